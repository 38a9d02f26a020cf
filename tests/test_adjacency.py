"""Slotted lag against a plain loop, over groups that one task would otherwise hold."""

import random
from collections import defaultdict

import pytest

from headwise.operators.adjacency import with_previous

SCHEMA = "g string, t bigint, k string, s bigint"


def make(seed, n=400):
    pick = random.Random(seed)
    # A third of all rows fall into one group, and many times repeat.
    return sorted(
        {
            (
                "hot" if pick.random() < 0.4 else f"g{pick.randrange(6)}",
                pick.choice([pick.randrange(-500, 4000), pick.randrange(0, 40) * 100]),
                f"k{pick.randrange(12)}",
                pick.randrange(3),
            )
            for _ in range(n)
        }
    )


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row[1:])
    result = {}
    for g, members in groups.items():
        members.sort()
        for before, (t, k, s) in zip([None, *members], members):
            result[g, t, k, s] = before[:2] if before else (None, None)
    return result


def run(spark, rows, width, max_gap):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    linked = with_previous(frame, ["g"], "t", ["k", "s"], {"pt": "t", "pk": "k"}, width, max_gap)
    found = linked.collect()
    assert sorted((r.g, r.t, r.k, r.s) for r in found) == rows
    return {(r.g, r.t, r.k, r.s): (r.pt, r.pk) for r in found}


@pytest.mark.parametrize("width", [50, 700, 10_000])
def test_unbounded(spark, width):
    rows = make(width)
    assert run(spark, rows, width, None) == brute(rows)


@pytest.mark.parametrize("width,max_gap", [(60, 60), (200, 30), (5000, 120), (120, 0)])
def test_bounded(spark, width, max_gap):
    rows = make(width + max_gap)

    def near(links):
        return {key: link for key, link in links.items() if link[0] is not None and key[1] - link[0] <= max_gap}

    assert near(run(spark, rows, width, max_gap)) == near(brute(rows))


def test_gap_wider_than_slot_is_refused(spark):
    with pytest.raises(ValueError):
        run(spark, make(1), 10, 20)
