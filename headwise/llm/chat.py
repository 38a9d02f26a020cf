"""Roles of a transcript's utterances by a hidden Markov model, and canonical turns.

A transcript is a sequence of utterances, each some lines of text that may open with a speaker
marker. The hidden states are the roles. An utterance emits its marker, its length, its
number of lines, whether it opens the transcript and whether it asks. The model counts these in
transcripts with known roles; Viterbi recovers the likeliest roles of any other.

A long transcript is never one task's work. It is cut into blocks of utterances. Each block
is first reduced to the score of its best path from every role before it to every role at its
end (max-plus products), blocks of blocks are reduced likewise, and then roles are handed
down: from the transcript to its blocks, and from a block to its utterances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import fresh_name, ship
from headwise.session import materialise, scratch_path

#: Utterances (by number) in a block, and blocks in a block of blocks.
BLOCK = 256
#: Added to every count.
SMOOTHING = 0.5
#: Most roles that are told apart, the most frequent ones.
ROLES = 16

# Words that open a line as speaker markers, with what they stand for.
MARKERS = {
    "system": "system",
    "instructions": "system",
    "user": "user",
    "human": "user",
    "customer": "user",
    "question": "user",
    "q": "user",
    "assistant": "assistant",
    "bot": "assistant",
    "ai": "assistant",
    "agent": "assistant",
    "answer": "assistant",
    "a": "assistant",
}
_MARKER = r"(?i)^\s*(?:<\|im_start\|>|###|\[|\*\*)?\s*(" + "|".join(MARKERS) + r")\s*(?:\]|\*\*)?\s*(?::|>|\n|-\s)"


def features(text: Column, opens: Column) -> Column:
    """What an utterance emits, as one struct of small numbers and names."""
    body = F.coalesce(text, F.lit(""))
    marker = F.lower(F.regexp_extract(body, _MARKER, 1))
    known = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    size = F.least(F.floor(F.log2(F.length(body) + 1) * 2), F.lit(40))
    return F.struct(
        F.coalesce(F.try_element_at(known, marker), F.lit("none")).alias("marker"),
        size.cast("string").alias("size"),
        F.least(F.regexp_count(body, F.lit("\n")), F.lit(8)).cast("string").alias("lines"),
        F.when(F.rtrim(body).endswith("?"), "asks").otherwise("tells").alias("asks"),
        F.when(opens, "first").otherwise("later").alias("place"),
    )


FEATURES = ("marker", "size", "lines", "asks", "place")


def bare_text(text: Column) -> Column:
    """An utterance without its speaker marker and the white space around it."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _MARKER, ""))


@dataclass(frozen=True)
class RoleModel:
    """Log probabilities: of the first role, of a role after another, and of each feature's values."""

    roles: list[str]
    first: np.ndarray
    step: np.ndarray
    emits: dict[str, dict[str, np.ndarray]]
    unseen: dict[str, np.ndarray]

    def emission(self, frame: pd.DataFrame) -> np.ndarray:
        """(utterances x roles), from columns named as the features."""
        total = np.zeros((len(frame), len(self.roles)))
        for name in FEATURES:
            codes, values = pd.factorize(frame[name])
            table = np.array([self.emits[name].get(v, self.unseen[name]) for v in values]).reshape(-1, len(self.roles))
            total += table[codes]
        return total


def _utterances(turns: DataFrame, conv: str, order: str, text: str) -> DataFrame:
    """`key`, `nth` and `text`, and the hash that orders utterances of the same number."""
    return turns.select(
        F.col(conv).alias("key"), F.col(order).cast("long").alias("nth"), F.col(text).alias("text")
    ).withColumn("tie", F.xxhash64("text"))


def _opening(turns: DataFrame) -> DataFrame:
    """The smallest number of each transcript."""
    return turns.groupBy("key").agg(F.min("nth").alias("opening"))


def _marked(utterances: DataFrame) -> DataFrame:
    """Utterances with their features as columns and the block they belong to."""
    opening = _opening(utterances).withColumnRenamed("key", "of_key")
    joined = utterances.join(opening, F.col("key").eqNullSafe(F.col("of_key"))).drop("of_key")
    opens = F.coalesce(F.col("nth") == F.col("opening"), F.lit(True))
    return joined.withColumn("f", features(F.col("text"), opens)).withColumn(
        "block", F.coalesce(F.floor(F.col("nth") / BLOCK), F.lit(-(1 << 40)))
    )


def train(
    turns: DataFrame,
    conv: str = "conv_id",
    order: str = "turn",
    text: str = "text",
    role: str = "role",
    held_out: Column | None = None,
) -> RoleModel:
    """Count roles, successions and features over all transcripts where `held_out` doesn't hold.

    Utterances without a role are left out of the counts. A succession is counted between
    utterances whose numbers follow one another, found by a join on transcript and number,
    so that a long transcript is spread over tasks. What comes back is a few rows per role.
    """
    rows = turns.where(F.col(role).isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.select(conv, order, text, F.col(role).alias("role"))
    names = rows.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role").limit(ROLES).collect()
    roles = sorted(r["role"] for r in names)
    number = {r: i for i, r in enumerate(roles)}
    known = rows.where(F.col("role").isin(roles))
    keyed = known.select(F.col(conv).alias("key"), F.col(order).cast("long").alias("nth"), "text", "role")
    following = keyed.select("key", (F.col("nth") - 1).alias("nth"), F.col("role").alias("next"))
    size = len(roles)
    first, step = np.full(size, SMOOTHING), np.full((size, size), SMOOTHING)
    for r in keyed.join(following, ["key", "nth"]).groupBy("role", "next").agg(F.count("*").alias("n")).collect():
        step[number[r["role"]], number[r["next"]]] += r["n"]
    marked = _marked(keyed)
    emits: dict[str, dict[str, np.ndarray]] = {name: {} for name in FEATURES}
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"f.{n}").alias("value")) for n in FEATURES]))
    for r in marked.select("role", one.alias("v")).groupBy("role", "v").agg(F.count("*").alias("n")).collect():
        name, value = r["v"]["name"], r["v"]["value"]
        emits[name].setdefault(value, np.zeros(size))[number[r["role"]]] += r["n"]
    first += emits["place"].get("first", np.zeros(size))
    logs, unseen = {}, {}
    for name, table in emits.items():
        total = sum(table.values(), np.zeros(size)) + SMOOTHING * (len(table) + 1)
        logs[name] = {v: np.log((n + SMOOTHING) / total) for v, n in table.items()}
        unseen[name] = np.log(SMOOTHING / total)
    return RoleModel(roles, np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True)), logs, unseen)


# --- Viterbi in blocks -----------------------------------------------------------------


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in frames of whole groups, with where each group starts; NULL keys are equal."""
    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        starts = _starts(rest, keys)
        if len(starts) > 1:
            yield rest.iloc[: starts[-1]], starts[:-1]
            rest = rest.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, _starts(rest, keys)


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    same = np.ones(max(len(frame) - 1, 0), bool)
    for key in keys:
        left, right = frame[key].iloc[:-1].reset_index(drop=True), frame[key].iloc[1:].reset_index(drop=True)
        same &= ((left == right) | (left.isna() & right.isna())).to_numpy(bool)
    return np.flatnonzero(np.concatenate([[True], ~same])) if len(frame) else np.zeros(0, int)


def _steps(model: RoleModel, frame: pd.DataFrame) -> np.ndarray:
    """One matrix per utterance: from the role before it to its own role, its emission included.

    The utterance that opens a transcript has the same row for every role before it.
    """
    steps = np.repeat(model.step[None], len(frame), axis=0)
    steps[frame["place"].to_numpy() == "first"] = model.first[None, :]
    return steps + model.emission(frame)[:, None, :]


def _lanes(starts: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the second, third ... row of all groups at once: which groups have one, and the rows."""
    lengths = np.diff(np.append(starts, count))
    for nth in range(1, int(lengths.max(initial=0))):
        active = np.flatnonzero(lengths > nth)
        yield active, starts[active] + nth


def folded(matrices: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Best scores over each group: the max-plus product of its matrices."""
    total = matrices[starts].copy()
    for active, rows in _lanes(starts, len(matrices)):
        total[active] = (total[active][:, :, :, None] + matrices[rows][:, None, :, :]).max(axis=2)
    return total


def paths(matrices: np.ndarray, starts: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Role at the end of each row on its group's best path from role `before` to role `after`."""
    scores = matrices[starts, before].copy()
    back = np.zeros(matrices.shape[:2], np.int64)
    lanes = list(_lanes(starts, len(matrices)))
    for active, rows in lanes:
        through = scores[active][:, :, None] + matrices[rows]
        back[rows] = through.argmax(axis=1)
        scores[active] = through.max(axis=1)
    role, found = after.copy(), np.zeros(len(matrices), np.int64)
    found[np.append(starts[1:], len(matrices)) - 1] = after
    for active, rows in reversed(lanes):
        role[active] = back[rows, role[active]]
        found[rows - 1] = role[active]
    return found


def _matrices(frame: pd.DataFrame, size: int) -> np.ndarray:
    return np.stack(frame["matrix"].to_numpy()).reshape(-1, size, size)


def _reduced(size: int, matrices, group: str):
    """One row per group: key, block and the group's matrix; `matrices` are those of its rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, ["key", group]):
            total = folded(matrices(frame), starts)
            heads = frame.iloc[starts]
            yield pd.DataFrame({"key": heads["key"], "block": heads[group], "matrix": list(total.reshape(-1, size * size))})

    return run


def _ends(size: int):
    """A transcript's best last role, from the matrices of its topmost blocks; what is before it has no say."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, ["key"]):
            total = folded(_matrices(frame, size), starts)
            yield pd.DataFrame({"key": frame["key"].iloc[starts], "before": 0, "after": total[:, 0].argmax(axis=1)})

    return run


def _handed_down(matrices, group: str, kept: list[str]):
    """Rows of a group with the roles before and at the end of each, from those of the group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(frames, ["key", group]):
            given = frame[["before", "after"]].to_numpy(np.int64)
            after = paths(matrices(frame), starts, given[starts, 0], given[starts, 1])
            before = np.concatenate([[0], after[:-1]])
            before[starts] = given[starts, 0]
            yield frame[kept].assign(before=before, after=after)

    return run


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which NULL keys are equal."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(renamed, condition).drop(*[f"__{c}" for c in on])


def recover_roles(
    turns: DataFrame, model: RoleModel, conv: str = "conv_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """(conv, order, tie, role_pred): the likeliest role of every different utterance of a transcript.

    Utterances are in the order of their numbers, those with one number in the order
    of their text's hash (`tie`), and exact repeats of an utterance count once. Only text and order are looked
    at. Without roles to choose from there are no rows.
    """
    spark = turns.sparkSession
    ship(spark)
    size = len(model.roles)
    folder = scratch_path(spark, "chat")
    kind = turns.schema[conv].dataType.simpleString()
    utterances = _utterances(turns, conv, order, text)
    once = utterances.groupBy("key", "nth", "tie").agg(F.min("text").alias("text"))
    lines = _marked(once).select("key", "nth", "tie", "block", *[f"f.{n}" for n in FEATURES])
    lines = materialise(lines if size else lines.limit(0), f"{folder}/lines")
    schema = f"key {kind}, block long, matrix array<double>"
    def steps(frame: pd.DataFrame) -> np.ndarray:
        return _steps(model, frame)

    def stored(frame: pd.DataFrame) -> np.ndarray:
        return _matrices(frame, size)

    def grouped(frame: DataFrame, group: list[str], order: list[str], run, schema: str) -> DataFrame:
        return frame.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)

    schema, roles = f"key {kind}, block long, matrix array<double>", "before int, after int"
    first = grouped(lines, ["key", "block"], ["nth", "tie"], _reduced(size, steps, "block"), schema)
    levels = [materialise(first, f"{folder}/level=0")]
    while levels[-1].groupBy("key").agg(F.count("*").alias("n")).where(f"n > {BLOCK}").take(1):
        above = levels[-1].withColumn("above", F.floor(F.col("block") / BLOCK))
        next_level = grouped(above, ["key", "above"], ["block"], _reduced(size, stored, "above"), schema)
        levels.append(materialise(next_level, f"{folder}/level={len(levels)}"))
    top = grouped(levels[-1], ["key"], ["block"], _ends(size), f"key {kind}, {roles}")
    ends = materialise(top.withColumn("above", F.lit(0).cast("long")), f"{folder}/ends")
    for level in range(len(levels) - 1, -1, -1):
        above = F.lit(0).cast("long") if level == len(levels) - 1 else F.floor(F.col("block") / BLOCK)
        given = _joined(levels[level].withColumn("above", above), ends, ["key", "above"])
        hand_down = _handed_down(stored, "above", ["key", "block"])
        down = grouped(given, ["key", "above"], ["block"], hand_down, f"key {kind}, block long, {roles}")
        ends = materialise(down.withColumnRenamed("block", "above"), f"{folder}/down={level}")
    given = _joined(lines.withColumn("above", F.col("block")), ends, ["key", "above"])
    hand_down = _handed_down(steps, "block", ["key", "nth", "tie"])
    named = grouped(given, ["key", "block"], ["nth", "tie"], hand_down, f"key {kind}, nth long, tie long, {roles}")
    names = F.array(*[F.lit(r) for r in model.roles]).cast("array<string>")
    return named.select(
        F.col("key").alias(conv), F.col("nth").alias(order), "tie", F.get(names, F.col("after")).alias("role_pred")
    )


def render(role: Column, text: Column) -> Column:
    """One canonical turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), bare_text(text), F.lit("<|im_end|>\n"))


def format_turns(
    turns: DataFrame, model: RoleModel, conv: str = "conv_id", order: str = "turn", text: str = "text"
) -> DataFrame:
    """All columns of `turns`, and `role_pred` and `rendered` (an underscore is added to a taken name).

    Every row stays, repeats included; a NULL or empty text renders as an empty turn. Rows
    without a number come first in their transcript, and rows without a transcript's id are one
    transcript. A turn is rendered by itself, so that no transcript is put together in one
    task; in order, a transcript's turns make its text. With no roles learned both are NULL.
    """
    predicted, rendered = fresh_name(turns, "role_pred"), fresh_name(turns, "rendered")
    key, nth, tie, role = (fresh_name(turns, name) for name in ("__key", "__nth", "__tie", "__role"))
    found = recover_roles(turns, model, conv, order, text).select(
        F.col(conv).alias(key), F.col(order).alias(nth), F.col("tie").alias(tie), F.col("role_pred").alias(role)
    )
    same = (
        F.col(conv).eqNullSafe(F.col(key))
        & F.col(order).cast("long").eqNullSafe(F.col(nth))
        & (F.xxhash64(F.col(text)) == F.col(tie))
    )
    return turns.join(found, same, "left").select(
        *turns.columns, F.col(role).alias(predicted), render(F.col(role), F.col(text)).alias(rendered)
    )
