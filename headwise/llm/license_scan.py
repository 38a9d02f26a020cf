"""Licence notices in texts, by a positional index of rare words; DataFrame operations only.

Templates (notices, and the phrases of the registered query) are kept as two small tables: their words,
and postings (word, template, place) of the rarest words of each one's mandatory key phrase. Wherever such a word stands in a
text, each of its postings says where the template would begin; places on which all postings of a template
agree are candidates, and the template's words are held against the text there. A template counts if its key
phrase stands word for word and enough of its weight is there. As a key phrase has all of its own
rarest words, no place that could count is passed over, however many licence words a text has.
"""

from __future__ import annotations

import json
from math import log
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.session import materialise, scratch_path

#: Least share of a template's weight.
SHARE = 0.6
#: Postings of a template: so many of its key phrase's rarest words (all, if it has fewer).
ANCHORS = 3

# The phrases of the registered query and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening words of common notices (label, mandatory key phrase, notice).
NOTICES = (
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("mit", "mit license", "released under the mit license"),
    (
        "mit",
        "free of charge to any person obtaining a copy",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted",
    ),
    (
        "mpl-2.0",
        "mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    (
        "gpl-3.0",
        "gnu general public license as published by the free software foundation either version 3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3",
    ),
    (
        "gpl-2.0",
        "gnu general public license as published by the free software foundation either version 2",
        "under the terms of the gnu general public license as published by the free software foundation either version 2",
    ),
    (
        "lgpl-3.0",
        "gnu lesser general public license version 3",
        "this work is licensed under the gnu lesser general public license version 3",
    ),
    (
        "lgpl-2.1",
        "gnu lesser general public license version 2 1",
        "this work is licensed under the gnu lesser general public license version 2 1",
    ),
    (
        "agpl-3.0",
        "gnu affero general public license version 3",
        "this work is licensed under the gnu affero general public license version 3",
    ),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0-1.0", "cc0 1 0", "dedicated to the public domain under cc0 1 0"),
    (
        "isc",
        "modify and or distribute this software for any purpose",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    (
        "unlicense",
        "free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain",
    ),
    ("zlib", "without any express or implied warranty", "this software is provided as is without any express or implied warranty"),
    ("epl-2.0", "eclipse public license v 2 0", "made available under the terms of the eclipse public license v 2 0"),
)
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _templates(phrases, notices) -> list[dict]:
    """Phrases and notices alike: words, place and length of the key phrase, label; `base` marks a phrase."""
    made = []
    for label, key, notice, base in [(x, p, p, True) for p, x in phrases] + [(*n, False) for n in notices]:
        words, parts = notice.split(), key.split()
        places = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        if not parts or not places:
            raise ValueError(f"key phrase {key!r} doesn't stand in its notice")
        made.append({"words": words, "key_at": places[0], "key_size": len(parts), "label": label, "base": base})
    return [{"template": nth, **t} for nth, t in enumerate(made)]


def _vocabulary(phrases=PHRASES, notices=NOTICES) -> list[str]:
    return sorted({w for t in _templates(phrases, notices) for w in t["words"]})


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; a NULL has none."""
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(_WORD), F.lit(0))


def _key_phrase(template: dict) -> list[str]:
    return template["words"][template["key_at"] : template["key_at"] + template["key_size"]]


def _holds_phrase(found: Column, templates: list[dict]) -> Column:
    """Whether all words of some key phrase are among those found; long words are asked for first."""
    phrases = {tuple(sorted(set(_key_phrase(t)), key=lambda w: (-len(w), w))) for t in templates}
    whole = F.array(*[_strings(list(p)) for p in sorted(phrases)])
    return F.exists(whole, lambda p: F.forall(p, lambda w: F.array_contains(found, w)))


def rarity(found: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log((1 + documents) / (1 + documents with the word)) per licence word, over all documents.

    `found` has the licence words of each document as `found`. One row per licence word
    comes back, a number fixed by the templates.
    """
    total = found.count()
    counts = found.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    seen = {r["word"]: r["n"] for r in counts}
    # A word of every document still counts a little.
    return {w: log((1 + total) / (1 + seen.get(w, 0))) + 1e-6 for w in vocabulary}


def _small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows made from the templates, as a frame; bounded by them, so it may be broadcast."""
    every = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(every)))


def _postings(templates: list[dict], idf: dict[str, float]) -> list[dict]:
    """(word, template, place) of the rarest words of each key phrase; `lead` marks the rarest."""
    rows = []
    for t in templates:
        key = _key_phrase(t)
        rarest = sorted(set(key), key=lambda w: (-idf[w], w))[:ANCHORS]
        rows += [
            {"word": w, "template": t["template"], "place": t["key_at"] + key.index(w), "lead": nth == 0, "anchors": len(rarest)}
            for nth, w in enumerate(rarest)
        ]
    return rows


def _hits(held: DataFrame, postings: list[dict], reach: int) -> DataFrame:
    """Every place of an indexed word: row, at, word, and around a leading word the words within `reach` from place `lo` on."""
    indexed = _strings(sorted({p["word"] for p in postings}))
    leading = _strings(sorted({p["word"] for p in postings if p["lead"]}))
    words = F.col("words")
    standing = F.filter(
        F.transform(words, lambda w, at: F.struct(at.alias("at"), w.alias("word"))),
        lambda x: F.array_contains(indexed, x["word"]),
    )

    def surrounded(x: Column) -> Column:
        lo = F.greatest(x["at"] - reach, F.lit(0))
        near = F.when(F.array_contains(leading, x["word"]), F.slice(words, lo + 1, 2 * reach + 1))
        return F.struct(x["at"].alias("at"), x["word"].alias("word"), lo.alias("lo"), near.alias("near"))

    split = held.select("row", words_of(F.col("kept")).alias("words"))
    return split.select("row", F.inline(F.transform(standing, surrounded)))


def _candidates(hits: DataFrame, postings: DataFrame) -> DataFrame:
    """Places (row, template, start) on which all postings of a template agree, with the words around the leading one."""
    around = F.when(F.col("lead"), F.struct("lo", "near"))
    return (
        hits.join(postings, "word")
        .groupBy("row", "template", (F.col("at") - F.col("place")).alias("start"), "anchors")
        .agg(F.count("*").alias("agreed"), F.max(around).alias("around"))
        .where("agreed = anchors")
        .select("row", "template", "start", "around.lo", "around.near")
    )


def _verified(candidates: DataFrame, templates: DataFrame) -> DataFrame:
    """Candidates whose key phrase stands word for word and that have enough of the template's weight, with that share."""
    first = F.col("start") - F.col("lo")
    same = F.transform("words", lambda w, j: F.coalesce(F.get("near", first + j) == w, F.lit(False)))
    weighed = F.zip_with("same", "weights", lambda s, x: F.when(s, x).otherwise(0.0))
    share = F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b) / F.col("weight")
    key_stands = F.forall(F.slice("same", F.col("key_at") + 1, F.col("key_size")), lambda s: s)
    return (
        candidates.join(templates, "template")
        .withColumn("same", same)
        .where(key_stands)
        .select("row", "start", "label", "base", F.least(share, F.lit(1.0)).alias("share"))
        .where(F.col("base") | (F.col("share") >= SHARE))
    )


def scan(
    docs: DataFrame, id: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are those whose phrase (phrase, label) stands somewhere; n_base counts all such places, and
    first_word and last_word are their smallest and largest start. `labels` adds the labels
    of notices (label, key phrase, notice; words in small letters, parted by one space). The score is the largest share
    of a notice that counts, 1 for a phrase, and 0 without either, to nine digits. A NULL or empty text has no words
    and no labels (empty strings). Repeated rows stay. No documents give no rows. A key phrase that doesn't stand in its
    notice is a ValueError.

    Words of every text are counted and looked up once. Only a text that has all words of a key phrase
    is kept for the positions, since no other can match. From it go the places of indexed words, and around
    leading ones as many words as the longest template has; whole texts are not shuffled. Templates may be hundreds: they are rows
    of a table, not expressions.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "licences")
    templates = _templates(phrases, notices)
    vocabulary = _vocabulary(phrases, notices)
    all_words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_WORD), F.lit(0))
    looked = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), all_words.alias("words")).select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.array_intersect("words", _strings(vocabulary)).alias("found"),
    )
    kept = F.when(_holds_phrase(F.col("found"), templates), F.col("text")).alias("kept")
    read = materialise(looked.select("row", "id", "n_words", "found", kept), f"{folder}/words")
    idf = rarity(read.select("found"), vocabulary)
    postings = _postings(templates, idf)
    weighed = [{**t, "weights": (w := [idf[x] for x in t["words"]]), "weight": sum(w)} for t in templates]
    hits = _hits(read.where("kept IS NOT NULL"), postings, max(len(t["words"]) for t in templates))
    candidates = _candidates(
        hits, _small_table(spark, postings, "word: string, template: int, place: int, lead: boolean, anchors: int")
    )
    schema = (
        "template: int, words: array<string>, weights: array<double>, weight: double, "
        "key_at: int, key_size: int, label: string, base: boolean"
    )
    found = (
        _verified(candidates, _small_table(spark, weighed, schema))
        .groupBy("row")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
            _joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
            _joined(F.collect_set("label")).alias("labels"),
            F.round(F.max(F.when(F.col("base"), 1.0).otherwise(F.col("share"))), 9).alias("score"),
        )
    )
    missing = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    every = read.select("row", "id", "n_words").join(found, "row", "left").na.fill(missing).drop("row")
    return every.withColumnRenamed("id", id)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")
