"""Operators that learn: held-out accuracy, planted cases, and exact parts against brute force."""

import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headwise.llm import chat, decontamination, language, queries, toxicity
from headwise.session import materialise, scratch_path

SF = "/root/testdata/sf0.01"


# --- languages -------------------------------------------------------------------------


def test_ngrams_of_texts_in_a_batch_equal_those_alone():
    texts = ["Ab, cd!", "", "é", "12", "x  y", "ÄÖÜ straße", " lead", "tail "]
    hashes, bounds = language.ngrams(texts)
    for i, text in enumerate(texts):
        alone = language.ngrams([text])[0]
        assert hashes[bounds[i] : bounds[i + 1]].tolist() == alone.tolist()
    assert np.diff(bounds)[[1, 3]].tolist() == [0, 0]
    assert language.ngrams(["Ab"])[0].tolist() == language.ngrams(["  aB "])[0].tolist()


def test_the_filter_returns_all_languages_of_an_ngram():
    grams = np.random.default_rng(3).integers(0, 1 << 64, 5000, dtype=np.uint64)
    rows = np.zeros((language.ROWS, 2), np.uint64)
    owner = {int(g): {i % 70, (i * 7) % 70} for i, g in enumerate(grams)}
    for gram, langs in owner.items():
        for nth, lang in itertools.product(range(language.HASHES), langs):
            rows[language.row_of(np.array([gram], np.uint64), nth), lang // 64] |= np.uint64(1 << lang % 64)
    model = language.LanguageFilter([f"l{i:02d}" for i in range(70)], rows, np.zeros(70))
    masks = model.masks(grams)
    for gram, mask in zip(grams.tolist(), masks):
        found = {b for b in range(70) if int(mask[b // 64]) >> (b % 64) & 1}
        assert owner[gram] <= found


def test_held_out_languages(spark):
    found = queries.op2_language_id(spark, SF).toPandas().merge(
        duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df(), on="doc_id"
    )
    held = found[found.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()


# --- toxicity --------------------------------------------------------------------------


def test_held_out_toxicity(spark):
    found = queries.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(
        duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").df(), on="doc_id"
    )
    held = found[found.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.02
    toxic = held[(held.toxic == 1) & (held.predicted == 1)]
    assert (toxic.toxic_sentences.map(len) > 0).mean() > 0.95


def test_noisy_or_finds_the_sentence_word():
    """Word 0 makes a bag toxic; word 1 is in half of all bags."""
    rng = np.random.default_rng(0)
    labels = np.arange(400) % 2
    counts = np.full(400, 10)
    bag = np.concatenate([np.flatnonzero(labels), np.flatnonzero(rng.random(400) < 0.5)])
    word = np.concatenate([np.zeros(200, int), np.ones(len(bag) - 200, int)])
    sentence = np.where(word == 0, bag * 10, bag * 10 + 1)
    weights = toxicity.fit_noisy_or(labels, counts, bag, sentence, word, 2, np.ones(400))
    p = 1 / (1 + np.exp(-(weights[-1] + weights[:2])))
    assert p[0] > 0.95 and p[1] < 0.1 and weights[-1] < -3


def test_a_long_clean_document_is_not_toxic_by_length(spark):
    rows = [(i, ("Fine words here. " * 30) + ("You moron. " if i % 2 else ""), i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.drop("toxic"), frame.select("doc_id", "toxic"))
    test = spark.createDataFrame([(1, "Fine words here. " * 5000), (2, "Quite new. You MORON, go! Bye."), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(test, model).collect()}
    assert [found[i].predicted for i in (1, 2, 3)] == [0, 1, 0] and found[3].score == 0
    assert [s.sentence for s in found[2].toxic_sentences] == ["You MORON, go"]


# --- decontamination -------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_common_subsequence_equals_the_table(seed):
    draw = random.Random(seed)
    a, b = ([draw.randrange(6) for _ in range(draw.randrange(40))] for _ in range(2))
    rows = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        rows[i + 1, j + 1] = rows[i, j] + 1 if a[i] == b[j] else max(rows[i, j + 1], rows[i + 1, j])
    assert decontamination.common_subsequence(np.array(a), np.array(b)) == rows[-1, -1]


def test_exact_paraphrased_and_clean(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    text = lambda n: " ".join(word() for _ in range(n))
    items = {i: text(n) + ". " + text(6) for i, n in enumerate((4, 12, 25, 50, 200))}
    docs, expected = {}, set()
    for i, item in items.items():
        words = item.replace(".", "").split()
        docs[100 + i] = f"{text(300)} {item.upper()} {text(300)}"
        mixed = [w for w in words[:-6] for w in ([w] if draw.random() < 0.85 else [word()])] + words[-6:]
        docs[200 + i] = f"{text(80)} {' '.join(mixed)} {text(20)}"
        docs[300 + i] = f"{text(200)} {' '.join(words[: len(words) // 4])} {text(200)}"
        expected |= {(100 + i, i)} | ({(200 + i, i)} if len(words) > 12 else set())
    docs |= {i: text(200) for i in range(50)}
    found = decontamination.find_leaks(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
    )
    pairs = {(r.doc_id, r.item_id) for r in found.select("doc_id", F.explode("leaks.item_id").alias("item_id")).collect()}
    assert expected <= pairs and all(d >= 100 and d < 300 for d, _ in pairs)


def test_planted_items_are_found_and_others_left_alone(spark):
    normal = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9\\x80-\\x{10ffff}]+', ' ', 'g')) || ' '"
    planted = duckdb.sql(
        f"""SELECT doc_id, item_id FROM (SELECT doc_id, {normal} AS t FROM '{SF}/documents.parquet') d
            JOIN (SELECT item_id, {normal} AS t FROM '{SF}/benchmark.parquet') b ON contains(d.t, b.t)"""
    ).fetchall()
    found = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()}
    assert planted and set(planted) <= found and len(found - set(planted)) <= len(planted) // 20


def planted(spark, items, hosts, copies):
    """(document, item) of copies put into documents, and those of them that are found."""
    pieces = [t.split() for t in hosts]
    for nth, (at, item) in enumerate(copies):
        pieces[at].insert(nth * 7919 % (len(pieces[at]) + 1), items[item])
    texts = [(i, " ".join(p)) for i, p in enumerate(pieces)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    stated = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontamination.find_leaks(docs, stated).select("doc_id", F.explode("leaks.item_id").alias("item_id"))
    return set(copies), {(r.doc_id, r.item_id) for r in found.collect()}


def some_texts():
    rows = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    return [r[0] for r in rows if 60 <= len(r[0].split()) <= 600]


@pytest.mark.parametrize("count", [2_000, 5_000])
def test_copies_are_found_however_many_items_there_are(spark, count):
    draw, texts = random.Random(count), some_texts()
    hosts, items = texts[::2], []
    while len(items) < count:
        words = draw.choice(texts[1::2]).split()
        size = draw.randrange(16, 51)
        at = draw.randrange(len(words) - size + 1)
        items.append(" ".join(words[at : at + size]))
    wanted, found = planted(spark, items, hosts[:120], [(i, draw.randrange(count)) for i in range(120)])
    assert not wanted - found


@pytest.mark.parametrize("every", [3, 1])
def test_a_passage_that_stands_in_many_documents_is_found(spark, every):
    hosts = some_texts()[:150]
    draw, known = random.Random(7), sorted({w for t in hosts for w in t.split()})
    hot = ["single", " ".join(f"hot{i}" for i in range(5)), " ".join(f"warm{i}" for i in range(18)), " ".join(f"lava{i}" for i in range(80))]
    items = [*hot, *(" ".join(draw.choices(known, k=draw.randrange(10, 60))) for _ in range(150))]
    copies = [(at, item) for item in range(len(hot)) for at in range(0, 150, every)]
    wanted, found = planted(spark, items, hosts, copies)
    assert not wanted - found


def test_the_latent_space_is_that_of_the_passages(spark):
    draw = random.Random(2)
    items = spark.createDataFrame([(i, " ".join(f"w{draw.randrange(300)}" for _ in range(30))) for i in range(40)], "item_id long, text string")
    idf = np.ones(decontamination.BUCKETS, np.float32)
    basis = decontamination.latent_space(items, idf, rank=64).astype(np.float64)
    matrix = np.zeros((40, decontamination.FEATURES))
    for i, row in enumerate(items.collect()):
        (at, weight), = decontamination._unit_rows(row.text, idf)
        np.add.at(matrix[i], at, weight)
    assert np.allclose(matrix @ basis @ basis.T, matrix, atol=1e-3)  # rank 40 fits into 64 directions


# --- chats -----------------------------------------------------------------------------


def test_blocks_give_the_path_of_plain_viterbi(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    draw = random.Random(4)
    rows = [(c, t, draw.choice(["user", "assistant", "system"]), "x" * draw.randrange(400) + draw.choice(["?", "\n", ""]))
            for c, n in ((1, 90), (2, 3), (3, 17)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.train(turns)
    found = {(r.conv_id, r.turn): r.role_pred for r in chat.recover_roles(turns, model).collect()}
    frame = turns.withColumn("f", chat.features(F.col("text"), F.col("turn") == 0)).select("conv_id", "turn", "f.*").toPandas()
    for conv, own in frame.groupby("conv_id"):
        own = own.sort_values("turn")
        emission = model.emission(own)
        score = model.first + emission[0]
        back = []
        for e in emission[1:]:
            through = score[:, None] + model.step
            back.append(through.argmax(axis=0))
            score = through.max(axis=0) + e
        path = [int(score.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        names = [model.roles[p] for p in path[::-1]]
        assert [found[conv, t] for t in own.turn] == names


def test_held_out_roles(spark):
    found = queries.op9_chat_format(spark, SF).toPandas()
    held = found[found.held_out]
    assert len(held) > 50 and (held.role == held.role_pred).mean() > 0.95
    assert found.rendered.str.startswith("<|im_start|>").all()


def test_markers_decide_and_are_taken_off(spark):
    rows = [(c, t, r, f"{m}: {'word ' * 20}") for c in range(20) for t, (r, m) in enumerate([("user", "Human"), ("assistant", "AI")] * 3)]
    model = chat.train(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = spark.createDataFrame([(1, 0, "AI: hello"), (1, 1, "### Human: and so"), (1, 2, "[bot] > fine")], "conv_id long, turn long, text string")
    found = sorted((r.turn, r.role_pred, r.rendered) for r in chat.format_turns(turns, model).collect())
    assert [f[1] for f in found] == ["assistant", "user", "assistant"]
    assert found[1][2] == "<|im_start|>user\nand so<|im_end|>\n"


# --- pipeline --------------------------------------------------------------------------


def test_stages_take_effect(spark):
    folder = scratch_path(spark, "stages")
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"{folder}/{name}")
        seen[name] = docs
        counts.append(docs.count())
        assert name == "token_output" or docs.columns == columns
    toxic = pd.Series([r.doc_id for r in queries.op5_toxicity(spark, SF).where("predicted = 1").collect()])
    left = {r.doc_id for r in seen["toxicity"].select("doc_id").collect()}
    assert len(set(toxic) & left) < len(toxic) / 4
    classes = queries.op3_simhash(spark, SF)
    leaders = {r.component_id for r in seen["toxicity"].join(classes, "doc_id").select("component_id").collect()}
    assert counts[1] >= len(leaders) * 0.95 and seen["simhash_near_dedup"].select("doc_id").distinct().count() == counts[1]
    leaks = {r.doc_id for r in queries.op4_decontamination(spark, SF).collect()}
    assert not leaks & {r.doc_id for r in seen["decontamination"].select("doc_id").collect()}
    assert counts[3] == counts[4] == seen["token_output"].count()
    assert counts[0] > counts[1] > counts[2]
