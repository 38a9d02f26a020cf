"""The training-data operators as registered queries, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.llm import (
    alignment,
    chat,
    decontamination,
    exact_dedup,
    language,
    license_scan,
    line_dedup,
    mixing,
    prefix_trie,
    simhash,
    token_output,
    toxicity,
    url_filter,
)
from headwise.llm.common import documents, remainder
from headwise.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_output.write_sequences(documents(spark, sf_dir), folder, tokenizer_path(), end_id=2)
    return token_output.read_digests(spark, folder)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 3) == 1
    model = language.train(docs, held_out=held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, distance=2, seed=42)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per benchmark item found in a document; documents without any give none."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.train(docs, labels, held_out=held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "toxic_sentences")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(documents(spark, sf_dir))
    return planned.withColumn("taken", F.col("size") * F.col("copies")).drop("copies")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(pages, model).drop("url")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its recovered role; learned from the transcripts that aren't held out."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    held_out = remainder("conv_id", 5) == 0
    model = chat.train(turns, held_out=held_out)
    found = chat.format_turns(turns, model)
    return found.select("conv_id", "turn", held_out.alias("held_out"), "role", "role_pred", "rendered")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    return alignment.compare_tokenizers(
        documents(spark, sf_dir), known.path("byte_bpe_50k.json"), known.path("piece_bpe_32k.model")
    )


def queries() -> dict[str, Query]:
    registered = (
        op1_token_output,
        op2_language_id,
        op3_simhash,
        op4_decontamination,
        op5_toxicity,
        op6_exact_dedup,
        op7_mixing,
        op8_url_filter,
        op9_chat_format,
        op10_license_scan,
        op11_line_dedup,
        op12_prefix_trie,
        op13_alignment,
    )
    return {query.__name__: query for query in registered}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": _EXACT,
        "op7_mixing": _MIXING,
        "op10_license_scan": _licences(),
        "op11_line_dedup": _LINES,
        "op12_prefix_trie": _TRIE,
    }


def _licences() -> str:
    """SQL over the phrases and notices as rows: every place of every word of theirs, lined up by start."""
    rows = [(label, phrase, phrase, True) for phrase, label in license_scan.PHRASES]
    rows += [(label, key, notice, False) for label, key, notice in license_scan.NOTICES]
    values = ", ".join(f"({n}, '{label}', '{key}', '{text}', {base})" for n, (label, key, text, base) in enumerate(rows))
    return _LICENCES.replace("$templates", values).replace("$share", str(license_scan.SHARE))


_EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""

_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, nth) AS place FROM s
), l AS (
  SELECT a.source, a.source_size, a.weight, a.place,
         ((SELECT sum(source_size) FROM o)
          - 3 * coalesce((SELECT sum(source_size) FROM o b WHERE b.place < a.place), 0))::DOUBLE
         / (SELECT sum(weight) FROM o b WHERE b.place >= a.place) AS level
  FROM o a
), t AS (
  SELECT source, source_size,
         least(3.0::DOUBLE * source_size, coalesce(
           (SELECT level FROM l WHERE level * weight < 3 * source_size ORDER BY place LIMIT 1) * weight,
           3.0::DOUBLE * source_size)) AS target
  FROM l
), r AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

_LICENCES = r"""
WITH t(nth, label, key, notice, base) AS (VALUES $templates),
tw AS (
  SELECT nth, label, base, key_size, unnest(range(len(words))) AS j, unnest(words) AS word, key_at
  FROM (SELECT *, string_split(notice, ' ') AS words, len(string_split(key, ' ')) AS key_size,
               len(regexp_extract_all(left(notice, strpos(' ' || notice || ' ', ' ' || key || ' ') - 1), '[^ ]+')) AS key_at
        FROM t)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), p AS MATERIALIZED (
  SELECT * FROM (SELECT r, unnest(range(len(words))) AS place, unnest(words) AS word FROM d)
  WHERE word IN (SELECT word FROM tw)
), idf AS (
  SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + count(DISTINCT r))) + 1e-6 AS idf
  FROM (SELECT DISTINCT word FROM tw) LEFT JOIN p USING (word) GROUP BY word
), weights AS (
  SELECT nth, sum(idf) AS weight FROM tw JOIN idf USING (word) GROUP BY nth
), lined AS (
  SELECT r, nth, label, base, place - j AS start, key_size, sum(idf) / any_value(weight) AS share,
         count(*) FILTER (WHERE j BETWEEN key_at AND key_at + key_size - 1) AS in_key
  FROM p JOIN tw USING (word) JOIN idf USING (word) JOIN weights USING (nth)
  GROUP BY r, nth, label, base, place - j, key_size
), found AS (
  SELECT * FROM lined WHERE in_key = key_size AND (base OR share >= $share)
)
SELECT any_value(doc_id) AS doc_id, any_value(len(words))::BIGINT AS n_words, count(*) FILTER (WHERE base) AS n_base,
       min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       coalesce(round(max(CASE WHEN base OR share > 1 THEN 1.0::DOUBLE ELSE share END), 9), 0) AS score
FROM d LEFT JOIN found USING (r) GROUP BY r
"""

_LINES = r"""
WITH l AS (
  SELECT doc_id, nth, parts[nth] AS line,
         translate(regexp_replace(parts[nth], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS nth
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), k AS (
  SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(k.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE k.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id
"""

_TRIE = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                      lambda s, i: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT convs.c, place, role, text FROM convs JOIN t ON t.c = base AND place <= h
  UNION ALL
  SELECT convs.c, place + 10, role, text FROM convs JOIN t ON t.c = convs.c AND place > h
), p AS (
  SELECT c, row_number() OVER w AS depth, length(text) AS points,
         md5(string_agg(md5(role) || md5(text), '' ORDER BY place) OVER w) AS node
  FROM r WINDOW w AS (PARTITION BY c ORDER BY place)
), m AS (
  SELECT c, depth, points, node, lag(node, 1, 'root') OVER (PARTITION BY c ORDER BY depth) AS above,
         depth = max(depth) OVER (PARTITION BY c) AS ends
  FROM p
  UNION ALL
  SELECT c, 0, 0, 'root', NULL, c NOT IN (SELECT c FROM p) FROM convs
), n AS (
  SELECT node, any_value(depth) AS depth, any_value(above) AS above, any_value(points) AS points, min(c) AS conv_id,
         count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY node
), kids AS (
  SELECT above AS node, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above
), under AS (
  SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.c = b.c AND b.depth >= a.depth
), sums AS (
  SELECT top AS node, count(*) FILTER (WHERE kids.node IS NULL) AS n_leaves,
         sum((n_convs - 1) * points)::BIGINT AS saved_tokens
  FROM under JOIN n ON n.node = under.node LEFT JOIN kids ON kids.node = under.node GROUP BY top
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM n JOIN sums ON sums.node = n.node LEFT JOIN kids ON kids.node = n.node LEFT JOIN n up ON up.node = n.above
"""
