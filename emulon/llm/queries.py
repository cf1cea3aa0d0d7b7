"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulon.llm import bpe, itq, langid, lines, lm, negatives, packing, postings, repair, simhash, spelling, surrogates, warc
from emulon.llm.common import crc_fold
from emulon.runtime import scratch_path

#: The key of surrogates; a real run takes a secret of its own.
KEY = b"surrogates of the registered query"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@_query
def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    repair.write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return repair.digest(repair.read(spark, path))


@_query
def op2_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


@_query
def op3_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op4_line_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_gone"), "text")


#: Sets share a word among the rarest ``size - ceil(0.8 size) + 1``, so pairs are looked for there and then compared in full.
SQL["op4_line_set_join"] = r"""
WITH cut AS (
  SELECT doc_id, text, len(string_split(text, chr(10))) AS n_lines,
         unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents),
lines AS (
  SELECT doc_id, line, content, n_lines,
         list_sort(list_filter(list_distinct(string_split_regex(lower(content), '\s+')), lambda w: w <> '')) AS words
  FROM cut),
firsts AS (SELECT words, min((doc_id, line)) AS first, len(words) AS size FROM lines WHERE len(words) > 0 GROUP BY words),
each_word AS (SELECT first, size, words, unnest(words) AS word FROM firsts),
rarity AS (SELECT word, count(*) AS n FROM each_word GROUP BY word),
ranked AS (SELECT first, size, words, word, row_number() OVER (PARTITION BY first ORDER BY n, word) AS place FROM each_word JOIN rarity USING (word)),
prefix AS (SELECT * FROM ranked WHERE place <= size - ceil(0.8 * size - 1e-9) + 1),
near AS (
  SELECT DISTINCT b.first FROM prefix a JOIN prefix b ON a.word = b.word AND a.first < b.first
  WHERE least(a.size, b.size) >= 0.8 * greatest(a.size, b.size) - 1e-9
    AND len(list_intersect(a.words, b.words)) >= 0.8 * (a.size + b.size - len(list_intersect(a.words, b.words))) - 1e-9),
judged AS (
  SELECT l.doc_id, l.line, l.content, l.n_lines,
         f.first IS NOT NULL AND (f.first <> (l.doc_id, l.line) OR s.first IS NOT NULL) AS gone
  FROM lines l LEFT JOIN firsts f ON f.words = l.words LEFT JOIN near s ON s.first = f.first)
SELECT doc_id, any_value(n_lines)::INT AS n_lines, sum(gone::INT)::INT AS n_gone,
       coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, NULL FROM documents WHERE text IS NULL""".replace("\\\\", "\\")


@_query
def op5_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(embeddings(spark, sf_dir), threshold=0.93)


@_query
def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, max_bits=4)


@_query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(documents(spark, sf_dir).select("doc_id", "text"), KEY, count="n_entities").select(
        "doc_id", "n_entities", "text")


@_query
def op8_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0, k=10)


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 3)
    model = langid.train(docs, fold != 1)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


@_query
def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 5) == 1
    model, tries, rare = lm.train(docs.where(~held_out), rare_pairs=True)
    return lm.score(docs, model, tries, rare).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op11_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(documents(spark, sf_dir), least_letters=6, least_count=5, every=199)
    return spelling.variants(words, ratio=5).select("word", "n", "form", "root", "n_near", "form_n")


#: The hash of a text is the exclusive sum of what each byte adds, given how many bytes follow it.  Words one edit apart
#: are equal without one letter.
SQL["op11_frequency_trie"] = """
WITH RECURSIVE
step AS (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS t FROM range(256) r(b)),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
spelt AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY doc_id, run),
named AS (SELECT row_number() OVER () AS i, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM spelt),
longest AS (SELECT coalesce(max(length(h)) // 2, 0) AS top FROM named),
after AS (
  SELECT 0 AS k, b, t FROM step
  UNION ALL SELECT k + 1, a.b, xor(a.t >> 8, s.t) FROM after a JOIN step s ON s.b = a.t & 255, longest WHERE k + 1 < top),
start AS (
  SELECT 0 AS k, 4294967295 AS z
  UNION ALL SELECT k + 1, xor(z >> 8, s.t) FROM start JOIN step s ON s.b = z & 255, longest WHERE k < top),
bytes AS (SELECT i, length(h) // 2 AS len, h, unnest(range(length(h) // 2)) AS pos FROM named),
parts AS (
  SELECT i, len, len - 1 - pos AS k,
         (instr('0123456789ABCDEF', h[2 * pos + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * pos + 2]) - 1 AS b
  FROM bytes),
crc AS (SELECT i, any_value(len) AS len, bit_xor(t) AS x FROM parts JOIN after USING (k, b) GROUP BY i),
hashed AS (SELECT run, n, xor(xor(x, z), 4294967295) AS crc FROM named JOIN crc USING (i) JOIN start ON start.k = crc.len),
results AS (
  SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (
  SELECT word, n, pos, substr(word, 1, pos) || substr(word, pos + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
best AS (
  SELECT word, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM ranked WHERE place = 1),
path AS (
  SELECT word, form AS root, 1 AS steps FROM best WHERE form IS NOT NULL
  UNION ALL SELECT path.word, best.form, steps + 1 FROM path JOIN best ON best.word = path.root WHERE best.form IS NOT NULL),
last AS (SELECT word, arg_max(root, steps) AS root FROM path GROUP BY word)
SELECT word, n, form, coalesce(root, word) AS root, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN last USING (word)"""


@_query
def op12_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is found again by its URL key, and read at the place that the index tells."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive, index = scratch_path(spark, "warc"), scratch_path(spark, "captures")
    warc.write_archive(pages, archive)
    warc.build_index(spark, archive, index)
    captures = warc.lookup(spark, index, pages.select(warc.url_key_of("url").alias("key")))
    return warc.resolve(warc.fetch(spark, archive, captures))


SQL["op12_capture_index"] = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
numbers AS (
  SELECT page_id, payload, list_transform(range(8), lambda i: list_reduce(list_transform(range(5), lambda j:
           instr('0123456789abcdef', h[5 * i + j + 1]) - 1), lambda a, b: a * 16 + b)) AS v
  FROM hashed),
spelt AS (
  SELECT page_id, payload, list_reduce(list_transform(range(32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1]), lambda a, b: a || b) AS digest
  FROM numbers),
firsts AS (SELECT payload, min(page_id) AS first FROM spelt GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM spelt JOIN firsts USING (payload)"""


@_query
def op13_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = negatives.whole_vectors(embeddings(spark, sf_dir), F.col("vec_id"), moved, F.col("embedding"), scale=256)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


SQL["op13_threshold_negatives"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
