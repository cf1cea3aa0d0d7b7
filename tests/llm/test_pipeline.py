"""The pipeline: each stage on its predecessor's rows, against brute force."""

import shutil

from pyspark.sql import functions as F

import corpus_pipeline
from emulon.llm import surrogates
from tests.llm.conftest import SMALL
from tests.llm.test_similar import brute_fingerprint, brute_lines, groups


def test_stages(spark, small_docs):
    columns = small_docs.columns
    docs = small_docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        if name != "pack":
            assert docs.columns == columns and [t for _, t in docs.dtypes] == [t for _, t in small_docs.dtypes]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
    first = {r["doc_id"]: r for r in small_docs.collect()}
    spoken = {k for k, r in first.items() if r["text"] and any(map(str.isalpha, r["text"]))}
    assert {r["doc_id"] for r in kept["language"]} == spoken
    assert sum(r["lang"] == first[r["doc_id"]]["lang"] for r in kept["language"]) > 0.95 * len(spoken)
    assert sorted((r["doc_id"], r["text"]) for r in kept["line_dedup"]) == sorted(brute_lines([(r["doc_id"], r["text"]) for r in kept["language"]]))
    rows = sorted((r["doc_id"], r["text"], brute_fingerprint(r["text"])) for r in kept["line_dedup"])
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][2] ^ rows[j][2]).bit_count() <= 4]
    stay = {rows[r][0] for r in set(groups(len(rows), near))}
    assert {r["doc_id"] for r in kept["near_duplicates"]} == stay
    before = {r["doc_id"]: r["text"] for r in kept["near_duplicates"]}
    for r in kept["private_data"]:
        assert r["n_chars"] == len(r["text"])
        old, new = surrogates.find(before[r["doc_id"]]), surrogates.find(r["text"])
        if not old:
            assert r["text"] == before[r["doc_id"]]
        assert not {e for *_, e in old} & {e for *_, e in new}
    assert {r["doc_id"] for r in kept["pack"]} == stay


def test_run_equals_its_stages(spark, small_docs, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()
    shutil.copy(f"{SMALL}/documents.parquet", folder / "documents.parquet")
    rows = corpus_pipeline.run(spark, str(folder)).collect()
    per_document = {}
    for r in rows:
        per_document.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in per_document.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048


def test_odd_documents_pass_through(spark, odd_docs, no_docs):
    for given in (odd_docs.drop("rows"), no_docs):
        docs = given
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        docs.collect()


def test_without_languages_texts_with_a_letter_stay(spark, odd_docs):
    kept = corpus_pipeline.language(spark, odd_docs, SMALL).collect()
    want = [r for r in odd_docs.collect() if r["text"] and any(map(str.isalpha, r["text"]))]
    assert want and sorted(map(str, kept)) == sorted(map(str, want))


def test_helper_columns_do_not_clash(spark, odd_docs):
    names = ["__doc", "__whole", "__list", "__LINES", "__gone", "__bits", "__row", "__hash", "__fixes", "__done", "__language", "__lang", "__score"]
    docs = odd_docs.drop("rows").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SMALL)
        rows = docs.collect()
        assert rows and all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in rows for n in names)
