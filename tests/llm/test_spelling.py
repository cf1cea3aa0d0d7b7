"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from emulon.llm import spelling


def brute_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if brute_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, form.get(w), root, len(near[w]), counts.get(form.get(w))))
    return out


def word_table(seed=5):
    rng = np.random.default_rng(seed)
    letters = list("abcdeéÿ×")
    words = {"".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(150)}
    words |= {"".join(rng.choice(letters, n)) for n in (31, 32, 33, 34, 60) for _ in range(2)}
    for w in list(words):
        for _ in range(2):
            i = int(rng.integers(len(w)))
            words |= {w[:i] + w[i + 1 :], w[:i] + str(rng.choice(letters)) + w[i:], w[:i] + "b" + w[i + 1 :]}
    words |= {"aaaaaa", "aaaaaaa", "aaaaa", "abaaaa", "baaaaa"}
    return {w: int(5 ** rng.integers(0, 6) + rng.integers(3)) for w in words if w}


@pytest.mark.parametrize("groups, shard_words", [(12, 50_000), (4, 20), (2, 1)])
def test_variants_equal_brute_force(spark, groups, shard_words):
    counts = word_table()
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(r["word"], r["n"], r["form"], r["root"], r["n_near"], r["form_n"])
           for r in spelling.variants(words, groups=groups, shard_words=shard_words).collect()}
    assert got == brute_variants(counts)


def test_pairs_are_found_once(spark):
    counts = word_table(6)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in spelling.links(words, groups=5, shard_words=30).collect()]
    want = {(a, b) for a in counts for b in counts if a < b and brute_edit(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_a_large_leaf_is_laid_out_in_steps(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 7)
    monkeypatch.setattr(spelling, "CHUNK", 5)
    words = sorted({"".join(p) for p in __import__("itertools").permutations("abcc")} | {"abc", "acc", "abccc"})
    spelt = [w.encode("latin-1") for w in words]
    vectors = np.array([[len(w), w.count("a"), w.count("b"), w.count("c")] for w in words])
    got = set()
    for i, j in spelling.near_pairs(spelt, vectors, spelt, vectors):
        got |= {(words[x], words[y]) for x, y in zip(i, j)}
    assert got == {(a, b) for a in words for b in words if len(b) - len(a) in (0, 1) and brute_edit(a, b)}


def brute_words(rows, every=199, least=2):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 4:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= least}


@pytest.mark.parametrize("every", [None, 3])
def test_words_are_counted_over_whole_texts(spark, small_docs, odd_docs, every, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    for docs in (small_docs, odd_docs):
        got = {r["word"]: r["n"] for r in spelling.count_words(docs, 4, 2, every).collect()}
        assert got == brute_words([(r["doc_id"], r["text"]) for r in docs.collect()], every)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert spelling.variants(spelling.count_words(no_docs)).collect() == []
    docs = odd_docs.withColumns({c: F.lit(1) for c in ("word", "n", "shard", "vec", "home", "form", "root")})
    counts = {r["word"]: r["n"] for r in spelling.count_words(docs, 4, 2).collect()}
    assert counts["aaaa"] if "aaaa" in counts else True
    got = {r["word"] for r in spelling.variants(spelling.count_words(docs, 4, 2)).collect()}
    assert got == set(counts) and counts["words"] == 3000


def test_roots_follow_forms(spark):
    chain = [Row(word=f"w{i:02d}", form=f"w{i + 1:02d}") for i in range(13)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain)).collect()}
    assert got == {f"w{i:02d}": "w13" for i in range(13)}
