"""Token files, packing and BPE against the tokenizers library itself."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emulon.llm import bpe, packing, repair, tokens
from emulon.runtime import scratch_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def library(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4") for t in texts]


@pytest.mark.parametrize("which", ["small_docs", "odd_docs", "no_docs"])
def test_token_files(spark, request, which):
    docs = request.getfixturevalue(which)
    path = scratch_path(spark, "test-tokens")
    repair.write(docs, path, BYTES, block_tokens=20_000)
    rows = sorted(repair.digest(repair.read(spark, path)).collect(), key=lambda r: r["start"])
    want = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) == len(want)
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = library(BYTES, [t for _, t in want])
    ids = [np.append(i, np.uint32(0)) for i in ids]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(
        (len(i), zlib.crc32(i.astype("<u4").tobytes())) for i in ids)
    if which == "small_docs":
        by_key = {k: i for (k, _), i in zip(want, ids)}
        assert all(r["ids_crc32"] == zlib.crc32(by_key[r["doc_id"]].astype("<u4").tobytes()) for r in rows)


def test_grammar():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5, n) for n in (0, 1, 2, 700, 3000, 0, 9)] + [np.full(1001, 7), np.tile([1, 2, 3], 400)]
    sizes = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.uint32)
    block = repair.compress(ids, sizes, 65_536, min_count=2, rounds=60)
    assert len(block.symbols) + 2 * len(block.rules) < len(ids) / 2
    again = repair.from_bytes(repair.to_bytes(block))
    expander = repair.Expander(again)
    assert (expander.ids() == ids).all()
    for doc, start, stop in ((3, 10, 50), (4, 2990, 3000), (7, 0, 1001), (8, 5, 6), (1, 0, 1), (8, 600, 1200)):
        assert (expander.span(doc, start, stop) == docs[doc][start:stop]).all()
    flat = {65_536 + i: r for i, r in enumerate(again.rules.tolist())}

    def size(s):
        return sum(map(size, flat[s])) if s in flat else 1

    assert [size(s) for s in flat] == again.expansion.tolist()


@pytest.mark.parametrize("which", ["small_docs", "odd_docs", "no_docs"])
def test_packing(spark, request, which):
    docs = request.getfixturevalue(which)
    capacity = 256
    rows = packing.packed_digest(docs, WORDS, end_id=1, capacity=capacity).collect()
    want = []
    given = docs.collect()
    for key, ids in zip([r["doc_id"] for r in given], library(WORDS, [r["text"] for r in given])):
        ids = np.append(ids, np.uint32(1)).astype("<u4")
        want += [(str(key), s, len(p := ids[s : s + capacity]), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    if which == "small_docs":
        assert sorted(sequences) == list(range(len(sequences)))
        assert sum(r["length"] for r in rows) / (capacity * len(sequences)) > 0.95


def test_places_of_a_histogram():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, 65, 5000), return_counts=True))}
    places = packing.shortest_pack_first(histogram, 64)
    filled = {}
    for length, count in histogram.items():
        for rank in range(count):
            i = np.flatnonzero((places.length == length) & (places.first_rank <= rank))[-1]
            filled.setdefault(int(places.first_sequence[i] + rank - places.first_rank[i]), []).append((int(places.offset[i]), length))
    for pieces in filled.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 64
    assert sum(n * c for n, c in histogram.items()) / (64 * len(filled)) > 0.98


@pytest.mark.parametrize("which", ["small_docs", "odd_docs", "no_docs"])
def test_rank_bpe(request, which):
    docs = request.getfixturevalue(which)
    texts = [r["text"] or "" for r in docs.collect()]
    tokenizer = Tokenizer.from_file(BYTES)
    ids = library(BYTES, texts)
    decoded = [tokenizer.decode(i.tolist(), skip_special_tokens=False) for i in ids]
    want = sorted((len(i), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, d in zip(ids, decoded))
    assert sorted(tuple(r)[1:] for r in bpe.round_trip_digest(docs, BYTES).collect()) == want
    assert sorted(r["text"] for r in bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()) == sorted(decoded)


def test_long_words_and_broken_bytes():
    encoder = bpe.RankEncoder(BYTES)
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abetho"), n)) for n in (300, 2000)] + ["a" * 999, "é" * 400]
    assert encoder.encode(words) == [i.tobytes() for i in library(BYTES, words)]
    assert [encoder.merge_long(w.encode()) for w in words] == encoder.merge_words([w.encode() for w in words])
    broken = np.array([int(encoder.of_byte[b]) for b in b"a\xe2\x82b\xff\xf0\x9f"], dtype="<u4")
    assert encoder.decode(broken.tobytes()) == Tokenizer.from_file(BYTES).decode(broken.tolist(), skip_special_tokens=False)


def test_text_is_hashed_where_it_lies(monkeypatch):
    listed, ranges = [], tokens.ranges
    monkeypatch.setattr(tokens, "ranges", lambda starts, lengths: listed.append(int(lengths.sum())) or ranges(starts, lengths))
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["\u00e9t\u00e9", "word", "12,", "a\n\tb", "x" * 1200, "\x7f", "end\u00a0"], 900)) for _ in range(20)]
    got = tokens.Encoder(BYTES, tokens.before_words).encode(texts)
    assert got == [i.tobytes() for i in library(BYTES, texts)]
    assert sum(listed) < 2 * sum(len(t.encode()) for t in texts)  # once to compare equal chunks, then the ids
