"""An n-gram language model in Elias-Fano tries, and scores of whole texts under it.

Tokens are the words between ASCII white space, lower-cased (A-Z), and one end per text.  Words whose share of the
training tokens is at least ``share`` are the vocabulary of the trie, so it has at most 1/share words and may be
broadcast.  All other words, known or not, are one class in the trie; inside the class a word has its own
probability, from the counts of all words.  Nothing is cut off: every token of every training text is counted.

With ``rare_pairs`` (the query's way) the class is no context and no successor: pairs of rare words are counted word by word too, in
levels of their own (``RareLevel``), and nothing is merged. A rare word's level lies in the shard of its hash.  It holds the word's count,
what came before it, and the frequent words that came after it, so every pair with a rare word is in exactly one shard.  T(h) is h's
own for frequent contexts, and for rare ones the mean over all rare contexts, so P(w | h) falls into a sum of what the shard of w and the
shard of h know.  A rare neighbour is known by 40 bits of its hash below the word's own 62.

P(w | h) mixes the counts after the word h with the unigram shares by Witten-Bell: (c(h, w) + T(h) P(w)) / (c(h) + T(h)),
T(h) being the number of different successors.  In the class of rare words, a word of count c has c / (n + t), and
all new words together have t / (n + t), n and t being the tokens and the different words of the class.

A trie shard holds the word pairs that a hash deals to it, so a frequent context is spread over all shards. Level 1: its
contexts and monotone pointers to their successors; unigram probabilities and back-off weights, by number, are
the same for all shards and travel with the vocabulary. Level 2: the successors. Identifiers are
relative to their context: a successor is stored as its number plus a base, the sum of what the contexts before
it need, so the whole level is one monotone sequence, and a word is found after a context by searching the
successor of (base + word) in it.  Both are Elias-Fano coded; probabilities are quantised to 16 bits.  The shards are rows
of a Parquet table of binary levels, which a task searches as they are, without decoding them (``Trie.open`` takes any buffer, a
memory-mapped file too): a count of the marks before every 64 bits finds the bucket of a value, its low bits the place.

Scoring sends, for each block of documents and shard, which words and pairs occur how often in which document, as
packed arrays; the shard answers with sums of the documents that it was asked about, so answers are as many as
the questions, whatever the number of shards.  So no text and no model is moved whole.  The number of shards
follows the numbers of words and of different words; shards serve blocks in lanes, so no group holds all blocks.

Nulls and oddities: a null or empty text is its end alone; rows are scored one by one, whatever their keys; with
nothing to learn from, the base score is 0 and every word is new; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulon.llm.common import column, ranges, whole
from emulon.runtime import cut_lineage, opened, share

BLOCK_BYTES = 12_000_000  # text of a block
END, RARE = 0, 1  # numbers of the end and of the class of rare words; END is also the context of the first word
QUANTUM = 1 / 4096  # step of a quantised log10


class EliasFano:
    """A monotone sequence of non-negative integers: low bits packed, high bits as marks after unary gaps, and a directory of the
    marks before each word of 64 bits.  Lookups read the buffer in place."""

    def __init__(self, buffer, at: int = 0):
        n, low_bits, words, low_bytes = np.frombuffer(buffer, "<u8", 4, at).astype(np.int64).tolist()
        self.n, self.low_bits, at = n, low_bits, at + 32
        self.marks = np.frombuffer(buffer, np.uint8, 8 * words, at).reshape(words, 8)
        self.ones = np.frombuffer(buffer, "<u4", words, at + 8 * words)
        self.low = np.frombuffer(buffer, np.uint8, low_bytes, at + 12 * words)
        self.end = at + 12 * words + low_bytes  # where the next part of the buffer begins
        self.top = 64 * words - n  # noughts, more than the largest high part

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        places = (values >> low_bits).astype(np.int64) + np.arange(n)
        words = (int(places[-1]) + 2 + 63) // 64 if n else 1  # a nought follows the last mark
        marks = np.zeros(64 * words, dtype=np.uint8)
        marks[places] = 1
        ones = np.cumsum(marks.reshape(words, 64).sum(axis=1, dtype=np.int64))
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = [np.packbits((values[i : i + 65536, None].astype(np.uint64) >> shifts & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
               for i in range(0, n if low_bits else 0, 65536)]
        low = b"".join(low) + bytes(8)
        return b"".join([np.array([n, low_bits, words, len(low)], dtype="<u8").tobytes(), np.packbits(marks, bitorder="little").tobytes(),
                         np.append(0, ones[:-1]).astype("<u4").tobytes(), low])

    @staticmethod
    def decode(buffer, at: int = 0) -> tuple[np.ndarray, int]:
        """All values, and where the next part of the buffer begins."""
        own = EliasFano(buffer, at)
        return own.get(np.arange(own.n)), own.end

    def values(self) -> np.ndarray:
        """All values, in one pass."""
        high = np.flatnonzero(np.unpackbits(self.marks.reshape(-1), bitorder="little")) - np.arange(self.n)
        low = [self._low(np.arange(at, min(at + 65536, self.n))) for at in range(0, self.n, 65536)]
        return high << self.low_bits | (np.concatenate(low) if low else np.zeros(0, np.int64))

    def _select(self, before: np.ndarray, i: np.ndarray, flip: int) -> np.ndarray:
        """The place of the i-th mark (with ``flip`` 255: nought) if ``before`` counts those before each word."""
        out = np.empty(len(i), dtype=np.int64)
        for at in range(0, len(i), 65536):
            some = i[at : at + 65536]
            word = np.searchsorted(before, some, "right") - 1
            bits = np.unpackbits(self.marks[word] ^ np.uint8(flip), axis=1, bitorder="little")
            inside = bits.cumsum(axis=1, dtype=np.uint8) > (some - before[word])[:, None]
            out[at : at + 65536] = 64 * word + inside.argmax(axis=1)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        bit = i * self.low_bits
        raw = self.low[(bit >> 3)[:, None] + np.arange(8)].view("<u8")[:, 0]
        # a value of at most 56 bits begins within the first byte of the eight, so it ends within the eighth
        return (raw >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return self._select(self.ones, i, 0) - i << self.low_bits | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value; -1 if it does not occur."""
        high, low = values >> self.low_bits, values & ((1 << self.low_bits) - 1)
        out = np.full(len(values), -1, dtype=np.int64)
        inside = np.flatnonzero((high >= 0) & (high < self.top))
        high, low = high[inside], low[inside]
        noughts = 64 * np.arange(len(self.ones)) - self.ones
        end = self._select(noughts, high, 255) - high
        start = np.zeros(len(high), dtype=np.int64)
        later = high > 0
        start[later] = self._select(noughts, high[later] - 1, 255) - (high[later] - 1)
        right = end.copy()
        while len(live := np.flatnonzero(start < right)):
            middle = start[live] + right[live] >> 1
            less = self._low(middle) < low[live]
            start[live[less]] = middle[less] + 1
            right[live[~less]] = middle[~less]
        here = np.flatnonzero(start < end)
        here = here[self._low(start[here]) == low[here]]
        out[inside[here]] = start[here]
        return out


class Trie:
    """One shard: contexts, pointers, successors and the successors' quantised probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, probabilities: np.ndarray):
        self.contexts, self.pointers, self.successors, self.probabilities = contexts, pointers, successors, probabilities

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, count: np.ndarray, model: Model) -> bytes:
        """From pairs sorted by context and word; totals and different successors of the contexts are the model's."""
        first = np.flatnonzero(np.diff(context, prepend=-1))
        contexts, pointers = context[first], np.append(first, len(context)).astype(np.int64)
        sizes = np.diff(pointers)
        total, different = model.totals[contexts], model.successors[contexts]
        mixed = count + np.repeat(different, sizes) * model.unigram[word]
        probability = np.log10(mixed / np.repeat(total + different, sizes))
        needs = word[pointers[1:] - 1] + 1
        base = np.cumsum(needs) - needs
        levels = [EliasFano.encode(v) for v in (contexts, pointers, np.repeat(base, sizes) + word)]
        return b"".join(levels) + np.minimum(65535, np.rint(-probability / QUANTUM)).astype("<u2").tobytes()

    @classmethod
    def open(cls, buffer) -> Trie:
        contexts = EliasFano(buffer)
        pointers = EliasFano(buffer, contexts.end)
        successors = EliasFano(buffer, pointers.end)
        return cls(contexts, pointers, successors, np.frombuffer(buffer, "<u2", successors.n, successors.end))

    def log10(self, context: np.ndarray, word: np.ndarray, model: Model) -> np.ndarray:
        """log10 P(word | context) of many pairs; a pair never seen has the back-off weight times the unigram."""
        different = model.successors[context]
        weight = np.where(different > 0, different / np.maximum(1, model.totals[context] + different), 1.0)
        out = np.log10(weight * model.unigram[word])
        names, which = np.unique(context, return_inverse=True)
        c = self.contexts.find(names)
        held = np.flatnonzero(c >= 0)
        base, end = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        first = self.pointers.get(c[held])
        end[held] = self.pointers.get(c[held] + 1)
        # the largest value of a context is its base and its last word, and the next base lies one beyond
        after = np.flatnonzero(first > 0)
        base[held[after]] = self.successors.get(first[after] - 1) + 1
        asked = np.flatnonzero(c[which] >= 0)
        s = self.successors.find(base[which[asked]] + word[asked])
        seen = (s >= 0) & (s < end[which[asked]])
        out[asked[seen]] = -QUANTUM * self.probabilities[s[seen]]
        return out


class RareLevel(NamedTuple):
    """The rare words of one shard, by rank, and their neighbours; keys are ascending."""

    words: np.ndarray  # upper 62 bits of the hashes
    count: np.ndarray
    before: tuple[np.ndarray, np.ndarray]  # rank x frequent word before it, times
    rare_before: tuple[np.ndarray, np.ndarray]  # rank and 40 bits of the rare word before it, times
    after: tuple[np.ndarray, np.ndarray]  # rank x frequent word after it, times

    @staticmethod
    def build(postings: list[bytes], size: int) -> bytes:
        """From the tokens of all blocks; ``size``: numbers of the vocabulary."""
        hashes, held, _, prev, prev_hash, after = zip(*map(_unpack_tokens, postings))
        words, rank = np.unique(np.concatenate([np.repeat(h >> np.uint64(2), n) for h, n in zip(hashes, held)]).astype(np.int64), return_inverse=True)
        prev, prev_hash, after = map(np.concatenate, (prev, prev_hash, after))
        rare = prev == RARE
        levels = [np.unique(keys, return_counts=True) for keys in (
            rank[~rare] * size + prev[~rare], rank[rare] << 40 | prev_hash, rank[after != RARE] * size + after[after != RARE])]
        coded = [EliasFano.encode(v) for v in (words, *(keys for keys, _ in levels))]
        return b"".join(coded) + _pack(np.bincount(rank, minlength=len(words)), *(n for _, n in levels))

    @classmethod
    def open(cls, raw: bytes | None) -> RareLevel:
        if raw is None:
            nothing = np.zeros(0, np.int64)
            return cls(nothing, nothing, *3 * [(nothing, nothing)])
        at, keys = 0, []
        for _ in range(4):
            coded = EliasFano(raw, at)
            keys.append(coded.values())
            at = coded.end
        times = _unpack(raw[at:])
        return cls(keys[0], times[0], *zip(keys[1:], times[1:]))

    def successors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts, and how many different pairs of theirs the level holds; rare contexts together."""
        context, n = np.unique(self.before[0] % max(1, size), return_counts=True)
        return np.append(context, RARE), np.append(n, len(self.rare_before[0]) + len(self.after[0]))

    def sums(self, raw: bytes, model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each token of a block: document, known words, sum for the base score, log10 probability; the frequent words after rare
        ones are counted with these."""
        hashes, held, docs, prev, prev_hash, after = _unpack_tokens(raw)
        size, tied = len(model.totals), model.tied
        count, rank = _times(self.words, self.count, (hashes >> np.uint64(2)).astype(np.int64), ranks=True)
        unigram = model.unigram[RARE] * np.where(count > 0, count, model.rare_types) / (model.rare_tokens + model.rare_types)
        rank, count, unigram = (np.repeat(a, held) for a in (rank, count, unigram))
        rare, follows = prev == RARE, after != RARE
        different = np.where(rare, tied, np.maximum(1, model.successors[prev]))
        pair = np.zeros(len(docs))
        pair[~rare] = _times(*self.before, rank[~rare] * size + prev[~rare])
        pair[rare] = _times(*self.rare_before, np.where(rank[rare] >= 0, rank[rare] << 40 | prev_hash, -1))
        next_pair = _times(*self.after, rank * size + after)
        log = np.log10(pair + different * unigram) - np.log10(count + tied)
        log -= np.where(rare, 0.0, np.log10(model.totals[prev] + different))
        log += np.where(follows, np.log10(next_pair + tied * model.unigram[after]), 0.0)
        known = (count > 0) + (follows & (model.totals[after] > 0)).astype(float)
        return docs, [known, np.log10(count + 0.5) + np.where(follows, model.log_counts[after], 0.0), log]


def _times(keys: np.ndarray, times: np.ndarray, asked: np.ndarray, ranks: bool = False):
    """How often each key asked for was counted; with ``ranks`` also its place, or -1."""
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    there = keys[at] == asked if len(keys) else np.zeros(len(asked), dtype=bool)
    found = np.zeros(len(asked), dtype=np.int64)
    found[there] = times[at[there]]
    return (found, np.where(there, at, -1)) if ranks else found


class Model(NamedTuple):
    """What every task needs to know; its size is bounded by 1/share words."""

    vocabulary: np.ndarray  # hashes of the frequent words, sorted; word i has number i + 2
    unigram: np.ndarray  # probability of end, rare and each frequent word, by number
    totals: np.ndarray  # training tokens after each context, by number
    successors: np.ndarray  # different tokens among them
    log_counts: np.ndarray  # log10(count + 1/2) by number; nought for rare
    tokens: int  # N
    types: int  # V
    rare_tokens: int
    rare_types: int
    shards: int
    rare_pairs: bool = False  # rare words are contexts and successors of their own

    @property
    def tied(self) -> float:
        """Different successors of a rare context, on the average."""
        return max(1.0, self.successors[RARE] / self.rare_types)


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES):
    """Blocks of about ``size`` characters of whole documents: keys, words of each document, number of each word,
    hash by number."""
    rows, texts, held = [], [], 0

    def block():
        known: dict[bytes, int] = {}
        number = known.setdefault
        ids, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            words = _words(text)
            sizes[i] = len(words)
            ids.append(np.array([number(w, len(known)) for w in words], dtype=np.int32))
        return rows, sizes, np.concatenate(ids) if ids else np.zeros(0, np.int32), _hashes(list(known))

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            keys = column(piece, "doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * piece.num_rows
            for row, text in zip(keys, column(piece, "text").to_pylist()):
                rows.append(row)
                texts.append(text)
                held += len(text)
                if held >= size:
                    yield block()
                    rows, texts, held = [], [], 0
    if rows:
        yield block()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n`` of every word of the texts; one word's counts are added up before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, hashes in _blocks(batches):
            n = np.bincount(ids, minlength=len(hashes))
            for at in range(0, len(n), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at : at + 20_000].view(np.int64)), pa.array(n[at : at + 20_000])],
                                                 names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each in the smallest unsigned type that holds it."""
    out = [np.array([len(arrays)], dtype="<u8").tobytes()]
    for a in arrays:
        size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(a) or int(a.max()) < 1 << (8 * s))
        out += [np.array([len(a), size], dtype="<u8").tobytes(), a.astype(f"<u{size}").tobytes()]
    return b"".join(out)


def _unpack(raw: bytes) -> list[np.ndarray]:
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, "<u8", 1)[0])):
        n, size = np.frombuffer(raw, "<u8", 2, at).tolist()
        a = np.frombuffer(raw, f"<u{size}", n, at + 16)
        out.append(a if size == 8 else a.astype(np.int64))
        at += 16 + n * size
    return out


def _pack_sums(touched: np.ndarray, sums: np.ndarray) -> bytes:
    """Documents of a block, ascending, and their three sums."""
    return np.array([len(touched)], dtype="<u4").tobytes() + touched.astype("<u4").tobytes() + sums.astype("<f8").tobytes()


def _unpack_sums(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4), np.frombuffer(raw, "<f8", 3 * n, 4 + 4 * n).reshape(3, n)


def _numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(hashes), RARE)
    i = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[i] == hashes, i + 2, RARE)


def _pairs(sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, context and word of each token, the ends included."""
    docs = np.repeat(np.arange(len(sizes)), sizes + 1)
    word = np.zeros(len(docs), dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(docs), dtype=bool)
    inside[ends] = False
    word[inside] = numbers
    context = np.concatenate([np.zeros(1, np.int64), word[:-1]])  # after an end (0) a text begins: context END
    return docs, context, word


def _pair_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that occur, each with its places in ascending order."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return ((s, order[cuts[s] : cuts[s + 1]]) for s in np.flatnonzero(np.diff(cuts)).tolist())


def _rare_tokens(sizes: np.ndarray, ids: np.ndarray, hashes: np.ndarray, numbers: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """The rare tokens of a block, packed by the shard of their word: the words with their times; document, word before, word after of each."""
    docs, context, word = _pairs(sizes, numbers[ids])
    local = np.zeros(len(docs), dtype=np.int64)
    local[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    at = np.flatnonzero(word == RARE)
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    place = np.empty(len(hashes), dtype=np.int64)
    by_place = np.lexsort((hashes, shard))
    place[by_place] = np.arange(len(hashes))
    at = at[np.argsort(place[local[at]], kind="stable")]
    cuts = np.searchsorted(shard[local[at]], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        mine = at[cuts[s] : cuts[s + 1]]
        names, held = np.unique(place[local[mine]], return_counts=True)
        prev = context[mine]
        prev_hash = hashes[local[mine[prev == RARE] - 1]] >> np.uint64(24)
        yield s, _pack(hashes[by_place[names]], held, docs[mine], prev & 0xFFFF, prev >> 16, prev_hash & np.uint64(0xFFFFFFFF),
                       prev_hash >> np.uint64(32), word[mine + 1] & 0xFFFF, word[mine + 1] >> 16)


def _unpack_tokens(raw: bytes) -> tuple[np.ndarray, ...]:
    hashes, held, docs, *halves = _unpack(raw)
    prev, prev_hash, after = (low.astype(np.int64) | high.astype(np.int64) << bits for low, high, bits in zip(halves[::2], halves[1::2], (16, 32, 16)))
    return hashes.astype(np.uint64), held, docs, prev, prev_hash, after


def train(texts: DataFrame, share_of: float = 1e-5, words_per_shard: int = 100_000,
          tokens_per_shard: int = 4_000_000, rare_pairs: bool = False) -> tuple[Model, DataFrame, DataFrame]:
    """The model, its trie shards (``shard, payload``, written) and the counts of rare words (``word, n``); with ``rare_pairs`` all pairs
    of rare words are learned too, and levels (``shard, level``) come instead of the counts.

    ``texts`` has a column text.  Shards are so many that each has ``words_per_shard`` different words and ``tokens_per_shard``
    training tokens at most, 8 at least."""
    spark = texts.sparkSession
    texts = texts.select(whole(F.col("text")).alias("text"))
    words = cut_lineage(word_counts(texts))
    n_docs = texts.count()
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    limit = max(1.0, share_of * n)
    frequent = words.where(F.col("n") >= limit).toPandas().sort_values("word")  # at most 1 / share_of rows
    vocabulary, c = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    order = np.argsort(vocabulary)
    vocabulary, c = vocabulary[order], c[order]
    rare_tokens, rare_types = int(n - c.sum()), max(1, int(v - len(c)))
    weights = np.concatenate([[n_docs + 0.5, rare_tokens + rare_types], c])
    totals = np.concatenate([[n_docs, rare_tokens], c]).astype(np.int64)
    model = Model(vocabulary, weights / weights.sum(), totals, np.zeros(len(totals), np.int64), np.log10(totals + 0.5),
                  int(n + n_docs), int(v + (n_docs > 0)), rare_tokens, rare_types,
                  max(8, -(-v // words_per_shard), -(-n // tokens_per_shard)), rare_pairs)
    shared = share(spark, model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = opened(shared)
        for _, sizes, ids, hashes in _blocks(batches):
            numbers = _numbers(hashes, own.vocabulary)
            _, context, word = _pairs(sizes, numbers[ids])
            if own.rare_pairs:
                both = (context != RARE) & (word != RARE)
                context, word = context[both], word[both]
                for s, tokens in _rare_tokens(sizes, ids, hashes, numbers, own.shards):
                    yield _row(PAIR_TYPES, s, None, tokens)
            keys, n = np.unique(context << 32 | word, return_counts=True)
            for s, mine in _by_shard(_pair_shard(keys, own.shards), own.shards):
                yield _row(PAIR_TYPES, s, _pack_pairs(keys[mine], n[mine]), None)

    def add(group: pa.Table) -> pa.Table:
        """The pairs of one shard, each once, and the level of its rare words."""
        keys, n = zip((np.zeros(0, np.int64),) * 2, *(_unpack_pairs(raw) for raw in group.column("pairs").drop_null().to_pylist()))
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, np.concatenate(n)).astype(np.int64)
        tokens = group.column("level").drop_null().to_pylist()
        level = RareLevel.build(tokens, size) if tokens else None
        return pa.Table.from_batches([_row(PAIR_TYPES, group.column("shard")[0].as_py(), _pack_pairs(keys, n), level)])

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, level in zip(column(batch, "pairs").to_pylist(), column(batch, "level").to_pylist()):
                context, n = np.unique(_unpack_pairs(raw)[0] >> 32, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(n)], names=["context", "n"])
                if level is not None:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, RareLevel.open(level).successors(size))), names=["context", "n"])

    size = len(totals)
    pairs = cut_lineage(texts.mapInArrow(count, PAIRS).groupBy("shard").applyInArrow(add, PAIRS))
    found = pairs.mapInArrow(different, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).toPandas()
    model.successors[found["context"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)  # one row a context
    shared_again = share(spark, model)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = opened(shared_again)
        for batch in batches:
            for shard, raw in zip(column(batch, "shard").to_pylist(), column(batch, "pairs").to_pylist()):
                keys, n = _unpack_pairs(raw)
                payload = Trie.build(keys >> 32, keys & 0xFFFFFFFF, n, own)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([payload], pa.binary())], names=["shard", "payload"])

    rare = pairs.where("level is not null").select("shard", "level") if rare_pairs else words.where(F.col("n") < limit)
    return model, cut_lineage(pairs.select("shard", "pairs").mapInArrow(build, "shard int, payload binary")), rare


PAIRS = "shard int, pairs binary, level binary"
PAIR_TYPES = {"shard": pa.int32(), "pairs": pa.binary(), "level": pa.binary()}
SUMS = "task int, block int, doc_ids array<long>, sizes array<long>, sums binary"


def _row(types: dict[str, pa.DataType], *cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types.values())], names=list(types))


def _pack_pairs(keys: np.ndarray, n: np.ndarray) -> bytes:
    context, sizes = np.unique(keys >> 32, return_counts=True)
    return _pack(context, sizes, keys & 0xFFFFFFFF, n)


def _unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    context, sizes, word, n = _unpack(raw)
    return np.repeat(context, sizes) << 32 | word, n


def _postings(what: np.ndarray, docs_of: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different values, how many documents each is in, and of these document and times."""
    names, which = np.unique(what, return_inverse=True)
    both, times = np.unique(which * np.int64(n_docs) + docs_of, return_counts=True)
    return names, np.bincount(both // n_docs, minlength=len(names)), both % n_docs, times


def score(docs: DataFrame, model: Model, tries: DataFrame, rare: DataFrame, tasks_per_lane: int = 1024) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared = share(spark, model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = opened(shared)
        task = TaskContext.get().partitionId()
        for number, (doc_ids, sizes, ids, hashes) in enumerate(_blocks(batches)):
            numbers = _numbers(hashes, own.vocabulary)
            docs_of, context, word = _pairs(sizes, numbers[ids])
            n = len(sizes)
            own_words = dict(_rare_tokens(sizes, ids, hashes, numbers, own.shards)) if own.rare_pairs else {}
            both = (context != RARE) & (word != RARE) if own.rare_pairs else slice(None)
            pairs = _postings((context << 32 | word)[both], docs_of[both], n)
            is_rare = (numbers == RARE)[ids] & (not own.rare_pairs)
            words = _postings(ids[is_rare], np.repeat(np.arange(n), sizes)[is_rare], n)
            words = (hashes[words[0]], *words[1:])
            of_pair = dict(_by_shard(_pair_shard(pairs[0], own.shards), own.shards))
            of_word = dict(_by_shard((words[0] % np.uint64(own.shards)).astype(np.int64), own.shards))
            nothing = np.zeros(0, np.int64)
            for i, s in enumerate(sorted(of_pair.keys() | of_word.keys() | own_words.keys())):
                parts = []
                for (names, held, docs_in, times), mine in ((words, of_word.get(s, nothing)), (pairs, of_pair.get(s, nothing))):
                    at = ranges((np.cumsum(held) - held)[mine], held[mine])
                    parts.append(_pack(names[mine], held[mine], docs_in[at], times[at]))
                if own.rare_pairs:
                    parts[0] = own_words.get(s)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s], pa.int32()), pa.array([task // tasks_per_lane], pa.int32()), pa.array([task], pa.int32()),
                    pa.array([number], pa.int32()), pa.array([doc_ids if i == 0 else None], pa.list_(pa.int64())),
                    pa.array([sizes + 1 if i == 0 else None], pa.list_(pa.int64())), pa.array([parts[0]], pa.binary()),
                    pa.array([parts[1]], pa.binary())], names=["shard", "lane", "task", "block", "doc_ids", "sizes", "words", "pairs"])

    def pack_rare(group: pa.Table) -> pa.Table:
        words, n = group.column("word").to_numpy().view(np.uint64), group.column("n").to_numpy()
        order = np.argsort(words)
        return pa.table({"shard": group.column("shard").slice(0, 1), "counts": pa.array([_pack(words[order], n[order])], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        own: Model = opened(shared)
        row = {c: next(iter(known.column(c).drop_null().to_pylist()), None) for c in ("payload", "counts", "level")}
        empty = np.zeros(0, np.int64)
        trie = Trie.open(row["payload"] or 3 * EliasFano.encode(empty))
        level = RareLevel.open(row["level"])
        words, counts = _unpack(row["counts"]) if row["counts"] else (np.zeros(0, np.uint64), empty)
        words = words.astype(np.uint64)
        class_total = own.rare_tokens + own.rare_types
        out = []
        for i in range(asked.num_rows):
            raw = asked.column("words")[i].as_py()
            rare_docs, of_rare = level.sums(raw, own) if own.rare_pairs and raw else (empty, 3 * [np.zeros(0)])
            hashes, held, word_docs, word_times = 4 * [empty] if own.rare_pairs else _unpack(raw)
            c = np.zeros(len(hashes), dtype=np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, hashes.astype(np.uint64)), len(words) - 1)
                c = np.where(words[at] == hashes.astype(np.uint64), counts[at], 0)
            in_class = np.log10(np.where(c > 0, c, own.rare_types) / class_total)
            keys, spread, pair_docs, pair_times = _unpack(asked.column("pairs")[i].as_py())
            keys = keys.astype(np.int64)
            context, word = keys >> 32, keys & 0xFFFFFFFF
            frequent = (word != RARE) & (own.totals[word] > 0)
            touched = np.union1d(np.union1d(word_docs, pair_docs), rare_docs)
            n = len(touched)
            of_word, of_pair = np.searchsorted(touched, word_docs), np.searchsorted(touched, pair_docs)

            def total(of_words: np.ndarray, of_pairs: np.ndarray) -> np.ndarray:
                return (np.bincount(of_word, np.repeat(of_words, held) * word_times, n)
                        + np.bincount(of_pair, np.repeat(of_pairs, spread) * pair_times, n))

            sums = [total(c > 0, frequent), total(np.log10(c + 0.5), np.where(word != RARE, own.log_counts[word], 0.0)),
                    total(in_class, trie.log10(context, word, own))]
            sums = [a + np.bincount(np.searchsorted(touched, rare_docs), b, n) for a, b in zip(sums, of_rare)]
            out.append(_pack_sums(touched, np.array(sums)))
        return asked.select(["task", "block", "doc_ids", "sizes"]).append_column("sums", pa.array(out, pa.binary()))

    def finish(group: pa.Table) -> pa.Table:
        """The documents of one block with their sums over all shards."""
        first = next(i for i in range(group.num_rows) if group.column("sizes")[i].is_valid)
        sizes = np.array(group.column("sizes")[first].as_py())
        sums = np.zeros((3, len(sizes)))
        for raw in group.sort_by("sums").column("sums").to_pylist():
            touched, part = _unpack_sums(raw)
            sums[:, touched] += part
        base = sums[1] - sizes * math.log10(model.tokens + 0.5 * (model.types + 1))
        return pa.table({"doc_id": pa.array(group.column("doc_ids")[first].as_py(), pa.int64()), "n_tokens": sizes,
                         "n_known": sums[0].astype(np.int64), "base_score": base, "score": sums[2]})

    unsigned = F.expr(f"cast(pmod(cast(word as decimal(20,0)) + if(word < 0, 18446744073709551616, 0), {model.shards}) as int)")
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(
        ask, "shard int, lane int, task int, block int, doc_ids array<long>, sizes array<long>, words binary, pairs binary")
    lanes = -(-docs.rdd.getNumPartitions() // tasks_per_lane)
    if model.rare_pairs:
        known = tries.unionByName(rare, allowMissingColumns=True).withColumn("counts", F.lit(None).cast("binary"))
    else:
        counts = rare.withColumn("shard", unsigned).groupBy("shard").applyInArrow(pack_rare, "shard int, counts binary")
        known = tries.join(counts, "shard", "full").withColumn("level", F.lit(None).cast("binary"))
    known = known.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(max(1, lanes) - 1))).alias("lane"), "payload", "counts", "level")
    answers = asked.groupBy("shard", "lane").cogroup(known.groupBy("shard", "lane")).applyInArrow(_if_asked(answer), SUMS)
    return answers.groupBy("task", "block").applyInArrow(
        finish, "doc_id long, n_tokens long, n_known long, base_score double, score double").withColumn(
        "train_tokens", F.lit(model.tokens).cast("long")).select(
        "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _if_asked(answer):
    """Shards that nobody asked give nothing."""
    types = {"task": pa.int32(), "block": pa.int32(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "sums": pa.binary()}

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        return answer(asked, known) if asked.num_rows else pa.table({n: pa.array([], t) for n, t in types.items()})

    return run
