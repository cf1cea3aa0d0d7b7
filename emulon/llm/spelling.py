"""Spelling variants of words by a frequency-vector trie.

The words of a corpus are counted, and each word that is frequent enough is linked with the words one edit away: one letter inserted, deleted
or replaced.  Its form is the near word of largest count, where that count is at least ``ratio`` times its own; its root is where
forms lead.

A word's vector holds how many letters it has of each letter group; groups are filled so that all hold about as many letters of the
corpus.  A trie arranges words by length and then by the successive counts.  An edit adds at most one to one count (a
surplus) and takes at most one from another (a deficit), so a depth-first search goes down the equal child, and, while its budget
of one surplus and one deficit lasts, the children one above and one below.  Words in the leaves reached are verified letter by letter.

The top levels (length and the first ``depth`` counts) deal the trie into shards; a word visits the shards that its budget reaches,
towards larger keys only, so each pair is found once.  ``depth`` is the least for which no shard holds more than
``shard_words`` words, so the work of a task does not grow with the vocabulary.

Nulls and oddities: a null or empty text has no words; a null key counts as an empty prefix of the sampling hash; repeated rows count
each time; words of any length are compared whole; ties between near words of equal count go to the smallest in code-point order; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulon.llm.common import column, ranges, texts
from emulon.runtime import cut_lineage

RUN = r"[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
GROUPS = 12
HELD = 200_000  # different words that a task counts before it passes them on
WIDE = 32  # longer words are compared one by one
CHUNK = 1 << 16  # places of one step of the search
PAIRS = 1 << 19  # pairs of words laid out at once, but for those of the last place


# ----------------------------------------------------------------------------- counting


def drop_letter(word: str, prefix_crc: int, every: int) -> str:
    """The word, less the letter that its hash names if ``every`` divides the hash."""
    h = zlib.crc32(word.encode(), prefix_crc)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, least_letters: int = 6, least_count: int = 5, every: int | None = None,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: runs of letters, lower-cased A-Z.  With ``every``, one in so many spellings loses a letter first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, content in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                own = Counter(find(content.translate(LOWER)))
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    if len(word) >= least_letters:
                        spelt = drop_letter(word, prefix, every) if every else word
                        if len(spelt) >= least_letters:
                            total[spelt] += n
                if len(total) >= HELD:
                    yield flush()
        if total:
            yield flush()

    counted = texts(docs, key, text).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ----------------------------------------------------------------------------- vectors and shards


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group: from the most frequent down, each goes to the group with the least so far.  At most 90 letters exist."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    held = [[0, ""] for _ in range(groups)]
    for letter, n in sorted(((r[0], r[1]) for r in letters), key=lambda x: (-x[1], x[0])):
        least = min(held, key=lambda g: g[0])
        least[0] += n
        least[1] += letter
    return [g[1] for g in held]


def vector(word: Column, groups: list[str]) -> Column:
    """Length and the counts of the groups, as an array."""
    length = F.length(word)
    counts = [length - F.length(F.translate(word, g, "")) if g else F.lit(0) for g in groups]
    return F.array(*[c.cast("int") for c in [length, *counts]])


def _shard(vec: Column, depth: int) -> Column:
    return F.concat_ws(",", F.transform(F.slice(vec, 1, depth + 1), lambda c: c.cast("string")))


def shard_depth(words: DataFrame, groups: int, shard_words: int) -> int:
    """The least number of counts after the length for which no shard holds more words; all of them if there is none."""
    for depth in range(1, groups):
        largest = words.groupBy(_shard(F.col("vec"), depth).alias("shard")).count().agg(F.max("count")).first()[0] or 0
        if largest <= shard_words:
            return depth
    return groups


def _visits(depth: int) -> list[list[int]]:
    """Changes of (length, first counts) that lead to the shards where later partners of a word are: one letter more, or as many
    letters with the first change upwards."""
    def change(length: int, up: int | None, down: int | None) -> list[int]:
        out = [0] * (depth + 1)
        out[0] = length
        if up is not None:
            out[up + 1] += 1
        if down is not None:
            out[down + 1] -= 1
        return out

    places = [None, *range(depth)]
    longer = [change(1, up, None) for up in places]
    equal = [change(0, up, down) for up in places for down in places if up != down or up is None]
    return longer + [c for c in equal if c >= [0] * (depth + 1)]


# ----------------------------------------------------------------------------- the trie


class Trie:
    """Words arranged by length and successive counts: per level, the sorted keys (parent, count) of its nodes."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.lexsort(vectors.T[::-1])
        rows = vectors[self.order].astype(np.int64)
        self.base = int(rows.max(initial=0)) + 3  # counts one above and one below have keys of their own
        self.levels: list[np.ndarray] = []
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(rows.shape[1]):
            keys, node = np.unique(node * self.base + rows[:, level] + 1, return_inverse=True)
            self.levels.append(keys)
        self.starts = np.searchsorted(node, np.arange(len(self.levels[-1]) + 1))  # words of a leaf lie together

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is the child, and its number."""
        keys = self.levels[level]
        wanted = node * self.base + np.minimum(count, self.base - 2) + 1  # what is too large leads to no key
        at = np.searchsorted(keys, wanted)
        found = (count >= 0) & (count < self.base - 2) & (at < len(keys))
        found[found] = keys[at[found]] == wanted[found]
        return found, at

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) pairs of words with as many letters, or one more.  Depth first, in chunks of places."""
        n = len(queries)
        queries = queries.astype(np.int64)
        last = len(self.levels) - 1
        stack: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for more in (0, 1):  # as many letters: one surplus, one deficit; one more: a surplus alone, to be spent
            for at in range(0, n, CHUNK):
                q = np.arange(at, min(n, at + CHUNK))
                found, node = self.child(0, np.zeros(len(q), dtype=np.int64), queries[q, 0] + more)
                q, node = q[found], node[found]
                stack.append((1, q, node, np.ones(len(q), dtype=bool), np.full(len(q), not more)))
        while stack:
            level, q, node, up, down = stack.pop()
            if not len(q):
                continue
            if level > last:
                yield q, node
                continue
            parts = []
            for step, may in ((0, None), (1, up), (-1, down)):
                s = slice(None) if may is None else may
                found, child = self.child(level, node[s], queries[q[s], level] + step)
                parts.append((q[s][found], child[found], (up[s] & (step != 1))[found], (down[s] & (step != -1))[found]))
            joined = [np.concatenate(p) for p in zip(*parts)]
            for at in range(0, len(joined[0]), CHUNK):
                stack.append((level + 1, *(j[at : at + CHUNK] for j in joined)))


def _padded(words: list[bytes]) -> np.ndarray:
    return np.array(words, dtype=f"S{WIDE}").view(np.uint8).reshape(len(words), WIDE)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    front = next((i for i in range(n) if a[i] != b[i]), n)
    return a[front + (len(a) >= len(b)) :] == b[front + (len(b) >= len(a)) :]


def _one_edit_rows(short: np.ndarray, long: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Row by row, for words of at most ``WIDE`` letters; ``same``: of as many letters, else the second has one more."""
    replaced = (short != long).sum(axis=1) == 1
    front = np.cumprod(short[:, :-1] == long[:, :-1], axis=1, dtype=np.uint8).sum(axis=1)
    back = np.cumprod((short[:, :-1] == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1)
    return np.where(same, replaced, front.astype(int) + back >= WIDE - 1)


def near_pairs(home: list[bytes], home_vectors: np.ndarray, visitors: list[bytes], visitor_vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, home) places of words one edit apart, the home word having as many letters or one more."""
    trie = Trie(home_vectors)
    home = [home[i] for i in trie.order]
    a, b = _padded([w[:WIDE] for w in visitors]), _padded([w[:WIDE] for w in home])
    len_a, len_b = np.array([len(w) for w in visitors]), np.array([len(w) for w in home])
    sizes = np.diff(trie.starts)
    for query, leaf in trie.search(visitor_vectors):
        ends = np.cumsum(sizes[leaf])
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], PAIRS), "left") if len(ends) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(query)]):  # leaves may be large: their words are laid out for some places at a time
            i = np.repeat(query[lo:hi], sizes[leaf[lo:hi]])
            j = ranges(trie.starts[leaf[lo:hi]], sizes[leaf[lo:hi]])
            short = (len_a[i] <= WIDE) & (len_b[j] <= WIDE)
            good = np.zeros(len(i), dtype=bool)
            rows = np.flatnonzero(short)
            for at in range(0, len(rows), PAIRS):
                r = rows[at : at + PAIRS]
                good[r] = _one_edit_rows(a[i[r]], b[j[r]], len_a[i[r]] == len_b[j[r]])
            for r in np.flatnonzero(~short):
                good[r] = one_edit(visitors[i[r]], home[j[r]])
            if good.any():
                yield i[good], trie.order[j[good]]


def links(words: DataFrame, groups: int = GROUPS, shard_words: int = 50_000) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words one edit apart, once."""
    letters = letter_groups(words, groups)
    words = cut_lineage(words.select("word", "n", vector(F.col("word"), letters).alias("vec")))
    depth = shard_depth(words, groups, shard_words)
    changes = F.array(*[F.array(*[F.lit(x) for x in c]) for c in _visits(depth)])
    top = F.slice("vec", 1, depth + 1)
    to = F.transform(changes, lambda c: F.zip_with(top, c, lambda x, y: x + y))
    visits = words.select(F.explode(F.filter(to, lambda v: ~F.exists(v, lambda c: c < 0))).alias("top"), "word", "n", "vec", F.lit(False).alias("home"))
    visits = visits.select(F.concat_ws(",", F.transform("top", lambda c: c.cast("string"))).alias("shard"), "word", "n", "vec", "home")
    shards = words.select(_shard(F.col("vec"), depth).alias("shard")).distinct()
    visits = visits.join(shards, "shard", "left_semi")  # a shard without words needs no visitor
    rows = visits.unionByName(words.select(_shard(F.col("vec"), depth).alias("shard"), "word", "n", "vec", F.lit(True).alias("home")))

    def search(group: pa.Table) -> pa.Table:
        at_home = group.column("home").to_numpy()
        n = group.column("n").to_numpy()
        vec = group.column("vec").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        spelt = [w.encode("latin-1") for w in group.column("word").to_pylist()]
        own, others = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        found = [(others[i], own[j]) for i, j in near_pairs([spelt[r] for r in own], vec[own], [spelt[r] for r in others], vec[others])]
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=int)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=int)
        # words of one shard and one length meet from both sides
        inside = np.fromiter((len(spelt[x]) == len(spelt[y]) for x, y in zip(a, b)), bool, len(a)) & (vec[a][:, : depth + 1] == vec[b][:, : depth + 1]).all(axis=1)
        keep = ~inside | np.fromiter((spelt[x] < spelt[y] for x, y in zip(a, b)), bool, len(a))
        a, b = pa.array(a[keep]), pa.array(b[keep])
        word, count = group.column("word"), group.column("n")
        return pa.table({"a": word.take(a), "n_a": count.take(a), "b": word.take(b), "n_b": count.take(b)})

    return rows.groupBy("shard").applyInArrow(search, "a string, n_a long, b string, n_b long")


# ----------------------------------------------------------------------------- forms and roots


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for each word with a form, by pointer doubling: counts grow ``ratio`` times along a chain, so it is short."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.alias("x").join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = cut_lineage(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(words: DataFrame, ratio: int = 5, groups: int = GROUPS, shard_words: int = 50_000) -> DataFrame:
    """word, n, form, root, n_near, form_n of each row of ``word, n`` (words of letters up to U+00FF, each once)."""
    words = cut_lineage(words)
    pairs = links(words, groups, shard_words)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    both = pairs.select(F.inline(ends))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    best = cut_lineage(best.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    ends_at = roots(best.where("form is not null"))
    return words.join(best.join(ends_at, "word", "left"), "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
