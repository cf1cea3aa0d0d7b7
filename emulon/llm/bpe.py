"""Byte-level BPE, encoding and decoding, by contiguous rank arrays.

A word is an array of parts and an array of ranks: the rank of the merge of each part with the next.  The
smallest rank is looked for by a scan, its boundary is deleted, and the ranks next to it are refreshed, until no
merge is left.  The words of a batch lie one after another in the same arrays, so each step works on all of
them at once.  Words longer than ``SHORT`` bytes take a heap instead of scans.

The results are those of the tokenizers library with ``add_special_tokens=False``: special tokens are recognised
in the text, and decoding keeps them and puts U+FFFD for bytes that are not UTF-8.

Nulls and oddities: a null text is empty and has no ids; texts are never cut; each row is encoded for itself, so
null or repeated keys are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emulon.llm.common import column, texts
from emulon.llm.tokens import MEMORY, Encoder, before_words

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 256
NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the others, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Rank of a pair of ids, for arrays of pairs at once: two tables of hashes, without collisions in the second."""

    def __init__(self, keys: np.ndarray):
        self.first = self._fill(keys, np.uint64(0x9E3779B97F4A7C15), 20)
        home = self._slot(keys, np.uint64(0x9E3779B97F4A7C15), 20)
        missed = np.flatnonzero(self.first[home] != np.arange(len(keys)))
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.second = np.full(1 << 18, len(keys), dtype=np.int32)
        for mix in range(0xD1B54A32D192ED03, 0xD1B54A32D192ED03 + 2000, 2):
            self.mix = np.uint64(mix)
            slots = self._slot(keys[missed], self.mix, 18)
            if len(np.unique(slots)) == len(missed):
                self.second[slots] = missed
                return
        raise ValueError("too many merges for the pair table")

    @staticmethod
    def _slot(keys: np.ndarray, mix: np.uint64, bits: int) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(15))) * mix >> np.uint64(64 - bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, mix: np.uint64, bits: int) -> np.ndarray:
        table = np.full(1 << bits, len(keys), dtype=np.int32)
        table[self._slot(keys, mix, bits)] = np.arange(len(keys), dtype=np.int32)
        return table

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = self.first[self._slot(keys, np.uint64(0x9E3779B97F4A7C15), 20)]
        wrong = np.flatnonzero(self.keys[found] != keys)
        again = self.second[self._slot(keys[wrong], self.mix, 18)]
        found[wrong] = np.where(self.keys[again] == keys[wrong], again, NONE)
        return found


class RankEncoder(Encoder):
    """Encodes and decodes without the library; the vocabulary file is the same."""

    def __init__(self, path: str, memory: int = MEMORY):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        alphabet = byte_alphabet()
        self.of_byte = np.zeros(256, dtype=np.int32)
        for char, byte in alphabet.items():
            self.of_byte[byte] = vocabulary[char]
        pairs = np.array([[vocabulary[a], vocabulary[b]] for a, b in merges], dtype=np.uint64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int32)
        keys = (pairs[:, 0] << np.uint64(32)) | pairs[:, 1]
        self.table = PairTable(keys)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.bytes_of: list[bytes] = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in {**vocabulary, **self.special}.items():
            plain = token in self.special or any(c not in alphabet for c in token)
            self.bytes_of[i] = token.encode() if plain else bytes(alphabet[c] for c in token)
        self.cut, self.memory, self.name = before_words, memory, (type(self).__name__, path)
        self.pattern = regex.compile(PATTERN)

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        """Texts that hold special tokens: what lies between is text of its own."""
        out = []
        for text in texts:
            ids = []
            for segment in self.at_special.split(text):
                if segment in self.special:
                    ids.append(np.array([self.special[segment]], dtype="<u4").tobytes())
                elif segment:
                    ids += super().encode([segment])
            out.append(b"".join(ids))
        return out

    def _new_ids(self, chunks: list[str], raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        find = self.pattern.findall
        plain = [c.removeprefix(" ").isalpha() for c in chunks]  # one match of the pattern
        words = [[c.encode()] if p else [w.encode() for w in find(c)] for c, p in zip(chunks, plain)]
        new = list(set().union(*words)) if words else []
        known: dict[bytes, bytes] = {}
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            short = [w for w in part if len(w) <= SHORT]
            known.update(zip(short, self.merge_words(short)))
            known.update([(w, self.merge_long(w)) for w in part if len(w) > SHORT])
        get = known.__getitem__
        return [get(w[0]) if len(w) == 1 else b"".join(map(get, w)) for w in words]

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; every step deletes one boundary in each word that has a merge left."""
        if not words:
            return []
        out: list[bytes] = [b""] * len(words)
        parts = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        sizes = np.array([len(w) for w in words])
        names = np.arange(len(words))[sizes > 0]
        sizes = sizes[sizes > 0]
        owner = np.repeat(np.arange(len(names)), sizes)
        ranks = np.full(len(parts), NONE, dtype=np.int32)
        ranks[:-1] = self.table.ranks(parts[:-1], parts[1:])
        ranks[np.cumsum(sizes) - 1] = NONE  # the last part has no partner
        while len(names):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            over = least == NONE
            if over.mean() > 0.25 or over.all():
                raw = parts.astype("<u4").tobytes()
                for i, a, n in zip(names[over].tolist(), starts[over].tolist(), sizes[over].tolist()):
                    out[i] = raw[4 * a : 4 * (a + n)]
                stay = np.repeat(~over, sizes)
                parts, ranks = parts[stay], ranks[stay]
                names, sizes, least = names[~over], sizes[~over], least[~over]
                if not len(names):
                    break
                owner = np.repeat(np.arange(len(names)), sizes)
                over = least == NONE
            at = np.flatnonzero((ranks == least[owner]) & (ranks != NONE))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # the leftmost of each word
            parts[at] = self.made[ranks[at]]
            stay = np.ones(len(parts), dtype=bool)
            stay[at + 1] = False
            ranks[at] = ranks[at + 1]  # only tells whether the merged part ends its word
            ends = np.zeros(len(parts), dtype=bool)
            ends[np.cumsum(sizes) - 1] = True
            ends[at] |= ends[at + 1]
            sizes[owner[at]] -= 1
            at = at - np.arange(len(at))  # where the merged parts come to lie
            parts, ranks, owner, ends = parts[stay], ranks[stay], owner[stay], ends[stay]
            for left in (at[~ends[at]], (at - 1)[(at > 0) & ~ends[at - 1]]):
                ranks[left] = self.table.ranks(parts[left], parts[left + 1])
            ranks[at[ends[at]]] = NONE
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The same for a long word: merges wait in a heap by rank and place, parts are linked."""
        parts = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank_of.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue  # one of them was merged before
            parts[i], parts[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return np.array([p for p in parts if p >= 0], dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                ids = encoder.encode(column(piece, "text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder(tokenizer)
        for batch in batches:
            decoded = [encoder.decode(i) for i in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(decoded, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes those ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                ids = encoder.encode(column(piece, "text").to_pylist())
                decoded = [hashlib.sha256(encoder.decode(i).encode()).hexdigest() for i in ids]
                yield pa.RecordBatch.from_arrays([
                    column(piece, "doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
