"""Whole texts to token ids with the tokenizers library, each distinct chunk once.

A chunk is a piece of text at whose ends the tokenizer always splits, so the ids of a text are the ids of its
chunks one after another.  Words repeat, so few chunks are new.  A batch of texts is cut, and its
equal chunks are found, as arrays: by a hash of their bytes, then by the bytes themselves.  Chunks and
their ids are remembered, in arrays, as long as the worker process lives.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Callable

import numpy as np

from emulon.llm.common import one_thread, ranges

MEMORY = 600_000  # chunks remembered; beyond it the memory starts anew
BATCH = 4_000_000  # bytes of text cut at once
SLICE = 2_000_000  # bytes hashed at once
MARKS = b".,;:!?"
_FACTORS = np.random.default_rng(20).integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ASCII letters and digits, visible ASCII, and marks."""
    table = np.zeros((3, 256), dtype=bool)
    table[0, [c for c in range(128) if chr(c).isalnum()]] = True
    table[1, 0x21:0x7F] = True
    table[2, list(MARKS)] = True
    return table[0][raw], table[1][raw], table[2][raw]


def before_words(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks for the byte-level pattern; ``first``: where texts start.  Cuts are made

    - before one space that precedes a visible character: the space belongs to what follows, and white space before
      it is a match of its own, whatever comes next;
    - between a letter or digit and a mark: no match holds both in this order;
    - before a line feed after a visible character, and after it if it stands alone before a visible one.

    Lead bytes under which Unicode has white space (C2, E1, E2, E3) are not taken for visible; not to cut is always right.
    """
    alnum, dark, mark = _kinds(raw)
    visible = (raw > 0x20) & (raw != 0x7F) & (raw != 0xC2) & ((raw < 0xE1) | (raw > 0xE3))
    feed = raw == 0x0A
    cut = np.zeros(len(raw), dtype=bool)
    cut[:-1] = (raw[:-1] == 0x20) & visible[1:]
    cut[1:] |= (alnum[:-1] & mark[1:]) | (dark[:-1] & feed[1:])
    cut[2:] |= dark[:-2] & feed[1:-1] & visible[2:]
    # characters before a place count within its text only: a line feed that starts a text has none before it
    after = first[feed[first]] + 1
    after = after[after < len(raw)]
    cut[after] &= raw[after] == 0x20
    cut[first] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(raw))


def at_white_space(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokenizers that drop white space: what lies between ASCII white space, a mark after a letter or digit apart."""
    alnum, _, mark = _kinds(raw)
    dark = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    begin, end = dark.copy(), dark.copy()
    apart = alnum[:-1] & mark[1:]
    begin[1:] &= ~dark[:-1] | apart
    end[:-1] &= ~dark[1:] | apart
    border = first[first > 0]  # texts follow one another without a gap
    begin[border], end[border - 1] = dark[border], dark[border - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Memory:
    """Chunks by hash, with their bytes and ids, in flat arrays; entries are numbered as they came."""

    def __init__(self):
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.text_ends, self.ids_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Entries of the chunks; -1 for those not known, -2 where another chunk has the hash."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, self.entry[at], -1)
        known = np.flatnonzero(found >= 0)
        e = found[known]
        same = self.text_ends[e + 1] - self.text_ends[e] == lengths[known]
        found[known[~same]] = -2
        known, e = known[same], e[same]
        differ = self.text[ranges(self.text_ends[e], lengths[known])] != raw[ranges(starts[known], lengths[known])]
        found[np.repeat(known, lengths[known])[differ]] = -2
        return found

    def add(self, hashes: np.ndarray, texts: list[bytes], ids: list[bytes]) -> np.ndarray:
        new = np.arange(len(texts)) + len(self.text_ends) - 1
        both = np.append(self.hashes, hashes)
        order = np.argsort(both, kind="stable")
        self.hashes, self.entry = both[order], np.append(self.entry, new)[order]
        self.text = np.append(self.text, np.frombuffer(b"".join(texts), np.uint8))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4"))
        self.text_ends = np.append(self.text_ends, self.text_ends[-1] + np.cumsum([len(t) for t in texts]))
        self.ids_ends = np.append(self.ids_ends, self.ids_ends[-1] + np.cumsum([len(i) // 4 for i in ids]))
        return new


def _of_worker() -> dict:
    """What lasts as long as the process: functions of this package travel by value, so its modules do not."""
    return sys.modules.setdefault("_emulon_worker", types.ModuleType("_emulon_worker")).__dict__.setdefault("tokens", {})


class Encoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``, truncation and padding unused.

    New chunks go to the library joined to texts of many chunks, which is faster than one by one.  Where
    a chunk's ids end is told by the bytes they stand for (byte-level vocabulary) or by the
    ids that close a word (vocabulary with word ends).
    """

    def __init__(self, path: str, cut: Callable, memory: int = MEMORY):
        one_thread()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.cut, self.memory, self.name = cut, memory, (type(self).__name__, path)
        vocabulary = self.library.get_vocab()
        self.word_ends = any(t.endswith("</w>") for t in vocabulary)
        self.weight = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.weight[i] = token.endswith("</w>") if self.word_ends else len(token)

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _sizes(self, chunks: list[str], raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray | list[int]:
        """What the weights of each chunk's ids add up to; -1 if only the library can tell."""
        if not self.word_ends:
            whole = (raw[starts] == 0x20) & (raw[starts + lengths - 1] > 0x20) & (lengths < 1000)
            return np.where(whole, lengths, -1)
        return [1 if c.isalpha() and "\u0130" not in c else -1 for c in chunks]  # lower case adds a mark to this one letter

    def _new_ids(self, chunks: list[str], raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The ids of chunks, and where in ``raw`` their bytes are."""
        sizes = np.array(self._sizes(chunks, raw, starts, lengths))
        out: list[bytes] = [b""] * len(chunks)
        alone = np.flatnonzero(sizes < 0).tolist()
        for i, ids in zip(alone, self._library_ids([chunks[i] for i in alone])):
            out[i] = ids
        joint = np.flatnonzero(sizes >= 0)
        glue = " " if self.word_ends else ""
        for at in range(0, len(joint), 20_000):
            some = joint[at : at + 20_000].tolist()
            part = [chunks[i] for i in some]
            encoded = self.library.encode_batch_fast(
                [glue.join(part[i : i + 200]) for i in range(0, len(part), 200)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in encoded])
            ends = 4 * (np.searchsorted(np.cumsum(self.weight[ids]), np.cumsum(sizes[some])) + 1)
            raw, ends = ids.tobytes(), ends.tolist()
            for i, a, b in zip(some, [0, *ends], ends):
                out[i] = raw[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        batch, raws, size = [], [], 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):  # a special token may touch anything: such a text goes whole
                out[i] = self._library_ids([text])[0]
            elif text:
                batch.append(i)
                raws.append(text.encode())
                size += len(raws[-1])
            if batch and (size >= BATCH or i == len(texts) - 1):
                for j, ids in zip(batch, self._encode(raws)):
                    out[j] = ids
                batch, raws, size = [], [], 0
        if batch:
            for j, ids in zip(batch, self._encode(raws)):
                out[j] = ids
        return out

    def _encode(self, raws: list[bytes]) -> list[bytes]:
        joined = b"".join(raws)
        raw = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.array([len(r) for r in raws])
        first = np.cumsum(sizes) - sizes
        starts, ends = self.cut(raw, first)
        if not len(starts):
            return [b""] * len(raws)
        lengths = ends - starts
        hashes = np.empty(len(starts), dtype=np.uint64)
        gapless = bool((ends[:-1] == starts[1:]).all())  # then a run of chunks is a stretch of the text
        slices = np.searchsorted(ends, np.arange(0, len(raw) + SLICE, SLICE), "right")
        slices = [(a, b) for a, b in zip(slices[:-1], [*slices[1:-1], len(starts)]) if b > a]
        for a, b in slices:
            at = np.cumsum(lengths[a:b]) - lengths[a:b]
            text = raw[starts[a] : ends[b - 1]] if gapless else raw[ranges(starts[a:b], lengths[a:b])]
            place = np.arange(len(text)) - np.repeat(at, lengths[a:b])
            place &= 4095
            weighted = _FACTORS[place]
            weighted *= np.add(text, 1, dtype=np.uint64)
            hashes[a:b] = np.add.reduceat(weighted, at)
        hashes, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        same = (lengths == lengths[one][which]).all() and all(
            ((raw[starts[a] : ends[b - 1]] if gapless else raw[ranges(starts[a:b], lengths[a:b])])
             == raw[ranges(starts[one][which[a:b]], lengths[a:b])]).all() for a, b in slices)
        if not same:  # two chunks share a hash: take each text for itself
            return [self._library_ids([r.decode()])[0] for r in raws]
        memories = _of_worker()
        memory: Memory = memories.setdefault(self.name, Memory())
        found = memory.find(hashes, raw, starts[one], lengths[one])
        if (found == -2).any() or len(memory.hashes) + (found < 0).sum() > self.memory:
            memory = memories[self.name] = Memory()
            found[:] = -1
        new = np.flatnonzero(found < 0)
        if len(new):
            chunks = [joined[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())]
            found[new] = memory.add(hashes[new], chunks, self._new_ids([c.decode() for c in chunks], raw, starts[one[new]], lengths[one[new]]))
        taken = (memory.ids_ends[found + 1] - memory.ids_ends[found])[which]
        ids = memory.ids[ranges(memory.ids_ends[found][which], taken)].tobytes()
        upto = np.concatenate([[0], np.cumsum(taken)])
        borders = 4 * upto[np.searchsorted(starts, np.append(first, len(raw)))]
        return [ids[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
