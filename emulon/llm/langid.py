"""Language of whole texts by hierarchical discrimination.

Linear support vector machines first tell the language families apart, one against the rest; then, inside the
family found, machines of one language against one other vote.  Features are the roots of the shares of hashed
byte 3-grams and 4-grams of the lower-cased text.

The machines are fitted on the driver on a bounded sample: about ``per_language`` distinct texts, or all if there are no more, of each
of the ``languages`` languages with the most, chosen by a hash of the text.  That bound is the one limit here: distinct texts
are counted over all documents and every whole text is predicted.

Nulls and oddities: a null text, or one without a letter, is ``und`` with score 0, as is everything if there is nothing to learn
from; documents of null language are not learned from; empty tables give empty results; repeated rows are predicted alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulon.llm.common import column, spare
from emulon.runtime import opened, share

BINS = 1 << 13
#: Families of ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms tl",
}


def family(language: str) -> str:
    code = language.lower().split("-")[0].split("_")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"only {language}")


def counts(text: str) -> np.ndarray:
    """Hashed byte 3-grams and 4-grams of the whole lower-cased text."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", dtype=np.uint8)
    total = np.zeros(BINS, dtype=np.int64)
    for at in range(0, len(raw), 1 << 20):
        b = raw[at : at + (1 << 20) + 3].astype(np.uint32)
        if len(b) < 3:
            break
        three = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        last = at + (1 << 20) + 3 >= len(raw)
        three = three if last else three[: 1 << 20]
        four = (three[: len(b) - 3] << np.uint32(8)) | b[3:][: len(three)]
        for grams, mix in ((three, np.uint32(2654435761)), (four, np.uint32(2246822519))):
            total += np.bincount((grams * mix) >> np.uint32(19), minlength=BINS)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def lettered(text: Column) -> Column:
    """``has_letter`` of a column; null where it is."""
    return text.cast("string").rlike(r"\p{L}")


class Model(NamedTuple):
    languages: list[str]
    families: list[str]
    members: list[list[int]]  # languages of each family
    family_weights: np.ndarray  # (BINS + 1, families)
    pairs: list[tuple[int, int]]  # languages of each pair machine, within a family
    pair_weights: np.ndarray  # (BINS + 1, pairs)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each row of features."""
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        by_family = x @ self.family_weights
        best = by_family.argmax(axis=1)
        others = by_family.copy()
        others[np.arange(len(x)), best] = -np.inf
        gap = by_family.max(axis=1) - others.max(axis=1) if len(self.families) > 1 else np.full(len(x), 20.0)
        score = 1 / (1 + np.exp(-np.minimum(gap, 20)))
        margins = x @ self.pair_weights
        out = []
        for i, f in enumerate(best.tolist()):
            members = self.members[f]
            votes = dict.fromkeys(members, 0)
            sure = dict.fromkeys(members, 0.0)
            for j, (a, b) in enumerate(self.pairs):
                if a in votes and b in votes:
                    m = float(margins[i, j])
                    votes[a if m > 0 else b] += 1
                    sure[a] += m
                    sure[b] -= m
            winner = max(members, key=lambda m: (votes[m], sure[m], -m))
            if len(members) > 1:
                score[i] /= 1 + np.exp(-max(-20.0, 2 * sure[winner] / (len(members) - 1)))
            out.append(self.languages[winner])
        return out, score


def support_vectors(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, the bias last; accelerated full gradients.

    ``y`` is 1 or -1; both classes weigh the same.  Rows of ``x`` have length one.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = ahead = np.zeros(x.shape[1], dtype=x.dtype)
    rate = 1 / (4 + penalty)  # squared lengths are at most 2
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = penalty * ahead - 2 * x.T @ (share * y * slack)
        new = ahead - rate * gradient
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return w


def _features(raw: np.ndarray) -> np.ndarray:
    total = np.maximum(1, raw.sum(axis=1, keepdims=True))
    return np.sqrt(raw / total).astype(np.float32)


def fit(rows: list[tuple[str, np.ndarray]]) -> Model | None:
    """The machines for rows of language and counts."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    which = np.array([languages.index(lang) for lang, _ in rows])
    x = _features(np.stack([c for _, c in rows]))
    families = sorted({family(lang) for lang in languages})
    members = [[i for i, lang in enumerate(languages) if family(lang) == f] for f in families]
    of_family = np.array([families.index(family(lang)) for lang in languages])[which]
    none = np.zeros((BINS + 1, 0), dtype=np.float32)
    weights = [support_vectors(x, np.where(of_family == f, 1, -1).astype(np.float32)) for f in range(len(families))]
    pairs = [(a, b) for m in members for i, a in enumerate(m) for b in m[i + 1 :]]
    machines = []
    for a, b in pairs:
        rows_ab = (which == a) | (which == b)
        machines.append(support_vectors(x[rows_ab], np.where(which[rows_ab] == a, 1, -1).astype(np.float32)))
    return Model(languages, families, members, np.stack(weights, axis=1), pairs, np.stack(machines, axis=1) if pairs else none)


def train(docs: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang",
          per_language: int = 300, languages: int = 100) -> Model | None:
    """Fits the machines on a sample of the rows where ``learn`` holds."""
    known = docs.where(learn) if learn is not None else docs
    known = known.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where(
        F.col("lang").isNotNull() & lettered(F.col("text")))
    # copies and texts that are not learned from must not make the others' chance smaller
    texts = known.select("lang", F.xxhash64("text").alias("hash")).distinct()
    frequent = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not frequent:
        return None
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    chance = F.create_map(*[F.lit(v) for r in frequent for v in (r["lang"], min(1.0, per_language / r["count"]))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, zlib.compress(counts(t).astype("<u4").tobytes(), 1))
                    for lang, t in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["lang", "counts"])

    # equal texts share their hash: at most this many rows a language go on, whatever the copies
    sample = known.where(unit < chance[F.col("lang")]).dropDuplicates(["lang", "text"]).mapInArrow(count, "lang string, counts binary")
    rows = sorted((r["lang"], bytes(r["counts"])) for r in sample.collect())
    return fit([(lang, np.frombuffer(zlib.decompress(c), "<u4")) for lang, c in rows])


def predict(docs: DataFrame, model: Model | None, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns, with the language predicted from the whole text and its score."""
    shared = share(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted: Model | None = opened(shared)
        for texts in batches:
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            good = [i for i, t in enumerate(texts) if has_letter(t)] if fitted else []
            for at in range(0, len(good), 256):
                part = good[at : at + 256]
                found, sure = fitted.predict(_features(np.stack([counts(texts.iloc[i]) for i in part])))
                scores[part] = sure
                for i, name in zip(part, found):
                    langs[i] = name
            yield pd.DataFrame({"lang": langs, "score": scores})

    # a filter on the result must not make Spark predict twice
    language = language.asNondeterministic()
    name = spare(docs, "__language")
    found = F.col(name)
    return docs.withColumn(name, language(F.col(f"`{text}`").cast("string"))).withColumns(
        {prediction: found["lang"], score: found["score"]}).drop(name)
