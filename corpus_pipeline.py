"""A training-text pipeline over ``documents``: five stages, each on what its predecessor kept.

Each stage is a function of the session, the documents so far and the folder of the tables.  All but the last return the columns of
documents; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulon.llm import langid, lines, packing, simhash, surrogates
from emulon.llm.common import spare
from emulon.runtime import cut_lineage

#: The key of surrogates; a real run takes a secret of its own.
KEY = b"surrogates of the corpus pipeline"


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` of the text as it is now, in the type that it has."""
    kind = dict(docs.dtypes).get("n_chars")
    counted = docs.withColumn("n_chars", F.length("text").cast(kind)) if kind else docs
    return counted.select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; the others get the language predicted.

    With no document to learn languages from, the others stay as they are."""
    model = langid.train(docs)
    if model is None:
        return docs.where(langid.lettered(F.col("text")))
    lang = spare(docs, "__lang")
    predicted = langid.predict(docs, model, prediction=lang, score=spare(docs, "__score"))
    return predicted.where(F.col(lang) != "und").withColumn("lang", F.col(lang)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line of any document go; documents stay."""
    return _measured(lines.dedup_lines(docs, counts=None), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest key."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates."""
    return _measured(surrogates.replace_entities(docs, KEY), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.packed_digest(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("pack", pack),
]

#: Language, fingerprints, surrogates and packing have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
