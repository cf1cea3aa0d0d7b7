"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (as long) and the whole text (null: empty); other columns, whatever their names, go."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), whole(F.col(f"`{text}`")).alias("text"))


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def spare(docs: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def one_thread() -> None:
    """Called first inside a task: native libraries keep to the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each range, ranges one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Left join with a table that has each key once.

    Keys that hold a thousandth of ``rows`` (those of ``left``, at least) are a thousand at most: their right rows are broadcast, so no task
    receives all left rows of such a key.  The others meet by shuffle."""
    counts = left.groupBy(key).count().where(F.col("count") * 1000 >= max(rows, 1000)).select(key)
    hot = right.join(F.broadcast(counts), key, "left_semi")
    marked = left.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), key, "left")
    cold = marked.where("is_hot is null").select(*left.columns).join(right, key, "left")
    return marked.where("is_hot").drop("is_hot").unionByName(cold)
