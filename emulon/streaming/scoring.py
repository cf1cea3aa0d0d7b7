"""Scoring of arriving rows, and error monitoring once the truth arrives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emulon.functions.columns import percent_error, quoted
from emulon.plans.scoring import Scorer
from emulon.runtime import scratch_path


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_scores(stream: DataFrame, scorer: Scorer, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append scored rows to a Parquet folder; stateless, so no watermark is needed."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream")
    return (
        scorer.transform(stream).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def monitor_errors(
    predictions: DataFrame,
    truths: DataFrame,
    key: str,
    outputs: Sequence[str],
    predicted_at: str,
    observed_at: str,
    delay: str = "1 hour",
    window: str = "1 hour",
) -> DataFrame:
    """Error of each output per time window, truth joined when it arrives within ``delay``.

    Watermarks on both sides bound the join state, and the window is closed by the watermark.
    """
    left = predictions.withWatermark(predicted_at, delay).alias("p")
    renamed = truths.withColumnsRenamed({c: f"true_{c}" for c in outputs}).withColumnRenamed(key, f"true_{key}")
    right = renamed.withWatermark(observed_at, delay).alias("t")
    condition = (
        (F.col(f"p.{quoted(key)}") == F.col(f"t.{quoted('true_' + key)}"))
        & (F.col(f"t.{quoted(observed_at)}") >= F.col(f"p.{quoted(predicted_at)}"))
        & (F.col(f"t.{quoted(observed_at)}") <= F.col(f"p.{quoted(predicted_at)}") + F.expr(f"INTERVAL {delay}"))
    )
    joined = left.join(right, condition, "inner")
    cells = []
    for c in outputs:
        pred, y = quoted(f"pred_{c}"), quoted(f"true_{c}")
        cells += [
            F.expr(f"avg(({pred} - {y}) * ({pred} - {y}))").alias(f"mse_{c}"),
            F.expr(f"avg(abs({pred} - {y}))").alias(f"mae_{c}"),
            F.expr(f"avg(abs({percent_error(pred, y)}))").alias(f"mape_{c}"),
        ]
    grouped = joined.groupBy(F.window(F.col(f"p.{quoted(predicted_at)}"), window)).agg(F.count(F.lit(1)).alias("rows"), *cells)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          "rows", *[f"{m}_{c}" for c in outputs for m in ("mse", "mae", "mape")])
