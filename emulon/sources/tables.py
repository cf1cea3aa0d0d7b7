"""Reading and pairing of input and output tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emulon.functions.columns import nan_to_null, quoted
from emulon.runtime import cut_lineage

BROADCAST_SPLITS = 100_000  # file splits whose starting numbers are broadcast


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None, sep: str = ",") -> DataFrame:
    """A headered CSV.  Give a schema for large files; without one the types are inferred once.

    NaN cells become nulls.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("nanValue", "NaN")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return nan_to_null(df)


def read_pair(
    spark: SparkSession,
    inputs_path: str,
    outputs_path: str,
    key: str | None = None,
    inputs_schema: str | StructType | None = None,
    outputs_schema: str | StructType | None = None,
) -> DataFrame:
    """The input and the output file as one table, paired by ``key`` or, without one, by row position."""
    x = read_table(spark, inputs_path, inputs_schema)
    y = read_table(spark, outputs_path, outputs_schema)
    return align(x, y, key) if key else pair_by_position(x, y)


@dataclass(frozen=True)
class PairReport:
    """What stands in the way of pairing two tables by key."""

    duplicate_inputs: int
    duplicate_outputs: int
    orphan_inputs: int
    orphan_outputs: int
    null_inputs: int = 0
    null_outputs: int = 0

    @property
    def clean(self) -> bool:
        return not any((self.duplicate_inputs, self.duplicate_outputs, self.orphan_inputs, self.orphan_outputs,
                        self.null_inputs, self.null_outputs))


def pair_report(x: DataFrame, y: DataFrame, key: str) -> PairReport:
    """Keys held twice, keys without a partner and rows without a key, from one grouped count of both key columns.

    A null key pairs with nothing, so it is neither a duplicate nor an orphan but a fault of its own.

    Grouping combines on the map side, so a key that fills a third of a table is one partial row.
    """
    keys = x.select(key, F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        y.select(key, F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = keys.groupBy(key).agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    there = F.col(f"`{key}`").isNotNull()
    row = counts.agg(
        F.count_if(there & (F.col("i") > 1)).alias("di"), F.count_if(there & (F.col("o") > 1)).alias("do"),
        F.count_if(there & (F.col("i") > 0) & (F.col("o") == 0)).alias("oi"),
        F.count_if(there & (F.col("o") > 0) & (F.col("i") == 0)).alias("oo"),
        F.coalesce(F.sum(F.when(~there, F.col("i"))), F.lit(0)).alias("ni"),
        F.coalesce(F.sum(F.when(~there, F.col("o"))), F.lit(0)).alias("no"),
    ).head()
    return PairReport(row["di"], row["do"], row["oi"], row["oo"], row["ni"], row["no"])


def _pairs_by_hash(x: DataFrame, y: DataFrame, key: str, orphans: str) -> bool:
    """Whether nothing stands in the way of pairing, told by a count of the keys' hashes, which are shorter to shuffle than text.

    Where two keys share a hash, or anything else is amiss, the answer is no, and ``pair_report`` tells what it is."""
    keys = x.select(F.col(f"`{key}`").alias("key"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(
        y.select(F.col(f"`{key}`").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    hashed = keys.select(F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("hash"), "i", "o")
    counts = hashed.groupBy("hash").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    if orphans == "drop":
        amiss = "hash is not null and (i > 1 or o > 1)"
    else:
        amiss = "hash is null or i <> 1 or o <> 1"
    return not counts.where(amiss).limit(1).count()


def align(x: DataFrame, y: DataFrame, key: str, orphans: str = "error") -> DataFrame:
    """Inputs and outputs joined by a key that is unique on both sides.

    Duplicate keys are always an error; orphans and null keys are errors too unless ``orphans='drop'``.
    """
    if orphans not in ("error", "drop"):
        raise ValueError("orphans is 'error' or 'drop'")
    if _pairs_by_hash(x, y, key, orphans):
        return x.join(y, key, "inner")
    report = pair_report(x, y, key)
    if report.duplicate_inputs or report.duplicate_outputs:
        raise ValueError(f"keys are not unique: {report}")
    if orphans == "error" and not report.clean:
        raise ValueError(f"keys without a partner: {report}")
    return x.join(y, key, "inner")


# Plan nodes that leave rows in the order and the partitions in which they were read.
KEEP_ORDER = {"Project", "Filter", "SubqueryAlias", "View", "Generate", "Union", "LogicalRelation", "RelationV2", "DataSourceV2Relation", "LocalRelation",
              "LogicalRDD", "ExternalRDD", "Range", "OneRowRelation", "UnresolvedHint", "ResolvedHint", "CollectMetrics"}


def _plan_nodes(plan) -> list[str]:
    """Class names of all nodes of a logical plan."""
    children = plan.children()
    return [plan.getClass().getSimpleName(), *(n for i in range(children.size()) for n in _plan_nodes(children.apply(i)))]


def number_rows(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row positions 0, 1, 2, ... in file order, without moving rows or leaving the JVM.

    A first scan counts the rows of every file split.  The splits, in order of file and offset,
    give each its starting number; inside a split Spark's own row ids are consecutive, which is checked.
    A table that was shuffled has no positions any more and is refused.
    """
    moved = sorted(set(_plan_nodes(df._jdf.queryExecution().analyzed())) - KEEP_ORDER)
    if moved:
        raise ValueError(f"the rows were shuffled, or may have been, by {moved}, so their positions are lost; number them where they are read")
    try:
        marked = df.selectExpr("*", "_metadata.file_path as _file", "_metadata.file_block_start as _start",
                               "monotonically_increasing_id() as _at")
    except AnalysisException:  # not read from files: the partitions are the splits
        marked = df.selectExpr("*", "'' as _file", "cast(spark_partition_id() as bigint) as _start",
                               "monotonically_increasing_id() as _at")
    splits = marked.groupBy("_file", "_start").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(splits.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
    if starts.where(F.col("_last") - F.col("_first") + 1 != F.col("_rows")).limit(1).count():
        raise ValueError("the rows of a file split are not consecutive; number them where they are read")
    starts = starts.select("_file", "_start", "_first", "_before")
    if starts.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    place = (F.col("_before") + F.col("_at") - F.col("_first")).alias(name)
    return marked.join(starts, ["_file", "_start"]).select(place, *df.columns)


def pair_by_position(x: DataFrame, y: DataFrame, name: str = "row_id") -> DataFrame:
    """Pair keyless tables by row position; their lengths must agree."""
    return align(number_rows(x, name), number_rows(y, name), name)


def decimal_comma(column: str) -> Column:
    return F.expr(f"try_cast(regexp_replace({quoted(column)}, ',', '.') AS double)")


def read_decimal_comma(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ";"
) -> DataFrame:
    """A CSV with decimal commas, all given columns (default: all) as doubles.

    Cells that are no numbers become nulls; ``bad_cells`` counts them.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    chosen = set(columns if columns is not None else raw.columns)
    return raw.select(*[decimal_comma(c).alias(c) if c in chosen else F.col(f"`{c}`") for c in raw.columns])


def bad_cells(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = ";") -> DataFrame:
    """Per column, how many filled cells of a decimal-comma file are no numbers."""
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    chosen = list(columns if columns is not None else raw.columns)
    one = raw.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & decimal_comma(c).isNull()).alias(f"c{i}")
                    for i, c in enumerate(chosen)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("bad")) for i, c in enumerate(chosen)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def divide_columns(df: DataFrame, n: int, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """First ``n`` data columns and the rest; the key goes along on both sides so they can be paired."""
    data = [c for c in df.columns if c != key]
    if not 0 < n < len(data):
        raise ValueError(f"n must leave columns on both sides of {len(data)}")
    lead = [key] if key else []
    return df.select(*lead, *data[:n]), df.select(*lead, *data[n:])


def write_divided(df: DataFrame, n: int, path: str, key: str | None = None) -> tuple[str, str]:
    """Write the two halves as headered CSV folders; returns their paths."""
    halves = divide_columns(df, n, key)
    paths = (f"{path}_inputs.csv", f"{path}_outputs.csv")
    for half, target in zip(halves, paths):
        half.write.mode("overwrite").option("header", True).csv(target)
    return paths


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; names that are not there are ignored."""
    return df.drop(*names)


def write_bundle(df: DataFrame, path: str) -> None:
    """All splits as one Parquet table partitioned by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_bundle(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The bundle, or one split of it: only that partition's files are read."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
