"""Tables that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emulon import Roles
from emulon.functions.columns import row_key
from emulon.operators.split import split
from emulon.runtime import cut_lineage, open_table

LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
INPUTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
CONTINUOUS = INPUTS[:4]
OUTPUTS = ("charge", "TCP_X_pos_list_0", "TCP_X_pos_list_1")
ROLES = Roles("key", INPUTS, OUTPUTS, ("l_linenumber",))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as an experiment table.  No column is a key, the whole row is."""
    lines = open_table(spark, f"{sf}/lineitem.parquet", ("l_orderkey", "l_partkey"))
    return lines.withColumn("key", row_key(LINE_COLUMNS)).selectExpr(
        "key",
        "l_orderkey",
        *INPUTS,
        "l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge",
        "l_extendedprice * l_discount as TCP_X_pos_list_0",
        "l_quantity * l_tax as TCP_X_pos_list_1",
    )


def parted(spark: SparkSession, sf: str) -> DataFrame:
    """The experiment table with its split, written once: fits scan the training part several times."""
    return cut_lineage(split(experiment(spark, sf), "key"), partition_by="split")


EXPERIMENT_SQL = f"""exp AS (
  SELECT md5(concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in LINE_COLUMNS)})) AS key,
         l_orderkey, {', '.join(INPUTS)},
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
         l_extendedprice * l_discount AS TCP_X_pos_list_0,
         l_quantity * l_tax AS TCP_X_pos_list_1
  FROM lineitem
)"""


def with_gaps(df: DataFrame) -> DataFrame:
    """The experiment table with missing inputs, by a rule on the values themselves."""
    return df.selectExpr(
        "key", "l_orderkey",
        "if(l_orderkey % 17 = 0, null, l_quantity) as l_quantity",
        "if(l_orderkey % 13 = 0, double('NaN'), l_extendedprice) as l_extendedprice",
        "l_discount", "l_tax", "l_linenumber", *OUTPUTS,
    )


GAPS_SQL = f"""{EXPERIMENT_SQL}, gaps AS (
  SELECT key, l_orderkey,
         CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
         l_discount, l_tax, l_linenumber, {', '.join(OUTPUTS)}
  FROM exp
)"""


def predicted(df: DataFrame) -> DataFrame:
    """A made prediction for every output: some percent off by a rule on the order key."""
    return df.selectExpr("*", *[f"{c} * (1 + ((l_orderkey % 7) - 3) / 100D) as pred_{c}" for c in OUTPUTS])


PREDICTED_SQL = f"""{EXPERIMENT_SQL}, predicted AS (
  SELECT *, {', '.join(f'{c} * (1 + ((l_orderkey % 7) - 3) / 100.0::DOUBLE) AS pred_{c}' for c in OUTPUTS)}
  FROM exp
), long AS (
  {' UNION ALL '.join(f"SELECT key, '{c}' AS output, {c} AS y, pred_{c} AS pred FROM predicted" for c in OUTPUTS)}
)"""


def unit_sql(key: str = "key", seed: int = 42, purpose: str = "") -> str:
    """The hash of a key as a number in [0, 1)."""
    return f"(('0x' || substr(md5('{purpose}{seed}:' || CAST({key} AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def split_sql(source: str = "exp", key: str = "key", test: float = 0.15, val: float = 0.15) -> str:
    u = unit_sql(key)
    return (f"parted AS (SELECT *, CASE WHEN {u} < {test} THEN 'test' WHEN {u} < {test} + {val} THEN 'val' "
            f"ELSE 'train' END AS split FROM {source})")


def rounded(df: DataFrame, digits: dict[str, int] | int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """All double columns rounded, so that sums in another order agree."""
    from pyspark.sql.types import DoubleType

    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}

    def places(c):
        return digits if isinstance(digits, int) else digits.get(c, 6)

    return df.selectExpr(*[
        f"round(`{c}`, {places(c)}) as `{c}`" if c in doubles and c not in keep else f"`{c}`" for c in df.columns])
