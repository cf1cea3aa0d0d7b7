"""Plans that must hold at scale: pruned scans, pushed filters, no cross joins, no Python where none is needed."""

import numpy as np
import pytest

from emulon import Roles, fit
from emulon.operators.evaluate import metrics
from emulon.operators.outliers import FenceFilter
from emulon.operators.scale import ColumnScale, Scalers
from emulon.operators.split import split
from emulon.runtime import open_table

LINES = "/root/testdata/sf0.001/lineitem.parquet"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(LINES)


def test_scaling_reads_only_its_columns(lines):
    scaled = Scalers({"l_tax": ColumnScale("minmax", 0.0, 0.08)}).transform(lines).select("l_tax", "l_orderkey")
    text = plan(scaled)
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in text and "Exchange" not in text


def test_fences_reach_the_scan(lines):
    kept = FenceFilter({"l_tax": (0.0, 0.05)}, keep_missing=False).transform(lines).select("l_tax")
    assert "Exchange" not in plan(kept) and "Python" not in plan(kept)


def test_split_is_narrow(lines):
    assert "Exchange" not in plan(split(lines.select("l_orderkey"), "l_orderkey"))


def test_surface_prediction_stays_in_the_jvm(spark, lines):
    rows = lines.selectExpr("monotonically_increasing_id() as key", "l_tax as a", "l_discount as b", "l_tax * l_discount as y")
    model = fit("response_surface", rows, Roles("key", ("a", "b"), ("y",)))
    text = plan(model.transform(rows))
    assert "Python" not in text and "Exchange" not in text
    assert np.allclose(model.transform(rows).selectExpr("max(abs(pred_y - y))").head()[0], 0, atol=1e-9)


def test_metrics_shuffle_one_row_per_task(lines):
    table = metrics(lines.selectExpr("l_tax as y", "l_tax * 1.1 as pred_y"), ["y"], ["mse", "mae", "mape"])
    text = plan(table)
    assert "Exchange SinglePartition" in text and "hashpartitioning" not in text
    assert "ReadSchema: struct<l_tax:double>" in text


def test_small_tables_are_dealt_and_large_ones_left_alone(spark):
    dealt = open_table(spark, LINES, ("l_orderkey",))
    assert dealt.rdd.getNumPartitions() == 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert "Exchange" not in plan(open_table(spark, LINES, ("l_orderkey",)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
