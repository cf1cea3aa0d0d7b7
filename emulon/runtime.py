"""Session helpers shared by the operators."""

from __future__ import annotations

import functools
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    """Folder of a local session; it goes away with the process."""
    return tempfile.TemporaryDirectory(prefix="emulon-", ignore_cleanup_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = _local_folder().name
        sc.setCheckpointDir(folder)
    return folder or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/emulon/{name}-{uuid.uuid4().hex[:12]}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[list[str]]:
    """Steps written inside are deleted at the end, but for those taken from the list of their paths.

    What a step shuffled goes as soon as it is written."""
    paths: list[str] = []
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    token = _passing.set(paths)
    try:
        yield paths
    finally:
        _passing.reset(token)
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_step(spark: SparkSession, at: int) -> None:
    """Delete a step before the others: the one written as number ``at`` of those inside ``passing_steps``."""
    if paths := _passing.get():
        _delete(spark, paths.pop(at))


def cut_lineage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Later scans read only the columns and partitions they need, nothing is computed twice, and
    a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    if (passing := _passing.get()) is not None:
        passing.append(path)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return written.select(*["`" + c.replace("`", "``") + "`" for c in df.columns])


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this package.  A plain broadcast names its classes by module, which
    executors need not have; here they travel along, as they do with functions."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast) -> object:
    """The object behind ``share``, inside a task; open it once per task."""
    return pickle.loads(shared.value)


SMALL_ROWS = 5_000_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Deal a small table to all workers before heavy computation; it may sit in a single file.

    A large table has partitions enough of its own and is left alone: no shuffle.  Rows are
    dealt by key and kept in key order, so that a repeated run adds up in the same order.
    """
    if rows > SMALL_ROWS:
        return df
    return df.repartition(worker_count(df.sparkSession), key).sortWithinPartitions(key)


def open_table(spark: SparkSession, path: str, deal_by: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet table.  A small one in a few files would be read by a few tasks only: its rows are
    dealt over all workers.  A table with partitions enough is left as it is."""
    df = spark.read.parquet(path)
    workers = worker_count(spark)
    if df.rdd.getNumPartitions() >= workers:  # a bare scan: this plans, it does not run
        return df
    return df.repartition(workers, *deal_by) if deal_by else df.repartition(workers)


def plan_partitions(df: DataFrame) -> int | None:
    """How many partitions the rows will have at most; None if the plan does not tell before it runs."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    if "AdaptiveSparkPlan" not in plan.getClass().getSimpleName():
        return execution.toRdd().getNumPartitions()  # a scan: this plans, it does not run
    return plan.outputPartitioning().numPartitions() or None


def worker_count(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
