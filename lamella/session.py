"""Where intermediate tables go and when they are removed, and global ranks without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster has none to offer."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again, which cuts its lineage, survives lost executors and lets columns be pruned."""
    path = f"{shared_dir(df.sparkSession)}/lamella/{name}-{uuid.uuid4().hex}"
    _written.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that the running operator has stored.
_written: ContextVar[list[str]] = ContextVar("written", default=[])  # noqa: B039  outside of an operator nobody reads it


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The list of tables stored inside. Those that are still on it at the end go to the list around."""
    around, mine = _written.get(), []
    token = _written.set(mine)
    try:
        yield mine
    finally:
        _written.reset(token)
        around.extend(mine)


def read_by(frames: Iterable[DataFrame]) -> set[str]:
    """Names of the folders that these frames read."""
    names = set()
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                paths = leaf.relation().location().rootPaths()
                names |= {paths.apply(k).getName() for k in range(paths.size())}
    return names


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove stored tables."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(operator: Callable) -> Callable:
    """The operator, after which the tables that it stored and its result does not read are removed. Its result is a frame or a tuple of frames."""

    @wraps(operator)
    def run(*args, **options):
        with scratch() as mine:
            out = operator(*args, **options)
            frames = out if isinstance(out, tuple) else (out,)
            needed = read_by(frames)
            drop(frames[0].sparkSession, [p for p in mine if p.rsplit("/", 1)[1] not in needed])
            mine[:] = [p for p in mine if p.rsplit("/", 1)[1] in needed]
        return out

    return run


def ranked(df: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """df with a column name: the place of each row in the ascending order of by, from 0. Values of by are distinct.

    Rows are dealt out by ranges of by and numbered inside each; the sizes of the ranges before are added. One row for each range goes to the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted(parts.groupBy("_part").count().collect())
    starts, at = [], 0
    for part, size in counts:
        starts.append((part, at))
        at += size
    starts = spark.createDataFrame(starts, "_part int, _start long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return parts.withColumn(name, inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col(name)).drop("_part", "_start")
