"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.session import drop, read_by, scratch, shared_dir, stored, tidy  # noqa: F401

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(**columns: Column) -> Column:
    """For a select: columns that are evaluated once per row. A filter, join or lambda that uses one is not given its expression instead, as nothing is pushed through a generator."""
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combinations (sums, maxima) of an array of int, by doubling: n log n for n numbers, where an array that grows in a fold costs n * n."""
    shift = lambda a, i, k: F.get(a, i - F.call_function("shiftleft", F.lit(1), k))
    step = lambda a, k: F.transform(a, lambda x, i: F.coalesce(combine(x, shift(a, i, k)), x)).cast("array<int>")
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(numbers))) - 1)
    return F.aggregate(rounds, numbers.cast("array<int>"), step)


def whole(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has at most so many rows; counting should be cheap, so df is stored or checkpointed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of an Arrow batch that is sent to Python, at most: whole texts are long, so batches are short to bound the workers' memory.
ARROW_ROWS = 256


def short_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ARROW_ROWS rows at most; the same for all operators, so the order of calls does not matter."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
