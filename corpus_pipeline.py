"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from lamella.llm import common as C
from lamella.llm import jaccard_join, mixing, packing, quality_rules, queries, secrets, token_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates share at least 80 / 100 of their distinct five-word shingles.
NEAR = {"words": 5, "num": 80, "den": 100}


#: Tables that the last stage's result reads.
_left: list[str] = []


def stage(f: Callable) -> Callable:
    """A stage, before which the tables of the stage before it are removed: its result has been written, and docs are read from there."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = C.read_by([docs])
        C.drop(spark, [p for p in _left if p.rsplit("/", 1)[1] not in read])
        with C.scratch() as mine:
            out = f(spark, docs, sf_dir)
            _left[:] = mine
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the n-gram Jaccard join: the smallest doc_id."""
    return jaccard_join.representatives(docs, **NEAR)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced in the texts; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs, queries.n_words(), ties=F.md5(C.whole("text")))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their length in tokens, bucket, batch and slot."""
    sized = C.stored(token_files.lengths(docs, tokenizer=queries.tokenizer_path()), "sized")
    return packing.pack(sized, F.col("n_tokens"), ties=F.md5(C.whole("text")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]

#: Linking by similarity and dynamic programming have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    with C.scratch() as written:
        for name, function in STAGES[:-1]:
            before = list(written)
            docs = C.stored(function(spark, docs, sf_dir), f"pipeline-{name}")
            C.drop(spark, [p for p in before if p not in _left])
            written[:] = [p for p in written if p not in before]
    out = STAGES[-1][1](spark, docs, sf_dir)
    _left.clear()  # out is read by the caller, later runs leave its tables alone
    return out
