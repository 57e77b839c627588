"""Volumes that arrive slab by slab: running counts and boxes of labels over a stream of voxel tables.

Voxels have no event time and slabs may come in any order, so the state is one
row for each label, and results are updates of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..volume import VOXEL


def read_slabs(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files under path, with columns x, y, z, label."""
    return spark.readStream.schema(VOXEL).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_stats(voxels: DataFrame) -> DataFrame:
    """label, voxel_count and inclusive box so far; to be written in update or complete mode."""
    return voxels.groupBy("label").agg(F.count("*").alias("voxel_count"), *[F.min(c).alias(f"min_{c}") for c in "xyz"], *[F.max(c).alias(f"max_{c}") for c in "xyz"])
