"""Pins: vertical segments of one label that together meet every component of every slice."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..volume import LabelVolume
from .aggregates import z_columns
from .components import slice_components, slice_runs, voxels_of


def cover(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy cover of the components of one label: the column that meets most components not met yet, again and again; ties go to the first place.

    pdf: x, y, z0, depth, cells (the component met in each slice). What a column meets only shrinks, so counts in the heap are upper bounds.
    """
    cells = [list(zip(range(z, z + len(c)), c, strict=True)) for z, c in zip(pdf.z0, pdf.cells, strict=True)]
    place = list(zip(pdf.z0, pdf.y, pdf.x, strict=True))
    heap = [(-len(c), place[i], i) for i, c in enumerate(cells)]
    heapq.heapify(heap)
    met, chosen = set(), []
    while heap:
        n, p, i = heapq.heappop(heap)
        left = [c for c in cells[i] if c not in met]
        if not left:
            continue
        if heap and (-len(left), p) > heap[0][:2]:
            heapq.heappush(heap, (-len(left), p, i))
            continue
        met.update(left)
        chosen.append(i)
    return pdf.iloc[np.array(sorted(chosen), dtype=int)][["label", "slab", "x", "y", "z0", "depth", "cells"]]


#: Slices of a slab. Pins end at its faces, so a label's cover is found slab by slab and no label is in one task as a whole.
SLAB = 128


def slab_columns(v: LabelVolume, slab: int) -> DataFrame:
    """The columns of z_columns(), cut at the faces of slabs."""
    last = F.col("z0") + F.col("depth")
    s = z_columns(v).withColumn("slab", F.explode(F.sequence(F.floor(F.col("z0") / slab), F.floor(last / slab))))
    low, high = F.greatest("z0", F.col("slab") * slab), F.least(last, (F.col("slab") + 1) * slab - 1)
    return s.select("x", "y", low.alias("z0"), (high - low).alias("depth"), "label", "slab")


def covers(v: LabelVolume, slab: int = SLAB) -> DataFrame:
    """label, slab, x, y, z0, depth, cells: for each label and slab, columns that meet each of its components, and the component that they meet in each slice.

    Columns that meet the same components as another are dropped first.
    """
    columns = slab_columns(v, slab)
    at = columns.select("label", "slab", "x", "y", "z0", "depth", F.explode(F.sequence("z0", F.col("z0") + F.col("depth"))).alias("z"))
    met = at.join(slice_components(v), ["x", "y", "z"]).groupBy("label", "slab", "x", "y", "z0", "depth").agg(F.sort_array(F.collect_list(F.struct("z", "ccid"))).alias("c"))
    met = met.select("label", "slab", "x", "y", "z0", "depth", F.transform("c", lambda c: c["ccid"]).alias("cells"))
    # One column for each set of components: the first in raster order.
    one = met.groupBy("label", "slab", "z0", "depth", "cells").agg(F.min(F.struct("y", "x")).alias("p")).select("label", "slab", "p.x", "p.y", "z0", "depth", "cells")
    return one.groupBy("label", "slab").applyInPandas(cover, "label long, slab long, x long, y long, z0 long, depth long, cells array<long>")


def pins(v: LabelVolume, slab: int = SLAB) -> DataFrame:
    """label, x, y, z0, depth: for each label, columns that meet each of its components."""
    return covers(v, slab).select("label", "x", "y", "z0", "depth")


def met_components(v: LabelVolume, p: DataFrame) -> DataFrame:
    """z, ccid, label of each component that a pin of its label meets."""
    at = p.select(F.col("label").alias("pin"), "x", "y", F.explode(F.sequence("z0", F.col("z0") + F.col("depth"))).alias("z"))
    there = voxels_of(slice_runs(v), "ccid", "label")
    return at.join(there, ["x", "y", "z"]).where("pin = label").select("z", "ccid", "label").distinct()


def background(p: DataFrame) -> DataFrame:
    """The label with most pins, the smallest of several: what a pin format need not store."""
    return p.groupBy("label").agg(F.count("*").alias("n")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
