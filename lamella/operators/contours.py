"""Contours: the closed walks around and inside of the components of each slice.

The sides of pixels that part a component from what is beside it are directed so
that the component is on their right. Each has one successor, so they fall into
closed walks: one around each component, clockwise, and one around each of its
holes, counter-clockwise. A contour lists the pixels on the right of its walk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..volume import LabelVolume
from .components import slice_runs, voxels_of

#: Steps along the top, right, bottom and left side of a pixel, walked clockwise; y points down.
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def sides(region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice (x, y) of component ids: which sides of pixels are walls (pixel * 4 + side), and the successor of each; pixels are y * sx + x."""
    sx, sy = region.shape
    framed = np.full((sx + 2, sy + 2), -1, np.int64)
    framed[1:-1, 1:-1] = region
    x, y = np.indices(region.shape)
    at = lambda dx, dy: framed[1 + dx : 1 + dx + sx, 1 + dy : 1 + dy + sy] == region
    walls, following = np.zeros((sx, sy, 4), bool), np.zeros((sx, sy, 4), np.int64)
    number = lambda dx, dy, s: ((y + dy) * sx + x + dx) * 4 + s % 4
    for s, (ax, ay) in enumerate(STEPS):
        ox, oy = STEPS[s - 1]  # outward
        walls[..., s] = ~at(ox, oy)
        ahead, beyond = at(ax, ay), at(ax + ox, ay + oy)
        # Around the corner of the same pixel, straight on, or around an inner corner of the component.
        following[..., s] = np.where(~ahead, number(0, 0, s + 1), np.where(~beyond, number(ax, ay, s), number(ax + ox, ay + oy, s - 1)))
    order = lambda a: a.transpose(1, 0, 2).reshape(-1)
    return order(walls), order(following)


def walked(region: np.ndarray) -> list[tuple[int, bool, np.ndarray]]:
    """(component, outer, pixels) of each contour, begun at its smallest pixel; pixels are 4-connected steps, the corners inside of a bend included."""
    sx = region.shape[0]
    walls, following = sides(region)
    left = walls.copy()
    out = []
    for start in np.flatnonzero(walls).tolist():
        if not left[start]:
            continue
        pixels, turn, at = [], 0, start
        while left[at]:
            left[at] = False
            pixel, side = divmod(at, 4)
            if not pixels or pixels[-1] != pixel:
                pixels.append(pixel)
            at = int(following[at])
            turn += (at % 4 - side + 1) % 4 - 1
            if (at % 4 - side) % 4 == 3:  # an inner corner: the pixel ahead lies between
                pixels.append(pixel + STEPS[side][0] + sx * STEPS[side][1])
        if len(pixels) > 1 and pixels[-1] == pixels[0]:
            pixels.pop()
        p = np.array(pixels, np.int64)
        p = np.roll(p, -int(np.argmin(p)))
        out.append((int(region[p[0] % sx, p[0] // sx]), turn > 0, p))
    return out


def contours(v: LabelVolume) -> DataFrame:
    """z, label, ccid, outer, pixels (y * sx + x, in order) of each contour; label 0 has contours like others. A slice is walked in one task."""
    sx, sy, _ = v.shape

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        region, label = np.zeros((sx, sy), np.int64), np.zeros(int(pdf.ccid.max()) + 1, np.int64)
        region[pdf.x, pdf.y] = pdf.ccid
        label[pdf.ccid] = pdf.label
        rows = [(pdf.z.iloc[0], label[c], c, outer, p) for c, outer, p in walked(region)]
        return pd.DataFrame(rows, columns=["z", "label", "ccid", "outer", "pixels"])

    return voxels_of(slice_runs(v), "ccid", "label").groupBy("z").applyInPandas(one, "z long, label long, ccid long, outer boolean, pixels array<long>")
