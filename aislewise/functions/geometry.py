"""Boxes, polygons and plane maps as columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def area(box: Box) -> Column:
    x1, y1, x2, y2 = box
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0.0))).otherwise(F.lit(0.0))


def foot_point(box: Box) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, box[3]


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges; a horizontal edge is never crossed."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 == y2:
            continue
        hit = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < F.lit(float(x2 - x1)) * (y - float(y1)) / float(y2 - y1) + float(x1))
        crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def edge_distance(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Distance to the nearest edge, positive inside and negative outside."""
    nearest = None
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        dx, dy = float(x2 - x1), float(y2 - y1)
        length = dx * dx + dy * dy
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - float(x1)) * dx + (y - float(y1)) * dy) / length)) if length else F.lit(0.0)
        d = F.hypot(x - (t * dx + float(x1)), y - (t * dy + float(y1)))
        nearest = d if nearest is None else F.least(nearest, d)
    return F.when(in_polygon(x, y, polygon), nearest).otherwise(-nearest)


def apply_homography(h: Sequence[Sequence[float]], x: Column, y: Column) -> tuple[Column, Column]:
    w = x * h[2][0] + y * h[2][1] + h[2][2]
    return (x * h[0][0] + y * h[0][1] + h[0][2]) / w, (x * h[1][0] + y * h[1][1] + h[1][2]) / w


def fit_homography(src: Sequence[tuple[float, float]], dst: Sequence[tuple[float, float]], threshold: float = 0.10) -> tuple[np.ndarray, list[int]]:
    """(3x3 map, inlier numbers) from a camera's few marked points, on the driver.

    Every four points give a map; the one with most points within the threshold (then the smallest error) is fitted
    again on those points.
    """
    a, b = np.asarray(src, float), np.asarray(dst, float)
    if len(a) < 4:
        raise ValueError("four points or more are needed")
    best = None
    for four in combinations(range(len(a)), 4):
        error = _error(h := _direct_linear(a[list(four)], b[list(four)]), a, b) if len(a) > 4 else np.zeros(len(a))
        inside = np.flatnonzero(error <= threshold)
        rank = (-len(inside), float(error[inside].sum()))
        if np.isfinite(rank[1]) and (best is None or rank < best[0]):
            best = (rank, inside)
    inside = best[1] if best and len(best[1]) >= 4 else np.arange(len(a))
    h = _direct_linear(a[inside], b[inside])
    return h, inside.tolist()


def _direct_linear(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    def centred(p):
        mean, scale = p.mean(axis=0), np.sqrt(2) / max(np.linalg.norm(p - p.mean(axis=0), axis=1).mean(), 1e-12)
        return np.array([[scale, 0, -scale * mean[0]], [0, scale, -scale * mean[1]], [0, 0, 1]])

    ta, tb = centred(a), centred(b)
    rows = []
    for (x, y), (u, v) in zip(a, b):
        x, y, _ = ta @ (x, y, 1)
        u, v, _ = tb @ (u, v, 1)
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    return h / (h[2, 2] if abs(h[2, 2]) > 1e-12 else 1.0)


def _error(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = np.c_[a, np.ones(len(a))] @ h.T
    with np.errstate(all="ignore"):
        return np.linalg.norm(p[:, :2] / p[:, 2:] - b, axis=1)
