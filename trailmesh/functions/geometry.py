"""Plane geometry expressions: boxes, foot points and homographies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def foot_point(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x + w / 2).alias("x"), (y + h).alias("y"))


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shared area of two (x, y, w, h) boxes."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i] + a[i + 2], b[i] + b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    both = intersection(a, b)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def project(m: list[float], u: Column, v: Column) -> Column:
    """Point under a row-major 3 x 3 homography; null where the scale vanishes."""
    d = m[6] * u + m[7] * v + m[8]
    return F.when(F.abs(d) >= 1e-9, F.struct(((m[0] * u + m[1] * v + m[2]) / d).alias("x"), ((m[3] * u + m[4] * v + m[5]) / d).alias("y")))


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Normalised direct linear transform of at least four point pairs."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(0)
        s = np.sqrt(2) / max(np.linalg.norm(p - c, axis=1).mean(), 1e-12)
        t = np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])
        return (p - c) * s, t

    if len(src) < 4:
        raise ValueError("a homography needs four point pairs")
    (a, ta), (b, tb) = normal(np.asarray(src, float)), normal(np.asarray(dst, float))
    one, zero = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    rows = np.vstack([np.hstack([p, zero, -b[:, :1] * p]), np.hstack([zero, p, -b[:, 1:] * p])])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2]
