"""Calibration of cameras from point pairs: correspondences, homography fits with trimming, and their errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.functions import geometry as G
from trailmesh.operators import ranks
from trailmesh.operators.lineage import computed_once

LEAST_POINTS = 4
#: Cameras with their matrices in a broadcast, at most (about 40 MB).
CAMERAS = 200_000


def correspondences(boxes: DataFrame, width: float, height: float, margin: float = 2.0, columns: int = 480, cell_m: float = 0.025, origin: tuple[float, float] = (-3.0, -9.0)) -> DataFrame:
    """cam, u, v, x, y of boxes(cam, x, y, w, h, position): foot points and the metres of their ground positions.

    Boxes that touch the frame's sides or bottom are cut, so their feet are not on the ground; they go.
    """
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    whole = (F.col("x") >= margin) & (right <= width - margin) & (bottom <= height - margin) & (F.col("h") > 0)
    place = lambda i, n: origin[i] + cell_m * n
    return boxes.filter(whole).select("cam", (F.col("x") + F.col("w") / 2).alias("u"), bottom.alias("v"), place(0, F.col("position") % columns).alias("x"), place(1, F.floor(F.col("position") / columns)).alias("y"))


def reprojection_error(matrix: str | Column | list[Column], u: Column, v: Column, x: Column, y: Column) -> Column:
    """Metres between the projected point and the true one; infinite where the projection vanishes. The matrix is an array or nine columns."""
    m = F.col(matrix) if isinstance(matrix, str) else matrix
    p = G.project(m if isinstance(m, list) else [F.element_at(m, i) for i in range(1, 10)], u, v)
    return F.coalesce(F.hypot(p["x"] - x, p["y"] - y), F.lit(float("inf")))


def _by_camera(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """rows with what is known of their cameras, a row each, computed before; few cameras are broadcast, so the rows stay where they are."""
    return rows.join(F.broadcast(cameras) if cameras.count() <= CAMERAS else cameras, "cam")


def _fit(points: DataFrame) -> DataFrame:
    """cam, n, matrix from points(cam, u, v, x, y, _w): the normalised direct linear transform, from sums over the points.

    Each camera's equations enter as 24 sums around its means; only they, not the points, are one row.
    """
    weighed = lambda c: F.sum(F.col("_w") * c) / F.sum("_w")
    mean = computed_once(points.groupBy("cam").agg(F.round(F.sum("_w")).cast("bigint").alias("n"), *[weighed(F.col(c)).alias(f"m{c}") for c in "uvxy"]))
    at = {c: F.col(c) - F.col(f"m{c}") for c in "uvxy"}
    base = [at["u"], at["v"], F.lit(1.0)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    weights = {"s": F.lit(1.0), "x": at["x"], "y": at["y"], "r": at["x"] * at["x"] + at["y"] * at["y"]}
    sums = [F.sum(F.col("_w") * w * base[i] * base[j]).alias(f"{k}{i}{j}") for k, w in weights.items() for i, j in pairs]
    spreads = [weighed(F.hypot(at[a], at[b])).alias(f"d{a}{b}") for a, b in ("uv", "xy")]
    rows = _by_camera(points, mean).groupBy("cam").agg(*sums, *spreads, *[F.max(c).alias(c) for c in ("n", "mu", "mv", "mx", "my")])
    # Points are scaled to a mean distance of the root of two; the sums, of products of so many of either side, are scaled for them.
    rows = rows.withColumns({s: F.when(F.col(d) > 1e-12, 2**0.5 / F.col(d)).otherwise(1.0) for d, s in (("duv", "suv"), ("dxy", "sxy"))})
    power = lambda k, i, j: F.pow("suv", F.lit((i < 2) + (j < 2))) * F.pow("sxy", F.lit({"s": 0, "x": 1, "y": 1, "r": 2}[k]))
    rows = rows.withColumns({f"{k}{i}{j}": F.col(f"{k}{i}{j}") * power(k, i, j) for k in weights for i, j in pairs})
    kind = dict(points.dtypes)["cam"]
    names = tuple(weights)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.to_dict("records"):
                part = {}
                for k in names:
                    part[k] = np.zeros((3, 3))
                    for i, j in pairs:
                        part[k][i, j] = part[k][j, i] = r[f"{k}{i}{j}"]
                zero = np.zeros((3, 3))
                whole = np.block([[part["s"], zero, -part["x"]], [zero, part["s"], -part["y"]], [-part["x"], -part["y"], part["r"]]])
                h = np.linalg.eigh(whole)[1][:, 0].reshape(3, 3)
                side = lambda s, a, b: np.array([[s, 0, -s * a], [0, s, -s * b], [0, 0, 1]])
                h = np.linalg.inv(side(r["sxy"], r["mx"], r["my"])) @ h @ side(r["suv"], r["mu"], r["mv"])
                good = r["n"] >= LEAST_POINTS and abs(h[2, 2]) >= 1e-9
                found.append((h / h[2, 2]).ravel().tolist() if good else None)
            yield pd.DataFrame({"cam": pdf["cam"], "n": pdf["n"], "matrix": found})

    return rows.mapInPandas(solve, f"cam {kind}, n bigint, matrix array<double>")


def fit_homographies(points: DataFrame, trim: float = 0.1, rounds: int = 2) -> DataFrame:
    """cam, matrix, n_points, n_input, rmse_m, median_m, p95_m of points(cam, u, v, x, y).

    After each fit the worst ``trim`` share of a camera's points goes, at least four stay, and it is fitted
    again. Cameras with fewer than four points, or points in one line, have a null matrix. Points of equal error go in any order.

    No point is moved or written: which of them stay is known from each fit and the last point that stays after it.
    The table of points is read some sixteen times.
    """
    if not 0 <= trim < 0.5:
        raise ValueError("trim is from 0 to below 0.5")
    points = points.select("cam", *[F.col(c).cast("double").alias(c) for c in "uvxy"]).filter("u IS NOT NULL AND v IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    kept, own = points.filter("cam IS NOT NULL").withColumn("_w", F.lit(1.0)), [F.col(c) for c in "uvxy"]
    fits = first = computed_once(_fit(kept))
    # Nine columns: code that looks each number up in an array is too long for the JVM to compile.
    good = lambda: fits.filter("matrix IS NOT NULL").select("cam", *[F.element_at("matrix", i).alias(f"_m{i}") for i in range(1, 10)])
    matrix = [F.col(f"_m{i}") for i in range(1, 10)]
    for _ in range(rounds if trim else 0):
        rows = _by_camera(kept, good()).withColumn("_e", F.when(F.col("_w").isNotNull(), reprojection_error(matrix, *own))).select("cam", *"uvxy", "_e", "_w")
        most = F.greatest(F.lit(LEAST_POINTS), F.bround(F.col("n") * (1.0 - trim), 0)).cast("bigint")
        cuts = computed_once(good().join(ranks.boundaries(rows, ["cam"], ["_e", *"uvxy"], "_w", 1.0 - trim, most), "cam"))
        rows = _by_camera(kept, cuts).withColumn("_at", F.struct(reprojection_error(matrix, *own).alias("_e"), *own))
        stays = F.when(F.col("_at") < F.col("last"), F.col("_w")).when(F.col("_at") == F.col("last"), F.col("_w") * F.col("part"))
        # Points that went have no weight. A filter would compute every error once more.
        kept = rows.withColumn("_w", stays).select("cam", *"uvxy", "_w")
        fits = computed_once(_fit(kept))
    rows = _by_camera(kept, good()).select("cam", "_w", F.when(F.col("_w").isNotNull(), reprojection_error(matrix, *own)).alias("_e"))
    rows = rows.select("cam", "_e", F.when(F.col("_e") < float("inf"), F.col("_w")).alias("_w")).withColumn("_e", F.when(F.col("_w").isNotNull(), F.col("_e")))
    marks = ranks.quantiles(rows, ["cam"], "_e", {"median_m": 0.5, "p95_m": 0.95}, weight="_w").drop("n")
    sums = rows.groupBy("cam").agg(F.sqrt(F.sum(F.col("_w") * F.col("_e") * F.col("_e")) / F.sum("_w")).alias("rmse_m"))
    sizes = first.select("cam", F.col("n").alias("n_input"))
    found = fits.select("cam", "matrix", F.when(F.col("matrix").isNotNull(), F.col("n")).alias("n_points"))
    return sizes.join(found, "cam", "left").join(sums, "cam", "left").join(marks, "cam", "left").select("cam", "matrix", F.coalesce("n_points", F.lit(0)).alias("n_points"), "n_input", "rmse_m", "median_m", "p95_m")


def projection_check(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row: p50_m, p95_m and pair_p95_m (p95 times the root of two) of all cameras' point errors together."""
    rows = points.join(cameras.select("cam", "matrix"), "cam").withColumn("_e", reprojection_error("matrix", *[F.col(c) for c in "uvxy"])).filter(F.col("_e") < float("inf"))
    return ranks.quantiles(rows, [], "_e", {"p50_m": 0.5, "p95_m": 0.95}).select("n", "p50_m", "p95_m", (F.col("p95_m") * 2**0.5).alias("pair_p95_m"))
