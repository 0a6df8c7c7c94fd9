"""Ground-plane evidence: distances, learned corrections, exit directions, entry zones, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ground_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def giou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Generalised overlap of two (x, y, w, h) boxes: overlap less the empty share of their hull."""
    reach = lambda i: F.least(a[i] + a[i + 2], b[i] + b[i + 2]) - F.greatest(a[i], b[i])
    span = lambda i: F.greatest(a[i] + a[i + 2], b[i] + b[i + 2]) - F.least(a[i], b[i])
    both = F.greatest(F.lit(0.0), reach(0)) * F.greatest(F.lit(0.0), reach(1))
    union, hull = a[2] * a[3] + b[2] * b[3] - both, span(0) * span(1)
    return both / union - (hull - union) / hull


def corrected_distances(points: DataFrame, models: DataFrame, cells: DataFrame) -> DataFrame:
    """Add ``corrected``: the distance of two cameras' points less their learned offset, in units of the reference spread.

    points(cam_a, ax, ay, cam_b, bx, by, ...); models(cam_1, cam_2, cell_m, sigma_ref, mu_x,
    mu_y, sigma) with cam_1 <= cam_2; cells(cam_1, cam_2, ix, iy, cell_mu_x, cell_mu_y,
    cell_sigma). A cell without a row takes the pair's defaults, an unknown pair gets null.
    """
    swap = F.col("cam_a") > F.col("cam_b")
    pick = lambda one, two: F.when(swap, F.col(two)).otherwise(F.col(one))
    p = points.withColumns({"cam_1": pick("cam_a", "cam_b"), "cam_2": pick("cam_b", "cam_a")}).join(models, ["cam_1", "cam_2"], "left")
    dx, dy = pick("bx", "ax") - pick("ax", "bx"), pick("by", "ay") - pick("ay", "by")
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / F.col("cell_m"))
    p = p.withColumns({"ix": cell("ax", "bx"), "iy": cell("ay", "by")}).join(cells, ["cam_1", "cam_2", "ix", "iy"], "left")
    mu = [F.coalesce(F.col(f"cell_mu_{c}"), F.col(f"mu_{c}")) for c in "xy"]
    far = F.hypot(dx - mu[0], dy - mu[1]) * F.col("sigma_ref") / F.coalesce(F.col("cell_sigma"), F.col("sigma"))
    return p.withColumn("corrected", far).select(*points.columns, "corrected")


def exit_velocity(paths: DataFrame, keys: list[str], ts: str, x: str, y: str, window_ms: int) -> DataFrame:
    """keys, vx, vy in units a second over the last ``window_ms`` of each path, by least squares.

    Paths with fewer than four points there, or that cover less than half the window, give
    no row. Both passes combine in the tasks, so a long path is no hot group.
    """
    last = paths.groupBy(*keys).agg(F.max(ts).alias("_last"))
    tail = paths.join(last, keys).filter(F.col(ts) >= F.col("_last") - window_ms)
    t = (F.col(ts) - F.col("_last")) / 1000
    fit = tail.groupBy(*keys).agg(
        F.regr_slope(F.col(x), t).alias("vx"), F.regr_slope(F.col(y), t).alias("vy"), F.count("*").alias("_n"), (F.max(ts) - F.min(ts)).alias("_span")
    )
    return fit.filter((F.col("_n") >= 4) & (F.col("_span") >= window_ms / 2)).drop("_n", "_span")


def exit_contradictions(candidates: DataFrame, directions: DataFrame, min_speed: float, min_cos: float) -> DataFrame:
    """Add ``cos``: set where candidates(src, dst, vx, vy) moved clearly against directions(src, dst, dx, dy), else null."""
    speed = F.hypot("vx", "vy")
    cos = (F.col("vx") * F.col("dx") + F.col("vy") * F.col("dy")) / speed
    out = candidates.join(directions, ["src", "dst"], "left")
    return out.withColumn("cos", F.when((speed >= min_speed) & (speed > 0) & (cos < min_cos), cos)).drop("dx", "dy")


def entry_flags(starts: DataFrame, grids: DataFrame, sizes: DataFrame, min_p: float, min_n: int) -> DataFrame:
    """Add ``is_entry``: whether a box of starts(cam, x, y, w, h) stands in a cell where tracks begin.

    grids(cam, row, col, p_entry, n); sizes(cam, frame_w, frame_h, rows, cols). Feet outside
    the frame fall in its outermost cells; cameras without a grid have no entries.
    """
    cell = lambda v, size, n: F.floor(F.greatest(F.lit(0.0), F.least(v / F.col(size) * F.col(n), F.col(n) - 1))).cast("int")
    s = starts.join(sizes, "cam", "left").withColumns({"col": cell(F.col("x") + F.col("w") / 2, "frame_w", "cols"), "row": cell(F.col("y") + F.col("h"), "frame_h", "rows")})
    s = s.join(grids, ["cam", "row", "col"], "left")
    return s.withColumn("is_entry", F.coalesce((F.col("n") >= min_n) & (F.col("p_entry") >= min_p), F.lit(False))).select(*starts.columns, "is_entry")


def ground_nms(points: DataFrame, keys: list[str], gid: str, x: str, y: str, support: str, radius: float) -> DataFrame:
    """Points that remain of each frame (keys): by support, then the smaller gid; those within ``radius`` of a kept one go.

    A frame's points are one array: as many as identities in view, whatever the table's size.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col(support)).alias("s"), F.col(gid).alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))))
    far = lambda kept, p: F.forall(kept, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) > radius)
    framed = points.groupBy(*keys).agg(order.alias("_p"))
    kept = F.aggregate("_p", F.filter("_p", lambda p: F.lit(False)), lambda k, p: F.when(far(k, p), F.concat(k, F.array(p))).otherwise(k))
    out = framed.select(*keys, F.explode(kept).alias("_k"))
    return out.select(*keys, F.col("_k.g").alias(gid), F.col("_k.x").alias(x), F.col("_k.y").alias(y), (-F.col("_k.s")).alias(support))


def sane_embedding(v: Column, dim: int) -> Column:
    """The vector, or null unless it has ``dim`` finite components."""
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.when((F.size(v) == dim) & (F.lit(dim) > 0) & finite, v)


def decimated(path: Column, cap: int) -> Column:
    """A path buffer filled in order: beyond ``cap`` entries, every other one goes, the first stays."""
    empty = F.filter(path, lambda p: F.lit(False))
    add = lambda kept, p: F.concat(kept, F.array(p))
    return F.aggregate(path, empty, lambda k, p: F.when(F.size(k) + 1 > cap, F.filter(add(k, p), lambda q, i: i % 2 == 0)).otherwise(add(k, p)))
