"""Exact quantiles and row numbers of few and large groups, without a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmesh.operators.lineage import computed_once

#: Numbers in a broadcast table of brackets, at most (32 MB).
BROADCAST = 1 << 22


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _bracketed(df: DataFrame, keys: list[str], value: str, bounds: list[float], accuracy: int) -> tuple[DataFrame, bool]:
    """df with ``_part``, the number of its group's approximate quantiles below the value, and whether the groups are few.

    Approximate quantiles depend on the order in which rows and parts of them arrive, and rows are placed by
    them more than once, so they are computed once. Few groups are broadcast.
    """
    near = computed_once(df.groupBy(*keys).agg(F.percentile_approx(value, bounds, accuracy).alias("_b")).filter("_b IS NOT NULL"))
    few = near.count() * len(bounds) <= BROADCAST
    side = F.broadcast(near) if few else near
    part = F.size(F.filter("_b", lambda c: c < F.col(value)))
    return df.alias("d").join(side.alias("k"), _same(keys, "d", "k")).select("d.*", "_b").withColumn("_part", part).drop("_b"), few


def _held(placed: DataFrame, few: bool, keys: list[str], values: list[str], weight: str, kept: Callable[[Column], Column]) -> DataFrame:
    """keys, n, values, _c and _upto of the brackets in which ``kept`` finds a place: rows of these values, and rows up to them in their group.

    Weights of rows of equal values add up to whole numbers.
    """
    rows = F.round(F.sum(weight)).cast("bigint").alias("_c")
    # As many rows as groups and brackets.
    sizes = placed.groupBy(*keys, "_part").agg(rows).withColumn("n", F.sum("_c").over(W.partitionBy(*keys)))
    sizes = sizes.withColumn("_before", F.sum("_c").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_c"))
    wanted = sizes.filter(kept(lambda place: (place >= F.col("_before")) & (place < F.col("_before") + F.col("_c")))).drop("_c")
    by = [*keys, "_part"]
    held = placed.alias("p").join((F.broadcast(wanted) if few else wanted).alias("w"), _same(by, "p", "w")).select("p.*", "n", "_before")
    held = held.groupBy(*by, *values, "n", "_before").agg(rows)
    return held.withColumn("_upto", F.col("_before") + F.sum("_c").over(W.partitionBy(*by).orderBy(*values).rowsBetween(W.unboundedPreceding, 0)))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], how: str = "linear", accuracy: int = 1000, weight: str | None = None) -> DataFrame:
    """keys, n and one column per name of ``qs``: exact quantiles of the non-null values of each group.

    ``linear`` interpolates at rank q (n - 1) from 0, ``nearest`` takes rank ceil(q n) from 1. A first pass
    brackets each quantile by approximate ones and a second counts the values between all brackets, so it is known
    between which of them each rank lies, however good they are; those, about 4 / accuracy of all, are sorted.
    A row counts ``weight`` times, with a null value or weight not at all (both are null then); weights of rows of one value add up to a whole number.
    """
    if how not in ("linear", "nearest"):
        raise ValueError(f"how is linear or nearest, not {how!r}")
    slack = 2.0 / accuracy
    if weight is None:
        df = df.filter(F.col(value).isNotNull())
    v = df.select(*keys, F.col(value).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).alias("_w"))
    bounds = sorted({b for q in qs.values() for b in (max(0.0, q - slack), min(1.0, q + slack))})
    rank = lambda q: q * (F.col("n") - 1) if how == "linear" else F.ceil(q * F.col("n")).cast("double") - 1
    kept = lambda holds: reduce(or_, [holds(side(rank(q))) for q in qs.values() for side in (F.floor, F.ceil)])
    held = _held(*_bracketed(v, keys, "_v", bounds, accuracy), keys, ["_v"], "_w", kept)
    out = []
    for name, q in qs.items():
        low, high = (F.min(F.when(F.col("_upto") > side(rank(q)), F.col("_v"))) for side in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(rank(q) - F.floor(rank(q)))).alias(name))
    found = held.groupBy(*keys).agg(F.max("n").alias("n"), *out)
    return (found if keys else found.filter("n > 0")).select(*keys, "n", *qs)


def boundaries(df: DataFrame, keys: list[str], values: list[str], weight: str, share: float, most: Column, accuracy: int = 1000) -> DataFrame:
    """keys, last and part of each group: of its rows by ``values`` the first ``most`` (by its number of rows n, about ``share`` of it).

    ``last`` is the struct of the values of the last of them; rows of these very values count with the weight ``part`` times their own.
    """
    slack = 2.0 / accuracy
    placed = _bracketed(df, keys, values[0], [max(0.0, share - slack), min(1.0, share + slack)], accuracy)
    held = _held(*placed, keys, values, weight, lambda holds: holds(most - 1)).withColumn("_left", most - F.col("_upto") + F.col("_c"))
    return held.filter("_left > 0 AND _left <= _c").select(*keys, F.struct(*values).alias("last"), (F.col("_left") / F.col("_c")).alias("part"))


def numbered(df: DataFrame, keys: list[str], value: str, ties: list[str], name: str = "number", parts: int = 64) -> DataFrame:
    """Add the row number from 1 of each row in its group, in order of a numeric ``value`` and then ``ties``.

    Groups are cut into ranges of the value, each range is numbered alone, and the sizes of the ranges before it are added.
    """
    rows, _ = _bracketed(df, keys, value, [k / parts for k in range(1, parts)], 10 * parts)
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    # As many rows as ranges.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    own = rows.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(value, *ties)))
    both = own.alias("o").join(before.alias("b"), _same([*keys, "_part"], "o", "b"))
    return both.select("o.*", (F.col("_own") + F.col("_before")).cast("bigint").alias(name)).drop("_own", "_part")
