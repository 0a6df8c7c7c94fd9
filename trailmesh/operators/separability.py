"""How well appearance tells people apart: nearest neighbours of tracklets by camera relation, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tracklets of a block; two blocks meet as one matrix product.
BLOCK = 512


def nearest(tracklets: DataFrame, session: str = "session", block: int = BLOCK) -> DataFrame:
    """For each tracklet and mode, the gallery's counts and distances: session, tid, mode, n_right, n_wrong, right, wrong.

    tracklets(session, tid, cam, person, start, end, vec), unit vectors. Mode ``cross`` takes
    the tracklets of other cameras, ``same_camera`` those of the same camera at other times. A
    session is cut into blocks by a hash; every pair of blocks is one matrix product in a task, from which only
    counts and least distances leave, so no session is one group.
    """
    n = tracklets.groupBy(session).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    rows = tracklets.select(session, "tid", "cam", "person", "start", "end", "vec").join(n, session)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("tid"), F.col("_blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    # As a query a row meets all blocks, as a gallery row it is met by all.
    q = rows.withColumn("_g", F.explode(others)).select(session, F.col("_own").alias("_q"), "_g", F.lit(True).alias("_query"), "tid", "cam", "person", "start", "end", "vec")
    g = rows.withColumn("_q", F.explode(others)).select(session, "_q", F.col("_own").alias("_g"), F.lit(False).alias("_query"), "tid", "cam", "person", "start", "end", "vec")
    kinds = dict(tracklets.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, held = pdf[pdf["_query"]], pdf[~pdf["_query"]]
        out = []
        if len(asked) and len(held):
            far = 1 - np.stack(asked["vec"]) @ np.stack(held["vec"]).T
            column = lambda c: (asked[c].to_numpy()[:, None], held[c].to_numpy()[None, :])
            (cq, cg), (pq, pg), (tq, tg), (sq, sg), (eq, eg) = (column(c) for c in ("cam", "person", "tid", "start", "end"))
            for mode, gallery in (("cross", cq != cg), ("same_camera", (cq == cg) & (tq != tg) & ((eg < sq) | (sg > eq)))):
                right, wrong = gallery & (pq == pg), gallery & (pq != pg)
                least = lambda m: np.where(m, far, np.inf).min(1)
                out.append(pd.DataFrame({session: asked[session], "tid": asked["tid"], "mode": mode, "n_right": right.sum(1), "n_wrong": wrong.sum(1), "right": least(right), "wrong": least(wrong)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[session, "tid", "mode", "n_right", "n_wrong", "right", "wrong"])

    part = q.unionByName(g).groupBy(session, "_q", "_g").applyInPandas(run, f"{session} {kinds[session]}, tid {kinds['tid']}, mode string, n_right bigint, n_wrong bigint, right double, wrong double")
    return part.groupBy(session, "tid", "mode").agg(F.sum("n_right").alias("n_right"), F.sum("n_wrong").alias("n_wrong"), F.min("right").alias("right"), F.min("wrong").alias("wrong"))


def rank_one(found: DataFrame, limit: float, keys: tuple[str, ...] = ("mode",)) -> DataFrame:
    """keys, n, rank1, chance, hard, right_below, wrong_below over the tracklets that have a right one in their gallery.

    ``hard`` is the share, among those with a wrong one too, whose nearest is wrong; the last two are the
    shares whose nearest right or wrong one is closer than ``limit``.
    """
    f = found.filter("n_right > 0")
    share = lambda c: F.avg(c.cast("double"))
    return f.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.col("right") <= F.col("wrong")).alias("rank1"), F.avg(F.col("n_right") / (F.col("n_right") + F.col("n_wrong"))).alias("chance"),
        share(F.when(F.col("n_wrong") > 0, F.col("wrong") < F.col("right"))).alias("hard"), share(F.col("right") < limit).alias("right_below"), share(F.when(F.col("n_wrong") > 0, F.col("wrong") < limit)).alias("wrong_below"),
    )


def early_vectors(frames: DataFrame, keys: list[str], order: str, firsts: tuple[int, ...], top_k: int = 10) -> DataFrame:
    """Per track (keys) and number of first frames: ``first_n`` and the unit mean of the ``top_k`` most confident vectors among them.

    frames(keys, order, confidence, vec). A track's frames are one array.
    """
    one = F.struct(F.col(order).alias("o"), F.col("confidence").alias("c"), F.col("vec").alias("v"))
    t = frames.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_f")).withColumn("first_n", F.explode(F.array(*[F.lit(n) for n in firsts])))
    # Equal confidences keep their order.
    ranked = F.slice(F.sort_array(F.transform(F.slice("_f", F.lit(1), F.col("first_n")), lambda f: F.struct((-f["c"]).alias("c"), f["o"].alias("o"), f["v"].alias("v")))), 1, top_k)
    t = t.withColumn("_best", ranked)
    total = F.aggregate(F.slice("_best", 2, 1 << 30), F.element_at("_best", 1)["v"].cast("array<double>"), lambda s, b: F.zip_with(s, b["v"], lambda x, y: x + y))
    t = t.withColumn("_sum", total)
    norm = F.sqrt(F.aggregate("_sum", F.lit(0.0), lambda s, x: s + x * x))
    return t.withColumn("_norm", norm).select(*keys, "first_n", F.transform("_sum", lambda x: x / F.col("_norm")).alias("vec"))
