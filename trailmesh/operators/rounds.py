"""Frames to rounds: the open tracklets of a site and the data-driven windows that call the associator.

A frame is a row (site, seq, cam, ts, detections) with detections(local, confidence, clean,
entry, x, y, vec); ``seq`` is the order of arrival. Time is the latest ts seen, never a
clock. The first frame opens a window; the first frame at or after its end runs a round
and opens the next. A local id that comes back after more than ``idle_ms`` closes its old
tracklet, which runs an early round at once. A late detection joins its tracklet and can move
its start, never its end. A frame with a null ts closes everything of its site.

Decisions have a kind: ``first``, ``update``, ``close``, ``revised`` (the identity of an earlier
decision changed; the last row of a tracklet holds) or ``position`` (an owned tracklet
between rounds).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmesh.operators.association import Associator, Config, Decision
from trailmesh.operators.gallery import Tracklet

DETECTION = "struct<local: bigint, confidence: double, clean: boolean, entry: boolean, x: double, y: double, vec: array<double>>"
DECISIONS = "round_ms bigint, kind string, tid bigint, cam string, local bigint, start bigint, end bigint, n_frames bigint, gid bigint, cost double, reason string"


class RoundEngine:
    """The state of one site: open tracklets, the window, and the associator."""

    def __init__(self, config: Config, first_tid: int = 1, first_gid: int = 1) -> None:
        self.config, self.associator = config, Associator(config)
        self.associator.gallery.next_id = first_gid
        self.next_tid, self.now, self.window_end = first_tid, None, None
        self.open: dict[tuple[str, int], Tracklet] = {}
        #: When an owned tracklet last reported its position.
        self.reported: dict[int, int] = {}

    def feed(self, cam: str, ts: int | None, detections: list[dict]) -> Iterator[tuple]:
        if ts is None:
            yield from self.finish()
            return
        self.now = ts if self.now is None else max(self.now, ts)
        closed = [t for d in detections if (t := self._seen(cam, ts, d)) is not None]
        if self.window_end is None:
            self.window_end = ts + self.config.window_ms
        rows: list[tuple] = []
        if ts >= self.window_end:
            self.window_end = ts + self.config.window_ms
            rows = self._round(ts, closed)
        elif closed:
            rows = self._round(ts, closed)
        yield from rows
        if self.config.position_ms is not None:
            yield from self._positions(cam, ts, detections, {r[2] for r in rows})

    def finish(self) -> Iterator[tuple]:
        """Close all tracklets and run the last round."""
        if self.now is not None:
            yield from self._round(self.now, [t for t in list(self.open.values()) if self._close(t)])
            self.window_end = None

    def _seen(self, cam: str, ts: int, d: dict) -> Tracklet | None:
        """Add a detection; the tracklet that it closes, if its local id was given anew."""
        c, key, closed = self.config, (cam, int(d["local"])), None
        t = self.open.get(key)
        if t is not None and ts - t.end > c.idle_ms:
            closed, t = (t if self._close(t) else None), None
        if t is None:
            t = self.open[key] = Tracklet(self.next_tid, cam, key[1], ts, ts)
            self.next_tid += 1
        x, y = d["x"], d["y"]
        point = None if x is None or y is None or x != x or y != y else (float(x), float(y))
        vec = None if d["vec"] is None else np.asarray(d["vec"], float)
        t.add(ts, float(d["confidence"]), bool(d["clean"]), point, vec, bool(d["entry"]), c.max_vectors, c.max_points)
        t.updated = True
        return closed

    def _close(self, t: Tracklet) -> bool:
        """Whether it was long enough to count."""
        del self.open[t.cam, t.local]
        t.closed = True
        return t.n >= self.config.min_frames

    def _round(self, now: int, extra: list[Tracklet]) -> list[tuple]:
        ended = [t for t in list(self.open.values()) if now - t.end > self.config.idle_ms and self._close(t)]
        moved = [t for t in self.open.values() if t.updated and t.n >= self.config.min_frames]
        for t in self.open.values():
            t.updated = False
        order = lambda t: (t.end, t.cam, t.local, t.tid)
        rows = [*sorted(extra, key=order), *sorted(ended, key=order), *sorted(moved, key=order)]
        out = [self._row(now, self._kind(t, d), t, d) for t, d in zip(rows, self.associator.round(rows), strict=True)]
        self.associator.prune(now)
        for t in rows:
            if t.closed:
                self.reported.pop(t.tid, None)
        return sorted(out, key=lambda r: (r[6], r[2]))

    @staticmethod
    def _kind(t: Tracklet, d: Decision) -> str:
        return "revised" if d.reason == "revised" else "first" if not d.is_update else "close" if t.closed else "update"

    @staticmethod
    def _row(now: int, kind: str, t: Tracklet, d: Decision) -> tuple:
        return now, kind, t.tid, t.cam, t.local, t.start, t.end, t.n, d.gid, d.cost, d.reason

    def _positions(self, cam: str, ts: int, detections: list[dict], done: set[int]) -> Iterator[tuple]:
        """Owned tracklets of this frame that no round has just reported; only reads the gallery."""
        for t in self.open.values():
            if t.tid in done:
                self.reported[t.tid] = ts
        for d in detections:
            t = self.open.get((cam, int(d["local"])))
            if t is None or t.tid in done or (k := self.associator.gallery.owner_of(t)) is None:
                continue
            if t.tid not in self.reported or ts - self.reported[t.tid] >= self.config.position_ms:
                self.reported[t.tid] = ts
                done.add(t.tid)
                yield self._row(ts, "position", t, Decision(k.gid, 0.0, "", is_update=True))


def frames_of(detections: DataFrame, keys: list[str], seq: Column, **columns: Column) -> DataFrame:
    """Frames (site, seq, cam, ts, detections) of a table of detections, one row per value of ``keys`` (site, cam, ts).

    ``columns`` give local, confidence, clean, entry, x, y and vec; missing ones count as 1, true, false or null.
    A frame's detections are one array: as many as are in view, whatever the table's size.
    """
    plain = {"confidence": F.lit(1.0), "clean": F.lit(True), "entry": F.lit(False), "x": F.lit(None), "y": F.lit(None), "vec": F.lit(None)}
    names = ("local", "confidence", "clean", "entry", "x", "y", "vec")
    one = F.struct(*[(columns.get(n, plain.get(n))).alias(n) for n in names]).cast(DETECTION)
    site, cam, ts = (F.col(k).alias(n) for k, n in zip(keys, ("site", "cam", "ts"), strict=True))
    return detections.groupBy(site, cam, ts).agg(F.min(seq).alias("seq"), F.sort_array(F.collect_list(one)).alias("detections"))


def associate_frames(frames: DataFrame, config: Config, first_ids: DataFrame | None = None) -> DataFrame:
    """All decisions of frames(site, seq, cam, ts, detections), with the site; every site ends with a flush.

    A task walks the sorted frames of its sites and holds the open tracklets and identities
    of one. ``first_ids`` (site, tid, gid) gives the numbers to go on from after a restart.
    """
    kinds = dict(frames.dtypes)
    rows = frames.select("site", "seq", "cam", "ts", "detections")
    if first_ids is None:
        rows = rows.withColumns({"tid": F.lit(1).cast("bigint"), "gid": F.lit(1).cast("bigint")})
    else:
        rows = rows.join(first_ids.select("site", "tid", "gid"), "site", "left").fillna(1, ["tid", "gid"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, engine, out = None, None, []

        def table() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["site", *[c.split()[0] for c in DECISIONS.split(", ")]]).astype({"cost": float})

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if engine is None or r.site != site:
                    if engine is not None:
                        out += [(site, *d) for d in engine.finish()]
                    site, engine = r.site, RoundEngine(config, int(r.tid), int(r.gid))
                out += [(site, *d) for d in engine.feed(r.cam, None if pd.isna(r.ts) else int(r.ts), list(r.detections) if r.detections is not None else [])]
                if len(out) >= 10_000:
                    yield table()
                    out = []
        if engine is not None:
            out += [(site, *d) for d in engine.finish()]
            yield table()

    # The walk takes far longer than its few bytes suggest, so small partitions are not put together.
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "site").sortWithinPartitions("site", "seq").mapInPandas(run, f"site {kinds['site']}, {DECISIONS}")


def next_ids(decisions: DataFrame) -> DataFrame:
    """(site, tid, gid) that a restarted engine goes on from: the first numbers no decision has used."""
    return decisions.groupBy("site").agg((F.max("tid") + 1).alias("tid"), (F.max("gid") + 1).alias("gid"))


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The row of each tracklet that holds: the last one of its rounds."""
    return decisions.filter("kind <> 'position'").groupBy("site", "tid").agg(F.max_by(F.struct("gid", "cam", "local", "start", "end", "n_frames", "round_ms"), F.struct("round_ms", "n_frames")).alias("d")).select("site", "tid", "d.*")
