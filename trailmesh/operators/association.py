"""Association of tracklets with identities under space, time and similarity limits.

The engine is sequential within a site (an identity's gallery depends on the rounds
before), and parallel over sites: one run of sorted rows or one state key each. ``Associator`` holds
the rules of a round; ``operators.rounds`` cuts a stream of frames into rounds, and the
batch and the streaming operator run the same classes. Distances are between ground points in metres,
projected before (``functions.geometry.project``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trailmesh.operators.assign import hungarian
from trailmesh.operators.gallery import Gallery, Identity, Path, Tracklet


@dataclass
class Config:
    max_cost: float = 0.5
    window_ms: int = 1000
    slack_ms: int = 0
    ttl_ms: int = 120_000
    ema: float = 0.3
    min_frames: int = 1
    #: (source, target) -> (least, most) milliseconds; pairs in overlaps need no transit.
    transitions: dict[tuple[str, str], tuple[int, int]] = field(default_factory=dict)
    overlaps: set[tuple[str, str]] = field(default_factory=set)
    unknown_pairs: bool = True
    #: A tracklet that a round has seen is open until it is silent for longer.
    idle_ms: int = 2000
    #: Similarity to the best appearance ("max") or to their running mean ("centroid").
    similarity: str = "max"
    gallery_size: int = 32
    top_k: int = 8
    max_vectors: int = 32
    max_points: int = 64
    #: A decision on fewer frames is taken once more when there are as many, or at the tracklet's end.
    revise_after: int | None = None
    #: Owned tracklets report their position as frames come, at most so often.
    position_ms: int | None = None
    #: Ground evidence: cost a metre, and the metres that two views, or a walk at this speed, may be apart.
    ground_weight: float = 0.4
    max_ground_m: float = 1.0
    max_speed_m_s: float = 2.0
    ground_tol_ms: int = 60
    reject_without_common_time: bool = False
    same_camera: bool = True
    #: Pairs with ground evidence may cost up to this instead of ``max_cost``; evidence over a gap expires.
    max_cost_ground: float | None = None
    evidence_gap_ms: int | None = None
    #: A same-camera link over a longer gap loses its evidence where another candidate would do.
    contested_gap_ms: int | None = None
    #: Pairs that are late for their transit are let in below this cost.
    overdue_cost: float | None = None
    #: (source, target) -> unit vector of those who leave for target, the window of the velocity, least speed, least cosine.
    directions: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    direction_rule: tuple[int, float, float] = (1000, 0.5, 0.0)
    #: Sorted camera pair -> dict(cell_m, sigma_ref, default=(mu_x, mu_y, sigma), cells={(ix, iy): (mu_x, mu_y, sigma)}).
    ground_errors: dict[tuple[str, str], dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.similarity not in ("max", "centroid"):
            raise ValueError(f"similarity is 'max' or 'centroid', not {self.similarity!r}")
        if not 0 < self.max_cost <= 2 or self.max_ground_m <= 0 or self.max_speed_m_s <= 0 or min(self.ground_weight, self.ground_tol_ms) < 0:
            raise ValueError("costs, distances and speeds are positive, and max_cost is at most 2")

    def overlapping(self, a: str, b: str) -> bool:
        return (a, b) in self.overlaps or (b, a) in self.overlaps


class Decision(NamedTuple):
    gid: int
    cost: float | None
    reason: str
    is_new: bool = False
    is_update: bool = False


def transit_ok(c: Config, src: str, dst: str, elapsed: int) -> bool:
    """Whether a person can be at dst ``elapsed`` ms after src."""
    if src == dst:
        return True
    limits = c.transitions.get((src, dst))
    if c.overlapping(src, dst):
        return limits is None or abs(elapsed) <= limits[1]
    return c.unknown_pairs if limits is None else limits[0] <= elapsed <= limits[1]


def exit_speed(path: Path, window_ms: int) -> tuple[float, float] | None:
    """Metres a second over the end of a path, by least squares; None on fewer than four points or half the window."""
    tail = np.array([p for p in path if p[0] >= path[-1][0] - window_ms], float)
    if len(tail) < 4 or tail[-1, 0] - tail[0, 0] < window_ms / 2:
        return None
    t = (tail[:, 0] - tail[:, 0].mean()) / 1000
    return tuple((t @ (tail[:, i] - tail[:, i].mean())) / (t @ t) for i in (1, 2))


def common_distance(a: Path, b: Path, tol_ms: int, error: dict | None = None, swapped: bool = False) -> float | None:
    """Median distance of a's points from b's nearest in time, over those within the tolerance; the earlier of a tie."""
    if not a or not b or a[0][0] > b[-1][0] + tol_ms or b[0][0] > a[-1][0] + tol_ms:
        return None
    x, y = np.array(a, float), np.array(b, float)
    at = np.searchsorted(y[:, 0], x[:, 0])
    left, right = np.maximum(at - 1, 0), np.minimum(at, len(y) - 1)
    near = np.where(np.abs(y[left, 0] - x[:, 0]) <= np.abs(y[right, 0] - x[:, 0]), left, right)
    hit = np.abs(y[near, 0] - x[:, 0]) <= tol_ms
    if not hit.any():
        return None
    p, q = x[hit, 1:], y[near[hit], 1:]
    if error is None:
        return float(np.median(np.hypot(*(p - q).T)))
    p, q = (q, p) if swapped else (p, q)
    cells = np.floor((p + q) / 2 / error["cell_m"]).astype(int)
    mu_sigma = np.array([error["cells"].get(tuple(c), error["default"]) for c in cells.tolist()])
    return float(np.median(np.hypot(*(p - q - mu_sigma[:, :2]).T) * error["sigma_ref"] / mu_sigma[:, 2]))


class Pair(NamedTuple):
    """Cost of a tracklet and an identity, infinite with the rule that forbids it; ground evidence, and the gap of a same-camera link."""

    cost: float
    rule: str = ""
    measured: bool = False
    gap: float | None = None


class Associator:
    def __init__(self, config: Config) -> None:
        self.config = config
        self.gallery = Gallery(config.gallery_size, config.ema, config.ttl_ms, config.top_k)

    @property
    def tracks(self) -> list[Identity]:
        return self.gallery.tracks()

    def pair(self, t: Tracklet, k: Identity, similarity: float | None) -> Pair:
        """The rules in order, then appearance and ground distance. ``similarity`` is None where a side has no vector."""
        c, gap = self.config, t.start - k.last_seen
        if k.owned.get(t.cam) == t.tid:
            return Pair(0.0)
        if k.busy(t.cam, t.start, t.end, c.slack_ms, t.tid):
            return Pair(np.inf, "overlap")
        if not t.best:
            return Pair(np.inf, "no_vector")
        overdue = False
        if not transit_ok(c, k.last_cam, t.cam, gap):
            limits = c.transitions.get((k.last_cam, t.cam))
            overdue = c.overdue_cost is not None and limits is not None and not c.overlapping(k.last_cam, t.cam) and gap > limits[1]
            if not overdue:
                return Pair(np.inf, "transit")
        way = c.directions.get((k.last_cam, t.cam)) if k.last_cam != t.cam else None
        if way is not None and (v := exit_speed(k.path(k.last_cam), c.direction_rule[0]) if k.path(k.last_cam) else None):
            speed = float(np.hypot(*v))
            if speed >= max(c.direction_rule[1], 1e-12) and (v[0] * way[0] + v[1] * way[1]) / speed < c.direction_rule[2]:
                return Pair(np.inf, "direction")
        if similarity is None:
            return Pair(np.inf, "no_vector")
        cost, measured, link = 1.0 - similarity, False, None
        own = tuple(sorted(t.path))
        for term in (self._same_camera(own, t, k) if c.same_camera else None, self._ground(own, t, k) if c.overlaps else None):
            if term is None:
                continue
            metres, far, evidence, over = term
            if far:
                return Pair(np.inf, far)
            cost += c.ground_weight * metres
            if evidence:
                measured, link = True, over
        if overdue:
            return Pair(np.inf, "transit") if cost >= c.overdue_cost else Pair(cost)
        return Pair(cost, "", measured, link)

    def _counts(self, gap: float) -> bool:
        return self.config.evidence_gap_ms is None or gap <= self.config.evidence_gap_ms

    def _walk(self, metres: float, gap: float, link: float | None) -> tuple[float, str, bool, float | None]:
        """Metres that count, unless they are more than a walk of this time allows."""
        c = self.config
        far = "distance" if metres > c.max_ground_m + c.max_speed_m_s * gap / 1000 else ""
        return min(metres, c.max_ground_m), far, self._counts(gap), link

    def _same_camera(self, own: Path, t: Tracklet, k: Identity) -> tuple | None:
        other = k.path(t.cam)
        if not own or not other:
            return None
        for a, b in ((other[-1], own[0]), (own[-1], other[0])):
            if a[0] <= b[0]:
                return self._walk(float(np.hypot(a[1] - b[1], a[2] - b[2])), float(b[0] - a[0]), float(b[0] - a[0]))
        return None

    def _ground(self, own: Path, t: Tracklet, k: Identity) -> tuple | None:
        c = self.config
        cams = [cam for cam in k.owned if cam != t.cam and k.path(cam) and c.overlapping(cam, t.cam)]
        found = [common_distance(own, k.path(cam), c.ground_tol_ms, c.ground_errors.get(tuple(sorted((cam, t.cam)))), t.cam > cam) for cam in cams]
        found = [d for d in found if d is not None]
        if found:
            return min(found), "distance" if min(found) > c.max_ground_m else "", True, None
        here = [cam for cam in cams if cam == k.last_cam or k.busy(cam, t.start, t.end, c.ground_tol_ms)]
        if here and own and c.reject_without_common_time:
            return 0.0, "no_common_time", False, None
        last = k.path(k.last_cam)
        if not own or not last or not c.overlapping(k.last_cam, t.cam):
            return None
        return self._walk(float(np.hypot(last[-1][1] - own[0][1], last[-1][2] - own[0][2])), abs(t.start - k.last_seen), None)

    def costs(self, rows: list[Tracklet], tracks: list[Identity]) -> tuple[np.ndarray, np.ndarray]:
        """Costs and limits of all pairs; similarities of all of them are one matrix product.

        Ground distance only adds to a cost, so pairs too unlike for any limit are left infinite.
        """
        c = self.config
        cost, limit = np.empty((len(rows), len(tracks))), np.empty((len(rows), len(tracks)))
        cost.fill(np.inf)
        limit.fill(c.max_cost)
        near = self.similarities(rows, tracks)
        most = max(c.max_cost, c.max_cost_ground or 0.0)
        alike: list[list[int]] = [[] for _ in rows]
        for i, j in zip(*(a.tolist() for a in (1 - near < most).nonzero()), strict=True):
            alike[i].append(j)
        for i, t in enumerate(rows):
            found = {j: self.pair(t, tracks[j], float(near[i, j])) for j in alike[i]}
            for j, p in found.items():
                cost[i, j] = p.cost
            if c.max_cost_ground is None:
                continue
            for j, p in found.items():
                if p.measured and not (p.gap is not None and t.entry):  # arrivals are nobody's continuation
                    limit[i, j] = c.max_cost_ground
            rivals = any(p.gap is None and p.cost < limit[i, j] for j, p in found.items())
            for j, p in found.items():
                if rivals and c.contested_gap_ms is not None and p.gap is not None and p.gap > c.contested_gap_ms:
                    limit[i, j] = c.max_cost
        return cost, limit

    def likenesses(self, t: Tracklet, tracks: list[Identity]) -> list[float]:
        """The ``similarities`` of one tracklet."""
        q = t.query(self.config.top_k)
        if q is None or not tracks or self.config.similarity == "centroid" or not all(k.appearances for k in tracks):
            return self.similarities([t], tracks)[0].tolist()
        held = [k.vectors() for k in tracks]
        starts = [0, *accumulate(map(len, held[:-1]))]
        return np.maximum.reduceat((q[None] @ np.concatenate(held).T)[0], starts).tolist()

    def within(self, t: Tracklet, tracks: list[Identity], near: list[float]) -> dict[int, float]:
        """Costs of one tracklet under ``max_cost``, by place; the ``costs`` of configurations without a limit of its own for ground evidence."""
        most, out = self.config.max_cost, {}
        for j, s in enumerate(near):
            if 1 - s < most and (cost := self.pair(t, tracks[j], s).cost) < most:
                out[j] = cost
        return out

    def feasible(self, t: Tracklet, tracks: list[Identity]) -> bool:
        """Whether the rules leave any identity, however unlike."""
        return any(self.pair(t, k, None if s != s else s).cost < np.inf for k, s in zip(tracks, self.likenesses(t, tracks), strict=True))

    def similarities(self, rows: list[Tracklet], tracks: list[Identity]) -> np.ndarray:
        """Cosine of each tracklet to the best appearance, or the centroid, of each identity; NaN without a vector."""
        queries = [(i, q) for i, t in enumerate(rows) if (q := t.query(self.config.top_k)) is not None]
        central = self.config.similarity == "centroid"
        cols = [j for j, k in enumerate(tracks) if (k.centroid is not None if central else k.appearances)]
        if queries and cols:
            held = [tracks[j].centroid[None] if central else tracks[j].vectors() for j in cols]
            asked = np.array([q for _, q in queries])
            near = np.maximum.reduceat(asked @ np.concatenate(held).T, [0, *accumulate(map(len, held[:-1]))], axis=1)
            if near.shape == (len(rows), len(tracks)):
                return near
        out = np.full((len(rows), len(tracks)), np.nan)
        if queries and cols:
            out[np.ix_([i for i, _ in queries], cols)] = near
        return out

    def round(self, tracklets: Iterable[Tracklet | dict]) -> list[Decision]:
        """The decision of each tracklet of one round: known ones are updated or revised, then new ones are matched by camera."""
        rows = [Tracklet.whole(t) if isinstance(t, dict) else t for t in tracklets]
        out: dict[int, Decision] = {}
        fresh, again = [], []
        for i, t in enumerate(rows):
            owner = self.gallery.owner_of(t)
            if owner is not None and t.provisional and (t.closed or t.n >= (self.config.revise_after or 0)):
                again.append((i, owner))
            elif owner is not None:
                self.gallery.absorb(owner, t)
                out[i] = Decision(owner.gid, 0.0, "", is_update=True)
            elif t.closed and (former := self.gallery.pop_former(t)) is not None:
                out[i] = Decision(former.gid, 0.0, "", is_update=True)
            else:
                fresh.append(i)
        for i, owner in again:
            out[i] = self._revised(rows[i], owner)
        for cam in sorted({rows[i].cam for i in fresh}):
            own = sorted((i for i in fresh if rows[i].cam == cam), key=lambda i: (rows[i].end, rows[i].tid))
            out |= dict(zip(own, self._matched([rows[i] for i in own]), strict=True))
        return [out[i] for i in range(len(rows))]

    def _matched(self, rows: list[Tracklet]) -> list[Decision]:
        """One camera's new tracklets: one to one with open identities, then the rest, in order of time, with those just made."""
        tracks = self.tracks
        alone = len(rows) == 1 and self.config.max_cost_ground is None
        out: dict[int, Decision] = {}
        if alone:
            paid = self.within(rows[0], tracks, self.likenesses(rows[0], tracks))
            wanted, best = [bool(paid)], [(0, j, paid[j]) for j in ([min(paid, key=paid.get)] if paid else [])]
        else:
            cost, limit = self.costs(rows, tracks)
            most = self.config.max_cost if self.config.max_cost_ground is None else 1.0
            share = cost if self.config.max_cost_ground is None else cost / limit  # of each pair's own limit
            good = share < most
            wanted = good.any(axis=1).tolist()
            best = [(r, j, float(cost[r, j])) for r, j in (hungarian(np.where(good, share, 10 * most + 1)) if any(wanted) else []) if good[r, j]]
        for r, j, price in best:
            self.gallery.absorb(tracks[j], rows[r])
            out[r] = Decision(tracks[j].gid, price, "matched")
        made: list[Identity] = []
        for r in sorted((r for r in range(len(rows)) if r not in out), key=lambda r: (rows[r].start, rows[r].tid)):
            nearest = self.costs([rows[r]], made)[0][0] if made else None
            if made and nearest.min() < self.config.max_cost:
                k = made[int(np.argmin(nearest))]
                self.gallery.absorb(k, rows[r])
                out[r] = Decision(k.gid, float(nearest.min()), "stitched")
                continue
            why = "empty" if not tracks else "taken" if wanted[r] else "threshold" if self.feasible(rows[r], tracks) else "no_candidate"
            made.append(self.gallery.create(rows[r]))
            out[r] = Decision(made[-1].gid, None, why, is_new=True)
        least = self.config.revise_after
        for t in rows:
            t.provisional = least is not None and not t.closed and t.n < least
        return [out[r] for r in range(len(rows))]

    def _revised(self, t: Tracklet, owner: Identity) -> Decision:
        """Take a tracklet out of its identity and decide again, once: it stays, moves, or becomes an identity of its own."""
        t.provisional = False
        self.gallery.detach(owner, t)
        alone = not owner.members
        others = [k for k in self.tracks if not (alone and k is owner)]
        if self.config.max_cost_ground is None:
            prices = self.within(t, others, self.likenesses(t, others))
            shares = {j: price / self.config.max_cost for j, price in prices.items()}
        else:
            cost, limit = self.costs([t], others)
            prices, shares = cost[0].tolist(), {j: share for j, share in enumerate((cost[0] / limit[0]).tolist()) if share < 1}
        if shares:
            best = min(shares, key=shares.get)
            k, paid, new = others[best], prices[best], False
            self.gallery.absorb(k, t)
            if alone:
                self.gallery.drop(owner)
        elif alone:
            k, paid, new = owner, None, False
            self.gallery.absorb(owner, t)
        else:
            k, paid, new = self.gallery.create(t), None, True
        return Decision(k.gid, paid, "" if k is owner else "revised", new, is_update=True)

    def prune(self, now: int) -> list[int]:
        return self.gallery.prune(now)


def associate_offline(tracklets: DataFrame, config: Config, site: str = "site") -> DataFrame:
    """gid, cost (null for a new identity) and reason of (site, tid, cam, start, end, vec) rows, and path (ts, x, y) if there is one.

    The rows of a site are walked in order of end time; a task holds one site's open
    identities and one window's tracklets at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, limit, engine, held, out = None, None, None, [], []

        def decided() -> list[tuple]:
            own = zip(held, engine.round(held), strict=True)
            rows = [(where, r["tid"], d.gid, d.cost, d.reason) for r, d in own]
            engine.prune(max(r["end"] for r in held))
            return rows

        def table() -> pd.DataFrame:
            return pd.DataFrame(out, columns=[site, "tid", "gid", "cost", "reason"]).astype({"cost": float})

        for pdf in batches:
            for r in pdf.to_dict("records"):
                other = engine is None or r[site] != where
                if held and (other or r["end"] > limit):
                    out += decided()
                    held = []
                if other:
                    engine, where = Associator(config), r[site]
                if not held:
                    limit = r["end"] + config.window_ms
                held.append(r)
            yield table()
            out = []
        if held:
            out = decided()
            yield table()

    kinds, columns = dict(tracklets.dtypes), [site, "tid", "cam", "start", "end", "vec", *(["path"] if "path" in tracklets.columns else [])]
    # The walk takes far longer than its few bytes suggest, so small partitions are not put together.
    parts = int(tracklets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tracklets.select(*columns).repartition(parts, site).sortWithinPartitions(site, "end", "cam", "tid")
    return rows.mapInPandas(run, f"{site} {kinds[site]}, tid {kinds['tid']}, gid bigint, cost double, reason string")
