"""The round engine as a stateful operator: one state key per site, the same decisions for any batch boundaries.

Needs Spark's RocksDB state store. Frames of a site are fed in order of ``seq``, the order
of arrival; a batch must hold no frame that precedes one of an earlier batch of its site (a
file or partition log by site gives that). Time is that of the data, so there are no timers and
nothing is too late: a frame with an old ts widens its tracklet.

The state of a site is a row of scalars, one map entry for each open tracklet and one
for each open identity; only entries that a batch changed are written.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmesh.operators.association import Config
from trailmesh.operators.rounds import DECISIONS, RoundEngine

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class SiteRounds(StatefulProcessor):
    def __init__(self, config: Config) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.site = handle.getValueState("site", "body binary")
        self.tracklets = handle.getMapState("tracklets", "cam string, local bigint", "body binary")
        self.identities = handle.getMapState("identities", "gid bigint", "body binary")

    def _loaded(self) -> tuple[RoundEngine, dict, dict]:
        engine, tracklets, identities = RoundEngine(self.config), {}, {}
        if self.site.exists():
            gallery = engine.associator.gallery
            engine.next_tid, engine.now, engine.window_end, engine.reported, gallery.next_id, gallery.former = pickle.loads(bytes(self.site.get()[0]))
            tracklets = {(k[0], k[1]): bytes(v[0]) for k, v in self.tracklets.iterator()}
            identities = {k[0]: bytes(v[0]) for k, v in self.identities.iterator()}
            # Tracklets keep the order in which they were opened.
            engine.open = dict(sorted(((k, pickle.loads(v)) for k, v in tracklets.items()), key=lambda kv: kv[1].tid))
            gallery.open = {g: pickle.loads(v) for g, v in sorted(identities.items())}
            gallery.owner = {tid: g for g, k in gallery.open.items() for tid in k.owned.values()}
        return engine, tracklets, identities

    def _kept(self, engine: RoundEngine, tracklets: dict, identities: dict) -> None:
        gallery = engine.associator.gallery
        self.site.update((pickle.dumps((engine.next_tid, engine.now, engine.window_end, engine.reported, gallery.next_id, gallery.former)),))
        for state, before, now in ((self.tracklets, tracklets, engine.open), (self.identities, identities, {g: k for g, k in gallery.open.items()})):
            key = (lambda k: k) if state is self.tracklets else (lambda k: (k,))
            for k, v in now.items():
                body = pickle.dumps(v)
                if before.get(k) != body:
                    state.updateValue(key(k), (body,))
            for k in before.keys() - now.keys():
                state.removeKey(key(k))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        engine, tracklets, identities = self._loaded()
        frames = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for part in range(0, len(frames), 1000):
            out = []
            for r in frames.iloc[part : part + 1000].itertuples(index=False):
                out += engine.feed(r.cam, None if pd.isna(r.ts) else int(r.ts), list(r.detections) if r.detections is not None else [])
            if out:
                yield pd.DataFrame([(key[0], *r) for r in out], columns=["site", *[c.split()[0] for c in DECISIONS.split(", ")]]).astype({"cost": float})
        self._kept(engine, tracklets, identities)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        """Numbers to go on from: a row (site, tid, gid)."""
        engine = RoundEngine(self.config, int(initialState["tid"].iloc[0]), int(initialState["gid"].iloc[0]))
        self._kept(engine, {}, {})

    def close(self) -> None:
        pass


def associate_stream(frames: DataFrame, config: Config, first_ids: DataFrame | None = None) -> DataFrame:
    """Decisions of a stream of frames(site, seq, cam, ts, detections) as they are taken."""
    site = dict(frames.dtypes)["site"]
    start = None if first_ids is None else first_ids.select("site", "tid", "gid").groupBy("site")
    keyed = frames.select("site", "seq", "cam", "ts", "detections").groupBy("site")
    return keyed.transformWithStateInPandas(SiteRounds(config), outputStructType=f"site {site}, {DECISIONS}", outputMode="Append", timeMode="None", initialState=start)
