"""Settings files: topology, calibrations, learned models; and the output records of the engine."""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmesh.operators.association import Config

UPDATE = (
    "global_id bigint, cam_id string, local_track_id bigint, tracklet_id bigint, ts_ms bigint, bbox array<double>, ground_point array<double>, "
    "cost double, is_new boolean, is_update boolean, n_cameras bigint, reason string"
)


def load_mapping(spark: SparkSession, path: str) -> dict[str, Any]:
    """A settings file from any store that Spark reads: JSON, or YAML where its library is there."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:
        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def with_override(mapping: dict[str, Any], dotted: str, value: Any) -> dict[str, Any]:
    """A copy with one value set by its dotted key; a key that is not there is an error, since it would do nothing."""
    head, _, rest = dotted.partition(".")
    if head not in mapping:
        raise KeyError(f"no setting {dotted!r}")
    return mapping | {head: with_override(mapping[head], rest, value) if rest else value}


def settings_hash(mapping: dict[str, Any], learned: dict[str, dict[str, Any]] | None = None) -> str:
    """A hash of settings and of what their learned files hold, whatever day those were fitted."""
    models = {k: {a: b for a, b in v.items() if a != "fit_date"} for k, v in (learned or {}).items()}
    return hashlib.sha256(json.dumps([mapping, models], sort_keys=True, default=str).encode()).hexdigest()[:12]


def with_topology(config: Config, topology: dict[str, Any]) -> Config:
    """The configuration with a topology's overlaps, transitions and policy; contradictions raise."""
    cameras = {str(c): spec or {} for c, spec in (topology.get("cameras") or {}).items()}
    overlaps = {(c, str(o)) for c, spec in cameras.items() for o in spec.get("overlaps_with") or ()}
    for a, b in sorted(overlaps):
        if b not in cameras or (b, a) not in overlaps:
            raise ValueError(f"{a} overlaps {b}, but not the other way round")
    policy = topology.get("unknown_pair_policy", "allow")
    if policy not in ("allow", "reject"):
        raise ValueError(f"unknown_pair_policy is allow or reject, not {policy!r}")
    transitions: dict[tuple[str, str], tuple[int, int]] = {}
    for t in topology.get("transitions") or ():
        src, dst, least, most = str(t["from"]), str(t["to"]), int(t.get("min_ms", 0)), int(t["max_ms"])
        if {src, dst} - cameras.keys():
            raise ValueError(f"transition of unknown camera: {src}, {dst}")
        if not 0 <= least <= most:
            raise ValueError(f"transition {src} to {dst}: {least} to {most} ms")
        transitions[src, dst] = (least, most)
        if t.get("bidirectional"):
            transitions[dst, src] = (least, most)
    return replace(config, overlaps=overlaps, transitions=transitions, unknown_pairs=policy == "allow")


def regions(spark: SparkSession, topology: dict[str, Any]) -> DataFrame:
    """rois(cam, x_lo, x_hi, y_lo, y_hi) of a topology's ground regions; unknown keys and empty ranges raise."""
    rows = []
    for cam, spec in (topology.get("cameras") or {}).items():
        roi = (spec or {}).get("ground_roi")
        if roi is None:
            continue
        if set(roi) - {"x_m", "y_m"}:
            raise ValueError(f"{cam}: unknown keys in ground_roi: {sorted(set(roi) - {'x_m', 'y_m'})}")
        ends = [None if v is None else float(v) for axis in ("x_m", "y_m") for v in roi.get(axis) or (None, None)]
        if any(a is not None and b is not None and not a < b for a, b in (ends[:2], ends[2:])):
            raise ValueError(f"{cam}: ground_roi has no inside")
        rows.append((str(cam), *ends))
    return spark.createDataFrame(rows, "cam string, x_lo double, x_hi double, y_lo double, y_hi double")


def with_learned(config: Config, errors: dict[str, Any] | None = None, directions: dict[str, Any] | None = None) -> Config:
    """The configuration with learned ground errors ("a|b" pairs) and exit directions ("a>b" pairs); a file of another kind raises."""
    for own, kind in ((errors, "ground_sigma"), (directions, "exit_direction")):
        if own is not None and own.get("kind") != kind:
            raise ValueError(f"a model of kind {own.get('kind')!r}, not {kind!r}")
    if errors is not None:
        one = lambda m: (float(m["mu"][0]), float(m["mu"][1]), float(m["sigma"]))
        pairs = {
            tuple(sorted(k.split("|"))): {"cell_m": float(m["cell_m"]), "sigma_ref": float(m["sigma_ref"]), "default": one(m["default"]), "cells": {(int(c["ix"]), int(c["iy"])): one(c) for c in m.get("cells") or ()}}
            for k, m in (errors.get("pairs") or {}).items()
        }
        config = replace(config, ground_errors=pairs)
    if directions is not None:
        ways = {tuple(k.split(">")): tuple(map(float, m["direction"])) for k, m in (directions.get("pairs") or {}).items()}
        config = replace(config, directions=ways, direction_rule=(int(directions["window_ms"]), float(directions["min_speed_m_s"]), float(directions["min_cos"])))
    return config


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    """cam, matrix (9 numbers by row), width, height of all calibration files of a folder."""
    rows = []
    for r in spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()).collect():  # a file a camera
        own = load_mapping(spark, r.file)
        size = own.get("image_size") or (None, None)
        rows.append((str(own["cam_id"]), [float(v) for row in own["matrix"] for v in row], size[0], size[1]))
    return spark.createDataFrame(rows, "cam string, matrix array<double>, width int, height int")


def write_updates(updates: DataFrame, path: str) -> None:
    """Output records as JSON lines, in the columns of ``UPDATE``."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(UPDATE).fieldNames()
    updates.select(*names).write.option("ignoreNullFields", False).json(path)


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Output records; optional fields take their defaults, a box without four numbers raises."""
    u = spark.read.schema(UPDATE).json(path)
    wrong = F.raise_error(F.lit("a box has four numbers")).cast("array<double>")
    default = {"cost": F.lit(0.0), "is_new": F.lit(False), "is_update": F.lit(False), "n_cameras": F.lit(1), "reason": F.lit(""), "ground_point": F.array(F.lit(0.0), F.lit(0.0))}
    return u.withColumn("bbox", F.when(F.size("bbox") == 4, F.col("bbox")).otherwise(wrong)).withColumns({c: F.coalesce(c, v) for c, v in default.items()})
