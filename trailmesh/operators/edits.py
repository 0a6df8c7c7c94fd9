"""Edits of annotated tracks as tables: boxes(cam, track, person, frame, x1, y1, x2, y2, keyframe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


class EditError(ValueError):
    """An edit that the track does not allow."""


def _of(cam: str, track: int) -> Column:
    return (F.col("cam") == cam) & (F.col("track") == track)


def _known(boxes: DataFrame, cam: str, track: int) -> DataFrame:
    own = boxes.filter(_of(cam, track))
    if own.isEmpty():
        raise EditError(f"no track {track} of {cam}")
    return own


def split(boxes: DataFrame, cam: str, track: int, frame: int, person: str | None = None) -> tuple[DataFrame, int]:
    """The track from ``frame`` on as a new one, and its number; both ends at the cut become keyframes."""
    ends = _known(boxes, cam, track).agg(F.max(F.when(F.col("frame") < frame, F.col("frame"))), F.min(F.when(F.col("frame") >= frame, F.col("frame")))).first()
    if ends[0] is None or ends[1] is None:
        raise EditError(f"track {track} has no frames on both sides of {frame}")
    new = boxes.filter(F.col("cam") == cam).agg(F.max("track")).first()[0] + 1
    tail = _of(cam, track) & (F.col("frame") >= frame)
    out = boxes.withColumn("keyframe", F.col("keyframe") | (_of(cam, track) & F.col("frame").isin(*ends)))
    named = F.col("person") if person is None else F.lit(person.strip())
    return out.withColumns({"track": F.when(tail, F.lit(new)).otherwise(F.col("track")).cast(boxes.schema["track"].dataType), "person": F.when(tail, named).otherwise(F.col("person"))}), new


def hide(boxes: DataFrame, cam: str, track: int, first: int, last: int) -> DataFrame:
    """The track without its frames from first to last; the frames next to the hole become keyframes."""
    _known(boxes, cam, track)
    gone = _of(cam, track) & F.col("frame").between(first, last)
    return boxes.filter(~gone).withColumn("keyframe", F.col("keyframe") | (_of(cam, track) & F.col("frame").isin(first - 1, last + 1)))


def merge(boxes: DataFrame, cam: str, keep: int, other: int) -> DataFrame:
    """Track ``other`` becomes part of ``keep``; frames that both have are an error. A missing name is taken from the other."""
    a, b = _known(boxes, cam, keep), _known(boxes, cam, other)
    both = a.select("frame").intersect(b.select("frame")).agg(F.count("*"), F.min("frame")).first()
    if both[0]:
        raise EditError(f"{keep} and {other} are both in {both[0]} frames, the first is {both[1]}")
    name = a.agg(F.max("person")).first()[0] or b.agg(F.max("person")).first()[0]
    either = F.col("cam").eqNullSafe(cam) & F.col("track").isin(keep, other)
    return boxes.withColumns({"track": F.when(either, F.lit(keep)).otherwise(F.col("track")).cast(boxes.schema["track"].dataType), "person": F.when(either, F.lit(name)).otherwise(F.col("person"))})


def set_box(boxes: DataFrame, cam: str, track: int, frame: int, box: tuple[float, float, float, float], link: bool = False) -> DataFrame:
    """The track with a keyframe at ``frame``; boxes between it and the keyframes around it in its stretch follow a straight line.

    ``link`` joins a frame outside all stretches to the last one before it, filling the frames between.
    """
    if box[2] <= box[0] or box[3] <= box[1]:
        raise EditError("a box has x2 > x1 and y2 > y1")
    own = _known(boxes, cam, track)
    there = not own.filter(F.col("frame") == frame).isEmpty()
    before = own.filter(F.col("frame") < frame).agg(F.max("frame")).first()[0]
    name = own.agg(F.max("person")).first()[0]
    kinds = dict(boxes.dtypes)
    values = {"cam": cam, "track": track, "person": name, "frame": frame, **dict(zip(BOX, map(float, box), strict=True)), "keyframe": True}
    row = boxes.sparkSession.range(1).select(*[(F.lit(values[c]) if c in values else F.lit(None)).cast(kinds[c]).alias(c) for c in boxes.columns])
    rest = own.filter(F.col("frame") != frame)
    if link and not there and before is not None:
        filled = boxes.sparkSession.range(before + 1, frame).select(*[(F.col("id") if c == "frame" else F.lit(False) if c == "keyframe" else F.lit(values.get(c))).cast(kinds[c]).alias(c) for c in boxes.columns])
        rest = rest.withColumn("keyframe", F.col("keyframe") | (F.col("frame") == before)).unionByName(filled)
    t = rest.unionByName(row)
    # The stretch of the new frame, and in it the nearest keyframes on either side.
    order = W.orderBy("frame")  # one person's frames in one camera
    t = t.withColumn("_run", F.col("frame") - F.row_number().over(order))
    mine = W.partitionBy("_run")
    key = lambda side, pick: pick(F.when(F.col("keyframe") & side, F.col("frame"))).over(mine)
    t = t.withColumns({"_has": F.max(F.col("frame") == frame).over(mine), "_lo": key(F.col("frame") < frame, F.max), "_hi": key(F.col("frame") > frame, F.min)})
    at = lambda c, f: F.max(F.when(F.col("frame") == f, F.col(c))).over(mine)
    lines = {}
    for c, v in zip(BOX, map(float, box), strict=True):
        low, high = at(c, F.col("_lo")), at(c, F.col("_hi"))
        back = low + (v - low) * (F.col("frame") - F.col("_lo")) / (F.lit(frame) - F.col("_lo"))
        on = v + (high - v) * (F.col("frame") - frame) / (F.col("_hi") - frame)
        lines[c] = F.when(F.col("_has") & (F.col("frame") > F.col("_lo")) & (F.col("frame") < frame), back).when(F.col("_has") & (F.col("frame") > frame) & (F.col("frame") < F.col("_hi")), on).otherwise(F.col(c))
    t = t.withColumns(lines).select(*boxes.columns)
    return boxes.filter(~_of(cam, track)).unionByName(t)


def edit_issues(boxes: DataFrame) -> DataFrame:
    """cam, track, issue, first, last, n: tracks without a name, and tracks of one name that share frames."""
    blank = boxes.filter("person = '' OR person IS NULL").groupBy("cam", "track").agg(F.lit("no_name").alias("issue"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))
    named = boxes.filter("person <> ''").select("cam", "person", "frame", "track")
    shared = named.groupBy("cam", "person", "frame").agg(F.min("track").alias("_owner"))
    clash = named.join(shared, ["cam", "person", "frame"]).filter("track <> _owner").groupBy("cam", "track").agg(F.lit("clash").alias("issue"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))
    return blank.unionByName(clash)
