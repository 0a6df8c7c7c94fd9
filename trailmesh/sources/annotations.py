"""Annotation files: XML video tracks, and position files of persons by view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ATTRIBUTES = "array<struct<_name: string, _VALUE: string>>"
_BOX = f"struct<_frame: string, _keyframe: string, _outside: string, _occluded: string, _xtl: string, _ytl: string, _xbr: string, _ybr: string, attribute: {_ATTRIBUTES}>"
_TRACK = f"_id string, _label string, attribute {_ATTRIBUTES}, box array<{_BOX}>"
_META = "start_frame string, stop_frame string, frame_filter string, original_size struct<width: string, height: string>"


def read_tracks(spark: SparkSession, path: str, label: str = "person", attribute: str = "person_id") -> DataFrame:
    """file, track, frame, person, x, y, w, h, occluded of all visible boxes of annotation files ("video 1.1").

    A box has the identity of its own attribute, else of its track's, else an empty one. A
    box without a number in one of its places raises, since a hole would pass for a result.
    """
    tracks = spark.read.format("xml").option("rowTag", "track").schema(_TRACK).load(path).withColumn("file", F.input_file_name())
    named = lambda c: F.trim(F.get(F.filter(F.coalesce(c, F.array().cast(_ATTRIBUTES)), lambda a: a["_name"] == attribute), F.lit(0))["_VALUE"])
    rows = tracks.filter(F.col("_label") == label).select("file", F.col("_id").cast("bigint").alias("track"), named(F.col("attribute")).alias("_own"), F.explode("box").alias("b"))
    rows = rows.filter(F.coalesce(F.col("b._outside"), F.lit("0")) != "1")
    number = lambda c, kind: F.coalesce(F.expr(f"try_cast(b._{c} AS {kind})"), F.raise_error(F.concat(F.lit(f"box without a number in {c}: track "), F.col("track").cast("string"), F.lit(" of "), F.col("file"))).cast(kind))
    person = F.coalesce(F.nullif(named(F.col("b.attribute")), F.lit("")), F.col("_own"), F.lit(""))
    x, y = number("xtl", "double"), number("ytl", "double")
    return rows.select(
        "file", "track", number("frame", "bigint").alias("frame"), person.alias("person"), x.alias("x"), y.alias("y"),
        (number("xbr", "double") - x).alias("w"), (number("ybr", "double") - y).alias("h"), F.coalesce(F.col("b._occluded") == "1", F.lit(False)).alias("occluded"),
    )


def read_meta(spark: SparkSession, path: str, row: str = "task") -> DataFrame:
    """file, start_frame, stop_frame, step, width, height of each file's ``row`` (task or job); missing ones count as 0, null, 1, null."""
    m = spark.read.format("xml").option("rowTag", row).schema(_META).load(path).withColumn("file", F.input_file_name())
    whole = lambda c: F.expr(f"try_cast(trim({c}) AS bigint)")
    step = F.expr(r"try_cast(regexp_extract(frame_filter, 'step\\s*=\\s*(\\d+)', 1) AS bigint)")
    return m.select("file", F.coalesce(whole("start_frame"), F.lit(0)).alias("start_frame"), whole("stop_frame").alias("stop_frame"), F.coalesce(step, F.lit(1)).alias("step"), whole("original_size.width").alias("width"), whole("original_size.height").alias("height"))


def to_video_frames(boxes: DataFrame, meta: DataFrame, numbering: str = "auto") -> DataFrame:
    """Boxes with the frames of the video and ``numbering``: 'abs', or 'rel' where the file counts the task's frames.

    'auto' takes frames for absolute if all of a file lie on the task's grid. A frame that is not one of the task's
    after that raises: a shifted file would give wrong scores without a sign.
    """
    if numbering not in ("auto", "abs", "rel"):
        raise ValueError(f"numbering is auto, abs or rel, not {numbering!r}")
    b = boxes.join(meta.select("file", "start_frame", "stop_frame", "step"), "file", "left").fillna({"start_frame": 0, "step": 1})
    on_grid = lambda f: (f >= F.col("start_frame")) & (F.pmod(f - F.col("start_frame"), F.col("step")) == 0)
    fits = boxes.join(meta.select("file", "start_frame", "step"), "file", "left").fillna({"start_frame": 0, "step": 1}).groupBy("file").agg(F.bool_and(on_grid(F.col("frame"))).alias("_grid"))
    kind = F.when(F.col("_grid"), "abs").otherwise("rel") if numbering == "auto" else F.lit(numbering)
    b = b.join(fits, "file").withColumn("numbering", kind)
    b = b.withColumn("frame", F.when(F.col("numbering") == "rel", F.col("start_frame") + F.col("frame") * F.col("step")).otherwise(F.col("frame")))
    inside = on_grid(F.col("frame")) & F.coalesce(F.col("frame") <= F.col("stop_frame"), F.lit(True))
    stray = F.raise_error(F.concat(F.lit("frame "), F.col("frame").cast("string"), F.lit(" is not of the task: "), F.col("file"))).cast("bigint")
    return b.withColumn("frame", F.when(inside, F.col("frame")).otherwise(stray)).select(*boxes.columns, "numbering")


def person_numbers(boxes: DataFrame, complete: bool = True) -> DataFrame:
    """file, track, gid: identities numbered from 1 in order of their names; a track with two names, or with ``complete`` a box without one, raises."""
    names = boxes.groupBy("file", "track").agg(F.collect_set(F.nullif("person", F.lit(""))).alias("names"), F.count(F.when(F.col("person") == "", 1)).alias("blank"))
    bad = F.when(F.size("names") > 1, F.lit("several identities")).when((F.col("blank") > 0) & F.lit(complete), F.lit("a box without an identity"))
    told = F.raise_error(F.concat(bad, F.lit(": track "), F.col("track").cast("string"), F.lit(" of "), F.col("file"))).cast("string")
    names = names.withColumn("person", F.when(bad.isNotNull(), told).otherwise(F.get("names", F.lit(0)))).filter("person IS NOT NULL")
    ranked = names.select("person").distinct().withColumn("gid", F.row_number().over(W.orderBy("person")).cast("bigint"))
    return names.join(ranked, "person").select("file", "track", "gid")


def write_tracks(keys: DataFrame, path: str, label: str = "person", attribute: str = "person_id") -> None:
    """Write keyframes(track, frame, x1, y1, x2, y2, outside) as annotation files with empty identities, tracks in several files."""
    text = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    flag = lambda c: F.when(c, "1").otherwise("0")
    blank = F.array(F.struct(F.lit(attribute).alias("_name"), F.lit("").alias("_VALUE"))).alias("attribute")
    box = F.struct(
        F.col("frame").alias("_f"), F.col("frame").cast("string").alias("_frame"), F.lit("1").alias("_keyframe"), flag(F.col("outside")).alias("_outside"), F.lit("0").alias("_occluded"),
        *[text(c).alias(f"_{n}") for c, n in (("x1", "xtl"), ("y1", "ytl"), ("x2", "xbr"), ("y2", "ybr"))], blank,
    )
    tracks = keys.groupBy(F.col("track").cast("string").alias("_id")).agg(F.transform(F.sort_array(F.collect_list(box)), lambda b: b.dropFields("_f")).alias("box"))
    tracks.select("_id", F.lit(label).alias("_label"), "box").write.format("xml").option("rootTag", "annotations").option("rowTag", "track").save(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """file, frame (the number in the file's name), person, position, view, x, y, w, h of position files; views where a person is not seen go."""
    view = "struct<viewNum: bigint, xmin: double, ymin: double, xmax: double, ymax: double>"
    rows = spark.read.option("multiLine", True).schema(f"personID bigint, positionID bigint, views array<{view}>").json(path).withColumn("file", F.input_file_name())
    frame = F.expr(r"cast(regexp_extract(file, '([0-9]+)\\.json$', 1) AS bigint)")
    rows = rows.select("file", frame.alias("frame"), F.col("personID").alias("person"), F.col("positionID").alias("position"), F.inline("views"))
    seen = rows.filter("xmin <> -1 AND ymin <> -1 AND xmax <> -1 AND ymax <> -1")
    return seen.select("file", "frame", "person", "position", F.col("viewNum").alias("view"), F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))
