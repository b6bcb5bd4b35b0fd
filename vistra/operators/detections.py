"""Detections: schedules, batches, frames and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistra.functions import geometry as g


def anchor_schedule(thumbs: DataFrame, *, mode: str, interval: int = 3, min_interval: int = 1, threshold: float = 0.35) -> DataFrame:
    """video_id, frame, reason of the anchors among ``thumbs(video_id, frame, thumb)``.

    A frame is an anchor if it is the first, if ``interval`` frames have passed since the last anchor, or if it
    differs enough from the last anchor.  The comparison is with the last anchor, so the frames of a video are
    folded in order; one video's frames are one array, of bounded size.
    """
    step = F.struct("frame", "thumb")
    start = F.struct(F.lit(-interval).alias("last"), F.lit(None).cast("double").alias("thumb"), F.array().cast("array<struct<frame:int,reason:string>>").alias("out"))

    def fold(s: Column, x: Column) -> Column:
        gap = x["frame"] - s["last"]
        scheduled = gap >= interval
        ready = scheduled if mode == "fixed_sparse" else gap >= min_interval
        differs = F.coalesce(F.abs(x["thumb"] - s["thumb"]) / 255 >= threshold, F.lit(False)) & F.lit(threshold > 0)
        changed = ready & differs
        first = s["thumb"].isNull()
        reason = F.when(first, "first").when(changed, "scene_change").otherwise("sparse_schedule" if mode == "fixed_sparse" else "interval")
        out = F.concat(s["out"], F.array(F.struct(x["frame"].alias("frame"), reason.alias("reason"))))
        hit = F.struct(x["frame"].alias("last"), x["thumb"].alias("thumb"), out.alias("out"))
        return F.when(first | scheduled | changed, hit).otherwise(s)

    folded = thumbs.groupBy("video_id").agg(F.aggregate(F.array_sort(F.collect_list(step)), start, fold).alias("s"))
    return folded.select("video_id", F.explode("s.out").alias("a")).select("video_id", "a.frame", "a.reason")


def frame_batches(frames: DataFrame, size: int = 5) -> DataFrame:
    """video_id, frame, batch_id, batch_frames: ordered frames in fixed batches that do not overlap."""
    order = Window.partitionBy("video_id").orderBy("frame")
    numbered = frames.withColumn("batch_id", F.floor((F.row_number().over(order) - 1) / size))
    batch = Window.partitionBy("video_id", "batch_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return numbered.withColumn("batch_frames", F.collect_list("frame").over(batch))


def route_sources(frames: DataFrame, failed: Column, interval: int = 15) -> DataFrame:
    """The detector of each frame: the slow one every ``interval`` frames unless it failed, the quick one else."""
    slow = (F.col("frame") % interval == 0) & ~F.coalesce(failed, F.lit(False))
    return frames.withColumn("source", F.when(slow, "dinox").otherwise("rexomni"))


def frame_spine(videos: DataFrame, detections: DataFrame) -> DataFrame:
    """Every frame of ``videos(video_id, total_frames)`` with its number of detections; those without are ``skipped``."""
    spine = videos.where("total_frames > 0").select("video_id", F.explode(F.sequence(F.lit(0), F.col("total_frames") - 1)).alias("frame"))
    counts = detections.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("objects"))
    joined = spine.join(counts, ["video_id", "frame"], "left")
    return joined.select("video_id", "frame", F.coalesce("objects", F.lit(0)).alias("objects"), F.when(F.col("objects").isNull(), "skipped").otherwise("observed").alias("status"))


def valid_boxes(detections: DataFrame, *, min_area: float = 500.0, most: int = 60) -> DataFrame:
    """Finite boxes of ``min_area`` or more, the first ``most`` of each frame in the detector's order (``event_id``)."""
    finite = F.lit(True)
    for side in g.box():
        finite = finite & side.isNotNull() & ~F.isnan(side) & (F.abs(side) < float("inf"))
    big = detections.where(finite & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (g.area(g.box()) >= min_area))
    rank = F.row_number().over(Window.partitionBy("video_id", "frame").orderBy("event_id"))
    return big.withColumn("ord", rank).where(F.col("ord") <= most)


def clipped_boxes(detections: DataFrame, width: float, height: float) -> DataFrame:
    """Corners sorted and clamped to the image; boxes without area are dropped."""
    b = g.box()
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))
    out = detections.withColumns(
        {
            "x1": inside(F.least(b[0], b[2]), width),
            "y1": inside(F.least(b[1], b[3]), height),
            "x2": inside(F.greatest(b[0], b[2]), width),
            "y2": inside(F.greatest(b[1], b[3]), height),
        }
    )
    return out.where("x2 > x1 and y2 > y1")


#: Text forms of the fields of a raw detection; numbers are cast one by one, so that one bad field is seen as such.
_RAW = "bbox array<string>, class string, class_name string, score string, confidence string, score_kind string, source string, batch_id string, raw_class_name string, association_weight string"


def compact(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the fields of the raw detection (a JSON object) in ``column``, typed: box, class (-1), class_name (unknown), score, score_kind and provenance.

    A detection goes if its box has not four numbers, or if its class or score is no number.  A score may be called confidence.
    """
    kept = [c for c in rows.columns if c != column]
    o = rows.select(*kept, F.from_json(column, _RAW).alias("o"))
    box = F.transform("o.bbox", lambda v: v.try_cast("double"))
    raw = F.coalesce("o.score", "o.confidence")
    out = o.withColumns({"_box": box, "_class": F.coalesce("o.class", F.lit("-1")).try_cast("double").cast("int"), "_score": raw.try_cast("double"), "_raw": raw})
    out = out.where((F.size("_box") == 4) & F.forall("_box", lambda v: v.isNotNull()) & F.col("_class").isNotNull() & (F.col("_raw").isNull() | F.col("_score").isNotNull()))
    kind = F.coalesce("o.score_kind", F.when(F.col("_score").isNotNull(), "legacy_confidence").otherwise("unavailable"))
    extra = [F.col(f"o.{c}") for c in ("source", "batch_id", "raw_class_name")] + [F.col("o.association_weight").try_cast("double").alias("association_weight")]
    return out.select(*kept, *[F.col("_box")[i].alias(s) for i, s in enumerate(g.SIDES)], F.col("_class").alias("class"), F.coalesce("o.class_name", F.lit("unknown")).alias("class_name"), F.col("_score").alias("score"), F.col("_score").alias("confidence"), kind.alias("score_kind"), *extra)


def batch_problems(batches: DataFrame, size: int = 5) -> DataFrame:
    """video_id, batch_id, problem of ``batches(video_id, batch_id, frame, batch_frames)``: a repeated frame, or a list of another length than its rows or than allowed."""
    seen = batches.groupBy("video_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("frame").alias("k"), F.max(F.size("batch_frames")).alias("listed"))
    problem = F.when(F.col("k") < F.col("n"), "repeated_frame").when(F.col("listed") != F.col("n"), "length_differs").when(F.col("n") > size, "too_long")
    return seen.withColumn("problem", problem).where("problem is not null").select("video_id", "batch_id", "problem")


def _broken(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()]))


def _bad_score(c: str) -> Column:
    return F.col(c).isNotNull() & (F.isnan(c) | ~F.col(c).between(0, 1))


def track_violations(tracks: DataFrame) -> DataFrame:
    """``tracks`` (track_id, frame, bbox, bbox_observed, class_name, confidence, box_source, is_predicted) with the list of what each row breaks."""
    finite = lambda b: (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.col(b)[2] > F.col(b)[0]) & (F.col(b)[3] > F.col(b)[1])
    seen, source, predicted = F.col("bbox_observed").isNotNull(), F.lower(F.trim(F.coalesce("box_source", F.lit("observed")))), F.coalesce("is_predicted", F.lit(False))
    checks = {
        "bad_track_id": F.col("track_id").isNull() | (F.col("track_id") < 0), "negative_frame": F.col("frame").isNotNull() & (F.col("frame") < 0), "bad_box": ~F.coalesce(finite("bbox"), F.lit(False)),
        "bad_observed_box": seen & ~F.coalesce(finite("bbox_observed"), F.lit(False)), "empty_class": F.trim(F.coalesce("class_name", F.lit(""))) == "", "bad_score": _bad_score("confidence"),
        "unknown_source": ~source.isin("observed", "interpolated", "predicted"), "predicted_but_observed": predicted & seen, "observed_without_box": (source == "observed") & ~seen, "unobserved_with_box": (source != "observed") & seen,
    }
    return tracks.withColumn("violations", _broken(checks))


def relation_violations(relations: DataFrame) -> DataFrame:
    """``relations`` (ids, predicate, half-open start_frame and end_frame, scores, evidence_frames) with the list of what each row breaks."""
    checks = {
        "bad_track_id": F.col("subject_id").isNull() | F.col("object_id").isNull() | (F.least("subject_id", "object_id") < 0), "same_track": F.coalesce(F.col("subject_id") == F.col("object_id"), F.lit(False)),
        "empty_predicate": F.trim(F.coalesce("predicate", F.lit(""))) == "", "bad_span": F.col("start_frame").isNull() | F.col("end_frame").isNull() | (F.col("start_frame") < 0) | (F.col("end_frame") <= F.col("start_frame")),
        "bad_score": _bad_score("confidence") | _bad_score("rule_support") | _bad_score("agent_score") | _bad_score("ranking_score"),
        "evidence_outside_span": F.exists(F.coalesce("evidence_frames", F.array().cast("array<int>")), lambda f: (f < F.col("start_frame")) | (f >= F.col("end_frame"))),
    }
    return relations.withColumn("violations", _broken(checks))


def violations(detections: DataFrame) -> DataFrame:
    """What each row breaks of the record contract, as flags and a list; clean rows have an empty list."""
    b = g.box()
    checks = {
        "negative_frame": F.col("frame").isNull() | (F.col("frame") < 0),
        "bad_box": ~F.coalesce((b[2] > b[0]) & (b[3] > b[1]), F.lit(False)),
        "bad_score": F.col("score").isNotNull() & (F.isnan("score") | ~F.col("score").between(0, 1)),
        "empty_class": F.coalesce(F.trim("class_name"), F.lit("")) == "",
    }
    names = [F.when(bad, name) for name, bad in checks.items()]
    return detections.withColumn("violations", F.array_compact(F.array(*names)))
