"""Gold annotations, exports of relations, and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_relations(annotations: DataFrame, predicates: DataFrame) -> DataFrame:
    """Relations of ``annotations(video_id, relation_instances)`` with inclusive spans; unknown predicates and empty spans are dropped."""
    rows = annotations.select("video_id", F.explode("relation_instances").alias("r"))
    rows = rows.select("video_id", F.col("r.subject_tid").alias("subject_id"), F.lower(F.trim("r.predicate")).alias("predicate"), F.col("r.object_tid").alias("object_id"), F.col("r.begin_fid").alias("start_frame"), (F.col("r.end_fid") - 1).alias("end_frame"))
    return rows.where("end_frame >= start_frame").join(F.broadcast(predicates.select(F.col("name").alias("predicate"))), "predicate", "left_semi")


def split_of(path):
    """The split of an annotation file: the folder it lies in."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def gold_trajectories(annotations: DataFrame) -> DataFrame:
    """video_id, track_id, category, frame, box of ``annotations(video_id, objects, trajectories)``; trajectories is a list of boxes for each frame.

    Boxes with a side missing go; a track that ``objects`` does not name is ``unknown``.
    """
    rows = annotations.select("video_id", "objects", F.posexplode("trajectories").alias("frame", "items")).select("video_id", "objects", "frame", F.explode("items").alias("i"))
    b = F.col("i.bbox")
    sides = {"x1": b["xmin"], "y1": b["ymin"], "x2": b["xmax"], "y2": b["ymax"]}
    rows = rows.withColumns({c: v.cast("double") for c, v in sides.items()}).where("i.tid is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    named = F.try_element_at(F.filter("objects", lambda o: o["tid"] == F.col("i.tid")), F.lit(1))["category"]
    return rows.select("video_id", F.col("i.tid").alias("track_id"), F.coalesce(named, F.lit("unknown")).alias("category"), "frame", *sides)


def manifest(gold: DataFrame) -> DataFrame:
    """relations and videos for each predicate, and for all of them (predicate null)."""
    counts = [F.count(F.lit(1)).alias("relations"), F.countDistinct("video_id").alias("videos")]
    return gold.groupBy("predicate").agg(*counts).unionByName(gold.agg(*counts).withColumn("predicate", F.lit(None).cast("string")))


def scope(videos: DataFrame, *, requested: list[str] | None = None, split: str | None = None) -> DataFrame:
    """The videos to be scored: those of a split, or those asked for."""
    return videos.where(F.col("split") == split).select("video_id") if split is not None else videos.where(F.col("video_id").isin(list(dict.fromkeys(requested or [])))).select("video_id")


def merge_exports(parts: list[DataFrame], requested: DataFrame) -> DataFrame:
    """One row per requested video with its relations in order; a video without any has an empty list."""
    rows = reduce(DataFrame.unionByName, parts)
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("rel_id", *[c for c in rows.columns if c not in ("rel_id", "video_id")]))).alias("relations"))
    joined = requested.select("video_id").distinct().join(lists, "video_id", "left")
    return joined.select("video_id", F.coalesce("relations", F.array().cast(lists.schema["relations"].dataType)).alias("relations"))


def report(metrics: list[tuple[str, float]], title: str = "Evaluation") -> str:
    """A Markdown table of a few metrics."""
    return "\n".join([f"# {title}", "", "| metric | value |", "|-|-|", *(f"| {k} | {v:.4f} |" for k, v in metrics), ""])


def official_report(metrics: dict[str, float], *, split: str, videos: int, complete: bool, states: dict[str, int], gold: int, predicted: int, viou: float = 0.5) -> str:
    """The Markdown report of the tube metrics: what was scored, detection, tagging, and which videos the submission lacks or has too many of."""
    part = [] if complete else ["> Only a part of the test set was scored; this is no benchmark result.", ""]
    table = lambda names: ["| metric | value |", "|-|-|", *(f"| {n} | {metrics[n]:.6f} |" for n in names if n in metrics), ""]
    return "\n".join([
        "# Relation detection and tagging (tube protocol)", "", f"Split `{split}`, {videos} videos, tubes matched from vIoU {viou:.2f} on.", "", *part,
        "## Relation detection", "", *table(["mAP", *sorted((m for m in metrics if m.startswith("R@")), key=lambda m: int(m[2:]))]),
        "## Relation tagging", "", *table(sorted((m for m in metrics if m.startswith("P@")), key=lambda m: int(m[2:]))),
        "## Coverage", "", "| videos | number |", "|-|-|", *(f"| {k} | {states.get(k, 0)} |" for k in ("missing", "extra", "empty")), "", f"{gold} gold relations, {predicted} predicted tubes.", "",
    ])


def diagnostic_report(overall: dict, per_predicate: list[dict], tracks: dict, *, track_iou: float = 0.3, tiou: float = 0.5, errors: list[dict] = ()) -> str:
    """The Markdown report of the track-aligned diagnostic: alignment, the summary, each predicate, and the first errors."""
    head = ["tp", "fp", "fn", "precision", "recall", "f1", "ap"]
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    row = lambda first, r: f"| {first} | " + " | ".join(cell(r[c]) for c in head) + " |"
    return "\n".join([
        "# Track-aligned diagnostic", "", "These are not the official metrics.", "", f"Tracks are aligned from IoU {track_iou:.2f} on frames with gold boxes, relations matched from tIoU {tiou:.2f}.",
        f"{tracks['matched']} of {tracks['gold']} gold tracks are matched, with a mean IoU of {tracks['mean_iou']:.4f}.", "",
        "| predicate | " + " | ".join(head) + " |", "|-" * (len(head) + 1) + "|", row("all", overall), *(row(r["predicate"], r) for r in per_predicate), "",
        *(["## First errors", "", *(f"- {e['error_type']}: {e['rel_id']}" for e in errors), ""] if errors else []),
    ])
