"""Tracks: votes, kinematics, quality, gaps and windows.  Rows are (video_id, track_id, frame, box, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistra.functions import geometry as g

KEYS = ("video_id", "track_id")


def by_frame():
    """A track's rows in order."""
    return Window.partitionBy(*KEYS).orderBy("frame")


def main_class(rows: DataFrame) -> DataFrame:
    """The most frequent class of each track; of equally frequent ones the first seen."""
    counts = rows.groupBy(*KEYS, "class_name").agg(F.count(F.lit(1)).alias("votes"), F.min("frame").alias("first_frame"))
    best = F.max_by(F.struct("class_name", "votes"), F.struct("votes", -F.col("first_frame")))
    return counts.groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, "b.class_name", "b.votes")


def recent_class_vote(rows: DataFrame, window: int = 12) -> DataFrame:
    """Each row with the class that weighs most in the track's last ``window`` rows.

    A null score weighs 1; ``unknown`` has no vote; of equal classes the one first seen in the window wins.
    """
    seen = F.collect_list(F.struct("class_name", F.coalesce("score", F.lit(1.0)).alias("w"))).over(by_frame().rowsBetween(1 - window, 0))
    votes = F.filter(seen, lambda v: v["class_name"] != "unknown")
    names = F.array_distinct(F.transform("votes", lambda v: v["class_name"]))
    total = lambda name: F.aggregate(F.filter("votes", lambda v: v["class_name"] == name), F.lit(0.0), lambda s, v: s + v["w"])
    totals = F.transform(names, lambda n: F.struct(n.alias("class_name"), total(n).alias("weight")))
    best = F.aggregate("totals", F.struct(F.lit(None).cast("string").alias("class_name"), F.lit(-1.0).alias("weight")), lambda s, t: F.when(t["weight"] > s["weight"], t).otherwise(s))
    return rows.withColumn("votes", votes).withColumn("totals", totals).withColumn("b", best).select(*rows.columns, F.coalesce("b.class_name", F.lit("unknown")).alias("voted_class"), F.greatest("b.weight", F.lit(0.0)).alias("weight"))


def kinematics(rows: DataFrame) -> DataFrame:
    """Running confidence, hits, path length and speed of each track at each of its rows."""
    cx, cy = g.center(g.box())
    moved = rows.withColumns({"cx": cx, "cy": cy})
    step = F.hypot(F.col("cx") - F.lag("cx").over(by_frame()), F.col("cy") - F.lag("cy").over(by_frame()))
    moved = moved.withColumn("step", F.coalesce(step, F.lit(0.0)))
    upto = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    duration = F.col("frame") - F.min("frame").over(upto) + 1
    out = moved.withColumns({"confidence": F.avg("score").over(upto), "hits": F.count(F.lit(1)).over(upto), "duration_frames": duration, "total_distance": F.sum("step").over(upto)})
    return out.withColumn("avg_speed", F.col("total_distance") / F.col("duration_frames")).drop("cx", "cy", "step")


def velocity(rows: DataFrame) -> DataFrame:
    """Each row's box velocity since the row before, per frame, null for a track's first."""
    dt = F.col("frame") - F.lag("frame").over(by_frame())
    return rows.withColumns({f"v_{s}": (F.col(s) - F.lag(s).over(by_frame())) / dt for s in g.SIDES})


def predict(rows: DataFrame, gap: Column) -> dict[str, Column]:
    """The boxes ``gap`` frames on, at the row's velocity."""
    return {s: F.col(s) + F.col(f"v_{s}") * gap for s in g.SIDES}


def class_distribution(rows: DataFrame) -> DataFrame:
    """The share of each class among a track's weights (null scores weigh 1)."""
    sums = rows.groupBy(*KEYS, "class_name").agg(F.sum(F.coalesce("score", F.lit(1.0))).alias("w"))
    total = F.sum("w").over(Window.partitionBy(*KEYS))
    return sums.select(*KEYS, "class_name", (F.col("w") / total).alias("share"))


def class_overlap(shares: DataFrame) -> DataFrame:
    """Sum over classes of the lesser share, for the pairs of tracks of a video that have a class in common."""
    a = shares.select("video_id", F.col("track_id").alias("a"), "class_name", F.col("share").alias("p"))
    b = shares.select("video_id", F.col("track_id").alias("b"), "class_name", F.col("share").alias("q"))
    return a.join(b, ["video_id", "class_name"]).where("a < b").groupBy("video_id", "a", "b").agg(F.sum(F.least("p", "q")).alias("overlap"))


def mean_embedding(rows: DataFrame, key: str, last: int = 20) -> DataFrame:
    """key, dim, value: the mean of the key's last ``last`` embeddings (by ``ord``), brought to length 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ord").desc()))
    parts = rows.withColumn("rk", rank).where(F.col("rk") <= last).select(key, F.posexplode("embedding").alias("dim", "v"))
    means = parts.groupBy(key, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(key)))
    return means.select(key, "dim", (F.col("m") / F.greatest(norm, F.lit(1e-12))).alias("value"))


def short_tracks(rows: DataFrame, min_frames: int = 2) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("frames")).where(F.col("frames") < min_frames)


def class_drift(rows: DataFrame, max_changes: int = 1) -> DataFrame:
    """Tracks whose class changes more than ``max_changes`` times from row to row."""
    changed = (F.col("class_name") != F.lag("class_name").over(by_frame())).cast("int")
    return rows.withColumn("c", changed).groupBy(*KEYS).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("changes")).where(F.col("changes") > max_changes)


def observed(rows: DataFrame) -> DataFrame:
    """The rows whose box was seen; without ``box_source`` all were."""
    return rows.where(F.coalesce("box_source", F.lit("observed")) == "observed") if "box_source" in rows.columns else rows


def large_jumps(rows: DataFrame, max_ratio: float = 0.45) -> DataFrame:
    """Observed rows whose centre moved more than ``max_ratio`` diagonals of the box since the observed row before."""
    cx, cy = g.center(g.box())
    moved = observed(rows).withColumns({"cx": cx, "cy": cy})
    far = F.hypot(F.col("cx") - F.lag("cx").over(by_frame()), F.col("cy") - F.lag("cy").over(by_frame()))
    b = g.box()
    diagonal = F.hypot(F.greatest(F.lit(1.0), b[2] - b[0]), F.greatest(F.lit(1.0), b[3] - b[1]))
    return moved.select(*KEYS, "frame", (far / diagonal).alias("jump_ratio")).where(F.col("jump_ratio") > max_ratio)


def continuity(rows: DataFrame) -> DataFrame:
    """Span, coverage, segments and gaps of each track.  ``box_source`` tells observed rows from interpolated ones."""
    once = rows.groupBy(*KEYS, "frame").agg(F.max((F.col("box_source") == "observed").cast("int")).alias("o"), F.max((F.col("box_source") == "interpolated").cast("int")).alias("i"))
    gap = F.col("frame") - F.lag("frame").over(by_frame()) - 1
    out = once.withColumn("gap", F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0))).groupBy(*KEYS).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("output_frames"), F.sum("o").alias("observed_frames"),
        F.sum("i").alias("interpolated_frames"), (F.sum((F.col("gap") > 0).cast("int")) + 1).alias("segments"), F.max("gap").alias("max_gap"),
    )
    span = F.col("end_frame") - F.col("start_frame") + 1
    return out.withColumns({"span_frames": span, "coverage_ratio": F.bround(F.col("output_frames") / span, 4), "observed_ratio": F.bround(F.col("observed_frames") / span, 4), "interpolation_ratio": F.bround(F.col("interpolated_frames") / F.col("output_frames"), 4)})


def quality(rows: DataFrame, *, min_frames: int = 2, max_changes: int = 1, max_ratio: float = 0.45) -> DataFrame:
    """Counts per video and the number of risky tracks: short, drifting, or jumping ones."""
    short, drift, jumps = short_tracks(rows, min_frames), class_drift(rows, max_changes), large_jumps(rows, max_ratio)
    flags = short.select(*KEYS, F.lit(1).alias("s"), F.lit(0).alias("d"), F.lit(0).alias("j"))
    flags = flags.unionByName(drift.select(*KEYS, F.lit(0).alias("s"), F.lit(1).alias("d"), F.lit(0).alias("j")))
    flags = flags.unionByName(jumps.select(*KEYS, F.lit(0).alias("s"), F.lit(0).alias("d"), F.lit(1).alias("j")))
    bad = flags.groupBy("video_id").agg(F.sum("s").alias("short_tracks"), F.sum("d").alias("class_drifts"), F.sum("j").alias("large_jumps"), F.countDistinct("track_id").alias("risk_tracks"))
    counts = rows.groupBy("video_id").agg(F.countDistinct("track_id").alias("tracks"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("short_tracks", "class_drifts", "large_jumps", "risk_tracks")]
    out = counts.join(bad, "video_id", "left").select("video_id", "tracks", *zero)
    return out.withColumn("passed", F.col("risk_tracks") == 0)


def risk_items(rows: DataFrame, *, min_frames: int = 2, max_changes: int = 1, max_ratio: float = 0.45) -> DataFrame:
    """video_id, track_id, type, amount (frames, or class changes), frame, jump_ratio: every reason for which a track is at risk."""
    none = {"amount": F.lit(None).cast("long"), "frame": F.lit(None).cast("int"), "jump_ratio": F.lit(None).cast("double")}
    kind = lambda df, name, **own: df.select(*KEYS, F.lit(name).alias("type"), *[own.get(c, v).alias(c) for c, v in none.items()])
    out = kind(short_tracks(rows, min_frames), "short_track", amount=F.col("frames"))
    out = out.unionByName(kind(class_drift(rows, max_changes), "class_drift", amount=F.col("changes")))
    return out.unionByName(kind(large_jumps(rows, max_ratio), "large_jump", frame=F.col("frame"), jump_ratio=F.col("jump_ratio")))


def risk_tracks(rows: DataFrame, **limits) -> DataFrame:
    return risk_items(rows, **limits).select(*KEYS).distinct()


def scene_ids(frames: DataFrame) -> DataFrame:
    """The number of scene changes up to each frame, its own included."""
    by = Window.partitionBy("video_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("scene_id", F.sum((F.col("reason") == "scene_change").cast("int")).over(by))


def interpolate_gaps(rows: DataFrame, max_gap: int = 6) -> DataFrame:
    """``rows`` with straight lines between observed boxes that are at most ``max_gap`` frames apart.

    ``box_source`` tells observed rows from predicted ones; without it all are observed.  Predicted rows on such a line take its box and are
    ``interpolated`` then; frames without a row get one with the attributes of the observed row before the gap.
    """
    if "box_source" not in rows.columns:
        rows = rows.withColumns({"box_source": F.lit("observed"), "is_predicted": F.lit(False)})
    seen, marks = F.col("box_source") == "observed", ("box_source", "is_predicted")
    others = [c for c in rows.columns if c not in (*KEYS, "frame", *g.SIDES, *marks)]
    upto = by_frame().rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*KEYS).orderBy(F.col("frame").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wide = rows.withColumns(
        {"l": F.last(F.when(seen, F.struct("frame", *g.SIDES, *others)), True).over(upto), "r": F.last(F.when(seen, F.struct("frame", *g.SIDES)), True).over(after), "n": F.lead("frame").over(by_frame())}
    )
    gap = F.col("r.frame") - F.col("l.frame") - 1
    inside = F.coalesce((gap > 0) & (gap <= max_gap), F.lit(False))
    at = lambda f: {s: F.col(f"l.{s}") + (F.col(f"r.{s}") - F.col(f"l.{s}")) * ((f - F.col("l.frame")) / (F.col("r.frame") - F.col("l.frame"))) for s in g.SIDES}
    mine = inside & ~seen
    own = wide.select(*KEYS, "frame", *others, *[F.when(mine, v).otherwise(F.col(s)).alias(s) for s, v in at(F.col("frame")).items()], F.when(mine, "interpolated").otherwise(F.col("box_source")).alias("box_source"), (mine | F.coalesce("is_predicted", F.lit(False))).alias("is_predicted"))
    fresh = wide.where(inside & (F.col("n") > F.col("frame") + 1)).withColumn("f", F.explode(F.sequence(F.col("frame") + 1, F.col("n") - 1)))
    fresh = fresh.select(*KEYS, F.col("f").alias("frame"), *[F.col(f"l.{c}").alias(c) for c in others], *[v.alias(s) for s, v in at(F.col("f")).items()], F.lit("interpolated").alias("box_source"), F.lit(True).alias("is_predicted"))
    return own.unionByName(fresh).select(*[c for c in rows.columns if c not in marks], *marks)


def trajectory_pivot(rows: DataFrame) -> DataFrame:
    """One row per track: its first class and a map from frame to box."""
    b = F.array(*g.box())
    return rows.groupBy(*KEYS).agg(F.min_by("class_name", "frame").alias("category"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame", b.alias("box"))))).alias("trajectory"))


def windows(videos: DataFrame, size: int = 30, stride: int = 15) -> DataFrame:
    """Sliding windows of ``videos(video_id, total_frames[, fps])``: window_id from 1, first and last frame and their times, frame_count.

    If the last window leaves frames over, one shorter window follows it.  Without fps a frame is a second.
    """
    n = F.col("total_frames")
    fps = F.greatest(F.lit(1), F.col("fps")) if "fps" in videos.columns else F.lit(1)
    regular = F.sequence(F.lit(0), F.greatest(F.lit(0), n - size), F.lit(stride))
    last = F.element_at(regular, -1)
    starts = F.when((last + size < n) & (last + stride < n), F.concat(regular, F.array(last + stride))).otherwise(regular)
    rows = videos.where("total_frames > 0").select("video_id", "total_frames", fps.alias("fps"), F.posexplode(starts).alias("at", "start_frame"))
    end = F.least(n - 1, F.col("start_frame") + size - 1)
    return rows.select("video_id", (F.col("at") + 1).alias("window_id"), "start_frame", end.alias("end_frame"), (F.col("start_frame") / F.col("fps")).alias("start_time"), (end / F.col("fps")).alias("end_time"), (end - F.col("start_frame") + 1).alias("frame_count"))


def first_windows(rows: DataFrame, most: int = 0) -> DataFrame:
    """The rows of the first ``most`` windows of each video; 0 takes all."""
    return rows.where(F.col("window_id") <= most) if most > 0 else rows


def assign_windows(rows: DataFrame, videos: DataFrame | int, size: int = 30, stride: int = 15) -> DataFrame:
    """Each row once for every window that holds its frame; window_id, start_frame and end_frame are those of ``windows``.

    ``videos`` gives each video's total_frames, or one number holds for all.  Frames outside a video are in no window.  Windows are
    arithmetic, so no range join is needed.
    """
    kept = rows.columns
    if isinstance(videos, DataFrame):
        rows, n = rows.join(videos.select("video_id", F.col("total_frames").alias("_total")), "video_id"), F.col("_total")
    else:
        n = F.lit(videos)
    regular = F.floor(F.greatest(F.lit(0), n - size) / stride)
    last = regular + F.when((regular * stride + size < n) & ((regular + 1) * stride < n), 1).otherwise(0)
    lo = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / stride))
    hi = F.least(last, F.floor(F.col("frame") / stride))
    at = F.explode(F.sequence(lo.cast("int"), hi.cast("int")))
    out = rows.where((F.col("frame") >= 0) & (F.col("frame") < n)).withColumn("_at", at)
    start = F.col("_at") * stride
    return out.select(*kept, (F.col("_at") + 1).alias("window_id"), start.alias("start_frame"), F.least(n - 1, start + size - 1).alias("end_frame"))


def frame_runs(rows: DataFrame, keys: tuple[str, ...], max_gap: int = 0) -> DataFrame:
    """Rows with the number of their run: a new one starts after more than ``max_gap`` missing frames."""
    order = Window.partitionBy(*keys).orderBy("frame")
    fresh = (F.col("frame") > F.lag("frame").over(order) + max_gap + 1).cast("int")
    return rows.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("run_id", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")
