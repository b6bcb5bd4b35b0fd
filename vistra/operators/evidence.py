"""What a pair of tracks shows over a window: features, events, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistra.functions import geometry as g

PACKET = ("video_id", "window_id", "subject_id", "object_id")


def visible_pairs(pairs: DataFrame, least: int = 2) -> DataFrame:
    """video_id, window_id, a, b, n: pairs that are visible together in at least ``least`` frames of a window."""
    return pairs.groupBy("video_id", "window_id", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def top_pairs(visible: DataFrame, most: int = 0) -> DataFrame:
    """With ``rank``, and ``deferred``: whether a pair lies beyond the first ``most`` of its window (0: none does)."""
    order = Window.partitionBy("video_id", "window_id").orderBy(F.col("n").desc(), "a", "b")
    rank = F.row_number().over(order)
    return visible.withColumn("rank", rank).withColumn("deferred", F.col("rank") > most if most > 0 else F.lit(False))


def rule_pair_cap(pairs: DataFrame, window_tracks: DataFrame, most: int = 0, most_tracks: int = 0) -> DataFrame:
    """The rows of ``pairs`` that are among the first ``most`` unordered pairs of their window, in the order of its tracks, with that ``rank``.

    ``window_tracks(video_id, window_id, track_id)`` has every track of a window, once; pairs that are never visible together take a place
    too.  Only its first ``most_tracks`` tracks count; 0 sets no bound.  The place follows from the two tracks' own, so no pairs are listed.
    """
    by = Window.partitionBy("video_id", "window_id")
    at = F.row_number().over(by.orderBy("track_id")) - 1
    places = window_tracks.select("video_id", "window_id", "track_id", at.alias("_at"), F.count(F.lit(1)).over(by).alias("_n"))
    if most_tracks > 0:
        places = places.where(F.col("_at") < most_tracks).withColumn("_n", F.least("_n", F.lit(most_tracks)))
    side = lambda c: places.select("video_id", "window_id", F.col("track_id").alias(c), F.col("_at").alias(f"_{c}"), F.col("_n").alias(f"_n{c}"))
    rows = pairs.join(side("a"), ["video_id", "window_id", "a"]).join(side("b"), ["video_id", "window_id", "b"])
    rank = F.col("_a") * F.col("_na") - F.col("_a") * (F.col("_a") + 1) / 2 + F.col("_b") - F.col("_a")
    rows = rows.withColumn("rank", rank.cast("long")).drop("_a", "_b", "_na", "_nb")
    return rows.where(F.col("rank") <= most) if most > 0 else rows


def coverage(ranked: DataFrame) -> DataFrame:
    """Candidate, processed and deferred pairs of each window."""
    return ranked.groupBy("video_id", "window_id").agg(F.count(F.lit(1)).alias("candidates"), F.sum((~F.col("deferred")).cast("int")).alias("processed"), F.sum(F.col("deferred").cast("int")).alias("deferred"))


def joint_sources(pairs: DataFrame) -> DataFrame:
    """Joint and jointly observed frames of a pair in a window, and how often each pair of box sources occurs."""
    kinds = pairs.groupBy("video_id", "window_id", "a", "b", F.concat_ws("/", "s_box_source", "o_box_source").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("kind", "n")))
    return kinds.groupBy("video_id", "window_id", "a", "b").agg(F.sum("n").alias("joint_frames"), F.coalesce(F.sum(F.when(F.col("kind") == "observed/observed", F.col("n"))), F.lit(0)).alias("observed_frames"), F.map_from_entries(entries).alias("source_pairs"))


def samples(pairs: DataFrame) -> DataFrame:
    """Per frame and direction: offsets, distances and overlap in units of the pair's scale."""
    side = lambda p, q: [*[F.col(f"{p}_{c}").alias(f"s_{c}") for c in ("box_source", *g.SIDES)], *[F.col(f"{q}_{c}").alias(f"o_{c}") for c in ("box_source", *g.SIDES)]]
    both = pairs.select("video_id", "window_id", "frame", F.col("a").alias("subject_id"), F.col("b").alias("object_id"), *side("s", "o"))
    both = both.unionByName(pairs.select("video_id", "window_id", "frame", F.col("b").alias("subject_id"), F.col("a").alias("object_id"), *side("o", "s")))
    s, o = g.box("s_"), g.box("o_")
    (sx, sy), (ox, oy) = g.center(s), g.center(o)
    scale = F.sqrt(F.greatest(g.area_clamped(s), g.area_clamped(o)))
    out = both.withColumns({"sx": sx, "sy": sy, "ox": ox, "oy": oy, "scale": scale, "size_ratio": g.area_clamped(s) / g.area_clamped(o), "iou": g.iou_clamped(s, o), "gap": g.edge_gap(s, o), "seen": ((F.col("s_box_source") == "observed") & (F.col("o_box_source") == "observed")).cast("int")})
    out = out.withColumns({"dx": (F.col("sx") - F.col("ox")) / F.col("scale"), "dy": (F.col("sy") - F.col("oy")) / F.col("scale"), "distance": g.length(F.col("sx") - F.col("ox"), F.col("sy") - F.col("oy")) / F.col("scale"), "edge_gap": F.col("gap") / F.col("scale")})
    return out.select(*PACKET, "frame", "sx", "sy", "ox", "oy", "scale", "dx", "dy", "distance", "edge_gap", "size_ratio", "iou", "seen")


def features(rows: DataFrame) -> DataFrame:
    """The evidence of each direction of a pair in a window, from its ``samples``; medians are exact, missing ones 0."""
    order = Window.partitionBy(*PACKET).orderBy("frame")
    before = lambda c: F.lag(c).over(order)
    df = F.col("frame") - before("frame")
    scale = (F.col("scale") + before("scale")) / 2
    speed = {f"v_{c}": (F.col(c) - before(c)) / scale / df for c in ("sx", "sy", "ox", "oy")}
    rows = rows.withColumns(speed | {"rate": (before("distance") - F.col("distance")) / df})
    rows = rows.withColumns({"s_speed": g.length(F.col("v_sx"), F.col("v_sy")), "o_speed": g.length(F.col("v_ox"), F.col("v_oy"))})
    cosine = (F.col("v_sx") * F.col("v_ox") + F.col("v_sy") * F.col("v_oy")) / (F.col("s_speed") * F.col("o_speed"))
    rows = rows.withColumn("cosine", F.when((F.col("s_speed") > 0) & (F.col("o_speed") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    mid = lambda c: F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0))
    nearest, closest = F.min_by("frame", F.struct("distance", "frame")), F.min_by("frame", F.struct(-F.col("iou"), "frame"))
    change = F.min_by("frame", F.when(F.col("rate").isNotNull(), F.struct(-F.abs("rate"), "frame")))
    events = F.array_sort(F.array_distinct(F.array_compact(F.array(nearest, closest, F.when(F.max(F.abs("rate")) > 1e-6, change)))))
    return rows.groupBy(*PACKET).agg(
        F.count(F.lit(1)).alias("frame_count"), F.avg("seen").alias("observed_pair_ratio"), mid("dx").alias("median_dx"), mid("dy").alias("median_dy"), F.min_by("distance", "frame").alias("distance_start"),
        F.max_by("distance", "frame").alias("distance_end"), F.min("distance").alias("distance_min"), F.min("edge_gap").alias("edge_gap_min"), F.max("iou").alias("iou_max"), mid("rate").alias("approach_rate"),
        mid("s_speed").alias("subject_speed"), mid("o_speed").alias("object_speed"), mid(F.abs("rate")).alias("relative_motion"), mid("cosine").alias("motion_alignment"), mid("size_ratio").alias("size_ratio"),
        ((F.min("dx") < 0) & (F.max("dx") > 0)).alias("crosses_horizontal_axis"), events.alias("event_frames"), F.array_sort(F.collect_list("frame")).alias("frames"),
    )


def event_sample(rows: DataFrame, most: int = 8, burst: int = 5) -> DataFrame:
    """``rows`` (frames, event_frames: lists) with ``sample``: frames about the events first, then evenly spaced ones, at most ``most``, in order."""
    radius = max(0, burst // 2)
    n = F.size("frames")
    size = F.least(F.lit(max(1, most)), n)
    around = F.flatten(F.transform("event_frames", lambda e: F.sequence(e - radius, e + radius)))
    near = F.filter(around, lambda f: F.array_contains("frames", f))
    place = lambda i: F.bround((n - 1) * i / F.greatest(size - 1, F.lit(1))).cast("int") + 1
    even = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.element_at("frames", place(i)))
    pick = F.array_sort(F.slice(F.array_distinct(F.concat(near, even)), 1, F.least(F.lit(most), n)))
    return rows.withColumn("sample", F.when(n > 0, pick).otherwise(F.array().cast("array<int>")))


def packets(features: DataFrame, routed: DataFrame) -> DataFrame:
    """One nested row for each direction: its evidence, candidates in order, and the frames to show."""
    return event_sample(features).join(routed.select(*PACKET, "candidates"), list(PACKET))


def pair_batches(visible: DataFrame, size: int = 6) -> DataFrame:
    """Windows of the same pair in chunks of ``size``, in order."""
    order = Window.partitionBy("video_id", "a", "b").orderBy("window_id")
    return visible.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size))


def crop_boxes(pairs: DataFrame, width: int, height: int, share: float = 0.4) -> DataFrame:
    """The pixels about both boxes, with ``share`` of their extent on each side, inside the frame."""
    s, o = g.box("s_"), g.box("o_")
    x1, y1, x2, y2 = F.least(s[0], o[0]), F.least(s[1], o[1]), F.greatest(s[2], o[2]), F.greatest(s[3], o[3])
    w, h = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    low = lambda v: F.greatest(F.lit(0), v.cast("int"))
    return pairs.select("video_id", "frame", "a", "b", low(x1 - share * w).alias("left_x"), low(y1 - share * h).alias("top_y"), F.least(F.lit(width), (x2 + share * w).cast("int")).alias("right_x"), F.least(F.lit(height), (y2 + share * h).cast("int")).alias("bottom_y"))


def annotatable(pairs: DataFrame, least: int = 30) -> DataFrame:
    """Ordered pairs with at least ``least`` common frames."""
    n = pairs.groupBy("video_id", "a", "b").agg(F.count(F.lit(1)).alias("common_frames")).where(F.col("common_frames") >= least)
    both = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))
    return n.select("video_id", F.explode(both).alias("d"), "common_frames").select("video_id", F.col("d.s").alias("subject_id"), F.col("d.o").alias("object_id"), "common_frames")
