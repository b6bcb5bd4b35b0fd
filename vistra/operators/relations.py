"""Relations between tracks: evidence from geometry, merging, clustering, conflicts and checks.

A relation row has video_id, subject_id, predicate, object_id, start_frame, end_frame (inclusive), evidence_frames and
scores: rule_support, agent_score, ranking_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistra.functions import geometry as g
from vistra.operators import tracks as T

KEY = ("video_id", "subject_id", "predicate", "object_id", "start_frame", "end_frame")
PAIR_SPAN = ("video_id", "subject_id", "object_id", "start_frame", "end_frame")


def box_weight(source: Column, interpolated: float = 0.75, predicted: float = 0.25) -> Column:
    return F.when(source == "observed", 1.0).when(source == "interpolated", interpolated).otherwise(predicted)


def pair_frames(rows: DataFrame) -> DataFrame:
    """Each frame of each unordered pair of tracks that are visible together, with both boxes."""
    kept = ["box_source", "class_name", *g.SIDES]
    side = lambda p, i: rows.select("video_id", "frame", F.col("track_id").alias(i), *[F.col(c).alias(p + c) for c in kept])
    return side("s_", "a").join(side("o_", "b"), ["video_id", "frame"]).where("a < b")


def geometry_votes(pairs: DataFrame, *, near_ratio: float = 0.35, axis_margin: float = 0.08, overlap: float = 0.05) -> DataFrame:
    """video_id, frame, a, b, weight, observed, and ``forward`` and ``backward``: predicates of a about b and of b about a."""
    s, o = g.box("s_"), g.box("o_")
    (sx, sy), (ox, oy) = g.center(s), g.center(o)
    scale = F.greatest(F.lit(1.0), F.sqrt(F.greatest(g.area(s), g.area(o))))
    margin = F.greatest(F.lit(8.0), axis_margin * F.col("scale"))
    near = (g.length(F.col("dx"), F.col("dy")) <= near_ratio * F.col("scale")) | (g.iou_plain(s, o) >= overlap)
    said = lambda lo_x, hi_x, lo_y, hi_y: F.array_compact(F.array(F.when(F.col("dx") < -F.col("margin"), lo_x).when(F.col("dx") > F.col("margin"), hi_x), F.when(F.col("dy") < -F.col("margin"), lo_y).when(F.col("dy") > F.col("margin"), hi_y), F.when(F.col("near"), "next_to")))
    weight = F.least(box_weight(F.col("s_box_source")), box_weight(F.col("o_box_source")))
    rows = pairs.withColumns({"dx": sx - ox, "dy": sy - oy, "scale": scale, "weight": weight, "observed": ((F.col("s_box_source") == "observed") & (F.col("o_box_source") == "observed")).cast("int")})
    rows = rows.where("weight > 0").withColumn("margin", margin).withColumn("near", near)
    return rows.select("video_id", "frame", "a", "b", "weight", "observed", said("left", "right", "above", "beneath").alias("forward"), said("right", "left", "beneath", "above").alias("backward"))


def rule_relations(rows: DataFrame, videos: DataFrame | int, *, max_gap: int = 0, min_votes: float = 0.6, min_evidence: int = 2, min_observed: int = 1, size: int = 30, stride: int = 15, **margins) -> DataFrame:
    """Runs of frames in which geometry supports a predicate, window by window; ``videos`` gives each video's total_frames, or a number holds for all.

    rule_support is the weight of the supporting frames over that of all frames of the pair within the run.  Votes are computed once
    for each frame, before windows repeat it; the run's total is a difference of running sums, so nothing is joined back.
    """
    votes = T.assign_windows(geometry_votes(pair_frames(rows), **margins), videos, size, stride)
    pair = Window.partitionBy("video_id", "window_id", "a", "b")
    upto = pair.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    votes = votes.withColumns({"upto": F.sum("weight").over(upto), "both": F.sum("observed").over(pair)}).where(F.col("both") >= min_observed)
    sides = F.array(F.struct(F.col("a").alias("subject_id"), F.col("b").alias("object_id"), F.col("forward").alias("said")), F.struct(F.col("b").alias("subject_id"), F.col("a").alias("object_id"), F.col("backward").alias("said")))
    kept = ["video_id", "window_id", "frame", "weight", "upto"]
    said = votes.select(*kept, F.explode(sides).alias("d")).select(*kept, "d.subject_id", "d.object_id", F.explode("d.said").alias("predicate"))
    keys = ("video_id", "window_id", "subject_id", "object_id", "predicate")
    runs = T.frame_runs(said, keys, max_gap).groupBy(*keys, "run_id").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("support"),
        (F.max("upto") - F.min(F.col("upto") - F.col("weight"))).alias("total"), F.array_sort(F.collect_list("frame")).alias("evidence_frames"),
    )
    ratio = F.col("support") / F.greatest(F.lit(1e-9), F.col("total"))
    out = runs.where((F.col("n") >= min_evidence) & (ratio >= min_votes))
    return out.select("video_id", F.col("window_id").alias("segment_id"), "subject_id", "predicate", "object_id", "start_frame", "end_frame", "evidence_frames", F.bround(ratio, 4).alias("rule_support"))


def ranking_score(clamp: bool = True, *more: str) -> Column:
    """The first score there is: ranking, agent, rule, confidence; 0 where there is none."""
    first = F.coalesce(*[F.col(c) for c in ("ranking_score", "agent_score", "rule_support", "confidence", *more)], F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), first)) if clamp else first


def normalize_span(rows: DataFrame, convention: str = "span_convention") -> DataFrame:
    """start_frame and end_excl (half-open) of spans in either convention; unmarked ones are inclusive, reversed ones are turned round."""
    lo, hi = F.least("start_frame", "end_frame"), F.greatest("start_frame", "end_frame")
    half_open = F.coalesce(F.col(convention), F.lit("inclusive")) == "half_open"
    return rows.withColumns({"start_frame": lo, "end_excl": hi + F.when(half_open, 0).otherwise(1)})


def merge(rows: DataFrame) -> DataFrame:
    """One row per key from several sources, ``ord`` telling their order.

    The first row gives what is no score; scores are the highest; score_kind stays if all agree; sources stand in
    order, evidence is united.
    """
    first = F.min_by("segment_id", "ord").alias("segment_id")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "source")))
    kinds = F.collect_set("score_kind")
    return rows.groupBy(*KEY).agg(
        F.max("rule_support").alias("rule_support"), F.max("agent_score").alias("agent_score"), F.max(ranking_score()).alias("ranking_score"),
        F.when(F.size(kinds) == 1, F.max("score_kind")).otherwise("mixed_ranking").alias("score_kind"), F.array_distinct(F.transform(ordered, lambda x: x["source"])).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_frames")))).alias("evidence_frames"), first,
    )


def add_coupling(rows: DataFrame, inverses: DataFrame) -> DataFrame:
    """``rows`` and, for each with an inverse that is not there yet, the inverse relation; ``coupled`` tells which is which."""
    inv = rows.join(F.broadcast(inverses), "predicate")
    mirrored = inv.withColumns({"subject_id": F.col("object_id"), "object_id": F.col("subject_id"), "predicate": F.col("inverse"), "sources": F.array_union("sources", F.array(F.lit("coupling")))})
    fresh = mirrored.drop("inverse").join(rows.select(*KEY), list(KEY), "left_anti").dropDuplicates(list(KEY))
    return rows.withColumn("coupled", F.lit(False)).unionByName(fresh.withColumn("coupled", F.lit(True)))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` of text fields (subject_track_id or subject_id, and so on) with a typed KEY; rows whose ids are no numbers or whose predicate is blank go.

    A missing start is 0, a missing end the start.
    """
    number = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns], F.lit(None).cast("string")).try_cast("long")
    out = rows.withColumns({"_s": number("subject_track_id", "subject_id"), "_o": number("object_track_id", "object_id"), "_p": F.lower(F.trim(F.coalesce("predicate", F.lit(""))))})
    out = out.withColumn("_st", F.coalesce(F.col("start_frame").try_cast("int"), F.lit(0))).withColumn("_en", F.coalesce(F.col("end_frame").try_cast("int"), F.col("_st")))
    bad = (F.col("start_frame").isNotNull() & F.col("start_frame").try_cast("int").isNull()) | (F.col("end_frame").isNotNull() & F.col("end_frame").try_cast("int").isNull())
    out = out.where(F.col("_s").isNotNull() & F.col("_o").isNotNull() & (F.col("_p") != "") & ~bad)
    names = ("subject_track_id", "object_track_id", *KEY[1:])
    return out.select(*[c for c in rows.columns if c not in names], F.col("_s").alias("subject_id"), F.col("_p").alias("predicate"), F.col("_o").alias("object_id"), F.col("_st").alias("start_frame"), F.col("_en").alias("end_frame"))


def add_inverses(rows: DataFrame, inverses: DataFrame) -> DataFrame:
    """The coupling of relations that have ids: an inverse is told from its origin by ``-inv`` at its id, its source and what it is the inverse of."""
    out = add_coupling(rows.withColumn("inverse_of", F.lit(None).cast("string")), inverses)
    made = F.col("coupled")
    return out.withColumns({"inverse_of": F.when(made, F.col("relation_id")), "relation_id": F.when(made, F.concat("relation_id", F.lit("-inv"))).otherwise(F.col("relation_id")), "source": F.when(made, "coupling").otherwise(F.col("source"))})


def clusters(rows: DataFrame, *, max_gap: int = 1, max_evidence_gap: int = 4) -> DataFrame:
    """Relations of the same pair and predicate put together over windows.

    In order of their spans, a relation opens a new cluster if it starts more than max_gap after the cluster's end, or if its evidence starts
    more than max_evidence_gap after the cluster's last.  Both ends are those of the cluster, so the order is folded, pair by pair.
    """
    evidence = F.when(F.size("evidence_frames") > 0, F.array_sort("evidence_frames")).otherwise(F.array_distinct(F.array("start_frame", "end_frame")))
    item = F.struct("start_frame", "end_frame", "ord", F.col("ev").alias("evidence_frames"), "rule_support", "agent_score", ranking_score().alias("ranking_score"), "sources", "segment_id")
    rows = rows.withColumn("ev", evidence)
    group = ("video_id", "subject_id", "predicate", "object_id")
    state = F.struct(F.lit(-1).alias("end"), F.lit(-1).alias("ev_end"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("ids"))

    def fold(s: Column, x: Column) -> Column:
        first, last = F.element_at(x["evidence_frames"], 1), F.element_at(x["evidence_frames"], -1)
        fresh = (s["n"] < 0) | (x["start_frame"] > s["end"] + max_gap) | (first > s["ev_end"] + max_evidence_gap)
        n = s["n"] + fresh.cast("int")
        end = F.when(fresh, x["end_frame"]).otherwise(F.greatest(s["end"], x["end_frame"]))
        ev_end = F.when(fresh, last).otherwise(F.greatest(s["ev_end"], last))
        return F.struct(end.cast("int").alias("end"), ev_end.cast("int").alias("ev_end"), n.alias("n"), F.concat(s["ids"], F.array(n)).alias("ids"))

    folded = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("ids", F.aggregate("items", state, fold, lambda s: s["ids"]))
    flat = folded.select(*group, F.explode(F.arrays_zip("items", "ids")).alias("z")).select(*group, F.col("z.ids").alias("cluster"), "z.items.*")
    out = flat.groupBy(*group, "cluster").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_frames")))).alias("evidence_frames"),
        F.bround(F.max("rule_support"), 4).alias("rule_support"), F.bround(F.max("agent_score"), 4).alias("agent_score"), F.bround(F.max("ranking_score"), 4).alias("ranking_score"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "ord", "sources"))), lambda x: x["sources"]))).alias("sources"),
        F.count(F.lit(1)).alias("segment_count"), F.transform(F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", "ord", "segment_id"))), lambda x: x["segment_id"]).alias("segment_ids"),
    )
    kind = F.when(F.col("rule_support").isNotNull() & F.col("agent_score").isNotNull(), "mixed_ranking").when(F.col("rule_support").isNotNull(), "rule_support").when(F.col("agent_score").isNotNull(), "agent_ranking").otherwise("legacy_confidence")
    return with_ids(out.drop("cluster").withColumn("score_kind", kind))


def with_ids(rows: DataFrame) -> DataFrame:
    """relation_id r000001 and so on, in each video by span, subject, predicate and object."""
    order = Window.partitionBy("video_id").orderBy("start_frame", "end_frame", "subject_id", "predicate", "object_id")
    return rows.withColumn("relation_id", F.format_string("r%06d", F.row_number().over(order)))


def conflicts(rows: DataFrame, mutex: DataFrame) -> DataFrame:
    """Pairs and spans that hold two predicates which exclude each other: the key, p and q."""
    sets = rows.groupBy(*PAIR_SPAN).agg(F.collect_set("predicate").alias("preds"))
    return sets.where(F.size("preds") > 1).join(F.broadcast(mutex), F.array_contains("preds", F.col("p")) & F.array_contains("preds", F.col("q"))).drop("preds")


def resolve_conflicts(rows: DataFrame, mutex: DataFrame) -> DataFrame:
    """``rows`` less, of two excluding predicates of a pair and span, the one with the lower score; of equal ones the first by name stays."""
    scores = rows.groupBy(*PAIR_SPAN, "predicate").agg(F.max(ranking_score()).alias("score"))
    named = lambda name: scores.withColumnsRenamed({"predicate": name, "score": f"score_{name}"})
    both = conflicts(rows, mutex).join(named("p"), [*PAIR_SPAN, "p"]).join(named("q"), [*PAIR_SPAN, "q"])
    lost = both.select(*PAIR_SPAN, F.when(F.col("score_p") >= F.col("score_q"), F.col("q")).otherwise(F.col("p")).alias("predicate"))
    return rows.join(lost, [*PAIR_SPAN, "predicate"], "left_anti")


def deletions(rows: DataFrame, mutex: DataFrame) -> DataFrame:
    """The rows that ``resolve_conflicts`` takes away, as actions: KEY, action, reason, ranking_score."""
    scores = rows.groupBy(*PAIR_SPAN, "predicate").agg(F.max(ranking_score()).alias("score"))
    named = lambda name: scores.withColumnsRenamed({"predicate": name, "score": f"score_{name}"})
    both = conflicts(rows, mutex).join(named("p"), [*PAIR_SPAN, "p"]).join(named("q"), [*PAIR_SPAN, "q"])
    first = F.col("score_p") >= F.col("score_q")
    lost = both.select(*PAIR_SPAN, F.when(first, F.col("q")).otherwise(F.col("p")).alias("predicate"), F.when(first, F.col("p")).otherwise(F.col("q")).alias("_kept"))
    reason = F.concat(F.lit("mutex conflict; keep "), F.col("_kept"))
    return rows.join(lost, [*PAIR_SPAN, "predicate"]).select(*KEY, F.lit("delete").alias("action"), reason.alias("reason"), ranking_score().alias("ranking_score"))


def verify_report(before: DataFrame, allowed: DataFrame, after: DataFrame, mutex: DataFrame, *, low: float = 0.45, examples: int = 20) -> DataFrame:
    """One row per video of ``before``: counts by source, low scores with the first ``examples`` of them, conflicts, and what the filters took.

    ``before``: relations as they came; ``allowed``: those that passed the category filter; ``after``: those that passed the score filter too.
    """
    name = F.concat_ws(" ", F.col("subject_id").cast("string"), F.col("predicate"), F.col("object_id").cast("string"), F.col("start_frame").cast("string"), F.col("end_frame").cast("string"))
    rows = before.withColumns({"_source": F.concat_ws(",", "sources"), "_low": ranking_score() < low, "_name": name})
    by = rows.groupBy("video_id", "_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_low").cast("int")).alias("low"))
    counts = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("_source", "n"))), lambda x: F.concat(x["_source"], F.lit("="), x["n"].cast("string"))))
    out = by.groupBy("video_id").agg(F.sum("n").alias("relations"), counts.alias("source_counts"), F.sum("low").alias("low_scores"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame", "end_frame", "subject_id", "predicate", "object_id"))
    shown = rows.where("_low").withColumn("_place", place).where(F.col("_place") <= examples)
    shown = shown.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_name"))), lambda x: x["_name"]).alias("low_examples"))
    n = lambda df, c: df.groupBy("video_id").agg(F.count(F.lit(1)).alias(c))
    out = out.join(n(conflicts(before, mutex), "conflicts"), "video_id", "left").join(n(allowed, "_allowed"), "video_id", "left").join(n(after, "kept"), "video_id", "left").join(shown, "video_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns({"conflicts": zero("conflicts"), "filtered_by_category": F.col("relations") - zero("_allowed"), "filtered_by_score": zero("_allowed") - zero("kept"), "kept": zero("kept"), "low_examples": F.coalesce("low_examples", F.array().cast("array<string>"))})
    return out.withColumn("passed", (F.col("conflicts") == 0) & (F.col("filtered_by_category") == 0)).drop("_allowed")


def review_items(rows: DataFrame, mutex: DataFrame, risky: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Relations for review with their reasons: a low score, a risky track, or - where neither holds - a conflict."""
    c = conflicts(rows, mutex).select(*PAIR_SPAN, F.explode(F.array("p", "q")).alias("predicate")).distinct().withColumn("conflict", F.lit(True))
    r = risky.select("video_id", "track_id").distinct()
    side = lambda name: r.select("video_id", F.col("track_id").alias(f"{name}_id"), F.lit(True).alias(f"risk_{name}"))
    out = rows.join(c, [*PAIR_SPAN, "predicate"], "left").join(side("subject"), ["video_id", "subject_id"], "left").join(side("object"), ["video_id", "object_id"], "left")
    low, risk = ranking_score() < threshold, F.coalesce("risk_subject", "risk_object", F.lit(False))
    reasons = F.array_compact(F.array(F.when(low, "low_ranking_score"), F.when(risk, "risky_track")))
    reasons = F.when(F.size(reasons) > 0, reasons).when(F.col("conflict"), F.array(F.lit("conflict")))
    return out.withColumn("review_reasons", reasons).where("review_reasons is not null").drop("conflict", "risk_subject", "risk_object")


def category_allowed(actual: Column, allowed: Column) -> Column:
    """Whether a class is in a list that may hold the wild cards any, object, animal and vehicle; no list allows all."""
    has = lambda word: F.array_contains(allowed, F.lit(word))
    return (
        allowed.isNull() | (F.size(allowed) == 0) | has("any") | F.array_contains(allowed, actual) | (has("object") & ~actual.isin("person", "unknown"))
        | (has("animal") & actual.isin("dog", "cat", "horse")) | (has("vehicle") & actual.isin("bicycle", "car", "skateboard", "surfboard"))
    )


def category_filter(rows: DataFrame, classes: DataFrame, constraints: DataFrame) -> DataFrame:
    """``rows`` with ``allowed``: whether both classes fit the predicate's constraints (predicate, subject_categories, object_categories)."""
    side = lambda name: classes.select("video_id", F.col("track_id").alias(f"{name}_id"), F.col("class_name").alias(f"{name}_class"))
    out = rows.join(side("subject"), ["video_id", "subject_id"], "left").join(side("object"), ["video_id", "object_id"], "left").join(F.broadcast(constraints), "predicate", "left")
    fits = lambda name: category_allowed(F.coalesce(f"{name}_class", F.lit("unknown")), F.col(f"{name}_categories"))
    return out.withColumn("allowed", fits("subject") & fits("object")).drop("subject_categories", "object_categories")


def export_filter(rows: DataFrame, least: float = 0.0) -> DataFrame:
    return rows.where(ranking_score() >= least) if least > 0 else rows
