"""Scoring relations against gold ones: tubes, their overlap, matching, and metrics.

Relations have rel_id, video_id, subject_id, predicate, object_id, start_frame, end_frame (inclusive) and score.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistra.functions import geometry as g
from vistra.operators import tracks as T
from vistra.sources.scratch import kept

TRIPLET = ("video_id", "s_cat", "predicate", "o_cat")


def spans(relations: DataFrame, tracks: DataFrame, classes: DataFrame) -> DataFrame:
    """``relations`` with s_cat and o_cat, null where a track has no box at all, and ``known``: whether both tracks are there."""
    there = tracks.select("video_id", "track_id").distinct().join(classes.select("video_id", "track_id", "class_name"), ["video_id", "track_id"])
    cat = lambda i, name: there.select("video_id", F.col("track_id").alias(i), F.col("class_name").alias(name))
    rows = relations.join(cat("subject_id", "s_cat"), ["video_id", "subject_id"], "left").join(cat("object_id", "o_cat"), ["video_id", "object_id"], "left")
    return rows.withColumn("known", F.col("s_cat").isNotNull() & F.col("o_cat").isNotNull())


def tube_frames(relations: DataFrame, tracks: DataFrame, classes: DataFrame) -> DataFrame:
    """The frames of each relation's span in which both tracks have boxes, with both boxes, categories and the number of the contiguous run.

    A span meets its tracks frame by frame, so a short relation of a long track costs its own length only.
    """
    side = lambda p, i: tracks.select("video_id", "frame", F.col("track_id").alias(i), *[F.col(c).alias(p + c) for c in g.SIDES])
    rows = spans(relations, tracks, classes).where("known and start_frame <= end_frame").drop("known")
    rows = rows.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame")))
    rows = rows.join(side("s_", "subject_id"), ["video_id", "subject_id", "frame"]).join(side("o_", "object_id"), ["video_id", "object_id", "frame"])
    return T.frame_runs(rows, ("video_id", "rel_id"), 0)


def projection_counts(relations: DataFrame, tracks: DataFrame, classes: DataFrame) -> DataFrame:
    """Per video: relations without one of their tracks, those without a common frame, runs beyond the first, and tubes."""
    runs = tube_frames(relations, tracks, classes).groupBy("video_id", "rel_id").agg((F.max("run_id") + 1).alias("runs"))
    rows = spans(relations, tracks, classes).join(runs, ["video_id", "rel_id"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    return rows.groupBy("video_id").agg(
        total((~F.col("known")).cast("int"), "skipped_missing_tracks"), total((F.col("known") & (F.col("runs") == 0)).cast("int"), "skipped_empty_tubes"),
        total(F.greatest(F.col("runs") - 1, F.lit(0)), "split_on_track_gaps"), total(F.col("runs"), "relation_count"),
    )


def tubes(frames: DataFrame) -> DataFrame:
    """One row for each contiguous run: its span (end exclusive) and both volumes, boxes counting their border pixels."""
    volume = lambda p: F.sum((F.col(p + "x2") - F.col(p + "x1") + 1) * (F.col(p + "y2") - F.col(p + "y1") + 1))
    return frames.groupBy(*TRIPLET, "rel_id", "run_id").agg(
        F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_excl"), F.max("score").alias("score"), volume("s_").alias("s_volume"), volume("o_").alias("o_volume")
    )


def tube_overlaps(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """p_rel, p_run, g_rel, g_run, viou: the lesser volume IoU of subject and object, for tubes of a video and triplet that share frames."""
    name = lambda df, p: df.select(*TRIPLET, "frame", *[F.col(c).alias(p + c) for c in ("rel_id", "run_id", *[q + x for q in ("s_", "o_") for x in g.SIDES])])
    both = name(predicted, "p_").join(name(gold, "g_"), [*TRIPLET, "frame"])

    def shared(p: str):
        w = F.least(F.col(f"p_{p}x2"), F.col(f"g_{p}x2")) - F.greatest(F.col(f"p_{p}x1"), F.col(f"g_{p}x1")) + 1
        h = F.least(F.col(f"p_{p}y2"), F.col(f"g_{p}y2")) - F.greatest(F.col(f"p_{p}y1"), F.col(f"g_{p}y1")) + 1
        return F.sum(F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h))

    keys = [*TRIPLET, "p_rel_id", "p_run_id", "g_rel_id", "g_run_id"]
    inter = both.groupBy(*keys).agg(shared("s_").alias("si"), shared("o_").alias("oi"))
    vol = lambda df, p: tubes(df).select(*TRIPLET, *[F.col(c).alias(p + c) for c in ("rel_id", "run_id", "s_volume", "o_volume")])
    rows = inter.join(vol(predicted, "p_"), [*TRIPLET, "p_rel_id", "p_run_id"]).join(vol(gold, "g_"), [*TRIPLET, "g_rel_id", "g_run_id"])
    iou = lambda i, v: F.col(i) / (F.col(f"p_{v}") + F.col(f"g_{v}") - F.col(i))
    return rows.select(*TRIPLET, F.col("p_rel_id").alias("p_rel"), F.col("p_run_id").alias("p_run"), F.col("g_rel_id").alias("g_rel"), F.col("g_run_id").alias("g_run"), F.least(iou("si", "s_volume"), iou("oi", "o_volume")).alias("viou"))


def greedy_match(candidates: DataFrame, group: tuple[str, ...], threshold: float) -> DataFrame:
    """group, pred, gold: each prediction in its order (``ord``) takes the best gold that is still free.

    ``candidates``: group, pred, ord, gold, g_ord, overlap.  Of equal overlaps the first gold wins.  Matching is
    separate for each group, and a group is the predictions of one triplet of one video.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "overlap", "g_ord"], ascending=[True, False, True], kind="stable")
        taken, served, out = set(), set(), []
        for i, (pred, gold) in enumerate(zip(pdf["pred"], pdf["gold"], strict=True)):
            if pred not in served and gold not in taken:
                served.add(pred)
                taken.add(gold)
                out.append(i)
        return pdf.iloc[out][[*group, "pred", "gold"]]

    rows = candidates.withColumn("overlap", F.round("overlap", 9)).where(F.col("overlap") >= threshold)
    kinds = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in (*group, "pred", "gold"))
    return rows.groupBy(*group).applyInPandas(run, kinds)


def official_match(predicted: DataFrame, gold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every predicted tube with its rank in its video and the gold tube that it takes, if any (tubes as ``rel-run``)."""
    name = lambda r, n: F.concat_ws("-", F.col(r), F.col(n).cast("string"))
    ranked = rank_predictions(tubes(predicted).withColumn("pred", name("rel_id", "run_id")))
    c = tube_overlaps(predicted, gold).select(*TRIPLET, name("p_rel", "p_run").alias("pred"), name("g_rel", "g_run").alias("gold"), F.col("viou").alias("overlap"))
    c = c.join(ranked.select("video_id", "pred", F.col("rank").alias("ord")), ["video_id", "pred"]).withColumn("g_ord", F.col("gold"))
    hits = greedy_match(c, TRIPLET, threshold).select("video_id", "pred", "gold")
    return ranked.join(hits, ["video_id", "pred"], "left")


def rank_predictions(rows: DataFrame) -> DataFrame:
    """rank within the video by falling score; ties keep the order of ``pred``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("score").desc(), "pred")))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    return rank_predictions(rows).where(F.col("rank") <= k)


def interpolated_ap(matched: DataFrame, gold_counts: DataFrame) -> DataFrame:
    """video_id, ap: area under the monotone envelope of precision over recall; videos without predictions have 0."""
    upto = Window.partitionBy("video_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = matched.join(gold_counts, "video_id").withColumn("hit", F.col("gold").isNotNull().cast("int"))
    rows = rows.withColumn("precision", F.sum("hit").over(upto) / F.col("rank"))
    best = F.max("precision").over(Window.partitionBy("video_id").orderBy("rank").rowsBetween(0, Window.unboundedFollowing))
    area = rows.withColumn("best", best).groupBy("video_id").agg(F.sum(F.col("hit") * F.col("best") / F.col("gold_count")).alias("ap"))
    return gold_counts.join(area, "video_id", "left").select("video_id", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def tagging(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Distinct triplets of each video by their best score, ``n`` from 1, whether gold has them, and the precision so far."""
    best = predicted.groupBy(*TRIPLET).agg(F.max("score").alias("score"))
    order = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "s_cat", "predicate", "o_cat")
    rows = best.withColumn("n", F.row_number().over(order)).join(gold.select(*TRIPLET, F.lit(1).alias("right")).distinct(), list(TRIPLET), "left")
    rows = rows.withColumn("right", F.coalesce("right", F.lit(0)))
    return rows.withColumn("precision", F.sum("right").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.col("n"))


def official_metrics(predicted: DataFrame, gold: DataFrame, *, threshold: float = 0.5, recalls=(50, 100), tags=(1, 5, 10)) -> DataFrame:
    """metric, value.  Videos without gold are left out; those without predictions count 0 everywhere.

    Both sides' frames are written once, since tubes, overlaps and tags all read them.
    """
    predicted, gold = kept(predicted, "predicted-frames"), kept(gold, "gold-frames")
    g_tubes = tubes(gold)
    counts = g_tubes.groupBy("video_id").agg(F.count(F.lit(1)).alias("gold_count"))
    matched = official_match(predicted, gold, threshold).join(counts.select("video_id"), "video_id", "left_semi")
    total = counts.agg(F.sum("gold_count").alias("total"))
    out = interpolated_ap(matched, counts).agg(F.avg("ap").alias("value")).select(F.lit("mAP").alias("metric"), "value")
    found = matched.agg(*[F.sum(((F.col("rank") <= k) & F.col("gold").isNotNull()).cast("int")).alias(f"R@{k}") for k in recalls]).crossJoin(total)
    out = out.unionByName(found.select(F.explode(F.array(*[F.struct(F.lit(f"R@{k}").alias("metric"), (F.coalesce(F.col(f"`R@{k}`"), F.lit(0)) / F.col("total")).alias("value")) for k in recalls])).alias("x")).select("x.*"))
    t = tagging(tubes(predicted), g_tubes)
    at = t.groupBy("video_id").agg(*[F.max_by("precision", F.when(F.col("n") <= k, F.col("n"))).alias(f"P@{k}") for k in tags])
    mean = counts.join(at, "video_id", "left").agg(*[F.avg(F.coalesce(F.col(f"`P@{k}`"), F.lit(0.0))).alias(f"P@{k}") for k in tags])
    return out.unionByName(mean.select(F.explode(F.array(*[F.struct(F.lit(f"P@{k}").alias("metric"), F.col(f"`P@{k}`").alias("value")) for k in tags])).alias("x")).select("x.*"))


def gold_supported_iou(predicted: DataFrame, gold: DataFrame, classes_p: DataFrame, classes_g: DataFrame) -> DataFrame:
    """video_id, category, gold_id, pred_id, iou for tracks of the same category that share a frame.

    Sums run over the gold track's frames only; one without a predicted box adds its area to the union.
    """
    name = lambda df, cl, i, p: df.select("video_id", F.col("track_id").alias(i), "frame", *[F.col(c).alias(p + c) for c in g.SIDES]).join(cl.select("video_id", F.col("track_id").alias(i), F.col("class_name").alias("category")), ["video_id", i])
    gg, pp = name(gold, classes_g, "gold_id", "g_"), name(predicted, classes_p, "pred_id", "p_")
    a, b = g.box("g_"), g.box("p_")
    inter = g.intersection(a, b)
    both = gg.join(pp, ["video_id", "category", "frame"]).groupBy("video_id", "category", "gold_id", "pred_id").agg(F.sum(inter).alias("i"), F.sum(g.area(b) - inter).alias("extra"))
    total = gg.groupBy("video_id", "gold_id").agg(F.sum(g.area(a)).alias("area"))
    return both.join(total, ["video_id", "gold_id"]).select("video_id", "category", "gold_id", "pred_id", (F.col("i") / (F.col("area") + F.col("extra"))).alias("iou"))


def align_tracks(ious: DataFrame, threshold: float = 0.3) -> DataFrame:
    """video_id, category, gold_id, pred_id, iou: the one-to-one alignment of the greatest summed IoU, then cut at ``threshold``.

    Categories do not mix, so each video and category is solved by itself.
    """
    from vistra.operators.assign import assign

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="gold_id", columns="pred_id", values="iou", fill_value=0.0).sort_index().sort_index(axis=1)
        rows, cols = assign(-table.to_numpy())
        out = pd.DataFrame({"gold_id": table.index[rows], "pred_id": table.columns[cols], "iou": table.to_numpy()[rows, cols]})
        return out[out["iou"] >= threshold].assign(video_id=pdf["video_id"].iloc[0], category=pdf["category"].iloc[0])[list(pdf.columns[:5])]

    rows = ious.select("video_id", "category", "gold_id", "pred_id", "iou")
    return rows.groupBy("video_id", "category").applyInPandas(run, rows.schema)


def diagnostic_match(predicted: DataFrame, gold: DataFrame, mapping: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every prediction with its rank over all videos, the gold ids of its tracks (null if not aligned) and the gold relation it takes, if any."""
    m = lambda i, n: mapping.select("video_id", F.col("pred_id").alias(i), F.col("gold_id").alias(n))
    rows = predicted.withColumn("pred", F.col("rel_id")).join(m("subject_id", "s"), ["video_id", "subject_id"], "left").join(m("object_id", "o"), ["video_id", "object_id"], "left")
    rows = rank_predictions(rows)
    target = gold.select("video_id", F.col("subject_id").alias("s"), "predicate", F.col("object_id").alias("o"), F.col("rel_id").alias("gold"), F.col("start_frame").alias("gs"), F.col("end_frame").alias("ge"))
    inter = F.greatest(F.lit(0), F.least("end_frame", "ge") + 1 - F.greatest("start_frame", "gs"))
    union = F.greatest("end_frame", "ge") + 1 - F.least("start_frame", "gs")
    c = rows.join(target, ["video_id", "s", "predicate", "o"]).select("video_id", "s", "predicate", "o", "pred", F.col("rank").alias("ord"), "gold", F.col("gold").alias("g_ord"), (inter / union).alias("overlap"))
    hits = greedy_match(c, ("video_id", "s", "predicate", "o"), threshold).select("video_id", "pred", "gold")
    return rows.join(hits, ["video_id", "pred"], "left")


#: Predictions that are ranked in one task, about.
SLICE_ROWS = 1_000_000


def running_hits(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` (score, video_id, pred, hit) with ``n``, the place by falling score within ``by``, and ``c``, the hits up to it.

    Ties stand by video_id and pred.  Rows are written once and cut into slices of scores, and of video ids within a score that fills a slice by itself; each
    slice is ranked by its own task, and the slices before it are added from a table of one row a slice.
    """
    score = F.coalesce("score", F.lit(float("-inf")))
    few = lambda c, k: F.percentile_approx(c, [(i + 1) / k for i in range(k - 1)], 10_000)
    rows = kept(rows, "ranked-rows")
    slices = min(1_000, rows.count() // SLICE_ROWS + 1)
    edges, ids = [], []
    if slices > 1:
        edges = sorted(set(rows.agg(few("score", slices)).collect()[0][0] or []))
        if dict(rows.dtypes)["video_id"] in ("int", "bigint"):
            ids = sorted(set(rows.agg(few("video_id", slices)).collect()[0][0] or []))
    above = lambda c, bounds: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > c)) if bounds else F.lit(0)
    at_edge = score.isin(edges) if edges else F.lit(False)
    rows = rows.withColumns({"_slice": 2 * above(score, edges) + at_edge.cast("int"), "_part": F.when(at_edge, len(ids) - above(F.col("video_id"), ids)).otherwise(0)})
    keys = [*by, "_slice", "_part"]
    own = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), "video_id", "pred").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("hit").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_slice", "_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_c")])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    ranked = rows.withColumns({"n": F.count(F.lit(1)).over(own), "c": F.sum("hit").over(own)})
    out = ranked.alias("r").join(sums.alias("s"), same)
    return out.select(*[F.col(f"r.{c}") for c in rows.columns if c not in ("_slice", "_part")], (F.col("n") + F.col("s._n")).alias("n"), (F.col("c") + F.col("s._c")).alias("c"))


def scoped(gold: DataFrame, *done: DataFrame) -> DataFrame:
    """The gold rows of the videos of any of the tables ``done``: a partial run is scored on what it processed."""
    ids = [x.select("video_id") for x in done]
    for x in ids[1:]:
        ids[0] = ids[0].unionByName(x)
    return gold.join(ids[0].distinct(), "video_id", "left_semi")


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` with the ``split`` of their predicate by ``splits(predicate, split)``; ``unknown`` where it has none."""
    return rows.join(F.broadcast(splits.select("predicate", "split")), "predicate", "left").withColumn("split", F.coalesce("split", F.lit("unknown")))


def macro_ap(per_predicate: DataFrame) -> DataFrame:
    """The mean ap of the predicates of ``summary`` that gold has."""
    return per_predicate.where("tp + fn > 0").agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("macro_ap"))


def track_alignment(mapping: DataFrame, gold_tracks: DataFrame, predicted_tracks: DataFrame) -> DataFrame:
    """One row: gold, predicted and matched tracks, recall of gold ones, and the mean IoU of the matched."""
    n = lambda df: df.select("video_id", "track_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    m = mapping.agg(F.count(F.lit(1)).alias("matched"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))
    row = n(gold_tracks).withColumnRenamed("n", "gold").crossJoin(n(predicted_tracks).withColumnRenamed("n", "predicted")).crossJoin(m)
    return row.withColumn("recall", F.when(F.col("gold") > 0, F.col("matched") / F.col("gold")).otherwise(0.0))


def summary(matched: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and ap (precision at each hit over the gold count) by the columns ``by``."""
    rows = running_hits(matched.withColumn("hit", F.col("gold").isNotNull().cast("int")), *by).withColumn("p", F.col("c") / F.col("n"))
    got = rows.groupBy(*by).agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("n"), F.sum(F.col("hit") * F.col("p")).alias("s"))
    want = gold.groupBy(*by).agg(F.count(F.lit(1)).alias("gold_count"))
    both = got.join(want, list(by), "full") if by else got.crossJoin(want)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tp, n, total = zero("tp"), zero("n"), zero("gold_count")
    precision, recall = F.when(n > 0, tp / n).otherwise(F.lit(0.0)), F.when(total > 0, tp / total).otherwise(F.lit(0.0))
    out = both.select(*by, tp.alias("tp"), (n - tp).alias("fp"), F.greatest(F.lit(0), total - tp).alias("fn"), precision.alias("precision"), recall.alias("recall"), F.when(total > 0, F.coalesce("s", F.lit(0.0)) / total).otherwise(F.lit(0.0)).alias("ap"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, f1).otherwise(F.lit(0.0)))


def recall_at_k(matched: DataFrame, gold: DataFrame, ks=(50, 100)) -> DataFrame:
    """k, recall.  The first k predictions of a video match as they do in the whole list."""
    hits = matched.agg(*[F.sum(((F.col("rank") <= k) & F.col("gold").isNotNull()).cast("int")).alias(str(k)) for k in ks])
    rows = hits.crossJoin(gold.agg(F.count(F.lit(1)).alias("total")))
    return rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.coalesce(F.col(f"`{k}`"), F.lit(0)) / F.greatest("total", F.lit(1))).alias("recall")) for k in ks])).alias("x")).select("x.*")


def tagging_at_k(matched: DataFrame, gold: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """k, precision: over distinct tags of aligned tracks, averaged over videos that have any."""
    tags = matched.where("s is not null and o is not null").groupBy("video_id", "s", "predicate", "o").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("video_id").orderBy("first")
    rows = tags.withColumn("n", F.row_number().over(order)).join(gold.select("video_id", F.col("subject_id").alias("s"), "predicate", F.col("object_id").alias("o"), F.lit(1).alias("right")).distinct(), ["video_id", "s", "predicate", "o"], "left")
    per = rows.groupBy("video_id").agg(*[F.avg(F.when(F.col("n") <= k, F.coalesce("right", F.lit(0)))).alias(str(k)) for k in ks])
    mean = per.agg(*[F.coalesce(F.avg(F.col(f"`{k}`")), F.lit(0.0)).alias(str(k)) for k in ks])
    return mean.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("precision")) for k in ks])).alias("x")).select("x.*")


def errors(matched: DataFrame, gold: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` unmatched predictions and missed gold relations: error_type, rel_id."""
    wrong = matched.where("gold is null").select(F.lit("false_positive").alias("error_type"), F.col("pred").alias("rel_id"), F.col("score"))
    missed = gold.join(matched.where("gold is not null").select(F.col("gold").alias("rel_id")), "rel_id", "left_anti").select(F.lit("false_negative").alias("error_type"), "rel_id", F.lit(None).cast("double").alias("score"))
    return wrong.unionByName(missed).orderBy(F.col("error_type").desc(), F.col("score").desc_nulls_last(), "rel_id").limit(most).select("error_type", "rel_id")


def coverage(requested: DataFrame, predicted: DataFrame) -> DataFrame:
    """video_id, state: videos that were asked for and are missing, that have no relation, or that are extra."""
    have = predicted.groupBy("video_id").agg(F.count("rel_id").alias("n"))
    missing = requested.join(have, "video_id", "left_anti").select("video_id", F.lit("missing").alias("state"))
    extra = have.join(requested, "video_id", "left_anti").select("video_id", F.lit("extra").alias("state"))
    return missing.unionByName(extra).unionByName(have.join(requested, "video_id", "left_semi").where("n = 0").select("video_id", F.lit("empty").alias("state")))
