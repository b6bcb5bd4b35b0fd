"""The whole chain for all videos at once: detections to verified relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistra.functions import ontology as O
from vistra.operators import actions as A
from vistra.operators import detections as D
from vistra.operators import evidence as E
from vistra.operators import relations as R
from vistra.operators import routing
from vistra.operators import tracking as K
from vistra.operators import tracks as T
from vistra.plans.config import Config
from vistra.sources.scratch import kept


def track(detections: DataFrame, config: Config) -> DataFrame:
    """Tracks with voted classes and filled gaps from detections with video_id, scene_id, frame, event_id, class_name, score and box."""
    c = config.tracking
    boxes = D.valid_boxes(detections, min_area=config.detection.min_area, most=config.detection.max_per_frame)
    boxes = boxes.withColumns({"class_group": F.col("class_name"), "det_id": F.col("event_id")})
    found = K.track_objects(boxes, least_iou=c.min_iou, max_age=c.max_age, min_hits=c.min_hits, delta=c.delta, inertia=c.inertia)
    rows = found.select("video_id", "scene_id", "frame", "det_id", "track_id").join(boxes.select("video_id", "det_id", "class_name", "score", "x1", "y1", "x2", "y2"), ["video_id", "det_id"])
    return T.interpolate_gaps(T.recent_class_vote(rows, c.vote_window).withColumn("class_name", F.col("voted_class")).drop("voted_class", "weight"), c.interpolate)


def rules(tracks: DataFrame, videos: DataFrame | int, config: Config) -> DataFrame:
    c, t = config.rules, config.tracking
    return R.rule_relations(tracks, videos, max_gap=c.max_gap, min_votes=c.min_votes, min_evidence=c.min_evidence, min_observed=c.min_observed, size=t.window, stride=t.stride, near_ratio=c.near_ratio, axis_margin=c.axis_margin, overlap=c.overlap)


def packets(tracks: DataFrame, videos: DataFrame | int, config: Config) -> DataFrame:
    """What a model is asked: evidence, candidates and frames of each direction of each pair and window."""
    spark = tracks.sparkSession
    pairs = T.first_windows(T.assign_windows(R.pair_frames(tracks), videos, config.tracking.window, config.tracking.stride), config.semantic.max_windows)
    features = E.features(E.samples(pairs)).where(F.col("frame_count") >= config.semantic.min_pair_frames)
    ranked = routing.ranked_predicates(features, O.predicates(spark), O.family_members(spark), O.GEOMETRIC)
    return E.packets(features, routing.route(ranked, O.siblings(spark), config.semantic.candidates))


def merge(sources: list[DataFrame]) -> DataFrame:
    """Relations of several sources, in order, merged and clustered over windows."""
    columns = [*R.KEY, "segment_id", "evidence_frames", "rule_support", "agent_score", "ranking_score", "score_kind", "source"]
    kinds = {"rule_support": "double", "agent_score": "double", "ranking_score": "double", "score_kind": "string", "source": "string"}
    rows = None
    for n, df in enumerate(sources):
        df = df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})
        df = df.select(*columns, F.struct(F.lit(n).alias("source_order"), F.col("segment_id").alias("segment")).alias("ord"))
        rows = df if rows is None else rows.unionByName(df)
    rows = rows.withColumns({"confidence": F.lit(None).cast("double"), "source": F.coalesce("source", F.lit("unknown"))})
    return R.merge(rows).withColumns({"confidence": F.lit(None).cast("double"), "ord": F.col("segment_id")})


def verify(relations: DataFrame, reviews: DataFrame | None, classes: DataFrame, constraints: DataFrame, config: Config) -> DataFrame:
    """Reviews, then exclusions, categories, scores and - if asked for - inverses."""
    spark = relations.sparkSession
    out = relations.withColumns({"source": F.element_at("sources", 1), "confidence": F.lit(None).cast("double")})
    if reviews is not None:
        checked = A.validate_reviews(reviews, out, O.predicates(spark)).where("accepted")
        out = R.resolve_conflicts(A.apply_reviews(out, checked), O.mutex(spark))
    out = R.category_filter(out, classes, constraints).where("allowed").drop("allowed", "subject_class", "object_class")
    out = R.export_filter(out, config.verify.min_export)
    return R.add_coupling(out, O.inverses(spark)) if config.verify.coupling else out.withColumn("coupled", F.lit(False))


def run(detections: DataFrame, videos: DataFrame | int, config: Config, *, semantic: DataFrame | None = None, reviews: DataFrame | None = None, constraints: DataFrame | None = None) -> DataFrame:
    """Detections to relations.  ``videos``: video_id, total_frames, or one length of all; ``semantic``: relations that a model proposed; ``reviews``: its review actions."""
    spark = detections.sparkSession
    tracks = kept(track(detections, config), "tracks")
    sources = [rules(tracks, videos, config).withColumns({"score_kind": F.lit("rule_support"), "source": F.lit("window_geometry")})]
    sources += [semantic] if semantic is not None else []
    c = config.clustering
    found = R.clusters(merge(sources), max_gap=c.max_gap, max_evidence_gap=c.max_evidence_gap)
    none = spark.createDataFrame([], "predicate string, subject_categories array<string>, object_categories array<string>")
    return verify(found, reviews, T.main_class(tracks), constraints if constraints is not None else none, config)
