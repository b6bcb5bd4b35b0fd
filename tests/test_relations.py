"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from vistra.functions import ontology as O
from vistra.operators import actions, detections, evaluation, evidence, relations, routing, tracking, tracks
from vistra.operators.evidence import PACKET

BOX = "x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], f"video_id long, track_id long, frame int, box_source string, class_name string, {BOX}")


def test_rules_give_one_span(spark):
    rows = [(t, f, "observed" if f == 0 else "interpolated", "dog", x, 0.0, x + 10, 10.0) for f in range(3) for t, x in ((1, 0.0), (2, 30.0))]
    got = {(r.subject_id, r.predicate, r.object_id): r for r in relations.rule_relations(boxes(spark, rows), 3).collect()}
    r = got[1, "left", 2]
    assert (r.start_frame, r.end_frame, r.evidence_frames, r.rule_support) == (0, 2, [0, 1, 2], 1.0)
    assert (2, "right", 1) in got


def test_rules_split_where_support_breaks(spark):
    xs = (30.0, 30.0, 5.0, 30.0, 30.0)
    rows = [(t, f, "observed", "dog", x, 0.0, x + 10, 10.0) for f, o in enumerate(xs) for t, x in ((1, 0.0), (2, o))]
    got = relations.rule_relations(boxes(spark, rows), 5).where("subject_id = 1 and predicate = 'left'").collect()
    assert sorted((r.start_frame, r.end_frame) for r in got) == [(0, 1), (3, 4)]
    wide = relations.rule_relations(boxes(spark, rows), 5, max_gap=1).where("subject_id = 1 and predicate = 'left'").collect()
    assert [(r.start_frame, r.end_frame, r.rule_support) for r in wide] == [(0, 4, 0.8)]


def rel(spark, rows):
    schema = "video_id long, subject_id long, predicate string, object_id long, start_frame int, end_frame int, evidence_frames array<int>, rule_support double, agent_score double, ranking_score double, confidence double, score_kind string, source string, sources array<string>, segment_id int, ord int"
    return spark.createDataFrame([(0, s, p, o, a, b, ev, rs, ag, None, cf, k, src, [src], n, n) for n, (s, p, o, a, b, ev, rs, ag, cf, k, src) in enumerate(rows)], schema)


def test_coupling_and_its_inverse(spark):
    one = rel(spark, [(1, "left", 2, 0, 10, [0], None, None, 0.8, "x", "a")])
    out = relations.add_coupling(one, O.inverses(spark)).collect()
    assert {(r.subject_id, r.predicate, r.object_id, r.coupled) for r in out} == {(1, "left", 2, False), (2, "right", 1, True)}
    again = relations.add_coupling(relations.add_coupling(one, O.inverses(spark)).drop("coupled"), O.inverses(spark))
    assert again.count() == 2


def test_clusters(spark):
    def spans(rows, **kw):
        out = relations.clusters(rel(spark, [(1, "follow", 2, a, b, ev, 0.5, None, None, "k", "s") for a, b, ev in rows]), **kw).orderBy("relation_id").collect()
        return [(r.start_frame, r.end_frame, r.segment_count, r.relation_id) for r in out]

    assert spans([(0, 29, []), (15, 44, [])]) == [(0, 44, 2, "r000001")]
    assert [x[:2] for x in spans([(0, 10, [0]), (5, 15, [15])])] == [(0, 10), (5, 15)]
    three = [(0, 50, [0]), (5, 10, [10]), (12, 14, [12])]
    assert [x[:2] for x in spans(three)] == [(0, 50), (5, 10), (12, 14)] == [x[:2] for x in spans(three[::-1])]


def test_merge_keeps_scores_apart(spark):
    rows = [(1, "left", 2, 0, 3, [1], 0.8, None, None, "rule_support", "a"), (1, "left", 2, 0, 3, [2], None, 0.6, None, "agent_ranking", "b")]
    (r,) = relations.merge(rel(spark, rows)).collect()
    assert (r.rule_support, r.agent_score, r.ranking_score, r.score_kind, r.sources, r.evidence_frames) == (0.8, 0.6, 0.8, "mixed_ranking", ["a", "b"], [1, 2])


def test_mutex_keeps_the_stronger_or_the_first_by_name(spark):
    rows = [(1, "left", 2, 0, 3, [1], 0.5, None, None, "k", "a"), (1, "right", 2, 0, 3, [1], 0.9, None, None, "k", "a"), (3, "above", 4, 0, 3, [1], 0.5, None, None, "k", "a"), (3, "beneath", 4, 0, 3, [1], 0.5, None, None, "k", "a")]
    kept = relations.resolve_conflicts(rel(spark, rows), O.mutex(spark)).collect()
    assert sorted(r.predicate for r in kept) == ["above", "right"]


def test_interpolation(spark):
    rows = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 2, 10.0, 0.0, 20.0, 10.0), (0, 1, 20, 0.0, 0.0, 10.0, 10.0)], f"video_id long, track_id long, frame int, {BOX}")
    out = {r.frame: r for r in tracks.interpolate_gaps(rows, 4).collect()}
    assert set(out) == {0, 1, 2, 20}
    assert (out[1].x1, out[1].x2, out[1].box_source, out[1].is_predicted) == (5.0, 15.0, "interpolated", True)
    assert out[2].box_source == "observed"


@pytest.mark.parametrize("n,size,stride,want", [(4, 3, 2, [(0, 2), (2, 3)]), (3, 30, 15, [(0, 2)]), (120, 30, 15, None), (100, 30, 15, None), (31, 30, 15, None)])
def test_windows_and_their_assignment(spark, n, size, stride, want):
    w = tracks.windows(spark.createDataFrame([(0, n)], "video_id long, total_frames int"), size, stride).orderBy("window_id").collect()
    spans = [(r.start_frame, r.end_frame) for r in w]
    assert want is None or spans == want
    assert spans[-1][1] == n - 1
    got = tracks.assign_windows(spark.range(n).select(F.col("id").cast("int").alias("frame")), n, size, stride).collect()
    assert sorted((r.window_id, r.frame) for r in got) == sorted((i, f) for i, (a, b) in enumerate(spans, 1) for f in range(a, b + 1))
    assert [r.window_id for r in w] == list(range(1, len(w) + 1))


def test_each_video_has_windows_of_its_own_length(spark):
    videos = spark.createDataFrame([(0, 4, 2), (1, 100, 25), (2, 0, 25)], "video_id long, total_frames int, fps int")
    w = tracks.windows(videos, 30, 15).orderBy("video_id", "window_id").collect()
    assert [(r.video_id, r.start_frame, r.end_frame, r.frame_count) for r in w][0] == (0, 0, 3, 4) and (w[0].start_time, w[0].end_time) == (0.0, 1.5)
    rows = videos.where("total_frames > 0").select("video_id", F.explode(F.sequence(F.lit(0), F.lit(120))).alias("frame"))
    got = tracks.assign_windows(rows, videos, 30, 15).collect()
    assert sorted((r.video_id, r.window_id, r.frame) for r in got) == sorted((r.video_id, r.window_id, f) for r in w for f in range(r.start_frame, r.end_frame + 1))
    assert {(r.video_id, r.window_id, r.start_frame, r.end_frame) for r in got} == {(r.video_id, r.window_id, r.start_frame, r.end_frame) for r in w}
    assert {r.window_id for r in tracks.first_windows(tracks.windows(videos), 2).collect()} == {1, 2}


def test_interpolation_overwrites_predicted_rows(spark):
    rows = [(0, 1, f, float(x), 0.0, x + 10.0, 10.0, s, s != "observed") for f, x, s in [(0, 0, "observed"), (1, 99, "predicted"), (3, 30, "observed"), (4, 70, "predicted"), (9, 0, "observed")]]
    frame = spark.createDataFrame(rows, f"video_id long, track_id long, frame int, {BOX}, box_source string, is_predicted boolean")
    out = {r.frame: (r.x1, r.box_source, r.is_predicted) for r in tracks.interpolate_gaps(frame, 2).collect()}
    assert out == {0: (0.0, "observed", False), 1: (10.0, "interpolated", True), 2: (20.0, "interpolated", True), 3: (30.0, "observed", False), 4: (70.0, "predicted", True), 9: (0.0, "observed", False)}
    jumps = tracks.large_jumps(frame).collect()
    assert {r.frame for r in jumps} == {3, 9}  # predicted rows are passed over
    kinds = sorted((r.type, r.frame) for r in tracks.risk_items(frame.withColumn("class_name", F.lit("dog")), min_frames=9).collect() if r.type == "large_jump")
    assert kinds == [("large_jump", 3), ("large_jump", 9)]


def test_continuity_and_quality(spark):
    rows = [(3, 0, "observed", "dog", 0.0, 0.0, 10.0, 10.0), (3, 1, "interpolated", "dog", 0.0, 0.0, 10.0, 10.0), (3, 4, "observed", "dog", 0.0, 0.0, 10.0, 10.0), (1, 0, "observed", "dog", 0.0, 0.0, 10.0, 10.0)]
    c = {r.track_id: r for r in tracks.continuity(boxes(spark, rows)).collect()}[3]
    assert (c.segments, c.max_gap, c.coverage_ratio, c.observed_ratio, c.interpolation_ratio) == (2, 2, 0.6, 0.4, 0.3333)
    (q,) = tracks.quality(boxes(spark, rows)).collect()
    assert (q.short_tracks, q.risk_tracks, q.passed) == (1, 1, False)


def test_evidence_of_an_approaching_pair(spark):
    rows = [(t, f, "observed", "dog", x, 0.0, x + 12, 20.0) for f in range(6) for t, x in ((1, 8.0 * f), (2, 48.0))]
    pairs = tracks.assign_windows(relations.pair_frames(boxes(spark, rows)), 6)
    feats = evidence.features(evidence.samples(pairs)).cache()
    e = {(r.subject_id, r.object_id): r for r in evidence.event_sample(feats).collect()}
    assert e[1, 2].median_dx < 0 < e[2, 1].median_dx and e[1, 2].approach_rate > 0 and 5 in e[1, 2].event_frames
    few = {(r.subject_id, r.object_id): r.sample for r in evidence.event_sample(feats, most=5).collect()}
    assert len(few[1, 2]) == 5 and few[1, 2] == sorted(few[1, 2])
    ranked = routing.ranked_predicates(feats, O.predicates(spark), O.family_members(spark), O.GEOMETRIC)
    names = routing.route(ranked, O.siblings(spark)).where("subject_id = 1").first().candidates
    assert len(names) <= 14 and "toward" in names and not set(names) & set(O.GEOMETRIC)
    assert set(PACKET) <= set(feats.columns)


def test_anchors(spark):
    t = spark.createDataFrame([(0, f, 0.0) for f in range(7)], "video_id long, frame int, thumb double")
    assert sorted(r.frame for r in detections.anchor_schedule(t, mode="fixed_sparse").collect()) == [0, 3, 6]


def test_reviews_by_id(spark):
    base = relations.with_ids(rel(spark, [(1, "left", 2, 0, 10, [2, 8], 0.5, None, None, "k", "a"), (1, "follow", 2, 0, 10, [5], 0.5, None, None, "k", "a")]))
    schema = "relation_id string, ord int, action string, reason string, new_predicate string, new_start int, new_end int, evidence_frames array<int>"
    acts = [("r000002", 1, "change_predicate", "x", "touch", None, None, None), ("r000002", 2, "refine_interval", "x", "", 2, 8, [2, 8]), ("r000002", 3, "refine_interval", "x", "", -1, 11, [2]), ("r9", 4, "reject_relation", "x", "", None, None, None), ("r000001", 5, "reject_relation", "", "", None, None, None), ("r000001", 6, "refine_interval", "x", "", None, 3, [5])]
    checked = actions.validate_reviews(spark.createDataFrame(acts, schema), base, O.predicates(spark))
    assert {r.ord: r.reject_reason for r in checked.collect()} == {1: None, 2: None, 3: "interval_outside_relation_evidence", 4: "unsupported_action_or_relation", 5: "missing_reason", 6: "invalid_interval"}
    out = {r.relation_id: r for r in actions.apply_reviews(base, checked.where("accepted")).collect()}
    assert (out["r000002"].predicate, out["r000002"].start_frame, out["r000002"].end_frame) == ("touch", 2, 8)
    assert out["r000001"].predicate == "follow" and out["r000001"].source == "a"


def test_ontology():
    assert len(O.PREDICATES) == 132 and len(O.OBJECTS) == 35
    assert O.components("walk_next_to") == ("walk", "next_to", "") and O.components("fall_off") == ("fall_off", "", "")
    assert O.components("taller") == ("", "", "taller") and O.components("levitate") == ("levitate", "", "")
    assert all(O.components(n) != (n, "", "") or n in O.ACTIONS for n in O.PREDICATES)


def gold_and_predictions(spark):
    tube = f"rel_id string, video_id string, predicate string, score double, frame int, run_id long, s_cat string, o_cat string, s_x1 double, s_y1 double, s_x2 double, s_y2 double, o_x1 double, o_y1 double, o_x2 double, o_y2 double"
    make = lambda name, video, score, at: [(name, video, "left", score, f, 0, "dog", "cat", at, 0.0, at + 9, 9.0, at, 0.0, at + 9, 9.0) for f in (0, 1)]
    gold = spark.createDataFrame(make("ga", "a", 0.0, 0.0) + make("gb", "b", 0.0, 0.0), tube)
    return gold, spark.createDataFrame(make("p1", "a", 0.9, 500.0) + make("p2", "a", 0.8, 0.0), tube)


def test_official_protocol(spark):
    gold, predicted = gold_and_predictions(spark)
    got = {r.metric: r.value for r in evaluation.official_metrics(predicted.withColumn("s_cat", F.when(F.col("rel_id") == "p1", "cow").otherwise("dog")), gold, tags=(1, 5)).collect()}
    assert got == {"mAP": 0.25, "R@50": 0.5, "R@100": 0.5, "P@1": 0.0, "P@5": 0.25}
    same = {r.metric: r.value for r in evaluation.official_metrics(gold, gold).collect()}
    assert same["mAP"] == 1.0


def test_volume_iou(spark):
    gold, predicted = gold_and_predictions(spark)
    o = evaluation.tube_overlaps(gold, gold).collect()
    assert [r.viou for r in o] == [1.0, 1.0]
    assert evaluation.tube_overlaps(predicted.where("rel_id = 'p1'"), gold).first().viou == 0.0


def test_gold_supported_iou_uses_gold_frames_only(spark):
    box = lambda t, frames: spark.createDataFrame([(0, t, f, 0.0, 0.0, 10.0, 10.0) for f in frames], f"video_id long, track_id long, frame int, {BOX}")
    cls = lambda t: spark.createDataFrame([(0, t, "dog")], "video_id long, track_id long, class_name string")
    (r,) = evaluation.gold_supported_iou(box(7, range(11)), box(1, (0, 10)), cls(7), cls(1)).collect()
    assert r.iou == 1.0
    (a,) = evaluation.align_tracks(spark.createDataFrame([(0, "dog", 1, 7, 1.0), (0, "dog", 1, 8, 0.9)], "video_id long, category string, gold_id long, pred_id long, iou double")).collect()
    assert (a.gold_id, a.pred_id) == (1, 7)


def test_tracker_keeps_ids_and_emits_confirmed_rows(spark):
    rows = [(0, 0, "dog", f, f, 10.0 + 2 * f, 0.0, 60.0 + 2 * f, 50.0) for f in range(5)] + [(0, 0, "dog", 2, 90, 500.0, 0.0, 550.0, 50.0)]
    out = tracking.track_objects(spark.createDataFrame(rows, f"video_id long, scene_id int, class_group string, frame int, det_id long, {BOX}")).collect()
    assert sorted(r.frame for r in out) == [0, 1, 2, 3, 4] and {r.track_id for r in out} == {1}


def test_stitching_links_within_a_scene(spark):
    emb = [1.0, 0.0]
    rows = [(0, 0, 1, 0, 5, "dog", emb, 0.0, 10.0, 0.0), (0, 0, 2, 10, 15, "dog", emb, 2.0, 12.0, 0.0), (0, 1, 3, 70, 75, "dog", emb, 2.0, 12.0, 0.0)]
    flat = [(v, s, i, a, b, c, e, x, 0.0, y, 10.0, x, 0.0, y, 10.0, z, z, z, z) for v, s, i, a, b, c, e, x, y, z in rows]
    cols = ", ".join(f"{p}_{c} double" for p in ("first", "last", "v") for c in ("x1", "y1", "x2", "y2"))
    pieces = spark.createDataFrame(flat, f"video_id long, scene_id int, piece_id long, start_frame int, end_frame int, class_name string, embedding array<double>, {cols}")
    out = {r.piece_id: r.head_id for r in tracking.stitch(tracking.stitch_edges(pieces), pieces).collect()}
    assert out == {1: 1, 2: 1, 3: 3}
