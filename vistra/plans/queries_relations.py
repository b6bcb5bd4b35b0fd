"""Queries over pairs and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistra.functions import geometry as g
from vistra.functions import ontology as O
from vistra.operators import labels
from vistra.operators import relations as R
from vistra.operators import tracks as T
from vistra.plans.queries_tracks import INTERP_SQL, LENGTHS_SQL, MIXED_SQL, lengths, mixed
from vistra.plans.registry import query, r6, with_obs
from vistra.sources import fixture


def filled(s, d):
    return T.interpolate_gaps(fixture.obs(s, d))


def rules(s, d, gap=0):
    return R.rule_relations(filled(s, d), fixture.FRAMES, max_gap=gap)


INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
PAIRS_SQL = f"""pf AS (SELECT video_id, frame, a, b, least(wa, wb) AS weight, observed, dx, dy, scale, greatest(8, 0.08 * scale) AS margin,
  (sqrt(dx * dx + dy * dy) <= 0.35 * scale OR inter / un >= 0.05) AS near FROM (
  SELECT a.video_id, a.frame, a.track_id AS a, b.track_id AS b, CASE a.box_source WHEN 'observed' THEN 1.0::DOUBLE WHEN 'interpolated' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS wa, CASE b.box_source WHEN 'observed' THEN 1.0::DOUBLE WHEN 'interpolated' THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS wb,
    (a.box_source = 'observed' AND b.box_source = 'observed')::INT AS observed, (a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2 AS dx, (a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2 AS dy,
    greatest(1.0, sqrt(greatest((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)))) AS scale, {INTER} AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {INTER} AS un
  FROM it a JOIN it b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id)),
pw AS (SELECT pf.*, w.window_id FROM pf JOIN range(1, 8) w(window_id) ON pf.frame BETWEEN (w.window_id - 1) * 15 AND (w.window_id - 1) * 15 + 29)"""


def rules_sql(gap: int = 0, name: str = "rr") -> str:
    p = name
    return f"""{p}_d AS (SELECT video_id, window_id, frame, weight, observed, a AS s, b AS o, dx, dy, margin, near FROM pw UNION ALL SELECT video_id, window_id, frame, weight, observed, b, a, -dx, -dy, margin, near FROM pw),
{p}_e AS (SELECT video_id, window_id, frame, weight, s, o, unnest(list_filter([CASE WHEN dx < -margin THEN 'left' WHEN dx > margin THEN 'right' END, CASE WHEN dy < -margin THEN 'above' WHEN dy > margin THEN 'beneath' END, CASE WHEN near THEN 'next_to' END], lambda x: x IS NOT NULL)) AS p FROM {p}_d),
{p}_n AS (SELECT *, CASE WHEN frame > lag(frame) OVER w + {gap} + 1 THEN 1 ELSE 0 END AS fresh FROM {p}_e WINDOW w AS (PARTITION BY video_id, window_id, s, o, p ORDER BY frame)),
{p}_r AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, window_id, s, o, p ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM {p}_n),
{p}_g AS (SELECT video_id, window_id, s, p, o, run, min(frame) AS st, max(frame) AS en, count(*) AS n, sum(weight) AS support, list(frame ORDER BY frame) AS ev FROM {p}_r GROUP BY ALL),
{p}_ok AS (SELECT video_id, window_id, s, o FROM {p}_d GROUP BY ALL HAVING sum(observed) >= 1),
{p}_t AS (SELECT g.video_id, g.window_id, g.s, g.p, g.o, g.run, sum(d.weight) AS total FROM {p}_g g JOIN {p}_d d ON d.video_id = g.video_id AND d.window_id = g.window_id AND d.s = g.s AND d.o = g.o AND d.frame BETWEEN g.st AND g.en GROUP BY ALL),
{p} AS (SELECT g.video_id, g.window_id::INT AS segment_id, g.s, g.p, g.o, g.st, g.en, g.ev, round_even(support / greatest(1e-9, total), 4) AS rule_support
  FROM {p}_g g JOIN {p}_t t USING (video_id, window_id, s, p, o, run) JOIN {p}_ok USING (video_id, window_id, s, o) WHERE g.n >= 2 AND support / greatest(1e-9, total) >= 0.6)"""


CHAIN = f", {INTERP_SQL}, {PAIRS_SQL}, {rules_sql()}"
_RULE_OUT = "video_id, segment_id, s AS subject_id, p AS predicate, o AS object_id, st AS start_frame, en AS end_frame, array_to_string(ev, ',') AS evidence_frames, rule_support"


def _over_lengths(pairs: str) -> str:
    return pairs[: pairs.index("pw AS (")] + f"{LENGTHS_SQL}, pw AS (SELECT pf.*, vw.window_id FROM pf JOIN vw ON vw.video_id = pf.video_id AND frame BETWEEN st AND least(n - 1, st + 29))"


def _text(c):
    return F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)


@query(with_obs(f", {INTERP_SQL}, {PAIRS_SQL} SELECT video_id, frame, a, b, weight, observed, CASE WHEN near THEN 1 ELSE 0 END AS near FROM pf"))
def pair_frames(s, d):
    v = R.geometry_votes(R.pair_frames(filled(s, d)))
    return v.select("video_id", "frame", "a", "b", "weight", "observed", F.array_contains("forward", "next_to").cast("int").alias("near"))


@query(with_obs(f"{CHAIN} SELECT {_RULE_OUT} FROM rr"))
def rule_relations(s, d):
    return rules(s, d).withColumn("evidence_frames", _text("evidence_frames"))


@query(with_obs(f", {INTERP_SQL}, {PAIRS_SQL}, {rules_sql(3)} SELECT {_RULE_OUT} FROM rr"))
def rule_relations_gap3(s, d):
    return rules(s, d, 3).withColumn("evidence_frames", _text("evidence_frames"))


@query(with_obs(f"""
SELECT a.video_id, a.frame, a.track_id AS a, b.track_id AS b,
  round(CASE WHEN aa + ba - i > 0 THEN i / (aa + ba - i) ELSE 0 END, 6)+0.0 AS iou_plain, round(i / greatest(1e-6, greatest(1, a.x2-a.x1)*greatest(1, a.y2-a.y1) + greatest(1, b.x2-b.x1)*greatest(1, b.y2-b.y1) - i), 6)+0.0 AS iou_clamped,
  round(i / greatest(1e-6, aa + ba - i), 6)+0.0 AS iou_eps, round(sqrt(pow(greatest(a.x1-b.x2, b.x1-a.x2, 0), 2) + pow(greatest(a.y1-b.y2, b.y1-a.y2, 0), 2)), 6)+0.0 AS edge_gap,
  round(sqrt(pow((a.x1+a.x2)/2-(b.x1+b.x2)/2, 2) + pow((a.y1+a.y2)/2-(b.y1+b.y2)/2, 2)) / sqrt(greatest(1, aa)), 6)+0.0 AS center_scaled
FROM (SELECT a.*, (x2-x1)*(y2-y1) AS aa FROM obs a) a JOIN (SELECT b.*, (x2-x1)*(y2-y1) AS ba FROM obs b) b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id, LATERAL (SELECT {INTER} AS i)"""))
def pair_iou(s, d):
    p = R.pair_frames(fixture.obs(s, d).withColumn("box_source", F.lit("observed")))
    a, b = g.box("s_"), g.box("o_")
    return p.select("video_id", "frame", "a", "b", r6(g.iou_plain(a, b)).alias("iou_plain"), r6(g.iou_clamped(a, b)).alias("iou_clamped"), r6(g.iou_eps(a, b)).alias("iou_eps"), r6(g.edge_gap(a, b)).alias("edge_gap"), r6(g.center_distance_scaled(a, b)).alias("center_scaled"))


@query(with_obs(f""", {INTERP_SQL}, {PAIRS_SQL}, c AS (SELECT video_id, window_id, a, b, count(*) AS n FROM pw GROUP BY ALL)
SELECT * FROM c WHERE n >= 2"""))
def pair_visibility(s, d):
    return visible_pairs(s, d)


def visible_pairs(s, d, least=2):
    from vistra.operators import evidence as E

    return E.visible_pairs(T.assign_windows(R.pair_frames(filled(s, d)), fixture.FRAMES), least)


#: Relations of three sources: rules, model answers for some of them, and contradictions.
REL_SQL = """rel AS (
  SELECT video_id, s, p, o, st, en, segment_id, segment_id AS ord, 'window_geometry' AS source, 'rule_support' AS kind, ev, rule_support AS rs, NULL::DOUBLE AS ag FROM rr UNION ALL
  SELECT video_id, s, p, o, st, en, segment_id, 100 + segment_id, 'window_semantic_vl', 'agent_ranking', list_distinct([st, en]), NULL, round(0.3 + ((s + o) % 5) * 0.1, 4) FROM rr WHERE (s + o + st) % 3 = 0 UNION ALL
  SELECT video_id, s, 'right', o, st, en, segment_id, 200 + segment_id, 'window_semantic_vl', 'agent_ranking', list_distinct([st, en]), NULL, 0.35 FROM rr WHERE p = 'left' AND (s + en) % 4 = 0),
mr AS (SELECT video_id, s, p, o, st, en, max(rs) AS rs, max(ag) AS ag, max(coalesce(ag, rs)) AS rk, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) ELSE 'mixed_ranking' END AS kind,
  CASE WHEN count(DISTINCT source) = 1 THEN [max(source)] ELSE ['window_geometry', 'window_semantic_vl'] END AS sources, list_sort(list_distinct(flatten(list(ev)))) AS ev, arg_min(segment_id, ord) AS segment_id FROM rel GROUP BY video_id, s, p, o, st, en)"""
MERGED = f"{CHAIN}, {REL_SQL}"
_KEY_OUT = "video_id, s AS subject_id, p AS predicate, o AS object_id, st AS start_frame, en AS end_frame"


def sources_of(s, d):
    """Relations of three sources, as ``REL_SQL`` has them."""
    r = rules(s, d)
    none = F.lit(None).cast("double")
    short = F.array_distinct(F.array("start_frame", "end_frame"))
    score = F.round(0.3 + ((F.col("subject_id") + F.col("object_id")) % 5) * 0.1, 4)
    base = ["video_id", "subject_id", "predicate", "object_id", "start_frame", "end_frame", "segment_id"]
    model = lambda df, at, value: df.select(*base, (F.col("segment_id") + at).alias("ord"), F.lit("window_semantic_vl").alias("source"), F.lit("agent_ranking").alias("score_kind"), short.alias("evidence_frames"), none.alias("rule_support"), value.alias("agent_score"))
    own = r.select(*base, F.col("segment_id").alias("ord"), F.lit("window_geometry").alias("source"), F.lit("rule_support").alias("score_kind"), "evidence_frames", "rule_support", none.alias("agent_score"))
    answers = model(r.where("(subject_id + object_id + start_frame) % 3 = 0"), 100, score)
    against = model(r.where("predicate = 'left' and (subject_id + end_frame) % 4 = 0").withColumn("predicate", F.lit("right")), 200, F.lit(0.35))
    out = own.unionByName(answers).unionByName(against)
    return out.withColumns({"ranking_score": none, "confidence": none})


def merged(s, d):
    return R.merge(sources_of(s, d)).withColumn("confidence", F.lit(None).cast("double"))


@query(with_obs(f"{MERGED} SELECT {_KEY_OUT}, rs AS rule_support, ag AS agent_score, rk AS ranking_score, kind AS score_kind, array_to_string(sources, ',') AS sources, array_to_string(ev, ',') AS evidence_frames, segment_id FROM mr"))
def merge_relations(s, d):
    return merged(s, d).drop("confidence").withColumns({"sources": _text("sources"), "evidence_frames": _text("evidence_frames")})


@query(with_obs(f"""{MERGED}, {O.values_sql('inv', 'p, i', O.INVERSES.items())}
SELECT {_KEY_OUT}, rk AS ranking_score, array_to_string(sources, ',') AS sources, false AS coupled FROM mr UNION ALL
SELECT m.video_id, m.o, i, m.s, m.st, m.en, m.rk, array_to_string(list_append(m.sources, 'coupling'), ','), true FROM mr m JOIN inv USING (p)
WHERE NOT EXISTS (SELECT 1 FROM mr x WHERE x.video_id = m.video_id AND x.s = m.o AND x.p = inv.i AND x.o = m.s AND x.st = m.st AND x.en = m.en)"""))
def coupling(s, d):
    out = R.add_coupling(merged(s, d), O.inverses(s))
    return out.select(*R.KEY, "ranking_score", _text("sources"), "coupled")


CONFLICT_SQL = f"""{O.values_sql('mx', 'p, q', O.MUTEX)},
cf AS (SELECT a.video_id, a.s, a.o, a.st, a.en, mx.p, mx.q, a.rk AS sp, b.rk AS sq FROM mr a JOIN mx ON a.p = mx.p JOIN mr b ON b.p = mx.q AND b.video_id = a.video_id AND b.s = a.s AND b.o = a.o AND b.st = a.st AND b.en = a.en)"""


@query(with_obs(f"{MERGED}, {CONFLICT_SQL} SELECT video_id, s AS subject_id, o AS object_id, st AS start_frame, en AS end_frame, p, q FROM cf"))
def mutex_conflicts(s, d):
    return R.conflicts(merged(s, d), O.mutex(s))


@query(with_obs(f"""{MERGED}, {CONFLICT_SQL} SELECT {_KEY_OUT}, rk AS ranking_score FROM mr m WHERE NOT EXISTS (SELECT 1 FROM cf WHERE cf.video_id = m.video_id AND cf.s = m.s AND cf.o = m.o AND cf.st = m.st AND cf.en = m.en AND m.p = CASE WHEN cf.sp >= cf.sq THEN cf.q ELSE cf.p END)"""))
def resolve_mutex(s, d):
    return R.resolve_conflicts(merged(s, d), O.mutex(s)).select(*R.KEY, "ranking_score")


@query(with_obs(f"{MERGED} SELECT {_KEY_OUT}, rk AS ranking_score FROM mr WHERE rk >= 0.5"))
def export_filter(s, d):
    return R.export_filter(merged(s, d), 0.5).select(*R.KEY, "ranking_score")


_RISK_SQL = "risky AS (SELECT DISTINCT video_id, track_id FROM obs WHERE track_id % 7 = 3)"


def _risky(s, d):
    return fixture.obs(s, d).where("track_id % 7 = 3").select("video_id", "track_id").distinct()


REVIEW_SQL = f"""{CONFLICT_SQL}, {_RISK_SQL}, rv AS (SELECT m.*, list_filter([CASE WHEN rk < 0.45 THEN 'low_ranking_score' END, CASE WHEN EXISTS (SELECT 1 FROM risky r WHERE r.video_id = m.video_id AND r.track_id IN (m.s, m.o)) THEN 'risky_track' END], lambda x: x IS NOT NULL) AS reasons,
  EXISTS (SELECT 1 FROM cf WHERE cf.video_id = m.video_id AND cf.s = m.s AND cf.o = m.o AND cf.st = m.st AND cf.en = m.en AND m.p IN (cf.p, cf.q)) AS conflict FROM mr m)"""


@query(with_obs(f"{MERGED}, {REVIEW_SQL} SELECT {_KEY_OUT}, CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') ELSE 'conflict' END AS review_reasons FROM rv WHERE len(reasons) > 0 OR conflict"))
def review_items(s, d):
    return R.review_items(merged(s, d), O.mutex(s), _risky(s, d)).select(*R.KEY, _text("review_reasons"))


_MAIN_SQL = """mc AS (SELECT video_id, track_id, class_name FROM (SELECT video_id, track_id, class_name, count(*) AS n, min(frame) AS f FROM obs GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY n DESC, f) = 1)"""


@query(with_obs(f"""{MERGED}, {_MAIN_SQL} SELECT m.video_id, m.s AS subject_id, m.p AS predicate, m.o AS object_id, m.st AS start_frame, m.en AS end_frame,
CASE m.p WHEN 'above' THEN a.class_name IN ('dog', 'cat', 'horse') WHEN 'left' THEN b.class_name NOT IN ('person', 'unknown') WHEN 'right' THEN a.class_name IN ('person', 'bicycle', 'car', 'skateboard', 'surfboard') ELSE true END AS allowed
FROM mr m JOIN mc a ON a.video_id = m.video_id AND a.track_id = m.s JOIN mc b ON b.video_id = m.video_id AND b.track_id = m.o"""))
def category_constraint(s, d):
    limits = s.createDataFrame([("above", ["animal"], None), ("left", ["any"], ["object"]), ("right", ["person", "vehicle"], [])], "predicate string, subject_categories array<string>, object_categories array<string>")
    return R.category_filter(merged(s, d), T.main_class(fixture.obs(s, d)), limits).select(*R.KEY, "allowed")


_ALLOWED_SQL = f"""{_MAIN_SQL}, fa AS (SELECT m.*, CASE m.p WHEN 'above' THEN a.class_name IN ('dog', 'cat', 'horse') WHEN 'left' THEN b.class_name NOT IN ('person', 'unknown') ELSE true END AS allowed
FROM mr m JOIN mc a ON a.video_id = m.video_id AND a.track_id = m.s JOIN mc b ON b.video_id = m.video_id AND b.track_id = m.o)"""


@query(with_obs(f"""{MERGED}, {CONFLICT_SQL}, {_ALLOWED_SQL}, q AS (SELECT video_id, array_to_string(sources, ',') AS source, count(*) AS n, count(*) FILTER (rk < 0.85) AS low FROM mr GROUP BY ALL),
lo AS (SELECT video_id, string_agg(concat_ws(' ', s, p, o, st, en), ';' ORDER BY st, en, s, p, o) AS ex FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY st, en, s, p, o) AS n FROM mr WHERE rk < 0.85) WHERE n <= 20 GROUP BY video_id),
k AS (SELECT video_id, count(*) AS n, count(*) FILTER (allowed) AS al, count(*) FILTER (allowed AND rk >= 0.7) AS kept FROM fa GROUP BY video_id)
SELECT q.video_id, sum(q.n)::BIGINT AS relations, string_agg(source || '=' || q.n, ';' ORDER BY source) AS source_counts, sum(low)::BIGINT AS low_scores, (SELECT count(*) FROM cf WHERE cf.video_id = q.video_id) AS conflicts, any_value(k.n - k.al) AS filtered_by_category, any_value(k.al - k.kept) AS filtered_by_score, any_value(k.kept) AS kept,
  coalesce(any_value(lo.ex), '') AS low_examples, (SELECT count(*) FROM cf WHERE cf.video_id = q.video_id) = 0 AND any_value(k.n - k.al) = 0 AS passed FROM q JOIN k USING (video_id) LEFT JOIN lo USING (video_id) GROUP BY q.video_id"""))
def verify_qc(s, d):
    m = merged(s, d)
    limits = s.createDataFrame([("above", ["animal"], None), ("left", ["any"], ["object"])], "predicate string, subject_categories array<string>, object_categories array<string>")
    allowed = R.category_filter(m, T.main_class(fixture.obs(s, d)), limits).where("allowed")
    out = R.verify_report(m, allowed, R.export_filter(allowed, 0.7), O.mutex(s), low=0.85)
    return out.withColumn("low_examples", F.concat_ws(";", "low_examples"))


@query(with_obs(f"""{MERGED}, {CONFLICT_SQL}, sc AS (SELECT video_id, s, o, st, en, p, max(rk) AS rk FROM mr GROUP BY ALL), lo AS (SELECT cf.video_id, cf.s, cf.o, cf.st, cf.en, CASE WHEN x.rk >= y.rk THEN cf.q ELSE cf.p END AS p, CASE WHEN x.rk >= y.rk THEN cf.p ELSE cf.q END AS kept
  FROM cf JOIN sc x ON (x.video_id, x.s, x.o, x.st, x.en, x.p) = (cf.video_id, cf.s, cf.o, cf.st, cf.en, cf.p) JOIN sc y ON (y.video_id, y.s, y.o, y.st, y.en, y.p) = (cf.video_id, cf.s, cf.o, cf.st, cf.en, cf.q))
SELECT mr.video_id, mr.s AS subject_id, mr.p AS predicate, mr.o AS object_id, mr.st AS start_frame, mr.en AS end_frame, 'delete' AS action, 'mutex conflict; keep ' || kept AS reason, round(rk, 6)+0.0 AS ranking_score FROM mr JOIN lo ON (lo.video_id, lo.s, lo.o, lo.st, lo.en, lo.p) = (mr.video_id, mr.s, mr.o, mr.st, mr.en, mr.p)"""))
def mutex_deletions(s, d):
    return R.deletions(merged(s, d), O.mutex(s)).withColumn("ranking_score", r6(F.col("ranking_score")))


_RAW_SQL = """SELECT video_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'x' || track_id ELSE track_id::VARCHAR END AS subject_track_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (track_id + 1)::VARCHAR END AS object_id,
  CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' Left ' ELSE 'touch' END AS predicate, CASE WHEN event_id % 3 = 0 THEN NULL ELSE frame::VARCHAR END AS start_frame, CASE WHEN event_id % 13 = 0 THEN 'late' WHEN event_id % 2 = 0 THEN NULL ELSE (frame + 9)::VARCHAR END AS end_frame FROM obs"""


@query(with_obs(f""", raw AS ({_RAW_SQL}) SELECT video_id, event_id, subject_track_id::BIGINT AS subject_id, lower(trim(predicate)) AS predicate, object_id::BIGINT AS object_id, coalesce(start_frame::INT, 0) AS start_frame, coalesce(end_frame::INT, start_frame::INT, 0) AS end_frame
FROM raw WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0 AND event_id % 13 <> 0"""))
def relation_keys(s, d):
    raw = fixture.obs(s, d).selectExpr("video_id", "event_id", "CASE WHEN event_id % 7 = 0 THEN concat('x', track_id) ELSE string(track_id) END AS subject_track_id", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE string(track_id + 1) END AS object_id",
                                       "CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' Left ' ELSE 'touch' END AS predicate", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE string(frame) END AS start_frame", "CASE WHEN event_id % 13 = 0 THEN 'late' WHEN event_id % 2 = 0 THEN NULL ELSE string(frame + 9) END AS end_frame")
    return R.keyed(raw)


CLUSTER_SQL = """o AS (SELECT *, row_number() OVER (PARTITION BY video_id, s, p, o ORDER BY st, en, segment_id) AS rn FROM mr),
gl AS (SELECT video_id, s, p, o, rn, en AS ce, ev[-1] AS ee, 0 AS cl FROM o WHERE rn = 1 UNION ALL
  SELECT x.video_id, x.s, x.p, x.o, x.rn, CASE WHEN x.st > g.ce + 1 OR x.ev[1] > g.ee + 4 THEN x.en ELSE greatest(g.ce, x.en) END, CASE WHEN x.st > g.ce + 1 OR x.ev[1] > g.ee + 4 THEN x.ev[-1] ELSE greatest(g.ee, x.ev[-1]) END,
    g.cl + CASE WHEN x.st > g.ce + 1 OR x.ev[1] > g.ee + 4 THEN 1 ELSE 0 END FROM gl g JOIN o x ON x.video_id = g.video_id AND x.s = g.s AND x.p = g.p AND x.o = g.o AND x.rn = g.rn + 1),
ga AS (SELECT video_id, s, p, o, cl, min(st) AS st, max(en) AS en, list_sort(list_distinct(flatten(list(ev)))) AS ev, round(max(rs), 4) AS rs, round(max(ag), 4) AS ag, round(max(rk), 4) AS rk, count(*) AS segment_count, list(segment_id ORDER BY rn) AS segment_ids FROM o JOIN gl USING (video_id, s, p, o, rn) GROUP BY ALL),
gi AS (SELECT *, printf('r%06d', row_number() OVER (PARTITION BY video_id ORDER BY st, en, s, p, o)) AS relation_id FROM ga)"""


def clustered(s, d):
    return R.clusters(merged(s, d).withColumn("ord", F.col("segment_id")))


@query(with_obs(f"""{MERGED}, {CLUSTER_SQL} SELECT {_KEY_OUT}, relation_id, rs AS rule_support, ag AS agent_score, rk AS ranking_score, segment_count, array_to_string(segment_ids, ',') AS segment_ids, array_to_string(ev, ',') AS evidence_frames,
CASE WHEN rs IS NOT NULL AND ag IS NOT NULL THEN 'mixed_ranking' WHEN rs IS NOT NULL THEN 'rule_support' ELSE 'agent_ranking' END AS score_kind FROM gi"""))
def global_relations(s, d):
    return clustered(s, d).drop("sources").withColumns({"segment_ids": _text("segment_ids"), "evidence_frames": _text("evidence_frames")})


@query(with_obs(f"{MERGED}, i AS (SELECT *, printf('r%06d', row_number() OVER (PARTITION BY video_id ORDER BY st, en, s, p, o)) AS relation_id FROM mr) SELECT {_KEY_OUT}, relation_id FROM i"))
def relation_ids(s, d):
    return R.with_ids(merged(s, d)).select(*R.KEY, "relation_id")


@query(with_obs(f"{MERGED} SELECT {_KEY_OUT}, round(least(1, greatest(0, coalesce(ag, rs, 0))), 6)+0.0 AS clamped, round(coalesce(ag * 3, rs, 0), 6)+0.0 AS unclamped FROM mr"))
def ranking_score(s, d):
    m = merged(s, d).withColumn("ranking_score", F.lit(None).cast("double"))
    return m.select(*R.KEY, r6(R.ranking_score()).alias("clamped"), F.col("agent_score"), "rule_support", "confidence", "ranking_score").withColumn("agent_score", F.col("agent_score") * 3).select(*R.KEY, "clamped", r6(R.ranking_score(False)).alias("unclamped"))


@query(with_obs(f"""{CHAIN} SELECT video_id, segment_id, s AS subject_id, p AS predicate, o AS object_id, least(a, b) AS start_frame, greatest(a, b) + CASE WHEN c = 'half_open' THEN 0 ELSE 1 END AS end_excl
FROM (SELECT *, CASE WHEN s % 2 = 0 THEN en ELSE st END AS a, CASE WHEN s % 2 = 0 THEN st ELSE en END AS b, CASE o % 3 WHEN 0 THEN 'half_open' WHEN 1 THEN 'inclusive' END AS c FROM rr)"""))
def span_normalize(s, d):
    r = rules(s, d).withColumns({"span_convention": F.expr("CASE object_id % 3 WHEN 0 THEN 'half_open' WHEN 1 THEN 'inclusive' END"), "x": F.col("start_frame")})
    turned = F.col("subject_id") % 2 == 0
    r = r.withColumns({"start_frame": F.when(turned, F.col("end_frame")).otherwise(F.col("start_frame")), "end_frame": F.when(turned, F.col("x")).otherwise(F.col("end_frame"))})
    return R.normalize_span(r).select("video_id", "segment_id", "subject_id", "predicate", "object_id", "start_frame", "end_excl")


_RAW_SQL = "CASE event_id % 6 WHEN 0 THEN '  Domestic-Cat ' WHEN 1 THEN 'MAN' WHEN 2 THEN 'giant  panda' WHEN 3 THEN '' WHEN 4 THEN 'Traffic_Light' ELSE class_name END"
_ALIAS_SQL = O.values_sql("al", "alias, name", [(n.replace("_", " "), n) for n in O.OBJECTS] + list(O.ALIASES.items()))
_LABEL_SQL = f"""{_ALIAS_SQL}, raw AS (SELECT video_id, event_id, {_RAW_SQL} AS raw FROM det), sp AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS spaced FROM raw),
lb AS (SELECT video_id, event_id, raw, coalesce(al.name, CASE WHEN spaced = '' THEN 'unknown' ELSE replace(spaced, ' ', '_') END) AS label FROM sp LEFT JOIN al ON al.alias = sp.spaced)"""


def _labels(s, d):
    raw = fixture.det(s, d).select("video_id", "event_id", F.expr(_RAW_SQL).alias("raw"))
    return labels.normalize(raw, "raw", O.aliases(s))


@query(with_obs(f", {_LABEL_SQL} SELECT * FROM lb"))
def normalize_label(s, d):
    return _labels(s, d)


@query(with_obs(f""", {_LABEL_SQL}, {O.values_sql('ob', 'name, k', [(n, 1) for n in O.OBJECTS])} SELECT video_id, raw AS raw_label, label AS canonical_label, CASE WHEN label IN (SELECT name FROM ob) THEN 'ontology' ELSE 'discovered' END AS ontology_source FROM lb QUALIFY row_number() OVER (PARTITION BY video_id, label ORDER BY event_id) = 1"""))
def vocabulary_dedup(s, d):
    v = labels.vocabulary(_labels(s, d), "event_id")
    known = F.broadcast(O.objects(s).select(F.col("name").alias("label"), F.lit("ontology").alias("o")))
    return v.join(known, "label", "left").select("video_id", F.col("raw").alias("raw_label"), F.col("label").alias("canonical_label"), F.coalesce("o", F.lit("discovered")).alias("ontology_source"))


@query(f"WITH {O.predicates_sql()} SELECT * FROM predicates UNION ALL SELECT NULL, 'levitate', 'levitate', '', ''")
def predicate_components(s, d):
    asked = O.predicates(s).select("name").unionByName(s.createDataFrame([("levitate",)], "name string"))
    p = asked.join(F.broadcast(O.predicates(s)), "name", "left")
    return p.select("id", "name", F.coalesce("action", "name").alias("action"), F.coalesce("spatial", F.lit("")).alias("spatial"), F.coalesce("comparative", F.lit("")).alias("comparative"))


FAMILY_SQL = f"""{O.predicates_sql()}, {O.words_sql('fa', O.FAMILY_ACTIONS)}, {O.words_sql('fs', O.FAMILY_SPATIALS)},
fm0 AS (SELECT name, grp AS family FROM predicates JOIN fa ON fa.word = action UNION SELECT name, grp FROM predicates JOIN fs ON fs.word = spatial UNION SELECT name, 'comparative' FROM predicates WHERE comparative <> ''),
fm AS (SELECT * FROM fm0 UNION ALL SELECT name, 'attention_social' FROM predicates WHERE name NOT IN (SELECT name FROM fm0))"""
SIBLING_SQL = f"""{O.words_sql('cg', O.CONFUSION_GROUPS)}, cp AS (SELECT a.group_ord, a.word AS mine, b.word AS theirs, b.ord FROM cg a JOIN cg b ON a.group_ord = b.group_ord AND a.word <> b.word),
sb0 AS (SELECT p.name, theirs AS sibling, group_ord, 0 AS br, ord AS pos FROM predicates p JOIN cp ON cp.mine = p.name UNION ALL
  SELECT p.name, q.name, group_ord, 1, q.id FROM predicates p JOIN cp ON cp.mine = p.action JOIN predicates q ON q.action = theirs AND q.spatial = p.spatial UNION ALL
  SELECT p.name, q.name, group_ord, 2, q.id FROM predicates p JOIN cp ON cp.mine = p.spatial JOIN predicates q ON q.spatial = theirs AND q.action = p.action),
sb AS (SELECT name, sibling, (row_number() OVER (PARTITION BY name ORDER BY k, sibling) - 1)::INT AS ord FROM (SELECT name, sibling, min(group_ord * 100000 + br * 10000 + pos) AS k FROM sb0 GROUP BY ALL))"""


@query(f"WITH {FAMILY_SQL} SELECT name, string_agg(family, ',' ORDER BY family) AS families FROM fm GROUP BY name")
def predicate_families(s, d):
    return O.family_members(s).groupBy("name").agg(F.concat_ws(",", F.array_sort(F.collect_list("family"))).alias("families"))


@query(f"WITH {O.predicates_sql()}, {SIBLING_SQL} SELECT * FROM sb")
def confusion_siblings(s, d):
    return O.siblings(s)


@query(f"""WITH {O.words_sql('nb', O.FAMILY_NEIGHBORS)}, chosen(family, k) AS (VALUES ('contact', 0), ('geometry', 1)),
r AS (SELECT word AS neighbor, min(k * 10 + ord) AS k FROM nb JOIN chosen ON chosen.family = nb.grp WHERE word NOT IN (SELECT family FROM chosen) GROUP BY word) SELECT neighbor, (row_number() OVER (ORDER BY k) - 1)::INT AS ord FROM r""")
def neighbor_families(s, d):
    from vistra.operators import routing

    chosen = s.createDataFrame([(1, "contact", 0), (1, "geometry", 1)], "key int, family string, k int")
    return routing.neighbor_families(chosen, O.neighbors(s), "key").select("neighbor", "ord")


@query(with_obs(f", {INTERP_SQL}, {_over_lengths(PAIRS_SQL)}, {rules_sql()} SELECT {_RULE_OUT} FROM rr"))
def rule_relations_lengths(s, d):
    return R.rule_relations(filled(s, d), lengths(s, d)).withColumn("evidence_frames", _text("evidence_frames"))


@query(with_obs(f", {MIXED_SQL}, {PAIRS_SQL}, {rules_sql()} SELECT {_RULE_OUT} FROM rr"))
def rule_relations_predicted(s, d):
    return R.rule_relations(T.interpolate_gaps(mixed(s, d)), fixture.FRAMES).withColumn("evidence_frames", _text("evidence_frames"))
