"""Queries over the evidence of pairs, routes and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistra.functions import ontology as O
from vistra.operators import evidence as E
from vistra.operators import relations as R
from vistra.operators import routing
from vistra.operators import tracks as T
from vistra.operators.evidence import PACKET
from vistra.plans.queries_relations import FAMILY_SQL, INTERP_SQL, PAIRS_SQL, SIBLING_SQL, filled, visible_pairs
from vistra.plans.registry import query, r6, with_obs
from vistra.sources import fixture

_VP = f", {INTERP_SQL}, {PAIRS_SQL}, vp AS (SELECT video_id, window_id, a, b, count(*) AS n FROM pw GROUP BY ALL HAVING count(*) >= 2)"


@query(with_obs(f"{_VP} SELECT *, row_number() OVER (PARTITION BY video_id, window_id ORDER BY n DESC, a, b) AS rank, row_number() OVER (PARTITION BY video_id, window_id ORDER BY n DESC, a, b) > 10 AS deferred FROM vp"))
def top_pairs(s, d):
    return E.top_pairs(visible_pairs(s, d), 10)


@query(with_obs(f"""{_VP}, wt AS (SELECT DISTINCT it.video_id, w.window_id, track_id FROM it JOIN range(1, 8) w(window_id) ON frame BETWEEN (w.window_id - 1) * 15 AND (w.window_id - 1) * 15 + 29),
ap AS (SELECT x.video_id, x.window_id, x.track_id AS a, y.track_id AS b, row_number() OVER (PARTITION BY x.video_id, x.window_id ORDER BY x.track_id, y.track_id) AS rank FROM (SELECT * FROM wt QUALIFY row_number() OVER (PARTITION BY video_id, window_id ORDER BY track_id) <= 9) x JOIN (SELECT * FROM wt QUALIFY row_number() OVER (PARTITION BY video_id, window_id ORDER BY track_id) <= 9) y ON x.video_id = y.video_id AND x.window_id = y.window_id AND x.track_id < y.track_id)
SELECT vp.*, ap.rank FROM vp JOIN ap USING (video_id, window_id, a, b) WHERE ap.rank <= 26"""))
def rule_pair_cap(s, d):
    inside = T.assign_windows(filled(s, d), fixture.FRAMES).select("video_id", "window_id", "track_id").distinct()
    return E.rule_pair_cap(visible_pairs(s, d), inside, 26, 9)


@query(with_obs(f"{_VP}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, window_id ORDER BY n DESC, a, b) AS rank FROM vp) SELECT video_id, window_id, count(*) AS candidates, count(*) FILTER (rank <= 10) AS processed, count(*) FILTER (rank > 10) AS deferred FROM r GROUP BY ALL"))
def pair_coverage(s, d):
    return E.coverage(E.top_pairs(visible_pairs(s, d), 10))


@query(with_obs(f""", {INTERP_SQL}, k AS (SELECT a.video_id, w.window_id, a.track_id AS a, b.track_id AS b, a.box_source || '/' || b.box_source AS kind, count(*) AS n FROM it a JOIN it b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id
  JOIN range(1, 8) w(window_id) ON a.frame BETWEEN (w.window_id - 1) * 15 AND (w.window_id - 1) * 15 + 29 GROUP BY ALL)
SELECT video_id, window_id, a, b, sum(n)::BIGINT AS joint_frames, coalesce(sum(n) FILTER (kind = 'observed/observed'), 0)::BIGINT AS observed_frames, string_agg(kind || '=' || n, ',' ORDER BY kind) AS source_pairs FROM k GROUP BY video_id, window_id, a, b"""))
def track_evidence(s, d):
    e = E.joint_sources(T.assign_windows(R.pair_frames(filled(s, d)), fixture.FRAMES))
    text = F.transform(F.map_entries("source_pairs"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return e.withColumn("source_pairs", F.concat_ws(",", text))


_AREA = lambda p: f"greatest(1, {p}.x2 - {p}.x1) * greatest(1, {p}.y2 - {p}.y1)"
_I = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
FEATURES_SQL = f"""{INTERP_SQL}, sm0 AS (SELECT a.video_id, w.window_id, a.frame, a.track_id AS s, b.track_id AS o, (a.x1 + a.x2) / 2 AS sx, (a.y1 + a.y2) / 2 AS sy, (b.x1 + b.x2) / 2 AS ox, (b.y1 + b.y2) / 2 AS oy,
  sqrt(greatest({_AREA('a')}, {_AREA('b')})) AS scale, {_AREA('a')} / ({_AREA('b')}) AS size_ratio, {_I} / greatest(1e-6, {_AREA('a')} + {_AREA('b')} - {_I}) AS iou,
  sqrt(greatest(a.x1 - b.x2, b.x1 - a.x2, 0) * greatest(a.x1 - b.x2, b.x1 - a.x2, 0) + greatest(a.y1 - b.y2, b.y1 - a.y2, 0) * greatest(a.y1 - b.y2, b.y1 - a.y2, 0)) AS gap, (a.box_source = 'observed' AND b.box_source = 'observed')::INT AS seen
  FROM it a JOIN it b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id <> b.track_id JOIN range(1, 8) w(window_id) ON a.frame BETWEEN (w.window_id - 1) * 15 AND (w.window_id - 1) * 15 + 29),
sm AS (SELECT *, (sx - ox) / scale AS dx, (sy - oy) / scale AS dy, sqrt((sx - ox) * (sx - ox) + (sy - oy) * (sy - oy)) / scale AS distance, gap / scale AS edge_gap FROM sm0),
sl AS (SELECT *, frame - lag(frame) OVER w AS df, (scale + lag(scale) OVER w) / 2 AS sc, lag(sx) OVER w AS px, lag(sy) OVER w AS py, lag(ox) OVER w AS qx, lag(oy) OVER w AS qy, lag(distance) OVER w AS pd FROM sm WINDOW w AS (PARTITION BY video_id, window_id, s, o ORDER BY frame)),
sv AS (SELECT *, (sx - px) / sc / df AS vsx, (sy - py) / sc / df AS vsy, (ox - qx) / sc / df AS vox, (oy - qy) / sc / df AS voy, (pd - distance) / df AS rate FROM sl),
sp AS (SELECT *, sqrt(vsx * vsx + vsy * vsy) AS ss, sqrt(vox * vox + voy * voy) AS os FROM sv),
sc AS (SELECT *, CASE WHEN ss > 0 AND os > 0 THEN greatest(-1.0, least(1.0, (vsx * vox + vsy * voy) / (ss * os))) END AS cosine FROM sp),
fe AS (SELECT video_id, window_id, s AS subject_id, o AS object_id, count(*) AS frame_count, avg(seen) AS observed_pair_ratio, median(dx) AS median_dx, median(dy) AS median_dy, arg_min(distance, frame) AS distance_start, arg_max(distance, frame) AS distance_end, min(distance) AS distance_min,
  min(edge_gap) AS edge_gap_min, max(iou) AS iou_max, coalesce(median(rate), 0) AS approach_rate, coalesce(median(ss), 0) AS subject_speed, coalesce(median(os), 0) AS object_speed, coalesce(median(abs(rate)), 0) AS relative_motion, coalesce(median(cosine), 0) AS motion_alignment, median(size_ratio) AS size_ratio,
  min(dx) < 0 AND max(dx) > 0 AS crosses_horizontal_axis, list(frame ORDER BY frame) AS frames, list_sort(list_distinct([first(frame ORDER BY distance, frame), first(frame ORDER BY iou DESC, frame), CASE WHEN max(abs(rate)) > 1e-6 THEN first(frame ORDER BY abs(rate) DESC NULLS LAST, frame) ELSE first(frame ORDER BY distance, frame) END])) AS ev FROM sc GROUP BY ALL HAVING count(*) >= 2)"""
_NUMBERS = ("observed_pair_ratio", "median_dx", "median_dy", "distance_start", "distance_end", "distance_min", "edge_gap_min", "iou_max", "approach_rate", "subject_speed", "object_speed", "relative_motion", "motion_alignment", "size_ratio")


def samples(s, d):
    return E.samples(T.assign_windows(R.pair_frames(filled(s, d)), fixture.FRAMES))


def features(s, d):
    return E.features(samples(s, d)).where("frame_count >= 2")


@query(with_obs(f", {FEATURES_SQL} SELECT {', '.join(PACKET)}, frame_count, {', '.join(f'round({c}, 6)+0.0 AS {c}' for c in _NUMBERS)}, crosses_horizontal_axis FROM fe"))
def trajectory_evidence(s, d):
    return features(s, d).select(*PACKET, "frame_count", *[r6(F.col(c)).alias(c) for c in _NUMBERS], "crosses_horizontal_axis")


@query(with_obs(f", {FEATURES_SQL} SELECT {', '.join(PACKET)}, array_to_string(ev, ',') AS event_frames FROM fe"))
def event_frames(s, d):
    return features(s, d).select(*PACKET, F.concat_ws(",", F.col("event_frames").cast("array<string>")).alias("event_frames"))


SAMPLE_SQL = """es AS (SELECT *, len(frames) AS n, least(8, len(frames)) AS k FROM fe),
es2 AS (SELECT *, list_concat(list_filter(flatten(list_transform(ev, lambda e: range(e - 2, e + 3))), lambda f: list_contains(frames, f)), list_transform(range(0, k), lambda i: frames[round_even((n - 1) * i / greatest(k - 1, 1)::DOUBLE, 0)::INT + 1])) AS pri FROM es),
es3 AS (SELECT video_id, window_id, subject_id, object_id, k, f, min(i) AS i FROM (SELECT video_id, window_id, subject_id, object_id, k, unnest(pri) AS f, generate_subscripts(pri, 1) AS i FROM es2) GROUP BY ALL),
es4 AS (SELECT *, row_number() OVER (PARTITION BY video_id, window_id, subject_id, object_id ORDER BY i) AS rn FROM es3),
sa AS (SELECT video_id, window_id, subject_id, object_id, string_agg(f::VARCHAR, ',' ORDER BY f) AS sample FROM es4 WHERE rn <= k GROUP BY ALL)"""


@query(with_obs(f", {FEATURES_SQL}, {SAMPLE_SQL} SELECT * FROM sa"))
def event_sample(s, d):
    return E.event_sample(features(s, d)).select(*PACKET, F.concat_ws(",", F.col("sample").cast("array<string>")).alias("sample"))


_C01 = lambda x: f"greatest(0.0, least(1.0, {x}))"
SCORES_SQL = f"""fx AS (SELECT *, greatest(0.0, 1 - edge_gap_min) AS prox, greatest(iou_max, greatest(0.0, 1 - edge_gap_min)) AS contact, greatest(0.0, motion_alignment) AS align FROM fe),
fs0 AS (SELECT {', '.join(PACKET)}, unnest(['geometry', 'relative_motion', 'locomotion_state', 'contact', 'manipulation', 'attention_social', 'comparative']) AS family,
  unnest([0.55, greatest(0.15, least(1.0, abs(approach_rate) * 12 + relative_motion * 4), 0.8 * align), greatest(0.2, least(1.0, subject_speed * 5)), greatest(0.1, contact), greatest(0.1, 0.65 * contact + 0.35 * align), greatest(0.2, 0.4 * prox + 0.35 * align), greatest(0.1, least(1.0, abs(ln(greatest(1e-6, size_ratio)) / ln(2.0))))]) AS score FROM fx),
fr AS (SELECT *, row_number() OVER (PARTITION BY video_id, window_id, subject_id, object_id ORDER BY score DESC, family) AS family_rank FROM fs0)"""


@query(with_obs(f", {FEATURES_SQL}, {SCORES_SQL} SELECT {', '.join(PACKET)}, family, round(score, 4)+0.0 AS score FROM fs0"))
def family_scores(s, d):
    return routing.family_scores(features(s, d)).withColumn("score", F.round("score", 4) + F.lit(0.0))


_EXCLUDED = ", ".join(f"'{p}'" for p in O.GEOMETRIC)
ROUTE_SQL = f"""{FAMILY_SQL}, {SIBLING_SQL}, rp0 AS (SELECT fr.video_id, fr.window_id, fr.subject_id, fr.object_id, fm.name, min(score) AS fsc, max(family_rank) <= 3 AS eligible FROM fr JOIN fm ON fm.family = fr.family WHERE fm.name NOT IN ({_EXCLUDED}) GROUP BY ALL),
rp1 AS (SELECT r.*, 0.6 * fsc + 0.25 * CASE p.spatial WHEN 'left' THEN {_C01('-median_dx')} WHEN 'right' THEN {_C01('median_dx')} WHEN 'above' THEN {_C01('-median_dy')} WHEN 'beneath' THEN {_C01('median_dy')} WHEN 'toward' THEN {_C01('approach_rate * 12')} WHEN 'away' THEN {_C01('approach_rate * -12')}
    WHEN 'past' THEN crosses_horizontal_axis::INT::DOUBLE WHEN 'next_to' THEN greatest(0.0, 1 - distance_min) WHEN 'with' THEN greatest(0.0, motion_alignment) ELSE 0.25 END
  + 0.15 * CASE WHEN p.action IN ('lie', 'sit', 'stand', 'stop') THEN greatest(0.0, 1 - subject_speed * 8) WHEN p.action IN ('creep', 'fly', 'jump', 'move', 'run', 'swim', 'walk') THEN least(1.0, subject_speed * 8)
    WHEN p.action IN ('chase', 'follow') THEN least(1.0, subject_speed * 5 + greatest(0.0, approach_rate) * 8 + greatest(0.0, motion_alignment) * 0.3) WHEN p.action <> '' THEN 0.5 ELSE 0.25 END AS score
  FROM rp0 r JOIN predicates p USING (name) JOIN fe USING (video_id, window_id, subject_id, object_id)),
rp AS (SELECT *, row_number() OVER (PARTITION BY video_id, window_id, subject_id, object_id ORDER BY round(score, 9) DESC, name) AS rank FROM rp1),
rf AS (SELECT rp.*, fr.family_rank FROM rp JOIN fm USING (name) JOIN fr USING (video_id, window_id, subject_id, object_id, family) WHERE eligible),
rb AS (SELECT *, row_number() OVER (PARTITION BY video_id, window_id, subject_id, object_id, family_rank ORDER BY rank) AS n FROM rf),
r1 AS (SELECT video_id, window_id, subject_id, object_id, name, min(family_rank * 10 + n) AS k FROM rb WHERE n <= 2 GROUP BY ALL),
ra AS (SELECT video_id, window_id, subject_id, object_id, name, k AS o FROM r1 UNION ALL SELECT r1.video_id, r1.window_id, r1.subject_id, r1.object_id, sb.sibling, 1000000 + k * 1000 + sb.ord FROM r1 JOIN sb USING (name) WHERE sb.sibling NOT IN ({_EXCLUDED})
  UNION ALL SELECT video_id, window_id, subject_id, object_id, name, 2000000 + rank FROM rp WHERE eligible),
ro AS (SELECT video_id, window_id, subject_id, object_id, name, row_number() OVER (PARTITION BY video_id, window_id, subject_id, object_id ORDER BY o) AS ord FROM (SELECT video_id, window_id, subject_id, object_id, name, min(o) AS o FROM ra GROUP BY ALL))"""


def ranked(s, d):
    return routing.ranked_predicates(features(s, d), O.predicates(s), O.family_members(s), O.GEOMETRIC)


@query(with_obs(f", {FEATURES_SQL}, {SCORES_SQL}, {ROUTE_SQL} SELECT {', '.join(PACKET)}, name, ord FROM ro WHERE ord <= 14"))
def route_predicates(s, d):
    return routing.listed(routing.route(ranked(s, d), O.siblings(s)))


_EXPAND_SQL = f"""{O.words_sql('nbr', O.FAMILY_NEIGHBORS)}, best AS (SELECT * FROM fr WHERE family_rank <= 3),
op AS (SELECT DISTINCT best.video_id, best.window_id, best.subject_id, best.object_id, nbr.word AS family FROM best JOIN nbr ON nbr.grp = best.family WHERE NOT EXISTS (SELECT 1 FROM best x WHERE x.video_id = best.video_id AND x.window_id = best.window_id AND x.subject_id = best.subject_id AND x.object_id = best.object_id AND x.family = nbr.word)),
wa AS (SELECT DISTINCT op.video_id, op.window_id, op.subject_id, op.object_id, fm.name FROM op JOIN fm USING (family) WHERE family IN ('contact', 'locomotion_state')),
ea AS (SELECT video_id, window_id, subject_id, object_id, name, ord AS o FROM ro WHERE ord <= 14 UNION ALL SELECT video_id, window_id, subject_id, object_id, name, 1000 + rank FROM rp JOIN wa USING (video_id, window_id, subject_id, object_id, name)),
eo AS (SELECT video_id, window_id, subject_id, object_id, name, row_number() OVER (PARTITION BY video_id, window_id, subject_id, object_id ORDER BY o) AS ord FROM (SELECT video_id, window_id, subject_id, object_id, name, min(o) AS o FROM ea GROUP BY ALL))"""


@query(with_obs(f", {FEATURES_SQL}, {SCORES_SQL}, {ROUTE_SQL}, {_EXPAND_SQL} SELECT {', '.join(PACKET)}, name, ord FROM eo WHERE ord <= 24"))
def expand_route(s, d):
    asked = F.array(F.lit("contact"), F.lit("locomotion_state"), F.lit("no_such_family"))
    routed = routing.route(ranked(s, d), O.siblings(s)).withColumn("requested", asked)
    return routing.listed(routing.expand(routed, O.neighbors(s)))


@query(with_obs(f""", {FEATURES_SQL}, {SCORES_SQL}, {_EXPAND_SQL.split(", wa AS")[0].split(",\nwa AS")[0]}, gr AS (SELECT * FROM op WHERE family IN ('contact', 'locomotion_state')),
al AS (SELECT video_id, window_id, subject_id, object_id, family FROM best UNION SELECT * FROM gr), nb AS (SELECT DISTINCT al.video_id, al.window_id, al.subject_id, al.object_id, nbr.word AS family FROM al JOIN nbr ON nbr.grp = al.family),
ex AS (SELECT * FROM nb EXCEPT SELECT * FROM al)
SELECT {', '.join(PACKET)}, (SELECT string_agg(family, ',' ORDER BY family) FROM al x WHERE (x.video_id, x.window_id, x.subject_id, x.object_id) = (fe.video_id, fe.window_id, fe.subject_id, fe.object_id)) AS families,
  coalesce((SELECT string_agg(family, ',' ORDER BY family) FROM ex x WHERE (x.video_id, x.window_id, x.subject_id, x.object_id) = (fe.video_id, fe.window_id, fe.subject_id, fe.object_id)), '') AS expandable FROM fe"""))
def expand_families(s, d):
    asked = F.array(F.lit("contact"), F.lit("locomotion_state"), F.lit("no_such_family"))
    routed = routing.route(ranked(s, d), O.siblings(s)).withColumn("requested", asked)
    out = routing.expand(routed, O.neighbors(s))
    return out.select(*PACKET, F.concat_ws(",", F.array_sort("families")).alias("families"), F.concat_ws(",", F.array_sort("expandable")).alias("expandable"))


@query(with_obs(f", {FEATURES_SQL}, {SCORES_SQL}, {ROUTE_SQL}, {SAMPLE_SQL}, rt AS (SELECT video_id, window_id, subject_id, object_id, string_agg(name, ',' ORDER BY ord) AS candidates FROM ro WHERE ord <= 14 GROUP BY ALL) SELECT {', '.join(PACKET)}, frame_count, round(median_dx, 6)+0.0 AS median_dx, round(approach_rate, 6)+0.0 AS approach_rate, candidates, sample FROM fe JOIN rt USING (video_id, window_id, subject_id, object_id) JOIN sa USING (video_id, window_id, subject_id, object_id)"))
def evidence_packets(s, d):
    f = features(s, d)
    r = routing.route(routing.ranked_predicates(f, O.predicates(s), O.family_members(s), O.GEOMETRIC), O.siblings(s))
    p = E.packets(f, r)
    return p.select(*PACKET, "frame_count", r6(F.col("median_dx")).alias("median_dx"), r6(F.col("approach_rate")).alias("approach_rate"), F.concat_ws(",", "candidates").alias("candidates"), F.concat_ws(",", F.col("sample").cast("array<string>")).alias("sample"))


@query(with_obs(f"{_VP}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id, a, b ORDER BY window_id) AS rn FROM vp) SELECT video_id, a, b, window_id, (rn - 1) // 6 AS chunk FROM n"))
def pair_batches(s, d):
    return E.pair_batches(visible_pairs(s, d), 6).select("video_id", "a", "b", "window_id", "chunk")


_PICK = "((a.x1 - 0.4 * greatest(1, {w}))::DOUBLE)"


@query(with_obs("""
, u AS (SELECT a.video_id, a.frame, a.track_id AS a, b.track_id AS b, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2 FROM obs a JOIN obs b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id)
SELECT video_id, frame, a, b, greatest(0, trunc(x1 - 0.4 * greatest(1.0, x2 - x1)))::INT AS left_x, greatest(0, trunc(y1 - 0.4 * greatest(1.0, y2 - y1)))::INT AS top_y, least(640, trunc(x2 + 0.4 * greatest(1.0, x2 - x1)))::INT AS right_x, least(240, trunc(y2 + 0.4 * greatest(1.0, y2 - y1)))::INT AS bottom_y FROM u"""))
def pair_crop_box(s, d):
    return E.crop_boxes(R.pair_frames(fixture.obs(s, d).withColumn("box_source", F.lit("observed"))), 640, 240)


@query(with_obs("""
SELECT a.video_id, a.track_id AS subject_id, b.track_id AS object_id, count(*) AS common_frames FROM obs a JOIN obs b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id <> b.track_id GROUP BY ALL HAVING count(*) >= 22"""))
def annotatable_pairs(s, d):
    return E.annotatable(R.pair_frames(fixture.obs(s, d).withColumn("box_source", F.lit("observed"))), 22)
