"""Queries over model replies and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistra.functions import ontology as O
from vistra.operators import actions as A
from vistra.operators import relations as R
from vistra.plans.queries_relations import CHAIN, INTERP_SQL, MERGED, PAIRS_SQL, merged, rules, visible_pairs
from vistra.plans.registry import query, with_obs
from vistra.sources import fixture

_REPLY = "CASE event_id % 5 WHEN 0 THEN concat('```json\n', props, '\n```') WHEN 1 THEN concat('Sure: ', props, ' done') WHEN 2 THEN 'no object' WHEN 3 THEN concat('```', props, '```') ELSE props END"


@query(rf"""WITH t AS (SELECT event_id, {_REPLY} AS reply FROM events), b AS (SELECT event_id, regexp_replace(trim(reply), '(?i)^```(?:json)?\s*|\s*```$', '', 'g') AS bare FROM t),
o AS (SELECT event_id, CASE WHEN json_valid(bare) AND bare LIKE '{{%' THEN bare WHEN json_valid(regexp_extract(bare, '(?s)(\{{.*\}})', 1)) THEN regexp_extract(bare, '(?s)(\{{.*\}})', 1) END AS obj FROM b)
SELECT event_id, obj IS NOT NULL AS parsed, CASE WHEN obj IS NOT NULL THEN CAST(json_extract(obj, '$.k') AS BIGINT) END AS k FROM o""")
def parse_actions(s, d):
    o = fixture.events(s, d).select("event_id", A.reply_object(F.expr(_REPLY.replace("\n", "\\n"))).alias("obj"))
    return o.select("event_id", F.col("obj").isNotNull().alias("parsed"), F.get_json_object("obj", "$.k").cast("long").alias("k"))


# ord, action, reason, swap, predicate, start, end, two evidence frames, score, family: each packet gets one of each
_VARIANTS = [
    (1, "accept_relation", "seen", 0, "touch", 0, 6, 0, 6, 0.8, ""), (2, "accept_relation", "seen", 0, "next_to", 0, 6, 0, 6, 0.8, ""), (3, "accept_relation", "seen", 1, "watch", 3, 9, 3, 7, 0.8, ""),
    (4, "Accept_Relation ", " ", 0, "touch", 0, 6, 0, 6, 0.8, ""), (5, "dance", "x", 0, "touch", 0, 6, 0, 6, 0.8, ""), (6, "request_candidate_expansion", "x", 0, "touch", 0, 6, 0, 6, 0.8, "nonsense"),
    (7, "request_candidate_expansion", "x", 0, "touch", 0, 6, 0, 6, 0.8, "manipulation"), (8, "request_candidate_expansion", "x", 1, "touch", 0, 6, 0, 6, 0.8, "contact"), (9, "request_more_frames", "x", 0, "touch", 0, 6, 1, 400, 0.8, ""),
    (10, "request_more_frames", "x", 0, "touch", 0, 6, 3, 400, 0.8, ""), (11, "accept_relation", "seen", 0, "follow", 6, 12, 6, 12, 1.7, ""), (12, "change_predicate", "x", 0, "touch", 0, 6, 0, 6, 0.8, ""),
    (13, " REJECT_relation", "x", 0, "touch", 0, 6, 0, 6, 0.8, ""), (14, "accept_relation", "seen", 1, "Right ", 9, 15, 9, 15, 0.25, ""),
]
_VCOLS = "ord, action, reason, swap, predicate, st, en, e1, e2, score, family"
_ACTIONS_SQL = f"""{INTERP_SQL}, {PAIRS_SQL}, {O.values_sql('va', _VCOLS, _VARIANTS)}, pk AS (SELECT video_id, window_id, a, b, (window_id - 1) * 15 AS w0, least(119, (window_id - 1) * 15 + 29) AS w1 FROM pw GROUP BY ALL HAVING count(*) >= 2),
ac AS (SELECT pk.*, concat(video_id, ':w', window_id, ':', a, ':', b) AS packet_id, va.*, CASE swap WHEN 0 THEN a ELSE b END AS s, CASE swap WHEN 0 THEN b ELSE a END AS o, lower(trim(action)) AS name FROM pk CROSS JOIN va),
ad AS (SELECT *, list_sort(list_distinct([e1, e2])) AS ev, name IN ({', '.join(f"'{a}'" for a in A.ACTION_TYPES)}) AS known, (name = 'request_candidate_expansion' AND trim(reason) <> '' AND family IN ('contact', 'manipulation')) AS expands FROM ac),
ae AS (SELECT *, min(CASE WHEN expands THEN ord END) OVER (PARTITION BY packet_id) AS at FROM ad),
vl AS (SELECT *, CASE WHEN NOT known THEN 'unsupported_action' WHEN trim(reason) = '' THEN 'missing_reason'
  WHEN name = 'accept_relation' THEN CASE WHEN NOT (lower(trim(predicate)) IN (SELECT unnest(CASE swap WHEN 0 THEN ['left', 'touch', 'follow'] ELSE ['right', 'watch'] END)) AND st <= en AND w0 + en <= w1 AND st <= ev[1] AND ev[-1] <= en AND ev[1] % 3 = 0 AND ev[-1] % 3 = 0 AND ev[-1] < 30 AND score BETWEEN 0 AND 1) THEN 'relation_outside_evidence_packet' END
  WHEN name = 'request_more_frames' THEN CASE WHEN e1 % 3 = 0 THEN 'request_budget_or_frames_invalid' END
  WHEN name = 'request_candidate_expansion' THEN CASE WHEN ord > at THEN 'candidate_expansion_already_requested' WHEN family NOT IN ('contact', 'manipulation') THEN 'request_budget_or_families_invalid' END
  WHEN name NOT IN ('reject_relation', 'defer_for_review') THEN 'action_not_valid_during_proposal' END AS because FROM ae)""".replace(" AS at FROM", " AS xat FROM").replace("ord > at ", "ord > xat ")


def validated(s, d):
    p = visible_pairs(s, d).withColumn("w0", (F.col("window_id") - 1) * 15)
    pid = F.concat(F.col("video_id").cast("string"), F.lit(":w"), F.col("window_id").cast("string"), F.lit(":"), F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string"))
    p = p.withColumn("packet_id", pid).withColumn("w1", F.least(F.lit(119), F.col("w0") + 29))
    strings = lambda *v: F.array(*map(F.lit, v))
    packets = p.select("packet_id", "video_id", "window_id", F.col("w0").alias("start_frame"), F.col("w1").alias("end_frame"), F.sequence("w0", "w1", F.lit(3)).alias("displayed"), F.sequence("w0", "w1").alias("available"), F.lit(2).alias("max_additional"))
    side = lambda x, y, c: p.select("packet_id", F.col(x).alias("subject_id"), F.col(y).alias("object_id"), strings(*c).alias("candidates"), strings("contact", "manipulation").alias("expandable"))
    directions = side("a", "b", ("left", "touch", "follow")).unionByName(side("b", "a", ("right", "watch")))
    v = F.broadcast(s.createDataFrame(_VARIANTS, "ord int, action string, reason string, swap int, predicate string, st int, en int, e1 int, e2 int, score double, family string"))
    turned = F.col("swap") == 1
    acts = p.join(v).select("packet_id", "ord", "action", "reason", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("subject_id"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("object_id"), "predicate",
                            (F.col("w0") + F.col("st")).alias("rel_start"), (F.col("w0") + F.col("en")).alias("rel_end"), F.array(F.col("w0") + F.col("e1"), F.col("w0") + F.col("e2")).alias("evidence_frames"), F.col("score").alias("agent_score"),
                            F.array(F.col("w0") + F.col("e1"), F.col("w0") + F.col("e2")).alias("frame_ids"), F.array("family").alias("families"))
    return A.validate_proposals(acts, packets, directions)


@query(with_obs(f", {_ACTIONS_SQL} SELECT packet_id, ord, because IS NULL AS accepted, because AS reject_reason, CASE WHEN because IS NULL AND name = 'request_more_frames' THEN (w0 + e1)::VARCHAR ELSE '' END AS granted_frames, CASE WHEN because IS NULL AND name = 'request_candidate_expansion' THEN family ELSE '' END AS granted_families FROM vl"))
def validate_actions(s, d):
    return validated(s, d).select("packet_id", "ord", "accepted", "reject_reason", F.concat_ws(",", F.col("granted_frames").cast("array<string>")).alias("granted_frames"), F.concat_ws(",", "granted_families").alias("granted_families"))


@query(with_obs(f", {_ACTIONS_SQL} SELECT packet_id, video_id, s AS subject_id, lower(trim(predicate)) AS predicate, o AS object_id, (w0 + st)::INT AS start_frame, (w0 + en)::INT AS end_frame, score::DOUBLE AS agent_score, 'window_semantic_vl' AS source, window_id::INT AS segment_id FROM vl WHERE because IS NULL AND name = 'accept_relation'"))
def semantic_relations(s, d):
    return A.semantic_relations(validated(s, d)).select("packet_id", "video_id", "subject_id", "predicate", "object_id", "start_frame", "end_frame", "agent_score", "source", "segment_id")


_REVIEWS = [(1, "accept_relation", "fine", "", 0, 0), (2, "change_predicate", "better", " Touch", 0, 0), (3, "change_predicate", "worse", "levitate", 0, 0), (4, "refine_interval", "tighter", "", 1, 0), (5, "refine_interval", "wider", "", -1, 1), (6, "request_more_frames", "more", "", 0, 0), (7, "reject_relation", "", "", 0, 0), (8, "wave", "x", "", 0, 0), (9, "change_predicate", "again", "follow", 0, 0), (10, "reject_relation", "gone", "", 0, 0)]
_RW_COLS = "ord, action, reason, new_predicate, ds, de"
_REVIEW_SQL = f"""{O.values_sql('rvv', _RW_COLS, _REVIEWS)}, {O.predicates_sql()}, ri AS (SELECT *, concat(video_id, '-', printf('r%06d', row_number() OVER (PARTITION BY video_id ORDER BY st, en, s, p, o))) AS relation_id, row_number() OVER (PARTITION BY video_id ORDER BY st, en, s, p, o) AS k FROM mr),
ra AS (SELECT CASE WHEN ord = 1 AND k % 3 = 0 THEN 'r-none' ELSE relation_id END AS relation_id, rvv.*, st + ds AS ns, en + de AS ne, list_filter(ev, lambda f: f >= st + ds) AS nev, ri.st, ri.en, ri.ev FROM ri JOIN rvv ON ((k + ord) % 3 = 0 OR ord < 3) AND (ord <> 10 OR k % 4 = 0)),
rr2 AS (SELECT *, CASE WHEN relation_id = 'r-none' OR action = 'wave' THEN 'unsupported_action_or_relation' WHEN trim(reason) = '' THEN 'missing_reason' WHEN action IN ('accept_relation', 'reject_relation', 'defer_for_review') THEN NULL
  WHEN action = 'change_predicate' THEN CASE WHEN lower(trim(new_predicate)) NOT IN (SELECT name FROM predicates) THEN 'invalid_predicate' END
  WHEN action = 'refine_interval' THEN CASE WHEN NOT (len(nev) > 0 AND st <= ns AND ns <= nev[1] AND nev[-1] <= ne AND ne <= en) THEN 'interval_outside_relation_evidence' END ELSE 'supplemental_request_not_available_in_review' END AS because FROM ra)"""


def _reviews(s, d):
    r = R.with_ids(merged(s, d)).withColumn("k", F.substring("relation_id", 2, 9).cast("int"))
    r = r.withColumn("relation_id", F.concat_ws("-", F.col("video_id").cast("string"), "relation_id")).withColumn("source", F.element_at("sources", 1))
    v = F.broadcast(s.createDataFrame(_REVIEWS, "ord int, action string, reason string, new_predicate string, ds int, de int"))
    acts = r.join(v, (((F.col("k") + F.col("ord")) % 3 == 0) | (F.col("ord") < 3)) & ((F.col("ord") != 10) | (F.col("k") % 4 == 0)))
    lo = F.col("start_frame") + F.col("ds")
    acts = acts.select(F.when((F.col("ord") == 1) & (F.col("k") % 3 == 0), "r-none").otherwise(F.col("relation_id")).alias("relation_id"), "ord", "action", "reason", "new_predicate", lo.alias("new_start"), (F.col("end_frame") + F.col("de")).alias("new_end"), F.filter("evidence_frames", lambda f: f >= F.col("start_frame") + F.col("ds")).alias("evidence_frames"))
    return r, A.validate_reviews(acts, r, O.predicates(s))


@query(with_obs(f"{MERGED}, {_REVIEW_SQL} SELECT relation_id, ord, because IS NULL AS accepted, because AS reject_reason FROM rr2"))
def validate_review(s, d):
    return _reviews(s, d)[1].select("relation_id", "ord", "accepted", "reject_reason")


@query(with_obs(f"""{MERGED}, {_REVIEW_SQL}, ok AS (SELECT * FROM rr2 WHERE because IS NULL), ed AS (SELECT relation_id, max((action = 'reject_relation')::INT) AS gone, arg_max(lower(trim(new_predicate)), ord) FILTER (action = 'change_predicate') AS np, arg_max(ns, ord) FILTER (action = 'refine_interval') AS ns, arg_max(ne, ord) FILTER (action = 'refine_interval') AS ne FROM ok GROUP BY relation_id)
SELECT ri.relation_id, coalesce(np, p) AS predicate, coalesce(ns, st) AS start_frame, coalesce(ne, en) AS end_frame, CASE WHEN np IS NOT NULL OR ns IS NOT NULL THEN 'verify_corrected' ELSE sources[1] END AS source FROM ri LEFT JOIN ed USING (relation_id) WHERE coalesce(gone, 0) = 0"""))
def apply_actions(s, d):
    r, v = _reviews(s, d)
    return A.apply_reviews(r, v.where("accepted")).select("relation_id", "predicate", "start_frame", "end_frame", "source")


@query(with_obs(f""", {_ACTIONS_SQL}, gr AS (SELECT packet_id, w0, w1, name, CASE WHEN because IS NULL AND name = 'request_more_frames' THEN e1 END AS f1, CASE WHEN because IS NULL AND name = 'request_more_frames' THEN e2 END AS f2, CASE WHEN because IS NULL AND name = 'request_candidate_expansion' THEN family END AS fam FROM vl),
fr AS (SELECT packet_id, w0, w1, list_filter(list_sort(list_distinct(flatten(list([w0 + f1, w0 + f2])))), lambda x: x IS NOT NULL AND x <= w1 AND (x - w0) % 3 <> 0) AS more, string_agg(DISTINCT fam, ',') AS fams FROM gr GROUP BY packet_id, w0, w1)
SELECT packet_id || ':supplemental' AS packet_id, packet_id AS parent_id, len(range(w0, w1 + 1, 3)) + least(len(more), 2) AS shown, coalesce(fams, '') AS families, 0 AS max_additional FROM fr WHERE len(more) > 0 OR fams IS NOT NULL"""))
def supplemental_packets(s, d):
    p = visible_pairs(s, d).withColumn("w0", (F.col("window_id") - 1) * 15)
    pid = F.concat(F.col("video_id").cast("string"), F.lit(":w"), F.col("window_id").cast("string"), F.lit(":"), F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string"))
    packets = p.select(pid.alias("packet_id"), F.sequence("w0", F.least(F.lit(119), F.col("w0") + 29), F.lit(3)).alias("displayed"))
    out = A.supplemental_packets(packets, validated(s, d))
    return out.select("packet_id", "parent_id", F.size("displayed").cast("long").alias("shown"), F.concat_ws(",", "granted_families").alias("families"), "max_additional")


@query(with_obs(f""", {INTERP_SQL}, {PAIRS_SQL}, pk AS (SELECT concat(video_id, ':w', window_id, ':', a, ':', b) AS packet_id, a, b FROM pw GROUP BY video_id, window_id, a, b HAVING count(*) >= 2)
SELECT packet_id, CASE WHEN (a + b) % 4 = 0 THEN NULL WHEN (a + b) % 3 = 0 THEN 'second' ELSE 'first' END AS actions, CASE WHEN (a + b) % 4 = 0 THEN 'missing' ELSE 'answered' END AS state FROM pk"""))
def packet_audit(s, d):
    pid = F.concat(F.col("video_id").cast("string"), F.lit(":w"), F.col("window_id").cast("string"), F.lit(":"), F.col("a").cast("string"), F.lit(":"), F.col("b").cast("string"))
    p = visible_pairs(s, d).select(pid.alias("packet_id"), "a", "b")
    keep = p.where("(a + b) % 4 <> 0")
    first = keep.select("packet_id", F.lit(1).alias("ord"), F.lit("first").alias("actions"))
    later = keep.where("(a + b) % 3 = 0").select("packet_id", F.lit(2).alias("ord"), F.lit("second").alias("actions"))
    lost = p.where("(a + b) % 4 = 0").select("packet_id", F.lit(1).alias("ord"), F.lit(None).cast("string").alias("actions"))
    return A.packet_audit(p, first.unionByName(later).unionByName(lost))


@query(with_obs(f"""{CHAIN}, sb AS (SELECT DISTINCT video_id, CASE WHEN a % 5 = 1 THEN concat('w', window_id, '_A', a, '_B', b, '_supplemental.jpg') ELSE concat('w', window_id, '_A', CASE WHEN b % 2 = 0 THEN b ELSE a END, '_B', CASE WHEN b % 2 = 0 THEN a ELSE b END, '.jpg') END AS path, a, b FROM pw WHERE (a + b) % 3 <> 0),
ls AS (SELECT video_id, a, b, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY video_id, a, b ORDER BY path) AS n FROM sb WHERE a % 5 <> 1) WHERE n <= 3 GROUP BY ALL)
SELECT rr.video_id, segment_id, s AS subject_id, p AS predicate, o AS object_id, st AS start_frame, coalesce(paths, '') AS paths, paths IS NULL AS deferred FROM rr LEFT JOIN ls ON ls.video_id = rr.video_id AND ls.a = least(s, o) AND ls.b = greatest(s, o)"""))
def review_evidence_split(s, d):
    p = visible_pairs(s, d, 1).where("(a + b) % 3 <> 0")
    plain = F.concat(F.lit("w"), F.col("window_id").cast("string"), F.lit("_A"), F.when(F.col("b") % 2 == 0, F.col("b")).otherwise(F.col("a")).cast("string"), F.lit("_B"), F.when(F.col("b") % 2 == 0, F.col("a")).otherwise(F.col("b")).cast("string"), F.lit(".jpg"))
    more = F.concat(F.lit("w"), F.col("window_id").cast("string"), F.lit("_A"), F.col("a").cast("string"), F.lit("_B"), F.col("b").cast("string"), F.lit("_supplemental.jpg"))
    boards = p.select("video_id", F.when(F.col("a") % 5 == 1, more).otherwise(plain).alias("path"))
    return A.split_by_storyboard(rules(s, d), boards, 3).select("video_id", "segment_id", "subject_id", "predicate", "object_id", "start_frame", F.concat_ws(",", "paths").alias("paths"), "deferred")


@query(with_obs(" SELECT state, count(*) AS videos FROM (SELECT DISTINCT video_id, CASE video_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'partial' END AS state FROM obs) GROUP BY state"))
def video_states(s, d):
    v = fixture.obs(s, d).select("video_id").distinct()
    return v.select(F.expr("CASE video_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'partial' END").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("videos"))
