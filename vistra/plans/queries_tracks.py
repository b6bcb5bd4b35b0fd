"""Queries over detections and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistra.functions import geometry as g
from vistra.functions import ontology as O
from vistra.operators import detections as D
from vistra.operators import tracks as T
from vistra.sources import files, fixture
from vistra.sources.fixture import DET_SQL
from vistra.plans.registry import query, r6, with_obs


def _videos(s, d):
    return fixture.det(s, d).select("video_id").distinct().withColumn("total_frames", F.lit(fixture.FRAMES))


@query("""
WITH l AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 13 = 0 THEN '  ' WHEN event_id % 17 = 0 THEN '[1]' ELSE props END AS line FROM events),
j AS (SELECT event_id, line FROM l WHERE json_valid(line) AND trim(line) LIKE '{%')
SELECT event_id, CAST(json_extract(line, '$.k') AS BIGINT) AS k FROM j
""")
def scan_jsonl(s, d):
    e = fixture.events(s, d)
    line = F.expr("CASE WHEN event_id % 11 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 13 = 0 THEN '  ' WHEN event_id % 17 = 0 THEN '[1]' ELSE props END")
    return files.parse_lines(e.select("event_id", line.alias("line")), "line", "k long").select("event_id", "k")


@query()
def file_fingerprint(s, d):
    return files.fingerprints(s, d, "*.parquet")


@query(with_obs(""" SELECT video_id, track_id, frame, class_name, sha256('{"class_name":"' || class_name || '","frame":' || frame || ',"track_id":' || track_id || ',"video_id":' || video_id || '}') AS sha256 FROM obs"""))
def stable_hash(s, d):
    return files.stable_hash(fixture.obs(s, d).select("video_id", "track_id", "frame", "class_name"), "class_name", "frame", "track_id", "video_id")


@query(r"""
WITH b AS (SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '([^/?#]*)/?([?#].*)?$', 1), '\.[^.]*$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '_'), ''), 'video') AS base FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM b)
SELECT page_id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS video_id FROM n
""")
def video_id_uniquify(s, d):
    return files.unique_ids(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), "url", "page_id", "video_id")


_THUMBS = """, spine AS (SELECT v.video_id, f.frame::INT AS frame FROM (SELECT DISTINCT video_id FROM det) v, range(0, 120) f(frame)),
th AS (SELECT s.video_id, s.frame, coalesce(sum(o.event_id) % 256, 0)::DOUBLE AS thumb FROM spine s LEFT JOIN obs o ON o.video_id = s.video_id AND o.frame = s.frame GROUP BY ALL),
"""


def _thumbs(s, d):
    o = fixture.obs(s, d).groupBy("video_id", "frame").agg((F.sum("event_id") % 256).cast("double").alias("t"))
    return fixture.frames(s, d).join(o, ["video_id", "frame"], "left").select("video_id", "frame", F.coalesce("t", F.lit(0.0)).alias("thumb"))


def _fold_sql(mode: str) -> str:
    ready = "f.frame - x.last >= 3" if mode == "fixed_sparse" else "f.frame - x.last >= 1"
    reason = "'sparse_schedule'" if mode == "fixed_sparse" else "'interval'"
    hit = f"({ready} AND abs(f.thumb - x.thumb) / 255 >= 0.35)"
    anchor = f"(f.frame - x.last >= 3 OR {hit})"
    name = mode
    return f"""{name} AS (
  SELECT video_id, frame, frame AS last, thumb, 'first' AS reason FROM th WHERE frame = 0 UNION ALL
  SELECT f.video_id, f.frame, CASE WHEN {anchor} THEN f.frame ELSE x.last END, CASE WHEN {anchor} THEN f.thumb ELSE x.thumb END,
    CASE WHEN {hit} THEN 'scene_change' WHEN {anchor} THEN {reason} END FROM {name} x JOIN th f ON f.video_id = x.video_id AND f.frame = x.frame + 1)"""


@query(with_obs(_THUMBS + _fold_sql("fixed_sparse") + ", " + _fold_sql("adaptive") + """
SELECT 'fixed_sparse' AS mode, video_id, frame, reason FROM fixed_sparse WHERE reason IS NOT NULL
UNION ALL SELECT 'adaptive', video_id, frame, reason FROM adaptive WHERE reason IS NOT NULL"""))
def anchor_schedule(s, d):
    t = _thumbs(s, d)
    parts = [D.anchor_schedule(t, mode=m).select(F.lit(m).alias("mode"), "video_id", "frame", "reason") for m in ("fixed_sparse", "adaptive")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {DET_SQL} SELECT DISTINCT video_id, frame, CASE WHEN frame % 15 = 0 AND frame % 45 <> 0 THEN 'dinox' ELSE 'rexomni' END AS source FROM det""")
def hybrid_route(s, d):
    return D.route_sources(fixture.det(s, d).select("video_id", "frame").distinct(), F.col("frame") % 45 == 0)


@query(f"""WITH {DET_SQL}, f AS (SELECT DISTINCT video_id, frame FROM det), n AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1) // 5 AS batch_id FROM f)
SELECT video_id, frame, batch_id, string_agg(frame::VARCHAR, ',' ORDER BY frame) OVER (PARTITION BY video_id, batch_id) AS batch_frames FROM n""".replace(
    "string_agg(frame::VARCHAR, ',' ORDER BY frame) OVER (PARTITION BY video_id, batch_id)", "(SELECT string_agg(m.frame::VARCHAR, ',' ORDER BY m.frame) FROM n m WHERE m.video_id = n.video_id AND m.batch_id = n.batch_id)"))
def frame_batches(s, d):
    out = D.frame_batches(fixture.det(s, d).select("video_id", "frame").distinct())
    return out.withColumn("batch_frames", F.concat_ws(",", F.col("batch_frames").cast("array<string>")))


@query(f"""WITH {DET_SQL}, c AS (SELECT video_id, frame, count(*) AS n FROM det WHERE frame % 3 = 0 GROUP BY ALL)
SELECT v.video_id, f.frame::INT AS frame, coalesce(c.n, 0) AS objects, CASE WHEN c.n IS NULL THEN 'skipped' ELSE 'observed' END AS status
FROM (SELECT DISTINCT video_id FROM det) v CROSS JOIN range(0, 120) f(frame) LEFT JOIN c ON c.video_id = v.video_id AND c.frame = f.frame""")
def frame_spine(s, d):
    return D.frame_spine(_videos(s, d), fixture.det(s, d).where("frame % 3 = 0"))


@query(f"""WITH {DET_SQL} SELECT video_id, frame, event_id, row_number() OVER (PARTITION BY video_id, frame ORDER BY event_id) AS ord FROM det
WHERE x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) >= 4200 QUALIFY ord <= 5""")
def detections_filtered(s, d):
    return D.valid_boxes(fixture.det(s, d), min_area=4200.0, most=5).select("video_id", "frame", "event_id", "ord")


@query(f"""WITH {DET_SQL}, c AS (SELECT event_id, least(greatest(x1, 0), 320.0) AS x1, least(greatest(y1, 0), 120.0) AS y1, least(greatest(x2, 0), 320.0) AS x2, least(greatest(y2, 0), 120.0) AS y2 FROM det)
SELECT * FROM c WHERE x2 > x1 AND y2 > y1""")
def detections_clipped(s, d):
    return D.clipped_boxes(fixture.det(s, d), 320, 120).select("event_id", *g.SIDES)


_BROKEN = """b AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN -1 ELSE frame END AS frame, x1, y1, CASE WHEN event_id % 23 = 0 THEN x1 ELSE x2 END AS x2, y2,
  CASE WHEN event_id % 29 = 0 THEN 1.5 ELSE score END AS score, CASE WHEN event_id % 31 = 0 THEN '  ' ELSE class_name END AS class_name FROM det)"""


@query(f"""WITH {DET_SQL}, {_BROKEN} SELECT event_id, concat_ws(',', CASE WHEN frame < 0 THEN 'negative_frame' END, CASE WHEN NOT (x2 > x1 AND y2 > y1) THEN 'bad_box' END,
  CASE WHEN score IS NOT NULL AND NOT score BETWEEN 0 AND 1 THEN 'bad_score' END, CASE WHEN trim(class_name) = '' THEN 'empty_class' END) AS violations FROM b""")
def contract_violations(s, d):
    broken = fixture.det(s, d).selectExpr("event_id", "CASE WHEN event_id % 19 = 0 THEN -1 ELSE frame END AS frame", "x1", "y1", "CASE WHEN event_id % 23 = 0 THEN x1 ELSE x2 END AS x2", "y2",
                                          "CASE WHEN event_id % 29 = 0 THEN 1.5D ELSE score END AS score", "CASE WHEN event_id % 31 = 0 THEN '  ' ELSE class_name END AS class_name")
    return D.violations(broken).select("event_id", F.concat_ws(",", "violations").alias("violations"))


@query(f"""WITH {DET_SQL} SELECT event_id, x1, y1, x2, y2, CASE WHEN event_id % 3 = 0 THEN -1 ELSE (event_id % 9)::INT END AS class, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE class_name END AS class_name, CASE WHEN event_id % 6 = 5 THEN NULL ELSE 0.25 END AS score,
  CASE WHEN event_id % 6 = 5 THEN 'unavailable' WHEN event_id % 6 = 1 THEN 'native' ELSE 'legacy_confidence' END AS score_kind FROM det WHERE event_id % 11 NOT IN (1, 2, 3) AND event_id % 13 <> 5 AND event_id % 17 <> 4""")
def detections_compacted(s, d):
    raw = """concat('{"bbox":', CASE event_id % 11 WHEN 1 THEN '[1,2,3]' WHEN 2 THEN '[1,2,"x",4]' WHEN 3 THEN 'null' ELSE concat('[', x1, ',', y1, ',', x2, ',', y2, ']') END,
      CASE WHEN event_id % 13 = 5 THEN ',"class":"dog"' WHEN event_id % 3 = 0 THEN '' ELSE concat(',"class":', event_id % 9) END, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',"class_name":"', class_name, '"') END,
      CASE WHEN event_id % 17 = 4 THEN ',"score":"high"' WHEN event_id % 6 = 5 THEN '' WHEN event_id % 2 = 0 THEN ',"confidence":0.25' ELSE ',"score":0.25' END, CASE WHEN event_id % 6 = 1 THEN ',"score_kind":"native"' ELSE '' END, '}')"""
    return D.compact(fixture.det(s, d).select("event_id", F.expr(raw).alias("raw")), "raw").select("event_id", *g.SIDES, "class", "class_name", "score", "score_kind")


_TRACK_ROWS = """event_id, CASE WHEN event_id % 31 = 0 THEN -1 ELSE track_id END AS track_id, CASE WHEN event_id % 29 = 0 THEN -2 ELSE frame END AS frame, x1, y1, CASE WHEN event_id % 23 = 0 THEN x1 ELSE x2 END AS x2, y2,
  CASE WHEN event_id % 19 = 0 THEN '  ' ELSE class_name END AS class_name, CASE WHEN event_id % 17 = 0 THEN 1.5 ELSE 0.5 END AS confidence, CASE event_id % 4 WHEN 0 THEN 'predicted' WHEN 1 THEN 'guessed' ELSE 'observed' END AS box_source, event_id % 4 = 0 AS is_predicted, event_id % 6 <> 0 AS seen"""


@query(with_obs(f""", r AS (SELECT {_TRACK_ROWS} FROM obs) SELECT event_id, concat_ws(',', CASE WHEN track_id < 0 THEN 'bad_track_id' END, CASE WHEN frame < 0 THEN 'negative_frame' END, CASE WHEN x2 <= x1 THEN 'bad_box' END, CASE WHEN seen AND x2 <= x1 THEN 'bad_observed_box' END, CASE WHEN trim(class_name) = '' THEN 'empty_class' END,
  CASE WHEN confidence > 1 THEN 'bad_score' END, CASE WHEN box_source = 'guessed' THEN 'unknown_source' END, CASE WHEN is_predicted AND seen THEN 'predicted_but_observed' END, CASE WHEN box_source = 'observed' AND NOT seen THEN 'observed_without_box' END, CASE WHEN box_source <> 'observed' AND seen THEN 'unobserved_with_box' END) AS violations FROM r"""))
def track_contract(s, d):
    r = fixture.obs(s, d).selectExpr(*fixture._split(_TRACK_ROWS)).withColumn("bbox", F.array(*g.box()))
    r = r.withColumn("bbox_observed", F.when(F.col("seen"), F.col("bbox")))
    return D.track_violations(r).select("event_id", F.concat_ws(",", "violations").alias("violations"))


_RELATION_ROWS = """event_id, track_id AS subject_id, CASE WHEN event_id % 5 = 0 THEN track_id WHEN event_id % 7 = 0 THEN -1 ELSE track_id + 1 END AS object_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'left' END AS predicate, frame AS start_frame, CASE WHEN event_id % 13 = 0 THEN frame ELSE frame + 5 END AS end_frame,
  0.5 AS confidence, CASE WHEN event_id % 17 = 0 THEN -0.1 ELSE 0.1 END AS rule_support, 0.2 AS agent_score, 0.3 AS ranking_score, CASE WHEN event_id % 3 = 0 THEN frame + 5 ELSE frame END AS evidence"""


@query(with_obs(f""", r AS (SELECT {_RELATION_ROWS} FROM obs) SELECT event_id, concat_ws(',', CASE WHEN object_id < 0 THEN 'bad_track_id' END, CASE WHEN object_id = subject_id THEN 'same_track' END, CASE WHEN trim(predicate) = '' THEN 'empty_predicate' END, CASE WHEN end_frame <= start_frame THEN 'bad_span' END,
  CASE WHEN rule_support < 0 THEN 'bad_score' END, CASE WHEN evidence < start_frame OR evidence >= end_frame THEN 'evidence_outside_span' END) AS violations FROM r"""))
def relation_contract(s, d):
    r = fixture.obs(s, d).selectExpr(*fixture._split(_RELATION_ROWS)).withColumn("evidence_frames", F.array("evidence"))
    return D.relation_violations(r).select("event_id", F.concat_ws(",", "violations").alias("violations"))


@query(f"""WITH {DET_SQL}, f AS (SELECT DISTINCT video_id, frame FROM det), n AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1) // 5 AS batch_id FROM f)
SELECT video_id, batch_id, CASE WHEN batch_id % 3 = 0 THEN 'repeated_frame' ELSE 'length_differs' END AS problem FROM n WHERE batch_id % 3 < 2 GROUP BY ALL""")
def batch_problems(s, d):
    b = D.frame_batches(fixture.det(s, d).select("video_id", "frame").distinct())
    twice = b.where("batch_id % 3 = 0").unionByName(b.where("batch_id % 3 = 0"))
    longer = b.where("batch_id % 3 = 1").withColumn("batch_frames", F.concat("batch_frames", F.array(F.lit(-1))))
    return D.batch_problems(twice.unionByName(longer).unionByName(b.where("batch_id % 3 = 2")))


@query(f"""WITH {DET_SQL}, c AS (SELECT video_id, frame, count(*) AS n FROM det WHERE frame % 3 = 0 GROUP BY ALL) SELECT video_id, frame FROM c""")
def tracker_clock(s, d):
    from vistra.operators import tracking as K

    return K.clock(D.frame_spine(_videos(s, d), fixture.det(s, d).where("frame % 3 = 0"))).select("video_id", "frame")


@query(f"""WITH {DET_SQL}, r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 3 = 1 THEN NULL ELSE class_name END AS class_name, CASE WHEN event_id % 4 = 0 THEN 'Bike' ELSE '' END AS category, CASE WHEN event_id % 5 = 0 THEN 'red-Panda' END AS label FROM det),
f AS (SELECT event_id, coalesce(nullif(trim(class_name), ''), nullif(trim(category), ''), nullif(trim(label), '')) AS v FROM r) SELECT event_id, CASE WHEN v IS NULL THEN 'unknown' WHEN v = 'Bike' THEN 'bicycle' WHEN v = 'red-Panda' THEN 'red_panda' ELSE v END AS label FROM f""")
def class_fallback(s, d):
    from vistra.operators import labels

    r = fixture.det(s, d).selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 3 = 1 THEN NULL ELSE class_name END AS class_name", "CASE WHEN event_id % 4 = 0 THEN 'Bike' ELSE '' END AS category", "CASE WHEN event_id % 5 = 0 THEN 'red-Panda' END AS class")
    return labels.first_name(r, O.aliases(s)).select("event_id", "label")


@query(f"""WITH {DET_SQL} SELECT DISTINCT class_name, CASE WHEN class_name IN ('car', 'bicycle') THEN 'vehicle' ELSE class_name END AS class_group FROM det""")
def class_groups(s, d):
    from vistra.operators import tracking as K

    same = s.createDataFrame([("Vehicle", " car"), ("Vehicle", "bicycle")], "canonical string, other string")
    return K.class_groups(fixture.det(s, d).select("class_name").distinct(), same)


@query(f"""WITH {DET_SQL}, f AS (SELECT video_id, class_name, min(event_id) AS first FROM det GROUP BY ALL)
SELECT video_id, class_name, (dense_rank() OVER (PARTITION BY video_id ORDER BY first) - 1)::INT AS class_id FROM f""")
def class_ids(s, d):
    from vistra.operators import labels

    return labels.class_ids(fixture.det(s, d), "event_id")


@query(with_obs("""
SELECT video_id, track_id, frame, round((x1+x2)/2,6)+0.0 AS cx, round((y1+y2)/2,6)+0.0 AS cy, round((x2-x1)*(y2-y1),6)+0.0 AS area, round(greatest(1,x2-x1)*greatest(1,y2-y1),6)+0.0 AS area_clamped FROM obs"""))
def box_geometry(s, d):
    b = g.box()
    cx, cy = g.center(b)
    return fixture.obs(s, d).select("video_id", "track_id", "frame", r6(cx).alias("cx"), r6(cy).alias("cy"), r6(g.area(b)).alias("area"), r6(g.area_clamped(b)).alias("area_clamped"))


@query(with_obs("""
SELECT event_id, least(greatest(least(x1,x2),0),299.0) AS cx1, least(greatest(least(y1,y2),0),119.0) AS cy1,
  greatest(least(greatest(greatest(x1,x2),0),299.0), least(greatest(least(x1,x2),0),299.0)+1) AS cx2,
  greatest(least(greatest(greatest(y1,y2),0),119.0), least(greatest(least(y1,y2),0),119.0)+1) AS cy2 FROM obs"""))
def clip_box(s, d):
    c = g.clip(g.box(), 300, 120)
    return fixture.obs(s, d).select("event_id", *[x.alias(f"c{n}") for x, n in zip(c, g.SIDES, strict=True)])


@query(with_obs("""
SELECT video_id, track_id, class_name, votes FROM (SELECT video_id, track_id, class_name, count(*) AS votes, min(frame) AS f FROM obs GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY votes DESC, f) = 1"""))
def main_class(s, d):
    return T.main_class(fixture.obs(s, d))


@query(with_obs(""", n AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS rn, coalesce(score, 1.0) AS w FROM obs),
v AS (SELECT a.video_id, a.track_id, a.frame, b.class_name, sum(b.w) AS weight, min(b.frame) AS f FROM n a JOIN n b ON a.video_id = b.video_id AND a.track_id = b.track_id AND b.rn BETWEEN a.rn - 11 AND a.rn GROUP BY ALL)
SELECT video_id, track_id, frame, class_name AS voted_class, round(weight, 6)+0.0 AS weight FROM v QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY weight DESC, f) = 1"""))
def class_vote_window(s, d):
    return T.recent_class_vote(fixture.obs(s, d)).select("video_id", "track_id", "frame", "voted_class", r6(F.col("weight")).alias("weight"))


@query(with_obs(""", m AS (SELECT *, coalesce(sqrt(pow((x1+x2)/2 - lag((x1+x2)/2) OVER w, 2) + pow((y1+y2)/2 - lag((y1+y2)/2) OVER w, 2)), 0) AS step FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))
SELECT video_id, track_id, frame, round(avg(score) OVER u, 10)+0.0 AS confidence, count(*) OVER u AS hits, frame - min(frame) OVER u + 1 AS duration_frames, round(sum(step) OVER u, 6)+0.0 AS total_distance,
  round(sum(step) OVER u / (frame - min(frame) OVER u + 1), 6)+0.0 AS avg_speed FROM m WINDOW u AS (PARTITION BY video_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING)"""))
def track_kinematics(s, d):
    k = T.kinematics(fixture.obs(s, d))
    return k.select("video_id", "track_id", "frame", F.round("confidence", 10).alias("confidence"), "hits", "duration_frames", r6(F.col("total_distance")).alias("total_distance"), r6(F.col("avg_speed")).alias("avg_speed"))


@query(with_obs("""
SELECT video_id, track_id, frame, round((x1 - lag(x1) OVER w) / (frame - lag(frame) OVER w), 6)+0.0 AS v_x1, round((y2 - lag(y2) OVER w) / (frame - lag(frame) OVER w), 6)+0.0 AS v_y2
FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)"""))
def track_velocity(s, d):
    return T.velocity(fixture.obs(s, d)).select("video_id", "track_id", "frame", r6(F.col("v_x1")).alias("v_x1"), r6(F.col("v_y2")).alias("v_y2"))


@query(with_obs(""", w AS (SELECT video_id, track_id, class_name, sum(coalesce(score, 1.0)) AS w FROM obs GROUP BY ALL)
SELECT video_id, track_id, class_name, round(w / sum(w) OVER (PARTITION BY video_id, track_id), 6)+0.0 AS share FROM w"""))
def class_distribution(s, d):
    return T.class_distribution(fixture.obs(s, d)).withColumn("share", r6(F.col("share")))


@query(with_obs(""", w AS (SELECT video_id, track_id, class_name, sum(coalesce(score, 1.0)) AS w FROM obs GROUP BY ALL),
p AS (SELECT video_id, track_id, class_name, w / sum(w) OVER (PARTITION BY video_id, track_id) AS p FROM w)
SELECT a.video_id, a.track_id AS a, b.track_id AS b, round(sum(least(a.p, b.p)), 6)+0.0 AS overlap FROM p a JOIN p b ON a.video_id = b.video_id AND a.class_name = b.class_name AND a.track_id < b.track_id GROUP BY ALL"""))
def class_overlap(s, d):
    return T.class_overlap(T.class_distribution(fixture.obs(s, d))).withColumn("overlap", r6(F.col("overlap")))


@query("""
WITH r AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rk FROM embeddings),
e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM r WHERE rk <= 20), m AS (SELECT label, dim, avg(v) AS m FROM e GROUP BY ALL)
SELECT label, dim::INT AS dim, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12), 6)+0.0 AS value FROM m""")
def mean_embedding(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("label", "embedding", F.col("vec_id").alias("ord"))
    return T.mean_embedding(e, "label").withColumn("value", r6(F.col("value")))


@query(with_obs(" SELECT video_id, track_id, count(*) AS frames FROM obs GROUP BY ALL HAVING count(*) < 45"))
def short_tracks(s, d):
    return T.short_tracks(fixture.obs(s, d), 45)


_DRIFT = """dr AS (SELECT video_id, track_id, coalesce(sum(c), 0)::BIGINT AS changes FROM (SELECT video_id, track_id, CASE WHEN class_name <> lag(class_name) OVER w THEN 1 WHEN lag(class_name) OVER w IS NOT NULL THEN 0 END AS c FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)) GROUP BY ALL HAVING coalesce(sum(c), 0) > 1)"""
_JUMP = """ju AS (SELECT video_id, track_id, frame, sqrt(pow((x1+x2)/2 - lag((x1+x2)/2) OVER w, 2) + pow((y1+y2)/2 - lag((y1+y2)/2) OVER w, 2)) / sqrt(pow(greatest(1, x2-x1), 2) + pow(greatest(1, y2-y1), 2)) AS jump_ratio
  FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame) QUALIFY jump_ratio > 0.45)"""


@query(with_obs(f", {_DRIFT} SELECT * FROM dr"))
def class_drift(s, d):
    return T.class_drift(fixture.obs(s, d))


@query(with_obs(f", {_JUMP} SELECT video_id, track_id, frame, round(jump_ratio, 6)+0.0 AS jump_ratio FROM ju"))
def large_jumps(s, d):
    return T.large_jumps(fixture.obs(s, d)).withColumn("jump_ratio", r6(F.col("jump_ratio")))


@query(with_obs(f""", {_DRIFT}, {_JUMP}, sh AS (SELECT video_id, track_id FROM obs GROUP BY ALL HAVING count(*) < 45),
k AS (SELECT video_id, track_id FROM sh UNION SELECT video_id, track_id FROM dr UNION SELECT video_id, track_id FROM ju)
SELECT v.video_id, v.tracks, (SELECT count(*) FROM sh WHERE sh.video_id = v.video_id) AS short_tracks, (SELECT count(*) FROM dr WHERE dr.video_id = v.video_id) AS class_drifts,
  (SELECT count(*) FROM ju WHERE ju.video_id = v.video_id) AS large_jumps, (SELECT count(*) FROM k WHERE k.video_id = v.video_id) AS risk_tracks, (SELECT count(*) FROM k WHERE k.video_id = v.video_id) = 0 AS passed
FROM (SELECT video_id, count(DISTINCT track_id) AS tracks FROM obs GROUP BY ALL) v"""))
def track_qc(s, d):
    return T.quality(fixture.obs(s, d), min_frames=45)


INTERP_SQL = """it AS (
  SELECT video_id, track_id, frame, class_name, score, x1, y1, x2, y2, 'observed' AS box_source, false AS is_predicted FROM obs UNION ALL
  SELECT video_id, track_id, f::INT, class_name, score, x1 + (nx1 - x1) * ((f - frame) / (nf - frame)), y1 + (ny1 - y1) * ((f - frame) / (nf - frame)), x2 + (nx2 - x2) * ((f - frame) / (nf - frame)), y2 + (ny2 - y2) * ((f - frame) / (nf - frame)), 'interpolated', true
  FROM (SELECT *, unnest(range(frame + 1, nf)) AS f FROM (SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2 FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)) WHERE nf - frame - 1 BETWEEN 1 AND 6))"""


@query(with_obs(f""", {INTERP_SQL} SELECT video_id, track_id, frame, class_name, box_source, is_predicted, round(x1,6)+0.0 AS x1, round(y1,6)+0.0 AS y1, round(x2,6)+0.0 AS x2, round(y2,6)+0.0 AS y2 FROM it"""))
def interpolate_gaps(s, d):
    return T.interpolate_gaps(fixture.obs(s, d)).select("video_id", "track_id", "frame", "class_name", "box_source", "is_predicted", *[r6(F.col(c)).alias(c) for c in g.SIDES])


@query(with_obs(f""", {INTERP_SQL}, n AS (SELECT *, greatest(coalesce(frame - lag(frame) OVER (PARTITION BY video_id, track_id ORDER BY frame) - 1, 0), 0) AS gap FROM it)
SELECT video_id, track_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS output_frames, count(*) FILTER (box_source = 'observed') AS observed_frames, count(*) FILTER (box_source = 'interpolated') AS interpolated_frames,
  count(*) FILTER (gap > 0) + 1 AS segments, max(gap) AS max_gap, max(frame) - min(frame) + 1 AS span_frames, round_even(count(*) / (max(frame) - min(frame) + 1), 4)+0.0 AS coverage_ratio,
  round_even(count(*) FILTER (box_source = 'observed') / (max(frame) - min(frame) + 1), 4)+0.0 AS observed_ratio, round_even(count(*) FILTER (box_source = 'interpolated') / count(*), 4)+0.0 AS interpolation_ratio FROM n GROUP BY video_id, track_id"""))
def track_continuity(s, d):
    c = T.continuity(T.interpolate_gaps(fixture.obs(s, d)))
    return c.select("video_id", "track_id", "start_frame", "end_frame", "output_frames", "observed_frames", "interpolated_frames", "segments", "max_gap", "span_frames", *[(F.col(x) + F.lit(0.0)).alias(x) for x in ("coverage_ratio", "observed_ratio", "interpolation_ratio")])


@query(f"""WITH {DET_SQL}, f AS (SELECT DISTINCT video_id, frame FROM det) SELECT video_id, frame, (count(*) FILTER (frame IN (60, 90)) OVER (PARTITION BY video_id ORDER BY frame))::BIGINT AS scene_id FROM f""")
def scene_ids(s, d):
    f = fixture.det(s, d).select("video_id", "frame").distinct().withColumn("reason", F.when(F.col("frame").isin(60, 90), "scene_change").otherwise("interval"))
    return T.scene_ids(f).drop("reason")


@query(with_obs("""
SELECT video_id, track_id, arg_min(class_name, frame) AS category, string_agg(frame || ':' || x1::BIGINT || '-' || y2::BIGINT, ',' ORDER BY frame) AS trajectory FROM obs GROUP BY video_id, track_id"""))
def trajectory_pivot(s, d):
    p = T.trajectory_pivot(fixture.obs(s, d))
    text = F.transform(F.map_entries("trajectory"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"][0].cast("long").cast("string"), F.lit("-"), e["value"][3].cast("long").cast("string")))
    return p.select("video_id", "track_id", "category", F.concat_ws(",", text).alias("trajectory"))


@query(with_obs(""", w AS (SELECT video_id, unnest(range(1, 8)) AS window_id FROM (SELECT DISTINCT video_id FROM obs))
SELECT w.video_id, w.window_id::INT AS window_id, ((w.window_id - 1) * 15)::INT AS start_frame, least(119, (w.window_id - 1) * 15 + 29)::INT AS end_frame, round((w.window_id - 1) * 15 / 25, 6)+0.0 AS start_time, round(least(119, (w.window_id - 1) * 15 + 29) / 25, 6)+0.0 AS end_time, least(120 - (w.window_id - 1) * 15, 30)::INT AS frame_count,
  (SELECT string_agg(t::VARCHAR, ',' ORDER BY t) FROM (SELECT DISTINCT o.track_id AS t FROM obs o WHERE o.video_id = w.video_id AND o.frame BETWEEN (w.window_id - 1) * 15 AND (w.window_id - 1) * 15 + 29)) AS track_ids FROM w"""))
def sliding_windows(s, d):
    w = T.windows(_videos(s, d).withColumn("fps", F.lit(25)))
    inside = T.assign_windows(fixture.obs(s, d).select("video_id", "track_id", "frame"), fixture.FRAMES).groupBy("video_id", "window_id").agg(F.array_sort(F.collect_set("track_id")).alias("ids"))
    return w.join(inside, ["video_id", "window_id"], "left").select("video_id", "window_id", "start_frame", "end_frame", r6(F.col("start_time")).alias("start_time"), r6(F.col("end_time")).alias("end_time"), "frame_count", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("track_ids"))


@query(with_obs("""
SELECT o.video_id, o.track_id, o.frame, w.window_id::INT AS window_id, ((w.window_id - 1) * 15)::INT AS start_frame, least(119, (w.window_id - 1) * 15 + 29)::INT AS end_frame
FROM obs o JOIN range(1, 8) w(window_id) ON o.frame BETWEEN (w.window_id - 1) * 15 AND (w.window_id - 1) * 15 + 29"""))
def window_assign(s, d):
    return T.assign_windows(fixture.obs(s, d).select("video_id", "track_id", "frame"), fixture.FRAMES)


#: Videos of unequal length, and their windows: regular ones, and one more where frames are left over.
LENGTHS_SQL = """vl AS (SELECT DISTINCT video_id, (40 + (video_id * 37) % 81)::INT AS n FROM obs),
vw AS (SELECT video_id, n, w.window_id, (w.window_id - 1) * 15 AS st FROM vl, range(1, 9) w(window_id) WHERE w.window_id - 1 <= greatest(0, n - 30) // 15 OR (w.window_id - 2 = greatest(0, n - 30) // 15 AND (w.window_id - 2) * 15 + 30 < n AND (w.window_id - 1) * 15 < n))"""


def lengths(s, d):
    return fixture.det(s, d).select("video_id").distinct().withColumn("total_frames", (40 + (F.col("video_id") * 37) % 81).cast("int"))


@query(with_obs(f""", {LENGTHS_SQL} SELECT video_id, window_id::INT AS window_id, st::INT AS start_frame, least(n - 1, st + 29)::INT AS end_frame, (least(n - 1, st + 29) - st + 1)::INT AS frame_count FROM vw"""))
def sliding_windows_lengths(s, d):
    return T.windows(lengths(s, d)).select("video_id", "window_id", "start_frame", "end_frame", "frame_count")


@query(with_obs(f""", {LENGTHS_SQL} SELECT o.video_id, track_id, frame, window_id::INT AS window_id, st::INT AS start_frame, least(n - 1, st + 29)::INT AS end_frame FROM obs o JOIN vw ON vw.video_id = o.video_id AND frame BETWEEN st AND least(n - 1, st + 29)"""))
def window_assign_lengths(s, d):
    return T.assign_windows(fixture.obs(s, d).select("video_id", "track_id", "frame"), lengths(s, d))


#: Tracks some of whose rows are predicted, not observed; gaps between observed rows are filled over them.
MIXED_SQL = """mx AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'predicted' ELSE 'observed' END AS src FROM obs),
mo AS (SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2 FROM mx WHERE src = 'observed' WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
mf AS (SELECT video_id, track_id, f::INT AS frame, class_name, score, x1 + (nx1 - x1) * ((f - frame) / (nf - frame)) AS x1, y1 + (ny1 - y1) * ((f - frame) / (nf - frame)) AS y1, x2 + (nx2 - x2) * ((f - frame) / (nf - frame)) AS x2, y2 + (ny2 - y2) * ((f - frame) / (nf - frame)) AS y2 FROM (SELECT *, unnest(range(frame + 1, nf)) AS f FROM mo WHERE nf - frame - 1 BETWEEN 1 AND 6)),
it AS (SELECT video_id, track_id, frame, class_name, score, x1, y1, x2, y2, 'observed' AS box_source, false AS is_predicted FROM mx WHERE src = 'observed'
  UNION ALL SELECT mf.video_id, mf.track_id, mf.frame, coalesce(mx.class_name, mf.class_name), CASE WHEN mx.frame IS NULL THEN mf.score ELSE mx.score END, mf.x1, mf.y1, mf.x2, mf.y2, 'interpolated', true FROM mf LEFT JOIN mx ON mx.video_id = mf.video_id AND mx.track_id = mf.track_id AND mx.frame = mf.frame
  UNION ALL SELECT video_id, track_id, frame, class_name, score, x1, y1, x2, y2, 'predicted', true FROM mx WHERE src = 'predicted' AND (video_id, track_id, frame) NOT IN (SELECT (video_id, track_id, frame) FROM mf))"""


def mixed(s, d):
    source = F.when(F.col("event_id") % 9 == 0, "predicted").otherwise("observed")
    return fixture.obs(s, d).withColumns({"box_source": source, "is_predicted": source == "predicted"})


@query(with_obs(f""", {MIXED_SQL} SELECT video_id, track_id, frame, class_name, round(score, 6)+0.0 AS score, box_source, is_predicted, round(x1,6)+0.0 AS x1, round(y2,6)+0.0 AS y2 FROM it"""))
def interpolate_mixed(s, d):
    return T.interpolate_gaps(mixed(s, d)).select("video_id", "track_id", "frame", "class_name", r6(F.col("score")).alias("score"), "box_source", "is_predicted", r6(F.col("x1")).alias("x1"), r6(F.col("y2")).alias("y2"))


_MIXED_JUMP = _JUMP.replace("FROM obs WINDOW", "FROM mx WHERE src = 'observed' WINDOW")


@query(with_obs(f""", {MIXED_SQL}, {_DRIFT}, {_MIXED_JUMP}, sh AS (SELECT video_id, track_id, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) < 45)
SELECT video_id, track_id, 'short_track' AS type, n::BIGINT AS amount, NULL::INT AS frame, NULL::DOUBLE AS jump_ratio FROM sh UNION ALL SELECT video_id, track_id, 'class_drift', changes, NULL, NULL FROM dr UNION ALL SELECT video_id, track_id, 'large_jump', NULL, frame, round(jump_ratio, 6)+0.0 FROM ju"""))
def risk_items(s, d):
    return T.risk_items(mixed(s, d), min_frames=45).withColumn("jump_ratio", r6(F.col("jump_ratio")))


@query(with_obs(""" SELECT video_id, track_id, frame, CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE x1 END WHEN event_id % 5 = 0 THEN x1 + 1 ELSE x1 END AS x1, CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE y2 END WHEN event_id % 5 = 0 THEN y2 + 1 ELSE y2 END AS y2 FROM obs"""))
def effective_box(s, d):
    box = F.array(*g.box())
    seen = F.when(F.col("event_id") % 9 == 0, F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))).when(F.col("event_id") % 5 == 0, F.transform(box, lambda v: v + 1))
    rows = fixture.obs(s, d).withColumns({"bbox": box, "bbox_observed": seen}).withColumn("b", g.effective("bbox", "bbox_observed"))
    return rows.select("video_id", "track_id", "frame", F.col("b")[0].alias("x1"), F.col("b")[3].alias("y2"))


@query(with_obs(""", n AS (SELECT *, CASE WHEN frame > lag(frame) OVER w + 2 THEN 1 ELSE 0 END AS fresh FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))
SELECT video_id, track_id, frame, (sum(fresh) OVER (PARTITION BY video_id, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING))::BIGINT AS run_id FROM n"""))
def frame_runs(s, d):
    return T.frame_runs(fixture.obs(s, d).select("video_id", "track_id", "frame"), ("video_id", "track_id"), 1)
