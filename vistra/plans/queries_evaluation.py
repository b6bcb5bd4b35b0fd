"""Queries that score relations against gold ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistra.functions import geometry as g
from vistra.functions import ontology as O
from vistra.operators import evaluation as E
from vistra.operators import relations as R
from vistra.operators import tracks as T
from vistra.plans.registry import query, r6, with_gold
from vistra.sources import annotations, fixture

# Predictions and gold relations: pairs of tracks with 20 common frames or more, from the latest and the earliest detections.
_REL = """SELECT concat('{p}', a.track_id, '_', b.track_id) AS rel_id, a.video_id, a.track_id AS s, CASE (a.track_id + b.track_id) % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'next_to' ELSE 'above' END AS p, b.track_id AS o, min(a.frame) + {shift} AS st, max(a.frame) AS en,
  ((a.track_id * 7 + b.track_id * 3) % 20) / 20.0::DOUBLE AS score FROM {t} a JOIN {t} b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id GROUP BY a.video_id, a.track_id, b.track_id HAVING count(*) >= 20 AND {cond}"""
_IT = lambda t, src: f"""{t} AS (SELECT video_id, track_id, frame, x1, y1, x2, y2 FROM {src} UNION ALL
  SELECT video_id, track_id, f::INT, x1 + (nx1 - x1) * ((f - frame) / (nf - frame)), y1 + (ny1 - y1) * ((f - frame) / (nf - frame)), x2 + (nx2 - x2) * ((f - frame) / (nf - frame)), y2 + (ny2 - y2) * ((f - frame) / (nf - frame))
  FROM (SELECT *, unnest(range(frame + 1, nf)) AS f FROM (SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2 FROM {src} WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)) WHERE nf - frame - 1 BETWEEN 1 AND 6))"""  # noqa: E731
_MC = lambda t, src: f"""{t} AS (SELECT video_id, track_id, class_name FROM (SELECT video_id, track_id, class_name, count(*) AS n, min(frame) AS f FROM {src} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY n DESC, f) = 1)"""
BASE = f""", pr AS ({_REL.format(p='p', t='obs', shift='2', cond='(a.track_id + b.track_id) % 5 <> 0')}), gr AS ({_REL.format(p='g', t='gobs', shift='0', cond='(a.track_id * b.track_id) % 4 <> 1')}),
{_IT('pit', 'obs')}, {_IT('git', 'gobs')}, {_MC('pmc', 'obs')}, {_MC('gmc', 'gobs')}"""
_TF = lambda n, r, t, m: f"""{n}0 AS (SELECT r.video_id, x.class_name AS s_cat, r.p, y.class_name AS o_cat, r.rel_id, r.score, s.frame, s.x1 AS sx1, s.y1 AS sy1, s.x2 AS sx2, s.y2 AS sy2, o.x1 AS ox1, o.y1 AS oy1, o.x2 AS ox2, o.y2 AS oy2
  FROM {r} r JOIN {t} s ON s.video_id = r.video_id AND s.track_id = r.s AND s.frame BETWEEN r.st AND r.en JOIN {t} o ON o.video_id = r.video_id AND o.track_id = r.o AND o.frame = s.frame JOIN {m} x ON x.video_id = r.video_id AND x.track_id = r.s JOIN {m} y ON y.video_id = r.video_id AND y.track_id = r.o),
{n} AS (SELECT *, rel_id || '-' || run AS id FROM (SELECT *, sum(fresh) OVER (PARTITION BY video_id, rel_id ORDER BY frame ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN frame > lag(frame) OVER (PARTITION BY video_id, rel_id ORDER BY frame) + 1 THEN 1 ELSE 0 END AS fresh FROM {n}0))),
{n}t AS (SELECT video_id, s_cat, p, o_cat, rel_id, run, id, min(frame) AS start_frame, max(frame) + 1 AS end_excl, max(score) AS score, sum((sx2 - sx1 + 1) * (sy2 - sy1 + 1)) AS sv, sum((ox2 - ox1 + 1) * (oy2 - oy1 + 1)) AS ov FROM {n} GROUP BY ALL)"""  # noqa: E731
_X = lambda q: f"greatest(0, least(a.{q}x2, b.{q}x2) - greatest(a.{q}x1, b.{q}x1) + 1) * greatest(0, least(a.{q}y2, b.{q}y2) - greatest(a.{q}y1, b.{q}y1) + 1)"
TUBES = f"{BASE}, {_TF('pt', 'pr', 'pit', 'pmc')}, {_TF('gt', 'gr', 'git', 'gmc')}"
OVERLAP = f"""ovl AS (SELECT i.video_id, i.pid, i.gid, least(si / (p.sv + g.sv - si), oi / (p.ov + g.ov - oi)) AS viou, p.s_cat, p.p, p.o_cat FROM (SELECT a.video_id, a.id AS pid, b.id AS gid, sum({_X('s')}) AS si, sum({_X('o')}) AS oi FROM pt a JOIN gt b ON a.video_id = b.video_id AND a.s_cat = b.s_cat AND a.p = b.p AND a.o_cat = b.o_cat AND a.frame = b.frame GROUP BY ALL) i
  JOIN ptt p ON p.id = i.pid AND p.video_id = i.video_id JOIN gtt g ON g.id = i.gid AND g.video_id = i.video_id)"""
RANKED = "pk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, id) AS rank FROM ptt)"
# Greedy matching as a recursion over the predictions of a video in their order; what is taken is carried along.
MATCH = """cd AS (SELECT video_id, pid, list({'g': gid, 'v': round(viou, 9)} ORDER BY round(viou, 9) DESC, gid) AS c FROM ovl WHERE round(viou, 9) >= 0.5 GROUP BY ALL),
pc AS (SELECT pk.video_id, pk.rank, pk.id, cd.c FROM pk LEFT JOIN cd ON cd.video_id = pk.video_id AND cd.pid = pk.id),
mm AS (SELECT video_id, 0::BIGINT AS rank, NULL::VARCHAR AS id, NULL::VARCHAR AS gold, []::VARCHAR[] AS used FROM (SELECT DISTINCT video_id FROM pk) UNION ALL
  SELECT pc.video_id, pc.rank, pc.id, list_filter(pc.c, lambda x: NOT list_contains(mm.used, x.g))[1].g, CASE WHEN list_filter(pc.c, lambda x: NOT list_contains(mm.used, x.g))[1].g IS NULL THEN mm.used ELSE list_append(mm.used, list_filter(pc.c, lambda x: NOT list_contains(mm.used, x.g))[1].g) END
  FROM mm JOIN pc ON pc.video_id = mm.video_id AND pc.rank = mm.rank + 1),
om AS (SELECT pk.*, mm.gold FROM pk JOIN mm ON mm.video_id = pk.video_id AND mm.rank = pk.rank)"""


def relations(s, d, which):
    o = fixture.obs(s, d) if which == "p" else fixture.gold_obs(s, d)
    pairs = o.select("video_id", "frame", F.col("track_id").alias("a")).join(o.select("video_id", "frame", F.col("track_id").alias("b")), ["video_id", "frame"]).where("a < b")
    n = pairs.groupBy("video_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    n = n.where((F.col("n") >= 20) & (F.expr("(a + b) % 5 <> 0") if which == "p" else F.expr("(a * b) % 4 <> 1")))
    name = F.expr("CASE (a + b) % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'next_to' ELSE 'above' END")
    return n.select(F.concat(F.lit(which), F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string"))).alias("rel_id"), "video_id", F.col("a").alias("subject_id"), name.alias("predicate"), F.col("b").alias("object_id"),
                    (F.col("lo") + (2 if which == "p" else 0)).alias("start_frame"), F.col("hi").alias("end_frame"), (F.expr("(a * 7 + b * 3) % 20") / 20).alias("score"))


def frames(s, d, which):
    o = fixture.obs(s, d) if which == "p" else fixture.gold_obs(s, d)
    return E.tube_frames(relations(s, d, which), T.interpolate_gaps(o), T.main_class(o))


@query(with_gold(f"{TUBES} SELECT video_id, s_cat, p AS predicate, o_cat, rel_id, run AS run_id, start_frame, end_excl, round(score, 6)+0.0 AS score, round(sv, 3)+0.0 AS s_volume FROM ptt"))
def project_tubes(s, d):
    return E.tubes(frames(s, d, "p")).select(*E.TRIPLET, "rel_id", "run_id", "start_frame", "end_excl", r6(F.col("score")).alias("score"), (F.round("s_volume", 3) + F.lit(0.0)).alias("s_volume"))


@query(with_gold(f"""{TUBES}, prx AS (SELECT video_id, rel_id, s, CASE WHEN s % 7 = 3 THEN -1 ELSE o END AS o, st + CASE WHEN s % 11 = 5 THEN 500 ELSE 0 END AS st, en + CASE WHEN s % 11 = 5 THEN 500 ELSE 0 END AS en FROM pr),
rn AS (SELECT x.video_id, x.rel_id, x.o = -1 AS missing, (SELECT count(DISTINCT run) FROM pt WHERE pt.video_id = x.video_id AND pt.rel_id = x.rel_id AND x.o <> -1 AND x.st < 500) AS runs FROM prx x)
SELECT video_id, count(*) FILTER (missing) AS skipped_missing_tracks, count(*) FILTER (NOT missing AND runs = 0) AS skipped_empty_tubes, sum(greatest(runs - 1, 0))::BIGINT AS split_on_track_gaps, sum(runs)::BIGINT AS relation_count FROM rn GROUP BY video_id"""))
def projection_counts(s, d):
    o = fixture.obs(s, d)
    far = F.when(F.col("subject_id") % 11 == 5, 500).otherwise(0)
    r = relations(s, d, "p").withColumns({"object_id": F.when(F.col("subject_id") % 7 == 3, -1).otherwise(F.col("object_id")), "start_frame": F.col("start_frame") + far, "end_frame": F.col("end_frame") + far})
    return E.projection_counts(r, T.interpolate_gaps(o), T.main_class(o))


@query(with_gold(f"{TUBES}, {OVERLAP} SELECT video_id, pid AS pred, gid AS gold, round(viou, 6)+0.0 AS viou FROM ovl"))
def tube_viou(s, d):
    o = E.tube_overlaps(frames(s, d, "p"), frames(s, d, "g"))
    name = lambda r, n: F.concat_ws("-", F.col(r), F.col(n).cast("string"))
    return o.select("video_id", name("p_rel", "p_run").alias("pred"), name("g_rel", "g_run").alias("gold"), r6(F.col("viou")).alias("viou"))


@query(with_gold(f"{TUBES}, {OVERLAP}, {RANKED}, {MATCH} SELECT video_id, id AS pred, rank, gold FROM om"))
def official_match(s, d):
    return E.official_match(frames(s, d, "p"), frames(s, d, "g")).select("video_id", "pred", "rank", "gold")


AP = """gc AS (SELECT video_id, count(*) AS n FROM gtt GROUP BY ALL), ap0 AS (SELECT om.video_id, om.rank, (om.gold IS NOT NULL)::INT AS hit, gc.n, sum((om.gold IS NOT NULL)::INT) OVER (PARTITION BY om.video_id ORDER BY om.rank) / om.rank AS prec FROM om JOIN gc ON gc.video_id = om.video_id),
ap1 AS (SELECT *, max(prec) OVER (PARTITION BY video_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM ap0), ap AS (SELECT gc.video_id, coalesce(sum(hit * best / ap1.n), 0) AS ap FROM gc LEFT JOIN ap1 ON ap1.video_id = gc.video_id GROUP BY gc.video_id)"""
TAG = """tb AS (SELECT video_id, s_cat, p, o_cat, max(score) AS score FROM ptt GROUP BY ALL), tg AS (SELECT tb.*, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, s_cat, p, o_cat) AS n, EXISTS (SELECT 1 FROM gtt WHERE gtt.video_id = tb.video_id AND gtt.s_cat = tb.s_cat AND gtt.p = tb.p AND gtt.o_cat = tb.o_cat)::INT AS hit FROM tb),
tp AS (SELECT *, sum(hit) OVER (PARTITION BY video_id ORDER BY n) / n AS prec FROM tg)"""


@query(with_gold(f"{TUBES}, {OVERLAP}, {RANKED}, {MATCH}, {AP} SELECT video_id, round(ap, 6)+0.0 AS ap FROM ap"))
def voc_ap(s, d):
    gold = frames(s, d, "g")
    counts = E.tubes(gold).groupBy("video_id").agg(F.count(F.lit(1)).alias("gold_count"))
    return E.interpolated_ap(E.official_match(frames(s, d, "p"), gold), counts).withColumn("ap", r6(F.col("ap")))


@query(with_gold(f"{TUBES}, {TAG} SELECT video_id, s_cat, p AS predicate, o_cat, n, hit AS right, round(prec, 6)+0.0 AS precision FROM tp"))
def tagging_precision(s, d):
    return E.tagging(E.tubes(frames(s, d, "p")), E.tubes(frames(s, d, "g"))).select(*E.TRIPLET, "n", "right", r6(F.col("precision")).alias("precision"))


@query(with_gold(f"""{TUBES}, {OVERLAP}, {RANKED}, {MATCH}, {AP}, {TAG}
SELECT 'mAP' AS metric, round(avg(ap), 6)+0.0 AS value FROM ap UNION ALL SELECT 'R@' || k, round((SELECT count(*) FROM om JOIN gc ON gc.video_id = om.video_id WHERE rank <= k AND gold IS NOT NULL) / (SELECT sum(n) FROM gc), 6)+0.0 FROM (VALUES (50), (100)) v(k)
UNION ALL SELECT 'P@' || k, round((SELECT avg(coalesce((SELECT arg_max(prec, tp.n) FROM tp WHERE tp.video_id = gc.video_id AND tp.n <= k), 0)) FROM gc), 6)+0.0 FROM (VALUES (1), (5), (10)) v(k)"""))
def official_metrics(s, d):
    return E.official_metrics(frames(s, d, "p"), frames(s, d, "g")).withColumn("value", r6(F.col("value")))


@query(with_gold(f"{BASE} SELECT video_id, rel_id, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, rel_id) AS rank FROM pr QUALIFY rank <= 20"))
def topk_predictions(s, d):
    return E.top_k(relations(s, d, "p").withColumn("pred", F.col("rel_id")), 20).select("video_id", "rel_id", "rank")


_SUPPORT = """gi AS (SELECT g.video_id, x.class_name AS category, g.track_id AS gold_id, p.track_id AS pred_id, sum(greatest(0, least(g.x2, p.x2) - greatest(g.x1, p.x1)) * greatest(0, least(g.y2, p.y2) - greatest(g.y1, p.y1))) AS i, sum((p.x2 - p.x1) * (p.y2 - p.y1)) AS pa FROM gobs g JOIN gmc x USING (video_id, track_id) JOIN pit p ON p.video_id = g.video_id AND p.frame = g.frame JOIN pmc y ON y.video_id = p.video_id AND y.track_id = p.track_id AND y.class_name = x.class_name GROUP BY ALL),
su AS (SELECT gi.video_id, category, gold_id, pred_id, i / (a + pa - i) AS iou FROM gi JOIN (SELECT video_id, track_id, sum((x2 - x1) * (y2 - y1)) AS a FROM gobs GROUP BY ALL) t ON t.video_id = gi.video_id AND t.track_id = gi.gold_id)"""


def support(s, d):
    p, q = fixture.obs(s, d), fixture.gold_obs(s, d)
    return E.gold_supported_iou(T.interpolate_gaps(p), q, T.main_class(p), T.main_class(q))


@query(with_gold(f"{BASE}, {_SUPPORT} SELECT video_id, category, gold_id, pred_id, round(iou, 6)+0.0 AS iou FROM su"))
def gold_supported_iou(s, d):
    return support(s, d).withColumn("iou", r6(F.col("iou")))


@query()
def align_tracks(s, d):
    return E.align_tracks(support(s, d)).withColumn("iou", r6(F.col("iou")))


# Boxes of one track lie far from those of others here, so a track's best partner is itself; the alignment is unit-tested.
_DIAG = f"""{BASE}, {_SUPPORT}, al AS (SELECT video_id, gold_id, pred_id FROM su WHERE gold_id = pred_id AND iou >= 0.3),
dr0 AS (SELECT pr.*, a.gold_id AS ms, b.gold_id AS mo, row_number() OVER (PARTITION BY pr.video_id ORDER BY score DESC, rel_id) AS rank FROM pr LEFT JOIN al a ON a.video_id = pr.video_id AND a.pred_id = pr.s LEFT JOIN al b ON b.video_id = pr.video_id AND b.pred_id = pr.o),
dm AS (SELECT d.*, (SELECT g.rel_id FROM gr g WHERE g.video_id = d.video_id AND g.s = d.ms AND g.o = d.mo AND g.p = d.p AND greatest(0, least(d.en, g.en) + 1 - greatest(d.st, g.st)) / (greatest(d.en, g.en) + 1 - least(d.st, g.st)) >= 0.5) AS gold FROM dr0 d)"""
_SUM = lambda by: f"""SELECT {by}tp::BIGINT AS tp, (n - tp)::BIGINT AS fp, greatest(0, gold_count - tp)::BIGINT AS fn, round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6)+0.0 AS precision, round(CASE WHEN gold_count > 0 THEN tp / gold_count ELSE 0 END, 6)+0.0 AS recall, round(CASE WHEN gold_count > 0 THEN s / gold_count ELSE 0 END, 6)+0.0 AS ap,
  round(CASE WHEN tp > 0 THEN 2 * (tp / n) * (tp / gold_count) / (tp / n + tp / gold_count) ELSE 0 END, 6)+0.0 AS f1"""  # noqa: E731


def _diag_sql(by: str) -> str:
    part, join = (f"PARTITION BY {by} ", f"USING ({by})") if by else ("", "ON true")
    sel = f"{by} AS {by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return with_gold(f"""{_DIAG}, {O.predicates_sql()}, dmx AS (SELECT dm.*, CASE WHEN predicates.id % 4 = 0 THEN 'novel' ELSE 'base' END AS split FROM dm JOIN predicates ON name = p), grx AS (SELECT gr.*, CASE WHEN predicates.id % 4 = 0 THEN 'novel' ELSE 'base' END AS split FROM gr JOIN predicates ON name = p),
l AS (SELECT *, (gold IS NOT NULL)::INT AS hit, row_number() OVER w AS k, sum((gold IS NOT NULL)::INT) OVER w AS c FROM dmx WINDOW w AS ({part}ORDER BY score DESC, video_id, rel_id ROWS UNBOUNDED PRECEDING)),
a AS (SELECT {sel}sum(hit) AS tp0, count(*) AS n0, sum(hit * c / k) AS s0 FROM l {group}), b AS (SELECT {sel}count(*) AS g0 FROM grx {group}),
z AS (SELECT {by + ', ' if by else ''}coalesce(tp0, 0) AS tp, coalesce(n0, 0) AS n, coalesce(s0, 0) AS s, coalesce(g0, 0) AS gold_count FROM a FULL JOIN b {join}) {_SUM((by if by != 'p' else 'p AS predicate') + ', ' if by else '')} FROM z""")


_MACRO_SQL = f"SELECT round(coalesce(avg(ap), 0), 6)+0.0 AS macro_ap FROM ({_diag_sql('p')}) WHERE tp + fn > 0"


def gold_of(s, d):
    """Gold relations of the videos that have predicted tracks or relations."""
    return E.scoped(relations(s, d, "g"), fixture.obs(s, d), relations(s, d, "p"))


def diagnosed(s, d):
    return E.diagnostic_match(relations(s, d, "p"), gold_of(s, d), E.align_tracks(support(s, d)))


def _six(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "ap", "f1")})


@query(with_gold(f"{_DIAG} SELECT video_id, rel_id AS pred, rank, gold FROM dm"))
def diag_match(s, d):
    return diagnosed(s, d).select("video_id", "pred", "rank", "gold")


@query(_diag_sql(""))
def diag_summary(s, d):
    return _six(E.summary(diagnosed(s, d), gold_of(s, d)))


@query(_diag_sql("p"))
def diag_per_predicate(s, d):
    return _six(E.summary(diagnosed(s, d), gold_of(s, d), "predicate"))


def splits(s):
    """The published split of predicates is not known; here every fourth one is novel."""
    return O.predicates(s).select(F.col("name").alias("predicate"), F.when(F.col("id") % 4 == 0, "novel").otherwise("base").alias("split"))


@query(_diag_sql("split"))
def diag_splits(s, d):
    return _six(E.summary(E.with_split(diagnosed(s, d), splits(s)), E.with_split(gold_of(s, d), splits(s)), "split"))


@query(_MACRO_SQL)
def diag_macro_ap(s, d):
    return E.macro_ap(_six(E.summary(diagnosed(s, d), gold_of(s, d), "predicate"))).withColumn("macro_ap", r6(F.col("macro_ap")))


@query(with_gold(f"{_DIAG} SELECT (SELECT count(DISTINCT (video_id, track_id)) FROM gobs) AS gold, (SELECT count(DISTINCT (video_id, track_id)) FROM obs) AS predicted, count(*) AS matched, round(coalesce(avg(iou), 0), 6)+0.0 AS mean_iou, round(count(*) / (SELECT count(DISTINCT (video_id, track_id)) FROM gobs), 6)+0.0 AS recall FROM su WHERE gold_id = pred_id AND iou >= 0.3"))
def track_alignment(s, d):
    a = E.track_alignment(E.align_tracks(support(s, d)), fixture.gold_obs(s, d), fixture.obs(s, d))
    return a.withColumns({c: r6(F.col(c)) for c in ("mean_iou", "recall")})


@query(with_gold(f"{_DIAG} SELECT k, round((SELECT count(*) FROM dm WHERE rank <= k AND gold IS NOT NULL) / (SELECT count(*) FROM gr), 6)+0.0 AS recall FROM (VALUES (5), (20)) v(k)"))
def diag_recall_at_k(s, d):
    return E.recall_at_k(diagnosed(s, d), relations(s, d, "g"), (5, 20)).withColumn("recall", r6(F.col("recall")))


@query(with_gold(f"""{_DIAG}, t AS (SELECT video_id, ms, p, mo, row_number() OVER (PARTITION BY video_id ORDER BY min(rank)) AS n FROM dm WHERE ms IS NOT NULL AND mo IS NOT NULL GROUP BY video_id, ms, p, mo),
h AS (SELECT t.*, EXISTS (SELECT 1 FROM gr WHERE gr.video_id = t.video_id AND gr.s = t.ms AND gr.p = t.p AND gr.o = t.mo)::INT AS hit FROM t)
SELECT k, round((SELECT avg(a) FROM (SELECT avg(hit) AS a FROM h WHERE n <= k GROUP BY video_id)), 6)+0.0 AS precision FROM (VALUES (1), (5), (10)) v(k)"""))
def diag_tagging_at_k(s, d):
    return E.tagging_at_k(diagnosed(s, d), relations(s, d, "g")).withColumn("precision", r6(F.col("precision")))


@query(with_gold(f"""{_DIAG} SELECT error_type, rel_id FROM (SELECT 'false_positive' AS error_type, rel_id, score FROM dm WHERE gold IS NULL UNION ALL SELECT 'false_negative', rel_id, NULL FROM gr WHERE rel_id NOT IN (SELECT gold FROM dm WHERE gold IS NOT NULL)) ORDER BY error_type DESC, score DESC NULLS LAST, rel_id LIMIT 100"""))
def error_examples(s, d):
    return E.errors(diagnosed(s, d), relations(s, d, "g"))


@query(with_gold(f"{BASE} SELECT * FROM (SELECT rel_id, video_id, p AS predicate FROM gr WHERE video_id IN (SELECT video_id FROM pr WHERE video_id % 3 <> 1))"))
def scoped_gold(s, d):
    return E.scoped(relations(s, d, "g"), relations(s, d, "p").where("video_id % 3 <> 1")).select("rel_id", "video_id", "predicate")


@query(with_gold(f"""{BASE}, rq AS (SELECT DISTINCT video_id FROM obs WHERE video_id % 4 <> 2 UNION SELECT 9001), pv AS (SELECT video_id, rel_id FROM pr WHERE video_id % 5 <> 0 UNION ALL SELECT DISTINCT video_id, NULL FROM obs WHERE video_id % 5 = 0 AND video_id % 3 = 0)
SELECT video_id, 'missing' AS state FROM rq WHERE video_id NOT IN (SELECT video_id FROM pv) UNION ALL SELECT DISTINCT video_id, 'extra' FROM pv WHERE video_id NOT IN (SELECT video_id FROM rq) UNION ALL SELECT video_id, 'empty' FROM pv WHERE video_id IN (SELECT video_id FROM rq) GROUP BY video_id HAVING count(rel_id) = 0"""))
def coverage_report(s, d):
    v = fixture.obs(s, d).select("video_id").distinct()
    asked = v.where("video_id % 4 <> 2").unionByName(s.createDataFrame([(9001,)], "video_id long"))
    have = relations(s, d, "p").where("video_id % 5 <> 0").select("video_id", "rel_id").unionByName(v.where("video_id % 5 = 0 and video_id % 3 = 0").withColumn("rel_id", F.lit(None).cast("string")))
    return E.coverage(asked, have)


@query(with_gold(""", m AS (SELECT DISTINCT video_id, CASE WHEN video_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM obs) SELECT video_id FROM m WHERE split = 'test'"""))
def eval_scope(s, d):
    m = fixture.obs(s, d).select("video_id").distinct().withColumn("split", F.when(F.col("video_id") % 5 == 0, "test").otherwise("train"))
    return annotations.scope(m, split="test")


_ANN = f"{BASE}, {O.predicates_sql()}, an AS (SELECT video_id, s, CASE WHEN s % 6 = 0 THEN 'levitate' ELSE p END AS p, o, st, CASE WHEN o % 7 = 0 THEN st ELSE en + 1 END AS fin FROM gr), gold AS (SELECT video_id, s, p, o, st, fin - 1 AS en FROM an JOIN predicates ON name = p WHERE fin - 1 >= st)"


def _annotated(s, d):
    r = relations(s, d, "g")
    name = F.when(F.col("subject_id") % 6 == 0, "levitate").otherwise(F.col("predicate"))
    end = F.when(F.col("object_id") % 7 == 0, F.col("start_frame")).otherwise(F.col("end_frame") + 1)
    item = F.struct(F.col("subject_id").alias("subject_tid"), name.alias("predicate"), F.col("object_id").alias("object_tid"), F.col("start_frame").alias("begin_fid"), end.alias("end_fid"))
    return annotations.gold_relations(r.groupBy("video_id").agg(F.collect_list(item).alias("relation_instances")), O.predicates(s))


@query(with_gold(f"{_ANN} SELECT video_id, s AS subject_id, p AS predicate, o AS object_id, st AS start_frame, en AS end_frame FROM gold"))
def gold_relations(s, d):
    return _annotated(s, d)


@query(with_gold(f"{_ANN} SELECT p AS predicate, count(*) AS relations, count(DISTINCT video_id) AS videos FROM gold GROUP BY p UNION ALL SELECT NULL, count(*), count(DISTINCT video_id) FROM gold"))
def gold_manifest(s, d):
    return annotations.manifest(_annotated(s, d))


@query(with_gold(f"{BASE}, rq AS (SELECT DISTINCT video_id FROM obs UNION SELECT 9001) SELECT rq.video_id, count(pr.rel_id) AS relations, coalesce(string_agg(pr.rel_id, ',' ORDER BY pr.rel_id), '') AS ids FROM rq LEFT JOIN pr ON pr.video_id = rq.video_id GROUP BY rq.video_id"))
def merge_exports(s, d):
    asked = fixture.obs(s, d).select("video_id").distinct().unionByName(s.createDataFrame([(9001,)], "video_id long"))
    r = relations(s, d, "p")
    out = annotations.merge_exports([r.where("video_id % 2 = 0"), r.where("video_id % 2 = 1")], asked)
    return out.select("video_id", F.size("relations").cast("long").alias("relations"), F.concat_ws(",", F.transform("relations", lambda x: x["rel_id"])).alias("ids"))


@query(with_gold(" SELECT video_id, track_id, CASE WHEN track_id % 4 = 0 THEN 'unknown' ELSE 'dog' END AS category, frame, x1, y1, x2, y2 FROM gobs WHERE event_id % 9 <> 0"))
def gold_trajectories(s, d):
    side = lambda c, gone: F.when(F.col("event_id") % 9 == gone, None).otherwise(F.col(c))
    box = F.struct(side("x1", 0).alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    o = fixture.gold_obs(s, d)
    by_frame = o.groupBy("video_id", "frame").agg(F.collect_list(F.struct(F.col("track_id").alias("tid"), box.alias("bbox"))).alias("items"))
    spine = fixture.frames(s, d).join(by_frame, ["video_id", "frame"], "left").select("video_id", "frame", F.coalesce("items", F.array().cast(by_frame.schema["items"].dataType)).alias("items"))
    lists = spine.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "items"))), lambda x: x["items"]).alias("trajectories"))
    names = o.where("track_id % 4 <> 0").groupBy("video_id").agg(F.collect_set(F.struct(F.col("track_id").alias("tid"), F.lit("dog").alias("category"))).alias("objects"))
    return annotations.gold_trajectories(lists.join(names, "video_id", "left"))


@query(f"WITH {O.predicates_sql()} SELECT name, CASE WHEN concat_ws(', ', CASE WHEN action <> '' THEN 'action=' || action END, CASE WHEN spatial <> '' THEN 'spatial=' || spatial END, CASE WHEN comparative <> '' THEN 'comparative=' || comparative END) = '' THEN 'atomic' ELSE concat_ws(', ', CASE WHEN action <> '' THEN 'action=' || action END, CASE WHEN spatial <> '' THEN 'spatial=' || spatial END, CASE WHEN comparative <> '' THEN 'comparative=' || comparative END) END AS parts, name IN ('next_to', 'touch', 'fight', 'play', 'with') AS symmetric FROM predicates")
def predicate_summary(s, d):
    return O.summary(s)


@query(f"SELECT * FROM (VALUES {', '.join(repr((k, v)) if chr(39) not in v else '(' + repr(k) + ', ' + chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) + ')' for k, v in O.FAMILY_DESCRIPTIONS.items())}) t(family, description)")
def family_descriptions(s, d):
    return O.families(s)
