"""Scoring without a global order, stitching, the appearance tracker, stages over videos, reports."""

import datetime
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistra.functions import ontology
from vistra.operators import actions, evaluation, tracking
from vistra.plans.stages import Stages, revision, source_fingerprint
from vistra.sources import annotations, providers


@pytest.mark.parametrize("by", [(), ("kind",)])
@pytest.mark.parametrize("size", [7, 1_000_000])
def test_running_hits_do_not_depend_on_the_slices(spark, monkeypatch, by, size):
    monkeypatch.setattr(evaluation, "SLICE_ROWS", size)
    rng = random.Random(3)
    rows = [(rng.choice([0.5, 0.5, 0.5, 1.0, None, rng.random()]), rng.randrange(6), f"p{i:03d}", rng.randrange(2), rng.choice("ab")) for i in range(120)]
    frame = spark.createDataFrame(rows, "score double, video_id long, pred string, hit int, kind string").repartition(5)
    got = {r.pred: (r.n, r.c) for r in evaluation.running_hits(frame, *by).collect()}
    want = {}
    for kind in "ab" if by else [None]:
        mine = sorted((r for r in rows if kind is None or r[4] == kind), key=lambda r: (-(r[0] if r[0] is not None else -9), r[1], r[2]))
        for n, r in enumerate(mine, 1):
            want[r[2]] = (n, sum(x[3] for x in mine[:n]))
    assert got == want


def test_links_are_the_cheapest_of_all():
    rng = random.Random(1)
    for _ in range(60):
        edges = {(i, j): rng.choice([0.1, 0.25, 0.3, 0.57, 0.5]) for i in range(4) for j in range(10, 14) if rng.random() < 0.4}
        got = tracking.cheapest_links(edges, 0.58)
        cost = lambda links: sum(edges[x] - 0.58 for x in links)
        ways = [w for k in range(5) for w in itertools.combinations(edges, k) if len({a for a, _ in w}) == k == len({b for _, b in w})]
        assert cost(got.items()) == pytest.approx(min(map(cost, ways)))


PIECE = "video_id long, scene_id int, piece_id long, start_frame int, end_frame int, shares map<string,double>, embedding array<double>, first_x1 double, first_y1 double, first_x2 double, first_y2 double, last_x1 double, last_y1 double, last_x2 double, last_y2 double, v_x1 double, v_y1 double, v_x2 double, v_y2 double"


def test_stitching_compares_class_shares(spark):
    box, still = [0.0, 0.0, 10.0, 10.0], [0.0] * 4
    piece = lambda n, a, b, shares, look: (0, 0, n, a, b, shares, look, *box, *box, *still)
    rows = [piece(1, 0, 10, {"dog": 0.75, "cat": 0.25}, [1.0, 0.0]), piece(2, 12, 20, {"dog": 0.5, "horse": 0.5}, [1.0, 0.0]), piece(3, 130, 140, {"cat": 1.0}, None)]
    frame = spark.createDataFrame(rows, PIECE)
    got = {(r.left_id, r.right_id): r.cost for r in tracking.stitch_edges(frame, max_cost=2.0).collect()}
    assert set(got) == {(1, 2)}  # the third starts more than 90 frames after both
    assert got[1, 2] == pytest.approx(0.05 * (1 - 0.5))
    far = {(r.left_id, r.right_id): r.cost for r in tracking.stitch_edges(frame, max_cost=2.0, max_gap=120).collect()}
    assert far[2, 3] == pytest.approx(0.55 + 0.05) and far[1, 3] == pytest.approx(0.55 + 0.05 * 0.75)


def test_tracklets_have_shares_and_the_heaviest_class(spark):
    rows = [(0, 0, 1, f, c, s, 0.0, 0.0, 9.0, 9.0) for f, c, s in [(0, "cat", 0.1), (1, "dog", 0.9), (2, "cat", None), (40, "cat", 0.5)]]
    out = sorted(tracking.tracklets(spark.createDataFrame(rows, "video_id long, scene_id int, track_id long, frame int, class_name string, score double, x1 double, y1 double, x2 double, y2 double")).collect(), key=lambda r: r.start_frame)
    assert [(r.start_frame, r.end_frame, r.class_name) for r in out] == [(0, 2, "cat"), (40, 40, "cat")]
    assert out[0].shares == pytest.approx({"cat": 1.1 / 2.0, "dog": 0.9 / 2.0}) and out[0].mean_confidence == pytest.approx(0.5)


DET = "video_id long, scene_id int, frame int, det_id long, class_name string, score double, x1 double, y1 double, x2 double, y2 double, embedding array<double>"


def test_appearance_tracker(spark):
    rows = []
    for f in range(6):
        rows.append((0, 0, f, 10 + f, "dog", 0.9, 2.0 * f, 0.0, 20.0 + 2 * f, 20.0, None if f == 3 else [1.0, 0.0]))
        rows.append((0, 0, f, 20 + f, " Cat", None, 200.0, 0.0, 220.0, 20.0, [0.0, 1.0]))
    rows.append((0, 0, 3, 99, "dog", 0.05, 400.0, 0.0, 420.0, 20.0, [1.0, 1.0]))
    frame = spark.createDataFrame(rows, DET)
    got = {r.det_id: (r.track_id, r.identity_support) for r in tracking.hybrid_track(frame, min_new_score=0.1).collect()}
    assert 99 not in got and len(got) == 12
    assert len({got[10 + f][0] for f in range(6)}) == 1 and len({got[20 + f][0] for f in range(6)}) == 1 and got[10][0] != got[20][0]
    assert got[10][1] == 0.5 and got[25][1] > 0.95
    assert tracking.hybrid_track(frame, min_hits=7).count() == 0


def test_class_groups_and_clock(spark):
    names = spark.createDataFrame([("Dog",), ("cat ",), (None,), ("car",)], "class_name string")
    same = spark.createDataFrame([("Pet", "dog"), ("Pet", "CAT")], "canonical string, other string")
    assert {r.class_name: r.class_group for r in tracking.class_groups(names, same).collect()} == {"Dog": "pet", "cat ": "pet", None: "unknown", "car": "car"}
    frames = spark.createDataFrame([(0, "observed", 0), (1, "skipped", 0), (2, "skipped", 2)], "frame int, status string, objects int")
    assert [r.frame for r in tracking.clock(frames).collect()] == [0, 2] and tracking.clock(frames, dense=True).count() == 3


def test_failing_videos_stop_no_others(spark, tmp_path):
    stages = Stages(spark, f"file://{tmp_path}/run")

    def build(videos):
        if {3, 6} & set(videos):
            raise ValueError(f"cannot read one of {videos}")
        return spark.createDataFrame([(v,) for v in videos], "video_id long")

    out = stages.run_videos("track", {"x": 1}, list(range(8)), build)
    assert sorted(r.video_id for r in out.collect()) == [0, 1, 2, 4, 5, 7] and stages.failed == [3, 6]
    states = [r.state for r in stages.table().collect()]
    assert states.count("failed") == 2 and "succeeded" in states
    assert stages.run_videos("track", {"x": 2}, [3], build) is None and stages.run_videos("track", {}, [], build) is None


def test_manifest_tells_where_the_code_came_from(spark, tmp_path):
    root = tmp_path / "src"
    (root / ".git" / "refs" / "heads").mkdir(parents=True)
    (root / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    assert revision(str(root)) == "unknown"
    (root / ".git" / "packed-refs").write_text("# pack-refs\nabc123 refs/heads/main\n")
    assert revision(str(root)) == "abc123"
    (root / ".git" / "refs" / "heads" / "main").write_text("def456\n")
    (root / "a.py").write_text("x = 1\n")
    first = source_fingerprint(str(root))
    record = json.loads(Stages(spark, f"file://{tmp_path}/run").manifest({"a": 1}, root=str(root), models={"detector": "stub"}))
    assert record["revision"] == "def456" and record["source_fingerprint"] == first and record["models"] == {"detector": "stub"}
    (root / "a.py").write_text("x = 2\n")
    assert source_fingerprint(str(root)) != first


def test_reports():
    text = annotations.official_report({"mAP": 0.5, "R@100": 0.25, "R@50": 0.125, "P@1": 1.0}, split="test", videos=3, complete=False, states={"missing": 1}, gold=9, predicted=12)
    assert "| mAP | 0.500000 |" in text and text.index("R@50") < text.index("R@100") and "| missing | 1 |" in text and "no benchmark" in text
    row = {"tp": 1, "fp": 2, "fn": 0, "precision": 1 / 3, "recall": 1.0, "f1": 0.5, "ap": 0.25}
    text = annotations.diagnostic_report(row, [row | {"predicate": "left"}], {"matched": 1, "gold": 2, "mean_iou": 0.75}, errors=[{"error_type": "false_positive", "rel_id": "p1"}])
    assert "| left | 1 | 2 | 0 | 0.3333 |" in text and "1 of 2 gold tracks" in text and "false_positive: p1" in text


def test_providers_without_calls(spark):
    packets = spark.createDataFrame([("a",), ("b",)], "packet_id string").withColumns({"prompt": F.lit("p"), "images": F.array().cast("array<string>")})
    columns = providers.ask(packets, providers.StubProvider).columns
    assert {(r.reply, r.error) for r in providers.dry_run(packets, "{}").collect()} == {("{}", None)}
    missing = providers.without_key(packets, "SOME_KEY")
    assert missing.columns == columns and {(r.reply, r.error) for r in missing.collect()} == {(None, "missing key SOME_KEY")}
    boxes = spark.createDataFrame([(1, 3.0, 4.0), (2, 0.0, 0.0)], "det_id long, x double, y double")
    found = {r.det_id: r.embedding for r in providers.embed(boxes, lambda: lambda pdf: [list(v) for v in pdf[["x", "y"]].to_numpy()]).collect()}
    assert found == {1: pytest.approx([0.6, 0.8]), 2: None}


def test_second_round_packets(spark):
    packets = spark.createDataFrame([("a", [0, 3]), ("b", [0])], "packet_id string, displayed array<int>")
    checked = spark.createDataFrame([("a", True, [5, 1], []), ("a", True, [], ["contact"]), ("b", False, [9], [])], "packet_id string, accepted boolean, granted_frames array<int>, granted_families array<string>")
    wider = spark.createDataFrame([("a", 1, 2, ["touch"])], "packet_id string, subject_id long, object_id long, candidates array<string>")
    out = actions.supplemental_packets(packets, checked, wider).collect()
    assert [(r.packet_id, r.parent_id, r.displayed, r.granted_families, r.max_additional) for r in out] == [("a:supplemental", "a", [0, 1, 3, 5], ["contact"], 0)]
    assert out[0].directions[0].candidates == ["touch"]
    everything = ontology.candidates_for(spark.range(1)).first().candidates
    assert len(everything) == 132 and np.unique(everything).size == 132


def test_stitch_edges_equal_their_sql_without_weight_and_at_ties(spark, tmp_path):
    """Pieces whose scores are all zero, alone and beside others of their class; costs that lie between two sixth places."""
    import duckdb

    from vistra.plans import catalog
    from vistra.plans.registry import r6

    rng = random.Random(4)
    rows, start = [], datetime.datetime(2024, 1, 1)
    for user in range(20):
        for frame in range(0, 60, 6):  # pieces of one detection, some of the two beside it
            for f in (frame, frame + 1) if rng.random() < 0.3 else (frame,):
                rows.append((len(rows), start + datetime.timedelta(hours=6 * f + 1), user, 0.0 if rng.random() < 0.4 else 50.0))
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, value double)")
    con.executemany("insert into events values (?, ?, ?, ?)", rows)
    con.execute("create table embeddings as select i as vec_id, [1.0::float, (i % 7)::float] as embedding from range(500) t(i)")
    for name in ("events", "embeddings"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    want = con.execute(catalog.ORACLES["stitch_edges"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["stitch_edges"](spark, str(tmp_path)).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)

    ties = [((rng.randrange(600_000) + 0.5) / 1e6,) for _ in range(500)] + [(0.5195015,), (-0.5195015,), (None,)]
    con.execute("create table ties (x double)")
    con.executemany("insert into ties values (?)", ties)
    want = dict(con.execute("select x, round(x, 6) + 0.0 from ties").fetchall())
    assert {r.x: r.y for r in spark.createDataFrame(ties, "x double").select("x", r6(F.col("x")).alias("y")).collect()} == want
