"""Trackers and stitching.  Boxes of a video, scene and class group are tracked in frame order by a NumPy kernel;
costs between tracks and detections, or between tracklets, are plain joins."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistra.functions import geometry as g
from vistra.operators import tracks as T
from vistra.operators.assign import assign

GROUP = ("video_id", "scene_id", "class_group")


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return inter / np.maximum(1e-6, area(a)[:, None] + area(b)[None] - inter)


def _to_state(box: np.ndarray) -> np.ndarray:
    w, h = box[2] - box[0], box[3] - box[1]
    return np.array([box[0] + w / 2, box[1] + h / 2, w * h, w / max(h, 1e-6)])


def _to_box(z: np.ndarray) -> np.ndarray:
    w = np.sqrt(max(z[2] * z[3], 1e-6))
    h = max(z[2], 1e-6) / w
    return np.array([z[0] - w / 2, z[1] - h / 2, z[0] + w / 2, z[1] + h / 2])


class KalmanBox:
    """Constant velocity of centre and area, constant aspect; variances grow with the time since the last observation."""

    MOVE = np.eye(7) + np.eye(7, k=4)
    SEE = np.eye(4, 7)
    NOISE = np.diag([1.0, 1, 1, 0.01, 0.01, 0.01, 1e-4])
    SEEN = np.diag([1.0, 1, 10, 10])

    def __init__(self, box: np.ndarray):
        self.x = np.r_[_to_state(box), 0, 0, 0]
        self.p = np.diag([10.0, 10, 10, 10, 1e4, 1e4, 1e4])

    def predict(self) -> np.ndarray:
        if self.x[2] + self.x[6] <= 0:
            self.x[6] = 0.0
        self.x, self.p = self.MOVE @ self.x, self.MOVE @ self.p @ self.MOVE.T + self.NOISE
        return _to_box(self.x)

    def update(self, box: np.ndarray) -> None:
        gain = self.p @ self.SEE.T @ np.linalg.inv(self.SEE @ self.p @ self.SEE.T + self.SEEN)
        self.x = self.x + gain @ (_to_state(box) - self.SEE @ self.x)
        self.p = (np.eye(7) - gain @ self.SEE) @ self.p


class Tracker:
    """Observation-centric tracking of one class group.

    Association adds to IoU how well the direction from a track's earlier observation to the detection agrees with its
    motion; tracks left over are tried again at their last observation; a track found again after a gap is filtered
    anew along the straight line between both observations.
    """

    def __init__(self, *, least_iou=0.3, max_age=10, min_hits=2, delta=3, inertia=0.2):
        self.least_iou, self.max_age, self.min_hits, self.delta, self.inertia = least_iou, max_age, min_hits, delta, inertia
        self.live: list[dict] = []
        self.ids = 0

    def step(self, number: int, boxes: np.ndarray) -> list[tuple[int, int, int]]:
        """(id, step, detection) of what this step confirms; a track's first steps come with its confirmation."""
        guess = np.array([t["filter"].predict() for t in self.live]).reshape(-1, 4)
        for t in self.live:
            t["age"] += 1
        pairs = self._match(guess, boxes, self._direction(number, boxes)) if len(boxes) and len(self.live) else []
        lost = [i for i in range(len(self.live)) if i not in {a for a, _ in pairs}]
        free = [j for j in range(len(boxes)) if j not in {b for _, b in pairs}]
        if lost and free:
            last = np.array([self.live[i]["seen"][-1][1] for i in lost])
            pairs += [(lost[a], free[b]) for a, b in self._match(last, boxes[free], 0.0)]
        out = []
        for i, j in pairs:
            out += self._found(self.live[i], number, boxes[j], j)
        for j in sorted(set(range(len(boxes))) - {b for _, b in pairs}):
            t = {"id": None, "filter": KalmanBox(boxes[j]), "seen": [], "age": 0, "waiting": []}
            self.live.append(t)
            out += self._found(t, number, boxes[j], j)
        self.live = [t for t in self.live if t["age"] <= self.max_age]
        return out

    def _direction(self, number: int, boxes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.live), len(boxes)))
        mid = (boxes[:, :2] + boxes[:, 2:]) / 2
        for i, t in enumerate(self.live):
            if len(t["seen"]) < 2:
                continue
            early = next((b for n, b in t["seen"] if n >= t["seen"][-1][0] - self.delta), t["seen"][0][1])
            start = (early[:2] + early[2:]) / 2
            last = (t["seen"][-1][1][:2] + t["seen"][-1][1][2:]) / 2
            own, theirs = last - start, mid - start
            if np.hypot(*own) > 1e-6:
                cosine = theirs @ own / np.maximum(np.hypot(*theirs.T) * np.hypot(*own), 1e-6)
                out[i] = self.inertia * (np.pi / 2 - np.arccos(np.clip(cosine, -1, 1))) / np.pi
        return out

    def _match(self, a: np.ndarray, b: np.ndarray, bonus) -> list[tuple[int, int]]:
        overlap = ious(a, b)
        rows, cols = assign(-(overlap + bonus))
        return [(int(i), int(j)) for i, j in zip(rows, cols, strict=True) if overlap[i, j] >= self.least_iou]

    def _found(self, t: dict, number: int, box: np.ndarray, j: int) -> list[tuple[int, int, int]]:
        if t["seen"] and t["age"] > 1:
            first, then = t["seen"][-1]
            fresh = KalmanBox(then)
            for k in range(first + 1, number):
                fresh.predict()
                fresh.update(then + (box - then) * (k - first) / (number - first))
            fresh.predict()
            t["filter"] = fresh
        if t["seen"]:
            t["filter"].update(box)
        t["seen"] = [*t["seen"][-8:], (number, box)]
        t["age"] = 0
        t["waiting"].append((number, j))
        if t["id"] is None and len(t["waiting"]) < self.min_hits:
            return []
        if t["id"] is None:
            t["id"], self.ids = self.ids, self.ids + 1
        out, t["waiting"] = [(t["id"], n, k) for n, k in t["waiting"]], []
        return out


def track_objects(detections: DataFrame, **options) -> DataFrame:
    """Detections of confirmed tracks with ``track_id``, numbered in each video by first frame, scene, group and local number.

    ``detections``: video_id, scene_id, class_group, frame, det_id, box.  The frames of a group that have detections are its clock.
    Groups are tracked by themselves; a new scene begins with no tracks.
    """
    kinds = detections.select(*GROUP, "frame", "det_id", *g.SIDES).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(**options), []
        pdf = pdf.sort_values(["frame", "det_id"], kind="stable").reset_index(drop=True)
        frames, boxes = pdf["frame"].to_numpy(), pdf[list(g.SIDES)].to_numpy(float)
        starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]]).tolist()
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True)):
            out += [(local, starts[step] + j) for local, step, j in tracker.step(n, boxes[a:b])]
        found = pdf.iloc[[i for _, i in out]].copy()
        found["local_id"] = [i for i, _ in out]
        return found[[*kinds.names, "local_id"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", local_id int"
    rows = detections.select(*kinds.names).groupBy(*GROUP).applyInPandas(run, schema)
    return number_tracks(rows)


def number_tracks(rows: DataFrame) -> DataFrame:
    first = rows.groupBy(*GROUP, "local_id").agg(F.min("frame").alias("first"))
    order = Window.partitionBy("video_id").orderBy("first", "scene_id", "class_group", "local_id")
    return rows.join(first.withColumn("track_id", F.row_number().over(order)).drop("first"), [*GROUP, "local_id"]).drop("local_id")


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def association_cost(pairs: DataFrame, *, weights=(0.3, 0.2, 0.45, 0.05), max_center=4.0, min_iou=0.01, min_similarity=0.35) -> DataFrame:
    """``pairs`` (boxes t_ and d_, similarity, class_probability) with ``cost``, null where all of IoU, distance and appearance speak against it."""
    a, b = g.box("t_"), g.box("d_")
    out = pairs.withColumns({"iou": g.iou_eps(a, b), "center": g.center_distance_scaled(a, b)})
    parts = [1 - F.col("iou"), F.least(F.lit(1.0), F.col("center") / max_center), 1 - F.greatest(F.lit(0.0), F.col("similarity")), 1 - F.col("class_probability")]
    cost = sum((p * (w / sum(weights)) for w, p in zip(weights, parts, strict=True)), F.lit(0.0))
    far = (F.col("iou") < min_iou) & (F.col("center") > max_center) & (F.col("similarity") < min_similarity)
    return out.withColumn("cost", F.when(~far, cost))


def association_weight(rows: DataFrame) -> Column:
    """What a detection counts as evidence: its own finite ``association_weight``, else its finite score, else 1."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    return F.coalesce(*[finite(c) for c in ("association_weight", "score") if c in rows.columns], F.lit(1.0))


def class_groups(classes: DataFrame, compatible: DataFrame) -> DataFrame:
    """class_name, class_group: classes that ``compatible(canonical, other)`` names together are tracked together, others by themselves.

    Names are compared trimmed and in lower case.
    """
    name = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "unknown").otherwise(F.lower(F.trim(c)))
    own = compatible.select(name(F.col("canonical")).alias("_other"), name(F.col("canonical")).alias("_group"))
    known = own.unionByName(compatible.select(name(F.col("other")).alias("_other"), name(F.col("canonical")).alias("_group"))).groupBy("_other").agg(F.min("_group").alias("_group"))
    rows = classes.withColumn("_name", name(F.col("class_name")))
    return rows.join(F.broadcast(known), F.col("_name") == F.col("_other"), "left").withColumn("class_group", F.coalesce("_group", "_name")).drop("_name", "_other", "_group")


def clock(frames: DataFrame, dense: bool = False) -> DataFrame:
    """The frames at which a tracker steps: all of ``frames(status, objects)``, or those that were observed or have detections."""
    return frames if dense else frames.where((F.col("status") == "observed") | (F.col("objects") > 0))


def tracklets(rows: DataFrame, max_gap: int = 15) -> DataFrame:
    """Tracks cut where more than ``max_gap`` frames are missing or the scene changes.

    Each has its span, first and last box, last velocity, ``votes`` (class -> weight), ``shares`` (class -> part of the weights, all of them to "unknown"
    where they sum to nothing), class_name (the heaviest class, the first by name of equal ones) and mean_confidence (null without any score).
    """
    runs = T.frame_runs(rows, ("video_id", "scene_id", "track_id"), max_gap)
    key = ("video_id", "scene_id", "track_id", "run_id")
    order = Window.partitionBy(*key).orderBy("frame")
    dt = F.col("frame") - F.lag("frame").over(order)
    weighed = runs.groupBy(*key, "class_name").agg(F.sum(association_weight(runs)).alias("w"))
    weighed = weighed.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_name", "w")))).alias("votes"), F.sum("w").alias("total"))
    best = F.element_at(F.array_sort(F.transform(F.map_entries("votes"), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("name")))), 1)["name"]
    shares = F.when(F.col("total") > 0, F.transform_values("votes", lambda k, v: v / F.col("total"))).otherwise(F.create_map(F.lit("unknown"), F.lit(1.0)))
    weighed = weighed.select(*key, "votes", shares.alias("shares"), best.alias("class_name"))
    runs = runs.withColumns({f"v_{s}": F.coalesce((F.col(s) - F.lag(s).over(order)) / dt, F.lit(0.0)) for s in g.SIDES})
    ends = [F.min_by(s, "frame").alias(f"first_{s}") for s in g.SIDES] + [F.max_by(s, "frame").alias(f"last_{s}") for s in g.SIDES] + [F.max_by(f"v_{s}", "frame").alias(f"v_{s}") for s in g.SIDES]
    score = F.avg("score") if "score" in rows.columns else F.lit(None).cast("double")
    out = runs.groupBy(*key).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n"), *ends, score.alias("mean_confidence"))
    return out.join(weighed, list(key))


def share_overlap(a: str, b: str) -> Column:
    """The sum over classes of the lesser share of two maps."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + F.least(e["value"], F.coalesce(F.col(b)[e["key"]], F.lit(0.0))))


def stitch_edges(pieces: DataFrame, *, max_gap=90, min_similarity=0.6, max_center=4.0, weights=(0.55, 0.25, 0.15, 0.05), max_cost=0.58) -> DataFrame:
    """left_id, right_id, gap, cost: pairs of ``pieces`` (with piece_id and a unit ``embedding``) of a video and scene that one object may explain.

    A piece without an embedding is like no other (similarity 0); without ``shares`` all of a piece is of its class_name.  Pairs meet by blocks of ``max_gap`` frames: a piece can only follow one that
    ended in its own block or the one before, so long scenes are not squared.
    """
    if "shares" not in pieces.columns:
        pieces = pieces.withColumn("shares", F.create_map(F.coalesce("class_name", F.lit("unknown")), F.lit(1.0)))
    kept = ["piece_id", "start_frame", "end_frame", "shares", "embedding"]
    block = lambda c: F.floor(F.col(c) / max_gap)
    left = pieces.select("video_id", "scene_id", F.explode(F.array(block("end_frame"), block("end_frame") + 1)).alias("block"), *[F.col(c).alias(f"l_{c}") for c in kept], *[F.col(f"last_{s}").alias(f"b_{s}") for s in g.SIDES], *[F.col(f"v_{s}").alias(f"v_{s}") for s in g.SIDES])
    right = pieces.select("video_id", "scene_id", block("start_frame").alias("block"), *[F.col(c).alias(f"r_{c}") for c in kept], *[F.col(f"first_{s}").alias(f"d_{s}") for s in g.SIDES])
    gap = F.col("r_start_frame") - F.col("l_end_frame")
    rows = left.join(right, ["video_id", "scene_id", "block"]).where((gap > 0) & (gap <= max_gap)).withColumn("gap", gap)
    rows = rows.withColumns({f"t_{s}": F.col(f"b_{s}") + F.col(f"v_{s}") * F.col("gap") for s in g.SIDES})
    a, b = g.box("t_"), g.box("d_")
    rows = rows.withColumns({"similarity": F.coalesce(dot("l_embedding", "r_embedding"), F.lit(0.0)), "center": g.center_distance_scaled(a, b), "iou": g.iou_eps(a, b), "same": share_overlap("l_shares", "r_shares")})
    parts = [1 - F.greatest(F.lit(0.0), F.col("similarity")), F.least(F.lit(1.0), F.col("center") / max_center), 1 - F.col("iou"), 1 - F.col("same")]
    cost = sum((p * (w / sum(weights)) for w, p in zip(weights, parts, strict=True)), F.lit(0.0))
    rows = rows.where((F.col("similarity") >= min_similarity) | (F.col("center") <= max_center)).withColumn("cost", cost)
    return rows.where(F.col("cost") < max_cost).select("video_id", "scene_id", F.col("l_piece_id").alias("left_id"), F.col("r_piece_id").alias("right_id"), "gap", "cost")


def cheapest_links(edges: dict[tuple[int, int], float], max_cost: float) -> dict[int, int]:
    """left -> right: the one-to-one links with the least summed cost, where going without a link costs ``max_cost``.

    Links that share no piece cannot disturb each other, so each connected part is solved by itself.
    """
    parent: dict[tuple[str, int], tuple[str, int]] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for left, right in edges:
        parent[find(("l", left))] = find(("r", right))
    parts: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for e in edges:
        parts.setdefault(find(("l", e[0])), []).append(e)
    out = {}
    for part in parts.values():
        lefts, rights = sorted({e[0] for e in part}), sorted({e[1] for e in part})
        row, col = {v: i for i, v in enumerate(lefts)}, {v: i for i, v in enumerate(rights)}
        cost = np.full((len(lefts), len(rights) + len(lefts)), max_cost)
        for e in part:
            cost[row[e[0]], col[e[1]]] = edges[e]
        linked = ((lefts[i], j) for i, j in zip(*assign(cost), strict=True) if j < len(rights))
        out |= {left: rights[j] for left, j in linked if edges.get((left, rights[j]), max_cost) < max_cost}
    return out


def stitch(edges: DataFrame, pieces: DataFrame, max_cost: float = 0.58) -> DataFrame:
    """video_id, scene_id, piece_id, head_id: chains of pieces by the cheapest one-to-one links, where going without a link costs ``max_cost``."""
    rows = pieces.select("video_id", "scene_id", F.col("piece_id").alias("left_id"), F.lit(None).cast("long").alias("right_id"), F.lit(None).cast("double").alias("cost"))
    rows = rows.unionByName(edges.select("video_id", "scene_id", "left_id", "right_id", "cost"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["right_id"].isna(), "left_id"].unique())
        linked = pdf.dropna(subset=["right_id"])
        after = cheapest_links({(int(x), int(y)): c for x, y, c in zip(linked["left_id"], linked["right_id"], linked["cost"], strict=True)}, max_cost)
        head = {int(i): int(i) for i in ids}
        for start in set(head) - set(after.values()):
            at = start
            while at in after:
                at = after[at]
                head[at] = start
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "scene_id": pdf["scene_id"].iloc[0], "piece_id": ids, "head_id": [head[int(i)] for i in ids]})

    return rows.groupBy("video_id", "scene_id").applyInPandas(run, f"video_id {rows.schema['video_id'].dataType.simpleString()}, scene_id {rows.schema['scene_id'].dataType.simpleString()}, piece_id long, head_id long")


def apply_global_ids(rows: DataFrame, mapping: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` under their global ids; those of stitched pieces are marked and carry 1 - cost of their last link."""
    ends = links.select("video_id", "ord", F.explode(F.array("left_id", "right_id")).alias("piece_id"), F.greatest(F.lit(0.0), 1 - F.col("cost")).alias("support"))
    last = ends.groupBy("video_id", "piece_id").agg(F.max_by("support", "ord").alias("identity_support"))
    out = rows.join(mapping, ["video_id", "piece_id"]).join(last, ["video_id", "piece_id"], "left")
    return out.withColumn("identity_source", F.when(F.col("identity_support").isNotNull(), "offline_stitch").otherwise("local"))


class AppearanceTracker:
    """Live tracks of one scene in arrays: last two boxes, appearance sums, class votes; a step costs one matrix, not a call a pair."""

    MEMORY = 20

    def __init__(self, share, max_cost, min_hits, max_age, max_center, min_iou, min_similarity, min_new_score):
        self.share, self.max_cost, self.min_hits, self.max_age = share, max_cost, min_hits, max_age
        self.max_center, self.min_iou, self.min_similarity, self.min_new_score = max_center, min_iou, min_similarity, min_new_score
        self.live: list[dict] = []
        self.ids = 0

    def _costs(self, n: int, boxes: np.ndarray, classes: list[str], looks: list[np.ndarray | None]) -> np.ndarray:
        last, before = (np.array([t[k] for t in self.live]) for k in ("box", "old"))
        at, old_at = (np.array([t[k] for t in self.live], float) for k in ("at", "old_at"))
        guess = last + (last - before) / np.maximum(at - old_at, 1.0)[:, None] * (n - at)[:, None]
        overlap = ious(guess, boxes)
        mid = lambda b: (b[:, :2] + b[:, 2:]) / 2
        size = np.sqrt(np.maximum(1.0, (guess[:, 2] - guess[:, 0]) * (guess[:, 3] - guess[:, 1])))
        away = np.linalg.norm(mid(guess)[:, None] - mid(boxes)[None], axis=2) / size[:, None]
        similarity = np.array([[0.0 if m is None or e is None else float(m @ e) for e in looks] for m in (t["mean"] for t in self.live)]).reshape(overlap.shape)
        likely = np.array([[t["votes"].get(c, 0.0) / (sum(t["votes"].values()) or 1.0) for c in classes] for t in self.live]).reshape(overlap.shape)
        cost = np.tensordot(self.share, np.stack([1 - overlap, np.minimum(1.0, away / self.max_center), 1 - np.maximum(0.0, similarity), 1 - likely]), 1)
        return np.where((overlap < self.min_iou) & (away > self.max_center) & (similarity < self.min_similarity), 1e6, cost)

    def step(self, n: int, boxes: np.ndarray, classes: list[str], weights: list[float], scores: list[float | None], looks: list, det: list[int]) -> list[tuple[int, int, int, float]]:
        """(frame, det, track, identity support) of everything that this frame's detections confirm."""
        self.live = [t for t in self.live if n - t["at"] <= self.max_age]
        taken, cost = {}, None
        if self.live and len(det):
            cost = self._costs(n, boxes, classes, looks)
            taken = {int(j): int(i) for i, j in zip(*assign(cost), strict=True) if cost[i, j] <= self.max_cost}
        out, known = [], list(self.live)
        for j in range(len(det)):
            if j in taken:
                t, support = known[taken[j]], max(0.0, 1.0 - float(cost[taken[j], j]))
                t["old"], t["old_at"] = t["box"], t["at"]
            elif scores[j] is not None and scores[j] < self.min_new_score:
                continue
            else:
                t, support = {"id": None, "old": boxes[j], "old_at": n, "looks": deque(maxlen=self.MEMORY), "mean": None, "votes": {}, "waiting": [], "hits": 0}, 0.5
                self.live.append(t)
            t["box"], t["at"] = boxes[j], n
            t["hits"] += 1
            t["votes"][classes[j]] = t["votes"].get(classes[j], 0.0) + weights[j]
            if looks[j] is not None:
                t["looks"].append(looks[j])
                mean = np.mean(t["looks"], axis=0)
                t["mean"] = mean / norm if (norm := np.linalg.norm(mean)) > 0 else None
            t["waiting"].append((n, det[j], support))
            if t["hits"] >= self.min_hits:
                if t["id"] is None:
                    self.ids += 1
                    t["id"] = self.ids
                out += [(f, d, t["id"], s) for f, d, s in t["waiting"]]
                t["waiting"] = []
        return out


def hybrid_track(detections: DataFrame, *, weights=(0.3, 0.2, 0.45, 0.05), max_cost=0.72, min_hits=2, max_age=30, max_center=4.0, min_iou=0.01, min_similarity=0.35, min_new_score=0.0) -> DataFrame:
    """Tracks by the cheapest assignment over overlap, distance, appearance and class; rows: video_id, scene_id, frame, det_id, track_id, identity_support.

    ``detections`` also have class_name and a unit ``embedding``, and may have score and association_weight.  A track predicts its box from its last two; its
    appearance is the mean of its last 20 embeddings, and a missing one is like no other.  Detections scored under ``min_new_score`` open no
    track.  identity_support is 1 - cost, and a half for a track's first row.
    """
    share = np.array(weights) / sum(weights)
    rows = detections.withColumns({"weight": association_weight(detections), "score": F.col("score").cast("double") if "score" in detections.columns else F.lit(None).cast("double")})
    columns = ["video_id", "scene_id", "frame", "det_id", "class_name", *g.SIDES, "embedding", "weight", "score"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, out = AppearanceTracker(share, max_cost, min_hits, max_age, max_center, min_iou, min_similarity, min_new_score), []
        pdf = pdf.sort_values(["frame", "det_id"], kind="stable")
        frames, boxes = pdf["frame"].to_numpy(), pdf[list(g.SIDES)].to_numpy(float)
        name = [str(c or "unknown").strip().lower() or "unknown" for c in pdf["class_name"]]
        look = [None if e is None or not np.any(np.isfinite(e)) or not np.any(e) else np.asarray(e, float) for e in pdf["embedding"]]
        score = [None if s is None or not np.isfinite(s) else float(s) for s in pdf["score"].astype(object)]
        det, weight = pdf["det_id"].tolist(), pdf["weight"].tolist()
        starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frames)], strict=True):
            out += tracker.step(int(frames[a]), boxes[a:b], name[a:b], weight[a:b], score[a:b], look[a:b], det[a:b])
        found = pd.DataFrame(out, columns=["frame", "det_id", "track_id", "identity_support"])
        return found.assign(video_id=pdf["video_id"].iloc[0], scene_id=pdf["scene_id"].iloc[0])[["video_id", "scene_id", "frame", "det_id", "track_id", "identity_support"]]

    kind = detections.schema["video_id"].dataType.simpleString()
    return rows.select(*columns).groupBy("video_id", "scene_id").applyInPandas(run, f"video_id {kind}, scene_id int, frame int, det_id long, track_id int, identity_support double")
