"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Every vector is projected on many directions, and each direction's projections are sorted.  A vector asks with a window of WINDOW to
both sides around its own projection, and collides once with every vector in it, for each direction and asking side.
Pairs whose collisions reach a count are verified by their cosine.  The count is calibrated on the whole table: every distinct vector gets a partner
whose cosine is just the least one, and the count is the largest that the wanted part of these pairs reaches.

In the middle of a direction a window would hold a good part of all vectors, so that collisions grew with the square of the table.  A vector
asks only where its own projection is far out, beyond ``tau``; lists hold what such a window can reach, the projections beyond tau - WINDOW, and
``tau`` grows with the table so that their length stays the same.  Near vectors meet there far more often than others, and
the number of directions is set so that a pair at the least cosine has COLLISIONS of them.

Directions are sums of two from small sets, (u_i + v_j) / sqrt(2), so the lists of a vector are found from 2m
products instead of m * m.  There are SETS pairs of such sets, independent of each other, because one vector may lie
far out in few directions of one pair.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches
from .components import components

LEAST_COSINE = 0.9
#: Expected number of vectors of a list; sets how far out lists begin.
LIST_SIZE = 12
#: Expected collisions of a pair whose cosine is just LEAST_COSINE, before the calibration.
COLLISIONS = 24.0
#: Part of the pairs at LEAST_COSINE, one for each distinct vector, that must reach the count.
RECALL = 0.998
#: Half the width of a query's window, in standard deviations of a projection.
WINDOW = 0.45
SETS = 16
SEED = 20_260


def plan(n: int, collisions: float = COLLISIONS) -> tuple[float, int]:
    """How far out queries begin for ``n`` vectors (in standard deviations), and m, the size of both sets of directions.

    With Q the weight of one tail beyond tau - WINDOW, a list has n * Q vectors.  Of two vectors with the least cosine the first asks and the second
    is in its window with probability p; SETS * m * m directions with two tails and two asking sides give 4 * SETS * m * m * p collisions.
    """
    normal = NormalDist()
    tau = normal.inv_cdf(1 - min(0.05, LIST_SIZE / max(n, 1))) + WINDOW
    rho, spread = LEAST_COSINE, math.sqrt(1 - LEAST_COSINE**2)
    steps = [tau + (i + 0.5) * 0.01 for i in range(400)]
    inside = [normal.cdf((x + WINDOW - rho * x) / spread) - normal.cdf((x - WINDOW - rho * x) / spread) for x in steps]
    p = sum(0.01 * normal.pdf(x) * w for x, w in zip(steps, inside, strict=True))
    return tau, math.ceil(math.sqrt(collisions / (4 * SETS * p)))


def directions(dim: int, m: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, number])
    return rng.standard_normal((dim, m), np.float32), rng.standard_normal((dim, m), np.float32)


def far_out(unit: np.ndarray, least: float, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, projection) wherever a row of ``unit`` has a projection of ``least`` or more; odd lists are the lower tails, turned round."""
    out, least = [], least * math.sqrt(2)
    for number in range(SETS):
        u, v = directions(unit.shape[1], m, number)
        a, b = unit @ u, unit @ v
        for sign in (0, 1):
            top = b.max(1, keepdims=True)
            row, i = np.nonzero(a + top >= least)
            for at in range(0, len(row), 20_000):
                r, k = row[at : at + 20_000], i[at : at + 20_000]
                total = a[r, k][:, None] + b[r]
                p, j = np.nonzero(total >= least)
                out.append((r[p], ((number * m + k[p].astype(np.int64)) * m + j) * 2 + sign, total[p, j] / math.sqrt(2)))
            a, b = -a, -b
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, unit (a double array, null where the vector is null, empty, zero or has null or non-finite parts) and same.

    ``same`` is equal for equal vectors.
    """
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    values = F.transform(x, lambda v: v.cast("double"))
    top = F.array_max(F.transform(values, lambda v: F.abs(v)))
    scaled = F.transform(F.col("values"), lambda v: v / F.col("top"))
    norm = F.sqrt(F.aggregate(F.col("scaled"), F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.select("vec_id", F.when(good, values).alias("values"), F.when(good, top).alias("top"))
    rows = rows.withColumn("scaled", F.when(F.col("top") > 0, scaled)).withColumn("norm", norm)
    rows = rows.select("vec_id", F.when(F.col("norm") > 0, F.transform("scaled", lambda v: v / F.col("norm") + 0.0)).alias("unit"))
    return rows.withColumn("same", F.when(F.col("unit").isNotNull(), F.sha2(F.to_json(F.struct("unit")).cast("binary"), 256)))


def collide(key: np.ndarray, p: np.ndarray, ids: np.ndarray, tau: float):
    """(asking id, met id) for every vector in the window of one that asks; lists stand one after the other, each sorted by projection."""
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    place = group * 64.0 + p  # each list on a stretch of its own, so that one search serves all
    ask = np.flatnonzero(p >= tau)
    if not len(ask):
        return
    low, high = np.searchsorted(place, place[ask] - WINDOW, "left"), np.searchsorted(place, place[ask] + WINDOW, "right")
    many = high - low
    bounds = np.flatnonzero(np.diff(np.cumsum(many) // 2_000_000, prepend=-1))
    for a, b in zip(bounds, np.r_[bounds[1:], len(ask)], strict=True):
        left = np.repeat(ask[a:b], many[a:b])
        right = np.repeat(low[a:b] - (np.cumsum(many[a:b]) - many[a:b]), many[a:b]) + np.arange(len(left))
        other = left != right
        yield ids[left[other]], ids[right[other]]


def pair_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each unordered pair once, the smaller id first, and how often it stands in the columns."""
    lo, hi = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    first = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(lo) else np.zeros(0, np.int64)
    return lo[first], hi[first], np.diff(np.r_[first, len(lo)])


def partners(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """For each row a unit vector whose cosine with it is LEAST_COSINE, in a random direction."""
    return _partners(unit, np.random.default_rng(seed).standard_normal(unit.shape))


def own_partners(unit: np.ndarray) -> np.ndarray:
    """Like ``partners``, in a direction that depends on nothing but the row, so that no dealing of the rows changes it."""
    z = [np.random.default_rng([SEED, xxhash.xxh64_intdigest(v.tobytes())]).standard_normal(len(v)) for v in np.ascontiguousarray(unit)]
    return _partners(unit, np.array(z).reshape(unit.shape))


def _partners(unit: np.ndarray, z: np.ndarray) -> np.ndarray:
    z -= (z * unit).sum(1, keepdims=True) * unit
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-30)
    return LEAST_COSINE * unit + math.sqrt(1 - LEAST_COSINE**2) * z


def collisions_of(x: np.ndarray, y: np.ndarray, tau: float, m: int) -> np.ndarray:
    """Collisions of row i of ``x`` with row i of ``y``."""
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 512):
        ends = [far_out(v[a : a + 512].astype(np.float32), tau - WINDOW, m) for v in (x, y)]
        row, lists, p = (np.concatenate(c) for c in zip(*ends, strict=True))
        key = row * (2 * SETS * m * m) + lists
        order = np.lexsort((p, key))
        side = np.repeat([0, 1], [len(e[0]) for e in ends])
        for left, right in collide(key[order], p[order], (2 * row + side)[order], tau):
            np.add.at(out, a + left // 2, (left // 2 == right // 2).astype(np.int64))
    return out


def calibrate(vectors: list[np.ndarray], n: int) -> tuple[float, int, int]:
    """``calibrated`` on all of ``vectors`` (an array for each length of vectors), in memory."""
    return calibrated(n, lambda tau, m: Counter(c for x in vectors if x.shape[1] > 1 for c in collisions_of(x, partners(x), tau, m).tolist()))


def calibrated(n: int, measure: Callable[[float, int], dict[int, int]]) -> tuple[float, int, int]:
    """tau, m and the count that a pair needs among ``n`` vectors; ``measure(tau, m)`` tells how many vectors have how many collisions with their partners.

    The count is the largest that RECALL of these pairs reach; where not even one collision does, there are more directions.
    """
    collisions = COLLISIONS
    while True:
        tau, m = plan(n, collisions)
        found = sorted((measure(tau, m) or {2: 1}).items())
        fewer = np.cumsum([c for _, c in found])
        needed = found[int(np.searchsorted(fewer, int((1 - RECALL) * fewer[-1]), "right"))][0]
        if needed >= 1 or collisions > 8 * COLLISIONS:
            return tau, m, max(needed, 1)
        collisions *= 2


def blocks(units: pa.ListArray):
    """(rows, their vectors) of up to 512 rows whose vectors have the same length."""
    widths = np.diff(units.offsets.to_numpy())
    flat, ends = units.flatten().to_numpy(), np.cumsum(widths)
    for dim in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == dim)
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            yield part, flat[(ends[part] - dim)[:, None] + np.arange(dim)]


def near_pairs(heads: DataFrame, n: int) -> DataFrame:
    """a, b (a < b): pairs of the ``n`` rows of ``heads(head, unit)`` with cosine LEAST_COSINE or more that their collisions find."""

    def measure(tau, m):
        def run(batches):
            found: Counter = Counter()
            for batch in batches:
                for _, unit in blocks(batch.column("unit")):
                    if unit.shape[1] > 1:
                        found.update(collisions_of(unit, own_partners(unit), tau, m).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["collisions", "vectors"])

        rows = map_batches(heads.select("unit"), run, "collisions long, vectors long").groupBy("collisions").agg(F.sum("vectors").alias("vectors"))
        return {r["collisions"]: r["vectors"] for r in rows.collect()}

    tau, m, needed = calibrated(n, measure)

    def project(batches):
        for batch in batches:
            ids = batch.column("head").to_numpy()
            for part, unit in blocks(batch.column("unit")):
                row, lists, p = far_out(unit.astype(np.float32), tau - WINDOW, m)
                dims = np.full(len(row), unit.shape[1], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(lists), pa.array(p.astype(np.float32)), pa.array(ids[part][row])], ["dim", "list", "p", "id"])

    def count(batches):
        """Collisions in sorted lists; a list may go on in the next batch."""
        rest = None
        for batch in batches:
            table = [batch.column(c).to_numpy() for c in ("dim", "list", "p", "id")]
            if rest is not None:
                table = [np.concatenate(x) for x in zip(rest, table, strict=True)]
            key = table[1] * 65_536 + table[0]
            last = np.flatnonzero(key != key[-1])
            stop = last[-1] + 1 if len(last) else 0
            if stop:
                yield from found(key[:stop], table[2][:stop], table[3][:stop])
            rest = [t[stop:] for t in table]
        if rest is not None:
            yield from found(rest[1] * 65_536 + rest[0], rest[2], rest[3])

    def found(key, p, ids):
        for x, y in collide(key, p, ids, tau):
            a, b, c = pair_counts(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["a", "b", "n"])

    entries = map_batches(heads.select("head", "unit"), project, "dim int, list long, p float, id long")
    dealt = entries.repartition("dim", "list").sortWithinPartitions("list", "dim", "p")
    counted = dealt.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    enough = counted.where(F.col("n") >= needed).select("a", "b")
    left, right = heads.select(F.col("head").alias("a"), F.col("unit").alias("x")), heads.select(F.col("head").alias("b"), F.col("unit").alias("y"))
    cosine = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return enough.join(left, "a").join(right, "b").where(cosine >= LEAST_COSINE).select("a", "b")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors (up to a positive factor that leaves the unit vector the same) are one class and count as links of each
    other.  Classes are told apart by their vectors, so rows that repeat a vec_id each have the links of their own vector; component_id is the
    smallest vec_id of the component.  Vectors without a direction link with nothing: n_links 0, their own id, kept.  Vectors of different lengths
    are never linked.  Rows with a null vec_id are passed through with no links and a null component; an empty table gives an empty one.
    """
    rows = cut(prepare(vectors), "vectors")
    usable = rows.where("same is not null and vec_id is not null")
    heads = usable.groupBy("same").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    heads = cut(heads.withColumn("head", F.monotonically_increasing_id()), "vector-heads")
    pairs = cut(near_pairs(heads, heads.count()), "vector-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = heads.select(F.col("head").alias("b"), "copies")
    linked = both.join(copies, "b").groupBy(F.col("a").alias("head")).agg(F.sum("copies").alias("more"))
    member = components(pairs).withColumnRenamed("node", "head")
    named = heads.select("same", "head", "least", "copies").join(linked, "head", "left").join(member, "head", "left").withColumn("component", F.coalesce("component", "head"))
    roots = named.groupBy("component").agg(F.min("least").alias("root"))
    named = named.join(roots, "component").select("same", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "root")
    usable_row = F.when(F.col("vec_id").isNotNull(), F.col("same"))
    out = rows.select("vec_id", usable_row.alias("same")).join(named, "same", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"))
