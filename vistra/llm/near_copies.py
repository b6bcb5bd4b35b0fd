"""Near copies: pairs of texts whose sets of word shingles have a Jaccard similarity of at least a bound.

Candidates share a band of minima: the shingles are hashed anew for each of BANDS x BAND functions, and a band's key
is made of the least values under its functions.  Two texts at similarity s miss each other in every band
with probability (1 - s^BAND)^BANDS, which is 7e-5 at 0.8.  Every candidate pair is verified with its exact sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, cut, map_batches, slices, text_bytes
from .components import components

SHINGLE, LEAST = 5, 0.8
BANDS, BAND = 24, 5
SEED = 42
#: Longs of marks for each set: every shingle sets one of their bits, by its hash.
MARKS = 16
#: Turns end when so many pairs a row of the keys are left, or more than this part of those before the turn.
ENOUGH, STALLED = 2, 0.5


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """Hashed shingles of texts; words are hashed once while they are remembered."""

    def __init__(self, shingle: int):
        self.factors = _odd(shingle, SEED)
        self.table = WordTable(lambda t: t.lower().split(), self._new, self._reset, limit=300_000)
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)

    def _new(self, words: list[bytes]) -> None:
        self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))])

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles one after the other, and how many each text has; fewer words than a shingle are one of their own."""
        flat, lengths = self.table.batch(texts)
        k = len(self.factors)
        counts = np.where(lengths > 0, np.maximum(lengths - k + 1, 1), 0)
        words = np.r_[self.hashes[flat], np.zeros(k - 1, np.uint64)]
        place = np.arange(len(flat))
        left = np.repeat(np.cumsum(lengths), lengths) - place  # words from here to the end of the text
        out = np.zeros(len(flat), np.uint64)
        for i, factor in enumerate(self.factors):
            out += np.where(left > i, words[i : i + len(flat)] * factor, np.uint64(0))
        starts = np.cumsum(lengths) - lengths
        return out[place - np.repeat(starts, lengths) < np.repeat(counts, lengths)], counts


def band_keys(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text; every text has at least one shingle."""
    starts, factors, mixers = np.cumsum(counts) - counts, _odd(BANDS * BAND, SEED + 1), _odd(BAND, SEED + 2)
    keys = np.empty((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(counts), band, np.uint64)
        for i in range(BAND):
            key = key * mixers[i] + np.minimum.reduceat(shingles * factors[band * BAND + i], starts)
        keys[:, band] = key
    return keys


def _keyed(texts: DataFrame, shingle: int) -> DataFrame:
    """key, node for every text with a word."""

    def run(batches):
        reader = Shingles(shingle)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = reader.read(text_bytes(part.column("text")).to_pylist())
                some = np.flatnonzero(counts)
                if len(some):
                    node = part.column("node").to_numpy()[some]
                    yield pa.RecordBatch.from_arrays([pa.array(band_keys(hashes, counts[some]).view(np.int64).ravel()), pa.array(np.repeat(node, BANDS))], ["key", "node"])

    return map_batches(texts, run, "key long, node long")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, n, shingles, marks: the distinct shingles of every text, and the bits that they set."""

    def run(batches):
        reader = Shingles(shingle)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = reader.read(text_bytes(part.column("text")).to_pylist())
                sets = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(sets)))
                bits = pa.FixedSizeListArray.from_arrays(pa.array(marks(np.concatenate(sets).view(np.uint64), sizes).ravel()), MARKS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sizes), lists, bits], ["node", "n", "shingles", "marks"])

    return map_batches(texts, run, "node long, n long, shingles array<long>, marks array<long>")


def marks(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of MARKS longs for each set: the bits that its shingles set."""
    bits = np.zeros((len(counts), MARKS * 64), bool)
    bits[np.repeat(np.arange(len(counts)), counts), (shingles % np.uint64(MARKS * 64)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def most_common(a: str, na: str, b: str, nb: str) -> Column:
    """At least as many as the shingles that two sets share, from their marks ``a`` and ``b`` (columns a0, a1, ..) and sizes.

    A bit that only one set has stands for a shingle, at least one, that the other does not have.
    """
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in range(MARKS)), F.lit(0))
    return F.least(F.col(na) - only(a, b), F.col(nb) - only(b, a))


def pairs(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """a, b: links between distinct texts (xxhash64 of each) that make the same components as all verified candidate pairs.

    Each text is first verified against the smallest one that it shares any key with, so a group of copies costs one pair a text whatever its size; then, while many pairs of a key are in different components
    and links still join them, against one other text of the key at a time.  At the end the texts of
    keys that are still in different components are ordered by their rarest shingles first: two sets of similarity s share one among
    the first n - ceil(s n) + 1 of each, with enough left after it in both, and marks that leave room for as many common shingles as that
    similarity needs, so only pairs that do are verified, and nothing is lost.
    """
    texts = docs.select(F.xxhash64("text").alias("node"), "text").where("text is not null")
    keys = cut(_keyed(texts, shingle).distinct(), "copies-keys")
    sizes = keys.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = cut(keys.join(sizes, "key"), "copies-shared")
    wanted = shared.select("node").distinct()
    once = texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = cut(_sets(once, shingle), "copies-sets")

    shared = cut(shared.join(sets.select("node", "n"), "node").join(sets.select(F.col("node").alias("head"), F.col("n").alias("head_n")), "head"), "copies-sized")

    def verified(candidates: DataFrame) -> DataFrame:
        """Of ``candidates`` (a, na, b, nb: nodes and the sizes of their sets) those whose sets are similar enough; sizes rule out many before sets are fetched."""
        left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        few = candidates.where(F.least("na", "nb") >= least * F.greatest("na", "nb"))
        both = few.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")) >= least).select("a", "b")

    first = shared.where("node <> head").groupBy("node", "n").agg(F.min(F.struct("head", "head_n")).alias("h"))
    first = first.select(F.col("h.head").alias("a"), F.col("h.head_n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    linked = cut(verified(first), "copies-linked")
    before, turn = None, 0
    while True:
        member = cut(components(linked), "copies-members")
        placed = shared.join(member, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        mixed = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        mixed = cut(mixed, "copies-parts")
        open_pairs, rows = mixed.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).collect()[0]
        placed = cut(placed.join(mixed.select("key"), "key", "left_semi"), "copies-mixed")
        if open_pairs <= ENOUGH * rows or (before is not None and open_pairs > STALLED * before):
            break
        before, turn = open_pairs, turn + 1
        order = F.xxhash64("node", "key", F.lit(turn))
        leads = placed.groupBy("key").agg(F.min_by(F.struct("node", "component", "n"), order).alias("lead"))
        ends = F.array_sort(F.array(F.struct("node", "n"), F.struct("lead.node", "lead.n")))
        more = placed.join(leads, "key").where("component <> lead.component").select(ends.alias("e")).distinct()
        more = more.select(F.col("e")[0]["node"].alias("a"), F.col("e")[0]["n"].alias("na"), F.col("e")[1]["node"].alias("b"), F.col("e")[1]["n"].alias("nb"))
        linked = cut(linked.unionByName(verified(more)), "copies-linked")
    mine = placed.select("node", "component").distinct()
    words = sets.join(mine, "node").select("node", "component", "n", F.explode("shingles").alias("shingle"))
    ranked = words.join(words.groupBy("shingle").agg(F.count(F.lit(1)).alias("among")), "shingle")
    ranked = ranked.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("among", "shingle")))
    first = cut(ranked.where(F.col("among") > 1).where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).select("shingle", "node", "component", (F.col("n") - F.col("at") + 1).alias("left"), "n"), "copies-prefixes")
    meet = first.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    first = first.join(meet, "shingle", "left_semi").join(sets.select("node", "marks"), "node")
    rest = meetings(first, least).distinct()
    return linked.unionByName(verified(rest)).distinct()


def meetings(first: DataFrame, least: float) -> DataFrame:
    """a, na, b, nb for pairs of ``first`` (shingle, node, component, left, n, marks) in different components, once for each shingle at which they meet and may still be similar enough."""
    side = lambda x: first.select("shingle", F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("left").alias(f"l{x}"), F.col("n").alias(f"n{x}"), *(F.col("marks")[i].alias(f"m{x}{i}") for i in range(MARKS)))
    needed = least * (F.col("na") + F.col("nb")) - 1e-9  # of the shared shingles, times 1 + least
    enough = F.least("la", "lb") * (1 + least) >= needed  # holds at the first shingle that the two share
    like = most_common("ma", "na", "mb", "nb") * (1 + least) >= needed
    return side("a").join(side("b"), "shingle").where("a < b and ca <> cb").where(enough).where(like).select("a", "na", "b", "nb")
