"""SimHash near-duplicates, linked through Golay codewords.

A fingerprint has three segments of 22, 21 and 21 bits.  Two fingerprints with at most two differing bits agree
in at least one segment (pigeonhole), and differ in at most two bits of the next one.  The binary
Golay code (23, 12) corrects three errors, so every word decodes to one codeword; two words with at most two
differing bits have a word between them within one bit of both, whose codeword is then a key of both.  A fingerprint's keys
are therefore: an exact segment with each codeword index found within one bit of the next segment - one
or six of them.  Fingerprints that share a key are joined and verified.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import cut, map_batches, slices, text_bytes
from .components import components

#: Fixed value: the generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 3
SEED = 42
BITS_APART = 2
#: A key with more distinct fingerprints than this is not joined by pairs but through one-bit neighbours.
PAIR_GROUP = 64

_LANES = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64, n)
    lanes = _LANES[hashes.view(np.uint8).reshape(n, 8)]
    parts = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # eight counters of one byte each
    ones = parts.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """For each 23-bit word the index (12 bits) of the codeword within three bits of it."""
    one = 1 << np.arange(23, dtype=np.int32)
    flips = np.r_[0, one, (one[:, None] | one)[np.triu_indices(23, 1)], [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]]
    error = np.zeros(1 << 11, np.int32)
    error[_syndrome(flips)] = flips
    out = np.empty(1 << 23, np.int16)
    for at in range(0, 1 << 23, 1 << 17):
        words = np.arange(at, at + (1 << 17), dtype=np.int32)
        out[at : at + (1 << 17)] = (words ^ error[_syndrome(words)]) >> 11
    return out


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each word by the generator."""
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices: of each segment and of its neighbours at one bit, each once."""
    table = codewords()
    near = np.concatenate([segment[None], segment[None] ^ (1 << np.arange(23))[:, None]])
    found = np.sort(table[near], axis=0)
    fresh = np.concatenate([np.ones((1, len(segment)), bool), found[1:] != found[:-1]])
    which, row = np.nonzero(fresh)
    return row, found[which, row].astype(np.int64)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints (uint64); a key is 2 + 22 + 12 bits."""
    rows, keys = [], []
    cutouts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for i in range(3):
        row, index = golay_keys(cutouts[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 34) | (cutouts[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns ``keep`` for every row; a null text is empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.fromiter(map(fingerprint, text_bytes(part.column("text")).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(k) for k in keep), pa.array(fps.view(np.int64))], ["doc_id", *keep, "fp"])

    rows = docs.select("doc_id", "text", *keep)
    extra = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{extra}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints that make the same components as all pairs at most BITS_APART apart.

    Keys of up to PAIR_GROUP fingerprints are joined and every pair verified.  Fingerprints of fuller keys are each
    linked to their 64 neighbours at one bit; two of them share a neighbour exactly if they are at most
    two bits apart, so nothing is lost and the cost stays in proportion to the group.
    """

    def keyed(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            row, key = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    def starred(batches):
        masks = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for a in range(0, len(fp), 4096):
                part = fp[a : a + 4096]
                near = (part.view(np.uint64)[:, None] ^ masks).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), pa.array(np.repeat(part, 65))], ["near", "fp"])

    keys = cut(fps.select("fp").distinct().mapInArrow(keyed, "key long, fp long"), "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    few = keys.join(sizes.where((F.col("n") > 1) & (F.col("n") <= PAIR_GROUP)).select("key"), "key")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
    pairs = pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS_APART).select("a", "b")
    many = keys.join(sizes.where(F.col("n") > PAIR_GROUP).select("key"), "key", "left_semi").select("fp").distinct()
    stars = cut(many.mapInArrow(starred, "near long, fp long"), "simhash-stars")
    heads = stars.groupBy("near").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred_links = stars.join(heads, "near").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(starred_links).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints at most two bits apart, the row's own included;
    null ids do not count, and a component of null ids alone has a null one.  Null, empty and white texts
    have fingerprint zero and are linked like any other.
    """
    rows = cut(fingerprints(docs), "simhash")
    heads = rows.groupBy("fp").agg(F.min("doc_id").alias("head"))
    heads = cut(heads, "simhash-heads")
    member = cut(components(links(heads)), "simhash-members")
    whole = heads.join(member, heads["fp"] == member["node"], "left").select("fp", "head", F.coalesce("component", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("head").alias("component_id"))
    named = whole.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, near: float | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) less those of a component that has a smaller doc_id.

    With ``near``, texts whose sets of five-word shingles have at least that Jaccard similarity are linked too.
    Of equal ids in a component one row stays, the first by a hash of its text, any one of those that differ in other columns only; rows with a null id
    stay only where their component has no other.  An empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    rows = cut(fingerprints(rows, "tie"), "simhash")
    heads = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("head")), "simhash-heads")
    linked = links(heads)
    if near is not None:
        pairs = cut(near_copies.pairs(docs, least=near), "simhash-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("tie")).distinct()
        marked = cut(rows.join(ends, "tie", "left_semi").select("tie", "fp").distinct(), "simhash-copies")
        side = lambda x: marked.select(F.col("tie").alias(x), F.col("fp").alias(f"fp_{x}"))
        linked = linked.unionByName(pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
    member = cut(components(linked), "simhash-members")
    whole = heads.join(member, heads["fp"] == member["node"], "left").select("head", F.coalesce("component", "fp").alias("root"))
    kept = cut(whole.groupBy("root").agg(F.min("head").alias("head")).select("head.doc_id", "head.tie").distinct(), "simhash-kept")
    tie = F.xxhash64("text")
    twice = cut(rows.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(kept, (rows["doc_id"].eqNullSafe(kept["doc_id"])) & (rows["tie"] == kept["tie"]), "left_semi"), "simhash-repeats")
    mine = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]) & (tie == kept["tie"]), "left_semi")
    if twice.isEmpty():
        return mine
    again = docs["doc_id"].eqNullSafe(twice["doc_id"]) & (tie == twice["tie"])
    once = mine.join(twice, again, "left_semi")
    return mine.join(twice, again, "left_anti").unionByName(once.dropDuplicates(["doc_id", "text"]))
