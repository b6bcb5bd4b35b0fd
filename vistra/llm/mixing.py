"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket.  The bucket in which a source's budget runs out is
found from the running sums and split into finer buckets, and again; then rows are taken by comparing
their hash with the threshold found.  Rows are never sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, slices, text_bytes

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target stops at so many times its size, and so does what is taken of a document.
MOST = 3
#: Bits of the hash that each level of the histogram tells apart.
LEVEL_BITS = 12
LEVELS = 3
#: Up to so many sources go to every worker (some MB at most); more are joined by a shuffle, each in SALT parts.
BROADCAST_SOURCES, SALT = 20_000, 32
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text, 0 for null) and h, the first 36 bits of md5(doc_id), -1 for a null id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n = np.fromiter((len(t.split()) for t in text_bytes(part.column("text")).to_pylist()), np.int64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(n)], ["doc_id", "source", "size"])

    rows = docs.select("doc_id", "text", "source")
    out = map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source {rows.schema['source'].dataType.simpleString()}, size long")
    return out.withColumn("h", hash36(F.col("doc_id")))


def hash36(doc_id):
    digits = F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 9)
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of ``sources`` (source, n; one row each): shares by weight of 100% of all sizes, capped at MOST times the size.

    Sources stand by code point, null last, and weigh ``weights``, repeating.  The excess of capped sources is shared again by weight: each turn
    gives the open ones one share a weight, until none is above its cap.  The driver sees two sums a turn and one row a partition.
    """
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt, "mix-order")
    before, counts = 0, []
    for r in sorted(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        counts.append((r["part"], before))
        before += r["n"]
    if not counts:
        return spark.createDataFrame([], f"source {sources.schema['source'].dataType.simpleString()}, source_size long, target double")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = cut(dealt.join(F.broadcast(spark.createDataFrame(counts, "part int, before long")), "part").select("source", F.col("n").alias("source_size"), weight.alias("weight")), "mix-weights")
    cap, share, capped = MOST * F.col("source_size"), 0.0, -1
    while True:
        full = F.col("weight") * F.lit(share) > cap if capped >= 0 else F.lit(False)
        at = ranked.agg(F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).collect()[0]
        if at[3] == capped or not at[2]:
            break
        share, capped = float(at[0] - at[1]) / at[2], at[3]
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(share)).alias("target"))


def by_source(rows: DataFrame, small: DataFrame, many: bool) -> DataFrame:
    """``rows`` joined with the columns of ``small`` (source as ``mix_source``, one row each, whose names no column of ``rows`` has).

    Up to BROADCAST_SOURCES sources go to every worker.  ``many`` are joined by a shuffle, each in SALT parts, so that a hot source is split.
    """
    same = F.col("source").eqNullSafe(F.col("mix_source"))
    if not many:
        return rows.join(F.broadcast(small), same)
    salted = small.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    mine = rows.withColumn("mix_part", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    return mine.join(salted, same & (F.col("mix_part") == F.col("mix_salt"))).drop("mix_salt", "mix_part")


def thresholds(rows: DataFrame) -> tuple[DataFrame, bool]:
    """One row per source of ``rows`` (doc_id, source, size, h; a written table): source, source_size, target, whole, rest, edge, all_rest; and whether they are many.

    Each document of a source is taken floor(target / source size) times, and once more if its hash is under the
    source's threshold; the threshold is the bucket edge whose sum comes nearest to the rest of the budget
    (the lower of two equally near).  Rows of equal hash share one decision.  An empty source takes nothing.
    """
    plan = cut(targets(cut(rows.groupBy("source").agg(F.sum("size").alias("n")), "mix-sources")), "mix-targets")
    many = plan.count() > BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("int")
    rest = F.when((F.col("source_size") > 0) & (F.col("whole") < MOST), F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    # edge: all hashes under it are taken; open: the bucket that holds the threshold, as the hash's leading bits
    state = plan.withColumn("whole", whole).withColumn("rest", rest).withColumns({"below": F.lit(0).cast("long"), "open": F.lit(0).cast("long")})
    bits = LEVEL_BITS * LEVELS
    for level in range(1, LEVELS + 1):
        shift = bits - LEVEL_BITS * level
        here = by_source(rows, state.select(F.col("source").alias("mix_source"), F.col("open").alias("mix_open")), many)
        # a null id has hash -1 and lies in the first bucket at every level
        place = F.greatest("h", F.lit(0))
        inside = here.where(F.shiftright(place, shift + LEVEL_BITS) == F.col("mix_open"))
        sums = inside.groupBy("source", F.shiftright(place, shift).alias("bucket")).agg(F.sum("size").alias("n"))
        by = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(by)).withColumnRenamed("source", "s")
        sums = sums.join(state.select("source", "below", "rest"), F.col("s").eqNullSafe(F.col("source")))
        over = sums.where(F.col("below") + F.col("upto") > F.col("rest"))
        first = over.groupBy("s").agg(F.min(F.struct("bucket", "upto", "n")).alias("at"))
        first = first.select("s", F.col("at.bucket").alias("bucket"), (F.col("at.upto") - F.col("at.n")).alias("before"), F.col("at.n").alias("n"))
        state = state.join(first, state["source"].eqNullSafe(first["s"]), "left").select(
            "source", "source_size", "target", "whole", "rest", (F.col("below") + F.coalesce("before", F.lit(0))).alias("below"),
            F.coalesce("bucket", F.lit(-1).cast("long")).alias("open"), F.coalesce("n", F.lit(0)).alias("last"),
        )
        state = cut(state, "mix-level")
    # the last bucket holds rows of one hash: take it if that comes nearer
    nearer = F.col("below") + F.col("last") - F.col("rest") < F.col("rest") - F.col("below")
    edge = F.when(F.col("open") < 0, F.lit(0)).otherwise(F.col("open") + nearer.cast("int"))
    return state.select("source", "source_size", "target", "whole", "rest", edge.alias("edge"), (F.col("open") < 0).alias("all_rest")), many


def with_times(rows: DataFrame, limits: DataFrame, many: bool) -> DataFrame:
    """``rows`` with one more column, ``mix`` (a struct: source_size, target, times); a column of that name must not be there."""
    out = by_source(rows, limits.select(F.col("source").alias("mix_source"), F.struct("source_size", "target", "whole", "rest", "edge", "all_rest").alias("mix")), many)
    place = F.greatest(hash36(F.col("doc_id")), F.lit(0))
    once_more = F.when(F.col("mix.all_rest"), F.col("mix.rest") > 0).otherwise(place < F.col("mix.edge"))
    times = F.least(F.col("mix.whole") + once_more.cast("int"), F.lit(MOST))
    return out.withColumn("mix", F.struct("mix.source_size", "mix.target", times.alias("times"))).drop("mix_source")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; taken is the words that the mix takes, repeats counted.

    Null texts have size 0, a null source is one of its own, rows of equal doc_id share a decision; an empty table gives an empty one.
    """
    rows = cut(sizes(docs), "mix-sizes")
    out = with_times(rows, *thresholds(rows))
    return out.select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.times")).alias("taken"))


def apply_mixture(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names), each as often as the mix takes it; texts are filtered where they lie."""
    inner = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = with_times(inner, *thresholds(cut(sizes(docs), "mix-sizes")))
    return out.where("mix.times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mix.times"))).alias("copy")).select("row.*")


#: The same mix in SQL: the running sums are taken over single hashes.
ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 9))::BIGINT, 0) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM docs GROUP BY source),
w AS (SELECT source, n, (k % 3 + 1)::DOUBLE AS weight FROM src),
-- water filling: the sources are capped in the order of 3 n / weight
r AS (SELECT *, {MOST} * n / weight AS ratio FROM w),
o AS (SELECT *, coalesce(sum({MOST} * n) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
  sum(weight) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS open_weight, sum(n) OVER () AS total FROM r),
lam AS (SELECT arg_min((total - capped) / open_weight, ratio) AS l FROM o WHERE (total - capped) / open_weight <= ratio),
t AS (SELECT source, n AS source_size, least({MOST} * n, l * weight)::DOUBLE AS target FROM r, lam),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {MOST})::BIGINT ELSE 0 END AS whole FROM t),
v AS (SELECT *, CASE WHEN source_size > 0 AND whole < {MOST} THEN target - whole * source_size ELSE 0 END AS rest FROM u),
g AS (SELECT source, h, sum(size) AS n FROM docs GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
z AS (SELECT c.source, c.h, CASE WHEN c.upto <= v.rest THEN true WHEN c.upto - c.n > v.rest THEN false ELSE c.upto - v.rest < v.rest - (c.upto - c.n) END AS more
  FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source)
SELECT docs.doc_id, docs.size, v.source_size, round(v.target, 3) AS target,
  (docs.size * least(v.whole + CASE WHEN z.more AND v.rest > 0 THEN 1 ELSE 0 END, {MOST}))::BIGINT AS taken
FROM docs JOIN v ON docs.source IS NOT DISTINCT FROM v.source JOIN z ON docs.source IS NOT DISTINCT FROM z.source AND docs.h = z.h
"""
