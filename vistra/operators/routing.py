"""Which predicates a pair's evidence makes worth asking about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistra.operators.evidence import PACKET


# The floors, factors and weights of the scores below.


def _in01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def score_columns() -> dict[str, Column]:
    """Each family's score from the columns of a row of features."""
    f = F.col
    proximity = F.greatest(F.lit(0.0), 1 - f("edge_gap_min"))
    contact = F.greatest(f("iou_max"), proximity)
    motion = F.least(F.lit(1.0), F.abs("approach_rate") * 12 + f("relative_motion") * 4)
    align = F.greatest(F.lit(0.0), f("motion_alignment"))
    size = F.least(F.lit(1.0), F.abs(F.log(F.greatest(F.lit(1e-6), f("size_ratio"))) / F.log(F.lit(2.0))))
    return {
        "geometry": F.lit(0.55),
        "relative_motion": F.greatest(F.lit(0.15), motion, 0.8 * align),
        "locomotion_state": F.greatest(F.lit(0.2), F.least(F.lit(1.0), f("subject_speed") * 5)),
        "contact": F.greatest(F.lit(0.1), contact),
        "manipulation": F.greatest(F.lit(0.1), 0.65 * contact + 0.35 * align),
        "attention_social": F.greatest(F.lit(0.2), 0.4 * proximity + 0.35 * align),
        "comparative": F.greatest(F.lit(0.1), size),
    }


def family_scores(features: DataFrame) -> DataFrame:
    """One row per direction and family with its score."""
    rows = F.array(*[F.struct(F.lit(name).alias("family"), score.alias("score")) for name, score in score_columns().items()])
    return features.select(*PACKET, F.explode(rows).alias("x")).select(*PACKET, "x.family", "x.score")


def spatial_support(spatial: Column) -> Column:
    f = F.col
    return (
        F.when(spatial == "left", _in01(-f("median_dx"))).when(spatial == "right", _in01(f("median_dx"))).when(spatial == "above", _in01(-f("median_dy"))).when(spatial == "beneath", _in01(f("median_dy")))
        .when(spatial == "toward", _in01(f("approach_rate") * 12)).when(spatial == "away", _in01(f("approach_rate") * -12)).when(spatial == "past", f("crosses_horizontal_axis").cast("double"))
        .when(spatial == "next_to", F.greatest(F.lit(0.0), 1 - f("distance_min"))).when(spatial == "with", F.greatest(F.lit(0.0), f("motion_alignment"))).otherwise(F.lit(0.25))
    )


def action_support(action: Column) -> Column:
    f, zero, one = F.col, F.lit(0.0), F.lit(1.0)
    return (
        F.when(action.isin("lie", "sit", "stand", "stop"), F.greatest(zero, 1 - f("subject_speed") * 8)).when(action.isin("creep", "fly", "jump", "move", "run", "swim", "walk"), F.least(one, f("subject_speed") * 8))
        .when(action.isin("chase", "follow"), F.least(one, f("subject_speed") * 5 + F.greatest(zero, f("approach_rate")) * 8 + F.greatest(zero, f("motion_alignment")) * 0.3))
        .when(action != "", F.lit(0.5)).otherwise(F.lit(0.25))
    )


def _as_map(rows: DataFrame, key: str, values: Column, name: str) -> DataFrame:
    """A small dimension as one row with a map from ``key`` to a list."""
    lists = rows.groupBy(key).agg(values.alias("v"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct(key, "v"))).alias(name))


def _in_order(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def ranked_predicates(features: DataFrame, predicates: DataFrame, members: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row per direction: ``best``, its three best families, and ``ranked``, all predicates in order.

    A composite predicate counts the weakest of its families, so one cue alone does not carry it; it is eligible if all of
    them are among the best.  Each row of features meets the fixed list of predicates, and the
    products of a row are gathered again by its key, which the features are already dealt by.
    """
    names = list(score_columns())
    rows = features.withColumns({f"_s_{n}": c for n, c in score_columns().items()})
    ahead = lambda n, m: (F.col(f"_s_{m}") > F.col(f"_s_{n}")) | ((F.col(f"_s_{m}") == F.col(f"_s_{n}")) & F.lit(m < n))
    rank = {n: sum((ahead(n, m).cast("int") for m in names if m != n), F.lit(1)) for n in names}
    rows = rows.withColumn("_fam", F.create_map(*[x for n in names for x in (F.lit(n), F.struct(F.col(f"_s_{n}").alias("score"), rank[n].alias("rank")))]))
    place = F.array(*[F.struct(F.col("_fam")[n]["rank"].alias("rank"), F.lit(n).alias("family")) for n in names])
    rows = rows.withColumn("best", F.slice(F.transform(F.array_sort(place), lambda x: x["family"]), 1, 3))
    known = (predicates.where(~F.col("name").isin(*exclude)) if exclude else predicates).join(members.groupBy("name").agg(F.collect_list("family").alias("families")), "name").select("name", "action", "spatial", "families")
    rows = rows.crossJoin(F.broadcast(known))
    mine = F.transform("families", lambda f: F.col("_fam")[f])
    score = 0.6 * F.array_min(F.transform(mine, lambda x: x["score"])) + 0.25 * spatial_support(F.col("spatial")) + 0.15 * action_support(F.col("action"))
    # ties are ties of the real numbers, not of their last bits
    item = F.struct((-F.round(score, 9)).alias("k"), "name", (F.array_max(F.transform(mine, lambda x: x["rank"])) <= 3).alias("eligible"), "families")
    return rows.groupBy(*PACKET).agg(F.first("best").alias("best"), F.array_sort(F.collect_list(item)).alias("ranked"))


def route(ranked: DataFrame, siblings: DataFrame, most: int = 14) -> DataFrame:
    """``ranked`` with ``candidates``: two eligible predicates of each of the best families, the siblings of those, then the other eligible ones; each once."""
    names = lambda items: F.transform(items, lambda x: x["name"])
    eligible = F.filter("ranked", lambda x: x["eligible"])
    first = F.flatten(F.transform("best", lambda f: F.slice(names(F.filter("_ok", lambda x: F.array_contains(x["families"], f))), 1, 2)))
    rows = ranked.crossJoin(F.broadcast(_as_map(siblings, "name", _in_order("ord", "sibling"), "_sib"))).withColumn("_ok", eligible)
    rows = rows.withColumn("_first", F.array_distinct(first))
    theirs = F.array_intersect(F.array_distinct(F.flatten(F.transform("_first", lambda n: F.coalesce(F.col("_sib")[n], F.array().cast("array<string>"))))), names("ranked"))
    return rows.withColumn("candidates", F.slice(F.array_distinct(F.concat("_first", theirs, names("_ok"))), 1, most)).drop("_sib", "_ok", "_first")


def expand(routed: DataFrame, neighbors: DataFrame, most: int = 24) -> DataFrame:
    """Routed rows with ``requested`` families: candidates get all ranked predicates of those that neighbour the best ones; at most ``most``.

    ``families`` are the best ones and those granted, ``expandable`` what neighbours any of them and is none of them.
    """
    rows = routed.crossJoin(F.broadcast(_as_map(neighbors, "family", _in_order("ord", "neighbor"), "_near")))
    around = lambda c: F.array_except(F.array_distinct(F.flatten(F.transform(c, lambda f: F.col("_near")[f]))), F.col(c))
    rows = rows.withColumn("_granted", F.array_intersect(F.col("requested"), around("best")))
    rows = rows.withColumn("families", F.array_distinct(F.concat("best", "_granted")))
    rows = rows.withColumn("expandable", around("families"))
    more = F.transform(F.filter("ranked", lambda x: F.arrays_overlap(x["families"], F.col("_granted"))), lambda x: x["name"])
    return rows.withColumn("candidates", F.slice(F.array_distinct(F.concat("candidates", more)), 1, most)).drop("_near", "_granted")


def listed(routed: DataFrame) -> DataFrame:
    """name, ord: candidates as rows, from 1."""
    return routed.select(*PACKET, F.posexplode("candidates").alias("ord", "name")).select(*PACKET, "name", (F.col("ord") + 1).alias("ord"))


def neighbor_families(chosen: DataFrame, neighbors: DataFrame, *keys: str) -> DataFrame:
    """neighbor, ord: neighbours of the chosen families (family, k: its place) that are not chosen themselves, in order, each once."""
    found = chosen.join(F.broadcast(neighbors), "family").select(*keys, "neighbor", F.struct("k", "ord").alias("o"))
    found = found.join(chosen.select(*keys, F.col("family").alias("neighbor")), [*keys, "neighbor"], "left_anti")
    first = found.groupBy(*keys, "neighbor").agg(F.min("o").alias("o"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("o")) - 1).drop("o")
