"""Labels: normal forms, vocabularies and class numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spaced(label: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), "[-_]", " "), r"\s+", " "))


def normalize(rows: DataFrame, column: str, aliases: DataFrame, out: str = "label") -> DataFrame:
    """``rows`` with the canonical label: an alias's name, else the spaced form with underscores; empty ones are ``unknown``."""
    known = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
    joined = rows.withColumn("_spaced", spaced(F.coalesce(F.col(column), F.lit("")))).join(F.broadcast(known), F.col("_spaced") == F.col("_alias"), "left")
    plain = F.when(F.col("_spaced") == "", "unknown").otherwise(F.regexp_replace("_spaced", " ", "_"))
    return joined.withColumn(out, F.coalesce("_name", plain)).drop("_spaced", "_alias", "_name")


def vocabulary(rows: DataFrame, order: str) -> DataFrame:
    """The first raw label of each canonical ``label`` of a video."""
    first = F.row_number().over(Window.partitionBy("video_id", "label").orderBy(order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def class_ids(rows: DataFrame, order: str) -> DataFrame:
    """video_id, class_name, class_id: numbers from 0 in the order in which classes are first seen."""
    seen = rows.groupBy("video_id", "class_name").agg(F.min(order).alias("first"))
    rank = F.dense_rank().over(Window.partitionBy("video_id").orderBy("first")) - 1
    return seen.select("video_id", "class_name", rank.alias("class_id"))


def first_name(rows: DataFrame, aliases: DataFrame, columns: tuple[str, ...] = ("class_name", "category", "label", "class"), out: str = "label") -> DataFrame:
    """``rows`` with the canonical label of the first of ``columns`` that is there and not blank; ``unknown`` if none is."""
    found = F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in columns if c in rows.columns], F.lit(""))
    return normalize(rows.withColumn("_raw", found), "_raw", aliases, out).drop("_raw")
