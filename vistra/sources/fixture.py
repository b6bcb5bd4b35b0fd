"""Detections derived from the ``events`` table, and the tables that follow from them.

The driver's tables hold no video, so ``det`` is computed from ``events`` by fixed formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = 120

_COLUMNS = """video_id, track_id, frame, event_id,
  CASE WHEN event_id % 7 = 0 THEN 'dog'
       ELSE CASE track_id % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'dog' WHEN 2 THEN 'horse' WHEN 3 THEN 'car' ELSE 'bicycle' END END AS class_name,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE least(1.0, value / 500.0) END AS score,
  CAST(40 + 60 * (track_id % 10) + 2 * (frame % 30) * (CASE WHEN track_id % 2 = 0 THEN 1 ELSE -1 END) + event_id % 17 AS DOUBLE) AS x1,
  CAST(60 + 25 * (track_id % 4) + event_id % 11 AS DOUBLE) AS y1,
  CAST(40 + 60 * (track_id % 10) + 2 * (frame % 30) * (CASE WHEN track_id % 2 = 0 THEN 1 ELSE -1 END) + event_id % 17 + 60 + event_id % 13 AS DOUBLE) AS x2,
  CAST(60 + 25 * (track_id % 4) + event_id % 11 + 50 + event_id % 19 AS DOUBLE) AS y2"""
_FROM = """(SELECT *, CAST(floor(user_id / 10.0) AS BIGINT) AS video_id, user_id AS track_id,
  CAST(floor(({us} - 1704067200000000) / 21600000000.0) AS INT) AS frame FROM events) t"""

#: The same tables as DuckDB views, for oracles.
DET_SQL = f"det AS (SELECT {_COLUMNS} FROM {_FROM.format(us='epoch_us(ts)')})"
OBS_SQL = "obs AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY event_id DESC) = 1)"
GOLD_SQL = "gobs AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY video_id, track_id, frame ORDER BY event_id) = 1)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, track_id, frame, event_id, class_name, score, x1, y1, x2, y2."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events(spark, sf_dir).select(
        "event_id", "value", F.floor(F.col("user_id") / 10).alias("video_id"), F.col("user_id").alias("track_id"),
        F.floor((at - 1704067200000000) / F.lit(21600000000.0)).cast("int").alias("frame"),
    )
    return rows.selectExpr(*_split(_COLUMNS))


def _split(text: str) -> list[str]:
    """Top-level commas part a select list."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def _pick(rows: DataFrame, order) -> DataFrame:
    keys = ("video_id", "track_id", "frame")
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(order(F.struct(*others), "event_id").alias("r")).select(*keys, "r.*").select(*rows.columns)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest detection of each track and frame."""
    return _pick(det(spark, sf_dir), F.max_by)


def gold_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest detection of each track and frame."""
    return _pick(det(spark, sf_dir), F.min_by)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame: every frame of every video."""
    ids = det(spark, sf_dir).select("video_id").distinct()
    return ids.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))


def previous(column: str, keys: tuple[str, ...] = ("video_id", "track_id")):
    return F.lag(column).over(Window.partitionBy(*keys).orderBy("frame"))
