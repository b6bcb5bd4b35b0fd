"""Structured Streaming forms of the batch operators: windows, deduplication, and running track state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_tracks(detections: DataFrame, *, size: str = "30 seconds", slide: str = "15 seconds", late: str = "10 seconds") -> DataFrame:
    """Tracks and rows of each video in sliding event-time windows (``ts``); a window closes ``late`` after its end.

    Unlike the batch windows these have no shorter one at the end of a video.
    """
    rows = detections.withWatermark("ts", late).groupBy("video_id", F.window("ts", size, slide).alias("w"))
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("track_id")).alias("track_ids"))
    return counted.select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "track_ids")


def distinct_rows(rows: DataFrame, keys: list[str], late: str = "10 seconds") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_tracks(detections: DataFrame, idle: str = "30 seconds") -> DataFrame:
    """For every batch of a track: rows seen so far, path length so far, and last centre; a track's state goes when it is idle for long."""
    schema = "video_id long, track_id long, hits long, total_distance double, cx double, cy double"
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits, total, cx, cy = state.get if state.exists else (0, 0.0, None, None)
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples():
                x, y = (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2
                total += 0.0 if cx is None else ((x - cx) ** 2 + (y - cy) ** 2) ** 0.5
                hits, cx, cy = hits + 1, x, y
        state.update((hits, total, cx, cy))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame([(*key, hits, total, cx, cy)], columns=["video_id", "track_id", "hits", "total_distance", "cx", "cy"])

    return detections.groupBy("video_id", "track_id").applyInPandasWithState(step, schema, "hits long, total double, cx double, cy double", "update", GroupStateTimeout.ProcessingTimeTimeout)
