"""Seams for models: detectors and vision-language providers give tables.  Only offline stubs are here; no call leaves the machine."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def call(self, prompt: str, images: list[str]) -> str:
        """The reply's text."""


class StubProvider:
    """Answers every prompt with the same text."""

    def __init__(self, reply: str = '{"actions": []}'):
        self.reply = reply

    def call(self, prompt: str, images: list[str]) -> str:
        return self.reply


def dry_run(packets: DataFrame, reply: str = '{"actions": []}') -> DataFrame:
    """What ``ask`` gives without calling anyone: the same reply for every packet."""
    return packets.select("packet_id", F.lit(reply).alias("reply"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))


def without_key(packets: DataFrame, name: str) -> DataFrame:
    """What ``ask`` gives where the provider's key is missing: a row with its error for every packet, not an exception."""
    return packets.select("packet_id", F.lit(None).cast("string").alias("reply"), F.lit(f"missing key {name}").alias("error"), F.lit(0).alias("attempts"))


def embed(boxes: DataFrame, make: Callable[[], Callable[[pd.DataFrame], list]], key: str = "det_id") -> DataFrame:
    """key, embedding of ``boxes`` by an encoder that is made once in each task; brought to length 1, null where the encoder gives none or zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for pdf in batches:
            found = []
            for v in encoder(pdf):
                norm = 0.0 if v is None else float(sum(float(x) * float(x) for x in v)) ** 0.5
                found.append([float(x) / norm for x in v] if norm > 0 else None)
            yield pd.DataFrame({key: pdf[key], "embedding": found})

    return boxes.mapInPandas(run, f"{key} {boxes.schema[key].dataType.simpleString()}, embedding array<double>")


def ask(packets: DataFrame, make: Callable[[], Provider], *, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """packet_id, reply, error, attempts for ``packets(packet_id, prompt, images)``; one provider for each task.

    A failed call is tried again after a growing pause; what still fails is a row with its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            rows = []
            for packet, prompt, images in zip(pdf["packet_id"], pdf["prompt"], pdf["images"], strict=True):
                reply = error = None
                for attempt in range(1, retries + 2):
                    try:
                        reply, error = provider.call(prompt, list(images) if images is not None else []), None
                        break
                    except Exception as e:
                        error = str(e)[:500]
                        time.sleep(wait * attempt)
                rows.append((packet, reply, error, attempt))
            yield pd.DataFrame(rows, columns=["packet_id", "reply", "error", "attempts"])

    return packets.select("packet_id", "prompt", "images").mapInPandas(run, "packet_id string, reply string, error string, attempts int")


def detect(frames: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Detections of ``frames`` by a detector that is made once in each task and takes a batch of frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make()
        for pdf in batches:
            yield detector(pdf)

    return frames.mapInPandas(run, schema)


#: What each kind of call asks for.
_TASKS = {
    "proposal": "Name the relations that the frames show.",
    "supplemental": "More frames or candidates were granted. Name the relations that they show; ask for nothing more.",
    "review": "Review these relations against the frames: accept, reject, change the predicate, or narrow the interval.",
    "vocabulary": "Name the classes of the objects that the frames show.",
}


def prompt(packet: Column, families: str = "", task: str = "proposal") -> Column:
    """The text for a packet (or an array of packets): the task, the families' meanings, and the packet as JSON."""
    return F.concat(F.lit(f"{_TASKS[task]} Answer with JSON: {{\"actions\": [...]}}.\n{families}\n"), F.to_json(packet))


def call_stats(replies: DataFrame) -> DataFrame:
    """How many calls there were, how many failed, and how many attempts they took."""
    return replies.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("error").isNotNull().cast("int")).alias("failed"), F.sum("attempts").alias("attempts"))


def canned(replies: dict) -> str:
    return json.dumps(replies, sort_keys=True)
