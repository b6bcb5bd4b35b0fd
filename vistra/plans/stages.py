"""Stages that are kept: a stage runs again only if its input has changed or its output is gone."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vistra.sources.files import config_hash


class Stages:
    """Tables under ``folder``, one per stage, with a status table beside them; paths are any that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.status: list[tuple] = []

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def run(self, name: str, inputs: dict, build: Callable[[], DataFrame], *, resume: bool = True, force: bool = False) -> DataFrame:
        """The stage's table; ``inputs`` is hashed, and an earlier table of the same hash is taken if it was finished."""
        key = config_hash(inputs)
        path, began = f"{self.folder}/{name}/{key[:16]}", time.strftime("%Y-%m-%d %H:%M:%S")
        if resume and not force and self._exists(f"{path}/_SUCCESS"):
            self.status.append((name, "skipped", key, began, began, path, None))
            return self.spark.read.parquet(path)
        try:
            build().write.mode("overwrite").parquet(path)
            if not self._exists(f"{path}/_SUCCESS"):
                raise RuntimeError(f"stage {name} left no output")
        except Exception as e:
            self.status.append((name, "failed", key, began, time.strftime("%Y-%m-%d %H:%M:%S"), None, str(e)[:500]))
            raise
        self.status.append((name, "succeeded", key, began, time.strftime("%Y-%m-%d %H:%M:%S"), path, None))
        return self.spark.read.parquet(path)

    def run_videos(self, name: str, inputs: dict, videos: list, build: Callable[[list], DataFrame], **options) -> DataFrame | None:
        """One stage over many videos of which none stops the others; the tables of those that succeeded, or None.

        ``build`` gets a list of videos.  A list that fails is halved until the videos that fail stand alone; each of them is
        a row of the status table, and the others are built without them in as few writes as that takes.
        """
        done, failed, todo = [], set(), [list(videos)] if videos else []
        while todo:
            part = todo.pop()
            try:
                done.append(self.run(name, {**inputs, "videos": part}, lambda p=part: build(p), **options))
            except Exception:
                if len(part) > 1:
                    self.status.pop()  # the halves tell which of them it was
                    todo += [part[len(part) // 2 :], part[: len(part) // 2]]
                else:
                    failed.add(part[0])
        self.failed = sorted(failed, key=str)
        out = None
        for df in done:
            out = df if out is None else out.unionByName(df)
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.status, "node string, state string, input_hash string, started_at string, finished_at string, output string, error string")

    def manifest(self, config: dict, *, root: str | None = None, models: dict | None = None) -> str:
        """The run's record: configuration, its hash, versions, models, the source's revision and fingerprint, and stages."""
        names = ("node", "state", "input_hash", "started_at", "finished_at", "output", "error")
        record = {"config": config, "config_hash": config_hash(config), "spark": self.spark.version, "models": models or {}, "stages": [dict(zip(names, s, strict=True)) for s in self.status]}
        if root:
            record |= {"revision": revision(root), "source_fingerprint": source_fingerprint(root)}
        return json.dumps(record, indent=2, sort_keys=True)


def revision(root: str) -> str:
    """The checked-out commit of a repository, read from its files; ``unknown`` where there is none."""
    git = Path(root) / ".git"
    try:
        if git.is_file():
            git = (Path(root) / git.read_text().split(":", 1)[1].strip()).resolve()
        head = (git / "HEAD").read_text().strip()
        name = head.removeprefix("ref:").strip()
        if name == head:
            return head or "unknown"
        if (git / name).exists():
            return (git / name).read_text().strip() or "unknown"
        packed = dict(reversed(x.split(" ", 1)) for x in (git / "packed-refs").read_text().splitlines() if " " in x and x[0] not in "#^")
        return packed.get(name, "unknown")
    except (OSError, IndexError):
        return "unknown"


def source_fingerprint(root: str) -> str:
    """A hash over the paths and contents of all Python files below ``root``."""
    files = sorted(p for p in Path(root).rglob("*.py") if ".git" not in p.parts)
    return config_hash({p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in files})
