"""Tables that are written once in the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: dict[str, str] = {}


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table below ``spark.checkpoint.dir``: planned once, whatever reads it, and safe from lost executors.

    Only a local session without that setting takes a temporary folder of this machine.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        app = spark.sparkContext.applicationId
        folder = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="shared-"))
    path = f"{folder.rstrip('/')}/kept-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
