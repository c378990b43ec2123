"""The folder that all nodes of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, a session in one process gets a local folder, and a
    cluster an error, as its nodes don't share one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = f"file://{tempfile.mkdtemp(prefix='strataframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
