"""Where intermediate tables and streaming checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; where that is unset, in a temporary folder in local mode alone, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-barlake-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
