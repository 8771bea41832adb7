"""A place for tables that a query makes for itself."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names, else (one machine, tests) in the local temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/moraine-{uuid4().hex}" if base else tempfile.mkdtemp(prefix="moraine-")
