"""A folder for files that live as long as the session's work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """The URI of a new folder that all executors see.

    It is below ``spark.checkpoint.dir``; only a local session may do without one.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{top.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
