"""A folder for tables that a run writes and reads again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share; a local one only on a local master
    without that setting, deleted at the end."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="peakpool-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
