"""Other readers: the plot table, and the cache of pretreated sites."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.functions.scalars import flag, number_or_zero


def read_plot(spark: SparkSession, path: str) -> DataFrame:
    """Plot records (and ord) from a table with header. Position_Mb may be missing; numbers that can't be read are zero."""
    t = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    need = ["Method", "Chromosome", "Position", "Raw_Value", "Smooth_Value", "Threshold", "Above_Threshold"]
    if missing := [c for c in need if c not in t.columns]:
        raise ValueError(f"{path} lacks columns {missing}")
    position = number_or_zero(F.col("Position"))
    mb = number_or_zero(F.col("Position_Mb")) if "Position_Mb" in t.columns else position / 1e6
    return t.select(F.monotonically_increasing_id().alias("ord"), F.col("Method").alias("method"), F.col("Chromosome").alias("chromosome"), position.cast("bigint").alias("position"), mb.alias("position_mb"), *[number_or_zero(F.col(c)).alias(c.lower()) for c in need[3:6]], flag(F.trim("Above_Threshold")).alias("above"))


def cache_key(spark: SparkSession, path: str, **options) -> str:
    """A name for what is derived from a file: its path, size, time and the options all count."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").orderBy("path").collect()
    return hashlib.sha256(repr(([tuple(f) for f in files], sorted(options.items()))).encode()).hexdigest()[:24]


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table of that key in a folder, made and written if it isn't there."""
    path = f"{folder.rstrip('/')}/{key}.parquet"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
