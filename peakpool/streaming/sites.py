"""Structured Streaming over folders of site tables.

Pretreatment but for the continuity filter, and the closed-form statistics, look at one site at a time; smoothing and thresholds
need whole series and stay with batch runs over what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.functions.statistics import statistic
from peakpool.operators import pretreat


def stream_sites(spark: SparkSession, folder: str, n_pools: int, sep: str = ",", per_trigger: int = 100) -> DataFrame:
    """Sites of delimited tables that appear in a folder. `ord` is null: a stream has no input order; chrom_idx is null too."""
    cells = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder).where(F.trim("value") != "").select(F.transform(F.split("value", "\t" if sep == "\t" else "\\" + sep, -1), lambda c: F.trim(c)).alias("c"))
    depth = lambda at: F.array(*[F.get("c", F.lit(at + 2 * i)).try_cast("double") for i in range(n_pools)])
    return cells.select(F.get("c", F.lit(0)).alias("chrom"), F.lit(None).cast("int").alias("chrom_idx"), F.lit(None).cast("bigint").alias("ord"), F.get("c", F.lit(1)).try_cast("double").alias("pos"), F.get("c", F.lit(2)).alias("ref"), F.get("c", F.lit(3)).alias("alt"), depth(4).alias("ref_a"), depth(5).alias("mut_a")).where("pos is not null and forall(ref_a, x -> x is not null) and forall(mut_a, x -> x is not null)")


def stream_statistics(sites: DataFrame, methods: list[str], n_pools: int, p: int = 1, p1: int = 0) -> DataFrame:
    """(method, chrom, pos, raw) of pretreated sites, stateless."""
    clean = pretreat.pretreat(sites, n_pools, p1) if p else pretreat.no_pretreat(sites)
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), statistic(m, n_pools).alias("raw")) for m in methods]))
    return clean.select("chrom", "pos", stacked.alias("s")).select("s.method", "chrom", "pos", "s.raw")
