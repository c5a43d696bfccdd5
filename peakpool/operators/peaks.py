"""Thresholds, peaks and the profiles around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakpool.functions.scalars import half_even, half_up, numeric_key

#: Fixed value: the width of a profile's bins, in base pairs.
BIN = 1e4


def auto_threshold(scored: DataFrame) -> DataFrame:
    """(method, threshold): median plus three population standard deviations of the smoothed values; their 90th percentile if
    all lie below that, rounded; four decimals."""
    s = scored.groupBy("method").agg(F.median("smooth").alias("med"), F.stddev_pop("smooth").alias("sd"), F.percentile("smooth", F.lit(0.9)).alias("p90"), F.max("smooth").alias("top"))
    high = F.col("med") + 3 * F.col("sd")
    return s.select("method", half_up(F.when(F.col("top") < half_even(high, 4), F.col("p90")).otherwise(high), 4).alias("threshold"))


def thresholds(scored: DataFrame, t: float = 0.0) -> DataFrame:
    """(method, threshold): automatic for t = 0, else t."""
    return auto_threshold(scored) if t == 0 else scored.select("method").distinct().withColumn("threshold", F.lit(float(t)))


def by_position(scored: DataFrame) -> DataFrame:
    """Each series' rows numbered by position, ties in input order; positions in Mb."""
    w = Window.partitionBy("method", "chrom_idx").orderBy("pos", "ord")
    return scored.withColumns({"rn": F.row_number().over(w), "pos_mb": F.col("pos") / 1e6})


def islands(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """(method, chrom, chrom_idx, left, peak, right, value) of each run of neighbours at or above the method's threshold."""
    rows = by_position(scored).join(F.broadcast(limits), "method")  # one row for each method
    above = rows.where(F.col("smooth") >= F.col("threshold"))
    run = Window.partitionBy("method", "chrom_idx").orderBy("rn")
    above = above.withColumn("island", F.col("rn") - F.row_number().over(run))
    best = F.min(F.struct((-F.col("smooth")).alias("low"), F.col("rn").alias("rn"), F.col("pos_mb").alias("at"), F.col("smooth").alias("smooth")))
    found = above.groupBy("method", "chrom", "chrom_idx", "island").agg(F.min_by("pos_mb", "rn").alias("left"), F.max_by("pos_mb", "rn").alias("right"), F.min("rn").alias("start"), best.alias("best"))
    return found.select("method", "chrom", "chrom_idx", "start", "left", F.col("best.at").alias("peak"), "right", half_even(F.col("best.smooth"), 5).alias("value"))


def peak_table(scored: DataFrame, limits: DataFrame, chroms: DataFrame, methods: list[str]) -> DataFrame:
    """Peaks of each of the methods (by name, so that the plan needs no job) with ids by rank: highest value first; ties, and chromosomes without a peak (nulls), from the last
    row of the table in chromosome order to the first."""
    rows = chroms.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).join(islands(scored, limits), ["method", "chrom", "chrom_idx"], "left")
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("method").orderBy("chrom_idx", "start")))
    rank = F.row_number().over(Window.partitionBy("method").orderBy(F.desc_nulls_last("value"), F.desc("row")))
    return rows.select("method", rank.alias("qtl"), "chrom", numeric_key(F.col("chrom")).alias("chr_display"), "left", "peak", "right", "value")


def interval_profile(scored: DataFrame, peaks: DataFrame) -> DataFrame:
    """(method, key, seq, pos, data, peak): mean position and smoothed value of the 10 kb bins on both sides of each peak.

    Bins are open intervals that step away from the peak as long as they end within the chromosome's sites; empty ones are left
    out; seq ascends with position. key is the chromosome's shown name, with an asterisk for each higher peak on it. Sites look
    up their bin's number on each side, so that the join is on the chromosome and costs a row for each site and peak.
    """
    rows = by_position(scored).withColumn("bp", F.col("pos_mb") * 1e6)
    ends = rows.groupBy("method", "chrom_idx").agg(F.min("bp").alias("first"), F.max("bp").alias("last"))
    nth = F.row_number().over(Window.partitionBy("method", "chr_display").orderBy("qtl"))
    own = peaks.where("peak is not null").withColumn("key", F.concat("chr_display", F.repeat(F.lit("*"), (nth - 1).cast("int"))))
    index = scored.groupBy("method", "chrom").agg(F.first("chrom_idx").alias("chrom_idx"))
    own = own.join(index, ["method", "chrom"]).join(ends, ["method", "chrom_idx"]).withColumn("at", F.col("peak") * 1e6)
    steps = F.greatest(F.lit(0), F.floor((F.col("last") - F.col("first")) / BIN) + 2).cast("int")
    # bounds are explicit: positions that went through Mb carry rounding, and a division would put some into the wrong bin
    bins = own.select("method", "chrom_idx", "key", "at", "first", "last", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), steps.alias("steps"))
    bins = bins.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("steps")))).withColumn("edge", F.col("at") + F.col("side") * F.col("k") * BIN)
    bins = bins.where((F.col("side") < 0) & (F.col("edge") >= F.col("first")) | (F.col("side") > 0) & (F.col("edge") <= F.col("last")))
    bins = bins.select("method", "chrom_idx", "key", "at", (F.col("side") * F.col("k")).alias("seq"), F.when(F.col("side") < 0, F.col("edge")).otherwise(F.col("edge") - BIN).alias("lo"), F.when(F.col("side") < 0, F.col("edge") + BIN).otherwise(F.col("edge")).alias("hi"))
    cell = F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor(F.col("hi") / BIN)))
    joined = rows.withColumn("cell", F.floor(F.col("bp") / BIN)).join(bins.withColumn("cell", cell), ["method", "chrom_idx", "cell"]).where((F.col("bp") > F.col("lo")) & (F.col("bp") < F.col("hi")))
    return joined.groupBy("method", "key", "seq", F.col("at").alias("peak")).agg(F.avg("bp").alias("pos"), F.avg("smooth").alias("data"))


def values_table(scored: DataFrame) -> DataFrame:
    """(method, chrom, chrom_idx, rn, position, value): raw values by position; the position comes back from Mb, cut off."""
    return by_position(scored).select("method", "chrom", "chrom_idx", "rn", (F.col("pos_mb") * 1e6).cast("bigint").alias("position"), F.col("raw").alias("value"))


def plot_records(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """The plot table of scored sites."""
    rows = by_position(scored).join(F.broadcast(limits), "method")
    return rows.select("method", F.col("chrom").alias("chromosome"), F.col("pos").cast("bigint").alias("position"), F.col("pos_mb").alias("position_mb"), F.col("raw").alias("raw_value"), F.col("smooth").alias("smooth_value"), "threshold", (F.col("smooth") >= F.col("threshold")).alias("above"))
