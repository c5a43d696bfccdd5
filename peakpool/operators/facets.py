"""Tables behind the facet plot of methods by chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakpool.functions.scalars import natural_key, scientific


def facet_ranges(records: DataFrame) -> DataFrame:
    """(kind, name, low, high): each chromosome's range of positions (kind x) and each method's range of values, from zero or
    below (kind y; thresholds count)."""
    x = records.groupBy(F.col("chromosome").alias("name")).agg(F.min("position_mb").alias("low"), F.max("position_mb").alias("high")).withColumn("kind", F.lit("x"))
    low = F.least(F.lit(0.0), F.min(F.least("raw_value", "smooth_value")))
    y = records.groupBy(F.col("method").alias("name")).agg(low.alias("low"), F.max(F.greatest("raw_value", "smooth_value", "threshold")).alias("high")).withColumn("kind", F.lit("y"))
    return x.unionByName(y).select("kind", "name", "low", "high")


def panels(records: DataFrame, order: str = "ord") -> DataFrame:
    """(method, chromosome, row, column, n, threshold): one panel for each pair; rows by the methods' first appearance, columns
    by the chromosomes' natural order, the threshold of the pair's last row. Pairs without rows have no panel."""
    g = records.groupBy("method", "chromosome").agg(F.count("*").alias("n"), F.max_by("threshold", order).alias("threshold"), F.min(order).alias("first"))
    rows = g.groupBy("method").agg(F.min("first").alias("first")).withColumn("row", F.row_number().over(Window.orderBy("first"))).select("method", "row")
    cols = natural_order(g.select("chromosome").distinct()).withColumnRenamed("place", "column")
    return g.join(F.broadcast(rows), "method").join(cols, "chromosome").select("method", "chromosome", "row", "column", "n", "threshold")


def natural_order(names: DataFrame, name: str = "chromosome") -> DataFrame:
    """(name, place): distinct names in natural order; a handful, so one task numbers them."""
    return names.select(name).distinct().withColumn("place", F.row_number().over(Window.orderBy(natural_key(F.col(name)))))


def significant(records: DataFrame) -> DataFrame:
    """The rows flagged above threshold, formatted as the table of significant sites. The flag is taken as given."""
    return records.where("above").select("method", "chromosome", F.col("position").alias("position_bp"), F.format_string("%.6f", "position_mb").alias("position_mb"), scientific(F.col("raw_value")).alias("raw_value"), scientific(F.col("smooth_value")).alias("fitted_value"), F.format_string("%.4f", "threshold").alias("method_threshold"), F.lit("TRUE").alias("above_threshold"))
