"""Pretreatment of sites: zero depths, depth, chi-square and continuity filters."""

from __future__ import annotations

from functools import reduce
from math import erfc
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakpool.functions.statistics import ZERO_DEPTH, pools

#: The chi-square statistic (one degree of freedom) at p = 0.05, and the step allowed between neighbours.
CHI2_CRITICAL, MAX_STEP = 3.841458820694126, 0.1


def n_pools(sites: DataFrame) -> int:
    """The largest number of pools of any site."""
    return sites.agg(F.max(F.size("ref_a")).alias("n")).first()["n"] or 0


def both(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def zero_adjust(sites: DataFrame) -> DataFrame:
    """Zero depths of either allele become 1e-4."""
    fix = lambda c: F.transform(c, lambda x: F.when(x == 0, F.lit(ZERO_DEPTH)).otherwise(x))
    return sites.withColumns({"ref_a": fix("ref_a"), "mut_a": fix("mut_a")})


def depth_filter(sites: DataFrame, n: int, least: int) -> DataFrame:
    """Drops a site if any pool has fewer than `least` reads; 0 keeps all."""
    if least <= 0:
        return sites
    return sites.where(both([r + a >= least for r, a in zip(pools("ref_a", n), pools("mut_a", n), strict=True)]))


def chi_square(ref: Column, alt: Column) -> Column:
    """Goodness of fit to equal alleles; 0 for a pool without reads."""
    return F.when(ref + alt > 0, (ref - alt) * (ref - alt) / (ref + alt)).otherwise(F.lit(0.0))


def chi_square_p(ref: Column, alt: Column) -> Column:
    """The p value of chi_square. For output only: the filter compares statistics and so needs no Python."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(erfc, na_action="ignore")

    return tail(F.sqrt(chi_square(ref, alt) / 2))


def chi_square_keep(n: int) -> Column:
    """All pools fit equal alleles, or the first and last both deviate, to opposite sides."""
    ref, alt = pools("ref_a", n), pools("mut_a", n)
    stats = [chi_square(r, a) for r, a in zip(ref, alt, strict=True)]
    fits = both([s <= CHI2_CRITICAL for s in stats])
    if n < 2:
        return fits
    share = [ref[i] / (ref[i] + alt[i]) for i in (0, -1)]
    apart = ((share[0] > 0.5) & (share[1] < 0.5)) | ((share[0] < 0.5) & (share[1] > 0.5))
    return reduce(or_, [fits, (stats[0] > CHI2_CRITICAL) & (stats[-1] > CHI2_CRITICAL) & apart])


def with_freq(sites: DataFrame) -> DataFrame:
    return sites.withColumn("freq", F.zip_with("ref_a", "mut_a", lambda r, a: r / (r + a)))


def continuity_filter(clean: DataFrame, n: int) -> DataFrame:
    """Keeps a site if each neighbour in input order (before this filter) is within 0.1 in every pool. A chromosome's ends need
    one neighbour only; a site without neighbours is dropped."""
    w = Window.partitionBy("chrom_idx").orderBy("ord")
    near = lambda other: both([F.abs(F.col("freq")[i] - F.col(other)[i]) < MAX_STEP for i in range(n)])
    beside = clean.withColumns({"before": F.lag("freq").over(w), "after": F.lead("freq").over(w)})
    keep = (F.col("before").isNotNull() | F.col("after").isNotNull()) & (F.col("before").isNull() | near("before")) & (F.col("after").isNull() | near("after"))
    return beside.where(keep).drop("before", "after")


def pretreat(sites: DataFrame, n: int, least: int = 0, p3: int = 1) -> DataFrame:
    """Adjusted, filtered sites with frequencies. p3=1 leaves the continuity filter off, p3=0 turns it on."""
    kept = with_freq(depth_filter(zero_adjust(sites), n, least).where(chi_square_keep(n)))
    return continuity_filter(kept, n) if p3 == 0 else kept


def no_pretreat(sites: DataFrame) -> DataFrame:
    """Frequencies without filters. Where a reference depth is zero both alleles become 1e-4; an alternative depth of zero
    stays."""
    fix = lambda other: F.zip_with("ref_a", other, lambda r, x: F.when(r == 0, F.lit(ZERO_DEPTH)).otherwise(x))
    return with_freq(sites.withColumns({"mut_a": fix("mut_a"), "ref_a": fix("ref_a")}))


def chromosomes(sites: DataFrame) -> DataFrame:
    """(chrom, chrom_idx) of all chromosomes of the input, also those that filters leave empty."""
    return sites.groupBy("chrom", "chrom_idx").agg(F.lit(1).alias("one")).drop("one")
