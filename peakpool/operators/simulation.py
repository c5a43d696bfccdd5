"""Simulated pools: gametes by crossing over, couples, phenotypes, pool frequencies.

All draws are functions of a seed and the drawn thing's own numbers, so that results don't depend on the partitioning and a task
that is run again draws the same.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Crossovers of a gamete and chromosome, the phenotype's noise, the least distance of effect points and how it
#: shrinks.
CROSSOVERS, NOISE, MIN_GAP, SHRINK = (5.0, 0.5), 0.06, 6e6, 0.8


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.ln(uniform(seed, F.lit(1), *keys))) * F.cos(2 * pi * uniform(seed, F.lit(2), *keys))


def base_sites(spark: SparkSession, arrays: list[np.ndarray]) -> DataFrame:
    """(chrom, idx, pos, ref, mut) of base haplotypes, one array of rows [chrom, pos, ref, mut] for each chromosome; idx counts
    a chromosome's sites from 0."""
    tables = [pa.table({"chrom": a[:, 0].astype(np.int32), "idx": np.arange(len(a), dtype=np.int64), "pos": a[:, 1].astype(float), "ref": a[:, 2].astype(float), "mut": a[:, 3].astype(float)}) for a in map(np.asarray, arrays) if len(a)]
    kind = "chrom int, idx bigint, pos double, ref double, mut double"
    return spark.createDataFrame(pa.concat_tables(tables), kind) if tables else spark.createDataFrame([], kind)


def effect_points(base: DataFrame, e: int, seed: int = 0, attempts: int = 500) -> DataFrame:
    """(point, chrom, idx, pos, ref, mut) of e sites drawn with replacement from all sites, whose positions, chromosomes aside,
    lie MIN_GAP apart; after each `attempts` draws in vain the gap shrinks by a fifth. The driver draws (chrom, idx) by the
    chromosomes' counts; Spark looks up the sites of all attempts at one gap in one join."""
    spark = base.sparkSession
    sizes = sorted((r["chrom"], r["n"]) for r in base.groupBy("chrom").agg(F.count("*").alias("n")).collect())
    if not sizes or e < 1:
        return spark.createDataFrame([], f"point int, {base.select('chrom', 'idx', 'pos', 'ref', 'mut')._jdf.schema().toDDL()}")
    names, ends, rng, gap = np.array([c for c, _ in sizes]), np.cumsum([n for _, n in sizes]), np.random.default_rng(seed), MIN_GAP
    kind = base.schema["chrom"].dataType.simpleString()
    while True:
        flat = rng.integers(0, ends[-1], (attempts, e))
        of = np.searchsorted(ends, flat, side="right")
        idx = flat - np.concatenate([[0], ends])[of]
        drawn = pa.table({"attempt": np.repeat(np.arange(attempts, dtype=np.int32), e), "chrom": names[of].reshape(-1), "idx": idx.reshape(-1).astype(np.int64)})
        asked = spark.createDataFrame(drawn, f"attempt int, chrom {kind}, idx bigint")
        found = base.select("chrom", "idx", "pos", "ref", "mut").join(F.broadcast(asked), ["chrom", "idx"])  # attempts times e rows
        order = Window.partitionBy("attempt").orderBy("pos", "chrom", "idx")
        near = found.withColumn("step", F.col("pos") - F.lag("pos").over(order)).groupBy("attempt").agg(F.coalesce(F.min("step"), F.lit(float("inf"))).alias("step"))
        first = near.where((F.col("step") >= gap) | F.lit(gap < 1)).agg(F.min("attempt").alias("a")).first()["a"]
        if first is not None:
            rows = sorted(tuple(r) for r in found.where(F.col("attempt") == int(first)).select("chrom", "idx", "pos", "ref", "mut").collect())
            return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"point int, chrom {kind}, idx bigint, pos double, ref double, mut double")
        gap *= SHRINK


def crossovers(base: DataFrame, gametes: int, seed: int = 0) -> DataFrame:
    """(file, chrom, points): sorted places at which the two haplotypes of a gamete's chromosome swap their tails."""
    sizes = base.groupBy("chrom").agg(F.count("*").alias("n"))
    files = base.sparkSession.range(1, gametes + 1).select(F.col("id").cast("int").alias("file"))
    each = sizes.withColumn("file", F.explode(F.sequence(F.lit(1), F.lit(gametes)))) if gametes else sizes.join(files, F.lit(False)).select("chrom", "n", "file")
    times = F.greatest(F.lit(0), F.round(F.lit(CROSSOVERS[0]) + F.lit(CROSSOVERS[1]) * normal(seed, F.lit(11), F.col("file"), F.col("chrom"))).cast("int"))
    drawn = each.withColumn("times", times)
    points = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.floor(uniform(seed, F.lit(12), F.col("file"), F.col("chrom"), k) * F.col("n")))).otherwise(F.array().cast("array<bigint>"))
    return drawn.select("file", "chrom", F.array_sort(points).alias("points"))


def couples(spark: SparkSession, individuals: int, gametes: int, seed: int = 0) -> DataFrame:
    """(couple, side, file, strand): pairs of gamete strands, drawn without replacement."""
    strands = spark.range(0, 2 * gametes).select((F.floor(F.col("id") / 2) + 1).cast("int").alias("file"), (F.col("id") % 2).cast("int").alias("strand"))
    order = F.row_number().over(Window.orderBy(uniform(seed, F.lit(13), F.col("file"), F.col("strand")), "file", "strand")) - 1
    return strands.withColumn("place", order).where(F.col("place") < 2 * individuals).select(F.floor(F.col("place") / 2).cast("int").alias("couple"), (F.col("place") % 2).cast("int").alias("side"), "file", "strand")


def carries_ref(points: Column, idx: Column, strand: Column) -> Column:
    """Whether a strand carries the reference haplotype at a site: it starts as its own and swaps at each point up to there."""
    return (F.size(F.filter(points, lambda p: p <= idx)) + strand) % 2 == 0


def phenotypes(pairs: DataFrame, crosses: DataFrame, effects: DataFrame, e: int, seed: int = 0, noise: float = NOISE) -> DataFrame:
    """(couple, phenotype): each effect point adds 1/e if both strands carry the reference value, half of it if they differ,
    nothing if both carry the other; normal noise is added and the sum is kept within 0 and 1."""
    at = crosses.join(F.broadcast(effects), "chrom")  # the effect points are e rows
    value = at.join(pairs, "file").withColumn("is_ref", carries_ref(F.col("points"), F.col("idx"), F.col("strand")))
    value = value.withColumn("v", F.when(F.col("is_ref"), F.col("ref")).otherwise(F.col("mut")))
    both = value.groupBy("couple", "point").agg(F.count_if(F.col("v") == F.col("ref")).alias("refs"), F.count_if(F.col("v") == F.col("mut")).alias("muts"))
    part = F.when(F.col("refs") == 2, F.lit(1.0 / e)).when(F.col("muts") == 2, F.lit(0.0)).otherwise(F.lit(0.5 / e))
    summed = both.groupBy("couple").agg(F.sum(part).alias("s"))
    return pairs.select("couple").distinct().join(summed, "couple", "left").select("couple", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) + F.lit(noise) * normal(seed, F.lit(14), F.col("couple")))).alias("phenotype"))


def pool_members(phenotype: DataFrame, individuals: int, n_pools: int, ratio: float) -> DataFrame:
    """(pool, couple): the lowest, the highest and, between them, centred slices of int(individuals * ratio) couples by
    phenotype. An individual may be in several pools if slices overlap."""
    size, each = individuals // n_pools, int(individuals * ratio)
    starts = [0 if k == 0 else individuals - each if k == n_pools - 1 else (size - each) // 2 + size * k for k in range(n_pools)]
    ranked = phenotype.withColumn("rn", F.row_number().over(Window.orderBy("phenotype", "couple")) - 1)
    slices = F.array_compact(F.array(*[F.when((F.col("rn") >= s) & (F.col("rn") < s + each), F.lit(k)) for k, s in enumerate(starts)]))
    return ranked.select(F.explode(slices).alias("pool"), "couple")


def pool_frequencies(base: DataFrame, crosses: DataFrame, pairs: DataFrame, members: DataFrame, individuals: int, n_pools: int) -> DataFrame:
    """(chrom, idx, pos, pool, k): the sum of the members' haplotype values over 2 * (individuals // n_pools).

    Per site only the number of strands that carry the reference haplotype is needed: it changes at crossovers alone, so that
    a running sum over their net changes gives it, at the cost of crossovers and sites and not of their product."""
    strands = members.join(pairs, "couple").join(crosses, "file")
    start = strands.groupBy("chrom", "pool").agg(F.count("*").alias("strands"), F.count_if(F.col("strand") == 0).alias("refs"))
    swaps = strands.select("chrom", "pool", "strand", F.posexplode("points").alias("k", "idx")).groupBy("chrom", "pool", "idx").agg(F.sum(F.when((F.col("k") + F.col("strand")) % 2 == 0, -1).otherwise(1)).alias("change"))
    sites = base.join(start, "chrom").join(swaps, ["chrom", "pool", "idx"], "left")
    run = F.sum(F.coalesce("change", F.lit(0))).over(Window.partitionBy("chrom", "pool").orderBy("idx"))
    sites = sites.withColumn("now", F.col("refs") + run)
    k = (F.col("now") * F.col("ref") + (F.col("strands") - F.col("now")) * F.col("mut")) / F.lit(float(2 * (individuals // n_pools)))
    return sites.select("chrom", "idx", "pos", "pool", k.alias("k"))


def as_sites(frequencies: DataFrame, n_pools: int) -> DataFrame:
    """The site table of pool frequencies: depths k and 1 - k, alleles I."""
    wide = frequencies.groupBy("chrom", "idx", "pos").pivot("pool", list(range(n_pools))).agg(F.first("k"))
    ref, alt = F.array(*[F.col(f"`{k}`") for k in range(n_pools)]), F.array(*[1 - F.col(f"`{k}`") for k in range(n_pools)])
    index = frequencies.select("chrom").distinct().withColumn("chrom_idx", F.row_number().over(Window.orderBy("chrom")) - 1)
    wide = wide.join(F.broadcast(index), "chrom")  # a row for each chromosome
    return wide.select(F.col("chrom").cast("string").alias("chrom"), "chrom_idx", F.col("idx").alias("ord"), "pos", F.lit("I").alias("ref"), F.lit("I").alias("alt"), ref.alias("ref_a"), alt.alias("mut_a"))


def simulate(base: DataFrame, individuals: int, n_pools: int = 2, ratio: float = 0.25, effects: int = 10, seed: int = 0) -> dict[str, DataFrame]:
    """All steps: effect points, crossovers, couples, phenotypes, members, frequencies, and the resulting site table."""
    spark, gametes = base.sparkSession, int(individuals * 1.2)
    points = effect_points(base, effects, seed)
    crosses, pairs = crossovers(base, gametes, seed), couples(spark, individuals, gametes, seed)
    seen = phenotypes(pairs, crosses, points, effects, seed)
    members = pool_members(seen, individuals, n_pools, ratio)
    freq = pool_frequencies(base, crosses, pairs, members, individuals, n_pools)
    return {"effects": points, "crossovers": crosses, "couples": pairs, "phenotypes": seen, "members": members, "frequencies": freq, "sites": as_sites(freq, n_pools)}
