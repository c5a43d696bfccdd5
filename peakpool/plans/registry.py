"""The library's queries by name, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.functions.scalars import flag
from peakpool.functions.statistics import pools, statistic
from peakpool.operators import facets, network, peaks, pretreat, simulation, smoothing
from peakpool.plans import oracle as O
from peakpool.plans.mapping import raw_values
from peakpool.sources import plots, sinks
from peakpool.sources.scratch import scratch
from peakpool.sources.sites import pileup, read_delimited, read_vcf, vcf_records
from peakpool.sources.tables import read_plot

FORMS = ["K", "ED4", "SNP", "SmoothG", "SmoothLOD", "Ridit"]
WINDOW, SHARE = 5, 0.1


def r6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def depths(df: DataFrame, n: int = 2) -> DataFrame:
    return df.select("chrom", "chrom_idx", "ord", "pos", *[x.alias(f"{c}{i}") for c, k in (("a", "ref_a"), ("m", "mut_a")) for i, x in enumerate(pools(k, n))])


def freqs(df: DataFrame, n: int = 2) -> DataFrame:
    return df.select("chrom", "pos", *[r6(x, f"f{i}") for i, x in enumerate(pools("freq", n))])


def clean(spark: SparkSession, d: str, n: int = 2, p1: int = 0, p3: int = 1) -> DataFrame:
    return pretreat.pretreat(pileup(spark, d, n), n, p1, p3)


def raw(spark: SparkSession, d: str, methods: list[str]) -> DataFrame:
    return raw_values(clean(spark, d), methods, 2)


def scored(spark: SparkSession, d: str, methods: list[str], w: float = WINDOW, smoother: str = "Moving Average") -> DataFrame:
    return smoothing.smooth(raw(spark, d, methods), smoother, w)


def peak_rows(spark: SparkSession, d: str, methods: list[str]) -> DataFrame:
    s = scored(spark, d, methods).persist()  # thresholds and islands both read it
    return peaks.peak_table(s, peaks.thresholds(s), pretreat.chromosomes(pileup(spark, d)), methods)


def chi(spark, d):
    z = pretreat.zero_adjust(pileup(spark, d))
    return z.select("chrom", "pos", *[r6(pretreat.chi_square(F.col("ref_a")[i], F.col("mut_a")[i]), f"stat{i}") for i in (0, 1)], pretreat.chi_square_keep(2).alias("keep"))


def smoothed(smoother: str, w: float):
    return lambda spark, d: scored(spark, d, ["SNP"], w, smoother).select("chrom", "pos", r6("smooth", "smooth"))


def stat(method: str, n: int = 2):
    return lambda spark, d: clean(spark, d, n).select("chrom", "pos", r6(statistic(method, n), "raw"))


def shown(df: DataFrame) -> DataFrame:
    return df.select("method", "qtl", "chrom", "chr_display", *[r6(c, c) for c in ("left", "peak", "right", "value")])


def profile(spark, d):
    s = scored(spark, d, ["SNP"]).persist()
    found = peaks.peak_table(s, peaks.thresholds(s), pretreat.chromosomes(pileup(spark, d)), ["SNP"])
    # positions of the test tables lie 100 kb apart: scaled, so that bins hold some
    near = s.withColumn("pos", F.col("pos") / 50)
    return peaks.interval_profile(near, found.withColumn("peak", F.col("peak") / 50)).select("method", "key", "seq", r6("pos", "pos"), r6("data", "data"), r6("peak", "peak"))


def records(spark, d) -> DataFrame:
    s = scored(spark, d, FORMS).persist()
    return peaks.plot_records(s, peaks.thresholds(s))


def p90(spark, d):
    s = scored(spark, d, ["SNP"]).withColumn("smooth", F.least(F.col("smooth"), F.lit(0.12)))
    return peaks.thresholds(s)


def one_layer() -> network.Network:
    return network.Network([network.Layer(network.INPUT, []), network.Layer(network.CONV, [0], 1, act=network.SIGMOID, weight=np.array([[[1.5], [-2.25]]], np.float32), bias=np.array([0.25], np.float32))])


def autoencoder(seed: int = 1) -> network.Network:
    rng = np.random.default_rng(seed)
    conv = lambda i, k, a, b, act: network.Layer(network.CONV, [i], k, act=act, weight=rng.normal(0, 0.3, (k, a, b)).astype(np.float32), bias=rng.normal(0, 0.1, b).astype(np.float32))
    return network.Network([
        network.Layer(network.INPUT, []), conv(0, 5, 2, 8, network.RELU), network.Layer(network.POOL, [1], 2, 2), conv(2, 3, 8, 8, network.RELU), network.Layer(network.DROPOUT, [3]),
        network.Layer(network.UPSAMPLE, [4], 2), network.Layer(network.ADD, [5, 1]), conv(6, 3, 8, 1, network.SIGMOID),
    ])


def base(spark, d) -> DataFrame:
    """Base haplotypes from the parts: value 0 is the reference, 1 the other."""
    s = pileup(spark, d)
    return s.select((F.col("chrom_idx") + 1).alias("chrom"), (F.col("ord") - 1).alias("idx"), "pos", F.lit(0.0).alias("ref"), F.lit(1.0).alias("mut"))


def drawn(spark, individuals: int = 40, chroms: int = 10):
    """Crossovers and couples by plain arithmetic, so that SQL can draw the same."""
    files = spark.range(1, 2 * individuals + 1).select(F.col("id").cast("int").alias("file"))
    crosses = files.withColumn("chrom", F.explode(F.sequence(F.lit(1), F.lit(chroms)))).select("file", "chrom", F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (F.col("file") * 7919 + F.col("chrom") * 104729 + k * 1299709).cast("bigint") % 197)).alias("points"))
    pairs = spark.range(0, 2 * individuals).select(F.floor(F.col("id") / 2).cast("int").alias("couple"), (F.col("id") % 2).cast("int").alias("side"), (F.col("id") + 1).cast("int").alias("file"), (F.col("id") % 3 % 2).cast("int").alias("strand"))
    return crosses, pairs


def drawn_phenotypes(spark, d):
    crosses, pairs = drawn(spark)
    points = base(spark, d).where("idx in (17, 60, 111)").where("chrom in (2, 5, 9)").withColumn("point", F.col("chrom") * 1000 + F.col("idx").cast("int"))
    return simulation.phenotypes(pairs, crosses, points, 9, noise=0.0)


def sim_phenotype(spark, d):
    return drawn_phenotypes(spark, d).select("couple", r6("phenotype", "phenotype"))


def sim_pools(spark, d):
    crosses, pairs = drawn(spark)
    members = simulation.pool_members(drawn_phenotypes(spark, d).withColumn("phenotype", F.round("phenotype", 6)), 40, 3, 0.25)
    return simulation.pool_frequencies(base(spark, d), crosses, pairs, members, 40, 3).select("chrom", "idx", "pool", r6("k", "k"))


def simulated(spark, d):
    s = simulation.simulate(base(spark, d), 60, 2, 0.25, 5, seed=7)["sites"]
    n = 2
    v = smoothing.smooth(raw_values(pretreat.no_pretreat(s), ["SNP", "ED4"], n), "LOWESS", 0.1)
    return v.select("method", "chrom", "pos", r6("raw", "raw"), r6("smooth", "smooth"))


def auto_span(spark, d):
    return smoothing.auto_spans(raw(spark, d, FORMS)).select("method", "chrom_idx", "span")


def auto_peaks(spark, d):
    s = smoothing.smooth(raw(spark, d, FORMS), "LOWESS", 0.0).persist()  # the search for spans is dear, and its result is read twice
    return shown(peaks.peak_table(s, peaks.thresholds(s), pretreat.chromosomes(pileup(spark, d)), FORMS))


FLAGS = ["True", "true", "TRUE", "1", "tRUE", "yes", "0", ""]


def site_table(spark, d):
    folder = scratch(spark)
    sinks.write_site_table(pileup(spark, d), folder)
    return depths(read_delimited(spark, folder)).select("chrom", "pos", "a0", "m0", "a1", "m1")


def vcf(spark, d) -> str:
    """The test sites as a VCF, every fiftieth record malformed; one file, as its first record is told by its place."""
    s = depths(pileup(spark, d))
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    sample = lambda i: F.concat(F.lit("0/1:"), F.when(F.col("ord") % 50 == 0, F.lit(".")).otherwise(F.concat_ws(",", whole(f"a{i}"), whole(f"m{i}"))), F.lit(":9"))
    line = F.concat_ws("\t", "chrom", whole("pos"), *map(F.lit, (".", "O", "F", "50", "PASS", ".", "GT:AD:DP")), sample(0), sample(1))
    rows = s.select("chrom_idx", "ord", line.alias("value")).unionByName(spark.createDataFrame([(-1, 1, "##fileformat=VCFv4.2"), (-1, 2, "#CHROM\tPOS")], "chrom_idx int, ord bigint, value string"))
    folder = scratch(spark)
    rows.coalesce(1).sortWithinPartitions("chrom_idx", "ord").select("value").write.text(folder)
    return folder


def plot_table(spark, d):
    folder = scratch(spark)
    names = {"method": "Method", "chromosome": "Chromosome", "position": "Position", "position_mb": "Position_Mb", "raw_value": "Raw_Value", "smooth_value": "Smooth_Value", "threshold": "Threshold", "above": "Above_Threshold"}
    records(spark, d).withColumnsRenamed(names).write.option("header", True).csv(folder)
    return read_plot(spark, folder).select("method", "chromosome", "position", *[r6(c, c) for c in ("position_mb", "raw_value", "smooth_value")], "threshold", "above")


def names_in_order(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.explode(F.array(F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")), F.concat(F.lit("chr"), (F.col("l_suppkey") % 40).cast("string"), F.lit("_"), (F.col("l_linenumber") % 3).cast("string")), F.lpad((F.col("l_suppkey") % 12).cast("string"), 2, "0"))).alias("chromosome"))
    return facets.natural_order(t).select("chromosome", F.col("place").cast("bigint").alias("place"))


def queries() -> dict:
    q = {
        "pileup_sites": lambda s, d: depths(pileup(s, d)),
        "pileup_sites_3pool": lambda s, d: depths(pileup(s, d, 3), 3),
        "zero_adjust": lambda s, d: depths(pretreat.zero_adjust(pileup(s, d))),
        "depth_filter": lambda s, d: depths(pretreat.depth_filter(pretreat.zero_adjust(pileup(s, d)), 2, 9)),
        "chisq_stat": lambda s, d: chi(s, d).drop("keep"),
        "chisq_keep": lambda s, d: chi(s, d).where("keep").select("chrom", "pos"),
        "pretreat_default": lambda s, d: freqs(clean(s, d)),
        "pretreat_depth": lambda s, d: freqs(clean(s, d, p1=9)),
        "pretreat_none": lambda s, d: freqs(pretreat.no_pretreat(pileup(s, d))),
        "continuity_filter": lambda s, d: freqs(clean(s, d, p3=0)),
        "stat_k": stat("K"), "stat_ed4": stat("ED4"), "stat_snp": stat("SNP"), "stat_smoothg": stat("SmoothG"), "stat_smoothlod": stat("SmoothLOD"), "stat_ridit": stat("Ridit"), "stat_k_3pool": stat("K", 3),
        "stat_all": lambda s, d: raw(s, d, FORMS).select("method", "chrom", "pos", r6("raw", "raw")),
        "smooth_moving_average_odd": smoothed("Moving Average", 5), "smooth_moving_average_even": smoothed("Moving Average", 4), "smooth_moving_average_long": smoothed("Moving Average", 100_000), "smooth_moving_average_frac_zero": smoothed("Moving Average", 0.3),
        "smooth_trikernel": smoothed("Tri-kernel-smooth", SHARE), "smooth_lowess_fixed": smoothed("LOWESS", SHARE),
        "auto_span": auto_span,
        "threshold_auto": lambda s, d: (lambda x: peaks.thresholds(x))(scored(s, d, FORMS)),
        "threshold_manual": lambda s, d: peaks.thresholds(scored(s, d, FORMS), 0.25),
        "threshold_p90_fallback": p90,
        "peaks": lambda s, d: shown(peak_rows(s, d, ["SNP"])),
        "peaks_all_methods": lambda s, d: shown(peak_rows(s, d, FORMS)),
        "peaks_auto_window": auto_peaks,
        "confidence_interval": profile,
        "values_export": lambda s, d: peaks.values_table(scored(s, d, ["SNP"])).select("chrom", F.col("rn").cast("bigint").alias("rn"), "position", r6("value", "value")),
        "facet_ranges": lambda s, d: facets.facet_ranges(records(s, d)).select("kind", "name", r6("low", "low"), r6("high", "high")),
        "significant_table": lambda s, d: facets.significant(records(s, d).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("raw_value", "smooth_value")})),
        "site_table_roundtrip": site_table, "vcf_roundtrip": lambda s, d: depths(read_vcf(s, vcf(s, d))).select("chrom", "chrom_idx", "pos", "a0", "m0", "a1", "m1"),
        "vcf_counts": lambda s, d: vcf_records(s, vcf(s, d)).groupBy("good").agg(F.count("*").alias("n")),
        "plot_table_roundtrip": plot_table, "facet_panels": lambda s, d: facets.panels(records(s, d).withColumn("ord", F.array_position(F.array(*map(F.lit, FORMS)), F.col("method")) * 10**12 + F.col("position"))).select("method", "chromosome", F.col("row").cast("bigint").alias("row"), F.col("column").cast("bigint").alias("column"), "n", "threshold"),
        "plot_bins": lambda s, d: plots.plot_bins(records(s, d), 20).select("method", "chromosome", "bin", *[r6(c, c) for c in ("at", "low", "high", "smooth")], "threshold"),
        "flags": lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy(flag(F.element_at(F.array(*map(F.lit, FLAGS)), (F.col("l_partkey") % len(FLAGS) + 1).cast("int"))).alias("flag")).agg(F.count("*").alias("n")),
        "natural_order": names_in_order,
        "dl_conv1x1_window64": lambda s, d: network.network_statistic(clean(s, d), one_layer().write(), 2).select("chrom", "pos", F.round("raw", 4).alias("raw")),
        "dl_autoencoder": lambda s, d: network.network_statistic(clean(s, d), autoencoder().write(), 2).select("chrom", "pos", r6("raw", "raw")),
        "sim_phenotype": sim_phenotype, "sim_pools": sim_pools, "sim_run": simulated,
    }
    return q


def oracle_sql() -> dict[str, str]:
    w2, w3 = f"with {O.ctes()}", f"with {O.ctes(3)}"
    r = lambda e, name: f"round({e}, 6) + 0.0 as {name}"
    out = {
        "pileup_sites": f"{w2} select chrom, chrom_idx, ord, pos, a0, m0, a1, m1 from sites",
        "pileup_sites_3pool": f"{w3} select chrom, chrom_idx, ord, pos, a0, m0, a1, m1, a2, m2 from sites",
        "zero_adjust": f"{w2} select chrom, chrom_idx, ord, pos, a0, m0, a1, m1 from adj",
        "depth_filter": f"with {O.ctes(p1=9)} select chrom, chrom_idx, ord, pos, a0, m0, a1, m1 from deep",
        "chisq_stat": f"{w2} select chrom, pos, {', '.join(r(f'(a{i}-m{i})*(a{i}-m{i})/(a{i}+m{i})', f'stat{i}') for i in (0, 1))} from adj",
        "chisq_keep": f"{w2} select chrom, pos from kept",
        "pretreat_default": f"{w2} select chrom, pos, {r('f0', 'f0')}, {r('f1', 'f1')} from kept",
        "pretreat_depth": f"with {O.ctes(p1=9)} select chrom, pos, {r('f0', 'f0')}, {r('f1', 'f1')} from kept",
        "pretreat_none": f"{w2}, n as (select chrom, pos, " + ", ".join(f"case when a{i} = 0 then 1e-4 else a{i} end as a{i}, case when a{i} = 0 then 1e-4 else m{i} end as m{i}" for i in (0, 1)) + f" from sites) select chrom, pos, {r('a0/(a0+m0)', 'f0')}, {r('a1/(a1+m1)', 'f1')} from n",
        "continuity_filter": f"{w2}, b as (select *, " + ", ".join(f"{g}(f{i}) over (partition by chrom_idx order by ord) as {g}{i}" for g in ("lag", "lead") for i in (0, 1)) + f" from kept) select chrom, pos, {r('f0', 'f0')}, {r('f1', 'f1')} from b where (lag0 is not null or lead0 is not null) and (lag0 is null or (abs(f0-lag0) < 0.1 and abs(f1-lag1) < 0.1)) and (lead0 is null or (abs(f0-lead0) < 0.1 and abs(f1-lead1) < 0.1))",
        "stat_k_3pool": f"{w3} select chrom, pos, {r('abs((-0.5*f0 + 0.5*f2) / 0.5)', 'raw')} from kept",
        "stat_all": f"{w2} select method, chrom, pos, {r('raw', 'raw')} from ({O.stacked(FORMS)})",
        "smooth_moving_average_odd": f"{w2}, raws as ({O.stacked(['SNP'])}) select chrom, pos, {r(O.moving(5), 'smooth')} from raws",
        "smooth_moving_average_even": f"{w2}, raws as ({O.stacked(['SNP'])}) select chrom, pos, {r(O.moving(4), 'smooth')} from raws",
        "smooth_moving_average_frac_zero": f"{w2} select chrom, pos, 0.0::double as smooth from kept",
        "smooth_moving_average_long": f"{w2}, raws as ({O.stacked(['SNP'])}), s as (select *, count(*) over (partition by chrom_idx) as n, row_number() over (partition by chrom_idx order by ord) as rn from raws) select s.chrom, s.pos, {r('coalesce(sum(o.raw), 0) / 100000', 'smooth')} from s left join s o on o.chrom_idx = s.chrom_idx and o.rn <= s.rn + (s.n - 1) // 2 and o.rn > s.rn + (s.n - 1) // 2 - 100000 group by s.chrom, s.pos",
        "smooth_trikernel": f"{w2}, raws as ({O.stacked(['SNP'])}){O.TRI.format(span=SHARE)}",
        "smooth_lowess_fixed": f"{w2}, raws as ({O.stacked(['SNP'])}){O.LOWESS.format(span=SHARE)}",
        "threshold_auto": f"{O.scored(FORMS)} select method, threshold from limits",
        "threshold_manual": f"{w2} select method, 0.25::double as threshold from ({O.stacked(FORMS)}) group by method",
        "threshold_p90_fallback": f"{w2}, raws as ({O.stacked(['SNP'])}), scored as (select * replace (least(smooth, 0.12) as smooth) from (select *, {O.moving(5)} as smooth from raws)), {O.LIMITS} select method, threshold from limits",
        "natural_order": "with t as (select unnest(['chr' || l_linenumber, 'chr' || (l_suppkey % 40) || '_' || (l_linenumber % 3), lpad(cast(l_suppkey % 12 as varchar), 2, '0')]) as chromosome from lineitem), k as (select distinct chromosome, case when chromosome like 'chr%' then 1 else 0 end as g, cast(regexp_extract(chromosome, '([0-9]+)', 1) as int) as a, coalesce(try_cast(regexp_extract(chromosome, '_([0-9]+)', 1) as int), -1) as b from t) select chromosome, row_number() over (order by g, a, b) as place from k",
        "dl_conv1x1_window64": f"{w2} select chrom, pos, round(cast(cast(1 as real) / (cast(1 as real) + cast(exp(-cast(cast(1.5 as real) * cast(f0 as real) + cast(-2.25 as real) * cast(f1 as real) + cast(0.25 as real) as double)) as real)) as double), 4) as raw from kept",
    }
    out |= {f"stat_{m.lower()}": f"{w2} select chrom, pos, {r('raw', 'raw')} from ({O.raw(m)})" for m in FORMS}
    even = "(case when {v} * 1e5 - floor({v} * 1e5) > 0.5 or ({v} * 1e5 - floor({v} * 1e5) = 0.5 and floor({v} * 1e5) % 2 <> 0) then floor({v} * 1e5) + 1 else floor({v} * 1e5) end) / 1e5"
    fill = lambda q: q.replace("round_even(i.v, 5)", even.format(v="i.v"))
    rows = f"select method, qtl, chrom, chr_display, {r('lft', 'left')}, {r('peak', 'peak')}, {r('rgt', 'right')}, {r('value', 'value')} from found"
    out["peaks"] = fill(f"{O.scored(['SNP'])} {rows}").replace("as left,", 'as "left",').replace("as right,", 'as "right",')
    out["peaks_all_methods"] = fill(f"{O.scored(FORMS)} {rows}").replace("as left,", 'as "left",').replace("as right,", 'as "right",')
    out["values_export"] = f"{w2} select chrom, row_number() over (partition by chrom_idx order by pos, ord) as rn, cast(trunc(pos / 1e6 * 1e6) as bigint) as position, {r('raw', 'value')} from ({O.raw('SNP')})"
    out["confidence_interval"] = fill(f"""{O.scored(['SNP'])}, pk as (select *, chr_display || repeat('*', cast(row_number() over (partition by chr_display order by qtl) - 1 as int)) as key, peak / 50 * 1e6 as mid from found where peak is not null),
bp as (select method, chrom, smooth, pos / 50 / 1e6 * 1e6 as bp from scored), ends as (select chrom, min(bp) as first, max(bp) as last from bp group by 1),
st as (select pk.method, pk.chrom, key, mid, first, last, unnest(range(1, cast(floor((last - first) / 1e4) as bigint) + 3)) as k from pk join ends using (chrom)),
bins as (select method, chrom, key, mid, -k as seq, mid - k * 1e4 as lo, mid - k * 1e4 + 1e4 as hi from st where mid - k * 1e4 >= first union all select method, chrom, key, mid, k, mid + k * 1e4 - 1e4, mid + k * 1e4 from st where mid + k * 1e4 <= last)
select b.method, b.key, cast(b.seq as int) as seq, {r('avg(bp)', 'pos')}, {r('avg(smooth)', 'data')}, {r('any_value(mid)', 'peak')} from bins b join bp on bp.chrom = b.chrom and bp.bp > b.lo and bp.bp < b.hi group by b.method, b.key, b.seq""")
    flat = f"{O.scored(FORMS)}, rec as (select method, chrom, pos, pos / 1e6 as mb, raw, smooth, threshold from scored join limits using (method))"
    out["facet_ranges"] = fill(f"{flat} select 'x' as kind, chrom as name, {r('min(mb)', 'low')}, {r('max(mb)', 'high')} from rec group by chrom union all select 'y', method, {r('least(0.0, min(least(raw, smooth)))', 'low')}, {r('max(greatest(raw, smooth, threshold))', 'high')} from rec group by method")
    sci = lambda e: f"(split_part(printf('%.14e', {e}), 'e', 1) || 'e' || case when cast(split_part(printf('%.14e', {e}), 'e', 2) as int) < 0 then '-' || lpad(cast(-cast(split_part(printf('%.14e', {e}), 'e', 2) as int) as varchar), 2, '0') else lpad(cast(cast(split_part(printf('%.14e', {e}), 'e', 2) as int) as varchar), 3, '0') end)"
    out["significant_table"] = f"{flat} select method, chrom as chromosome, cast(pos as bigint) as position_bp, printf('%.6f', mb) as position_mb, {sci('round(raw, 6) + 0.0')} as raw_value, {sci('round(smooth, 6) + 0.0')} as fitted_value, printf('%.4f', threshold) as method_threshold, 'TRUE' as above_threshold from rec where smooth >= threshold"
    out["plot_table_roundtrip"] = f"{flat} select method, chrom as chromosome, cast(pos as bigint) as position, {r('mb', 'position_mb')}, {r('raw', 'raw_value')}, {r('smooth', 'smooth_value')}, threshold, smooth >= threshold as above from rec"
    out["facet_panels"] = f"{flat} select method, chrom as chromosome, list_position({FORMS!r}, method) as row, dense_rank() over (order by cast(chrom as int)) as column, count(*) as n, max(threshold) as threshold from rec group by method, chrom".replace("as row,", 'as "row",').replace("as column,", 'as "column",')
    out["plot_bins"] = f"{flat}, e as (select chrom, min(mb) as first, max(mb) as last from rec group by 1), b as (select rec.*, cast(least(19, floor((mb - first) / greatest(last - first, 1e-12) * 20)) as int) as bin from rec join e using (chrom)) select method, chrom as chromosome, bin, {r('avg(mb)', 'at')}, {r('min(raw)', 'low')}, {r('max(raw)', 'high')}, {r('avg(smooth)', 'smooth')}, max(threshold) as threshold from b group by method, chrom, bin"
    out["site_table_roundtrip"] = f"{w2} select chrom, pos, a0, m0, a1, m1 from sites"
    read = "not (chrom_idx = 0 and ord = 1)"
    out["vcf_roundtrip"] = f"{w2} select chrom, chrom_idx, pos, a0, m0, a1, m1 from sites where {read} and ord % 50 <> 0"
    out["vcf_counts"] = f"{w2} select ord % 50 <> 0 as good, count(*) as n from sites where {read} group by 1"
    out["flags"] = f"select l_partkey % {len(FLAGS)} < 4 as flag, count(*) as n from lineitem group by 1"
    out["sim_phenotype"] = f"{w2}, {SIM} select couple, {r('phenotype', 'phenotype')} from ph"
    out["sim_pools"] = f"{w2}, {SIM}, rk as (select couple, row_number() over (order by round(phenotype, 6), couple) - 1 as rn from ph), mem as (select 0 as pool, couple from rk where rn < 10 union all select 1, couple from rk where rn >= 14 and rn < 24 union all select 2, couple from rk where rn >= 30), st as (select pool, chrom, points, strand from mem join pairs using (couple) join cr using (file)) select s.chrom_idx + 1 as chrom, s.ord - 1 as idx, pool, {r('sum((len(list_filter(points, lambda p: p <= s.ord - 1)) + strand) % 2) / 26.0', 'k')} from sites s join st on st.chrom = s.chrom_idx + 1 group by 1, 2, 3"
    return out


SIM = """cr as (select file, chrom, [(file * 7919 + chrom * 104729 + k * 1299709) % 197 for k in range(1, 6)] as points from (select unnest(range(1, 81)) as file) cross join (select unnest(range(1, 11)) as chrom)),
pairs as (select cast(i // 2 as int) as couple, i + 1 as file, i % 3 % 2 as strand from (select unnest(range(0, 80)) as i)),
ef as (select chrom_idx + 1 as chrom, ord - 1 as idx from sites where ord - 1 in (17, 60, 111) and chrom_idx + 1 in (2, 5, 9)),
g as (select couple, ef.chrom, idx, sum((len(list_filter(points, lambda p: p <= idx)) + strand) % 2) as muts from pairs join cr using (file) join ef using (chrom) group by 1, 2, 3),
ph as (select couple, least(1.0, greatest(0.0, sum(case when muts = 0 then 1.0 / 9 when muts = 2 then 0.0 else 0.5 / 9 end))) as phenotype from g group by 1)"""
