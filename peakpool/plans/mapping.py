"""The mapping run: sites to statistics, smoothed values, thresholds, peaks and profiles, as one plan over all methods."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.functions.statistics import statistic
from peakpool.operators import facets, network, peaks, pretreat, smoothing
from peakpool.schema import METHODS
from peakpool.sources import plots, sinks, sites, tables


def parse_methods(spec: str) -> list[str]:
    """`all`, or names separated by commas in any case; each once, in the order given."""
    if spec.strip().lower() == "all":
        return list(METHODS)
    known = {m.lower(): m for m in METHODS}
    names = [p.strip() for p in spec.split(",") if p.strip()]
    if bad := [n for n in names if n.lower() not in known]:
        raise ValueError(f"unknown method {bad[0]!r}; known: all, {', '.join(METHODS)}")
    if not names:
        raise ValueError("no method is named")
    return list(dict.fromkeys(known[n.lower()] for n in names))


def raw_values(clean: DataFrame, methods: list[str], n: int, weights: bytes | None = None) -> DataFrame:
    """RAW rows of all methods: the closed forms from one pass over the sites, the network's from its windows."""
    forms = [m for m in methods if m != "DL"]
    parts = []
    if forms:
        stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), statistic(m, n).alias("raw")) for m in forms]))
        parts.append(clean.select("chrom", "chrom_idx", "ord", "pos", stacked.alias("s")).select("s.method", "chrom", "chrom_idx", "ord", "pos", "s.raw"))
    if "DL" in methods:
        if weights is None:
            raise ValueError("method DL needs weights")
        parts.append(network.network_statistic(clean, weights, n))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def run_map(raw_sites: DataFrame, methods: str = "all", p: int = 1, p1: int = 0, p2: int = 1, p3: int = 1, smoother: str = "LOWESS", w: float = 0.0, t: float = 0.0, weights: bytes | None = None, skip_dl: bool = False) -> dict[str, DataFrame]:
    """Tables chroms, clean, scored, thresholds, peaks, profile, values. p2 has no effect; p3=0 turns the continuity filter on."""
    names = [m for m in parse_methods(methods) if not (skip_dl and m == "DL")]
    n = pretreat.n_pools(raw_sites)
    clean = pretreat.pretreat(raw_sites, n, p1, p3) if p else pretreat.no_pretreat(raw_sites)
    scored = smoothing.smooth(raw_values(clean, names, n, weights), smoother, w)
    limits = peaks.thresholds(scored, t)
    chroms = pretreat.chromosomes(raw_sites)
    found = peaks.peak_table(scored, limits, chroms, names)
    return {"chroms": chroms, "clean": clean, "scored": scored, "thresholds": limits, "peaks": found, "profile": peaks.interval_profile(scored, found), "values": peaks.values_table(scored)}


def name_kind(path: str) -> str:
    return path.rsplit("/", 1)[-1].partition(".")[2]


def report_skipped(records: DataFrame) -> tuple[int, int]:
    """(good, skipped) records of a VCF, printed, with the first five skipped ones."""
    n = records.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if n["bad"]:
        first = records.where("not good").orderBy("ord").select("chrom", "ord").limit(5).collect()
        print(f"skipped {n['bad']} malformed records, the first on: {', '.join(str(r['chrom']) for r in first)}")
    print(f"read {n['good']} records")
    return n["good"], n["bad"]


def vcf_to_csv(spark: SparkSession, path: str, folder: str) -> tuple[int, int]:
    """Writes a VCF's sites as a site table (text parts in input order); (good, skipped) records."""
    sinks.write_site_table(sites.read_vcf(spark, path), folder)
    return report_skipped(sites.vcf_records(spark, path))


def map_file(spark: SparkSession, path: str, out: str, methods: str = "all", p: int = 1, p1: int = 0, p2: int = 1, p3: int = 1, smoother: str = "LOWESS", w: float = 0.0, t: float = 0.0, weights: str | None = None, skip_dl: bool = False) -> str:
    """Runs a site file and writes all result files under out/<name>. The site table is cached under out/cache by the file's
    content, and scored sites are written before they are used five times over."""
    name = path.rsplit("/", 1)[-1].partition(".")[0]
    key = tables.cache_key(spark, path)
    raw = tables.cached(spark, os.path.join(out, "cache"), key, lambda: sites.read_sites(spark, path))
    names = [m for m in parse_methods(methods) if not (skip_dl and m == "DL")]
    net = network.find_weights(pretreat.n_pools(raw), weights) if "DL" in names else None
    run = run_map(raw, ",".join(names), p, p1, p2, p3, smoother, w, t, net)
    if "vcf" in name_kind(path):
        report_skipped(sites.vcf_records(spark, path))
    options = {"methods": names, "p": p, "p1": p1, "p3": p3, "smoother": smoother, "w": w, "weights": net}
    scored = tables.cached(spark, os.path.join(out, "cache"), tables.cache_key(spark, path, **options), lambda: run["scored"])
    limits = peaks.thresholds(scored, t).cache()
    found = peaks.peak_table(scored, limits, run["chroms"], names).cache()
    folder = os.path.join(out, name)
    os.makedirs(folder, exist_ok=True)
    for r in limits.collect():
        m = r["method"]
        own = scored.where(F.col("method") == m)
        title = f"{p1}-{m}-{smoother}-{'auto' if w == 0 else f'{w:g}'}-{r['threshold']:.{4 if t == 0 else 2}f}"
        sinks.write_peaks(found.where(F.col("method") == m), os.path.join(folder, f"{title}.csv"))
        sinks.write_values(own, os.path.join(folder, f"{m} values.txt"))
        sinks.write_profiles(peaks.interval_profile(own, found.where(F.col("method") == m)), os.path.join(folder, f"{m}_confidence_interval_data.json"))
        sinks.write_arrays(own, run["chroms"], folder, m)
        records = peaks.plot_records(own, limits)
        ranges = {(x["kind"], x["name"]): (x["low"], x["high"]) for x in facets.facet_ranges(records).collect()}
        order = [x["chrom"] for x in run["chroms"].orderBy("chrom_idx").collect() if ("x", x["chrom"]) in ranges]
        plots.draw(plots.plot_bins(records), ranges, [m], order, os.path.join(folder, f"{title}.svg"))
    return folder
