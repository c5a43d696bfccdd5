"""Command line: map, simulate, plot, vcf2csv, compare."""

from __future__ import annotations

import argparse
import glob
import json
import os

import numpy as np
from pyspark.sql import SparkSession

from peakpool.operators import facets, simulation
from peakpool.plans.mapping import map_file, vcf_to_csv
from peakpool.schema import SMOOTHERS
from peakpool.sources import plots, sinks, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="peakpool")
    sub = top.add_subparsers(dest="command", required=True)
    m = sub.add_parser("map", help="map a site file or VCF")
    m.add_argument("--i", required=True, help="input: .vcf, .vcf.gz or a delimited table")
    m.add_argument("--m", default="all", help="methods, comma-separated")
    m.add_argument("--p", type=int, default=1, help="pretreat: 1 or 0")
    m.add_argument("--p1", type=int, default=0, help="least reads of a pool")
    m.add_argument("--p2", type=int, default=1, help="without effect")
    m.add_argument("--p3", type=int, default=1, help="0 turns the continuity filter on")
    m.add_argument("--s", default="LOWESS", choices=SMOOTHERS)
    m.add_argument("--w", type=float, default=0.0, help="window; 0 searches")
    m.add_argument("--t", type=float, default=0.0, help="threshold; 0 computes")
    m.add_argument("--weights", help="folder of network weights")
    m.add_argument("--skip-dl", action="store_true", help="leave the network out")
    m.add_argument("--o", default="Results")
    s = sub.add_parser("simulate", help="simulate pools from base haplotypes")
    s.add_argument("--i", type=int, default=200)
    s.add_argument("--p", type=int, default=2)
    s.add_argument("--r", type=float, default=0.25)
    s.add_argument("--e", type=int, default=10)
    s.add_argument("--s", default="simulated", help="output folder")
    s.add_argument("--base", default="Simulate_data", help="folder of base haplotypes (.npy, one for each chromosome)")
    s.add_argument("--seed", type=int, default=0)
    v = sub.add_parser("vcf2csv", help="write a VCF's sites as a site table")
    v.add_argument("--i", required=True)
    v.add_argument("--o", required=True, help="folder of the table's text parts")
    c = sub.add_parser("compare", help="compare two result folders")
    c.add_argument("--a", required=True)
    c.add_argument("--b", required=True)
    c.add_argument("--m", required=True, help="method")
    p = sub.add_parser("plot", help="facet tables and significant sites of a plot table")
    p.add_argument("--i", required=True)
    p.add_argument("--o", default="plot")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("peakpool").getOrCreate()
    if a.command == "map":
        print(map_file(spark, a.i, a.o, a.m, a.p, a.p1, a.p2, a.p3, a.s, a.w, a.t, a.weights, a.skip_dl))
    elif a.command == "simulate":
        paths = sorted(glob.glob(os.path.join(a.base, "*.npy")))
        if not paths:
            raise SystemExit(f"no base haplotypes in {a.base}")
        base = simulation.base_sites(spark, [np.load(x) for x in paths]).cache()
        out = simulation.simulate(base, a.i, a.p, a.r, a.e, a.seed)
        os.makedirs(a.s, exist_ok=True)
        for name in ("effects", "phenotypes"):
            with open(os.path.join(a.s, f"{name}.json"), "w") as f:
                json.dump([r.asDict() for r in out[name].toLocalIterator()], f)
        sinks.write_gametes(base, out["crossovers"], os.path.join(a.s, "gametes"))
        sinks.write_simulated(out["sites"], a.s)
    elif a.command == "vcf2csv":
        vcf_to_csv(spark, a.i, a.o)
    elif a.command == "compare":
        found = plots.compare_runs(plots.read_run(a.a, a.m), plots.read_run(a.b, a.m))
        print("\n".join(found) or "equal")
        if found:
            raise SystemExit(1)
    else:
        os.makedirs(a.o, exist_ok=True)
        records = tables.read_plot(spark, a.i).cache()
        sinks.write_significant(facets.significant(records.orderBy("ord")), os.path.join(a.o, "qtl_significant_table.csv"))
        sinks.write_significant(facets.facet_ranges(records).orderBy("kind", "name"), os.path.join(a.o, "facet_ranges.csv"))
        panels = facets.panels(records).orderBy("row", "column")
        sinks.write_significant(panels, os.path.join(a.o, "facet_panels.csv"))
        found = panels.collect()  # one row for each method and chromosome
        ranges = {(x["kind"], x["name"]): (x["low"], x["high"]) for x in facets.facet_ranges(records).collect()}
        rows, columns = (list(dict.fromkeys(x[c] for x in sorted(found, key=lambda x: x[k]))) for c, k in (("method", "row"), ("chromosome", "column")))
        plots.draw(plots.plot_bins(records), ranges, rows, columns, os.path.join(a.o, "facets.svg"))


if __name__ == "__main__":
    main()
