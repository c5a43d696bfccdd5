"""Plots of scored sites as SVG. Executors reduce each panel to one row for each of its columns of pixels, so that what is drawn
follows the picture and not the sites."""

from __future__ import annotations

from math import ceil, floor, log10
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of pixels and height of a panel, space around it.
WIDTH, HEIGHT, MARGIN = 160, 140, 46


def ticks(low: float, high: float, target: int = 5) -> list[float]:
    """Round places between low and high, about `target` of them, at steps of 1, 2 or 5 times a power of ten."""
    if not high > low:
        return [low]
    power = floor(log10((high - low) / target))
    steps = [m * 10.0**p for p in (power, power + 1) for m in (1, 2, 5)]
    places = lambda s: range(ceil(low / s - 1e-9), floor(high / s + 1e-9) + 1)
    step = min(steps, key=lambda s: (abs(len(places(s)) - target), s))
    return [round(k * step, 12) for k in places(step)]


def tick_label(v: float) -> str:
    return f"{round(v, 6):g}" if abs(v) >= 1e7 else f"{round(v, 6):f}".rstrip("0").rstrip(".") or "0"


def plot_bins(records: DataFrame, columns: int = WIDTH) -> DataFrame:
    """(method, chromosome, bin, at, low, high, smooth, threshold): of each panel's columns that hold sites the mean position,
    the least and largest raw value and the mean smoothed value; threshold: the panel's largest."""
    ends = records.groupBy("chromosome").agg(F.min("position_mb").alias("first"), F.max("position_mb").alias("last"))
    wide = F.greatest(F.col("last") - F.col("first"), F.lit(1e-12))
    rows = records.join(F.broadcast(ends), "chromosome")  # a row for each chromosome
    rows = rows.withColumn("bin", F.least(F.lit(columns - 1), F.floor((F.col("position_mb") - F.col("first")) / wide * columns)).cast("int"))
    return rows.groupBy("method", "chromosome", "bin").agg(F.avg("position_mb").alias("at"), F.min("raw_value").alias("low"), F.max("raw_value").alias("high"), F.avg("smooth_value").alias("smooth"), F.max("threshold").alias("threshold"))


def draw(bins: DataFrame, ranges: dict[tuple[str, str], tuple[float, float]], rows: list[str], columns: list[str], path: str) -> None:
    """One SVG of panels, methods by chromosomes: raw values as bars from least to largest, the smoothed line, the threshold.
    ranges: (kind, name) -> (low, high), x by chromosome and y by method. A pair without sites has an empty panel."""
    found: dict[tuple[str, str], list] = {}
    for r in bins.orderBy("method", "chromosome", "bin").collect():  # panels times their columns of pixels
        found.setdefault((r["method"], r["chromosome"]), []).append(r)
    step_x, step_y = WIDTH + MARGIN, HEIGHT + MARGIN
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{step_x * len(columns) + MARGIN}" height="{step_y * len(rows) + MARGIN}" font-family="sans-serif" font-size="9">']
    for i, method in enumerate(rows):
        for j, chrom in enumerate(columns):
            left, top = MARGIN + j * step_x, MARGIN / 2 + i * step_y
            (x0, x1), (y0, y1) = ranges["x", chrom], ranges["y", method]
            x = lambda v: left + (v - x0) / (x1 - x0 or 1) * WIDTH  # noqa: B023, E731
            y = lambda v: top + HEIGHT - (v - y0) / (y1 - y0 or 1) * HEIGHT  # noqa: B023, E731
            out.append(f'<rect x="{left}" y="{top}" width="{WIDTH}" height="{HEIGHT}" fill="none" stroke="#888"/><text x="{left}" y="{top - 3}">{escape(method)} {escape(chrom)}</text>')
            out += [f'<text x="{x(t):.1f}" y="{top + HEIGHT + 10}" text-anchor="middle">{tick_label(t)}</text>' for t in ticks(x0, x1, 4)]
            out += [f'<text x="{left - 3}" y="{y(t) + 3:.1f}" text-anchor="end">{tick_label(t)}</text>' for t in ticks(y0, y1, 4)] if j == 0 else []
            own = found.get((method, chrom), [])
            out += [f'<line x1="{x(r["at"]):.1f}" x2="{x(r["at"]):.1f}" y1="{y(r["low"]) + 0.5:.1f}" y2="{y(r["high"]) - 0.5:.1f}" stroke="#9ab"/>' for r in own]
            if own:
                line = " ".join(f"{x(r['at']):.1f},{y(r['smooth']):.1f}" for r in own)
                level = y(max(r["threshold"] for r in own))
                out.append(f'<polyline points="{line}" fill="none" stroke="#c22"/><line x1="{left}" x2="{left + WIDTH}" y1="{level:.1f}" y2="{level:.1f}" stroke="#333" stroke-dasharray="4 3"/>')
    with open(path, "w") as f:
        f.write("\n".join([*out, "</svg>\n"]))


def compare_runs(first: dict, second: dict, values: float = 1e-4, peaks: float = 0.05) -> list[str]:
    """How two runs' results differ: dicts with threshold, values (chrom, position, value) and peaks (chrom, Mb). Thresholds and
    positions must be equal, values agree to a relative `values`, peaks to `peaks` Mb."""
    found = []
    if float(first["threshold"]) != float(second["threshold"]):
        found.append(f"threshold: {first['threshold']} and {second['threshold']}")
    a, b = sorted(first["values"]), sorted(second["values"])
    if [x[:2] for x in a] != [x[:2] for x in b]:
        found.append(f"sites: {len(a)} and {len(b)}, or other positions")
    else:
        far = sum(abs(x[2] - y[2]) > values * max(abs(x[2]), abs(y[2]), 1e-12) for x, y in zip(a, b, strict=True))
        found += [f"values: {far} differ"] if far else []
    p, q = sorted(first["peaks"]), sorted(second["peaks"])
    if len(p) != len(q) or any(x[0] != y[0] or abs(x[1] - y[1]) > peaks for x, y in zip(p, q, strict=False)):
        found.append(f"peaks: {p} and {q}")
    return found


def read_run(folder: str, method: str) -> dict:
    """A run's result files of one method, for compare_runs."""
    import csv
    import glob
    import os

    table = next(f for f in sorted(glob.glob(os.path.join(glob.escape(folder), "*.csv"))) if f"-{method}-" in os.path.basename(f))
    with open(table) as f:
        peaks = [(r["Chr"], float(r["Peak"])) for r in csv.DictReader(f) if r["Peak"] != "-"]
    own = os.path.join(folder, f"{method} values.txt")
    parts = sorted(glob.glob(os.path.join(glob.escape(own), "part-*"))) if os.path.isdir(own) else [own]
    values = [(c, int(p), float(v)) for part in parts for c, p, v in (line.rstrip("\n").split("\t") for line in open(part))]
    return {"threshold": os.path.basename(table).removesuffix(".csv").rsplit("-", 1)[1], "values": values, "peaks": peaks}
