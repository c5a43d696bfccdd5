"""Smoothing of a method's values along each chromosome, in input order."""

from __future__ import annotations

from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakpool.schema import RAW, SCORED, SMOOTHERS

SERIES = ["method", "chrom_idx"]
#: Rows of a block of a long series, at least.
BLOCK = 1 << 16


def tricube(d: np.ndarray) -> np.ndarray:
    return np.where(np.abs(d) < 1, (1 - np.abs(d) ** 3) ** 3, 0.0)


def window_starts(x: np.ndarray, q: int) -> np.ndarray:
    """Where the window of q neighbours of each point begins: it moves right while the point lies beyond the middle of the
    window and the next point. x ascends."""
    n = len(x)
    middle = (x[: n - q] + x[q:]) / 2
    left = np.searchsorted(middle, x, side="left")
    i = np.arange(n)
    left = np.where(i < left, i, left)
    return np.where(i > left + q - 1, np.maximum(0, i - (q - 1)), left)


def local_lines(x: np.ndarray, y: np.ndarray, frac: float, points: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fit, leverage) of locally weighted lines at the points (all by default); x ascends. Rows are taken in blocks so that
    memory follows the window."""
    n = len(x)
    points = np.arange(n) if points is None else points
    if n < 2:
        return y[points].astype(float), np.ones(len(points))
    q = min(n, max(2, floor(frac * n)))
    left = window_starts(x, q)[points]
    fit, lever = np.empty(len(points)), np.empty(len(points))
    step = max(1, (1 << 16) // q)
    wide_x, wide_y = (np.lib.stride_tricks.sliding_window_view(v, q) for v in (x, y))
    dot = lambda *v: np.einsum(",".join(["ij"] * len(v)) + "->i", *v)
    for at in range(0, len(points), step):
        i, own = points[at : at + step], left[at : at + step]
        xj, yj = wide_x[own], wide_y[own]
        h = np.maximum(x[i] - xj[:, 0], xj[:, -1] - x[i])
        h = np.where(h <= 0, 1.0, h)
        r = np.abs(xj - x[i][:, None]) / h[:, None]
        w = np.maximum(1 - r * r * r, 0)
        w = w * w * w
        sw = w.sum(1)
        safe = np.where(sw > 0, sw, 1)
        swx, swy, wx = dot(w, xj), dot(w, yj), w * xj
        xbar, ybar = swx / safe, swy / safe
        sxx = dot(wx, xj) - sw * xbar * xbar
        sxy = dot(wx, yj) - sw * xbar * ybar
        flat = np.abs(sxx) < 1e-300
        slope = sxy / np.where(flat, 1, sxx)
        d = x[i] - xbar
        fit[at : at + step] = np.where(sw <= 0, y[i], np.where(flat, ybar, ybar + slope * d))
        lever[at : at + step] = np.where(sw <= 0, 1.0, np.where(flat, 1 / safe, 1 / safe + d * d / np.where(flat, 1, sxx)))
    return fit, lever


def evenly(y: np.ndarray, frac: float) -> np.ndarray:
    """local_lines over x = 0, 1, 2, ...: away from the ends the window is symmetric, so that the line's value is a mean with a
    fixed kernel."""
    n = len(y)
    if n < 3:
        return local_lines(np.arange(n, dtype=float), y, frac)[0]
    q = min(n, max(2, floor(frac * n)))
    h = q // 2
    inside = np.arange(h, n - h) if h else np.arange(0)
    kernel = tricube(np.arange(-h, h + 1) / h) if h else np.ones(1)
    out = np.empty(n)
    if len(inside) and q < n:
        out[inside] = np.convolve(y, kernel / kernel.sum(), mode="valid") if len(y) * len(kernel) < 1 << 28 else _fft(y, kernel / kernel.sum())
        ends = np.concatenate([np.arange(0, h), np.arange(n - h, n)])
    else:
        ends = np.arange(n)
    out[ends] = local_lines(np.arange(n, dtype=float), y, frac, ends)[0]
    return out


def _fft(y: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    size = 1 << (len(y) + len(kernel) - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(kernel, size), size)
    return full[len(kernel) - 1 : len(y)]


def aicc(signal: np.ndarray, position: np.ndarray, span: float) -> float:
    """The corrected Akaike criterion of the fit of position on signal (ascending); infinite where it isn't defined."""
    n = len(signal)
    if n < 7:
        return float("inf")
    fit, lever = local_lines(signal, position, span)
    trace, sigma = lever.sum(), ((position - fit) ** 2).sum() / (n - 1)
    rest = n - trace - 2
    if not (0 < sigma < np.inf) or rest <= 0:
        return float("inf")
    return log(sigma) + 1 + 4 * (trace + 1) / rest


def best_span(values: np.ndarray, position_mb: np.ndarray, low: float = 0.05, high: float = 0.95, within: float = 1e-3) -> float:
    """The span with the least criterion, by a golden-section search; three decimals."""
    order = np.argsort(values, kind="stable")
    x, y = values[order], position_mb[order]
    ratio = (5**0.5 - 1) / 2
    inner = [high - ratio * (high - low), low + ratio * (high - low)]
    cost = [aicc(x, y, s) for s in inner]
    while abs(high - low) > within:
        if cost[0] < cost[1]:
            high, inner[1], cost[1] = inner[1], inner[0], cost[0]
            inner[0] = high - ratio * (high - low)
            cost[0] = aicc(x, y, inner[0])
        else:
            low, inner[0], cost[0] = inner[0], inner[1], cost[1]
            inner[1] = low + ratio * (high - low)
            cost[1] = aicc(x, y, inner[1])
    return floor((inner[0] if cost[0] < cost[1] else inner[1]) * 1000 + 0.5) / 1000


def kernel_mean(y: np.ndarray, w: int, lead: int, count: int) -> np.ndarray:
    """Tri-cube means of w neighbours at y[lead : lead + count]; what lies outside y counts as zero, with its weight."""
    left = (w - 1) // 2 if w % 2 else w // 2 - 1
    right = w - 1 - left
    reach = max(left, right)
    if reach == 0:
        return y[lead : lead + count].copy()
    weight = (1 - (np.abs(np.arange(-left, right + 1)) / reach) ** 3) ** 3
    padded = np.concatenate([np.zeros(left), y, np.zeros(right)])
    out = np.convolve(padded, weight[::-1], mode="valid") / weight.sum() if weight.sum() > 0 else np.zeros(len(y))
    return out[lead : lead + count]


def auto_spans(raw: DataFrame) -> DataFrame:
    """(method, chrom_idx, span): the best span of each series. The search needs a series as a whole; chromosomes bound it."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("ord").to_numpy(), kind="stable")
        v, p = t.column("raw").to_numpy()[order], t.column("pos").to_numpy()[order] / 1e6
        return pa.table({"method": t.column("method").slice(0, 1), "chrom_idx": t.column("chrom_idx").slice(0, 1), "span": pa.array([best_span(v, p)])})

    tasks = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes cost many seconds here
    return raw.select("method", "chrom_idx", "ord", "pos", "raw").repartition(tasks, *SERIES).groupBy(*SERIES).applyInArrow(run, "method string, chrom_idx int, span double")


def moving_average(raw: DataFrame, w: float | None) -> DataFrame:
    """Means of int(w) neighbours, zero beyond the ends, as a framed window. None (searched spans, all below one) and windows
    below one give zeros. Series that are shorter than the window are taken as a whole."""
    size = int(w or 0)
    if size == 0:
        return raw.withColumn("smooth", F.lit(0.0))
    series = Window.partitionBy(*SERIES)
    counted = raw.withColumn("n", F.count("*").over(series))
    after = (size - 1) // 2
    mean = F.sum("raw").over(series.orderBy("ord").rowsBetween(after - size + 1, after)) / size
    long = counted.where(F.col("n") >= size).withColumn("smooth", mean).drop("n")

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("ord").to_numpy(), kind="stable")))
        y = t.column("raw").to_numpy()
        n, s = len(y), (len(y) - 1) // 2
        sums, i = np.concatenate([[0.0], np.cumsum(y)]), np.arange(len(y))
        out = (sums[np.minimum(n, i + s + 1)] - sums[np.clip(i + s - size + 1, 0, n)]) / size
        return t.append_column("smooth", pa.array(out))

    names = [f.name for f in long.schema]
    short = counted.where(F.col("n") < size).drop("n").groupBy(*SERIES).applyInArrow(run, long.schema)
    return long.unionByName(short).select(names)


def by_blocks(raw: DataFrame, reach, f) -> DataFrame:
    """f over blocks of each series with `reach` rows of margin on both sides, so that one task holds a block and not a
    chromosome. reach: a column over n and span. f(values, first row, n, span, lead, count) -> smoothed values."""
    series = Window.partitionBy(*SERIES)
    rows = raw.withColumns({"rn": F.row_number().over(series.orderBy("ord")) - 1, "n": F.count("*").over(series)}).withColumn("reach", reach)
    rows = rows.withColumn("size", F.greatest(F.lit(BLOCK), 2 * F.col("reach")))
    first, last = (F.floor((F.col("rn") + s * F.col("reach")) / F.col("size")) for s in (-1, 1))
    top = F.floor((F.col("n") - 1) / F.col("size"))
    spread = rows.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, top))))

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("rn").to_numpy(), kind="stable")))
        rn, size, block = t.column("rn").to_numpy(), t.column("size")[0].as_py(), t.column("block")[0].as_py()
        own = np.flatnonzero(rn // size == block)
        y = f(t.column("raw").to_numpy(), int(rn[0]), t.column("n")[0].as_py(), t.column("span")[0].as_py(), int(own[0]), len(own))
        names = [c.strip().split()[0] for c in RAW.split(",")] + ["span"]
        return t.slice(own[0], len(own)).select(names).append_column("smooth", pa.array(y))

    return spread.groupBy(*SERIES, "block").applyInArrow(run, SCORED)


def tri_kernel(raw: DataFrame) -> DataFrame:
    """Tri-cube means of int(span * n) neighbours."""
    if raw.groupBy(*SERIES).agg((F.first("span") * F.count("*")).alias("w")).where("w < 1").limit(1).count():
        raise ValueError("the tri-cube window has no row: span * sites of a chromosome must be at least 1")

    def f(y, first, n, span, lead, count):
        return kernel_mean(y, int(span * n), lead, count)

    return by_blocks(raw, F.least(F.floor(F.col("span") * F.col("n")) + 1, F.col("n")), f)


def lowess(raw: DataFrame) -> DataFrame:
    """Locally weighted lines over row numbers, span * n neighbours, no robustness rounds."""

    def f(y, first, n, span, lead, count):
        if len(y) == n:
            return evenly(y, span)[lead : lead + count]
        q = min(n, max(2, floor(span * n)))
        h = q // 2
        kernel = tricube(np.arange(-h, h + 1) / h)
        kernel /= kernel.sum()
        at = np.arange(lead, lead + count)
        row = at + first
        out, inner = np.empty(count), (row >= h) & (row < n - h)
        if inner.any():
            a, b = at[inner][0], at[inner][-1]
            out[inner] = np.convolve(y[a - h : b + h + 1], kernel, mode="valid") if count * len(kernel) < 1 << 28 else _fft(y[a - h : b + h + 1], kernel)
        for i in np.flatnonzero(~inner).tolist():  # the series' ends, by their own windows
            left = min(max(ceil(row[i] - q / 2), 0), n - q) - first
            x = np.arange(left, left + q, dtype=float) - at[i]
            w = tricube(x / max(-x[0], x[-1]))
            yj = y[left : left + q]
            sw, xbar, ybar = w.sum(), (w * x).sum() / w.sum(), (w * yj).sum() / w.sum()
            sxx = (w * x * x).sum() - sw * xbar * xbar
            out[i] = ybar - xbar * ((w * x * yj).sum() - sw * xbar * ybar) / sxx if abs(sxx) > 1e-300 else ybar
        return out

    return by_blocks(raw, F.greatest(F.lit(2), F.floor(F.col("span") * F.col("n"))), f)


def smooth(raw: DataFrame, smoother: str = "LOWESS", w: float = 0.0) -> DataFrame:
    """Values with `span` and `smooth`. w: the window, a share of the series or, for the moving average, a number of rows;
    0 searches each series' best span."""
    if smoother not in SMOOTHERS:
        raise ValueError(f"unknown smoother {smoother}; known: {', '.join(SMOOTHERS)}")
    columns = [c.strip().split()[0] for c in RAW.split(",")]
    if w == 0:
        spans = auto_spans(raw)
        raw = raw.join(spans, SERIES).select(*columns, "span")
    else:
        raw = raw.select(*columns, F.lit(float(w)).alias("span"))
    out = moving_average(raw, w or None) if smoother == "Moving Average" else {"LOWESS": lowess, "Tri-kernel-smooth": tri_kernel}[smoother](raw)
    return out.select(*columns, "span", "smooth")
