"""Quirks of the method, readers and sinks, against plain loops and literals."""

import gzip
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakpool.functions import scalars, statistics
from peakpool.operators import facets, network, peaks, pretreat, simulation, smoothing
from peakpool.plans.mapping import map_file, parse_methods, raw_values, run_map
from peakpool.sources import sites, tables

SITES = "chrom string, chrom_idx int, ord bigint, pos double, ref string, alt string, ref_a array<double>, mut_a array<double>"


def make(spark, rows):
    """rows: (chrom, pos, ref depths, alt depths) in input order."""
    idx = {}
    return spark.createDataFrame([(c, idx.setdefault(c, len(idx)), i, float(p), "A", "G", [float(x) for x in r], [float(x) for x in a]) for i, (c, p, r, a) in enumerate(rows)], SITES)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def stat(spark, method, ref, alt):
    df = pretreat.no_pretreat(make(spark, [("1", 1, ref, alt)]))
    return df.select(statistics.statistic(method, len(ref)).alias("v")).first()["v"]


def test_statistics_literals(spark):
    one = lambda f, *freq: spark.range(1).select(f([F.lit(float(x)) for x in freq]).alias("v")).first()["v"]
    assert one(statistics.k_slope, 0, 1) == pytest.approx(1.0) and one(statistics.k_slope, 0.2, 0.8) == pytest.approx(0.6)
    assert one(statistics.ed4, 0.1, 0.9) == pytest.approx(4 * 0.8**4) and one(statistics.snp_index, 0.1, 0.9) == pytest.approx(0.8)
    assert one(statistics.smooth_g, 1, 0) == 0.0
    assert stat(spark, "SmoothLOD", [90, 10], [10, 90]) > 20
    assert stat(spark, "SNP", [30, 10], [10, 30]) == pytest.approx(stat(spark, "K", [30, 10], [10, 30]))


def plain_ridit(a):
    ref, alt = a[::2], a[1::2]
    size = [x + y for x, y in zip(ref, alt)]
    n, seen, rank = sum(size), 0.0, []
    for s in size:
        rank.append((seen + s / 2) / n)
        seen += s
    var = (sum(s * r * r for s, r in zip(size, rank)) - sum(s * r for s, r in zip(size, rank)) ** 2 / n) / (n - 1)
    ratio = var * n / (sum(ref) * sum(alt))
    gap = abs(sum(x * r for x, r in zip(ref, rank)) / sum(ref) - sum(x * r for x, r in zip(alt, rank)) / sum(alt))
    z = gap / math.sqrt(ratio)
    return 0.5 * math.erfc(z / math.sqrt(2)), z


def test_ridit_is_near_the_exact_tail_and_scores_extremes_low(spark):
    for ref, alt in (([12, 30], [9, 31]), ([30, 10], [10, 30]), ([20, 25, 60], [22, 21, 40]), ([50, 3], [4, 55])):
        p, z = plain_ridit([x for pair in zip(ref, alt) for x in pair])
        assert stat(spark, "Ridit", ref, alt) == pytest.approx(-math.log(p), abs=2e-4), z
    assert stat(spark, "Ridit", [90000, 10], [10, 90000]) == pytest.approx(-math.log(0.01))  # a tail of zero counts as 0.01


def test_zero_depths(spark):
    df = make(spark, [("1", 1, [0, 50], [50, 0])])
    z = pretreat.zero_adjust(df).first()
    assert (z.ref_a, z.mut_a) == ([1e-4, 50.0], [50.0, 1e-4])
    n = pretreat.no_pretreat(df).first()  # both alleles change where the reference is zero, and only there
    assert (n.ref_a, n.mut_a, n.freq) == ([1e-4, 50.0], [1e-4, 0.0], [0.5, 1.0])


def test_filters(spark):
    df = make(spark, [("1", 1, [5, 5], [5, 5]), ("1", 2, [50, 50], [50, 50]), ("1", 3, [100, 1], [1, 100]), ("1", 4, [100, 100], [1, 1]), ("1", 5, [100, 50], [1, 50])])
    assert [r.pos for r in pretreat.depth_filter(df, 2, 20).orderBy("ord").collect()] == [2, 3, 4, 5]
    assert [r.pos for r in pretreat.pretreat(df, 2).orderBy("ord").collect()] == [1, 2, 3]  # all fit, or both ends deviate to opposite sides
    p = spark.range(1).select(pretreat.chi_square_p(F.lit(89.0), F.lit(85.0)).alias("a"), pretreat.chi_square_p(F.lit(100.0), F.lit(1.0)).alias("b")).first()
    assert p.a == pytest.approx(0.7617075639478075, abs=1e-6) and p.b == pytest.approx(6.795441656785791e-23, rel=1e-6)


def test_continuity(spark):
    rows = [("1", 1, [50], [50]), ("1", 2, [52], [48]), ("1", 3, [90], [10]), ("1", 4, [91], [9]), ("2", 1, [50], [50])]
    f = pretreat.with_freq(make(spark, rows))
    assert values(pretreat.continuity_filter(f, 1).orderBy("chrom_idx", "ord"), "chrom", "pos") == [("1", 1.0), ("1", 4.0)]  # neighbours before the filter; a lone site goes
    assert pretreat.pretreat(make(spark, [("1", 1, [50, 50], [50, 50])]), 2, p3=1).count() == 1  # p3=1: off
    assert pretreat.pretreat(make(spark, [("1", 1, [50, 50], [50, 50])]), 2, p3=0).count() == 0


def raws(spark, *series):
    return spark.createDataFrame([("SNP", str(c), c, i, float(i * 1000), float(v)) for c, s in enumerate(series) for i, v in enumerate(s)], "method string, chrom string, chrom_idx int, ord bigint, pos double, raw double")


def smooth(spark, name, w, *series):
    rows = smoothing.smooth(raws(spark, *series), name, w).orderBy("chrom_idx", "ord").collect()
    return [[r.smooth for r in rows if r.chrom_idx == c] for c in range(len(series))]


def test_moving_average(spark):
    rng = np.random.default_rng(0)
    assert smooth(spark, "Moving Average", 2, [1, 2, 3]) == [[0.5, 1.5, 2.5]]
    assert smooth(spark, "Moving Average", 0.5, [1, 2, 3]) == [[0, 0, 0]]  # a share is cut to zero rows
    for w in (1, 2, 5, 8, 13):
        a, b = rng.random(9), rng.random(20)
        for got, y in zip(smooth(spark, "Moving Average", w, a, b), (a, b)):
            assert np.allclose(got, np.convolve(y, np.ones(w) / w, "same")[: len(y)])


def test_tri_kernel(spark):
    got = smooth(spark, "Tri-kernel-smooth", 0.35, [5.0] * 20)[0]
    assert got[10] == pytest.approx(5) and got[0] < 5
    assert smooth(spark, "Tri-kernel-smooth", 0.05, [3.0] * 20)[0] == [3.0] * 20  # one row
    with pytest.raises(ValueError, match="no row"):
        smooth(spark, "Tri-kernel-smooth", 0.01, [5.0] * 20)


def slow_line(x, y, i, q):
    left = 0
    while left + q < len(x) and x[i] > (x[left] + x[left + q]) / 2:
        left += 1
    left = i if i < left else max(0, i - q + 1) if i > left + q - 1 else left
    j = np.arange(left, min(left + q, len(x)))
    h = max(x[i] - x[j[0]], x[j[-1]] - x[i])
    w = (1 - (np.abs(x[j] - x[i]) / (h if h > 0 else 1)) ** 3) ** 3
    keep = w > 0
    j, w = j[keep], w[keep]
    if np.ptp(x[j]) == 0:
        return (w * y[j]).sum() / w.sum()
    b, a = np.polyfit(x[j] - x[i], y[j], 1, w=np.sqrt(w))
    return a


def test_lowess_equals_point_fits(spark):
    rng = np.random.default_rng(2)
    for n, frac in ((3, 0.5), (10, 0.4), (41, 0.3), (60, 0.11), (30, 1.0)):
        y = rng.random(n)
        want = [slow_line(np.arange(n, dtype=float), y, i, min(n, max(2, int(frac * n)))) for i in range(n)]
        assert np.allclose(smooth(spark, "LOWESS", frac, y)[0], want)
        x = np.sort(np.round(rng.random(n), 1))  # ties
        q = min(n, max(2, int(frac * n)))
        assert np.allclose(smoothing.local_lines(x, y, frac)[0], [slow_line(x, y, i, q) for i in range(n)], atol=1e-6)
    assert np.allclose(smooth(spark, "LOWESS", 0.2, [2.0] * 50)[0], 2.0)
    y = np.sin(np.arange(100) / 10)
    assert np.corrcoef(smooth(spark, "LOWESS", 0.15, y)[0], y)[0, 1] > 0.99


def test_blocks_change_nothing(spark, monkeypatch):
    y = np.random.default_rng(3).random(300)
    for name, w in (("LOWESS", 0.05), ("Tri-kernel-smooth", 0.04)):
        whole = smooth(spark, name, w, y)[0]
        monkeypatch.setattr(smoothing, "BLOCK", 32)
        assert np.allclose(smooth(spark, name, w, y)[0], whole)
        monkeypatch.undo()


def test_spans(spark):
    assert smoothing.best_span(np.arange(5.0), np.arange(5.0)) == 0.95  # too few points for the criterion
    s = smoothing.auto_spans(raws(spark, np.random.default_rng(4).random(80))).collect()
    assert len(s) == 1 and 0.05 <= s[0].span <= 0.95
    with pytest.raises(ValueError, match="unknown smoother"):
        smoothing.smooth(raws(spark, [1.0]), "Spline")


def scored(spark, *series):
    return smoothing.smooth(raws(spark, *series), "Moving Average", 1.0)


def test_peaks_and_ids(spark):
    s = scored(spark, [0, 0.5, 0.9, 0.4, 0, 0, 0.7, 0.2], [0.1, 0.2], [0.9, 0.9, 0])
    limits = peaks.thresholds(s, 0.3)
    chroms = spark.createDataFrame([("0", 0), ("1", 1), ("2", 2), ("x", 3)], "chrom string, chrom_idx int")
    got = values(peaks.peak_table(s, limits, chroms, ["SNP"]).orderBy("qtl"), "qtl", "chr_display", "left", "peak", "right", "value")
    assert got == [(1, "2.0", 0.0, 0.0, 0.001, 0.9), (2, "0.0", 0.001, 0.002, 0.003, 0.9), (3, "0.0", 0.006, 0.006, 0.006, 0.7), (4, "x", None, None, None, None), (5, "1.0", None, None, None, None)]


def test_threshold(spark):
    x = [0.1] * 50 + [0.9] + [0.2] * 20
    t = peaks.thresholds(scored(spark, x)).first().threshold
    high = np.median(x) + 3 * np.std(x)
    assert t == math.floor(high * 1e4 + 0.5) / 1e4
    y = list(np.linspace(0, 1, 11))
    assert peaks.thresholds(scored(spark, y)).first().threshold == 0.9  # none reaches the first: the 90th percentile


def test_profile_matches_stepping(spark):
    rng = np.random.default_rng(5)
    pos = np.sort(rng.integers(0, 200_000, 300)).astype(float)
    df = spark.createDataFrame([("SNP", "1", 0, i, float(p), float(v), 1.0, float(v)) for i, (p, v) in enumerate(zip(pos, rng.random(300)))], "method string, chrom string, chrom_idx int, ord bigint, pos double, raw double, span double, smooth double")
    at = float(pos[150] / 1e6)
    pk = spark.createDataFrame([("SNP", 1, "1", "1.0", at, at, at, 1.0), ("SNP", 2, "1", "1.0", at, float(pos[20] / 1e6), at, 0.5)], "method string, qtl int, chrom string, chr_display string, left double, peak double, right double, value double")
    got = {}
    for r in peaks.interval_profile(df, pk).orderBy("key", "seq").collect():
        got.setdefault(r.key, []).append((r.pos, r.data))
    v = [r.smooth for r in df.orderBy("ord").collect()]
    for key, mid in (("1.0", at), ("1.0*", pos[20] / 1e6)):
        x, want, c = (pos / 1e6) * 1e6, [], mid * 1e6
        for sign in (-1, 1):
            k, side = 1, []
            while (c - k * 1e4 >= x[0]) if sign < 0 else (c + k * 1e4 <= x[-1]):
                lo = c - k * 1e4 if sign < 0 else c + k * 1e4 - 1e4
                own = [i for i in range(300) if lo < x[i] < (lo + 1e4 if sign < 0 else c + k * 1e4)]
                if own:
                    side.append((np.mean(x[own]), np.mean([v[i] for i in own])))
                k += 1
            want += side[::-1] if sign < 0 else side
        assert np.allclose(got[key], want)


def test_input_order_counts_and_positions_sort_later(spark):
    rows = [("1", p, [50 + k, 50], [50, 50 + k]) for k, p in enumerate([300, 100, 200, 400])]
    run = run_map(make(spark, rows), "snp", p=0, smoother="Moving Average", w=2)
    s = run["scored"].orderBy("ord").collect()
    raw = [r.raw for r in s]
    assert np.allclose([r.smooth for r in s], np.convolve(raw, [0.5, 0.5], "same"))
    assert [r.position for r in run["values"].orderBy("rn").collect()] == [100, 200, 300, 400]


def test_scalars(spark):
    df = spark.createDataFrame([(1.00005, 1.5e-4), (0.125, -0.00005), (2.5, 2.00005)], "a double, b double")
    assert [r[0] for r in df.select(scalars.half_even(F.col("a"), 4)).collect()][0] == pytest.approx(1.0001)
    assert [r[0] for r in df.select(scalars.half_up(F.col("b"), 4)).collect()][:2] == [pytest.approx(1e-4), pytest.approx(-1e-4)]
    assert [scalars.shortest(x) for x in (3.0, 1e-7, 0.1, None)] == ["3.0", "0.0000001", "0.1", "-"]
    sci = spark.createDataFrame([(3.30060260012033e-07,), (1.0,), (123456.0,), (0.0,)], "x double").select(scalars.scientific(F.col("x")))
    assert [r[0] for r in sci.collect()] == ["3.30060260012033e-07", "1.00000000000000e000", "1.23456000000000e005", "0.00000000000000e000"]
    keys = spark.createDataFrame([("1",), ("01",), ("chr1",), ("1.5",), ("X",)], "c string").select(scalars.numeric_key(F.col("c")))
    assert [r[0] for r in keys.collect()] == ["1.0", "1.0", "chr1", "1.5", "X"]
    names = spark.createDataFrame([(x,) for x in ("chr10", "chr2", "chr1", "chrX", "chr02", "2", "10", "chr1a")], "chromosome string")
    assert [r.chromosome for r in facets.natural_order(names).orderBy("place").collect()] == ["2", "10", "chr1", "chr1a", "chr2", "chr02", "chr10", "chrX"]


VCF = "\n".join([
    "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
    "1\t5\t.\tG\tA\t1\tPASS\t.\tGT:AD\t0/1:1,2\t0/1:3,4",
    "1\t206542\t.\tG\tA\t22948.3\tPASS\tAC=8;AF=0.5\tGT:AD:DP:GQ:PL\t0/1:64,87:151:99:x\t0/1:49,45:94:99:y\r",
    "1\t7\t.\tG\tA\t1\tPASS\t.\tGT:DP\t0/1:10\t0/1:4", "", "2\tx\t.\tG\tA\t1\tPASS\t.\tGT:AD\t0/1:1,2\t0/1:3,4", "2\t9\t.\tG\tA\t1\tPASS\t.\tGT:AD\t0/1:.\t0/1:3,4",
    "2\t10\t.\tG\tA,C\t1\tPASS\t.\tAD:GT\t1,2,9:0/1\t3,4,9:0/1", "#late", "2\t11\t.\tG\tA\t1\tPASS\t.\tAD",
])


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(VCF)
    for name in ("a.vcf", "b.vcf.gz"):
        got = values(sites.read_sites(spark, str(tmp_path / name)).orderBy("ord"), "chrom", "chrom_idx", "pos", "ref_a", "mut_a")
        assert got == [("1", 0, 206542.0, [64.0, 49.0], [87.0, 45.0]), ("2", 1, 10.0, [1.0, 3.0], [2.0, 4.0])]
    assert sites.vcf_records(spark, str(tmp_path / "a.vcf")).where("not good").count() == 5


def test_delimited(spark, tmp_path):
    (tmp_path / "s.csv").write_text("1, 100 ,A,G,10,5,8,6\r\n\n2,300,A,G,20,8,15,7\n1,200,C,T,12,4,9,5\n")
    got = values(sites.read_sites(spark, str(tmp_path / "s.csv")).orderBy("ord"), "chrom", "chrom_idx", "pos", "ref_a", "mut_a")
    assert got == [("1", 0, 100.0, [10.0, 8.0], [5.0, 6.0]), ("2", 1, 300.0, [20.0, 15.0], [8.0, 7.0]), ("1", 0, 200.0, [12.0, 9.0], [4.0, 5.0])]
    assert [sites.sniff(x) for x in ("1,2,3", "1\t2\t3", "a;b", "a b", "a", "a,b;c")] == [",", "\t", ";", " ", ",", ","]
    for bad in ("1,2,3,4,5\n", "", "1,2,3,4,5,6,7\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            sites.read_sites(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "bad.csv").write_text("1,x,A,G,1,2\n")
    with pytest.raises(Exception):
        sites.read_sites(spark, str(tmp_path / "bad.csv")).collect()


def test_methods():
    assert parse_methods("all")[0] == "DL" and len(parse_methods("ALL")) == 7
    assert parse_methods("snp, k,SNP") == ["SNP", "K"]
    for bad in ("zz", ",", ""):
        with pytest.raises(ValueError):
            parse_methods(bad)


def slow_net(net, x):
    out = []
    for layer in net.layers:
        a = out[layer.inputs[0]] if layer.inputs else x
        if layer.op == network.CONV:
            k, pad = layer.size, (layer.size - 1) // 2 if layer.same else 0
            n = a.shape[1] + (k - 1 if layer.same else 0) + 1 - k
            y = np.zeros((a.shape[0], n, layer.weight.shape[2]))
            for b, t, d, i, o in np.ndindex(a.shape[0], n, k, a.shape[2], y.shape[2]):
                if 0 <= t + d - pad < a.shape[1]:
                    y[b, t, o] += a[b, t + d - pad, i] * layer.weight[d, i, o]
            y += 0 if layer.bias is None else layer.bias
            a = np.maximum(y, 0) if layer.act == network.RELU else 1 / (1 + np.exp(-y)) if layer.act == network.SIGMOID else y
        elif layer.op == network.POOL:
            a = np.stack([a[:, t * layer.stride : t * layer.stride + layer.size].max(1) for t in range((a.shape[1] - layer.size) // layer.stride + 1)], 1)
        elif layer.op == network.UPSAMPLE:
            a = a.repeat(layer.size, 1)
        elif layer.op == network.ADD:
            a = a + out[layer.inputs[1]]
        out.append(a)
    return out[-1]


def test_convolution_rounds_each_step():
    """Products and sums in single precision, one after the other as the SQL of dl_conv1x1_window64 has them."""
    f = np.array([(a / b, c / d) for b in range(1, 25) for a in range(b + 1) for d in range(1, 25) for c in range(d + 1)])
    x = np.pad(f, ((0, -len(f) % 64), (0, 0))).astype(np.float32).reshape(-1, 64, 2)
    one = np.float32(1)
    want = np.float32(1.5) * x[..., 0] + np.float32(-2.25) * x[..., 1] + np.float32(0.25)
    layer = network.Layer(network.CONV, [0], 1, weight=np.array([[[1.5], [-2.25]]], np.float32), bias=np.array([0.25], np.float32))
    assert (network.convolve(x, layer)[..., 0] == want).all()
    layer.act = network.SIGMOID
    assert (network.convolve(x, layer)[..., 0] == one / (one + np.exp(-want.astype(np.float64)).astype(np.float32))).all()


def test_network(spark):
    from peakpool.plans.registry import autoencoder

    net = autoencoder(3)
    x = np.random.default_rng(1).random((3, 64, 2)).astype(np.float32)
    assert np.allclose(net.forward(x), slow_net(net, x.astype(float)), atol=1e-5)
    again = network.Network.read(net.write())
    assert np.array_equal(again.forward(x), net.forward(x))
    for bad in (b"xxxx", net.write()[:-3]):
        with pytest.raises(ValueError):
            network.Network.read(bad)
    rows = [("1", i, [int(50 + 40 * v[0]), int(60 * v[1])], [50, 60]) for i, v in enumerate(x.reshape(-1, 2)[:130])]
    clean = pretreat.no_pretreat(make(spark, rows))
    got = [r.raw for r in raw_values(clean, ["DL"], 2, net.write()).orderBy("ord").collect()]
    f = np.zeros((192, 2), np.float32)
    f[:130] = [r.freq for r in clean.orderBy("ord").collect()]
    assert np.allclose(got, net.forward(f.reshape(3, 64, 2)).reshape(-1)[:130])
    with pytest.raises(ValueError):
        network.find_weights(11)


def test_plot_table(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Method,Chromosome,Position,Raw_Value,Smooth_Value,Threshold,Above_Threshold\nK,chr2,1500000,0.5,x,0.3,True\nK,chr10,7,0.1,0.2,0.3,FALSE\nSNP,chr2,8,-0.5,0.2,0.4,1\n")
    r = tables.read_plot(spark, str(tmp_path / "p.csv"))
    assert values(r.orderBy("ord"), "position_mb", "smooth_value", "above")[0] == (1.5, 0.0, True)
    assert values(facets.panels(r).orderBy("row", "column"), "method", "chromosome", "row", "column", "threshold") == [("K", "chr2", 1, 1, 0.3), ("K", "chr10", 1, 2, 0.3), ("SNP", "chr2", 2, 1, 0.4)]
    assert {(x.kind, x.name): (x.low, x.high) for x in facets.facet_ranges(r).collect()}["y", "SNP"] == (-0.5, 0.4)
    s = facets.significant(r).orderBy("position_bp").collect()
    assert [x.position_bp for x in s] == [8, 1500000] and s[1].raw_value == "5.00000000000000e-01" and s[1].method_threshold == "0.3000"


def test_simulation(spark):
    base = simulation.base_sites(spark, [np.array([[c, p * 1e6, 0, 1] for p in range(30)]) for c in (1, 2)]).cache()
    a, b = (simulation.simulate(base, 40, 2, 0.25, 4, seed=5) for _ in (1, 2))
    rows = [values(x["frequencies"].orderBy("chrom", "idx", "pool"), "chrom", "idx", "pool", "k") for x in (a, b)]
    assert rows[0] == rows[1] and len(rows[0]) == 120  # a seed draws the same
    assert max(r[3] for r in rows[0]) <= 0.5 + 1e-9  # 10 members of pools that count as 20
    cross = {(r.file, r.chrom): r.points for r in a["crossovers"].collect()}
    pairs, members = a["couples"].collect(), a["members"].collect()
    assert len({(r.file, r.strand) for r in pairs}) == len(pairs) == 80
    for chrom, idx, pool, k in rows[0][::7]:
        own = {m.couple for m in members if m.pool == pool}
        total = sum((sum(p <= idx for p in cross[r.file, chrom]) + r.strand) % 2 for r in pairs if r.couple in own)
        assert k == pytest.approx(total / 40)
    ph = {r.couple: r.phenotype for r in a["phenotypes"].collect()}
    assert len(ph) == 40 and all(0 <= v <= 1 for v in ph.values())
    low = sorted(ph, key=lambda c: (ph[c], c))
    assert {m.couple for m in members if m.pool == 0} == set(low[:10]) and {m.couple for m in members if m.pool == 1} == set(low[-10:])
    gaps = sorted(r.pos for r in a["effects"].collect())
    assert all(y - x >= 6e6 for x, y in zip(gaps, gaps[1:]))


def test_map_file_and_cache(spark, tmp_path):
    rng = np.random.default_rng(7)
    src = tmp_path / "demo.csv"
    src.write_text("".join(f"{c},{1000 * i},A,G,{rng.integers(20, 60)},{rng.integers(20, 60)},{rng.integers(20, 60)},{rng.integers(20, 60)}\n" for c in (1, 2) for i in range(60)))
    out = map_file(spark, str(src), str(tmp_path / "out"), methods="SNP,K", smoother="LOWESS", w=0.3)
    names = sorted(os.listdir(out))
    assert "SNP values.txt" in names and "K_confidence_interval_data.json" in names and "smooth_data_for_plot_SNP.npy" in names
    csvs = [n for n in names if n.endswith(".csv")]
    assert len(csvs) == 2 and csvs[0].startswith("0-K-LOWESS-0.3-")
    assert open(os.path.join(out, csvs[0])).readline() == "QTL,Chr,Left,Peak,Right,Value\n"
    ragged = np.load(os.path.join(out, "all_data_for_plot_K.npy"), allow_pickle=True)
    assert len(ragged) == 2 and sum(map(len, ragged)) == len(np.load(os.path.join(out, "all_data_for_percentile_K.npy")))
    json.load(open(os.path.join(out, "K_confidence_interval_data.json")))
    before = tables.cache_key(spark, str(src))
    src.write_text(src.read_text() + "2,99999,A,G,30,30,30,30\n")
    assert tables.cache_key(spark, str(src)) != before


def test_stream(spark, tmp_path):
    from peakpool.streaming.sites import stream_sites, stream_statistics

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,100,A,G,30,20,20,30\nbad,x,A,G,1,2,3,4\n2,5,A,G,40,41,39,40\n")
    q = stream_statistics(stream_sites(spark, str(tmp_path / "in"), 2), ["SNP", "K"], 2).writeStream.format("memory").queryName("st").start()
    q.processAllAvailable()
    got = {(r.method, r.chrom): r.raw for r in spark.table("st").collect()}
    q.stop()
    assert got["SNP", "1"] == pytest.approx(0.2) and len(got) == 4


def test_command_line(spark, tmp_path, monkeypatch):
    from peakpool.cli import main

    np.save(tmp_path / "ch1.npy", np.array([[1, p * 1e6, 0, 1] for p in range(40)]))
    main(["simulate", "--i", "20", "--e", "2", "--base", str(tmp_path), "--s", str(tmp_path / "sim")], spark)
    assert len(open(tmp_path / "sim" / "simulate_data.csv").readlines()) == 40
    main(["map", "--i", str(tmp_path / "sim" / "simulate_data.csv"), "--m", "snp", "--p", "0", "--s", "Moving Average", "--w", "3", "--o", str(tmp_path / "res")], spark)
    assert os.path.exists(tmp_path / "res" / "simulate_data" / "SNP values.txt")
    (tmp_path / "p.csv").write_text("Method,Chromosome,Position,Raw_Value,Smooth_Value,Threshold,Above_Threshold\nK,1,15,0.5,0.4,0.3,TRUE\n")
    main(["plot", "--i", str(tmp_path / "p.csv"), "--o", str(tmp_path / "plot")], spark)
    assert open(tmp_path / "plot" / "qtl_significant_table.csv").readlines()[1].startswith("K,1,15,0.000015,5.00000000000000e-01,")


def test_vcf_command_counts_and_writes(spark, tmp_path, capsys):
    from peakpool.cli import main

    (tmp_path / "a.vcf").write_text(VCF)
    main(["vcf2csv", "--i", str(tmp_path / "a.vcf"), "--o", str(tmp_path / "out")], spark)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["1,206542,G,A,64,87,49,45", "2,10,G,A,C,1,2,3,4"]
    said = capsys.readouterr().out
    assert "skipped 5 malformed records" in said and "read 2 records" in said


def test_gametes_matrix_and_weights(spark, tmp_path, monkeypatch):
    from peakpool.sources import sinks

    base = simulation.base_sites(spark, [np.array([[c, p, p / 10, p / 10 + 5] for p in range(8)]) for c in (1, 2)])
    crosses = spark.createDataFrame([(1, 1, [3, 6]), (1, 2, []), (2, 1, [0]), (2, 2, [4, 4])], "file int, chrom int, points array<bigint>")
    sinks.write_gametes(base, crosses, str(tmp_path / "g"))
    own, other = np.arange(8) / 10, np.arange(8) / 10 + 5
    a, b = sinks.read_gamete(str(tmp_path / "g" / "1.bin"))
    swapped = np.isin(np.arange(8), [3, 4, 5])
    assert np.array_equal(a, [*np.where(swapped, other, own), *own]) and np.array_equal(b, [*np.where(swapped, own, other), *other])
    assert np.array_equal(sinks.read_gamete(str(tmp_path / "g" / "2.bin"))[0], [*other, *own])
    sinks.write_matrix(base.orderBy("chrom", "idx"), ["chrom", "pos", "ref", "mut"], str(tmp_path / "m.npy"))
    assert np.load(tmp_path / "m.npy").shape == (16, 4) and np.load(tmp_path / "m.npy")[9].tolist() == [2, 1, 0.1, 5.1]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "2pool.bin").write_bytes(b"x")
    monkeypatch.setenv("PEAKPOOL_WEIGHTS", str(tmp_path / "w"))
    assert network.find_weights(2) == b"x"
    with pytest.raises(FileNotFoundError):
        network.find_weights(2, str(tmp_path / "none"))


def test_any_site_can_be_an_effect_point(spark):
    base = simulation.base_sites(spark, [np.array([[c, p * 1e6, 0, 1] for p in range(50)]) for c in (1, 2)])
    drawn = {(r.chrom, r.idx) for seed in range(12) for r in simulation.effect_points(base, 12, seed, attempts=40).collect()}
    assert len(drawn) > 60  # of 100
    assert simulation.effect_points(base.limit(0), 3).count() == simulation.effect_points(base, 0).count() == 0


def test_plots_and_run_comparison(spark, tmp_path):
    from peakpool.sources import plots

    assert plots.ticks(0, 10) == [0, 2, 4, 6, 8, 10] and plots.ticks(3, 3) == [3] and plots.ticks(0.0, 0.3)[1] == 0.1
    assert [plots.tick_label(x) for x in (0.0, 2.0, 0.25, 1e8)] == ["0", "2", "0.25", "1e+08"]
    run = {"threshold": "0.3", "values": [("1", 5, 0.5), ("1", 9, 0.25)], "peaks": [("1.0", 0.7)]}
    assert plots.compare_runs(run, run) == []
    other = {"threshold": "0.4", "values": [("1", 5, 0.5), ("1", 9, 0.26)], "peaks": [("1.0", 0.8)]}
    assert len(plots.compare_runs(run, other)) == 3


def test_plain_sql_gives_the_same_rows(spark):
    """The queries that write and read again, on the smallest tables."""
    import duckdb

    from peakpool.plans import registry

    d, sql, con = "/root/testdata/sf0.001", registry.oracle_sql(), duckdb.connect()
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
    for name in ("site_table_roundtrip", "vcf_roundtrip", "vcf_counts", "plot_table_roundtrip", "facet_panels", "plot_bins", "significant_table", "flags", "dl_conv1x1_window64"):
        got = registry.queries()[name](spark, d)
        want = con.execute(sql[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns), name
        assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall())), name
