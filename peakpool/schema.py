"""The tables that operators hand to each other."""

from __future__ import annotations

#: A site: its chromosome, that one's number by first appearance, its place in the input, and the pools' depths.
SITES = "chrom string, chrom_idx int, ord bigint, pos double, ref string, alt string, ref_a array<double>, mut_a array<double>"
#: A site after pretreatment.
CLEAN = f"{SITES}, freq array<double>"
#: A method's raw value.
RAW = "method string, chrom string, chrom_idx int, ord bigint, pos double, raw double"
#: Raw and smoothed value, with the window that was used.
SCORED = f"{RAW}, span double, smooth double"
PEAKS = "method string, qtl int, chrom string, chr_display string, left double, peak double, right double, value double"
INTERVALS = "method string, key string, seq int, pos double, data double, peak double"
PLOT = "method string, chromosome string, position bigint, position_mb double, raw_value double, smooth_value double, threshold double, above boolean"

METHODS = ("DL", "K", "ED4", "SNP", "SmoothG", "SmoothLOD", "Ridit")
SMOOTHERS = ("Tri-kernel-smooth", "LOWESS", "Moving Average")
