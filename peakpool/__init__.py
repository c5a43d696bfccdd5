"""Bulked segregant analysis on Spark: sites, statistics, smoothing, thresholds, peaks, intervals, simulation."""
