"""Association statistics of one site, as column expressions over the pools' depths and frequencies.

Pools are unrolled, as their number is known when the plan is built; the first pool is the low one, the last the high one.
"""

from __future__ import annotations

from functools import reduce
from math import pi, sqrt
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The polynomial for the normal tail below 1.9, lowest power first.
TAIL = (0.049867347, 0.0211410061, 0.0032776263, 0.0000380036, 0.0000488906, 0.000005383)
#: Where the polynomial ends, where the tail counts as zero, what a zero tail becomes, what a zero depth becomes.
TAIL_FROM, TAIL_ZERO, ZERO_P, ZERO_DEPTH = 1.9, 100.0, 0.01, 1e-4


def pools(name: str, n: int) -> list[Column]:
    return [F.col(name)[i] for i in range(n)]


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def k_slope(freq: list[Column]) -> Column:
    """Absolute slope of frequency over pools at equal steps from 0 to 1."""
    n = len(freq)
    x = [i / (n - 1) for i in range(n)]
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    return F.abs(total([F.lit(v - mean) * f for v, f in zip(x, freq, strict=True)]) / F.lit(spread))


def ed4(freq: list[Column]) -> Column:
    d = freq[-1] - freq[0]
    return F.lit(4.0) * d * d * d * d


def snp_index(freq: list[Column]) -> Column:
    return F.abs(freq[-1] - freq[0])


def smooth_g(freq: list[Column]) -> Column:
    """G of the first and last pool with this field's customary, crossed expected counts; 0 where a term is undefined."""
    low, high = freq[0], freq[-1]
    first, second = low + high, 2 - (low + high)
    term = lambda x, expected: x * F.ln(F.try_divide(x, expected))
    g = 2 * (term(low, first * first / 2) + term(1 - low, second / 2) + term(high, second / 2) + term(1 - high, F.lit(0.5)))
    return F.coalesce(F.when(~F.isnan(g), g), F.lit(0.0))


def smooth_lod(ref: list[Column], alt: list[Column]) -> Column:
    """LOD of pools 0 and 1 against equal frequencies; 0 where a term is undefined."""
    share = [F.try_divide(r, r + a) for r, a in zip(ref[:2], alt[:2], strict=True)]
    own = total([r * F.log10(p) + a * F.log10(1 - p) for r, a, p in zip(ref, alt, share, strict=False)])
    lod = own - total([*ref[:2], *alt[:2]]) * F.log10(F.lit(0.5))
    return F.coalesce(F.when(~F.isnan(lod), lod), F.lit(0.0))


def ridit_z(ref: list[Column], alt: list[Column]) -> Column:
    """The ridit test's normal deviate over pools as ordered classes; null where it is undefined, 101 for a negative variance."""
    size = [r + a for r, a in zip(ref, alt, strict=True)]
    n, n_ref, n_alt = total(size), total(ref), total(alt)
    before = [total(size[:m]) if m else F.lit(0.0) for m in range(len(size))]
    rank = [(b + s / 2) / n for b, s in zip(before, size, strict=True)]
    sums = [total([w * r for w, r in zip(x, rank, strict=True)]) for x in (ref, alt, size)]
    square = total([s * r * r for s, r in zip(size, rank, strict=True)])
    variance = F.try_divide(square - sums[2] * sums[2] / n, n - 1)
    ratio = F.try_divide(variance * n, n_ref * n_alt)
    return F.when(ratio < 0, F.lit(101.0)).otherwise(F.try_divide(F.abs(sums[0] / n_ref - sums[1] / n_alt), F.sqrt(ratio)))


def ridit(ref: list[Column], alt: list[Column]) -> Column:
    """Minus log of the upper tail of the ridit deviate; a tail of zero or an undefined one counts as 0.01."""
    z = ridit_z(*[[F.when(x == 0, F.lit(ZERO_DEPTH)).otherwise(x) for x in side] for side in (ref, alt)])
    return F.element_at(F.transform(F.array(z), tail_score), 1)  # a lambda names z, which is used many times


def tail_score(z: Column) -> Column:
    deep = F.aggregate(F.sequence(F.lit(18), F.lit(1), F.lit(-1)), F.lit(0.0), lambda t, k: k / (z + t))
    far = F.exp(-0.5 * z * z) / F.lit(sqrt(2 * pi)) / (z + deep)
    poly = F.lit(TAIL[-1])
    for c in reversed(TAIL[:-1]):
        poly = F.lit(c) + z * poly
    near = F.pow(1 + z * poly, F.lit(-16.0)) / 2
    p = F.when(z.isNull() | F.isnan(z) | (z > TAIL_ZERO), F.lit(0.0)).when(z >= TAIL_FROM, far).otherwise(near)
    return -F.ln(F.when(p == 0, F.lit(ZERO_P)).otherwise(p))


def statistic(method: str, n_pools: int) -> Column:
    """The named statistic over columns ref_a, mut_a and freq."""
    ref, alt, freq = (pools(c, n_pools) for c in ("ref_a", "mut_a", "freq"))
    if n_pools < 2:
        raise ValueError("at least two pools are needed")
    table = {"K": lambda: k_slope(freq), "ED4": lambda: ed4(freq), "SNP": lambda: snp_index(freq), "SmoothG": lambda: smooth_g(freq), "SmoothLOD": lambda: smooth_lod(ref, alt), "Ridit": lambda: ridit(ref, alt)}
    if method not in table:
        raise ValueError(f"unknown method {method}")
    return table[method]()
