"""The same queries as plain SQL over the test tables."""

from __future__ import annotations

from peakpool.functions.statistics import TAIL
from peakpool.operators.pretreat import CHI2_CRITICAL


def ctes(n: int = 2, p1: int = 0) -> str:
    flags = ["A", "R"] if n == 2 else ["A", "N", "R"]
    each = lambda f: ", ".join(f(i) for i in range(n))
    count = ", ".join(f"cast(count(case when l_returnflag = '{f}' and l_linestatus = '{s}' then 1 end) as double) as {c}{i}" for i, f in enumerate(flags) for s, c in (("O", "a"), ("F", "m")))
    fix = lambda c: f"case when {c} = 0 then 1e-4 else {c} end as {c}"
    stat = lambda i: f"(a{i}-m{i})*(a{i}-m{i})/(a{i}+m{i})"
    fits = " and ".join(f"{stat(i)} <= {CHI2_CRITICAL!r}" for i in range(n))
    z = n - 1
    apart = f"{stat(0)} > {CHI2_CRITICAL!r} and {stat(z)} > {CHI2_CRITICAL!r} and ((a0/(a0+m0) > 0.5 and a{z}/(a{z}+m{z}) < 0.5) or (a0/(a0+m0) < 0.5 and a{z}/(a{z}+m{z}) > 0.5))"
    depth = " and ".join(f"a{i}+m{i} >= {p1}" for i in range(n)) if p1 else "true"
    return f"""pile as (select cast(1 + l_partkey % 10 as int) as no, l_partkey * 10007 as bp, {count} from lineitem group by 1, 2),
sites as (select cast(no as varchar) as chrom, cast(no - 1 as int) as chrom_idx, row_number() over (partition by no order by bp) as ord, cast(bp as double) as pos, {each(lambda i: f"a{i}, m{i}")} from pile),
adj as (select chrom, chrom_idx, ord, pos, {each(lambda i: fix(f"a{i}") + ", " + fix(f"m{i}"))} from sites),
deep as (select * from adj where {depth}),
kept as (select *, {each(lambda i: f"a{i}/(a{i}+m{i}) as f{i}")} from deep where ({fits}) or ({apart}))"""


def ridit() -> str:
    """The ridit score of two pools, from columns a0, m0, a1, m1."""
    s0, s1, n = "(a0+m0)", "(a1+m1)", "(a0+m0+a1+m1)"
    r0, r1 = f"(({s0}/2)/{n})", f"(({s0}+{s1}/2)/{n})"
    ref, alt = "(a0+a1)", "(m0+m1)"
    first = f"({s0}*{r0}+{s1}*{r1})"
    ratio = f"((({s0}*{r0}*{r0}+{s1}*{r1}*{r1})-{first}*{first}/{n})/({n}-1)*{n}/({ref}*{alt}))"
    gap = f"abs((a0*{r0}+a1*{r1})/{ref}-(m0*{r0}+m1*{r1})/{alt})"
    t = "0.0"
    for k in range(18, 0, -1):
        t = f"({k}/(z+{t}))"
    poly = repr(TAIL[-1])
    for c in reversed(TAIL[:-1]):
        poly = f"({c!r}+z*{poly})"
    return f"""select chrom, chrom_idx, ord, pos, -ln(case when p is null or p = 0 then 0.01 else p end) as raw from (
  select *, case when z > 100 then 0.0 when z >= 1.9 then exp(-0.5*z*z)/sqrt(2*pi())/(z+{t}) else power(1+z*{poly}, -16)/2 end as p from (
    select *, case when ratio < 0 then 101.0 when ratio = 0 then null else gap/sqrt(ratio) end as z from (select *, {ratio} as ratio, {gap} as gap from kept)))"""


FORMS = {
    "K": "abs(f1-f0)",
    "ED4": "4*power(f1-f0, 4)",
    "SNP": "abs(f1-f0)",
    "SmoothG": "2*(f0*ln(f0/((f0+f1)*(f0+f1)/2)) + (1-f0)*ln((1-f0)/((2-f0-f1)/2)) + f1*ln(f1/((2-f0-f1)/2)) + (1-f1)*ln((1-f1)/0.5))",
    "SmoothLOD": "a0*log10(a0/(a0+m0)) + m0*log10(1-a0/(a0+m0)) + a1*log10(a1/(a1+m1)) + m1*log10(1-a1/(a1+m1)) - (a0+m0+a1+m1)*log10(0.5)",
}


def raw(method: str) -> str:
    return ridit() if method == "Ridit" else f"select chrom, chrom_idx, ord, pos, {FORMS[method]} as raw from kept"


def moving(w: int) -> str:
    after = (w - 1) // 2
    return f"sum(raw) over (partition by method, chrom_idx order by ord rows between {w - 1 - after} preceding and {after} following) / {w}"


def stacked(methods: list[str]) -> str:
    return " union all ".join(f"select '{m}' as method, * from ({raw(m)})" for m in methods)


LIMITS = """limits as (select method, floor(v * 1e4 + 0.5) / 1e4 as threshold from (
  select method, case when top < (case when s - floor(s) > 0.5 or (s - floor(s) = 0.5 and floor(s) % 2 <> 0) then floor(s) + 1 else floor(s) end) / 1e4 then p90 else high end as v from (
    select *, high * 1e4 as s from (select method, median(smooth) + 3 * stddev_pop(smooth) as high, quantile_cont(smooth, 0.9) as p90, max(smooth) as top from scored group by method))))"""

PEAKS = """ranked as (select *, pos / 1e6 as pos_mb, row_number() over (partition by method, chrom_idx order by pos, ord) as rn from scored),
above as (select *, rn - row_number() over (partition by method, chrom_idx order by rn) as island from ranked join limits using (method) where smooth >= threshold),
best as (select method, chrom, chrom_idx, island, min(rn) as start, arg_min(pos_mb, rn) as lft, arg_max(pos_mb, rn) as rgt, max(smooth) as v from above group by all),
isl as (select b.method, b.chrom, b.chrom_idx, b.start, b.lft, b.rgt, min(a.rn) as prn, any_value(b.v) as v from best b join above a on a.method = b.method and a.chrom_idx = b.chrom_idx and a.island = b.island and a.smooth = b.v group by all),
isl2 as (select i.method, i.chrom, i.chrom_idx, i.start, i.lft, r.pos_mb as peak, i.rgt, round_even(i.v, 5) as value from isl i join ranked r on r.method = i.method and r.chrom_idx = i.chrom_idx and r.rn = i.prn),
chroms as (select distinct chrom, chrom_idx from sites),
every as (select m.method, c.chrom, c.chrom_idx, i.start, i.lft, i.peak, i.rgt, i.value, row_number() over (partition by m.method order by c.chrom_idx, i.start nulls first) as row from (select method from limits) m cross join chroms c left join isl2 i on i.method = m.method and i.chrom_idx = c.chrom_idx),
found as (select method, cast(row_number() over (partition by method order by value desc nulls last, row desc) as int) as qtl, chrom, chrom || '.0' as chr_display, lft, peak, rgt, value from every)"""


def scored(methods: list[str], w: int = 5) -> str:
    return f"with {ctes()}, raws as ({stacked(methods)}), scored as (select *, {moving(w)} as smooth from raws), {LIMITS}, {PEAKS}"


TRI = """, n as (select chrom_idx, count(*) as n, cast(floor({span} * count(*)) as int) as w from raws group by 1),
s as (select r.*, n.n, n.w, row_number() over (partition by r.chrom_idx order by ord) as rn, case when w % 2 = 1 then (w - 1) // 2 else w // 2 - 1 end as l, case when w % 2 = 1 then (w - 1) // 2 else w // 2 end as g from raws r join n using (chrom_idx)),
d as (select chrom_idx, w, l, g, unnest(range(-l, g + 1)) as d from (select distinct chrom_idx, w, l, g from s)),
k as (select chrom_idx, d, power(1 - power(abs(d) / cast(greatest(l, g) as double), 3), 3) as k from d),
tot as (select chrom_idx, sum(k) as k from k group by 1)
select s.chrom, s.pos, round(sum(k.k * o.raw) / any_value(tot.k), 6) + 0.0 as smooth from s join k on k.chrom_idx = s.chrom_idx join tot on tot.chrom_idx = s.chrom_idx join s o on o.chrom_idx = s.chrom_idx and o.rn = s.rn + k.d group by s.chrom, s.pos"""

LOWESS = """, n as (select chrom_idx, count(*) as n, greatest(2, cast(floor({span} * count(*)) as int)) as q from raws group by 1),
s as (select r.*, n.n, n.q, row_number() over (partition by r.chrom_idx order by ord) - 1 as i from raws r join n using (chrom_idx)),
win as (select *, least(greatest(cast(ceil(i - q / 2.0) as bigint), 0), n - q) as lo from s),
h as (select *, greatest(i - lo, lo + q - 1 - i) as h from win),
m as (select h.chrom, h.pos, h.i, power(1 - power(abs(o.i - h.i) / cast(h.h as double), 3), 3) as w, cast(o.i - h.i as double) as x, o.raw as y from h join s o on o.chrom_idx = h.chrom_idx and o.i between h.lo and h.lo + h.q - 1),
f as (select chrom, pos, sum(w) as sw, sum(w * x) / sum(w) as xb, sum(w * y) / sum(w) as yb, sum(w * x * x) as sxx, sum(w * x * y) as sxy from m group by 1, 2)
select chrom, pos, round(yb - xb * (sxy - sw * xb * yb) / (sxx - sw * xb * xb), 6) + 0.0 as smooth from f"""
