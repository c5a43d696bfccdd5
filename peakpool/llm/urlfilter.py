"""URL rules by a Bloom filter cascade over the complete key universe of the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakpool.llm.common import table

#: The stated rules: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The rules are held on the driver: more are refused. The false positives of a level are expected to be fewer than the rules.
MAX_RULES = 10_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.lit(2**31 - 1))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys under which a rule for the url could be listed: each suffix of the host that starts a label, followed by each
    beginning of the path that is as long as some rule's path; longest host first, then longest path."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_compact(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]))
    return F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(h, p))))


class Level:
    """One Bloom filter: bits and hash count for a false positive rate; keys are hashed by XXH64 under two salts."""

    def __init__(self, spark: SparkSession, keys: list[str], rate: float, depth: int):
        self.depth = depth
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.bits = max(64, math.ceil(len(keys) * self.hashes / math.log(2)))
        words = [0] * (self.bits // 64 + 1)
        if keys:
            rows = spark.createDataFrame([(k,) for k in keys], "key string").select(F.explode(self.places(F.col("key"))).alias("bit")).distinct().collect()
            for (bit,) in rows:
                words[bit // 64] |= 1 << bit % 64
        self.words = [w - (1 << 64) if w >> 63 else w for w in words]

    def places(self, key: Column) -> Column:
        a, b = F.xxhash64(F.lit(2 * self.depth), key), F.xxhash64(F.lit(2 * self.depth + 1), key)
        half = lambda x: F.shiftrightunsigned(x, 1)
        return F.array(*[F.pmod(half(a) % F.lit(1 << 40) + F.lit(i) * (half(b) % F.lit(1 << 20) * 2 + 1), F.lit(self.bits)) for i in range(self.hashes)])

    def has(self, key: Column) -> Column:
        bitmap = F.array(*[F.lit(w).cast("bigint") for w in self.words])
        return F.forall(self.places(key), lambda p: F.call_function("shiftright", F.element_at(bitmap, (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)


class Cascade:
    """Exact membership in `listed` for every key of `universe`.

    The first level encodes the listed keys, the next the universe's keys that pass it without being listed, the next the
    listed keys that pass that one, and so on until a level lets nothing pass that it shouldn't. A key is listed if the number
    of levels that it passes in a row is odd. The first level's rate is listed / (universe * sqrt 2), so that the false
    positives, which the driver holds, are expected to be fewer than the listed keys whatever the size of the universe.
    """

    def __init__(self, universe: DataFrame, listed: list[str]):
        spark = universe.sparkSession
        if len(listed) > MAX_RULES:
            raise ValueError(f"{len(listed)} keys are listed; at most {MAX_RULES} are held")
        self.levels: list[Level] = []
        n = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
        within, others = list(listed), None
        while within:
            rate = min(0.5, len(listed) / (math.sqrt(2) * max(n, 1))) if not self.levels else 0.5
            self.levels.append(level := Level(spark, within, rate, len(self.levels)))
            if others is None:  # the false positives of the first level come from the whole universe
                inside = spark.createDataFrame([(k,) for k in listed], "key string")
                passed = universe.where(level.has(F.col("key"))).distinct().join(F.broadcast(inside), "key", "left_anti")
                others = [r.key for r in passed.collect()]
            else:
                others = [r.key for r in spark.createDataFrame([(k,) for k in others], "key string").where(level.has(F.col("key"))).collect()]
            within, others = others, within

    def holds(self, key: Column) -> Column:
        passed = F.lit(False)
        for i, level in reversed(list(enumerate(self.levels))):
            passed = F.when(level.has(key), F.lit(True) if i == len(self.levels) - 1 else ~passed).otherwise(F.lit(False))
        return passed


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The cascade tells which of a url's
    keys are listed, exactly and without a join, as the universe is all keys of all urls; the longest listed key is the rule,
    and a second cascade, over the blocked keys, tells its verdict. No rule: null and `default`. Null urls and urls without :// have
    empty host and path and no rule; repeated rows are judged alike; no rules or an empty table are allowed. Other columns
    are not read.
    """
    spec = {h + p: v for h, p, v in rules}
    host, path = host_path(F.col(url_col))
    own = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not spec:
        return own.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    own = own.withColumn("keys", url_keys(F.col("host"), F.col("path"), sorted({len(p) for _, p, _ in rules})))
    universe = own.select(F.explode("keys").alias("key"))
    listed = Cascade(universe, sorted(spec))
    blocked = Cascade(universe, sorted(k for k, v in spec.items() if v == "block"))
    best = F.aggregate(F.filter("keys", listed.holds), F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.char_length(k) > F.char_length(a)), k).otherwise(a))
    named = own.select(id_col, "host", "path", best.alias("rule"))
    return named.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow")))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def sql(rules=RULES, default: str = "allow") -> str:
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"when {fits(h, p)} then '{h + p}'" for h, p, _ in longest)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in longest)
    return f"""with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), own as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from cut
)
select page_id, host, path, case {rule} end as rule, case {verdict} else '{default}' end as verdict from own"""
