"""Quality rules with thresholds from mergeable quantile sketches of each language and source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakpool.llm.common import as_bytes, parts, table, written

#: Bytes that don't count towards word_chars: the six white space characters, and continuation bytes of UTF-8.
NO_CHARS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
SYMBOLS = b"#*$%&|<>"
#: A sketch's bins grow by this factor: quantiles are right to one per cent.
GAMMA = 1.02
#: Tables of so many groups at most are broadcast; larger ones are joined by a shuffle.
BROADCAST_GROUPS = 10_000
#: What a sketch belongs to; levels() sets the first.
KEY = ["level", "lang", "source", "metric"]
WINDOW = 5


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    t = text or b""
    w = t.split()
    lines = [x for x in t.split(b"\n") if x.strip()]
    return len(w), len(t.translate(None, NO_CHARS)), len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(w), len(lines)


def repeated(w: list[bytes]) -> int:
    """Words in windows of five words that occur twice or more, the first occurrence included."""
    if len(w) <= WINDOW:
        return 0
    h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    n = len(h) - WINDOW + 1
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int32)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
RATES = {"length": "word_chars / n_words", "symbols": "n_symbols / n_words", "lines": "n_dup_lines / n_lines", "words": "n_words", "rows": "n_lines"}
#: Rules on counts: the sketched rate, its count, and what that is out of, with the sketch of the latter.
COUNTED = {"symbols": ("n_symbols", "n_words", "words"), "lines": ("n_dup_lines", "n_lines", "rows")}


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches):
        for b in parts(batches, 3):
            out = np.array([measure(t) for t in as_bytes(b.column(3))], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(out[:, i]) for i in range(6))], ["id", "lang", "source", *METRICS])

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, lang_col, source_col)]
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(["id", "lang", "source"], kinds, strict=True)) + "".join(f", {m} bigint" for m in METRICS))


def sketches(values: DataFrame) -> DataFrame:
    """(lang, source, metric, value) -> (lang, source, metric, bin, n): counts in bins whose bounds grow by GAMMA, bin null
    for zero. Sketches merge by adding counts, so partial aggregation builds them and the partitioning leaves no trace."""
    bin_of = F.when(F.col("value") > 0, F.ceil(F.log(F.col("value")) / F.lit(float(np.log(GAMMA)))))
    return values.where("value is not null").groupBy("lang", "source", "metric", bin_of.alias("bin")).agg(F.count("*").alias("n"))


def middle(bin_: Column) -> Column:
    return F.when(bin_.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), bin_) * F.lit(2 / (1 + GAMMA)))


def same(a: str, b: str, names: list[str]) -> Column:
    return F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in names))


def bounded(df: DataFrame) -> DataFrame:
    """df, broadcast if it has BROADCAST_GROUPS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def levels(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bin, n): the sketches of each language and source (level 2), merged ones of each language (1),
    and that of all texts (0). Three times the sketches' rows at most, whatever the number of groups."""
    rows = sketch.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    lang, source = F.when(F.col("level") > 0, F.col("lang")), F.when(F.col("level") > 1, F.col("source"))
    return rows.groupBy("level", lang.alias("lang"), source.alias("source"), "metric", "bin").agg(F.sum("n").alias("n"))


def chosen(values: DataFrame, least: int) -> DataFrame:
    """(lang, source, metric, values) of each language and source, from what each level's sketches gave: their own if those hold
    `least` texts, else the language's, else those of all texts."""
    own, lang, every = (values.where(F.col("level") == k).alias(a) for k, a in ((2, "own"), (1, "lang"), (0, "every")))
    rows = own.join(bounded(lang), same("own", "lang", ["lang", "metric"])).join(F.broadcast(every), same("own", "every", ["metric"]))  # a row for each metric
    pick = lambda c: F.when(F.col("own.total") >= least, F.col(f"own.{c}")).when(F.col("lang.total") >= least, F.col(f"lang.{c}")).otherwise(F.col(f"every.{c}"))
    return rows.select("own.lang", "own.source", "own.metric", *[pick(c).alias(c) for c in values.columns if c not in (*KEY, "total")])


def quantiles(sketch: DataFrame, at: dict[str, float]) -> DataFrame:
    """(the sketch's key, total, one column for each of at): the sketches' quantiles, by the bins' middles."""
    key = [c for c in KEY if c in sketch.columns]
    w = Window.partitionBy(*key)
    run = sketch.withColumns({"below": F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first())), "total": F.sum("n").over(w)})
    return run.groupBy(*key).agg(F.max("total").alias("total"), *[F.min(F.when(F.col("below") >= F.col("total") * F.lit(q), middle(F.col("bin")))).alias(name) for name, q in at.items()])


def breaks(sketch: DataFrame, zero: DataFrame, factor: float, above: float) -> DataFrame:
    """(the sketch's key, total, limit): where a sketch breaks off. Of neighbouring bins that hold texts, the first above the
    quantile `above` whose next one is `factor` times as high; the limit is their geometric mean. Null if there is none: then
    the group is one population. zero: (the sketch's key, zero), the rate that no occurrence stands for."""
    w = Window.partitionBy(*KEY)
    rows = sketch.alias("s").join(bounded(zero).alias("z"), same("s", "z", KEY)).select("s.*", "zero")
    rows = rows.withColumn("value", F.greatest(middle(F.col("bin")), F.col("zero")))
    run = rows.withColumns({"below": F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first())), "total": F.sum("n").over(w), "next": F.lead("value").over(w.orderBy(F.col("bin").asc_nulls_first()))})
    broken = (F.col("below") >= F.col("total") * F.lit(above)) & (F.col("next") >= F.col("value") * F.lit(factor))
    return run.groupBy(*KEY).agg(F.max("total").alias("total"), F.min(F.when(broken, F.sqrt(F.col("value") * F.col("next")))).alias("limit"))


def with_limits(m: DataFrame, limits: DataFrame) -> DataFrame:
    """m with the columns that limits holds for each language and source."""
    limits = limits.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    return m.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left").drop("lang_", "source_")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: float = 3.0, factor: float = 4.0, least: int = 30) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rules (those
    of length, symbols and lines that the text fails, comma-joined).

    base_failed: fewer than 10 words, or over a fifth of them in repeated windows. Of the others, kept is false if the text fails
    one of three rules, whose limits all come from the sketches of its language and source (chosen() says which, if they hold
    fewer than `least` texts):
    length: the mean word length lies beyond the group's middle half by over `fence` times its width and `fence` sampling
    errors; one is the upper quartile of the group's |length - median| sqrt(n_words), over sqrt(n_words).
    symbols, lines: symbols per word, or the share of repeated lines, lie beyond the place where the group's upper quarter breaks
    off (by `factor`; no occurrence stands for half of one in the group's median text), by over `fence` standard errors of a
    count at that rate, of one occurrence at least. A group that doesn't break off has no such limit.
    Quantiles are of all texts with words; nulls in lang or source
    are a group of their own; null and empty texts have no words and fail; very long texts are measured whole; repeated rows are
    judged alike; an empty table gives no rows. Other columns are not read. Counts are written once; sketches are aggregated
    before any shuffle, so that a hot source costs its bins only.
    """
    m = written(measured(docs, id_col, text_col, lang_col, source_col))
    stacked = m.where("n_words > 0").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.expr(e).cast("double").alias("value")) for k, e in RATES.items()])).alias("x")).select("lang", "source", "x.*")
    own = written(levels(sketches(stacked)))
    q = written(quantiles(own, {"low": 0.25, "mid": 0.5, "high": 0.75}))
    length = written(chosen(q.where("metric = 'length'"), least).drop("metric").withColumnsRenamed({c: f"length_{c}" for c in ("low", "mid", "high")}))
    zero = q.where(F.col("metric").isin([x[2] for x in COUNTED.values()]))
    named = F.create_map(*[F.lit(y) for k, x in COUNTED.items() for y in (x[2], k)])
    zero = zero.select("level", "lang", "source", named[F.col("metric")].alias("metric"), (0.5 / F.col("mid")).alias("zero"))
    limits = written(breaks(own.where(F.col("metric").isin(list(COUNTED))), zero, factor, 0.75))
    limits = chosen(limits, least).groupBy("lang", "source").pivot("metric", list(COUNTED)).agg(F.first("limit"))
    n_words = F.greatest("n_words", F.lit(1))
    mean = F.expr("word_chars / nullif(n_words, 0)")
    spread = with_limits(m.where("n_words > 0"), bounded(length)).select("lang", "source", F.lit("spread").alias("metric"), (F.abs(mean - F.col("length_mid")) * F.sqrt(n_words)).alias("value"))
    spread = chosen(written(quantiles(levels(sketches(spread)), {"spread": 0.75})), least).drop("metric")
    j = with_limits(m, bounded(written(with_limits(with_limits(length, limits), spread))))  # one join with the texts, by a shuffle if groups are many
    beside = F.lit(fence) * (F.col("length_high") - F.col("length_low") + F.col("spread") / F.sqrt(n_words))
    most = lambda k, n: F.col(k) * F.col(n) + F.lit(fence) * F.sqrt(F.greatest(F.col(k) * F.col(n), F.lit(1.0)))
    failed = {"length": ~mean.between(F.col("length_low") - beside, F.col("length_high") + beside)} | {k: F.col(x[0]) > most(k, x[1]) for k, x in COUNTED.items()}
    rules = F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in failed.items()])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return j.select(F.col("id").alias(id_col), *METRICS[:5], base.alias("base_failed"), (~base & (rules == "")).alias("kept"), rules.alias("rules"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
