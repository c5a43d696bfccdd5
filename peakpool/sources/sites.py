"""Readers of site tables: delimited text, VCF, and counts of the test tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separators in the order in which ties are decided.
SEPARATORS = (",", "\t", ";", " ")


def sniff(line: str) -> str:
    """The separator that occurs most often in a line; a comma if none does."""
    best = max(SEPARATORS, key=line.count)
    return best if best in line else ","


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line): a text's lines in order; ids are taken on the scan, before any shuffle. Compression by the name's suffix."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r+$", "").alias("line"))


def numbered(sites: DataFrame) -> DataFrame:
    """Adds chrom_idx by the chromosomes' first appearance; chromosomes are few, so their order is broadcast."""
    first = sites.groupBy("chrom").agg(F.min("ord").alias("first"))
    index = first.select("chrom", (F.row_number().over(Window.orderBy("first")) - 1).alias("chrom_idx"))
    return sites.join(F.broadcast(index) if index.count() <= 100_000 else index, "chrom")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table without header: chrom, pos, REF, ALT, then two depths for each pool. The separator is told by the first line;
    blank lines are skipped, cells are trimmed, nothing is quoted. A bad number raises when it is read; a bad width at once."""
    text = lines(spark, path).where(F.trim("line") != "")
    head = text.orderBy("ord").limit(1).collect()
    if not head:
        raise ValueError(f"{path} has no rows")
    sep = sniff(head[0]["line"])
    width = len(head[0]["line"].split(sep))
    if width < 6 or width % 2:
        raise ValueError(f"{path}: a row has chrom, pos, REF, ALT and two depths for each pool; found {width} columns")
    cells = text.select("ord", F.transform(F.split("line", "\\" + sep if sep != "\t" else "\t", -1), lambda c: F.trim(c)).alias("c"))
    depth = lambda at: F.array(*[F.col("c")[i].cast("double") for i in range(at, width, 2)])
    rows = cells.select(F.col("c")[0].alias("chrom"), "ord", F.col("c")[1].cast("double").alias("pos"), F.col("c")[2].alias("ref"), F.col("c")[3].alias("alt"), depth(4).alias("ref_a"), depth(5).alias("mut_a"))
    return numbered(rows).select("chrom", "chrom_idx", "ord", "pos", "ref", "alt", "ref_a", "mut_a")


def vcf_records(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, pos, ref, alt, depths, good): a VCF's records but for its first, which is always left out, like the leading
    header. good: ten columns or more, a whole-number position, and two whole numbers in each sample's AD field."""
    text = lines(spark, path)
    body = text.where(~F.col("line").startswith("#")).agg(F.min("ord").alias("first"))
    rest = text.join(F.broadcast(body), F.col("ord") > F.col("first")).where(F.trim("line") != "")
    c = F.split("line", "\t", -1)
    ad = F.array_position(F.split(F.get(c, 8), ":", -1), "AD")
    sample = lambda s: F.split(F.get(F.split(s, ":", -1), (ad - 1).cast("int")), ",", -1)
    number = lambda s, i: F.when(F.get(sample(s), F.lit(i)).rlike(r"^[+-]?[0-9]+$"), F.get(sample(s), F.lit(i)).try_cast("bigint"))
    pairs = F.when((F.size(c) >= 10) & (ad > 0), F.transform(F.slice(c, 10, F.greatest(F.size(c) - 9, F.lit(0))), lambda s: F.struct(number(s, 0).alias("ref"), number(s, 1).alias("alt"))))
    pos = F.when(F.get(c, 1).rlike(r"^[+-]?[0-9]+$"), F.get(c, 1).try_cast("bigint"))
    rows = rest.select("ord", F.get(c, 0).alias("chrom"), pos.alias("pos"), F.get(c, 3).alias("ref"), F.get(c, 4).alias("alt"), pairs.alias("depths"))
    good = F.col("pos").isNotNull() & F.col("depths").isNotNull() & F.coalesce(F.forall("depths", lambda d: d["ref"].isNotNull() & d["alt"].isNotNull()), F.lit(False))
    return rows.withColumn("good", good)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The sites of a VCF's good records; bad ones are skipped (vcf_records tells which)."""
    rows = vcf_records(spark, path).where("good")
    own = rows.select("chrom", "ord", F.col("pos").cast("double").alias("pos"), "ref", "alt", F.transform("depths", lambda d: d["ref"].cast("double")).alias("ref_a"), F.transform("depths", lambda d: d["alt"].cast("double")).alias("mut_a"))
    return numbered(own).select("chrom", "chrom_idx", "ord", "pos", "ref", "alt", "ref_a", "mut_a")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """By the file's name: what follows its first dot says whether it is a VCF."""
    _, dot, kind = path.rsplit("/", 1)[-1].partition(".")
    if not dot:
        raise ValueError(f"{path}: the name needs an extension (vcf or csv)")
    return read_vcf(spark, path) if "vcf" in kind else read_delimited(spark, path)


def pileup(spark: SparkSession, sf_dir: str, n_pools: int = 2) -> DataFrame:
    """Sites counted from lineitem: a part is a site, the return flag its pool, the line status its allele."""
    flags = ["A", "R"] if n_pools == 2 else ["A", "N", "R"]
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    count = lambda f, s: F.count(F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), 1)).cast("double")
    g = t.groupBy((F.col("l_partkey") % 10 + 1).cast("int").alias("no"), (F.col("l_partkey") * 10007).alias("at")).agg(*[count(f, s).alias(f"{s}{i}") for i, f in enumerate(flags) for s in "OF"])
    depth = lambda s: F.array(*[F.col(f"{s}{i}") for i in range(n_pools)])
    order = F.row_number().over(Window.partitionBy("no").orderBy("at")).cast("bigint")
    return g.select(F.col("no").cast("string").alias("chrom"), (F.col("no") - 1).alias("chrom_idx"), order.alias("ord"), F.col("at").cast("double").alias("pos"), F.lit("O").alias("ref"), F.lit("F").alias("alt"), depth("O").alias("ref_a"), depth("F").alias("mut_a"))
