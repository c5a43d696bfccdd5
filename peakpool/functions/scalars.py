"""Rounding, number formats, natural order and flags, as column expressions and their plain counterparts for sinks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Rounds the scaled double, ties to even. bround() would round its decimal text instead."""
    scaled = x * F.lit(10.0**digits)
    low = F.floor(scaled).cast("double")
    rest = scaled - low
    up = (rest > 0.5) | ((rest == 0.5) & (F.pmod(low, F.lit(2.0)) != 0))
    return F.when(up, low + 1).otherwise(low) / F.lit(10.0**digits)


def half_up(x: Column, digits: int) -> Column:
    """Rounds the scaled double, ties away from zero."""
    scaled = x * F.lit(10.0**digits)
    return F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)).cast("double") / F.lit(10.0**digits)


def shortest(v: float | None) -> str:
    """The shortest decimal without exponent; whole numbers end in .0; a dash for null."""
    if v is None:
        return "-"
    return f"{v:.1f}" if v == int(v) and abs(v) < 1e15 else format(Decimal(repr(v)), "f")


def plain(v: float) -> str:
    """The shortest decimal without exponent and without .0."""
    text = format(Decimal(repr(float(v))), "f")
    return text.removesuffix(".0")


def numeric_key(chrom: Column) -> Column:
    """A chromosome's name as shown in tables: numbers as floats ("1" as "1.0"), other names as they are."""
    number = F.expr(f"try_cast(`{chrom}` as double)") if isinstance(chrom, str) else chrom.try_cast("double")
    text = chrom if isinstance(chrom, Column) else F.col(chrom)
    whole = F.concat(F.format_string("%.0f", F.floor(number).cast("double")), F.lit(".0"))
    return F.when(number.isNull(), text).when((number == F.floor(number)) & (F.abs(number) < 1e15), whole).otherwise(number.cast("string"))


def natural_key(text: Column) -> Column:
    """A key whose order is the natural order: runs of digits by value, then by length; other characters by themselves."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9])"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits(p)).cast("string"), 6, "0"), digits(p), F.lit(" "), F.lpad(F.length(p).cast("string"), 6, "0"))).otherwise(p))


def scientific(x: Column) -> Column:
    """15 significant digits and an exponent of three characters: e-07, e000, e012."""
    text = F.format_string("%.14e", x)
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    return F.concat(F.regexp_extract(text, r"^([^e]*)", 1), F.lit("e"), F.when(power < 0, F.concat(F.lit("-"), F.lpad(F.abs(power).cast("string"), 2, "0"))).otherwise(F.lpad(power.cast("string"), 3, "0")))


def flag(text: Column) -> Column:
    """Whether a text stands for true."""
    return F.coalesce(text.isin("True", "true", "TRUE", "1"), F.lit(False))


def number_or_zero(text: Column, kind: str = "double") -> Column:
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(0).cast(kind))
