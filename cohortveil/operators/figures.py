"""Figures in prose, and whether a released number stands behind them.

A figure says that some number rounds to it, so it stands for an interval: half a unit
of its last decimal, or of its last significant digit, to either side.  It is supported if
a released number lies in that interval.  Figures and numbers are put into one order,
where the first number at or after an interval's beginning decides; nothing is expanded
and no range is compared with every number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scans import following_min
from ..session import cut

# Characters read as a minus, blanks between groups of three digits,
# whole numbers and significance levels that need no support.
MINUS_SIGNS = "\u2010\u2011\u2013\u2212"
GROUP_SPACES = " \u00a0\u202f"
LARGEST_ORDINAL = 12
CONVENTIONAL = (0.05, 0.01, 0.001)
#: Two numbers this close, relative to the larger of one and their size, are the same.
SAME = 1e-9


def _grouped(text: Column) -> Column:
    """Text with the blanks between groups of three digits taken out.

    Words after the first are put back with a blank before them, or without one where three
    digits alone follow a digit.
    """
    words = F.split(text, f"[{GROUP_SPACES}]", -1)
    pairs = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit("")), words).alias("before"))
    joins = lambda p: p["w"].rlike("^[0-9]{3}([^\\p{L}\\p{N}_]|$)") & p["before"].rlike("[0-9]$")
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["w"].isNotNull()),
                                    lambda p: F.concat(F.when(joins(p), "").otherwise(" "), p["w"])), "")


def figures(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every figure in a text, once: key, figure, value, decimals, digits (significant).

    A text is cut at everything but letters, digits and ``_.,+-``, after a sign that
    follows a word and after a comma that follows a fraction; the pieces that read as
    numbers are its figures.
    """
    plain = F.translate(F.col(text), MINUS_SIGNS, "-" * len(MINUS_SIGNS))
    # most texts have no group of three digits after a digit and a blank: those need no list of words
    plain = F.when(plain.rlike(f"[0-9][{GROUP_SPACES}][0-9]{{3}}"), _grouped(plain)).otherwise(plain)
    plain = F.regexp_replace(plain, "([\\p{L}\\p{N}_])[-+]", "$1 ")
    plain = F.regexp_replace(plain, "([.][0-9]+),", "$1 ")
    pieces = F.transform(F.split(plain, "[^\\p{L}\\p{N}_.,+-]+"),
                         lambda p: F.rtrim(F.ltrim(p, F.lit(",")), F.lit(".,")))
    numbers = F.filter(F.array_distinct(pieces), lambda p: p.rlike("^[-+]?[0-9]") & (F.translate(p, "0123456789.,+-", "") == ""))
    number = F.translate("figure", "+,", "")
    significant = F.rtrim(F.ltrim(F.translate(number, "-.", ""), F.lit("0")), F.lit("0"))
    return (texts.select(key, F.explode(numbers).alias("figure"))
            .select(key, "figure", number.try_cast("double").alias("value"),
                    F.length(F.split_part(number, F.lit("."), F.lit(2))).alias("decimals"),
                    F.greatest(F.lit(1), F.length(significant)).alias("digits"))
            .where(F.col("value").isNotNull()))


def interval() -> tuple[Column, Column]:
    """Least and greatest number that rounds to a figure by its decimals or its significant digits."""
    v, size = F.col("value"), F.abs("value")
    decade = F.floor(F.log10(F.when(size > 0, size)))
    unit = F.pow(F.lit(10.0), decade - F.col("digits") + 1)
    place = 0.5 * F.pow(F.lit(10.0), -F.col("decimals"))
    away = F.greatest(place, F.coalesce(unit / 2, place))
    # just under a power of ten a number has one digit less before its point
    toward = F.greatest(place, F.coalesce(F.when(size == F.pow(F.lit(10.0), decade), unit / 20).otherwise(unit / 2), place))
    slack = SAME * F.greatest(F.lit(1.0), size)
    low = v - F.when(v < 0, away).otherwise(toward) - slack
    high = v + F.when(v < 0, toward).otherwise(away) + slack
    return low, high


def released_numbers(*tables: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """Every number in released tables with their keys: values, counts, p-values, and figures in keys."""
    found = None
    for table, keys in tables:
        numeric = [f.name for f in table.schema.fields if isinstance(f.dataType, T.NumericType)]
        named = [f.name for f in table.schema.fields if f.name in keys and isinstance(f.dataType, T.StringType)]
        parts = [table.select(F.explode(F.array(*(F.col(c).cast("double") for c in numeric))).alias("value"))] if numeric else []
        parts += [figures(table.select(F.lit(0).alias("at"), F.col(c).alias("text")), "at").select("value") for c in named]
        for part in parts:
            found = part if found is None else found.unionByName(part)
    return found.where(F.col("value").isNotNull() & ~F.isnan("value")).distinct()


def unsupported_figures(texts: DataFrame, key: str, released: DataFrame, text: str = "text") -> DataFrame:
    """Figures that no released number rounds to: key, figure.

    ``released`` has one column ``value``.  Shares in [0, 1] may be quoted as percentages;
    whole numbers up to twelve and the usual significance levels are always fine.
    """
    x = F.col("value").cast("double")
    numbers = released.select(F.explode(F.array(x, F.when(x.between(0, 1), x * 100))).alias("at")).where(
        "at is not null").distinct()
    said = figures(texts, key, text)
    small = (F.col("value") == F.floor("value")) & F.col("value").between(0, LARGEST_ORDINAL)
    # texts are read for their figures once, not again for the join at the end
    said = cut(said.where(~small & ~F.col("value").isin(*CONVENTIONAL)))
    low, high = interval()
    # few distinct figures recur in many texts: each is decided once
    asked = said.select("value", "decimals", "digits").distinct()
    line = asked.select(low.alias("at"), F.lit(0).alias("is_number"), "value", "decimals", "digits", high.alias("high")).unionByName(
        numbers.select("at", F.lit(1).alias("is_number")), allowMissingColumns=True)
    line = following_min(line, ["at", "is_number"], F.when(F.col("is_number") == 1, F.col("at")), "next")
    without = line.where("is_number = 0").where(~F.coalesce(F.col("next") <= F.col("high"), F.lit(False)))
    return said.join(without.select("value", "decimals", "digits"), ["value", "decimals", "digits"], "left_semi").select(key, "figure")
