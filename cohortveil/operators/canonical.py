"""One text form of values, rows and tables, and digests over it.

A field is its length, a colon and its text, or ``~`` if it is null, so that no two
different rows share a text.  Numbers are written as sign, digits without zeros at
either end, ``e`` and exponent: 45.20 and 45.2 are ``452e-1``, 10200 is ``102e2``.  Every
step is plain text work that any SQL engine can repeat.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_number(c: Column) -> Column:
    """A number of any type as sign, digits and exponent; ``nan``, ``inf`` or ``-inf`` where it is none."""
    text = c.cast("string")
    mantissa = F.split_part(F.ltrim(text, F.lit("-")), F.lit("E"), F.lit(1))
    power = F.coalesce(F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
    exponent = power - F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))
    digits = F.ltrim(F.translate(mantissa, ".", ""), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    written = F.concat(sign, short, F.lit("e"), (exponent + F.length(digits) - F.length(short)).cast("string"))
    return (F.when(text == "NaN", "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
            .when(digits == "", "0e0").otherwise(written))


#: Digits of a decimal that fits into a long.
LONG_DIGITS = 18


def _long_decimal(c: Column, kind: T.DecimalType) -> Column:
    """:func:`canonical_number` of a decimal of few digits, by whole numbers instead of text."""
    whole = (c * F.lit(Decimal(10 ** kind.scale))).cast("bigint")
    zeros = reduce(lambda a, b: a + b, ((whole % F.lit(10 ** k) == 0).cast("int") for k in range(1, kind.precision + 1)))
    power = F.get(F.array(*(F.lit(10 ** k).cast("bigint") for k in range(kind.precision + 1))), zeros)
    exponent = (zeros - kind.scale) * (whole != 0).cast("int")
    return F.concat(F.call_function("div", whole, power).cast("string"), F.lit("e"), exponent.cast("string"))


def decimals(c: Column) -> Column:
    """Places after the point that a number needs."""
    exponent = F.split_part(canonical_number(c), F.lit("e"), F.lit(2)).try_cast("int")
    return F.greatest(F.lit(0), -F.coalesce(exponent, F.lit(0)))


def value_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType) and 0 <= kind.scale <= kind.precision <= LONG_DIGITS:
        return _long_decimal(c, kind)
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        return canonical_number(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def field(text: Column) -> Column:
    """Text with its length before it, or ``~``."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def row_text(df: DataFrame, columns) -> Column:
    """Names and values of a row's columns, in the order of their names."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat(*(part for c in sorted(columns)
                      for part in (F.lit(f"{len(c)}:{c}"), field(value_text(F.col(f"`{c}`"), kinds[c])))))


def table_digest(df: DataFrame, group=()) -> DataFrame:
    """Order-free content digest of a table of any size, optionally per group.

    SHA-256 digests of the rows are added up in four 60-bit parts: duplicates count,
    order does not, and nothing is collected.
    """
    columns = [c for c in df.columns if c not in group]
    part = lambda i: F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("bigint")
    # each part adds up as two longs of 30 bits, which hold 2^33 rows
    halves = [s for i in range(4) for s in (F.sum(F.shiftright(part(i), 30)).alias(f"_h{i}"),
                                            F.sum(part(i).bitwiseAND(F.lit((1 << 30) - 1))).alias(f"_l{i}"))]
    total = lambda i: (F.col(f"_h{i}").cast("decimal(20,0)") * F.lit(1 << 30) + F.col(f"_l{i}")).cast("decimal(30,0)")
    digest = F.sha2(row_text(df, columns), 256) if columns else F.sha2(F.lit(""), 256)
    out = df.withColumn("_d", digest).groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *halves)
    text = F.concat_ws("|", F.col("rows").cast("string"), *(
        F.coalesce(total(i), F.lit(0)).cast("string") for i in range(4)))
    return out.select(*group, "rows", F.sha2(text, 256).alias("digest"))
