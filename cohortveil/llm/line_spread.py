"""Cross-site boilerplate removal by the spread of lines over sites.

A line that stands on many distinct sites is boilerplate.  Sites per line are
counted with HyperLogLog sketches that merge by aggregation; lines whose estimate
is near the threshold get an exact distinct count.  A boilerplate line stays once,
where it comes first (least document id, then the hash of the text, then line number);
elsewhere it goes.

DataFrame functions only.  Sketches and minima combine before the shuffle, so a
line that stands in a third of all documents is one row per task; where lines meet what
was found out about them, they are dealt over ``SALT`` tasks each.

Edge cases: lines are compared without blanks at their ends; blank lines are never
boilerplate.  A null site is a site of its own.  A null text stays null, an empty
one empty.  Ids are of any type; null ids come last in the order, told apart by their texts.
Rows equal in id and text keep or lose the same lines.  Repeats of a line inside one document all go, but for the first place.
All columns of the documents are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Distinct sites from which a line is boilerplate.
LEAST_SITES = 10
#: log2 of a sketch's registers, and the band around the threshold, in standard
#: errors of the sketch, inside which lines are counted exactly.
SKETCH_BITS, BAND_ERRORS = 11, 5.0
_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
#: Parts of a line in joins; what is joined to it stands there as often.
SALT = 8


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(id, body, site, place, line): non-blank lines by hash; ``body`` is the hash of the whole text."""
    rows = documents.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("place", "text"))
    line = F.btrim("text", F.lit(" \t\r"))
    return rows.where(line != "").select("id", "body", "site", "place", F.xxhash64(line).alias("line"))


def _first() -> Column:
    """Order of the places of a line."""
    return F.struct(F.col("id").isNull().alias("late"), "id", "body", "place")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("body", "place"), F.lit(SALT)))


def _everywhere(few: DataFrame) -> DataFrame:
    return few.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))


def boilerplate(found: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """(line, keep) for lines on at least ``least_sites`` sites; ``keep`` is the place that stays."""
    spread = found.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"),
                                       F.min(_first()).alias("keep"))
    band = least_sites * _ERROR * BAND_ERRORS + 1
    spread = cut(spread.select("line", "keep", F.hll_sketch_estimate("sketch").alias("sites"))
                 .where(F.col("sites") >= least_sites - band))
    near = spread.where(F.col("sites") <= least_sites + band).select("line")
    exact = (_dealt(found).join(_everywhere(near), ["line", "part"], "left_semi").select("line", "site").distinct()
             .groupBy("line").agg(F.count("*").alias("exact")))
    return (spread.join(exact, "line", "left").where(F.coalesce("exact", "sites") >= least_sites)
            .select("line", "keep"))


def clean(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
          least_sites: int = LEAST_SITES, removed_col: str | None = None) -> DataFrame:
    """The documents with boilerplate lines removed from ``text_col``.

    ``removed_col`` names a further column for the number of removed lines.
    """
    found = cut(lines(documents, id_col, text_col, site_col))
    marks = boilerplate(found, least_sites)
    drops = (_dealt(found).join(_everywhere(marks), ["line", "part"]).where(~_first().eqNullSafe(F.col("keep"))).groupBy("id", "body")
             .agg(F.collect_set("place").alias("drop")))
    names = documents.columns
    left = documents.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    at = {c: f"in_{i}" for i, c in enumerate(names)}
    body = F.xxhash64(at[text_col])
    joined = left.join(drops, left[at[id_col]].eqNullSafe(drops.id) & (body == drops.body), "left")
    kept = F.array_join(F.filter(F.split(at[text_col], "\n", -1), lambda _, i: ~F.array_contains("drop", i)), "\n")
    out = joined.withColumn("kept", F.when(F.col("drop").isNull(), F.col(at[text_col])).otherwise(kept))
    columns = [F.col("kept" if c == text_col else at[c]).alias(c) for c in names]
    if removed_col:
        columns.append(F.coalesce(F.size("drop"), F.lit(0)).alias(removed_col))
    return out.select(*columns)
