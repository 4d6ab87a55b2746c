"""Sessions rebuilt from a verified audit log, without reading sealed parts again.

A log is one or more chains of rows with ids from 0 on, each row's MAC covering its text and
the MAC before it.  A segment is ``size`` rows of a chain.  Once a segment is full it is
sealed: its rows are verified once, what they add to every user's session is written
as state rows, and a mark records its ends, its times and the digest of its state under a
MAC.  A rebuild checks marks and state digests, reads only the rows of segments that are
open or lie across the cutoff, verifies those in parallel and adds them up with the
sealed states.  A chain with any fault gives no state at all.

State rows are (user, kind, name, number): ``units``, ``bits`` and ``records`` add up over
segments; a ``total`` (of a measure) or a ``cohort`` is a fact that is kept once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .canonical import field, table_digest
from .textjobs import keyed_mac

GENESIS = "genesis"
SUMS = ("units", "bits", "records")
ACCOUNTING = ("struct<cost:bigint,selection_bits:bigint,totals:array<struct<measure:string,total:bigint>>,"
              "cohorts:array<struct<view:string,cohort_id:string,quantity:string>>>")


@dataclass(frozen=True)
class Sealed:
    """marks: chain, segment, rows, first_ts, last_ts, first_prev, last_mac, state_digest, seal.
    states: chain, segment, user, kind, name, number."""

    marks: DataFrame
    states: DataFrame


def row_body(prev_mac: Column | None = None) -> Column:
    """Text under a row's MAC: its fields and the MAC before it."""
    return F.concat(*(field(c) for c in (F.col("id").cast("string"), F.col("ts").cast("string"), F.col("user"), F.col("status"),
                                         F.col("accounting"), F.col("prev_mac") if prev_mac is None else prev_mac)))


def state_rows(rows: DataFrame, *by: str) -> DataFrame:
    """by…, user, kind, name, number: what rows add to the sessions of their users."""
    live = rows.where((F.col("status") != "config") & (F.col("user") != "")).withColumn("a", F.from_json("accounting", ACCOUNTING))
    key = [*by, "user"]
    part = lambda kind, name, fact, add: F.struct(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), fact.cast("bigint").alias("fact"), add.cast("bigint").alias("add"))
    none = F.lit(None)
    listed = lambda items, then: F.coalesce(F.transform(items, then), F.array().cast(
        "array<struct<kind:string,name:string,fact:bigint,add:bigint>>"))
    # every part of a row is read from its text once, and sums and facts meet in one grouping
    parts = F.concat(
        F.array(*(part(kind, none, none, add) for kind, add in zip(SUMS, (F.col("a.cost"), F.col("a.selection_bits"), F.lit(1))))),
        listed(F.col("a.totals"), lambda t: part("total", t["measure"], t["total"], none)),
        listed(F.col("a.cohorts"), lambda c: part("cohort", F.to_json(c, {"ignoreNullFields": "false"}), none, none)))
    return live.select(*key, F.inline(parts)).groupBy(*key, "kind", "name", "fact").agg(F.sum("add").alias("add")).select(
        *key, "kind", "name", F.when(F.col("kind").isin(*SUMS), F.coalesce("add", F.lit(0))).otherwise(F.col("fact")).alias("number"))


def merge_states(states: DataFrame, *by: str) -> DataFrame:
    """State rows of several segments as those of one session."""
    key = [*by, "user", "kind", "name"]
    sums = states.where(F.col("kind").isin(*SUMS)).groupBy(*key).agg(F.sum("number").alias("number"))
    return sums.unionByName(states.where(~F.col("kind").isin(*SUMS)).select(*key, "number").distinct())


def _segment(size: int) -> Column:
    return F.floor(F.col("id") / size).cast("bigint")


def _checked(rows: DataFrame, ends: DataFrame | None, key: bytes, size: int) -> DataFrame:
    """chain, id, ts, prev_mac, mac, sound: whether the MAC recomputes and links to the row, or sealed end, before.

    A row's own MAC is recomputed where the row is read, so that texts do not travel.
    """
    own = F.coalesce(F.col("mac") == keyed_mac(row_body(), key), F.lit(False))
    slim = rows.select("chain", "id", "ts", "prev_mac", "mac", own.alias("own"))
    before = rows.select("chain", (F.col("id") + 1).alias("id"), F.col("mac").alias("before"))
    if ends is not None:
        before = before.unionByName(ends.select("chain", ((F.col("segment") + 1) * size).alias("id"), F.col("last_mac").alias("before")))
    before = before.groupBy("chain", "id").agg(F.max("before").alias("before"), F.min("before").alias("least"))
    joined = slim.join(before, ["chain", "id"], "left")
    same = (F.col("before") == F.col("least")) & (F.col("prev_mac") == F.col("before"))
    link = F.when(F.col("id") == 0, F.col("prev_mac") == GENESIS).otherwise(F.coalesce(same, F.lit(False)))
    return joined.withColumn("sound", link & F.col("own")).drop("own", "before", "least")


def _seal(key: bytes) -> Column:
    fields = ("chain", "segment", "rows", "first_ts", "last_ts", "first_prev", "last_mac", "state_digest")
    return keyed_mac(F.concat(*(field(F.col(c).cast("string")) for c in fields)), key)


def seal(log: DataFrame, key: bytes, size: int) -> Sealed:
    """Seal every full segment of a log whose rows are sound; states and ends are written once."""
    rows = _checked(log, None, key, size).withColumn("segment", _segment(size))
    full = cut(rows.groupBy("chain", "segment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("prev_mac", "id").alias("first_prev"), F.max_by("mac", "id").alias("last_mac"),
        F.bool_and("sound").alias("sound")).where((F.col("rows") == size) & F.col("sound")).drop("sound"))
    states = state_rows(log.withColumn("segment", _segment(size)), "chain", "segment")
    states = cut(states.join(full.select("chain", "segment"), ["chain", "segment"], "left_semi"))
    digests = table_digest(states, ("chain", "segment")).select("chain", "segment", F.col("digest").alias("state_digest"))
    marks = full.join(digests, ["chain", "segment"], "left").withColumn("seal", _seal(key))
    return Sealed(marks, states)


def rebuild(log: DataFrame, sealed: Sealed, heads: DataFrame, key: bytes, size: int, cutoff) -> tuple[DataFrame, DataFrame]:
    """(state, verdicts): every user's session since the cutoff, and whether each chain is sound.

    ``heads``: chain, head, the MAC of the last row that is known to have been written.  Log
    rows of sealed segments wholly before or after the cutoff are not read.
    """
    marks = sealed.marks
    link = marks.select("chain", (F.col("segment") + 1).alias("segment"), F.col("last_mac").alias("_end"))
    digests = table_digest(sealed.states, ("chain", "segment")).select("chain", "segment", F.col("digest").alias("_digest"))
    held = marks.join(link, ["chain", "segment"], "left").join(digests, ["chain", "segment"], "left")
    linked = F.when(F.col("segment") == 0, F.col("first_prev") == GENESIS).otherwise(F.coalesce(F.col("first_prev") == F.col("_end"), F.lit(False)))
    held = held.withColumn("sound", linked & (F.col("seal") == _seal(key)) & F.col("state_digest").eqNullSafe(F.col("_digest")))
    across = (F.col("first_ts") < F.lit(cutoff)) & (F.col("last_ts") >= F.lit(cutoff))
    shut = marks.where(~across).select("chain", "segment")

    rows = log.withColumn("segment", _segment(size)).join(shut, ["chain", "segment"], "left_anti")
    # within a sealed segment that is read again, its rows come before its mark's word on the next one
    checked = _checked(rows, marks, key, size).withColumn("segment", _segment(size))
    again = cut(checked.groupBy("chain", "segment").agg(F.count(F.lit(1)).alias("_rows"), F.max_by("mac", "id").alias("_last"),
                                                        F.bool_and("sound").alias("_sound")))
    reread = marks.where(across).select("chain", "segment", "rows", "last_mac").join(again, ["chain", "segment"], "left").select(
        "chain", F.coalesce((F.col("rows") == F.col("_rows")) & (F.col("last_mac") == F.col("_last")), F.lit(False)).alias("sound"))
    ends = rows.select("chain", F.col("mac").alias("head")).unionByName(marks.select("chain", F.col("last_mac").alias("head")))
    present = heads.join(ends.distinct().withColumn("_there", F.lit(True)), ["chain", "head"], "left").select(
        "chain", F.coalesce("_there", F.lit(False)).alias("sound"))
    parts = held.select("chain", "sound").unionByName(again.select("chain", F.col("_sound").alias("sound"))).unionByName(reread).unionByName(present)
    verdicts = parts.groupBy("chain").agg(F.bool_and("sound").alias("sound"))

    whole = marks.where(F.col("first_ts") >= F.lit(cutoff)).select("chain", "segment")
    late = state_rows(rows.where(F.col("ts") >= F.lit(cutoff)), "chain")
    states = sealed.states.join(whole, ["chain", "segment"], "left_semi").drop("segment").unionByName(late)
    trusted = states.join(verdicts.where("sound").select("chain"), "chain", "left_semi")
    return merge_states(trusted), verdicts
