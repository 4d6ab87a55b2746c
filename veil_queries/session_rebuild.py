"""Sessions rebuilt from sealed and open parts of audit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortveil.operators import sessions as S
from cohortveil.operators.textjobs import keyed_mac
from cohortveil.session import cut
from cohortveil.studies import shop

from .registry import query

KEY, SIZE, CUTOFF = b"session key of the example study", 64, "2024-01-15 00:00:00"
#: Chains whose log, states or marks are tampered with after sealing.
EDITED, FORGED, MOVED, SHORTENED, BEHEADED = 1, 2, 3, 4, 5


def audit_log(spark, d):
    """A chain per thousand events; a row's accounting is JSON text under its MAC."""
    events = spark.read.schema(shop.SCHEMAS["events"]).parquet(f"{d}/events.parquet")
    accounting = F.to_json(F.struct(
        (F.col("event_id") % 3 + 1).alias("cost"), (F.col("event_id") % 2).alias("selection_bits"),
        F.array(F.struct(F.col("event_type").alias("measure"), (F.col("event_id") % 7).alias("total"))).alias("totals"),
        F.array(F.struct(F.lit("clicks").alias("view"), F.col("event_type").alias("cohort_id"),
                         F.when(F.col("event_id") % 2 == 0, "amount").alias("quantity"))).alias("cohorts")))
    rows = events.select(
        F.floor(F.col("event_id") / 1000).alias("chain"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("a"), (F.col("user_id") % 30).cast("string")).alias("user"),
        F.when(F.col("event_type") == "error", "config").otherwise("released").alias("status"), accounting.alias("accounting"))
    # a chain holds a thousand rows at most: MACs are folded in their order, and rows meet theirs afterwards
    listed = rows.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "user", "status", "accounting"))).alias("r"))

    # MACs so far as one binary: a list would be copied text by text at every step
    mac_of = lambda macs, k: F.when(k == 0, S.GENESIS).otherwise(F.substring(macs, (k - 1) * 64 + 1, F.lit(64)).cast("string"))

    def step(macs, r):
        place = F.floor(F.octet_length(macs) / 64).cast("int")
        body = F.concat(*(S.field(c) for c in (place.cast("string"), r["ts"].cast("string"), r["user"], r["status"], r["accounting"],
                                               mac_of(macs, place))))
        return F.concat(macs, keyed_mac(body, KEY).cast("binary"))

    folded = listed.withColumn("macs", F.aggregate("r", F.lit(b""), step))
    return folded.select("chain", F.inline(F.transform("r", lambda r, i: F.struct(
        i.cast("bigint").alias("id"), r["ts"].alias("ts"), r["user"].alias("user"), r["status"].alias("status"),
        r["accounting"].alias("accounting"), mac_of(F.col("macs"), i).alias("prev_mac"), mac_of(F.col("macs"), i + 1).alias("mac")))))


def tampered(spark, d):
    """The log, its sealed part and its heads, after five chains were tampered with and old rows were dropped."""
    log = cut(audit_log(spark, d))
    heads = log.groupBy("chain").agg(F.max_by("mac", "id").alias("head"))
    sealed = S.seal(log, KEY, SIZE)
    marks, states = cut(sealed.marks), sealed.states
    chain = F.col("chain")
    ends = log.groupBy("chain").agg(F.max("id").alias("_last"))
    held = log.join(ends, "chain")
    lowered = F.when((chain == EDITED) & (F.col("id") == F.col("_last")), F.regexp_replace("accounting", '"cost":[0-9]+', '"cost":0'))
    held = held.withColumn("accounting", F.coalesce(lowered, "accounting"))
    # a row of the segment across the cutoff goes missing; elsewhere the newest row does
    crossing = marks.where((F.col("first_ts") < F.lit(CUTOFF)) & (F.col("last_ts") >= F.lit(CUTOFF))).select(
        chain.alias("_c"), (F.col("segment") * SIZE + 3).alias("_gone")).where(F.col("_c") == SHORTENED)
    held = held.join(crossing, (chain == F.col("_c")) & (F.col("id") == F.col("_gone")), "left_anti")
    held = held.where(~((chain == BEHEADED) & (F.col("id") == F.col("_last")))).drop("_last")
    # rows of sealed segments far from the cutoff may be archived
    shut = marks.where(F.col("last_ts") < F.lit(CUTOFF)).select("chain", "segment")
    held = cut(held.withColumn("segment", F.floor(F.col("id") / SIZE)).join(shut, ["chain", "segment"], "left_anti").drop("segment"))
    states = states.withColumn("number", F.when((chain == FORGED) & (F.col("kind") == "units"), 0).otherwise(F.col("number")))
    marks = marks.withColumn("last_ts", F.when(chain == MOVED, F.col("last_ts") + F.expr("interval 1 day")).otherwise(F.col("last_ts")))
    return held, S.Sealed(marks, states), heads


_EVENTS = f"""e AS (SELECT event_id // 1000 AS chain, event_id, event_type, 'a' || CAST(user_id % 30 AS VARCHAR) AS "user", ts,
  row_number() OVER (PARTITION BY event_id // 1000 ORDER BY ts, event_id) - 1 AS id FROM events),
seg AS (SELECT chain, id // {SIZE} AS segment, COUNT(*) AS k, MIN(ts) AS lo, MAX(ts) AS hi FROM e GROUP BY ALL),
bad AS (SELECT {EDITED} AS chain UNION SELECT chain FROM seg WHERE k = {SIZE} AND chain IN ({FORGED}, {MOVED})
  UNION SELECT chain FROM seg WHERE k = {SIZE} AND chain = {SHORTENED} AND lo < TIMESTAMP '{CUTOFF}' AND hi >= TIMESTAMP '{CUTOFF}'
  UNION SELECT {BEHEADED})"""


@query("D12_verified_rebuild", f"""WITH {_EVENTS}, live AS (SELECT * FROM e WHERE event_type <> 'error' AND ts >= TIMESTAMP '{CUTOFF}' AND chain NOT IN (SELECT chain FROM bad)),
sums AS (SELECT "user", SUM(1 + event_id % 3) AS units, SUM(event_id % 2) AS bits, COUNT(*) AS records FROM live GROUP BY 1)
SELECT "user", 'units' AS kind, NULL AS name, CAST(units AS BIGINT) AS number FROM sums UNION ALL SELECT "user", 'bits', NULL, CAST(bits AS BIGINT) FROM sums
UNION ALL SELECT "user", 'records', NULL, records FROM sums
UNION ALL SELECT DISTINCT "user", 'total', event_type, event_id % 7 FROM live
UNION ALL SELECT DISTINCT "user", 'cohort', '{{"view":"clicks","cohort_id":"' || event_type || '","quantity":' || CASE WHEN event_id % 2 = 0 THEN '"amount"' ELSE 'null' END || '}}', NULL FROM live""")
def d12_rebuild(spark, d):
    """Units, bits, totals and cohorts of every user since a cutoff, from sealed states and the rows that have to be read;
    chains with an edited row, a forged state, a moved mark, a lost row or a lost end give nothing."""
    log, sealed, heads = tampered(spark, d)
    return S.rebuild(log, sealed, heads, KEY, SIZE, CUTOFF)[0]


@query("D12_chain_verdicts", f"""WITH {_EVENTS} SELECT DISTINCT chain, chain NOT IN (SELECT chain FROM bad) AS sound FROM e""")
def d12_verdicts(spark, d):
    log, sealed, heads = tampered(spark, d)
    return S.rebuild(log, sealed, heads, KEY, SIZE, CUTOFF)[1]
