"""Text jobs, release audits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortveil.functions.stats import adjust_p_values
from cohortveil.operators import cells as C
from cohortveil.operators import gateway as G
from cohortveil.operators import release_audit as O
from cohortveil.operators import textjobs as T
from cohortveil.operators.figures import released_numbers, unsupported_figures
from cohortveil.plans.staged import Plan, Stage, run_batch, run_plan
from cohortveil.session import cut
from cohortveil.specs import Filter, Measure, QuerySpec
from cohortveil.studies import shop
from cohortveil.study import Policy

from .gateway_checks import POLICY, SUM_CELLS, infinite, whale
from .registry import query
from .sqltext import CUSTOMER_SALES, SALES, canon, cells, complementary, digest_of, field, half_up, ring

MEAN_REGION = QuerySpec("sales", Measure("mean", "o_totalprice"), ("r_name",))
# Endings that turn conversation turns into requests.
ENDINGS = ("mean order price by region", "show raw row data per donor", "total orders", "count of orders by month",
           "verbatim comments", "region map", "list each participant", "trend of order value over time")


def read(spark, d, name):
    return spark.read.schema(shop.SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


def requests(spark, d):
    """Conversation turns, each ending in one of a few fixed phrases."""
    turns = read(spark, d, "conversations")
    ending = F.element_at(F.array(*(F.lit(e) for e in ENDINGS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)) + 1).cast("int"))
    return turns.select("conv_id", "turn", F.concat_ws(" ", "text", ending).alias("text"))


CUES = ("order", "region")
_ending_sql = "CASE (conv_id + turn) % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS)) + " END"
REQUESTS_SQL = f"requests AS (SELECT conv_id, turn, ' ' || lower(text || ' ' || {_ending_sql}) || ' ' AS low FROM conversations)"


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _first_sql(phrases) -> str:
    return "CASE " + " ".join(f"WHEN contains(low, {_quoted(p)}) THEN {_quoted(p)}" for p in phrases) + " END"


def _some_sql(phrases) -> str:
    return "(" + " OR ".join(f"contains(low, {_quoted(p)})" for p in phrases) + ")"


@query("T1_screened_requests", f"""WITH {REQUESTS_SQL}, h AS (SELECT conv_id, turn, {_first_sql(T.BLOCKED_PHRASES)} AS b,
 {_first_sql(T.BLOCKED_TEXT_PHRASES)} AS t, {_some_sql(T.ANALYSIS_CUES)} AND {_some_sql(CUES)} AS s FROM requests)
SELECT conv_id, turn, CASE WHEN b IS NOT NULL THEN 'blocked' WHEN t IS NOT NULL THEN 'free_text' WHEN s THEN 'ok'
 ELSE 'out_of_scope' END AS verdict, coalesce(b, t) AS phrase FROM h""")
def t1(spark, d):
    return T.screen_requests(requests(spark, d), CUES).drop("text")


SYNONYMS = shop.study().synonyms


def _dims_sql(synonyms: dict[str, str]) -> str:
    """The same blanking of longer terms first, for ASCII text."""
    steps, rest = [], "low0"
    edge, end = "(^|[^a-z0-9_])", "($|[^a-z0-9_])"
    order = sorted(synonyms, key=len, reverse=True)
    for i, term in enumerate(order):
        pattern = f"{edge}{term}(s|es)?{end}"
        blank = rest
        for _ in range(2):        # neighbours share the character between them
            blank = f"regexp_replace({blank}, '{pattern}', '\\1#\\3', 'g')"
        steps.append(f"s{i} AS (SELECT *, CASE WHEN regexp_matches({rest}, '{pattern}') THEN '{synonyms[term]}' END AS f{i}, "
                     f"{blank} AS low{i + 1} FROM {'r0' if i == 0 else f's{i - 1}'})")
        rest = f"low{i + 1}"
    found = ", ".join(f"f{i}" for i in range(len(order)))
    return (f"r0 AS (SELECT conv_id, turn, trim(low) AS low0 FROM requests), {', '.join(steps)} "
            f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct([{found}])), ',') AS dims FROM s{len(order) - 1}")


@query("T2_dimensions_named", f"WITH {REQUESTS_SQL}, {_dims_sql(shop.study().synonyms)}")
def t2(spark, d):
    return T.dimensions_named(requests(spark, d), SYNONYMS).select("conv_id", "turn", F.array_join("dims", ",").alias("dims"))


@query("T2_dimensions_named_in_documents")
def t2_docs(spark, d):
    """The same over whole documents with a vocabulary of common words of their prose."""
    words = {"the": "article", "the other": "contrast", "hand": "body", "hands": "body", "en": "particle", "over": "place"}
    return T.dimensions_named(read(spark, d, "documents"), words).select("doc_id", "dims")


def released_values(spark, d):
    out = G.release(shop.workspace(spark, d), QuerySpec("sales", Measure("mean", "o_totalprice"), ("n_name",)))
    return out.released


_SPACES = "[ \u00a0\u202f]"
_WORD = "\\p{L}\\p{N}_"
YEAR_CELLS = cells("sales", "order_year", "o_totalprice", name="years")

FIGURES_SQL = f"""words AS (
  SELECT doc_id, string_split_regex(translate(text, '\u2010\u2011\u2013\u2212', '----'), '{_SPACES}') AS w FROM documents),
joined AS (
  SELECT doc_id, array_to_string([CASE WHEN i > 1 AND regexp_matches(w[i], '^[0-9]{{3}}([^{_WORD}]|$)') AND regexp_matches(w[i - 1], '[0-9]$')
    THEN '' ELSE ' ' END || w[i] FOR i IN range(1, len(w) + 1)], '') AS text FROM words),
pieces AS (
  SELECT doc_id, unnest(list_distinct([rtrim(ltrim(p, ','), '.,') FOR p IN string_split_regex(regexp_replace(regexp_replace(text,
    '([{_WORD}])[-+]', '\\1 ', 'g'), '([.][0-9]+),', '\\1 ', 'g'), '[^{_WORD}.,+-]+')])) AS figure FROM joined),
numbers AS (
  SELECT doc_id, figure, translate(figure, '+,', '') AS txt FROM pieces
  WHERE regexp_matches(figure, '^[-+]?[0-9]') AND translate(figure, '0123456789.,+-', '') = ''),
said AS (
  SELECT *, TRY_CAST(txt AS DOUBLE) AS v, length(split_part(txt, '.', 2)) AS places,
    greatest(1, length(rtrim(ltrim(translate(txt, '-.', ''), '0'), '0'))) AS digits FROM numbers WHERE TRY_CAST(txt AS DOUBLE) IS NOT NULL),
asked AS (SELECT DISTINCT v, places, digits, abs(v) AS size, floor(log10(CASE WHEN v <> 0 THEN abs(v) END)) AS decade FROM said
  WHERE NOT (v = floor(v) AND v BETWEEN 0 AND 12) AND v NOT IN (0.05, 0.01, 0.001)),
spans AS (SELECT *, 0.5 * pow(10.0, -places) AS half, pow(10.0, decade - digits + 1) AS unit FROM asked),
sides AS (SELECT *, greatest(half, coalesce(unit / 2, half)) AS away, greatest(half, coalesce(CASE WHEN size = pow(10.0, decade) THEN unit / 20
  ELSE unit / 2 END, half)) AS toward, 1e-9 * greatest(1.0, size) AS slack FROM spans),
ranges AS (SELECT v, places, digits, v - CASE WHEN v < 0 THEN away ELSE toward END - slack AS low,
  v + CASE WHEN v < 0 THEN toward ELSE away END + slack AS high FROM sides)"""


def released_tables(spark, d):
    """Means by nation and sums by year, as released, with their keys."""
    ws = shop.workspace(spark, d)
    years = G.release(ws, QuerySpec("sales", Measure("sum", "o_totalprice"), ("order_year",))).released
    return (released_values(spark, d), ("n_name",)), (years, ("order_year",))


@query("T4_unsupported_figures", f"""WITH {SALES}, {cells('sales', 'n_name', 'o_totalprice', value='mean')}, {YEAR_CELLS}, {FIGURES_SQL},
known AS (SELECT CAST(value AS DOUBLE) AS x FROM cells UNION SELECT CAST({ring('n')} AS DOUBLE) FROM cells
  UNION SELECT CAST(round(value, 2) AS DOUBLE) FROM years UNION SELECT CAST({ring('n')} AS DOUBLE) FROM years UNION SELECT CAST(order_year AS DOUBLE) FROM years),
held AS (SELECT x FROM known WHERE x IS NOT NULL UNION SELECT x * 100 FROM known WHERE x BETWEEN 0 AND 1)
SELECT doc_id, figure FROM said JOIN ranges USING (v, places, digits)
WHERE NOT EXISTS (SELECT 1 FROM held WHERE x BETWEEN low AND high)""")
def t4(spark, d):
    """Figures of every document against values, counts and keys of two released tables."""
    return unsupported_figures(read(spark, d, "documents"), "doc_id", released_numbers(*released_tables(spark, d)))


@query("T5_grounded_claims", """WITH steps AS (SELECT event_id AS step FROM events WHERE event_type IN ('view', 'click')),
claims AS (SELECT conv_id * 1000 + turn AS claim_id, CASE WHEN turn % 5 = 0 THEN 'not_answerable' ELSE 'supported' END AS verdict,
 conv_id AS a, conv_id * 3 + turn AS b FROM conversations)
SELECT claim_id, CASE WHEN a IN (SELECT step FROM steps) OR b IN (SELECT step FROM steps) THEN verdict ELSE 'not_answerable' END AS verdict FROM claims""")
def t5(spark, d):
    claims = read(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"),
        F.when(F.col("turn") % 5 == 0, "not_answerable").otherwise("supported").alias("verdict"),
        F.array(F.col("conv_id"), F.col("conv_id") * 3 + F.col("turn")).alias("evidence"))
    steps = read(spark, d, "events").select(
        F.col("event_id").alias("step"),
        F.when(F.col("event_type").isin("view", "click"), "released").otherwise("denied").alias("status"))
    return T.ground_claims(claims, steps).select("claim_id", "verdict")


REGION_CELLS = cells("sales", "r_name", "o_totalprice", value="mean")
_EVIDENCE = " || ".join(field(x) for x in ("'group_statistic'", "'s1'", "'mean'", "'6:r_name' || " + field("r_name"), "name", "txt",
                                           "CAST(prec AS VARCHAR)", "CAST(NULL AS VARCHAR)"))


@query("T6_evidence", f"""WITH {SALES}, {REGION_CELLS}, r AS (SELECT r_name, CAST(value AS DOUBLE) AS value, CAST({ring('n')} AS DOUBLE) AS n FROM cells),
l AS (SELECT r_name, 'value' AS name, value AS v FROM r UNION ALL SELECT r_name, 'n', n FROM r),
p AS (SELECT *, {canon('v')} AS txt FROM l),
q AS (SELECT *, greatest(0, -CAST(split_part(txt, 'e', 2) AS INTEGER)) AS prec FROM p)
SELECT 'ev-' || substr(sha256({_EVIDENCE}), 1, 16) AS evidence_id, r_name, name, v AS value, CAST(prec AS INTEGER) AS precision FROM q""")
def t6(spark, d):
    out = G.release(shop.workspace(spark, d), MEAN_REGION).released
    items = T.evidence(out, "s1", "mean", ("r_name",), ("value", "n"), measure="o_totalprice")
    return items.select("evidence_id", F.col("keys")["r_name"].alias("r_name"), "name", "value", "precision")


_SALES_TEXT = {"c_mktsegment": "c_mktsegment", "is_urgent": "CAST(is_urgent AS VARCHAR)", "n_name": "n_name", "o_orderpriority": "o_orderpriority",
              "o_orderstatus": "o_orderstatus", "o_totalprice": canon("o_totalprice"), "order_month": "CAST(order_month AS VARCHAR)",
              "order_year": "CAST(order_year AS VARCHAR)"}


@query("T7_table_digests", f"WITH {SALES} {digest_of('sales', _SALES_TEXT, 'r_name')}")
def t7(spark, d):
    return T.table_digest(shop.workspace(spark, d).public("sales"), ("r_name",))


_text = lambda *names: {n: f"CAST({n} AS VARCHAR)" for n in names}
_money = lambda *names: {n: canon(f"CAST({n} AS DECIMAL(12,2))") for n in names}
_TABLE_TEXTS = {
    "orders": {**_text("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), **_money("o_totalprice"),
               "order_year": "CAST(year(o_orderdate) AS VARCHAR)", "order_month": "CAST(month(o_orderdate) AS VARCHAR)",
               "is_urgent": "CAST(o_orderpriority = '1-URGENT' AS VARCHAR)"},
    "customer": {**_text("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), **_money("c_acctbal"),
                 "balance": "CAST(CAST(floor(c_acctbal) AS INTEGER) AS VARCHAR)"},
    "nation": _text("n_nationkey", "n_name", "n_regionkey"),
    "region": _text("r_regionkey", "r_name"),
    "lineitem": {**_text("l_orderkey", "l_returnflag", "l_linestatus"), **_money("l_quantity", "l_extendedprice", "l_discount"),
                 "ship_year": "CAST(year(l_shipdate) AS VARCHAR)"},
    "events": {**_text("event_id", "user_id", "event_type", "props"), **_money("value"),
               "hour_band": "CAST(CAST(floor(hour(ts) / 6) AS INTEGER) AS VARCHAR)",
               "day": "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS VARCHAR)"},
}


@query("T8_snapshot_manifest", " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", rows, '{','.join(sorted(columns))}' AS columns, digest FROM ({digest_of(name, columns)})"
    for name, columns in _TABLE_TEXTS.items()))
def t8(spark, d):
    manifest = T.snapshot_manifest({n: shop.workspace(spark, d).tables[n] for n in shop.TABLES})
    return manifest.withColumn("columns", F.array_join("columns", ","))


@query("T8_snapshot_shape", """SELECT 'orders' AS "table", COUNT(*) AS rows, 8 AS n_columns FROM orders UNION ALL SELECT 'customer', COUNT(*), 6 FROM customer
UNION ALL SELECT 'nation', COUNT(*), 3 FROM nation UNION ALL SELECT 'region', COUNT(*), 2 FROM region
UNION ALL SELECT 'lineitem', COUNT(*), 7 FROM lineitem UNION ALL SELECT 'events', COUNT(*), 7 FROM events""")
def t8_shape(spark, d):
    return t8(spark, d).select("table", "rows", F.size(F.split("columns", ",")).alias("n_columns"))


KEY = b"audit key of the example study"


def _mac_sql(text: str) -> str:
    """HMAC-SHA-256 in SQL: the key padded to a block, once per direction."""
    pad = lambda b: "unhex('" + bytes(x ^ b for x in KEY.ljust(64, b"\0")).hex() + "')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({text}))))"


@query("T9_keyed_macs", f"SELECT event_id, {_mac_sql('props')} AS mac FROM events")
def t9(spark, d):
    return read(spark, d, "events").select("event_id", T.keyed_mac(F.col("props"), KEY).alias("mac"))


CHAIN = ("user_id", "day", "block")


def chain_keys():
    return (F.col("user_id"), F.to_date("ts").alias("day"), F.floor(F.col("event_id") / 1000).alias("block"))


def audit_chains(spark, d):
    """A keyed chain per user, day and block of a thousand event ids, with some
    rows altered and some removed.  A chain holds a thousand rows at most."""
    events = read(spark, d, "events").select(
        *chain_keys(), "event_id", "event_type", F.col("value").cast("string").alias("body"))
    rows = events.groupBy(*CHAIN).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "body"))).alias("r"))
    start = F.struct(F.lit("genesis").alias("mac"), F.array().cast(
        "array<struct<id:bigint,event_id:bigint,body:string,prev_mac:string,mac:string>>").alias("out"))

    def step(s, r):
        body = F.concat_ws("|", r["event_type"], r["body"])
        mac = T.keyed_mac(F.concat_ws("|", body, s["mac"]), KEY)
        row = F.struct(F.size(s["out"]).cast("bigint").alias("id"), r["event_id"].alias("event_id"),
                       body.alias("body"), s["mac"].alias("prev_mac"), mac.alias("mac"))
        return F.struct(mac.alias("mac"), F.array_append(s["out"], row).alias("out"))

    chained = rows.select(*CHAIN, F.inline(F.aggregate("r", start, step)["out"]))
    altered = F.when(F.col("event_id") % 50 == 0, F.concat("body", F.lit("0"))).otherwise(F.col("body"))
    return chained.where(F.col("event_id") % 77 != 0).withColumn("body", altered)


@query("T10_verified_chain", """WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id // 1000 AS block, event_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_id // 1000 ORDER BY event_id) - 1 AS id FROM events),
k AS (SELECT * FROM o WHERE event_id % 77 <> 0)
SELECT k.user_id, k.day, k.block, k.id, k.event_id % 50 <> 0 AS mac_ok, k.id = 0 OR p.id IS NOT NULL AS link_ok
FROM k LEFT JOIN k p ON p.user_id = k.user_id AND p.day = k.day AND p.block = k.block AND p.id = k.id - 1""")
def t10(spark, d):
    rows = cut(audit_chains(spark, d))
    body = F.concat_ws("|", "body", "prev_mac")
    return T.verify_chain(rows, body, KEY, chain=CHAIN)


@query("T10_chain_verdicts", """WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id // 1000 AS block, event_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_id // 1000 ORDER BY event_id) - 1 AS id FROM events),
k AS (SELECT * FROM o WHERE event_id % 77 <> 0),
c AS (SELECT k.user_id, k.day, k.block, bool_and(k.event_id % 50 <> 0 AND (k.id = 0 OR p.id IS NOT NULL)) AS ok
 FROM k LEFT JOIN k p ON p.user_id = k.user_id AND p.day = k.day AND p.block = k.block AND p.id = k.id - 1 GROUP BY ALL),
m AS (SELECT user_id, day, block, arg_max(event_id, id) AS e FROM o GROUP BY ALL)
SELECT c.user_id, c.day, c.block, c.ok AND m.e % 77 <> 0 AS intact FROM c JOIN m ON c.user_id = m.user_id AND c.day = m.day AND c.block = m.block""")
def t10_verdict(spark, d):
    rows = cut(audit_chains(spark, d))
    full = read(spark, d, "events").groupBy(*chain_keys()).agg(F.max("event_id").alias("event_id"))
    last = rows.select(*CHAIN, "event_id", "mac")
    marks = full.join(last, [*CHAIN, "event_id"], "left").select(
        *CHAIN, F.coalesce("mac", F.lit("lost")).alias("mark"))
    checked = T.verify_chain(rows, F.concat_ws("|", "body", "prev_mac"), KEY, chain=CHAIN)
    return T.chain_verdict(checked, rows, marks, CHAIN)


# some orders of the snapshot changed after the releases were recorded
_CHANGED = "CASE WHEN person % 300 = 3 THEN o_totalprice + 1 ELSE o_totalprice END"
_OWN_CELLS = """SELECT n_name, o_orderstatus, SUM({x}) AS v, COUNT(*) AS k FROM sales GROUP BY ALL"""


def _replayed(spark, d):
    spec = QuerySpec("sales", Measure("sum", "o_totalprice"), ("n_name", "o_orderstatus"))
    changed = lambda t: t.withColumn("o_totalprice", F.when(
        F.col("o_custkey") % 300 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(12,2)"))
    then, now = ({}, {"orders": changed})
    return [C.cells(shop.workspace(spark, d, **tables), spec).select("n_name", "o_orderstatus", F.col("value").cast("double").alias("value"), "n")
            for tables in (then, now)]


@query("T11_replay_compare", f"""WITH {SALES}, a AS ({_OWN_CELLS.format(x='o_totalprice')}), b AS ({_OWN_CELLS.format(x=_CHANGED)})
SELECT a.n_name, bool_and(a.v = b.v AND a.k = b.k) AS reproduced FROM a JOIN b ON a.n_name = b.n_name AND a.o_orderstatus = b.o_orderstatus GROUP BY a.n_name""")
def t11(spark, d):
    """Digests of every nation's cells, recomputed whole after some orders changed."""
    before, after = (T.table_digest(t, ("n_name",)) for t in _replayed(spark, d))
    return T.replay_compare(before, after, ("n_name",)).select("n_name", "reproduced")


@query("T11_replay_releases", f"""WITH {SALES}, a AS ({_OWN_CELLS.format(x='o_totalprice')}), b AS ({_OWN_CELLS.format(x=_CHANGED)})
SELECT a.n_name, CASE WHEN a.n_name IN ('NATION_2', 'NATION_9') THEN 'refused' WHEN bool_and(a.v = b.v) THEN 'reproduced' ELSE 'digest_differs' END AS status,
  CASE WHEN a.n_name NOT IN ('NATION_2', 'NATION_9') THEN CAST(SUM(CASE WHEN a.v <> b.v THEN 1 ELSE 0 END) AS INTEGER) END AS lost_evidence
FROM a JOIN b ON a.n_name = b.n_name AND a.o_orderstatus = b.o_orderstatus GROUP BY a.n_name""")
def t11_releases(spark, d):
    """Every nation's release replayed: digests, evidence ids and the semantics it was recorded under."""
    before, after = _replayed(spark, d)
    record = lambda t, semantics: T.release_record(t, ("n_name",), ("value", "n"), "s1", "sum", semantics)
    old = F.col("n_name").isin("NATION_2", "NATION_9")
    committed = record(before.where(old), "1").unionByName(record(before.where(~old), "2"))
    return T.replay_releases(committed, record(after, "2"), ("n_name",))


def plan_log(spark, d):
    """Runs are customers; their orders are log rows and the first urgent one commits the plan."""
    orders = read(spark, d, "orders")
    return orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"),
                         F.col("o_orderpriority").alias("request"),
                         F.when(F.col("o_orderpriority") == "1-URGENT", "plan").when(
                             F.col("o_orderstatus") == "F", "released").otherwise("denied").alias("status"))


STAGE_LIST = (("2-HIGH", "released"), ("5-LOW", "denied"), ("2-HIGH", "released"))


@query("T12_matched_stages", """WITH log AS (SELECT o_custkey AS run, o_orderkey AS id, o_orderpriority AS request,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'plan' WHEN o_orderstatus = 'F' THEN 'released' ELSE 'denied' END AS status FROM orders),
runs AS (SELECT DISTINCT run FROM log), p AS (SELECT run, MIN(id) AS plan_id FROM log WHERE status = 'plan' GROUP BY run),
a AS (SELECT r.run, MIN(l.id) AS row_id FROM runs r LEFT JOIN log l ON l.run = r.run AND l.request = '2-HIGH' AND l.status = 'released' GROUP BY r.run),
b AS (SELECT a.run, a.row_id AS prev, MIN(l.id) AS row_id FROM a LEFT JOIN log l ON l.run = a.run AND l.request = '5-LOW' AND l.status = 'denied'
  AND l.id > coalesce(a.row_id, -1) GROUP BY a.run, a.row_id),
c AS (SELECT b.run, MIN(l.id) AS row_id FROM b LEFT JOIN log l ON l.run = b.run AND l.request = '2-HIGH' AND l.status = 'released'
  AND l.id > coalesce(b.row_id, b.prev, -1) GROUP BY b.run),
s AS (SELECT run, 1 AS k, row_id FROM a UNION ALL SELECT run, 2, row_id FROM b UNION ALL SELECT run, 3, row_id FROM c)
SELECT s.run, CAST(s.k AS INTEGER) AS k, CASE WHEN s.row_id > p.plan_id THEN 'precommitted' ELSE 'exploratory' END AS label
FROM s LEFT JOIN p ON s.run = p.run""")
def t12(spark, d):
    log = plan_log(spark, d)
    stages = log.select("run").distinct().select("run", F.inline(F.array(*(
        F.struct(F.lit(k).alias("k"), F.lit(r).alias("request"), F.lit(s).alias("status"))
        for k, (r, s) in enumerate(STAGE_LIST, 1)))))
    return T.commitment_labels(T.match_stages(stages, log), log)


@query("T12_weakest_label", """WITH log AS (SELECT o_custkey AS run, o_orderkey AS id, o_orderpriority AS p FROM orders)
SELECT run, CASE WHEN MIN(id) = MIN(CASE WHEN p = '1-URGENT' THEN id END) THEN 'precommitted' ELSE 'exploratory' END AS label FROM log GROUP BY run""")
def t12_weakest(spark, d):
    """Every later row of a run as its own stage: committed only if the plan row came first."""
    log = plan_log(spark, d)
    each = log.where(F.col("status") != "plan").select("run", F.lit(1).alias("k"), F.col("id").alias("row_id"))
    plans = log.where(F.col("status") == "plan").select("run").distinct().select(
        "run", F.lit(0).alias("k"), F.lit(2 ** 62).alias("row_id"))
    return T.weakest_label(T.commitment_labels(each.unionByName(plans), log))


def private_names(spark, d):
    """Benchmark passages, standing for strings that must not leave."""
    bench = spark.read.schema("item_id bigint, text string").parquet(f"{d}/benchmark.parquet")
    return bench.select(F.col("text").alias("private"))


@query("T13_private_string_sweep", """WITH p AS (SELECT DISTINCT text AS private FROM benchmark)
SELECT d.doc_id, p.private FROM documents d JOIN p ON length(p.private) >= 8 AND contains(d.text, p.private)""")
def t13(spark, d):
    return T.sweep_private(read(spark, d, "documents"), "doc_id", private_names(spark, d))


@query("T14_guessed_commitments", """SELECT DISTINCT 'sha256:' || sha256(CAST(p_size AS VARCHAR)) AS commitment, CAST(p_size AS VARCHAR) AS guess FROM part WHERE p_size <= 30""")
def t14(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    published = part.select(F.concat(F.lit("sha256:"), F.sha2(F.col("p_size").cast("string"), 256)).alias("commitment"))
    guesses = spark.range(31).select(F.col("id").cast("string").alias("guess"))
    return T.guessed_commitments(published, guesses)


@query("T15_hidden_stages", """SELECT DISTINCT user_id AS run, event_type AS stage FROM events
EXCEPT SELECT DISTINCT user_id, event_type FROM events WHERE value > 45""")
def t15(spark, d):
    events = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "value")
    return T.hidden_stages(events.select("run", "stage").distinct(), events.where("value > 45").select("run", "stage").distinct())


SIZES_SQL = f"""{SALES}, small AS (SELECT n_name || '|' || c_mktsegment AS level, COUNT(DISTINCT person) AS size FROM sales GROUP BY 1 HAVING COUNT(DISTINCT person) < 10)"""


@query("T16_stated_sizes", f"""WITH {SIZES_SQL}
SELECT e.event_id, s.level, s.size FROM events e JOIN small s ON CAST(e.user_id % 40 AS BIGINT) = s.size""")
def t16(spark, d):
    """Notes that mention a number next to a long hexadecimal id."""
    notes = read(spark, d, "events").select(
        "event_id", F.concat(F.lit("id ffff0000ffff0007 of group "), (F.col("user_id") % 40).cast("string"),
                             F.lit(" at rate 7.5 ev-00000009")).alias("text"))
    sales = shop.workspace(spark, d)
    small = C.person_counts(sales, QuerySpec("sales", Measure("count"), ("n_name", "c_mktsegment"))).where(
        F.col("n_persons") < 10).select(F.concat_ws("|", "n_name", "c_mktsegment").alias("level"), F.col("n_persons").alias("size"))
    return T.stated_sizes(notes, "event_id", small)


@query("T17_session_p_values")
def t17(spark, d):
    """p-values of two released correlation tables, adjusted together."""
    ws = shop.workspace(spark, d)
    items = None
    for stage, key in (("s1", "r_name"), ("s2", "c_mktsegment")):
        out = G.release(ws, QuerySpec("sales", Measure("corr", x="o_totalprice", y="c_acctbal"), (key,))).released
        part = T.evidence(out, stage, "corr", (key,), ("value", "p_value", "n"))
        items = part if items is None else items.unionByName(part)
    return adjust_p_values(cut(T.session_p_values(items)))


# -- release audits ---------------------------------------------------------------------------

BY = ("n_name", "c_mktsegment")


@query("O1_undersized_released_cells", f"""WITH {SALES}, t AS (SELECT n_name, c_mktsegment, COUNT(*) AS n, COUNT(DISTINCT person) AS n_persons FROM sales GROUP BY ALL)
SELECT n_name, c_mktsegment, n_persons FROM t WHERE n >= 10 AND n_persons < 10""")
def o1(spark, d):
    """Audit a table released on row counts alone."""
    ws, spec = shop.workspace(spark, d), QuerySpec("sales", Measure("count"), BY)
    careless = C.cells(ws, spec).where(F.col("n") >= 10).drop("n_persons")
    return O.undersized_cells(ws, careless, spec, POLICY)


@query("O2_dominated_released_cells", f"""WITH {SALES}, {SUM_CELLS} SELECT n_name, c_mktsegment, round(dominance, 9) AS dominance FROM cells WHERE dominance > 0.5""")
def o2(spark, d):
    ws, spec = shop.workspace(spark, d, orders=whale), QuerySpec("sales", Measure("sum", "o_totalprice"), BY)
    careless = C.cells(ws, spec).drop("dominance", "n_persons")
    return O.dominated_cells(ws, careless, spec, POLICY).withColumn("dominance", F.round("dominance", 9))


@query("O4_bad_released_values", """WITH t AS (SELECT event_type, CAST(ts AS DATE) AS day, bool_or(event_id % 997 = 0) AS bad FROM events GROUP BY ALL)
SELECT 'value' AS problem, COUNT(*) AS n_cells FROM t WHERE bad UNION ALL SELECT 'event_type', COUNT(*) FROM t WHERE event_type NOT IN ('view', 'click')""")
def o4(spark, d):
    ws = shop.workspace(spark, d, shop.study(event_type=("view", "click")), events=infinite)
    table = C.cells(ws, QuerySpec("clicks", Measure("sum", "value"), ("event_type", "day")))
    return O.bad_values(table.drop("n_persons", "dominance"), ("event_type", "day"), ws.study)


def one_segment(t):
    """All but one in fifty customers moved to one segment."""
    return t.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 50 == 0, F.col("c_mktsegment")).otherwise("BUILDING"))


@query("O5_composable_pairs", f"""WITH {SALES}, t AS (SELECT person, n_name, CASE WHEN person % 50 = 0 THEN c_mktsegment ELSE 'BUILDING' END AS seg FROM sales),
a AS (SELECT n_name, COUNT(DISTINCT person) AS k, COUNT(DISTINCT CASE WHEN seg = 'BUILDING' THEN person END) AS b, COUNT(DISTINCT seg) AS segs FROM t GROUP BY n_name)
SELECT 'nation-segment|' || n_name || '|BUILDING' AS cohort_a, 'nation|' || n_name AS cohort_b, CAST(k - b AS BIGINT) AS n_persons
FROM a WHERE b >= 10 AND k - b < 10 AND segs <> 2""")
def o5(spark, d):
    """Cells of two released tables whose difference isolates a few customers.

    A nation with exactly one other cell loses BUILDING to complementary
    suppression, so it has no such pair.
    """
    ws = shop.workspace(spark, d, customer=one_segment)
    one = G.release(ws, QuerySpec("sales", Measure("count"), ("n_name",))).released
    two = G.release(ws, QuerySpec("sales", Measure("count"), BY)).released
    cohorts = cut(O.cells_as_cohorts(one, "sales", ("n_name",), "nation").unionByName(
        O.cells_as_cohorts(two, "sales", BY, "nation-segment")))
    return O.composable_pairs(ws, "sales", cohorts, POLICY).select(
        F.greatest("cohort_a", "cohort_b").alias("cohort_b"), F.least("cohort_a", "cohort_b").alias("cohort_a"), "n_persons").select(
        F.when(F.col("cohort_a").startswith("nation-"), F.col("cohort_a")).otherwise(F.col("cohort_b")).alias("cohort_a"),
        F.when(F.col("cohort_a").startswith("nation-"), F.col("cohort_b")).otherwise(F.col("cohort_a")).alias("cohort_b"), "n_persons")


@query("O6_planted_checks", f"""WITH {SALES}, t AS (SELECT order_month AS k, {half_up('SUM(CASE WHEN order_month >= 7 THEN 3 * o_totalprice ELSE o_totalprice END)', 'COUNT(*)')} AS v FROM sales GROUP BY 1),
s AS (SELECT bool_and(a.v < b.v) AS m FROM t a JOIN t b ON b.k = a.k + 1)
SELECT arg_max(k, v) AS argmax, round(MAX(v) / MIN(v), 6) AS ratio, round((MAX(v) - MIN(v)) / AVG(v), 6) AS spread, (SELECT m FROM s) AS monotone FROM t""")
def o6(spark, d):
    """A planted second-half effect must show in the released means."""
    planted = lambda t: t.withColumn("o_totalprice", F.when(F.col("order_month") >= 7, F.col("o_totalprice") * 3).otherwise(
        F.col("o_totalprice")).cast("decimal(14,2)"))
    ws = shop.workspace(spark, d, orders=planted)
    out = G.release(ws, QuerySpec("sales", Measure("mean", "o_totalprice"), ("order_month",))).released
    checks = O.planted_checks(out, "order_month", range(1, 13))
    return checks.select("argmax", F.round("ratio", 6).alias("ratio"), F.round("spread", 6).alias("spread"), "monotone")


# -- batches ----------------------------------------------------------------------------------

BATCH = [
    QuerySpec("sales", Measure("mean", "o_totalprice"), ("r_name",), (Filter("n_name", "==", "NATION_3"),)),
    QuerySpec("sales", Measure("mean", "o_totalprice"), ("r_name",), (Filter("n_name", "==", "NATION_3"), Filter("balance", ">=", 0))),
    QuerySpec("sales", Measure("count"), ("c_mktsegment",)),
    QuerySpec("sales", Measure("count"), ("n_name", "o_orderstatus", "o_orderpriority")),
    QuerySpec("sales", Measure("sum", "o_totalprice"), ("order_year",)),
    QuerySpec("sales", Measure("count"), ("n_name",)),
]


PLAN = Plan("Which segments order more?", (
    Stage("base", "mean order by region", MEAN_REGION),
    Stage("fine", "mean order by segment and status in one nation", QuerySpec(
        "sales", Measure("mean", "o_totalprice"), ("c_mktsegment", "o_orderstatus"), (Filter("n_name", "==", "NATION_7"),)),
        after="base", statuses=("released",), exclude_sparse="c_mktsegment"),
    Stage("retry", "only if nothing came out", MEAN_REGION, after="fine", statuses=("denied",)),
))


@query("P2_plan_stages", f"""WITH {SALES}, k AS (SELECT c_mktsegment, COUNT(DISTINCT person) AS p FROM sales WHERE n_name = 'NATION_7' GROUP BY 1),
c AS (SELECT s.c_mktsegment, s.o_orderstatus, COUNT(*) AS n, COUNT(DISTINCT person) < 10 AS out FROM sales s JOIN k ON k.c_mktsegment = s.c_mktsegment
  WHERE n_name = 'NATION_7' AND k.p >= 10 GROUP BY ALL),
base AS (SELECT * FROM c), {complementary('base', ['c_mktsegment', 'o_orderstatus'])[0]}
SELECT 'base' AS stage, 'released' AS status, COUNT(DISTINCT r_name) AS n_rows, CAST('' AS VARCHAR) AS excluded FROM sales
UNION ALL SELECT 'fine', CASE WHEN bool_or(out) THEN 'redacted' ELSE 'released' END, SUM(CASE WHEN out THEN 0 ELSE 1 END),
  (SELECT coalesce(string_agg(c_mktsegment, ',' ORDER BY c_mktsegment), '') FROM k WHERE p < 10) FROM {complementary('base', ['c_mktsegment', 'o_orderstatus'])[1]}
UNION ALL SELECT 'retry', 'skipped', 0, '' FROM region WHERE r_regionkey = 0""")
def p2(spark, d):
    out = None
    for r in run_plan(shop.workspace(spark, d), PLAN):
        rows = (r.released.agg(F.count(F.lit(1)).alias("n_rows")) if r.released is not None
                else spark.range(1).select(F.lit(0).cast("bigint").alias("n_rows")))
        part = rows.select(F.lit(r.id).alias("stage"), F.lit(r.status).alias("status"), "n_rows",
                           F.lit(",".join(r.excluded)).alias("excluded"))
        out = part if out is None else out.unionByName(part)
    return out


@query("P3_batch_ledger", f"""WITH {SALES}, a AS (SELECT COUNT(DISTINCT person) AS k, COUNT(DISTINCT CASE WHEN balance >= 0 THEN person END) AS s FROM sales WHERE n_name = 'NATION_3'),
g AS (SELECT SUM(CASE WHEN p >= 10 THEN 1 ELSE 0 END) AS kept FROM (SELECT COUNT(DISTINCT person) AS p FROM sales GROUP BY n_name, o_orderstatus, o_orderpriority))
SELECT CAST(1 AS BIGINT) AS seq, CAST(k AS BIGINT) AS persons_total, 'released' AS status FROM a
UNION ALL SELECT 2, s, CASE WHEN k - s < 10 THEN 'denied' ELSE 'released' END FROM a
UNION ALL SELECT 3, COUNT(DISTINCT person), 'released' FROM sales
UNION ALL SELECT 4, (SELECT SUM(p) FROM (SELECT COUNT(DISTINCT person) AS p FROM sales GROUP BY n_name, o_orderstatus, o_orderpriority)), CASE WHEN kept > 100 THEN 'review' ELSE 'other' END FROM g
UNION ALL SELECT 5, (SELECT SUM(p) FROM (SELECT COUNT(DISTINCT person) AS p FROM sales GROUP BY order_year)), 'released' FROM a
UNION ALL SELECT 6, NULL, 'denied' FROM a""")
def p3(spark, d):
    _, ledger = run_batch(shop.workspace(spark, d), BATCH, Policy(budget=5))
    return ledger.select("seq", "persons_total", "status")


CROSS = [
    QuerySpec("sales", Measure("sum", "o_totalprice"), ("r_name",)),
    QuerySpec("customer_sales", Measure("sum", "total_price"), ("r_name",), (Filter("c_mktsegment", "!=", "none"),)),
    QuerySpec("customer_sales", Measure("sum", "total_price"), ("c_mktsegment",), (Filter("r_name", "==", "ASIA"),)),
    QuerySpec("customer_sales", Measure("sum", "total_price"), ("r_name",)),
]


@query("P3_cross_view_denial", f"""WITH {SALES}, {CUSTOMER_SALES},
one AS (SELECT person, SUM(o_totalprice) AS s FROM sales GROUP BY person),
two AS (SELECT person, total_price AS s, r_name FROM customer_sales),
d AS (SELECT COUNT(CASE WHEN abs(coalesce(one.s, 0) - coalesce(two.s, 0)) > 1e-6 THEN 1 END) AS same,
  COUNT(CASE WHEN abs(coalesce(one.s, 0) - CASE WHEN r_name = 'ASIA' THEN coalesce(two.s, 0) ELSE 0 END) > 1e-6 THEN 1 END) AS asia
  FROM one FULL JOIN two ON one.person = two.person)
SELECT CAST(1 AS BIGINT) AS seq, 'released' AS status FROM d
UNION ALL SELECT 2, CASE WHEN same < 10 THEN 'denied' ELSE 'released' END FROM d
UNION ALL SELECT 3, CASE WHEN asia < 10 THEN 'denied' ELSE 'released' END FROM d
UNION ALL SELECT 4, 'released' FROM d""")
def p3_cross(spark, d):
    """Sums of one quantity on two views: other predicates over the same contributions
    are refused, equal predicates and far cohorts are not."""
    _, ledger = run_batch(shop.workspace(spark, d), CROSS)
    return ledger.select("seq", "status")


REFUSED = Plan("Two cohorts that nearly coincide", (
    Stage("one", "mean order by region in one nation", BATCH[0]),
    Stage("two", "the same without the few in debt", QuerySpec("sales", Measure("mean", "o_totalprice"), ("r_name",), (
        Filter("n_name", "==", "NATION_3"), Filter("balance", ">=", 0))), after="one", statuses=("released", "redacted")),
))


@query("P2_plan_refused_stage", f"""WITH {SALES}, a AS (SELECT COUNT(DISTINCT person) AS k, COUNT(DISTINCT CASE WHEN balance >= 0 THEN person END) AS s FROM sales WHERE n_name = 'NATION_3')
SELECT 'one' AS stage, 'released' AS status, '' AS reason FROM a
UNION ALL SELECT 'two', CASE WHEN k - s < 10 THEN 'denied' ELSE 'released' END, CASE WHEN k - s < 10 THEN 'differencing' ELSE '' END FROM a""")
def p2_refused(spark, d):
    """A plan keeps the same ledger as single requests."""
    out = run_plan(shop.workspace(spark, d), REFUSED)
    orders = read(spark, d, "orders").agg(F.count(F.lit(1)))
    return orders.select(F.inline(F.array(*(F.struct(F.lit(r.id).alias("stage"), F.lit(r.status).alias("status"),
                                                     F.lit(r.reason).alias("reason")) for r in out))))
