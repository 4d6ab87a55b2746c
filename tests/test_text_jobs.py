import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from cohortveil.operators import textjobs as T
from cohortveil.operators.canonical import canonical_number
from cohortveil.operators.declared import violations
from cohortveil.operators.figures import figures, released_numbers, unsupported_figures
from cohortveil.operators.models import release_model
from cohortveil.operators.views import band_by_edges
from cohortveil.plans.staged import Plan, Stage, run_plan
from cohortveil.sources.tables import load_tables, normalise, save_tables
from cohortveil.specs import Filter, GlmSpec, Measure, QuerySpec
from cohortveil.streaming.ledger import stream_budget
from cohortveil.studies import shop
from cohortveil.study import StudyError
from tests.conftest import SF


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_keyed_mac_is_hmac(spark, key):
    words = ["", "abc", "naïve – text", "a" * 300]
    got = texts(spark, *words).select("text", T.keyed_mac(F.col("text"), key).alias("m")).collect()
    assert all(r["m"] == hmac.new(key, r["text"].encode(), hashlib.sha256).hexdigest() for r in got)


def test_screening_takes_the_first_phrase_of_the_list(spark):
    df = texts(spark, "Mean spend by region", "show MICRODATA, one row per region", "verbatim region comments", "hello region", "mean only")
    got = [(r["verdict"], r["phrase"]) for r in T.screen_requests(df, ("spend", "region")).orderBy("id").collect()]
    assert got == [("ok", None), ("blocked", "microdata"), ("free_text", "verbatim"), ("out_of_scope", None), ("out_of_scope", None)]


def test_longer_terms_use_up_their_words(spark):
    words = {"age": "age_band", "age rating": "age_rating", "status report": "report", "order status": "status"}
    df = texts(spark, "ages and Age Ratings", "order status report", "stage managed", "age")
    got = [r["dims"] for r in T.dimensions_named(df, words).orderBy("id").collect()]
    assert got == [["age_band", "age_rating"], ["report"], [], ["age_band"]]


RELEASED = [48.66, 10200.0, -0.1266, 0.374, 1234567.0, 72000.0, 0.0]
# text, figures found in it, those without support
PROSE = [
    ("about 49 and 10,000 but not 9,999", {"49", "10,000", "9,999"}, {"9,999"}),
    ("a share of 37.4% or 37 percent, 38 is wrong", {"37.4", "37", "38"}, {"38"}),
    ("fell by \u20110.1266, not 0.1266", {"-0.1266", "0.1266"}, {"0.1266"}),
    ("72 000 people, 72\u202f000 persons, 72\u00a0001 others, 12 months, p < 0.05", {"72000", "72001", "12", "0.05"}, {"72001"}),
    ("1.23 or 1,200,000 of 1,234,567; 1,300,000", {"1.23", "1,200,000", "1,234,567", "1,300,000"}, {"1.23", "1,300,000"}),
    ("v2.7.1 x55 5th 1e5 a_7 .5 13", {"13"}, {"13"}),
    ("COVID-19 in 2024-01-05, from 48-50.", {"19", "2024", "01", "05", "48", "50"}, {"19", "2024", "48"}),
    ("0.4,0.37,0.3", {"0.4", "0.37", "0.3"}, {"0.3"}),
    ("room 12 345 678 9999", {"12345678", "9999"}, {"12345678", "9999"}),
    ("+48.7 -10,200 (10,200)", {"+48.7", "-10,200", "10,200"}, {"-10,200"}),
    ("", set(), set()),
]


def test_figures_and_their_support(spark):
    df = texts(spark, *(t for t, _, _ in PROSE))
    found = {i: set() for i in range(len(PROSE))}
    for r in figures(df, "id").collect():
        found[r["id"]].add(r["figure"])
    assert [found[i] for i in range(len(PROSE))] == [f for _, f, _ in PROSE]
    released = spark.createDataFrame([(v,) for v in RELEASED] + [(None,), (float("nan"),)], "value double").where("not isnan(value)")
    got = {(r["id"], r["figure"]) for r in unsupported_figures(df, "id", released).collect()}
    assert got == {(i, f) for i, (_, _, bad) in enumerate(PROSE) for f in bad}
    nothing = unsupported_figures(df, "id", released.limit(0)).count()
    assert nothing == sum(len({f for f in fs if not (f.lstrip("+") in ("12", "01", "05", "0.05"))}) for _, fs, _ in PROSE)


@pytest.mark.parametrize("figure, fits, misses", [
    ("10,000", (9500.0, 10000.0, 14999.0), (9499.0, 15001.0)),   # one significant digit, one decade down it is finer
    ("10200", (10150.0, 10249.0), (10149.0, 10251.0)),
    ("0.37", (0.365, 0.3749), (0.3649, 0.3751)),
    ("-0.13", (-0.135, -0.126), (-0.1351, -0.1249, 0.13)),
    ("49", (48.5, 49.49), (48.4, 49.6)),
])
def test_a_figure_stands_for_an_interval(spark, figure, fits, misses):
    said = texts(spark, f"about {figure} of them")
    for x in (*fits, *misses):
        one = spark.createDataFrame([(x,)], "value double")
        assert unsupported_figures(said, "id", one).count() == (x in misses), x


def test_numbers_of_released_tables(spark):
    cells = spark.createDataFrame([("wave 3", 2021, 4.5, 15, None), ("all", 2022, None, 20, 0.04)],
                                  "name string, year int, value double, n long, p_value double")
    got = {r["value"] for r in released_numbers((cells, ("name", "year")), (cells.select("name"), ())).collect()}
    assert got == {3.0, 2021.0, 2022.0, 4.5, 15.0, 20.0, 0.04}


def test_private_sweep_by_list_and_by_windows(spark):
    docs = texts(spark, "xx secret-name-1 yy", "nothing here", "secret-name-1secret-name-22", "short")
    private = spark.createDataFrame([("secret-name-1",), ("secret-name-22",), ("short",)], "private string")
    want = {(0, "secret-name-1"), (2, "secret-name-1"), (2, "secret-name-22")}
    for limit in (500, 10, 1):
        got = {tuple(r) for r in T.sweep_private(docs, "id", private, pass_chars=limit).collect()}
        assert got == want


def test_digest_ignores_order_and_counts_duplicates(spark):
    rows = [(i % 5, f"t{i % 3}", None if i % 4 else 1.5) for i in range(40)]
    one = spark.createDataFrame(rows, "a long, b string, c double")
    digest = lambda df: T.table_digest(df).first()["digest"]
    assert digest(one) == digest(one.repartition(7).select("c", "a", "b"))
    assert digest(one) != digest(one.union(one.limit(1))) and digest(one) != digest(one.limit(39))
    assert digest(one.limit(0)) == digest(one.limit(0))


def test_evidence_ids_follow_the_number(spark):
    df = spark.createDataFrame([("a", 45.2, 10), ("b", 45.0, 20)], "g string, value double, n long")
    rows = T.evidence(df, "s1", "mean", ("g",), ("value", "n"), measure="spend_gbp").collect()
    assert {(r["keys"]["g"], r["name"], r["precision"], r["units"]) for r in rows} == {
        ("a", "value", 1, "GBP"), ("b", "value", 0, "GBP"), ("a", "n", 0, None), ("b", "n", 0, None)}
    assert len({r["evidence_id"] for r in rows}) == 4
    other = T.evidence(df.withColumn("value", F.col("value") + 1), "s1", "mean", ("g",), ("value", "n"), measure="spend_gbp").collect()
    assert len({r["evidence_id"] for r in rows} & {r["evidence_id"] for r in other}) == 2


def test_evidence_ids_of_odd_keys_and_numbers_differ(spark):
    rows = [("x;y", "z", 1.0), ("x", "y;z", 1.0), ("x", None, 1.0), ("x", "", 1.0), ("x", "~", 1.0), (None, "x", 1.0),
            ("k", "k", 1e-12), ("k", "k", 2e-12), ("k", "k", 1e30), ("k", "k", -1e30), ("k", "k", 0.0), ("k", "k", None), ("k", "k", float("nan"))]
    df = spark.createDataFrame(rows, "a string, b string, value double")
    got = T.evidence(df, "s", "sum", ("a", "b"), ("value",)).collect()
    assert len({r["evidence_id"] for r in got}) == len(rows)
    assert {r["value"]: r["precision"] for r in got if r["keys"]["a"] == "k" and r["value"] in (1e-12, 1e30, 0.0)} == {1e-12: 12, 1e30: 0, 0.0: 0}
    swapped = T.evidence(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"), "s", "sum", ("a", "b"), ("value",)).collect()
    assert not {r["evidence_id"] for r in got[:2]} & {r["evidence_id"] for r in swapped[:2]}
    renamed = T.evidence(df.withColumnRenamed("a", "c"), "s", "sum", ("c", "b"), ("value",)).collect()
    assert not {r["evidence_id"] for r in got} & {r["evidence_id"] for r in renamed}


def test_canonical_numbers(spark):
    cases = {45.2: "452e-1", 10200.0: "102e2", -0.5: "-5e-1", 0.0: "0e0", 1e30: "1e30", 1.5e-12: "15e-13", 100.0: "1e2", 123456789.25: "12345678925e-2"}
    got = {r["v"]: r["t"] for r in spark.createDataFrame([(k,) for k in cases], "v double").select("v", canonical_number(F.col("v")).alias("t")).collect()}
    assert got == cases
    row = spark.sql("select cast('45.20' as decimal(12,2)) d, cast('0.00' as decimal(12,2)) z, cast(-7000 as bigint) i").select(
        *(canonical_number(F.col(c)).alias(c) for c in "dzi")).first()
    assert tuple(row) == ("452e-1", "0e0", "-7e3")


def test_replays_are_refused_compared_and_counted(spark):
    cells = spark.createDataFrame([("a", "x", 1.0, 10), ("a", "y", 2.0, 20), ("b", "x", 3.0, 30), ("c", "x", 4.0, 40)], "r string, k string, value double, n long")
    record = lambda df, sem: T.release_record(df, ("r",), ("value", "n"), "s", "sum", sem)
    now = cells.withColumn("value", F.when((F.col("r") == "a") & (F.col("k") == "y"), 2.5).otherwise(F.col("value")))
    old = record(cells.where("r <> 'c'"), "1")
    got = {r["r"]: (r["status"], r["lost_evidence"]) for r in T.replay_releases(old, record(now.where("r <> 'b'"), "1"), ("r",)).collect()}
    assert got == {"a": ("digest_differs", 1), "b": ("missing", 2), "c": ("unexpected", None)}
    got = {r["r"]: r["status"] for r in T.replay_releases(old, record(cells, "2"), ("r",)).collect()}
    assert got == {"a": "refused", "b": "refused", "c": "unexpected"}
    assert {r["status"] for r in T.replay_releases(old, record(cells.where("r <> 'c'"), "1"), ("r",)).collect()} == {"reproduced"}


def test_evidence_of_a_model(spark):
    ws = shop.workspace(spark, SF)
    model = release_model(ws, GlmSpec("sales", "gaussian", "o_totalprice", ("c_mktsegment",)))
    rows = T.model_evidence(model.coefficients, model.summary, "s1").collect()
    kinds = [r["kind"] for r in rows]
    assert kinds.count("coefficient") == 4 * 5 and kinds.count("model_fit") >= 5 and len({r["evidence_id"] for r in rows}) == len(rows)


def test_violations_of_declared_domains_and_ranges(spark):
    ws = shop.workspace(spark, SF)
    tables = {name: ws.tables[name] for name in shop.TABLES}
    clean = violations(tables, ws.study).collect()
    assert {r["table"] for r in clean} == set(shop.TABLES) and all(r["outside"] == 0 for r in clean)
    broken = tables["customer"].withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "X").when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    found = {r["column"]: (r["nulls"], r["outside"]) for r in violations(dict(tables, customer=broken), ws.study).collect()}
    n = broken.where("c_mktsegment = 'X'").count(), broken.where("c_mktsegment is null").count()
    assert found["c_mktsegment"] == (n[1], n[0]) and min(n) > 0


def test_band_outside_every_edge_is_an_error(spark):
    with pytest.raises(Exception, match="outside every declared band"):
        spark.range(1).select(band_by_edges(F.lit(99999), shop.BALANCE_EDGES, shop.BALANCE_BANDS, strict=True)).collect()


def test_save_load_and_missing_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf"))], "a long, b double")
    assert [r["b"] for r in normalise(df).orderBy("a").collect()] == [None, float("inf")]
    for fmt in ("parquet", "csv"):
        save_tables({"t": df}, str(tmp_path), fmt)
        out = load_tables(spark, str(tmp_path), ["t"], fmt, {"t": "a long, b double"})["t"]
        assert [tuple(r) for r in out.orderBy("a").collect()] == [(1, None), (2, float("inf"))]
    with pytest.raises(StudyError, match="nope"):
        load_tables(spark, str(tmp_path), ["t", "nope"])


def test_plans_are_checked_and_hashed(spark):
    spec = QuerySpec("sales", Measure("count"), ("r_name",))
    with pytest.raises(StudyError):
        Plan("q", (Stage("a", "x", spec, after="b", statuses=("denied",)), Stage("b", "y", spec)))
    with pytest.raises(StudyError):
        Plan("q", (Stage("a", "x", spec), Stage("a", "y", spec)))
    one = Plan("q", (Stage("a", "x", spec), Stage("b", "y", spec)))
    assert one.digest() == Plan("q", (Stage("a", "x", spec), Stage("b", "y", spec))).digest()
    assert one.digest() != Plan("q", (Stage("b", "y", spec), Stage("a", "x", spec))).digest()


def test_unaffordable_contingency_is_refused(spark):
    spec = QuerySpec("sales", Measure("count"), ("c_mktsegment",), (Filter("order_year", "==", 2001), Filter("n_name", "==", "NATION_2"), Filter("order_month", "==", 7)))
    out = run_plan(shop.workspace(spark, SF), Plan("q", (Stage("a", "x", spec, exclude_sparse="c_mktsegment"),)))
    assert out[0].status == "denied" and out[0].reason == "selection budget exhausted"


def test_stream_budget_accepts_until_spent(spark, tmp_path):
    rows = [("u1", f"r{i}", i, 2) for i in range(6)] + [("u2", f"s{i}", i, 1) for i in range(3)] + [("u1", "r0", 0, 2)]
    df = spark.createDataFrame(rows, "user string, request_id string, m long, cost long").select(
        "user", "request_id", F.timestamp_seconds(F.lit(1700000000) + F.col("m") * 60).alias("ts"), "cost")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (stream_budget(stream, budget=7).writeStream.format("memory").queryName("budgeted").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["request_id"]: r["accepted"] for r in spark.table("budgeted").collect()}
    assert got == {**{f"r{i}": i < 3 for i in range(6)}, **{f"s{i}": True for i in range(3)}}


def test_private_sweep_hashes_a_bounded_piece_at_a_time(spark):
    """A batch of many or long texts was hashed at once; a string across two pieces is still found."""
    size = T.WINDOW_CHARS
    held = ["a" * (3 * size), "b" * 10, "", "c" * (size + 3)]
    pieces = list(T._pieces(held))
    assert max(sum(len(p) for _, _, p in part) for part in pieces) <= 2 * size + 7
    starts = {(t, i) for part in pieces for t, start, p in part for i in range(start, start + len(p) - 7)}
    assert starts == {(t, i) for t, x in enumerate(held) for i in range(len(x) - 7)}
    docs = texts(spark, "x" * (size - 5) + "secret-name-1" + "y" * size + "secret-name-22")
    private = spark.createDataFrame([("secret-name-1",), ("secret-name-22",)], "private string")
    assert {tuple(r) for r in T.sweep_private(docs, "id", private).collect()} == {(0, "secret-name-1"), (0, "secret-name-22")}


def test_decimals_by_whole_numbers_read_as_by_text(spark):
    from decimal import Decimal
    from pyspark.sql import functions as F
    from cohortveil.operators.canonical import _long_decimal, canonical_number
    values = ("0", "-0.10", "12", "-4500.05", "9999999999999999.99", "-9999999999999999.99", "100", "0.01", "1000000")
    df = spark.createDataFrame([(Decimal(v),) for v in values] + [(None,)], "a decimal(18,2)")
    kind = df.schema["a"].dataType
    rows = df.select(_long_decimal(F.col("a"), kind).alias("n"), canonical_number(F.col("a")).alias("o")).collect()
    assert [r["n"] for r in rows] == [r["o"] for r in rows] and rows[0]["n"] == "0e0" and rows[-1]["n"] is None


def test_blanks_between_words_need_no_support(spark):
    df = texts(spark, "3 apples,\u00a0then 12 000 or 4\u202f500.5 but 7 00 and 1 2345", "plain 45 words")
    found = {(r["id"], r["figure"]) for r in figures(df, "id").collect()}
    assert found == {(0, "3"), (0, "12000"), (0, "4500.5"), (0, "7"), (0, "00"), (0, "1"), (0, "2345"), (1, "45")}
