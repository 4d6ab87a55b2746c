"""Requests of every kind, sweeps over all group-bys, and rebuilt sessions."""

import hashlib
import hmac
import json
import random
from dataclasses import replace
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortveil.operators import cells as C
from cohortveil.operators import sessions as S
from cohortveil.operators.lattice import key_sets, parents
from cohortveil.operators.views import Workspace
from cohortveil.plans.requests import planned
from cohortveil.plans.staged import Session
from cohortveil.session import cut
from cohortveil.specs import FactorSpec, Filter, GlmSpec, Measure, QuerySpec, SeriesSpec
from cohortveil.study import Policy, Study, View


def study():
    view = View(base="t", person="t.person", columns={c: f"t.{c}" for c in ("a", "b", "wave", "flag", "x")},
                dims={"a": "cat", "b": "cat", "wave": "int", "flag": "bool"}, measures=("x",),
                responses={"x": ("gaussian",), "flag": ("binomial",)}, time_dims=("wave",), population="people")
    return Study("one", {"t": {"person": "DI", "a": "QI", "b": "QI", "wave": "QI", "flag": "QI", "x": "S"}}, {"v": view},
                 domains={"a": ("p", "q")})


@pytest.fixture(scope="module")
def ws(spark):
    rng = random.Random(3)
    rows = [(f"u{k % 90}", "pq"[k % 2], rng.choice(["r", "s", None]), 1 + k % 5, rng.random() < 0.4, round(rng.uniform(1, 9), 2)) for k in range(900)]
    df = spark.createDataFrame(rows, "person string, a string, b string, wave int, flag boolean, x double")
    return Workspace(study(), {"t": cut(df)})


GAUSS = GlmSpec("v", "gaussian", "x", ("a",))
BINOM = GlmSpec("v", "binomial", "flag", ("a",))


def test_planned_tables():
    names = lambda spec: [(p.role, p.key, p.required) for p in planned(spec)]
    assert names(GAUSS) == [("mean", "v:mean:x#mean", True), ("sum_sq", "v:sum_sq:x#sum_sq", False)]
    assert names(BINOM) == [("trials", "v:count:*#trials", True), ("successes", "v:count:*#successes", True)]
    assert planned(BINOM)[1].query.filters == (Filter("flag", "==", True),)
    assert [p.role for p in planned(FactorSpec("v", "x", "a", tool="normality"))] == ["sum", "sum_sq", "sum_cube", "sum_quad"]
    assert all(p.required for p in planned(FactorSpec("v", "x", "a")))
    assert names(SeriesSpec("v", "x", "wave", "sum")) == [("series", "v:sum:x#series", True)]
    assert names(QuerySpec("v", Measure("count"), ("a",))) == [("", "v:count:*", True)]


def test_a_model_is_charged_for_its_tables_or_for_nothing(ws):
    poor = Session(ws, Policy(budget=1))
    refused = poor.run(BINOM)
    assert (refused.status, refused.reason, poor.spent, refused.tables) == ("denied", "query_budget", 0, {})
    assert poor.run(QuerySpec("v", Measure("count"), ("a",))).status == "released" and poor.spent == 1
    session = Session(ws, Policy())
    given = session.run(BINOM)
    assert given.status == "released" and session.spent == 2 and set(given.tables) == {"coefficients", "summary", "cells"}
    assert [len(f) for _, _, f, _ in session.released] == [0, 1]  # the successes are a cohort of their own
    # a cohort that nearly is that of the successes
    near = QuerySpec("v", Measure("count"), ("a",), (Filter("flag", "==", True), Filter("wave", "<=", 5)))
    assert session.run(near).reason == "differencing" and session.spent == 3
    strict = Session(ws, Policy(dominance=1e-6))
    lost = strict.run(FactorSpec("v", "x", "a"))
    assert (lost.status, lost.reason, strict.spent, strict.released) == ("denied", "nothing released", 1, [])
    assert [e.persons_total for e in lost.entries][1] is None
    means = Session(ws, replace(Policy(), dominance=0.5)).run(SeriesSpec("v", "x", "wave"))
    assert means.status == "released" and means.tables["cells"].count() == 5


def test_wide_sets_cover_every_set_once():
    dims = [f"d{k}" for k in range(8)]
    plan = parents(dims, 3, {d: 2 + k for k, d in enumerate(dims)})
    assert sorted(s for sets in plan.values() for s in sets) == sorted(key_sets(dims)) and len(key_sets(dims)) == 93
    assert all(set(s) <= set(w) for w, sets in plan.items() for s in sets) and len(plan) <= 14
    assert list(parents(["a"], 3, {"a": 2})) == [("a",)]


def test_sweep_equals_each_group_by(spark, ws):
    rows = spark.createDataFrame([(f"u{k % 9}", "pq"[k % 2], None if k % 5 == 0 else "r", k % 3, k % 4 == 0, float(k)) for k in range(60)],
                                 "person string, a string, b string, wave int, flag boolean, x double")
    small = Workspace(study(), {"t": cut(rows)})
    dims = ["a", "b", "flag", "wave"]
    sweep = C.sweep_cells(small, "v", "x", degrees=(1, 2), hits="flag").collect()
    got = {(r["grouping"], *(r[d] for d in dims)): (r["n"], r["n_persons"], r["s1"], r["k"], r["k_persons"], round(r["dominance1"], 9)) for r in sweep}
    want = {}
    data = [r.asDict() for r in rows.collect()]
    for k in range(4):
        for keys in combinations(dims, k):
            for r in data:
                want.setdefault(("+".join(keys), *(r[d] if d in keys else None for d in dims)), []).append(r)
    assert set(got) == set(want)
    for key, own in want.items():
        per = {}
        for r in own:
            per[r["person"]] = per.get(r["person"], 0) + r["x"]
        hits = {r["person"] for r in own if r["flag"]}
        total = sum(per.values())
        top = max(per.values()) / total if total else float("inf")
        assert got[key] == (len(own), len(per), total, sum(r["flag"] for r in own), len(hits), round(top, 9)), key


KEY, SIZE = b"k", 4
START = datetime(2024, 1, 1)


def chain_rows(chain, n):
    enc = lambda t: "~" if t is None else f"{len(t)}:{t}"
    prev, out = S.GENESIS, []
    for i in range(n):
        accounting = json.dumps({"cost": i % 3, "selection_bits": 1, "totals": [{"measure": "m", "total": i % 2}],
                                 "cohorts": [{"view": "v", "cohort_id": f"c{i % 2}", "quantity": None}]})
        ts, user, status = START + timedelta(hours=i), f"u{i % 2}", "config" if i % 5 == 4 else "released"
        body = "".join(enc(x) for x in (str(i), str(ts), user, status, accounting, prev))
        mac = hmac.new(KEY, body.encode(), hashlib.sha256).hexdigest()
        out.append((chain, i, ts, user, status, accounting, prev, mac))
        prev = mac
    return out


def expected(rows, cutoff):
    out = {}
    for _, i, ts, user, status, accounting, *_ in rows:
        if ts >= cutoff and status != "config":
            a = json.loads(accounting)
            for kind, number in (("units", a["cost"]), ("bits", 1), ("records", 1)):
                out[user, kind, None] = out.get((user, kind, None), 0) + number
            out[user, "total", "m", i % 2] = i % 2
            out[user, "cohort", json.dumps(a["cohorts"][0], separators=(",", ":"))] = None
    return {(*k[:3], v) for k, v in out.items()}


SCHEMA = "chain int, id long, ts timestamp, user string, status string, accounting string, prev_mac string, mac string"


def test_sessions_come_from_sealed_states_and_open_rows(spark):
    rows = chain_rows(1, 18)
    log = cut(spark.createDataFrame(rows, SCHEMA))
    sealed = S.seal(log, KEY, SIZE)
    sealed = S.Sealed(cut(sealed.marks), cut(sealed.states))
    assert sealed.marks.count() == 4
    heads = spark.createDataFrame([(1, rows[-1][-1])], "chain int, head string")
    cutoff = START + timedelta(hours=6)  # inside the second segment
    read = lambda kept, **other: S.rebuild(kept, replace(sealed, **other), heads, KEY, SIZE, cutoff)
    state = lambda out: {tuple(r) for r in out[0].select("user", "kind", "name", "number").collect()}
    sound = lambda out: [r["sound"] for r in out[1].collect()]
    want = expected(rows, cutoff)
    assert state(read(log)) == want and sound(read(log)) == [True]
    # rows of sealed segments away from the cutoff are not needed
    archived = log.where("id between 4 and 7 or id >= 16")
    assert state(read(archived)) == want
    tampered = [log.where("id <> 5"), log.where("id <> 17"), log.where("id <> 16"),
                log.withColumn("user", F.when(F.col("id") == 6, "u9").otherwise(F.col("user"))),
                log.withColumn("accounting", F.when(F.col("id") == 17, F.lit("{}")).otherwise(F.col("accounting")))]
    for bad in tampered:
        out = read(bad)
        assert sound(out) == [False] and state(out) == set()
    for bad in ({"states": sealed.states.withColumn("number", F.lit(0).cast("bigint"))}, {"states": sealed.states.where("segment <> 2")},
                {"marks": sealed.marks.withColumn("last_ts", F.col("last_ts") + F.expr("interval 9 hours"))}):
        assert sound(read(log, **bad)) == [False]


def test_sealing_writes_states_once_and_moves_no_texts(spark):
    """Every look at the marks parsed and verified the whole log again, and its texts met in joins."""
    log = cut(spark.createDataFrame(chain_rows(1, 18), SCHEMA))
    sealed = S.seal(log, KEY, SIZE)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan(sealed.states) + plan(sealed.marks) and sealed.states.inputFiles()
    checked = S._checked(log, None, KEY, SIZE)
    assert "accounting" not in checked.columns
    # an empty list, no list and a list that holds null, in one grouping with the sums
    odd = spark.createDataFrame(
        [("released", "u", '{"cost":2,"totals":[],"cohorts":[null]}'), ("released", "u", '{"totals":[{"measure":"m"}]}'), ("released", "u", "x"),
         ("config", "u", '{"cost":1}'), ("released", "", '{"cost":1}'), ("released", None, '{"cost":1}')], "status string, user string, accounting string")
    rows = sorted(tuple(r) for r in S.state_rows(odd.union(odd)).na.fill("-", ["name"]).na.fill(-1, ["number"]).collect())
    assert rows == [("u", "bits", "-", 0), ("u", "cohort", "-", -1), ("u", "records", "-", 6), ("u", "total", "m", -1), ("u", "units", "-", 4)]


def test_a_log_of_events_is_folded_without_lists_of_macs(spark, tmp_path):
    """The fold copied every MAC before a row, text by text, for that row."""
    from veil_queries import session_rebuild as R
    events = spark.createDataFrame([(i, START + timedelta(minutes=7 * (i % 40)), i % 9 if i % 11 else None, "error" if i % 5 == 0 else "view")
                                    for i in range(130)], "event_id long, ts timestamp, user_id long, event_type string")
    events.withColumn("value", F.lit(1.0)).withColumn("props", F.lit("")).write.parquet(f"{tmp_path}/events.parquet")
    log = R.audit_log(spark, str(tmp_path))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "array_append" not in plan and "array_insert" not in plan
    rows = log.withColumn("at", F.col("ts").cast("string")).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(130)) and [r["ts"] for r in rows] == sorted(r["ts"] for r in rows)
    before = S.GENESIS
    for r in rows:
        parts = (str(r["id"]), r["at"], r["user"], r["status"], r["accounting"], before)
        body = "".join("~" if p is None else f"{len(p)}:{p}" for p in parts)
        assert r["prev_mac"] == before and r["mac"] == hmac.new(R.KEY, body.encode(), hashlib.sha256).hexdigest()
        before = r["mac"]


def test_tasks_of_a_sweep_and_of_marginals_follow_their_rows(spark, ws, monkeypatch):
    """Small shuffles were merged into a few tasks, each of which then made many times their rows."""
    from cohortveil.operators import lattice
    orders = spark.createDataFrame([(i, i % 50, "F", 1.0 + i, "1-URGENT", 1995, 1, True) for i in range(200)],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                   "o_orderpriority string, order_year int, order_month int, is_urgent boolean")
    before = lattice.by_person(orders.withColumnRenamed("o_custkey", "_person"), 10).rdd.getNumPartitions()
    monkeypatch.setattr(lattice, "ROWS_PER_TASK", 40)
    held = lattice.by_person(orders.withColumnRenamed("o_custkey", "_person"), 10)
    assert held.rdd.getNumPartitions() == 50 > before
    assert held.count() == 200
