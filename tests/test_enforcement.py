"""Review, denial, cell identity, correlation precision, unconverged fits."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortveil.operators import gateway as G
from cohortveil.operators import models as M
from cohortveil.operators import rules as R
from cohortveil.operators.cells import cells
from cohortveil.operators.views import Workspace
from cohortveil.specs import GlmSpec, Measure, QuerySpec
from cohortveil.study import Policy, Study, View

POLICY = Policy()


def workspace(spark, rows, schema="person string, g string, h string, x double, y double"):
    table = spark.createDataFrame(rows, schema)
    view = View(base="t", person="t.person", columns={"g": "t.g", "h": "t.h", "x": "t.x", "y": "t.y"},
                dims={"g": "cat", "h": "cat"}, measures=("x", "y"), responses={"x": ("gaussian",)})
    study = Study("tiny", {"t": {"person": "DI", "g": "QI", "h": "QI", "x": "S", "y": "S"}}, {"v": view})
    return Workspace(study, {"t": table})


def test_a_table_over_the_bound_needs_review(spark):
    rows = [(f"p{i}-{j}", f"g{i}", "h", 1.0 + j, 2.0) for i in range(8) for j in range(12)]
    ws, spec = workspace(spark, rows), QuerySpec("v", Measure("mean", "x"), ("g",))
    small = replace(POLICY, max_cells=7)
    out = G.release(ws, spec, small)
    assert out.released.isEmpty() and out.outcome.first()["outcome"] == "review"
    assert [(r["rule"], r["severity"], r["suppressable"], r["n_cells"]) for r in out.findings.collect()] == [("too_granular", "medium", False, 8)]
    assert G.review_decision(out.findings).first()["decision"] == "human"
    fine = G.release(ws, spec, replace(POLICY, max_cells=8))
    assert fine.released.count() == 8 and fine.outcome.first()["outcome"] == "released" and fine.findings.isEmpty()


def test_model_cells_over_the_bound_need_review(spark):
    rows = [(f"p{i}-{j}", f"g{i}", "h", 1.0 + i + j % 3, 2.0) for i in range(8) for j in range(12)]
    ws, spec = workspace(spark, rows), GlmSpec("v", "gaussian", "x", ("g",))
    out = M.release_model(ws, spec, replace(POLICY, max_cells=7))
    assert (out.status, out.reasons, out.cells, out.coefficients) == ("review", ("too_granular",), None, None)
    assert M.release_model(ws, spec).status == "released"


def test_a_table_with_an_identifier_is_denied_with_findings(spark):
    ws = workspace(spark, [(f"p{j}", "g", "h", 1.0, 2.0) for j in range(12)])
    spec = QuerySpec("v", Measure("count"), ("g",))
    table = cells(ws, spec).withColumn("person", F.lit("p1"))
    out = G.release_cells(table, spec, POLICY, ws.study)
    assert out.released.isEmpty() and "person" not in out.released.columns
    assert out.outcome.first()["outcome"] == "denied" and out.status.first()["decision"] == "deny"
    assert [(r["rule"], r["severity"], r["suppressable"]) for r in out.findings.collect()] == [("identifier_egress", "high", False)]


def released_keys(ws, keys):
    out = G.release(ws, QuerySpec("v", Measure("count"), keys)).released
    return {tuple(r[k] for k in keys) for r in out.collect()}


def test_missing_and_empty_keys_are_two_cells(spark):
    people = lambda g, h, n: [(f"{g}{h}{i}", g, h, 1.0, 1.0) for i in range(n)]
    rows = people(None, "a", 12) + people("", "a", 12) + people("z", "a", 30) + people("y", "a", 3)
    ws = workspace(spark, rows)
    # one cell is too small, so exactly one more is given up
    assert len(released_keys(ws, ("g",))) == 2 and ("z",) in released_keys(ws, ("g",))


def test_keys_that_join_to_one_text_stay_apart(spark):
    people = lambda g, h, n: [(f"{g}/{h}/{i}", g, h, 1.0, 1.0) for i in range(n)]
    rows = people("a|b", "c", 12) + people("a", "b|c", 12) + people("a|b", "d", 14) + people("a", "d", 14) + people("a|b", "e", 3)
    kept = released_keys(workspace(spark, rows), ("g", "h"))
    assert ("a", "b|c") in kept and ("a|b", "c") not in kept


def test_verdicts_by_keys_and_by_ambiguous_text(spark):
    table = spark.createDataFrame([(None, 20), ("", 20), ("x", 20)], "g string, n long")
    by_text = spark.createDataFrame([("", "release"), ("x", "release")], "cell string, rule string")
    out = {r["g"]: r["failed_rules"] for r in R.apply_verdicts(table, ("g",), by_text).collect()}
    assert out == {None: ["checker_incomplete"], "": ["checker_incomplete"], "x": []}
    by_key = spark.createDataFrame([(None, "release"), ("", "p-ratio"), ("x", "release")], "g string, rule string")
    out = {r["g"]: r["failed_rules"] for r in R.apply_verdicts(table, ("g",), by_key).collect()}
    assert out == {None: [], "": ["p-ratio"], "x": []}


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e9])
def test_correlation_survives_an_offset(spark, offset):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 400)
    y = 0.6 * x + rng.normal(0, 1, 400)
    rows = [(f"p{i}", "g", "h", offset + float(a), -offset + float(b)) for i, (a, b) in enumerate(zip(x, y))]
    r = cells(workspace(spark, rows), QuerySpec("v", Measure("corr", x="x", y="y"), ("g",))).first()
    assert r["value"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
    left = [abs(np.corrcoef(np.delete(x, i), np.delete(y, i))[0, 1] - np.corrcoef(x, y)[0, 1]) for i in range(400)]
    assert r["influence"] == pytest.approx(max(left), abs=1e-6)


def test_constant_columns_have_no_correlation(spark):
    rows = [(f"p{i}", "flat", "h", 1e9 + 0.1, float(i)) for i in range(20)]
    rows += [(f"q{i}", "far", "h", -1e9 + 0.1, float(i)) for i in range(20)]
    table = cells(workspace(spark, rows), QuerySpec("v", Measure("corr", x="x", y="y"), ("g",))).collect()
    assert {r["value"] for r in table} == {None}
    assert G.release(workspace(spark, rows), QuerySpec("v", Measure("corr", x="x", y="y"), ("g",))).released.isEmpty()


def test_unconverged_models_keep_a_row(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_STEPS", 2)
    rows = [("m", 0, [0], 4.0, 1.0, 0.0, "poisson"), ("m", 1, [0, 1], 900.0, 1.0, 0.0, "poisson")]
    base = spark.createDataFrame(rows, "model_id string, cell int, idx array<int>, y double, w double, off double, family string")
    from functools import reduce

    out = reduce(lambda a, b: a.unionByName(b), M._reweighted(base)).collect()
    assert [(r["model_id"], r["estimable"]) for r in out] == [("m", False)]


def two_views(spark, rows):
    """Spending per visit and per person, over the same persons."""
    from cohortveil.study import Join, SumIf

    visits = spark.createDataFrame(rows, "person string, shop string, x double")
    people = visits.select("person").distinct().withColumn("kind", F.lit("k"))
    low = View(base="t", person="t.person", columns={"shop": "t.shop", "x": "t.x"}, dims={"shop": "cat"}, measures=("x",), population="people")
    high = View(base="p", person="p.person", joins=(Join("t", "p.person", "person", "left"),),
                columns={"kind": "p.kind", "total": SumIf("t.x", "t.shop", ("a", "b"))}, dims={"kind": "cat"}, measures=("total",),
                population="people")
    study = Study("two", {"t": {"person": "DI", "shop": "QI", "x": "S"}, "p": {"person": "DI", "kind": "QI"}}, {"low": low, "high": high},
                  quantities={"spend": {"low": "x", "high": "total"}})
    return Workspace(study, {"t": visits, "p": people})


def test_sums_of_one_quantity_on_two_views(spark):
    from cohortveil.plans.staged import Session
    from cohortveil.specs import Filter

    ws = two_views(spark, [(f"p{i}", "ab"[i % 2], 1.0 + i % 5) for i in range(60)])
    low = lambda *f: QuerySpec("low", Measure("sum", "x"), (), f)
    high = lambda *f: QuerySpec("high", Measure("sum", "total"), (), f)
    session = Session(ws, POLICY)
    assert session.request(low())[:2] == ("released", "")
    # the same contributions under another predicate
    assert session.request(high(Filter("kind", "==", "k")))[:2] == ("denied", "differencing")
    # equal predicates are the same cohort
    assert session.request(high())[:2] == ("released", "")
    far = Session(ws, POLICY)
    assert far.request(low(Filter("shop", "==", "a")))[0] == "released"
    assert far.request(high())[0] == "released"  # thirty persons contribute to one side only
    short = Session(ws, replace(POLICY, budget=1))
    assert short.request(low())[0] == "released" and short.request(high())[:2] == ("denied", "query_budget")
