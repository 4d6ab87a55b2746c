import random

import pytest
from pyspark.sql import functions as F

from cohortveil.operators import gateway as G
from cohortveil.operators import rules as R
from cohortveil.operators.cells import cells, contributions
from cohortveil.operators.measures import dominance
from cohortveil.operators.views import Workspace
from cohortveil.specs import Filter, Measure, QuerySpec
from cohortveil.study import Join, Policy, Study, StudyError, View

POLICY = Policy()


def tiny(spark, rows, domain=None):
    """A study of one table: person, group, x, y."""
    table = spark.createDataFrame(rows, "person string, g string, x double, y double")
    view = View(base="t", person="t.person", columns={"g": "t.g", "x": "t.x", "y": "t.y"},
                dims={"g": "cat"}, measures=("x", "y"))
    study = Study("tiny", {"t": {"person": "DI", "g": "QI", "x": "S", "y": "S"}}, {"v": view},
                  domains={"g": domain} if domain else {})
    return Workspace(study, {"t": table})


def judged(ws, measure, keys=("g",)):
    return {r["g"]: r for r in R.judge(cells(ws, QuerySpec("v", measure, keys)), keys, POLICY, ws.study).collect()}


def test_rules_on_a_hand_built_table(spark):
    rows = [(f"p{i}", "ok", 10.0, 1.0) for i in range(12)]
    rows += [(f"q{i}", "small", 10.0, 1.0) for i in range(9)]
    rows += [(f"r{i}", "whale", 1.0, 1.0) for i in range(12)] + [("w", "whale", 100.0, 1.0)]
    rows += [(f"s{i}", "typo", 10.0, 1.0) for i in range(12)]
    rows += [(f"t{i}", "inf", float("inf") if i == 0 else 5.0, 1.0) for i in range(12)]
    rows += [(f"u{i}", None, 10.0, 1.0) for i in range(12)]
    out = judged(tiny(spark, rows, ("ok", "small", "whale", "inf")), Measure("sum", "x"))
    assert out["ok"]["failed_rules"] == []
    assert out["small"]["failed_rules"] == ["small_cell"]
    assert out["whale"]["failed_rules"] == ["dominance"]
    assert out["typo"]["failed_rules"] == ["undeclared_cell_key"]
    assert set(out["inf"]["failed_rules"]) == {"dominance", "nonfinite_value"}
    assert out[None]["failed_rules"] == []


def test_zero_total_and_cancelling_contributions_are_withheld(spark):
    rows = [(f"p{i}", "zero", 50.0 if i % 2 else -50.0, 1.0) for i in range(20)]
    rows += [(f"q{i}", "one", 50.0 if i % 2 else -50.0, 1.0) for i in range(20)] + [("w", "one", 137.0, 1.0)]
    out = judged(tiny(spark, rows), Measure("sum", "x"))
    assert out["zero"]["failed_rules"] == ["dominance"]
    assert out["one"]["dominance"] == pytest.approx(1.0)


def test_count_of_persons_not_rows(spark):
    rows = [("hyper", "g", 1.0, 1.0)] * 900 + [(f"p{i}", "g", 1.0, 1.0) for i in range(8)]
    out = judged(tiny(spark, rows), Measure("count"))
    assert out["g"]["n"] == 908 and out["g"]["n_persons"] == 9 and out["g"]["failed_rules"] == ["small_cell"]


def test_missing_measure_leaves_rows_out(spark):
    rows = [(f"p{i}", "g", 1.0 if i < 2 else None, 1.0) for i in range(12)]
    out = judged(tiny(spark, rows), Measure("mean", "x"))
    assert (out["g"]["n"], out["g"]["n_persons"]) == (2, 2)


def test_influence_equals_leaving_each_person_out(spark):
    rng = random.Random(3)
    rows = [(f"p{i % 15}", "ab"[i % 2], rng.random(), rng.random()) for i in range(90)]
    rows += [("z", "a", 30.0, 40.0)]
    got = {r["g"]: r["influence"] for r in cells(tiny(spark, rows), QuerySpec("v", Measure("corr", x="x", y="y"), ("g",))).collect()}

    def r(pts):
        n = len(pts)
        mx, my = sum(p[2] for p in pts) / n, sum(p[3] for p in pts) / n
        sxy = sum((p[2] - mx) * (p[3] - my) for p in pts)
        return sxy / (sum((p[2] - mx) ** 2 for p in pts) * sum((p[3] - my) ** 2 for p in pts)) ** 0.5

    for g in "ab":
        mine = [p for p in rows if p[1] == g]
        want = max(abs(r(mine) - r([p for p in mine if p[0] != who])) for who in {p[0] for p in mine})
        assert got[g] == pytest.approx(want, abs=1e-9)


def test_person_whose_removal_destroys_the_correlation_has_infinite_influence(spark):
    rows = [(f"p{i}", "g", 0.0, float(i)) for i in range(11)] + [("z", "g", 15.0, 3.0)]
    row = cells(tiny(spark, rows), QuerySpec("v", Measure("corr", x="x", y="y"), ("g",))).first()
    assert row["influence"] == float("inf")
    whole = cells(tiny(spark, rows), QuerySpec("v", Measure("corr", x="x", y="y"))).first()
    assert whole["influence"] == float("inf") and whole["n_persons"] == 12


def sequential(table, keys, base=5):
    """The one-margin-at-a-time rule, on plain Python rows."""
    live = {i for i, r in enumerate(table) if not r["out"]}
    text = lambda r: "|".join("" if r[k] is None else str(r[k]) for k in keys)
    levels = [(k, v) for k in keys for v in dict.fromkeys(r[k] for r in table)]
    changed = True
    while changed:
        changed = False
        for k, v in levels:
            whole = [i for i, r in enumerate(table) if r[k] == v]
            rest = [i for i in whole if i in live]
            if len(whole) - len(rest) == 1 and rest:
                live.remove(min(rest, key=lambda i: (round(table[i]["n"] / base), text(table[i]))))
                changed = True
    return {text(table[i]) for i in live}


@pytest.mark.parametrize("seed", range(4))
def test_complementary_suppression_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    names = [("a", ["x", "y", "z", None]), ("b", ["1", "2", "3"]), ("c", ["u", "v"])][: 2 + seed % 2]
    table, keys = [], [n for n, _ in names]

    def fill(prefix, rest):
        if not rest:
            n = rng.choice([3, 12, 14, 15, 21, 22, 40])
            table.append({**prefix, "n": n, "out": rng.random() < 0.25})
            return
        for level in rest[0][1]:
            if rng.random() < 0.9:
                fill({**prefix, rest[0][0]: level}, rest[1:])

    fill({}, names)
    schema = ", ".join(f"{k} string" for k in keys) + ", n long, failed_rules array<string>"
    df = spark.createDataFrame([(*(r[k] for k in keys), r["n"], ["small_cell"] if r["out"] else []) for r in table], schema)
    out = G.complementary(df, keys, POLICY).where(~R.fails())
    got = {"|".join(r[k] or "" for k in keys) for r in out.collect()}
    assert got == sequential(table, keys)


def test_one_missing_cell_takes_the_smallest_released_count(spark):
    rows = [("a", 3, ["small_cell"]), ("b", 12, []), ("c", 11, []), ("d", 40, [])]
    df = spark.createDataFrame(rows, "g string, n long, failed_rules array<string>")
    kept = {r["g"] for r in G.complementary(df, ["g"], POLICY).where(~R.fails()).collect()}
    assert kept == {"c", "d"}          # 12 and 11 both release as 10; "b" is first by key


def test_finalised_order_and_helpers(spark):
    df = spark.createDataFrame([("b", 11, 11, 0.1), ("a", 12, 12, 0.1), ("c", 48, 40, 0.2)],
                               "g string, n long, n_persons long, dominance double")
    out = G.finalise(df, ["g"], POLICY)
    assert out.columns == ["g", "n"]
    assert [tuple(r) for r in out.collect()] == [("c", 50), ("a", 10), ("b", 10)]


def test_identifier_column_is_refused(spark):
    ws = tiny(spark, [("p", "g", 1.0, 1.0)])
    with pytest.raises(StudyError):
        G.vet(ws.tables["t"].withColumn("n", F.lit(20)), ["g"], POLICY, ws.study, "count")
    with pytest.raises(StudyError):
        G.vet(ws.tables["t"].select(F.lit(20).alias("n")), ["g"], POLICY, ws.study, "count")
    with pytest.raises(StudyError):
        G.check_columns(ws.tables["t"], ["g", "n"])


def test_nothing_released_is_a_denial(spark):
    out = G.release(tiny(spark, [("p", "g", 1.0, 1.0)]), QuerySpec("v", Measure("count"), ("g",), (Filter("g", "==", "none"),)))
    assert out.status.first()["status"] == "denied"


def test_release_ignores_row_order_and_partitions(spark):
    rows = [(f"p{i % 40}", "abc"[i % 3], float(i % 17), 1.0) for i in range(300)]
    spec = QuerySpec("v", Measure("sum", "x"), ("g",))
    one = G.release(tiny(spark, rows), spec).released.collect()
    ws = tiny(spark, list(reversed(rows)))
    ws.tables["t"] = ws.tables["t"].repartition(7)
    assert G.release(ws, spec).released.collect() == one


def test_early_sums_equal_joined_rows(spark):
    """A view whose base carries the person is summed before its joins."""
    facts = spark.createDataFrame([(i, i % 7, f"k{i % 3}", i % 5 * 1.5) for i in range(200)], "id long, who long, k string, x double")
    people = spark.createDataFrame([(w, f"s{w % 2}") for w in range(6)] + [(3, "s9")], "who long, s string")
    view = View(base="f", person="f.who", joins=(Join("p", "f.who", "who"),),
                columns={"k": "f.k", "s": "p.s", "x": "f.x"}, dims={"k": "cat", "s": "cat"}, measures=("x",))
    study = Study("early", {"f": {"id": "meta", "who": "DI", "k": "QI", "x": "S"}, "p": {"who": "DI", "s": "QI"}}, {"v": view})
    ws = Workspace(study, {"f": facts, "p": people})
    got = {tuple(r) for r in contributions(ws, QuerySpec("v", Measure("sum", "x"), ("k", "s"), (Filter("k", "!=", "k1"),))).collect()}
    want = (facts.join(people, "who").where("k <> 'k1'").groupBy("k", "s", "who").agg(F.count("*"), F.sum("x")))
    assert got == {tuple(r) for r in want.collect()}


def test_external_rules_and_unsafe_rule_names(spark):
    rows = [("p%d" % i, "pair", 1.0, 1.0) for i in range(10)] + [("w1", "pair", 46.0, 1.0), ("w2", "pair", 46.0, 1.0)]
    ws = tiny(spark, rows)
    top = R.external_rules(R.top_two(contributions(ws, QuerySpec("v", Measure("sum", "x"), ("g",))), ["g"])).first()
    assert (top["persons"], top["largest"], top["second"]) == (12, 46.0, 46.0)
    assert top["failed_rules"] == ["nk-rule"]
    alone = R.top_two(contributions(ws, QuerySpec("v", Measure("sum", "x"))), []).first()
    assert (alone["persons"], alone["second"]) == (12, 46.0)
    name = spark.range(1).select(R.safe_rule_name(F.lit("<script>")).alias("a"), R.safe_rule_name(F.lit(" P-Ratio")).alias("b")).first()
    assert tuple(name) == ("unnamed", "p-ratio")


def test_dominance_of_missing_totals_is_infinite(spark):
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) a").select(dominance(F.col("a"), F.col("a"), F.col("a")).alias("d")).first()
    assert row["d"] == float("inf")
