"""Sweeps over all group-bys, added up to cells where the persons are."""

import random
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cohortveil.operators import cells as C
from cohortveil.operators import lattice
from cohortveil.operators import rules as R
from cohortveil.operators.views import Workspace
from cohortveil.session import cut
from cohortveil.study import Join, Study, View

DIMS = ("flag", "home", "kind", "wave")
BIG = Decimal(10) ** 21


def study(person="t.person"):
    view = View(base="t", person=person, joins=(Join("p", "t.link", "key"),),
                columns={"kind": "t.kind", "wave": "t.wave", "flag": "p.flag", "home": "p.home", "x": "t.x", "hit": "t.hit"},
                dims={"kind": "cat", "wave": "int", "flag": "bool", "home": "cat"}, measures=("x",), population="people")
    return Study("joined", {"t": {"person": "DI", "link": "R", "kind": "QI", "wave": "QI", "x": "S", "hit": "QI"},
                            "p": {"key": "R", "flag": "QI", "home": "QI"}}, {"v": view}, domains={})


def rows_of(seed, amount):
    """Facts, and a joined table in which a key can come twice, alike or not; a fact's person can differ from its key."""
    rng = random.Random(seed)
    facts = []
    for _ in range(400):
        person = rng.choice([None, *range(40)])
        link = person if rng.random() < 0.9 else rng.randrange(40)
        facts.append((None if person is None else f"u{person}", link, rng.choice(["a", "b", "", None]), rng.choice([1, 2, None]), amount(rng), rng.random() < 0.3))
    homes = [(k, rng.choice([True, False, None]), rng.choice(["n", "s", None])) for k in range(40)]
    return facts, homes + homes[:5] + [(k, False, "other") for k in range(3, 9)]


def workspace(spark, facts, homes, kind):
    t = spark.createDataFrame(facts, f"person string, link int, kind string, wave int, x {kind}, hit boolean")
    return Workspace(study(), {"t": cut(t), "p": cut(spark.createDataFrame(homes, "key int, flag boolean, home string"))})


def expected(facts, homes):
    """(grouping, dims…) → persons → [rows, sum, hits]."""
    out = {}
    for person, link, kind, wave, x, hit in facts:
        for key, flag, home in homes:
            if x is None or link is None or key != link:
                continue
            row = {"flag": flag, "home": home, "kind": kind, "wave": wave}
            for k in range(4):
                for keys in combinations(DIMS, k):
                    cell = ("+".join(keys), *(row[d] if d in keys else None for d in DIMS))
                    own = out.setdefault(cell, {}).setdefault(person, [0, 0, 0])
                    own[0], own[1], own[2] = own[0] + 1, own[1] + x, own[2] + hit
    return out


@pytest.mark.parametrize("kind, amount", [
    ("decimal(12,2)", lambda r: Decimal(r.randrange(-300, 900)) / 100), ("int", lambda r: r.randrange(-5, 9)),
    ("double", lambda r: r.choice([None, r.randrange(-8, 16) / 4])), ("decimal(30,2)", lambda r: BIG * r.randrange(-3, 9) + r.randrange(99))])
def test_sweep_over_joined_dimensions_that_may_differ_within_a_person(spark, kind, amount):
    facts, homes = rows_of(7, amount)
    ws = workspace(spark, facts, homes, kind)
    assert lattice.joined_dims(ws, "v", DIMS) == ["flag", "home"]
    persons = cut(C.sweep_persons(ws, "v", "x", hits="hit", two=True))
    swept = {(r["grouping"], *(r[d] for d in DIMS)): r for r in C.swept_cells(persons, DIMS).collect()}
    top = {(r["grouping"], *(r[d] for d in DIMS)): r for r in R.top_two(persons, ("grouping", *DIMS), "_c1").collect()}
    want = expected(facts, homes)
    # a row is a cell: before, it was a person in a cell
    assert persons.count() == len(want) and set(swept) == set(top) == set(want)
    for cell, own in want.items():
        sums = sorted((v[1] for v in own.values()), reverse=True)
        got = swept[cell]
        assert (got["n"], got["n_persons"], got["k"], got["k_persons"]) == (
            sum(v[0] for v in own.values()), len(own), sum(v[2] for v in own.values()), sum(v[2] > 0 for v in own.values())), cell
        assert got["s1"] == sum(sums), cell
        total, most = float(abs(sum(sums))), float(max(map(abs, sums)))
        share = max(most / float(sum(map(abs, sums))), most / total) if total else float("inf")
        assert got["dominance1"] == pytest.approx(share), cell
        assert (top[cell]["persons"], top[cell]["total"], top[cell]["largest"]) == (len(own), sum(sums), sums[0]), cell
        assert top[cell]["second"] == (sums[1] if len(sums) > 1 else None), cell


def test_top_two_of_a_sweep_is_that_of_its_persons(spark):
    facts, homes = rows_of(3, lambda r: float(r.choice([2, 2, 2, 5, -1])))
    ws = workspace(spark, facts, homes, "double")
    persons = C.sweep_persons(ws, "v", "x", ["home", "kind"], two=True)
    both = cut(ws.per_person("v", ["home", "kind"], (), ("x",), lambda c: {"contribution": c("x")}))
    want = sorted(map(repr, R.top_two(both, ["home", "kind"]).collect()))
    assert sorted(map(repr, R.top_two(persons.where("grouping = 'home+kind'"), ["home", "kind"], "_c1").collect())) == want


def test_amounts_keep_every_digit():
    kind = pa.decimal128(38, 2)
    for values in ([0, 1, -1, 2 ** 61], [2 ** 62, -5, 7], [2 ** 90, -(2 ** 90), -1], [-(2 ** 63), 1]):
        column = pa.chunked_array([pa.array([Decimal(v) / 100 for v in values], kind)])
        got = lattice._numbers(column.slice(1))
        assert [int(v) for v in got] == values[1:]
        back = lattice._column(got, kind, np.array([True] + [False] * (len(values) - 2)))
        assert back.to_pylist() == [None] + [Decimal(v) / 100 for v in values[2:]]


def test_many_levels_are_numbered_within_64_bits():
    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 2 ** 20, 500) for _ in range(5)]
    got = lattice._joint(codes, 500)
    assert got.max() < 2 ** 31 and len(np.unique(got)) == len({c for c in zip(*codes)})


def test_models_of_one_column_share_a_sweep(spark, monkeypatch):
    """Each response and family swept the view anew."""
    from tests.conftest import SF
    from veil_queries import model_fits
    seen, sweep = [], C.sweep_cells
    monkeypatch.setattr(C, "sweep_cells", lambda ws, view, column, **k: seen.append((view, column)) or sweep(ws, view, column, **k))
    _, long = model_fits.releasable_models(spark, SF)
    assert len(seen) == len(set(seen)) == 4
    kinds = {":".join(r["model_id"].split(":")[:2]) for r in long.select("model_id").distinct().collect()}
    assert kinds <= {"gaussian:o_totalprice", "binomial:is_urgent", "gaussian:total_price", "gaussian:open_orders",
                     "poisson:open_orders", "poisson:urgent_orders"} and len(kinds) > 3
