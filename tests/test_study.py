from dataclasses import replace

import pytest

from cohortveil.operators.rules import denial_reasons
from cohortveil.operators.release_audit import egress
from cohortveil.specs import (FactorSpec, Filter, GlmSpec, Measure, QuerySpec, SeriesSpec, check_filters,
                              normal_form)
from cohortveil.studies import shop
from cohortveil.study import BandEdges, Join, Policy, StudyError

STUDY = shop.study()


def bad_view(**change):
    view = replace(STUDY.view("sales"), **change)
    return lambda: replace(STUDY, views={**STUDY.views, "sales": view})


@pytest.mark.parametrize("build", [
    bad_view(base="nowhere"),
    bad_view(joins=(Join("customer", "orders.o_custkey", "c_custkey"),) * 2),
    bad_view(dims={"missing": "cat"}),
    bad_view(time_dims=("r_name",)),
    bad_view(columns={**STUDY.view("sales").columns, "who": "orders.o_custkey"}),
    bad_view(measures=("nope",)),
    bad_view(responses={"o_totalprice": ("gamma",)}),
    lambda: replace(STUDY, tables={**STUDY.tables, "x": {"a": "??"}}),
    lambda: replace(STUDY, quantities={"q": {"sales": "o_totalprice"}}),
    lambda: replace(STUDY, bands={"order_year": shop.BALANCE_EDGES}),
    lambda: replace(STUDY, synonyms={"x": "nope"}),
    lambda: BandEdges((1, 2), (3,)),
    lambda: Policy(dominance=0.9),
    lambda: Policy(round_base=2),
])
def test_bad_declarations_are_refused(build):
    with pytest.raises(StudyError):
        build()


@pytest.mark.parametrize("f", [
    Filter("o_totalprice", "==", 1), Filter("r_name", "<", "ASIA"), Filter("r_name", "==", 3),
    Filter("order_year", "==", True), Filter("order_year", "in", []), Filter("order_year", "in", list(range(60))),
    Filter("is_urgent", "==", "yes"), Filter("balance", "==", 0), Filter("balance", ">=", 5),
    Filter("balance", "in", [0]),
])
def test_bad_filters_are_refused(f):
    with pytest.raises(StudyError):
        check_filters(STUDY, STUDY.view("sales"), [f])


def test_internal_filter_needs_edges():
    loose = replace(STUDY, bands={})
    with pytest.raises(StudyError):
        check_filters(loose, loose.view("sales"), [Filter("balance", ">=", 0)])


@pytest.mark.parametrize("spec", [
    QuerySpec("nope", Measure("count")),
    QuerySpec("sales", Measure("median", "o_totalprice")),
    QuerySpec("sales", Measure("count", "o_totalprice")),
    QuerySpec("sales", Measure("mean", "c_acctbal")),
    QuerySpec("sales", Measure("corr", x="c_acctbal", y="c_acctbal")),
    QuerySpec("sales", Measure("count"), ("r_name", "r_name")),
    QuerySpec("sales", Measure("count"), ("r_name", "n_name", "c_mktsegment", "order_year")),
    QuerySpec("sales", Measure("count"), ("balance",)),
    QuerySpec("sales", Measure("count"), (), tuple(Filter("order_year", "!=", y) for y in range(6))),
    GlmSpec("sales", "poisson", "o_totalprice", ("r_name",)),
    GlmSpec("sales", "binomial", "is_urgent", ("is_urgent",)),
    GlmSpec("sales", "gaussian", "o_totalprice", ()),
    FactorSpec("sales", "is_urgent", "r_name"),
    SeriesSpec("sales", "o_totalprice", "r_name"),
    SeriesSpec("sales", "o_totalprice", "order_year", "median"),
])
def test_bad_requests_are_refused(spec):
    with pytest.raises(StudyError):
        spec.check(STUDY)


def test_normal_form_ignores_order_and_single_lists():
    a = [Filter("x", "in", ["b"]), Filter("y", "==", 1), Filter("y", "==", 1)]
    b = [Filter("y", "==", 1), Filter("x", "==", "b")]
    assert normal_form(a) == normal_form(b)


def test_keys_and_roles():
    corr = lambda x, y: QuerySpec("sales", Measure("corr", x=x, y=y)).measure_key()
    assert corr("o_totalprice", "c_acctbal") == corr("c_acctbal", "o_totalprice")
    assert STUDY.quantity_of("sales", "o_totalprice") == "order_value"
    assert STUDY.population_of("sales") == "customers"
    assert "o_custkey" in STUDY.having_role("DI") and "o_totalprice" in STUDY.having_role("S")
    assert STUDY.having_role("R") >= {"n_nationkey"}


def test_schema_level_denials():
    assert denial_reasons(["o_custkey", "n"], STUDY) == ["identifier_egress"]
    assert denial_reasons(["o_totalprice"], STUDY) == ["raw_sensitive"]
    assert denial_reasons(["r_name", "props", "n"], STUDY) == ["free_text_egress"]
    assert denial_reasons(["r_name", "value", "n"], STUDY) == []
    assert egress(["r_name", "balance", "n"], STUDY) == ["internal_variable_egress"]
