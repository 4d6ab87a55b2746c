"""A sample of registered queries against their SQL; tests/oracle_check.py runs all."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle_check import compare, connect

SAMPLE = ("A2_mean", "A7_corr", "A12_marginals", "F2_comparison", "F5_band_range", "V3_person_rollup", "V8_dense_panel",
          "W1_dominance", "R11_complementary_one_key", "R17_safe_release", "R26_published_marginals", "D2_row_difference",
          "D7_total_deltas", "M11_anova", "M14_normality", "M18_trend", "T5_grounded_claims", "O1_undersized_released_cells")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    verdict, _, _ = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
