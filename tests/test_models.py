import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortveil.functions import tails
from cohortveil.operators import cellstats as S
from cohortveil.operators import models as M
from cohortveil.specs import GlmSpec
from cohortveil.studies import shop
from tests.conftest import SF


def test_tails_match_identities_and_tables():
    assert tails.student_upper(1.0, 1) == pytest.approx(0.25, abs=1e-12)              # Cauchy
    assert tails.student_upper(2.228, 10) == pytest.approx(0.025, abs=2e-5)
    assert tails.student_upper(-2.228, 10) == pytest.approx(0.975, abs=2e-5)
    assert tails.chi2_upper(3.0, 2) == pytest.approx(math.exp(-1.5), abs=1e-12)
    assert tails.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=2e-5)
    assert tails.f_upper(4.0, 1, 7) == pytest.approx(2 * tails.student_upper(2.0, 7), abs=1e-12)
    assert tails.f_upper(3.3258, 5, 10) == pytest.approx(0.05, abs=2e-5)
    assert tails.normal_upper(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert tails.gamma_upper(0.5, 0.5) == pytest.approx(math.erfc(math.sqrt(0.5)), abs=1e-12)
    assert tails.beta_regularised(0.3, 1, 1) == pytest.approx(0.3, abs=1e-12)
    assert tails.beta_regularised(0.25, 2, 5) == pytest.approx(0.46606445, abs=1e-8)
    assert tails.pearson_two_sided(0.5, 10) == pytest.approx(2 * tails.student_upper(0.5 * math.sqrt(8 / 0.75), 8), abs=1e-12)
    assert math.isnan(tails.pearson_two_sided(0.5, 2)) and tails.pearson_two_sided(1.0, 5) == 0.0
    assert tails.f_upper(0.0, 2, 3) == 1.0 and math.isnan(tails.f_upper(float("nan"), 2, 3))
    big = tails.student_upper(np.array([0.1, 1.0, 5.0]), 1e6)
    # the t tail exceeds the normal one by about (z⁴ + z²)/(4·df) of it
    assert big == pytest.approx(tails.normal_upper(np.array([0.1, 1.0, 5.0])), rel=1e-3)


def synthetic(seed=1):
    rng = random.Random(seed)
    rows = []
    for a in ("x", "y", "z"):
        for b in ("p", "q"):
            for _ in range(rng.randint(30, 60)):
                eta = {"x": 0.0, "y": 0.4, "z": -0.3}[a] + {"p": 0.0, "q": 0.5}[b]
                rows.append((a, b, 3 + eta + rng.gauss(0, 1), rng.random() < 1 / (1 + math.exp(-eta)),
                             np.random.default_rng(rng.randint(0, 10 ** 9)).poisson(math.exp(eta))))
    return rows


def dense(rows):
    return np.array([[1, a == "y", a == "z", b == "q"] for a, b, *_ in rows], dtype=float)


def irls(x, y, family):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        eta = x @ beta
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
        w = mu * (1 - mu) if family == "binomial" else mu
        beta = np.linalg.solve(x.T @ (w[:, None] * x), x.T @ (w * (eta + (y - mu) / w)))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ (w[:, None] * x))))


def test_cells_give_the_row_level_fit(spark):
    """Grouped fits equal ordinary row-level fits of all three families at once."""
    rows = synthetic()
    df = spark.createDataFrame([(a, b, g, bool(t), int(k)) for a, b, g, t, k in rows], "a string, b string, g double, t boolean, k long")
    cell = df.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("g").alias("mean"), F.sum(F.col("g") * F.col("g")).alias("sum_sq"),
                                    F.sum(F.col("t").cast("int")).alias("k"), F.sum("k").cast("double").alias("sum"))
    long = None
    for family in ("gaussian", "binomial", "poisson"):
        part = M.as_model_cells(cell, family, family, ("a", "b"))
        long = part if long is None else long.unionByName(part)
    study = shop.study()
    fitted, solved = M.fit(long, study)
    coefs = M.coefficients(M.level_positions(long, study), solved, M.summaries(fitted)).collect()
    got = {(r["model_id"], r["term"], r["level"]): (r["estimate"], r["std_error"]) for r in coefs}
    x = dense(rows)
    names = [("(intercept)", ""), ("a", "y"), ("a", "z"), ("b", "q")]
    y = np.array([r[2] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    disp = ((y - x @ beta) ** 2).sum() / (len(y) - 4)
    want = {"gaussian": (beta, np.sqrt(disp * np.diag(np.linalg.inv(x.T @ x)))),
            "binomial": irls(x, np.array([float(r[3]) for r in rows]), "binomial"),
            "poisson": irls(x, np.array([float(r[4]) for r in rows]), "poisson")}
    for family, (b, se) in want.items():
        for i, name in enumerate(names):
            assert got[(family, *name)] == pytest.approx((b[i], se[i]), abs=1.1e-4), (family, name)
    tss = ((y - y.mean()) ** 2).sum()
    r2 = M.summaries(fitted).where("family = 'gaussian'").first()["r_squared"]
    assert r2 == pytest.approx(1 - ((y - x @ beta) ** 2).sum() / tss, abs=1e-9)


def test_unestimable_models_are_left_out(spark):
    cell = spark.createDataFrame([("x", "p", 10, 5.0, 300.0), ("y", "q", 10, 6.0, 400.0)], "a string, b string, n long, mean double, sum_sq double")
    aliased = M.as_model_cells(cell, "holes", "gaussian", ("a", "b"))
    whole = M.as_model_cells(cell, "fine", "gaussian", ("a",))
    fitted, solved = M.fit(aliased.unionByName(whole), shop.study())
    assert [r["model_id"] for r in solved.collect()] == ["fine"]
    entries = [("m", 0, 0, 2.0), ("m", 0, 1, 2.0), ("m", 1, 0, 2.0), ("m", 1, 1, 2.0), ("m", 0, -1, 1.0), ("m", 1, -1, 1.0)]
    df = spark.createDataFrame(entries, "model_id string, i int, j int, v double")
    assert not df.groupBy("model_id").applyInPandas(M._solve, M._SOLVED).first()["estimable"]


def test_refit_from_released_cells_and_partial_release(spark):
    ws = shop.workspace(spark, SF)
    spec = GlmSpec("customer_sales", "gaussian", "total_price", ("r_name",))
    first = M.release_model(ws, spec)
    assert first.status == "released"
    again = M.fit_released(first.cells.drop("sum_sq"), spec, ws.study)
    assert again.coefficients.columns == ["model_id", "term", "level", "estimate"]
    a = {(r["term"], r["level"]): r["estimate"] for r in first.coefficients.collect()}
    assert a == {(r["term"], r["level"]): r["estimate"] for r in again.coefficients.collect()}
    assert again.summary.first()["dispersion_released"] is False


def test_small_cells_deny_a_model(spark):
    out = M.release_model(shop.workspace(spark, SF), GlmSpec("sales", "gaussian", "o_totalprice", ("n_name", "c_mktsegment")))
    assert out.status == "denied" and out.coefficients is None


def test_degenerate_normality_and_series(spark):
    flat = spark.createDataFrame([("a", 10, 50.0, 250.0, 1250.0, 6250.0), ("b", 3, 6.0, 14.0, 36.0, 98.0)],
                                 "g string, n long, sum double, sum_sq double, sum_cube double, sum_quad double")
    assert all(math.isnan(r["jarque_bera"]) and math.isnan(r["p_value"]) for r in S.normality(flat, "g").collect())
    same = spark.createDataFrame([(t, 5.0, 10) for t in range(8)], "t int, value double, n long")
    got = {r["quantity"]: r["value"] for r in S.series_diagnostics(same, "t").collect()}
    assert got["n_windows"] == 8 and got["trend_slope"] == 0 and math.isnan(got["dominant_period"]) and math.isnan(got["acf_lag_1"])
    wave = spark.createDataFrame([(t, round(10 * math.cos(2 * math.pi * t / 4), 6), 10) for t in range(12)], "t int, value double, n long")
    got = {r["quantity"]: r["value"] for r in S.series_diagnostics(wave, "t").collect()}
    assert got["dominant_period"] == 4.0 and got["dominant_period_share"] == pytest.approx(1.0, abs=1e-4)
