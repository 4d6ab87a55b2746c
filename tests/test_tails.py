import math

import numpy as np
import pytest

from cohortveil.functions import tails as T


@pytest.mark.parametrize("a", [1e4, 1e5, 1e6, 1e9])
def test_gamma_at_its_mean_for_large_shapes(a):
    # Q(a, a) = 1/2 - 1 / (3 sqrt(2 pi a)) + O(a^-3/2)
    assert float(T.gamma_upper(a, a)) == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * a)), abs=1e-8)


def test_gamma_forms_agree_where_they_meet():
    for z in (-3.0, -1.0, -0.04, 0.0, 0.03, 0.5, 2.0, 4.0):
        a = 9999.0
        x = a + z * math.sqrt(a)
        below = float(T.gamma_upper(a, x))
        assert float(T._gamma_upper_large(np.array(a), np.array(x))) == pytest.approx(below, rel=1e-7, abs=1e-12)


def test_beta_settles_for_large_arguments():
    # Student's tail with very many degrees of freedom is the normal tail
    assert float(T.student_upper(1.96, 1e9)) == pytest.approx(float(T.normal_upper(1.96)), rel=1e-5)
    assert float(T.beta_regularised(0.5, 1e6, 1e6)) == pytest.approx(0.5, abs=1e-6)
    assert float(T.student_upper(1.0, 1.0)) == pytest.approx(0.25, abs=1e-12)  # atan closed form
    assert float(T.f_upper(3.0, 2.0, 2.0)) == pytest.approx(0.25, abs=1e-12)  # 1 / (1 + f)


def test_unsettled_is_not_a_number(monkeypatch):
    monkeypatch.setattr(T, "MOST_STEPS", 2)
    assert np.isnan(T.beta_regularised(0.3, 50.0, 60.0))
