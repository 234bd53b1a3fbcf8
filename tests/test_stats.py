import math

import numpy as np
import pytest

from causeway.functions import stats


@pytest.mark.parametrize("p, df, t", [(0.05, 10, 2.228139), (0.01, 30, 2.749996), (0.05, 1, 12.706205)])
def test_t(p, df, t):
    assert stats.t_p(t, df) == pytest.approx(p, abs=1e-6)


def test_f_and_chi2():
    assert stats.f_p(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_p(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.f_p(2.5**2, 1, 20) == pytest.approx(stats.t_p(2.5, 20), abs=1e-12)


def test_normal():
    assert stats.normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert stats.normal_p(-1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert math.isnan(stats.t_p(1.0, 0))


def test_solve_with_collinear_columns():
    x = np.array([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])
    b = stats.solve(x.T @ x, x.T @ np.array([5.0, 10.0, 15.0]))
    assert x @ b == pytest.approx([5, 10, 15])
