"""Synthetic control against a fine grid of weights and a general solver."""

import tracemalloc

import numpy as np
import pytest

from causeway.plans import confirm, synthetic
from causeway.spec import PanelSpec

SPEC = PanelSpec(entity="e", time="t", outcome="y")


def _panel(spark, y):
    return spark.createDataFrame([(e, t, float(v)) for e, row in enumerate(y) for t, v in enumerate(row)], "e long, t int, y double").repartition(3)


def test_hull_against_a_general_solver():
    r = np.random.default_rng(0)
    for n, periods in ((3, 5), (8, 4), (30, 6), (40, 12), (5, 1)):
        donors, target = r.normal(0, 1, (n, periods)), r.normal(0, 0.7, periods)
        donors[1] = donors[0]
        hull = synthetic.Hull(target, donors[n - 1], n - 1)
        for _ in range(500):
            k = int(np.argmin(donors @ hull.gap))
            if not hull.add(donors[k], k):
                break
        w = np.zeros(n)
        w[hull.rows] = hull.weights
        want = synthetic.simplex_weights(donors.T, target, rounds=20_000)
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and len(hull.rows) <= periods + 1
        assert np.linalg.norm(w @ donors - target) <= np.linalg.norm(want @ donors - target) + 1e-6


def test_three_donors_by_a_grid(spark):
    r = np.random.default_rng(1)
    y = np.cumsum(r.normal(0, 1, (4, 8)), axis=1)
    first = 6
    pre = np.arange(8) < first
    grid = np.array([(a, b, 1 - a - b) for a in np.linspace(0, 1, 401) for b in np.linspace(0, 1, 401) if a + b <= 1 + 1e-9])
    got = {x["e"] if "e" in x.asDict() else x["entity"]: x for x in synthetic.synthetic_control(_panel(spark, y), SPEC, 0, first).collect()}
    best = grid[np.argmin((((grid @ y[1:][:, pre]) - y[0][pre]) ** 2).sum(axis=1))]
    gap = y[0] - best @ y[1:]
    assert got[0]["treated"] and got[0]["att"] == pytest.approx(gap[~pre].mean(), abs=0.02) and got[0]["pre_rmse"] == pytest.approx(np.sqrt((gap[pre] ** 2).mean()), abs=0.002)
    for k in (1, 2, 3):  # placebos: of the two other donors, never the treated unit
        a, b = (j for j in (1, 2, 3) if j != k)
        w = np.linspace(0, 1, 2001)[:, None]
        fits = w * y[a] + (1 - w) * y[b]
        gap = y[k] - fits[np.argmin(((fits[:, pre] - y[k][pre]) ** 2).sum(axis=1))]
        assert got[k]["att"] == pytest.approx(gap[~pre].mean(), abs=0.01) and got[k]["pre_rmse"] == pytest.approx(np.sqrt((gap[pre] ** 2).mean()), abs=0.001)
    ratios = [x["ratio"] for x in got.values()]
    assert got[0]["p"] == sum(x >= got[0]["ratio"] for x in ratios) / 4
    gaps = synthetic.synthetic_gaps(_panel(spark, y), SPEC, 0, first).collect()
    assert [g["actual"] for g in gaps] == pytest.approx(list(y[0])) and np.mean([g["gap"] for g in gaps[first:]]) == pytest.approx(got[0]["att"])


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = _panel(spark, r.normal(0, 1, (23, 9)))
    one = {x["entity"]: x for x in synthetic.synthetic_control(df, SPEC, 3, 7).collect()}
    monkeypatch.setattr(synthetic, "BLOCK_CELLS", 60)
    many = {x["entity"]: x for x in synthetic.synthetic_control(df, SPEC, 3, 7).collect()}
    assert one.keys() == many.keys() and len(one) == 23
    for k, x in one.items():
        assert many[k]["att"] == pytest.approx(x["att"], abs=1e-6) and many[k]["p"] == x["p"]
    with pytest.raises(ValueError):
        synthetic.synthetic_control(df, SPEC, 99, 7)


def _sdid(y, k, others, pre):
    """Effect of unit ``k`` by the general solver, all donors in one matrix."""
    donors, after = y[others], int((~pre).sum())
    noise = np.diff(donors[:, pre], axis=1).std()
    w = synthetic.simplex_weights(donors[:, pre].T, y[k][pre], ridge=np.sqrt(after) * noise**2 * pre.sum(), intercept=True, rounds=50_000)
    lam = synthetic.simplex_weights(donors[:, pre], donors[:, ~pre].mean(axis=1), ridge=1e-6 * noise**2 * len(others), intercept=True, rounds=50_000)
    return (y[k][~pre].mean() - lam @ y[k][pre]) - (w @ donors[:, ~pre].mean(axis=1) - w @ (donors[:, pre] @ lam))


@pytest.mark.parametrize("n, periods, first", [(25, 8, 6), (9, 6, 4), (40, 5, 2)])
def test_did_by_blocks_against_a_general_solver(spark, monkeypatch, n, periods, first):
    """Donors are met where they lie, in blocks of targets and on from a few donors; no matrix of all is made."""
    monkeypatch.setattr(synthetic, "TARGETS", 7)
    monkeypatch.setattr(synthetic, "SAMPLE", 6)
    monkeypatch.setattr(synthetic, "TILE", 20)
    y = 50 + np.cumsum(np.random.default_rng(n).normal(0, 1, (n, periods)), axis=1)
    y[1] = y[2]
    pre = np.arange(periods) < first
    got = synthetic.synthetic_did(_panel(spark, y), SPEC, 0, first).first()
    others = list(range(1, n))
    assert got["donors"] == n - 1 and got["att"] == pytest.approx(_sdid(y, 0, others, pre), abs=1e-5)
    if n > 11:
        assert got["se"] == pytest.approx(np.std([_sdid(y, k, [j for j in others if j != k], pre) for k in others]), abs=1e-5)


def test_weights_of_many_donors_are_the_optimum():
    r = np.random.default_rng(4)
    c, b, rho = r.normal(0, 1, (4000, 4)), r.normal(0, 2, (30, 4)), np.full(30, 9.0)
    u = np.concatenate([np.ones((len(c), 1)), -c], axis=1)
    v, _ = synthetic.donor_weights(b, rho, lambda who, v: synthetic._active_sums(u, np.zeros(len(c)), v))
    w = np.maximum(v @ u.T, 0) / 9
    slope = (w @ c - b) @ c.T + 9 * w  # equal where a donor has weight, and nowhere less
    assert w.sum(axis=1) == pytest.approx(np.ones(30), abs=1e-8)
    assert np.abs(np.where(w > 0, slope - v[:, :1], 0)).max() < 1e-7 and (slope - v[:, :1]).min() > -1e-7


def test_time_weights_against_a_general_solver():
    r = np.random.default_rng(5)
    x = [r.normal(0, 1, (30, 6)) + r.normal(0, 1, (30, 1)) for _ in range(50)]
    x = [a - a.mean(axis=0) for a in x]
    got = synthetic.time_weights(np.stack([a.T @ a for a in x]), np.full(50, 0.01))
    for a, w in zip(x, got):
        assert w == pytest.approx(synthetic.simplex_weights(a[:, :-1], a[:, -1], ridge=0.01, rounds=50_000), abs=1e-4)


def test_equal_courses_have_no_noise(spark):
    y = np.arange(14.0)[:, None] + np.arange(6.0)
    y[0, 4:] += 3
    got = synthetic.synthetic_did(_panel(spark, y), SPEC, 0, 4).first()
    assert got["att"] == pytest.approx(3, abs=1e-6) and got["se"] == pytest.approx(0, abs=1e-6)


def test_a_batch_meets_a_block_of_targets_in_tiles():
    r = np.random.default_rng(6)
    y, x = r.normal(0, 1, (4000, 3)), r.normal(0, 1, (20_000, 3))
    tracemalloc.start()
    least, low = synthetic._least(y, x, [(k, k) for k in range(0, 4000, 2)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all products are 640 MB
    for k in (0, 1, 2, 3998, 3999, 4000, 19_999):
        g = y @ x[k]
        if k % 2 == 0 and k < 4000:
            g[k] = np.inf
        assert least[k] == g.argmin() and low[k] == pytest.approx(g.min())


def test_fit_of_the_treated_unit_needs_no_placebos(spark, monkeypatch):
    y = np.cumsum(np.random.default_rng(7).normal(0, 1, (12, 8)), axis=1)
    df = _panel(spark, y)
    want = synthetic.synthetic_control(df, SPEC, 3, 6).where("treated").first()["pre_rmse"]
    monkeypatch.setattr(synthetic, "synthetic_control", None)
    assert synthetic.pre_rmse(df, SPEC, 3, 6) == pytest.approx(want, abs=1e-9)
    verdict, values = confirm.DIAGNOSTICS["fit"][0](confirm.Case(df, SPEC, unit=3, first=6))
    assert values["pre_rmse"] == pytest.approx(want, abs=1e-9) and verdict in ("PASS", "FAIL")


def test_boxes_of_donors_give_the_sums_of_the_donors(monkeypatch):
    r = np.random.default_rng(8)
    c, g, v = r.normal(0, 1, (1000, 3)), r.normal(0, 1, 1000), r.normal(0, 1, (150, 4))
    c[300:600] = c[:300]
    v[7], v[8] = 0, [1, 0, 0, 0]
    u, number = np.concatenate([np.ones((1000, 1)), -c], axis=1), r.integers(1, 9, 1000)
    a, b = np.triu_indices(4)
    want = (v @ u.T > 0).astype(float) @ (np.concatenate([u[:, a] * u[:, b], u * g[:, None]], axis=1) * number[:, None])
    for near in (1, 4, 64):
        monkeypatch.setattr(synthetic, "NEAR", near)
        i, j = synthetic._near(c), synthetic._near(v)
        assert sorted(i) == list(range(1000)) and sorted(j) == list(range(150))
        assert synthetic._active_sums(u[i], g[i], v[j], number[i]) == pytest.approx(want[j], abs=1e-9)


def test_points_of_a_leaf_lie_in_its_half():
    r = np.random.default_rng(9)
    x = r.normal(0, 1, (4096, 2))
    leaf = synthetic._Tree.of(x, 6).leaf(x)
    assert np.bincount(leaf).tolist() == [64] * 64
    one = synthetic._Tree.of(np.repeat(x[:3], 50, axis=0), 4)  # equal points share a leaf
    assert len(set(one.leaf(x[:3]))) == 3
    assert synthetic._Tree.of(x[:1], 3).leaf(x).max() < 8


def test_a_start_without_donors_is_begun_anew_alone():
    r = np.random.default_rng(10)
    c, b, rho = r.normal(0, 1, (500, 2)), r.normal(0, 0.5, (20, 2)), np.full(20, 3.0)
    u, met = np.concatenate([np.ones((500, 1)), -c], axis=1), []

    def sums(who, v):
        met.append(len(who))
        return synthetic._active_sums(u, np.zeros(500), v)

    want, _ = synthetic.donor_weights(b, rho, sums)
    start = want.copy()
    start[4] = [-1.0, 0, 0]
    met.clear()
    got, _ = synthetic.donor_weights(b, rho, sums, start)
    assert met[0] == 20 and max(met[1:]) == 1
    assert got == pytest.approx(want, abs=1e-9)


def test_the_panel_is_worked_out_once_for_all_treated_units(spark):
    y = np.cumsum(np.random.default_rng(11).normal(0, 1, (30, 7)), axis=1)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = _panel(spark, y).mapInPandas(counted, "e long, t int, y double")
    got = synthetic.synthetic_did_multi(df, SPEC, {0: 4, 1: 5}).first()
    assert seen.value == 210
    one = [synthetic.synthetic_did(_panel(spark, y).where(f"e != {1 - k}"), SPEC, k, 4 + k).first() for k in (0, 1)]
    assert got["att"] == pytest.approx((3 * one[0]["att"] + 2 * one[1]["att"]) / 5) and got["se"] == pytest.approx(np.sqrt(np.mean([x["se"] ** 2 for x in one])))
    for k, x in enumerate(one):
        others, pre = list(range(2, 30)), np.arange(7) < 4 + k
        assert x["att"] == pytest.approx(_sdid(y, k, others, pre), abs=1e-5)
        assert x["se"] == pytest.approx(np.std([_sdid(y, i, [j for j in others if j != i], pre) for i in others]), abs=1e-5)


def test_periods_are_those_of_the_units_that_count(spark):
    """A period that only another treated unit has isn't asked of the donors; one that a donor has is, with or without a value."""
    y = np.cumsum(np.random.default_rng(12).normal(0, 1, (20, 6)), axis=1)
    row = lambda e, v: spark.createDataFrame([(e, 6, v)], "e long, t int, y double")
    df = _panel(spark, y)
    want = synthetic.synthetic_did(df.where("e != 1"), SPEC, 0, 3).first()
    with pytest.raises(ValueError, match="three donors are needed"):
        synthetic.synthetic_did_multi(df.union(row(0, 3.0)), SPEC, {0: 3, 1: 4})
    got = synthetic._did(df, synthetic._courses(df.union(row(1, 3.0)), SPEC).where("entity != 1"), SPEC, 0, 3).first()
    assert (got["att"], got["donors"]) == (pytest.approx(want["att"]), 18)
    with pytest.raises(ValueError, match="unit 0 isn't there"):
        synthetic.synthetic_did(df.union(row(5, None)), SPEC, 0, 3)
