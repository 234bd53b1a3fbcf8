"""Order statistics in parts against sorting everything, with limits so small that every path is taken."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import ranges, reshape
from causeway.plans import dml, robust, staggered
from causeway.spec import PanelSpec


def _numbers():
    r = np.random.default_rng(0)
    return {
        "normal": list(r.normal(0, 1, 900)),
        "skewed": list(np.exp(r.normal(0, 9, 700))),
        "ties": [float(v) for v in r.integers(0, 3, 800)],
        "same": [7.0] * 50,
        "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, *r.normal(0, 1e300, 300)],
        "one": [3.5],
        "none": [],
    }


@pytest.mark.parametrize("small, buckets", [(4096, 1024), (5, 4), (1, 3)])
def test_quantiles_by_sorting(spark, monkeypatch, small, buckets):
    monkeypatch.setattr(ranges, "SMALL", small)
    monkeypatch.setattr(ranges, "BUCKETS", buckets)
    numbers, shares = _numbers(), [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    n = max(map(len, numbers.values()))
    rows = [tuple(float(v[i]) if i < len(v) else (None if i % 2 else float("nan")) for v in numbers.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in numbers))
    got = ranges.exact_quantiles(df, {k: shares for k in numbers})
    for k, v in numbers.items():
        with np.errstate(over="ignore"):
            want = np.quantile(v, shares) if v and k != "wide" else [None] * len(shares)
        if k == "wide":
            at = [q * (len(v) - 1) for q in shares]
            s = sorted(v)
            want = [s[int(a)] if a == int(a) else (int(a) + 1 - a) * s[int(a)] + (a - int(a)) * s[int(a) + 1] for a in at]
        assert got[(k,)] == pytest.approx(list(want), rel=1e-12) if v else got[(k,)] == want


def test_quantiles_of_groups_and_months(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SMALL", 10)
    r = np.random.default_rng(1)
    rows = [(int(i % 3) if i % 7 else None, float(r.normal(i % 3, 1))) for i in range(500)]
    got = ranges.exact_quantiles(spark.createDataFrame(rows, "g int, x double"), {"x": [0.5]}, ["g"])
    for g in (None, 0, 1, 2):
        assert got[g, "x"][0] == pytest.approx(np.median([x for k, x in rows if k == g]))
    days = spark.createDataFrame(rows, "g int, x double").withColumn("ts", F.to_timestamp(F.concat(F.lit("2020-0"), (F.coalesce("g", F.lit(3)) + 1).cast("string"), F.lit("-05"))))
    months = {m["month"]: m["value"] for m in reshape.aggregate_by_month(days, "ts", "here", "x", "median").collect()}
    assert months[1] == pytest.approx(got[0, "x"][0]) and months[4] == pytest.approx(got[None, "x"][0]) and len(months) == 4


@pytest.mark.parametrize("small, buckets, spread", [(4096, 1024, 1 << 61), (3, 4, 1 << 61), (3, 4, 5), (2, 8, 1)])
def test_kth_of_each_draw_by_sorting(spark, monkeypatch, small, buckets, spread):
    monkeypatch.setattr(ranges, "SMALL", small)
    monkeypatch.setattr(ranges, "BUCKETS", buckets)
    r = np.random.default_rng(2)
    pairs = [(d, int(r.integers(-spread, spread)), e) for d in (1, 2, 3) for e in range(60)]
    got = ranges.kth_of_each_draw(spark.createDataFrame(pairs, "draw int, key long, _e long"), 3, [1, 7, 30, 60, 61], 60)
    for d in (1, 2, 3):
        own = sorted((k, e) for x, k, e in pairs if x == d)
        assert all(got[d, k] == own[k - 1] for k in (1, 7, 30, 60)) and (d, 61) not in got


def test_permutations_choose_as_many_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SMALL", 8)
    units = spark.range(200).withColumnRenamed("id", "_e")
    same = lambda e, s: e % 2  # noqa: E731  # many ties: by id
    for order in (None, same):
        dealt = robust._dealt(units, 5, [30, 0, 50, 120], 200, 1, order).select("draw", "_part", "_e").collect()
        for d in range(1, 6):
            own = [r for r in dealt if r["draw"] == d]
            assert [sum(r["_part"] == p for r in own) for p in range(5)] == [30, 0, 50, 120, 0]
    assert sorted(r["_e"] for r in dealt if r["draw"] == 1 and r["_part"] == 0) == list(range(0, 60, 2))
    first, again = ({(r["draw"], r["_e"]) for r in robust._dealt(units.repartition(n), 3, [20], 200, 4, None).where("_part = 0").collect()} for n in (2, 9))
    assert first == again and len({frozenset(e for d, e in first if d == k) for k in (1, 2, 3)}) == 3


def test_nearest_controls_across_ranges(spark, monkeypatch):
    """Ranges of a few scores each, some without a control; a third of the units share one score."""
    monkeypatch.setattr(ranges, "ROWS_A_RANGE", 6)
    r = np.random.default_rng(3)
    x = np.where(np.arange(300) % 3 == 0, 0.25, np.round(r.normal(0, 1, 300), 2))
    t = (r.random(300) < 1 / (1 + np.exp(-1.5 * x))).astype(int)
    df = spark.createDataFrame([(int(i), float(x[i]), int(t[i]), float(x[i] * 2 + i % 5)) for i in range(300)], "u long, x double, t int, y double").repartition(5)
    ps = {p["u"]: p["ps"] for p in dml.propensity(df, "t", ["x"], keep=["u"]).collect()}
    got = {m["unit"]: m for m in dml.matched(df, "y", "t", ["x"], "u").collect()}
    controls = [i for i in range(300) if not t[i]]
    assert got.keys() == {i for i in range(300) if t[i]}
    for i, m in got.items():
        best = min(controls, key=lambda c: (abs(ps[c] - ps[i]), ps[c], -c))
        assert m["match_ps"] == pytest.approx(ps[best], rel=1e-12) and m["match_y"] == pytest.approx(x[best] * 2 + best % 5)
    near = dml.matched(df, "y", "t", ["x"], "u", caliper=0.001).collect()
    assert len(near) == len(got) and 0 < sum(m["match_ps"] is None for m in near) == sum(abs(m["match_ps"] - m["ps"]) > 0.001 for m in got.values())
    assert dml.matched(df.where("t = 1"), "y", "t", ["x"], "u").count() == 0


def test_doubly_robust_by_pair(spark):
    """Every pair of cohort and period on its own, written out in numpy; one cohort has nine controls in its period."""
    r = np.random.default_rng(5)
    rows = []
    for e in range(160):
        ft = [None, 2.0, 3.0, None][e % 4]
        a, b = r.normal(), r.normal(3, 2)
        for t in range(5):
            if not (t == 4 and e % 4 in (0, 3) and e > 17):
                rows.append((e, t, float(a + t * b * 0.1 + (ft is not None and t >= ft) * (1 + b) + r.normal(0, 0.1)), float(b + 0.01 * t), float(a), ft))
    df = spark.createDataFrame(rows, "e long, t int, y double, c double, k double, ft double")
    spec = PanelSpec(entity="e", time="t", outcome="y", first_treated="ft", controls=("c", "k"))
    got = {(x["g"], x["t"]): x for x in staggered.att_gt(df, spec).collect()}
    cell = {(e, t): (y, c, k) for e, t, y, c, k, _ in rows}
    cohort = {e: ft for e, *_, ft in rows}
    assert got.keys() == {(2.0, 2.0), (2.0, 3.0), (2.0, 4.0), (3.0, 3.0), (3.0, 4.0)}
    for (g, t), x in got.items():
        own = [e for e in cohort if cohort[e] in (None, g) and (e, t) in cell and (e, g - 1) in cell]
        d = np.array([cohort[e] == g for e in own], float)
        dy = np.array([cell[e, t][0] - cell[e, g - 1][0] for e in own])
        z = np.array([cell[e, g - 1][1:] for e in own])
        z = np.column_stack([np.ones(len(own)), (z - z.mean(axis=0)) / z.std(axis=0)])
        b = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ b))
            b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (d - p))
        p = np.clip(1 / (1 + np.exp(-z @ b)), 0.01, 0.99)
        c = d == 0
        gamma = np.linalg.lstsq(z[c], dy[c], rcond=None)[0] if c.sum() >= 10 else np.zeros(3)
        u, w1, w0 = dy - z @ gamma, d / d.mean(), p * (1 - d) / (1 - p)
        w0 = w0 / w0.mean()
        m1, m0 = (w1 * u).mean(), (w0 * u).mean()
        f = w1 * (u - m1) - w0 * (u - m0)
        assert (x["att"], x["se"]) == (pytest.approx(m1 - m0, rel=1e-6), pytest.approx(math.sqrt(f.var() / len(own)), rel=1e-6))
        assert (x["n_treated"], x["n_control"]) == (int(d.sum()), int(c.sum()))
    assert got[2.0, 4.0]["n_control"] == 9
    assert staggered.att_gt(df.where("ft is null"), spec).count() == 0
