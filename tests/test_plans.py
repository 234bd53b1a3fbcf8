import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.plans import confirm, cross_section, decide, did, robust, staggered, synthetic
from causeway.plans.gram import ols
from causeway.spec import Method, PanelSpec

SPEC = PanelSpec(entity="e", time="t", outcome="y", treated="d", post="p", first_treated="ft", controls=("x",))


def rows(effect=5.0, noise=0.0, missing=False, seed=1):
    r = np.random.default_rng(seed)
    out = []
    for e in range(24):
        for t in range(8):
            if missing and (e * 3 + t) % 7 == 0:
                continue
            d, p = float(e % 2 == 0), float(t >= 4)
            x = float(r.standard_normal())
            out.append((e, t, 3.0 * e - 2.0 * t + 0.7 * x + effect * d * p + noise * float(r.standard_normal()), d, p, 4.0 if d else None, x))
    return out


def panel(spark, **k):
    return spark.createDataFrame(rows(**k), "e int, t int, y double, d double, p double, ft double, x double")


def dummies(data):
    """Least squares with dummies of all entities and periods."""
    es, ts = sorted({r[0] for r in data}), sorted({r[1] for r in data})
    z = np.array([[r[3] * r[4], r[6], *(float(r[0] == e) for e in es), *(float(r[1] == t) for t in ts[1:])] for r in data])
    y = np.array([r[2] for r in data])
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    e = y - z @ b
    v = np.linalg.pinv(z.T @ z) * (e @ e) / (len(y) - np.linalg.matrix_rank(z))
    return b, v, e, z


@pytest.mark.parametrize("missing", [False, True])
def test_planted_effect_is_recovered(spark, missing):
    r = did.twfe(panel(spark, missing=missing), SPEC).first()
    assert r["coef"] == pytest.approx(5, abs=1e-8)
    assert r["r2_within"] == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("missing", [False, True])
def test_equals_dummy_regression(spark, missing):
    data = rows(noise=1.0, missing=missing)
    b, v, *_ = dummies(data)
    r = did.twfe(panel(spark, noise=1.0, missing=missing), SPEC, clustered=False).first()
    assert r["coef"] == pytest.approx(b[0], abs=1e-9)
    assert r["se"] == pytest.approx(np.sqrt(v[0, 0]), abs=1e-9)


def test_scaling_and_shifting(spark):
    p = panel(spark, noise=1.0)
    a = did.twfe(p, SPEC).first()
    b = did.twfe(p.withColumn("y", F.col("y") * 10 + 1e6), SPEC).first()
    assert b["coef"] == pytest.approx(10 * a["coef"], rel=1e-7) and b["se"] == pytest.approx(10 * a["se"], rel=1e-6)


def test_leave_one_out_equals_refits(spark):
    data = rows(noise=1.0, missing=True)
    got = {r["e"]: r["coef"] for r in robust.leave_one_out(panel(spark, noise=1.0, missing=True), SPEC).collect()}
    assert len(got) == 24
    for e in (0, 7, 23):
        assert got[e] == pytest.approx(dummies([r for r in data if r[0] != e])[0][0], abs=1e-8)


def test_placebo_equals_refits(spark):
    spec = PanelSpec(**{**SPEC.__dict__, "controls": ()})
    order = lambda e, s: (e * 13 + s * 7) % 24
    got = {r["draw"]: r["coef"] for r in robust.placebo_permutation(panel(spark, noise=1.0), spec, 3, order=order).collect()}
    for s in (1, 2, 3):
        chosen = sorted(range(24), key=lambda e: ((e * 13 + s * 7) % 24, e))[:12]
        data = [(e, t, y, float(e in chosen), p, ft, 0.0) for e, t, y, d, p, ft, x in rows(noise=1.0)]
        assert got[s] == pytest.approx(dummies(data)[0][0], abs=1e-8)


def test_event_study_keeps_never_treated_in_the_base(spark):
    r = {x["rel_time"]: x for x in did.event_study(panel(spark), SPEC, 3, 3).collect()}
    assert r[-1]["coef"] == 0
    assert all(abs(r[k]["coef"]) < 1e-8 for k in (-3, -2)) and all(r[k]["coef"] == pytest.approx(5, abs=1e-8) for k in (0, 1, 2, 3))


def test_staggered_estimators(spark):
    spec = PanelSpec(**{**SPEC.__dict__, "controls": ()})
    p = panel(spark).withColumn("ft", F.when(F.col("e") % 4 == 0, 3.0).when(F.col("e") % 4 == 1, 5.0)).withColumn("y", 3.0 * F.col("e") - F.col("t") + F.when(F.col("t") >= F.col("ft"), 4.0).otherwise(0.0))
    att = staggered.att_gt(p, spec).collect()
    assert len(att) == 8 and all(r["att"] == pytest.approx(4) for r in att)
    assert {r["kind"]: r["att"] for r in staggered.aggregate_att(staggered.att_gt(p, spec)).collect()}["overall"] == pytest.approx(4)
    assert all(r["coef"] == pytest.approx(4 if r["rel_time"] >= 0 else 0, abs=1e-8) for r in staggered.sun_abraham(p, spec).collect())
    bacon = staggered.goodman_bacon(p, spec)
    assert sum(r["weight"] for r in bacon.collect()) == pytest.approx(1)
    twfe = did.twfe(p.withColumn("d", (F.col("t") >= F.col("ft")).cast("double")).fillna(0.0, ["d"]).withColumn("p", F.lit(1.0)), spec).first()["coef"]
    assert sum(r["weight"] * r["estimate"] for r in bacon.collect()) == pytest.approx(twfe, abs=1e-8)
    dr = staggered.att_gt(p, SPEC).collect()
    assert all(r["att"] == pytest.approx(4, abs=1e-6) for r in dr)


def test_rdd_and_iv(spark):
    x = spark.range(4000).select(((F.col("id") * 37) % 4000 / 2000 - 1).alias("x"), (F.hash("id") % 1000 / 1000.0).alias("z"), (F.xxhash64("id") % 1000 / 1000.0).alias("u"))
    s = x.withColumn("y", 2 * F.col("x") + F.when(F.col("x") >= 0, 3.0).otherwise(0.0))
    assert cross_section.sharp_rdd(s, "y", "x", 0.0, 0.5).first()["coef"] == pytest.approx(3, abs=1e-8)
    i = x.withColumn("d", F.col("z") + F.col("u")).withColumn("y", 2 * F.col("d") + 5 * F.col("u"))
    r = {a["estimator"]: a for a in cross_section.instrumental(i, "y", "d", ["z"]).collect()}
    assert abs(r["2sls"]["coef"] - 2) < 0.4 < abs(r["2sls"]["ols_coef"] - 2)
    assert r["liml"]["coef"] == pytest.approx(r["2sls"]["coef"], abs=1e-6) and not r["2sls"]["weak"]
    assert not cross_section.mccrary(x, "x", 0.0).first()["manipulated"]
    assert r["liml"]["kappa"] == pytest.approx(1, abs=1e-9)


def test_liml_against_the_roots_in_numpy(spark):
    """Noise of its own and two instruments: kappa over 1; large means don't cost digits."""
    r = np.random.default_rng(3)
    z, u, v = r.standard_normal((500, 2)), r.standard_normal(500), r.standard_normal(500)
    d = z @ [0.4, 0.2] + u
    y = 1.5 * d + u + v
    df = spark.createDataFrame([(float(a), float(b), *map(float, c)) for a, b, c in zip(y, d, z)], "y double, d double, z0 double, z1 double")
    yd, one = np.column_stack([y, d]), np.ones((500, 1))
    left = lambda x: yd.T @ (yd - x @ np.linalg.lstsq(x, yd, rcond=None)[0])
    x = np.column_stack([one, z])
    kappa = min(np.linalg.eigvals(np.linalg.solve(left(x), left(one))).real)
    right = np.column_stack([d, one])
    hat = x @ np.linalg.lstsq(x, np.column_stack([right, y]), rcond=None)[0]
    want = np.linalg.solve((1 - kappa) * right.T @ right + kappa * right.T @ hat[:, :2], (1 - kappa) * right.T @ y + kappa * right.T @ hat[:, 2])[0]
    for shift in (0.0, 1e7):
        got = {a["estimator"]: a for a in cross_section.instrumental(df.select((F.col("y") + shift).alias("y"), (F.col("d") + shift).alias("d"), (F.col("z0") - shift).alias("z0"), "z1"), "y", "d", ["z0", "z1"]).collect()}
        assert got["liml"]["kappa"] == pytest.approx(kappa, abs=1e-6) and got["liml"]["kappa"] > 1
        assert got["liml"]["coef"] == pytest.approx(want, abs=1e-6)


def test_constant_is_moved_back(spark):
    df = spark.createDataFrame([(float(i), 1e6 + i, 3.0 + 2.0 * (1e6 + i) + (i % 3)) for i in range(60)], "k double, x double, y double")
    fit = ols(df, F.col("y"), {"x": F.col("x")})
    x = np.array([[1.0, i] for i in range(60)])  # about 1e6
    y = np.array([3.0 + 2.0 * i + (i % 3) for i in range(60)])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit.beta[1] == pytest.approx(b[1], rel=1e-9) and fit.beta[0] == pytest.approx(b[0] + 2e6 - b[1] * 1e6, rel=1e-6)


def test_simplex_weights():
    r = np.random.default_rng(0)
    donors = r.standard_normal((20, 6))
    truth = np.array([0.5, 0.3, 0.2, 0, 0, 0])
    w = synthetic.simplex_weights(donors, donors @ truth)
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    assert w == pytest.approx(truth, abs=1e-4)


def test_synthetic(spark):
    p = panel(spark, effect=0.0, noise=0.05).withColumn("y", F.col("y") + F.when((F.col("e") == 8) & (F.col("t") >= 4), 10.0).otherwise(0.0))
    assert synthetic.synthetic_did(p, SPEC, "8", 4).first()["att"] == pytest.approx(10, abs=1.5)
    out = synthetic.synthetic_control(p, SPEC, "8", 4).where("treated").first()
    assert out["att"] == pytest.approx(10, abs=1.5)


def test_every_combination_has_a_method_and_a_fallback(spark):
    r = decide.recommend(decide.all_facts(spark))
    assert r.count() == 1 << 12
    assert r.where("method is null or size(assumptions) = 0 or size(fallbacks) = 0").count() == 0


def test_facts_from_json(spark):
    doc = '{"q3_timing": {"has_known_start_time": true, "treatment_starts_at_different_times": true}, "q4_control_group": {"has_never_treated_units": true}}'
    r = decide.classify(decide.parse_facts(spark.createDataFrame([("a", doc), ("b", "{}"), ("c", None)], "policy_id string, facts string"))).collect()
    assert {x["policy_id"]: x["method"] for x in r} == {"a": "staggered_did", "b": "psm", "c": "psm"}


@pytest.mark.parametrize("p, f, n, changed, word", [(3, 0, 4, False, "strong"), (2, 0, 4, False, "moderate"), (4, 0, 4, True, "moderate"), (2, 2, 4, True, "suggestive"), (2, 1, 4, False, "not identifiable")])
def test_strength(p, f, n, changed, word):
    assert decide.strength(p, f, n, changed) == word


def test_evaluation(spark):
    report = confirm.evaluate(confirm.Case(panel(spark, noise=0.5), SPEC, unit=2, first=4), Method.DID)
    text = confirm.markdown(report, "Policy")
    assert "## Estimate" in text and "coef" in text
    assert float(report.where("item = 'coef'").first()["value"]) == pytest.approx(5, abs=0.7)
