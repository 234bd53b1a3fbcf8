"""Small functions that no query reaches, each on a few rows."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from causeway import panels
from causeway.functions import stats, text
from causeway.operators import clean, ranges, reshape, validate
from causeway.plans import confirm, cross_section, dml, robust
from causeway.plans.gram import logit
from causeway.sources import readers, sinks
from causeway.spec import Method, PanelSpec
from causeway.streaming import panel_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_roles_and_flags(spark):
    df = spark.createDataFrame([("a", 1, "1.5", float("nan"), 2.0), ("b", 2, "x", 1.0, None)], "e string, t int, y string, d double, ft double")
    spec = PanelSpec("e", "t", "y", "d", None, "ft")
    assert rows(spec.check(df)) == [("a", 1, 2.0, 1.5, None), ("b", 2, None, None, 1.0)]
    with pytest.raises(ValueError, match="lacks z"):
        PanelSpec("e", "t", "z", None, None).check(df)
    assert rows(robust.staggered_did_interaction(df, spec).select("e", "post")) == [("a", 0), ("b", 0)]
    assert cross_section.z_test(1.96, 1.0) == pytest.approx(0.05, abs=1e-4) and math.isnan(cross_section.z_test(1.0, 0.0))
    assert rows(robust.combine_checks(spark, {"a": True, "b": None, "c": False})) == [("a", "pass", "moderate"), ("b", "not run", "moderate"), ("c", "fail", "moderate")]
    assert spark.range(1).select(stats.percent_effect(F.lit(0.1), True), stats.percent_effect(F.lit(0.1), False)).first() == (pytest.approx(10.517, abs=1e-3), 0.1)


def test_texts(spark):
    df = spark.createDataFrame([("Smith and Jones (2004) say, Li et al. (2010) too", "中x")], "a string, b string")
    r = df.select(text.citations(F.col("a")).alias("c"), text.has_chinese(F.col("b")).alias("h"), text.author_key(F.lit("Jones & Smith (2004)")).alias("k")).first()
    assert r["c"] == ["Smith and Jones (2004)", "Li et al. (2010)"] and r["h"] and r["k"] == "2004 jones smith"


def test_tables(spark):
    wide = spark.createDataFrame([("New York, NY", "1", 2.0), ("Boston", "x", None)], "RegionName string, `2020-01-31` string, `2020-02-29` double")
    assert [(r[0], str(r[1]), r[2]) for r in reshape.melt_dates(wide, "RegionName", "new york").orderBy("date").collect()] == [("New York, NY", "2020-01-31", 1.0), ("New York, NY", "2020-02-29", 2.0)]
    rates = spark.createDataFrame([(2020, "6.9"), (2021, None)], "year int, close string")
    assert rows(reshape.first_column(rates, ["missing", "close"], "usd_cny", ["year"])) == [("usd_cny", 2020, 6.9)]
    with pytest.raises(ValueError):
        reshape.first_column(rates, ["no"], "x", ["year"])
    pairs = spark.createDataFrame([(" Hangzhou ", "330100"), ("Hangzhou", "330199"), ("12", "330100"), ("x", "33")], "name string, code string")
    assert rows(clean.map_from_pairs(pairs, "name", "code")) == [("Hangzhou", "330100")]
    names = spark.createDataFrame([("330100", "杭州市", 0), ("33", "杭州", 1)], "code string, name string, position int")
    assert rows(clean.name_variants(names)) == [("33", "33", 1), ("330100", "330100", 0), ("杭州", "33", 1), ("杭州市", "330100", 0)]
    raw = spark.createDataFrame([("a", "2001", "1"), ("a", "2001", "x"), (None, "y", None)], "e string, t string, v string")
    assert [(r["check"], r["n"]) for r in validate.raw_format(raw, "e", "t", "v").collect()] == [("null_ids", 1), ("bad_times", 1), ("bad_values", 1), ("duplicate_keys", 1)]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2001, 1.0), ("b", 2002, -1.0)], "entity_id string, year int, value double")
    assert readers.positive_only(df).count() == 1 and readers.nan_to_null(df.withColumn("value", F.lit(float("nan")))).first()["value"] is None
    a, b = (readers.reproducible_sample(df.union(df), "entity_id", 3).collect() for _ in range(2))
    assert a == b and len(a) == 3
    dated = df.withColumn("date", F.make_date("year", F.lit(1), F.lit(1)))
    assert readers.date_range(dated, "2002-01-01", None).count() == 1 and readers.date_range(dated, None, "2001-12-31").count() == 1
    for kind in ("parquet", "csv", "json", "dta"):
        sinks.write_panel(df, f"file://{tmp_path}/p.{kind}", kind)
        assert readers.read_table(spark, f"file://{tmp_path}/p.{kind}").count() == 2
    got = {r["variable"]: (r["status"], r["detail"]) for r in sinks.status_table(spark, {"x": df, "y": df.where("false"), "z": ValueError("no"), "w": None}).collect()}
    assert got == {"x": ("success", None), "y": ("empty", None), "z": ("error", "no"), "w": ("error", None)}
    bands = sinks.confidence_bands(spark.createDataFrame([(0, 1.0, 0.5)], "rel_time int, coef double, se double")).first()
    assert (bands["lo"], bands["hi"]) == (pytest.approx(0.02), pytest.approx(1.98))


def test_logit_and_matching(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.standard_normal((300, 2))
    t = (r.random(300) < 1 / (1 + np.exp(-(0.3 + x @ [0.8, -0.5])))).astype(float)
    df = spark.createDataFrame([(k, float(a), float(b), float(c), float(2 * c + a)) for k, ((a, b), c) in enumerate(zip(x, t))], "u long, x0 double, x1 double, t double, y double")
    b, z = np.zeros(3), np.column_stack([np.ones(300), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (t - p))
    assert logit(df, "t", ["x0", "x1"]) == pytest.approx(b, abs=1e-8) and logit(df.where("false"), "t", ["x0"]) == pytest.approx([0, 0])
    ps = 1 / (1 + np.exp(-z @ b))
    c = np.flatnonzero(t == 0)
    want = {int(k): min(abs(ps[c] - ps[k])) for k in np.flatnonzero(t == 1)}
    got = {m["unit"]: abs(m["ps"] - m["match_ps"]) for m in dml.matched(df, "y", "t", ["x0", "x1"], "u").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    assert dml.psm(df, "y", "t", ["x0", "x1"], "u").first()["att"] == pytest.approx(2, abs=0.6)
    near = dml.psm(df, "y", "t", ["x0", "x1"], "u", caliper=1e-4).first()
    assert near["pairs"] + near["unmatched"] == int(t.sum()) and near["unmatched"] > 0
    exact = dml.cem(df.withColumn("x0", F.lit(1.0)), "t", "t", ["x0"]).first()
    assert exact["att"] == 1 and exact["strata"] == 1 and exact["dropped"] == 0


def test_running_sums_over_ranges(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).cast("double").alias("a"), (F.col("id") % 7).alias("k"))
    got = ranges.running_sum(df, "a", "k", "b").orderBy("a").collect()
    total = 0
    for r in got:
        assert r["b"] == total
        total += r["k"]
    assert len(got) == 500 and ranges.running_sum(df.where("false"), "a", "k", "b").count() == 0


def test_fallbacks_are_tried_in_order(spark):
    data = spark.createDataFrame([(e, t, float(e + t), float(e % 2), float(t > 1)) for e in range(8) for t in range(4)], "e int, t int, y double, d double, p double")
    case = confirm.Case(data, PanelSpec("e", "t", "y", "d", "p"))
    tried = confirm.fallback_attempts(case, Method.IV)
    assert [(a["method"], a["hop"], a["outcome"]) for a in tried] == [("scm", 1, "skipped"), ("unknown", 1, "skipped")]
    rdd = confirm.confirm(case, Method.RDD)
    assert rdd["attempts"][0]["outcome"] == "skipped" and rdd["attempts"][-1]["method"] == str(rdd["final"]) == "did"
    assert confirm.specification(case, Method.DID) == {"method": "did", "entity": "e", "time": "t", "outcome": "y", "controls": [], "treated": "d", "post": "p", "complete": True}


def test_stream_without_data(spark, tmp_path):
    events = spark.createDataFrame([], "user_id long, ts timestamp, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    out = panel_stream.run_once(panel_stream.entity_windows(panel_stream.event_stream(spark, f"file://{tmp_path}")), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    assert out.count() == 0 and out.columns == ["entity_id", "start", "n", "total", "squares"]




def test_linear_cross_fitting_from_sums_by_fold(spark):
    """Residuals are those of least squares on the other folds; no column beyond the model's is cached."""
    r = np.random.default_rng(3)
    x, fold = r.normal(5, 2, (200, 2)), np.arange(200) % 3
    t = x[:, 0] + r.normal(0, 1, 200)
    y = 3 * t - x[:, 1] + r.normal(0, 1, 200)
    df = spark.createDataFrame([(i, int(fold[i]), *map(float, x[i]), float(t[i]), float(y[i]), "wide") for i in range(200)], "u long, f int, a double, b double, t double, y double, other string")
    got, cached = dml.cross_fitted(df, "y", "t", ["a", "b"], "u", 3, "linear", F.col("f"))
    assert cached.columns == ["_fold", "_yd", "_td", "a", "b"]
    rows = {round(q["_yd"], 9): q for q in got.collect()}
    cached.unpersist()
    z = np.column_stack([np.ones(200), x])
    for k in range(3):
        beta = np.linalg.lstsq(z[fold != k], np.column_stack([y, t])[fold != k], rcond=None)[0]
        for i in np.flatnonzero(fold == k):
            q = rows[round(y[i], 9)]
            assert (q["_ry"], q["_rt"]) == pytest.approx(tuple(np.array([y[i], t[i]]) - z[i] @ beta), abs=1e-8)


def test_line_items_have_more_tasks_where_the_table_has_more_rows(spark, sf, monkeypatch):
    few = panels.line_items(spark, sf)
    monkeypatch.setattr(panels, "ROWS_A_TASK", 500)
    many = panels.line_items(spark, sf)
    assert many.rdd.getNumPartitions() == 12 and few.rdd.getNumPartitions() < 12
    assert few.exceptAll(many).count() == 0 and few.count() == many.count()


@pytest.mark.parametrize("binary", [True, False])
def test_boosted_trees_on_cells_are_those_on_rows(spark, monkeypatch, binary):
    """Residuals are those of trees fitted on every row of the other folds; what is fitted are cells of equal features."""
    r = np.random.default_rng(5)
    n = 2000
    x = np.column_stack([r.integers(0, 9, n) - 3.0, r.choice([0.0, 0.1, 0.7, 9.0], n), np.ones(n)])
    t = (r.random(n) < 1 / (1 + np.exp(-x[:, 0] / 3))).astype(float) if binary else x[:, 0] + r.normal(0, 2, n)
    y = 3 * t + x[:, 0] * x[:, 1] + r.normal(0, 3, n)
    df = spark.createDataFrame([(i, i % 2, *map(float, x[i]), float(t[i]), float(y[i])) for i in range(n)], "u long, f int, a double, b double, c double, t double, y double")
    sizes, made = [], dml.learner

    def noted(*args):
        model = made(*args)
        fit = model.fit
        model.fit = lambda train: sizes.append(train.count()) or fit(train)
        return model

    monkeypatch.setattr(dml, "learner", noted)
    got, cached = dml.cross_fitted(df, "y", "t", ["a", "b", "c"], "u", 2, "boosting", F.col("f"))
    rows = {q["_yd"]: q for q in got.collect()}
    assert got.count() == n == len(rows) and got.columns == ["_fold", "_yd", "_td", "a", "b", "c", "_my", "_mt", "_ry", "_rt"]
    cached.unpersist()
    assert len(sizes) == 4 and max(sizes) <= 36 * (1 + binary)
    wide = VectorAssembler(inputCols=["a", "b", "c"], outputCol="_x").transform(df)
    of = {"maxIter": 10, "maxDepth": 3, "seed": 42, "featuresCol": "_x"}
    for k in range(2):
        train, test = wide.where(F.col("f") != k), wide.where(F.col("f") == k)
        of_y = GBTRegressor(labelCol="y", predictionCol="my", **of).fit(train).transform(test)
        both = (GBTClassifier(labelCol="t", **of) if binary else GBTRegressor(labelCol="t", predictionCol="mt", **of)).fit(train).transform(of_y)
        for q in both.select("y", "t", "my", vector_to_array("probability")[1].alias("mt") if binary else "mt").collect():
            assert (rows[q["y"]]["_ry"], rows[q["y"]]["_rt"]) == pytest.approx((q["y"] - q["my"], q["t"] - q["mt"]), abs=1e-9)


def test_bins_of_trees_have_as_many_rows_as_can_be(spark, monkeypatch):
    """A bin a value where there are few, else 32 bins by rank of which a heavy value fills its own; ranges of values make no difference."""
    v = np.round(np.random.default_rng(2).normal(0, 1, 4000), 3)
    v[:1500] = 0.25
    inf = float("inf")
    df = spark.createDataFrame([(float(a), (-0.0, 0.0, -inf, inf, 3.0)[i % 5]) for i, a in enumerate(v)], "a double, b double")
    starts = dml._bin_starts(df, "a")
    value, n = np.unique(v, return_counts=True)
    code = np.ceil(32 * (np.cumsum(n) - n / 2) / len(v))
    assert starts == [value[code == k].min() for k in np.unique(code)][1:]
    size = np.bincount(np.searchsorted(starts, v, side="right"))
    assert size.max() < 1500 + 125 + n[value != 0.25].max() and np.sort(size)[-2] < 125 + 2 * n[value != 0.25].max()
    assert dml._bin_starts(df, "b") == [0.0, 3.0, 1.7e308] and dml._bin_starts(df.where("b = 3"), "b") == []
    monkeypatch.setattr(ranges, "ROWS_A_RANGE", 100)
    assert dml._bin_starts(df, "a") == starts


def test_effects_by_boosted_trees(spark, monkeypatch):
    """Infinite and equal features are no error, and a plain join of the cells gives what the broadcast gives."""
    r = np.random.default_rng(8)
    rows = [(i, float(r.integers(0, 5)), [float("inf"), -0.0, 0.0][i % 3], 1.0, float(i % 2)) for i in range(300)]
    df = spark.createDataFrame([(*q, 2 * q[4] + q[1] + float(r.normal())) for q in rows], "u long, a double, b double, c double, t double, y double")
    few = dml.dml(df, "y", "t", ["a", "b", "c"], "u", 2, "boosting").first()
    monkeypatch.setattr(dml, "BROADCAST_CELLS", 0)
    assert tuple(dml.dml(df, "y", "t", ["a", "b", "c"], "u", 2, "boosting").first()) == pytest.approx(tuple(few), rel=1e-9)
    assert few["n"] == 300 and few["theta"] == pytest.approx(2, abs=0.5)
