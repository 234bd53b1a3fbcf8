"""Causal forest against trees grown by hand, and on planted effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.plans import dml, forest


def _by_hand(h, x, rt, ry, edges, tree, depth, least):
    """{node: (feature, cut)} and {node: effect} of one tree, row by row and cut by cut."""
    codes = [[int(sum(v > e for e in edges[j])) for j, v in enumerate(row)] for row in x]
    role = forest.roles(h, tree)

    def slope(rows):
        n = len(rows)
        t, y = sum(rt[i] for i in rows) / n, sum(ry[i] for i in rows) / n
        info = sum((rt[i] - t) ** 2 for i in rows)
        return sum((rt[i] - t) * (ry[i] - y) for i in rows) / info, info

    cuts, effects = {}, {}

    def go(node, level, cut_rows, own, above):
        effects[node] = slope(own)[0] if len(own) >= least else above
        best = (0.0, None)
        if level < depth:
            for f in forest.offered(tree, node, len(edges)):
                for c in range(forest.BINS - 1):
                    left, right = [i for i in cut_rows if codes[i][f] <= c], [i for i in cut_rows if codes[i][f] > c]
                    if len(left) >= least and len(right) >= least:
                        (a, ja), (b, jb) = slope(left), slope(right)
                        gain = (a - b) ** 2 * ja * jb / (ja + jb)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (int(f), c))
        if best[1]:
            cuts[node] = best[1]
            f, c = best[1]
            for k, side in ((1, lambda i: codes[i][f] <= c), (2, lambda i: codes[i][f] > c)):
                go(2 * node + k, level + 1, [i for i in cut_rows if side(i)], [i for i in own if side(i)], effects[node])

    everyone = range(len(x))
    go(0, 0, [i for i in everyone if role[i] == forest.CUT], [i for i in everyone if role[i] == forest.ESTIMATE], 0.0)
    return cuts, effects


def test_trees_by_hand(spark):
    r = np.random.default_rng(0)
    n = 1200
    x = np.round(r.normal(0, 1, (n, 3)), 2)
    t = r.integers(0, 2, n) + 0.3 * x[:, 0]
    y = t * (1 + 2 * (x[:, 1] > 0.3) - (x[:, 2] < -0.5)) + x[:, 0] + r.normal(0, 0.3, n)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(t[i]), float(y[i])) for i in range(n)], "u long, a double, b double, c double, t double, y double").repartition(5)
    rows = forest.residuals(df, "y", "t", ["a", "b", "c"], "u", 42)
    grown = forest.grow(rows, 3, 3, 2, 20)
    local = rows.collect()
    h = np.array([q["_h"] for q in local]).astype(np.uint64)
    values, rt, ry = [tuple(q[f"_f{j}"] for j in range(3)) for q in local], [q["_rt"] for q in local], [q["_ry"] for q in local]
    for tree in range(3):
        cuts, effects = _by_hand(h, values, rt, ry, grown.edges, tree, 2, 20)
        assert {k: (f, c) for k, (f, c) in enumerate(zip(grown.feature[tree].tolist(), grown.cut[tree].tolist())) if f >= 0} == cuts and cuts
        for node, e in effects.items():
            assert grown.effect[tree, node] == pytest.approx(e, rel=1e-6)


def test_planted_effects_are_found(spark):
    """The outcome depends much on a, the effect on b alone; a forest that splits on the outcome would follow a."""
    n = 6000
    x = spark.range(n).select("id", *((F.xxhash64("id", F.lit(k)) % 1000 / 1000.0).alias(c) for k, c in enumerate("abe")))
    df = x.withColumn("t", (F.xxhash64("id", F.lit(9)) % 2 == 0).cast("double")).withColumn("effect", F.when(F.col("b") > 0.2, 3.0).otherwise(0.0)).withColumn("y", 20 * F.sin(3 * F.col("a")) + F.col("effect") * F.col("t") + F.col("e"))
    got = dml.causal_forest(df, "y", "t", ["a", "b"], "id").select("cate", "cate_se", "effect", "b").toPandas()
    assert np.corrcoef(got["cate"], got["effect"])[0, 1] > 0.75
    far = got[(got["b"] - 0.2).abs() > 0.1]
    assert (far["cate"] > 1.5).eq(far["effect"] > 1.5).mean() > 0.95 and (got["cate_se"] >= 0).all() and got["cate_se"].mean() > 0
    again = dml.causal_forest(df.repartition(7), "y", "t", ["a", "b"], "id").select("id", "cate").toPandas().sort_values("id")
    first = dml.causal_forest(df, "y", "t", ["a", "b"], "id").select("id", "cate").toPandas().sort_values("id")
    assert np.allclose(first["cate"], again["cate"])


def test_forest_on_odd_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 2.0), (2, None, 0.0, 1.0), (3, 2.0, None, 1.0), (4, 3.0, 1.0, None)], "u long, a double, t double, y double")
    assert [r["u"] for r in dml.causal_forest(df, "y", "t", ["a"], "u", trees=2).collect()] == [1]
    assert dml.causal_forest(df.where("false"), "y", "t", ["a"], "u", trees=2).count() == 0


def test_sums_by_cell_give_the_same_forest(spark, monkeypatch):
    """Few cells: rows are read once for all levels, and effects come from a table of cells."""
    n = 4000
    x = spark.range(n).select("id", *((F.xxhash64("id", F.lit(k)) % 12).cast("double").alias(c) for k, c in enumerate("ab")), (F.xxhash64("id", F.lit(9)) % 2 == 0).cast("double").alias("t"))
    df = x.withColumn("y", F.col("t") * (F.col("b") > 3).cast("double") * 2 + F.col("a") + (F.xxhash64("id", F.lit(5)) % 100) / 100)
    found = []
    for most in (forest.MOST_CELLS, 0):
        monkeypatch.setattr(forest, "MOST_CELLS", most)
        rows = forest.residuals(df, "y", "t", ["a", "b"], "id", 42)
        grown = forest.grow(rows, 2, 7, 4, 20)
        told = forest.with_effects(df, grown, ["a", "b"], "id", 42).orderBy("id").toPandas()
        found.append((grown, told))
    (one, a), (many, b) = found
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all() and (one.feature >= 0).sum() > 7
    assert np.allclose(one.effect, many.effect) and np.allclose(a["cate"], b["cate"]) and np.allclose(a["cate_se"], b["cate_se"])
