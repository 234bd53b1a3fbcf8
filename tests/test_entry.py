import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from causeway import panels
from causeway.plans import decide, dml, synthetic
from causeway.queries import ORACLE_SQL, PLAIN, QUERIES

CHEAP = ["did_twfe_closed_form", "did_twfe_clustered", "leave_one_out", "att_aggregates", "rdd_sharp_uniform", "iv_just_identified", "missing_runs", "impute_sporadic", "merge_panels", "covariate_balance", "attrition", "parse_amounts", "classify_mechanisms"]


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) <= set(entry_module.queries())


def test_flagship(spark):
    assert entry_module.entry(spark).count() == 1


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name])
    cols = sorted(want.columns)

    def plain(rows):
        return sorted([tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows], key=str)

    got = QUERIES[name](spark, sf).select(*cols).collect()
    assert plain(map(tuple, got)) == plain(want.select(*cols).fetchall())


def test_data_requirements_reads_the_whole_catalogue(spark, tmp_path):
    rows = [(f"steel {k:04}", "sheet") for k in range(5000)] + [("tube", "copper")]
    spark.createDataFrame(rows, "p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["concept"]: (r["key"], r["tier"]) for r in QUERIES["data_requirements"](spark, str(tmp_path)).collect()}
    assert got == {"steel": ("steel 4999", "A"), "copper": ("tube", "B"), "nothing_like_it": (None, "C")}


def test_synthetic_queries_use_every_supplier(spark):
    sf = "/root/testdata/sf0.01"
    p = panels.supplier_year(spark, sf)
    periods = p.select("year").distinct().count()
    units = {r["entity_id"] for r in p.groupBy("entity_id").agg(F.countDistinct("year").alias("n")).where(f"n = {periods}").collect()}
    assert len(units) > 31
    assert {r["entity"] for r in QUERIES["synthetic_control"](spark, sf).collect()} == units
    assert QUERIES["synthetic_did"](spark, sf).first()["donors"] == len(units) - 1
    want = synthetic.synthetic_did_multi(p, PLAIN, {2: 1998, 4: 1999}).first()
    assert QUERIES["synthetic_did_multi"](spark, sf).first()["att"] == pytest.approx(want["att"])
    want = {r["time"]: r["synthetic"] for r in synthetic.synthetic_gaps(p, PLAIN, "2", 1998).collect()}
    assert {r["time"]: r["synthetic"] for r in QUERIES["synthetic_gaps"](spark, sf).collect()} == pytest.approx(want)


@pytest.mark.parametrize("name", ["classify_mechanisms", "method_recommendations"])
def test_policies_are_the_orders(spark, name, tmp_path):
    """Every order is judged; keys 0 to 4,095 have every combination of facts, as ``all_facts`` has."""
    spark.range(5000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["policy_id"]: r["method"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    want = {r["policy_id"]: r["method"] for r in decide.classify(decide.all_facts(spark)).collect()}
    assert len(got) == 5000 and {k: got[k] for k in want} == want and all(got[str(k)] == want[str(k - 4096)] for k in range(4096, 5000))


def test_html_statistical_table_reads_the_pages(spark, tmp_path):
    html = "<table><tr><td colspan=3>City table</td></tr><tr><th>City</th><th>GDP 2019</th><th>GDP 2020</th></tr><tr><td>A</td><td>1,200</td><td>3万</td></tr><tr><td>B</td><td>5</td><td>7</td></tr><tr><td colspan=3>note</td></tr></table>"
    rows = [(1, "u", html), (2, "u", "<p>none</p>"), (3, "u", html.replace("3万", "8")), (4, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in QUERIES["html_statistical_table"](spark, str(tmp_path)).collect()}
    assert got == {(1, "A", 2020, 3e4), (1, "B", 2020, 7.0), (3, "A", 2020, 8.0), (3, "B", 2020, 7.0)}


def test_draws_and_folds_are_the_defaults(spark, sf, monkeypatch):
    assert QUERIES["placebo_summary"](spark, sf).first()["draws"] == 500
    assert QUERIES["staggered_placebo"](spark, sf).count() == 200
    folds, fitted = [], dml.cross_fitted

    def noted(df, y, treatment, features, unit, n, kind, fold):
        folds.append(n)
        return fitted(df, y, treatment, features, unit, n, kind, fold)

    monkeypatch.setattr(dml, "cross_fitted", noted)
    QUERIES["dml_linear_cate"](spark, sf)
    assert folds == [5]
