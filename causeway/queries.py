"""Queries over the driver's tables, each with the SQL that states its result where SQL can."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway import panels
from causeway.functions import stats, text
from causeway.operators import clean, html_tables, reshape, validate
from causeway.panels import LINE_ITEMS_SQL, NATION_YEAR_SQL, ORDERS_BY_BALANCE_SQL, SUPPLIER_YEAR_SQL, USER_DAY_SQL, table
from causeway.plans import confirm, cross_section, decide, did, dml, robust, staggered, synthetic
from causeway.regression_sql import moments, newton, normal_p, sweep, t_p, within
from causeway.spec import Method, PanelSpec
from causeway.sources import readers, sinks
from causeway.streaming import incremental, panel_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

P1 = PanelSpec(controls=("quantity", "discount"), first_treated="first_treated")
PLAIN = PanelSpec(first_treated="first_treated")
P3 = PanelSpec(time="day")


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))  # no -0


# --- difference-in-differences -------------------------------------------------------------------------------------

#: x less its entity mean and period mean plus the mean, of a balanced panel ``p`` (e, t, y, d).
_WITHIN = """
    z AS (SELECT *, y - avg(y) OVER (PARTITION BY {k}e) - avg(y) OVER (PARTITION BY {k}t) + avg(y) OVER ({only}) AS yt,
                    d - avg(d) OVER (PARTITION BY {k}e) - avg(d) OVER (PARTITION BY {k}t) + avg(d) OVER ({only}) AS dt FROM p)
"""
_W = _WITHIN.format(k="", only="")


def _by(key: str) -> str:
    return _WITHIN.format(k=f"{key}, ", only=f"PARTITION BY {key}")


_P = f"p AS (SELECT entity_id AS e, year AS t, y, treated * post AS d FROM ({SUPPLIER_YEAR_SQL}))"


@query(f"WITH {_P}, {_W} SELECT round(sum(dt * yt) / sum(dt * dt), 6) AS coef, count(*) AS n FROM z")
def did_twfe_closed_form(spark, sf):
    return rounded(did.closed_form_did(panels.supplier_year(spark, sf), PLAIN))


@query(f"""
    WITH {_P}, {_W}, b AS (SELECT sum(dt * yt) / sum(dt * dt) AS b, sum(dt * dt) AS sxx, count(*) AS n, count(DISTINCT e) AS ne, count(DISTINCT t) AS nt FROM z),
    s AS (SELECT e, sum(dt * (yt - b * dt)) AS s FROM z, b GROUP BY e)
    SELECT round(any_value(b), 6) AS coef, round(sqrt(sum(s * s) * any_value(ne / (ne - 1.0)) * any_value((n - 1.0) / (n - nt))) / any_value(sxx), 6) AS se, any_value(n) AS n, any_value(ne) AS entities
    FROM s, b
""")
def did_twfe_clustered(spark, sf):
    return rounded(did.twfe(panels.supplier_year(spark, sf), PLAIN).select("coef", "se", "n", "entities"))


@query(f"""
    WITH {_P}, {_W}, b AS (SELECT sum(dt * yt) / sum(dt * dt) AS b, sum(dt * dt) AS sxx, count(*) AS n, count(DISTINCT e) AS ne, count(DISTINCT t) AS nt FROM z)
    SELECT round(any_value(b), 6) AS coef, round(sqrt(sum((yt - b * dt) ** 2) / any_value(n - ne - nt) / any_value(sxx)), 6) AS se, any_value(n - ne - nt)::DOUBLE AS df FROM z, b
""")
def did_classical_errors(spark, sf):
    return rounded(did.twfe(panels.supplier_year(spark, sf), PLAIN, clustered=False).select("coef", "se", "df"))


def _clustered(label: str, terms: dict[str, str], controls: list[str], places: int = 4) -> str:
    """CTEs and a query of RESULT's columns for each of ``terms`` (name: expression) with entity and period effects."""
    cols = [*(f"x{k}" for k in range(len(terms))), *controls]
    k = len(cols)
    z = within(f"(SELECT *, entity_id AS e, year AS t FROM ({SUPPLIER_YEAR_SQL}))", {"y": "y", **dict(zip(cols, [*terms.values(), *controls]))})
    u = " - ".join(["y", *(f"a{i}_{k} * {c}" for i, c in enumerate(cols))])
    score = lambda i: " + ".join(f"-a{min(i, j)}_{max(i, j)} * {c}" for j, c in enumerate(cols))
    parts = []
    for i, name in enumerate(terms):
        parts.append(f"""SELECT '{label}' AS spec, '{name}' AS term, a{i}_{k} AS coef, sqrt((SELECT sum(s * s) FROM (SELECT sum(({score(i)}) * ({u})) AS s FROM fit_{label}_z, fit_{label} GROUP BY e)) * ne / (ne - 1.0) * (n - 1.0) / (n - {k} - nt + 1)) AS se,
            1 - a{k}_{k} / (SELECT sum(ye * ye) FROM fit_{label}_z) AS r2_within, n, ne AS entities, ne - 1.0 AS df FROM fit_{label}, (SELECT count(DISTINCT e) AS ne, count(DISTINCT t) AS nt FROM fit_{label}_z)""")
    return f"fit_{label}_z AS MATERIALIZED ({z}), {sweep(moments(f'fit_{label}_z', cols), k, f'fit_{label}')}, {label}_r AS ({' UNION ALL '.join(parts)})"


def _results(*labels: str, places: int = 4) -> str:
    every = " UNION ALL ".join(f"SELECT * FROM {x}_r" for x in labels)
    return f"SELECT spec, term, round(coef, {places}) AS coef, round(se, {places}) AS se, round(t, {places}) AS t, round({t_p('t', 'df')}, {places}) AS p, round(r2_within, {places}) AS r2_within, n, entities, df::DOUBLE AS df FROM (SELECT *, coef / se AS t FROM ({every}))"


@query(f"WITH {_clustered('baseline', {'did': 'treated * post'}, [])}, {_clustered('full', {'did': 'treated * post'}, ['quantity', 'discount'])} {_results('baseline', 'full')}")
def did_baseline_and_full(spark, sf):
    return rounded(did.twfe(panels.supplier_year(spark, sf), P1, baseline=True), 4)


@query()
def did_unbalanced_user_day(spark, sf):
    return did.twfe(panels.user_day(spark, sf), P3)


#: Suppliers by year with the period relative to treatment, cut to -3 to 3.
_REL = f"(SELECT *, entity_id AS e, year AS t, greatest(least(year - first_treated, 3), -3) AS rel FROM ({SUPPLIER_YEAR_SQL}))"
_RELS = [-3, -2, 0, 1, 2, 3]


def _event_sql() -> str:
    cols = [*(f"r{i}" for i in range(len(_RELS))), "quantity", "discount"]
    k = len(cols)
    x = {**{f"r{i}": f"coalesce((first_treated IS NOT NULL AND rel = {r})::INT, 0)" for i, r in enumerate(_RELS)}, "quantity": "quantity", "discount": "discount"}
    rows = " UNION ALL ".join(f"SELECT {r} AS rel_time, a{i}_{k} AS coef, sqrt(-a{i}_{i} * s2) AS se FROM v" for i, r in enumerate(_RELS))
    return f"""
        WITH z AS MATERIALIZED ({within(_REL, {"y": "y", **x})}), {sweep(moments("z", cols), k, "m")},
        v AS (SELECT *, a{k}_{k} / df AS s2 FROM (SELECT m.*, n - ne - nt + 1 - {k} AS df FROM m, (SELECT count(DISTINCT e) AS ne, count(DISTINCT t) AS nt FROM z))),
        f AS (SELECT *, (1 + 2 * f / df) ** (-df / 2.0) AS p FROM (SELECT df, (a0_{k} * a0_{k} * -a1_1 - 2 * a0_{k} * a1_{k} * -a0_1 + a1_{k} * a1_{k} * -a0_0) / (a0_0 * a1_1 - a0_1 * a0_1) / s2 / 2 AS f FROM v)),
        r AS (SELECT *, coef / se AS t FROM ({rows}) UNION ALL SELECT -1, 0, 0, NULL)
        SELECT rel_time::INT AS rel_time, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({t_p("t", "df")}, 4) AS p, round(coef - 1.96 * se, 4) AS lo, round(coef + 1.96 * se, 4) AS hi,
               round(f, 4) AS pretrend_f, round(f.p, 4) AS pretrend_p, f.p > 0.05 AS jointly_zero FROM r, f
    """


@query(_event_sql())
def event_study(spark, sf):
    return rounded(did.event_study(panels.supplier_year(spark, sf), P1, n_pre=3, n_post=3), 4)


@query(f"""
    WITH w AS (SELECT unnest([1, 2, 3]) AS width), p AS (
        SELECT width, entity_id AS e, year AS t, y, treated * post AS d FROM ({SUPPLIER_YEAR_SQL}), w WHERE year BETWEEN 1998 - width AND 1997 + width
    ), {_by("width")}
    SELECT width, 'ok' AS status, count(*) AS n, round(sum(dt * yt) / sum(dt * dt), 5) AS coef FROM z GROUP BY width
""")
def alternative_windows(spark, sf):
    return rounded(did.alternative_windows(panels.supplier_year(spark, sf), PLAIN, 1998).select("width", "status", "n", "coef"), 5)


@query(f"""
    WITH w AS (SELECT unnest([1, 2, 3]) AS width), p AS (
        SELECT width, entity_id AS e, year AS t, y, treated * post AS d FROM ({SUPPLIER_YEAR_SQL}), w WHERE year BETWEEN 1998 - width AND 1997 + width
    ), {_by("width")}, b AS (SELECT width, sum(dt * yt) / sum(dt * dt) AS b, sum(dt * dt) AS sxx, count(*) - count(DISTINCT e) - count(DISTINCT t) AS df FROM z GROUP BY width),
    e AS (SELECT b.width, any_value(b) AS b, any_value(df) AS df, any_value(b) / sqrt(sum((yt - b * dt) ** 2) / any_value(df) / any_value(sxx)) AS t FROM z JOIN b ON z.width = b.width GROUP BY b.width),
    q AS (SELECT b, {t_p("t", "df")} AS p FROM e), a AS (SELECT count(*) AS n, min(b) > 0 OR max(b) < 0 AS same_sign, count(*) FILTER (p < 0.05) IN (0, count(*)) AS same_significance, max(abs(b)) < 3 * min(abs(b)) AS similar_size FROM q)
    SELECT *, same_sign AND same_significance AND similar_size AS stable FROM a
""")
def window_stability(spark, sf):
    return did.stability(did.alternative_windows(panels.supplier_year(spark, sf), PLAIN, 1998))


@query(f"WITH {_clustered('intensity', {'dose': 'entity_id * post'}, ['quantity', 'discount'])} {_results('intensity', places=5)}")
def intensity_did(spark, sf):
    return rounded(did.intensity_did(panels.supplier_year(spark, sf), P1, "entity_id"), 5)


@query(f"WITH {_clustered('ddd', {'ddd': 'treated * post * (entity_id % 3 = 0)::INT', 'treated_post': 'treated * post', 'group_post': 'post * (entity_id % 3 = 0)::INT'}, [])} {_results('ddd')}")
def triple_difference(spark, sf):
    return rounded(did.triple_difference(panels.supplier_year(spark, sf).withColumn("grp", (F.col("entity_id") % 3 == 0).cast("double")), PLAIN, "grp"), 4)


@query(f"SELECT entity_id, round(y - avg(y) OVER (PARTITION BY entity_id), 6) AS y FROM ({SUPPLIER_YEAR_SQL})")
def entity_demeaned(spark, sf):
    return rounded(did.demeaned(panels.supplier_year(spark, sf), "entity_id", ["y"]))


# --- robustness ----------------------------------------------------------------------------------------------------


@query(f"""
    WITH q AS (SELECT entity_id AS e, year AS t, y, treated * post AS d FROM ({SUPPLIER_YEAR_SQL})), k AS (SELECT DISTINCT e AS entity_id FROM q),
    p AS (SELECT * FROM q, k WHERE e <> entity_id), {_by("entity_id")}
    SELECT entity_id, round(sum(dt * yt) / sum(dt * dt), 5) AS coef FROM z GROUP BY entity_id
""")
def leave_one_out(spark, sf):
    return rounded(robust.leave_one_out(panels.supplier_year(spark, sf), PLAIN).select("entity_id", "coef"), 5)


_LOO_COLS = {"y": "y", "d": "treated * post", "quantity": "quantity", "discount": "discount"}


@query(f"""
    WITH q AS MATERIALIZED (SELECT *, entity_id AS e, year AS t FROM ({SUPPLIER_YEAR_SQL})), k AS (SELECT DISTINCT e AS gone FROM q), p AS (SELECT * FROM q, k WHERE e <> gone),
    z AS MATERIALIZED ({within("p", _LOO_COLS, "gone")}), {sweep(moments("z", ["d", "quantity", "discount"], by="gone"), 3, "m", "gone, n")},
    b AS (SELECT gone, a0_3 AS b, avg(a0_3) OVER () AS mean, stddev_pop(a0_3) OVER () AS sd FROM m)
    SELECT round(min(b), 4) AS lo, min_by(gone, b) AS lo_entity, round(max(b), 4) AS hi, max_by(gone, b) AS hi_entity, round(any_value(sd), 4) AS sd, count(*) FILTER (abs(b - mean) > 2 * sd) AS influential FROM b
""")
def leave_one_out_summary(spark, sf):
    return rounded(robust.loo_summary(robust.leave_one_out(panels.supplier_year(spark, sf), P1), "entity_id"), 4)


@query(f"""
    WITH q AS (SELECT entity_id AS e, year AS t, y, post FROM ({SUPPLIER_YEAR_SQL})), n AS (SELECT count(*) AS k FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 2 = 0),
    r AS (SELECT e, draw, row_number() OVER (PARTITION BY draw ORDER BY (e * 7919 + draw * 104729) * (e % 97 + 13) % 1000003, e) AS r FROM (SELECT DISTINCT e FROM q), (SELECT unnest(range(1, 501)) AS draw)),
    p AS (SELECT draw, q.e, t, y, post * (r <= k)::INT AS d FROM q JOIN r USING (e), n), {_by("draw")}
    SELECT draw::INT AS draw, round(sum(dt * yt) / sum(dt * dt), 5) AS coef FROM z GROUP BY draw
""")
def placebo_permutation(spark, sf):
    return rounded(robust.placebo_permutation(panels.supplier_year(spark, sf), PLAIN, order=_order), 5)


#: An order of entities that differs by draw and that SQL can state.
_ORDER = "(e * 7919 + draw * 104729) * (e % 97 + 13) % 1000003"


def _order(e, draw):
    return (e * 7919 + draw * 104729) * (e % 97 + 13) % 1000003


@query(f"""
    WITH q AS (SELECT entity_id AS e, year AS t, y, treated, post FROM ({SUPPLIER_YEAR_SQL})), n AS (SELECT count(DISTINCT e) FILTER (treated > 0) AS k FROM q),
    r AS (SELECT e, draw, row_number() OVER (PARTITION BY draw ORDER BY {_ORDER}, e) AS r FROM (SELECT DISTINCT e FROM q), (SELECT unnest(range(0, 501)) AS draw)),
    p AS (SELECT draw, q.e, t, y, post * (CASE WHEN draw = 0 THEN treated > 0 ELSE r <= k END)::INT AS d FROM q JOIN r USING (e), n), {_by("draw")},
    b AS (SELECT draw, sum(dt * yt) / sum(dt * dt) AS b FROM z GROUP BY draw), a AS (SELECT b AS actual FROM b WHERE draw = 0)
    SELECT count(*) AS draws, round(avg((abs(b) >= abs(actual))::INT), 6) AS p, round(avg(b), 4) AS mean, round(stddev_pop(b), 4) AS sd, round(quantile_cont(b, 0.025), 4) AS lo, round(quantile_cont(b, 0.975), 4) AS hi, round(any_value(actual), 4) AS actual
    FROM b, a WHERE draw > 0
""")
def placebo_summary(spark, sf):
    r = robust.randomization_inference(panels.supplier_year(spark, sf), PLAIN, order=_order)
    r = r.select("draws", F.round("p", 6).alias("p"), "mean", "sd", F.get("range", F.lit(0)).alias("lo"), F.get("range", F.lit(1)).alias("hi"), "actual")
    return r.select("draws", "p", *((F.round(c, 4) + 0.0).alias(c) for c in ("mean", "sd", "lo", "hi", "actual")))


@query(f"""
    WITH q AS (SELECT entity_id AS e, year AS t, y, first_treated AS ft FROM ({SUPPLIER_YEAR_SQL})), u AS (SELECT DISTINCT e, ft FROM q WHERE ft IS NOT NULL),
    r AS (SELECT e, draw, row_number() OVER (PARTITION BY draw ORDER BY ft, e) AS i, row_number() OVER (PARTITION BY draw ORDER BY {_ORDER}, e) AS j, ft FROM u, (SELECT unnest(range(1, 201)) AS draw)),
    g AS (SELECT a.draw, a.e, b.ft AS given FROM r a JOIN r b ON a.draw = b.draw AND a.j = b.i),
    p AS (SELECT k.draw, q.e, t, y, coalesce((t >= given)::INT, 0) AS d FROM q CROSS JOIN (SELECT unnest(range(1, 201)) AS draw) k LEFT JOIN g ON g.e = q.e AND g.draw = k.draw), {_by("draw")}
    SELECT draw::INT AS draw, round(sum(dt * yt) / sum(dt * dt), 4) AS coef FROM z GROUP BY draw
""")
def staggered_placebo(spark, sf):
    return rounded(robust.staggered_placebo(panels.supplier_year(spark, sf), PLAIN, order=_order), 4)


@query(f"""
    WITH s AS (SELECT unnest([-2, -1]) AS shift), p AS (
        SELECT shift, entity_id AS e, year AS t, y, treated * (year >= 1998 + shift)::INT AS d FROM ({SUPPLIER_YEAR_SQL}), s WHERE year < 1998
    ), {_by("shift")}
    SELECT shift, 'ok' AS status, count(*) AS n, round(sum(dt * yt) / sum(dt * dt), 5) AS coef FROM z GROUP BY shift
""")
def placebo_in_time(spark, sf):
    return rounded(robust.placebo_in_time(panels.supplier_year(spark, sf), PLAIN, 1998, (-2, -1)).select("shift", "status", "n", "coef"), 5)


_STEPS = f"z AS MATERIALIZED ({within(f'(SELECT *, entity_id AS e, year AS t FROM ({SUPPLIER_YEAR_SQL}))', _LOO_COLS)}), {sweep(moments('z', ['d']), 1, 's0')}, {sweep(moments('z', ['d', 'quantity']), 2, 's1')}, {sweep(moments('z', ['d', 'quantity', 'discount']), 3, 's2')}"


@query(f"""
    WITH {_STEPS}, v AS (SELECT var_pop(y) * count(y) AS tss FROM ({SUPPLIER_YEAR_SQL})),
    r AS (SELECT s0.a0_1 AS b0, 1 - s0.a1_1 / tss AS r0, s2.a0_3 AS b1, 1 - s2.a3_3 / tss AS r1, least(1.3 * (1 - s2.a3_3 / tss), 0.99) AS most FROM s0, s2, v),
    x AS (SELECT *, b1 - (b0 - b1) * (most - r1) / (r1 - r0) AS star, b1 * (r1 - r0) / ((b0 - b1) * (most - r1)) AS delta FROM r)
    SELECT round(b0, 4) AS beta_short, round(r0, 4) AS r2_short, round(b1, 4) AS beta_full, round(r1, 4) AS r2_full, round(most, 4) AS r2_max, round(star, 4) AS beta_star, round(delta, 4) AS delta_zero, (star > 0) = (b1 > 0) AND abs(delta) >= 1 AS robust FROM x
""")
def oster_bounds(spark, sf):
    return rounded(robust.oster_bounds(panels.supplier_year(spark, sf), P1), 4)


@query(f"""
    WITH {_STEPS}, k AS (SELECT count(DISTINCT e) AS ne, count(DISTINCT t) AS nt FROM z),
    r AS ({" UNION ALL ".join(f"SELECT {i} AS step, '{a}' AS added, a0_{i + 1} AS coef, sqrt(-a0_0 * a{i + 1}_{i + 1} / (n - ne - nt - {i})) AS se, n - ne - nt - {i} AS df FROM s{i}, k" for i, a in enumerate(("none", "quantity", "discount")))}),
    x AS (SELECT *, coef / se AS t, (min(coef) OVER () > 0 OR max(coef) OVER () < 0) AND max(abs(coef)) OVER () < 2 * min(abs(coef)) OVER () AS stable FROM r)
    SELECT step::INT AS step, added, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({t_p("t", "df")}, 4) AS p, stable FROM x
""")
def coefficient_stability(spark, sf):
    return rounded(robust.coefficient_stability(panels.supplier_year(spark, sf), P1), 4)


# --- staggered adoption --------------------------------------------------------------------------------------------

_ATT = f"""
    p AS ({SUPPLIER_YEAR_SQL}), g AS (SELECT DISTINCT first_treated AS g FROM p WHERE first_treated IS NOT NULL),
    c AS (SELECT g, b.year::DOUBLE AS t, a.entity_id, (a.first_treated IS NOT NULL)::INT AS d, b.y - a.y AS dy
          FROM g JOIN p a ON a.year = g - 1 AND (a.first_treated = g OR a.first_treated IS NULL) JOIN p b ON b.entity_id = a.entity_id AND b.year >= g),
    a AS (SELECT g, t, avg(dy) FILTER (d = 1) - avg(dy) FILTER (d = 0) AS att,
                 sqrt(var_pop(dy) FILTER (d = 1) / count(*) FILTER (d = 1) + var_pop(dy) FILTER (d = 0) / count(*) FILTER (d = 0)) AS se,
                 count(*) FILTER (d = 1) AS n_treated, count(*) FILTER (d = 0) AS n_control FROM c GROUP BY g, t)
"""


@query(f"WITH {_ATT} SELECT g, t, round(att, 5) AS att, round(se, 5) AS se, n_treated, n_control FROM a")
def att_by_cohort_and_time(spark, sf):
    return rounded(staggered.att_gt(panels.supplier_year(spark, sf), PLAIN), 5)


@query(f"""
    WITH {_ATT}, c2 AS (SELECT g, avg(att) AS att, max(n_treated) AS n FROM a GROUP BY g)
    SELECT 'overall' AS kind, NULL::DOUBLE AS at, round(sum(att * n) / sum(n), 5) AS att FROM c2
    UNION ALL SELECT 'cohort', g, round(att, 5) FROM c2
    UNION ALL SELECT 'event', t - g, round(sum(att * n_treated) / sum(n_treated), 5) FROM a GROUP BY t - g
""")
def att_aggregates(spark, sf):
    return rounded(staggered.aggregate_att(staggered.att_gt(panels.supplier_year(spark, sf), PLAIN)), 5)


@query(f"""
    WITH p AS MATERIALIZED ({SUPPLIER_YEAR_SQL}), g AS (SELECT DISTINCT first_treated AS g FROM p WHERE first_treated IS NOT NULL),
    c0 AS (SELECT g, b.year::DOUBLE AS t, a.entity_id AS e, (a.first_treated IS NOT NULL)::INT AS d, b.y - a.y AS dy, a.quantity AS q, a.discount AS k
           FROM g JOIN p a ON a.year = g - 1 AND (a.first_treated = g OR a.first_treated IS NULL) JOIN p b ON b.entity_id = a.entity_id AND b.year >= g),
    c AS MATERIALIZED (SELECT g, t, e, d, dy, (q - avg(q) OVER w) / stddev_pop(q) OVER w AS x1, (k - avg(k) OVER w) / stddev_pop(k) OVER w AS x2 FROM c0 WINDOW w AS (PARTITION BY g, t)),
    {newton("c", "d", ["x1", "x2"], "b", "g, t")}, {sweep(moments("(SELECT * FROM c WHERE d = 0)", ["1", "x1", "x2"], by="g, t", last=("dy",)), 3, "o", "g, t, n")},
    r AS (SELECT c.g, c.t, d, dy - a0_3 - a1_3 * x1 - a2_3 * x2 AS r, greatest(least(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 0.99), 0.01) AS ps FROM c JOIN b USING (g, t) JOIN o USING (g, t)),
    w AS (SELECT g, t, d, r, d / avg(d) OVER k AS w1, ps * (1 - d) / (1 - ps) / avg(ps * (1 - d) / (1 - ps)) OVER k AS w0 FROM r WINDOW k AS (PARTITION BY g, t)),
    m AS (SELECT *, avg(w1 * r) OVER k AS m1, avg(w0 * r) OVER k AS m0 FROM w WINDOW k AS (PARTITION BY g, t))
    SELECT g, t, round(any_value(m1 - m0), 3) AS att, round(sqrt(var_pop(w1 * (r - m1) - w0 * (r - m0)) / count(*)), 3) AS se, count(*) FILTER (d = 1) AS n_treated, count(*) FILTER (d = 0) AS n_control FROM m GROUP BY g, t
""")
def att_doubly_robust(spark, sf):
    return rounded(staggered.att_gt(panels.supplier_year(spark, sf), P1), 3)


@query(f"""
    WITH p AS MATERIALIZED ({SUPPLIER_YEAR_SQL}), g AS (SELECT DISTINCT first_treated AS g FROM p WHERE first_treated IS NOT NULL),
    c AS (SELECT g, b.year::DOUBLE AS t, coalesce(a.first_treated = g, false) AS d, b.y - a.y AS dy
          FROM g JOIN p a ON a.year = g - 1 JOIN p b ON b.entity_id = a.entity_id AND b.year <> g - 1 WHERE a.first_treated IS NULL OR a.first_treated = g OR a.first_treated > b.year)
    SELECT g, t, round(avg(dy) FILTER (d) - avg(dy) FILTER (NOT d), 4) AS att, round(sqrt(var_pop(dy) FILTER (d) / count(*) FILTER (d) + var_pop(dy) FILTER (NOT d) / count(*) FILTER (NOT d)), 4) AS se,
           count(*) FILTER (d) AS n_treated, count(*) FILTER (NOT d) AS n_control FROM c GROUP BY g, t
""")
def att_not_yet_treated(spark, sf):
    return rounded(staggered.att_gt(panels.supplier_year(spark, sf), PLAIN, control="notyet", pre=True), 4)


def _poisson_sql(u: str) -> str:
    """Draws of a Poisson variable of mean 1 from uniform numbers."""
    cdf, steps = 0.0, []
    for k in range(8):
        cdf += math.exp(-1) / math.factorial(k)
        steps.append(f"({u} >= {cdf!r})::INT")
    return " + ".join(steps)


@query(f"""
    WITH {_ATT}, u AS (SELECT g, t, d, dy, draw, (entity_id * 7919 + draw * 104729) * (entity_id % 97 + 13) % 1000003 / 1000003 AS u FROM c, (SELECT unnest(range(1, 101)) AS draw)),
    w AS (SELECT g, t, d, dy, draw, ({_poisson_sql("u")})::DOUBLE AS w FROM u),
    b AS (SELECT draw, g, t, sum(w * dy) FILTER (d = 1) / nullif(sum(w) FILTER (d = 1), 0) - sum(w * dy) FILTER (d = 0) / nullif(sum(w) FILTER (d = 0), 0) AS att, sum(w) FILTER (d = 1) AS n FROM w GROUP BY ALL),
    h AS (SELECT draw, g, avg(att) AS att, max(n) AS n FROM b WHERE att IS NOT NULL GROUP BY ALL), o AS (SELECT draw, sum(att * n) / sum(n) AS att FROM h GROUP BY draw)
    SELECT count(att) AS replicates, round(avg(att), 4) AS mean, round(stddev_samp(att), 4) AS sd, round(quantile_cont(att, 0.025), 4) AS lo, round(quantile_cont(att, 0.975), 4) AS hi FROM o
""")
def att_bootstrap(spark, sf):
    return rounded(staggered.bootstrap_att(panels.supplier_year(spark, sf), PLAIN, uniform=lambda e, s: _order(e, s) / 1000003), 4)


def _sun_abraham_sql() -> str:
    used = [(g, r) for g in (1997, 1998, 1999) for r in (-3, -2, 0, 1, 2, 3) if 1995 <= g + r <= 2001]
    cols, k = [f"c{i}" for i in range(len(used))], len(used)
    x = {c: f"coalesce((first_treated = {g} AND rel = {r})::INT, 0)" for c, (g, r) in zip(cols, used)}
    rows = []
    for r in _RELS:
        own = [(i, g) for i, (g, q) in enumerate(used) if q == r]
        w = {i: f"(SELECT count(y) FILTER (first_treated = {g} AND rel = {r}) / count(y) FILTER (first_treated IN ({', '.join(str(h) for _, h in own)}) AND rel = {r}) FROM {_REL})" for i, g in own}
        coef = " + ".join(f"{w[i]} * a{i}_{k}" for i, _ in own)
        var = " + ".join(f"{w[i]} * {w[j]} * -a{min(i, j)}_{max(i, j)}" for i, _ in own for j, _ in own)
        rows.append(f"SELECT {r} AS rel_time, {coef} AS coef, sqrt(({var}) * s2) AS se FROM v")
    return f"""
        WITH z AS MATERIALIZED ({within(_REL, {"y": "y", **x})}), {sweep(moments("z", cols), k, "m")},
        v AS MATERIALIZED (SELECT m.*, a{k}_{k} / (n - ne - nt + 1 - {k}) AS s2 FROM m, (SELECT count(DISTINCT e) AS ne, count(DISTINCT t) AS nt FROM z)),
        r AS MATERIALIZED (SELECT *, coef / se AS zz FROM ({" UNION ALL ".join(rows)}))
        SELECT rel_time::INT AS rel_time, round(coef, 4) AS coef, round(se, 4) AS se, round({normal_p("zz")}, 4) AS p FROM r
    """


@query(_sun_abraham_sql())
def sun_abraham(spark, sf):
    return rounded(staggered.sun_abraham(panels.supplier_year(spark, sf), PLAIN, 3, 3), 4)


@query(f"""
    WITH c AS MATERIALIZED (SELECT first_treated AS g, year AS t, avg(y) AS y, count(DISTINCT entity_id) AS n FROM ({SUPPLIER_YEAR_SQL}) GROUP BY ALL),
    n AS (SELECT g, max(n) AS n FROM c GROUP BY g), s AS (SELECT (SELECT sum(n) FROM n) AS total, (SELECT n FROM n WHERE g IS NULL) AS n0, (SELECT count(DISTINCT t) FROM c) AS nt),
    h AS (SELECT c.g, any_value(n.n) AS n, count(*) FILTER (c.t >= c.g) / any_value(nt) AS share FROM c JOIN n ON c.g = n.g, s WHERE c.g IS NOT NULL GROUP BY c.g),
    v AS (SELECT 'treated vs never' AS kind, h.g AS first, NULL AS second, avg(a.y - b.y) FILTER (a.t >= h.g) - avg(a.y - b.y) FILTER (a.t < h.g) AS estimate,
                 any_value(((h.n + n0) / total) ** 2 * (h.n / (h.n + n0)) * (n0 / (h.n + n0)) * share * (1 - share)) AS w
          FROM h JOIN c a ON a.g = h.g JOIN c b ON b.g IS NULL AND a.t = b.t, s GROUP BY h.g),
    p AS (SELECT k.g AS k, l.g AS l, k.n AS nk, l.n AS nl, k.share AS dk, l.share AS dl FROM h k JOIN h l ON k.g < l.g),
    e AS (SELECT 'earlier vs later', k, l, avg(a.y - b.y) FILTER (a.t >= k) - avg(a.y - b.y) FILTER (a.t < k), any_value(((nk + nl) / total * (1 - dl)) ** 2 * (nk / (nk + nl)) * (nl / (nk + nl)) * ((dk - dl) / (1 - dl)) * ((1 - dk) / (1 - dl)))
          FROM p JOIN c a ON a.g = k AND a.t < l JOIN c b ON b.g = l AND a.t = b.t, s GROUP BY k, l),
    u AS (SELECT 'later vs earlier', l, k, avg(a.y - b.y) FILTER (a.t >= l) - avg(a.y - b.y) FILTER (a.t < l), any_value(((nk + nl) / total * dk) ** 2 * (nk / (nk + nl)) * (nl / (nk + nl)) * (dl / dk) * ((dk - dl) / dk))
          FROM p JOIN c a ON a.g = l AND a.t >= k JOIN c b ON b.g = k AND a.t = b.t, s GROUP BY k, l),
    r AS (SELECT * FROM v UNION ALL SELECT * FROM e UNION ALL SELECT * FROM u)
    SELECT kind, first::DOUBLE AS first, second::DOUBLE AS second, round(estimate, 4) AS estimate, round(w / sum(w) OVER (), 6) AS weight FROM r
""")
def goodman_bacon(spark, sf):
    b = staggered.goodman_bacon(panels.supplier_year(spark, sf), PLAIN)
    return b.withColumns({"estimate": F.round("estimate", 4) + 0.0, "weight": F.round("weight", 6)})


# --- cross-sections ------------------------------------------------------------------------------------------------

_NEAR = f"(SELECT x - 4500 AS dist, y, taken FROM ({ORDERS_BY_BALANCE_SQL}) WHERE abs(x - 4500) <= 2000)"


@query(f"""
    SELECT round(regr_intercept(y, dist) FILTER (dist >= 0) - regr_intercept(y, dist) FILTER (dist < 0), 4) AS coef, 2000.0::DOUBLE AS bandwidth,
           count(*) FILTER (dist < 0) AS n_below, count(*) FILTER (dist >= 0) AS n_above FROM {_NEAR}
""")
def rdd_sharp_uniform(spark, sf):
    return rounded(cross_section.sharp_rdd(panels.orders_by_balance(spark, sf), "y", "x", 4500.0, 2000.0, "uniform").select("coef", "bandwidth", "n_below", "n_above"), 4)


@query(f"""
    WITH h AS (SELECT 1.84 * stddev_pop(x) * count(x) ** (-0.2) AS h FROM ({ORDERS_BY_BALANCE_SQL})),
    r AS MATERIALIZED (SELECT x - 4500 AS dist, (x >= 4500)::INT AS above, y, h, 1 - abs(x - 4500) / h AS w FROM ({ORDERS_BY_BALANCE_SQL}), h WHERE abs(x - 4500) <= h),
    {sweep(moments("(SELECT * FROM r WHERE w > 0)", ["above", "1", "dist", "dist * above"], "w"), 4, "m")},
    v AS (SELECT a0_4 AS coef, sqrt(a4_4 / (m.n - 4) * -a0_0) AS se, m.n - 4 AS df, 1 - a4_4 / (SELECT a4_4 - a1_4 * a1_4 / a1_1 FROM m_0) AS r2 FROM m), t AS (SELECT *, coef / se AS t FROM v)
    SELECT 'jump' AS term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({t_p("t", "df")}, 4) AS p, round(r2, 6) AS r2, (SELECT round(h, 4) FROM h) AS bandwidth,
           (SELECT count(*) FROM r WHERE above = 0) AS n_below, (SELECT count(*) FROM r WHERE above = 1) AS n_above FROM t
""")
def rdd_sharp_triangular(spark, sf):
    r = cross_section.sharp_rdd(panels.orders_by_balance(spark, sf), "y", "x", 4500.0)
    return r.select("term", *((F.round(c, 6 if c == "r2" else 4) + 0.0).alias(c) for c in ("coef", "se", "t", "p", "r2", "bandwidth")), "n_below", "n_above")


@query(f"""
    WITH r AS MATERIALIZED (SELECT *, (dist >= 0)::INT AS above FROM {_NEAR}), {sweep(moments("r", ["1", "dist", "dist * above"], last=("above", "taken", "y")), 3, "m", rest=3)},
    v AS (SELECT *, a3_4 / a3_3 AS fs, (a4_4 - a3_4 * a3_4 / a3_3) / (n - 4) / a3_3 AS fv, a3_5 / a3_4 AS late FROM m),
    e AS (SELECT *, sqrt((a5_5 - 2 * late * a4_5 + late * late * a4_4) / (n - 4) * a3_3 / a3_4 / a3_4) AS se, n - 4 AS df FROM v), t AS (SELECT *, late / se AS t FROM e)
    SELECT round(fs, 8) AS first_stage, round(fs * fs / fv, 4) AS first_stage_f, round(a3_5 / a3_3, 4) AS itt, round(late, 2) AS late, round(se, 2) AS se, round({t_p("t", "df")}, 4) AS p, 2000.0::DOUBLE AS bandwidth, n FROM t
""")
def rdd_fuzzy_uniform(spark, sf):
    r = cross_section.fuzzy_rdd(panels.orders_by_balance(spark, sf), "y", "x", "taken", 4500.0, 2000.0, "uniform")
    places = {"first_stage": 8, "first_stage_f": 4, "itt": 4, "late": 2, "se": 2, "p": 4, "bandwidth": 4}
    return r.select(*((F.round(c, k) + 0.0).alias(c) for c, k in places.items()), "n")


@query(f"SELECT round(1.84 * stddev_pop(x) * count(x) ** (-0.2), 6) AS bandwidth, count(x) AS n FROM ({ORDERS_BY_BALANCE_SQL})")
def rdd_bandwidth(spark, sf):
    return rounded(cross_section.rule_of_thumb_bandwidth(panels.orders_by_balance(spark, sf), "x"))


@query(f"""
    WITH o AS ({ORDERS_BY_BALANCE_SQL}), s AS (SELECT min(x) AS lo, max(x) AS hi, floor(sqrt(count(*)))::INT AS k FROM o),
    b AS (SELECT least(floor((x - lo) / ((hi - lo) / k)), k - 1)::INT AS bin, count(*) AS n FROM o, s GROUP BY 1)
    SELECT i::INT AS bin, round(lo + (i + 0.5) * ((hi - lo) / k), 6) AS mid, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(k)) AS i, lo, hi, k FROM s) LEFT JOIN b ON i = bin
""")
def density_histogram(spark, sf):
    return rounded(cross_section.density_bins(panels.orders_by_balance(spark, sf), "x"))


@query(f"""
    WITH o AS ({ORDERS_BY_BALANCE_SQL}), s AS (SELECT min(x) AS lo, max(x) AS hi, floor(sqrt(count(*)))::INT AS k FROM o),
    b AS (SELECT least(floor((x - lo) / ((hi - lo) / k)), k - 1)::INT AS bin, count(*) AS n FROM o, s GROUP BY 1),
    g AS MATERIALIZED (SELECT coalesce(b.n, 0) AS y, lo + (i + 0.5) * ((hi - lo) / k) - 4500 AS dist FROM (SELECT unnest(range(k)) AS i, lo, hi, k FROM s) LEFT JOIN b ON i = bin),
    {sweep(moments("(SELECT *, (dist >= 0)::INT AS above FROM g)", ["above", "1", "dist", "dist * above"]), 4, "m")},
    t AS (SELECT a0_4 AS jump, a0_4 / sqrt(a4_4 / (n - 4) * -a0_0) AS t, n - 4 AS df, n AS bins FROM m), p AS (SELECT *, {t_p("t", "df")} AS p FROM t)
    SELECT round(jump, 4) AS jump, round(t, 4) AS t, round(p, 4) AS p, bins::INT AS bins, p < 0.05 AS manipulated FROM p
""")
def mccrary_density(spark, sf):
    return rounded(cross_section.mccrary(panels.orders_by_balance(spark, sf), "x", 4500.0), 4)


@query(f"SELECT round(covar_pop(y, discount) / covar_pop(quantity + 100 * discount, discount), 4) AS coef, count(*) AS n FROM ({LINE_ITEMS_SQL})")
def iv_just_identified(spark, sf):
    x = panels.line_items(spark, sf).withColumn("strong", F.col("quantity") + 100 * F.col("discount"))
    return rounded(cross_section.instrumental(x, "y", "strong", ["discount"]).where("estimator = '2sls'").select("coef", "n"), 4)


@query(f"""
    WITH r AS MATERIALIZED (SELECT y, quantity + 100 * discount AS d, discount AS z1, tax AS z2, size FROM ({LINE_ITEMS_SQL})), c AS (SELECT avg(y) AS my, avg(d) AS md, avg(z1) AS m1, avg(z2) AS m2, avg(size) AS ms FROM r),
    x AS MATERIALIZED (SELECT y - my AS y, d - md AS d, z1 - m1 AS z1, z2 - m2 AS z2, size - ms AS size FROM r, c),
    {sweep(moments("x", ["size", "z1", "z2"], last=("d", "y")), 3, "w", rest=2)},
    k AS (SELECT w.n, w_1.a3_3 AS dd, w_1.a3_4 AS dy, w_1.a4_4 AS yy, w.a3_3 AS ed, w.a3_4 AS edy, w.a4_4 AS ey FROM w, w_1),
    q AS (SELECT *, dd - ed AS pd, dy - edy AS pdy, yy - ey AS py, ed * ey - edy * edy AS det, dd * ey + yy * ed - 2 * dy * edy AS mid, dd * yy - dy * dy AS det0 FROM k),
    e AS (SELECT '2sls' AS estimator, 1.0 AS kappa, * FROM q UNION ALL SELECT 'liml', 2 * det0 / (mid + sqrt(mid * mid - 4 * det * det0)), * FROM q),
    b AS (SELECT *, ((1 - kappa) * dy + kappa * pdy) / ((1 - kappa) * dd + kappa * pd) AS b FROM e),
    s AS (SELECT *, yy - 2 * b * dy + b * b * dd AS rss, n - 3 AS df, pd / 2 / (ed / (n - 4)) AS f FROM b),
    t AS (SELECT *, sqrt(rss / df / ((1 - kappa) * dd + kappa * pd)) AS se, (py - 2 * b * pdy + b * b * pd) / (rss / n) AS j FROM s), u AS (SELECT *, b / se AS t, sqrt(j) AS rj FROM t)
    SELECT estimator, round(b, 3) AS coef, round(se, 3) AS se, round({t_p("t", "df")}, 4) AS p, round(dy / dd, 3) AS ols_coef, round(f, 3) AS first_stage_f, round((1 + 2 * f / (n - 4)) ** (-(n - 4) / 2.0), 4) AS first_stage_p, f < 13.9 AS weak,
           round(j, 3) AS j, round({normal_p("rj")}, 3) AS j_p, round(kappa, 5) AS kappa, n FROM u
""")
def iv_2sls_and_liml(spark, sf):
    x = panels.line_items(spark, sf).withColumn("strong", F.col("quantity") + 100 * F.col("discount"))
    r = cross_section.instrumental(x, "y", "strong", ["discount", "tax"], ("size",))
    places = {"coef": 3, "se": 3, "p": 4, "ols_coef": 3, "first_stage_f": 3, "first_stage_p": 4, "j": 3, "j_p": 3, "kappa": 5}
    return r.select("estimator", *((F.round(c, k) + 0.0).alias(c) for c, k in places.items()), "weak", "n")


@query()
def synthetic_control(spark, sf):
    return synthetic.synthetic_control(panels.supplier_year(spark, sf), PLAIN, "2", 1998)


@query()
def synthetic_gaps(spark, sf):
    return synthetic.synthetic_gaps(panels.supplier_year(spark, sf), PLAIN, "2", 1998)


@query()
def synthetic_did(spark, sf):
    return synthetic.synthetic_did(panels.supplier_year(spark, sf), PLAIN, "2", 1998)


@query()
def synthetic_did_multi(spark, sf):
    return synthetic.synthetic_did_multi(panels.supplier_year(spark, sf), PLAIN, {2: 1998, 4: 1999})


def _items(spark, sf):
    return panels.line_items(spark, sf).withColumn("u", F.col("order_id") * 10 + F.col("line"))


_FOLD = "(order_id * 7 + line) % 5"
_FEATURES = ["size", "retail", "quantity", "discount"]


def _residuals_sql(features: list[str]) -> str:
    """CTEs up to ``r``: rows with fold f and residuals ry and rt of regressions on the other folds."""
    centred = ", ".join(f"{c} - avg({c}) OVER () AS c{i}" for i, c in enumerate(features))
    cols = ["1", *(f"c{i}" for i in range(len(features)))]
    k = len(cols)
    fit = lambda y: " + ".join(f"a{i}_{y} * {c}" for i, c in enumerate(cols))
    return f"""
        x AS MATERIALIZED (SELECT y, d, {", ".join(features)}, {_FOLD} AS f, {centred} FROM ({LINE_ITEMS_SQL})), o AS (SELECT x.*, k.f AS out_of FROM x JOIN (SELECT unnest(range(5)) AS f) k ON x.f <> k.f),
        {sweep(moments("o", cols, by="out_of", last=("y", "d")), k, "m", "out_of, n", rest=2)}, r AS MATERIALIZED (SELECT x.*, y - ({fit(k)}) AS ry, d - ({fit(k + 1)}) AS rt FROM x JOIN m ON f = out_of)
    """


@query(f"""
    WITH {_residuals_sql(_FEATURES)}, t AS (SELECT avg(th) AS theta FROM (SELECT avg(rt * ry) / avg(rt * rt) AS th FROM r GROUP BY f)),
    a AS (SELECT any_value(theta) AS theta, avg(rt * rt) AS j, avg((rt * (ry - theta * rt)) ** 2) AS v, count(*) AS n, 1 - sum(ry * ry) / (var_pop(y) * count(*)) AS r2_y, 1 - sum(rt * rt) / (var_pop(d) * count(*)) AS r2_t FROM r, t),
    s AS (SELECT *, sqrt(v / n) / j AS se FROM a), z AS (SELECT *, theta / se AS z FROM s)
    SELECT round(theta, 4) AS theta, round(se, 4) AS se, round({normal_p("z")}, 4) AS p, n, round(r2_y, 6) AS r2_y, round(r2_t, 6) AS r2_t FROM z
""")
def dml_linear(spark, sf):
    fold = (F.col("order_id") * 7 + F.col("line")) % 5
    r = dml.dml(_items(spark, sf), "y", "d", _FEATURES, "u", fold=fold)
    return r.select(*((F.round(c, 4) + 0.0).alias(c) for c in ("theta", "se", "p")), "n", *((F.round(c, 6) + 0.0).alias(c) for c in ("r2_y", "r2_t")))


@query()
def dml_forest(spark, sf):
    return dml.dml(_items(spark, sf), "y", "d", ["size", "retail", "quantity", "discount"], "u", folds=2, kind="boosting")


@query(f"""
    WITH {_residuals_sql(["size", "quantity"])}, {sweep(moments("r", ["1", "rt", "rt * size", "rt * quantity"], last=("ry",)), 4, "e")},
    v AS ({" UNION ALL ".join(f"SELECT '{x}' AS term, a{i + 1}_4 AS coef, sqrt(a4_4 / (n - 4) * -a{i + 1}_{i + 1}) AS se FROM e" for i, x in enumerate(("effect", "effect:size", "effect:quantity")))}), t AS (SELECT *, coef / se AS t FROM v)
    SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round({normal_p("t")}, 4) AS p FROM t
""")
def dml_linear_cate(spark, sf):
    fold = (F.col("order_id") * 7 + F.col("line")) % 5
    return rounded(dml.linear_cate(_items(spark, sf), "y", "d", ["size", "quantity"], "u", fold=fold), 4)


_SCALED = f"x AS MATERIALIZED (SELECT order_id * 10 + line AS u, y, d, size, quantity, (size - avg(size) OVER ()) / stddev_samp(size) OVER () AS x1, (quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER () AS x2 FROM ({LINE_ITEMS_SQL}))"


@query(f"""
    WITH {_SCALED}, {newton("x", "d", ["x1", "x2"], "b")}, {sweep(moments("(SELECT * FROM x WHERE d = 1)", ["1", "x1", "x2"]), 3, "m1")}, {sweep(moments("(SELECT * FROM x WHERE d = 0)", ["1", "x1", "x2"]), 3, "m0")},
    p AS (SELECT y, d, greatest(least(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 0.99), 0.01) AS ps, m1.a0_3 + m1.a1_3 * x1 + m1.a2_3 * x2 AS f1, m0.a0_3 + m0.a1_3 * x1 + m0.a2_3 * x2 AS f0 FROM x, b, m1, m0),
    q AS (SELECT d * y / ps - (1 - d) * y / (1 - ps) AS ipw, f1 - f0 + d * (y - f1) / ps - (1 - d) * (y - f0) / (1 - ps) AS aipw FROM p)
    SELECT 'ipw' AS estimator, round(avg(ipw), 3) AS ate, round(stddev_pop(ipw) / sqrt(count(*)), 3) AS se, count(*) AS n FROM q UNION ALL SELECT 'aipw', round(avg(aipw), 3), round(stddev_pop(aipw) / sqrt(count(*)), 3), count(*) FROM q
""")
def ipw_and_aipw(spark, sf):
    return rounded(dml.weighting(_items(spark, sf), "y", "d", ["size", "quantity"]), 3)


#: Each treated unit with the nearest control by propensity: of equally near ones the lower, of one score the largest unit.
_MATCHED = f"""
    {_SCALED}, {newton("x", "d", ["x1", "x2"], "b")}, s AS MATERIALIZED (SELECT u, y, d, greatest(least(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 0.99), 0.01) AS ps FROM x, b),
    l AS MATERIALIZED (SELECT ps, arg_max(y, u) AS last FROM s WHERE d = 0 GROUP BY ps),
    below AS (SELECT s.u, s.ps, s.y, l.ps AS bp, l.last AS bv FROM s ASOF LEFT JOIN l ON s.ps >= l.ps WHERE d = 1),
    both_ AS (SELECT k.*, l.ps AS ap, l.last AS av FROM below k ASOF LEFT JOIN l ON k.ps <= l.ps),
    m AS MATERIALIZED (SELECT y - CASE WHEN bp IS NULL OR abs(ap - ps) < abs(ps - bp) THEN av ELSE bv END AS diff FROM both_)
"""


@query(f"""
    WITH {_MATCHED}, a AS (SELECT avg(diff) AS att, stddev_samp(diff) / sqrt(count(diff)) AS se, count(diff) AS pairs FROM m), z AS (SELECT *, att / se AS z FROM a)
    SELECT round(att, 4) AS att, round(se, 4) AS se, round({normal_p("z")}, 4) AS p, pairs, 0::BIGINT AS unmatched FROM z
""")
def psm_matching(spark, sf):
    return rounded(dml.psm(_items(spark, sf), "y", "d", ["size", "quantity"], "u"), 4)


@query(f"""
    WITH {_MATCHED}, v AS (SELECT abs(diff) AS a, count(*) AS k, count(*) FILTER (diff > 0) AS up FROM m WHERE diff <> 0 GROUP BY abs(diff)),
    r AS (SELECT k, up, coalesce(sum(k) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2.0 AS rank FROM v),
    t AS (SELECT sum(k)::BIGINT AS pairs, sum(up * rank)::DOUBLE AS w, sum(k * rank)::DOUBLE AS s1, sum(k * rank * rank)::DOUBLE AS s2 FROM r), g AS (SELECT unnest([1, 1.2, 1.5, 1.8, 2, 2.5, 3])::DOUBLE AS gamma),
    z AS (SELECT gamma, pairs, (w - gamma / (1 + gamma) * s1) / sqrt(gamma / (1 + gamma) * (1 - gamma / (1 + gamma)) * s2) AS zu, (w - (1 - gamma / (1 + gamma)) * s1) / sqrt(gamma / (1 + gamma) * (1 - gamma / (1 + gamma)) * s2) AS zl FROM g, t),
    p AS (SELECT *, CASE WHEN zu > 0 THEN ({normal_p("zu")}) / 2 ELSE 1 - ({normal_p("zu")}) / 2 END AS pu, CASE WHEN zl > 0 THEN ({normal_p("zl")}) / 2 ELSE 1 - ({normal_p("zl")}) / 2 END AS pl FROM z)
    SELECT gamma, pairs, round(zu, 4) AS z_upper, round(pu, 4) AS p_upper, round(zl, 4) AS z_lower, round(pl, 4) AS p_lower, (SELECT min(gamma) FROM p WHERE pu > 0.05) AS critical_gamma FROM p
""")
def rosenbaum_bounds(spark, sf):
    return rounded(robust.rosenbaum_bounds(_items(spark, sf), "y", "d", ["size", "quantity"], "u"), 4)


@query(f"""
    WITH r AS ({LINE_ITEMS_SQL}), e AS (SELECT min(size) AS l1, max(size) AS h1, min(quantity) AS l2, max(quantity) AS h2 FROM r),
    c AS (SELECT least(floor((size - l1) / ((h1 - l1) / 5)), 4) AS b1, least(floor((quantity - l2) / ((h2 - l2) / 5)), 4) AS b2, d, y FROM r, e),
    s AS (SELECT b1, b2, count(*) FILTER (d = 1) AS n1, count(*) FILTER (d = 0) AS n0, avg(y) FILTER (d = 1) AS m1, avg(y) FILTER (d = 0) AS m0, var_pop(y) FILTER (d = 1) AS v1, var_pop(y) FILTER (d = 0) AS v0 FROM c GROUP BY b1, b2)
    SELECT round(sum(n1 * (m1 - m0)) FILTER (n1 > 0 AND n0 > 0) / sum(n1) FILTER (n1 > 0 AND n0 > 0), 4) AS att, round(sqrt(sum(n1 * n1 * (v1 / n1 + v0 / n0)) FILTER (n1 > 0 AND n0 > 0)) / sum(n1) FILTER (n1 > 0 AND n0 > 0), 4) AS se,
           count(*) FILTER (n1 > 0 AND n0 > 0) AS strata, (sum(n1) FILTER (n1 > 0 AND n0 > 0))::BIGINT AS treated, (sum(n0) FILTER (n1 > 0 AND n0 > 0))::BIGINT AS controls, coalesce(sum(n1 + n0) FILTER (n1 = 0 OR n0 = 0), 0)::BIGINT AS dropped FROM s
""")
def cem_matching(spark, sf):
    return rounded(dml.cem(_items(spark, sf), "y", "d", ["size", "quantity"]), 4)


@query(f"""
    WITH {_SCALED}, {newton("x", "d", ["x1", "x2"], "b", penalty=0.001)}, p AS (SELECT d, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS ps FROM x, b),
    a AS (SELECT min(ps) FILTER (d = 1) AS t_lo, max(ps) FILTER (d = 1) AS t_hi, min(ps) FILTER (d = 0) AS c_lo, max(ps) FILTER (d = 0) AS c_hi FROM p),
    s AS (SELECT *, greatest(least(t_hi, c_hi) - greatest(t_lo, c_lo), 0) / nullif(greatest(t_hi, c_hi) - least(t_lo, c_lo), 0) AS share FROM a)
    SELECT round(t_lo, 6) AS t_lo, round(t_hi, 6) AS t_hi, round(c_lo, 6) AS c_lo, round(c_hi, 6) AS c_hi, round(coalesce(share, 1), 6) AS overlap, CASE WHEN share < 0.1 THEN 'FAIL' WHEN share < 0.5 THEN 'UNCERTAIN' ELSE 'PASS' END AS verdict FROM s
""")
def propensity_overlap(spark, sf):
    return rounded(dml.overlap(_items(spark, sf), "d", ["size", "quantity"]))


@query()
def causal_forest(spark, sf):
    return dml.forest_summary(dml.causal_forest(_items(spark, sf), "y", "d", ["size", "quantity"], "u"))


@query()
def causal_forest_groups(spark, sf):
    c = dml.causal_forest(_items(spark, sf), "y", "d", ["size", "quantity"], "u")
    return dml.quintile_means(c, ["size", "quantity"]).select("feature", F.lit("top").alias("level"), F.col("top").alias("value")).union(dml.group_effects(c, "quantity").select(F.lit("quantity"), "level", "cate"))


@query(f"""
    WITH r AS (SELECT quantity * size / 10 + retail / 100 AS y, size, quantity FROM ({LINE_ITEMS_SQL})), c AS (SELECT avg(size) AS m1, stddev_pop(size) AS s1, avg(quantity) AS m2, stddev_pop(quantity) AS s2 FROM r),
    x AS MATERIALIZED (SELECT y, (size - m1) / s1 AS x1, (quantity - m2) / s2 AS x2 FROM r, c), {sweep(moments("x", ["1", "x1", "x2"]), 3, "m")},
    v AS ({" UNION ALL ".join(f"SELECT '{x}' AS term, a{i}_3 AS coef, sqrt(a3_3 / (n - 3) * -a{i}_{i}) AS se FROM m" for i, x in enumerate(("const", "size", "quantity")))}), t AS (SELECT *, coef / se AS t FROM v)
    SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 4) AS t, round({normal_p("t")}, 4) AS p FROM t
""")
def best_linear_projection(spark, sf):
    x = _items(spark, sf).withColumn("cate", F.col("quantity") * F.col("size") / 10 + F.col("retail") / 100)
    r = cross_section.best_linear_projection(x, "cate", ["size", "quantity"])
    return r.select("term", *((F.round(c, k) + 0.0).alias(c) for c, k in {"coef": 6, "se": 6, "t": 4, "p": 4}.items()))


@query(f"""
    SELECT round(avg(quantity), 6) AS mean, round(stddev_pop(quantity), 6) AS sd, min(quantity) AS lo, max(quantity) AS hi, quantile_cont(quantity::DOUBLE, 0.05) AS p5, quantile_cont(quantity::DOUBLE, 0.25) AS p25,
           quantile_cont(quantity::DOUBLE, 0.5) AS p50, quantile_cont(quantity::DOUBLE, 0.75) AS p75, quantile_cont(quantity::DOUBLE, 0.95) AS p95, round(avg((quantity > 0)::INT), 6) AS share_positive, count(quantity) AS n FROM ({LINE_ITEMS_SQL})
""")
def effect_distribution(spark, sf):
    return rounded(cross_section.effect_distribution(panels.line_items(spark, sf), "quantity"))


@query(f"SELECT entity_id, year, CASE WHEN first_treated IS NOT NULL THEN greatest(least(year - first_treated, 2), -3) END::INT AS rel_time, coalesce((year >= first_treated)::INT, 0) AS post FROM ({SUPPLIER_YEAR_SQL})")
def relative_time(spark, sf):
    p = panels.supplier_year(spark, sf)
    return p.select("entity_id", "year", did.relative_time("year", "first_treated", 3, 2).alias("rel_time"), did.post_flag("year", "first_treated").alias("post"))


@query("""
    SELECT c_custkey, round(CASE WHEN abs(u) <= 1 THEN 1 - abs(u) ELSE 0 END, 6) AS triangular, round(CASE WHEN abs(u) <= 1 THEN 0.75 * (1 - u * u) ELSE 0 END, 6) AS epanechnikov, (CASE WHEN abs(u) <= 1 THEN 1 ELSE 0 END)::DOUBLE AS uniform
    FROM (SELECT c_custkey, (c_acctbal - 4500) / 2000 AS u FROM customer)
""")
def kernel_weights(spark, sf):
    u = (F.col("c_acctbal") - 4500) / 2000
    kinds = ("triangular", "epanechnikov", "uniform")
    return rounded(table(spark, sf, "customer").select("c_custkey", *(cross_section.kernel(u, k).cast("double").alias(k) for k in kinds)))


@query(f"""
    WITH p AS (SELECT first_treated AS g, year AS t, avg(y) AS y, count(DISTINCT entity_id) AS n FROM ({SUPPLIER_YEAR_SQL}) GROUP BY ALL), n AS (SELECT g, max(n) AS n FROM p GROUP BY g), s AS (SELECT sum(n) AS total, (SELECT n FROM n WHERE g IS NULL) AS n0 FROM n),
    e AS (SELECT a.g, avg(a.y - b.y) FILTER (a.t >= a.g) - avg(a.y - b.y) FILTER (a.t < a.g) AS estimate FROM p a JOIN p b ON b.g IS NULL AND a.t = b.t WHERE a.g IS NOT NULL GROUP BY a.g)
    SELECT g AS first, round(estimate, 5) AS estimate FROM e
""")
def bacon_against_never(spark, sf):
    b = staggered.goodman_bacon(panels.supplier_year(spark, sf), PLAIN).where("kind = 'treated vs never'")
    return rounded(b.select("first", "estimate"), 5)


@query()
def heterogeneity_drivers(spark, sf):
    return dml.heterogeneity_drivers(_items(spark, sf), "y", "d", ["size", "quantity"], "u")


_WORDS = "list_distinct(list_filter(string_split_regex({0}, '[\\s_-]+'), lambda w: length(w) > 1))"


def _match_sql(q: str, t: str) -> str:
    """Likeness of two ASCII texts."""
    q, t = f"lower(trim({q}))", f"lower(trim({t}))"
    a, b = _WORDS.format(q), _WORDS.format(t)
    return f"CASE WHEN {q} = '' OR {t} = '' THEN 0 WHEN {q} = {t} THEN 1 WHEN contains({t}, {q}) THEN 0.85 WHEN contains({q}, {t}) THEN 0.8 ELSE 0.5 * least(len(list_intersect({a}, {b})) / greatest(len({a}), 1), 1) END"


def _hit_sql(x: str, words: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({x}), {w!r})' for w in ws)} THEN '{k}'" for k, ws in words.items()) + f" ELSE '{default}' END"


def _level_sql(x: str, hint: str) -> str:
    named = " ".join(f"WHEN lower({hint}) IN ('{k}', {', '.join(map(repr, ws))}) THEN '{k}'" for k, ws in text.LEVELS.items())
    return f"CASE {named} ELSE {_hit_sql(x, text.LEVELS, 'yearly')} END"


#: What a description may say, and what hint may stand beside it, dealt out by the key.
_SAID = ["in every city", "省 GDP", "nationwide", "日度", "by month, 月频", "annual", "as such", "地级", "of Germany", "美国", "中国", "World Bank", "at the moon"]
_HINTS = ["", "monthly", "省级", "nationwide", "unknown", "CITY"]


def _described(spark, sf):
    of = lambda words, k: F.get(F.array(*map(F.lit, words)), (F.col("c_custkey") % k).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", of(_SAID, len(_SAID))).alias("description"), F.nullif(of(_HINTS, len(_HINTS)), F.lit("")).alias("hint"))


_DESCRIBED = f"(SELECT c_custkey, c_mktsegment || ' ' || {_SAID}[c_custkey % {len(_SAID)} + 1] AS description, {_HINTS}[c_custkey % {len(_HINTS)} + 1] AS hint FROM customer)"


@query(f"SELECT c_custkey, {_level_sql('description', 'hint')} AS level, {_hit_sql('description', text.LEVELS, 'yearly')} AS plain FROM {_DESCRIBED}")
def inferred_levels(spark, sf):
    return _described(spark, sf).select("c_custkey", text.infer_level(F.col("description"), F.col("hint")).alias("level"), text.infer_level(F.col("description")).alias("plain"))


@query(f"SELECT c_custkey, {_hit_sql('description', text.PLACES, 'global')} AS place, {_hit_sql(chr(40) + 'description || chr(32) || hint' + chr(41), text.PLACES, 'global')} AS hinted FROM {_DESCRIBED}")
def inferred_places(spark, sf):
    return _described(spark, sf).select("c_custkey", text.infer_place(F.col("description")).alias("place"), text.infer_place(F.col("description"), F.col("hint")).alias("hinted"))


@query(f"SELECT n_nationkey, ({_match_sql('n_name', 'r_name')})::DOUBLE AS score, ({_match_sql('n_name', chr(39) + 'nation 7, of ' + chr(39) + ' || r_name')})::DOUBLE AS loose FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_scores(spark, sf):
    x = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    return x.select("n_nationkey", text.text_match(F.col("n_name"), F.col("r_name")).alias("score"), text.text_match(F.col("n_name"), F.concat(F.lit("nation 7, of "), "r_name")).alias("loose"))


@query(f"""
    WITH r AS (SELECT DISTINCT p_type AS name, p_type || CASE WHEN p_size % 2 = 0 THEN ' by city' ELSE '' END AS d, CASE WHEN p_size % 3 = 0 THEN 'monthly' ELSE '' END AS hint FROM part),
    c AS (SELECT DISTINCT p_name AS key, p_type AS t, CASE WHEN p_size > 25 THEN 'city' ELSE 'monthly' END AS cl FROM part),
    l AS (SELECT name, d, {_level_sql('d', 'hint')} AS l FROM r),
    s AS (SELECT name, key, 0.35 * ({_match_sql('d', 't')})::DOUBLE + 0.35 * ({_match_sql('name', 'key')})::DOUBLE + 0.15 * CASE WHEN contains(cl, l) OR contains(l, cl) THEN 1.0 ELSE 0.5 END + CASE WHEN lower(name) = lower(key) THEN 0.15 ELSE 0 END AS s FROM l, c),
    b AS (SELECT name, key, round(max(s), 3)::DOUBLE AS score FROM s WHERE s >= 0.3 GROUP BY ALL)
    SELECT name, count(*) AS entries, max(score) AS best, round(sum(score), 2) AS total FROM b GROUP BY name
""")
def requirement_search(spark, sf):
    p = table(spark, sf, "part")
    needs = p.select(F.col("p_type").alias("name"), F.concat("p_type", F.when(F.col("p_size") % 2 == 0, " by city").otherwise("")).alias("description"), F.when(F.col("p_size") % 3 == 0, "monthly").alias("level"), F.lit(None).cast("string").alias("place"))
    catalogue = p.select(F.col("p_name").alias("key"), F.col("p_type").alias("search_text"), F.when(F.col("p_size") > 25, "city").otherwise("monthly").alias("level")).distinct()
    found = reshape.search_requirements(needs, catalogue, top=1 << 30).groupBy("name", "key").agg(F.max("score").alias("score"))
    return found.groupBy("name").agg(F.count("key").alias("entries"), F.max("score").alias("best"), F.round(F.sum("score"), 2).alias("total"))


# --- cleaning and validation ---------------------------------------------------------------------------------------

#: A panel with holes: y is null where the key and year say so, and some rows are missing.
_HOLES = f"""(SELECT entity_id, year, CASE WHEN (entity_id * 7 + year) % 11 < 3 OR entity_id % 41 = 0 THEN NULL ELSE y END AS y, treated, post, first_treated, quantity
              FROM ({SUPPLIER_YEAR_SQL}) WHERE (entity_id + year) % 17 <> 0)"""


def _holes(spark, sf):
    p = panels.supplier_year(spark, sf).where((F.col("entity_id") + F.col("year")) % 17 != 0)
    gone = ((F.col("entity_id") * 7 + F.col("year")) % 11 < 3) | (F.col("entity_id") % 41 == 0)
    return p.withColumn("y", F.when(~gone, F.col("y")))


@query(f"""
    SELECT count(DISTINCT entity_id) AS entities, count(DISTINCT year) AS periods, count(*) AS n_rows, count(DISTINCT entity_id) * count(DISTINCT year) AS expected,
           count(*) = count(DISTINCT entity_id) * count(DISTINCT year) AS balanced, round(100 * (1 - count(*) / (count(DISTINCT entity_id) * count(DISTINCT year))), 1) AS missing_pct FROM ({NATION_YEAR_SQL})
""")
def panel_balance(spark, sf):
    return clean.balance(panels.nation_year(spark, sf), "entity_id", "year")


@query(f"""
    WITH h AS (SELECT entity_id, year, y IS NULL AS gone, row_number() OVER w AS i, count(*) OVER e AS n, count(y) OVER e AS k FROM {_HOLES} WINDOW w AS (PARTITION BY entity_id ORDER BY year), e AS (PARTITION BY entity_id)),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY entity_id, gone ORDER BY year) AS island FROM h),
    g AS (SELECT entity_id, min(year) AS start, max(year) AS stop, count(*) AS length, min(i) AS lo, max(i) AS hi, any_value(n) AS n, any_value(k) AS k FROM r WHERE gone GROUP BY entity_id, island)
    SELECT entity_id, start, stop, length, CASE WHEN k = 0 THEN 'systematic' WHEN length > 1 THEN 'gap_run' WHEN lo = 1 OR hi = n THEN 'boundary' ELSE 'sporadic' END AS kind FROM g
""")
def missing_runs(spark, sf):
    return clean.missing_runs(_holes(spark, sf), "entity_id", "year", "y")


@query(f"""
    WITH h AS (SELECT entity_id, year, y, lag(y) OVER w AS a, lead(y) OVER w AS b, count(*) OVER (PARTITION BY entity_id) AS n FROM {_HOLES} WINDOW w AS (PARTITION BY entity_id ORDER BY year))
    SELECT entity_id, year, round(CASE WHEN y IS NULL AND n >= 3 THEN (a + b) / 2 ELSE y END, 6) AS y, (y IS NULL AND n >= 3 AND a + b IS NOT NULL)::INT AS y_imputed FROM h
""")
def impute_sporadic(spark, sf):
    return rounded(clean.impute_sporadic(_holes(spark, sf).select("entity_id", "year", "y"), "entity_id", "year", "y"))


@query(f"""
    WITH h AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity_id) AS n, count(y) OVER (PARTITION BY entity_id) AS k FROM {_HOLES} WINDOW w AS (PARTITION BY entity_id ORDER BY year)),
    s AS (SELECT count(DISTINCT entity_id) AS entities, count(*) - count(y) AS missing, count(*) AS n, count(DISTINCT entity_id) FILTER (k = 0) AS systematic, count(*) FILTER (k > 0 AND y IS NULL AND i > 1 AND i < n AND a IS NOT NULL AND b IS NOT NULL) AS sporadic,
                 count(*) FILTER (k > 0 AND y IS NULL AND (i = 1 AND b IS NOT NULL OR i = n AND a IS NOT NULL)) AS boundary, count(*) FILTER (k > 0 AND y IS NULL AND (i = 1 OR a IS NOT NULL) AND i < n AND b IS NULL) AS gap_runs FROM h)
    SELECT 'y' AS variable, missing, round(100.0 * missing / n, 4)::DOUBLE AS pct, entities, systematic, sporadic, boundary, gap_runs,
           CASE WHEN systematic > 0.3 * entities THEN 'warn_systematic' WHEN sporadic > 0.3 * entities THEN 'warn_sporadic' WHEN gap_runs > 0 THEN 'has_gaps' WHEN missing > 0 THEN 'minor' ELSE 'ok' END AS verdict FROM s
""")
def missing_verdicts(spark, sf):
    return clean.missing_verdicts(_holes(spark, sf), "entity_id", "year", ["y"])


@query(f"SELECT entity_id, year, round(last_value(y IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY year), 6) AS y FROM {_HOLES}")
def forward_filled(spark, sf):
    return rounded(clean.forward_fill(_holes(spark, sf).select("entity_id", "year", "y"), "entity_id", "year", ["y"]))


@query(f"SELECT entity_id, year FROM (SELECT entity_id, year, row_number() OVER (PARTITION BY entity_id ORDER BY year) AS r FROM ({USER_DAY_SQL.replace('day(ts) AS day', 'day(ts) AS year')})) WHERE r <= 3")
def first_days(spark, sf):
    return clean.head_samples(panels.user_day(spark, sf).select("entity_id", F.col("day").alias("year")), "entity_id", "year", 3)


@query("SELECT n_nationkey AS key, CASE WHEN n_nationkey < 5 THEN (SELECT r_name FROM region WHERE r_regionkey = n_nationkey) ELSE n_name END AS name FROM nation")
def ordered_union(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return clean.ordered_union([r, table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), r], "key")


@query(f"""
    WITH p AS ({SUPPLIER_YEAR_SQL}), a AS (SELECT entity_id, year, y FROM p WHERE entity_id % 3 <> 0), b AS (SELECT entity_id, year, quantity FROM p WHERE year > 1996), c AS (SELECT entity_id, year, discount FROM p WHERE (entity_id + year) % 2 = 0)
    SELECT entity_id, year, round(y, 6) AS y, round(quantity, 6) AS quantity, round(discount, 6) AS discount FROM a FULL JOIN b USING (entity_id, year) FULL JOIN c USING (entity_id, year)
""")
def merge_panels(spark, sf):
    p = panels.supplier_year(spark, sf)
    parts = {"y": p.where("entity_id % 3 <> 0"), "quantity": p.where("year > 1996"), "discount": p.where("(entity_id + year) % 2 = 0")}
    return rounded(clean.merge_panels(parts))


@query(f"""
    WITH d AS (SELECT o_custkey::VARCHAR AS entity_id, year(o_orderdate)::INT AS year, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS r FROM orders)
    SELECT entity_id, year, price FROM d WHERE r = 1
""")
def load_variable_first_row(spark, sf):
    raw = table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("city_id"), F.year("o_orderdate").cast("string").alias("年份"), F.col("o_totalprice").cast("string").alias("price"), "o_orderkey")
    return clean.load_variable(raw, "price", order=F.col("o_orderkey"))


@query("""
    SELECT c_custkey, CASE WHEN n_name IS NOT NULL THEN 'N' || c_nationkey ELSE 'x' END AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def normalise_names(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    # a third as written, a third with brackets, a third with a wrong letter, which only likeness finds
    odd = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("n_name"), F.lit(" (x)"))).when(F.col("c_custkey") % 3 == 1, F.translate("n_name", "O", "X")).otherwise(F.col("n_name"))
    mapping = table(spark, sf, "nation").select(F.col("n_name").alias("alias"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_nationkey").alias("position"))
    return clean.normalise_entities(c.select("c_custkey", odd.alias("nation")), "nation", mapping)


@query(f"""
    SELECT entity_id, year, round(y, 6) AS y, first_treated, (first_treated IS NOT NULL)::INT AS treated, coalesce((year >= first_treated)::INT, 0) AS post, (first_treated IS NOT NULL)::INT * coalesce((year >= first_treated)::INT, 0) AS treated_post
    FROM ({SUPPLIER_YEAR_SQL})
""")
def attach_treatment(spark, sf):
    p = panels.supplier_year(spark, sf)
    return rounded(clean.attach_treatment(p.select("entity_id", "year", "y"), p.select("entity_id", "first_treated").distinct()))


@query(f"SELECT 'y' AS variable, count(*) - count(y) AS missing, round(100.0 * (count(*) - count(y)) / count(*), 4)::DOUBLE AS pct FROM {_HOLES} UNION ALL SELECT 'quantity', count(*) - count(quantity), round(100.0 * (count(*) - count(quantity)) / count(*), 4) FROM {_HOLES}")
def missing_values(spark, sf):
    return validate.missing_values(_holes(spark, sf), ["y", "quantity"])


@query(f"SELECT year, count(*) AS n_rows, count(y) AS complete FROM {_HOLES} GROUP BY year")
def complete_by_period(spark, sf):
    return validate.complete_by_period(_holes(spark, sf), "year", ["y", "quantity"])


@query("""
    WITH q AS (SELECT quantile_cont(o_totalprice::DOUBLE, 0.25) AS a, quantile_cont(o_totalprice::DOUBLE, 0.75) AS b, quantile_cont(o_totalprice::DOUBLE, 0.01) AS p1, quantile_cont(o_totalprice::DOUBLE, 0.99) AS p99 FROM orders)
    SELECT 'o_totalprice' AS variable, count(*) AS n, count(*) FILTER (o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)) AS outliers,
           round(100.0 * count(*) FILTER (o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a)) / count(*), 4)::DOUBLE AS pct, round(any_value(p1), 4) AS p1, round(any_value(p99), 4) AS p99 FROM orders, q
""")
def outliers_iqr(spark, sf):
    return rounded(validate.outliers(table(spark, sf, "orders"), ["o_totalprice"], threshold=0.5), 4)


@query("""
    WITH q AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, quantile_cont(o_totalprice::DOUBLE, 0.01) AS p1, quantile_cont(o_totalprice::DOUBLE, 0.99) AS p99 FROM orders)
    SELECT 'o_totalprice' AS variable, count(*) AS n, count(*) FILTER (abs(o_totalprice - m) > 1.5 * s) AS outliers, round(100.0 * count(*) FILTER (abs(o_totalprice - m) > 1.5 * s) / count(*), 4)::DOUBLE AS pct,
           round(any_value(p1), 4) AS p1, round(any_value(p99), 4) AS p99 FROM orders, q
""")
def outliers_z(spark, sf):
    return rounded(validate.outliers(table(spark, sf, "orders"), ["o_totalprice"], "z", 1.5), 4)


@query(f"""
    WITH h AS MATERIALIZED (SELECT * FROM {_HOLES}), np AS (SELECT count(DISTINCT year) AS np, max(year) AS top, count(*) AS rows FROM h),
    steps AS (SELECT year - lag(year) OVER (ORDER BY year) AS d FROM (SELECT DISTINCT year FROM h)),
    e AS (SELECT entity_id, count(DISTINCT year) AS p, count(DISTINCT treated) AS kinds, count(DISTINCT first_treated) AS starts, max(treated) AS d, min(first_treated) AS ft, count(*) FILTER (post = 1 AND year < first_treated) AS early,
                 count(y) FILTER (year < first_treated) AS outcomes FROM h GROUP BY entity_id),
    q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM h), o AS (SELECT count(*) FILTER (y < a - 3 * (b - a) OR y > b + 3 * (b - a)) AS k, count(y) AS n FROM h, q),
    i AS (
        SELECT 'duplicate_keys' AS "check", 'critical' AS severity, 'rows share an entity and period' AS detail, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM h GROUP BY entity_id, year)
        UNION ALL SELECT 'incomplete_entities', 'warning', 'entities lack periods', count(*) FILTER (p < np) FROM e, np
        UNION ALL SELECT 'uneven_time', 'warning', 'steps differ from the median by over a tenth', count(*) FILTER (abs(d - m) > 0.1 * abs(m)) FROM steps, (SELECT quantile_cont(d, 0.5) AS m FROM steps)
        UNION ALL SELECT 'treatment_values', 'critical', 'treatment values other than 0 and 1', count(*) FILTER (treated NOT IN (0, 1)) FROM h
        UNION ALL SELECT 'null_ids', 'critical', 'rows without an entity', count(*) FILTER (entity_id IS NULL) FROM h
        UNION ALL SELECT 'constant_y', 'critical', 'y doesn''t vary', (count(DISTINCT y) <= 1)::INT FROM h
        UNION ALL SELECT 'missing_values', 'warning', 'y', CASE WHEN 100.0 * (count(*) - count(y)) / count(*) > 5 THEN count(*) - count(y) ELSE 0 END FROM h
        UNION ALL SELECT 'outliers', 'warning', 'y', CASE WHEN 100.0 * k / n > 1 THEN k ELSE 0 END FROM o
        UNION ALL SELECT 'treatment_varies', 'warning', 'treatment changes within entities', count(*) FILTER (kinds > 1) FROM e
        UNION ALL SELECT 'several_starts', 'critical', 'entities with several first periods', count(*) FILTER (starts > 1) FROM e
        UNION ALL SELECT 'post_before_start', 'critical', 'post is 1 before the first treated period', count(*) FILTER (early > 0) FROM e
        UNION ALL SELECT 'never_with_start', 'critical', 'never-treated entities with a first period', count(*) FILTER (d = 0 AND ft IS NOT NULL) FROM e
        UNION ALL SELECT 'treated_at_end', 'warning', 'treated at or after the last period', count(*) FILTER (ft >= top) FROM e, np
        UNION ALL SELECT 'pretreatment', 'critical', 'treated entities with too few periods before', count(*) FILTER (ft IS NOT NULL AND outcomes < 2) FROM e
    )
    SELECT CASE WHEN bool_or(severity = 'critical') OVER () THEN 'FAIL' ELSE 'WARN' END AS verdict, "check", severity, detail, n FROM i WHERE n > 0
""")
def validate_panel(spark, sf):
    return validate.validate(_holes(spark, sf), PLAIN)


@query(f"SELECT entity_id, count(*) FILTER (year < first_treated) AS periods, count(y) FILTER (year < first_treated) AS outcomes, count(y) FILTER (year < first_treated) >= 2 AS enough FROM {_HOLES} WHERE first_treated IS NOT NULL GROUP BY entity_id")
def pretreatment_periods(spark, sf):
    return validate.pretreatment(_holes(spark, sf), PLAIN)


_SMD = "abs(avg({c}) FILTER (d = 1) - avg({c}) FILTER (d = 0)) / sqrt((var_samp({c}) FILTER (d = 1) + var_samp({c}) FILTER (d = 0)) / {k})"


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, round(avg({c}) FILTER (d = 1), 6) AS treated_mean, round(avg({c}) FILTER (d = 0), 6) AS control_mean, round({_SMD.format(c=c, k=2)}, 6) AS smd FROM ({LINE_ITEMS_SQL})" for c in ("size", "quantity")))
def covariate_balance(spark, sf):
    return rounded(validate.smd(panels.line_items(spark, sf), "d", ["size", "quantity"]))


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, round(avg({c}) FILTER (d = 1), 6) AS treated_mean, round(avg({c}) FILTER (d = 0), 6) AS control_mean, round({_SMD.format(c=c, k=1)}, 6) AS smd FROM (SELECT *, treated AS d FROM ({SUPPLIER_YEAR_SQL}) WHERE year < 1997)" for c in ("y", "quantity")))
def descriptive_statistics(spark, sf):
    return rounded(validate.descriptives(panels.supplier_year(spark, sf), PLAIN, ["y", "quantity"]))


@query(f"SELECT 100 * avg(k::INT) AS pct_switching, CASE WHEN avg(k::INT) = 0 THEN 'FAIL' WHEN 100 * avg(k::INT) >= 5 THEN 'PASS' ELSE 'UNCERTAIN' END AS verdict FROM (SELECT entity_id, count(DISTINCT treated * post) > 1 AS k FROM ({SUPPLIER_YEAR_SQL}) GROUP BY entity_id)")
def treatment_variation(spark, sf):
    return validate.treatment_variation(panels.supplier_year(spark, sf).withColumn("s", F.col("treated") * F.col("post")), "entity_id", "s")


@query(f"WITH a AS (SELECT avg(taken) FILTER (x >= 4500) AS rate, avg(taken) FILTER (x < 4500) AS control_rate FROM ({ORDERS_BY_BALANCE_SQL})) SELECT round(rate, 6) AS rate, round(control_rate, 6) AS control_rate, CASE WHEN rate >= 0.8 THEN 'PASS' WHEN rate < 0.5 THEN 'FAIL' ELSE 'UNCERTAIN' END AS verdict FROM a")
def compliance(spark, sf):
    return rounded(validate.compliance(panels.orders_by_balance(spark, sf).withColumn("assigned", (F.col("x") >= 4500).cast("int")), "assigned", "taken"))


@query(f"""
    WITH p AS ({USER_DAY_SQL}), e AS (SELECT min(day) AS lo, max(day) AS hi FROM p), u AS (SELECT entity_id, max(treated) AS d, bool_or(day = lo) AS a, bool_or(day = hi) AS b FROM p, e GROUP BY entity_id),
    r AS (SELECT avg((NOT b)::INT) FILTER (d = 1) AS t, avg((NOT b)::INT) FILTER (d = 0) AS c FROM u WHERE a)
    SELECT round(t, 6) AS treated_rate, round(c, 6) AS control_rate, round(abs(t - c), 6) AS difference, CASE WHEN abs(t - c) < 0.05 THEN 'PASS' ELSE 'UNCERTAIN' END AS verdict FROM r
""")
def attrition(spark, sf):
    return rounded(validate.attrition(panels.user_day(spark, sf), "entity_id", "day", "treated"))


@query(f"SELECT bool_or(d = 1 AND quantity <= 25) AS a_only, bool_or(d = 0 AND quantity > 25) AS b_only, bool_or(d = 1 AND quantity <= 25) AND bool_or(d = 0 AND quantity > 25) AS separable FROM ({LINE_ITEMS_SQL})")
def policy_overlap(spark, sf):
    return validate.policy_overlap(panels.line_items(spark, sf).withColumn("b", (F.col("quantity") > 25).cast("int")), "d", "b")


# --- reshaping, catalogues, text -----------------------------------------------------------------------------------


@query(f"SELECT entity_id, year, 'quantity' AS series, round(quantity, 6) AS value FROM ({SUPPLIER_YEAR_SQL}) UNION ALL SELECT entity_id, year, 'discount', round(discount, 6) FROM ({SUPPLIER_YEAR_SQL})")
def wide_to_long(spark, sf):
    return rounded(reshape.wide_to_long(panels.supplier_year(spark, sf), ["entity_id", "year"], {"quantity": "quantity", "discount": "discount"}, "series"))


@query("SELECT 'events' AS entity_id, year(ts)::INT AS year, month(ts)::INT AS month, round(quantile_cont(value::DOUBLE, 0.5), 6) AS value FROM events GROUP BY ALL")
def aggregate_by_month(spark, sf):
    return rounded(reshape.aggregate_by_month(table(spark, sf, "events"), "ts", "events", "value", "median"))


@query(f"SELECT year, {', '.join(f'round(max(y) FILTER (entity_id = {k}), 6) AS n{k}' for k in range(25))} FROM ({NATION_YEAR_SQL}) GROUP BY year")
def pivot_entities(spark, sf):
    p = panels.nation_year(spark, sf).withColumn("s", F.concat(F.lit("n"), F.col("entity_id").cast("string")))
    return rounded(reshape.pivot_wide(p, "year", "s", "y"))


@query("""
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_partkey * 10000.0 WHEN 1 THEN p_partkey * 1e8 WHEN 2 THEN p_partkey * 1e12 WHEN 3 THEN p_partkey + 0.5 END::DOUBLE AS amount FROM part
""")
def parse_amounts(spark, sf):
    k = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_size") % 5 == 0, F.concat(k, F.lit("万"))).when(F.col("p_size") % 5 == 1, F.concat(k, F.lit(" 亿"))).when(F.col("p_size") % 5 == 2, F.concat(k, F.lit("万亿"))).when(F.col("p_size") % 5 == 3, F.concat(k, F.lit(".5"))).otherwise("none")
    return table(spark, sf, "part").select("p_partkey", text.parse_amount(raw).alias("amount"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("SELECT s_suppkey, CASE WHEN abs(s_acctbal) >= 1000 THEN printf('%.2f', s_acctbal) ELSE printf('%.4f', s_acctbal) END AS shown FROM supplier WHERE s_acctbal <> 0")
def formatted_numbers(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal <> 0").select("s_suppkey", stats.format_number(F.col("s_acctbal")).alias("shown"))


@query("SELECT o_orderkey, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars FROM (SELECT o_orderkey, (o_orderkey % 200) / 1000.0 AS p FROM orders)")
def significance_stars(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", stats.stars((F.col("o_orderkey") % 200) / 1000.0).alias("stars"))


@query(f"""
    WITH c AS (SELECT DISTINCT p_type AS key, p_brand AS description FROM part), q AS (SELECT DISTINCT p_type AS query FROM part),
    s AS (SELECT query, key, round(0.35 * ({_match_sql("query", "description")})::DOUBLE + 0.35 * ({_match_sql("query", "key")})::DOUBLE + 0.15 + CASE WHEN lower(query) = lower(key) OR lower(query) = lower(description) THEN 0.15 ELSE 0 END, 6)::DOUBLE AS score FROM q, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s WHERE score >= 0.1)
    SELECT query, key, score, rank::INT AS rank FROM r WHERE rank <= 3
""")
def catalogue_search(spark, sf):
    parts = table(spark, sf, "part")
    catalogue = parts.select(F.col("p_type").alias("key"), F.col("p_brand").alias("description"), F.lit("yearly").alias("level")).distinct()
    return reshape.search_catalogue(parts.select(F.col("p_type").alias("query"), F.lit("yearly").alias("level")).distinct(), catalogue, 3)


@query("""
    WITH b AS (SELECT DISTINCT lower(p_type) AS key, lower(p_name) AS description FROM part), a AS (SELECT unnest(['steel', 'copper', 'nothing_like_it']) AS concept),
    s AS (SELECT concept, key, (CASE WHEN key = concept THEN 100 WHEN contains(key, concept) THEN 50 ELSE 0 END + CASE WHEN contains(description, replace(concept, '_', ' ')) THEN 40 ELSE 0 END
                 + 5 * len(list_intersect(list_distinct(string_split(replace(concept, '_', ' '), ' ')), list_distinct(string_split(description, ' ')))))::INT AS score FROM a, b),
    m AS (SELECT concept, max(score) AS score FROM s WHERE score > 0 GROUP BY concept), k AS (SELECT m.concept, m.score, max(key) AS key FROM m JOIN s ON m.concept = s.concept AND m.score = s.score GROUP BY ALL)
    SELECT a.concept, key, score, CASE WHEN score >= 50 THEN 'A' WHEN score IS NOT NULL THEN 'B' ELSE 'C' END AS tier FROM a LEFT JOIN k USING (concept)
""")
def data_requirements(spark, sf):
    parts = table(spark, sf, "part")
    catalogue = parts.select(F.lower("p_type").alias("key"), F.lower("p_name").alias("description")).distinct()
    concepts = spark.createDataFrame([("steel",), ("copper",), ("nothing_like_it",)], "concept string")
    return reshape.requirements(reshape.match_concepts(concepts, catalogue), concepts)


_CONCEPTS = [("steel_x", "a survey of metals", "city", "cn"), ("zzz_qq", "zzz qq", "province", "cn"), ("pilot_y", "a pilot policy", None, None), ("got_it", "there already", None, None)]


@query("""
    SELECT min(p_type) AS name, 'available' AS section, min(p_type) AS key, 0.65::DOUBLE AS score, min(p_type) || ', ' || min(p_type) AS alternatives, 'A' AS tier, NULL::VARCHAR AS suggestion FROM part
    UNION ALL VALUES ('got_it', 'fetched', NULL, NULL, NULL, 'A', NULL), ('steel_x', 'needed', NULL, NULL, NULL, 'B', 'survey data, after registration'), ('zzz_qq', 'needed', NULL, NULL, NULL, 'C', 'statistical yearbooks, or by hand'),
        ('pilot_y', 'needed', NULL, NULL, NULL, 'C', 'policy documents, by hand')
""")
def data_gaps(spark, sf):
    parts = table(spark, sf, "part")
    known = parts.agg(F.min("p_type")).first()[0]
    needs = spark.createDataFrame([(known, "a kind of part", None, None), *_CONCEPTS], "name string, description string, level string, place string")
    catalogue = parts.select(F.col("p_type").alias("key"), F.col("p_brand").alias("description"), F.lit("yearly").alias("level")).distinct()
    found = reshape.search_catalogue(needs.select(F.col("name").alias("query"), F.lit("yearly").alias("level")), catalogue, 3)
    return reshape.gap_report(needs, found, spark.createDataFrame([("got_it", "cached")], "name string, status string"))


@query("SELECT page_id, list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"''#]+)', 1)).len() AS links FROM pages")
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.array_distinct(text.links(F.col("html")))).cast("long").alias("links"))


@query()
def html_statistical_table(spark, sf):
    cells = html_tables.table_cells(table(spark, sf, "pages"), "page_id", "html")
    return html_tables.statistical_values(cells, "page_id", "GDP", 2020)


@query("""
    SELECT * FROM (SELECT n_regionkey AS page_id, n_name AS entity_id, unnest([2019, 2020])::INT AS year, unnest([(1 + n_nationkey) * 1234.5, n_nationkey * 10000.0])::DOUBLE AS value FROM nation) WHERE value > 0
""")
def statistical_tables_of_nations(spark, sf):
    """A page per region with a table of its nations, read back for both years."""
    n = table(spark, sf, "nation").withColumn("row", F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td>"), F.format_number((F.col("n_nationkey") + 1) * 1234.5, 1), F.lit("</td><td>"), F.col("n_nationkey").cast("string"), F.lit("万</td></tr>")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "row"))), lambda x: x["row"]), "")
    pages = n.groupBy(F.col("n_regionkey").alias("page_id")).agg(F.concat(F.lit("<html><body><p>x</p><table><tr><td colspan=3>Table</td></tr><tr><th>Nation</th><th>GDP 2019</th><th>GDP 2020</th></tr>"), body, F.lit("</table>")).alias("html"))
    cells = html_tables.table_cells(pages, "page_id", "html")
    return html_tables.statistical_values(cells, "page_id", "GDP", 2019).union(html_tables.statistical_values(cells, "page_id", "GDP", 2020))


# --- payloads of connectors, made of the tables and read back --------------------------------------------------------


def _nation_year(spark, sf):
    return panels.nation_year(spark, sf).join(F.broadcast(table(spark, sf, "nation")), F.col("entity_id") == F.col("n_nationkey")).select("n_name", "year", "y")  # 25 nations


_NATION_YEAR_NAMED = f"SELECT n_name AS entity_id, year::INT AS year, round(y, 6) AS value FROM ({NATION_YEAR_SQL}) JOIN nation ON entity_id = n_nationkey"


def _by_nation(spark, sf, entry, body: str):
    """(name, json) a nation; ``entry`` makes an entry of the map or list of a year that ``body`` holds at %s."""
    rows = _nation_year(spark, sf).groupBy(F.col("n_name").alias("name")).agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("x"))
    head, tail = body.split("%s")
    return rows.select("name", F.concat(F.lit(head), "x", F.lit(tail)).alias("json"))


@query(_NATION_YEAR_NAMED)
def payload_oecd(spark, sf):
    at = F.concat(F.lit('"0:'), (F.col("year") - 1990).cast("string"), F.lit('":['), F.col("y").cast("string"), F.lit(",0]"))
    periods = ",".join(f'{{"id":"{1990 + k}"}}' for k in range(30))
    body = '{"dataSets":[{"observations":{%s}}],"structure":{"dimensions":{"observation":[{"name":"MEASURE","keyPosition":0},{"name":"TIME_PERIOD","keyPosition":1,"values":[' + periods + "]}]}}}"
    return rounded(readers.oecd(_by_nation(spark, sf, at, body)))


@query(_NATION_YEAR_NAMED)
def payload_eurostat(spark, sf):
    at = F.concat(F.lit('"'), (30 + F.col("year") - 1990).cast("string"), F.lit('":'), F.col("y").cast("string"))
    periods = ",".join(f'"{1990 + k}":{k}' for k in range(30))
    body = '{"value":{%s},"id":["unit","time"],"size":[2,30],"dimension":{"time":{"category":{"index":{' + periods + "}}}}}"
    return rounded(readers.eurostat(_by_nation(spark, sf, at, body)))


@query("SELECT 'orders' AS entity_id, date, round(value, 6) AS value FROM (SELECT make_date(year(o_orderdate), month(o_orderdate), 1) AS date, avg(o_totalprice) AS value FROM orders GROUP BY ALL)")
def payload_fred(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").cast("string").alias("date")).agg(F.avg("o_totalprice").cast("string").alias("value"))
    o = o.union(spark.createDataFrame([("2030-01-01", ".")], "date string, value string"))
    return rounded(readers.fred(o.agg(F.to_json(F.struct(F.collect_list(F.struct("date", "value")).alias("observations"))).alias("json")), "orders"))


@query(f"SELECT entity_id, year, 'M13' AS period, 'Annual' AS period_name, value FROM ({_NATION_YEAR_NAMED})")
def payload_bls(spark, sf):
    each = F.struct(F.col("year").cast("string").alias("year"), F.lit("M13").alias("period"), F.lit("Annual").alias("periodName"), F.col("y").cast("string").alias("value"))
    series = _nation_year(spark, sf).groupBy(F.col("n_name").alias("seriesID")).agg(F.collect_list(each).alias("data"))
    return rounded(readers.bls(series.select(F.to_json(F.struct(F.struct(F.array(F.struct("seriesID", "data")).alias("series")).alias("Results"))).alias("json"))))


@query(_NATION_YEAR_NAMED)
def payload_national_statistics(spark, sf):
    rows = _nation_year(spark, sf)
    code = F.concat(F.lit("c"), F.crc32("n_name").cast("string"))
    wds = F.array(F.struct(F.lit("reg").alias("wdcode"), code.alias("valuecode")), F.struct(F.lit("sj").alias("wdcode"), F.col("year").cast("string").alias("valuecode")))
    nodes = rows.agg(F.collect_list(F.struct(F.struct(F.col("y").alias("data"), F.lit(True).alias("hasdata")).alias("data"), wds.alias("wds"))).alias("datanodes"), F.collect_set(F.struct(code.alias("code"), F.col("n_name").alias("cname"))).alias("n"))
    named = F.array(F.struct(F.lit("reg").alias("wdcode"), F.col("n").alias("nodes")))
    return rounded(readers.national_statistics(nodes.select(F.to_json(F.struct(F.struct("datanodes", named.alias("wdnodes")).alias("returndata"))).alias("json"))))


@query(_NATION_YEAR_NAMED)
def payload_world_bank(spark, sf):
    wide = _nation_year(spark, sf).groupBy(F.col("n_name").alias("economy")).pivot("year", list(range(1995, 2003))).agg(F.first("y"))
    return rounded(readers.world_bank(wide.withColumnsRenamed({str(k): f"YR{k}" for k in range(1995, 2003)})))


@query("SELECT c_name AS name, c_acctbal AS amount, 'fec' AS entity_id FROM customer")
def payload_campaign_finance(spark, sf):
    pages = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))).alias("results"))).alias("json"))
    return readers.campaign_finance(pages, "name:string,amount:double")


@query("SELECT n_name AS entity_id, 2020 AS year, (n_nationkey * 1000)::DOUBLE AS value FROM nation WHERE n_nationkey > 0")
def payload_census(spark, sf):
    return readers.census(table(spark, sf, "nation").select(F.col("n_name").alias("地区"), F.lit("x").alias("备注"), (F.col("n_nationkey") * 1000).cast("string").alias("常住人口")), "total_population", 2020)


@query("SELECT user_id::VARCHAR AS entity_id, ts::DATE AS date, count(*)::DOUBLE AS aqi, round(max(value), 6) AS pm25 FROM events GROUP BY ALL")
def payload_city_air_quality(spark, sf):
    days = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("city"), F.date_format("ts", "yyyy/MM/dd").alias("日期")).agg(F.count(F.lit(1)).alias("AQI"), F.max("value").alias("PM2.5"))
    return rounded(readers.city_air_quality(days, F.col("city")))


@query("SELECT 'sp500' AS entity_id, ts::DATE AS date, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*)::DOUBLE AS volume FROM events GROUP BY ALL")
def payload_stock_index(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("Date")).agg(F.min("value").alias("Low"), F.max("value").alias("High"), F.count(F.lit(1)).alias("Volume"))
    return rounded(readers.stock_index(days, "sp500").select("entity_id", "date", "low", "high", "volume"))


@query("SELECT lpad((l_suppkey % 90)::VARCHAR, 2, '0') || '-' || lpad(l_linenumber::VARCHAR, 3, '0') || '-' || lpad((l_partkey % 9000)::VARCHAR, 4, '0') AS entity_id, l_shipdate::DATE AS date, CASE WHEN l_returnflag = 'R' THEN l_tax ELSE l_discount END AS value, l_returnflag AS parameter FROM lineitem")
def payload_air_monitors(spark, sf):
    x = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 90).cast("string").alias("state_code"), F.col("l_linenumber").cast("string").alias("county_code"), (F.col("l_partkey") % 9000).cast("string").alias("site_number"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_local"), F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("arithmetic_mean"), F.col("l_tax").alias("sample_measurement"), F.col("l_returnflag").alias("parameter"))
    return readers.air_quality(x)


@query("SELECT l_suppkey::VARCHAR AS entity_id, l_shipdate::DATE AS date, l_quantity / 10 AS temp, CASE WHEN l_linenumber % 2 = 0 THEN l_tax / 10 ELSE 0 END AS max, l_discount / 10 AS min, 0.0::DOUBLE AS prcp, l_linenumber / 10.0::DOUBLE AS wdsp FROM lineitem")
def payload_weather(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("station"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_quantity").cast("string").alias("temp"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("string")).alias("max"), F.col("l_discount").cast("string").alias("min"), F.lit("n/a").alias("prcp"), F.col("l_linenumber").cast("string").alias("wdsp"))
    return readers.weather(x)


@query("SELECT event_id, ts::DATE AS date FROM events WHERE event_type = 'error'")
def payload_open_records(spark, sf):
    x = table(spark, sf, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"))
    return readers.open_records(x, "created_date", "event_type = 'error'").select("event_id", "date")


# --- decisions, reports, streams -----------------------------------------------------------------------------------

_BITS = [c for c, t, _ in decide.FACTS if t == "boolean"]
_FACTS_SQL = f"SELECT o_orderkey::VARCHAR AS policy_id, {', '.join(f'(o_orderkey >> {k}) % 2 = 1 AS {c}' for k, c in enumerate(_BITS))} FROM orders"


def _facts(spark, sf):
    """A policy an order, with facts by the bits of its key, so that 4,096 orders in a row have every combination."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("policy_id"), *((F.shiftright("o_orderkey", k) % 2 == 1).alias(c) for k, c in enumerate(_BITS)))


@query(f"""
    WITH f AS ({_FACTS_SQL}), m AS (SELECT *, CASE WHEN assigned_by_lottery THEN 'random_assignment' WHEN has_threshold THEN 'threshold_rule' WHEN has_instrument THEN 'time_varying_unobservables'
        WHEN NOT has_start_time THEN 'selection_on_observables' WHEN overlapping_policies THEN 'multiple_overlapping_policies' WHEN has_intensity THEN 'continuous_intensity'
        WHEN staggered THEN 'staggered_policy_shock' ELSE 'single_policy_shock' END AS mechanism FROM f)
    SELECT policy_id, mechanism, CASE mechanism WHEN 'random_assignment' THEN 'randomization' WHEN 'threshold_rule' THEN 'rdd' WHEN 'time_varying_unobservables' THEN 'iv'
        WHEN 'selection_on_observables' THEN CASE WHEN many_controls THEN 'dml' ELSE 'psm' END WHEN 'multiple_overlapping_policies' THEN 'ddd' WHEN 'continuous_intensity' THEN 'intensity_did'
        WHEN 'staggered_policy_shock' THEN 'staggered_did' ELSE CASE WHEN never_treated_units THEN 'did' ELSE 'synthetic_did' END END AS method FROM m
""")
def classify_mechanisms(spark, sf):
    return decide.classify(_facts(spark, sf)).select("policy_id", "mechanism", "method")


def _recommendations_sql() -> str:
    listed = ", ".join(f"('{m}', {k}, '{f}')" for k, (m, f, _) in enumerate(decide.FALLBACKS))
    counts = ", ".join(f"('{m}', {sum(a[0] == m for a in decide.ASSUMPTIONS)})" for m in sorted({a[0] for a in decide.ASSUMPTIONS}))
    own = [("has_threshold", "threshold_rule", "rdd"), ("has_instrument", "time_varying_unobservables", "iv"), ("overlapping_policies", "multiple_overlapping_policies", "ddd"), ("has_intensity", "continuous_intensity", "intensity_did"), ("staggered", "staggered_policy_shock", "staggered_did")]
    extra = ", ".join(f"CASE WHEN {c} AND mechanism <> '{m}' THEN '{f}' END" for c, m, f in own)
    return f"""
        WITH c AS ({ORACLE_SQL["classify_mechanisms"]}), f AS ({_FACTS_SQL}), l AS (SELECT m, list(f ORDER BY k) AS fs FROM (VALUES {listed}) AS v(m, k, f) GROUP BY m), n AS (SELECT * FROM (VALUES {counts}) AS v(m, k))
        SELECT policy_id, mechanism, method, CASE mechanism WHEN 'threshold_rule' THEN CASE WHEN perfect_compliance THEN 'sharp' ELSE 'fuzzy' END WHEN 'staggered_policy_shock' THEN CASE WHEN never_treated_units THEN 'never-treated controls' ELSE 'not-yet-treated controls' END END AS variant,
               n.k::INT AS assumptions, array_to_string(list_concat(coalesce(fs, []), list_filter([{extra}], lambda x: x IS NOT NULL)), ',') AS fallbacks
        FROM c JOIN f USING (policy_id) LEFT JOIN l ON l.m = method LEFT JOIN n ON n.m = method
    """


@query(_recommendations_sql())
def method_recommendations(spark, sf):
    r = decide.recommend(_facts(spark, sf))
    return r.select("policy_id", "mechanism", "method", "variant", F.size("assumptions").alias("assumptions"), F.array_join(F.transform("fallbacks", lambda x: x["fallback"]), ",").alias("fallbacks"))


@query("""
    WITH v AS (SELECT o_custkey AS "case", CASE o_orderkey % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'UNCERTAIN' ELSE 'PASS' END AS verdict, o_custkey % 2 = 0 AS changed FROM orders),
    a AS (SELECT "case", count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) AS total, bool_or(changed) AS changed FROM v GROUP BY "case")
    SELECT "case", passed, failed, total, CASE WHEN failed = 0 AND passed >= 0.75 * total AND NOT changed THEN 'strong' WHEN failed = 0 THEN 'moderate' WHEN failed <= 2 AND changed THEN 'suggestive' ELSE 'not identifiable' END AS strength FROM a
""")
def identification_strength(spark, sf):
    o = table(spark, sf, "orders")
    v = F.when(F.col("o_orderkey") % 7 == 0, "FAIL").when(F.col("o_orderkey") % 7 == 1, "UNCERTAIN").otherwise("PASS")
    return decide.strengths(o.select(F.col("o_custkey").alias("case"), v.alias("verdict"), (F.col("o_custkey") % 2 == 0).alias("changed")))


@query()
def evaluation_report(spark, sf):
    return confirm.evaluate(confirm.Case(panels.supplier_year(spark, sf), PLAIN, unit=2, first=1998), Method.DID)


@query("SELECT user_id AS entity_id, date_trunc('day', ts)::TIMESTAMP AS start, count(value) AS n, round(sum(value), 6) AS total, round(sum(value * value), 6) AS squares FROM events GROUP BY ALL")
def stream_entity_windows(spark, sf):
    folder = f"{sinks.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    done = panel_stream.run_once(panel_stream.entity_windows(panel_stream.event_stream(spark, sf)), f"{folder}/windows", f"{folder}/checkpoint")
    return rounded(done.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(f"""
    WITH q AS (SELECT user_id AS e, (day(ts) - 1) // 8 AS t, avg(value) AS y FROM events GROUP BY ALL), p AS (SELECT *, (e % 2 = 0 AND t >= 2)::INT AS d, (t = 1)::INT AS p1, (t = 2)::INT AS p2, (t = 3)::INT AS p3 FROM q),
    z AS MATERIALIZED (SELECT {", ".join(f"{c} - avg({c}) OVER k AS {c}" for c in ("y", "d", "p1", "p2", "p3"))} FROM p WINDOW k AS (PARTITION BY e)), {sweep(moments("z", ["d", "p1", "p2", "p3"]), 4, "m")}
    SELECT round(a0_4, 4) AS coef, (SELECT count(*) FROM p) AS n, (SELECT count(DISTINCT e) FROM p) AS entities FROM m
""")
def stream_did(spark, sf):
    """Events dealt into four files, a batch each, so that later batches have rows of cells of earlier ones."""
    folder = f"{sinks.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf, "events").repartition(4, "event_id").write.parquet(f"{folder}/events.parquet")
    events = panel_stream.event_stream(spark, folder)
    kept = incremental.IncrementalDid(spark, f"{folder}/state", F.col("e") % 2 == 0, F.col("t") >= 2)
    kept.run(events.select(F.col("user_id").alias("e"), F.floor((F.dayofmonth("ts") - 1) / 8).alias("t"), F.col("value").alias("y")), f"{folder}/checkpoint")
    return rounded(kept.estimate(), 4)
