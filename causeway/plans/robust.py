"""Robustness on Gram blocks: placebo permutations, leave-one-out, coefficient bounds, placebo in time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.stats import normal_cdf, solve
from causeway.operators.ranges import kth_of_each_draw, not_after, running_sum
from causeway.plans.did import did_gram, frame, interaction, post_flag
from causeway.plans.gram import Gram
from causeway.sources.sinks import written
from causeway.spec import PanelSpec


def leave_one_out(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(entity, coef, influential): without each entity; influential if over 2 standard deviations from the mean."""
    g = did_gram(df, spec).persist()
    loo = written(g.leave_one_out("did"), "leave-one-out").withColumnRenamed("entity", spec.entity)  # solved once, read twice
    g.free()
    m = loo.agg(F.avg("coef").alias("m"), F.stddev_pop("coef").alias("s"))
    return loo.join(F.broadcast(m)).select(spec.entity, "coef", (F.abs(F.col("coef") - F.col("m")) > 2 * F.col("s")).alias("influential"))


def loo_summary(loo: DataFrame, entity: str) -> DataFrame:
    return loo.agg(F.min("coef").alias("lo"), F.min_by(entity, "coef").alias("lo_entity"), F.max("coef").alias("hi"), F.max_by(entity, "coef").alias("hi_entity"), F.stddev_pop("coef").alias("sd"), F.sum(F.col("influential").cast("long")).alias("influential"))


def _dealt(units: DataFrame, draws: int, quotas: list[int], rows: int, seed: int, order) -> DataFrame:
    """``units`` once for each draw, with ``draw`` and ``_part``: the number of the quota that the unit falls in, by order of (key, _e).

    The first quotas[0] units of a draw get part 0, the next quotas[1] part 1, and so on; the rest get the number of
    quotas. Parts are told by the unit at the end of each quota, of which there is one a draw, so nothing is sorted.
    """
    key = order(F.col("_e"), F.col("draw")).cast("long") if order else F.shiftright(F.xxhash64("_e", "draw", F.lit(seed)), 2)
    every = units.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("key", key)
    ends = [int(x) for x in np.cumsum(quotas)]
    found = kth_of_each_draw(every.select("draw", "key", "_e"), draws, sorted({e for e in ends if 0 < e < rows}), rows)
    kind = units.schema["_e"].dataType.simpleString()
    columns = ", ".join(f"_k{i} long, _u{i} {kind}" for i in range(len(ends)))
    # a quota that ends at 0 has nobody, one that ends at the last unit everybody
    first, last = (-(1 << 63), None), ((1 << 63) - 1, None)
    table = [(d, *(x for e in ends for x in (first if e <= 0 else last if e >= rows else found[d, e]))) for d in range(1, draws + 1)]
    cuts = F.broadcast(units.sparkSession.createDataFrame(table, f"draw int, {columns}"))  # a row a draw
    part = F.lit(0)
    for i in range(len(ends)):
        part = part + F.when(F.coalesce(not_after(F.col("key"), F.col("_e"), F.col(f"_k{i}"), F.col(f"_u{i}")), F.lit(False)), 0).otherwise(1)
    return every.join(cuts, "draw").withColumn("_part", part)


def _coefficients(sums: DataFrame, one) -> DataFrame:
    """(draw, coef) of the rows of sums ``b``, of which there is one a draw."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"draw": batch["draw"], "coef": pd.Series([one(np.asarray(b)) for b in batch["b"]], dtype=float)})

    return sums.mapInPandas(run, "draw int, coef double")


def placebo_permutation(df: DataFrame, spec: PanelSpec, draws: int = 500, seed: int = 42, order=None) -> DataFrame:
    """(draw, coef): the estimate with random treated entities, as many as there are.

    With treatment constant in an entity, the row of treated x post in the sum of blocks is the sum of the
    chosen entities' rows of post, so a draw is a sum, not a refit. Entities are chosen by the least
    values of ``order`` (entity, draw), a hash by default, up to a threshold that counts tell. Draws that are
    collinear have a null.
    """
    g = Gram(df, spec.entity, spec.time, spec.outcome, {"post": F.col(spec.post), **{c: F.col(c) for c in spec.controls}}, keep={"d": F.col(spec.treated).cast("double")}).persist()
    total, _, entities = g.total
    treated = g.blocks.agg(F.sum((F.col("d") > 0).cast("long"))).first()[0] or 0
    k = g.names.index("post")
    units = g.blocks.select("_e", *(F.get("g", F.lit(g.place(k, j))).alias(f"b{j}") for j in range(g.k)))
    chosen = _dealt(units, draws, [treated], entities, seed, order).where("_part = 0")
    sums = chosen.groupBy("draw").agg(F.array(*(F.sum(f"b{j}") for j in range(g.k))).alias("b"))
    cols = [j for j in range(g.k - 1) if j != k]

    def one(b: np.ndarray) -> float | None:
        xx = np.empty((len(cols) + 1,) * 2)
        xx[1:, 1:] = total[np.ix_(cols, cols)]
        xx[0, 0], xx[0, 1:], xx[1:, 0] = b[k], b[cols], b[cols]
        # what treated x post has beyond the other columns
        free = b[k] - b[cols] @ solve(xx[1:, 1:], b[cols]) if cols else b[k]
        return float(solve(xx, np.concatenate([[b[-1]], total[cols, -1]]))[0]) if free > 1e-9 * max(b[k], 1e-300) else None

    found = frame(df, [r.asDict() for r in _coefficients(sums, one).collect()], "draw int, coef double")  # a row a draw
    g.free()
    return found


def placebo_summary(draws: DataFrame, actual: float) -> DataFrame:
    """Share of draws at least as large as the estimate in size, and the draws' moments."""
    ok = draws.where("coef is not null and not isnan(coef)")
    return ok.agg(F.count(F.lit(1)).alias("draws"), F.avg((F.abs("coef") >= abs(actual)).cast("double")).alias("p"), F.avg("coef").alias("mean"), F.stddev_pop("coef").alias("sd"), F.percentile("coef", F.array(F.lit(0.025), F.lit(0.975))).alias("range")).withColumn("actual", F.lit(float(actual)))


def staggered_placebo(df: DataFrame, spec: PanelSpec, draws: int = 200, seed: int = 42, order=None) -> DataFrame:
    """(draw, coef): first treated periods dealt anew among the treated entities, in the order of ``order`` (entity, draw), a hash by default.

    The first entities get the earliest period, as many as have it, the next ones the second, and so on: quotas over
    the order. Each entity has a block for each cohort; a draw picks one of them per entity and adds them up.
    """
    cohorts = sorted(r[0] for r in df.select(spec.first_treated).where(F.col(spec.first_treated).isNotNull()).distinct().collect())
    names = {f"c{k}": (F.col(spec.time) >= F.lit(c)).cast("double") for k, c in enumerate(cohorts)}
    g = Gram(df, spec.entity, spec.time, spec.outcome, names, keep={"ft": F.col(spec.first_treated)}).persist()
    total, _, _ = g.total
    m, rest = len(cohorts), range(len(cohorts), g.k)
    treated = g.blocks.where("ft is not null")
    size = {r["ft"]: r["n"] for r in treated.groupBy("ft").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = [size.get(c, 0) for c in cohorts]
    per = F.array(*(F.array(F.get("g", F.lit(g.place(k, k))), *(F.get("g", F.lit(g.place(k, j))) for j in rest)) for k in range(m)))
    dealt = _dealt(treated.select("_e", per.alias("b")), draws, quotas, sum(quotas), seed, order)
    sums = dealt.select("draw", F.get("b", F.col("_part")).alias("b")).groupBy("draw").agg(F.array(*(F.sum(F.get("b", F.lit(i))) for i in range(1 + len(rest)))).alias("b"))
    inner = total[m:-1, m:-1]

    def one(b: np.ndarray) -> float:
        xx = np.block([[b[:1, None], b[None, 1:-1]], [b[1:-1, None], inner]])
        return float(solve(xx, np.concatenate([b[-1:], total[m:-1, -1]]))[0])

    found = frame(df, [r.asDict() for r in _coefficients(sums, one).collect()], "draw int, coef double")  # a row a draw
    g.free()
    return found


OSTER = "beta_short double, r2_short double, beta_full double, r2_full double, r2_max double, beta_star double, delta_zero double, robust boolean"


def oster_bounds(df: DataFrame, spec: PanelSpec, factor: float = 1.3) -> DataFrame:
    """Coefficient bounds for omitted variables: the effect at equal selection and R2 of min(1.3 R2, 0.99),
    and the selection that would bring it to zero. R2 counts the fixed effects."""
    g = did_gram(df, spec).persist()
    tss = df.select(F.col(spec.outcome).cast("double").alias("y"), interaction(spec).alias("d"), spec.time, *spec.controls).dropna().agg(F.var_pop("y") * F.count("y")).first()[0]
    short, full = g.fit(["did"]), g.fit()
    g.free()
    r = [1 - f.rss / tss for f in (short, full)]
    b = [float(f.beta[f.names.index("did")]) for f in (short, full)]
    most = min(factor * r[1], 0.99)
    moved, gained = b[0] - b[1], r[1] - r[0]
    star = b[1] - moved * (most - r[1]) / gained if abs(gained) > 1e-12 else None
    delta = b[1] * gained / (moved * (most - r[1])) if abs(moved * (most - r[1])) > 1e-12 else None
    ok = None if star is None else (star > 0) == (b[1] > 0) and (delta is None or abs(delta) >= 1)
    return frame(df, [{"beta_short": b[0], "r2_short": r[0], "beta_full": b[1], "r2_full": r[1], "r2_max": most, "beta_star": star, "delta_zero": delta, "robust": ok}], OSTER)


def coefficient_stability(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The estimate as controls are added one by one, from parts of one Gram matrix; stable if max/min < 2 and no sign changes."""
    g = did_gram(df, spec).persist()
    rows = []
    for k in range(len(spec.controls) + 1):
        fit = g.fit(["did", *spec.controls[:k]])
        rows.append({"step": k, "added": spec.controls[k - 1] if k else "none", **fit.row("did")})
    g.free()
    size = [abs(r["coef"]) for r in rows]
    stable = len({r["coef"] > 0 for r in rows}) == 1 and max(size) < 2 * min(size)
    return frame(df, [r | {"stable": stable} for r in rows], "step int, added string, coef double, se double, t double, p double, stable boolean")


def placebo_in_time(df: DataFrame, spec: PanelSpec, first: int, shifts: tuple[int, ...] = (-4, -3, -2)) -> DataFrame:
    """Fake treatment dates on the periods before the true one; an effect there speaks against parallel trends."""
    before = df.where(F.col(spec.time) < first)
    rows = []
    for s in shifts:
        fake = before.withColumn("_fake", (F.col(spec.time) >= first + s).cast("double"))
        g = Gram(fake, spec.entity, spec.time, spec.outcome, {"did": F.col(spec.treated).cast("double") * F.col("_fake"), **{c: F.col(c) for c in spec.controls}})
        total, n, _ = g.total
        g.free()
        fit = g.fit()
        usable = n > 0 and total[0, 0] > 0 and fit.df > 0
        rows.append({"shift": s, "n": n, "status": "ok" if usable else "no variation", **({k: v for k, v in fit.row("did").items() if k != "t"} if usable else {})})
    return frame(df, rows, "shift int, status string, n long, coef double, se double, p double")


def rosenbaum_bounds(df: DataFrame, outcome: str, treatment: str, covariates: list[str], unit: str, gammas: tuple[float, ...] = (1, 1.2, 1.5, 1.8, 2, 2.5, 3)) -> DataFrame:
    """Signed-rank bounds after matching each treated unit to the control with the nearest propensity."""
    from causeway.plans.dml import matched

    diffs = matched(df, outcome, treatment, covariates, unit).select((F.col("y") - F.col("match_y")).alias("diff")).where("diff <> 0")
    # ranks of |diff| with ties averaged, from counts of distinct values
    sizes = diffs.groupBy(F.abs("diff").alias("a")).agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("diff") > 0).cast("long")).alias("up"))
    ranked = running_sum(sizes, "a", "k", "_before")
    r = ranked.select("k", "up", (F.col("_before") + (F.col("k") + 1) / 2).alias("rank")).agg(F.sum("k").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(F.col("k") * F.col("rank")).alias("s1"), F.sum(F.col("k") * F.col("rank") ** 2).alias("s2")).first()
    rows = []
    for gamma in gammas:
        p = gamma / (1 + gamma)
        var = p * (1 - p) * (r["s2"] or 0)
        z = ((r["w"] or 0) - p * (r["s1"] or 0)) / math.sqrt(var) if var > 0 else float("nan")
        low = ((r["w"] or 0) - (1 - p) * (r["s1"] or 0)) / math.sqrt(var) if var > 0 else float("nan")
        rows.append({"gamma": float(gamma), "pairs": r["n"] or 0, "z_upper": z, "p_upper": 1 - normal_cdf(z), "z_lower": low, "p_lower": 1 - normal_cdf(low)})
    critical = next((x["gamma"] for x in rows if x["p_upper"] > 0.05), None)
    return frame(df, [x | {"critical_gamma": critical} for x in rows], "gamma double, pairs long, z_upper double, p_upper double, z_lower double, p_lower double, critical_gamma double")


def randomization_inference(df: DataFrame, spec: PanelSpec, draws: int = 500, seed: int = 42, order=None) -> DataFrame:
    """Permutation p-value of the estimate itself."""
    g = did_gram(df, spec)
    actual = g.fit()
    g.free()
    return placebo_summary(placebo_permutation(df, spec, draws, seed, order), float(actual.beta[actual.names.index("did")]))


def sensitivity_verdict(checks: dict[str, bool | None]) -> str:
    """robust if every check that ran passed, moderate if at least half did, else sensitive."""
    ran = [v for v in checks.values() if v is not None]
    return "not run" if not ran else "robust" if all(ran) else "moderate" if sum(ran) * 2 >= len(ran) else "sensitive"


def combine_checks(spark, checks: dict[str, bool | None]) -> DataFrame:
    """One row per check with pass, fail or not run, and the verdict over all."""
    verdict = sensitivity_verdict(checks)
    rows = [(k, "not run" if v is None else "pass" if v else "fail", verdict) for k, v in checks.items()]
    return spark.createDataFrame(rows, "check string, result string, verdict string")


def staggered_did_interaction(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumn("post", post_flag(spec.time, spec.first_treated))
