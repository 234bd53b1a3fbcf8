"""Staggered adoption: ATT(g,t), its aggregates, Sun-Abraham, Goodman-Bacon and the cluster bootstrap."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.stats import normal_p, solve
from causeway.plans.did import frame, relative_time
from causeway.plans.gram import Gram
from causeway.spec import PanelSpec


def cohorts_and_periods(df: DataFrame, spec: PanelSpec) -> tuple[list, list]:
    """Distinct first treated periods and periods; a panel has few of either."""
    g = sorted(r[0] for r in df.select(spec.first_treated).where(F.col(spec.first_treated).isNotNull()).distinct().collect())
    t = sorted(r[0] for r in df.select(spec.time).where(F.col(spec.time).isNotNull()).distinct().collect())
    return g, t


def _outcomes(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(entity, ft, at): one row an entity, with a map from period to outcome and controls; so no self-join is needed."""
    cell = F.struct(F.col(spec.outcome).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in spec.controls))
    return df.where(F.col(spec.outcome).isNotNull()).groupBy(F.col(spec.entity).alias("entity"), F.col(spec.first_treated).cast("double").alias("ft")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(spec.time).cast("double"), cell))).alias("at"))


def _changes(x: DataFrame, gs: list, ts: list, controls: tuple[str, ...], control: str, pre: bool) -> DataFrame:
    pairs = [(float(g), float(t), float(max(x for x in ts if x < g))) for g in gs if any(x < g for x in ts) for t in ts if pre and t != max(x for x in ts if x < g) or t >= g]
    grid = x.sparkSession.createDataFrame(pairs or [(0.0, 0.0, 0.0)], "g double, t double, base double").where(F.lit(bool(pairs)))
    both = x.join(F.broadcast(grid), F.when(F.col("ft").isNull(), True).otherwise((F.col("ft") == F.col("g")) | (F.col("ft") > F.col("t")) & F.lit(control == "notyet")))
    now, then = F.try_element_at("at", F.col("t")), F.try_element_at("at", F.col("base"))
    out = both.select("g", "t", "entity", F.coalesce((F.col("ft") == F.col("g")).cast("int"), F.lit(0)).alias("d"), (now["y"] - then["y"]).alias("dy"), *(then[c].alias(c) for c in controls))
    return out.dropna(subset=["dy", *controls])


def long_differences(df: DataFrame, spec: PanelSpec, control: str = "never", pre: bool = False) -> DataFrame:
    """(g, t, entity, d, dy, controls at g-1): changes since the last period before g, of the cohort and its controls.

    ``control`` is ``never`` (never treated) or ``notyet`` (not treated by t as well).
    """
    return _changes(_outcomes(df, spec), *cohorts_and_periods(df, spec), spec.controls, control, pre)


ATT_ROW = "g double, t double, att double, se double, n_treated long, n_control long"


def att_plain(changes: DataFrame) -> DataFrame:
    """ATT(g,t) without covariates: difference of mean changes, in SQL aggregates."""
    d = F.col("d") == 1
    a = changes.groupBy("g", "t").agg(
        F.avg(F.when(d, F.col("dy"))).alias("m1"), F.avg(F.when(~d, F.col("dy"))).alias("m0"),
        F.var_pop(F.when(d, F.col("dy"))).alias("v1"), F.var_pop(F.when(~d, F.col("dy"))).alias("v0"),
        F.sum(d.cast("long")).alias("n_treated"), F.sum((~d).cast("long")).alias("n_control"),
    ).where("n_treated > 0 and n_control > 0")
    se = F.sqrt(F.col("v1") / F.col("n_treated") + F.col("v0") / F.col("n_control"))
    return a.select("g", "t", (F.col("m1") - F.col("m0")).alias("att"), se.alias("se"), "n_treated", "n_control")


def _of_each_pair(changes: DataFrame, values: dict[tuple, list[float]], names: list[str]) -> DataFrame:
    """``changes`` of the pairs (g, t) that ``values`` has, with columns of a pair's values."""
    table = changes.sparkSession.createDataFrame([(*k, *map(float, v)) for k, v in values.items()], ", ".join(f"{c} double" for c in ("g", "t", *names)))
    return changes.join(F.broadcast(table), ["g", "t"])  # a row a pair


def _dot(weights: list[str], columns: list[Column]) -> Column:
    return sum((F.col(w) * c for w, c in zip(weights, columns)), F.lit(0.0))


def att_doubly_robust(changes: DataFrame, controls: tuple[str, ...], rounds: int = 30) -> DataFrame:
    """(g, t, att, se, n_treated, n_control) of all pairs at once, from sums by pair.

    Logit propensities by Newton's method, one aggregation a round for all pairs that haven't settled; outcome
    regressions among controls; then weighted means, and in a last pass the squares of the influence functions. What
    is broadcast and what comes back is a row a pair, whatever its number of entities. Pairs without treated or control
    entities are left out; with under ten controls the outcome regression is nil.
    """
    k = len(controls) + 1
    names = {n: [f"_{n}{i}" for i in range(k)] for n in ("m", "s", "b", "c")}
    moments = changes.groupBy("g", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("n1"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(controls, 1) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).collect()
    size = {(r["g"], r["t"]): (r["n"], r["n1"]) for r in moments if 0 < r["n1"] < r["n"]}
    if not size:
        return frame(changes, [], ATT_ROW)
    scale = {(r["g"], r["t"]): [*(r[f"m{i}"] for i in range(1, k)), *(r[f"s{i}"] or 1.0 for i in range(1, k))] for r in moments if (r["g"], r["t"]) in size}
    z = [F.lit(1.0), *((F.col(c) - F.col(m)) / F.col(s) for c, m, s in zip(controls, names["m"][1:], names["s"][1:]))]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def square(values: list) -> np.ndarray:
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, values):
            h[i, j] = h[j, i] = v or 0.0
        return h

    beta = {p: np.zeros(k) for p in size}
    gamma: dict[tuple, np.ndarray] = {}
    active = set(size)
    score = F.greatest(F.least(_dot(names["b"], z), F.lit(30.0)), F.lit(-30.0))
    ps = 1 / (1 + F.exp(-score))
    for round_ in range(rounds):
        at = _of_each_pair(changes, {p: [*scale[p], *beta[p]] for p in active}, [*names["m"][1:], *names["s"][1:], *names["b"]])
        at = at.select("g", "t", "d", "dy", ps.alias("_p"), *(c.alias(f"_z{i}") for i, c in enumerate(z)))
        x, no = [F.col(f"_z{i}") for i in range(k)], F.col("d") == 0
        sums = [F.sum(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i, j in pairs] + [F.sum((F.col("d") - F.col("_p")) * c) for c in x]
        if not round_:  # the outcome regression doesn't depend on the propensities
            sums += [F.sum(F.when(no, x[i] * x[j])) for i, j in pairs] + [F.sum(F.when(no, c * F.col("dy"))) for c in x]
        for r in at.groupBy("g", "t").agg(*sums).collect():
            p, v = (r[0], r[1]), list(r[2:])
            step = np.linalg.pinv(square(v[: len(pairs)]) + 1e-9 * np.eye(k)) @ np.array(v[len(pairs) : len(pairs) + k])
            beta[p] = beta[p] + step
            if np.abs(step).max() < 1e-9:
                active.discard(p)
            if not round_:
                own = v[len(pairs) + k :]
                few = size[p][0] - size[p][1] < 10
                gamma[p] = np.zeros(k) if few else solve(square(own[: len(pairs)]), np.array(own[len(pairs) :]))
        if not active:
            break
    at = _of_each_pair(changes, {p: [*scale[p], *beta[p], *gamma[p]] for p in size}, [*names["m"][1:], *names["s"][1:], *names["b"], *names["c"]])
    at = at.select("g", "t", "d", F.greatest(F.least(ps, F.lit(0.99)), F.lit(0.01)).alias("_p"), (F.col("dy") - _dot(names["c"], z)).alias("_r"))
    at = at.select("g", "t", "d", "_r", (F.col("_p") * (1 - F.col("d")) / (1 - F.col("_p"))).alias("_w"))
    means = {(r["g"], r["t"]): (r["w"], r["r1"] / size[r["g"], r["t"]][1], r["r0"] / r["w"]) for r in at.groupBy("g", "t").agg(F.sum("_w").alias("w"), F.sum(F.col("d") * F.col("_r")).alias("r1"), F.sum(F.col("_w") * F.col("_r")).alias("r0")).collect()}
    last = _of_each_pair(at, {p: [n / n1, n / means[p][0], *means[p][1:]] for p, (n, n1) in size.items()}, ["_f1", "_f0", "_m1", "_m0"])
    influence = F.col("d") * F.col("_f1") * (F.col("_r") - F.col("_m1")) - F.col("_w") * F.col("_f0") * (F.col("_r") - F.col("_m0"))
    squares = {(r["g"], r["t"]): r["v"] for r in last.groupBy("g", "t").agg(F.avg(influence**2).alias("v")).collect()}
    rows = [{"g": p[0], "t": p[1], "att": means[p][1] - means[p][2], "se": math.sqrt(squares[p] / n), "n_treated": n1, "n_control": n - n1} for p, (n, n1) in size.items()]
    return frame(changes, rows, ATT_ROW)


def att_gt(df: DataFrame, spec: PanelSpec, control: str = "never", pre: bool = False) -> DataFrame:
    """ATT(g,t) for t >= g; with controls doubly robust (logit propensity and outcome regression among controls).

    Errors are from influence functions over entities.
    """
    if not spec.controls:
        return att_plain(long_differences(df, spec, control, pre))
    x = _outcomes(df, spec).persist()  # a row an entity, read once a round
    found = att_doubly_robust(_changes(x, *cohorts_and_periods(df, spec), spec.controls, control, pre), spec.controls)
    x.unpersist()
    return found


def aggregate_att(att: DataFrame) -> DataFrame:
    """(kind, at, att): overall weighted by cohort size, by cohort, and by time since treatment."""
    post = att.where("t >= g")
    by_g = post.groupBy("g").agg(F.avg("att").alias("att"), F.max("n_treated").alias("n"))
    by_e = post.groupBy((F.col("t") - F.col("g")).alias("at")).agg((F.sum(F.col("att") * F.col("n_treated")) / F.sum("n_treated")).alias("att"))
    overall = by_g.agg((F.sum(F.col("att") * F.col("n")) / F.sum("n")).alias("att"))
    return overall.select(F.lit("overall").alias("kind"), F.lit(None).cast("double").alias("at"), "att").union(by_g.select(F.lit("cohort"), "g", "att")).union(by_e.select(F.lit("event"), "at", "att"))


def bootstrap_att(df: DataFrame, spec: PanelSpec, replicates: int = 100, seed: int = 42, uniform=None) -> DataFrame:
    """Cluster bootstrap of the overall ATT without covariates: entities are weighted by Poisson(1) draws.

    (replicates, mean, sd, lo, hi). The weights come from ``uniform`` (entity, replicate), a number from 0 to 1, by
    default a hash, so a retried task draws the same ones.
    """
    changes = long_differences(df, PanelSpec(**{**spec.__dict__, "controls": ()}))
    reps = changes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = uniform(F.col("entity"), F.col("rep")) if uniform else F.pmod(F.xxhash64("entity", "rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cdf, terms = 0.0, []
    for k in range(8):
        cdf += math.exp(-1) / math.factorial(k)
        terms.append((u >= F.lit(cdf)).cast("int"))
    weighted = reps.withColumn("w", sum(terms[1:], terms[0]).cast("double"))
    d = F.col("d") == 1
    mean = lambda c: F.sum(F.when(c, F.col("w") * F.col("dy"))) / F.nullif(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
    by = weighted.groupBy("rep", "g", "t").agg((mean(d) - mean(~d)).alias("att"), F.sum(F.when(d, F.col("w"))).alias("n"))
    by_g = by.where("att is not null").groupBy("rep", "g").agg(F.avg("att").alias("att"), F.max("n").alias("n"))
    overall = by_g.groupBy("rep").agg((F.sum(F.col("att") * F.col("n")) / F.sum("n")).alias("att"))
    # a row a replicate
    return overall.agg(F.count("att").alias("replicates"), F.avg("att").alias("mean"), F.stddev_samp("att").alias("sd"), F.percentile("att", F.lit(0.025)).alias("lo"), F.percentile("att", F.lit(0.975)).alias("hi"))


def sun_abraham(df: DataFrame, spec: PanelSpec, n_pre: int = 4, n_post: int = 4) -> DataFrame:
    """(rel_time, coef, se, p): cohort by relative-time effects, averaged with the cohorts' shares at that time."""
    gs, _ = cohorts_and_periods(df, spec)
    x = df.withColumn("_rel", relative_time(spec.time, spec.first_treated, n_pre, n_post))
    cells = {(r["_g"], r["_rel"]): r["n"] for r in x.where("_rel is not null").groupBy(F.col(spec.first_treated).alias("_g"), "_rel").agg(F.count(spec.outcome).alias("n")).collect()}
    used = [(g, r) for g, r in sorted(cells) if r != -1]
    dummies = {f"{g}:{r}": F.coalesce(((F.col(spec.first_treated) == g) & (F.col("_rel") == r)).cast("double"), F.lit(0.0)) for g, r in used}
    gram = Gram(x, spec.entity, spec.time, spec.outcome, {**dummies, **{c: F.col(c) for c in spec.controls}})
    fit = gram.fit()
    gram.free()
    rows = []
    for r in sorted({r for _, r in used}):
        own = [(fit.names.index(f"{g}:{q}"), cells[g, q]) for g, q in used if q == r]
        at, share = [k for k, _ in own], np.array([n for _, n in own], float) / sum(n for _, n in own)
        coef, se = float(fit.beta[at] @ share), float(np.sqrt(max(share @ fit.covariance[np.ix_(at, at)] @ share, 0)))
        rows.append({"rel_time": r, "coef": coef, "se": se, "p": normal_p(coef / se) if se > 0 else None})
    return frame(df, rows, "rel_time int, coef double, se double, p double")


def goodman_bacon(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """(kind, first, second, estimate, weight): all 2x2 comparisons of a balanced panel and their weights.

    Treated against never treated, earlier against later before the later is treated, and later against
    earlier after the earlier is. Cell means come from one aggregation by cohort and period.
    """
    cells = df.where(F.col(spec.outcome).isNotNull()).groupBy(F.col(spec.first_treated).alias("g"), F.col(spec.time).alias("t")).agg(F.avg(spec.outcome).alias("y"), F.countDistinct(spec.entity).alias("n")).collect()
    y: dict = {}
    n: dict = {}
    for r in cells:
        y.setdefault(r["g"], {})[r["t"]] = r["y"]
        n[r["g"]] = max(n.get(r["g"], 0), r["n"])
    total, ts = sum(n.values()), sorted({r["t"] for r in cells})

    def share(g):
        return sum(t >= g for t in ts) / len(ts)

    def did(a, b, window, cut):
        cut_of = lambda g, late: np.mean([y[g][t] for t in window if (t >= cut) == late and t in y[g]])
        return float((cut_of(a, True) - cut_of(a, False)) - (cut_of(b, True) - cut_of(b, False)))

    rows, gs = [], sorted(g for g in n if g is not None and any(t < g for t in ts) and any(t >= g for t in ts))
    for g in gs:
        d = share(g)
        if None in n:
            s = n[g] + n[None]
            rows.append(("treated vs never", g, None, did(g, None, ts, g), (s / total) ** 2 * (n[g] / s) * (n[None] / s) * d * (1 - d)))
    for i, k in enumerate(gs):
        for later in gs[i + 1 :]:
            dk, dl = share(k), share(later)
            s = n[k] + n[later]
            part = (n[k] / s) * (n[later] / s)
            early, late = [t for t in ts if t < later], [t for t in ts if t >= k]
            rows.append(("earlier vs later", k, later, did(k, later, early, k), ((s / total) * (1 - dl)) ** 2 * part * ((dk - dl) / (1 - dl)) * ((1 - dk) / (1 - dl))))
            rows.append(("later vs earlier", later, k, did(later, k, late, later), ((s / total) * dk) ** 2 * part * (dl / dk) * ((dk - dl) / dk)))
    weight = sum(r[-1] for r in rows) or 1.0
    return frame(df, [{"kind": a, "first": None if b is None else float(b), "second": None if c is None else float(c), "estimate": e, "weight": w / weight} for a, b, c, e, w in rows], "kind string, first double, second double, estimate double, weight double")
