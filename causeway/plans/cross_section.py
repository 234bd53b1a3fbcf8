"""Regression discontinuity and instrumental variables from weighted moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.stats import chi2_p, f_p, inverse, normal_p, solve, t_p
from causeway.operators.ranges import exact_quantiles
from causeway.plans.did import frame
from causeway.plans.gram import Moments, Ols, ols


def kernel(u: Column, kind: str = "triangular") -> Column:
    shapes = {"triangular": 1 - F.abs(u), "epanechnikov": 0.75 * (1 - u * u), "uniform": F.lit(1.0)}
    return F.when(F.abs(u) <= 1, shapes[kind]).otherwise(0.0)


def rule_of_thumb_bandwidth(df: DataFrame, x: str) -> DataFrame:
    """1.84 x population standard deviation x n^(-1/5)."""
    return df.agg((1.84 * F.stddev_pop(x) * F.pow(F.count(x), F.lit(-0.2))).alias("bandwidth"), F.count(x).alias("n"))


def _design(x: str, cutoff: float, controls: tuple[str, ...]) -> dict[str, Column]:
    dist = F.col(x) - F.lit(cutoff)
    above = (F.col(x) >= cutoff).cast("double")
    return {"above": above, "dist": dist, "dist_above": dist * above, **{c: F.col(c) for c in controls}}


RDD = "term string, coef double, se double, t double, p double, r2 double, bandwidth double, n_below long, n_above long"


def sharp_rdd(df: DataFrame, y: str, x: str, cutoff: float, bandwidth: float | None = None, kind: str = "triangular", controls: tuple[str, ...] = ()) -> DataFrame:
    """Kernel-weighted local linear regression on either side; the jump at the cutoff. At the cutoff is treated."""
    h = bandwidth or rule_of_thumb_bandwidth(df, x).first()[0]
    near = df.where(F.abs(F.col(x) - cutoff) <= h)
    fit = ols(near, F.col(y), _design(x, cutoff, controls), kernel((F.col(x) - cutoff) / F.lit(h), kind))
    sides = near.dropna(subset=[y, x, *controls]).agg(F.sum((F.col(x) < cutoff).cast("long")), F.sum((F.col(x) >= cutoff).cast("long"))).first()
    return frame(df, [{"term": "jump", **fit.row("above"), "r2": 1 - fit.rss / fit.tss if fit.tss else None, "bandwidth": float(h), "n_below": sides[0], "n_above": sides[1]}], RDD)


FUZZY = "first_stage double, first_stage_f double, itt double, late double, se double, p double, bandwidth double, n long"


def fuzzy_rdd(df: DataFrame, y: str, x: str, taken: str, cutoff: float, bandwidth: float | None = None, kind: str = "triangular", controls: tuple[str, ...] = ()) -> DataFrame:
    """Jump of the outcome over the jump of treatment; weighted two-stage errors from actual treatment."""
    h = bandwidth or rule_of_thumb_bandwidth(df, x).first()[0]
    near = df.where(F.abs(F.col(x) - cutoff) <= h)
    m = Moments(near, {**_design(x, cutoff, controls), "_d": F.col(taken), "_y": F.col(y)}, kernel((F.col(x) - cutoff) / F.lit(h), kind))
    xs = m.names[:-2]
    first, itt = m.ols("_d", xs), m.ols("_y", xs)
    est = _two_stage(m, "_y", "_d", ["above"], [c for c in xs if c not in ("above", "const")])
    return frame(df, [{"first_stage": first.row("above")["coef"], "first_stage_f": first.row("above")["t"] ** 2, "itt": itt.row("above")["coef"], "late": est["coef"], "se": est["se"], "p": est["p"], "bandwidth": float(h), "n": m.n}], FUZZY)


def density_bins(df: DataFrame, x: str) -> DataFrame:
    """floor(sqrt(n)) bins of equal width with the last closed on the right: (bin, mid, n)."""
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    k = max(1, int(np.floor(np.sqrt(r["n"] or 0))))
    width = ((r["hi"] - r["lo"]) / k if r["n"] else 0) or 1.0
    b = F.least(F.floor((F.col(x) - F.lit(r["lo"] or 0.0)) / F.lit(width)), F.lit(k - 1)).cast("int")
    counts = df.where(F.col(x).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(r["lo"] or 0.0) + (F.col("bin") + 0.5) * F.lit(width)).alias("mid"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mccrary(df: DataFrame, x: str, cutoff: float) -> DataFrame:
    """Jump of the binned density at the cutoff by a local linear fit on either side."""
    bins = density_bins(df, x)
    fit = ols(bins, F.col("n"), _design("mid", cutoff, ()))
    return frame(df, [{"jump": fit.row("above")["coef"], "t": fit.row("above")["t"], "p": fit.row("above")["p"], "bins": int(fit.n), "manipulated": fit.row("above")["p"] < 0.05}], "jump double, t double, p double, bins int, manipulated boolean")


def _two_stage(m: Moments, y: str, d: str, zs: list[str], xs: list[str], kappa: float = 1.0) -> dict:
    """k-class estimate from moments: 1 is two-stage least squares."""
    g, n, exo = m.g, m.n, m.at(["const", *xs])
    inst = exo + m.at(zs)
    iy, idd = m.at([y, d])
    right = [idd, *exo]
    proj = lambda a, b: g[np.ix_(a, inst)] @ inverse(g[np.ix_(inst, inst)]) @ g[np.ix_(inst, b)]
    a = (1 - kappa) * g[np.ix_(right, right)] + kappa * proj(right, right)
    b = (1 - kappa) * g[right, iy] + kappa * proj(right, [iy])[:, 0]
    beta = solve(a, b)
    rss = float(g[iy, iy] - 2 * beta @ g[right, iy] + beta @ g[np.ix_(right, right)] @ beta)
    df = n - len(right)
    se = float(np.sqrt(max(rss / df * inverse(a)[0, 0], 0))) if df > 0 else float("nan")
    t = float(beta[0]) / se if se > 0 else float("nan")
    # overidentification: residuals projected on the instruments
    e_inst = g[inst, iy] - g[np.ix_(inst, right)] @ beta
    j = float(e_inst @ inverse(g[np.ix_(inst, inst)]) @ e_inst / (rss / n)) if rss > 0 else 0.0
    return {"coef": float(beta[0]), "se": se, "t": t, "p": t_p(t, df), "j": j, "rss": rss, "df": df}


#: Critical first-stage F by number of instruments.
CRITICAL_F = {1: 23.1, 2: 13.9, 3: 9.1, 4: 6.0, 5: 4.8}
IV = "estimator string, coef double, se double, p double, ols_coef double, first_stage_f double, first_stage_p double, weak boolean, j double, j_p double, kappa double, n long"


def least_root(w0: np.ndarray, w1: np.ndarray) -> float:
    """The least k with |W0 - k W1| = 0 for covariances W1 <= W0; 1 if W0 is 0."""
    scale = np.sqrt(np.maximum(np.diag(w0), 0))
    if not (scale > 0).all():
        return 1.0
    value, vector = np.linalg.eigh(w0 / np.outer(scale, scale))
    keep = value > 1e-10 * value[-1]
    half = vector[:, keep] / np.sqrt(value[keep])
    most = float(np.linalg.eigvalsh(half.T @ (w1 / np.outer(scale, scale)) @ half)[-1])
    return 1 / min(max(most, 1e-300), 1.0)


def instrumental(df: DataFrame, y: str, d: str, instruments: list[str], controls: tuple[str, ...] = ()) -> DataFrame:
    """Two-stage least squares and LIML, with the partial first-stage F, a weak-instrument flag and the J test.

    Everything follows from the products of [1, controls, instruments, d, y]; complete cases only.
    """
    cols = {**{c: F.col(c) for c in (*controls, *instruments)}, "_d": F.col(d), "_y": F.col(y)}
    m = Moments(df, cols)
    full = m.ols("_d", ["const", *controls, *instruments])
    short = m.ols("_d", ["const", *controls])
    q = len(instruments)
    f = (short.rss - full.rss) / q / (full.rss / full.df) if full.rss > 0 and full.df > 0 else float("nan")
    plain: Ols = m.ols("_y", ["const", *controls, "_d"])
    # LIML's kappa: the least root of |W0 - k W1|, with (y, d) less the controls and less controls and instruments. It is
    # 1 over the largest root of |W1 - m W0|, which is at most 1 and does without the inverse of W1, singular where y and d
    # are collinear after the instruments
    g, yd, exo = m.g, m.at(["_y", "_d"]), m.at(["const", *controls])
    inst = exo + m.at(instruments)
    left = lambda on: g[np.ix_(yd, yd)] - g[np.ix_(yd, on)] @ inverse(g[np.ix_(on, on)]) @ g[np.ix_(on, yd)]
    kappa = least_root(left(exo), left(inst))
    rows = []
    for name, k in (("2sls", 1.0), ("liml", kappa)):
        e = _two_stage(m, "_y", "_d", instruments, list(controls), k)
        rows.append({"estimator": name, "coef": e["coef"], "se": e["se"], "p": e["p"], "ols_coef": plain.row("_d")["coef"], "first_stage_f": f, "first_stage_p": f_p(f, q, full.df), "weak": f < CRITICAL_F.get(q, 4.8), "j": e["j"] if q > 1 else None, "j_p": chi2_p(e["j"], q - 1) if q > 1 else None, "kappa": k, "n": m.n})
    return frame(df, rows, IV)


def best_linear_projection(df: DataFrame, cate: str, features: list[str]) -> DataFrame:
    """Regression of effects on standardised features, classical errors, normal p-values."""
    m = df.agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    std = {c: (F.col(c) - F.lit(m[f"m_{i}"] or 0.0)) / F.lit(m[f"s_{i}"] or 1.0) for i, c in enumerate(features)}
    fit = ols(df, F.col(cate), std)
    rows = [{"term": x, **fit.row(x, normal=True)} for x in fit.names]
    return frame(df, rows, "term string, coef double, se double, t double, p double")


def effect_distribution(df: DataFrame, cate: str) -> DataFrame:
    """One row: mean, sd, lo, hi, exact quantiles, share_positive, n."""
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    a = df.agg(F.avg(cate).alias("mean"), F.stddev_pop(cate).alias("sd"), F.min(cate).alias("lo"), F.max(cate).alias("hi"), F.avg((F.col(cate) > 0).cast("double")).alias("share_positive"), F.count(cate).alias("n"))
    found = exact_quantiles(df, {cate: q})[(cate,)]
    return a.select("mean", "sd", "lo", "hi", *(F.lit(v).cast("double").alias(f"p{int(x * 100)}") for x, v in zip(q, found)), "share_positive", "n")


def z_test(coef: float, se: float) -> float:
    return normal_p(coef / se) if se > 0 else float("nan")
