"""Difference-in-differences with fixed effects, event studies, windows and triple differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.stats import f_p
from causeway.plans.gram import Fit, Gram, wald_f
from causeway.spec import PanelSpec


def interaction(spec: PanelSpec):
    return F.col(spec.treated).cast("double") * F.col(spec.post).cast("double")


def post_flag(time: str, first_treated: str):
    """1 from the first treated period on, else 0; never-treated units have 0."""
    return F.coalesce((F.col(time) >= F.col(first_treated)).cast("int"), F.lit(0))


def did_gram(df: DataFrame, spec: PanelSpec) -> Gram:
    return Gram(df, spec.entity, spec.time, spec.outcome, {"did": interaction(spec), **{c: F.col(c) for c in spec.controls}})


def frame(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


RESULT = "spec string, term string, coef double, se double, t double, p double, r2_within double, n long, entities long, df double"


def _row(label: str, fit: Fit, term: str, covariance=None, df=None) -> dict:
    r2 = 1 - fit.rss / fit.tss if fit.tss > 0 else None
    return {"spec": label, "term": term, **fit.row(term, covariance, df), "r2_within": r2, "n": fit.n, "entities": fit.entities, "df": float(fit.df if df is None else df)}


def twfe(df: DataFrame, spec: PanelSpec, baseline: bool = False, clustered: bool = True) -> DataFrame:
    """Two-way fixed-effects estimate of treated x post; with ``baseline`` also without the controls.

    Errors are clustered by entity, or classical with ``clustered`` false. Both specifications come from
    the same blocks. Works on unbalanced panels.
    """
    g = did_gram(df, spec).persist()
    rows = []
    for label, use in (("baseline", ["did"]), ("full", None)):
        if label == "full" or baseline:
            fit = g.fit(use)
            rows.append(_row(label, fit, "did", *(g.clustered(fit) if clustered else ())))
    g.free()
    return frame(df, rows, RESULT)


def closed_form_did(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The coefficient of a balanced panel as one plan: x less its entity mean and period mean plus the mean."""
    x = df.select(F.col(spec.entity).alias("e"), F.col(spec.time).alias("t"), F.col(spec.outcome).cast("double").alias("y"), interaction(spec).alias("d"))
    by_e = x.groupBy("e").agg(F.avg("y").alias("ye"), F.avg("d").alias("de"))
    by_t = x.groupBy("t").agg(F.avg("y").alias("yt"), F.avg("d").alias("dt"))
    every = x.agg(F.avg("y").alias("ya"), F.avg("d").alias("da"))
    z = x.join(by_e, "e").join(by_t, "t").join(F.broadcast(every))  # one row
    z = z.select((F.col("y") - F.col("ye") - F.col("yt") + F.col("ya")).alias("y"), (F.col("d") - F.col("de") - F.col("dt") + F.col("da")).alias("d"))
    return z.agg((F.sum(F.col("d") * F.col("y")) / F.sum(F.col("d") * F.col("d"))).alias("coef"), F.count(F.lit(1)).alias("n"))


def relative_time(time: str, first_treated: str, n_pre: int, n_post: int):
    """Periods since treatment within [-n_pre, n_post], outer ones in the end bins; null for never-treated units."""
    rel = F.greatest(F.least(F.col(time) - F.col(first_treated), F.lit(n_post)), F.lit(-n_pre)).cast("int")
    return F.when(F.col(first_treated).isNotNull(), rel)  # greatest and least pass over nulls


EVENT = "rel_time int, coef double, se double, t double, p double, lo double, hi double, pretrend_f double, pretrend_p double, jointly_zero boolean"


def event_study(df: DataFrame, spec: PanelSpec, n_pre: int = 4, n_post: int = 4, reference: int = -1) -> DataFrame:
    """Effects by relative time with entity and time effects; never-treated units stay in the base.

    The reference period is a row with zeros. The pre-trend test is a joint F of all earlier periods but it.
    """
    x = df.select(spec.entity, spec.time, spec.outcome, spec.first_treated, *spec.controls).withColumn("_rel", relative_time(spec.time, spec.first_treated, n_pre, n_post))
    dummies = {f"r={r}": F.coalesce((F.col("_rel") == r).cast("double"), F.lit(0.0)) for r in range(-n_pre, n_post + 1) if r != reference}
    g = Gram(x, spec.entity, spec.time, spec.outcome, {**dummies, **{c: F.col(c) for c in spec.controls}})
    rels = [r for r in range(-n_pre, n_post + 1) if r != reference and g.means[f"r={r}"]]  # those that a row has
    fit = g.fit([*(f"r={r}" for r in rels), *spec.controls])
    stat, q = wald_f(fit, [f"r={r}" for r in rels if r < 0])
    p = f_p(stat, q, fit.df) if q else None
    g.free()
    rows = []
    for r in sorted({*rels, reference}):
        own = {"coef": 0.0, "se": 0.0, "t": None, "p": None} if r == reference else fit.row(f"r={r}")
        rows.append({"rel_time": r, **own, "lo": own["coef"] - 1.96 * own["se"], "hi": own["coef"] + 1.96 * own["se"], "pretrend_f": stat if q else None, "pretrend_p": p, "jointly_zero": None if p is None else p > 0.05})
    return frame(df, rows, EVENT)


def window_sample(df: DataFrame, time: str, first: int, width: int) -> DataFrame:
    """``width`` periods before and from the first treated period on."""
    return df.where(F.col(time).between(first - width, first + width - 1))


ALT = "width int, status string, n long, coef double, se double, p double"


def alternative_windows(df: DataFrame, spec: PanelSpec, first: int, widths: tuple[int, ...] = (1, 2, 3), least: int = 20) -> DataFrame:
    """The classical estimate on narrower windows; windows of fewer than ``least`` rows have a status only."""
    rows = []
    for w in widths:
        part = window_sample(df, spec.time, first, w)
        g = did_gram(part, spec)
        enough = g.total[1] >= least
        g.free()
        if not enough:
            rows.append({"width": w, "status": "too few rows", "n": g.total[1]})
            continue
        rows.append({"width": w, "status": "ok", "n": g.total[1], **{k: v for k, v in g.fit().row("did").items() if k != "t"}})
    return frame(df, rows, ALT)


def stability(windows: DataFrame) -> DataFrame:
    """One row: do signs and significance agree, and is the largest effect under three times the smallest?

    Fewer than two estimates count as stable.
    """
    ok = windows.where("status = 'ok'")
    a = ok.agg(F.count(F.lit(1)).alias("n"), F.min("coef").alias("lo"), F.max("coef").alias("hi"), F.min(F.abs("coef")).alias("small"), F.max(F.abs("coef")).alias("large"), F.sum((F.col("p") < 0.05).cast("int")).alias("sig"))
    signs = (F.col("lo") > 0) | (F.col("hi") < 0)
    size = F.col("large") < 3 * F.col("small")
    same = F.col("sig").isin(0) | (F.col("sig") == F.col("n"))
    few = F.col("n") < 2
    return a.select("n", (few | signs).alias("same_sign"), (few | same).alias("same_significance"), (few | size).alias("similar_size"), (few | (signs & same & size)).alias("stable"))


def intensity_did(df: DataFrame, spec: PanelSpec, dose: str) -> DataFrame:
    """post x dose with both effects; its F test is the squared t."""
    g = Gram(df, spec.entity, spec.time, spec.outcome, {"dose": F.col(dose).cast("double") * F.col(spec.post).cast("double"), **{c: F.col(c) for c in spec.controls}}).persist()
    fit = g.fit()
    row = _row("intensity", fit, "dose", *g.clustered(fit))
    g.free()
    return frame(df, [row], RESULT)


def triple_difference(df: DataFrame, spec: PanelSpec, group: str) -> DataFrame:
    """treated x post x group, with treated x post and group x post; entity and time effects take the rest."""
    t, p, s = (F.col(c).cast("double") for c in (spec.treated, spec.post, group))
    g = Gram(df, spec.entity, spec.time, spec.outcome, {"ddd": t * p * s, "treated_post": t * p, "group_post": s * p, **{c: F.col(c) for c in spec.controls}}).persist()
    fit = g.fit()
    cov = g.clustered(fit)
    rows = [_row("ddd", fit, x, *cov) for x in ("ddd", "treated_post", "group_post")]
    g.free()
    return frame(df, rows, RESULT)


def demeaned(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Columns less their entity's mean."""
    w = Window.partitionBy(entity)
    return df.select(entity, *((F.col(c) - F.avg(c).over(w)).alias(c) for c in cols))
