"""Checks of a panel: structure, missing values, outliers, types, treatment, and balance of arms.

Every check gives rows (check, severity, detail, n), and validate() puts them together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from causeway.operators.ranges import exact_quantiles
from causeway.spec import PanelSpec

ISSUE = ["check", "severity", "detail", "n"]


def _issues(df: DataFrame, found: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """One row for each of {check: (severity, detail, count)} whose count isn't 0, from a one-row aggregate."""
    each = F.array(*(F.struct(F.lit(k).alias("check"), F.lit(s).alias("severity"), d.cast("string").alias("detail"), n.cast("long").alias("n")) for k, (s, d, n) in found.items()))
    return df.select(F.explode(each).alias("i")).select("i.*").where("n > 0")


def structure(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Repeated keys (all of their rows count), entities without every period, and odd steps in time."""
    w = Window.orderBy("t")  # of distinct periods
    steps = df.select(F.col(time).cast("double").alias("t")).where("t is not null").distinct().withColumn("d", F.col("t") - F.lag("t").over(w))
    mid = steps.agg(F.percentile("d", F.lit(0.5)).alias("m"), F.count("t").alias("periods"))
    odd = steps.crossJoin(F.broadcast(mid)).agg(F.sum((F.abs(F.col("d") - F.col("m")) > 0.1 * F.abs("m")).cast("long")).alias("odd"), F.max("periods").alias("periods"))
    keys = df.groupBy(entity, time).agg(F.count(F.lit(1)).alias("k"))
    dup = keys.agg(F.sum(F.when(F.col("k") > 1, F.col("k"))).alias("dup"))
    short = keys.groupBy(entity).agg(F.count(time).alias("p")).crossJoin(F.broadcast(odd)).agg(F.sum((F.col("p") < F.col("periods")).cast("long")).alias("short"))
    one = dup.crossJoin(F.broadcast(short)).crossJoin(F.broadcast(odd))
    return _issues(one, {
        "duplicate_keys": ("critical", F.lit("rows share an entity and period"), F.coalesce("dup", F.lit(0))),
        "incomplete_entities": ("warning", F.lit("entities lack periods"), F.coalesce("short", F.lit(0))),
        "uneven_time": ("warning", F.lit("steps differ from the median by over a tenth"), F.coalesce("odd", F.lit(0))),
    })


def missing_values(df: DataFrame, variables: list[str]) -> DataFrame:
    """(variable, missing, pct) of each variable."""
    counts = [F.sum(F.col(v).isNull().cast("long")).alias(v) for v in variables]
    a = df.agg(F.count(F.lit(1)).alias("_n"), *counts)
    each = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("missing"), F.round(100 * F.col(v) / F.nullif("_n", F.lit(0)), 4).alias("pct")) for v in variables))
    return a.select(F.explode(each).alias("r")).select("r.*")


def complete_by_period(df: DataFrame, time: str, variables: list[str]) -> DataFrame:
    full = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in variables))
    return df.groupBy(time).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(full.cast("long")).alias("complete"))


def outliers(df: DataFrame, variables: list[str], method: str = "iqr", threshold: float = 3.0, least: int = 10) -> DataFrame:
    """(variable, n, outliers, pct, p1, p99): outside quartiles -/+ threshold x range, or beyond threshold standard deviations.

    Quantiles are exact and come from several passes over counts.
    """
    q = exact_quantiles(df, {v: [0.01, 0.25, 0.75, 0.99] for v in variables})
    moments = df.agg(*(F.struct(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).alias(f"_{i}") for i, v in enumerate(variables))).first() if method != "iqr" else None

    def outside(i: int, v: str) -> Column:
        if method == "iqr":
            _, lo, hi, _ = q[(v,)]
            return F.lit(False) if lo is None else (F.col(v) < lo - threshold * (hi - lo)) | (F.col(v) > hi + threshold * (hi - lo))
        return F.abs(F.col(v) - F.lit(moments[i]["m"])) > threshold * F.lit(moments[i]["s"])

    a = df.agg(*(F.struct(F.count(v).alias("n"), F.sum(F.coalesce(outside(i, v).cast("long"), F.lit(0))).alias("k")).alias(f"_{i}") for i, v in enumerate(variables)))
    each = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"_{i}.n").alias("n"), F.col(f"_{i}.k").alias("outliers"), F.round(100 * F.col(f"_{i}.k") / F.nullif(F.col(f"_{i}.n"), F.lit(0)), 4).alias("pct"), F.lit(q[(v,)][0]).cast("double").alias("p1"), F.lit(q[(v,)][3]).cast("double").alias("p99")) for i, v in enumerate(variables)))
    return a.select(F.explode(each).alias("r")).select("r.*").where(F.col("n") >= least)


def types(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Outcome numeric, treatment 0/1, ids there, no constant measures. The approximate count of distinct values tells none or one from more exactly."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wrong = not isinstance(kinds[spec.outcome], NumericType)
    text_time = isinstance(kinds[spec.time], StringType)
    measures = [spec.outcome, *spec.controls]
    treated = F.col(spec.treated)
    a = df.agg(
        F.sum((treated.isNotNull() & ~treated.cast("double").isin(0.0, 1.0)).cast("long")).alias("odd_treated"),
        F.sum(F.col(spec.entity).isNull().cast("long")).alias("null_ids"),
        *(F.approx_count_distinct(m).alias(f"d_{m}") for m in measures),
    )
    found = {
        "outcome_type": ("critical", F.lit("the outcome isn't numeric"), F.lit(int(wrong))),
        "time_type": ("warning", F.lit("the time is text"), F.lit(int(text_time))),
        "treatment_values": ("critical", F.lit("treatment values other than 0 and 1"), F.col("odd_treated")),
        "null_ids": ("critical", F.lit("rows without an entity"), F.col("null_ids")),
    }
    found |= {f"constant_{m}": ("critical", F.lit(f"{m} doesn't vary"), (F.col(f"d_{m}") <= 1).cast("long")) for m in measures}
    return _issues(a, found)


def treatment_consistency(df: DataFrame, spec: PanelSpec) -> DataFrame:
    ft = spec.first_treated
    units = df.groupBy(spec.entity).agg(
        F.countDistinct(spec.treated).alias("kinds"), F.countDistinct(ft).alias("starts"), F.max(spec.treated).alias("d"), F.min(ft).alias("ft"),
        F.sum(((F.col(spec.post) == 1) & (F.col(spec.time) < F.col(ft))).cast("long")).alias("early"), F.max(spec.time).alias("last"),
    )
    yes = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    a = units.crossJoin(F.broadcast(df.agg(F.max(spec.time).alias("end")))).agg(yes(F.col("kinds") > 1).alias("varies"), yes(F.col("starts") > 1).alias("starts"), yes(F.col("early") > 0).alias("early"), yes((F.col("d") == 0) & F.col("ft").isNotNull()).alias("never"), yes(F.col("ft") >= F.col("end")).alias("late"))
    return _issues(a, {
        "treatment_varies": ("warning", F.lit("treatment changes within entities"), F.col("varies")),
        "several_starts": ("critical", F.lit("entities with several first periods"), F.col("starts")),
        "post_before_start": ("critical", F.lit("post is 1 before the first treated period"), F.col("early")),
        "never_with_start": ("critical", F.lit("never-treated entities with a first period"), F.col("never")),
        "treated_at_end": ("warning", F.lit("treated at or after the last period"), F.col("late")),
    })


def pretreatment(df: DataFrame, spec: PanelSpec, least: int = 2) -> DataFrame:
    """(entity, periods, outcomes, enough) before treatment, of treated entities."""
    before = F.col(spec.time) < F.col(spec.first_treated)
    a = df.where(F.col(spec.first_treated).isNotNull()).groupBy(spec.entity).agg(F.sum(before.cast("long")).alias("periods"), F.sum((before & F.col(spec.outcome).isNotNull()).cast("long")).alias("outcomes"))
    return a.withColumn("enough", F.col("outcomes") >= least)


def raw_format(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    a = df.agg(
        F.sum(F.col(entity).isNull().cast("long")).alias("ids"),
        F.sum((F.col(time).isNotNull() & F.col(time).try_cast("double").isNull()).cast("long")).alias("times"),
        F.sum((F.col(value).isNotNull() & F.col(value).try_cast("double").isNull()).cast("long")).alias("values"),
        (F.count(F.lit(1)) - F.countDistinct(F.struct(entity, time))).alias("dup"),
    )
    return _issues(a, {"null_ids": ("critical", F.lit("rows without an entity"), F.col("ids")), "bad_times": ("critical", F.lit("times that aren't numbers"), F.col("times")), "bad_values": ("warning", F.lit("values that aren't numbers"), F.col("values")), "duplicate_keys": ("warning", F.lit("repeated keys"), F.col("dup"))})


def validate(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """All issues with the overall verdict: FAIL with a critical one, WARN with any, else PASS.

    The panel is cached, since every check reads it.
    """
    df = df.persist()
    parts = [structure(df, spec.entity, spec.time), types(df, spec)]
    miss = missing_values(df, [spec.outcome, *spec.controls]).where("pct > 5")
    parts.append(miss.select(F.lit("missing_values").alias("check"), F.lit("warning").alias("severity"), F.col("variable").alias("detail"), F.col("missing").alias("n")))
    out = outliers(df, [spec.outcome, *spec.controls]).where("pct > 1")
    parts.append(out.select(F.lit("outliers").alias("check"), F.lit("warning").alias("severity"), F.col("variable").alias("detail"), F.col("outliers").alias("n")))
    if spec.first_treated:
        parts.append(treatment_consistency(df, spec))
        few = pretreatment(df, spec).agg(F.sum((~F.col("enough")).cast("long")).alias("few"))
        parts.append(_issues(few, {"pretreatment": ("critical", F.lit("treated entities with too few periods before"), F.coalesce("few", F.lit(0)))}))
    issues = [tuple(r) for r in reduce(DataFrame.union, parts).collect()]  # a row per check and variable at most
    df.unpersist()
    verdict = "FAIL" if any(r[1] == "critical" for r in issues) else "WARN" if issues else "PASS"
    return df.sparkSession.createDataFrame([(verdict, *r) for r in issues or [(None,) * 4]], "verdict string, check string, severity string, detail string, n long")


def smd(df: DataFrame, treatment: str, covariates: list[str], pooled: bool = True) -> DataFrame:
    """(variable, treated_mean, control_mean, smd): over sqrt((v1+v0)/2), or sqrt(v1+v0) if not pooled."""
    d = F.col(treatment).cast("double") == 1
    cells = [F.struct(F.avg(F.when(d, F.col(c))).alias("m1"), F.avg(F.when(~d, F.col(c))).alias("m0"), F.var_samp(F.when(d, F.col(c))).alias("v1"), F.var_samp(F.when(~d, F.col(c))).alias("v0")).alias(c) for c in covariates]
    a = df.agg(*cells)
    scale = lambda c: F.nullif(F.sqrt((F.col(f"{c}.v1") + F.col(f"{c}.v0")) / (2 if pooled else 1)), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"{c}.m1").alias("treated_mean"), F.col(f"{c}.m0").alias("control_mean"), (F.abs(F.col(f"{c}.m1") - F.col(f"{c}.m0")) / scale(c)).alias("smd")) for c in covariates))
    return a.select(F.explode(each).alias("r")).select("r.*")


def descriptives(df: DataFrame, spec: PanelSpec, variables: list[str]) -> DataFrame:
    """Means and deviations by arm before the first treatment, and their standardised difference (not pooled)."""
    first = df.agg(F.min(spec.first_treated)).first()[0]
    pre = df if first is None else df.where(F.col(spec.time) < first)
    return smd(pre, spec.treated, variables, pooled=False)


def treatment_variation(df: DataFrame, entity: str, status: str) -> DataFrame:
    a = df.groupBy(entity).agg((F.countDistinct(status) > 1).cast("double").alias("switches")).agg((100 * F.avg("switches")).alias("pct_switching"))
    return a.withColumn("verdict", F.when(F.col("pct_switching") == 0, "FAIL").when(F.col("pct_switching") >= 5, "PASS").otherwise("UNCERTAIN"))


def compliance(df: DataFrame, assigned: str, taken: str) -> DataFrame:
    a = df.agg(F.avg(F.when(F.col(assigned) == 1, F.col(taken))).alias("rate"), F.avg(F.when(F.col(assigned) == 0, F.col(taken))).alias("control_rate"))
    return a.withColumn("verdict", F.when(F.col("rate") >= 0.8, "PASS").when(F.col("rate") < 0.5, "FAIL").otherwise("UNCERTAIN"))


def attrition(df: DataFrame, entity: str, time: str, treated: str) -> DataFrame:
    """Share of each arm that is there in the first period and not in the last, and the difference."""
    ends = F.broadcast(df.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")))
    units = df.join(ends).groupBy(entity).agg(F.max(treated).alias("d"), F.max((F.col(time) == F.col("_lo")).cast("int")).alias("first"), F.max((F.col(time) == F.col("_hi")).cast("int")).alias("last"))
    gone = (F.col("last") == 0).cast("double")
    a = units.where("first = 1").agg(F.avg(F.when(F.col("d") == 1, gone)).alias("treated_rate"), F.avg(F.when(F.col("d") == 0, gone)).alias("control_rate"))
    return a.withColumn("difference", F.abs(F.col("treated_rate") - F.col("control_rate"))).withColumn("verdict", F.when(F.col("difference") < 0.05, "PASS").otherwise("UNCERTAIN"))


def policy_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether some rows have policy A alone and some B alone."""
    r = df.agg(F.bool_or((F.col(a) == 1) & (F.col(b) == 0)).alias("a_only"), F.bool_or((F.col(a) == 0) & (F.col(b) == 1)).alias("b_only"))
    return r.withColumn("separable", F.col("a_only") & F.col("b_only"))
