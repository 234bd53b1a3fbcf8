"""From facts on how a policy was assigned to a mechanism, a method, its assumptions and its fallbacks.

Facts are one row per policy with flat columns, so that many policies are classified in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.spec import Method

#: (column, type, default) of the facts.
FACTS = (
    ("policy_id", "string", None), ("assigned_by_lottery", "boolean", False), ("has_threshold", "boolean", False), ("perfect_compliance", "boolean", True),
    ("has_instrument", "boolean", False), ("has_start_time", "boolean", False), ("many_controls", "boolean", False), ("overlapping_policies", "boolean", False),
    ("has_intensity", "boolean", False), ("staggered", "boolean", False), ("never_treated_units", "boolean", False), ("all_treated_eventually", "boolean", False), ("panel_available", "boolean", True),
)

#: The nested document of facts, as research writes it.
FACTS_JSON = """q1_assignment struct<how_is_treatment_assigned:string>, q2_threshold struct<has_eligibility_threshold:boolean,compliance_is_perfect:boolean>,
q3_timing struct<has_known_start_time:boolean,treatment_starts_at_different_times:boolean>, q4_control_group struct<has_never_treated_units:boolean,all_units_eventually_treated:boolean>,
q5_treatment_type struct<has_intensity_variation:boolean>, q6_concurrent_policies struct<has_overlapping_policies:boolean>, q7_instrument struct<has_plausible_instrument:boolean>,
data_environment struct<control_variable_count:string,panel_available:boolean>"""


def parse_facts(df: DataFrame, id_col: str = "policy_id", json_col: str = "facts") -> DataFrame:
    """Flat facts from JSON documents; what isn't said has its default."""
    f = df.select(F.col(id_col).cast("string").alias("policy_id"), F.from_json(json_col, FACTS_JSON).alias("f"))
    path = {
        "assigned_by_lottery": F.col("f.q1_assignment.how_is_treatment_assigned") == "by_lottery", "has_threshold": F.col("f.q2_threshold.has_eligibility_threshold"),
        "perfect_compliance": F.col("f.q2_threshold.compliance_is_perfect"), "has_instrument": F.col("f.q7_instrument.has_plausible_instrument"),
        "has_start_time": F.col("f.q3_timing.has_known_start_time"), "many_controls": F.col("f.data_environment.control_variable_count").isin("many", "high", "very_high"),
        "overlapping_policies": F.col("f.q6_concurrent_policies.has_overlapping_policies"), "has_intensity": F.col("f.q5_treatment_type.has_intensity_variation"),
        "staggered": F.col("f.q3_timing.treatment_starts_at_different_times"), "never_treated_units": F.col("f.q4_control_group.has_never_treated_units"),
        "all_treated_eventually": F.col("f.q4_control_group.all_units_eventually_treated"), "panel_available": F.col("f.data_environment.panel_available"),
    }
    return f.select("policy_id", *(F.coalesce(path[c], F.lit(default)).alias(c) for c, _, default in FACTS[1:]))


def classify(facts: DataFrame) -> DataFrame:
    """Adds mechanism, method and the other features that a stronger rule has overruled.

    The rules in order: lottery, threshold, instrument, no start time, overlapping policies, intensity,
    then staggered or single timing.
    """
    x = facts.select(*(F.coalesce(F.col(c), F.lit(d)).alias(c) if d is not None else F.col(c) for c, _, d in FACTS))
    yes = F.col
    mechanism = (
        F.when(yes("assigned_by_lottery"), "random_assignment").when(yes("has_threshold"), "threshold_rule").when(yes("has_instrument"), "time_varying_unobservables")
        .when(~yes("has_start_time"), "selection_on_observables").when(yes("overlapping_policies"), "multiple_overlapping_policies").when(yes("has_intensity"), "continuous_intensity")
        .when(yes("staggered"), "staggered_policy_shock").otherwise("single_policy_shock")
    )
    m = F.col("mechanism")
    method = (
        F.when(m == "random_assignment", Method.RANDOMIZATION.value).when(m == "threshold_rule", Method.RDD.value).when(m == "time_varying_unobservables", Method.IV.value)
        .when((m == "selection_on_observables") & yes("many_controls"), Method.DML.value).when(m == "selection_on_observables", Method.PSM.value)
        .when(m == "multiple_overlapping_policies", Method.DDD.value).when(m == "continuous_intensity", Method.INTENSITY_DID.value)
        .when(m == "staggered_policy_shock", Method.STAGGERED_DID.value).when(yes("never_treated_units"), Method.DID.value).otherwise(Method.SYNTHETIC_DID.value)
    )
    variant = (
        F.when(m == "threshold_rule", F.when(yes("perfect_compliance"), "sharp").otherwise("fuzzy"))
        .when(m == "staggered_policy_shock", F.when(yes("never_treated_units"), "never-treated controls").otherwise("not-yet-treated controls"))
    )
    features = F.array_compact(F.array(
        F.when(yes("has_threshold") & (m != "threshold_rule"), "threshold"), F.when(yes("has_instrument") & (m != "time_varying_unobservables"), "instrument"),
        F.when(yes("overlapping_policies") & (m != "multiple_overlapping_policies"), "overlapping_policies"), F.when(yes("has_intensity") & (m != "continuous_intensity"), "intensity"),
        F.when(yes("staggered") & (m != "staggered_policy_shock"), "staggered"),
    ))
    risk = m.isin("single_policy_shock", "staggered_policy_shock")
    return x.withColumn("mechanism", mechanism).select("*", method.alias("method"), variant.alias("variant"), features.alias("secondary"), risk.alias("unobservables_risk"))


#: Fixed values: (method, assumption, testable, diagnostic).
ASSUMPTIONS = (
    ("did", "parallel trends", True, "event_study"), ("did", "no anticipation", True, "leads"), ("did", "SUTVA", False, None),
    ("staggered_did", "parallel trends", True, "event_study"), ("staggered_did", "no anticipation", True, "leads"), ("staggered_did", "balanced panel", True, "balance"), ("staggered_did", "SUTVA", False, None),
    ("rdd", "no manipulation", True, "density"), ("rdd", "continuous covariates", True, "covariate_balance"), ("rdd", "first stage", True, "compliance"),
    ("iv", "relevance", True, "first_stage"), ("iv", "exclusion", False, None), ("iv", "overidentification", True, "j_test"),
    ("scm", "good fit before treatment", True, "fit"), ("scm", "no interference", False, None),
    ("synthetic_did", "good fit before treatment", True, "fit"), ("synthetic_did", "no anticipation", True, "leads"), ("synthetic_did", "SUTVA", False, None),
    ("dml", "overlap", True, "overlap"), ("dml", "unconfoundedness", False, None), ("psm", "overlap", True, "overlap"), ("psm", "covariate balance", True, "covariate_balance"), ("psm", "unconfoundedness", False, None),
    ("causal_forest", "overlap", True, "overlap"), ("randomization", "covariate balance", True, "covariate_balance"), ("randomization", "compliance", True, "compliance"), ("randomization", "attrition", True, "attrition"),
    ("intensity_did", "parallel trends by dose", True, "dose_trends"), ("intensity_did", "SUTVA", False, None), ("ddd", "separable policies", True, "policy_overlap"), ("ddd", "parallel trends of differences", True, "event_study"),
)
#: Fixed values: (method, fallback, when).
FALLBACKS = (
    ("randomization", "iv", "if compliance is imperfect"), ("randomization", "did", "if arms differ and data before treatment exist"),
    ("rdd", "iv", "if compliance at the cutoff is partial"), ("rdd", "did", "if units choose their side and data before treatment exist"),
    ("dml", "causal_forest", "if heterogeneity is the interest"), ("dml", "psm", "if overlap is poor or the sample small"), ("dml", "iv", "if an instrument exists"), ("dml", "did", "if a panel exists"),
    ("psm", "dml", "if balance is poor"), ("psm", "causal_forest", "if heterogeneity is the interest"), ("psm", "iv", "if an instrument exists"), ("psm", "did", "if a panel exists"),
    ("did", "psm", "if arms differ in observables"), ("did", "scm", "if few units are treated"), ("did", "iv", "if an instrument exists and trends diverge"),
    ("synthetic_did", "scm", "if placebo inference is unstable"), ("synthetic_did", "iv", "if an instrument exists"),
    ("staggered_did", "scm", "if few units are treated"), ("staggered_did", "iv", "if an instrument exists and trends diverge"),
    ("iv", "scm", "if no instrument is valid"), ("iv", "unknown", "if no method's assumptions are plausible"), ("scm", "unknown", "if no fit before treatment is good"),
    ("intensity_did", "iv", "if an instrument for the dose exists"), ("intensity_did", "did", "with the dose cut at its median"), ("ddd", "did", "if one policy can be controlled for"), ("ddd", "unknown", "if the policies can't be separated"),
)


def recommend(facts: DataFrame) -> DataFrame:
    """classify() with arrays of assumptions and of fallbacks in order; overruled features bring fallbacks of their own."""
    spark = facts.sparkSession
    a = spark.createDataFrame(list(ASSUMPTIONS), "method string, name string, testable boolean, diagnostic string").groupBy("method").agg(F.sort_array(F.collect_list(F.struct("name", "testable", "diagnostic"))).alias("assumptions"))
    rows = [(m, k, f, w) for k, (m, f, w) in enumerate(FALLBACKS)]
    f = spark.createDataFrame(rows, "method string, rank int, fallback string, condition string").groupBy("method").agg(F.sort_array(F.collect_list(F.struct("rank", "fallback", "condition"))).alias("_f"))
    own = {"threshold": "rdd", "instrument": "iv", "overlapping_policies": "ddd", "intensity": "intensity_did", "staggered": "staggered_did"}
    extra = F.transform("secondary", lambda s: F.struct(F.try_element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), s).alias("fallback"), F.concat(F.lit("overruled feature: "), s).alias("condition")))
    listed = F.transform(F.coalesce("_f", F.array().cast("array<struct<rank:int,fallback:string,condition:string>>")), lambda x: F.struct(x["fallback"].alias("fallback"), x["condition"].alias("condition")))
    x = classify(facts).join(F.broadcast(a), "method", "left").join(F.broadcast(f), "method", "left")  # tables of fixed values
    return x.withColumn("fallbacks", F.concat(listed, extra)).drop("_f")


def strength(passed: int, failed: int, total: int, changed: bool) -> str:
    """strong: no failure, three quarters passed, first choice kept; moderate: no failure; suggestive: two failures at most after a change."""
    if failed == 0:
        return "strong" if total and passed >= 0.75 * total and not changed else "moderate"
    return "suggestive" if failed <= 2 and changed else "not identifiable"


def strengths(verdicts: DataFrame) -> DataFrame:
    """(case, passed, failed, total, strength) of rows (case, verdict, changed)."""
    a = verdicts.groupBy("case").agg(F.sum((F.col("verdict") == "PASS").cast("long")).alias("passed"), F.sum((F.col("verdict") == "FAIL").cast("long")).alias("failed"), F.count(F.lit(1)).alias("total"), F.bool_or("changed").alias("changed"))
    s = F.when((F.col("failed") == 0) & (F.col("passed") >= 0.75 * F.col("total")) & ~F.col("changed"), "strong").when(F.col("failed") == 0, "moderate").when((F.col("failed") <= 2) & F.col("changed"), "suggestive").otherwise("not identifiable")
    return a.select("case", "passed", "failed", "total", s.alias("strength"))


def all_facts(spark: SparkSession) -> DataFrame:
    """Every combination of the yes-no facts: 2^12 policies, for tests and tables."""
    names = [c for c, t, _ in FACTS if t == "boolean"]
    bits = [(F.shiftright(F.col("id"), k) % 2 == 1).alias(c) for k, c in enumerate(names)]
    return spark.range(1 << len(names)).select(F.col("id").cast("string").alias("policy_id"), *bits)
