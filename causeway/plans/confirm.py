"""Tests a method's assumptions on the data, falls back where they fail, and estimates by the method that is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.stats import normal_p
from causeway.operators import validate as v
from causeway.plans import cross_section, decide, did, dml, robust, staggered, synthetic
from causeway.spec import Method, PanelSpec


@dataclass
class Case:
    """A panel or cross-section with the roles that the methods need; those a method lacks make it unavailable."""

    data: DataFrame
    spec: PanelSpec
    running: str | None = None
    cutoff: float | None = None
    instruments: list[str] = field(default_factory=list)
    dose: str | None = None
    group: str | None = None
    unit: str | int | None = None
    first: int | None = None
    assigned: str | None = None
    policies: tuple[str, str] | None = None


Verdict = tuple[str, dict]


def _word(passed: bool | None) -> str:
    return "UNCERTAIN" if passed is None else "PASS" if passed else "FAIL"


def _event_study(c: Case) -> Verdict:
    r = did.event_study(c.data, c.spec).first()
    return _word(r["jointly_zero"]), {"f": r["pretrend_f"], "p": r["pretrend_p"]}


def _leads(c: Case) -> Verdict:
    """Lead -2 against -1, the last before the reference."""
    rows = {r["rel_time"]: r for r in did.event_study(c.data, c.spec).collect()}
    r = rows.get(-2)
    return _word(None if r is None or r["p"] is None else r["p"] > 0.05), {"coef": r and r["coef"], "p": r and r["p"]}


def _balance(c: Case) -> Verdict:
    from causeway.operators.clean import balance

    r = balance(c.data, c.spec.entity, c.spec.time).first()
    return _word(r["missing_pct"] < 5), r.asDict()


def _density(c: Case) -> Verdict:
    r = cross_section.mccrary(c.data, c.running, c.cutoff).first()
    return _word(not r["manipulated"]), r.asDict()


def _covariates(c: Case) -> Verdict:
    worst = v.smd(c.data, c.spec.treated, list(c.spec.controls)).agg(F.max("smd")).first()[0]
    return _word(None if worst is None else worst < 0.25), {"largest": worst}


def _first_stage(c: Case) -> Verdict:
    r = cross_section.instrumental(c.data, c.spec.outcome, c.spec.treated, c.instruments, c.spec.controls).first()
    return _word(not r["weak"]), {"f": r["first_stage_f"]}


def _j_test(c: Case) -> Verdict:
    r = cross_section.instrumental(c.data, c.spec.outcome, c.spec.treated, c.instruments, c.spec.controls).first()
    return _word(None if r["j_p"] is None else r["j_p"] > 0.05), {"j": r["j"], "p": r["j_p"]}


def _fit(c: Case) -> Verdict:
    error = synthetic.pre_rmse(c.data, c.spec, c.unit, c.first)
    sd = c.data.where(F.col(c.spec.time) < c.first).agg(F.stddev_samp(c.spec.outcome)).first()[0]
    return _word(None if not sd or error is None else error < 0.5 * sd), {"pre_rmse": error, "sd": sd}


def _overlap(c: Case) -> Verdict:
    r = dml.overlap(c.data, c.spec.treated, list(c.spec.controls)).first()
    return r["verdict"], {"overlap": r["overlap"]}


def _compliance(c: Case) -> Verdict:
    r = v.compliance(c.data, c.assigned, c.spec.treated).first()
    return r["verdict"], {"rate": r["rate"]}


def _attrition(c: Case) -> Verdict:
    r = v.attrition(c.data, c.spec.entity, c.spec.time, c.spec.treated).first()
    return r["verdict"], {"difference": r["difference"]}


def _dose_trends(c: Case) -> Verdict:
    """A false date in the middle of the periods before the first treatment."""
    before = c.data.where(F.col(c.spec.time) < c.first)
    mid = before.agg(F.percentile(c.spec.time, F.lit(0.5))).first()[0]
    if mid is None:
        return "UNCERTAIN", {}
    r = did.intensity_did(before.withColumn(c.spec.post, (F.col(c.spec.time) > mid).cast("double")), c.spec, c.dose).first()
    return _word(None if r["p"] is None else r["p"] > 0.05), {"p": r["p"]}


def _policies(c: Case) -> Verdict:
    return _word(v.policy_overlap(c.data, *c.policies).first()["separable"]), {}


#: diagnostic: (function, roles it needs)
DIAGNOSTICS: dict[str, tuple[Callable[[Case], Verdict], tuple[str, ...]]] = {
    "event_study": (_event_study, ("first_treated",)), "leads": (_leads, ("first_treated",)), "balance": (_balance, ()), "density": (_density, ("running", "cutoff")),
    "covariate_balance": (_covariates, ("treated", "controls")), "first_stage": (_first_stage, ("instruments",)), "j_test": (_j_test, ("instruments",)), "fit": (_fit, ("unit", "first")),
    "overlap": (_overlap, ("treated", "controls")), "compliance": (_compliance, ("assigned",)), "attrition": (_attrition, ("treated",)), "dose_trends": (_dose_trends, ("dose", "first")), "policy_overlap": (_policies, ("policies",)),
}


def _has(case: Case, role: str) -> bool:
    value = getattr(case.spec, role) if hasattr(case.spec, role) else getattr(case, role)
    return value is not None and value != () and value != []


def diagnose(case: Case, method: Method) -> list[dict]:
    """One row per assumption of the method: PASS, FAIL, UNCERTAIN, or NOT_RUN where it can't be tested or a role is missing."""
    rows = []
    for m, name, testable, key in decide.ASSUMPTIONS:
        if m != method:
            continue
        verdict, values = "NOT_RUN", {}
        if testable and key and all(_has(case, r) for r in DIAGNOSTICS[key][1]):
            verdict, values = DIAGNOSTICS[key][0](case)
        rows.append({"method": str(method), "assumption": name, "verdict": verdict, "values": {k: str(x) for k, x in values.items()}})
    return rows


def _staggered(c: Case) -> DataFrame:
    """The overall effect with the error of the cluster bootstrap."""
    att = staggered.aggregate_att(staggered.att_gt(c.data, c.spec)).where("kind = 'overall'").first()["att"]
    se = staggered.bootstrap_att(c.data, c.spec, 100).first()["sd"]
    return did.frame(c.data, [{"coef": att, "se": se, "p": normal_p(att / se) if se else None}], "coef double, se double, p double")


#: What each method needs beyond entity, time and outcome, and how it estimates: a frame with coef and se.
ESTIMATORS: dict[Method, tuple[tuple[str, ...], Callable[[Case], DataFrame]]] = {
    Method.DID: (("treated", "post"), lambda c: did.twfe(c.data, c.spec).select("coef", "se", "p")),
    Method.STAGGERED_DID: (("first_treated",), lambda c: _staggered(c)),
    Method.INTENSITY_DID: (("dose", "post"), lambda c: did.intensity_did(c.data, c.spec, c.dose).select("coef", "se", "p")),
    Method.DDD: (("treated", "post", "group"), lambda c: did.triple_difference(c.data, c.spec, c.group).where("term = 'ddd'").select("coef", "se", "p")),
    Method.RDD: (("running", "cutoff"), lambda c: cross_section.sharp_rdd(c.data, c.spec.outcome, c.running, c.cutoff).select("coef", "se", "p")),
    Method.IV: (("treated", "instruments"), lambda c: cross_section.instrumental(c.data, c.spec.outcome, c.spec.treated, c.instruments, c.spec.controls).where("estimator = '2sls'").select("coef", "se", "p")),
    Method.SCM: (("unit", "first"), lambda c: synthetic.synthetic_control(c.data, c.spec, c.unit, c.first).where("treated").select(F.col("att").alias("coef"), F.lit(None).cast("double").alias("se"), "p")),
    Method.SYNTHETIC_DID: (("unit", "first"), lambda c: synthetic.synthetic_did(c.data, c.spec, c.unit, c.first).select(F.col("att").alias("coef"), "se", "p")),
    Method.DML: (("treated", "controls"), lambda c: dml.dml(c.data, c.spec.outcome, c.spec.treated, list(c.spec.controls), c.spec.entity).select(F.col("theta").alias("coef"), "se", "p")),
    Method.CAUSAL_FOREST: (("treated", "controls"), lambda c: dml.forest_summary(dml.causal_forest(c.data, c.spec.outcome, c.spec.treated, list(c.spec.controls), c.spec.entity)).select(F.col("mean").alias("coef"), "se", F.lit(None).cast("double").alias("p"))),
    Method.PSM: (("treated", "controls"), lambda c: dml.psm(c.data, c.spec.outcome, c.spec.treated, list(c.spec.controls), c.spec.entity).select(F.col("att").alias("coef"), "se", "p")),
    Method.RANDOMIZATION: (("treated", "post"), lambda c: robust.randomization_inference(c.data, c.spec).select(F.col("actual").alias("coef"), F.col("sd").alias("se"), "p")),
}


def available(case: Case, method: Method) -> bool:
    return method in ESTIMATORS and all(_has(case, r) for r in ESTIMATORS[method][0])


def fallback_attempts(case: Case, method: Method) -> list[dict]:
    """Fallbacks tried in order until one is selected: (method, hop, outcome, reason, verdicts).

    First those of the method, then those of its fallbacks, and so on, each method once: skipped without the columns it
    needs, rejected with a failed assumption, else selected.
    """
    attempts, seen, level, hop = [], {str(method)}, [str(method)], 1
    while level:
        following = []
        for asked in level:
            for m, fallback, _ in decide.FALLBACKS:
                if m != asked or fallback in seen:
                    continue
                seen.add(fallback)
                following.append(fallback)
                own = Method(fallback)
                if not available(case, own):
                    needs = ESTIMATORS[own][0] if own in ESTIMATORS else ()
                    lacks = [r for r in needs if not _has(case, r)]
                    attempts.append({"method": fallback, "hop": hop, "outcome": "skipped", "reason": f"lacks {', '.join(lacks)}" if lacks else "has no estimator", "verdicts": []})
                    continue
                verdicts = diagnose(case, own)
                failed = [r["assumption"] for r in verdicts if r["verdict"] == "FAIL"]
                attempts.append({"method": fallback, "hop": hop, "outcome": "rejected" if failed else "selected", "reason": ", ".join(failed), "verdicts": verdicts})
                if not failed:
                    return attempts
        level, hop = following, hop + 1
    return attempts


def confirm(case: Case, method: Method) -> dict:
    """The method, or the first fallback without a failed assumption, with verdicts, attempts and the strength of the case."""
    first = diagnose(case, method) if available(case, method) else [{"method": str(method), "assumption": "data", "verdict": "FAIL", "values": {}}]
    final, rows, attempts = method, first, []
    if any(r["verdict"] == "FAIL" for r in first):
        attempts = fallback_attempts(case, method)
        if attempts and attempts[-1]["outcome"] == "selected":
            final, rows = Method(attempts[-1]["method"]), attempts[-1]["verdicts"]
    ran = [r for r in rows if r["verdict"] != "NOT_RUN"]
    passed, failed = sum(r["verdict"] == "PASS" for r in ran), sum(r["verdict"] == "FAIL" for r in ran)
    return {"method": method, "final": final, "verdicts": first if final == method else first + rows, "attempts": attempts, "strength": decide.strength(passed, failed, len(ran), final != method)}


def specification(case: Case, method: Method) -> dict:
    """What an estimation of the method needs, by role: a dictionary of plain values for a report or a job."""
    roles = {r: getattr(case.spec, r) if hasattr(case.spec, r) else getattr(case, r) for r in (ESTIMATORS[method][0] if method in ESTIMATORS else ())}
    return {"method": str(method), "entity": case.spec.entity, "time": case.spec.time, "outcome": case.spec.outcome, "controls": list(case.spec.controls), **roles, "complete": available(case, method)}


def evaluate(case: Case, method: Method) -> DataFrame:
    """Confirm, estimate and check robustness on one cached panel: (section, item, value) rows that a report is made of."""
    data = case.data.persist()
    case = Case(**{**case.__dict__, "data": data})
    found = confirm(case, method)
    rows = [("method", "asked", str(found["method"])), ("method", "used", str(found["final"])), ("method", "strength", found["strength"])]
    rows += [("assumption", f"{r['method']}: {r['assumption']}", r["verdict"]) for r in found["verdicts"]]
    rows += [("fallback", a["method"], f"{a['outcome']}{': ' if a['reason'] else ''}{a['reason']}") for a in found["attempts"]]
    if available(case, found["final"]):
        e = ESTIMATORS[found["final"]][1](case).first()
        rows += [("estimate", k, None if e[k] is None else repr(float(e[k]))) for k in ("coef", "se", "p")]
    checks: dict[str, bool | None] = {}
    if found["final"] in (Method.DID, Method.STAGGERED_DID) and case.spec.treated and case.spec.post:
        loo = robust.leave_one_out(data, case.spec)
        s = robust.loo_summary(loo, case.spec.entity).first()
        checks["leave one out"] = (s["lo"] > 0) == (s["hi"] > 0)
        checks["coefficient stability"] = robust.coefficient_stability(data, case.spec).first()["stable"] if case.spec.controls else None
        checks["placebo"] = robust.randomization_inference(data, case.spec).first()["p"] < 0.05
    rows += [("robustness", k, "not run" if x is None else "pass" if x else "fail") for k, x in checks.items()]
    rows.append(("robustness", "verdict", robust.sensitivity_verdict(checks)))
    data.unpersist()
    return data.sparkSession.createDataFrame(rows, "section string, item string, value string")


def markdown(report: DataFrame, title: str) -> str:
    """The report as text; it is as long as the list of checks."""
    lines, section = [f"# {title}"], None
    for r in report.collect():
        if r["section"] != section:
            section = r["section"]
            lines += ["", f"## {section.capitalize()}", ""]
        lines.append(f"- {r['item']}: {r['value'] if r['value'] is not None else 'n/a'}")
    return "\n".join(lines) + "\n"
