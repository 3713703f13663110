"""The rule engine: flags for rows that break a rule, their weights, and what they find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.columns import BY_INDEX, any_of, lookup, no, per
from panelworks.schema import ABSORBING, DPD_BANDS

# Weights of severities, what labels detector rules aim at (in order of precedence),
# and rules that raise a signal rather than find a labelled defect.
WEIGHTS = {"high": 3.0, "medium": 2.0, "low": 1.0}
TARGETS = {
    "balance_non_increasing": "balance_inconsistency", "balance_within_original": "balance_inconsistency",
    "date_order_valid": "date_invalid", "document_completeness_at_closure": "document_gap", "terminal_state_immutability": "status_reversal",
}
ADVISORY = {"servicer_source_agreement", "stale_record"}
SEVERITIES = {
    "balance_non_increasing": "high", "date_order_valid": "high", "dpd_status_consistency": "medium",
    "terminal_state_immutability": "high", "document_completeness_at_closure": "medium", "servicer_source_agreement": "medium",
    "balance_within_original": "high", "stale_record": "medium",
}
STALE_DAYS = 45

_terminal = lambda: no(F.col("current_status").isin(ABSORBING))
_modified = lambda: no(F.col("modification_flag") == 1)


def balance_non_increasing() -> Column:
    before = F.lag("current_balance").over(per("loan_id", by=BY_INDEX))
    return no(F.col("current_balance") > before) & ~_modified()


def balance_within_original() -> Column:
    return no(F.col("current_balance") > F.col("original_balance") * 1.0001) & ~_modified()


def date_order_valid() -> Column:
    return no(F.col("reporting_month") < F.col("origination_month"))


def dpd_status_consistency() -> Column:
    low = F.coalesce(lookup({k: v[0] for k, v in DPD_BANDS.items()}, F.col("current_status")), F.lit(0))
    high = F.coalesce(lookup({k: v[1] for k, v in DPD_BANDS.items()}, F.col("current_status")), F.lit(10000))
    return no((F.col("days_past_due") < low) | (F.col("days_past_due") > high))


def terminal_state_immutability() -> Column:
    earlier = per("loan_id", by=BY_INDEX).rowsBetween(W.unboundedPreceding, -1)
    return no(F.max(_terminal().cast("int")).over(earlier) == 1) & ~_terminal()


def document_completeness_at_closure() -> Column:
    return _terminal() & (F.col("document_status").isNull() | (F.col("document_status") == "Missing"))


def servicer_source_agreement() -> Column:
    return no(F.col("source_conflict"))


def stale_record() -> Column:
    lag = F.datediff("last_updated_at", "reporting_month")
    return no((lag > STALE_DAYS) | (lag < 0))


#: Rule identifier -> a function that gives its flag as a column. Add to it to plug in a rule.
REGISTRY: dict[str, Callable[[], Column]] = {
    f.__name__: f
    for f in (
        balance_non_increasing, date_order_valid, dpd_status_consistency, terminal_state_immutability,
        document_completeness_at_closure, servicer_source_agreement, balance_within_original, stale_record,
    )
}


def evaluate_rules(df: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """A flag column for every known rule, all in one pass; rules not in REGISTRY are left out."""
    return df.withColumns({r: REGISTRY[r]() for r in rules or REGISTRY if r in REGISTRY})


def flag_columns(df: DataFrame) -> list[str]:
    return [r for r in REGISTRY if r in df.columns]


def rule_scores(flagged: DataFrame) -> DataFrame:
    """rule_violation_count, any_violation and rule_severity_score."""
    flags = flag_columns(flagged)
    return flagged.withColumns(
        {
            "rule_violation_count": sum(F.col(r).cast("int") for r in flags),
            "any_violation": any_of([F.col(r) for r in flags]),
            "rule_severity_score": sum(F.col(r).cast("double") * WEIGHTS[SEVERITIES[r]] for r in flags),
        }
    )


def rule_catalog(flagged: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(rule_id, severity, weight, source, implemented, n_flagged, description) of every declared and every local rule.

    ``declared`` is a table of rule declarations (rule_id, description, severity). A declared rule that the engine
    does not know is reported as not implemented with no flags; a known rule that is not declared is a local one.
    """
    flags = flag_columns(flagged)
    counts = flagged.agg(*[F.coalesce(F.sum(F.col(r).cast("long")), F.lit(0)).alias(r) for r in flags])
    rows = ", ".join(f"'{r}', '{SEVERITIES.get(r, 'medium')}', {r}" for r in flags)
    known = counts.selectExpr(f"stack({len(flags)}, {rows}) AS (rule_id, _severity, _n)")
    if declared is None:
        out = known.withColumns({"severity": F.col("_severity"), "description": F.lit(None).cast("string"), "source": F.lit("local")})
    else:
        told = declared.groupBy("rule_id").agg(F.min("severity").alias("severity"), F.min("description").alias("description"), F.lit(1).alias("_d"))
        out = told.join(known, "rule_id", "full").withColumns({"severity": F.coalesce("severity", "_severity", F.lit("medium")), "source": F.when(F.col("_d").isNotNull(), "declared").otherwise("local")})
    weight = F.coalesce(lookup(WEIGHTS, F.col("severity")), F.lit(WEIGHTS["medium"]))
    return out.select("rule_id", "severity", weight.alias("weight"), "source", F.col("_severity").isNotNull().alias("implemented"), F.coalesce("_n", F.lit(0)).alias("n_flagged"), "description")


def benchmark_rules(flagged: DataFrame, label: str = "exception_required", kind: str = "exception_type") -> DataFrame:
    """Each rule, and any detector or any rule, against labels: one aggregate, unpivoted."""
    flags = flag_columns(flagged)
    masks = {r: F.col(r) for r in flags}
    truths = {r: F.col(kind) == TARGETS[r] for r in flags if r in TARGETS}
    for name, rules in (("ANY DETECTOR RULE", [r for r in flags if r not in ADVISORY]), ("ANY RULE", flags)):
        masks[name], truths[name] = any_of([F.col(r) for r in rules]), F.col(label) == 1
    n = lambda c: F.coalesce(F.sum(no(c).cast("long")), F.lit(0))
    cells, at = [], {}
    for name, mask in masks.items():
        truth = truths.get(name)
        at[name] = len(cells)
        cells += [n(mask), n(truth) if truth is not None else F.lit(None).cast("long"), n(mask & truth) if truth is not None else F.lit(None).cast("long"), n(mask & (F.col(label) == 1))]
    totals = flagged.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    rows = ", ".join(f"'{name}', c{i}, c{i + 1}, c{i + 2}, c{i + 3}" for name, i in at.items())
    out = totals.selectExpr(f"stack({len(at)}, {rows}) AS (rule_id, n_flagged, n_labelled, true_positives, _hits)")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        "rule_id", "n_flagged", "n_labelled", "true_positives", share("true_positives", "n_flagged").alias("precision"),
        share("true_positives", "n_labelled").alias("recall"), share("_hits", "n_flagged").alias("exception_rate_when_flagged"),
    )


def rule_covered() -> Column:
    return any_of([F.col(r) for r in REGISTRY if r not in ADVISORY])


def rule_assigned_type() -> Column:
    return F.coalesce(*[F.when(F.col(r), t) for r, t in TARGETS.items()], F.lit("none"))


def exception_coverage(flagged: DataFrame, label: str = "exception_required") -> DataFrame:
    covered, y = rule_covered(), F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    return flagged.agg(n(y).alias("total"), n(y & covered).alias("resolved_by_rules"), n(~y & covered).alias("false_positives"), n(y & ~covered).alias("residual"))


def blend_rule_and_anomaly(df: DataFrame, rule: str = "rule_severity_score", anomaly: str = "anomaly_score") -> DataFrame:
    """blended_score: 0.6 of the rule score and 0.4 of the anomaly score, each scaled to [0, 1]."""
    ends = df.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in (rule, anomaly) for f in (F.min, F.max)])
    scaled = lambda c: F.when(F.col(f"_max_{c}") > F.col(f"_min_{c}"), (F.col(c) - F.col(f"_min_{c}")) / (F.col(f"_max_{c}") - F.col(f"_min_{c}"))).otherwise(0.0)
    out = df.crossJoin(F.broadcast(ends)).withColumn("blended_score", 0.6 * scaled(rule) + 0.4 * scaled(anomaly))
    return out.drop(*ends.columns)


def combined_exception_output(df: DataFrame, p: str = "residual_prob", anomaly: str = "anomaly_score") -> DataFrame:
    """exception_probability, exception_kind and decided_by; a rule outranks a model, that a score.

    Where the model decides, the kind is its residual_type, if there is one.
    """
    covered, has = rule_covered(), F.col(p).isNotNull()
    typed = F.coalesce("residual_type", F.lit("none")) if "residual_type" in df.columns else F.lit("none")
    return df.withColumns(
        {
            "exception_probability": F.when(covered, 0.98).when(has, F.col(p)).otherwise(F.col(anomaly) * 0.5),
            "exception_kind": F.when(covered, rule_assigned_type()).when(has & (F.col(p) >= 0.5), typed).otherwise("none"),
            "decided_by": F.when(covered, "rule").when(has & (F.col(p) >= 0.5), "residual model").when(has, "no exception indicated").otherwise("anomaly score only"),
        }
    )


def reviewer_queue(df: DataFrame, top_rules: int = 15, top_others: int = 10, drivers: DataFrame | None = None) -> DataFrame:
    """The rows to look at first, with the rules that fired as text.

    ``drivers`` (row_id, drivers) adds what makes the row unusual, for the rows shown only.
    """
    flags = flag_columns(df)
    fired = F.array_join(F.filter(F.array(*[F.when(F.col(r), r) for r in flags]), lambda x: x.isNotNull()), ", ")
    rows = df.select("row_id", "exception_probability", "anomaly_score", "decided_by", fired.alias("fired_rules"))
    order = [F.desc("exception_probability"), F.desc("anomaly_score"), "row_id"]
    shown = rows.where("decided_by = 'rule'").orderBy(*order).limit(top_rules).unionByName(rows.where("decided_by <> 'rule'").orderBy(*order).limit(top_others))
    return shown if drivers is None else shown.join(drivers.select("row_id", "drivers"), "row_id", "left")


def decided_by_mix(df: DataFrame) -> DataFrame:
    mix = df.groupBy("decided_by").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return mix.crossJoin(F.broadcast(total)).select("decided_by", "n", (F.col("n") / F.col("total")).alias("share"))


def exception_labels() -> dict[str, Column]:
    """exception_type by precedence, and exception_required."""
    s, dpd = F.col("current_status"), F.col("days_past_due")
    kind = F.when(s.isin(ABSORBING) & (F.col("document_status") == "Missing"), "document_gap").when(
        ((s == "Current") & (dpd > 0)) | ((s == "90DPD") & (dpd < 60)), "delinquency_inconsistency"
    ).otherwise("none")
    return {"exception_type": kind, "exception_required": (kind != "none").cast("int")}
