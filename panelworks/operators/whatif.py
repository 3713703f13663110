"""Loan rows scored again under changed inputs, by the models that score the portfolio."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.operators.models import Fitted, score_targets, score_transitions
from panelworks.operators.scoring import changed_columns, what_if_deltas, what_if_frames
from panelworks.operators.transitions import one_step_scores, score_next_state
from panelworks.schema import ABSORBING
from panelworks.session import checkpoint, written

# Columns that describe the record and not the loan, as a clean record has them.
RECORD = {"rule_violation_count": 0, "source_conflict": 0, "source_stale": 0, "servicer_update_lag_days": 0, "data_quality_score": 100.0}
# Derived columns whose change is reported.
DERIVED = [
    "balance_ratio", "amortisation_gap", "term_progress", "rate_incentive", "rate_incentive_pctile", "credit_score_band_ordinal", "ltv_band_ordinal", "dti_band_ordinal",
]
KEYS = ["scenario_id", "row_id"]


def what_if_features(rows: DataFrame, overrides: DataFrame, features: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(before, after): the overridden rows with features, once without and once with the overrides.

    A whole loan is worked out anew, as later rows follow from earlier ones; ``features`` of a row follow from its loan
    alone. Columns of RECORD are the same on both
    sides: overrides of them are ignored, and where ``rows`` has none they are those of a clean record.
    """
    overrides = overrides.drop(*RECORD)
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) if c in rows.columns else F.lit(float(v)) for c, v in RECORD.items()})
    rows = written(rows.join(overrides.select("loan_id").distinct(), "loan_id", "left_semi"))
    _, after = what_if_frames(rows, overrides, features)
    asked = overrides.select("scenario_id", "loan_id", "reporting_month").distinct()
    # Without overrides a loan is the same in all of its scenarios, so it is worked out once.
    before = features(rows).join(asked, ["loan_id", "reporting_month"])
    return checkpoint(before.select("scenario_id", *[c for c in before.columns if c != "scenario_id"])), checkpoint(after.join(asked, ["scenario_id", "loan_id", "reporting_month"], "left_semi"))


def what_if_scores(before: DataFrame, after: DataFrame, models: list[Fitted]) -> DataFrame:
    """A row for each scenario, row and target that has a model: both probabilities, their change and bands, and ``changed``,
    the names of the overridden and derived columns that differ, empty where nothing does."""
    fitted = [m for m in models if m.model is not None]
    if not fitted:
        raise ValueError("no target has a model")
    names = {m.target: f"_p_{m.target}" for m in fitted}
    shown = [c for c in before.columns if c not in (*KEYS, *RECORD, "loan_id", "reporting_month")]
    old = score_targets(before, fitted, names).select(*KEYS, *[F.col(c).alias(f"{c}_base") for c in (*shown, *names.values())])
    pairs = checkpoint(score_targets(after, fitted, names).select(*KEYS, *shown, *names.values()).join(old, KEYS))
    reported = [c for c in shown if c in DERIVED or c in OVERRIDABLE]
    changed = pairs.select(*KEYS, changed_columns(pairs, reported).alias("changed"))
    deltas = what_if_deltas(pairs, list(names.values()))
    return deltas.withColumn("target", F.expr("substring(target, 4)")).join(changed, KEYS)


# Columns that a reviewer may override.
OVERRIDABLE = [
    "current_balance", "interest_rate", "days_past_due", "remaining_term_months", "modification_flag", "current_status", "credit_score_band", "ltv_band", "dti_band",
]


def what_if_states(before: DataFrame, after: DataFrame, cells: DataFrame, models: dict, columns: list[str]) -> DataFrame:
    """(scenario_id, row_id, baseline_state, baseline_confidence, scenario_state, scenario_confidence) by the transition models;
    a loan in an absorbing state stays there for certain."""
    def scored(df: DataFrame) -> DataFrame:
        at = one_step_scores(df.withColumn("from_state", F.col("current_status")), cells)
        out = score_next_state(score_transitions(at, models, columns), "p_model")
        absorbed = F.col("from_state").isin(ABSORBING)
        return out.select(
            *KEYS, F.when(absorbed, F.col("from_state")).otherwise(F.col("next_state_pred")).alias("state"), F.when(absorbed, 1.0).otherwise(F.col("next_state_confidence")).alias("confidence")
        )

    old = scored(before).select(*KEYS, F.col("state").alias("baseline_state"), F.col("confidence").alias("baseline_confidence"))
    return old.join(scored(after).select(*KEYS, F.col("state").alias("scenario_state"), F.col("confidence").alias("scenario_confidence")), KEYS)
