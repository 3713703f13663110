"""Sources, joins and reconciliation of the panel with a second feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.columns import no, per
from panelworks.schema import ABSORBING, REQUIRED

KEYS = ["loan_id", "reporting_month"]


def require_columns(df: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def pack_summary(tables: dict[str, DataFrame], loan_id: str = "loan_id") -> DataFrame:
    """(table, n_rows, n_columns, n_loans) of each table."""
    rows = [
        df.agg(F.count("*").alias("n_rows"), F.countDistinct(loan_id).alias("n_loans")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_loans"
        )
        for name, df in tables.items()
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def attach_static(panel: DataFrame, static: DataFrame, key: str = "loan_id") -> DataFrame:
    """Left join of the columns that the panel lacks; repeated keys in ``static`` raise."""
    if static.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} is not unique in the static table")
    extra = [c for c in static.columns if c == key or c not in panel.columns]
    return panel.join(static.select(extra), key, "left")


def sort_panel(panel: DataFrame) -> DataFrame:
    """Rows of a loan together, in order of month and then row."""
    order = "month_index" if "month_index" in panel.columns else "reporting_month"
    return panel.repartition("loan_id").sortWithinPartitions("loan_id", order, "row_id")


def dedupe_feed(feed: DataFrame, order: str = "seq") -> DataFrame:
    """One row of each key: that of the highest ``order``."""
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.col(order).desc()))
    return feed.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def reconcile(panel: DataFrame, feed: DataFrame | None, tolerance: float = 0.01, stale_days: int = 45) -> DataFrame:
    """The panel with reconciliation flags; all are false or 0 where no feed row matches."""
    lag = F.datediff("last_updated_at", "reporting_month")
    if feed is None:
        none = {c: F.lit(False) for c in ("has_servicer_record", "balance_conflict", "current_status_conflict", "days_past_due_conflict", "source_conflict", "source_stale")}
        return panel.withColumns(
            none | {"balance_rel_diff": F.lit(0.0), "servicer_update_lag_days": F.lit(0), "panel_update_lag_days": F.coalesce(lag, F.lit(0))}
        )
    sv = dedupe_feed(feed).select(
        *KEYS, F.col("current_balance").alias("_balance"), F.col("current_status").alias("_status"),
        F.col("days_past_due").alias("_dpd"), F.col("last_updated_at").alias("_updated"), F.lit(True).alias("_matched"),
    )
    matched = no(F.col("_matched"))
    gap = F.abs(F.col("_balance") - F.col("current_balance")) / F.nullif(F.col("current_balance"), F.lit(0.0))
    feed_lag = F.datediff("_updated", "reporting_month")
    out = panel.join(sv, KEYS, "left").withColumns(
        {
            "has_servicer_record": matched,
            "balance_conflict": no(matched & (gap > tolerance)),
            "balance_rel_diff": F.coalesce(gap, F.lit(0.0)),
            "current_status_conflict": matched & ~F.col("_status").eqNullSafe(F.col("current_status")),
            "days_past_due_conflict": matched & ~F.col("_dpd").eqNullSafe(F.col("days_past_due")),
            "servicer_update_lag_days": F.coalesce(feed_lag, F.lit(0)),
            "source_stale": no(matched & ((feed_lag > stale_days) | (feed_lag < 0))),
            "panel_update_lag_days": F.coalesce(lag, F.lit(0)),
        }
    )
    conflict = F.col("balance_conflict") | F.col("current_status_conflict") | F.col("days_past_due_conflict")
    return out.withColumn("source_conflict", conflict).drop("_balance", "_status", "_dpd", "_updated", "_matched")


def orphan_feed_rows(panel: DataFrame, feed: DataFrame) -> DataFrame:
    return dedupe_feed(feed).join(panel.select(*KEYS), KEYS, "left_anti")


def reconcile_summary(reconciled: DataFrame, feed: DataFrame) -> DataFrame:
    """(check, n) rows."""
    names = {
        "matched to panel": "has_servicer_record", "panel rows with any conflict": "source_conflict",
        "panel rows with stale source": "source_stale", "conflict: current_balance": "balance_conflict",
        "conflict: current_status": "current_status_conflict", "conflict: days_past_due": "days_past_due_conflict",
    }
    counts = reconciled.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in names.values()])
    pairs = ", ".join(f"'{name}', {c}" for name, c in names.items())
    return (
        counts.selectExpr(f"stack({len(names)}, {pairs}) AS (check, n)")
        .unionByName(feed.agg(F.count("*").alias("n")).select(F.lit("servicer rows").alias("check"), "n"))
        .unionByName(orphan_feed_rows(reconciled, feed).agg(F.count("*").alias("n")).select(F.lit("orphan servicer rows").alias("check"), "n"))
    )


def source_trust(reconciled: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double"))
    out = reconciled.where("source_system IS NOT NULL").groupBy("source_system").agg(
        F.count("*").alias("n_records"), rate("source_conflict").alias("conflict_rate"), rate("source_stale").alias("stale_rate"),
        F.percentile("panel_update_lag_days", F.lit(0.5)).alias("median_update_lag_days"),
    )
    return out.withColumn("trust_score", F.greatest(F.lit(0.0), 1 - 0.6 * F.col("conflict_rate") - 0.4 * F.col("stale_rate")))


def conflict_lift(reconciled: DataFrame, label: str = "exception_required") -> DataFrame:
    y = F.col(label).cast("double")
    out = reconciled.agg(F.avg(y).alias("overall_rate"), F.avg(F.when(F.col("source_conflict"), y)).alias("conflict_rate"))
    return out.withColumn("lift", F.col("conflict_rate") / F.nullif(F.col("overall_rate"), F.lit(0.0)))


def union_panels(train: DataFrame, score: DataFrame) -> DataFrame:
    """Both panels with their origin; the order of score rows is kept in ``score_order``."""
    return train.withColumns({"origin": F.lit("train"), "score_order": F.lit(None).cast("long")}).unionByName(
        score.withColumns({"origin": F.lit("score"), "score_order": F.col("row_id")})
    )


def loans_without_history(train: DataFrame, score: DataFrame) -> DataFrame:
    return score.select("loan_id").distinct().join(train.select("loan_id"), "loan_id", "left_anti")


def loan_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("loan_id").intersect(b.select("loan_id"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """How many rows repeat a (loan, month) key."""
    return df.groupBy(*KEYS).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def latest_per_loan(panel: DataFrame, active_only: bool = True) -> DataFrame:
    last = F.row_number().over(per("loan_id", by=[F.desc("month_index"), F.desc("row_id")]))
    out = panel.withColumn("_rank", last).where("_rank = 1").drop("_rank")
    return out.where(~F.col("current_status").isin(ABSORBING)) if active_only else out


def loan_history(panel: DataFrame, loan_id: str) -> DataFrame:
    """One loan: months seen, delinquent months, and its last bad state."""
    rows = panel.where(F.col("loan_id") == loan_id)
    bad = F.col("current_status").isin("30DPD", "60DPD", "90DPD", "Default")
    return rows.groupBy("loan_id").agg(
        F.countDistinct("reporting_month").alias("months_observed"), F.sum(bad.cast("long")).alias("delinquent_months"),
        F.max_by("current_status", F.when(bad, F.struct("month_index", "row_id"))).alias("last_bad_status"),
    )
