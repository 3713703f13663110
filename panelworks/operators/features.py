"""Panel features that use a loan's rows so far only, forward labels, and time-aware splits."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.columns import BY_INDEX, BY_MONTH, clip, lookup, no, per
from panelworks.operators.metrics import prefix_sums
from panelworks.operators.quality import folded
from panelworks.schema import CREDIT_MIDPOINTS, DELINQUENT, DTI_MIDPOINTS, LTV_MIDPOINTS
from panelworks.session import written

HORIZONS = {"delinq_3": 3, "delinq_6": 6, "default_12": 12, "prepay_12": 12}


def canonicalise_state(df: DataFrame, column: str = "state") -> DataFrame:
    return df.withColumn(column, F.upper(folded(F.col(column))))


def amortisation(df: DataFrame) -> DataFrame:
    """balance_ratio, term_progress, scheduled_balance_ratio and amortisation_gap."""
    if "balance_ratio" not in df.columns:
        df = df.withColumn("balance_ratio", clip(F.col("current_balance") / F.nullif(F.col("original_balance"), F.lit(0.0)), 0, 2))
    term = F.col("loan_age_months") + F.col("remaining_term_months")
    grow = 1 + F.col("interest_rate") / 1200
    whole, so_far = F.pow(grow, term), F.pow(grow, F.col("loan_age_months"))
    return df.withColumns(
        {"term_progress": clip(F.col("loan_age_months") / F.nullif(term, F.lit(0)), 0, 1), "scheduled_balance_ratio": clip((whole - so_far) / F.nullif(whole - 1, F.lit(0.0)), 0, 1)}
    ).withColumn("amortisation_gap", F.col("balance_ratio") - F.col("scheduled_balance_ratio"))


def market_rates(df: DataFrame) -> DataFrame:
    """(month, market_rate): mean first rate of loans by origination month, over three such months."""
    first = df.withColumn("_n", F.row_number().over(per("loan_id", by=BY_MONTH))).where("_n = 1")
    # The rate at origination, where the panel has it: a modification changes the current one.
    rate = "original_interest_rate" if "original_interest_rate" in df.columns else "interest_rate"
    months = first.groupBy(F.col("origination_month").alias("month")).agg(F.avg(rate).alias("rate"))
    # A table of months: small whatever the panel, so its one window is no bottleneck.
    return months.select("month", F.avg("rate").over(W.orderBy("month").rowsBetween(-2, 0)).alias("market_rate"))


def rate_incentive(df: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """market_rate as of the reporting month (the last known one, else the first) and the gap to it.

    ``rates`` are the market rates of a whole panel, where ``df`` is a part of it.
    """
    rates = market_rates(df) if rates is None else rates
    months = df.select(F.col("reporting_month").alias("month")).distinct().join(rates, "month", "full")
    known = F.last("market_rate", ignorenulls=True).over(W.orderBy("month"))
    first = F.first("market_rate", ignorenulls=True).over(W.orderBy("month").rowsBetween(0, W.unboundedFollowing))
    filled = months.select(F.col("month").alias("reporting_month"), F.coalesce(known, first).alias("market_rate"))
    out = df.join(F.broadcast(filled), "reporting_month", "left")
    return out.withColumn("rate_incentive", F.col("interest_rate") - F.col("market_rate"))


def rate_incentive_pctile(df: DataFrame) -> DataFrame:
    """Average-rank percentile of rate_incentive within its month, ranked over distinct values.

    One prefix sum over (month, value) serves all months, so a month is no single task.
    """
    counts = df.where("rate_incentive IS NOT NULL").groupBy("reporting_month", "rate_incentive").agg(F.count("*").alias("n"))
    placed = prefix_sums(counts.select(F.struct("reporting_month", "rate_incentive").alias("k"), "n"), "k", ["n"]).select("k.*", "n", "up_n")
    months = placed.groupBy("reporting_month").agg(F.sum("n").alias("_total"), F.min("up_n").alias("_base"))
    rank = (F.col("up_n") - F.col("_base") + (F.col("n") + 1) / 2) / F.col("_total")
    ranks = placed.join(F.broadcast(months), "reporting_month").select("reporting_month", "rate_incentive", rank.alias("rate_incentive_pctile"))
    # Rows without an incentive would all have one key a month; they need no rank.
    some = F.col("rate_incentive").isNotNull()
    return df.where(some).join(ranks, ["reporting_month", "rate_incentive"], "left").unionByName(df.where(~some).withColumn("rate_incentive_pctile", F.lit(None).cast("double")))


def history(df: DataFrame) -> DataFrame:
    """Running features of each loan in order of reporting month."""
    w = per("loan_id", by=BY_MONTH).rowsBetween(W.unboundedPreceding, 0)
    late = no(F.col("current_status").isin(DELINQUENT)).cast("long")
    before = F.lag("current_status").over(per("loan_id", by=BY_MONTH))
    df = df.withColumns(
        {
            "months_delinquent_to_date": F.sum(late).over(w),
            "max_dpd_to_date": F.max("days_past_due").over(w),
            "ever_modified": F.coalesce(F.max("modification_flag").over(w), F.lit(0)),
            "balance_change_3m": F.col("balance_ratio") - F.lag("balance_ratio", 3).over(per("loan_id", by=BY_MONTH)),
            "_episode": F.sum(1 - late).over(w),
            "_changed": no(F.col("current_status") != before).cast("long"),
        }
    )
    run = per("loan_id", "_episode", by=BY_MONTH).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns(
        {
            "ever_delinquent": (F.col("months_delinquent_to_date") > 0).cast("int"),
            "n_status_changes_to_date": F.sum("_changed").over(w),
            "delinquency_streak": F.sum(late).over(run),
        }
    ).drop("_episode", "_changed")


def band_ordinals(df: DataFrame) -> DataFrame:
    """Midpoints of the bands that are there; unknown labels are null."""
    bands = {"credit_score_band": CREDIT_MIDPOINTS, "ltv_band": LTV_MIDPOINTS, "dti_band": DTI_MIDPOINTS}
    return df.withColumns({f"{c}_ordinal": lookup(m, F.col(c)) for c, m in bands.items() if c in df.columns})


def quality_features(df: DataFrame) -> DataFrame:
    """Quality columns as numbers, with what a clean row would have where they are missing."""
    columns = {"rule_violation_count": 0, "source_conflict": 0, "source_stale": 0, "servicer_update_lag_days": 0, "data_quality_score": 100.0}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double" if c == "data_quality_score" else "int"), F.lit(v)) if c in df.columns else F.lit(v) for c, v in columns.items()})


def engineer_features(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """All features that the columns allow, and a manifest: for each step whether it was built, the columns it added and those it lacked.

    The panel is written once, as several steps first gather figures over all of it.
    """
    df = written(df)
    steps = [
        (canonicalise_state, ["state"]), (amortisation, ["current_balance", "original_balance", "loan_age_months", "remaining_term_months", "interest_rate"]),
        (rate_incentive, ["origination_month", "interest_rate"]), (rate_incentive_pctile, ["origination_month", "interest_rate"]),
        (history, ["current_status", "days_past_due", "modification_flag", "balance_ratio"]), (band_ordinals, []), (quality_features, []),
    ]
    manifest = []
    for step, needs in steps:
        before, missing = df.columns, [c for c in needs if c not in df.columns]
        df = df if missing else step(df)
        manifest.append({"step": step.__name__, "built": not missing, "added": [c for c in df.columns if c not in before], "missing": missing})
    return df, manifest


def forward_labels(df: DataFrame) -> DataFrame:
    """Whether a state comes within the next rows of a loan, and its next state (its own at the end)."""
    w = lambda k: per("loan_id", by=BY_INDEX).rowsBetween(1, k)
    hit = lambda states, k: F.coalesce(F.max(F.col("current_status").isin(states).cast("int")).over(w(k)), F.lit(0))
    bad = [*DELINQUENT, "Default"]
    return df.withColumns(
        {
            "delinq_3": hit(bad, 3), "delinq_6": hit(bad, 6), "default_12": hit(["Default"], 12), "prepay_12": hit(["Prepaid"], 12),
            "next_state": F.coalesce(F.lead("current_status").over(per("loan_id", by=BY_INDEX)), F.col("current_status")),
        }
    )


def mature_label_mask(df: DataFrame, horizon: int) -> DataFrame:
    """Rows whose outcome over ``horizon`` months can be known."""
    last = df.agg(F.add_months(F.max("reporting_month"), -horizon).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where("reporting_month <= _last").drop("_last")


def months_of(df: DataFrame) -> list:
    """The distinct months, in order, as dates; one row for each month of the panel comes to the driver."""
    months = df.where("reporting_month IS NOT NULL").select(F.col("reporting_month").cast("date").alias("m")).distinct().orderBy("m")
    return [r[0] for r in months.collect()]


def split_months(months: list, horizon: int, test_fraction: float = 0.2) -> tuple:
    """(end of training, start of the test) for the distinct months of a panel.

    The cut leaves room for a share of the months to test on and for the purge; a panel too short for both
    is tested on what is left behind the purge. The test begins by the calendar, whatever months are missing.
    """
    if len(months) < 3:
        raise ValueError("at least three months are needed")
    at = len(months) - max(1, round(len(months) * test_fraction)) - horizon - 1
    if at < 1:
        at = max(0, len(months) - horizon - 2)
    return months[at], add_months(months[at], horizon + 1)


def add_months(day: datetime.date, n: int) -> datetime.date:
    """The same day ``n`` months on, or that month's last."""
    at = day.year * 12 + day.month - 1 + n
    year, month = at // 12, at % 12 + 1
    return datetime.date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def time_aware_split(df: DataFrame, horizon: int, test_fraction: float = 0.2) -> DataFrame:
    """Column ``part``: train up to a cut, purged for ``horizon`` months, then test; rows without a month are purged."""
    cut, test = split_months(months_of(df), horizon, test_fraction)
    part = F.when(F.col("reporting_month") <= F.lit(cut), "train").when(F.col("reporting_month") >= F.lit(test), "test").otherwise("purged")
    return df.withColumn("part", part)


def walk_forward_folds(df: DataFrame, n_folds: int = 4, horizon: int = 3, least_train: int = 12) -> DataFrame:
    """(fold, train_end, test_start, test_end) of expanding, purged windows; the first one trains on ``least_train`` months
    and its own. A panel too short for that raises; folds without a month to test on are left out."""
    months = months_of(df)
    if len(months) < least_train + n_folds + horizon:
        raise ValueError(f"{len(months)} months are too few for {n_folds} folds after {least_train} months and a purge of {horizon}")
    step = max(1, (len(months) - least_train - horizon) // n_folds)
    rows = []
    for k in range(n_folds):
        at = least_train + k * step
        if at >= len(months) - horizon - 1:
            break
        start, end = add_months(months[at], horizon + 1), add_months(months[at], horizon + step)
        if any(start <= m <= end for m in months):
            rows.append((k + 1, months[at], start, end))
    return df.sparkSession.createDataFrame(rows, "fold int, train_end date, test_start date, test_end date")


def held_out(pct: int):
    """Loans set aside by a hash of their id: about ``pct`` in a hundred, the same ones in every run."""
    return F.conv(F.substring(F.md5(F.col("loan_id").cast("string")), 1, 8), 16, 10).cast("long") % 100 < pct


def group_disjoint_split(df: DataFrame, horizon: int = 3, held_pct: int = 30, test_fraction: float = 0.2) -> DataFrame:
    """As time_aware_split, with held-out loans: only they are tested, and they are never trained on."""
    held = F.coalesce(held_out(held_pct), F.lit(False))
    out = time_aware_split(df, horizon, test_fraction)
    keep = ((F.col("part") == "train") & ~held) | ((F.col("part") == "test") & held)
    return out.withColumn("part", F.when(keep, F.col("part")).otherwise("purged"))


def random_group_split(df: DataFrame, test_pct: int = 25) -> DataFrame:
    """Loan-disjoint and blind to time; a diagnostic."""
    return df.withColumn("part", F.when(F.coalesce(held_out(test_pct), F.lit(False)), "test").otherwise("train"))


def scoring_frame(train: DataFrame, score: DataFrame, prepare, static: DataFrame | None = None) -> DataFrame:
    """The score rows with everything that ``prepare`` adds, worked out over both panels, with the columns of ``static`` that
    they lack joined by loan first.

    A score row's history reaches back into the training rows of its loan; ``prepare`` maps a panel to
    one with flags, quality and features. Rows keep score_order, the order to write them in.
    """
    from panelworks.operators.reconcile import attach_static, union_panels

    both = union_panels(train, score)
    return prepare(both if static is None else attach_static(both, static)).where("origin = 'score'").drop("origin")
