"""State transitions, empirical matrices, scenario projection and survival curves."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.functions.columns import BY_MONTH, clip, per
from panelworks.operators.metrics import auc_by_group, classification_report, reliability_bins, roc_auc, score_table
from panelworks.schema import ABSORBING, DELINQUENT, SEVERITY, STATES
from panelworks.session import checkpoint

# Age buckets in months; ages beyond use the matrix of all ages.
AGE_BUCKETS = [(0, 12), (12, 24), (24, 36), (36, 60), (60, 999)]
LAPLACE = 0.5


def age_bucket(age: Column) -> Column:
    out = F.lit(-1)
    for i, (lo, hi) in enumerate(AGE_BUCKETS):
        out = F.when((age >= lo) & (age < hi), i).otherwise(out)
    return out


def transition_frame(panel: DataFrame) -> DataFrame:
    """Rows whose loan has a row in the next month, with its state as ``to_state``."""
    w = per("loan_id", by=BY_MONTH)
    to, month = F.lead("current_status").over(w), F.lead("reporting_month").over(w)
    gap = (F.year("_next") - F.year("reporting_month")) * 12 + F.month("_next") - F.month("reporting_month")
    return panel.withColumns({"to_state": to, "_next": month}).where(F.col("to_state").isNotNull() & (gap == 1)).drop("_next").withColumnRenamed("current_status", "from_state")


def transition_losses(panel: DataFrame) -> DataFrame:
    """(n_rows, n_without_successor, n_gaps, n_kept), and n_disagree where the panel has a next_state of its own: kept rows whose
    next row is in another state than that says."""
    w = per("loan_id", by=BY_MONTH)
    shipped = "next_state" in panel.columns
    rows = panel.select("reporting_month", F.lead("reporting_month").over(w).alias("_next"), F.lead("current_status").over(w).alias("_to"), *["next_state"] * shipped)
    gap = (F.year("_next") - F.year("reporting_month")) * 12 + F.month("_next") - F.month("reporting_month")
    n = lambda c: F.sum(c.cast("long"))
    return rows.agg(F.count("*").alias("n_rows"), n(F.col("_next").isNull()).alias("n_without_successor"), n((gap != 1) & F.col("_next").isNotNull()).alias("n_gaps"), n(F.coalesce(gap == 1, F.lit(False))).alias("n_kept"),
                    *[n(F.coalesce((gap == 1) & (F.col("next_state") != F.col("_to")), F.lit(False))).alias("n_disagree")] * shipped)


def _spine(spark) -> DataFrame:
    cells = [(a, i, b, j) for (i, a), (j, b) in itertools.product(enumerate(STATES), repeat=2)]
    return spark.createDataFrame(cells, "from_state string, i int, to_state string, j int")


def transition_counts(frame: DataFrame) -> DataFrame:
    """(from_state, to_state, n, rate) of all 36 cells."""
    counts = frame.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    out = _spine(frame.sparkSession).join(counts, ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy("from_state"))
    return out.select("from_state", "to_state", "n", F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("rate"))


def empirical_matrix(frame: DataFrame) -> DataFrame:
    """(bucket, from_state, to_state, p): smoothed rates of each age bucket, and of all ages as -1."""
    rows = frame.select(F.explode(F.array_distinct(F.array(age_bucket(F.col("loan_age_months")), F.lit(-1)))).alias("bucket"), "from_state", "to_state")
    counts = rows.groupBy("bucket", "from_state", "to_state").agg(F.count("*").alias("n"))
    buckets = frame.sparkSession.createDataFrame([(b,) for b in range(-1, len(AGE_BUCKETS))], "bucket int")
    cells = _spine(frame.sparkSession).crossJoin(buckets).join(counts, ["bucket", "from_state", "to_state"], "left")
    absorbing = F.col("from_state").isin(ABSORBING)
    weight = F.coalesce(F.col("n"), F.lit(0)) + LAPLACE
    p = F.when(absorbing, (F.col("i") == F.col("j")).cast("double")).otherwise(weight / F.sum(weight).over(W.partitionBy("bucket", "from_state")))
    return cells.select("bucket", "from_state", "to_state", "i", "j", p.alias("p"))


def matrix_column(cells: DataFrame) -> DataFrame:
    """(bucket, m): the matrix of each bucket as an array of rows."""
    rows = cells.groupBy("bucket", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "p"))), lambda c: c["p"]).alias("row"))
    return rows.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("m"))


def _stress_kinds() -> list[list[int]]:
    """Which multiplier a cell takes: 0 none, 1 delinquency, 2 default, 3 prepayment."""
    kind = lambda s, t: 0 if s == t or s in ABSORBING else 3 if t == "Prepaid" else 2 if t == "Default" else int(SEVERITY[t] > SEVERITY[s])
    return [[kind(s, t) for t in STATES] for s in STATES]


def stressed(m: Column, default: Column, delinq: Column, prepay: Column) -> Column:
    """A matrix under scenario multipliers: scaled targets, the rest from the stay cell, renormalised.

    Array functions throughout, so the expression stays short whatever the number of states.
    """
    kinds = F.array(*[F.array(*[F.lit(k) for k in row]) for row in _stress_kinds()])
    mults = F.array(F.lit(1.0), delinq, default, prepay)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def stress(row: Column, i: Column) -> Column:
        scaled = F.zip_with(row, F.get(kinds, i), lambda c, k: c * F.get(mults, k))
        stay = F.get(row, i) - total(F.zip_with(scaled, row, lambda a, b: a - b))
        kept = F.transform(scaled, lambda c, j: F.greatest(F.when(j == i, stay).otherwise(c), F.lit(0.0)))
        # The sum is taken once: an array of one array carries it on.
        return F.get(F.transform(F.array(kept), lambda k: F.transform(k, lambda c: c / F.coalesce(F.nullif(total(k), F.lit(0.0)), F.lit(1.0)))), 0)

    absorbing = F.array(*[F.lit(s in ABSORBING) for s in STATES])
    neutral = (default == 1.0) & (delinq == 1.0) & (prepay == 1.0)
    return F.when(neutral, m).otherwise(F.transform(m, lambda row, i: F.when(F.get(absorbing, i), row).otherwise(stress(row, i))))


def scenario_matrices(cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, bucket, m): six matrices for each scenario, a table of fixed size."""
    out = matrix_column(cells).crossJoin(F.broadcast(scenarios))
    return out.select("scenario", "bucket", stressed(F.col("m"), F.col("default_mult"), F.col("delinq_mult"), F.col("prepay_mult")).alias("m"))


def simulate_paths(loans: DataFrame, cells: DataFrame, scenarios: DataFrame, horizon: int = 12) -> DataFrame:
    """(row keys, scenario, month, p): state probabilities of each loan for months 0..horizon.

    A step multiplies the distribution by the matrix of the loan's age bucket at that time. Paths depend
    on start state and age only, so one path is worked out for each distinct pair and joined back.
    """
    start = F.when(F.col("current_status").isin(STATES), F.col("current_status")).otherwise("Current")
    keyed = loans.withColumns({"_start": start, "_age": F.col("loan_age_months")})
    kinds = keyed.select("_start", "_age").distinct()
    tables = scenario_matrices(cells, scenarios).groupBy("scenario").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "m"))), lambda x: x["m"]).alias("ms")
    )  # position 0 holds the matrix of all ages
    paths = kinds.crossJoin(F.broadcast(tables))
    one_hot = F.array(*[(F.col("_start") == s).cast("double") for s in STATES])
    paths = paths.withColumn("_p0", one_hot)
    # One expression carries the curve so far; each step appends the last distribution times a matrix.
    def step(curve: Column, h: Column) -> Column:
        m = F.get("ms", age_bucket(F.col("_age") + h) + 1)
        flows = F.zip_with(F.element_at(curve, -1), m, lambda q, row: F.transform(row, lambda c: c * q))
        zero = F.array(*[F.lit(0.0) for _ in STATES])
        return F.concat(curve, F.array(F.aggregate(flows, zero, lambda acc, f: F.zip_with(acc, f, lambda x, y: x + y))))

    curve = F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), F.array(F.col("_p0")), step)
    paths = paths.select("_start", "_age", "scenario", F.posexplode(curve).alias("month", "p"))
    return keyed.join(paths, ["_start", "_age"]).drop("_start", "_age")


def project_balance_ratio(ahead: Column) -> Column:
    """balance_ratio ``ahead`` months on under level payments: scaled by the scheduled balances then and now."""
    grow, age = 1 + F.col("interest_rate") / 1200, F.col("loan_age_months")
    whole = F.pow(grow, age + F.col("remaining_term_months"))
    left = lambda months: (whole - F.pow(grow, months)) / F.nullif(whole - 1, F.lit(0.0))
    scale = F.coalesce(F.when(left(age) > 1e-9, F.nanvl(left(age + ahead) / left(age), F.lit(None).cast("double"))), F.lit(1.0))
    ratio = clip(F.col("balance_ratio") * F.least(F.greatest(scale, F.lit(0.0)), F.lit(1.0)), 0, 2)
    return F.when(ahead == 0, F.col("balance_ratio")).otherwise(ratio)


def advance_covariates(df: DataFrame, ahead: Column) -> DataFrame:
    """Rows ``ahead`` months on: older, fewer months left, scheduled balance; all else as last seen."""
    moved = {}
    if {"balance_ratio", "interest_rate", "loan_age_months", "remaining_term_months"} <= set(df.columns):
        moved["balance_ratio"] = project_balance_ratio(ahead)
    if "loan_age_months" in df.columns:
        moved["loan_age_months"] = F.col("loan_age_months") + ahead
    if "remaining_term_months" in df.columns:
        moved["remaining_term_months"] = F.greatest(F.col("remaining_term_months") - ahead, F.lit(0))
    return df.withColumns(moved)


def fold_paths(steps: DataFrame, horizon: int) -> DataFrame:
    """(row_id, scenario, month, p): paths from a matrix for each row, scenario and step.

    ``steps`` has row_id, scenario, start (a state), h (0 to horizon - 1) and m (6 by 6). A row's matrices meet
    once, ``horizon`` of them, and are multiplied in order.
    """
    named = F.array(*[F.lit(s) for s in STATES])
    rows = steps.groupBy("row_id", "scenario").agg(F.first("start").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("h", "m"))), lambda x: x["m"]).alias("ms"))
    one_hot = F.transform(named, lambda s: (s == F.when(F.array_contains(named, F.col("start")), F.col("start")).otherwise("Current")).cast("double"))

    def step(curve: Column, m: Column) -> Column:
        flows = F.zip_with(F.element_at(curve, -1), m, lambda q, row: F.transform(row, lambda c: c * q))
        zero = F.array(*[F.lit(0.0) for _ in STATES])
        return F.concat(curve, F.array(F.aggregate(flows, zero, lambda acc, f: F.zip_with(acc, f, lambda x, y: x + y))))

    return rows.select("row_id", "scenario", F.posexplode(F.aggregate("ms", F.array(one_hot), step)).alias("month", "p"))


def portfolio_curves(paths: DataFrame, weight: str | None = None) -> DataFrame:
    """(scenario, month, cif_default, cif_prepaid, share_dpd), means over loans or means by ``weight``."""
    at = lambda s: F.col("p")[STATES.index(s)]
    late = at(DELINQUENT[0]) + at(DELINQUENT[1]) + at(DELINQUENT[2])
    mean = (lambda x: F.sum(x * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))) if weight else F.avg
    return paths.groupBy("scenario", "month").agg(mean(at("Default")).alias("cif_default"), mean(at("Prepaid")).alias("cif_prepaid"), mean(late).alias("share_dpd"))


def state_share_curve(paths: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(s) for s in STATES])
    return paths.select("scenario", "month", F.posexplode("p").alias("i", "q")).groupBy("scenario", "month", F.get(names, F.col("i")).alias("state")).agg(F.avg("q").alias("mean_share"))


def segment_impacts(paths: DataFrame, segments: list[str], month: int = 12) -> DataFrame:
    """(segment_type, segment, scenario, n, mean_default, mean_prepaid) at the last month."""
    ends = paths.where(F.col("month") == month).select("scenario", F.col("p")[4].alias("d"), F.col("p")[5].alias("q"), F.explode(F.array(*[F.struct(F.lit(s).alias("segment_type"), F.col(s).cast("string").alias("segment")) for s in segments])).alias("g"))
    return ends.where("g.segment IS NOT NULL").groupBy("g.segment_type", "g.segment", "scenario").agg(F.count("*").alias("n"), F.avg("d").alias("mean_default"), F.avg("q").alias("mean_prepaid"))


def segment_uplift(impacts: DataFrame, least: int = 50, top: int = 12) -> DataFrame:
    """The segments that the adverse scenario hurts most, in percentage points."""
    wide = impacts.groupBy("segment_type", "segment", "n").pivot("scenario", ["base", "adverse_credit"]).agg(F.first("mean_default"))
    return wide.where(F.col("n") >= least).select("segment_type", "segment", "n", (100 * (F.col("adverse_credit") - F.col("base"))).alias("uplift_pp")).orderBy(F.desc("uplift_pp"), "segment_type", "segment").limit(top)


def scenario_deltas(curves: DataFrame, month: int = 12) -> DataFrame:
    ends = curves.where(F.col("month") == month)
    base = ends.where("scenario = 'base'").select(F.col("cif_default").alias("b"), F.col("cif_prepaid").alias("q"))
    return ends.crossJoin(F.broadcast(base)).select("scenario", (F.col("cif_default") - F.col("b")).alias("default_delta"), (F.col("cif_prepaid") - F.col("q")).alias("prepaid_delta"))


def time_to_event(panel: DataFrame) -> DataFrame:
    """(loan_id, duration, event): age at the first absorbing row (1 Default, 2 Prepaid), else last age (0)."""
    order = F.struct("reporting_month", "row_id")
    done = F.col("current_status").isin(ABSORBING)
    event = F.min_by(F.when(F.col("current_status") == "Default", 1).otherwise(2), F.when(done, order))
    age = F.coalesce(F.min_by("loan_age_months", F.when(done, order)), F.max_by("loan_age_months", order))
    return panel.groupBy("loan_id").agg(F.greatest(age, F.lit(1)).alias("duration"), F.coalesce(event, F.lit(0)).alias("event"))


def _event_table(events: DataFrame) -> DataFrame:
    """(duration, d1, d2, at_risk); a table of durations, small whatever the loans."""
    counts = events.groupBy("duration").agg(F.sum((F.col("event") == 1).cast("long")).alias("d1"), F.sum((F.col("event") == 2).cast("long")).alias("d2"), F.count("*").alias("n"))
    return counts.select("duration", "d1", "d2", F.sum("n").over(W.orderBy(F.desc("duration"))).alias("at_risk"))


def _running_product(x: Column) -> Column:
    w = W.orderBy("duration").rowsBetween(W.unboundedPreceding, 0)
    return F.when(F.min(x).over(w) <= 0, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(x > 0, x))).over(w)))


def kaplan_meier(events: DataFrame) -> DataFrame:
    """(duration, one_minus_km): default with prepayment as censoring, which overstates it."""
    return _event_table(events).select("duration", (1 - _running_product(1 - F.col("d1") / F.col("at_risk"))).alias("one_minus_km"))


def aalen_johansen(events: DataFrame) -> DataFrame:
    """(duration, cif_default, one_minus_km): cumulative incidence with both risks, ties exact."""
    table = _event_table(events)
    table = table.withColumns({"s": _running_product(1 - (F.col("d1") + F.col("d2")) / F.col("at_risk")), "one_minus_km": 1 - _running_product(1 - F.col("d1") / F.col("at_risk"))})
    before = F.coalesce(F.lag("s").over(W.orderBy("duration")), F.lit(1.0))
    cif = table.withColumn("_step", before * F.col("d1") / F.col("at_risk"))
    return cif.select("duration", F.sum("_step").over(W.orderBy("duration").rowsBetween(W.unboundedPreceding, 0)).alias("cif_default"), "one_minus_km")


def one_step_scores(frame: DataFrame, cells: DataFrame) -> DataFrame:
    """The transition frame with p: the empirical probabilities of the next state."""
    return frame.withColumn("_b", age_bucket(F.col("loan_age_months"))).join(F.broadcast(matrix_column(cells).withColumnRenamed("bucket", "_b")), "_b").withColumn(
        "p", F.get("m", F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("from_state")).cast("int") - 1)
    ).drop("m", "_b")


def log_loss_multiclass(scored: DataFrame, label: str = "to_state", p: str = "p") -> DataFrame:
    states = F.array(*[F.lit(s) for s in STATES])
    hit = F.try_element_at(p, F.array_position(states, F.col(label)).cast("int"))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(1e-12)))
    return scored.agg(F.count("*").alias("n"), F.avg(-F.ln(F.greatest(hit, F.lit(1e-12)) / total)).alias("log_loss"))


def score_next_state(scored: DataFrame, p: str = "p") -> DataFrame:
    """next_state_pred and next_state_confidence; ties go to the earlier state."""
    best = F.array_max(p)
    return scored.withColumns({"next_state_confidence": best, "next_state_pred": F.get(F.array(*[F.lit(s) for s in STATES]), F.array_position(p, best).cast("int") - 1)})


def evaluate_one_step(scored: DataFrame, label: str = "to_state", p: str = "p") -> DataFrame:
    """(metric, value): n, log_loss, accuracy, macro_f1, and auc_<state> of each state against the rest.

    A state that does not come, or that alone comes, has no AUC.
    """
    scored = checkpoint(scored.select(label, p))
    loss = log_loss_multiclass(scored, label, p).selectExpr("stack(2, 'n', CAST(n AS DOUBLE), 'log_loss', log_loss) AS (metric, value)")
    hard = classification_report(score_next_state(scored, p), label, "next_state_pred").selectExpr("stack(2, 'accuracy', accuracy, 'macro_f1', macro_f1) AS (metric, value)")
    cells = F.array(*[F.struct(F.lit(s).alias("g"), (F.col(label) == s).cast("int").alias("y"), F.col(p)[i].alias("s")) for i, s in enumerate(STATES)])
    auc = auc_by_group(scored.select(F.explode(cells).alias("c")).select("c.*")).where("roc_auc IS NOT NULL")
    return loss.unionByName(hard).unionByName(auc.select(F.concat(F.lit("auc_"), "g").alias("metric"), F.col("roc_auc").alias("value")))


def compare_to_baseline(scored: DataFrame, model: str, baseline: str, label: str = "to_state") -> DataFrame:
    """(metric, baseline, model, delta) of two columns of probabilities."""
    one, other = evaluate_one_step(scored, label, baseline), evaluate_one_step(scored, label, model)
    both = one.select("metric", F.col("value").alias("baseline")).join(other.select("metric", F.col("value").alias("model")), "metric", "full")
    return both.withColumn("delta", F.col("model") - F.col("baseline"))


def horizon_crosscheck(scored: DataFrame, label: str, p: str) -> tuple[DataFrame, DataFrame]:
    """Chain-implied probabilities against a label that the chain never saw.

    The first table is (n, observed_rate, predicted_rate, brier, roc_auc), the second ten bins of equal counts.
    """
    y, q = F.col(label).cast("double"), F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    rows = checkpoint(scored.where(F.col(label).isNotNull() & F.col(p).isNotNull()).select("row_id", F.col(label), q.alias(p)))
    flat = rows.agg(F.count("*").alias("n"), F.avg(y).alias("observed_rate"), F.avg(p).alias("predicted_rate"), F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"))
    return flat.crossJoin(roc_auc(score_table(rows, label, p))), reliability_bins(rows, label, p)


def credibility_blend(scored: DataFrame, p: str = "p_model", q: str = "p_empirical") -> DataFrame:
    """(from_state, alpha, log_loss): the model's weight in each origin state by held-out log-loss.

    Both columns hold the probability of the state that came. Under 30 rows the weight is 0.
    """
    grid = F.array(*[F.lit(a) for a in (0.0, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0)])
    rows = scored.select("from_state", F.col(p).alias("a"), F.col(q).alias("b"), F.explode(grid).alias("alpha"))
    mixed = F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b")
    losses = rows.groupBy("from_state", "alpha").agg(F.count("*").alias("n"), F.avg(-F.ln(F.greatest(mixed, F.lit(1e-12)))).alias("log_loss"))
    best = losses.groupBy("from_state").agg(F.max("n").alias("n"), F.min(F.struct("log_loss", "alpha")).alias("best"))
    return best.select("from_state", "n", F.when(F.col("n") < 30, 0.0).otherwise(F.col("best.alpha")).alias("alpha"))
