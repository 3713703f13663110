"""Registered queries over the loan panel, each beside the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.functions.columns import printed
from panelworks.operators import features as feat
from panelworks.operators import metrics as met
from panelworks.operators import quality as qual
from panelworks.operators import reconcile as rec
from panelworks.operators import rules as rul
from panelworks.operators import scoring as sco
from panelworks.operators import text as txt
from panelworks.operators import transitions as tra
from panelworks.plans import testpanel as tp
from panelworks.schema import EXCEPTION_LABELS, FEATURE_LABELS, RULE_LABELS, STATES
from panelworks.session import checkpoint, prepare, shared_dir, table, written
from panelworks.sources import audit_log, pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STATE_LIST = "['Current', '30DPD', '60DPD', '90DPD', 'Default', 'Prepaid']"
RULES = list(rul.REGISTRY)

#: Common table expressions, each with those it stands on.
CTES = {
    "panel": ([], tp.PANEL),
    "feed": (["panel"], tp.FEED),
    "static": ([], tp.STATIC),
    "sv": (["feed"], "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY loan_id, reporting_month ORDER BY seq DESC) AS rn FROM feed) WHERE rn = 1"),
    "rec": (["panel", "sv"], """
SELECT p.*, s.seq IS NOT NULL AS has_servicer_record,
  coalesce(abs(s.current_balance - p.current_balance) / nullif(p.current_balance, 0) > 0.01, false) AS balance_conflict,
  coalesce(abs(s.current_balance - p.current_balance) / nullif(p.current_balance, 0), 0) AS balance_rel_diff,
  s.seq IS NOT NULL AND s.current_status IS DISTINCT FROM p.current_status AS current_status_conflict,
  s.seq IS NOT NULL AND s.days_past_due IS DISTINCT FROM p.days_past_due AS days_past_due_conflict,
  coalesce(date_diff('day', p.reporting_month, s.last_updated_at), 0) AS servicer_update_lag_days,
  coalesce(date_diff('day', p.reporting_month, s.last_updated_at) > 45 OR date_diff('day', p.reporting_month, s.last_updated_at) < 0, false) AS source_stale,
  coalesce(date_diff('day', p.reporting_month, p.last_updated_at), 0) AS panel_update_lag_days,
  balance_conflict OR current_status_conflict OR days_past_due_conflict AS source_conflict
FROM panel p LEFT JOIN sv s ON s.loan_id = p.loan_id AND s.reporting_month = p.reporting_month"""),
    "flags": (["rec"], """
SELECT *, CASE WHEN current_status IN ('Default', 'Prepaid') AND document_status = 'Missing' THEN 'document_gap'
    WHEN (current_status = 'Current' AND days_past_due > 0) OR (current_status = '90DPD' AND days_past_due < 60) THEN 'delinquency_inconsistency' ELSE 'none' END AS exception_type,
  CASE WHEN exception_type <> 'none' THEN 1 ELSE 0 END AS exception_required,
  coalesce(current_balance > lag(current_balance) OVER w, false) AND modification_flag <> 1 AS balance_non_increasing,
  reporting_month < origination_month AS date_order_valid,
  NOT (days_past_due BETWEEN CASE current_status WHEN '30DPD' THEN 30 WHEN '60DPD' THEN 60 WHEN '90DPD' THEN 90 WHEN 'Default' THEN 90 ELSE 0 END
    AND CASE current_status WHEN 'Current' THEN 0 WHEN 'Prepaid' THEN 0 WHEN '30DPD' THEN 59 WHEN '60DPD' THEN 89 ELSE 10000 END) AS dpd_status_consistency,
  current_status NOT IN ('Default', 'Prepaid') AND coalesce(max(CASE WHEN current_status IN ('Default', 'Prepaid') THEN 1 ELSE 0 END)
    OVER (PARTITION BY loan_id ORDER BY month_index, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS terminal_state_immutability,
  current_status IN ('Default', 'Prepaid') AND (document_status IS NULL OR document_status = 'Missing') AS document_completeness_at_closure,
  source_conflict AS servicer_source_agreement,
  current_balance > original_balance * 1.0001 AND modification_flag <> 1 AS balance_within_original,
  date_diff('day', reporting_month, last_updated_at) > 45 OR date_diff('day', reporting_month, last_updated_at) < 0 AS stale_record
FROM rec WINDOW w AS (PARTITION BY loan_id ORDER BY month_index, row_id)"""),
    "ruled": (["flags"], f"""
SELECT *, {' + '.join(f'CAST({r} AS INT)' for r in RULES)} AS rule_violation_count, {' OR '.join(RULES)} AS any_violation,
  {' + '.join(f'CAST({r} AS INT) * {rul.WEIGHTS[rul.SEVERITIES[r]]}' for r in RULES)} AS rule_severity_score,
  {' OR '.join(r for r in RULES if r not in rul.ADVISORY)} AS covered,
  CASE {' '.join(f"WHEN {r} THEN '{t}'" for r, t in rul.TARGETS.items())} ELSE 'none' END AS assigned,
  CAST(row_id % 1000 AS DOUBLE) / 1000 AS anomaly_score,
  CASE WHEN row_id % 3 = 0 THEN CAST((row_id * 7) % 1000 AS DOUBLE) / 1000 END AS residual_prob
FROM flags"""),
    "med": (["ruled"], "SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{c}" for c in qual.OUTLIER_COLUMNS) + " FROM ruled"),
    "mad": (["ruled", "med"], "SELECT " + ", ".join(f"quantile_cont(abs({c} - med_{c}), 0.5) AS mad_{c}" for c in qual.OUTLIER_COLUMNS) + " FROM ruled, med"),
    "scored": (["ruled", "med", "mad"], f"""
SELECT ruled.*, ({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in qual.KEY_COLUMNS)}) / 6.0::DOUBLE AS completeness,
  ({' + '.join(f'CAST(coalesce(abs({c} - med_{c}) / nullif(mad_{c}, 0) > 5, false) AS INT)' for c in qual.OUTLIER_COLUMNS)}) / 5.0::DOUBLE AS outlyingness,
  least(rule_severity_score::DOUBLE * 15, 60.0::DOUBLE) AS rule_penalty, CAST(source_conflict AS INT) * 10.0::DOUBLE AS conflict_penalty, CAST(source_stale AS INT) * 5.0::DOUBLE AS stale_penalty,
  least(greatest(100 - (1 - completeness) * 25 - outlyingness * 20 - rule_penalty - conflict_penalty - stale_penalty, 0), 100) AS data_quality_score
FROM ruled, med, mad"""),
    "amort": (["panel"], """
SELECT *, least(greatest(current_balance / nullif(original_balance, 0), 0), 2) AS balance_ratio,
  loan_age_months + remaining_term_months AS term,
  least(greatest(loan_age_months::DOUBLE / nullif(term, 0), 0), 1) AS term_progress,
  least(greatest((pow(1 + interest_rate / 1200, term) - pow(1 + interest_rate / 1200, loan_age_months)) / nullif(pow(1 + interest_rate / 1200, term) - 1, 0), 0), 1) AS scheduled_balance_ratio,
  balance_ratio - scheduled_balance_ratio AS amortisation_gap
FROM panel"""),
    "rates": (["panel"], """
SELECT month, avg(rate) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS market_rate FROM (
  SELECT origination_month AS month, avg(interest_rate) AS rate FROM (
    SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY reporting_month, row_id) AS rn FROM panel) WHERE rn = 1 GROUP BY 1)"""),
    "rated": (["panel", "rates"], """
SELECT *, interest_rate - market_rate AS rate_incentive FROM (
  SELECT p.*, coalesce(r.market_rate, (SELECT min_by(market_rate, month) FROM rates)) AS market_rate FROM panel p ASOF LEFT JOIN rates r ON p.reporting_month >= r.month)"""),
    "hist": (["amort"], """
SELECT *, sum(late) OVER (PARTITION BY loan_id, episode ORDER BY reporting_month, row_id) AS delinquency_streak, CAST(months_delinquent_to_date > 0 AS INT) AS ever_delinquent,
  sum(changed) OVER (PARTITION BY loan_id ORDER BY reporting_month, row_id) AS n_status_changes_to_date FROM (
  SELECT *, CASE WHEN current_status IN ('30DPD', '60DPD', '90DPD') THEN 1 ELSE 0 END AS late,
    sum(late) OVER w AS months_delinquent_to_date, max(days_past_due) OVER w AS max_dpd_to_date, coalesce(max(modification_flag) OVER w, 0) AS ever_modified,
    sum(1 - late) OVER w AS episode, balance_ratio - lag(balance_ratio, 3) OVER w AS balance_change_3m,
    CASE WHEN current_status <> lag(current_status) OVER w THEN 1 ELSE 0 END AS changed
  FROM amort WINDOW w AS (PARTITION BY loan_id ORDER BY reporting_month, row_id))"""),
    "labels12": (["panel"], """
SELECT *, coalesce(max(bad) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS delinq_3, coalesce(max(bad) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) AS delinq_6,
  coalesce(max(d) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), 0) AS default_12, coalesce(max(q) OVER (w ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), 0) AS prepay_12,
  coalesce(lead(current_status) OVER (w), current_status) AS next_state
FROM (SELECT *, CASE WHEN current_status IN ('30DPD', '60DPD', '90DPD', 'Default') THEN 1 ELSE 0 END AS bad, CASE WHEN current_status = 'Default' THEN 1 ELSE 0 END AS d, CASE WHEN current_status = 'Prepaid' THEN 1 ELSE 0 END AS q FROM panel)
WINDOW w AS (PARTITION BY loan_id ORDER BY month_index, row_id)"""),
    "marked": (["labels12"], "SELECT *, CAST((row_id * 7 + delinq_3 * 300) % 1000 AS DOUBLE) / 1000 AS p FROM labels12"),
    "trans": (["panel"], """
SELECT * EXCLUDE (nx), current_status AS from_state FROM (
  SELECT *, lead(current_status) OVER w AS to_state, lead(reporting_month) OVER w AS nx FROM panel WINDOW w AS (PARTITION BY loan_id ORDER BY reporting_month, row_id))
WHERE to_state IS NOT NULL AND (year(nx) - year(reporting_month)) * 12 + month(nx) - month(reporting_month) = 1"""),
    "spine": ([], f"SELECT s[i] AS from_state, i, s[j] AS to_state, j FROM (SELECT {STATE_LIST} AS s, unnest(range(1, 7)) AS i), (SELECT unnest(range(1, 7)) AS j)"),
    "cells": (["trans", "spine"], """
SELECT x.b AS bucket, sp.from_state, sp.to_state, sp.i, sp.j,
  CASE WHEN sp.from_state IN ('Default', 'Prepaid') THEN CASE WHEN sp.i = sp.j THEN 1.0::DOUBLE ELSE 0 END
    ELSE (coalesce(c.n, 0) + 0.5::DOUBLE) / sum(coalesce(c.n, 0) + 0.5::DOUBLE) OVER (PARTITION BY x.b, sp.from_state) END AS p
FROM spine sp CROSS JOIN (SELECT CAST(unnest(range(-1, 5)) AS INT) AS b) x
LEFT JOIN (SELECT bucket, from_state, to_state, count(*) AS n FROM (
    SELECT -1 AS bucket, from_state, to_state FROM trans UNION ALL
    SELECT CASE WHEN loan_age_months < 12 THEN 0 WHEN loan_age_months < 24 THEN 1 WHEN loan_age_months < 36 THEN 2 WHEN loan_age_months < 60 THEN 3 ELSE 4 END, from_state, to_state FROM trans
    WHERE loan_age_months >= 0 AND loan_age_months < 999) GROUP BY ALL) c
  ON c.bucket = x.b AND c.from_state = sp.from_state AND c.to_state = sp.to_state"""),
    "latest": (["panel"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY month_index DESC, row_id DESC) AS rn FROM panel) WHERE rn = 1 AND current_status NOT IN ('Default', 'Prepaid')"),
    "scen": ([], "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {d}::DOUBLE, {q}::DOUBLE, {p}::DOUBLE)" for n, d, q, p in tp.SCENARIOS) + ") v(scenario, default_mult, delinq_mult, prepay_mult)"),
    "stress": (["cells", "scen"], """
SELECT scenario, bucket, i, j, CASE WHEN neutral THEN p ELSE kept / nullif(sum(kept) OVER r, 0) END AS p FROM (
  SELECT *, CASE WHEN i <> j THEN greatest(np, 0) ELSE greatest(p - sum(CASE WHEN i <> j THEN np - p ELSE 0 END) OVER r, 0) END AS kept FROM (
    SELECT c.*, s.scenario, default_mult = 1 AND delinq_mult = 1 AND prepay_mult = 1 AS neutral,
      p * CASE WHEN i = j OR i IN (5, 6) THEN 1 WHEN j = 6 THEN prepay_mult WHEN j = 5 THEN default_mult WHEN j > i THEN delinq_mult ELSE 1 END AS np
    FROM cells c, scen s) WINDOW r AS (PARTITION BY scenario, bucket, i))
WINDOW r AS (PARTITION BY scenario, bucket, i)"""),
    "ends": (["panel"], """
SELECT loan_id, greatest(coalesce(min_by(loan_age_months, (reporting_month, row_id)) FILTER (WHERE current_status IN ('Default', 'Prepaid')), max_by(loan_age_months, (reporting_month, row_id))), 1) AS duration,
  coalesce(min_by(CASE WHEN current_status = 'Default' THEN 1 ELSE 2 END, (reporting_month, row_id)) FILTER (WHERE current_status IN ('Default', 'Prepaid')), 0) AS event
FROM panel GROUP BY loan_id"""),
    "risk": (["ends"], """
SELECT duration, d1, d2, sum(n) OVER (ORDER BY duration DESC) AS at_risk FROM (
  SELECT duration, sum(CAST(event = 1 AS INT)) AS d1, sum(CAST(event = 2 AS INT)) AS d2, count(*) AS n FROM ends GROUP BY duration)"""),
    "surv": (["risk"], """
SELECT duration, d1, at_risk, CASE WHEN min(a) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN a > 0 THEN ln(a) END) OVER w) END AS s_all,
  CASE WHEN min(b) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN b > 0 THEN ln(b) END) OVER w) END AS s_one
FROM (SELECT *, 1 - (d1 + d2) / at_risk::DOUBLE AS a, 1 - d1 / at_risk::DOUBLE AS b FROM risk) WINDOW w AS (ORDER BY duration)"""),
    "sub": (["ruled", "marked"], """
SELECT r.loan_id, strftime(r.reporting_month, '%Y-%m-%d') AS reporting_month, m.p AS next_3m_delinquency_prob, CAST((r.row_id * 11) % 997 AS DOUBLE) / 997 AS next_6m_delinquency_prob,
  CAST((r.row_id * 13) % 991 AS DOUBLE) / 9910 AS next_12m_default_prob, CAST((r.row_id * 17) % 983 AS DOUBLE) / 983 AS next_12m_prepayment_prob,
  m.next_state AS next_state_pred, 0.5::DOUBLE AS next_state_confidence, CAST(r.covered AS INT) AS exception_required_pred, r.assigned AS exception_type_pred,
  CASE WHEN r.covered THEN 0.98::DOUBLE ELSE least(r.anomaly_score * 0.5, 0.49) END AS exception_confidence, r.anomaly_score, 'rate (+)' AS top_drivers,
  CASE WHEN r.covered THEN 'REVIEW - data exception, verify record before relying on scores' WHEN r.anomaly_score >= 0.90 THEN 'REVIEW - unusual record pattern, confirm data quality'
    WHEN next_12m_default_prob >= 0.05 THEN 'REVIEW - elevated 12-month default risk' WHEN next_3m_delinquency_prob >= 0.25 THEN 'REVIEW - elevated near-term delinquency risk'
    WHEN next_3m_delinquency_prob >= 0.10 THEN 'MONITOR - early delinquency signal' WHEN next_12m_prepayment_prob >= 0.40 THEN 'MONITOR - elevated prepayment likelihood'
    ELSE 'NO ACTION - within normal range' END AS recommended_action, 0.5::DOUBLE AS model_confidence
FROM ruled r JOIN marked m USING (row_id)"""),
}


def with_ctes(sql: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + sql if order else sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, so that both engines print the same."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def query(needs: str = "", sql: str | None = None, doubles: str = ""):
    """Registers a function; ``sql`` may refer to the CTES that ``needs`` names."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(prepare(spark), sf_dir))
        if sql:
            text = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles.split())}) FROM ({sql})" if doubles else f"SELECT * FROM ({sql})" if sql.lstrip().startswith("WITH") else sql
            SQL[f.__name__] = with_ctes(text, *needs.split())
        return f

    return register


# Frames that several queries use.
def _panel(spark, d):
    return tp.panel(spark, d)


def _rec(spark, d):
    # The feed reads the panel three times more.
    p = written(_panel(spark, d))
    return rec.reconcile(p, tp.feed(p))


def _ruled(spark, d):
    df = rul.rule_scores(rul.evaluate_rules(_rec(spark, d).withColumns(rul.exception_labels())))
    return df.withColumns(
        {"anomaly_score": (F.col("row_id") % 1000).cast("double") / 1000, "residual_prob": F.when(F.col("row_id") % 3 == 0, ((F.col("row_id") * 7) % 1000).cast("double") / 1000)}
    )


def _scored(spark, d):
    return qual.record_quality(written(_ruled(spark, d)))


def _marked(spark, d):
    df = feat.forward_labels(_panel(spark, d))
    return df.withColumn("p", ((F.col("row_id") * 7 + F.col("delinq_3") * 300) % 1000).cast("double") / 1000)


def _halves(df):
    early = F.col("reporting_month") < F.lit("1995-07-01").cast("date")
    return df.where(early), df.where(~early)


HALF = "reporting_month < DATE '1995-07-01'"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel, reconciliation, rules, severity, record quality, and quality by month."""
    return rounded(qual.batch_quality(_scored(prepare(spark), sf_dir), ("reporting_month",)))


# Sources and joins.
@query("panel static", """
SELECT 'panel' AS "table", count(*) AS n_rows, CAST(19 AS BIGINT) AS n_columns, count(DISTINCT loan_id) AS n_loans FROM panel
UNION ALL SELECT 'static', count(*), 5, count(DISTINCT loan_id) FROM static""")
def pack_summary(spark, d):
    return rec.pack_summary({"panel": _panel(spark, d), "static": tp.static(spark, d)})


def _pack(spark, d):
    """The panel's tables written as a pack of CSV files, some with dates that are none; its folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/pack-{uuid.uuid4().hex}"
    early, late = _halves(_panel(spark, d))
    broken = F.when(F.col("row_id") % 101 == 0, "not a date").otherwise(F.col("last_updated_at").cast("string"))
    for name, df in (("train", early.withColumn("last_updated_at", broken)), ("test", late), ("static", tp.static(spark, d))):
        pack.write_derived(df, f"{folder}/{pack.TABLES[name]}.csv", kind="csv")
    return folder


@query("panel", f"SELECT row_id, loan_id, reporting_month, current_balance, days_past_due, CAST(CASE WHEN row_id % 101 <> 0 THEN last_updated_at END AS TIMESTAMP) AS last_updated_at, document_status FROM panel WHERE {HALF}", "current_balance")
def load_pack(spark, d):
    found = pack.load_pack(spark, _pack(spark, d))
    assert found.missing == [pack.TABLES["servicer"]]
    return found.train.select("row_id", "loan_id", "reporting_month", "current_balance", "days_past_due", "last_updated_at", "document_status")


@query("panel static", f"""
SELECT 'train' AS "table", count(*) AS n_rows, CAST(19 AS BIGINT) AS n_columns, count(DISTINCT loan_id) AS n_loans FROM panel WHERE {HALF}
UNION ALL SELECT 'test', count(*), 19, count(DISTINCT loan_id) FROM panel WHERE NOT {HALF} UNION ALL SELECT 'static', count(*), 5, count(DISTINCT loan_id) FROM static""")
def load_pack_summary(spark, d):
    return pack.load_pack(spark, _pack(spark, d)).summary()


def _rules_file(spark, d):
    """A file of rule declarations for the panel: the engine's first six rules, and one that it does not know."""
    flagged = _ruled(spark, d)
    counts = flagged.agg(*[F.coalesce(F.sum(F.col(r).cast("long")), F.lit(0)).alias(r) for r in RULES[:6]])
    rules = [F.struct(F.lit(r).alias("rule_id"), F.concat(F.lit("fires on "), F.col(r).cast("string"), F.lit(" rows")).alias("description"), F.lit(rul.SEVERITIES[r]).alias("severity")) for r in RULES[:6]]
    rules.append(F.struct(F.lit("income_verified").alias("rule_id"), F.lit("no such column").alias("description"), F.lit("low").alias("severity")))
    path = f"{shared_dir(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    counts.select(F.array(*rules).alias("rules")).coalesce(1).write.json(path)
    return flagged, path


DECLARED = " UNION ALL ".join([*(f"SELECT '{r}' AS rule_id, concat('fires on ', count(*) FILTER (WHERE {r}), ' rows') AS description, '{rul.SEVERITIES[r]}' AS severity FROM flags" for r in RULES[:6]), "SELECT 'income_verified', 'no such column', 'low'"])


@query("flags", f"SELECT *, CAST(NULL AS VARCHAR) AS applies_to FROM ({DECLARED})")
def load_rules(spark, d):
    return pack.load_rules(spark, _rules_file(spark, d)[1])


@query("", "SELECT r_name AS scenario, 1 + r_regionkey / 10.0::DOUBLE AS default_mult, CASE WHEN r_regionkey = 3 THEN 1 ELSE 1 + r_regionkey / 5.0::DOUBLE END AS delinq_mult, 1 - r_regionkey / 10.0::DOUBLE AS prepay_mult FROM region", "default_mult delinq_mult prepay_mult")
def load_scenarios(spark, d):
    """A scenario file with one row for each region, a multiplier missing in one of them."""
    k = F.col("r_regionkey")
    path = f"{shared_dir(spark).rstrip('/')}/scenarios-{uuid.uuid4().hex}"
    rows = table(spark, d, "region").select(F.col("r_name").alias("scenario_name"), (1 + k / 10).alias("default_multiplier"), F.when(k != 3, 1 + k / 5).alias("delinquency_multiplier"), (1 - k / 10).alias("prepayment_multiplier"))
    pack.write_derived(rows, path, kind="csv")
    return pack.load_scenarios(spark, path)


@query("scored", "SELECT row_id, loan_id, reporting_month, source_system, data_quality_score FROM scored", "data_quality_score")
def write_derived(spark, d):
    """Record quality, written by source system and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/derived-{uuid.uuid4().hex}"
    pack.write_derived(_scored(spark, d), path, ["row_id", "loan_id", "reporting_month", "source_system", "data_quality_score"], by=["source_system"])
    return spark.read.parquet(path).select("row_id", "loan_id", "reporting_month", "source_system", "data_quality_score")


@query("panel static", "SELECT p.row_id, p.loan_id, s.ltv_band, s.dti_band, s.loan_purpose, s.vintage FROM panel p LEFT JOIN static s USING (loan_id)")
def attach_static(spark, d):
    return rec.attach_static(_panel(spark, d), tp.static(spark, d)).select("row_id", "loan_id", "ltv_band", "dti_band", "loan_purpose", "vintage")


@query("panel", "SELECT row_id, row_number() OVER (PARTITION BY loan_id ORDER BY month_index, row_id) AS n FROM panel")
def sort_panel(spark, d):
    from pyspark.sql import Window as W

    return rec.sort_panel(_panel(spark, d)).select("row_id", F.row_number().over(W.partitionBy("loan_id").orderBy("month_index", "row_id")).cast("long").alias("n"))


@query("sv", "SELECT loan_id, reporting_month, seq, current_balance FROM sv", "current_balance")
def dedupe_feed(spark, d):
    return rec.dedupe_feed(tp.feed(_panel(spark, d))).select("loan_id", "reporting_month", "seq", "current_balance")


FLAGS = ["row_id", "has_servicer_record", "balance_conflict", "balance_rel_diff", "current_status_conflict", "days_past_due_conflict", "source_conflict", "source_stale", "servicer_update_lag_days", "panel_update_lag_days"]


@query("rec", f"SELECT {', '.join(FLAGS)} FROM rec", "balance_rel_diff")
def reconcile_flags(spark, d):
    return _rec(spark, d).select(*FLAGS)


@query("panel", "SELECT row_id, false AS has_servicer_record, false AS source_conflict, false AS source_stale, 0 AS servicer_update_lag_days FROM panel")
def reconcile_empty(spark, d):
    return rec.reconcile(_panel(spark, d), None).select("row_id", "has_servicer_record", "source_conflict", "source_stale", "servicer_update_lag_days")


@query("panel sv", "SELECT loan_id, reporting_month, seq FROM sv WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.loan_id = sv.loan_id AND p.reporting_month = sv.reporting_month)")
def orphan_feed_rows(spark, d):
    p = _panel(spark, d)
    return rec.orphan_feed_rows(p, tp.feed(p)).select("loan_id", "reporting_month", "seq")


@query("rec feed sv", """
SELECT 'servicer rows' AS "check", count(*) AS n FROM feed
UNION ALL SELECT 'orphan servicer rows', count(*) FROM sv WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.loan_id = sv.loan_id AND p.reporting_month = sv.reporting_month)
UNION ALL SELECT 'matched to panel', count(*) FILTER (WHERE has_servicer_record) FROM rec
UNION ALL SELECT 'panel rows with any conflict', count(*) FILTER (WHERE source_conflict) FROM rec
UNION ALL SELECT 'panel rows with stale source', count(*) FILTER (WHERE source_stale) FROM rec
UNION ALL SELECT 'conflict: current_balance', count(*) FILTER (WHERE balance_conflict) FROM rec
UNION ALL SELECT 'conflict: current_status', count(*) FILTER (WHERE current_status_conflict) FROM rec
UNION ALL SELECT 'conflict: days_past_due', count(*) FILTER (WHERE days_past_due_conflict) FROM rec""")
def reconcile_summary(spark, d):
    p = _panel(spark, d)
    return rec.reconcile_summary(rec.reconcile(p, tp.feed(p)), tp.feed(p))


@query("rec", """
SELECT source_system, count(*) AS n_records, avg(CAST(source_conflict AS INT)) AS conflict_rate, avg(CAST(source_stale AS INT)) AS stale_rate,
  quantile_cont(panel_update_lag_days::DOUBLE, 0.5) AS median_update_lag_days, greatest(0, 1 - 0.6 * avg(CAST(source_conflict AS INT)) - 0.4 * avg(CAST(source_stale AS INT))) AS trust_score
FROM rec GROUP BY source_system""", "conflict_rate stale_rate median_update_lag_days trust_score")
def source_trust(spark, d):
    return rec.source_trust(_rec(spark, d))


@query("flags", """
SELECT avg(exception_required) AS overall_rate, avg(exception_required) FILTER (WHERE source_conflict) AS conflict_rate, avg(exception_required) FILTER (WHERE source_conflict) / avg(exception_required) AS lift FROM flags""", "overall_rate conflict_rate lift")
def conflict_lift(spark, d):
    return rec.conflict_lift(_ruled(spark, d))


@query("panel", f"SELECT row_id, CASE WHEN {HALF} THEN 'train' ELSE 'score' END AS origin, CASE WHEN {HALF} THEN NULL ELSE row_id END AS score_order FROM panel")
def union_panels(spark, d):
    return rec.union_panels(*_halves(_panel(spark, d))).select("row_id", "origin", "score_order")


@query("panel", f"SELECT DISTINCT loan_id FROM panel WHERE NOT {HALF} AND loan_id NOT IN (SELECT loan_id FROM panel WHERE {HALF} AND CAST(loan_id AS BIGINT) % 7 <> 0)")
def loans_without_history(spark, d):
    """Loans of the later half that the earlier one, without every seventh loan, does not know."""
    early, late = _halves(_panel(spark, d))
    return rec.loans_without_history(early.where(F.col("loan_id").cast("long") % 7 != 0), late)


@query("panel", f"SELECT loan_id FROM panel WHERE {HALF} INTERSECT SELECT loan_id FROM panel WHERE NOT {HALF}")
def loan_overlap(spark, d):
    return rec.loan_overlap(*_halves(_panel(spark, d)))


@query("panel", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM panel GROUP BY loan_id, reporting_month)")
def duplicate_keys(spark, d):
    return rec.duplicate_keys(_panel(spark, d))


@query("latest", "SELECT loan_id, row_id, current_status FROM latest")
def latest_per_loan(spark, d):
    return rec.latest_per_loan(_panel(spark, d)).select("loan_id", "row_id", "current_status")


@query("panel", """
SELECT loan_id, count(DISTINCT reporting_month) AS months_observed, CAST(count(*) FILTER (WHERE current_status IN ('30DPD', '60DPD', '90DPD', 'Default')) AS BIGINT) AS delinquent_months,
  max_by(current_status, (month_index, row_id)) FILTER (WHERE current_status IN ('30DPD', '60DPD', '90DPD', 'Default')) AS last_bad_status FROM panel WHERE loan_id = '7' GROUP BY loan_id""")
def loan_history(spark, d):
    return rec.loan_history(_panel(spark, d), "7")


# Rules.
def _rule(name):
    def one(spark, d):
        return _ruled(spark, d).where(name).select("row_id", "loan_id", "reporting_month")

    one.__name__ = f"rule_{name}"
    query("flags", f"SELECT row_id, loan_id, reporting_month FROM flags WHERE {name}")(one)


for _name in RULES:
    _rule(_name)


@query("flags", "SELECT k.*, d.description FROM (" + " UNION ALL ".join([*(f"""SELECT '{r}' AS rule_id, '{rul.SEVERITIES[r]}' AS severity, {rul.WEIGHTS[rul.SEVERITIES[r]]}::DOUBLE AS weight, '{"declared" if r in RULES[:6] else "local"}' AS source, true AS implemented, count(*) FILTER (WHERE {r}) AS n_flagged FROM flags""" for r in RULES), "SELECT 'income_verified', 'low', 1.0::DOUBLE, 'declared', false, 0"]) + f") k LEFT JOIN ({DECLARED}) d USING (rule_id)")
def evaluate_rules(spark, d):
    flagged, path = _rules_file(spark, d)
    return rul.rule_catalog(flagged, pack.load_rules(spark, path))


@query("ruled", "SELECT row_id, rule_violation_count, any_violation, CAST(rule_severity_score AS DOUBLE) AS rule_severity_score, covered, assigned FROM ruled", "rule_severity_score")
def rule_scores(spark, d):
    return _ruled(spark, d).select("row_id", "rule_violation_count", "any_violation", "rule_severity_score", rul.rule_covered().alias("covered"), rul.rule_assigned_type().alias("assigned"))


def _bench_sql():
    rows = []
    for r in RULES:
        t = f"exception_type = '{rul.TARGETS[r]}'" if r in rul.TARGETS else None
        rows.append((r, r, t))
    rows.append(("ANY DETECTOR RULE", "covered", "exception_required = 1"))
    rows.append(("ANY RULE", "any_violation", "exception_required = 1"))
    out = []
    for name, mask, t in rows:
        f = lambda c: f"count(*) FILTER (WHERE {c})"
        lab, tp_ = (f(t), f(f"{mask} AND {t}")) if t else ("CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)")
        out.append(
            f"SELECT '{name}' AS rule_id, {f(mask)} AS n_flagged, {lab} AS n_labelled, {tp_} AS true_positives, {tp_} / greatest({f(mask)}, 1)::DOUBLE AS precision, "
            f"{tp_} / greatest({lab}, 1)::DOUBLE AS recall, {f(mask + ' AND exception_required = 1')} / greatest({f(mask)}, 1)::DOUBLE AS exception_rate_when_flagged FROM ruled"
        )
    # A rule without a labelled type has no precision or recall.
    return "SELECT rule_id, n_flagged, n_labelled, true_positives, precision, CASE WHEN n_labelled IS NOT NULL THEN recall END AS recall, exception_rate_when_flagged FROM (" + " UNION ALL ".join(out) + ")"


@query("ruled", _bench_sql(), "precision recall exception_rate_when_flagged")
def benchmark_rules(spark, d):
    return rul.benchmark_rules(_ruled(spark, d)).withColumn("recall", F.when(F.col("n_labelled").isNotNull(), F.col("recall")))


@query("ruled", """
SELECT count(*) FILTER (WHERE exception_required = 1) AS total, count(*) FILTER (WHERE exception_required = 1 AND covered) AS resolved_by_rules,
  count(*) FILTER (WHERE exception_required = 0 AND covered) AS false_positives, count(*) FILTER (WHERE exception_required = 1 AND NOT covered) AS residual FROM ruled""")
def exception_coverage(spark, d):
    return rul.exception_coverage(_ruled(spark, d))


@query("panel", """
SELECT row_id, CASE WHEN current_status IN ('Default', 'Prepaid') AND document_status = 'Missing' THEN 'document_gap'
  WHEN (current_status = 'Current' AND days_past_due > 0) OR (current_status = '90DPD' AND days_past_due < 60) THEN 'delinquency_inconsistency' ELSE 'none' END AS exception_type FROM panel""")
def exception_labels(spark, d):
    return _panel(spark, d).withColumns(rul.exception_labels()).select("row_id", "exception_type")


@query("ruled", """
SELECT row_id, 0.6 * (rule_severity_score - min(rule_severity_score) OVER ()) / (max(rule_severity_score) OVER () - min(rule_severity_score) OVER ())
  + 0.4 * (anomaly_score - min(anomaly_score) OVER ()) / (max(anomaly_score) OVER () - min(anomaly_score) OVER ()) AS blended_score FROM ruled""", "blended_score")
def blend_rule_and_anomaly(spark, d):
    return rul.blend_rule_and_anomaly(_ruled(spark, d)).select("row_id", "blended_score")


DECIDED = """SELECT row_id, anomaly_score, CASE WHEN covered THEN 0.98::DOUBLE WHEN residual_prob IS NOT NULL THEN residual_prob ELSE anomaly_score * 0.5 END AS exception_probability,
  CASE WHEN covered THEN assigned ELSE 'none' END AS exception_kind,
  CASE WHEN covered THEN 'rule' WHEN residual_prob >= 0.5 THEN 'residual model' WHEN residual_prob IS NOT NULL THEN 'no exception indicated' ELSE 'anomaly score only' END AS decided_by, %s FROM ruled"""


@query("ruled", f"SELECT * EXCLUDE (anomaly_score, x) FROM ({DECIDED % '0 AS x'})", "exception_probability")
def combined_exception_output(spark, d):
    return rul.combined_exception_output(_ruled(spark, d)).select("row_id", "exception_probability", "exception_kind", "decided_by")


@query("ruled", f"SELECT decided_by, count(*) AS n, count(*) / (SELECT count(*) FROM ruled)::DOUBLE AS share FROM ({DECIDED % '0 AS x'}) GROUP BY decided_by", "share")
def decided_by_mix(spark, d):
    return rul.decided_by_mix(rul.combined_exception_output(_ruled(spark, d)))


# Quality.
PROFILED = {
    "row_id": "bigint", "loan_id": "string", "month_index": "bigint", "original_balance": "double", "current_balance": "double", "interest_rate": "double", "days_past_due": "bigint",
    "modification_flag": "int", "document_status": "string", "servicer_name": "string", "reporting_month": "date",
}


def _profile_sql():
    out = []
    for c, kind in PROFILED.items():
        num = kind in ("bigint", "double", "int")
        q = lambda x: f"quantile_cont({c}::DOUBLE, {x})"
        stats = f"{q(0.0)} AS min, {q(0.5)} AS median, {q(1.0)} AS max" if num else "NULL::DOUBLE AS min, NULL::DOUBLE AS median, NULL::DOUBLE AS max"
        fence = f"(SELECT count(*) FROM panel WHERE {c} < (SELECT {q(.25)} - 3 * ({q(.75)} - {q(.25)}) FROM panel) OR {c} > (SELECT {q(.75)} + 3 * ({q(.75)} - {q(.25)}) FROM panel)) * (SELECT CAST({q(.75)} <> {q(.25)} AS BIGINT) FROM panel)" if num else "NULL::BIGINT"
        many = f"count(DISTINCT {c}) > 50" if kind == "string" else "false"
        out.append(f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, {many} AS high_cardinality, count(*) - count({c}) AS n_missing, 100.0 * (count(*) - count({c})) / count(*) AS missing_pct, count(DISTINCT {c}) AS n_distinct, {stats}, {fence} AS n_outliers FROM panel")
    return " UNION ALL ".join(out)


@query("panel", _profile_sql(), "missing_pct min median max")
def profile_columns(spark, d):
    return qual.profile_columns(_panel(spark, d), list(PROFILED))


CATS = ["credit_score_band", "state", "current_status", "document_status", "source_system"]


@query("panel", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS top_value, 100.0 * count(*) / (SELECT count(*) FROM panel) AS top_pct FROM panel WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in CATS), "top_pct")
def top_values(spark, d):
    return qual.top_values(_panel(spark, d), CATS)


NUMS = ["original_balance", "current_balance", "interest_rate", "days_past_due", "loan_age_months", "remaining_term_months"]


@query("panel", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}::DOUBLE, {b}::DOUBLE) AS pearson FROM panel" for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]) + ") WHERE abs(pearson) >= 0.8", "pearson")
def numeric_correlations(spark, d):
    return qual.numeric_correlations(_panel(spark, d), NUMS)


def _cramer(a, b):
    return f"""
SELECT '{a}' AS a, '{b}' AS b, CASE WHEN r < 2 OR k < 2 OR low <= 0 THEN 0 ELSE sqrt(greatest(0, chi2 / n - (r - 1) * (k - 1) / (n - 1)) / low) END AS cramers_v FROM (
  SELECT *, least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1 AS low FROM (
    SELECT any_value(n) * (sum(o * o / (rx * cy)) - 1) AS chi2, any_value(n) AS n, count(DISTINCT x)::DOUBLE AS r, count(DISTINCT y)::DOUBLE AS k FROM (
      SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM (
        SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS o FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2))))"""


@query("panel", " UNION ALL ".join(_cramer(a, b) for i, a in enumerate(CATS) for b in CATS[i + 1 :]), "cramers_v")
def categorical_associations(spark, d):
    return qual.categorical_associations(_panel(spark, d), CATS)


@query("panel", _cramer("state", "source_system"), "cramers_v")
def cramers_v(spark, d):
    return qual.categorical_associations(_panel(spark, d), ["state", "source_system"])


@query("panel", """
SELECT 'state' AS "column", key, count(*) AS n_variants, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT state, CASE lower(trim(state)) WHEN 'california' THEN 'ca' ELSE lower(trim(state)) END AS key, count(*) AS n FROM panel GROUP BY 1, 2) GROUP BY key HAVING count(*) > 1""")
def inconsistent_categories(spark, d):
    return qual.inconsistent_categories(_panel(spark, d), ["state", "source_system"])


AGE = "(year(reporting_month) - year(origination_month)) * 12 + month(reporting_month) - month(origination_month)"


@query("panel", " UNION ALL ".join(f"SELECT '{n}' AS invariant, count(*) FILTER (WHERE {c}) AS n_breaks, 100.0 * count(*) FILTER (WHERE {c}) / count(*) AS pct FROM panel" for n, c in {
    "balance <= original": "current_balance > original_balance * 1.0001", "age + remaining = term": "abs(loan_age_months + remaining_term_months - CASE WHEN row_id % 29 = 0 THEN 348 ELSE 360 END) > 1",
    "age = months since origination": f"abs(loan_age_months - ({AGE})) > 1", "current => dpd 0": "current_status = 'Current' AND days_past_due > 0",
    "prepayment flag => prepaid": "(row_id % 53 = 0 OR current_status = 'Prepaid') AND current_status <> 'Prepaid'"}.items()), "pct")
def relationship_breaks(spark, d):
    k = F.col("row_id")
    more = {"original_term_months": F.when(k % 29 == 0, 348).otherwise(360), "prepayment_flag": F.when((k % 53 == 0) | (F.col("current_status") == "Prepaid"), 1).otherwise(0)}
    return qual.relationship_breaks(_panel(spark, d).withColumns(more))


QUAL = ["completeness", "outlyingness", "rule_penalty", "conflict_penalty", "stale_penalty", "data_quality_score"]


@query("scored", f"SELECT row_id, {', '.join(QUAL)} FROM scored", " ".join(QUAL))
def record_quality(spark, d):
    return _scored(spark, d).select("row_id", *QUAL)


@query("scored", " UNION ALL ".join(f"SELECT '{c}' AS batch_type, CAST({c} AS VARCHAR) AS batch, count(*) AS n_records, avg(data_quality_score) AS mean_score, 100.0 * avg(CAST(data_quality_score < 70 AS INT)) AS pct_below_70 FROM scored WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("reporting_month", "servicer_name", "source_system")), "mean_score pct_below_70")
def batch_quality(spark, d):
    return qual.batch_quality(_scored(spark, d))


@query("scored", """
SELECT band, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM scored) AS pct FROM (
  SELECT CASE WHEN data_quality_score >= 90 THEN '90-100' WHEN data_quality_score >= 70 THEN '70-90' WHEN data_quality_score >= 50 THEN '50-70' ELSE '0-50' END AS band FROM scored) GROUP BY band""", "pct")
def quality_bands(spark, d):
    return qual.quality_bands(_scored(spark, d))


@query("scored", "SELECT row_id, data_quality_score FROM scored WHERE any_violation ORDER BY data_quality_score, row_id LIMIT 25", "data_quality_score")
def worst_records(spark, d):
    return qual.worst_records(_scored(spark, d)).select("row_id", "data_quality_score")


def _psi_sql(c, number):
    sides = f"SELECT {c}{'::DOUBLE' if number else ''} AS v, {HALF} AS e FROM panel"
    if number:
        cells = f"""SELECT count(*) FILTER (WHERE x.v >= y.lo AND x.v < y.hi AND e) AS e, count(*) FILTER (WHERE x.v >= y.lo AND x.v < y.hi AND NOT e) AS a FROM x, (
          SELECT CASE WHEN i = 1 THEN '-inf'::DOUBLE ELSE edges[i] END AS lo, CASE WHEN i = len(edges) - 1 THEN 'inf'::DOUBLE ELSE edges[i + 1] END AS hi FROM (
            SELECT edges, unnest(range(1, len(edges))) AS i FROM (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM x WHERE e))) y GROUP BY y.lo"""
    else:
        cells = "SELECT count(*) FILTER (WHERE e) AS e, count(*) FILTER (WHERE NOT e) AS a FROM x WHERE v IS NOT NULL GROUP BY v"
    share = lambda k, cond: f"greatest({k} / (SELECT count(v) FROM x WHERE {cond})::DOUBLE, 1e-6)"
    es, as_ = share("e", "e"), share("a", "NOT e")
    return f"""
SELECT "column", psi, expected_missing_pct, actual_missing_pct, CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'material' END AS band FROM (
  WITH x AS ({sides}) SELECT '{c}' AS "column", (SELECT sum(({as_} - {es}) * ln({as_} / {es})) FROM ({cells})) AS psi,
    100.0 * (SELECT count(*) - count(v) FROM x WHERE e) / (SELECT count(*) FROM x WHERE e) AS expected_missing_pct,
    100.0 * (SELECT count(*) - count(v) FROM x WHERE NOT e) / (SELECT count(*) FROM x WHERE NOT e) AS actual_missing_pct)"""


@query("panel", _psi_sql("interest_rate", True), "psi expected_missing_pct actual_missing_pct")
def psi(spark, d):
    return qual.drift_report(*_halves(_panel(spark, d)), ["interest_rate"], [])


@query("panel", " UNION ALL ".join([*(_psi_sql(c, True) for c in ("current_balance", "interest_rate", "loan_age_months")), *(_psi_sql(c, False) for c in ("current_status", "document_status", "source_system"))]), "psi expected_missing_pct actual_missing_pct")
def drift_report(spark, d):
    return qual.drift_report(*_halves(_panel(spark, d)), ["current_balance", "interest_rate", "loan_age_months"], ["current_status", "document_status", "source_system"])


# Features, labels and splits.
@query("panel", "SELECT row_id, upper(CASE lower(trim(state)) WHEN 'california' THEN 'ca' ELSE lower(trim(state)) END) AS state FROM panel")
def canonicalise_state(spark, d):
    return feat.canonicalise_state(_panel(spark, d)).select("row_id", "state")


AMORT = ["balance_ratio", "term_progress", "scheduled_balance_ratio", "amortisation_gap"]


@query("amort", f"SELECT row_id, {', '.join(AMORT)} FROM amort", " ".join(AMORT))
def amortisation_features(spark, d):
    return feat.amortisation(_panel(spark, d)).select("row_id", *AMORT)


@query("rates", "SELECT * FROM rates", "market_rate")
def market_rate(spark, d):
    return feat.market_rates(_panel(spark, d))


@query("rated", "SELECT row_id, market_rate, rate_incentive FROM rated", "market_rate rate_incentive")
def asof_market_rate(spark, d):
    return feat.rate_incentive(_panel(spark, d)).select("row_id", "market_rate", "rate_incentive")


@query("rated", """
SELECT row_id, (rank() OVER (PARTITION BY reporting_month ORDER BY ri) + (count(*) OVER (PARTITION BY reporting_month, ri) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY reporting_month) AS rate_incentive_pctile
FROM (SELECT row_id, reporting_month, round(rate_incentive, 9) AS ri FROM rated)""", "rate_incentive_pctile")
def rate_incentive_pctile(spark, d):
    df = feat.rate_incentive(_panel(spark, d)).withColumn("rate_incentive", F.round("rate_incentive", 9))
    return feat.rate_incentive_pctile(df).select("row_id", "rate_incentive_pctile")


HIST = ["months_delinquent_to_date", "ever_delinquent", "max_dpd_to_date", "ever_modified", "delinquency_streak", "n_status_changes_to_date", "balance_change_3m"]


@query("hist", "SELECT row_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in HIST[:-1]) + ", balance_change_3m FROM hist", "balance_change_3m")
def history_features(spark, d):
    return feat.history(feat.amortisation(_panel(spark, d))).select("row_id", *[F.col(c).cast("long").alias(c) for c in HIST[:-1]], HIST[-1])


@query("panel static", """
SELECT row_id, CASE credit_score_band WHEN '<620' THEN 600 WHEN '620-659' THEN 640 WHEN '660-699' THEN 680 WHEN '700-739' THEN 720 WHEN '740-779' THEN 760 WHEN '780+' THEN 800 END AS credit_score_band_ordinal,
  CASE ltv_band WHEN '<=60' THEN 55 WHEN '61-70' THEN 65 WHEN '71-80' THEN 75 WHEN '81-90' THEN 85 WHEN '>95' THEN 98 END AS ltv_band_ordinal,
  CASE dti_band WHEN '<=30' THEN 25 WHEN '31-36' THEN 33 WHEN '37-43' THEN 40 END AS dti_band_ordinal FROM panel LEFT JOIN static USING (loan_id)""")
def band_ordinals(spark, d):
    return feat.band_ordinals(rec.attach_static(_panel(spark, d), tp.static(spark, d))).select("row_id", "credit_score_band_ordinal", "ltv_band_ordinal", "dti_band_ordinal")


@query("scored", "SELECT row_id, rule_violation_count, CAST(source_conflict AS INT) AS source_conflict, CAST(source_stale AS INT) AS source_stale, servicer_update_lag_days, data_quality_score FROM scored", "data_quality_score")
def quality_features(spark, d):
    return feat.quality_features(_scored(spark, d)).select("row_id", "rule_violation_count", "source_conflict", "source_stale", "servicer_update_lag_days", "data_quality_score")


@query("scored rated hist", """
SELECT s.row_id, h.balance_ratio, h.amortisation_gap, r.rate_incentive, CAST(h.delinquency_streak AS BIGINT) AS delinquency_streak, s.data_quality_score
FROM scored s JOIN rated r USING (row_id) JOIN hist h USING (row_id)""", "balance_ratio amortisation_gap rate_incentive data_quality_score")
def engineer_features(spark, d):
    return feat.engineer_features(_scored(spark, d))[0].select("row_id", "balance_ratio", "amortisation_gap", "rate_incentive", "delinquency_streak", "data_quality_score")


@query("labels12", "SELECT row_id, delinq_3, delinq_6, default_12, prepay_12, next_state FROM labels12")
def forward_labels(spark, d):
    return feat.forward_labels(_panel(spark, d)).select("row_id", "delinq_3", "delinq_6", "default_12", "prepay_12", "next_state")


@query("panel", "SELECT row_id FROM panel WHERE reporting_month <= (SELECT max(reporting_month) - INTERVAL 12 MONTH FROM panel)")
def mature_label_mask(spark, d):
    return feat.mature_label_mask(_panel(spark, d), 12).select("row_id")


#: Cut and start of the test for the sorted months ``ms`` of a table; {h} is the purge, {f} the share to test on.
CUT = """(SELECT cut, CAST(cut + INTERVAL ({h} + 1) MONTH AS DATE) AS test FROM (
  SELECT ms[CASE WHEN pos < 1 THEN greatest(0, len(ms) - {h} - 2) ELSE pos END + 1] AS cut FROM (
    SELECT ms, len(ms) - greatest(1, CAST(round_even(len(ms) * {f}, 0) AS INT)) - {h} - 1 AS pos FROM (SELECT list_sort(list(DISTINCT reporting_month)) AS ms FROM {t}))))"""


def split_sql(t: str, h: int, f: float = 0.2) -> str:
    """Every column of ``t`` and its part."""
    return f"SELECT t.*, CASE WHEN reporting_month <= cut THEN 'train' WHEN reporting_month >= test THEN 'test' ELSE 'purged' END AS part FROM {t} t, {CUT.format(t=t, h=h, f=f)}"


HELD = "CAST(('0x' || md5(loan_id)[1:8]) AS BIGINT) % 100 < {0}"


@query("panel", f"SELECT row_id, part FROM ({split_sql('panel', 12)})")
def time_aware_split(spark, d):
    return feat.time_aware_split(_panel(spark, d), 12).select("row_id", "part")


@query("panel", """
SELECT fold, ms[12 + (fold - 1) * step + 1] AS train_end, CAST(train_end + INTERVAL 4 MONTH AS DATE) AS test_start, CAST(train_end + (3 + step) * INTERVAL 1 MONTH AS DATE) AS test_end FROM (
  SELECT ms, greatest(1, (len(ms) - 15) // 4) AS step, CAST(unnest([1, 2, 3, 4]) AS INT) AS fold FROM (SELECT list_sort(list(DISTINCT reporting_month)) AS ms FROM panel))
WHERE 12 + (fold - 1) * step < len(ms) - 4""")
def walk_forward_folds(spark, d):
    return feat.walk_forward_folds(_panel(spark, d))


@query("panel", f"SELECT row_id, loan_id, CASE WHEN part = CASE WHEN {HELD.format(30)} THEN 'test' ELSE 'train' END THEN part ELSE 'purged' END AS part FROM ({split_sql('panel', 3)})")
def group_disjoint_split(spark, d):
    return feat.group_disjoint_split(_panel(spark, d)).select("row_id", "loan_id", "part")


@query("panel", f"SELECT row_id, loan_id, CASE WHEN {HELD.format(25)} THEN 'test' ELSE 'train' END AS part FROM panel")
def random_group_split(spark, d):
    return feat.random_group_split(_panel(spark, d)).select("row_id", "loan_id", "part")


# Transitions and survival.
@query("trans", "SELECT row_id, from_state, to_state FROM trans")
def transition_frame(spark, d):
    return tra.transition_frame(_panel(spark, d)).select("row_id", "from_state", "to_state")


@query("labels12", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE nx IS NULL) AS n_without_successor, count(*) FILTER (WHERE g <> 1) AS n_gaps, count(*) FILTER (WHERE g = 1) AS n_kept, count(*) FILTER (WHERE g = 1 AND next_state <> nt) AS n_disagree FROM (
  SELECT nx, nt, next_state, (year(nx) - year(reporting_month)) * 12 + month(nx) - month(reporting_month) AS g FROM (
    SELECT reporting_month, next_state, lead(reporting_month) OVER w AS nx, lead(current_status) OVER w AS nt FROM labels12 WINDOW w AS (PARTITION BY loan_id ORDER BY reporting_month, row_id)))""")
def transition_losses(spark, d):
    """Beside what is left out, how often the next month is in another state than the panel's own next_state."""
    return tra.transition_losses(feat.forward_labels(_panel(spark, d)))


@query("trans spine", """
SELECT sp.from_state, sp.to_state, coalesce(c.n, 0) AS n, coalesce(coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY sp.from_state), 0)::DOUBLE, 0) AS rate
FROM spine sp LEFT JOIN (SELECT from_state, to_state, count(*) AS n FROM trans GROUP BY ALL) c USING (from_state, to_state)""", "rate")
def transition_counts(spark, d):
    return tra.transition_counts(tra.transition_frame(_panel(spark, d)))


@query("cells", "SELECT bucket, from_state, to_state, p FROM cells", "p")
def empirical_matrix(spark, d):
    return tra.empirical_matrix(tra.transition_frame(_panel(spark, d))).select("bucket", "from_state", "to_state", "p")


@query("stress", f"SELECT scenario, bucket, {STATE_LIST}[i] AS from_state, {STATE_LIST}[j] AS to_state, p FROM stress", "p")
def scenario_stress(spark, d):
    cells = tra.empirical_matrix(tra.transition_frame(_panel(spark, d)))
    out = tra.scenario_matrices(cells, tp.scenarios(spark)).select("scenario", "bucket", F.posexplode("m").alias("i", "row")).select("scenario", "bucket", "i", F.posexplode("row").alias("j", "p"))
    names = F.array(*[F.lit(s) for s in STATES])
    return out.select("scenario", "bucket", F.get(names, F.col("i")).alias("from_state"), F.get(names, F.col("j")).alias("to_state"), "p")


def _paths(spark, d):
    p = _panel(spark, d)
    return tra.simulate_paths(rec.latest_per_loan(p), tra.empirical_matrix(tra.transition_frame(p)), tp.scenarios(spark))


#: One step of a path: the distribution times the matrix of the age bucket, as a recursive query.
PATHS = """
RECURSIVE_PATHS AS (
  SELECT l.loan_id, s.scenario, 0 AS month, l.loan_age_months AS age, l.state0, l.credit_score_band, l.servicer_name,
    list_transform([1, 2, 3, 4, 5, 6], lambda k: CASE WHEN k = l.state0 THEN 1.0::DOUBLE ELSE 0 END) AS p
  FROM (SELECT *, list_position(%s, current_status) AS state0 FROM latest) l, scen s
  UNION ALL
  SELECT r.loan_id, r.scenario, r.month + 1, r.age + 1, r.state0, r.credit_score_band, r.servicer_name,
    list_transform([1, 2, 3, 4, 5, 6], lambda k: list_sum(list_transform([1, 2, 3, 4, 5, 6], lambda i: r.p[i] * m.m[(i - 1) * 6 + k])))
  FROM RECURSIVE_PATHS r JOIN mats m ON m.scenario = r.scenario AND m.bucket = CASE WHEN r.age < 0 OR r.age >= 999 THEN -1 WHEN r.age < 12 THEN 0 WHEN r.age < 24 THEN 1 WHEN r.age < 36 THEN 2 WHEN r.age < 60 THEN 3 ELSE 4 END
  WHERE r.month < 12)""" % STATE_LIST


def _paths_sql(sql: str, doubles: str) -> str:
    """The recursive part needs WITH RECURSIVE, so these queries are put together by hand."""
    inner = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles.split())}) FROM ({sql.replace('paths', 'RECURSIVE_PATHS')})"
    text = with_ctes(inner, "stress", "latest")
    head, tail = text.split("\nSELECT * REPLACE", 1)
    mats = ", mats AS (SELECT scenario, bucket, list(p ORDER BY i, j) AS m FROM stress GROUP BY ALL), "
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + mats + PATHS.strip() + "\nSELECT * REPLACE" + tail


def path_query(sql: str, doubles: str):
    def register(f):
        query()(f)
        SQL[f.__name__] = _paths_sql(sql, doubles)
        return f

    return register


@path_query("SELECT loan_id, scenario, month, p[1] AS p_current, p[5] AS p_default, p[6] AS p_prepaid FROM paths", "p_current p_default p_prepaid")
def simulate_paths(spark, d):
    return _paths(spark, d).select("loan_id", "scenario", "month", *[F.col("p")[i].alias(n) for n, i in (("p_current", 0), ("p_default", 4), ("p_prepaid", 5))])


CURVES = "SELECT scenario, month, avg(p[5]) AS cif_default, avg(p[6]) AS cif_prepaid, avg(p[2] + p[3] + p[4]) AS share_dpd FROM paths GROUP BY ALL"


@path_query(CURVES, "cif_default cif_prepaid share_dpd")
def portfolio_curves(spark, d):
    return tra.portfolio_curves(_paths(spark, d))


@path_query(f"SELECT scenario, month, {STATE_LIST}[k] AS state, avg(p[k]) AS mean_share FROM paths, (SELECT unnest(range(1, 7)) AS k) GROUP BY scenario, month, k", "mean_share")
def state_share_curve(spark, d):
    return tra.state_share_curve(_paths(spark, d))


SEGMENTS = ["credit_score_band", "servicer_name"]
IMPACTS = " UNION ALL ".join(f"SELECT '{s}' AS segment_type, {s} AS segment, scenario, count(*) AS n, avg(p[5]) AS mean_default, avg(p[6]) AS mean_prepaid FROM paths WHERE month = 12 AND {s} IS NOT NULL GROUP BY {s}, scenario" for s in SEGMENTS)


@path_query(IMPACTS, "mean_default mean_prepaid")
def segment_impacts(spark, d):
    return tra.segment_impacts(_paths(spark, d), SEGMENTS)


@path_query(f"""
SELECT segment_type, segment, n, uplift_pp FROM (SELECT a.segment_type, a.segment, a.n, 100 * (a.mean_default - b.mean_default) AS uplift_pp
  FROM ({IMPACTS}) a JOIN ({IMPACTS}) b ON a.segment_type = b.segment_type AND a.segment = b.segment WHERE a.scenario = 'adverse_credit' AND b.scenario = 'base' AND a.n >= 10)
ORDER BY uplift_pp DESC, segment_type, segment LIMIT 12""", "uplift_pp")
def segment_uplift(spark, d):
    return tra.segment_uplift(tra.segment_impacts(_paths(spark, d), SEGMENTS), least=10)


@path_query(f"SELECT c.scenario, c.cif_default - b.cif_default AS default_delta, c.cif_prepaid - b.cif_prepaid AS prepaid_delta FROM ({CURVES}) c, ({CURVES}) b WHERE c.month = 12 AND b.month = 12 AND b.scenario = 'base'", "default_delta prepaid_delta")
def scenario_deltas(spark, d):
    return tra.scenario_deltas(tra.portfolio_curves(_paths(spark, d)))


AHEAD = """
SELECT row_id, h, loan_age_months + h AS loan_age_months, greatest(remaining_term_months - h, 0) AS remaining_term_months,
  CASE WHEN h = 0 THEN balance_ratio ELSE least(greatest(balance_ratio * least(greatest(CASE WHEN now > 1e-9 THEN later / now ELSE 1 END, 0), 1), 0), 2) END AS balance_ratio FROM (
  SELECT *, (pow(g, term) - pow(g, loan_age_months)) / nullif(pow(g, term) - 1, 0) AS now, (pow(g, term) - pow(g, loan_age_months + h)) / nullif(pow(g, term) - 1, 0) AS later FROM (
    SELECT *, 1 + interest_rate / 1200 AS g FROM amort, (SELECT unnest([0, 1, 6, 12]) AS h)))"""


@query("amort", AHEAD, "balance_ratio")
def advance_covariates(spark, d):
    df = feat.amortisation(_panel(spark, d)).withColumn("h", F.explode(F.array(*[F.lit(h) for h in (0, 1, 6, 12)])))
    return tra.advance_covariates(df, F.col("h")).select("row_id", "h", "loan_age_months", "remaining_term_months", "balance_ratio")


@query("amort", f"SELECT row_id, h, balance_ratio FROM ({AHEAD})", "balance_ratio")
def project_balance_ratio(spark, d):
    df = feat.amortisation(_panel(spark, d)).withColumn("h", F.explode(F.array(*[F.lit(h) for h in (0, 1, 6, 12)])))
    return df.select("row_id", "h", tra.project_balance_ratio(F.col("h")).alias("balance_ratio"))


@path_query("SELECT scenario, month, sum(p[5] * w) / sum(w) AS cif_default, sum(p[6] * w) / sum(w) AS cif_prepaid, sum((p[2] + p[3] + p[4]) * w) / sum(w) AS share_dpd FROM (SELECT *, 1 + CAST(loan_id AS BIGINT) % 7 AS w FROM paths) GROUP BY ALL", "cif_default cif_prepaid share_dpd")
def weighted_curves(spark, d):
    return tra.portfolio_curves(_paths(spark, d).withColumn("w", 1 + F.col("loan_id").cast("long") % 7), "w")


#: Chains from every mature, active row, a path for each distinct state and age, in the base scenario.
HORIZON = """
WITH RECURSIVE {ctes},
kinds AS (SELECT DISTINCT current_status AS s, loan_age_months AS a FROM labels12 WHERE {mature}),
mats AS (SELECT bucket, list(p ORDER BY i, j) AS m FROM cells GROUP BY ALL),
walk AS (
  SELECT s, a, 0 AS month, list_transform([1, 2, 3, 4, 5, 6], lambda k: CASE WHEN k = list_position({states}, s) THEN 1.0::DOUBLE ELSE 0 END) AS p FROM kinds
  UNION ALL
  SELECT w.s, w.a, w.month + 1, list_transform([1, 2, 3, 4, 5, 6], lambda k: list_sum(list_transform([1, 2, 3, 4, 5, 6], lambda i: w.p[i] * m.m[(i - 1) * 6 + k])))
  FROM walk w JOIN mats m ON m.bucket = CASE WHEN w.a + w.month < 0 OR w.a + w.month >= 999 THEN -1 WHEN w.a + w.month < 12 THEN 0 WHEN w.a + w.month < 24 THEN 1 WHEN w.a + w.month < 36 THEN 2 WHEN w.a + w.month < 60 THEN 3 ELSE 4 END WHERE w.month < 12),
cc AS (SELECT l.row_id, l.default_12 AS y, w.p[5] AS p FROM labels12 l JOIN walk w ON w.s = l.current_status AND w.a = l.loan_age_months AND w.month = 12 WHERE {mature})
"""


def _horizon_sql(sql: str) -> str:
    ctes = with_ctes("", "labels12", "cells").removeprefix("WITH ").rstrip()
    mature = "reporting_month <= (SELECT max(reporting_month) - INTERVAL 12 MONTH FROM labels12) AND current_status NOT IN ('Default', 'Prepaid')"
    return HORIZON.format(ctes=ctes, states=STATE_LIST, mature=mature) + sql


def _crosscheck(spark, d):
    rows = feat.mature_label_mask(feat.forward_labels(_panel(spark, d)), 12).where(~F.col("current_status").isin("Default", "Prepaid"))
    cells = tra.empirical_matrix(tra.transition_frame(_panel(spark, d)))
    paths = tra.simulate_paths(rows.select("row_id", "default_12", "current_status", "loan_age_months"), cells, tp.scenarios(spark).where("scenario = 'base'"))
    ends = paths.where("month = 12").select("row_id", "default_12", F.round(F.col("p")[4], 12).alias("p"))
    return tra.horizon_crosscheck(ends, "default_12", "p")


@query()
def horizon_crosscheck(spark, d):
    return _crosscheck(spark, d)[0]


SQL["horizon_crosscheck"] = _horizon_sql("""SELECT n, round(observed_rate, 6) AS observed_rate, round(predicted_rate, 6) AS predicted_rate, round(brier, 6) AS brier, round(roc_auc, 6) AS roc_auc FROM (
  SELECT count(*) AS n, avg(y) AS observed_rate, avg(p) AS predicted_rate, avg((p - y) * (p - y)) AS brier, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS roc_auc
  FROM (SELECT y, p, rank() OVER (ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY round(p, 12)) - 1) / 2.0::DOUBLE AS r FROM cc))""")


@query()
def horizon_calibration(spark, d):
    return _crosscheck(spark, d)[1]


SQL["horizon_calibration"] = _horizon_sql("""SELECT bin, n, round(mean_predicted, 6) AS mean_predicted, round(observed_rate, 6) AS observed_rate, round(mean_predicted - observed_rate, 6) AS gap FROM (
  SELECT CAST(b AS INT) AS bin, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS observed_rate FROM (SELECT *, ntile(10) OVER (ORDER BY round(p, 12), row_id) AS b FROM cc) GROUP BY b)""")


@query("ends", "SELECT loan_id, duration, event FROM ends")
def time_to_event(spark, d):
    return tra.time_to_event(_panel(spark, d))


@query("surv", "SELECT duration, 1 - s_one AS one_minus_km FROM surv", "one_minus_km")
def kaplan_meier(spark, d):
    return tra.kaplan_meier(tra.time_to_event(_panel(spark, d)))


@query("surv", "SELECT duration, sum(coalesce(prev, 1) * d1 / at_risk::DOUBLE) OVER (ORDER BY duration) AS cif_default, 1 - s_one AS one_minus_km FROM (SELECT *, lag(s_all) OVER (ORDER BY duration) AS prev FROM surv)", "cif_default one_minus_km")
def aalen_johansen(spark, d):
    return tra.aalen_johansen(tra.time_to_event(_panel(spark, d)))


ONE_STEP = """SELECT t.row_id, t.to_state, list(c.p ORDER BY c.j) AS p FROM trans t JOIN cells c ON c.from_state = t.from_state AND c.bucket =
  CASE WHEN loan_age_months < 0 OR loan_age_months >= 999 THEN -1 WHEN loan_age_months < 12 THEN 0 WHEN loan_age_months < 24 THEN 1 WHEN loan_age_months < 36 THEN 2 WHEN loan_age_months < 60 THEN 3 ELSE 4 END GROUP BY ALL"""


def _one_step(spark, d):
    frame = written(tra.transition_frame(_panel(spark, d)))
    return tra.one_step_scores(frame, tra.empirical_matrix(frame))


@query("trans cells", f"SELECT count(*) AS n, avg(-ln(greatest(p[list_position({STATE_LIST}, to_state)], 1e-12) / list_sum(list_transform(p, lambda x: greatest(x, 1e-12))))) AS log_loss FROM ({ONE_STEP})", "log_loss")
def log_loss_multiclass(spark, d):
    return tra.log_loss_multiclass(_one_step(spark, d))


@query("trans cells", f"SELECT row_id, {STATE_LIST}[list_position(p, list_max(p))] AS next_state_pred, list_max(p) AS next_state_confidence FROM ({ONE_STEP})", "next_state_confidence")
def score_next_state(spark, d):
    return tra.score_next_state(_one_step(spark, d)).select("row_id", "next_state_pred", "next_state_confidence")


def _one_step_sql(source: str) -> str:
    """(metric, value) of probabilities p; source is a query of (row_id, to_state, p)."""
    return f"""
SELECT * FROM (
  WITH o AS ({source}), k AS (SELECT to_state AS y, {STATE_LIST}[list_position(p, list_max(p))] AS q FROM o),
  c AS (SELECT x AS c, (SELECT count(*) FROM k WHERE y = x)::DOUBLE AS r, (SELECT count(*) FROM k WHERE q = x)::DOUBLE AS s, (SELECT count(*) FROM k WHERE y = x AND q = x)::DOUBLE AS t FROM (SELECT DISTINCT unnest([y, q]) AS x FROM k)),
  e AS (SELECT {STATE_LIST}[i] AS g, CAST(to_state = {STATE_LIST}[i] AS INT) AS y, p[i] AS s FROM o, (SELECT unnest(range(1, 7)) AS i)),
  a AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0::DOUBLE AS r FROM e)
  SELECT 'n' AS metric, count(*)::DOUBLE AS value FROM o
  UNION ALL SELECT 'log_loss', avg(-ln(greatest(p[list_position({STATE_LIST}, to_state)], 1e-12) / list_sum(list_transform(p, lambda x: greatest(x, 1e-12))))) FROM o
  UNION ALL SELECT 'accuracy', sum(t) / sum(r) FROM c UNION ALL SELECT 'macro_f1', avg(2 * t / (r + s)) FROM c
  UNION ALL SELECT concat('auc_', g), (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) FROM a GROUP BY g HAVING sum(y) > 0 AND sum(1 - y) > 0)"""


@query("trans cells", _one_step_sql(ONE_STEP), "value")
def evaluate_one_step(spark, d):
    return tra.evaluate_one_step(_one_step(spark, d))


ALL_AGES = "SELECT t.row_id, t.to_state, list(c.p ORDER BY c.j) AS p FROM trans t JOIN cells c ON c.from_state = t.from_state AND c.bucket = -1 GROUP BY ALL"


@query("trans cells", f"SELECT metric, b.value AS baseline, m.value AS model, m.value - b.value AS delta FROM ({_one_step_sql(ALL_AGES)}) b FULL JOIN ({_one_step_sql(ONE_STEP)}) m USING (metric)", "baseline model delta")
def compare_to_baseline(spark, d):
    """Matrices by age against one matrix for all ages."""
    frame = tra.transition_frame(_panel(spark, d))
    cells = tra.empirical_matrix(frame)
    whole = tra.one_step_scores(frame, cells.where("bucket = -1").select(F.explode(F.array(*[F.lit(b) for b in range(-1, 5)])).alias("bucket"), "from_state", "to_state", "i", "j", "p"))
    both = tra.one_step_scores(frame, cells).join(whole.select("row_id", F.col("p").alias("p_all")), "row_id")
    return tra.compare_to_baseline(both, "p", "p_all")


@query("trans cells", f"""
WITH k AS (SELECT to_state AS y, {STATE_LIST}[list_position(p, list_max(p))] AS q FROM ({ONE_STEP})),
c AS (SELECT x AS c, (SELECT count(*) FROM k WHERE y = x)::DOUBLE AS r, (SELECT count(*) FROM k WHERE q = x)::DOUBLE AS s, (SELECT count(*) FROM k WHERE y = x AND q = x)::DOUBLE AS t FROM (SELECT DISTINCT unnest([y, q]) AS x FROM k))
SELECT sum(t) / sum(r) AS accuracy, avg(2 * t / (r + s)) AS macro_f1, sum(r * 2 * t / (r + s)) / sum(r) AS weighted_f1 FROM c""", "accuracy macro_f1 weighted_f1")
def classification_report(spark, d):
    return met.classification_report(tra.score_next_state(_one_step(spark, d)), "to_state", "next_state_pred")


@query("trans", """
SELECT from_state, n, CASE WHEN n < 30 THEN 0 ELSE alpha END AS alpha FROM (
  SELECT from_state, alpha, n, row_number() OVER (PARTITION BY from_state ORDER BY loss, alpha) AS rn FROM (
    SELECT from_state, alpha, count(*) AS n, avg(-ln(greatest(alpha * a + (1 - alpha) * b, 1e-12))) AS loss FROM (
      SELECT from_state, ((row_id * 7) % 900 + 50) / 1000.0::DOUBLE AS a, ((row_id * 11) % 800 + 100) / 1000.0::DOUBLE AS b, unnest([0.0, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0])::DOUBLE AS alpha FROM trans) GROUP BY ALL)) WHERE rn = 1""", "alpha")
def credibility_blend(spark, d):
    frame = tra.transition_frame(_panel(spark, d))
    return tra.credibility_blend(frame.withColumns({"p_model": ((F.col("row_id") * 7) % 900 + 50) / 1000, "p_empirical": ((F.col("row_id") * 11) % 800 + 100) / 1000}))


# Metrics.
def _table(spark, d):
    return met.score_table(_marked(spark, d), "delinq_3", "p")


AT = "SELECT p AS s, sum(delinq_3) OVER (ORDER BY p DESC) AS tp, sum(1 - delinq_3) OVER (ORDER BY p DESC) AS fp, tp / (tp + fp)::DOUBLE AS precision, sum(delinq_3) OVER () AS np, delinq_3 FROM marked"


@query("marked", "SELECT (sum(r) FILTER (WHERE delinq_3 = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS roc_auc FROM (SELECT delinq_3, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r, sum(delinq_3) OVER ()::DOUBLE AS n1, sum(1 - delinq_3) OVER ()::DOUBLE AS n0 FROM marked) GROUP BY n1, n0", "roc_auc")
def roc_auc(spark, d):
    return met.roc_auc(_table(spark, d))


@query("marked", f"SELECT sum(precision * delinq_3) / sum(delinq_3) AS pr_auc, sum(precision * delinq_3) / sum(delinq_3) / avg(delinq_3) AS pr_auc_lift FROM ({AT})", "pr_auc pr_auc_lift")
def pr_auc(spark, d):
    return met.pr_auc(_table(spark, d))


@query("marked", f"SELECT coalesce(max(tp / np::DOUBLE) FILTER (WHERE precision >= 0.5), 0) AS recall_at_p50, coalesce(max(tp / np::DOUBLE) FILTER (WHERE precision >= 0.8), 0) AS recall_at_p80 FROM ({AT})", "recall_at_p50 recall_at_p80")
def recall_at_precision(spark, d):
    return met.recall_at_precision(_table(spark, d))


@query("marked", f"SELECT s AS threshold, tp / np::DOUBLE AS recall, 'highest recall at the precision' AS reason FROM ({AT}) WHERE precision >= 0.5 ORDER BY tp DESC, s LIMIT 1", "threshold recall")
def choose_threshold(spark, d):
    return met.choose_threshold(_table(spark, d))


@query("marked", """
SELECT tp, fp, fn, tn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall FROM (SELECT count(*) FILTER (WHERE delinq_3 = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE delinq_3 = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (WHERE delinq_3 = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE delinq_3 = 0 AND p < 0.5) AS tn FROM marked)""", "precision recall")
def confusion(spark, d):
    return met.confusion(_marked(spark, d), "delinq_3", "p")


BINS = "SELECT CAST(b AS INT) AS bin, count(*) AS n, avg(p) AS mean_predicted, avg(delinq_3) AS observed_rate, avg(p) - avg(delinq_3) AS gap FROM (SELECT *, ntile(10) OVER (ORDER BY p, row_id) AS b FROM marked) GROUP BY b"


@query("marked", BINS, "mean_predicted observed_rate gap")
def reliability_bins(spark, d):
    return met.reliability_bins(_marked(spark, d), "delinq_3", "p")


@query("marked", f"SELECT sum(n * abs(gap)) / sum(n) AS ece FROM ({BINS})", "ece")
def ece(spark, d):
    return met.ece(met.reliability_bins(_marked(spark, d), "delinq_3", "p"))


@query("marked", f"""
SELECT count(*) AS n, avg(delinq_3) AS prevalence, avg((p - delinq_3) * (p - delinq_3)) AS brier,
  2.0::DOUBLE * count(*) FILTER (WHERE delinq_3 = 1 AND p >= 0.5) / (count(*) FILTER (WHERE p >= 0.5) + sum(delinq_3)) AS f1, (SELECT sum(n * abs(gap)) / sum(n) FROM ({BINS})) AS ece FROM marked""", "prevalence brier f1 ece")
def binary_metrics(spark, d):
    return met.binary_metrics(_marked(spark, d), "delinq_3", "p").select("n", "prevalence", "brier", "f1", "ece")


@query("marked", "SELECT state AS segment, count(*) AS n, avg(p) AS mean_predicted, avg(delinq_3) AS observed_rate, avg((p - delinq_3) * (p - delinq_3)) AS brier, avg(p) - avg(delinq_3) AS gap FROM marked GROUP BY state HAVING count(*) >= 200", "mean_predicted observed_rate brier gap")
def calibration_by_segment(spark, d):
    return met.calibration_by_segment(_marked(spark, d), "delinq_3", "p", "state")


@query("marked", """
SELECT segment, count(*) AS n, avg(y) AS observed_rate, avg(s) AS mean_predicted, avg(CAST(s >= bar AS INT)) AS selection_rate,
  (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE AS roc_auc, sum(y * tp / up::DOUBLE) / sum(y) / avg(y) AS pr_auc_lift FROM (
  SELECT state AS segment, delinq_3 AS y, p AS s, (SELECT quantile_cont(p, 0.95) FROM marked) AS bar, rank() OVER (PARTITION BY state ORDER BY p) + (count(*) OVER (PARTITION BY state, p) - 1) / 2.0::DOUBLE AS r,
    sum(delinq_3) OVER (PARTITION BY state ORDER BY p DESC) AS tp, count(*) OVER (PARTITION BY state ORDER BY p DESC) AS up FROM marked)
GROUP BY segment HAVING count(*) >= 200""", "observed_rate mean_predicted selection_rate roc_auc pr_auc_lift")
def slice_metrics(spark, d):
    return met.slice_metrics(_marked(spark, d), "delinq_3", "p", "state")


ERR = ["current_balance", "interest_rate", "loan_age_months", "days_past_due"]


@query("marked", """
WITH o AS (SELECT *, CASE WHEN delinq_3 = 1 THEN CASE WHEN p >= 0.5 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN p >= 0.5 THEN 'FP' ELSE 'TN' END END AS o FROM marked),
s AS (""" + " UNION ALL ".join(f"SELECT o, '{c}' AS feature, avg({c}) AS m, var_samp({c}) AS v FROM o GROUP BY o" for c in ERR) + """)
SELECT a.o AS error, a.feature, (a.m - b.m) / sqrt((a.v + b.v) / 2) AS gap FROM s a JOIN s b ON a.feature = b.feature AND ((a.o = 'FP' AND b.o = 'TN') OR (a.o = 'FN' AND b.o = 'TP'))""", "gap")
def error_profile(spark, d):
    return met.error_profile(_marked(spark, d), "delinq_3", "p", ERR)


@query("marked", " UNION ALL ".join(f"SELECT '{c}' AS segment_type, {c} AS segment, count(*) AS n, CAST(sum(delinq_3) AS BIGINT) AS positives, avg(CAST(p >= 0.5 AS INT)) FILTER (WHERE delinq_3 = 0) AS fp_rate, avg(CAST(p < 0.5 AS INT)) FILTER (WHERE delinq_3 = 1) AS fn_rate FROM marked WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 150" for c in ("state", "servicer_name", "credit_score_band")), "fp_rate fn_rate")
def segment_errors(spark, d):
    return met.segment_errors(_marked(spark, d), "delinq_3", "p", ["state", "servicer_name", "credit_score_band"])


@query("marked", "SELECT CAST(len(list_filter(e[2:len(e)-1], lambda x: x < p)) + 1 AS INT) AS decile, count(*) AS n, avg(delinq_3) AS rate FROM marked, (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM marked) GROUP BY 1", "rate")
def score_deciles(spark, d):
    return met.score_deciles(_marked(spark, d), "delinq_3", "p")


@query("marked", "SELECT CAST(least(floor(p * 60) + 1, 60) AS INT) AS bin, count(*) AS n FROM marked GROUP BY 1")
def score_histogram(spark, d):
    return met.score_histogram(_marked(spark, d), "p")


@query("marked", "SELECT row_id, CASE WHEN lo >= hi THEN 'medium' WHEN p <= lo THEN 'high' WHEN p <= hi THEN 'medium' ELSE 'low' END AS confidence FROM marked, (SELECT quantile_cont(p, 1.0::DOUBLE / 3) AS lo, quantile_cont(p, 2.0::DOUBLE / 3) AS hi FROM marked)")
def confidence_band(spark, d):
    return met.confidence_band(_marked(spark, d), "p").select("row_id", "confidence")


# Scoring and review tables.
SHOWN = ["loan_id", "reporting_month", "exception_required_pred", "exception_type_pred", "exception_confidence", "anomaly_score", "next_12m_default_prob", "next_state_pred", "recommended_action"]


def _submission(spark, d, keep=()):
    r = _ruled(spark, d).withColumns({"exception_required_pred": rul.rule_covered().cast("int"), "exception_type_pred": rul.rule_assigned_type(), "exception_confidence": sco.exception_confidence()})
    m = _marked(spark, d).select("row_id", F.col("p").alias("next_3m_delinquency_prob"), F.col("next_state").alias("next_state_pred"))
    part = lambda a, n, by: ((F.col("row_id") * a) % n).cast("double") / by
    df = r.join(m, "row_id").withColumns(
        {"next_6m_delinquency_prob": part(11, 997, 997), "next_12m_default_prob": part(13, 991, 9910), "next_12m_prepayment_prob": part(17, 983, 983),
         "next_state_confidence": F.lit(0.5), "top_drivers": F.lit("rate (+)"), "model_confidence": F.lit(0.5)}
    )
    return sco.build_submission(df, keep)


@query("sub", f"SELECT {', '.join(SHOWN)} FROM sub", "exception_confidence anomaly_score next_12m_default_prob")
def build_submission(spark, d):
    return _submission(spark, d).select(*SHOWN)


@query("sub", "SELECT loan_id, reporting_month, anomaly_score, model_confidence FROM sub", "anomaly_score model_confidence")
def template_select(spark, d):
    return sco.template_select(_submission(spark, d), ["loan_id", "reporting_month", "anomaly_score", "model_confidence"])


@query("sub", """
SELECT 'row count' AS "check", true AS passed UNION ALL SELECT 'rows align', true UNION ALL SELECT 'column order', true
UNION ALL SELECT 'probabilities in range', bool_and(""" + " AND ".join(f"{c} BETWEEN 0 AND 1" for c in [*sco.PROBS, "exception_confidence", "anomaly_score", "model_confidence", "next_state_confidence"]) + """) FROM sub
UNION ALL SELECT 'known states', bool_and(next_state_pred IN ('Current', '30DPD', '60DPD', '90DPD', 'Default', 'Prepaid')) FROM sub
UNION ALL SELECT 'flag is 0 or 1', bool_and(exception_required_pred IN (0, 1)) FROM sub
UNION ALL SELECT 'no blank text', bool_and(trim(recommended_action) <> '' AND trim(exception_type_pred) <> '' AND trim(top_drivers) <> '') FROM sub
""" + " ".join(f"UNION ALL SELECT 'no nulls: {c}', count(*) = count({c}) FROM sub" for c in sco.TEMPLATE) + " ".join(
    f" UNION ALL SELECT 'not constant: {c}', min({c}) <> max({c}) FROM sub" for c in [*sco.PROBS, "anomaly_score", "model_confidence"]) + " ".join(
    f" UNION ALL SELECT 'ties: {c}', max(n) / sum(n)::DOUBLE <= 0.25 AND count(*) / sum(n)::DOUBLE >= 0.05 FROM (SELECT count(*) AS n FROM sub GROUP BY {c})" for c in sco.PROBS))
def validate_submission(spark, d):
    return sco.validate_submission(checkpoint(_submission(spark, d, ["row_id"])), _panel(spark, d))


@query("sub", "SELECT recommended_action AS action, count(*) AS n, count(*) / (SELECT count(*) FROM sub)::DOUBLE AS share FROM sub GROUP BY 1", "share")
def recommend_action(spark, d):
    return sco.action_mix(_submission(spark, d))


@query("ruled", "SELECT row_id, CASE WHEN covered THEN 0.98::DOUBLE ELSE least(anomaly_score * 0.5, 0.49) END AS exception_confidence FROM ruled", "exception_confidence")
def exception_confidence(spark, d):
    return _ruled(spark, d).select("row_id", sco.exception_confidence().alias("exception_confidence"))


@query("marked", "SELECT row_id, least(greatest(1 - (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE) / count(*) OVER (), 0.01), 0.99) AS model_confidence FROM marked", "model_confidence")
def model_confidence(spark, d):
    return sco.model_confidence(_marked(spark, d), "p").select("row_id", "model_confidence")


@query("marked", "SELECT row_id, CASE WHEN p < 0.30 THEN 'Low' WHEN p < 0.60 THEN 'Medium' ELSE 'High' END AS band, CASE WHEN p <= 0.25 THEN 'Low' WHEN p <= 0.75 THEN 'Medium' ELSE 'High' END AS chosen FROM marked")
def risk_band(spark, d):
    return _marked(spark, d).select("row_id", sco.risk_band(F.col("p")).alias("band"), sco.risk_band(F.col("p"), (0.25, 0.75), right_closed=True).alias("chosen"))


@query("panel", "SELECT count(DISTINCT loan_id) AS n_loans, count(*) AS n_rows, min(reporting_month) AS first_month, max(reporting_month) AS last_month, avg(CAST(current_status IN ('30DPD', '60DPD', '90DPD') AS INT)) AS share_delinquent FROM panel", "share_delinquent")
def portfolio_kpis(spark, d):
    return sco.portfolio_kpis(_panel(spark, d))


@query("marked", "SELECT loan_id AS segment, count(*) AS n, avg(p) AS mean_probability FROM marked GROUP BY loan_id ORDER BY avg(p) DESC, loan_id LIMIT 25", "mean_probability")
def risk_by_segment(spark, d):
    return sco.risk_by_segment(_marked(spark, d), "p", "loan_id")


@query("panel", """
WITH o AS (SELECT 1 AS scenario_id, loan_id, reporting_month, 0.0::DOUBLE AS current_balance FROM panel WHERE row_id % 50 = 0),
n AS (SELECT l.scenario_id, p.* REPLACE (coalesce(o.current_balance, p.current_balance) AS current_balance), p.current_balance AS old FROM panel p JOIN (SELECT DISTINCT scenario_id, loan_id FROM o) l ON l.loan_id = p.loan_id
  LEFT JOIN o ON o.loan_id = p.loan_id AND o.reporting_month = p.reporting_month)
SELECT scenario_id, row_id, balance_change, balance_change_base FROM (
  SELECT scenario_id, row_id, current_balance - lag(current_balance, 3) OVER w AS balance_change, old - lag(old, 3) OVER w AS balance_change_base FROM n WINDOW w AS (PARTITION BY scenario_id, loan_id ORDER BY reporting_month, row_id))""", "balance_change balance_change_base")
def what_if_batch(spark, d):
    from panelworks.functions.columns import BY_MONTH, per

    p = _panel(spark, d)
    overrides = p.where("row_id % 50 = 0").select(F.lit(1).alias("scenario_id"), "loan_id", "reporting_month", F.lit(0.0).alias("current_balance"))
    change = lambda df: df.withColumn("balance_change", F.col("current_balance") - F.lag("current_balance", 3).over(per("loan_id", by=BY_MONTH)))
    return sco.what_if_batch(p, overrides, change).select("scenario_id", "row_id", "balance_change", "balance_change_base")


def _what_if(spark, d):
    """Balances set to 0 in some months; the score is a fixed function of features that follow the balance."""
    p = _panel(spark, d)
    overrides = p.where("row_id % 50 = 0").select(F.lit(1).alias("scenario_id"), "loan_id", "reporting_month", F.lit(0.0).alias("current_balance")).distinct()
    return sco.what_if_batch(p, overrides, lambda df: feat.amortisation(df).withColumn("score", F.col("balance_ratio") * 0.5 + F.col("term_progress") * 0.1))


WHAT_IF = """(SELECT 1 AS scenario_id, a.row_id, a.balance_ratio AS balance_ratio_base, a.amortisation_gap AS amortisation_gap_base, a.term_progress, a.scheduled_balance_ratio,
  CASE WHEN o.loan_id IS NOT NULL THEN 0 ELSE a.balance_ratio END AS balance_ratio FROM amort a JOIN (SELECT DISTINCT loan_id FROM panel WHERE row_id % 50 = 0) l ON l.loan_id = a.loan_id
  LEFT JOIN (SELECT DISTINCT loan_id, reporting_month FROM panel WHERE row_id % 50 = 0) o ON o.loan_id = a.loan_id AND o.reporting_month = a.reporting_month)"""


@query("amort", f"""
SELECT scenario_id, row_id, 'score' AS target, b AS baseline, s AS scenario, (s - b) * 100 AS change_pp, (s - b) / nullif(b, 0) AS relative_change,
  CASE WHEN b < 0.30 THEN 'Low' WHEN b < 0.60 THEN 'Medium' ELSE 'High' END AS baseline_band, CASE WHEN s < 0.30 THEN 'Low' WHEN s < 0.60 THEN 'Medium' ELSE 'High' END AS scenario_band
FROM (SELECT *, balance_ratio_base * 0.5::DOUBLE + term_progress * 0.1::DOUBLE AS b, balance_ratio * 0.5::DOUBLE + term_progress * 0.1::DOUBLE AS s FROM {WHAT_IF})""", "baseline scenario change_pp relative_change")
def what_if_deltas(spark, d):
    return sco.what_if_deltas(_what_if(spark, d), ["score"])


@query("amort", f"SELECT scenario_id, row_id, CASE WHEN balance_ratio <> balance_ratio_base THEN 'balance_ratio, amortisation_gap' ELSE '' END AS changed FROM {WHAT_IF}")
def what_if_changed(spark, d):
    pairs = _what_if(spark, d)
    return pairs.select("scenario_id", "row_id", sco.changed_columns(pairs, ["balance_ratio", "term_progress", "scheduled_balance_ratio", "amortisation_gap"]).alias("changed"))


@query("marked", "SELECT row_id, (max(p) OVER () - p) / (max(p) OVER () - min(p) OVER ()) AS anomaly_score FROM marked", "anomaly_score")
def anomaly_score(spark, d):
    return sco.anomaly_score(_marked(spark, d), "p").select("row_id", "anomaly_score")


DRIVE = ["current_balance", "interest_rate", "days_past_due"]


DRIVERS = """
WITH q AS (SELECT """ + ", ".join(f"quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q_{c}" for c in DRIVE) + """ FROM panel),
m AS (SELECT """ + ", ".join(f"quantile_cont(abs({c} - q_{c}[2]), 0.5) AS m_{c}" for c in DRIVE) + """ FROM panel, q),
d AS (""" + " UNION ALL ".join(
    f"SELECT row_id, '{c}' AS feature, {c}::DOUBLE AS value, q_{c}[2] AS median, ({c} - q_{c}[2]) / coalesce(nullif(m_{c}, 0), nullif((q_{c}[3] - q_{c}[1]) / 1.349, 0)) AS deviation, "
    f"100.0::DOUBLE * (rank() OVER (ORDER BY {c}) - 1) / count(*) OVER () AS percentile FROM panel, q, m" for c in DRIVE) + """)
SELECT row_id, feature, value, median, deviation, percentile, CASE WHEN deviation > 0 THEN 'above' ELSE 'below' END AS direction, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(deviation) DESC, feature) AS INT) AS rank
FROM d WHERE abs(deviation) >= 3 QUALIFY rank <= 3"""


@query("panel", DRIVERS, "value median deviation percentile")
def anomaly_drivers(spark, d):
    return sco.anomaly_drivers(_panel(spark, d), DRIVE)


@query("panel", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, med AS median, mad, coalesce(nullif(mad, 0), nullif(iqr / 1.349, 0)) AS scale FROM (
  SELECT quantile_cont({c}::DOUBLE, 0.5) AS med, quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25) AS iqr, (SELECT quantile_cont(abs({c} - (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM panel)), 0.5) FROM panel) AS mad FROM panel)""" for c in DRIVE), "median mad scale")
def reference_stats(spark, d):
    return sco.reference_stats(_panel(spark, d), DRIVE)


def _cases(values: dict, key: str) -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    return f"CASE {key} {' '.join(f'WHEN {quote(k)} THEN {quote(v)}' for k, v in values.items())} ELSE replace({key}, '_', ' ') END"


@query("panel", f"""
SELECT p.row_id, count(r.feature) AS n_drivers, coalesce(string_agg({_cases(FEATURE_LABELS, 'r.feature')} || ' ' || direction || ' median by ' || printf('%.1f', abs(deviation)) || ' robust deviations', '; ' ORDER BY rank), '{sco.IN_COMBINATION}') AS drivers
FROM panel p LEFT JOIN ({DRIVERS}) r ON r.row_id = p.row_id GROUP BY p.row_id""")
def anomaly_text(spark, d):
    p = _panel(spark, d)
    out = sco.anomaly_text(p, sco.anomaly_drivers(p, DRIVE))
    return out.withColumn("n_drivers", F.col("n_drivers").cast("long"))


@query("ruled", f"""
SELECT q.row_id, exception_probability, anomaly_score, decided_by, fired_rules, drivers FROM (
  SELECT *, row_number() OVER (PARTITION BY decided_by = 'rule' ORDER BY exception_probability DESC, anomaly_score DESC, row_id) AS rn
  FROM ({DECIDED % ("concat_ws(', ', " + ', '.join(f"CASE WHEN {r} THEN '{r}' END" for r in RULES) + ") AS fired_rules")})) q JOIN ({SQL['anomaly_text']}) t ON t.row_id = q.row_id
WHERE rn <= CASE WHEN decided_by = 'rule' THEN 15 ELSE 10 END""", "exception_probability anomaly_score")
def reviewer_queue(spark, d):
    """With what makes each row unusual."""
    p = _panel(spark, d)
    return rul.reviewer_queue(rul.combined_exception_output(_ruled(spark, d)), drivers=sco.anomaly_text(p, sco.anomaly_drivers(p, DRIVE)))


@query("panel", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM panel HAVING min({c}) < max({c})" for c in ("loan_age_months", "remaining_term_months", "original_balance", "current_balance", "interest_rate", "days_past_due", "modification_flag")) + ")")
def detector_features(spark, d):
    df = _panel(spark, d).withColumn("same", F.lit(3))
    return df.groupBy().agg(F.array(*[F.lit(c) for c in sco.detector_features(df)]).alias("f")).select(F.explode("f").alias("feature"))


COEFS = {"interest_rate": 0.8, "days_past_due": 0.05, "loan_age_months": -0.01}
SHAP = " UNION ALL ".join(f"SELECT row_id, '{c}' AS source, {b} * ({c} - (SELECT avg({c}) FROM panel)) AS value FROM panel" for c, b in COEFS.items())


@query("panel", SHAP, "value")
def linear_shap(spark, d):
    return sco.linear_shap(_panel(spark, d), COEFS)


@query("panel", f"SELECT source, mean_abs, 100 * mean_abs / sum(mean_abs) OVER () AS share_pct FROM (SELECT source, avg(abs(value)) AS mean_abs FROM ({SHAP}) GROUP BY source)", "mean_abs share_pct")
def shap_to_source(spark, d):
    return sco.shap_to_source(sco.linear_shap(_panel(spark, d), COEFS))


@query("panel", f"""
SELECT row_id, string_agg(source || CASE WHEN value >= 0 THEN ' (+)' ELSE ' (-)' END, '; ' ORDER BY r) AS top_drivers FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, source) AS r FROM ({SHAP})) WHERE r <= 2 GROUP BY row_id""")
def local_drivers(spark, d):
    return sco.local_drivers(sco.linear_shap(_panel(spark, d), COEFS), top=2)


@query("ruled", f"""
SELECT r.row_id, CASE WHEN covered THEN concat_ws('; ', {', '.join(f"CASE WHEN {r} THEN '{RULE_LABELS.get(r, r.replace('_', ' '))}' END" for r in RULES)}) ELSE t.told END AS top_drivers
FROM ruled r JOIN (SELECT row_id, string_agg({_cases(FEATURE_LABELS, 'source')} || CASE WHEN value >= 0 THEN ' (+)' ELSE ' (-)' END, '; ' ORDER BY k) AS told FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, {_cases(FEATURE_LABELS, 'source')}) AS k FROM ({SHAP})) WHERE k <= 3 GROUP BY row_id) t ON t.row_id = r.row_id""")
def driver_text(spark, d):
    return sco.driver_text(_ruled(spark, d), sco.linear_shap(_panel(spark, d), COEFS)).select("row_id", "top_drivers")


# Texts.
#: DuckDB has no look-behind, so the blanks between digits go by two passes; the sign is marked as the operator does it.
NORMAL = "translate(regexp_replace(regexp_replace(coalesce({x}, ''), '(\\d)[\u00a0\u202f\u2009](\\d)', '\\1\\2', 'g'), '(\\d)[\u00a0\u202f\u2009](\\d)', '\\1\\2', 'g'), '" + txt.DASHES + txt.BLANKS + "\ue000', '-------   ')"
NUMBERS = """list_filter(list_transform(regexp_extract_all(regexp_replace({n}, '(^|[\\s(\\[{{:,=])-\\s*(\\$?\\d)', '\\1\ue000\\2', 'g'), '(\ue000?\\$?\\d[\\d,]*\\.?\\d*\\s*%?)'),
  lambda tok: {{'raw': replace(rtrim(regexp_replace(tok, '\\s+$', '')), '\ue000', '-'), 'value': TRY_CAST(regexp_replace(tok, '[,$%\\s\ue000]', '', 'g') AS DOUBLE) * CASE WHEN tok[1] = '\ue000' THEN -1 ELSE 1 END, 'pct': contains(tok, '%')}}), lambda num: num.value IS NOT NULL)"""


def _numbers_sql(column: str) -> str:
    return NUMBERS.format(n=NORMAL.format(x=column))


@query("", f"""
SELECT doc_id, len(n)::BIGINT AS n_numbers, len(list_filter(n, lambda x: x.pct))::BIGINT AS n_percents, len(list_filter(n, lambda x: x.value < 0))::BIGINT AS n_negative,
  coalesce(list_sum(list_transform(n, lambda x: least(abs(x.value), 1e6))), 0)::DOUBLE AS total, coalesce(array_to_string(list_transform(n, lambda x: x.raw), '|'), '') AS raws
FROM (SELECT doc_id, {_numbers_sql('text')} AS n FROM documents)""", "total")
def extract_numbers(spark, d):
    n = F.col("n")
    count = lambda test: F.size(F.filter(n, test)).cast("long")
    return table(spark, d, "documents").select("doc_id", txt.extract_numbers(F.col("text")).alias("n")).select(
        "doc_id", F.size(n).cast("long").alias("n_numbers"), count(lambda x: x["is_percent"]).alias("n_percents"), count(lambda x: x["value"] < 0).alias("n_negative"),
        F.aggregate(n, F.lit(0.0), lambda a, x: a + F.least(F.abs(x["value"]), F.lit(1e6))).alias("total"), F.array_join(F.transform(n, lambda x: x["raw"]), "|").alias("raws"),
    )


@query("", f"SELECT conv_id, turn, {NORMAL.format(x='text')} AS text FROM conversations")
def normalise_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", txt.normalise_text(F.col("text")).alias("text"))


PHRASES = {"has_causal": txt.CAUSAL, "has_decision": txt.DECISION, "has_certainty": txt.CERTAINTY, "has_disclaimer": txt.DISCLAIMER}
#: Notes on the panel's rows, as a generator would write them: some say what they must not, or a figure from nowhere.
NOTES = """
SELECT row_id, loan_id, reporting_month, p, x, concat(
  CASE WHEN row_id % 17 = 0 THEN '' ELSE concat('The model estimate for the next 3 months is ', CAST((p1000 // 10) AS STRING), '.', CAST((p1000 % 10) AS STRING), '%') END,
  CASE WHEN row_id % 7 = 0 THEN ', against 77.77% elsewhere' ELSE '' END, CASE WHEN row_id % 5 = 0 THEN ' because the borrower moved' ELSE '' END,
  CASE WHEN row_id % 11 = 0 THEN '. Recommend denial' WHEN row_id % 13 = 0 THEN '. It will default' ELSE '' END, CASE WHEN row_id % 3 = 0 THEN '. For review' ELSE '' END,
  CASE WHEN row_id % 19 = 0 THEN concat(' of loan ', loan_id) ELSE '' END) AS note
FROM (SELECT row_id, loan_id, reporting_month, CAST((row_id * 7) % 1000 AS BIGINT) AS p1000, CAST((row_id * 7) % 1000 AS DOUBLE) / 1000 AS p, CAST((row_id * 13) % 500 AS DOUBLE) / 100 AS x FROM panel)
"""
CTES["notes"] = (["panel"], NOTES)


def _notes(spark, d):
    return spark.sql(NOTES.replace("//", "DIV").replace("FROM panel", "FROM {panel}"), panel=_panel(spark, d))


def _grounds(spark, d):
    quantities = F.array("p", "x")
    literals = txt.literal_numbers(F.col("loan_id"), F.date_format("reporting_month", "yyyy-MM-dd"), F.lit("next_3m_delinquency"))
    return _notes(spark, d), quantities, literals


@query("notes", "SELECT row_id, " + ", ".join(f"({' OR '.join(f"contains(lower(note), '{p}')" for p in ps)}) AS {n}" for n, ps in PHRASES.items()) + ", trim(note) = '' AS is_empty, regexp_matches(note, '[0-9]') AS cites_number FROM notes")
def phrase_flags(spark, d):
    return txt.phrase_flags(_notes(spark, d), "note").select("row_id", *PHRASES, "is_empty", "cites_number")


_HELD = "(list_bool_or(list_transform(exact, lambda q: abs({v} - q) <= 1e-6)) IS TRUE OR list_bool_or(list_transform(known, lambda q: abs({v} - q) <= 1e-6 OR (q <> 0 AND abs({v} - q) <= 0.02 * abs(q)))) IS TRUE)"


def _known_sql(*columns: str) -> str:
    return "list_filter([" + ", ".join(_ways_sql(c) for c in columns) + "]::DOUBLE[], lambda q: q IS NOT NULL)"


def _ways_sql(c: str) -> str:
    """The forms of a quantity, as the operator lists them."""
    out = []
    for f in (c, f"abs({c})"):
        out += [f, *(f"round({f}, {k})" for k in range(5)), *(f"CASE WHEN abs({f}) <= 1 THEN round({f} * 100, {k}) END" for k in (6, 0, 1, 2, 3))]
    return ", ".join(out)


GROUNDED = f"""
SELECT row_id, note, p, x, list_transform(list_filter(said, lambda n: NOT ({_HELD.format(v='n.value')} OR (n.pct AND {_HELD.format(v='(n.value / 100)')}))), lambda n: n.raw) AS loose FROM (
  SELECT row_id, note, p, x, {_numbers_sql('note')} AS said, {_known_sql('p', 'x')} AS known,
    [CAST(loan_id AS DOUBLE), year(reporting_month), month(reporting_month), day(reporting_month), 3]::DOUBLE[] AS exact FROM notes)"""


@query("notes", f"SELECT row_id, array_to_string(loose, '|') AS ungrounded, len(loose) = 0 AS grounded FROM ({GROUNDED})")
def numeric_grounding(spark, d):
    notes, quantities, literals = _grounds(spark, d)
    return txt.numeric_grounding(notes, "note", quantities, literals).select("row_id", F.array_join("ungrounded", "|").alias("ungrounded"), "grounded")


def _any(ps):
    return "(" + " OR ".join(f"contains(lower(note), '{p}')" for p in ps) + ")"


@query("notes", f"""
SELECT row_id, failed_checks, failed_checks = '' AS ok FROM (SELECT row_id, concat_ws(',', CASE WHEN len(loose) > 0 THEN 'numeric_grounding' END, CASE WHEN {_any(txt.CAUSAL)} THEN 'no_causal_claims' END,
  CASE WHEN {_any(txt.DECISION)} THEN 'no_decision_language' END, CASE WHEN {_any(txt.CERTAINTY)} THEN 'no_false_certainty' END, CASE WHEN NOT {_any(txt.DISCLAIMER)} THEN 'carries_disclaimer' END,
  CASE WHEN trim(note) = '' THEN 'non_empty' END, CASE WHEN NOT regexp_matches(note, '[0-9]') THEN 'reports_the_numbers' END) AS failed_checks FROM ({GROUNDED}))""")
def note_checks(spark, d):
    notes, quantities, literals = _grounds(spark, d)
    return txt.note_checks(notes, "note", quantities, literals).select("row_id", "failed_checks", "ok")


@query("notes", f"SELECT row_id, len(list_filter(list_filter({_numbers_sql('note')}, lambda n: n.pct), lambda n: abs(n.value / 100 - p) > 0.02))::BIGINT AS n_mismatched FROM notes")
def probability_mismatch(spark, d):
    return _notes(spark, d).select("row_id", F.size(txt.probability_mismatch(F.col("note"), F.col("p"))).cast("long").alias("n_mismatched"))


CHUNKS = r"""
WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS INT) AS line, unnest(ls) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS ls FROM {source})),
t AS (SELECT doc_id, line, trim(raw) AS l FROM l WHERE trim(raw) <> ''),
s AS (SELECT *, last_value(CASE WHEN starts_with(l, '#') THEN trim(regexp_replace(l, '^#+', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM t),
c AS (SELECT *, starts_with(l, '|') AND length(l) - length(replace(l, '|', '')) >= 3 AS tab, list_transform(string_split(regexp_replace(l, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM s WHERE NOT starts_with(l, '#')),
r AS (SELECT *, tab AND len(cells) > 1 AND NOT regexp_full_match(cells[1], '[-: ]*') AND lower(cells[1]) NOT IN ('field', 'column', 'name') AS is_row FROM c)
SELECT doc_id, line, section, CASE WHEN is_row THEN 'field' ELSE 'prose' END AS kind, CASE WHEN is_row THEN cells[1] END AS name, CASE WHEN is_row THEN cells[1] || ': ' || cells[2] ELSE l END AS passage
FROM r WHERE is_row OR (NOT tab AND length(l) > 40 AND NOT starts_with(l, '>'))"""
#: Customers as pages of a dictionary in Markdown: headings, tables, quotes and prose.
PAGES = """
SELECT c_custkey AS doc_id, concat('# Segment ', c_mktsegment, chr(10), '| Field | Meaning |', chr(10), '|---|---|', chr(10), '| acct_', CAST(c_custkey AS STRING), ' | balance of nation ', CAST(c_nationkey AS STRING), ' |', chr(10),
  chr(10), '## Notes', chr(10), CASE WHEN c_custkey % 3 = 0 THEN '> a quoted line that is as long as any other line of prose' ELSE concat('A line of prose about ', c_name, ' that is longer than forty characters') END, chr(10),
  CASE WHEN c_custkey % 4 = 0 THEN '| lone |' ELSE concat('| phone_', CAST(c_custkey AS STRING), ' | kept for nation ', CAST(c_nationkey AS STRING), ' | x |') END, chr(10), 'short line') AS text
FROM customer
"""
CTES["pages_md"] = ([], PAGES)


def _pages(spark, d):
    return spark.sql(PAGES.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))


@query("pages_md", "SELECT * FROM (" + CHUNKS.replace("{source}", "pages_md") + ")")
def corpus_chunks(spark, d):
    return txt.corpus_chunks(_pages(spark, d))


@query("", "SELECT * FROM (" + CHUNKS.replace("{source}", "documents") + ")")
def corpus_chunks_documents(spark, d):
    return txt.corpus_chunks(table(spark, d, "documents"))


TFIDF = """
  WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}') AS w FROM @docs),
  qw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}') AS w FROM @questions),
  dt AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(w) AS term FROM dw UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM dw)) GROUP BY ALL),
  qt AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(w) AS term FROM qw UNION ALL SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM qw)) GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM @docs)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dt GROUP BY term),
  d AS (SELECT doc_id, term, (1 + ln(c)) * idf AS w FROM dt JOIN idf USING (term)), q AS (SELECT item_id, term, (1 + ln(c)) * idf AS w FROM qt JOIN idf USING (term)),
  dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM d GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM q GROUP BY item_id)
  SELECT q.item_id, d.doc_id, sum(q.w * d.w) / (any_value(qn.n) * any_value(dn.n)) AS score FROM q JOIN d USING (term) JOIN dn ON dn.doc_id = d.doc_id JOIN qn ON qn.item_id = q.item_id GROUP BY q.item_id, d.doc_id"""
RANKED = "CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank"


def _tfidf(docs: str, questions: str) -> str:
    return TFIDF.replace("@docs", docs).replace("@questions", questions)


@query("", f"SELECT item_id, doc_id, score, {RANKED} FROM ({_tfidf('documents', 'benchmark')}) WHERE score >= 0.12 QUALIFY rank <= 3", "score")
def tfidf_search(spark, d):
    return txt.tfidf_search(table(spark, d, "documents"), table(spark, d, "benchmark"))


#: Passages of the dictionary and questions about its fields, some of which name none.
PASSAGES = f"SELECT doc_id * 100 + line AS doc_id, passage AS text, name, section FROM ({CHUNKS.replace('{source}', 'pages_md')})"
CTES["passages"] = (["pages_md"], PASSAGES)
QUESTIONS = """SELECT c_custkey AS item_id, CASE WHEN c_custkey % 20 = 0 THEN concat('what is the balance of nation ', CAST(c_nationkey AS STRING), '?')
  ELSE concat('What does acct_', CAST(c_custkey AS STRING), ' mean, or phone?') END AS text FROM customer WHERE c_custkey % 10 = 0"""
CTES["asked"] = ([], QUESTIONS)
NAMED = f"""SELECT item_id, doc_id, score, {RANKED} FROM (
  SELECT h.*, string_split_regex(lower(coalesce(p.name, '')), '[^a-z0-9]+') AS names, string_split_regex(lower(regexp_replace(q.text, '[^A-Za-z0-9_]+', ' ', 'g')), '[^a-z0-9]+') AS words FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM ({_tfidf('passages', 'asked')}) WHERE score >= 0.12 QUALIFY r <= 15) h
  JOIN passages p ON p.doc_id = h.doc_id JOIN asked q ON q.item_id = h.item_id)
WHERE len(list_filter(names, lambda x: x <> '')) = 0 OR len(list_filter(list_intersect(names, words), lambda x: x <> '')) > 0 QUALIFY rank <= 3"""


def _passages(spark, d):
    chunks = txt.corpus_chunks(_pages(spark, d))
    return checkpoint(chunks.select((F.col("doc_id") * 100 + F.col("line")).alias("doc_id"), F.col("passage").alias("text"), "name", "section"))


def _asked(spark, d):
    return spark.sql(QUESTIONS.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))


@query("passages asked", NAMED, "score")
def passage_search(spark, d):
    return txt.tfidf_search(_passages(spark, d), _asked(spark, d), name="name")


@query("passages asked", f"""
SELECT q.item_id, min(h.doc_id) FILTER (WHERE h.rank = 1) AS doc_id, count(h.rank) > 0 AS covered, coalesce(min(p.text) FILTER (WHERE h.rank = 1), '{txt.NOT_COVERED}') AS answer,
  coalesce(string_agg(concat('dictionary (', p.section, ')'), '; ' ORDER BY h.rank) FILTER (WHERE h.rank IS NOT NULL), '') AS citations
FROM asked q LEFT JOIN ({NAMED}) h ON h.item_id = q.item_id LEFT JOIN passages p ON p.doc_id = h.doc_id GROUP BY q.item_id""")
def answer_passages(spark, d):
    passages = _passages(spark, d)
    asked = _asked(spark, d)
    return txt.answer_lookup(asked, txt.tfidf_search(passages, asked, name="name"), passages, F.concat(F.lit("dictionary ("), "section", F.lit(")")))


REVIEWED = ["row_id", "queue", "loan_id", "reporting_month", "p", "score", "required", "type", "decided_by", "n_rules"]


@query("ruled marked", f"""
SELECT row_id, queue, loan_id, strftime(reporting_month, '%Y-%m-%d') AS reporting_month, round(p, 5) AS p, round(anomaly_score, 4) AS score, covered AS required,
  {_cases(EXCEPTION_LABELS, 'assigned')} AS type, CASE WHEN covered THEN 'rule' ELSE 'model score' END AS decided_by, CAST(rule_violation_count AS INT) AS n_rules FROM (
  SELECT r.*, m.p, row_number() OVER (ORDER BY m.p DESC, r.row_id) AS a, CASE WHEN covered THEN row_number() OVER (PARTITION BY covered ORDER BY r.row_id) END AS b,
    CASE WHEN a <= 10 THEN 'risky' ELSE 'flagged' END AS queue FROM ruled r JOIN marked m USING (row_id)) WHERE a <= 10 OR b <= 10""", "p score")
def review_context(spark, d):
    df = _ruled(spark, d).join(_marked(spark, d).select("row_id", "p"), "row_id")
    df = df.withColumns({"covered": rul.rule_covered(), "assigned": rul.rule_assigned_type(), "top_drivers": F.lit("interest rate (+); state (-)")})
    out = txt.review_context(df, "p", rul.flag_columns(df))
    get = lambda path: F.get_json_object("context", path)
    return out.select(
        "row_id", "queue", get("$.loan_id").alias("loan_id"), get("$.reporting_month").alias("reporting_month"), get("$.predictions.next_3m_delinquency").cast("double").alias("p"),
        get("$.anomaly.score").cast("double").alias("score"), get("$.exception.required").cast("boolean").alias("required"), get("$.exception.type").alias("type"), get("$.exception.decided_by").alias("decided_by"),
        F.size(F.from_json(get("$.exception.rules_broken"), "array<string>")).alias("n_rules"),
    )


# Models and sampled results: no SQL twin, invariants are tested.
def _parts(spark, d):
    """Labelled rows before and after the split, written once for the passes of a fit."""
    return _halves(written(_marked(spark, d)))


MODEL_COLUMNS = ["current_balance", "interest_rate", "days_past_due", "loan_age_months", "modification_flag", "credit_score_band", "current_status"]


#: Columns of the panel, of which the engineered ones are left out for the baseline.
RAW_COLUMNS = ["current_balance", "interest_rate", "days_past_due", "loan_age_months", "credit_score_band", "current_status"]
ENGINEERED = [*RAW_COLUMNS, "balance_ratio", "amortisation_gap", "months_delinquent_to_date", "delinquency_streak"]


def _features(spark, d):
    """Labels, and features of amortisation and history, written once for the fits."""
    return written(feat.history(feat.amortisation(feat.forward_labels(_panel(spark, d)))))


PARTS = """
WITH m AS (SELECT * FROM labels12 WHERE reporting_month <= (SELECT max(reporting_month) - INTERVAL {h} MONTH FROM labels12)),
o AS (SELECT * FROM {outer}), t AS (SELECT * EXCLUDE part FROM o WHERE part = 'train'), i AS (SELECT * FROM {inner}),
n AS (SELECT count(*) FILTER (WHERE part = 'train') AS inner_fit, count(*) FILTER (WHERE part = 'test') AS cal FROM i)
SELECT '{t}' AS target, CASE WHEN cal > 200 THEN inner_fit ELSE (SELECT count(*) FROM t) END AS n_fit, CASE WHEN cal > 200 THEN cal ELSE 0 END AS n_calibration,
  (SELECT count(*) FROM o WHERE part = 'test') AS n_test, (SELECT count(*) FROM labels12) - (SELECT count(*) FROM m) AS n_immature FROM n"""


@query("labels12", " UNION ALL ".join(f"SELECT * FROM ({PARTS.format(t=t, h=h, outer='(' + split_sql('m', h) + ')', inner='(' + split_sql('t', h) + ')')})" for t, h in feat.HORIZONS.items()))
def target_parts(spark, d):
    """How many rows each target is fitted, calibrated and tested on."""
    from panelworks.operators import models as mod

    df, out = checkpoint(feat.forward_labels(_panel(spark, d))), None
    for t in feat.HORIZONS:
        parts = mod.target_parts(df, t)
        n = lambda x: F.lit(0 if x is None else x.count()).cast("long")
        row = df.limit(1).select(F.lit(t).alias("target"), n(parts["fit"]).alias("n_fit"), n(parts["calibration"]).alias("n_calibration"), n(parts["test"]).alias("n_test"), F.lit(parts["n_immature"]).cast("long").alias("n_immature"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def train_binary_target(spark, d):
    from panelworks.operators import models as mod

    return mod.train_binary_target(_features(spark, d), "delinq_3", RAW_COLUMNS, ENGINEERED, rounds=8).metrics


@query()
def score_targets(spark, d):
    """Calibrated probabilities of two targets for the panel's last months, by models of the months before."""
    from panelworks.operators import models as mod

    df = _features(spark, d)
    fitted = [mod.train_binary_target(df, t, RAW_COLUMNS, ENGINEERED, rounds=5) for t in ("delinq_3", "default_12")]
    late = df.where(F.col("reporting_month") >= F.lit("1998-01-01").cast("date"))
    out = mod.score_targets(late, fitted)
    return out.select("row_id", *[c for c in out.columns if c.endswith("_prob")])


@query("marked", f"""
SELECT row_id, array_to_string(list_transform(p6, lambda x: printf('%.6f', x)), ',') AS p FROM (
  SELECT row_id, list_transform([1, 2, 3, 4, 5, 6], lambda k: CASE WHEN k = cur THEN 1 - c WHEN total > 0 THEN c * o[k] / total ELSE 0 END) AS p6 FROM (
    SELECT *, list_sum(o) AS total FROM (SELECT row_id, p AS c, list_position({STATE_LIST}, current_status) AS cur,
      list_transform([1, 2, 3, 4, 5, 6], lambda k: CASE WHEN k = list_position({STATE_LIST}, current_status) THEN 0 ELSE ((row_id * k) % 10)::DOUBLE / 45 END) AS o FROM marked)))""")
def recombined_next_state(spark, d):
    from panelworks.operators import models as mod

    destination = F.array(*[((F.col("row_id") * k) % 10).cast("double") / 45 for k in range(1, 7)])
    p = mod.recombine(F.col("p"), destination, F.col("current_status"))
    return _marked(spark, d).select("row_id", F.array_join(printed(p, 6), ",").alias("p"))


@query()
def next_state_hierarchical(spark, d):
    from panelworks.operators import models as mod

    metrics, champion, _ = mod.next_state_hierarchical(_features(spark, d), ENGINEERED, rounds=5)
    return metrics.withColumn("champion", F.col("model") == champion)


@query("ruled", f"""
WITH u AS (SELECT * FROM ruled WHERE NOT covered), p AS (SELECT *, exception_required = 1 AS y FROM ({split_sql('u', 0, 0.25)})),
k AS (SELECT exception_type AS k, count(*) AS n, n >= 25 AND k <> 'status_reversal' AS good FROM u WHERE exception_type <> 'none' GROUP BY 1)
SELECT count(*) AS n_residual, count(*) FILTER (WHERE y) AS n_exceptions, count(*) FILTER (WHERE y) >= 20 AS enough, count(*) FILTER (WHERE y AND part = 'train') AS n_train_positive, count(*) FILTER (WHERE y AND part = 'test') AS n_test_positive,
  count(*) FILTER (WHERE y) >= 20 AND count(*) FILTER (WHERE y AND part = 'train') >= 5 AND count(*) FILTER (WHERE y AND part = 'test') >= 3 AS trainable,
  coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM k WHERE good), '') AS learnable_types, coalesce((SELECT string_agg(k || ' ' || n, ',' ORDER BY k || ' ' || n) FROM k WHERE NOT good), '') AS skipped_types
FROM p""")
def residual_gates(spark, d):
    from panelworks.operators import models as mod

    return mod.residual_gates(_ruled(spark, d))


#: Exceptions that the rules leave: late accounts of a conflicting source, and accounts whose feed is late, by type.
RESIDUAL_COLUMNS = ["current_balance", "days_past_due", "servicer_update_lag_days", "panel_update_lag_days", "current_status"]


def _residual(spark, d):
    kind = F.when(F.col("current_status").isin("30DPD", "60DPD", "90DPD") & F.col("source_conflict"), "late_conflict").when(F.col("servicer_update_lag_days") > 6, "late_feed")
    df = _ruled(spark, d).drop("residual_prob").withColumn("exception_type", F.coalesce(kind, "exception_type"))
    return df.withColumn("exception_required", (F.col("exception_type") != "none").cast("int"))


@query()
def residual_type_model(spark, d):
    """How well types of uncovered exceptions are told apart, beside the types that gates leave out."""
    from panelworks.operators import models as mod

    found = mod.train_residual_models(_residual(spark, d), RESIDUAL_COLUMNS, rounds=10)
    return found.kind_metrics.crossJoin(found.gates.select("learnable_types", "skipped_types"))


@query()
def residual_exception_model(spark, d):
    """Rows that are required to be looked at although no detector rule fires, with probability and type."""
    from panelworks.operators import models as mod

    scored, _ = mod.residual_exception_model(_residual(spark, d), RESIDUAL_COLUMNS, rounds=10)
    return rul.combined_exception_output(scored).select("row_id", "residual_prob", "exception_probability", "exception_kind", "decided_by")


@query()
def predictability_ceiling(spark, d):
    from panelworks.operators import models as mod

    return mod.predictability_ceiling(_features(spark, d), "delinq_3", ENGINEERED, rounds=5)


@query()
def permutation_importance(spark, d):
    from panelworks.operators import models as mod

    df = _features(spark, d)
    columns = ["days_past_due", "loan_age_months", "current_status"]
    return mod.permutation_importance(mod.boosted_model(df, "delinq_3", columns, rounds=4), df, "delinq_3", columns)


@query()
def temporal_ensemble(spark, d):
    """Spread of scores of models from expanding windows, for the rows of the last months."""
    from panelworks.operators import models as mod

    df = _features(spark, d)
    late = df.where(F.col("reporting_month") >= F.lit("1998-01-01").cast("date"))
    return mod.temporal_ensemble(df, late, "delinq_3", ["days_past_due", "loan_age_months", "current_status"], rounds=3).select("row_id", "mean_prediction", "spread", "relative_spread")


def _chain(spark, d):
    """Latest rows, origin models with weights from later rows, empirical cells and the columns of both."""
    from panelworks.operators import models as mod

    columns = ["loan_age_months", "remaining_term_months", "interest_rate", "balance_ratio", "credit_score_band"]
    frame = checkpoint(tra.transition_frame(feat.amortisation(_panel(spark, d))))
    early, late = _halves(frame)
    cells = checkpoint(tra.empirical_matrix(early))
    models = mod.transition_model(early, columns)
    weights = mod.blend_weights(tra.one_step_scores(late, cells), models, columns)
    return feat.amortisation(rec.latest_per_loan(_panel(spark, d))), models, weights, cells, columns


@query()
def covariate_paths(spark, d):
    """Chains whose matrices follow the loans' covariates, with weights from later rows."""
    from panelworks.operators import models as mod

    loans, models, weights, cells, columns = _chain(spark, d)
    return tra.portfolio_curves(mod.covariate_paths(loans, models, weights, cells, tp.scenarios(spark), columns))


@query()
def cox_cause_specific(spark, d):
    from panelworks.operators import models as mod

    p = _panel(spark, d)
    events = tra.time_to_event(p).join(p.groupBy("loan_id").agg(F.min("interest_rate").alias("rate"), F.min("credit_score_band").alias("band")), "loan_id")
    return mod.cox_cause_specific(events, {"interest_rate": F.col("rate"), "band <620": (F.col("band") == "<620").cast("int"), "band 780+": (F.col("band") == "780+").cast("int")}, cause=2)


@query()
def tree_shap(spark, d):
    """Attributions to source columns for the rows of the last months."""
    from panelworks.operators import explain
    from panelworks.operators import models as mod

    df = _features(spark, d)
    columns = ["days_past_due", "loan_age_months", "current_status", "balance_ratio"]
    late = df.where(F.col("reporting_month") >= F.lit("1998-01-01").cast("date"))
    return explain.tree_shap(mod.boosted_model(df, "delinq_3", columns, rounds=5), late, columns)


@query()
def baseline_model(spark, d):
    from panelworks.operators import models as mod

    train, test = _parts(spark, d)
    fitted = mod.baseline_model(train.drop("p"), "delinq_3", MODEL_COLUMNS)
    return met.roc_auc(met.score_table(mod.score(fitted, test.drop("p"), MODEL_COLUMNS), "delinq_3", "p"))


@query()
def boosted_model(spark, d):
    from panelworks.operators import models as mod

    train, test = _parts(spark, d)
    fitted = mod.boosted_model(train.drop("p"), "delinq_3", MODEL_COLUMNS, rounds=10)
    return mod.score(fitted, test.drop("p"), MODEL_COLUMNS).select("row_id", "p")


#: Isotonic regression as the largest of the smallest means: over starts up to a value, of means to ends from it on.
ISOTONIC = """
g AS (SELECT p, row_number() OVER (ORDER BY p) AS k, sum(delinq_3) AS y, count(*) AS n, sum(delinq_3 * delinq_3 * 1.0) AS yy FROM marked GROUP BY p),
c AS (SELECT *, sum(y) OVER w AS sy, sum(n) OVER w AS sn FROM g WINDOW w AS (ORDER BY k)),
m AS (SELECT a.k AS a, b.k AS b, min((b.sy - a.sy + a.y)::DOUBLE / (b.sn - a.sn + a.n)) OVER (PARTITION BY a.k ORDER BY b.k DESC) AS least FROM c a JOIN c b ON b.k >= a.k),
i AS (SELECT b AS k, max(least) OVER (PARTITION BY b) AS v FROM m QUALIFY row_number() OVER (PARTITION BY b ORDER BY a) = 1),
o AS (SELECT round(v, 12) AS v, sum(n) AS n, sum(n * v * v - 2 * v * y + y) AS e FROM i JOIN g USING (k) GROUP BY 1)"""


@query("marked", f"""
WITH {ISOTONIC}
SELECT n, n_positive, n_distinct, tie_share, brier_isotonic, n >= 1000 AND n_positive >= 50 AND n_distinct / n::DOUBLE >= 0.05 AND tie_share <= 0.25 AS isotonic_kept FROM (
  SELECT CAST(sum(n) AS BIGINT) AS n, (SELECT CAST(sum(delinq_3) AS BIGINT) FROM marked) AS n_positive, count(*) AS n_distinct, max(n) / sum(n)::DOUBLE AS tie_share, sum(e) / sum(n)::DOUBLE AS brier_isotonic FROM o)""", "tie_share brier_isotonic")
def select_calibrator(spark, d):
    """What decides whether isotonic regression may be chosen, of its own output."""
    from panelworks.operators import models as mod

    c = mod.select_calibrator(_marked(spark, d), "delinq_3", "p")
    kept = c.n >= mod.LEAST_ROWS and c.n_positive >= mod.LEAST_POSITIVES and c.isotonic_kept_ranks
    return spark.createDataFrame([(c.n, c.n_positive, c.n_distinct, c.tie_share, c.brier_isotonic, kept)], "n long, n_positive long, n_distinct long, tie_share double, brier_isotonic double, isotonic_kept boolean")


@query()
def calibrators(spark, d):
    """The chosen calibrator and both forced ones, with what they make of the scores."""
    from panelworks.operators import models as mod

    rows = checkpoint(_marked(spark, d).select("delinq_3", "p"))
    out = [(m, mod.select_calibrator(rows, "delinq_3", "p", m)) for m in ("auto", "platt", "isotonic", "identity")]
    return spark.createDataFrame([(m, c.method, c.brier_raw, c.brier_platt, c.brier_isotonic, c.reason) for m, c in out], "asked string, method string, brier_raw double, brier_platt double, brier_isotonic double, reason string")


@query("marked", """
WITH r AS (SELECT credit_score_band, state, document_status, servicer_name FROM marked WHERE NOT """ + HALF + """),
t AS (SELECT 'state' AS c, state AS v FROM r UNION ALL SELECT 'document_status', document_status FROM r UNION ALL SELECT 'servicer_name', servicer_name FROM r),
n AS (SELECT c, v, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL), o AS (SELECT c, min_by(v, (-n, v)) AS mode FROM n GROUP BY c),
k AS (SELECT c, v FROM n WHERE n >= 400),
a AS (SELECT 'state' AS c, state AS v FROM marked UNION ALL SELECT 'document_status', document_status FROM marked UNION ALL SELECT 'servicer_name', servicer_name FROM marked)
SELECT c AS "column", CASE WHEN k.v IS NULL THEN '(rare)' ELSE k.v END AS level, count(*) AS n FROM (SELECT c, coalesce(v, mode) AS v FROM a JOIN o USING (c)) x LEFT JOIN k USING (c, v) GROUP BY ALL""")
def preprocess(spark, d):
    """Levels of three columns as learnt on later rows, with 400 rows as the bar, and applied to all."""
    from panelworks.operators.preprocess import encoder

    columns = ["state", "document_status", "servicer_name"]
    late, df = _halves(_marked(spark, d))[1], _marked(spark, d)
    fitted = encoder(late, columns, least=400).fit(late)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), fitted.level(c).alias("level")) for c in columns])
    return df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.level").agg(F.count("*").alias("n"))


@query("panel", "SELECT unnest(['credit_score_band', 'current_balance', 'current_status', 'days_past_due', 'document_status', 'interest_rate', 'loan_age_months', 'modification_flag', 'month_index', 'original_balance', 'remaining_term_months', 'servicer_name', 'source_system', 'state']) AS \"column\"")
def feature_columns(spark, d):
    """What models may use of the panel."""
    from panelworks.operators import models as mod

    df = feat.forward_labels(_panel(spark, d)).withColumn("constant", F.lit(1))
    return spark.createDataFrame([(c,) for c in mod.feature_columns(df)], "column string")


@query()
def linear_shap_model(spark, d):
    """Attributions of a fitted logistic regression for all rows, against the rows that it was fitted on."""
    from panelworks.operators import explain
    from panelworks.operators import models as mod

    df = _features(spark, d)
    early = _halves(df)[0]
    return explain.linear_shap(mod.baseline_model(early, "delinq_3", RAW_COLUMNS), df, early)


def _what_if_sides(spark, d):
    """(before, after, all rows with features): four kinds of overrides, of every 97th row."""
    from panelworks.operators import whatif

    p = written(_scored(spark, d))
    rates = checkpoint(feat.market_rates(p))
    features = lambda df: feat.quality_features(feat.band_ordinals(feat.history(feat.rate_incentive(feat.amortisation(df), rates))))
    kinds = [(1, "current_balance", 0.0, None), (2, "days_past_due", 60.0, "60DPD"), (3, "interest_rate", 9.0, None), (4, "nothing", 0.0, None)]
    kinds = spark.createDataFrame(kinds, "scenario_id int, field string, x double, status string")
    to = lambda c: F.when(F.col("field") == c, F.col("x")).alias(c)
    asked = p.where("row_id % 97 = 0").select("loan_id", "reporting_month").distinct().crossJoin(F.broadcast(kinds))
    overrides = asked.select("scenario_id", "loan_id", "reporting_month", *map(to, ("current_balance", "days_past_due", "interest_rate")), F.col("status").alias("current_status"))
    return *whatif.what_if_features(p, overrides, features), written(features(feat.forward_labels(p)))


@query()
def what_if_scores(spark, d):
    """Probabilities of trained models before and after four kinds of overrides, the fourth of which changes nothing."""
    from panelworks.operators import models as mod
    from panelworks.operators import whatif

    before, after, df = _what_if_sides(spark, d)
    columns = [*ENGINEERED, "rate_incentive", "data_quality_score"]
    return whatif.what_if_scores(before, after, [mod.train_binary_target(df, t, RAW_COLUMNS, columns, rounds=10, segments=()) for t in ("delinq_3", "prepay_12")])


@query()
def what_if_states(spark, d):
    """Next states of trained transition models before and after the same overrides."""
    from panelworks.operators import models as mod
    from panelworks.operators import whatif

    before, after, df = _what_if_sides(spark, d)
    columns = ["loan_age_months", "interest_rate", "balance_ratio", "days_past_due", "credit_score_band"]
    moves = written(tra.transition_frame(df.drop("next_state")).select("from_state", "to_state", *columns))
    return whatif.what_if_states(before, after, checkpoint(tra.empirical_matrix(moves)), mod.transition_model(moves, columns), columns)


#: One folder for each application and input: the queries on the file share its stages.
_FILES: dict[tuple[str, str], str] = {}
FILE_CUT = "1998-01-01"


def _scoring_file(spark, d):
    from panelworks.operators import submission

    key = spark.sparkContext.applicationId, d
    path = _FILES.setdefault(key, f"{shared_dir(spark).rstrip('/')}/submission-{uuid.uuid4().hex}")
    # The feed and both halves read the panel.
    panel = written(_panel(spark, d))
    early = F.col("reporting_month") < F.lit(FILE_CUT).cast("date")
    train, score = written(feat.forward_labels(panel.where(early))), panel.where(~early)
    columns = [*ENGINEERED, "remaining_term_months", "rate_incentive", "max_dpd_to_date", "data_quality_score", "servicer_update_lag_days"]
    return submission.score_panel(spark, train, score, tp.feed(panel), submission.Recipe(RAW_COLUMNS, columns, rounds=10), path), score


@query()
def score_submission(spark, d):
    """The scoring file of the panel's last months, every column by models and rules of the months before."""
    return _scoring_file(spark, d)[0].drop("row_id")


@query("flags", f"""
SELECT loan_id, strftime(reporting_month, '%Y-%m-%d') AS reporting_month, CAST(covered AS INT) AS exception_required_pred, assigned AS exception_type_pred FROM (
  SELECT *, {' OR '.join(r for r in RULES if r not in rul.ADVISORY)} AS covered, CASE {' '.join(f"WHEN {r} THEN '{t}'" for r, t in rul.TARGETS.items())} ELSE 'none' END AS assigned FROM flags)
WHERE reporting_month >= DATE '{FILE_CUT}'""")
def submission_rules(spark, d):
    """Keys of the scoring file, and what rules decide in it."""
    return _scoring_file(spark, d)[0].select("loan_id", "reporting_month", "exception_required_pred", "exception_type_pred")


@query()
def submission_checks(spark, d):
    """The checks of the scoring file that models made."""
    out, score = _scoring_file(spark, d)
    return sco.validate_submission(out, score)


@query()
def platt(spark, d):
    from panelworks.operators import models as mod

    train, test = _parts(spark, d)
    return mod.apply_platt(test, "p", mod.platt(train, "delinq_3", "p"), "q").select("row_id", "p", "q")


@query()
def isotonic(spark, d):
    from panelworks.operators import models as mod

    train, test = _parts(spark, d)
    return mod.isotonic(train, "delinq_3", "p").transform(test).select("row_id", "p", F.col("prediction").alias("q"))


@query()
def adversarial_validation(spark, d):
    from panelworks.operators import models as mod

    columns = ["current_balance", "interest_rate", "days_past_due", "state", "loan_age_months"]
    halves = [checkpoint(h) for h in _halves(_panel(spark, d))]
    runs = [mod.adversarial_validation(*halves, columns, with_time=t).withColumn("with_time", F.lit(t)) for t in (True, False)]
    return runs[0].unionByName(runs[1])


@query()
def transition_model(spark, d):
    from panelworks.operators import models as mod

    columns = ["loan_age_months", "interest_rate", "current_balance"]
    scored = _one_step(spark, d).select("row_id", "from_state", "to_state", *columns, "p")
    return mod.score_transitions(scored, mod.transition_model(scored, columns), columns).select("row_id", "from_state", F.aggregate("p_model", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("p_model").alias("top"))


def _sims(spark, d):
    from panelworks.operators import simulate

    p = _panel(spark, d)
    return simulate.monte_carlo(rec.latest_per_loan(p), tra.empirical_matrix(tra.transition_frame(p)), tp.scenarios(spark))


@query()
def monte_carlo(spark, d):
    return _sims(spark, d)


@query()
def mc_percentiles(spark, d):
    from panelworks.operators import simulate

    return simulate.mc_bands(_sims(spark, d))


@query()
def monte_carlo_covariates(spark, d):
    """Bands of all three shares by chains that follow the loans' covariates."""
    from panelworks.operators import models as mod
    from panelworks.operators import simulate

    loans, models, weights, cells, columns = _chain(spark, d)
    return simulate.mc_bands(simulate.monte_carlo_covariates(mod.covariate_matrices(loans, models, weights, cells, columns), tp.scenarios(spark)))


@query()
def cluster_bootstrap(spark, d):
    from panelworks.operators import simulate

    return simulate.cluster_bootstrap(_marked(spark, d), "delinq_3", "p")


@query()
def isolation_forest(spark, d):
    from panelworks.operators import simulate

    train, rest = _halves(written(_panel(spark, d)))
    # Written once: scaling first finds the ends of all scores.
    scored = written(simulate.isolation_forest(train, rest.select("row_id", *NUMS), NUMS).select("row_id", "raw", "anomaly_flagged"))
    return sco.anomaly_score(scored).select("row_id", "anomaly_score", "anomaly_flagged")


@query()
def anomaly_flags(spark, d):
    """Rows flagged beyond the training scores' quantile of 2 %, in the training half and in the other."""
    from panelworks.operators import simulate

    train, rest = _halves(written(_panel(spark, d)))
    forest = simulate.fit_isolation_forest(train, NUMS, contamination=0.02)
    both = forest.score(train.withColumn("half", F.lit("train"))).unionByName(forest.score(rest.withColumn("half", F.lit("rest"))))
    return both.groupBy("half").agg(F.count("*").alias("n"), F.sum(F.col("anomaly_flagged").cast("long")).alias("n_flagged"))


FOLDS = ["f1", "f2", "f3"]
FOLD_SQL = "SELECT *, ((row_id * 7) % 100 + 100) / 1000.0::DOUBLE AS f1, ((row_id * 11) % 100 + 100) / 1000.0::DOUBLE AS f2, ((row_id * 13) % 400) / 1000.0::DOUBLE AS f3 FROM marked"
SPREAD_SQL = f"""SELECT row_id, delinq_3, mean_prediction, spread, low, high, spread / greatest(mean_prediction, 1e-6) AS relative_spread FROM (
  SELECT *, (f1 + f2 + f3) / 3 AS mean_prediction, sqrt(((f1 - mean_prediction) ** 2 + (f2 - mean_prediction) ** 2 + (f3 - mean_prediction) ** 2) / 3) AS spread, least(f1, f2, f3) AS low, greatest(f1, f2, f3) AS high FROM ({FOLD_SQL}))"""


def _spread(spark, d):
    part = lambda a, n, plus: (((F.col("row_id") * a) % n) + plus).cast("double") / 1000
    return met.temporal_spread(_marked(spark, d).withColumns({"f1": part(7, 100, 100), "f2": part(11, 100, 100), "f3": part(13, 400, 0)}), FOLDS)


@query("marked", f"SELECT row_id, mean_prediction, spread, low, high, relative_spread FROM ({SPREAD_SQL})", "mean_prediction spread low high relative_spread")
def temporal_uncertainty(spark, d):
    return _spread(spark, d).select("row_id", "mean_prediction", "spread", "low", "high", "relative_spread")


@query("marked", f"SELECT avg(spread) AS mean_spread, quantile_cont(spread, 0.5) AS median_spread, CAST(count(*) FILTER (WHERE spread > mean_prediction) AS BIGINT) AS n_wide, 100.0 * count(*) FILTER (WHERE spread > mean_prediction) / count(*) AS pct_wide FROM ({SPREAD_SQL})", "mean_spread median_spread pct_wide")
def spread_summary(spark, d):
    return met.spread_summary(_spread(spark, d))


@query("marked", """
SELECT band, count(*) AS n, avg(y) AS observed_rate, avg(p) AS mean_predicted, avg((p - y) * (p - y)) AS brier, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE AS roc_auc FROM (
  SELECT *, rank() OVER (PARTITION BY band ORDER BY p) + (count(*) OVER (PARTITION BY band, p) - 1) / 2.0::DOUBLE AS r FROM (
    SELECT p, delinq_3 AS y, CASE WHEN p <= lo THEN 'high' WHEN p <= hi THEN 'medium' ELSE 'low' END AS band FROM marked, (SELECT quantile_cont(p, 1.0::DOUBLE / 3) AS lo, quantile_cont(p, 2.0::DOUBLE / 3) AS hi FROM marked)))
GROUP BY band HAVING count(*) >= 50""", "observed_rate mean_predicted brier roc_auc")
def band_check(spark, d):
    return met.band_check(met.confidence_band(_marked(spark, d), "p"), "delinq_3", "p")


@query("marked", f"""
SELECT corr(a, b) AS spearman FROM (SELECT rank() OVER (ORDER BY relative_spread) + (count(*) OVER (PARTITION BY relative_spread) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (ORDER BY mean_prediction) + (count(*) OVER (PARTITION BY mean_prediction) - 1) / 2.0::DOUBLE AS b FROM (SELECT row_id, round(relative_spread, 9) AS relative_spread, round(mean_prediction, 9) AS mean_prediction FROM ({SPREAD_SQL})))""", "spearman")
def spearman(spark, d):
    df = _spread(spark, d).withColumns({c: F.round(c, 9) for c in ("relative_spread", "mean_prediction")})
    return met.spearman(df, "relative_spread", "mean_prediction")


AUDIT = "SELECT props AS provider, CASE WHEN event_type = 'error' THEN 'down' END AS error, CASE WHEN value < 5 THEN ' ' ELSE 'said' END AS output, value < 50 AS accepted, value AS latency_ms, CASE WHEN value >= 80 THEN ['numeric_grounding', 'non_empty'] WHEN value >= 50 THEN ['no_causal_claims'] END AS failed FROM events"


def _log(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        F.col("props").alias("provider"), F.when(F.col("event_type") == "error", "down").alias("error"), F.when(v < 5, " ").otherwise("said").alias("output"), (v < 50).alias("accepted"), v.alias("latency_ms"),
        F.when(v >= 80, F.array(F.lit("numeric_grounding"), F.lit("non_empty"))).when(v >= 50, F.array(F.lit("no_causal_claims"))).alias("failed_checks"),
    )


@query("", f"""
SELECT provider, n_calls, n_errors, n_empty, n_accepted, n_rejected, n_accepted + n_rejected AS reached_check, median_latency_ms, coalesce(n_rejected / nullif(n_accepted + n_rejected, 0)::DOUBLE, 0) AS rejection_rate FROM (
  SELECT provider, count(*) AS n_calls, count(*) FILTER (WHERE error IS NOT NULL) AS n_errors, count(*) FILTER (WHERE error IS NULL AND trim(output) = '') AS n_empty,
    count(*) FILTER (WHERE error IS NULL AND trim(output) <> '' AND accepted) AS n_accepted, count(*) FILTER (WHERE error IS NULL AND trim(output) <> '' AND NOT accepted) AS n_rejected,
    list_sort(list(coalesce(latency_ms, 0)))[count(*) // 2 + 1] AS median_latency_ms FROM ({AUDIT}) GROUP BY provider)""", "median_latency_ms rejection_rate")
def audit_summary(spark, d):
    return txt.audit_summary(_log(spark, d))


@query("", f"""SELECT "check", count(*) AS n FROM (SELECT unnest(failed) AS "check" FROM ({AUDIT}) WHERE error IS NULL AND trim(output) <> '' AND NOT accepted) GROUP BY 1""")
def rejections_by_check(spark, d):
    return txt.rejections_by_check(_log(spark, d))


@query("", "SELECT task, CAST(attempt AS INT) AS attempt, substr(sha256(coalesce(prompt, '')), 1, 16) AS prompt_sha256_16, prompt FROM (SELECT CAST(conv_id AS VARCHAR) AS task, turn AS attempt, text AS prompt FROM conversations)")
def append_audit_log(spark, d):
    """Two appends to one log, read back."""
    path = f"{shared_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    rows = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("task"), F.col("turn").cast("int").alias("attempt"), F.col("text").alias("prompt"))
    for part in (rows.where("attempt % 2 = 0"), rows.where("NOT attempt <=> 0 AND NOT attempt % 2 <=> 0")):
        audit_log.append_audit_log(part, path)
    return audit_log.read_audit_log(spark, path).select("task", "attempt", "prompt_sha256_16", "prompt")


@query("", f"""
SELECT b.item_id, min(h.doc_id) FILTER (WHERE h.rank = 1) AS doc_id, count(h.rank) > 0 AS covered, coalesce(min(d.text) FILTER (WHERE h.rank = 1), '{txt.NOT_COVERED}') AS answer,
  coalesce(string_agg(CAST(h.doc_id AS VARCHAR), '; ' ORDER BY h.rank), '') AS citations
FROM benchmark b LEFT JOIN ({SQL['tfidf_search']}) h ON h.item_id = b.item_id LEFT JOIN documents d ON d.doc_id = h.doc_id GROUP BY b.item_id""")
def answer_lookup(spark, d):
    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    return txt.answer_lookup(bench, txt.tfidf_search(docs, bench), docs)


@query("scored rated hist static", f"""
SELECT s.row_id, s.row_id AS score_order, h.balance_ratio, r.rate_incentive, CAST(h.months_delinquent_to_date AS BIGINT) AS months_delinquent_to_date, s.data_quality_score, t.ltv_band,
  CASE t.dti_band WHEN '<=30' THEN 25 WHEN '31-36' THEN 33 WHEN '37-43' THEN 40 END AS dti_band_ordinal
FROM scored s JOIN rated r USING (row_id) JOIN hist h USING (row_id) LEFT JOIN static t ON t.loan_id = s.loan_id WHERE NOT s.{HALF}""", "balance_ratio rate_incentive data_quality_score")
def scoring_frame(spark, d):
    def everything(df):
        flagged = rul.rule_scores(rul.evaluate_rules(rec.reconcile(df, tp.feed(_panel(spark, d)))))
        return feat.engineer_features(qual.record_quality(flagged))[0]

    out = feat.scoring_frame(*_halves(_panel(spark, d)), everything, tp.static(spark, d))
    return out.select("row_id", "score_order", "balance_ratio", "rate_incentive", "months_delinquent_to_date", "data_quality_score", "ltv_band", "dti_band_ordinal")


# The derived tables, and the query that each is made by.
DERIVED = {
    "rule_flags": "evaluate_rules", "top_anomalies": "worst_records", "scenario_curves": "portfolio_curves", "segment_impacts": "segment_impacts", "monte_carlo_curves": "mc_percentiles",
    "exception_output": "combined_exception_output", "reviewer_examples": "reviewer_queue", "uncertainty": "temporal_uncertainty",
}


def _derived(name: str, source: str) -> None:
    def run(spark, d):
        path = f"{shared_dir(spark).rstrip('/')}/derived-{uuid.uuid4().hex}/{name}"
        pack.write_derived(QUERIES[source](spark, d), path)
        return spark.read.parquet(path)

    QUERIES[f"derived_{name}"] = run
    if source in SQL:
        SQL[f"derived_{name}"] = SQL[source]


for _name, _source in DERIVED.items():
    _derived(_name, _source)
