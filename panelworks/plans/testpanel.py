"""The loan panel that queries and tests derive from the star-schema tables.

A supplier is a loan and a ship month a reporting month; states, gaps, repeats and defects come from
integer arithmetic. The SQL texts run in Spark and in DuckDB; Spark makes the panel's repeats in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.session import table

PANEL = """
WITH lines AS (
  SELECT l_suppkey AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS m,
         CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS ln,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r
  FROM lineitem),
agg AS (
  SELECT k, m, COUNT(*) AS n, SUM(q) AS q, SUM(ln) AS ln, SUM(r) AS r FROM lines GROUP BY k, m),
base AS (
  SELECT a.*, MIN(m) OVER (PARTITION BY k) AS o,
         CAST((q * 7 + ln * 13 + r * 29) % 100 AS INT) AS h FROM agg a),
st AS (
  SELECT *, CAST((year(m) - year(o)) * 12 + month(m) - month(o) AS BIGINT) AS idx,
    CASE WHEN h < 80 THEN 'Current' WHEN h < 90 THEN '30DPD' WHEN h < 95 THEN '60DPD'
         WHEN h < 98 THEN '90DPD' WHEN h < 99 THEN 'Default' ELSE 'Prepaid' END AS s,
    CAST(100000 + 1000 * (k % 400) AS BIGINT) AS ob FROM base),
dup AS (SELECT *, 0 AS copy FROM st UNION ALL SELECT *, 1 AS copy FROM st WHERE q % 97 = 0)
SELECT CAST(k * 2000 + idx * 2 + copy AS BIGINT) AS row_id,
  CAST(k AS STRING) AS loan_id, idx AS month_index,
  CASE WHEN q % 211 = 0 THEN CAST(o - INTERVAL 2 MONTH AS DATE) ELSE m END AS reporting_month,
  o AS origination_month, idx AS loan_age_months, 360 - idx AS remaining_term_months,
  CAST(ob AS DOUBLE) AS original_balance,
  CAST(ob * (1000 - 2 * idx) * CASE WHEN q % 83 = 0 THEN 15 ELSE 10 END AS DOUBLE) / 10000.0 AS current_balance,
  CAST(300 + (k % 40) * 10 AS DOUBLE) / 100.0 AS interest_rate,
  CASE k % 6 WHEN 0 THEN '<620' WHEN 1 THEN '620-659' WHEN 2 THEN '660-699' WHEN 3 THEN '700-739'
       WHEN 4 THEN '740-779' ELSE '780+' END AS credit_score_band,
  CASE WHEN k % 5 = 0 AND q % 10 = 0 THEN 'california' WHEN k % 5 = 0 THEN 'CA'
       WHEN k % 5 = 1 THEN 'TX' WHEN k % 5 = 2 THEN 'NY' WHEN k % 5 = 3 THEN 'FL' ELSE 'WA' END AS state,
  s AS current_status,
  CAST(CASE s WHEN 'Current' THEN CASE WHEN q % 61 = 0 THEN 5 ELSE 0 END WHEN '30DPD' THEN 30
       WHEN '60DPD' THEN 60 WHEN '90DPD' THEN 95 WHEN 'Default' THEN 150 ELSE 0 END AS BIGINT) AS days_past_due,
  CASE WHEN q % 89 = 0 THEN 1 ELSE 0 END AS modification_flag,
  CASE WHEN ln % 31 = 0 THEN NULL WHEN ln % 13 = 0 THEN 'Missing' WHEN ln % 7 = 0 THEN 'Pending' ELSE 'Complete' END AS document_status,
  CASE k % 3 WHEN 0 THEN 'LOS_A' WHEN 1 THEN 'LOS_B' ELSE 'Core' END AS source_system,
  CASE WHEN q % 47 = 0 THEN NULL ELSE CONCAT('Servicer ', CAST(k % 5 AS STRING)) END AS servicer_name,
  CAST(m + CAST(q % 10 AS INT) * INTERVAL 1 DAY AS DATE) AS last_updated_at
FROM dup
"""

#: A second source for some of the rows, with conflicts, stale stamps, orphans and repeated keys.
FEED = """
SELECT loan_id, reporting_month, current_status, days_past_due,
  CASE WHEN row_id % 21 = 0 THEN CAST(last_updated_at - INTERVAL 120 DAY AS DATE) ELSE last_updated_at END AS last_updated_at,
  row_id AS seq,
  CASE WHEN row_id % 3 = 1 THEN current_balance * 1.25 ELSE current_balance END AS current_balance
FROM panel WHERE row_id % 7 = 0
UNION ALL
SELECT CONCAT('X', loan_id), reporting_month, current_status, days_past_due, last_updated_at, row_id + 100000000, current_balance
FROM panel WHERE row_id % 35 = 0
UNION ALL
SELECT loan_id, reporting_month, current_status, days_past_due, last_updated_at, row_id + 200000000, current_balance * 0.75
FROM panel WHERE row_id % 77 = 0
"""

#: One row for each loan; columns that the panel lacks.
STATIC = """
SELECT CAST(s_suppkey AS STRING) AS loan_id,
  CASE s_suppkey % 5 WHEN 0 THEN '<=60' WHEN 1 THEN '61-70' WHEN 2 THEN '71-80' WHEN 3 THEN '81-90' ELSE '>95' END AS ltv_band,
  CASE s_suppkey % 4 WHEN 0 THEN '<=30' WHEN 1 THEN '31-36' WHEN 2 THEN '37-43' ELSE '21-30' END AS dti_band,
  CASE s_suppkey % 3 WHEN 0 THEN 'Purchase' WHEN 1 THEN 'Refinance' ELSE 'CashOut' END AS loan_purpose,
  CAST(1990 + s_suppkey % 8 AS BIGINT) AS vintage
FROM supplier
"""

#: Three macro scenarios, as multipliers of transition probabilities.
SCENARIOS = [
    # Name, default, delinquency and prepayment multiplier.
    ("base", 1.0, 1.0, 1.0),
    ("adverse_credit", 1.85, 1.55, 0.55),
    ("high_prepayment", 0.9, 0.92, 2.2),
]


#: The repeats of PANEL, and the same rows from one pass: Spark would read and group all lines once for each side of the union.
_TWICE = "SELECT *, 0 AS copy FROM st UNION ALL SELECT *, 1 AS copy FROM st WHERE q % 97 = 0"
_ONCE = "SELECT *, explode(CASE WHEN q % 97 = 0 THEN array(0, 1) ELSE array(0) END) AS copy FROM st"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PANEL.replace(_TWICE, _ONCE).replace("FROM lineitem)", "FROM {lineitem})"), lineitem=table(spark, sf_dir, "lineitem"))


def feed(panel_df: DataFrame) -> DataFrame:
    return panel_df.sparkSession.sql(FEED.replace("FROM panel", "FROM {panel}"), panel=panel_df)


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATIC.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, default_mult double, delinq_mult double, prepay_mult double")
