"""Small frames with exact results for the panel operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelworks.operators import features, metrics, quality, reconcile, rules, scoring, text, transitions
from panelworks.plans import testpanel
from panelworks.schema import STATES

COLUMNS = (
    "row_id long, loan_id string, month_index long, reporting_month date, origination_month date, loan_age_months long, remaining_term_months long, current_status string, days_past_due long, "
    "current_balance double, original_balance double, modification_flag int, document_status string, last_updated_at date, source_system string, interest_rate double"
)


def month(i):
    return dt.date(2022 + i // 12, i % 12 + 1, 1)


def row(loan, i, n=0, **over):
    base = {
        "row_id": i * 10 + n, "loan_id": loan, "month_index": i, "reporting_month": month(i), "origination_month": month(0), "loan_age_months": i, "remaining_term_months": 360 - i,
        "current_status": "Current", "days_past_due": 0, "current_balance": 100000.0 - 100 * i, "original_balance": 100000.0, "modification_flag": 0, "document_status": "Complete",
        "last_updated_at": month(i) + dt.timedelta(days=4), "source_system": "A", "interest_rate": 5.0,
    }
    return tuple((base | over).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def fired(df, rule):
    return sorted(r["row_id"] for r in rules.evaluate_rules(df.withColumn("source_conflict", F.lit(False))).where(rule).collect())


def test_balance_rule_stays_within_a_loan(spark):
    df = frame(spark, row("a", 0), row("a", 1, current_balance=120000.0), row("a", 2, current_balance=130000.0, modification_flag=1), row("b", 3, current_balance=500000.0))
    assert fired(df, "balance_non_increasing") == [10]
    assert fired(df, "balance_within_original") == [10, 30]


def test_terminal_rule_flags_the_row_that_came_back(spark):
    df = frame(spark, row("a", 0), row("a", 1, current_status="Default", days_past_due=120), row("a", 2), row("a", 3, current_status="Default", days_past_due=120), row("b", 4))
    assert fired(df, "terminal_state_immutability") == [20]


def test_row_rules(spark):
    df = frame(
        spark, row("a", 0, reporting_month=dt.date(2021, 11, 1)), row("a", 1, current_status="30DPD", days_past_due=10), row("a", 2, current_status="Prepaid", document_status=None),
        row("a", 3, current_status="Default", days_past_due=100, document_status="Pending"), row("a", 4, last_updated_at=month(1)), row("a", 5, days_past_due=None),
    )
    assert fired(df, "date_order_valid") == [0]
    assert fired(df, "dpd_status_consistency") == [10]
    assert fired(df, "document_completeness_at_closure") == [20]
    assert fired(df, "stale_record") == [0, 40]


def test_reconciliation(spark):
    panel = frame(spark, row("a", 0), row("a", 1, days_past_due=None), row("a", 2), row("b", 3))
    feed = spark.createDataFrame(
        [("a", month(0), "Current", 0, month(0), 1, 150000.0), ("a", month(0), "Current", 0, month(0), 2, 100000.0), ("a", month(1), "Current", None, month(4), 3, 99900.0), ("x", month(0), "Current", 0, month(0), 4, 1.0)],
        "loan_id string, reporting_month date, current_status string, days_past_due long, last_updated_at date, seq long, current_balance double",
    )
    out = {r["row_id"]: r for r in reconcile.reconcile(panel, feed).collect()}
    assert [out[i]["has_servicer_record"] for i in (0, 10, 20, 30)] == [True, True, False, False]
    assert not out[0]["source_conflict"] and not out[10]["source_conflict"] and out[10]["source_stale"]
    assert [r["loan_id"] for r in reconcile.orphan_feed_rows(panel, feed).collect()] == ["x"]
    none = reconcile.reconcile(panel, None)
    assert set(none.columns) == set(reconcile.reconcile(panel, feed).columns)
    assert none.where("source_conflict OR source_stale").count() == 0


def test_static_keys_must_be_unique(spark):
    panel = frame(spark, row("a", 0))
    with pytest.raises(ValueError):
        reconcile.attach_static(panel, spark.createDataFrame([("a", 1), ("a", 2)], "loan_id string, x int"))
    with pytest.raises(ValueError):
        reconcile.require_columns(panel.drop("current_status"))


def test_history_looks_back_only(spark):
    rows = [row("a", i, current_status=s, days_past_due=d) for i, (s, d) in enumerate([("Current", 0), ("30DPD", 30), ("60DPD", 60), ("Current", 0), ("30DPD", 31)])]
    names = ["months_delinquent_to_date", "delinquency_streak", "n_status_changes_to_date", "max_dpd_to_date"]
    get = lambda rs: [tuple(r[n] for n in names) for r in features.history(features.amortisation(frame(spark, *rs))).orderBy("row_id").collect()]
    full = get(rows)
    assert full == [(0, 0, 0, 0), (1, 1, 1, 30), (2, 2, 2, 60), (2, 0, 3, 60), (3, 1, 4, 60)]
    rows[-1] = row("a", 4, current_status="Default", days_past_due=999)
    assert get(rows)[:4] == full[:4]


def test_split_is_purged(spark):
    df = frame(spark, *[row("a", i) for i in range(30)])
    parts = features.time_aware_split(df, horizon=3).groupBy("part").agg(F.max("month_index").alias("hi"), F.min("month_index").alias("lo"), F.count("*").alias("n"))
    got = {r["part"]: (r["lo"], r["hi"], r["n"]) for r in parts.collect()}
    assert got == {"train": (0, 20, 21), "purged": (21, 23, 3), "test": (24, 29, 6)}
    # Sixty months, a purge of three: a fifth of them is tested on, from the calendar month after the purge.
    long = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(60)]
    assert features.split_months(long, 3) == (dt.date(2023, 9, 1), dt.date(2024, 1, 1))
    assert features.split_months(long[:6], 3) == (long[1], long[5])  # too short for both: what is left is tested on
    holes = [m for m in long if m.month != 1]
    assert features.split_months(holes, 3)[1] == features.add_months(features.split_months(holes, 3)[0], 4)
    assert features.add_months(dt.date(2023, 10, 31), 4) == dt.date(2024, 2, 29)
    with pytest.raises(ValueError):
        features.time_aware_split(frame(spark, row("a", 0)), 3)


def test_folds_keep_a_least_training_window(spark):
    df = frame(spark, *[row("a", i) for i in range(60)])
    start = df.agg(F.min("reporting_month")).first()[0]
    at = lambda i: features.add_months(start, i)
    got = [tuple(r) for r in features.walk_forward_folds(df, 4, 3).collect()]
    assert got == [(k + 1, at(12 + 11 * k), at(16 + 11 * k), at(12 + 11 * k + 14)) for k in range(4)]
    with pytest.raises(ValueError):
        features.walk_forward_folds(frame(spark, *[row("a", i) for i in range(18)]), 4, 3)


def test_manifest_and_market_rate(spark):
    rows = [row("a", 0, interest_rate=9.0), row("b", 0, interest_rate=5.0)]
    df = frame(spark, *rows).withColumn("original_interest_rate", F.lit(4.0))
    assert [r["market_rate"] for r in features.market_rates(df).collect()] == [4.0]
    assert [r["market_rate"] for r in features.market_rates(frame(spark, *rows)).collect()] == [7.0]
    _, manifest = features.engineer_features(frame(spark, *rows).drop("interest_rate"))
    by = {m["step"]: m for m in manifest}
    assert by["amortisation"] == {"step": "amortisation", "built": False, "added": [], "missing": ["interest_rate"]}
    assert by["quality_features"]["built"] and "data_quality_score" in by["quality_features"]["added"]


def test_threshold_and_bands(spark):
    table = metrics.score_table(spark.createDataFrame([(1, 0.9), (0, 0.5)], "y int, p double"), "y", "p")
    assert metrics.choose_threshold(table).first()["threshold"] == 0.5  # the lowest of equal recalls
    df = spark.createDataFrame([(0.2,), (0.25,), (0.5,), (0.76,), (None,)], "relative_spread double")
    assert [r["confidence"] for r in metrics.confidence_band(df, fixed=(0.25, 0.75)).collect()] == ["high", "high", "medium", "low", "unknown"]
    zero = metrics.temporal_spread(spark.createDataFrame([(0.0, 0.0), (0.0, 2e-6)], "a double, b double"), ["a", "b"]).collect()
    assert [r["relative_spread"] for r in zero] == [0.0, 1.0]


def walk(spark):
    states = ["Current", "Current", "30DPD", "Current", "60DPD", "90DPD", "Default"]
    return frame(spark, *[row(f"l{k}", i, k, current_status=states[(i + k) % 7 if i < 5 else 0]) for k in range(6) for i in range(12) if (k, i) != (2, 6)])


def test_transitions_leave_out_gaps_and_ends(spark):
    loss = transitions.transition_losses(walk(spark)).first()
    assert (loss["n_rows"], loss["n_without_successor"], loss["n_gaps"]) == (71, 6, 1)
    cells = transitions.empirical_matrix(transitions.transition_frame(walk(spark)))
    sums = cells.groupBy("bucket", "from_state").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 36 and all(math.isclose(r["s"], 1) for r in sums)
    stay = cells.where("from_state IN ('Default', 'Prepaid') AND from_state = to_state").select("p").distinct().collect()
    assert [r["p"] for r in stay] == [1.0]


def test_paths_and_stress(spark):
    panel = walk(spark)
    cells = transitions.empirical_matrix(transitions.transition_frame(panel))
    paths = transitions.simulate_paths(reconcile.latest_per_loan(panel), cells, testpanel.scenarios(spark)).cache()
    curves = {(r["scenario"], r["month"]): r for r in transitions.portfolio_curves(paths).collect()}
    assert all(math.isclose(sum(r["p"]), 1, abs_tol=1e-9) and min(r["p"]) >= 0 for r in paths.collect())
    for s in ("base", "adverse_credit"):
        cif = [curves[s, m]["cif_default"] for m in range(13)]
        assert cif == sorted(cif)
    assert curves["adverse_credit", 12]["cif_default"] > curves["base", 12]["cif_default"]
    assert curves["high_prepayment", 12]["cif_prepaid"] > curves["base", 12]["cif_prepaid"]


def test_survival_curves(spark):
    events = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 2, 1), ("d", 3, 0)], "loan_id string, duration long, event int")
    got = [(r["duration"], round(r["cif_default"], 6), round(r["one_minus_km"], 6)) for r in transitions.aalen_johansen(events).orderBy("duration").collect()]
    assert got == [(1, 0.25, 0.25), (2, 0.5, 0.5), (3, 0.5, 0.5)]


def test_metrics_by_hand(spark):
    rows = [(i, s, y) for i, (s, y) in enumerate([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1), (0.4, 0)])]
    df = spark.createDataFrame(rows, "row_id long, p double, y int")
    table = metrics.score_table(df, "y", "p")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / 9
    assert math.isclose(metrics.roc_auc(table).first()["roc_auc"], want)
    bins = metrics.reliability_bins(df, "y", "p", 4).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [2, 2, 1, 1]


def test_prefix_sums_do_not_depend_on_partitions(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("k"), F.col("id").alias("v"))
    sums = [sorted(tuple(r) for r in metrics.prefix_sums(df, "k", ["v"], n).collect()) for n in (1, 8)]
    assert sums[0] == sums[1] and len(sums[0]) == 100


def test_psi(spark):
    a = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit("c").alias("s"))
    same = quality.drift_report(a, a, ["x"], ["s"]).collect()
    assert all(abs(r["psi"]) < 1e-9 and r["band"] == "stable" for r in same)
    moved = quality.drift_report(a, a.select((F.col("x") + 500).alias("x"), F.lit("d").alias("s")), ["x"], ["s"]).collect()
    assert all(r["band"] == "material" for r in moved)


def test_action_order(spark):
    base = {"exception_required_pred": 0, "anomaly_score": 0.0, "next_12m_default_prob": 0.0, "next_3m_delinquency_prob": 0.0, "next_12m_prepayment_prob": 0.0}
    cases = [({}, "NO ACTION"), ({"next_12m_prepayment_prob": 0.4}, "MONITOR - elevated"), ({"next_3m_delinquency_prob": 0.1}, "MONITOR - early"), ({"next_3m_delinquency_prob": 0.25}, "REVIEW - elevated near"), ({"next_12m_default_prob": 0.05, "next_3m_delinquency_prob": 0.9}, "REVIEW - elevated 12"), ({"anomaly_score": 0.9, "next_12m_default_prob": 1.0}, "REVIEW - unusual"), ({"exception_required_pred": 1, "anomaly_score": 1.0}, "REVIEW - data")]
    for over, start in cases:
        df = spark.createDataFrame([tuple((base | over).values())], "exception_required_pred int, anomaly_score double, next_12m_default_prob double, next_3m_delinquency_prob double, next_12m_prepayment_prob double")
        assert df.select(scoring.recommend_action().alias("a")).first()["a"].startswith(start)


def test_text(spark):
    df = spark.createDataFrame([("Default is caused by 1,234.5 and 7%",), (None,)], "text string")
    rows = text.phrase_flags(df).withColumn("n", text.extract_numbers(F.col("text"))).collect()
    assert rows[0]["has_causal"] and rows[0]["cites_number"] and [tuple(n) for n in rows[0]["n"]] == [("1,234.5", 1234.5, False), ("7%", 7.0, True)]
    assert rows[1]["is_empty"] and rows[1]["n"] == []


def test_every_state_is_in_the_counts(spark):
    counts = transitions.transition_counts(transitions.transition_frame(walk(spark)))
    assert counts.count() == len(STATES) ** 2


def test_sampled_paths_lie_around_the_curve(spark):
    from panelworks.operators import simulate

    panel = walk(spark)
    cells, loans = transitions.empirical_matrix(transitions.transition_frame(panel)), reconcile.latest_per_loan(panel)
    many = loans.crossJoin(spark.range(60)).withColumn("loan_id", F.concat("loan_id", F.lit("-"), F.col("id").cast("string")))
    curve = {(r["scenario"], r["month"]): r["cif_default"] for r in transitions.portfolio_curves(transitions.simulate_paths(many, cells, testpanel.scenarios(spark))).collect()}
    sims = simulate.monte_carlo(many, cells, testpanel.scenarios(spark), n_sims=100)
    for r in simulate.mc_percentiles(sims).where("month = 12").collect():
        assert abs(r["mean"] - curve[r["scenario"], 12]) < 0.02 and r["p5"] <= r["p50"] <= r["p95"]


def test_isolation_forest_finds_the_odd_row(spark):
    from panelworks.operators import simulate

    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") * 7919 % 101).cast("double").alias("a"), F.when(F.col("id") == 77, 5000.0).otherwise((F.col("id") * 104729 % 97).cast("double")).alias("b"))
    scored = scoring.anomaly_score(simulate.isolation_forest(df, df, ["a", "b"], trees=50, sample=128)).orderBy(F.desc("anomaly_score"))
    assert scored.first()["row_id"] == 77


def test_audit_log(spark, tmp_path):
    from panelworks.sources import audit_log

    path = f"{tmp_path}/log"
    assert audit_log.read_audit_log(spark, path).count() == 0
    records = spark.createDataFrame([("p", "t", "x", 1.0), (None, "t", "y", 2.0)], "prompt string, task string, context string, latency_ms double")
    audit_log.append_audit_log(records, path)
    with open(f"{path}/more.json", "w") as f:
        f.write('{"prompt": "q", "accepted": true}\nnot json\n')
    rows = {r["prompt"]: r for r in audit_log.read_audit_log(spark, path).collect()}
    assert set(rows) == {"p", None, "q"} and len(rows["p"]["prompt_sha256_16"]) == 16


def test_isolation_forest_samples_tables_of_any_size(spark):
    from panelworks.operators import simulate

    # Less than one row in a million is picked for a tree.
    train = spark.range(4_000_000).select(F.col("id").alias("row_id"), (F.col("id") % 101).cast("double").alias("a"))
    raw = simulate.isolation_forest(train, train.limit(200), ["a"], trees=8, sample=3).select("raw").distinct().collect()
    assert len(raw) > 1 and all(-1 < r["raw"] < 0 for r in raw)


def test_pooled_keeps_every_level_of_enough_rows(spark):
    from panelworks.operators import models

    df = spark.range(3003).select(F.when(F.col("id") < 3000, F.concat(F.lit("l"), F.col("id") % 1500)).when(F.col("id") < 3002, F.lit(None)).otherwise("rare").alias("c"))
    got = {r["c"]: r["count"] for r in models.pooled(df, ["c"], least=2).groupBy("c").count().collect()}
    assert len(got) == 1501 and got["(rare)"] == 1 and got["l0"] == 4 and got["l1499"] == 2
