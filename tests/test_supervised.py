"""Encoding, boosting, calibration, counterfactual scores and the scoring file."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from panelworks.operators import boosting, explain, features, metrics, models, reconcile, rules, scoring, simulate, submission, transitions, whatif
from panelworks.operators.preprocess import RARE, PanelEncoder, encoder
from panelworks.plans import testpanel
from panelworks.schema import STATES
from panelworks.session import checkpoint


def vectors(df):
    return [list(r["features"]) for r in df.select("features").collect()]


def test_encoder_learns_once_and_applies_the_same_map(spark, tmp_path):
    rows = [(float(i), "a") for i in range(30)] + [(None, "b")] * 20 + [(float("nan"), None)] * 7 + [(1.0, f"rare{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "x double, c string").repartition(3)
    fitted = encoder(df, ["x", "c"], scale=True, least=10).fit(df)
    assert [n for n, _ in fitted.places()] == ["x", "c=a", "c=b", f"c={RARE}"] and [s for _, s in fitted.places()] == ["x", "c", "c", "c"]
    values = np.array([float(i) for i in range(30)] + [1.0] * 3)
    median = np.sort(values)[len(values) // 2]  # of an odd number
    filled = np.concatenate([values, np.full(27, median)])
    new = spark.createDataFrame([(None, "rare0"), (float(filled.mean() + filled.std()), None), (0.0, "never seen"), (0.0, "b")], "x double, c string")
    got = vectors(fitted.transform(new))
    assert np.allclose([g[0] for g in got], [(median - filled.mean()) / filled.std(), 1.0, -filled.mean() / filled.std(), -filled.mean() / filled.std()])
    # A rare level, and one that was not there, score as they were fitted; a missing one is the mode.
    assert [g[1:] for g in got] == [[0, 0, 1], [1, 0, 0], [0, 0, 1], [0, 1, 0]]
    fitted.write().overwrite().save(f"file://{tmp_path}/encoder")
    again = type(fitted).load(f"file://{tmp_path}/encoder")
    assert vectors(again.transform(new)) == got and again.places() == fitted.places()


def test_encoder_of_odd_columns(spark):
    df = spark.createDataFrame([(None, None, "u"), (None, None, "v")], "x double, c string, d string")
    fitted = PanelEncoder(numbers=["x"], names=["c", "d"], least=5).fit(df)
    assert vectors(fitted.transform(df)) == [[0.0, 1.0, 1.0], [0.0, 1.0, 1.0]]
    few = spark.createDataFrame([("a",)] * 3 + [(None,)] * 4, "c string")
    assert PanelEncoder(names=["c"], least=5).fit(few).learnt["levels"]["c"] == ["a", ["a"]]  # rows without a value count for the mode
    # The number of jobs does not follow the number of columns.
    wide = spark.range(50).select(*[(F.col("id") % (i + 2)).cast("string").alias(f"c{i}") for i in range(12)], *[F.col("id").cast("double").alias(f"n{i}") for i in range(12)])
    jobs = []
    for n in (2, 12):
        spark.sparkContext.setJobGroup(f"enc{n}", "")
        PanelEncoder(numbers=[f"n{i}" for i in range(n)], names=[f"c{i}" for i in range(n)], least=1).fit(wide)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"enc{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def three_classes(spark, n=900):
    r = np.random.default_rng(0)
    a, b, c = r.normal(size=n), r.integers(0, 5, n), r.choice(["x", "y", "z"], n)
    y = np.where(a > 0.5, 2, np.where((c == "x") & (b > 2), 1, 0))
    y = np.where(r.random(n) < 0.1, r.integers(0, 3, n), y)
    rows = [(i, float(a[i]), int(b[i]), str(c[i]), ["late", "fine", "gone"][y[i]], float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b int, c string, kind string, y double").repartition(4)


def slow_boosting(x, y, edges, rounds, depth, rate, ridge):
    """Softmax boosting in plain numpy on all rows at once; margins."""
    bins = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    k = int(y.max()) + 1
    prior = np.log(np.bincount(y, minlength=k) / len(y))
    z = np.tile(prior, (len(y), 1))

    def grow(rows, g, h, out, level):
        if level == depth:
            return
        best, total = None, np.array([g[rows].sum(), h[rows].sum()])
        for j in range(x.shape[1]):
            for cut in range(edges.shape[1]):
                left = rows[bins[rows, j] <= cut]
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = total - (gl, hl)
                if hl >= 1e-3 and hr >= 1e-3:
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total[0] ** 2 / (total[1] + ridge)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, j, cut
        if best:
            for part in (rows[bins[rows, best[1]] <= best[2]], rows[bins[rows, best[1]] > best[2]]):
                out[part] = -rate * g[part].sum() / (h[part].sum() + ridge)
                grow(part, g, h, out, level + 1)

    for _ in range(rounds):
        p, step = boosting.softmax(z), np.zeros_like(z)
        for c in range(k):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])
            step[:, c] = -rate * g.sum() / (h.sum() + ridge)
            grow(np.arange(len(y)), g, h, step[:, c], 0)
        z = z + step
    return z


def test_boosting_against_numpy(spark):
    df = three_classes(spark, 300)
    enc = encoder(df, ["a", "b", "c"], scale=False).fit(df)
    told = checkpoint(enc.transform(df))
    estimator = boosting.BoostedClasses(labelCol="y", rounds=7, depth=2, bins=8)
    fitted = estimator.fit(told)
    rows = fitted.transform(told).select("features", "y", "probability").collect()
    x, y = np.array([list(r["features"]) for r in rows]), np.array([int(r["y"]) for r in rows])
    from pyspark.ml.functions import vector_to_array

    edges = estimator._edges(told.select(vector_to_array("features").alias("x")), x.shape[1])
    want = boosting.softmax(slow_boosting(x, y, edges, 7, 2, 0.1, 1.0))
    assert np.allclose([list(r["probability"]) for r in rows], want, atol=1e-5)
    again = boosting.BoostedClasses(labelCol="y", rounds=7, depth=2, bins=8).fit(told.repartition(1))  # however rows are dealt
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(fitted.rounds, again.rounds))


def test_boosted_classes_beat_forests(spark):
    df = three_classes(spark)
    train, test = df.where("row_id % 3 > 0").withColumn("kind", F.when(F.col("row_id") % 50 > 0, F.col("kind"))), df.where("row_id % 3 = 0")
    model, known = models.multiclass_model(train, "kind", ["a", "b", "c"], ["fine", "gone", "late"], rounds=15)
    assert known == ["fine", "gone", "late"]
    place = {s: i for i, s in enumerate(known)}
    loss = lambda rows: -np.mean([np.log(max(r["probability"][place[r["kind"]]], 1e-9)) for r in rows])
    rows = model.transform(test).select("probability", "kind").collect()
    assert all(np.isclose(sum(r["probability"]), 1) for r in rows)
    label = F.array_position(F.array(*[F.lit(s) for s in known]), F.col("kind")).cast("double") - 1
    enc = model.stages[0]
    forest = RandomForestClassifier(labelCol="_y", numTrees=20, maxDepth=6, seed=7).fit(enc.transform(train.where("kind IS NOT NULL").withColumn("_y", label)))
    assert loss(rows) < loss(forest.transform(enc.transform(test)).select("probability", "kind").collect())
    one = boosting.BoostedClasses(labelCol="y").fit(enc.transform(df.where("y = 1")))
    assert np.allclose([list(r[0])[1] for r in one.transform(enc.transform(test)).select("probability").collect()], 1, atol=0.01)


def test_calibrator_is_judged_by_its_output(spark):
    r = np.random.default_rng(5)
    p = r.random(4000)
    rows = [(float(x), int(r.random() < 0.02 + 0.3 * (x > 0.6))) for x in p]  # two levels: isotonic merges all but a few values
    df = spark.createDataFrame(rows, "p double, y int").repartition(3)
    c = models.select_calibrator(df, "y", "p")
    assert c.method == "platt" and not c.isotonic_kept_ranks and c.reason == "isotonic merges the ranks" and c.brier_isotonic < c.brier_platt
    assert models.select_calibrator(df, "y", "p", "isotonic").method == "isotonic" and models.select_calibrator(df, "y", "p", "identity").fitted is None
    few = models.select_calibrator(df.limit(400), "y", "p")
    assert few.n_distinct is None and few.method in ("platt", "identity")
    assert models.select_calibrator(df.where("y = 0"), "y", "p").method == "identity"
    with pytest.raises(ValueError):
        models.select_calibrator(df, "y", "p", "best")
    for method in ("platt", "isotonic", "identity"):
        out = models.select_calibrator(df, "y", "p", method).apply(df, "p", "q")
        assert out.columns == ["p", "y", "q"] and out.where("q BETWEEN 0 AND 1").count() == 4000


def test_linear_attributions_add_up(spark):
    df = three_classes(spark, 400).withColumn("t", (F.col("y") == 2).cast("int"))
    model = models.baseline_model(df.where("row_id < 300"), "t", ["a", "b", "c"])
    values = explain.linear_shap(model, df, df.where("row_id < 300")).collect()
    assert {v["source"] for v in values} == {"a", "b", "c"} and len(values) == 3 * 400
    sums = {}
    for v in values:
        sums[v["row_id"]] = sums.get(v["row_id"], v["base"]) + v["value"]
    p = {r["row_id"]: r["p"] for r in models.score(model, df, ["a", "b", "c"]).collect()}
    assert all(np.isclose(sums[i], np.log(p[i] / (1 - p[i]))) for i in p)
    held = explain.linear_shap(model, df.where("row_id < 300"), df.where("row_id < 300")).groupBy("source").agg(F.avg("value").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in held)


def test_permutation_in_one_pass(spark):
    df = three_classes(spark, 500).withColumn("t", (F.col("y") == 2).cast("int"))
    model = models.boosted_model(df, "t", ["a", "b", "c"], rounds=4)
    got = {r["column"]: r["auc_drop"] for r in models.permutation_importance(model, df, "t", ["a", "b", "c"]).collect()}
    # The same by a loop, with numpy in the place of the joins.
    rows = df.select("row_id", "a", "b", "c", "t", F.xxhash64("row_id", F.lit("rows")).alias("h"), *[F.xxhash64("row_id", F.lit(c)).alias(f"h_{c}") for c in "abc"]).toPandas().sort_values(["h", "row_id"])
    auc = lambda p: metrics.roc_auc(metrics.score_table(models.score(model, spark.createDataFrame(p, "row_id long, a double, b int, c string, t int"), ["a", "b", "c"], "_p"), "t", "_p")).first()[0]
    plain = rows[["row_id", "a", "b", "c", "t"]]
    for c in "abc":
        dealt = plain.assign(**{c: rows.sort_values([f"h_{c}", "row_id"])[c].to_numpy()})
        assert np.isclose(got[c], auc(plain) - auc(dealt)), c
    assert max(got, key=got.get) == "a"


def long_panel(spark, loans=70, months=48):
    """A panel of many loans with slow movements, so that every stage has something to learn."""
    i, m = F.floor(F.col("id") / months), (F.col("id") % months).cast("int")
    h = lambda *by: F.pmod(F.xxhash64(*by), F.lit(1000))
    late = F.when(h(i, F.floor(m / 4), F.lit("late")) < 120 + 6 * F.pmod(i, F.lit(20)), True).otherwise(False)
    gone = h(i, F.lit("gone"))
    status = F.when(gone < F.least(m * 6, F.lit(120)), "Default").when(gone > 1000 - F.least(m * 9, F.lit(250)), "Prepaid").when(late & (m % 4 == 3), "60DPD").when(late, "30DPD").otherwise("Current")
    base = spark.range(loans * months).select(
        F.col("id").alias("row_id"), F.concat(F.lit("l"), i).alias("loan_id"), m.cast("long").alias("month_index"), F.add_months(F.lit("2020-01-01").cast("date"), m).alias("reporting_month"),
        F.lit("2020-01-01").cast("date").alias("origination_month"), m.cast("long").alias("loan_age_months"), (360 - m).cast("long").alias("remaining_term_months"),
        F.lit(200000.0).alias("original_balance"), (200000.0 - 400 * m - F.pmod(i, F.lit(20)) * 100 + h(F.col("id")) / 1000).alias("current_balance"), (3 + F.pmod(i, F.lit(9)) / 2).alias("interest_rate"),
        F.when(F.pmod(i, F.lit(3)) == 0, "<620").otherwise("700-739").alias("credit_score_band"), F.lit("TX").alias("state"), status.alias("current_status"),
        F.lit(0).alias("modification_flag"), F.when(h(F.col("id"), F.lit("doc")) < 60, "Missing").otherwise("Complete").alias("document_status"), F.lit("Core").alias("source_system"), F.lit("Servicer 1").alias("servicer_name"),
        F.date_add(F.add_months(F.lit("2020-01-01").cast("date"), m), 3).alias("last_updated_at"),
    )
    dpd = F.when(F.col("current_status") == "30DPD", 35).when(F.col("current_status") == "60DPD", 65).when(F.col("current_status") == "Default", 120).otherwise(0)
    return base.withColumn("days_past_due", dpd.cast("long"))


COLUMNS = ["loan_age_months", "days_past_due", "interest_rate", "balance_ratio", "credit_score_band", "current_status", "data_quality_score"]


def feed_of(panel):
    return panel.where("row_id % 5 = 0").select("loan_id", "reporting_month", "current_status", "days_past_due", "last_updated_at", F.col("row_id").alias("seq"), (F.col("current_balance") * F.when(F.col("row_id") % 3 == 0, 1.2).otherwise(1.0)).alias("current_balance"))


def test_what_if_with_trained_scores(spark):
    panel = checkpoint(features.forward_labels(long_panel(spark)).withColumn("data_quality_score", F.lit(70.0)))
    prepare = lambda df: features.quality_features(features.history(features.amortisation(df)))
    fitted = models.train_binary_target(checkpoint(prepare(panel)), "delinq_3", COLUMNS[:3], COLUMNS, rounds=4)
    asked = panel.where("row_id % 211 = 0").select("loan_id", "reporting_month", "current_balance", "days_past_due", "current_status", "interest_rate")
    nothing = asked.withColumn("scenario_id", F.lit(1))
    late = asked.select(F.lit(2).alias("scenario_id"), "loan_id", "reporting_month", F.lit(None).cast("double").alias("current_balance"), F.lit(65).cast("long").alias("days_past_due"), F.lit("60DPD").alias("current_status"), F.lit(None).cast("double").alias("interest_rate"))
    pretty = nothing.unionByName(late).withColumns({"data_quality_score": F.lit(100.0), "no_such_column": F.lit(1)})
    before, after = whatif.what_if_features(panel, pretty, prepare)
    n = asked.count()
    assert before.count() == after.count() == 2 * n
    # The record's own columns are the same on both sides, whatever the override says.
    assert {r[0] for r in before.unionByName(after).select("data_quality_score").distinct().collect()} == {70.0}
    assert {r[0] for r in after.select("rule_violation_count").distinct().collect()} == {0}
    scores = whatif.what_if_scores(before, after, [fitted]).collect()
    assert len(scores) == 2 * n and {s["target"] for s in scores} == {"delinq_3"}
    assert all(s["change_pp"] == 0 and s["changed"] == "" and s["baseline_band"] == s["scenario_band"] for s in scores if s["scenario_id"] == 1)
    moved = [s for s in scores if s["scenario_id"] == 2 and s["change_pp"] != 0]
    assert moved and all("days_past_due" in s["changed"] or "current_status" in s["changed"] for s in moved)
    direct = {r["row_id"]: r["q"] for r in fitted.score(after.where("scenario_id = 2"), "q").collect()}
    assert all(np.isclose(s["scenario"], direct[s["row_id"]]) for s in scores if s["scenario_id"] == 2)
    moves = checkpoint(transitions.transition_frame(prepare(panel).drop("next_state")))
    cells = checkpoint(transitions.empirical_matrix(moves))
    names = ["loan_age_months", "days_past_due"]
    states = whatif.what_if_states(before, after, cells, models.transition_model(moves, names, least_rows=100), names).collect()
    assert len(states) == 2 * n and all(s["baseline_state"] == s["scenario_state"] and np.isclose(s["baseline_confidence"], s["scenario_confidence"]) for s in states if s["scenario_id"] == 1)
    assert {s["scenario_state"] for s in states} <= set(STATES)


def test_scoring_file_from_models(spark, tmp_path):
    panel = checkpoint(long_panel(spark))
    early = F.col("month_index") < 40
    train, score, feed = features.forward_labels(panel.where(early)), panel.where(~early), feed_of(panel)
    recipe, path = submission.Recipe(COLUMNS[:3], COLUMNS, rounds=2, trees=20, method="platt"), f"file://{tmp_path}/chain"
    out = submission.score_panel(spark, train, score, feed, recipe, path)
    assert out.columns == ["row_id", *scoring.TEMPLATE] and out.count() == score.count()
    failed = {r["check"] for r in scoring.validate_submission(out, score).where("NOT passed").collect()}
    assert not {f for f in failed if not f.startswith("ties")}, failed
    distinct = out.agg(*[F.count_distinct(c).alias(c) for c in scoring.TEMPLATE]).first().asDict()
    assert all(n > 1 for n in distinct.values()), distinct
    flagged = rules.evaluate_rules(reconcile.reconcile(reconcile.union_panels(panel.where(early), panel.where(~early)), feed)).where("origin = 'score'")
    assert {(r["row_id"], r["x"]) for r in flagged.select("row_id", rules.rule_covered().cast("int").alias("x")).collect()} == {(r["row_id"], r["exception_required_pred"]) for r in out.collect()}
    # A chain that was stopped goes on with the first table that is not there in full.
    stages = submission.Stages(spark, path)
    assert all(stages.done(s) for s in ("frame", "probabilities", "anomalies", "file"))
    (tmp_path / "chain" / "anomalies" / "_SUCCESS").unlink()
    (tmp_path / "chain" / "file" / "_SUCCESS").unlink()
    before = out.toPandas().sort_values("row_id").reset_index(drop=True)
    again = submission.score_panel(spark, train, score, feed, recipe, path).toPandas().sort_values("row_id").reset_index(drop=True)
    assert again.equals(before)


def test_covariate_draws_follow_the_curve(spark):
    panel = checkpoint(long_panel(spark))
    frame = checkpoint(transitions.transition_frame(features.amortisation(panel)))
    cells, names = checkpoint(transitions.empirical_matrix(frame)), ["loan_age_months", "balance_ratio"]
    fitted = models.transition_model(frame, names, least_rows=100)
    loans, scenarios = checkpoint(features.amortisation(reconcile.latest_per_loan(panel))), testpanel.scenarios(spark)
    weights = dict.fromkeys(fitted, 0.6)
    steps = models.covariate_matrices(loans, fitted, weights, cells, names, 6)
    draws = simulate.monte_carlo_covariates(steps, scenarios, 6, 200)
    assert draws.count() == 3 * 200 * 7
    n = loans.count()
    paths = models.covariate_paths(loans, fitted, weights, cells, scenarios, names, 6)
    want = {(r["scenario"], r["month"]): r for r in paths.groupBy("scenario", "month").agg(*[F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(6)]).collect()}
    bands = {(r["share"], r["scenario"], r["month"]): r for r in simulate.mc_bands(draws).collect()}
    for (scenario, month), row in want.items():
        for share, mean in (("share_default", row["p4"]), ("share_prepaid", row["p5"]), ("share_delinquent", row["p1"] + row["p2"] + row["p3"])):
            got = bands[share, scenario, month]
            assert abs(got["mean"] - mean) < 5 * np.sqrt(0.25 / (n * 200)) and got["p5"] <= got["p50"] <= got["p95"], (scenario, month, share)


def test_transition_estimator_is_a_plug(spark):
    frame = checkpoint(transitions.transition_frame(long_panel(spark)))
    cells, names = checkpoint(transitions.empirical_matrix(frame)), ["loan_age_months", "days_past_due", "credit_score_band"]
    fitted = models.transition_model(frame, names, least_rows=100, estimator=lambda: RandomForestClassifier(numTrees=5, maxDepth=3, seed=1))
    assert fitted and all(isinstance(m, PipelineModel) and m.stages[-1].getNumTrees == 5 for m, _ in fitted.values())
    rows = models.score_transitions(transitions.one_step_scores(frame, cells), fitted, names).select("from_state", "p_model").collect()
    for r in rows:
        assert np.isclose(sum(r["p_model"]), 1)
        if r["from_state"] in fitted:
            assert all(p == 0 for p, s in zip(r["p_model"], STATES) if s not in fitted[r["from_state"]][1])


def test_anomaly_flags_by_offset(spark):
    train = spark.range(1000).select(F.col("id").alias("row_id"), F.rand(1).alias("a"), F.randn(2).alias("b"))
    train = checkpoint(train)
    forest = simulate.fit_isolation_forest(train, ["a", "b"], trees=30, contamination=0.05)
    assert forest.score(train).where("anomaly_flagged").count() == 50
    odd = spark.createDataFrame([(1, 0.5, 0.0), (2, 9.0, 30.0), (3, None, None)], "row_id long, a double, b double")
    assert {r["row_id"]: r["anomaly_flagged"] for r in forest.score(odd).collect()} == {1: False, 2: True, 3: False}
    assert simulate.fit_isolation_forest(train, ["a"], trees=5).offset == -0.5


def test_residual_types(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(1600):
        kind = "none" if r.random() < 0.7 else str(r.choice(["late", "doc", "odd"], p=[0.5, 0.48, 0.02]))
        rows.append((i, i % 40, kind, {"late": 3.0, "doc": -3.0}.get(kind, 0.0) + float(r.normal())))
    df = spark.createDataFrame(rows, "row_id long, m int, exception_type string, x double").withColumns({"reporting_month": F.add_months(F.lit("2020-01-01").cast("date"), F.col("m")), "exception_required": (F.col("exception_type") != "none").cast("int"), "anomaly_score": F.lit(0.1)})
    df = df.withColumns({name: F.lit(False) for name in rules.REGISTRY}).withColumn("date_order_valid", F.col("row_id") % 50 == 0)
    found = models.train_residual_models(df, ["x"], rounds=8)
    gates = found.gates.first()
    assert gates["learnable_types"] == "doc,late" and gates["skipped_types"].startswith("odd ") and gates["trainable"]
    assert found.kind_metrics.first()["macro_f1"] > 0.9 and found.required_metrics is not None
    out = rules.combined_exception_output(found.score(df)).collect()
    assert len(out) == 1600
    for r_ in out:
        if r_["row_id"] % 50 == 0:
            assert r_["decided_by"] == "rule" and r_["residual_prob"] is None and r_["residual_type"] is None
        elif r_["residual_prob"] >= 0.5:
            assert r_["decided_by"] == "residual model" and r_["exception_kind"] == r_["residual_type"] in ("doc", "late")
        else:
            assert r_["exception_kind"] == "none"
    shown = rules.reviewer_queue(rules.combined_exception_output(found.score(df)), drivers=df.select("row_id", F.lit("x above").alias("drivers"))).collect()
    assert shown and all(r_["drivers"] == "x above" for r_ in shown)
