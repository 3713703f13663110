"""Models, simulations and metrics against definitions worked out in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import explain, features, metrics, models, reconcile, scoring, simulate, text, transitions
from panelworks.plans import testpanel
from panelworks.schema import ABSORBING, STATES
from panelworks.session import checkpoint
from tests.test_panel import walk


def test_quantiles(spark):
    r = np.random.default_rng(1)
    groups = {"a": r.integers(0, 9, 200).astype(float), "b": r.normal(size=57), "c": np.array([4.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("d", None)]
    qs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.95, 1.0]
    got = {x["g"]: (x["n"], x["q"]) for x in metrics.quantiles(spark.createDataFrame(rows, "g string, x double"), qs).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and np.allclose(got[g][1], np.quantile(xs, qs))
    wide = metrics.quantile_row(spark.createDataFrame([(1, None), (3, None)], "x long, y double"), {"x": F.col("x"), "y": F.col("y")}, [0.5], "q_").first()
    assert wide["q_x"] == [2.0] and wide["q_y"] is None


def auc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    pos, neg = y == 1, y == 0
    gain = (s[pos][:, None] > s[neg][None, :]) + (s[pos][:, None] == s[neg][None, :]) / 2
    return (gain * w[pos][:, None] * w[neg][None, :]).sum() / (w[pos].sum() * w[neg].sum())


def average_precision(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    out = 0.0
    for t in np.unique(s):
        top, here = s >= t, s == t
        if w[top].sum():
            out += w[here & (y == 1)].sum() * w[top & (y == 1)].sum() / w[top].sum()
    return out / w[y == 1].sum()


def test_auc_by_group(spark):
    r = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", int(r.integers(0, 2)), float(r.integers(0, 20)) / 20) for i in range(300)] + [("c", 1, 0.5), ("a", None, 0.1)]
    got = {x["g"]: x for x in metrics.auc_by_group(spark.createDataFrame(rows, "g string, y int, s double")).collect()}
    for g in "ab":
        y, s = (np.array(v) for v in zip(*[(y, s) for k, y, s in rows if k == g and y is not None]))
        assert np.isclose(got[g]["roc_auc"], auc(y, s)) and np.isclose(got[g]["pr_auc"], average_precision(y, s)) and np.isclose(got[g]["pr_auc_lift"], average_precision(y, s) / y.mean())
    assert got["c"]["roc_auc"] is None and got["c"]["pr_auc"] is None


def test_bootstrap_is_exact(spark):
    r = np.random.default_rng(3)
    rows = [(f"l{i % 40}", int(r.random() < 0.3), float(r.integers(0, 30)) / 30) for i in range(400)]
    df = spark.createDataFrame(rows, "loan_id string, y int, p double").repartition(5)
    got = {x["metric"]: x for x in simulate.cluster_bootstrap(df, "y", "p", n=60).collect()}
    seeds = np.array([x["h"] for x in spark.createDataFrame([(k,) for k, _, _ in rows], "k string").select(F.xxhash64("k").alias("h")).collect()])
    w = np.searchsorted(simulate._POISSON, simulate.uniform(seeds[:, None], np.arange(60)), side="right")
    y, s = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    for name, f in (("roc_auc", auc), ("pr_auc", average_precision)):
        want = np.percentile([f(y, s, w[:, k].astype(float)) for k in range(60)], [2.5, 97.5])
        assert np.allclose([got[name]["low"], got[name]["high"]], want) and got[name]["n_usable"] == 60
    few = simulate.cluster_bootstrap(df.where("y = 0"), "y", "p", n=40).collect()
    assert all(x["low"] is None and x["n_usable"] == 0 for x in few)


def test_spearman(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [3.0, 1.0, 4.0, 4.0, 8.0]
    rank = lambda x: [sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2 for u in x]
    got = metrics.spearman(spark.createDataFrame([*zip(a, b), (None, 1.0)], "a double, b double"), "a", "b").first()["spearman"]
    assert np.isclose(got, np.corrcoef(rank(a), rank(b))[0, 1])


def test_stress(spark):
    r = np.random.default_rng(4)
    m = r.random((6, 6))
    m /= m.sum(axis=1, keepdims=True)
    for i, s in enumerate(STATES):
        if s in ABSORBING:
            m[i] = np.eye(6)[i]
    df = spark.createDataFrame([(m.tolist(), *x) for x in ((1.0, 1.0, 1.0), (1.85, 1.55, 0.55), (50.0, 50.0, 50.0), (0.0, 0.0, 0.0))], "m array<array<double>>, d double, l double, q double")
    for k, row in enumerate(df.select("d", "l", "q", transitions.stressed(F.col("m"), F.col("d"), F.col("l"), F.col("q")).alias("s")).collect()):
        got, want = np.array(row["s"]), m.copy()
        mult = np.array([[0 if i == j else [1, row["l"], row["d"], row["q"]][kind] for j, kind in enumerate(kinds)] for i, kinds in enumerate(transitions._stress_kinds())])
        for i in range(4):
            cells = m[i] * mult[i]
            cells[i] = m[i][i] - sum(cells[j] - m[i][j] for j in range(6) if j != i)
            cells = np.maximum(cells, 0)
            want[i] = cells / cells.sum()
        assert np.allclose(got, m if k == 0 else want) and np.allclose(got.sum(axis=1), 1) and np.allclose(got[4:], m[4:])


def test_chains_with_covariates(spark):
    panel = walk(spark).withColumn("row_id", F.xxhash64("loan_id", "month_index"))
    cells, loans = transitions.empirical_matrix(transitions.transition_frame(panel)), features.amortisation(reconcile.latest_per_loan(panel))
    names = ["loan_age_months", "balance_ratio"]
    want = {(r["row_id"], r["scenario"], r["month"]): r["p"] for r in transitions.simulate_paths(loans, cells, testpanel.scenarios(spark)).collect()}
    got = {(r["row_id"], r["scenario"], r["month"]): r["p"] for r in models.covariate_paths(loans, {}, {}, cells, testpanel.scenarios(spark), names).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    frame = features.amortisation(transitions.transition_frame(walk(spark).crossJoin(spark.range(30)).withColumns({"loan_id": F.concat("loan_id", F.col("id").cast("string")), "row_id": F.col("row_id") + F.col("id") * 1000}).drop("id")))
    fitted = models.transition_model(frame, names, least_rows=50)
    weights = models.blend_weights(transitions.one_step_scores(frame, cells), fitted, names)
    assert fitted and set(weights) == set(fitted) and all(0 <= w <= 1 for w in weights.values())
    paths = models.covariate_paths(loans, fitted, dict.fromkeys(fitted, 0.7), cells, testpanel.scenarios(spark), names).collect()
    assert len(paths) == len(want) and all(np.isclose(sum(r["p"]), 1) and min(r["p"]) >= 0 for r in paths)


def test_projected_balance(spark):
    df = spark.createDataFrame([(0.9, 6.0, 12, 348), (0.9, 0.0, 12, 348), (0.9, 6.0, 360, 0), (None, 6.0, 1, 2)], "balance_ratio double, interest_rate double, loan_age_months long, remaining_term_months long")
    got = transitions.advance_covariates(df, F.lit(6)).collect()
    g = 1.005
    left = lambda k: (g**360 - g**k) / (g**360 - 1)
    assert np.isclose(got[0]["balance_ratio"], 0.9 * left(18) / left(12)) and got[1]["balance_ratio"] == 0.9 and got[3]["balance_ratio"] is None
    assert [(r["loan_age_months"], r["remaining_term_months"]) for r in got] == [(18, 342), (18, 342), (366, 0), (7, 0)]


def test_cox(spark):
    r = np.random.default_rng(6)
    x = np.column_stack([r.normal(size=400), r.integers(0, 2, 400)]).astype(float)
    t = np.ceil(r.exponential(8 / np.exp(0.8 * x[:, 0] - 0.5 * x[:, 1]))).astype(int).clip(1, 30)
    e = np.where(t == 30, 0, r.choice([1, 1, 2], 400))
    df = spark.createDataFrame([(int(t[i]), int(e[i]), float(x[i, 0]), float(x[i, 1])) for i in range(400)], "duration long, event int, a double, b double")
    got = {c["covariate"]: c["coef"] for c in models.cox_cause_specific(df, {"a": F.col("a"), "b": F.col("b"), "same": F.lit(1.0)}).collect()}
    assert got["same"] == 0.0
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    b = np.array([got["a"], got["b"]]) * x.std(axis=0, ddof=1)
    grad = -0.1 * b
    for i in np.flatnonzero(e == 1):
        risk = t >= t[i]
        w = np.exp(z[risk] @ b)
        grad += (z[i] - (w[:, None] * z[risk]).sum(axis=0) / w.sum()) / 400
    assert np.abs(grad).max() < 1e-6 and got["a"] > 0 > got["b"]


def test_tree_attributions_add_up(spark):
    r = np.random.default_rng(7)
    rows = [(i, float(r.normal()), float(r.integers(0, 5)), str(r.choice(["x", "y", "z"]))) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, c, int(a + (c == "x") > 0.4)) for i, a, b, c in rows], "row_id long, a double, b double, ab string, y int")
    names = ["a", "b", "ab"]
    model = models.boosted_model(df, "y", names, rounds=4)
    raw = {x["row_id"]: x["rawPrediction"][1] for x in model.transform(df).select("row_id", "rawPrediction").collect()}
    sums, base, sources = {}, set(), set()
    for x in explain.tree_shap(model, df, names).collect():
        sums[x["row_id"]] = sums.get(x["row_id"], 0.0) + x["value"]
        base.add(round(x["base"], 9))
        sources.add(x["source"])
    assert sources == {"a", "b", "ab"} and len(base) == 1
    assert all(np.isclose(sums[i] + next(iter(base)), raw[i], atol=1e-6) for i in raw)
    # Two features that matter alike share a product of theirs.
    leaf = [(1.0, ((0, 0.5, False, 0.5), (1, 0.5, False, 0.5)))]
    values, start = explain.attributions(np.array([[1.0, 1.0], [0.0, 1.0]]), [leaf], [1.0])
    assert start == 0.25 and np.allclose(values, [[0.375, 0.375], [-0.375, 0.125]])


def test_recombined_states(spark):
    df = spark.createDataFrame([(0.2, [0.5, 0.3, 0.2, 0.0, 0.0, 0.0], "Current"), (0.0, [0.0] * 6, "60DPD"), (0.4, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], "Current")], "c double, d array<double>, s string")
    got = [r["p"] for r in df.select(models.recombine(F.col("c"), F.col("d"), F.col("s")).alias("p")).collect()]
    assert np.allclose(got, [[0.8, 0.12, 0.08, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0.6, 0, 0, 0, 0, 0]])


def test_target_and_residual_gates(spark):
    loan, m = F.floor(F.col("id") / 40), F.col("id") % 40
    panel = spark.range(80 * 40).select(
        F.col("id").alias("row_id"), F.concat(F.lit("l"), loan).alias("loan_id"), m.alias("month_index"), F.add_months(F.lit("2020-01-01").cast("date"), m.cast("int")).alias("reporting_month"),
        m.alias("loan_age_months"), F.when(F.pmod(F.xxhash64(loan, F.floor(m / 3)), F.lit(5)) == 0, "30DPD").otherwise("Current").alias("current_status"),
    )
    df = checkpoint(features.forward_labels(panel).withColumn("days_past_due", F.when((F.col("delinq_3") == 1) & (F.col("row_id") % 7 > 0), 9).otherwise(0)))
    parts = models.target_parts(df, "delinq_3")
    span = {k: parts[k].agg(F.min("month_index"), F.max("month_index")).first() for k in ("fit", "calibration", "test")}
    assert [tuple(span[k]) for k in ("fit", "calibration", "test")] == [(0, 18), (22, 26), (30, 36)] and parts["n_immature"] == 3 * 80
    fitted = models.train_binary_target(df, "delinq_3", ["loan_age_months"], ["days_past_due", "loan_age_months"], rounds=3)
    scored = fitted.score(df, "q")
    assert scored.columns == [*df.columns, "q"] and scored.where("q BETWEEN 0 AND 1").count() == df.count() and fitted.champion in ("baseline", "boosted")
    flagged = df.withColumns({r: F.lit(False) for r in ("balance_non_increasing", "date_order_valid", "dpd_status_consistency", "terminal_state_immutability", "document_completeness_at_closure", "servicer_source_agreement", "balance_within_original", "stale_record")})
    few = flagged.withColumns({"exception_required": (F.col("row_id") == 0).cast("int"), "exception_type": F.lit("none")})
    out, gates = models.residual_exception_model(few, ["days_past_due"])
    assert not gates.first()["enough"] and out.where("residual_prob IS NOT NULL").count() == 0
    many = flagged.withColumns({"exception_required": F.col("delinq_3"), "exception_type": F.when(F.col("delinq_3") == 1, "late").otherwise("none")})
    out, gates = models.residual_exception_model(many, ["days_past_due"], rounds=2)
    assert fitted.metrics.count() == 3 and fitted.metrics.where("calibrated").count() == 1
    assert gates.first()["trainable"] and gates.first()["learnable_types"] == "late" and out.where("residual_prob IS NULL").count() == 0


def test_numbers_and_grounds(spark):
    cases = {
        "4.32% of $1,250,000 across 3 months, -0.5 delta": [4.32, 1250000.0, 3.0, -0.5], "2023-09-01": [2023.0, 9.0, 1.0], "2023\u201109\u201101": [2023.0, 9.0, 1.0],
        "13\u202f104.95": [13104.95], "0.71 123 loans": [0.71, 123.0], "next_3m": [3.0], "(-4, -5 =-6 a-7": [-4.0, -5.0, -6.0, 7.0], "1\u00a0234\u00a0567": [1234567.0], "no": [], "\ue0005": [5.0],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: [n["value"] for n in r["n"]] for r in df.select("t", text.extract_numbers(F.col("t")).alias("n")).collect()}
    assert got == cases
    notes = {"the estimate is 4.32%": [], "roughly 4.3%": [], "over the next 3 months": [], "4.32%, well below the 8.7% portfolio average": ["8.7%"], "a 6.67% decline": [], "in 2023-09": [], "of 0.09": ["0.09"], "": [], "+12.4 deviations": []}
    rows = spark.createDataFrame([(k,) for k in notes], "note string")
    out = text.numeric_grounding(rows, "note", F.array(F.lit(0.0432), F.lit(-0.06666), F.lit(None).cast("double"), F.lit(12.4)), text.literal_numbers(F.lit("next_3m"), F.lit("2023-09-01"))).collect()
    assert {r["note"]: r["ungrounded"] for r in out} == notes and all(r["grounded"] == (not notes[r["note"]]) for r in out)
    bad = spark.createDataFrame([("We are certain: 50% and 10%",), ("none",), (None,)], "t string").select(text.probability_mismatch(F.col("t"), F.lit(0.5)).alias("m")).collect()
    assert [r["m"] for r in bad] == [[0.1], [], []]


def test_chunks_and_answers(spark):
    page = "intro\n# Fields\n| Field | Meaning |\n|---|:--|\n| ltv_band | loan to value band of the borrower | x |\n| dti_band | debt to income band |\n> quoted " + "q" * 50 + "\n\n## Notes\n" + "prose " * 9 + "\n| one |"
    docs = spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["section"], r["kind"], r["name"], r["passage"].strip()) for r in text.corpus_chunks(docs).orderBy("line").collect()]
    assert got == [("Fields", "field", "ltv_band", "ltv_band: loan to value band of the borrower"), ("Fields", "field", "dti_band", "dti_band: debt to income band"), ("Notes", "prose", None, ("prose " * 9).strip())]
    passages = text.corpus_chunks(docs).select(F.col("line").cast("long").alias("doc_id"), F.col("passage").alias("text"), "name")
    asked = spark.createDataFrame([(1, "what is the ltv_band?"), (2, "favourite colour of the borrower, loan to value"), (3, None)], "item_id long, text string")
    answers = {r["item_id"]: (r["covered"], r["answer"]) for r in text.answer_lookup(asked, text.tfidf_search(passages, asked, name="name"), passages).collect()}
    assert answers == {1: (True, "ltv_band: loan to value band of the borrower"), 2: (False, text.NOT_COVERED), 3: (False, text.NOT_COVERED)}


def test_submission_failures(spark):
    row = {c: 0.5 for c in scoring.TEMPLATE} | {"row_id": 0, "loan_id": "a", "reporting_month": "2022-01-01", "next_state_pred": "Current", "exception_required_pred": 0, "exception_type_pred": "none", "top_drivers": "x", "recommended_action": "y"}
    rows = [row | {"row_id": i, **{c: (i + 1) / 30 for c in [*scoring.PROBS, "anomaly_score", "model_confidence"]}} for i in range(20)]
    schema = "row_id long, " + ", ".join(f"{c} {'int' if c == 'exception_required_pred' else 'string' if isinstance(row[c], str) else 'double'}" for c in scoring.TEMPLATE)
    panel = spark.range(20).select(F.col("id").alias("row_id"), F.lit("a").alias("loan_id"), F.lit("2022-01-01").cast("date").alias("reporting_month"))
    frame = lambda rs: spark.createDataFrame([tuple(r[c] for c in ["row_id", *scoring.TEMPLATE]) for r in rs], schema)
    failed = lambda df, p=panel: {r["check"] for r in scoring.validate_submission(df, p).where("NOT passed").collect()}
    assert failed(frame(rows)) == set()
    assert failed(frame(rows[:-1])) == {"row count", "rows align"}
    assert failed(frame([rows[0] | {"loan_id": "b"}, *rows[1:]])) == {"rows align"}
    assert failed(frame([rows[0] | {"next_state_pred": "Gone", "exception_required_pred": 2, "top_drivers": " ", "anomaly_score": 1.5}, *rows[1:]])) == {"known states", "flag is 0 or 1", "no blank text", "probabilities in range"}
    assert failed(frame([r | {"next_6m_delinquency_prob": 0.2, "model_confidence": 0.5} for r in rows])) == {"ties: next_6m_delinquency_prob", "not constant: next_6m_delinquency_prob", "not constant: model_confidence"}
    assert failed(frame(rows).select("loan_id", "row_id", *[c for c in reversed(scoring.TEMPLATE) if c != "loan_id"])) == {"column order"}


def test_what_if_reports_what_changed(spark):
    pairs = spark.createDataFrame([(1, 7, 0.2, 0.7, "x", "x", None), (1, 8, 0.5, 0.5, "x", None, 1.0)], "scenario_id int, row_id int, p_base double, p double, s_base string, s string, p2 double").withColumn("p2_base", F.col("p2"))
    got = [(r["baseline_band"], r["scenario_band"], round(r["change_pp"], 6), round(r["relative_change"], 6)) for r in scoring.what_if_deltas(pairs, ["p"]).orderBy("row_id").collect()]
    assert got == [("Low", "High", 50.0, 2.5), ("Medium", "Medium", 0.0, 0.0)]
    assert [r[0] for r in pairs.orderBy("row_id").select(scoring.changed_columns(pairs, ["p", "s", "p2"])).collect()] == ["p", "s"]


def test_hierarchy_needs_changes(spark):
    panel = features.forward_labels(walk(spark).crossJoin(spark.range(30)).withColumns({"loan_id": F.concat("loan_id", F.col("id").cast("string")), "row_id": F.col("row_id") + F.col("id") * 1000}).drop("id"))
    table, champion, notes = models.next_state_hierarchical(panel, ["loan_age_months", "days_past_due"], rounds=2)
    names = {r["model"]: r["log_loss"] for r in table.collect()}
    assert set(names) == {"persistence", "flat", "hierarchical"} and not notes and names[champion] == min(names[k] for k in ("flat", "hierarchical"))
    table, champion, notes = models.next_state_hierarchical(panel, ["loan_age_months"], least_changes=10**6)
    assert champion == "flat" and notes
