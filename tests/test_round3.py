"""Findings of round 3: rows that leave their task, and results that differed from the SQL."""

import datetime
import math
import re
import threading
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from panelworks.operators import boosting, explain, features, metrics, models, preprocess, rules, scoring, simulate, submission, text, whatif
from panelworks.plans import queries, testpanel
from panelworks.session import checkpoint


def brute_force(docs, questions, least=0.12, top=3):
    def bag(t):
        w = re.findall("[a-z0-9]{2,}", (t or "").lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    bags = {k: bag(t) for k, t in docs}
    df = Counter(t for b in bags.values() for t in b)
    weigh = lambda b: {t: (1 + math.log(c)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in b.items() if t in df}
    length = lambda w: math.sqrt(sum(x * x for x in w.values()))
    held, out = {k: weigh(b) for k, b in bags.items()}, set()
    for i, t in questions:
        q = weigh(bag(t))
        scores = [(-round(s, 9), k) for k, w in held.items() if w and q and (s := sum(x * w.get(u, 0) for u, x in q.items()) / length(q) / length(w)) >= least]
        out |= {(i, k, r + 1) for r, (_, k) in enumerate(sorted(scores)[:top])}
    return out


@pytest.fixture
def kept(monkeypatch):
    """Rows of every table that the search writes."""
    rows, write = [], text.checkpoint

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(text, "checkpoint", counted)
    return rows


def searched(spark, docs, questions):
    out = text.tfidf_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(questions, "item_id long, text string"))
    return {(r["item_id"], r["doc_id"], r["rank"]) for r in out.collect()}


def test_search_keeps_no_row_for_each_word(spark, kept):
    docs = [(i, " ".join(f"w{i * 7 % 90 + j}x{j % 11}" for j in range(300)) + (" alpha beta gamma delta" * 9 if i % 20 == 0 else "")) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "alpha beta"), (63, "alpha beta")]
    questions = [(1, "Alpha beta gamma, delta"), (2, "w14x0 w15x1 w16x2"), (3, None), (4, "absent")]
    assert searched(spark, docs, questions) == brute_force(docs, questions)
    # All words of all texts are 35,000 rows and more.
    assert max(kept) < 10000


def test_search_makes_no_pair_of_common_words(spark, kept):
    docs = [(2 * i + j, f"{'acct' if j else 'phone'}_{i}x: {'balance of' if j else 'kept for'} nation {i % 25}") for i in range(300) for j in (0, 1)]
    questions = [(i, f"What does acct_{i}x mean, or phone?" if i % 2 else f"what is the balance of nation {i % 5 + 10}?") for i in range(300)]
    assert searched(spark, docs, questions) == brute_force(docs, questions)
    # 300 questions of 600 passages: common words alone would make 90,000 pairs.
    assert max(kept) < 6000


@pytest.mark.parametrize("slices, most", [(2**21, 10**6), (3, 10**6), (2**21, 0)])
def test_search_sums_pairs_where_the_text_is(spark, monkeypatch, slices, most):
    monkeypatch.setattr(text.postings, "SLICE", slices)
    monkeypatch.setattr(text, "BROADCAST_ROWS", most)
    plans, write = {}, text.checkpoint
    monkeypatch.setattr(text, "checkpoint", lambda df: (plans.setdefault(tuple(df.columns), df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    docs = [(2 * i + j, f"{'acct' if j else 'phone'}_{i}x: {'balance of' if j else 'kept for'} nation {i % 25}") for i in range(60) for j in (0, 1)] + [(500, None), (501, "")]
    questions = [(i, f"What does acct_{i}x mean, or phone?" if i % 2 else f"what is the balance of nation {i % 5 + 10}?") for i in range(60)] + [(90, None)]
    assert searched(spark, docs, questions) == brute_force(docs, questions)
    # No pair of a text and a question is shuffled, unless the questions are too many for every task.
    assert ("Exchange" in plans["asked_id", "doc_id", "at_least", "at_most"]) == (most == 0)


def test_numbers_end_without_white_space(spark, tmp_path):
    cases = [(i, t) for i, t in enumerate(["7.\n", "65 \t\r\n", "5\n%", "5\v%", "-\v5", "( - 5\f", "3\n\n4 "])]
    spark.createDataFrame(cases, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["extract_numbers"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == by_sql(tmp_path, "documents", "extract_numbers", got.columns)


def by_sql(path, name, query, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet/*.parquet')")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[query]})").fetchall(), key=str if query != "extract_numbers" else None)


def test_halves_are_printed_by_their_binary_value(spark):
    from panelworks.functions.columns import printed

    values = [0.0811875, 0.0000005, 0.5, 1.0, None, 0.1234565, -2.0000015]
    df = spark.createDataFrame([(values,), (None,)], "x array<double>")
    with_c = [None if v is None else "%.6f" % v for v in values]
    assert [r[0] for r in df.select(printed(F.col("x"), 6)).collect()] == [with_c, None]


def test_repeated_overrides_repeat_their_rows(spark, tmp_path):
    # Two rows of one loan that are dated before its origination share a month; both are overridden.
    def month(i):
        return datetime.date(1995 + i // 12, i % 12 + 1, 3)

    rows = [(1, month(i), 211.0 if i in (0, 25) else 10.0 + i, 1 + i % 5, "N") for i in range(31)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_quantity double, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES["what_if_batch"](spark, str(tmp_path))
    told = by_sql(tmp_path, "lineitem", "what_if_batch", got.columns)
    assert len(told) == 33 and sorted((tuple(r) for r in got.collect()), key=str) == told


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_of_folds_is_plain_arithmetic(spark):
    df = metrics.temporal_spread(spark.createDataFrame([(0.1, 0.2, 0.6), (0.4, None, 0.2), (None, None, None)], "a double, b double, c double"), ["a", "b", "c"])
    assert "lambda" not in planned(df)
    shown = ["mean_prediction", "spread", "low", "high", "relative_spread"]
    first, second, none = [[r[c] for c in shown] for r in df.collect()]
    assert first == pytest.approx([0.3, math.sqrt(0.14 / 3), 0.1, 0.6, math.sqrt(0.14 / 3) / 0.3]) and second == pytest.approx([0.3, 0.1, 0.2, 0.4, 1 / 3])
    assert none == [None] * 5


def test_phrases_are_looked_for_in_a_text_normalised_once(spark):
    df = text.phrase_flags(spark.createDataFrame([("It WILL default",), (None,), ("For\u00a0review 7",)], "text string"))
    assert planned(df).count("translate(") == 1
    names = ["has_causal", "has_decision", "has_certainty", "has_disclaimer", "is_empty", "cites_number"]
    assert [[r[c] for c in names] for r in df.collect()] == [[False, False, True, False, False, False], [False, False, False, False, True, False], [False, False, False, True, False, True]]


def test_forest_scores_rows_where_they_are(spark):
    df = spark.range(400).selectExpr("id AS row_id", "CAST(id % 37 AS DOUBLE) AS a", "CASE WHEN id % 9 > 0 THEN id * id % 101 END AS b", "'x' AS kept")
    forest = simulate.fit_isolation_forest(df, ["a", "b"], trees=20, sample=64)
    out = forest.score(df)
    assert "Join" not in planned(out) and out.columns == ["row_id", "a", "b", "kept", "raw", "anomaly_flagged"]

    def walk(node, x):
        return node[0] if len(node) == 1 else walk(node[2] if x[node[0]] < node[1] else node[3], x)

    scale = sum(simulate._mean_path(n) for n, _ in forest.trees)
    for r in out.collect():
        x = r["a"], forest.medians["b"] if r["b"] is None else r["b"]
        assert r["raw"] == pytest.approx(-(2.0 ** (-sum(walk(t, x) for _, t in forest.trees) / scale)), rel=1e-12)


def test_rules_read_the_lines_once(spark):
    ruled = queries._ruled(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in ruled._jdf.queryExecution().executedPlan().toString()
    # Quality scores pass over the flags several times; none of them joins the feed or ranks a loan's rows again.
    scored = queries._scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in scored and "SortMergeJoin" not in scored


def test_features_are_written_once(spark):
    df = queries._features(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in planned(df) and "written-" in df.inputFiles()[0]


def test_panel_reads_the_lines_once(spark):
    df = testpanel.panel(spark, "/root/testdata/sf0.001")
    assert planned(df).count("l_suppkey") and planned(df).count("Relation") == 1
    con, lines = duckdb.connect(), "(SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet')"
    there = con.execute(f"SELECT count(*), sum(row_id), sum(row_id * days_past_due) FROM ({testpanel.PANEL.replace('FROM lineitem)', f'FROM {lines})')})").fetchone()
    assert df.agg(F.count("*"), F.sum("row_id"), F.sum(F.expr("row_id * days_past_due"))).first() == there


def test_halves_for_a_fit_are_written_once(spark):
    assert all("written-" in half.inputFiles()[0] for half in queries._parts(spark, "/root/testdata/sf0.001"))


def seen(df):
    """``df`` and an accumulator of how many of its rows were worked out."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), n


def test_transition_frame_is_worked_out_once(spark):
    rows = [(i, s, t, float(i % 7), [0.25] * 4) for i in range(40) for s in ("Current", "30DPD", "60DPD") for t in ("Current", "Default")]
    frame, n = seen(spark.createDataFrame(rows, "row_id long, from_state string, to_state string, x double, p array<double>"))
    fitted = models.transition_model(frame, ["x"], least_rows=20)
    assert set(fitted) == {"Current", "30DPD", "60DPD"} and n.value == len(rows)
    assert models.score_transitions(frame, fitted, ["x"]).count() == len(rows) and n.value == 2 * len(rows)


@pytest.fixture
def wrote(monkeypatch):
    """Columns of every table that the models write."""
    out, write = [], models.written

    def told(df):
        out.append(df.columns)
        return write(df)

    monkeypatch.setattr(models, "written", told)
    return out


def test_targets_are_fitted_on_their_columns_and_measured_when_asked(spark, monkeypatch, wrote):
    calls, measure = [], models.binary_metrics
    monkeypatch.setattr(models, "binary_metrics", lambda *a: calls.append(1) or measure(*a))
    month = F.add_months(F.lit("2020-01-01").cast("date"), (F.col("id") % 24).cast("int"))
    df = spark.range(600).select(F.col("id").alias("row_id"), month.alias("reporting_month"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("a").alias("other"))
    fitted = models.train_binary_target(df, "y", ["x"], ["x"], rounds=1)
    assert models.score_targets(df, [fitted], {"y": "q"}).where("q BETWEEN 0 AND 1").count() == 600
    assert not calls and wrote and all("other" not in columns for columns in wrote)
    assert fitted.metrics.count() == len(calls) >= 2


def test_classes_are_fitted_on_their_columns(spark, wrote):
    df = spark.range(60).select((F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "Current").otherwise("Default").alias("y"), F.lit("a").alias("other"))
    models.multiclass_model(df, "y", ["x"], rounds=1)
    assert wrote == [["_y", "x"]]


def test_boosting_counts_many_rows_at_a_time():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 3))], ["y"]) for i in range(0, 30, 3)]
    out = list(boosting._together(iter(batches), 8))
    assert [b.num_rows for b in out] == [9, 9, 9, 3] and [v for b in out for v in b.column(0).to_pylist()] == list(range(30))


def test_long_lists_of_levels_have_the_same_places(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), f"a{i % 3}", f"b{i % 5}") for i in range(30)], "x double, a string, b string")
    fitted = preprocess.PanelEncoder(numbers=["x"], names=["a", "b"], least=2).fit(df)
    vectors = lambda: [r["features"].toArray().tolist() for r in fitted.transform(df).collect()]
    short = vectors()
    for few in (0, 4):
        monkeypatch.setattr(preprocess, "FEW_LEVELS", few)
        assert vectors() == short and len(short[0]) == len(fitted.places()) == 11


def test_loans_without_overrides_are_worked_out_once(spark):
    sizes = []

    def prepare(df):
        sizes.append(df.count())
        return features.quality_features(df)

    rows = spark.createDataFrame([(i, f"L{i % 4}", datetime.date(2020, 1 + i // 4, 1), 5.0) for i in range(12)], "row_id long, loan_id string, reporting_month date, interest_rate double")
    asked = rows.where("row_id IN (4, 5)").crossJoin(spark.range(3).toDF("scenario_id")).select("scenario_id", "loan_id", "reporting_month", F.lit(9.0).alias("interest_rate"))
    before, after = whatif.what_if_features(rows, asked, prepare)
    # Two of four loans have overrides; three scenarios of each are changed.
    assert min(sizes) == 6 and max(sizes) == 18
    got = lambda df: sorted((r["scenario_id"], r["row_id"], r["interest_rate"]) for r in df.collect())
    assert got(before) == [(s, i, 5.0) for s in range(3) for i in (4, 5)] and got(after) == [(s, i, 9.0) for s in range(3) for i in (4, 5)]


def test_flags_of_the_scoring_file_are_written_once(spark, monkeypatch):
    out = []
    monkeypatch.setattr(submission, "written", lambda df: out.append(df.columns) or df)
    monkeypatch.setattr(submission.qual, "record_quality", lambda df: df)
    monkeypatch.setattr(submission.feat, "engineer_features", lambda df: (df, []))
    panel = testpanel.panel(spark, "/root/testdata/sf0.001").limit(20)
    submission.panel_features(panel, testpanel.feed(panel))
    assert len(out) == 1 and "rule_severity_score" in out[0]


def test_types_are_told_apart_without_the_other_model(spark, monkeypatch):
    months = F.add_months(F.lit("2020-01-01").cast("date"), (F.floor(F.col("row_id") / 4) % 12).cast("int"))
    kind = F.when(F.col("row_id") % 4 == 0, "late").when(F.col("row_id") % 4 == 1, "doc").otherwise("none")
    df = spark.range(480).toDF("row_id").withColumns({"exception_type": kind, "x": F.col("row_id") % 4 + F.rand(3), "reporting_month": months, "anomaly_score": F.lit(0.1)})
    df = df.withColumn("exception_required", (F.col("exception_type") != "none").cast("int")).withColumns({name: F.lit(name == "date_order_valid") & (F.col("row_id") % 60 == 0) for name in rules.REGISTRY})
    fits, fit = [], models.boosted_model
    monkeypatch.setattr(models, "boosted_model", lambda *a: (fits.append(a[1]), fit(*a))[1])
    found = models.train_residual_models(df, ["x"], rounds=2)
    assert found.gates.first()["trainable"] and found.kind_metrics.first()["macro_f1"] > 0.9
    # The types' metrics take no model of whether a row is an exception; it is there when asked for, once.
    assert fits == []
    assert found.required is found.required and found.required_metrics.count() and fits == ["exception_required"]
    assert found.score(df).where("residual_prob IS NULL").count() == 8


def test_search_takes_few_jobs(spark):
    docs = [(2 * i + j, f"{'acct' if j else 'phone'}_{i}x: {'balance of' if j else 'kept for'} nation {i % 25}") for i in range(60) for j in (0, 1)]
    questions = [(i, f"What does acct_{i}x mean, or phone?") for i in range(60)]
    sc, taken = spark.sparkContext, {}
    sc.setJobGroup("search", "jobs of a search")
    try:
        assert searched(spark, docs, questions) == brute_force(docs, questions)
        taken = sc.statusTracker().getJobIdsForGroup("search")
    finally:
        sc.setJobGroup("", "")
    # 62 with a pass for the sketch and one more for the document frequencies.
    assert 0 < len(taken) < 56


def test_passages_shuffle_texts_not_lines(spark):
    plan = text.corpus_chunks(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate posexplode") < plan.index("Exchange")


def test_passages_by_odd_ends_of_lines(spark):
    """Line separators of Unicode end no line, as in the SQL."""
    texts = ["## A ## \n| a | b | \n|| c || d ||", "|--\u0085| x | y |\n|||\n|||| z\n| only |", "|a|b||\n| - : | v |\n|  | w |\n| Name | n | m |", None, "", "#\n### \n| k | v | |\n" + "p" * 41]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in text.corpus_chunks(docs).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == set(con.execute(queries.SQL["corpus_chunks_documents"]).fetchall())


def test_search_broadcasts_no_table_by_a_guess(spark, monkeypatch, tmp_path):
    plans, run = [], text.checkpoint
    monkeypatch.setattr(text, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or run(df))
    docs = [(i, f"balance of account acct_{i} in nation {i % 7}", f"acct_{i}") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, name string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i, f"what is acct_{i}?") for i in range(0, 200, 10)], "item_id long, text string").write.parquet(f"{tmp_path}/asked")
    passages, asked = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/asked")
    out = text.answer_lookup(asked, text.tfidf_search(passages, asked, name="name"), passages)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
    assert {r["item_id"]: r["doc_id"] for r in out.collect()} == {i: i for i in range(0, 200, 10)}


def test_largest_parts_leave_the_task_only(spark):
    columns = ["months_delinquent_to_date", "interest_rate", "balance_ratio", "state", "never"]
    df = spark.range(800).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).alias(columns[0]), (F.col("id") * 31 % 11).cast("double").alias(columns[1]), (F.col("id") * 17 % 13).cast("double").alias(columns[2]),
        F.when(F.col("id") % 3 == 0, "CA").otherwise("TX").alias(columns[3]), F.lit(1.0).alias(columns[4]), ((F.col("id") % 7 > 4) | (F.col("id") * 31 % 11 > 8)).cast("int").alias("y"),
    )
    df = checkpoint(df)
    for maker, shap in ((models.boosted_model, lambda m, *top: explain.tree_shap(m, df, columns, *top)), (models.baseline_model, lambda m, *top: explain.linear_shap(m, df, df, *top))):
        model = maker(df, "y", columns)
        whole, cut = (checkpoint(shap(model, *top)) for top in ((), (3,)))
        assert whole.count() == 800 * len(columns) and cut.count() == 800 * 3
        said = lambda values: {tuple(r) for r in scoring.local_drivers(values.withColumn("source", scoring.label(F.col("source"))), 3).collect()}
        assert said(whole) == said(cut) and len(said(cut)) == 800
        assert cut.select("row_id", "source", "value").exceptAll(whole.select("row_id", "source", "value")).isEmpty()


def test_independent_fits_run_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)
    submission._at_once(spark, [both.wait, both.wait])
    with pytest.raises(ZeroDivisionError):
        submission._at_once(spark, [lambda: 1 // 0, lambda: spark.range(3).count()])


def test_scores_of_folds_are_written_once(spark, monkeypatch):
    wrote, write = [], models.written
    monkeypatch.setattr(models, "written", lambda df: wrote.append(df.columns) or write(df))
    monkeypatch.setattr(models, "checkpoint", lambda df: pytest.fail("a table for each fold"))
    month = F.add_months(F.lit("2020-01-01").cast("date"), (F.col("id") % 24).cast("int"))
    df = spark.range(1200).select(F.col("id").alias("row_id"), month.alias("reporting_month"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 3 + F.col("id") % 5 > 12).cast("int").alias("delinq_3"))
    out = models.temporal_ensemble(df, df.select("row_id", "x"), "delinq_3", ["x"], 3, 2)
    assert out.count() == 1200 and len(wrote) == 2 and wrote[1][:2] == ["row_id", "x"] and len(wrote[1]) >= 4
