"""Supervised models of the panel with Spark ML, and their calibration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.operators.boosting import BoostedClasses
from panelworks.operators.features import HORIZONS, mature_label_mask, months_of, time_aware_split, walk_forward_folds
from panelworks.operators.metrics import auc_by_group, binary_metrics, calibration_by_segment, classification_report, pr_auc, prefix_sums, reliability_bins, roc_auc, score_table, temporal_spread
from panelworks.operators.preprocess import LEAST_LEVEL, encoder, pooled  # noqa: F401
from panelworks.operators.quality import numeric_columns
from panelworks.operators.rules import rule_covered
from panelworks.operators.transitions import advance_covariates, fold_paths, log_loss_multiclass, one_step_scores, score_next_state, stressed
from panelworks.schema import ABSORBING, STATES
from panelworks.session import checkpoint, written

# Columns that tell the outcome, or who a row is.
LEAKS = ["delinq_3", "delinq_6", "default_12", "prepay_12", "next_state", "exception_required", "exception_type"]
IDENTIFIERS = ["row_id", "loan_id", "reporting_month", "origination_month", "last_updated_at"]
#: Levels of fewer rows are pooled in transition models.
RARE_LEVEL = 20


def feature_columns(df: DataFrame, drop: list[str] = LEAKS + IDENTIFIERS) -> list[str]:
    """Columns that are no leak or identifier and have more than one value; null is a value."""
    there = [c for c in df.columns if c not in drop]
    kinds = df.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in there]).first()
    return [c for c in there if (kinds[c] or 0) > 1]


def preprocess(df: DataFrame, columns: list[str], scale: bool = True, least: int = LEAST_LEVEL) -> list[Estimator]:
    """The stages before a model: median and mode imputation, rare levels pooled, one-hot places, standardised numbers."""
    return [encoder(df, columns, scale, least)]


def _weighted(df: DataFrame, label: str, balanced: bool) -> DataFrame:
    """Weights n / (2 n_c), or neg / pos for positives."""
    pos, n = df.agg(F.sum(F.col(label).cast("long")), F.count("*")).first()
    pos = pos or 0
    up, down = (n / (2 * max(1, pos)), n / (2 * max(1, n - pos))) if balanced else ((n - pos) / max(1, pos), 1.0)
    return df.withColumn("_weight", F.when(F.col(label) == 1, up).otherwise(down))


def baseline_model(train: DataFrame, label: str, columns: list[str]) -> PipelineModel:
    train = _weighted(train, label, balanced=True)
    lr = LogisticRegression(labelCol=label, weightCol="_weight", regParam=1e-4, maxIter=50)
    return Pipeline(stages=[*preprocess(train, columns), lr]).fit(train)


def boosted_model(train: DataFrame, label: str, columns: list[str], rounds: int = 20) -> PipelineModel:
    train = _weighted(train, label, balanced=False)
    gbt = GBTClassifier(labelCol=label, weightCol="_weight", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=7)
    return Pipeline(stages=[*preprocess(train, columns, scale=False), gbt]).fit(train)


def score(model: PipelineModel, df: DataFrame, columns: list[str], name: str = "p") -> DataFrame:
    """``df`` with the probability of label 1, within [0, 1]."""
    out = model.transform(df)
    return out.select(*df.columns, F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.0)), F.lit(1.0)).alias(name))


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.ln(q / (1 - q))


def platt(df: DataFrame, label: str, p: str) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression on the log-odds."""
    rows = VectorAssembler(inputCols=["_z"], outputCol="features").transform(df.select(F.col(label).cast("double").alias("label"), log_odds(F.col(p)).alias("_z")))
    fitted = LogisticRegression(standardization=False, maxIter=50).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def apply_platt(df: DataFrame, p: str, fitted: tuple[float, float], name: str) -> DataFrame:
    return df.withColumn(name, 1 / (1 + F.exp(-(F.lit(fitted[0]) * log_odds(F.col(p)) + F.lit(fitted[1])))))


def isotonic(df: DataFrame, label: str, p: str):
    return IsotonicRegression(labelCol=label, featuresCol=p).fit(df.select(F.col(label).cast("double").alias(label), p))


# What a calibration slice must have, and what isotonic regression must leave of its ranks.
LEAST_ROWS, LEAST_POSITIVES, LEAST_DISTINCT, MOST_TIED, MARGIN = 1000, 50, 0.05, 0.25, 0.02


@dataclass
class Calibrator:
    """A calibration method with what decided for it; figures that were not needed are None."""

    method: str
    fitted: object = None
    n: int = 0
    n_positive: int = 0
    brier_raw: float | None = None
    brier_platt: float | None = None
    brier_isotonic: float | None = None
    n_distinct: int | None = None
    tie_share: float | None = None
    reason: str = ""

    def apply(self, df: DataFrame, p: str, name: str) -> DataFrame:
        """``df`` with the calibrated probability, within [0, 1]."""
        if self.method == "platt":
            out = apply_platt(df, p, self.fitted, "_cal")
        elif self.method == "isotonic":
            out = self.fitted.transform(df.withColumn(self.fitted.getFeaturesCol(), F.col(p))).withColumn("_cal", F.col("prediction"))
        else:
            out = df.withColumn("_cal", F.col(p))
        return out.select(*df.columns, F.least(F.greatest("_cal", F.lit(0.0)), F.lit(1.0)).alias(name))

    @property
    def isotonic_kept_ranks(self) -> bool:
        return self.n_distinct is not None and self.n_distinct / self.n >= LEAST_DISTINCT and self.tie_share <= MOST_TIED


def isotonic_gates(df: DataFrame, label: str, p: str) -> Calibrator:
    """Isotonic regression with the figures that it is judged by: how its own output keeps the ranks apart."""
    fitted = isotonic(df, label, p)
    out = fitted.transform(df.select(p, F.col(label).cast("double").alias("_y")))
    levels = out.groupBy(F.round("prediction", 12).alias("v")).agg(F.count("*").alias("n"), F.sum((F.col("prediction") - F.col("_y")) ** 2).alias("e"))
    row = levels.agg(F.count("*").alias("distinct"), F.max("n").alias("tie"), F.sum("n").alias("n"), F.sum("e").alias("e")).first()
    return Calibrator("isotonic", fitted, n=row["n"], brier_isotonic=row["e"] / row["n"], n_distinct=row["distinct"], tie_share=row["tie"] / row["n"])


def select_calibrator(df: DataFrame, label: str, p: str, method: str = "auto") -> Calibrator:
    """Isotonic, Platt or none, with the reason; a ``method`` of these names forces it.

    Isotonic regression needs rows and positives, its output must keep enough distinct values and no large tie, and
    it must beat Platt by a margin. Platt must beat the raw scores. Rows without label or score are left out.
    """
    if method not in ("auto", "platt", "isotonic", "identity"):
        raise ValueError(f"unknown calibration method: {method}")
    df = checkpoint(df.select(F.col(label).cast("int").alias(label), F.col(p).cast("double").alias(p)).dropna())
    brier = lambda d, c: d.agg(F.avg((F.col(c) - F.col(label)) ** 2)).first()[0]
    n, pos, raw = df.agg(F.count("*"), F.sum(F.col(label).cast("long")), F.avg((F.col(p) - F.col(label)) ** 2)).first()
    out = Calibrator("identity", n=n, n_positive=pos or 0, brier_raw=raw, reason="method forced by caller")
    if method == "identity":
        return out
    if not n or pos in (0, n):
        out.reason = "the calibration slice has a single class"
        return out
    by_platt = by_isotonic = None
    if method != "isotonic":
        by_platt = platt(df, label, p)
        out.brier_platt = brier(apply_platt(df, p, by_platt, "_q"), "_q")
    if method == "isotonic" or method == "auto" and n >= LEAST_ROWS and pos >= LEAST_POSITIVES:
        by_isotonic = isotonic_gates(df, label, p)
        out.brier_isotonic, out.n_distinct, out.tie_share = by_isotonic.brier_isotonic, by_isotonic.n_distinct, by_isotonic.tie_share
    if method != "auto":
        out.method, out.fitted = method, by_platt if method == "platt" else by_isotonic.fitted
    elif out.isotonic_kept_ranks and out.brier_isotonic < out.brier_platt * (1 - MARGIN):
        out.method, out.fitted, out.reason = "isotonic", by_isotonic.fitted, "isotonic beats Platt by more than the margin"
    else:
        why = "too few rows or positives for isotonic" if by_isotonic is None else "isotonic is within the margin" if out.isotonic_kept_ranks else "isotonic merges the ranks"
        out.method, out.fitted, out.reason = ("platt", by_platt, why) if out.brier_platt < raw else ("identity", None, "raw scores are calibrated better")
    return out


# Columns that tell the time.
TIME_LIKE = ["reporting_month", "month_index", "origination_month", "loan_age_months", "remaining_term_months", "vintage", "last_updated_at", "market_rate"]


def adversarial_validation(a: DataFrame, b: DataFrame, columns: list[str], folds: int = 3, most_rows: int = 40_000, with_time: bool = True, top: int = 10) -> DataFrame:
    """(auc, verdict, top_features): how well two samples can be told apart by out-of-fold scores, and by which columns.

    The classifier is fitted on at most about ``most_rows`` rows of each side, chosen by hash. Without time, the
    columns of TIME_LIKE are left out. top_features are those whose permutation costs a classifier of all rows AUC, the
    dearest first.
    """
    columns = [c for c in columns if with_time or c not in TIME_LIKE]
    both = a.select("row_id", *columns, F.lit(1).alias("side")).unionByName(b.select("row_id", *columns, F.lit(0).alias("side")))
    sizes = {r["side"]: r["count"] for r in both.groupBy("side").count().collect()}
    space = 1_000_000
    share = F.when(F.col("side") == 1, min(1.0, most_rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most_rows / max(1, sizes.get(0, 0)))) * space
    both = both.where(F.pmod(F.xxhash64("row_id", "side"), F.lit(space)) < share)
    both = checkpoint(both.withColumn("_fold", F.pmod(F.xxhash64("row_id"), F.lit(folds))))
    parts = None
    for k in range(folds):
        scored = score(boosted_model(both.where(F.col("_fold") != k), "side", columns, rounds=8), both.where(F.col("_fold") == k), columns).select("side", "p")
        parts = scored if parts is None else parts.unionByName(scored)
    auc = roc_auc(score_table(checkpoint(parts), "side", "p"))
    drops = permutation_importance(boosted_model(both, "side", columns, rounds=8), both, "side", columns, top).where("auc_drop > 0")
    said = drops.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("auc_drop")).alias("d"), "column"))), lambda x: x["column"]), ", ").alias("top_features"))
    verdict = F.when(F.col("roc_auc") < 0.55, "indistinguishable").when(F.col("roc_auc") < 0.70, "mild shift").when(F.col("roc_auc") < 0.90, "clear shift").otherwise("separate")
    return auc.select(F.col("roc_auc").alias("auc"), verdict.alias("verdict")).crossJoin(F.broadcast(said))


def transition_estimator() -> Estimator:
    return LogisticRegression(family="multinomial", regParam=1e-3, maxIter=30)


def transition_model(
    frame: DataFrame, columns: list[str], least_rows: int = 200, least_class: int = 5, estimator: Callable[[], Estimator] = transition_estimator
) -> dict[str, tuple[PipelineModel, list[str]]]:
    """A model for each origin state with enough rows and classes; others stay empirical.

    ``estimator`` makes any classifier that reads features and a label and writes a probability vector. Its places are
    the classes of that origin in the order of the states, whatever the classifier.
    """
    models, origins = {}, [s for s in STATES if s not in ABSORBING]
    # Written once: each origin's fit reads its own rows several times.
    held = written(frame.where(F.col("from_state").isin(origins)).select(*dict.fromkeys(["from_state", "to_state", *columns])))
    moves = held.groupBy("from_state", "to_state").count().collect()  # a row for each pair of states
    for state in origins:
        rows = held.where(F.col("from_state") == state)
        counts = {r["to_state"]: r["count"] for r in moves if r["from_state"] == state}
        classes = [s for s in STATES if counts.get(s, 0) >= least_class]
        if sum(counts.values()) < least_rows or len(classes) < 2:
            continue
        label = F.array_position(F.array(*[F.lit(s) for s in classes]), F.col("to_state")).cast("double") - 1
        rows = rows.where(F.col("to_state").isin(classes)).withColumn("_y", label).select("_y", *columns)
        made = estimator()
        made = made.copy({made.getParam("labelCol"): "_y", made.getParam("featuresCol"): "features"})
        models[state] = Pipeline(stages=[*preprocess(rows, columns, least=RARE_LEVEL), made]).fit(rows), classes
    return models


def score_transitions(frame: DataFrame, models: dict, columns: list[str], fallback: str = "p") -> DataFrame:
    """``frame`` with p_model: probabilities by the origin state's model, or the empirical ones.

    The frame is written once, as each model reads the rows of its own state.
    """
    keep, frame = frame.columns, written(frame)
    parts = frame.where(~F.coalesce(F.col("from_state").isin(list(models)), F.lit(False))).withColumn("p_model", F.col(fallback))
    for state, fitted in models.items():
        parts = parts.unionByName(_six(fitted, frame.where(F.col("from_state") == state), columns, "p_model").select(*keep, "p_model"))
    return parts


# Supervised targets.
@dataclass
class Fitted:
    """A fitted target: the champion and its calibrator. Metrics, reliability and segments are worked out when they are first
    asked for, as scoring needs none of them."""

    target: str
    columns: list[str]
    champion: str
    model: PipelineModel | None
    calibrator: Calibrator
    notes: list[str]
    measure: Callable[[], tuple[DataFrame, DataFrame | None, dict[str, DataFrame]]] | None = None

    @cached_property
    def _measured(self) -> tuple[DataFrame | None, DataFrame | None, dict[str, DataFrame]]:
        return self.measure() if self.measure else (None, None, {})

    @property
    def metrics(self) -> DataFrame | None:
        return self._measured[0]

    @property
    def reliability(self) -> DataFrame | None:
        return self._measured[1]

    @property
    def segments(self) -> dict[str, DataFrame]:
        return self._measured[2]

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        """``df`` with the calibrated probability, within [0, 1]; a target without a model raises."""
        if self.model is None:
            raise ValueError(f"{self.target}: {'; '.join(self.notes)}")
        raw = score(self.model, df, self.columns, "_raw")
        return self.calibrator.apply(raw, "_raw", name).select(*df.columns, name)


def target_parts(df: DataFrame, target: str, horizon: int | None = None, test_fraction: float = 0.2, least_calibration: int = 200) -> dict[str, DataFrame | int]:
    """fit, calibration (None if too small) and test rows of a target, and how many labels were not mature.

    Both splits are purged by the target's horizon; the inner one cuts the training rows again.
    """
    horizon = HORIZONS.get(target, 0) if horizon is None else horizon
    usable = df.where(F.col(target).isNotNull())
    mature = mature_label_mask(usable, horizon)
    parts = written(time_aware_split(mature, horizon, test_fraction))
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    fit, calibration = train, None
    if len(months_of(train)) >= 3:
        inner = time_aware_split(train, horizon, test_fraction)
        calibration = inner.where("part = 'test'").drop("part")
        if calibration.count() > least_calibration:
            fit = inner.where("part = 'train'").drop("part")
        else:
            calibration = None
    return {"fit": fit, "calibration": calibration, "test": test, "n_immature": usable.count() - parts.count()}


def train_binary_target(df: DataFrame, target: str, base_columns: list[str], columns: list[str], rounds: int = 20, segments: tuple[str, ...] = ("credit_score_band",), method: str = "auto") -> Fitted:
    """Mature rows, purged split, two models, the champion by average precision, then its calibrator.

    The champion is measured raw and calibrated on test rows that neither saw.
    """
    # Only what is fitted on or measured is written.
    segments = tuple(c for c in segments if c in df.columns)
    told = [c for c in ("row_id", target, *segments) if c in df.columns]
    parts, notes = target_parts(df.select(*dict.fromkeys(["reporting_month", *told, *base_columns, *columns])), target), []
    fit, test = parts["fit"], parts["test"]
    if parts["n_immature"]:
        notes.append(f"{parts['n_immature']} rows whose window ends after the panel are left out")
    classes = lambda rows: rows.select(target).distinct().count()
    if classes(test) < 2 or classes(fit) < 2:
        return Fitted(target, columns, "none", None, Calibrator("identity"), [*notes, "no label variation; skipped"])
    candidates = {}
    for name, maker, cols in (("baseline", baseline_model, base_columns), ("boosted", boosted_model, columns)):
        model = maker(fit, target, cols) if maker is baseline_model else maker(fit, target, cols, rounds)
        scored = checkpoint(score(model, test, cols, "_p").select(*told, "_p"))
        candidates[name] = model, cols, scored, pr_auc(score_table(scored, target, "_p")).first()["pr_auc"] or 0.0
    champion = max(candidates, key=lambda k: candidates[k][3])
    model, cols, *_ = candidates[champion]
    calibrator = Calibrator("identity", reason="too few rows to calibrate on")
    if parts["calibration"] is None:
        notes.append(calibrator.reason)
    else:
        calibrator = select_calibrator(score(model, parts["calibration"], cols, "_p"), target, "_p", method)
    out = Fitted(target, cols, champion, model, calibrator, notes)

    def row(rows: DataFrame, name: str, n: int, calibrated: bool) -> DataFrame:
        return binary_metrics(rows, target, "_p").select(F.lit(name).alias("model"), F.lit(n).alias("n_features"), F.lit(calibrated).alias("calibrated"), "*")

    def measure() -> tuple[DataFrame, DataFrame | None, dict[str, DataFrame]]:
        metrics = None
        for name, (_, cols, scored, _) in candidates.items():
            r = row(scored, name, len(cols), False)
            metrics = r if metrics is None else metrics.unionByName(r)
        if parts["calibration"] is None:
            return metrics, None, {}
        final = checkpoint(out.score(test, "_p").select(*told, "_p"))
        metrics = metrics.unionByName(row(final, f"{champion} + {calibrator.method}", len(out.columns), True))
        return metrics, reliability_bins(final, target, "_p"), {c: calibration_by_segment(final, target, "_p", c) for c in segments}

    out.measure = measure
    return out


def score_targets(df: DataFrame, models: list[Fitted], names: dict[str, str] | None = None) -> DataFrame:
    """``df`` with one calibrated probability for each target that has a model; others are left out."""
    for m in models:
        if m.model is not None:
            df = m.score(df, (names or {}).get(m.target, f"{m.target}_prob"))
    return df


def predictability_ceiling(df: DataFrame, target: str, columns: list[str], rounds: int = 10, test_pct: int = 25) -> DataFrame:
    """(split, n_test, prevalence, roc_auc, pr_auc, lift, share_lost_to_time): the same recipe out of time and on held-out loans.

    Lift, not average precision, is compared, as the two test sets differ in prevalence.
    """
    horizon = HORIZONS.get(target, 0)
    usable = checkpoint(mature_label_mask(df.where(F.col(target).isNotNull()), horizon))
    timed = time_aware_split(usable, horizon)
    held = F.pmod(F.xxhash64("loan_id", F.lit("ceiling")), F.lit(100)) < test_pct
    out = None
    for name, train, test in (("temporal", timed.where("part = 'train'"), timed.where("part = 'test'")), ("random", usable.where(~held), usable.where(held))):
        scored = checkpoint(score(boosted_model(checkpoint(train), target, columns, rounds), test, columns, "_p"))
        table = checkpoint(score_table(scored, target, "_p"))
        row = scored.agg(F.count("*").alias("n_test"), F.avg(F.col(target).cast("double")).alias("prevalence")).crossJoin(roc_auc(table)).crossJoin(pr_auc(table).withColumnRenamed("pr_auc_lift", "lift"))
        row = row.select(F.lit(name).alias("split"), "*")
        out = row if out is None else out.unionByName(row)
    lifts = out.agg(F.max(F.when(F.col("split") == "random", F.col("lift"))).alias("_r"), F.max(F.when(F.col("split") == "temporal", F.col("lift"))).alias("_t"))
    lost = ((F.col("_r") - F.col("_t")) / F.nullif("_r", F.lit(0.0))).alias("share_lost_to_time")
    return out.crossJoin(F.broadcast(lifts)).select(*out.columns, lost)


def permutation_importance(model: PipelineModel, df: DataFrame, label: str, columns: list[str], top: int = 10) -> DataFrame:
    """(column, auc_drop): how much AUC falls when a column's values are dealt to other rows.

    Rows, and the values of each column, get places in the order of a hash of row_id with a seed of their own, all by
    two prefix sums. Every row is scored once for each column, with the value of the same place, in one pass.
    """
    df = checkpoint(df.select("row_id", label, *columns))
    numbers = numeric_columns(df)
    one = {"_one": F.lit(1).cast("long")}
    key = lambda seed: F.struct(seed.alias("seed"), F.xxhash64("row_id", seed).alias("h"), F.col("row_id").alias("i"))
    rows = prefix_sums(df.withColumns({"_k": key(F.lit("rows")), **one}), "_k", ["_one"]).select(*df.columns, F.col("up__one").alias("_at"))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("number"), (F.lit(None) if c in numbers else F.col(c)).cast("string").alias("level"))
        for c in columns
    ])
    values = df.select("row_id", F.explode(cells).alias("v")).select("row_id", "v.*")
    values = prefix_sums(values.withColumns({"_k": key(F.col("column")), **one}), "_k", ["_one"])
    start = values.groupBy("column").agg(F.min("up__one").alias("_start"))  # one row for each column
    values = values.join(F.broadcast(start), "column").select("column", "number", "level", (F.col("up__one") - F.col("_start")).alias("_at"))
    dealt = rows.join(values, "_at")
    own = lambda c: F.col("number" if c in numbers else "level").cast(df.schema[c].dataType)
    dealt = dealt.withColumns({c: F.when(F.col("column") == c, own(c)).otherwise(F.col(c)) for c in columns})
    both = df.withColumn("column", F.lit("")).unionByName(dealt.select("column", *df.columns))
    scored = score(model, both, columns, "_p").select(F.col("column").alias("g"), F.col(label).alias("y"), F.col("_p").alias("s"))
    aucs = checkpoint(auc_by_group(checkpoint(scored)).select("g", "roc_auc"))
    whole = aucs.where("g = ''").select(F.col("roc_auc").alias("_whole"))
    drops = aucs.where("g <> ''").crossJoin(F.broadcast(whole)).select(F.col("g").alias("column"), (F.col("_whole") - F.col("roc_auc")).alias("auc_drop"))
    return drops.orderBy(F.desc("auc_drop"), "column").limit(top)


def temporal_ensemble(df: DataFrame, rows: DataFrame, target: str, columns: list[str], folds: int = 3, rounds: int = 5) -> DataFrame:
    """``rows`` with mean_prediction, spread and the like over models that were fitted on expanding windows.

    Folds without both labels are left out; fewer than two usable folds raise.
    """
    horizon, names = HORIZONS.get(target, 0), []
    df = written(df.select(*dict.fromkeys(["reporting_month", target, *columns])))
    for f in walk_forward_folds(df, folds, horizon).collect():  # one row for each fold
        train = df.where(F.col("reporting_month") <= F.lit(f["train_end"]))
        if train.select(target).distinct().count() == 2:
            names.append(f"_f{f['fold']}")
            rows = score(boosted_model(train, target, columns, rounds), rows, columns, names[-1])
    # All models score a row in one pass, and later steps read the scores only.
    return temporal_spread(written(rows), names).drop(*names)


# Next state.
def recombine(change: Column, destination: Column, current: Column) -> Column:
    """Six probabilities: 1 - change for the current state, else change by destination without the current state.

    ``destination`` has six probabilities; what it gives the current state belongs to no change. Where nothing is
    left, only the stay cell has a value.
    """
    states = F.array(*[F.lit(s) for s in STATES])
    others = F.zip_with(destination, states, lambda q, s: F.when(s == current, 0.0).otherwise(q))
    total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(others, states, lambda q, s: F.when(s == current, 1 - change).otherwise(F.when(total > 0, change * q / total).otherwise(0.0)))


def multiclass_model(train: DataFrame, label: str, columns: list[str], classes: list[str] = STATES, rounds: int = 20) -> tuple[PipelineModel, list[str]]:
    """A boosted model of several classes, and which of ``classes`` it knows, in their order; rows without a label are left out."""
    there = {r[0] for r in train.where(F.col(label).isin(classes)).select(label).distinct().collect()}  # no more than ``classes``
    known = [s for s in classes if s in there]
    y = F.array_position(F.array(*[F.lit(s) for s in known]), F.col(label)).cast("double") - 1
    rows = written(train.where(F.col(label).isin(known)).select(y.alias("_y"), *columns))
    return Pipeline(stages=[*preprocess(rows, columns, scale=False), BoostedClasses(labelCol="_y", rounds=rounds)]).fit(rows), known


def _six(model: tuple[PipelineModel, list[str]], rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``rows`` with a probability for each state; those that the model does not know get 0."""
    fitted, classes = model
    got = vector_to_array("probability")
    p = F.array(*[got[classes.index(s)] if s in classes else F.lit(0.0) for s in STATES])
    return fitted.transform(rows).select(*[F.col(c) for c in rows.columns], p.alias(name))


def next_state_hierarchical(df: DataFrame, columns: list[str], target: str = "next_state", least_changes: int = 100, rounds: int = 10) -> tuple[DataFrame, str, list[str]]:
    """Will the state change, and then to what: (metrics, champion, notes).

    metrics has a row for persistence (a reference, never the champion), a flat six-class model and, with
    ``least_changes`` changes to two states or more, the two stages. The champion has the least log-loss. The first
    stage is not class-weighted, as its output is multiplied and not cut.
    """
    notes = []
    df = df.select(*dict.fromkeys(["reporting_month", target, "current_status", *columns]))
    parts = written(time_aware_split(df.where(F.col(target).isNotNull() & F.col("current_status").isNotNull()), 1))
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    states = F.array(*[F.lit(s) for s in STATES])
    scored = test.withColumn("_persistence", F.transform(states, lambda s: (s == F.col("current_status")).cast("double")))
    scored = checkpoint(_six(multiclass_model(train, target, columns, rounds=rounds), scored, columns, "_flat"))
    names = {"persistence": "_persistence", "flat": "_flat"}
    changed = train.withColumn("_changed", (F.col(target) != F.col("current_status")).cast("int"))
    moves = changed.where("_changed = 1")
    if moves.count() >= least_changes and moves.select(target).distinct().count() >= 2:
        first = Pipeline(stages=[*preprocess(changed, columns, scale=False), GBTClassifier(labelCol="_changed", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=7)]).fit(changed)
        scored = _six(multiclass_model(moves, target, columns, rounds=rounds), score(first, scored, columns, "_change"), columns, "_to")
        scored = checkpoint(scored.withColumn("_two", recombine(F.col("_change"), F.col("_to"), F.col("current_status"))))
        names["hierarchical"] = "_two"
    else:
        notes.append("too few state changes for a second stage")
    out = None
    for name, p in names.items():
        row = log_loss_multiclass(scored, target, p).crossJoin(classification_report(score_next_state(scored, p), target, "next_state_pred")).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    out = checkpoint(out)
    champion = out.where("model <> 'persistence'").orderBy("log_loss", "model").first()["model"]
    return out, champion, notes


# What is left for a model once the rules have spoken.
# Types that only rules assign.
RULES_ONLY = ["status_reversal"]


def _residual_parts(flagged: DataFrame) -> DataFrame:
    """Rows that no detector rule covers, with their part; a quarter of the months is tested on, without a purge."""
    residual = flagged.where(~rule_covered())
    return time_aware_split(residual, 0, 0.25) if len(months_of(residual)) >= 3 else residual.withColumn("part", F.lit("train"))


def residual_gates(flagged: DataFrame, label: str = "exception_required", kind: str = "exception_type", least: int = 20, least_type: int = 25) -> DataFrame:
    """(n_residual, n_exceptions, enough, n_train_positive, n_test_positive, trainable, learnable_types, skipped_types) of rows
    that no detector rule covers. skipped_types are those with too few rows and those that only rules assign, with their numbers."""
    residual = _residual_parts(flagged)
    y = F.coalesce(F.col(label) == 1, F.lit(False))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    part = lambda p: y & (F.col("part") == p)
    counts = residual.agg(F.count("*").alias("n_residual"), n(y).alias("n_exceptions"), n(part("train")).alias("n_train_positive"), n(part("test")).alias("n_test_positive"))
    types = residual.where(F.col(kind).isNotNull() & (F.col(kind) != "none")).groupBy(F.col(kind).alias("k")).count()
    good = (F.col("count") >= least_type) & ~F.col("k").isin(RULES_ONLY)
    said = lambda test, text: F.array_join(F.sort_array(F.collect_set(F.when(test, text))), ",")
    types = types.agg(said(good, F.col("k")).alias("learnable_types"), said(~good, F.concat("k", F.lit(" "), F.col("count"))).alias("skipped_types"))
    enough = F.col("n_exceptions") >= least
    return counts.crossJoin(types).select(
        "n_residual", "n_exceptions", enough.alias("enough"), "n_train_positive", "n_test_positive", (enough & (F.col("n_train_positive") >= 5) & (F.col("n_test_positive") >= 3)).alias("trainable"),
        "learnable_types", "skipped_types",
    )


@dataclass
class ResidualModels:
    """What is learnt of rows that no rule covers; a model whose gates are not met is None. Each is fitted when it is first asked for."""

    gates: DataFrame
    columns: list[str]
    parts: DataFrame
    trainable: bool
    known: list[str]
    label: str
    kind: str
    rounds: int

    def _part(self, name: str) -> DataFrame:
        return self.parts.where(F.col("part") == name)

    @cached_property
    def required(self) -> PipelineModel | None:
        return boosted_model(self._part("train"), self.label, self.columns, self.rounds) if self.trainable else None

    @cached_property
    def required_metrics(self) -> DataFrame | None:
        return binary_metrics(checkpoint(score(self.required, self._part("test"), self.columns, "_p")), self.label, "_p") if self.trainable else None

    @cached_property
    def kinds(self) -> tuple[PipelineModel, list[str]] | None:
        of_kind = F.col(self.kind).isin(self.known)
        if len(self.known) < 2 or self._part("test").where(of_kind).select(self.kind).distinct().count() < 2:
            return None
        return multiclass_model(self._part("train").where(of_kind), self.kind, self.columns, self.known, self.rounds)

    @cached_property
    def kind_metrics(self) -> DataFrame | None:
        if not self.kinds:
            return None
        scored = self.kinds[0].transform(self._part("test").where(F.col(self.kind).isin(self.known))).withColumn("_kind", best_of("probability", self.kinds[1]))
        return classification_report(checkpoint(scored.select(self.kind, "_kind")), self.kind, "_kind")

    def score(self, flagged: DataFrame) -> DataFrame:
        """``flagged`` with residual_prob and residual_type, null where a rule covers the row or there is no model."""
        if self.required is None:
            return flagged.withColumns({"residual_prob": F.lit(None).cast("double"), "residual_type": F.lit(None).cast("string")})
        rows = score(self.required, flagged.where(~rule_covered()).select("row_id", *self.columns), self.columns, "residual_prob")
        if self.kinds:
            rows = self.kinds[0].transform(rows).withColumn("residual_type", best_of("probability", self.kinds[1]))
        else:
            rows = rows.withColumn("residual_type", F.lit(None).cast("string"))
        return flagged.join(rows.select("row_id", "residual_prob", "residual_type"), "row_id", "left")


def best_of(vector: str, classes: list[str]) -> Column:
    """The class of the largest probability, the first one of a tie."""
    p = vector_to_array(vector)
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int"))


def train_residual_models(flagged: DataFrame, columns: list[str], label: str = "exception_required", kind: str = "exception_type", rounds: int = 20) -> ResidualModels:
    """Whether an uncovered row is an exception, and of which type, each on the training part and measured on the test part.

    The model of types knows those of enough rows, two at least, and is fitted on exceptions only.
    """
    flagged = written(flagged)
    gates = checkpoint(residual_gates(flagged, label, kind))
    row = gates.first()
    parts = _residual_parts(flagged).withColumn(label, F.coalesce(F.col(label), F.lit(0)))
    parts = written(parts.select(*dict.fromkeys(["row_id", "part", label, kind, *columns])))
    known = [t for t in row["learnable_types"].split(",") if t]
    return ResidualModels(gates, columns, parts, row["trainable"], known, label, kind, rounds)


def residual_exception_model(flagged: DataFrame, columns: list[str], label: str = "exception_required", rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(scored, gates): ``flagged`` with residual_prob and residual_type, null where a rule covers the row or the gates are not met."""
    models = train_residual_models(flagged, columns, label, rounds=rounds)
    return models.score(flagged), models.gates


# Transition chains with covariates.
def blend_weights(holdout: DataFrame, models: dict, columns: list[str]) -> dict[str, float]:
    """The model's weight in each origin state, by log-loss on rows it was not fitted on; half where none came."""
    from panelworks.operators.transitions import credibility_blend

    scored = score_transitions(holdout, models, columns)
    states = F.array(*[F.lit(s) for s in STATES])
    hit = lambda p: F.coalesce(F.try_element_at(p, F.array_position(states, F.col("to_state")).cast("int")), F.lit(0.0))
    found = credibility_blend(scored.select("from_state", hit("p_model").alias("p_model"), hit("p").alias("p_empirical"))).collect()  # one row for each state
    return {s: 0.5 for s in models} | {r["from_state"]: float(r["alpha"]) for r in found if r["from_state"] in models}


def covariate_matrices(loans: DataFrame, models: dict, weights: dict[str, float], cells: DataFrame, columns: list[str], horizon: int = 12) -> DataFrame:
    """(row_id, current_status, h, m): the matrix of each loan for steps 0 to horizon - 1, from advanced covariates.

    A loan becomes one row for each step; each origin state's model scores all of them, blended with the empirical
    row by the state's weight; absorbing rows stay. The matrices are written once, for paths and draws alike.
    """
    steps = loans.select(*dict.fromkeys(["row_id", "current_status", "loan_age_months", "remaining_term_months", "interest_rate", "balance_ratio", *columns]))
    steps = advance_covariates(steps.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))), F.col("h"))
    rows = []
    for i, s in enumerate(STATES):
        name = f"_row{i}"
        if s in ABSORBING:
            steps = steps.withColumn(name, F.array(*[F.lit(float(t == s)) for t in STATES]))
        else:
            steps = one_step_scores(steps.withColumn("from_state", F.lit(s)), cells).withColumnRenamed("p", name).drop("from_state")
            if s in models:
                steps = _six(models[s], steps, columns, "_m").withColumn(name, F.zip_with("_m", name, lambda a, b: weights[s] * a + (1 - weights[s]) * b)).drop("_m")
        rows.append(name)
    return checkpoint(steps.select("row_id", "current_status", "h", F.array(*rows).alias("m")))


def covariate_paths(loans: DataFrame, models: dict, weights: dict[str, float], cells: DataFrame, scenarios: DataFrame, columns: list[str], horizon: int = 12) -> DataFrame:
    """(row_id, scenario, month, p) of chains whose matrix is worked out anew each month; a loan's steps are folded."""
    steps = covariate_matrices(loans, models, weights, cells, columns, horizon)
    told = steps.crossJoin(F.broadcast(scenarios)).select(
        "row_id", "scenario", F.col("current_status").alias("start"), "h", stressed(F.col("m"), F.col("default_mult"), F.col("delinq_mult"), F.col("prepay_mult")).alias("m")
    )
    return fold_paths(told, horizon)


# Cause-specific hazards.
def cox_cause_specific(events: DataFrame, covariates: dict[str, Column], cause: int = 1, ridge: float = 0.1, rounds: int = 25) -> DataFrame:
    """(covariate, coef, hazard_ratio): proportional hazards of one cause, the other being censored; Breslow ties.

    ``events`` has duration and event. Covariates are scaled to unit deviation and penalised by ``ridge`` / 2 times
    the mean's square norm, as the mean log-likelihood is maximised. Each Newton step sums the risk sets by
    duration on Spark; one row for each duration comes to the driver.
    """
    names = list(covariates)
    rows = events.select("duration", (F.col("event") == cause).cast("double").alias("d"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(covariates.values())])
    rows = rows.dropna()
    k = len(names)
    moments = rows.agg(F.count("*").alias("n"), *[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(k) for f in (F.avg, F.stddev_samp)]).first()
    mean, dev = (np.array([moments[f"{f}{i}"] or 0.0 for i in range(k)]) for f in ("avg", "stddev_samp"))
    live = dev > 0
    scaled = checkpoint(rows.select("duration", "d", *[((F.col(f"x{i}") - float(mean[i])) / float(dev[i] if live[i] else 1.0)).alias(f"x{i}") for i in range(k)]))
    b, n = np.zeros(k), max(1, moments["n"])
    for _ in range(rounds):
        w = F.exp(sum((F.lit(float(b[i])) * F.col(f"x{i}") for i in range(k)), F.lit(0.0)))
        sums = [F.sum(w).alias("s0"), F.sum("d").alias("d")]
        sums += [F.sum(w * F.col(f"x{i}")).alias(f"s{i + 1}") for i in range(k)] + [F.sum(F.col("d") * F.col(f"x{i}")).alias(f"e{i}") for i in range(k)]
        sums += [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]
        table = scaled.groupBy("duration").agg(*sums).orderBy(F.desc("duration")).toPandas()
        risk = table.drop(columns=["duration"]).cumsum()
        d, s0 = table["d"].to_numpy(), risk["s0"].to_numpy()
        s1 = risk[[f"s{i + 1}" for i in range(k)]].to_numpy()
        grad = table[[f"e{i}" for i in range(k)]].to_numpy().sum(axis=0) - (d[:, None] * s1 / s0[:, None]).sum(axis=0)
        hess = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                hess[i, j] = hess[j, i] = (d * (risk[f"q{i}_{j}"].to_numpy() / s0 - s1[:, i] * s1[:, j] / s0**2)).sum()
        step = np.linalg.solve(hess / n + ridge * np.eye(k), grad / n - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    coef = np.where(live, b / np.where(live, dev, 1.0), 0.0)
    return events.sparkSession.createDataFrame([(name, float(c), float(np.exp(c))) for name, c in zip(names, coef)], "covariate string, coef double, hazard_ratio double")
