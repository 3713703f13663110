"""From two panels to the scoring file: a chain of written stages that goes on where it was left.

Every stage reads what earlier ones wrote and writes one table. A stage whose table is complete is not run
again, so a chain that was stopped, or lost its driver, starts at the first stage that is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators import features as feat
from panelworks.operators import models as mod
from panelworks.operators import quality as qual
from panelworks.operators import reconcile as rec
from panelworks.operators import rules as rul
from panelworks.operators import scoring as sco
from panelworks.operators import simulate
from panelworks.operators import transitions as tra
from panelworks.operators.explain import attributions_of
from panelworks.session import checkpoint, written

# Targets by the column of the file, those that explain a row in order of preference, the one whose spread tells confidence.
TARGETS = {"delinq_3": "next_3m_delinquency_prob", "delinq_6": "next_6m_delinquency_prob", "default_12": "next_12m_default_prob", "prepay_12": "next_12m_prepayment_prob"}
EXPLAINED = ["delinq_3", "default_12"]
CONFIDENCE_TARGET, CONFIDENCE_FOLDS = "delinq_3", 4
#: Drivers that a row is told.
TOP_DRIVERS = 3
#: Fits that run side by side; each keeps its rows in memory or on disk while it lasts.
AT_ONCE = 2
#: Column names that the transition models use where a panel has them.
TRANSITION_COLUMNS = ["loan_age_months", "remaining_term_months", "interest_rate", "balance_ratio", "credit_score_band", "months_delinquent_to_date", "days_past_due"]


@dataclass
class Stages:
    """Tables of one chain in one folder."""

    spark: SparkSession
    path: str
    ran: list[str] = field(default_factory=list)

    def done(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made if it is not there in full."""
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.ran.append(name)
        return self.spark.read.parquet(f"{self.path}/{name}")


@dataclass
class Recipe:
    """What the models are fitted on: columns, boosting rounds and trees."""

    base_columns: list[str]
    columns: list[str]
    rounds: int = 20
    trees: int = 300
    method: str = "auto"


def _at_once(spark: SparkSession, jobs: list[Callable[[], object]]) -> None:
    """Jobs that do not need each other: a fit is hundreds of short stages, whose last tasks leave most cores idle."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


def panel_features(df: DataFrame, feed: DataFrame) -> DataFrame:
    """A panel with the second source's conflicts, rule flags and scores, record quality and all features."""
    # Written, as the quality of a record is judged by quantiles of the whole panel.
    flagged = written(rul.rule_scores(rul.evaluate_rules(rec.reconcile(df, feed))))
    return feat.engineer_features(qual.record_quality(flagged))[0]


def score_panel(spark: SparkSession, train: DataFrame, score: DataFrame, feed: DataFrame, recipe: Recipe, path: str, static: DataFrame | None = None) -> DataFrame:
    """(row_id and the columns of the scoring file) for every row of ``score``, each worked out by a model or rule.

    ``train`` has forward labels and a next_state. ``path`` is the chain's folder. Target columns without a model (no
    variation of the label) are null, which the file's checks report.
    """
    stages = Stages(spark, path)
    labels = ["delinq_3", "delinq_6", "default_12", "prepay_12", "next_state"]
    bare = [c for c in score.columns if c not in labels]

    def everything() -> DataFrame:
        both = rec.union_panels(train.select(*bare), score.select(*bare))
        both = rec.attach_static(both, static) if static is not None else both
        return panel_features(both, feed)

    frame = stages.table("frame", everything)
    told = stages.table("told", lambda: frame.where("origin = 'train'").join(train.select("row_id", *labels), "row_id"))
    new = frame.where("origin = 'score'")
    columns = [c for c in recipe.columns if c in frame.columns]
    base = [c for c in recipe.base_columns if c in frame.columns]

    # Fitted models live in this process only: a stage that was written needs none, the first one that was not fits them.
    fitted: dict[str, mod.Fitted] = {}

    def target(name: str) -> mod.Fitted:
        if name not in fitted:
            fitted[name] = mod.train_binary_target(told.select(*dict.fromkeys(["row_id", "loan_id", "reporting_month", name, *base, *columns])), name, base, columns, recipe.rounds, (), recipe.method)
        return fitted[name]

    def probabilities() -> DataFrame:
        out = mod.score_targets(new, [target(t) for t in TARGETS], TARGETS)
        return out.select("row_id", *[F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in TARGETS.values()])

    def next_state() -> DataFrame:
        names = [c for c in TRANSITION_COLUMNS if c in told.columns]
        moves = written(tra.transition_frame(told.drop("next_state")).select(*dict.fromkeys(["from_state", "to_state", "loan_age_months", *names])))
        cells = checkpoint(tra.empirical_matrix(moves))
        models = mod.transition_model(moves, names)
        at = tra.one_step_scores(new.select(*dict.fromkeys(["row_id", "current_status", "loan_age_months", *names])).withColumn("from_state", F.col("current_status")), cells)
        scored = tra.score_next_state(mod.score_transitions(at, models, names), "p_model")
        return scored.select("row_id", F.coalesce("next_state_pred", "current_status").alias("next_state_pred"), F.coalesce("next_state_confidence", F.lit(0.0)).alias("next_state_confidence"))

    def anomalies() -> DataFrame:
        names = sco.detector_features(told.select([c for c in told.columns if c not in ("origin", "score_order")]))
        forest = simulate.fit_isolation_forest(told, names, recipe.trees)
        return sco.anomaly_score(forest.score(new.select("row_id", *names))).select("row_id", "anomaly_score", "anomaly_flagged")

    def exceptions() -> DataFrame:
        rows = new.join(stages.table("anomalies", anomalies), "row_id")
        return rows.select("row_id", rul.rule_covered().cast("int").alias("exception_required_pred"), rul.rule_assigned_type().alias("exception_type_pred"), sco.exception_confidence().alias("exception_confidence"))

    def drivers() -> DataFrame:
        known = [t for t in EXPLAINED if target(t).model is not None]
        if known:
            # Rules tell the drivers of covered rows, and no more than the largest parts of others are shuffled.
            values = attributions_of(target(known[0]), new.where(~rul.rule_covered()), told, TOP_DRIVERS)
        else:
            values = new.select("row_id", F.lit("").alias("source"), F.lit(0.0).alias("value")).limit(0)
        return sco.driver_text(new, values.select("row_id", "source", "value"), TOP_DRIVERS).select("row_id", "top_drivers")

    def spread() -> DataFrame:
        rows = mod.temporal_ensemble(told, new.select("row_id", *columns), CONFIDENCE_TARGET, columns, CONFIDENCE_FOLDS, recipe.rounds)
        return sco.model_confidence(rows.select("row_id", "relative_spread")).select("row_id", "model_confidence")

    independent = {"confidence": spread, "next_state": next_state, "anomalies": anomalies}
    jobs = [lambda t=t: target(t) for t in TARGETS] if not stages.done("probabilities") else []
    _at_once(spark, jobs + [lambda name=name, make=make: stages.table(name, make) for name, make in independent.items()])
    out = new.select("row_id", "loan_id", "reporting_month")
    made = {"probabilities": probabilities, "next_state": next_state, "anomalies": anomalies, "exceptions": exceptions, "drivers": drivers, "confidence": spread}
    for name, make in made.items():
        out = out.join(stages.table(name, make).drop("anomaly_flagged"), "row_id")
    return stages.table("file", lambda: sco.build_submission(out, ["row_id"]))
