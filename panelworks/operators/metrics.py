"""Metrics of scores against 0/1 labels, from counts by distinct score."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from panelworks.session import checkpoint


def prefix_sums(counts: DataFrame, order: str, sums: list[str], partitions: int | None = None) -> DataFrame:
    """``counts`` with up_<c>: the sum of c over all rows of a smaller ``order``; a global running sum.

    Rows are dealt by range of ``order`` and sorted in their places, in one shuffle; each partition sums its own rows
    as they come, and the totals of the partitions before it (one row each) are added. No task sees all rows.
    """
    spark = counts.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(counts.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    ends = dealt.groupBy("_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{c}") for c in sums])
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in sums])
    kinds = [offsets.schema[f"_o_{c}"].dataType for c in sums]
    schema = StructType([*dealt.schema.fields, *[StructField(f"_l_{c}", kind) for c, kind in zip(sums, kinds)]])
    out = dealt.mapInArrow(_running([dealt.columns.index(c) for c in sums], [f"_l_{c}" for c in sums], kinds), schema).join(F.broadcast(offsets), "_part")
    return out.withColumns({f"up_{c}": F.col(f"_l_{c}") + F.col(f"_o_{c}") for c in sums}).drop("_part", *[f"_l_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def _running(at: list[int], names: list[str], kinds: list[DataType]):
    """Adds what the rows before each row sum up to, in the order in which they come."""
    types = [to_arrow_type(kind) for kind in kinds]

    def run(batches):
        before = [0] * len(at)
        for batch in batches:
            added = []
            for i, (column, kind) in enumerate(zip(at, types)):
                x = batch.column(column).fill_null(0).cast(kind)
                so_far = pc.cumulative_sum(x, start=pa.scalar(before[i], kind))
                added.append(pc.subtract(so_far, x).cast(kind))
                if len(so_far):
                    before[i] = so_far[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return run


def quantiles(rows: DataFrame, qs: list[float]) -> DataFrame:
    """(g, n, q): exact quantiles of x by group, interpolated between neighbours.

    ``rows`` has g (a few groups; one row for each is broadcast) and x; null x is left out. Values are counted,
    their places found by prefix sums, and only the values at the wanted places meet in one task.
    """
    counts = rows.where("x IS NOT NULL").groupBy("g", "x").agg(F.count("*").alias("n"))
    placed = prefix_sums(counts.select(F.struct("g", "x").alias("k"), "n"), "k", ["n"]).select("k.g", "k.x", "n", "up_n")
    ends = placed.groupBy("g").agg(F.sum("n").alias("_total"), F.min("up_n").alias("_base"))
    placed = placed.join(F.broadcast(ends), "g").withColumn("_from", F.col("up_n") - F.col("_base"))
    place = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    here = lambda p: F.max(F.when((F.col("_from") <= p) & (p < F.col("_from") + F.col("n")), F.col("x")))
    cells = [here(f(place(q))).alias(f"_{name}{i}") for i, q in enumerate(qs) for f, name in ((F.floor, "lo"), (F.ceil, "hi"))]
    out = placed.groupBy("g").agg(F.max("_total").alias("_total"), *cells)
    value = lambda i, q: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place(q) - F.floor(place(q)))
    return out.select("g", F.col("_total").alias("n"), F.array(*[value(i, q) for i, q in enumerate(qs)]).alias("q"))


#: A sketch places a value within this share of the rows; brackets are twice as wide on both sides.
_SKETCH = 2000


def quantile_row(df: DataFrame, columns: dict[str, Column], qs: list[float], prefix: str) -> DataFrame:
    """One row with <prefix><name>: the exact quantiles of each column as an array; null where it has no value.

    A mergeable sketch brackets each wanted place in one pass, a second pass counts what lies below each bracket, and
    only the values inside of them, some thousandths of all, are placed among each other. Where a bracket
    missed its place, or a column holds NaN, all its values are.
    """
    names = list(columns)
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
    wide = 2 / _SKETCH
    shares = [min(1.0, max(0.0, q + d)) for q in qs for d in (-wide, wide)]
    told = rows.agg(*[
        F.struct(F.count(x), F.count_if(F.isnan(x)), F.percentile_approx(x, shares, _SKETCH)).alias(x) for x in rows.columns
    ]).first()  # one row of a few numbers for each column
    brackets = {(i, k): (told[i][2][2 * k], told[i][2][2 * k + 1]) for i in range(len(names)) if told[i][0] and not told[i][1] for k in range(len(qs))}
    found: dict[int, list[float]] = {}
    if brackets:
        below = rows.agg(*[F.count_if(F.col(f"x{i}") < lo).alias(f"b{i}_{k}") for (i, k), (lo, _) in brackets.items()]).first()
        cells = F.array(*[F.when(F.col(f"x{i}").between(lo, hi), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"x{i}").alias("x"))) for (i, k), (lo, hi) in brackets.items()])
        inside = rows.select(F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).groupBy("c.i", "c.k", "c.x").agg(F.count("*").alias("n"))
        placed = checkpoint(prefix_sums(inside.select(F.struct("i", "k", "x").alias("o"), "n"), "o", ["n"]).select("o.*", "n", "up_n"))
        base = placed.groupBy("i", "k").agg(F.min("up_n").alias("base"))
        # The place counts from the bracket's first value, where it is the only part of the panel that is looked at.
        wanted = [(i, k, math.floor(p) - below[f"b{i}_{k}"], math.ceil(p) - below[f"b{i}_{k}"]) for i, k in brackets for p in [qs[k] * (told[i][0] - 1)]]
        asked = F.broadcast(df.sparkSession.createDataFrame(wanted, "i int, k int, lo long, hi long"))
        first, n = F.col("up_n") - F.col("base"), F.col("n")
        here = lambda p: F.max(F.when((first <= F.col(p)) & (F.col(p) < first + n), F.col("x")))
        ends = placed.join(F.broadcast(base), ["i", "k"]).join(asked, ["i", "k"]).groupBy("i", "k").agg(here("lo").alias("lo"), here("hi").alias("hi"))
        for r in ends.collect():  # a row for each column and quantile
            if r["lo"] is not None and r["hi"] is not None:
                p = qs[r["k"]] * (told[r["i"]][0] - 1)
                found.setdefault(r["i"], [None] * len(qs))[r["k"]] = r["lo"] + (r["hi"] - r["lo"]) * (p - math.floor(p))
    missed = [i for i in range(len(names)) if told[i][0] and (i not in found or None in found[i])]
    if missed:
        cells = F.array(*[F.struct(F.lit(i).alias("g"), F.col(f"x{i}").alias("x")) for i in missed])
        found |= {r["g"]: list(r["q"]) for r in quantiles(rows.select(F.explode(cells).alias("c")).select("c.*"), qs).collect()}
    schema = StructType([StructField(f"{prefix}{name}", ArrayType(DoubleType())) for name in names])
    return df.sparkSession.createDataFrame([tuple(found.get(i) for i in range(len(names)))], schema)


def auc_by_group(rows: DataFrame) -> DataFrame:
    """(g, roc_auc, pr_auc, pr_auc_lift) of rows with g, y (0 or 1) and s; null where a class is missing.

    One prefix sum over (g, s) serves all groups, so a large group is no large task.
    """
    counts = rows.where("y IS NOT NULL AND s IS NOT NULL").groupBy("g", "s").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    placed = prefix_sums(counts.select(F.struct("g", "s").alias("k"), "pos", "neg"), "k", ["pos", "neg"]).select("k.g", "pos", "neg", "up_pos", "up_neg")
    ends = placed.groupBy("g").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.min("up_pos").alias("_bp"), F.min("up_neg").alias("_bn"))
    cut = placed.join(ends, "g").withColumns({"tp": F.col("all_pos") - (F.col("up_pos") - F.col("_bp")), "fp": F.col("all_neg") - (F.col("up_neg") - F.col("_bn"))})
    both = F.first("all_pos") * F.first("all_neg")
    area = F.sum(F.col("pos") * (F.col("up_neg") - F.col("_bn") + F.col("neg") / 2)) / F.nullif(both, F.lit(0))
    ap = F.when(both > 0, F.sum(F.col("tp") / (F.col("tp") + F.col("fp")) * F.col("pos")) / F.first("all_pos"))
    base = F.first("all_pos") / (F.first("all_pos") + F.first("all_neg"))
    return cut.groupBy("g").agg(area.alias("roc_auc"), ap.alias("pr_auc"), (ap / F.nullif(base, F.lit(0.0))).alias("pr_auc_lift"))


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """(s, pos, neg, up_pos, up_neg, all_pos, all_neg) by distinct score."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg")
    )
    sums = prefix_sums(counts, "s", ["pos", "neg"])
    total = sums.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return sums.crossJoin(F.broadcast(total))


def roc_auc(table: DataFrame) -> DataFrame:
    """Exact, ties count half; null if a class is missing."""
    area = F.sum(F.col("pos") * (F.col("up_neg") + F.col("neg") / 2)) / F.nullif(F.first("all_pos") * F.first("all_neg"), F.lit(0))
    return table.agg(area.alias("roc_auc"))


def _at_threshold(table: DataFrame) -> DataFrame:
    """tp and fp of taking every row with a score of s or more."""
    return table.withColumns({"tp": F.col("all_pos") - F.col("up_pos"), "fp": F.col("all_neg") - F.col("up_neg")}).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def pr_auc(table: DataFrame) -> DataFrame:
    """Average precision and its lift over the prevalence."""
    cut = _at_threshold(table)
    ap = F.sum(F.col("precision") * F.col("pos")) / F.nullif(F.first("all_pos"), F.lit(0))
    base = F.first("all_pos") / F.nullif(F.first("all_pos") + F.first("all_neg"), F.lit(0))
    return cut.agg(ap.alias("pr_auc"), (ap / F.nullif(base, F.lit(0.0))).alias("pr_auc_lift"))


def recall_at_precision(table: DataFrame, bars: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    cut = _at_threshold(table)
    best = lambda bar: F.coalesce(F.max(F.when(F.col("precision") >= bar, F.col("tp") / F.nullif(F.col("all_pos"), F.lit(0)))), F.lit(0.0))
    return cut.agg(*[best(b).alias(f"recall_at_p{int(b * 100)}") for b in bars])


def choose_threshold(table: DataFrame, bar: float = 0.5) -> DataFrame:
    """(threshold, recall, reason): the lowest threshold of the highest recall with that precision, else 0.5."""
    cut = _at_threshold(table).where(F.col("precision") >= bar)
    best = cut.agg(F.max(F.struct((F.col("tp") / F.col("all_pos")).alias("recall"), (-F.col("s")).alias("below"))).alias("b"))
    return best.select(
        F.coalesce(-F.col("b.below"), F.lit(0.5)).alias("threshold"), F.coalesce("b.recall", F.lit(0.0)).alias("recall"),
        F.when(F.col("b").isNull(), "precision not reachable").otherwise("highest recall at the precision").alias("reason"),
    )


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = df.agg(n(y & hit).alias("tp"), n(~y & hit).alias("fp"), n(y & ~hit).alias("fn"), n(~y & ~hit).alias("tn"))
    return out.withColumns({"precision": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))})


def reliability_bins(df: DataFrame, label: str, score: str, n_bins: int = 10, tie: str = "row_id") -> DataFrame:
    """(bin, n, mean_predicted, observed_rate, gap) of bins with equal counts; the first ones take the rest.

    The position of a row comes from prefix sums over distinct (score, tie) keys.
    """
    rows = df.select(F.struct(F.col(score).alias("s"), F.col(tie).alias("t")).alias("k"), F.col(label).cast("double").alias("y"), F.lit(1).cast("long").alias("one"))
    placed = prefix_sums(rows, "k", ["one"]).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))
    size, extra = F.floor(F.col("total") / n_bins), F.col("total") % n_bins
    at = F.col("up_one")
    big = extra * (size + 1)
    b = F.when(at < big, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - big) / F.greatest(size, F.lit(1)))) + 1
    return placed.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("k.s").alias("mean_predicted"), F.avg("y").alias("observed_rate")).withColumn("gap", F.col("mean_predicted") - F.col("observed_rate"))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def binary_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: n, prevalence, f1, brier, ece, roc_auc, pr_auc, pr_auc_lift and recalls."""
    y, p = F.col(label).cast("double"), F.col(score)
    tp = F.sum(((F.col(label) == 1) & (p >= 0.5)).cast("long"))
    base = df.agg(
        F.count("*").alias("n"), F.avg(y).alias("prevalence"), F.avg((p - y) * (p - y)).alias("brier"),
        F.coalesce(2 * tp / F.nullif(F.sum((p >= 0.5).cast("long")) + F.sum(y.cast("long")), F.lit(0)), F.lit(0.0)).alias("f1"),
    )
    table = checkpoint(score_table(df, label, score))
    return base.crossJoin(roc_auc(table)).crossJoin(pr_auc(table)).crossJoin(recall_at_precision(table)).crossJoin(ece(reliability_bins(df, label, score)))


def calibration_by_segment(df: DataFrame, label: str, score: str, segment: str, least: int = 200) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(score)
    out = df.where(F.col(segment).isNotNull()).groupBy(F.col(segment).cast("string").alias("segment")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed_rate"), F.avg((p - y) * (p - y)).alias("brier")
    )
    return out.where(F.col("n") >= least).withColumn("gap", F.col("mean_predicted") - F.col("observed_rate"))


def slice_metrics(df: DataFrame, label: str, score: str, segment: str, least: int = 200) -> DataFrame:
    """By segment: n, observed rate, mean score, share at or above the 95th percentile, AUC and AP lift."""
    bar = quantile_row(df, {"bar": F.col(score)}, [0.95], "_")
    rows = df.where(F.col(segment).isNotNull()).select(F.col(segment).cast("string").alias("segment"), F.col(label).alias("y"), F.col(score).alias("s"))
    flat = rows.crossJoin(F.broadcast(bar)).groupBy("segment").agg(
        F.count("*").alias("n"), F.avg("y").alias("observed_rate"), F.avg("s").alias("mean_predicted"), F.avg((F.col("s") >= F.col("_bar")[0]).cast("double")).alias("selection_rate")
    )
    auc = auc_by_group(rows.withColumnRenamed("segment", "g")).select(F.col("g").alias("segment"), "roc_auc", "pr_auc_lift")
    return flat.where(F.col("n") >= least).join(auc, "segment", "left")


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1); a class without predictions or rows has F1 0."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select("n", F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("is_y")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_y")))).alias("k"), (F.col("y") == F.col("p")).alias("hit"))
    classes = sides.groupBy("k.c").agg(
        F.sum(F.when(F.col("k.is_y") == 1, F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(F.col("k.is_y") == 0, F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("hit") & (F.col("k.is_y") == 1), F.col("n")).otherwise(0)).alias("tp"),
    ).withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(F.col("rows") + F.col("said"), F.lit(0)), F.lit(0.0)))
    return classes.agg((F.sum("tp") / F.sum("rows")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("rows")) / F.sum("rows")).alias("weighted_f1"))


def error_profile(df: DataFrame, label: str, score: str, columns: list[str], threshold: float = 0.5, least: int = 5, top: int = 10) -> DataFrame:
    """(error, feature, gap): how far features of false calls lie from those of right ones, in deviations."""
    hit = F.col(score) >= threshold
    outcome = F.when(F.col(label) == 1, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN"))
    rows = df.select(outcome.alias("o"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f"))
    stats = rows.groupBy("f.feature", "o").agg(F.count("f.x").alias("n"), F.avg("f.x").alias("m"), F.var_samp("f.x").alias("v"))
    right = stats.select("feature", F.when(F.col("o") == "TN", "FP").when(F.col("o") == "TP", "FN").alias("o"), F.col("n").alias("rn"), F.col("m").alias("rm"), F.col("v").alias("rv"))
    gap = (F.col("m") - F.col("rm")) / F.nullif(F.sqrt((F.col("v") + F.col("rv")) / 2), F.lit(0.0))
    pairs = stats.where("o IN ('FP', 'FN')").join(F.broadcast(right.where("o IS NOT NULL")), ["feature", "o"])
    pairs = pairs.where((F.col("n") >= least) & (F.col("rn") >= least)).select(F.col("o").alias("error"), "feature", gap.alias("gap")).where("gap IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("error").orderBy(F.desc(F.abs("gap")), "feature"))
    return pairs.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def segment_errors(df: DataFrame, label: str, score: str, segments: list[str], threshold: float = 0.5, least: int = 150) -> DataFrame:
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    rows = df.select(y.alias("y"), hit.alias("h"), F.explode(F.array(*[F.struct(F.lit(s).alias("segment_type"), F.col(s).cast("string").alias("segment")) for s in segments])).alias("g"))
    n = lambda c: F.sum(c.cast("long"))
    y, h = F.col("y"), F.col("h")
    out = rows.where("g.segment IS NOT NULL").groupBy("g.segment_type", "g.segment").agg(
        F.count("*").alias("n"), n(y).alias("positives"), (n(~y & h) / F.nullif(n(~y), F.lit(0))).alias("fp_rate"), (n(y & ~h) / F.nullif(n(y), F.lit(0))).alias("fn_rate")
    )
    return out.where(F.col("n") >= least)


def score_deciles(df: DataFrame, label: str, score: str) -> DataFrame:
    """(decile, n, rate) by quantile edges, right-closed, repeated edges dropped."""
    edges = quantile_row(df, {"e": F.col(score)}, [i / 10 for i in range(11)], "_").select(F.array_distinct("_e").alias("e"))
    rows = df.crossJoin(F.broadcast(edges))
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    return rows.groupBy((F.size(F.filter(inner, lambda x: x < F.col(score))) + 1).alias("decile")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))


def score_histogram(df: DataFrame, score: str, bins: int = 60) -> DataFrame:
    return df.where(F.col(score).isNotNull()).groupBy(F.least(F.floor(F.col(score) * bins) + 1, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def confidence_band(
    df: DataFrame, spread: str = "relative_spread", cuts: tuple[float, float] = (1 / 3, 2 / 3), fixed: tuple[float, float] | None = None
) -> DataFrame:
    """confidence: terciles of the spread (or quantiles at ``cuts``); one band if the edges meet.

    ``fixed`` puts the edges at these values of the spread itself, (0.25, 0.75) for example. A row without a spread
    has an unknown confidence.
    """
    s, e = F.col(spread), F.col("_e")
    missing = s.isNull() | F.isnan(s.cast("double"))
    band = F.when(missing, "unknown").when(e[0] >= e[1], "medium").when(s <= e[0], "high").when(s <= e[1], "medium").otherwise("low")
    if fixed:
        return df.withColumn("_e", F.array(*[F.lit(float(x)) for x in fixed])).withColumn("confidence", band).drop("_e")
    edges = quantile_row(df, {"e": F.col(spread)}, list(cuts), "_")
    return df.crossJoin(F.broadcast(edges)).withColumn("confidence", band).drop("_e")


def temporal_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean_prediction, spread (population deviation), low, high and relative_spread of fold scores.

    At least two folds are needed; null scores are left out of a row's figures.
    """
    if len(columns) < 2:
        raise ValueError("at least two folds are needed")
    # Plain arithmetic over the columns: Spark compiles it, and does not work out a lambda's parts anew for each fold.
    ps = [F.col(c).cast("double") for c in columns]
    n = sum((p.isNotNull().cast("int") for p in ps), F.lit(0))
    mean = lambda xs: sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)) / F.nullif(F.col("_n"), F.lit(0))
    df = df.withColumn("_n", n).withColumn("mean_prediction", mean(ps))
    df = df.withColumns({"spread": F.sqrt(mean([(p - F.col("mean_prediction")) * (p - F.col("mean_prediction")) for p in ps])), "low": F.least(*ps), "high": F.greatest(*ps)})
    return df.withColumn("relative_spread", F.col("spread") / F.when(F.col("mean_prediction").isNotNull(), F.greatest("mean_prediction", F.lit(1e-6)))).drop("_n")


def spread_summary(df: DataFrame) -> DataFrame:
    """(mean_spread, median_spread, n_wide, pct_wide): rows whose spread exceeds their mean prediction."""
    wide = F.coalesce((F.col("spread") > F.col("mean_prediction")), F.lit(False))
    rest = df.agg(F.avg("spread").alias("mean_spread"), F.sum(wide.cast("long")).alias("n_wide"), (100 * F.avg(wide.cast("double"))).alias("pct_wide"))
    middle = quantile_row(df, {"m": F.col("spread")}, [0.5], "_")
    return rest.crossJoin(F.broadcast(middle)).select("mean_spread", F.col("_m")[0].alias("median_spread"), "n_wide", "pct_wide")


def band_check(df: DataFrame, label: str, score: str, band: str = "confidence", least: int = 50) -> DataFrame:
    """(band, n, observed_rate, mean_predicted, brier, roc_auc) of bands with enough rows."""
    y, p = F.col(label).cast("double"), F.col(score)
    out = df.groupBy(F.col(band).alias("band")).agg(F.count("*").alias("n"), F.avg(y).alias("observed_rate"), F.avg(p).alias("mean_predicted"), F.avg((p - y) * (p - y)).alias("brier"))
    auc = auc_by_group(df.select(F.col(band).alias("g"), F.col(label).alias("y"), p.alias("s"))).select(F.col("g").alias("band"), "roc_auc")
    return out.where(F.col("n") >= least).join(auc, "band", "left")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(v, r): the average rank of each distinct value, from 1 on; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return prefix_sums(counts, "v", ["n"]).select("v", (F.col("up_n") + (F.col("n") + 1) / 2).alias("r"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman): the correlation of average ranks over rows with both values."""
    # The filter comes after the checkpoint: before it, the optimizer would work out both columns once more for it.
    df = checkpoint(df.select(F.col(a).alias("a"), F.col(b).alias("b"))).where("a IS NOT NULL AND b IS NOT NULL")
    ra, rb = (average_ranks(df, c).select(F.col("v").alias(c), F.col("r").alias(f"r{c}")) for c in ("a", "b"))
    return df.join(ra, "a").join(rb, "b").agg(F.corr("ra", "rb").alias("spearman"))
