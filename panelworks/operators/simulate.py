"""Sampled paths, resampled metrics and isolation trees: small numpy helpers inside Spark jobs."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelworks.operators.metrics import quantile_row
from panelworks.operators.transitions import AGE_BUCKETS, _stress_kinds, scenario_matrices
from panelworks.schema import ABSORBING, STATES
from panelworks.session import checkpoint

N_SIMS = 300


def uniform(seeds: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) of 64-bit seeds and counters (broadcast against each other), by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        x = seeds.astype(np.uint64) + (counters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def monte_carlo(loans: DataFrame, cells: DataFrame, scenarios: DataFrame, horizon: int = 12, n_sims: int = N_SIMS) -> DataFrame:
    """(scenario, sim, month, share_default, share_prepaid, share_delinquent) of sampled portfolio paths.

    Every loan draws its own steps from a 64-bit hash of its id, so results do not depend on how rows are
    dealt; a block of loans is drawn at once. A partition emits counts by scenario, sim and month only: their
    number has a bound, and no row for each loan and sim ever exists.
    """
    tables: dict[str, np.ndarray] = {}
    for r in scenario_matrices(cells, scenarios).collect():  # six matrices for each scenario
        tables.setdefault(r["scenario"], np.zeros((6, 6, 6)))[r["bucket"] + 1] = np.array(r["m"])
    upper = {s: m.cumsum(axis=2) for s, m in tables.items()}
    ages = np.array([lo for lo, _ in AGE_BUCKETS])

    def run(batches):
        counts = {s: np.zeros((horizon + 1, n_sims * 6), np.int64) for s in upper}
        sims = np.arange(n_sims)
        for batch in batches:
            seeds, start, age = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            for lo in range(0, len(seeds), 256):
                seed, first, old = seeds[lo : lo + 256, None], start[lo : lo + 256], age[lo : lo + 256]
                for k, (name, cum) in enumerate(sorted(upper.items())):
                    at = np.repeat(first[:, None], n_sims, axis=1)
                    counts[name][0] += np.bincount((sims * 6 + at).ravel(), minlength=n_sims * 6)
                    for h in range(horizon):
                        now = old + h
                        bucket = np.where((now >= 0) & (now < 999), np.searchsorted(ages, now, side="right"), 0)
                        draw = uniform(seed, (k * horizon + h) * n_sims + sims)
                        at = np.minimum((cum[bucket[:, None], at] < draw[:, :, None]).sum(axis=2), 5)
                        counts[name][h + 1] += np.bincount((sims * 6 + at).ravel(), minlength=n_sims * 6)
        yield from _counted(counts, horizon, n_sims)

    place = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("current_status")) - 1
    rows = loans.select(
        F.xxhash64(F.col("loan_id").cast("string")).alias("seed"), F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("long").alias("start"),
        F.coalesce(F.col("loan_age_months").cast("long"), F.lit(0)).alias("age"),
    )
    return _shares(rows.mapInArrow(run, _COUNTS))


_COUNTS = "scenario string, sim long, month long, n long, d long, q long, l long"


def _counted(counts: dict[str, np.ndarray], horizon: int, n_sims: int):
    """A batch for each scenario: how many loans, and how many of them in default, prepaid and delinquent."""
    for name, c in counts.items():
        c = c.reshape(horizon + 1, n_sims, 6)
        month, sim = np.meshgrid(np.arange(horizon + 1), np.arange(n_sims), indexing="ij")
        columns = [sim, month, c.sum(axis=2), c[:, :, 4], c[:, :, 5], c[:, :, 1:4].sum(axis=2)]
        yield pa.RecordBatch.from_arrays([pa.array([name] * sim.size), *(pa.array(x.ravel()) for x in columns)], names=["scenario", "sim", "month", "n", "d", "q", "l"])


def _shares(partial: DataFrame) -> DataFrame:
    total = partial.groupBy("scenario", "sim", "month").agg(*[F.sum(c).alias(c) for c in "ndql"])
    share = lambda c: F.col(c) / F.nullif(F.col("n"), F.lit(0))
    return total.select("scenario", "sim", "month", share("d").alias("share_default"), share("q").alias("share_prepaid"), share("l").alias("share_delinquent"))


def monte_carlo_covariates(steps: DataFrame, scenarios: DataFrame, horizon: int = 12, n_sims: int = N_SIMS) -> DataFrame:
    """As :func:`monte_carlo`, from matrices of each loan and step (``models.covariate_matrices``).

    A loan's matrices meet once and are stressed and cumulated once; all its draws use them. Partitions emit counts
    only. Loans are numbered by row_id; a repeated row_id is one loan.
    """
    tables = [(r["scenario"], r["default_mult"], r["delinq_mult"], r["prepay_mult"]) for r in scenarios.orderBy("scenario").collect()]  # a handful
    kinds, stay = np.array(_stress_kinds()), np.eye(6, dtype=bool)
    free = np.array([s not in ABSORBING for s in STATES])[:, None]

    def stress(m: np.ndarray, default: float, delinq: float, prepay: float) -> np.ndarray:
        if default == delinq == prepay == 1.0:
            return m
        scaled = m * np.array([1.0, delinq, default, prepay])[kinds]
        kept = m.diagonal(axis1=-2, axis2=-1) - (scaled - m).sum(axis=-1)
        scaled = np.maximum(np.where(stay, kept[..., None], scaled), 0.0)
        total = scaled.sum(axis=-1, keepdims=True)
        return np.where(free, scaled / np.where(total > 0, total, 1.0), m)

    def run(batches):
        counts = {name: np.zeros((horizon + 1, n_sims * 6), np.int64) for name, *_ in tables}
        sims = np.arange(n_sims)
        for batch in batches:
            seeds, start = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            m = batch.column(2).flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(seeds), horizon, 6, 6)
            for k, (name, *mults) in enumerate(tables):
                cum = stress(m, *mults).cumsum(axis=3)
                for lo in range(0, len(seeds), 256):
                    seed, own = seeds[lo : lo + 256, None], cum[lo : lo + 256]
                    at, loan = np.repeat(start[lo : lo + 256, None], n_sims, axis=1), np.arange(len(own))[:, None]
                    counts[name][0] += np.bincount((sims * 6 + at).ravel(), minlength=n_sims * 6)
                    for h in range(horizon):
                        draw = uniform(seed, (k * horizon + h) * n_sims + sims)
                        at = np.minimum((own[loan, h, at] < draw[:, :, None]).sum(axis=2), 5)
                        counts[name][h + 1] += np.bincount((sims * 6 + at).ravel(), minlength=n_sims * 6)
        yield from _counted(counts, horizon, n_sims)

    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.first("current_status")) - 1, F.lit(0))
    ordered = F.transform(F.sort_array(F.collect_set(F.struct("h", F.flatten("m").alias("m")))), lambda x: x["m"])  # ``horizon`` matrices
    loans = steps.groupBy("row_id").agg(F.greatest(place, F.lit(0)).cast("long").alias("start"), ordered.alias("ms"))
    return _shares(loans.select(F.xxhash64("row_id").alias("seed"), "start", "ms").mapInArrow(run, _COUNTS))


def mc_percentiles(paths: DataFrame, share: str = "share_default") -> DataFrame:
    """(scenario, month, p5, p25, p50, p75, p95, mean) of a share over sims."""
    q = F.percentile(share, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = paths.groupBy("scenario", "month").agg(q.alias("q"), F.avg(share).alias("mean"))
    return out.select("scenario", "month", *[F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))], "mean")


def mc_bands(paths: DataFrame) -> DataFrame:
    """The percentiles of all three shares: (share, scenario, month, p5 ... mean)."""
    out = None
    for share in ("share_default", "share_prepaid", "share_delinquent"):
        part = mc_percentiles(paths, share).select(F.lit(share).alias("share"), "*")
        out = part if out is None else out.unionByName(part)
    return out


#: Shares of the Poisson distribution of mean 1 up to 0, 1, 2 ...
_POISSON = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(16)])


def cluster_bootstrap(df: DataFrame, label: str, score: str, cluster: str = "loan_id", n: int = 400, least: int = 30) -> DataFrame:
    """(metric, low, high, n_usable): loan-clustered 95 % intervals of AUC and average precision, exact with ties.

    A cluster has a Poisson(1) weight in each replicate, drawn from a hash of its id. Rows are dealt by range of
    the score; a first pass sums the weights of each partition, a second one adds those of the partitions before
    and emits a replicate's share of both areas. Under ``least`` usable replicates the intervals are null.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.xxhash64(F.col(cluster).cast("string")).alias("k"), (F.col(label) == 1).cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(rows.repartitionByRange(parts, F.col("s").desc()).sortWithinPartitions(F.col("s").desc()).withColumn("part", F.spark_partition_id()))

    def weights(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, y, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        w = np.searchsorted(_POISSON, uniform(k.astype(np.int64)[:, None], np.arange(n)), side="right")
        return w * (y == 1)[:, None], w * (y != 1)[:, None], s

    def totals(batches):
        pos, neg, part = np.zeros(n), np.zeros(n), None
        for batch in batches:
            if batch.num_rows:
                a, b, _ = weights(batch)
                pos, neg, part = pos + a.sum(axis=0), neg + b.sum(axis=0), batch.column(3)[0].as_py()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pos.tolist()]), pa.array([neg.tolist()])], names=["part", "pos", "neg"])

    ends = {r["part"]: (np.array(r["pos"]), np.array(r["neg"])) for r in dealt.mapInArrow(totals, "part int, pos array<double>, neg array<double>").collect()}  # one row for each partition
    above, before = (np.zeros(n), np.zeros(n)), {}
    for part in sorted(ends):
        before[part] = above
        above = above[0] + ends[part][0], above[1] + ends[part][1]

    def areas(batches):
        """Sums over groups of equal scores; the group that a batch ends in is held until its end is seen."""
        tp = fp = None
        auc, ap, held = np.zeros(n), np.zeros(n), None

        def close(pos, neg):
            nonlocal tp, fp, auc, ap
            auc = auc + neg * (tp + pos / 2)
            tp, fp = tp + pos, fp + neg
            ap = ap + np.divide(pos * tp, tp + fp, out=np.zeros(n), where=tp + fp > 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            if tp is None:
                tp, fp = before[batch.column(3)[0].as_py()]
            pos, neg, s = weights(batch)
            starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
            for i, at in enumerate(starts):
                if held and held[0] == s[at]:
                    held = held[0], held[1] + pos[i], held[2] + neg[i]
                    continue
                if held:
                    close(*held[1:])
                held = s[at], pos[i], neg[i]
        if held:
            close(*held[1:])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(auc), pa.array(ap)], names=["rep", "auc", "ap"])

    usable = (above[0] > 0) & (above[1] > 0)
    sums = dealt.mapInArrow(areas, "rep long, auc double, ap double").groupBy("rep").agg(F.sum("auc").alias("auc"), F.sum("ap").alias("ap")).collect()  # one row for each replicate
    found = {"roc_auc": [r["auc"] / (above[0] * above[1])[r["rep"]] for r in sums if usable[r["rep"]]], "pr_auc": [r["ap"] / above[0][r["rep"]] for r in sums if usable[r["rep"]]]}
    out = [(m, *(map(float, np.percentile(x, [2.5, 97.5])) if len(x) >= least else (None, None)), len(x)) for m, x in found.items()]
    return df.sparkSession.createDataFrame(out, "metric string, low double, high double, n_usable long")


# Fixed value: the raw score below which a row is flagged where no share is given.
AUTO_OFFSET = -0.5


@dataclass
class IsolationForest:
    """Trees, the medians that fill gaps, and the raw score below which a row is flagged."""

    columns: list[str]
    medians: dict[str, float]
    trees: list
    offset: float | None

    def _filled(self) -> list[Column]:
        return [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(f"_f{i}") for i, c in enumerate(self.columns)]

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with raw (minus the isolation score, so that lower is stranger) and anomaly_flagged."""
        held, n, wide = rows.sparkSession.sparkContext.broadcast([(size, *_flat(tree)) for size, tree in self.trees]), len(self.columns), len(rows.columns)

        def run(batches):
            for batch in batches:
                x = np.column_stack([batch.column(wide + i).to_numpy(zero_copy_only=False) for i in range(n)])
                total, scale = np.zeros(len(x)), 0.0
                for size, *tree in held.value:
                    total += _depths(x, *tree)
                    scale += _mean_path(size)
                yield pa.RecordBatch.from_arrays([*batch.columns[:wide], pa.array(-np.power(2.0, -total / max(scale, 1e-9)))], names=[*batch.schema.names[:wide], "raw"])

        scored = rows.select("*", *self._filled()).mapInArrow(run, StructType([*rows.schema.fields, StructField("raw", DoubleType())]))
        return scored.withColumn("anomaly_flagged", F.col("raw") < F.lit(self.offset))


def fit_isolation_forest(train: DataFrame, columns: list[str], trees: int = 300, sample: int = 256, contamination: float | None = None) -> IsolationForest:
    """Trees grow on hash-chosen samples of the training rows, one group of at most about ``sample`` rows for each
    tree; scoring is a map with the trees broadcast (some 10 kB each). Nulls take the training median. Rows below the
    offset are flagged: the ``contamination`` quantile of the training rows' own scores, or half way if that is None.
    """
    train = checkpoint(train.select("row_id", *dict.fromkeys(columns)))
    row = quantile_row(train, {c: F.col(c) for c in columns}, [0.5], "").first()
    forest = IsolationForest(columns, {c: float(row[c][0] or 0.0) if row[c] else 0.0 for c in columns}, [], None)
    names = [f"_f{i}" for i in range(len(columns))]
    n = max(1, train.count())
    below = min(1.0, sample / n) * 2.0**64 - 2.0**63  # of all 64 bits, so that no panel is too large for a share above 0
    # Only rows that a tree picks leave the compiled loop over rows and trees; a lambda over an array of trees takes six times as long.
    each = train.select("row_id", *forest._filled(), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    picks = each.where(F.xxhash64("row_id", "tree").cast("double") <= below)

    def grow(pdf):
        import pandas as pd

        tree = int(pdf["tree"].iloc[0])
        r = np.random.default_rng(tree)
        x = pdf.sort_values("row_id")[names].to_numpy(float)
        limit = max(1, int(np.ceil(np.log2(max(2, len(x))))))

        def split(part, depth):
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
            if depth >= limit or len(part) <= 1 or not len(spread):
                return [depth + _mean_path(len(part))]
            c = int(r.choice(spread))
            cut = float(r.uniform(part[:, c].min(), part[:, c].max()))
            low = part[:, c] < cut
            return [c, cut, split(part[low], depth + 1), split(part[~low], depth + 1)]

        return pd.DataFrame({"tree": [tree], "body": [json.dumps([len(x), split(x, 0)])]})

    forest.trees = [json.loads(r["body"]) for r in picks.groupBy("tree").applyInPandas(grow, "tree int, body string").orderBy("tree").collect()]
    if contamination is None:
        forest.offset = AUTO_OFFSET
        return forest
    # The scores are written once: their quantile is found in several passes.
    edge = quantile_row(checkpoint(forest.score(train).select("raw")), {"raw": F.col("raw")}, [contamination], "").first()
    forest.offset = float(edge["raw"][0]) if edge["raw"] else None
    return forest


def isolation_forest(train: DataFrame, rows: DataFrame, columns: list[str], trees: int = 300, sample: int = 256, contamination: float | None = None) -> DataFrame:
    """``rows`` with raw and anomaly_flagged by a forest of the training rows."""
    return fit_isolation_forest(train, columns, trees, sample, contamination).score(rows)


def _flat(tree: list) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(levels, column, cut, child, depth) of a tree's nodes; node i goes on at child[2 * i] if its value is not below the cut,
    else at child[2 * i + 1]. A leaf goes on at itself."""
    column, cut, child, depth, levels = [], [], [], [], 0

    def add(node: list, level: int) -> int:
        nonlocal levels
        at, levels = len(column), max(levels, level)
        leaf = len(node) == 1
        column.append(0 if leaf else node[0])
        cut.append(0.0 if leaf else node[1])
        depth.append(node[0] if leaf else 0.0)
        child.extend((at, at))
        if not leaf:
            child[2 * at + 1] = add(node[2], level + 1)
            child[2 * at] = add(node[3], level + 1)
        return at

    add(tree, 0)
    return levels, np.array(column, np.intp), np.array(cut), np.array(child, np.intp), np.array(depth)


def _depths(x: np.ndarray, levels: int, column: np.ndarray, cut: np.ndarray, child: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The depth at which each row ends; all rows go down one level at a time."""
    at, first, flat = np.zeros(len(x), np.intp), np.arange(len(x)) * x.shape[1], np.ascontiguousarray(x).ravel()
    for _ in range(levels):
        at = child.take(2 * at + (flat.take(first + column.take(at)) < cut.take(at)))
    return depth.take(at)


def _mean_path(n: int) -> float:
    """Mean depth at which a search in a random tree of n keys ends."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
