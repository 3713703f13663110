"""One fitted stage between the panel's columns and a model's feature vector."""

from __future__ import annotations

import json
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.operators.quality import numeric_columns
from panelworks.session import checkpoint

LEAST_LEVEL = 25
RARE = "(rare)"
#: A column with more levels than this, each of enough rows, is no category; fitting it raises.
MOST_LEVELS = 5000
#: Columns of so many levels at most get an expression for each place.
FEW_LEVELS = 64


class _Encoding(Params):
    numbers = Param(Params._dummy(), "numbers", "numeric columns", TypeConverters.toListString)
    names = Param(Params._dummy(), "names", "categorical columns", TypeConverters.toListString)
    least = Param(Params._dummy(), "least", "levels of fewer rows are pooled", TypeConverters.toInt)
    scale = Param(Params._dummy(), "scale", "whether numbers are standardised", TypeConverters.toBoolean)


class PanelEncoder(Estimator, _Encoding, DefaultParamsReadable, DefaultParamsWritable):
    """Learns medians, means, deviations, modes and frequent levels, of all columns together.

    A missing number (null or NaN) becomes the median, from a sketch exact to a part in ten thousand. A missing
    level becomes the mode, the first one of a tie; a level of fewer than ``least`` rows, those without a value counted
    for the mode, and any level that was not there is ``(rare)``. The number of jobs does not depend on the columns.
    """

    @keyword_only
    def __init__(self, *, numbers=(), names=(), least=LEAST_LEVEL, scale=True):
        super().__init__()
        self._set(numbers=list(numbers), names=list(names), least=least, scale=scale)

    def _fit(self, df: DataFrame) -> PanelEncoderModel:
        numbers, names, least = self.getOrDefault("numbers"), self.getOrDefault("names"), self.getOrDefault("least")
        state = {"numbers": {}, "levels": {}}
        if numbers:
            x = {c: _number(c) for c in numbers}
            parts = [F.struct(F.percentile_approx(v, 0.5, 10_000), F.avg(v), F.var_pop(v), F.count(v)).alias(f"c{i}") for i, v in enumerate(x.values())]
            row = df.agg(F.count("*").alias("n"), *parts).first()
            for i, c in enumerate(numbers):
                median, mean, var, n = row[f"c{i}"]
                if not n:
                    state["numbers"][c] = [0.0, 0.0, 1.0]
                    continue
                # Mean and deviation of the column once its gaps are filled.
                share = n / row["n"]
                filled = share * mean + (1 - share) * median
                var = share * (var + (mean - filled) ** 2) + (1 - share) * (median - filled) ** 2
                state["numbers"][c] = [median, filled, math.sqrt(var) or 1.0]
        if names:
            cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("level")) for c in names])
            counts = checkpoint(df.select(F.explode(cells).alias("x")).groupBy("x.c", "x.level").agg(F.count("*").alias("n")))
            some = F.col("level").isNotNull()
            first = F.min(F.when(some, F.struct((-F.col("n")).alias("n"), "level")))
            tops = counts.groupBy("c").agg(
                first.alias("top"), F.sum(F.when(~some, F.col("n")).otherwise(0)).alias("missing"), F.count_if(some & (F.col("n") >= least)).alias("kept")
            ).collect()  # one row for each column
            wide = [r["c"] for r in tops if r["kept"] > MOST_LEVELS]
            if wide:
                raise ValueError(f"too many levels: {sorted(wide)}")
            kept: dict[str, list[str]] = {c: [] for c in names}
            for r in counts.where(some & (F.col("n") >= least)).select("c", "level").collect():  # MOST_LEVELS for each column at most
                kept[r["c"]].append(r["level"])
            for r in tops:
                mode = r["top"]["level"] if r["top"] else None
                if mode is not None and mode not in kept[r["c"]] and r["missing"] - r["top"]["n"] >= least:
                    kept[r["c"]].append(mode)
                state["levels"][r["c"]] = [mode, sorted(kept[r["c"]])]
            for c in names:
                state["levels"].setdefault(c, [None, []])
        return self._copyValues(PanelEncoderModel(json.dumps(state)))


class PanelEncoderModel(Model, _Encoding, DefaultParamsReadable, DefaultParamsWritable):
    """Applies what was learnt; the same map when a model is fitted and when it scores."""

    state = Param(Params._dummy(), "state", "what was learnt, as JSON", TypeConverters.toString)

    def __init__(self, state: str = "{}"):
        super().__init__()
        self._set(state=state)

    @property
    def learnt(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    def level(self, name: str) -> Column:
        mode, kept = self.learnt["levels"][name]
        value = F.coalesce(F.col(name).cast("string"), F.lit(mode))
        return F.when(value.isin(kept), value).otherwise(RARE) if kept else F.lit(RARE)

    def places(self) -> list[tuple[str, str]]:
        """(name, source column) of each place of the feature vector."""
        numbers = [(c, c) for c in self.getOrDefault("numbers")]
        return numbers + [(f"{c}={v}", c) for c in self.getOrDefault("names") for v in (*self.learnt["levels"][c][1], RARE)]

    def _transform(self, df: DataFrame) -> DataFrame:
        learnt, scale, kept = self.learnt, self.getOrDefault("scale"), df.columns
        named = {c: f"_level_{i}" for i, c in enumerate(self.getOrDefault("names"))}
        df = df.withColumns({at: self.level(c) for c, at in named.items()})
        values = []
        for c in self.getOrDefault("numbers"):
            median, mean, dev = learnt["numbers"][c]
            x = F.coalesce(_number(c), F.lit(median))
            values.append((x - F.lit(mean)) / F.lit(dev) if scale else x)
        # Places of few levels are compared one by one in compiled code; a long list goes through an array function.
        runs = []
        for c, at in named.items():
            levels, own = (*learnt["levels"][c][1], RARE), F.col(at)
            if len(levels) <= FEW_LEVELS:
                values += [(own == v).cast("double") for v in levels]
            else:
                runs += [values, F.transform(F.array(*[F.lit(v) for v in levels]), _is(own))]
                values = []
        runs.append(values)
        parts = [F.array(*r).cast("array<double>") if isinstance(r, list) else r for r in runs]
        vector = F.concat(*parts) if len(parts) > 1 else parts[0]
        attrs = [{"idx": i, "name": name} for i, (name, _) in enumerate(self.places())]
        meta = {"ml_attr": {"attrs": {"numeric": attrs}, "num_attrs": len(attrs)}}
        return df.select(*[F.col(c) for c in kept if c != "features"], array_to_vector(vector).alias("features", metadata=meta))


def _is(own: Column):
    return lambda level: (level == own).cast("double")


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def encoder(df: DataFrame, columns: list[str], scale: bool = True, least: int = LEAST_LEVEL) -> PanelEncoder:
    numbers = [c for c in columns if c in numeric_columns(df)]
    return PanelEncoder(numbers=numbers, names=[c for c in columns if c not in numbers], scale=scale, least=least)


def pooled(df: DataFrame, columns: list[str], least: int = LEAST_LEVEL) -> DataFrame:
    """``df`` with rare levels of ``columns`` as ``(rare)`` and nulls as the most frequent level."""
    if not columns:
        return df
    fitted = PanelEncoder(names=columns, least=least).fit(df)
    return df.withColumns({c: fitted.level(c) for c in columns})
