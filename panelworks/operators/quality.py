"""Profiles, record quality and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelworks.functions.columns import clip
from panelworks.operators.metrics import quantile_row, quantiles
from panelworks.schema import ALIASES
from panelworks.session import checkpoint

KEY_COLUMNS = ["current_balance", "current_status", "days_past_due", "interest_rate", "credit_score_band", "document_status"]
#: Numeric columns whose robust deviation counts; time-like columns and identifiers stay out.
OUTLIER_COLUMNS = ["original_balance", "current_balance", "interest_rate", "days_past_due", "modification_flag"]

MANY_LEVELS = 50


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: type, missing, distinct, and for numbers min, median, max and 3-IQR outliers.

    Pass one is one wide aggregate and the quartiles; pass two counts outliers beyond the fences found by it.
    A text column of more than MANY_LEVELS values has high cardinality.
    """
    df = checkpoint(df.select(*(columns or df.columns)))
    columns = columns or df.columns
    numbers = [c for c in numeric_columns(df) if c in columns]
    cells = [F.count("*").alias("n")]
    for c in columns:
        cells += [F.count(c).alias(f"n_{c}"), F.countDistinct(c).alias(f"d_{c}")]
    first = df.agg(*cells)
    if numbers:
        first = first.crossJoin(F.broadcast(quantile_row(df, {c: F.col(c) for c in numbers}, [0.0, 0.25, 0.5, 0.75, 1.0], "q_")))
    first = checkpoint(first)
    kinds = dict(df.dtypes)
    wide = df.select(*[F.col(c).cast("double").alias(f"x_{c}") for c in numbers]).crossJoin(F.broadcast(first))
    iqr = lambda c: F.col(f"q_{c}")[3] - F.col(f"q_{c}")[1]
    out = lambda c: (F.col(f"x_{c}") < F.col(f"q_{c}")[1] - 3 * iqr(c)) | (F.col(f"x_{c}") > F.col(f"q_{c}")[3] + 3 * iqr(c))
    beyond = wide.agg(*[F.coalesce(F.sum(F.when((iqr(c) != 0) & (F.col(f"n_{c}") >= 10), out(c).cast("long"))), F.lit(0)).alias(f"o_{c}") for c in numbers])
    both = first.crossJoin(beyond) if numbers else first
    null = "CAST(NULL AS DOUBLE)"
    rows = ", ".join(
        f"'{c}', '{kinds[c]}', n - n_{c}, d_{c}, {f'd_{c} > {MANY_LEVELS}' if kinds[c] == 'string' else 'false'}, " + (f"q_{c}[0], q_{c}[2], q_{c}[4], o_{c}" if c in numbers else f"{null}, {null}, {null}, CAST(NULL AS BIGINT)")
        for c in columns
    )
    return both.selectExpr("n", f"stack({len(columns)}, {rows}) AS (column, dtype, n_missing, n_distinct, high_cardinality, min, median, max, n_outliers)").select(
        "column", "dtype", "high_cardinality", "n_missing", (100.0 * F.col("n_missing") / F.col("n")).alias("missing_pct"), "n_distinct", "min", "median", "max", "n_outliers"
    )


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, top_value, top_pct): the most frequent value, ties to the smallest."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*").where("value IS NOT NULL")
    counts = pairs.groupBy("column", "value").count()
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("b"))
    total = df.agg(F.count("*").alias("total"))
    return best.crossJoin(F.broadcast(total)).select("column", F.col("b.value").alias("top_value"), (-100.0 * F.col("b.n") / F.col("total")).alias("top_pct"))


def numeric_correlations(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """(a, b, pearson) of pairs with an absolute correlation of ``least`` or more, pairwise complete."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = None
    for lo in range(0, len(pairs), 100):
        part = pairs[lo : lo + 100]
        wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        rows = wide.selectExpr(f"stack({len(part)}, {', '.join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(part))}) AS (a, b, pearson)")
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.abs("pearson") >= least)


def categorical_associations(df: DataFrame, columns: list[str], least: float = 0.0, most_levels: int = 40) -> DataFrame:
    """(a, b, cramers_v): bias-corrected association of all pairs of columns, in one pass.

    Columns of more than ``most_levels`` values are dropped before any pair is counted, so a pair has a bounded number of cells.
    """
    columns = narrow(df, columns, most_levels)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])).alias("p")).select("p.*")
    cells = rows.where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x", "y").agg(F.count("*").cast("double").alias("o"))
    cells = cells.withColumns({"rx": F.sum("o").over(_w("a", "b", "x")), "cy": F.sum("o").over(_w("a", "b", "y")), "n": F.sum("o").over(_w("a", "b"))})
    # chi2 = n * (sum of o^2 / (rx * cy) - 1); empty cells add nothing.
    stat = cells.groupBy("a", "b").agg(
        (F.first("n") * (F.sum(F.col("o") * F.col("o") / (F.col("rx") * F.col("cy"))) - 1)).alias("chi2"), F.first("n").alias("n"),
        F.countDistinct("x").alias("r"), F.countDistinct("y").alias("k"),
    ).where((F.col("r") <= most_levels) & (F.col("k") <= most_levels))
    r, k, n = F.col("r"), F.col("k"), F.col("n")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (r - 1) * (k - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    low = F.least(rc, kc) - 1
    v = F.when((r < 2) | (k < 2) | (low <= 0), 0.0).otherwise(F.sqrt(phi / low))
    return stat.select("a", "b", v.alias("cramers_v")).where(F.col("cramers_v") >= least)


def narrow(df: DataFrame, columns: list[str], most_levels: int) -> list[str]:
    """The columns of no more than ``most_levels`` values, null aside: one count of levels for all, no value comes to the driver."""
    if not columns:
        return []
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    levels = df.select(F.explode(cells).alias("x")).where("x.v IS NOT NULL").groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
    wide = {r["c"] for r in levels.groupBy("c").agg(F.count("*").alias("levels")).where(F.col("levels") > most_levels).collect()}  # names of columns
    return [c for c in columns if c not in wide]


def _w(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def folded(value: Column) -> Column:
    """Trimmed, lower-cased, and by the table of aliases."""
    from panelworks.functions.columns import lookup

    key = F.lower(F.trim(value))
    return F.coalesce(lookup(ALIASES, key), key)


def inconsistent_categories(df: DataFrame, columns: list[str], most_levels: int = 200) -> DataFrame:
    """(column, key, n_variants, n_rows): spellings that fold to one key; columns of more than ``most_levels`` values are left out."""
    columns = narrow(df, columns, most_levels)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, key string, n_variants long, n_rows long")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("p")).select("p.*").where("value IS NOT NULL")
    counts = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column", folded(F.col("value")).alias("key")).agg(F.count("*").alias("n_variants"), F.sum("n").alias("n_rows")).where("n_variants > 1")


def relationship_breaks(df: DataFrame) -> DataFrame:
    """(invariant, n_breaks, pct) of what should hold between columns; those whose columns are missing are left out."""
    months = (F.year("reporting_month") - F.year("origination_month")) * 12 + F.month("reporting_month") - F.month("origination_month")
    breaks = {
        "balance <= original": (["current_balance", "original_balance"], F.col("current_balance") > F.col("original_balance") * 1.0001),
        "age + remaining = term": (["loan_age_months", "remaining_term_months", "original_term_months"], F.abs(F.col("loan_age_months") + F.col("remaining_term_months") - F.col("original_term_months")) > 1),
        "age = months since origination": (["reporting_month", "origination_month", "loan_age_months"], F.abs(F.col("loan_age_months") - months) > 1),
        "current => dpd 0": (["current_status", "days_past_due"], (F.col("current_status") == "Current") & (F.col("days_past_due") > 0)),
        "prepayment flag => prepaid": (["prepayment_flag", "current_status"], (F.col("prepayment_flag") == 1) & (F.col("current_status") != "Prepaid")),
    }
    breaks = {name: test for name, (needs, test) in breaks.items() if set(needs) <= set(df.columns)}
    wide = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(b.cast("long")), F.lit(0)).alias(f"b{i}") for i, b in enumerate(breaks.values())])
    rows = ", ".join(f"'{name}', b{i}" for i, name in enumerate(breaks))
    return wide.selectExpr("n", f"stack({len(breaks)}, {rows}) AS (invariant, n_breaks)").select("invariant", "n_breaks", (100.0 * F.col("n_breaks") / F.col("n")).alias("pct"))


def robust_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: med_<c> and mad_<c> (median absolute deviation) of each column, each by one pass of prefix sums."""
    df = checkpoint(df.select(*columns))
    med = checkpoint(quantile_row(df, {c: F.col(c) for c in columns}, [0.5], "_m_").select(*[F.col(f"_m_{c}")[0].alias(f"med_{c}") for c in columns]))
    both = df.crossJoin(F.broadcast(med))
    mad = quantile_row(both, {c: F.abs(F.col(c) - F.col(f"med_{c}")) for c in columns}, [0.5], "_d_")
    return checkpoint(med.crossJoin(mad).select(*med.columns, *[F.col(f"_d_{c}")[0].alias(f"mad_{c}") for c in columns]))


def record_quality(df: DataFrame, columns: list[str] = OUTLIER_COLUMNS) -> DataFrame:
    """data_quality_score (0 to 100) of every row and what it is made of.

    Needs rule_severity_score, source_conflict and source_stale; missing ones cost nothing.
    """
    stats = robust_stats(df, columns)
    deviates = [F.coalesce(F.abs(F.col(c) - F.col(f"med_{c}")) / F.nullif(F.col(f"mad_{c}"), F.lit(0.0)) > 5, F.lit(False)).cast("int") for c in columns]
    there = sum(F.col(c).isNotNull().cast("int") for c in KEY_COLUMNS)
    cost = lambda c, by: (F.coalesce(F.col(c), F.lit(False)).cast("double") * by) if c in df.columns else F.lit(0.0)
    severity = F.coalesce(F.col("rule_severity_score"), F.lit(0.0)) if "rule_severity_score" in df.columns else F.lit(0.0)
    out = df.crossJoin(F.broadcast(stats)).withColumns(
        {
            "completeness": there / len(KEY_COLUMNS), "outlyingness": sum(deviates) / len(columns),
            "rule_penalty": clip(severity * 15.0, 0, 60), "conflict_penalty": cost("source_conflict", 10.0), "stale_penalty": cost("source_stale", 5.0),
        }
    )
    score = 100.0 - (1 - F.col("completeness")) * 25 - F.col("outlyingness") * 20 - F.col("rule_penalty") - F.col("conflict_penalty") - F.col("stale_penalty")
    return out.withColumn("data_quality_score", clip(score, 0, 100)).drop(*stats.columns)


def batch_quality(scored: DataFrame, by: tuple[str, ...] = ("reporting_month", "servicer_name", "source_system")) -> DataFrame:
    """(batch_type, batch, n_records, mean_score, pct_below_70), all groupings in one pass."""
    rows = scored.select("data_quality_score", F.explode(F.array(*[F.struct(F.lit(c).alias("batch_type"), F.col(c).cast("string").alias("batch")) for c in by])).alias("b"))
    return rows.where("b.batch IS NOT NULL").groupBy("b.batch_type", "b.batch").agg(
        F.count("*").alias("n_records"), F.avg("data_quality_score").alias("mean_score"),
        (100.0 * F.avg((F.col("data_quality_score") < 70).cast("double"))).alias("pct_below_70"),
    )


def quality_bands(scored: DataFrame) -> DataFrame:
    s = F.col("data_quality_score")
    band = F.when(s >= 90, "90-100").when(s >= 70, "70-90").when(s >= 50, "50-70").otherwise("0-50")
    return _shares(scored.groupBy(band.alias("band")).agg(F.count("*").alias("n")))


def _shares(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", 100.0 * F.col("n") / F.col("total")).drop("total")


def worst_records(scored: DataFrame, n: int = 25) -> DataFrame:
    return scored.where("any_violation").orderBy("data_quality_score", "row_id").limit(n)


def _long(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.lit(None).cast("string").alias("level")) for c in numbers]
    cells += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("x"), F.col(c).cast("string").alias("level")) for c in categories]
    return df.select(F.explode(F.array(*cells)).alias("p")).select("p.*")


def drift_report(expected: DataFrame, actual: DataFrame, numbers: list[str], categories: list[str], buckets: int = 10) -> DataFrame:
    """(column, psi, band, expected_missing_pct, actual_missing_pct): all columns in one job.

    Numbers with more than ``buckets`` values are binned at the expected sample's quantiles, with
    open ends and the last bin closed; others and categories compare shares of their values.
    """
    both = _long(expected, numbers, categories).withColumn("side", F.lit("e")).unionByName(_long(actual, numbers, categories).withColumn("side", F.lit("a")))
    both = checkpoint(both)
    there = both.where("side = 'e'").select(F.col("column").alias("g"), "x")
    edges = quantiles(there, [i / buckets for i in range(buckets + 1)]).select(F.col("g").alias("column"), F.array_distinct("q").alias("edges"))
    values = there.groupBy(F.col("g").alias("column")).agg(F.countDistinct("x").alias("n_values"))
    # One row for each column of the report.
    rows = both.join(F.broadcast(values.join(edges, "column", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))), "column")
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = (F.col("n_values") > buckets)
    value = F.when(binned & F.col("x").isNotNull(), F.size(F.filter(inner, lambda e: e <= F.col("x"))).cast("string")).when(F.col("x").isNotNull(), F.col("x").cast("string")).otherwise(F.col("level"))
    counts = rows.select("column", "side", value.alias("value"), (binned & (F.size("edges") < 3)).alias("flat")).groupBy("column", "value").agg(
        F.sum((F.col("side") == "e").cast("long")).alias("e"), F.sum((F.col("side") == "a").cast("long")).alias("a"), F.first("flat").alias("flat")
    )
    counts = checkpoint(counts)
    totals = counts.groupBy("column").agg(*[F.sum(F.when(F.col("value").isNotNull(), F.col(c))).alias(f"n{c}") for c in ("e", "a")])
    shares = counts.join(F.broadcast(totals), "column")  # one row for each column
    es, as_ = (F.greatest(F.col(c) / F.nullif(F.col(n), F.lit(0)), F.lit(1e-6)) for c, n in (("e", "ne"), ("a", "na")))
    term = F.when(F.col("value").isNotNull(), (as_ - es) * F.ln(as_ / es))
    missing = lambda c, n: 100.0 * F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col(c))), F.lit(0)) / F.sum(c)
    out = shares.groupBy("column").agg(
        F.when(F.max("ne").isNull() | F.max("na").isNull() | (F.max("ne") == 0) | (F.max("na") == 0), None).when(F.max("flat"), 0.0).otherwise(F.sum(term)).alias("psi"),
        missing("e", "ne").alias("expected_missing_pct"), missing("a", "na").alias("actual_missing_pct"),
    )
    band = F.when(F.col("psi").isNull(), "not comparable").when(F.col("psi") < 0.10, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("material")
    return out.withColumn("band", band)
