"""The data pack: CSV or Parquet tables of a folder, rule declarations, scenarios, and derived tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.operators.reconcile import pack_summary, require_columns

# The tables of a pack and their files; only the first has to be there.
TABLES = {"train": "loan_monthly_performance_train", "test": "loan_monthly_performance_test", "static": "loan_static_attributes", "servicer": "servicer_updates"}
DATES = {"reporting_month": "date", "origination_month": "date", "last_updated_at": "timestamp"}
LONGS = ["row_id", "month_index", "loan_age_months", "remaining_term_months", "original_term_months", "days_past_due", "vintage", "seq"]
INTS = ["modification_flag", "exception_required", "delinq_3", "delinq_6", "default_12", "prepay_12", "prepayment_flag", "default_flag"]
DOUBLES = ["current_balance", "original_balance", "interest_rate", "original_interest_rate"]
TYPES = dict.fromkeys(LONGS, "bigint") | dict.fromkeys(INTS, "int") | dict.fromkeys(DOUBLES, "double") | DATES


@dataclass
class Pack:
    """The tables of a pack; the optional ones are None where their file is missing."""

    train: DataFrame
    test: DataFrame | None = None
    static: DataFrame | None = None
    servicer: DataFrame | None = None
    missing: list[str] = field(default_factory=list)

    def tables(self) -> dict[str, DataFrame]:
        return {name: df for name in TABLES if (df := getattr(self, name)) is not None}

    def summary(self) -> DataFrame:
        return pack_summary(self.tables())


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def typed(df: DataFrame) -> DataFrame:
    """Known columns in their types; what cannot be read as such, dates above all, is null."""
    def cast(name: str, kind: str):
        if kind in ("date", "timestamp"):
            return F.expr(f"try_to_timestamp(CAST(`{name}` AS STRING))").cast(kind)
        return F.col(f"`{name}`").try_cast(kind)

    return df.select(*[cast(c, TYPES[c]).alias(c) if c in TYPES else F.col(f"`{c}`") for c in df.columns])


def load_pack(spark: SparkSession, folder: str, kind: str = "csv") -> Pack:
    """Reads the pack at ``folder`` lazily; a missing train table or required column raises.

    CSV has a header and is read as text, without a pass to infer types; columns beyond the known ones stay text.
    """
    folder, found, missing = folder.rstrip("/"), {}, []
    for name, file in TABLES.items():
        path = f"{folder}/{file}.{kind}"
        if exists(spark, path):
            read = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.format(kind).load(path)
            found[name] = typed(read)
        elif name == "train":
            raise FileNotFoundError(path)
        else:
            missing.append(file)
    for name in ("train", "test"):
        if name in found:
            require_columns(found[name])
    return Pack(**found, missing=missing)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, description, severity, applies_to) of a JSON file with a list ``rules``; what is not given is null."""
    schema = "rules array<struct<rule_id: string, description: string, severity: string, applies_to: string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("rules").alias("r")).select("r.*").where("rule_id IS NOT NULL")


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, default_mult, delinq_mult, prepay_mult) of a CSV file of macro scenarios; a multiplier not given is 1."""
    rows = spark.read.option("header", True).csv(path)
    names = {"default_mult": "default_multiplier", "delinq_mult": "delinquency_multiplier", "prepay_mult": "prepayment_multiplier"}
    return rows.select(F.col("scenario_name").alias("scenario"), *[F.coalesce(F.col(c).try_cast("double"), F.lit(1.0)).alias(n) for n, c in names.items()])


def write_derived(df: DataFrame, path: str, columns: list[str] | None = None, kind: str = "parquet", by: list[str] = ()) -> None:
    """Writes key columns and results, replacing what is there; ``by`` are columns to partition the folder by.

    Rows are dealt by ``by`` first, with a salt, so a folder gets some files and not one of every task.
    """
    out = df.select(*columns) if columns else df
    if by:
        out = out.repartition(*by, F.pmod(F.xxhash64(*out.columns), F.lit(8)))
    writer = out.write.mode("overwrite").partitionBy(*by) if by else out.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
