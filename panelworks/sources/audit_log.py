"""The audit log of generated notes: one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = (
    "timestamp string, task string, provider string, model string, attempt int, prompt string, prompt_sha256_16 string, context_sha256_16 string, output string, latency_ms double, "
    "accepted boolean, error string, validation struct<ok: boolean, checks: map<string, boolean>, failed_checks: array<string>, violations: array<string>, ungrounded_numbers: array<string>>"
)


def with_hashes(records: DataFrame) -> DataFrame:
    """prompt_sha256_16 and, where there is a context, context_sha256_16; null texts hash as empty."""
    short = lambda c: F.substring(F.sha2(F.coalesce(F.col(c), F.lit("")), 256), 1, 16)
    return records.withColumns({f"{c}_sha256_16": short(c) for c in ("prompt", "context") if c in records.columns})


def append_audit_log(records: DataFrame, path: str) -> None:
    with_hashes(records).drop("context").write.mode("append").json(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """All records; malformed lines are skipped, and a log that is not there is empty."""
    try:
        return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)
