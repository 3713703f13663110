"""Names of helper columns that cannot clash with those of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with underscores behind it until ``df`` has no such column (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
