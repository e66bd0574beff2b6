"""Result sinks: a published result is written once, a summary has sorted members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish_once(df: DataFrame, path: str) -> None:
    """Write a result; a path that holds one already is refused."""
    df.write.mode("errorifexists").parquet(path)


def summary_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with its members in name order, nulls kept."""
    names = sorted(df.columns)
    return df.select(
        F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")
    )


def write_summary(df: DataFrame, path: str) -> None:
    """The machine-readable summary and, beside it, the same rows as a table."""
    summary_json(df).write.mode("errorifexists").text(f"{path}/summary_json")
    df.write.mode("errorifexists").parquet(f"{path}/summary")
