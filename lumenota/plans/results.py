"""The ``events`` table read as answered attempts: statuses, usage, cost, cache and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.plans.bindings import table


def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``c`` (value in cents) and ``k`` (the number in its properties)."""
    return table(spark, sf_dir, "events").withColumns(
        {
            "c": F.round(F.col("value") * 100).cast("bigint"),
            "k": F.get_json_object("props", "$.k").cast("bigint"),
        }
    )


def answered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event as a finished case: error events failed, signup events never answered."""
    kind, c, k = F.col("event_type"), F.col("c"), F.col("k")
    status = (
        F.when(kind == "error", "infrastructure_failure")
        .when(kind == "signup", "harness_error")
        .otherwise("success")
    )
    answered = F.col("status") == "success"
    cost = (c.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,8)")
    hit = answered & (c < 500)
    return (
        event_numbers(spark, sf_dir)
        .withColumn("status", status)
        .withColumns(
            {
                "input_tokens": F.when(answered, k * 100),
                "output_tokens": F.when(answered, k * 10),
                "cache_read_tokens": F.when(answered, k),
                "cache_write_5m_tokens": F.when(answered, F.lit(0).cast("bigint")),
                "cache_write_1h_tokens": F.when(
                    answered, F.call_function("div", k, F.lit(2))
                ),
                "cost_usd": F.when(answered, cost),
                "incurred_cost_usd": F.when(
                    answered, F.when(hit, F.lit(0).cast("decimal(18,8)")).otherwise(cost)
                ),
                "answered_attempts": F.when(answered, 1).otherwise(0),
                "cache_hits": F.when(hit, 1).otherwise(0),
            }
        )
    )
