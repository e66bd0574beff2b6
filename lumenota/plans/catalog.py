"""All registered queries; importing the query modules fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenota.plans import (
    queries_files,  # noqa: F401
    queries_functions,  # noqa: F401
    queries_grading,  # noqa: F401
    queries_ledger,  # noqa: F401
    queries_measure,  # noqa: F401
    queries_rules,  # noqa: F401
    queries_sources,  # noqa: F401
)
from lumenota.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline correct rates of the graded run, per scope and layer."""
    return QUERIES["a17_headline"](spark, sf_dir)
