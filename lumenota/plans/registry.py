"""The registered queries: a name, a DataFrame builder and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

#: The JVM interprets methods of more bytes than this for ever. Spark's own limit is eight times that;
#: a longer whole-stage method is given up for its steps, whose expressions are split into short ones.
LONGEST_METHOD = "8000"


def compiled(spark: SparkSession) -> None:
    """Have wide projections run as compiled code; rows do not depend on it."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", LONGEST_METHOD)


def portable(df: DataFrame) -> DataFrame:
    """Result columns in types every engine shares: bigint, double, boolean and string."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType | T.FloatType):
            column = column.cast("double")
        elif isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, T.IntegerType | T.ShortType | T.ByteType):
            column = column.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name`` with its oracle SQL, if any."""

    def register(builder: Builder) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            compiled(spark)
            return portable(builder(spark, sf_dir))

        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return builder

    return register
