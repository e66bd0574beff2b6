"""Shared helpers: tables, cutting lineage, and global positions in an order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenota.session import checkpointed, shared_folder

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct column ``__row``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def unboxed(df: DataFrame) -> DataFrame:
    """The columns that ``boxed`` put away."""
    return df.select("__row.*")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, columns
    are compressed and later reads take only what they need."""
    folder = f"{shared_folder(df.sparkSession)}/{label}-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts in UTF-8 (null: empty) in turns of about ``most`` bytes, with the row at which
    each turn begins; memory follows one turn, or one text where that is longer."""
    first, turn, size = 0, [], 0
    for value in texts.cast(pa.large_binary()):
        text = value.as_py() or b""
        turn.append(text)
        size += len(text)
        if size >= most:
            yield first, turn
            first, turn, size = first + len(turn), [], 0
    if turn:
        yield first, turn


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range-sorted rows with ``__chunk`` (their range) and ``__at`` (a global order), kept in the
    shared folder so that every later use sees the same ranges."""
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at)
    return checkpointed(rows.withColumn("__chunk", F.shiftright("__at", 33)))


def ranked(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` plus its zero-based rank over all rows in the order of ``keys`` (nulls first).

    Rows are dealt by range; only one count per range meets in one task and is broadcast, and the
    number of ranges is the session's number of shuffle partitions.
    """
    placed = _placed(df, keys)
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select("__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = F.col("__at") - F.shiftleft("__chunk", 33)
    joined = placed.join(F.broadcast(offsets), "__chunk")
    return joined.withColumn(name, F.col("__o") + inside).drop("__o", "__at", "__chunk")


def prefix_sums(df: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` plus exclusive running sums over all rows in the order of ``keys`` (nulls first).

    ``sums`` maps an output name to a numeric column without nulls. As in ``ranked``, a task holds
    one range and the totals of the ranges meet in one small table.
    """
    placed = _placed(df, keys)
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__chunk").orderBy("__at").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = placed.groupBy("__chunk").agg(
        *[F.sum(source).alias(f"__t_{name}") for name, source in sums.items()]
    )
    offsets = totals.select(
        "__chunk",
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums],
    )
    local = placed.withColumns(
        {f"__l_{n}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for n, s in sums.items()}
    )
    joined = local.join(F.broadcast(offsets), "__chunk")
    joined = joined.withColumns({n: F.col(f"__t_{n}") + F.col(f"__l_{n}") for n in sums})
    return joined.drop("__at", "__chunk", *[f"__t_{n}" for n in sums], *[f"__l_{n}" for n in sums])
