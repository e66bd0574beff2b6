"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to equal numbers of bits, rows are sorted by their index
on the Hilbert curve through the grid, and the order is cut into runs of equal row counts. A shard
then covers a compact region of the grid, so minimum and maximum statistics of its files prune
filters on any of the dimensions.

Defined cases: a null dimension value is its own level, first in order; a null text has no bytes;
equal index, checksum and id leave rows that are interchangeable; repeated rows take one slot
each; an empty table gives an empty result. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import prefix_sums, ranked, table

BITS = 6
SHARDS = 16


def hilbert_index(levels: Sequence[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a grid cell; each level is an int in [0, 2**bits).

    Works from the highest bit down: each step undoes the reflection or the exchange of axes that
    the curve applies inside the current half, then the Gray code of the axes gives the digits.
    """
    n = len(levels)
    steps = F.array(
        *[
            F.struct(F.lit(1 << bit).alias("q"), F.lit(axis).alias("axis"))
            for bit in range(bits - 1, 0, -1)
            for axis in range(n)
        ]
    )

    def unfold(cell: Column, step: Column) -> Column:
        low, axis = step["q"] - 1, step["axis"]
        upper = F.get(cell, axis).bitwiseAND(step["q"]) != 0
        swapped = F.get(cell, F.lit(0)).bitwiseXOR(F.get(cell, axis)).bitwiseAND(low)
        reflect = lambda v, at: F.when(at == 0, v.bitwiseXOR(low)).otherwise(v)
        exchange = lambda v, at: F.when(
            (at == 0) | (at == axis), v.bitwiseXOR(swapped)
        ).otherwise(v)
        return F.transform(
            cell, lambda v, at: F.when(upper, reflect(v, at)).otherwise(exchange(v, at))
        )

    def digits(cell: Column) -> Column:
        gray = [F.get(cell, F.lit(0))]
        for axis in range(1, n):
            gray.append(gray[-1].bitwiseXOR(F.get(cell, F.lit(axis))))
        turn = F.lit(0)
        for bit in range(bits - 1, 0, -1):
            set_ = gray[-1].bitwiseAND(F.lit(1 << bit)) != 0
            turn = turn.bitwiseXOR(F.when(set_, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
        index = F.lit(0).cast("long")
        for bit in range(bits - 1, -1, -1):
            for axis in range(n):
                digit = F.shiftright(gray[axis].bitwiseXOR(turn), bit).bitwiseAND(F.lit(1))
                index = index * 2 + digit
        return index

    start = F.array(*[c.cast("int") for c in levels])
    unfolded = F.aggregate(steps, start, unfold) if n * (bits - 1) else start
    return F.get(F.transform(F.array(unfolded), digits), F.lit(0))


def value_levels(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Distinct values of ``column`` with an order-preserving level of about equal depth each."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    placed = prefix_sums(counts, [column], {"__before": "__n"})
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    middle = (F.col("__before") * 2 + F.col("__n")) * (1 << (bits - 1))
    level = F.least(F.floor(middle / F.col("__all")), F.lit((1 << bits) - 1)).cast("int")
    return placed.crossJoin(F.broadcast(total)).select(column, level.alias(f"{column}_level"))


def size_level(size: Column, bits: int) -> Column:
    """Half-octave of a positive size."""
    octave = F.length(F.bin(size))
    shift = F.greatest(octave - 2, F.lit(0))
    half = F.call_function("shiftright", size, shift).bitwiseAND(F.lit(1))
    return F.least(octave * 2 + half.cast("int"), F.lit((1 << bits) - 1)).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per document: its curve index, shard and gapless slot (counts differ by at most one).

    ``docs`` has doc_id, text, lang and source. Only narrow columns are sorted and kept.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    for column in ("lang", "source"):
        levels = value_levels(docs.select(column), column, bits).withColumnRenamed(column, "__v")
        narrow = narrow.join(levels, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")
    cell = [F.col("lang_level"), F.col("source_level"), size_level(F.col("size"), bits)]
    indexed = narrow.withColumn("curve", hilbert_index(cell, bits))
    indexed = indexed.select("doc_id", "lang", "source", "size", "text_crc32", "curve")
    placed = ranked(indexed, ["curve", "text_crc32", "doc_id"], "rank")
    total = placed.agg(F.count(F.lit(1)).alias("__all"))
    first = F.expr(f"(shard * __all + {shards - 1}) div {shards}")
    return (
        placed.crossJoin(F.broadcast(total))
        .withColumn("shard", F.expr(f"cast(rank * {shards} div __all as int)"))
        .withColumn("slot", F.col("rank") - first)
        .drop("rank", "__all")
    )


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``rows``."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the shard manifest of its input."""
    return shard_documents(docs).withColumn("law", F.lit("rows"))
