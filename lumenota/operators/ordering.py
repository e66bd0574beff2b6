"""Positions and running totals inside groups of any size.

A group is scanned in two levels: chunk summaries first (a small window per group), then the rows
of one chunk. No task ever holds more than one chunk of a group or the group's chunk summaries, so
a group with a third of all rows is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _chunk_offsets(df: DataFrame, group: Sequence[str], chunk: str) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, chunk).agg(F.count(F.lit(1)).alias("__n"))
    offset = F.coalesce(F.sum("__n").over(before), F.lit(0))
    return counts.select(*group, chunk, offset.alias("__offset"))


def row_index(
    df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[str | Column], name: str
) -> DataFrame:
    """``df`` plus a zero-based position in ``group`` ordered by ``chunk`` then ``order``.

    ``chunk`` must be the leading order column, or a monotone function of it; neither it nor the
    group columns may be null.
    """
    inside = Window.partitionBy(*group, chunk).orderBy(*order)
    keys = [*group, chunk]
    ranked = df.withColumn("__in", F.row_number().over(inside))
    joined = ranked.join(_chunk_offsets(df, group, chunk), keys, "inner")
    position = (F.col("__offset") + F.col("__in") - 1).cast("int")
    return joined.withColumn(name, position).drop("__in", "__offset")


def running_before(
    df: DataFrame,
    group: Sequence[str],
    chunk: str,
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
) -> DataFrame:
    """Exclusive running sums and maxima in ``group`` ordered by ``chunk`` then ``order``.

    ``sums`` and ``maxima`` map an output name to an input column; a first row gets null.
    """
    sums, maxima = sums or {}, maxima or {}
    inside = (
        Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, chunk).agg(
        *[F.sum(source).alias(f"__s_{name}") for name, source in sums.items()],
        *[F.max(source).alias(f"__m_{name}") for name, source in maxima.items()],
    )
    offsets = totals.select(
        *group,
        chunk,
        *[F.sum(f"__s_{name}").over(before).alias(f"__s_{name}") for name in sums],
        *[F.max(f"__m_{name}").over(before).alias(f"__m_{name}") for name in maxima],
    )
    local = df.withColumns(
        {f"__ls_{name}": F.sum(source).over(inside) for name, source in sums.items()}
        | {f"__lm_{name}": F.max(source).over(inside) for name, source in maxima.items()}
    )
    joined = local.join(offsets, [*group, chunk], "inner")
    zero = F.lit(0)
    result = joined.withColumns(
        {
            name: F.when(
                F.col(f"__s_{name}").isNotNull() | F.col(f"__ls_{name}").isNotNull(),
                F.coalesce(F.col(f"__s_{name}"), zero) + F.coalesce(F.col(f"__ls_{name}"), zero),
            )
            for name in sums
        }
        | {
            name: F.greatest(F.col(f"__m_{name}"), F.col(f"__lm_{name}")) for name in maxima
        }
    )
    return result.drop(
        *[f"__s_{n}" for n in sums], *[f"__ls_{n}" for n in sums],
        *[f"__m_{n}" for n in maxima], *[f"__lm_{n}" for n in maxima],
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return isinstance(kind, T.AtomicType | T.NullType) and not isinstance(kind, T.VariantType)


def _extreme_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool
) -> DataFrame:
    kinds = {field.name: field.dataType for field in df.schema.fields}
    others = [name for name in df.columns if name not in keys and name not in order]
    ties = [name for name in others if _orderable(kinds[name])]
    place = F.struct(*order, *ties)
    if len(ties) == len(others):
        best = F.max(place) if last else F.min(place)
    else:
        pick = F.max_by if last else F.min_by
        best = pick(F.struct(*[name for name in df.columns if name not in keys]), place)
    wanted = [name if name in keys else f"__row.{name}" for name in df.columns]
    return df.groupBy(*keys).agg(best.alias("__row")).select(*wanted)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the greatest ``order`` per key, as a partial aggregate (no per-key sort).

    Rows of equal order are told apart by their other columns, so every run keeps the same one;
    columns without an order (maps) cannot decide.
    """
    return _extreme_per_key(df, keys, order, last=True)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the smallest ``order`` per key; ties as in ``latest_per_key``."""
    return _extreme_per_key(df, keys, order, last=False)


def one_per_key(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` as the side of a join that must not multiply rows: one row per key.

    Equal rows are kept once. Two different rows of one key are refused, with the key, when the
    result is read.
    """
    rest = [name for name in df.columns if name not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    held = df.groupBy(*keys).agg(F.min(row).alias("__row"), F.max(row).alias("__other"))
    shown = F.concat_ws(", ", *[F.col(key).cast("string") for key in keys])
    refused = F.raise_error(F.concat(F.lit(f"{what}: different rows for "), shown))
    kept = F.when(~F.col("__row").eqNullSafe(F.col("__other")), refused).otherwise(F.col("__row"))
    return held.select(*keys, kept.alias("__row")).select(*keys, "__row.*").select(*df.columns)
