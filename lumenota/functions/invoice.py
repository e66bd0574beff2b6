"""Small invoice-shaped column functions: paths, length classes, hazards and installments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenota.functions.numbers import dec
from lumenota.functions.text import normalize_name

HAZARD_NUMBER_MIN = "100000"  # fixed value


def field_path(list_name: str, index: Column, column: str | Column) -> Column:
    """``items[3].total`` from a list name, a zero-based index and a column name."""
    name = F.lit(column) if isinstance(column, str) else column
    return F.concat(F.lit(f"{list_name}["), index.cast("string"), F.lit("]."), name)


def length_class(item_count: Column) -> Column:
    """``short`` up to 8 items, ``medium`` up to 25, else ``many_items``."""
    return (
        F.when(item_count <= 8, "short").when(item_count <= 25, "medium").otherwise("many_items")
    )


def unit_wraps(unit: Column, *, unicode: bool = True) -> Column:
    return F.coalesce(normalize_name(unit, unicode=unicode) == "par", F.lit(False))


def number_wraps(unit_price: Column, total: Column) -> Column:
    limit = dec(HAZARD_NUMBER_MIN)
    return F.coalesce(unit_price >= limit, F.lit(False)) | F.coalesce(total >= limit, F.lit(False))


def hazard_names(unit_wrap: Column, number_wrap: Column) -> Column:
    """The sorted hazard set from the two case-level flags."""
    return F.array_compact(
        F.array(F.when(number_wrap, F.lit("number_wrap")), F.when(unit_wrap, F.lit("unit_wrap")))
    )


def render_hazards(items: Column) -> Column:
    """The sorted hazard set of a nested item array (Latin-1 units)."""
    unit = F.exists(items, lambda item: unit_wraps(item["unit"], unicode=False))
    number = F.exists(items, lambda item: number_wraps(item["unit_price"], item["total"]))
    return hazard_names(unit, number)


def installment_split(total: Column, count: Column, issue_date: Column) -> Column:
    """``count`` installments of ``total``: equal half-up shares, the last takes the remainder.

    Due dates follow the issue date every 30 days; amounts are ``DECIMAL(18,2)``.
    """
    cents = (total * dec("100", 9)).cast("bigint")
    share = F.call_function("div", cents * 2 + count, count * 2)
    rest = cents - share * (count - 1)

    def part(i: Column) -> Column:
        amount = F.when(i < count, share).otherwise(rest).cast("decimal(18,0)") * dec("0.01", 9)
        return F.struct(
            F.lpad(i.cast("string"), 3, "0").alias("number"),
            F.date_add(issue_date, (i * 30).cast("int")).alias("due_date"),
            amount.cast("decimal(18,2)").alias("amount"),
        )

    empty = F.transform(F.array().cast("array<int>"), part)
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count.cast("int")), part)).otherwise(
        empty
    )


def canonical_sha256(value: Column) -> Column:
    """SHA-256 of a struct's JSON in member order, null members kept."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)
