"""Numbers: strict text forms, half-up rounding, four-place rates and tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wire forms of signed money, unsigned 4-place numbers and unsigned rates.
MONEY_PATTERN = r"-?[0-9]+\.[0-9]{2}"
DECIMAL4_PATTERN = r"[0-9]+\.[0-9]{4}"
RATE_PATTERN = r"[0-9]+\.[0-9]{2}"

# The default cent tolerance and the cap of a sum's tolerance.
CENT = "0.01"
SUM_CAP = "1.00"


def dec(value: str, precision: int | None = None, scale: int | None = None) -> Column:
    """A decimal literal of the text ``value``, as narrow as its digits.

    A wide literal would make Spark drop fraction digits of the other side of a comparison.
    """
    places = scale if scale is not None else len(value.partition(".")[2])
    digits = sum(character.isdigit() for character in value)
    return F.lit(value).cast(f"decimal({precision or digits},{places})")


def full_match(col: Column, pattern: str) -> Column:
    """True when the whole value matches; a final newline does not pass."""
    return col.rlike(rf"\A(?:{pattern})\z")


def parse_fixed(col: Column, scale: int, *, signed: bool, precision: int = 18) -> Column:
    """The decimal of a text with exactly ``scale`` fraction digits, else null."""
    sign = "-?" if signed else ""
    shape = full_match(col, rf"{sign}[0-9]+\.[0-9]{{{scale}}}")
    return F.when(shape, col.try_cast(f"decimal({precision},{scale})"))


def parse_decimal(col: Column) -> Column:
    """Any finite decimal text as ``DECIMAL(38,10)``; null for everything else."""
    return F.trim(col).try_cast("decimal(38,10)")


def parse_cost(col: Column) -> Column:
    """A finite, non-negative cost text; null when absent or unusable."""
    number = F.trim(col).try_cast("decimal(28,8)")
    return F.when(number >= 0, number)


def round_half_up(col: Column, places: int = 2) -> Column:
    """Half away from zero; a decimal has no negative zero."""
    return F.round(col, places)


def round4(col: Column) -> Column:
    """A non-negative double to four places, half up."""
    return F.floor(col * 10000.0 + 0.5) / F.lit(10000.0)


def rate4(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` at four places half up, in integers; null for zero."""
    num, den = numerator.cast("bigint"), denominator.cast("bigint")
    scaled = F.call_function("div", num * F.lit(20000) + den, den * F.lit(2))
    return F.when(den != 0, scaled / F.lit(10000.0))


def sum_tolerance(count: Column, tolerance: str = CENT, cap: str = SUM_CAP) -> Column:
    """``min(tolerance * max(1, count), cap)``."""
    scaled = F.greatest(count, F.lit(1)).cast("decimal(18,0)") * dec(tolerance, 9)
    return F.least(scaled, dec(cap, 9)).cast("decimal(18,2)")


def within(left: Column, right: Column, tolerance: Column | str = CENT) -> Column:
    """The inclusive comparison ``|left - right| <= tolerance``."""
    limit = dec(tolerance) if isinstance(tolerance, str) else tolerance
    return F.abs(left - right) <= limit


def significant_digits(number: Column) -> Column:
    """The digits of a number without point, sign, leading and trailing zeros."""
    digits = F.regexp_replace(number.cast("string"), r"[^0-9]", "")
    return F.regexp_replace(digits, r"^0+|0+$", "")


def wilson_bounds(correct: Column, cases: Column, invoices: Column) -> tuple[Column, Column]:
    """The 95 percent Wilson interval of ``correct / cases`` with ``invoices`` draws."""
    z = 1.959963984540054  # fixed value: the 97.5th percentile of the standard normal
    z2 = z * z
    p = correct.cast("double") / cases.cast("double")
    n = invoices.cast("double")
    d = F.lit(1.0) + F.lit(z2) / n
    centre = (p + F.lit(z2) / (F.lit(2.0) * n)) / d
    spread = p * (F.lit(1.0) - p) / n + F.lit(z2) / (F.lit(4.0) * n * n)
    half = F.lit(z) * F.sqrt(spread) / d
    usable = (cases > 0) & (invoices > 0)
    low = F.when(usable, round4(F.greatest(F.lit(0.0), centre - half)))
    high = F.when(usable, round4(F.least(F.lit(1.0), centre + half)))
    return low, high
