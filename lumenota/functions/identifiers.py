"""Tax identifiers, access keys, state codes and record ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenota.functions.numbers import full_match

# Whole-value patterns of the document's identifiers and codes.
ACCESS_KEY_PATTERN = "[0-9]{6}[A-Z0-9]{12}[0-9]{26}"
CNPJ_PATTERN = "[A-Z0-9]{12}[0-9]{2}"
CPF_PATTERN = "[0-9]{11}"
TAX_ID_PATTERN = "[0-9]{11}|[A-Z0-9]{12}[0-9]{2}"
UF_PATTERN = "[A-Z]{2}"
NCM_PATTERN = "[0-9]{8}"
CFOP_PATTERN = "[0-9]{4}"
TAX_CODE_PATTERN = "[0-9]{3,4}"

# Weights of the official check digits.
CNPJ_WEIGHTS_1 = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
CNPJ_WEIGHTS_2 = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
CPF_WEIGHTS_1 = (10, 9, 8, 7, 6, 5, 4, 3, 2)
CPF_WEIGHTS_2 = (11, 10, 9, 8, 7, 6, 5, 4, 3, 2)
# Weights 2 to 9 cycle from the right over the 43 body characters.
KEY_WEIGHTS = tuple(2 + (42 - position) % 8 for position in range(43))

# The 27 federative units and their IBGE codes.
UF_CODES = {
    "RO": "11", "AC": "12", "AM": "13", "RR": "14", "PA": "15", "AP": "16", "TO": "17",
    "MA": "21", "PI": "22", "CE": "23", "RN": "24", "PB": "25", "PE": "26", "AL": "27",
    "SE": "28", "BA": "29", "MG": "31", "ES": "32", "RJ": "33", "SP": "35", "PR": "41",
    "SC": "42", "RS": "43", "MS": "50", "MT": "51", "GO": "52", "DF": "53",
}

# Name, first position (from 1) and length of the access key segments.
KEY_SEGMENTS = (
    ("uf", 1, 2),
    ("year_month", 3, 4),
    ("cnpj", 7, 14),
    ("model", 21, 2),
    ("series", 23, 3),
    ("number", 26, 9),
    ("emission_type", 35, 1),
    ("numeric_code", 36, 8),
    ("check_digit", 44, 1),
)


def _weighted(col: Column, weights: tuple[int, ...]) -> Column:
    """The weighted sum of the first characters (value = ASCII - 48); null for a shorter text.

    Digits are read one by one in plain terms, which Spark compiles; a text with another character
    makes that sum null and takes the general form.
    """
    plain = F.lit(0)
    for position, weight in enumerate(weights, start=1):
        plain = plain + F.substring(col, position, 1).try_cast("int") * weight
    terms = F.zip_with(
        F.split(F.substring(col, 1, len(weights)), ""),
        F.array(*[F.lit(weight) for weight in weights]),
        lambda character, weight: (F.ascii(character) - 48) * weight,
    )
    return F.coalesce(plain, F.aggregate(terms, F.lit(0), lambda total, term: total + term))


# Digits by remainder from -10: 11 less the remainder, 0 for remainders below 2.
_DIGITS = "0" * 12 + "987654321"


def _mod11_digit(total: Column) -> Column:
    """The digit of a weighted sum, looked up so that the sum is written once."""
    return F.substring(F.lit(_DIGITS), total % 11 + 11, F.lit(1)).cast("int")


def mod11_check(col: Column, weights: tuple[int, ...]) -> Column:
    """The mod-11 digit of the first ``len(weights)`` characters (value = ASCII - 48)."""
    return _mod11_digit(_weighted(col, weights))


def _two_digits(base: Column, first: tuple[int, ...], second: tuple[int, ...]) -> Column:
    """Two check digits of a base as long as ``first``; the second also weighs the first digit."""
    digit = mod11_check(base, first)
    after = _mod11_digit(_weighted(base, second[:-1]) + digit * second[-1])
    return F.concat(digit.cast("string"), after.cast("string"))


def cnpj_digits(base: Column) -> Column:
    """The two check digits of a 12-character CNPJ base; null for another shape."""
    return F.when(
        full_match(base, "[A-Z0-9]{12}"), _two_digits(base, CNPJ_WEIGHTS_1, CNPJ_WEIGHTS_2)
    )


def cpf_digits(base: Column) -> Column:
    """The two check digits of a 9-digit CPF base; null for another shape."""
    return F.when(full_match(base, "[0-9]{9}"), _two_digits(base, CPF_WEIGHTS_1, CPF_WEIGHTS_2))


def is_repeated(col: Column) -> Column:
    """True when every character of the value is the same."""
    return (F.length(col) > 0) & (col == F.repeat(F.substring(col, 1, 1), F.length(col)))


def is_cnpj_shape(col: Column) -> Column:
    return full_match(col, CNPJ_PATTERN)


def is_cpf_shape(col: Column) -> Column:
    return full_match(col, CPF_PATTERN)


def is_key_shape(col: Column) -> Column:
    return full_match(col, ACCESS_KEY_PATTERN)


def is_valid_cnpj(col: Column) -> Column:
    """Shape, matching digits and not one repeated character; false for null."""
    right = cnpj_digits(F.substring(col, 1, 12)) == F.substring(col, 13, 2)
    return F.coalesce(is_cnpj_shape(col) & ~is_repeated(col) & right, F.lit(False))


def is_valid_cpf(col: Column) -> Column:
    """Shape, matching digits and not one repeated digit; false for null."""
    right = cpf_digits(F.substring(col, 1, 9)) == F.substring(col, 10, 2)
    return F.coalesce(is_cpf_shape(col) & ~is_repeated(col) & right, F.lit(False))


def access_key_digit(body: Column) -> Column:
    """The check digit of a 43-character access key body; null for another shape."""
    return F.when(
        full_match(body, "[0-9]{6}[A-Z0-9]{12}[0-9]{25}"), mod11_check(body, KEY_WEIGHTS)
    )


def is_valid_access_key(col: Column) -> Column:
    """Shape and matching check digit; false for null."""
    digit = access_key_digit(F.substring(col, 1, 43)).cast("string")
    return F.coalesce(is_key_shape(col) & (digit == F.substring(col, 44, 1)), F.lit(False))


def split_access_key(col: Column) -> Column:
    """The nine segments of a well-formed key as a struct, else null."""
    parts = [F.substring(col, start, size).alias(name) for name, start, size in KEY_SEGMENTS]
    return F.when(is_key_shape(col), F.struct(*parts))


def access_key_body(
    uf: Column,
    year_month: Column,
    cnpj: Column,
    model: Column,
    series: Column,
    number: Column,
    emission_type: Column,
    numeric_code: Column,
) -> Column:
    """The 43 characters of a key before its check digit."""
    return F.concat(
        F.lpad(uf, 2, "0"),
        year_month,
        cnpj,
        F.lpad(model, 2, "0"),
        F.lpad(series.cast("string"), 3, "0"),
        F.lpad(number.cast("string"), 9, "0"),
        emission_type.cast("string"),
        F.lpad(numeric_code.cast("string"), 8, "0"),
    )


def make_access_key(*parts: Column) -> Column:
    """The 44-character key of the parts of ``access_key_body``, check digit included; null if a part
    overflows. Over very many rows the body should be a column of its own."""
    return complete_access_key(access_key_body(*parts))


def complete_access_key(body: Column) -> Column:
    """A body and its check digit; null for another shape."""
    return F.concat(body, access_key_digit(body).cast("string"))


def uf_code(col: Column) -> Column:
    """The IBGE code of a state, null for an unknown one (a 27-entry literal map)."""
    entries = [F.lit(part) for pair in UF_CODES.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), col)


def year_month(date: Column) -> Column:
    """Two-digit year and month of a local date."""
    return F.date_format(date, "yyMM")


def valid_case_id(col: Column) -> Column:
    """A decision case id: lowercase letters, digits and inner hyphens, 1 to 64 characters."""
    return F.coalesce(full_match(col, "[a-z0-9][a-z0-9-]{0,63}"), F.lit(False))


def valid_record_id(col: Column) -> Column:
    """A case id of the run files: letters, digits, dot, underscore and hyphen."""
    return F.coalesce(full_match(col, "[A-Za-z0-9._-]+"), F.lit(False))


def valid_salt(col: Column) -> Column:
    """A replicate salt: the case id alphabet, at most 64 characters."""
    return F.coalesce(full_match(col, "[A-Za-z0-9._-]{1,64}"), F.lit(False))
