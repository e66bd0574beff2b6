"""The deterministic validation rules, each problem one finding row.

A rule is a column function giving a finding struct or null. The same functions serve nested
invoices (``validate``: no shuffle at all) and flat header and item tables (``validate_flat``: one
pre-aggregated shuffle by case).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenota.functions import identifiers as ids
from lumenota.functions.invoice import field_path
from lumenota.functions.numbers import CENT, SUM_CAP, dec, full_match, sum_tolerance, within
from lumenota.session import stored

RULES_VERSION = "rules-1"
FINDING_TYPE = (
    "struct<field:string,rule_id:string,expected:string,actual:string,severity:string>"
)

# The texts a finding states as expected.
CNPJ_EXPECTED = "12 uppercase letters or digits followed by 2 digits"
CPF_EXPECTED = "11 digits"
KEY_EXPECTED = "44 characters: 6 digits, 12 uppercase letters or digits, 26 digits"
UF_EXPECTED = "one of the 27 UF codes"
NOT_REPEATED = "not a single repeated character"
REGIME_EXPECTED = (
    "cst_csosn codes of one length (3 digits for Regime Normal, 4 for Simples Nacional)"
)
TAX_CODE_EXPECTED = "a CST or CSOSN code with a tax rule"
EARLIEST_ISSUE_DATE = "2006-04-01"
FISCAL_MODEL = "55"

# Tax codes (origin digit cut) by treatment and length.
TAXED_CODES = ("00", "20", "90", "900")
NOT_TAXED_CODES = ("40", "41", "50", "60", "101", "102", "103", "300", "400", "500")

ITEM_TEXT = ("code", "description", "ncm", "cst_csosn", "cfop", "unit")
ITEM_NUMBERS = (
    "quantity", "unit_price", "total", "icms_base", "icms_rate", "icms_amount", "ipi_rate",
    "ipi_amount",
)
ITEM_FIELDS = ITEM_TEXT + ITEM_NUMBERS
TOTAL_FIELDS = (
    "icms_base", "icms_amount", "icms_st_base", "icms_st_amount", "products_total", "freight",
    "insurance", "discount", "other_expenses", "ipi_amount", "invoice_total",
)
INSTALLMENT_FIELDS = ("number", "due_date", "amount")
HEADER_REQUIRED = (
    "access_key", "number", "series", "issue_date", "operation_nature", "issuer.cnpj",
    "issuer.name", "issuer.uf", "recipient.tax_id", "recipient.tax_id_kind", "recipient.name",
    "recipient.uf", *(f"totals.{name}" for name in TOTAL_FIELDS),
)

# The item sums checked against a totals box: rule id, item column, totals column.
SUM_RULES = (
    ("TOTAL_SUM_PRODUCTS", "total", "products_total"),
    ("TOTAL_SUM_ICMS_BASE", "icms_base", "icms_base"),
    ("TOTAL_SUM_ICMS", "icms_amount", "icms_amount"),
    ("TOTAL_SUM_IPI", "ipi_amount", "ipi_amount"),
)

# The rules whose expected and actual may be shown, and the sentences of the others.
REVEALED_RULES = (
    "DATE_PLAUSIBLE", "DUE_DATE_ORDER", "ITEMS_EMPTY", "ITEM_ARITH", "TAX_ARITH_ICMS",
    "TAX_NOT_TAXED_AMOUNT", "TAX_ARITH_IPI", "TOTAL_SUM_PRODUCTS", "TOTAL_SUM_ICMS_BASE",
    "TOTAL_SUM_ICMS", "TOTAL_SUM_IPI", "TOTAL_VNF_FORMULA", "DUP_SUM",
)


def finding(
    field: Column | str, rule: str, expected: Column | str, actual: Column | str,
    severity: str = "error",
) -> Column:
    """One finding struct; plain strings are literals."""

    def text(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value.cast("string")

    return F.struct(
        text(field).alias("field"),
        F.lit(rule).alias("rule_id"),
        text(expected).alias("expected"),
        text(actual).alias("actual"),
        F.lit(severity).alias("severity"),
    )


def each_found(df: DataFrame, keep: Sequence[Column | str], cells: Sequence[Column]) -> DataFrame:
    """One row per struct in ``cells`` that is not null, its members beside the columns ``keep``.

    The array is a column of its own before its nulls are dropped: Spark compiles what makes it, and
    interprets everything written inside ``array_compact``.
    """
    made = df.select(*keep, F.array(*cells).alias("__cells"))
    return made.select(*made.columns[:-1], F.inline(F.array_compact("__cells")))


def overflow(field: Column | str) -> Column:
    return finding(field, "ARITH_OVERFLOW", "a representable amount", "")


def _compare(
    field: Column | str, rule: str, computed: Column, printed: Column, tolerance: Column | str
) -> Column:
    """Printed against computed; a computed null stands for an overflow."""
    shown = computed.cast("decimal(38,2)")
    return F.when(computed.isNull(), overflow(field)).when(
        ~within(computed, printed, tolerance), finding(field, rule, shown, printed)
    )


# --- header rules -----------------------------------------------------------------------------


def _cnpj(field: str, value: Column) -> Column:
    computed = ids.cnpj_digits(F.substring(value, 1, 12))
    printed = F.substring(value, 13, 2)
    return (
        F.when(~ids.is_cnpj_shape(value), finding(field, "CNPJ_FORMAT", CNPJ_EXPECTED, value))
        .when(ids.is_repeated(value), finding(field, "CNPJ_CHECK_DIGIT", NOT_REPEATED, value))
        .when(computed != printed, finding(field, "CNPJ_CHECK_DIGIT", computed, printed))
    )


def _cpf(field: str, value: Column) -> Column:
    computed = ids.cpf_digits(F.substring(value, 1, 9))
    printed = F.substring(value, 10, 2)
    return F.when(
        ids.is_repeated(value), finding(field, "CPF_CHECK_DIGIT", NOT_REPEATED, value)
    ).when(computed != printed, finding(field, "CPF_CHECK_DIGIT", computed, printed))


def issuer_rule() -> list[Column]:
    return [_cnpj("issuer.cnpj", F.col("issuer.cnpj"))]


def recipient_rule() -> list[Column]:
    field, value, kind = "recipient.tax_id", F.col("recipient.tax_id"), F.col("recipient.tax_id_kind")
    as_cnpj, as_cpf = ids.is_cnpj_shape(value), ids.is_cpf_shape(value)
    identifier = (
        F.when(as_cnpj, _cnpj(field, value))
        .when(as_cpf, _cpf(field, value))
        .when(kind == "cpf", finding(field, "CPF_FORMAT", CPF_EXPECTED, value))
        .otherwise(finding(field, "CNPJ_FORMAT", CNPJ_EXPECTED, value))
    )
    shape = F.when(as_cnpj, "cnpj").when(as_cpf, "cpf")
    mismatch = F.when(
        shape != kind, finding("recipient.tax_id_kind", "TAX_ID_KIND_MISMATCH", shape, kind)
    )
    return [identifier, mismatch]


def uf_rule() -> list[Column]:
    return [
        F.when(
            ids.uf_code(F.col(f"{party}.uf")).isNull(),
            finding(f"{party}.uf", "UF_UNKNOWN", UF_EXPECTED, F.col(f"{party}.uf")),
        )
        for party in ("issuer", "recipient")
    ]


def key_rule() -> list[Column]:
    key = F.col("access_key")
    computed = ids.access_key_digit(F.substring(key, 1, 43)).cast("string")
    printed = F.substring(key, 44, 1)
    return [
        F.when(
            ~ids.is_key_shape(key), finding("access_key", "KEY_FORMAT", KEY_EXPECTED, key)
        ).when(computed != printed, finding("access_key", "KEY_CHECK_DIGIT", computed, printed))
    ]


def key_cross_rule() -> list[Column]:
    """The key's segments against the extracted fields; only for a well-formed key."""
    key = F.col("access_key")
    part = {name: F.substring(key, start, size) for name, start, size in ids.KEY_SEGMENTS}
    number, series = F.col("number"), F.col("series")
    expected_uf, expected_month = ids.uf_code(F.col("issuer.uf")), ids.year_month(F.col("issue_date"))
    issuer = F.col("issuer.cnpj")
    checks = (
        ("KEY_UF_MISMATCH", part["uf"] != expected_uf, expected_uf, part["uf"]),
        ("KEY_ISSUER_CNPJ_MISMATCH", part["cnpj"] != issuer, issuer, part["cnpj"]),
        ("KEY_YEAR_MONTH_MISMATCH", part["year_month"] != expected_month, expected_month,
         part["year_month"]),
        ("KEY_MODEL_MISMATCH", part["model"] != FISCAL_MODEL, FISCAL_MODEL, part["model"]),
        ("KEY_SERIES_MISMATCH", part["series"].try_cast("int") != series, series, part["series"]),
        ("KEY_NUMBER_MISMATCH", part["number"].try_cast("int") != number, number, part["number"]),
    )
    shaped = ids.is_key_shape(key)
    return [
        F.when(shaped & wrong, finding("access_key", rule, expected, actual))
        for rule, wrong, expected, actual in checks
    ]


def date_rule(reference_date: str) -> list[Column]:
    issue = F.col("issue_date")
    earliest = F.lit(EARLIEST_ISSUE_DATE).cast("date")
    latest = F.date_add(F.lit(reference_date).cast("date"), 1)
    allowed = F.concat(earliest.cast("string"), F.lit(" to "), latest.cast("string"))
    late = (issue < earliest) | (issue > latest)
    return [F.when(late, finding("issue_date", "DATE_PLAUSIBLE", allowed, issue))]


def formula_rule(tolerance: str = CENT) -> list[Column]:
    """The invoice total from its boxes, left to right; any overflow is its own finding."""
    box = {name: F.col(f"totals.{name}") for name in TOTAL_FIELDS}
    total = F.try_subtract(box["products_total"], box["discount"])
    for name in ("icms_st_amount", "freight", "insurance", "other_expenses", "ipi_amount"):
        total = F.try_add(total, box[name])
    return [
        _compare(
            "totals.invoice_total", "TOTAL_VNF_FORMULA", F.round(total, 2), box["invoice_total"],
            tolerance,
        )
    ]


HEADER_RULES: tuple[tuple[str, Callable[[], list[Column]]], ...] = (
    ("issuer", issuer_rule),
    ("recipient", recipient_rule),
    ("uf", uf_rule),
    ("key", key_rule),
    ("key_cross", key_cross_rule),
)


# --- item rules -------------------------------------------------------------------------------


def tax_treatment(code: Column) -> Column:
    """``taxed``, ``not_taxed`` or ``unsupported`` from the code without its origin digit."""
    family = F.substring(code, 2, 3)
    shaped = full_match(code, ids.TAX_CODE_PATTERN)
    return (
        F.when(shaped & family.isin(*TAXED_CODES), "taxed")
        .when(shaped & family.isin(*NOT_TAXED_CODES), "not_taxed")
        .otherwise("unsupported")
    )


def item_arith(item: Column, path: Column, tolerance: str = CENT) -> Column:
    computed = F.round(F.try_multiply(item["quantity"], item["unit_price"]), 2)
    return _compare(F.concat(path, F.lit(".total")), "ITEM_ARITH", computed, item["total"], tolerance)


def _percentage(base: Column, rate: Column) -> Column:
    return F.round(F.try_multiply(F.try_multiply(base, rate), dec("0.01", 3)), 2)


def icms_rule(item: Column, path: Column, tolerance: str = CENT) -> Column:
    """The taxed arithmetic, the zero amount of untaxed codes, or the unsupported-code warning."""
    treatment = tax_treatment(item["cst_csosn"])
    amount_path = F.concat(path, F.lit(".icms_amount"))
    taxed = _compare(
        amount_path, "TAX_ARITH_ICMS", _percentage(item["icms_base"], item["icms_rate"]),
        item["icms_amount"], tolerance,
    )
    untaxed = F.when(
        item["icms_amount"] != 0,
        finding(amount_path, "TAX_NOT_TAXED_AMOUNT", "0.00", item["icms_amount"]),
    )
    unsupported = finding(
        F.concat(path, F.lit(".cst_csosn")), "TAX_CODE_UNSUPPORTED", TAX_CODE_EXPECTED,
        item["cst_csosn"], "warning",
    )
    return (
        F.when(treatment == "taxed", taxed)
        .when(treatment == "not_taxed", untaxed)
        .otherwise(unsupported)
    )


def ipi_rule(item: Column, path: Column, tolerance: str = CENT) -> Column:
    return _compare(
        F.concat(path, F.lit(".ipi_amount")), "TAX_ARITH_IPI",
        _percentage(item["total"], item["ipi_rate"]), item["ipi_amount"], tolerance,
    )


ITEM_RULES: tuple[tuple[str, Callable[..., Column]], ...] = (
    ("arith", item_arith),
    ("icms", icms_rule),
    ("ipi", ipi_rule),
)


def item_findings(
    item: Column, index: Column, rules: Sequence[str] | None = None, tolerance: str = CENT
) -> Column:
    """The findings of one item as an array; ``rules`` names a subset of ``ITEM_RULES``."""
    return F.array_compact(F.array(*item_cells(item, index, rules, tolerance)))


def item_cells(
    item: Column, index: Column, rules: Sequence[str] | None = None, tolerance: str = CENT
) -> list[Column]:
    """Per rule the finding of one item, or null."""
    path = F.concat(F.lit("items["), index.cast("string"), F.lit("]"))
    chosen = [rule for name, rule in ITEM_RULES if rules is None or name in rules]
    return [rule(item, path, tolerance) for rule in chosen]


def header_findings(
    reference_date: str | None, rules: Sequence[str] | None = None, *, formula: bool = False
) -> Column:
    """The findings that need the header only, in rule order."""
    return F.array_compact(F.array(*header_cells(reference_date, rules, formula=formula)))


def header_cells(
    reference_date: str | None, rules: Sequence[str] | None = None, *, formula: bool = False
) -> list[Column]:
    """Per header rule its finding, or null, in rule order."""
    parts = [
        column
        for name, rule in HEADER_RULES
        if rules is None or name in rules
        for column in rule()
    ]
    if reference_date is not None:
        parts += date_rule(reference_date)
    if formula:
        parts += formula_rule()
    return parts


def items_level_findings(count: Column, three_digit: Column, four_digit: Column) -> list[Column]:
    """No item at all, and 3- and 4-digit tax codes in one invoice."""
    return [
        F.when(count == 0, finding("items", "ITEMS_EMPTY", "at least one item", "0 items")),
        F.when(
            three_digit & four_digit,
            finding("items", "REGIME_CODE_MISMATCH", REGIME_EXPECTED, "3-digit and 4-digit codes"),
        ),
    ]


def sum_findings(
    sums: dict[str, Column], count: Column, tolerance: str = CENT, cap: str = SUM_CAP
) -> list[Column]:
    """The four item sums against their totals boxes; a null sum stands for an overflow."""
    return [
        _compare(
            f"totals.{box}", rule, F.round(sums[column], 2), F.col(f"totals.{box}"),
            sum_tolerance(count, tolerance, cap),
        )
        for rule, column, box in SUM_RULES
    ]


def installment_sum_finding(
    total: Column, count: Column, tolerance: str = CENT, cap: str = SUM_CAP
) -> Column:
    """The installment sum against the invoice total; nothing without installments."""
    checked = _compare(
        "installments", "DUP_SUM", F.round(total, 2), F.col("totals.invoice_total"),
        sum_tolerance(count, tolerance, cap),
    )
    return F.when(count > 0, checked)


def due_date_finding(installment: Column, index: Column, issue_date: Column) -> Column:
    return F.when(
        installment["due_date"] < issue_date,
        finding(
            field_path("installments", index, "due_date"), "DUE_DATE_ORDER",
            F.concat(F.lit("on or after "), issue_date.cast("string")), installment["due_date"],
        ),
    )


# --- nulls ------------------------------------------------------------------------------------


def _null_paths(names: Sequence[str], get: Callable[[str], Column], prefix: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(get(name).isNull(), F.concat(prefix, F.lit(name))) for name in names])
    )


def _list_null_paths(list_name: str, names: Sequence[str]) -> Column:
    def element(item: Column, index: Column) -> Column:
        prefix = F.concat(F.lit(f"{list_name}["), index.cast("string"), F.lit("]"))
        inside = _null_paths(names, lambda name: item[name], F.concat(prefix, F.lit(".")))
        return F.when(item.isNull(), F.array(prefix)).otherwise(inside)

    column = F.col(list_name)
    return F.when(column.isNull(), F.array(F.lit(list_name))).otherwise(
        F.flatten(F.transform(column, element))
    )


def null_paths() -> Column:
    """The paths of every required value that is null, in document order."""
    header = _null_paths(HEADER_REQUIRED, F.col, F.lit(""))
    return F.concat(
        header,
        _list_null_paths("items", ITEM_FIELDS),
        _list_null_paths("installments", INSTALLMENT_FIELDS),
    )


def _null_finding(path: Column) -> Column:
    return finding(path, "NULL_VALUE", "a value", "null")


# --- whole validation -------------------------------------------------------------------------


def _nested_sum(list_name: str, column: str) -> Column:
    zero = F.lit(0).cast("decimal(38,2)")
    return F.aggregate(
        F.col(list_name),
        zero,
        lambda total, row: F.try_add(total, row[column]).cast("decimal(38,2)"),
    )


def nested_findings(
    reference_date: str, tolerance: str = CENT, cap: str = SUM_CAP, header: Column | None = None
) -> Column:
    """All findings of one nested invoice row as an array, in the declared order. ``header`` can hold
    its header cells, made beforehand."""
    items, count = F.col("items"), F.size("items")
    shaped = lambda item: full_match(item["cst_csosn"], ids.TAX_CODE_PATTERN)
    three = F.exists(items, lambda item: shaped(item) & (F.length(item["cst_csosn"]) == 3))
    four = F.exists(items, lambda item: shaped(item) & (F.length(item["cst_csosn"]) == 4))
    sums = {column: _nested_sum("items", column) for _, column, _ in SUM_RULES}
    due = F.array_compact(
        F.transform(
            F.col("installments"), lambda part, i: due_date_finding(part, i, F.col("issue_date"))
        )
    )
    by_item = F.flatten(
        F.transform(items, lambda item, i: item_findings(item, i, tolerance=tolerance))
    )
    tail = F.array_compact(
        F.array(
            *sum_findings(sums, count, tolerance, cap),
            *formula_rule(tolerance),
            installment_sum_finding(
                _nested_sum("installments", "amount"), F.size("installments"), tolerance, cap
            ),
        )
    )
    found = F.concat(
        F.array_compact(header) if header is not None else header_findings(reference_date),
        due,
        F.array_compact(F.array(*items_level_findings(count, three, four))),
        by_item,
        tail,
    )
    nulls = null_paths()
    return F.when(F.size(nulls) > 0, F.transform(nulls, _null_finding)).otherwise(found)


def validate(
    invoices: DataFrame, reference_date: str, *, key: str = "case_id", tolerance: str = CENT,
    cap: str = SUM_CAP,
) -> DataFrame:
    """Findings of nested invoices: one row per problem, with its position in the declared order."""
    made = invoices.withColumn("__header", F.array(*header_cells(reference_date)))
    found = nested_findings(reference_date, tolerance, cap, F.col("__header"))
    listed = made.select(key, F.posexplode(found).alias("ordinal", "f"))
    return listed.select(key, "ordinal", "f.*")


def item_sums(items: DataFrame, key: str = "case_id") -> DataFrame:
    """Per case the item count, the four sums (null on overflow) and the tax code lengths."""
    shaped = full_match(F.col("cst_csosn"), ids.TAX_CODE_PATTERN)
    size = F.length("cst_csosn")
    nulls = [F.col(name).isNull() for name in ITEM_FIELDS]
    any_null = nulls[0]
    for flag in nulls[1:]:
        any_null = any_null | flag
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("item_count"),
        *[F.try_sum(column).alias(f"sum_{column}") for _, column, _ in SUM_RULES],
        F.bool_or(shaped & (size == 3)).alias("three_digit"),
        F.bool_or(shaped & (size == 4)).alias("four_digit"),
        F.bool_or(any_null).alias("item_nulls"),
    )


def with_item_sums(headers: DataFrame, items: DataFrame, key: str = "case_id") -> DataFrame:
    """Headers with their item sums; a header without items has count 0 and zero sums."""
    joined = headers.join(item_sums(items, key), key, "left")
    missing = F.col("item_count").isNull()
    zero = F.lit(0).cast("decimal(28,2)")
    return joined.withColumns(
        {
            f"sum_{column}": F.when(missing, zero).otherwise(F.col(f"sum_{column}"))
            for _, column, _ in SUM_RULES
        }
        | {
            name: F.coalesce(F.col(name), F.lit(False))
            for name in ("three_digit", "four_digit", "item_nulls")
        }
    ).withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def total_findings(headers: DataFrame, items: DataFrame, *, key: str = "case_id") -> DataFrame:
    """Empty-list, code-length and sum findings of flat tables."""
    summed = with_item_sums(headers, items, key)
    sums = {column: F.col(f"sum_{column}") for _, column, _ in SUM_RULES}
    count = F.col("item_count")
    found = items_level_findings(count, F.col("three_digit"), F.col("four_digit"))
    found += sum_findings(sums, count)
    return each_found(summed, [key], found)


def item_table_findings(
    items: DataFrame, *, key: str = "case_id", row: str = "row", rules: Sequence[str] | None = None
) -> DataFrame:
    """Item findings of a flat item table; no shuffle."""
    item = F.struct(*ITEM_FIELDS)
    return each_found(items, [key], item_cells(item, F.col(row), rules))


def installment_findings(
    headers: DataFrame, installments: DataFrame, *, key: str = "case_id"
) -> DataFrame:
    """Due dates before the issue date and installment sums off the invoice total."""
    dates = headers.select(key, "issue_date")
    part = F.struct(*INSTALLMENT_FIELDS)
    due = due_date_finding(part, F.col("row"), F.col("issue_date"))
    late = each_found(installments.join(dates, key), [key], [due])
    sums = installments.groupBy(key).agg(
        F.try_sum("amount").alias("installment_sum"), F.count(F.lit(1)).alias("installment_count")
    )
    off = each_found(
        headers.join(sums, key),
        [key],
        [installment_sum_finding(F.col("installment_sum"), F.col("installment_count"))],
    )
    return late.unionByName(off)


def flat_null_findings(
    headers: DataFrame, items: DataFrame, installments: DataFrame | None = None, *,
    key: str = "case_id",
) -> DataFrame:
    """NULL_VALUE findings of flat header, item and installment tables."""

    def held(rows: DataFrame, names: Sequence[str], prefix: Column) -> DataFrame:
        """Paths of the nulls; rows without one, nearly all, build no array."""
        some = F.col(names[0]).isNull()
        for name in names[1:]:
            some = some | F.col(name).isNull()
        return rows.filter(some).select(
            key, F.explode(_null_paths(names, F.col, prefix)).alias("path")
        )

    def listed(rows: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
        prefix = F.concat(F.lit(f"{name}["), F.col("row").cast("string"), F.lit("]."))
        return held(rows, fields, prefix)

    header = held(headers, HEADER_REQUIRED, F.lit(""))

    paths = header.unionByName(listed(items, "items", ITEM_FIELDS))
    if installments is not None:
        paths = paths.unionByName(listed(installments, "installments", INSTALLMENT_FIELDS))
    return paths.select(key, F.inline(F.array(_null_finding(F.col("path")))))


def validate_flat(
    headers: DataFrame, items: DataFrame, installments: DataFrame, reference_date: str, *,
    key: str = "case_id",
) -> DataFrame:
    """All findings of flat tables; a case with a null value keeps only its NULL_VALUE rows.

    The null findings, few as a rule, are written first: Spark then knows their size and hands them to
    the tasks, and only where they are many does every table move to meet them.
    """
    nulls = stored(flat_null_findings(headers, items, installments, key=key), "null-findings")
    head = each_found(headers, [key], header_cells(reference_date, formula=True))
    found = (
        head.unionByName(item_table_findings(items, key=key))
        .unionByName(total_findings(headers, items, key=key))
        .unionByName(installment_findings(headers, installments, key=key))
    )
    blocked = nulls.select(key).distinct()
    return found.join(blocked, key, "left_anti").unionByName(nulls)


def severity_split(cases: DataFrame, findings: DataFrame, *, key: str = "case_id") -> DataFrame:
    """Per case its error and warning counts and ``ok`` / ``warned`` / ``failed``."""
    counts = findings.groupBy(key).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    joined = cases.select(key).join(counts, key, "left")
    errors, warnings = (F.coalesce(name, F.lit(0)) for name in ("errors", "warnings"))
    verdict = F.when(errors > 0, "failed").when(warnings > 0, "warned").otherwise("ok")
    return joined.select(
        key, errors.alias("errors"), warnings.alias("warnings"), verdict.alias("verdict")
    )


# The longest echoed value, and what is said when a value may not be echoed.
MAX_REVEALED_LENGTH = 64
UNKNOWN_SENTENCE = (
    "This value fails an automatic consistency check. Re-read it on the document."
)
RULE_SENTENCES = {
    "CNPJ_FORMAT": "The CNPJ is not 14 characters of the expected form. Re-read all 14 characters on the document.",
    "CNPJ_CHECK_DIGIT": "The check digits of the CNPJ do not match its other characters. Re-read all 14 characters on the document.",
    "CPF_FORMAT": "The CPF is not 11 digits. Re-read all 11 digits on the document.",
    "CPF_CHECK_DIGIT": "The check digits of the CPF do not match its other digits. Re-read all 11 digits on the document.",
    "TAX_ID_KIND_MISMATCH": "The tax identifier kind does not match the length of the identifier. Re-read the identifier on the document.",
    "UF_UNKNOWN": "This state code is not a valid Brazilian state code. Re-read it on the document.",
    "KEY_FORMAT": "The access key is not 44 characters of the expected form. Re-read all 44 characters on the document.",
    "KEY_CHECK_DIGIT": "The check digit of the access key does not match its other 43 characters. Re-read all 44 characters on the document.",
    "KEY_UF_MISMATCH": "The state segment of the access key does not match the issuer state. Re-read the access key and the issuer state on the document.",
    "KEY_ISSUER_CNPJ_MISMATCH": "The issuer CNPJ segment of the access key does not match the issuer CNPJ. Re-read the access key and the issuer CNPJ on the document.",
    "KEY_YEAR_MONTH_MISMATCH": "The year and month segment of the access key does not match the issue date. Re-read the access key and the issue date on the document.",
    "KEY_MODEL_MISMATCH": "The model segment of the access key is not the one expected for this document. Re-read the access key on the document.",
    "KEY_SERIES_MISMATCH": "The series segment of the access key does not match the invoice series. Re-read the access key and the series on the document.",
    "KEY_NUMBER_MISMATCH": "The number segment of the access key does not match the invoice number. Re-read the access key and the number on the document.",
    "REGIME_CODE_MISMATCH": "The CST or CSOSN codes of the items mix code lengths. Re-read the CST column on the document.",
    "NULL_VALUE": "A required value is missing from the previous answer. Re-read this part of the document and return every field.",
    "ARITH_OVERFLOW": "A value is too large to be an amount on this document. Re-read it on the document.",
}


def redact(findings: DataFrame) -> DataFrame:
    """Error findings with a ``detail`` text that never echoes an unsafe value.

    Arithmetic and date rules show both values when they are short and plain; every other rule
    shows a fixed sentence.
    """
    safe = lambda value: (
        (F.length(value) <= MAX_REVEALED_LENGTH) & full_match(value, r"[A-Za-z0-9 .:\-]+")
    )
    revealed = F.when(
        safe(F.col("expected")) & safe(F.col("actual")),
        F.concat(
            F.lit("Expected "), F.col("expected"), F.lit(", but the answer has "), F.col("actual"),
            F.lit(". Re-read both on the document."),
        ),
    ).otherwise(F.lit(UNKNOWN_SENTENCE))
    entries = [F.lit(part) for pair in RULE_SENTENCES.items() for part in pair]
    fixed = F.coalesce(
        F.try_element_at(F.create_map(*entries), F.col("rule_id")), F.lit(UNKNOWN_SENTENCE)
    )
    detail = F.when(F.col("rule_id").isin(*REVEALED_RULES), revealed).otherwise(fixed)
    return (
        findings.filter(F.col("severity") == "error")
        .withColumn("detail", detail)
        .drop("expected", "actual", "severity")
    )


def truth_gate(findings: DataFrame) -> DataFrame:
    """The error findings of a truth table; an empty result passes, warnings are allowed."""
    return findings.filter(F.col("severity") == "error")
