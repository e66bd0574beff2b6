"""Registered queries of the validation rules (V01 to V30), over answered invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenota.functions import identifiers as ids
from lumenota.operators import rules as r
from lumenota.plans import bindings as b
from lumenota.plans import oracle_sql as q
from lumenota.plans.graded import answered_invoices
from lumenota.plans.registry import query
from lumenota.session import stored

C = F.col
COLUMNS = "case_id, field, rule_id, expected, actual, severity"


def _row(source: str, field: str, rule: str, expected: str, actual: str, where: str,
         severity: str = "error") -> str:
    return (
        f"SELECT case_id, {field} AS field, '{rule}' AS rule_id, {expected} AS expected, "
        f"{actual} AS actual, '{severity}' AS severity FROM {source} WHERE {where}"
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _is_cnpj(x: str) -> str:
    return f"regexp_full_match({x},'{ids.CNPJ_PATTERN}')"


def _is_cpf(x: str) -> str:
    return f"regexp_full_match({x},'{ids.CPF_PATTERN}')"


_IS_KEY = f"regexp_full_match(access_key,'{ids.ACCESS_KEY_PATTERN}')"
_UF_KNOWN = f"list_contains({q.UF_ARRAY}, issuer_uf)"
_UF_CODE = f"{q.UF_CODE_ARRAY}[list_position({q.UF_ARRAY},issuer_uf)]"


def _cnpj_rows(field: str, x: str, source: str) -> list[str]:
    digits = q.cnpj_digits(f"substr({x},1,12)")
    repeated = f"{x}=repeat(substr({x},1,1),length({x}))"
    name = _text(field)
    return [
        _row(source, name, "CNPJ_CHECK_DIGIT", _text(r.NOT_REPEATED), x,
             f"{_is_cnpj(x)} AND {repeated}"),
        _row(source, name, "CNPJ_CHECK_DIGIT", digits, f"substr({x},13,2)",
             f"{_is_cnpj(x)} AND NOT {repeated} AND {digits}<>substr({x},13,2)"),
    ]


def _header_rows(head: str) -> str:
    cpf = q.cpf_digits("substr(tax_id,1,9)")
    cpf_repeated = "tax_id=repeat(substr(tax_id,1,1),length(tax_id))"
    no_shape = f"NOT {_is_cnpj('tax_id')} AND NOT {_is_cpf('tax_id')}"
    shape = f"CASE WHEN {_is_cnpj('tax_id')} THEN 'cnpj' WHEN {_is_cpf('tax_id')} THEN 'cpf' END"
    key_digit = f"CAST({q.mod11('substr(access_key,1,43)', ids.KEY_WEIGHTS)} AS VARCHAR)"
    tax = "'recipient.tax_id'"
    rows = [
        _row(head, "'issuer.cnpj'", "CNPJ_FORMAT", _text(r.CNPJ_EXPECTED), "issuer_cnpj",
             f"NOT {_is_cnpj('issuer_cnpj')}"),
        *_cnpj_rows("issuer.cnpj", "issuer_cnpj", head),
        *_cnpj_rows("recipient.tax_id", "tax_id", head),
        _row(head, tax, "CPF_CHECK_DIGIT", _text(r.NOT_REPEATED), "tax_id",
             f"{_is_cpf('tax_id')} AND {cpf_repeated}"),
        _row(head, tax, "CPF_CHECK_DIGIT", cpf, "substr(tax_id,10,2)",
             f"{_is_cpf('tax_id')} AND NOT {cpf_repeated} AND {cpf}<>substr(tax_id,10,2)"),
        _row(head, tax, "CPF_FORMAT", _text(r.CPF_EXPECTED), "tax_id",
             f"{no_shape} AND tax_id_kind='cpf'"),
        _row(head, tax, "CNPJ_FORMAT", _text(r.CNPJ_EXPECTED), "tax_id",
             f"{no_shape} AND tax_id_kind<>'cpf'"),
        _row(head, "'recipient.tax_id_kind'", "TAX_ID_KIND_MISMATCH", shape, "tax_id_kind",
             f"({shape})<>tax_id_kind"),
        _row(head, "'issuer.uf'", "UF_UNKNOWN", _text(r.UF_EXPECTED), "issuer_uf",
             f"NOT {_UF_KNOWN}"),
        _row(head, "'recipient.uf'", "UF_UNKNOWN", _text(r.UF_EXPECTED), "recipient_uf",
             f"NOT list_contains({q.UF_ARRAY}, recipient_uf)"),
        _row(head, "'access_key'", "KEY_FORMAT", _text(r.KEY_EXPECTED), "access_key",
             f"NOT {_IS_KEY}"),
        _row(head, "'access_key'", "KEY_CHECK_DIGIT", key_digit, "substr(access_key,44,1)",
             f"{_IS_KEY} AND {key_digit}<>substr(access_key,44,1)"),
    ]
    part = {name: f"substr(access_key,{start},{size})" for name, start, size in ids.KEY_SEGMENTS}
    crosses = (
        ("KEY_UF_MISMATCH", _UF_CODE, part["uf"], f"{_UF_KNOWN} AND {part['uf']}<>{_UF_CODE}"),
        ("KEY_ISSUER_CNPJ_MISMATCH", "issuer_cnpj", part["cnpj"], f"{part['cnpj']}<>issuer_cnpj"),
        ("KEY_YEAR_MONTH_MISMATCH", "strftime(issue_date,'%y%m')", part["year_month"],
         f"{part['year_month']}<>strftime(issue_date,'%y%m')"),
        ("KEY_MODEL_MISMATCH", "'55'", part["model"], f"{part['model']}<>'55'"),
        ("KEY_SERIES_MISMATCH", "CAST(series AS VARCHAR)", part["series"],
         f"TRY_CAST({part['series']} AS INTEGER)<>series"),
        ("KEY_NUMBER_MISMATCH", "CAST(number AS VARCHAR)", part["number"],
         f"TRY_CAST({part['number']} AS INTEGER)<>number"),
    )
    rows += [
        _row(head, "'access_key'", rule, expected, actual, f"{_IS_KEY} AND {wrong}")
        for rule, expected, actual, wrong in crosses
    ]
    latest = f"DATE '{b.REFERENCE_DATE}' + 1"
    rows.append(
        _row(head, "'issue_date'", "DATE_PLAUSIBLE",
             f"'{r.EARLIEST_ISSUE_DATE} to '||CAST({latest} AS VARCHAR)",
             "CAST(issue_date AS VARCHAR)",
             f"issue_date<DATE '{r.EARLIEST_ISSUE_DATE}' OR issue_date>{latest}")
    )
    formula = (
        "(products_total-discount+icms_st_amount+freight+insurance+other_expenses+ipi_amount)"
    )
    rows.append(
        _row(head, "'totals.invoice_total'", "TOTAL_VNF_FORMULA", q.fixed(formula, 2),
             q.fixed("invoice_total", 2), f"abs({formula}-invoice_total)>1")
    )
    return f"head_findings AS ({' UNION ALL '.join(rows)})"


def _item_rows(items: str, side: str) -> str:
    path = "'items['||pos||']"
    line = q.half_up(f"{side}_quantity*{side}_unit_price", "1000000")
    icms = q.half_up(f"{side}_icms_base*{side}_icms_rate", "10000")
    ipi = q.half_up(f"{side}_total*{side}_ipi_rate", "10000")
    code = f"{side}_cst_csosn"
    taxed = f"({code} IN ('000','020','0900'))"
    untaxed = f"({code} IN ('041','0102'))"
    rows = [
        _row(items, f"{path}.total'", "ITEM_ARITH", q.fixed(line, 2), q.fixed(f"{side}_total", 2),
             f"abs({line}-{side}_total)>1"),
        _row(items, f"{path}.icms_amount'", "TAX_ARITH_ICMS", q.fixed(icms, 2),
             q.fixed(f"{side}_icms_amount", 2), f"{taxed} AND abs({icms}-{side}_icms_amount)>1"),
        _row(items, f"{path}.icms_amount'", "TAX_NOT_TAXED_AMOUNT", "'0.00'",
             q.fixed(f"{side}_icms_amount", 2), f"{untaxed} AND {side}_icms_amount<>0"),
        _row(items, f"{path}.cst_csosn'", "TAX_CODE_UNSUPPORTED", _text(r.TAX_CODE_EXPECTED), code,
             f"NOT {taxed} AND NOT {untaxed}", "warning"),
        _row(items, f"{path}.ipi_amount'", "TAX_ARITH_IPI", q.fixed(ipi, 2),
             q.fixed(f"{side}_ipi_amount", 2), f"abs({ipi}-{side}_ipi_amount)>1"),
    ]
    return f"item_findings AS ({' UNION ALL '.join(rows)})"


# Headers whose boxes are the sums of the true items, checked against the sums of another side.
SUMMED = """
box AS (SELECT case_id, sum(t_total) AS products_total, sum(t_icms_base) AS icms_base,
  sum(t_icms_amount) AS icms_amount, sum(t_ipi_amount) AS ipi_amount FROM t_items GROUP BY case_id),
boxed AS (SELECT h.case_id, coalesce(x.products_total,0) AS products_total,
  coalesce(x.icms_base,0) AS icms_base, coalesce(x.icms_amount,0) AS icms_amount,
  coalesce(x.ipi_amount,0) AS ipi_amount FROM cases h LEFT JOIN box x USING (case_id))"""


# The boxes as an answer prints them, whatever its items add up to.
PRINTED = "boxed AS (SELECT case_id, products_total, icms_base, icms_amount, ipi_amount FROM p_head)"


def _total_rows(side: str) -> str:
    sums = f"""sums AS (SELECT case_id, count(*) AS n, sum({side}_total) AS total,
      sum({side}_icms_base) AS base, sum({side}_icms_amount) AS amount,
      sum({side}_ipi_amount) AS ipi, bool_or(length({side}_cst_csosn)=3) AS three,
      bool_or(length({side}_cst_csosn)=4) AS four FROM {side}_items GROUP BY case_id),
    checked AS (SELECT boxed.*, coalesce(n,0) AS n, coalesce(total,0) AS total,
      coalesce(base,0) AS base, coalesce(amount,0) AS amount, coalesce(ipi,0) AS ipi,
      coalesce(three,false) AS three, coalesce(four,false) AS four
      FROM boxed LEFT JOIN sums USING (case_id))"""
    rows = [
        _row("checked", "'items'", "ITEMS_EMPTY", "'at least one item'", "'0 items'", "n=0"),
        _row("checked", "'items'", "REGIME_CODE_MISMATCH", _text(r.REGIME_EXPECTED),
             "'3-digit and 4-digit codes'", "three AND four"),
    ]
    for rule, mine, box in (
        ("TOTAL_SUM_PRODUCTS", "total", "products_total"),
        ("TOTAL_SUM_ICMS_BASE", "base", "icms_base"),
        ("TOTAL_SUM_ICMS", "amount", "icms_amount"),
        ("TOTAL_SUM_IPI", "ipi", "ipi_amount"),
    ):
        rows.append(
            _row("checked", f"'totals.{box}'", rule, q.fixed(mine, 2), q.fixed(box, 2),
                 f"abs({mine}-{box})>least(greatest(n,1),100)")
        )
    return f"{sums}, total_findings AS ({' UNION ALL '.join(rows)})"


_DUE = _row(
    "inst JOIN p_head USING (case_id)", "'installments['||pos||'].due_date'", "DUE_DATE_ORDER",
    "'on or after '||CAST(issue_date AS VARCHAR)", "CAST(p_due AS VARCHAR)",
    "has_p AND p_due<issue_date",
)
_DUP = _row(
    """(SELECT case_id, sum(p_amount) AS s, count(*) AS n FROM inst WHERE has_p GROUP BY case_id)
       JOIN p_head USING (case_id)""",
    "'installments'", "DUP_SUM", q.fixed("s", 2), q.fixed("invoice_total", 2),
    "abs(s-invoice_total)>least(n,100)",
)
INSTALLMENT_ROWS = f"installment_findings AS ({_DUE} UNION ALL {_DUP})"
# The same over the true installments and the headers whose total follows from the true items.
TRUE_INSTALLMENT_ROWS = (
    INSTALLMENT_ROWS.replace("has_p AND p_due", "p_due")
    .replace(" WHERE has_p GROUP BY", " GROUP BY")
    .replace("p_due", "t_due")
    .replace("p_amount", "t_amount")
    .replace("p_head", "summed_head")
)
SUMMED_HEAD = """summed_head AS (SELECT t.case_id, t.issue_date,
  b.products_total - t.discount + t.freight + b.ipi_amount AS invoice_total
  FROM t_head t JOIN boxed b USING (case_id))"""
EVERY_FINDING = " UNION ALL ".join(
    f"SELECT {COLUMNS} FROM {part}_findings" for part in ("head", "item", "total", "installment")
)
ANSWER_SQL = (
    q.CASES, q.HEADERS, q.LINKS, q.INSTALLMENTS, _header_rows("p_head"), _item_rows("p_items", "p"),
    PRINTED, _total_rows("p"), INSTALLMENT_ROWS, f"every AS ({EVERY_FINDING})",
)

HEAD_SQL = (q.CASES, q.HEADERS, _header_rows("p_head"))
ITEM_SQL = (q.LINKS, _item_rows("p_items", "p"))
TOTAL_SQL = (q.CASES, q.LINKS, SUMMED, _total_rows("p"))
INST_SQL = (q.CASES, q.HEADERS, q.INSTALLMENTS, INSTALLMENT_ROWS)


def answered(spark, sf):
    return b.answered_headers(b.true_headers(spark, sf))


def answered_items(spark, sf):
    return b.answered_items(b.item_links(spark, sf))


def answered_installments(spark, sf):
    return b.flat_installments(b.installment_links(spark, sf), "p")


def header_part(spark, sf, rules, *, dates=False, formula=False):
    found = r.header_findings(b.REFERENCE_DATE if dates else None, rules, formula=formula)
    return answered(spark, sf).select("case_id", F.inline(found))


def _register_header(name: str, rule_ids: tuple[str, ...], rules: tuple[str, ...], **kwargs) -> None:
    listed = ",".join(f"'{rule}'" for rule in rule_ids)
    sql = q.with_ctes(
        *HEAD_SQL, select=f"SELECT {COLUMNS} FROM head_findings WHERE rule_id IN ({listed})"
    )

    @query(name, sql)
    def build(spark, sf):
        return header_part(spark, sf, rules, **kwargs).filter(C("rule_id").isin(*rule_ids))


_register_header("v02_cnpj_format", ("CNPJ_FORMAT",), ("issuer", "recipient"))
_register_header("v03_cnpj_check_digit", ("CNPJ_CHECK_DIGIT",), ("issuer", "recipient"))
_register_header("v04_cpf_format", ("CPF_FORMAT",), ("recipient",))
_register_header("v05_cpf_check_digit", ("CPF_CHECK_DIGIT",), ("recipient",))
_register_header("v06_tax_id_kind_mismatch", ("TAX_ID_KIND_MISMATCH",), ("recipient",))
_register_header("v07_uf_unknown", ("UF_UNKNOWN",), ("uf",))
_register_header("v08_key_format", ("KEY_FORMAT",), ("key",))
_register_header("v09_key_check_digit", ("KEY_CHECK_DIGIT",), ("key",))
_register_header("v10_key_uf_mismatch", ("KEY_UF_MISMATCH",), ("key_cross",))
_register_header("v11_key_issuer_cnpj_mismatch", ("KEY_ISSUER_CNPJ_MISMATCH",), ("key_cross",))
_register_header("v12_key_year_month_mismatch", ("KEY_YEAR_MONTH_MISMATCH",), ("key_cross",))
_register_header("v13_key_model_mismatch", ("KEY_MODEL_MISMATCH",), ("key_cross",))
_register_header(
    "v14_key_series_number", ("KEY_SERIES_MISMATCH", "KEY_NUMBER_MISMATCH"), ("key_cross",)
)
_register_header("v15_date_plausible", ("DATE_PLAUSIBLE",), (), dates=True)
_register_header("v25_total_formula", ("TOTAL_VNF_FORMULA",), (), formula=True)


def _register_item(name: str, rule_id: str, rule: str) -> None:
    sql = q.with_ctes(
        *ITEM_SQL, select=f"SELECT {COLUMNS} FROM item_findings WHERE rule_id='{rule_id}'"
    )

    @query(name, sql)
    def build(spark, sf):
        found = r.item_table_findings(answered_items(spark, sf), rules=(rule,))
        return found.filter(C("rule_id") == rule_id)


_register_item("v19_tax_code_unsupported", "TAX_CODE_UNSUPPORTED", "icms")
_register_item("v20_item_arith", "ITEM_ARITH", "arith")
_register_item("v21_tax_arith_icms", "TAX_ARITH_ICMS", "icms")
_register_item("v22_tax_not_taxed_amount", "TAX_NOT_TAXED_AMOUNT", "icms")
_register_item("v23_tax_arith_ipi", "TAX_ARITH_IPI", "ipi")


def summed_headers(spark, sf, links):
    return b.headers_with_item_totals(b.true_headers(spark, sf), b.true_items(links))


def _total_part(spark, sf):
    links = b.item_links(spark, sf)
    return r.total_findings(summed_headers(spark, sf, links), b.answered_items(links))


def _register_total(name: str, rule_ids: tuple[str, ...]) -> None:
    listed = ",".join(f"'{rule}'" for rule in rule_ids)
    sql = q.with_ctes(
        *TOTAL_SQL, select=f"SELECT {COLUMNS} FROM total_findings WHERE rule_id IN ({listed})"
    )

    @query(name, sql)
    def build(spark, sf):
        return _total_part(spark, sf).filter(C("rule_id").isin(*rule_ids))


_register_total("v17_items_empty", ("ITEMS_EMPTY",))
_register_total("v18_regime_code_mismatch", ("REGIME_CODE_MISMATCH",))
_register_total("v24_total_sums", tuple(rule for rule, _, _ in r.SUM_RULES))


def _installment_part(spark, sf):
    return r.installment_findings(answered(spark, sf), answered_installments(spark, sf))


def _register_installment(name: str, rule_id: str) -> None:
    sql = q.with_ctes(
        *INST_SQL, select=f"SELECT {COLUMNS} FROM installment_findings WHERE rule_id='{rule_id}'"
    )

    @query(name, sql)
    def build(spark, sf):
        return _installment_part(spark, sf).filter(C("rule_id") == rule_id)


_register_installment("v16_due_date_order", "DUE_DATE_ORDER")
_register_installment("v26_dup_sum", "DUP_SUM")


def _with_gaps(spark, sf):
    """Answers with nulls: the issue date of one misreading, the unit of another."""
    answers = answered_invoices(spark, sf)
    heads = answers.headers.withColumn("issue_date", F.when(C("g") != 21, C("issue_date")))
    items = answers.items.withColumn("unit", F.when(C("unit") != "ZZ", C("unit")))
    return heads, items


@query(
    "v01_null_value",
    q.with_ctes(
        q.CASES,
        q.LINKS,
        select="""SELECT case_id, field, 'NULL_VALUE' AS rule_id, 'a value' AS expected,
          'null' AS actual, 'error' AS severity FROM (
          SELECT case_id, 'issue_date' AS field FROM cases WHERE g=21 UNION ALL
          SELECT case_id, 'items['||pos||'].unit' FROM p_items WHERE p_unit='ZZ')""",
    ),
)
def null_value(spark, sf):
    heads, items = _with_gaps(spark, sf)
    return r.flat_null_findings(heads, items)


def _validated(spark, sf):
    """All findings of all rules over the answers."""
    answers = answered_invoices(spark, sf)
    return r.validate_flat(answers.headers, answers.items, answers.installments, b.REFERENCE_DATE)


@query(
    "v01_validate_gated",
    q.with_ctes(
        *ANSWER_SQL,
        """nulls AS (SELECT case_id FROM cases WHERE g=21 UNION ALL
          SELECT case_id FROM p_items WHERE p_unit='ZZ')""",
        select="""SELECT rule_id, severity, count(*) AS findings, count(DISTINCT case_id) AS cases
          FROM every WHERE case_id NOT IN (SELECT case_id FROM nulls) GROUP BY ALL
          UNION ALL SELECT 'NULL_VALUE', 'error', count(*), count(DISTINCT case_id) FROM nulls""",
    ),
)
def validate_gated(spark, sf):
    """All rules over answers with gaps: a case with a null has no other finding."""
    heads, items = _with_gaps(spark, sf)
    installments = answered_invoices(spark, sf).installments
    found = r.validate_flat(heads, items, installments, b.REFERENCE_DATE)
    return found.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("case_id").alias("cases")
    )


@query(
    "v01_validate_all",
    q.with_ctes(*ANSWER_SQL, select=f"SELECT {COLUMNS} FROM every"),
)
def validate_all(spark, sf):
    """Every finding of every rule, in one table."""
    return _validated(spark, sf).select(*COLUMNS.split(", "))


@query(
    "v27_arith_overflow",
    q.with_ctes(
        q.LINKS,
        select="""SELECT case_id, 'items['||pos||'].total' AS field, 'ARITH_OVERFLOW' AS rule_id,
          'a representable amount' AS expected, '' AS actual, 'error' AS severity
          FROM p_items WHERE f=3""",
    ).replace("has_t, has_p,", "has_t, has_p, f,", 1),
)
def arith_overflow(spark, sf):
    """Quantities wider than the declared type: the product overflows and becomes a finding."""
    links = b.item_links(spark, sf).filter(C("p").isNotNull())
    huge = F.when(
        C("p.quantity") == C("t.quantity") * 10, F.lit("9" * 34).cast("decimal(38,4)")
    ).otherwise(C("p.quantity").cast("decimal(38,4)"))
    items = links.select(
        "case_id", C("pos").alias("row"), C("p").withField("quantity", huge).alias("p")
    ).select("case_id", "row", "p.*")
    found = r.item_table_findings(items, rules=("arith",))
    return found.filter(C("rule_id") == "ARITH_OVERFLOW")


@query(
    "v28_severity_split",
    q.with_ctes(
        *ANSWER_SQL,
        """tallied AS (SELECT case_id, count(*) FILTER (severity='error') AS errors,
          count(*) FILTER (severity='warning') AS warnings FROM every GROUP BY case_id)""",
        select="""SELECT case_id, coalesce(errors,0) AS errors, coalesce(warnings,0) AS warnings,
          CASE WHEN coalesce(errors,0)>0 THEN 'failed' WHEN coalesce(warnings,0)>0 THEN 'warned'
          ELSE 'ok' END AS verdict FROM cases LEFT JOIN tallied USING (case_id)""",
    ),
)
def severity_split(spark, sf):
    return r.severity_split(b.case_metadata(spark, sf), _validated(spark, sf))


def _redacted_sql() -> str:
    listed = ",".join(f"'{rule}'" for rule in r.REVEALED_RULES)
    safe = "regexp_full_match({0},'[A-Za-z0-9 .:-]+') AND length({0})<=64"
    fixed = " ".join(
        f"WHEN '{rule}' THEN {_text(sentence)}" for rule, sentence in r.RULE_SENTENCES.items()
    )
    return f"""SELECT case_id, field, rule_id, CASE WHEN rule_id IN ({listed}) THEN
      CASE WHEN {safe.format("expected")} AND {safe.format("actual")} THEN 'Expected '||expected||
        ', but the answer has '||actual||'. Re-read both on the document.'
        ELSE {_text(r.UNKNOWN_SENTENCE)} END
      ELSE CASE rule_id {fixed} ELSE {_text(r.UNKNOWN_SENTENCE)} END END AS detail
      FROM every WHERE severity='error'"""


@query("v29_redact", q.with_ctes(*ANSWER_SQL, select=_redacted_sql()))
def redact(spark, sf):
    return r.redact(_validated(spark, sf))


@query(
    "v30_truth_gate",
    q.with_ctes(
        q.CASES, q.HEADERS, q.LINKS, q.INSTALLMENTS, SUMMED, _header_rows("t_head"),
        _item_rows("t_items", "t"), _total_rows("t"), SUMMED_HEAD, TRUE_INSTALLMENT_ROWS,
        f"every AS ({EVERY_FINDING})",
        select=f"SELECT {COLUMNS} FROM every WHERE severity='error'",
    ),
)
def truth_gate(spark, sf):
    """All rules over true invoices with true sums: what is left are code-length mixes, empty orders,
    late dates and the installments, which still follow the printed total."""
    # Each table is read by several rules, so it is made and written once.
    items = stored(b.true_items(b.item_links(spark, sf)), "true-items")
    headers = b.headers_with_item_totals(b.true_headers(spark, sf), items)
    found = r.validate_flat(
        stored(headers, "true-headers"),
        items,
        stored(b.flat_installments(b.installment_links(spark, sf), "t"), "true-installments"),
        b.REFERENCE_DATE,
    )
    return r.truth_gate(found)
