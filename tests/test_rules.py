import copy
from decimal import Decimal as D

import pytest

from lumenota.operators import evaluate, rules
from tests.fixtures import frame, invoice

DAY = "2026-04-01"


def found(spark, data):
    rows = rules.validate(frame(spark, [data]), DAY).orderBy("ordinal").collect()
    return [(r.rule_id, r.field) for r in rows]


def changed(**members):
    data = invoice(1)
    data.update(members)
    return data


def nested(path, value):
    data = copy.deepcopy(invoice(1))
    target = data
    *parents, last = path
    for part in parents:
        target = target[part]
    target[last] = value
    return data


def test_valid_invoice_has_no_finding(spark):
    assert found(spark, invoice(1)) == []


@pytest.mark.parametrize(
    "path, value, expected",
    [
        (("recipient", "uf"), "ZZ", ("UF_UNKNOWN", "recipient.uf")),
        (("recipient", "tax_id"), "abc", ("CNPJ_FORMAT", "recipient.tax_id")),
        (("recipient", "tax_id"), "52998224725", ("TAX_ID_KIND_MISMATCH", "recipient.tax_id_kind")),
        (("number",), 5, ("KEY_NUMBER_MISMATCH", "access_key")),
        (("series",), 7, ("KEY_SERIES_MISMATCH", "access_key")),
        (("items", 0, "total"), D("1.00"), ("ITEM_ARITH", "items[0].total")),
        (("items", 2, "icms_amount"), D("1.00"), ("TAX_ARITH_ICMS", "items[2].icms_amount")),
        (("items", 2, "cst_csosn"), "041", ("TAX_NOT_TAXED_AMOUNT", "items[2].icms_amount")),
        (("items", 2, "cst_csosn"), "010", ("TAX_CODE_UNSUPPORTED", "items[2].cst_csosn")),
        (("items", 1, "ipi_amount"), D("9.00"), ("TAX_ARITH_IPI", "items[1].ipi_amount")),
        (("items", 1, "cst_csosn"), "0900", ("REGIME_CODE_MISMATCH", "items")),
        (("totals", "freight"), D("99.00"), ("TOTAL_VNF_FORMULA", "totals.invoice_total")),
        (("installments", 0, "amount"), D("1.00"), ("DUP_SUM", "installments")),
        (("access_key",), "x", ("KEY_FORMAT", "access_key")),
    ],
)
def test_one_change_one_rule(spark, path, value, expected):
    assert expected in found(spark, nested(path, value))


def test_null_values_suppress_everything_else(spark):
    data = nested(("items", 1, "unit"), None)
    data["recipient"]["uf"] = "ZZ"
    data["operation_nature"] = None
    assert found(spark, data) == [("NULL_VALUE", "operation_nature"), ("NULL_VALUE", "items[1].unit")]


def test_empty_items(spark):
    ids = [rule for rule, _ in found(spark, changed(items=[]))]
    assert ids[0] == "ITEMS_EMPTY" and "TOTAL_SUM_PRODUCTS" in ids


def test_flat_and_nested_agree(spark):
    data = [invoice(1), nested(("items", 0, "total"), D("1.00")), changed(items=[])]
    for case, row in enumerate(data):
        row["case_id"] = case
    df = frame(spark, data)
    headers = df.drop("items", "installments")
    flat = rules.validate_flat(
        headers, evaluate.list_rows(df, "items"), evaluate.list_rows(df, "installments"), DAY
    )
    columns = ("case_id", "field", "rule_id", "expected", "actual", "severity")
    left = sorted(map(tuple, rules.validate(df, DAY).select(*columns).collect()))
    assert left == sorted(map(tuple, flat.select(*columns).collect())) and left


def test_redaction_never_echoes_identifiers(spark):
    df = rules.validate(frame(spark, [nested(("recipient", "tax_id"), "secret!")]), DAY)
    shown = [r.detail for r in rules.redact(df).collect()]
    assert shown and not any("secret" in text for text in shown)


def test_null_installments_block_the_flat_form_too(spark):
    row = nested(("installments", 0, "amount"), None)
    df = frame(spark, [row])
    flat = rules.validate_flat(
        df.drop("items", "installments"), evaluate.list_rows(df, "items"),
        evaluate.list_rows(df, "installments"), DAY,
    )
    assert [(r.rule_id, r.field) for r in flat.collect()] == [("NULL_VALUE", "installments[0].amount")]
    assert found(spark, row) == [("NULL_VALUE", "installments[0].amount")]


def test_truth_tables_are_made_once(spark):
    """Lines, orders and installments are read from what was written, however many rules ask for them."""
    from lumenota.plans.queries_rules import truth_gate

    plan = truth_gate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
