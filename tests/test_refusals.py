import pytest
from pyspark.sql import functions as F

from lumenota.operators import decisions as d

CASES = "case_id string, extraction_status string, tax_id string, has_warning boolean, invoice_total decimal(18,2)"


def test_a_policy_has_one_row(spark):
    cases = spark.createDataFrame([("a", "success", "B", False, None)], CASES)
    policy = spark.createDataFrame([("B", None)], "buyer_cnpj string, approval_limit decimal(18,2)")
    assert d.label(cases, policy).count() == 1
    for wrong in (policy.union(policy), policy.limit(0)):
        with pytest.raises(Exception, match="exactly one row"):
            d.label(cases, wrong).collect()


def test_records_without_a_label_are_refused(spark):
    columns = "case_id string, status string, decision string, cause string, model_decision string"
    rows = [("a", "decided", "approve", "none", "approve"), ("b", "decided", "reject", "none", None)]
    records = spark.createDataFrame(rows, columns)
    labels = records.select("case_id", "decision", "cause")
    assert d.grade_decisions(records, labels).filter("decision_correct").count() == 2
    with pytest.raises(Exception, match="no label for case b"):
        d.grade_decisions(records, labels.filter(F.col("case_id") == "a")).collect()
