"""Plans that stay cheap on large tables: compiled expressions, rows that need not move."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lumenota.functions import identifiers as ids
from lumenota.operators import rules as r
from lumenota.plans import bindings as b

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, before)


def test_queries_have_long_methods_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    queries()["f10_mod11_check"](spark, SF)
    assert int(spark.conf.get(key)) <= 8000


def test_headers_are_hashed_by_case_once(spark, no_broadcast):
    counted = b.header_links(spark, SF).groupBy("case_id").count()
    # orders and customers by customer, then the narrow rows by order
    assert len(re.findall(r"Exchange hashpartitioning", _plan(counted))) == 3


def test_check_digits_of_any_text(spark):
    texts = ["112223330001", "12ABC34501DE", "1122233300", "", None, "11222333 001", "-./ -./ -./ ",
             "1122233300019", "é12223330001", "٣12223330001"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [x[0] for x in rows.select(ids.mod11_check(F.col("t"), ids.CNPJ_WEIGHTS_1)).collect()]

    def digit(text):
        if text is None or len(text) < 12:
            return None
        total = sum((ord(c) - 48) * w for c, w in zip(text, ids.CNPJ_WEIGHTS_1, strict=False))
        return 0 if total < 0 or total % 11 < 2 else 11 - total % 11

    assert found == [digit(t) for t in texts]


def _flat(spark, unit):
    item = dict.fromkeys(r.ITEM_FIELDS, "1") | {"cst_csosn": "000", "unit": unit}
    kinds = b.KINDS
    items = spark.createDataFrame([("a", 0)], "case_id string, row int").select(
        "case_id", "row", *[F.lit(item[n]).cast(kinds[n]).alias(n) for n in r.ITEM_FIELDS]
    )
    one = b.true_headers(spark, SF).limit(1).withColumn("case_id", F.lit("a"))
    heads = spark.createDataFrame(one.collect(), one.schema)
    parts = spark.createDataFrame(
        [], "case_id string, row int, number string, due_date date, amount decimal(18,2)"
    )
    return heads, items, parts


def test_few_nulls_do_not_move_the_other_tables(spark):
    plan = _plan(r.validate_flat(*_flat(spark, "UN"), b.REFERENCE_DATE))
    anti = [line for line in plan.splitlines() if "LeftAnti" in line]
    assert anti and all("BroadcastHashJoin" in line for line in anti)


def test_a_null_leaves_only_null_findings(spark):
    found = r.validate_flat(*_flat(spark, None), b.REFERENCE_DATE).collect()
    assert [(x.field, x.rule_id) for x in found] == [("items[0].unit", "NULL_VALUE")]


def test_found_cells_keep_order_and_columns(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    cells = [F.when(F.col("v").isNotNull(), F.struct(F.col("v").alias("a"))),
             F.when(F.col("k") == 1, F.struct(F.lit("y").alias("a")))]
    found = r.each_found(rows, [F.col("k").alias("key")], cells)
    assert found.columns == ["key", "a"]
    assert [tuple(x) for x in found.collect()] == [(1, "x"), (1, "y")]
