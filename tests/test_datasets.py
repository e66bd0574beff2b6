from pyspark.errors import PySparkRuntimeError, SparkRuntimeException
from pyspark.sql import functions as F

import pytest

from lumenota.operators import datasets as ds


def greedy(rows, cells, seed):
    from hashlib import sha256

    taken = []
    for name, test in cells:
        pool = [r[0] for r in rows if r[1] == "dev" and test(r) and r[0] not in taken]
        taken.append(min(pool, key=lambda c: (sha256(f"{seed}:ci:{name}:{c}".encode()).hexdigest(), c)))
    return [(name, c) for (name, _), c in zip(cells, taken, strict=True)]


def test_picks_equal_a_loop_over_the_cells(spark):
    rows = [(i, "dev" if i % 3 else "test", i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "case_id int, split string, kind int")
    names = [f"k{i}" for i in range(4)] + ["any", "again", "more"]
    tests = [lambda r, i=i: r[2] == i for i in range(4)] + [lambda r: True] * 3
    columns = [F.col("kind") == i for i in range(4)] + [F.lit(True)] * 3
    for seed in "123":
        got = ds.pick_one_per_cell(df, list(zip(names, columns, strict=True)), seed).collect()
        assert [tuple(r) for r in got] == greedy(rows, list(zip(names, tests, strict=True)), seed)


def test_a_cell_without_a_free_case_is_an_error(spark):
    df = spark.createDataFrame([(1, "dev")], "case_id int, split string")
    with pytest.raises((PySparkRuntimeError, SparkRuntimeException), match="cell 'two'|cell two"):
        ds.pick_one_per_cell(df, [("one", F.lit(True)), ("two", F.lit(True))], "1").collect()


def test_nesting_keeps_printed_order_and_empty_lists(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, name string")
    items = spark.createDataFrame([(1, 3, "z"), (1, 0, "y"), (1, 10, None)], "case_id int, row int, code string")
    parts = spark.createDataFrame([], "case_id int, row int, amount int")
    got = {r.case_id: r for r in ds.nest_invoices(heads, items, parts).collect()}
    assert [i.code for i in got[1]["items"]] == ["y", "z", None]
    assert got[1].installments == [] and got[2]["items"] == []


def plan(**changes):
    """A consistent cell of ten slots, with changes."""
    cell = {
        "cell": "simples-short", "regime": "simples", "length": "short", "count": 10, "item_low": 1,
        "item_high": 8, "pages": "single", "traits": {"mei": [5], "confusable": [6], "long_text": [7]},
        "pinned": {8: 1, 9: 4}, "curve": {0: "dev", 1: "test"}, "long_low": 20, "long_high": 30,
    }
    return {**cell, **changes}


PROBLEMS = (
    ({}, set()),
    ({"regime": "other"}, {"no such regime"}),
    ({"length": "huge"}, {"no such length", "long_text not for this length"}),
    ({"pages": "none"}, {"no such pages", "curve not for this pages"}),
    ({"count": 1, "traits": {}, "pinned": {}, "curve": {}}, {"fewer bases than splits"}),
    ({"item_low": 0}, {"item band does not ascend from 1"}),
    ({"long_low": 31}, {"long band does not ascend from 1"}),
    ({"long_low": None, "long_high": None}, set()),
    ({"traits": {"mei": [10, -1]}}, {"mei on a slot the cell lacks"}),
    ({"traits": {"st_deferral": [5]}}, {"st_deferral not for this regime"}),
    ({"cell": "normal-short"}, {"mei not for this cell"}),
    ({"traits": {"mixed_tax_codes": [8, 9]}}, {"mixed_tax_codes together with pinned_one"}),
    ({"traits": {"confusable": [8]}}, {"confusable together with pinned_one"}),
    ({"traits": {"confusable": [4], "long_text": [4]}}, {"confusable together with long_text"}),
    ({"traits": {"confusable": [0]}}, {"confusable together with curve"}),
    ({"traits": {"mei": [1]}}, {"mei together with curve"}),
    ({"traits": {"long_text": [1]}}, {"long_text together with curve"}),
    ({"traits": {"long_text": [9]}}, set()),
    ({"traits": {"long_text": [9]}, "length": "multi_page"}, {"long_text together with pinned"}),
    ({"traits": {"cpf_recipient": [3], "alphanumeric_recipient": [3]}},
     {"alphanumeric_recipient together with cpf_recipient"}),
    ({"pinned": {10: 2}}, {"pinned on a slot the cell lacks"}),
    ({"curve": {0: "dev", 11: "test"}}, {"curve on a slot the cell lacks"}),
    ({"curve": {0: "train"}}, {"curve without a split"}),
    ({"curve": {n: "dev" for n in range(3)}}, set()),
    ({"curve": {n: "dev" for n in range(4)}}, {"more dev curve slots than places"}),
)


def test_every_relation_of_a_quota_plan(spark):
    schema = (
        "cell string, regime string, length string, count int, item_low int, item_high int, "
        "pages string, traits map<string,array<int>>, pinned map<int,int>, curve map<int,string>, "
        "long_low int, long_high int, number int"
    )
    rows = [tuple({**plan(**change), "number": i}.values()) for i, (change, _) in enumerate(PROBLEMS)]
    cells = spark.createDataFrame(rows, schema)
    # Cells are told apart by name; the number stands in for it where a problem does not need it.
    for i, (change, expected) in enumerate(PROBLEMS):
        found = ds.check_quota(cells.filter(F.col("number") == i)).collect()
        assert {r.problem for r in found} == expected, change
