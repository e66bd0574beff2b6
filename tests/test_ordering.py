import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lumenota.operators import datasets as ds
from lumenota.operators.ledger import (
    TOKEN_RATES,
    admit,
    check_overrides,
    check_same_overrides,
    price_table,
    replay,
)
from lumenota.operators.ordering import latest_per_key, row_index, running_before, top_per_key


def hot(spark, seed=1):
    """Two thirds of all rows share one key."""
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), i // 10, i, rng.randint(0, 9)) for i in range(500)]
    return rows, spark.createDataFrame(rows, "g string, chunk int, ord int, v int")


def test_row_index(spark):
    rows, df = hot(spark)
    got = {r.ord: r.pos for r in row_index(df, ["g"], "chunk", ["ord"], "pos").collect()}
    seen = {}
    for g, _, order, _ in rows:
        assert got[order] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1


def test_running_before(spark):
    rows, df = hot(spark)
    found = running_before(df, ["g"], "chunk", ["ord"], {"s": "v"}, {"m": "v"}).collect()
    got = {r.ord: (r.s, r.m) for r in found}
    state = {}
    for g, _, order, v in rows:
        total, most = state.get(g, (None, None))
        assert got[order] == (total, most)
        state[g] = ((total or 0) + v, v if most is None else max(most, v))


def test_latest_per_key(spark):
    rows, df = hot(spark)
    got = {r.g: r.ord for r in latest_per_key(df, ["g"], ["ord"]).collect()}
    assert got == {g: max(r[2] for r in rows if r[0] == g) for g in "ab"}


def test_admit_against_a_loop(spark):
    rng = random.Random(2)
    rows = [("r", i, D(rng.randint(0, 30)) / 10, D(rng.choice([0, 0, 1]))) for i in range(300)]
    df = spark.createDataFrame(rows, "run_id string, ordinal bigint, spent decimal(18,8), assumed decimal(18,8)")
    got = {r.ordinal: r.admitted for r in admit(df, "200", "1.5").collect()}
    spent = assumed = largest = D(0)
    for _, i, cost, held in rows:
        assert got[i] == (spent + assumed + max(D("1.5"), largest) <= 200)
        spent, assumed, largest = spent + cost, assumed + held, max(largest, cost)
    assert not all(got.values()) and any(got.values())


def test_replay_modes(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "key string")
    store = spark.createDataFrame([("a", "old")], "key string, answer string")
    for mode, want in {
        "off": [(None, True), (None, True)], "refresh": [("refresh", True)] * 2,
        "read_write": [("hit", False), ("miss", True)],
        "read_only": [("cache_miss", False), ("hit", False)],
    }.items():
        rows = replay(requests, store, mode).collect()
        got = sorted(((r.cache_status, r.makes_call) for r in rows), key=str)
        assert got == sorted(want, key=str), mode


def test_overrides_must_agree(spark):
    schema = "overrides map<string,string>"
    check_same_overrides(spark.createDataFrame([({},), (None,)], schema))
    import pytest

    with pytest.raises(ValueError, match="different overrides"):
        check_same_overrides(spark.createDataFrame([({"a": "1"},), (None,)], schema))


def test_allocate_sums_to_the_amount(spark):
    rows = [("x", i // 3, i, cap, 100) for i, cap in enumerate([30, 0, 50, 40, 9])]
    df = spark.createDataFrame(rows, "g string, chunk int, ord int, cap bigint, amount bigint")
    found = ds.allocate(df, ["g"], "chunk", ["ord"]).orderBy("ord").collect()
    assert [r.share for r in found] == [30, 0, 50, 20, 0]


def test_quota_plan(spark):
    cells = spark.createDataFrame(
        [(1, "normal-short", "normal", "short", 3, 1, 8, "single", {"confusable": [2]}, {1: 1},
          {0: "dev"}, None, None),
         (2, "simples-short", "simples", "short", 2, 1, 8, "multi", {"mei": [0, 5]}, {}, {1: "x"},
          None, None)],
        "cell_order int, cell string, regime string, length string, count int, item_low int, "
        "item_high int, pages string, traits map<string,array<int>>, pinned map<int,int>, "
        "curve map<int,string>, long_low int, long_high int",
    )
    bases = ds.expand_quota(cells).orderBy("number").collect()
    assert [(r.number, r.cell, r.slot, r.crt) for r in bases] == [
        (1, "normal-short", 0, 3), (2, "normal-short", 1, 3), (3, "normal-short", 2, 3),
        (4, "simples-short", 0, 4), (5, "simples-short", 1, 1),
    ]
    twins = ds.expand_twins(ds.expand_quota(cells)).orderBy("number").collect()
    assert [t.number for t in twins] == list(range(6, 22)) and twins[8].base_number == 5
    problems = {(r.cell, r.problem) for r in ds.check_quota(cells).collect()}
    assert problems == {
        ("simples-short", "mei on a slot the cell lacks"), ("simples-short", "curve without a split"),
        ("simples-short", "curve not for this pages"),
    }


def test_hot_cell_split(spark):
    bases = spark.range(900).select(
        F.col("id").alias("case_id"), F.when(F.col("id") < 600, 1).otherwise(2).alias("cell"),
        F.lit(None).cast("string").alias("curve_split"),
    )
    counts = ds.stratified_split(bases, "1").groupBy("cell", "split").count().collect()
    assert {(r.cell, r.split): r["count"] for r in counts} == {
        (1, "dev"): 200, (1, "test"): 400, (2, "dev"): 100, (2, "test"): 200,
    }


def test_equal_order_values_keep_the_same_row(spark):
    rows = [(k, 5, f"{k}{v}", {"m": str(v)} if v % 2 else None) for k in "ab" for v in range(20)]
    schema = "k string, at int, answer string, extra map<string,string>"
    for parts in (1, 4, 7):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        for columns in (["k", "at", "answer"], ["k", "at", "answer", "extra"]):
            found = latest_per_key(df.select(*columns), ["k"], ["at"]).collect()
            assert sorted(r.answer for r in found) == ["a9", "b9"]
            assert found[0].asDict().keys() == set(columns)
            first = top_per_key(df.select(*columns), ["k"], ["at"]).collect()
            assert sorted(r.answer for r in first) == ["a0", "b0"]


def test_doubled_prices_and_prompts_do_not_multiply_rows(spark):
    rates = list(dict.fromkeys(TOKEN_RATES.values()))
    schema = "model string, " + ", ".join(f"{name} decimal(18,8)" for name in rates)
    price = lambda model, x: (model, *[D(x)] * len(rates))
    aliases = spark.createDataFrame([("x", "m"), ("x", "m")], "alias string, target string")
    doubled = spark.createDataFrame([price("m", 1), price("m", 1), price("n", 2)], schema)
    assert sorted(r.model for r in price_table(doubled, aliases).collect()) == ["m", "n", "x"]
    unlike = spark.createDataFrame([price("m", 1), price("m", 3)], schema)
    with pytest.raises(Exception, match="price: different rows for m"):
        price_table(unlike, aliases).collect()
    requests = spark.createDataFrame(
        [("m", "p1", None, None, 0)],
        "model string, prompt_version string, cache_mode string, replicate_salt string, max_repairs int",
    )
    prompts = spark.createDataFrame([("p1", 1), ("p1", 2)], "prompt_version string, n int")
    assert [r.bad_fields for r in check_overrides(requests, doubled, prompts).collect()] == [[]]
