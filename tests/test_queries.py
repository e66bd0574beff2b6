"""A few registered queries against their SQL at the smallest scale (all of them are compared when
the driver runs)."""

import math
from pathlib import Path

import duckdb
import pytest

from lumenota.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
CHOSEN = ("f06_rate4", "v20_item_arith", "j06_candidate_pairs", "a17_headline", "l03_roll_up",
          "d12_decision_summary", "n08_invoice_totals")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")


def comparable(rows):
    def one(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 9) + 0.0
        return value

    return sorted((tuple(one(v) for v in row) for row in rows), key=str)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_oracle(spark, name):
    base = duckdb.connect()
    for table in Path(FOLDER).glob("*.parquet"):
        base.execute(f"create view {table.stem} as select * from '{table}'")
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    result = base.execute(ORACLES[name])
    found = [column[0] for column in result.description]
    assert sorted(found) == names
    order = [found.index(column) for column in names]
    oracle = [tuple(row[i] for i in order) for row in result.fetchall()]
    assert comparable(tuple(row[c] for c in names) for row in df.collect()) == comparable(oracle)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 180
