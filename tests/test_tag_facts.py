from decimal import Decimal

from lumenota.operators import grading as g
from lumenota.operators import tags
from lumenota.plans.graded import stored_pairs
from lumenota.plans.queries_sources import _whole_invoices
from lumenota.session import stored

WRONG = "case_id bigint, scope string, event string, column string, predicted string"
TRUE = "case_id bigint, code string, description string, ncm string, quantity int, unit_price int, total int, icms_base int, icms_amount int, ipi_amount int"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_from_other_rows_whatever_a_case_holds(spark):
    """Case 1 has more wrong cells than there are bits for it, case 2 one, case 3 none."""
    rows = [(1, f"P{k}", "Thing", "1", k, 2, 3, 4, 5, 6) for k in range(1, 400)]
    rows += [(case, "P1", "Thing", "1", 7, 2, 3, 4, 5, 0) for case in (2, 3)]
    wrong = [(1, "item", None, "code", f"p-{k}") for k in range(1, 800)]
    wrong += [(1, "item", None, "quantity", str(k)) for k in range(300, 500)]
    wrong += [(2, "item", None, "quantity", "7.00"), (2, "item", None, "ipi_amount", "0"),
              (2, "item", "missing", "total", "3"), (2, "header", None, "total", "3"),
              (2, "item", None, "code", None)]
    truth = spark.createDataFrame(rows, TRUE)
    found = tags.values_from_other_rows(spark.createDataFrame(wrong, WRONG), truth)
    shown = sorted(map(tuple, found.collect()))
    # "p-7" is "p 7" when normalised, no true code; amounts are compared at four places.
    assert shown == [(1, "quantity", f"{k}.0000") for k in range(300, 400)] + [(2, "quantity", "7.0000")]
    # True rows meet their case's bits before their cells are listed.
    plan = optimized(found)
    assert "bit_or" in plan and plan.index("Generate") < plan.index("bit_or")


def graded(spark):
    """Two rows of a case; the second answer has the first row's quantity."""
    columns = [(name, "decimal(18,2)" if name in g.NUMERIC_COLUMNS else "string") for name in g.ITEM_COLUMNS]
    kind = "struct<" + ",".join(f"{name}:{t}" for name, t in columns) + ">"
    made = lambda row, q: "named_struct(" + ",".join(
        f"'{name}',CAST('{q if name == 'quantity' else row + 10 * k}' AS {t})" for k, (name, t) in enumerate(columns)
    ) + ")"
    linked = stored(spark.sql(
        f"""SELECT 1L AS case_id, 0 AS row, CAST({made(1, 5)} AS {kind}) AS t, CAST({made(1, 5)} AS {kind}) AS p
        UNION ALL SELECT 1L, 1, {made(2, 8)}, {made(2, 5)}"""
    ), "linked")
    header = stored(spark.sql("SELECT 1L AS case_id, 'success' AS status, false AS crossover"), "header")
    wrong = stored(g.linked_wrong(g.grade_pairs(linked, "item"), "item"), "wrong")
    return wrong, header, linked


def test_wrong_values_are_hashed_by_their_case_alone(spark):
    wrong, header, linked = graded(spark)
    tagged = tags.tag_wrong_values(wrong, header, linked)
    assert [(r.path, r.tag) for r in tagged.collect()] == [("items[1].quantity", "value_from_other_row")]
    joins = [line for line in optimized(tagged).splitlines() if "Join LeftOuter" in line]
    assert joins and not any("event_key" in line or "match_value" in line for line in joins)


def test_pairs_are_stored_without_what_is_right(spark, tmp_path):
    links = spark.sql(
        """SELECT id AS case_id, named_struct('a', 'x', 'n', CAST(1.5 AS DECIMAL(5,2))) AS t,
        CASE id WHEN 0 THEN named_struct('a', 'x', 'n', CAST(1.5 AS DECIMAL(5,2)))
          WHEN 1 THEN named_struct('a', CAST(NULL AS STRING), 'n', CAST(2.5 AS DECIMAL(5,2))) END AS p
        FROM range(3) UNION ALL
        SELECT 3, NULL, named_struct('a', 'y', 'n', CAST(NULL AS DECIMAL(5,2)))"""
    )
    held = stored_pairs(links, "pairs")
    assert held.dtypes == links.dtypes
    rows = {r.case_id: (r.t and tuple(r.t), r.p and tuple(r.p)) for r in held.collect()}
    right = ("x", Decimal("1.50"))
    assert rows == {0: (right, right), 1: (right, (None, Decimal("2.50"))), 2: (right, None), 3: (None, ("y", None))}


def test_whole_invoices_are_nested_where_their_rows_lie(spark):
    """Flat tables are not written first, and no list is moved to its invoice."""
    plan = _whole_invoices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "answered-" not in plan
    assert not any("collect_list" in line for line in plan.splitlines() if "Exchange" in line)
    lists = [line for line in plan.splitlines() if "collect_list" in line]
    assert lists
