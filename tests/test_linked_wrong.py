from lumenota.operators import grading as g


def test_wholly_right_rows_make_no_cells(spark):
    values = "struct<number:string,due_date:date,amount:decimal(18,2)>"
    links = spark.sql(
        f"""SELECT 1L AS case_id, pos AS row, from_json(t, '{values}') AS t, from_json(p, '{values}') AS p
        FROM VALUES
        (0, '{{"number":"1","amount":5}}', '{{"number":"1","amount":5}}'),
        (1, '{{"number":"2","due_date":"2020-01-01","amount":5}}', '{{"number":"2","due_date":"2020-01-01","amount":5}}'),
        (2, '{{"number":"3","amount":5}}', NULL),
        (3, NULL, '{{"number":"4","amount":5}}') AS links(pos, t, p)"""
    )
    wrong = g.linked_wrong(g.grade_pairs(links, "installment"), "installment")
    shown = {(r["path"], r["event"]) for r in wrong.collect()}
    # A value that is null on both sides is wrong, so the first row keeps its cell.
    assert shown == {
        ("installments[0].due_date", None),
        ("installments[2].amount", "missing"),
        ("installments[+3].amount", "extra"),
    }
    plan = wrong._jdf.queryExecution().analyzed().toString()
    assert "Filter" in plan[plan.index("Generate") :]
