from pyspark.sql import functions as F

from lumenota.operators import measure as m
from lumenota.operators.grading import HEADER_FIELDS


def field_cases(spark, rows):
    """(slice, base case, number of right fields) as cases; no number means no header."""
    listed = spark.createDataFrame(rows, "t string, base_case bigint, rights int")
    flags = [(F.col("rights") > k).alias(name.replace(".", "__")) for k, name in enumerate(HEADER_FIELDS)]
    return listed.withColumn("fields", F.when(F.col("rights").isNotNull(), F.struct(*flags)))


def test_fields_are_counted_before_they_are_listed(spark):
    rows = [("a", 1, 3), ("a", 1, 0), ("a", 2, 40), ("b", None, 1), ("b", 3, None), ("c", 4, None)]
    stats = m.field_stats(field_cases(spark, rows), ("t",))
    got = {(r.t, r.label): (r.correct, r.n, r.invoices) for r in stats.collect()}
    wanted = {}
    for t, n, invoices in (("a", 3, 2), ("b", 1, 0)):
        for k, label in enumerate(HEADER_FIELDS):
            right = sum(r is not None and r > k for s, _, r in rows if s == t)
            wanted[t, label] = (right, n, invoices)
    assert got == wanted
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_no_case_has_no_field(spark):
    assert m.field_stats(field_cases(spark, [("a", 1, None)])).collect() == []
