from pyspark.sql import functions as F

from lumenota.operators import datasets as ds
from lumenota.operators.evaluate import grade_answers
from tests.fixtures import frame, invoice


def test_each_misreading_gets_its_own_tag(spark):
    """All 18 misreadings at once: one case each, and every wrong value carries that tag."""
    base = [invoice(number) for number in range(1, len(ds.MISREADINGS) + 1)]
    truth = frame(spark, base)
    answers = None
    names = {}
    for number, tag in enumerate(ds.MISREADINGS, start=1):
        names[number] = tag
        part = ds.corrupt(truth.filter(F.col("case_id") == number), tag)
        answers = part if answers is None else answers.unionByName(part)
    answers = answers.persist()
    assert answers.count() == len(ds.MISREADINGS)
    cases = truth.select("case_id", F.lit("success").alias("status"))
    found = grade_answers(cases, truth, answers)
    tags = {}
    for row in found.tagged.select("case_id", "path", "tag").collect():
        tags.setdefault(row.case_id, set()).add(row.tag)
    assert {case: {tag} for case, tag in names.items()} == tags
    verdicts = {r.case_id: r.correct for r in found.cases.select("case_id", "correct").collect()}
    assert set(verdicts.values()) == {False}


def test_perfect_and_broken_answers(spark):
    truth = frame(spark, [invoice(n) for n in (1, 2, 3, 4)])
    statuses = {1: "success", 2: "schema_invalid", 3: "refused", 4: "harness_error"}
    cases = spark.createDataFrame(list(statuses.items()), "case_id bigint, status string")
    found = grade_answers(cases, truth, truth)
    rows = {r.case_id: (r.correct, r.wrong_count) for r in found.cases.collect()}
    assert rows[1] == (True, 0) and rows[3] == (False, 0) and rows[4] == (None, 0)
    assert rows[2] == (False, 27 + 6 + 2)
    assert {r.tag for r in found.tagged.select("tag").distinct().collect()} == {"schema_invalid"}
