"""Grading of nested answers against nested truth: match, grade, tag and assemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenota.operators import grading as g
from lumenota.operators import matching, tags
from lumenota.session import checkpointed

HEADER = (
    "access_key", "number", "series", "issue_date", "operation_nature", "issuer", "recipient",
    "totals",
)


@dataclass(frozen=True)
class Evaluation:
    """The lazy tables of one graded run."""

    header: DataFrame
    wrong: DataFrame
    tagged: DataFrame
    cases: DataFrame
    item_pairs: DataFrame
    installment_pairs: DataFrame


def list_rows(invoices: DataFrame, list_name: str) -> DataFrame:
    """``case_id, row`` and the members of one list, in printed order."""
    listed = invoices.select("case_id", F.posexplode(list_name).alias("row", "r"))
    return listed.filter(F.col("r").isNotNull()).select("case_id", "row", "r.*")


def _header(invoices: DataFrame) -> DataFrame:
    return invoices.select(
        "case_id",
        *HEADER,
        F.coalesce(F.size("items"), F.lit(0)).alias("item_count"),
        F.coalesce(F.size("installments"), F.lit(0)).alias("installment_count"),
    )


def grade_answers(
    cases: DataFrame, truth: DataFrame, answers: DataFrame, tolerance: str = "0.00"
) -> Evaluation:
    """Grade nested answers: rows matched by optimal assignment, each wrong value tagged.

    ``cases`` has ``case_id, status`` and any metadata. A case with a broken answer keeps no
    answered rows and is wrong everywhere; refused and unfinished cases are not graded.
    """
    graded = cases.filter(F.col("status").isin(*g.GRADED_STATUSES)).select("case_id", "status")
    usable = graded.filter(F.col("status") != "schema_invalid").select("case_id")
    true_side = truth.join(graded.select("case_id"), "case_id", "left_semi")
    answer_side = answers.join(usable, "case_id", "left_semi")
    header = g.grade_header(
        g.join_headers(cases, _header(true_side), _header(answer_side)), tolerance
    )
    wrong = g.header_wrong(header)
    sides = {}
    for kind, (_, list_name, _) in g.KINDS.items():
        true_rows, answer_rows = list_rows(true_side, list_name), list_rows(answer_side, list_name)
        pairs = checkpointed(matching.match_rows(true_rows, answer_rows, kind))  # used four times
        paired = g.grade_pairs(
            g.pair_rows(true_rows, answer_rows, pairs.drop("score"), kind), kind, tolerance
        )
        missing, extra = g.unmatched_rows(true_rows, answer_rows, pairs)
        wrong = wrong.unionByName(g.pair_wrong(paired, kind)).unionByName(
            g.row_events(missing, extra, kind)
        )
        sides[kind] = (true_rows, paired, missing, extra)
    _, item_pairs, missing, extra = sides["item"]
    linked = g.linked_rows(item_pairs, missing, extra, "item")
    tagged = tags.tag_wrong_values(wrong, header, linked)
    return Evaluation(
        header=header,
        wrong=wrong,
        tagged=tagged,
        cases=g.grade_cases(cases, tagged, header),
        item_pairs=item_pairs,
        installment_pairs=sides["installment"][1],
    )
