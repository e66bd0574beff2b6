"""The graded run of the driver tables: cases, wrong values and row statistics in one place."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.operators import grading as g
from lumenota.operators import tags
from lumenota.plans import bindings as b
from lumenota.session import stored


@dataclass(frozen=True)
class GradedRun:
    """A graded run. ``linked`` has all graded item rows, paired, missing (null ``p``) and extra
    (null ``t``), with a ``right_<column>`` flag each, ``parts`` the same of installments; ``wrong`` is the table
    of wrong values."""

    cases: DataFrame
    header: DataFrame
    items: DataFrame
    installments: DataFrame
    linked: DataFrame
    parts: DataFrame
    wrong: DataFrame
    truth: DataFrame


def _kept_links(links: DataFrame, status: DataFrame) -> DataFrame:
    """The links of the graded cases; a case with an unusable answer keeps its true rows only."""
    kept = links.join(status, "case_id").withColumn(
        "p", F.when(F.col("status") != "schema_invalid", F.col("p"))
    )
    used = F.col("t").isNotNull() | F.col("p").isNotNull()
    return kept.filter(used).select("case_id", F.col("pos").alias("row"), "t", "p")


def stored_pairs(links: DataFrame, label: str) -> DataFrame:
    """``links`` stored like any table, but of ``p`` only the members that differ from ``t``."""
    names = links.select("p.*").columns
    same = {name: F.col(f"t.{name}").eqNullSafe(F.col(f"p.{name}")) for name in names}
    kept = links.withColumns(
        {
            "__answered": F.col("p").isNotNull(),
            "__same": F.struct(*[hit.alias(name) for name, hit in same.items()]),
            "__own": F.struct(
                *[F.when(~hit, F.col(f"p.{name}")).alias(name) for name, hit in same.items()]
            ),
        }
    ).drop("p")
    held = stored(kept, label)
    members = [
        F.when(F.col(f"__same.{name}"), F.col(f"t.{name}")).otherwise(F.col(f"__own.{name}")).alias(name)
        for name in names
    ]
    whole = held.withColumn("p", F.when(F.col("__answered"), F.struct(*members)))
    return whole.select(*links.columns)


def counted(links: DataFrame, name: str) -> DataFrame:
    """Per case the number of true and of answered rows, in one grouping."""
    return links.groupBy("case_id").agg(
        F.count_if(F.col("t").isNotNull()).alias(f"true_{name}"),
        F.count_if(F.col("p").isNotNull()).alias(f"answered_{name}"),
    )


def counted_headers(
    header_links: DataFrame, item_links: DataFrame, installment_links: DataFrame
) -> DataFrame:
    """Header links of the graded cases with both list lengths inside ``t`` and ``p``.

    The lists' links are those of the graded cases; a case with an unusable answer has none there.
    """
    names = ("item_count", "installment_count")
    joined = (
        header_links.filter(F.col("status").isin(*g.GRADED_STATUSES))
        .join(counted(item_links, names[0]), "case_id", "left")
        .join(counted(installment_links, names[1]), "case_id", "left")
    )
    t, p = (
        F.struct(
            *[F.col(f"{side}.{name}").alias(name) for name in b.HEADER_COLUMNS],
            *[F.coalesce(f"{word}_{name}", F.lit(0)).alias(name) for name in names],
        )
        for side, word in (("t", "true"), ("p", "answered"))
    )
    usable = F.when(F.col("status") != "schema_invalid", p)
    both = joined.select("case_id", "status", t.alias("t"), usable.alias("p"))
    return both.withColumn("crossover", g.party_crossover(F.col("t"), F.col("p")))


@dataclass(frozen=True)
class Invoices:
    headers: DataFrame
    items: DataFrame
    installments: DataFrame


@lru_cache(maxsize=4)
def answered_invoices(spark: SparkSession, sf_dir: str) -> Invoices:
    """The answered invoices as flat tables, written once a session like ``graded_run``."""
    return Invoices(
        stored(b.answered_headers(b.true_headers(spark, sf_dir)), "answered-headers"),
        stored(b.answered_items(b.item_links(spark, sf_dir)), "answered-items"),
        stored(
            b.flat_installments(b.installment_links(spark, sf_dir), "p"), "answered-installments"
        ),
    )


@lru_cache(maxsize=4)
def graded_run(spark: SparkSession, sf_dir: str, tolerance: str = "0.00") -> GradedRun:
    """One graded run, written once a session into the shared folder and read by every query that
    measures it. The tables behind it are taken to stay as they are while the session lasts.
    """
    cases = stored(b.case_metadata(spark, sf_dir, placed=False), "graded-cases")
    status = cases.filter(F.col("status").isin(*g.GRADED_STATUSES)).select("case_id", "status")
    item_links = b.item_links(spark, sf_dir)
    installment_links = b.installment_links(spark, sf_dir)
    linked = g.grade_pairs(_kept_links(item_links, status), "item", tolerance)
    linked = stored_pairs(linked, "graded-items")
    parts = _kept_links(installment_links, status)
    parts = stored_pairs(g.grade_pairs(parts, "installment", tolerance), "graded-installments")
    header = g.grade_header(
        counted_headers(b.header_links(spark, sf_dir), linked, parts), tolerance
    )
    header = stored_pairs(header, "graded-headers")
    wrong = (
        g.header_wrong(header)
        .unionByName(g.linked_wrong(linked, "item"))
        .unionByName(g.linked_wrong(parts, "installment"))
    )
    return GradedRun(
        cases=cases,
        header=header,
        items=item_links,
        installments=installment_links,
        linked=linked,
        parts=parts,
        wrong=stored(wrong, "graded-wrong"),
        truth=linked.filter(F.col("t").isNotNull()).select("case_id", "row", "t.*"),
    )


def tagged_wrong(run: GradedRun) -> DataFrame:
    return tags.tag_wrong_values(run.wrong, run.header, run.linked)


def graded_cases(run: GradedRun, *, tagged: bool = False) -> DataFrame:
    wrong = tagged_wrong(run) if tagged else run.wrong
    return g.grade_cases(run.cases, wrong, run.header)
