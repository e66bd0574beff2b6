"""Queries over small files: manifests, labels and prices as texts, appended and published results.

The texts are built from the tables, one file's text per customer or brand, so they grow with them.
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumenota.plans import bindings as b
from lumenota.plans.registry import query
from lumenota.session import shared_folder
from lumenota.sources import records, sinks, tables

C = F.col


def _case_lists(spark, sf, **members):
    """One JSON text per customer with its orders as ``cases``."""
    orders = b.table(spark, sf, "orders")
    case = F.struct(*[value.alias(name) for name, value in members.items()])
    grouped = orders.groupBy("o_custkey").agg(F.collect_list(case).alias("cases"))
    version = C("o_custkey").cast("string")
    return grouped.select(
        F.to_json(F.struct(version.alias("labelling_version"), "cases")).alias("value")
    )


def _case_id():
    return F.concat(F.lit("o-"), C("o_orderkey").cast("string"))


@query(
    "s05_manifest_cases",
    """SELECT 'o-'||o_orderkey AS case_id, CASE WHEN o_orderstatus='F' THEN 'o-'||(o_orderkey-1)
      ELSE 'o-'||o_orderkey END AS base_case, CASE WHEN o_orderpriority<>'2-HIGH' THEN 'dev' END AS split,
      CAST(substr(o_orderpriority,1,1) AS BIGINT) AS pages, (o_totalprice*100)::BIGINT/100 AS invoice_total
      FROM orders""",
)
def manifest_cases(spark, sf):
    """Cases of manifests; splits and base cases are absent here and there."""
    base = F.concat(F.lit("o-"), (C("o_orderkey") - 1).cast("string"))
    price = C("o_totalprice").cast("decimal(18,2)").cast("string")
    texts = _case_lists(
        spark, sf, case_id=_case_id(), base_case=F.when(C("o_orderstatus") == "F", base),
        split=F.when(C("o_orderpriority") != "2-HIGH", "dev"),
        pages=F.substring("o_orderpriority", 1, 1).cast("int"),
        expected=F.struct(price.alias("invoice_total")),
    )
    total = C("expected.invoice_total").cast("decimal(18,2)").alias("invoice_total")
    return tables.manifest_cases(texts).select("case_id", "base_case", "split", "pages", total)


@query(
    "s06_labels",
    """SELECT CAST(o_custkey AS VARCHAR) AS labelling_version, 'o-'||o_orderkey AS case_id,
      CASE WHEN o_orderstatus='O' THEN 'approve' WHEN o_orderstatus='F' THEN 'escalate' END AS decision,
      CASE WHEN o_orderpriority<>'5-LOW' THEN 'none' END AS cause,
      o_orderstatus IN ('O','F') AND o_orderpriority<>'5-LOW' AS usable FROM orders""",
)
def labels(spark, sf):
    """Expected decisions of label texts; some have no decision or no cause."""
    decision = F.when(C("o_orderstatus") == "O", "approve").when(
        C("o_orderstatus") == "F", "escalate"
    )
    cause = F.when(C("o_orderpriority") != "5-LOW", "none")
    texts = _case_lists(spark, sf, case_id=_case_id(), decision=decision, cause=cause)
    return tables.label_rows(texts).select(
        "labelling_version", "case_id", "decision", "cause", "usable"
    )


def _price_texts(spark, sf):
    part = b.table(spark, sf, "part")
    rate = C("p_retailprice").cast("decimal(10,2)").cast("string")
    entry = F.struct(
        C("p_partkey").cast("string").alias("model"),
        F.struct(
            rate.alias("input"), F.when(C("p_size") > 10, "1.5").otherwise("n/a").alias("output")
        ).alias("rates"),
    )
    alias = F.struct(
        F.concat(F.lit("latest-"), C("p_partkey").cast("string")).alias("name"),
        C("p_partkey").cast("string").alias("target"),
    )
    grouped = part.groupBy("p_brand", "p_size").agg(
        F.map_from_entries(F.collect_list(entry)).alias("models"),
        F.map_from_entries(F.collect_list(alias)).alias("aliases"),
    )
    version = C("p_brand").alias("pricing_version")
    return grouped.select(F.to_json(F.struct(version, "models", "aliases")).alias("value"))


@query(
    "s07_prices",
    """SELECT p_brand AS pricing_version, CAST(p_partkey AS VARCHAR) AS model,
      (p_retailprice*100)::BIGINT/100 AS input, CASE WHEN p_size>10 THEN 1.5::DOUBLE END AS output,
      'latest-'||p_partkey AS alias FROM part""",
)
def prices(spark, sf):
    """Rates of every model beside its alias; a rate that is no number is null."""
    found, aliases = tables.price_rows(_price_texts(spark, sf))
    joined = found.join(aliases, C("model") == C("target"))
    return joined.select("pricing_version", "model", "input", "output", "alias")


@query(
    "s10_append_records",
    "SELECT 'e-'||event_id AS case_id, event_type AS status FROM events",
)
def append_records(spark, sf):
    """Events appended to a run in two goes, read back as its records."""
    folder = f"{shared_folder(spark)}/lumenota-run-{uuid.uuid4().hex}"
    events = b.table(spark, sf, "events")
    rows = events.select(
        F.concat(F.lit("e-"), C("event_id").cast("string")).alias("case_id"),
        C("event_type").alias("status"),
    )
    early = F.col("status") == "click"
    for some in (rows.filter(early), rows.filter(~early)):
        records.append_records(some, folder)
    return records.read_records(spark, folder).select("case_id", "status")


@query(
    "s11_publish_once",
    """SELECT o_orderpriority AS priority, count(*) AS orders, true AS refused FROM orders
      GROUP BY o_orderpriority""",
)
def publish_once(spark, sf):
    """A published result read back, and whether publishing it again was refused."""
    folder = f"{shared_folder(spark)}/lumenota-published-{uuid.uuid4().hex}"
    counts = b.table(spark, sf, "orders").groupBy(C("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    sinks.publish_once(counts, folder)
    try:
        sinks.publish_once(counts.limit(0), folder)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(folder).withColumn("refused", F.lit(refused))
