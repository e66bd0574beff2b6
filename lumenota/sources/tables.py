"""Manifests, labels, prices, run state, decision cases, policy and file digests."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.functions.identifiers import valid_case_id
from lumenota.sources.records import typed_invoice

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFEST_SCHEMA = """
dataset string, dataset_version string, as_of_date string, master_seed bigint,
quota_sha256 string, ci_subset array<string>,
cases array<struct<case_id:string,xml:string,xml_sha256:string,pdf:string,pdf_sha256:string,
  pages:int,tags:array<string>,
  expected:struct<item_count:int,installment_count:int,invoice_total:string,issuer_cnpj:string,
    recipient_tax_id:string,recipient_tax_id_kind:string,regime:string>,
  split:string,base_case:string,rendering:string,severity:string,barcode_readable:boolean>>
"""
LABEL_SCHEMA = """
labelling_version string,
cases array<struct<case_id:string,decision:string,cause:string,rule:int>>
"""
RUN_STATES = ("usable", "missing", "damaged")
HELD_OUT_SPLIT = "test"


class SelectionRefused(ValueError):
    """The chosen cases may not be run."""


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def manifest_cases(raw: DataFrame) -> DataFrame:
    """One row per case of the manifests in column ``value``; absent members stay null, a null base
    case is the case."""
    cases = raw.select(F.from_json("value", MANIFEST_SCHEMA).alias("m")).select(F.inline("m.cases"))
    cases = cases.filter(F.col("case_id").isNotNull())
    return cases.withColumn("base_case", F.coalesce("base_case", "case_id"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a manifest file."""
    return manifest_cases(_texts(spark, path))


def label_rows(raw: DataFrame) -> DataFrame:
    """Expected decisions of the label texts in column ``value``; entries without a case, decision
    or cause are kept apart by ``usable``."""
    rows = raw.select(F.from_json("value", LABEL_SCHEMA).alias("m"))
    rows = rows.select("m.labelling_version", F.inline("m.cases"))
    usable = (
        F.col("case_id").isNotNull() & F.col("decision").isNotNull() & F.col("cause").isNotNull()
    )
    return rows.withColumn("usable", usable)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The expected decisions of a label file."""
    return label_rows(_texts(spark, path))


def price_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(prices, aliases)`` of the price texts in column ``value``: one row per model with its
    decimal rates, one per alias."""
    rates = ("input", "cache_write_5m", "cache_write_1h", "cache_read", "output")
    packed = ",".join(f"{rate}:string" for rate in rates)
    schema = f"pricing_version string, models map<string,struct<{packed}>>, aliases map<string,string>"
    rows = raw.select(F.from_json("value", schema).alias("m")).select("m.*")
    prices = rows.select("pricing_version", F.explode("models").alias("model", "r"))
    decimals = [F.col(f"r.{rate}").try_cast("decimal(10,4)").alias(rate) for rate in rates]
    aliases = rows.select(F.explode("aliases").alias("alias", "target"))
    return prices.select("pricing_version", "model", *decimals), aliases


def read_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The prices and aliases of a price file."""
    return price_rows(_texts(spark, path))


def run_state_columns(text: str) -> dict[str, Column]:
    """``case_ids, stopped_reason, problem`` of a run-state text; one without a list is damaged."""
    tree = F.try_parse_json(text)
    listed = F.schema_of_variant(F.try_variant_get(tree, "$.case_ids", "variant"))
    usable = F.coalesce(listed.startswith("ARRAY"), F.lit(False))
    state = F.from_json(text, "case_ids array<string>, stopped_reason string")
    problem = F.when(F.col(text).isNull(), "missing").when(~usable, "damaged")
    return {
        "case_ids": F.when(usable, state["case_ids"]).alias("case_ids"),
        "stopped_reason": F.when(usable, state["stopped_reason"]).alias("stopped_reason"),
        "problem": problem.alias("problem"),
    }


def run_state(texts: DataFrame, text: str = "value") -> DataFrame:
    return texts.select(*run_state_columns(text).values())


def read_run_state(spark: SparkSession, path: str) -> DataFrame:
    """The state row of a run folder's state file; a missing file is one row ``missing``."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(location):
        return run_state(spark.range(1).select(F.lit(None).cast("string").alias("value")))
    return run_state(spark.read.text(path, wholetext=True))


def read_decision_cases(spark: SparkSession, path: str) -> DataFrame:
    """The decision cases of a folder of case files, one file each; a bad case id is an error."""
    return decision_cases(spark.read.text(path, wholetext=True))


def decision_cases(raw: DataFrame) -> DataFrame:
    """``case_id, extraction_status, tax_id, has_warning, invoice_total, invoice`` per case text."""
    head = F.from_json(
        "value",
        "case_id string, extraction struct<status:string>, "
        "findings array<struct<rule_id:string,severity:string>>",
    )
    body = F.get_json_object("value", "$.invoice")
    rows = raw.select(head.alias("h"), F.when(body.isNotNull(), typed_invoice(body)).alias("invoice"))
    rows = rows.select(
        "h.case_id",
        F.col("h.extraction.status").alias("extraction_status"),
        F.col("invoice.recipient.tax_id").alias("tax_id"),
        F.coalesce(
            F.exists("h.findings", lambda found: found["severity"] == "warning"), F.lit(False)
        ).alias("has_warning"),
        F.col("invoice.totals.invoice_total").alias("invoice_total"),
        "invoice",
    )
    named = F.coalesce(F.col("case_id"), F.lit("(none)"))
    refuse = F.raise_error(F.concat(F.lit("not a decision case id: "), named))
    valid = F.coalesce(valid_case_id(F.col("case_id")), F.lit(False))
    return rows.withColumn("case_id", F.when(valid, F.col("case_id")).otherwise(refuse))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """The one-row policy."""
    raw = _json(spark, path, "buyer_cnpj string, approval_limit string")
    return raw.withColumn("approval_limit", F.col("approval_limit").try_cast("decimal(18,2)"))


#: What Hadoop unpacks by a file's name, and the mark it leaves out at the start of a text.
PACKED_NAME = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst)\z"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a file from its lines, which come in order; only the running digests are held.

    Neither the end of the last line nor a mark at the start is among the lines: the file's length tells.
    """

    def closed() -> pa.RecordBatch:
        missing = length - seen
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{file}: its lines are {missing} bytes short")
        digest = digests[missing >= 3]
        digest.update(b"\n" * (missing % 3))
        return pa.RecordBatch.from_pydict({"file": [file], "sha256": [digest.hexdigest()]})

    file, length, seen, digests = None, 0, 0, ()
    for batch in batches:
        files, lines = batch.column("file"), batch.column("line").to_pylist()
        starts = [0] if batch.num_rows else []
        if batch.num_rows and files[0] != files[-1]:
            names = files.to_pylist()
            starts += [k for k in range(1, len(names)) if names[k] != names[k - 1]]
        for first, last in zip(starts, [*starts[1:], batch.num_rows], strict=False):
            text, name = b"\n".join(lines[first:last]), files[first].as_py()
            if name == file:
                text = b"\n" + text
            else:
                if file is not None:
                    yield closed()
                file, length, seen = name, batch.column("length")[first].as_py(), 0
                digests = hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)
            seen += len(text)
            for digest in digests:
                digest.update(text)
    if file is not None:
        yield closed()


def content_hash(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file, of any length.

    The bytes are read as lines, split by split; the lines of a file are put in order in one partition
    and pass through its digest there. Packed files, which would be unpacked, are read whole.
    """
    meta = F.col("_metadata")
    known = spark.read.format("binaryFile").load(path)
    files = known.select("path", "length", meta["file_path"].alias("file"))
    packed = meta["file_path"].rlike(PACKED_NAME)
    lines = spark.read.format("text").option("lineSep", "\n").load(path).filter(~packed)
    lines = lines.select(
        meta["file_path"].alias("file"), meta["file_size"].alias("length"),
        meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("line"),
    )
    ordered = lines.repartition("file").sortWithinPartitions("file", "block", "place")
    hashed = ordered.mapInArrow(_digests, "file string, sha256 string")
    whole = known.filter(packed).select(
        meta["file_path"].alias("file"), F.sha2("content", 256).alias("sha256")
    )
    # A file without a line has the mark alone; Spark lists no empty files.
    alone = F.lit(hashlib.sha256(BYTE_ORDER_MARK).hexdigest())
    joined = files.join(hashed.unionByName(whole), "file", "left")
    return joined.select("path", "length", F.coalesce("sha256", alone).alias("sha256"))


def table_diff(fresh: DataFrame, committed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that are missing, extra or different by key, compared by a digest of the rest."""
    rest = [name for name in fresh.columns if name not in key]
    digest = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    left = fresh.select(*key, digest.alias("fresh"))
    right = committed.select(*key, digest.alias("committed"))
    joined = left.join(right, list(key), "full_outer")
    problem = (
        F.when(F.col("fresh").isNull(), "missing")
        .when(F.col("committed").isNull(), "extra")
        .when(F.col("fresh") != F.col("committed"), "different")
    )
    return joined.select(*key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def unknown_ids(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("case_id").join(manifest.select("case_id"), "case_id", "left_anti")


def select_cases(
    manifest: DataFrame, *, split: str | None = None, wanted: DataFrame | None = None,
    allow_test: bool = False,
) -> DataFrame:
    """The manifest rows of a split and of wanted ids.

    Unknown ids, an empty selection and held-out cases (unless allowed) raise before anything runs.
    """
    chosen = manifest if split is None else manifest.filter(F.col("split") == split)
    if wanted is not None:
        unknown = unknown_ids(chosen, wanted).take(3)
        if unknown:
            listed = ", ".join(row.case_id for row in unknown)
            raise SelectionRefused(f"unknown case id(s): {listed}")
        chosen = chosen.join(wanted.select("case_id").distinct(), "case_id", "left_semi")
    if not chosen.take(1):
        raise SelectionRefused("no case is selected")
    if not allow_test:
        held_out = chosen.filter(F.col("split") == HELD_OUT_SPLIT).take(1)
        if held_out:
            raise SelectionRefused("a selected case belongs to the held-out test split")
    return chosen
