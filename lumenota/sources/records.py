"""Run records, strict invoice texts and the append-only run files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.functions import identifiers as ids
from lumenota.functions.numbers import full_match, parse_fixed
from lumenota.operators.ordering import latest_per_key
from lumenota.operators.rules import INSTALLMENT_FIELDS, ITEM_FIELDS, ITEM_TEXT, TOTAL_FIELDS

USAGE = ",".join(
    f"{name}:bigint"
    for name in (
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens",
        "cache_write_1h_tokens",
    )
)
FINDING = "struct<field:string,rule_id:string,expected:string,actual:string,severity:string>"
RECORD_SCHEMA = f"""
record_version int, run_id string, case_id string, status string,
request struct<pdf_sha256:string,reference_date:string,trace_id:string,
  overrides:map<string,string>>,
http struct<status:int,wall_ms:int,error:string,error_type:string>,
response struct<contract_version:string,case_id:string,trace_id:string,
  effective:struct<model:string,prompt_version:string,repair_prompt_version:string,
    schema_sha256:string,pricing_version:string,reference_date:string,cache_mode:string,
    replicate_salt:string,max_repairs:int>,
  outcome:struct<status:string,invoice:string,findings:array<{FINDING}>,
    failure:struct<kind:string>,raw_output:string>,
  attempts:array<struct<index:int,kind:string,prompt_version:string,status:string,
    raw_output:string,findings:array<{FINDING}>,usage:struct<{USAGE}>,cost_usd:string,
    cost_warning:string,latency_ms:bigint,stop_reason:string,model_returned:string,
    http_attempts:int,cache:struct<mode:string,status:string,key:string,stored:boolean>,
    incurred_cost_usd:string>>,
  usage:struct<{USAGE}>,cost_usd:string,cost_warning:string,incurred_cost_usd:string,
  latency_ms:bigint,stop_reason:string,model_returned:string>
"""


class BadRecord(ValueError):
    """A line of a run file that is not a run record."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, size, line``: the lines of run files in file order."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("line"),
    )


def parse_records(lines: DataFrame, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Lines with their parsed ``record`` and the ``reason`` a line is none; blank lines go."""
    record = F.from_json("line", schema)
    tree = F.try_parse_json("line")
    listed = F.json_object_keys("line")
    reason = (
        F.when(tree.isNull(), "invalid JSON")
        .when(listed.isNull(), "not a JSON object")
        .when(~F.schema_of_variant(F.try_variant_get(tree, "$.case_id", "variant")).eqNullSafe(
            "STRING"), "no string case_id")
        .when(~ids.valid_record_id(record["case_id"]),
              "case_id has characters outside A-Z a-z 0-9 . _ -")
    )
    kept = lines.filter(F.trim("line") != "")
    return kept.withColumns({"record": record, "reason": reason})


def bad_files(lines: DataFrame) -> DataFrame:
    """Files with a bad line that is not a torn end: ``file`` and the ``reason`` of its first.

    A torn end is bad JSON in the last line of a file without a final newline. Whether there is one
    follows from the file's size against its lines, with or without a leading byte order mark.
    """
    parsed = parse_records(lines)
    bad = F.col("reason").isNotNull()
    place = F.struct("block", "place")
    found = parsed.groupBy("file").agg(
        F.count_if(bad).alias("n"),
        F.min_by("reason", F.when(bad, place)).alias("reason"),
        F.max_by("reason", place).alias("last"),
    )
    sizes = lines.groupBy("file").agg(
        (F.max("size") - F.sum(F.octet_length("line") + 1)).alias("rest")
    )
    torn = (F.col("n") == 1) & F.col("last").eqNullSafe("invalid JSON") & F.col("rest").isin(-1, 2)
    return found.filter("n > 0").join(sizes, "file").filter(~torn).select("file", "reason")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of every case of a run folder or file.

    A file's torn last line (bad JSON in a file without a final newline) is left out; any other bad
    line of any file raises ``BadRecord``.
    """
    lines = read_lines(spark, path)
    first = bad_files(lines).orderBy("file").first()
    if first is not None:
        raise BadRecord(f"{first.file}: a line is not a run record ({first.reason})")
    good = parse_records(lines).filter(F.col("reason").isNull())
    rows = good.select("record.*", "file", "block", "place")
    return latest_per_key(rows, ["case_id"], ["file", "block", "place"])


def append_records(df: DataFrame, path: str) -> None:
    """Append records durably, one JSON line each."""
    df.write.mode("append").json(path)


# --- strict invoice texts ---------------------------------------------------------------------


def _shape(members: dict[str, str]) -> str:
    return "OBJECT<" + ", ".join(f"{name}: {members[name]}" for name in sorted(members)) + ">"


_PARTY = {
    "issuer": ("cnpj", "name", "ie", "uf"),
    "recipient": ("tax_id", "tax_id_kind", "name", "ie", "uf"),
}
_TOP = {
    "access_key": "STRING", "number": "BIGINT", "series": "BIGINT", "issue_date": "STRING",
    "operation_nature": "STRING",
}
_TOP_MEMBERS = (*_TOP, "issuer", "recipient", "items", "totals", "installments")

INVOICE_TEXT_SCHEMA = (
    "access_key string, number bigint, series bigint, issue_date string, operation_nature string, "
    "issuer struct<cnpj:string,name:string,ie:string,uf:string>, "
    "recipient struct<tax_id:string,tax_id_kind:string,name:string,ie:string,uf:string>, "
    f"items array<struct<{','.join(f'{name}:string' for name in ITEM_FIELDS)}>>, "
    f"totals struct<{','.join(f'{name}:string' for name in TOTAL_FIELDS)}>, "
    f"installments array<struct<{','.join(f'{name}:string' for name in INSTALLMENT_FIELDS)}>>"
)


def _typed(tree: Column, path: str, kind: str) -> Column:
    """A violation unless the member at ``path`` has exactly the type."""
    found = F.schema_of_variant(F.try_variant_get(tree, f"$.{path}", "variant"))
    return F.when(~found.eqNullSafe(kind), F.lit(path))


def _element_shapes(elements: Column, list_name: str, fields: tuple[str, ...]) -> Column:
    """The paths of list elements (JSON texts) whose member set or types are wrong."""
    expected = _shape(dict.fromkeys(fields, "STRING"))

    def wrong(element: Column, i: Column) -> Column:
        found = F.schema_of_variant(F.try_parse_json(element))
        return F.when(
            ~found.eqNullSafe(expected),
            F.concat(F.lit(f"{list_name}["), i.cast("string"), F.lit("]")),
        )

    return F.coalesce(
        F.array_compact(F.transform(elements, wrong)), F.array(F.lit(list_name))
    )


def _pattern(value: Column, pattern: str, path: Column | str) -> Column:
    name = F.lit(path) if isinstance(path, str) else path
    return F.when(~F.coalesce(full_match(value, pattern), F.lit(False)), name)


def _day(value: Column, path: Column | str) -> Column:
    name = F.lit(path) if isinstance(path, str) else path
    shaped = full_match(value, "[0-9]{4}-[0-9]{2}-[0-9]{2}") & value.try_cast("date").isNotNull()
    return F.when(~F.coalesce(shaped, F.lit(False)), name)


_SCALES = {"quantity": 4, "unit_price": 4}


def _amount(value: Column, name: str, path: Column | str) -> Column:
    label = F.lit(path) if isinstance(path, str) else path
    scale = _SCALES.get(name, 2)
    signed = scale == 2 and not name.endswith("_rate")
    precision = 9 if name.endswith("_rate") else 18
    return F.when(parse_fixed(value, scale, signed=signed, precision=precision).isNull(), label)


def _item_leaves(item: Column, i: Column) -> Column:
    def at(name: str) -> Column:
        return F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{name}"))

    return F.array_compact(
        F.array(
            _pattern(item["ncm"], ids.NCM_PATTERN, at("ncm")),
            _pattern(item["cst_csosn"], ids.TAX_CODE_PATTERN, at("cst_csosn")),
            _pattern(item["cfop"], ids.CFOP_PATTERN, at("cfop")),
            *[
                _amount(item[name], name, at(name))
                for name in ITEM_FIELDS
                if name not in ITEM_TEXT
            ],
        )
    )


def _installment_leaves(part: Column, i: Column) -> Column:
    def at(name: str) -> Column:
        return F.concat(F.lit("installments["), i.cast("string"), F.lit(f"].{name}"))

    return F.array_compact(
        F.array(_day(part["due_date"], at("due_date")), _amount(part["amount"], "amount", at("amount")))
    )


def _read_text(raw: Column) -> Column:
    """A text read once in every form the checks need."""

    def elements(name: str) -> Column:
        return F.from_json(F.get_json_object(raw, f"$.{name}"), "array<string>").alias(name)

    return F.struct(
        F.try_parse_json(raw).alias("tree"),
        F.from_json(raw, INVOICE_TEXT_SCHEMA).alias("invoice"),
        F.json_object_keys(raw).alias("keys"),
        elements("items"),
        elements("installments"),
    )


def invoice_violations(read: Column) -> Column:
    """The paths at which a read text is not a strict invoice; values are never shown.

    Unknown, missing and mistyped members are violations of their object; malformed leaves are
    violations of their own path.
    """
    tree, invoice, keys = read["tree"], read["invoice"], read["keys"]
    members = F.array(*[F.lit(name) for name in _TOP_MEMBERS])
    top = [
        F.when(
            (F.size(F.array_except(keys, members)) > 0)
            | (F.size(F.array_except(members, keys)) > 0),
            F.lit("$"),
        ),
        *[_typed(tree, name, kind) for name, kind in _TOP.items()],
    ]
    for party, names in _PARTY.items():
        shapes = [
            _shape({name: ("VOID" if name == "ie" and no_ie else "STRING") for name in names})
            for no_ie in (False, True)
        ]
        found = F.schema_of_variant(F.try_variant_get(tree, f"$.{party}", "variant"))
        top.append(F.when(~F.coalesce(found.isin(*shapes), F.lit(False)), F.lit(party)))
    top.append(_typed(tree, "totals", _shape(dict.fromkeys(TOTAL_FIELDS, "STRING"))))
    leaves = [
        _pattern(invoice["access_key"], ids.ACCESS_KEY_PATTERN, "access_key"),
        _day(invoice["issue_date"], "issue_date"),
        _pattern(invoice["issuer"]["cnpj"], ids.CNPJ_PATTERN, "issuer.cnpj"),
        _pattern(invoice["issuer"]["uf"], ids.UF_PATTERN, "issuer.uf"),
        _pattern(invoice["recipient"]["tax_id"], ids.TAX_ID_PATTERN, "recipient.tax_id"),
        _pattern(invoice["recipient"]["tax_id_kind"], "cnpj|cpf", "recipient.tax_id_kind"),
        _pattern(invoice["recipient"]["uf"], ids.UF_PATTERN, "recipient.uf"),
        *[_amount(invoice["totals"][name], name, f"totals.{name}") for name in TOTAL_FIELDS],
    ]
    none = F.array().cast("array<string>")
    inside = F.concat(
        F.array_compact(F.array(*top)),
        _element_shapes(read["items"], "items", ITEM_FIELDS),
        _element_shapes(read["installments"], "installments", INSTALLMENT_FIELDS),
        F.array_compact(F.array(*leaves)),
        F.coalesce(F.flatten(F.transform(invoice["items"], _item_leaves)), none),
        F.coalesce(F.flatten(F.transform(invoice["installments"], _installment_leaves)), none),
    )
    readable = tree.isNotNull() & keys.isNotNull()
    return F.when(readable, F.array_distinct(inside)).otherwise(F.array(F.lit("$")))


def typed_invoice(raw: Column) -> Column:
    """The typed invoice struct of a strict text (call it on valid texts only)."""
    return _typed_members(F.from_json(raw, INVOICE_TEXT_SCHEMA))


def _typed_members(invoice: Column) -> Column:

    def amount(value: Column, name: str) -> Column:
        kind = "decimal(18,4)" if name in _SCALES else "decimal(18,2)"
        return value.try_cast("decimal(9,2)" if name.endswith("_rate") else kind).alias(name)

    return F.struct(
        invoice["access_key"].alias("access_key"),
        invoice["number"].try_cast("int").alias("number"),
        invoice["series"].try_cast("int").alias("series"),
        invoice["issue_date"].try_cast("date").alias("issue_date"),
        invoice["operation_nature"].alias("operation_nature"),
        invoice["issuer"].alias("issuer"),
        invoice["recipient"].alias("recipient"),
        F.transform(
            invoice["items"],
            lambda item: F.struct(
                *[item[name].alias(name) for name in ITEM_TEXT],
                *[amount(item[name], name) for name in ITEM_FIELDS if name not in ITEM_TEXT],
            ),
        ).alias("items"),
        F.struct(*[amount(invoice["totals"][name], name) for name in TOTAL_FIELDS]).alias("totals"),
        F.transform(
            invoice["installments"],
            lambda part: F.struct(
                part["number"].alias("number"),
                part["due_date"].try_cast("date").alias("due_date"),
                amount(part["amount"], "amount"),
            ),
        ).alias("installments"),
    )


def parse_invoice(df: DataFrame, raw: str) -> DataFrame:
    """Plus ``violations``, ``parse_status`` (ok / schema_invalid) and the typed ``invoice``.

    The one-element explode reads each text once for all checks.
    """
    read = df.select("*", F.explode(F.array(_read_text(F.col(raw)))).alias("__read"))
    checked = read.withColumn("violations", invoice_violations(F.col("__read")))
    valid = F.size("violations") == 0
    return checked.withColumns(
        {
            "parse_status": F.when(valid, "ok").otherwise("schema_invalid"),
            "invoice": F.when(valid, _typed_members(F.col("__read.invoice"))),
        }
    ).drop("__read")
