"""Grading: header fields, matched rows and row events, each wrong value one narrow row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenota.functions.invoice import field_path
from lumenota.functions.numbers import within
from lumenota.functions.text import same_id, same_name
from lumenota.operators.rules import ITEM_FIELDS, TOTAL_FIELDS, each_found

GRADER_VERSION = "grader-1"

ITEM_COLUMNS = ITEM_FIELDS
INSTALLMENT_COLUMNS = ("number", "due_date", "amount")
TEXT_COLUMNS = frozenset({"code", "description", "unit"})
ID_COLUMNS = frozenset({"ncm", "cst_csosn", "cfop", "number"})
NUMERIC_COLUMNS = frozenset(
    {
        "quantity", "unit_price", "total", "icms_base", "icms_rate", "icms_amount", "ipi_rate",
        "ipi_amount", "amount",
    }
)
# Columns a value can be copied from inside one row.
ROW_MONEY_COLUMNS = ("quantity", "unit_price", "total", "icms_base", "icms_amount", "ipi_amount")

KINDS = {
    "item": (ITEM_COLUMNS, "items", "total"),
    "installment": (INSTALLMENT_COLUMNS, "installments", "amount"),
}

TOTAL_PATHS = tuple(f"totals.{name}" for name in TOTAL_FIELDS)
HEADER_FIELDS = (
    "access_key", "number", "series", "issue_date", "operation_nature", "issuer.cnpj",
    "issuer.name", "issuer.ie", "issuer.uf", "recipient.tax_id", "recipient.tax_id_kind",
    "recipient.name", "recipient.ie", "recipient.uf", *TOTAL_PATHS, "item_count",
    "installment_count",
)
ID_FIELDS = frozenset({"access_key", "issuer.cnpj", "recipient.tax_id"})
NAME_FIELDS = frozenset({"operation_nature", "issuer.name", "recipient.name"})
NULLABLE_ID_FIELDS = frozenset({"issuer.ie", "recipient.ie"})
COUNT_FIELDS = {"item_count": "item", "installment_count": "installment"}

OUTCOME_STATUSES = (
    "success", "validation_failed", "refused", "truncated", "schema_invalid",
    "infrastructure_failure", "harness_error",
)
GRADED_STATUSES = ("success", "validation_failed", "schema_invalid")
EXCLUDED_STATUSES = ("infrastructure_failure", "harness_error")

PAYMENT_HEADER_PATHS = (
    "access_key", "issuer.cnpj", "recipient.tax_id", "issue_date", "totals.invoice_total",
)

WRONG_COLUMNS = (
    "path", "scope", "column", "ordinal", "row", "predicted_row", "event", "expected", "predicted",
    "within_cent", "payment", "other_box",
)


def column_right(
    column: str, predicted: Column, expected: Column, tolerance: str = "0.00", *,
    unicode: bool = True,
) -> Column:
    """Whether a row value is right for its column; a null on either side is wrong."""
    if column in TEXT_COLUMNS:
        return same_name(predicted, expected, unicode=unicode)
    if column in ID_COLUMNS:
        return same_id(predicted, expected)
    if column in NUMERIC_COLUMNS:
        return F.coalesce(within(predicted, expected, tolerance), F.lit(False))
    return F.coalesce(predicted == expected, F.lit(False))


def payment_flag(scope: Column, path: Column, column: Column) -> Column:
    """Whether a wrong value moves money or says who owes whom."""
    return (
        F.when(scope == "header", path.isin(*PAYMENT_HEADER_PATHS))
        .when(scope == "item", column == "total")
        .when(scope == "installment", column.isin("due_date", "amount"))
        .otherwise(F.lit(False))
    )


def graded_status(record_status: Column, outcome_status: Column) -> Column:
    """The outcome status of a completed record, ``harness_error`` without a known outcome."""
    known = (record_status == "completed") & outcome_status.isin(*OUTCOME_STATUSES)
    return F.when(known, outcome_status).otherwise("harness_error")


# --- rows -------------------------------------------------------------------------------------


def pair_rows(truth: DataFrame, answer: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """``case_id, row, predicted_row, t, p`` of the matched pairs.

    Both joins are on (case, row), so a case with very many rows is still spread.
    """
    columns = KINDS[kind][0]
    true_side = truth.select("case_id", "row", F.struct(*columns).alias("t"))
    answer_side = answer.select(
        "case_id", F.col("row").alias("predicted_row"), F.struct(*columns).alias("p")
    )
    return pairs.join(true_side, ["case_id", "row"]).join(
        answer_side, ["case_id", "predicted_row"]
    )


def unmatched_rows(
    truth: DataFrame, answer: DataFrame, pairs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The true rows nobody answers and the answered rows nobody asked for."""
    missing = truth.join(pairs.select("case_id", "row"), ["case_id", "row"], "left_anti")
    used = pairs.select("case_id", F.col("predicted_row").alias("row"))
    return missing, answer.join(used, ["case_id", "row"], "left_anti")


def linked_rows(paired: DataFrame, missing: DataFrame, extra: DataFrame, kind: str) -> DataFrame:
    """``case_id, row, t, p`` of all rows of one list: a null ``p`` is a missing row, a null ``t`` an
    extra one (whose ``row`` is its answered place)."""
    columns = KINDS[kind][0]
    both = paired.select("case_id", "row", "t", "p")
    lost = missing.select("case_id", "row", F.struct(*columns).alias("t"))
    gained = extra.select("case_id", "row", F.struct(*columns).alias("p"))
    return both.unionByName(lost, True).unionByName(gained, True)


def _other_box(kind: str, column: str, t: Column, p: Column) -> Column:
    """Whether a wrong amount is another money column's value of the same true row."""
    if kind != "item" or column not in ROW_MONEY_COLUMNS:
        return F.lit(False)
    others = [t[other] for other in ROW_MONEY_COLUMNS if other != column]
    return F.coalesce((p[column] != 0) & p[column].isin(*others), F.lit(False))


def grade_pairs(
    paired: DataFrame, kind: str, tolerance: str = "0.00", *, unicode: bool = True
) -> DataFrame:
    """Matched pairs with one ``right_<column>`` boolean per column."""
    columns = KINDS[kind][0]
    t, p = F.col("t"), F.col("p")
    needs_unicode = {"description"} if unicode else set()
    return paired.withColumns(
        {
            f"right_{column}": column_right(
                column, p[column], t[column], tolerance, unicode=column in needs_unicode
            )
            for column in columns
        }
    )


def _cells(kind: str, when: Column | None = None) -> list[Column]:
    """Per column the wrong cell of a pair, or null where it is right."""
    columns, list_name, _ = KINDS[kind]
    t, p, row = F.col("t"), F.col("p"), F.col("row")
    cells = []
    for position, column in enumerate(columns):
        near = (
            F.coalesce(within(p[column], t[column]), F.lit(False))
            if column in NUMERIC_COLUMNS
            else F.lit(False)
        )
        wrong = ~F.col(f"right_{column}")
        cells.append(
            F.when(
                wrong if when is None else when & wrong,
                F.struct(
                    field_path(list_name, row, column).alias("path"),
                    F.lit(column).alias("column"),
                    F.lit(position).alias("ordinal"),
                    t[column].cast("string").alias("expected"),
                    p[column].cast("string").alias("predicted"),
                    near.alias("within_cent"),
                    _other_box(kind, column, t, p).alias("other_box"),
                ),
            )
        )
    return cells


def pair_wrong(graded: DataFrame, kind: str) -> DataFrame:
    """One row per wrong column of a matched pair."""
    listed = each_found(graded, ["case_id", "row", "predicted_row"], _cells(kind))
    return _wrong_shape(listed, kind, event=F.lit(None).cast("string"))


def linked_wrong(graded: DataFrame, kind: str) -> DataFrame:
    """All wrong values of one list in a single pass over linked rows.

    ``graded`` is ``grade_pairs`` of rows ``case_id, row, t, p`` where a null ``p`` is a missing and
    a null ``t`` an extra row, so cells and row events come from the same scan.
    """
    columns, list_name, anchor = KINDS[kind]
    t, p, row = F.col("t"), F.col("p"), F.col("row")
    has_true, has_answer = t.isNotNull(), p.isNotNull()
    nothing = F.lit(None).cast("string")

    def event(path: Column, expected: Column, predicted: Column) -> Column:
        return F.struct(
            path.alias("path"),
            F.lit(anchor).alias("column"),
            F.lit(0).alias("ordinal"),
            expected.alias("expected"),
            predicted.alias("predicted"),
            F.lit(False).alias("within_cent"),
            F.lit(False).alias("other_box"),
        )

    extra_path = F.concat(F.lit(f"{list_name}[+"), row.cast("string"), F.lit(f"].{anchor}"))
    missing = event(field_path(list_name, row, anchor), t[anchor].cast("string"), nothing)
    extra = event(extra_path, nothing, p[anchor].cast("string"))
    both = has_true & has_answer
    found = [
        *_cells(kind, both),
        F.when(has_true & ~has_answer, missing),
        F.when(has_answer & ~has_true, extra),
    ]
    all_right = both
    for column in columns:
        all_right = all_right & F.col(f"right_{column}")
    kept = (
        F.col("case_id"),
        F.when(has_true, row).alias("row"),
        F.when(has_answer, row).alias("predicted_row"),
        F.when(has_true & ~has_answer, "missing").when(has_answer & ~has_true, "extra").alias("event"),
    )
    listed = each_found(graded.filter(~all_right), kept, found)
    return _wrong_shape(listed, kind, event=F.col("event"))


def row_events(missing: DataFrame, extra: DataFrame, kind: str) -> DataFrame:
    """Each missing true row and each extra answered row as one wrong value on the anchor."""
    _, list_name, anchor = KINDS[kind]
    nothing = F.lit(None).cast("string")
    shared = {
        "column": F.lit(anchor),
        "ordinal": F.lit(0),
        "within_cent": F.lit(False),
        "other_box": F.lit(False),
    }
    value, row = F.col(anchor).cast("string"), F.col("row")
    lost = missing.select(
        "case_id", "row", F.lit(None).cast("int").alias("predicted_row"),
        field_path(list_name, row, anchor).alias("path"), value.alias("expected"),
        nothing.alias("predicted"), *[column.alias(name) for name, column in shared.items()],
    )
    gained = extra.select(
        "case_id", F.lit(None).cast("int").alias("row"), row.alias("predicted_row"),
        F.concat(F.lit(f"{list_name}[+"), row.cast("string"), F.lit(f"].{anchor}")).alias("path"),
        nothing.alias("expected"), value.alias("predicted"),
        *[column.alias(name) for name, column in shared.items()],
    )
    return _wrong_shape(lost, kind, event=F.lit("missing")).unionByName(
        _wrong_shape(gained, kind, event=F.lit("extra"))
    )


def _wrong_shape(df: DataFrame, kind: str, event: Column) -> DataFrame:
    shaped = df.withColumns({"scope": F.lit(kind), "event": event})
    flag = payment_flag(F.col("scope"), F.col("path"), F.col("column"))
    return shaped.withColumn("payment", flag).select("case_id", *WRONG_COLUMNS)


def row_wrong(
    truth: DataFrame, answer: DataFrame, pairs: DataFrame, kind: str, tolerance: str = "0.00"
) -> DataFrame:
    """All wrong values of one list: wrong cells, missing rows and extra rows."""
    graded = grade_pairs(pair_rows(truth, answer, pairs, kind), kind, tolerance)
    missing, extra = unmatched_rows(truth, answer, pairs)
    return pair_wrong(graded, kind).unionByName(row_events(missing, extra, kind))


def row_stats(
    cases: DataFrame, truth: DataFrame, answer: DataFrame, graded: DataFrame, kind: str
) -> DataFrame:
    """Per case the row counts, fully right rows and per-column right counts of one list.

    Three pre-aggregated groupings joined on the case; a column's ``n`` is ``matched``.
    """
    columns = KINDS[kind][0]
    all_right = F.col(f"right_{columns[0]}")
    for column in columns[1:]:
        all_right = all_right & F.col(f"right_{column}")
    matched = graded.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(all_right).alias("rows_all_correct"),
        *[F.count_if(F.col(f"right_{column}")).alias(f"correct_{column}") for column in columns],
    )
    true_rows = truth.groupBy("case_id").agg(F.count(F.lit(1)).alias("true_rows"))
    answered = answer.groupBy("case_id").agg(F.count(F.lit(1)).alias("predicted_rows"))
    joined = (
        cases.select("case_id")
        .join(true_rows, "case_id", "left")
        .join(answered, "case_id", "left")
        .join(matched, "case_id", "left")
    )
    names = [name for name in joined.columns if name != "case_id"]
    return joined.select("case_id", *[F.coalesce(name, F.lit(0)).alias(name) for name in names])


ORDER_CHUNK = 4096


def order_preserved(pairs: DataFrame) -> DataFrame:
    """Per case whether matched true rows ascend in answered order (a case with no pair is absent).

    Neighbours are compared inside chunks of answered rows and then between chunk edges, so no
    window holds a whole large case.
    """
    chunk = F.floor(F.col("predicted_row") / ORDER_CHUNK)
    inside = Window.partitionBy("case_id", "chunk").orderBy("predicted_row")
    stepped = pairs.withColumn("chunk", chunk).withColumn(
        "before", F.lag("row").over(inside)
    )
    edges = stepped.groupBy("case_id", "chunk").agg(
        F.bool_and(F.coalesce(F.col("before") < F.col("row"), F.lit(True))).alias("ascending"),
        F.min_by("row", "predicted_row").alias("first_row"),
        F.max_by("row", "predicted_row").alias("last_row"),
        F.count(F.lit(1)).alias("matched"),
    )
    between = Window.partitionBy("case_id").orderBy("chunk")
    linked = edges.withColumn("previous", F.lag("last_row").over(between))
    step = F.coalesce(F.col("previous") < F.col("first_row"), F.lit(True))
    return linked.groupBy("case_id").agg(
        F.bool_and(F.col("ascending") & step).alias("order_preserved"),
        F.sum("matched").alias("matched"),
    )


# --- header -----------------------------------------------------------------------------------


def _member(side: Column, path: str) -> Column:
    value = side
    for part in path.split("."):
        value = value[part]
    return value


def header_right(field: str, p: Column, t: Column, tolerance: str = "0.00") -> Column:
    """Whether one header field is right, by its class."""
    value, expected = _member(p, field), _member(t, field)
    if field in ID_FIELDS:
        right = same_id(value, expected)
    elif field in NULLABLE_ID_FIELDS:
        right = F.when(expected.isNull(), value.isNull()).otherwise(same_id(value, expected))
    elif field in NAME_FIELDS:
        right = same_name(value, expected)
    elif field.startswith("totals."):
        right = within(value, expected, tolerance)
    else:
        right = value == expected
    return F.coalesce(right, F.lit(False)) & p.isNotNull()


def grade_header(joined: DataFrame, tolerance: str = "0.00") -> DataFrame:
    """``joined`` (``case_id, t, p``; a null ``p`` is an unusable answer) plus ``fields``."""
    t, p = F.col("t"), F.col("p")
    flags = [
        header_right(field, p, t, tolerance).alias(field.replace(".", "__"))
        for field in HEADER_FIELDS
    ]
    return joined.withColumn("fields", F.struct(*flags))


def header_wrong(graded: DataFrame) -> DataFrame:
    """One row per header field graded wrong, in field order."""
    t, p = F.col("t"), F.col("p")
    cells = []
    for position, field in enumerate(HEADER_FIELDS):
        value, expected = _member(p, field), _member(t, field)
        near, other = F.lit(False), F.lit(False)
        if field in TOTAL_PATHS:
            near = F.coalesce(within(value, expected), F.lit(False))
            boxes = [_member(t, path) for path in TOTAL_PATHS if path != field]
            other = F.coalesce((value != 0) & value.isin(*boxes), F.lit(False))
        cells.append(
            F.when(
                ~F.col(f"fields.{field.replace('.', '__')}"),
                F.struct(
                    F.lit(field).alias("path"),
                    F.lit(field).alias("column"),
                    F.lit(position).alias("ordinal"),
                    expected.cast("string").alias("expected"),
                    value.cast("string").alias("predicted"),
                    near.alias("within_cent"),
                    other.alias("other_box"),
                ),
            )
        )
    nothing = F.lit(None).cast("int")
    listed = each_found(graded, ["case_id"], cells)
    return _wrong_shape(
        listed.withColumns({"row": nothing, "predicted_row": nothing}),
        "header",
        event=F.lit(None).cast("string"),
    )


def party_crossover(t: Column, p: Column) -> Column:
    """The issuer and recipient identity values of the answer are each other's."""

    def crosses(value: Column, own: Column, other: Column, same) -> Column:
        return same(value, other) & ~same(own, other) & own.isNotNull() & other.isNotNull()

    def by_name(left: Column, right: Column) -> Column:
        return same_name(left, right, unicode=False)

    issuer_id, recipient_id = t["issuer"]["cnpj"], t["recipient"]["tax_id"]
    issuer_name, recipient_name = t["issuer"]["name"], t["recipient"]["name"]
    found = (
        crosses(p["issuer"]["cnpj"], issuer_id, recipient_id, same_id)
        | crosses(p["recipient"]["tax_id"], recipient_id, issuer_id, same_id)
        | crosses(p["issuer"]["name"], issuer_name, recipient_name, by_name)
        | crosses(p["recipient"]["name"], recipient_name, issuer_name, by_name)
    )
    return F.coalesce(found, F.lit(False))


def join_headers(cases: DataFrame, truth: DataFrame, answer: DataFrame) -> DataFrame:
    """``case_id, status, t, p, crossover`` of the graded cases; ``p`` is null for a bad schema."""
    names = [name for name in truth.columns if name != "case_id"]
    graded = cases.filter(F.col("status").isin(*GRADED_STATUSES)).select("case_id", "status")
    joined = graded.join(
        truth.select("case_id", F.struct(*names).alias("t")), "case_id"
    ).join(answer.select("case_id", F.struct(*names).alias("p")), "case_id", "left")
    usable = joined.withColumn("p", F.when(F.col("status") != "schema_invalid", F.col("p")))
    return usable.withColumn("crossover", party_crossover(F.col("t"), F.col("p")))


# --- cases ------------------------------------------------------------------------------------


def validator_block(findings: Column) -> Column:
    """Error and warning counts and the sorted distinct rule ids of a findings array."""
    known = F.filter(
        F.coalesce(findings, F.array().cast("array<struct<rule_id:string,severity:string>>")),
        lambda found: found["severity"].isin("error", "warning"),
    )
    return F.struct(
        F.size(F.filter(known, lambda found: found["severity"] == "error")).alias("errors"),
        F.size(F.filter(known, lambda found: found["severity"] == "warning")).alias("warnings"),
        F.array_sort(
            F.array_distinct(F.array_compact(F.transform(known, lambda found: found["rule_id"])))
        ).alias("rule_ids"),
    )


def attempt_block(attempts: Column) -> Column:
    """Count, statuses, answered attempts, cache hits and summed latency of an attempts array."""
    answered = F.filter(attempts, lambda attempt: attempt["usage"].isNotNull())
    hits = F.filter(answered, lambda attempt: attempt["cache"]["status"] == "hit")
    latencies = F.filter(
        F.transform(attempts, lambda attempt: attempt["latency_ms"]), lambda ms: ms.isNotNull()
    )
    total = F.aggregate(latencies, F.lit(0).cast("bigint"), lambda acc, ms: acc + ms)
    return F.struct(
        F.when(attempts.isNotNull(), F.size(attempts)).alias("attempt_count"),
        F.transform(attempts, lambda attempt: attempt["status"]).alias("attempt_statuses"),
        F.coalesce(F.when(attempts.isNotNull(), F.size(hits)), F.lit(0)).alias("cache_hits"),
        F.coalesce(F.when(attempts.isNotNull(), F.size(answered)), F.lit(0)).alias(
            "answered_attempts"
        ),
        F.when(F.size(latencies) > 0, total).alias("model_latency_ms"),
    )


def wrong_per_case(wrong: DataFrame) -> DataFrame:
    """Per case the counts and flags of its wrong values (one pre-aggregated grouping)."""
    tagged = "tag" in wrong.columns
    extra = [F.array_sort(F.collect_set("tag")).alias("failure_tags")] if tagged else []
    return wrong.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("wrong_count"),
        F.count_if(F.col("within_cent")).alias("cent_count"),
        F.bool_or("payment").alias("payment"),
        *extra,
    )


def verdict(status: Column, wrong_count: Column) -> Column:
    """Null for excluded statuses, true only for a success without a wrong value."""
    return F.when(status.isin(*EXCLUDED_STATUSES), F.lit(None).cast("boolean")).otherwise(
        (status == "success") & (wrong_count == 0)
    )


def grade_cases(
    cases: DataFrame, wrong: DataFrame, header: DataFrame | None = None,
    parts: Sequence[DataFrame] = (),
) -> DataFrame:
    """One graded row per case: metadata, wrong counts, verdict, total delta and extra parts."""
    joined = cases.join(wrong_per_case(wrong), "case_id", "left")
    zero = {name: F.coalesce(name, F.lit(0)) for name in ("wrong_count", "cent_count")}
    joined = joined.withColumns(zero | {"payment": F.coalesce("payment", F.lit(False))})
    joined = joined.withColumn("correct", verdict(F.col("status"), F.col("wrong_count")))
    if header is not None:
        delta = (F.col("p.totals.invoice_total") - F.col("t.totals.invoice_total")).alias(
            "total_delta"
        )
        joined = joined.join(header.select("case_id", "fields", delta), "case_id", "left")
    for part in parts:
        joined = joined.join(part, "case_id", "left")
    return joined


def with_meta(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Records with their case metadata; without one the case is its own base case."""
    joined = records.join(metadata, "case_id", "left")
    return joined.withColumn(
        "base_case", F.coalesce(F.col("base_case"), F.col("case_id").cast("string"))
    )


def cases_not_run(selected: DataFrame, records: DataFrame) -> DataFrame:
    """The selected cases without a stored record."""
    return selected.join(records.select("case_id"), "case_id", "left_anti")
