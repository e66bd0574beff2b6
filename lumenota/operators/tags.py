"""Failure tags: every wrong value gets exactly one, by the first rule of an ordered list.

The facts a rule reads about other rows of a case come from one table of linked rows: amounts that
meet on (case, column, amount) in one pass, the last matched row per case, and the true cells whose
values were copied. Each is joined to the wrong values once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenota.functions.numbers import significant_digits
from lumenota.functions.text import (
    digit_text,
    edit_class,
    normalize_id,
    normalize_name,
    text_ratio_at_least,
)
from lumenota.operators.grading import NUMERIC_COLUMNS, TEXT_COLUMNS
from lumenota.operators.rules import each_found

TAGS_VERSION = "failure-tags-1"
# The tags in rule order; a tag's rule number is its position.
TAG_ORDER = (
    "schema_invalid",
    "party_swap",
    "merged_rows",
    "split_rows",
    "trailing_rows_lost",
    "dropped_row",
    "invented_row",
    "value_from_other_row",
    "value_from_other_box",
    "thousands_misparse",
    "zero_for_blank",
    "digit_transposition",
    "digit_substitution",
    "digit_count",
    "text_near_miss",
    "text_wrong",
    "tax_code_wrong",
    "date_wrong",
    "untagged",
)
UNTAGGED_RULE = len(TAG_ORDER) - 1

SUM_COLUMNS = ("total", "quantity")
OTHER_ROW_COLUMNS = (
    "code", "description", "ncm", "quantity", "unit_price", "total", "icms_base", "icms_amount",
    "ipi_amount",
)
HEADER_ID_PATHS = (
    "access_key", "issuer.cnpj", "recipient.tax_id", "issuer.ie", "recipient.ie", "number",
    "series",
)
ITEM_ID_COLUMNS = ("ncm", "cst_csosn", "cfop", "code")
TAX_CODE_COLUMNS = ("cst_csosn", "cfop", "ncm")
HEADER_NEAR_MISS_PATHS = ("operation_nature", "issuer.name", "recipient.name")
ITEM_NEAR_MISS_COLUMNS = ("code", "description", "unit")
HEADER_TEXT_ONLY_PATHS = ("issuer.uf", "recipient.uf", "recipient.tax_id_kind")

FACT_KEYS = ("case_id", "event_key", "line", "column")
FACTS = ("merged", "split")
_AMOUNT = "decimal(38,4)"


# --- facts about other rows -------------------------------------------------------------------


def _movements(linked: DataFrame) -> DataFrame:
    """Totals and quantities that could have moved between rows: ``case_id, line, column, kind,
    amount``. A matched cell whose true value is not zero has *grown* by its gap and *shrunk* by the
    opposite; a missing row has *lost* its amount and an extra row has *gained* one.
    """
    t, p = F.col("t"), F.col("p")
    cells = []
    for name in SUM_COLUMNS:
        true, read = t[name].cast(_AMOUNT), p[name].cast(_AMOUNT)
        gap = F.when(true != 0, read - true)
        for kind, amount in (
            (F.when(p.isNull(), "lost").when(t.isNotNull(), "grown"), F.when(p.isNull(), true).otherwise(gap)),
            (F.when(t.isNull(), "gained").when(p.isNotNull(), "shrunk"), F.when(t.isNull(), read).otherwise(-gap)),
        ):
            parts = (F.lit(name).alias("column"), kind.alias("kind"), amount.cast(_AMOUNT).alias("amount"))
            cells.append(F.struct(*parts))
    listed = linked.select("case_id", F.col("row").alias("line"), F.inline(F.array(*cells)))
    return listed.filter(F.col("kind").isNotNull() & (F.col("amount") != 0))


def moved_rows(linked: DataFrame) -> DataFrame:
    """Movements that meet another of equal amount in their case and column, with ``fact``.

    *merged*: a cell has grown by a missing row's amount; *split*: it has shrunk by an extra row's.
    """
    meets = Window.partitionBy("case_id", "column", "amount")
    seen = lambda kind: F.max(F.col("kind") == kind).over(meets)
    facts = (
        _movements(linked)
        .withColumns({kind: seen(kind) for kind in ("grown", "lost", "shrunk", "gained")})
        .withColumn(
            "fact",
            F.when(F.col("kind").isin("grown", "lost") & F.col("grown") & F.col("lost"), "merged").when(
                F.col("kind").isin("shrunk", "gained") & F.col("shrunk") & F.col("gained"), "split"
            ),
        )
    )
    return facts.filter(F.col("fact").isNotNull()).select("case_id", "line", "column", "kind", "fact")


def last_matched(linked: DataFrame) -> DataFrame:
    """Per case the last true row that is matched."""
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    return linked.filter(both).groupBy("case_id").agg(F.max("row").alias("last_row"))


def _trailing(line: Column) -> Column:
    return line > F.coalesce(F.col("last_row"), F.lit(-1))


def trailing_missing(linked: DataFrame) -> DataFrame:
    """Missing true rows after the last matched one."""
    missing = linked.filter(F.col("p").isNull()).select("case_id", F.col("row").alias("line"))
    joined = missing.join(last_matched(linked), "case_id", "left")
    return joined.filter(_trailing(F.col("line"))).select("case_id", "line")


def row_facts(linked: DataFrame) -> DataFrame:
    """The merged and split facts of item rows, one row per cell or row event."""
    moved = moved_rows(linked)
    event = F.when(F.col("kind") == "lost", "missing").when(F.col("kind") == "gained", "extra")
    return (
        moved.withColumn("event_key", F.coalesce(event, F.lit("")))
        # A row event stands on the total, whichever of its amounts moved.
        .withColumn("column", F.when(event.isNotNull(), "total").otherwise(F.col("column")))
        .groupBy(*FACT_KEYS)
        .agg(*[F.bool_or(F.col("fact") == name).alias(name) for name in FACTS])
    )


def _match_value(column: Column, value: Column) -> Column:
    """The comparable form of a cell: normalised text, or the amount at four places."""
    numeric = value.try_cast(_AMOUNT).cast("string")
    return (
        F.when(column.isin("code", "description"), normalize_name(value))
        .when(column == "ncm", normalize_id(value))
        .otherwise(numeric)
    )


def true_cell_values(truth: DataFrame, kept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``case_id, column, match_value`` of every true cell whose value can be copied; ``kept`` can tell
    by a cell's column and value which ones are wanted."""
    values = {
        name: (
            normalize_name(F.col(name))
            if name in TEXT_COLUMNS
            else normalize_id(F.col(name))
            if name == "ncm"
            else F.col(name).cast(_AMOUNT).cast("string")
        )
        for name in OTHER_ROW_COLUMNS
    }
    if kept is None:
        cells = [F.struct(F.lit(k).alias("column"), v.alias("match_value")) for k, v in values.items()]
        return truth.select("case_id", F.inline(F.array(*cells)))
    made = truth.withColumns({f"__{name}": value for name, value in values.items()})
    cells = [
        F.when(
            kept(F.lit(name), F.col(f"__{name}")),
            F.struct(F.lit(name).alias("column"), F.col(f"__{name}").alias("match_value")),
        )
        for name in OTHER_ROW_COLUMNS
    ]
    return each_found(made, ["case_id"], cells)


#: Bits that stand for the wrong cells of a case, in words of 64.
MARK_WORDS = 4


def _mark(column: Column, value: Column) -> tuple[Column, Column]:
    """The word and the bit that stand for a cell's value."""
    digest = F.xxhash64(column, value)
    word = F.shiftrightunsigned(digest, 6).bitwiseAND(F.lit(MARK_WORDS - 1).cast("bigint"))
    return word, F.call_function("shiftleft", F.lit(1).cast("bigint"), digest.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def values_from_other_rows(wrong: DataFrame, truth: DataFrame) -> DataFrame:
    """Distinct ``case_id, column, match_value`` of wrong cells that equal some true row's cell.

    A wrong cell differs from its own true row, so any true row with the value is another row. True rows
    meet a few bits that stand for their case's wrong cells; only cells whose bit is set move on to meet the
    wrong keys themselves, however many a case has.
    """
    keys = ["case_id", "column", "match_value"]
    copied = with_match_value(wrong).filter(F.col("match_value").isNotNull()).select(keys)
    word, bit = _mark(F.col("column"), F.col("match_value"))
    marks = copied.groupBy("case_id").agg(
        *[F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"__m{k}") for k in range(MARK_WORDS)]
    )
    met = truth.join(marks.hint("shuffle_hash"), "case_id")

    def marked(column: Column, value: Column) -> Column:
        word, bit = _mark(column, value)
        held = F.lit(None).cast("bigint")
        for k in range(MARK_WORDS):
            held = F.when(word == k, F.col(f"__m{k}")).otherwise(held)
        return value.isNotNull() & (held.bitwiseAND(bit) != 0)

    cells = true_cell_values(met, marked)
    return cells.join(copied.distinct(), keys, "left_semi").distinct()


def with_match_value(wrong: DataFrame) -> DataFrame:
    """Plus the comparable form of a wrong cell that could be some other true row's value, or null."""
    eligible = _item_value() & F.col("column").isin(*OTHER_ROW_COLUMNS) & ~_is_zero_text()
    value = F.when(eligible, F.col("predicted"))
    return wrong.withColumn("match_value", _match_value(F.col("column"), value))


def _is_zero_text() -> Column:
    numeric = F.col("column").isin(*NUMERIC_COLUMNS)
    return numeric & (F.col("predicted").try_cast(_AMOUNT) == 0)


# --- the rules --------------------------------------------------------------------------------


def _numeric() -> Column:
    column, path = F.col("column"), F.col("path")
    return F.col("event").isNull() & (
        F.when(F.col("scope") == "item", column.isin(*NUMERIC_COLUMNS))
        .when(F.col("scope") == "installment", column == "amount")
        .otherwise(path.startswith("totals."))
    )


def _id_like() -> Column:
    return F.col("event").isNull() & (
        F.when(F.col("scope") == "item", F.col("column").isin(*ITEM_ID_COLUMNS))
        .when(F.col("scope") == "installment", F.col("column") == "number")
        .otherwise(F.col("path").isin(*HEADER_ID_PATHS))
    )


def _near_miss_text() -> Column:
    return F.col("event").isNull() & (
        F.when(F.col("scope") == "item", F.col("column").isin(*ITEM_NEAR_MISS_COLUMNS))
        .when(F.col("scope") == "header", F.col("path").isin(*HEADER_NEAR_MISS_PATHS))
        .otherwise(F.lit(False))
    )


def _text_only() -> Column:
    return (
        F.col("event").isNull()
        & (F.col("scope") == "header")
        & F.col("path").isin(*HEADER_TEXT_ONLY_PATHS)
    )


def _both_text() -> Column:
    return F.col("predicted").isNotNull() & F.col("expected").isNotNull()


def _item_value() -> Column:
    return (F.col("scope") == "item") & F.col("event").isNull()


def with_comparable(wrong: DataFrame) -> DataFrame:
    """The columns the value rules compare, each computed once: numbers, digits and names."""
    kinds = wrong.withColumns(
        {
            "numeric": F.coalesce(_numeric(), F.lit(False)),
            "id_like": F.coalesce(_id_like(), F.lit(False)),
            "near_text": F.coalesce(_near_miss_text() & _both_text(), F.lit(False)),
        }
    )
    numbers = kinds.withColumns(
        {
            f"n_{side}": F.when(F.col("numeric"), F.col(side).try_cast("decimal(38,10)"))
            for side in ("predicted", "expected")
        }
    )
    digits = numbers.withColumns(
        {
            f"d_{side}": F.when(
                F.col("id_like") | F.col(f"n_{side}").isNotNull(), digit_text(F.trim(F.col(side)))
            )
            for side in ("predicted", "expected")
        }
        | {
            f"name_{side}": normalize_name(F.when(F.col("near_text"), F.col(side)))
            for side in ("predicted", "expected")
        }
    )
    return digits.withColumns(
        {
            "edit": edit_class(F.col("d_predicted"), F.col("d_expected")),
            "near": text_ratio_at_least(F.col("name_predicted"), F.col("name_expected")),
        }
    )


COMPARABLE = (
    "numeric", "id_like", "near_text", "n_predicted", "n_expected", "d_predicted", "d_expected",
    "name_predicted", "name_expected", "edit", "near",
)


def _thousands() -> Column:
    predicted, expected = F.col("n_predicted"), F.col("n_expected")
    same = significant_digits(predicted) == significant_digits(expected)
    return (predicted != 0) & (predicted != expected) & same


def _date_wrong() -> Column:
    column, path = F.col("column"), F.col("path")
    return F.col("event").isNull() & (
        F.when(F.col("scope") == "installment", column == "due_date").otherwise(
            (F.col("scope") == "header") & (path == "issue_date")
        )
    )


PREDICATES: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("schema_invalid", lambda: F.col("status") == "schema_invalid"),
    ("party_swap", lambda: F.col("crossover") & F.col("of_party")),
    ("merged_rows", lambda: (F.col("scope") == "item") & F.col("merged")),
    ("split_rows", lambda: (F.col("scope") == "item") & F.col("split")),
    ("trailing_rows_lost", lambda: (F.col("scope") == "item") & F.col("trailing")),
    ("dropped_row", lambda: F.col("event") == "missing"),
    ("invented_row", lambda: F.col("event") == "extra"),
    ("value_from_other_row", lambda: F.col("other_row")),
    ("value_from_other_box", lambda: F.col("other_box")),
    ("thousands_misparse", _thousands),
    ("zero_for_blank", lambda: (F.col("n_predicted") == 0) & (F.col("n_expected") != 0)),
    ("digit_transposition", lambda: F.col("edit") == "transposition"),
    ("digit_substitution", lambda: F.col("edit") == "substitution"),
    ("digit_count", lambda: F.col("edit") == "count"),
    ("text_near_miss", lambda: F.col("near_text") & F.col("near")),
    ("text_wrong", lambda: (_near_miss_text() | _text_only()) & _both_text()),
    ("tax_code_wrong", lambda: _item_value() & F.col("column").isin(*TAX_CODE_COLUMNS)),
    ("date_wrong", _date_wrong),
    ("untagged", lambda: F.lit(True)),
)
#: The tags told by a value alone; those before them need facts of the case and of other rows.
VALUE_TAGS = TAG_ORDER[TAG_ORDER.index("value_from_other_box") :]
FACT_TAGS = TAG_ORDER[: len(TAG_ORDER) - len(VALUE_TAGS)]
ROW_EVENT_TAGS = (
    "schema_invalid", "merged_rows", "split_rows", "trailing_rows_lost", "dropped_row",
    "invented_row",
)


def first_rule(only: tuple[str, ...] | None = None) -> Column:
    """The number of the first rule that matches, over columns and facts of a wrong value."""
    chain = None
    for number, (tag, predicate) in enumerate(PREDICATES):
        if only is not None and tag not in only:
            continue
        hit = F.coalesce(predicate(), F.lit(False))
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return chain


def tag_name(rule: Column) -> Column:
    return F.element_at(F.array(*[F.lit(tag) for tag in TAG_ORDER]), rule + 1)


def _keyed(
    wrong: DataFrame, header: DataFrame, linked: DataFrame, copied: DataFrame | None = None
) -> DataFrame:
    """Wrong values with the case facts and the row facts; with ``copied`` also whether a cell's
    ``match_value`` is some other true row's.

    The few facts are put among the wrong values, which are hashed by their case once; each fact is spread
    over its rows in place.
    """
    line = F.when(F.col("scope") == "item", F.coalesce("row", "predicted_row"))
    keyed = wrong.withColumns(
        {"event_key": F.coalesce("event", F.lit("")), "line": F.coalesce(line, F.lit(-1))}
    )
    known = {"__fact": F.lit(True)}
    rows = keyed.unionByName(row_facts(linked).withColumns(known), True)
    spread = {name: F.max(name).over(Window.partitionBy(*FACT_KEYS)) for name in FACTS}
    if copied is not None:
        rows = rows.unionByName(copied.withColumns(known | {"other_row": F.lit(True)}), True)
        same = Window.partitionBy("case_id", "column", "match_value")
        spread["other_row"] = F.max("other_row").over(same)
    met = rows.repartition("case_id").withColumns(spread)
    joined = (
        met.filter(F.col("__fact").isNull())
        .join(header.select("case_id", "status", "crossover"), "case_id", "left")
        .join(last_matched(linked), "case_id", "left")
    )
    trailing = (F.col("event") == "missing") & (F.col("scope") == "item") & _trailing(F.col("line"))
    # Facts of no case belong to no row.
    flags = {
        name: F.coalesce(F.col(name) & F.col("case_id").isNotNull(), F.lit(False))
        for name in (*spread, "crossover")
    }
    flags["trailing"] = F.coalesce(trailing, F.lit(False))
    return joined.withColumns(flags).drop("event_key", "line", "last_row", "__fact")


def _is_count() -> Column:
    counts = (F.col("scope") == "header") & F.col("column").isin("item_count", "installment_count")
    return counts & ~F.coalesce(F.col("status") == "schema_invalid", F.lit(False))


def _event_place() -> Column:
    """Missing rows in order, then extra rows in order."""
    rank = F.when(F.col("event") == "missing", 0).otherwise(1)
    return F.struct(rank, F.coalesce("row", "predicted_row"))


def _count_field() -> Column:
    """The count field that a row event explains."""
    return F.when(F.col("event").isNotNull(), F.concat("scope", F.lit("_count")))


def first_event_rules(keyed: DataFrame) -> DataFrame:
    """Per case and count field the rule of the first row event: missing rows, then extra rows."""
    return (
        keyed.filter(F.col("event").isNotNull())
        .withColumn("rule", first_rule(ROW_EVENT_TAGS))
        .groupBy("case_id", _count_field().alias("column"))
        .agg(F.min_by("rule", _event_place()).alias("event_rule"))
    )


def with_value_rule(wrong: DataFrame) -> DataFrame:
    """Plus ``value_rule``, the first rule that a value alone tells, and whether it is a party's: what
    is compared for it need not move with the row."""
    of_party = F.col("path").rlike(r"\A(issuer|recipient)\.")
    ruled = with_comparable(wrong).withColumns({"value_rule": first_rule(VALUE_TAGS), "of_party": of_party})
    return ruled.drop(*COMPARABLE, "other_box")


def tag_values(joined: DataFrame) -> DataFrame:
    """Wrong values plus ``rule`` and ``tag``; a count takes the tag of its first row event.

    Counts meet the row events they inherit from in a window of the case's count fields, where the rows
    lie since they got their facts.
    """
    count_field = F.when(_is_count(), F.col("column")).otherwise(_count_field())
    meets = Window.partitionBy("case_id", "count_field")
    event_rule = F.when(F.col("event").isNotNull(), first_rule(ROW_EVENT_TAGS))
    place = F.when(F.col("event").isNotNull(), _event_place())
    inherited = F.min_by("event_rule", "place").over(meets)
    ruled = joined.withColumns(
        {"count_field": count_field, "event_rule": event_rule, "place": place}
    ).withColumn("inherited", inherited)
    own = F.coalesce(first_rule(FACT_TAGS), F.col("value_rule"))
    rule = F.when(_is_count(), F.coalesce("inherited", F.lit(UNTAGGED_RULE))).otherwise(own)
    dropped = (
        *FACTS, "trailing", "other_row", "crossover", "status", "event_rule", "count_field", "place",
        "inherited", "value_rule", "of_party", "match_value",
    )
    tagged = ruled.withColumn("rule", rule)
    return tagged.withColumn("tag", tag_name(F.col("rule"))).drop(*dropped)


def tag_wrong_values(wrong: DataFrame, header: DataFrame, linked: DataFrame) -> DataFrame:
    """All wrong values with their tag: facts from the linked item rows, then the ordered rules.

    ``linked`` has ``case_id, row, t, p`` of every item row (see ``grading.linked_rows``) and is read
    three times; it should be a stored table.
    """
    truth = linked.filter(F.col("t").isNotNull()).select("case_id", "t.*")
    copied = values_from_other_rows(wrong, truth)
    valued = with_match_value(with_value_rule(wrong))
    return tag_values(_keyed(valued, header, linked, copied))
