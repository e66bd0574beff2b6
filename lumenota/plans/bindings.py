"""Bindings of the driver's star-schema tables to invoices, answers, runs and ledgers.

Orders are invoices, line items are invoice items, and an answer is the same item with the misreading
its tax and discount values stand for. Every binding reads whole tables; misreadings are computed
columns, so nothing is filtered away to make a check cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenota.functions import identifiers as ids
from lumenota.functions.invoice import installment_split
from lumenota.functions.numbers import dec
from lumenota.operators.rules import ITEM_FIELDS, SUM_RULES, TOTAL_FIELDS, with_item_sums

UF_LIST = tuple(ids.UF_CODES)
MONEY, FINE, RATE = "decimal(18,2)", "decimal(18,4)", "decimal(9,2)"

# The misreading a line item stands for: 11 * (tax in percent) + (discount in percent).
DROPPED = (1, 12)
INVENTED, MERGED, SPLIT = 2, 23, 24
TWO_SLOTS = (INVENTED, MERGED, SPLIT)


# The tables' orders predate the electronic invoice; their dates are read twelve years later.
DATE_SHIFT_DAYS = 4383
REFERENCE_DATE = "2013-07-01"


def issue_date() -> Column:
    return F.date_add(F.col("o_orderdate").cast("date"), DATE_SHIFT_DAYS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table hashed by the key that later steps group by; they find it in place."""
    return df.repartition(key)


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


# Columns only the position of a line needs.
UNPLACED = ("l_suppkey", "l_linenumber", "l_shipdate")


def _money(col: Column) -> Column:
    return col.cast(MONEY)


def _cents_product(total: Column, rate: Column) -> Column:
    """``round(total * rate / 100, 2)`` as money."""
    return F.round(total * rate * dec("0.01", 3), 2).cast(MONEY)


KINDS = {name: "string" for name in ITEM_FIELDS} | {
    "quantity": FINE, "unit_price": FINE, "icms_rate": RATE, "ipi_rate": RATE, "total": MONEY,
    "icms_base": MONEY, "icms_amount": MONEY, "ipi_amount": MONEY,
}


def _base_fields() -> dict[str, Column]:
    """The fields of one invoice item from its line item; those of its part stand beside it."""
    total = F.col("l_extendedprice").cast(MONEY)
    ext = (total * 100).cast("bigint")
    pieces = F.col("l_quantity").cast("bigint")
    price4 = F.call_function("div", ext * 200 + pieces, pieces * 2)
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return {
        "code": F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
        "cst_csosn": F.when(flag == "A", "000")
        .when((flag == "R") & (line == "F"), "041")
        .when(flag == "R", "010")
        .when(line == "O", "0102")
        .otherwise("020"),
        "cfop": F.when(line == "O", "5102").otherwise("6102"),
        "quantity": F.col("l_quantity").cast(FINE),
        "unit_price": (price4.cast("decimal(18,0)") * dec("0.0001", 5)).cast(FINE),
        "total": total,
        "icms_rate": (F.col("l_tax") * 100).cast(RATE),
        "ipi_rate": (F.col("l_discount") * 100).cast(RATE),
    }


def _true_changes() -> dict[str, Column]:
    """The second true row of a merged pair (slot 1): a small adjunct of the first."""
    small = dec("7.50", 18)
    return {
        "code": F.concat("code", F.lit("B")),
        "description": F.concat(F.lit("adjunct "), F.col("description")),
        "quantity": dec("3.0000", 18),
        "unit_price": dec("2.5000", 18),
        "total": small,
    }


def _swapped_cents(total: Column) -> Column:
    text = total.cast("string")
    size = F.length(text)
    one = F.lit(1)
    swapped = F.concat(
        F.substring(text, F.lit(1), size - 2),
        F.substring(text, size, one),
        F.substring(text, size - 1, one),
    )
    return swapped.try_cast(MONEY)


def _answers() -> dict[str, list[tuple[Column, Column]]]:
    """Per field the misreadings (condition, answered value); no match means read right."""
    f, slot = F.col("f"), F.col("slot")
    invented = (slot == 1) & (f == INVENTED)
    other_half = (slot == 1) & (f == SPLIT)
    col = F.col
    half_quantity = F.call_function("div", (col("quantity") * 10000).cast("bigint"), F.lit(2))
    half_total = F.call_function("div", (col("total") * 100).cast("bigint"), F.lit(2))
    quantity_half = (half_quantity.cast("decimal(18,0)") * dec("0.0001", 5)).cast(FINE)
    total_half = (half_total.cast("decimal(18,0)") * dec("0.01", 3)).cast(MONEY)
    shorter = F.substring(col("description"), F.lit(1), F.length("description") - 1)
    return {
        "code": [
            (invented, F.lit("NOROW-1")),
            (f == 36, F.concat(F.lit("Q"), F.substring("code", 2, 40))),
        ],
        "description": [
            (invented, F.lit("row of no invoice")),
            (f == 38, shorter),
            (f == 39, F.lit("unreadable")),
        ],
        "ncm": [(invented, F.lit("00112233")), (f == 37, F.substring("ncm", 1, 7))],
        "cst_csosn": [(f == 40, F.lit("9999"))],
        "cfop": [(f == 50, F.lit("9999"))],
        "unit": [(invented, F.lit("CX")), (f == 41, F.lit("ZZ"))],
        "quantity": [
            (invented, dec("6.0000")),
            (other_half, col("quantity") - quantity_half),
            (f == MERGED, col("quantity") + 3),
            (f == SPLIT, quantity_half),
            (f == 3, col("quantity") * 10),
            (f.between(45, 49), dec("25.0000")),
        ],
        "unit_price": [
            (invented, dec("8.5000")),
            (f == 44, col("unit_price") + dec("2941.83")),
        ],
        "total": [
            (invented, dec("51.00")),
            (other_half, col("total") - total_half),
            (f == MERGED, col("total") + dec("7.50")),
            (f == SPLIT, total_half),
            (f == 35, _swapped_cents(col("total"))),
            (f == 43, col("total") + dec("0.01")),
        ],
        "icms_base": [(invented, dec("51.00"))],
        "icms_amount": [
            (invented | (f == 34), dec("0.00")),
            (f == 42, col("total")),
        ],
        "ipi_amount": [(f == 51, col("ipi_amount") * 100)],
    }


def _chain(choices: list[tuple[Column, Column]], otherwise: Column, kind: str) -> Column:
    chained = None
    for condition, value in choices:
        typed = value.cast(kind)
        chained = F.when(condition, typed) if chained is None else chained.when(condition, typed)
    return otherwise if chained is None else chained.otherwise(otherwise)


def item_links(spark: SparkSession, sf_dir: str, *, positions: bool = True) -> DataFrame:
    """One row per true item, answered item or both: ``case_id, pos, t, p`` (either may be null).

    ``pos`` is the printed position inside the invoice; without ``positions`` it is left out. The
    lines are hashed by their invoice once, as the narrow columns they are read from, and placed
    there by a spilling sort; ``t`` and ``p`` are made after it and stay hashed by case.
    """
    used = [name for name in LINE_COLUMNS if positions or name not in UNPLACED]
    line = table(spark, sf_dir, "lineitem").select(*used)
    kind = F.col("p_type")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"),
        F.lpad(F.col("p_size").cast("string"), 8, "0").alias("ncm"),
        F.when(kind == "ECONOMY", "UN")
        .when(kind == "PROMO", "PAR")
        .when(kind == "LARGE", "CX")
        .otherwise("KG")
        .alias("unit"),
    )
    f = F.round(F.col("l_tax") * 100).cast("int") * 11 + F.round(F.col("l_discount") * 100).cast("int")
    slots = F.when(F.col("f").isin(*TWO_SLOTS), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    read_lines = spread(line.join(part, line.l_partkey == part.p_partkey), "l_orderkey")
    placed = read_lines.withColumn("f", f).withColumn("slot", F.explode(slots))
    if positions:
        order = (
            "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "slot",
        )
        inside = Window.partitionBy("l_orderkey").orderBy(*order)
        # A line without a date takes a place but is not printed.
        placed = placed.withColumn("pos", F.row_number().over(inside) - 1)
        placed = placed.filter(F.col("l_orderkey").isNotNull() & F.col("l_shipdate").isNotNull())
    sourced = placed.withColumns(_base_fields())
    adjunct = (F.col("slot") == 1) & (F.col("f") == MERGED)
    for_true = _true_changes()
    tax = F.when(F.col("cst_csosn").isin("041", "0102"), dec("0.00", 18)).otherwise(
        _cents_product(F.col("true_total"), F.col("icms_rate"))
    )
    answers = _answers()
    first_true = {
        f"true_{name}": F.when(adjunct, for_true[name].cast(KINDS[name])).otherwise(F.col(name))
        for name in for_true
    }
    read = sourced.withColumns(first_true).withColumns(
        {
            "icms_base": F.col("total"),
            "icms_amount": F.when(
                F.col("cst_csosn").isin("041", "0102"), dec("0.00", 18)
            ).otherwise(_cents_product(F.col("total"), F.col("icms_rate"))),
            "ipi_amount": _cents_product(F.col("total"), F.col("ipi_rate")),
            "true_icms_base": F.col("true_total"),
            "true_icms_amount": tax.cast(MONEY),
            "true_ipi_amount": _cents_product(F.col("true_total"), F.col("ipi_rate")),
        }
    )
    has_true = (F.col("slot") == 0) | (F.col("f") == MERGED)
    has_answer = ((F.col("slot") == 0) & ~F.col("f").isin(*DROPPED)) | (
        (F.col("slot") == 1) & F.col("f").isin(INVENTED, SPLIT)
    )
    true_fields = [
        F.col(f"true_{name}" if f"true_{name}" in read.columns else name).alias(name)
        for name in ITEM_FIELDS
    ]
    read_fields = [
        _chain(answers.get(name, []), F.col(name), KINDS[name]).alias(name) for name in ITEM_FIELDS
    ]
    linked = read.withColumns(
        {
            "case_id": F.col("l_orderkey"),
            "t": F.when(has_true, F.struct(*true_fields)),
            "p": F.when(has_answer, F.struct(*read_fields)),
        }
    )
    return linked.select("case_id", *(["pos"] if positions else []), "t", "p")


def true_items(links: DataFrame) -> DataFrame:
    return links.filter(F.col("t").isNotNull()).select("case_id", F.col("pos").alias("row"), "t.*")


def answered_items(links: DataFrame) -> DataFrame:
    return links.filter(F.col("p").isNotNull()).select("case_id", F.col("pos").alias("row"), "p.*")


def given_pairs(links: DataFrame) -> DataFrame:
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    return links.filter(both).select(
        "case_id", F.col("pos").alias("row"), F.col("pos").alias("predicted_row")
    )


# --- headers ----------------------------------------------------------------------------------

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _uf(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(uf) for uf in UF_LIST]), index.cast("int") + 1)


def _segment_index() -> Column:
    chain = F.when(F.col("c_mktsegment") == SEGMENTS[0], 0)
    for position, name in enumerate(SEGMENTS[1:], start=1):
        chain = chain.when(F.col("c_mktsegment") == name, position)
    return chain


def header_fault() -> Column:
    """25 * order status + 5 * priority + market segment, each counted from 0."""
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    priority = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return status.otherwise(2) * 25 + priority * 5 + _segment_index()


def case_status(g: Column) -> Column:
    return (
        F.when(g.between(45, 49), "validation_failed")
        .when(g.between(50, 54), "refused")
        .when(g.between(55, 59), "truncated")
        .when(g.between(60, 64), "schema_invalid")
        .when(g.between(65, 69), "infrastructure_failure")
        .when(g.between(70, 74), "harness_error")
        .otherwise("success")
    )


def _orders(spark: SparkSession, sf_dir: str, *, placed: bool = True) -> DataFrame:
    """Orders with their customer, hashed and sorted by order while they are narrow: what is made of
    them after that meets other tables of the case as it stands. Not ``placed``, they stay where they are."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    both = orders.join(customer, orders.o_custkey == customer.c_custkey)
    if placed:
        both = spread(both, "o_orderkey").sortWithinPartitions("o_orderkey")
    return both.withColumn("g", header_fault())


def _digits(col: Column, size: int) -> Column:
    return F.lpad(col.cast("string"), size, "0")


def true_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice header per order, with ``g`` (its misreading) and ``base_case`` (the customer)."""
    household = F.col("c_mktsegment") == "HOUSEHOLD"
    based = _orders(spark, sf_dir).withColumns(
        {
            "issuer_base": F.concat(_digits(F.col("o_custkey"), 8), F.lit("0001")),
            "cnpj_base": F.concat(_digits(F.col("o_orderkey"), 8), F.lit("0002")),
            "cpf_base": _digits(F.col("o_orderkey"), 9),
        }
    )
    issuer_base, cnpj_base, cpf_base = (F.col(n) for n in ("issuer_base", "cnpj_base", "cpf_base"))
    sourced = based.withColumns(
        {
            "issuer_cnpj": F.concat(issuer_base, ids.cnpj_digits(issuer_base)),
            "tax_id": F.when(household, F.concat(cpf_base, ids.cpf_digits(cpf_base))).otherwise(
                F.concat(cnpj_base, ids.cnpj_digits(cnpj_base))
            ),
            "issuer_uf": _uf(F.col("c_nationkey")),
            "issue_date": issue_date(),
            "products": _money(F.col("o_totalprice")),
        }
    )
    body = ids.access_key_body(
        ids.uf_code(F.col("issuer_uf")), ids.year_month(F.col("issue_date")), F.col("issuer_cnpj"),
        F.lit("55"), F.col("c_nationkey") + 1, F.col("o_orderkey"), F.lit("1"), F.col("o_custkey"),
    )
    sourced = sourced.withColumn("key_body", body)
    key = ids.complete_access_key(F.col("key_body"))
    zero = _money(F.lit("0.00"))
    freight, discount, icms = _money(F.lit("10.00")), _money(F.lit("5.00")), _money(F.lit("18.00"))
    boxes = {name: zero for name in TOTAL_FIELDS} | {
        "icms_amount": icms,
        "products_total": F.col("products"),
        "freight": freight,
        "discount": discount,
        "invoice_total": (F.col("products") - discount + freight).cast(MONEY),
    }
    return sourced.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("base_case"),
        "g",
        key.alias("access_key"),
        F.col("o_orderkey").cast("int").alias("number"),
        (F.col("c_nationkey") + 1).cast("int").alias("series"),
        "issue_date",
        F.concat(F.lit("VENDA "), F.col("o_orderpriority")).alias("operation_nature"),
        F.struct(
            F.col("issuer_cnpj").alias("cnpj"),
            F.col("c_name").alias("name"),
            F.when(
                F.col("c_mktsegment") != "BUILDING",
                F.concat(F.lit("IE"), F.col("c_custkey").cast("string")),
            ).alias("ie"),
            F.col("issuer_uf").alias("uf"),
        ).alias("issuer"),
        F.struct(
            F.col("tax_id"),
            F.when(household, "cpf").otherwise("cnpj").alias("tax_id_kind"),
            F.concat(F.lit("Buyer "), F.col("o_orderkey").cast("string")).alias("name"),
            F.lit(None).cast("string").alias("ie"),
            _uf(F.col("c_nationkey") + 1).alias("uf"),
        ).alias("recipient"),
        F.struct(*[boxes[name].alias(name) for name in TOTAL_FIELDS]).alias("totals"),
    )


HEADER_COLUMNS = (
    "access_key", "number", "series", "issue_date", "operation_nature", "issuer", "recipient",
    "totals",
)


def _answered_fields() -> dict[str, Column]:
    """The header fields as answered: the misreading ``g`` stands for, if any."""
    g = F.col("g")
    cnpj, tax_id = F.col("issuer.cnpj"), F.col("recipient.tax_id")
    key, date = F.col("access_key"), F.col("issue_date")

    def cut(col: Column) -> Column:
        return F.substring(col, F.lit(1), F.length(col) - 1)

    last = F.substring(tax_id, F.length(tax_id), F.lit(1))
    wrong_digit = F.concat(cut(tax_id), F.when(last == "0", "1").otherwise("0"))
    swapped_cnpj = F.concat(
        F.substring(cnpj, 1, 6), F.substring(cnpj, 8, 1), F.substring(cnpj, 7, 1),
        F.substring(cnpj, 9, 6),
    )
    issuer = F.struct(
        F.when(g == 0, swapped_cnpj).when(g == 1, tax_id).otherwise(cnpj).alias("cnpj"),
        F.when(g == 1, F.col("recipient.name"))
        .when(g == 12, cut(F.col("issuer.name")))
        .otherwise(F.col("issuer.name"))
        .alias("name"),
        F.when((g == 7) & F.col("issuer.ie").isNull(), "X")
        .when(g != 7, F.col("issuer.ie"))
        .alias("ie"),
        F.when(g == 15, "XX")
        .when((g == 29) & (F.col("issuer.uf") == "SP"), "RJ")
        .when(g == 29, "SP")
        .otherwise(F.col("issuer.uf"))
        .alias("uf"),
    )
    kind = F.col("recipient.tax_id_kind")
    recipient = F.struct(
        F.when(g == 1, cnpj)
        .when(g == 16, "abc")
        .when(g == 28, "123")
        .when(g == 17, wrong_digit)
        .when(g == 18, F.repeat(F.lit("1"), F.length(tax_id)))
        .otherwise(tax_id)
        .alias("tax_id"),
        F.when((g == 20) & (kind == "cpf"), "cnpj")
        .when(g == 20, "cpf")
        .otherwise(kind)
        .alias("tax_id_kind"),
        F.when(g == 1, F.col("issuer.name")).otherwise(F.col("recipient.name")).alias("name"),
        F.col("recipient.ie").alias("ie"),
        F.when(g == 11, "ZZ").otherwise(F.col("recipient.uf")).alias("uf"),
    )
    box = {name: F.col(f"totals.{name}") for name in TOTAL_FIELDS}
    box |= {
        "invoice_total": F.when(g == 2, box["invoice_total"] + dec("0.01"))
        .when(g == 3, box["invoice_total"] * 100)
        .otherwise(box["invoice_total"]),
        "freight": F.when(g == 9, box["products_total"]).otherwise(box["freight"]),
        "discount": F.when(g == 10, dec("0.00")).otherwise(box["discount"]),
        "icms_amount": F.when(g == 13, box["icms_amount"] + dec("2941.83")).otherwise(
            box["icms_amount"]
        ),
    }
    changes = {
        "access_key": F.when(g == 5, cut(key))
        .when(g == 19, F.concat(F.substring(key, 1, 20), F.lit("65"), F.substring(key, 23, 22)))
        .when(g == 22, F.concat(F.lit("x"), F.substring(key, 2, 43)))
        .otherwise(key),
        "number": F.when(g == 8, F.col("number") + 1).otherwise(F.col("number")),
        "series": F.when(g == 14, F.col("series") + 1).otherwise(F.col("series")),
        "issue_date": F.when(g == 4, F.date_add(date, 1))
        .when(g == 21, F.lit("2004-01-01").cast("date"))
        .otherwise(date),
        "operation_nature": F.when(g == 6, "DEVOLUCAO").otherwise(F.col("operation_nature")),
        "issuer": issuer,
        "recipient": recipient,
        "totals": F.struct(*[box[name].cast(MONEY).alias(name) for name in TOTAL_FIELDS]),
    }
    return changes


def answered_headers(headers: DataFrame) -> DataFrame:
    changes = _answered_fields()
    return headers.select(
        *[changes.get(name, F.col(name)).alias(name) for name in headers.columns]
    )


def header_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, g, status, t, p``: the true and the answered header of each order, no join."""
    changes = _answered_fields()
    answered = [changes.get(name, F.col(name)).alias(name) for name in HEADER_COLUMNS]
    return true_headers(spark, sf_dir).select(
        "case_id",
        "g",
        case_status(F.col("g")).alias("status"),
        F.struct(*HEADER_COLUMNS).alias("t"),
        F.struct(*answered).alias("p"),
    )


def headers_with_item_totals(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers whose four item boxes and total are the sums of ``items`` (zero without items)."""
    summed = with_item_sums(headers, items)
    box = {name: F.col(f"totals.{name}") for name in TOTAL_FIELDS}
    for _, column, target in SUM_RULES:
        box[target] = F.col(f"sum_{column}")
    box["invoice_total"] = (
        box["products_total"] - box["discount"] + box["freight"] + box["ipi_amount"]
    )
    totals = F.struct(*[box[name].cast(MONEY).alias(name) for name in TOTAL_FIELDS])
    return summed.withColumn("totals", totals).select(*headers.columns)


def installment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, pos, t, p`` of the installments: as many as the priority digit says."""
    orders = _orders(spark, sf_dir)
    count = F.substring("o_orderpriority", 1, 1).cast("int")
    split = installment_split(
        _money(F.col("o_totalprice")) + dec("5.00", 18), count, issue_date()
    )
    listed = orders.select(
        F.col("o_orderkey").alias("case_id"), "g", F.posexplode(split).alias("pos", "t")
    )
    t, g = F.col("t"), F.col("g")
    late = F.struct(
        t["number"].alias("number"),
        F.date_add(t["due_date"], 1).alias("due_date"),
        t["amount"].alias("amount"),
    )
    early = F.struct(
        t["number"].alias("number"),
        F.date_sub(t["due_date"], 60).alias("due_date"),
        t["amount"].alias("amount"),
    )
    short = F.struct(
        t["number"].alias("number"),
        t["due_date"].alias("due_date"),
        (t["amount"] - dec("2.00", 18)).cast(MONEY).alias("amount"),
    )
    dropped = (g == 23) & (F.col("pos") == 0)
    answer = (
        F.when(g == 24, late).when(g == 25, early).when(g == 26, short).otherwise(t)
    )
    return listed.select("case_id", "pos", "t", F.when(~dropped, answer).alias("p"))


def flat_installments(links: DataFrame, side: str) -> DataFrame:
    kept = links.filter(F.col(side).isNotNull())
    return kept.select("case_id", F.col("pos").alias("row"), f"{side}.*")


# --- case metadata ----------------------------------------------------------------------------

RENDERINGS = (
    ("text", None),
    ("image_clean", None),
    ("rotation", "mild"),
    ("blur", "severe"),
    ("barcode_damaged", None),
)


def case_metadata(spark: SparkSession, sf_dir: str, *, placed: bool = True) -> DataFrame:
    """Split, rendering, severity, barcode flag and tags of each order."""
    orders = _orders(spark, sf_dir, placed=placed)
    region = F.col("c_nationkey") % 5
    rendering, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for position, (name, level) in enumerate(RENDERINGS):
        rendering = F.when(region == position, name).otherwise(rendering)
        severity = F.when(region == position, F.lit(level)).otherwise(severity)
    segment, status = F.col("c_mktsegment"), F.col("o_orderstatus")
    tags = F.array_compact(
        F.array(
            F.when(status == "F", "regime_normal").otherwise("simples_nacional"),
            F.when(segment == "HOUSEHOLD", "cpf_recipient"),
            F.when(F.col("o_totalprice") < 150000, "short")
            .when(F.col("o_totalprice") < 350000, "medium")
            .otherwise("many_items"),
            F.when(F.col("o_totalprice") >= 350000, "multi_page").otherwise("single_page"),
            F.when(segment == "MACHINERY", "mixed_tax_codes"),
        )
    )
    return orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_custkey").alias("base_case"),
        F.when(segment.isin("AUTOMOBILE", "BUILDING"), "dev").otherwise("test").alias("split"),
        rendering.alias("rendering"),
        severity.alias("severity"),
        (segment != "FURNITURE").alias("barcode_readable"),
        tags.alias("case_tags"),
        "g",
        case_status(F.col("g")).alias("status"),
    )
