"""Building test tables: quotas, splits, taxes, totals, identifiers and seeded misreadings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenota.functions import identifiers as ids
from lumenota.functions.invoice import length_class
from lumenota.functions.numbers import dec
from lumenota.operators.ordering import row_index, running_before

MONEY, RATE = "decimal(18,2)", "decimal(9,2)"

# The renderings of a curve case, in numbering order.
TWIN_RENDERINGS = (
    ("image_clean", None),
    ("rotation", "mild"),
    ("rotation", "severe"),
    ("blur", "mild"),
    ("blur", "severe"),
    ("low_dpi", "mild"),
    ("low_dpi", "severe"),
    ("barcode_damaged", None),
)
# Tax parameters by tax code; a code not listed has none of them.
ICMS_RATES = {
    "00": "18.00", "10": "18.00", "20": "12.00", "51": "18.00", "70": "18.00", "90": "18.00",
    "900": "12.00",
}
BASE_REDUCTIONS = {"20": "33.33", "70": "33.33"}
CREDIT_RATES = {"101": "3.10"}
ST_MARGINS = {"10": "40.00", "30": "40.00", "70": "35.00"}
ST_RATES = {"10": "18.00", "30": "18.00", "70": "18.00"}
DEFERRAL_RATES = {"51": "33.33"}
ST_CODES = ("10", "30", "51", "70")


# --- quotas and splits ------------------------------------------------------------------------


def _cell_offsets(cells: DataFrame) -> DataFrame:
    """Cells with how many base cases and curve cases come before them.

    Cells are the rows of a quota plan, one per kind of case, never one per case.
    """
    before = Window.orderBy("cell_order").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumns(
        {
            "base_offset": F.coalesce(F.sum("count").over(before), F.lit(0)),
            "curve_offset": F.coalesce(F.sum(F.size("curve")).over(before), F.lit(0)),
        }
    )


def expand_quota(cells: DataFrame) -> DataFrame:
    """Numbered base cases of quota cells with their slot traits, pins, band and explicit split.

    ``cells``: ``cell_order, cell, regime, length, count, item_low, item_high, pages, traits
    map<string,array<int>>, pinned map<int,int>, curve map<int,string>, long_low, long_high``.
    """
    slots = _cell_offsets(cells).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.col("count") - 1))
    )
    slot = F.col("slot").cast("int")
    traits = F.array_sort(
        F.map_keys(F.map_filter("traits", lambda _, where: F.array_contains(where, slot)))
    )
    rows = slots.withColumn("slot_traits", traits)
    has = lambda trait: F.array_contains("slot_traits", trait)
    long_band = has("long_text") & F.col("long_low").isNotNull()
    low = F.when(long_band, F.col("long_low")).otherwise(F.col("item_low"))
    number = F.col("base_offset") + F.col("slot") + 1
    place = F.array_position(F.array_sort(F.map_keys("curve")), slot)
    return rows.select(
        number.cast("bigint").alias("number"),
        "cell", "slot", "regime",
        F.when(has("mei"), 4).when(F.col("regime") == "normal", 3).otherwise(1).alias("crt"),
        "length", "pages",
        F.when(has("mixed_tax_codes"), F.greatest(F.lit(2), low)).otherwise(low).alias("band_low"),
        F.when(long_band, F.col("long_high")).otherwise(F.col("item_high")).alias("band_high"),
        F.col("slot_traits").alias("traits"),
        F.try_element_at("pinned", slot).alias("pinned_items"),
        F.try_element_at("curve", slot).alias("curve_split"),
        F.when(place > 0, F.col("curve_offset") + place - 1).alias("curve_rank"),
    )


def expand_twins(
    bases: DataFrame, renderings: Sequence[tuple[str, str | None]] = TWIN_RENDERINGS
) -> DataFrame:
    """Every curve base once per rendering, numbered after the bases."""
    listed = F.array(
        *[
            F.struct(
                F.lit(position).alias("place"),
                F.lit(name).alias("rendering"),
                F.lit(level).cast("string").alias("severity"),
            )
            for position, (name, level) in enumerate(renderings)
        ]
    )
    last = bases.agg(F.max("number").alias("last"))
    curve = bases.filter(F.col("curve_split").isNotNull())
    twins = curve.crossJoin(F.broadcast(last)).select(
        F.col("number").alias("base_number"), "curve_rank", "last", F.inline(listed)
    )
    number = F.col("last") + F.col("curve_rank") * len(renderings) + F.col("place") + 1
    return twins.select(number.alias("number"), "base_number", "rendering", "severity")


# Fixed values of a quota plan, as relations. A *mark* is what a slot carries: a trait, ``curve`` for
# a base with twins, ``pinned`` for a fixed item count and ``pinned_one`` where that count is one.
ATTRIBUTE_VALUES = {
    "regime": ("normal", "simples"),
    "length": ("short", "medium", "many_items", "multi_page"),
    "pages": ("single", "multi"),
}
SPLIT_NAMES = ("dev", "test")
MARK_CELLS = (  # mark, attribute, the values of it that the mark may stand in
    ("st_deferral", "regime", ("normal",)),
    ("mei", "cell", ("simples-short", "simples-medium")),
    ("long_text", "length", ("short", "multi_page")),
    ("curve", "pages", ("single",)),
)
MARKS_APART = (  # two marks that no slot has together, and the only length that holds for (or none)
    ("mixed_tax_codes", "pinned_one", None),
    ("confusable", "pinned_one", None),
    ("confusable", "long_text", None),
    ("confusable", "curve", None),
    ("mei", "curve", None),
    ("long_text", "curve", None),
    ("long_text", "pinned", "multi_page"),
    ("alphanumeric_recipient", "cpf_recipient", None),
)


def slot_marks(cells: DataFrame) -> DataFrame:
    """``cell, count`` and the attributes of a cell with every ``slot, mark`` of it, and the split
    that a curve slot names."""
    own = ["cell", "count", *ATTRIBUTE_VALUES]
    parts = (
        cells.select(*own, F.explode("traits").alias("mark", "slots")).select(
            *own, "mark", F.explode("slots").alias("slot"), F.lit(None).cast("string").alias("split")
        ),
        cells.select(*own, F.lit("curve").alias("mark"), F.explode("curve").alias("slot", "split")),
        cells.select(*own, F.explode("pinned").alias("slot", "items")).select(
            *own,
            F.explode(
                F.array_compact(
                    F.array(F.lit("pinned"), F.when(F.col("items") == 1, F.lit("pinned_one")))
                )
            ).alias("mark"),
            "slot",
            F.lit(None).cast("string").alias("split"),
        ),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def check_quota(cells: DataFrame) -> DataFrame:
    """``cell, problem``: where a quota plan breaks a relation it is defined by.

    An attribute has a value of its own list; a mark stands inside its cell, and only in cells it may
    stand in; two marks that stay apart share no slot; a band ascends from 1; a cell has a base for
    either split, and names no more dev slots than a third of it gives.
    """
    marks = slot_marks(cells)
    spark = cells.sparkSession

    def say(found: DataFrame, problem: Column) -> DataFrame:
        return found.select("cell", problem.alias("problem"))

    attributes = cells.select(
        "cell",
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("attribute"), F.col(n).alias("value")) for n in ATTRIBUTE_VALUES]
            )
        ),
    )
    listed = [(name, value) for name, values in ATTRIBUTE_VALUES.items() for value in values]
    known = spark.createDataFrame(listed, "attribute string, value string")
    strange = attributes.join(F.broadcast(known), ["attribute", "value"], "left_anti")

    place = F.create_map(
        *[x for n in ("cell", *ATTRIBUTE_VALUES) for x in (F.lit(n), F.col(n))]
    )
    homes = spark.createDataFrame(
        [(m, a, list(v)) for m, a, v in MARK_CELLS], "mark string, attribute string, homes array<string>"
    )
    abroad = marks.withColumn("place", place).join(F.broadcast(homes), "mark")
    abroad = abroad.filter(~F.array_contains("homes", F.try_element_at("place", F.col("attribute"))))

    outside = marks.filter((F.col("slot") < 0) | (F.col("slot") >= F.col("count")))
    apart = spark.createDataFrame(list(MARKS_APART), "mark string, other string, only string")
    partners = marks.select("cell", "slot", F.col("mark").alias("other"))
    together = (
        marks.join(F.broadcast(apart), "mark")
        .filter(F.col("only").isNull() | (F.col("only") == F.col("length")))
        .join(partners, ["cell", "slot", "other"])
    )

    curve = marks.filter(F.col("mark") == "curve")
    unnamed = curve.filter(~F.col("split").isin(*SPLIT_NAMES))
    dev = curve.filter(F.col("split") == "dev").groupBy("cell", "count").agg(F.count(F.lit(1)).alias("n"))
    third = F.greatest(F.lit(1), F.call_function("div", F.col("count") + 1, F.lit(3)))
    bands = cells.select(
        "cell",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("band"), F.col(f"{n}_low").alias("low"), F.col(f"{n}_high").alias("high"))
                    for n in ("item", "long")
                ]
            )
        ),
    )
    broken = bands.filter((F.col("low") < 1) | (F.col("low") > F.col("high")))
    problems = (
        say(strange, F.concat(F.lit("no such "), "attribute")),
        say(outside, F.concat("mark", F.lit(" on a slot the cell lacks"))),
        say(abroad, F.concat("mark", F.lit(" not for this "), "attribute")),
        say(together, F.concat("mark", F.lit(" together with "), "other")),
        say(unnamed, F.lit("curve without a split")),
        say(broken, F.concat("band", F.lit(" band does not ascend from 1"))),
        say(cells.filter(F.col("count") < len(SPLIT_NAMES)), F.lit("fewer bases than splits")),
        say(dev.filter(F.col("n") > third), F.lit("more dev curve slots than places")),
    )
    found = problems[0]
    for more in problems[1:]:
        found = found.unionByName(more)
    return found.distinct()


def stratified_split(bases: DataFrame, seed: str, *, case: str = "case_id") -> DataFrame:
    """Per cell a third of the bases (at least one) in dev, explicit ones first.

    The others are taken in the order of a seeded digest. Their positions are scanned by digest
    prefix, so a cell with very many cases is spread.
    """
    places = bases.groupBy("cell").agg(
        F.greatest(F.lit(1), F.call_function("div", F.count(F.lit(1)) + 1, F.lit(3))).alias("dev"),
        F.count_if(F.col("curve_split") == "dev").alias("named"),
    )
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.lit("split"), F.col(case).cast("string")), 256)
    free = bases.filter(F.col("curve_split").isNull()).withColumn("digest", digest)
    prefixed = free.withColumn("prefix", F.substring("digest", 1, 3))
    ranked = row_index(prefixed, ["cell"], "prefix", ["digest", case], "place")
    chosen = ranked.join(places, "cell").select(
        case,
        "cell",
        F.when(F.col("place") < F.col("dev") - F.col("named"), "dev").otherwise("test").alias(
            "split"
        ),
    )
    named = bases.filter(F.col("curve_split").isNotNull())
    return chosen.unionByName(named.select(case, "cell", F.col("curve_split").alias("split")))


def split_twins(twins: DataFrame, splits: DataFrame, *, case: str = "case_id") -> DataFrame:
    """Twins take the split of their base."""
    base = splits.select(F.col(case).alias("base_case"), "split")
    return twins.join(base, "base_case")


def pick_one_per_cell(
    cases: DataFrame, cells: Sequence[tuple[str, Column]], seed: str, *, case: str = "case_id"
) -> DataFrame:
    """``cell, case`` of one dev case per named predicate: the smallest seeded digest, in the order
    of the cells, no case twice.

    A cell can lose at most one of its best cases to each cell before it, so its first as many as
    there are cells suffice: one pass keeps those, and the greedy choice runs over that bounded list
    in one row. A cell without a free case is an error when the result is read.
    """
    names = [name for name, _ in cells]
    digest = lambda name: F.sha2(
        F.concat_ws(":", F.lit(seed), F.lit("ci"), F.lit(name), F.col(case).cast("string")), 256
    )
    offers = F.array_compact(
        F.array(
            *[
                F.when(hit, F.struct(F.lit(at).alias("at"), digest(name).alias("digest")))
                for at, (name, hit) in enumerate(cells)
            ]
        )
    )
    listed = cases.filter(F.col("split") == "dev").select(F.col(case).alias("case"), F.inline(offers))
    best = Window.partitionBy("at").orderBy("digest", "case")
    near = listed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= len(cells))
    offered = near.agg(F.sort_array(F.collect_list(F.struct("at", "rank", "case"))).alias("offered"))
    kind = dict(cases.dtypes)[case]

    def choose(taken: Column, at: Column) -> Column:
        free = F.filter(
            "offered", lambda o: (o["at"] == at) & ~F.array_contains(taken["cases"], o["case"])
        )
        pick = F.get(free, F.lit(0))["case"]
        missing = F.concat(
            F.lit("no dev case matches cell "), F.get(F.array(*map(F.lit, names)), at)
        )
        checked = F.coalesce(pick, F.raise_error(missing).cast(kind))
        return F.struct(F.concat(taken["cases"], F.array(checked)).alias("cases"))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("cases"))
    chosen = F.aggregate(F.sequence(F.lit(0), F.lit(len(cells) - 1)), start, choose)["cases"]
    picked = offered.select(F.posexplode(chosen).alias("at", case))
    return picked.select(F.get(F.array(*map(F.lit, names)), F.col("at")).alias("cell"), case)


def nest_invoices(headers: DataFrame, items: DataFrame, installments: DataFrame) -> DataFrame:
    """Headers with their ``items`` and ``installments`` as arrays in printed order (by ``row``).

    An invoice has at most 990 items by its layout; that bounds what meets in one row.
    """
    nested = headers
    for name, rows in (("items", items), ("installments", installments)):
        fields = [c for c in rows.columns if c not in ("case_id", "row")]
        listed = rows.groupBy("case_id").agg(
            F.sort_array(F.collect_list(F.struct("row", F.struct(*fields).alias("r")))).alias("rows")
        )
        kept = F.transform("rows", lambda member: member["r"])
        nested = nested.join(listed.select("case_id", kept.alias(name)), "case_id", "left")
        empty = F.array().cast(dict(nested.dtypes)[name])
        nested = nested.withColumn(name, F.coalesce(name, empty))
    return nested


def derive_tags(facts: DataFrame) -> DataFrame:
    """Plus ``tags``: the sorted trait set of an invoice from its facts.

    ``facts``: ``regime, crt, item_count, pages, issuer_cnpj, recipient_tax_id,
    recipient_kind, tax_codes array<string>, ipi_total, freight, discount, installment_count``.
    """
    c = F.col
    digits_only = r"\A[0-9]+\z"
    tags = F.array_compact(
        F.array(
            F.when(c("regime") == "normal", "regime_normal").otherwise("simples_nacional"),
            F.when(c("crt") == 4, "mei"),
            length_class(c("item_count")),
            F.when(c("pages") == 1, "single_page").otherwise("multi_page"),
            F.when(c("issuer_cnpj").rlike(digits_only), "numeric_cnpj").otherwise(
                "alphanumeric_cnpj"
            ),
            F.when(c("recipient_kind") == "cpf", "cpf_recipient").when(
                ~c("recipient_tax_id").rlike(digits_only), "alphanumeric_recipient"
            ),
            F.when(
                F.size(F.array_intersect("tax_codes", F.array(*[F.lit(x) for x in ST_CODES]))) > 0,
                "st_deferral",
            ),
            F.when(F.size(F.array_distinct("tax_codes")) >= 2, "mixed_tax_codes"),
            F.when(c("ipi_total") != 0, "ipi"),
            F.when((c("freight") != 0) | (c("discount") != 0), "freight_discount"),
            F.when(c("installment_count") > 0, "installments"),
        )
    )
    return facts.withColumn("tags", F.array_sort(F.array_distinct(tags)))


# --- amounts ----------------------------------------------------------------------------------


def _rate(table: dict[str, str], code: Column) -> Column:
    """A rate by tax code, zero for codes without one."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    found = F.try_element_at(F.create_map(*entries), code)
    return F.coalesce(found, F.lit("0.00")).cast(RATE)


def _share(amount: Column, rate: Column) -> Column:
    return F.round(amount * rate * dec("0.01"), 2).cast(MONEY)


def item_taxes(items: DataFrame) -> DataFrame:
    """Plus the tax columns of items (``tax_code, quantity, unit_price, ipi_rate``)."""
    code = F.col("tax_code")
    hundred = dec("100.00")
    total = F.round(F.col("quantity") * F.col("unit_price"), 2).cast(MONEY)
    rated = items.withColumns(
        {
            "total": total,
            "icms_rate": _rate(ICMS_RATES, code),
            "reduction": _rate(BASE_REDUCTIONS, code),
            "deferral_rate": _rate(DEFERRAL_RATES, code),
            "st_rate": _rate(ST_RATES, code),
            "st_margin": _rate(ST_MARGINS, code),
            "credit_rate": _rate(CREDIT_RATES, code),
        }
    )
    zero = F.lit(0).cast(MONEY)
    based = rated.withColumns(
        {
            "icms_base": F.when(~code.isin(*ICMS_RATES), zero)
            .when(F.col("reduction") != 0, _share(F.col("total"), hundred - F.col("reduction")))
            .otherwise(F.col("total")),
            "st_base": F.when(F.col("st_rate") == 0, zero).otherwise(
                _share(F.col("total"), hundred + F.col("st_margin"))
            ),
            "credit_amount": _share(F.col("total"), F.col("credit_rate")),
            "ipi_amount": _share(F.col("total"), F.col("ipi_rate")),
        }
    ).withColumn("operation_amount", _share(F.col("icms_base"), F.col("icms_rate")))
    deferred = based.withColumn(
        "deferred_amount", _share(F.col("operation_amount"), F.col("deferral_rate"))
    ).withColumn("icms_amount", (F.col("operation_amount") - F.col("deferred_amount")).cast(MONEY))
    st = (_share(F.col("st_base"), F.col("st_rate")) - F.col("icms_amount")).cast(MONEY)
    return deferred.withColumn("st_amount", F.when(F.col("st_rate") == 0, zero).otherwise(st))


def invoice_totals(items: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """The item sums of an invoice and its total (products, discount, ST, freight and IPI)."""
    sums = {
        "products_total": "total",
        "icms_base": "icms_base",
        "icms_amount": "icms_amount",
        "icms_st_base": "st_base",
        "icms_st_amount": "st_amount",
        "ipi_amount": "ipi_amount",
        "freight": "freight",
        "discount": "discount",
    }
    grouped = items.groupBy(*by).agg(
        *[F.sum(source).cast(MONEY).alias(name) for name, source in sums.items()]
    )
    c = F.col
    total = (
        c("products_total") - c("discount") + c("icms_st_amount") + c("freight") + c("ipi_amount")
    )
    return grouped.withColumn("invoice_total", total.cast(MONEY))


def allocate(
    rows: DataFrame, group: Sequence[str], chunk: str, order: Sequence[str], *, cap: str = "cap",
    amount: str = "amount",
) -> DataFrame:
    """Plus ``share``: the group's amount (whole cents) spread in order, each row within its cap.

    Rows fill up in order, so the shares sum to the amount whenever the caps can hold it. The
    running caps are scanned in chunks of the order.
    """
    before = running_before(rows, group, chunk, order, sums={"__filled": cap})
    left = F.greatest(F.col(amount) - F.coalesce("__filled", F.lit(0)), F.lit(0))
    return before.withColumn("share", F.least(F.col(cap), left)).drop("__filled")


# --- identifiers ------------------------------------------------------------------------------


def synthetic_digits(seed: Column, size: int) -> Column:
    """``size`` decimal digits from the digest of a seed text."""
    digest = F.translate(F.sha2(seed, 256), "abcdef", "012345")
    return F.substring(digest, 1, size)


def synthetic_cnpj(seed: Column) -> Column:
    """A valid numeric CNPJ of branch 0001."""
    root = synthetic_digits(seed, 8)
    safe = F.when(ids.is_repeated(root), F.concat(F.substring(root, 1, 7), F.lit("9"))).otherwise(
        root
    )
    last = F.when(ids.is_repeated(safe), F.concat(F.substring(safe, 1, 7), F.lit("8"))).otherwise(
        safe
    )
    base = F.concat(last, F.lit("0001"))
    return F.concat(base, ids.cnpj_digits(base))


def synthetic_cpf(seed: Column) -> Column:
    """A valid CPF whose base is not one repeated digit."""
    base = synthetic_digits(seed, 9)
    ending = F.when(F.substring(base, 1, 1) == "9", "8").otherwise("9")
    safe = F.when(ids.is_repeated(base), F.concat(F.substring(base, 1, 8), ending)).otherwise(base)
    return F.concat(safe, ids.cpf_digits(safe))


# --- misreadings ------------------------------------------------------------------------------
#
# A misreading is the least change to an invoice that fits the definition of one tag. Each rule names
# the member it rewrites and gives the new value, null where the tag cannot apply. Rows are chosen by
# what they hold: the dearest row, or the ends of the list.

Rule = Callable[[], dict[str, Column]]
MISREADINGS: dict[str, Rule] = {}
_ROW_TYPES = {"quantity": "decimal(18,4)", "unit_price": "decimal(18,4)", "total": MONEY}


def _misreading(tag: str) -> Callable[[Rule], Rule]:
    def register(rule: Rule) -> Rule:
        MISREADINGS[tag] = rule
        return rule

    return register


def _length() -> Column:
    return F.size("items")


def _dearest() -> Column:
    """Place (from one) of the row with the greatest total, the first of equals."""
    totals = F.col("items")["total"]
    return F.array_position(totals, F.array_max(totals)).cast("int")


def _row(place: Column) -> Column:
    return F.try_element_at("items", place)


def _edited(row: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        row = row.withField(name, value.cast(_ROW_TYPES[name]) if name in _ROW_TYPES else value)
    return row


def _with_row(place: Column, **values: Column) -> Column:
    """The items with members of one row replaced."""
    return F.transform(
        "items", lambda row, i: F.when(i + 1 == place, _edited(row, values)).otherwise(row)
    )


def _first_rows(count: Column) -> Column:
    return F.slice("items", F.lit(1), F.greatest(count, F.lit(0)))


def _box(name: str, value: Column) -> Column:
    return F.col("totals").withField(name, value.cast(MONEY))


def _all_but_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)


@_misreading("party_swap")
def _parties_exchanged() -> dict[str, Column]:
    """Each party carries the other's number."""
    issuer, recipient = F.col("issuer"), F.col("recipient")
    return {
        "issuer": issuer.withField("cnpj", recipient["tax_id"]),
        "recipient": recipient.withField("tax_id", issuer["cnpj"]),
    }


@_misreading("merged_rows")
def _last_two_in_one() -> dict[str, Column]:
    """The last row is read as part of the one above it."""
    n = _length()
    last, above = _row(n), _row(n - 1)
    sums = {name: above[name] + last[name] for name in ("quantity", "total")}
    both = F.slice(_with_row(n - 1, **sums), F.lit(1), F.greatest(n - 1, F.lit(0)))
    return {"items": F.when((n > 2) & (last["total"] * above["total"] != 0), both)}


@_misreading("split_rows")
def _dearest_in_two() -> dict[str, Column]:
    """A quarter of the dearest row stands in a row of its own at the end."""
    at = _dearest()
    row = _row(at)
    part = {
        name: F.bround(row[name] / 4, scale).cast(_ROW_TYPES[name])
        for name, scale in (("quantity", 4), ("total", 2))
    }
    left = {name: row[name] - value for name, value in part.items()}
    large = (part["quantity"] > 0) & (part["total"] > 0)
    rows = F.concat(_with_row(at, **left), F.array(_edited(row, part)))
    return {"items": F.when(large, rows)}


@_misreading("trailing_rows_lost")
def _second_half_lost() -> dict[str, Column]:
    n = _length()
    return {"items": F.when(n > 1, _first_rows(F.ceil(n / 2).cast("int")))}


@_misreading("dropped_row")
def _first_row_lost() -> dict[str, Column]:
    n = _length()
    return {"items": F.when(n > 2, F.slice("items", F.lit(2), F.greatest(n - 1, F.lit(0))))}


@_misreading("invented_row")
def _mirrored_row_added() -> dict[str, Column]:
    """The dearest row once more with its texts mirrored and its amounts raised."""
    row = _row(_dearest())
    texts = {name: F.reverse(row[name]) for name in ("code", "description", "ncm", "unit")}
    amounts = {name: row[name] + row[name] + 1 for name in _ROW_TYPES}
    return {"items": F.when(row.isNotNull(), F.concat("items", F.array(_edited(row, texts | amounts))))}


@_misreading("value_from_other_row")
def _total_of_the_cheapest() -> dict[str, Column]:
    at, totals = _dearest(), F.col("items")["total"]
    least = F.array_min(F.filter(totals, lambda total: total != 0))
    usable = (_length() > 2) & (least < F.array_max(totals))
    return {"items": F.when(usable, _with_row(at, total=least))}


@_misreading("value_from_other_box")
def _products_for_the_whole() -> dict[str, Column]:
    whole, products = F.col("totals.invoice_total"), F.col("totals.products_total")
    return {"totals": F.when((products != 0) & (products != whole), _box("invoice_total", products))}


@_misreading("thousands_misparse")
def _comma_for_a_point() -> dict[str, Column]:
    whole = F.col("totals.invoice_total")
    return {"totals": F.when(whole != 0, _box("invoice_total", whole * 1000))}


@_misreading("zero_for_blank")
def _freight_read_as_nothing() -> dict[str, Column]:
    freight = F.col("totals.freight")
    return {"totals": F.when(freight != 0, _box("freight", freight - freight))}


@_misreading("digit_transposition")
def _last_unequal_digits_exchanged() -> dict[str, Column]:
    """The last two unequal neighbours among the access key's digits change places."""
    key = "access_key"
    pair = r"^(.*)([0-9])(?!\2)([0-9])(.*)$"
    swapped = F.regexp_replace(key, pair, "$1$3$2$4")
    return {key: F.when(swapped != F.col(key), swapped)}


@_misreading("digit_substitution")
def _last_digit_raised() -> dict[str, Column]:
    cnpj = F.col("issuer.cnpj")
    digit = F.substring(cnpj, -1, 1)
    raised = F.pmod(digit.try_cast("int") + 1, F.lit(10)).cast("string")
    changed = F.concat(_all_but_last(cnpj), raised)
    return {"issuer": F.when(changed.isNotNull(), F.col("issuer").withField("cnpj", changed))}


@_misreading("digit_count")
def _last_digit_doubled() -> dict[str, Column]:
    tax_id = F.col("recipient.tax_id")
    longer = F.concat(tax_id, F.substring(tax_id, -1, 1))
    return {"recipient": F.when(tax_id != "", F.col("recipient").withField("tax_id", longer))}


@_misreading("text_near_miss")
def _last_letter_doubled() -> dict[str, Column]:
    at = _dearest()
    text = _row(at)["description"]
    longer = F.concat(text, F.substring(text, -1, 1))
    return {"items": F.when(F.length(text) > 10, _with_row(at, description=longer))}


@_misreading("text_wrong")
def _nature_mirrored() -> dict[str, Column]:
    nature, mirrored = F.col("operation_nature"), F.reverse("operation_nature")
    return {"operation_nature": F.when(nature != mirrored, mirrored)}


@_misreading("tax_code_wrong")
def _last_code_mirrored() -> dict[str, Column]:
    n = _length()
    code = _row(n)["cfop"]
    return {"items": F.when(code != F.reverse(code), _with_row(n, cfop=F.reverse(code)))}


@_misreading("date_wrong")
def _a_day_late() -> dict[str, Column]:
    return {"issue_date": F.date_add("issue_date", 1)}


@_misreading("untagged")
def _tax_of_no_kind() -> dict[str, Column]:
    tax = F.col("totals.icms_amount")
    return {"totals": _box("icms_amount", tax + tax + dec("71.03"))}


def corrupt(invoices: DataFrame, tag: str) -> DataFrame:
    """Invoices with the misreading of a tag; those it does not apply to are left out."""
    changes = MISREADINGS[tag]()
    columns = [changes.get(name, F.col(name)).alias(name) for name in invoices.columns]
    changed = invoices.select(*columns)
    return changed.dropna("any", subset=list(changes))


def expected_block(invoices: DataFrame) -> DataFrame:
    """The manifest's expected values of nested invoices."""
    return invoices.select(
        "case_id",
        F.struct(
            F.size("items").alias("item_count"),
            F.size("installments").alias("installment_count"),
            F.col("totals.invoice_total").alias("invoice_total"),
            F.col("issuer.cnpj").alias("issuer_cnpj"),
            F.col("recipient.tax_id").alias("recipient_tax_id"),
            F.col("recipient.tax_id_kind").alias("recipient_tax_id_kind"),
        ).alias("expected"),
    )


def mutate_cases(base: DataFrame, specs: Sequence[tuple[str, dict[str, Column], str]]) -> DataFrame:
    """Decision cases: each base once per spec (name, changed columns, intended decision)."""
    parts = []
    for name, changes, intended in specs:
        changed = base.withColumns(changes) if changes else base
        parts.append(
            changed.withColumns({"spec": F.lit(name), "intended": F.lit(intended)})
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def intent_problems(labelled: DataFrame) -> DataFrame:
    """Mutated cases whose label is not the intended decision."""
    return labelled.filter(F.col("decision") != F.col("intended"))
