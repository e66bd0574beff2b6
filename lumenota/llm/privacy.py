"""Personal data: fixed patterns first, then terms that give a protected value away.

Base spans are found by pattern. Every value found is a protected entity. The corpus then tells how
strongly a term in an entity's documents reveals it: with document counts of the term n(t), of the
entity n(e) and of both n(t, e), the share p = (n(t, e) + k n(e) / N) / (n(t) + k) is that of the
entity among the term's documents, drawn to its share of all by k = SMOOTHING documents. The
disclosure of t is the smoothed pointwise mutual information log(p N / n(e)), and t is a disclosing
term of e where that reaches DISCLOSURE of the information content log(N / n(e)) of the entity
itself. Terms are words outside base spans; a disclosing one becomes a span of kind ``term``
wherever it stands in the documents of its entity. ``sanitised`` replaces base spans by their kind
and removes or generalises terms.

Spans are counted in code points, end exclusive. Defined cases: a null text is empty and has no
spans; texts are read whole at any length; base spans of different kinds may overlap; repeated rows
(equal id and text) count as documents of their own and get equal spans; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import table
from lumenota.session import checkpointed

KINDS = ("email", "ip", "card", "phone")
#: The same languages as the plain patterns, written so that no position is tried twice: a match
#: can only start where a run starts, and runs are taken whole (possessive).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Documents by which a term's share is drawn to the share of all: one shared document is evidence
#: in a large table, and none in a small one.
SMOOTHING = 1 / 3
DISCLOSURE = 0.9
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+"
SPAN = "array<struct<start:int,stop:int,value:string>>"


def spans_of(
    text: Column,
    pattern: str,
    possible: Column | None = None,
    wanted: Callable[[Column], Column] | None = None,
) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (start, stop, value), in code points; of
    the matches only the ``wanted`` ones, where that is given.

    The pieces between the matches and the matches themselves alternate; their lengths add up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def build(both: Column) -> Column:
        matches, pieces = both["matches"], both["pieces"]

        def step(acc: Column, i: Column) -> Column:
            match = F.get(matches, i)
            begins = acc["at"] + F.length(F.get(pieces, i))
            ends = begins + F.length(match)
            span = F.struct(begins.alias("start"), ends.alias("stop"), match.alias("value"))
            more = F.concat(acc["spans"], F.array(span))
            if wanted is not None:
                more = F.when(wanted(match), more).otherwise(acc["spans"])
            return F.struct(ends.alias("at"), more.alias("spans"))

        every = F.sequence(F.lit(0), F.size(matches) - 1)
        return F.aggregate(every, start, step, lambda acc: acc["spans"])

    def located(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        both = F.array(F.struct(matches.alias("matches"), pieces.alias("pieces")))
        return F.when(
            F.size(matches) > 0, F.get(F.transform(both, build), F.lit(0))
        ).otherwise(none)

    searched = found if possible is None else F.when(possible, found)
    kept = F.coalesce(searched, F.array().cast("array<string>"))
    return F.get(F.transform(F.array(kept), located), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(i % 2 == 0, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The accepted spans of each kind."""
    plus, at_sign = F.instr(text, "+") > 0, F.instr(text, "@") > 0
    found = {
        "email": spans_of(text, PATTERNS["email"], at_sign),
        "ip": spans_of(text, PATTERNS["ip"]),
        "card": spans_of(text, PATTERNS["card"]),
        "phone": spans_of(text, PATTERNS["phone"], plus),
    }
    octets = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
    between = lambda s, low, high: F.length(_digits(s["value"])).between(low, high)
    return {
        "email": found["email"],
        "ip": F.filter(found["ip"], lambda s: s["value"].rlike(octets)),
        "card": F.filter(found["card"], lambda s: between(s, 12, 19) & luhn(_digits(s["value"]))),
        "phone": F.filter(found["phone"], lambda s: between(s, 9, 15)),
    }


def _all_kinds() -> Column:
    """Spans of all kinds as (start, order of kind, stop, kind, value), sorted."""

    def of_kind(at: int, kind: str) -> Column:
        return F.transform(
            F.col(f"__{kind}"),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(at).alias("at"), s["stop"].alias("stop"),
                F.lit(kind).alias("kind"), s["value"].alias("value"),
            ),
        )

    parts = [of_kind(at, kind) for at, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))  # noqa: E731, E501
    return F.array_join(F.transform(spans, one), ",")


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans, which are sorted."""

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        between = F.substring(text, acc["at"] + 1, begin - acc["at"])
        blank = F.repeat(F.lit(" "), F.greatest(s["stop"] - begin, F.lit(0)))
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.concat(acc["parts"], F.array(between, blank)).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))
    )
    return F.aggregate(spans, start, step, rest)


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, ``__base`` spans and, only where there are any, the text outside them."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("__text"))
    rows = rows.withColumns({f"__{kind}": s for kind, s in base_spans(F.col("__text")).items()})
    rows = rows.select("doc_id", "text_hash", "__text", _all_kinds().alias("__base"))
    outside = F.when(F.size("__base") > 0, _blanked(F.col("__text"), F.col("__base")))
    return rows.select("doc_id", "text_hash", "__base", outside.alias("__rest"))


def _words(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _terms(found: DataFrame) -> DataFrame:
    """One row per document, entity and term of the document."""
    entity = F.transform("__base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))
    rows = found.where(F.col("__rest").isNotNull())
    rows = rows.select(
        "doc_id", "text_hash", F.array_distinct(entity).alias("__e"),
        F.explode(_words(F.col("__rest"))).alias("term"),
    )
    rows = rows.select("doc_id", "text_hash", "term", F.explode("__e").alias("__e"))
    return rows.select("doc_id", "text_hash", "__e.kind", "__e.value", "term")


def disclosing_terms(docs: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """(kind, value, term) whose disclosure reaches the threshold, from counts of all documents."""
    pairs = terms.groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("n_both"))
    entity = F.transform("__base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))
    entities = found.select(F.explode(F.array_distinct(entity)).alias("__s")).groupBy(
        F.col("__s.kind").alias("__kind"), F.col("__s.value").alias("__value")
    ).agg(F.count(F.lit(1)).alias("n_entity"))
    same = (F.col("kind") == F.col("__kind")) & (F.col("value") == F.col("__value"))
    pairs = pairs.join(entities, same).drop("__kind", "__value")
    pairs = checkpointed(pairs)
    wanted = pairs.select(F.col("term").alias("__wanted")).distinct()
    words = docs.select(F.explode(_words(F.col("text"))).alias("__word"))
    counts = words.groupBy("__word").agg(F.count(F.lit(1)).alias("n_term"))
    counts = counts.join(wanted, F.col("__word") == F.col("__wanted")).drop("__wanted")
    n = docs.agg(F.count(F.lit(1)).alias("__n"))
    scored = pairs.join(counts, F.col("term") == F.col("__word")).crossJoin(F.broadcast(n))
    base_rate = F.col("n_entity") / F.col("__n")
    rate = (F.col("n_both") + base_rate * SMOOTHING) / (F.col("n_term") + SMOOTHING)
    shown, whole = F.log(rate / base_rate), -F.log(base_rate)
    scored = scored.withColumns({"disclosure": shown, "content": whole})
    kept = scored.where((F.col("content") > 0) & (shown >= whole * DISCLOSURE))
    return kept.select("kind", "value", "term", "disclosure", "content")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, ``base`` spans and ``terms`` spans, sorted."""
    found = checkpointed(found_spans(docs))
    terms = _terms(found)
    flagged = disclosing_terms(docs, found, terms).select(
        F.col("kind").alias("__kind"), F.col("value").alias("__value"), F.col("term").alias("__t")
    )
    same = (
        (F.col("kind") == F.col("__kind"))
        & (F.col("value") == F.col("__value"))
        & (F.col("term") == F.col("__t"))
    )
    added = terms.join(flagged, same).groupBy(
        F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")
    ).agg(F.collect_set("term").alias("__flagged"))
    own = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))
    joined = found.join(added, own, "left")
    spans = spans_of(
        F.col("__rest"), TERM, F.col("__flagged").isNotNull(),
        lambda match: F.array_contains("__flagged", F.lower(match)),
    )
    marked = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(len(KINDS)).alias("at"), s["stop"].alias("stop"),
            F.lit("term").alias("kind"), F.lower(s["value"]).alias("value"),
        ),
    )
    return joined.select("doc_id", "text_hash", F.col("__base").alias("base"), marked.alias("terms"))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in capitals; of overlapping spans the first
    stands for all. A term with a digit is generalised to ``[TERM]``, other terms are removed."""

    def step(acc: Column, s: Column) -> Column:
        shown = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        shown = shown.when(s["value"].rlike("[0-9]"), F.lit("[TERM]")).otherwise(F.lit(""))
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        apart = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(apart, F.concat(acc["out"], between, shown)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))
    )
    return F.aggregate(spans, start, step, rest)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts, digests and spans."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "terms"))).alias("spans"),
    )
