"""How filters of a corpus interact: what each removes in every order, and its fair share.

A document's failures of the five filters are five bits. Per part of the corpus the documents of each
of the 32 bit sets are counted; everything else follows from those counts. The game of a part gives a
coalition S of filters the number of documents that S removes, v(S). Its Hart-Mas-Colell potential is
P(S) = (v(S) + sum of P(S without i) over i in S) / |S| with P of nothing 0; the Shapley value of a
filter is the potential of all filters less that of all the others. The recursion runs on
|S|! * P(S), which is whole. What a filter removes at its step of an order is the difference of v
with and without it.

Defined cases: a null text is empty, a null part is the empty string and shares the part of empty
strings. A row without an id is no copy and has none. Of repeated rows with equal id and text all count, and none is a copy of the
other. Several label rows of one document flag it if any does; null labels flag nothing. An empty
table gives an empty result; very long texts are counted whole, one text at a time; extra columns are
not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import WORD, stored, table

#: Few words, few distinct words, many capitals, reserved characters, copies.
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
RESERVED = "[#$%&*|]"


def _bit(test: Column, place: int) -> Column:
    return F.when(test, F.lit(1 << place)).otherwise(F.lit(0))


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that ``text`` (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("kinds"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(n: Column) -> Column:
        return (
            _bit(n["words"] < MIN_WORDS, 0)
            + _bit(n["kinds"] * F.lit(100).cast("long") < n["words"] * MIN_DISTINCT_PERCENT, 1)
            + _bit(capitals * F.lit(100).cast("long") > F.length(text) * MAX_CAPITAL_PERCENT, 2)
            + _bit(text.rlike(RESERVED), 3)
        )

    return F.get(F.transform(F.array(counts), bits), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (``n``), good and toxic ones by ``part`` and ``failed``, the bit set of failures.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic. Texts stay in the scan:
    they are read once, what is stored and shuffled is a digest of each. The join with the least id
    of a text is on digest and id, so a large group of copies is spread; so are rows without an id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select(
            "doc_id",
            F.coalesce(F.col("source"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            text_failures(text).alias("bits"),
        )
        .groupBy("doc_id", "part", "digest", "bits")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = stored(rows, "failures")
    flags = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    spread = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit(b""))
    flagged = rows.withColumn("spread", spread).join(
        flags.withColumn("spread", F.lit(b"")), ["doc_id", "spread"], "left"
    )
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    least = least.filter("doc_id is not null").withColumn("is_first", F.lit(True))
    marked = flagged.join(least, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return (
        marked.withColumn("failed", F.col("bits") + _bit(copy, 4))
        .groupBy("part", "failed")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )


def _removed(counts: Column, coalitions: int) -> Column:
    """Rows that each coalition removes: those with a failure among its filters."""
    every = F.sequence(F.lit(0), F.lit(coalitions - 1))
    return F.transform(
        every,
        lambda s: F.aggregate(
            F.transform(
                counts, lambda n, m: F.when(m.bitwiseAND(s) != 0, n).otherwise(F.lit(0).cast("long"))
            ),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        ),
    )


def scaled_potentials(worth: Column, players: int) -> Column:
    """|S|! * P(S) of the game ``worth`` (an array by coalition), for every coalition S in order."""
    shares = F.array(*[F.lit(factorial(k)).cast("long") for k in range(players)])

    def step(known: Column, s: Column) -> Column:
        own = F.get(worth, s) * F.get(shares, F.bit_count(s) - 1)
        for i in range(players):
            without = F.get(known, s - (1 << i))
            own = own + F.when(s.bitwiseAND(F.lit(1 << i)) != 0, without).otherwise(F.lit(0))
        return F.concat(known, F.array(own))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit((1 << players) - 1)),
        F.array(F.lit(0).cast("long")),
        step,
    )


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from counts by part and failed filters."""
    size, sets = len(filters), 1 << len(filters)
    whole = sets - 1

    def by_set(column: str) -> Column:
        cells = [F.sum(F.when(F.col("failed") == m, F.col(column))) for m in range(sets)]
        return F.array(*[F.coalesce(c, F.lit(0).cast("long")) for c in cells]).alias(column)

    parts = counts.groupBy("part").agg(*[by_set(c) for c in ("n", "good", "toxic")])
    parts = parts.select(
        "part",
        "n",
        F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("documents"),
        *[_removed(F.col(c), sets).alias(f"v_{c}") for c in ("n", "good", "toxic")],
    ).withColumn("potential", scaled_potentials(F.col("v_n"), size))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(size)))
    )
    bit = {f: 1 << i for i, f in enumerate(filters)}
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit_of = F.create_map(*[F.lit(x) for pair in bit.items() for x in pair])
    before = F.aggregate(
        F.sequence(F.lit(0), F.col("step")),
        F.lit(0),
        lambda s, k: s
        + F.when(
            (k > 0) & (k < F.col("step")), bit_of[F.substring("filter_order", k, F.lit(1))]
        ).otherwise(F.lit(0)),
    )
    steps = steps.withColumn("own", bit_of[letter]).withColumn("before", before)
    at = lambda array, s: F.get(F.col(array), s)
    after = F.col("before") + F.col("own")
    gain = lambda array: at(array, after) - at(array, F.col("before"))
    scale = factorial(size)
    return steps.select(
        "part",
        "filter_order",
        "step",
        letter.alias("filter"),
        (F.col("documents") - at("v_n", after)).alias("kept"),
        gain("v_n").alias("removed"),
        (at("v_n", F.col("own")) - gain("v_n")).alias("redundant"),
        at("n", F.col("own")).alias("unique_fails"),
        gain("v_good").alias("good_lost"),
        gain("v_toxic").alias("toxic_lost"),
        (
            at("potential", F.lit(whole)) * (scale // factorial(size))
            - at("potential", F.lit(whole) - F.col("own")) * (scale // factorial(size - 1))
        ).alias("shapley"),
    )


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents: 120 orders of 5 steps for each source."""
    counts = failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions(counts)


#: Walks every order document set by document set and sums the removals of all orders.
OP11_SQL = r"""
with recursive marks as (
  select d.doc_id, coalesce(d.source, '') part, coalesce(d.text, '') body,
    regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') words
  from documents d),
flags as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) good,
    max(case when toxic = 1 then 1 else 0 end) toxic
  from labels where doc_id is not null group by doc_id),
least as (select coalesce(text, '') body, min(doc_id) first from documents group by 1),
failing as (
  select m.part, coalesce(f.good, 0) good, coalesce(f.toxic, 0) toxic,
    case when len(m.words) < 50 then 'A' else '' end
    || case when 100 * len(list_distinct(m.words)) < 65 * len(m.words) then 'B' else '' end
    || case when 100 * length(regexp_replace(m.body, '[^A-Z]+', '', 'g')) > 5 * length(m.body)
         then 'C' else '' end
    || case when regexp_matches(m.body, '[#$%&*|]') then 'D' else '' end
    || case when l.first < m.doc_id or (m.doc_id is null and l.first is not null)
         then 'E' else '' end fails
  from marks m join least l on l.body = m.body left join flags f on f.doc_id = m.doc_id),
sets as (
  select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from failing group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) letter),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter filter_order
  from letters a, letters b, letters c, letters d, letters e
  where length(replace(replace(replace(replace(replace('ABCDE', a.letter, ''), b.letter, ''),
    c.letter, ''), d.letter, ''), e.letter, '')) = 0),
steps as (
  select filter_order, step, substr(filter_order, step, 1) letter,
    substr(filter_order, 1, step - 1) earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) step)),
walked as (
  select p.part, s.filter_order, s.step, s.letter,
    sum(case when translate(fails, earlier || letter, '') = fails then n else 0 end) kept,
    sum(case when translate(fails, earlier, '') = fails and contains(fails, letter)
      then n else 0 end) removed,
    sum(case when translate(fails, earlier, '') <> fails and contains(fails, letter)
      then n else 0 end) redundant,
    sum(case when fails = letter then n else 0 end) unique_fails,
    sum(case when translate(fails, earlier, '') = fails and contains(fails, letter)
      then good else 0 end) good_lost,
    sum(case when translate(fails, earlier, '') = fails and contains(fails, letter)
      then toxic else 0 end) toxic_lost
  from sets p, steps s group by 1, 2, 3, 4)
select part, filter_order, cast(step as integer) step, letter as "filter",
  cast(kept as bigint) kept,
  cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost,
  cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) shapley
from walked
"""
