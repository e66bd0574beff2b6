"""Mixing sources to target weights along a time-varying curriculum.

Sources get weights by their rank in code point order and share the words of all documents; a
target stops at a multiple of its source's size and the excess goes to the others by weight. A
source's documents form a word stream in a shuffled but fixed order, walked again from its start
until the target is met, so the last copy taken may be cut by the budget. Each source has a
schedule, a weight that changes linearly over training time; its integral is the cumulative demand,
and inverting the demand at a copy's first word gives the copy's training position in [0, 1).

Defined cases: a null text has no words and is never taken; a null source is a source of its own,
last in order; repeated rows (equal id, source and text) are one unit and take equal whole shares,
rounded down; no words at all give targets of zero; an empty table gives an empty result. Extra
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import boxed, n_words, prefix_sums, ranked, table, unboxed

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Start and end of the linear schedule of each weight: heavy sources fade in, light ones fade out.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def _by_rank(values: Sequence[float]) -> Column:
    """The value a rank takes from a repeating list."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))


def source_targets(
    sources: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    most_passes: int = MOST_PASSES,
) -> DataFrame:
    """``sources`` (source, source_size) plus target, start_weight and end_weight.

    Water filling in closed form: in the order of cap per weight, the level that would hold if all
    sources before a row were capped is greatest at the first source that is not, and every target
    is the smaller of its cap and that level times its weight.
    """
    order = sources.withColumn("__last", F.col("source").isNull().cast("int"))
    order = ranked(order, ["__last", "source"], "rank").drop("__last")
    scale = 1
    for weight in weights:
        scale *= weight
    order = order.select(
        "*",
        _by_rank(weights).cast("long").alias("weight"),
        _by_rank([a for a, _ in schedules]).cast("double").alias("start_weight"),
        _by_rank([b for _, b in schedules]).cast("double").alias("end_weight"),
        (F.col("source_size") * most_passes).alias("__cap"),
    ).withColumn("__fill", F.expr(f"__cap * ({scale} div weight)"))
    placed = prefix_sums(order, ["__fill", "rank"], {"__caps": "__cap", "__weights": "weight"})
    totals = order.agg(F.sum("source_size").alias("__all"), F.sum("weight").alias("__weight"))
    level = (F.col("__all") - F.col("__caps")).cast("double") / (
        F.col("__weight") - F.col("__weights")
    ).cast("double")
    levels = placed.crossJoin(F.broadcast(totals)).agg(F.max(level).alias("__level"))
    target = F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("weight"))
    return placed.crossJoin(F.broadcast(levels)).select(
        "source", "source_size", target.alias("target"), "start_weight", "end_weight"
    )


def position_of(share: Column, start: Column, end: Column) -> Column:
    """Training time at which a schedule's integral reaches ``share`` of its whole."""
    demand = share * (start + end) / 2.0
    return demand * 2.0 / (start + F.sqrt(start * start + (end - start) * demand * 2.0))


def mix_units(docs: DataFrame, most_passes: int = MOST_PASSES) -> DataFrame:
    """One row per unit of repeated rows: ``copies`` rows, what each row takes, and its passes.

    ``takes`` is an array of (pass, words, position). Only narrow columns are shuffled.
    """
    units = (
        docs.select(
            "doc_id",
            "source",
            F.xxhash64("text").alias("__text_hash"),
            n_words(F.col("text")).alias("size"),
        )
        .groupBy("doc_id", "source", "size", "__text_hash")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("__order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("__unit", F.col("size") * F.col("copies"))
    )
    keys = ["source", "__order", "doc_id", "__text_hash"]
    placed = prefix_sums(units, keys, {"__before": "__unit"})
    sources = placed.groupBy(F.col("source").alias("__source")).agg(
        F.sum("__unit").alias("source_size"), F.min("__before").alias("__first")
    )
    targets = source_targets(sources.select(F.col("__source").alias("source"), "source_size"))
    targets = targets.withColumnRenamed("source", "__s").drop("source_size")
    sources = sources.join(targets, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    joined = placed.join(sources, F.col("source").eqNullSafe(F.col("__source")))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    joined = joined.withColumns({"__goal": goal, "__at": F.col("__before") - F.col("__first")})

    def one(number: int) -> Column:
        begins = F.col("__at") + F.col("source_size") * number
        words = F.greatest(F.least(F.col("__goal") - begins, F.col("__unit")), F.lit(0))
        share = begins.cast("double") / F.col("__goal").cast("double")
        position = position_of(share, F.col("start_weight"), F.col("end_weight"))
        return F.struct(
            F.lit(number).alias("pass"),
            F.floor(words / F.col("copies")).cast("long").alias("words"),
            F.when(words > 0, position).alias("position"),
        )

    takes = F.filter(F.array(*map(one, range(most_passes))), lambda x: x["words"] > 0)
    return joined.select(
        "doc_id", "source", "__text_hash", "copies", "size", "source_size", "target",
        takes.alias("takes"),
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """One row per document: its source's size and target, the words taken, its first position."""
    units = mix_units(docs)
    rows = units.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    add = F.aggregate("takes", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return rows.select(
        "doc_id", "size", "source_size", "target", add.alias("taken"),
        F.get(F.col("takes")["position"], F.lit(0)).alias("position"),
    )


def training_order(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, one row per document and pass taken, range-sorted by position."""
    takes = mix_units(docs).select(
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__source"),
        F.col("__text_hash").alias("__hash"),
        F.explode("takes").alias("__take"),
    )
    same = (
        F.col("__row.doc_id").eqNullSafe(F.col("__id"))
        & F.col("__row.source").eqNullSafe(F.col("__source"))
        & (F.xxhash64("__row.text") == F.col("__hash"))
    )
    mixed = boxed(docs).join(takes, same)
    return unboxed(mixed.orderBy("__take.position", "__id"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each, in training order."""
    return mix_documents(table(spark, sf_dir, "documents")).orderBy("position", "doc_id")


OP3_SQL = """
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as o,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source is null, encode(source)) - 1 as r
  from d group by source
), w as (
  select *, [5, 2, 1][r % 3 + 1]::bigint as weight, [0.5, 1.0, 1.5][r % 3 + 1]::double as a,
         [1.5, 1.0, 0.5][r % 3 + 1]::double as b, 3 * source_size as cap
  from s
), f as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as lev
  from w window before as (order by cap * (10 // weight), r
                           rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, a, b, least(cap::double, (max(lev) over ()) * weight) as target
  from f
), p as (
  select d.doc_id, d.size, t.source_size, t.target, t.a, t.b,
         floor(t.target + 0.5)::bigint as goal,
         coalesce(sum(d.size) over (partition by d.source order by d.o
                  rows between unbounded preceding and 1 preceding), 0)::bigint as seat
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (greatest(least(goal - seat, size), 0) + greatest(least(goal - seat - source_size, size), 0)
        + greatest(least(goal - seat - 2 * source_size, size), 0))::bigint as taken,
       case when least(goal - seat, size) > 0 then
         ((seat::double / goal::double) * (a + b) / 2.0) * 2.0
         / (a + sqrt(a * a + (b - a) * ((seat::double / goal::double) * (a + b) / 2.0) * 2.0))
       end as position
from p
"""
