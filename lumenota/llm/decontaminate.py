"""Benchmark decontamination: MinHash containment search of short items inside long documents.

An item is far smaller than the documents that may hold it, so no Jaccard signature of a document
can show it. The sketch is therefore the item's alone: its shingles of least hash, as many as its
size class needs so that an item with THRESHOLD of its shingles in a document is missed with at
most MISS. A document that holds enough of a sketch is a candidate, and exact containment of the
item's distinct shingles, compared as text, decides. Documents are read in one pass; each of their
shingles is probed once, and only hits are shuffled.

Defined cases: a null or short text (fewer than five words) holds nothing; an item of fewer than
five words has no shingle and is never found; equal items are found under each id, repeated rows of
one item count once; repeated rows of a document (equal id and text) give one row per item; very
long texts are read whole; null ids are kept as ids; an empty table on either side gives an empty
result. Extra columns are not read, and pass through ``clean_documents``.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import GAP, boxed, table, unboxed
from lumenota.session import checkpointed

WORDS = 5
THRESHOLD = 0.8
MISS = 1e-6
#: Sketch size by size class (the octave of an item's number of shingles); small items are whole.
LARGEST_SKETCH = 16
#: Index rows that are broadcast at most (each is a hash and an item id); beyond, the probe joins
#: by shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts give one empty word."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), GAP)


def exploded_shingles(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df`` and its shingles' ``hash``, with the words array ``__w`` and the
    position ``__i`` still at hand, so that what follows stays inside one generated loop."""
    at = F.explode(F.sequence(F.lit(0), F.size("__w") - WORDS))
    shingles = df.where(F.size("__w") >= WORDS).select(*keep, "__w", at.alias("__i"))
    parts = [F.get("__w", F.col("__i") + j) for j in range(WORDS)]
    return shingles.select(*keep, "__w", "__i", F.xxhash64(*parts).alias("hash"))


def _shingle_text() -> Column:
    return F.concat_ws(" ", F.slice("__w", F.col("__i") + 1, WORDS))


def least_hits(sketch: int) -> int:
    """Hits that a containment of THRESHOLD reaches in a sketch of that size, but for MISS."""
    tail = 0.0
    for hits in range(sketch + 1):
        tail += comb(sketch, hits) * THRESHOLD**hits * (1 - THRESHOLD) ** (sketch - hits)
        if tail > MISS:
            return max(hits, 1)
    return 1


def item_shingles(items: DataFrame) -> DataFrame:
    """Distinct shingles of each item: item_id, hash, shingle and the item's ``n_item``."""
    rows = items.select("item_id", words_of(F.col("text")).alias("__w"))
    rows = exploded_shingles(rows, ["item_id"])
    rows = rows.select("item_id", "hash", _shingle_text().alias("shingle")).distinct()
    sizes = rows.groupBy(F.col("item_id").alias("__id")).agg(F.count(F.lit(1)).alias("n_item"))
    return rows.join(sizes, F.col("item_id").eqNullSafe(F.col("__id"))).drop("__id")


def sketches(shingles: DataFrame) -> DataFrame:
    """The index: hash, item_id and the hits (``least``) its size class asks for."""
    octaves = range(1, LARGEST_SKETCH.bit_length() + 1)
    size = F.lit(LARGEST_SKETCH)
    for octave in sorted(octaves, reverse=True):
        size = F.when(F.length(F.bin("n_item")) <= octave, F.lit(min(2**octave, LARGEST_SKETCH)))\
            .otherwise(size)
    bottom = shingles.groupBy("item_id", "n_item").agg(
        F.sort_array(F.collect_set("hash")).alias("__all")
    )
    bottom = bottom.withColumn("__sketch", F.slice("__all", F.lit(1), size))
    least = F.element_at(
        F.array(*[F.lit(least_hits(n)) for n in range(1, LARGEST_SKETCH + 1)]), F.size("__sketch")
    )
    return bottom.select("item_id", least.alias("least"), F.explode("__sketch").alias("__hash"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_item, n_shared, containment) of every pair at ``threshold``.

    A size class's sketch is a bounded part of each item, so one item's shingles never are too many
    for a row; the items' table as a whole may be of any size.
    """
    known = checkpointed(item_shingles(items))
    index = checkpointed(sketches(known))
    probe = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       words_of(F.col("text")).alias("__w"))
    hashed = exploded_shingles(rows, ["doc_id", "text_hash"])
    hits = hashed.select("doc_id", "text_hash", "hash").join(probe, F.col("hash") == F.col("__hash"))
    counted = hits.groupBy("doc_id", "text_hash", "item_id", "least").agg(
        F.count_distinct("hash").alias("__hits")
    )
    found = counted.where(F.col("__hits") >= F.col("least"))
    found = checkpointed(found.select("doc_id", "text_hash", "item_id"))
    # verification: the candidates' own texts against their items, shingle by shingle
    pairs = found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "item_id")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(pairs, same)
    held = held.select("doc_id", "text_hash", "item_id", words_of(F.col("text")).alias("__w"))
    held = exploded_shingles(held, ["doc_id", "text_hash", "item_id"])
    held = held.select("doc_id", "text_hash", "item_id", _shingle_text().alias("shingle"))
    target = known.select(F.col("item_id").alias("__item"), F.col("shingle").alias("__s"), "n_item")
    match = F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("shingle") == F.col("__s"))
    shared = held.join(target, match).groupBy("doc_id", "text_hash", "item_id", "n_item").agg(
        F.count_distinct("shingle").alias("n_shared")
    )
    containment = F.col("n_shared") / F.col("n_item")
    return shared.withColumn("containment", containment).where(containment >= threshold)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    bad = contaminated(docs, items).select(
        F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")
    )
    same = F.col("__row.doc_id").eqNullSafe(F.col("__d")) & (
        F.xxhash64("__row.text") == F.col("__h")
    )
    return unboxed(boxed(docs).join(checkpointed(bad.distinct()), same, "left_anti"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: one row per item that a document holds."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminated(docs, items).drop("text_hash")


OP5_SQL = """
with d as (
  select distinct doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), i as (
  select distinct item_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from benchmark
), di as (
  select doc_id, w, unnest(range(1, len(w) - 3)) as k from d where len(w) >= 5
), ii as (
  select item_id, w, unnest(range(1, len(w) - 3)) as k from i where len(w) >= 5
), ds as (
  select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from di
), si as (
  select distinct item_id, array_to_string(w[k:k + 4], ' ') as s from ii
), n as (
  select item_id, count(*) as n_item from si group by item_id
)
select ds.doc_id, si.item_id, n.n_item, count(*) as n_shared,
       count(*)::double / n.n_item::double as containment
from ds join si on ds.s = si.s join n on n.item_id = si.item_id
group by ds.doc_id, si.item_id, n.n_item
having count(*)::double / n.n_item::double >= 0.8
"""
