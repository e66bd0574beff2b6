"""Exact removal of long repeated byte strings across all documents.

A byte goes when a string of LENGTH bytes that covers it starts at a second place anywhere. Every
such window is filed under its anchor, the GRAM-byte string in it with the least hash (the leftmost
of equals): equal windows have equal anchors at equal offsets, and neighbouring windows mostly
share theirs, so a document is a list of runs of windows, one anchor each. Counting runs settles
most of them: equal whole runs are repeated, runs whose anchor is unique are not. The rest is split
into blocks aligned to the anchor and counted again, and what blocks leave open is counted window
by window. Only hashes and positions are shuffled for that, with sums made before the shuffle.

The method this stands in for builds the suffix array of all documents column by column, a pass over
the whole collection for each symbol of the longest document; README gives the figures.

Windows never cross documents. Defined cases: a null text has no bytes; texts shorter than LENGTH
lose nothing; very long texts are read in overlapping pieces, whole; repeated rows are copies of
each other and lose all their windows; a table of one text loses only what repeats inside it; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import slices, stored, table
from lumenota.session import checkpointed

LENGTH = 400
GRAM = 64
#: Windows of an open run are counted in blocks of this many, then one by one.
BLOCK = 8
#: Windows of a text that are hashed at once.
PIECE = 1 << 20
_TURN = 2 << 20

_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A full avalanche of 64 bits."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


class Hashes:
    """Hashes of any byte range of ``data`` from running sums of weighted byte values."""

    up = _powers(_BASE, 1)
    down = _powers(pow(_BASE, -1, 2**64), 1)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if len(Hashes.up) <= n:
            Hashes.up = _powers(_BASE, n + n // 4 + 1)
            Hashes.down = _powers(pow(_BASE, -1, 2**64), n + n // 4 + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * Hashes.up[:n], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[begins]) * Hashes.down[begins]
        return _mixed(value + (ends - begins).astype(np.uint64))


def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows by anchor: text, anchor's place, first and last window, the hashes of the
    anchor and of the whole run."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in ("i8", "i8", "i8", "i8", "u8", "u8"))
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    low = _U((1 << 24) - 1)
    keys = (grams & ~low) | at.astype(np.uint64)
    width = LENGTH - GRAM + 1  # least key of each window, from least keys of halves of blocks
    padded = np.append(keys, np.full(-len(keys) % width, 2**64 - 1, np.uint64)).reshape(-1, width)
    upto = np.minimum.accumulate(padded, axis=1).ravel()
    since = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(since[:n], upto[width - 1 : width - 1 + n]) & low).astype(np.int64)
    start = np.arange(n)
    doc = np.searchsorted(ends, start, side="right")
    inside = start + LENGTH <= ends[doc]
    breaks = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(inside & np.append(True, breaks | ~inside[:-1]))
    last = np.flatnonzero(inside & np.append(breaks | ~inside[1:], True))
    begins = np.append(0, ends)[doc[first]]
    place = anchor[first]
    whole = hashes.of(first, last + LENGTH)
    return doc[first], place - begins, first - begins, last - begins, grams[place], whole


#: A run of windows in one number: its first window, how far the anchor lies behind that, and how
#: far the last window does; the latter two are less than LENGTH.
_BITS = 10
_OUT = ("key", "run", "core", "whole")
_OUT_SQL = ", ".join(f"{name} long" for name in _OUT)


def _run(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << 2 * _BITS) | ((place - first) << _BITS) | (last - first)


def _unrun(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, low = run >> 2 * _BITS, (1 << _BITS) - 1
    return first + ((run >> _BITS) & low), first, first + (run & low)


def _batch(key: np.ndarray, run: np.ndarray, core: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    columns = [key, run, core.view(np.int64), whole.view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(_OUT))


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, int, list[bytes]]]:
    """Short texts together, long ones in overlapping pieces: rows, offset, byte strings."""
    short = [i for i, t in enumerate(texts) if LENGTH <= len(t) <= PIECE]
    if short:
        yield np.array(short), 0, [texts[i] for i in short]
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            for at in range(0, len(text) - LENGTH + 1, PIECE):
                yield np.array([i]), at, [text[at : at + PIECE + LENGTH - 1]]


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for begin, texts in slices(batch.column("text"), _TURN):
            for rows, offset, pieces in _pieces(texts):
                doc, place, first, last, core, whole = _runs(pieces)
                run = _run(place + offset, first + offset, last + offset)
                yield _batch(keys[rows[doc] + begin], run, core, whole)


def _split_runs(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of ``width`` windows, aligned to the anchor, of the runs listed with each text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            texts = batch.column("text").cast(pa.large_binary())
            for key, text, runs in zip(keys, texts, batch.column("runs"), strict=True):
                own = np.sort(runs.values.to_numpy())
                first = own >> 2 * _BITS
                # runs far apart in a very long text are hashed apart
                breaks = np.flatnonzero(np.diff(first // PIECE)) + 1
                for some in np.split(own, breaks):
                    run, core, whole = _blocks(text.as_py(), some, width)
                    yield _batch(np.full(len(run), key), run, core, whole)

    return split


def _blocks(text: bytes, runs: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    place, first, last = _unrun(runs)
    low, high = int(first.min()), int(last.max()) + LENGTH
    hashes = Hashes(np.frombuffer(text, np.uint8)[low:high])
    top, bottom = (place - last) // width, (place - first) // width
    counts = bottom - top + 1
    owner = np.repeat(np.arange(len(runs)), counts)
    block = top[owner] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    end = place[owner] - block * width  # the last window the block can have
    begin = end - width + 1
    own_first, own_last = np.maximum(begin, first[owner]), np.minimum(end, last[owner])
    core = hashes.of(end - low, begin + LENGTH - low)  # the bytes all its windows share
    whole = hashes.of(own_first - low, own_last + LENGTH - low)
    return _run(place[owner], own_first, own_last), core, whole


def _counted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated pieces, and the pieces that are still open with one of each repeated kind that
    shares their core."""
    kinds = found.groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("run").alias("run")
    )
    kinds = stored(kinds, "repeat-kinds")
    many = kinds.where("n >= 2").select(F.col("core").alias("__c"), F.col("whole").alias("__w"))
    same = (F.col("core") == F.col("__c")) & (F.col("whole") == F.col("__w"))
    repeated = found.join(many, same).select("key", "run").distinct()
    mixed = kinds.groupBy(F.col("core").alias("__c")).agg(F.count(F.lit(1)).alias("__kinds"))
    mixed = mixed.where("__kinds >= 2")
    open_ = kinds.join(mixed, F.col("core") == F.col("__c"))
    return repeated, open_.select("key", "run")


def _with_runs(texts: DataFrame, runs: DataFrame) -> DataFrame:
    listed = runs.groupBy(F.col("key").alias("__k")).agg(F.collect_set("run").alias("runs"))
    return texts.join(listed, F.col("key") == F.col("__k")).select("key", "text", "runs")


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by windows, from first and last windows; touching runs join."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.append(True, begin[1:] > end[:-1])
    starts = np.flatnonzero(new)
    return begin[starts], end[np.append(starts[1:] - 1, len(end) - 1)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        rows = []
        texts = batch.column("text").cast(pa.large_binary())
        for value, runs in zip(texts, batch.column("runs"), strict=True):
            text = value.as_py()
            _, first, last = _unrun(runs.values.to_numpy())
            begins, ends = (x.tolist() for x in _spans(first, last))
            kept, at = sha256(), 0
            for begin, end in zip(begins, ends, strict=True):
                kept.update(text[at:begin])
                at = end
            kept.update(text[at:])
            spans = [{"begin": b, "end": e} for b, e in zip(begins, ends, strict=True)]
            rows.append((sum(ends) - sum(begins), len(begins), kept.hexdigest(), spans))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(span))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *map(pa.array, columns, kinds)],
            names=["key", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row per text that loses bytes: key (a hash of the text), n_removed, n_spans, kept_sha256
    and the removed ``spans`` (begin, end) in bytes.

    All documents are counted; after that only one document of each text is looked at again.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    keyed = keyed.where(F.octet_length("text") >= LENGTH)
    runs = keyed.select("key", "text").mapInArrow(_find_runs, _OUT_SQL)
    repeated, open_ = _counted(stored(runs, "repeat-runs"))
    covers = [stored(repeated, "repeat-covers")]
    open_ = stored(open_, "repeat-open")
    held = covers[0].select("key").union(open_.select("key")).distinct()
    held = held.select(F.col("key").alias("__k"))
    # copies are counted down to one document before anything is joined
    one = keyed.groupBy("key").agg(F.min("doc_id").alias("__d"))
    one = one.join(held, F.col("key") == F.col("__k"), "left_semi")
    one = stored(one.select("__d", F.col("key").alias("__k")), "repeat-ids")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("key") == F.col("__k"))
    # the ids grow with the documents, so they are merged and not broadcast at any size
    texts = stored(keyed.join(one.hint("merge"), same).select("key", "text"), "repeat-texts")
    for width in (BLOCK, 1):
        found = _with_runs(texts, open_).mapInArrow(_split_runs(width), _OUT_SQL)
        repeated, open_ = _counted(stored(found, "repeat-blocks"))
        covers.append(repeated)
    covered = covers[0].union(covers[1]).union(covers[2])
    cut = _with_runs(texts, covered).mapInArrow(
        _cut,
        "key long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<begin:long,end:long>>",
    )
    return cut.dropDuplicates(["key"])


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what they lose and the digest of what stays."""
    docs = table(spark, sf_dir, "documents")
    cut = repeated_bytes(docs).select(
        F.col("key").alias("__k"), "n_removed", "n_spans", "kept_sha256"
    )
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("__sha"),
    )
    zero = F.lit(0).cast("long")
    # kept apart from the rows, so that many copies of one text are split in the join
    joined = own.join(checkpointed(cut), F.col("key") == F.col("__k"), "left")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "__sha").alias("kept_sha256"),
        # the finding itself: whether the document repeats anything, and how much of it
        F.col("n_removed").isNotNull().alias("has_repeats"),
        F.coalesce(F.col("n_removed") / F.col("n_bytes"), F.lit(0.0)).alias("removed_share"),
    )
