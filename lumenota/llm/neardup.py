"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, weight = count in the text times the inverse
document frequency 1 + log(N / n), with n of N documents holding the shingle and n taken as at least
COMMON of N: what more documents than that share is boilerplate and weighs less, while the shingles
of a large group of near copies weigh what the changed ones do. Two texts are linked where their weighted
Jaccard similarity is THRESHOLD or more. Signatures of consistent weighted samples in bands propose
pairs, the exact weighted Jaccard similarity decides, and classes are connected components.

Shingles reach their document counts through one shuffle of packed hashes, after the most common
ones, a bounded number, have been counted apart so that none fills a bucket. A shingle of one document cannot
be shared, so only its weight matters: it is dropped there, a document keeps the sum, and its
sample takes part as one exponential draw of that total weight. A text whose shared weight is under
THRESHOLD of its whole weight cannot be linked at all and leaves before it is signed.

Words are runs of characters other than ASCII white space, as they stand. Defined cases: null and
short texts (fewer than five words) have no shingle and are only equal to equal texts; equal texts
are one text, whatever their ids; repeated rows count as documents of their own; very long texts
are used whole; ties take the smaller key; a class is named by its least doc_id (null where all are
null); an empty table gives an empty result. Extra columns are not read and pass through
``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenota.llm.common import boxed, n_words, slices, stored, table, unboxed
from lumenota.operators.components import components
from lumenota.session import checkpointed

WORDS = 5
THRESHOLD = 0.8
#: Share of all documents up to which shingles are taken as equally rare.
COMMON = 0.1
#: A pair at the threshold shares no band with probability (1 - 0.8**ROWS)**BANDS, about 1e-5.
BANDS = 16
ROWS = 3
#: Bytes of text whose shingles meet in one bucket; the number of buckets grows with the input.
BUCKET_BYTES = 10 << 20
_TURN = 1 << 20
#: Very common shingles, whose document counts are found beforehand, are at most this many.
MOST_FREQUENT = 1_000_000
#: Pairs of texts of different classes that a bucket may have for each of its texts to be compared
#: one by one; larger buckets are first joined along a chain and then compared in blocks.
PARTNERS = 16
#: Texts on each side of a block.
BLOCK = 256

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


class _Powers:
    """Powers of the hash's base and of its inverse, kept as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (
                np.multiply.accumulate(np.append(_U(1), np.full(n + n // 4, base % 2**64, np.uint64)))
                for base in (_PRIME, pow(_PRIME, -1, 2**64))
            )
        return cls.up[:n], cls.down[:n]


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _U(_PRIME))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of every text, in order of place."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    gap = _IS_GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    begin, end = edge[::2], edge[1::2]
    up, down = _Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], up[:-1], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    words = _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(np.cumsum(lengths), begin, side="right")
    n = len(words) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, WORDS):
        h = h * _U(0xD6E8FEB86659FD93) + words[j : n + j]
    own = doc[:n] == doc[WORDS - 1 :]
    return doc[:n][own], _mixed(h[own])


def _grouped(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with counts, sorted by row, then hash."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.flatnonzero(
        np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))
    ) if len(rows) else np.zeros(0, np.int64)
    return rows[new], hashes[new], np.diff(np.append(new, len(rows)))


_PACKED = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])
_PACKED_SQL = "bucket long, packed binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other behind their types and lengths."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for part in data[4:at].decode().split(";"):
        kind, n = part.split(",")
        out.append(np.frombuffer(data, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _parts(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted array."""
    values, begins = np.unique(numbers, return_index=True)
    ends = np.append(begins[1:], len(numbers))
    for value, a, b in zip(values.tolist(), begins.tolist(), ends[: len(begins)].tolist(), strict=True):
        yield value, slice(a, b)


def _turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per turn of texts: keys, copies and shingle totals of its distinct texts, then rows, hashes
    and counts of their distinct shingles."""
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for first, texts in slices(batch.column("text"), _TURN):
            own = keys[first : first + len(texts)]
            own, at, copies = np.unique(own, return_index=True, return_counts=True)
            rows, hashes = shingle_hashes([texts[i] for i in at])
            totals = np.bincount(rows, minlength=len(own)).astype(np.uint32)
            yield own, copies.astype(np.uint32), totals, *_grouped(rows, hashes)


_COUNT_SQL = "hash long, n long"


def _held(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.searchsorted(known, hashes).clip(max=len(known) - 1)] == hashes


def _counts(known: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents per shingle and turn: of the known shingles, or of those two documents share."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, copies, _, rows, hashes, _ in _turns_of(batches):
            if known is not None:
                kept = _held(hashes, known)
                rows, hashes = rows[kept], hashes[kept]
            values, inverse = np.unique(hashes, return_inverse=True)
            n = np.bincount(inverse, weights=copies[rows], minlength=len(values)).astype(np.int64)
            if known is None:
                values, n = values[n >= 2], n[n >= 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(n)], names=["hash", "n"]
            )

    return count


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of very common shingles and the exact number of documents of each.

    Common is more than one in MOST_FREQUENT of all shingles of all documents, so there are at most
    MOST_FREQUENT of them at any size of input; they travel with the tasks.
    """
    words = F.greatest(n_words(F.col("text")) - (WORDS - 1), F.lit(0))
    least = max(2, (rows.agg(F.sum(words)).first()[0] or 0) // MOST_FREQUENT)
    total = lambda known: rows.mapInArrow(_counts(known), _COUNT_SQL).groupBy("hash").agg(
        F.sum("n").alias("n")
    )
    some = total(None).where(F.col("n") >= least).select("hash").toArrow().column(0).to_numpy()
    known = np.sort(some.view(np.uint64))
    if not len(known):
        return known, np.zeros(0, np.int64)
    exact = total(known).toArrow()
    hashes = exact.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], exact.column("n").to_numpy()[order]


def _shingle_packs(
    buckets: int, common: np.ndarray, documents: np.ndarray
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per turn of texts and bucket: keys, shingle totals, copies and numbers of shingles of texts;
    six bytes of each hash (the bucket holds the rest); counts of shingles that repeat in a text.

    Common shingles go straight to the groups of their texts (negative buckets), as their document
    counts are known: no bucket gathers the many texts of one shingle.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, copies, totals, rows, hashes, counts in _turns_of(batches):
            numbers, packs = [], []
            known = _held(hashes, common)
            if known.any():
                r, h, c = rows[known], hashes[known], counts[known]
                group = (own[r].view(np.uint64) % _U(buckets)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                r, h, c = r[order], h[order], c[order]
                held = documents[np.searchsorted(common, h)]
                for number, at in _parts(group[order]):
                    numbers.append(-1 - number)
                    packs.append(
                        _pack(own[r[at]], totals[r[at]], _mixed(~h[at]),
                              c[at].astype(np.uint32), held[at])
                    )
                rows, hashes, counts = rows[~known], hashes[~known], counts[~known]
            bucket = (hashes & _U(0xFFFFFFFF)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            rows, hashes, counts = rows[order], hashes[order], counts[order]
            for number, at in _parts(bucket[order]):
                texts, n = np.unique(rows[at], return_counts=True)
                six = (hashes[at] >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                more = np.flatnonzero(counts[at] > 1)
                numbers.append(int(number))
                packs.append(
                    _pack(own[texts], totals[texts], copies[texts], n.astype(np.uint32),
                          np.ascontiguousarray(six).ravel(), more.astype(np.uint32),
                          counts[at][more].astype(np.uint32))
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(packs, pa.binary())], schema=_PACKED
            )

    return pack


def _shared_packs(groups: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket: the shingles of two documents or more, packed for each group of texts."""

    def share(packs: pa.Table) -> pa.Table:
        bucket = packs.column("bucket")[0].as_py()
        if bucket < 0:  # common shingles: already packed for their group
            number = pa.array(np.full(len(packs), -1 - bucket))
            return pa.Table.from_arrays([number, packs.column("packed")], schema=_PACKED)
        parts = [_unpack(x.as_py()) for x in packs.column("packed")]
        key, total, copies = (
            np.concatenate([np.repeat(p[i], p[3]) for p in parts]) for i in range(3)
        )
        wide = np.zeros((len(key), 8), np.uint8)
        wide[:, :6] = np.concatenate([p[4] for p in parts]).reshape(-1, 6)
        rest = wide.view(np.uint64).ravel()
        times = np.ones(len(key), np.uint32)
        offset = 0
        for p in parts:
            times[p[5] + offset] = p[6]
            offset += len(p[4]) // 6
        del parts, wide
        order = np.argsort(rest, kind="stable")
        sorted_ = rest[order]
        new = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        n = np.add.reduceat(copies[order].astype(np.int64), new)
        documents = np.empty(len(key), np.int64)
        documents[order] = np.repeat(n, np.diff(np.append(new, len(order))))
        kept = np.flatnonzero(documents >= 2)
        group = (key[kept].view(np.uint64) % _U(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        kept, group = kept[order], group[order]
        name = _mixed(rest[kept] * _U((2 * bucket + 1) % 2**64) + _U(bucket))
        rows = [
            (number, _pack(key[kept[at]], total[kept[at]], name[at], times[kept[at]],
                           documents[kept[at]]))
            for number, at in _parts(group)
        ]
        numbers, packed = zip(*rows, strict=True) if rows else ([], [])
        return pa.Table.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], schema=_PACKED
        )

    return share


def _draws(names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name for sample k: r and log c with c and r from Gamma(2, 1), and beta uniform."""
    h = _mixed(names + _U(_PRIME * (2 * k + 1) % 2**64))
    g = _mixed(h ^ _U(0xA0761D6478BD642F))
    unit = lambda x: (x.astype(np.float64) + 0.5) * 2.0**-32
    low, high = _U(0xFFFFFFFF), _U(32)
    r = -np.log(unit(h & low) * unit(h >> high))
    c = -np.log(unit(g & low) * unit(g >> high))
    return r, np.log(c), unit(_mixed(g) & low)


def band_keys(
    key: np.ndarray, begins: np.ndarray, names: np.ndarray, weights: np.ndarray, alone: np.ndarray
) -> np.ndarray:
    """A band key for each text and band, zero where a sample of the band is a shingle of no other.

    Texts are runs of (names, weights) from ``begins``; ``alone`` is their unshared weight.
    """
    n = len(begins)
    size = np.diff(np.append(begins, len(names)))
    owner = np.repeat(np.arange(n), size)
    log_w = np.log(weights)
    out = np.zeros((n, BANDS), np.uint64)
    for band in range(BANDS):
        code = np.full(n, band + 1, np.uint64)
        good = np.ones(n, bool)
        for row in range(ROWS):
            k = band * ROWS + row
            r, log_c, beta = _draws(names, k)
            t = np.floor(log_w / r + beta)
            value = log_c - r * (t - beta + 1.0)
            least = np.minimum.reduceat(value, begins)
            hit = np.flatnonzero(value == least[owner])
            first = hit[np.unique(owner[hit], return_index=True)[1]]
            seed = _U((k + 1) * _PRIME % 2**64)
            unit = ((_mixed(key.view(np.uint64) + seed) >> _U(11)) + 0.5) * 2.0**-53
            with np.errstate(divide="ignore"):
                other = np.log(-np.log1p(-unit)) - np.log(alone)
            good &= least <= other
            code = _mixed(code * _U(_PRIME) + names[first] + t[first].astype(np.int64).view(np.uint64))
        out[:, band] = np.where(good, code | _U(1), _U(0))
    return out


_SIGNED = pa.schema(
    [("key", pa.int64()), ("weight", pa.float64()), ("bands", pa.list_(pa.int64())),
     ("shared", pa.binary())]
)
_SIGNED_SQL = "key long, weight double, bands array<long>, shared binary"


def _signatures(documents: int) -> Callable[[pa.Table], pa.Table]:
    """Of one group of texts: weight, band keys and shared shingles of those that can be linked."""
    limit = 1.0 + log(1.0 / COMMON)
    top = min(1.0 + log(documents), limit)

    def sign(packs: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in packs.column("packed")]
        key, total, name, times, held = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((name, key))
        key, total, name, times, held = (c[order] for c in (key, total, name, times, held))
        new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))  # equal texts: once
        key, total, name, times, held = (c[new] for c in (key, total, name, times, held))
        weight = times * np.minimum(1.0 + log(documents) - np.log(held), limit)
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.add.reduceat(weight, begins)
        alone = (total[begins] - np.add.reduceat(times.astype(np.int64), begins)) * top
        alone = np.maximum(alone, 0.0)
        fit = shared >= THRESHOLD * (shared + alone) * (1 - 1e-9)
        size = np.diff(np.append(begins, len(key)))
        inside = np.repeat(fit, size)
        key, name, weight = key[inside], name[inside], weight[inside]
        size, whole, alone = size[fit], (shared + alone)[fit], alone[fit]
        if not len(size):
            return pa.Table.from_batches([], _SIGNED)
        begins = np.cumsum(size) - size
        bands = np.concatenate(
            [_some_bands(key, begins, size, name, weight, alone, some)
             for some in _turns(size)]
        ).view(np.int64)
        packed = []
        for a, b in zip(begins.tolist(), (begins + size).tolist(), strict=True):
            values, code = np.unique(weight[a:b], return_inverse=True)
            code = code.astype(np.uint8 if len(values) < 256 else np.uint32)
            packed.append(_pack(name[a:b], values, code))
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())
        )
        return pa.Table.from_arrays(
            [pa.array(key[begins]), pa.array(whole), lists, pa.array(packed, pa.binary())],
            schema=_SIGNED,
        )

    return sign


def _turns(size: np.ndarray) -> list[np.ndarray]:
    """Texts in turns of about 100,000 shingles."""
    turn = np.cumsum(size) // 100_000
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff(turn)) + 1)


def _some_bands(key, begins, size, name, weight, alone, some) -> np.ndarray:  # noqa: ANN001
    a, b = begins[some[0]], begins[some[-1]] + size[some[-1]]
    own = begins[some]
    return band_keys(key[own], own - a, name[a:b], weight[a:b], alone[some])


def weighted_jaccard(left: bytes, left_weight: float, right: bytes, right_weight: float) -> float:
    """Of two texts, from their packed shared shingles and whole weights."""
    a, b = _unpack(left), _unpack(right)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][a[2][i]], b[1][b[2][j]]).sum())
    return common / (left_weight + right_weight - common)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("pa", "wa", "pb", "wb")]
        scores = [
            weighted_jaccard(*(x.as_py() for x in (p, w, q, v)))
            for p, w, q, v in zip(*columns, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())],
            names=["a", "b", "similarity"],
        )


def _linked(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough, with their similarity."""
    side = lambda c: signed.select(
        F.col("key").alias(f"__{c}"), F.col("shared").alias(f"p{c}"), F.col("weight").alias(f"w{c}")
    )
    both = pairs.join(side("b"), F.col("b") == F.col("__b")).drop("__b")
    both = both.join(side("a"), F.col("a") == F.col("__a")).drop("__a")
    scored = both.mapInArrow(_compare, "a long, b long, similarity double")
    return scored.where(F.col("similarity") >= THRESHOLD)


def signed_texts(docs: DataFrame) -> DataFrame:
    """key, weight, bands and packed shingles of every distinct text that can have a link."""
    rows = docs.select(F.xxhash64("text").alias("key"), "text").where("text is not null")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    buckets = max(1, (size or 0) // BUCKET_BYTES + 1)
    packs = rows.mapInArrow(_shingle_packs(buckets, *frequent_shingles(rows)), _PACKED_SQL)
    shared = packs.groupBy("bucket").applyInArrow(_shared_packs(buckets), _PACKED_SQL)
    signed = shared.groupBy("bucket").applyInArrow(_signatures(max(n, 1)), _SIGNED_SQL)
    return stored(signed, "neardup-signed")


def _between_classes(bands: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of texts of different classes in one bucket whose weights allow a link; the bands
    of crowded buckets.

    All such pairs, where they are at most PARTNERS times the bucket's texts. In larger buckets each
    class is represented by its least text, and these are compared in a chain; ``_crowded_links``
    compares what is left there.
    """
    named = bands.join(classes, F.col("key") == F.col("node"), "left").drop("node")
    named = checkpointed(named.withColumn("component", F.coalesce("component", "key")))
    parts = named.groupBy("band", "component").agg(
        F.min("key").alias("least"), F.count(F.lit(1)).alias("n")
    )
    largest = F.max(F.struct("n", "component"))["component"]
    buckets = parts.groupBy(F.col("band").alias("__band")).agg(
        largest.alias("__largest"),
        ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("__pairs"),
        F.sum("n").alias("__n"),
    )
    buckets = checkpointed(buckets.where("__pairs > 0"))
    small = F.col("__pairs") <= F.col("__n") * PARTNERS
    some = named.join(buckets.where(small), F.col("band") == F.col("__band"))
    outside = some.where("component <> __largest").select(
        "band", F.col("key").alias("a"), F.col("component").alias("ca"), F.col("weight").alias("wa")
    )
    others = some.select(
        F.col("band").alias("__b"), F.col("key").alias("b"), F.col("component").alias("cb"),
        F.col("weight").alias("wb"), (F.col("component") == F.col("__largest")).alias("inside"),
    )
    apart = (F.col("ca") != F.col("cb")) & (F.col("inside") | (F.col("a") > F.col("b")))
    near = F.least("wa", "wb") >= F.greatest("wa", "wb") * (THRESHOLD - 1e-9)
    pairs = outside.join(others, (F.col("band") == F.col("__b")) & apart & near).select("a", "b")
    chain = Window.partitionBy("band").orderBy("least")
    crowded = parts.join(buckets.where(~small), F.col("band") == F.col("__band"), "left_semi")
    crowded = crowded.select(F.col("least").alias("a"), F.lag("least").over(chain).alias("b"))
    pairs = pairs.union(crowded.where("b is not null"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return pairs, buckets.where(~small).select("__band")


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _block_links(rows: pa.Table) -> pa.Table:
    """Of one block: a link for every two classes with similar texts, one on either side.

    A pair is scored in the least band that its texts share, and once where both are outside the
    bucket's largest class.
    """
    band = rows.column("band")[0].as_py()
    left = np.array(rows.column("left"), bool)
    key, whole, component, inside = (
        rows.column(c).to_numpy() for c in ("key", "weight", "component", "inside")
    )
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(one) or not len(two):
        return _LINK.empty_table()
    lists = rows.column("mine").combine_chunks()
    own = np.repeat(np.arange(len(key)), np.diff(lists.offsets.to_numpy()))
    lower = lists.values.to_numpy()
    own, lower = own[lower < band], lower[lower < band]
    both = np.intersect1d(lower[left[own]], lower[~left[own]])
    held = np.zeros((len(key), len(both)), np.float32)
    in_both = np.isin(lower, both)
    held[own[in_both], np.searchsorted(both, lower[in_both])] = 1
    low = np.minimum(whole[one][:, None], whole[two])
    high = np.maximum(whole[one][:, None], whole[two])
    open_ = (
        (component[one][:, None] != component[two])
        & (inside[two] | (key[one][:, None] > key[two]))
        & (low >= high * (THRESHOLD - 1e-9))
        & (held[one] @ held[two].T == 0)
    )
    packs = rows.column("shared")
    unpacked = [_unpack(packs[i].as_py()) for i in two.tolist()]
    name = np.concatenate([p[0] for p in unpacked])
    weight = np.concatenate([p[1][p[2]] for p in unpacked])
    text = np.repeat(np.arange(len(two)), [len(p[0]) for p in unpacked])
    order = np.argsort(name, kind="stable")
    name, weight, text = name[order], weight[order], text[order]
    links: dict[tuple[int, int], tuple[int, int]] = {}
    for i in np.flatnonzero(open_.any(axis=1)).tolist():
        pack = packs[int(one[i])].as_py()
        names, values, code = _unpack(pack)
        first = np.searchsorted(name, names)
        n = np.searchsorted(name, names, side="right") - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        common = np.bincount(
            text[at], np.minimum(np.repeat(values[code], n), weight[at]), minlength=len(two)
        )
        score = common / (whole[one[i]] + whole[two] - common)
        for j in np.flatnonzero(open_[i] & (score >= THRESHOLD - 1e-9)).tolist():
            a, b = int(one[i]), int(two[j])
            if score[j] < THRESHOLD + 1e-9:  # sums in the order of all other pairs decide
                exact = weighted_jaccard(pack, whole[a], packs[b].as_py(), whole[b])
                if exact < THRESHOLD:
                    continue
            links.setdefault((int(component[a]), int(component[b])), (int(key[a]), int(key[b])))
    a, b = zip(*links.values(), strict=True) if links else ([], [])
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK)


def _crowded_links(
    bands: DataFrame, crowded: DataFrame, classes: DataFrame, signed: DataFrame
) -> DataFrame:
    """Links (a, b) between the classes that still meet in crowded buckets, from all their pairs.

    In each bucket the texts outside its largest class meet all texts, in blocks of about BLOCK by
    BLOCK texts, so a task holds two blocks and a text is sent once for each block it meets.
    """
    named = bands.join(crowded, F.col("band") == F.col("__band"), "left_semi")
    named = named.join(classes, F.col("key") == F.col("node"), "left")
    named = named.select("band", "key", F.coalesce("component", "key").alias("component"))
    named = checkpointed(named)
    parts = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    stats = parts.groupBy(F.col("band").alias("__band")).agg(
        F.max(F.struct("n", "component"))["component"].alias("__largest"),
        F.sum("n").alias("__n"), F.max("n").alias("__in"),
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    stats = stats.where("__n > __in").select(
        "__band", "__largest", blocks(F.col("__n") - F.col("__in")).alias("__rows"),
        blocks(F.col("__n")).alias("__columns"),
    )
    texts = named.join(checkpointed(stats), F.col("band") == F.col("__band")).drop("__band")
    texts = checkpointed(texts.withColumn("inside", F.col("component") == F.col("__largest")))
    mine = texts.groupBy(F.col("key").alias("__key")).agg(F.collect_list("band").alias("mine"))
    mine = mine.join(signed.select("key", "weight", "shared"), F.col("__key") == F.col("key"))
    texts = texts.join(mine.drop("key"), F.col("key") == F.col("__key")).drop("__key")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    own = ["band", "key", "component", "inside", "weight", "mine", "shared"]
    row, column = (F.expr(f"pmod(key, {c})") for c in ("__rows", "__columns"))
    left = texts.where("not inside").select(
        *own, F.lit(True).alias("left"), row.alias("i"), span(F.col("__columns")).alias("j")
    )
    right = texts.select(
        *own, F.lit(False).alias("left"), span(F.col("__rows")).alias("i"), column.alias("j")
    )
    return left.union(right).groupBy("band", "i", "j").applyInArrow(_block_links, "a long, b long")


def text_classes(docs: DataFrame) -> DataFrame:
    """(node, component) of the distinct texts, by key, that are linked to another.

    Every text is first compared with the least text of each of its band buckets, which joins most
    of a class at a cost linear in the bucket; pairs inside a class need no further look. What is
    left, pairs of texts in one bucket but in different classes, is then compared: one by one, or
    in crowded buckets along a chain and then, between the classes still apart, in blocks.
    """
    signed = signed_texts(docs)
    bands = signed.select("key", "weight", F.explode("bands").alias("band")).where("band <> 0")
    heads = bands.groupBy(F.col("band").alias("__band")).agg(
        F.min("key").alias("__least"), F.count(F.lit(1)).alias("__n")
    )
    bands = bands.join(heads.where("__n >= 2"), F.col("band") == F.col("__band"))
    bands = checkpointed(bands.select("band", "key", "weight", "__least"))
    stars = bands.where("key <> __least").select(F.col("key").alias("a"), F.col("__least").alias("b"))
    stars = stars.distinct()
    links = checkpointed(_linked(stars, signed).select("a", "b"))
    classes = checkpointed(components(links))
    pairs, crowded = _between_classes(bands, classes)
    tried = stars.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    pairs = pairs.join(tried, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_anti")
    more = checkpointed(_linked(pairs, signed).select("a", "b"))
    links = links.union(more)
    if crowded.isEmpty():
        return components(links)
    rest = _crowded_links(bands, crowded, checkpointed(components(links)), signed)
    return components(links.union(checkpointed(rest)))


def classes_of(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, class_key, class_id (least doc_id) and class_size."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    texts = text_classes(docs)
    named = own.join(texts, F.col("text_key") == F.col("node"), "left")
    named = named.withColumn("class_key", F.coalesce("component", "text_key"))
    named = named.drop("node", "component")
    named = checkpointed(named)
    heads = named.groupBy(F.col("class_key").alias("__c")).agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )
    # kept apart from the rows, so that a large class is split in the join
    heads = checkpointed(heads)
    return named.join(heads, F.col("class_key") == F.col("__c")).drop("__c")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least doc_id, with its own columns."""
    kept = classes_of(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = kept.groupBy("class_key", F.col("doc_id").alias("__d")).agg(
        F.min("text_key").alias("__k")
    )
    keyed = boxed(docs).withColumn("__key", F.xxhash64("__row.text"))
    keyed = keyed.withColumn("__id", F.col("__row.doc_id"))
    same = F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k"))
    rows = keyed.join(kept, same, "left_semi")
    first = Window.partitionBy("__id", "__key").orderBy("__key")
    return unboxed(rows.withColumn("__n", F.row_number().over(first)).where("__n = 1"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of near-duplicates."""
    return classes_of(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
