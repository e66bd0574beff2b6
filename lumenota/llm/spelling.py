"""Spelling variants grouped under the form they most likely miss, by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Bigrams
have a global order, rarest first. A word's *prefix* is its three first bigrams in that order (with
all that tie with the third), and its *pivots* are the two disjoint bigrams of the prefix that are
rarest in sum, found by dynamic programming. One edit cannot touch both pivots, and the one it leaves
whole stands in the other word's prefix if that prefix reaches as far in the order; so every near
pair meets at a pivot of one and a prefix bigram of the other.

*Position limits.* The untouched pivot has the edit on its right, and then the same distance from the
start in both words, or on its left, with the same distance from the end. All letters on the quiet
side are equal too, and so is one half of the letters on the other side, whichever the edit is not
in. An index key is the side, the position, the shorter word's length, which half, and a hash of the
equal letters; a frequent bigram alone fills no bucket. Beside the key stand the letters of the half
that may differ, so what meets is compared there and then; what passes is verified by the edit
distance of the whole words, so a hash that collides costs work and no result.

Words are counted where they stand; distinct words are what is indexed. Only the bigram counts go
through the driver: the alphabet has 90 letters, so there are at most 8,100.

Defined cases: a null or empty text has no words, a null id reads as an empty one; repeated rows are
counted each time; equal counts give the form that is first in code-point order; an empty table gives
an empty result. A text of any length is read whole; a run of letters of any length is a word (a long
run of one letter has an index entry per letter). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import stored, table

#: The letters of words; all of them fit in one byte of Latin-1, which the bigram codes rely on.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fewer letters than this do not make a word; three bigrams need four.
MIN_LETTERS = 7
MIN_COUNT = 2
#: A form is at least this many times as frequent as its variant.
RATIO = 10
#: A run loses a letter where this divides its checksum.
DROP_EVERY = 31

PREFIX, PIVOTS, WIDTH = 3, 2, 2
#: A half of more letters is not carried beside its key, only compared with the whole words.
CARRIED = 24
_BASE = 0x9E3779B97F4A7C15


def dropped_letter(doc_id: Column, run: Column) -> Column:
    """``run`` (lower case), or what is left of it where its checksum with the id drops a letter."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (mark % F.length(run)).cast("int")
    rest = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(mark % DROP_EVERY == 0, rest).otherwise(run)


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT):
    """Distinct words of ``docs`` (doc_id, text) with their occurrences ``n``."""
    runs = F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0)
    )
    run = F.col("run")
    lowered = F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run)
    return (
        docs.select("doc_id", F.explode(runs).alias("run"))
        .select("doc_id", lowered.alias("run"))
        .select(dropped_letter(F.col("doc_id"), run).alias("word"))
        .filter(F.length("word") >= min_letters)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words one after the other, and where each word begins (and the last ends)."""
    texts = words.to_pylist()
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    return letters, np.concatenate([[0], np.cumsum(sizes)])


def _bigrams(letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code, word number and place in the letters of every bigram."""
    codes = letters[:-1].astype(np.int64) << 8 | letters[1:]
    places = np.arange(codes.size)
    word = np.searchsorted(starts, places, side="right") - 1
    inside = places + 1 < starts[word + 1]
    return codes[inside], word[inside], places[inside]


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(1 << 16, np.int64)
    for batch in batches:
        letters, starts = _letters(batch.column(0))
        if letters.size:
            totals += np.bincount(_bigrams(letters, starts)[0], minlength=totals.size)
    seen = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], ["gram", "n"])


def rarest_disjoint(places: list[int], costs: list[int], wanted: int = PIVOTS) -> list[int]:
    """Which of the grams at ascending ``places`` to take so that ``wanted`` of them are disjoint and
    their costs are least in sum: best[k] over a growing left part, one gram at a time."""
    free, before = 0, [(0, ())] + [None] * wanted
    history = []
    for i, (place, cost) in enumerate(zip(places, costs, strict=True)):
        while free < i and places[free] + WIDTH <= place:
            free += 1
        fitting = history[free - 1] if free else [(0, ())] + [None] * wanted
        now = list(before)
        for k in range(1, wanted + 1):
            if fitting[k - 1] is not None:
                total = fitting[k - 1][0] + cost
                if now[k] is None or total < now[k][0]:
                    now[k] = (total, (*fitting[k - 1][1], i))
        history.append(now)
        before = now
    return list(before[wanted][1])


def _prefixes(letters, starts, ranks, costs):
    """Word, place and pivot mark of every prefix bigram, in order of word and place."""
    codes, word, places = _bigrams(letters, starts)
    order = np.lexsort((places, ranks[codes], word))
    codes, word, places = codes[order], word[order], places[order]
    first = np.searchsorted(word, np.arange(starts.size - 1))
    third = ranks[codes[first + PREFIX - 1]]
    kept = ranks[codes] <= third[word]
    codes, word, places = codes[kept], word[kept], places[kept]
    order = np.lexsort((places, word))
    codes, word, places = codes[order], word[order], places[order]
    pivot = np.zeros(word.size, bool)
    bounds = np.searchsorted(word, np.arange(starts.size)).tolist()
    at, cost = places.tolist(), costs[codes].tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        for i in rarest_disjoint(at[a:b], cost[a:b]):
            pivot[a + i] = True
    return word, places, pivot


class _Hashes:
    """Hashes of any stretch of the letters, equal for equal stretches wherever they stand."""

    def __init__(self, letters: np.ndarray):
        n = letters.size + 1
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        powers = np.concatenate([[np.uint64(1)], np.full(n, base)]).cumprod()
        self.back = np.concatenate([[np.uint64(1)], np.full(n, inverse)]).cumprod()
        terms = (letters.astype(np.uint64) + np.uint64(1)) * powers[: letters.size]
        self.sums = np.concatenate([[np.uint64(0)], terms.cumsum()])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _mixed(*parts: np.ndarray) -> np.ndarray:
    key = np.uint64(0x243F6A8885A308D3)
    for part in parts:
        key = (key ^ part.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        key = key ^ (key >> np.uint64(32))
    return key.view(np.int64)


def _keys(letters, starts, word, places):
    """For each prefix bigram its index keys: (key, number of the bigram, where the half that may
    differ begins and ends, whether the word is taken as the longer one of a pair)."""
    hashes = _Hashes(letters)
    begin, end = starts[word], starts[word + 1]
    length, number = end - begin, np.arange(word.size)
    for side in (0, 1):
        if side == 0:  # the edit is on the right
            quiet, low, high, offset = (begin, places + WIDTH), places + WIDTH, end, places - begin
        else:
            quiet, low, high, offset = (places, end), begin, places, end - WIDTH - places
        whole = hashes.of(*quiet)
        for shorter in (0, 1):  # the word is the shorter of the pair, or one letter longer
            rest = high - low - shorter
            some = rest >= 0
            cut = np.maximum(rest, 0) // 2
            for half in (0, 1):  # the half that the edit is not in
                if half == 0:
                    split = np.where(some, low + cut, low)
                    equal, other = (low, split), (split, high)
                else:
                    split = np.where(some, high - (rest - cut), high)
                    equal, other = (split, high), (low, split)
                tag = np.full(word.size, side * 2 + half)
                key = _mixed(tag, offset, length - shorter, whole, hashes.of(*equal))
                yield key[some], number[some], other[0][some], other[1][some], bool(shorter)


def _stretches(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of the letters as texts; null where one is longer than CARRIED."""
    text = letters.tobytes().decode("latin-1")
    pairs = zip(start.tolist(), end.tolist(), strict=True)
    return pa.array([text[a:b] if b - a <= CARRIED else None for a, b in pairs], pa.string())


def _index(ranks: np.ndarray, costs: np.ndarray):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters, starts = _letters(batch.column("word"))
            word, places, pivot = _prefixes(letters, starts, ranks, costs)
            ids = np.asarray(batch.column("id"))
            for key, number, start, end, longer in _keys(letters, starts, word, places):
                columns = [key, ids[word[number]], pivot[number], np.full(key.size, longer)]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c) for c in columns], _stretches(letters, start, end)],
                    ["key", "id", "pivot", "longer", "rest"],
                )

    return index


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: (a, a_n, b, b_n).

    ``words`` has a unique ``id``, ``word`` (four letters or more) and ``n``; it is read several times
    and should be a stored table.
    """
    grams = words.select("word").mapInArrow(_count_bigrams, "gram long, n long")
    found = grams.groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most 8,100 rows
    costs = np.zeros(1 << 16, np.int64)
    for row in found:
        costs[row["gram"]] = row["n"]
    ranks = np.empty(costs.size, np.int64)
    ranks[np.lexsort((np.arange(costs.size), costs))] = np.arange(costs.size)
    entries = words.select("id", "word").mapInArrow(
        _index(ranks, costs), "key long, id long, pivot boolean, longer boolean, rest string"
    )
    # An index is many times its words: the planner, which knows the words' size only, must not
    # broadcast it.
    p, q = entries.alias("p"), entries.alias("q").hint("merge")
    apart = F.levenshtein("p.rest", "q.rest", 1) == 1
    met = p.join(q, "key").filter(
        (F.col("p.id") < F.col("q.id"))
        & (F.col("p.pivot") | F.col("q.pivot"))
        & ~(F.col("p.longer") & F.col("q.longer"))
        & F.coalesce(apart, F.lit(True))
    )
    pairs = met.select(F.col("p.id").alias("i"), F.col("q.id").alias("j")).distinct()
    left = words.select(F.col("id").alias("i"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = words.select(F.col("id").alias("j"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    verified = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    return pairs.join(left, "i").join(right, "j").filter(verified).select("a", "a_n", "b", "b_n")


def _roots(links: DataFrame) -> DataFrame:
    """The last form from each word with a form: (word, root).

    Every round doubles the steps taken; counts grow along the forms, so the chains end.
    """
    chain = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while chain.filter("moved").limit(1).count():
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        taken = F.coalesce("further", "root")
        step = chain.join(on, "root", "left")
        chain = stored(
            step.select("word", taken.alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
    return chain.select("word", "root")


def spelling_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Every word of ``counts`` (word, n) with its near words, form and root.

    A form has at least ``ratio`` times (2 or more) the occurrences of its variant.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: a form is more frequent than its variant")
    words = stored(counts.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m"))
    both = both.unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"),
    )
    frequent = -F.col("best.less") >= F.col("n") * ratio
    formed = words.join(best, "word", "left").select(
        "word",
        F.when(frequent, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    formed = stored(formed, "spelling-forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their variants' forms."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
