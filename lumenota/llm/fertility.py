"""Quality rules with tokeniser fertility.

Two public vocabularies measure each text: characters per token in either, the larger of their shares
of byte tokens, and the entropy of the tokens. Bands per language come from the corpus: for each
measure the 5 % and 95 % points of all documents of the language, and of those of about the same
length, widened by SLACK of their distance. A text is rejected where a measure lies outside both, or
outside the fixed limits of its script. A language of less than one document in RARE, or none, is
judged by the documents of its script. Base rules count words, symbols, repeated lines and repeated
windows of words.

Texts are measured once, in Arrow batches, and written; only counts of documents by group and rounded
measure are shuffled, so results do not depend on partitioning.

Defined cases: a null or blank text has no words and fails the base rule; very long texts are
measured whole; ties and repeated rows are judged alike, row by row, and each row counts; a group of
fewer than 20 documents reaches from its least to its greatest value; an empty table gives an empty
result; extra columns pass through ``keep_documents`` untouched.
"""

from __future__ import annotations

from base64 import b64decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenota.llm.common import boxed, slices, stored, table, unboxed
from lumenota.session import checkpointed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern by which byte-level vocabularies of this kind cut texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed limits by script: characters per token of the first vocabulary, its byte-fallback share and
#: token entropy as a share of the greatest entropy that many tokens can have.
BANDS = {
    "latin": {"chars": (1.2, 8.0), "fallback": (0.0, 0.2), "entropy": (0.35, 1.0)},
    "other": {"chars": (0.2, 8.0), "fallback": (0.0, 0.9), "entropy": (0.25, 1.0)},
}
#: Points of the bands, as percentages of a group's documents.
LOW, HIGH = 5, 95
#: Part of the distance of the two points by which a band is widened on either side.
SLACK = 0.5
#: Least widening, in hundredths: characters, characters, share of tokens, bits.
LEAST_SLACK = {"chars": 10, "chars_bytes": 10, "fallback": 5, "entropy": 20}
#: Languages of at least one document in this many have bands of their own; there are no more.
RARE = 1_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_fallback long, entropy double, latin_share double, "
    "n_byte_tokens long, n_byte_parts long"
)


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    """The tokeniser and a mask of its byte tokens, once per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_ = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return model, bytes_


@lru_cache(maxsize=2)
def _byte_vocabulary(path: str):
    """The byte-level tokeniser and a mask of its tokens that are one byte of a longer character."""
    import tiktoken

    with open(path, "rb") as file:
        pairs = [line.split() for line in file]
    ranks = {b64decode(token): int(rank) for token, rank in pairs}
    coder = tiktoken.Encoding(path, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    part = np.zeros(max(ranks.values()) + 1, bool)
    part[[rank for token, rank in ranks.items() if len(token) == 1 and token[0] > 0x7F]] = True
    return coder, part


def _repeated_words(ids: np.ndarray) -> int:
    """Words covered by a window of WINDOW words that occurs twice or more in the text."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    code = ids
    for width in range(1, WINDOW):  # codes of longer and longer windows, exact
        pair = code[:-1] * np.int64(len(ids)) + ids[width:]
        values, code = np.unique(pair, return_inverse=True)
        if len(values) == len(code):
            return 0
    twice = np.bincount(code)[code] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = True
_IS_LETTER_START = _IS_LETTER.copy()
_IS_LETTER_START[0xCA:0xF8] = True


def _measure(texts: list[bytes], path: str, byte_path: str = BYTE_VOCABULARY) -> list[tuple]:
    """The measures of each text; words that several texts share are tokenised once."""
    model, is_byte = _vocabulary(path)
    split = [text.split() for text in texts]
    index: dict[bytes, int] = {}
    coded = [np.array([index.setdefault(w, len(index)) for w in words], np.int64) for words in split]
    shown = [w.decode("utf-8", "replace") for w in index]
    encoded = model.encode(shown, num_threads=1)
    coder, is_part = _byte_vocabulary(byte_path)
    coded_bytes = [coder.encode_ordinary(" " + w) for w in shown]  # as a word stands in a line
    byte_lengths = np.array([len(x) for x in coded_bytes], np.int64)
    byte_parts = np.array([int(is_part[x].sum()) for x in coded_bytes], np.int64)
    lengths = np.array([len(x) for x in encoded], np.int64)
    flat = np.fromiter((i for x in encoded for i in x), np.int64, int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    rows = []
    for text, ids in zip(texts, coded, strict=True):
        data = np.frombuffer(text, np.uint8)
        word_chars = _code_points(data) - int(np.count_nonzero(_IS_GAP[data]))
        letters = int(np.count_nonzero(_IS_LETTER_START[data]))
        latin = int(np.count_nonzero(_IS_LETTER[data])) / letters if letters else 1.0
        n = fallback = n_bytes = n_parts = 0
        compact = ids
        entropy = 0.0
        if len(ids):
            words, compact, counts = np.unique(ids, return_inverse=True, return_counts=True)
            own = lengths[words]
            n = int((own * counts).sum())
            n_bytes = int((byte_lengths[words] * counts).sum())
            n_parts = int((byte_parts[words] * counts).sum())
            at = np.repeat(starts[words] - np.cumsum(own) + own, own) + np.arange(own.sum())
            tokens, weight = flat[at], np.repeat(counts, own)
            fallback = int(weight[is_byte[tokens]].sum())
            share = np.bincount(tokens, weights=weight)
            share = share[share > 0] / max(n, 1)
            entropy = float(-(share * np.log2(share)).sum()) if n else 0.0
        rows.append(
            (len(ids), word_chars, int(np.count_nonzero(_IS_SYMBOL[data])), _repeated_lines(text),
             _repeated_words(compact), n, fallback, entropy, latin, n_bytes, n_parts)
        )
    return rows


_NAMES = [part.split()[0] for part in MEASURES.split(", ")]
_TURN = 4 << 20


def measured(
    docs: DataFrame, vocabulary: str = VOCABULARY, byte_vocabulary: str = BYTE_VOCABULARY
) -> DataFrame:
    """``docs`` in one column ``__row`` and the struct column ``__measures``."""
    kind = ", ".join(part.replace(" ", ": ") for part in MEASURES.split(", "))

    @F.pandas_udf(f"struct<{kind}>")
    def measure(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for _, turn in slices(pa.Array.from_pandas(texts, type=pa.large_string()), _TURN):
            rows += _measure(turn, vocabulary, byte_vocabulary)
        return pd.DataFrame(rows, columns=_NAMES)

    return boxed(docs).withColumn("__measures", measure("__row.text"))


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (
        m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED
    )


def _script(m: Column) -> Column:
    return F.when(m["latin_share"] >= 0.5, F.lit("latin")).otherwise(F.lit("other"))


def _within_limits(m: Column) -> Column:
    """Whether the measures are inside the fixed limits of the text's script."""
    n = F.greatest(m["n_tokens"], F.lit(1))
    evenness = m["entropy"] / F.log2(F.greatest(m["n_tokens"], F.lit(2)))
    inside = F.lit(False)
    for name, limits in BANDS.items():
        fits = _script(m) == name
        values = (m["word_chars"] / n, m["n_fallback"] / n, evenness)
        for value, (low, high) in zip(values, limits.values(), strict=True):
            fits = fits & value.between(low, high)
        inside = inside | fits
    return inside


def _banded(m: Column) -> dict[str, Column]:
    """The measures that have bands, in whole hundredths."""
    n, n_bytes = F.greatest(m["n_tokens"], F.lit(1)), F.greatest(m["n_byte_tokens"], F.lit(1))
    values = {
        "chars": m["word_chars"] / n,
        "chars_bytes": m["word_chars"] / n_bytes,
        "fallback": F.greatest(m["n_fallback"] / n, m["n_byte_parts"] / n_bytes),
        "entropy": m["entropy"],
    }
    return {name: F.floor(value * 100).cast("int") for name, value in values.items()}


def _length(m: Column) -> Column:
    """Texts of one length class have less than twice the tokens of each other."""
    return F.floor(F.log2(F.greatest(m["n_tokens"], F.lit(1)))).cast("int")


def bands_of(rows: DataFrame) -> DataFrame:
    """Bands from measured rows (``__row.lang`` and ``__measures``): one row for each group (``lang``
    or ``script``, the other null) and length class (-1: all lengths) with a struct (low, high) of
    hundredths for each measure. Documents that fail the base rules do not count. At most RARE
    languages are in it, two scripts and some 40 length classes.
    """
    m = F.col("__measures")
    none = F.lit(None).cast("string")
    group = lambda lang, script, length: F.struct(
        lang.alias("lang"), script.alias("script"), length.alias("length")
    )
    lang, everywhere = F.col("__row.lang").cast("string"), F.lit(-1)
    groups = F.array(
        *[group(a, b, n) for a, b in ((lang, none), (none, _script(m))) for n in (_length(m), everywhere)]
    )
    cells = F.array(
        *[F.struct(F.lit(k).alias("measure"), v.alias("cell")) for k, v in _banded(m).items()]
    )
    counted = (
        rows.where(~_base_failed(m))
        .select(F.explode(cells).alias("c"), groups.alias("groups"))
        .select("c.*", F.explode("groups").alias("g"))
        .where(F.col("g.lang").isNotNull() | F.col("g.script").isNotNull())
        .groupBy("g.lang", "g.script", "g.length", "measure", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = ("lang", "script", "length", "measure")
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("cell")
    placed = counted.withColumns({"upto": F.sum("n").over(upto), "of": F.sum("n").over(whole)})
    reached = lambda percent: F.min(
        F.when(F.col("upto") * 100 >= F.col("of") * percent, F.col("cell"))
    )
    points = placed.groupBy(*keys).agg(
        reached(LOW).alias("low"), reached(HIGH).alias("high"), F.first("of").alias("of")
    )
    least = F.create_map(*[F.lit(x) for pair in LEAST_SLACK.items() for x in pair])
    slack = F.greatest((F.col("high") - F.col("low")) * SLACK, least[F.col("measure")].cast("double"))
    band = F.struct((F.col("low") - slack).alias("low"), (F.col("high") + slack).alias("high"))
    bands = (
        points.groupBy("lang", "script", "length")
        .agg(
            F.first("of").alias("n_docs"),
            *[F.first(F.when(F.col("measure") == k, band), True).alias(k) for k in LEAST_SLACK],
        )
    )
    total = bands.where("script IS NOT NULL AND length = -1").agg(F.sum("n_docs").alias("__all"))
    common = bands.where("lang IS NOT NULL AND length = -1").crossJoin(F.broadcast(total))
    common = common.where(F.col("n_docs") * RARE >= F.col("__all")).select(F.col("lang").alias("__lang"))
    kept = bands.join(common, F.col("lang") == F.col("__lang"), "left")
    return kept.where(F.col("script").isNotNull() | F.col("__lang").isNotNull()).drop("__lang")


def judged(rows: DataFrame) -> DataFrame:
    """Measured ``rows``, which are read twice, plus ``base_failed``, ``in_bands`` and ``kept``."""
    m = F.col("__measures")
    bands = checkpointed(bands_of(rows))

    def side(name: str, key: str, length: Column) -> DataFrame:
        """Rows of ``bands`` of one kind, as (__<name>, key, length)."""
        own = bands.where(F.col(key).isNotNull() & length)
        return F.broadcast(
            own.select(
                F.col(key).alias(f"__{name}_key"), F.col("length").alias(f"__{name}_length"),
                F.struct(*LEAST_SLACK).alias(f"__{name}"),
            )
        )

    for name, key, value in (
        ("lang", "lang", F.col("__row.lang").cast("string")),
        ("script", "script", _script(m)),
    ):
        near, far = side(name, key, F.col("length") >= 0), side(f"{name}_all", key, F.col("length") < 0)
        rows = rows.join(
            near,
            (value == F.col(f"__{name}_key")) & (_length(m) == F.col(f"__{name}_length")),
            "left",
        ).join(far, value == F.col(f"__{name}_all_key"), "left")
    common = F.col("__lang_all").isNotNull()
    inside = F.lit(True)
    for measure, value in _banded(m).items():
        fits = F.lit(False)
        for part in ("", "_all"):
            band = F.when(common, F.col(f"__lang{part}")).otherwise(F.col(f"__script{part}"))[measure]
            # a share of byte tokens can only be too large
            above = F.lit(True) if measure == "fallback" else value >= band["low"]
            fits = fits | F.coalesce(above & (value <= band["high"]), F.lit(False))
        inside = inside & fits
    failed = _base_failed(m)
    # a document that fails the base rules may belong to no group; its bands decide nothing
    return rows.select(
        "__row", "__measures", failed.alias("base_failed"),
        (_within_limits(m) & inside).alias("in_bands"),
        (~failed & _within_limits(m) & inside).alias("kept"),
    )


def judge_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document with its measures, base_failed, in_bands and kept."""
    m = F.col("__measures")
    rows = measured(docs.select("doc_id", "lang", "text"), vocabulary)
    rows = rows.select(F.struct("__row.doc_id", "__row.lang").alias("__row"), "__measures")
    rows = judged(stored(rows, "fertility"))
    return rows.select(
        "__row.doc_id",
        *[m[name].alias(name) for name in _NAMES],
        (m["word_chars"] / F.greatest(m["n_tokens"], F.lit(1))).alias("chars_per_token"),
        "base_failed", "in_bands", "kept",
    )


def keep_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents that pass the base rules and the bands, with their own columns."""
    rows = stored(measured(docs, vocabulary), "fertility")
    return unboxed(judged(rows).where("kept").select("__row"))


def op10_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, measured and judged."""
    return judge_documents(table(spark, sf_dir, "documents"))
