"""Toxicity by a subsequence string kernel and a support vector machine.

*Kernel.* A word's features are its subsequences of three characters; one that spans s characters
weighs DECAY**s, spans are at most SPAN. Two words are as like as the cosine of their features, to the
power SHARPNESS. Characters put between the letters of a word stretch its subsequences and leave most
of them there, so `idxiot` stays close to `idiot`. The kernel of two sentences is the sum
over their pairs of distinct words.

*Landmarks.* The kernel is taken against a bounded number of landmark words (Nyström): the words whose
presence speaks most for toxic documents by the counts over all labelled rows, no two of them alike,
the most frequent words of clean ones, and clean words that resemble toxic ones. With M the kernel among the landmarks, a sentence's
features are M**-1/2 times its kernels to them; the machine is linear in those.

*Training.* Labels are of documents. Every sentence of a clean document is a clean one; of a toxic
document the one that scores highest stands for it, and those that score half as much, first by the
counts, then by the machine of the round before. Each sentence is also learned with a character put into each of its words. The fit
takes at most FIT_DOCUMENTS documents a class and FIT_SENTENCES sentences of each, by hash; the
counts take every labelled document. A document's score is its highest sentence's, through a logistic
curve (Platt) fitted on the same documents.

Sentences end at `.`, `!`, `?` or a line's end, and after LONGEST words. Words are lower-case runs of
characters other than white space, without the marks in them (`id-i.ot`); of a word that marks cut,
pieces of PIECE or more letters are words too; single characters in a row are one word (`i d i o t`);
of a word of more than WINDOW characters every stretch of that length, half overlapping, is one.

Defined cases: a null or empty text has no sentence and scores as one without words; a null id is not
held out and has no label; several label rows of a document make it toxic if any does, rows with a
null label say nothing; without labels of both classes every score is 0; repeated rows score alike;
an empty table gives an empty result; texts of any length are scored whole, one text at a time. Extra
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.llm.common import slices, stored, table

DECAY = 0.6
SPAN = 6
SHARPNESS = 3
WINDOW = 24
LONGEST = 40
PIECE = 4
TOXIC_LANDMARKS, CLEAN_LANDMARKS, HARD_LANDMARKS = 72, 16, 40
#: Words whose features are made at once; their letters stay below 2**16.
CHUNK = 2500
#: Landmarks that are more alike than this say the same.
ALIKE = 0.8
#: A word speaks for toxic documents where its logarithmic odds, less two standard errors, exceed this.
SURE = 0.5
FIT_DOCUMENTS = 1000
FIT_SENTENCES = 40
ROUNDS = 2
#: How much the slack of a toxic document weighs against the length of the weights.
FIRMNESS = 8.0
THRESHOLD = 0.7
#: Words scored before the table of known scores is begun anew.
REMEMBERED = 400_000
#: Characters taken in a turn.
TURN = 4_000_000

_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")
_MARKS = re.compile(r"[\W_]+")
_LONE = re.compile(r"(?<!\S)\w(?:[^\S\n]+\w){2,}(?!\w)")
_GAPS = [(i, j) for i, j in combinations(range(1, SPAN), 2)]


def _units(token: str) -> list[str]:
    """The words that one run of characters other than white space is read as."""
    if len(token) <= WINDOW and token.isalnum():
        return [token]
    pieces = [x for x in _MARKS.split(token) if x]
    whole = "".join(pieces)
    if len(whole) > WINDOW:
        words = [whole[i : i + WINDOW] for i in range(0, len(whole) - WINDOW // 2, WINDOW // 2)]
    else:
        words = [whole] if whole else []
    if len(pieces) > 1:
        words += [x for x in pieces if PIECE <= len(x) <= WINDOW]
    return words


def _parts(text: str) -> list[str]:
    """Sentences as texts, with single characters in a row joined."""
    return _SENTENCE.split(_LONE.sub(lambda m: "".join(m.group().split()), text.lower()))


def sentences(text: str) -> Iterator[list[str]]:
    """The distinct words of each sentence, in order; every sentence has one."""
    for part in _parts(text):
        words = [w for token in part.split() for w in _units(token)]
        for at in range(0, len(words), LONGEST):
            yield list(dict.fromkeys(words[at : at + LONGEST]))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, feature and weight of the subsequences of at most CHUNK words; the weights of a
    word have length 1. A feature is three code points in one number; words are at most WINDOW long."""
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(codes.astype(np.int64), return_inverse=True)  # below 2**16 letters
    owner = np.repeat(np.arange(sizes.size), sizes) << 48
    left = np.repeat(starts + sizes, sizes) - np.arange(codes.size)
    keys, weights = [], []
    for j, k in _GAPS:
        at = np.flatnonzero(left > k)
        keys.append(owner[at] | codes[at] << 32 | codes[at + j] << 16 | codes[at + k])
        weights.append(np.full(at.size, DECAY ** (k + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    if key.size:
        new = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        key, weight = key[new], np.add.reduceat(weight, new)
    row, low = key >> 48, 0xFFFF
    if not key.size:
        return row, key, weight
    first, second, third = (alphabet[key >> shift & low] for shift in (32, 16, 0))
    norm = np.sqrt(np.bincount(row, weight**2, sizes.size))
    return row, first << 42 | second << 21 | third, weight / norm[row]


class Landmarks:
    """Kernels of words to fixed landmark words."""

    def __init__(self, words: list[str]):
        row, name, weight = features(words)
        order = np.argsort(name, kind="stable")
        self.words = words
        self.owners, self.weights = row[order], weight[order]
        self.names, self.starts = np.unique(name[order], return_index=True)
        self.counts = np.diff(self.starts, append=name.size)

    def kernel(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per landmark."""
        some = [self._kernel(words[at : at + CHUNK]) for at in range(0, len(words), CHUNK)]
        return np.concatenate(some) if some else np.zeros((0, len(self.words)))

    def _kernel(self, words: list[str]) -> np.ndarray:
        row, name, weight = features(words)
        shape = len(words), len(self.words)
        if not row.size or not self.names.size:
            return np.zeros(shape)
        place = np.minimum(np.searchsorted(self.names, name), self.names.size - 1)
        hit = np.flatnonzero(self.names[place] == name)
        counts = self.counts[place[hit]]
        first = np.repeat(self.starts[place[hit]] - counts.cumsum() + counts, counts)
        entry = first + np.arange(first.size)  # every landmark that has the feature
        cell = np.repeat(row[hit], counts) * shape[1] + self.owners[entry]
        terms = np.repeat(weight[hit], counts) * self.weights[entry]
        return np.bincount(cell, terms, shape[0] * shape[1]).reshape(shape) ** SHARPNESS


def spread_apart(words: list[str], most: int, taken: list[str]) -> list[str]:
    """The first ``most`` words, in order, of which none is like an earlier or a taken one."""
    chosen = list(taken)
    for word in words:
        if len(chosen) - len(taken) >= most:
            break
        if len(word) < 3 or chosen and Landmarks(chosen).kernel([word]).max() > ALIKE**SHARPNESS:
            continue
        chosen.append(word)
    return chosen[len(taken) :]


def with_inserted(words: list[str]) -> list[str]:
    """Each word with one character put in, which its checksum chooses."""
    out = []
    for word in words:
        mark = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        at = 1 + mark % max(len(word) - 1, 1)
        out.append(word[:at] + "-._*xeaio"[mark // 64 % 9] + word[at:])
    return [w[:WINDOW] for w in out]


@dataclass
class Model:
    """Landmark words with their weights, the bias, and the logistic curve over sentence scores."""

    words: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scorer(self):
        """A function from texts to their scores; it remembers words it has met."""
        marks = Landmarks(self.words)
        places: dict[str, int] = {}
        tokens: dict[str, list[int]] = {}
        known = np.zeros(0)

        def place(token: str) -> list[int]:
            found = tokens.get(token)
            if found is None:
                found = [places.setdefault(w, len(places)) for w in _units(token)]
                tokens[token] = found
            return found

        def tops(parts: list[str], owners: list[int], best: np.ndarray) -> None:
            """Raise the best scores of the owners of sentences."""
            nonlocal known
            split = pc.utf8_split_whitespace(pa.array(parts, pa.large_string()))
            coded = split.values.dictionary_encode()
            found = [place(t) for t in coded.dictionary.to_pylist()]
            if len(places) > known.size:
                fresh = list(islice(places, known.size, None))
                known = np.concatenate([known, marks.kernel(fresh) @ self.weights])
            sizes = np.fromiter((len(f) for f in found), np.int64, len(found))
            words = np.fromiter(chain.from_iterable(found), np.int64, sizes.sum())
            codes = coded.indices.to_numpy()
            counts = sizes[codes]
            sentence = np.repeat(np.arange(len(parts)), np.diff(split.offsets.to_numpy()))
            sentence = np.repeat(sentence, counts)
            if not sentence.size:
                return
            first = (sizes.cumsum() - sizes)[codes] - counts.cumsum() + counts
            words = words[np.repeat(first, counts) + np.arange(sentence.size)]
            begins = np.flatnonzero(np.r_[True, np.diff(sentence) != 0])
            sizes = np.diff(begins, append=sentence.size)
            within = np.arange(sentence.size) - np.repeat(begins, sizes)
            window = np.cumsum(within % LONGEST == 0) - 1
            owner = np.array(owners)[sentence[within % LONGEST == 0]]
            pairs = np.sort(window << 32 | words)
            pairs = pairs[np.r_[True, np.diff(pairs) != 0]]  # each word once
            np.maximum.at(best, owner, np.bincount(pairs >> 32, known[pairs & 0xFFFFFFFF]))

        def score(texts: list[str]) -> np.ndarray:
            nonlocal known
            best = np.full(len(texts), -np.inf)
            if len(places) > REMEMBERED:
                places.clear()
                tokens.clear()
                known = np.zeros(0)
            parts: list[str] = []
            owners: list[int] = []
            size = 0
            for number, text in enumerate(texts):
                for part in _parts(text):
                    parts.append(part)
                    owners.append(number)
                    size += len(part)
                    if size > TURN:
                        tops(parts, owners, best)
                        parts, owners, size = [], [], 0
            if parts:
                tops(parts, owners, best)
            margin = np.where(np.isinf(best), 0.0, best) + self.bias
            return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

        return score


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton steps; the bias is last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(v):
        return v @ keep @ v / 2 + c * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(50):
        slack = 1 - y * (x @ w)
        active = slack > 0
        grad = keep @ w - 2 * c * (x[active].T @ (weight * y * slack)[active])
        if np.abs(grad).max() < 1e-6 * c:
            break
        hess = keep + 2 * c * (x[active].T * weight[active]) @ x[active]
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w) - 1e-4 * size * grad @ step:
            size /= 2
        w = w - size * step
    return w


def _curve(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, both classes weighing the same (Platt's targets)."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    x = np.stack([scores, np.ones_like(scores)], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - target)) + 1e-4 * w
        hess = (x.T * (weight * p * (1 - p))) @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _embedded(examples, marks: Landmarks, root: np.ndarray, change) -> list[np.ndarray]:
    """Features of each document's sentences, with ``change`` made to their words."""
    kinds = {w: i for i, w in enumerate(dict.fromkeys(w for _, doc in examples for s in doc for w in s))}
    changed = change(list(kinds))
    words = marks.kernel(changed) @ root
    return [np.array([words[[kinds[w] for w in s]].sum(0) for s in doc]) for _, doc in examples]


def _learned(examples, words: list[str], scores: list[np.ndarray], rounds: int):
    """Landmarks, their weights, the bias, and each document's sentence scores, plain and stretched."""
    marks = Landmarks(words)
    values, vectors = np.linalg.eigh(marks.kernel(words))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    both = list(zip(_embedded(examples, marks, root, lambda ws: ws),
                    _embedded(examples, marks, root, with_inserted), strict=True))
    toxic = [t for t, _ in examples]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    rows0 = sum(len(plain) for (plain, _), t in zip(both, toxic, strict=True) if not t)
    for _ in range(rounds):
        x, y, weight = [], [], []
        for t, (plain, stretched), s in zip(toxic, both, scores, strict=True):
            top = int(np.argmax(s))
            if t:
                picked = np.flatnonzero(s >= s[top] / 2) if s[top] > 0 else [top]
                x += [plain[picked], stretched[picked]]
                weight.append(np.full(2 * len(picked), 1 / n1 / len(picked)))
            else:
                x += [plain, stretched]
                weight.append(np.full(2 * len(plain), 0.25 / rows0))
                weight[-1][[top, top + len(plain)]] += 0.25 / n0
            y.append(np.full(weight[-1].size, 1.0 if t else -1.0))
        w = _machine(np.concatenate(x), np.concatenate(y), np.concatenate(weight) * n1 * FIRMNESS)
        scores = [plain @ w[:-1] for plain, _ in both]
    stretched = [x @ w[:-1] for _, x in both]
    return marks, root @ w[:-1], float(w[-1]), scores, stretched


def fitted(
    examples: list[tuple[bool, list[list[str]]]], evidence: dict[str, float], clean: list[str]
) -> Model:
    """The machine from documents as (toxic, sentences).

    ``evidence`` has words that speak for toxic documents, strongest first, with how much; ``clean``
    has frequent words of clean documents. After a first fit the words of clean sentences that score
    highest become landmarks too, so that the machine can tell them from the toxic words they resemble.
    """
    words = spread_apart(list(evidence), TOXIC_LANDMARKS, [])
    words += spread_apart(clean, CLEAN_LANDMARKS, words)
    scores = [np.array([sum(evidence.get(w, 0.0) for w in s) for s in doc]) for _, doc in examples]
    marks, weights, _, scores, _ = _learned(examples, words, scores, ROUNDS)
    held = Counter(w for t, doc in examples if not t for w in {w for s in doc for w in s})
    usual = [w for w, n in held.items() if n > 1]
    if usual:
        harm = dict(zip(usual, (marks.kernel(usual) @ weights).tolist(), strict=True))
        hard = sorted((w for w in usual if harm[w] > 0), key=lambda w: (-harm[w] * held[w], w))
        words += spread_apart([w for w in hard if w not in set(words)], HARD_LANDMARKS, [])
    marks, weights, bias, scores, stretched = _learned(examples, words, scores, ROUNDS)
    tops = np.array([s.max() + bias for s in (*scores, *stretched)])
    slope, shift = _curve(tops, np.array([t for t, _ in examples] * 2))
    return Model(words, weights, bias, slope, shift)


def _word_presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, clean documents) of a batch of (text, toxic)."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for word in {w for s in sentences(text.as_py() or "") for w in s}:
                counts.setdefault(word, [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.string()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
            ],
            ["word", "toxic", "clean"],
        )


def _fit_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, sentences) of a batch of (text, toxic): the FIT_SENTENCES of least checksum."""
    for batch in batches:
        kept = []
        for text in batch.column(0):
            marked = (
                (zlib.crc32(" ".join(s).encode("utf-8", "surrogatepass")), s)
                for s in sentences(text.as_py() or "")
            )
            kept.append([" ".join(s) for _, s in sorted(marked)[:FIT_SENTENCES]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(kept, pa.list_(pa.string()))], ["toxic", "sentences"]
        )


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    mark = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    return mark % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The machine from the labelled documents that are not held out; None without both classes.

    The word counts cover all labelled documents; what comes to the driver is a bounded number of
    words and of sentences.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    rows = docs.select("doc_id", "text").filter("text is not null").join(known.hint("merge"), "doc_id")
    rows = stored(rows, "toxicity-labelled")  # the only shuffle of texts
    classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return None
    n1, n0 = classes[True], classes[False]
    presence = rows.select("text", "toxic").mapInArrow(
        _word_presence, "word string, toxic long, clean long"
    )
    presence = presence.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    presence = stored(presence.filter("toxic > 1 or clean > 1"), "toxicity-words")
    odds = F.log(
        (F.col("toxic") + 0.5) / (n1 + 1.0) / ((F.col("clean") + 0.5) / (n0 + 1.0))
    )
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    weight = (odds * F.col("toxic")).alias("weight")
    strong = presence.filter((F.col("toxic") >= 2) & (odds - 2 * error > SURE))
    strong = strong.select("word", odds.alias("odds"), weight).orderBy(F.desc("weight"), "word")
    strong = strong.limit(8 * TOXIC_LANDMARKS)
    evidence = {r["word"]: r["odds"] for r in strong.collect()}
    plain = presence.filter(odds < 0.5).orderBy(F.desc("clean"), "word")
    clean = [r["word"] for r in plain.limit(8 * CLEAN_LANDMARKS).collect()]
    if not evidence or not clean:
        return None
    sample = []
    for toxic in (True, False):
        some = rows.filter(F.col("toxic") == toxic).select(
            "doc_id", "toxic", F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")).alias("mark")
        )
        sample.append(some.dropDuplicates(["doc_id"]).orderBy("mark", "doc_id").limit(FIT_DOCUMENTS))
    chosen = sample[0].unionByName(sample[1]).select("doc_id")
    fit = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "toxic")
    fit = fit.mapInArrow(_fit_sentences, "toxic boolean, sentences array<string>")
    examples = sorted(
        (r["toxic"], [s.split(" ") for s in r["sentences"]]) for r in fit.collect() if r["sentences"]
    )
    if len({t for t, _ in examples}) < 2:
        return None
    return fitted(examples, evidence, clean)


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and ``score`` of every document of ``docs`` (doc_id, text)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = [score([t.decode() for t in turn]) for _, turn in slices(batch.column("text"), TURN)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate([*found, []]))], ["doc_id", "score"]
            )

    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a machine learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
