"""The string kernel against its definition, and the machine on documents held out."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from lumenota.llm import toxicity as tox
from tests.llm.cases import frame, odd_documents, prose

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ["dumbwit", "grotlump", "vexmaggot", "sneerhog", "blatherfool"]


def brute_features(word):
    out = {}
    for i, j, k in combinations(range(len(word)), 3):
        if k - i < tox.SPAN:
            name = word[i] + word[j] + word[k]
            out[name] = out.get(name, 0.0) + tox.DECAY ** (k - i + 1)
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {n: v / norm for n, v in out.items()} if norm else {}


def brute_kernel(a, b):
    x, y = brute_features(a), brute_features(b)
    return sum(v * y.get(n, 0.0) for n, v in x.items()) ** tox.SHARPNESS


def gapped(word, rng):
    at = rng.randint(1, len(word) - 1)
    return rng.choice([word[:at] + rng.choice("-.*xq") + word[at:], "-".join(word), " ".join(word)])


def corpus(n=240, seed=7):
    """Documents of invented prose, a third of them with insults, ids from 0."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(30, 200)).split(" ")
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_kernel_is_that_of_the_definition():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    words = [w for w in words if w] + ["aaaaaa", "ab", "abc", "idiot", "id-iot", "i.d.i.o.t"]
    marks = tox.Landmarks(words[:20] + ["idiot"])
    got = marks.kernel(words)
    want = np.array([[brute_kernel(w, m) for m in marks.words] for w in words])
    assert np.allclose(got, want, atol=1e-12)
    near = brute_kernel("id-iot", "idiot"), brute_kernel("idoit", "idiot"), brute_kernel("ideas", "idiot")
    assert near[0] > 0.2 > near[2]


def test_sentences_cover_every_word_once():
    text = "One two. i d i o t! X\n" + "ww " * 100 + "…(quoted)… " + "z" * 60
    found = list(tox.sentences(text))
    words = [w for s in found for w in s]
    assert "idiot" in words and "quoted" in words and words.count("ww") == 3
    assert max(len(s) for s in found) <= tox.LONGEST and max(map(len, words)) <= tox.WINDOW
    assert list(tox.sentences(" .\n!")) == [] and list(tox.sentences("")) == []


def test_held_out_documents_and_tampered_insults(spark):
    docs, labels = corpus()
    rng = random.Random(9)
    extra = []
    for i in range(1000, 1040):  # not labelled, every insult tampered with
        words = prose(rng, 80).split(" ")
        for _ in range(4):
            words.insert(rng.randrange(len(words)), gapped(rng.choice(INSULTS), rng))
        extra.append((i, " ".join(words), "en", "s", None))
    model = tox.train(frame(spark, docs), frame(spark, labels, LABELS))
    got = {r[0]: r[1] for r in tox.score_documents(frame(spark, docs + extra), model).collect()}
    truth = {i: t for i, _, t in labels}
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= tox.THRESHOLD) == bool(truth[i]) for i in unseen)
    assert len(unseen) > 50 and right / len(unseen) >= 0.97
    assert sum(got[i] >= tox.THRESHOLD for i in range(1000, 1040)) >= 36


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = corpus(120)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a = tox.train(frame(spark, docs), frame(spark, labels, LABELS))
    b = tox.train(frame(spark, docs).repartition(7), frame(spark, other, LABELS))
    assert a.words == b.words and np.array_equal(a.weights, b.weights)


def test_odd_documents_and_extra_columns(spark):
    docs, labels = corpus(120)
    model = tox.train(frame(spark, docs), frame(spark, labels + [(None, 1, 1), (3, None, None)], LABELS))
    odd = [*odd_documents(), (77, "dumbwit " * 5000, "en", "s", 1), (78, "q" * 5000, "en", "s", 1)]
    df = frame(spark, odd).selectExpr("*", "1 as score", "true as held_out", "2 as toxic", "3 as word")
    got = tox.score_documents(df, model).collect()
    assert len(got) == len(odd) and all(0 <= r[1] <= 1 for r in got)
    scores = {}
    for (_, text, *_), r in zip(sorted(odd, key=str), sorted(got, key=str), strict=False):
        scores.setdefault(r[0], set()).add(r[1])
    empty = {r[1] for r in got if r[0] in (0, 1, 2)}
    assert len(empty) == 1  # null, empty and blank texts score alike
    assert max(r[1] for r in got if r[0] == 77) >= tox.THRESHOLD > max(r[1] for r in got if r[0] == 78)


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_without_both_classes(spark, toxic):
    docs, labels = corpus(12)
    rows = [] if toxic is None else [(i, 1, toxic) for i, _, _ in labels]
    model = tox.train(frame(spark, docs), frame(spark, rows, LABELS))
    assert model is None
    assert {r[1] for r in tox.score_documents(frame(spark, docs), model).collect()} == {0.0}
    assert tox.score_documents(frame(spark, []), model).count() == 0


def test_machine_and_curve_separate():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(1.5, 0.3, (50, 2)), rng.normal(-1.5, 0.3, (80, 2))]
    y = np.r_[np.ones(50), -np.ones(80)]
    w = tox._machine(x, y, np.ones(130))
    assert ((x @ w[:2] + w[2] > 0) == (y > 0)).all()
    slope, shift = tox._curve(x @ w[:2] + w[2], y > 0)
    assert slope > 0 and 1 / (1 + math.exp(-(slope * 2 + shift))) > 0.7
