"""Documents that try every defined case, and brute-force versions of what operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from hashlib import blake2b, sha256
from math import log

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    vowels, rest = "aeiou", "bcdfghlmnprstv"
    word = lambda: "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    words = [word() for _ in range(n)]
    lines, at = [], 0
    while at < n:
        step = rng.randint(5, 20)
        lines.append(" ".join(words[at : at + step]) + ".")
        at += step
    return "\n".join(lines)


def odd_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty, long, equal and repeated rows."""
    rng = random.Random(11)
    base = prose(rng, 400)
    words = base.split(" ")
    near = " ".join(w if i % 97 else "changed" for i, w in enumerate(words))
    texts = [
        None, "", "  \n\t ", "one two three", base, base, near, base[:600] + prose(rng, 200),
        prose(rng, 300) + base[500:1200], prose(rng, 8000), "x " * 60, "é" * 900, "a" * 1500,
        prose(rng, 120), prose(rng, 121), prose(rng, 122), "\x1c\x85 nb\xa0sp " + prose(rng, 30),
        "😀 " + prose(rng, 40) + " 漢字" * 20,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None)
            for i, t in enumerate(texts)]
    rows += [rows[13], rows[13], rows[0], (None, texts[14], "fr", "s1", 3), (None, base, "fr", "s9", 3)]
    return rows


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame(rows, columns).repartition(3)


def words(text):
    return WORD.findall(text or "")


def repeated_bytes(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by counting every window."""
    data = [(t or "").encode() for t in texts]
    window = lambda b, i: blake2b(b[i : i + length], digest_size=12).digest()
    seen = Counter(window(b, i) for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[window(b, i)] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1]))
        out.append((len(b), sum(mask), spans, sha256(kept).hexdigest()))
    return out


def near_classes(rows, threshold=0.8):
    """Classes (lists of doc_id) by all pairs that share a shingle, over (doc_id, text) rows."""
    bags = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in
            (words(t) for _, t in rows)]
    n = sum(t is not None for _, t in rows)
    held = Counter(k for bag in bags for k in bag)
    weights = [{k: c * (1 + min(log(n / held[k]), log(10))) for k, c in bag.items()} for bag in bags]
    whole = [sum(w.values()) for w in weights]
    where = defaultdict(list)
    for i, bag in enumerate(bags):
        for k in bag:
            where[k].append(i)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, (_, text) in enumerate(rows):
        parent[top(i)] = top(first.setdefault(text, i))
    for i, own in enumerate(weights):
        common = Counter()
        for k, w in own.items():
            for j in where[k]:
                if j > i:
                    common[j] += min(w, weights[j][k])
        for j, c in common.items():
            if c / (whole[i] + whole[j] - c) >= threshold:
                parent[top(i)] = top(j)
    classes = defaultdict(list)
    for i, (number, _) in enumerate(rows):
        classes[top(i)].append(number)
    return sorted(sorted(c, key=str) for c in classes.values())


def same_rows(left, right):
    return sorted(map(tuple, left), key=str) == sorted(map(tuple, right), key=str)
