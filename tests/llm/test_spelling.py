"""Spelling variants against all pairs."""

import random
import re
import zlib
from itertools import combinations

import pytest

from lumenota.llm import spelling
from tests.llm.cases import frame, odd_documents, prose

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    counts = {}
    for row in rows:
        for run in RUN.findall(row[1] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


def brute_variants(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return rows


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def planted(seed=3):
    """Families of words one edit apart, of one letter, with repeated bigrams, and in chains."""
    rng = random.Random(seed)
    letters = "abcdeéÿÀ×"
    words = []
    for size in (7, 8, 9, 14, 40):
        for _ in range(12):
            base = "".join(rng.choice(letters) for _ in range(size))
            words.append(base)
            for _ in range(6):
                at, c = rng.randrange(size + 1), rng.choice(letters)
                words.append(
                    rng.choice([base[:at] + c + base[at:], base[:at] + base[at + 1 :], base[:at] + c + base[at + 1 :]])
                )
    words += ["a" * n for n in range(7, 13)] + ["ab" * n for n in range(4, 8)]
    words += ["aaaaaaab", "baaaaaaa", "aaabaaaa", "x" * 3000, "x" * 2999 + "y", "x" * 3001]
    words = [w for w in dict.fromkeys(words) if len(w) >= 7]
    weight = lambda i: (2, 3, 25, 260)[i % 4 if i % 9 else 3]
    return {w: weight(i) for i, w in enumerate(words)}


def test_near_words_of_planted_families(spark):
    counts = planted()
    df = frame(spark, list(counts.items()), "word string, n long")
    got = rows_of(spelling.spelling_variants(df))
    assert len(got) == len(counts)
    assert set(got) == brute_variants(counts)


def test_chains_reach_their_root(spark):
    counts = {"variant": 2, "variants": 30, "variantss": 400, "variantsss": 5000, "lonesome": 9}
    df = frame(spark, list(counts.items()), "word string, n long")
    got = {r[0]: r for r in rows_of(spelling.spelling_variants(df))}
    assert got["variant"][1:3] == ("variants", "variantsss")
    assert got["lonesome"] == ("lonesome", None, "lonesome", 9, 0, None)
    assert set(got.values()) == brute_variants(counts)


def test_whole_query_on_odd_documents(spark):
    rng = random.Random(5)
    base = [w for w in prose(rng, 60).replace(".", "").split() if len(w) > 6]
    rows = odd_documents()
    for i in range(400):
        rows.append((1000 + i, " ".join(rng.choice(base).capitalize() for _ in range(30)), "en", "s", 1))
    counts = brute_counts(rows)
    extra = frame(spark, rows).selectExpr("*", "1 as word", "2 as n", "3 as run", "4 as id", "5 as key")
    got = rows_of(spelling.spelling_variants(spelling.word_counts(extra)))
    assert set(got) == brute_variants(counts) and len(got) == len(counts)
    assert any(r[1] for r in got)


def test_empty_table_and_ratio(spark):
    nothing = spelling.spelling_variants(spelling.word_counts(frame(spark, [])))
    assert nothing.count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, [], "word string, n long"), ratio=1)


def test_rarest_disjoint_against_all_choices():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(14), rng.randint(3, 8)))
        costs = [rng.randint(1, 9) for _ in places]
        took = spelling.rarest_disjoint(places, costs)
        best = min(costs[i] + costs[j] for i, j in combinations(range(len(places)), 2)
                   if places[j] - places[i] >= 2)
        assert len(took) == 2 and places[took[1]] - places[took[0]] >= 2
        assert sum(costs[i] for i in took) == best
