"""The filter audit against a walk through every order, document by document."""

import random
import re
from itertools import permutations

from lumenota.llm import audit
from tests.llm.cases import frame, odd_documents, prose, words

LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """The failed filters of each (doc_id, text, ...) row."""
    out = []
    for number, text, *_ in rows:
        text = text or ""
        ws, failed = words(text), set()
        if len(ws) < 50:
            failed.add("A")
        if 100 * len(set(ws)) < 65 * len(ws):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            failed.add("C")
        if re.search("[#$%&*|]", text):
            failed.add("D")
        if number is not None and any(
            n is not None and n < number and (t or "") == text for n, t, *_ in rows
        ):
            failed.add("E")
        out.append(failed)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = failures(rows)
    out = []
    for part in {r[3] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[3] or "") == part]
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                steps.append(
                    ["".join(order), step, letter, len(left), len(gone),
                     sum(letter in f for _, f in own) - len(gone),
                     sum(f == {letter} for _, f in own),
                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                )
        total = {x: sum(s[4] for s in steps if s[2] == x) for x in "ABCDE"}
        out += [(part, *s, total[s[2]]) for s in steps]
    return out


def documents(seed=4):
    rng = random.Random(seed)
    rows = odd_documents()
    for i in range(60):
        text = prose(rng, rng.randint(20, 120))
        if i % 4 == 0:
            text = text.upper()[:30] + text
        if i % 5 == 0:
            text += " #tag"
        if i % 6 == 0:
            text = " ".join([text.split()[0]] * 70)
        rows.append((100 + i, text, "en", f"s{i % 3}", i))
        if i % 7 == 0:
            rows.append((200 + i, text, "en", None if i % 2 else "", i))
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < 0.6]
    return rows, labels + labels[:3] + [(None, 1, 1), (99999, 1, 1)]


def test_every_order_and_step(spark):
    rows, labels = documents()
    docs = frame(spark, rows).selectExpr("*", "1 as part", "'x' as digest", "2 as n", "3 as good", "4 as bits")
    counts = audit.failure_counts(docs, frame(spark, labels, LABELS))
    got = [tuple(r) for r in audit.interactions(counts).collect()]
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({r[3] or "" for r in rows})
    assert sorted(got) == sorted(want)


def test_shapley_of_all_orders_sums_to_what_is_removed(spark):
    rows, labels = documents(8)
    counts = audit.failure_counts(frame(spark, rows), frame(spark, labels, LABELS))
    one = audit.interactions(counts).filter("filter_order = 'ABCDE'").groupBy("part")
    for r in one.agg({"shapley": "sum", "removed": "sum"}).collect():
        assert r["sum(shapley)"] == 120 * r["sum(removed)"]


def test_empty_tables(spark):
    nothing = frame(spark, [])
    labels = frame(spark, [], LABELS)
    assert audit.interactions(audit.failure_counts(nothing, labels)).count() == 0
    rows, _ = documents()
    counts = audit.failure_counts(frame(spark, rows), labels)
    assert {(r.good_lost, r.toxic_lost) for r in audit.interactions(counts).collect()} == {(0, 0)}
