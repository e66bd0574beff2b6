"""Operators on documents against brute force, with every defined case among the rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenota.llm import decontaminate, fertility, licenses, neardup, privacy, repeats
from tests.llm import cases
from tests.llm.cases import frame, odd_documents, prose, words


def empty(spark):
    return frame(spark, []).limit(0)


def test_base_measures_equal_their_definition(spark):
    rows = odd_documents()
    rows.append((77, "a b c d e\na b c d e\n \na b c d e f $#|\n" * 3, "en", "s", 0))
    docs = frame(spark, rows).withColumn("__row", F.lit("clash")).withColumn("kept", F.lit(1))
    got = fertility.judge_documents(docs).collect()
    want = []
    for number, text, *_ in rows:
        text = text or ""
        ws = words(text)
        windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        twice = {w for w, n in Counter(windows).items() if n > 1}
        covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
        lines = [line for line in text.split("\n") if words(line)]
        want.append((number, len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"),
                     len(lines) - len(set(lines)), len(covered),
                     len(ws) < 10 or 100 * len(covered) > 20 * len(ws)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed")
    assert cases.same_rows([[r[n] for n in names] for r in got], want)
    kept = fertility.keep_documents(docs)
    assert kept.columns == docs.columns
    assert cases.same_rows([[r.doc_id] for r in kept.collect()], [[r.doc_id] for r in got if r.kept])
    assert fertility.judge_documents(empty(spark)).count() == 0


def test_fertility_counts_tokens_of_each_word():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    text = "The quick brown fox 漢字漢字 \U00010348\U00010348 jumps over the lazy dog"
    ids = [i for w in text.split() for i in model.encode(w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    row = dict(zip(fertility._NAMES, fertility._measure([text.encode()], fertility.VOCABULARY)[0],
                   strict=True))
    assert row["n_tokens"] == len(ids)
    assert row["n_fallback"] == sum(model.is_byte(i) for i in ids) > 0
    assert row["entropy"] == pytest.approx(-(share * np.log2(share)).sum())


def test_bands_reject_fallback_and_long_tokens(spark):
    rng = random.Random(3)
    strange = " ".join("".join(chr(0x10330 + rng.randrange(20)) for _ in range(6)) for _ in range(40))
    plain = prose(random.Random(2), 200)
    rows = [(1, strange, "en", "s", 0), (2, plain, "en", "s", 0)]
    judged = {r.doc_id: r for r in fertility.judge_documents(frame(spark, rows)).collect()}
    assert not judged[1].base_failed and not judged[1].kept
    assert judged[2].kept


def test_byte_vocabulary_counts_tokens_and_parts():
    coder, _ = fertility._byte_vocabulary(fertility.BYTE_VOCABULARY)
    text = "The quick brown fox 漢字 \U00010348\U00010348 naïve"
    row = dict(zip(fertility._NAMES, fertility._measure([text.encode()], fertility.VOCABULARY)[0],
                   strict=True))
    ids = [i for w in text.split() for i in coder.encode_ordinary(" " + w)]
    parts = [coder.decode_single_token_bytes(i) for i in ids]
    assert row["n_byte_tokens"] == len(ids)
    assert row["n_byte_parts"] == sum(len(p) == 1 and p[0] > 0x7F for p in parts) > 0


def plain_bands(rows):
    """(language or script, length or -1, measure) -> (low, high), by sorting; ``rows`` are judged."""
    groups, docs = defaultdict(list), Counter()
    for r, lang in rows:
        if r.base_failed:
            continue
        docs[lang] += 1
        script = "latin" if r.latin_share >= 0.5 else "other"
        for key in (("l", lang), ("s", script)):
            for length in (-1, int(np.log2(max(r.n_tokens, 1)))):
                for measure, cell in plain_cells(r).items():
                    groups[key, length, measure].append(cell)
    common = {lang for lang, n in docs.items() if lang is not None and n * fertility.RARE >= sum(docs.values())}
    bands = {}
    for key, cells in groups.items():
        cells.sort()
        low, high = (cells[-(-len(cells) * p // 100) - 1] for p in (fertility.LOW, fertility.HIGH))
        slack = max((high - low) * fertility.SLACK, fertility.LEAST_SLACK[key[2]])
        bands[key] = (low - slack, high + slack)
    return bands, common


def plain_cells(r):
    n, b = max(r.n_tokens, 1), max(r.n_byte_tokens, 1)
    values = {"chars": r.word_chars / n, "chars_bytes": r.word_chars / b,
              "fallback": max(r.n_fallback / n, r.n_byte_parts / b), "entropy": r.entropy}
    return {k: int(np.floor(v * 100)) for k, v in values.items()}


def test_bands_equal_sorting_and_reject_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(fertility, "RARE", 20)
    rng = random.Random(8)
    german = ["straße", "über", "größe", "müßte", "schön", "wäre", "verfügung", "zurück", "während"]
    rows = [(i, prose(rng, rng.randint(12, 400)), "en", "s", 0) for i in range(150)]
    rows += [(200 + i, " ".join(rng.choice(german) + rng.choice(["en", "er", "", "heit"]) for _ in range(90)), "de", "s", 0)
             for i in range(40)]
    laced = [" ".join(w + "$%&" * rng.randint(1, 2) for w in prose(rng, 120).split()) for _ in range(2)]
    rows += [(300 + i, text, "en", "s", 0) for i, text in enumerate(laced)]
    rows += [(310, prose(rng, 80), None, "s", 0), (311, prose(rng, 80), "xx", "s", 0)]
    langs = {r[0]: r[2] for r in rows}
    got = fertility.judge_documents(frame(spark, rows).repartition(6)).collect()
    bands, common = plain_bands([(r, langs[r.doc_id]) for r in got])
    assert common == {"en", "de"} and len(got) == len(rows)
    for r in got:
        lang, script = langs[r.doc_id], "latin" if r.latin_share >= 0.5 else "other"
        key = ("l", lang) if lang in common else ("s", script)
        inside = True
        for measure, cell in plain_cells(r).items():
            fits = [bands.get((key, n, measure)) for n in (int(np.log2(max(r.n_tokens, 1))), -1)]
            inside &= any(b and (measure == "fallback" or cell >= b[0]) and cell <= b[1] for b in fits)
        evenness = r.entropy / np.log2(max(r.n_tokens, 2))
        limits = fertility.BANDS[script]
        n = max(r.n_tokens, 1)
        for value, (low, high) in zip((r.word_chars / n, r.n_fallback / n, evenness), limits.values(), strict=True):
            inside &= low <= value <= high
        assert r.in_bands == inside, r
        assert r.kept == (inside and not r.base_failed)
    dropped = {r.doc_id for r in got if not r.kept and not r.base_failed}
    assert dropped >= {300, 301} and len(dropped) <= 5


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = odd_documents()
    common = prose(rng, 60)
    for group in range(4):  # near copies, and texts that share a passage but are not near
        words_ = prose(rng, 150).split(" ")
        for copy in range(12):
            mine = list(words_)
            for _ in range(rng.randint(0, 4)):
                mine[rng.randrange(len(mine))] = "other"
            rows.append((100 + 20 * group + copy, " ".join(mine), "en", "s", 0))
    rows += [(300 + i, common + "\n" + prose(rng, 40), "en", "s", 0) for i in range(20)]
    docs = frame(spark, rows).withColumn("class_id", F.lit("clash"))
    got = neardup.classes_of(docs).collect()
    classes = defaultdict(list)
    for r in got:
        classes[r.class_id, r.class_size].append(r.doc_id)
    want = cases.near_classes([r[:2] for r in rows])
    assert sorted(sorted(c, key=str) for c in classes.values()) == want
    assert all(c == min(x for x in ids if x is not None) and n == len(ids)
               for (c, n), ids in classes.items())
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(c for c, _ in classes)
    assert neardup.classes_of(empty(spark)).count() == neardup.keep_one(empty(spark)).count() == 0
    one = frame(spark, [(None, "just one", None, None, None)] * 2)
    assert neardup.keep_one(one).count() == 1


def test_near_copies_inside_a_family_of_one_template(spark):
    """Similarity is about 0.74 to all of the family and 0.82 to the planted partner, and some pairs
    share crowded buckets only."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    template, rows = fresh(404), []
    for i in range(260):
        head = fresh(7) if i % 2 == 0 or i >= 160 else head  # noqa: F821
        rows.append((i, " ".join(head + template + fresh(14)), "en", "s", 0))
    want = cases.near_classes([r[:2] for r in rows])
    assert sum(len(c) == 2 for c in want) == 80 and len(want) == 180
    classes = defaultdict(list)
    for r in neardup.classes_of(frame(spark, rows)).collect():
        classes[r.class_id].append(r.doc_id)
    assert sorted(sorted(c, key=str) for c in classes.values()) == want


def test_samples_collide_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**63, 400).astype(np.uint64)
    weights = rng.uniform(1, 5, 400)
    left, right = slice(0, 300), slice(100, 400)
    both = np.concatenate([names[left], names[right]])
    w = np.concatenate([weights[left], weights[right]])
    hits = 0
    for seed in range(60):
        keys = np.array([seed, seed + 1000])
        bands = neardup.band_keys(keys, np.array([0, 300]), both ^ np.uint64(seed << 40), w, np.zeros(2))
        hits += (bands[0] == bands[1]).sum()
    similarity = weights[100:300].sum() / weights.sum()
    assert hits / 60 / neardup.BANDS == pytest.approx(similarity**neardup.ROWS, abs=0.05)


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(3, 60))) for i in range(30)] + [(30, None), (31, "")]
    items += [items[4], (40, items[5][1])]
    rows = odd_documents()
    for i in range(12):
        part = items[i][1].split(" ")
        cut = part[: max(5, len(part) * (10 - i % 4) // 10)]
        rows.append((500 + i, prose(rng, 200) + "\n" + " ".join(cut) + " " + prose(rng, 3000 * (i % 2)), "en", "s", 0))
    docs = frame(spark, rows).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    bag = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}
    want = set()
    for number, text, *_ in rows:
        own = bag(text)
        for item, t in items:
            if bag(t) and len(bag(t) & own) >= 0.8 * len(bag(t)):
                want.add((number, item, len(bag(t) & own)))
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == want and len(want) > 5
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    dirty = {(n, t) for n, t, *_ in rows if any(n == x[0] for x in want)}
    assert clean.count() == len([r for r in rows if r[:2] not in dirty])
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_repeated_strings_equal_all_windows(spark):
    rows = odd_documents()
    rng = random.Random(8)
    base = prose(rng, 1500)
    rows += [(600, base[:399], "", "", 0), (601, base[:400], "", "", 0), (602, "ab" * 700, "", "", 0),
             (603, base[900:1400] + "!" + base[900:1400], "", "", 0)]
    for i in range(30):
        at = rng.randint(0, len(base) - 460)
        rows.append((610 + i, prose(rng, 30) + base[at : at + rng.randint(390, 450)] + prose(rng, 30), "", "", 0))
    docs = frame(spark, rows).withColumn("n_removed", F.lit("clash"))
    cut = {r.key: r for r in repeats.repeated_bytes(docs).collect()}
    keys = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).collect()
    want = dict(zip([(i, t) for i, t, *_ in rows],
                    cases.repeated_bytes([r[1] for r in rows], repeats.LENGTH), strict=True))
    for r in keys:
        size, removed, spans, digest = want[r.doc_id, r.text]
        if not removed:
            assert r.key not in cut
            continue
        got = cut[r.key]
        assert (got.n_removed, got.n_spans, got.kept_sha256) == (removed, spans, digest)
        assert sum(s.end - s.begin for s in got.spans) == removed
    assert repeats.repeated_bytes(empty(spark)).count() == 0


def test_long_texts_in_pieces_have_the_same_windows(monkeypatch):
    text = prose(random.Random(9), 2000).encode()
    batch = pa.RecordBatch.from_pydict({"key": [2], "text": [text]})

    def windows():
        out = set()
        for b in repeats._find_runs(iter([batch])):
            for place, first, last in zip(*repeats._unrun(b.column("run").to_numpy()), strict=True):
                out |= {(place, w) for w in range(first, last + 1)}
        return out

    whole = windows()
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert windows() == whole and len(whole) == len(text) - repeats.LENGTH + 1


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for at, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), at, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(10)
    pieces = ["a@b.c", "x.y%z@mail.example.com", "@", "@@", ".", "1.2.3.4", "256.1.1.1", "001.2.3.4", "5.6.7.8.9",
              "4111 1111 1111 1111", "4111111111111111", "378282246310005", "+1 (988) 555-2485", "+12", "-", " ",
              "é", "😀", "4444-3333-2222-1111", "0" * 14, "word", "_", "+", "(", "7"]
    rows = odd_documents()
    rows += [(700 + i, "".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(40)), "", "", 0)
             for i in range(120)]
    rows += [(900, "1" * 30000 + " " + "a" * 30000 + "@", "", "", 0), (901, "+1" + "(" * 9000, "", "", 0)]
    docs = frame(spark, rows).withColumn("base", F.lit("clash"))
    got = privacy.find_personal_data(docs).select("doc_id", privacy.written(F.col("base")).alias("s"))
    assert cases.same_rows(got.collect(), [(i, plain_spans(t)) for i, t, *_ in rows])
    assert privacy.find_personal_data(empty(spark)).count() == 0


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(12)
    mail = "jo.doe@mail.example.com"
    rows = [(i, f"{prose(rng, 20)} wrote Zarathustra99 to {mail} about thing {i}", "", "", 0) for i in range(6)]
    rows += [(50 + i, f"{prose(rng, 20)} wrote of about thing", "", "", 0) for i in range(40)]
    rows.append((99, "Zarathustra99 alone, far from any address", "", "", 0))
    found = {r.doc_id: r for r in privacy.find_personal_data(frame(spark, rows)).collect()}
    for number, text, *_ in rows[:6]:
        terms = {text[t.start : t.stop] for t in found[number].terms}
        assert "Zarathustra99" in terms and not terms & {"about", "thing", "wrote"}
    assert not found[99].terms and not found[50].terms
    docs = frame(spark, rows).withColumn("key", F.xxhash64("text"))
    spans = privacy.find_personal_data(frame(spark, rows)).select(
        F.col("doc_id").alias("d"), F.array_sort(F.concat("base", "terms")).alias("spans")
    )
    clean = docs.join(spans, F.col("doc_id") == F.col("d")).select(
        "doc_id", privacy.sanitised(F.col("text"), F.col("spans")).alias("t")
    )
    clean = {r.doc_id: r.t for r in clean.collect()}
    assert "wrote [TERM] to [EMAIL] about" in clean[0] and clean[99] == rows[-1][1]


def test_a_term_beside_one_address_gives_it_away_in_the_whole_document(spark):
    rng = random.Random(14)
    common = prose(rng, 40)
    text = f"Quillfeather led it. {common} {common} Mail amy.low@one.example.org, {common} signed quillfeather"
    rows = [(1, text, "", "", 0)] + [(10 + i, common, "", "", 0) for i in range(300)]
    found = {r.doc_id: r for r in privacy.find_personal_data(frame(spark, rows)).collect()}
    assert [text[t.start : t.stop] for t in found[1].terms if t.value == "quillfeather"] == ["Quillfeather", "quillfeather"]
    assert not {t.value for t in found[1].terms} & {"low", "one", "example", *common.lower().replace(".", "").split()}
    assert not any(found[i].terms for i in found if i != 1)


def test_licenses_equal_containment_in_whole_texts(spark):
    rng = random.Random(13)
    notice = licenses.TEMPLATES["MIT-notice"].split(" ")
    rows = odd_documents()
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for gap in (0, 3, 17):
            rows.append((800 + 10 * i + gap, prose(rng, 5 + gap) + f" “{text}.” ".replace("“", "(").replace("”", ")") + prose(rng, 40), "", "", 0))
    changed = list(notice)
    changed[20] = "changed"
    rows.append((990, prose(rng, 30) + " " + " ".join(changed).upper() + "\n" + prose(rng, 30), "", "", 0))
    docs = frame(spark, rows).withColumn("template", F.lit("clash"))
    got = licenses.scan_licenses(docs).collect()
    plain = lambda t: [w.lower().strip(".,;:!?()[]{}\"'`*") for w in words(t)]
    bag = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    want = set()
    for number, text, *_ in rows:
        for name, template in licenses.TEMPLATES.items():
            wanted = bag(plain(template), min(5, len(words(template))))
            if len(wanted & bag(plain(text), min(5, len(words(template))))) >= 0.8 * len(wanted):
                want.add((number, name))
    assert {(r.doc_id, r.template) for r in got} == want
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        held = plain(" ".join(words(texts[r.doc_id])[r.first_word : r.end_word]))
        assert bag(held, 5) & bag(plain(licenses.TEMPLATES[r.template]), 5)
    assert licenses.scan_licenses(empty(spark)).count() == 0
