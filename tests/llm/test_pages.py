"""WARC and URL operators against plain Python, with every defined case among the rows."""

import random
import re
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from lumenota.llm import urls, warc

COLUMNS = "page_id long, url string, html string"


def odd_pages():
    rng = random.Random(3)
    long = "<p>" + "é word\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 4000
    same = "<html>" + "same " * 40
    rows = [
        (1, "https://a.example.net/en/1?x=1&y=2#t", same), (2, "HTTP://B.Example.COM/de/", same),
        (3, None, same), (4, "no scheme", None), (5, "", ""), (6, "x://", "small"), (7, "y://h", "small"),
        (8, "z://É.org/fr/x", long), (9, "a://b\r\nc/d", long), (None, "n://n.net/", same),
        (None, None, "nobody " * 30), (11, "q://example.net?u=1/2", "b" * 99), (12, "q://net/", "b" * 99),
    ]
    rows += [(20 + i, f"https://h{i}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'fr', 'de'])}/{i}",
              f"<p>{rng.random()}" * rng.randint(1, 30)) for i in range(80)]
    return rows + [rows[0], rows[0], rows[5]]


def test_archives_give_every_capture_back(spark, tmp_path):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, COLUMNS).withColumn("type", F.lit("clash")).repartition(4)
    folder = f"file://{tmp_path}/archives"
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder)
    assert Counter(r.type for r in records.select("type").collect())["request"] == len(rows)
    got = warc.assemble(records).collect()
    first = {}
    for number, _, html in rows:
        if number is not None and len((html or "").encode()) >= warc.MIN_REVISIT:
            first[html] = min(first.get(html, number), number)
    want, kept = [], Counter()
    for number, _, html in rows:
        head = first.get(html, number)
        again = head is not None and head != number
        want.append((number, len((html or "").encode()), "revisit" if again else "response",
                     head if again else None))
        if not again:
            kept[(html or "").encode()] += 1
    assert sorted(((r.metadata.page_id, r.full_bytes, r.type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert Counter(bytes(r.response.payload) for r in got if r.type == "response") == kept
    assert all(r.request.uri == r.response.uri for r in got)
    digest = {number: sha256((html or "").encode()).hexdigest() for number, _, html in rows}
    assert all(r.response.declared_digest == "sha256:" + digest[r.metadata.page_id] for r in got
               if r.metadata.page_id is not None)


def test_an_empty_table_archives_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], COLUMNS), folder)
    assert warc.assemble(warc.read_records(spark, folder)).count() == 0


def plain_parts(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group() if rest[len(host) :][:1] == "/" else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_rules_hosts_and_verdicts(spark):
    rows = odd_pages()
    host, path = urls.host_and_path(F.col("url"))
    pages = spark.createDataFrame(rows, COLUMNS).select("page_id", "url", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("rule", urls.fitting_rule(F.col("host"), F.col("path"), urls.RULES))
    labelled = pages.where("rule is not null").withColumn("blocked", F.col("rule.block"))
    model = urls.fit(labelled)
    got = urls.judge(pages, model).select("page_id", "url", "host", "path", "rule", "verdict", "model_blocks")
    want = []
    for number, url, _ in rows:
        h, p = plain_parts(url)
        fits = [r for r in urls.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.shown()), default=None)
        want.append((number, url, h, p, best.shown() if best else None,
                     ("block" if best.block else "allow") if best else None))
    rows = got.collect()
    model_says = lambda r: "block" if r.model_blocks else "allow"
    seen = [(*r[:5], r.verdict if r.rule else None) for r in rows]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert all(r.verdict == model_says(r) for r in rows if r.rule is None)
    assert urls.judge(pages.limit(0), model).count() == 0
    nothing = urls.judge(pages, urls.fit(labelled.limit(0))).where("rule is null").select("verdict")
    assert {r.verdict for r in nothing.collect()} == {"allow"}


def test_model_learns_lexical_signs_of_held_out_urls(spark):
    rng = random.Random(1)

    def one(i):
        bad = i % 2 == 0
        name = "".join(rng.choice("0123456789xq" if bad else "aeioulmnrst") for _ in range(12))
        tail = "?" + "&".join(f"p{j}={rng.random()}" for j in range(rng.randint(3, 6))) if bad else ""
        url = f"https://{name}.example.{rng.choice(['com', 'org'])}/{i}{tail}"
        return url, *plain_parts(url), bad

    rows = [one(i) for i in range(400)]
    df = spark.createDataFrame(rows, "url string, host string, path string, blocked boolean")
    model = urls.fit(df.where(F.crc32("url") % 4 > 0))
    judged = urls.predict(df.where(F.crc32("url") % 4 == 0), model)
    right = judged.where(F.col("model_blocks") == F.col("blocked")).count()
    assert right >= 0.95 * judged.count() > 50


def test_features_of_a_url(spark):
    df = spark.createDataFrame([("https://a.b.example.org/x//y/z?k=1&l=&m#f", "a.b.example.org", "/x//y/z")],
                               "url string, host string, path string")
    r = urls.with_features(df).first()
    assert (r.depth, r.n_params, r.suffix, r.n_chars) == (3, 3, "org.example", len(r.url))
    assert r.digit_ratio == 1 / len(r.url) and 3 < r.entropy < 5


LABELLED = "url string, host string, path string, blocked boolean"


def test_urls_of_one_suffix_get_different_verdicts(spark):
    """Every suffix is blocked as often as not, so only the other features can tell."""
    rng = random.Random(2)

    def one(i):
        bad = i % 2 == 0
        digits = "".join(rng.choice("0123456789") for _ in range(14)) if bad else "page"
        url = f"https://h{rng.choice('abc')}.example.com/{'x/' * rng.randint(1, 3)}{digits}"
        return url, *plain_parts(url), bad

    rows = {r[0]: r for r in map(one, range(600))}
    df = spark.createDataFrame(list(rows.values()), LABELLED)
    plain = [f"https://new.example.com/{'y/' * k}page" for k in (1, 2)]
    odd = [f"https://new.example.com/{'y/' * k}98127364519283" for k in (1, 2)]
    fresh = spark.createDataFrame([(u, *plain_parts(u), "own", 0.5) for u in plain + odd],
                                  "url string, host string, path string, suffix string, entropy double")
    got = urls.predict(fresh, urls.fit(df))
    assert got.columns == [*fresh.columns, "model_blocks"]  # a caller's columns keep their values
    assert {(r.suffix, r.entropy) for r in got.collect()} == {("own", 0.5)}
    assert {r.url for r in got.where("model_blocks").collect()} == set(odd)


def test_suffix_rates_count_every_labelled_row(spark):
    rng = random.Random(5)
    rows = []
    for i in range(500):
        url = f"https://s{i % 40}.d{i % 40}.org/{i}"
        rows += [(url, *plain_parts(url), rng.random() < (i % 40) / 40)] * rng.randint(1, 3)
    hot = "https://s1.d1.org/hot"
    rows += [(hot, *plain_parts(hot), True)] * 300
    model = urls.fit(spark.createDataFrame(rows, LABELLED).repartition(5), fit_rows=40)
    base = sum(r[3] for r in rows) / len(rows)
    want = {}
    for k in range(40):
        own = [r[3] for r in rows if r[1] == f"s{k}.d{k}.org"]
        want[f"org.d{k}"] = (sum(own) + urls.PRIOR * base) / (len(own) + urls.PRIOR)
    got = {r.suffix: r.suffix_rate for r in model.suffixes.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(model.base_rate - base) < 1e-12 and model.trees is not None


def test_the_fit_sample_holds_distinct_urls_of_both_labels(spark):
    rows = [(f"u://a.org/{i}", "a.org", f"/{i}", i % 10 == 0) for i in range(200)]
    rows += [rows[1]] * 400 + [(None, "", "", True), ("u://both", "both", "", True), ("u://both", "both", "", False)]
    df = spark.createDataFrame(rows, LABELLED).selectExpr("*", "host AS suffix", "0L AS fold")
    sample = urls.fit_sample(df, 20).collect()
    assert Counter(r.label for r in sample) == {0.0: 10, 1.0: 10}
    assert len({r.url for r in sample}) == 20
    weights = {r.label: r.weight for r in sample}
    assert weights == {0.0: 18.0, 1.0: 2.2}
    whole = {r.url: r.label for r in urls.fit_sample(df, 1000).collect()}
    assert len(whole) == 202 and whole["u://both"] == whole[None] == 1.0


def test_frequent_and_rare_suffixes_get_the_same_rates(spark, monkeypatch):
    rows = [(f"u://h{i}.d{i % 7}.org", f"h{i}.d{i % 7}.org") for i in range(70)] + [(None, None)] * 30
    df = spark.createDataFrame(rows, "url string, host string").selectExpr(
        "*", "concat_ws('.', slice(reverse(split(host, '[.]')), 1, 2)) AS suffix")
    rates = spark.createDataFrame([(f"org.d{k}", k / 10) for k in range(5)], "suffix string, suffix_rate double")
    model = urls.UrlModel(rates, 0.25, None)
    for share in (0, 5, 10_000):  # none, one and all suffixes are broadcast
        monkeypatch.setattr(urls, "HOT_SHARE", share)
        got = urls._rated(df, model).collect()
        assert len(got) == 100
        for r in got:
            k = int(r.suffix[-1]) if r.suffix else 9
            assert r.suffix_rate == (k / 10 if k < 5 else 0.25)
