import json

import pytest
from pyspark.sql import functions as F

from lumenota.operators import rules
from lumenota.operators.evaluate import grade_answers
from lumenota.sources import nfe, records, sinks, tables
from tests.fixtures import frame, invoice, xml


def test_xml_round_trip(spark, tmp_path):
    for number in (1, 2):
        (tmp_path / f"case-{number}.xml").write_text(xml(invoice(number)), encoding="utf-8")
    broken = xml(invoice(3)).replace("<CRT>3</CRT>", "").replace("<ICMS00>", "<OTHER>", 1)
    (tmp_path / "case-3.xml").write_text(broken.replace("</ICMS00>", "</OTHER>", 1), encoding="utf-8")
    good, bad = nfe.quarantine(nfe.read_nfe(spark, str(tmp_path)))
    rows = {r.case_id: r for r in bad.collect()}
    assert set(rows) == {"case-3"} and {"emit/CRT", "imposto/ICMS"} <= set(rows["case-3"].problems)
    assert rules.truth_gate(rules.validate(good, "2026-04-01")).count() == 0
    numbered = good.withColumn("case_id", F.regexp_extract("case_id", r"([0-9]+)$", 1).cast("bigint"))
    truth = frame(spark, [invoice(1), invoice(2)])
    cases = truth.select("case_id", F.lit("success").alias("status"))
    assert [r.correct for r in grade_answers(cases, truth, numbered).cases.collect()] == [True, True]


def write_lines(path, lines, end="\n"):
    path.write_bytes(("\n".join(lines) + end).encode())


def test_later_record_wins_and_a_torn_tail_is_dropped(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    lines = ['{"case_id":"a","status":"harness_error"}', "", '{"case_id":"b","status":"completed"}',
             '{"case_id":"a","status":"completed","run_id":"x y"}', '{"case_id":"c","sta']
    write_lines(path, lines, end="")
    rows = {r.case_id: r.status for r in records.read_records(spark, str(path)).collect()}
    assert rows == {"a": "completed", "b": "completed"}
    write_lines(path, lines)
    with pytest.raises(records.BadRecord, match="invalid JSON"):
        records.read_records(spark, str(path))
    write_lines(path, ['{"case_id":"../x"}', '{"case_id":"a"}'])
    with pytest.raises(records.BadRecord, match="characters outside"):
        records.read_records(spark, str(path))


def invoice_json(**changes):
    data = invoice(1)
    text = json.loads(json.dumps(data, default=str))
    text.pop("case_id")
    text.update(changes)
    return json.dumps(text)


def test_strict_invoice_texts(spark):
    missing = json.loads(invoice_json())
    del missing["totals"]["freight"]
    texts = {
        "ok": (invoice_json(), []),
        "extra": (invoice_json(extra=1), ["$"]),
        "type": (invoice_json(number="7"), ["number"]),
        "member": (json.dumps(missing), ["totals", "totals.freight"]),
        "leaf": (invoice_json(issue_date="2026-02-30"), ["issue_date"]),
        "null": (invoice_json(series=None), ["series"]),
        "text": ("not json", ["$"]),
        "array": ("[]", ["$"]),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "name string, raw string")
    rows = {r.name: r for r in records.parse_invoice(df, "raw").collect()}
    assert {name: rows[name].violations for name in texts} == {n: v[1] for n, v in texts.items()}
    assert rows["ok"].parse_status == "ok" and len(rows["ok"].invoice["items"]) == 6
    assert rows["null"].invoice is None


def test_small_tables(spark, tmp_path):
    prices = {"pricing_version": "p", "aliases": {"x-1": "x"},
              "models": {"x": {"input": "1.00", "cache_write_5m": "1.25", "cache_write_1h": "2.00",
                               "cache_read": "0.10", "output": "5.00"}}}
    (tmp_path / "prices.json").write_text(json.dumps(prices, indent=1))
    rates, aliases = tables.read_prices(spark, str(tmp_path / "prices.json"))
    assert str(rates.first().output) == "5.0000" and aliases.first().target == "x"
    manifest = {"dataset": "d", "cases": [{"case_id": "a", "split": "dev"}, {"case_id": "b", "split": "test"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest, indent=1))
    cases = tables.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert [r.case_id for r in tables.select_cases(cases, split="dev").collect()] == ["a"]
    with pytest.raises(tables.SelectionRefused, match="held-out"):
        tables.select_cases(cases)
    with pytest.raises(tables.SelectionRefused, match="unknown"):
        tables.select_cases(cases, split="dev", wanted=spark.createDataFrame([("zz",)], "case_id string"))
    state = tables.read_run_state(spark, str(tmp_path / "none.json")).first()
    assert state.problem == "missing"
    (tmp_path / "run.json").write_text('{"case_ids": ["a"], "stopped_reason": null}')
    assert tables.read_run_state(spark, str(tmp_path / "run.json")).first().problem is None
    labels = {"labelling_version": "v", "cases": [{"case_id": "a", "decision": "approve", "cause": "none"},
                                                  {"case_id": "b", "decision": "reject"}]}
    (tmp_path / "labels.json").write_text(json.dumps(labels))
    assert [r.usable for r in tables.read_labels(spark, str(tmp_path / "labels.json")).collect()] == [True, False]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "b int, a string")
    sinks.write_summary(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/summary_json")).first().value == '{"a":null,"b":1}'
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.publish_once(df, str(tmp_path / "out/summary"))
    records.append_records(df, str(tmp_path / "log"))
    records.append_records(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    hashed = tables.content_hash(spark, str(tmp_path / "f.bin")).first()
    assert hashed.sha256 == hashlib.sha256(b"abc").hexdigest()


def test_files_are_hashed_as_streams_of_any_bytes(spark, tmp_path):
    import gzip
    import hashlib
    import random

    rng, mark = random.Random(7), b"\xef\xbb\xbf"
    texts = {
        "end": b"a\n", "open": b"a\r\nb", "blank": b"\n\n", "mark": mark, "marked": mark + b"x\n",
        "split.parquet": rng.randbytes(300_000), "zeros": bytes(200_000), "packed.gz": gzip.compress(b"abc"),
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    size, limit = "spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength"
    before = {key: spark.conf.get(key) for key in (size, limit)}
    try:
        spark.conf.set(size, "32k")
        spark.conf.set(limit, "100000")  # longer files cannot be one row, like those of 2 GiB
        rows = tables.content_hash(spark, str(tmp_path)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in rows}
    assert found == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in texts.items()}


def test_only_a_torn_end_is_left_out(spark, tmp_path):
    good, more, torn = '{"case_id":"a","status":"x"}', '{"case_id":"b","status":"y"}', '{"case_id":"c'
    read = lambda name: {r.case_id for r in records.read_records(spark, f"{tmp_path}/{name}").collect()}
    for name, text in (("torn", f"{good}\n{more}\n{torn}"), ("whole", f"{good}\n\n{more}\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.jsonl").write_text(text)
        assert read(name) == {"a", "b"}
    for name, text in (("middle", f"{good}\n{torn}\n{more}"), ("ended", f"{good}\n{torn}\n"),
                       ("list", f"{good}\n[1]"), ("two", f"{torn}\n{torn}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.jsonl").write_text(text)
        with pytest.raises(records.BadRecord):
            read(name)


def test_bad_decision_case_ids_are_refused(spark):
    texts = spark.createDataFrame([('{"case_id":"../x","extraction":{"status":"success"}}',)], "value string")
    with pytest.raises(Exception, match="not a decision case id"):
        tables.decision_cases(texts).collect()
