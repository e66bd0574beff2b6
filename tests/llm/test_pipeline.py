"""Each stage of the pipeline against brute force over what the stage before it kept."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lumenota.llm import mixing
from tests.llm import cases
from tests.llm.cases import frame, odd_documents, words

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no driver tables")


def bag(text):
    ws = words(text)
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(r[0] if r[0] is None else r[0] + 10**6, *r[1:]) for r in odd_documents()]
    docs = docs.unionByName(frame(spark, odd)).withColumn("shard", F.lit("clash"))
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], FOLDER).cache())
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    rows = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in seen[:5]]
    assert all(d.columns == docs.columns for d in seen[:5])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    for number, text in rows[0]:  # clean documents stay
        ws = words(text)
        windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        repeats = any(n > 1 for n in windows.values())
        littered = 10 * sum((text or "").count(c) for c in "#*$%&|<>") > len(ws)  # the bands' to judge
        if len(ws) >= 10 and not repeats and not littered and number != 10**6 + 17:
            assert ids[1][number]
        if number in good and len(ws) >= 10 and not repeats:
            assert ids[1][number]
        if len(ws) < 10:
            assert (number, text) not in rows[1]
    classes = cases.near_classes(rows[1])
    assert sorted(ids[2].elements()) == sorted(min(x for x in c if x is not None) for c in classes)
    dirty = {n for n, t in rows[2] if any(len(bag(i) & bag(t)) >= 0.8 * len(bag(i)) for i in items if bag(i))}
    assert ids[3] == ids[2] - Counter(dict.fromkeys(dirty, 1)) and dirty
    takes = {r.doc_id: len(r.takes) for r in mixing.mix_units(seen[3]).collect()}
    assert ids[4] == Counter({n: k for n, k in takes.items() if k})
    assert ids[5] == ids[4]
    slots = defaultdict(list)
    for r in seen[5].select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_an_empty_table_passes_every_stage(spark):
    docs = frame(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
