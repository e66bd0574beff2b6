"""Hilbert curve, sharding, mixing, components and the shared helpers."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenota.llm import mixing, sharding
from lumenota.llm.common import prefix_sums, ranked
from lumenota.operators.components import components
from tests.llm.cases import COLUMNS, frame, odd_documents, words


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (1, 3)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, [f"x{i}" for i in range(n)])
    index = sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)
    place = {r["i"]: tuple(r)[:n] for r in df.withColumn("i", index).collect()}
    assert sorted(place) == list(range(1 << n * bits))
    steps = (zip(place[i], place[i + 1], strict=True) for i in range(len(place) - 1))
    assert all(sum(abs(a - b) for a, b in step) == 1 for step in steps)


def test_ranks_and_sums_over_all_rows(spark):
    values = [(i % 7, i) for i in range(200)] + [(None, 500)]
    df = spark.createDataFrame(values, "k long, v long").repartition(5)
    order = sorted(values, key=lambda x: (x[0] is not None, x[0], x[1]))
    got = {r.v: (r.rank, r.before) for r in prefix_sums(
        ranked(df, ["k", "v"], "rank"), ["k", "v"], {"before": "v"}).collect()}
    total = 0
    for at, (_, v) in enumerate(order):
        assert got[v] == (at, total)
        total += v


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    links += [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for link in links for x in link}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    want = {x: top(x) for x in parent if sum(x in link and len(set(link)) > 1 for link in links)}
    df = spark.createDataFrame(links, "a long, b long")
    got = components(df).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert components(df.limit(0)).count() == 0


def test_shards_are_even_and_gapless(spark):
    rows = odd_documents()
    docs = frame(spark, rows).withColumn("shard", F.lit("clash")).withColumn("rank", F.lit(1))
    got = sharding.shard_documents(docs, shards=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert len(got) == len(rows) and len(slots) == 4 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    crc = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                  for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == crc
    again = sharding.shard_documents(docs.repartition(2), shards=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def refilled(sizes, weights):
    """Targets by resharing the excess again and again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while free:
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        for i in over or free:
            target[i] = 3.0 * sizes[i] if over else share[i]
        if not over:
            break
        rest -= sum(3 * sizes[i] for i in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_equal_repeated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 10, 200, 1000, 5000]) for _ in range(9)]
    names = [f"s{i}" for i in range(8)] + [None]
    sources = spark.createDataFrame(list(zip(names, sizes, strict=True)),
                                    "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    want = refilled(sizes, [(5, 2, 1)[i % 3] for i in range(9)])
    assert [got[n] for n in names] == pytest.approx(want)


def test_mix_takes_targets_and_repeats_rows(spark):
    rows = odd_documents()
    docs = frame(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix_documents(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in rows)
    source = {(i, len(words(t))): s for i, t, _, s, _ in rows}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position < 1
        name = source[r.doc_id, r["size"]]
        taken[name] += r.taken
        target[name] = r.target
    # repeated rows take equal whole shares, so a source can stay short by their number
    assert all(target[s] - 4 <= taken[s] <= target[s] + 1 for s in target)
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    order = mixing.training_order(docs)
    assert order.columns == docs.columns
    times = Counter(r.doc_id for r in order.collect())
    for r in got:
        if r.doc_id is not None and r.doc_id not in (0, 13):
            assert times[r.doc_id] == -(-r.taken // max(r["size"], 1))


def test_schedules_move_sources_in_time(spark):
    share = spark.range(0, 101).select((F.col("id") / 100).alias("x"))
    one = lambda a, b: [
        r[0] for r in share.select(mixing.position_of(F.col("x"), F.lit(a), F.lit(b))).collect()
    ]
    late, even, early = one(0.5, 1.5), one(1.0, 1.0), one(1.5, 0.5)
    assert even == pytest.approx([i / 100 for i in range(101)])
    assert all(a >= b >= c for a, b, c in zip(late, even, early, strict=True))
    assert late[-1] == pytest.approx(1) and early[0] == 0
    for t, x in zip(late, range(101), strict=True):  # the integral of the schedule is the share
        assert 0.5 * t + 0.5 * t * t == pytest.approx(x / 100)


def test_schema_of_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert mixing.training_order(docs).columns == docs.columns
