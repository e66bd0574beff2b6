"""The drawn resamples against plain integers, and their sums against a loop."""

import random
from hashlib import md5

import numpy as np

from lumenota.operators import measure as m


def draw(unit: str, resample: int) -> int:
    start = int(md5(f"{m.BOOTSTRAP_SEED}:{unit}".encode()).hexdigest()[: m.UNIT_DIGITS], 16)
    x = (start + resample * m.RESAMPLE_STEP % m.PRIME) % m.PRIME
    for constant in m.ROUNDS:
        x = x * (x + constant) % m.PRIME
    return sum(x >= t for t in m.poisson_thresholds())


def test_weights_are_poisson_and_independent():
    units = np.arange(1500)  # neighbours, the worst case for a weak mix
    weights = m.poisson_weights(units, 1500)
    assert abs(weights.mean() - 1) < 0.005 and abs(weights.var() - 1) < 0.01
    for side in (weights[:200], weights.T[:200]):
        off = np.corrcoef(side) - np.eye(200)
        assert abs(off.std() - 1500**-0.5) < 0.002 and np.abs(off).max() < 0.15


def test_sums_by_group_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, f"u{u}", rng.randint(0, 50), rng.choice([0, 1, None]))
            for u in range(300) for g in ("a", "b", None) if rng.random() < 0.7]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "grp string, base_case string, right int, n int").repartition(5)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in m.bootstrap_sums(df, ["right", "n"], 20, by=("grp",)).collect()}
    want = {}
    for group, unit, right, n in rows:
        for r in range(20):
            w = draw(unit, r)
            a, b = want.get((group, r), (0, 0))
            want[group, r] = (a + w * right, b + w * (n or 0))
    assert got == want
    assert m.bootstrap_sums(df.limit(0), ["right"], 20).count() == 0


def test_interval_of_a_known_rate(spark):
    rows = [(f"u{u}", 1 if u % 4 else 0, 1) for u in range(400)]
    sums = m.bootstrap_sums(spark.createDataFrame(rows, "base_case string, k int, n int"), ["k", "n"], 4000)
    (row,) = m.bootstrap_interval(sums, {"rate": ("k", "n")}).collect()
    assert row.resamples == 4000
    assert abs(float(row.low) - (0.75 - 1.96 * 0.02165)) < 0.006
    assert abs(float(row.high) - (0.75 + 1.96 * 0.02165)) < 0.006


def test_a_units_rows_come_together(spark):
    """Units in order, each drawn once; before, every batch that held one of its rows drew it again."""
    df = spark.createDataFrame([("a", "u", 1)], "grp string, base_case string, k int")
    plan = m.bootstrap_sums(df, ["k"], 20, by=("grp",))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "MapInArrow" in line)
    assert "Sort [__unit" in lines[at + 1] and "RepartitionByExpression [__unit" in lines[at + 2]


def test_every_draw_of_a_unit():
    for unit in ("u1", "u2"):
        start = int(md5(f"{m.BOOTSTRAP_SEED}:{unit}".encode()).hexdigest()[: m.UNIT_DIGITS], 16)
        weights = m.poisson_weights(np.array([start]), 700)[:, 0]
        assert weights.tolist() == [draw(unit, r) for r in range(700)]
