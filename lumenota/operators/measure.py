"""Measures of a graded run: rates with intervals, slices, row metrics, totals and percentiles.

Every measure is one pre-aggregated grouping; a report key (scope, slice, layer) is exploded from a
short array beside the case, so membership never needs a join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenota.functions.numbers import rate4, wilson_bounds
from lumenota.operators.grading import (
    EXCLUDED_STATUSES,
    GRADED_STATUSES,
    HEADER_FIELDS,
    INSTALLMENT_COLUMNS,
    ITEM_COLUMNS,
    OUTCOME_STATUSES,
)
from lumenota.operators.ordering import running_before
from lumenota.operators.tags import TAG_ORDER

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICES_VERSION = "slices-1"
BOOTSTRAP_SEED = "20261101"
#: Fixed value: the resamples of the published intervals.
RESAMPLES = 10_000


def _count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


# --- scopes and slices ------------------------------------------------------------------------


def _tag_slice(tag: str) -> Column:
    return F.array_contains("case_tags", tag)


def _rendering_slice(kind: str, severity: str | None = None) -> Column:
    level = F.col("severity").isNull() if severity is None else F.col("severity") == severity
    return (F.col("rendering") == kind) & level


def slice_predicates() -> tuple[tuple[str, Column], ...]:
    """The declared slices over tags, the barcode flag, rendering and severity."""
    tagged = (
        ("regime=normal", "regime_normal"),
        ("regime=simples", "simples_nacional"),
        ("length=short", "short"),
        ("length=medium", "medium"),
        ("length=many_items", "many_items"),
        ("multi_page=yes", "multi_page"),
        ("multi_page=no", "single_page"),
        ("alphanumeric_cnpj=yes", "alphanumeric_cnpj"),
        ("cpf_recipient=yes", "cpf_recipient"),
        ("st_deferral=yes", "st_deferral"),
        ("mixed_tax_codes=yes", "mixed_tax_codes"),
        ("long_text=yes", "long_text"),
        ("confusable=yes", "confusable"),
    )
    degraded = [
        (f"rendering={kind}/{level}", _rendering_slice(kind, level))
        for kind in ("rotation", "blur", "low_dpi")
        for level in ("mild", "severe")
    ]
    return (
        *((name, _tag_slice(tag)) for name, tag in tagged),
        ("barcode_readable=yes", F.col("barcode_readable") == F.lit(True)),
        ("barcode_readable=no", F.col("barcode_readable") == F.lit(False)),
        ("rendering=text", _rendering_slice("text")),
        ("rendering=image_clean", _rendering_slice("image_clean")),
        ("rendering=barcode_damaged", _rendering_slice("barcode_damaged")),
        *degraded,
    )


SLICE_IDS = (
    "regime=normal", "regime=simples", "length=short", "length=medium", "length=many_items",
    "multi_page=yes", "multi_page=no", "alphanumeric_cnpj=yes", "cpf_recipient=yes",
    "st_deferral=yes", "mixed_tax_codes=yes", "long_text=yes", "confusable=yes",
    "barcode_readable=yes", "barcode_readable=no", "rendering=text", "rendering=image_clean",
    "rendering=barcode_damaged", "rendering=rotation/mild", "rendering=rotation/severe",
    "rendering=blur/mild", "rendering=blur/severe", "rendering=low_dpi/mild",
    "rendering=low_dpi/severe",
)


def with_slices(cases: DataFrame) -> DataFrame:
    """One row per case and slice it belongs to (``slice_id``), by one exploded array."""
    members = F.array_compact(F.array(*[F.when(hit, name) for name, hit in slice_predicates()]))
    return cases.withColumn("slice_id", F.explode(members))


def manifest_complete(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row ``full``: every manifest case is in the run and every run case has a split."""
    absent = manifest.join(cases.select("case_id"), "case_id", "left_anti")
    gaps = absent.agg(F.count(F.lit(1)).alias("absent"))
    state = cases.agg(_count_if(F.col("split").isNull()).alias("unsplit"))
    return gaps.crossJoin(state).select(
        ((F.col("absent") == 0) & (F.col("unsplit") == 0)).alias("full")
    )


def with_scopes(cases: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """One row per case and scope: overall, its split, and full when the one-row table says so."""
    base = cases if full is None else cases.crossJoin(F.broadcast(full))
    flag = F.lit(False) if full is None else F.col("full")
    known = F.when(F.col("split").isin("test", "dev"), F.col("split"))
    scopes = F.array_compact(F.array(F.lit("overall"), known, F.when(flag, F.lit("full"))))
    exploded = base.withColumn("scope", F.explode(scopes))
    return exploded if full is None else exploded.drop("full")


# --- rates ------------------------------------------------------------------------------------


def _grouped(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def with_rate(df: DataFrame, correct: str, n: str, invoices: str) -> DataFrame:
    """Plus the four-place rate and the Wilson interval over distinct invoices."""
    low, high = wilson_bounds(F.col(correct), F.col(n), F.col(invoices))
    return df.withColumns({"rate": rate4(F.col(correct), F.col(n)), "low": low, "high": high})


def correct_rate(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases with a verdict, distinct invoices among them, excluded, correct, rate and interval."""
    counted = F.col("correct").isNotNull()
    grouped = _grouped(
        cases, by,
        F.count_if(counted).alias("cases"),
        F.count_distinct(F.when(counted, F.col("base_case"))).alias("invoices"),
        _count_if(F.col("status").isin(*EXCLUDED_STATUSES)).alias("excluded"),
        _count_if(F.col("correct")).alias("correct"),
    )
    return with_rate(grouped, "correct", "cases", "invoices")


def status_counts(cases: DataFrame) -> DataFrame:
    """Cases per outcome status, zeros kept."""
    names = F.array(*[F.lit(status) for status in OUTCOME_STATUSES])
    listed = cases.sparkSession.range(1).select(F.explode(names).alias("status"))
    counts = cases.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(listed).join(counts, "status", "left").select(
        "status", F.coalesce("n", F.lit(0)).alias("cases")
    )


def silent_errors(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Successes that were still wrong, split into those touching a payment value and the rest."""
    success = F.col("status") == "success"
    silent = success & (F.col("wrong_count") > 0)
    grouped = _grouped(
        cases, by,
        _count_if(success).alias("success_cases"),
        F.count_distinct(F.when(success, F.col("base_case"))).alias("invoices"),
        _count_if(silent).alias("silent"),
        _count_if(silent & F.col("payment")).alias("payment_cases"),
    )
    rated = with_rate(grouped, "silent", "success_cases", "invoices")
    return rated.withColumn("other_cases", F.col("silent") - F.col("payment_cases"))


def value_label() -> Column:
    """``issuer.cnpj`` for a header value, ``item.total`` for a row value."""
    row = F.concat("scope", F.lit("."), "column")
    return F.when(F.col("scope") == "header", F.col("path")).otherwise(row)


def wrong_on_success(cases: DataFrame, wrong: DataFrame) -> DataFrame:
    """Wrong values per field label over success cases."""
    success = cases.filter(F.col("status") == "success").select("case_id")
    kept = wrong.join(success, "case_id", "left_semi")
    return kept.groupBy(value_label().alias("label")).agg(F.count(F.lit(1)).alias("wrong_values"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Values and cases per failure tag, zeros kept."""
    names = F.array(*[F.lit(tag) for tag in TAG_ORDER])
    listed = tagged.sparkSession.range(1).select(F.explode(names).alias("tag"))
    per_case = tagged.groupBy("tag", "case_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_case.groupBy("tag").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("case_count")
    )
    return F.broadcast(listed).join(counts, "tag", "left").select(
        "tag",
        F.coalesce("n", F.lit(0)).alias("wrong_values"),
        F.coalesce("case_count", F.lit(0)).alias("cases"),
    )


def incomplete_state(
    cases: DataFrame, not_run: DataFrame, run_state: str | None = None,
    stopped_reason: str | None = None,
) -> DataFrame:
    """One row saying whether a run is unfinished, and how."""
    totals = cases.agg(
        _count_if(F.col("status") == "infrastructure_failure").alias("infrastructure_failure"),
        _count_if(F.col("status") == "harness_error").alias("harness_error"),
    ).crossJoin(not_run.agg(F.count(F.lit(1)).alias("cases_not_run")))
    state, reason = F.lit(run_state).cast("string"), F.lit(stopped_reason).cast("string")
    flagged = (
        (F.col("infrastructure_failure") > 0)
        | (F.col("harness_error") > 0)
        | (F.col("cases_not_run") > 0)
        | reason.isNotNull()
        | state.isNotNull()
    )
    return totals.select(
        flagged.alias("incomplete"), "infrastructure_failure", "harness_error", "cases_not_run",
        reason.alias("stopped_reason"), state.alias("run_state"),
    )


def hazard_counts(cases: DataFrame) -> DataFrame:
    """Text-layer cases and correct ones per wrap hazard, with any and none."""
    hazards = F.coalesce("render_hazards", F.array().cast("array<string>"))
    keys = F.concat(
        hazards, F.array(F.when(F.size(hazards) > 0, F.lit("any")).otherwise(F.lit("none")))
    )
    exploded = cases.filter(F.col("rendering") == "text").select(
        "correct", F.explode(keys).alias("hazard")
    )
    return exploded.groupBy("hazard").agg(
        F.count(F.lit(1)).alias("cases"), _count_if(F.col("correct")).alias("correct")
    )


# --- rows -------------------------------------------------------------------------------------


def _columns(kind: str) -> tuple[str, ...]:
    return ITEM_COLUMNS if kind == "item" else INSTALLMENT_COLUMNS


def row_metrics(stats: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Pooled precision, recall, F1, fully right rate and per-column rates of row statistics."""
    counters = ["true_rows", "predicted_rows", "matched", "rows_all_correct"]
    counters += [f"correct_{column}" for column in _columns(kind)]
    grouped = _grouped(stats, by, *[F.sum(name).alias(name) for name in counters])
    c = F.col
    rates = {
        "precision": rate4(c("matched"), c("predicted_rows")),
        "recall": rate4(c("matched"), c("true_rows")),
        "f1": rate4(c("matched") * 2, c("predicted_rows") + c("true_rows")),
        "all_values_correct": rate4(c("rows_all_correct"), c("true_rows")),
    } | {f"rate_{name}": rate4(c(f"correct_{name}"), c("matched")) for name in _columns(kind)}
    return grouped.withColumns(rates)


def column_stats(stats: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """``label, correct, n, rate`` per column, pooled over the row statistics."""
    cells = F.array(
        *[
            F.struct(
                F.lit(f"{kind}.{name}").alias("label"),
                F.col(f"correct_{name}").alias("right"),
                F.col("matched").alias("of"),
            )
            for name in _columns(kind)
        ]
    )
    listed = stats.select(*by, F.inline(cells))
    grouped = listed.groupBy(*by, "label").agg(
        F.sum("right").alias("correct"), F.sum("of").alias("n")
    )
    return grouped.withColumn("rate", rate4(F.col("correct"), F.col("n")))


def order_summary(ordered: DataFrame) -> DataFrame:
    """Cases with at least two matched rows, and those that kept their order."""
    eligible = F.col("matched") >= 2
    return ordered.agg(
        _count_if(eligible & F.col("order_preserved")).alias("cases"),
        _count_if(eligible).alias("n"),
    )


def field_stats(fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per header field the graded cases, invoices, rate and interval (from a ``fields`` struct)."""
    # Every case has every field, so cases and invoices are counted once for all labels.
    known = fields.filter(F.col("fields").isNotNull())
    names = {name: name.replace(".", "__") for name in HEADER_FIELDS}
    counted = known.groupBy(*by).agg(
        *[_count_if(F.col(f"fields.{member}")).alias(f"__{member}") for member in names.values()],
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("base_case").alias("invoices"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("label"), F.col(f"__{member}").alias("correct"))
            for name, member in names.items()
        ]
    )
    grouped = counted.filter(F.col("n") > 0).select(*by, F.inline(cells), "n", "invoices")
    return with_rate(grouped, "correct", "n", "invoices")


# --- bootstrap --------------------------------------------------------------------------------


# A draw is a number below the prime 2**31 - 1: the unit's digest plus a step for each resample,
# squared up (x -> x * (x + k)) once per round. Another engine can follow it in 64-bit integers.
PRIME = 2**31 - 1
RESAMPLE_STEP = 1_164_413_355
ROUNDS = (362_437, 521_288_629, 88_675_123, 613_566_757)
UNIT_DIGITS = 7
#: Units whose draws are held at once: resamples x units numbers of eight bytes.
UNITS_AT_ONCE = 128


def poisson_thresholds(most: int = 12) -> list[int]:
    """The least draws that stand for 1, 2, ... ``most`` times in a resample (Poisson with mean 1)."""
    total = probability = 2.718281828459045**-1
    found = []
    for count in range(1, most + 1):
        found.append(int(total * PRIME))
        probability /= count
        total += probability
    return found


def _reduce(x: np.ndarray, spare: np.ndarray) -> None:
    """``x`` modulo the prime in place, for 0 <= x < 2**62, by folding."""
    for _ in range(2):
        np.right_shift(x, 31, out=spare)
        x &= PRIME
        x += spare
    np.subtract(x, PRIME, out=x, where=x >= PRIME)


#: Resamples whose draws are made together, so that they stay in the processor's cache.
DRAWS_AT_ONCE = 256


def poisson_weights(units: np.ndarray, resamples: int) -> np.ndarray:
    """How often each unit stands in each resample: (resamples, units)."""
    weights = np.empty((resamples, units.size))
    thresholds = np.array(poisson_thresholds())
    often, seldom = thresholds[:4], thresholds[4:]
    for first in range(0, resamples, DRAWS_AT_ONCE):
        steps = np.arange(first, min(first + DRAWS_AT_ONCE, resamples), dtype=np.int64)[:, None]
        steps = steps * RESAMPLE_STEP
        spare = np.empty_like(steps)
        _reduce(steps, spare)
        draws = steps + units[None, :]
        spare, added = np.empty_like(draws), np.empty_like(draws)
        _reduce(draws, spare)
        for constant in ROUNDS:
            np.add(draws, constant, out=added)
            draws *= added
            _reduce(draws, spare)
        own = weights[first : first + DRAWS_AT_ONCE]
        np.greater_equal(draws, often[0], out=own)
        for threshold in often[1:]:
            own += draws >= threshold
        rows, columns = np.nonzero(draws >= seldom[0])
        own[rows, columns] += np.searchsorted(seldom, draws[rows, columns], side="right")
    return weights


def bootstrap_sums(
    vectors: DataFrame, counters: Sequence[str], resamples: int, *, by: Sequence[str] = (),
    seed: str = BOOTSTRAP_SEED, unit: str = "base_case",
) -> DataFrame:
    """Counter sums of resamples of the invoices: ``by, resample`` and the sums.

    Each invoice enters a resample with a Poisson(1) count drawn from (seed, resample, invoice), the
    same in every group of ``by``. Every partition multiplies its matrix of draws with its counters,
    a bounded number of units at a time, and gives one sum for each group and resample; only those
    are shuffled, pre-aggregated. Units come in order, so the draws of one are made once. The groups of ``by`` must be few: their sums are held in a task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string")))
    start = F.conv(F.substring(digest, 1, UNIT_DIGITS), 16, 10).cast("bigint")
    rows = vectors.select(
        start.alias("__unit"),
        *[F.col(name).cast("string").alias(f"__by_{i}") for i, name in enumerate(by)],
        *[F.col(name).cast("bigint").alias(name) for name in counters],
    )
    names, width = list(counters), len(by)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            units, place = np.unique(np.asarray(batch.column(0)), return_inverse=True)
            groups = list(zip(*(batch.column(1 + i).to_pylist() for i in range(width)), strict=True))
            groups = groups or [()] * batch.num_rows
            kinds = {group: k for k, group in enumerate(dict.fromkeys(groups))}
            kind = np.array([kinds[group] for group in groups], np.int64)
            values = np.stack(
                [np.asarray(batch.column(1 + width + i).fill_null(0)) for i in range(len(names))], 1
            ).astype(float)
            # Each unit's counters of all groups side by side, so that one product serves them all.
            dense = np.zeros((units.size, len(kinds), len(names)))
            np.add.at(dense, (place, kind), values)
            dense = dense.reshape(units.size, -1)
            total = np.zeros((resamples, dense.shape[1]))
            for first in range(0, units.size, UNITS_AT_ONCE):
                weights = poisson_weights(units[first : first + UNITS_AT_ONCE], resamples)
                total += weights @ dense[first : first + UNITS_AT_ONCE]
            counted = total.round().astype(np.int64).reshape(resamples, len(kinds), len(names))
            for group, k in kinds.items():
                own = sums.setdefault(group, np.zeros((resamples, len(names)), np.int64))
                own += counted[:, k]
        for group, own in sums.items():
            listed = [pa.array([value] * resamples, pa.string()) for value in group]
            columns = [pa.array(np.ascontiguousarray(own[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*listed, pa.array(np.arange(resamples)), *columns],
                [*[f"__by_{i}" for i in range(width)], "resample", *names],
            )

    schema = "".join(f"__by_{i} string, " for i in range(width)) + "resample bigint"
    schema += "".join(f", `{name}` bigint" for name in names)
    kinds_of = dict(vectors.dtypes)
    keys = [F.col(f"__by_{i}").cast(kinds_of[name]).alias(name) for i, name in enumerate(by)]
    # A unit's rows come together, so its draws are made once.
    partial = rows.repartition("__unit").sortWithinPartitions("__unit").mapInArrow(summed, schema)
    return partial.groupBy(*keys, "resample").agg(*[F.sum(name).alias(name) for name in names])


def bootstrap_interval(
    sums: DataFrame, ratios: dict[str, tuple[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """Nearest-rank 2.5 and 97.5 percentiles of each ratio; zero denominators are skipped."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("label"),
                F.col(top).cast("bigint").alias("numerator"),
                F.col(bottom).cast("bigint").alias("denominator"),
            )
            for name, (top, bottom) in ratios.items()
        ]
    )
    listed = sums.select(*by, F.inline(cells)).filter(F.col("denominator") != 0)
    valued = listed.withColumn("value", rate4(F.col("numerator"), F.col("denominator")))
    low = F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY value)")
    high = F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY value)")
    return valued.groupBy(*by, "label").agg(
        low.alias("low"), high.alias("high"), F.count(F.lit(1)).alias("resamples")
    )


def invoice_vectors(stats: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Row statistics summed per invoice (``base_case``), with the counters of the ratios."""
    counters = ["true_rows", "predicted_rows", "matched", "rows_all_correct"]
    counters += [f"correct_{name}" for name in _columns(kind)]
    summed = stats.groupBy(*by, "base_case").agg(*[F.sum(name).alias(name) for name in counters])
    return summed.withColumns(
        {
            "matched_twice": F.col("matched") * 2,
            "both_rows": F.col("predicted_rows") + F.col("true_rows"),
        }
    )


def row_ratios(kind: str) -> dict[str, tuple[str, str]]:
    return {
        "precision": ("matched", "predicted_rows"),
        "recall": ("matched", "true_rows"),
        "f1": ("matched_twice", "both_rows"),
        "all_values_correct": ("rows_all_correct", "true_rows"),
    } | {f"{kind}.{name}": (f"correct_{name}", "matched") for name in _columns(kind)}


# --- headline and slices ----------------------------------------------------------------------


def headline(cases: DataFrame) -> DataFrame:
    """Correct rate of text, image and pooled cases per scope; no rendering counts in pooled only."""
    layer = F.when(F.col("rendering") == "text", F.lit("text")).when(
        F.col("rendering").isNotNull(), F.lit("image")
    )
    layers = F.array_compact(F.array(F.lit("pooled"), layer))
    return correct_rate(cases.withColumn("layer", F.explode(layers)), ("scope", "layer"))


def slice_rates(cases: DataFrame) -> DataFrame:
    """Correct rate of every declared slice per scope, empty slices kept with zeros."""
    found = correct_rate(with_slices(cases), ("scope", "slice_id"))
    names = F.array(*[F.lit(name) for name in SLICE_IDS])
    grid = cases.select("scope").distinct().withColumn("slice_id", F.explode(names))
    joined = grid.join(found, ["scope", "slice_id"], "left")
    zeros = {
        name: F.coalesce(name, F.lit(0)) for name in ("cases", "invoices", "excluded", "correct")
    }
    return joined.withColumns(zeros)


# --- totals -----------------------------------------------------------------------------------


def value_ranks(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, each value of ``column``, its count ``n``, the smaller values' ``before`` and ``all``.

    Rows become counts of values first. Values are then summed in two levels, by the range of 1024
    they fall in and inside it, so no task holds all values of a group.
    """
    group = F.struct(*by) if by else F.lit(0)
    counts = df.filter(F.col(column).isNotNull()).groupBy(
        group.alias("group"), F.col(column).alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("chunk", F.floor(F.col("value") / 1024).cast("long"))
    placed = running_before(counts, ["group"], "chunk", ["value"], sums={"before": "n"})
    totals = counts.groupBy(F.col("group").alias("__group")).agg(F.sum("n").alias("all"))
    joined = placed.join(totals, F.col("group").eqNullSafe(F.col("__group")))
    return joined.select(
        *[F.col(f"group.{name}").alias(name) for name in by],
        "value", "n", F.coalesce("before", F.lit(0)).alias("before"), "all",
    )


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group from both sides; groups may have null names."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    named = right.select(*[F.col(n).alias(f"__{n}") for n in by],
                         *[n for n in right.columns if n not in by])
    same = F.lit(True)
    for name in by:
        same = same & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return left.join(named, same, "left").drop(*[f"__{name}" for name in by])


def latency_summary(cases: DataFrame, column: str = "latency_ms", by: Sequence[str] = ()) -> DataFrame:
    """Least, nearest-rank median and 95th, greatest and count of an integer column."""
    whole = _grouped(
        cases, by,
        F.min(column).alias("least"), F.max(column).alias("greatest"), F.count(column).alias("n"),
    )

    def rank(percent: int) -> Column:
        reached = (F.col("before") + F.col("n")) * 100 >= F.col("all") * percent
        return F.min(F.when(reached, F.col("value"))).cast("bigint")

    ranks = _grouped(value_ranks(cases, column, by), by, rank(50).alias("p50"), rank(95).alias("p95"))
    return _beside(whole, ranks, by).select(*by, "least", "p50", "p95", "greatest", "n")


def median_spread(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Least, interpolated median and greatest value of a numeric column."""
    whole = _grouped(df, by, F.min(column).alias("least"), F.max(column).alias("greatest"))

    def at(place: Column) -> Column:
        inside = (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col("value").cast("double")))

    low, high = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    middle = _grouped(value_ranks(df, column, by), by, ((at(low) + at(high)) / 2).alias("median"))
    return _beside(whole, middle, by).select(*by, "least", "median", "greatest")


TOKEN_FIELDS = (
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens",
    "cache_write_1h_tokens",
)


def usage_totals(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Token sums, notional and incurred cost, and how many cases have neither price."""
    answered = F.col("status") != "harness_error"
    cost, paid = F.col("cost_usd"), F.col("incurred_cost_usd")
    zero = F.lit(0).cast("decimal(38,8)")
    return _grouped(
        cases, by,
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in TOKEN_FIELDS],
        F.coalesce(F.sum(F.when(answered, cost)), zero).alias("cost_usd"),
        F.coalesce(F.sum(F.when(answered, paid)), zero).alias("incurred_cost_usd"),
        _count_if(answered & cost.isNull()).alias("unpriced_cases"),
        _count_if(answered & paid.isNull()).alias("unpriced_incurred_cases"),
    )


def cache_hit_rate(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Answered attempts, hits and their rate; the rate is null without an answer, not 0."""
    grouped = _grouped(
        cases, by,
        F.coalesce(F.sum("cache_hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("answered_attempts"), F.lit(0)).alias("answered_attempts"),
    )
    return grouped.withColumn("hit_rate", rate4(F.col("hits"), F.col("answered_attempts")))


def within_cent_counts(cases: DataFrame) -> DataFrame:
    """Wrong values off by a cent or less, and cases wrong by nothing else."""
    only = (F.col("wrong_count") > 0) & (F.col("cent_count") == F.col("wrong_count"))
    return cases.agg(
        F.coalesce(F.sum("cent_count"), F.lit(0)).alias("cent_values"),
        _count_if(only).alias("cent_cases"),
    )


def rule_counts(cases: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Caught and warned cases (one row), and the cases per rule id of their findings."""
    warned = findings.filter(F.col("severity") == "warning").select("case_id").distinct()
    caught = cases.agg(_count_if(F.col("status") == "validation_failed").alias("caught"))
    header = caught.crossJoin(warned.agg(F.count(F.lit(1)).alias("with_warnings")))
    per_rule = (
        findings.groupBy("rule_id", "case_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("cases"))
    )
    return header, per_rule


def attempt_totals(cases: DataFrame) -> DataFrame:
    """Attempts in total, successes that needed more than one, and the greatest count."""
    repaired = (F.col("status") == "success") & (F.col("attempt_count") > 1)
    return cases.agg(
        F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("total"),
        _count_if(repaired).alias("repaired"),
        F.max("attempt_count").alias("most"),
    )


def config_values(cases: DataFrame, settings: Sequence[str]) -> DataFrame:
    """The sorted distinct values of each setting, one row per setting."""
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("setting"), F.col(name).cast("string").alias("value"))
            for name in settings
        ]
    )
    listed = cases.select(F.inline(cells)).filter(F.col("value").isNotNull()).distinct()
    return listed.groupBy("setting").agg(F.array_sort(F.collect_list("value")).alias("found"))


def schema_validity(cases: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Graded cases and valid ones per schema check."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"), F.coalesce(F.col(name), F.lit(False)).alias("valid")
            )
            for name in checks
        ]
    )
    graded = cases.filter(F.col("status").isin(*GRADED_STATUSES)).select(F.inline(cells))
    return graded.groupBy("check").agg(
        F.count_if("valid").alias("correct"), F.count(F.lit(1)).alias("n")
    )


def run_summary(cases: DataFrame) -> DataFrame:
    """The one-row summary of a graded run: counts, rate, silent errors and cent errors."""
    one = correct_rate(cases).select(
        *[F.col(name).alias(f"correct_{name}") for name in
          ("cases", "invoices", "excluded", "correct", "rate", "low", "high")]
    )
    silent = silent_errors(cases).select(
        *[F.col(name).alias(f"silent_{name}") for name in
          ("success_cases", "silent", "rate", "payment_cases", "other_cases")]
    )
    statuses = cases.agg(
        *[_count_if(F.col("status") == status).alias(f"n_{status}") for status in OUTCOME_STATUSES],
        F.count(F.lit(1)).alias("total"),
    )
    return one.crossJoin(silent).crossJoin(within_cent_counts(cases)).crossJoin(statuses)
