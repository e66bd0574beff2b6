"""Comparison of two graded runs: refusal checks, flips, classes and an exact paired test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenota.operators.grading import GRADED_STATUSES

REFUSALS = ("manifest_sha256", "grader_version", "tolerance")


class CompareRefusal(ValueError):
    """The two runs cannot be compared."""


def comparable_problems(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per header value in which two one-row run headers differ."""
    names = [name for name in REFUSALS if name in first.columns]
    left = first.select(*[F.col(name).cast("string").alias(f"a_{name}") for name in names])
    right = second.select(*[F.col(name).cast("string").alias(f"b_{name}") for name in names])
    cells = []
    for name in names:
        a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
        if name == "tolerance":
            same = a.try_cast("decimal(38,10)").eqNullSafe(b.try_cast("decimal(38,10)"))
        else:
            same = a.eqNullSafe(b) & a.isNotNull()
        cells.append(
            F.when(~same, F.struct(F.lit(name).alias("what"), a.alias("first"), b.alias("second")))
        )
    return left.crossJoin(right).select(F.inline(F.array_compact(F.array(*cells))))


def duplicate_cases(cases: DataFrame) -> DataFrame:
    """Case ids that appear more than once in a run."""
    counts = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > 1).select("case_id", "n")


def check_comparable(
    first: DataFrame, second: DataFrame, first_cases: DataFrame, second_cases: DataFrame
) -> None:
    """Raise ``CompareRefusal`` unless both runs were graded the same way."""
    problems = comparable_problems(first, second).take(len(REFUSALS))
    if problems:
        shown = "; ".join(f"{row.what} differs: {row.first} and {row.second}" for row in problems)
        raise CompareRefusal(shown)
    for name, cases in (("first", first_cases), ("second", second_cases)):
        twice = duplicate_cases(cases).take(1)
        if twice:
            raise CompareRefusal(f"case id {twice[0].case_id} appears twice in the {name} run")


def _first_per_path(wrong: DataFrame) -> DataFrame:
    order = [name for name in ("ordinal", "row", "predicted_row") if name in wrong.columns]
    place = F.struct(*order) if order else F.lit(0)
    return wrong.groupBy("case_id", "path").agg(F.min_by("tag", place).alias("tag"))


def flips(first_wrong: DataFrame, second_wrong: DataFrame) -> DataFrame:
    """The paths wrong in exactly one run, with that run's tag and the direction."""
    before = _first_per_path(first_wrong).withColumnRenamed("tag", "before_tag")
    after = _first_per_path(second_wrong).withColumnRenamed("tag", "after_tag")
    joined = before.withColumn("before", F.lit(True)).join(
        after.withColumn("after", F.lit(True)), ["case_id", "path"], "full_outer"
    )
    only_after, only_before = F.col("before").isNull(), F.col("after").isNull()
    change = F.when(only_after, "became_wrong").when(only_before, "became_right")
    return joined.filter(only_after | only_before).select(
        "case_id", "path", F.coalesce("after_tag", "before_tag").alias("tag"), change.alias("change")
    )


def pair_cases(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both runs side by side: presence flags, statuses, verdicts and wrong counts."""
    kept = ("status", "correct", "wrong_count")

    def side(cases: DataFrame, name: str) -> DataFrame:
        return cases.select(
            "case_id",
            F.lit(True).alias(f"in_{name}"),
            *[F.col(column).alias(f"{name}_{column}") for column in kept],
        )

    joined = side(first, "first").join(side(second, "second"), "case_id", "full_outer")
    return joined.withColumns(
        {name: F.coalesce(name, F.lit(False)) for name in ("in_first", "in_second")}
    )


def classify(paired: DataFrame) -> DataFrame:
    """Plus ``change``: how a case moved between the runs (null when it did not)."""
    c = F.col
    shared = c("in_first") & c("in_second")
    unknown = c("first_correct").isNull() | c("second_correct").isNull()
    both_wrong = ~c("first_correct") & ~c("second_correct")
    both_graded = c("first_status").isin(*GRADED_STATUSES) & c("second_status").isin(
        *GRADED_STATUSES
    )
    change = (
        F.when(~c("in_second"), "only_first")
        .when(~c("in_first"), "only_second")
        .when(shared & unknown, "not_comparable")
        .when(c("first_correct") & ~c("second_correct"), "regressed")
        .when(~c("first_correct") & c("second_correct"), "improved")
        .when(
            both_wrong & both_graded & (c("second_wrong_count") > c("first_wrong_count")),
            "worsened",
        )
        .when(
            both_wrong & both_graded & (c("second_wrong_count") < c("first_wrong_count")),
            "improved",
        )
        .when(
            both_wrong & ~both_graded & (c("first_status") != c("second_status")),
            "status_changed",
        )
    )
    return paired.withColumn("change", change)


def _stirling_error(n: Column) -> Column:
    """log n! less Stirling's formula: exact for small n, by its series (to 1e-16) beyond."""
    x = F.greatest(n, F.lit(1)).cast("double")
    formula = F.log(x * 6.283185307179586) / 2 + x * F.log(x) - x
    exact = F.log(F.factorial(F.least(n, F.lit(20)).cast("int"))) - formula
    square = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - F.lit(1 / 1680) / square) / square) / square) / x
    return F.when(n <= 20, exact).otherwise(series)


def _two_sided(least: Column, n: Column) -> Column:
    """Twice the chance of at most ``least`` heads in ``n`` tosses of a fair coin, at most 1.

    The chance of exactly ``least`` by its deviance from one half, times the sum of the smaller
    terms relative to it. That sum is over in a few square roots of n, so neither the count of terms
    nor the loss of digits grows with n.
    """
    few, many, all_ = (c.cast("double") for c in (least, n - least, n))
    lean = (many - few) / all_
    deviance = few * F.log1p(-lean) + many * F.log1p(lean)
    errors = _stirling_error(n) - _stirling_error(least) - _stirling_error(n - least)
    spread = F.log(all_ / (few * many * 6.283185307179586)) / 2
    log_chance = F.when(least == 0, -all_ * 0.6931471805599453).otherwise(
        errors - deviance + spread
    )
    terms = F.least(least, F.ceil(F.sqrt(all_) * 12) + 30)
    start = F.struct(F.lit(1.0).alias("ratio"), F.lit(1.0).alias("total"))

    def step(state: Column, i: Column) -> Column:
        ratio = state["ratio"] * (few - i + 1) / (many + i)
        return F.struct(ratio.alias("ratio"), (state["total"] + ratio).alias("total"))

    places = F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1)).cast("long"))
    total = F.when(least == 0, F.lit(1.0)).otherwise(F.aggregate(places, start, step)["total"])
    return F.least(F.lit(1.0), F.exp(log_chance) * total * 2)


def mcnemar(counts: DataFrame, b: str = "b", c: str = "c") -> DataFrame:
    """Plus ``p_value`` and ``significant`` (p < 0.05) of the exact two-sided paired test.

    One formula for every number of discordant cases, good to about 1e-13; ``near_alpha`` says when
    the value lies within 1e-12 of 0.05, which no pair of counts up to some hundreds does.
    """
    small, n = F.least(b, c).cast("long"), (F.col(b) + F.col(c)).cast("long")
    p = F.when(n == 0, F.lit(1.0)).otherwise(_two_sided(small, F.greatest(n, F.lit(1))))
    near = F.abs(F.col("p_value") - 0.05) < 1e-12
    tested = counts.withColumn("p_value", p)
    return tested.withColumns({"significant": F.col("p_value") < 0.05, "near_alpha": near})


def paired_verdict(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Discordant counts, p-value and verdict over ``first_correct`` / ``second_correct`` rows."""
    first, second = F.col("first_correct"), F.col("second_correct")
    grouped = pairs.groupBy(*by) if by else pairs.groupBy()
    counts = grouped.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(first & ~second).alias("b"),
        F.count_if(second & ~first).alias("c"),
    )
    tested = mcnemar(counts)
    verdict = (
        F.when(F.col("cases") == 0, "inconclusive")
        .when(F.col("b") + F.col("c") == 0, "no change")
        .when(F.col("significant"), "significant")
        .otherwise("inconclusive")
    )
    return tested.withColumn("verdict", verdict)


def run_verdict(paired: DataFrame, metadata: DataFrame) -> DataFrame:
    """The verdict over the text cases of split test, or of all splits when test has none."""
    comparable = paired.filter(
        F.col("first_correct").isNotNull() & F.col("second_correct").isNotNull()
    )
    text = comparable.join(metadata.select("case_id", "split", "rendering"), "case_id").filter(
        F.col("rendering") == "text"
    )
    in_test = F.col("split") == "test"
    first, second = F.col("first_correct"), F.col("second_correct")
    lost, won = first & ~second, second & ~first
    sums = text.agg(
        F.count_if(in_test).alias("test_cases"),
        F.count(F.lit(1)).alias("all_cases"),
        F.count_if(in_test & lost).alias("test_b"),
        F.count_if(lost).alias("all_b"),
        F.count_if(in_test & won).alias("test_c"),
        F.count_if(won).alias("all_c"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("split", F.lit("None")))), ",").alias(
            "splits"
        ),
    )
    use_test = F.col("test_cases") > 0
    chosen = sums.select(
        F.when(use_test, "test text")
        .when(F.col("all_cases") > 0, F.concat("splits", F.lit(" text")))
        .alias("label"),
        *[
            F.when(use_test, F.col(f"test_{name}")).otherwise(F.col(f"all_{name}")).alias(name)
            for name in ("cases", "b", "c")
        ],
    )
    tested = mcnemar(chosen)
    verdict = (
        F.when(F.col("cases") == 0, "inconclusive")
        .when(F.col("b") + F.col("c") == 0, "no change")
        .when(F.col("significant"), "significant")
        .otherwise("inconclusive")
    )
    return tested.withColumn("verdict", verdict)


def config_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Settings (``setting, found``) whose value lists differ between two runs."""
    empty = F.array().cast("array<string>")
    joined = first.withColumnRenamed("found", "before").join(
        second.withColumnRenamed("found", "after"), "setting", "full_outer"
    )
    before, after = F.coalesce("before", empty), F.coalesce("after", empty)
    return joined.filter(before != after).select(
        "setting", before.alias("first"), after.alias("second")
    )


def field_deltas(first: DataFrame, second: DataFrame) -> DataFrame:
    """``label, correct, n`` tables of two runs side by side with the change in correct."""
    left = first.select("label", F.col("correct").alias("first_correct"), F.col("n").alias("first_n"))
    right = second.select(
        "label", F.col("correct").alias("second_correct"), F.col("n").alias("second_n")
    )
    joined = left.join(right, "label", "full_outer")
    names = ("first_correct", "first_n", "second_correct", "second_n")
    filled = joined.withColumns({name: F.coalesce(name, F.lit(0)) for name in names})
    return filled.withColumn("delta", F.col("second_correct") - F.col("first_correct"))


def run_state(state: DataFrame) -> DataFrame:
    """The completeness text of a run-state row; it never changes a verdict."""
    stopped = F.when(
        F.col("stopped_reason").isNotNull(), F.concat(F.lit(", stopped: "), "stopped_reason")
    ).otherwise(F.lit(""))
    text = (
        F.when(F.col("incomplete").isNull(), "completeness not recorded")
        .when(~F.col("incomplete"), "complete")
        .otherwise(F.concat(F.lit("incomplete"), stopped))
    )
    return state.withColumn("state_text", text)
