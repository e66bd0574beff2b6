"""Approve / reject / escalate decisions: labels, guard, terminal states and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenota.operators.measure import TOKEN_FIELDS, median_spread

LABELLING_VERSION = "decision-labels-1"
# Outcomes, and the causes a model may give for an escalation.
OUTCOMES = ("approve", "reject", "escalate")
MODEL_CAUSES = ("extraction_not_success", "policy_warning", "over_limit")
CAUSES = ("none", *MODEL_CAUSES, "tool_failed", "step_budget_exhausted")
CALLED = ("ok", "error")


def label(cases: DataFrame, policy: DataFrame) -> DataFrame:
    """Cases with the decision, cause and rule of the first policy rule that applies.

    ``cases`` has ``extraction_status, tax_id, has_warning, invoice_total``; ``policy`` is one row,
    any other number of rows is an error.
    """
    one = policy.agg(
        F.count(F.lit(1)).alias("rows"), F.first("buyer_cnpj").alias("buyer"),
        F.first("approval_limit").alias("approval_limit"),
    )
    refuse = F.raise_error(F.lit("a policy has exactly one row"))
    buyer = F.when(F.col("rows") == 1, F.col("buyer")).otherwise(refuse)
    one = one.select(buyer.alias("buyer_cnpj"), "approval_limit")
    joined = cases.crossJoin(F.broadcast(one))
    rule = (
        F.when(~F.col("extraction_status").eqNullSafe("success"), 1)
        .when(~F.col("tax_id").eqNullSafe(F.col("buyer_cnpj")), 2)
        .when(F.col("has_warning"), 3)
        .when(F.col("invoice_total") > F.col("approval_limit"), 4)
        .otherwise(5)
    )
    labelled = joined.withColumn("rule", rule).drop("buyer_cnpj", "approval_limit")
    number = F.col("rule")
    return labelled.withColumns(
        {
            "decision": F.when(number == 2, "reject")
            .when(number == 5, "approve")
            .otherwise("escalate"),
            "cause": F.when(number == 1, "extraction_not_success")
            .when(number == 3, "policy_warning")
            .when(number == 4, "over_limit")
            .otherwise("none"),
        }
    )


def allowed_pair(outcome: Column, cause: Column) -> Column:
    """Whether a model may give this outcome with this cause."""
    plain = outcome.isin("approve", "reject") & (cause == "none")
    return F.coalesce(plain | ((outcome == "escalate") & cause.isin(*MODEL_CAUSES)), F.lit(False))


def apply_guard(decided: DataFrame) -> DataFrame:
    """The final decision next to the model's own, from the guard's extraction status."""
    success = F.col("guard_status").eqNullSafe("success")
    outcome = F.col("model_decision")
    return decided.withColumns(
        {
            "decision": F.when(success, outcome).otherwise("escalate"),
            "cause": F.when(success, F.col("model_cause")).otherwise("extraction_not_success"),
            "decided_by": F.when(success, "model").otherwise("guard"),
            "guard_overridden": ~success & outcome.isin("approve", "reject"),
        }
    )


def terminal_state(steps: DataFrame, max_steps: int) -> DataFrame:
    """Status, cause and decider of a case from its last step, as one pre-aggregated grouping.

    ``steps`` has ``case_id, step, failure_kind, stop_reason, calls, tool_failed, parsed``; a case
    whose last step only asked for tools, with budget left, is unfinished (null status).
    """
    read = ("failure_kind", "stop_reason", "calls", "tool_failed", "parsed")
    last = steps.groupBy("case_id").agg(
        F.max("step").alias("last_step"), F.max_by(F.struct(*read), "step").alias("s")
    )
    s, tool_use = F.col("s"), F.col("s.stop_reason") == "tool_use"
    spent = F.col("last_step") >= max_steps - 1
    status = (
        F.when(s["failure_kind"].isNotNull(), "infrastructure_failure")
        .when(tool_use & (s["calls"] == 0), "schema_invalid")
        .when(tool_use & (spent | s["tool_failed"]), "decided")
        .when(tool_use, F.lit(None))
        .when(s["stop_reason"] == "refusal", "refused")
        .when(s["stop_reason"] != "end_turn", "truncated")
        .when(s["parsed"], "decided")
        .otherwise("schema_invalid")
    )
    decided = F.col("status") == "decided"
    by = F.when(
        decided, F.when(tool_use & spent, "step_budget").when(tool_use, "tool_failure")
        .otherwise("model")
    )
    cause = F.when(F.col("decided_by") == "step_budget", "step_budget_exhausted").when(
        F.col("decided_by") == "tool_failure", "tool_failed"
    )
    return (
        last.withColumn("status", status)
        .withColumn("decided_by", by)
        .withColumn("code_cause", cause)
        .select("case_id", "last_step", "status", "decided_by", "code_cause")
    )


def unlabelled(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Records without a label; grading refuses a run that has any."""
    return records.select("case_id").join(labels.select("case_id"), "case_id", "left_anti")


def grade_decisions(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Records against their labels: decision, cause and the model's own decision.

    A decided case without a final decision is wrong. A cause counts only where the label
    escalates; undecided cases have no grades. A record without a label is an error.
    """
    expected = labels.select(
        "case_id",
        F.col("decision").alias("expected_decision"),
        F.col("cause").alias("expected_cause"),
        F.lit(True).alias("labelled"),
    )
    joined = records.join(expected, "case_id", "left")
    refuse = F.raise_error(F.concat(F.lit("no label for case "), F.col("case_id").cast("string")))
    joined = joined.withColumn(
        "status", F.when(F.col("labelled"), F.col("status")).otherwise(refuse)
    ).drop("labelled")
    decided = F.col("status") == "decided"
    has = F.col("decision").isNotNull()
    return joined.withColumns(
        {
            "decision_correct": F.when(
                decided, has & F.coalesce(F.col("decision") == F.col("expected_decision"), F.lit(False))
            ),
            "cause_correct": F.when(
                decided & has & (F.col("expected_decision") == "escalate"),
                F.coalesce(F.col("cause") == F.col("expected_cause"), F.lit(False)),
            ),
            "model_decision_correct": F.when(
                decided & has & F.col("model_decision").isNotNull(),
                F.col("model_decision") == F.col("expected_decision"),
            ),
        }
    )


def citations(evidence: DataFrame, calls: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per decided case: evidence count, whether every cited source was called, and uncited.

    ``evidence`` has ``case_id, source``; ``calls`` has ``case_id, name, source, outcome``.
    """
    called = (
        calls.filter((F.col("source") == "model") & F.col("outcome").isin(*CALLED))
        .select("case_id", F.col("name").alias("source"))
        .distinct()
        .withColumn("called", F.lit(True))
    )
    counted = evidence.groupBy("case_id", "source").agg(F.count(F.lit(1)).alias("n"))
    checked = counted.join(called, ["case_id", "source"], "left")
    per_case = checked.groupBy("case_id").agg(
        F.sum("n").alias("evidence_count"),
        F.bool_and(F.col("called").isNotNull()).alias("all_called"),
    )
    joined = decisions.select("case_id", "model_decision").join(per_case, "case_id", "left")
    count = F.coalesce("evidence_count", F.lit(0))
    bare = (count == 0) & F.col("model_decision").isin("approve", "reject")
    return joined.select(
        "case_id",
        count.alias("evidence_count"),
        (F.coalesce("all_called", F.lit(True)) & ~bare).alias("citations_valid"),
        (count == 0).alias("uncited"),
    )


def step_counts(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Per case the steps, answered steps, cache hits, tokens, model and guard calls."""
    answered = F.col("answered")
    per_step = steps.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(answered).alias("answered_steps"),
        F.count_if(answered & F.col("cache_status").eqNullSafe("hit")).alias("cache_hits"),
        *[
            F.coalesce(F.sum(F.when(answered, F.col(name))), F.lit(0)).alias(name)
            for name in TOKEN_FIELDS
            if name in steps.columns
        ],
    )
    per_call = calls.groupBy("case_id").agg(
        F.count_if(F.col("source") == "model").alias("model_tool_calls"),
        F.count_if(F.col("source") == "guard").alias("guard_tool_calls"),
    )
    names = ("model_tool_calls", "guard_tool_calls")
    return per_step.join(per_call, "case_id", "left").withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in names}
    )


def plain_rate(correct: Column, n: Column) -> Column:
    """The unrounded rate of decision summaries; null without a case."""
    return F.when(n != 0, correct.cast("double") / n.cast("double"))


def decision_accuracy(graded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``measure, n, correct, rate`` of the decision, cause and model-decision verdicts."""
    names = {
        "accuracy": "decision_correct",
        "cause_accuracy": "cause_correct",
        "model_accuracy": "model_decision_correct",
    }
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), F.col(column).alias("right"))
            for name, column in names.items()
        ]
    )
    listed = graded.select(*by, F.inline(cells))
    grouped = listed.groupBy(*by, "measure").agg(
        F.count("right").alias("n"), F.count_if(F.coalesce("right", F.lit(False))).alias("correct")
    )
    return grouped.withColumn("rate", plain_rate(F.col("correct"), F.col("n")))


def escalation_pr(graded: DataFrame) -> DataFrame:
    """Precision and recall of escalate over the cases with a decision verdict."""
    judged = F.col("decision_correct").isNotNull()
    said = judged & F.col("decision").eqNullSafe("escalate")
    meant = judged & (F.col("expected_decision") == "escalate")
    sums = graded.agg(
        F.count_if(said & meant).alias("hits"),
        F.count_if(said).alias("said"),
        F.count_if(meant).alias("meant"),
    )
    return sums.select(
        plain_rate(F.col("hits"), F.col("said")).alias("precision"),
        plain_rate(F.col("hits"), F.col("meant")).alias("recall"),
    )


def spread(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Least, interpolated median and greatest value of a column."""
    return median_spread(df, column, by)


def decision_totals(cases: DataFrame) -> DataFrame:
    """Token sums and costs of a decision run; a cost is null when any answer's is unknown."""
    responded = F.col("status") != "harness_error"

    def unknown(name: str) -> Column:
        return F.count_if(responded & F.col(name).isNull())

    def total(name: str) -> Column:
        return F.when(unknown(name) == 0, F.sum(F.when(responded, F.col(name))))

    return cases.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in TOKEN_FIELDS],
        total("cost_usd").alias("cost_usd"),
        total("incurred_cost_usd").alias("incurred_cost_usd"),
        unknown("cost_usd").alias("unpriced_cases"),
        unknown("incurred_cost_usd").alias("unpriced_incurred_cases"),
    )


def decision_valid(decision: Column) -> Column:
    """The strict shape of a decision struct: known outcome and cause, a reason, whole evidence."""
    whole = F.forall(
        decision["evidence"],
        lambda item: item["source"].isNotNull() & item["ref"].isNotNull() & item["value"].isNotNull(),
    )
    return F.coalesce(
        decision["outcome"].isin(*OUTCOMES)
        & decision["cause"].isin(*CAUSES)
        & decision["reason"].isNotNull()
        & whole,
        F.lit(False),
    )


def decision_summary(graded: DataFrame) -> DataFrame:
    """The one-row summary: the three accuracies, escalation scores and guard counts."""
    wide = decision_accuracy(graded)
    names = ("accuracy", "cause_accuracy", "model_accuracy")
    accuracies = wide.agg(
        *[
            F.max(F.when(F.col("measure") == name, F.col(part))).alias(f"{name}_{part}")
            for name in names
            for part in ("n", "correct", "rate")
        ]
    )
    guard = graded.agg(
        F.count("guard_overridden").alias("guard_checked"),
        F.count_if(F.coalesce("guard_overridden", F.lit(False))).alias("guard_overridden"),
        F.count(F.lit(1)).alias("total"),
    )
    return accuracies.crossJoin(escalation_pr(graded)).crossJoin(guard)
