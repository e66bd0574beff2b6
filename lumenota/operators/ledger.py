"""The ledger of model calls: price, replay, roll-up, budget gate and resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenota.functions.identifiers import valid_salt
from lumenota.functions.invoice import canonical_sha256
from lumenota.functions.numbers import dec
from lumenota.operators.measure import TOKEN_FIELDS
from lumenota.operators.ordering import latest_per_key, one_per_key, running_before

COST = "decimal(18,8)"
# The rate column of each token counter, and the wire names of the cache modes.
TOKEN_RATES = {
    "input_tokens": "input",
    "output_tokens": "output",
    "cache_read_tokens": "cache_read",
    "cache_write_5m_tokens": "cache_write_5m",
    "cache_write_1h_tokens": "cache_write_1h",
}
CACHE_MODES = ("off", "read_write", "read_only", "refresh")
COMPLETE_STOPS = ("end_turn", "tool_use")
MAX_REPAIRS_LIMIT = 5
# Responses and client errors after which no provider call can have been made.
NO_PROVIDER_CALL_STATUSES = (400, 401, 404, 413, 415)
UNSENT_ERROR_TYPES = ("ConnectError", "ConnectTimeout", "PoolTimeout")

# Running totals are scanned in chunks of this many cases.
ADMIT_CHUNK = 4096


class RunConfigMismatch(ValueError):
    """The records of a run were requested with different overrides."""


# --- price ------------------------------------------------------------------------------------


def price_table(prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """One rate row per model name, aliases included; a direct price wins over an alias.

    A model with two different prices, or an alias of two models, is refused.
    """
    rates = list(dict.fromkeys(TOKEN_RATES.values()))
    direct = one_per_key(prices.select("model", *rates), ["model"], "price")
    named = one_per_key(aliases.select("alias", "target"), ["alias"], "model alias")
    aliased = named.join(direct, named.target == direct.model).select(
        F.col("alias").alias("model"), *rates
    )
    extra = aliased.join(direct.select("model"), "model", "left_anti")
    return direct.unionByName(extra)


def price_attempts(attempts: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Plus ``cost_usd`` (8 places half up) and ``cost_warning`` of every answered attempt.

    The returned model is priced if it can be, else the requested one; an unpriced answer has a null
    cost and a warning naming the requested model.
    """
    table = price_table(prices, aliases)
    rates = [name for name in table.columns if name != "model"]
    returned = table.select(
        F.col("model").alias("model_returned"), F.struct(*rates).alias("by_returned")
    )
    requested = table.select(
        F.col("model").alias("model_requested"), F.struct(*rates).alias("by_requested")
    )
    joined = attempts.join(returned, "model_returned", "left").join(
        requested, "model_requested", "left"
    )
    rate = F.coalesce("by_returned", "by_requested")
    micro = None
    for tokens, name in TOKEN_RATES.items():
        part = F.col(tokens).cast("decimal(18,0)") * rate[name].cast("decimal(10,4)")
        micro = part if micro is None else micro + part
    cost = F.round(micro * dec("0.000001"), 8).cast(COST)
    answered = F.col("answered")
    warning = F.concat(F.lit("unpriced_model:"), F.col("model_requested"))
    return joined.withColumns(
        {
            "cost_usd": F.when(answered, cost),
            "cost_warning": F.when(answered & rate.isNull(), warning),
        }
    ).drop("by_returned", "by_requested")


def incurred_cost(
    answered: Column, cache_status: Column, failure_kind: Column, cost: Column
) -> Column:
    """What a call cost the caller: 0 for a hit or a cache miss, the cost when answered, else null."""
    zero = F.lit(0).cast(COST)
    return F.when(answered, F.when(cache_status == "hit", zero).otherwise(cost)).when(
        failure_kind == "cache_miss", zero
    )


def roll_up(attempts: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Per case usage, cost and incurred cost; a total is null when any part is unknown."""
    answered = F.col("answered")
    unpriced = answered & F.col("cost_usd").isNull()
    return attempts.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(answered, F.col(name))), F.lit(0)).alias(name)
            for name in TOKEN_FIELDS
        ],
        F.when(~F.bool_or(unpriced), F.sum(F.when(answered, F.col("cost_usd")))).alias("cost_usd"),
        F.min_by("cost_warning", F.when(unpriced, F.col("index"))).alias("cost_warning"),
        F.when(
            ~F.bool_or(F.col("incurred_cost_usd").isNull()), F.sum("incurred_cost_usd")
        ).alias("incurred_cost_usd"),
    )


def resolve_outcome(
    attempts: DataFrame, max_repairs: int, by: Sequence[str] = ("case_id",)
) -> DataFrame:
    """The outcome of a case from its attempts: the last decides.

    A last repair that broke the schema with the budget spent falls back to the last candidate
    that parsed and failed validation. One pre-aggregated grouping, no per-case sort.
    """
    index = F.col("index")
    candidate = F.when(
        (F.col("status") == "validation_failed") & (index < max_repairs), index
    )
    grouped = attempts.groupBy(*by).agg(
        F.max_by("status", index).alias("last_status"),
        F.max(index).alias("last_index"),
        F.max(candidate).alias("candidate_index"),
    )
    broken = (
        (F.col("last_status") == "schema_invalid")
        & (F.col("last_index") > 0)
        & (F.col("last_index") >= max_repairs)
        & F.col("candidate_index").isNotNull()
    )
    return grouped.select(
        *by,
        F.when(broken, "validation_failed").otherwise(F.col("last_status")).alias("status"),
        F.when(broken, F.col("candidate_index")).otherwise(F.col("last_index")).alias("index"),
    )


# --- replay -----------------------------------------------------------------------------------


def request_key(fields: Column, version: str) -> Column:
    """The cache key of a request: SHA-256 of its members in order, after the recipe's version.

    ``fields`` is a struct in recipe order whose large members are already digests.
    """
    return canonical_sha256(F.struct(F.lit(version).alias("key_version"), fields.alias("fields")))


def store_answers(store: DataFrame, answers: DataFrame) -> DataFrame:
    """The store after new answers: complete ones only, the latest per key, bad entries dropped."""
    usable = F.col("key").rlike(r"\A[0-9a-f]{64}\z") & F.col("answer").isNotNull()
    complete = answers.filter(F.col("stop_reason").isin(*COMPLETE_STOPS))
    merged = store.select("key", "written_at", "answer").unionByName(
        complete.select("key", "written_at", "answer")
    )
    return latest_per_key(merged.filter(usable), ["key"], ["written_at"])


def replay(requests: DataFrame, store: DataFrame, mode: str) -> DataFrame:
    """Requests with ``cache_status``, the stored answer where one is used, and ``makes_call``.

    ``off`` never looks, ``refresh`` always calls, ``read_only`` never calls: a key without an
    entry is a ``cache_miss`` failure. A hit keeps the stored answer and makes no call.
    """
    if mode not in CACHE_MODES:
        raise ValueError(f"unknown cache mode {mode!r}")
    if mode in ("off", "refresh"):
        status = F.lit("refresh" if mode == "refresh" else None).cast("string")
        return requests.withColumns(
            {
                "cache_status": status,
                "answer": F.lit(None).cast(dict(store.dtypes)["answer"]),
                "makes_call": F.lit(True),
            }
        )
    joined = requests.join(store.select("key", "answer"), "key", "left")
    found = F.col("answer").isNotNull()
    missing = "cache_miss" if mode == "read_only" else "miss"
    return joined.withColumns(
        {
            "cache_status": F.when(found, "hit").otherwise(missing),
            "makes_call": ~found & F.lit(mode == "read_write"),
        }
    )


# --- budget -----------------------------------------------------------------------------------


def charge(records: DataFrame, reserve: str) -> DataFrame:
    """Plus ``spent``, ``assumed`` and ``unpriced`` of every record.

    A completed record is charged its incurred cost (its cost where the record knows no incurred
    cost at all), or the reserve when that is unknown. A failed one is charged the reserve only if
    it may have reached the provider.
    """
    completed = F.col("status") == "completed"
    known = F.when(F.col("has_incurred"), F.col("incurred_cost_usd")).otherwise(F.col("cost_usd"))
    cost = F.when(known >= 0, known)
    refused = F.col("http_status").isin(*NO_PROVIDER_CALL_STATUSES)
    unsent = F.col("http_status").isNull() & F.col("error_type").isin(*UNSENT_ERROR_TYPES)
    reached = ~(F.coalesce(refused, F.lit(False)) | F.coalesce(unsent, F.lit(False)))
    held = F.lit(reserve).cast(COST)
    zero = F.lit(0).cast(COST)
    return records.withColumns(
        {
            "spent": F.when(completed, F.coalesce(cost, zero)).otherwise(zero).cast(COST),
            "assumed": F.when(completed & cost.isNull(), held)
            .when(~completed & reached, held)
            .otherwise(zero)
            .cast(COST),
            "unpriced": completed & cost.isNull(),
        }
    )


def admit(
    charged: DataFrame, cap: str, reserve: str, *, run: Sequence[str] = ("run_id",),
    ordinal: str = "ordinal",
) -> DataFrame:
    """Plus ``admitted``: cases run in order while the money so far and the next reserve fit.

    Before each case, spent + assumed + max(reserve, largest spent so far) must not exceed the cap.
    All three only grow along the run, so the first refusal is the stop of all that follow. The
    running values are scanned in chunks of the order, so one run of any length is spread.
    """
    chunked = charged.withColumn("__chunk", F.floor(F.col(ordinal) / ADMIT_CHUNK))
    totals = running_before(
        chunked, list(run), "__chunk", [ordinal],
        sums={"spent_before": "spent", "assumed_before": "assumed"},
        maxima={"largest_before": "spent"},
    )
    zero = F.lit(0).cast("decimal(38,8)")
    spent, assumed = (F.coalesce(f"{name}_before", zero) for name in ("spent", "assumed"))
    held = F.lit(reserve).cast(COST)
    following = F.greatest(held, F.coalesce("largest_before", F.lit(0).cast(COST)))
    fits = spent + assumed + following <= F.lit(cap).cast(COST)
    return totals.withColumns(
        {"spent_before": spent, "assumed_before": assumed, "admitted": fits}
    ).drop("__chunk", "largest_before")


def resume_plan(selection: DataFrame, prior_selection: DataFrame, records: DataFrame) -> DataFrame:
    """What a resumed run does with each case: skip, rerun, run, or keep an earlier selection.

    ``records`` are all stored ones; the latest per case says whether it completed.
    """
    last = latest_per_key(records, ["case_id"], ["ordinal"]).select("case_id", "status")
    chosen = selection.select("case_id", F.lit(True).alias("selected"))
    union = chosen.join(
        prior_selection.select("case_id", F.lit(True).alias("earlier")), "case_id", "full_outer"
    ).join(last, "case_id", "left")
    action = (
        F.when(F.col("selected").isNull(), "earlier_selection")
        .when(F.col("status") == "completed", "skip")
        .when(F.col("status").isNotNull(), "rerun")
        .otherwise("run")
    )
    return union.select("case_id", action.alias("action"))


def override_texts(records: DataFrame) -> DataFrame:
    """The distinct recorded overrides (a map column) as sorted JSON; no overrides reads as null."""
    entries = F.array_sort(F.map_entries("overrides"))
    text = F.when(F.size("overrides") > 0, F.to_json(F.map_from_entries(entries)))
    return records.select(text.alias("overrides")).distinct()


def check_same_overrides(records: DataFrame) -> None:
    """Raise unless all records of a run were requested with one configuration."""
    found = override_texts(records).take(2)
    if len(found) > 1:
        shown = " and ".join(str(row.overrides) for row in found)
        raise RunConfigMismatch(f"the records of one run have different overrides: {shown}")


def run_report(charged: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Completed and failed records, money spent, notional, assumed, and unpriced answers."""
    completed = F.col("status") == "completed"
    return charged.groupBy(*by).agg(
        F.count_if(completed).alias("completed"),
        F.count_if(~completed).alias("harness_errors"),
        F.sum("spent").alias("spent_usd"),
        F.coalesce(F.sum(F.when(completed, F.col("cost_usd"))), F.lit(0).cast(COST)).alias(
            "notional_usd"
        ),
        F.sum("assumed").alias("assumed_usd"),
        F.count_if("unpriced").alias("unpriced_cases"),
    )


def check_overrides(requests: DataFrame, priced: DataFrame, prompts: DataFrame) -> DataFrame:
    """Plus ``bad_fields``: the override names that may not be used, never their values."""
    models = priced.select("model").distinct().withColumn("__priced", F.lit(True))
    known = prompts.select("prompt_version").distinct().withColumn("__known", F.lit(True))
    joined = requests.join(models, "model", "left").join(known, "prompt_version", "left")
    mode, salt = F.col("cache_mode"), F.col("replicate_salt")
    repairs = F.col("max_repairs")
    bad = F.array_compact(
        F.array(
            F.when(mode.isNotNull() & ~mode.isin(*CACHE_MODES), "overrides.cache_mode"),
            F.when(salt.isNotNull() & ~valid_salt(salt), "overrides.replicate_salt"),
            F.when(F.col("model").isNotNull() & F.col("__priced").isNull(), "overrides.model"),
            F.when(
                F.col("prompt_version").isNotNull() & F.col("__known").isNull(),
                "overrides.prompt_version",
            ),
            F.when(
                repairs.isNotNull() & ~repairs.between(0, MAX_REPAIRS_LIMIT),
                "overrides.max_repairs",
            ),
        )
    )
    return joined.withColumn("bad_fields", bad).drop("__priced", "__known")
