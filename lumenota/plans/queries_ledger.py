"""Registered queries of the ledger (L01 to L13, J09, J10) and of decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenota.operators import decisions as d
from lumenota.operators import ledger as led
from lumenota.operators.ordering import latest_per_key, row_index
from lumenota.plans import bindings as b
from lumenota.plans import oracle_sql as q
from lumenota.plans.queries_measure import EVENTS_SQL
from lumenota.plans.registry import query
from lumenota.plans.results import answered_events, event_numbers

C = F.col

_PRICES = (("model-small", "1.00", "1.25", "2.00", "0.10", "5.00"),
           ("model-large", "2.00", "2.50", "4.00", "0.20", "10.00"))


def price_list(spark):
    rates = ("input", "cache_write_5m", "cache_write_1h", "cache_read", "output")
    prices = spark.createDataFrame(_PRICES, "model string, " + ", ".join(f"{r} string" for r in rates))
    aliases = spark.createDataFrame(
        [("model-small-2026", "model-small")], "alias string, target string"
    )
    return prices, aliases


def attempts(spark, sf):
    """Events as attempts: the user is the case, time gives the index inside it."""
    kind, c = C("event_type"), C("c")
    returned = (
        F.when(kind == "click", "model-small")
        .when(kind == "view", "model-small-2026")
        .when(kind == "purchase", "model-new")
        .when(kind == "signup", "model-new")
    )
    requested = F.when(kind == "signup", "model-odd").otherwise("model-large")
    answered = C("event_type") != "error"
    k = C("k")
    usage = {
        "input_tokens": k * 100,
        "output_tokens": k * 10,
        "cache_read_tokens": k,
        "cache_write_5m_tokens": k * 0,
        "cache_write_1h_tokens": F.call_function("div", k, F.lit(2)),
    }
    rows = event_numbers(spark, sf).select(
        C("user_id").alias("case_id"), "event_id", "ts", "c", "event_type",
        F.date_trunc("hour", "ts").alias("hour"),
        returned.alias("model_returned"), requested.alias("model_requested"),
        answered.alias("answered"),
        *[F.when(answered, value).cast("bigint").alias(name) for name, value in usage.items()],
        F.when(answered & (c < 500), "hit").when(answered, "miss").alias("cache_status"),
        F.when(~answered & (c < 1000), "cache_miss").when(~answered, "provider_error").alias(
            "failure_kind"
        ),
    )
    indexed = row_index(rows, ["case_id"], "hour", ["ts", "event_id"], "index")
    priced = led.price_attempts(indexed, *price_list(spark))
    incurred = led.incurred_cost(
        C("answered"), C("cache_status"), C("failure_kind"), C("cost_usd")
    )
    return priced.withColumn("incurred_cost_usd", incurred)


ATTEMPTS_SQL = """numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS idx
  FROM answers),
attempts AS (SELECT user_id AS case_id, event_id, idx, event_type, c, k, event_type<>'error' AS answered,
  CASE WHEN event_type IN ('click','view') THEN 1 WHEN event_type='purchase' THEN 2 END AS tier,
  CASE WHEN event_type='error' AND c<1000 THEN 'cache_miss' WHEN event_type='error' THEN 'provider_error' END
    AS failure FROM numbered),
priced AS (SELECT *, CASE WHEN answered AND tier IS NOT NULL THEN
    tier*(k*100*100 + k*10*500 + k*10 + (k//2)*200) END AS micro,
  CASE WHEN answered AND tier IS NULL THEN 'unpriced_model:model-odd' END AS warning FROM attempts),
ledger AS (SELECT *, CASE WHEN answered THEN CASE WHEN c<500 THEN 0 ELSE micro END
  WHEN failure='cache_miss' THEN 0 END AS paid FROM priced)"""
# micro is in 1e-8 dollars: tokens x (rate in cents) / 1e6 tokens.
LEDGER = (EVENTS_SQL, ATTEMPTS_SQL)


@query(
    "l01_price_attempts",
    q.with_ctes(*LEDGER, select="SELECT event_id, micro/100000000 AS cost_usd, warning AS cost_warning FROM ledger"),
)
def price_attempts(spark, sf):
    return attempts(spark, sf).select("event_id", "cost_usd", "cost_warning")


@query(
    "l02_incurred_cost",
    q.with_ctes(*LEDGER, select="SELECT event_id, paid/100000000 AS incurred_cost_usd FROM ledger"),
)
def incurred_cost(spark, sf):
    return attempts(spark, sf).select("event_id", "incurred_cost_usd")


@query(
    "l03_roll_up",
    q.with_ctes(
        *LEDGER,
        select="""SELECT case_id, sum(CASE WHEN answered THEN k*100 ELSE 0 END)::BIGINT AS input_tokens,
          CASE WHEN NOT bool_or(answered AND micro IS NULL) THEN sum(micro)/100000000 END AS cost_usd,
          first(warning ORDER BY idx) FILTER (warning IS NOT NULL) AS cost_warning,
          CASE WHEN NOT bool_or(paid IS NULL) THEN sum(paid)/100000000 END AS incurred_cost_usd
          FROM ledger GROUP BY case_id""",
    ),
)
def roll_up(spark, sf):
    found = led.roll_up(attempts(spark, sf))
    return found.select(
        "case_id", "input_tokens", "cost_usd", "cost_warning", "incurred_cost_usd"
    )


@query(
    "l03_roll_up_by_kind",
    q.with_ctes(
        *LEDGER,
        select="""SELECT case_id, event_type,
          CASE WHEN NOT bool_or(answered AND micro IS NULL) THEN sum(micro)/100000000 END AS cost_usd,
          CASE WHEN NOT bool_or(paid IS NULL) THEN sum(paid)/100000000 END AS incurred_cost_usd
          FROM ledger GROUP BY case_id, event_type""",
    ),
)
def roll_up_by_kind(spark, sf):
    found = led.roll_up(attempts(spark, sf), ("case_id", "event_type"))
    return found.select("case_id", "event_type", "cost_usd", "incurred_cost_usd")


@query(
    "l04_resolve_outcome",
    """WITH turns AS (SELECT conv_id, turn, CASE WHEN role='assistant' AND length(text)>200 THEN 'schema_invalid'
        WHEN role='assistant' THEN 'success' ELSE 'validation_failed' END AS status FROM conversations),
      lasts AS (SELECT conv_id, max(turn) AS last, max(turn) FILTER (status='validation_failed' AND turn<2) AS cand
        FROM turns GROUP BY conv_id)
      SELECT conv_id AS case_id, CASE WHEN t.status='schema_invalid' AND last>0 AND last>=2 AND cand IS NOT NULL
        THEN 'validation_failed' ELSE t.status END AS status,
        CASE WHEN t.status='schema_invalid' AND last>0 AND last>=2 AND cand IS NOT NULL THEN cand ELSE last END
        AS "index" FROM lasts JOIN turns t USING (conv_id) WHERE t.turn=last""",
)
def resolve_outcome(spark, sf):
    assistant = C("role") == "assistant"
    status = (
        F.when(assistant & (F.length("text") > 200), "schema_invalid")
        .when(assistant, "success")
        .otherwise("validation_failed")
    )
    turns = b.table(spark, sf, "conversations").select(
        C("conv_id").alias("case_id"), C("turn").alias("index"), status.alias("status")
    )
    return led.resolve_outcome(turns, 2)


_KEY = """sha256('{"key_version":"1","fields":{"role":"'||role||'","text_sha256":"'||sha256(text)||'"}}')"""


def requests(spark, sf):
    fields = F.struct("role", F.sha2("text", 256).alias("text_sha256"))
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", led.request_key(fields, "1").alias("key")
    )


@query("l05_request_key", f"SELECT conv_id, turn, {_KEY} AS key FROM conversations")
def request_key(spark, sf):
    return requests(spark, sf).select("conv_id", "turn", "key")


_STORE = f"""keyed AS (SELECT conv_id, turn, role, {_KEY} AS key FROM conversations),
store AS (SELECT key, max(conv_id*100+turn) AS written_at FROM keyed WHERE role IN ('assistant','system')
  GROUP BY key)"""


def _store(spark, sf):
    """A store of the assistant and system turns: other turns are not complete answers."""
    stop = F.when(C("role") == "assistant", "end_turn").when(C("role") == "system", "tool_use")
    answers = requests(spark, sf).select(
        "key",
        (C("conv_id") * 100 + C("turn")).alias("written_at"),
        F.concat_ws("/", "conv_id", "turn").alias("answer"),
        stop.otherwise("max_tokens").alias("stop_reason"),
    )
    empty = answers.filter(F.lit(False)).select("key", "written_at", "answer")
    return led.store_answers(empty, answers)


@query(
    "l06_replay_read_only",
    q.with_ctes(
        _STORE,
        select="""SELECT conv_id, turn, CASE WHEN s.key IS NULL THEN 'cache_miss' ELSE 'hit' END AS cache_status,
          false AS makes_call FROM keyed k LEFT JOIN store s ON k.key=s.key""",
    ),
)
def replay_read_only(spark, sf):
    found = led.replay(requests(spark, sf), _store(spark, sf), "read_only")
    return found.select("conv_id", "turn", "cache_status", "makes_call")


@query(
    "j10_replay_read_write",
    q.with_ctes(
        _STORE,
        select="""SELECT conv_id, turn, CASE WHEN s.key IS NULL THEN 'miss' ELSE 'hit' END AS cache_status,
          s.key IS NULL AS makes_call FROM keyed k LEFT JOIN store s ON k.key=s.key""",
    ),
)
def replay_read_write(spark, sf):
    found = led.replay(requests(spark, sf), _store(spark, sf), "read_write")
    return found.select("conv_id", "turn", "cache_status", "makes_call")


@query("l07_store_answers", q.with_ctes(_STORE, select="SELECT key, written_at FROM store"))
def store_answers(spark, sf):
    return _store(spark, sf).select("key", "written_at")


def charged_events(spark, sf):
    """Events as run records: errors failed in four ways, the rest completed."""
    kind, c = C("event_type"), C("c")
    failed = kind == "error"
    records = answered_events(spark, sf).select(
        F.lit("run").alias("run_id"), C("event_id").alias("ordinal"), "user_id",
        F.when(failed, "harness_error").otherwise("completed").alias("status"),
        (kind != "view").alias("has_incurred"), "cost_usd", "incurred_cost_usd",
        F.when(failed & (c < 500), 400).when(failed & (c < 2000), 500).alias("http_status"),
        F.when(failed & (c >= 2000) & (c < 6000), "ConnectError")
        .when(failed & (c >= 6000), "ReadTimeout")
        .alias("error_type"),
    )
    return led.charge(records, "0.50")


CHARGED_SQL = """charged AS (SELECT event_id, user_id, status='success' AS priced_ok, event_type, c,
  CASE WHEN event_type IN ('error','signup') THEN 0 WHEN event_type='view' OR c>=500 THEN c ELSE 0 END AS spent,
  CASE WHEN event_type='signup' THEN 50 WHEN event_type='error' AND c<500 THEN 0
    WHEN event_type='error' AND c<2000 THEN 50 WHEN event_type='error' AND c<6000 THEN 0
    WHEN event_type='error' THEN 50 ELSE 0 END AS assumed FROM answers)"""
CHARGED = (EVENTS_SQL, CHARGED_SQL)


@query(
    "l08_charge",
    q.with_ctes(
        *CHARGED,
        select="""SELECT event_id AS ordinal, spent/100 AS spent, assumed/100 AS assumed,
          event_type='signup' AS unpriced FROM charged""",
    ),
)
def charge(spark, sf):
    return charged_events(spark, sf).select("ordinal", "spent", "assumed", "unpriced")


@query(
    "l09_admit",
    q.with_ctes(
        *CHARGED,
        """running AS (SELECT *, coalesce(sum(spent) OVER w,0) AS s, coalesce(sum(assumed) OVER w,0) AS a,
          coalesce(max(spent) OVER w,0) AS largest FROM charged
          WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        select="""SELECT event_id AS ordinal, s/100 AS spent_before, a/100 AS assumed_before,
          s+a+greatest(50,largest)<=5000000 AS admitted FROM running""",
    ),
)
def admit(spark, sf):
    """All events as one run in event order, against a cap of 50,000."""
    found = led.admit(charged_events(spark, sf), "50000.00", "0.50")
    return found.select("ordinal", "spent_before", "assumed_before", "admitted")


@query(
    "l10_resume_plan",
    """WITH last AS (SELECT user_id AS case_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id),
      chosen AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderstatus='F'),
      earlier AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderstatus='P')
      SELECT coalesce(c.case_id,e.case_id) AS case_id, CASE WHEN c.case_id IS NULL THEN 'earlier_selection'
        WHEN kind IS NULL THEN 'run' WHEN kind<>'error' THEN 'skip' ELSE 'rerun' END AS action
      FROM chosen c FULL OUTER JOIN earlier e ON c.case_id=e.case_id
      LEFT JOIN last l ON l.case_id=coalesce(c.case_id,e.case_id)""",
)
def resume_plan(spark, sf):
    orders = b.table(spark, sf, "orders").select(C("o_custkey").alias("case_id"), "o_orderstatus")
    records = b.table(spark, sf, "events").select(
        C("user_id").alias("case_id"),
        C("event_id").alias("ordinal"),
        F.when(C("event_type") == "error", "harness_error").otherwise("completed").alias("status"),
    )
    return led.resume_plan(
        orders.filter("o_orderstatus = 'F'").select("case_id").distinct(),
        orders.filter("o_orderstatus = 'P'").select("case_id").distinct(),
        records,
    )


@query(
    "l11_same_overrides",
    """SELECT DISTINCT CASE WHEN lang IN ('en','fr') THEN '{"cache_mode":"'||lang||'","salt":"s"}' END AS overrides
      FROM documents""",
)
def same_overrides(spark, sf):
    docs = b.table(spark, sf, "documents")
    given = F.create_map(F.lit("salt"), F.lit("s"), F.lit("cache_mode"), C("lang"))
    return led.override_texts(
        docs.select(F.when(C("lang").isin("en", "fr"), given).alias("overrides"))
    )


@query(
    "l12_run_report",
    q.with_ctes(
        *CHARGED,
        select="""SELECT user_id, count(*) FILTER (event_type<>'error') AS completed,
          count(*) FILTER (event_type='error') AS harness_errors, sum(spent)/100 AS spent_usd,
          sum(CASE WHEN priced_ok THEN c ELSE 0 END)/100 AS notional_usd, sum(assumed)/100 AS assumed_usd,
          count(*) FILTER (event_type='signup') AS unpriced_cases FROM charged GROUP BY user_id""",
    ),
)
def run_report(spark, sf):
    return led.run_report(charged_events(spark, sf), ("user_id",))


@query(
    "l13_check_overrides",
    """SELECT o_orderkey, array_to_string(list_filter([
      CASE WHEN o_orderstatus='P' THEN 'overrides.cache_mode' END,
      CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN 'overrides.replicate_salt' END,
      CASE WHEN o_orderstatus='O' THEN 'overrides.model' END,
      CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'overrides.prompt_version' END,
      CASE WHEN CAST(substr(o_orderpriority,1,1) AS INTEGER)*2>5 THEN 'overrides.max_repairs' END],
      lambda x: x IS NOT NULL), ',') AS bad_fields FROM orders""",
)
def check_overrides(spark, sf):
    status, priority = C("o_orderstatus"), C("o_orderpriority")
    asked = b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "P", "sometimes").otherwise("read_only").alias("cache_mode"),
        priority.alias("replicate_salt"),
        F.when(status == "F", "model-large").when(status == "O", "model-odd").alias("model"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "extract-x").otherwise("extract-1").alias(
            "prompt_version"
        ),
        (F.substring(priority, 1, 1).cast("int") * 2).alias("max_repairs"),
    )
    priced = led.price_table(*price_list(spark))
    prompts = spark.createDataFrame([("extract-1",)], "prompt_version string")
    return led.check_overrides(asked, priced, prompts).select("o_orderkey", "bad_fields")


@query(
    "j09_price_lookup",
    q.with_ctes(
        *LEDGER,
        select="""SELECT event_type, count(*) FILTER (micro IS NOT NULL) AS priced,
          count(*) FILTER (warning IS NOT NULL) AS unpriced FROM ledger GROUP BY event_type""",
    ),
)
def price_lookup(spark, sf):
    return attempts(spark, sf).groupBy("event_type").agg(
        F.count("cost_usd").alias("priced"), F.count("cost_warning").alias("unpriced")
    )


@query(
    "s04_latest_per_key",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1""",
)
def latest(spark, sf):
    events = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"]).drop("ts")


# --- decisions --------------------------------------------------------------------------------

_CASES = """dcases AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'P' THEN 'refused' ELSE 'success' END
  AS extraction_status, c_mktsegment AS tax_id, o_orderpriority='1-URGENT' AS has_warning,
  CAST(round(o_totalprice*100) AS BIGINT) AS total, o_orderpriority, o_orderstatus, o_custkey
  FROM orders JOIN customer ON o_custkey=c_custkey),
ruled AS (SELECT *, CASE WHEN extraction_status<>'success' THEN 1 WHEN tax_id<>'BUILDING' THEN 2
  WHEN has_warning THEN 3 WHEN total>20000000 THEN 4 ELSE 5 END AS rule FROM dcases),
labelled AS (SELECT *, CASE rule WHEN 2 THEN 'reject' WHEN 5 THEN 'approve' ELSE 'escalate' END AS decision,
  CASE rule WHEN 1 THEN 'extraction_not_success' WHEN 3 THEN 'policy_warning' WHEN 4 THEN 'over_limit'
  ELSE 'none' END AS cause FROM ruled)"""


def labelled(spark, sf):
    orders, customer = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    cases = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        C("o_orderkey").alias("case_id"),
        F.when(C("o_orderstatus") == "P", "refused").otherwise("success").alias(
            "extraction_status"
        ),
        C("c_mktsegment").alias("tax_id"),
        (C("o_orderpriority") == "1-URGENT").alias("has_warning"),
        C("o_totalprice").cast("decimal(18,2)").alias("invoice_total"),
        "o_orderpriority",
        "o_orderstatus",
    )
    policy = spark.createDataFrame(
        [("BUILDING", "200000.00")], "buyer_cnpj string, approval_limit string"
    ).withColumn("approval_limit", C("approval_limit").cast("decimal(18,2)"))
    return d.label(cases, policy)


@query("d01_label", q.with_ctes(_CASES, select="SELECT case_id, rule::BIGINT AS rule, decision, cause FROM labelled"))
def label(spark, sf):
    return labelled(spark, sf).select("case_id", "rule", "decision", "cause")


@query(
    "d02_allowed_pair",
    """SELECT event_id, CASE WHEN event_type IN ('click','view') THEN c>=500 WHEN event_type='error'
      THEN c<500 ELSE false END AS allowed FROM (SELECT *, CAST(round(value*100) AS BIGINT) AS c FROM events)""",
)
def allowed_pair(spark, sf):
    kind, c = C("event_type"), C("c")
    outcome = F.when(kind == "click", "approve").when(kind == "view", "reject").when(
        kind == "error", "escalate"
    )
    cause = F.when(c < 500, "over_limit").otherwise("none")
    return event_numbers(spark, sf).select("event_id", d.allowed_pair(outcome, cause).alias("allowed"))


def decided(spark, sf):
    """The model approves or rejects by price alone; the guard then reads the status."""
    cases = labelled(spark, sf)
    model = F.when(C("invoice_total") > 300000, "escalate").when(
        C("tax_id") == "BUILDING", "approve"
    )
    records = cases.select(
        "case_id",
        C("extraction_status").alias("guard_status"),
        model.otherwise("reject").alias("model_decision"),
        F.when(C("invoice_total") > 300000, "over_limit").otherwise("none").alias("model_cause"),
        F.when(C("o_orderpriority") == "5-LOW", "refused").otherwise("decided").alias("status"),
        "o_orderpriority",
    )
    guarded = d.apply_guard(records)
    lost = (C("o_orderpriority") == "4-NOT SPECIFIED") & (C("guard_status") != "success")
    kept = ("decision", "cause", "decided_by", "guard_overridden", "model_decision")
    undecided = C("status") != "decided"
    return guarded.withColumns(
        {
            name: F.when(~undecided & (~lost if name in ("decision", "cause") else F.lit(True)), C(name))
            for name in kept
        }
    )


DECIDED = f"""{_CASES},
guarded AS (SELECT *, CASE WHEN total>30000000 THEN 'escalate' WHEN tax_id='BUILDING' THEN 'approve' ELSE 'reject' END
    AS md, CASE WHEN total>30000000 THEN 'over_limit' ELSE 'none' END AS mc, o_orderpriority='5-LOW' AS und,
    o_orderpriority='4-NOT SPECIFIED' AND extraction_status<>'success' AS lost,
    extraction_status='success' AS ok FROM labelled),
decided AS (SELECT case_id, decision AS expected_decision, cause AS expected_cause,
  CASE WHEN und THEN 'refused' ELSE 'decided' END AS status,
  CASE WHEN NOT und AND NOT lost THEN CASE WHEN ok THEN md ELSE 'escalate' END END AS decision,
  CASE WHEN NOT und AND NOT lost THEN CASE WHEN ok THEN mc ELSE 'extraction_not_success' END END AS cause,
  CASE WHEN NOT und THEN CASE WHEN ok THEN 'model' ELSE 'guard' END END AS decided_by,
  CASE WHEN NOT und THEN NOT ok AND md IN ('approve','reject') END AS guard_overridden,
  CASE WHEN NOT und THEN md END AS model_decision FROM guarded),
graded_decisions AS (SELECT *, CASE WHEN status='decided' THEN coalesce(decision=expected_decision,false) END
    AS decision_correct,
  CASE WHEN status='decided' AND decision IS NOT NULL AND expected_decision='escalate'
    THEN coalesce(cause=expected_cause,false) END AS cause_correct,
  CASE WHEN status='decided' AND decision IS NOT NULL AND model_decision IS NOT NULL
    THEN model_decision=expected_decision END AS model_decision_correct FROM decided)"""


@query(
    "d03_apply_guard",
    q.with_ctes(
        DECIDED,
        select="SELECT case_id, decision, cause, decided_by, guard_overridden, model_decision FROM decided",
    ),
)
def apply_guard(spark, sf):
    return decided(spark, sf).select(
        "case_id", "decision", "cause", "decided_by", "guard_overridden", "model_decision"
    )


def graded_decisions(spark, sf):
    return d.grade_decisions(decided(spark, sf), labelled(spark, sf))


@query(
    "d05_grade_decisions",
    q.with_ctes(
        DECIDED,
        select="""SELECT case_id, decision_correct, cause_correct, model_decision_correct
          FROM graded_decisions""",
    ),
)
def grade_decisions(spark, sf):
    return graded_decisions(spark, sf).select(
        "case_id", "decision_correct", "cause_correct", "model_decision_correct"
    )


def _accuracy(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS measure, count({column}) AS n, count(*) FILTER ({column}) AS correct,
      CASE WHEN count({column})>0 THEN count(*) FILTER ({column})::DOUBLE/count({column})::DOUBLE END AS rate
      FROM graded_decisions"""


_ACCURACIES = " UNION ALL ".join(
    _accuracy(name, column)
    for name, column in (
        ("accuracy", "decision_correct"),
        ("cause_accuracy", "cause_correct"),
        ("model_accuracy", "model_decision_correct"),
    )
)
_ESCALATION = """SELECT tp::DOUBLE/said::DOUBLE AS precision, tp::DOUBLE/meant::DOUBLE AS recall FROM (SELECT
  count(*) FILTER (decision='escalate' AND expected_decision='escalate') AS tp,
  count(*) FILTER (decision='escalate') AS said, count(*) FILTER (expected_decision='escalate') AS meant
  FROM graded_decisions WHERE decision_correct IS NOT NULL)"""


@query("d08_decision_accuracy", q.with_ctes(DECIDED, select=_ACCURACIES))
def decision_accuracy(spark, sf):
    return d.decision_accuracy(graded_decisions(spark, sf))


@query("d09_escalation_pr", q.with_ctes(DECIDED, select=_ESCALATION))
def escalation_pr(spark, sf):
    return d.escalation_pr(graded_decisions(spark, sf))


@query(
    "d12_decision_summary",
    q.with_ctes(
        DECIDED,
        f"acc AS ({_ACCURACIES})",
        select="SELECT "
        + ", ".join(
            f"(SELECT {part} FROM acc WHERE measure='{name}') AS {name}_{part}"
            for name in ("accuracy", "cause_accuracy", "model_accuracy")
            for part in ("n", "correct", "rate")
        )
        + f""", e.*, g.* FROM ({_ESCALATION}) e, (SELECT count(guard_overridden) AS guard_checked,
          count(*) FILTER (guard_overridden) AS guard_overridden, count(*) AS total FROM graded_decisions) g""",
    ),
)
def decision_summary(spark, sf):
    return d.decision_summary(graded_decisions(spark, sf))


def _steps(spark, sf):
    size = F.length("text")
    assistant = C("role") == "assistant"
    return b.table(spark, sf, "conversations").select(
        C("conv_id").alias("case_id"),
        C("turn").alias("step"),
        F.when(C("role") == "system", "provider_error").alias("failure_kind"),
        F.when(C("role") == "user", "tool_use")
        .when(assistant & (size < 100), "refusal")
        .when(assistant & (size < 200), "max_tokens")
        .otherwise("end_turn")
        .alias("stop_reason"),
        F.when(size < 80, 0).otherwise(1).alias("calls"),
        (size > 300).alias("tool_failed"),
        (size < 400).alias("parsed"),
    )


@query(
    "d04_terminal_state",
    """WITH last AS (SELECT conv_id AS case_id, max(turn) AS last_step, arg_max(role,turn) AS role,
        arg_max(length(text),turn) AS n FROM conversations GROUP BY conv_id),
      stated AS (SELECT *, CASE WHEN role='system' THEN 'infrastructure_failure'
        WHEN role='user' AND n<80 THEN 'schema_invalid' WHEN role='user' AND (last_step>=5 OR n>300) THEN 'decided'
        WHEN role='user' THEN NULL WHEN n<100 THEN 'refused' WHEN n<200 THEN 'truncated'
        WHEN n<400 THEN 'decided' ELSE 'schema_invalid' END AS status FROM last),
      decider AS (SELECT *, CASE WHEN status='decided' THEN CASE WHEN role='user' AND last_step>=5 THEN 'step_budget'
        WHEN role='user' THEN 'tool_failure' ELSE 'model' END END AS decided_by FROM stated)
      SELECT case_id, last_step, status, decided_by, CASE decided_by WHEN 'step_budget' THEN
        'step_budget_exhausted' WHEN 'tool_failure' THEN 'tool_failed' END AS code_cause FROM decider""",
)
def terminal_state(spark, sf):
    return d.terminal_state(_steps(spark, sf), 6)


@query(
    "j03_records_without_label",
    "SELECT doc_id AS case_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def records_without_label(spark, sf):
    docs = b.table(spark, sf, "documents").select(C("doc_id").alias("case_id"))
    return d.unlabelled(docs, b.table(spark, sf, "labels").select(C("doc_id").alias("case_id")))


_CITED = """cited AS (SELECT user_id AS case_id, event_type AS source, count(*) AS n FROM events
  WHERE event_type<>'error' GROUP BY ALL),
called AS (SELECT DISTINCT user_id AS case_id, event_type AS name FROM events WHERE event_type<>'signup'
  AND CAST(round(value*100) AS BIGINT)<9000),
judged AS (SELECT c.case_id, sum(n)::BIGINT AS evidence_count, bool_and(l.name IS NOT NULL) AS valid FROM cited c
  LEFT JOIN called l ON c.case_id=l.case_id AND c.source=l.name GROUP BY c.case_id)"""


def _citation_inputs(spark, sf):
    events = event_numbers(spark, sf)
    evidence = events.filter("event_type <> 'error'").select(
        C("user_id").alias("case_id"), C("event_type").alias("source")
    )
    calls = events.select(
        C("user_id").alias("case_id"),
        C("event_type").alias("name"),
        F.when(C("event_type") == "signup", "guard").otherwise("model").alias("source"),
        F.when(C("c") < 3000, "ok").when(C("c") < 9000, "error").otherwise("skipped").alias(
            "outcome"
        ),
    )
    return evidence, calls


@query(
    "d06_citations",
    q.with_ctes(
        _CITED,
        select="""SELECT c_custkey AS case_id, coalesce(evidence_count,0) AS evidence_count,
          coalesce(valid,true) AND NOT (evidence_count IS NULL AND c_mktsegment='BUILDING') AS citations_valid,
          evidence_count IS NULL AS uncited FROM customer LEFT JOIN judged ON case_id=c_custkey""",
    ),
)
def citations(spark, sf):
    evidence, calls = _citation_inputs(spark, sf)
    decisions = b.table(spark, sf, "customer").select(
        C("c_custkey").alias("case_id"),
        F.when(C("c_mktsegment") == "BUILDING", "approve").otherwise("escalate").alias(
            "model_decision"
        ),
    )
    return d.citations(evidence, calls, decisions)


@query(
    "j16_uncalled_sources",
    q.with_ctes(
        _CITED,
        select="""SELECT c.case_id, c.source FROM cited c ANTI JOIN called l
          ON c.case_id=l.case_id AND c.source=l.name""",
    ),
)
def uncalled_sources(spark, sf):
    evidence, calls = _citation_inputs(spark, sf)
    called = calls.filter((C("source") == "model") & C("outcome").isin(*d.CALLED)).select(
        "case_id", C("name").alias("source")
    )
    return evidence.distinct().join(called, ["case_id", "source"], "left_anti")


@query(
    "d07_step_counts",
    q.with_ctes(
        EVENTS_SQL,
        select="""SELECT user_id AS case_id, count(*) AS steps, count(*) FILTER (status='success') AS answered_steps,
          count(*) FILTER (status='success' AND c<500) AS cache_hits,
          sum(CASE WHEN status='success' THEN k*100 ELSE 0 END)::BIGINT AS input_tokens,
          sum(CASE WHEN status='success' THEN k*10 ELSE 0 END)::BIGINT AS output_tokens,
          count(*) FILTER (event_type<>'signup') AS model_tool_calls,
          count(*) FILTER (event_type='signup') AS guard_tool_calls FROM answers GROUP BY user_id""",
    ),
)
def step_counts(spark, sf):
    steps = answered_events(spark, sf).select(
        C("user_id").alias("case_id"),
        (C("status") == "success").alias("answered"),
        F.when(C("cache_hits") == 1, "hit").alias("cache_status"),
        "input_tokens",
        "output_tokens",
    )
    return d.step_counts(steps, _citation_inputs(spark, sf)[1])


@query(
    "d10_spread",
    """SELECT event_type, min(c)::BIGINT AS least, quantile_cont(c::DOUBLE,0.5) AS median, max(c)::BIGINT AS greatest
      FROM (SELECT event_type, CAST(round(value*100) AS BIGINT) AS c FROM events) GROUP BY event_type""",
)
def spread(spark, sf):
    return d.spread(event_numbers(spark, sf), "c", ("event_type",))


@query(
    "d11_decision_totals",
    q.with_ctes(
        EVENTS_SQL,
        select="""SELECT sum(CASE WHEN status='success' THEN k*100 ELSE 0 END)::BIGINT AS input_tokens,
          sum(CASE WHEN status='success' THEN k*10 ELSE 0 END)::BIGINT AS output_tokens,
          sum(CASE WHEN status='success' THEN k ELSE 0 END)::BIGINT AS cache_read_tokens,
          0::BIGINT AS cache_write_5m_tokens,
          sum(CASE WHEN status='success' THEN k//2 ELSE 0 END)::BIGINT AS cache_write_1h_tokens,
          CAST(NULL AS DOUBLE) AS cost_usd, CAST(NULL AS DOUBLE) AS incurred_cost_usd,
          count(*) FILTER (status='infrastructure_failure') AS unpriced_cases,
          count(*) FILTER (status='infrastructure_failure') AS unpriced_incurred_cases FROM answers""",
    ),
)
def decision_totals(spark, sf):
    return d.decision_totals(answered_events(spark, sf))


@query(
    "d13_decision_valid",
    """SELECT event_id, event_type<>'error' AND CAST(round(value*100) AS BIGINT)>=500 AS valid FROM events""",
)
def decision_valid(spark, sf):
    kind, c = C("event_type"), C("c")
    item = F.struct(
        kind.alias("source"), F.lit("r").alias("ref"), F.when(c >= 500, "v").alias("value")
    )
    decision = F.struct(
        F.array(item).alias("evidence"),
        F.lit("why").alias("reason"),
        F.when(kind == "error", "perhaps").otherwise("reject").alias("outcome"),
        F.lit("none").alias("cause"),
    )
    return event_numbers(spark, sf).select("event_id", d.decision_valid(decision).alias("valid"))
