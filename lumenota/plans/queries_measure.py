"""Registered queries of the measures (A01 to A27) and of comparing two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenota.operators import compare as cmp
from lumenota.operators import grading as g
from lumenota.operators import measure as m
from lumenota.plans import bindings as b
from lumenota.plans import graded_sql as s
from lumenota.plans import oracle_sql as q
from lumenota.plans.graded import graded_cases, graded_run, tagged_wrong
from lumenota.plans.queries_grading import STATS_SQL, link_stats
from lumenota.plans.registry import query
from lumenota.plans.results import answered_events

C = F.col
BASE = (*s.WRONG, s.GRADED)

RATE = "CASE WHEN {n}=0 THEN NULL ELSE ((20000*{k}+{n})//(2*{n}))/10000 END"
_Z = 1.959963984540054
_Z2 = _Z * _Z


def rate_sql(k: str, n: str) -> str:
    return RATE.format(k=k, n=n)


def wilson_sql(k: str, n: str, i: str) -> str:
    p = f"(({k})::DOUBLE/({n})::DOUBLE)"
    d = f"(1.0::DOUBLE+{_Z2!r}::DOUBLE/({i})::DOUBLE)"
    centre = f"(({p}+{_Z2!r}::DOUBLE/(2.0::DOUBLE*({i})::DOUBLE))/{d})"
    spread = (
        f"({p}*(1.0::DOUBLE-{p})/({i})::DOUBLE+{_Z2!r}::DOUBLE/"
        f"(4.0::DOUBLE*({i})::DOUBLE*({i})::DOUBLE))"
    )
    half = f"({_Z!r}::DOUBLE*sqrt({spread})/{d})"
    low = f"floor(greatest(0.0::DOUBLE,{centre}-{half})*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE"
    high = f"floor(least(1.0::DOUBLE,{centre}+{half})*10000.0::DOUBLE+0.5::DOUBLE)/10000.0::DOUBLE"
    usable = f"({n})>0 AND ({i})>0"
    return (
        f"CASE WHEN {usable} THEN {low} END AS low, CASE WHEN {usable} THEN {high} END AS high"
    )


def correct_sql(source: str, keys: str = "") -> str:
    """The correct-rate row of A02 over ``source``, grouped by ``keys``."""
    listed = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {listed}cases, invoices, excluded, correct, {rate_sql("correct", "cases")} AS rate,
      {wilson_sql("correct", "cases", "invoices")} FROM (SELECT {listed}
      count(*) FILTER (correct IS NOT NULL) AS cases,
      count(DISTINCT base_case) FILTER (correct IS NOT NULL) AS invoices,
      count(*) FILTER (status IN ('infrastructure_failure','harness_error')) AS excluded,
      count(*) FILTER (correct) AS correct FROM {source} {group})"""


SCOPED = """scoped AS (SELECT *, unnest(['overall', split, 'full']) AS scope FROM graded)"""


def _cases(spark, sf):
    return graded_cases(graded_run(spark, sf))


def scoped_cases(spark, sf):
    cases = _cases(spark, sf)
    manifest = b.table(spark, sf, "orders").select(C("o_orderkey").alias("case_id"))
    return m.with_scopes(cases, m.manifest_complete(cases, manifest))


@query(
    "a01_status_counts",
    q.with_ctes(
        q.CASES,
        select=f"""SELECT status, count(case_id) AS cases FROM (SELECT unnest([
          {",".join(f"'{x}'" for x in g.OUTCOME_STATUSES)}]) AS status) LEFT JOIN cases USING (status)
          GROUP BY status""",
    ),
)
def status_counts(spark, sf):
    return m.status_counts(b.case_metadata(spark, sf))


@query("a02_correct_rate", q.with_ctes(*BASE, select=correct_sql("graded")))
def correct_rate(spark, sf):
    return m.correct_rate(_cases(spark, sf))


@query(
    "a03_wilson",
    f"""SELECT c_mktsegment, {wilson_sql("k", "n", "i")} FROM (SELECT c_mktsegment, count(*) AS n,
      count(*) FILTER (o_orderstatus='F') AS k, count(DISTINCT o_custkey) AS i FROM orders
      JOIN customer ON o_custkey=c_custkey GROUP BY c_mktsegment)""",
)
def wilson(spark, sf):
    orders, customer = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    counts = joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(C("o_orderstatus") == "F").alias("k"),
        F.count_distinct("o_custkey").alias("i"),
    )
    return m.with_rate(counts, "k", "n", "i").select("c_mktsegment", "low", "high")


def silent_sql(source: str, keys: str = "") -> str:
    listed = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {listed}success_cases, invoices, silent, {rate_sql("silent", "success_cases")} AS rate,
      {wilson_sql("silent", "success_cases", "invoices")}, payment_cases, silent-payment_cases
      AS other_cases FROM (SELECT {listed} count(*) FILTER (status='success') AS success_cases,
      count(DISTINCT base_case) FILTER (status='success') AS invoices,
      count(*) FILTER (status='success' AND wrong_count>0) AS silent,
      count(*) FILTER (status='success' AND wrong_count>0 AND payment) AS payment_cases
      FROM {source} {group})"""


@query("a04_silent_errors", q.with_ctes(*BASE, SCOPED, select=silent_sql("scoped", "scope")))
def silent_errors(spark, sf):
    return m.silent_errors(scoped_cases(spark, sf), ("scope",))


@query(
    "a05_wrong_on_success",
    q.with_ctes(
        *s.WRONG,
        select="""SELECT CASE WHEN scope='header' THEN path ELSE scope||'.'||col END AS label,
          count(*) AS wrong_values FROM wrong JOIN gcase USING (case_id) WHERE status='success'
          GROUP BY ALL""",
    ),
)
def wrong_on_success(spark, sf):
    run = graded_run(spark, sf)
    return m.wrong_on_success(run.cases, run.wrong)


@query(
    "a06_tag_counts",
    q.with_ctes(
        *s.WRONG, s.TAGGED,
        select=f"""SELECT tag, count(case_id) AS wrong_values, count(DISTINCT case_id) AS cases FROM
          (SELECT unnest({s.TAG_LIST}) AS tag) LEFT JOIN
          (SELECT case_id, {s.TAG_LIST}[rule+1] AS tag FROM tagged) USING (tag) GROUP BY tag""",
    ),
)
def tag_counts(spark, sf):
    """Near-miss and other wrong text read as one tag here, as in ``t_tag_values``."""
    tagged = tagged_wrong(graded_run(spark, sf))
    tag = F.when(C("tag") == "text_near_miss", "text_wrong").otherwise(C("tag"))
    return m.tag_counts(tagged.withColumn("tag", tag))


@query(
    "a07_incomplete_state",
    """SELECT true AS incomplete, count(*) FILTER (event_type='error') AS infrastructure_failure,
      count(*) FILTER (event_type='signup') AS harness_error,
      (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS cases_not_run,
      'cost_cap' AS stopped_reason, CAST(NULL AS VARCHAR) AS run_state FROM events""",
)
def incomplete_state(spark, sf):
    kind = C("event_type")
    status = F.when(kind == "error", "infrastructure_failure").when(
        kind == "signup", "harness_error"
    )
    cases = b.table(spark, sf, "events").select(status.otherwise("success").alias("status"))
    not_run = g.cases_not_run(
        b.table(spark, sf, "documents").select(C("doc_id").alias("case_id")),
        b.table(spark, sf, "labels").select(C("doc_id").alias("case_id")),
    )
    return m.incomplete_state(cases, not_run, stopped_reason="cost_cap")


@query(
    "a08_hazard_counts",
    q.with_ctes(
        *BASE,
        """flags AS (SELECT case_id, bool_or(t_unit='PAR') AS u,
          bool_or(t_unit_price>=1000000000 OR t_total>=10000000) AS n FROM t_items GROUP BY case_id),
        flagged AS (SELECT correct, coalesce(u,false) AS u, coalesce(n,false) AS n FROM graded
          LEFT JOIN flags USING (case_id) WHERE rendering='text')""",
        select="""SELECT * FROM (
          SELECT 'unit_wrap' AS hazard, count(*) AS cases, count(*) FILTER (correct) AS correct
            FROM flagged WHERE u UNION ALL
          SELECT 'number_wrap', count(*), count(*) FILTER (correct) FROM flagged WHERE n UNION ALL
          SELECT 'any', count(*), count(*) FILTER (correct) FROM flagged WHERE u OR n UNION ALL
          SELECT 'none', count(*), count(*) FILTER (correct) FROM flagged WHERE NOT (u OR n))
          WHERE cases>0""",
    ),
)
def hazard_counts(spark, sf):
    from lumenota.functions import invoice as inv

    run = graded_run(spark, sf)
    flags = run.items.filter(C("t").isNotNull()).groupBy("case_id").agg(
        F.bool_or(inv.unit_wraps(C("t.unit"), unicode=False)).alias("u"),
        F.bool_or(inv.number_wraps(C("t.unit_price"), C("t.total"))).alias("n"),
    )
    hazards = flags.select("case_id", inv.hazard_names(C("u"), C("n")).alias("render_hazards"))
    return m.hazard_counts(graded_cases(run).join(hazards, "case_id", "left"))


_COUNTERS = ("true_rows", "predicted_rows", "matched", "rows_all_correct") + tuple(
    f"correct_{name}" for name in g.ITEM_COLUMNS
)
_SUMS = ", ".join(f"sum({name})::BIGINT AS {name}" for name in _COUNTERS)
METRICS_SQL = f"""SELECT {{keys}}{", ".join(_COUNTERS)},
  {rate_sql("matched", "predicted_rows")} AS precision, {rate_sql("matched", "true_rows")} AS recall,
  {rate_sql("(2*matched)", "(predicted_rows+true_rows)")} AS f1,
  {rate_sql("rows_all_correct", "true_rows")} AS all_values_correct,
  {", ".join(f"{rate_sql(f'correct_{x}', 'matched')} AS rate_{x}" for x in g.ITEM_COLUMNS)}
  FROM (SELECT {{keys}}{_SUMS} FROM {{source}} GROUP BY ALL)"""


@query(
    "a09_row_metrics",
    q.with_ctes(
        q.CASES, q.LINKS, STATS_SQL,
        select=METRICS_SQL.format(
            keys="split, ", source="(SELECT stats.*, split FROM stats JOIN cases USING (case_id))"
        ),
    ),
)
def row_metrics(spark, sf):
    stats = link_stats(b.item_links(spark, sf, positions=False))
    cases = b.case_metadata(spark, sf).select("case_id", "split")
    return m.row_metrics(stats.join(cases, "case_id"), "item", ("split",))


_RATIOS = m.row_ratios("item")


def _draws_sql(units: str) -> str:
    """How often (``w``) each of ``units`` (base_case) stands in each resample."""
    draw = f"""((('0x'||substr(md5('{m.BOOTSTRAP_SEED}:'||base_case),1,{m.UNIT_DIGITS}))::BIGINT
      + (resample*{m.RESAMPLE_STEP})%{m.PRIME})%{m.PRIME})"""
    rounds, source = [], f"(SELECT base_case, resample, {draw} AS x FROM {units}, (SELECT unnest(range(0,{m.RESAMPLES})) AS resample))"
    for constant in m.ROUNDS:
        source = f"(SELECT base_case, resample, (x*(x+{constant}))%{m.PRIME} AS x FROM {source})"
    weight = "+".join(f"(x>={t})::BIGINT" for t in m.poisson_thresholds())
    return f"SELECT base_case, resample, {weight} AS w FROM {source}"


_WANTED = sorted({name for pair in _RATIOS.values() for name in pair})
_EXTRA = "2*sum(matched)::BIGINT AS matched_twice, (sum(predicted_rows)+sum(true_rows))::BIGINT AS both_rows"
_VECTORS = f"""vectors AS (SELECT base_case, {_SUMS}, {_EXTRA}
  FROM stats JOIN cases USING (case_id) GROUP BY base_case),
draws AS ({_draws_sql("(SELECT DISTINCT base_case FROM vectors)")}),
sums AS (SELECT resample, {", ".join(f"sum({x}*w)::BIGINT AS {x}" for x in _WANTED)}
  FROM vectors JOIN draws USING (base_case) GROUP BY resample)"""


def _intervals_sql(source: str, keys: str = "", chosen=None) -> str:
    valued = " UNION ALL ".join(
        f"SELECT {keys}'{label}' AS label, {rate_sql(top, bottom)} AS v FROM {source} WHERE {bottom}<>0"
        for label, (top, bottom) in (chosen or _RATIOS).items()
    )
    return f"""SELECT {keys}label, quantile_disc(v,0.025) AS low, quantile_disc(v,0.975) AS high,
      count(*) AS resamples FROM ({valued}) GROUP BY {keys}label"""


def _vectors(spark, sf, by=()):
    stats = link_stats(b.item_links(spark, sf, positions=False))
    cases = b.case_metadata(spark, sf)
    return m.invoice_vectors(stats.join(cases, "case_id"), "item", by)


@query(
    "a10_bootstrap_sums",
    q.with_ctes(q.CASES, q.LINKS, STATS_SQL, _VECTORS, select="SELECT * FROM sums"),
)
def bootstrap_sums(spark, sf):
    return m.bootstrap_sums(_vectors(spark, sf), _WANTED, m.RESAMPLES)


@query(
    "a11_bootstrap_interval",
    q.with_ctes(q.CASES, q.LINKS, STATS_SQL, _VECTORS, select=_intervals_sql("sums")),
)
def bootstrap_interval(spark, sf):
    """Intervals of all row ratios."""
    return m.bootstrap_interval(m.bootstrap_sums(_vectors(spark, sf), _WANTED, m.RESAMPLES), _RATIOS)


_COLUMN_RATIOS = {label: pair for label, pair in _RATIOS.items() if label.startswith("item.")}
_COLUMN_COUNTERS = sorted({name for pair in _COLUMN_RATIOS.values() for name in pair})


@query("a13_scopes", q.with_ctes(*BASE, SCOPED, select="SELECT scope, count(*) AS cases FROM scoped GROUP BY scope"))
def scopes(spark, sf):
    return scoped_cases(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("cases"))


_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT base_case, split, tags, '{field}' AS label, {s._header_right(field)} AS ok FROM headed"
    for field in g.HEADER_FIELDS
)
FIELDS_SQL = f"""headed AS (SELECT heads.*, base_case, split, tags FROM heads JOIN
  (SELECT case_id, base_case, split, tags FROM cases) USING (case_id)),
field_rows AS ({_FIELD_ROWS})"""


def field_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, correct, n, invoices, {rate_sql("correct", "n")} AS rate,
      {wilson_sql("correct", "n", "invoices")} FROM (SELECT {keys}, count(*) FILTER (ok) AS correct,
      count(*) AS n, count(DISTINCT base_case) AS invoices FROM {source} GROUP BY {keys})"""


def _field_cases(spark, sf):
    run = graded_run(spark, sf)
    return run.header.select("case_id", "fields").join(run.cases.drop("status"), "case_id")


@query("a14_field_stats", q.with_ctes(*s.WRONG, FIELDS_SQL, select=field_sql("field_rows", "label")))
def field_stats(spark, sf):
    return m.field_stats(_field_cases(spark, sf))


_COLUMN_ROWS = " UNION ALL ".join(
    f"SELECT 'item.{x}' AS label, correct_{x} AS correct, matched AS n FROM stats"
    for x in g.ITEM_COLUMNS
)


@query(
    "a15_column_stats",
    q.with_ctes(
        q.LINKS, STATS_SQL,
        select=f"""SELECT label, correct, n, {rate_sql("correct", "n")} AS rate FROM (SELECT label,
          sum(correct)::BIGINT AS correct, sum(n)::BIGINT AS n FROM ({_COLUMN_ROWS}) GROUP BY label)""",
    ),
)
def column_stats(spark, sf):
    return m.column_stats(link_stats(b.item_links(spark, sf, positions=False)), "item")


@query(
    "a16_field_by_slice",
    q.with_ctes(
        *s.WRONG, FIELDS_SQL,
        """tagged_rows AS (SELECT base_case, split AS scope, label, ok, unnest(tags) AS t FROM field_rows)""",
        select=field_sql("tagged_rows", "scope, t, label"),
    ),
)
def field_by_slice(spark, sf):
    """Header fields by split and case tag."""
    cases = _field_cases(spark, sf).withColumn("t", F.explode("case_tags"))
    return m.field_stats(cases.withColumnRenamed("split", "scope"), ("scope", "t"))


@query(
    "a17_headline",
    q.with_ctes(
        *BASE, SCOPED,
        """layered AS (SELECT *, unnest(CASE WHEN rendering='text' THEN ['pooled','text']
          WHEN rendering IS NOT NULL THEN ['pooled','image'] ELSE ['pooled'] END) AS layer FROM scoped)""",
        select=correct_sql("layered", "scope, layer"),
    ),
)
def headline(spark, sf):
    return m.headline(scoped_cases(spark, sf))


_TAG_SLICES = [
    ("regime=normal", "regime_normal"), ("regime=simples", "simples_nacional"),
    ("length=short", "short"), ("length=medium", "medium"), ("length=many_items", "many_items"),
    ("multi_page=yes", "multi_page"), ("multi_page=no", "single_page"),
    ("alphanumeric_cnpj=yes", "alphanumeric_cnpj"), ("cpf_recipient=yes", "cpf_recipient"),
    ("st_deferral=yes", "st_deferral"), ("mixed_tax_codes=yes", "mixed_tax_codes"),
    ("long_text=yes", "long_text"), ("confusable=yes", "confusable"),
]
_SLICE_SQL = ",".join(
    [f"CASE WHEN list_contains(tags,'{tag}') THEN '{name}' END" for name, tag in _TAG_SLICES]
    + ["CASE WHEN barcode_readable THEN 'barcode_readable=yes' ELSE 'barcode_readable=no' END"]
    + ["CASE WHEN severity IS NULL THEN 'rendering='||rendering ELSE 'rendering='||rendering||'/'||severity END"]
)
SLICED = f"""sliced AS (SELECT *, unnest(list_filter([{_SLICE_SQL}], lambda x: x IS NOT NULL)) AS slice_id
  FROM scoped)"""
_ALL_SLICES = "[" + ",".join(f"'{name}'" for name in m.SLICE_IDS) + "]"


@query(
    "a12_column_intervals",
    q.with_ctes(
        q.CASES, q.LINKS, STATS_SQL,
        f"""sliced AS (SELECT case_id, base_case, unnest(list_filter([{_SLICE_SQL}],
          lambda x: x IS NOT NULL)) AS slice_id FROM cases)""",
        f"""vectors AS (SELECT slice_id, base_case, {", ".join(f"sum({x})::BIGINT AS {x}" for x in _COLUMN_COUNTERS)}
          FROM stats JOIN sliced USING (case_id) GROUP BY slice_id, base_case)""",
        f"draws AS ({_draws_sql('(SELECT DISTINCT base_case FROM vectors)')})",
        f"""sums AS (SELECT slice_id, resample, {", ".join(f"sum({x}*w)::BIGINT AS {x}" for x in _COLUMN_COUNTERS)}
          FROM vectors JOIN draws USING (base_case) GROUP BY slice_id, resample)""",
        select=_intervals_sql("sums", "slice_id, ", _COLUMN_RATIOS),
    ),
)
def column_intervals(spark, sf):
    """Per slice an interval for every item column, all columns from one draw."""
    stats = link_stats(b.item_links(spark, sf, positions=False))
    sliced = m.with_slices(stats.join(b.case_metadata(spark, sf), "case_id"))
    vectors = m.invoice_vectors(sliced, "item", ("slice_id",))
    sums = m.bootstrap_sums(vectors, _COLUMN_COUNTERS, m.RESAMPLES, by=("slice_id",))
    return m.bootstrap_interval(sums, _COLUMN_RATIOS, ("slice_id",))


@query(
    "a18_slice_rates",
    q.with_ctes(
        *BASE, SCOPED, SLICED,
        select=f"""SELECT scope, slice_id, coalesce(cases,0) AS cases, coalesce(invoices,0) AS invoices,
          coalesce(excluded,0) AS excluded, coalesce(correct,0) AS correct, rate, low, high FROM
          (SELECT DISTINCT scope, unnest({_ALL_SLICES}) AS slice_id FROM scoped) LEFT JOIN
          ({correct_sql("sliced", "scope, slice_id")}) USING (scope, slice_id)""",
    ),
)
def slice_rates(spark, sf):
    return m.slice_rates(scoped_cases(spark, sf))


@query(
    "j18_case_slices",
    q.with_ctes(*BASE, SCOPED, SLICED, select="SELECT case_id, slice_id FROM sliced WHERE scope='overall'"),
)
def case_slices(spark, sf):
    return m.with_slices(b.case_metadata(spark, sf)).select("case_id", "slice_id")


@query(
    "a19_latency_summary",
    """SELECT event_type, min(c)::BIGINT AS least, quantile_disc(c,0.5)::BIGINT AS p50,
      quantile_disc(c,0.95)::BIGINT AS p95, max(c)::BIGINT AS greatest, count(*) AS n
      FROM (SELECT event_type, CAST(round(value*100) AS BIGINT) AS c FROM events) GROUP BY event_type""",
)
def latency_summary(spark, sf):
    events = b.table(spark, sf, "events").select(
        "event_type", F.round(C("value") * 100).cast("bigint").alias("latency_ms")
    )
    return m.latency_summary(events, by=("event_type",))


EVENTS_SQL = """answers AS (SELECT event_id, user_id, ts, event_type, CAST(round(value*100) AS BIGINT) AS c,
  CAST(regexp_extract(props,'[0-9]+') AS BIGINT) AS k,
  CASE event_type WHEN 'error' THEN 'infrastructure_failure' WHEN 'signup' THEN 'harness_error'
    ELSE 'success' END AS status FROM events)"""


@query(
    "a20_usage_totals",
    q.with_ctes(
        EVENTS_SQL,
        select="""SELECT user_id, sum(CASE WHEN status='success' THEN k*100 ELSE 0 END)::BIGINT AS input_tokens,
          sum(CASE WHEN status='success' THEN k*10 ELSE 0 END)::BIGINT AS output_tokens,
          sum(CASE WHEN status='success' THEN k ELSE 0 END)::BIGINT AS cache_read_tokens,
          0::BIGINT AS cache_write_5m_tokens,
          sum(CASE WHEN status='success' THEN k//2 ELSE 0 END)::BIGINT AS cache_write_1h_tokens,
          sum(CASE WHEN status='success' THEN c ELSE 0 END)/100 AS cost_usd,
          sum(CASE WHEN status='success' AND c>=500 THEN c ELSE 0 END)/100 AS incurred_cost_usd,
          count(*) FILTER (status='infrastructure_failure') AS unpriced_cases,
          count(*) FILTER (status='infrastructure_failure') AS unpriced_incurred_cases
          FROM answers GROUP BY user_id""",
    ),
)
def usage_totals(spark, sf):
    return m.usage_totals(answered_events(spark, sf), ("user_id",))


@query(
    "a21_cache_hit_rate",
    q.with_ctes(
        EVENTS_SQL,
        """counts AS (SELECT user_id, count(*) FILTER (status='success' AND c<500) AS hits,
          count(*) FILTER (status='success') AS answered_attempts FROM answers GROUP BY user_id)""",
        select=f"SELECT *, {rate_sql('hits', 'answered_attempts')} AS hit_rate FROM counts",
    ),
)
def cache_hit_rate(spark, sf):
    return m.cache_hit_rate(answered_events(spark, sf), ("user_id",))


@query(
    "a22_within_cent_counts",
    q.with_ctes(
        *BASE,
        select="""SELECT sum(cent_count)::BIGINT AS cent_values,
          count(*) FILTER (wrong_count>0 AND cent_count=wrong_count) AS cent_cases FROM graded""",
    ),
)
def within_cent_counts(spark, sf):
    return m.within_cent_counts(_cases(spark, sf))


@query(
    "a23_rule_counts",
    q.with_ctes(
        EVENTS_SQL,
        select="""SELECT event_type AS rule_id, count(DISTINCT user_id) AS cases FROM answers
          GROUP BY event_type""",
    ),
)
def rule_counts(spark, sf):
    events = answered_events(spark, sf)
    severity = F.when(C("event_type") == "view", "warning").otherwise("error")
    findings = events.select(
        C("user_id").alias("case_id"), C("event_type").alias("rule_id"), severity.alias("severity")
    )
    return m.rule_counts(events, findings)[1]


@query(
    "a23_caught_and_warned",
    q.with_ctes(
        EVENTS_SQL,
        select="""SELECT 0::BIGINT AS caught, count(DISTINCT user_id) FILTER (event_type='view')
          AS with_warnings FROM answers""",
    ),
)
def caught_and_warned(spark, sf):
    events = answered_events(spark, sf)
    severity = F.when(C("event_type") == "view", "warning").otherwise("error")
    findings = events.select(
        C("user_id").alias("case_id"), C("event_type").alias("rule_id"), severity.alias("severity")
    )
    return m.rule_counts(events, findings)[0]


@query(
    "a24_attempt_totals",
    """SELECT sum(n)::BIGINT AS total, count(*) FILTER (ok AND n>1) AS repaired, max(n) AS most FROM
      (SELECT conv_id, count(*) AS n, bool_or(role='assistant') AS ok FROM conversations GROUP BY conv_id)""",
)
def attempt_totals(spark, sf):
    turns = b.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.bool_or(C("role") == "assistant").alias("ok"),
    )
    status = F.when(C("ok"), "success").otherwise("refused")
    return m.attempt_totals(turns.withColumn("status", status))


@query(
    "a25_config_values",
    """SELECT 'lang' AS setting, string_agg(v, ',' ORDER BY v) AS found FROM (SELECT DISTINCT lang AS v
      FROM documents) UNION ALL SELECT 'source', string_agg(v, ',' ORDER BY v) FROM
      (SELECT DISTINCT source AS v FROM documents)""",
)
def config_values(spark, sf):
    return m.config_values(b.table(spark, sf, "documents"), ("lang", "source"))


@query(
    "a26_schema_validity",
    q.with_ctes(
        q.CASES,
        select="""SELECT 'strict' AS "check", count(*) FILTER (status<>'schema_invalid') AS correct,
          count(*) AS n FROM cases WHERE status IN ('success','validation_failed','schema_invalid')
          UNION ALL SELECT 'loose', count(*), count(*) FROM cases
          WHERE status IN ('success','validation_failed','schema_invalid')""",
    ),
)
def schema_validity(spark, sf):
    cases = b.case_metadata(spark, sf).withColumns(
        {"strict": C("status") != "schema_invalid", "loose": F.lit(True)}
    )
    return m.schema_validity(cases, ("strict", "loose"))


_STATUS_SQL = ", ".join(f"count(*) FILTER (status='{x}') AS n_{x}" for x in g.OUTCOME_STATUSES)


@query(
    "a27_run_summary",
    q.with_ctes(
        *BASE,
        f"one AS ({correct_sql('graded')})",
        f"quiet AS ({silent_sql('graded')})",
        select=f"""SELECT one.cases AS correct_cases, one.invoices AS correct_invoices,
          one.excluded AS correct_excluded, one.correct AS correct_correct, one.rate AS correct_rate,
          one.low AS correct_low, one.high AS correct_high, quiet.success_cases AS silent_success_cases,
          quiet.silent AS silent_silent, quiet.rate AS silent_rate,
          quiet.payment_cases AS silent_payment_cases, quiet.other_cases AS silent_other_cases, t.*
          FROM one, quiet, (SELECT sum(cent_count)::BIGINT AS cent_values,
          count(*) FILTER (wrong_count>0 AND cent_count=wrong_count) AS cent_cases,
          {_STATUS_SQL}, count(*) AS total FROM graded) t""",
    ),
)
def run_summary(spark, sf):
    return m.run_summary(_cases(spark, sf))


# --- comparison -------------------------------------------------------------------------------

SECOND = """second_wrong AS (
  SELECT case_id, path, col, ordinal, row, prow FROM wrong JOIN (SELECT case_id, split FROM cases) c
    USING (case_id) WHERE NOT (scope='header' AND split='dev')
  UNION ALL SELECT case_id, 'issuer.uf', 'checked', 0, NULL, NULL FROM cases JOIN gcase USING (case_id)
    WHERE rendering='blur'),
second_counts AS (SELECT case_id, count(*) AS wrong_count FROM second_wrong GROUP BY case_id),
second AS (SELECT case_id, status2 AS status, coalesce(wrong_count,0) AS wrong_count,
    CASE WHEN status2 IN ('infrastructure_failure','harness_error') THEN NULL
      ELSE status2='success' AND coalesce(wrong_count,0)=0 END AS correct
  FROM (SELECT case_id, CASE WHEN status='refused' AND split='dev' THEN 'truncated'
      WHEN status='truncated' AND split='test' THEN 'success' ELSE status END AS status2 FROM cases)
  LEFT JOIN second_counts USING (case_id)),
paired AS (SELECT coalesce(a.case_id,b.case_id) AS case_id, a.status AS first_status,
  a.correct AS first_correct, a.wrong_count AS first_wrong_count, b.status AS second_status,
  b.correct AS second_correct, b.wrong_count AS second_wrong_count
  FROM graded a FULL OUTER JOIN second b ON a.case_id=b.case_id)"""


def _second_wrong(run):
    split = run.cases.select("case_id", "split")
    fixed = (C("scope") == "header") & (C("split") == "dev")
    kept = run.wrong.join(split, "case_id").filter(~fixed)
    shape = ("case_id", "path", "column", "ordinal", "row", "predicted_row")
    graded = run.cases.filter(C("status").isin(*g.GRADED_STATUSES) & (C("rendering") == "blur"))
    nothing = F.lit(None).cast("int")
    added = graded.select(
        "case_id", F.lit("issuer.uf").alias("path"), F.lit("checked").alias("column"),
        F.lit(0).alias("ordinal"), nothing.alias("row"), nothing.alias("predicted_row"),
    )
    return kept.select(*shape).unionByName(added)


def _second_cases(run):
    status = (
        F.when((C("status") == "refused") & (C("split") == "dev"), "truncated")
        .when((C("status") == "truncated") & (C("split") == "test"), "success")
        .otherwise(C("status"))
    )
    cases = run.cases.withColumn("status", status)
    counts = _second_wrong(run).groupBy("case_id").agg(F.count(F.lit(1)).alias("wrong_count"))
    joined = cases.join(counts, "case_id", "left").withColumn(
        "wrong_count", F.coalesce("wrong_count", F.lit(0))
    )
    return joined.withColumn("correct", g.verdict(C("status"), C("wrong_count")))


def _paired(spark, sf):
    run = graded_run(spark, sf)
    return cmp.pair_cases(graded_cases(run), _second_cases(run))


@query(
    "c01_check_comparable",
    """SELECT 'manifest_sha256' AS what, a AS first, b AS second FROM (SELECT (SELECT max(lang) FROM
      documents) AS a, (SELECT max(c_mktsegment) FROM customer) AS b) WHERE a<>b""",
)
def comparable_problems(spark, sf):
    """Two run headers that differ in their manifest but not in grader or tolerance."""
    first = b.table(spark, sf, "documents").agg(
        F.max("lang").alias("manifest_sha256"),
        F.lit("grader-1").alias("grader_version"),
        F.lit("0").alias("tolerance"),
    )
    second = b.table(spark, sf, "customer").agg(
        F.max("c_mktsegment").alias("manifest_sha256"),
        F.lit("grader-1").alias("grader_version"),
        F.lit("0.00").alias("tolerance"),
    )
    return cmp.comparable_problems(first, second)


@query(
    "c01_duplicate_cases",
    "SELECT l_orderkey AS case_id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*)>1",
)
def duplicate_cases(spark, sf):
    return cmp.duplicate_cases(
        b.table(spark, sf, "lineitem").select(C("l_orderkey").alias("case_id"))
    )


@query(
    "c02_flips",
    q.with_ctes(
        *BASE, SECOND,
        """before AS (SELECT case_id, path, first(col ORDER BY ordinal, row, prow) AS tag FROM wrong
          GROUP BY ALL), after AS (SELECT case_id, path, first(col ORDER BY ordinal, row, prow) AS tag
          FROM second_wrong GROUP BY ALL)""",
        select="""SELECT case_id, path, tag, 'became_right' AS change FROM before
          ANTI JOIN after USING (case_id, path) UNION ALL
          SELECT case_id, path, tag, 'became_wrong' FROM after ANTI JOIN before USING (case_id, path)""",
    ),
)
def flips(spark, sf):
    run = graded_run(spark, sf)
    before = run.wrong.withColumn("tag", C("column"))
    return cmp.flips(before, _second_wrong(run).withColumn("tag", C("column")))


CLASSIFIED = """classified AS (SELECT *, CASE WHEN first_correct IS NULL OR second_correct IS NULL
  THEN 'not_comparable' WHEN first_correct AND NOT second_correct THEN 'regressed'
  WHEN NOT first_correct AND second_correct THEN 'improved'
  WHEN NOT first_correct AND NOT second_correct THEN
    CASE WHEN first_status IN ('success','validation_failed','schema_invalid') AND second_status IN
      ('success','validation_failed','schema_invalid') THEN
      CASE WHEN second_wrong_count>first_wrong_count THEN 'worsened'
           WHEN second_wrong_count<first_wrong_count THEN 'improved' END
    WHEN first_status<>second_status THEN 'status_changed' END END AS change FROM paired)"""


@query(
    "c03_classify",
    q.with_ctes(*BASE, SECOND, CLASSIFIED, select="SELECT case_id, change FROM classified"),
)
def classify(spark, sf):
    return cmp.classify(_paired(spark, sf)).select("case_id", "change")


@query(
    "j05_run_to_run",
    q.with_ctes(
        *BASE, SECOND,
        select="SELECT case_id, true AS in_first, true AS in_second, first_status, second_status FROM paired",
    ),
)
def run_to_run(spark, sf):
    return _paired(spark, sf).select(
        "case_id", "in_first", "in_second", "first_status", "second_status"
    )


PAIRED_DOCS = """judged AS (SELECT lang, source, quality=1 AS truth, n_chars>1500 AS one, n_chars>900 AS two
  FROM documents JOIN labels USING (doc_id)),
paired_docs AS (SELECT lang, source, one=truth AS first_correct, two=truth AS second_correct FROM judged)"""
_P = """CASE WHEN b+c=0 THEN 1.0 ELSE least(1.0, exp(ln(2.0)+ln(list_sum(list_transform(
  range(0, least(b,c)::BIGINT+1), lambda i: exp(lgamma(b+c+1)-lgamma(i+1)-lgamma(b+c-i+1)-(b+c)*ln(2.0)))))))
  END"""


@query(
    "c04_mcnemar_exact",
    q.with_ctes(
        PAIRED_DOCS,
        """counts AS (SELECT source, count(*) FILTER (first_correct AND NOT second_correct) AS b,
          count(*) FILTER (second_correct AND NOT first_correct) AS c FROM paired_docs GROUP BY source)""",
        select=f"SELECT source, b, c, round({_P},6) AS p_value, {_P}<0.05 AS significant FROM counts",
    ),
)
def mcnemar_exact(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    pairs = _document_pairs(docs, labels)
    counts = pairs.groupBy("source").agg(
        F.count_if(C("first_correct") & ~C("second_correct")).alias("b"),
        F.count_if(C("second_correct") & ~C("first_correct")).alias("c"),
    )
    tested = cmp.mcnemar(counts)
    return tested.select(
        "source", "b", "c", F.round("p_value", 6).alias("p_value"), "significant"
    )


def _document_pairs(docs, labels):
    truth = C("quality") == 1
    return docs.join(labels, "doc_id").select(
        "lang",
        "source",
        ((C("n_chars") > 1500) == truth).alias("first_correct"),
        ((C("n_chars") > 900) == truth).alias("second_correct"),
    )


@query(
    "c05_verdict",
    q.with_ctes(
        *BASE, SECOND,
        """chosen AS (SELECT 'test text' AS label, count(*) AS cases,
          count(*) FILTER (first_correct AND NOT second_correct) AS b,
          count(*) FILTER (second_correct AND NOT first_correct) AS c FROM paired JOIN
          (SELECT case_id, split, rendering FROM cases) USING (case_id) WHERE rendering='text'
          AND split='test' AND first_correct IS NOT NULL AND second_correct IS NOT NULL)""",
        select=f"""SELECT label, cases, b, c, CASE WHEN b+c=0 THEN 'no change' WHEN {_P}<0.05
          THEN 'significant' ELSE 'inconclusive' END AS verdict FROM chosen""",
    ),
)
def verdict(spark, sf):
    run = graded_run(spark, sf)
    found = cmp.run_verdict(_paired(spark, sf), run.cases)
    return found.select("label", "cases", "b", "c", "verdict")


@query(
    "c05_verdict_by_language",
    q.with_ctes(
        PAIRED_DOCS,
        """counts AS (SELECT lang, count(*) AS cases, count(*) FILTER (first_correct AND NOT second_correct)
          AS b, count(*) FILTER (second_correct AND NOT first_correct) AS c FROM paired_docs GROUP BY lang)""",
        select=f"""SELECT lang, cases, b, c, CASE WHEN b+c=0 THEN 'no change' WHEN {_P}<0.05
          THEN 'significant' ELSE 'inconclusive' END AS verdict FROM counts""",
    ),
)
def verdict_by_language(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    found = cmp.paired_verdict(_document_pairs(docs, labels), ("lang",))
    return found.select("lang", "cases", "b", "c", "verdict")


@query(
    "c06_config_changes",
    """SELECT 'lang' AS setting, a AS first, b AS second FROM (SELECT
      (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT lang AS v FROM documents)) AS a,
      (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT lang AS v FROM documents JOIN labels
        USING (doc_id) WHERE toxic=1)) AS b) WHERE a IS DISTINCT FROM b
      UNION ALL SELECT 'source', a, b FROM (SELECT
      (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT source AS v FROM documents)) AS a,
      (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT source AS v FROM documents JOIN labels
        USING (doc_id) WHERE toxic=1)) AS b) WHERE a IS DISTINCT FROM b""",
)
def config_changes(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id")
    return cmp.config_changes(
        m.config_values(docs, ("lang", "source")), m.config_values(toxic, ("lang", "source"))
    )


# A second run that reads every value of each third case right, where it reads it at all.
_BETTER = "case_id%3=0"
_PART_RIGHT = {
    "number": "true", "due_date": "t_due=p_due", "amount": "t_amount=p_amount",
}


def _deltas_sql() -> str:
    def counted(label: str, right: str, source: str, better: str = _BETTER) -> str:
        return f"""SELECT '{label}' AS label, count(*) FILTER ({right}) AS first_correct, count(*) AS first_n,
          count(*) FILTER (({right}) OR ({better})) AS second_correct, count(*) AS second_n FROM {source}"""

    usable = "JOIN (SELECT case_id FROM gcase WHERE status<>'schema_invalid') USING (case_id)"
    read = f"{_BETTER} AND NOT broken"
    rows = [counted(field, s._header_right(field), "heads", read) for field in g.HEADER_FIELDS]
    both = f"(SELECT * FROM links {usable} WHERE has_t AND has_p)"
    rows += [counted(f"item.{c}", s.item_right(c), both) for c in g.ITEM_COLUMNS]
    both = f"(SELECT inst.* FROM inst {usable} WHERE has_p)"
    rows += [counted(f"installment.{c}", _PART_RIGHT[c], both) for c in g.INSTALLMENT_COLUMNS]
    return f"""SELECT *, second_correct-first_correct AS delta FROM ({" UNION ALL ".join(rows)})"""


@query("c07_field_deltas", q.with_ctes(*s.WRONG, select=_deltas_sql()))
def field_deltas(spark, sf):
    """Counts of every header field, item column and installment column of two runs."""
    run = graded_run(spark, sf)
    better = C("case_id") % 3 == 0

    def counts(improve):
        again = F.when(C("p").isNotNull() & better, C("t")).otherwise(C("p"))
        redone = lambda df: df.withColumn("p", again) if improve else df
        both = C("t").isNotNull() & C("p").isNotNull()
        found = None
        for kind, linked, columns in (
            ("item", run.linked, g.ITEM_COLUMNS),
            ("installment", run.parts, g.INSTALLMENT_COLUMNS),
        ):
            graded = g.grade_pairs(redone(linked.filter(both).select("case_id", "row", "t", "p")), kind)
            stats = graded.agg(
                F.count(F.lit(1)).alias("matched"),
                *[F.count_if(C(f"right_{c}")).alias(f"correct_{c}") for c in columns],
            )
            listed = m.column_stats(stats, kind).select("label", "correct", "n")
            found = listed if found is None else found.unionByName(listed)
        heads = g.grade_header(redone(run.header.select("case_id", "status", "t", "p", "crossover")))
        heads = heads.withColumn("base_case", C("case_id"))
        return found.unionByName(m.field_stats(heads).select("label", "correct", "n"))

    return cmp.field_deltas(counts(False), counts(True))


@query(
    "c08_run_state",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'completeness not recorded' WHEN 'click' THEN
      'complete' WHEN 'error' THEN 'incomplete, stopped: cost_cap' ELSE 'incomplete' END AS state_text
      FROM events""",
)
def run_state(spark, sf):
    kind = C("event_type")
    states = b.table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", F.lit(False)).when(kind != "view", F.lit(True)).alias("incomplete"),
        F.when(kind == "error", "cost_cap").alias("stopped_reason"),
    )
    return cmp.run_state(states).select("event_id", "state_text")
