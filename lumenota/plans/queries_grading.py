"""Registered queries of joins, grading and failure tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenota.operators import grading as g
from lumenota.operators import matching as m
from lumenota.operators import tags
from lumenota.plans import bindings as b
from lumenota.plans import graded_sql as s
from lumenota.plans import oracle_sql as q
from lumenota.plans.graded import graded_cases, graded_run, tagged_wrong
from lumenota.plans.registry import query
from lumenota.session import stored

C = F.col
WRONG_OUT = """case_id, path, scope, col AS "column", row AS true_row, prow AS predicted_row, event,
  expected, predicted, within_cent, payment"""


def wrong_out(df):
    return df.select(
        "case_id", "path", "scope", "column", C("row").alias("true_row"), "predicted_row", "event",
        "expected", "predicted", "within_cent", "payment",
    )


_FLAGS = ", ".join(
    f"{s._header_right(field)} AS {field.replace('.', '__')}" for field in g.HEADER_FIELDS
)


@query(
    "g01_grade_header",
    q.with_ctes(*s.WRONG, select=f"SELECT case_id, {_FLAGS} FROM heads"),
)
def grade_header(spark, sf):
    return graded_run(spark, sf).header.select("case_id", "fields.*")


@query("g02_header_wrong", q.with_ctes(*s.WRONG, select=f"SELECT {WRONG_OUT} FROM wrong WHERE scope='header'"))
def header_wrong(spark, sf):
    return wrong_out(g.header_wrong(graded_run(spark, sf).header))


_ITEM_TABLES = (q.CASES, q.LINKS)


@query(
    "g03_grade_rows",
    q.with_ctes(
        *s.WRONG, select=f"SELECT {WRONG_OUT} FROM wrong WHERE scope='item' AND event IS NULL"
    ),
)
def grade_rows(spark, sf):
    """Every column of every matched pair graded; a linked row carries both sides already."""
    both = C("t").isNotNull() & C("p").isNotNull()
    paired = graded_run(spark, sf).linked.filter(both).withColumn("predicted_row", C("row"))
    return wrong_out(g.pair_wrong(paired, "item"))


@query(
    "g04_row_events",
    q.with_ctes(
        q.LINKS,
        select=f"""SELECT case_id, 'items['||pos||'].total' AS path, 'missing' AS event,
          {q.fixed("t_total", 2)} AS expected, CAST(NULL AS VARCHAR) AS predicted FROM links
          WHERE has_t AND NOT has_p UNION ALL SELECT case_id, 'items[+'||pos||'].total', 'extra', NULL,
          {q.fixed("p_total", 2)} FROM links WHERE has_p AND NOT has_t""",
    ),
)
def row_events(spark, sf):
    links = b.item_links(spark, sf)
    missing, extra = g.unmatched_rows(
        b.true_items(links), b.answered_items(links), b.given_pairs(links)
    )
    found = g.row_events(missing, extra, "item")
    return found.select("case_id", "path", "event", "expected", "predicted")


_STATS = ", ".join(
    f"count(*) FILTER (has_t AND has_p AND {s.item_right(c)}) AS correct_{c}"
    for c in g.ITEM_COLUMNS
)
_ALL = " AND ".join(s.item_right(c) for c in g.ITEM_COLUMNS)
STATS_SQL = f"""stats AS (SELECT case_id, count(*) FILTER (has_t) AS true_rows,
  count(*) FILTER (has_p) AS predicted_rows, count(*) FILTER (has_t AND has_p) AS matched,
  count(*) FILTER (has_t AND has_p AND {_ALL}) AS rows_all_correct, {_STATS}
  FROM links GROUP BY case_id)"""


def link_stats(links):
    """Row statistics straight from links: one pre-aggregated grouping, no join."""
    graded = g.grade_pairs(links, "item")
    both = C("t").isNotNull() & C("p").isNotNull()
    all_right = both
    for column in g.ITEM_COLUMNS:
        all_right = all_right & C(f"right_{column}")
    return graded.groupBy("case_id").agg(
        F.count_if(C("t").isNotNull()).alias("true_rows"),
        F.count_if(C("p").isNotNull()).alias("predicted_rows"),
        F.count_if(both).alias("matched"),
        F.count_if(all_right).alias("rows_all_correct"),
        *[
            F.count_if(both & C(f"right_{column}")).alias(f"correct_{column}")
            for column in g.ITEM_COLUMNS
        ],
    )


@query("g05_row_stats", q.with_ctes(q.LINKS, STATS_SQL, select="SELECT * FROM stats"))
def row_stats(spark, sf):
    return link_stats(b.item_links(spark, sf, positions=False))


@query(
    "g06_order_preserved",
    q.with_ctes(
        q.LINKS,
        """placed AS (SELECT case_id, pos AS row, CASE WHEN f BETWEEN 60 AND 62 THEN -pos ELSE pos END
          AS prow FROM links WHERE has_t AND has_p),
        stepped AS (SELECT *, lag(row) OVER (PARTITION BY case_id ORDER BY prow) AS before FROM placed)""",
        select="""SELECT case_id, bool_and(coalesce(before<row,true)) AS order_preserved,
          count(*) AS matched FROM stepped GROUP BY case_id""",
    ).replace("has_t, has_p,", "has_t, has_p, f,", 1),
)
def order_preserved(spark, sf):
    """Pairs whose answered place is turned round for some tax and discount values."""
    links = b.item_links(spark, sf)
    f = (C("t.icms_rate") * 11 + C("t.ipi_rate")).cast("int")
    place = F.when(f.between(60, 62), -C("pos")).otherwise(C("pos"))
    both = C("t").isNotNull() & C("p").isNotNull()
    pairs = links.filter(both).select(
        "case_id", C("pos").alias("row"), place.alias("predicted_row")
    )
    return g.order_preserved(pairs)


@query(
    "g07_payment_flag",
    q.with_ctes(
        *s.WRONG,
        select="""SELECT scope, payment, count(*) AS n FROM wrong GROUP BY ALL""",
    ),
)
def payment_flag(spark, sf):
    return graded_run(spark, sf).wrong.groupBy("scope", "payment").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "g08_graded_status",
    """SELECT event_id, CASE WHEN event_type<>'error' AND event_type IN ('view') THEN 'success'
      WHEN event_type='click' THEN 'refused' ELSE 'harness_error' END AS status FROM events""",
)
def graded_status(spark, sf):
    kind = C("event_type")
    record = F.when(kind == "error", "harness_error").otherwise("completed")
    outcome = F.when(kind == "view", "success").when(kind == "click", "refused").otherwise(kind)
    return b.table(spark, sf, "events").select(
        "event_id", g.graded_status(record, outcome).alias("status")
    )


@query(
    "g09_verdict",
    q.with_ctes(
        *s.WRONG, s.GRADED, select="SELECT case_id, status, wrong_count, correct FROM graded"
    ),
)
def verdict(spark, sf):
    return graded_cases(graded_run(spark, sf)).select(
        "case_id", "status", "wrong_count", "correct"
    )


@query(
    "g10_schema_invalid",
    q.with_ctes(
        *s.WRONG,
        select="""SELECT case_id, count(*) AS wrong_count, count(*) FILTER (event='missing') AS missing,
          count(*) FILTER (predicted IS NOT NULL) AS with_value
          FROM wrong JOIN gcase USING (case_id) WHERE broken GROUP BY case_id""",
    ),
)
def schema_invalid(spark, sf):
    run = graded_run(spark, sf)
    broken = run.cases.filter(C("status") == "schema_invalid").select("case_id")
    return run.wrong.join(broken, "case_id", "left_semi").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("wrong_count"),
        F.count_if(C("event") == "missing").alias("missing"),
        F.count_if(C("predicted").isNotNull()).alias("with_value"),
    )


@query(
    "g11_total_delta",
    q.with_ctes(
        *s.WRONG,
        select="""SELECT case_id, CASE WHEN NOT broken THEN (p_invoice_total-t_invoice_total)/100 END
          AS total_delta FROM heads""",
    ),
)
def total_delta(spark, sf):
    head = graded_run(spark, sf).header
    return head.select(
        "case_id",
        (C("p.totals.invoice_total") - C("t.totals.invoice_total")).alias("total_delta"),
    )


@query(
    "g15_grade_cases",
    q.with_ctes(
        *s.WRONG,
        s.GRADED,
        select="""SELECT case_id, base_case, split, rendering, severity, status, wrong_count, cent_count,
          payment, correct FROM graded""",
    ),
)
def grade_cases(spark, sf):
    return graded_cases(graded_run(spark, sf)).select(
        "case_id", "base_case", "split", "rendering", "severity", "status", "wrong_count",
        "cent_count", "payment", "correct",
    )


# --- joins ------------------------------------------------------------------------------------


@query(
    "j01_records_to_truth",
    q.with_ctes(
        *s.WRONG,
        select="""SELECT case_id, status, t_invoice_total/100 AS true_total FROM heads""",
    ),
)
def records_to_truth(spark, sf):
    run = graded_run(spark, sf)
    return run.header.select(
        "case_id", "status", C("t.totals.invoice_total").alias("true_total")
    )


@query(
    "j02_records_to_metadata",
    """SELECT o_orderkey AS case_id, coalesce(CAST(d.doc_id AS VARCHAR), CAST(o_orderkey AS VARCHAR))
      AS base_case, d.lang FROM orders LEFT JOIN documents d ON o_orderkey=d.doc_id""",
)
def records_to_metadata(spark, sf):
    records = b.table(spark, sf, "orders").select(C("o_orderkey").alias("case_id"))
    metadata = b.table(spark, sf, "documents").select(
        C("doc_id").alias("case_id"), C("doc_id").cast("string").alias("base_case"), "lang"
    )
    return g.with_meta(records, metadata)


@query(
    "j04_cases_not_run",
    "SELECT doc_id AS case_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def cases_not_run(spark, sf):
    selected = b.table(spark, sf, "documents").select(C("doc_id").alias("case_id"))
    records = b.table(spark, sf, "labels").select(C("doc_id").alias("case_id"))
    return g.cases_not_run(selected, records)


@query(
    "j08_unmatched_rows",
    q.with_ctes(
        q.LINKS,
        select="""SELECT case_id, pos, CASE WHEN has_t THEN 'missing' ELSE 'extra' END AS side
          FROM links WHERE has_t<>has_p""",
    ),
)
def unmatched_rows(spark, sf):
    links = b.item_links(spark, sf)
    missing, extra = g.unmatched_rows(
        b.true_items(links), b.answered_items(links), b.given_pairs(links)
    )
    return missing.select("case_id", C("row").alias("pos"), F.lit("missing").alias("side")).unionByName(
        extra.select("case_id", C("row").alias("pos"), F.lit("extra").alias("side"))
    )


_FACT_SQL = (*s.WRONG, s.TAGGED)


def _moved(spark, sf, fact, cell_kind, side):
    """Cells and row events of one kind of moved amounts."""
    moved = tags.moved_rows(graded_run(spark, sf).linked).filter(C("fact") == fact)
    cells = moved.filter(C("kind") == cell_kind).select(
        "case_id", C("line").alias("pos"), "column", F.lit("cell").alias("side")
    )
    rows = moved.filter(C("kind") != cell_kind).select("case_id", C("line").alias("pos")).distinct()
    return cells.unionByName(
        rows.select("case_id", "pos", F.lit("row").alias("column"), F.lit(side).alias("side"))
    )


@query(
    "j11_absorbed_rows",
    q.with_ctes(
        *_FACT_SQL,
        select="""SELECT case_id, pos, col AS "column", 'cell' AS side FROM merged_cells UNION ALL
          SELECT case_id, pos, 'row', 'missing' FROM merged_lost""",
    ),
)
def absorbed_rows(spark, sf):
    return _moved(spark, sf, "merged", "grown", "missing")


@query(
    "j12_split_rows",
    q.with_ctes(
        *_FACT_SQL,
        select="""SELECT case_id, pos, col AS "column", 'cell' AS side FROM split_cells UNION ALL
          SELECT case_id, pos, 'row', 'extra' FROM split_gained""",
    ),
)
def split_rows(spark, sf):
    return _moved(spark, sf, "split", "shrunk", "extra")


@query(
    "j13_value_of_other_row",
    q.with_ctes(*_FACT_SQL, select='SELECT case_id, pos, col AS "column" FROM copied'),
)
def value_of_other_row(spark, sf):
    run = graded_run(spark, sf)
    copied = tags.values_from_other_rows(run.wrong, run.truth)
    cells = run.wrong.filter((C("scope") == "item") & C("event").isNull())
    keyed = cells.withColumns(
        {
            "crossover": F.lit(False),
            "match_value": tags._match_value(C("column"), C("predicted")),
        }
    )
    hit = keyed.join(copied, ["case_id", "column", "match_value"], "left_semi")
    return hit.select("case_id", C("row").alias("pos"), "column")


@query(
    "j14_value_of_other_box",
    q.with_ctes(
        *s.WRONG, select="SELECT case_id, path FROM wrong WHERE other_box"
    ),
)
def value_of_other_box(spark, sf):
    return graded_run(spark, sf).wrong.filter("other_box").select("case_id", "path")


@query(
    "j15_party_crossover",
    q.with_ctes(*s.WRONG, select="SELECT case_id, crossover FROM crossed"),
)
def party_crossover(spark, sf):
    return graded_run(spark, sf).header.select("case_id", "crossover")


_SCORE = " + ".join(
    f"CASE WHEN coalesce({test},false) THEN {m.ITEM_WEIGHTS[name]} ELSE 0 END"
    for name, test in (
        ("code", f"{s.norm_name('a.p_code')}={s.norm_name('t.t_code')}"),
        ("description", f"{s.norm_name('a.p_description')}={s.norm_name('t.t_description')}"),
        ("ncm", "a.p_ncm=t.t_ncm"),
        ("unit", "a.p_unit=t.t_unit"),
        ("quantity", "a.p_quantity=t.t_quantity"),
        ("unit_price", "a.p_unit_price=t.t_unit_price"),
        ("total", "a.p_total=t.t_total"),
    )
)
CANDIDATES = f"""scored AS (SELECT t.case_id, t.pos AS true_row, a.pos AS predicted_row, ({_SCORE})::BIGINT AS score
  FROM t_items t JOIN p_items a USING (case_id)),
candidates AS (SELECT * FROM scored WHERE score>={m.ITEM_MINIMUM})"""


def _both_sides(spark, sf):
    links = b.item_links(spark, sf)
    return b.true_items(links), b.answered_items(links)


def _stored_sides(spark, sf):
    """Both sides with the identity columns alone, made and written once."""
    kept = [
        F.when(C(side).isNotNull(), F.struct(*[C(f"{side}.{name}") for name in m.ITEM_WEIGHTS]))
        for side in ("t", "p")
    ]
    links = b.item_links(spark, sf).select("case_id", "pos", kept[0].alias("t"), kept[1].alias("p"))
    links = stored(links, "matching-rows")
    return b.true_items(links), b.answered_items(links)


@query("j06_candidate_pairs", q.with_ctes(q.LINKS, CANDIDATES, select="SELECT * FROM candidates"))
def candidate_pairs(spark, sf):
    found = m.candidate_pairs(*_both_sides(spark, sf), "item")
    return found.withColumnRenamed("row", "true_row")


@query(
    "j07_settled_pairs",
    q.with_ctes(
        q.LINKS, CANDIDATES,
        """degrees AS (SELECT *, count(*) OVER (PARTITION BY case_id, true_row) AS true_degree,
          count(*) OVER (PARTITION BY case_id, predicted_row) AS answer_degree FROM candidates)""",
        select="SELECT * FROM degrees",
    ),
)
def settled_pairs(spark, sf):
    found = m.with_degrees(m.candidate_pairs(*_both_sides(spark, sf), "item"))
    return found.withColumnRenamed("row", "true_row")


def _classes_sql(side: str) -> str:
    """Rows of one side grouped by their identity values, named by their least row."""
    values = {
        name: s.norm_name(f"{side}_{name}") if name in ("code", "description") else f"{side}_{name}"
        for name in m.ITEM_WEIGHTS
    }
    listed = ", ".join(f"{value} AS {name}" for name, value in values.items())
    return f"""{side}_classes AS (SELECT * EXCLUDE (pos), min(pos) AS row, count(*) AS n FROM
      (SELECT case_id, {listed}, pos FROM {side}_items) GROUP BY ALL)"""


_CLASS_SCORE = " + ".join(
    f"CASE WHEN coalesce(t.{name}=p.{name},false) THEN {weight} ELSE 0 END"
    for name, weight in m.ITEM_WEIGHTS.items()
)


@query(
    "j06_class_pairs",
    q.with_ctes(
        q.LINKS,
        _classes_sql("t"),
        _classes_sql("p"),
        f"""paired AS (SELECT t.case_id, t.row AS true_row, p.row AS predicted_row,
          ({_CLASS_SCORE})::BIGINT AS score, t.n AS true_rows, p.n AS answer_rows
          FROM t_classes t JOIN p_classes p USING (case_id))""",
        select=f"SELECT * FROM paired WHERE score>={m.ITEM_MINIMUM}",
    ),
)
def class_pairs(spark, sf):
    """Pairs between classes of equal rows, each named by its least row."""
    found = m.class_pairs(*_both_sides(spark, sf), "item")
    return found.withColumnRenamed("row", "true_row")


def best_totals_sql(*parts: str) -> str:
    """The greatest total score and then the least total distance of each case, by walking through
    every one-to-one choice of ``candidates``."""
    walked = q.with_ctes(
        *parts,
        """ranked AS (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY true_row) AS k
          FROM candidates)""",
        "tops AS (SELECT case_id, max(k) AS last FROM ranked GROUP BY case_id)",
        """choices AS (SELECT case_id, k, 1::BIGINT << predicted_row::INTEGER AS bit, score,
          abs(true_row-predicted_row) AS distance FROM ranked
          UNION ALL SELECT DISTINCT case_id, k, 0::BIGINT, 0, 0 FROM ranked)""",
        """walk AS (SELECT case_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS score,
          0::BIGINT AS distance FROM tops UNION ALL
          SELECT w.case_id, c.k, w.used|c.bit, w.score+c.score, w.distance+c.distance
          FROM walk w JOIN choices c ON c.case_id=w.case_id AND c.k=w.k+1 AND (w.used&c.bit)=0)""",
        """best AS (SELECT case_id, max(score*1000000-distance) AS v FROM walk GROUP BY case_id)""",
        select="""SELECT case_id, ((v+999999)//1000000)::BIGINT AS score,
          (((v+999999)//1000000)*1000000-v)::BIGINT AS distance FROM best""",
    )
    return walked.replace("WITH ", "WITH RECURSIVE ", 1)


def match_totals(pairs):
    return pairs.groupBy("case_id").agg(
        F.sum("score").alias("score"),
        F.sum(F.abs(C("row") - C("predicted_row"))).alias("distance"),
    )


@query("j07_match_totals", best_totals_sql(q.LINKS, CANDIDATES))
def match_item_totals(spark, sf):
    """Total score and row distance of each case's optimal pairs, the same for every optimum."""
    return match_totals(m.match_rows(*_stored_sides(spark, sf), "item"))


@query(
    "j07_match_installment_totals",
    best_totals_sql(
        q.CASES, q.INSTALLMENTS,
        """candidates AS (SELECT t.case_id, t.pos AS true_row, p.pos AS predicted_row,
          (CASE WHEN t.number=p.number THEN 2 ELSE 0 END + CASE WHEN t.t_due=p.p_due THEN 2 ELSE 0 END
          + CASE WHEN t.t_amount=p.p_amount THEN 1 ELSE 0 END)::BIGINT AS score
          FROM inst t JOIN inst p ON t.case_id=p.case_id AND p.has_p
          WHERE t.number=p.number OR t.t_due=p.p_due)""",
    ),
)
def match_installment_totals(spark, sf):
    links = b.installment_links(spark, sf)
    return match_totals(
        m.match_rows(b.flat_installments(links, "t"), b.flat_installments(links, "p"), "installment")
    )


@query("j07_match_rows")
def match_rows(spark, sf):
    """The optimal one-to-one pairs of all items (checked against brute force in the tests)."""
    return m.match_rows(*_stored_sides(spark, sf), "item").withColumnRenamed("row", "true_row")


@query("j07_match_installments")
def match_installments(spark, sf):
    links = b.installment_links(spark, sf)
    found = m.match_rows(
        b.flat_installments(links, "t"), b.flat_installments(links, "p"), "installment"
    )
    return found.withColumnRenamed("row", "true_row")


# --- tags -------------------------------------------------------------------------------------


@query(
    "t_tag_values",
    q.with_ctes(
        *_FACT_SQL,
        select=f"""SELECT case_id, path, {s.TAG_LIST}[rule+1] AS tag FROM tagged""",
    ),
)
def tag_values(spark, sf):
    """Every wrong value with its tag; the two text tags, told apart by a ratio, read as one."""
    found = tagged_wrong(graded_run(spark, sf))
    tag = F.when(C("tag") == "text_near_miss", "text_wrong").otherwise(C("tag"))
    return found.select("case_id", "path", tag.alias("tag"))


@query(
    "t04_trailing_rows_lost",
    q.with_ctes(
        *_FACT_SQL,
        select="""SELECT l.case_id, l.pos FROM lost l LEFT JOIN last_row USING (case_id)
          WHERE pos>coalesce(last,-1)""",
    ),
)
def trailing_rows(spark, sf):
    run = graded_run(spark, sf)
    return tags.trailing_missing(run.linked).withColumnRenamed("line", "pos")


@query("t14_text_near_miss")
def text_near_miss(spark, sf):
    """Near-miss names and descriptions: a matching-block ratio, which SQL cannot express."""
    wrong = graded_run(spark, sf).wrong
    compared = tags.with_comparable(wrong).filter("near_text")
    return compared.select("case_id", "path", "expected", "predicted", "near")


@query(
    "t19_inherited_count_tags",
    q.with_ctes(
        *_FACT_SQL,
        select=f"""SELECT case_id, col AS "column", {s.TAG_LIST}[event_rule+1] AS tag FROM event_rules""",
    ),
)
def inherited_tags(spark, sf):
    run = graded_run(spark, sf)
    rules = tags.first_event_rules(tags._keyed(run.wrong, run.header, run.linked))
    return rules.select("case_id", "column", tags.tag_name(C("event_rule")).alias("tag"))
