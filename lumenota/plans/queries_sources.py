"""Registered queries of the sources (S01 to S16), the datasets (N01 to N13) and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenota.operators import datasets as ds
from lumenota.operators import grading as g
from lumenota.operators.decisions import label
from lumenota.operators.rules import validate
from lumenota.plans import bindings as b
from lumenota.plans import oracle_sql as q
from lumenota.plans import queries_rules as rules_sql
from lumenota.plans.registry import query
from lumenota.session import shared_folder
from lumenota.sources import nfe, records, sinks, tables
from lumenota.streaming import streams

C = F.col


# --- invoice XML ------------------------------------------------------------------------------


def xml_texts(spark, sf):
    """One invoice XML per order; some priorities lack an element or carry a malformed number."""
    orders = b.table(spark, sf, "orders")
    priority = C("o_orderpriority")
    price = C("o_totalprice").cast("decimal(18,2)").cast("string")
    number = C("o_orderkey").cast("string")
    crt = F.when(C("o_orderstatus") == "F", "3").otherwise("1")
    code = F.when(C("o_orderstatus") == "F", "<CST>00</CST>").otherwise("<CSOSN>102</CSOSN>")
    group = F.when(C("o_orderstatus") == "F", "ICMS00").otherwise("ICMSSN102")
    quantity = F.when(priority == "2-HIGH", "two").otherwise("2.0000")
    uf = F.when(priority == "1-URGENT", "").otherwise("<enderEmit><UF>SP</UF></enderEmit>")
    day = F.date_format(C("o_orderdate"), "yyyy-MM-dd")

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    body = F.concat(
        F.lit('<infNFe Id="NFe'), F.lpad(number, 44, "0"), F.lit('"><ide>'), tag("nNF", number),
        F.lit("<serie>1</serie>"), tag("dhEmi", F.concat(day, F.lit("T23:30:00-03:00"))),
        F.lit("<natOp>VENDA</natOp></ide><emit><CNPJ>00000000000191</CNPJ><xNome>A &amp; B</xNome>"),
        tag("CRT", crt), uf, F.lit("</emit><dest><CPF>52998224725</CPF>"), tag("xNome", priority),
        F.lit("<enderDest><UF>RJ</UF></enderDest></dest><det nItem='1'><prod><cProd>P1</cProd>"),
        F.lit("<xProd>thing</xProd><NCM>12345678</NCM><CFOP>5102</CFOP><uCom>UN</uCom>"),
        tag("qCom", quantity), F.lit("<vUnCom>1.5</vUnCom>"), tag("vProd", price),
        F.lit("</prod><imposto><ICMS><"), group, F.lit("><orig>0</orig>"), code, F.lit("</"), group,
        F.lit("></ICMS></imposto></det><total><ICMSTot>"), tag("vProd", price), tag("vNF", price),
        F.lit("</ICMSTot></total></infNFe>"),
    )
    return orders.select("o_orderkey", body.alias("xml"))


@query(
    "s01_parse_nfe",
    """SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR),44,'0') AS access_key, o_orderkey AS number,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS issue_date, o_orderpriority AS recipient_name,
      CASE WHEN o_orderstatus='F' THEN '000' ELSE '0102' END AS cst_csosn,
      CAST(round(o_totalprice*100) AS BIGINT)/100 AS total, 0.0::DOUBLE AS icms_amount,
      CAST(round(o_totalprice*100) AS BIGINT)/100 AS invoice_total FROM orders
      WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')""",
)
def parse_nfe(spark, sf):
    good, _ = nfe.quarantine(nfe.parse_nfe(xml_texts(spark, sf), "xml", ("o_orderkey",)))
    item = C("items")[0]
    return good.select(
        "o_orderkey", "access_key", "number", "issue_date",
        C("recipient.name").alias("recipient_name"), item["cst_csosn"].alias("cst_csosn"),
        item["total"].alias("total"), item["icms_amount"].alias("icms_amount"),
        C("totals.invoice_total").alias("invoice_total"),
    )


@query(
    "s02_quarantine",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'enderEmit/UF' ELSE 'qCom' END AS problems
      FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')""",
)
def quarantine(spark, sf):
    _, bad = nfe.quarantine(nfe.parse_nfe(xml_texts(spark, sf), "xml", ("o_orderkey",)))
    return bad.select("o_orderkey", "problems")


# --- records and strict texts -----------------------------------------------------------------


def record_lines(spark, sf):
    """Run-file lines from events: whole records, odd ids, arrays, torn texts and blank lines."""
    kind, number = C("event_type"), C("event_id").cast("string")
    line = (
        F.when(kind == "click", F.concat(F.lit('{"case_id":"c-'), number, F.lit('","status":"completed"}')))
        .when(kind == "view", F.concat(F.lit('{"case_id":"a/'), number, F.lit('"}')))
        .when(kind == "error", F.lit("[1,2]"))
        .when(kind == "purchase", F.concat(F.lit('{"case_id":"c-'), number))
        .otherwise(F.lit("  "))
    )
    return b.table(spark, sf, "events").select("event_id", line.alias("line"))


@query(
    "s03_parse_records",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'case_id has characters outside A-Z a-z 0-9 . _ -'
      WHEN 'error' THEN 'not a JSON object' WHEN 'purchase' THEN 'invalid JSON' END AS reason,
      CASE WHEN event_type='click' THEN 'c-'||event_id WHEN event_type='view' THEN 'a/'||event_id END AS case_id
      FROM events WHERE event_type<>'signup'""",
)
def parse_records(spark, sf):
    parsed = records.parse_records(record_lines(spark, sf))
    known = C("reason").isNull() | C("reason").startswith("case_id")
    return parsed.select(
        "event_id", "reason", F.when(known, C("record.case_id")).alias("case_id")
    )


@query(
    "s08_run_state",
    """SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'missing' ELSE 'damaged' END
      AS problem, CASE WHEN event_type='click' THEN 'cost_cap' END AS stopped_reason FROM events""",
)
def run_state(spark, sf):
    kind = C("event_type")
    text = (
        F.when(kind == "click", F.lit('{"case_ids":["a"],"stopped_reason":"cost_cap"}'))
        .when(kind == "error", F.lit('{"case_ids":"a"}'))
        .when(kind != "view", F.lit("{"))
    )
    events = b.table(spark, sf, "events").select("event_id", text.alias("value"))
    state = tables.run_state_columns("value")
    return events.select("event_id", state["problem"], state["stopped_reason"])


def invoice_texts(spark, sf):
    """Strict invoice texts from orders, with one kind of violation for each priority."""
    heads = b.header_links(spark, sf).select("case_id", "t")
    orders = b.table(spark, sf, "orders").select(
        C("o_orderkey").alias("case_id"), "o_orderpriority"
    )
    joined = heads.join(orders, "case_id")
    t, priority = C("t"), C("o_orderpriority")
    totals = F.struct(
        *[t["totals"][name].cast("string").alias(name) for name in b.TOTAL_FIELDS]
    )
    party = t["issuer"].withField("ie", F.coalesce(t["issuer"]["ie"], F.lit("ISENTO")))
    nature = F.when(priority == "5-LOW", F.lit(None)).otherwise(t["operation_nature"])
    item_fields = {name: "0.00" for name in b.ITEM_FIELDS} | {
        "code": "P1", "description": "thing", "ncm": "12345678", "cst_csosn": "000", "cfop": "5102",
        "unit": "UN", "quantity": "1.0000", "unit_price": "1.0000",
    }
    ncm = F.when(priority == "3-MEDIUM", "1234").otherwise("12345678")
    item = F.struct(
        *[
            (ncm if name == "ncm" else F.lit(value)).alias(name)
            for name, value in item_fields.items()
        ]
    )
    whole = F.struct(
        t["access_key"].alias("access_key"), t["number"].alias("number"),
        t["series"].alias("series"), t["issue_date"].cast("string").alias("issue_date"),
        nature.alias("operation_nature"), party.alias("issuer"),
        t["recipient"].alias("recipient"), F.array(item).alias("items"), totals.alias("totals"),
        F.array().cast("array<struct<number:string,due_date:string,amount:string>>").alias(
            "installments"),
    )
    text = F.to_json(whole, {"ignoreNullFields": "false"})
    shown = (
        F.when(priority == "1-URGENT", F.concat(F.lit('{"extra":1,'), F.substring(text, F.lit(2), F.length(text))))
        .when(priority == "2-HIGH", F.substring(text, F.lit(1), F.length(text) - 1))
        .otherwise(text)
    )
    return joined.select("case_id", shown.alias("raw"))


@query(
    "s09_parse_invoice",
    q.with_ctes(
        *(q.CASES, q.HEADERS),
        select="""SELECT o_orderkey AS case_id, CASE o_orderpriority WHEN '1-URGENT' THEN '$' WHEN '2-HIGH' THEN '$'
          WHEN '3-MEDIUM' THEN 'items[0].ncm' WHEN '5-LOW' THEN 'operation_nature' ELSE '' END AS violations,
          CASE WHEN o_orderpriority LIKE '4%' THEN 'ok' ELSE 'schema_invalid' END AS parse_status,
          CASE WHEN o_orderpriority LIKE '4%' THEN invoice_total/100 END AS invoice_total
          FROM ordered JOIN t_head ON o_orderkey=case_id""",
    ),
)
def parse_invoice(spark, sf):
    parsed = records.parse_invoice(invoice_texts(spark, sf), "raw")
    return parsed.select(
        "case_id", "violations", "parse_status",
        C("invoice.totals.invoice_total").alias("invoice_total"),
    )


@query(
    "s12_summary_json",
    """SELECT '{"c_custkey":'||c_custkey||',"c_mktsegment":"'||c_mktsegment||'","c_name":"'||c_name||
      '","none":null}' AS value FROM customer""",
)
def summary_json(spark, sf):
    rows = b.table(spark, sf, "customer").select(
        F.lit(None).cast("string").alias("none"), "c_name", "c_mktsegment", "c_custkey"
    )
    return sinks.summary_json(rows)


@query("s13_content_hash")
def content_hash(spark, sf):
    """Digests of the table files themselves."""
    hashed = tables.content_hash(spark, f"{sf}/*.parquet")
    return hashed.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query(
    "s14_table_diff",
    """SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 'missing' WHEN o_orderpriority='5-LOW' THEN 'extra'
      ELSE 'different' END AS problem FROM orders WHERE o_orderstatus='F' OR o_orderpriority='5-LOW' OR
      o_orderstatus='O'""",
)
def table_diff(spark, sf):
    """Orders against a copy that lost the low ones, gained the F ones and changed the O ones."""
    orders = b.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    changed = orders.withColumn(
        "o_totalprice",
        F.when(C("o_orderstatus") == "O", -C("o_totalprice")).otherwise(C("o_totalprice")),
    )
    fresh = orders.filter("o_orderstatus <> 'F'")
    committed = changed.filter("o_orderpriority <> '5-LOW' OR o_orderstatus = 'F'")
    return tables.table_diff(fresh, committed, ["o_orderkey"])


@query(
    "s15_select_cases",
    """SELECT doc_id AS case_id, CASE WHEN lang='en' THEN 'test' ELSE 'dev' END AS split FROM documents
      WHERE doc_id IN (SELECT doc_id FROM labels) AND lang<>'en'""",
)
def select_cases(spark, sf):
    manifest = b.table(spark, sf, "documents").select(
        C("doc_id").alias("case_id"), F.when(C("lang") == "en", "test").otherwise("dev").alias("split")
    )
    dev = manifest.filter("split = 'dev'")
    wanted = b.table(spark, sf, "labels").select(C("doc_id").alias("case_id")).join(
        dev.select("case_id"), "case_id", "left_semi"
    )
    return tables.select_cases(manifest, split="dev", wanted=wanted)


@query(
    "s15_unknown_ids",
    "SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)",
)
def unknown_ids(spark, sf):
    manifest = b.table(spark, sf, "documents").select(C("doc_id").alias("case_id"))
    return tables.unknown_ids(
        manifest, b.table(spark, sf, "orders").select(C("o_orderkey").alias("case_id"))
    )


# --- datasets ---------------------------------------------------------------------------------


def quota_cells(spark, sf):
    """One quota cell per nation, as large as its number of customers."""
    counts = b.table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).cast("int").alias("count")
    )
    key = C("c_nationkey")
    small = F.when(key % 2 == 0, "normal").otherwise("simples")
    traits = F.create_map(
        F.lit("confusable"), F.array(F.lit(3), F.lit(5)),
        F.lit("long_text"), F.array(F.lit(4), key % 6),
        F.lit("mixed_tax_codes"), F.array(F.lit(1), F.lit(2)),
    )
    return counts.select(
        key.alias("cell_order"), F.concat(F.lit("nation-"), key.cast("string")).alias("cell"),
        small.alias("regime"),
        F.when(key < 12, "short").otherwise("medium").alias("length"), "count",
        F.lit(1).alias("item_low"), F.when(key == 7, 0).otherwise(8).alias("item_high"),
        F.lit("single").alias("pages"), traits.alias("traits"),
        F.create_map(F.lit(2), F.lit(1)).alias("pinned"),
        F.create_map(F.lit(0), F.lit("dev"), F.lit(6), F.lit("test")).alias("curve"),
        F.lit(20).alias("long_low"), F.lit(30).alias("long_high"),
    )


CELLS = """cells AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey),
offsets AS (SELECT *, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT
  AS base, coalesce(count(*) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)*2 AS curves
  FROM cells),
slots AS (SELECT *, unnest(range(0,n)) AS slot FROM offsets),
bases AS (SELECT base+slot+1 AS number, 'nation-'||k AS cell, slot, curves, slot IN (4, k%6) AS long_text,
  slot IN (3,5) AS confusable, slot IN (1,2) AS mixed, k,
  CASE slot WHEN 0 THEN 'dev' WHEN 6 THEN 'test' END AS curve_split FROM slots)"""


@query(
    "n01_expand_quota",
    q.with_ctes(
        CELLS,
        select="""SELECT number, cell, slot, CASE WHEN k%2=0 THEN 3 ELSE 1 END::BIGINT AS crt,
          CASE WHEN mixed THEN greatest(2, CASE WHEN long_text THEN 20 ELSE 1 END)
            WHEN long_text THEN 20 ELSE 1 END::BIGINT AS band_low,
          CASE WHEN long_text THEN 30 WHEN k=7 THEN 0 ELSE 8 END::BIGINT AS band_high,
          array_to_string(list_filter([CASE WHEN confusable THEN 'confusable' END,
            CASE WHEN long_text THEN 'long_text' END, CASE WHEN mixed THEN 'mixed_tax_codes' END],
            lambda x: x IS NOT NULL), ',') AS traits,
          CASE WHEN slot=2 THEN 1 END::BIGINT AS pinned_items, curve_split FROM bases""",
    ),
)
def expand_quota(spark, sf):
    return ds.expand_quota(quota_cells(spark, sf)).select(
        "number", "cell", "slot", "crt", "band_low", "band_high", "traits", "pinned_items",
        "curve_split",
    )


_RENDERINGS = ",".join(f"'{name}/{level or ''}'" for name, level in ds.TWIN_RENDERINGS)


@query(
    "n02_expand_twins",
    q.with_ctes(
        CELLS,
        f"""twins AS (SELECT number AS base_number, curves + CASE slot WHEN 0 THEN 0 ELSE 1 END AS rank,
          unnest(range(0,8)) AS place FROM bases WHERE curve_split IS NOT NULL),
        named AS (SELECT *, [{_RENDERINGS}][place+1] AS r, (SELECT max(number) FROM bases) AS last FROM twins)""",
        select="""SELECT last+rank*8+place+1 AS number, base_number, split_part(r,'/',1) AS rendering,
          nullif(split_part(r,'/',2),'') AS severity FROM named""",
    ),
)
def expand_twins(spark, sf):
    return ds.expand_twins(ds.expand_quota(quota_cells(spark, sf)))


@query(
    "n03_check_quota",
    q.with_ctes(
        CELLS,
        select="""SELECT 'nation-'||k AS cell, problem FROM cells, (VALUES
          ('item band does not ascend from 1', k=7),
          ('mixed_tax_codes together with pinned_one', true),
          ('long_text not for this length', k>=12),
          ('confusable together with long_text', k%6 IN (3,5)),
          ('long_text together with curve', k%6=0),
          ('curve on a slot the cell lacks', n<=6),
          ('confusable on a slot the cell lacks', n<=5),
          ('long_text on a slot the cell lacks', n<=greatest(4,k%6)),
          ('mixed_tax_codes on a slot the cell lacks', n<=2),
          ('pinned on a slot the cell lacks', n<=2),
          ('pinned_one on a slot the cell lacks', n<=2),
          ('fewer bases than splits', n<2)) AS p(problem, holds) WHERE holds""",
    ),
)
def check_quota(spark, sf):
    return ds.check_quota(quota_cells(spark, sf))


def _bases(spark, sf):
    """Customers as base cases of their nation; two market segments bring their own split."""
    rich, poor = C("c_acctbal") > 9900, C("c_acctbal") < -900
    return b.table(spark, sf, "customer").select(
        C("c_custkey").alias("case_id"),
        C("c_nationkey").alias("cell"),
        F.when(rich, "dev").when(poor, "test").alias("curve_split"),
    )


SPLITS = """splitting AS (SELECT c_custkey AS case_id, c_nationkey AS cell, CASE WHEN c_acctbal>9900 THEN 'dev'
  WHEN c_acctbal<-900 THEN 'test' END AS named FROM customer),
places AS (SELECT cell, greatest(1,(count(*)+1)//3) AS dev, count(*) FILTER (named='dev') AS taken
  FROM splitting GROUP BY cell),
ranked AS (SELECT case_id, cell, row_number() OVER (PARTITION BY cell ORDER BY sha256('7:split:'||case_id), case_id)-1
  AS place FROM splitting WHERE named IS NULL),
splits AS (SELECT case_id, cell, CASE WHEN place<dev-taken THEN 'dev' ELSE 'test' END AS split FROM ranked
  JOIN places USING (cell) UNION ALL SELECT case_id, cell, named FROM splitting WHERE named IS NOT NULL)"""


@query("n04_stratified_split", q.with_ctes(SPLITS, select="SELECT case_id, cell::BIGINT AS cell, split FROM splits"))
def stratified_split(spark, sf):
    return ds.stratified_split(_bases(spark, sf), "7")


@query(
    "n05_pick_one_per_cell",
    q.with_ctes(
        SPLITS,
        """pool AS (SELECT case_id, c_mktsegment FROM splits JOIN customer ON case_id=c_custkey WHERE split='dev'),
        one AS (SELECT arg_min(case_id, sha256('7:ci:BUILDING:'||case_id)) AS p FROM pool
          WHERE c_mktsegment='BUILDING'),
        two AS (SELECT arg_min(case_id, sha256('7:ci:any:'||case_id)) AS p FROM pool
          WHERE case_id NOT IN (SELECT p FROM one))""",
        select="SELECT 'BUILDING' AS cell, p AS case_id FROM one UNION ALL SELECT 'any', p FROM two",
    ),
)
def pick_one_per_cell(spark, sf):
    splits = ds.stratified_split(_bases(spark, sf), "7").drop("cell")
    customer = b.table(spark, sf, "customer")
    pool = splits.join(customer, splits.case_id == customer.c_custkey).select(
        "case_id", "split", "c_mktsegment"
    )
    return ds.pick_one_per_cell(
        pool, (("BUILDING", C("c_mktsegment") == "BUILDING"), ("any", F.lit(True))), "7"
    )


@query(
    "n06_derive_tags",
    """SELECT o_orderkey, array_to_string(list_sort(list_filter([
      CASE WHEN o_orderstatus='F' THEN 'regime_normal' ELSE 'simples_nacional' END,
      CASE WHEN o_orderpriority='1-URGENT' THEN 'mei' END,
      CASE WHEN n<=8 THEN 'short' WHEN n<=25 THEN 'medium' ELSE 'many_items' END,
      CASE WHEN o_totalprice<300000 THEN 'single_page' ELSE 'multi_page' END, 'alphanumeric_cnpj',
      CASE WHEN o_orderstatus='O' THEN 'cpf_recipient' ELSE NULL END,
      CASE WHEN o_orderstatus='P' THEN 'st_deferral' END, CASE WHEN o_orderstatus='P' THEN 'mixed_tax_codes' END,
      CASE WHEN o_totalprice>=100000 THEN 'ipi' END, CASE WHEN o_totalprice>=200000 THEN 'freight_discount' END,
      CASE WHEN n>10 THEN 'installments' END], lambda x: x IS NOT NULL)), ',') AS tags
      FROM (SELECT *, o_custkey%40 AS n FROM orders)""",
)
def derive_tags(spark, sf):
    status, price = C("o_orderstatus"), C("o_totalprice")
    n = (C("o_custkey") % 40).cast("int")
    codes = F.when(status == "P", F.array(F.lit("10"), F.lit("00"))).otherwise(
        F.array(F.lit("00"), F.lit("00"))
    )
    facts = b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "F", "normal").otherwise("simples").alias("regime"),
        F.when(C("o_orderpriority") == "1-URGENT", 4).otherwise(1).alias("crt"),
        n.alias("item_count"),
        F.when(price < 300000, 1).otherwise(2).alias("pages"),
        F.lit("AB0000000001").alias("issuer_cnpj"),
        F.lit("12345678901").alias("recipient_tax_id"),
        F.when(status == "O", "cpf").otherwise("cnpj").alias("recipient_kind"),
        codes.alias("tax_codes"),
        F.when(price >= 100000, 1).otherwise(0).alias("ipi_total"),
        F.when(price >= 200000, 1).otherwise(0).alias("freight"),
        F.lit(0).alias("discount"),
        F.when(n > 10, 2).otherwise(0).alias("installment_count"),
    )
    return ds.derive_tags(facts).select("o_orderkey", "tags")


def taxed_items(spark, sf):
    flag, line = C("l_returnflag"), C("l_linestatus")
    code = (
        F.when((flag == "A") & (line == "F"), "00")
        .when(flag == "A", "10")
        .when((flag == "R") & (line == "F"), "20")
        .when(flag == "R", "51")
        .when(line == "F", "70")
        .otherwise("101")
    )
    return b.table(spark, sf, "lineitem").select(
        C("l_orderkey").alias("case_id"),
        code.alias("tax_code"),
        C("l_quantity").cast("decimal(18,4)").alias("quantity"),
        (C("l_extendedprice") * 0.01).cast("decimal(18,4)").alias("unit_price"),
        (C("l_discount") * 100).cast("decimal(9,2)").alias("ipi_rate"),
        F.lit("1.00").cast("decimal(18,2)").alias("freight"),
        F.lit("0.50").cast("decimal(18,2)").alias("discount"),
    )


TAXED = """raw AS (SELECT l_orderkey AS case_id, CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN '00'
  WHEN l_returnflag='A' THEN '10' WHEN l_returnflag='R' AND l_linestatus='F' THEN '20' WHEN l_returnflag='R' THEN '51'
  WHEN l_linestatus='F' THEN '70' ELSE '101' END AS code, CAST(l_quantity AS BIGINT) AS pieces,
  CAST(round(l_extendedprice*100) AS BIGINT) AS u, CAST(round(l_discount*10000) AS BIGINT) AS ipi FROM lineitem),
totalled AS (SELECT *, (2*pieces*u+100)//200 AS t FROM raw),
based AS (SELECT *, CASE WHEN code='101' THEN 0 WHEN code IN ('20','70') THEN (2*t*6667+10000)//20000 ELSE t END AS b,
  CASE WHEN code IN ('00','10','51','70') THEN 1800 WHEN code='20' THEN 1200 ELSE 0 END AS r,
  CASE code WHEN '10' THEN (2*t*14000+10000)//20000 WHEN '70' THEN (2*t*13500+10000)//20000 ELSE 0 END AS sb,
  CASE WHEN code='101' THEN (2*t*310+10000)//20000 ELSE 0 END AS credit, (2*t*ipi+10000)//20000 AS ia FROM totalled),
operated AS (SELECT *, (2*b*r+10000)//20000 AS op FROM based),
taxed AS (SELECT *, op - CASE WHEN code='51' THEN (2*op*3333+10000)//20000 ELSE 0 END AS icms FROM operated),
finished AS (SELECT *, CASE WHEN sb=0 THEN 0 ELSE (2*sb*1800+10000)//20000 - icms END AS st FROM taxed)"""


@query(
    "n07_item_taxes",
    q.with_ctes(
        TAXED,
        select="""SELECT case_id, code AS tax_code, pieces::DOUBLE AS quantity, t/100 AS total, b/100 AS icms_base,
          icms/100 AS icms_amount, sb/100 AS st_base, st/100 AS st_amount, credit/100 AS credit_amount,
          ia/100 AS ipi_amount FROM finished""",
    ),
)
def item_taxes(spark, sf):
    return ds.item_taxes(taxed_items(spark, sf)).select(
        "case_id", "tax_code", "quantity", "total", "icms_base", "icms_amount", "st_base",
        "st_amount", "credit_amount", "ipi_amount",
    )


@query(
    "n08_invoice_totals",
    q.with_ctes(
        TAXED,
        select="""SELECT case_id, sum(t)/100 AS products_total, sum(icms)/100 AS icms_amount,
          sum(st)/100 AS icms_st_amount, sum(t+st+ia+100-50)/100 AS invoice_total FROM finished GROUP BY case_id""",
    ),
)
def invoice_totals(spark, sf):
    found = ds.invoice_totals(ds.item_taxes(taxed_items(spark, sf)))
    return found.select(
        "case_id", "products_total", "icms_amount", "icms_st_amount", "invoice_total"
    )


@query(
    "n09_allocate",
    """SELECT l_orderkey AS case_id, l_partkey, l_linenumber::BIGINT AS l_linenumber, cap, amount, least(cap, greatest(amount-coalesce(sum(cap)
      OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber ROWS BETWEEN UNBOUNDED
      PRECEDING AND 1 PRECEDING),0),0))::BIGINT AS share FROM (SELECT l.*, CAST(l_quantity*100 AS BIGINT) AS cap,
      5000::BIGINT AS amount FROM lineitem l)""",
)
def allocate(spark, sf):
    """Fifty units of money spread over the lines of each order, at most the quantity each."""
    rows = b.table(spark, sf, "lineitem").select(
        C("l_orderkey").alias("case_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
        (C("l_quantity") * 100).cast("bigint").alias("cap"), F.lit(5000).cast("bigint").alias("amount"),
    )
    found = ds.allocate(rows, ["case_id"], "l_shipdate", ["l_partkey", "l_suppkey", "l_linenumber"])
    return found.select("case_id", "l_partkey", "l_linenumber", "cap", "amount", "share")


_DIGITS = "substr(translate(sha256('s:'||c_custkey),'abcdef','012345'),1,8)"


@query(
    "n10_synthetic_ids",
    f"SELECT c_custkey, {_DIGITS} AS root, true AS cnpj_valid, true AS cpf_valid FROM customer",
)
def synthetic_ids(spark, sf):
    from lumenota.functions import identifiers as ids

    seed = F.concat(F.lit("s:"), C("c_custkey").cast("string"))
    made = b.table(spark, sf, "customer").select(
        "c_custkey", ds.synthetic_cnpj(seed).alias("cnpj"), ds.synthetic_cpf(seed).alias("cpf")
    )
    return made.select(
        "c_custkey",
        F.substring("cnpj", 1, 8).alias("root"),
        ids.is_valid_cnpj(C("cnpj")).alias("cnpj_valid"),
        ids.is_valid_cpf(C("cpf")).alias("cpf_valid"),
    )


@query(
    "n11_corrupt_header",
    q.with_ctes(
        q.CASES, q.HEADERS,
        select="""SELECT case_id, 'party_swap' AS tag, tax_id||'/'||issuer_cnpj AS changed FROM t_head UNION ALL
          SELECT case_id, 'digit_count', tax_id||right(tax_id,1) FROM t_head UNION ALL
          SELECT case_id, 'digit_substitution', left(issuer_cnpj,length(issuer_cnpj)-1)||
            (CAST(right(issuer_cnpj,1) AS INTEGER)+1)%10 FROM t_head UNION ALL
          SELECT case_id, 'date_wrong', CAST(CAST(issue_date+INTERVAL 1 DAY AS DATE) AS VARCHAR) FROM t_head
          UNION ALL SELECT case_id, 'thousands_misparse', CAST(invoice_total*10 AS VARCHAR)||'.00' FROM t_head
          WHERE invoice_total<>0 UNION ALL
          SELECT case_id, 'value_from_other_box', products_total//100||'.'||
            lpad(CAST(products_total%100 AS VARCHAR),2,'0') FROM t_head
            WHERE products_total<>0 AND products_total<>invoice_total""",
    ),
)
def corrupt_header(spark, sf):
    """Six header misreadings of every invoice (the row ones are checked end to end in the tests)."""
    heads = b.true_headers(spark, sf)
    shown = {
        "party_swap": F.concat_ws("/", "issuer.cnpj", "recipient.tax_id"),
        "digit_count": C("recipient.tax_id"),
        "digit_substitution": C("issuer.cnpj"),
        "date_wrong": C("issue_date").cast("string"),
        "thousands_misparse": C("totals.invoice_total").cast("string"),
        "value_from_other_box": C("totals.invoice_total").cast("string"),
    }
    parts = [
        ds.corrupt(heads, tag).select(
            "case_id", F.lit(tag).alias("tag"), value.alias("changed")
        )
        for tag, value in shown.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@query(
    "n13_mutate_cases",
    """SELECT spec, intended, decision, count(*) AS cases FROM (SELECT spec, intended, CASE
      WHEN spec='refused' THEN 'escalate' WHEN c_mktsegment<>'BUILDING' AND spec<>'ours' THEN 'reject'
      WHEN spec='costly' OR o_totalprice>200000 THEN 'escalate' ELSE 'approve' END AS decision
      FROM orders JOIN customer ON o_custkey=c_custkey, (VALUES ('ours','approve'),('costly','escalate'),
      ('refused','escalate')) AS s(spec,intended)) GROUP BY ALL""",
)
def mutate_cases(spark, sf):
    orders, customer = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        C("o_orderkey").alias("case_id"), F.lit("success").alias("extraction_status"),
        C("c_mktsegment").alias("tax_id"), F.lit(False).alias("has_warning"),
        C("o_totalprice").cast("decimal(18,2)").alias("invoice_total"),
    )
    dear = F.lit("900000.00").cast("decimal(18,2)")
    mutated = ds.mutate_cases(
        base,
        (
            ("ours", {"tax_id": F.lit("BUILDING")}, "approve"),
            ("costly", {"invoice_total": dear}, "escalate"),
            ("refused", {"extraction_status": F.lit("refused")}, "escalate"),
        ),
    )
    policy = spark.createDataFrame(
        [("BUILDING", "200000.00")], "buyer_cnpj string, approval_limit string"
    ).withColumn("approval_limit", C("approval_limit").cast("decimal(18,2)"))
    return label(mutated, policy).groupBy("spec", "intended", "decision").agg(
        F.count(F.lit(1)).alias("cases")
    )


# --- nested rows and streams ------------------------------------------------------------------


# Rows are counted inside their invoice here, so a row that was not answered leaves no gap.
_PLACE = "SELECT * REPLACE (row_number() OVER (PARTITION BY case_id ORDER BY pos)-1 AS pos) FROM"
NESTED_SQL = q.with_ctes(
    q.CASES, q.HEADERS, q.LINKS, q.INSTALLMENTS, rules_sql._header_rows("p_head"),
    f"n_items AS ({_PLACE} p_items)", f"n_inst AS ({_PLACE} inst WHERE has_p)",
    rules_sql._item_rows("n_items", "p"), rules_sql.PRINTED, rules_sql._total_rows("p"),
    rules_sql.INSTALLMENT_ROWS.replace("inst JOIN", "n_inst JOIN"),
    select=rules_sql.EVERY_FINDING,
)


def _whole_invoices(spark, sf):
    """The answered invoices with their items and installments, nested where the three lie by case."""
    headers = b.answered_headers(b.true_headers(spark, sf))
    installments = b.flat_installments(b.installment_links(spark, sf), "p")
    return ds.nest_invoices(headers, b.answered_items(b.item_links(spark, sf)), installments)


@query("v_validate_nested", NESTED_SQL)
def validate_nested(spark, sf):
    """The nested form of all rules over whole invoices: arrays only, no shuffle after nesting."""
    return validate(_whole_invoices(spark, sf), b.REFERENCE_DATE).drop("ordinal")


def work_folder(spark):
    """A fresh folder in the shared one, for a stream's tables and state."""
    return f"{shared_folder(spark)}/lumenota-stream-{uuid.uuid4().hex}"


@query(
    "w02_latest_stream",
    """SELECT user_id AS case_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY event_id DESC) AS r FROM events) WHERE r=1""",
)
def latest_stream(spark, sf):
    """The events file as a stream; the newest event of every user is kept."""
    schema = b.table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.select(C("user_id").alias("case_id"), "event_id", "event_type")
    folder = work_folder(spark)
    running = streams.latest_stream(rows, f"{folder}/table", ["event_id"], f"{folder}/state")
    running.awaitTermination()
    return streams.read_latest(spark, f"{folder}/table", ["event_id"])


@query("w01_validate_stream", NESTED_SQL)
def validate_stream(spark, sf):
    """Answered invoices written nested, then read back and checked by all rules as a stream."""
    folder = work_folder(spark)
    nested = _whole_invoices(spark, sf).drop("g", "base_case")
    nested.write.parquet(f"{folder}/invoices")
    source = spark.readStream.schema(nested.schema).parquet(f"{folder}/invoices")
    found = streams.validate_stream(source, b.REFERENCE_DATE).drop("ordinal")
    streams.drain(
        found,
        lambda batch, epoch: batch.write.mode("overwrite").parquet(
            f"{folder}/findings/batch={epoch}"
        ),
        f"{folder}/state",
    )
    return spark.read.parquet(f"{folder}/findings").drop("batch")


@query(
    "w03_spend_stream",
    """WITH charged AS (SELECT user_id AS run_id, event_id AS ordinal, CAST(round(value*100) AS BIGINT) AS spent
      FROM events), running AS (SELECT *, sum(spent) OVER w AS s, coalesce(sum(spent) OVER b,0) AS before,
      coalesce(max(spent) OVER b,0) AS held, max(spent) OVER w AS largest FROM charged WINDOW
      w AS (PARTITION BY run_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY run_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT run_id, ordinal, s/100 AS spent, largest/100 AS largest, before+greatest(50,held)<=400000 AS admitted
      FROM running""",
)
def spend_stream(spark, sf):
    """The events file as a stream of charged records, one run per user, cap 4,000."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = b.table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    charged = source.select(
        C("user_id").cast("string").alias("run_id"), C("event_id").alias("ordinal"),
        C("value").cast("decimal(18,8)").alias("spent"),
        F.lit("0").cast("decimal(18,8)").alias("assumed"),
    )
    folder = work_folder(spark)
    streams.drain(
        streams.spend_stream(charged, "4000.00", "0.50"),
        lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/spend/batch={epoch}"),
        f"{folder}/state",
    )
    return spark.read.parquet(f"{folder}/spend").select(
        C("run_id").cast("bigint").alias("run_id"), "ordinal", "spent", "largest", "admitted"
    )


# --- blocks of nested run records -------------------------------------------------------------


def _event_findings(spark, sf):
    """Events with a findings array: one finding of their own kind and, for some, a warning."""
    kind, c = C("event_type"), F.round(C("value") * 100).cast("bigint")
    own = F.struct(
        kind.alias("rule_id"), F.when(kind == "view", "note").otherwise("error").alias("severity")
    )
    warning = F.struct(F.lit("A_WARNING").alias("rule_id"), F.lit("warning").alias("severity"))
    found = F.when(c < 2000, F.array(own, own, warning)).when(c < 9000, F.array(own))
    return b.table(spark, sf, "events").select("event_id", found.alias("findings"))


@query(
    "g12_validator_block",
    """SELECT event_id, CASE WHEN event_type='view' OR c>=9000 THEN 0 WHEN c<2000 THEN 2 ELSE 1 END::BIGINT AS errors,
      CASE WHEN c<2000 THEN 1 ELSE 0 END::BIGINT AS warnings, array_to_string(list_sort(list_filter([
      CASE WHEN c<2000 THEN 'A_WARNING' END, CASE WHEN c<9000 AND event_type<>'view' THEN event_type END],
      lambda x: x IS NOT NULL)), ',') AS rule_ids
      FROM (SELECT *, CAST(round(value*100) AS BIGINT) AS c FROM events)""",
)
def validator_block(spark, sf):
    rows = _event_findings(spark, sf)
    return rows.select("event_id", g.validator_block(C("findings")).alias("v")).select(
        "event_id", "v.*"
    )


@query(
    "g13_attempt_block",
    """SELECT event_id, CASE WHEN event_type<>'error' THEN 2 END::BIGINT AS attempt_count,
      CASE WHEN event_type<>'error' THEN 'refused,success' END AS attempt_statuses,
      CASE WHEN event_type='click' THEN 1 ELSE 0 END::BIGINT AS cache_hits,
      CASE WHEN event_type<>'error' THEN 1 ELSE 0 END::BIGINT AS answered_attempts,
      CASE WHEN event_type<>'error' THEN 7+c END::BIGINT AS model_latency_ms
      FROM (SELECT *, CAST(round(value*100) AS BIGINT) AS c FROM events)""",
)
def attempt_block(spark, sf):
    kind, c = C("event_type"), F.round(C("value") * 100).cast("bigint")
    cache = F.struct(F.when(kind == "click", "hit").otherwise("miss").alias("status"))
    usage = F.struct(F.lit(1).cast("bigint").alias("input_tokens"))
    first = F.struct(
        F.lit("refused").alias("status"), F.when(F.lit(False), usage).alias("usage"),
        cache.alias("cache"), F.lit(7).cast("bigint").alias("latency_ms"),
    )
    second = F.struct(
        F.lit("success").alias("status"), F.when(F.lit(True), usage).alias("usage"),
        cache.alias("cache"), c.alias("latency_ms"),
    )
    attempts = F.when(kind != "error", F.array(first, second))
    rows = b.table(spark, sf, "events").select("event_id", attempts.alias("attempts"))
    return rows.select("event_id", g.attempt_block(C("attempts")).alias("a")).select(
        "event_id", "a.*"
    )


@query(
    "g14_schema_validity",
    """SELECT o_orderpriority LIKE '4%' AS valid, count(*) AS cases FROM orders GROUP BY ALL""",
)
def schema_validity(spark, sf):
    """The strict check of every raw text, counted."""
    parsed = records.parse_invoice(invoice_texts(spark, sf), "raw")
    return parsed.groupBy((C("parse_status") == "ok").alias("valid")).agg(
        F.count(F.lit(1)).alias("cases")
    )


@query(
    "n12_expected_block",
    q.with_ctes(
        q.CASES, q.HEADERS, q.LINKS, q.INSTALLMENTS,
        """counts AS (SELECT case_id, count(*) AS n FROM t_items GROUP BY case_id),
        parts AS (SELECT case_id, count(*) AS m FROM inst GROUP BY case_id)""",
        select="""SELECT case_id, coalesce(n,0) AS item_count, coalesce(m,0) AS installment_count,
          invoice_total/100 AS invoice_total, issuer_cnpj, tax_id AS recipient_tax_id,
          tax_id_kind AS recipient_tax_id_kind FROM t_head LEFT JOIN counts USING (case_id)
          LEFT JOIN parts USING (case_id)""",
    ),
)
def expected_block(spark, sf):
    nested = ds.nest_invoices(
        b.true_headers(spark, sf),
        b.true_items(b.item_links(spark, sf)),
        b.flat_installments(b.installment_links(spark, sf), "t"),
    )
    return ds.expected_block(nested).select("case_id", "expected.*")


@query(
    "s16_decision_cases",
    """SELECT case_id, CASE WHEN o_orderstatus='P' THEN 'refused' ELSE 'success' END AS extraction_status,
      o_orderpriority='1-URGENT' AS has_warning FROM (SELECT o_orderkey AS case_id, * FROM orders)""",
)
def decision_cases(spark, sf):
    """Decision case texts from orders, read back by the case reader's columns."""
    status = F.when(C("o_orderstatus") == "P", "refused").otherwise("success")
    severity = F.when(C("o_orderpriority") == "1-URGENT", "warning").otherwise("error")
    text = F.to_json(
        F.struct(
            F.concat(F.lit("o-"), C("o_orderkey").cast("string")).alias("case_id"),
            F.struct(status.alias("status")).alias("extraction"),
            F.array(
                F.struct(F.lit("X").alias("rule_id"), severity.alias("severity"))
            ).alias("findings"),
        )
    )
    texts = b.table(spark, sf, "orders").select("o_orderkey", text.alias("value"))
    return tables.decision_cases(texts).select(
        F.substring_index("case_id", "-", -1).cast("bigint").alias("case_id"),
        "extraction_status",
        "has_warning",
    )
