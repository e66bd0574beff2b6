"""Registered queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenota.functions import identifiers as ids
from lumenota.functions import invoice as inv
from lumenota.functions import numbers as num
from lumenota.functions import text as txt
from lumenota.plans import bindings as b
from lumenota.plans import oracle_sql as q
from lumenota.plans.registry import query

table = b.table
C = F.col
CASES_HEADERS = (q.CASES, q.HEADERS)


@query(
    "f01_full_match",
    """SELECT c_custkey, regexp_full_match(c_name,'Customer#[0-9]{9}') AS plain,
      regexp_full_match(c_name||chr(10),'Customer#[0-9]{9}') AS with_newline,
      regexp_full_match(c_mktsegment,'[A-M]+') AS segment FROM customer""",
)
def full_match(spark, sf):
    df = table(spark, sf, "customer")
    return df.select(
        "c_custkey",
        num.full_match(C("c_name"), "Customer#[0-9]{9}").alias("plain"),
        num.full_match(F.concat("c_name", F.lit("\n")), "Customer#[0-9]{9}").alias("with_newline"),
        num.full_match(C("c_mktsegment"), "[A-M]+").alias("segment"),
    )


_PRICE_TEXT = """priced AS (SELECT o_orderkey, CAST(round(o_totalprice*100) AS BIGINT) AS c,
  CAST(substr(o_orderpriority,1,1) AS INTEGER) AS k FROM orders),
texts AS (SELECT *, CASE k WHEN 1 THEN c//100||'.'||lpad(CAST(c%100 AS VARCHAR),2,'0')
  WHEN 2 THEN '-'||c//100||'.'||lpad(CAST(c%100 AS VARCHAR),2,'0')
  WHEN 3 THEN c//100||'.5' WHEN 4 THEN '1e3'
  ELSE c//100||'.'||lpad(CAST(c%100 AS VARCHAR),2,'0')||chr(10) END AS t FROM priced)"""


def _price_texts(spark, sf):
    text = C("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.substring("o_orderpriority", 1, 1)
    whole = F.substring_index(text, ".", 1)
    shown = (
        F.when(k == "1", text)
        .when(k == "2", F.concat(F.lit("-"), text))
        .when(k == "3", F.concat(whole, F.lit(".5")))
        .when(k == "4", "1e3")
        .otherwise(F.concat(text, F.lit("\n")))
    )
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("t"), k.alias("k"))


@query(
    "f02_parse_fixed",
    q.with_ctes(
        _PRICE_TEXT,
        select="""SELECT o_orderkey, CASE k WHEN 1 THEN c/100 WHEN 2 THEN -c/100 END AS signed,
          CASE k WHEN 1 THEN c/100 END AS unsigned FROM texts""",
    ),
)
def parse_fixed(spark, sf):
    return _price_texts(spark, sf).select(
        "o_orderkey",
        num.parse_fixed(C("t"), 2, signed=True).alias("signed"),
        num.parse_fixed(C("t"), 2, signed=False).alias("unsigned"),
    )


@query(
    "f03_parse_decimal",
    q.with_ctes(
        _PRICE_TEXT,
        select="""SELECT o_orderkey, CASE k WHEN 2 THEN -c/100 WHEN 3 THEN c//100+0.5
          WHEN 4 THEN 1000.0 ELSE c/100 END::DOUBLE AS value FROM texts""",
    ),
)
def parse_decimal(spark, sf):
    return _price_texts(spark, sf).select("o_orderkey", num.parse_decimal(C("t")).alias("value"))


_COSTS = """costs AS (SELECT event_id, event_type, CAST(round(value*100) AS BIGINT) AS c FROM events)"""


@query(
    "f04_parse_cost",
    q.with_ctes(
        _COSTS,
        select="""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL
          ELSE c/100 END AS cost FROM costs""",
    ),
)
def parse_cost(spark, sf):
    text = C("value").cast("decimal(18,2)").cast("string")
    kind = C("event_type")
    shown = (
        F.when(kind == "error", F.concat(F.lit("-"), text))
        .when(kind == "signup", "NaN")
        .when(kind == "view", F.concat(F.lit(" "), text, F.lit(" ")))
        .otherwise(text)
    )
    return table(spark, sf, "events").select("event_id", num.parse_cost(shown).alias("cost"))


@query(
    "f05_round_half_up",
    """SELECT o_orderkey, ((2*c*125+10000)//20000)/100 AS rounded,
      (-((2*c*125+10000)//20000))/100 AS negative
      FROM (SELECT o_orderkey, CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders)""",
)
def round_half_up(spark, sf):
    part = C("o_totalprice").cast("decimal(18,2)") * num.dec("0.0125")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        num.round_half_up(part).alias("rounded"),
        num.round_half_up(-part).alias("negative"),
    )


@query(
    "f06_rate4",
    """SELECT o_custkey, CASE WHEN n=0 THEN NULL ELSE ((2*10000*k+n)//(2*n))/10000 END AS urgent_rate,
      CASE WHEN k=0 THEN NULL ELSE ((2*10000*n+k)//(2*k))/10000 END AS per_urgent
      FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority='1-URGENT') AS k
            FROM orders GROUP BY o_custkey)""",
)
def rate4(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(C("o_orderpriority") == "1-URGENT").alias("k"),
    )
    return counts.select(
        "o_custkey",
        num.rate4(C("k"), C("n")).alias("urgent_rate"),
        num.rate4(C("n"), C("k")).alias("per_urgent"),
    )


@query(
    "f07_sum_tolerance",
    """SELECT l_orderkey, least(greatest(count(*),1), 100)/100 AS tolerance
      FROM lineitem GROUP BY l_orderkey""",
)
def sum_tolerance(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("l_orderkey", num.sum_tolerance(C("n")).alias("tolerance"))


@query(
    "f08_normalize_id",
    """SELECT s_suppkey, upper(regexp_replace(s_name||' 12.345/a-'||s_suppkey,'[ ./-]','','g')) AS id
      FROM supplier""",
)
def normalize_id(spark, sf):
    shown = F.concat("s_name", F.lit(" 12.345/a-"), C("s_suppkey").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", txt.normalize_id(shown).alias("id"))


@query(
    "f09_normalize_name",
    r"""SELECT doc_id, md5(trim(regexp_replace(translate(replace(lower(text),'ß','ss'),'ªº²³¹µ',
      'ao231μ'),'[^\p{L}\p{N}]+',' ','g'))) AS digest FROM documents""",
)
def normalize_name(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(txt.normalize_name(C("text"))).alias("digest")
    )


@query(
    "f10_mod11_check",
    f"""SELECT c_custkey, {q.mod11("lpad(CAST(c_custkey AS VARCHAR),12,'0')", ids.CNPJ_WEIGHTS_1)}
      ::BIGINT AS digit FROM customer""",
)
def mod11_check(spark, sf):
    base = F.lpad(C("c_custkey").cast("string"), 12, "0")
    return table(spark, sf, "customer").select(
        "c_custkey", ids.mod11_check(base, ids.CNPJ_WEIGHTS_1).alias("digit")
    )


@query(
    "f11_cnpj",
    q.with_ctes(
        *CASES_HEADERS,
        select=f"""SELECT case_id, issuer_cnpj, {q.cnpj_digits("substr(issuer_cnpj,1,12)")} AS digits,
          regexp_full_match(issuer_cnpj,'[A-Z0-9]{{12}}[0-9]{{2}}')
          AND issuer_cnpj<>repeat(substr(issuer_cnpj,1,1),14)
          AND {q.cnpj_digits("substr(issuer_cnpj,1,12)")}=substr(issuer_cnpj,13,2) AS valid
          FROM p_head""",
    ),
)
def cnpj(spark, sf):
    heads = b.answered_headers(b.true_headers(spark, sf))
    value = C("issuer.cnpj")
    digits = ids.cnpj_digits(F.rpad(F.substring(value, 1, 12), 12, "0"))
    return heads.select(
        "case_id",
        value.alias("issuer_cnpj"),
        digits.alias("digits"),
        ids.is_valid_cnpj(value).alias("valid"),
    )


@query(
    "f12_cpf",
    q.with_ctes(
        *CASES_HEADERS,
        select=f"""SELECT case_id, tax_id, regexp_full_match(tax_id,'[0-9]{{11}}')
          AND tax_id<>repeat(substr(tax_id,1,1),11)
          AND {q.cpf_digits("substr(tax_id,1,9)")}=substr(tax_id,10,2) AS valid FROM p_head""",
    ),
)
def cpf(spark, sf):
    heads = b.answered_headers(b.true_headers(spark, sf))
    value = C("recipient.tax_id")
    return heads.select("case_id", value.alias("tax_id"), ids.is_valid_cpf(value).alias("valid"))


@query(
    "f13_access_key_digit",
    q.with_ctes(
        *CASES_HEADERS,
        select=f"""SELECT case_id, regexp_full_match(access_key,'[0-9]{{6}}[A-Z0-9]{{12}}[0-9]{{26}}')
          AND CAST({q.mod11("substr(access_key,1,43)", ids.KEY_WEIGHTS)} AS VARCHAR)
            =substr(access_key,44,1) AS valid FROM p_head""",
    ),
)
def access_key_digit(spark, sf):
    heads = b.answered_headers(b.true_headers(spark, sf))
    return heads.select("case_id", ids.is_valid_access_key(C("access_key")).alias("valid"))


@query(
    "f14_split_access_key",
    q.with_ctes(
        *CASES_HEADERS,
        select="""SELECT case_id, substr(access_key,1,2) AS uf, substr(access_key,3,4) AS year_month,
          substr(access_key,7,14) AS cnpj, substr(access_key,21,2) AS model,
          substr(access_key,23,3) AS series, substr(access_key,26,9) AS number,
          substr(access_key,35,1) AS emission_type, substr(access_key,36,8) AS numeric_code,
          substr(access_key,44,1) AS check_digit FROM t_head""",
    ),
)
def split_access_key(spark, sf):
    heads = b.true_headers(spark, sf)
    return heads.select("case_id", ids.split_access_key(C("access_key")).alias("k")).select(
        "case_id", "k.*"
    )


@query("f15_make_access_key", q.with_ctes(*CASES_HEADERS, select="SELECT case_id, access_key FROM t_head"))
def make_access_key(spark, sf):
    return b.true_headers(spark, sf).select("case_id", "access_key")


@query(
    "f16_uf_code",
    q.with_ctes(
        *CASES_HEADERS,
        select=f"""SELECT case_id, issuer_uf, {q.UF_CODE_ARRAY}[list_position({q.UF_ARRAY},issuer_uf)]
          AS code FROM p_head""",
    ),
)
def uf_code(spark, sf):
    heads = b.answered_headers(b.true_headers(spark, sf))
    uf = C("issuer.uf")
    return heads.select("case_id", uf.alias("issuer_uf"), ids.uf_code(uf).alias("code"))


@query("f17_year_month", "SELECT o_orderkey, strftime(o_orderdate,'%y%m') AS aamm FROM orders")
def year_month(spark, sf):
    day = C("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", ids.year_month(day).alias("aamm"))


@query(
    "f18_digit_text",
    r"""SELECT o_orderkey, regexp_replace(upper(o_orderpriority),'[^\p{L}\p{N}]','','g') AS label,
      CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR) AS price FROM orders""",
)
def digit_text(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        txt.digit_text(C("o_orderpriority")).alias("label"),
        txt.digit_text(C("o_totalprice").cast("decimal(18,2)")).alias("price"),
    )


@query(
    "f19_significant_digits",
    """SELECT o_orderkey, trim(CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR),'0') AS digits
      FROM orders""",
)
def significant_digits(spark, sf):
    price = C("o_totalprice").cast("decimal(18,4)")
    return table(spark, sf, "orders").select(
        "o_orderkey", num.significant_digits(price).alias("digits")
    )


_EDITS = """priced AS (SELECT o_orderkey, CAST(CAST(round(o_totalprice*100) AS BIGINT) AS VARCHAR) AS a,
  CAST(substr(o_orderpriority,1,1) AS INTEGER) AS k FROM orders),
edits AS (SELECT *, CASE k WHEN 1 THEN substr(a,2,1)||substr(a,1,1)||substr(a,3) WHEN 2 THEN '0'||substr(a,2)
  WHEN 3 THEN substr(a,1,length(a)-1) WHEN 4 THEN a||'7' ELSE '99'||substr(a,3) END AS b FROM priced),
spotted AS (SELECT *, CASE WHEN length(a)=length(b) THEN list_filter(range(1,length(a)+1),
  lambda i: substr(a,i,1)<>substr(b,i,1)) END AS d FROM edits)"""


def _edits(spark, sf):
    a = (C("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint").cast("string")
    df = table(spark, sf, "orders").select(
        "o_orderkey", a.alias("a"), F.substring("o_orderpriority", 1, 1).alias("k")
    )
    a, k, one = C("a"), C("k"), F.lit(1)
    rest = F.substring(a, F.lit(3), F.length(a))
    other = (
        F.when(k == "1", F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), rest))
        .when(k == "2", F.concat(F.lit("0"), F.substring(a, F.lit(2), F.length(a))))
        .when(k == "3", F.substring(a, one, F.length(a) - 1))
        .when(k == "4", F.concat(a, F.lit("7")))
        .otherwise(F.concat(F.lit("99"), rest))
    )
    return df.select("o_orderkey", "a", other.alias("b"))


@query(
    "f20_one_transposition",
    q.with_ctes(
        _EDITS,
        select="""SELECT o_orderkey, coalesce(len(d)=2 AND d[2]=d[1]+1 AND substr(a,d[1],1)=substr(b,d[2],1)
          AND substr(a,d[2],1)=substr(b,d[1],1), false) AS hit FROM spotted""",
    ),
)
def one_transposition(spark, sf):
    return _edits(spark, sf).select(
        "o_orderkey", txt.one_transposition(C("a"), C("b")).alias("hit")
    )


@query(
    "f21_one_substitution",
    q.with_ctes(_EDITS, select="SELECT o_orderkey, coalesce(len(d)=1,false) AS hit FROM spotted"),
)
def one_substitution(spark, sf):
    return _edits(spark, sf).select("o_orderkey", txt.one_substitution(C("a"), C("b")).alias("hit"))


@query(
    "f22_one_insert_or_delete",
    q.with_ctes(
        _EDITS,
        """longer AS (SELECT *, CASE WHEN length(a)>length(b) THEN a ELSE b END AS l,
          CASE WHEN length(a)>length(b) THEN b ELSE a END AS s FROM edits)""",
        select="""SELECT o_orderkey, length(l)=length(s)+1 AND len(list_filter(range(1,length(l)+1),
          lambda i: substr(l,1,i-1)||substr(l,i+1)=s))>0 AS hit FROM longer""",
    ),
)
def one_insert_or_delete(spark, sf):
    return _edits(spark, sf).select(
        "o_orderkey", txt.one_insert_or_delete(C("a"), C("b")).alias("hit")
    )


@query("f23_text_ratio")
def text_ratio(spark, sf):
    links = b.item_links(spark, sf, positions=False)
    near = txt.text_ratio_at_least(
        txt.normalize_name(C("p.description")), txt.normalize_name(C("t.description"))
    )
    both = C("t").isNotNull() & C("p").isNotNull()
    return links.select("case_id", F.when(both, near).alias("near"))


@query(
    "f24_within_cent",
    q.with_ctes(
        q.LINKS,
        select="""SELECT case_id, pos, abs(p_total-t_total)<=1 AS near FROM links WHERE has_t AND has_p""",
    ),
)
def within_cent(spark, sf):
    links = b.item_links(spark, sf)
    both = links.filter(C("t").isNotNull() & C("p").isNotNull())
    return both.select(
        "case_id", "pos", num.within(C("p.total"), C("t.total")).alias("near")
    )


@query(
    "f25_valid_ids",
    """SELECT o_orderkey, regexp_full_match(lower(o_orderpriority),'[a-z0-9][a-z0-9-]{0,63}') AS case_id,
      regexp_full_match(o_orderpriority,'[A-Za-z0-9._-]+') AS record_id,
      regexp_full_match(o_orderpriority||chr(10),'[A-Za-z0-9._-]{1,64}') AS salt FROM orders""",
)
def valid_ids(spark, sf):
    label = C("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        ids.valid_case_id(F.lower(label)).alias("case_id"),
        ids.valid_record_id(label).alias("record_id"),
        ids.valid_salt(F.concat(label, F.lit("\n"))).alias("salt"),
    )


@query(
    "f26_canonical_sha256",
    """SELECT conv_id, turn, sha256('{"version":"1","conversation":'||conv_id||',"turn":'||turn||
      ',"role":"'||role||'","system":null,"text_sha256":"'||sha256(text)||'"}') AS key
      FROM conversations""",
)
def canonical_sha256(spark, sf):
    request = F.struct(
        F.lit("1").alias("version"),
        C("conv_id").alias("conversation"),
        "turn",
        "role",
        F.lit(None).cast("string").alias("system"),
        F.sha2("text", 256).alias("text_sha256"),
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", inv.canonical_sha256(request).alias("key")
    )


@query(
    "f27_render_hazards",
    q.with_ctes(
        q.LINKS,
        """flags AS (SELECT case_id, bool_or(t_unit='PAR') AS u,
          bool_or(t_unit_price>=1000000000 OR t_total>=10000000) AS n FROM t_items GROUP BY case_id)""",
        select="""SELECT case_id, CASE WHEN n AND u THEN 'number_wrap,unit_wrap' WHEN n THEN 'number_wrap'
          WHEN u THEN 'unit_wrap' ELSE '' END AS hazards FROM flags""",
    ),
)
def render_hazards(spark, sf):
    links = b.item_links(spark, sf, positions=False).filter(C("t").isNotNull())
    flags = links.groupBy("case_id").agg(
        F.bool_or(inv.unit_wraps(C("t.unit"), unicode=False)).alias("u"),
        F.bool_or(inv.number_wraps(C("t.unit_price"), C("t.total"))).alias("n"),
    )
    return flags.select("case_id", inv.hazard_names(C("u"), C("n")).alias("hazards"))


@query(
    "f28_field_path",
    q.with_ctes(
        q.LINKS, select="SELECT case_id, 'items['||pos||'].total' AS path FROM links WHERE has_t"
    ),
)
def field_path(spark, sf):
    items = b.true_items(b.item_links(spark, sf))
    return items.select("case_id", inv.field_path("items", C("row"), "total").alias("path"))


@query(
    "f29_length_class",
    """SELECT o_custkey, CASE WHEN count(*)<=8 THEN 'short' WHEN count(*)<=25 THEN 'medium'
      ELSE 'many_items' END AS length_class FROM orders GROUP BY o_custkey""",
)
def length_class(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("o_custkey", inv.length_class(C("n")).alias("length_class"))


@query(
    "f30_installment_split",
    q.with_ctes(
        q.CASES,
        q.INSTALLMENTS,
        select="""SELECT case_id, CAST(pos AS BIGINT) AS pos, number, CAST(t_due AS VARCHAR) AS due_date,
          t_amount/100 AS amount FROM inst""",
    ),
)
def installment_split(spark, sf):
    return b.installment_links(spark, sf).select("case_id", "pos", "t.*")
