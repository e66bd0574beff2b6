"""The bindings again as SQL common table expressions, for checking against another engine.

Amounts are integers here (cents, ten-thousandths), so nothing depends on an engine's decimal
division.
"""

from __future__ import annotations

from lumenota.functions import identifiers as ids
from lumenota.plans.bindings import DATE_SHIFT_DAYS, SEGMENTS, UF_LIST

UF_ARRAY = "[" + ",".join(f"'{uf}'" for uf in UF_LIST) + "]"
UF_CODE_ARRAY = "[" + ",".join(f"'{ids.UF_CODES[uf]}'" for uf in UF_LIST) + "]"


def mod11(text: str, weights: tuple[int, ...]) -> str:
    """The mod-11 digit of ``text`` as an integer expression."""
    listed = "[" + ",".join(str(weight) for weight in weights) + "]"
    total = (
        f"list_sum(list_transform(range(1,{len(weights) + 1}), "
        f"lambda i: (ascii(substr({text},i,1))-48)*{listed}[i]))"
    )
    return f"(((11-(({total})%11))%11)%10)::INTEGER"


def two_digits(base: str, first: tuple[int, ...], second: tuple[int, ...]) -> str:
    digit = f"CAST({mod11(base, first)} AS VARCHAR)"
    longer = f"({base}||{digit})"
    return f"({digit}||CAST({mod11(longer, second)} AS VARCHAR))"


def cnpj_digits(base: str) -> str:
    return two_digits(base, ids.CNPJ_WEIGHTS_1, ids.CNPJ_WEIGHTS_2)


def cpf_digits(base: str) -> str:
    return two_digits(base, ids.CPF_WEIGHTS_1, ids.CPF_WEIGHTS_2)


def half_up(numerator: str, denominator: str) -> str:
    """Integer division rounded half up, for non-negative operands."""
    return f"((2*({numerator})+({denominator}))//(2*({denominator})))"


def fixed(value: str, places: int) -> str:
    """The text of an integer amount with ``places`` decimals."""
    scale = 10**places
    sign = f"CASE WHEN ({value})<0 THEN '-' ELSE '' END"
    return (
        f"({sign}||CAST(abs({value})//{scale} AS VARCHAR)||'.'||"
        f"lpad(CAST(abs({value})%{scale} AS VARCHAR),{places},'0'))"
    )


LINKS = """
lines AS (
  SELECT l.*, p.p_name, p.p_brand, p.p_type, p.p_size,
    CAST(round(l_tax*100) AS INTEGER)*11 + CAST(round(l_discount*100) AS INTEGER) AS f,
    CAST(round(l_tax*10000) AS BIGINT) AS rc, CAST(round(l_discount*10000) AS BIGINT) AS pc,
    CAST(round(l_extendedprice*100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS pieces
  FROM lineitem l JOIN part p ON l_partkey=p_partkey),
slotted AS (
  SELECT *, unnest(CASE WHEN f IN (2,23,24) THEN [0,1] ELSE [0] END) AS slot FROM lines),
based AS (
  SELECT *, 'P'||l_partkey AS b_code, p_name||' '||p_brand||' '||p_type AS b_description,
    lpad(CAST(p_size AS VARCHAR),8,'0') AS b_ncm,
    CASE WHEN l_returnflag='A' THEN '000' WHEN l_returnflag='R' AND l_linestatus='F' THEN '041'
         WHEN l_returnflag='R' THEN '010' WHEN l_linestatus='O' THEN '0102' ELSE '020' END AS cst,
    CASE WHEN l_linestatus='O' THEN '5102' ELSE '6102' END AS cfop,
    CASE p_type WHEN 'ECONOMY' THEN 'UN' WHEN 'PROMO' THEN 'PAR' WHEN 'LARGE' THEN 'CX'
         ELSE 'KG' END AS b_unit,
    pieces*10000 AS b_q, (c*200+pieces)//(pieces*2) AS b_u
  FROM slotted),
amounts AS (
  SELECT *, (slot=1 AND f=23) AS adj,
    CASE WHEN cst IN ('041','0102') THEN 0 ELSE (2*c*rc+10000)//20000 END AS b_ia,
    (2*c*pc+10000)//20000 AS b_pa,
    CASE WHEN cst IN ('041','0102') THEN 0 ELSE (2*750*rc+10000)//20000 END AS a_ia,
    (2*750*pc+10000)//20000 AS a_pa,
    (slot=0 OR f=23) AS has_t,
    ((slot=0 AND f NOT IN (1,12)) OR (slot=1 AND f IN (2,24))) AS has_p,
    (slot=1 AND f=2) AS inv
  FROM based),
links AS (
  SELECT l_orderkey AS case_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey,
      l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
      slot) - 1 AS pos, has_t, has_p,
    CASE WHEN adj THEN b_code||'B' ELSE b_code END AS t_code,
    CASE WHEN adj THEN 'adjunct '||b_description ELSE b_description END AS t_description,
    b_ncm AS t_ncm, cst AS t_cst_csosn, cfop AS t_cfop, b_unit AS t_unit,
    CASE WHEN adj THEN 30000 ELSE b_q END AS t_quantity,
    CASE WHEN adj THEN 25000 ELSE b_u END AS t_unit_price,
    CASE WHEN adj THEN 750 ELSE c END AS t_total,
    CASE WHEN adj THEN 750 ELSE c END AS t_icms_base,
    rc AS t_icms_rate,
    CASE WHEN adj THEN a_ia ELSE b_ia END AS t_icms_amount,
    pc AS t_ipi_rate,
    CASE WHEN adj THEN a_pa ELSE b_pa END AS t_ipi_amount,
    CASE WHEN inv THEN 'NOROW-1' WHEN f=36 THEN 'Q'||substr(b_code,2) ELSE b_code END AS p_code,
    CASE WHEN inv THEN 'row of no invoice' WHEN f=38 THEN substr(b_description,1,length(b_description)-1)
         WHEN f=39 THEN 'unreadable' ELSE b_description END AS p_description,
    CASE WHEN inv THEN '00112233' WHEN f=37 THEN substr(b_ncm,1,7) ELSE b_ncm END AS p_ncm,
    CASE WHEN f=40 THEN '9999' ELSE cst END AS p_cst_csosn,
    CASE WHEN f=50 THEN '9999' ELSE cfop END AS p_cfop,
    CASE WHEN inv THEN 'CX' WHEN f=41 THEN 'ZZ' ELSE b_unit END AS p_unit,
    CASE WHEN inv THEN 60000 WHEN slot=1 AND f=24 THEN b_q - b_q//2 WHEN f=23 THEN b_q+30000
         WHEN f=24 THEN b_q//2 WHEN f=3 THEN b_q*10 WHEN f BETWEEN 45 AND 49 THEN 250000
         ELSE b_q END AS p_quantity,
    CASE WHEN inv THEN 85000 WHEN f=44 THEN b_u+29418300 ELSE b_u END AS p_unit_price,
    CASE WHEN inv THEN 5100 WHEN slot=1 AND f=24 THEN c - c//2 WHEN f=23 THEN c+750
         WHEN f=24 THEN c//2 WHEN f=35 THEN (c//100)*100 + (c%10)*10 + (c//10)%10
         WHEN f=43 THEN c+1 ELSE c END AS p_total,
    CASE WHEN inv THEN 5100 ELSE c END AS p_icms_base, rc AS p_icms_rate,
    CASE WHEN inv OR f=34 THEN 0 WHEN f=42 THEN c ELSE b_ia END AS p_icms_amount,
    pc AS p_ipi_rate,
    CASE WHEN f=51 THEN b_pa*100 ELSE b_pa END AS p_ipi_amount
  FROM amounts),
t_items AS (SELECT * FROM links WHERE has_t),
p_items AS (SELECT * FROM links WHERE has_p)
"""


def _segment_case() -> str:
    parts = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(SEGMENTS))
    return f"CASE c_mktsegment {parts} END"


STATUS = """CASE WHEN g BETWEEN 45 AND 49 THEN 'validation_failed' WHEN g BETWEEN 50 AND 54 THEN
 'refused' WHEN g BETWEEN 55 AND 59 THEN 'truncated' WHEN g BETWEEN 60 AND 64 THEN
 'schema_invalid' WHEN g BETWEEN 65 AND 69 THEN 'infrastructure_failure' WHEN g BETWEEN 70 AND 74
 THEN 'harness_error' ELSE 'success' END"""

CASES = f"""
ordered AS (
  SELECT o.*, c_name, c_nationkey, c_mktsegment, c_custkey,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 25
    + (CAST(substr(o_orderpriority,1,1) AS INTEGER)-1)*5 + {_segment_case()} AS g
  FROM orders o JOIN customer c ON o_custkey=c_custkey),
cases AS (
  SELECT o_orderkey AS case_id, o_custkey AS base_case, g, {STATUS} AS status,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING') THEN 'dev' ELSE 'test' END AS split,
    CASE c_nationkey%5 WHEN 0 THEN 'text' WHEN 1 THEN 'image_clean' WHEN 2 THEN 'rotation'
      WHEN 3 THEN 'blur' ELSE 'barcode_damaged' END AS rendering,
    CASE c_nationkey%5 WHEN 2 THEN 'mild' WHEN 3 THEN 'severe' END AS severity,
    c_mktsegment <> 'FURNITURE' AS barcode_readable,
    list_filter([CASE WHEN o_orderstatus='F' THEN 'regime_normal' ELSE 'simples_nacional' END,
      CASE WHEN c_mktsegment='HOUSEHOLD' THEN 'cpf_recipient' END,
      CASE WHEN o_totalprice<150000 THEN 'short' WHEN o_totalprice<350000 THEN 'medium'
           ELSE 'many_items' END,
      CASE WHEN o_totalprice>=350000 THEN 'multi_page' ELSE 'single_page' END,
      CASE WHEN c_mktsegment='MACHINERY' THEN 'mixed_tax_codes' END], lambda x: x IS NOT NULL) AS tags
  FROM ordered)
"""

_ISSUER_BASE = "(lpad(CAST(o_custkey AS VARCHAR),8,'0')||'0001')"
_CNPJ_BASE = "(lpad(CAST(o_orderkey AS VARCHAR),8,'0')||'0002')"
_CPF_BASE = "lpad(CAST(o_orderkey AS VARCHAR),9,'0')"

HEADERS = f"""
identified AS (
  SELECT *, {_ISSUER_BASE}||{cnpj_digits(_ISSUER_BASE)} AS issuer_cnpj,
    CASE WHEN c_mktsegment='HOUSEHOLD' THEN {_CPF_BASE}||{cpf_digits(_CPF_BASE)}
         ELSE {_CNPJ_BASE}||{cnpj_digits(_CNPJ_BASE)} END AS tax_id,
    {UF_ARRAY}[c_nationkey+1] AS issuer_uf, {UF_ARRAY}[c_nationkey+2] AS recipient_uf,
    CAST(o_orderdate AS DATE) + {DATE_SHIFT_DAYS} AS issue_date,
    CAST(round(o_totalprice*100) AS BIGINT) AS products
  FROM ordered),
keyed AS (
  SELECT *, {UF_CODE_ARRAY}[c_nationkey+1]||strftime(issue_date,'%y%m')||issuer_cnpj||'55'
    ||lpad(CAST(c_nationkey+1 AS VARCHAR),3,'0')||lpad(CAST(o_orderkey AS VARCHAR),9,'0')||'1'
    ||lpad(CAST(o_custkey AS VARCHAR),8,'0') AS body
  FROM identified),
t_head AS (
  SELECT o_orderkey AS case_id, o_custkey AS base_case, g,
    body||CAST({mod11("body", ids.KEY_WEIGHTS)} AS VARCHAR) AS access_key,
    CAST(o_orderkey AS INTEGER) AS number, c_nationkey+1 AS series, issue_date,
    'VENDA '||o_orderpriority AS operation_nature, issuer_cnpj, c_name AS issuer_name,
    CASE WHEN c_mktsegment<>'BUILDING' THEN 'IE'||c_custkey END AS issuer_ie, issuer_uf, tax_id,
    CASE WHEN c_mktsegment='HOUSEHOLD' THEN 'cpf' ELSE 'cnpj' END AS tax_id_kind,
    'Buyer '||o_orderkey AS recipient_name, CAST(NULL AS VARCHAR) AS recipient_ie, recipient_uf,
    0 AS icms_base, 1800 AS icms_amount, 0 AS icms_st_base, 0 AS icms_st_amount,
    products AS products_total, 1000 AS freight, 0 AS insurance, 500 AS discount,
    0 AS other_expenses, 0 AS ipi_amount, products+500 AS invoice_total
  FROM keyed),
p_head AS (
  SELECT case_id, base_case, g,
    CASE g WHEN 5 THEN substr(access_key,1,43) WHEN 19 THEN substr(access_key,1,20)||'65'||
      substr(access_key,23) WHEN 22 THEN 'x'||substr(access_key,2) ELSE access_key END AS access_key,
    CASE WHEN g=8 THEN number+1 ELSE number END AS number,
    CASE WHEN g=14 THEN series+1 ELSE series END AS series,
    CASE WHEN g=4 THEN issue_date+1 WHEN g=21 THEN DATE '2004-01-01' ELSE issue_date END AS issue_date,
    CASE WHEN g=6 THEN 'DEVOLUCAO' ELSE operation_nature END AS operation_nature,
    CASE g WHEN 0 THEN substr(issuer_cnpj,1,6)||substr(issuer_cnpj,8,1)||substr(issuer_cnpj,7,1)||
      substr(issuer_cnpj,9) WHEN 1 THEN tax_id ELSE issuer_cnpj END AS issuer_cnpj,
    CASE g WHEN 1 THEN recipient_name WHEN 12 THEN substr(issuer_name,1,length(issuer_name)-1)
      ELSE issuer_name END AS issuer_name,
    CASE WHEN g=7 AND issuer_ie IS NULL THEN 'X' WHEN g<>7 THEN issuer_ie END AS issuer_ie,
    CASE WHEN g=15 THEN 'XX' WHEN g=29 AND issuer_uf='SP' THEN 'RJ' WHEN g=29 THEN 'SP'
      ELSE issuer_uf END AS issuer_uf,
    CASE g WHEN 1 THEN issuer_cnpj WHEN 16 THEN 'abc' WHEN 28 THEN '123' WHEN 17 THEN substr(tax_id,1,length(tax_id)-1)
      ||CASE WHEN right(tax_id,1)='0' THEN '1' ELSE '0' END
      WHEN 18 THEN repeat('1',length(tax_id)) ELSE tax_id END AS tax_id,
    CASE WHEN g=20 AND tax_id_kind='cpf' THEN 'cnpj' WHEN g=20 THEN 'cpf' ELSE tax_id_kind END
      AS tax_id_kind,
    CASE WHEN g=1 THEN issuer_name ELSE recipient_name END AS recipient_name, recipient_ie,
    CASE WHEN g=11 THEN 'ZZ' ELSE recipient_uf END AS recipient_uf,
    icms_base, CASE WHEN g=13 THEN icms_amount+294183 ELSE icms_amount END AS icms_amount,
    icms_st_base, icms_st_amount, products_total,
    CASE WHEN g=9 THEN products_total ELSE freight END AS freight, insurance,
    CASE WHEN g=10 THEN 0 ELSE discount END AS discount, other_expenses, ipi_amount,
    CASE g WHEN 2 THEN invoice_total+1 WHEN 3 THEN invoice_total*100 ELSE invoice_total END
      AS invoice_total
  FROM t_head)
"""

INSTALLMENTS = f"""
counted AS (
  SELECT *, CAST(substr(o_orderpriority,1,1) AS INTEGER) AS n,
    CAST(round(o_totalprice*100) AS BIGINT)+500 AS c,
    CAST(o_orderdate AS DATE) + {DATE_SHIFT_DAYS} AS issued FROM ordered),
shared AS (SELECT *, (2*c+n)//(2*n) AS share, unnest(range(0,n)) AS pos FROM counted),
inst AS (
  SELECT o_orderkey AS case_id, g, pos, lpad(CAST(pos+1 AS VARCHAR),3,'0') AS number,
    issued + CAST((pos+1)*30 AS INTEGER) AS t_due,
    CASE WHEN pos+1<n THEN share ELSE c-share*(n-1) END AS t_amount,
    NOT (g=23 AND pos=0) AS has_p,
    issued + CAST((pos+1)*30 AS INTEGER) + CASE g WHEN 24 THEN 1 WHEN 25 THEN -60 ELSE 0 END AS p_due,
    CASE WHEN pos+1<n THEN share ELSE c-share*(n-1) END - CASE WHEN g=26 THEN 200 ELSE 0 END AS p_amount
  FROM shared)
"""


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",".join(part.strip() for part in parts) + "\n" + select.strip()
