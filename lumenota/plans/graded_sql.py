"""The graded run of ``graded.py`` as SQL common table expressions."""

from __future__ import annotations

from lumenota.operators import grading as g
from lumenota.operators import tags
from lumenota.plans import oracle_sql as q

SCALES = {name: 4 for name in ("quantity", "unit_price")}

# Header field -> SQL column of t_head / p_head.
HEADER_SQL = {field: field.replace("totals.", "") for field in g.HEADER_FIELDS} | {
    "issuer.cnpj": "issuer_cnpj",
    "issuer.name": "issuer_name",
    "issuer.ie": "issuer_ie",
    "issuer.uf": "issuer_uf",
    "recipient.tax_id": "tax_id",
    "recipient.tax_id_kind": "tax_id_kind",
    "recipient.name": "recipient_name",
    "recipient.ie": "recipient_ie",
    "recipient.uf": "recipient_uf",
}


def norm_name(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}),'[^\p{{L}}\p{{N}}]+',' ','g'))"


def norm_id(x: str) -> str:
    return f"upper(regexp_replace({x},'[ ./-]','','g'))"


def _header_right(field: str) -> str:
    t, p = f"t_{HEADER_SQL[field]}", f"p_{HEADER_SQL[field]}"
    if field in g.ID_FIELDS:
        test = f"{norm_id(p)}={norm_id(t)}"
    elif field in g.NULLABLE_ID_FIELDS:
        test = f"CASE WHEN {t} IS NULL THEN {p} IS NULL ELSE {norm_id(p)}={norm_id(t)} END"
    elif field in g.NAME_FIELDS:
        test = f"{norm_name(p)}={norm_name(t)}"
    else:
        test = f"{p}={t}"
    return f"(NOT broken AND coalesce({test},false))"


def _header_text(field: str, side: str) -> str:
    column = f"{side}_{HEADER_SQL[field]}"
    if field.startswith("totals."):
        return q.fixed(column, 2)
    return f"CAST({column} AS VARCHAR)"


def _header_wrong() -> str:
    rows = []
    for position, field in enumerate(g.HEADER_FIELDS):
        predicted = f"CASE WHEN NOT broken THEN {_header_text(field, 'p')} END"
        near = other = "false"
        if field in g.TOTAL_PATHS:
            t, p = f"t_{HEADER_SQL[field]}", f"p_{HEADER_SQL[field]}"
            boxes = ",".join(f"t_{HEADER_SQL[o]}" for o in g.TOTAL_PATHS if o != field)
            near = f"(NOT broken AND abs({p}-{t})<=1)"
            other = f"(NOT broken AND {p}<>0 AND {p} IN ({boxes}))"
        rows.append(
            f"SELECT case_id, '{field}' AS path, 'header' AS scope, '{field}' AS col, "
            f"{position} AS ordinal, CAST(NULL AS BIGINT) AS row, CAST(NULL AS BIGINT) AS prow, "
            f"CAST(NULL AS VARCHAR) AS event, {_header_text(field, 't')} AS expected, "
            f"{predicted} AS predicted, {near} AS within_cent, {other} AS other_box "
            f"FROM heads WHERE NOT {_header_right(field)}"
        )
    return f"header_wrong AS ({' UNION ALL '.join(rows)})"


def _heads() -> str:
    names = [HEADER_SQL[field] for field in g.HEADER_FIELDS if field not in g.COUNT_FIELDS]
    listed = ", ".join(f"t.{n} AS t_{n}, p.{n} AS p_{n}" for n in names)
    return f"""
gcase AS (SELECT case_id, status, status='schema_invalid' AS broken FROM cases
  WHERE status IN ('success','validation_failed','schema_invalid')),
ic AS (SELECT case_id, count(*) FILTER (has_t) AS tn, count(*) FILTER (has_p) AS pn FROM links
  GROUP BY case_id),
nc AS (SELECT case_id, count(*) AS tn, count(*) FILTER (has_p) AS pn FROM inst GROUP BY case_id),
heads AS (SELECT t.case_id, status, broken, {listed},
  coalesce(ic.tn,0) AS t_item_count, coalesce(ic.pn,0) AS p_item_count,
  coalesce(nc.tn,0) AS t_installment_count, coalesce(nc.pn,0) AS p_installment_count
  FROM t_head t JOIN p_head p USING (case_id) JOIN gcase USING (case_id)
  LEFT JOIN ic USING (case_id) LEFT JOIN nc USING (case_id)),
crossed AS (SELECT case_id, NOT broken AND (
  (p_issuer_cnpj=t_tax_id AND t_issuer_cnpj<>t_tax_id)
  OR (p_tax_id=t_issuer_cnpj AND t_issuer_cnpj<>t_tax_id)
  OR ({norm_name("p_issuer_name")}={norm_name("t_recipient_name")}
      AND {norm_name("t_issuer_name")}<>{norm_name("t_recipient_name")})
  OR ({norm_name("p_recipient_name")}={norm_name("t_issuer_name")}
      AND {norm_name("t_issuer_name")}<>{norm_name("t_recipient_name")})) AS crossover FROM heads)"""


def item_right(column: str) -> str:
    t, p = f"t_{column}", f"p_{column}"
    if column in g.TEXT_COLUMNS:
        return f"({norm_name(p)}={norm_name(t)})"
    if column in g.ID_COLUMNS:
        return f"({norm_id(p)}={norm_id(t)})"
    return f"({p}={t})"


def cell_text(column: str, side: str) -> str:
    if column in g.NUMERIC_COLUMNS:
        return q.fixed(f"{side}_{column}", SCALES.get(column, 2))
    return f"{side}_{column}"


def _item_wrong() -> str:
    rows = []
    for position, column in enumerate(g.ITEM_COLUMNS):
        t, p = f"t_{column}", f"p_{column}"
        near = other = "false"
        if column in g.NUMERIC_COLUMNS:
            cent = 100 if column in SCALES else 1
            near = f"abs({p}-{t})<={cent}"
        if column in g.ROW_MONEY_COLUMNS:
            mine = p if column in SCALES else f"{p}*100"
            others = ",".join(
                f"t_{o}" if o in SCALES else f"t_{o}*100"
                for o in g.ROW_MONEY_COLUMNS
                if o != column
            )
            other = f"({p}<>0 AND {mine} IN ({others}))"
        rows.append(
            f"SELECT case_id, 'items['||pos||'].{column}' AS path, 'item' AS scope, "
            f"'{column}' AS col, {position} AS ordinal, pos AS row, pos AS prow, "
            f"CAST(NULL AS VARCHAR) AS event, {cell_text(column, 't')} AS expected, "
            f"{cell_text(column, 'p')} AS predicted, {near} AS within_cent, {other} AS other_box "
            f"FROM matched WHERE NOT {item_right(column)}"
        )
    return f"item_cells AS ({' UNION ALL '.join(rows)})"


ROWS = f"""
matched AS (SELECT l.* FROM links l JOIN gcase USING (case_id) WHERE has_t AND has_p AND NOT broken),
lost AS (SELECT l.* FROM links l JOIN gcase USING (case_id) WHERE has_t AND (NOT has_p OR broken)),
gained AS (SELECT l.* FROM links l JOIN gcase USING (case_id)
  WHERE has_p AND NOT has_t AND NOT broken),
{_item_wrong()},
item_events AS (
  SELECT case_id, 'items['||pos||'].total' AS path, 'item' AS scope, 'total' AS col, 0 AS ordinal,
    pos AS row, CAST(NULL AS BIGINT) AS prow, 'missing' AS event, {q.fixed("t_total", 2)} AS expected,
    CAST(NULL AS VARCHAR) AS predicted, false AS within_cent, false AS other_box FROM lost
  UNION ALL
  SELECT case_id, 'items[+'||pos||'].total', 'item', 'total', 0, NULL, pos, 'extra', NULL,
    {q.fixed("p_total", 2)}, false, false FROM gained),
part_rows AS (SELECT i.*, status, broken FROM inst i JOIN gcase USING (case_id)),
part_cells AS (
  SELECT case_id, 'installments['||pos||'].due_date' AS path, 'installment' AS scope,
    'due_date' AS col, 1 AS ordinal, pos AS row, pos AS prow, CAST(NULL AS VARCHAR) AS event,
    CAST(t_due AS VARCHAR) AS expected, CAST(p_due AS VARCHAR) AS predicted, false AS within_cent,
    false AS other_box FROM part_rows WHERE has_p AND NOT broken AND t_due<>p_due
  UNION ALL
  SELECT case_id, 'installments['||pos||'].amount', 'installment', 'amount', 2, pos, pos, NULL,
    {q.fixed("t_amount", 2)}, {q.fixed("p_amount", 2)}, abs(t_amount-p_amount)<=1, false
    FROM part_rows WHERE has_p AND NOT broken AND t_amount<>p_amount
  UNION ALL
  SELECT case_id, 'installments['||pos||'].amount', 'installment', 'amount', 0, pos, NULL,
    'missing', {q.fixed("t_amount", 2)}, NULL, false, false
    FROM part_rows WHERE NOT has_p OR broken),
untyped AS (SELECT * FROM header_wrong UNION ALL SELECT * FROM item_cells UNION ALL
  SELECT * FROM item_events UNION ALL SELECT * FROM part_cells),
wrong AS (SELECT *, CASE scope WHEN 'header' THEN path IN ('access_key','issuer.cnpj',
  'recipient.tax_id','issue_date','totals.invoice_total') WHEN 'item' THEN col='total'
  ELSE col IN ('due_date','amount') END AS payment FROM untyped)"""

WRONG = (q.CASES, q.HEADERS, q.LINKS, q.INSTALLMENTS, _heads(), _header_wrong(), ROWS)

GRADED = """
per_case AS (SELECT case_id, count(*) AS wrong_count, count(*) FILTER (within_cent) AS cent_count,
  bool_or(payment) AS payment FROM wrong GROUP BY case_id),
graded AS (SELECT c.*, coalesce(wrong_count,0) AS wrong_count, coalesce(cent_count,0) AS cent_count,
  coalesce(payment,false) AS payment,
  CASE WHEN status IN ('infrastructure_failure','harness_error') THEN NULL
    ELSE status='success' AND coalesce(wrong_count,0)=0 END AS correct
  FROM cases c LEFT JOIN per_case USING (case_id))"""


def _copied() -> str:
    rows = []
    for column in tags.OTHER_ROW_COLUMNS:
        if column in ("code", "description"):
            true, mine = norm_name(f"t_{column}"), norm_name(f"m.p_{column}")
        elif column == "ncm":
            true, mine = norm_id("t_ncm"), norm_id("m.p_ncm")
        else:
            true, mine = f"CAST(t_{column} AS VARCHAR)", f"CAST(m.p_{column} AS VARCHAR)"
        zero = f" AND m.p_{column}<>0" if column in g.NUMERIC_COLUMNS else ""
        rows.append(
            f"SELECT DISTINCT m.case_id, m.pos, '{column}' AS col FROM matched m JOIN "
            f"(SELECT DISTINCT case_id, {true} AS v FROM t_items) t ON m.case_id=t.case_id "
            f"AND {mine}=t.v WHERE NOT {item_right(column)}{zero}"
        )
    return f"copied AS ({' UNION ALL '.join(rows)})"


_DIGIT_IDS = ",".join(f"'{path}'" for path in tags.HEADER_ID_PATHS)
_CASE_NUMERIC = """(event IS NULL AND CASE scope WHEN 'item' THEN col IN ('quantity','unit_price',
 'total','icms_base','icms_rate','icms_amount','ipi_rate','ipi_amount') WHEN 'installment' THEN
 col='amount' ELSE path LIKE 'totals.%' END)"""

TAGGED = f"""
gaps AS (SELECT case_id, pos, 'total' AS col, (p_total-t_total)*100 AS gap FROM matched
    WHERE p_total<>t_total AND t_total<>0
  UNION ALL SELECT case_id, pos, 'quantity', p_quantity-t_quantity FROM matched
    WHERE p_quantity<>t_quantity AND t_quantity<>0),
lost_amounts AS (SELECT case_id, pos, 'total' AS col, t_total*100 AS amount FROM lost WHERE t_total<>0
  UNION ALL SELECT case_id, pos, 'quantity', t_quantity FROM lost WHERE t_quantity<>0),
gained_amounts AS (SELECT case_id, pos, 'total' AS col, p_total*100 AS amount FROM gained
    WHERE p_total<>0
  UNION ALL SELECT case_id, pos, 'quantity', p_quantity FROM gained WHERE p_quantity<>0),
merged_cells AS (SELECT DISTINCT x.case_id, x.pos, x.col FROM gaps x JOIN lost_amounts y
  ON x.case_id=y.case_id AND x.col=y.col AND x.gap=y.amount),
merged_lost AS (SELECT DISTINCT y.case_id, y.pos FROM gaps x JOIN lost_amounts y
  ON x.case_id=y.case_id AND x.col=y.col AND x.gap=y.amount),
split_cells AS (SELECT DISTINCT x.case_id, x.pos, x.col FROM gaps x JOIN gained_amounts y
  ON x.case_id=y.case_id AND x.col=y.col AND -x.gap=y.amount),
split_gained AS (SELECT DISTINCT y.case_id, y.pos FROM gaps x JOIN gained_amounts y
  ON x.case_id=y.case_id AND x.col=y.col AND -x.gap=y.amount),
last_row AS (SELECT case_id, max(pos) AS last FROM matched GROUP BY case_id),
{_copied()},
factual AS (SELECT w.*, status, crossover,
    scope='item' AND event IS NULL AND mc.pos IS NOT NULL OR
      (scope='item' AND event='missing' AND ml.pos IS NOT NULL) AS merged,
    scope='item' AND event IS NULL AND sc.pos IS NOT NULL OR
      (scope='item' AND event='extra' AND sg.pos IS NOT NULL) AS split,
    scope='item' AND event='missing' AND row>coalesce(last,-1) AS at_tail,
    scope='item' AND event IS NULL AND co.pos IS NOT NULL AS other_row,
    {_CASE_NUMERIC} AS num,
    event IS NULL AND CASE scope WHEN 'item' THEN col IN ('ncm','cst_csosn','cfop','code')
      WHEN 'installment' THEN col='number' ELSE path IN ({_DIGIT_IDS}) END AS idl,
    event IS NULL AND CASE scope WHEN 'item' THEN col IN ('code','description','unit')
      WHEN 'header' THEN path IN ('operation_nature','issuer.name','recipient.name') ELSE false END
      AS near_text
  FROM wrong w JOIN gcase USING (case_id) JOIN crossed USING (case_id)
  LEFT JOIN (SELECT case_id, pos, col AS c2 FROM merged_cells) mc ON w.case_id=mc.case_id AND w.row=mc.pos AND w.col=mc.c2
  LEFT JOIN merged_lost ml ON w.case_id=ml.case_id AND w.row=ml.pos
  LEFT JOIN (SELECT case_id, pos, col AS c2 FROM split_cells) sc ON w.case_id=sc.case_id AND w.row=sc.pos AND w.col=sc.c2
  LEFT JOIN split_gained sg ON w.case_id=sg.case_id AND w.prow=sg.pos
  LEFT JOIN last_row lr ON w.case_id=lr.case_id
  LEFT JOIN (SELECT case_id, pos, col AS c2 FROM copied) co ON w.case_id=co.case_id AND w.row=co.pos AND w.col=co.c2),
digital AS (SELECT *, CASE WHEN num THEN TRY_CAST(predicted AS DECIMAL(38,10)) END AS np,
  CASE WHEN num THEN TRY_CAST(expected AS DECIMAL(38,10)) END AS ne,
  CASE WHEN num OR idl THEN regexp_replace(upper(predicted),'[^A-Z0-9]','','g') END AS a,
  CASE WHEN num OR idl THEN regexp_replace(upper(expected),'[^A-Z0-9]','','g') END AS b FROM factual),
spotted2 AS (SELECT *, CASE WHEN length(a)=length(b) THEN list_filter(range(1,length(a)+1),
    lambda i: substr(a,i,1)<>substr(b,i,1)) END AS d,
  CASE WHEN length(a)>length(b) THEN a ELSE b END AS lo,
  CASE WHEN length(a)>length(b) THEN b ELSE a END AS sh FROM digital),
first_rules AS (SELECT *, CASE
  WHEN scope='header' AND col IN ('item_count','installment_count') AND status<>'schema_invalid' THEN 18
  WHEN status='schema_invalid' THEN 0
  WHEN crossover AND (path LIKE 'issuer.%' OR path LIKE 'recipient.%') THEN 1
  WHEN merged THEN 2 WHEN split THEN 3 WHEN at_tail THEN 4 WHEN event='missing' THEN 5
  WHEN event='extra' THEN 6 WHEN other_row THEN 7 WHEN other_box THEN 8
  WHEN np<>0 AND np<>ne AND trim(regexp_replace(CAST(np AS VARCHAR),'[^0-9]','','g'),'0')
    =trim(regexp_replace(CAST(ne AS VARCHAR),'[^0-9]','','g'),'0') THEN 9
  WHEN np=0 AND ne<>0 THEN 10
  WHEN len(d)=2 AND d[2]=d[1]+1 AND substr(a,d[1],1)=substr(b,d[2],1)
    AND substr(a,d[2],1)=substr(b,d[1],1) THEN 11
  WHEN len(d)=1 THEN 12
  WHEN length(lo)=length(sh)+1 AND len(list_filter(range(1,length(lo)+1),
    lambda i: substr(lo,1,i-1)||substr(lo,i+1)=sh))>0 THEN 13
  WHEN near_text AND predicted IS NOT NULL AND expected IS NOT NULL THEN 15
  WHEN scope='header' AND path IN ('issuer.uf','recipient.uf','recipient.tax_id_kind')
    AND predicted IS NOT NULL AND expected IS NOT NULL THEN 15
  WHEN scope='item' AND event IS NULL AND col IN ('cst_csosn','cfop','ncm') THEN 16
  WHEN event IS NULL AND ((scope='installment' AND col='due_date') OR path='issue_date') THEN 17
  ELSE 18 END AS first_rule FROM spotted2),
event_rules AS (SELECT case_id, scope||'_count' AS col,
  first(first_rule ORDER BY (event='extra'), coalesce(row,prow)) AS event_rule
  FROM first_rules WHERE event IS NOT NULL GROUP BY ALL),
tagged AS (SELECT f.*, CASE WHEN f.scope='header' AND f.col IN ('item_count','installment_count')
  AND status<>'schema_invalid' THEN coalesce(event_rule,18) ELSE first_rule END AS rule
  FROM first_rules f LEFT JOIN event_rules e ON f.case_id=e.case_id AND f.col=e.col)"""

TAG_LIST = "[" + ",".join(f"'{tag}'" for tag in tags.TAG_ORDER) + "]"
