"""Invoices of our own making, as nested rows and as XML."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from lumenota.operators.rules import INSTALLMENT_FIELDS, ITEM_FIELDS, ITEM_TEXT, TOTAL_FIELDS

D = Decimal
_NUMBERS = {"quantity": "decimal(18,4)", "unit_price": "decimal(18,4)", "icms_rate": "decimal(9,2)",
            "ipi_rate": "decimal(9,2)"}
ITEM_TYPE = ",".join(
    f"{n}:{'string' if n in ITEM_TEXT else _NUMBERS.get(n, 'decimal(18,2)')}" for n in ITEM_FIELDS
)
SCHEMA = (
    "case_id bigint, access_key string, number int, series int, issue_date date, "
    "operation_nature string, issuer struct<cnpj:string,name:string,ie:string,uf:string>, "
    "recipient struct<tax_id:string,tax_id_kind:string,name:string,ie:string,uf:string>, "
    f"items array<struct<{ITEM_TYPE}>>, "
    f"totals struct<{','.join(f'{n}:decimal(18,2)' for n in TOTAL_FIELDS)}>, "
    "installments array<struct<number:string,due_date:date,amount:decimal(18,2)>>"
)


def mod11(text: str, weights) -> int:
    rest = sum((ord(c) - 48) * w for c, w in zip(text, weights)) % 11
    return 0 if rest < 2 else 11 - rest


def cnpj(base: str) -> str:
    first = mod11(base, (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
    second = mod11(base + str(first), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
    return f"{base}{first}{second}"


def access_key(uf: str, month: str, owner: str, series: int, number: int) -> str:
    body = f"{uf}{month}{owner}55{series:03d}{number:09d}1{number:08d}"
    weights = [2 + (42 - i) % 8 for i in range(43)]
    return body + str(mod11(body, weights))


NAMES = ("PARAFUSO SEXTAVADO", "MANGUEIRA DE JARDIM", "REGISTRO DE ESFERA", "FITA ADESIVA LARGA",
         "RESMA DE PAPEL A4", "CABO FLEXIVEL AZUL", "LUMINARIA DE MESA")


def item(case: int, i: int) -> dict:
    quantity, price = D(f"{3 + i}.0000"), D(f"{17 + 10 * i + case}.2500")
    total = (quantity * price).quantize(D("0.01"))
    icms = (total * D("18") / 100).quantize(D("0.01"), rounding="ROUND_HALF_UP")
    return {
        "code": f"C{case}{i:02d}7", "description": f"{NAMES[i % 7]} {case}{i}",
        "ncm": f"{73180000 + 131 * i + case}", "cst_csosn": "000", "cfop": "5102", "unit": "UN",
        "quantity": quantity, "unit_price": price, "total": total, "icms_base": total,
        "icms_rate": D("18.00"), "icms_amount": icms, "ipi_rate": D("0.00"),
        "ipi_amount": D("0.00"),
    }


def invoice(case: int, rows: int = 6) -> dict:
    items = [item(case, i) for i in range(rows)]
    products = sum((x["total"] for x in items), D(0))
    icms = sum((x["icms_amount"] for x in items), D(0))
    owner = cnpj(f"1234{case:04d}0001")
    day = dt.date(2026, 3, 16)
    total = products + D("12.00")
    half = (total / 2).quantize(D("0.01"))
    boxes = dict.fromkeys(TOTAL_FIELDS, D("0.00")) | {
        "icms_base": products, "icms_amount": icms, "products_total": products,
        "freight": D("12.00"), "invoice_total": total,
    }
    return {
        "case_id": case, "access_key": access_key("35", "2603", owner, 6, 900 + case),
        "number": 900 + case, "series": 6, "issue_date": day,
        "operation_nature": "VENDA DE MERCADORIA",
        "issuer": {"cnpj": owner, "name": f"Silva Serviços {case} LTDA", "ie": "1071823", "uf": "SP"},
        "recipient": {"tax_id": cnpj(f"9876{case:04d}0002"), "tax_id_kind": "cnpj",
                      "name": f"Rodrigues Indústria {case} SA", "ie": None, "uf": "RJ"},
        "items": items, "totals": boxes,
        "installments": [
            {"number": "001", "due_date": day + dt.timedelta(30), "amount": half},
            {"number": "002", "due_date": day + dt.timedelta(60), "amount": total - half},
        ],
    }


def frame(spark, invoices: list[dict]):
    return spark.createDataFrame(invoices, SCHEMA)


def xml(data: dict) -> str:
    def fields(pairs):
        return "".join(f"<{name}>{value}</{name}>" for name, value in pairs if value is not None)

    det = "".join(
        f"<det nItem='{n}'><prod>"
        + fields([("cProd", x["code"]), ("xProd", x["description"]), ("NCM", x["ncm"]),
                  ("CFOP", x["cfop"]), ("uCom", x["unit"]), ("qCom", x["quantity"]),
                  ("vUnCom", x["unit_price"]), ("vProd", x["total"])])
        + "</prod><imposto><ICMS><ICMS00><orig>0</orig><CST>00</CST>"
        + fields([("vBC", x["icms_base"]), ("pICMS", x["icms_rate"]), ("vICMS", x["icms_amount"])])
        + "</ICMS00></ICMS></imposto></det>"
        for n, x in enumerate(data["items"], start=1)
    )
    t, dest, emit = data["totals"], data["recipient"], data["issuer"]
    boxes = fields([("vBC", t["icms_base"]), ("vICMS", t["icms_amount"]),
                    ("vProd", t["products_total"]), ("vFrete", t["freight"]),
                    ("vNF", t["invoice_total"])])
    dups = "".join(
        "<dup>" + fields([("nDup", d["number"]), ("dVenc", d["due_date"]), ("vDup", d["amount"])])
        + "</dup>"
        for d in data["installments"]
    )
    return (
        '<?xml version="1.0" encoding="UTF-8"?>'
        '<nfeProc xmlns="http://www.portalfiscal.inf.br/nfe"><NFe>'
        f'<infNFe Id="NFe{data["access_key"]}"><ide>'
        + fields([("nNF", data["number"]), ("serie", data["series"]),
                  ("dhEmi", f"{data['issue_date']}T23:50:00-03:00"),
                  ("natOp", data["operation_nature"])])
        + "</ide><emit>" + fields([("CNPJ", emit["cnpj"]), ("xNome", emit["name"]),
                                   ("IE", emit["ie"]), ("CRT", "3")])
        + f"<enderEmit><UF>{emit['uf']}</UF></enderEmit></emit><dest>"
        + fields([("CNPJ", dest["tax_id"]), ("xNome", dest["name"])])
        + f"<enderDest><UF>{dest['uf']}</UF></enderDest></dest>{det}"
        + f"<total><ICMSTot>{boxes}</ICMSTot></total><cobr>{dups}</cobr></infNFe></NFe></nfeProc>"
    )


__all__ = ["INSTALLMENT_FIELDS", "SCHEMA", "access_key", "cnpj", "frame", "invoice", "xml"]
