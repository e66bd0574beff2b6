"""Electronic invoice XML to typed invoice rows, and the rows that cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenota.operators.rules import TOTAL_FIELDS

# The ICMS groups of an item, and the totals box of each total element.
ICMS_GROUPS = (
    "ICMS00", "ICMS10", "ICMS20", "ICMS30", "ICMS40", "ICMS51", "ICMS60", "ICMS70", "ICMS90",
    "ICMSSN101", "ICMSSN102", "ICMSSN201", "ICMSSN202", "ICMSSN500", "ICMSSN900",
)
TOTAL_ELEMENTS = {
    "icms_base": "vBC",
    "icms_amount": "vICMS",
    "icms_st_base": "vBCST",
    "icms_st_amount": "vST",
    "products_total": "vProd",
    "freight": "vFrete",
    "insurance": "vSeg",
    "discount": "vDesc",
    "other_expenses": "vOutro",
    "ipi_amount": "vIPI",
    "invoice_total": "vNF",
}
_GROUP = "struct<orig:string,CST:string,CSOSN:string,vBC:string,pICMS:string,vICMS:string>"
_ICMS = ",".join(f"{name}:{_GROUP}" for name in ICMS_GROUPS)
_BOXES = ",".join(f"{element}:string" for element in TOTAL_ELEMENTS.values())
NFE_SCHEMA = f"""
_Id string,
ide struct<nNF:string,serie:string,dhEmi:string,natOp:string>,
emit struct<CNPJ:string,xNome:string,IE:string,CRT:string,enderEmit:struct<UF:string>>,
dest struct<CNPJ:string,CPF:string,xNome:string,IE:string,enderDest:struct<UF:string>>,
det array<struct<prod:struct<cProd:string,xProd:string,NCM:string,CFOP:string,uCom:string,
  qCom:string,vUnCom:string,vProd:string>,
  imposto:struct<ICMS:struct<{_ICMS}>,IPI:struct<IPITrib:struct<pIPI:string,vIPI:string>>>>>,
total struct<ICMSTot:struct<{_BOXES}>>,
cobr struct<dup:array<struct<nDup:string,dVenc:string,vDup:string>>>
"""

MONEY, FINE, RATE = "decimal(18,2)", "decimal(18,4)", "decimal(9,2)"


def _text(col: Column) -> Column:
    """Trimmed text; an empty element reads as absent."""
    trimmed = F.trim(col)
    return F.when(trimmed != "", trimmed)


def _number(col: Column, kind: str) -> Column:
    """A decimal rounded half up to its type; null for malformed text."""
    places = int(kind[:-1].split(",")[1])
    return F.round(_text(col).try_cast("decimal(38,10)"), places).try_cast(kind)


def _or_zero(col: Column, kind: str) -> Column:
    """As ``_number``; an absent tax element is zero."""
    return F.when(_text(col).isNull(), F.lit(0).cast(kind)).otherwise(_number(col, kind))


def _groups(det: Column) -> Column:
    """The ICMS groups present in an item."""
    return F.array_compact(F.array(*[det["imposto"]["ICMS"][name] for name in ICMS_GROUPS]))


def _tax_code(group: Column, crt: Column) -> Column:
    code = F.when(crt.isin("1", "4"), _text(group["CSOSN"])).otherwise(_text(group["CST"]))
    return F.concat(_text(group["orig"]), code)


def _item(det: Column, crt: Column) -> Column:
    prod, group = det["prod"], F.try_element_at(_groups(det), F.lit(1))
    ipi = det["imposto"]["IPI"]["IPITrib"]
    return F.struct(
        _text(prod["cProd"]).alias("code"),
        _text(prod["xProd"]).alias("description"),
        _text(prod["NCM"]).alias("ncm"),
        _tax_code(group, crt).alias("cst_csosn"),
        _text(prod["CFOP"]).alias("cfop"),
        _text(prod["uCom"]).alias("unit"),
        _number(prod["qCom"], FINE).alias("quantity"),
        _number(prod["vUnCom"], FINE).alias("unit_price"),
        _number(prod["vProd"], MONEY).alias("total"),
        _or_zero(group["vBC"], MONEY).alias("icms_base"),
        _or_zero(group["pICMS"], RATE).alias("icms_rate"),
        _or_zero(group["vICMS"], MONEY).alias("icms_amount"),
        _or_zero(ipi["pIPI"], RATE).alias("ipi_rate"),
        _or_zero(ipi["vIPI"], MONEY).alias("ipi_amount"),
    )


def _installment(dup: Column) -> Column:
    return F.struct(
        _text(dup["nDup"]).alias("number"),
        _text(dup["dVenc"]).try_cast("date").alias("due_date"),
        _number(dup["vDup"], MONEY).alias("amount"),
    )


def invoice_columns(nfe: Column) -> list[Column]:
    """The invoice members of a parsed ``infNFe`` struct."""
    emit, dest, ide = nfe["emit"], nfe["dest"], nfe["ide"]
    crt = _text(emit["CRT"])
    cnpj, cpf = _text(dest["CNPJ"]), _text(dest["CPF"])
    boxes = nfe["total"]["ICMSTot"]
    return [
        F.regexp_replace(nfe["_Id"], r"\ANFe", "").alias("access_key"),
        _text(ide["nNF"]).try_cast("int").alias("number"),
        _text(ide["serie"]).try_cast("int").alias("series"),
        # The printed local date: never through a time zone.
        F.substring(_text(ide["dhEmi"]), 1, 10).try_cast("date").alias("issue_date"),
        _text(ide["natOp"]).alias("operation_nature"),
        F.struct(
            _text(emit["CNPJ"]).alias("cnpj"),
            _text(emit["xNome"]).alias("name"),
            _text(emit["IE"]).alias("ie"),
            _text(emit["enderEmit"]["UF"]).alias("uf"),
        ).alias("issuer"),
        F.struct(
            F.coalesce(cnpj, cpf).alias("tax_id"),
            F.when(cnpj.isNotNull(), "cnpj").when(cpf.isNotNull(), "cpf").alias("tax_id_kind"),
            _text(dest["xNome"]).alias("name"),
            _text(dest["IE"]).alias("ie"),
            _text(dest["enderDest"]["UF"]).alias("uf"),
        ).alias("recipient"),
        F.coalesce(F.transform(nfe["det"], lambda det: _item(det, crt)), F.array()).alias("items"),
        F.struct(
            *[_or_zero(boxes[TOTAL_ELEMENTS[name]], MONEY).alias(name) for name in TOTAL_FIELDS]
        ).alias("totals"),
        F.coalesce(F.transform(nfe["cobr"]["dup"], _installment), F.array()).alias("installments"),
    ]


def _need(value: Column, element: str) -> Column:
    return F.when(value.isNull(), F.lit(element))


def _bad_number(col: Column, kind: str, element: str) -> Column:
    return F.when(_text(col).isNotNull() & _number(col, kind).isNull(), F.lit(element))


def _item_problems(det: Column, crt: Column) -> Column:
    prod, groups = det["prod"], _groups(det)
    group = F.try_element_at(groups, F.lit(1))
    ipi = det["imposto"]["IPI"]["IPITrib"]
    code = F.when(crt.isin("1", "4"), F.lit("CSOSN")).otherwise("CST")
    missing = [
        _need(_text(prod[name]), name)
        for name in ("cProd", "xProd", "NCM", "CFOP", "uCom", "qCom", "vUnCom", "vProd")
    ]
    numbers = [
        _bad_number(prod["qCom"], FINE, "qCom"),
        _bad_number(prod["vUnCom"], FINE, "vUnCom"),
        _bad_number(prod["vProd"], MONEY, "vProd"),
        _bad_number(group["vBC"], MONEY, "vBC"),
        _bad_number(group["pICMS"], RATE, "pICMS"),
        _bad_number(group["vICMS"], MONEY, "vICMS"),
        _bad_number(ipi["pIPI"], RATE, "pIPI"),
        _bad_number(ipi["vIPI"], MONEY, "vIPI"),
    ]
    one_group = F.size(groups) == 1
    shape = [
        F.when(~one_group, F.lit("imposto/ICMS")),
        F.when(one_group & _text(group["orig"]).isNull(), F.lit("orig")),
        F.when(
            one_group & _text(group["orig"]).isNotNull() & _tax_code(group, crt).isNull(), code
        ),
    ]
    return F.array_compact(F.array(*missing, *shape, *numbers))


def problem_column(nfe: Column) -> Column:
    """The names of the elements that are missing or malformed, in document order."""
    emit, dest, ide = nfe["emit"], nfe["dest"], nfe["ide"]
    crt = _text(emit["CRT"])
    identified = F.coalesce(_text(dest["CNPJ"]), _text(dest["CPF"]))
    boxes = nfe["total"]["ICMSTot"]
    day = F.substring(_text(ide["dhEmi"]), 1, 10)
    header = [
        _need(F.when(nfe["_Id"] != "", nfe["_Id"]), "infNFe/@Id"),
        _need(_text(ide["nNF"]).try_cast("int"), "ide/nNF"),
        _need(_text(ide["serie"]).try_cast("int"), "ide/serie"),
        _need(day.try_cast("date"), "ide/dhEmi"),
        _need(_text(ide["natOp"]), "ide/natOp"),
        _need(_text(emit["CNPJ"]), "emit/CNPJ"),
        _need(_text(emit["xNome"]), "emit/xNome"),
        _need(crt, "emit/CRT"),
        _need(_text(emit["enderEmit"]["UF"]), "enderEmit/UF"),
        _need(identified, "dest/CNPJ or dest/CPF"),
        _need(_text(dest["xNome"]), "dest/xNome"),
        _need(_text(dest["enderDest"]["UF"]), "enderDest/UF"),
        _need(boxes, "total/ICMSTot"),
        *[_bad_number(boxes[element], MONEY, element) for element in TOTAL_ELEMENTS.values()],
    ]

    def part(dup: Column) -> Column:
        return F.array_compact(
            F.array(
                _need(_text(dup["nDup"]), "nDup"),
                _need(_text(dup["dVenc"]).try_cast("date"), "dVenc"),
                _need(_number(dup["vDup"], MONEY), "vDup"),
            )
        )

    none = F.array().cast("array<string>")
    return F.concat(
        F.array_compact(F.array(*header)),
        F.coalesce(F.flatten(F.transform(nfe["det"], lambda det: _item_problems(det, crt))), none),
        F.coalesce(F.flatten(F.transform(nfe["cobr"]["dup"], part)), none),
    )


def to_invoices(parsed: DataFrame, nfe: str = "nfe", keep: tuple[str, ...] = ()) -> DataFrame:
    """Invoice columns and ``problems`` from a parsed struct column."""
    column = F.col(nfe)
    problems = F.when(column.isNull(), F.array(F.lit("infNFe"))).otherwise(problem_column(column))
    return parsed.select(*keep, *invoice_columns(column), problems.alias("problems"))


def parse_nfe(df: DataFrame, xml: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Invoices of a column of XML texts whose root is ``infNFe``."""
    parsed = F.from_xml(F.col(xml), NFE_SCHEMA, {"mode": "PERMISSIVE"})
    # A one-element explode parses each text once: without it a later filter on ``problems`` would
    # be pushed below with the whole parse repeated for every element it reads.
    return to_invoices(df.select(*keep, F.explode(F.array(parsed)).alias("nfe")), "nfe", keep)


def read_nfe(spark: SparkSession, path: str) -> DataFrame:
    """Invoices of a folder of XML files; ``case_id`` is the file's name without its ending."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", "infNFe")
        .schema(NFE_SCHEMA)
        .load(path)
        .select("*", F.col("_metadata.file_name").alias("file"))
    )
    names = [name for name in raw.columns if name != "file"]
    case_id = F.regexp_replace("file", r"\.xml\z", "")
    return to_invoices(
        raw.select(case_id.alias("case_id"), F.struct(*names).alias("nfe")), "nfe", ("case_id",)
    )


def quarantine(invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The readable invoices, and the others with the names of their bad elements."""
    good = F.size("problems") == 0
    return invoices.filter(good).drop("problems"), invoices.filter(~good)
