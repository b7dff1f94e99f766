"""Delimited text, its detection and mapping (SRC01-SRC07, SRC13, DOM43, DOM45).

Detection looks at a bounded head on the driver; parsing is distributed.  Lines come as (file, row,
text), so any number of files is read in one job.
"""

from __future__ import annotations

import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: First bytes of formats that are not text.
MAGIC = {b"PK\x03\x04": "excel", b"PAR1": "parquet", b"ARROW1": "feather", b"%PDF": "pdf", b"\xd0\xcf\x11\xe0": "excel"}
EXTENSIONS = {"csv": "delimited", "tsv": "delimited", "txt": "delimited", "xlsx": "excel", "xls": "excel", "parquet": "parquet", "feather": "feather", "arrow": "feather", "ofx": "ofx", "qfx": "ofx", "qbo": "ofx", "pdf": "pdf"}
TOTAL_ROW = r"(?i)^\W*(grand\s+)?(total|subtotal|balance forward|ending balance|closing balance)\b"
MOST_BYTES = 25 * 2**20
#: Header names by the field they mean, the likeliest first.
ALIASES = {
    "transaction_date": ("date", "transaction date", "trans date", "posted date", "post date", "posting date", "datum"),
    "amount": ("amount", "transaction amount", "value", "betrag"),
    "debit_amount": ("debit", "withdrawal", "withdrawals", "money out", "debit amount"),
    "credit_amount": ("credit", "deposit", "deposits", "money in", "credit amount"),
    "description": ("description", "payee", "merchant", "details", "narrative", "name", "text"),
    "memo": ("memo", "notes", "note", "reference"),
    "balance": ("balance", "running balance", "saldo"),
    "category": ("category", "type"),
    "currency_code": ("currency", "currency code", "ccy"),
    "source_transaction_id": ("transaction id", "id", "fitid", "reference number"),
}


def detect(name: str, head: bytes, size: int) -> dict:
    """SRC01: format, encoding and delimiter from a file's name and first bytes; refuses large files."""
    if size > MOST_BYTES:
        raise ValueError(f"{name}: {size} bytes are more than {MOST_BYTES}")
    kind = next((k for m, k in MAGIC.items() if head.startswith(m)), None) or EXTENSIONS.get(name.rpartition(".")[2].lower(), "delimited")
    out = {"kind": kind, "encoding": "utf-8", "delimiter": None}
    if kind == "delimited":
        for enc in ("utf-8-sig", "utf-8", "cp1252"):
            try:
                text = head.decode(enc)
                out["encoding"] = enc
                break
            except UnicodeDecodeError:
                continue
        lines = [x for x in text.splitlines() if x.strip()][:20]
        score = {d: sorted(x.count(d) for x in lines)[len(lines) // 2] if lines else 0 for d in ",\t;|"}
        out["delimiter"] = max(score, key=lambda d: (score[d], -",\t;|".index(d)))
    return out


def header_row(lines: list[str], delimiter: str) -> int:
    """The first line whose width is the usual one and that holds no number or date."""
    widths = [x.count(delimiter) for x in lines]
    usual = max(set(widths), key=widths.count) if widths else 0
    for i, x in enumerate(lines):
        cells = [c.strip().strip('"') for c in x.split(delimiter)]
        if widths[i] == usual and all(c and not re.fullmatch(r"[-+(]?[\d.,/\s$€-]+\)?", c) for c in cells):
            return i
    return 0


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, text) of text files; rows are numbered within a file."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return x.select("file", (F.row_number().over(W.partitionBy("file").orderBy("at")) - 1).cast("long").alias("row"), "text")


def parse_lines(lines: DataFrame, delimiter: str = ",", header: int | None = None) -> DataFrame:
    """SRC02, SRC03: lines behind the header row as columns of text named by it; rows that repeat the
    header, total rows and blank lines go."""
    head = [r["text"] for r in lines.orderBy("file", "row").limit(50).collect()]
    at = header_row(head, delimiter) if header is None else header
    names = [c.strip().strip('"') or f"column_{i + 1}" for i, c in enumerate(head[at].split(delimiter))]
    cells = F.from_csv(F.col("text"), F.lit(", ".join(f"`{n}` string" for n in names)), {"sep": delimiter, "mode": "PERMISSIVE"})
    kept = lines.where(F.col("row") > at).where((F.trim("text") != "") & ~F.col("text").rlike(TOTAL_ROW) & ~F.col("text").eqNullSafe(F.lit(head[at])))
    return kept.select("file", "row", cells.alias("c")).select("file", "row", "c.*")


def guard_rows(df: DataFrame, warn: int = 10_000, refuse: int = 50_000) -> str:
    """SRC07: ok, warn or refuse, without counting further than needed."""
    n = df.limit(refuse + 1).count()
    return "refuse" if n > refuse else "warn" if n > warn else "ok"


def read_excel(spark: SparkSession, data: bytes, sheet: str | None = None) -> DataFrame:
    """SRC04: a workbook's sheet, the largest where none is named; needs openpyxl."""
    import pandas as pd

    sheets = pd.read_excel(io.BytesIO(data), sheet_name=None, dtype=str)
    pdf = sheets[sheet] if sheet else max(sheets.values(), key=len)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` string" for c in pdf.columns))


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC06: Arrow files, each read by one task from bytes that Spark's own file systems give."""

    def run(batches):
        import pyarrow.feather as pf

        for pdf in batches:
            for data in pdf["content"]:
                yield pf.read_table(io.BytesIO(data)).to_pandas()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def map_columns(names: list[str]) -> dict:
    """DOM45: field to header by alias, and high (date, amount and description), medium or low confidence."""
    plain = {re.sub(r"[^a-z ]", " ", n.lower()).strip(): n for n in reversed(names)}
    found, used = {}, set()
    for f, aliases in ALIASES.items():
        hit = next((plain[a] for a in aliases if a in plain and plain[a] not in used), None)
        if hit:
            found[f] = hit
            used.add(hit)
    amount = "amount" in found or {"debit_amount", "credit_amount"} <= found.keys()
    n = sum((("transaction_date" in found), amount, ("description" in found)))
    return {"mapping": found, "confidence": {3: 0.95, 2: 0.75}.get(n, 0.3), "tier": {3: "high", 2: "medium"}.get(n, "low")}


def sign_convention(rows: DataFrame, amount: str | None, debit: str | None = None, credit: str | None = None, header: str = "") -> str:
    """DOM43: split_debit_credit, ambiguous, negative_is_income or negative_is_expense."""
    if debit and credit:
        return "split_debit_credit"
    s = F.trim(F.col(amount))
    minus = rows.agg(F.bool_or(s.startswith("-") | s.startswith("("))).first()[0]
    if not minus:
        return "ambiguous"
    return "negative_is_income" if re.search(r"charge|credit card|debit", header, re.I) else "negative_is_expense"


def signed(convention: str, amount=None, debit=None, credit=None):
    """DOM43: the signed amount under a convention."""
    if convention == "split_debit_credit":
        return F.coalesce(credit, F.lit(0).cast("decimal(18,2)")) - F.coalesce(F.abs(debit), F.lit(0).cast("decimal(18,2)"))
    return -amount if convention == "negative_is_income" else amount
