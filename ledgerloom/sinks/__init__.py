"""Writing tables and bundles (SNK01-SNK06, SNK09)."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(stored: DataFrame, new: DataFrame, keys: list[str], mode: str) -> tuple[DataFrame, DataFrame]:
    """SNK01: what the table holds after writing ``new`` (insert, replace, upsert, ignore), and the rows
    actually written."""
    cols = stored.columns
    new = new.select(*cols)
    if mode == "insert":
        return stored.unionByName(new), new
    if mode == "replace":
        return new, new
    if mode == "upsert":
        fresh = new.dropDuplicates(keys)
        return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh), fresh
    if mode == "ignore":
        fresh = new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*cols)
        return stored.unionByName(fresh), fresh
    raise ValueError(mode)


def safe_cell(c):
    """SNK02: text that a spreadsheet would take for a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[-+]?\d[\d.,]*$"), F.concat(F.lit("'"), c)).otherwise(c)


def export_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """SNK02: every cell as text; one file only where asked for."""
    cells = [(F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")).alias(c) if t != "string" else safe_cell(F.col(c)).alias(c) for c, t in df.dtypes]
    x = df.select(*cells)
    (x.coalesce(1) if single else x).write.mode("overwrite").csv(path, header=True)


def export_parquet(df: DataFrame, path: str) -> None:
    """SNK03: the schema as it is."""
    df.write.mode("overwrite").parquet(path)


def workbook(tables: dict[str, DataFrame], most: int = 1_000_000) -> bytes:
    """SNK04: a sheet for each table under a name that spreadsheets allow; needs openpyxl."""
    import pandas as pd

    out = io.BytesIO()
    with pd.ExcelWriter(out) as w:
        for name, df in tables.items():
            pdf = df.limit(most + 1).toPandas()
            if len(pdf) > most:
                raise ValueError(f"{name} has over {most} rows")
            pdf.to_excel(w, sheet_name=re.sub(r"[\[\]:*?/\\]", "_", name)[:31], index=False)
    return out.getvalue()


def bundle(files: dict[str, bytes]) -> bytes:
    """SNK05: a ZIP with a manifest of SHA-256 checksums."""
    manifest = {n: {"sha256": hashlib.sha256(b).hexdigest(), "bytes": len(b)} for n, b in sorted(files.items())}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in sorted(files.items()):
            z.writestr(n, b)
        z.writestr("manifest.json", json.dumps(manifest, indent=1))
    return out.getvalue()


def verify(data: bytes) -> list[str]:
    """SNK05: names whose content is not what the manifest says."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        manifest = json.loads(z.read("manifest.json"))
        names = set(z.namelist()) - {"manifest.json"}
        return sorted({n for n, m in manifest.items() if n not in names or hashlib.sha256(z.read(n)).hexdigest() != m["sha256"]} | (names - manifest.keys()))


def checksum(df: DataFrame) -> DataFrame:
    """SNK06: rows and an order-free checksum of a table, in one aggregation."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def dictionary(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, bool]]:
    """SNK06: table, column, type and whether it may be null."""
    return [(n, f.name, f.dataType.simpleString(), f.nullable) for n, df in tables.items() for f in df.schema.fields]


def current_state(log: DataFrame) -> DataFrame:
    """SNK09: (operation_id, seq, entity, entity_id, before, after) to the rows that are there now."""
    x = log.groupBy("entity", "entity_id").agg(F.max_by("after", "seq").alias("image"))
    return x.where("image is not null")


def undo(log: DataFrame, operation_id: str) -> DataFrame:
    """SNK09: the log with the operation's inverse behind it."""
    last = log.agg(F.max("seq").alias("last"))
    back = log.where(F.col("operation_id") == operation_id).crossJoin(F.broadcast(last))
    span = log.where(F.col("operation_id") == operation_id).agg(F.max("seq").alias("hi"))
    back = back.crossJoin(F.broadcast(span))
    inverse = back.select(F.concat(F.lit("undo:"), "operation_id").alias("operation_id"), (F.col("last") + 1 + F.col("hi") - F.col("seq")).alias("seq"), "entity", "entity_id", F.col("after").alias("before"), F.col("before").alias("after"))
    return log.unionByName(inverse)
