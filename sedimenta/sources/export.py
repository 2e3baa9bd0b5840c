"""Items as files."""

from __future__ import annotations

import datetime as dt
import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a cell of a sheet may hold, and how long a sheet's name may be.
CELL, SHEET_NAME = 32_767, 31


def flatten(items: DataFrame, fields: list[str], active_only: bool = False) -> DataFrame:
    """Items as a table: their fields as text, then _url, _first_seen, _last_seen, _gone_at. Lists are joined by '; '.

    fields: the columns to take from data, in order; a key that an item lacks is null.
    """
    rows = items.filter(F.col("gone_at").isNull()) if active_only else items
    rows = rows.withColumn("_data", F.from_json("data", "map<string,string>"))
    value = lambda n: _joined(F.try_element_at("_data", F.lit(n)))
    return rows.select(*(value(n).alias(n) for n in fields), F.col("source_url").alias("_url"), F.col("first_seen").alias("_first_seen"), F.col("last_seen").alias("_last_seen"), F.col("gone_at").alias("_gone_at"))


def _joined(text: Column) -> Column:
    as_list = F.from_json(text, "array<string>")
    return F.when(text.startswith("[") & as_list.isNotNull(), F.array_join(F.transform(as_list, lambda x: F.coalesce(x, F.lit("None"))), "; ")).otherwise(text)


def cut_cells(df: DataFrame, limit: int = CELL) -> DataFrame:
    """Texts longer than a cell may hold, cut to one sign less, with an ellipsis."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(F.length(n) > limit, F.concat(F.substring(n, 1, limit - 1), F.lit("…"))).otherwise(F.col(n)) for n in texts})


def default_path(site: str, fmt: str, now: dt.datetime, folder: str = "data") -> Path:
    return Path(folder) / f"{site}_{now:%Y%m%d_%H%M}.{fmt}"


def write(df: DataFrame, fmt: str, site: str, path: str | Path | None = None, now: dt.datetime | None = None) -> Path:
    """One file of a flattened table: csv (';', a byte order mark), json (one array) or xlsx.

    Rows stream through the driver one partition at a time, as one file has one writer; tables beyond that go to write_parts().
    """
    if fmt not in ("csv", "json", "xlsx"):
        raise ValueError(f"unknown format {fmt!r}")
    out = Path(path) if path else default_path(site, fmt, now or dt.datetime.now())
    out.parent.mkdir(parents=True, exist_ok=True)
    if fmt == "xlsx":
        _xlsx(cut_cells(df), out, site[:SHEET_NAME])
        return out
    if fmt == "csv":
        import csv

        with out.open("w", encoding="utf-8-sig", newline="") as f:
            w = csv.writer(f, delimiter=";", lineterminator="\n")
            w.writerow(df.columns)
            for row in df.toLocalIterator():
                w.writerow(["" if v is None else v for v in row])
        return out
    with out.open("w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.toLocalIterator()):
            f.write(("," if i else "") + "\n" + json.dumps(row.asDict(), ensure_ascii=False, indent=2, default=str))
        f.write("\n]")
    return out


def write_parts(df: DataFrame, fmt: str, folder: str) -> None:
    """The same table in as many files as it has partitions: csv with ';' and header, or JSON lines."""
    if fmt == "csv":
        df.write.option("sep", ";").option("header", True).csv(folder)
    elif fmt == "json":
        df.write.option("ignoreNullFields", False).json(folder)
    else:
        raise ValueError(f"unknown format {fmt!r} for parts")


def _column(i: int) -> str:
    name = ""
    while True:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
        if i < 0:
            return name


def _xlsx(df: DataFrame, out: Path, sheet: str) -> None:
    """A workbook of one sheet, written as zipped XML."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }

    def cell(v, r: int, c: int) -> str:
        at = f"{_column(c)}{r}"
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        text = escape("".join(ch for ch in str(v) if ch in "\t\n\r" or ord(ch) >= 32))
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, head + body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write((head + f'<worksheet xmlns="{main}"><sheetData>').encode())
            rows = [df.columns]
            for r, row in enumerate((x for part in (rows, df.toLocalIterator()) for x in part), 1):
                f.write((f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
