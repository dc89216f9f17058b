"""Files that Spark has no reader for, parsed a file at a time inside tasks.

Each file is read whole by one task, so many files spread; a single file of these formats is
bounded by what a workbook or a well log can hold.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


COMMON_NULLS = (-999.25, -9999.0, -999.0)  # fixed values: what stands for no reading where a log names nothing
FOOT = 0.3048


def parse_las(text: str) -> tuple[dict[str, str], list[str], list[list[float | None]]]:
    """Header values, curve names and records of a LAS 1.2 or 2.0 log.

    The data is one stream of numbers cut by the number of curves, so wrapped logs read as
    others. The NULL code, or the usual ones without it, becomes None; depths in feet become
    metres. A last record that isn't whole is left out.
    """
    header, curves, tokens, section = {}, [], [], ""
    units: dict[str, str] = {}
    for raw in text.removeprefix("\ufeff").splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("~"):
            if section == "A":
                break
            section = line[1:2].upper()
            continue
        if section == "A":
            tokens += re.split(r"[\s,]+", line)
            continue
        m = re.match(r"([^.\s]+)\s*\.(\S*)\s*([^:]*)(?::.*)?$", line)
        if not m:
            continue
        name = m[1].upper()
        units.setdefault(name, m[2].upper())
        if section == "C":
            curves.append(name)
        else:
            header[name] = m[3].strip()
    if not curves:
        return header, curves, []
    values = [float(x) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x) else None for x in tokens if x]
    try:
        nulls = (float(header["NULL"]),)
    except (KeyError, ValueError):
        nulls = COMMON_NULLS
    values = [None if v in nulls else v for v in values]
    n = len(curves)
    rows = [values[at : at + n] for at in range(0, len(values) - n + 1, n)]
    if (units.get(curves[0]) or units.get("STRT", "")) in ("F", "FT", "FEET"):
        rows = [[None if r[0] is None else round(r[0] * FOOT, 4), *r[1:]] for r in rows]
    return header, curves, rows


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """``file, hole, depth, curve, value``: the first curve is the depth; missing values are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                header, curves, rows = parse_las(bytes(content).decode("utf-8", "replace"))
                hole = header.get("WELL") or header.get("UWI") or file.rpartition("/")[2].rpartition(".")[0]
                out = [(file, hole, r[0], c, v) for r in rows if r and r[0] is not None for c, v in zip(curves[1:], r[1:]) if v is not None]
                yield pd.DataFrame(out, columns=["file", "hole", "depth", "curve", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, hole string, depth double, curve string, value double")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def parse_xlsx(content: bytes) -> list[tuple[str, list[dict[int, str]]]]:
    """Sheets as (name, rows); a row maps column numbers to texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        targets = {}
        for rel in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            targets[rel.get("Id")] = rel.get("Target").lstrip("/").removeprefix("xl/")
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            rows = []
            for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(_REL)])).iter(f"{{{_NS['m']}}}row"):
                cells = {}
                for k, c in enumerate(row.findall("m:c", _NS)):
                    col = 0
                    for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                        col = col * 26 + ord(ch) - 64
                    v = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is None:
                        continue
                    else:
                        text = shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells[col - 1 if col else k] = text
                rows.append(cells)
            out.append((sheet.get("name"), rows))
        return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """``file, sheet, row, cells``: a map from the header's names to texts, for each data row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                out = []
                for name, rows in parse_xlsx(bytes(content)):
                    if not rows:
                        continue
                    head = rows[0]
                    out += [(file, name, i, {head[k]: v for k, v in r.items() if k in head}) for i, r in enumerate(rows[1:], 1) if r]
                yield pd.DataFrame(out, columns=["file", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, sheet string, row int, cells map<string,string>")


def sheet_table(cells: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """One sheet's named columns as text."""
    return cells.where(F.col("sheet") == sheet).select("row", *(F.col("cells")[c].alias(c) for c in columns))
