"""Delimited files as people leave them: encodings, notes above the header, banners, decimal commas.

The head of a file is looked at on the driver (some hundred lines); the rows are read as lines,
split and typed by Spark. A quoted cell may not run over several lines here; ``read_delimited``
reads such files.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.assay import NO_DATA, NO_DATA_TEXT
from lodestone.sources.tables import IDENTIFIER_WORDS

DELIMITERS = (",", ";", "\t", "|")
COMMA_NUMBER = r"^[+-]?\d+,\d+$"
POINT_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# The fields of the main tables and the header names that stand for them.
SCHEMAS = {
    "collars": {
        "hole_id": ("hole_id", "holeid", "hole", "bhid", "dhid", "ddh", "ddh_id", "ddh_no", "hole_name"),
        "x": ("x", "easting", "east", "utm_e", "utme"),
        "y": ("y", "northing", "north", "utm_n", "utmn"),
        "z": ("z", "elevation", "elev", "rl", "utm_z"),
        "azimuth": ("azimuth", "azim_grid", "azi", "az", "brg", "bearing", "collar_az", "hole_az"),
        "dip": ("dip", "inclination", "incl"),
        "length": ("length", "total_depth", "eoh", "max_depth", "hole_length", "actual_depth", "final_depth", "td", "depth"),
    },
    "survey": {
        "hole_id": ("hole_id", "holeid", "hole", "bhid", "dhid", "ddh", "ddh_id", "ddh_no"),
        "depth": ("depth", "at", "md", "station", "dist", "distance"),
        "azimuth": ("azimuth", "azi", "az", "azim", "brg", "bearing"),
        "dip": ("dip", "inclination", "incl"),
    },
    "intervals": {
        "hole_id": ("hole_id", "holeid", "hole", "bhid", "dhid", "ddh", "ddh_id", "ddh_no"),
        "from": ("from", "depth_from", "from_m", "start", "top"),
        "to": ("to", "depth_to", "to_m", "end", "bottom"),
        "value": ("lithology", "lith_code", "rock_code", "rock_type", "code", "unit", "value"),
    },
}
NUMERIC_FIELDS = ("x", "y", "z", "azimuth", "dip", "length", "depth", "from", "to")
# Header parts that rule a column out for a field.
VETO = {
    "hole_id": r"(length|depth|_len$|_m$|azi|dip|elev|type|status|parent|purpose|path|diam)",
    "measured": r"(comment|cmnts?|nominal|planned|plan_|design|target|(^|_)ref(_|$)|precollar|pre_collar|boco|tofr|water)",
    "hole length": r"(depth|dep)_(of|to)_|(^|_)(best|peak|top|base|bottom|intercept|basement|bedrock|regolith|oxide|fresh|transition)(_|$)",
}
# A banner's most filled and a name row's least worded share, a table's least width, the least share of rows as wide as a spaced header.
BANNER, WORDED, LEAST_WIDTH, SPACED = 0.5, 0.8, 3, 0.8


@dataclass(frozen=True)
class Layout:
    """How a file is laid out: its encoding, delimiter, header, and the lines above its rows."""

    encoding: str
    delimiter: str
    headers: tuple[str, ...]
    above: tuple[str, ...]
    spaced: bool = False  # columns stand apart by runs of spaces


def _cells(line: str, delimiter: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line], delimiter=delimiter), [])]


def layout_of(lines: list[str], encoding: str = "utf-8", comment: str = "#") -> Layout:
    """The layout that the first lines of a file show.

    Comment lines and notes above the header are passed over: the header is the first line from
    which on several lines have the same width, wider than the lines above. A banner of group
    names, mostly empty, gives way to the row of names under it. Rows that end in a delimiter may be one
    empty cell wider than their header. Without any delimiter, a header of three words or more over rows
    of as many is a table of spaced columns.
    """
    lines = given = [x.removeprefix("\ufeff").rstrip("\r") for x in lines]
    text = [i for i, x in enumerate(lines) if x.strip() and not x.lstrip().startswith(comment)]
    if not text:
        return Layout(encoding, ",", (), ())
    sample = [lines[i] for i in text[:60]]
    spaced = _spaced(sample)
    if spaced:
        lines = [re.sub(r"\s+", "\t", x.strip()) for x in given]
    delimiter = "\t" if spaced else max(DELIMITERS, key=lambda d: (sum(x.count(d) for x in sample), -DELIMITERS.index(d)))
    width = {i: len(_cells(lines[i], delimiter)) for i in text}
    at = text[0]
    if width[at] >= LEAST_WIDTH and len(text) > 1:
        under = text[1]
        top, names = _cells(lines[at], delimiter), _cells(lines[under], delimiter)
        filled = [c for c in top if c]
        words = [c for c in names if c and not re.match(POINT_NUMBER, c)]
        if len(top) == len(names) and 1 <= len(filled) <= BANNER * len(top) and len(words) >= WORDED * len(names):
            at = under
    else:
        for k, i in enumerate(text[1:], 1):
            after = text[k + 1 : k + 4]
            even = all(width[j] == width[i] for j in after)
            ended = all(width[j] == width[i] + 1 and lines[j].rstrip().endswith(delimiter) for j in after)
            if width[i] >= LEAST_WIDTH and width[i] > width[at] and after and (even or ended):
                at = i
                break
    headers: list[str] = []
    for n, name in enumerate(_cells(lines[at], delimiter), 1):
        name = name or f"column_{n}"
        twin = sum(h.lower() == name.lower() or h.lower().startswith(name.lower() + "_again") for h in headers)
        headers.append(name if not twin else f"{name}_again{twin}")
    return Layout(encoding, delimiter, tuple(headers), tuple(given[: at + 1]), spaced)


def _spaced(sample: list[str]) -> bool:
    """No line has a delimiter or a quote, and most have as many words as the first, three or more."""
    if any(c in x for x in sample for c in ',;\t|"') or len(sample) < 2:
        return False
    width = len(sample[0].split())
    return width >= LEAST_WIDTH and sum(len(x.split()) == width for x in sample[1:]) >= SPACED * (len(sample) - 1)


def probe(spark: SparkSession, *parts: str, lines: int = 300) -> Layout:
    """The layout of a file, or of one in several parts, from the first lines of each.

    The encoding is judged by all bytes, in tasks: a line anywhere that isn't UTF-8 means Windows-1252.
    """
    head = [bytes(r.b) for path in parts for r in spark.read.text(path).select(F.col("value").cast("binary").alias("b")).limit(lines).collect()]
    foreign = spark.read.text(list(parts)).where(~F.is_valid_utf8("value"))
    encoding = "utf-8" if foreign.isEmpty() else "windows-1252"
    return layout_of([b.decode(encoding, "replace") for b in head], encoding)


def decoded(raw: Column, encoding: str) -> Column:
    """Bytes as text. Windows-1252 is Latin-1 but for the control range, whose letters are put in."""
    if encoding == "utf-8":
        return raw.cast("string")
    low = [chr(b) for b in range(0x80, 0xA0)]
    high = [bytes([b]).decode("windows-1252", "replace") for b in range(0x80, 0xA0)]
    return F.translate(F.decode(raw, "iso-8859-1"), "".join(low), "".join(high))


def read_raw(spark: SparkSession, path: str, layout: Layout | None = None, comment: str = "#") -> DataFrame:
    """The rows of a file as text columns named by its header.

    Lines that begin with the comment mark are notes unless they are as wide as the header.
    """
    how = layout or probe(spark, path)
    text = F.regexp_replace(decoded(F.col("value").cast("binary"), how.encoding), "^\ufeff|\r$", "")
    lines = spark.read.text(path).select(text.alias("line"))
    cut = F.regexp_replace(F.trim("line"), r"\s+", "\t") if how.spaced else F.col("line")
    wide = F.size(F.split(cut, re.escape(how.delimiter))) >= len(how.headers)
    lines = lines.where((F.trim("line") != "") & ~F.col("line").isin(*how.above) & (~F.ltrim("line").startswith(comment) | wide)).select(cut.alias("line"))
    names = [f"c{i}" for i in range(len(how.headers))]
    row = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"sep": how.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return lines.select(row.alias("r")).select(*(F.trim(F.col(f"r.{n}")).alias(h) for n, h in zip(names, how.headers)))


def decimal_commas(raw: DataFrame, columns: list[str]) -> dict[str, str]:
    """Columns whose commas are decimal marks (``convert``) or may be (``ambiguous``), decided over all rows.

    Commas must not be rarer than plain numbers, and one of them must have other than three
    digits after it: "1,234" alone may be thousands.
    """
    parts = []
    for c in columns:
        t = F.trim(F.col(c))
        comma = t.rlike(COMMA_NUMBER)
        parts.append(F.struct(F.count(F.when(comma, 1)).alias("comma"), F.count(F.when(t.rlike(POINT_NUMBER), 1)).alias("plain"), F.count(F.when(comma & (F.length(F.substring_index(t, ",", -1)) != 3), 1)).alias("sure")).alias(c))
    one = raw.agg(*parts).first() if columns else {}
    return {c: "convert" if one[c].sure else "ambiguous" for c in columns if one[c].comma and one[c].comma >= one[c].plain}


def number_in(cell: Column, comma: bool) -> Column:
    """A cell as a number by its column's mark; no-data texts and codes are null."""
    text = F.trim(cell)
    plain = F.replace(text, F.lit(","), F.lit(".")) if comma else text
    value = F.when(~F.lower(text).isin(*NO_DATA_TEXT), plain).try_cast("double")
    return F.when(~value.isin(*NO_DATA) & ~F.isnan(value), value)


def typed(raw: DataFrame) -> DataFrame:
    """Text columns as numbers where every filled cell reads as one by the column's decimal mark.

    Identifiers by name, and columns with a zero in front of a whole number, stay text.
    """
    marks = decimal_commas(raw, raw.columns)
    comma = {c: marks.get(c) == "convert" for c in raw.columns}
    filled = lambda c: F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c))).isin(*NO_DATA_TEXT)
    named = [c for c in raw.columns if not set(re.split(r"[\s_]+", c.lower())) & set(IDENTIFIER_WORDS)]
    if not named:
        return raw
    checks = raw.agg(*(F.struct(F.count(F.when(filled(c), 1)).alias("n"), F.count(F.when(filled(c) & number_in(F.col(c), comma[c]).isNull() & ~F.coalesce(F.trim(F.col(c)).try_cast("double").isin(*NO_DATA), F.lit(False)), 1)).alias("bad"), F.count(F.when(F.trim(F.col(c)).rlike(r"^0\d+$"), 1)).alias("zero")).alias(c) for c in named)).first()
    numeric = [c for c in named if checks[c].n and not checks[c].bad and not checks[c].zero]
    return raw.withColumns({c: number_in(F.col(c), comma[c]) for c in numeric}) if numeric else raw


def normal_header(header: str) -> str:
    """A header as an alias would spell it: unit suffix dropped, marks as underscores, % as pct."""
    plain = re.sub(r"\s*[(\[].*?[)\]]\s*$", "", header.strip().lower()).replace("%", "pct")
    return re.sub(r"[\s\-/.]+", "_", plain).strip("_")


def guess_mapping(target: str, headers: list[str]) -> dict[str, str]:
    """Field -> header of one of the main tables: an exact alias first, then an alias inside a header; each header once."""
    norm = {h: normal_header(h) for h in headers}
    barred = {"hole_id": ["hole_id"]}
    if target in ("collars", "survey"):
        barred |= {f: ["measured"] for f in ("azimuth", "dip", "depth", "length")}
    if target == "collars":
        barred["length"] = ["measured", "hole length"]
    fits = lambda field, h: not any(re.search(VETO[v], norm[h]) for v in barred.get(field, []))
    out: dict[str, str] = {}
    for exact in (True, False):
        for field, aliases in SCHEMAS[target].items():
            if field in out:
                continue
            for alias in aliases:
                hit = [h for h in headers if h not in out.values() and fits(field, h) and (norm[h] == alias if exact else len(alias) > 2 and alias in norm[h])]
                if hit:
                    out[field] = hit[0]
                    break
    return out


def guess_target(headers: list[str]) -> str:
    """The main table that most of whose fields the headers name exactly; the first of equals."""
    score = {t: sum(any(normal_header(h) in a for h in headers) for a in fields.values()) / len(fields) for t, fields in SCHEMAS.items()}
    return max(score, key=lambda t: score[t])


def mapped(raw: DataFrame, target: str, mapping: dict[str, str] | None = None, dip_positive_down: bool = False) -> DataFrame:
    """A file's rows as one of the main tables: its fields first, typed, then the other columns as they are."""
    found = mapping or guess_mapping(target, raw.columns)
    marks = decimal_commas(raw, [h for f, h in found.items() if f in NUMERIC_FIELDS and dict(raw.dtypes)[h] == "string"])
    cols = []
    for field in SCHEMAS[target]:
        if field not in found:
            cols.append(F.lit(None).cast("double" if field in NUMERIC_FIELDS else "string").alias(field))
        elif field in NUMERIC_FIELDS:
            h = found[field]
            v = number_in(F.col(h), marks.get(h) == "convert") if dict(raw.dtypes)[h] == "string" else F.col(h).cast("double")
            cols.append((-v if field == "dip" and dip_positive_down else v).alias(field))
        else:
            cols.append(F.trim(F.col(found[field]).cast("string")).alias(field))
    taken = {f.lower() for f in SCHEMAS[target]}
    return raw.select(*cols, *(F.col(f"`{c}`").alias(c if c.lower() not in taken else f"{c}_file") for c in raw.columns if c not in found.values()))
