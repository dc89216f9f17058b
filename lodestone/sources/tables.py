"""Readers and writers of project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.assay import NO_DATA_TEXT, number

IDENTIFIER_WORDS = ("id", "hole", "sample", "code", "name", "number", "no")


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", keep: list[str] | None = None, numeric: list[str] | None = None, comment: str = "#") -> DataFrame:
    """Delimited text with a header: text columns, of which ``numeric`` become doubles.

    Identifiers stay text ("0045" isn't 45). ``keep`` prunes columns in the scan.
    """
    raw = spark.read.option("header", True).option("sep", delimiter).option("comment", comment).option("enforceSchema", False).csv(path)
    if keep:
        raw = raw.select(*keep)
    return raw.withColumns({c: number(F.col(c)) for c in (numeric or [])})


def guess_numeric(raw: DataFrame) -> list[str]:
    """Columns of text that read as numbers in every row and aren't identifiers by name or by a zero in front."""
    words = {c: set(c.lower().replace("_", " ").split()) for c in raw.columns}
    named = [c for c in raw.columns if not words[c] & set(IDENTIFIER_WORDS)]
    if not named:
        return []
    checks = raw.agg(*(F.struct(F.count(F.when(F.col(c).isNotNull() & number(F.col(c)).isNull() & ~F.lower(F.trim(c)).isin(*NO_DATA_TEXT), 1)).alias("bad"), F.count(F.when(F.col(c).rlike(r"^0\d+$"), 1)).alias("zero"), F.count(number(F.col(c))).alias("good")).alias(c) for c in named)).first()
    return [c for c in named if checks[c].good and not checks[c].bad and not checks[c].zero]


def write_delimited(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    rows.write.option("header", True).option("sep", delimiter).option("escape", '"').csv(path)


def read_geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """Point features: ``x, y`` and the named properties as text."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return one.where("f.geometry.type = 'Point'").select(F.get("f.geometry.coordinates", 0).alias("x"), F.get("f.geometry.coordinates", 1).alias("y"), *(F.col("f.properties")[p].alias(p) for p in properties))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int = 16, fetch: int = 20_000) -> DataFrame:
    """A database table in parallel ranges of an integer key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties={"fetchsize": str(fetch)})


def read_xyz_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Line-oriented XYZ text: a LINE header names the line of the rows after it.

    Lines of one file follow its byte order; a file is read as one piece (wholetext), so many
    files are spread over tasks.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.transform(F.split("value", r"\r?\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))).alias("l")).select("file", "l.pos", "l.line")
    body = text.where(~F.trim("line").startswith("/") & (F.trim("line") != ""))
    from pyspark.sql import Window

    head = F.when(F.upper(F.trim("line")).rlike(r"^(LINE|TIE)\s"), F.trim("line"))
    named = body.withColumn("name", F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos"))).where(head.isNull())
    cells = F.split(F.trim("line"), r"[\s,]+")
    return named.select("file", "pos", F.regexp_replace("name", r"(?i)^(line|tie)\s+", "").alias("line_id"), *(number(F.get(cells, i)).alias(c) for i, c in enumerate(columns)))
