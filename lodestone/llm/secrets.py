"""Secret scans with a ledger of blobs: each text version is scanned once for each rule version.

A text is a blob named by its SHA-256. The ledger is a table in a shared folder that holds,
for each (blob, rule set version), the spans found. A scan takes the blobs the ledger lacks,
scans one copy of each, appends to the ledger and joins the findings back to every document
that holds the blob. All of it is DataFrame and SQL functions.

Positions come from cutting: the text between matches and the matches alternate, so running
sums of their lengths are the spans. The sums run in a window over a blob's matches, which
lie together since blobs were grouped; so the work follows the number of matches. They run in
code points, which is what a span says, and in bytes, by which a text is cut without counting
through it again.

Defined cases: null text is the empty blob and has no findings. Repeated rows each get their
blob's findings. A column of the caller's with the name of a result (``blob``, ``spans``)
gives way to it in ``scan``; ``redact`` leaves all columns but ``text`` as they are. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_dir, packed, unpacked, without

#: Name, pattern, and what a match must hold besides; the first three are the base rules.
#: ``probe`` is a pattern that every match contains and that is quick to deny.
RULES = (
    {"kind": "assign", "pattern": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "group": 2, "least": 6, "probe": r"(?i)password|passwd|secret|token|api_?key"},
    {"kind": "access", "pattern": r"AKIA[A-Z0-9]+", "group": 0, "least": 20, "probe": "AKIA"},
    {"kind": "hex", "pattern": r"[0-9a-f]+", "group": 0, "least": 24, "probe": r"[0-9a-f]{24}"},
    {"kind": "private_key", "pattern": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "group": 0, "least": 1, "probe": "PRIVATE KEY-----"},
)
BASE = ("assign", "access", "hex")
VERSION = "1"
#: ``from`` and ``to`` are the span in bytes, ``clear`` the byte up to which earlier spans reach.
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,from:int,to:int,clear:int>>"
_MATCH = "array<struct<rank:int,pos:int,step:int,len:int,step_b:int,len_b:int,good:boolean>>"


def _matches(text: Column, rule: dict, rank: int) -> Column:
    """All matches of one rule, leftmost and not overlapping: how far each is from the last one's end."""
    probe = text.contains(rule["probe"]) if rule["probe"].isalnum() or "PRIVATE" in rule["probe"] else text.rlike(rule["probe"])
    pattern = rule["pattern"]
    if rule["kind"] == "hex":  # a whole run of at least so many is what + and a length test give
        pattern = r"[0-9a-f]{24,}"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule["group"])) if rule["group"] else whole
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("m"), value.alias("v"))

    def told(x: Column, i: Column) -> Column:
        size = lambda c: F.char_length(x[c])
        raw = lambda c: F.octet_length(x[c])
        return F.struct(F.lit(rank).alias("rank"), i.alias("pos"), (size("gap") + size("m")).alias("step"), size("m").alias("len"), (raw("gap") + raw("m")).alias("step_b"), raw("m").alias("len_b"), (size("v") >= rule["least"]).alias("good"))

    return F.when(probe, F.transform(pairs, told).cast(_MATCH)).otherwise(F.array().cast(_MATCH))


def find_spans(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``blob, spans`` of a table of distinct ``blob, text``: spans of all rules by start, then rule order."""
    every = F.concat(*(_matches(F.col("text"), r, i) for i, r in enumerate(rules)))
    rows = blobs.select("blob", F.explode_outer(every).alias("m")).select("blob", "m.*")
    so_far = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum("step").over(so_far).cast("int")).withColumn("to", F.sum("step_b").over(so_far).cast("int"))
    ends = ends.withColumn("start", F.col("end") - F.col("len")).withColumn("from", F.col("to") - F.col("len_b"))
    before = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.element_at(F.array(*(F.lit(r["kind"]) for r in rules)), F.col("rank") + 1)
    ends = ends.withColumn("clear", F.coalesce(F.max(F.when(F.col("good"), F.col("to"))).over(before), F.lit(0)))
    one = F.when(F.col("good"), F.struct("start", "rank", "end", kind.alias("kind"), "from", "to", "clear"))
    return ends.groupBy("blob").agg(F.sort_array(F.collect_list(one)).cast(_SPAN).alias("spans"))


def _scanned(docs: DataFrame, ledger: str | None, rules, version: str) -> DataFrame:
    """``row`` (the columns of ``docs``), ``given`` (its text), ``blob`` and ``spans``.

    A ledger that holds a blob twice, as two scans at once leave it, counts once.
    """
    version = f"{version}-{hashlib.sha256(json.dumps([list(rules), _SPAN], sort_keys=True).encode()).hexdigest()}"
    spark = docs.sparkSession
    path = ledger or fresh_dir(spark, "secret-ledger")
    schema = f"blob binary, version string, spans {_SPAN}"
    text = F.coalesce(F.col("text"), F.lit(""))
    named = packed(docs, F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), F.col("text").alias("given"))
    blobs = named.select("blob", F.coalesce("given", F.lit("")).alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger and _exists(spark, path):
        seen = spark.read.schema(schema).parquet(path).where(F.col("version") == version)
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    find_spans(blobs, rules).select("blob", F.lit(version).alias("version"), "spans").write.mode("append").parquet(path)
    done = spark.read.schema(schema).parquet(path).where(F.col("version") == version)
    hits = done.where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    return named.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES, version: str = VERSION) -> DataFrame:
    """``docs`` with ``blob`` (SHA-256 of the text) and ``spans`` (start, rank, end, kind, ...).

    ``ledger`` is a folder of earlier scans; without one a new ledger is begun in the shared
    folder. Its rows are (blob, version, spans), where the version goes with a digest of the
    rules; a blob scanned with these rules under this version before is not scanned again.
    """
    done = _scanned(without(docs, "blob", "spans"), ledger, rules, version)
    return done.select("row.*", "blob", "spans")


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: str | None = None, rules=RULES, version: str = VERSION) -> DataFrame:
    """``docs`` with each secret's span replaced by ``[kind]``; other columns stay.

    Of spans that overlap the first gives the name and all are cut out.
    """
    done = _scanned(docs, ledger, rules, version)
    fresh = F.filter("spans", lambda s: s["from"] >= s["clear"])

    def cut(raw: Column) -> Column:
        """``raw`` is a lambda's variable, so a piece costs its own bytes only, not the text's."""
        piece = lambda begin, end: F.substring(raw, begin + 1, end - begin).cast("string")
        named = F.transform(fresh, lambda s: F.concat(piece(s["clear"], s["from"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(named, ""), piece(F.array_max(F.transform("spans", lambda s: s["to"])), F.octet_length(raw)))

    redacted = F.transform(F.array(F.coalesce(F.col("given"), F.lit("")).cast("binary")), cut)[0]
    return done.select(*unpacked(done, docs.columns, F.when(F.size("spans") > 0, redacted).otherwise(F.col("given"))))
