"""Line dedup: drop lines that many documents share, keeping them in one document.

A row per line key is range-partitioned by (hash, document descending, position) and sorted
inside each partition, so a key with a third of all lines is spread over many partitions.
Each partition is streamed once. A key that lies inside one partition is decided there; the
first and the last key of a partition may go on in a neighbour and are decided from one
summary row per partition. Only positions come back, as a compressed keep bitmap for each
document; texts are not shuffled until the bitmaps are applied.

Defined cases: null or empty text is one empty line. Rows with equal doc_id and text are one
document and get the same bitmap; rows with equal doc_id and other text count as one holder
of a key. A null doc_id counts as the smallest id. Extra columns of any name stay. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import binary_values, ident, packed, staged, unpacked

_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("tkey", pa.int64()), ("pos", pa.int32())])
_KEYS_SQL = "h1 long, h2 long, did long, tkey long, pos int"
_FOUND_SQL = f"kind string, {_KEYS_SQL}, docs array<long>"
_FOUND = pa.schema([("kind", pa.string()), *_KEYS, ("docs", pa.list_(pa.int64()))])


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            dids, tkeys = batch.column("__did").to_pylist(), batch.column("__tkey").to_pylist()
            hashes, did, tkey, pos = [], [], [], []
            for d, t, text in zip(dids, tkeys, binary_values(batch, "text")):
                for i, line in enumerate(text.split(b"\n")):
                    key = line.strip()
                    if len(key) < min_chars:
                        continue
                    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    hashes.append(digest(key.lower()))
                    did.append(d)
                    tkey.append(t)
                    pos.append(i)
            if pos:
                h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(did, pa.int64()), pa.array(tkey, pa.int64()), pa.array(pos, pa.int32())], schema=_KEYS)

    return run


def _stream(min_docs: int):
    """Decide the keys of one sorted partition.

    Rows out: ``drop`` (decided), ``open`` (its key may go on in another partition) and
    ``seen`` (the first ``min_docs`` documents that this partition holds of such a key).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, first_run, docs, held = None, True, [], []

        def close(last: bool) -> None:
            if key is None:
                return
            if first_run or last:
                out.append(("seen", *key, None, None, None, list(docs)))
                out.extend(("open", *key, *r, None) for r in held)

        for batch in batches:
            for h1, h2, did, tkey, pos in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "did", "tkey", "pos"))):
                if key != (h1, h2):
                    if key is not None:
                        close(False)
                        first_run = False
                    key, docs, held = (h1, h2), [], []
                if len(docs) < min_docs and (not docs or docs[-1] != did):
                    docs.append(did)
                if first_run:  # it may have begun in the partition before
                    out.append(("open", h1, h2, did, tkey, pos, None))
                elif did != docs[0]:
                    if len(docs) >= min_docs:
                        out.extend(("drop", h1, h2, *r, None) for r in held)
                        held.clear()
                        out.append(("drop", h1, h2, did, tkey, pos, None))
                    else:
                        held.append((did, tkey, pos))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _FOUND)], schema=_FOUND)
                out = []
        close(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    return run


def pack_keep(dropped: list[int]) -> bytes:
    """Dropped positions as a compressed bitmap of kept lines; later lines are kept."""
    keep = np.ones(max(dropped) + 1, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes() + bytes([len(keep) % 8]), 1)


def unpack_keep(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    n = (len(raw) - 1) * 8 - (8 - raw[-1] if raw[-1] else 0)
    return np.unpackbits(np.frombuffer(raw[:-1], dtype=np.uint8))[:n].astype(bool)


@F.pandas_udf(T.BinaryType())
def _pack(dropped: pd.Series) -> pd.Series:
    return dropped.map(pack_keep)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
def _apply(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
    texts, lines, drops = [], [], []
    for t, b in zip(text, bitmap):
        t = t or ""
        if b is None:
            texts.append(t)
            lines.append(t.count("\n") + 1)
            drops.append(0)
            continue
        parts, keep = t.split("\n"), unpack_keep(bytes(b))
        kept = [p for p, k in zip(parts, keep) if k] + parts[len(keep) :]
        texts.append("\n".join(kept))
        lines.append(len(parts))
        drops.append(len(parts) - len(kept))
    return pd.DataFrame({"text": texts, "n_lines": lines, "n_dropped": drops})


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """``__did, __tkey, keep_bitmap`` for each document that loses lines."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = docs.select(*ident(), "text").mapInArrow(_line_keys(min_chars), _KEYS_SQL)
    order = [F.col("h1"), F.col("h2"), F.col("did").desc(), F.col("tkey"), F.col("pos")]
    found = staged(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _FOUND_SQL), "line-runs")
    seen = found.where("kind = 'seen'").groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("holders"))
    seen = seen.where(F.size("holders") >= min_docs).select("h1", "h2", F.array_max("holders").alias("owner"))
    # two rows per partition at most, whatever the data
    late = found.where("kind = 'open'").join(F.broadcast(seen), ["h1", "h2"]).where("did <> owner")
    cols = ["did", "tkey", "pos"]
    drops = found.where("kind = 'drop'").select(*cols).unionByName(late.select(*cols)).distinct()
    whole = drops.groupBy("did", "tkey").agg(F.collect_list("pos").alias("pos"))
    return whole.select(F.col("did").alias("__did"), F.col("tkey").alias("__tkey"), _pack("pos").alias("keep_bitmap"))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, out: str | None = "__lines") -> DataFrame:
    """``docs`` with the kept lines as ``text``, and a struct ``out`` of (n_lines, n_dropped).

    A caller's column of that name gives way; without ``out`` there are the caller's columns only.
    """
    joined = packed(docs, *ident(), F.col("text").alias("given")).join(bitmaps, ["__did", "__tkey"], "left")
    done = joined.select("row", _apply("given", "keep_bitmap").alias("done"))
    kept = [c for c in docs.columns if out is None or c.lower() != out.lower()]
    return done.select(*unpacked(done, kept, F.col("done.text")), *([F.col("done").alias(out)] if out else []))
