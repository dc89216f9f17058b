"""Substring dedup: remove words covered by a window of words that occurs again.

Equal texts are first made one, with a count, and written as a table bucketed by part, so the
later passes meet their inputs without shuffling texts again. A part holds about ``PART``
bytes of text, however large the table is.

1. Every text is winnowed: of each window the phrase (a few words) with the smallest hash is
   its anchor. Equal windows have equal anchors, so only windows of a recurring anchor can
   recur. An anchor is spelled in letters, a few for each word; the spelled anchors are counted
   over all texts, which confirms the phrases that recur. A row per anchor and part is
   shuffled, about one for each fourteen words.
2. Each part gets the spelled phrases that recur among its anchors and compiles them into
   Aho-Corasick automata, shards of at most ``SHARD`` phrases. All texts of the part stream
   through them. Nothing but their hits says where a phrase occurs: the windows anchored at a
   hit are hashed and counted over all parts, which confirms the passages, and the places of
   the hits are kept with the text.
3. Each part gets its confirmed windows and the hits, and marks the words that the confirmed
   windows at the hits cover.

Windows are compared by 64-bit hashes of whole windows after their anchors were equal.
Defined cases: null text has no words; a text shorter than a window loses nothing; repeated
rows are copies and lose what recurs. A column of the caller's with the name of a result gives
way to it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_dir, packed, staged, without
from lodestone.llm.words import WordHashes, rolling

PHRASE, LETTERS, BITS = 8, 3, 5
PART, SHARD = 32 << 20, 50_000
_HASHES = WordHashes()
_PLACE = np.uint64((1 << 24) - 1)


def anchors(phrases: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` phrases the position of its smallest, the first of equals.

    Phrases are ordered by their high 40 bits, then by place; positions never go back.
    """
    n = len(phrases) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    # minima of blocks from the left and from the right meet in every window
    value = np.full(-(-len(phrases) // span) * span, np.uint64(2**64 - 1))
    value[: len(phrases)] = (phrases & ~_PLACE) | (np.arange(len(phrases), dtype=np.uint64) & _PLACE)
    block = value.reshape(-1, span)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    low = (np.minimum(right[:n], left[span - 1 : span - 1 + n]) & _PLACE).astype(np.int64)
    start = np.arange(n)
    return start + ((low - start) & int(_PLACE))


def _distinct(at: np.ndarray) -> np.ndarray:
    """Distinct values of positions that never go back."""
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known`` (not empty), without sorting anything anew."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def begin() -> None:
    _HASHES.begin()


def hashed(words: list[bytes]) -> np.ndarray:
    return _HASHES.of(words)


def _anchored(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and, for each window start, its anchor's position."""
    h = hashed(words)
    return h, anchors(rolling(h, PHRASE), window - PHRASE + 1)


def spelled(h: np.ndarray) -> np.ndarray:
    """Each word's LETTERS letters as one number."""
    return h & np.uint64((1 << (LETTERS * BITS)) - 1)


def phrase_keys(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases at these places, spelled, as two numbers of half a phrase each."""
    out = []
    for half in range(2):
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(half * PHRASE // 2, (half + 1) * PHRASE // 2):
            key = (key << np.uint64(LETTERS * BITS)) | codes[at + k]
        out.append(key.view(np.int64))
    return out[0], out[1]


def letters(codes: np.ndarray) -> str:
    """A text of letters for spelled words: LETTERS a word, each from an alphabet of its own.

    So the automaton's states have few edges, and phrases are met at words' beginnings only.
    Two words may share their letters; a phrase of eight that is met by such chance only adds
    windows, which are compared by their full hashes.
    """
    out = np.empty((len(codes), LETTERS), dtype=np.uint8)
    for k in range(LETTERS):
        out[:, k] = ((codes >> np.uint64(BITS * k)) & np.uint64((1 << BITS) - 1)).astype(np.uint8) + (k << BITS)
    return out.tobytes().decode("ascii")


def phrases_of(first: np.ndarray, second: np.ndarray) -> list[str]:
    """The letters of phrases that ``phrase_keys`` gave."""
    codes = np.empty((len(first), PHRASE), dtype=np.uint64)
    for half, key in enumerate((first, second)):
        for k in range(PHRASE // 2):
            shift = np.uint64(LETTERS * BITS * (PHRASE // 2 - 1 - k))
            codes[:, half * PHRASE // 2 + k] = (key.view(np.uint64) >> shift) & np.uint64((1 << (LETTERS * BITS)) - 1)
    text, size = letters(codes.ravel()), PHRASE * LETTERS
    return [text[at : at + size] for at in range(0, len(text), size)]


def compiled(phrases: list[str]) -> Iterator[ahocorasick.Automaton]:
    """Automata of at most SHARD phrases each, one at a time."""
    for at in range(0, len(phrases), SHARD):
        shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for phrase in phrases[at : at + SHARD]:
            shard.add_word(phrase)
        shard.make_automaton()
        yield shard


def _counted(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and whether they were met once (1) or more often (2)."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    n = np.add.reduceat(weights[order], first) if len(first) else np.empty(0, dtype=np.int64)
    return [c[first] for c in columns], np.minimum(n, 2).astype(np.int32)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, found in held.items():
                (first, second), n = _counted([np.concatenate([f[k] for f in found]) for k in (0, 1)], np.concatenate([f[2] for f in found]))
                yield pa.RecordBatch.from_pydict({"k1": pa.array(first), "k2": pa.array(second), "part": pa.array(np.full(len(first), part, dtype=np.int32)), "n": pa.array(n)})
            held.clear()

        for batch in batches:
            for part, text, copies in zip(batch.column("part").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("copies").to_pylist()):
                words = text.split()
                if len(words) < window:
                    continue
                h, at = _anchored(words, window)
                at = _distinct(at)
                held.setdefault(part, []).append((*phrase_keys(spelled(h), at), np.full(len(at), copies)))
                size += len(at)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


_HITS = pa.schema([("h", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("blob", pa.binary()), ("starts", pa.binary())])
_HITS_SQL = "h long, part int, n int, blob binary, starts binary"


def _hits(window: int):
    """Rows of two kinds: windows anchored at a hit (h, n), and a text's places of them (blob, starts).

    ``starts`` are runs of window starts, first and past the last, as 32-bit numbers.
    """

    def run(key: tuple, texts: pa.Table, recurring: pa.Table) -> pa.Table:
        part = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        phrases = phrases_of(recurring.column("k1").to_numpy(), recurring.column("k2").to_numpy())
        parsed, hashes, weights, blobs, places = [], [], [], [], []
        if phrases:
            for blob, text, copies in zip(texts.column("blob").to_pylist(), texts.column("text").cast(pa.binary()).to_pylist(), texts.column("copies").to_pylist()):
                words = text.split()
                if len(words) >= window:
                    h, at = _anchored(words, window)
                    parsed.append((blob, h, at, letters(spelled(h)), copies, np.zeros(len(h), dtype=bool)))
        for shard in compiled(phrases):
            for _, _, _, spelling, _, met in parsed:
                met[[(end + 1) // LETTERS - PHRASE for end, _ in shard.iter(spelling)]] = True
        for blob, h, at, _, copies, met in parsed:
            there = met[at]
            if there.any():
                edge = np.flatnonzero(np.diff(there, prepend=False, append=False))
                hashes.append(rolling(h, window)[there].view(np.int64))
                weights.append(np.full(int(there.sum()), copies))
                blobs.append(blob)
                places.append(edge.astype(np.uint32).tobytes())
        values, n = _counted([np.concatenate(hashes)], np.concatenate(weights)) if hashes else ([np.empty(0, dtype=np.int64)], np.empty(0, dtype=np.int32))
        counted, kept = len(n), len(blobs)
        columns = [
            pa.chunked_array([pa.array(values[0], pa.int64()), pa.nulls(kept, pa.int64())]),
            pa.array(np.full(counted + kept, part, dtype=np.int32)),
            pa.chunked_array([pa.array(n, pa.int32()), pa.nulls(kept, pa.int32())]),
            pa.chunked_array([pa.nulls(counted, pa.binary()), pa.array(blobs, pa.binary())]),
            pa.chunked_array([pa.nulls(counted, pa.binary()), pa.array(places, pa.binary())]),
        ]
        return pa.table(columns, schema=_HITS)

    return run


def _marked(window: int, digest: bool):
    def run(key: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        h, found = hits.column("h"), hits.column("blob").to_pylist()
        known = np.sort(h.drop_null().to_numpy().view(np.uint64))
        at_of = {b: np.frombuffer(s, dtype=np.uint32).reshape(-1, 2) for b, s in zip(found, hits.column("starts").to_pylist()) if b is not None}
        blobs = texts.column("blob").to_pylist()
        total, removed, kept_text = [], [], []
        for blob, text in zip(blobs, texts.column("text").cast(pa.binary()).to_pylist()):
            words = text.split()
            n, runs = len(words), at_of.get(blob)
            if runs is not None and len(known):
                starts = np.concatenate([np.arange(a, b) for a, b in runs])
                starts = starts[_among(rolling(hashed(words), window)[starts], known)]
                edge = np.zeros(n + 1, dtype=np.int64)
                edge[starts] += 1
                edge[starts + window] -= 1
                keep = np.cumsum(edge[:-1]) == 0
                words = [x for x, k in zip(words, keep.tolist()) if k]
            total.append(n)
            removed.append(n - len(words))
            kept_text.append(b" ".join(words))
        return pa.table({"blob": pa.array(blobs, pa.binary()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array([hashlib.sha256(x).hexdigest() for x in kept_text] if digest else [x.decode("utf-8", "replace") for x in kept_text], pa.string())})

    return run


def remove_repeats(docs: DataFrame, window: int = 35, digests: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the kept words joined by one space.

    With ``digests`` ``kept`` is their SHA-256, so that the texts stay in the tasks.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * buckets, -(-size // PART))
    blob = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    named = packed(without(docs, "n_words", "n_removed", "kept"), blob.alias("blob"), F.coalesce("text", F.lit("")).alias("given"))
    texts = named.select("blob", F.col("given").alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"), F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("blob"), F.lit(parts)).cast("int"))
    table = f"lodestone_texts_{uuid.uuid4().hex}"
    try:
        texts.repartition(buckets, "part").write.option("compression", "zstd").option("path", fresh_dir(spark, "texts")).bucketBy(buckets, "part").saveAsTable(table)
        texts = spark.table(table)

        def recurring(rows: DataFrame, *key: str) -> DataFrame:
            """Keys met more than once; a part has few rows of a key (one per flush), so groups are bounded."""
            return rows.withColumn("all", F.sum("n").over(Window.partitionBy(*key))).where("all > 1").select(*key, "part")

        by_part = texts.select("part", "blob", "text", "copies").groupBy("part")
        phrases = recurring(texts.select("part", "text", "copies").mapInArrow(_anchor_rows(window), "k1 long, k2 long, part int, n int"), "k1", "k2")
        hits = staged(by_part.cogroup(phrases.groupBy("part")).applyInArrow(_hits(window), _HITS_SQL), "hits")
        windows = recurring(hits.where("blob is null").select("h", "part", "n"), "h")
        told = windows.select("part", "h", F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("binary").alias("starts")).unionByName(hits.where("blob is not null").select("part", "h", "blob", "starts"))
        marked = by_part.cogroup(told.groupBy("part")).applyInArrow(_marked(window, digests), "blob binary, n_words long, n_removed long, kept string")
        marked = staged(marked, "kept-words")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return named.join(marked, "blob").select("row.*", "n_words", "n_removed", "kept")
