"""Align the tokens of two tokenizers over the same bytes.

A text's tokens of either side are byte ranges. In each batch of documents pandas' merge_asof
finds for each token start the other side's covering token, keyed by document: the documents
of a batch stand one behind the other on one axis of bytes, where both sides begin a document
at the same place, so the key is part of the offset. The union of both directions is the set of
overlaps; where a start meets an equal start a new group begins, so groups end where tokens
of both sides end.

Links are all pairs of a group. Where one side has one token these are its overlaps; other
groups are spread out, and large ones by their distinct ids with counts, so
no more than distinct id pairs are ever formed.

How many documents hold an id pair is counted by Spark over all documents. The most frequent
pairs, a bounded number, go to the tasks as a sorted array; all other pairs meet their
counts in a join, where none of them is hot.

Both encoders cut a text where either side always cuts, and keep the ids of what they met. A
long text is handled in stretches that begin at a single space between two other characters,
where both sides cut too, so a task's memory doesn't follow the length of a text.

Defined cases: null and empty texts, and texts whose tokens don't give back their bytes (U+2581
in a text, for one), have no tokens. Special tokens' strings are plain text. Rows that share an
id are aligned one by one and each counts as a document. Columns other than the id and the
text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import BYTE_WORDS, vocabulary
from lodestone.llm.common import frequent, holds, staged

SPACE = "▁"
#: Texts of a batch that are aligned together, and how far a long text goes before it is cut, in characters.
STRETCH = 1 << 20
#: Groups of more pairs than this go by distinct ids.
WIDE = 1 << 12
_BREAK = re.compile(r"(?<=\S) (?=\S)")


class Symbols:
    """The bytes of each id, so that those of many ids are laid out at once."""

    def __init__(self, bytes_of: list[bytes]):
        self.lengths = np.array([len(x) for x in bytes_of], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)

    def spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes, and where each id's end."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b"", ends
        return self.letters[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes(), ends


class Pieces(dict):
    """Packed ids (little-endian uint32) of units of text by a sentencepiece model; those of units seen are kept.

    A unit is a run of spaces with what follows up to the next space. Merges don't cross units, since no
    piece holds the space sign behind another character; a model that has such a piece gets whole texts.
    """

    def __init__(self, path: str, keep: int = 250_000):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        whole = any(SPACE in x.lstrip(SPACE) for x in names)
        self.units = (lambda text: [text]) if whole else re.compile(" *[^ ]+| +").findall
        self.bytes_of = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.keep, self.older = keep, {}
        self.blank = array("I", [self.model.piece_to_id(SPACE)]).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that begin with a space each; the model gets all units that it hasn't seen at once."""
        cut = [self.units(t) for t in texts]
        if len(self) > self.keep:
            self.older = dict(self)
            self.clear()
        new = {u for units in cut for u in units if u not in self}
        known = {u: self.older[u] for u in new if u in self.older}
        rest = [u for u in new if u not in known]
        found = known | {u: array("I", ids).tobytes() for u, ids in zip(rest, self.model.encode([u[1:] for u in rest]))}
        if " " in found:
            found[" "] = self.blank
        self.update(found)
        out = [b"".join(map(self.__getitem__, units)) for units in cut]
        for u in [u for u in found if len(u) > 64]:
            del self[u]
        return out


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """One pair of encoders per worker process."""
    holds("align", _SIDES.clear)
    if (a_path, b_path) not in _SIDES:
        _SIDES.clear()
        _SIDES[a_path, b_path] = Sides(a_path, b_path)
    return _SIDES[a_path, b_path]


class Sides:
    """Both tokenizers, with the bytes and the decimal names of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import tiktoken

        vocab = vocabulary(a_path)
        ranks = {raw: i for i, raw in enumerate(vocab.bytes_of) if i not in vocab.special.values()}
        self.code = tiktoken.Encoding("a", pat_str=BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        self.b = Pieces(b_path)
        self.a_bytes, self.b_bytes = Symbols(vocab.bytes_of), Symbols(self.b.bytes_of)
        self.base = len(self.b.bytes_of)
        # each id with what may follow it: A has "," or "|", B has "," or ";"
        self.names = Symbols([b"%d%c" % (i, e) for i in range(len(vocab.bytes_of)) for e in b",|"] + [b"%d%c" % (i, e) for i in range(self.base) for e in b",;"])

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for texts that begin with a space; None where they don't give the bytes back."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, b in zip(texts, self.b.packed(texts)):
            ids = np.frombuffer(self.code(text, set()), "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            raw = text.encode()
            out.append(ids if self.a_bytes.spelled(ids[0])[0] == raw and self.b_bytes.spelled(ids[1])[0] == raw else None)
        return out


def stretches(text: str) -> Iterator[str]:
    """A space and the text, cut so that each part begins with a space where both sides cut."""
    text, start = " " + text, 0
    while len(text) - start > STRETCH and (m := _BREAK.search(text, start + STRETCH)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


class Alignment:
    """Groups and links of several stretches: flat arrays, in order."""

    def __init__(self, both: Sides, parts: list[tuple[np.ndarray, np.ndarray]]):
        n = len(parts)
        count = np.array([(len(a), len(b)) for a, b in parts], dtype=np.int64).reshape(n, 2)
        none = np.empty(0, np.int64)
        self.a, self.b = (np.concatenate([none, *(p[k] for p in parts)]) for k in (0, 1))
        self.both, self.count, self.n = both, count, n
        la, lb = both.a_bytes.lengths[self.a], both.b_bytes.lengths[self.b]
        self.sa, self.sb = np.cumsum(la) - la, np.cumsum(lb) - lb
        a_at, b_at = pd.DataFrame({"start": self.sa}), pd.DataFrame({"start": self.sb})
        self.over_b = pd.merge_asof(a_at, b_at.assign(j=np.arange(len(self.sb))), on="start")["j"].to_numpy() if len(self.sa) else np.empty(0, np.int64)
        self.over_a = pd.merge_asof(b_at, a_at.assign(j=np.arange(len(self.sa))), on="start")["j"].to_numpy() if len(self.sb) else np.empty(0, np.int64)
        new_a, self.new_b = self.sb[self.over_b] == self.sa, self.sa[self.over_a] == self.sb
        self.ga, self.gb = np.cumsum(new_a) - 1, np.cumsum(self.new_b) - 1
        groups = int(self.ga[-1]) + 1 if len(self.ga) else 0
        self.na, self.nb = np.bincount(self.ga, minlength=groups), np.bincount(self.gb, minlength=groups)
        self.part_a = np.repeat(np.arange(n), count[:, 0])
        self.groups = np.bincount(self.part_a[new_a], minlength=n)
        self.first = np.cumsum(self.groups) - self.groups  # each part's first group
        self.links = np.array([x.sum() for x in np.split(self.na * self.nb, self.first[1:])], dtype=np.int64) if n else np.empty(0, np.int64)

    def named(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3;`` of each part."""
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool)
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        upto_a, upto_b = np.cumsum(self.na), np.cumsum(self.nb)
        codes[np.arange(len(self.a)) + (upto_b - self.nb)[self.ga]] = 2 * self.a + last(self.ga)
        codes[np.arange(len(self.b)) + upto_a[self.gb]] = 2 * (len(self.both.a_bytes.lengths) + self.b) + last(self.gb)
        text, ends = self.both.names.spelled(codes)
        cuts = np.append(0, ends)[np.append(0, np.cumsum(self.count.sum(axis=1)))].tolist()
        return [text[s:e] for s, e in zip(cuts, cuts[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ``part``, ``a * base + b`` of linked tokens with the number of their links."""
        base, size = self.both.base, self.both.base * len(self.both.a_bytes.lengths)
        width = self.na * self.nb
        simple = (self.na == 1) | (self.nb == 1)
        i = np.concatenate([np.arange(len(self.a)), self.over_a[~self.new_b]])
        j = np.concatenate([self.over_b, np.flatnonzero(~self.new_b)])  # the union of both directions
        keep = simple[self.ga[i]]
        i, j = i[keep], j[keep]
        first_b = np.cumsum(self.nb) - self.nb
        spread = np.flatnonzero(~simple[self.ga] & (width <= WIDE)[self.ga])
        times = self.nb[self.ga[spread]]
        more = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        i, j = np.concatenate([i, np.repeat(spread, times)]), np.concatenate([j, np.repeat(first_b[self.ga[spread]], times) + more])
        keys, n = np.unique(self.part_a[i] * size + self.a[i] * base + self.b[j], return_counts=True)
        first_a, extra = np.cumsum(self.na) - self.na, []
        for g in np.flatnonzero(~simple & (width > WIDE)):
            x, nx = np.unique(self.a[first_a[g] : first_a[g] + self.na[g]], return_counts=True)
            y, ny = np.unique(self.b[first_b[g] : first_b[g] + self.nb[g]], return_counts=True)
            extra.append((self.part_a[first_a[g]] * size + (x[:, None] * base + y).ravel(), np.outer(nx, ny).ravel()))
        if extra:
            keys, n = summed(np.concatenate([keys, *(k for k, _ in extra)]), np.concatenate([n, *(m for _, m in extra)]))
        return keys // size, keys % size, n


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(keys, return_inverse=True)
    return keys, np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64)


def _batched(both: Sides, texts: list[str | None]) -> Iterator[tuple[list[int], Alignment, set[int]]]:
    """Alignments of about STRETCH characters, with the row of each part, and the rows that have no tokens."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0

    def aligned() -> tuple[list[int], Alignment, set[int]]:
        found = list(zip(rows, both.tokens(parts)))
        fit = [(r, f) for r, f in found if f is not None]
        return [r for r, _ in fit], Alignment(both, [f for _, f in fit]), {r for r, f in found if f is None}

    for row, text in enumerate(texts):
        for part in stretches(text) if text else ():
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= STRETCH:
                yield aligned()
                rows, parts, size = [], [], 0
    if rows:
        yield aligned()


def _groups(a_path: str, b_path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for row, text in enumerate(texts):
                parts = both.tokens(list(stretches(text))) if text else []
                at = group = 0
                for part in [] if any(p is None for p in parts) else parts:
                    one = Alignment(both, [part])
                    n = len(one.na)
                    starts = one.sa[np.cumsum(one.na) - one.na] + at
                    end = at + int(both.a_bytes.lengths[one.a].sum())
                    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k)), pa.int32()), pa.array(x, pa.int32())) for k, x in ((one.na, one.a), (one.nb, one.b))]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[row]] * n, pa.int64()), pa.array(np.arange(group, group + n)), pa.array(starts), pa.array(np.append(starts[1:], end)), *lists], schema=schema)
                    at, group = end, group + n

    return run


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each group: ``doc_id, group, start, end`` (bytes of space and text), ``a_ids, b_ids``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_groups(a_path, b_path), "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>")


_SUMMARY = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _summary(a_path: str, b_path: str):
    schema = pa.schema([("uid", pa.int64()), *((x, pa.int64()) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, uid = sides(a_path, b_path), TaskContext.get().partitionId() << 40
        none = np.empty(0, np.int64)
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((n, 4), dtype=np.int64)
            states: list = [None] * n
            tail: list[bytes] = [b""] * n
            held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
            failed: set[int] = set()
            for rows, part, fail in _batched(both, batch.column("text").to_pylist()):
                failed |= fail
                of, keys, times = part.pairs()
                cuts = np.searchsorted(of, np.arange(1, part.n))
                np.add.at(sums, rows, np.column_stack([part.count, part.groups, part.links]))
                for row, name, k, t in zip(rows, part.named(), np.split(keys, cuts), np.split(times, cuts)):
                    if states[row] is None:
                        states[row] = hashlib.sha256()
                    states[row].update(tail[row] + name[:-1])
                    tail[row] = name[-1:]
                    held[row].append((k, t))
            for row in failed:
                sums[row], states[row], held[row] = 0, None, []
            joined = [x[0] if len(x) == 1 else summed(*map(np.concatenate, zip(*x))) if x else (none, none) for x in held]
            offsets = pa.array(np.append(0, np.cumsum([len(k) for k, _ in joined])), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[c] for x in joined]) if n else none)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), batch.column("doc_id"), *(pa.array(sums[:, c]) for c in range(4)), pa.array([s.hexdigest() if s else "" for s in states], pa.string()), *lists], schema=schema)
            uid += n

    return run


@lru_cache(maxsize=1)
def _base(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def pair_counts(summary: DataFrame, base: int) -> DataFrame:
    """``pair, docs, best``: how many documents hold an id pair linked, and whether no pair of its A id has more."""
    counts = staged(summary.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    most = counts.groupBy(F.expr(f"pair div {base}").alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {base}")).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def most_frequent(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pair, docs, best`` of at most ``size`` pairs, sorted by pair."""
    top = counts.where(frequent(counts, "docs", size)).toPandas().sort_values("pair")
    return tuple(top[c].to_numpy(dtype=kind) for c, kind in (("pair", "i8"), ("docs", "i8"), ("best", "?")))


def _weighed(top: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Sums over the frequent pairs of each row, and the other pairs as they are."""
    keys, docs, best = top
    columns = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pairs, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(n), pa.compute.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * docs[at[hit]])
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(row[~hit], minlength=n))), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sums[0]), pa.array(sums[1]), *rest], names=[*columns, "n_best", "count_sum", "pairs", "times"])

    return run


def summarize(docs: DataFrame, a_path: str, b_path: str, known: int = 1 << 17) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``.

    ``known`` bounds the pairs whose counts the tasks are given, some 17 bytes each.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summary = staged(narrow.mapInArrow(_summary(a_path, b_path), _SUMMARY), "aligned")
    counts = staged(pair_counts(summary, _base(b_path)), "pair-counts")
    kinds = _SUMMARY.replace("pairs array", "n_best long, count_sum long, pairs array")
    done = staged(summary.mapInArrow(_weighed(most_frequent(counts, known)), kinds), "weighed")
    rare = done.where(F.size("pairs") > 0).select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rare = rare.select("uid", F.col("p.pairs").alias("pair"), F.col("p.times").alias("m")).join(counts, "pair")
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("docs")).alias("more_sum"))
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("long").alias(c)
    return done.join(rare, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
