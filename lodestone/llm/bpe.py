"""Byte-pair encoding with a compiled lexicon, and decoding.

The frequent words of the corpus (a bounded number) are compiled, with their ids as output,
into a minimal acyclic automaton whose states share suffixes. It is written once to the
shared folder; Spark hands it to each executor once, whatever store that folder is on, and the
tasks map it into memory. A word is looked up by walking the automaton; the number of words
passed on the way is the word's rank, which addresses its ids. Words that the lexicon lacks
are merged exactly by pair ranks; tiktoken's merge kernel does this for words of sensible
length, ``Vocabulary.merge`` says the same in Python.

A text is cut at the vocabulary's special tokens, then into runs that end before white
space, so that a run's ids depend on the run alone. Runs seen are kept in a bounded cache of
two generations, so that what is still asked for outlives the older one.

Defined cases: null text counts as empty and has no ids; special-token strings in a text
become their special ids, as the tokenizers library does; decoding replaces byte sequences
that are not UTF-8. Repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_dir, holds, staged

#: Unicode White_Space, which Python's own \s doesn't match exactly.
WS = "\t-\r \x85\xa0  -     　"
#: Word patterns of the two public vocabularies (fixed values).
BYTE_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
LOWER_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+"
NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(spare)
            spare += 1
    return [chars[b] for b in range(256)]


class Vocabulary:
    """Merges, byte symbols and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        ids = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.lower = bool(suffix)
        self.inner = [ids[c] for c in alphabet]
        self.final = [ids[c + suffix] for c in alphabet]
        self.enders = {i for t, i in ids.items() if suffix and t.endswith(suffix)}
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(ids[a] << 16 | ids[b], rank << 16 | ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(LOWER_WORDS if self.lower else BYTE_WORDS)
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(back[c] for c in token.removesuffix(suffix)) + (b" " if suffix and token.endswith(suffix) else b"")
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.lengths = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank merges first, the leftmost of equals."""
        ids = [self.inner[b] for b in word]
        if ids:
            ids[-1] = self.final[word[-1]]
        if len(ids) > 400:
            return self._merge_long(ids)
        get = self.pairs.get
        rank = [get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:])]
        while rank:
            best = min(rank)
            if best == NONE:
                break
            i = rank.index(best)
            ids[i : i + 2] = [best & 0xFFFF]
            del rank[i]
            if i:
                rank[i - 1] = get(ids[i - 1] << 16 | ids[i], NONE)
            if i < len(rank):
                rank[i] = get(ids[i] << 16 | ids[i + 1], NONE)
        return ids

    @cached_property
    def fast(self):
        """The same merges by tiktoken: a token's id is its rank in both vocabularies.

        A byte that UTF-8 lacks stands for the end of a word; it joins the last letter first.
        """
        import tiktoken

        ranks = {raw: i for i, raw in enumerate(self.bytes_of) if i not in self.special.values()}
        if self.lower:
            ranks = {self.marked(i): i for i in ranks.values()}
            ranks |= {bytes([b]): len(self.bytes_of) + b for b in range(256) if bytes([b]) not in ranks}
        join = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        return (lambda word: join(word + b"\xff")) if self.lower else join

    def quick(self, word: bytes) -> list[int]:
        """``merge`` by the kernel, but for words so long that it would take their square."""
        return self.fast(word) if len(word) <= 400 else self.merge(word)

    def marked(self, i: int) -> bytes:
        raw = self.bytes_of[i]
        return raw[:-1] + b"\xff" if i in self.enders else raw

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for words without a sensible length."""
        n, get = len(ids), self.pairs.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(v, i) for i in range(n - 1) if (v := get(ids[i] << 16 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            v, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 16 | ids[j], NONE) != v:
                continue
            ids[i], ids[j] = v & 0xFFFF, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (w := get(ids[a] << 16 | ids[b], NONE)) != NONE:
                    heapq.heappush(heap, (w, a))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lexicon:
    """A minimal acyclic automaton over bytes; ``find`` gives a word's packed ids or None.

    Layout: counts, edge range and finality of each state, then label, target and number of
    words to the left of each edge, then where each word's ids start, then the ids.
    """

    MAGIC = b"MADFST01"

    def __init__(self, buffer):
        head = struct.unpack_from("<8s4Q", buffer)
        if head[0] != self.MAGIC:
            raise ValueError("not a lexicon file")
        states, edges, words, ids = head[1:]
        view, at = memoryview(buffer), 40

        def take(code: str, count: int):
            nonlocal at
            size = struct.calcsize(code) * count
            part = view[at : at + size].cast(code)
            at += size + -size % 8
            return part

        self.first, self.final = take("I", states + 1), take("B", states)
        self.target, self.skip = take("I", edges), take("I", edges)
        self.labels = bytes(take("B", edges))
        self.start, self.ids = take("I", words + 1), take("I", ids)

    def find(self, word: bytes) -> bytes | None:
        state = rank = 0
        first, labels = self.first, self.labels
        for b in word:
            e = labels.find(b, first[state], first[state + 1])
            if e < 0:
                return None
            rank += self.skip[e]
            state = self.target[e]
        if not self.final[state]:
            return None
        return self.ids[self.start[rank] : self.start[rank + 1]].tobytes()

    @classmethod
    def compile(cls, outputs: dict[bytes, list[int]]) -> bytes:
        """Sorted words go in one by one; a finished suffix is replaced by an equal state."""
        words = sorted(outputs)
        registry: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple]] = []  # final, ((label, state), ...)
        path: list[list] = [[False, []]]  # states of the last word: final, edges

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in registry:
                registry[key] = len(frozen)
                frozen.append(key)
            return registry[key]

        last = b""
        for word in [*words, None]:
            common = 0
            if word is not None:
                while common < min(len(word), len(last)) and word[common] == last[common]:
                    common += 1
            while len(path) > common + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))
            if word is None:
                break
            for _ in word[common:]:
                path.append([False, []])
            path[-1][0] = True
            last = word
        root = freeze(path[0])
        reach = []  # words that can end from a state on; targets are frozen before sources
        for final, edges in frozen:
            reach.append(final + sum(reach[s] for _, s in edges))
        number = {s: i for i, s in enumerate([root, *(s for s in range(len(frozen)) if s != root)])}
        first, final_flags, labels, target, skip = [0], [], [], [], []
        for s in number:
            final, edges = frozen[s]
            passed = int(final)
            for label, t in edges:
                labels.append(label)
                target.append(number[t])
                skip.append(passed)
                passed += reach[t]
            first.append(len(labels))
            final_flags.append(int(final))
        start, ids = [0], []
        for word in words:
            ids.extend(outputs[word])
            start.append(len(ids))
        out = struct.pack("<8s4Q", cls.MAGIC, len(frozen), len(labels), len(words), len(ids))
        for code, values in (("I", first), ("B", final_flags), ("I", target), ("I", skip), ("B", labels), ("I", start), ("I", ids)):
            raw = struct.pack(f"<{len(values)}{code}", *values)
            out += raw + bytes(-len(raw) % 8)
        return out


@lru_cache(maxsize=4)
def open_lexicon(uri: str) -> Lexicon:
    """The executor's copy of a lexicon, mapped into memory."""
    with open(SparkFiles.get(uri.rpartition("/")[2]), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def publish(spark: SparkSession, uri: str, content: bytes) -> None:
    """Write a file to the shared folder through Spark's file systems and hand it to all executors."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(uri)


class Encoder(dict):
    """Packed ids (little-endian uint32) of texts; as a dict, those of runs already seen."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, keep: int = 250_000, fast: bool = True):
        super().__init__()
        self.merge, self.older = vocab.quick if fast else vocab.merge, {}
        self.vocab, self.lexicon, self.keep = vocab, lexicon, keep
        self.runs = None if vocab.lower else re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+").findall
        self.lower_runs = re.compile(f"[^{WS}]+").findall

    def __missing__(self, run: str) -> bytes:
        packed = self.older.get(run)
        if packed is None:
            packed = self.coded(run)
        if len(run) <= 64:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[run] = packed
        return packed

    def coded(self, run: str) -> bytes:
        vocab, out = self.vocab, []
        pieces = [run] if vocab.lower and run.isascii() and run.isalpha() else vocab.words.findall(run)
        if vocab.lower and len(pieces) > 1:  # a piece is a run too, and mostly one already seen
            return b"".join(map(self.__getitem__, pieces))
        for piece in pieces:
            word = piece.encode("utf-8", "surrogatepass")
            found = self.lexicon.find(word) if self.lexicon else None
            if found is None:
                ids = self.merge(word)
                found = struct.pack(f"<{len(ids)}I", *ids)
            out.append(found)
        return b"".join(out)

    @staticmethod
    def folded(text: str) -> str:
        """Lower case letter by letter: the final sigma has no form of its own."""
        return text.replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """``lower_runs``; Python's own white space is the same but for four separators."""
        return self.lower_runs(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def plain(self, text: str) -> bytes:
        if self.runs is None:
            if not text.isascii():
                import unicodedata

                text = unicodedata.normalize("NFC", text)
            return b"".join(map(self.__getitem__, self.split(self.folded(text))))
        return b"".join(map(self.__getitem__, self.runs(text)))

    def encode(self, text: str) -> bytes:
        if self.vocab.special_re is None or "<|" not in text:
            return self.plain(text)
        parts = self.vocab.special_re.split(text)
        return b"".join(struct.pack("<I", self.vocab.special[p]) if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4")
        lengths = self.vocab.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.vocab.letters[np.repeat(self.vocab.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocab_path: str, lexicon_uri: str | None = None, fast: bool = True) -> Encoder:
    """One encoder per worker process and vocabulary, so that its cache outlives a task."""
    holds("bpe", _ENCODERS.clear)
    key = (vocab_path, lexicon_uri, fast)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary(vocab_path), open_lexicon(lexicon_uri) if lexicon_uri else None, fast=fast)
    return _ENCODERS[key]


def _count_words(vocab_path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: Counter = Counter()
        vocab = vocabulary(vocab_path)
        split = Encoder(vocab).runs or Encoder(vocab).lower_runs

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for run_, n in runs.items():
                if n > 1:
                    for w in vocab.words.findall(run_.lower() if vocab.lower else run_):
                        if len(w) <= 32:
                            words[w] += n
            runs.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

        for batch in batches:
            for text in batch.column(text_col).to_pylist():
                if text:
                    runs.update(split(text))
            if len(runs) > 500_000:
                yield flush()
        yield flush()

    return run


def build_lexicon(docs: DataFrame, vocab_path: str, size: int = 50_000, text_col: str = "text") -> str:
    """Compile the ``size`` most frequent words of all documents; the file's URI.

    Each task counts all words of its rows and passes on those that it met more than once;
    a word's count only decides whether it is looked up or merged, never its ids. The driver
    gets at most ``size`` words, all from one class of counts on.
    """
    counted = docs.select(text_col).mapInArrow(_count_words(vocab_path, text_col), "word string, n long")
    counted = staged(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 3"), "word-counts")
    # the lowest of some hundred count classes down to which the words number at most ``size``
    level = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if held + r["count"] > size:
            break
        least, held = r["level"], held + r["count"]
    top = counted.where(level >= least).select("word").collect() if least is not None else []
    vocab = vocabulary(vocab_path)
    words = {r.word.encode("utf-8", "surrogatepass") for r in top}
    uri = fresh_dir(docs.sparkSession, "lexicon")
    publish(docs.sparkSession, uri, Lexicon.compile({w: vocab.merge(w) for w in words if w}))
    return uri


def encode(docs: DataFrame, vocab_path: str, lexicon_uri: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as packed little-endian uint32 (binary)."""

    @F.pandas_udf("binary")
    def ids(texts):
        code = encoder(vocab_path, lexicon_uri).encode
        return texts.map(lambda t: code(t) if t else b"")

    return docs.withColumn(out, ids(F.col(text_col)))


def decode(docs: DataFrame, vocab_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of packed ids."""

    @F.pandas_udf("string")
    def text(packed):
        code = encoder(vocab_path).decode
        return packed.map(lambda p: code(bytes(p)).decode("utf-8", "replace") if p is not None else "")

    return docs.withColumn(out, text(F.col(ids_col)))


def round_trip(docs: DataFrame, vocab_path: str, lexicon_uri: str | None = None) -> DataFrame:
    """Ids and their decoded text in one pass, as digests: the report over a whole corpus.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row; ids and texts stay in
    the task. Use ``encode`` and ``decode`` to get them.
    """
    import hashlib

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocab_path, lexicon_uri)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column("text").to_pylist():
                packed = coder.encode(text) if text else b""
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                raw = coder.decode(packed)
                back.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
