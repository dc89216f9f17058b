"""A hidden Markov language model: latent states trained by Baum-Welch, exact likelihood of whole texts.

The alphabet of the chain is bounded: the most frequent words of the corpus are symbols of their
own, every other word belongs to one of a fixed number of classes by its last letters, and an end
symbol closes a text. A word that isn't a symbol of its own costs, besides its class, its share of the
class's count over the whole corpus; a word that the corpus lacks has the share of one unseen word
there. So the model says the probability of every text, whatever its words, from counts
of all training words, which are as many as the corpus has and never leave Spark.

1. Words are counted over all training documents. Only the symbols (a bounded number) and one
   row for each class reach the driver.
2. Texts become sequences of symbols, in a written table; rare words stay beside them.
3. Baum-Welch: each task runs forward and backward recursions over its sequences, a step over many
   sequences at once, and passes on expected counts by symbol and state. Spark adds them up; the driver
   gets one row for each symbol and state, normalises, and the next round begins. Every round sees all
   training documents; only a caller's own ``rounds`` can have one see a share, by a hash of the text.
   Sequences are cut into stretches of 512 symbols for training only; stretches that go on have a
   start distribution of their own.
4. The scaled forward recursion runs over each whole sequence. Rare words meet their counts in a join, in
   which none of them is hot.

Expected counts are added up as fixed-point numbers, so their order doesn't matter.

Defined cases: null text counts as empty, which is its end alone; a null id is hashed as an
empty string; repeated rows are counted and scored each; long texts need memory for their
symbols only. Columns other than the id and the text are not read. An empty table gives an
empty result; with no training document every word is unseen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import binary_values, frequent, holds, staged

STATES = 8
CLASSES = 4096
SYMBOLS = 1 << 15
STRETCH = 512
#: Symbols that are taken through the recursions together.
TOGETHER = 1 << 19
#: The same in training, which keeps two rows of states for each.
TRAINED_TOGETHER = 1 << 18
#: Shares of the training documents, in sixteenths, that the rounds see: all of them in each.
ROUNDS = (16,) * 7
_FIXED = 1 << 16  # expected counts are added up in such parts


def word_class(word: bytes) -> int:
    """A class by the last letters."""
    return xxhash.xxh3_64_intdigest(word[-3:]) % CLASSES


def held_out() -> Column:
    """The fifth of the documents that is never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


# the chain, in numpy


@dataclass
class Chain:
    """``start`` of documents and of stretches that go on, ``move`` from state to state, ``emit`` by symbol."""

    start: np.ndarray  # 2 x states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states; column sums are 1

    @classmethod
    def initial(cls, weights: np.ndarray, states: int = STATES) -> Chain:
        """Sticky states whose symbols lean at random (by a fixed seed) from their frequency."""
        rng = np.random.default_rng(11)
        emit = weights[:, None] * np.exp(rng.normal(0, 1.0, (len(weights), states)))
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full((2, states), 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def of(cls, counts: np.ndarray, weights: np.ndarray, prior: float = 200.0) -> Chain:
        """From expected counts: rows of symbols, then two of starts, then those of moves.

        Symbols are smoothed by ``prior`` draws from the corpus's frequencies.
        """
        k, n = counts.shape[1], len(weights)
        emit = counts[:n] + prior * weights[:, None]
        start = counts[n : n + 2] + 0.5
        move = counts[n + 2 :] + 0.5
        return cls(start / start.sum(axis=1, keepdims=True), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 of each whole sequence's probability, by the scaled forward recursion."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        sizes = np.array([len(sequences[i]) for i in order])
        flat = np.concatenate([sequences[i] for i in order])
        begin = np.cumsum(sizes) - sizes
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # sequences longer than t
        total = np.zeros(len(order))
        now = self.start[0] * self.emit[flat[begin]]
        for t, n in enumerate(live.tolist()):
            if t:
                now = (now[:n] @ self.move) * self.emit[flat[begin[:n] + t]]
            scale = now.sum(axis=1)
            now /= scale[:, None]
            total[:n] += np.log10(scale)
        out = np.empty(len(order))
        out[order] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Expected counts of symbols, starts and moves, laid out as ``of`` takes them."""
        k, n = self.move.shape[0], len(self.emit)
        parts = [(s[i : i + STRETCH], int(i > 0)) for s in sequences for i in range(0, len(s), STRETCH)]
        parts.sort(key=lambda p: -len(p[0]))
        sizes = np.array([len(p) for p, _ in parts])
        begun = np.array([b for _, b in parts])
        flat = np.concatenate([p for p, _ in parts])
        begin = np.cumsum(sizes) - sizes
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right").tolist()
        symbols = np.concatenate([flat[begin[:m] + t] for t, m in enumerate(live)])  # those of step 0, then of step 1, ...
        at = np.cumsum([0, *live]).tolist()
        said, alphas = self.emit[symbols], np.empty((len(symbols), k))
        scales, ones, back = np.empty(len(symbols)), np.ones(k), self.move.T.copy()
        for t, m in enumerate(live):
            here = slice(at[t], at[t + 1])
            now = (now[:m] @ self.move if t else self.start[begun]) * said[here]
            scales[here] = 1 / (now @ ones)
            now = np.multiply(now, scales[here, None], out=alphas[here])
        moves = np.zeros((k, k))
        said *= scales[:, None]
        beta = np.ones((live[-1], k))
        for t in range(len(live) - 1, -1, -1):
            if t + 1 < len(live):
                m = live[t + 1]
                ahead = beta * said[at[t + 1] : at[t + 2]]
                moves += alphas[at[t] : at[t] + m].T @ ahead
                beta = np.ones((live[t], k))
                np.matmul(ahead, back, out=beta[:m])
            alphas[at[t] : at[t + 1]] *= beta  # now the posterior of the states
        out = np.zeros((n + 2 + k, k))
        for j in range(k):
            out[:n, j] = np.bincount(symbols, weights=alphas[:, j], minlength=n)
        for b in (0, 1):
            out[n + b] = alphas[: live[0]][begun == b].sum(axis=0)
        out[n + 2 :] = moves * self.move
        return out


def _together(sequences: Iterator[tuple[int, np.ndarray]], most: int = TOGETHER) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    keys: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for key, s in sequences:
        keys.append(key)
        held.append(s)
        size += len(s)
        if size >= most:
            yield keys, held
            keys, held, size = [], [], 0
    if keys:
        yield keys, held


# the corpus, in Spark


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counted(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(word_class, words), pa.int32()), pa.array(seen.values(), pa.int64())], names=["word", "class", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in binary_values(batch, text_col):
                seen.update(_words(text))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    return run


@dataclass
class Lexicon:
    """What the driver knows of the counts: symbols, class totals, totals."""

    words: list[bytes]  # symbols of their own
    counts: np.ndarray
    class_total: np.ndarray
    class_words: np.ndarray
    texts: int
    tokens: int  # ends included
    distinct: int

    @property
    def weights(self) -> np.ndarray:
        """Frequency of each symbol, the classes and the end included, none of them zero."""
        raw = np.concatenate([self.counts, self.class_total, [self.texts]]) + 0.5
        return raw / raw.sum()

    @property
    def share(self) -> np.ndarray:
        """log10 of what a rare word's count is divided by in its class."""
        return np.log10(self.class_total + 0.5 * (self.class_words + 1))

    @property
    def base(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))


_ENCODED = "uid long, doc_id long, held_out boolean, share int, n_tokens long, n_known long, base double, classes double, symbols binary, words array<binary>, times array<long>"
_ENCODED_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("share", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("classes", pa.float64()), ("symbols", pa.binary()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])


class _Numbers(dict):
    """Word -> symbol, with a bounded number of rare words kept."""

    def __init__(self, lexicon: Lexicon):
        super().__init__((w, i) for i, w in enumerate(lexicon.words))
        self.own, self.room = len(lexicon.words), 200_000

    def __missing__(self, word: bytes) -> int:
        i = self.own + word_class(word)
        if len(word) <= 40 and len(self) < self.own + self.room:
            self[word] = i
        return i


def _encoded(lexicon: Lexicon):
    """Symbols of each text, what is known of its base score, and its rare words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = _Numbers(lexicon), len(lexicon.words)
        holds("hmm", number.clear)
        end = own + CLASSES
        logs = np.log10(np.append(lexicon.counts, lexicon.texts) + 0.5)  # symbols of their own, then the end
        share = lexicon.share
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = binary_values(batch, "text")
            out: list[list] = [[] for _ in range(7)]
            for text in texts:
                words = _words(text)
                s = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
                rare = np.flatnonzero(s >= own)
                n = Counter([words[i] for i in rare.tolist()])
                known = len(words) - len(rare)
                out[0].append(len(words) + 1)
                out[1].append(known + (lexicon.texts > 0))
                out[2].append(float(logs[s[s < own]].sum() + logs[-1]))
                out[3].append(float(-share[s[rare] - own].sum()))
                out[4].append(np.append(s, end).astype("<u2").tobytes())
                out[5].append(list(n))
                out[6].append(list(n.values()))
            rows = len(texts)
            shares = [xxhash.xxh3_64_intdigest(t) % 16 for t in texts]
            given = [pa.array(np.arange(uid, uid + rows)), batch.column("doc_id"), batch.column("held_out"), pa.array(shares, pa.int32())]
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(x, f.type) for x, f in zip(out, list(_ENCODED_ARROW)[4:]))], schema=_ENCODED_ARROW)
            uid += rows

    return run


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2").astype(np.int64) for b in batch.column("symbols").to_pylist()]


def _expected(chain: Chain):
    k = chain.move.shape[0]
    names = ["row", *(f"s{j}" for j in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(chain.emit) + 2 + k, k))
        for _, held in _together(((0, s) for batch in batches for s in _sequences(batch)), TRAINED_TOGETHER):
            total += chain.expected(held)
        fixed = np.rint(total * _FIXED).astype(np.int64)
        rows = np.flatnonzero(fixed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(fixed[rows, j]) for j in range(k))], names=names)

    return run


def _scored(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("uid").to_pylist()
            for ids, held in _together(zip(keys, _sequences(batch))):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chain.log10(held))], names=["uid", "chain"])

    return run


def count_words(docs: DataFrame) -> DataFrame:
    """``word, class, n`` over all words of ``docs``."""
    counted = docs.select("text").mapInArrow(_counted("text"), "word binary, class int, n long")
    return staged(counted.groupBy("word", "class").agg(F.sum("n").alias("n")), "words")


def lexicon(counts: DataFrame, texts: int, size: int = SYMBOLS) -> tuple[Lexicon, DataFrame]:
    """The bounded part of the counts, and the counts of all words that aren't symbols of their own."""
    top = frequent(counts, "n", size)
    own = sorted(((-r.n, bytes(r.word)) for r in counts.where(top).select("word", "n").collect()))
    rest = counts.where(~top)
    total, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        total[r["class"]], words[r["class"]] = r.n, r.words
    found = Lexicon([w for _, w in own], np.array([-n for n, _ in own], dtype=float), total, words, texts, 0, 0)
    found.tokens = int(found.counts.sum() + total.sum()) + texts
    found.distinct = len(own) + int(words.sum()) + (texts > 0)
    return found, rest


def train(encoded: DataFrame, found: Lexicon, states: int = STATES, rounds: tuple[int, ...] = ROUNDS) -> Chain:
    """Baum-Welch over all training rows of ``encoded``; other ``rounds``: sixteenths of them that each round sees."""
    chain = Chain.initial(found.weights, states)
    sums = [F.sum(f"s{j}").alias(f"s{j}") for j in range(states)]
    for share in rounds:
        seen = encoded.where(~F.col("held_out") & (F.col("share") < share)).select("symbols")
        parts = seen.mapInArrow(_expected(chain), ", ".join(["row long", *(f"s{j} long" for j in range(states))]))
        counts = np.zeros((len(found.weights) + 2 + states, states))
        added = parts.groupBy("row").agg(*sums).toPandas()
        counts[added["row"].to_numpy(dtype=int)] = added[[f"s{j}" for j in range(states)]].to_numpy(dtype=float) / _FIXED
        if counts.any():  # there may be no text to learn from; the states then stay as they lean
            chain = Chain.of(counts, found.weights)
    return chain


def score(docs: DataFrame, states: int = STATES, rounds: tuple[int, ...] = ROUNDS, size: int = SYMBOLS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``."""
    if size + CLASSES >= 1 << 16:
        raise ValueError("symbols are kept in two bytes")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    learned = narrow.where(~F.col("held_out"))
    found, rest = lexicon(count_words(learned), learned.count(), size)
    encoded = staged(narrow.select("doc_id", "held_out", "text").mapInArrow(_encoded(found), _ENCODED), "symbols")
    chain = train(encoded, found, states, rounds)
    likely = encoded.select("uid", "symbols").mapInArrow(_scored(chain), "uid long, chain double")
    rare = encoded.where(F.size("words") > 0).select("uid", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rare = rare.select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("m")).join(rest.select("word", "n"), "word", "left")
    each = F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    rare = rare.groupBy("uid").agg(F.sum(each).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("met"))
    rare_sum = F.coalesce("rare", F.lit(0.0))
    joined = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "classes").join(likely, "uid").join(rare, "uid", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(found.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_sum - F.col("n_tokens") * F.lit(found.base)).alias("base_score"),
        (F.col("chain") + F.col("classes") + rare_sum).alias("score"),
    )
