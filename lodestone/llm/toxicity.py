"""Toxicity scores from a misspelling-tolerant lexicon and the context of its hits.

A lexicon (what a bounded sample of labelled rows teaches, whole words and word stems, and a
list of the caller's if there is one) is a trie. It is intersected with a Levenshtein automaton of one edit per entry: the states of the
product are built as words ask for them and kept, so a word is decided in one pass over its
letters. Each hit is scored by its window: quotation marks or reporting words around it speak
for quotation, words of address for abuse. A logistic model over a few such counts gives the
score. Only the sample of labelled documents outside the held-out fifth is learned from.

Defined cases: null and empty text has no hits and gets the model's base score. A null doc_id
is never held out. Labels without a document, null labels and repeated labels (the larger
counts) are allowed; with fewer than ten usable labels of either kind fixed weights score the
caller's list. Extra columns stay; one of the name of the score gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import holds

REPORTING = frozenset("said says wrote writes called quote quoted quotes cited word term slur reported".split())
ADDRESS = frozenset("you your yours ur youre tu te vous toi du dich dir dein ihr eres".split())
WORDS = re.compile(r"[^\W\d_]+")
QUOTES = re.compile("[\"“”«»„]")
WINDOW = 6
VOCABULARY = math.log(1e8)  # evidence against chance among so many words
FEATURES = 6


class FuzzyTrie(dict):
    """The product of a lexicon trie and one-edit Levenshtein automata, built on demand.

    As a dict: word -> None, or (entry, edits). A state is a set of (trie node, edits, skipped
    letter); skipped lets two swapped letters count as one edit. Entries that end in ``*`` are
    stems: they match every word that begins with them. Entries shorter than ``min_fuzzy``
    letters are matched as they are.
    """

    def __init__(self, entries, min_fuzzy: int = 5, keep: int = 200_000, most_states: int = 20_000):
        super().__init__()
        self.keep, self.most_states = keep, most_states
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]  # some entry below takes an edit
        for entry in sorted(entries):
            word, node = entry.removesuffix("*"), 0
            takes = len(word) >= min_fuzzy and not entry.endswith("*")
            self.fuzzy[0] |= takes
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.whole.append(None)
                    self.stem.append(None)
                    self.fuzzy.append(False)
                node = self.children[node][c]
                self.fuzzy[node] |= takes
            (self.stem if entry.endswith("*") else self.whole)[node] = entry
        self.min_fuzzy = min_fuzzy
        self._restart()

    def _restart(self) -> None:
        """Forget the states built so far: they are built again as words ask for them."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple | None] = []
        self.halts: list[tuple | None] = []  # a stem is complete: the rest of the word is free
        self.start = self._state({(0, 0, "")})

    def _state(self, items) -> int:
        items = set(items)
        for node, edits, skipped in list(items):  # letters of the entry that the word lacks
            if not edits and not skipped and self.fuzzy[node]:
                for child in self.children[node].values():
                    if self.fuzzy[child]:
                        items.add((child, 1, ""))
        key = frozenset(items)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = sorted((e, self.whole[n]) for n, e, s in key if not s and self.whole[n] and (not e or len(self.whole[n]) >= self.min_fuzzy))
            halts = sorted((e, self.stem[n]) for n, e, s in key if not s and not e and self.stem[n])
            self.ends.append((ends[0][1], ends[0][0]) if ends else None)
            self.halts.append((halts[0][1], halts[0][0]) if halts else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, skipped in self.sets[state]:
            kids = self.children[node]
            if skipped:  # the word had the entry's next but one letter; now the one before it
                if c in kids and skipped in self.children[kids[c]]:
                    out.add((self.children[kids[c]][skipped], 1, ""))
                continue
            if c in kids:
                out.add((kids[c], edits, ""))
            if not edits and self.fuzzy[node]:
                out.add((node, 1, ""))  # a letter too many
                out |= {(k, 1, "") for k in kids.values() if self.fuzzy[k]}  # another letter
                if any(c in self.children[k] for k in kids.values()):
                    out.add((node, 1, c))
        to = self._state(out) if out else -1
        self.moves[state][c] = to
        return to

    def __missing__(self, word: str):
        if len(self.sets) > self.most_states:
            self._restart()
        state, moves, found = self.start, self.moves, None
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
            if nxt < 0:
                break
            state = nxt
            if self.halts[state]:
                found = self.halts[state]
                break
        else:
            found = self.ends[state]
        if len(word) <= 40:
            if len(self) >= self.keep:
                self.clear()
            self[word] = found
        return found


def hits(text: str, trie: FuzzyTrie, weights: dict[str, float]) -> list[float]:
    """Counts of one text: plain, misspelled, quoted and addressed hits, weight, density."""
    low = text.lower()
    words = WORDS.findall(low)
    found = [(i, m) for i, m in enumerate(map(trie.__getitem__, words)) if m]
    if not found:
        return [0.0] * FEATURES
    at = {i for i, _ in found}
    quoted_words: set[int] = set()
    if QUOTES.search(low):
        open_, count, last = False, 0, 0
        for q in QUOTES.finditer(low):
            n = len(WORDS.findall(low, last, q.start()))
            if open_ and n <= 60:
                quoted_words |= at & set(range(count, count + n))
            open_, count, last = not open_, count + n, q.end()
    plain = fuzzy = quoted = addressed = weight = 0.0
    for i, (entry, edits) in found:
        around = words[max(0, i - WINDOW) : i + WINDOW + 1]
        if i in quoted_words or not REPORTING.isdisjoint(around):
            quoted += 1
            weight += 0.3 * weights.get(entry, 1.0)
            continue
        addressed += not ADDRESS.isdisjoint(around)
        plain += not edits
        fuzzy += bool(edits)
        weight += weights.get(entry, 1.0) / (1 + edits)
    return [math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), math.log1p(max(weight, 0.0)), 100 * len(found) / (len(words) + 20)]


def crc32_text(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary"))


def held_out(col: str = "doc_id"):
    return F.coalesce(crc32_text(col) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """``text, toxic`` of about ``max_rows`` labelled documents at most, spread by a hash of the id.

    The ids are few by that bound and are broadcast; the held-out fifth is never among them.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    n = known.count()
    share = min(1.0, max_rows / n) if n else 1.0
    cut = int(share * 1_000_003)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < cut).limit(2 * max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", F.col("__toxic").alias("toxic"))


def _marks(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(4, min(len(word), 9)))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clean, bad = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {w for w in WORDS.findall((text or "").lower()) if 4 <= len(w) <= 24}
            (bad if toxic else clean).update({m for w in words for m in _marks(w)})
    keys = list(bad.keys() | clean.keys())
    yield pa.RecordBatch.from_pydict({"mark": pa.array(keys, pa.string()), "bad": pa.array([bad[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, seed: tuple[str, ...] = (), least: int = 6, max_marks: int = 20_000, max_entries: int = 2_000) -> dict:
    """Entries with weights and a logistic model, from a bounded sample of labelled rows.

    Bounds of the fit, and of nothing else: ``max_rows`` labelled rows, the ``max_marks`` marks
    that most toxic rows of the sample hold, ``max_entries`` entries. A mark is a word of 4 to 24
    letters or its first 4 to 8 letters; scoring takes words of any length.

    Word and stem counts over the sample run in Spark; only marks that are clearly toxic come
    to the driver, with the toxic sample documents that hold them. Words that only toxic rows
    hold, and more often than chance gives any word of a large vocabulary, are entries. Further
    words and stems are chosen greedily by the toxic documents that nothing chosen so far
    explains, so that words which merely occur in the same documents stay out.
    """
    rows = training_rows(docs, labels, max_rows).cache()
    n_bad, n_clean = (rows.where(f"toxic = {t}").count() for t in (1, 0))
    weights = {w: 3.0 for w in seed}
    if n_bad < 10 or n_clean < 10:
        rows.unpersist()
        return {"entries": weights, "model": [-4.0, 3.0, 1.5, 0.5, 0.5, 1.0, 0.2]}
    counts = rows.mapInArrow(_count, "mark string, bad long, clean long").groupBy("mark").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    strong = counts.where((F.col("bad") >= least) & (F.col("bad") / n_bad > 30 * (F.col("clean") + 0.3) / n_clean)).orderBy(F.desc("bad"), "mark").limit(max_marks)
    strong = strong.collect()
    scores = {r.mark: math.log((r.bad + 0.5) / n_bad) - math.log((r.clean + 0.5) / n_clean) for r in strong}
    chance = math.log((n_bad + n_clean) / n_bad)  # of a row to be toxic, as bits of evidence
    sure = [r.mark for r in strong if not r.clean and not r.mark.endswith("*") and r.bad * chance > VOCABULARY][:max_entries]
    support: dict[str, set[int]] = {}
    if scores:
        chosen_marks = set(scores)

        def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, marks = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    mine = {m for w in set(WORDS.findall((text or "").lower())) if 4 <= len(w) <= 24 for m in _marks(w)} & chosen_marks
                    ids.append(doc_id)
                    marks.append(sorted(mine))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "marks": pa.array(marks, pa.list_(pa.string()))})

        for r in rows.where("toxic = 1").select(F.col("doc_id").cast("long"), "text").mapInArrow(holders, "doc_id long, marks array<string>").collect():
            for m in r.marks:
                support.setdefault(m, set()).add(r.doc_id)
    entries: dict[str, float] = {w: max(scores.get(w, 3.0), 1.0) for w in (*seed, *sure)}
    explained: set[int] = set().union(*(support.get(w, set()) for w in entries)) if support else set()
    while len(entries) < max_entries and support:
        best = max(support, key=lambda m: (len(support[m] - explained), not m.endswith("*"), -len(m), m))
        gain = support.pop(best) - explained
        if len(gain) < least:
            break
        entries[best] = scores[best]
        explained |= gain
    trie = FuzzyTrie(entries)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hits(t or "", trie, entries))

    sample = rows.select("toxic", features("text").alias("x")).toPandas()
    rows.unpersist()
    x = np.column_stack([np.ones(len(sample)), np.array(sample["x"].tolist(), dtype=float)])
    y = sample["toxic"].to_numpy(dtype=float)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[0.05] * (x.shape[1] - 1)])
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return {"entries": entries, "model": [float(v) for v in w]}


def score(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 of each whole text."""
    entries, weights = model["entries"], model["model"]

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        trie = _trie(tuple(sorted(entries)))
        x = np.array([hits(t or "", trie, entries) for t in texts]).reshape(len(texts), FEATURES)
        z = weights[0] + x @ np.array(weights[1:])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, toxic("text"))


_TRIES: dict[tuple, FuzzyTrie] = {}


def _trie(entries: tuple) -> FuzzyTrie:
    """One trie per worker process, so that what it has learned of words outlives a batch."""
    holds("toxicity", _TRIES.clear)
    if entries not in _TRIES:
        _TRIES.clear()
        _TRIES[entries] = FuzzyTrie(entries)
    return _TRIES[entries]
