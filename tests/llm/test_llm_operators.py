"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import ann, bpe, graph, lines, maxscore, minhash, packing, secrets, substrings, toxicity, vectors, warc
from lodestone.llm.queries import BYTE_VOCAB, WORD_VOCAB

WS = b" \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, n_lines string, spans string"  # extra columns with clashing names


def documents(seed=1, n=60):
    rng = random.Random(seed)
    words = ["ore", "vein", "Drill", "core", "assay", "gold", "ünter", "x1", "the", "of"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(8) for _ in range(5)]
    passage = line(60)
    texts = []
    for i in range(n):
        parts = [line(rng.randint(1, 12)) for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            parts.insert(0, "  " + rng.choice(shared).upper() + "\t")
        if i % 7 == 0:
            parts.append(passage)
        texts.append("\n".join(parts))
    base = line(90)
    texts += [base, base, base + " more", base.replace("gold", "lead", 1), line(30) + " " + base]
    texts += [None, "", " ", "\n\n", "one", "one two three", "one two three", "a" * 5000, "w " * 3000, "日本語 テキスト　x", "tab\x1fsep nbsp"]
    rows = [(i * 3 - 20, t, "z", "q") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "lonely text without id", "z", "q"), (rows[5][0], "another text of the same id", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# lines


def brute_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").encode().split(b"\n"):
            k = x.strip(WS).lower()
            if len(k.decode()) >= min_chars:
                holders[k].add(-(2**63) if d is None else d)
    bad = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t, *_ in rows:
        parts = (t or "").encode().split(b"\n")
        me = -(2**63) if d is None else d
        kept = [x for x in parts if bad.get(x.strip(WS).lower(), me) == me]
        out.append((d, len(parts), len(parts) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_lines(spark, docs, partitions):
    done = lines.drop_lines(docs, lines.keep_bitmaps(docs, partitions=partitions))
    got = sorted(((r.doc_id, r["__lines"].n_lines, r["__lines"].n_dropped, r.text) for r in done.collect()), key=repr)
    assert got == brute_lines(documents())
    assert set(docs.columns) <= set(done.columns)


def test_lines_of_one_hot_key(spark):
    rows = [(i, "the same line in every document\nown line number %d of many" % i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    done = lines.drop_lines(df, lines.keep_bitmaps(df, partitions=9))
    assert done.where("__lines.n_dropped = 0").select("doc_id").collect() == [(399,)]


def test_bitmap_round_trip():
    for dropped in ([0], [7], [8], [3, 900], list(range(17))):
        keep = lines.unpack_keep(lines.pack_keep(dropped))
        assert np.flatnonzero(~keep).tolist() == dropped and len(keep) == max(dropped) + 1


# near-duplicates


def shingle_set(t, k):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def brute_components(rows, k, percent=80):
    sets = [(d, shingle_set(t, k)) for d, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), 2**63), -(2**63) if d is None else d)
    return sorted((-(2**63) if d is None else d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, k):
    got = sorted((r["__did"], r.n_shingles, r.component) for r in minhash.near_duplicates(docs, k).collect())
    assert got == brute_components(documents(), k)


def test_chains_of_copies(spark):
    """Copies that drift: neighbours are linked, ends aren't; all are one component."""
    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(60):
        words[rng.randrange(200)] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["__did"], r.n_shingles, r.component) for r in minhash.near_duplicates(df, 4).collect())
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize("edits", [4, 14, 24])
def test_group_of_near_copies_around_an_absent_text(spark, edits, monkeypatch):
    """Copies of one text, each with its own edits: neighbours in a bucket, linked or not by chance."""
    monkeypatch.setattr(minhash, "BLOCK", 16)  # several blocks
    rng = random.Random(edits)
    base = [f"b{i}" for i in range(240)]
    rows = []
    for i in range(70):
        words = list(base)
        for p in rng.sample(range(240), rng.randint(0, edits) if i % 4 else edits // 2):
            words[p] = f"e{i}_{p}"
        rows.append((rng.randrange(10**6), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["__did"], r.n_shingles, r.component) for r in minhash.near_duplicates(df, 4).collect())
    assert got == brute_components(rows, 4)


def test_several_texts_of_one_id_are_linked_text_by_text(spark):
    """Each id holds a near copy of a group and a text of its own that has a copy elsewhere."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(240)]
    rows = []
    for i in range(70):
        words = list(base)
        for p in rng.sample(range(240), rng.randint(0, 14)):
            words[p] = f"e{i}_{p}"
        own = [f"o{i}_{j}" for j in range(20 + 3 * i)]
        rows += [(100 + i, " ".join(words)), (100 + i, " ".join(own)), (1000 + i, " ".join([*own, "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["__did"], r.n_shingles, r.component) for r in minhash.near_duplicates(df, 4).collect())
    assert got == brute_components(rows, 4)


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 5, 100, 5000):
        assert minhash.sketch(np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))).max() < 2**64 - 1
    rng = np.random.default_rng(0)
    for n in (30, 400):  # agreement estimates similarity
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 2).astype(np.uint64)])
        same = np.mean([(minhash.sketch(a + np.uint64(s)) == minhash.sketch(b + np.uint64(s))).mean() for s in range(0, 50_000, 1000)])
        assert abs(same - 1 / 3) < 0.04


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: c for x, c in parent.items() if x in linked}


# repeated passages


def brute_repeats(rows, window):
    where = defaultdict(int)
    parsed = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for _, w in parsed:
        for i in range(len(w) - window + 1):
            where[tuple(w[i : i + window])] += 1
    out = []
    for d, w in parsed:
        gone = set()
        for i in range(len(w) - window + 1):
            if where[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [12, 35])
def test_repeats(spark, docs, window):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, window).collect()), key=repr)
    assert got == brute_repeats(documents(), window)


def test_repeats_are_located_by_the_automata(spark, docs, monkeypatch):
    """Several shards give the same; automata that hold no phrase leave every word."""
    monkeypatch.setattr(substrings, "SHARD", 7)
    want = brute_repeats(documents(), 12)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, 12).collect()), key=repr)
    assert got == want and sum(r[2] for r in want) > 0
    monkeypatch.setattr(substrings, "compiled", lambda phrases: iter(()))
    assert substrings.remove_repeats(docs, 12).agg({"n_removed": "sum"}).first()[0] == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lodestone_texts")]


def test_phrases_are_spelled_as_texts_are():
    h = np.random.default_rng(3).integers(0, 2**63, 40).astype(np.uint64)
    codes, at = substrings.spelled(h), np.array([0, 7, 32])
    text = substrings.letters(codes)
    size = substrings.LETTERS
    assert substrings.phrases_of(*substrings.phrase_keys(codes, at)) == [text[size * i : size * (i + substrings.PHRASE)] for i in at]


def test_anchors_brute_force():
    rng = np.random.default_rng(4)
    for n, span in ((5, 5), (40, 7), (200, 28), (3, 9)):
        v = rng.integers(0, 12, n).astype(np.uint64) << np.uint64(40)
        want = [max(range(i, i + span), key=lambda p: (-int(v[p]), -p)) for i in range(n - span + 1)]
        assert substrings.anchors(v, span).tolist() == want


# archives


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, None), (1, "http://c/\r\nx", ""), (7, "u", "é" * 3000), (None, "n", "same"), (2, "http://b/", "same"), (8, "u", "WARC/1.1\r\n\r\nfake")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, offset string, length long")
    index = warc.write(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digests(warc.read(index)).collect()), key=repr)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        f = first[h or ""]
        revisit = p is not None and p > f
        want.append((p, len(raw), warc.digest32(raw), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=repr)
    some = warc.read(index.where("page_id in (7, 8)"), max_gap=10)
    assert {r.page_id: bytes(r.payload).decode() for r in some.collect()} == {7: "é" * 3000, 8: "WARC/1.1\r\n\r\nfake"}
    assert warc.digests(warc.read(warc.write(pages.limit(0)))).count() == 0


# vectors


def vector_rows(n=300, dims=16, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    x = centres[rng.integers(0, 5, n)] + 0.7 * rng.normal(size=(n, dims))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows[40] = (40, rows[41][1])  # a tie
    rows += [(1000, None), (1100, [0.0] * dims), (1200, [float("nan")] * dims), (1300, [None] * dims), (None, rows[0][1]), (1400, [float("inf")] + [1.0] * (dims - 1))]
    return rows


def exact_tops(rows, every, k, number):
    """Of each query row the ``k`` best (id, score) by brute force; rows with one id and vector ask once."""
    width = Counter(len(v) for _, v in rows if v).most_common(1)[0][0]
    good = [(i, [number(x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    asks = {(i, tuple(v)): v for i, v in good if i % every == 0}
    limit = lambda s: max(min(s, 2**63 - 1), -(2**63)) if isinstance(s, int) else s
    return sorted((q, sorted(((j, limit(sum_in_order(v, w))) for j, w in good if j != q), key=lambda t: (-t[1], t[0]))[:k]) for (q, _), v in asks.items())


def lists_of(rows):
    out, now = [], None
    for r in rows:
        if r["rank"] == 1:
            now = (r.query_id, [])
            out.append(now)
        assert now[0] == r.query_id and r["rank"] == len(now[1]) + 1
        now[1].append((r.vec_id, r.score))
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "ragged", "huge"])
def test_maxscore_exact(spark, kind):
    rows = vector_rows()
    rng = np.random.default_rng(2)
    if kind == "sparse":
        rows = [(i, [0.0 if rng.random() < 0.8 else x for x in v] if v and len(v) == 16 else v) for i, v in rows]
    if kind == "ragged":  # sizes that divide the usual one too
        rows += [(1500, [1.0] * 8), (1501, [1.0] * 32), (1502, []), (1550, [0.5] * 15)]
    if kind == "huge":
        rows = [(i, [x * 1e30 if i % 40 == 3 and c == 5 else x for c, x in enumerate(v)] if v and len(v) == 16 and i is not None else v) for i, v in rows]
        rows += [(1600, [1e300] + [1.0] * 15), (1601, [2.0**40] + [0.25] * 15)]
    rows += [rows[7], rows[7], rows[50], rows[50], (100, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = maxscore.top_k(df, df.where("vec_id % 50 = 0"), k=5, block=64, query_block=3).collect()
    assert lists_of(got) == exact_tops(rows, 50, 5, lambda x: int(maxscore.whole_numbers(np.array([x]))[0]))
    assert maxscore.top_k(df.limit(0), df.limit(0)).count() == 0
    assert maxscore.top_k(df, df.limit(0)).count() == 0


def test_maxscore_leaves_postings_out():
    """Once a threshold is known, rows are passed over, and the result stays."""
    rng = np.random.default_rng(3)
    x, w = rng.integers(0, 50, (500, 12)).astype(float) * (rng.random((500, 12)) < 0.2), rng.integers(1, 9, 12).astype(float)
    shard = maxscore.Postings(np.arange(500), x)
    rows, scores = shard.top(w, -1, 5, -np.inf)
    again, same = shard.top(w, -1, 5, scores[-1])
    assert rows.tolist() == again.tolist() and scores.tolist() == same.tolist() == sorted((x @ w), reverse=True)[:5]
    assert len(shard.top(w, -1, 5, scores[0] + 1)[0]) == 0


@pytest.mark.parametrize("ragged", [False, True])
def test_nearest(spark, ragged):
    rows = vector_rows()
    if ragged:
        rows += [(1500, [1.0] * 8), (1520, [1.0] * 32), (1502, []), (1540, [0.5] * 15)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    got = lists_of(ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, segment_rows=24).collect())
    want = exact_tops([r for r in rows if r[1] is None or any(r[1])], 20, 10, float)
    assert [q for q, _ in got] == [q for q, _ in want]
    assert all(mine == sorted(mine, key=lambda t: (-t[1], t[0])) and len(mine) == 10 for _, mine in got)
    assert np.mean([len(set(a) & set(b)) / 10 for (_, a), (_, b) in zip(got, want)]) >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df, F.lit(False)).count() == 0


def test_nearest_of_few_and_of_repeated_rows(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 3.0]), (1, [1.0, 3.0]), (2, [2.0, 1.0]), (40, [0.0, 1.0]), (40, [0.0, 1.0]), (40, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert lists_of(ann.nearest(df, F.col("vec_id") % 20 == 0).collect()) == exact_tops(rows, 20, 20, float)


def test_nearest_of_a_hot_vector(spark):
    """A vector of a third of all rows: its smallest ids are found, and the rows around them too."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1001 + 3 * i, x[7].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = dict(lists_of(ann.nearest(df, F.col("vec_id") % 20 == 0, segment_rows=16).collect()))
    want = dict(exact_tops(rows, 20, 20, float))
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_top_pairs_do_not_depend_on_the_block():
    """Scores bit-equal whatever the block's shape, ties by id."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64))
    x[300:340] = x[7]
    ids = rng.permutation(600).astype(np.int64)
    q, own = np.concatenate([x[7:8], rng.normal(size=(36, 64))]), np.full(37, -1, dtype=np.int64)
    exact = [[(-sum_in_order(q[r], x[j]), int(ids[j])) for j in range(600)] for r in range(len(q))]
    for size, queries in ((600, 37), (97, 37), (13, 5), (1, 1)):
        met = defaultdict(list)
        for a in range(0, len(q), queries):
            for b in range(0, len(x), size):
                at, j, scores = ann.top_pairs(q[a : a + queries], own[a : a + queries], x[b : b + size], ids[b : b + size], 20)
                for r, i, s in zip(at.tolist(), ids[b : b + size][j].tolist(), scores.tolist()):
                    met[a + r].append((-s, i))
        for r in range(len(q)):
            assert sorted(met[r])[:20] == sorted(exact[r])[:20]


def sum_in_order(a, b):
    total = 0
    for x, y in zip(np.asarray(a, dtype=object).tolist(), np.asarray(b, dtype=object).tolist()):
        total += x * y
    return total


def test_nearest_with_a_short_reach(spark, monkeypatch):
    """Clustered rows need few segments; rows met on several curves stand once in a list."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 64)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 64)) * 0.1 for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[i * 7].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    reaches = []
    measured = ann.measured_reach
    monkeypatch.setattr(ann, "measured_reach", lambda *a: reaches.append(measured(*a)) or reaches[-1])
    got = dict(lists_of(ann.nearest(df, F.col("vec_id") % 20 == 0, segment_rows=64, sample=30).collect()))
    assert reaches[0] <= 4  # of some 40 segments
    want = dict(exact_tops(rows, 20, 20, float))
    others = sorted(got)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in others]) >= 0.9
    for q, mine in got.items():
        assert len(mine) == 20 and len({j for j, _ in mine}) == 20
        assert mine == sorted(mine, key=lambda t: (-t[1], t[0]))
    assert all(s in {t for _, t in want[q]} for q in others for j, s in got[q] if j in {j for j, _ in want[q]})


def test_hilbert_is_a_path():
    """All cells once, each a neighbour of the one before."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = ann.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_best_breaks_ties_by_id():
    assert vectors.best(np.array([1.0, 3.0, 3.0, 3.0]), np.array([9, 8, 2, 5]), 2).tolist() == [2, 3]


# toxicity


def test_fuzzy_trie_brute_force():
    def distance1(a, b):
        if a == b:
            return 0
        if len(a) == len(b):
            bad = [i for i in range(len(a)) if a[i] != b[i]]
            if len(bad) == 1 or (len(bad) == 2 and bad[1] == bad[0] + 1 and a[bad[0]] == b[bad[1]] and a[bad[1]] == b[bad[0]]):
                return 1
        if abs(len(a) - len(b)) == 1:
            s, t = sorted((a, b), key=len)
            if any(t[:i] + t[i + 1 :] == s for i in range(len(t))):
                return 1
        return 9

    entries = ["moron", "idiot", "scum", "stupid", "trash", "vequ*"]
    trie = toxicity.FuzzyTrie(entries)
    rng = random.Random(8)
    words = ["vequement", "vequ", "veq", "scum", "scumm", "idoit", "idiots", "iidiot", "tupid", "stpuid", "", "t", "trasht", "xtrash", "mron"]
    for _ in range(3000):
        w = list(rng.choice(entries[:5]))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "s", "o", "m"])
        words.append("".join(w))
    for w in words:
        near = [(d, e) for e in entries[:5] if (d := distance1(w, e)) == 0 or (d == 1 and len(e) >= 5)]
        want = (min(near)[1], min(near)[0]) if near else None
        if w.startswith("vequ"):
            want = ("vequ*", 0)
        assert trie[w] == want, w


def test_quotation_counts_apart():
    listed = ("idiot", "moron")
    trie = toxicity.FuzzyTrie(listed)
    w = dict.fromkeys(listed, 3.0)
    abuse, quote = toxicity.hits("you are an idiot and a moron", trie, w), toxicity.hits('the report said "idiot" here', trie, w)
    assert abuse[0] > 0 and abuse[2] == 0 and abuse[3] > 0 and quote[0] == 0 and quote[2] > 0
    assert toxicity.hits("", trie, w) == [0.0] * toxicity.FEATURES


def test_toxicity_learns_and_leaves_held_out_rows_alone(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = ["w%d" % rng.randrange(300) for _ in range(60)]
        words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["stupid", "moron"]) if i % 2 else "zorgue" + rng.choice("abcdef")
        rows.append((i, " ".join(words)))
        labels.append((i, None, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "you stupid moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels += [(None, 1, 1), (77777, 1, 1), (3, 1, None), (4, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, lab)
    assert any(e.startswith("zorg") for e in model["entries"])
    got = {r.doc_id: (r.s, r.h) for r in toxicity.score(docs, model, out="s").select("doc_id", "s", toxicity.held_out().alias("h")).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i][1] == (i in set(held)) for i in range(900))
    assert np.mean([(got[i][0] >= 0.5) == (i % 5 == 1) for i in held]) > 0.95
    assert got[5000][0] == got[5001][0] < 0.5 and got[None][0] > 0.5 and not got[None][1]
    train = toxicity.training_rows(docs, lab, 100_000).join(docs.select("doc_id"), "doc_id").select("doc_id").collect()
    assert not {r.doc_id for r in train} & set(held)
    flat = toxicity.learn(docs, lab.limit(0))
    assert toxicity.score(docs.limit(0), flat, out="s").count() == 0


# secrets

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute_secrets(text):
    out = []
    for rank, (kind, (p, g, least)) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), kind) for m in p.finditer(text or "") if len(m[g]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


SECRETS = ["token = \"abc123def\" é token: x1 passWORD='longer-one'", "ééé AKIA" + "A1" * 9 + " AKIA12", "f" * 24 + "g" + "0" * 23 + " " + "a" * 60, "secret:  token = abcdef", "api_key==xxxxxxx apikey : yyyyyy", None, "", "😀 token=😀abcdefg token=abcdefg", "password=\n abcdef", "token=" + "a" * 30]


def test_secrets(spark):
    rows = [(i, t, "s", "b") for i, t in enumerate(SECRETS * 2)] + [(None, "token=abcdefg", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string, kind string")
    done = secrets.scan(df)
    got = sorted(((r.doc_id, r.s) for r in done.select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()), key=repr)
    assert got == sorted(((i, brute_secrets(t)) for i, t, *_ in rows), key=repr)
    assert set(df.columns) <= set(done.columns)
    assert secrets.scan(df.limit(0)).count() == 0


def test_secrets_of_a_text_with_very_many_matches(spark):
    """The work follows the matches: 60,000 of them in one text, and one of five rows is short."""
    text = " ".join("é" + "0123456789abcdef" * 2 + (" token=ab" if i % 5 else " token=abcdefg") for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    done = {r.doc_id: r for r in secrets.scan(df).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert done[1].s == brute_secrets(text) and done[2].s == ""
    back = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert back[1] == " ".join("é[hex]" + (" token=ab" if i % 5 else " [assign]") for i in range(60_000))


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, "token=abcdefg"), (2, "nothing")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "nothing"), (4, "token=hijklmn"), (5, "token=abcdefg")], "doc_id long, text string")
    secrets.scan(one, ledger=ledger).collect()
    assert spark.read.parquet(ledger).count() == 2
    got = {r.doc_id: len(r.spans) for r in secrets.scan(two, ledger=ledger).collect()}
    assert got == {3: 0, 4: 1, 5: 1} and spark.read.parquet(ledger).count() == 3
    secrets.scan(two, ledger=ledger, version="2").collect()
    assert spark.read.parquet(ledger).count() == 6


def test_ledger_tells_rules_apart(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1, "token=abcdefg " + "AKIA" + "A1" * 9)], "doc_id long, text string")
    few = secrets.RULES[:1]
    assert [len(r.spans) for r in secrets.scan(df, ledger=ledger, rules=few).collect()] == [1]
    assert [len(r.spans) for r in secrets.scan(df, ledger=ledger).collect()] == [2]
    assert [len(r.spans) for r in secrets.scan(df, ledger=ledger, rules=few).collect()] == [1]
    assert spark.read.parquet(ledger).count() == 2


def test_redact(spark):
    df = spark.createDataFrame([(1, "a token=abcdefg b " + "0" * 24), (2, None), (3, "plain"), (4, "token=" + "a" * 30)], "doc_id long, text string")
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["a [assign] b [hex]", None, "plain", "[assign]"]


# tokens

ODD = ["", " ", "  x  y\n\n z", "It's I'LL 'lo the'd're", "naïve Ünïcode ΣΑΣ İstanbul ǅ", "tab\tsep\r\n\x1cx\x85y\xa0z　w", "a<|endoftext|>b <|endoftext|> <|startoftext|>", "x" * 3000, "日本語テキスト", "é café Å", "😀👍🏽", "\x00nul", "½ ² 1234", "!" * 90, None]


@pytest.mark.parametrize("vocab", [BYTE_VOCAB, WORD_VOCAB])
def test_encoding_is_the_librarys(spark, vocab):
    library = Tokenizer.from_file(vocab)
    library.no_truncation()
    library.no_padding()
    rows = [(i, t) for i, t in enumerate(ODD + [t for _, t, *_ in documents()[:70]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    lexicon = bpe.build_lexicon(df, vocab, size=60) if vocab == BYTE_VOCAB else None
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(df, vocab, lexicon).collect()}
    for i, t in rows:
        assert list(memoryview(got[i]).cast("I")) == library.encode(t or "", add_special_tokens=False).ids, t
    slow = bpe.Encoder(bpe.vocabulary(vocab), keep=20, fast=False)
    assert all(slow.encode(t or "") == got[i] for i, t in rows)
    if vocab == BYTE_VOCAB:
        back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df, vocab), vocab).collect()}
        assert all(back[i] == library.decode(list(memoryview(got[i]).cast("I")), skip_special_tokens=False) for i, t in rows)
        for r in bpe.round_trip(df, vocab, lexicon).collect():
            assert r.n_tokens == len(got[r.doc_id]) // 4 and r.ids_sha256 == hashlib.sha256(got[r.doc_id]).hexdigest()
        assert bpe.round_trip(df.limit(0), vocab, bpe.build_lexicon(df.limit(0), vocab)).count() == 0


@pytest.mark.parametrize("path", [BYTE_VOCAB, WORD_VOCAB])
def test_both_merges_are_the_same(path):
    """On every token's own bytes, and on random joins of tokens."""
    vocab, rng = bpe.vocabulary(path), random.Random(3)
    tokens = [t for i, t in enumerate(vocab.bytes_of) if t.strip(b" ") and i not in vocab.special.values()]
    tokens = [t.strip(b" ") if vocab.lower else t for t in tokens]
    words = tokens + ["".join(rng.choice("aeinrstlo' ") for _ in range(rng.randint(1, 450))).encode() for _ in range(300)] + [b"".join(rng.choice(tokens) for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    assert all(vocab.quick(w) == vocab.merge(w) for w in words)


def test_lexicon_finds_what_it_holds():
    vocab = bpe.vocabulary(BYTE_VOCAB)
    words = {w.encode(): vocab.merge(w.encode()) for w in ("a", "ab", " ab", "xab", "zab", "éa", "drilling", "filling", "killing")}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words))
    assert all(list(memoryview(lexicon.find(w)).cast("I")) == ids for w, ids in words.items())
    assert lexicon.find(b"") is None and lexicon.find(b"drill") is None and lexicon.find(b"abc") is None
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find(b"a") is None
    rng = random.Random(1)
    for _ in range(300):  # long words take the heap
        w = bytes(rng.choice(b"abehint ") for _ in range(rng.randint(1, 60)))
        ids = [vocab.inner[b] for b in w]
        assert vocab._merge_long(ids) == vocab.merge(w)


def test_a_lower_case_word_is_merged_once_whatever_stands_around_it():
    coder, merged = bpe.Encoder(bpe.vocabulary(WORD_VOCAB)), Counter()
    join = coder.merge
    coder.merge = lambda word: merged.update([word]) or join(word)
    text = "Vein vein, VEIN. (vein) vein's ÉTÉ été! étÉ ΣΑΣ, σας ΣΑσ \x1cx\x1dvein\x1e \x1f Vein9vein"
    library = Tokenizer.from_file(WORD_VOCAB)
    library.no_truncation()
    assert list(memoryview(coder.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids
    assert merged[b"vein"] == merged["été".encode()] == merged["σας".encode()] == 1


def test_white_space_of_runs_is_that_of_the_pattern():
    coder = bpe.Encoder(bpe.vocabulary(WORD_VOCAB))
    for i in (i for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        text = f"a{chr(i)}b {chr(i)}"
        assert coder.split(text) == coder.lower_runs(text)


@pytest.mark.parametrize("how", [{}, {"open_windows": 2, "min_gap": 2}, {"open_windows": 1, "min_gap": 10_000}])
def test_packing(spark, how):
    rng = random.Random(7)
    rows = [(i, " ".join("word%d" % rng.randrange(50) for _ in range(rng.randint(0, 900)))) for i in range(120)] + [(500, None), (501, ""), (502, "x y " * 4000), (7, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(6)
    got = packing.pack(df, WORD_VOCAB, **how).collect()
    library = Tokenizer.from_file(WORD_VOCAB)
    library.no_truncation()
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = Counter((d, len(x)) for d, xs in ids.items() for x in xs)
    assert sum(len(x) for xs in ids.values() for x in xs) == sum(r.length for r in got)
    for (d, n), parts in pieces.items():
        if want[(d, n)] != 1:
            continue
        x, at = next(x for x in ids[d] if len(x) == n), 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(struct.pack(f"<{length}I", *x[start : start + length]))
            at += length
        assert at == n
    assert packing.pack(df.limit(0), WORD_VOCAB).count() == 0


CLASHES = ["spans", "blob", "version", "keep_bitmap", "n_lines", "n_dropped", "kept", "n_words", "n_removed", "kept_sha256", "component", "component_id", "n_shingles", "score", "toxic", "held_out", "predicted", "ids", "n_tokens", "decoded", "start", "length", "window", "offset", "sequence_id", "doc_tokens", "h", "part", "copies", "m", "pos", "rank"]


def test_columns_with_the_operators_own_names(spark):
    """Every name that some operator uses, on one table: nothing fails, the documented ones give way."""
    rows = [(i, t, *(f"own {c}" for c in CLASHES)) for i, t in enumerate(SECRETS + ["a b c d e f g " * 9, "a b c d e f g " * 9])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    n = len(rows)
    own = lambda done, *but: all(done.where(F.col(c) == f"own {c}").count() == n for c in ("kept", "spans", "blob") if c not in but)
    scanned = secrets.scan(df)
    assert scanned.count() == n and own(scanned, "spans", "blob") and len(set(scanned.columns)) == len(scanned.columns)
    redacted = secrets.redact(df)
    assert redacted.columns == df.columns and own(redacted)
    dropped = lines.drop_lines(df, lines.keep_bitmaps(df))
    assert dropped.count() == n and own(dropped)
    cut = substrings.remove_repeats(df, 12)
    assert cut.count() == n and own(cut, "kept") and len(set(cut.columns)) == len(cut.columns)
    assert minhash.near_duplicates(df).count() == n and minhash.keep_one(df).columns == df.columns
    model = toxicity.learn(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    scored = toxicity.score(df, model)
    assert scored.columns == df.columns and own(scored)
    assert packing.pack(df, WORD_VOCAB).agg(F.countDistinct("doc_id")).first()[0] == n
    coded = bpe.encode(df, BYTE_VOCAB)
    assert bpe.decode(coded, BYTE_VOCAB).count() == n and own(coded) and bpe.round_trip(df, BYTE_VOCAB).count() == n
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *CLASHES, F.lit(1).alias("payload"), F.lit(2).alias("file"), F.lit(3).alias("refers_to"), F.lit(4).alias("__first"))
    assert warc.digests(warc.read(warc.write(pages))).count() == n
    few = df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id") % 3).cast("array<float>").alias("embedding"), "rank", "part", F.lit(1).alias("row"), F.lit(1).alias("query_id"), F.lit(1).alias("asks"))
    assert ann.nearest(few, F.col("vec_id") == 0).count() == min(20, n - 1) and maxscore.top_k(few, few.where("vec_id = 0")).count() == 5


def test_no_operator_fails_on_an_empty_table(spark, empty):
    assert lines.drop_lines(empty, lines.keep_bitmaps(empty)).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0 and minhash.keep_one(empty).count() == 0
    assert bpe.encode(empty, BYTE_VOCAB).count() == 0 and bpe.decode(bpe.encode(empty, BYTE_VOCAB), BYTE_VOCAB).count() == 0
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_VOCAB
