"""Operators 11 to 13 against brute force: null, empty and long texts, ties, repeats, clashing columns."""

import bisect
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import align, bpe, hmm, turns
from lodestone.llm.queries import BYTE_VOCAB, PIECE_MODEL

DOCS = "doc_id long, text string, uid string, pairs string, share string, n string"  # clashing extra columns


def documents():
    rng = random.Random(4)
    words = ["ore", "Vein", "core.", "über", "x1", "the", "of", "drill,", "zz", "日本"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += [None, "", " ", "\n\n", "one", "one", "a" * 3000, "w " * 4000, "a\u2581b", "<|endoftext|> <s> </s> <0x0A>", "  two  spaces  ", "tab\tline\r\n", "é" * 50, "\u3000x\x00y", "!?" * 600]
    rows = [(i * 7 - 5, t, "u", "p", "s", "n") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "no id at all", None, None, None, None), (rows[5][0], "the same id", "", "", "", "")]


# alignment


def brute_alignment(rows):
    a_side, b_side = Tokenizer.from_file(BYTE_VOCAB), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_side.encode_special_tokens = True
    a_bytes = bpe.vocabulary(BYTE_VOCAB).bytes_of
    b_bytes = [bytes([int(x[3:5], 16)]) if b_side.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in ((i, b_side.id_to_piece(i)) for i in range(32000))]
    held, out = Counter(), []
    for d, x in rows:
        a, b = (a_side.encode(" " + x, add_special_tokens=False).ids, b_side.encode(x)) if x else ([], [])
        raw = (" " + (x or "")).encode()
        if not x or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            out.append((d, 0, 0, 0, Counter(), "", []))
            continue
        ends = [list(itertools.accumulate(len(of[i]) for i in ids)) for ids, of in ((a, a_bytes), (b, b_bytes))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side]):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = Counter(p for x_, y_ in groups for p in itertools.product(x_, y_))
        held.update(links.keys())
        name = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((d, len(a), len(b), len(groups), links, hashlib.sha256(name.encode()).hexdigest(), groups))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    return [(d, na, nb, g, sum(k.values()), sum(m for p, m in k.items() if held[p] == top[p[0]]), sum(m * held[p] for p, m in k.items()), h) for d, na, nb, g, k, h, _ in out], out


@pytest.mark.parametrize(("known", "stretch", "wide"), [(1 << 17, 1 << 20, 1 << 12), (40, 50, 1), (0, 7, 4)])
def test_alignment(spark, monkeypatch, known, stretch, wide):
    """All links whatever is known beforehand, wherever long texts are cut and however large groups are spread."""
    monkeypatch.setattr(align, "STRETCH", stretch)
    monkeypatch.setattr(align, "WIDE", wide)
    rows = documents()
    both = align.Sides(BYTE_VOCAB, PIECE_MODEL)
    for _, text, *_ in rows:  # the settings above don't reach the workers, so this runs here
        parts = list(align.stretches(text)) if text else []
        assert "".join(parts) == (" " + text if text else "")
    want, _ = brute_alignment([r[:2] for r in rows])
    sums, links = [], []
    texts = [r[1] for r in rows]
    total = np.zeros((len(rows), 4), dtype=int)
    gone = set()
    pairs = [Counter() for _ in rows]
    for of, part, fail in align._batched(both, texts):
        gone |= fail
        np.add.at(total, of, np.column_stack([part.count, part.groups, part.links]))
        for p, key, n in zip(*part.pairs()):
            pairs[of[p]][divmod(int(key), both.base)] += int(n)
    for row in gone:
        total[row], pairs[row] = 0, Counter()
    assert [tuple(x) for x in total.tolist()] == [w[1:5] for w in want]
    assert [sum(p.values()) for p in pairs] == [w[4] for w in want] and not sums and not links
    got = align.summarize(spark.createDataFrame(rows, DOCS).repartition(3), BYTE_VOCAB, PIECE_MODEL, known=known)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_groups_of_tokens(spark):
    rows = documents()
    _, out = brute_alignment([r[:2] for r in rows])
    want = sorted(((d, i, *g) for d, *_, groups in out for i, g in enumerate(groups)), key=repr)
    got = align.groups(spark.createDataFrame(rows, DOCS), BYTE_VOCAB, PIECE_MODEL).collect()
    assert sorted(((r.doc_id, r.group, list(r.a_ids), list(r.b_ids)) for r in got), key=repr) == want
    assert all(r.start < r.end for r in got)


def test_encoders_of_alignment_equal_the_libraries():
    rng = random.Random(9)
    letters = ["a", " ", "  ", "\n", "\t", "é", "日本", "<|endoftext|>", "<unk>", "<s>", "'s", "12", "!?", "\u3000", "the", " the", "\u2581", "🙂", "\x00", "\u200b"]
    a_side, b_side = Tokenizer.from_file(BYTE_VOCAB), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_side.encode_special_tokens = True
    both = align.Sides(BYTE_VOCAB, PIECE_MODEL)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    for text, found in zip(texts, both.tokens([" " + t for t in texts])):
        assert (found is None) == ("\u2581" in text)
        if found:
            assert found[0].tolist() == a_side.encode(" " + text, add_special_tokens=False).ids and found[1].tolist() == b_side.encode(text)


def test_alignment_of_an_empty_table(spark):
    assert align.summarize(spark.createDataFrame([], DOCS), BYTE_VOCAB, PIECE_MODEL).count() == 0


# language model


def chain(states=3, symbols=5, seed=2):
    rng = np.random.default_rng(seed)
    one = lambda *shape: (x := rng.random(shape)) / x.sum(axis=-1, keepdims=True)
    return hmm.Chain(one(2, states), one(states, states), one(states, symbols).T.copy())


def test_likelihood_and_expected_counts_by_all_paths(monkeypatch):
    model, sequences = chain(), [np.array(s) for s in ([0, 1, 4], [4], [2, 2, 3, 1, 4], [3, 4])]
    want, total = [], np.zeros((5 + 2 + 3, 3))
    for s in sequences:
        whole, counts = 0.0, np.zeros_like(total)
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[0][path[0]] * np.prod([model.move[x, y] for x, y in itertools.pairwise(path)]) * np.prod([model.emit[o, x] for o, x in zip(s, path)])
            whole += p
            for o, x in zip(s, path):
                counts[o, x] += p
            counts[5, path[0]] += p
            for x, y in itertools.pairwise(path):
                counts[7 + x, y] += p
        want.append(np.log10(whole))
        total += counts / whole
    assert np.allclose(model.log10(sequences), want, atol=1e-12)
    assert np.allclose(model.expected(sequences), total, atol=1e-9)
    monkeypatch.setattr(hmm, "STRETCH", 2)  # stretches start anew, from their own distribution
    cut = model.expected(sequences)
    assert np.isclose(cut[:5].sum(), sum(map(len, sequences))) and np.isclose(cut[6].sum(), 1 + 2)


def test_training_never_lowers_the_likelihood():
    rng = np.random.default_rng(5)
    sequences = [np.append(rng.integers(0, 10, rng.integers(1, 60)) + 10 * (i % 2), 20) for i in range(200)]
    weights = np.bincount(np.concatenate(sequences), minlength=21) + 0.5
    model, before = hmm.Chain.initial(weights / weights.sum(), 4), -np.inf
    for _ in range(15):
        now = model.log10(sequences).sum()
        assert now >= before - 1e-6
        before, model = now, hmm.Chain.of(model.expected(sequences), weights / weights.sum(), prior=1e-9)
    assert before > -1.2 * sum(map(len, sequences))  # two halves of ten symbols each are told apart


def brute_base(rows):
    words = lambda t: (t or "").encode().lower().split()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t in rows if not held(d) for w in [*words(t), b" end"])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*words(t), b" end"]
        out.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)))
    return out


@pytest.mark.parametrize("size", [1 << 15, 6, 0])
def test_base_scores(spark, size):
    """The same counts whether words are symbols of their own or meet their counts in the join."""
    rows = documents()
    got = hmm.score(spark.createDataFrame(rows, DOCS).repartition(3), states=2, rounds=(16,), size=size).collect()
    key = lambda r: repr(tuple(r)[:4])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(brute_base([r[:2] for r in rows]), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], atol=1e-9)


def test_scores_are_those_of_the_chain_and_the_counts(spark):
    """One round by hand, in one process: initial chain, expected counts, scores with the classes' shares."""
    rows = documents()
    words = lambda t: (t or "").encode().lower().split()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t, *_ in rows if not held(d) for w in words(t))
    texts = sum(not held(r[0]) for r in rows)
    by_level = defaultdict(list)
    for w, n in counts.items():
        by_level[int(np.floor(np.log2(n) * 8))].append(w)
    own = []
    for level in sorted(by_level, reverse=True):
        if len(own) + len(by_level[level]) > 6:
            break
        own += by_level[level]
    own.sort(key=lambda w: (-counts[w], w))
    total, kinds = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w in set(counts) - set(own):
        total[hmm.word_class(w)] += counts[w]
        kinds[hmm.word_class(w)] += 1
    weights = np.concatenate([[counts[w] for w in own], total, [texts]]) + 0.5
    symbol = lambda w: own.index(w) if w in own else len(own) + hmm.word_class(w)
    sequence = lambda t: np.array([*map(symbol, words(t)), len(own) + hmm.CLASSES])
    model = hmm.Chain.initial(weights / weights.sum(), 3)
    model = hmm.Chain.of(model.expected([sequence(r[1]) for r in rows if not held(r[0])]), weights / weights.sum())
    rare = lambda w: np.log10((counts[w] + 0.5) / (total[hmm.word_class(w)] + 0.5 * (kinds[hmm.word_class(w)] + 1)))
    want = sorted((repr(r[0]), model.log10([sequence(r[1])])[0] + sum(rare(w) for w in words(r[1]) if w not in own)) for r in rows)
    got = hmm.score(spark.createDataFrame(rows, DOCS), states=3, rounds=(16,), size=6).collect()
    got = sorted((repr(r.doc_id), r.score) for r in got)
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-2)


def test_every_round_learns_from_all_training_texts(spark):
    """The chain that seven rounds give is that of seven rounds over every training sequence, in one process."""
    rng = np.random.default_rng(6)
    counts = np.array([9.0, 7, 5, 3])
    found = hmm.Lexicon([b"a", b"b", b"c", b"d"], counts, np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES), 1, 25, 5)
    sequences = [np.append(rng.integers(0, 4, rng.integers(0, 30)), 4 + hmm.CLASSES) for _ in range(96)]
    rows = [(i % 5 == 1, i % 16, bytearray(s.astype("<u2").tobytes())) for i, s in enumerate(sequences)]
    got = hmm.train(spark.createDataFrame(rows, "held_out boolean, share int, symbols binary").repartition(3), found, 3)
    want = hmm.Chain.initial(found.weights, 3)
    for _ in range(7):
        want = hmm.Chain.of(want.expected([s for s, (held, *_) in zip(sequences, rows) if not held]), found.weights)
    for ours, theirs in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)):
        assert np.allclose(ours, theirs, rtol=1e-3)


def test_held_out_texts_are_likelier_than_by_frequency(spark):
    sf = "/root/testdata/sf0.01"
    got = hmm.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.25


def test_language_model_of_an_empty_table(spark):
    assert hmm.score(spark.createDataFrame([], DOCS)).count() == 0
    alone = hmm.score(spark.createDataFrame([(7, "held out? or not", *"abcd")], DOCS)).first()
    assert alone.n_tokens == 5 and np.isfinite(alone.score)


# turns


def all_repairs(codes):
    """Least cost and audit over every string of edits that isn't dearer than deleting all."""
    found, stack = (4 * len(codes), "D" * len(codes)), [(0, "", 0, "0")]
    while stack:
        cost, edits, i, at = stack.pop()
        if cost > found[0]:
            continue
        if i == len(codes) and at in "0a":
            found = min(found, (cost, edits))
        want = {"0": "u", "s": "u", "u": "a", "a": "u"}[at]
        stack.append((cost + 3, edits + "I", i, want))
        if i < len(codes):
            role, state = "sua?"[codes[i] & 3], codes[i] >> 2
            stack.append((cost + 4, edits + "D", i + 1, at))
            if state in (turns.SOUND, turns.TRUNCATED):
                more = cost + (3 if state == turns.TRUNCATED else 0)
                stack.append((more, edits + "K", i + 1, want) if role == want else (more + 3, edits + "R", i + 1, want))
                if role == "s" and at == "0":
                    stack.append((more, edits + "K", i + 1, "s"))
    return found


def test_audits_by_all_edits():
    rng = random.Random(6)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) | rng.choice([0, 0, 0, 1, 2, 3]) << 2 for _ in range(rng.randint(0, 4)))
        assert turns.audit(codes) == all_repairs(codes)


def test_a_long_conversation_is_aligned_in_proportion():
    rng = random.Random(7)
    codes = bytes((1 + i % 2) | rng.choice([0] * 9 + [1, 3]) << 2 for i in range(60_000))
    cost, edits = turns.audit(codes)
    assert cost > 0 and len(edits) >= len(codes) and edits.count("D") + edits.count("K") + edits.count("R") == len(codes)


CONVERSATIONS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 2, "user", "And?"), (1, 3, "user", "And?"), (1, 4, "assistant", "So it"),
    (2, None, "system", "Rules!"), (2, 5, "assistant", "Right."), (2, 5, "assistant", "Right."), (2, 9, "user", None),
    (3, 0, None, "x."), (3, 1, "", "y."), (3, 2, "tool", "z."), (3, 3, "System", "t."),
    (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (4, 0, "user", "   \n"), (5, 2, "user", "long. " * 20_000), (5, 1, "user", "first."),
]


def brute_repair(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == c), key=lambda m: (m[0], m[1], hashlib.md5(f"{len(m[1])}:{m[1]}{m[2]}".encode()).hexdigest()))
        seen, codes, states = set(), [], []
        for _, r, x in mine:
            bare = x.strip(" \t\n\x0b\x0c\r")
            state = 1 if not bare else 2 if (r, x) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((r, x))
            states.append(state)
            codes.append({"s": 0, "u": 1, "a": 2}.get(r[:1], 3) | state << 2)
        cost, edits = turns.audit(bytes(codes))
        want, body, at, row = turns.targets(edits), [], 0, 0
        for e in edits:
            if e != "D":
                name = {"u": "user", "a": "assistant"}.get(want[at])
                body.append(f"{mine[row][1] if e == 'K' else name}:{'' if e == 'I' else mine[row][2]}")
                at += 1
            row += e != "I"
        known = [t for t, *_ in mine if t >= 0]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((x[1][:1], y[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for x, y in itertools.pairwise(mine))
        out[c] = (gaps, *(states.count(k) for k in (1, 2, 3)), illegal, cost, edits, hashlib.sha256("\n".join(body).encode()).hexdigest())
    return out


def test_repair(spark):
    given = spark.createDataFrame([(*r, "x", "y", 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, c string, h string, n int")
    report, repaired = turns.repair(given.repartition(5))
    digest = {r.conv_id: r.repaired_sha256 for r in turns.digests(repaired).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, none)) for r in report.collect()}
    assert got == brute_repair(CONVERSATIONS)
    for conv, rows in itertools.groupby(sorted(repaired.collect(), key=lambda r: (repr(r.conv_id), r.pos)), key=lambda r: r.conv_id):
        rows = list(rows)
        initials = "".join(r.role[0] for r in rows)
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2) and [r.pos for r in rows] == list(range(len(rows)))
        assert "".join(r.edit for r in rows) == got[conv][6].replace("D", "")


def test_repair_of_an_empty_table(spark):
    report, repaired = turns.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == repaired.count() == 0 == turns.digests(repaired).count()


def test_damage(spark):
    rows = [(c, t, "assistant", f"Turn {t}. Really?") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    got = turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        word = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        row = (c, t, "user" if k == 4 else word(r), "" if k == 1 else word(x).translate({ord(p): None for p in ".!?"}) if k == 2 else word(x))
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


# names


INNER = ["__did", "__tkey", "row", "given", "done", "blob", "spans", "keep_bitmap", "kept", "found", "score", "__score", "__lines", "__spans", "__blob", "__keep", "uid", "c", "t", "h", "n", "k", "pos", "did", "tkey", "node", "component", "words", "share", "symbols", "pairs", "times", "class"]


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    """Documents with a column of each inner name, and the same without them."""
    line = "the same long line in every text of three"
    texts = [f"{line}\nof its own {i} {'x' * i}" for i in range(4)] + ["a b c d e f g h " * 5, "a b c d e f g h " * 5, "password = hunter22secret", None, "you zorgue"]
    own = [f"own {c}" for c in INNER]
    rows = [(i, x, "en", "s", 0, *own) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INNER))
    folder = tmp_path_factory.mktemp("named")
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return docs, str(folder)


def same_rows(got, plain, docs):
    """Rows and columns as without the extra columns, and those untouched."""
    assert got.columns == docs.columns
    key = lambda r: (r.doc_id, r.text or "")
    rows, want = sorted(got.collect(), key=key), sorted(plain.collect(), key=key)
    assert [(r.doc_id, r.text) for r in rows] == [(r.doc_id, r.text) for r in want]
    assert all(r[c] == f"own {c}" for r in rows for c in INNER)


@pytest.mark.parametrize("stage", range(4))
def test_stages_with_columns_of_every_inner_name(spark, named, stage):
    import corpus_pipeline

    docs, folder = named
    _, run = corpus_pipeline.STAGES[stage]
    plain = docs.drop(*INNER)
    same_rows(run(spark, docs, folder), run(spark, plain, folder), docs)


def test_operators_with_columns_of_every_inner_name(spark, named):
    from lodestone.llm import bpe, lines, minhash, packing, secrets, substrings
    from lodestone.llm.queries import WORD_VOCAB

    docs, _ = named
    plain = docs.drop(*INNER)
    count = docs.count()
    assert minhash.keep_one(docs).count() == minhash.keep_one(plain).count() < count
    assert minhash.near_duplicates(docs).count() == count
    lost = lambda d: lines.drop_lines(d, lines.keep_bitmaps(d)).agg(F.sum("__lines.n_dropped")).first()[0]
    assert lost(docs) == lost(plain) == 3
    spans = lambda d: secrets.scan(d).agg(F.sum(F.size("spans"))).first()[0]
    assert spans(docs) == spans(plain) == 1
    gone = lambda d: substrings.remove_repeats(d).agg(F.sum("n_removed")).first()[0]
    assert gone(docs) == gone(plain) > 0
    assert packing.pack(docs, WORD_VOCAB).count() == packing.pack(plain, WORD_VOCAB).count()
    assert bpe.round_trip(docs, BYTE_VOCAB).count() == count
    assert align.summarize(docs, BYTE_VOCAB, PIECE_MODEL).count() == count
    assert hmm.score(docs, states=2, rounds=(16,)).count() == count


def test_a_ledger_that_holds_a_blob_twice(spark, tmp_path):
    from lodestone.llm import secrets

    ledger = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token: abcdef123")], "doc_id long, text string")
    secrets.scan(docs, ledger=ledger).collect()
    spark.read.parquet(ledger).write.parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("append").parquet(ledger)
    assert secrets.scan(docs, ledger=ledger).count() == 1
