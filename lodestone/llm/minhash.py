"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is its set of word shingles. The sketch has ``T`` coordinates filled in rounds: in
round i every element is hashed to one coordinate with a value in [i, i + 1), the smallest
stays, and rounds end as soon as every coordinate is filled; from round T on, round i fills
coordinate i - T, so 2T rounds always suffice. Two sets agree in a coordinate with the
probability of their similarity, and the number of agreements is concentrated around it.

Documents with equal sets are one class, found by a 128-bit fingerprint; only classes go on.
Bands of the sketch give buckets. First each class is checked against the smallest class it
shares a bucket with, and the links that hold give components; buckets that are large and hold
several components go on with other hubs for some rounds. What is still open in a bucket is
compared by whole sketches inside a task, which passes on no more than a forest over its
members; the trees of all buckets give groups that hold every pair worth checking. A group's
shingle sets meet block by block, and each pair of different components that agrees in the
sketches is confirmed there on the full sets; again only a forest of links comes out. The
members of a group's largest component never meet one another, only the members outside it
do and meet them; so rows follow the members of a group, and no link between components is lost.

A pair of similarity 0.8 shares no band with a probability of 5e-8 (32 bands of 4), and its
sketches agree in fewer than ``AGREE`` of the ``T`` coordinates with one of about 4e-5.

Defined cases: a text of fewer words than a shingle is one shingle; one without words (or
null) has the empty set and is linked with nothing. Rows that share a doc_id but not the text
are linked text by text. A null doc_id counts as the smallest id inside and comes back as
null. Extra columns don't matter. Empty table, empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import NULL_ID, binary_values, ident, packed, staged
from lodestone.llm.graph import HOT, components, stars
from lodestone.llm.words import WordHashes, mixed, rolling

T, BANDS, ROWS, AGREE = 512, 32, 4, 374
BLOCK, HUBS = 2048, 3  # members that meet in a task; rounds of further hubs for larger buckets
_EMPTY = np.uint64(2**64 - 1)
_LIKELY = 4 * T + T * T.bit_length()
_SEEDS = np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
_SKETCH_SQL = "did long, tkey long, n long, f1 long, f2 long, bands array<long>, coords binary"
_SKETCH = pa.schema([("did", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("coords", pa.binary())])
_HASHES = WordHashes()


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``k`` words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = _HASHES.of(words)
    if len(words) < k:  # the whole sequence is one shingle; its length keeps it apart
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], dtype=np.uint64)
    return np.unique(rolling(h, k))


def begin() -> None:
    _HASHES.begin()


def sketch(items: np.ndarray) -> np.ndarray:
    """The ``T`` coordinates of a non-empty set.

    As many rounds go together as are likely to fill all coordinates: values of a later round
    are larger, so rounds past the last one needed change nothing.
    """
    out = np.full(T, _EMPTY, dtype=np.uint64)
    i = 0
    while i < T:
        rounds = min(T - i, max(1, _LIKELY // len(items)))
        h = mixed(items[None, :] + _SEEDS[i : i + rounds, None])
        value = (np.arange(i, i + rounds, dtype=np.uint64)[:, None] << np.uint64(48)) | (h >> np.uint64(16))
        np.minimum.at(out, (h & np.uint64(T - 1)).astype(np.intp).ravel(), value.ravel())
        i += rounds
        if out.max() != _EMPTY:
            return out
    for i in range(T, 2 * T):
        h = mixed(items + _SEEDS[i])
        out[i - T] = min(out[i - T], (np.uint64(i << 48) | (h >> np.uint64(16))).min())
    return out


def bands(coords: np.ndarray) -> np.ndarray:
    """One hash for each band of ``ROWS`` coordinates; bands differ in their seeds."""
    rows = coords[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(ROWS):
        out = mixed(out + rows[:, j])
    return out.view(np.int64)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            n, prints, rows, low = [], [], [], []
            for text in binary_values(batch, "text"):
                items = shingles(text, k)
                n.append(len(items))
                prints.append(xxhash.xxh3_128_digest(items.tobytes()))
                coords = sketch(items) if len(items) else None
                rows.append(None if coords is None else bands(coords))
                low.append(None if coords is None else coords.astype(np.uint8).tobytes())
            f = np.frombuffer(b"".join(prints), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("__did"), batch.column("__tkey"), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(rows, pa.list_(pa.int64())), pa.array(low, pa.binary())], schema=_SKETCH)

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _forest(percent: int, exact: bool):
    """Links (a, b) between members of one (group, block, block); rows come sorted by these.

    Members of different components are compared by size and sketch and, if ``exact``, by their
    sets. A pair that holds joins two trees, so fewer links come out than there are members.
    """

    def compare(i: int, j: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda r: (r[0], r[1]))
        block, node, label, n = (np.array([r[k] for r in held], dtype=np.int64) for k in (0, 1, 2, 3))
        if (label == label[0]).all():
            return
        coords = np.frombuffer(b"".join(r[4] for r in held), dtype=np.uint8).reshape(len(held), T)
        sets = [np.frombuffer(r[5], dtype=np.uint64) for r in held] if exact else None
        # a link joins components; what is only worth checking joins members, since a pair of
        # the same two components may hold where this one fails
        tree = label.copy() if exact else np.arange(len(held))
        right = np.flatnonzero(block == j)
        a, b = [], []
        for x in range(len(held) - 1):
            if block[x] != i:
                break
            y = right[right > x] if i == j else right
            y = y[(label[y] != label[x]) & (tree[y] != tree[x]) & (100 * n[y] >= percent * n[x]) & (100 * n[x] >= percent * n[y])]
            if len(y):
                y = y[(coords[y] == coords[x]).sum(axis=1) >= AGREE]
            for k in y.tolist():
                if tree[k] != tree[x] and (sets is None or _similar(sets[x], sets[k], percent)):
                    tree[tree == tree[k]] = tree[x]
                    a.append(node[x])
                    b.append(node[k])
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("grp", "i", "j", "block", "node", "c", "n", "coords", *(["items"] if exact else []))]
            for grp, i, j, *rest in zip(*cols):
                if key != (grp, i, j):
                    if len(held) > 1:
                        yield from compare(key[1], key[2], held)
                    key, held = (grp, i, j), []
                held.append(rest)
        if len(held) > 1:
            yield from compare(key[1], key[2], held)

    return run


def _blocks_meet(members: DataFrame) -> DataFrame:
    """``members`` (grp, node, c, ...) of groups with two components or more, dealt to pairs of blocks.

    Blocks of the largest component have numbers from 0 on below; they meet the blocks of the
    members outside it, which are numbered down from -1 there, and these meet one another too.
    """
    sizes = members.groupBy("grp", "c").agg(F.count("*").alias("k"))
    open_ = sizes.groupBy("grp").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"), F.count("*").alias("components")).where("components > 1")
    many = lambda k: F.ceil(k / BLOCK).cast("int")
    open_ = open_.select("grp", F.col("top.c").alias("__top"), many(F.col("top.k")).alias("__inside"), many(F.col("k") - F.col("top.k")).alias("__outside"))
    rows = members.join(open_, "grp").withColumn("__in", F.col("c") == F.col("__top"))
    rows = rows.withColumn("block", F.when(F.col("__in"), F.pmod(F.xxhash64("node"), F.col("__inside"))).otherwise(-1 - F.pmod(F.xxhash64("node"), F.col("__outside"))).cast("int"))
    outside, inside = F.sequence(-F.col("__outside"), F.lit(-1)), F.sequence(F.lit(0), F.col("__inside") - 1)
    to = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    of_inside = F.transform(outside, lambda o: to(o, F.col("block")))
    of_outside = F.concat(F.transform(inside, lambda o: to(F.col("block"), o)), F.transform(outside, lambda o: to(F.least(F.col("block"), o), F.greatest(F.col("block"), o))))
    pair = F.explode(F.when(F.col("__in"), of_inside).otherwise(of_outside))
    return rows.withColumn("__p", pair).select("*", "__p.i", "__p.j").drop("__p", "__top", "__in", "__inside", "__outside")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "items": pa.array([shingles(t, k).tobytes() for t in binary_values(batch, "text")], pa.binary())})

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                keep.append(_similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, node) whose full sets are similar enough, as links (a, b).

    A hub with more than a ``HOT``-th of all pairs is split into parts; there are fewer than
    ``HOT`` such hubs, so their list is broadcast.
    """
    pairs = staged(pairs, "pairs")
    total = pairs.count()
    hot = pairs.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") * HOT > total)
    hot = F.broadcast(hot.select("a", F.ceil(F.col("k") * HOT / total).cast("int").alias("parts")))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x")).join(hot, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    return dealt.join(x, ["a", "part"]).join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``__did, __tkey, n_shingles, component`` for each row of ``docs``."""
    rows = docs.select(*ident(), "text")
    known = staged(rows.mapInArrow(_sketches(shingle_words), _SKETCH_SQL), "sketches")
    classes = known.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("did", "tkey")).alias("first"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    # a node is a class, not a doc_id: an id may have several texts
    classes = staged(classes.select("f1", "f2", F.xxhash64("f1", "f2").alias("node"), F.col("first.did").alias("did"), F.col("first.tkey").alias("tkey"), "n", "bands"), "classes")

    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("most")).where("hub.node < most").select("band", "hub")
    # members of buckets with two classes or more
    members = staged(banded.join(shared, "band").select("band", "node", "n", "hub"), "buckets")
    sizes = classes.select("node", "n")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "did", "tkey")
    texts = rows.dropDuplicates(["__did", "__tkey"]).join(wanted, (F.col("__did") == F.col("did")) & (F.col("__tkey") == F.col("tkey"))).select("node", "text")
    sets = staged(texts.mapInArrow(_sets(shingle_words), "node long, items binary"), "sets")

    def star(towards: DataFrame) -> DataFrame:
        """Confirmed links of each node with its hub; ``towards`` has (node, n, hub), hub being (node, n)."""
        near = (F.col("n") * 100 >= F.col("hub.n") * percent) & (F.col("hub.n") * 100 >= F.col("n") * percent)
        pairs = towards.where(near & (F.col("hub.node") != F.col("node"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        return staged(_confirm(pairs, sets, percent), "links")

    def joined(linked: DataFrame, links: DataFrame) -> DataFrame:
        """The stars of ``linked`` and further links, which often are none."""
        if not links.head(1):
            return linked
        return stars(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    linked = stars(star(members.groupBy("node").agg(F.any_value("n").alias("n"), F.min("hub").alias("hub"))))
    for turn in range(HUBS):
        known_c = members.select("band", "node", "n").join(linked, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("c"))
        turned = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "c", "n")
        large = known_c.groupBy("band").agg(F.min(turned).alias("hub"), F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where(f"k > {BLOCK} and lo < hi").select("band", "hub")
        large = staged(large, "large-buckets")
        if not large.head(1):
            break
        # the buckets are large, so they are few against their members
        towards = known_c.join(large, "band").where("c <> hub.c").groupBy("node").agg(F.any_value("n").alias("n"), F.min("hub").alias("hub"))
        linked = joined(linked, star(towards))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order, shape = ["grp", "i", "j"], ["grp", "i", "j", "block", "node", "c", "n", "coords"]
    labelled = members.join(linked, "node", "left").select(F.col("band").alias("grp"), "node", "n", F.coalesce("component", "node").alias("c"))
    short = staged(known.where("n > 0").select("did", "tkey", "coords").join(wanted, ["did", "tkey"]).select("node", "coords").dropDuplicates(["node"]), "coords")
    dealt = _blocks_meet(labelled).join(short, "node").repartition(n, *order).sortWithinPartitions(*order)
    worth = staged(dealt.select(*shape).mapInArrow(_forest(percent, False), "a long, b long"), "worth-checking")

    def late() -> DataFrame:
        """Links between components that the pairs worth checking lead to."""
        groups = components(worth).select("node", F.col("component").alias("grp"))
        inside = groups.join(sizes, "node").join(linked, "node", "left").select("grp", "node", "n", F.coalesce("component", "node").alias("c"))
        dealt = _blocks_meet(inside).join(short, "node").join(sets, "node").repartition(n, *order).sortWithinPartitions(*order)
        return staged(dealt.select(*shape, "items").mapInArrow(_forest(percent, True), "a long, b long"), "late-links")

    whole = joined(linked, late()) if worth.head(1) else linked
    held = classes.join(whole, "node", "left").select("f1", "f2", "did", F.coalesce("component", "node").alias("grp"))
    node_of = held.join(held.groupBy("grp").agg(F.min("did").alias("component")), "grp").select("f1", "f2", "component")
    out = known.join(node_of, ["f1", "f2"], "left")
    return out.select(F.col("did").alias("__did"), F.col("tkey").alias("__tkey"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("did")).alias("component"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without those that another document of their component stands for."""
    found = near_duplicates(docs, **how).where("__did = component").select("__did", "__tkey").distinct()
    return packed(docs, *ident()).join(found, ["__did", "__tkey"], "left_semi").select("row.*")


def restored(col: str):
    """An inner id as the caller's id: NULL_ID is null again."""
    return F.when(F.col(col) != NULL_ID, F.col(col))
