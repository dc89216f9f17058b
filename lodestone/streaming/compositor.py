"""Interval tables composited to fixed lengths as their files arrive.

A hole's rows may come in any number of batches and need not stand together. Each hole keeps its open bins
[k L, (k + 1) L) as state; a bin is published once the hole has gone ``slack`` metres past it, or at the hole's
end. What is published are parts that add up (metres, metres times value, metres by text), so a late row just
publishes one more part of its bin: composites are the same in one batch and in many, and no
row is lost. State holds the open bins only.

A text column takes the value with most metres in the bin, of equals the one that begins higher up, then the least.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "held string"
PART = "hole string, k long, from_ double, to_ double, n long, metres map<string,double>, totals map<string,double>, texts array<struct<name:string,text:string,metres:double,first:double>>"
_EDGE = 1e-9
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}


def usable(rows: DataFrame, ended: str | None = None) -> DataFrame:
    """Rows with a hole and a positive length; and those that mark a hole's end, if there is such a column."""
    whole = F.col("from_").isNotNull() & F.col("to_").isNotNull() & (F.col("to_") > F.col("from_")) & (F.abs(F.col("to_")) < float("inf")) & (F.abs(F.col("from_")) < float("inf"))
    named = F.trim(F.col("hole").cast("string")) != ""
    return rows.where(named & (whole | F.col(ended)) if ended else named & whole)


class Bins(dict):
    """Open bins of one hole: k -> part."""

    def add(self, a: float, b: float, row: tuple, length: float, numbers: list[str], texts: list[str]) -> None:
        for k in range(math.floor(a / length + _EDGE), math.ceil(b / length - _EDGE)):
            top, base = max(a, k * length), min(b, (k + 1) * length)
            w = base - top
            if w <= _EDGE:
                continue
            part = self.setdefault(k, {"from_": top, "to_": base, "n": 0, "metres": {}, "totals": {}, "texts": {}})
            part["from_"], part["to_"], part["n"] = min(part["from_"], top), max(part["to_"], base), part["n"] + 1
            for c, v in zip(numbers, row):
                if v is not None and math.isfinite(v):
                    part["metres"][c] = part["metres"].get(c, 0.0) + w
                    part["totals"][c] = part["totals"].get(c, 0.0) + v * w
            for c, t in zip(texts, row[len(numbers) :]):
                if isinstance(t, str) and (t := t.strip()):
                    m, first = part["texts"].setdefault(c, {}).get(t, (0.0, top))
                    part["texts"][c][t] = (m + w, min(first, top))

    def taken(self, hole: str, below: float, length: float) -> list[dict]:
        """Parts of the bins that end above a depth; they leave."""
        out = []
        for k in sorted(k for k in self if (k + 1) * length <= below):
            part = self.pop(k)
            texts = [{"name": c, "text": t, "metres": m, "first": f} for c, seen in part["texts"].items() for t, (m, f) in seen.items()]
            out.append({"hole": hole, "k": k, **part, "texts": texts})
        return out


def parts(rows: DataFrame, length: float, numbers: list[str], texts: list[str] = [], slack: float = 0.0, ended: str | None = None, keys: int = 256) -> DataFrame:  # noqa: B006
    """A stream of published parts of ``rows`` (hole, from_, to_ and the columns named).

    ``ended``: a boolean column that is true in a hole's last row. Holes share ``keys`` keys of the state by
    their hash, since a state of its own for each hole costs more than its rows. A task holds the open bins of one
    key at a time, so there should be a key for every few thousand holes (``keys_for``); the
    number must stay as it is while the stream's checkpoint is in use.
    """
    if not length > 0:
        raise ValueError("the length must be above 0")

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # hole -> deepest top so far, open bins
        before = json.loads(state.get[0]) if state.exists else {}
        held = {h: (math.inf if d is None else d, Bins({int(k): v for k, v in b.items()})) for h, (d, b) in before.items()}
        touched = set()
        for frame in frames:
            for hole, a, b, over, *row in zip(*(frame[c].tolist() for c in ("hole", "from_", "to_", "__ended", *numbers, *texts))):
                deepest, bins = held.get(hole) or (-math.inf, Bins())
                if b > a:  # false for missing ends too
                    bins.add(a, b, row, length, numbers, texts)
                    deepest = max(deepest, a)
                if over or b > a:
                    held[hole] = (math.inf if over else deepest, bins)  # after a hole's end rows are published as they come
                    touched.add(hole)
        out = [part for hole in sorted(touched) for part in held[hole][1].taken(hole, held[hole][0] - slack, length)]
        state.update((json.dumps({h: (d if math.isfinite(d) else None, b) for h, (d, b) in held.items()}),))
        if out:
            yield pd.DataFrame(out)

    over = F.coalesce(F.col(ended), F.lit(False)) if ended else F.lit(False)
    ready = usable(rows, ended).select(F.trim(F.col("hole").cast("string")).alias("hole"), *(F.col(c).cast("double").alias(c) for c in ("from_", "to_", *numbers)), *texts, over.alias("__ended"))
    ready = ready.withColumn("__key", F.pmod(F.xxhash64("hole"), F.lit(keys)))
    return ready.groupBy("__key").applyInPandasWithState(run, PART, _STATE, "append", GroupStateTimeout.NoTimeout)


def keys_for(holes: int) -> int:
    """Keys of the state for so many holes."""
    return max(256, holes // 4096)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Publishes all that can be published now into a Parquet table; may be run again when files have come.

    The state lies in RocksDB, on disk: the store that is the default holds all open bins, twice, in the executors' memory.
    """
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        conf.set(k, v)
    try:
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def open_parts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The bins that are still open, read from the stream's state."""
    part = "struct<from_:double,to_:double,n:bigint,metres:map<string,double>,totals:map<string,double>,texts:map<string,map<string,array<double>>>>"
    holes = spark.read.format("statestore").load(checkpoint).select(F.explode(F.from_json("value.groupState.held", "map<string,array<string>>")).alias("hole", "v"))
    held = holes.select("hole", F.explode(F.from_json(F.col("v")[1], f"map<string,{part}>")).alias("k", "p")).withColumn("k", F.col("k").cast("long"))
    texts = F.flatten(F.transform(F.map_entries("p.texts"), lambda c: F.transform(F.map_entries(c["value"]), lambda t: F.struct(c["key"].alias("name"), t["key"].alias("text"), t["value"][0].alias("metres"), t["value"][1].alias("first")))))
    return held.select("hole", "k", *(F.col(f"p.{c}").alias(c) for c in ("from_", "to_", "n", "metres", "totals")), texts.alias("texts"))


def composites(published: DataFrame, numbers: list[str], texts: list[str] = []) -> DataFrame:  # noqa: B006
    """``hole, k, from_, to_, n``, means and texts of each bin, from its parts."""
    means = [(F.sum(F.col("totals")[c]) / F.nullif(F.sum(F.col("metres")[c]), F.lit(0.0))).alias(c) for c in numbers]
    out = published.groupBy("hole", "k").agg(F.min("from_").alias("from_"), F.max("to_").alias("to_"), F.sum("n").alias("n"), *means)
    if texts:
        each = published.select("hole", "k", F.explode("texts").alias("t")).groupBy("hole", "k", "t.name", "t.text").agg(F.sum("t.metres").alias("m"), F.min("t.first").alias("f"))
        # metres to the micrometre: sums of parts in another order may differ in their last bit
        rank = F.struct(-F.round("m", 6), "f", "text")
        best = each.groupBy("hole", "k").agg(*(F.min(F.when(F.col("name") == c, rank)).getField("text").alias(c) for c in texts))
        out = out.join(best, ["hole", "k"], "left")
    return out
