"""Decisions that a file's own rows take when it is read: conventions, units, joins, filters, merges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEET = 3.2808398950131235


def scan_columns(rows: DataFrame, columns: list[str], number: Callable[[Column], Column]) -> DataFrame:
    """Of each column: blank, negative and zero cells and the largest value (0 at least); one pass."""
    parts = []
    for c in columns:
        text, v = F.trim(F.col(c).cast("string")), number(F.col(c))
        parts += [F.count(F.when(F.coalesce(text, F.lit("")) == "", 1)).alias(f"{c}__b"), F.count(F.when(v < 0, 1)).alias(f"{c}__n"), F.count(F.when(v == 0, 1)).alias(f"{c}__z"), F.greatest(F.coalesce(F.max(v), F.lit(0.0)), F.lit(0.0)).alias(f"{c}__m")]
    stacked = ", ".join(f"'{c}', `{c}__b`, `{c}__n`, `{c}__z`, `{c}__m`" for c in columns)
    return rows.agg(*parts).selectExpr(f"stack({len(columns)}, {stacked}) as (column, n_blank, n_negative, n_zero, most)")


def dip_convention(rows: DataFrame, dip: str, by: list[str] | None = None, steep: float = 45.0) -> DataFrame:
    """``convention`` of a file's dips: ``pos_down`` if none is negative and 90 % of the positive ones are steep."""
    d = F.col(dip)
    s = rows.where(d.isNotNull() & ~F.isnan(d) & (d != 0)).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count(F.when(d > 0, 1)).alias("positive"), F.count(F.when(d < 0, 1)).alias("negative"), F.count(F.when(d >= steep, 1)).alias("steep"))
    down = (F.col("negative") == 0) & (F.col("positive") > 0) & (F.col("steep") >= 0.9 * F.col("positive"))
    return s.withColumn("convention", F.when(down, "pos_down").otherwise("neg_down"))


def depth_unit_hint(rows: DataFrame, collars: DataFrame) -> DataFrame:
    """``kind`` of depth against hole length where 60 % of two holes or more agree: ``feet`` or ``metres``; a row or none.

    ``rows`` has ``hole, depth``, ``collars`` ``hole, length``; ``ratio`` is the upper median of those that agree.
    """
    deep = rows.where(F.col("hole").isNotNull()).groupBy("hole").agg(F.max("depth").alias("d"))
    r = deep.join(collars.select("hole", "length"), "hole").where("length > 0 and d > 0").select((F.col("d") / F.col("length")).alias("r"))
    feet, metres = (F.col("r").between(k * 0.9, k * 1.1) for k in (FEET, 0.305))
    r = r.withColumn("kind", F.when(feet, "feet").when(metres, "metres"))
    total = r.agg(F.count("*").alias("total"))
    kinds = r.where("kind is not null").groupBy("kind").agg(F.count("*").alias("holes"))
    from lodestone.operators.stats import cumulative

    middle = cumulative(r, ["kind"], "r").where((F.col("cum") > F.floor(F.col("total") / 2)) & (F.col("cum") - F.col("w") <= F.floor(F.col("total") / 2))).select("kind", F.col("r").alias("ratio"))
    met = kinds.join(middle, "kind").withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one")
    return met.where("total >= 2 and holes >= total * 0.6").select("kind", "ratio", "holes", "total")


def per_hole_join(rows: DataFrame, collars: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Collars with the other columns of a per-hole table, if every row of it names a collar at the same place.

    ``rows`` and ``collars`` have ``hole, x, y``; rows without an id don't count. If a row has no
    collar, lies farther off than the tolerance or lacks a place, nothing joins and the columns stay null.
    """
    key = lambda c: F.trim(F.col(c).cast("string"))
    extra = [c for c in rows.columns if c not in ("hole", "x", "y")]
    named = rows.where(F.coalesce(key("hole"), F.lit("")) != "").select(key("hole").alias("__h"), F.col("x").alias("__x"), F.col("y").alias("__y"), *extra)
    at = collars.select(key("hole").alias("__h"), F.col("x").alias("__cx"), F.col("y").alias("__cy"))
    near = (F.abs(F.col("__x") - F.col("__cx")) <= tolerance) & (F.abs(F.col("__y") - F.col("__cy")) <= tolerance)
    bad = named.join(at, "__h", "left").agg(F.count(F.when(~F.coalesce(near, F.lit(False)), 1)).alias("__bad"))
    one = named.dropDuplicates(["__h"]).drop("__x", "__y")
    out = collars.withColumn("__h", key("hole")).join(one, "__h", "left").withColumn("__one", F.lit(1)).join(F.broadcast(bad.withColumn("__one", F.lit(1))), "__one")
    return out.select(*collars.columns, *(F.when(F.col("__bad") == 0, F.col(c)).alias(c) for c in extra))


def qc_links(rows: DataFrame, order: str) -> DataFrame:
    """``sample_id, parent_id, sample_type`` of a link table: of an id's rows the last counts; rows that link nothing are out."""
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c)
    clean = rows.select(text("sample_id"), text("parent_id"), text("sample_type"), F.col(order).alias("__o")).where("sample_id <> '' and (parent_id <> '' or sample_type <> '')")
    last = clean.groupBy(F.upper("sample_id").alias("__k")).agg(F.max_by(F.struct("sample_id", "parent_id", "sample_type"), "__o").alias("r"))
    return last.select("r.*")


def merge_assays(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Results of one interval and source as one row: incoming values replace, values they lack stay."""
    both = old.select(*keys, *values, F.lit(0).alias("__s")).unionByName(new.select(*keys, *values, F.lit(1).alias("__s")))
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__s"))).alias(c) for c in values]
    return both.groupBy(*keys).agg(*latest)


def drop_holes(rows: DataFrame, holes: DataFrame, keys: tuple[str, ...] = ("hole", "source"), qc: str | None = None) -> DataFrame:
    """Rows without those of the listed holes (and source); rows marked as ``qc`` stay."""
    gone = holes.select(*keys).distinct()
    if qc is None:
        return rows.join(gone, list(keys), "left_anti")
    return rows.where(F.coalesce(F.col(qc), F.lit(False))).unionByName(rows.where(~F.coalesce(F.col(qc), F.lit(False))).join(gone, list(keys), "left_anti").select(*rows.columns))


def recovery(drilled: Column, loss: Column | None = None, recovered: Column | None = None) -> Column:
    """Core recovery in per cent to four digits, from the loss or from what was recovered; null on a run of no length."""
    share = (drilled - loss) / drilled if loss is not None else recovered / drilled
    return F.when(drilled > 0, F.round(share * 100, 4))


def filled_down(rows: DataFrame, hole: str, order: str, section: str, cuts: int = 128) -> DataFrame:
    """Blank ids take the last id above them inside a section of the file (a sheet, a split).

    A section is cut into stretches of about equal counts; each takes over the last id of those above, so a
    long section isn't one task's. ``order`` is a number.
    """
    text = F.trim(F.col(hole).cast("string"))
    given = F.when(text != "", text)
    place = F.col(order).cast("double")
    marks = sorted(set(rows.agg(F.percentile_approx(place, [i / cuts for i in range(1, cuts)], 20 * cuts)).first()[0] or []))
    dealt = rows.withColumn("__b", F.size(F.filter(F.lit(marks).cast("array<double>"), lambda m: m <= place)) if marks else F.lit(0))
    ends = dealt.groupBy(F.col(section).alias("__section"), F.col("__b").alias("__c")).agg(F.max_by(given, F.when(given.isNotNull(), F.col(order))).alias("__last"))
    over = Window.partitionBy("__section").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__section", "__c", F.last("__last", True).over(over).alias("__above"))
    inside = Window.partitionBy(section, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("__own", F.last(given, True).over(inside)).join(ends, F.col(section).eqNullSafe(F.col("__section")) & (F.col("__b") == F.col("__c")), "left")
    return met.withColumn(hole, F.coalesce("__own", "__above")).select(*rows.columns)


def holes_matching(filter_text: str, hole: str = "hole", fields: dict[str, str] | None = None) -> Column:
    """A condition from typed terms: ids by part (any of them), ``field=value`` (any of one field, all fields).

    Case doesn't count and ``_`` stands for a space. A value matches as the whole or as a word.
    ``fields`` maps the names that may be typed to columns; a term of another field matches nothing.
    """
    plain = lambda c: F.replace(F.lower(F.trim(F.col(c).cast("string"))), F.lit("_"), F.lit(" "))
    norm = lambda t: t.strip().lower().replace("_", " ")
    ids, picks = [], {}
    for term in filter_text.replace(",", " ").split():
        if "=" in term:
            name, value = map(norm, term.split("=", 1))
            picks.setdefault(name, []).append(value)
        else:
            ids.append(norm(term))
    out = [reduce(or_, (plain(hole).contains(t) for t in ids))] if ids else []
    known = {norm(k): c for k, c in (fields or {}).items()}
    for name, values in picks.items():
        if name not in known:
            return F.lit(False)
        c = plain(known[name])
        out.append(reduce(or_, ((c == v) | F.array_contains(F.split(c, r"[^a-z0-9.]+"), v) for v in values)))
    return reduce(and_, (F.coalesce(x, F.lit(False)) for x in out)) if out else F.lit(True)


def field_picks(collars: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct values of each collar field with their number of holes; null for holes without a value."""
    stacked = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in fields)
    cells = collars.selectExpr(f"stack({len(fields)}, {stacked}) as (field, value)")
    blank = F.when(F.trim("value") != "", F.trim("value"))
    return cells.groupBy("field", blank.alias("value")).agg(F.count("*").alias("n"))


def coverage(collars: DataFrame, rows: DataFrame, short: float) -> DataFrame:
    """Holes that a log lacks or that it ends short of: ``hole, state, end, length``.

    Holes without rows are reported only if more than half of the holes have some.
    """
    deep = rows.groupBy("hole").agg(F.max("to_").alias("end"))
    met = collars.select("hole", "length").join(deep, "hole", "left")
    share = met.agg((F.count("end") * 2 > F.count("*")).alias("most")).withColumn("__one", F.lit(1))
    state = F.when(F.col("end").isNull() & F.col("most"), "missing").when(F.col("end") < F.col("length") - short, "short")
    out = met.withColumn("__one", F.lit(1)).join(F.broadcast(share), "__one").withColumn("state", state)
    return out.where("state is not null").select("hole", "state", "end", "length")


def unsurveyed(stations: DataFrame, ends: DataFrame, gap: float = 100.0, tail: float = 10.0) -> DataFrame:
    """Stretches of a hole that no station describes: ``hole, from_, to_, kind`` (gap or tail)."""
    order = Window.partitionBy("hole").orderBy("depth")
    at = stations.where(F.col("depth").isNotNull()).select("hole", "depth").distinct().withColumn("next", F.lead("depth").over(order))
    met = at.join(ends.select("hole", "length"), "hole")
    kind = F.when(F.col("next") - F.col("depth") > gap, "gap").when(F.col("next").isNull() & (F.col("length") - F.col("depth") > tail), "tail")
    out = met.select("hole", F.col("depth").alias("from_"), F.least(F.coalesce("next", "length"), F.col("length")).alias("to_"), kind.alias("kind"))
    return out.where("kind is not null and to_ > from_")


def unit_votes(rows: DataFrame, code: str = "code") -> DataFrame:
    """For each ordered pair of units the holes that have both and show the first above: ``above, below, holes, of``."""
    top = rows.where(F.col("from_").isNotNull() & F.col(code).isNotNull()).groupBy("hole", F.col(code).alias("u")).agg(F.min("from_").alias("t"))
    units = top.groupBy("hole").agg(F.collect_list(F.struct("t", "u")).alias("us"))  # a hole has as many as the log has codes
    pairs = units.select(F.explode("us").alias("a"), "us").select("a", F.explode("us").alias("b")).where("a.t < b.t")
    votes = pairs.groupBy(F.col("a.u").alias("above"), F.col("b.u").alias("below")).agg(F.count("*").alias("holes"))
    other = votes.select(F.col("above").alias("below"), F.col("below").alias("above"), F.col("holes").alias("against"))
    return votes.join(other, ["above", "below"], "left").select("above", "below", "holes", (F.col("holes") + F.coalesce("against", F.lit(0))).alias("of"))


def unit_order(votes: DataFrame) -> DataFrame:
    """Units by how many others they start above in most holes: ``unit, wins, rank``."""
    won = votes.where("2 * holes > of").groupBy(F.col("above").alias("unit")).agg(F.count("*").alias("wins"))
    every = votes.select(F.col("above").alias("unit")).union(votes.select("below")).distinct()
    out = every.join(won, "unit", "left").select("unit", F.coalesce("wins", F.lit(0)).alias("wins"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("wins"), "unit")))  # units are few


def declustered_picks(picks: DataFrame, bin_m: float, order: str) -> DataFrame:
    """Of the picks of one hole in one depth bin the middle one by depth."""
    b = Window.partitionBy("hole", F.floor(F.col("depth") / bin_m))
    ranked = picks.withColumn("__n", F.row_number().over(b.orderBy("depth", order))).withColumn("__k", F.count("*").over(b))
    return ranked.where(F.col("__n") == F.floor(F.col("__k") / 2) + 1).drop("__n", "__k")
