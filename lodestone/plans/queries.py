"""The domain operators bound to the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import assay
from lodestone.operators import catchments, desurvey, geostat, grids, intervals, multivar, quality, spatial, stats
from lodestone.plans import bind
from lodestone.plans.bind import rounded, with_
from lodestone.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


# intervals

@query(with_("iv", "isl") + f""", cut AS (
  SELECT iv.hole, iv.code, iv.from_, iv.to_, iv.value, isl.from_ AS top, isl.to_ AS bottom
  FROM iv JOIN isl ON iv.hole = isl.hole AND iv.code = isl.code AND iv.from_ >= isl.from_ AND iv.to_ <= isl.to_
), b AS (
  SELECT *, unnest(range(CAST(floor((from_ - top) / 10) AS BIGINT), CAST(ceil((to_ - top) / 10) AS BIGINT))) AS k FROM cut
), p AS (
  SELECT hole, code, top, bottom, k, value, least(to_, top + (k + 1) * 10) - greatest(from_, top + k * 10) AS len FROM b
)
SELECT hole, code, top + k * 10 AS from_, least(top + k * 10 + 10, bottom) AS to_, {r("sum(len * value) / sum(len)")} AS value, sum(len) AS covered
FROM p WHERE len > 1e-6 GROUP BY hole, code, top, bottom, k HAVING sum(len) >= 5 - 1e-6""")
def composites_by_order(spark, d):
    out = intervals.composite(bind.intervals(spark, d), 10.0, 0.5, domain="code")
    return out.withColumn("value", rounded(F.col("value")))


@query(with_("iv", "isl") + " SELECT hole, code, from_, to_, n FROM isl")
def merge_touching(spark, d):
    return intervals.merge_touching(bind.intervals(spark, d), "code")


@query(with_("iv") + """, o AS (SELECT hole, from_, to_ FROM iv WHERE status = 'O'), e AS (SELECT hole, max(to_) + 25 AS length FROM iv GROUP BY hole),
s AS (SELECT hole, from_, to_ FROM o UNION ALL SELECT hole, 0, 0 FROM e UNION ALL SELECT hole, length, length FROM e),
g AS (SELECT *, max(to_) OVER (PARTITION BY hole ORDER BY from_, to_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT hole, reach AS from_, from_ AS to_ FROM g WHERE from_ > reach + 1e-6""")
def gaps(spark, d):
    iv = bind.intervals(spark, d)
    return intervals.gaps(iv.where("status = 'O'"), iv.groupBy("hole").agg((F.max("to_") + 25).alias("length")))


@query(with_("iv", "ov") + """, g AS (SELECT *, max(to_) OVER (PARTITION BY hole ORDER BY from_, to_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ov),
h AS (SELECT hole, CASE WHEN reach IS NULL THEN 0 ELSE greatest(0, least(to_, reach) - from_) END AS o FROM g)
SELECT hole, count(*) AS n_rows, count(*) FILTER (WHERE o > 1e-6) AS n_overlaps, sum(o) AS overlap_m FROM h GROUP BY hole""")
def overlap_summary(spark, d):
    return intervals.overlap_summary(bind.overlapping(spark, d))


@query(with_("iv", "ov") + f""", c AS (SELECT DISTINCT hole, from_, to_, value FROM ov),
p AS (SELECT hole, p, lead(p) OVER (PARTITION BY hole ORDER BY p) AS q FROM (SELECT hole, from_ AS p FROM c UNION SELECT hole, to_ FROM c))
SELECT p.hole, p AS from_, q AS to_, {r("avg(value)")} AS value, count(*) AS n, count(DISTINCT value) > 1 AS conflict
FROM p JOIN c ON c.hole = p.hole AND c.from_ <= p AND c.to_ >= q WHERE q IS NOT NULL GROUP BY p.hole, p, q""")
def segments(spark, d):
    return intervals.segments(bind.overlapping(spark, d)).withColumn("value", rounded(F.col("value")))


_PAIRS = "x AS (SELECT b25.hole, b25.from_, b25.to_, isl.code, isl.from_ AS lf, isl.to_ AS lt, least(b25.to_, isl.to_) - greatest(b25.from_, isl.from_) AS m FROM b25 JOIN isl ON b25.hole = isl.hole AND b25.from_ < isl.to_ AND isl.from_ < b25.to_)"


@query(with_("iv", "b25", "isl") + f", {_PAIRS} SELECT hole, from_, to_, arg_max(code, (m, -lf)) AS code FROM x GROUP BY hole, from_, to_")
def code_by_overlap(spark, d):
    return intervals.code_by_overlap(bind.bins25(spark, d), intervals.merge_touching(bind.intervals(spark, d), "code").drop("n"))


@query(with_("iv", "b25", "isl") + """ SELECT b25.hole, b25.from_, b25.to_, isl.code FROM b25 LEFT JOIN isl
ON b25.hole = isl.hole AND isl.from_ <= (b25.from_ + b25.to_) / 2 AND (b25.from_ + b25.to_) / 2 < isl.to_""")
def code_at_midpoint(spark, d):
    return intervals.code_at_midpoint(bind.bins25(spark, d), intervals.merge_touching(bind.intervals(spark, d), "code").drop("n"))


@query(with_("iv", "b25") + f""", x AS (SELECT b25.hole, b25.from_, b25.to_, iv.value, least(b25.to_, iv.to_) - greatest(b25.from_, iv.from_) AS m FROM b25 JOIN iv ON b25.hole = iv.hole AND b25.from_ < iv.to_ AND iv.from_ < b25.to_)
SELECT hole, from_, to_, {r("sum(m * value) / sum(m)")} AS value, sum(m) AS covered FROM x GROUP BY hole, from_, to_""")
def overlap_means(spark, d):
    out = intervals.overlap_means(bind.bins25(spark, d), bind.intervals(spark, d).select("hole", "from_", "to_", "value"))
    return out.withColumn("value", rounded(F.col("value")))


@query(with_("iv", "b25", "isl") + f", {_PAIRS} SELECT hole, from_, to_, code, sum(m) AS metres FROM x GROUP BY hole, from_, to_, code")
def metres_by_code(spark, d):
    return intervals.metres_by_code(bind.bins25(spark, d), intervals.merge_touching(bind.intervals(spark, d), "code").drop("n"))


@query(with_("rd") + f" SELECT hole, floor(depth / 720) * 720 AS bin_from, floor(depth / 720) * 720 + 720 AS bin_to, count(*) AS n, {r('avg(value)', 3)} AS mean, min(value) AS least, max(value) AS most FROM rd WHERE value IS NOT NULL GROUP BY hole, floor(depth / 720)")
def reading_bins(spark, d):
    out = intervals.reading_bins(bind.readings(spark, d), 720.0)
    return out.withColumn("mean", rounded(F.col("mean"), 3))


@query(with_("rd") + """ SELECT event_id, hole, depth, value, list_sort(l)[CAST(floor((len(l) + 1) / 2) AS BIGINT)] AS filtered
FROM (SELECT *, list(value) OVER (PARTITION BY hole ORDER BY depth RANGE BETWEEN 2000 PRECEDING AND 2000 FOLLOWING) AS l FROM rd)""")
def moving_median(spark, d):
    return intervals.moving_median(bind.readings(spark, d), 2000.0).select("event_id", "hole", "depth", "value", "filtered")


@query(with_("rd") + """, days AS (SELECT DISTINCT hole, floor(depth / 1440) * 1440 AS from_, floor(depth / 1440) * 1440 + 1440 AS to_ FROM rd WHERE code = 'purchase')
SELECT rd.event_id, rd.hole, rd.depth, days.from_, days.to_ FROM rd JOIN days ON rd.hole = days.hole AND days.from_ <= rd.depth AND rd.depth < days.to_""")
def readings_in_intervals(spark, d):
    rd = bind.readings(spark, d)
    day = F.floor(F.col("depth") / 1440) * 1440.0
    days = rd.where("code = 'purchase'").select("hole", day.alias("from_"), (day + 1440).alias("to_")).distinct()
    return intervals.readings_in_intervals(rd.select("event_id", "hole", "depth"), days, 720.0)


@query(with_("iv") + f""" SELECT hole, sum(to_ - from_) AS metres, sum((to_ - from_) * value) AS gt, coalesce(sum(to_ - from_) FILTER (WHERE value >= 6), 0) AS metres_above,
coalesce(sum((to_ - from_) * value) FILTER (WHERE value >= 6), 0) AS gt_above, max(value) AS most, min(from_) FILTER (WHERE value >= 6) AS first_above, {r("sum((to_ - from_) * value) / sum(to_ - from_)")} AS grade FROM iv GROUP BY hole""")
def hole_totals(spark, d):
    out = intervals.hole_totals(bind.intervals(spark, d), 6.0)
    return out.withColumn("grade", rounded(F.col("grade")))


@query(with_("iv") + " SELECT hole, coalesce(sum(to_ - from_) FILTER (WHERE code = 'R'), 0) AS thick, min(from_) FILTER (WHERE code = 'R') AS top, max(to_) FILTER (WHERE code = 'R') AS base FROM iv GROUP BY hole")
def coded_thickness(spark, d):
    return intervals.coded_thickness(bind.intervals(spark, d), "code", "R")


@query(with_("iv") + " SELECT hole, arg_min(code, from_) AS code, min(from_) AS depth FROM iv WHERE code <> 'N' GROUP BY hole")
def first_code_under_cover(spark, d):
    return intervals.first_code(bind.intervals(spark, d), ("N",))


def _runs_sql(name: str, cutoff: float, dilution: float, least: float, cap: float | None = None) -> str:
    """Intercepts row by row: a run's state goes down the hole, a run that ends is a row with ``shut``.

    The order lines don't overlap, so each is a segment of its own.
    """
    metal = f"least(value, {cap}) * (to_ - from_)" if cap is not None else "value * (to_ - from_)"
    return f"""{name}_m AS (
  SELECT hole, 0::BIGINT AS p, NULL::DOUBLE AS st, NULL::DOUBLE AS en, 0::DOUBLE AS me, 0::DOUBLE AS sa, 0::BIGINT AS n, 0::DOUBLE AS wm, 0::DOUBLE AS wl, 0::BIGINT AS wn, false AS shut, NULL::DOUBLE AS s0, NULL::DOUBLE AS e0, NULL::DOUBLE AS sa0, NULL::DOUBLE AS me0, NULL::BIGINT AS n0
  FROM (SELECT DISTINCT hole FROM sg)
  UNION ALL
  SELECT hole, p + 1, CASE WHEN grows THEN st WHEN hi THEN f WHEN dies THEN NULL ELSE st END, CASE WHEN hi THEN t WHEN dies THEN NULL ELSE en END,
         CASE WHEN grows THEN me + wm + mv WHEN hi THEN mv ELSE me END, CASE WHEN grows THEN sa + wl + len WHEN hi THEN len ELSE sa END, CASE WHEN grows THEN n + wn + 1 WHEN hi THEN 1 ELSE n END,
         CASE WHEN hi OR dies OR st IS NULL THEN 0 ELSE wm + mv END, CASE WHEN hi OR dies OR st IS NULL THEN 0 ELSE wl + len END, CASE WHEN hi OR dies OR st IS NULL THEN 0 ELSE wn + 1 END,
         st IS NOT NULL AND ((hi AND NOT grows) OR dies), st, en, sa, me, n
  FROM (
    SELECT m.hole, m.p, st, en, me, sa, n, wm, wl, wn, sg.from_ AS f, sg.to_ AS t, sg.to_ - sg.from_ AS len, {metal} AS mv, value >= {cutoff} AS hi,
           st IS NOT NULL AND value >= {cutoff} AND sg.from_ - en <= {dilution} + 1e-6 AND (me + wm + {metal}) / (sa + wl + sg.to_ - sg.from_) >= {cutoff} AS grows,
           st IS NOT NULL AND value < {cutoff} AND sg.to_ - en > {dilution} + 1e-6 AS dies
    FROM {name}_m m JOIN sg ON sg.hole = m.hole AND sg.p = m.p + 1)
), {name} AS (
  SELECT hole, s0 AS from_, e0 AS to_, e0 - s0 AS length, sa0 AS sampled, me0 / sa0 AS grade, n0 AS n FROM {name}_m WHERE shut AND e0 - s0 >= {least} - 1e-6
  UNION ALL
  SELECT hole, st, en, en - st, sa, me / sa, n FROM (SELECT *, max(p) OVER (PARTITION BY hole) AS last FROM {name}_m) WHERE p = last AND st IS NOT NULL AND en - st >= {least} - 1e-6
)"""


_SEGMENTS = with_("iv", recursive=True) + ", sg AS (SELECT hole, from_, to_, value, row_number() OVER (PARTITION BY hole ORDER BY from_) AS p FROM iv WHERE to_ > from_)"


@query(_SEGMENTS + ", " + _runs_sql("best", 6.0, 15.0, 10.0, 9.0) + " SELECT * FROM best")
def best_intercepts(spark, d):
    return intervals.intercepts(bind.intervals(spark, d), 6.0, 15.0, 10.0, 9.0)


@query(_SEGMENTS + ", " + _runs_sql("wide", 5.0, 20.0, 10.0) + ", " + _runs_sql("rich", 9.0, 0.0, 1.0) + """ SELECT b.hole, a.from_ AS parent_from, a.to_ AS parent_to, b.from_, b.to_, b.grade
FROM wide a JOIN rich b ON b.hole = a.hole AND a.from_ <= b.from_ + 1e-6 AND a.to_ >= b.to_ - 1e-6 AND a.length > b.length + 1e-6""")
def including_intercepts(spark, d):
    iv = bind.intervals(spark, d)
    return intervals.attach_including(intervals.intercepts(iv, 5.0, 20.0, 10.0), intervals.intercepts(iv, 9.0, 0.0, 1.0))


# desurvey

_STEP = {
    "tangential": ("l * cos(i1) * sin(a1)", "l * cos(i1) * cos(a1)", "l * sin(i1)"),
    "balanced_tangential": ("l / 2 * (cos(i0) * sin(a0) + cos(i1) * sin(a1))", "l / 2 * (cos(i0) * cos(a0) + cos(i1) * cos(a1))", "l / 2 * (sin(i0) + sin(i1))"),
}
_BEND = "acos(greatest(-1, least(1, cos(i0) * sin(a0) * cos(i1) * sin(a1) + cos(i0) * cos(a0) * cos(i1) * cos(a1) + sin(i0) * sin(i1))))"
_STEP["minimum_curvature"] = tuple(f"({x}) * rf" for x in _STEP["balanced_tangential"])
_FLAT = "(CASE WHEN abs(i1 - i0) < 1e-9 THEN cos(i0) ELSE (sin(i1) - sin(i0)) / (i1 - i0) END)"
_STEP["radius_of_curvature"] = (
    f"l * {_FLAT} * (CASE WHEN abs(t) < 1e-9 THEN sin(a0) ELSE (cos(a0) - cos(a0 + t)) / t END)",
    f"l * {_FLAT} * (CASE WHEN abs(t) < 1e-9 THEN cos(a0) ELSE (sin(a0 + t) - sin(a0)) / t END)",
    "l * (CASE WHEN abs(i1 - i0) < 1e-9 THEN sin(i0) ELSE (cos(i0) - cos(i1)) / (i1 - i0) END)",
)


def _trace_sql(method: str) -> str:
    x, y, z = _STEP[method]
    return with_("st", "co") + f""", s AS (
  SELECT hole, depth, depth - coalesce(lag(depth) OVER w, 0) AS l, radians(azimuth) AS a1, radians(coalesce(lag(azimuth) OVER w, azimuth)) AS a0,
         radians(dip) AS i1, radians(coalesce(lag(dip) OVER w, dip)) AS i0,
         radians(azimuth - coalesce(lag(azimuth) OVER w, azimuth) + 180 - 360 * floor((azimuth - coalesce(lag(azimuth) OVER w, azimuth) + 180) / 360) - 180) AS t
  FROM st WINDOW w AS (PARTITION BY hole ORDER BY depth)
), f AS (SELECT *, CASE WHEN {_BEND} < 1e-9 THEN 1 ELSE 2 / {_BEND} * tan({_BEND} / 2) END AS rf FROM s),
m AS (SELECT hole, depth, {x} AS dx, {y} AS dy, {z} AS dz FROM f)
SELECT hole, depth, {r("x + sum(dx) OVER w", 3)} AS x, {r("y + sum(dy) OVER w", 3)} AS y, {r("z + sum(dz) OVER w", 3)} AS z
FROM m JOIN co USING (hole) WINDOW w AS (PARTITION BY hole ORDER BY depth ROWS UNBOUNDED PRECEDING)"""


def _trace(method: str):
    def run(spark, d):
        t = desurvey.traces(bind.stations(spark, d), bind.collars(spark, d), method)
        return t.select("hole", "depth", *(rounded(F.col(c), 3).alias(c) for c in "xyz"))

    run.__name__ = f"desurvey_{method}"
    return run


for _m in desurvey.METHODS:
    query(_trace_sql(_m))(_trace(_m))

_LEG = "WINDOW w AS (PARTITION BY hole ORDER BY depth)"
_AT = "((d0 <= p.depth AND (d1 IS NULL OR p.depth < d1)) OR (head AND p.depth < d0))"
_SHARE = "CASE WHEN d1 IS NULL OR p.depth < d0 THEN 0 ELSE (p.depth - d0) / (d1 - d0) END"


@query(with_("iv", "b25", "st") + f""", e AS (SELECT hole, depth AS d0, azimuth AS a0, dip AS i0, lead(depth) OVER w AS d1, lead(azimuth) OVER w AS a1, lead(dip) OVER w AS i1, row_number() OVER w = 1 AS head FROM st {_LEG}),
p AS (SELECT hole, from_ + 12.5 AS depth FROM b25),
q AS (SELECT p.hole, p.depth, {_SHARE} AS s, a0, i0, coalesce(i1, i0) AS i1, coalesce(a1, a0) - a0 + 180 AS v FROM p JOIN e ON p.hole = e.hole AND {_AT})
SELECT hole, depth, {r("u - 360 * floor(u / 360)", 3)} AS azimuth, {r("i0 + s * (i1 - i0)", 3)} AS dip FROM (SELECT *, a0 + s * (v - 360 * floor(v / 360) - 180) AS u FROM q)""")
def attitude_at_depth(spark, d):
    pts = bind.bins25(spark, d).select("hole", (F.col("from_") + 12.5).alias("depth"))
    out = desurvey.attitude_at(pts, bind.stations(spark, d))
    return out.select("hole", "depth", rounded(F.col("azimuth"), 3).alias("azimuth"), rounded(F.col("dip"), 3).alias("dip"))


@query(with_("iv", "b25", "st", "co") + f""", m AS (SELECT hole, depth, depth - coalesce(lag(depth) OVER w, 0) AS l, radians(azimuth) AS a, radians(dip) AS i FROM st {_LEG}),
t AS (SELECT m.hole, m.depth, x + sum(l * cos(i) * sin(a)) OVER w AS x, y + sum(l * cos(i) * cos(a)) OVER w AS y, z + sum(l * sin(i)) OVER w AS z FROM m JOIN co USING (hole) WINDOW w AS (PARTITION BY m.hole ORDER BY m.depth ROWS UNBOUNDED PRECEDING)),
e AS (SELECT hole, depth AS d0, x, y, z, lead(depth) OVER w AS d1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, row_number() OVER w = 1 AS head FROM t {_LEG}),
p AS (SELECT hole, from_ + 12.5 AS depth FROM b25)
SELECT hole, depth, {r("x + s * (coalesce(x1, x) - x)", 3)} AS x, {r("y + s * (coalesce(y1, y) - y)", 3)} AS y, {r("z + s * (coalesce(z1, z) - z)", 3)} AS z
FROM (SELECT p.hole, p.depth, {_SHARE} AS s, e.x, e.y, e.z, x1, y1, z1 FROM p JOIN e ON p.hole = e.hole AND {_AT})""")
def point_on_trace(spark, d):
    pts = bind.bins25(spark, d).select("hole", (F.col("from_") + 12.5).alias("depth"))
    trace = desurvey.traces(bind.stations(spark, d), bind.collars(spark, d), "tangential")
    out = desurvey.point_on_trace(pts, trace)
    return out.select("hole", "depth", *(rounded(F.col(c), 3).alias(c) for c in "xyz"))


# statistics

@query("""WITH o AS (SELECT l_returnflag AS code, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT code, v AS quantile FROM o WHERE i = floor((n - 1) * 0.9 + 0.5)""")
def quantile_nearest_rank(spark, d):
    rows = bind.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("code"), F.col("l_extendedprice").alias("v"))
    return stats.nearest_rank(rows, ["code"], "v", 0.9)


@query("""WITH o AS (SELECT l_returnflag AS code, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)
SELECT code, min(v) AS quantile FROM o WHERE c >= t * 0.75 GROUP BY code""")
def quantile_by_length(spark, d):
    rows = bind.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("code"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))
    return stats.length_percentile(rows, ["code"], "v", "w", 0.75)


@query(with_("iv") + f""", s AS (SELECT code, count(*) AS n, sum(to_ - from_) AS weight, sum((to_ - from_) * (to_ - from_)) AS w2, sum((to_ - from_) * value) AS s, sum((to_ - from_) * value * value) AS q, min(value) AS least, max(value) AS most FROM iv GROUP BY code),
v AS (SELECT *, s / weight AS mean, (q - s * s / weight) / (weight - w2 / weight) AS variance FROM s)
SELECT code, n, weight, least, most, {r("mean", 6)} AS mean, {r("variance", 6)} AS variance, {r("100 * sqrt(variance) / mean", 6)} AS cv FROM v""")
def weighted_summary(spark, d):
    iv = bind.intervals(spark, d).withColumn("len", F.col("to_") - F.col("from_"))
    out = stats.weighted_summary(iv, ["code"], "value", "len")
    return out.select("code", "n", "weight", "least", "most", *(rounded(F.col(c), 6).alias(c) for c in ("mean", "variance", "cv")))


@query(with_("iv") + f""" SELECT code, count(*) AS n, count(*) FILTER (WHERE value > 8) AS n_capped, sum(value * (to_ - from_)) AS metal, coalesce(sum((value - 8) * (to_ - from_)) FILTER (WHERE value > 8), 0) AS removed,
{r("100 * coalesce(sum((value - 8) * (to_ - from_)) FILTER (WHERE value > 8), 0) / sum(value * (to_ - from_))")} AS removed_pct FROM iv WHERE value > 0 GROUP BY code""")
def cap_audit(spark, d):
    iv = bind.intervals(spark, d).withColumn("len", F.col("to_") - F.col("from_"))
    return stats.cap_audit(iv, ["code"], "value", "len", 8.0).withColumn("removed_pct", rounded(F.col("removed_pct")))


@query(with_("iv") + f""", m AS (SELECT value * (to_ - from_) AS metal, row_number() OVER (ORDER BY value DESC, value * (to_ - from_) DESC) AS k FROM iv WHERE value > 0)
SELECT CAST(t.top AS BIGINT) AS top, sum(metal) FILTER (WHERE k <= t.top) AS metal, {r("sum(metal) FILTER (WHERE k <= t.top) / sum(metal)", 8)} AS share FROM m, (SELECT unnest([1, 2, 3, 5, 10, 20, 50, 100]) AS top) t GROUP BY t.top""")
def metal_at_risk(spark, d):
    iv = bind.intervals(spark, d).withColumn("len", F.col("to_") - F.col("from_"))
    return stats.top_metal(iv, "value", "len").withColumn("share", rounded(F.col("share"), 8))


@query(with_("iv") + f""", c AS (SELECT unnest([2.0::DOUBLE, 4, 6, 8, 10]) AS cutoff), x AS (SELECT value, to_ - from_ AS w FROM iv)
SELECT cutoff, count(*) FILTER (WHERE value >= cutoff) AS n_above, coalesce(sum(w) FILTER (WHERE value >= cutoff), 0) AS metres_above, coalesce(sum(w * value) FILTER (WHERE value >= cutoff), 0) AS metal_above,
{r("count(*) FILTER (WHERE value >= cutoff) / count(*)", 6)} AS n_share, {r("coalesce(sum(w) FILTER (WHERE value >= cutoff), 0) / sum(w)", 6)} AS metres_share, {r("coalesce(sum(w * value) FILTER (WHERE value >= cutoff), 0) / sum(w * value)", 6)} AS metal_share FROM x, c GROUP BY cutoff""")
def above_cutoffs(spark, d):
    iv = bind.intervals(spark, d).withColumn("len", F.col("to_") - F.col("from_"))
    out = stats.above_cutoffs(iv, "value", "len", [2, 4, 6, 8, 10])
    return out.select("cutoff", "n_above", "metres_above", "metal_above", *(rounded(F.col(c), 6).alias(c) for c in ("n_share", "metres_share", "metal_share")))


@query(with_("rd") + f""", m AS (SELECT code, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM rd GROUP BY code)
SELECT code, any_value(n) AS n, {r("any_value(mean)")} AS mean, {r("any_value(sd)")} AS sd, count(*) FILTER (WHERE abs(value - mean) > 2 * sd) AS beyond_2sd, count(*) FILTER (WHERE abs(value - mean) > 3 * sd) AS beyond_3sd FROM rd JOIN m USING (code) GROUP BY code""")
def control_limits(spark, d):
    out = stats.control_limits(bind.readings(spark, d), ["code"], "value")
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean", "sd")})


@query(with_("rd") + f" SELECT code, count(*) AS n, {r('avg(value)')} AS mean, " + ", ".join(f"{r(f'quantile_cont(value, {p})')} AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"))) + " FROM rd WHERE value IS NOT NULL GROUP BY code HAVING count(*) >= 3")
def box_by_code(spark, d):
    out = stats.box_by_code(bind.readings(spark, d), "code", "value")
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean", "p25", "p50", "p75", "p90")})


@query(with_("rd") + f""", z AS (SELECT code, count(*) FILTER (WHERE value <= 0) AS n_zero, count(*) FILTER (WHERE value > 0) AS n, median(value) FILTER (WHERE value > 0) AS med,
quantile_cont(log10(CASE WHEN value > 0 THEN value END), 0.25) AS q1, quantile_cont(log10(CASE WHEN value > 0 THEN value END), 0.75) AS q3, avg(log10(CASE WHEN value > 0 THEN value END)) AS lm, stddev_samp(log10(CASE WHEN value > 0 THEN value END)) AS ls FROM rd GROUP BY code)
SELECT code, any_value(n) AS n, any_value(n_zero) AS n_zero, {r("any_value(med)")} AS median, {r("1.4826 * median(abs(value - med))")} AS mad, {r("any_value(lm)")} AS log_mean, {r("any_value(ls)")} AS log_sd, {r("pow(10, any_value(q3) + 1.5 * (any_value(q3) - any_value(q1)))", 2)} AS tukey_fence
FROM rd JOIN z USING (code) WHERE value > 0 GROUP BY code""")
def population_summary(spark, d):
    out = stats.population_summary(bind.readings(spark, d), ["code"], "value")
    return out.withColumns({c: rounded(F.col(c)) for c in ("median", "mad", "log_mean", "log_sd")} | {"tukey_fence": rounded(F.col("tukey_fence"), 2)})


@query(f"SELECT l_returnflag AS code, count(*) AS n, {r('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem GROUP BY 1")
def correlation_pearson(spark, d):
    rows = bind.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "code")
    return stats.pearson(rows, "l_quantity", "l_extendedprice", ["code"]).withColumn("r", rounded(F.col("r")))


@query(f"""WITH q AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (
SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM q)
SELECT count(*) AS n, {r('corr(rx, ry)')} AS r FROM k""")
def correlation_spearman(spark, d):
    return stats.spearman(bind.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", rounded(F.col("r")))


@query(f"SELECT l_returnflag AS code, count(*) AS n, {r('regr_slope(l_extendedprice, l_quantity)', 2)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept, {r('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY 1")
def line_fit(spark, d):
    out = stats.line_fit(bind.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "code"), "l_quantity", "l_extendedprice", ["code"])
    return out.select("code", "n", rounded(F.col("slope"), 2).alias("slope"), rounded(F.col("intercept"), 2).alias("intercept"), rounded(F.col("r2")).alias("r2"))


@query(with_("iv") + f""", w AS (SELECT code, value, sum(to_ - from_) AS w FROM iv GROUP BY code, value)
SELECT code, value, {r("(sum(w) OVER (PARTITION BY code ORDER BY value) - w / 2) / sum(w) OVER (PARTITION BY code)", 6)} AS position FROM w""")
def probability_points(spark, d):
    iv = bind.intervals(spark, d).withColumn("len", F.col("to_") - F.col("from_"))
    return stats.probability_points(iv, ["code"], "value", "len").withColumn("position", rounded(F.col("position"), 6))


@query(f"SELECT CAST(k AS INTEGER) AS class, {r('list_extract(q, k)', 3)} AS upper FROM (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM lineitem), (SELECT unnest([1, 2, 3, 4, 5]) AS k)")
def class_breaks(spark, d):
    return stats.class_breaks(bind.table(spark, d, "lineitem"), "l_extendedprice", 5).withColumn("upper", rounded(F.col("upper"), 3))


@query(f"""WITH k AS (SELECT l_linestatus = 'O' AS pos, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rk FROM lineitem)
SELECT n_pos, n_neg, {r("(s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg)", 6)} AS auc FROM (SELECT count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(rk) FILTER (WHERE pos) AS s FROM k)""")
def roc_auc(spark, d):
    rows = bind.table(spark, d, "lineitem").withColumn("label", F.when(F.col("l_linestatus") == "O", 1).otherwise(0))
    return stats.auc(rows, "l_extendedprice", "label").withColumn("auc", rounded(F.col("auc"), 6))


# points

_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(with_("pt") + f" SELECT a.id AS a_id, b.id AS b_id, {_D2} AS d2 FROM pt a JOIN pt b ON a.id < b.id AND {_D2} <= 6400")
def pairs_within(spark, d):
    pts = bind.points(spark, d)
    return spatial.within(pts, pts, 80.0).where("a.id < b.id").select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "d2")


@query(with_("pt") + f" SELECT a.id AS id, b.id AS near_id, {_D2} AS d2, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS INTEGER) AS rank FROM pt a JOIN pt b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) <= 3")
def k_nearest_points(spark, d):
    pts = bind.points(spark, d)
    out = spatial.k_nearest(pts, pts, "id", 3, 40.0, other="id")
    return out.select(F.col("a.id").alias("id"), F.col("b.id").alias("near_id"), "d2", "rank")


@query(with_("pt", recursive=True) + f""", e AS (SELECT a.id AS u, b.id AS v FROM pt a JOIN pt b ON {_D2} <= 4900), c AS (SELECT id AS u, id AS v FROM pt UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u)
SELECT u AS id, min(v) AS cluster FROM c GROUP BY u""")
def point_clusters(spark, d):
    bind.shared_path(spark, "")  # a checkpoint folder is set from here on
    return spatial.clusters(bind.points(spark, d).drop("zone"), "id", 70.0)


_RING = [(100.0, 100.0), (900.0, 200.0), (700.0, 900.0), (150.0, 800.0)]
_HOLE = [(400.0, 400.0), (600.0, 400.0), (600.0, 600.0), (400.0, 600.0)]


def _inside_sql() -> str:
    parts = []
    for ring in (_RING, _HOLE):
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if y1 != y2:
                parts.append(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2 - x1}) * (y - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END")
    return f"({' + '.join(parts)}) % 2 = 1"


@query(with_("pt") + f" SELECT id, {_inside_sql()} AS inside FROM pt")
def points_in_polygon(spark, d):
    return bind.points(spark, d).select("id", spatial.in_polygon(F.col("x"), F.col("y"), [_RING, _HOLE]).alias("inside"))


@query(with_("pt") + f" SELECT a.id, {r(f'1e6 * coalesce(sum((1 - {_D2} / 22500) * (1 - {_D2} / 22500)), 0) * 3 / (pi() * 22500)')} AS density FROM pt a JOIN pt b ON {_D2} <= 22500 GROUP BY a.id")
def kernel_density(spark, d):
    pts = bind.points(spark, d)
    return spatial.kernel_density(pts, pts, "id", 150.0).select("id", rounded(F.col("density") * 1e6).alias("density"))


@query(with_("pt") + f""", p AS (SELECT sqrt({_D2}) AS h, (a.value - b.value) * (a.value - b.value) AS sq FROM pt a JOIN pt b ON a.id < b.id AND {_D2} <= 72900)
SELECT CAST(floor(h / 60 + 0.5) AS INTEGER) AS bin, count(*) AS pairs, {r("avg(h)")} AS h, {r("sum(sq) / (2 * count(*))", 2)} AS gamma FROM p WHERE floor(h / 60 + 0.5) BETWEEN 1 AND 4 GROUP BY 1""")
def experimental_variogram(spark, d):
    out = geostat.variogram(bind.points(spark, d), "id", "value", 60.0, 4)
    return out.select("bin", "pairs", rounded(F.col("h")).alias("h"), rounded(F.col("gamma"), 2).alias("gamma"))


@query(with_("pt", "bl") + f""", t AS (SELECT id, x * 5 AS x, y * 5 AS y FROM bl), p AS (SELECT a.id, b.value, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS k FROM t a JOIN pt b ON {_D2} <= 40000)
SELECT id, count(*) AS n, {r("CASE WHEN min(d2) < 1e-6 THEN arg_min(value, k) ELSE sum(value / d2) FILTER (WHERE d2 >= 1e-6) / sum(1 / d2) FILTER (WHERE d2 >= 1e-6) END", 2)} AS estimate FROM p WHERE k <= 12 GROUP BY id""")
def inverse_distance(spark, d):
    targets = bind.blocks(spark, d).select("id", (F.col("x") * 5).alias("x"), (F.col("y") * 5).alias("y"))
    out = geostat.idw(targets, bind.points(spark, d), "id", "id", "value", 200.0)
    return out.withColumn("estimate", rounded(F.col("estimate"), 2))


@query(with_("pt", "bl") + f""", t AS (SELECT id, x * 5 AS x, y * 5 AS y FROM bl) SELECT a.id, arg_min(b.value, ({_D2}, b.id)) AS estimate FROM t a JOIN pt b ON {_D2} <= 40000 GROUP BY a.id""")
def nearest_estimate(spark, d):
    targets = bind.blocks(spark, d).select("id", (F.col("x") * 5).alias("x"), (F.col("y") * 5).alias("y"))
    return geostat.nearest_value(targets, bind.points(spark, d), "id", "id", "value", 200.0)


@query(with_("bl") + f""", c AS (SELECT unnest([900.0::DOUBLE, 1000, 1100, 1500]) AS cutoff) SELECT cutoff, count(*) FILTER (WHERE value >= cutoff) AS blocks, coalesce(sum(volume) FILTER (WHERE value >= cutoff), 0) AS volume, coalesce(sum(volume * density) FILTER (WHERE value >= cutoff), 0) AS tonnes,
coalesce(sum(volume * density * value) FILTER (WHERE value >= cutoff), 0) AS metal, {r("sum(volume * density * value) FILTER (WHERE value >= cutoff) / sum(volume * density) FILTER (WHERE value >= cutoff)")} AS grade FROM bl, c GROUP BY cutoff""")
def grade_tonnage(spark, d):
    out = geostat.grade_tonnage(bind.blocks(spark, d), "value", [900, 1000, 1100, 1500], "volume", "density")
    return out.withColumn("grade", rounded(F.col("grade")))


@query(with_("bl") + f""", b AS (SELECT *, unnest(range(CAST(floor((z - 3.5) / 5) AS BIGINT), CAST(ceil((z + 3.5) / 5) AS BIGINT))) AS bench FROM bl WHERE value >= 950),
s AS (SELECT *, greatest(0, least(z + 3.5, (bench + 1) * 5) - greatest(z - 3.5, bench * 5)) / 7 * volume AS v FROM b)
SELECT bench, count(*) AS blocks, {r("sum(v)")} AS volume, {r("sum(v * value)", 2)} AS metal FROM s WHERE v > 0 GROUP BY bench""")
def tonnage_by_bench(spark, d):
    out = geostat.by_bench(bind.blocks(spark, d), "value", 950.0, 5.0)
    return out.select("bench", "blocks", rounded(F.col("volume")).alias("volume"), rounded(F.col("metal"), 2).alias("metal"))


@query(with_("pt", "bl") + f""", b AS (SELECT floor(x / 50) AS slice, count(*) AS blocks, avg(value) AS bm FROM bl GROUP BY 1), s AS (SELECT floor(x / 50) AS slice, count(*) AS samples, sum(value * (zone + 1)) / sum(zone + 1) AS sm FROM pt GROUP BY 1)
SELECT CAST(slice AS BIGINT) AS slice, blocks, {r("bm")} AS block_mean, samples, {r("sm")} AS sample_mean FROM b FULL JOIN s USING (slice)""")
def swath_plot(spark, d):
    out = geostat.swath(bind.blocks(spark, d), bind.points(spark, d).withColumn("w", F.col("zone") + 1), "x", 50.0, "value", "w")
    return out.select("slice", "blocks", rounded(F.col("block_mean")).alias("block_mean"), "samples", rounded(F.col("sample_mean")).alias("sample_mean"))


# grids

_DIRS = "d(k, di, dj) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1))"
_FLOW = """f AS (SELECT g.i, g.j, coalesce(arg_max(k, (s, -k)) FILTER (WHERE s > 0), -1) AS direction FROM gr g
LEFT JOIN LATERAL (SELECT k, (g.z - n.z) / CASE WHEN k % 2 = 1 THEN sqrt(2) ELSE 1 END AS s FROM d JOIN gr n ON n.i = g.i + di AND n.j = g.j + dj) x ON true GROUP BY g.i, g.j)"""


@query(with_("gr") + f", {_DIRS}, {_FLOW} SELECT i, j, direction FROM f")
def flow_directions(spark, d):
    return grids.flow_directions(bind.terrain(spark, d))


@query(with_("gr", recursive=True) + f""", {_DIRS}, {_FLOW}, w AS (SELECT i, j, i AS ti, j AS tj FROM f UNION ALL SELECT w.i, w.j, w.ti + di, w.tj + dj FROM w JOIN f ON f.i = w.ti AND f.j = w.tj JOIN d ON d.k = f.direction)
SELECT ti AS i, tj AS j, count(*) AS cells FROM w GROUP BY 1, 2""")
def flow_accumulation(spark, d):
    return catchments.flow_accumulation(grids.flow_directions(bind.terrain(spark, d)))


_SITES = """st AS (SELECT p_partkey AS site, CAST(p_partkey % 40 AS INTEGER) AS i, CAST(p_partkey // 40 AS INTEGER) AS j FROM part WHERE p_size % 12 = 0),
lab AS (SELECT i, j, arg_min(site, n) AS site FROM (SELECT w.i, w.j, w.n, st.site FROM w JOIN st ON st.i = w.ti AND st.j = w.tj) GROUP BY i, j)"""
_WALK = "w AS (SELECT i, j, i AS ti, j AS tj, 0 AS n FROM f UNION ALL SELECT w.i, w.j, w.ti + di, w.tj + dj, n + 1 FROM w JOIN f ON f.i = w.ti AND f.j = w.tj JOIN d ON d.k = f.direction)"


def _sites(spark, d):
    k = F.col("p_partkey")
    node = F.struct((k % 40).cast("long").alias("i"), F.floor(k / 40).alias("j"))
    return bind.table(spark, d, "part").where("p_size % 12 = 0").select(k.alias("site"), node.alias("node"))


@query(with_("gr", recursive=True) + f", {_DIRS}, {_FLOW}, {_WALK}, {_SITES} SELECT f.i, f.j, lab.site FROM f LEFT JOIN lab ON lab.i = f.i AND lab.j = f.j")
def sub_catchments(spark, d):
    """The first of the sites (parts of some sizes) that each cell drains to."""
    edges = catchments.downstream(grids.flow_directions(bind.terrain(spark, d)))
    return catchments.first_site(edges, _sites(spark, d)).select(F.col("node.i").cast("int").alias("i"), F.col("node.j").cast("int").alias("j"), "site")


@query(with_("gr", recursive=True) + f""", {_DIRS}, {_FLOW}, {_WALK}, {_SITES}, own AS (SELECT site, count(*) AS own FROM lab WHERE site IS NOT NULL GROUP BY site),
whole AS (SELECT st.site, count(*) AS total FROM w JOIN st ON st.i = w.ti AND st.j = w.tj GROUP BY st.site)
SELECT st.site, lab.site AS down, own.own, whole.total FROM st JOIN own ON own.site = st.site JOIN whole ON whole.site = st.site LEFT JOIN (f JOIN d ON d.k = f.direction) ON f.i = st.i AND f.j = st.j LEFT JOIN lab ON lab.i = f.i + di AND lab.j = f.j + dj""")
def site_tree(spark, d):
    edges = staged(catchments.downstream(grids.flow_directions(bind.terrain(spark, d))), "edges")
    sites = _sites(spark, d)
    return catchments.site_tree(edges, sites, catchments.first_site(edges, sites))


@query(with_("gr", recursive=True) + f""", {_DIRS}, {_FLOW}, {_WALK}, acc AS (SELECT ti AS i, tj AS j, count(*) AS cells FROM w GROUP BY 1, 2), s AS (SELECT p_partkey AS site, p_partkey % 40 + p_size * 0.01::DOUBLE AS x, p_partkey // 40 - p_size * 0.013::DOUBLE AS y FROM part WHERE p_size % 12 = 0),
m AS (SELECT s.site, acc.i, acc.j, acc.cells, sqrt((acc.i - x) * (acc.i - x) + (acc.j - y) * (acc.j - y)) AS moved, row_number() OVER (PARTITION BY site ORDER BY cells DESC, CASE WHEN acc.i = floor(x + 0.5) AND acc.j = floor(y + 0.5) THEN 0 ELSE 1 END, acc.j, acc.i) AS n
FROM s JOIN acc ON sqrt((acc.i - floor(x + 0.5)) * (acc.i - floor(x + 0.5)) + (acc.j - floor(y + 0.5)) * (acc.j - floor(y + 0.5))) <= 3 WHERE EXISTS (FROM f WHERE f.i = floor(x + 0.5) AND f.j = floor(y + 0.5)))
SELECT site, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, cells, floor(moved * 1e6 + 0.5) / 1e6 AS moved FROM m WHERE n = 1""")
def snapped_sites(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    sites = bind.table(spark, d, "part").where("p_size % 12 = 0").select(k.alias("site"), (k % 40 + s * 0.01).alias("x"), (F.floor(k / 40) - s * 0.013).alias("y"))
    acc = catchments.flow_accumulation(grids.flow_directions(bind.terrain(spark, d)))
    return catchments.snap_sites(sites, acc, 3.0).withColumn("moved", rounded(F.col("moved"), 6))


_N = lambda di, dj: f"coalesce((SELECT z FROM gr n WHERE n.i = g.i + {di} AND n.j = g.j + {dj}), g.z)"


@query(with_("gr") + f""", s AS (SELECT i, j, (({_N(1, -1)} + 2 * {_N(1, 0)} + {_N(1, 1)}) - ({_N(-1, -1)} + 2 * {_N(-1, 0)} + {_N(-1, 1)})) / 800 AS gx, (({_N(-1, 1)} + 2 * {_N(0, 1)} + {_N(1, 1)}) - ({_N(-1, -1)} + 2 * {_N(0, -1)} + {_N(1, -1)})) / 800 AS gy FROM gr g)
SELECT i, j, {r("greatest(0, (sin(radians(45)) - cos(radians(45)) * (gx * sin(radians(315)) - gy * cos(radians(315)))) / sqrt(1 + gx * gx + gy * gy))")} AS shade, {r("degrees(atan(sqrt(gx * gx + gy * gy)))")} AS slope FROM s""")
def hillshade(spark, d):
    out = grids.hillshade(bind.terrain(spark, d), size=100.0)
    return out.select("i", "j", rounded(F.col("shade")).alias("shade"), rounded(F.col("slope")).alias("slope"))


@query(with_("gr") + f""", m AS (SELECT i, j, greatest(0, least(1, (z - 1000) / 8000)) AS a, greatest(0, least(1, (size - 40) / -35)) AS b FROM gr)
SELECT i, j, {r("least(a, b)", 6)} AS f_and, {r("greatest(a, b)", 6)} AS f_or, {r("1 - (1 - a) * (1 - b)", 6)} AS f_sum, {r("pow(1 - (1 - a) * (1 - b), 0.7) * pow(a * b, 0.3)", 6)} AS f_gamma FROM m""")
def fuzzy_overlay(spark, d):
    t = bind.terrain(spark, d)
    m = [grids.membership(F.col("z"), 1000, 9000), grids.membership(F.col("size"), 40, 5)]
    return t.select("i", "j", *(rounded(grids.fuzzy_overlay(m, k), 6).alias(f"f_{k}") for k in ("and", "or", "sum", "gamma")))


@query(with_("gr") + f""", c AS (SELECT z > 6000 AS p, size > 30 AS d FROM gr), t AS (SELECT greatest(count(*) FILTER (WHERE p AND d)::DOUBLE, 0.5) AS pd, greatest(count(*) FILTER (WHERE p AND NOT d)::DOUBLE, 0.5) AS pn, greatest(count(*) FILTER (WHERE NOT p AND d)::DOUBLE, 0.5) AS ad, greatest(count(*) FILTER (WHERE NOT p AND NOT d)::DOUBLE, 0.5) AS an FROM c),
w AS (SELECT *, ln((pd / (pd + ad)) / (pn / (pn + an))) AS wp, ln((ad / (pd + ad)) / (an / (pn + an))) AS wm FROM t)
SELECT {r("wp", 6)} AS w_plus, {r("wm", 6)} AS w_minus, {r("wp - wm", 6)} AS contrast, {r("(wp - wm) / sqrt(1 / pd + 1 / pn + 1 / ad + 1 / an)", 6)} AS studentized FROM w""")
def weights_of_evidence(spark, d):
    c = bind.terrain(spark, d).select(F.when(F.col("z") > 6000, 1).otherwise(0).alias("p"), F.when(F.col("size") > 30, 1).otherwise(0).alias("d"))
    out = grids.weights_of_evidence(c, "p", "d")
    return out.select(*(rounded(F.col(x), 6).alias(x) for x in out.columns))


@query(with_("gr") + f" SELECT zone, count(*) AS n, {r('avg(z)')} AS mean, min(z) AS least, max(z) AS most, {r('quantile_cont(z, 0.1)')} AS p10, {r('quantile_cont(z, 0.5)')} AS p50, {r('quantile_cont(z, 0.9)')} AS p90, count(*) * 25.0::DOUBLE AS area FROM gr GROUP BY zone")
def zonal_stats(spark, d):
    out = grids.zonal_stats(bind.terrain(spark, d), "zone", "z", 25.0)
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean", "p10", "p50", "p90")})


# many elements

@query(f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS k FROM embeddings), c AS (SELECT vec_id, k, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM e)
SELECT vec_id, {r("sum(c * c)", 5)} AS norm2, {r("sum(c) FILTER (WHERE k = 1)", 5)} AS first FROM c GROUP BY vec_id""")
def centred_log_ratio(spark, d):
    parts = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.exp(v))
    out = bind.table(spark, d, "embeddings").select("vec_id", multivar.clr(parts).alias("c"))
    return out.select("vec_id", rounded(F.aggregate("c", F.lit(0.0), lambda a, v: a + v * v), 5).alias("norm2"), rounded(F.get("c", 0), 5).alias("first"))


@query(f"""WITH m AS (SELECT label, k, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS k FROM embeddings) GROUP BY label, k), r AS (SELECT label, list(m ORDER BY k) AS ref FROM m GROUP BY label)
SELECT vec_id, {r("acos(greatest(-1, least(1, list_dot_product(embedding::DOUBLE[], ref) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(ref, ref)))))")} AS angle FROM embeddings JOIN r USING (label)""")
def spectral_angles(spark, d):
    e = bind.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("ref"))
    out = e.join(means.select("label", F.col("ref.m").alias("ref")), "label")
    return out.select("vec_id", rounded(multivar.spectral_angle(F.col("v"), F.col("ref"))).alias("angle"))


@query()
def principal_components(spark, d):
    e = bind.table(spark, d, "embeddings")
    _, axes, mean = multivar.principal_components(e, "embedding", 64, 3)
    return multivar.project(e.select("vec_id", "embedding"), "embedding", axes, mean, "scores").select("vec_id", "scores")


@query()
def sample_clusters(spark, d):
    return multivar.k_means(bind.table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 10).select("vec_id", "cluster")


# quality

@query(with_("iv", "ov") + """, o AS (SELECT hole, from_, to_, CASE WHEN value > 0 THEN value END AS value FROM ov), e AS (SELECT hole, max(to_) - 5 AS length FROM iv WHERE hole % 7 <> 0 GROUP BY hole),
j AS (SELECT o.*, e.length, max(to_) OVER b AS reach, lag(from_) OVER w AS pf, lag(to_) OVER w AS pt FROM o LEFT JOIN e USING (hole) WINDOW w AS (PARTITION BY o.hole ORDER BY from_, to_), b AS (PARTITION BY o.hole ORDER BY from_, to_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT hole, from_, to_, unnest([
  CASE WHEN to_ > length + 1e-6 THEN 'warning/beyond end of hole' END, CASE WHEN length IS NULL THEN 'error/no collar' END, CASE WHEN value IS NULL THEN 'info/no value' END,
  CASE WHEN reach > from_ + 1e-6 AND NOT coalesce(from_ = pf AND to_ = pt, false) THEN 'warning/overlap' END, CASE WHEN from_ = pf AND to_ = pt THEN 'warning/duplicate interval' END,
  CASE WHEN reach < from_ - 1e-6 THEN 'info/gap' END, CASE WHEN value > 9 THEN 'warning/value above range' END]) AS x FROM j)
SELECT split_part(x, '/', 1) AS severity, 'Intervals' AS category, split_part(x, '/', 2) AS rule, hole, from_, to_ FROM i WHERE x IS NOT NULL""")
def interval_issues(spark, d):
    iv = bind.intervals(spark, d)
    rows = bind.overlapping(spark, d).withColumn("value", F.when(F.col("value") > 0, F.col("value")))
    ends = iv.where("hole % 7 <> 0").groupBy("hole").agg((F.max("to_") - 5).alias("length"))
    return quality.interval_issues(rows, ends, most=9.0)


@query(with_("st", "iv") + f""", e AS (SELECT hole, max(to_) AS length FROM iv GROUP BY hole), j AS (SELECT *, depth - lag(depth) OVER w AS step, lag(depth) OVER w AS d0, radians(lag(dip) OVER w) AS i0, radians(dip) AS i1, radians(azimuth - lag(azimuth) OVER w) AS t FROM st JOIN e USING (hole) WINDOW w AS (PARTITION BY hole ORDER BY depth)),
k AS (SELECT *, degrees(acos(greatest(-1, least(1, sin(i0) * sin(i1) + cos(i0) * cos(i1) * cos(t))))) AS bend FROM j)
SELECT CASE WHEN bend * 30 / step >= 20 AND bend >= 5 THEN 'error' ELSE 'warning' END AS severity, 'Survey' AS category, 'dogleg' AS rule, hole, d0 AS from_, depth AS to_ FROM k WHERE step >= 10 AND bend >= 2 AND bend * 30 / step >= 3""")
def survey_issues(spark, d):
    ends = bind.intervals(spark, d).groupBy("hole").agg(F.max("to_").alias("length"))
    return quality.survey_issues(bind.stations(spark, d), ends)


@query(with_("rd") + f""", s AS (SELECT hole, code, event_id, value, first_value(value) OVER w AS v1, row_number() OVER w AS n FROM rd WINDOW w AS (PARTITION BY hole, floor(depth / 1440), code ORDER BY event_id)),
p AS (SELECT code, abs(v1 - value) / ((v1 + value) / 2) * 100 AS rpd FROM s WHERE n > 1 AND value <> v1)
SELECT code, count(*) AS n, count(*) FILTER (WHERE rpd <= 30) AS n_within, {r("avg(rpd)")} AS mean_rpd FROM p GROUP BY code""")
def duplicate_rpd(spark, d):
    rd = bind.readings(spark, d).withColumn("day", F.floor(F.col("depth") / 1440))
    pairs = quality.duplicate_pairs(rd, ["hole", "day", "code"], "event_id", "value", 30.0)
    return quality.duplicate_summary(pairs, ["code"]).withColumn("mean_rpd", rounded(F.col("mean_rpd")))


@query(with_("rd") + " SELECT code, count(*) AS n, count(*) FILTER (WHERE value > 60) AS n_failed, max(value) AS most FROM rd GROUP BY code")
def blank_failures(spark, d):
    return quality.blank_failures(bind.readings(spark, d), ["code"], "value", 60.0)


# tables

@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size BETWEEN 6 AND 20 AND lower(p_name) LIKE '%ring%' AND lower(p_brand) NOT LIKE '%brand#1%' ")
def column_filters(spark, d):
    t = bind.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return assay.filter_table(t, {"p_size": "6..20", "p_name": "ring", "p_brand": "!Brand#1"}, order="p_partkey")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '<' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN l_tax = 0 THEN '>' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN l_linenumber = 3 THEN '-999' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS c FROM lineitem)
SELECT coalesce(CASE WHEN c[1] IN ('<', '>') THEN c[1] END, '') AS mark, count(*) AS n, count(CASE WHEN c = '-999' THEN NULL ELSE 1 END) AS n_value, sum(CASE WHEN c = '-999' THEN NULL WHEN c[1] = '<' THEN CAST(c[2:] AS DOUBLE) / 2 WHEN c[1] = '>' THEN CAST(c[2:] AS DOUBLE) ELSE CAST(c AS DOUBLE) END) AS total FROM t GROUP BY 1""")
def censored_cells(spark, d):
    q = F.col("l_quantity").cast("int").cast("string")
    cell = F.when(F.col("l_discount") == 0, F.concat(F.lit("<"), q)).when(F.col("l_tax") == 0, F.concat(F.lit(">"), q)).when(F.col("l_linenumber") == 3, "-999").otherwise(q)
    t = bind.table(spark, d, "lineitem").select(assay.censored(cell).alias("c"))
    return t.groupBy(F.coalesce("c.q", F.lit("")).alias("mark")).agg(F.count("*").alias("n"), F.count("c.v").alias("n_value"), F.sum("c.v").alias("total"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('l_discount + coalesce(l_tax, 0) * (50 * 0.8) / (1200 * 0.9)', 6)} AS equivalent FROM lineitem")
def metal_equivalent(spark, d):
    e = assay.metal_equivalent({"Au": F.col("l_discount"), "Ag": F.col("l_tax")}, {"Au": 1200, "Ag": 50}, {"Au": 0.9, "Ag": 0.8}, "Au")
    return bind.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(e, 6).alias("equivalent"))


@query(with_("rd") + " SELECT hole, " + ", ".join(f"arg_min(value, event_id) FILTER (WHERE code = '{c}') AS {c}" for c in ("click", "error", "purchase")) + " FROM rd GROUP BY hole")
def long_to_wide(spark, d):
    return assay.pivot_long(bind.readings(spark, d), ["hole"], "code", "value", "event_id", ["click", "error", "purchase"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_rows(spark, d):
    o = bind.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return assay.upsert(o, o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


# the SQL workspace: tables are views, any Spark SQL runs over them

def _workspace(sql: str):
    def run(spark, d):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            bind.table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


WORKSPACE = {
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_top_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k <= 2",
    "sql_semi_anti": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "sql_set_operations": "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "sql_star_join": "SELECT r.r_name, n.n_name, count(*) AS n, CAST(sum(l.l_quantity) AS DOUBLE) AS quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, n.n_name HAVING count(*) > 10",
    "sql_running_window": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS top5, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events",
}
for _name, _sql in WORKSPACE.items():
    _f = _workspace(_sql)
    _f.__name__ = _name
    query(_sql)(_f)


# sources and streams

@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")
def delimited_round_trip(spark, d):
    """Orders as delimited text in the shared folder, read back with types, a projection and a filter."""
    from lodestone.sources import tables

    path = bind.shared_path(spark, "orders-csv")
    tables.write_delimited(bind.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    back = tables.read_delimited(spark, path, keep=["o_orderkey", "o_orderstatus", "o_totalprice"], numeric=["o_totalprice"])
    return back.where("o_totalprice > 100000").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def stream_binned(spark, d):
    """Events as a stream of files, in hourly windows, up to what is there now."""
    from lodestone.streaming import logs

    source, out, mark = (bind.shared_path(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    bind.table(spark, d, "events").select("ts", "event_type", "value").write.parquet(source)
    stream = logs.read_growing(spark, source, "ts timestamp, event_type string, value double")
    logs.run_to_end(logs.binned(stream, "ts", ["event_type"], "value"), out, mark)
    return spark.read.parquet(out).withColumn("total", rounded(F.col("total"), 2))


# joins and directions

from lodestone.operators import joins, orientation  # noqa: E402


@query(with_("bl") + f" SELECT a.id, a.value, b.density, {r('a.value * b.density')} AS product FROM bl a JOIN bl b ON a.x = b.x AND a.y = b.y AND a.z = b.z WHERE b.id % 3 <> 0")
def lattice_join(spark, d):
    a = bind.blocks(spark, d)
    moved = a.where("id % 3 <> 0").withColumns({c: F.col(c) + 1e-5 for c in "xyz"})
    out = joins.lattice_join(a.select("id", "value", "x", "y", "z"), moved, ["density"])
    return out.select("id", "value", "density", rounded(F.col("value") * F.col("density")).alias("product"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT c_custkey, c_nationkey, o_orderstatus, o_orderkey AS first_order FROM customer LEFT JOIN l ON o_custkey = c_custkey AND k = 1""")
def join_by_sample_id(spark, d):
    lab = bind.table(spark, d, "orders").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0 ")).alias("lab_id"), "o_orderstatus", F.col("o_orderkey").alias("first_order"), F.col("o_orderkey").alias("row"))
    field = bind.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return joins.join_by_id(field, lab, "c_custkey", "lab_id", "row")


@query(with_("rd") + f""", b AS (SELECT hole, depth AS t, max(value) AS v FROM rd WHERE hole < 3 GROUP BY hole, depth), m AS (SELECT hole, median(v) AS m FROM b GROUP BY hole),
q AS (SELECT event_id, depth, value FROM rd WHERE hole >= 3), j AS (SELECT q.*, b0.hole, b0.t AS t0, b0.v AS v0, b1.t AS t1, b1.v AS v1 FROM (SELECT q.*, m.hole FROM q, m) q ASOF LEFT JOIN b b0 ON b0.hole = q.hole AND b0.t <= q.depth ASOF LEFT JOIN b b1 ON b1.hole = q.hole AND b1.t >= q.depth),
k AS (SELECT event_id, depth, value, avg(CASE WHEN depth = t0 THEN v0 WHEN t1 - t0 <= 1440 THEN v0 + (v1 - v0) * (depth - t0) / (t1 - t0) END - m) AS drift FROM j JOIN m USING (hole) GROUP BY 1, 2, 3)
SELECT event_id, depth, value, {r("drift")} AS drift, {r("value - drift")} AS corrected FROM k""")
def diurnal_correction(spark, d):
    rd = bind.readings(spark, d)
    base = rd.where("hole < 3").groupBy("hole", "depth").agg(F.max("value").alias("value"))
    out = joins.diurnal_correct(rd.where("hole >= 3").select("event_id", "depth", "value"), base, "depth", "value", "hole", 1440.0)
    return out.select("event_id", "depth", "value", rounded(F.col("drift")).alias("drift"), rounded(F.col("corrected")).alias("corrected"))


_NAMES = ["Economy ", "STANDART", "promo", "larg", "Smal-l"]


@query("""WITH t AS (SELECT DISTINCT p_type FROM part), n AS (SELECT unnest(['Economy ', 'STANDART', 'promo', 'larg', 'Smal-l']) AS name),
e AS (SELECT p_type, name, levenshtein(regexp_replace(lower(p_type), '[\\s_\\-]+', '', 'g'), regexp_replace(lower(name), '[\\s_\\-]+', '', 'g')) AS edits FROM t, n)
SELECT p_type, CASE WHEN min(edits) <= 2 THEN arg_min(name, (edits, name)) END AS name, CAST(min(edits) AS INTEGER) AS edits FROM e GROUP BY p_type""")
def harmonised_codes(spark, d):
    return joins.harmonise(bind.table(spark, d, "part"), "p_type", _NAMES)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} > 0 AND {b} > 0) AS n, {r(f'corr(log10(CASE WHEN {a} > 0 AND {b} > 0 THEN {a} END), log10(CASE WHEN {a} > 0 AND {b} > 0 THEN {b} END))')} AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))))
def correlation_matrix_log(spark, d):
    return joins.pair_matrix(bind.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], log=True).withColumn("r", rounded(F.col("r")))


@query(with_("st") + f""", v AS (SELECT hole % 20 AS g, -sin(radians(-dip)) * sin(radians(azimuth)) AS x, -sin(radians(-dip)) * cos(radians(azimuth)) AS y, -cos(radians(-dip)) AS z FROM st),
s AS (SELECT g, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM v GROUP BY g), q AS (SELECT *, sqrt(x * x + y * y + z * z) AS l, degrees(atan2(x, y)) AS a FROM s)
SELECT g, n, {r("l", 3)} AS resultant, {r("a - 360 * floor(a / 360)", 2)} AS azimuth, {r("degrees(asin(-z / l))", 3)} AS plunge, {r("(n - 1) / (n - l)")} AS kappa FROM q""")
def fisher_statistics(spark, d):
    x, y, z = orientation.pole(-F.col("dip"), F.col("azimuth"))
    rows = bind.stations(spark, d).select((F.col("hole") % 20).alias("g"), x.alias("x"), y.alias("y"), z.alias("z"))
    out = orientation.fisher(rows, ["g"], "x", "y", "z")
    return out.select("g", "n", rounded(F.col("resultant"), 3).alias("resultant"), rounded(F.col("azimuth"), 2).alias("azimuth"), rounded(F.col("plunge"), 3).alias("plunge"), rounded(F.col("kappa")).alias("kappa"))


@query(with_("st") + f" SELECT hole % 5 AS g, CAST(floor(azimuth / 30) * 30 AS INTEGER) AS bin, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY hole % 5)', 6)} AS share FROM st GROUP BY 1, 2")
def rose_bins(spark, d):
    rows = bind.stations(spark, d).withColumn("g", F.col("hole") % 5)
    return orientation.rose(rows, ["g"], "azimuth", 30).withColumn("share", rounded(F.col("share"), 6))


@query()
def kriged_blocks(spark, d):
    pts = bind.points(spark, d)
    bins = geostat.variogram(pts, "id", "value", 60.0, 6).orderBy("bin").collect()
    model = geostat.fit_model([(b.h, b.gamma, b.pairs) for b in bins], "spherical")
    targets = bind.blocks(spark, d).select("id", (F.col("x") * 5).alias("x"), (F.col("y") * 5).alias("y"))
    return geostat.krige(targets, pts, "id", "id", "value", 250.0, model)


# drilling

from lodestone.operators import drilling  # noqa: E402


@query(with_("st") + """, s AS (SELECT hole, lag(depth) OVER w AS from_, depth AS to_, depth - lag(depth) OVER w AS step FROM st WINDOW w AS (PARTITION BY hole ORDER BY depth)), u AS (SELECT hole, median(step) AS usual FROM s WHERE step > 0 GROUP BY hole)
SELECT hole, from_, to_, step, usual FROM s JOIN u USING (hole) WHERE step > 1.6 * usual""")
def survey_gaps(spark, d):
    return drilling.survey_gaps(bind.stations(spark, d), 1.6)


@query(with_("st") + f""", e AS (SELECT hole, min(depth) AS d0, max(depth) AS d1, arg_min(azimuth, depth) AS a0, arg_max(azimuth, depth) AS a1, arg_min(dip, depth) AS i0, arg_max(dip, depth) AS i1 FROM st GROUP BY hole), t AS (SELECT *, a1 - a0 + 180 AS v FROM e WHERE d1 > d0)
SELECT hole, {r("(i1 - i0) * 100 / (d1 - d0)")} AS lift, {r("(v - 360 * floor(v / 360) - 180) * 100 / (d1 - d0)")} AS drift FROM t""")
def survey_deviation(spark, d):
    return drilling.deviation(bind.stations(spark, d)).select("hole", rounded(F.col("lift")).alias("lift"), rounded(F.col("drift")).alias("drift"))


@query(with_("pt") + f""", n AS (SELECT a.id, sqrt(min({_D2})) AS d FROM pt a JOIN pt b ON a.id <> b.id GROUP BY a.id), k AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM n)
SELECT any_value(n) AS n, {r("min(d)")} AS least, {r("min(d) FILTER (WHERE k > n // 2)")} AS median, {r("max(d)")} AS most FROM k""")
def hole_spacing(spark, d):
    out = drilling.spacing(bind.points(spark, d), "id", 50.0)
    return out.withColumns({c: rounded(F.col(c)) for c in ("least", "median", "most")})


@query(with_("pt") + f""", l AS (SELECT avg(x) AS cx, avg(y) AS cy, 90 - degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) AS b FROM pt), m AS (SELECT *, radians(b - 180 * floor(b / 180)) AS t FROM l)
SELECT id, {r("(x - cx) * sin(t) + (y - cy) * cos(t)", 3)} AS along, {r("(x - cx) * cos(t) - (y - cy) * sin(t)", 3)} AS offset_ FROM pt, m""")
def fence_projection(spark, d):
    pts = bind.points(spark, d).select("id", "x", "y")
    out = drilling.to_line(pts, drilling.best_line(pts))
    return out.select("id", rounded(F.col("along"), 3).alias("along"), rounded(F.col("offset"), 3).alias("offset_"))


@query(with_("st") + f""", t AS (SELECT hole, depth, -depth * 0.5 + (hole % 40) AS z FROM st), l AS (SELECT hole, depth AS d1, z AS z1, lag(depth) OVER w AS d0, lag(z) OVER w AS z0 FROM t WINDOW w AS (PARTITION BY hole ORDER BY depth)),
s AS (SELECT *, greatest(0, least((-30 - z0) / (z1 - z0), (-10 - z0) / (z1 - z0))) AS s0, least(1, greatest((-30 - z0) / (z1 - z0), (-10 - z0) / (z1 - z0))) AS s1 FROM l WHERE d1 > d0)
SELECT hole, {r("d0 + s0 * (d1 - d0)")} AS from_, {r("d0 + s1 * (d1 - d0)")} AS to_ FROM s WHERE d0 + s1 * (d1 - d0) > d0 + s0 * (d1 - d0) + 1e-9""")
def level_slab_runs(spark, d):
    trace = bind.stations(spark, d).select("hole", "depth", (-F.col("depth") * 0.5 + F.col("hole") % 40).alias("z"))
    return drilling.slab_runs(trace, -30.0, -10.0).select("hole", rounded(F.col("from_")).alias("from_"), rounded(F.col("to_")).alias("to_"))


@query(with_("iv") + f""", p AS (SELECT hole, code, count(*) / sum(count(*)) OVER (PARTITION BY hole) AS p FROM iv GROUP BY hole, code) SELECT hole, {r("max(p)")} AS most, {r("-sum(p * log2(p))")} AS entropy FROM p GROUP BY hole""")
def unit_uncertainty(spark, d):
    p = drilling.unit_probability(bind.intervals(spark, d), "hole", "code")
    return drilling.unit_entropy(p, "hole").select("hole", rounded(F.col("most")).alias("most"), rounded(F.col("entropy")).alias("entropy"))


@query("""WITH s AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) WHEN p_partkey % 3 = 1 THEN p_type || 's' ELSE p_type END AS v FROM part), n AS (SELECT regexp_replace(regexp_replace(lower(v), '[\\s_\\-]+', '', 'g'), 's$', '') AS key, v AS spelling, count(*) AS n FROM s GROUP BY 1, 2)
SELECT key, spelling, n FROM n QUALIFY count(*) OVER (PARTITION BY key) > 1""")
def twin_spellings(spark, d):
    k = F.col("p_partkey") % 3
    t = bind.table(spark, d, "part").select(F.when(k == 0, F.upper("p_type")).when(k == 1, F.concat("p_type", F.lit("s"))).otherwise(F.col("p_type")).alias("v"))
    return drilling.twin_values(t, "v")


@query(with_("iv") + f""", x AS (SELECT hole, value, to_ - from_ AS w, CASE WHEN code <> 'N' THEN 2 + value * 0.125 END AS d FROM iv), k AS (SELECT hole, sum(w * d) / sum(w) FILTER (WHERE d IS NOT NULL) AS m FROM x GROUP BY hole)
SELECT hole, {r("sum(value * w * coalesce(d, m, 1)) / sum(w * coalesce(d, m, 1))")} AS grade, {r("sum(w * coalesce(d, m, 1))")} AS mass FROM x JOIN k USING (hole) GROUP BY hole""")
def density_weighted_grade(spark, d):
    iv = bind.intervals(spark, d).select("hole", "value", (F.col("to_") - F.col("from_")).alias("len"), F.when(F.col("code") != "N", 2 + F.col("value") * 0.125).alias("density"))
    out = drilling.density_weighted(iv, ["hole"], "value", "len", "density")
    return out.select("hole", rounded(F.col("grade")).alias("grade"), rounded(F.col("mass")).alias("mass"))


@query("""WITH c AS (SELECT o_orderkey AS hole, CAST((o_orderkey * 37) % 100 AS DOUBLE) AS x, CAST((o_orderkey * 91) % 100 AS DOUBLE) AS y, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 5 AS DOUBLE) END AS z, CAST(o_orderkey % 400 AS DOUBLE) AS az, floor(o_totalprice / 1000) - 5 AS len FROM orders),
i AS (SELECT hole, len, unnest([CASE WHEN z IS NULL THEN 'error/no position' END, CASE WHEN az > 360 THEN 'warning/azimuth outside 0-360' END, CASE WHEN len <= 0 THEN 'warning/length not positive' END, CASE WHEN count(*) OVER (PARTITION BY x, y, z) > 1 THEN 'warning/shared position' END]) AS m FROM c)
SELECT split_part(m, '/', 1) AS severity, 'Collars' AS category, split_part(m, '/', 2) AS rule, hole, 0.0::DOUBLE AS from_, len AS to_ FROM i WHERE m IS NOT NULL""")
def collar_issues(spark, d):
    k = F.col("o_orderkey")
    c = bind.table(spark, d, "orders").select(k.alias("hole"), ((k * 37) % 100).cast("double").alias("x"), ((k * 91) % 100).cast("double").alias("y"), F.when(k % 11 != 0, (k % 5).cast("double")).alias("z"), (k % 400).cast("double").alias("azimuth"), F.lit(-60.0).alias("dip"), (F.floor(F.col("o_totalprice") / 1000) - 5).cast("double").alias("length"))
    return quality.collar_issues(c)


from lodestone.plans import field, formulas, more, space, streams  # noqa: E402, F401
