"""Survey cleaning, levelling, corridors, plan grids and supports bound to the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import intervals, plan, surveys
from lodestone.plans import bind
from lodestone.plans.bind import rounded, with_
from lodestone.plans.queries import query, r


def _rounded(df, *cols, digits=4):
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


# surveys along lines

_DESPIKE = """WITH n AS (SELECT event_id, event_type AS line, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS j, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE event_id % 5 <> 0),
a AS (SELECT *, unnest(range(-5, 6)) AS o FROM n),
b AS (SELECT *, CASE WHEN j + o < 0 THEN least(n - 1, -(j + o)) WHEN j + o > n - 1 THEN greatest(0, 2 * (n - 1) - (j + o)) ELSE j + o END AS m, CASE WHEN j + o < 0 THEN 0 WHEN j + o > n - 1 THEN n - 1 END AS e FROM a),
w AS (SELECT b.event_id, b.line, b.v, median(CASE WHEN b.e IS NULL THEN x.v ELSE 2 * y.v - x.v END) AS running FROM b JOIN n x ON x.line = b.line AND x.j = b.m LEFT JOIN n y ON y.line = b.line AND y.j = b.e GROUP BY b.event_id, b.line, b.v),
l AS (SELECT line, greatest(1.0, 3 * 1.4826 * median(abs(v - running))) AS "limit" FROM w GROUP BY line)"""


@query(f"{_DESPIKE} SELECT event_id, line, {r('running')} AS running, {r('\"limit\"')} AS \"limit\", abs(v - running) > \"limit\" AS spike FROM w JOIN l USING (line)")
def despiked_lines(spark, d):
    rows = bind.table(spark, d, "events").where("event_id % 5 <> 0").select("event_id", F.col("event_type").alias("line"), "value")
    return _rounded(surveys.despiked(rows, "line", "event_id", "value", 11, 3.0, 1.0), "running", "limit").drop("value")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' OR user_id % 100 >= 50")
def good_signal(spark, d):
    rows = bind.table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "error", "*").otherwise((F.col("user_id") % 100).cast("string")).alias("sq"))
    return surveys.good_signal(rows, "sq", 50.0).drop("sq")


@query(f"WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), o AS (SELECT event_type, abs(value - m) AS d FROM events JOIN m USING (event_type)), s AS (SELECT event_type, median(d) AS s FROM o GROUP BY 1) SELECT event_type, {r('max(d)')} AS anomaly FROM o JOIN s USING (event_type) WHERE s <= 0 OR d <= 2.5 * 1.4826 * s GROUP BY event_type")
def largest_anomaly(spark, d):
    return _rounded(surveys.largest_anomaly(bind.table(spark, d, "events"), ["event_type"], "value", 2.5), "anomaly")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('CASE WHEN l_discount > 0 THEN l_tax / l_discount END')} AS ratio FROM lineitem")
def channel_ratios(spark, d):
    return bind.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(surveys.ratio("l_tax", "l_discount")).alias("ratio"))


_TIES = with_("pt", recursive=True) + """, e AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, a.value AS va, b.value AS vb FROM pt a JOIN pt b ON a.zone % 2 = 0 AND b.zone % 2 = 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600),
o AS (SELECT *, row_number() OVER (ORDER BY d2, a, b) AS k FROM e),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub, false AS taken UNION ALL
  SELECT o.k, CASE WHEN f THEN list_append(ua, o.a) ELSE ua END, CASE WHEN f THEN list_append(ub, o.b) ELSE ub END, f FROM (SELECT o.*, ua, ub, NOT list_contains(ua, o.a) AND NOT list_contains(ub, o.b) AS f FROM g JOIN o ON o.k = g.k + 1) o),
t AS (SELECT a, b, d2, va, vb FROM o JOIN g USING (k) WHERE taken)"""


def _ties(spark, d):
    pts = bind.points(spark, d)
    return surveys.tie_pairs(pts.where("zone % 2 = 0"), pts.where("zone % 2 = 1"), "id", 60.0)


@query(f"{_TIES} SELECT a, b, d2 FROM t")
def tie_pairs(spark, d):
    return _ties(spark, d)


@query(f"{_TIES}, q AS (SELECT abs(va) + 1 AS va, abs(vb) + 1 AS vb FROM t) SELECT count(*) AS n, {r('median(va / vb)')} AS factor, {r('quantile_cont(va / vb, 0.16)')} AS low, {r('quantile_cont(va / vb, 0.84)')} AS high FROM q")
def level_factor(spark, d):
    values = bind.points(spark, d).select("id", (F.abs("value") + 1).alias("v"))
    pairs = _ties(spark, d).join(values.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(values.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return _rounded(surveys.level_factor(pairs, "va", "vb"), "factor", "low", "high")


_METHOD = "CASE user_id % 6 WHEN 0 THEN 'Assumed' WHEN 1 THEN CASE WHEN event_type = 'error' THEN 'GYRO ' ELSE 'planned' END WHEN 2 THEN 'Reflex EZ-Trac' WHEN 3 THEN 'rig aligner' WHEN 4 THEN '' ELSE 'collar set-up' END"


@query(f"""WITH s AS (SELECT user_id AS hole, {_METHOD} AS m FROM events), c AS (SELECT hole, CASE WHEN m IN ('Assumed', 'planned', 'collar set-up') THEN 'assumed' WHEN m IN ('GYRO ', 'Reflex EZ-Trac') THEN 'measured' END AS c FROM s WHERE m <> '')
SELECT hole, CASE WHEN bool_or(c = 'measured') THEN 'measured' WHEN bool_or(c = 'assumed') THEN 'assumed' ELSE 'unread' END AS method FROM c GROUP BY hole""")
def survey_methods(spark, d):
    rows = bind.table(spark, d, "events").select(F.col("user_id").alias("hole"), F.expr(_METHOD).alias("m"))
    return surveys.methods_by_hole(rows, "m")


@query(with_("co", "st") + " SELECT hole FROM co WHERE hole % 3 = 0 AND hole NOT IN (SELECT hole FROM st WHERE hole % 2 = 0)")
def attitude_assumed(spark, d):
    k = F.col("hole") % 3 == 0
    collars = bind.collars(spark, d).withColumns({"azimuth": F.when(~k, F.lit(10.0)), "dip": F.lit(-60.0)})
    return surveys.attitude_assumed(collars, bind.stations(spark, d).where("hole % 2 = 0")).select("hole")


# holes against sections and planes

_TRACE = "tr AS (SELECT hole, depth, (hole * 37) % 1000 + depth * azimuth / 400 AS x, (hole * 91) % 1000 - depth * dip / 90 AS y FROM st)"
_LINE = ((100.0, 200.0), (800.0, 500.0))
_D = """px AS (SELECT hole, depth, x - 100 AS px, y - 200 AS py, least(1, greatest(0, ((x - 100) * 700 + (y - 200) * 300) / 580000)) AS t FROM tr), dd AS (SELECT hole, depth, px, py, sqrt((px - t * 700) * (px - t * 700) + (py - t * 300) * (py - t * 300)) AS d FROM px)"""


def _trace(spark, d):
    h, m = F.col("hole"), F.col("depth")
    return bind.stations(spark, d).select("hole", "depth", ((h * 37) % 1000 + m * F.col("azimuth") / 400).alias("x"), ((h * 91) % 1000 - m * F.col("dip") / 90).alias("y"))


@query(with_("st") + f""", {_TRACE}, {_D}, l AS (SELECT hole, depth AS m1, d AS d1, lag(depth) OVER w AS m0, lag(d) OVER w AS d0 FROM dd WINDOW w AS (PARTITION BY hole ORDER BY depth)),
s AS (SELECT hole, CASE WHEN d0 <= 60 THEN m0 ELSE m0 + (60 - d0) / (d1 - d0) * (m1 - m0) END AS f, CASE WHEN d1 <= 60 THEN m1 ELSE m0 + (60 - d0) / (d1 - d0) * (m1 - m0) END AS t, d0 > 60 AS fresh, m0 FROM l WHERE m0 IS NOT NULL AND (d0 <= 60 OR d1 <= 60)),
k AS (SELECT *, sum(CASE WHEN fresh OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY hole ORDER BY m0) AS run FROM (SELECT *, row_number() OVER (PARTITION BY hole ORDER BY m0) AS n FROM s)) SELECT hole, {r('min(f)')} AS from_, {r('max(t)')} AS to_ FROM k GROUP BY hole, run""")
def corridor_runs(spark, d):
    return _rounded(surveys.corridor_runs(_trace(spark, d), *_LINE, 60.0), "from_", "to_")


@query(with_("st") + f", {_TRACE}, {_D} SELECT hole, {r('min((py * 700 - px * 300) / sqrt(580000))')} AS least, {r('max((py * 700 - px * 300) / sqrt(580000))')} AS most FROM dd WHERE d <= 60 GROUP BY hole")
def corridor_offsets(spark, d):
    return _rounded(surveys.corridor_offsets(_trace(spark, d), *_LINE, 60.0), "least", "most")


@query(with_("st") + f""", v AS (SELECT hole, depth, sin(radians(hole % 90)) * sin(radians(hole % 360)) AS nx, sin(radians(hole % 90)) * cos(radians(hole % 360)) AS ny, cos(radians(hole % 90)) AS nz, cos(radians(dip)) * sin(radians(azimuth)) AS hx, cos(radians(dip)) * cos(radians(azimuth)) AS hy, sin(radians(dip)) AS hz FROM st),
a AS (SELECT hole, depth, degrees(asin(least(1, abs(nx * hx + ny * hy + nz * hz)))) AS a FROM v) SELECT hole, depth, {r('a')} AS alpha, {r('CASE WHEN sin(radians(a)) > 0.1 THEN 1 / sin(radians(a)) ELSE 10 END')} AS weight FROM a""")
def plane_angles(spark, d):
    h = F.col("hole")
    rows = bind.stations(spark, d).withColumn("alpha", surveys.alpha_angle(h % 360, h % 90, F.col("azimuth"), F.col("dip")))
    return _rounded(rows.select("hole", "depth", "alpha", surveys.sampling_weight(F.col("alpha")).alias("weight")), "alpha", "weight")


# plan grids

_GT = "hp AS (SELECT id, x, y, 3.0::DOUBLE + id % 17 AS gt, CASE WHEN id % 9 <> 0 THEN 1.0::DOUBLE + id % 4 END AS thickness FROM pt)"
_NODES = f"""{_GT}, bx AS (SELECT min(x) AS x0, min(y) AS y0, CAST(ceil((max(x) - min(x)) / 40) + 1 AS BIGINT) AS nx, CAST(ceil((max(y) - min(y)) / 40) + 1 AS BIGINT) AS ny FROM hp),
nd AS (SELECT i, j, x0 + i * 40 AS x, y0 + j * 40 AS y FROM (SELECT *, unnest(range(nx)) AS i FROM bx) JOIN (SELECT unnest(range(ny)) AS j FROM bx) ON true),
pg AS (SELECT i, j, n.x, n.y, coalesce(arg_min(h.gt, h.id) FILTER (WHERE d < 1e-6), sum(h.gt / (d * d)) FILTER (WHERE d >= 1e-6) / sum(1 / (d * d)) FILTER (WHERE d >= 1e-6)) AS gt, coalesce(arg_min(coalesce(thickness, 0), h.id) FILTER (WHERE d < 1e-6), sum(coalesce(thickness, 0) / (d * d)) FILTER (WHERE d >= 1e-6) / sum(1 / (d * d)) FILTER (WHERE d >= 1e-6)) AS thickness
  FROM (SELECT nd.*, hp.id AS hid, sqrt((nd.x - hp.x) * (nd.x - hp.x) + (nd.y - hp.y) * (nd.y - hp.y)) AS d FROM nd JOIN hp ON (nd.x - hp.x) * (nd.x - hp.x) + (nd.y - hp.y) * (nd.y - hp.y) <= 10000) n JOIN hp h ON h.id = hid GROUP BY i, j, n.x, n.y)"""


def _grid(spark, d):
    i = F.col("id")
    holes = bind.points(spark, d).select("id", "x", "y", (3.0 + i % 17).alias("gt"), F.when(i % 9 != 0, 1.0 + i % 4).alias("thickness"))
    return plan.plan_grid(holes, "id", 40.0, 100.0)


@query(with_("pt") + f", {_NODES} SELECT i, j, x, y, {r('gt')} AS gt, {r('thickness')} AS thickness FROM pg")
def plan_grid(spark, d):
    return _rounded(_grid(spark, d), "gt", "thickness")


@query(with_("pt") + f", {_NODES} SELECT count(*) AS nodes, count(*) * 1600.0::DOUBLE AS area, {r('sum(thickness) * 1600', 2)} AS volume, {r('sum(thickness) * 1600 * 2.7', 2)} AS tonnes, {r('sum(gt) / sum(thickness)')} AS grade FROM pg WHERE gt >= 8")
def plan_summary(spark, d):
    return _rounded(_rounded(plan.plan_summary(_grid(spark, d), 40.0, 8.0, 2.7), "volume", "tonnes", digits=2), "grade")


@query(with_("pt") + f", {_NODES} SELECT CAST(floor((i * 40 + 20) / 150) AS BIGINT) AS pi, CAST(floor((j * 40 + 20) / 150) AS BIGINT) AS pj, count(*) AS nodes, {r('avg(gt)')} AS gt, {r('avg(thickness)')} AS thickness, {r('sum(thickness) * 1600 * 2.7', 2)} AS tonnes, avg(gt) >= 10 AS ore FROM pg GROUP BY 1, 2")
def plan_panels(spark, d):
    return _rounded(_rounded(plan.panels(_grid(spark, d), 40.0, 150.0, 10.0, 2.7), "gt", "thickness"), "tonnes", digits=2)


@query(with_("gr") + f""", s AS (SELECT a.i, a.j, a.z AS a, b.z AS b, c.z AS c, e.z AS d FROM gr a JOIN gr b ON b.i = a.i + 1 AND b.j = a.j JOIN gr c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN gr e ON e.i = a.i AND e.j = a.j + 1),
p AS (SELECT i, j, 1 AS k, i + (5000 - a) / (b - a) AS x, j::DOUBLE AS y FROM s WHERE (a >= 5000) <> (b >= 5000) UNION ALL SELECT i, j, 2, i + 1, j + (5000 - b) / (c - b) FROM s WHERE (b >= 5000) <> (c >= 5000)
UNION ALL SELECT i, j, 3, i + (5000 - d) / (c - d), j + 1 FROM s WHERE (c >= 5000) <> (d >= 5000) UNION ALL SELECT i, j, 4, i, j + (5000 - a) / (d - a) FROM s WHERE (d >= 5000) <> (a >= 5000)),
n AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY k) AS n FROM p)
SELECT u.i, u.j, {r('u.x')} AS x1, {r('u.y')} AS y1, {r('v.x')} AS x2, {r('v.y')} AS y2 FROM n u JOIN n v ON u.i = v.i AND u.j = v.j AND v.n = u.n + 1 WHERE u.n % 2 = 1""")
def contour_segments(spark, d):
    return _rounded(plan.contours(bind.terrain(spark, d), "z", 5000.0), "x1", "y1", "x2", "y2")


# supports

_CAND = "cd AS (SELECT p_partkey % 50 AS block, p_size AS hole, (p_partkey * 7919) % 10007 + 1.0::DOUBLE AS d2, p_partkey AS k FROM part)"


def _candidates(spark, d):
    k = F.col("p_partkey")
    return bind.table(spark, d, "part").select((k % 50).alias("block"), F.col("p_size").alias("hole"), ((k * 7919) % 10007 + 1.0).alias("d2"), k.alias("k"))


@query(f"WITH {_CAND}, h AS (SELECT *, row_number() OVER (PARTITION BY block, hole ORDER BY d2, k) AS h FROM cd) SELECT block, hole, d2, k FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY d2, k) AS n FROM h WHERE h <= 2) WHERE n <= 12")
def chosen_neighbours(spark, d):
    return plan.chosen_neighbours(_candidates(spark, d), "block", "hole", ["d2", "k"], 12, 4, 2)


@query(f"WITH {_CAND}, s AS (SELECT block, hole, sum(1 / d2) AS w FROM cd GROUP BY block, hole) SELECT block, hole, {r('share', 6)} AS share FROM (SELECT *, w / sum(w) OVER (PARTITION BY block) AS share FROM s) WHERE share >= 0.05 - 1e-9")
def material_holes(spark, d):
    return _rounded(plan.material_holes(_candidates(spark, d), "block", "hole", "d2"), "share", digits=6)


@query(f"""WITH x AS (SELECT p_partkey AS id, p_size - 3.0::DOUBLE AS v FROM part WHERE p_partkey % 7 <> 0), f AS (SELECT min(v) / 2 AS f FROM x WHERE v > 0), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM x), c AS (SELECT v AS c FROM o WHERE k = floor(0.9 * (n - 1)))
SELECT id, {r('log10(greatest(v, 0) + 1)', 6)} AS logged, {r('log10(greatest(v, f))', 6)} AS floored, least(v, c) AS capped FROM x, f, c""")
def value_transforms(spark, d):
    k = F.col("p_partkey")
    rows = bind.table(spark, d, "part").select(k.alias("id"), F.when(k % 7 != 0, F.col("p_size") - 3.0).alias("v"))
    made = [plan.transformed(rows, "v", how, 90.0).withColumnRenamed("v", name) for how, name in (("log", "logged"), ("logfloor", "floored"), ("cap", "capped"))]
    return _rounded(made[0].join(made[1], "id").join(made[2], "id"), "logged", "floored", digits=6)


@query(with_("iv") + f", n AS (SELECT *, greatest(1, CAST(ceil((to_ - from_) / 7.5) AS BIGINT)) AS n FROM iv) SELECT hole, code, {r('from_ + i * (to_ - from_) / n')} AS from_, {r('from_ + (i + 1) * (to_ - from_) / n')} AS to_ FROM (SELECT *, unnest(range(n)) AS i FROM n)")
def split_intervals(spark, d):
    rows = bind.intervals(spark, d).select("hole", "code", "from_", "to_")
    return _rounded(plan.split_intervals(rows, 7.5), "from_", "to_")


@query("""WITH x AS (SELECT (p_size - 5) * 100.0::DOUBLE AS v FROM part), s AS (SELECT v, sum(v) OVER (ORDER BY v DESC ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY v DESC) AS k, sum(v) OVER () AS t, count(*) OVER () AS n FROM x WHERE v > 0)
SELECT min(k) FILTER (WHERE c >= t / 2) AS half_from, any_value(n) AS contributing, round(sum(v) FILTER (WHERE k <= 10) / any_value(t), 3) AS ten_share FROM s""")
def metal_carriers(spark, d):
    return plan.metal_carriers(bind.table(spark, d, "part").select(((F.col("p_size") - 5) * 100.0).alias("v")), "v")


@query("""WITH x AS (SELECT CASE WHEN l_linenumber <> 2 THEN l_discount END AS a, CASE WHEN l_linenumber <> 4 THEN l_tax END AS b, l_quantity AS c, l_discount < 0.02 AS la, l_tax < 0.01 AS lb FROM lineitem)
SELECT 'a' AS a, 'b' AS b, count(*) FILTER (WHERE x.a IS NOT NULL AND x.b IS NOT NULL) AS n, count(*) FILTER (WHERE x.a IS NOT NULL AND x.b IS NOT NULL AND (la OR lb)) AS below FROM x UNION ALL SELECT 'a', 'c', count(x.a), count(x.a) FILTER (WHERE la) FROM x UNION ALL SELECT 'b', 'c', count(x.b), count(x.b) FILTER (WHERE lb) FROM x""")
def below_detection_pairs(spark, d):
    n = F.col("l_linenumber")
    rows = bind.table(spark, d, "lineitem").select(F.when(n != 2, F.col("l_discount")).alias("a"), F.when(n != 4, F.col("l_tax")).alias("b"), F.col("l_quantity").alias("c"))
    return plan.below_detection_pairs(rows, ["a", "b", "c"], {"a": F.col("a") < 0.02, "b": F.col("b") < 0.01, "c": F.lit(False)})


@query(f"""WITH x AS (SELECT l_returnflag AS g, l_quantity AS a, CASE WHEN l_linenumber <> 3 THEN l_quantity * (0.4 + l_linenumber * 0.05) END AS b FROM lineitem), q AS (SELECT g, abs(a - b) / ((a + b) / 2) * 100 AS d, CASE WHEN a > 0 THEN b / a END AS q FROM x WHERE b IS NOT NULL)
SELECT g, count(*) AS n, {r('median(d)')} AS median_rpd, {r('median(q)')} AS median_ratio, median(q) < 0.499 AS different FROM q GROUP BY g""")
def method_pairs(spark, d):
    n = F.col("l_linenumber")
    rows = bind.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("a"), F.when(n != 3, F.col("l_quantity") * (0.4 + n * 0.05)).alias("b"))
    return _rounded(plan.method_pairs(rows, ["g"], "a", "b"), "median_rpd", "median_ratio")


_FLAG = "CASE p_partkey % 8 WHEN 0 THEN 'b.d.l.' WHEN 1 THEN '<' WHEN 2 THEN 'Not detected' WHEN 3 THEN 'over-limit' WHEN 4 THEN 'UDL' WHEN 5 THEN '' WHEN 6 THEN 'ok' END"


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '<' WHEN 1 THEN '<' WHEN 2 THEN '<' WHEN 3 THEN '>' WHEN 4 THEN '>' END AS qualifier FROM part")
def flag_qualifiers(spark, d):
    return bind.table(spark, d, "part").select("p_partkey", plan.flag_qualifier(F.expr(_FLAG)).alias("qualifier"))


@query(with_("iv", "isl") + " SELECT code, sum(to_ - from_) AS metres, count(DISTINCT hole) AS holes, sum(to_ - from_) * 900 AS volume FROM isl GROUP BY code")
def logged_volume(spark, d):
    return plan.logged_volume(intervals.merge_touching(bind.intervals(spark, d), "code"), ["code"], 30.0)
