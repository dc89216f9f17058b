"""Import decisions, quality control, blocks and meshes bound to the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import assay
from lodestone.operators import economics, imports, intervals, qaqc
from lodestone.plans import bind
from lodestone.sources import rawtables
from lodestone.plans.bind import rounded, with_
from lodestone.plans.queries import query, r


def _rounded(df, *cols, digits=4):
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


# intercepts and logs


@query(with_("iv", "isl") + """, a AS (SELECT hole, min(from_) AS f, max(to_) AS t FROM iv WHERE value >= 3 GROUP BY hole), e AS (SELECT hole, max(to_) - (hole % 2) * 5 AS l FROM iv WHERE hole % 3 <> 0 GROUP BY hole)
SELECT hole, code, from_, to_, coalesce(from_ <= f + 0.01, false) AS open_top, coalesce(to_ >= t - 0.01, false) OR coalesce(l > 0 AND to_ >= l - 0.01, false) AS open_bottom FROM isl LEFT JOIN a USING (hole) LEFT JOIN e USING (hole)""")
def intercept_open_ends(spark, d):
    iv = bind.intervals(spark, d)
    ends = iv.where("hole % 3 <> 0").groupBy("hole").agg((F.max("to_") - (F.col("hole") % 2) * 5).alias("length"))
    return intervals.open_ends(intervals.merge_touching(iv, "code").drop("n"), iv.withColumn("value", F.when(F.col("value") >= 3, F.col("value"))), ends)


@query(with_("iv") + f""" SELECT hole, from_, to_, to_ - from_ AS length, value AS grade, {r("(to_ - from_) * 0.6")} AS true_width, {r("greatest((to_ - from_) * 0.6, 12)")} AS width, {r("value * (to_ - from_) * 0.6 / greatest((to_ - from_) * 0.6, 12)")} AS diluted_grade,
{r("value * (to_ - from_) * 0.6")} AS gram_metres, greatest((to_ - from_) * 0.6, 12) > (to_ - from_) * 0.6 AS is_diluted FROM iv WHERE value >= 0""")
def diluted_intercepts(spark, d):
    found = bind.intervals(spark, d).select("hole", "from_", "to_", (F.col("to_") - F.col("from_")).alias("length"), F.col("value").alias("grade"))
    return _rounded(intervals.diluted(found, 12.0, F.lit(0.6)), "true_width", "width", "diluted_grade", "gram_metres")


@query(with_("iv", "isl") + " SELECT hole, code, 'top' AS side, from_ AS depth FROM isl UNION ALL SELECT hole, code, 'base', to_ FROM isl")
def unit_contacts(spark, d):
    return intervals.contacts(bind.intervals(spark, d))


_NEW = "n AS (SELECT DISTINCT hole, status AS source, CASE WHEN code = 'R' THEN from_ + (to_ - from_) * 0.5 ELSE from_ END AS from_, to_ FROM iv WHERE hole % 3 = 0)"


@query(with_("iv") + f""", {_NEW}, o AS (SELECT DISTINCT hole, status AS source, from_, to_ FROM iv WHERE (hole, status) IN (SELECT hole, source FROM n)),
gone AS (SELECT * FROM o EXCEPT SELECT * FROM n), fresh AS (SELECT * FROM n EXCEPT SELECT * FROM o),
met AS (SELECT DISTINCT g.hole, g.source FROM gone g JOIN fresh f ON f.hole = g.hole AND f.source = g.source AND f.from_ < g.to_ - 1e-9 AND f.to_ > g.from_ + 1e-9)
SELECT hole, source, count(*) AS stale FROM gone JOIN met USING (hole, source) GROUP BY hole, source""")
def changed_intervals(spark, d):
    old = bind.intervals(spark, d).withColumnRenamed("status", "source")
    new = old.where("hole % 3 = 0").withColumn("from_", F.when(F.col("code") == "R", F.col("from_") + (F.col("to_") - F.col("from_")) * 0.5).otherwise(F.col("from_")))
    return intervals.changed_intervals(old, new)


@query(with_("iv") + " SELECT hole, status AS source, from_, to_, value FROM iv WHERE code = 'A' OR NOT (hole % 5 = 0 AND status = 'O')")
def drop_file_rows(spark, d):
    rows = bind.intervals(spark, d).select("hole", F.col("status").alias("source"), "from_", "to_", "value", (F.col("code") == "A").alias("qc"))
    holes = rows.where("hole % 5 = 0 and source = 'O'").select("hole", "source")
    return imports.drop_holes(rows, holes, qc="qc").drop("qc")


# decisions of an import


@query("""WITH c AS (SELECT CASE WHEN l_linenumber <> 3 THEN floor(l_discount * 100 + 0.5) - 3 END AS a, CASE WHEN l_linenumber <> 5 THEN floor(l_tax * 100 + 0.5) END AS b FROM lineitem)
SELECT 'a' AS column, count(*) FILTER (WHERE a IS NULL) AS n_blank, count(*) FILTER (WHERE a < 0) AS n_negative, count(*) FILTER (WHERE a = 0) AS n_zero, greatest(max(a), 0) AS most FROM c
UNION ALL SELECT 'b', count(*) FILTER (WHERE b IS NULL), count(*) FILTER (WHERE b < 0), count(*) FILTER (WHERE b = 0), greatest(max(b), 0) FROM c""")
def column_scan(spark, d):
    cell = lambda c, k: F.floor(F.col(c) * 100 + 0.5) - k
    rows = bind.table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 3, "").otherwise(cell("l_discount", 3).cast("string")).alias("a"), F.when(F.col("l_linenumber") != 5, cell("l_tax", 0).cast("string")).alias("b"))
    return imports.scan_columns(rows, ["a", "b"], assay.number)


@query(with_("st") + """, s AS (SELECT hole % 7 AS g, CASE hole % 7 WHEN 1 THEN -dip WHEN 2 THEN -dip - 20 ELSE dip END AS d FROM st),
k AS (SELECT g, count(*) AS n, count(*) FILTER (WHERE d > 0) AS positive, count(*) FILTER (WHERE d < 0) AS negative, count(*) FILTER (WHERE d >= 45) AS steep FROM s WHERE d <> 0 GROUP BY g)
SELECT *, CASE WHEN negative = 0 AND positive > 0 AND steep >= 0.9 * positive THEN 'pos_down' ELSE 'neg_down' END AS convention FROM k""")
def dip_convention(spark, d):
    g = F.col("hole") % 7
    dip = F.when(g == 1, -F.col("dip")).when(g == 2, -F.col("dip") - 20).otherwise(F.col("dip"))
    return imports.dip_convention(bind.stations(spark, d).select(g.alias("g"), dip.alias("d")), "d", ["g"])


@query(with_("iv") + f""", k AS (SELECT hole, max(to_) AS d, CASE WHEN hole % 4 < 3 THEN max(to_) / (3.2 + (hole % 3) * 0.05) ELSE max(to_) END AS l FROM iv GROUP BY hole), x AS (SELECT d / l AS r FROM k),
f AS (SELECT r, row_number() OVER (ORDER BY r) AS k, count(*) OVER () AS n FROM x WHERE r BETWEEN 3.2808398950131235 * 0.9 AND 3.2808398950131235 * 1.1)
SELECT 'feet' AS kind, {r("min(r) FILTER (WHERE k > n // 2)")} AS ratio, any_value(n) AS holes, (SELECT count(*) FROM x) AS total FROM f""")
def depth_unit_hint(spark, d):
    rows = bind.intervals(spark, d).select("hole", F.col("to_").alias("depth"))
    deep = F.max("depth")
    collars = rows.groupBy("hole").agg(F.when(F.col("hole") % 4 < 3, deep / (3.2 + (F.col("hole") % 3) * 0.05)).otherwise(deep).alias("length"))
    return _rounded(imports.depth_unit_hint(rows, collars), "ratio")


@query(with_("co") + " SELECT hole, x, y, z, CASE WHEN hole % 2 = 0 THEN o_orderstatus END AS purpose FROM co JOIN orders ON o_orderkey = hole")
def per_hole_attributes(spark, d):
    collars = bind.collars(spark, d)
    status = bind.table(spark, d, "orders").select(F.col("o_orderkey").alias("hole"), F.col("o_orderstatus").alias("purpose"))
    sheet = collars.join(status, "hole").where("hole % 2 = 0").select(F.concat(F.lit(" "), F.col("hole").cast("string")).alias("hole"), (F.col("x") + 0.5).alias("x"), (F.col("y") - 0.5).alias("y"), "purpose")
    return imports.per_hole_join(sheet, collars)


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, CASE WHEN event_type = 'purchase' THEN '' ELSE event_type END AS parent_id, CASE WHEN event_type = 'error' THEN 'dup' ELSE '' END AS sample_type, event_id FROM events)
SELECT sample_id, arg_max(parent_id, event_id) AS parent_id, arg_max(sample_type, event_id) AS sample_type FROM s WHERE parent_id <> '' OR sample_type <> '' GROUP BY sample_id""")
def qc_links(spark, d):
    t = F.col("event_type")
    rows = bind.table(spark, d, "events").select(F.col("user_id").cast("string").alias("sample_id"), F.when(t != "purchase", t).alias("parent_id"), F.when(t == "error", "dup").alias("sample_type"), "event_id")
    return imports.qc_links(rows, "event_id")


@query(with_("iv") + """, o AS (SELECT hole, from_, to_, status AS source, value AS au, CASE WHEN code <> 'R' THEN value * 2 END AS ag FROM iv),
n AS (SELECT hole, from_, to_, status AS source, CASE WHEN code <> 'A' THEN value + 1 END AS au, value * 3 AS ag FROM iv WHERE hole % 3 = 0)
SELECT hole, from_, to_, source, coalesce(n.au, o.au) AS au, coalesce(n.ag, o.ag) AS ag FROM o LEFT JOIN n USING (hole, from_, to_, source)""")
def merge_assays(spark, d):
    iv = bind.intervals(spark, d).withColumnRenamed("status", "source")
    keys, v = ["hole", "from_", "to_", "source"], F.col("value")
    old = iv.select(*keys, v.alias("au"), F.when(F.col("code") != "R", v * 2).alias("ag"))
    new = iv.where("hole % 3 = 0").select(*keys, F.when(F.col("code") != "A", v + 1).alias("au"), (v * 3).alias("ag"))
    return imports.merge_assays(old, new, keys, ["au", "ag"])


@query(with_("iv") + " SELECT hole, from_, to_, round((to_ - from_ - value) / (to_ - from_) * 100, 4) AS recovery FROM iv")
def core_recovery(spark, d):
    iv = bind.intervals(spark, d)
    return iv.select("hole", "from_", "to_", imports.recovery(F.col("to_") - F.col("from_"), loss=F.col("value")).alias("recovery"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS name FROM events")
def filled_down_ids(spark, d):
    rows = bind.table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("name"))
    return imports.filled_down(rows, "name", "event_id", "user_id")


@query("""SELECT o_orderkey AS hole FROM orders WHERE (CAST(o_orderkey AS VARCHAR) LIKE '%12%' OR CAST(o_orderkey AS VARCHAR) LIKE '%7%') AND lower(o_orderstatus) = 'f' AND lower(o_orderpriority) IN ('1-urgent', '2-high')""")
def hole_filter_terms(spark, d):
    orders = bind.table(spark, d, "orders")
    wanted = imports.holes_matching("12, 7 Status=F priority=urgent priority=2-HIGH", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority"})
    return orders.where(wanted).select(F.col("o_orderkey").alias("hole"))


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def field_picks(spark, d):
    return imports.field_picks(bind.table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(with_("iv") + """, c AS (SELECT hole, max(to_) + (hole % 3) * 20 AS length FROM iv GROUP BY hole), e AS (SELECT hole, max(to_) AS "end" FROM iv WHERE hole % 5 <> 0 GROUP BY hole)
SELECT hole, CASE WHEN "end" IS NULL THEN 'missing' ELSE 'short' END AS state, "end", length FROM c LEFT JOIN e USING (hole) WHERE "end" IS NULL OR "end" < length - 30""")
def log_coverage(spark, d):
    iv = bind.intervals(spark, d)
    collars = iv.groupBy("hole").agg((F.max("to_") + (F.col("hole") % 3) * 20).alias("length"))
    return imports.coverage(collars, iv.where("hole % 5 <> 0"), 30.0)


@query(with_("st") + """, e AS (SELECT hole, max(depth) + (hole % 4) * 8 AS l FROM st GROUP BY hole), s AS (SELECT hole, depth, lead(depth) OVER (PARTITION BY hole ORDER BY depth) AS n FROM (SELECT DISTINCT hole, depth FROM st))
SELECT hole, depth AS from_, least(coalesce(n, l), l) AS to_, CASE WHEN n IS NULL THEN 'tail' ELSE 'gap' END AS kind FROM s JOIN e USING (hole) WHERE (n - depth > 30 OR (n IS NULL AND l - depth > 10)) AND least(coalesce(n, l), l) > depth""")
def unsurveyed_spans(spark, d):
    st = bind.stations(spark, d)
    return imports.unsurveyed(st, st.groupBy("hole").agg((F.max("depth") + (F.col("hole") % 4) * 8).alias("length")), 30.0, 10.0)


_VOTES = """t AS (SELECT hole, code AS u, min(from_) AS f FROM iv GROUP BY hole, code), v AS (SELECT a.u AS above, b.u AS below, count(*) AS holes FROM t a JOIN t b ON a.hole = b.hole AND a.f < b.f GROUP BY a.u, b.u),
w AS (SELECT v.above, v.below, v.holes, v.holes + coalesce(o.holes, 0) AS "of" FROM v LEFT JOIN v o ON o.above = v.below AND o.below = v.above)"""


@query(with_("iv") + f', {_VOTES} SELECT above, below, holes, "of" FROM w')
def unit_votes(spark, d):
    return imports.unit_votes(bind.intervals(spark, d))


@query(with_("iv") + f""", {_VOTES}, u AS (SELECT above AS unit FROM w UNION SELECT below FROM w), k AS (SELECT unit, count(above) AS wins FROM u LEFT JOIN w ON above = unit AND 2 * holes > "of" GROUP BY unit)
SELECT unit, wins, CAST(row_number() OVER (ORDER BY wins DESC, unit) AS INTEGER) AS rank FROM k""")
def unit_order(spark, d):
    return imports.unit_order(imports.unit_votes(bind.intervals(spark, d)))


@query(with_("rd") + """, k AS (SELECT event_id, hole, depth, row_number() OVER (PARTITION BY hole, floor(depth / 1440) ORDER BY depth, event_id) AS n, count(*) OVER (PARTITION BY hole, floor(depth / 1440)) AS k FROM rd)
SELECT event_id, hole, depth FROM k WHERE n = k // 2 + 1""")
def declustered_picks(spark, d):
    return imports.declustered_picks(bind.readings(spark, d).select("event_id", "hole", "depth"), 1440.0, "event_id")


# quality control

_LINES = "x AS (SELECT l_returnflag AS element, floor(l_discount * 100 + 0.5) + 1 AS v, floor(l_tax * 100 + 0.5) AS t, least(l_quantity, 40) AS q FROM lineitem)"


def _lines(spark, d):
    cell = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("double")
    return bind.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("element"), (cell("l_discount") + 1).alias("v"), cell("l_tax").alias("t"), F.least(F.col("l_quantity"), F.lit(40.0)).alias("q"))


@query(f"WITH {_LINES} SELECT element, min(t) FILTER (WHERE t > 0) AS step, count(*) FILTER (WHERE t = 0) AS zeros FROM x GROUP BY element HAVING count(*) FILTER (WHERE t = 0) >= 20 AND count(*) FILTER (WHERE t = 0) >= 0.05 * count(t)")
def reporting_step(spark, d):
    return qaqc.zero_steps(_lines(spark, d), ["element"], "t")


_FLOOR = f"""WITH {_LINES}, m AS (SELECT element, min(v) AS floor FROM x WHERE v > 0 GROUP BY element),
f AS (SELECT element, floor, count(*) FILTER (WHERE v = floor) AS n, count(*) FILTER (WHERE v > 0) AS p, min(v) FILTER (WHERE v > floor) AS next FROM x JOIN m USING (element) GROUP BY element, floor)"""


@query(f"{_FLOOR} SELECT element, floor, n, {r('n / p', 6)} AS share, floor * 2 AS dl, next FROM f WHERE n >= 20 AND n / p >= 0.05")
def censoring_floor(spark, d):
    return _rounded(qaqc.censoring_floor(_lines(spark, d), ["element"], "v"), "share", digits=6)


@query(f"{_FLOOR} SELECT element, {r('n / p', 6)} AS share, floor, floor * 2 AS dl FROM f WHERE n >= 20 AND n / p >= 0.09")
def floor_elements(spark, d):
    return _rounded(qaqc.floor_elements(_lines(spark, d), "element", "v", 0.09), "share", digits=6)


@query(f"""WITH {_LINES}, m AS (SELECT element, max(q) AS ceiling FROM x GROUP BY element), b AS (SELECT element, max(q) AS below FROM x WHERE q < 40 GROUP BY element)
SELECT element, ceiling, count(*) FILTER (WHERE q = ceiling) AS n, count(*) FILTER (WHERE q = below) AS next FROM x JOIN m USING (element) JOIN b USING (element) GROUP BY element, ceiling HAVING count(*) FILTER (WHERE q = ceiling) >= 5 AND count(*) FILTER (WHERE q = ceiling) > 2 * count(*) FILTER (WHERE q = below)""")
def censoring_ceiling(spark, d):
    return qaqc.censoring_ceiling(_lines(spark, d), ["element"], "q")


@query(f"""WITH x AS (SELECT l_linenumber AS element, l_extendedprice / (l_linenumber * 50) AS v FROM lineitem) SELECT element, {r("median(v)")} AS median, {r("max(v)")} AS most, count(*) AS n FROM x WHERE v > 0 GROUP BY element HAVING count(*) >= 3 AND median(v) > 100""")
def percent_reading_ppm(spark, d):
    rows = bind.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("element"), (F.col("l_extendedprice") / (F.col("l_linenumber") * 50)).alias("v"))
    return _rounded(qaqc.percent_reading_ppm(rows, "element", "v"), "median", "most")


@query(f"WITH x AS (SELECT l_returnflag AS g, CASE WHEN l_linenumber <> 2 THEN l_tax END AS a, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS b FROM lineitem) SELECT g, count(*) AS n, count(a) AS used, {r('avg(a)', 6)} AS mean_a, count(a) AS n_a, {r('avg(b) FILTER (WHERE a IS NOT NULL)')} AS mean_b, count(b) FILTER (WHERE a IS NOT NULL) AS n_b FROM x GROUP BY g")
def group_means(spark, d):
    n = F.col("l_linenumber")
    rows = bind.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.when(n != 2, F.col("l_tax")).alias("a"), F.when(n != 4, F.col("l_quantity")).alias("b"))
    out = qaqc.group_means(rows, ["g"], ["a", "b"], ["a"])
    return _rounded(_rounded(out, "mean_a", digits=6), "mean_b")


_OXIDES = "x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS si, CASE WHEN p_partkey % 6 <> 0 THEN floor(p_retailprice / 40) END AS al, CASE WHEN p_partkey % 50 = 1 THEN 120.0::DOUBLE ELSE p_partkey % 30 END AS fe FROM part)"


@query(f"WITH {_OXIDES} SELECT p_partkey, si + al + fe AS total, fe > 100 AS over FROM x WHERE fe > 100 OR si + al + fe < 40 OR si + al + fe > 102")
def oxide_totals(spark, d):
    k = F.col("p_partkey")
    rows = bind.table(spark, d, "part").select(k, F.col("p_size").cast("double").alias("si"), F.when(k % 6 != 0, F.floor(F.col("p_retailprice") / 40).cast("double")).alias("al"), F.when(k % 50 == 1, 120.0).otherwise((k % 30).cast("double")).alias("fe"))
    out = qaqc.outside_tolerance(qaqc.oxide_totals(rows, ["si", "al", "fe"]), 40.0, 102.0)
    return out.select("p_partkey", "total", (F.size("over_100") > 0).alias("over"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS v FROM part), m AS (SELECT list_distinct([quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75)]) AS m FROM x)
SELECT p_partkey, CASE WHEN v IS NOT NULL THEN CAST(len(list_filter(m, lambda q: q <= v)) + 1 AS INTEGER) END AS class FROM x, m""")
def log_classes(spark, d):
    rows = bind.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("v"))
    return qaqc.classes_by_quartile(rows, "v").select("p_partkey", "class")


@query(with_("iv") + f" SELECT code, count(*) AS n, {r('avg(value / 2)')} AS mean, CASE WHEN count(*) < 30 THEN 'few' WHEN avg(value / 2) BETWEEN 2.48 AND 2.55 THEN 'taken' ELSE 'outside' END AS state FROM iv GROUP BY code")
def density_by_code(spark, d):
    rows = bind.intervals(spark, d).select("code", (F.col("value") / 2).alias("v"))
    return _rounded(qaqc.density_by_code(rows, "code", "v", 2.48, 2.55, 30), "mean")


_Z = """lg AS (SELECT zone, id, log10({v}) AS l FROM gq WHERE {v} > 0), md AS (SELECT zone, median(l) AS m FROM lg GROUP BY zone), ma AS (SELECT zone, median(abs(l - m)) AS s FROM lg JOIN md USING (zone) GROUP BY zone)"""
_GQ = "gq AS (SELECT p_partkey AS id, p_brand AS zone, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS c FROM part)"


def _parts(spark, d):
    k = F.col("p_partkey")
    return bind.table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("zone"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), ((k * 7919) % 10007).cast("double").alias("c"))


@query(f"WITH {_GQ}, {_Z.format(v='c')} SELECT id, zone, {r('(l - m) / (1.4826 * s)')} AS z FROM lg JOIN md USING (zone) JOIN ma USING (zone) WHERE s > 0")
def robust_scores(spark, d):
    return _rounded(qaqc.robust_scores(_parts(spark, d), ["zone"], "c").select("id", "zone", "z"), "z")


def _z_of(v: str) -> str:
    return _Z.format(v=v).replace("lg ", f"lg_{v} ").replace("md ", f"md_{v} ").replace("ma ", f"ma_{v} ") + f", z_{v} AS (SELECT id, (l - m) / (1.4826 * s) AS z FROM lg_{v} JOIN md_{v} USING (zone) JOIN ma_{v} USING (zone) WHERE s > 0)"


@query(f"WITH {_GQ}, " + ", ".join(_z_of(v) for v in "abc") + f""", w AS (SELECT gq.id, z_a.z AS a, z_b.z AS b, z_c.z AS c FROM gq LEFT JOIN z_a USING (id) LEFT JOIN z_b USING (id) LEFT JOIN z_c USING (id))
SELECT id, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2 THEN {r("(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)", 3)} END AS "index" FROM w""")
def pathfinder_index(spark, d):
    rows = _parts(spark, d)
    wide = rows.select("id")
    for v in "abc":
        wide = wide.join(qaqc.robust_scores(rows, ["zone"], v, "__z").select("id", F.col("__z").alias(v)), "id", "left")
    return _rounded(qaqc.pathfinder_index(wide, "id", ["a", "b", "c"]), "index", digits=3)


@query(f"""WITH {_GQ}, m AS (SELECT zone, [quantile_cont(c, 0.5), quantile_cont(c, 0.9), quantile_cont(c, 0.98)] AS m FROM gq GROUP BY zone)
SELECT id, zone, CAST(len(list_filter(m, lambda q: q <= c)) AS INTEGER) AS class FROM gq JOIN m USING (zone)""")
def anomaly_classes(spark, d):
    return qaqc.anomaly_classes(_parts(spark, d), ["zone"], "c", [0.5, 0.9, 0.98]).select("id", "zone", "class")


# blocks, meshes, transforms

_RPG = economics.revenue_per_grade("g/t", 1800.0, 92.0)


@query(with_("bl") + f""", t AS (SELECT id, z, value / 500 AS g, volume * density AS t FROM bl)
SELECT id, t AS tonnes, g >= 25 / {_RPG!r}::DOUBLE AS is_ore, {r(f"CASE WHEN g >= 25 / {_RPG!r}::DOUBLE THEN t * (g * {_RPG!r}::DOUBLE - 25) ELSE 0 END - t * 4", 2)} AS net FROM t""")
def block_values(spark, d):
    bl = bind.blocks(spark, d).withColumn("value", F.col("value") / 500)
    return _rounded(economics.block_values(bl, _RPG, 25.0, 4.0).select("id", "tonnes", "is_ore", "net"), "net", digits=2)


@query(with_("bl") + f""", t AS (SELECT z, value / 500 AS g, volume * density AS t FROM bl), s AS (SELECT z, sum(t) AS tonnes, sum(t * g) * {_RPG!r}::DOUBLE AS v FROM t GROUP BY z)
SELECT z, tonnes, {r("v", 1)} AS revenue, tonnes * 60 AS cost, {r("v - tonnes * 60", 1)} AS margin FROM s""")
def stope_values(spark, d):
    bl = bind.blocks(spark, d).withColumn("value", F.col("value") / 500)
    return _rounded(economics.stope_values(bl, ["z"], _RPG, 60.0), "revenue", "margin", digits=1)


@query(with_("bl", "pt") + f""", h AS (SELECT x / 5 AS x, y / 5 AS y, 3.0::DOUBLE + id % 10 AS z FROM pt), l AS (SELECT b.x, b.y, min(h.z) AS low FROM (SELECT DISTINCT x, y FROM bl) b JOIN h ON (b.x - h.x) * (b.x - h.x) + (b.y - h.y) * (b.y - h.y) <= 900 GROUP BY b.x, b.y),
k AS (SELECT greatest(value, 0) * volume AS m, coalesce(z + dz / 2 < low, false) AS u FROM bl LEFT JOIN l USING (x, y)) SELECT count(*) FILTER (WHERE u) AS blocks, count(*) AS "of", {r("coalesce(sum(m) FILTER (WHERE u), 0) / sum(m)", 6)} AS metal_share FROM k""")
def below_drilling(spark, d):
    holes = bind.points(spark, d).select(F.col("id").alias("hole"), (F.col("x") / 5).alias("x"), (F.col("y") / 5).alias("y"), (3.0 + F.col("id") % 10).alias("z"))
    return _rounded(economics.below_drilling(bind.blocks(spark, d), holes, "id", 30.0), "metal_share", digits=6)


_AXES = {"x": (0.0, 26.0, 40), "y": (0.0, 26.0, 40)}
_AT = "LEFT JOIN gr ON gr.i = least(greatest(floor({t}.x / 26 + 0.5), 0), 39) AND gr.j = least(greatest(floor({t}.y / 26 + 0.5), 0), 39)"


def _lattice(spark, d):
    return bind.terrain(spark, d).withColumnsRenamed({"i": "ix", "j": "iy"})


@query(with_("pt", "gr") + f" SELECT count(*) AS above, count(*) FILTER (WHERE gr.z >= 3000) AS inside, count(*) FILTER (WHERE gr.z < 3000) AS outside, count(*) FILTER (WHERE gr.z IS NULL) AS no_data FROM pt {_AT.format(t='pt')} WHERE value >= 3000")
def shell_support(spark, d):
    return economics.support(bind.points(spark, d), _lattice(spark, d).withColumnRenamed("z", "value"), _AXES, 3000.0)


@query(with_("co", "gr") + f" SELECT hole, co.x, co.y, co.z, gr.z AS terrain, co.z - gr.z AS \"offset\" FROM co {_AT.format(t='co')}")
def terrain_offsets(spark, d):
    return economics.terrain_offsets(bind.collars(spark, d), _lattice(spark, d).select("ix", "iy", "z"), _AXES)


@query(with_("pt", "gr") + f" SELECT id, pt.x, pt.y, CASE WHEN id % 3 = 0 THEN id ELSE coalesce(gr.z, 0) END::DOUBLE AS z, CASE WHEN id % 3 = 0 THEN 'own' WHEN gr.z IS NOT NULL THEN 'terrain' ELSE 'flat' END AS placed FROM pt {_AT.format(t='pt')}")
def placed_samples(spark, d):
    pts = bind.points(spark, d).select("id", "x", "y", F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("z"))
    return economics.placed_samples(pts, _lattice(spark, d).select("ix", "iy", "z"), _AXES)


@query(f"WITH k AS (SELECT l_returnflag AS model, l_linestatus AS log, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT model, log, n, {r('n / sum(n) OVER (PARTITION BY log)', 6)} AS share FROM k")
def model_agreement(spark, d):
    return _rounded(economics.agreement(bind.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), "share", digits=6)


@query(with_("gr") + f" SELECT CAST(i // 4 AS INTEGER) AS bi, CAST(j // 4 AS INTEGER) AS bj, count(*) AS n, {r('avg(z)')} AS mean, min(z) AS least, max(z) AS most FROM gr GROUP BY 1, 2")
def coarse_grid(spark, d):
    return _rounded(economics.coarse_cells(bind.terrain(spark, d), 4, "z"), "mean")


@query(with_("gr") + f", t AS (SELECT z - size * 150 AS t FROM gr) SELECT count(*) AS cells, {r('avg(t)')} AS mean, min(t) AS least, max(t) AS most, count(*) FILTER (WHERE t < 0) AS negative, sum(greatest(t, 0)) * 100 AS volume FROM t")
def isopach(spark, d):
    gr = bind.terrain(spark, d)
    return _rounded(economics.isopach(gr, gr.withColumn("z", F.col("size") * 150), 10.0), "mean")


@query("""WITH c AS (SELECT p_partkey % 20 AS i, (p_partkey // 20) % 20 AS j, p_partkey // 400 AS k, p_size % 3 AS unit FROM part), o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS t(a, b, c)),
n AS (SELECT unit, i + a AS i, j + b AS j, k + c AS k FROM c, o WHERE i + a BETWEEN 0 AND 19 AND j + b BETWEEN 0 AND 19 AND k + c BETWEEN 0 AND 99),
f AS (SELECT n.unit, count(*) AS faces FROM n LEFT JOIN c USING (i, j, k) WHERE c.unit IS DISTINCT FROM n.unit GROUP BY n.unit)
SELECT c.unit, count(*) AS cells, count(*) * 700.0::DOUBLE AS volume, coalesce(any_value(faces), 0) AS faces, coalesce(any_value(faces), 0) * 350.0::DOUBLE AS band FROM c LEFT JOIN f USING (unit) GROUP BY c.unit""")
def unit_stats(spark, d):
    k = F.col("p_partkey")
    cells = bind.table(spark, d, "part").select((k % 20).alias("i"), (F.floor(k / 20) % 20).alias("j"), F.floor(k / 400).alias("k"), (F.col("p_size") % 3).alias("unit"))
    return economics.unit_stats(cells, (20, 20, 100), 700.0)


def _corner(*xyz):
    return F.struct(*(x.cast("double").alias(n) for x, n in zip(xyz, "xyz")))


@query(f"""WITH t AS (SELECT p_brand, p_partkey % 10 AS px1, p_partkey % 7 AS py1, p_partkey % 5 AS pz1, (p_partkey + 3) % 10 AS qx1, (p_partkey * 3) % 7 AS qy1, (p_partkey + 1) % 5 AS qz1, (p_partkey * 7) % 10 AS wx1, (p_partkey + 2) % 7 AS wy1, (p_partkey * 2) % 5 AS wz1 FROM part),
v AS (SELECT p_brand, {r("abs(sum(px1 * (qy1 * wz1 - qz1 * wy1) + py1 * (qz1 * wx1 - qx1 * wz1) + pz1 * (qx1 * wy1 - qy1 * wx1))) / 6.0::DOUBLE")} AS volume, count(*) AS triangles FROM t GROUP BY p_brand),
p AS (SELECT p_brand, px1 * 100 + py1 * 10 + pz1 AS a, qx1 * 100 + qy1 * 10 + qz1 AS b, wx1 * 100 + wy1 * 10 + wz1 AS c FROM t), e AS (SELECT p_brand, least(a, b) AS p, greatest(a, b) AS q FROM p UNION ALL SELECT p_brand, least(b, c), greatest(b, c) FROM p UNION ALL SELECT p_brand, least(c, a), greatest(c, a) FROM p),
o AS (SELECT p_brand, count(*) FILTER (WHERE k <> 2) AS open_edges FROM (SELECT p_brand, p, q, count(*) AS k FROM e GROUP BY ALL) GROUP BY p_brand) SELECT p_brand, volume, triangles, open_edges FROM v JOIN o USING (p_brand)""")
def mesh_volume(spark, d):
    k = F.col("p_partkey")
    t = bind.table(spark, d, "part").select("p_brand", _corner(k % 10, k % 7, k % 5).alias("a"), _corner((k + 3) % 10, (k * 3) % 7, (k + 1) % 5).alias("b"), _corner((k * 7) % 10, (k + 2) % 7, (k * 2) % 5).alias("c"))
    return _rounded(economics.mesh_volume(t, ["p_brand"]), "volume")


@query(with_("pt") + " SELECT a.id, a.x, a.y FROM pt a JOIN pt b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) / 4 <= 3600 GROUP BY a.id, a.x, a.y HAVING count(*) >= 2")
def search_support(spark, d):
    return economics.supported(bind.points(spark, d).select("id", "x", "y"), "id", 60.0, 2, stretch={"y": 2.0})


_PAIRS = "q AS (SELECT zone, x, y, 2 * (x * 0.8 - y * 0.6) + 5 + id % 3 AS u, 2 * (x * 0.6 + y * 0.8) - 7 + id % 2 AS v FROM pt)"


def _pairs(spark, d):
    x, y, i = F.col("x"), F.col("y"), F.col("id")
    return bind.points(spark, d).select("zone", "x", "y", (2 * (x * 0.8 - y * 0.6) + 5 + i % 3).alias("u"), (2 * (x * 0.6 + y * 0.8) - 7 + i % 2).alias("v"))


@query(with_("pt") + f""", {_PAIRS}, s AS (SELECT zone, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) + var_pop(y) AS s, covar_pop(x, u) + covar_pop(y, v) AS p, covar_pop(x, v) - covar_pop(y, u) AS q, var_pop(u) + var_pop(v) AS t FROM q GROUP BY zone)
SELECT zone, n, {r("sqrt(p * p + q * q) / s")} AS scale, {r("degrees(atan2(q / s, p / s))")} AS rotation, {r("mu - p / s * mx + q / s * my", 2)} AS shift_x, {r("mv - q / s * mx - p / s * my", 2)} AS shift_y, {r("sqrt(greatest(t - (p * p + q * q) / s, 0))", 3)} AS rms FROM s WHERE n >= 3 AND s > 0""")
def similarity_fit(spark, d):
    out = economics.similarity_fit(_pairs(spark, d), ["zone"]).where("n >= 3")
    return _rounded(_rounded(_rounded(out, "scale", "rotation"), "shift_x", "shift_y", digits=2), "rms", digits=3)


@query(with_("pt") + f""", {_PAIRS}, s AS (SELECT zone, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM q GROUP BY zone HAVING count(*) >= 4),
k AS (SELECT zone, n, mx, my, mu, mv, (yy * xu - xy * yu) / (xx * yy - xy * xy) AS a, (xx * yu - xy * xu) / (xx * yy - xy * xy) AS b, (yy * xv - xy * yv) / (xx * yy - xy * xy) AS d, (xx * yv - xy * xv) / (xx * yy - xy * xy) AS e FROM s WHERE xx * yy - xy * xy > 0)
SELECT zone, n, {r("a")} AS a, {r("b")} AS b, {r("mu - a * mx - b * my", 2)} AS c, {r("d")} AS d, {r("e")} AS e, {r("mv - d * mx - e * my", 2)} AS f FROM k""")
def affine_fit(spark, d):
    out = economics.affine_fit(_pairs(spark, d), ["zone"]).where("n >= 4")
    return _rounded(_rounded(out, "a", "b", "d", "e"), "c", "f", digits=2)


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(l_quantity) AS a, ln(l_extendedprice) AS b, ln(CASE WHEN l_discount > 0 THEN l_discount END) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r("(a - (b + c) / 2) * sqrt(2.0 / 3)")} AS z1, {r("(b - c) * sqrt(0.5)")} AS z2 FROM x""")
def pivot_log_ratios(spark, d):
    z = economics.pivot_ilr(["l_quantity", "l_extendedprice", "l_discount"])
    return bind.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(z[0]).alias("z1"), rounded(z[1]).alias("z2"))


# files as people leave them, and the workspace

_FILE = "f AS (SELECT CAST(o_orderkey AS VARCHAR) AS hole_id, CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 4 AS x, CAST((o_orderkey * 91) % 1000 AS DOUBLE) / 8 AS y, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS z, CAST(o_orderkey % 360 AS DOUBLE) AS azimuth, -45.0::DOUBLE - o_orderkey % 40 AS dip, o_orderstatus AS status FROM orders)"


def _collar_file(spark, d):
    """Orders as a file with notes, a decimal comma, no-data codes and letters of Windows-1252."""
    path = bind.shared_path(spark, "collar-file")
    k = F.col("o_orderkey")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    cells = [k.cast("string"), comma(F.format_string("%.2f", ((k * 37) % 1000) / 4)), comma(F.format_string("%.4f", ((k * 91) % 1000) / 8)), F.when(k % 7 == 0, "-9999").otherwise((k % 50).cast("string")), (k % 360).cast("string"), (45 + k % 40).cast("string"), "o_orderstatus", F.lit("Zürich; Süd")]
    quoted = F.concat_ws(";", *cells[:-1], F.concat(F.lit('"'), cells[-1], F.lit('"')))
    head = ["# exported by a survey tool", "Collar table of the Süd licence", "", "Hole_Type;BHID;Easting (m);Northing (m);RL;Azi;Dip;Status;Place"]
    rows = bind.table(spark, d, "orders").select(F.encode(F.concat(F.lit("DD;"), quoted), "iso-8859-1").cast("string").alias("value"))
    top = spark.createDataFrame([(0, "\n".join(head))], "i int, value string").select(F.encode("value", "iso-8859-1").cast("string").alias("value"))
    top.coalesce(1).write.text(f"{path}/a")
    rows.write.text(f"{path}/b")
    return path


@query(f"WITH {_FILE} SELECT hole_id, x, y, z, azimuth, dip, CAST(NULL AS DOUBLE) AS length, 'DD' AS \"Hole_Type\", status AS \"Status\", 'Zürich; Süd' AS \"Place\" FROM f")
def read_collar_file(spark, d):
    """Layout, encoding, decimal commas, header mapping and dip convention decided from the file."""
    from lodestone.sources import rawtables

    path = _collar_file(spark, d)
    layout = rawtables.probe(spark, f"{path}/a", f"{path}/b")
    raw = rawtables.read_raw(spark, f"{path}/*", layout)
    mapping = rawtables.guess_mapping("collars", raw.columns)
    turned = imports.dip_convention(raw.select(rawtables.number_in(F.col(mapping["dip"]), False).alias("d")), "d").first()
    return rawtables.mapped(raw, "collars", mapping, bool(turned and turned.convention == "pos_down"))


def _views(spark, d):
    from lodestone.plans import workspace

    iv, k = bind.intervals(spark, d), F.col("p_partkey")
    part = bind.table(spark, d, "part")
    points = F.sequence(F.lit(1), 3 + F.col("r_regionkey").cast("int"))
    return workspace.publish({
        "collars": workspace.collars(bind.collars(spark, d).withColumnsRenamed({"hole": "hole_id"}).withColumn("purpose", F.col("hole_id") % 3)),
        "survey": workspace.survey(bind.stations(spark, d).withColumnRenamed("hole", "hole_id")),
        "litho": workspace.layer(iv.select(F.col("hole").alias("hole_id"), F.col("from_").alias("from"), F.col("to_").alias("to"), F.col("code").alias("value"), F.col("status").alias("intensity"))),
        "boundaries": workspace.boundaries(bind.table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("licence").alias("kind"), F.array(points, points).alias("parts"))),
        "surface_samples": workspace.surface_samples(part.select(k.alias("sample_id"), (k % 40).alias("x"), F.floor(k / 40).alias("y"), F.col("p_size").alias("Au"), F.col("p_retailprice").alias("Cu"), F.col("p_brand").alias("grid"), F.when(k % 2 == 0, F.col("p_type")).alias("colour")), ["Au", "Cu"], ["grid", "colour"]),
    })


@query(with_("co", "st", "iv") + """ SELECT CAST(c.hole AS VARCHAR) AS hole_id, c.x, c.y, c.hole % 3 AS purpose, s.n AS stations, s.dip, l.metres FROM co c
JOIN (SELECT hole, count(*) AS n, min(dip) AS dip FROM st GROUP BY hole) s USING (hole) JOIN (SELECT hole, sum(to_ - from_) AS metres FROM iv WHERE code = 'R' AND status = 'F' GROUP BY hole) l USING (hole)""")
def workspace_holes(spark, d):
    _views(spark, d)
    return spark.sql("""SELECT c.hole_id, c.x, c.y, c.purpose, s.stations, s.dip, l.metres FROM collars c JOIN (SELECT hole_id, count(*) AS stations, min(dip) AS dip FROM survey GROUP BY hole_id) s USING (hole_id)
JOIN (SELECT hole_id, sum(`to` - `from`) AS metres FROM litho WHERE value = 'R' AND intensity = 'F' GROUP BY hole_id) l USING (hole_id)""")


@query("SELECT r_name AS name, 'licence' AS kind, CAST(NULL AS VARCHAR) AS status, CAST(2 AS INTEGER) AS part_count, CAST(2 * (3 + r_regionkey) AS INTEGER) AS vertex_count FROM region")
def workspace_boundaries(spark, d):
    _views(spark, d)
    return spark.sql("SELECT name, kind, status, part_count, vertex_count FROM boundaries")


@query("""SELECT p_brand AS grid, count(*) AS n, count(*) FILTER (WHERE p_partkey % 2 = 0) AS coloured, max(CAST(p_size AS DOUBLE)) AS au, floor(sum(p_retailprice) * 100 + 0.5) / 100 AS cu FROM part GROUP BY p_brand""")
def workspace_surface_samples(spark, d):
    _views(spark, d)
    return spark.sql("SELECT get_json_object(attrs, '$.grid') AS grid, count(*) AS n, count(get_json_object(attrs, '$.colour')) AS coloured, max(Au) AS au, floor(sum(Cu) * 100 + 0.5) / 100 AS cu FROM surface_samples GROUP BY 1")


@query("SELECT CAST(o_orderkey % 90 * 10 AS DOUBLE) AS \"LINE\", CAST(o_orderkey AS DOUBLE) AS \"STN\", (o_orderkey * 37) % 1000 / 8 AS \"GRID_X\", o_orderstatus AS \"CODE\", CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS \"MX\" FROM orders")
def read_spaced_file(spark, d):
    """Columns that stand apart by runs of spaces, -9999 where there is no value."""
    path = bind.shared_path(spark, "spaced-file")
    k = F.col("o_orderkey")
    gap = F.lit("   ")
    line = F.concat(gap, (k % 90 * 10).cast("string"), gap, k.cast("string"), F.lit(" "), F.format_string("%.3f", ((k * 37) % 1000) / 8), gap, "o_orderstatus", gap, F.when(k % 9 == 0, "-9999").otherwise((k % 50).cast("string")), F.lit("  "))
    spark.createDataFrame([("  LINE    STN   GRID_X  CODE   MX",)], "value string").coalesce(1).write.text(f"{path}/a")
    bind.table(spark, d, "orders").select(line.alias("value")).write.text(f"{path}/b")
    layout = rawtables.probe(spark, f"{path}/a", f"{path}/b")
    return rawtables.typed(rawtables.read_raw(spark, f"{path}/*", layout))


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal FROM supplier), m AS (SELECT max(k) AS k FROM s)
SELECT CAST(s.k AS VARCHAR) AS hole_id, CAST(s.k % 100 AS DOUBLE) AS x, CAST(s.k % 70 AS DOUBLE) AS y, CAST(s.k % 30 AS DOUBLE) AS z, CAST(s.k % 360 AS DOUBLE) AS azimuth, CAST(-60 AS DOUBLE) AS dip, CAST(NULL AS DOUBLE) AS length,
'1' AS "Hole_Azi_Ref", '5' AS "Depth_to_Base", CASE WHEN s.k = m.k THEN 'Süd' ELSE 'north' END AS "Place" FROM s JOIN m ON true""")
def read_ended_file(spark, d):
    """Notes, a header, rows that end in a delimiter; only the last row's bytes tell the encoding."""
    path = bind.shared_path(spark, "ended-file")
    k = F.col("s_suppkey")
    rows = bind.table(spark, d, "supplier")
    last = rows.agg(F.max("s_suppkey")).first()[0]
    cells = [k, k % 100, k % 70, k % 30, k % 360, F.lit(-60), F.lit(1), F.lit(5), F.when(k == last, "Süd").otherwise("north"), F.lit("")]
    head = ["Client: a company", "Datum: local", "Hole,Easting,Northing,RL,Azimuth,Dip,Hole_Azi_Ref,Depth_to_Base,Place"]
    as_written = lambda c: F.encode(c, "iso-8859-1").cast("string").alias("value")
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/a")
    rows.orderBy(k).select(as_written(F.concat_ws(",", *(c.cast("string") for c in cells)))).write.text(f"{path}/b")
    layout = rawtables.probe(spark, f"{path}/a", f"{path}/b")
    raw = rawtables.read_raw(spark, f"{path}/*", layout)
    return rawtables.mapped(raw, "collars", rawtables.guess_mapping("collars", raw.columns))
