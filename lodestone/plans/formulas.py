"""Formulas over the test tables and breaks in their quantile plots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import formula
from lodestone.operators import stats
from lodestone.plans import bind
from lodestone.plans.bind import rounded, with_
from lodestone.plans.queries import query

FORMULAS = {
    "sum": "size + [retail price] * 2",
    "signs": "-size ^ 2 + 2 ^ -1 ^ 2 - +3",
    "ratio": "[retail price] / (size - 10)",
    "left": "[retail price] % 7 - size % 4",
    "least": "min(size, key % 11, 9)",
    "whole": "round([retail price] / 8) + floor(-size / 3) + ceil(size / 3)",
    "logs": "log10(size - 5) + sqrt(size - 20) * 0",
    "pick": "if(size > 25 and not (key % 2 = 0), [retail price], if(size < 5 or size >= 45, -1, 0))",
    "digits": "brand_no * 2 + 1",
    "flag": "(size <> 7) && key / 0 < 1 || size = 30",
}


def _parts(spark, d):
    part = bind.table(spark, d, "part")
    k = F.col("p_partkey")
    number = F.when(k % 5 != 0, F.substring("p_brand", 7, 2)).when(k % 10 == 0, "n/a")
    return part.select(k.alias("key"), F.when(k % 13 != 0, F.col("p_size")).alias("size"), F.floor("p_retailprice").cast("double").alias("retail price"), F.concat(F.lit(" "), number).alias("brand_no"), F.col("p_brand").alias("brand"))


_PARTS = """WITH p AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) END AS size, floor(p_retailprice) AS price,
CASE WHEN p_partkey % 5 <> 0 THEN substr(p_brand, 7, 2) WHEN p_partkey % 10 = 0 THEN 'n/a' END AS number, p_brand AS brand FROM part)"""


@query(_PARTS + """ SELECT key, size + price * 2 AS sum, -(size * size) + 0.5::DOUBLE - 3 AS signs, CASE WHEN size <> 10 THEN floor(price / (size - 10) * 1e6 + 0.5) / 1e6 END AS ratio, price % 7 - size % 4 AS left,
CASE WHEN size IS NOT NULL THEN least(size, key % 11, 9) END AS least, floor(price / 8 + 0.5) + floor(-size / 3) + ceil(size / 3) AS whole,
CASE WHEN size >= 20 THEN floor(log10(size - 5) * 1e6 + 0.5) / 1e6 END AS logs,
CASE WHEN size > 25 AND key % 2 = 1 THEN price WHEN size IS NULL AND key % 2 = 1 THEN NULL WHEN size < 5 OR size >= 45 THEN -1 WHEN size IS NULL THEN NULL ELSE 0 END AS pick,
TRY_CAST(number AS DOUBLE) * 2 + 1 AS digits, CASE WHEN size = 30 THEN 1.0::DOUBLE WHEN size = 7 THEN 0.0::DOUBLE END AS flag FROM p""")
def formula_columns(spark, d):
    out = formula.calculate(_parts(spark, d), FORMULAS)
    near = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return out.select("key", *(near(n) if n in ("ratio", "logs") else F.col(f"`{n}`") for n in FORMULAS))


@query(_PARTS + """ SELECT key, CASE WHEN size >= 40 THEN 'big' WHEN size < 40 THEN lower(brand) END AS code, CASE WHEN size IS NULL THEN NULL WHEN size > 25 THEN CAST(CAST(size AS INT) AS VARCHAR) ELSE 'low' END AS mixed,
lower(brand) = 'brand#13' AS same, CASE WHEN number IS NULL THEN NULL WHEN number = 'n/a' THEN false ELSE CAST(number AS INT) > 30 END AS above FROM p""")
def formula_codes(spark, d):
    p = _parts(spark, d).withColumn("brand", F.lower("brand"))
    texts = {"code": "if(size >= 40, 'big', brand)", "mixed": "if(size > 25, size, 'low')", "same": "brand = ' BRAND#13 '", "above": "if(brand_no = 'N/A', 1 > 2, brand_no > 30)"}
    return formula.calculate(p, texts, texts=True).select("key", *texts)


def _assays(spark, d):
    """Line items as assays: Fe in %, Cu in ppm with values below detection, Si in %."""
    iv = bind.intervals(spark, d)
    v = F.col("value")
    return iv.select("hole", "from_", F.when(v != 9, v * 5).alias("Fe"), F.when(v < 3, 3.0).otherwise(v * 100).alias("Cu"), F.when(v < 3, "<").alias("Cu_q"), (v - 4).alias("Si"), F.when((v < 3) & (F.col("code") == "R"), "<").alias("Fe_q"))


_UNITS = {"Fe": "%", "Cu": "ppm", "Si": "%"}
_ASSAYS = with_("iv") + ", a AS (SELECT hole, from_, code, CASE WHEN value <> 9 THEN value * 5 END AS fe, CASE WHEN value < 3 THEN 3.0::DOUBLE ELSE value * 100 END AS cu, value < 3 AS cub, value < 3 AND code = 'R' AS feb, value - 4 AS si FROM iv)"


@query(_ASSAYS + """ SELECT hole, from_, CASE WHEN NOT cub AND NOT feb AND fe <> 0 THEN floor(cu / fe * 1e6 + 0.5) / 1e6 END AS ratio, CAST(NULL AS VARCHAR) AS ratio_q,
CASE WHEN cub OR feb THEN 'below detection' WHEN fe IS NULL THEN 'missing' WHEN fe = 0 THEN 'no number' END AS ratio_why,
floor((fe * 10000 + cu) * 1e6 + 0.5) / 1e6 AS metal, CASE WHEN fe IS NOT NULL AND cub AND feb THEN '<' END AS metal_q, CASE WHEN fe IS NULL THEN 'missing' END AS metal_why,
floor(si * 2.1392 * 1e6 + 0.5) / 1e6 AS silica FROM a""")
def calculated_elements(spark, d):
    a = formula.calculated_element(_assays(spark, d), "ratio", "Cu / Fe", _UNITS)
    a = formula.calculated_element(a, "metal", "Fe + Cu", _UNITS, {"Fe": "ppm"})
    a = formula.calculated_element(a, "silica", "SiO2", _UNITS)
    near = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return a.select("hole", "from_", near("ratio"), "ratio_q", "ratio_why", near("metal"), "metal_q", "metal_why", near("silica"))


@query(_ASSAYS + """, v AS (SELECT *, NOT cub AND NOT feb AS free, cu / nullif(fe, 0) AS r FROM a)
SELECT count(r) FILTER (WHERE free) AS computed, CAST(0 AS BIGINT) AS flagged, count(*) FILTER (WHERE free AND fe IS NULL) AS missing, count(*) FILTER (WHERE free AND fe = 0) AS no_number, count(*) FILTER (WHERE NOT free) AS below,
floor(min(r) FILTER (WHERE free) * 1e6 + 0.5) / 1e6 AS least, floor(max(r) FILTER (WHERE free) * 1e6 + 0.5) / 1e6 AS most FROM v""")
def calculated_outcome(spark, d):
    out = formula.outcome(formula.calculated_element(_assays(spark, d), "ratio", "Cu / Fe", _UNITS), "ratio")
    near = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return out.select("computed", "flagged", "missing", "no_number", "below", near("least"), near("most"))


@query("SELECT unnest(['Fe + Cu', 'Cu / Fe']) AS formula")
def stale_formulas(spark, d):
    """Formulas to work out again after one value of Cu has changed and a formula of Si alone hasn't."""
    a = _assays(spark, d)
    made = formula.signatures(a, ["Fe + Cu", "Cu / Fe", "Si * 2"])
    now = a.withColumn("Cu", F.when((F.col("hole") == 1) & (F.col("from_") == 0), F.col("Cu") + 1).otherwise(F.col("Cu")))
    return spark.createDataFrame([(f,) for f in formula.stale(now, {f: (f, s) for f, s in made.items()})], "formula string")


@query(with_("bl") + """, a AS (SELECT x, y, z, min(value) AS v FROM bl GROUP BY x, y, z), b AS (SELECT x, y, z, min(density) AS v FROM bl WHERE id % 3 <> 0 GROUP BY x, y, z)
SELECT a.x, a.y, a.z, floor(a.v * b.v / nullif(b.v - 2.5, 0) * 1e6 + 0.5) / 1e6 AS value, CAST(1 + (b.v IS NOT NULL)::INT AS INT) AS inputs FROM a LEFT JOIN b USING (x, y, z)""")
def block_formula(spark, d):
    b = bind.blocks(spark, d)
    models = {"Fe": b.select("x", "y", "z", "value"), "sg": b.where("id % 3 <> 0").select("x", "y", "z", F.col("density").alias("value")), "other": b.select("x", "y", "z", "value")}
    out = formula.block_formula(models, "Fe * sg / (sg - 2.5)")
    return out.withColumn("value", F.floor(F.col("value") * 1e6 + 0.5) / 1e6)


@query("""WITH p AS (SELECT c_mktsegment AS code, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS DOUBLE) AS x, power(c_acctbal / 1000, 3) AS y FROM customer),
m AS (SELECT *, x - avg(x) OVER () AS u, y - avg(y) OVER () AS v FROM p),
q AS (SELECT code, x, row_number() OVER w - 1 AS k, count(*) OVER g AS n, sum(u) OVER w - u AS a1, sum(v) OVER w - v AS a2, sum(u * u) OVER w - u * u AS a3, sum(u * v) OVER w - u * v AS a4, sum(v * v) OVER w - v * v AS a5,
  sum(u) OVER g AS t1, sum(v) OVER g AS t2, sum(u * u) OVER g AS t3, sum(u * v) OVER g AS t4, sum(v * v) OVER g AS t5 FROM m WINDOW w AS (PARTITION BY code ORDER BY x, y), g AS (PARTITION BY code)),
f AS (SELECT code, x, k, n, a3 - a1 * a1 / k AS lxx, a4 - a1 * a2 / k AS lxy, a5 - a2 * a2 / k AS lyy, t3 - a3 - (t1 - a1) * (t1 - a1) / (n - k) AS hxx, t4 - a4 - (t1 - a1) * (t2 - a2) / (n - k) AS hxy, t5 - a5 - (t2 - a2) * (t2 - a2) / (n - k) AS hyy,
  t3 - t1 * t1 / n AS wxx, t4 - t1 * t2 / n AS wxy, t5 - t2 * t2 / n AS wyy FROM q WHERE k >= 8 AND n - k >= 8)
SELECT code, n, k, x AS at, floor((lyy - lxy * lxy / lxx + hyy - hxy * hxy / hxx) * 10 + 0.5) / 10 AS sse, floor((wyy - wxy * wxy / wxx) * 10 + 0.5) / 10 AS sse_one, floor(lxy / lxx * 1e4 + 0.5) / 1e4 AS slope_low, floor(hxy / hxx * 1e4 + 0.5) / 1e4 AS slope_high
FROM f QUALIFY row_number() OVER (PARTITION BY code ORDER BY lyy - lxy * lxy / lxx + hyy - hxy * hxy / hxx, k) = 1""".replace(" AS at,", ' AS "at",'))
def quantile_breaks(spark, d):
    """Where the cubes of the ordered balances of each segment bend."""
    c = bind.table(spark, d, "customer")
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey"))
    out = stats.two_segment_break(c.select(F.col("c_mktsegment").alias("code"), rank.alias("x"), F.pow(F.col("c_acctbal") / 1000, F.lit(3.0)).alias("y")), "x", "y", ["code"])
    return out.withColumns({"sse": rounded(F.col("sse"), 1), "sse_one": rounded(F.col("sse_one"), 1), "slope_low": rounded(F.col("slope_low")), "slope_high": rounded(F.col("slope_high"))})
