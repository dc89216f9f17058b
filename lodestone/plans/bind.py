"""The test tables in the roles of the domain: holes, intervals, stations, points, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.staging import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x, digits: int = 4):
    """Half up; written the same way in the SQL."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines end to end: hole, from_, to_, value (discount in %), code, status."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    to = F.sum("l_quantity").over(w)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole"), (to - F.col("l_quantity")).alias("from_"), to.alias("to_"), F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("value"), F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("status"))


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals and a copy of those coded R, moved down by half their length."""
    iv = intervals(spark, sf_dir)
    half = (F.col("to_") - F.col("from_")) * 0.5
    moved = iv.where("code = 'R'").withColumns({"from_": F.col("from_") + half, "to_": F.col("to_") + half, "value": F.col("value") + 1})
    return iv.unionByName(moved)


def bins25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 25 units down each hole."""
    ends = intervals(spark, sf_dir).groupBy("hole").agg(F.max("to_").alias("e"))
    return ends.select("hole", F.explode(F.sequence(F.lit(0), F.ceil(F.col("e") / 25).cast("int") - 1)).alias("b")).select("hole", (F.col("b") * 25.0).alias("from_"), (F.col("b") * 25.0 + 25).alias("to_"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hole"), F.sum("l_quantity").over(w).alias("depth"), ((37 * F.col("l_linenumber") + F.col("l_partkey")) % 360).cast("double").alias("azimuth"), (-45.0 - F.col("l_suppkey") % 30).alias("dip"))


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("hole"), ((k * 37) % 1000).cast("double").alias("x"), ((k * 91) % 1000).cast("double").alias("y"), (k % 50).cast("double").alias("z"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: hole = user, depth = minutes since 2024-01-01."""
    minutes = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 60).cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("hole"), minutes.alias("depth"), "value", F.col("event_type").alias("code"), "event_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on a plane."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 379) % 1009).cast("double").alias("x"), ((k * 613) % 1013).cast("double").alias("y"), F.floor(F.col("s_acctbal")).cast("double").alias("value"), F.col("s_nationkey").alias("zone"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of a grid 40 wide, with a height without ties nearby."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % 40).cast("int").alias("i"), F.floor(k / 40).cast("int").alias("j"), ((k * 7919) % 10007).cast("double").alias("z"), F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("zone"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), ((k % 20) * 10.0).alias("x"), ((F.floor(k / 20) % 20) * 10.0).alias("y"), (F.floor(k / 400) * 7.0).alias("z"), F.lit(7.0).alias("dz"), F.lit(700.0).alias("volume"), F.floor("p_retailprice").cast("double").alias("value"), (2.0 + F.col("p_size") % 8 * 0.25).alias("density"))


#: The same roles as common table expressions for DuckDB.
SQL = {
    "iv": """iv AS (
  SELECT l_orderkey AS hole, sum(l_quantity) OVER w - l_quantity AS from_, sum(l_quantity) OVER w AS to_,
         floor(l_discount * 100 + 0.5) AS value, l_returnflag AS code, l_linestatus AS status
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "ov": "ov AS (SELECT hole, from_, to_, value, code FROM iv UNION ALL SELECT hole, from_ + (to_ - from_) * 0.5, to_ + (to_ - from_) * 0.5, value + 1, code FROM iv WHERE code = 'R')",
    "b25": "b25 AS (SELECT hole, b * 25.0::DOUBLE AS from_, b * 25.0::DOUBLE + 25 AS to_ FROM (SELECT hole, unnest(range(CAST(ceil(max(to_) / 25) AS BIGINT))) AS b FROM iv GROUP BY hole))",
    "isl": """isl AS (
  SELECT hole, code, min(from_) AS from_, max(to_) AS to_, count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY hole ORDER BY from_, to_ ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN lag(code) OVER (PARTITION BY hole ORDER BY from_, to_) IS NOT DISTINCT FROM code THEN 0 ELSE 1 END AS fresh FROM iv))
  GROUP BY hole, run, code)""",
    "st": """st AS (
  SELECT l_orderkey AS hole, sum(l_quantity) OVER w AS depth, CAST((37 * l_linenumber + l_partkey) % 360 AS DOUBLE) AS azimuth, -45.0::DOUBLE - l_suppkey % 30 AS dip
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "co": "co AS (SELECT o_orderkey AS hole, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS x, CAST((o_orderkey * 91) % 1000 AS DOUBLE) AS y, CAST(o_orderkey % 50 AS DOUBLE) AS z FROM orders)",
    "rd": "rd AS (SELECT user_id AS hole, CAST(floor((floor(epoch(ts)) - 1704067200) / 60) AS DOUBLE) AS depth, value, event_type AS code, event_id FROM events)",
    "pt": "pt AS (SELECT s_suppkey AS id, CAST((s_suppkey * 379) % 1009 AS DOUBLE) AS x, CAST((s_suppkey * 613) % 1013 AS DOUBLE) AS y, floor(s_acctbal) AS value, s_nationkey AS zone FROM supplier)",
    "gr": "gr AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS i, CAST(p_partkey // 40 AS INTEGER) AS j, CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS z, CAST(p_size AS DOUBLE) AS size, p_brand AS zone FROM part)",
    "bl": "bl AS (SELECT p_partkey AS id, (p_partkey % 20) * 10.0::DOUBLE AS x, ((p_partkey // 20) % 20) * 10.0::DOUBLE AS y, (p_partkey // 400) * 7.0::DOUBLE AS z, 7.0::DOUBLE AS dz, 700.0::DOUBLE AS volume, floor(p_retailprice) AS value, 2.0::DOUBLE + p_size % 8 * 0.25::DOUBLE AS density FROM part)",
}


def with_(*names: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(SQL[n] for n in names)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder."""
    return fresh_dir(spark, name)
