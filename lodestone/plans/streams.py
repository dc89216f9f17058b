"""Files of the test tables as streams, each with the SQL of its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans import bind
from lodestone.plans.bind import rounded, with_
from lodestone.plans.queries import query, r
from lodestone.streaming import compositor, logs


@query(with_("iv") + f""", s AS (SELECT hole, from_, to_, CASE WHEN value <> 3 THEN value END AS value, CASE WHEN status = 'O' THEN code END AS code FROM iv),
b AS (SELECT *, unnest(range(CAST(floor(from_ / 20) AS BIGINT), CAST(ceil(to_ / 20) AS BIGINT))) AS k FROM s),
w AS (SELECT *, greatest(from_, k * 20) AS a, least(to_, (k + 1) * 20) - greatest(from_, k * 20) AS m FROM b),
t AS (SELECT hole, k, code, sum(m) AS m, min(a) AS f FROM w WHERE code IS NOT NULL GROUP BY hole, k, code),
best AS (SELECT hole, k, arg_min(code, (-m, f, code)) AS code FROM t GROUP BY hole, k)
SELECT CAST(w.hole AS VARCHAR) AS hole, k, min(a) AS from_, max(least(to_, (k + 1) * 20)) AS to_, count(*) AS n, {r("sum(m * value) / sum(m) FILTER (WHERE value IS NOT NULL)")} AS value, any_value(best.code) AS code
FROM w LEFT JOIN best USING (hole, k) GROUP BY w.hole, k""")
def stream_composites(spark, d):
    """Order lines in six files, a hole's rows spread over them, composited to 20 m as the files are read."""
    v = F.col("value")
    rows = bind.intervals(spark, d).select(F.col("hole").cast("string").alias("hole"), "from_", "to_", F.when(v != 3, v).alias("value"), F.when(F.col("status") == "O", F.col("code")).alias("code"), v.alias("__file"))
    path = bind.shared_path(spark, "stream")
    rows.repartition(6, "__file").drop("__file").write.parquet(f"{path}/in")
    keys = compositor.keys_for(bind.table(spark, d, "orders").count())
    source = logs.read_growing(spark, f"{path}/in", "hole string, from_ double, to_ double, value double, code string", files_per_trigger=2)
    compositor.run_to_end(compositor.parts(source, 20.0, ["value"], ["code"], slack=10.0, keys=keys), f"{path}/parts", f"{path}/state")
    parts = spark.read.schema(source.sparkSession.createDataFrame([], compositor.PART).schema).parquet(f"{path}/parts")
    out = compositor.composites(parts.unionByName(compositor.open_parts(spark, f"{path}/state")), ["value"], ["code"])
    return out.withColumn("value", rounded(F.col("value")))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS hole, CASE WHEN event_id % 10 <> 0 THEN CAST(floor((floor(epoch(ts)) - 1704067200) / 60) AS DOUBLE) END AS depth, CASE WHEN event_id % 7 <> 0 THEN floor(value) + 0.5 END AS gamma, CASE WHEN event_type <> 'view' THEN CAST(event_id % 50 AS DOUBLE) END AS density FROM events)
SELECT hole, count(*) AS n, count(*) FILTER (WHERE depth IS NOT NULL) AS usable, count(gamma) AS gamma_n, floor(sum(gamma) * 10 + 0.5) / 10 AS gamma_sum, count(density) AS density_n, max(depth) AS deepest FROM e GROUP BY hole""")
def stream_typed_log(spark, d):
    """Events as a log's text cells, read as a stream into typed readings and summed up by hole."""
    minute = F.floor((F.floor(F.unix_timestamp("ts")) - 1704067200) / 60).cast("string")
    id_ = F.col("event_id")
    raw = bind.table(spark, d, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("BHID"),
        F.when(id_ % 10 != 0, minute).otherwise("surface").alias("DEPTH"),
        F.when(id_ % 7 != 0, F.concat(F.floor("value").cast("string"), F.lit(",5"))).otherwise("").alias("GAMMA"),
        F.when(F.col("event_type") != "view", (id_ % 50).cast("string")).alias("DENS"),
    )
    path = bind.shared_path(spark, "log")
    raw.repartition(4).write.parquet(f"{path}/in")
    stream = logs.read_growing(spark, f"{path}/in", "BHID string, DEPTH string, GAMMA string, DENS string", files_per_trigger=2)
    typed = logs.typed_readings(stream, "BHID", ["GAMMA", "DENS"], depth="DEPTH")
    compositor.run_to_end(typed, f"{path}/out", f"{path}/state")
    got = spark.read.parquet(f"{path}/out")
    return got.groupBy("hole").agg(F.count("*").alias("n"), F.count_if("usable").alias("usable"), F.count("GAMMA").alias("gamma_n"), (F.floor(F.sum("GAMMA") * 10 + 0.5) / 10).alias("gamma_sum"), F.count("DENS").alias("density_n"), F.max("depth").alias("deepest"))
