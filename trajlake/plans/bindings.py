"""The given tables in the shape of capture tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.functions.pose import POSE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as trajectories: clip = label, frame by vec_id, position and quaternion from the first seven floats."""
    e = table(spark, sf_dir, "embeddings")
    f = {i: F.get("embedding", F.lit(i)).cast("double") for i in range(10)}
    frame = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint")
    n = F.sqrt(sum((f[i] * f[i] for i in range(4, 7)), f[3] * f[3]))
    q = [(f[i] / n).alias(c) for i, c in zip(range(3, 7), POSE[3:], strict=True)]
    return e.select(F.col("label").alias("clip"), frame.alias("frame"), "vec_id", f[0].alias("tx"), f[1].alias("ty"), f[2].alias("tz"), *q, (F.col("vec_id") % 7 != 0).alias("valid"), f[7].alias("ox"), f[8].alias("oy"), f[9].alias("oz"))


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signals: clip = user, frame by time, width = value with gaps, flag."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("bigint")
    return e.select(F.col("user_id").alias("clip"), frame.alias("frame"), "event_id", ((us - F.min(us).over(w)) / 1e6).alias("t"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("width"), F.col("event_type").isin("click", "purchase").alias("flag"))


def desc(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec")), e.select(F.col("vec_id").alias("ref"), F.col("embedding").alias("rvec"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traj(spark, sf_dir).select("clip", F.col("vec_id").alias("point_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))


_F = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(10))
TRAJ = f"""traj AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, f0 AS tx, f1 AS ty, f2 AS tz,
    f3 / n AS qw, f4 / n AS qx, f5 / n AS qy, f6 / n AS qz, vec_id % 7 <> 0 AS valid, f7 AS ox, f8 AS oy, f9 AS oz
    FROM (SELECT *, sqrt(f3 * f3 + f4 * f4 + f5 * f5 + f6 * f6) AS n FROM (SELECT vec_id, label, {_F} FROM embeddings)))"""
SIG = """sig AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, CASE WHEN event_id % 9 <> 0 THEN value END AS width, event_type IN ('click', 'purchase') AS flag FROM events)"""
