"""What several operators of this subpackage need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys, at most, that ``join_uneven`` takes for hot; a hot key has more rows than HOT_ROWS.
HOT_KEYS, HOT_ROWS = 2000, 64
#: Most rows of one Arrow batch that goes to Python: texts may be long.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, the warehouse's, and a temporary one where all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    elif not base:
        base = tempfile.mkdtemp(prefix="trajlake-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a written table: its lineage ends there, and a lost executor costs nothing of it."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` has written and nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def join_uneven(rows: DataFrame, side: DataFrame, keys: list[str], times: str, salt: Column, broadcast_rows: int = 0) -> DataFrame:
    """``rows`` with what ``side``, a written table of distinct ``keys``, has for them, or null.

    ``times`` says how many of ``rows`` have a key. Keys of more than a HOT_KEYS-th of all rows are
    broadcast, and their rows are spread by ``salt`` through the join of all others, so no
    key fills a task. A ``side`` of ``broadcast_rows`` at most is broadcast whole.
    """
    if broadcast_rows and side.count() <= broadcast_rows:
        return rows.join(F.broadcast(side), keys, "left")
    least = max(HOT_ROWS, (side.agg(F.sum(times)).first()[0] or 0) // HOT_KEYS)
    values = [c for c in side.columns if c not in keys]
    hot = side.where(F.col(times) > least).select(*keys, F.struct(*values).alias("_hot"))
    cold = side.where(F.col(times) <= least).select(*keys, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(salt, F.lit(1 << 20)).cast("int") + 1))
    met = spread.join(cold, [*keys, "_salt"], "left").withColumn("_of", F.coalesce("_hot", "_cold"))
    return met.select("*", *[F.col("_of")[c].alias(c) for c in values]).drop("_hot", "_cold", "_of", "_salt")


def short_batches(spark: SparkSession) -> None:
    """Hands Python at most BATCH_ROWS rows at once, so that long texts don't fill its memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever ``body`` does with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of ``key`` as text, modulo ``modulus``; a null key gives null."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on ``keys`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))
