"""A training corpus in five stages: languages, exact copies, near copies, source mix, packing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajlake.llm.common import cut, scratch
from trajlake.llm.exact_dedup import exact_dedup
from trajlake.llm.language_id import UNKNOWN, identify
from trajlake.llm.mixing import mix_sources
from trajlake.llm.ngram_join import BROADCAST_IDS, ngram_join
from trajlake.llm.packing import pack
from trajlake.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Files whose numbers are broadcast, at most: 16 bytes each.
BROADCAST_FILES = 1_000_000
#: Buckets in which file names are ranked; tasks, at most, that the rows of one file are dealt to where they are shuffled.
FILE_BUCKETS, FILE_PLACES = 4096, 64


def _numbered(files: DataFrame, tag: str) -> DataFrame:
    """_file, _h (its hash), _k (a number of its own) of ``files`` (_file). Names are ranked within buckets of a hash, so no task holds them all."""
    named = files.withColumn("_h", F.xxhash64("_file")).withColumn("_bucket", F.pmod("_h", F.lit(FILE_BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_file")) - 1
    return cut(named.select("_file", "_h", (rank.cast("bigint") * FILE_BUCKETS + F.col("_bucket")).alias("_k")), tag)


def _keyed(docs: DataFrame, tag: str) -> DataFrame:
    """``docs`` with ``_row``: a key of each row's own, as ids may repeat or be null.

    Rows of written files have their place in them, which no reading changes; others are written first.
    File numbers are broadcast by the hash of the name, so texts aren't shuffled; beyond
    BROADCAST_FILES, or where two names have one hash, rows are dealt by name and place.
    """
    try:
        placed = docs.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return cut(docs.withColumn("_row", F.monotonically_increasing_id()), tag)
    files = _numbered(docs.select(F.col("_metadata.file_path").alias("_file")).distinct(), tag)
    n, hashes = files.agg(F.count("*"), F.count_distinct("_h")).first()
    if n == hashes and n <= BROADCAST_FILES:
        met = placed.withColumn("_h", F.xxhash64("_file")).join(F.broadcast(files.select("_h", "_k")), "_h")
    else:
        places = files.select("_file", "_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(FILE_PLACES - 1).cast("bigint"))).alias("_place"))
        met = placed.withColumn("_place", F.col("_at") % FILE_PLACES).join(places, ["_file", "_place"])
    return met.withColumn("_row", F.col("_k") * (1 << 36) + F.col("_at")).select(*COLUMNS, "_row")


def _with_id(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``_id``: ids first, then rows."""
    return keyed.withColumn("_id", F.struct("doc_id", "_row"))


def _without(keyed: DataFrame, gone: DataFrame, tag: str) -> DataFrame:
    """``keyed`` without the rows whose ``_row`` is in ``gone``, and without ``_row``."""
    gone = cut(gone, tag)
    return keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "_row", "left_anti").select(COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language: null ones and those without a letter. Each row counts for itself, whatever its id; an empty table stays empty."""
    keyed = _keyed(docs, "rows")
    rejected = identify(keyed, id_col="_row").where(F.col("lang_pred") == UNKNOWN).select(F.col("doc_id").alias("_row"))
    return _without(keyed, rejected, "rejected")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the document with the largest id (a null one is the smallest), one row of it. Null counts as the empty text; an empty table stays empty."""
    keyed = _keyed(docs, "rows")
    gone = exact_dedup(_with_id(keyed), id_col="_id").where("not kept").select("doc_id._row")
    return _without(keyed, gone, "copies")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each component of near copies (five words, 0.8), the document with the smallest id (a null one is the largest), one row of it.

    Texts without words, null ones too, are no copies; rows that repeat an id are compared as others are; an empty table stays empty.
    """
    keyed = _keyed(docs, "rows")
    found = ngram_join(keyed, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    moved = cut(found.where("_row != component_id"), "moved")
    members = moved.unionByName(moved.select(F.col("component_id").alias("_row"), "component_id").distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))
    best = members.join(keyed.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("best")).select("best._row")
    return _without(keyed, members.select("_row").join(best, "_row", "left_anti"), "near")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix wants it: 0, 1 or 2 rows. A null source is one of its own, the last; an empty table stays empty."""
    keyed = _keyed(docs, "rows")
    copies = mix_sources(_with_id(keyed), id_col="_id", drawn_by=lambda key: key["doc_id"]).where("copies > 0").select("doc_id._row", "copies")
    copies = cut(copies, "copies")
    rows = keyed.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "_row")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens. A null text is an empty one; rows that repeat an id are packed each; an empty table gives no piece."""
    return pack(docs, tokenizer_file())


STAGES = [("language_id", languages), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
