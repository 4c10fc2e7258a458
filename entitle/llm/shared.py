"""Intermediate tables in the shared folder, and inputs of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in the dialects of Java and of DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that goes to Python.
BATCH_ROWS = 1000
#: Stands for a null doc_id inside the operators.
NO_ID = -(1 << 63)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: later stages survive lost executors
    and do not run it again. One folder for each application, to be deleted after it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands whole texts to Python in batches of BATCH_ROWS rows at most, so that neither
    side of a worker holds many megabytes at once."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """id, text_key and text of every row, and the columns named. A null doc_id counts as the smallest of
    all ids, a null text as empty. Rows that share an id but not a text keep apart by ``text_key``, the
    64-bit hash of the text; rows that share both are one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                                      F.xxhash64(text).alias("text_key"), text.alias("text"), *more)


def compact(texts: DataFrame) -> DataFrame:
    """``texts`` of ``keyed`` with a constant text_key where no id is repeated: then ids alone tell rows apart, and
    rows derived from them are a quarter smaller. Counts ids only; nothing else depends on the outcome."""
    twice = texts.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return texts.withColumn("text_key", F.lit(0).cast("long")) if twice.isEmpty() else texts


def doc_id(column: str = "id") -> Column:
    """The doc_id behind an ``id``."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as the struct ``row``, whatever its columns are called, with its id and text_key."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), *more)


def rows_of(docs: DataFrame, chosen: DataFrame, how: str = "left_semi", once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (id, text_key) is in ``chosen`` (left_anti: is not), all columns in their
    order; ``once``: one row of those that share both."""
    found = packed(docs).join(chosen.select("id", "text_key"), ["id", "text_key"], how)
    return (found.dropDuplicates(["id", "text_key"]) if once else found).select("row.*")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that the adaptive skew join can split, whatever ``right`` is. A grouped ``right`` is already dealt
    by ``keys``, and Spark then would not read a hot key's rows of ``left`` in several tasks; one more key, a
    bit of the first, makes it deal both sides anew. ``right`` is the smaller side, with few rows per key."""
    bit = F.xxhash64(keys[0]).bitwiseAND(F.lit(1))
    return left.withColumn("_bit", bit).join(right.withColumn("_bit", bit), ["_bit", *keys], how).drop("_bit")
