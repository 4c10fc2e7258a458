"""Reading and writing catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitle import schema as D
from entitle.operators import validate as V
from entitle.sources.json_array import array_elements


def load_catalogue(spark: SparkSession, path: str, lines: bool = False, split: bool = False, **validation) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) catalogue rows with their load position; an empty catalogue is refused.

    ``lines=False`` reads documents of the form {"schemes": [...]}, one task per file; positions run on from file
    to file in order of path. ``split=True`` reads the same documents, large ones in several tasks;
    ``lines=True`` reads one programme per line with its ``pos``, as ``write_catalogue`` writes it, and
    splits files as well.
    """
    if lines:
        fields = [*D.CATALOGUE.fields, T.StructField("pos", T.LongType())]
        rows = spark.read.schema(T.StructType(fields)).json(path)
    elif split:
        rows = array_elements(spark, path, "schemes").select(F.from_json("json", D.CATALOGUE).alias("s"), "pos").select("s.*", "pos")
    else:
        wrapper = T.StructType([T.StructField("schemes", T.ArrayType(D.CATALOGUE))])
        documents = spark.read.schema(wrapper).option("multiLine", True).json(path)
        rows = numbered(documents.withColumn("file", F.col("_metadata.file_path")))
    require_rows(rows)
    checked = V.validate_catalogue(rows, **validation)
    return V.split_valid(checked)


def numbered(documents: DataFrame) -> DataFrame:
    """Programmes of ``documents`` (file, schemes) with ``pos``: dense, unique, in order of file and place.

    Files get offsets from their counts, one small row each; the programmes are not sorted."""
    sizes = documents.groupBy("file").agg(F.sum(F.coalesce(F.size("schemes"), F.lit(0)).cast("long")).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = documents.select("file", F.posexplode("schemes").alias("_at", "s"))
    return (placed.join(sizes.select("file", before.alias("_offset")), "file")
            .select("s.*", (F.col("_offset") + F.col("_at")).alias("pos")))


def parsed(texts: DataFrame) -> DataFrame:
    """Programmes of ``texts`` (file, json): catalogue documents held as text."""
    wrapper = T.StructType([T.StructField("schemes", T.ArrayType(D.CATALOGUE))])
    return numbered(texts.select("file", F.from_json("json", wrapper)["schemes"].alias("schemes")))


def require_rows(catalogue: DataFrame) -> DataFrame:
    """Fail early on an empty catalogue."""
    if catalogue.isEmpty():
        raise ValueError("the catalogue is empty")
    return catalogue


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    catalogue.write.mode("overwrite").json(path)


def from_rows(spark: SparkSession, rows: list, schema: T.StructType = D.CATALOGUE) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def replace_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> None:
    """Replace a managed table; the schema may change."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)


def table_or(spark: SparkSession, name: str, fallback: DataFrame) -> DataFrame:
    return spark.table(name) if spark.catalog.tableExists(name) else fallback


def verify_written(written: DataFrame, source: DataFrame) -> DataFrame:
    """One row: counts on both sides and whether they agree."""
    return source.agg(F.count(F.lit(1)).alias("source_rows")).withColumn(
        "written_rows", written.agg(F.count(F.lit(1))).scalar()
    ).withColumn("matches", F.col("source_rows") == F.col("written_rows"))


def as_json(df: DataFrame, *keep: str) -> DataFrame:
    """Rows as JSON text."""
    return df.select(*keep, F.to_json(F.struct(*df.columns)).alias("json"))
