"""Session and checkpoint helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "entitle", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; a cluster passes its own master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def truncate_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared folder named by ``spark.checkpoint.dir``.

    The copy is reliable: it outlives lost executors. A session that names no folder uses one in its
    warehouse, which executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", f"{warehouse}/checkpoints"))
    return df.checkpoint(eager=True)
