"""Input tables of the jobs, derived from the driver's parquet tables (whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entitle.operators.joins import dealt

#: Words of a supplier's search text.
QUERY_WORDS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("user_id"),
        (key % 90).cast("int").alias("age"),
        F.round(F.abs("c_acctbal") * 120, 0).alias("income"),
        F.when(key % 5 == 0, "General").when(key % 5 == 1, "OBC").when(key % 5 == 2, "SC")
        .when(key % 5 == 3, "ST").otherwise("Minority").alias("category"),
        F.when(segment == "FURNITURE", "student").when(segment == "MACHINERY", "farmer")
        .when(segment == "HOUSEHOLD", "unemployed").when(segment == "AUTOMOBILE", "self-employed")
        .otherwise("employed").alias("occupation"),
        F.col("n_name").alias("state"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, kind = F.col("pos"), F.col("p_size") % 8, F.col("p_type")
    age = (F.when(k % 8 == 0, "All").when(k % 8 == 1, "18+").when(k % 8 == 2, "18-25")
           .when(k % 8 == 3, "60+").when(k % 8 == 4, "16-35").when(k % 8 == 5, "< 18")
           .when(k % 8 == 6, "21").otherwise("All for disabled, 60+ for others"))
    income = (F.when(size == 1, "BPL families").when(size == 2, "< 2.5 lakh").when(size == 3, "< 5 lakh")
              .when(size == 4, "< ₹8,00,000").when(size == 5, "Low income").when(size == 6, "< 1 crore")
              .otherwise("All"))
    category = (F.when(k % 7 == 0, "All").when(k % 7 == 1, "SC/ST").when(k % 7 == 2, "OBC")
                .when(k % 7 == 3, "Minority communities").when(k % 7 == 4, "General")
                .when(k % 7 == 5, "Small farmers").otherwise("OBC, SC"))
    occupation = (F.when(kind == "ECONOMY", "student").when(kind == "SMALL", "farmer")
                  .when(kind == "MEDIUM", "entrepreneur").when(kind == "PROMO", "jobless").otherwise("All"))
    documents = (F.when(k % 3 == 0, "Identity card,Income certificate")
                 .when(k % 3 == 1, " Identity card ,, Marksheet,Identity card")
                 .otherwise("Ration card,   "))
    return (
        table(spark, sf_dir, "part").withColumn("pos", F.col("p_partkey")).select(
            "pos",
            F.concat(F.lit("s-"), k.cast("string")).alias("id"),
            F.concat_ws(" ", "p_name", "p_brand").alias("name"),
            F.concat_ws(" ", "p_brand", "p_name", F.lower("p_type")).alias("description"),
            F.struct(age.alias("age"), income.alias("income"), category.alias("category"),
                     occupation.alias("occupation")).alias("eligibility"),
            F.split(documents, ",").alias("documents"),
            F.when(k % 3 == 0, "Central").otherwise(
                F.concat(F.lit("NATION_"), (k % 25).cast("string"))).alias("state"),
            F.lower("p_type").alias("category"),
            F.concat_ws(" ", "p_name", F.lower("p_type")).alias("keywords"),
        )
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id, scheme_id): every part a customer ever ordered."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ordered = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("s-"), F.col("l_partkey").cast("string")).alias("scheme_id"),
    )
    return dealt(ordered, items.count(), "user_id", "scheme_id").distinct()


def scheme_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search text per supplier: how often it delivers what, the six commonest words and kinds first.

    All of a supplier's deliveries count. Words are few (those of part names and types), so a supplier has a
    short list of counts, from which the text takes the most telling ones."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    words = F.explode(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand"))))
    counts = (items.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .select(F.col("l_suppkey").alias("query_id"), words.alias("word"))
              .groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n")))
    ranked = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("r", ranked).where(F.col("r") <= QUERY_WORDS)
    return best.groupBy("query_id").agg(F.array_join(
        F.array_sort(F.collect_list(F.struct("r", "word")))["word"], " ").alias("query"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"),
        F.col("label").cast("string").alias("category"))


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("operation"),
        (F.col("value") * 10).alias("duration_ms"), (F.col("event_type") != "error").alias("success"), "props")
