"""Catalogue lookups, browsing and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entitle.functions.strings import display_name


# Positions numbered together, places of a page block: they bound tasks, not results.
NUMBERED_ROWS, PAGE_ROWS = 100_000, 50


def latest(catalogue: DataFrame) -> DataFrame:
    """One row per id; of repeated ids the last loaded (highest pos) wins."""
    columns = catalogue.columns
    return (catalogue.groupBy("id").agg(F.max_by(F.struct(*columns), "pos").alias("row"))
            .select("row.*"))


def lookup(catalogue: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids with their catalogue row; unknown ids keep nulls."""
    wanted = catalogue.join(ids.select("id").distinct(), "id", "left_semi").select(*catalogue.columns)
    return ids.join(latest(wanted), "id", "left")


def by_category(catalogue: DataFrame, category: str) -> DataFrame:
    return catalogue.where(F.col("category") == category)


def by_state(catalogue: DataFrame, state: str) -> DataFrame:
    return catalogue.where(F.col("state") == state)


def filter_catalogue(catalogue: DataFrame, category: str | None = None, state: str | None = None,
                     occupation: str | None = None) -> DataFrame:
    """All given filters hold; an occupation also matches rows open to all."""
    if category:
        catalogue = by_category(catalogue, category)
    if state:
        catalogue = by_state(catalogue, state)
    if occupation:
        rule = F.lower(F.col("eligibility")["occupation"])
        catalogue = catalogue.where(rule.isin("all", occupation.lower()))
    return catalogue


def occupation_index(catalogue: DataFrame) -> DataFrame:
    """(occupation, id); every row is also listed under ``all``."""
    rule = F.lower(F.col("eligibility")["occupation"])
    return catalogue.select(F.explode(F.array_distinct(F.array(rule, F.lit("all")))).alias("occupation"), "id")


def browse(catalogue: DataFrame, category: str | None = None, state: str | None = None,
           limit: int = 10, offset: int = 0) -> DataFrame:
    """One page in catalogue order, with the total behind it and unassessed score columns."""
    rows = filter_catalogue(catalogue, category, state)
    total = rows.agg(F.count(F.lit(1))).scalar()
    page = rows.orderBy("pos").offset(offset).limit(limit)
    return (
        page.withColumn("total_available", total)
        .withColumn("has_more", F.lit(offset + limit) < F.col("total_available"))
        .withColumn("match_score", F.lit(100.0))
        .withColumn("reason", F.lit("Not assessed while browsing"))
        .withColumn("is_eligible", F.lit(False))
    )


def browse_requests(catalogue: DataFrame, requests: DataFrame) -> DataFrame:
    """One page for each of ``requests`` (request_id, category, state, limit, offset; null filters are open).

    Rows: request_id, place (1-based within all that fit), id, total_available, has_more. Every programme is numbered
    within the four filters it can fall under (all, its category, its state, both). Numbers come from
    counts of blocks of positions and the order within a block, so no filter's rows meet in one task; requests meet
    them by filter and block of PAGE_ROWS places.
    """
    kinds = F.explode(F.array(*[F.struct(
        (F.col("category") if own_category else F.lit(None).cast("string")).alias("_category"),
        (F.col("state") if own_state else F.lit(None).cast("string")).alias("_state"),
        F.lit(2 * own_category + own_state).alias("_kind")) for own_category in (0, 1) for own_state in (0, 1)]))
    rows = catalogue.select("id", "pos", kinds.alias("k")).select("id", "pos", "k.*").withColumn(
        "_block", F.floor(F.col("pos") / NUMBERED_ROWS))
    key = ["_kind", "_category", "_state"]
    sizes = rows.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "total_available": F.sum("_n").over(W.partitionBy(*key))})

    def same(left: str, right: str, *more: str) -> Column:
        both = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in [*key, *more]]
        return reduce(lambda a, b: a & b, both)

    inside = F.row_number().over(W.partitionBy(*key, "_block").orderBy("pos"))
    numbered = (rows.withColumn("_inside", inside).alias("r").join(sizes.alias("s"), same("r", "s", "_block"))
                .select("r.id", *[f"r.{c}" for c in key], (F.col("_before") + F.col("_inside")).alias("place"), "total_available")
                .withColumn("_page", F.floor((F.col("place") - 1) / PAGE_ROWS)))
    asked = requests.select(
        "request_id", "limit", "offset", F.col("category").alias("_category"), F.col("state").alias("_state"),
        (2 * F.col("category").isNotNull().cast("int") + F.col("state").isNotNull().cast("int")).alias("_kind"),
        F.explode(F.sequence(F.floor(F.col("offset") / PAGE_ROWS),
                             F.floor((F.col("offset") + F.col("limit") - 1) / PAGE_ROWS))).alias("_page"))
    place = F.col("n.place")
    return (asked.alias("a").join(numbered.alias("n"), same("a", "n", "_page"))
            .where((place > F.col("a.offset")) & (place <= F.col("a.offset") + F.col("a.limit")))
            .select("a.request_id", "n.place", "n.id", "n.total_available",
                    (F.col("a.offset") + F.col("a.limit") < F.col("n.total_available")).alias("has_more")))


def count_by(catalogue: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return (catalogue.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), column))


def category_list(catalogue: DataFrame) -> DataFrame:
    """Categories with count, display name and the number of categories."""
    counts = catalogue.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    total = catalogue.agg(F.countDistinct("category")).scalar()
    return (counts.withColumn("display_name", display_name(F.col("category")))
            .withColumn("total_categories", total))


def summary(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(
        F.count(F.lit(1)).alias("total_schemes"),
        F.countDistinct("category").alias("categories"),
        F.countDistinct("state").alias("states"),
        F.count("embedding").alias("schemes_with_embeddings"),
    )


def storage_report(catalogue: DataFrame) -> DataFrame:
    """Rows and vector bytes for each category and each state, in one pass."""
    sets = catalogue.select("category", "state", F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)).alias("dims"))
    return (sets.groupingSets([["category"], ["state"]], "category", "state")
            .agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("dims") * 4).alias("vector_bytes"))
            .select(F.when(F.col("g") == 1, "category").otherwise("state").alias("kind"),
                    F.when(F.col("g") == 1, F.col("category")).otherwise(F.col("state")).alias("value"), "rows", "vector_bytes"))


def sample(catalogue: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in catalogue order, some columns only."""
    return catalogue.orderBy("pos").limit(n).select(*columns)
