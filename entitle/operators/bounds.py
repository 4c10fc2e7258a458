"""Exact search over unit vectors that scores only what upper bounds leave.

Vectors are sparse, (id, term, weight) of length 1, so a similarity is a sum over common terms. Equal vectors are one
vector with members. Three bounds keep pairs from being formed:

* **Floors.** The heaviest postings of each term give every query some true results at once. What has to
  be beaten from then on is the floor, one number per query.
* **Prefixes.** Of a query's terms, rarest first, only those are looked up without which the rest could still reach
  the floor: the rest is worth at most its weights times the heaviest posting of each term, and at most its length.
* **Bands.** Two unit vectors of similarity s or more have angles to a common axis that differ by acos(s) at most. So a
  query meets only those postings of a term whose weights lie in the bands that this allows.

What is left is scored with whole vectors; no result is lost, whatever the floors.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from entitle.operators.eligibility import by_user, top_ranked
from entitle.operators.joins import fits, small_or_split_join, split_hot_join
from entitle.session import truncate_lineage

#: Bands of weights, and the heaviest postings of a term that are looked at first.
BANDS, CHAMPIONS = 32, 16
#: Similarities are rounded to so many digits before anything is compared.
DIGITS = 4
#: By this much a similarity may be under a floor and still be rounded up to it.
SLACK = 0.6 * 10 ** -DIGITS
#: Pairs of queries and vectors whose sums one task holds at most.
PAIRS = 2_000_000
TABLES = ["postings", "champions", "terms", "members"]


class Impacts(NamedTuple):
    """A corpus for bounded search; ``vec`` is the first item of those with a vector."""

    postings: DataFrame   #: term, band, vec, item_weight
    champions: DataFrame  #: the heaviest postings of each term: term, vec, item_weight
    terms: DataFrame      #: term, df, peak: as many rows as the vocabulary
    members: DataFrame    #: vec, item


def _band(weight: Column) -> Column:
    return F.least(F.floor(weight * BANDS), F.lit(BANDS - 1)).cast("int")


def build_impacts(postings: DataFrame, item_id: str, champions: int = CHAMPIONS) -> Impacts:
    """The tables of ``postings`` (item, term, weight). Vectors are equal when their numbers of terms and two
    order-free sums of 64-bit hashes over terms and weights (12 digits) agree. ``postings`` are read twice, and
    only those of one item per vector are kept."""
    items = postings.select(F.col(item_id).alias("item"), "term", "weight")
    mark = lambda salt: F.xxhash64("term", F.round("weight", 12), F.lit(salt))
    signed = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark(1)).alias("x"), F.sum(mark(2).cast("decimal(20,0)")).alias("s"))
    signed = truncate_lineage(signed.select("item", F.unhex(F.md5(F.concat_ws(" ", "n", "x", "s"))).alias("sign")))
    named = signed.groupBy("sign").agg(F.min("item").alias("vec"))
    members = truncate_lineage(small_or_split_join(signed, named, ["sign"], "item").select("vec", "item"))
    firsts = members.where(F.col("vec") == F.col("item")).select("item")
    rows = small_or_split_join(items, firsts, ["item"], "term").select(
        "term", _band(F.col("weight")).alias("band"), F.col("item").alias("vec"), F.col("weight").alias("item_weight"))
    return _derived(truncate_lineage(by_user(rows, "vec")), members, champions)


def _derived(rows: DataFrame, members: DataFrame, champions: int) -> Impacts:
    best = top_ranked(rows, ["term"], [F.desc("item_weight"), F.col("vec")], champions).select("term", "vec", "item_weight")
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("item_weight").alias("peak"))
    return Impacts(rows, best, terms, members)


def restricted(impacts: Impacts, items: DataFrame, champions: int = CHAMPIONS) -> Impacts:
    """``impacts`` of the given ``items`` (item) alone."""
    members = impacts.members.join(items, "item", "left_semi")
    return _derived(impacts.postings.join(members.select("vec").distinct(), "vec", "left_semi"), members, champions)


def write_impacts(impacts: Impacts, path: str) -> None:
    """The tables as Parquet, postings in order of term and band, so that a search reads few row groups."""
    for name, df in zip(TABLES, impacts):
        df = df.repartitionByRange("term", "band").sortWithinPartitions("term", "band") if name == "postings" else df
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_impacts(spark: SparkSession, path: str) -> Impacts:
    return Impacts(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def _product() -> Column:
    return F.sum(F.col("weight") * F.col("item_weight"))


def _rounded(product: Column) -> Column:
    return F.round(F.least(product, F.lit(1.0)), DIGITS).alias("similarity")


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that sends ``right`` to every task where it fits, and leaves ``left`` where it is then."""
    return left.join(F.broadcast(right) if fits(right) else right, keys, how)


def first_matches(queries: DataFrame, impacts: Impacts, n: int) -> DataFrame:
    """(query_id, vec, similarity): the ``n`` vectors of each query that share most with it by champions alone, with the
    similarity of their whole vectors."""
    shared = queries.join(impacts.champions, "term").groupBy("query_id", "vec").agg(_product().alias("_part"))
    likely = top_ranked(shared, ["query_id"], [F.desc("_part"), F.col("vec")], n).select("query_id", "vec")
    whole = _met(likely.join(queries, "query_id"), impacts.postings.drop("band"), ["vec", "term"])
    return whole.groupBy("query_id", "vec").agg(_rounded(_product())).where("similarity > 0")


def above(queries: DataFrame, floors: DataFrame, impacts: Impacts) -> DataFrame:
    """(query_id, vec, similarity) of all pairs whose similarity is at least the query's ``floor``.

    ``queries`` is (query_id, term, weight), ``floors`` (query_id, floor). A floor of 0 or less bounds nothing: then
    every pair with a common term is scored. Where queries or postings fit, they are sent to every task, and sums of pairs are
    made where the others are, without a shuffle.
    """
    floor = F.greatest(F.col("floor") - SLACK, F.lit(0.0))
    q = queries.join(floors.select("query_id", floor.alias("floor")), "query_id").join(F.broadcast(impacts.terms), "term")
    rarest = W.partitionBy("query_id").orderBy("df", "term").rowsBetween(0, W.unboundedFollowing)
    tail = F.least(F.sum(F.col("weight") * F.col("peak")).over(rarest), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(rarest)))
    q = q.withColumn("_tail", tail * (1 + 1e-9))
    rest = F.max(F.when(F.col("_tail") < F.col("floor"), F.col("_tail"))).over(W.partitionBy("query_id"))
    q = truncate_lineage(q.withColumn("_rest", F.coalesce(rest, F.lit(0.0))).select(
        "query_id", "term", "weight", "floor", "_tail", "_rest"))
    own, reach = F.acos(F.least("weight", F.lit(1.0))), F.acos("floor")
    low, high = F.cos(F.least(own + reach, F.lit(math.pi / 2))), F.cos(F.greatest(own - reach, F.lit(0.0)))
    bands = F.sequence(_band(F.greatest(low - 1e-9, F.lit(0.0))), _band(high + 1e-9))
    needed = q.where(F.col("_tail") >= F.col("floor")).withColumn("band", F.explode(bands)).drop("_tail")
    # so many tasks that each sums up PAIRS pairs at most
    asked, held = floors.count(), impacts.postings.agg(F.approx_count_distinct("vec")).first()[0]
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked * held // PAIRS))
    few = fits(needed)
    if not few and fits(impacts.postings):
        met = needed.repartition(parts, "query_id").join(F.broadcast(impacts.postings), ["term", "band"])
    elif few:
        met = impacts.postings.repartition(parts, "vec").join(F.broadcast(needed), ["term", "band"])
    else:
        met = split_hot_join(by_user(impacts.postings, "vec"), needed, ["term", "band"], "vec")
    pairs = (
        met.groupBy("query_id", "vec").agg(_product().alias("_part"), F.first("_rest").alias("_rest"), F.first("floor").alias("_floor"))
        .where(F.col("_part") + F.col("_rest") + 1e-9 >= F.col("_floor")).select("query_id", "vec", "_part", "_floor")
    )
    # a pair that is left lacks the terms that were not looked up
    others = q.where(F.col("_tail") < F.col("floor")).select("query_id", "term", "weight")
    whole = (_met(_met(pairs, others, ["query_id"], "left"), impacts.postings.drop("band"), ["vec", "term"], "left")
             .groupBy("query_id", "vec").agg(F.first("_part").alias("_part"), F.coalesce(_product(), F.lit(0.0)).alias("_more"),
                                             F.first("_floor").alias("_floor")))
    return (whole.select("query_id", "vec", _rounded(F.col("_part") + F.col("_more")), "_floor")
            .where((F.col("similarity") > 0) & (F.col("similarity") >= F.col("_floor"))).drop("_floor"))


def similar_pairs(queries: DataFrame, items: DataFrame, threshold: float, item_id: str = "doc_id") -> DataFrame:
    """(query_id, item, similarity) of all pairs at or above ``threshold``, which is above 0: equal items are compared once,
    and no pair is formed that shares only terms without which the rest stays below the threshold."""
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    impacts = build_impacts(items, item_id)
    floors = queries.select("query_id").distinct().withColumn("floor", F.lit(float(threshold)))
    found = above(queries, floors, impacts).where(F.col("similarity") >= threshold)
    return found.join(impacts.members, "vec").select("query_id", "item", "similarity")


def best(queries: DataFrame, impacts: Impacts, k: int, threshold: float) -> DataFrame:
    """(query_id, item, similarity, rank): the k most similar items of each query at or above the threshold,
    ties in order of the item."""
    queries = truncate_lineage(queries)
    members = top_ranked(impacts.members, ["vec"], [F.col("item")], k, "_place")
    first = first_matches(queries, impacts, 2 * k).join(members, "vec")
    kth = top_ranked(first, ["query_id"], [F.desc("similarity"), F.col("item")], k).where(F.col("rank") == k)
    floors = (queries.select("query_id").distinct().join(kth.select("query_id", "similarity"), "query_id", "left")
              .select("query_id", F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(float(threshold))).alias("floor")))
    found = above(queries, truncate_lineage(floors), impacts).where(F.col("similarity") >= threshold)
    # of vectors only the first k can have one of the first k items
    found = top_ranked(found, ["query_id"], [F.desc("similarity"), F.col("vec")], k, "_v").drop("_v")
    return top_ranked(found.join(members, "vec").select("query_id", "item", "similarity"),
                      ["query_id"], [F.desc("similarity"), F.col("item")], k)
