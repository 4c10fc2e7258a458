"""Mixing sources to target weights (operator 3); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entitle.llm.shared import NO_ID, WORD, keep, packed, table

#: Words of a block, blocks of an output shard.
BLOCK_WORDS, SHARD_BLOCKS = 64, 1024
#: Weights, dealt to the sources in order of code point, null last, again and again.
WEIGHTS = (3, 1, 2)
#: Words of the mix per word of the input; most words a source may give per word it has.
SHARE, REPEATS = 1.5, 2
#: Parts of a source whose blocks are numbered by themselves; a part's rows meet in one task.
PARTS = 4096
#: Primes; the product of any three exceeds every 64-bit count, so one of them divides no given count.
PRIMES = (67867979, 49979687, 32452843, 15485863)
SEED = 20240817


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``target``: ``share`` of all words dealt by
    weight, none above ``repeats`` times its size, the excess dealt again by weight.

    Water filling in closed form: in order of size / weight, the capped sources are those whose cap lies
    under the level that the rest would get. The rows are one per source, made by an aggregation.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = (sizes.withColumn("weight", F.get(kinds, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
            .withColumn("cap", F.col("source_size") * float(repeats))
            .withColumn("level", F.col("cap") / F.col("weight")))
    by_level = Window.orderBy("level", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.withColumns({
        "left_words": share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    rows = rows.withColumn("here", F.col("left_words") / F.col("left_weight"))
    # the first source whose cap is not reached sets the level for all after it
    final = F.min(F.when(F.col("level") > F.col("here"), F.struct("level", "here"))).over(whole)["here"]
    return rows.withColumn("final", final).select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def permuted(index: Column, count: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. count - 1: a step that has no divisor in common with ``count`` and
    a start, both hashed from ``key``."""
    step = F.coalesce(*[F.when(count % p != 0, F.lit(p)) for p in PRIMES], F.lit(1))
    start = F.pmod(F.xxhash64(F.lit(SEED), key), count)
    return F.pmod(index * (step % count) + start, count)


def _numbered(docs: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents with the range [begin, begin + size) that their words take in their source, and sources
    with their size. A source's rows are dealt to PARTS parts by a hash, parts get offsets from their
    sums, rows from the sum of those before them in the part: no task holds a source."""
    rows = keep(docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
        word_count().alias("size"))
        .withColumn("part", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text_key"), F.lit(PARTS))))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "part").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r")
              .join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part")))
              .select("r.doc_id", "r.source", "r.text_key", "r.size", (F.col("offset") + F.col("ahead")).alias("begin")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return keep(placed), sizes


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their range in their source, sources with target, blocks of the mix).

    The mix has one row per slot: shard, slot, source, block. A shard's slots are dealt to the sources by a
    multinomial draw given the totals: all slots of all sources are shuffled by a pseudorandom permutation,
    so a source gets its target within one block. Slot i of a source holds the block number
    perm(i mod blocks): every block once before any block twice, and none more often than the target asks.
    """
    placed, sizes = _numbered(docs, block_words)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    targets = keep(source_targets(sizes).withColumns({
        "blocks": F.ceil(F.col("source_size") / block_words),
        "slots": F.least(F.round(F.try_divide(F.col("target"), F.col("source_size")) * F.ceil(F.col("source_size") / block_words)),
                         REPEATS * F.ceil(F.col("source_size") / block_words)).cast("long")})
        .withColumn("slots", F.coalesce("slots", F.lit(0).cast("long")))
        .withColumn("first", F.sum("slots").over(order) - F.col("slots")))
    total = targets.agg(F.sum("slots")).first()[0] or 0
    spark = docs.sparkSession
    # slot -> source by equal bins of slots: a source is repeated once for each bin it reaches
    width = max(1, -(-total // 2048))
    bins = targets.where("slots > 0").withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("slots") - 1) / width))))
    slots = (spark.range(0, total, 1, max(8, total // 1_000_000)).withColumn("bin", F.floor(F.col("id") / width)).join(bins, "bin")
             .where((F.col("id") >= F.col("first")) & (F.col("id") < F.col("first") + F.col("slots"))))
    drawn = permuted(F.col("id"), F.lit(max(1, total)), F.lit("shard"))
    nth = F.col("id") - F.col("first")
    mix = slots.select(F.floor(drawn / shard_blocks).alias("shard"), F.pmod(drawn, F.lit(shard_blocks)).alias("slot"), "source",
                       F.floor(nth / F.col("blocks")).alias("round"),
                       permuted(F.pmod(nth, F.col("blocks")), F.col("blocks"), F.col("source")).alias("block"))
    return placed, targets, mix


def spans(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each (document, block of its source) that share words: word range [low, high) of the document."""
    begin, size = F.col("begin"), F.col("size")
    rows = placed.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(begin / block_words), F.floor((begin + size - 1) / block_words))))
    return rows.withColumns({"low": F.greatest(F.lit(0), F.col("block") * block_words - begin),
                             "high": F.least(size, (F.col("block") + 1) * block_words - begin)})


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, text_key.

    Words ``[^\\x20\\x09-\\x0D]+`` stand for tokens. The words of a source, documents in a hashed order, are
    packed into blocks of ``block_words``; a block may hold several documents and a document several
    blocks. The mix (``mixed_blocks``) joins the blocks by (source, block number); ``taken`` counts a
    document's words in it, repeats included, at most twice its size.

    A null text has no words, a null source is a source (last by name), repeated rows are documents of
    their own. An empty table gives no rows. The hashes are fixed, so reruns agree.
    """
    placed, targets, mix = mixed_blocks(docs, block_words, shard_blocks)
    used = mix.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = spans(placed, block_words)
    taken = (pieces.alias("p").join(used.alias("u"), F.col("p.source").eqNullSafe(F.col("u.source"))
                                    & (F.col("p.block") == F.col("u.block")))
             .groupBy("p.doc_id", "p.source", "p.begin")
             .agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken")))
    whole = placed.alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id"))
                                   & F.col("d.source").eqNullSafe(F.col("t.source"))
                                   & (F.col("d.begin") == F.col("t.begin")) & (F.col("d.size") > 0), "left")
    return whole.join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.size", "s.source_size", "s.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"),
        "d.text_key")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: for each round (first use, second use) of a row's blocks a row with the words
    taken in it, joined by spaces, or the text itself if that is all of it. All columns of ``docs`` in their
    order; text, and n_chars if there is one, are set anew. Same cases as ``mix_sources``."""
    placed, _, mix = mixed_blocks(docs, block_words)
    used = mix.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = spans(placed, block_words).alias("p").join(
        used.alias("u"), F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("p.block") == F.col("u.block")))
    lists = (pieces.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text_key", "begin", "size",
                           F.struct("low", "high", "times").alias("piece"))
             .groupBy("id", "text_key", "begin")
             .agg(F.any_value("size").alias("size"), F.sort_array(F.collect_list("piece")).alias("pieces")))
    rows = packed(docs).dropDuplicates(["id", "text_key"])
    both = rows.join(lists, ["id", "text_key"]).withColumn("round", F.explode(F.array(F.lit(1), F.lit(2))))
    both = both.withColumn("pieces", F.filter("pieces", lambda p: p["times"] >= F.col("round")))
    both = both.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["high"] - p["low"]))
    both = both.where("taken > 0").withColumn("words", F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)))
    part = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(
        F.col("words"), (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")))), " ")
    text = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(part)
    new = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return both.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("text_key")
