"""Join building blocks: hot keys are split, substring tests become equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY_ROWS = 500_000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Rows of a task where they are dealt by number: keys shrink so much in a shuffle that partitions of equal bytes hold millions.
TASK_ROWS = 500_000


def split_hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread_on: str,
                   how: str = "inner", hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Equi join whose hot ``left`` keys are spread over several tasks.

    Keys with more than ``hot_rows`` left rows get ceil(rows / hot_rows) salts. Left rows take a salt
    from a hash of ``spread_on`` (the same after a retry), matching right rows are repeated once per
    salt. The list of hot keys has at most rows / hot_rows entries. No join is forced to broadcast.
    ``left`` is read once more to count, so this is for plain tables; a computed left side is better
    left to the adaptive skew join.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = (
        left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    salted_left = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_on), salts).cast("int"))
        .drop("_salts")
    )
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, all else by eight bytes."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        if kind == "string":
            total = total + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "array<string>":
            total = total + F.coalesce(F.octet_length(F.array_join(name, " ")), F.lit(0))
        else:
            total = total + 8
    return total


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a count finds at most ``max_rows`` rows and ``max_bytes`` bytes, so that ``df`` may be sent to every task."""
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return size.n <= max_rows and size.b <= max_bytes


def small_or_split_join(left: DataFrame, right: DataFrame, keys: list[str], spread_on: str,
                        max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner equi join that sends ``right`` to every task only after counting at most ``max_rows`` rows and
    ``max_bytes`` bytes in it, and splits hot keys otherwise."""
    if fits(right, max_rows, max_bytes):
        return left.join(F.broadcast(right), keys)
    return split_hot_join(left, right, keys, spread_on)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when they come in fewer partitions than that; larger inputs stay put.

    Looks at the number of partitions only, so nothing runs and no list reaches the driver."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of ``rows`` rows at most, by ``keys`` in tasks of TASK_ROWS; as it is where all cores together take that many."""
    if rows <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)


def _grams(text: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - width + 1),
                       lambda i: F.substring(text, i, width))


def substring_link(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str,
                   width: int = 3) -> DataFrame:
    """All (needle, haystack) pairs with the needle inside the haystack; exact, no cross product.

    Both inputs are reduced to distinct non-empty values. A needle is keyed by its first ``width``
    characters (all of it when shorter), a haystack by every piece of 1..width characters.
    """
    n = needles.select(needle).where(F.length(needle) > 0).distinct()
    n = n.withColumn("_gram", F.substring(F.col(needle), F.lit(1), F.lit(width)))
    h = haystacks.select(haystack).where(F.length(haystack) > 0).distinct()
    # pieces of lengths that no needle has would meet nothing
    found = [r[0] for r in n.select(F.length("_gram")).distinct().collect()]  # 1 .. width
    lengths = F.filter(F.array(*[F.lit(i) for i in sorted(found)]).cast("array<int>"), lambda w: w <= F.length(haystack))
    grams = F.array_distinct(F.flatten(F.transform(lengths, lambda w: _grams(F.col(haystack), w))))
    h = h.withColumn("_gram", F.explode(grams))
    return n.join(h, "_gram").where(F.col(haystack).contains(F.col(needle))).select(needle, haystack)
