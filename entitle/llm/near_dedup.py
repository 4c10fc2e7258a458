"""MinHash near-dedup with odd sketches (operator 7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.kernels import BASES, LOWER, Rolling, mix, signed, text_slices, words
from entitle.llm.shared import doc_id, keep, keyed, rows_of, split_join, table

#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
SHINGLE_WORDS, PERCENT = 5, 80
#: BANDS bands of ROWS MinHash values: two sets at the threshold miss all of them once in 300,000 pairs.
BANDS, ROWS = 32, 5
#: Bits of an odd sketch; pairs of sets that differ in more of them are not confirmed. At the threshold 57
#: bits differ on average, with a standard deviation of 8.5.
SKETCH_BITS, MOST_BITS = 512, 92
#: Members of a bucket that are compared in one task; larger buckets are cut, and PIVOTS of their members
#: stand in every part. What the parts leave apart meets by shared rare shingles.
PART_ROWS, PIVOTS = 512, 32
#: Places of the bits that texts are chosen by before they are shuffled, in words of 64.
WANTED = 1 << 24
#: Places of the table that tells rare shingles from frequent ones; shingles of one place count together.
RARITY = 1 << 18

_random = np.random.default_rng(11)
FACTORS = _random.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)

FEATURES = "id long, text_key long, n long, a long, b long, bands array<long>, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row of a slice the sorted distinct hashes of its shingles; of fewer words than a shingle the
    hash of all of them, of no words nothing."""
    data = LOWER[data]
    w = words(data, offsets)
    hashes = w.hashes(data)
    rolling = Rolling(hashes, BASES[1])
    grams = rolling.all_of(size)
    out = []
    for low, high in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if high - low >= size:
            out.append(np.unique(grams[low:high - size + 1]))
        else:
            out.append(rolling.spans(np.array([low]), np.array([high])) if high > low else np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, 4,096 shingles at a time."""
    least = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    x = mix(shingles)
    x = (x >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 4096):
        values = x[None, i:i + 4096] * FACTORS[:, None] + SHIFTS[:, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the (function, value) samples of each row: equal samples cancel out in an XOR."""
    n, k = least.shape
    bit = mix(least.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    odd = np.zeros((n, SKETCH_BITS), np.uint8)
    np.add.at(odd, (np.repeat(np.arange(n), k), bit.ravel().astype(np.int64)), 1)
    return np.packbits(odd & 1, axis=1)


def _features(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                sets = shingle_sets(data, offsets, size)
                least = np.stack([min_hashes(s) for s in sets])
                rows = least.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS))
                for r in range(ROWS):
                    key = mix(key * np.uint64(BASES[0]) + rows[:, :, r])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), signed(key.ravel()))
                sums = [np.array([mix(s ^ np.uint64(base)).sum(dtype=np.uint64) for s in sets], np.uint64) for base in BASES]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()), signed(sums[0]), signed(sums[1]), bands,
                    pa.array([x.tobytes() for x in odd_sketches(least)], pa.binary())],
                    ["id", "text_key", "n", "a", "b", "bands", "sketch"])
    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i),
                    pa.array([s.tobytes() for s in shingle_sets(data, offsets, size)], pa.binary())], ["node", "shingles"])
    return run


def _close(sketches: np.ndarray, sizes: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Bits in which each member differs from member k; SKETCH_BITS where the sizes rule a link out."""
    bits = np.bitwise_count(sketches ^ sketches[k]).sum(axis=1).astype(np.int64)
    least, most = np.minimum(sizes, sizes[k]), np.maximum(sizes, sizes[k])
    bits[100 * least < percent * most] = SKETCH_BITS
    return bits


def forest_pairs(sketches: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of a bucket to be confirmed: a spanning forest of least differences. If the members are linked at
    all, they are along the forest, but for errors of the estimate; what these leave apart, ``_crossing`` finds."""
    g = len(sizes)
    if g == 2:
        return [(0, 1)] if _close(sketches, sizes, 0, percent)[1] <= MOST_BITS else []
    outside, best, parent = np.ones(g, bool), np.full(g, SKETCH_BITS), np.zeros(g, np.int64)
    pairs: list[tuple[int, int]] = []
    k = 0
    while True:
        outside[k] = False
        bits = _close(sketches, sizes, k, percent)
        bits[k] = SKETCH_BITS
        nearer = outside & (bits < best)
        best[nearer], parent[nearer] = bits[nearer], k
        if not outside.any():
            return pairs
        k = int(np.where(outside, best, SKETCH_BITS + 1).argmin())
        if best[k] <= MOST_BITS:
            pairs.append((min(k, int(parent[k])), max(k, int(parent[k]))))


def _whole_parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows that come sorted by (bucket, part), about ``rows`` at a time, no part cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held)
            bucket, part = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            done = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            cut = int(done[-1]) + 1 if len(done) else 0
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _members(rows: pa.Table) -> Iterator[np.ndarray]:
    """Row numbers of each part's distinct members (a pivot is in its own part twice), parts of two at least."""
    bucket, part, node = (rows.column(k).to_numpy() for k in range(3))
    new = np.ones(len(rows), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
    heads = np.flatnonzero(new)
    for low, high in zip(heads.tolist(), np.append(heads[1:], len(rows)).tolist()):
        if high - low > 1:
            at = np.unique(node[low:high], return_index=True)[1] + low
            if len(at) > 1:
                yield at


def _sketches(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint64).reshape(len(rows), -1)


def _links(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["u", "v"])


def _bucket_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs to be confirmed, from rows (bucket, part, node, n, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_parts(batches, 20_000):
            node, n, sketch = rows.column(2).to_numpy(), rows.column(3).to_numpy(), _sketches(rows)
            left, right = [], []
            for at in _members(rows):
                ends = np.array(forest_pairs(sketch[at], n[at], percent), np.int64).reshape(-1, 2)
                left.append(node[at][ends[:, 0]])
                right.append(node[at][ends[:, 1]])
            yield _links(left, right)
    return run


def _crossing(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (bucket, part, node, n, sketch, component) those close to a member of another component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_parts(batches, 20_000):
            n, sketch, component = rows.column(3).to_numpy(), _sketches(rows), rows.column(5).to_numpy()
            involved = [np.zeros(0, np.int64)]
            for at in _members(rows):
                own, sizes, kinds = sketch[at], n[at], component[at]
                if kinds.min() == kinds.max():
                    continue
                near = [((_close(own, sizes, k, percent) <= MOST_BITS) & (kinds != kinds[k])).any() for k in range(len(at))]
                involved.append(at[np.array(near)])
            yield from rows.take(pa.array(np.concatenate(involved))).to_batches()
    return run


def _confirm_parts(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between components, from rows (bucket, part, node, n, sketch, component, shingles). A member's
    set is met by all others of its part at once; components joined by a link found are one from then on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_parts(batches, 600):
            node, n, sketch, component = (rows.column(2).to_numpy(), rows.column(3).to_numpy(), _sketches(rows),
                                          rows.column(5).to_numpy())
            shingles = rows.column(6).combine_chunks()
            left, right = [], []
            for at in _members(rows):
                own, sizes, kinds = sketch[at], n[at], component[at].copy()
                every = np.concatenate([np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in at.tolist()])
                begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                _, code = np.unique(every, return_inverse=True)
                mark = np.zeros(int(code.max()) + 1, bool)
                for k in range(len(at)):
                    near = (_close(own, sizes, k, percent) <= MOST_BITS) & (kinds != kinds[k])
                    if not near.any():
                        continue
                    mine = code[begin[k]:begin[k] + sizes[k]]
                    mark[mine] = True
                    both = np.add.reduceat(mark[code].astype(np.int64), begin)
                    mark[mine] = False
                    for x in np.flatnonzero(near & (100 * both >= percent * (sizes + sizes[k] - both))).tolist():
                        if kinds[x] != kinds[k]:
                            left.append(node[at[[k]]])
                            right.append(node[at[[x]]])
                            kinds[kinds == kinds[x]] = kinds[k]
            yield _links(left, right)
    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n) of the shingles of a partition's sets (node, shingles), summed up in it."""
    total = np.zeros(RARITY, np.int64)
    for batch in batches:
        for s in batch.column(1):
            np.add.at(total, mix(np.frombuffer(s.as_buffer(), np.uint64)) % np.uint64(RARITY), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])


def rare_prefixes(shingles: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set by which it is found as the smaller of a linked pair, and as the larger.

    In one order of all shingles, the first that two linked sets share stands so early in both: of n shingles a
    partner that is no smaller shares 2 * percent / (100 + percent) at least, any other percent / 100.
    The order decides only how many sets share a shingle here, never whether a pair is found."""
    n = len(shingles)
    first = np.lexsort((shingles, often[mix(shingles) % np.uint64(len(often))]))
    return (shingles[first[:n + 1 + -2 * percent * n // (100 + percent)]], shingles[first[:n + 1 + -percent * n // 100]])


def _prefixes(often: np.ndarray, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, node, smaller) from sets (node, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, s in zip(batch.column(0), batch.column(1)):
                both = rare_prefixes(np.frombuffer(s.as_buffer(), np.uint64), often, percent)
                bucket, smaller = np.concatenate(both), np.repeat([True, False], [len(x) for x in both])
                yield pa.RecordBatch.from_arrays([signed(bucket), pa.array(np.full(len(bucket), node.as_py())), pa.array(smaller)],
                                                 ["bucket", "node", "smaller"])
    return run


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(linked, pa.bool_()))
    return run


def likely(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose keys are among ``wanted``, and a few others. What is sent to every task are WANTED bits at most, so that no
    text is shuffled only to find that nothing asks for it."""
    place = F.xxhash64(*keys).bitwiseAND(F.lit(WANTED - 1))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    bits = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return (rows.withColumn("_word", word).join(F.broadcast(bits), "_word")
            .where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (u, v), for nodes with links.

    Large stars and small stars in turn until nothing changes: every step is a minimum per node, with
    partial sums, and a join, so hot nodes are no group in one task.
    """
    ends = keep(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = split_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (split_join(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        ends = keep(small)
        seen = ends.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        ends.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (node, component) with the links ``more`` (u, v) between nodes of it or new ones. Only the components
    that the links touch are put together anew, as nodes of their own."""
    label = found.select("node", "component")
    ends = more.join(label.withColumnsRenamed({"node": "u", "component": "a"}), "u", "left").join(
        label.withColumnsRenamed({"node": "v", "component": "b"}), "v", "left")
    merged = keep(components(ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))))
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    known = split_join(found, moved, ["component"], "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = merged.join(found.select("node"), "node", "left_anti")
    return known.unionByName(fresh.select("node", "component"))


def rare_blocks(entries: DataFrame) -> DataFrame:
    """(bucket, part, node, component): the members of a shingle, dealt into blocks of about PART_ROWS rows so that each
    smaller set meets each larger one of another component in one of them.

    ``entries`` has bucket, node, smaller, component and nodes, the size of the component. Nothing in the largest
    component of a shingle has to meet itself, so it meets only the rest. A frequent shingle is in no prefix of
    smaller sets, unless the sets that share it are linked by it, and then makes no blocks."""
    main = F.max(F.struct("nodes", "component")).alias("main")
    groups = entries.groupBy("bucket").agg(main, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rest = F.col("component") != F.col("main.component")
    rows = keep(split_join(entries, groups.select("bucket", "main"), ["bucket"]).select("bucket", "node", "smaller", "component", rest.alias("rest")))
    # side 0: smaller sets of the rest with all larger ones; side 1: those of the main component with larger ones of the rest
    sides = (F.when(F.col("smaller"), F.array(F.when(F.col("rest"), 0).otherwise(1)))
             .otherwise(F.when(F.col("rest"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    sided = rows.withColumn("side", F.explode(sides)).drop("rest")
    half = max(1, PART_ROWS // 2)
    count = lambda of: F.ceil(F.sum(of.cast("long")) / half).cast("long")
    blocks = (sided.groupBy("bucket", "side").agg(count(F.col("smaller")).alias("down"), count(~F.col("smaller")).alias("across"))
              .where("down > 0 AND across > 0"))
    own = F.pmod(F.xxhash64("node", "bucket"), F.when(F.col("smaller"), F.col("down")).otherwise(F.col("across")))
    last = F.when(F.col("smaller"), F.col("across")).otherwise(F.col("down")) - 1
    dealt = (split_join(sided, blocks, ["bucket", "side"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))))
    at = F.when(F.col("smaller"), F.col("own") * F.col("across") + F.col("other")).otherwise(F.col("other") * F.col("across") + F.col("own"))
    return dealt.select("bucket", (at * 2 + F.col("side")).alias("part"), "node", "component").distinct()


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, id, text_key.

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. A document's set has
    its distinct shingles of ``shingle_words`` words; with fewer words all of them are one shingle. Documents
    are linked when 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest doc_id
    reachable, and the row that has it is kept.

    Equal sets are one node. MinHash samples of a node fill the bands that make candidates and, folded
    by parity, its odd sketch: the XOR of two sketches tells how many samples differ. In every bucket the
    pairs of a spanning forest by that estimate are confirmed on the full sets; then
    members that are close to another component meet it with their full sets. So neither copies nor
    buckets become all their pairs. Buckets over PART_ROWS members are cut into parts that share PIVOTS members;
    members of such a bucket that are still in different components meet by their rarest shingles, of which every
    linked pair has one in common (``rare_prefixes``), so that no link is lost between parts.

    A null or empty text has an empty set and is linked with nothing; a null doc_id counts as the smallest
    id; rows of one id and text are one document. An empty table gives no rows; other columns are not read.
    """
    texts = keyed(docs)
    features = keep(texts.select("id", "text_key", "text").mapInArrow(_features(shingle_words), FEATURES))
    nodes = keep(features.where("n > 0").groupBy("a", "b").agg(
        F.min(F.struct("id", "text_key")).alias("least"), F.any_value(F.struct("n", "bands", "sketch")).alias("f"))
        .select("a", "b", "least", "f.*").withColumn("node", F.monotonically_increasing_id()))
    # a smaller set has no partner but its equal
    wide = nodes.where(F.col("n") * (100 - percent) >= percent)
    banded = wide.select("node", F.explode("bands").alias("bucket"))
    filled = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    draw = F.xxhash64("bucket", "node")
    pivot = (parts > 1) & (F.pmod(draw, F.ceil(F.col("size") / PIVOTS)) == 0)
    own = F.pmod(F.xxhash64("node", "bucket"), parts).cast("int")
    members = (split_join(banded, filled, ["bucket"])
               .withColumn("part", F.explode(F.when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))))
               .join(wide.select("node", "n", "sketch"), "node").select("bucket", "part", "node", "n", "sketch"))
    members = keep(members)

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part")

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = keep(wanted.distinct().join(nodes.select("node", "least.*"), "node"))
        some = likely(texts, rows, ["id", "text_key"]).join(rows, ["id", "text_key"]).dropDuplicates(["id", "text_key"])
        return keep(some.select("node", "text").mapInArrow(_sets(shingle_words), "node long, shingles binary"))

    pairs = keep(by_part(members).mapInArrow(_bucket_pairs(percent), "u long, v long").distinct())
    sets = sets_of(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("y"))
    links = keep(pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u long, v long"))
    found = keep(components(links))
    # members of one bucket that are close but in different components
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).select(
        "bucket", "part", "node", "n", "sketch", "component")
    open_ = keep(by_part(labelled).mapInArrow(_crossing(percent), labelled.schema))
    if not open_.isEmpty():
        rows = open_.join(sets_of(open_.select("node")), "node").select(*open_.columns, "shingles")
        more = by_part(rows).mapInArrow(_confirm_parts(percent), "u long, v long").distinct()
        found = keep(joined_components(found, more))
    # members of one large bucket that are in different components
    cut = members.where("part > 0").select("bucket").distinct()
    large = keep(split_join(members.select("bucket", "node").distinct(), cut, ["bucket"])
                 .join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    mixed = large.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart = keep(split_join(large, mixed.select("bucket"), ["bucket"]).select("node", "component").distinct())
    if not apart.isEmpty():
        sets = sets_of(apart.select("node"))
        counts = sets.mapInArrow(_places, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        often = np.zeros(RARITY, np.int64)
        often[counts["place"].to_numpy()] = counts["n"].to_numpy()
        sizes = apart.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
        labels = split_join(apart, sizes, ["component"])
        entries = keep(sets.mapInArrow(_prefixes(often, percent), "bucket long, node long, smaller boolean").join(labels, "node"))
        rows = keep(rare_blocks(entries).join(wide.select("node", "n", "sketch"), "node")
                    .select("bucket", "part", "node", "n", "sketch", "component"))
        open_ = keep(by_part(rows).mapInArrow(_crossing(percent), rows.schema))
        if not open_.isEmpty():
            rows = open_.join(sets.join(open_.select("node").distinct(), "node"), "node").select(*open_.columns, "shingles")
            more = by_part(rows).mapInArrow(_confirm_parts(percent), "u long, v long").distinct()
            found = keep(joined_components(found, more))
    of_node = (nodes.select("a", "b", "node", "least.id").join(found, "node", "left")
               .withColumn("component", F.coalesce("component", "node")))
    least = of_node.groupBy("component").agg(F.min("id").alias("component_id"))
    of_set = split_join(of_node, least, ["component"]).select("a", "b", "component_id")
    full = split_join(features.where("n > 0").select("id", "text_key", "n", "a", "b"), of_set, ["a", "b"])
    both = full.select("id", "text_key", "n", "component_id").unionByName(
        features.where("n = 0").select("id", "text_key", "n", F.col("id").alias("component_id")))
    return both.select(doc_id(), F.col("n").alias("n_shingles"), doc_id("component_id").alias("component_id"),
                       (F.col("id") == F.col("component_id")).alias("kept"), "id", "text_key")


def near_dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of ``near_groups`` stays; all columns in their order, repeated rows once."""
    stays = near_groups(docs, shingle_words, percent).where("kept").select("id", "text_key").distinct()
    return rows_of(docs, stays, once=True)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle_words=2).drop("id", "text_key")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
  ELSE list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS u, doc_id AS root FROM d UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.u),
c AS (SELECT u, min(root) AS component_id FROM r GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.u = doc_id
"""
