"""Nearest neighbours from an inverted file of centroids, exact or at a measured recall.

Vectors are scaled to length 1, so that their distance d and their cosine s are tied by d^2 = 2 - 2 s. Each lies in the cell of
its nearest centroid, at a known distance. By the triangle inequality a query at distance a from a centroid is at
least |a - b| away from a member at distance b; cells and members farther than the k-th best so far are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.operators.eligibility import top_ranked
from entitle.session import truncate_lineage

#: Bounds of the fit: vectors the centroids are trained on, cells, queries that the number of probes is chosen by.
SAMPLE, MOST_CELLS, TRIALS = 50_000, 4096, 256
#: Bytes of a block: what one task compares is a block of members with a block of queries, a strip of so many pairs at a time.
BLOCK_BYTES, STRIP_CELLS = 8 << 20, 1 << 22
DIGITS = 4
#: By this much a similarity may be under a bound and still be rounded up to it.
SLACK = 10 ** -DIGITS


class InvertedFile(NamedTuple):
    """``cells`` (cell, centroid, low, high, n): as many rows as cells. ``members`` (cell, item_id, unit, far): all items."""

    cells: DataFrame
    members: DataFrame


def _units(rows: DataFrame, key: str, dim: int | None = None) -> DataFrame:
    """(key, unit): vectors scaled to length 1. Those without entries, of length 0 or of another width are left out, for
    they are similar to nothing."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    kept = rows.select(key, "vector", norm.alias("_n")).where("size(vector) > 0 AND _n > 0")
    kept = kept if dim is None else kept.where(F.size("vector") == dim)
    return kept.select(key, F.transform("vector", lambda x: x.cast("double") / F.col("_n")).alias("unit"))


def build_inverted_file(items: DataFrame, cells: int | None = None, seed: int = 7) -> InvertedFile:
    """The inverted file of ``items`` (item_id, vector), of the commonest width.

    Centroids (the root of the number of items, MOST_CELLS at most) are trained on SAMPLE rows at most, chosen by the hash of
    their ids; every item is assigned to its nearest one."""
    units = truncate_lineage(_units(items, "item_id"))
    width = units.groupBy(F.size("unit").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if width is None:
        none = units.sparkSession.createDataFrame([], "cell int, centroid array<double>, low double, high double, n long")
        return InvertedFile(none, units.select(F.lit(0).alias("cell"), "*", F.lit(0.0).alias("far")))
    units = units.where(F.size("unit") == width.dim)
    sample = units.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).select(array_to_vector("unit").alias("features"))
    model = KMeans(k=max(1, min(cells or round(width.n ** .5), MOST_CELLS, width.n)), maxIter=8, seed=seed).fit(sample)
    centres = np.array(model.clusterCenters())

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            away = _distances(np.array(pdf["unit"].tolist()).reshape(len(pdf), -1), centres)
            cell = away.argmin(axis=1) if len(pdf) else np.zeros(0, int)
            yield pdf.assign(cell=cell.astype(np.int32), far=away[np.arange(len(pdf)), cell])

    kind = dict(units.dtypes)["item_id"]
    members = truncate_lineage(units.mapInPandas(assigned, f"item_id {kind}, unit array<double>, cell int, far double"))
    held = members.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n"))
    names = units.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>")
    return InvertedFile(names.join(held, "cell"), members.select("cell", "item_id", "unit", "far"))


def write_inverted_file(index: InvertedFile, path: str) -> None:
    """The file as Parquet, members in folders by cell, so that a search reads the cells it visits."""
    index.cells.write.mode("overwrite").parquet(f"{path}/cells")
    index.members.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/members")


def read_inverted_file(spark: SparkSession, path: str) -> InvertedFile:
    return InvertedFile(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/members"))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.zeros((0, len(centres)))
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0))


def block_size(width: int, bytes_: int = BLOCK_BYTES) -> int:
    """Rows of a block of vectors of ``width`` numbers."""
    return max(256, bytes_ // (8 * max(1, width)))


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def best_of_block(left: np.ndarray, right: np.ndarray, k: int | None, floors: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None,
                  columns: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the best ``k`` columns of each row at or above its floor; all of them for None.

    Columns come in the order that breaks ties. Rows are taken in strips, so that a strip's similarities, not those of the block, are held.
    ``columns`` tells which columns a strip needs; ``same`` are keys of rows and columns that are not to meet."""
    out: list[tuple[np.ndarray, ...]] = []
    step = max(16, STRIP_CELLS // max(1, len(right)))
    for start in range(0, len(left), step):
        rows = slice(start, start + step)
        cols = np.arange(len(right)) if columns is None else columns(rows)
        raw = left[rows] @ right[cols].T
        least = floors[rows][:, None] - SLACK
        if same is not None:
            raw[same[0][rows][:, None] == same[1][cols][None, :]] = -2.0
        if k is not None and raw.shape[1] > 4 * k:  # what is more than a rounding below the k-th best cannot be among the best
            near = np.count_nonzero(raw >= least) > raw.size // 16
            least = np.maximum(least, np.partition(raw, -k, axis=1)[:, -k][:, None] - SLACK) if near else least
        row, col = np.nonzero(raw >= least)
        value = np.round(raw[row, col], DIGITS)
        held = value >= floors[rows][row]
        row, col, value = row[held], col[held], value[held]
        if k is not None:
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            first = np.searchsorted(row, row, side="left")
            held = np.arange(len(row)) - first < k
            row, col, value = row[held], col[held], value[held]
        out.append((row + start, cols[col], value))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _grouped(cells: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each cell and how many it has: cells along the main axis of their centroids share a group of about ``size``
    members, a larger cell has groups of its own."""
    centres = np.array(cells["centroid"].tolist())
    axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    first, parts = np.zeros(len(cells), int), np.ones(len(cells), int)
    group, held, counts = 0, 0, cells["n"].to_numpy()
    for i in np.argsort(centres @ axis, kind="stable"):
        if held and held + counts[i] > size:
            group, held = group + 1, 0
        first[i], parts[i] = group, _blocks(int(counts[i]), size)
        group, held = (group + parts[i], 0) if parts[i] > 1 else (group, held + counts[i])
    return first, parts


def _compared(asked: DataFrame, index: InvertedFile, cells: pd.DataFrame, n: int, k: int, threshold: float, exclude_same: bool,
              block_rows: int | None, probes: int | None) -> DataFrame:
    """(query_id, item_id, similarity): the best k of each group of cells that a query visits. ``asked`` is (query_id, unit, reach, floor).

    A query visits its ``probes`` nearest cells, or, for None, all that may hold something in its reach. A vector is sent once for
    each group or block it meets, not once for each cell; which cells of the group a query visits is found where they meet."""
    centres, names = np.array(cells["centroid"].tolist()), cells["cell"].to_numpy()
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    size = block_rows or block_size(centres.shape[1])
    first, parts = _grouped(cells, size)
    n_query = _blocks(n, size)

    def needed(away: np.ndarray, reach: np.ndarray, limit: np.ndarray, at: np.ndarray) -> np.ndarray:
        if probes is not None:
            return away <= limit[:, None] + 1e-9
        return np.maximum(np.maximum(away - high[at], low[at] - away), 0.0) <= reach[:, None] + 1e-9

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.arange(len(names))
        for pdf in batches:
            away = _distances(np.array(pdf["unit"].tolist()).reshape(len(pdf), centres.shape[1]), centres)
            last = min(probes or 1, len(names)) - 1
            limit = np.partition(away, last, axis=1)[:, last] if len(pdf) else np.zeros(0)
            mark = needed(away, pdf["reach"].to_numpy(), limit, every)
            groups = [np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(m)] or [np.zeros(0, int)]))
                      for m in mark]
            yield pdf.assign(limit=limit, home=away.argmin(axis=1).astype(np.int32) if len(pdf) else np.zeros(0, np.int32), groups=groups)

    types = dict(asked.dtypes)["query_id"], dict(index.members.dtypes)["item_id"]
    q = (asked.select("query_id", "unit", "reach", "floor")
         .mapInPandas(visited, f"query_id {types[0]}, unit array<double>, reach double, floor double, limit double, home int, groups array<int>")
         .withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int")).withColumn("_g", F.explode("groups")).drop("groups"))
    of = index.members.sparkSession.createDataFrame(
        [(int(c), int(f), int(p)) for c, f, p in zip(names, first, parts)], "cell int, _first int, _parts int")  # as many rows as cells
    i = (index.members.join(F.broadcast(of), "cell")
         .select("cell", F.col("item_id").alias("item_id"), F.col("unit").alias("unit"),
                 (F.col("_first") + F.pmod(F.xxhash64("item_id"), F.col("_parts"))).cast("int").alias("_g"))
         .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))))
    place = {int(c): j for j, c in enumerate(names)}

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        left = left.sort_values("home", kind="stable")  # queries of a strip visit much the same cells
        right = right.sort_values("item_id", kind="stable")
        x, y = np.array(left["unit"].tolist()), np.array(right["unit"].tolist())
        at, cell = np.unique(right["cell"].map(place).to_numpy(), return_inverse=True)
        mark = needed(_distances(x, centres[at]), left["reach"].to_numpy(), left["limit"].to_numpy(), at)
        ids, items = left["query_id"].to_numpy(), right["item_id"].to_numpy()
        row, col, value = best_of_block(x, y, k, left["floor"].to_numpy(), (ids, items) if exclude_same else None,
                                        lambda rows: np.flatnonzero(mark[rows].any(axis=0)[cell]))
        return pd.DataFrame({"query_id": ids[row], "item_id": items[col], "similarity": value})

    keys = ["_g", "_q"]
    return (q.groupBy(*keys).cogroup(i.groupBy(*keys))
            .applyInPandas(block, f"query_id {types[0]}, item_id {types[1]}, similarity double"))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the rows of ``truth`` (query_id, item_id) that are in ``found``; 1 when there are none."""
    total = truth.count()
    return truth.join(found, ["query_id", "item_id"], "left_semi").count() / total if total else 1.0


def probes_for(index: InvertedFile, k: int, threshold: float, target: float, exclude_same: bool = False) -> int:
    """The fewest cells to visit by which a sample of the items (TRIALS at most, chosen by the hash of their ids), taken
    as queries, finds ``target`` of its exact neighbours."""
    rows = index.members.orderBy(F.xxhash64("item_id"), "item_id").limit(TRIALS)
    cells = index.cells.orderBy("cell").toPandas()  # MOST_CELLS rows at most
    sample = rows.select(F.col("item_id").alias("query_id"), F.col("unit").alias("vector"))
    exact = truncate_lineage(search(sample, index, k, threshold, exclude_same=exclude_same).join(
        index.members.select("item_id", "cell"), "item_id").select("query_id", "cell"))
    ranks = np.full(len(cells) + 1, 0)
    units = {r.query_id: r.vector for r in sample.collect()}
    centres, place = np.array(cells["centroid"].tolist()), {c: i for i, c in enumerate(cells["cell"])}
    for row in exact.collect():  # k rows for each of the sample at most
        away = _distances(np.array([units[row.query_id]]), centres)[0]
        ranks[int((away < away[place[row.cell]]).sum()) + 1] += 1
    seen = np.cumsum(ranks)
    return int(np.searchsorted(seen, target * seen[-1])) or 1


def search(queries: DataFrame, index: InvertedFile, k: int, threshold: float, exact: bool = True, probes: int = 2,
           exclude_same: bool = False, block_rows: int | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank): the best ``k`` items of each of ``queries`` (query_id, vector) at or above the
    threshold (above 0), ties in order of the item.

    The ``probes`` nearest cells come first. With ``exact=False`` that is all; ``probes_for`` finds how many a recall needs.
    Otherwise the k-th best bounds how far away anything better may be, and every cell that reaches so far is visited.
    Blocks (BLOCK_BYTES, or ``block_rows`` rows) bound what a task holds, whatever the size of a cell. The result is stored once.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    cells = index.cells.orderBy("cell").toPandas()  # MOST_CELLS rows at most
    kind = dict(queries.dtypes)["query_id"], dict(index.members.dtypes)["item_id"]
    if cells.empty:
        return queries.sparkSession.createDataFrame([], f"query_id {kind[0]}, item_id {kind[1]}, similarity double, rank int")
    width = len(cells["centroid"][0])
    widest = float(np.sqrt(max(0.0, 2 - 2 * (threshold - SLACK))))
    asked = truncate_lineage(_units(queries, "query_id", width).withColumn("reach", F.lit(widest)).withColumn("floor", F.lit(float(threshold))))
    args = (index, cells, asked.count(), k, threshold, exclude_same, block_rows)
    order = [F.desc("similarity"), F.col("item_id")]
    found = truncate_lineage(top_ranked(_compared(asked, *args, probes), ["query_id"], order, k))
    if not exact:
        return found
    kth = found.where(F.col("rank") == k).select("query_id", "similarity")
    nearer = F.sqrt(F.greatest(2 - 2 * (F.col("similarity") - SLACK), F.lit(0.0)))
    reach = F.when(F.col("similarity").isNull(), F.col("reach")).otherwise(F.least("reach", nearer))
    asked = asked.join(kth, "query_id", "left").select("query_id", "unit", reach.alias("reach"),
                                                      F.greatest("floor", F.coalesce("similarity", F.lit(0.0))).alias("floor"))
    return truncate_lineage(top_ranked(_compared(asked, *args, None), ["query_id"], order, k))
