"""Embedding whitening by weighted multiplicity covariance (operator 13)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.shared import keep, split_join, table

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries of the grid stay within this, so that no sum of them leaves a decimal of 38 digits.
FAR = float(1 << 62)
#: What fits a signed 64-bit number.
LONG = (1 << 63) - 1


class Fit(NamedTuple):
    """Mean and components of a fit list: ``weight`` is the sum of weights, ``sums`` those of the entries times weight."""

    weight: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def on_grid(vector: Column) -> Column:
    """``vector`` as longs floor(64 * c) + 1000000, null where it is null or holds null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(FAR)), F.lit(-FAR))) + OFFSET
    return F.when(finite, F.transform(vector, entry))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False)


def _entry_sums(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact sums of a partition by dimension; dimension -1 has the weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, sums = 0, [0] * dim
        for batch in batches:
            x, w = _vectors(batch, dim), _weights(batch)
            if not len(x):
                continue
            most = max(int(x.max()), -int(x.min())) * int(w.sum())
            total = w @ x if most <= LONG else (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
            weight += int(w.sum())
            sums = [s + int(t) for s, t in zip(sums, total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(s) for s in [weight, *sums]], pa.decimal128(38, 0))], ["i", "s"])
    return run


def _centred(x: np.ndarray, fit_weight: int, sums: list[int]) -> np.ndarray:
    """x minus the mean: the whole part of the mean goes in integers, then its fraction, so that nothing cancels."""
    whole = [s // fit_weight for s in sums]
    fraction = np.array([(s - m * fit_weight) / fit_weight for s, m in zip(sums, whole)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - fraction


def _products(dim: int, width: int, project: Callable[[np.ndarray], np.ndarray]
              ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sum over a partition of weight times the outer product of each projected vector, one row per line of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = project(_vectors(batch, dim))
            total += (y * _weights(batch)[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "line"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            held[i] = held.get(i, 0.0) + line.values.to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "line"])


def _matrix(distinct: DataFrame, dim: int, width: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The products of all partitions, added up line by line; ``width`` lines reach the driver, whatever the rows."""
    kind = "i int, line array<double>"
    parts = distinct.select("x", "w").mapInArrow(_products(dim, width, project), kind)
    lines = parts.repartition("i").mapInArrow(_added, kind).collect()
    out = np.zeros((width, width))
    for row in lines:
        out[row.i] += row.line
    return out


def fit(distinct: DataFrame, dim: int, components: int) -> Fit | None:
    """Mean, covariance (divisor: sum of weights) and its first eigenvectors over (x, w); None without rows."""
    sums = {r.i: int(r.s) for r in distinct.select("x", "w").mapInArrow(_entry_sums(dim), "i int, s decimal(38,0)")
            .groupBy("i").agg(F.sum("s").alias("s")).collect()}
    weight = sums.pop(-1, 0)
    if not weight:
        return None
    totals = [sums[i] for i in range(dim)]
    v = _matrix(distinct, dim, dim, lambda x: _centred(x, weight, totals)) / weight
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    directions = vectors[:, order]
    sign = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))])
    return Fit(weight, totals, directions * sign, values[order], float(np.trace(v)))


def _deviations(x: np.ndarray, weight: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where that is no 64-bit number."""
    most = max(int(x.max()), -int(x.min())) * weight + max(map(abs, sums))
    if most * most * len(sums) <= LONG:
        t = x * weight - np.array(sums, np.int64)
        return (t * t).sum(axis=1).tolist()
    if most <= LONG:
        t = x * weight - np.array(sums, np.int64)
        if int(np.abs(t).max()) ** 2 * len(sums) <= LONG:
            return (t * t).sum(axis=1).tolist()
    t = x.astype(object) * weight - np.array(sums, object)
    return [d if d <= LONG else None for d in (t * t).sum(axis=1)]


def _whitened(dim: int, model: Fit, scale: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, dim)
            z = _centred(x, model.weight, model.sums) @ model.directions
            defined = np.broadcast_to(scale > 0, z.shape).ravel()
            values = pa.array((z * scale).ravel(), mask=~defined)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(x, model.weight, model.sums), pa.int64()),
                                              pa.ListArray.from_arrays(offsets, values)], ["x", "deviation", "whitened"])
    return run


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           weights: str = "one") -> DataFrame:
    """One row per remaining row: ``id_col``, n, deviation, whitened, explained, identity_error.

    Entries go to the grid floor(64 * c) + 1000000. Equal grid vectors are one entry of the fit list, with weight one
    (``weights="one"``) or with the number of their rows (``"count"``); n is the sum of weights. Mean and
    covariance come from that list by centred matrix products in the tasks, partial ones added up; only the covariance,
    dimension by dimension, reaches the driver. Each distinct vector is whitened once and joined back to its rows by a
    join that splits hot vectors.

    ``whitened`` has the centred vector on the first unit eigenvectors (each with its largest entry positive), over
    the root of the eigenvalue; ``explained`` the eigenvalues over the trace; ``identity_error`` the largest entry
    of the whitened list's covariance minus the identity. ``deviation`` is the sum over dimensions of (n * x - S)^2.

    Rows go whose vector is null or empty, holds null or non-finite entries, or has another length than the
    commonest (of equals the longest). Ids may be null or repeated, each row gives a row. Entries beyond 2^56 count as
    that. A component whose eigenvalue is zero to double precision is null and stays out of ``identity_error``; both
    that and ``explained`` are null where nothing varies. A ``deviation`` beyond 64 bits is null. An empty table, or
    one without valid vectors, gives no rows. Columns of other names are not read.
    """
    if weights not in ("one", "count"):
        raise ValueError(weights)
    rows = embeddings.select(F.col(id_col), on_grid(F.col(vector)).alias("x")).where("size(x) > 0")
    weight = F.count(F.lit(1)) if weights == "count" else F.lit(1).cast("long")
    distinct = keep(rows.groupBy("x").agg(weight.alias("w")))
    sizes = distinct.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    dim = common.dim if common else 1
    distinct = distinct.where(F.size("x") == dim)
    model = fit(distinct, dim, min(components, dim))
    if model is None:
        model = Fit(1, [0] * dim, np.zeros((dim, 0)), np.zeros(0), 0.0)
    least = (model.eigenvalues[0] if len(model.eigenvalues) else 0.0) * dim * np.finfo(float).eps
    sound = model.eigenvalues > max(least, 0.0)
    scale = np.where(sound, 1 / np.sqrt(np.where(sound, model.eigenvalues, 1.0)), 0.0)
    error = None
    if sound.any():
        chosen, width = model.directions[:, sound] * scale[sound], int(sound.sum())
        product = _matrix(distinct, dim, width, lambda x: _centred(x, model.weight, model.sums) @ chosen) / model.weight
        error = float(np.abs(product - np.eye(width)).max())
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.eigenvalues]
    result = distinct.select("x").mapInArrow(_whitened(dim, model, scale), "x array<long>, deviation long, whitened array<double>")
    return split_join(rows.where(F.size("x") == dim), result, ["x"]).select(
        id_col, F.lit(model.weight).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(e).cast("double") for e in explained]).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
