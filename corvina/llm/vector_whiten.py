"""Whitening of embeddings from exact integer scatter.

Entries become whole numbers, and the model is fitted on each distinct vector once.
Tasks take a shift off and add up sums and cross-products without rounding (factors are
cut into limbs whose products are exact as floats), Spark adds up the limbs of what the
tasks give, and n * X'X - S S' is formed as a matrix of Python integers.  Only then is
it turned into floats and decomposed, so a large mean takes no digits away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mapped, stored

#: An entry c becomes floor(SCALE * c) + 1,000,000; the tasks take this shift off again, so that it is never added.
SCALE = 64
COMPONENTS = 16
#: Entries beyond this, in units of 1 / SCALE, count as this, so that a long holds them.
LARGEST = 1 << 62
#: Bits of a limb of a factor, and rows whose products of limbs a float holds exactly.
LIMB, ROWS = 22, 512
#: Bits and number of the limbs that Spark adds up: room for 2**31 tasks and sums below 2**179.
WORD, WORDS = 30, 6
#: Entries of the vectors in memory at once.
ENTRIES = 1 << 20
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vector: Column) -> Column:
    """floor(SCALE * c) of each entry, within LARGEST: the whole vector with its shift taken off."""
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of equal dimension, with their vectors as a matrix."""
    for batch in batches:
        length = pc.list_value_length(batch.column("x")).to_numpy(zero_copy_only=False)
        for d in np.unique(length).tolist():
            same = batch.filter(pa.array(length == d))
            step = max(1, ENTRIES // max(d, 1))
            for i in range(0, same.num_rows if d else 0, step):
                part = same.slice(i, step)
                yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Scatter:
    """Number, sums and cross-products of whole vectors, exactly."""

    def __init__(self, d: int):
        self.n, self.d = 0, d
        self.sums, self.products = np.zeros(d, object), np.zeros((d, d), object)

    def add(self, x: np.ndarray) -> None:
        sign, size = np.sign(x), np.abs(x)
        limbs = [(sign * (size >> at & (1 << LIMB) - 1)).astype(float) for at in (0, LIMB, 2 * LIMB)]
        limbs = [(k, limb) for k, limb in enumerate(limbs) if limb.any()]
        self.n += len(x)
        for k, limb in limbs:
            self.sums = self.sums + (limb.astype(np.int64).sum(0).astype(object) << LIMB * k)
        for a, left in limbs:
            for b, right in limbs:
                if a <= b:
                    total = np.zeros((self.d, self.d), np.int64)
                    for i in range(0, len(x), ROWS):
                        total += (left[i : i + ROWS].T @ right[i : i + ROWS]).astype(np.int64)
                    both = total if a == b else total + total.T
                    self.products = self.products + (both.astype(object) << LIMB * (a + b))

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(dimension, i, j, value): products at i <= j, sums at i = -1, the number at i = j = -1."""
        yield self.d, -1, -1, self.n
        for j in range(self.d):
            yield self.d, -1, j, self.sums[j]
            for i in range(j + 1):
                yield self.d, i, j, self.products[i, j]


@dataclass(frozen=True)
class Model:
    """What one dimension's vectors are whitened with."""

    n: int
    sums: np.ndarray  # without the shift
    axes: np.ndarray  # a column for each component
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: longs while they fit, else Python integers."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums.tolist()), default=0)
        return self.n * x - self.sums.astype(np.int64) if top <= LONG else self.n * x.astype(object) - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (centred.astype(float) / self.n) @ self.axes / np.sqrt(self.values)


def deviation(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; None where a long doesn't hold it."""
    top = int(np.abs(centred).max(initial=0))
    wide = centred if top * top * centred.shape[1] <= LONG else centred.astype(object)
    return [x if x <= LONG else None for x in (wide * wide).sum(1).tolist()]


def scatter(fit: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """(n, sums, n * X'X - S S') by dimension; the driver gets a row for each pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for _, x in _blocks(batches):
            held.setdefault(x.shape[1], Scatter(x.shape[1])).add(x)
        names = ["d", "i", "j", *(f"w{k}" for k in range(WORDS))]
        for s in held.values():
            rows = list(s.rows())
            for i in range(0, len(rows), 100_000):
                d, a, b, value = zip(*rows[i : i + 100_000], strict=True)
                words = [[v >> WORD * k & (1 << WORD) - 1 for v in value] for k in range(WORDS - 1)] + [[v >> WORD * (WORDS - 1) for v in value]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (d, a, b)), *(pa.array(w, pa.int64()) for w in words)], names)

    words = [f"w{k}" for k in range(WORDS)]
    found = mapped(fit, run, "d long, i long, j long, " + ", ".join(f"{w} long" for w in words)).groupBy("d", "i", "j").agg(*(F.sum(w).alias(w) for w in words)).collect()
    by: dict[int, dict[tuple[int, int], int]] = {}
    for r in found:
        by.setdefault(r.d, {})[r.i, r.j] = sum(r[w] << WORD * k for k, w in enumerate(words))
    out = {}
    for d, values in by.items():
        n, sums = values[-1, -1], [values[-1, j] for j in range(d)]
        out[d] = n, sums, [[n * values[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return out


def model(n: int, sums: list[int], spread: list[list[int]]) -> Model:
    """Decomposes spread / n**2; components whose eigenvalue is zero in double precision keep the value 0."""
    covariance = np.array([[v / (n * n) for v in row] for row in spread])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    values = np.where(values > len(values) * np.finfo(float).eps * values[0], values, 0.0)
    trace = sum(spread[i][i] for i in range(len(spread))) / (n * n)
    some = slice(0, min(COMPONENTS, len(values)))
    return Model(n, np.array(sums, object), axes[:, some], values[some], values[some] / trace if trace else np.full(len(values[some]), np.nan))


def identity_error(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, x in _blocks(batches):
            m = models[x.shape[1]]
            z = m.whitened(m.centred(x))[:, m.values > 0]
            held[x.shape[1]] = held.get(x.shape[1], 0.0) + z.T @ z
        for d, total in held.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(d, pa.int64()), i.size), pa.array(i), pa.array(j), pa.array(total.ravel())], ["d", "i", "j", "v"])

    out: dict[int, float] = {}
    for r in mapped(fit, run, "d long, i long, j long, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.d] = max(out.get(r.d, 0.0), abs(r.v / models[r.d].n - (r.i == r.j)))
    return out


def whiten(vectors: DataFrame) -> DataFrame:
    """A row for each usable vector and component: `vec_id, component, n, deviation, whitened, explained, identity_error`.

    Vectors that are null or hold null or non-finite entries are left out, and so are
    vectors without entries, which have no components.  Vectors of each dimension are a
    population of their own.  Repeated vectors count once in the fit and get rows each.
    Where the fit list has no spread along a component, `whitened` is null (and
    `explained`, if it has none at all); `identity_error` is that of the others, null
    if there are none.  `deviation` is null where a long can't hold it.  An empty table
    gives no rows.  Other columns of `vectors` are left alone.
    """
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("x")).filter(F.size("x") > 0)
    fit = stored(rows.select("x").distinct())
    models = {d: model(*x) for d, x in scatter(fit).items()}
    errors = identity_error(fit, models)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            m = models[x.shape[1]]
            k, centred = len(m.values), m.centred(x)
            z, at = m.whitened(centred), pa.array(np.repeat(np.arange(len(x)), k))
            flat = m.values > 0
            columns = [
                part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.repeat(pa.scalar(m.n, pa.int64()), len(at)),
                pa.array(deviation(centred), pa.int64()).take(at), pa.array(z.ravel(), mask=np.tile(~flat, len(x))), pa.array(np.tile(m.explained, len(x)), from_pandas=True),
                pa.repeat(pa.scalar(errors.get(x.shape[1]), pa.float64()), len(at)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mapped(rows, run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
