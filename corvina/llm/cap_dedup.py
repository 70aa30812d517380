"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the products of small random codebooks: a rotated vector is
cut in parts, each part has a codebook, and a direction takes one word of each.  A
vector passes a filter if its inner product with the direction reaches a bound; all
passing directions are list-decoded from the words that can still reach it with the
best of the other parts.  Vectors that share a filter are compared by exact cosine.
There are two parts, four where the codebooks would be large, and one (plain random
directions) in few dimensions, whose parts would have next to no directions.

The bound follows from the number of vectors, so that a filter holds about
`PER_FILTER` unrelated ones whatever the input's size.  Rotations are added until
simulated pairs at the threshold share a filter with the wanted recall; pairs above
it do so more surely.  In few dimensions a vector has more neighbours than that
within the threshold, and no number of such small filters finds them: filters are
then widened until `MOST_ROUNDS` rotations reach the recall, in the end to one filter
that all vectors pass, which compares all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, mapped
from ._links import shared_buckets, tiles, verify
from .ngram_join import classes

THRESHOLD = 0.95
RECALL = 0.999
#: Unrelated vectors that a filter holds, and filters that a vector passes in each round, on average.
PER_FILTER = 0.25
LIST = 8
#: Rotations at most, before filters are made wider instead; by how much; and the share of vectors from which one filter holds all.
MOST_ROUNDS = 24
WIDENED = 3.0
WIDEST = 0.3
#: Dimensions below which directions have one part; words a codebook of two parts may have; scores and simulated pairs held at once.
FEW = 6
MOST_WORDS = 4096
SCORES = 1 << 22
PAIRS = 2000
SEED = 77


class Code:
    """Product codes for vectors of one dimension, each with a rotation of its own; `share` of all vectors pass a filter."""

    def __init__(self, dim: int, share: float):
        self.dim, self.share = dim, share
        self.rng = np.random.default_rng([SEED, dim, round(-np.log2(share) * 64)])
        self.bound = np.float32(_bound(dim, share))
        directions = LIST / share
        self.parts = 1 if dim < FEW else 4 if directions > MOST_WORDS**2 and dim >= 2 * FEW else 2
        self.words = max(2, round(directions ** (1 / self.parts)))
        self.rounds: list[list[np.ndarray]] = []

    def grow(self) -> None:
        """Add a rotation with its codebooks."""
        rotation = np.linalg.qr(self.rng.standard_normal((self.dim, self.dim)))[0]
        books = []
        for part in np.array_split(rotation, self.parts, axis=1):
            book = self.rng.standard_normal((self.words, part.shape[1]))
            book /= np.linalg.norm(book, axis=1, keepdims=True) * np.sqrt(self.parts)
            books.append((part @ book.T).astype(np.float32))
        self.rounds.append(books)

    def decode(self, unit: np.ndarray, rounds: slice = slice(None)) -> list[np.ndarray]:
        """Numbers of all directions that each unit vector passes; without codebooks all pass the one."""
        if not self.rounds:
            return [np.zeros(1, np.int64) for _ in unit]
        unit = unit.astype(np.float32)
        step = max(1, SCORES // self.words)
        return [x for k in range(0, len(unit), step) for x in self._decode(unit[k : k + step], rounds)]

    def _decode(self, unit: np.ndarray, rounds: slice) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in unit]
        for t, books in list(enumerate(self.rounds))[rounds]:
            scores = [unit @ book for book in books]
            best = np.stack([x.max(1) for x in scores])
            able = [x >= (self.bound - (best.sum(0) - b))[:, None] for x, b in zip(scores, best, strict=True)]
            for row, found in enumerate(out):
                number = able[0][row].nonzero()[0].astype(np.int64)
                total = scores[0][row, number]
                number += t * self.words
                for k in range(1, self.parts):
                    more = able[k][row].nonzero()[0]
                    total = total[:, None] + scores[k][row, more][None, :]
                    i, j = (total >= self.bound - best[k + 1 :, row].sum()).nonzero()
                    number, total = number[i] * self.words + more[j], total[i, j]
                found.append(number[total >= self.bound] if self.parts == 1 else number)
        return [np.concatenate(found) for found in out]


def _tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products, and the share of all unit vectors that reach each with a direction."""
    x = np.linspace(-1, 1, 400_001)
    if dim == 2:
        return x, np.arccos(x) / np.pi
    density = np.maximum(1 - x * x, 1e-300) ** ((dim - 3) / 2)
    return x, 1 - np.cumsum(density) / density.sum()


def _bound(dim: int, share: float) -> float:
    """The inner product with a direction that a share of all unit vectors reaches."""
    x, tail = _tail(dim)
    return float(x[min(np.searchsorted(-tail, -share), len(x) - 1)])


def _least(dim: int, threshold: float) -> float:
    """The share of vectors in a cap that just holds two vectors at the threshold; no smaller filter finds them."""
    x, tail = _tail(dim)
    return float(tail[min(np.searchsorted(x, np.sqrt((1 + threshold) / 2)), len(x) - 1)])


@cache
def code_for(dim: int, power: int, threshold: float, recall: float) -> Code:
    """The code for up to 2**power vectors, its rotations from simulated pairs at the threshold."""
    rng = np.random.default_rng([SEED, dim, power])
    a = rng.standard_normal((PAIRS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((PAIRS, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    if dim > 1:
        b = threshold * a + np.sqrt(1 - threshold**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    share = max(min(0.1, PER_FILTER / 2**power), _least(dim, threshold)) if dim > 1 else 1.0
    while dim > 1 and share < WIDEST:
        code, met = Code(dim, share), np.zeros(PAIRS, bool)
        while met.mean() < recall and len(code.rounds) < MOST_ROUNDS:
            code.grow()
            this = slice(len(code.rounds) - 1, None)
            met |= np.array([len(np.intersect1d(x, y, assume_unique=True)) > 0 for x, y in zip(code.decode(a, this), code.decode(b, this), strict=True)])
            # rotations are independent: each finds the same part of what is left, but for chance
            if len(code.rounds) == 3 and (1 - met.mean()) ** (MOST_ROUNDS / 3) > 4 * (1 - recall) + 0.01:
                break
        if met.mean() >= recall:
            return code
        share *= WIDENED
    return Code(dim, 1.0)


def cosine_at_least(threshold: float):
    """Function that says which of a tile's vectors have a cosine of `threshold` or more, in double precision."""

    def similar(payloads: list[bytes]) -> np.ndarray:
        sizes = np.array([*map(len, payloads)])
        out = np.zeros((len(payloads), len(payloads)), bool)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(payloads[i] for i in at), np.float64).reshape(len(at), -1)
            norm = np.sqrt((x * x).sum(1))
            out[np.ix_(at, at)] = x @ x.T / (norm[:, None] * norm[None, :]) >= threshold
        return out

    return similar


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """`vec_id, n_links, component_id, kept` for every row of `vec_id, embedding`.

    Vectors that are null, empty or zero or hold null or non-finite components link
    with nothing, and vectors of different dimensions don't link.  Equal vectors are
    one node until the end, so copies are counted and not compared.  Repeated rows
    link like others; null ids are never a component's least one unless it has no
    other; other columns are ignored; an empty table gives no rows.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    power = max(4, int(vectors.count()).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, lists = part.column("vec_id"), part.column("embedding").to_pylist()
                nodes: list = [None] * len(lists)
                payloads: list = [None] * len(lists)
                filters: list = [[]] * len(lists)
                by: dict[int, list[int]] = {}
                arrays = {}
                for i, v in enumerate(lists):
                    if v and None not in v:
                        x = np.asarray(v, np.float64)
                        scale = np.abs(x).max()
                        if np.isfinite(x).all() and scale > 0:
                            arrays[i] = x / scale if scale > 1e100 or scale < 1e-100 else x
                            by.setdefault(len(x), []).append(i)
                for dim, at in by.items():
                    x = np.stack([arrays[i] for i in at])
                    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                    for i, row, found in zip(at, x, code_for(dim, power, threshold, recall).decode(unit), strict=True):
                        payloads[i] = row.tobytes()
                        nodes[i] = hashlib.blake2b(payloads[i], digest_size=16).digest()
                        filters[i] = found * 65536 + dim % 65536
                yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.binary()), pa.array(payloads, pa.binary()), pa.array(filters, pa.list_(pa.int64()))], ["vec_id", "node", "payload", "filters"])

    signed = checkpointed(mapped(vectors, run, "vec_id long, node binary, payload binary, filters array<long>"))
    sound, alone = signed.filter("node is not null"), signed.filter("node is null")
    nodes = sound.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.min("payload").alias("payload"))
    members = checkpointed(shared_buckets(sound.select("node", F.explode("filters").alias("bucket"))))
    links = checkpointed(verify(tiles(members, nodes.select("node", "payload", "copies")), cosine_at_least(threshold)))
    linked = classes(sound.select(F.col("vec_id").alias("doc_id"), "node"), nodes.select("node", "copies", "first"), links)
    linked = linked.select(F.col("doc_id").alias("vec_id"), "n_links", F.col("class_id").alias("component_id"))
    rows = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return rows.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
