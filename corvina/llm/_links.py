"""Verification of candidate pairs inside buckets, and classes of what is linked.

Candidates are never made into rows.  A member of a bucket is a row with its payload;
a bucket of many members is cut into blocks, and each pair of blocks is a tile that
one task verifies in memory.  A pair that shares several buckets counts in the one
with the least id.  What a tile gives is one count for each member and a forest of
links, so results grow with the members, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, mapped, slices

#: Members of a block; a tile has two blocks.
BLOCK = 256


def shared_buckets(pairs: DataFrame) -> DataFrame:
    """Distinct `bucket, node` rows that stand in a bucket with others; of buckets with the same members one is kept.

    Adds `members`, the size of the bucket.
    """
    distinct = checkpointed(pairs.select("bucket", "node").distinct())
    sizes = distinct.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("members > 1")
    kept = sizes.groupBy("members", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
    return distinct.join(kept, "bucket")


def tiles(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows `bucket, i, j, block, node, buckets, payload, copies` for `members` (bucket, node, members) and `nodes` (node, payload, copies)."""
    mine = members.groupBy("node").agg(F.collect_list(F.struct("bucket", "members")).alias("in"), F.sort_array(F.collect_list("bucket")).alias("buckets"))
    rows = nodes.join(mine, "node").select("node", "payload", "copies", "buckets", F.explode("in").alias("b"))
    blocks = F.ceil(F.col("b.members") / BLOCK).cast("int")
    rows = rows.select("node", "payload", "copies", "buckets", F.col("b.bucket").alias("bucket"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "buckets", "payload", "copies")


def _earlier(lists: list[np.ndarray], bucket: int) -> np.ndarray:
    """Which members share a bucket of lesser id."""
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [*map(len, lists)])
    less = flat < bucket
    ids, at = np.unique(flat[less], return_inverse=True)
    if not len(ids):
        return np.zeros((len(lists), len(lists)), bool)
    seen = np.zeros((len(lists), len(ids)), np.float32)
    seen[owner[less], at] = 1
    return seen @ seen.T > 0


def _forest(n: int, a: np.ndarray, b: np.ndarray, order: list[bytes]) -> list[tuple[int, int]]:
    """Links of every member to the least member of its class, of those that have one."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            low, high = (x, y) if order[x] < order[y] else (y, x)
            parent[high] = low
    return [(x, root(x)) for x in range(n) if root(x) != x]


def verify(tiled: DataFrame, similar: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """`node, other, links`: links of a node inside tiles (other null), and a forest of links (links 0).

    `similar` gives the boolean matrix of a tile's payloads.
    """

    def solve(rows: list[tuple]) -> tuple[list, list, list]:
        bucket, i, j = rows[0][:3]
        blocks = np.array([r[3] for r in rows])
        nodes = [r[4] for r in rows]
        hit = np.triu(similar([r[6] for r in rows]), 1)
        if i != j:  # pairs inside a block belong to that block's own tile
            hit &= blocks[:, None] != blocks[None, :]
        if hit.any():
            hit &= ~_earlier([np.asarray(r[5]) for r in rows], bucket)
        a, b = hit.nonzero()
        if not len(a):
            return [], [], []
        copies = np.array([r[7] for r in rows], np.int64)
        links = np.bincount(a, weights=copies[b], minlength=len(rows)) + np.bincount(b, weights=copies[a], minlength=len(rows))
        some = np.flatnonzero(links).tolist()
        edges = _forest(len(rows), a, b, nodes)
        return [nodes[x] for x in some] + [nodes[x] for x, _ in edges], [None] * len(some) + [nodes[y] for _, y in edges], [int(links[x]) for x in some] + [0] * len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            if len(held) > 1:
                for x, y in zip(out, solve(held), strict=True):
                    x.extend(y)
            held.clear()

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["node", "other", "links"])
            for x in out:
                x.clear()
            return made

        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "node", "buckets", "payload", "copies")), strict=True):
                if held and held[0][:3] != row[:3]:
                    close()
                if not held or held[-1][4] != row[4]:  # a node may come twice
                    held.append(row)
            yield batch_out()
        close()
        yield batch_out()

    dealt = tiled.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return mapped(dealt, run, "node binary, other binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """`node, root` of every node of `node, other` edges: root is the least node that links reach.

    Alternates large and small stars; every round writes its edges to the shared
    checkpoint folder, and rounds end when the edges stay as they are.
    """
    e = edges.select(F.greatest("node", "other").alias("v"), F.least("node", "other").alias("u")).filter("u is not null and v <> u").distinct()
    e, before = checkpointed(e), None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select("u", "v")).toDF("v", "u")  # v has the neighbour u
        # written, so that the join deals both sides anew and a hub's neighbours can be split
        least = checkpointed(both.groupBy("v").agg(F.min("u").alias("n")).select("v", F.least("v", "n").alias("m")))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = checkpointed(large)
        least = checkpointed(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.*")
        e = checkpointed(small.filter("v <> u").distinct())
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(roots)
