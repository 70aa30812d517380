"""Jaccard join of documents on word n-grams by MinHash banding.

A document is its set of five-word shingles (runs of letters, digits and
underscores, in small letters).  Documents with one set are one node.  Every node's MinHash values are
cut into bands of `rows` values; band and row counts follow from the recall wanted
at the threshold.  Nodes that share a band stand in a bucket; pairs in a bucket are
verified on their full sets.  Only nodes in a bucket with others are read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, mapped, ranges, slices, split_words, strings
from ._links import components, shared_buckets, tiles, verify

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
#: MinHash values a document may have at most; more rows a band mean fewer needless candidates.
VALUES = 160
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, values: int = VALUES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the bands that reach the recall stay within `values`."""
    best = None
    for rows in range(1, values + 1):
        bands = 1 if threshold >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows > values:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall can't be reached within so many values")
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, from their UTF-8 bytes."""
    raw = [w.encode() for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    most = int(lengths.max(initial=0))
    powers = np.cumprod(np.full(max(most, 1), MULTIPLIER))
    place = ranges(np.zeros(len(raw), np.int64), lengths)
    total = np.zeros(len(raw), np.uint64)
    some = lengths > 0
    if some.any():
        total[some] = np.add.reduceat(flat * powers[place], (np.cumsum(lengths) - lengths)[some])
    return mix(total + lengths.astype(np.uint64))


def shingles(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's set of n-grams, sorted; how many each text has).

    A text of fewer than n words has one shingle of them all, one without words none.
    """
    # what is neither letter, mark, digit nor underscore becomes a space
    texts = pc.replace_substring_regex(pc.utf8_lower(strings(texts)), r"[^\pL\pM\pN_]+", " ")
    counts, codes, words = split_words(pc.utf8_trim(texts, " "))
    keep = word_hashes(words.to_pylist())
    empty = np.array(pc.equal(words, "").to_numpy(zero_copy_only=False), bool)
    if empty.any():
        real = ~empty[codes]
        owner = np.repeat(np.arange(len(counts)), counts)
        counts, codes = np.bincount(owner[real], minlength=len(counts)), codes[real]
    h = keep[codes]
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = ranges(np.cumsum(counts) - counts, made)
    size = np.repeat(np.minimum(counts, n), made)
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        inside = k < size
        total[inside] = total[inside] * MULTIPLIER + h[first[inside] + k]
    total = mix(total + size.astype(np.uint64))
    owner = np.repeat(np.arange(len(counts)), made)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[new], np.bincount(owner[new], minlength=len(counts))


def set_ids(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes for each set; equal sets have equal ones."""
    starts = np.cumsum(counts) - counts
    some = counts > 0
    halves = np.zeros((len(counts), 2), np.uint64)
    for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
        if some.any():
            halves[some, k] = np.add.reduceat(mix(values * np.uint64(2 * salt + 1)), starts[some])
    halves[:, 0] += counts.astype(np.uint64)
    return [x.tobytes() for x in halves]


def band_keys(values: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band and set that isn't empty."""
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64)
    keys = np.zeros((int(some.sum()), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(keys), band, np.uint64)
        for k in range(band * rows, band * rows + rows):
            low = np.minimum.reduceat((values * factors[k] + adds[k]) >> np.uint64(16), starts) if len(starts) else key
            key = mix(key * MULTIPLIER + low)
        keys[:, band] = key
    return keys


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """`doc_id, key, tie, node, bands` of every row: its set's id and its band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, counts = shingles(batch.column("text"), n)
            keys = band_keys(values, counts, bands, rows)
            offsets = np.concatenate([[0], np.cumsum((counts > 0) * bands)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("tie"), pa.array(set_ids(values, counts), pa.binary()), lists], ["doc_id", "key", "tie", "node", "bands"])

    return mapped(docs, run, "doc_id long, key long, tie long, node binary, bands array<long>")


def payloads(rows: DataFrame, n: int = N) -> DataFrame:
    """`node, payload, copies`: the set of each row's text as bytes of sorted 64-bit hashes; rows whose set isn't the node's are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, counts = shingles(batch.column("text"), n)
            sets = [x.tobytes() for x in np.split(values, np.cumsum(counts)[:-1])]
            made = pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary()), batch.column("copies")], ["node", "payload", "copies"])
            yield made.filter(pc.equal(batch.column("node"), pa.array(set_ids(values, counts), pa.binary())))

    return mapped(rows.select("node", "text", "copies"), run, "node binary, payload binary, copies long")


def jaccard_at_least(threshold: float):
    """Function that says which of a tile's sets have a Jaccard similarity of `threshold` or more."""

    def similar(sets: list[bytes]) -> np.ndarray:
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        sizes = np.array([*map(len, arrays)], np.int64)
        count = len(arrays)
        common = np.zeros((count, count), np.int64)
        if count <= 6:
            for a in range(count):
                for b in range(a + 1, count):
                    if min(sizes[a], sizes[b]) >= threshold * max(sizes[a], sizes[b]):
                        common[a, b] = len(np.intersect1d(arrays[a], arrays[b], assume_unique=True))
        else:
            owner = np.repeat(np.arange(count), sizes)
            _, at, seen = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
            # shingles that all share add the same to each pair, and those of one set nothing
            everywhere = int((seen == count).sum())
            use = (seen > 1) & (seen < count)
            column = np.cumsum(use) - 1
            used = use[at]
            owner, column = owner[used], column[at][used]
            order = column.argsort(kind="stable")
            owner, column = owner[order], column[order]
            width = 4096
            for low in range(0, int(use.sum()), width):
                a, b = np.searchsorted(column, (low, low + width))
                m = np.zeros((count, width), np.float32)
                m[owner[a:b], column[a:b] - low] = 1
                common += (m @ m.T).astype(np.int64)
            common += everywhere
        union = sizes[:, None] + sizes[None, :] - common
        return common >= threshold * union - 1e-9

    return similar


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """`doc_id, class_id, n_links, n_copies` for every row of `doc_id, text`.

    n_links counts the other rows whose n-gram sets have a Jaccard similarity of the
    threshold or more, rows with an equal set included; class_id is the least doc_id
    that links reach, n_copies the rows with an equal set.  A null text is empty; rows
    without words have equal (empty) sets and link with each other alone; null doc_ids
    are never a class's least one unless it has no other; repeated rows link like
    others; other columns are ignored; an empty table gives no rows.
    """
    signed, nodes, links = _linked(docs, threshold, recall, n)
    return classes(signed.select("doc_id", "node"), nodes, links)


def _key(docs: DataFrame) -> Column:
    """A row's id, or for rows without one the hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def _tie(docs: DataFrame) -> Column:
    """What tells rows with one key apart: the hash of the text."""
    return F.xxhash64(F.col("text").cast("string"))


def _linked(docs: DataFrame, threshold: float, recall: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their nodes, nodes, verified links)."""
    bands, rows = bands_for(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(docs).alias("key"), _tie(docs).alias("tie"), F.col("text").cast("string").alias("text"))
    signed = checkpointed(signatures(docs, bands, rows, n))
    nodes = signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "key", "tie")).alias("k")).select("node", "copies", "first", "k.key", "k.tie")
    members = checkpointed(shared_buckets(signed.select("node", F.explode("bands").alias("bucket"))))

    # One text for each node in a bucket; the rows that repeat it go where the join has brought them.
    wanted = members.select("node").distinct().join(nodes, "node").select("key", "tie", "node", "copies")
    found = docs.select("key", "text", "tie").join(wanted, ["key", "tie"]).dropDuplicates(["key", "node", "tie"])
    links = checkpointed(verify(tiles(members, payloads(found, n)), jaccard_at_least(threshold)))
    return signed, nodes, links


def representatives(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = N) -> DataFrame:
    """The rows of `docs` with all their columns, one of each class: that with the least id.

    Rows without an id stay only where their class has no row with one, and of
    several of them one stays; rows that repeat an id are judged each by its own text.
    """
    signed, nodes, links = _linked(docs, threshold, recall, n)
    roots = components(links.filter("other is not null").select("node", "other"))
    known = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.struct(F.col("first").isNull().alias("none"), "key", "tie").alias("who"))
    chosen = checkpointed(known.groupBy("root").agg(F.min("who").alias("who")).select("root", F.struct("who.key", "who.tie").alias("stays")))
    stays = known.join(chosen, "root").select("node", "stays")
    gone = checkpointed(signed.select("key", "tie", "node").join(stays, "node").filter("key <> stays.key or tie <> stays.tie").select("key", "tie").distinct())
    left = docs.withColumns({"_row_key": _key(docs), "_row_tie": _tie(docs)}).join(gone.withColumnsRenamed({"key": "_row_key", "tie": "_row_tie"}), ["_row_key", "_row_tie"], "left_anti")
    if signed.groupBy("key", "tie").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["_row_key", "_row_tie"])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def classes(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`doc_id, class_id, n_links, n_copies` from rows (doc_id, node), nodes (node, copies, first) and verified links."""
    counts = links.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.filter("other is not null").select("node", "other"))
    known = nodes.join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # written, so that the join below deals both sides anew and a large class's part can be split
    known = checkpointed(known)
    least = checkpointed(known.groupBy("root").agg(F.min("first").alias("class_id")))
    known = known.join(least, "root").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    return rows.join(known, "node").select("doc_id", "class_id", "n_links", "n_copies")
