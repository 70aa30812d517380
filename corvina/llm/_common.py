"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a Python worker; bounds memory, not results.
SLICE_BYTES = 2 << 20


def ready(spark: SparkSession) -> None:
    """Let Python workers find this library where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with this library at hand in the workers."""
    ready(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    It comes from ``spark.checkpoint.dir``; only a local session without that setting
    and without a folder of its own (tests) gets a temporary one, a cluster's raises
    RuntimeError.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvina-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder and read back: smaller than a checkpoint, and readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `limit` bytes in each; one row at least."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(edges):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and executors count what they keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array) -> pa.Array:
    """Nulls as empty texts, 64-bit offsets, no slice of a longer array (some kernels misread those)."""
    return pa.concat_arrays([pc.fill_null(column, "").cast(pa.large_string())])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space, as (words per text, code of each word, distinct words).

    An empty word stands where a text begins or ends with white space.
    """
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each pair, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def gather(counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all texts and how many each has, from the values of the distinct words."""
    starts = np.cumsum(lengths) - lengths
    per_word = lengths[codes]
    values = flat[ranges(starts[codes], per_word)]
    ends = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(counts)])]
    return values, np.diff(ends)


class WordMemo:
    """Keeps what `encode` gives for words, up to `limit` of them (a cache: results don't depend on it)."""

    def __init__(self, encode, limit: int = 300_000):
        self.encode, self.limit, self.known = encode, limit, {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word counted, ids of all words)."""
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            for i, ids in zip(missing, self.encode([words[i] for i in missing]), strict=True):
                found[i] = np.asarray(ids, "<u4").tobytes()
            room = self.limit - len(self.known)
            for i in missing[: max(room, 0)]:
                self.known[words[i]] = found[i]
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return lengths, np.frombuffer(b"".join(found), "<u4")
