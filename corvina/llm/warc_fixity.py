"""Fixity audit of WARC replicas with Merkle trees over offset ranges.

Each record is hashed.  The records that begin in a range of `1 << LEAF_BITS` bytes
of a file make a leaf of the file's tree; each level above covers `1 << FAN_BITS`
ranges of the level below, up to the file's root.  Ranges follow from offsets, so a
node gathers the records of one range and no more, however large a file is.  Two
replicas are compared root by root; only the children of differing nodes are looked
at further, and in the end the records of differing leaves.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed, mapped

LEAF_BITS = 16
FAN_BITS = 3
LEVELS = 6
#: Pages of one file in `layout`.
FILE_PAGES = 256
DATE = "2024-01-01T00:00:00Z"
NEWLINE = "\r\n"
GAP, GZIP = b"\r\n\r\n", b"\x1f\x8b\x08"
#: Where a record may begin after damage.
START = re.compile(rb"WARC/\d\.\d+\r\n|\x1f\x8b\x08[\x00-\x1f]")
#: Where a line of a plain file begins a record: no head has such a line.
LINE = re.compile(rb"\r\n(?=WARC/\d\.\d+\r\n)")
#: Bytes of a compressed record that are unpacked at once at most, and bytes of payload in a batch.
BLOCK, BATCH = 1 << 16, 8 << 20


def record(url: Column, page_id: Column, html: Column) -> Column:
    """A page as a WARC resource record; nulls are empty."""
    html, url, number = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit("")), F.coalesce(page_id.cast("string"), F.lit(""))
    parts = [
        F.lit(f"WARC/1.0{NEWLINE}WARC-Type: resource{NEWLINE}WARC-Date: {DATE}{NEWLINE}WARC-Target-URI: "), url, F.lit(f"{NEWLINE}WARC-Record-ID: <urn:page:"), number,
        F.lit(f">{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), F.octet_length(html).cast("string"), F.lit(NEWLINE * 2), html, F.lit(NEWLINE * 2),
    ]
    return F.concat(*parts)


def layout(pages: DataFrame) -> DataFrame:
    """`page_id, file, offset, length, digest, copies` of every distinct record of `page_id, url, html`.

    A file holds the records of `FILE_PAGES` consecutive ids in the order of ids, then
    digests.  Equal records of one id are stored once and counted.  Null ids are spread
    over files of their own by digest; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("url").cast("string"), F.col("page_id").cast("long"), F.col("html").cast("string")).alias("record"))
    rows = rows.select("page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length")).groupBy("page_id", "digest", "length").agg(F.count("*").alias("copies"))
    file = F.coalesce(F.floor(F.col("page_id") / FILE_PAGES).cast("string"), F.concat(F.lit("null-"), F.substring("digest", 1, 2)))
    within = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.withColumn("file", file).withColumn("offset", F.sum("length").over(within) - F.col("length")).select("page_id", "file", "offset", "length", "digest", "copies")


def leaves(records: DataFrame) -> DataFrame:
    """Lowest nodes `file, node, hash` of records `file, offset, length, digest`."""
    item = F.struct("offset", "length", "digest")
    text = F.transform(F.sort_array(F.collect_set(item)), lambda x: F.concat_ws(" ", x["offset"], x["length"], x["digest"]))
    return records.groupBy("file", F.shiftright("offset", LEAF_BITS).alias("node")).agg(F.sha2(F.concat_ws("\n", text), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """Nodes one level up: the hash of the children's places and hashes, in order."""
    text = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(" ", x["node"], x["hash"]))
    return nodes.groupBy("file", F.shiftright("node", FAN_BITS).alias("up")).agg(F.sha2(F.concat_ws("\n", text), 256).alias("hash")).withColumnRenamed("up", "node")


@dataclass
class Trees:
    """Records of one replica and the levels of its files' trees, leaves first, each written once."""

    records: DataFrame
    levels: list[DataFrame]


def trees(records: DataFrame) -> Trees:
    """Trees of records `file, offset, length, digest`; those with a null file or offset can't be located and are left out.

    The last level has one node per file for files up to 2**(LEAF_BITS + FAN_BITS * LEVELS) bytes.
    """
    records = checkpointed(records.select("file", "offset", "length", "digest").filter("file is not null and offset is not null"))
    levels = [checkpointed(leaves(records))]
    for _ in range(LEVELS):
        levels.append(checkpointed(parents(levels[-1])))
    return Trees(records, levels)


def _differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys under which two tables have not the same value, with both values; null where one has none."""
    both = a.select(*keys, F.col(value).alias("a"), F.lit(None).cast("string").alias("b")).unionByName(b.select(*keys, F.lit(None).cast("string").alias("a"), F.col(value).alias("b")))
    return both.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))


def audit(primary: Trees, replica: Trees) -> DataFrame:
    """`file, offset, status, digest, replica_digest` of the records that differ.

    One record stands at an offset (of several the greatest digest counts).  status:
    corrupt, missing (in the replica) or extra.  Repeated rows count once; equal or
    empty replicas give no rows.
    """
    sides = (primary, replica)
    suspects = _differing(*(x.levels[-1] for x in sides), ["file", "node"], "hash").select("file", "node")
    for level in range(LEVELS - 1, -1, -1):
        marked = suspects.withColumnRenamed("node", "up")
        children = [x.levels[level].withColumn("up", F.shiftright("node", FAN_BITS)).join(marked, ["file", "up"], "left_semi") for x in sides]
        suspects = checkpointed(_differing(*children, ["file", "node"], "hash").select("file", "node"))
    marked = suspects.withColumnRenamed("node", "up")
    inside = [x.records.withColumn("up", F.shiftright("offset", LEAF_BITS)).join(marked, ["file", "up"], "left_semi").withColumn("all", F.concat_ws(" ", "digest", "length")) for x in sides]
    found = _differing(*inside, ["file", "offset"], "all")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return found.select("file", "offset", status.alias("status"), F.substring_index("a", " ", 1).alias("digest"), F.substring_index("b", " ", 1).alias("replica_digest"))


def roots(built: Trees) -> DataFrame:
    """`file, root` of every file."""
    return built.levels[-1].groupBy("file").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("hash"))), 256).alias("root"))


def _unpacked(data: bytes, pos: int) -> tuple[bytes, int] | None:
    """The gzip member of a record at a place, by growing blocks, and where it ends; None if it is broken or none."""
    unpack, out, block = zlib.decompressobj(31), [], 512
    try:
        while not unpack.eof and pos < len(data):
            out.append(unpack.decompress(data[pos : pos + block]))
            pos += block
            block = min(2 * block, BLOCK)
            if len(out) == 1 and not out[0].startswith(b"WARC/"):
                return None
        out.append(unpack.flush())
    except zlib.error:
        return None
    return b"".join(out), min(pos, len(data)) - len(unpack.unused_data)


def _headers(head: bytes) -> tuple[dict[str, str], int | None]:
    """Headers in small letters, and the payload's length; None if it is no number."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = headers.get("content-length", "0") or "0"
    return headers, int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in small letters, payload) of the records of a WARC file, plain or gzip by record.

    Together the records cover the file.  A stretch that is no record, or whose length
    is no number, is given up to the next beginning of a record, with the headers that
    it has and no payload; a head with a line that begins a record isn't one; a record cut short
    has the payload that is there.  Time is linear in the file.
    """
    pos, size = 0, len(data)
    gap = data.find(GAP)  # the first at or after pos: looked for once
    while pos < size:
        headers: dict[str, str] = {}
        if 0 <= gap < pos:
            gap = data.find(GAP, pos)
        if data.startswith(b"WARC/", pos):
            if gap >= 0 and not LINE.search(data, pos, gap + 2):
                headers, length = _headers(data[pos:gap])
                if length is not None:
                    begin = gap + len(GAP)
                    end = min(begin + length + len(GAP), size)
                    yield pos, end - pos, headers, data[begin : begin + length]
                    pos = end
                    continue
        elif data.startswith(GZIP, pos):
            found = _unpacked(data, pos)
            if found and GAP in found[0]:
                head, _, body = found[0].partition(GAP)
                headers, length = _headers(head)
                yield pos, found[1] - pos, headers, body[: length or 0]
                pos = found[1]
                continue
        again = START.search(data, pos + 1)
        end = again.start() if again else size
        yield pos, end - pos, headers, b""
        pos = end


def read(files: DataFrame) -> DataFrame:
    """`file, offset, length, digest, uri, payload` of the records in files of Spark's binaryFile source; digest is of the stored bytes."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["file", "offset", "length", "digest", "uri", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for offset, length, headers, body in parse(data := content.as_py() or b""):
                    rows.append((path, offset, length, hashlib.sha256(memoryview(data)[offset : offset + length]).hexdigest(), headers.get("warc-target-uri"), body))
                    held += len(body)
                    if held >= BATCH or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return mapped(files.select("path", "content"), run, "file string, offset long, length long, digest string, uri string, payload binary")
