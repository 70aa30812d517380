import gzip
import hashlib
import time

import pytest
from corvina.llm import warc_fixity

PAGES = "page_id long, url string, html string"


def make(spark, n=700):
    return warc_fixity.layout(spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(n)], PAGES))


def audit(a, b):
    return warc_fixity.audit(warc_fixity.trees(a), warc_fixity.trees(b))


def damage(rows, spark, change=(), lose=(), add=()):
    out = [(r.file, r.offset, r.length, "0" * 64 if r.page_id in change else r.digest) for r in rows if r.page_id not in lose]
    return spark.createDataFrame([*out, *add], "file string, offset long, length long, digest string")


def test_layout_is_the_files_bytes(spark):
    rows = sorted(make(spark, 300).collect(), key=lambda r: (r.file, r.offset))
    for name in {r.file for r in rows}:
        data, mine = b"", [r for r in rows if r.file == name]
        for r in mine:
            html = f"<p>{r.page_id}</p>" * (r.page_id % 40)
            data += f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: {warc_fixity.DATE}\r\nWARC-Target-URI: http://h/{r.page_id}\r\nWARC-Record-ID: <urn:page:{r.page_id}>\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n{html}\r\n\r\n".encode()
        parsed = list(warc_fixity.parse(data))
        assert [(o, n) for o, n, _, _ in parsed] == [(r.offset, r.length) for r in mine]
        assert [hashlib.sha256(data[o : o + n]).hexdigest() for o, n, _, _ in parsed] == [r.digest for r in mine]


def test_damage_is_found(spark):
    rows = make(spark).collect()
    whole = damage(rows, spark)
    by_id = {r.page_id: r for r in rows}
    hurt = damage(rows, spark, change={3, 44, 500}, lose={7, 699}, add=[("9", 5, 1, "f" * 64)])
    got = {(r.file, r.offset): r.status for r in audit(whole, hurt).collect()}
    want = {(by_id[i].file, by_id[i].offset): "corrupt" for i in (3, 44, 500)} | {(by_id[i].file, by_id[i].offset): "missing" for i in (7, 699)} | {("9", 5): "extra"}
    assert got == want
    assert audit(whole, whole).count() == 0
    a, b = ({r.file: r.root for r in warc_fixity.roots(warc_fixity.trees(x)).collect()} for x in (whole, hurt))
    assert [f for f in a if a[f] == b.get(f)] == []
    same = damage(rows, spark, change={3})
    c = {r.file: r.root for r in warc_fixity.roots(warc_fixity.trees(same)).collect()}
    assert a["0"] != c["0"] and a["1"] == c["1"] and a["2"] == c["2"]


def test_edge_rows(spark):
    rows = warc_fixity.layout(spark.createDataFrame([(None, None, None), (None, "u", "x"), (1, None, "é"), (1, None, "é"), (1, "v", None)], PAGES)).collect()
    assert sorted(r.copies for r in rows) == [1, 1, 1, 2]
    assert all(r.file.startswith("null-") for r in rows if r.page_id is None)
    assert warc_fixity.layout(spark.createDataFrame([], PAGES)).count() == 0
    schema = "file string, offset long, length long, digest string, node int"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([("f", 0, 5, "a", 1), ("f", 0, 5, "a", 1), (None, 3, 1, "b", 2), ("f", None, 1, "c", 3), ("f", 1 << 40, 9, None, 4)], schema)
    assert audit(empty, empty).count() == 0
    assert {(r.offset, r.status) for r in audit(some, empty).collect()} >= {(0, "missing")}


@pytest.mark.parametrize("packed", [False, True])
def test_reading_files(spark, tmp_path, packed):
    records = [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u{i}\r\nContent-Length: {i}\r\n\r\n{'x' * i}\r\n\r\n".encode() for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(gzip.compress(r) if packed else r for r in records) + b"rest")
    got = sorted(warc_fixity.read(spark.read.format("binaryFile").load(str(tmp_path))).collect(), key=lambda r: r.offset)
    assert [(r.uri, bytes(r.payload)) for r in got] == [*((f"u{i}", b"x" * i) for i in range(5)), (None, b"")]
    assert sum(r.length for r in got) == (tmp_path / "a.warc").stat().st_size


def stored(n, payload=lambda i: b"x" * (i % 50)):
    return [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(payload(i))}\r\n\r\n".encode() + payload(i) + b"\r\n\r\n" for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_damaged_files_of_a_replica(spark, tmp_path, packed):
    """Real files, read back: bytes changed within records, a broken head, a lost end."""
    for side in "ab":
        (tmp_path / side).mkdir()
    wanted = set()
    for name in ("one.warc", "two.warc", "three.warc"):
        records = [gzip.compress(r, mtime=0) if packed else r for r in stored(400)]
        (tmp_path / "a" / name).write_bytes(b"".join(records))
        starts = [sum(map(len, records[:k])) for k in range(400)]
        if name == "one.warc":
            records[7] = b"\0" * len(records[7])
            records[9] = records[9][:-30] + b"?" + records[9][-29:]
            records[300] = records[300][:4] + b"!" + records[300][5:]
            wanted |= {(name, starts[k], "corrupt") for k in (7, 9, 300)}
        elif name == "two.warc":
            records = records[:390]
            wanted |= {(name, starts[k], "missing") for k in range(390, 400)}
        (tmp_path / "b" / name).write_bytes(b"".join(records))
    sides = [warc_fixity.read(spark.read.format("binaryFile").load(str(tmp_path / x))).selectExpr("substring_index(file, '/', -1) file", "offset", "length", "digest") for x in "ab"]
    got = {(r.file, r.offset, r.status) for r in audit(*sides).collect()}
    assert got >= wanted and {x for x in got - wanted if x[2] != "extra"} == set()


@pytest.mark.parametrize("size", ["abc", "-5", "1e3", "9" * 30, "", "٣"])
def test_lengths_that_are_no_numbers(size):
    head = f"WARC/1.0\r\nWARC-Target-URI: u\r\nContent-Length: {size}\r\n\r\n".encode()
    data = stored(2)[1] + head + b"body\r\n\r\n" + stored(3)[2]
    parsed = list(warc_fixity.parse(data))
    assert sum(n for _, n, _, _ in parsed) == len(data) and parsed[0][3] == b"x" and parsed[-1][3] == b"xx"


def test_parsing_is_linear():
    for part in (stored(1, lambda i: b"y" * 40)[0], gzip.compress(stored(1)[0]), b"WARC/1.0\r\n", b"\x1f\x8b\x08\x00", gzip.compress(b"no record"), b"\nWARC/1.0\r\nContent-Length: x\r\n\r\n"):
        data = part * (3_000_000 // len(part))
        began = time.process_time()
        assert sum(n for _, n, _, _ in warc_fixity.parse(data)) == len(data)
        assert time.process_time() - began < 15, part  # one that copies the rest for each record takes hours


def test_heads_without_end_are_read_once():
    for tail in (b"\r\n\r\n", b""):
        data = b"WARC/1.0\r\nContent-Length: x\r\n" * 34_000 + tail
        began = time.process_time()
        parsed = list(warc_fixity.parse(data))
        assert sum(n for _, n, _, _ in parsed) == len(data) and len(parsed) == 34_000
        assert time.process_time() - began < 1.5
    good = stored(2)[0]
    parsed = list(warc_fixity.parse(b"WARC/1.0\r\nContent-Length: 3\r\n" + good))
    assert [n for _, n, _, _ in parsed][1:] == [n for _, n, _, _ in warc_fixity.parse(good)]
