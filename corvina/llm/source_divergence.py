"""How far apart the sources of a language are, and by which terms.

Terms are runs of ASCII letters (A-Z in small letters) and of characters beyond ASCII.
Tasks count them per language and source; a language keeps the terms that stand in
enough of its documents.  The kept counts are dealt to tiles, each a block of terms by
a block or two of sources, dense because a term that a source lacks has a probability
too.  A tile is an int64 matrix of scaled probabilities, all its pairs of sources are
compared by broadcasting, and it gives a partial sum for each pair and the best terms
of each source; Spark adds up the sums and merges the best.  All arithmetic is on whole
numbers: exact while a language has fewer than 9 * 10**15 terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import mapped, slices, split_words, stored, strings

#: Documents of its language that a term must stand in, and best terms of a source.
MIN_DOCS, BEST = 10, 10
#: Terms and sources of a block, and the differences that a tile holds at once.
TERMS, SOURCES, ENTRIES = 8192, 128, 1 << 20
#: Counts that a task holds before it gives them out.
HELD = 3 << 18
SALTS = 64
#: ASCII letters in small letters, other ASCII as spaces, all else as it is.
LETTERS = bytes(i | 32 if 65 <= i <= 90 else i if i > 127 or 97 <= i <= 122 else 32 for i in range(256))


def _numpy(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def counts(docs: DataFrame) -> DataFrame:
    """`lang, source, term, n, docs`: occurrences of a term and the documents with it, a row or a few from each task."""
    names = ["lang", "source", "term", "n", "docs"]

    def found(batch: pa.RecordBatch) -> pa.Table:
        texts = strings(batch.column("text"))
        _, offsets, data = texts.buffers()
        letters = pa.py_buffer((data.to_pybytes() if data else b"").translate(LETTERS))
        per_text, codes, terms = split_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, letters]))
        groups = pa.StructArray.from_arrays([batch.column("lang").dictionary_encode().indices, batch.column("source").dictionary_encode().indices], ["a", "b"])
        wide = int(pc.max(groups.field(1)).as_py()) + 1
        group = _numpy(groups.field(0)).astype(np.int64) * wide + _numpy(groups.field(1))
        _, first, group = np.unique(group, return_index=True, return_inverse=True)
        keys, n = np.unique(np.repeat(group, per_text) * len(terms) + codes, return_counts=True)
        alone = np.unique(np.repeat(np.arange(len(texts)), per_text) * len(terms) + codes)
        _, with_it = np.unique(group[alone // max(len(terms), 1)] * len(terms) + alone % max(len(terms), 1), return_counts=True)
        at = pa.array(first[keys // max(len(terms), 1)])
        made = [batch.column("lang").take(at), batch.column("source").take(at), terms.take(pa.array(keys % max(len(terms), 1))), pa.array(n), pa.array(with_it)]
        return pa.table(made, names).filter(pc.field("term") != "")

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        fresh = 0
        for batch in slices(batches, "text"):
            kept.append(found(batch))
            fresh += len(kept[-1])
            if fresh > HELD:
                kept, fresh = [summed(kept)], 0
                if len(kept[0]) > HELD:
                    yield from out(kept.pop())
        if kept:
            yield from out(summed(kept))

    def out(total: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(total), 100_000):
            part = total.slice(i, 100_000).cast(pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]))
            yield from part.combine_chunks().to_batches()

    return mapped(docs.select(_text("lang"), _text("source"), _text("text")), run, "lang string, source string, term string, n long, docs long")


def scaled(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)) by long division."""
    rest, by = count + 2, total + 2 * terms
    whole = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // by, rest % by
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


class _Tile:
    """One block of terms by the sources of two blocks (or one)."""

    def __init__(self, head: pa.Table):
        head = head.sort_by([("side", "ascending"), ("source", "ascending")])
        self.lang, self.alone = head["lang"][0].as_py(), head["i"][0].as_py() == head["j"][0].as_py()
        self.sources, self.total = head["source"].combine_chunks(), head["n"].to_numpy()
        self.terms, self.lang_total, self.absent = (head[c][0].as_py() for c in ("terms", "lang_n", "here"))
        side = head["side"].to_numpy()
        first = len(side) if self.alone else int((side == head["i"][0].as_py()).sum())
        self.rows, self.columns = np.arange(first), np.arange(0 if self.alone else first, len(side))
        self.sums = np.zeros((len(self.rows), len(self.columns)), np.int64)
        self.best: list[list[tuple[int, str]]] = [[] for _ in range(len(side))]

    def add(self, rows: pa.Table) -> None:
        """Counts of whole terms, in the order of the terms."""
        name, source = rows["term"].combine_chunks(), pc.index_in(rows["source"].combine_chunks(), value_set=self.sources).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], _numpy(pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)))]))
        term = np.repeat(np.arange(len(first)), np.diff([*first, len(name)]))
        self.absent -= len(first)
        n, lang_n = rows["n"].to_numpy(), rows["lang_n"].to_numpy()[first]
        count = np.zeros((len(self.sources), len(first)), np.int64)
        count[source, term] = n
        p = scaled(count, self.total[:, None], self.terms)
        step = max(1, ENTRIES // max(self.sums.size, 1))
        for t in range(0, len(first), step):
            self.sums += apart(p[self.rows, None, t : t + step], p[None, self.columns, t : t + step]).sum(2)
        if self.alone:
            q = scaled(lang_n, np.full(len(first), self.lang_total), self.terms)
            for s in range(len(self.sources)):
                some = np.flatnonzero((count[s] > 0) & (p[s] > q))
                value = apart(p[s, some], q[some])
                top = np.argsort(-value, kind="stable")[:BEST]
                here = zip((-value[top]).tolist(), name.take(pa.array(first[some[top]])).to_pylist(), strict=True)
                self.best[s] = sorted([*self.best[s], *here], key=lambda x: (x[0], x[1].encode()))[:BEST]

    def out(self) -> pa.RecordBatch:
        names = self.sources.to_pylist()
        if self.absent:  # terms of the block that only other sources have
            p = scaled(np.zeros(len(names), np.int64), self.total, self.terms)
            self.sums += self.absent * apart(p[self.rows, None], p[None, self.columns])
        a, b = np.nonzero(self.rows[:, None] < self.columns[None, :])
        pairs = list(zip(self.rows[a].tolist(), self.columns[b].tolist(), self.sums[a, b].tolist(), strict=True))
        rows = [(names[x], "pair", names[y], v) for a, b, v in pairs for x, y in ((a, b), (b, a))]
        rows += [(names[s], "term", term, -v) for s, best in enumerate(self.best) for v, term in best]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(self.lang), len(rows)), *map(pa.array, columns, types)], ["lang", "source", "part", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by tile, heads first, then counts by term."""
    key, head, held, tile = None, [], [], None

    def flush(last: bool) -> None:
        """Add the terms that are whole: all but the one that comes last, unless no more rows come."""
        nonlocal tile
        if tile is None:
            tile = _Tile(pa.Table.from_batches(head))
            head.clear()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            whole = len(rows)
            if not last:
                whole = pc.index(rows["term"], rows["term"][-1]).as_py()
                held.extend(rows.slice(whole).to_batches())
            if whole:
                tile.add(rows.slice(0, whole))

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "i", "j")), strict=True))
        kinds = _numpy(pc.is_valid(batch.column("term")))
        edges = [0, *(x for x in range(1, len(keys)) if keys[x] != keys[x - 1] or kinds[x] != kinds[x - 1]), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if key is not None and keys[a] != key:
                flush(True)
                yield tile.out()
                tile = None
            key = keys[a]
            (held if kinds[a] else head).append(batch.slice(a, b - a))
        if sum(len(x) for x in held) >= TERMS:
            flush(False)
    if key is not None:
        flush(True)
        yield tile.out()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`lang, source, part, item, value, rank` for each source of each language.

    Part `pair` has each other source of the language, part `term` the terms that mark
    the source most against its language.  Null lang, source and text are empty text;
    rows that repeat count each time; a source without terms has pairs and no terms, and
    a language that keeps no term has pairs of value 0.  An empty table gives no rows.
    """
    word = Window.partitionBy("lang", "term")
    per = counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per = per.select("lang", "source", "term", "n", F.sum("n").over(word).alias("lang_n"), F.sum("docs").over(word).alias("docs"), (F.row_number().over(word.orderBy("source")) == 1).cast("long").alias("first"))
    kept = stored(per.filter(F.col("docs") >= min_docs).drop("docs"))
    every = docs.select(_text("lang"), _text("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    groups = stored(every.join(own, ["lang", "source"], "left").fillna(0, ["n", "first"]))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("first").alias("terms"), F.count("*").alias("sources"))
    langs = langs.select("lang", "lang_n", "terms", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int").alias("blocks"), F.ceil(F.col("sources") / SOURCES).cast("int").alias("sides"))
    side = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int").alias("side")
    salted = langs.select("lang", "blocks", "sides", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cells = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    cells = cells.withColumn("block", F.pmod(F.xxhash64("term", F.lit(1)), F.col("blocks")).cast("int"))
    none = F.lit(None).cast("long")
    here = cells.groupBy("lang", "block").agg(F.sum("first").alias("here"))
    cells = cells.select("lang", "block", "sides", side, "source", "term", "n", "lang_n", none.alias("terms"), none.alias("here"))
    heads = langs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(here, ["lang", "block"], "left")
    heads = groups.select("lang", "source", "n").join(heads, "lang")
    heads = heads.select("lang", "block", "sides", side, "source", F.lit(None).cast("string").alias("term"), "n", "lang_n", "terms", F.coalesce("here", F.lit(0)).cast("long").alias("here"))
    rows = cells.unionAll(heads).select("*", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    rows = rows.select("lang", "block", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "source", "term", "n", "lang_n", "terms", "here")
    dealt = rows.repartition("lang", "block", "i", "j").sortWithinPartitions("lang", "block", "i", "j", F.col("term").asc_nulls_first())
    found = mapped(dealt, _tiles, "lang string, source string, part string, item string, value long")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", F.row_number().over(best).alias("rank"))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= BEST))
