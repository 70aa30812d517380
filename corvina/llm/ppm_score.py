"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to `ORDER` bytes, trained on all texts that
are not held out.  A text is its bytes in small letters (A-Z only) after `ORDER` end
marks, and one end mark after them.  A symbol is coded in the longest context that the
training texts have: where it makes c of the T symbols seen there, q of them different,
its probability is (2c - 1) / 2T, and q / 2T is the escape to the context one byte
shorter, in which the symbols of the longer context are excluded from T and q.  Below
the empty context all symbols not yet excluded are alike.  The probabilities of the next
symbol sum to one in each context.

The trie has a row for each context and symbol; lower orders are sums over it.  Texts never meet the whole trie: the documents of a block ask for their distinct
n-grams, and the log-probability of each goes back to the block.  A block asks each
range of contexts for its n-grams of that range in one row, sorted and compressed, and
gets one row back, so an n-gram takes a byte or two on its way in place of a row.
What a task holds is one block's answers, or the distinct n-grams of one range, however
large the trie is.  The unigram base is found in the same way, with words for n-grams.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, mapped, slices, split_words, stored, strings

#: Bytes of the longest context (six at most: an n-gram is one long).
ORDER = 6
#: The end mark, a byte that no UTF-8 text has, and the number of symbols.
END, SYMBOLS = 0xFF, 256
#: Bytes of text of a block, and of a window whose n-grams are looked up at once.
BLOCK, WINDOW = 32 << 20, 1 << 19
#: Bytes of context up to which levels are tables, and bytes of text for each range of longer contexts, or of words.
SHORT, RANGE = 4, 16 << 20
#: N-grams that a task holds before it counts them.
RAW = 1 << 20
#: How hard texts and words are compressed.
LEVEL = 6
#: What a word counts before it is seen.
PRIOR = 0.1
#: Many answers are alike and aren't kept: the only symbol of a context seen once, and a word seen once.
USUAL, USUAL_COUNT = float(np.log10(0.5)), 1.0
ANSWER = ["keys", "seen", "totals", "escapes"]
WHAT = {"word": 0, "gram": 1, "texts": 2}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id is read as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _numpy(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def windows(texts: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, index of the text of each), for a bounded number of n-grams at once; n + 1 for n bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    spans = np.diff(offsets) + order + 1
    starts = np.cumsum(spans) - spans
    flat = np.full(int(spans.sum()) + order, END, np.uint8)
    valid = np.ones(len(flat), bool)
    for start, a, b in zip(starts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        flat[start + order : start + order + b - a] = data[a:b]
        valid[start + b - a + 1 : start + b - a + 1 + order] = False
    for at in range(0, len(flat) - order, WINDOW):
        to = min(at + WINDOW, len(flat) - order)
        grams = flat[at:to].astype(np.int64)
        for k in range(1, order + 1):
            grams = grams << 8 | flat[at + k : to + k]
        first, last = np.searchsorted(starts, [at, to - 1], "right") - 1
        some = slice(first, last + 1)
        inside = np.minimum(starts[some] + spans[some], to) - np.maximum(starts[some], at)
        owner = np.repeat(np.arange(first, last + 1), inside)
        keep = valid[at:to]
        yield grams[keep], owner[keep]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their counts; each part is sorted and distinct."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.sort(np.concatenate([x for x, _ in parts]))
    grams = grams[np.append(True, grams[1:] != grams[:-1])]
    counts = np.zeros(len(grams), np.int64)
    for x, n in parts:
        counts[np.searchsorted(grams, x)] += n
    return grams, counts


def _counted(words: list[pa.Table]) -> pa.Table:
    coded = pa.concat_arrays([c for t in words for c in t["word"].chunks]).dictionary_encode()
    n = np.bincount(_numpy(coded.indices), np.concatenate([t["n"].to_numpy() for t in words]), len(coded.dictionary))
    return pa.table({"word": coded.dictionary, "n": pa.array(n.astype(np.int64))})


def squeezed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed: all lowest bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def squeezed_words(words: list[bytes]) -> bytes:
    """Words, which have no line feeds, compressed with one to a line."""
    lines = b"\n".join(words)
    return len(lines).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(lines, asbytes=True)


def unsqueezed_words(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


def _low(x, size: int):
    """The last bytes, of numbers or a column."""
    mask = (1 << 8 * size) - 1
    return x.bitwiseAND(mask) if isinstance(x, Column) else x & mask


def branch_first(grams: np.ndarray, order: int) -> np.ndarray:
    """N-grams with their branch, the `SHORT` bytes before the last one, moved to the front."""
    short = min(order, SHORT)
    return _low(grams >> 8, short) << 8 * (order - short + 1) | grams >> 8 * (short + 1) << 8 | _low(grams, 1)


def branch_back(keys: np.ndarray, order: int) -> np.ndarray:
    """The n-grams that `branch_first` made."""
    short = min(order, SHORT)
    far = order - short
    return _low(keys >> 8, far) << 8 * (short + 1) | keys >> 8 * (far + 1) << 8 | _low(keys, 1)


def _mixed(branch):
    """A branch's place from 0 to 2**32, for numbers or a column."""
    return _low(branch * 0x2545F491, 4)


def runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Slices of alike values of some columns: these values and the slice."""
    columns = [_numpy(batch.column(x)) for x in names]
    edges = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        if j > i:
            yield *(int(x[i]) for x in columns), batch.slice(i, j - i)


def ranged(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range of `place` and the indices of its rows, in their order."""
    at, sizes = np.argsort(place, kind="stable"), np.bincount(place)
    to = np.cumsum(sizes)
    for r in np.flatnonzero(sizes).tolist():
        yield r, at[to[r] - sizes[r] : to[r]]


def asked(docs: DataFrame, size: int, order: int = ORDER) -> DataFrame:
    """The documents dealt to blocks (null text: empty), and what each block asks for; `size` is the texts' bytes.

    A block has rows of packed documents (`texts`: ids, whether held out, small-letter
    texts), a row for each range of words or branches that it has words or n-grams of
    (`range`, packed `words` or `keys`, and `counts`), and a row for each distinct end of
    an n-gram that the tables of lower levels have (`gram`).  `n` and `counts` count the
    training texts, words or n-grams.
    """
    short, ranges = min(order, SHORT), size // RANGE + 1
    # the larger a block, the fewer n-grams it has for its length
    rows = docs.coalesce(size // BLOCK + 1).select(F.spark_partition_id().cast("long").alias("part"), "doc_id", held_out(F.col("doc_id")).alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    types = {"block": pa.int64(), "texts": pa.binary(), "gram": pa.int64(), "n": pa.int64(), "range": pa.int64(), "words": pa.binary(), "keys": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Table] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        raw: dict[int, list[np.ndarray]] = {0: [], 1: []}
        block, size = None, 0

        def count(least: int) -> None:
            for counted, found in raw.items():
                if found and sum(map(len, found)) >= least:
                    keys, counts = np.unique(np.concatenate(found), return_counts=True)
                    found.clear()
                    grams.append((keys, counts * counted))
            if len(grams) > 2 and sum(len(x) for x, _ in grams[1:]) > max(RAW, len(grams[0][0])):
                grams[:] = [_summed(grams)]

        def out(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            full = {"block": pa.repeat(pa.scalar(block, pa.int64()), n)} | columns
            return pa.RecordBatch.from_arrays([full.get(c, pa.nulls(n, t)) for c, t in types.items()], [*types])

        def asking(r: int, counts: np.ndarray, **columns: bytes) -> pa.RecordBatch:
            return out(range=pa.array([r]), counts=pa.array([squeezed(counts)], pa.binary()), **{c: pa.array([x], pa.binary()) for c, x in columns.items()})

        def close() -> Iterator[pa.RecordBatch]:
            if words:
                total = _counted(words).sort_by("word")
                words.clear()
                names, n = total["word"].combine_chunks().cast(pa.large_binary()).to_pylist(), total["n"].to_numpy()
                del total
                for r, own in ranged(np.fromiter(map(zlib.crc32, names), np.int64, len(names)) * ranges >> 32):
                    yield asking(r, n[own], words=squeezed_words([names[i] for i in own.tolist()]))
                del names, n
            count(0)
            keys, counts = _summed(grams)
            grams.clear()
            branch = keys >> 8 * (order - short + 1)
            ends = branch << 8 | _low(keys, 1)
            names = np.unique(ends)
            n = np.bincount(np.searchsorted(names, ends), counts, len(names)).astype(np.int64)
            del ends
            for i in range(0, len(names), 100_000):
                yield out(gram=pa.array(names[i : i + 100_000]), n=pa.array(n[i : i + 100_000]))
            place = (_mixed(branch) * ranges >> 32).astype(np.int32)
            del branch
            for r, own in ranged(place):
                yield asking(r, counts[own], keys=squeezed(np.diff(keys[own], prepend=0)))
            del keys, counts, place
            give_back()

        for batch in slices(batches, "text"):
            if block is None:
                block = batch.column("part")[0].as_py() << 32
            held, whole = batch.column("held"), pc.ascii_lower(strings(batch.column("text")))
            sink = pa.BufferOutputStream()
            packed = pa.RecordBatch.from_arrays([batch.column("doc_id"), held, whole], ["doc_id", "held", "text"])
            with pa.ipc.new_stream(sink, packed.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as stream:
                stream.write_batch(packed)
            yield out(texts=pa.array([sink.getvalue().to_pybytes()], pa.binary()), n=pa.array([pc.sum(pc.invert(held)).as_py()], pa.int64()))
            for some, counted in ((pc.invert(held), 1), (held, 0)):
                texts = pa.concat_arrays([whole.filter(some)])
                if not len(texts):
                    continue
                for found, _ in windows(texts, order):
                    raw[counted].append(branch_first(found, order))
                    count(RAW)
                _, codes, names = split_words(texts)
                words.append(pa.table({"word": names, "n": pa.array(np.bincount(codes, minlength=len(names)) * counted, pa.int64())}).filter(pc.field("word") != ""))
            if sum(map(len, words[1:])) > max(RAW // 4, len(words[0])):
                words[:] = [_counted(words)]
            size += batch.column("text").nbytes
            if size >= BLOCK:
                yield from close()
                block, size = block + 1, 0
        if block is not None:
            yield from close()

    return mapped(rows, run, "block long, texts binary, gram long, n long, range long, words binary, keys binary, counts binary")


def _seen(c: Column, total: Column) -> Column:
    return F.log10(F.try_divide(2 * c - 1, 2 * total))


def _escape(different: Column, total: Column) -> Column:
    return F.log10(F.try_divide(different, 2 * total))


def lower_levels(grams: DataFrame, order: int) -> DataFrame:
    """`gram, c, t, q, logp, escaped` for n-grams of `order` + 1 bytes from their counts `n`.

    `t` and `q` are the context's symbols and different symbols, `logp` is the last byte's
    log10 probability in the context, `escaped` that after escaping from the context.
    Level k has the n-grams' last k + 1 bytes.  A context has at most 256 symbols and a
    suffix at most 256 bytes before it, so no group of a window or join exceeds that.
    """
    below, levels = None, [grams]
    for k in range(order, 0, -1):
        levels.append(levels[-1].groupBy(_low(F.col("gram"), k).alias("gram")).agg(F.sum("n").alias("n")))
    for k, short in enumerate(reversed(levels)):
        level = short.select("gram", F.col("n").cast("double").alias("c"), F.shiftright("gram", 8).alias("context"))
        own = Window.partitionBy("context")
        level_sums = [F.sum("c").over(own).alias("t"), F.sum(F.when(F.col("c") > 0, 1.0).otherwise(0.0)).over(own).alias("q")]
        if below is None:
            level = level.select("*", *level_sums).withColumn("escaped", -F.log10(F.greatest(SYMBOLS - F.col("q"), F.lit(1.0)))).withColumn("lower", F.col("escaped"))
        else:
            under = below.select(F.col("gram").alias("suffix"), F.col("c").alias("c1"), F.col("t").alias("t1"), F.col("q").alias("q1"), F.col("logp").alias("lower"), F.col("escaped").alias("escaped1"))
            level = level.withColumn("suffix", _low(F.col("gram"), k)).join(under, "suffix")
            level = level.select("*", *level_sums, F.sum(F.when(F.col("c") > 0, F.col("c1")).otherwise(0.0)).over(own).alias("excluded"))
            rest, left = F.col("t1") - F.col("excluded"), F.col("q1") - F.col("q")  # what escaping from this context leaves in the shorter one
            further = F.when(left > 0, _escape(left, rest)).otherwise(0.0) + F.col("escaped1")
            level = level.withColumn("escaped", F.when(F.col("c1") > 0, _seen(F.col("c1"), rest)).otherwise(further))
        known = F.when(F.col("c") > 0, _seen(F.col("c"), F.col("t"))).otherwise(_escape(F.col("q"), F.col("t")) + F.col("escaped"))
        below = level.select("gram", "c", "t", "q", F.when(F.col("t") == 0, F.col("lower")).otherwise(known).alias("logp"), "escaped")
    return below


def _next_level(grams: np.ndarray, c: np.ndarray, under: tuple[np.ndarray, ...], suffix: np.ndarray) -> tuple[np.ndarray, ...]:
    """(c, t, q, logp, escaped) of sorted n-grams whose suffixes are the rows `suffix` of `under`."""
    _, context = np.unique(grams >> 8, return_inverse=True)
    c1, t1, q1, lower, escaped1 = (x[suffix] for x in under)
    t, q, excluded = (np.bincount(context, x)[context] for x in (c, c > 0, np.where(c > 0, c1, 0)))
    rest, left = t1 - excluded, q1 - q
    with np.errstate(divide="ignore", invalid="ignore"):
        further = np.where(left > 0, np.log10(left / (2 * rest)), 0) + escaped1
        escaped = np.where(c1 > 0, np.log10((2 * c1 - 1) / (2 * rest)), further)
        known = np.where(c > 0, np.log10((2 * c - 1) / (2 * t)), np.log10(q / (2 * t)) + escaped)
    return c, t, q, np.where(t == 0, lower, known), escaped


def trie(asks: DataFrame, ends: DataFrame, ranges: int, order: int = ORDER) -> DataFrame:
    """`block, keys, seen, totals, escapes`: for each row of `asks`, what gives the probability of the last byte of each n-gram after the others.

    `asks` has packed n-grams (`block`, `range`, `keys`, `counts`; counts may be 0) as
    `asked` makes them, `ends` the counts `n` of all distinct `gram`, their last bytes.
    The answer has how often each n-gram was seen, the total of each context, and log10 of
    the probability of those never seen; `probabilities` reads it.  Levels of up to `SHORT` bytes of context are tables;
    longer contexts are branches below those, and a range of branches is solved in arrays
    by one task.  There are as many more ranges as there is more text, and a branch of the
    default order has at most 2**24 n-grams, however large the corpus is; what blocks ask
    of a range stays compressed, and is read one block at a time.
    """
    short = min(order, SHORT)
    level = ["c", "t", "q", "logp", "escaped"]
    none = {"gram": "long"} | dict.fromkeys(level, "double") | {"block": "long", "keys": "binary", "counts": "binary"}

    def shaped(df: DataFrame, where: Column, what: int) -> DataFrame:
        return df.select(where.alias("range"), F.lit(what).alias("what"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    place = F.shiftright(_mixed(F.shiftright("gram", 8)) * F.lit(ranges).cast("long"), 32)
    rows = shaped(lower_levels(ends, short), place, 0).unionAll(shaped(asks, F.col("range"), 1))

    def solved(heads: list[pa.RecordBatch], asks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for keys, counts in ((x, n) for batch in asks for x, n in zip(batch.column("keys"), batch.column("counts"), strict=True)):
            parts.append((np.cumsum(unsqueezed(keys.as_py())), unsqueezed(counts.as_py())))
            if len(parts) > 2 and sum(len(x) for x, _ in parts[1:]) > max(RAW, len(parts[0][0])):
                parts[:] = [_summed(parts)]
        grams, counts = _summed(parts)
        parts.clear()
        grams = branch_back(grams, order)
        table = pa.Table.from_batches(heads)
        names = table["gram"].to_numpy()
        at = np.argsort(names)
        names, values = names[at], tuple(table[v].to_numpy()[at] for v in level)
        for k in range(short + 1, order + 1):
            longer, at = np.unique(_low(grams, k + 1), return_inverse=True)
            values = _next_level(longer, np.bincount(at, counts), values, np.searchsorted(names, _low(longer, k)))
            names = longer
        c, t, _, logp, _ = values
        del grams, counts, values
        for batch in asks:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                keys = np.cumsum(unsqueezed(packed))
                at = np.searchsorted(names, branch_back(keys, order))
                seen = c[at].astype(np.int64)
                answer = squeezed(seen), squeezed(t[at[_first(keys)]].astype(np.int64)), squeezed(logp[at[seen == 0]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (packed, *answer))], ["block", *ANSWER])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {0: [], 1: []}
        now = None
        for batch in batches:
            for where, what, part in runs(batch, "range", "what"):
                if where != now:
                    if held[1]:
                        yield from solved(held[0], held[1])
                    now = where
                    held[0].clear(), held[1].clear()
                held[what].append(part)
        if held[1]:
            yield from solved(held[0], held[1])
        held[0].clear(), held[1].clear()
        give_back()

    return mapped(rows.repartition("range").sortWithinPartitions("range", "what"), run, "block long, " + ", ".join(f"{c} binary" for c in ANSWER))


def _first(keys: np.ndarray) -> np.ndarray:
    """Where a context begins among sorted n-grams."""
    return np.append(True, keys[1:] >> 8 != keys[:-1] >> 8)


def probabilities(keys: bytes, seen: bytes, totals: bytes, escapes: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and the log10 probabilities of their last bytes, of a row of `trie`."""
    grams, c = np.cumsum(unsqueezed(keys)), unsqueezed(seen)
    t = unsqueezed(totals)[np.cumsum(_first(grams)) - 1]
    logp = np.empty(len(grams))
    logp[c == 0] = unsqueezed(escapes).view(np.float64)
    logp[c > 0] = np.log10((2 * c[c > 0] - 1) / (2 * t[c > 0]))
    return branch_back(grams, order), logp


def words_counted(asks: DataFrame) -> DataFrame:
    """`block, words, counts` of each row of `asks`, with counts in all blocks, and a row of `n, v` for each range.

    `n` sums the counts of the range's different words, `v` is how many have any.
    """

    def counted(asks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for batch in asks for x in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True)]
        lists = [unsqueezed_words(words) for _, words, _ in rows]
        coded = pa.array(itertools.chain.from_iterable(lists), pa.large_binary()).dictionary_encode()
        codes = _numpy(coded.indices)
        c = np.bincount(codes, np.concatenate([unsqueezed(n) for _, _, n in rows])).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])[:-1]
        answers = [squeezed(c[own]) for own in np.split(codes, ends)]
        one = [None]
        columns = [pa.array([b for b, _, _ in rows] + one, pa.int64()), pa.array([w for _, w, _ in rows] + one, pa.binary()), pa.array(answers + one, pa.binary())]
        sums = [pa.array([None] * len(rows) + [int(x)], pa.int64()) for x in (c.sum(), np.count_nonzero(c))]
        yield pa.RecordBatch.from_arrays([*columns, *sums], ["block", "words", "counts", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            for where, part in runs(batch, "range"):
                if where != now and held:
                    yield from counted(held)
                    held.clear()
                now = where
                held.append(part)
        if held:
            yield from counted(held)
        held.clear()
        give_back()

    return mapped(asks.repartition("range").sortWithinPartitions("range"), run, "block long, words binary, counts binary, n long, v long")


class Answers:
    """Values by n-gram, `USUAL` for those without one: sorted by a hash, with a table of where its leading bits begin."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        bits = max(len(grams).bit_length(), 8)
        self.shift = np.uint64(64 - bits)
        slots = self._slots(grams)
        order = np.argsort(slots)
        sizes = np.bincount(slots, minlength=1 << bits)
        self.longest = int(sizes.max())
        self.first = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.grams, self.values = np.append(grams[order], -1), np.append(values[order], USUAL)

    def _slots(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.first[self._slots(grams)]
        off = np.flatnonzero(self.grams[at] != grams)
        for _ in range(self.longest - 1):
            if not len(off):
                break
            at[off] = np.minimum(at[off] + 1, len(self.grams) - 1)
            off = off[self.grams[at[off]] != grams[off]]
        at[off] = len(self.grams) - 1
        return self.values[at]


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`.

    `score` is the log10 probability of the whole text under the trie; `base_score` that
    of its tokens under the smoothed unigram model.  Null and empty texts are one end
    mark.  Rows that repeat count each time and get a row each; without training texts
    all symbols are alike and each token has probability one; an empty table gives no
    rows.  Other columns of `docs` are left alone.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = stored(asked(docs, size, order))
    texts = rows.filter("texts is not null").select("block", "texts", "n")
    words = words_counted(rows.filter("words is not null").select("block", "range", "words", "counts"))
    ends = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("ends"))
    seen = words.filter("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    totals = ends.crossJoin(seen).select("ends", (F.col("n") + F.col("ends")).alias("total"), (F.col("v") + F.when(F.col("ends") > 0, 1).otherwise(0)).alias("distinct"))
    asks = rows.filter("keys is not null").select("block", "range", "keys", "counts")
    answers = trie(asks, stored(rows.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))), size // RANGE + 1, order)
    empty = dict.fromkeys(["words", "counts", *ANSWER, "texts"], "binary")

    def shaped(df: DataFrame, what: str) -> DataFrame:
        return df.select("block", F.lit(WHAT[what]).alias("what"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))

    parts = shaped(words.filter("block is not null"), "word").unionAll(shaped(answers, "gram")).unionAll(shaped(texts, "texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        block, names, counts, answer = None, None, None, None

        def words_answered(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
            words, values = [pa.array([], pa.large_binary())], [np.zeros(0)]
            for batch in parts:
                for some, n in zip(*batch.columns, strict=True):
                    value = unsqueezed(n.as_py()).astype(np.float64)
                    keep = value != USUAL_COUNT
                    words.append(pa.array(unsqueezed_words(some.as_py()), pa.large_binary()).filter(pa.array(keep)))
                    values.append(value[keep])
            return pa.concat_arrays(words), np.concatenate(values)

        def answered(parts: list[pa.RecordBatch]) -> Answers:
            grams, values = [np.zeros(0, np.int64)], [np.zeros(0)]
            for batch in parts:
                for row in zip(*batch.columns, strict=True):
                    found, value = probabilities(*(x.as_py() for x in row), order)
                    keep = value != USUAL
                    grams.append(found[keep])
                    values.append(value[keep])
            return Answers(np.concatenate(grams), np.concatenate(values))

        def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = strings(batch.column("text"))
            logp = np.zeros(len(text))
            for found, owner in windows(text, order):
                logp += np.bincount(owner, answer(found), len(text))
            per_text, codes, distinct = split_words(text)
            at = _numpy(pc.fill_null(pc.index_in(distinct.cast(pa.large_binary()), value_set=names), -1)).astype(np.int64)
            c = np.append(counts, USUAL_COUNT)[at]
            real = _numpy(pc.not_equal(distinct, ""))
            owner = np.repeat(np.arange(len(text)), per_text)

            def total(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner, np.where(real, values, 0)[codes], len(text))

            values = [batch.column("doc_id"), batch.column("held"), total(np.ones(len(at))).astype(np.int64), total(c > 0).astype(np.int64), total(np.log10(c + PRIOR)), logp]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], ["doc_id", "held_out", "words", "known", "base", "score"])

        for batch in batches:
            for b, what, part in runs(batch, "block", "what"):
                if b != block:
                    block, answer = b, None
                    held[0].clear(), held[1].clear()
                if what < WHAT["texts"]:
                    held[what].append(part.select(["words", "counts"] if what == WHAT["word"] else ANSWER))
                    continue
                if answer is None:
                    names, counts = words_answered(held[0])
                    answer = answered(held[1])
                    held[0].clear(), held[1].clear()
                    give_back()
                for packed in part.column("texts"):
                    yield from map(scored, pa.ipc.open_stream(packed.as_buffer()))
        names, counts, answer = None, None, None
        give_back()

    dealt = parts.repartition("block").sortWithinPartitions("block", "what")
    found = mapped(dealt, run, f"doc_id {kind}, held_out boolean, words long, known long, base double, score double")
    base = F.col("base") + F.log10(F.col("ends") + PRIOR) - (F.col("words") + 1) * F.log10(F.col("total") + PRIOR * (F.col("distinct") + 1))
    return found.crossJoin(F.broadcast(totals)).select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + F.when(F.col("ends") > 0, 1).otherwise(0)).alias("n_known"),
        F.col("total").cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )
