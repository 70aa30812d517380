"""Quality classifier by co-training of two views of a document.

One view is the text's content (shares of character classes, repetition, line and
word shapes), the other the page's metadata (source, language, length).  Each view
has a logistic regression, fitted on the labelled rows.  In each round both views
judge every other document on Spark; those that one is confident of count, with its
label, in the other's sums of gradients and Hessians, and each view takes a Newton
step over labelled and handed documents.  Both are calibrated on labelled rows kept
aside (Platt) and combined as independent evidence; all documents are scored in one
pass without a shuffle.

The fit sees at most `LABELLED` labelled rows, the ones with the least hashes of
their ids; nothing else is sampled.  Features are written once, a round reads them
and gives sums of fixed size, and the model is of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, mapped, slices, split_words, strings

LABELLED = 8000
ROUNDS = 4
#: How sure a view must be of a document to hand it over, what one counts beside a labelled row at most, and all of them beside all labelled rows.
SURE = 0.97
ONE_HANDED = 0.5
ALL_HANDED = 0.5
#: A weight moves by this much in a round at most; parts in which the sums of all tasks are added up.
STEP = 2.0
SLOTS = 4
KEEP = 0.5
HASHED_SOURCES, HASHED_LANGS = 32, 8

#: Character classes that the content view counts, by bytes.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"|", b"#%&$*@", b"'\"()-", b"<>{}[]/\\=+^~`_"]
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES):
    CLASS_OF[list(_chars)] = _k
CLASS_OF[0x80:0xC0] = len(CLASSES) + 1  # continuation bytes
KINDS = len(CLASSES) + 2
#: Text handled at once; counting needs some fifty bytes for each of its bytes.
SLICE = 1 << 19
#: Rows of features that are summed at once.
ROWS = 4096


def content(texts: pa.Array) -> np.ndarray:
    """Features of the content view, one row per text."""
    texts = strings(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(n), lengths)
    counts = np.bincount(owner * KINDS + CLASS_OF[raw], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    chars = np.maximum(lengths - counts[:, -1], 1)
    shares = counts[:, :-1] / chars[:, None]
    per_text, codes, _ = split_words(texts)
    words = np.maximum(per_text, 1)
    at = np.repeat(np.arange(n), per_text)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (at[1:] == at[:-1])
    distinct = np.bincount(np.unique(at * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1), minlength=n)
    lines = counts[:, 4] + 1
    shape = np.column_stack([
        np.bincount(at[same], minlength=n) / words, distinct / words, chars / words / 10, np.log1p(words) / 10, np.log1p(lines) / 10,
        np.minimum(words / lines, 200) / 200, counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1), (lengths == 0).astype(float),
    ])
    return np.column_stack([np.sqrt(shares), shape, np.sqrt(shape[:, 0]), (shares[:, 7:9] > 0.01), shape[:, 0] > 0.05, shape[:, 6] > 0.2]).astype(float)


def _hashed(values: list, buckets: int, salt: int) -> np.ndarray:
    import zlib

    out = np.zeros((len(values), buckets))
    for i, v in enumerate(values):
        out[i, zlib.crc32(f"{salt}:{v}".encode()) % buckets] = 1
    return out


def metadata(sources: pa.Array, langs: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Features of the metadata view; null is a value of its own, a null length is 0."""
    size = np.maximum(pc.fill_null(n_chars, 0).to_numpy(zero_copy_only=False).astype(float), 0)
    log = np.log1p(size)[:, None] / 10
    return np.column_stack([_hashed(sources.to_pylist(), HASHED_SOURCES, 1), _hashed(langs.to_pylist(), HASHED_LANGS, 2), log, log * log, size[:, None] < 40])


@dataclass
class View:
    """A calibrated logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return np.clip(self.slope * z + self.shift, -30, 30)


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25, offset: np.ndarray | float = 0.0, first: float = 1e-6) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = first
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta + offset, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * beta), -STEP, STEP)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    return View(mean, scale, _newton((x - mean) / scale, y, weight, ridge))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling, drawn towards slope 1 and shift 0 where rows are few; a slope that isn't positive leaves the prior alone."""
    if len(np.unique(y)) < 2:
        return
    z = view.logits(x)
    shift, more = _newton(z[:, None], y, np.ones(len(y)), 10.0, offset=z, first=1.0)
    view.slope, view.shift = (1 + more, shift) if more > -1 else (0.0, float(np.log(y.mean() / (1 - y.mean()))))


@dataclass
class Model:
    content: View
    metadata: View
    prior: float

    def probabilities(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by content, by metadata, and by both: the views' evidence adds up over the prior."""
        za, zb = self.content.logits(a), self.metadata.logits(b)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (za, zb, za + zb - self.prior))


@dataclass
class Handed:
    """What documents handed to a view with one label add up to at its present weights: their number, gradient and Hessian."""

    number: float
    gradient: np.ndarray
    hessian: np.ndarray


def handed(views: tuple[View, View], a: np.ndarray, b: np.ndarray) -> list[list[Handed]]:
    """For each view and label (0, 1), the sums over the rows that the other view is sure of."""
    xs = [(x - v.mean) / v.scale for x, v in zip((a, b), views, strict=True)]
    ps = [1 / (1 + np.exp(-v.logits(x))) for x, v in zip((a, b), views, strict=True)]
    out = []
    for k in (0, 1):
        x = np.column_stack([np.ones(len(a)), xs[k]])
        p = 1 / (1 + np.exp(-np.clip(x @ views[k].weights, -30, 30)))
        sums = []
        for label, sure in ((0.0, ps[1 - k] <= 1 - SURE), (1.0, ps[1 - k] >= SURE)):
            z, q = x[sure], p[sure]
            sums.append(Handed(float(sure.sum()), z.T @ (label - q), (z * (q * (1 - q))[:, None]).T @ z))
        out.append(sums)
    return out


def _stepped(view: View, x: np.ndarray, y: np.ndarray, sums: list[Handed], rate: float, ridge: float = 1.0) -> View:
    """The view after one Newton step over labelled rows and handed ones; of handed rows the labels count as the labelled rows have them, so without one of either label none counts."""
    x = np.column_stack([np.ones(len(x)), (x - view.mean) / view.scale])
    beta = view.weights
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    penalty = np.full(len(beta), ridge)
    penalty[0] = 1e-6
    gradient, hessian = x.T @ (y - p) - penalty * beta, (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
    shares = (1 - rate, rate)
    total = min(ALL_HANDED * len(y), *(ONE_HANDED * part.number / share for part, share in zip(sums, shares, strict=True)))
    for part, share in zip(sums, shares, strict=True):
        if total:
            weight = total * share / part.number
            gradient, hessian = gradient + weight * part.gradient, hessian + weight * part.hessian
    return View(view.mean, view.scale, beta + np.clip(np.linalg.solve(hessian, gradient), -STEP, STEP))


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, gather: Callable[[tuple[View, View]], list[list[Handed]]] | None, rounds: int = ROUNDS) -> Model:
    """Model from labelled rows (both views, y in 0/1) and `gather`, which gives what all other rows hand over; every fifth labelled row calibrates."""
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    prior = float(np.log(rate / (1 - rate)))
    if len(np.unique(y[~aside])) < 2:  # nothing to tell apart: the prior for all
        flat = [View(np.zeros(v.shape[1]), np.ones(v.shape[1]), np.r_[prior, np.zeros(v.shape[1])]) for v in views]
        return Model(*flat, prior)
    fitted = [fit_view(v[~aside], y[~aside], np.ones(int((~aside).sum()))) for v in views]
    for turn in range(rounds + 1):
        for k in (0, 1):
            calibrate(fitted[k], views[k][aside], y[aside])
        if turn == rounds or gather is None:
            break
        sums = gather(tuple(fitted))
        fitted = [_stepped(fitted[k], views[k][~aside], y[~aside], sums[k], rate) for k in (0, 1)]
    return Model(fitted[0], fitted[1], prior)


def _prepared(docs: DataFrame) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    columns = [("source", "string"), ("lang", "string"), ("n_chars", "long")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns])


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    def column(name: str, kind: pa.DataType) -> pa.Array:
        return batch.column(name).cast(kind) if name in batch.schema.names else pa.nulls(batch.num_rows, kind)

    return content(column("text", pa.string())), metadata(column("source", pa.string()), column("lang", pa.string()), column("n_chars", pa.int64()))


def _tabled(docs: DataFrame) -> DataFrame:
    """`doc_id, tie, a, source, lang, n_chars`: the content view's features, and what the metadata view's follow from, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            a = content(batch.column("text")).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), lists, *(batch.column(c) for c in ("source", "lang", "n_chars"))], ["doc_id", "tie", "a", "source", "lang", "n_chars"])

    return mapped(_prepared(docs).withColumn("tie", F.xxhash64("text")), run, "doc_id long, tie long, a array<float>, source string, lang string, n_chars long")


def _both(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    a = batch.column("a").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    return a, metadata(batch.column("source"), batch.column("lang"), batch.column("n_chars"))


def _gathered(pool: DataFrame, views: tuple[View, View]) -> list[list[Handed]]:
    """What all rows of a feature table hand over: every task gives its sums, which are added up in a few parts."""
    sizes = [len(v.weights) for v in views]
    total = sum(2 * (1 + n + n * n) for n in sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                out += np.concatenate([np.r_[h.number, h.gradient, h.hessian.ravel()] for sums in handed(views, *_both(part)) for h in sums])
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total)
        for batch in batches:
            out += batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, total).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["sums"])

    # of fixed size: SLOTS rows, whatever the input's size
    parts = mapped(mapped(pool, run, "sums array<double>").repartition(SLOTS), add, "sums array<double>").collect()
    flat, made, at = np.sum([r.sums for r in parts], axis=0), [], 0
    for n in sizes:
        made.append([])
        for _ in (0, 1):
            number, gradient, hessian = np.split(flat[at : at + 1 + n + n * n], [1, 1 + n])
            made[-1].append(Handed(float(number[0]), gradient, hessian.reshape(n, n)))
            at += 1 + n + n * n
    return made


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on a bounded sample of labelled rows and all other rows of `docs`.

    `labels` has doc_id and quality 0/1; of several labels of an id the majority counts,
    null ones don't.  Of rows that repeat a labelled id the text with the least hash is
    the labelled one; other rows, with null ids too, are unlabelled.
    """
    table = checkpointed(_tabled(docs))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    # at most `labelled` ids, so they may go to every task
    some = F.broadcast(checkpointed(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)))
    mine = table.join(some, "doc_id").groupBy("doc_id").agg(F.min(F.struct("tie", "a", "source", "lang", "n_chars", "y")).alias("x")).select("doc_id", "x.*")
    got = mine.toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return cotrain(tuple(np.zeros((0, x.shape[1])) for x in _features(pa.RecordBatch.from_pydict({"text": pa.array([""])}))), np.zeros(0), None)
    pool = table.join(some.select("doc_id"), "doc_id", "left_anti")
    return cotrain(_both(got.to_batches()[0]), got.column("y").to_numpy().astype(float), lambda views: _gathered(pool, views), rounds)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """`doc_id, p_content, p_metadata, score, keep` for every row.

    Null texts are empty, null metadata are values of their own, missing metadata
    columns are null; repeated rows come out each; other columns are ignored; an
    empty table gives no rows; without usable labels all have the prior.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            p = model.probabilities(*_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p), pa.array(p[2] >= keep)], ["doc_id", "p_content", "p_metadata", "score", "keep"])

    return mapped(_prepared(docs), run, "doc_id long, p_content double, p_metadata double, score double, keep boolean")


def good(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of `docs` that the model keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield batch.filter(pa.array(model.probabilities(*_features(batch))[2] >= keep))

    return mapped(docs, run, docs.schema)
