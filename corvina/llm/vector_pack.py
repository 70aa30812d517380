"""Packing of tokenised examples: vector bin packing with a dot-product heuristic.

Each example asks for a vector of resources: tokens, one segment, and tokens that
bear loss.  Open sequences have a remaining capacity in the same three units.  The
heuristic places the piece whose demand has the largest dot product with what is
left of the sequence (both as shares of the capacity).  Examples may be cut, so a
sequence that nothing fits any more takes the beginning of the longest waiting
piece, and what remains of that piece waits on.

Every task packs the rows of its own partition while they stream through it: no
shuffle, no group that could grow, and the memory of a window of waiting pieces.
What is left at the end of a partition is laid in sequences of power-of-two
lengths, which need no padding.  A task that is run again reads the same split
and gives the same sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import WordMemo, gather, mapped, slices, split_words, strings

MAX_TOKENS = 4096
MAX_SEGMENTS = 64
#: Pieces that wait for a place in a sequence.
WINDOW = 512
#: Words whose ids a worker keeps, and text that it handles at once: words repeat more in more text.
KEPT = 600_000
SLICE = 6 << 20
#: Letters before this one are letters to every version of the character tables.
SURE_LETTERS = "\u0590"
#: Tokens of a conversation that are one example at most; longer ones go on as further examples.
EXAMPLE = 1 << 16


@dataclass
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be 1 or more")


class Packer:
    """Places pieces (example, start, length, loss tokens) into sequences.

    `loss_of(example, start, length)` says how many tokens of a piece bear loss.
    """

    def __init__(self, limits: Limits, first_sequence: int = 0, window: int = WINDOW, loss_of=None):
        self.limits, self.next_sequence, self.window = limits, first_sequence, window
        self.loss_of = loss_of or (lambda example, start, length: length)
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: list[list[int]] = []  # example, start, length, loss tokens
        self.out: list[tuple[int, int, int, int, int]] = []  # example, start, length, sequence, offset

    def add(self, example: int, tokens: int) -> None:
        """Take in one example.  Whole sequences' worth of it are placed at once where loss allows."""
        start, most = 0, self.limits.tokens
        while tokens - start >= most and self.loss_of(example, start, most) <= self.limits.loss:
            self._place([(example, start, most)])
            start += most
        if tokens > start:
            self.waiting.append([example, start, tokens - start, self.loss_of(example, start, tokens - start)])
        while len(self.waiting) >= self.window:
            self._fill(self.limits.tokens, must_fill=False)

    def finish(self) -> None:
        """Lay the rest in full sequences, then in ever smaller powers of two."""
        while self.waiting:
            rest = sum(x[2] for x in self.waiting)
            target = self.limits.tokens if rest >= self.limits.tokens else 1 << (rest.bit_length() - 1)
            self._fill(target, must_fill=True)

    def _place(self, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for example, start, length in pieces:
            self.out.append((example, start, length, self.next_sequence, offset))
            offset += length
        self.next_sequence += 1

    def _head(self, piece: list[int], tokens: int, loss: int) -> int:
        """Longest beginning of a piece within both limits."""
        take = min(tokens, piece[2])
        if self.loss_of(piece[0], piece[1], take) <= loss:
            return take
        low, high = 0, take
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.loss_of(piece[0], piece[1], mid) <= loss else (low, mid - 1)
        return low

    def _fill(self, target: int, must_fill: bool) -> None:
        left = np.array([target, self.limits.segments, self.limits.loss], float)
        demand = np.array([[x[2], 1, x[3]] for x in self.waiting], float)
        free = np.ones(len(self.waiting), bool)
        chosen: list[tuple[int, int, int]] = []
        while left[0] > 0 and left[1] > 0:
            fits = free & (demand <= left).all(1)
            if fits.any():
                score = (demand / self.capacity) @ (left / self.capacity)
                i = int(np.where(fits, score, -1.0).argmax())
                piece, take = self.waiting[i], self.waiting[i][2]
            else:
                if not free.any() or left[2] <= 0 and (demand[free, 2] > 0).all():
                    break
                i = int(np.where(free, demand[:, 0], -1.0).argmax())
                piece = self.waiting[i]
                take = self._head(piece, int(left[0]), int(left[2]))
                if take <= 0:
                    break
            chosen.append((piece[0], piece[1], take))
            left -= [take, 1, self.loss_of(piece[0], piece[1], take)]
            if take == piece[2]:
                free[i] = False
            else:
                piece[1], piece[2] = piece[1] + take, piece[2] - take
                piece[3] = self.loss_of(piece[0], piece[1], piece[2])
                demand[i] = [piece[2], 1, piece[3]]
        self.waiting = [x for x, f in zip(self.waiting, free, strict=True) if f]
        # a sequence that a segment or loss limit closed early: cut to powers of two, which need no padding
        used = int(target - left[0])
        if used == self.limits.tokens or used & (used - 1) == 0:
            self._place(chosen)
        else:
            for part in _powers(chosen):
                self._place(part)


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a run of pieces into runs whose lengths are powers of two, largest first."""
    queue = [list(x) for x in pieces]
    rest = sum(x[2] for x in queue)
    while rest:
        room = 1 << (rest.bit_length() - 1)
        rest -= room
        part = []
        while room:
            example, start, length = queue[0]
            take = min(room, length)
            part.append((example, start, take))
            room -= take
            if take == length:
                queue.pop(0)
            else:
                queue[0] = [example, start + take, length - take]
        yield part


_memo: dict[str, WordMemo] = {}


def word_encoder(path: str) -> WordMemo:
    """Encoder of single words; kept for the life of a worker.

    The tokenizer never merges a letter with a mark after it, so a final stop or comma is encoded apart,
    after letters that stay letters in small letters (a dotted capital I ends in a mark there).
    """
    if path not in _memo:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        stems = WordMemo(lambda words: [x.ids for x in model.encode_batch_fast(words, add_special_tokens=False)], KEPT)

        def encode(words: list[str]) -> list[np.ndarray]:
            cut = [w[-1:] in (".", ",") and "\0" < w[-2:-1] < SURE_LETTERS and w[-2].isalpha() and len(w[-2].lower()) == 1 for w in words]
            parts = list(dict.fromkeys(w[:-1] if c else w for w, c in zip(words, cut, strict=True)))
            lengths, flat = stems([*parts, ".", ","])
            ids = dict(zip([*parts, ".", ","], np.split(flat, np.cumsum(lengths)[:-1]), strict=True))
            return [np.concatenate([ids[w[:-1]], ids[w[-1]]]) if c else ids[w] for w, c in zip(words, cut, strict=True)]

        _memo[path] = WordMemo(encode, KEPT)
    return _memo[path]


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each counted).

    The tokenizer drops white space, so words are encoded one by one, each distinct
    one once.  It also lower-cases all but its special tokens, written in lower case
    between <| and |>: in texts without these, words that differ in case are one.  It
    composes marks with letters before that, so capitals before marks stay as they are.
    """
    texts = strings(texts)
    kept = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, r"[A-Z]\pM"))
    texts = pc.if_else(kept, texts, pc.ascii_lower(texts)) if pc.any(kept).as_py() else pc.ascii_lower(texts)
    counts, codes, words = split_words(texts)
    lengths, flat = word_encoder(path)(words.to_pylist())
    return gather(counts, codes, lengths, flat)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TURN_SCHEMA = "conv_id long, turn long, start long, length long, ids_crc32 long, loss_tokens long, example_tokens long, sequence_id long, offset long"


class _Held:
    """Examples that wait for places, and the packer that places them: head columns, ids, tokens that bear loss before each id."""

    def __init__(self, limits: Limits, schema: str):
        self.examples: dict[int, list] = {}
        self.packer = Packer(limits, TaskContext.get().partitionId() << 33, loss_of=lambda e, start, length: int(self.examples[e][2][start + length] - self.examples[e][2][start]) if self.examples[e][2] is not None else length)
        self.names = [x.split()[0] for x in schema.split(", ")]
        self.made = 0

    def add(self, head: tuple, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        before = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        self.examples[self.made] = [head, ids.astype("<u4"), before, len(ids)]
        self.packer.add(self.made, len(ids))
        self.made += 1

    def placed(self) -> pa.RecordBatch:
        rows = []
        for example, start, length, sequence, offset in self.packer.out:
            head, ids, before, _ = held = self.examples[example]
            loss = () if before is None else (int(before[start + length] - before[start]),)
            rows.append((*head, start, length, zlib.crc32(ids[start : start + length].tobytes()), *loss, len(ids), sequence, offset))
            held[3] -= length
            if not held[3]:
                del self.examples[example]
        self.packer.out.clear()
        columns = zip(*rows, strict=True) if rows else [[]] * len(self.names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], self.names)

    def rest(self) -> pa.RecordBatch:
        self.packer.finish()
        return self.placed()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits | None = None) -> DataFrame:
    """Tokenise `doc_id, text` and pack all ids into sequences; one row per piece.

    A null text is empty, an empty text has the end id alone, a null doc_id stays
    null; repeated rows are packed once each; other columns are ignored; an empty
    table gives no rows.  All tokens bear loss.  `sequence_id` is the partition's
    number in the upper bits and a running number below.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(limits, SCHEMA)
        for batch in slices(batches, "text", SLICE):
            ids, counts = token_ids(batch.column("text"), tokenizer_path)
            ends = np.cumsum(counts)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends - counts, ends, strict=True):
                held.add((doc_id,), np.append(ids[a:b], end_id))
            yield held.placed()
        yield held.rest()

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, SCHEMA)


def pack_turns(turns: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Tokenise instruction data `conv_id, turn, role, text` and pack it under all three limits; one row per piece.

    The turns of a conversation are one example, in order, each with the end id after
    it; the ids of turns whose role is one of `loss_roles` bear loss.  Rows are dealt
    by ranges of (conv_id, turn) and stream through in that order, so a conversation is
    never gathered: what is longer than `EXAMPLE` tokens or lies on two ranges goes on
    as a further example.  `turn` is that of an example's first row; start and length
    count from there.  A null text is empty, null ids are a conversation of their own,
    null roles bear no loss; repeated rows are packed once each, equal turns by role and
    text; other columns are ignored; an empty table gives no rows.
    """
    limits = limits or Limits()
    rows = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    order = ["conv_id", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(limits, TURN_SCHEMA)
        head: tuple | None = None
        ids: list[np.ndarray] = []
        loss: list[np.ndarray] = []

        def close() -> None:
            if ids:
                held.add(head, np.concatenate(ids), np.concatenate(loss))
                ids.clear()
                loss.clear()

        for batch in slices(batches, "text", SLICE):
            found, counts = token_ids(batch.column("text"), tokenizer_path)
            ends = np.cumsum(counts)
            for conv, turn, role, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role")), ends - counts, ends, strict=True):
                if not ids or head[0] != conv or sum(map(len, ids)) >= EXAMPLE:
                    close()
                    head = (conv, turn)
                ids.append(np.append(found[a:b], end_id))
                loss.append(np.full(len(ids[-1]), role in loss_roles))
            yield held.placed()
        close()
        yield held.rest()

    return mapped(rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order), run, TURN_SCHEMA)
