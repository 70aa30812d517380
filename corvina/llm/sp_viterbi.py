"""SentencePiece encoding and decoding with a batched Viterbi in numpy.

Distinct words of equal length advance together.  At each position the hashes of
all substrings that end there are probed in the sorted hashes of the pieces, hits
are compared with the piece itself, and the maximum over the admissible hits
stores a backpointer for every word of the batch.

A unigram model admits every hit and adds up the pieces' scores.  A BPE model is no
additive one: there an arc is admissible only if its piece may follow the piece
before it, that is, if merging the two pieces' characters gives just these two
pieces.  A sequence whose neighbours all agree in this way is what BPE gives, so
at most one arc is admissible at each position and the maximum is over one value;
ids are then exactly the library's.  Which pairs agree is found once for each pair
and kept.

A word too long to have others of its length beside it is a batch of its own: all its
substrings are probed at once and only the maxima are taken one position at a time.

Models that normalise text beyond the dummy prefix and the white-space mark have the
library normalise it; models with user-defined pieces or pieces over several words
are refused.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import WordMemo, gather, mapped, ranges, slices, strings

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Longer words are batches of their own: few words share such a length.  The method is the same.
LONG = 256
#: Pairs whose agreement is kept at most; beyond it the store starts anew.
PAIRS = 2_000_000
#: Pairs gathered before they are sorted in, words whose ids are kept, bits of the filter before the search.
NEWEST = 20_000
WORDS = 500_000
FILTER_BITS = 20
#: Text handled at once: words repeat more in more text.
SLICE = 6 << 20

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A model's pieces, and encoding and decoding of many texts at once."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.bpe, spec = model.trainer_spec.model_type == BPE, model.normalizer_spec
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model's type or white space isn't supported")
        self.normalise = None
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            from sentencepiece import SentencePieceProcessor

            self.normalise = SentencePieceProcessor(model_file=path).Normalize
        self.kinds = np.array([p.type for p in model.pieces])
        self.prefix = spec.add_dummy_prefix
        self.names = [p.piece for p in model.pieces]
        if (self.kinds == USER).any() or self.bpe and (self.kinds == UNUSED).any() or any(SPACE in name.lstrip(SPACE) for name in self.names):
            raise ValueError("user-defined pieces, unused pieces of BPE models and pieces over several words aren't supported")
        self.size = len(self.names)
        self.unk = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.byte_ids = np.full(256, self.unk)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_ids[int(self.names[i][1:-1], 16)] = i
        self.byte_fallback = bool((self.kinds == BYTE).any())
        usable = np.flatnonzero(self.kinds == NORMAL)
        self.id_of = {self.names[i]: int(i) for i in usable}
        self.score = np.array([p.score for p in model.pieces], np.float32)  # sums are rounded as the library rounds them
        lengths = np.array([len(n) for n in self.names])
        self.longest = int(lengths[usable].max())
        self.chars = np.zeros((self.size, self.longest), np.uint32)
        for i in usable:
            self.chars[i, : lengths[i]] = [*map(ord, self.names[i])]
        self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.longest, BASE))])
        keys = np.array([self._hash(self.names[i]) for i in usable], np.uint64)
        order = keys.argsort(kind="stable")
        self.keys, self.key_ids = keys[order], usable[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << FILTER_BITS, bool)  # which hashes can be those of pieces, by their upper bits
        self.maybe[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.lengths = np.concatenate([lengths, [1]])  # the last: a character without a piece
        self.lowest = self.score[usable].min() - np.float32(10)
        self.apart = not any("\n" in n and len(n) > 1 for n in self.id_of)
        self.raw = [self._bytes(i) for i in range(self.size)]
        self.raw_lengths = np.array([len(x) for x in self.raw])
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.agree: dict[int, bool] = {}
        self.agree_one: dict[int, bool] = {}
        self.pair_keys, self.pair_values = np.zeros(0, np.int64), np.zeros(0, bool)  # the same, sorted, but for the newest
        self.memo = WordMemo(self.encode_words, WORDS)

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _bytes(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.names[i][1:-1], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.names[i].replace(SPACE, " ").encode()

    def merge(self, text: str) -> list[str]:
        """The parts that BPE merging leaves of a text: best score first, leftmost of equals."""
        parts, right = list(text), list(range(1, len(text) + 1))
        left = list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            i = self.id_of.get(parts[a] + parts[b])
            if i is not None:
                heapq.heappush(heap, (-self.score[i], a, b, parts[a] + parts[b]))

        for a in range(len(text) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not parts[a] or not parts[b] or parts[a] + parts[b] != joined or right[a] != b:
                continue
            parts[a], parts[b], right[a] = joined, "", right[b]
            if right[b] < len(parts):
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [p for p in parts if p]

    def _agrees(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether pieces may stand side by side; ids from `size` up are characters without a piece."""
        keys = first * np.int64(1 << 22) + second
        out = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[at] == keys
            out[known] = self.pair_values[at[known]]
            rest = np.flatnonzero(~known)
        else:
            rest = np.arange(len(keys))
        for i, k in zip(rest.tolist(), keys[rest].tolist(), strict=True):
            found = self.agree.get(k)
            if found is None:
                a, b = self._text(k >> 22), self._text(k & ((1 << 22) - 1))
                found = self.agree[k] = self.merge(a + b) == [a, b]
            out[i] = found
        if len(self.agree) >= NEWEST:
            if len(self.pair_keys) >= PAIRS:
                self.pair_keys, self.pair_values = self.pair_keys[:0], self.pair_values[:0]
            keys = np.concatenate([self.pair_keys, np.fromiter(self.agree, np.int64, len(self.agree))])
            values = np.concatenate([self.pair_values, np.fromiter(self.agree.values(), bool, len(self.agree))])
            order = keys.argsort(kind="stable")
            self.pair_keys, self.pair_values = keys[order], values[order]
            self.agree.clear()
        return out

    def _text(self, i: int) -> str:
        return self.names[i] if i < self.size else chr(i - self.size)

    def _advance(self, codes: np.ndarray) -> list[list[int]]:
        """Ids of words of one length: rows of code points."""
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        score = np.full((length + 1, n), -np.inf, np.float32)
        score[0] = 0
        last = np.full((length + 1, n), -1, np.int64)
        for j in range(1, length + 1):
            for size in range(min(self.longest, j), 0, -1):  # of equal sums the longer last piece counts
                i = j - size
                probe = prefix[j] - prefix[i] * self.powers[size]
                rows = np.flatnonzero(self.maybe[probe >> np.uint64(64 - FILTER_BITS)] & (last[i] >= 0 if i else True))
                if not len(rows) and size > 1:
                    continue
                at = np.minimum(np.searchsorted(self.keys, probe[rows]), len(self.keys) - 1)
                sure = self.keys[at] == probe[rows]
                rows, piece = rows[sure], self.key_ids[at[sure]]
                same = (self.lengths[piece] == size) & (self.chars[piece, :size] == codes[rows, i:j]).all(1)
                rows, piece = rows[same], piece[same]
                gain = self.score[piece]
                if size == 1:  # a character without a piece is an arc of its own
                    rest = np.ones(n, bool)
                    rest[rows] = False
                    rest = np.flatnonzero(rest & np.isfinite(score[i]))
                    rows = np.concatenate([rows, rest])
                    piece = np.concatenate([piece, codes[rest, i].astype(np.int64) + self.size])
                    gain = np.concatenate([gain, np.full(len(rest), self.lowest)])
                if i and self.bpe and len(rows):
                    fit = self._agrees(last[i, rows], piece)
                    rows, piece, gain = rows[fit], piece[fit], gain[fit]
                total = score[i, rows] + gain
                better = total > score[j, rows]
                rows, piece, total = rows[better], piece[better], total[better]
                score[j, rows], last[j, rows] = total, piece
        at, out = np.full(n, length), []
        found = np.isfinite(score[length])
        while (at > 0).any() and found.any():
            piece = np.where((at > 0) & found, last[at, np.arange(n)], -1)
            out.append(piece)
            at = at - np.where(piece >= 0, self.lengths[np.minimum(piece, self.size)], at)
        steps = np.array(out[::-1]).T.tolist() if out else [[]] * n
        return [[x for x in row if x >= 0] if ok else None for row, ok in zip(steps, found, strict=True)]

    def _arcs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, pieces) of all arcs of one word, by end, longer pieces first."""
        length = len(codes)
        prefix = np.zeros(length + 1, np.uint64)
        for j, c in enumerate(codes.tolist()):
            prefix[j + 1] = (int(prefix[j]) * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        ends, found = [], []
        for size in range(min(self.longest, length), 0, -1):
            probe = prefix[size:] - prefix[:-size] * self.powers[size]
            begins = np.flatnonzero(self.maybe[probe >> np.uint64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(self.keys, probe[begins]), len(self.keys) - 1)
            sure = self.keys[at] == probe[begins]
            begins, piece = begins[sure], self.key_ids[at[sure]]
            same = self.lengths[piece] == size
            for k in range(size):
                same &= self.chars[piece, k] == codes[begins + k]
            begins, piece = begins[same], piece[same]
            if size == 1:  # a character without a piece is an arc of its own
                rest = np.ones(length, bool)
                rest[begins] = False
                rest = np.flatnonzero(rest)
                begins, piece = np.concatenate([begins, rest]), np.concatenate([piece, codes[rest].astype(np.int64) + self.size])
            ends.append(begins + size)
            found.append(piece)
        ends, found = np.concatenate(ends), np.concatenate(found)
        order = ends.argsort(kind="stable")
        return ends[order], found[order]

    def _advance_one(self, codes: np.ndarray) -> list[int] | None:
        """Ids of one long word; None if no sequence of pieces agrees."""
        length = len(codes)
        score, last = [np.float32(-np.inf)] * (length + 1), [-1] * (length + 1)
        score[0] = np.float32(0)
        lengths, gains, known = self.lengths.tolist(), list(self.score), self.agree_one
        for j, piece in zip(*(x.tolist() for x in self._arcs(codes)), strict=True):
            i = j - (lengths[piece] if piece < self.size else 1)
            if i and last[i] < 0:
                continue
            if i and self.bpe:
                key = last[i] << 22 | piece
                fit = known.get(key)
                if fit is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    fit = known[key] = bool(self._agrees(np.array([last[i]]), np.array([piece]))[0])
                if not fit:
                    continue
            total = score[i] + (gains[piece] if piece < self.size else self.lowest)
            if total > score[j]:
                score[j], last[j] = total, piece
        out, j = [], length
        while j:
            if last[j] < 0:
                return None
            out.append(last[j])
            j -= lengths[last[j]] if last[j] < self.size else 1
        return out[::-1]

    def _out(self, pieces: list[int]) -> list[int]:
        if max(pieces, default=0) < self.size:
            return pieces
        ids: list[int] = []
        for p in pieces:
            if p < self.size:
                ids.append(p)
            elif self.byte_fallback:
                ids += self.byte_ids[list(chr(p - self.size).encode())].tolist()
            else:
                ids.append(self.unk)
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that hold the white-space mark instead of spaces."""
        out: list = [[]] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, members in by.items():
            if not length:
                continue
            codes = np.frombuffer("".join(words[i] for i in members).encode("utf-32-le"), np.uint32).reshape(len(members), length)
            found = map(self._advance_one, codes) if length > LONG else self._advance(codes)
            for i, pieces in zip(members, found, strict=True):
                if pieces is None:
                    raise ValueError(f"no pieces of this model agree on {words[i][:80]!r}")
                out[i] = self._out(pieces)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each counted)."""
        texts = strings(texts)
        if self.normalise:
            runs, texts = True, pa.array([self.normalise(t) for t in texts.to_pylist()], pa.large_string())
        else:
            some = pc.greater(pc.binary_length(texts), 0)
            # a space at the beginning makes a run with the prefix
            runs = any(pc.any(f(texts, x)).as_py() for f, x in ((pc.match_substring, "  "), (pc.match_substring, SPACE), (pc.starts_with, " ")))
            texts = pc.replace_substring(texts, " ", SPACE if runs else " " + SPACE)
            if self.prefix:
                texts = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
        if runs:
            texts = pc.replace_substring_regex(texts, f"({SPACE}+)", r" \1")
        if self.apart:  # no piece holds a line end and another character
            texts = pc.replace_substring(texts, "\n", " \n ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths, flat = self.memo(coded.dictionary.to_pylist())
        ids, counts = gather(counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths, flat)
        if self.byte_fallback or not (ids == self.unk).any():
            return ids, counts
        # a run of unknown characters of a text is one id
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != self.unk) | (ids[:-1] != self.unk) | (owner[1:] != owner[:-1])
        return ids[keep], np.bincount(owner[keep], minlength=len(counts))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 each give U+FFFD, ids out of range raise."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is out of range")
        raw = self.raw_flat[ranges(self.raw_starts[ids], self.raw_lengths[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.raw_lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        first = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            skip = self.prefix and first[k] < len(ids) and b > a and self.kinds[ids[first[k]]] == NORMAL and raw[a : a + 1] == b" "
            out.append(raw[a + skip : b].decode("utf-8", "each_byte"))
        return out


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """A worker's copy of a model."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """`doc_id, n_ids, ids, decoded` of every row of `doc_id, text`: the model's ids and their text again.

    A null text is empty and has no ids.  The decoded text is the text, with the
    white-space mark U+2581 as a space.  Rows are neither joined nor counted, so
    null or repeated doc_ids, ties and other columns don't matter; an empty table
    gives no rows.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in slices(batches, "text", SLICE):
            ids, counts = model.encode(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(model.decode(ids, counts), pa.string())],
                ["doc_id", "n_ids", "ids", "decoded"],
            )

    schema = "doc_id long, n_ids long, ids array<int>, decoded string"
    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, schema)


def decode(rows: DataFrame, model_path: str, keep: str = "doc_id") -> DataFrame:
    """`keep, text` of every row's `ids array<int>`; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pa.array(model.decode(lists.flatten().to_numpy(zero_copy_only=False), counts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(keep), pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)], [keep, "text"])

    return mapped(rows.select(keep, "ids"), run, f"{keep} {dict(rows.dtypes)[keep]}, text string")
