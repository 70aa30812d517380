"""Texts that are alike: functions that differ only in numbers are read once, and what was found is told again for each.

A text is cut behind lines that are a closing brace alone.  A piece's key is the piece
without its decimal numbers, numbers at the end of names and line comments, and which of
the names' numbers are equal.  What reading a piece gives depends on no more than that,
but for names, offsets and the numbers themselves, which are put back.  A piece counts
only if it reads on its own as it reads within its text: brackets closed, nothing noted,
a function at its end.  Any other text is read whole, as if this module weren't there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from .c_syntax import Tree
from .c_tokens import IDENT

#: Numbers at the end of names, decimal numbers, line comments.
RUN = re.compile(r"((?<=_)[1-9][0-9]*(?!\w)|(?<![\w.])[1-9][0-9]*(?![\w.])|//[^\n\\]*)")
#: What makes a text be read whole: literals, directives, block comments, continued lines, numbers with exponents.
ODD = re.compile(r"""["'\\#@$\x00-\x08\x0b-\x1f\x7f]|/\*|::|\.\.\.[0-9]|[eEpP][+-][0-9]""")
#: Characters beyond ASCII.
BEYOND = re.compile(r"[^\x00-\x7f]")
#: Fields of results that are offsets, and those that are lines.
OFFSETS, LINES = {"lo", "hi", "declared_lo", "declared_hi", "begins", "ends"}, {"line", "first_line", "last_line"}
TOLD = OFFSETS | LINES
#: Digits that stand for a name's number in what is read; texts that hold them are read whole.
MARK, MARKED = "9070503", re.compile("9070503([0-9]{4})7")
#: Pieces that one worker keeps twice over, and the longest one.
KEPT, LONGEST = 6_000, 1 << 12
#: Keys of pieces met once that one worker remembers.
ONCE = 200_000


class Piece:
    """What is known of all pieces with one key: results with blanks for names and offsets."""

    __slots__ = ("lengths", "rows", "numbers", "told", "lines", "size")

    def __init__(self, lengths: list[int], rows: list, numbers: list[list[int]], told: object, size: int, lines: int):
        self.lengths, self.rows, self.numbers, self.told, self.size, self.lines = lengths, rows, numbers, told, size, lines


class Context:
    """What a piece's blanks are filled with."""

    __slots__ = ("shift", "names", "line")

    def __init__(self, shift: list[int], names: list[str], line: int):
        self.shift, self.names, self.line = shift, names, line


def blanks(value, key: str, places: list[int]) -> Callable[[Context], object] | None:
    """How a result is told again, or None if it is the same for every text; `places` are the ends of the runs."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        if key in OFFSETS:
            n = bisect_right(places, value)
            return lambda c: value + c.shift[n]
        return (lambda c: value + c.line) if key in LINES else None
    if isinstance(value, str):
        if MARK not in value:
            return None
        parts = MARKED.split(value)
        numbered = [int(p) if i % 2 else p for i, p in enumerate(parts)]
        if len(parts) == 3 and not parts[2]:
            return lambda c: numbered[0] + c.names[numbered[1]]
        return lambda c: "".join(c.names[p] if i % 2 else p for i, p in enumerate(numbered))
    if isinstance(value, dict):
        inner = {}
        for k, v in value.items():
            if v.__class__ is int and k not in TOLD or v.__class__ is str and MARK not in v or v.__class__ is bool or v is None:
                continue
            if f := blanks(v, k, places):
                inner[k] = f
        return (lambda c: value | {k: f(c) for k, f in inner.items()}) if inner else None
    if isinstance(value, (list, tuple)):
        inner = [(i, f) for i, v in enumerate(value) if (f := blanks(v, key, places))]
        if not inner:
            return None

        def told(c: Context) -> list:
            out = list(value)
            for i, f in inner:
                out[i] = f(c)
            return out

        return told
    return None


def moved(value, at: int, line: int, key: str = ""):
    """A result of a piece that begins at an offset and on a line of its text."""
    if isinstance(value, dict):
        return {k: v if v.__class__ is str or v.__class__ is int and k not in TOLD else moved(v, at, line, k) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [moved(v, at, line, key) for v in value]
    if value.__class__ is int and key in TOLD:
        return value + (at if key in OFFSETS else line)
    return value


class Reader:
    """Reads texts by their pieces: `make(tree)` gives a row for each function, from its syntax alone, and something to add for a piece.

    `numbers` says that results depend on no decimal number's value, at most on how many
    different ones a function has: `finish(row, n)` is told (less than 0 where they are to
    be left out), and may put into order what stands in the order of names.  `whole` texts are one piece.
    What is `given` beside a text goes to `make`, behind the tree.  `early` readers learn
    a piece when they meet it first: for results that are short to tell again.
    """

    def __init__(self, make: Callable[..., tuple[list[dict], object]], numbers: bool = False, finish: Callable[[dict, int], None] | None = None, whole: bool = False, kept: int = KEPT, early: bool = False):
        self.make, self.numbers, self.finish, self.whole = make, numbers, finish, whole
        self.kept, self.early = kept, early
        self.known: dict = {}
        self.former: dict = {}  # what was known before `known` was full; found again, it is known again
        self.once: set[int] = set()  # keys met once: most pieces never come again, and learning costs more than reading

    def read(self, text: str, given: tuple = ()) -> tuple[list[dict], list[Piece]] | None:
        """Rows of a text's functions and its pieces, or None if it must be read whole."""
        rows, pieces, at = self.begin(text, given)
        return (rows, pieces) if at == len(text) and pieces else None

    def begin(self, text: str, given: tuple = ()) -> tuple[list[dict], list[Piece], int]:
        """Rows and pieces of as much of a text as is made of pieces that count, and where that ends: what follows doesn't change how they read."""
        rows, pieces, at, line = [], [], 0, 0
        if len(text) > LONGEST * 64:
            return rows, pieces, at
        cut = [text] if self.whole else text.split("\n}\n")
        last = len(cut) - 1
        if not text.isascii() or ODD.search(text) or MARK in text:
            if self.whole:
                return rows, pieces, at
            odd = min([m.start() for m in (ODD.search(text), BEYOND.search(text)) if m] + [i for i in [text.find(MARK)] if i >= 0])
            cut, last = text[: text.rfind("\n}\n", 0, odd) + 3].split("\n}\n")[:-1] if "\n}\n" in text[:odd] else [], len(text)
        for k, part in enumerate(cut):
            if k < last:
                part += "\n}\n"
            if len(part) > LONGEST:
                return rows, pieces, at
            runs = RUN.split(part)
            found = runs[1::2]
            names = [r for i, r in enumerate(found) if runs[2 * i][-1:] == "_" and r[0] != "/"]
            order: dict[str, int] = {}
            same = tuple([order.setdefault(n, len(order)) for n in names])
            skeleton = "\0".join(runs[::2])
            key = (skeleton, same, k < last, given)
            if "//" in part:
                key += (tuple([i for i, r in enumerate(found) if r[0] == "/"]),)
            if not self.numbers:
                key += (tuple([r for i, r in enumerate(found) if runs[2 * i][-1:] != "_" and r[0] != "/"]),)
            piece = self.known.get(key)
            if piece is None:
                piece = self.former.get(key)
                if piece is None and not self.early and (met := hash(key)) not in self.once:
                    if len(self.once) >= ONCE:
                        self.once.clear()
                    self.once.add(met)
                    piece = self.learn(runs[::2], found, None, k < last, given)
                    if piece is False:
                        return rows, pieces, at
                    rows += [moved(row, at, line) for row, _ in piece.rows] if at else [row for row, _ in piece.rows]
                    pieces.append(piece)
                    at += len(part)
                    line += piece.lines
                    continue
                if piece is None:
                    piece = self.learn(runs[::2], found, order, k < last, given)
                if len(self.known) >= self.kept:
                    self.known, self.former = {}, self.known
                self.known[key] = piece
            if piece is False:
                return rows, pieces, at
            shift = list(accumulate([len(r) - n for r, n in zip(found, piece.lengths, strict=True)], initial=at))
            context = Context(shift, list(order), line)
            for row, numbers in zip(piece.rows, piece.numbers, strict=True):
                fixed, fill = row
                made = fill(context) if fill else dict(fixed)
                if self.finish:
                    self.finish(made, len({found[i] for i in numbers}))
                rows.append(made)
            pieces.append(piece)
            at += len(part)
            line += piece.lines
        return rows, pieces, at

    def learn(self, fixed: list[str], runs: list[str], order: dict[str, int] | None, inner: bool, given: tuple = ()) -> Piece | bool:
        """Reads a piece, with marks for its names' numbers in that `order` if it shall be told again; False if it doesn't stand alone."""
        if order and len(order) > 9_999:
            return False
        marked = runs if order is None else [f"{MARK}{order[r]:04d}7" if before[-1:] == "_" and r[0] != "/" else r for before, r in zip(fixed, runs, strict=False)]
        parts = [""] * (2 * len(runs) + 1)
        parts[::2], parts[1::2] = fixed, marked
        text = "".join(parts)
        tree = Tree(text)
        kids = tree.root.kids
        if tree.notes or tree.has_label_addresses or inner and not (kids and kids[-1].tag == "func_def" and kids[-1].hi == len(tree.tokens) > 0):
            return False
        if not tree.closed:
            return False
        if order is None:
            made, told = self.make(tree, *given)
            return Piece([], [(row, None) for row in made], [], told, len(text), text.count("\n"))
        ends = list(accumulate(map(len, parts)))[1::2]
        # a run is one token or the end of one, or a comment
        token_ends = {t.hi: t for t in tree.tokens}
        plain = []
        for i, end in enumerate(ends):
            run = marked[i]
            token = token_ends.get(end)
            if run[0] == "/":
                continue
            if token is None or (token.kind != IDENT if run.startswith(MARK) else token.text != run):
                return False
            if not run.startswith(MARK):
                plain.append((i, token.lo))
        made, told = self.make(tree, *given)
        spans = [tree.span(f) for f in tree.functions()]
        numbers = [[i for i, lo in plain if a <= lo < b] for a, b in spans] if len(made) == len(spans) else [[] for _ in made]
        if self.finish:
            for row, own in zip(made, numbers, strict=True):
                self.finish(row, -len({runs[i] for i in own}))
        rows = [(row, blanks(row, "", ends)) for row in made]
        return Piece([len(r) for r in marked], rows, numbers, told, len(text), text.count("\n"))


#: Readers that a worker keeps from task to task, by what they read for.
SHARED: dict[tuple, Reader] = {}
#: As many of them at once.
SHARED_MOST = 3


def shared(key: tuple, make: Callable[..., tuple[list[dict], object]], **how) -> Reader:
    """This worker's reader for a purpose; `key` names all that `make` depends on."""
    reader = SHARED.pop(key, None) or Reader(make, **how)
    SHARED[key] = reader
    while len(SHARED) > SHARED_MOST:
        del SHARED[next(iter(SHARED))]
    return reader


def per_text(reader: Reader, text: str, given: tuple = ()) -> list[dict] | None:
    """A text's rows with functions numbered through the text, or None if it must be read whole; a piece's addition is its number of functions."""
    read = reader.read(text, given)
    if read is None:
        return None
    rows, pieces = read
    k = before = 0
    for piece in pieces:
        for row in rows[k : k + len(piece.rows)] if before else ():
            if row.get("function_id") is not None:
                row["function_id"] += before
        k += len(piece.rows)
        before += piece.told
    return rows
