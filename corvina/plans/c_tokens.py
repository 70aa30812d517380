"""Total tokeniser for C as people and decompilers write it.

Every text gives tokens; what can't be read becomes an `unknown` token or a
diagnostic, never an error.  Offsets are of code points here; `Positions` turns them
into bytes and lines.
"""

from __future__ import annotations

import bisect
import re
from itertools import accumulate
from typing import NamedTuple

# Keywords, and other spellings of the same keyword.
KEYWORDS = (
    "_Alignas _Alignof _Atomic auto _Bool break case char _Complex const continue default do double else enum extern float for _Generic goto if _Imaginary inline int long "
    "_Noreturn register restrict return short signed sizeof static _Static_assert struct switch _Thread_local typedef union unsigned void volatile while asm __attribute__ "
    "__builtin_choose_expr __builtin_offsetof __builtin_types_compatible_p __builtin_va_arg __builtin_va_list __extension__ __cdecl __declspec __imag__ __int128 __label__ __real__ typeof"
).split()
ALIASES = {
    "_Alignof": "__alignof __alignof__", "_Complex": "__complex __complex__", "const": "__const __const__", "inline": "__inline __inline__", "restrict": "__restrict __restrict__",
    "signed": "__signed __signed__", "_Thread_local": "__thread", "volatile": "__volatile __volatile__", "asm": "__asm __asm__", "__attribute__": "__attribute", "__declspec": "_declspec",
    "__imag__": "__imag", "__real__": "__real", "typeof": "__typeof __typeof__",
    "__cdecl": "_cdecl __stdcall _stdcall __fastcall _fastcall __thiscall _thiscall __vectorcall _vectorcall __regcall __clrcall __pascal _pascal __watcall __usercall __userpurge",
}
CANONICAL = {k: k for k in KEYWORDS} | {alias: k for k, names in ALIASES.items() for alias in names.split()}

IDENT, INT, FLOAT, CHAR, STRING, UNKNOWN, REGISTER, END = "identifier", "integer", "float", "character", "string", "unknown", "register_annotation", "end"
OPERANDS = {IDENT, INT, FLOAT, CHAR, STRING}
CLOSERS = {")", "]", "}"}
ARTEFACTS = {UNKNOWN, REGISTER}
#: Tokens that are no Halstead operators: all but keywords and punctuators, and closing brackets.
NO_OPERATORS = OPERANDS | CLOSERS | ARTEFACTS | {END}

SCAN = re.compile(
    r"""
    (?P<space>(?:\s|\\\r?\n)+)
  | (?P<comment>//(?:[^\n\\]|\\.|\\\n)*|/\*.*?\*/)
  | (?P<open>/\*)
  | (?P<string>(?:u8|[uUL])?"(?:[^"\\\n]|\\.|\\\n)*(?P<s_end>"?))
  | (?P<char>(?:u8|[uUL])?'(?:[^'\\\n]|\\.|\\\n)*(?P<c_end>'?))
  | (?P<number>\.?\d(?:[eEpP][+-](?=[\w])|[\w.])*)
  | (?P<word>(?:[^\W\d]|\$)(?:\w|\$)*)
  | (?P<register>@[ \t]*<?[A-Za-z]\w*>?)
  | (?P<punct>>>=|<<=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|::|\#\#|[][{}();,.<>=!~?:+*/%&|^#-])
  | (?P<other>.)
    """,
    re.X | re.S,
)
HEX_FLOAT = re.compile(r"0[xX][\da-fA-F.]*[pP]|0[xX][\da-fA-F]*\.")
#: A line that looks like the beginning of a function, where reading goes on after an open comment.
RESUME = re.compile(r"^(?:\w[\w \t*]*[ \t*])\w+[ \t]*\([^;{}]*\)\s*\{", re.M)


class Token(NamedTuple):
    kind: str
    text: str
    lo: int
    hi: int


class Note(NamedTuple):
    """A diagnostic."""

    severity: str
    message: str
    lo: int
    hi: int


#: Kinds of tokens seen so far, by their text; "" for white space.  Texts with a diagnostic are not kept.
_seen: dict[str, str] = {}
SEEN = 100_000


def tokenize(text: str) -> tuple[list[Token], list[Note], list[int]]:
    """Tokens of a text, without white space and comments, what was odd about it, and the tokens at which reading went on after an open comment."""
    out: list[Token] = []
    notes: list[Note] = []
    resumed: list[int] = []
    seen, append, new = _seen.get, out.append, tuple.__new__
    if len(_seen) > SEEN:
        _seen.clear()
    pos = 0
    while pos < len(text):
        for m in SCAN.finditer(text, pos):
            piece = m[0]
            kind = seen(piece)
            if kind is not None:
                if kind:
                    append(new(Token, (kind, piece, *m.span())))
                continue
            group = m.lastgroup
            if group == "space" or group == "comment":
                if len(piece) < 64:
                    _seen[piece] = ""
                continue
            lo, pos = m.span()
            sound = True
            if group == "word":
                kind = CANONICAL.get(piece, IDENT)
            elif group == "punct":
                kind = piece
            elif group == "number":
                hexadecimal = piece[:2] in ("0x", "0X")
                kind = FLOAT if HEX_FLOAT.match(piece) or not hexadecimal and re.search(r"[.eE]", piece) else INT
            elif group == "string":
                kind, sound = STRING, bool(m["s_end"])
                if not sound:
                    notes.append(Note("error", "unterminated string literal", lo, pos))
            elif group == "char":
                kind, sound = CHAR, bool(m["c_end"])
                if not sound:
                    notes.append(Note("error", "unterminated character literal", lo, pos))
            elif group == "register":
                kind = REGISTER
            elif group == "open":
                pos = _resumed(text, pos)
                notes.append(Note("error", "unterminated comment", lo, pos))
                resumed.append(len(out))
                break
            else:
                kind, sound = UNKNOWN, False
                notes.append(Note("error", "unexpected character", lo, pos))
            if sound and len(piece) < 64:
                _seen[piece] = kind
            append(new(Token, (kind, piece, lo, pos)))
        else:
            break
    return out, notes, resumed


def _resumed(text: str, pos: int) -> int:
    """Where reading goes on after a comment that nothing ends: behind its line, where a function begins, or at the end."""
    again = RESUME.search(text, pos)
    return again.start() if again else len(text)


def is_operator(kind: str) -> bool:
    """Whether a token counts as a Halstead operator."""
    return kind not in NO_OPERATORS


class Positions:
    """Byte offsets and line numbers of code-point offsets of one text."""

    def __init__(self, text: str):
        self.size = len(text)
        self.ends = None if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]
        self.breaks = [m.end() for m in re.finditer("\n", text)]

    def byte(self, at: int) -> int:
        at = min(at, self.size)
        return at if self.ends is None else self.ends[at]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.breaks, at) + 1
