"""Tolerant parser: tokens to a syntax tree, whatever the text.

A tree node has a tag, its token range and its children.  Regions that fit no rule
become `error` nodes, so every token stands under some node and a damaged function
doesn't take its neighbours along.  Binary operators of one level make one flat node.
"""

from __future__ import annotations

import sys

from .c_tokens import CHAR, CLOSERS, END, FLOAT, IDENT, INT, REGISTER, STRING, Note, Token, tokenize

# Names of tree nodes.
STATEMENTS = set("compound_stmt expr_stmt null_stmt if_stmt while_stmt do_while_stmt for_stmt switch_stmt case_label default_label label_stmt goto_stmt break_stmt continue_stmt return_stmt".split())
EXPRESSIONS = set(
    "comma_expr assign_expr cond_expr binary_expr cast_expr compound_literal unary_expr sizeof_type alignof_type postfix_expr call_args index_suffix member_suffix inc_dec_suffix "
    "paren_expr stmt_expr name_ref literal builtin_expr label_addr".split()
)

STORAGE = {"auto", "extern", "inline", "register", "static", "typedef", "_Noreturn", "_Thread_local", "__extension__"}
QUALIFIERS = {"const", "volatile", "restrict", "_Atomic"}
BASE_TYPES = {"void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "_Bool", "_Complex", "_Imaginary", "__int128", "__builtin_va_list"}
TAGGED = {"struct", "union", "enum"}
DECORATION = {"__attribute__", "__declspec", "__cdecl", "asm", "_Alignas"}
SPECIFIERS = STORAGE | QUALIFIERS | BASE_TYPES | TAGGED | {"typeof", "__attribute__", "__declspec", "_Alignas"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
LEVELS = [{"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}, {"<", ">", "<=", ">="}, {"<<", ">>"}, {"+", "-"}, {"*", "/", "%"}]
LEVEL_OF = {op: n for n, ops in enumerate(LEVELS) for op in ops}
PREFIX = {"++", "--", "+", "-", "!", "~", "*", "&", "sizeof", "_Alignof", "__extension__", "__real__", "__imag__"}
BLOCK_ENDS = {"}", END}
SUFFIXES = {"(", "[", ".", "->", "++", "--"}
STATEMENT_WORDS = {"if", "while", "do", "for", "switch", "case", "default", "goto", "break", "continue", "return"}
#: Operands of one token, and what after one shows that it is all of the operand.
LEAVES = {IDENT: "name_ref", INT: "literal", FLOAT: "literal", CHAR: "literal"}
ENDS = {";", ",", ")", "]"}
AFTER_LEAF = ENDS | LEVEL_OF.keys() | ASSIGN | {"?", ":"}
CLOSING = {"(": ")", "[": "]", "{": "}"}
DEEP = 200_000
#: Tokens before a body among which a function's name is looked for.
HEAD = 400


class Node:
    __slots__ = ("tag", "lo", "hi", "kids", "main", "split")

    def __init__(self, tag: str, lo: int, hi: int = -1, kids: list[Node] | None = None, main: int = -1):
        self.tag, self.lo, self.hi, self.kids, self.main = tag, lo, hi, kids or [], main
        self.split = 0  # of a statement with a header: how many children the header has

    @property
    def header(self) -> list[Node]:
        return self.kids[: self.split]

    @property
    def arms(self) -> list[Node]:
        return self.kids[self.split :]

    def first(self, *tags: str) -> Node | None:
        return next((k for k in self.kids if k.tag in tags), None)

    def walk(self):
        """This node and all below it, parents first."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.kids))


class Tree:
    def __init__(self, text: str):
        self.text = text
        self.tokens, self.notes, resumed = tokenize(text)
        self.resumed = frozenset(resumed)  # tokens that begin anew at the top level
        self.has_label_addresses = False
        self.closed = True  # whether every bracket has its other one
        self.may_fork = any(t.kind in ("&&", "||", "?") for t in self.tokens)
        # nesting costs heap, not stack; the walks over the tree go as deep as the parser
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
        self.root = Parser(self).unit()

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else END

    def word(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def span(self, node: Node) -> tuple[int, int]:
        if not self.tokens or node.lo >= len(self.tokens):
            return len(self.text), len(self.text)
        return self.tokens[node.lo].lo, self.tokens[max(node.lo, node.hi - 1)].hi

    def functions(self) -> list[Node]:
        return [n for n in self.root.kids if n.tag == "func_def"]

    def name_of(self, function: Node) -> str:
        name = next((n for n in function.walk() if n.tag == "decl_name"), None)
        return "".join(self.word(i) for i in range(name.lo, name.hi)) if name else ""


class Parser:
    def __init__(self, tree: Tree):
        self.tree, self.t, self.i, self.size = tree, tree.tokens, 0, len(tree.tokens)
        self.kinds = [x.kind for x in tree.tokens] + [END] * 4
        self.match = self._pairs()
        self.ahead = 0, 0  # where salvage looked from and what it found

    def _pairs(self) -> dict[int, int]:
        """Closing bracket of each opening one; a missing one ends where its surroundings end."""
        out: dict[int, int] = {}
        stack: list[int] = []
        resumed = self.tree.resumed
        for i, k in enumerate(self.kinds):
            if resumed and i in resumed:
                stack.clear()
            if k in CLOSING:
                stack.append(i)
            elif k in (")", "]", "}"):
                while stack and CLOSING[self.kinds[stack[-1]]] != k and (k == "}" or self.kinds[stack[-1]] != "{"):
                    stack.pop()
                if stack and CLOSING[self.kinds[stack[-1]]] == k:
                    out[stack.pop()] = i
        self.tree.closed = 2 * len(out) == sum(k in CLOSING or k in CLOSERS for k in self.kinds)
        return out

    # -- basics ---------------------------------------------------------
    def at(self, *kinds: str) -> bool:
        return self.kinds[self.i] in kinds

    def take(self) -> int:
        if self.i < self.size:
            self.i += 1
        return self.i - 1

    def note(self, message: str, severity: str = "error", lo: int | None = None) -> None:
        where = min(self.i if lo is None else lo, len(self.t) - 1)
        a, b = (self.t[where].lo, self.t[where].hi) if self.t else (0, 0)
        self.tree.notes.append(Note(severity, message, a, b))

    def expect(self, kind: str, message: str, severity: str = "warning") -> bool:
        if self.at(kind):
            self.take()
            return True
        self.note(message, severity)
        return False

    def done(self, node: Node) -> Node:
        node.hi = self.i if self.i > node.lo else node.lo
        return node

    def error_to(self, *stops: str) -> Node:
        """An error node up to one of the stops outside brackets."""
        node = Node("error", self.i)
        self.note("unrecognised text")
        resumed = self.tree.resumed
        while not self.at(END, *stops) and self.i not in resumed:
            self.skip_one()
        if self.i == node.lo and not self.at(END) and self.i not in resumed:
            self.take()
        return self.done(node)

    def skip_one(self) -> None:
        close = self.match.get(self.i)
        self.i = close + 1 if close is not None else min(self.i + 1, len(self.t))

    def line_end(self, i: int) -> int:
        """First token after the line (with continuations) that token i stands on."""
        text, at = self.tree.text, self.t[i].hi
        while (at := text.find("\n", at)) >= 0 and text[max(0, at - 2) : at].rstrip("\r").endswith("\\"):
            at += 1
        if at < 0:
            return len(self.t)
        while i < len(self.t) and self.t[i].lo < at:
            i += 1
        return i

    def new_line(self) -> bool:
        """Whether the token here stands on a later line than the one before it."""
        return self.i >= len(self.t) or self.tree.text.find("\n", self.t[self.i - 1].hi, self.t[self.i].lo) >= 0

    def directive(self) -> Node:
        node = Node("pp_directive", self.i)
        self.i = max(self.line_end(self.i), self.i + 1)
        return self.done(node)

    def decoration(self) -> list[Node]:
        """Attributes (nodes) and calling conventions and register notes (nothing)."""
        out = []
        while self.at("__attribute__", "__declspec", "__cdecl", REGISTER, "_Alignas", "asm"):
            lo, kind = self.i, self.kinds[self.i]
            self.take()
            if kind in ("__cdecl", REGISTER):
                continue
            if kind == "asm" and self.at("volatile"):
                self.take()
            if self.at("("):
                self.skip_one()
            out.append(Node("asm" if kind == "asm" else "attribute", lo, self.i))
        return out

    # -- declarations -----------------------------------------------------
    def unit(self) -> Node:
        root = Node("unit", 0)
        while not self.at(END):
            before = self.i
            root.kids.append(self.external())
            if self.i == before:
                self.take()
        return self.done(root)

    def external(self) -> Node:
        if self.at("#"):
            return self.directive()
        if self.at(";"):
            node = Node("null_stmt", self.take())
            return self.done(node)
        if self.at("_Static_assert"):
            return self.static_assert()
        if self.at("asm"):
            node = Node("asm", self.i, kids=[])
            self.decoration()
            self.expect(";", "expected ';'")
            return self.done(node)
        if self.at("}", ")", "]"):
            self.note("unmatched closing bracket")
            return Node("error", self.take(), self.i)
        return self.declaration(top=True)

    def static_assert(self) -> Node:
        node = Node("static_assert", self.take())
        if self.at("("):
            self.skip_one()
        self.expect(";", "expected ';' after static assertion")
        return self.done(node)

    def specifiers(self) -> Node:
        node = Node("decl_specifiers", self.i)
        typed = False
        while True:
            k = self.kinds[self.i]
            if k in ("__attribute__", "__declspec", "__cdecl", REGISTER, "_Alignas"):
                node.kids += self.decoration()
            elif k in TAGGED:
                typed = True
                self.tagged(node)
            elif k in ("typeof", "_Atomic") and self.kinds[self.i + 1] == "(":
                typed = True
                self.take()
                self.skip_one()
            elif k in STORAGE or k in QUALIFIERS:
                self.take()
            elif k in BASE_TYPES:
                typed = True
                self.take()
            elif k == IDENT and not typed and self.names_type():
                typed = True
                self.take()
            else:
                break
        return self.done(node)

    def names_type(self) -> bool:
        """Whether the identifier here is read as a type: something that declares follows it."""
        j = self.i + 1
        while self.kinds[j] in ("*", "__cdecl", REGISTER) or self.kinds[j] in QUALIFIERS:
            j += 1
        k = self.kinds[j]
        if k == IDENT or k in SPECIFIERS and k not in ("typeof",):
            return True
        return k == "(" and j == self.i + 1 and self.kinds[j + 1] in ("*", "__cdecl") and self.match.get(j) is not None and self.kinds[self.match[j] + 1] == "("

    def tagged(self, node: Node) -> None:
        enum = self.kinds[self.take()] == "enum"
        node.kids += self.decoration()
        if self.at(IDENT):
            self.take()
        node.kids += self.decoration()
        if not self.at("{"):
            return
        body = Node("enum_body" if enum else "struct_body", self.i)
        close = self.match.get(self.i, len(self.t))
        self.take()
        while self.i < close and not self.at(END):
            before = self.i
            if self.at("#"):
                body.kids.append(self.directive())
            elif enum:
                item = Node("enumerator", self.i)
                if self.at(IDENT):
                    self.take()
                    item.kids += self.decoration()
                    if self.at("="):
                        self.take()
                        item.kids.append(self.conditional())
                else:
                    item.kids.append(self.error_to(",", "}"))
                body.kids.append(self.done(item))
                if self.at(","):
                    self.take()
            elif self.at("_Static_assert"):
                body.kids.append(self.static_assert())
            else:
                item = Node("member_decl", self.i)
                item.kids.append(self.specifiers())
                while self.i < close and not self.at(";", "}"):
                    stuck = self.i
                    item.kids.append(self.declarator())
                    if self.at(":"):
                        self.take()
                        while self.i < close and not self.at(",", ";"):
                            self.skip_one()
                    if self.at(","):
                        self.take()
                    elif not self.at(";") and self.i < close:
                        item.kids.append(self.error_to(";", "}"))
                    if self.i == stuck:
                        self.take()
                if self.at(";"):
                    self.take()
                body.kids.append(self.done(item))
            if self.i == before:
                self.take()
        self.i = min(max(self.i, close), len(self.t))
        self.expect("}", "expected '}'", "error")
        node.kids.append(self.done(body))

    def declarator(self) -> Node:
        node = Node("declarator", self.i)
        while self.at("*", "^") or self.kinds[self.i] in QUALIFIERS or self.at("__cdecl", "__attribute__", "__declspec", REGISTER):
            if self.at("*", "^"):
                node.kids.append(Node("pointer_operator", self.take(), self.i))
            elif self.kinds[self.i] in QUALIFIERS:
                self.take()
            else:
                node.kids += self.decoration()
        if self.at(IDENT):
            node.kids.append(Node("decl_name", self.take(), self.i))
            while self.at("::") and self.kinds[self.i + 1] == IDENT:  # a qualified name is one name
                self.take()
                self.take()
                node.kids[-1].hi = self.i
        elif self.at("(") and self.match.get(self.i) is not None and self.kinds[self.i + 1] not in SPECIFIERS and self.kinds[self.i + 1] not in (")",):
            inner = Node("parenthesized_declarator", self.take())
            inner.kids.append(self.declarator())
            self.expect(")", "expected ')'")
            node.kids.append(self.done(inner))
        node.kids += self.decoration()
        while self.at("(", "["):
            lo, call = self.i, self.at("(")
            close = self.match.get(self.i)
            if close is None:  # a missing bracket costs this declarator only
                self.note("missing closing bracket")
                self.take()
                while not self.at(END, "{", ";") and self.i not in self.tree.resumed:
                    self.take()
                node.kids.append(Node("param_list" if call else "array_suffix", lo, self.i))
                break
            suffix = Node("param_list" if call else "array_suffix", lo, close + 1)
            if call:
                start = lo + 1
                j = start
                while j <= close:
                    if j == close or self.kinds[j] == ",":
                        if j > start:
                            suffix.kids.append(Node("param_decl", start, j))
                        start = j + 1
                    j = self.match[j] + 1 if j in self.match and j != close else j + 1
            self.i = close + 1
            node.kids.append(suffix)
            node.kids += self.decoration()
        return self.done(node)

    def declaration(self, top: bool = False) -> Node:
        """A declaration or, at the top, a function definition."""
        node = Node("decl", self.i)
        if self.at("__label__"):
            while not self.at(";", END, "}"):
                self.take()
            self.expect(";", "expected ';'")
            node.tag = "local_label"
            return self.done(node)
        node.kids.append(self.specifiers())
        if top and node.kids[0].hi == node.kids[0].lo and not self.at(IDENT, "*", "("):
            if self.salvage(node):
                return self.function(node)
            error = self.error_to(";", "{", "}")
            if self.at("{"):
                self.skip_one()
            elif self.at(";"):
                self.take()
            return self.done(error)
        while not self.at(";", END, "}"):
            before = self.i
            d = self.declarator()
            node.kids.append(d)
            if top and self.is_function(d):
                return self.function(node)
            if self.at("="):
                init = Node("initializer", self.take())
                init.kids.append(self.init_value())
                node.kids.append(self.done(init))
            if self.at(","):
                self.take()
                continue
            if self.at(";", END, "}"):
                break
            if top and self.salvage(node):
                return self.function(node)
            if top and self.at("{"):
                if d.first("param_list"):
                    return self.function(node)
                self.note("unexpected body")
                body = Node("error", self.i)
                self.skip_one()
                node.kids.append(self.done(body))
                return self.done(node)
            if not top and (self.kinds[self.i] in STATEMENT_WORDS or self.at("{")):
                break
            if self.i > before and self.new_line():  # a missing ';' at a line's end
                break
            node.kids.append(self.error_to(";", "}", "{"))
            if self.i == before:
                self.take()
        if self.at(";"):
            self.take()
        else:
            self.note("expected ';' after declaration", "warning")
            if self.i == node.lo:
                self.take()
        return self.done(node)

    def salvage(self, node: Node) -> bool:
        """Whether what was begun as another declaration runs into a function body; then its declarator is set.

        Decompilers print words that are no C between type, name, parameters and body.
        The name is the first word with a parenthesis after which only words and
        parentheses come before the body.
        """
        begin, end = self.ahead
        if not begin <= self.i < end:
            end = self.i
            while self.kinds[end] not in ("{", ";", "}", "=", END):
                end = self.match.get(end, end) + 1
            self.ahead = self.i, end
        if self.kinds[end] != "{":
            return False
        at = max(node.lo, end - HEAD)
        while at < end:
            if self.kinds[at] == IDENT and self.kinds[at + 1] == "(" and at + 1 in self.match:
                rest = self.match[at + 1] + 1
                while rest < end and (self.kinds[rest] in (IDENT, "(", REGISTER) or self.kinds[rest] in DECORATION or self.kinds[rest] in QUALIFIERS):
                    rest = self.match.get(rest, rest) + 1
                if rest == end:
                    while at - 2 >= node.lo and self.kinds[at - 1] == "::" and self.kinds[at - 2] == IDENT:
                        at -= 2
                    self.note("unknown words in a function's head", "warning")
                    self.i = at
                    node.kids = [node.kids[0], self.declarator()]
                    node.kids[0].hi = min(node.kids[0].hi, at)
                    self.i = end
                    return True
            at += 1
        return False

    def is_function(self, d: Node) -> bool:
        if not any(n.tag == "param_list" for n in d.walk()) or not any(n.tag == "decl_name" for n in d.walk()):
            return False
        if self.at("{"):
            return True
        # declarations of parameters between the list and the body
        j = self.i
        if self.kinds[j] in SPECIFIERS or self.kinds[j] == IDENT:
            while self.kinds[j] not in ("{", END, "(", "="):
                if self.kinds[j] == "}":
                    return False
                j += 1
            return self.kinds[j] == "{" and self.kinds[j - 1] == ";"
        return False

    def function(self, node: Node) -> Node:
        node.tag = "func_def"
        while not self.at("{", END):
            before = self.i
            node.kids.append(self.declaration())
            if self.i == before:
                self.take()
        if self.at("{"):
            node.kids.append(self.compound())
        return self.done(node)

    def init_value(self) -> Node:
        if not self.at("{"):
            return self.assignment()
        node = Node("init_list", self.i)
        close = self.match.get(self.i, len(self.t))
        self.take()
        while self.i < close and not self.at(END):
            before = self.i
            if self.at(".") or self.at("["):
                d = Node("designator", self.i)
                while self.at(".", "["):
                    if self.at("["):
                        self.skip_one()
                    else:
                        self.take()
                        if self.at(IDENT):
                            self.take()
                node.kids.append(self.done(d))
                if self.at("="):
                    self.take()
            node.kids.append(self.init_value())
            if self.at(","):
                self.take()
            elif self.i < close:
                node.kids.append(self.error_to(",", "}"))
                if self.at(","):
                    self.take()
            if self.i == before:
                self.take()
        self.i = min(max(self.i, close), len(self.t))
        self.expect("}", "expected '}'", "error")
        return self.done(node)

    # -- statements --------------------------------------------------------
    def compound(self) -> Node:
        node = Node("compound_stmt", self.i)
        close = self.match.get(self.i)
        self.take()
        resumed = self.tree.resumed
        while self.kinds[self.i] not in BLOCK_ENDS and (not resumed or self.i not in resumed):
            before = self.i
            node.kids.append(self.statement())
            if self.i == before:
                self.take()
        if close is None or not self.at("}"):
            self.note("expected '}'")
        if self.at("}") and self.i not in resumed:
            self.take()
        return self.done(node)

    def starts_declaration(self) -> bool:
        k = self.kinds[self.i]
        if k in SPECIFIERS or k == "__label__":
            return k != "__extension__" or self.kinds[self.i + 1] in SPECIFIERS
        if k != IDENT:
            return False
        j = self.i + 1
        while self.kinds[j] == "*" or self.kinds[j] in QUALIFIERS:
            j += 1
        if self.kinds[j] == IDENT:  # "T x", "T *x"
            return self.kinds[j + 1] in (";", "=", ",", "[", ":", END) or self.kinds[j + 1] == "(" and j == self.i + 1 or self.kinds[j + 1] == ")" and False
        return j == self.i + 1 and self.kinds[j] == "(" and self.kinds[j + 1] == "*" and self.kinds[j + 2] == IDENT and self.kinds[j + 3] == ")" and self.kinds[j + 4 if j + 4 < len(self.kinds) else -1] == "("

    def parenthesised(self) -> list[Node]:
        if not self.expect("(", "expected '('", "error"):
            return []
        out = [] if self.at(")") else [self.expression()]
        if not self.at(")") and not self.at("{", ";", "}"):
            out.append(self.error_to(")", ";", "{", "}"))
        self.expect(")", "expected ')'")
        return out

    def body(self) -> Node:
        if self.at("}", END):
            self.note("expected a statement")
            return Node("null_stmt", self.i, self.i)
        return self.statement()

    def statement(self) -> Node:
        k, node = self.kinds[self.i], Node("", self.i)
        if k == "{":
            return self.compound()
        if k == IDENT and self.kinds[self.i + 1] in ASSIGN:
            node.tag = "expr_stmt"
            node.kids.append(self.expression())
            self.end_statement(node)
            return self.done(node)
        if k == "#":
            return self.directive()
        if k == ";":
            self.take()
            node.tag = "null_stmt"
            return self.done(node)
        if k == "if":
            node.tag, node.main = "if_stmt", self.take()
            node.kids += self.parenthesised()
            node.split = len(node.kids)
            node.kids.append(self.body())
            if self.at("else"):
                self.take()
                node.kids.append(self.body())
            return self.done(node)
        if k == "while":
            node.tag, node.main = "while_stmt", self.take()
            node.kids += self.parenthesised()
            node.split = len(node.kids)
            node.kids.append(self.body())
            return self.done(node)
        if k == "do":
            node.tag, node.main = "do_while_stmt", self.take()
            node.kids.append(self.body())
            if self.expect("while", "expected 'while'", "error"):
                node.kids += self.parenthesised()
            self.expect(";", "expected ';'")
            return self.done(node)
        if k == "for":
            return self.for_statement()
        if k == "switch":
            node.tag, node.main = "switch_stmt", self.take()
            node.kids += self.parenthesised()
            node.split = len(node.kids)
            node.kids.append(self.body())
            return self.done(node)
        if k == "case":
            node.tag, node.main = "case_label", self.take()
            node.kids.append(self.conditional())
            if self.at("..."):
                self.take()
                node.kids.append(self.conditional())
            self.expect(":", "expected ':'")
            return self.done(node)
        if k == "default" and self.kinds[self.i + 1] == ":":
            node.tag, node.main = "default_label", self.take()
            self.take()
            return self.done(node)
        if k == "goto":
            node.tag, node.main = "goto_stmt", self.take()
            if self.at("*"):
                self.take()
                node.kids.append(self.expression())
            elif self.at(IDENT):
                self.take()
            else:
                self.note("expected a label")
            self.expect(";", "expected ';'")
            return self.done(node)
        if k in ("break", "continue"):
            node.tag, node.main = f"{k}_stmt", self.take()
            self.expect(";", "expected ';'")
            return self.done(node)
        if k == "return":
            node.tag, node.main = "return_stmt", self.take()
            if not self.at(";", "}", END):
                node.kids.append(self.expression())
            self.end_statement(node)
            return self.done(node)
        if k == "asm":
            node.tag = "asm"
            self.take()
            while not self.at(";", "}", END):
                self.skip_one()
            self.expect(";", "expected ';'")
            return self.done(node)
        if k == "_Static_assert":
            return self.static_assert()
        if k == IDENT and self.kinds[self.i + 1] == ":" and self.kinds[self.i + 2] != ":":
            node.tag, node.main = "label_stmt", self.take()
            self.take()
            return self.done(node)
        if self.starts_declaration():
            return self.declaration()
        if k in (")", "]", "else", "default", "__attribute__"):
            self.note("unexpected token")
            node.tag = "error"
            self.take()
            if k == "__attribute__" and self.at("("):
                self.skip_one()
            return self.done(node)
        node.tag = "expr_stmt"
        node.kids.append(self.expression())
        self.end_statement(node)
        return self.done(node)

    def end_statement(self, node: Node) -> None:
        if self.at(";"):
            self.take()
        elif self.at("}", END) or self.kinds[self.i] in STATEMENT_WORDS or self.i > node.lo and self.new_line():
            self.note("expected ';'", "warning")
        else:
            node.kids.append(self.error_to(";", "}"))
            if self.at(";"):
                self.take()

    def for_statement(self) -> Node:
        node = Node("for_stmt", self.i, main=self.take())
        if self.expect("(", "expected '('", "error"):
            init = Node("for_init", self.i)
            if self.starts_declaration():
                init.kids.append(self.declaration())
            else:
                if not self.at(";"):
                    init.kids.append(self.expression())
                self.expect(";", "expected ';'")
            node.kids.append(self.done(init))
            for tag, stop in (("for_cond", ";"), ("for_step", ")")):
                part = Node(tag, self.i)
                if not self.at(stop, "{", "}"):
                    part.kids.append(self.expression())
                if not self.at(stop) and not self.at("{", "}", END):
                    part.kids.append(self.error_to(stop, "{", "}"))
                node.kids.append(self.done(part))
                if tag == "for_cond":
                    self.expect(";", "expected ';'")
            self.expect(")", "expected ')'")
        node.split = len(node.kids)
        node.kids.append(self.body())
        return self.done(node)

    # -- expressions -------------------------------------------------------
    def expression(self) -> Node:
        first = self.assignment()
        if not self.at(","):
            return first
        node = Node("comma_expr", first.lo, kids=[first], main=self.i)
        while self.at(","):
            self.take()
            node.kids.append(self.assignment())
        return self.done(node)

    def assignment(self) -> Node:
        i = self.i
        if self.kinds[i + 1] in ENDS and (tag := LEAVES.get(self.kinds[i])):
            self.i = i + 1
            return Node(tag, i, i + 1, None, i)
        left = self.conditional()
        if self.kinds[self.i] not in ASSIGN:
            return left
        node = Node("assign_expr", left.lo, kids=[left], main=self.take())
        node.kids.append(self.init_value() if self.at("{") else self.assignment())
        return self.done(node)

    def conditional(self) -> Node:
        test = self.binary()
        if not self.at("?"):
            return test
        node = Node("cond_expr", test.lo, kids=[test], main=self.take())
        if not self.at(":"):
            node.kids.append(self.expression())
        if self.expect(":", "expected ':'", "error"):
            node.kids.append(self.conditional_or_assignment())
        return self.done(node)

    def conditional_or_assignment(self) -> Node:
        return self.assignment()

    def binary(self) -> Node:
        """Flat chains; levels are climbed in a loop so that a plain operand costs one call."""
        chains: list[tuple[int, Node]] = []  # level, open chain
        left = self.operand()
        while True:
            k = self.kinds[self.i]
            found = LEVEL_OF.get(k, -1)
            while chains and chains[-1][0] > found:
                _, chain = chains.pop()
                chain.kids.append(left)
                chain.hi = left.hi
                left = chain
            if found < 0:
                return left
            if chains and chains[-1][0] == found:
                chains[-1][1].kids.append(left)
            else:
                chains.append((found, Node("binary_expr", left.lo, kids=[left], main=self.i)))
            self.take()
            left = self.operand()

    def operand(self) -> Node:
        i = self.i
        if self.kinds[i + 1] in AFTER_LEAF and (tag := LEAVES.get(self.kinds[i])):
            self.i = i + 1
            return Node(tag, i, i + 1, None, i)
        return self.cast()

    def type_in_parens(self) -> bool:
        """Whether "(" here opens a type name."""
        close, j = self.match.get(self.i), self.i + 1
        if close is None or close == j:
            return False
        if self.kinds[j] in BASE_TYPES | TAGGED | QUALIFIERS | {"typeof"}:
            return True
        if self.kinds[j] != IDENT:
            return False
        j += 1
        while self.kinds[j] == IDENT:
            j += 1
        stars = 0
        while j < close and (self.kinds[j] in ("*", "__cdecl") or self.kinds[j] in QUALIFIERS):
            stars += self.kinds[j] == "*"
            j += 1
        if j != close:
            return self.kinds[j] == "(" and self.kinds[j + 1] == "*" and stars == 0 and self.kinds[self.match.get(j, j) + 1] == "("
        after = self.kinds[close + 1]
        if stars:
            return after in (IDENT, INT, FLOAT, CHAR, STRING, "(", "&", "*", "-", "~", "!", "{", "sizeof", "+", "++", "--") or after == ")" and False
        return after in (IDENT, INT, FLOAT, CHAR, STRING, "~", "!", "sizeof", "{") or after == "(" and self.t[close].hi <= self.t[close + 1].lo and self.looks_like_type(self.i + 1)

    def looks_like_type(self, i: int) -> bool:
        word = self.t[i].text
        return word.endswith("_t") or word.startswith(("undefined", "uint", "int", "_BYTE", "_WORD", "_DWORD", "_QWORD")) or word in ("byte", "word", "dword", "qword", "bool", "size_t", "uchar", "ushort", "ulong", "code")

    def type_name(self) -> Node:
        """A parenthesised type name; stands before its "("."""
        close = self.match[self.i]
        node = Node("type_name", self.i + 1, close)
        self.i = close + 1
        return node

    def cast(self) -> Node:
        if self.at("(") and self.type_in_parens():
            lo = self.i
            kind = self.type_name()
            if self.at("{"):
                return self.suffixes(Node("compound_literal", lo, kids=[kind, self.init_value()], hi=self.i))
            if self.kinds[self.i] in PREFIX or self.at("(", IDENT, INT, FLOAT, CHAR, STRING, "&&") or self.kinds[self.i].startswith("__builtin"):
                node = Node("cast_expr", lo, kids=[kind])
                node.kids.append(self.cast())
                return self.done(node)
            self.i = lo
        return self.unary()

    def unary(self) -> Node:
        k = self.kinds[self.i]
        if k in ("sizeof", "_Alignof") and self.kinds[self.i + 1] == "(":
            lo = self.take()
            close = self.match.get(self.i)
            typed = close is not None and (self.type_in_parens() or self.kinds[self.i + 1] == IDENT and self.kinds[close - 1] == "*")
            if typed and self.kinds[close + 1] != "{":
                return Node("sizeof_type" if k == "sizeof" else "alignof_type", lo, kids=[self.type_name()], hi=self.i, main=lo)
            self.i = lo
        if k in PREFIX:
            node = Node("unary_expr", self.i, main=self.take())
            node.kids.append(self.cast())
            return self.done(node)
        if k == "&&" and self.kinds[self.i + 1] == IDENT:
            self.tree.has_label_addresses = True
            node = Node("label_addr", self.take())
            self.take()
            return self.done(node)
        return self.suffixes(self.primary())

    def primary(self) -> Node:
        k, lo = self.kinds[self.i], self.i
        if lo in self.tree.resumed:
            self.note("expected an expression")
            return Node("error", lo, lo)
        if k == IDENT:
            self.take()
            while self.at("::") and self.kinds[self.i + 1] == IDENT:
                self.take()
                self.take()
            return Node("name_ref", lo, self.i, main=lo)
        if k == STRING:
            while self.at(STRING):
                self.take()
            return Node("literal", lo, self.i, main=lo)
        if k in (INT, FLOAT, CHAR):
            self.take()
            return Node("literal", lo, self.i, main=lo)
        if k == "(":
            if self.kinds[self.i + 1] == "{":
                self.tree.may_fork = True
                node = Node("stmt_expr", self.take())
                node.kids.append(self.compound())
                self.expect(")", "expected ')'")
                return self.done(node)
            node = Node("paren_expr", self.take())
            if not self.at(")"):
                node.kids.append(self.expression())
            if not self.at(")") and not self.at(";", "{", "}", END):
                node.kids.append(self.error_to(")", ";", "{", "}"))
            self.expect(")", "expected ')'")
            return self.done(node)
        if k.startswith("__builtin") or k == "_Generic":
            self.take()
            if self.at("("):
                self.skip_one()
            return Node("builtin_expr", lo, self.i, main=lo)
        if k in BASE_TYPES or k in TAGGED:  # a type where a value should be, as in va_arg(ap, int)
            node = Node("type_name", lo)
            while self.kinds[self.i] in BASE_TYPES | TAGGED | QUALIFIERS or self.at("*", IDENT):
                self.take()
            return self.done(node)
        self.note("expected an expression")
        node = Node("error", lo)
        if not self.at(";", ")", "]", "}", "{", ",", ":", END) and k not in STATEMENT_WORDS:
            self.take()
        return self.done(node)

    def suffixes(self, base: Node) -> Node:
        if self.kinds[self.i] not in SUFFIXES or self.i in self.tree.resumed:
            return base
        node = None
        while self.kinds[self.i] in SUFFIXES:
            lo, k = self.i, self.kinds[self.i]
            if k in ("(", "[") and self.match.get(self.i) is None:
                self.note("missing closing bracket")
                suffix = Node("call_args" if k == "(" else "index_suffix", self.take())
                while not self.at(";", "{", "}", ")", END) and self.i not in self.tree.resumed:
                    self.take()
                suffix = self.done(suffix)
            elif k == "(":
                suffix = Node("call_args", self.take())
                while not self.at(")", ";", "{", "}", END):
                    before = self.i
                    suffix.kids.append(self.assignment())
                    if self.at(","):
                        self.take()
                    elif not self.at(")"):
                        suffix.kids.append(self.error_to(",", ")", ";", "}"))
                        if self.at(","):
                            self.take()
                    if self.i == before:
                        self.take()
                self.expect(")", "expected ')'")
                suffix = self.done(suffix)
            elif k == "[":
                suffix = Node("index_suffix", self.take())
                if not self.at("]"):
                    suffix.kids.append(self.expression())
                if not self.at("]") and not self.at(";", "}", END):
                    suffix.kids.append(self.error_to("]", ";", "}"))
                self.expect("]", "expected ']'")
                suffix = self.done(suffix)
            elif k in (".", "->"):
                self.take()
                if self.at(IDENT):
                    self.take()
                else:
                    self.note("expected a member name")
                suffix = Node("member_suffix", lo, self.i, main=lo)
            else:
                self.take()
                suffix = Node("inc_dec_suffix", lo, self.i, main=lo)
            if node is None:
                node = Node("postfix_expr", base.lo, kids=[base], main=lo)
            node.kids.append(suffix)
            node.hi = suffix.hi
        return node or base
