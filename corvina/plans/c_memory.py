"""What a function does with memory, as steps over places: the small reader before the joins of `operators.memory`.

A place is a region - a variable with a path, as in "x", "x.f", "x[*]", "*p" for what
a parameter points to - or what a pointer refers to, with a path below it.  Names that
an inner scope declares anew get a number.  Temporaries begin with "%".
"""

from __future__ import annotations

from . import c_alike, c_graph
from .c_measure import parameters
from .c_syntax import Node, Tree

# Kinds of steps.
OPERATIONS = "parameter local addr copy load store gep unknown read write argument".split()
UNREAD = {"sizeof_type", "alignof_type", "type_name", "attribute", "asm", "static_assert", "decl_specifiers", "label_addr", "param_list"}
ELEMENTS = "[*]"


class Steps:
    """Reads one function; `rows` are (op, dst, src, path, lo, at, number, callee), positions in tokens."""

    def __init__(self, tree: Tree, function: Node):
        self.tree, self.rows, self.made = tree, [], 0
        self.scopes: list[dict[str, str]] = [{}]
        self.seen: dict[str, int] = {}
        self.pointers: set[str] = set()
        self.arrays: set[str] = set()
        self.plain: set[str] = set()
        self.unions: list[str] = []
        found = next((n for n in function.walk() if n.tag == "param_list"), None)
        words = [[tree.tokens[i].text for i in range(k.lo, k.hi)] for k in found.kids] if found else []
        for number, name in enumerate(parameters(tree, function)):
            here = self.bind(name)
            if number < len(words) and {"*", "["} & {*words[number]}:
                self.pointers.add(here)
                self.row("parameter", here, f"*{here}", number=number, lo=function.lo, at=-1)
                if "union" in words[number]:
                    self.unions.append(f"*{here}")
            else:
                self.plain.add(here)
            self.row("write", here, lo=function.lo, at=-1)
        body = function.first("compound_stmt")
        if body:
            self.visit(body)

    def row(self, op: str, dst: str | None = None, src: str | None = None, path: str = "", lo: int = 0, at: int = 0, number: int = 0, callee: str | None = None) -> None:
        self.rows.append((op, dst, src, path, lo, at, number, callee))

    def bind(self, name: str) -> str:
        n = self.seen[name] = self.seen.get(name, 0) + 1
        self.scopes[-1][name] = name if n == 1 else f"{name}#{n}"
        return self.scopes[-1][name]

    def known(self, node: Node) -> str:
        name = self.tree.word(node.lo)
        return next((s[name] for s in reversed(self.scopes) if name in s), name)

    def operator(self, node: Node) -> str:
        return self.tree.kind(node.main) if node.tag == "unary_expr" else ""

    def temporary(self) -> str:
        self.made += 1
        return f"%{self.made}"

    # -- places ------------------------------------------------------------------
    def place(self, node: Node) -> tuple[str, str, str] | None:
        """("region", path, "") or ("deref", pointer, path below) of an expression that names memory."""
        while node.tag == "paren_expr" and node.kids:
            node = node.kids[0]
        if node.tag == "name_ref":
            return "region", self.known(node), ""
        if self.operator(node) == "*":
            inner = node.kids[0]
            while inner.tag == "paren_expr" and inner.kids:
                inner = inner.kids[0]
            return self.place(inner.kids[0]) if self.operator(inner) == "&" else self.through(inner, "")
        if node.tag != "postfix_expr":
            return None
        here = self.place(node.kids[0])
        base: Node | None = node.kids[0]
        for k in node.kids[1:]:
            if k.tag == "member_suffix" and self.tree.kind(k.main) == ".":
                here = here and (here[0], here[1] + (f".{self.tree.word(k.main + 1)}" if here[0] == "region" else ""), here[2] + (f".{self.tree.word(k.main + 1)}" if here[0] == "deref" else ""))
            elif k.tag == "member_suffix":
                here = self.through_place(here, base, f".{self.tree.word(k.main + 1)}", k.lo)
            elif k.tag == "index_suffix":
                if here and here[0] == "region" and (here[1] in self.arrays or here[1] not in self.pointers and ("." in here[1] or here[1].endswith(ELEMENTS))):
                    here = "region", here[1] + ELEMENTS, ""
                else:
                    here = self.through_place(here, base, "", k.lo)
            else:
                return None
            base = None
        return here

    def through(self, pointer: Node, path: str) -> tuple[str, str, str]:
        """What a pointer expression refers to."""
        if pointer.tag == "name_ref" and (name := self.known(pointer)) not in self.arrays:
            return "deref", name, path
        if pointer.tag == "name_ref":
            return "region", self.known(pointer) + ELEMENTS + path, ""
        held = self.temporary()
        self.assign(held, pointer, pointer.lo)
        return "deref", held, path

    def through_place(self, here: tuple[str, str, str] | None, base: Node | None, path: str, lo: int) -> tuple[str, str, str]:
        if here is None:
            held = self.temporary()
            if base is None:
                self.row("unknown", held, lo=lo)
            else:
                self.assign(held, base, lo)
            return "deref", held, path
        if here[0] == "region":
            if here[1] in self.arrays:
                return "region", here[1] + ELEMENTS + path, ""
            return "deref", here[1], path
        held = self.temporary()
        self.row("load", held, here[1], here[2], lo=lo)
        return "deref", held, path

    # -- pointer values ----------------------------------------------------------------
    def assign(self, dst: str, value: Node, lo: int) -> None:
        """Steps that give a place (a region's path or a temporary) the targets of a value."""
        while value.tag == "paren_expr" and value.kids:
            value = value.kids[0]
        tag = value.tag
        if tag == "literal":
            if self.tree.kind(value.lo) == "string":
                self.row("addr", dst, f"<text {value.lo}>", lo=lo)
        elif self.operator(value) == "&":
            here = self.place(value.kids[0])
            if here is None:
                self.row("unknown", dst, lo=lo)
            elif here[0] == "region":
                self.row("addr", dst, here[1], lo=lo)
            elif here[2]:
                self.row("gep", dst, here[1], here[2], lo=lo)
            else:
                self.row("copy", dst, here[1], lo=lo)
        elif tag == "assign_expr" and self.tree.kind(value.main) == "=":
            self.assign(dst, value.kids[1], lo)
        elif tag == "cond_expr" and len(value.kids) > 2:
            for k in value.kids[1:]:
                self.assign(dst, k, lo)
        elif tag == "comma_expr":
            self.assign(dst, value.kids[-1], lo)
        elif tag == "cast_expr" and len(value.kids) > 1:
            number = self.place(value.kids[1])
            to_pointer = any(self.tree.kind(i) == "*" for i in range(value.kids[0].lo, value.kids[0].hi))
            if to_pointer and not (number and number[0] == "region" and number[1] in self.plain):
                self.assign(dst, value.kids[1], lo)
            else:
                self.row("unknown", dst, lo=lo)
        elif (here := self.place(value)) is not None:
            if here[0] == "deref":
                self.row("load", dst, here[1], here[2], lo=lo)
            elif here[1] in self.arrays:
                self.row("addr", dst, here[1] + ELEMENTS, lo=lo)
            elif here[1] not in self.plain:
                self.row("copy", dst, here[1], lo=lo)
        else:
            self.row("unknown", dst, lo=lo)

    def put(self, target: Node, value: Node | None, lo: int, at: int, reads: bool) -> None:
        """A write to a target, and the targets of the value if the target may hold a pointer."""
        here = self.place(target)
        if here is None:
            self.visit(target)
            return
        self.inner(target)
        if reads:
            self.access("read", here, lo, lo)
        if value is not None and not (here[0] == "region" and here[1] in self.plain):
            if here[0] == "region":
                self.assign(here[1], value, lo)
            else:
                held = self.temporary()
                self.assign(held, value, lo)
                self.row("store", here[1], held, here[2], lo=lo)
        elif value is None and here[0] == "region" and here[1] in self.pointers:
            self.row("unknown", here[1], lo=lo)  # a pointer that moves
        self.access("write", here, lo, at)

    def access(self, op: str, here: tuple[str, str, str], lo: int, at: int) -> None:
        if here[0] == "deref":
            if not here[1].startswith("%"):
                self.row("read", here[1], lo=lo, at=lo)
            self.row(op, None, here[1], here[2], lo=lo, at=at)
        else:
            self.row(op, here[1], lo=lo, at=at)

    def inner(self, node: Node) -> None:
        """What a place reads to be found: indexes and calls inside it."""
        for k in node.kids:
            if k.tag in ("index_suffix", "call_args"):
                for x in k.kids:
                    self.visit(x)
            elif k.tag != "member_suffix":
                self.inner(k)

    # -- the walk --------------------------------------------------------------------------
    def visit(self, node: Node) -> None:
        tag = node.tag
        if tag in UNREAD or self.operator(node) in ("sizeof", "_Alignof"):
            return
        if tag in ("compound_stmt", "for_stmt"):
            self.scopes.append({})
            for k in node.kids:
                self.visit(k)
            self.scopes.pop()
        elif tag == "decl":
            self.declare(node)
        elif tag == "assign_expr":
            plain = self.tree.kind(node.main) == "="
            self.visit(node.kids[1])
            self.put(node.kids[0], node.kids[1] if plain else None, node.lo, node.hi, not plain)
        elif self.operator(node) in ("++", "--"):
            self.put(node.kids[0], None, node.lo, node.hi, True)
        elif self.operator(node) == "&":
            self.inner(node.kids[0])
        elif tag == "postfix_expr" and node.kids[-1].tag == "inc_dec_suffix":
            base = node.kids[0] if len(node.kids) == 2 else Node("postfix_expr", node.lo, node.kids[-2].hi, node.kids[:-1], node.main)
            self.put(base, None, node.lo, node.hi, True)
        elif tag == "postfix_expr" and any(k.tag == "call_args" for k in node.kids):
            self.call(node)
        elif (here := self.place(node)) is not None:
            self.inner(node)
            self.access("read", here, node.lo, node.lo)
        else:
            for k in node.kids:
                self.visit(k)

    def call(self, node: Node) -> None:
        direct = node.kids[0].tag == "name_ref" and node.kids[1].tag == "call_args" and not any(self.tree.word(node.kids[0].lo) in s for s in self.scopes)
        if not direct:
            self.visit(node.kids[0])
        for i, k in enumerate(node.kids[1:]):
            if k.tag != "call_args":
                continue
            callee = self.tree.word(node.kids[0].lo) if direct and not i else None
            for number, x in enumerate(k.kids):
                self.visit(x)
                held = self.temporary()
                before = len(self.rows)
                self.assign(held, x, x.lo)
                if len(self.rows) > before and self.rows[-1][0] != "unknown":
                    self.row("argument", held, lo=node.lo, at=node.hi, number=number, callee=callee)

    def declare(self, node: Node) -> None:
        words = {self.tree.kind(i) for i in range(node.kids[0].lo, node.kids[0].hi)} if node.kids else set()
        if "typedef" in words:
            return
        last: str | None = None
        for k in node.kids:
            if k.tag == "declarator":
                name = next((n for n in k.walk() if n.tag == "decl_name"), None)
                if name is None:
                    continue
                last = self.bind(self.tree.word(name.lo))
                tags = {n.tag for n in k.walk()}
                if "array_suffix" in tags:
                    self.arrays.add(last)
                elif "pointer_operator" in tags:
                    self.pointers.add(last)
                    self.row("local", last, lo=k.lo, at=k.hi)
                elif not words & {"struct", "union"} and "identifier" not in words:
                    self.plain.add(last)
                if "union" in words and "pointer_operator" not in tags:
                    self.unions.append(last + (ELEMENTS if "array_suffix" in tags else ""))
            elif k.tag == "initializer" and last is not None:
                for x in k.kids:
                    self.visit(x)
                    if last not in self.plain:
                        self.assign(last, x, k.lo)
                self.row("write", last, lo=k.lo, at=k.hi)


def steps(tree: Tree, function: Node) -> dict:
    """Steps of a function with the node each stands in, the edges of its graph, and its unions."""
    read = Steps(tree, function)
    graph = c_graph.graph_of(tree, function)
    owners = sorted((s[1] - s[0], i) for i, s in enumerate(graph.spans) if i > 1)

    def owner(lo: int) -> int | None:
        at = tree.tokens[lo].lo
        return next((i for _, i in owners if graph.spans[i][0] <= at < graph.spans[i][1]), None)

    held: dict[int, int | None] = {}
    rows = []
    for i, (op, dst, src, path, lo, at, number, callee) in enumerate(read.rows):
        if at == -1:
            node = 0
        else:
            node = held[lo] if lo in held else held.setdefault(lo, owner(lo))
        if node is not None or op not in ("read", "write"):
            rows.append({"ord": i, "op": op, "dst": dst, "src": src, "path": path, "at": at, "node": node, "number": number, "callee": callee})
    return {"steps": rows, "edges": [{"src": e[0], "dst": e[1]} for e in graph.edges], "n_nodes": len(graph.kinds), "unions": read.unions, "locals": [n if k == 1 else f"{n}#{k}" for n, last in read.seen.items() for k in range(1, last + 1)]}


def _read(tree: Tree) -> tuple[list[dict], None]:
    return [{"function": tree.name_of(f)} | steps(tree, f) for f in tree.functions()], None


#: Steps number a text's tokens, so texts are alike only as a whole.
_reader = c_alike.Reader(_read, numbers=True, whole=True, kept=3_000)


def functions(text: str) -> list[dict]:
    """Name and steps of each function of a text."""
    read = _reader.read(text)
    return read[0] if read else _read(Tree(text))[0]
