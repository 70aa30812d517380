"""Types of expressions and the conversions that C makes on the way; what isn't known stays unknown.

A type is a name with a star for each pointer level, as in "unsigned int" or
"char * *"; an array counts as a pointer to its elements where it is used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from ..functions.c_types import FLOATS, INTEGERS, promoted, usual
from .c_syntax import QUALIFIERS, STORAGE, Node, Tree

SIZE, DISTANCE = "unsigned long", "long"
COMPARING = {"<", ">", "<=", ">=", "==", "!="}


def named(words: list[str]) -> str | None:
    """The type that specifiers name, in one spelling; None for a name that may stand for any type."""
    words = [w for w in words if w not in QUALIFIERS and w not in STORAGE and not w.startswith("__attribute")]
    if words and words[0] in ("struct", "union", "enum"):
        return "unsigned int" if words[0] == "enum" else " ".join(words[:2]) if len(words) > 1 and words[1].isidentifier() else None
    count = Counter(words)
    unsigned, long = count["unsigned"] > 0, count["long"]
    if "double" in count:
        return "long double" if long else "double"
    if len(count) == 1 and words[0] in ("float", "void", "_Bool"):
        return words[0]
    if "char" in count:
        return "unsigned char" if unsigned else "signed char" if count["signed"] else "char"
    if not count or any(w not in ("unsigned", "signed", "long", "short", "int", "__int128") for w in count):
        return None
    base = "short" if count["short"] else "__int128" if count["__int128"] else ("int", "long", "long long")[min(long, 2)]
    return f"unsigned {base}" if unsigned else base


def literal(word: str) -> str | None:
    """Type of a number, character or string as it is written."""
    if word[:1] in ("'", '"'):
        return "int" if word[0] == "'" else "char *"
    low = word.lower()
    if not low[:2] == "0x" and any(c in low for c in ".e"):
        return "float" if low.endswith("f") else "long double" if low.endswith("l") else "double"
    digits = low.rstrip("ul")
    suffix = low[len(digits) :]
    try:
        value = int(digits, 16 if digits[:2] == "0x" else 8 if digits[:1] == "0" and len(digits) > 1 else 10)
    except ValueError:
        return None
    decimal = digits[:1] != "0" or digits == "0"
    for name, bits in (("int", 31), ("unsigned int", 32), ("long", 63), ("unsigned long", 64)):
        if value < 2**bits and not ("u" in suffix and bits in (31, 63)) and not ("l" in suffix and bits < 63) and not (decimal and "u" not in suffix and bits in (32, 64)):
            return name
    return None


class Typer:
    """Types of one function's expressions; `rows` are operations in the order of their evaluation from the inside out."""

    def __init__(self, tree: Tree, function: Node, members: dict[str, dict[str, str]] | None = None, results: dict[str, str] | None = None):
        self.tree, self.rows, self.members, self.results = tree, [], members or {}, results or {}
        self.scopes: list[dict[str, str | None]] = [{}]
        head = next((n for n in function.walk() if n.tag == "param_list"), None)
        for p in head.kids if head else []:
            words = [tree.word(i) for i in range(p.lo, p.hi)]
            at = next((i for i in range(len(words) - 1, -1, -1) if tree.kind(p.lo + i) == "identifier"), None)
            if at:
                self.scopes[0][words[at]] = self.pointed(named([w for w in words[:at] if w != "*"]), words.count("*") + words.count("[")) if "(" not in words else None
        body = function.first("compound_stmt")
        if body:
            self.walk(body)

    @staticmethod
    def pointed(base: str | None, depth: int) -> str | None:
        return None if base is None else base + " *" * depth

    def row(self, node: Node, operation: str, kind: str | None, operands: list[tuple[str | None, str | None]]) -> str | None:
        self.rows.append((node.lo, node.hi, operation, kind, operands))
        return kind

    def walk(self, node: Node) -> None:
        if node.tag in ("compound_stmt", "for_stmt"):
            self.scopes.append({})
            for k in node.kids:
                self.walk(k)
            self.scopes.pop()
        elif node.tag == "decl":
            self.declare(node)
        elif node.tag.endswith("_expr") or node.tag in ("name_ref", "literal", "sizeof_type", "alignof_type", "compound_literal"):
            self.of(node)
        elif node.tag not in ("type_name", "attribute", "asm"):
            for k in node.kids:
                self.walk(k)

    def declare(self, node: Node) -> None:
        words = [self.tree.word(i) for i in range(node.kids[0].lo, node.kids[0].hi)] if node.kids else []
        if "typedef" in words:
            return
        last: str | None = None
        for k in node.kids:
            if k.tag == "declarator":
                name = next((n for n in k.walk() if n.tag == "decl_name"), None)
                if name is not None:
                    tags = Counter(n.tag for n in k.walk())
                    last = self.pointed(named(words), tags["pointer_operator"] + tags["array_suffix"]) if not tags["param_list"] and not tags["parenthesized_declarator"] else None
                    self.scopes[-1][self.tree.word(name.lo)] = last
            elif k.tag == "initializer":
                for x in k.kids:
                    if x.tag == "init_list":
                        self.walk(x)
                    else:
                        found = self.of(x)
                        self.row(k, "=", last, [(found, self.into(found, last))])

    @staticmethod
    def into(found: str | None, wanted: str | None) -> str | None:
        """The type that a value is converted to, None where it needs no conversion or one isn't known."""
        return wanted if found is not None and wanted is not None and found != wanted else None

    def binary(self, node: Node, operation: str, a: str | None, b: str | None) -> str | None:
        if operation in ("&&", "||"):
            return self.row(node, operation, "int", [(a, None), (b, None)])
        if operation in ("<<", ">>"):
            kinds = [promoted(x) if x in INTEGERS else None for x in (a, b)]
            return self.row(node, operation, kinds[0], [(x, self.into(x, k)) for x, k in zip((a, b), kinds, strict=True)])
        common = usual(a, b) if a and b else None
        pointers = [x is not None and x.endswith("*") for x in (a, b)]
        if common is None and operation in ("+", "-") and any(pointers):
            kind = DISTANCE if all(pointers) and operation == "-" else a if pointers[0] and b in INTEGERS else b if pointers[1] and a in INTEGERS and operation == "+" else None
            return self.row(node, operation, kind, [(a, None), (b, None)])
        kind = "int" if operation in COMPARING else common
        return self.row(node, operation, kind, [(x, self.into(x, common)) for x in (a, b)])

    def of(self, node: Node) -> str | None:
        tag, kids = node.tag, node.kids
        if tag == "literal":
            return literal(self.tree.word(node.lo))
        if tag == "name_ref":
            word = self.tree.word(node.lo)
            return next((s[word] for s in reversed(self.scopes) if word in s), None)
        if tag in ("sizeof_type", "alignof_type"):
            return SIZE
        if tag == "paren_expr":
            return self.of(kids[0]) if kids else None
        if tag == "binary_expr" and kids:
            kind = self.of(kids[0])
            for k in kids[1:]:
                kind = self.binary(node, self.tree.kind(k.lo - 1), kind, self.of(k))
            return kind
        if tag == "assign_expr" and len(kids) == 2:
            left, right, operation = self.of(kids[0]), self.of(kids[1]) if kids[1].tag != "init_list" else None, self.tree.kind(node.main)
            if operation != "=" and left and right and not left.endswith("*"):
                common = promoted(left) if operation in ("<<=", ">>=") else usual(left, right)
                return self.row(node, operation, left, [(left, self.into(left, common)), (right, self.into(right, None if operation in ("<<=", ">>=") else common))])
            return self.row(node, operation, left, [(right, self.into(right, left) if operation == "=" else None)])
        if tag == "cond_expr" and len(kids) > 1:
            arms = [self.of(k) for k in kids][-2:]
            kind = arms[0] if arms[0] == arms[1] and arms[0] not in INTEGERS else usual(*arms) if all(arms) else None
            return self.row(node, "?:", kind, [(x, self.into(x, kind)) for x in arms])
        if tag == "comma_expr":
            return [self.of(k) for k in kids][-1]
        if tag == "cast_expr" and len(kids) == 2:
            words = [self.tree.word(i) for i in range(kids[0].lo, kids[0].hi)]
            kind = self.pointed(named([w for w in words if w != "*"]), words.count("*")) if not {"(", "["} & {*words} else None
            found = self.of(kids[1])
            return self.row(node, "cast", kind, [(found, self.into(found, kind))])
        if tag == "unary_expr" and kids:
            return self.unary(node, self.tree.kind(node.main), kids[0])
        if tag == "postfix_expr":
            return self.postfix(node)
        for k in kids:
            self.walk(k)
        return None

    def unary(self, node: Node, operation: str, operand: Node) -> str | None:
        if operation in ("sizeof", "_Alignof"):
            return SIZE
        found = self.of(operand)
        if operation == "!":
            return self.row(node, operation, "int", [(found, None)])
        if operation in ("+", "-", "~"):
            kind = promoted(found) if found in INTEGERS else found if found in FLOATS and operation != "~" else None
            return self.row(node, operation, kind, [(found, self.into(found, kind))])
        kind = found if operation in ("++", "--") else f"{found} *" if operation == "&" and found else found[:-2] if operation == "*" and found and found.endswith(" *") else None
        return self.row(node, operation, kind, [(found, None)])

    def postfix(self, node: Node) -> str | None:
        base = node.kids[0]
        called = len(node.kids) > 1 and node.kids[1].tag == "call_args" and base.tag == "name_ref"
        kind = None if called else self.of(base)
        for k in node.kids[1:]:
            inner = [self.of(x) for x in k.kids]
            if k.tag == "index_suffix":
                kind = self.row(node, "[]", kind[:-2] if kind and kind.endswith(" *") else None, [(kind, None), (inner[0] if inner else None, None)])
            elif k.tag == "inc_dec_suffix":
                kind = self.row(node, self.tree.kind(k.main), kind, [(kind, None)])
            elif k.tag == "call_args":
                result = self.results.get(self.tree.word(base.lo)) if called and k is node.kids[1] and not any(self.tree.word(base.lo) in s for s in self.scopes) else None
                kind = self.row(node, "call", result, [(x, None) for x in inner])
            else:
                record = kind if self.tree.kind(k.main) == "." else kind[:-2] if kind and kind.endswith(" *") else None
                found = self.members.get(record or "", {}).get(self.tree.word(k.main + 1), "unknown")
                kind = self.row(node, "member", None if found == "unknown" else found.replace(" []", " *"), [(kind, None)])
        return kind


def operations(tree: Tree, function: Node, members: dict[str, dict[str, str]] | None = None, results: dict[str, str] | None = None) -> Iterator[dict]:
    """Operations of a function with their types and the conversions of their operands, given the members of records and the results of functions."""
    for number, (lo, hi, operation, kind, operands) in enumerate(Typer(tree, function, members, results).rows):
        yield {"ord": number, "lo": lo, "hi": hi, "op": operation, "type": kind, "operands": [{"type": a, "converted": b} for a, b in operands]}
