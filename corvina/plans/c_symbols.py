"""Declarations with the stretch of text that sees them, and uses of names: what `operators.symbols` joins."""

from __future__ import annotations

from .c_syntax import Node, Tree

# Kinds of symbols.
KINDS = "typedef enumerator function object parameter local".split()


class Symbols:
    """`declared`: (name, kind, token, begin, end, depth, function); `used`: (name, token, function).  Begin and end are token numbers."""

    def __init__(self, tree: Tree):
        self.tree, self.declared, self.used = tree, [], []
        self.function: int | None = None
        last = len(tree.tokens)
        number = 0
        for n in tree.root.kids:
            if n.tag == "func_def":
                self.define(n, number, last)
                number += 1
            else:
                self.walk(n, 0, last)

    def add(self, name: int, kind: str, begin: int, end: int, depth: int) -> None:
        self.declared.append((self.tree.word(name), kind, name, begin, end, depth, self.function))

    def define(self, node: Node, number: int, last: int) -> None:
        declarator = next((d for d in node.kids if d.tag == "declarator"), None)
        name = declarator and next((n for n in declarator.walk() if n.tag == "decl_name"), None)
        if name:
            self.add(name.lo, "function", declarator.hi, last, 0)
        self.specified(node.first("decl_specifiers"), 0, last)
        self.function = number
        params = declarator and next((n for n in declarator.walk() if n.tag == "param_list"), None)
        for p in params.kids if params else []:
            at = next((n.lo for n in p.walk() if n.tag == "decl_name"), None)
            identifiers = [i for i in range(p.lo, p.hi) if self.tree.kind(i) == "identifier"]
            if at is None and "(" not in [self.tree.word(i) for i in range(p.lo, p.hi)] and identifiers and identifiers[-1] > p.lo:
                at = identifiers[-1]
            for i in identifiers[: 1 if identifiers and identifiers[0] != at and (identifiers[0] == p.lo or self.tree.word(identifiers[0] - 1) in ("const", "volatile")) else 0]:
                self.used.append((self.tree.word(i), i, number))
            if at is not None:
                self.add(at, "parameter", p.hi, node.hi, 1)
        for k in node.kids:
            if k.tag == "compound_stmt":
                self.walk(k, 1, node.hi)
        self.function = None

    def specified(self, node: Node | None, depth: int, end: int) -> None:
        """Enumerators that specifiers declare, and typedef names that they use."""
        if node is None:
            return
        for n in node.walk():
            if n.tag == "enumerator":
                self.add(n.lo, "enumerator", n.hi, end, depth)
                for k in n.kids:
                    self.walk(k, depth, end)
            elif n.tag in ("decl_specifiers", "type_name"):
                body = n.first("struct_body", "enum_body")
                for i in range(n.lo, body.lo if body else n.hi):
                    if self.tree.kind(i) == "identifier" and (i == n.lo or self.tree.word(i - 1) not in ("struct", "union", "enum", ".", "->")):
                        self.used.append((self.tree.word(i), i, self.function))

    def walk(self, node: Node, depth: int, end: int) -> None:
        tag = node.tag
        if tag in ("compound_stmt", "for_stmt"):
            depth, end = depth + 1, node.hi
        elif tag == "decl":
            self.declare(node, depth, end)
            return
        elif tag == "name_ref":
            self.used.append((self.tree.word(node.lo), node.lo, self.function))
        elif tag == "type_name":
            self.specified(node, depth, end)
            return
        for k in node.kids:
            self.walk(k, depth, end)

    def declare(self, node: Node, depth: int, end: int) -> None:
        head = node.kids[0] if node.kids and node.kids[0].tag == "decl_specifiers" else None
        self.specified(head, depth, end)
        typedef = head is not None and "typedef" in [self.tree.word(i) for i in range(head.lo, head.hi)]
        for k in node.kids:
            if k.tag == "declarator":
                name = next((n for n in k.walk() if n.tag == "decl_name"), None)
                if name is not None:
                    kind = "typedef" if typedef else "function" if k.first("param_list") is not None else "local" if depth else "object"
                    self.add(name.lo, kind, k.hi, end, depth)
                for s in (s for s in k.kids if s.tag == "array_suffix"):
                    self.used += [(self.tree.word(i), i, self.function) for i in range(s.lo, s.hi) if self.tree.kind(i) == "identifier"]
            elif k is not head:
                self.walk(k, depth, end)
