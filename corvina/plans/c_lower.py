"""Expressions as typed operations in a partial order, with C's conversions written out.

Each expression that a statement evaluates is a root.  Its operations name the values
they take, the truth values that admit them, and what must come before them; a root
that can't be expressed, or whose side effects have no order, is one `unknown` with a
reason.  Types are spelled as in `c_typing`, arrays with "[]"; what isn't known is
"unknown".
"""

from __future__ import annotations

from collections import Counter

from ..functions.c_types import FLOATS, INTEGERS, promoted, usual
from . import c_alike, c_graph
from .c_syntax import Node, Tree
from .c_tokens import Positions
from .c_typing import COMPARING, DISTANCE, literal, named

# Kinds of operations, conversions, and reasons why a root isn't lowered.
KINDS = "const load store binary compare unary convert select call branch return sequence unknown".split()
CONVERSIONS = ("promotion", "usual_arithmetic", "assignment")
REASONS = ("unsupported_form", "unsequenced_effects", "braced_initializer", "unplaced")
UNKNOWN = "unknown"
ARRAY = " []"
CONTROLS = {"if_stmt": "if", "while_stmt": "while", "do_while_stmt": "do_while", "switch_stmt": "switch"}


class Declined(Exception):
    """A root that has no operations; the argument is the reason."""


class Names:
    """What the file's own declarations say: types of functions and objects, members of records, typedefs."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.typedefs: dict[str, str] = {}
        self.results: dict[str, str] = {}
        self.objects: set[str] = set()
        self.members: dict[str, dict[str, str]] = {}
        for n in tree.root.kids:
            self.record(n)
            head = n.kids[0] if n.kids and n.kids[0].tag == "decl_specifiers" else None
            if n.tag not in ("decl", "func_def"):
                continue
            words = self.words(head)
            for d in (k for k in n.kids if k.tag == "declarator"):
                name, kind = self.declared(words, d)
                if name is None:
                    continue
                if "typedef" in words:
                    self.typedefs[name] = kind
                elif d.first("param_list") is not None:
                    self.results[name] = kind
                else:
                    self.objects.add(name)

    def words(self, node: Node | None) -> list[str]:
        body = node.first("struct_body") if node else None
        return [self.tree.word(i) for i in range(node.lo, body.lo if body else node.hi)] if node else []

    def record(self, node: Node) -> None:
        """Members of the records that a declaration spells out, nested ones too."""
        for spec in (n for n in node.walk() if n.tag == "decl_specifiers"):
            body, words = spec.first("struct_body"), self.words(spec)
            tag = next((f"{w} {words[i + 1]}" for i, w in enumerate(words[:-1]) if w in ("struct", "union")), None)
            if body is not None and tag is not None:
                found = (self.declared(self.words(m.kids[0]), d) for m in body.kids if m.tag == "member_decl" and m.kids for d in m.kids if d.tag == "declarator")
                self.members[tag] = {name: kind for name, kind in found if name is not None}

    def base(self, words: list[str]) -> str:
        words = [w for w in words if w != "typedef"]
        plain = [w for w in words if w not in ("const", "volatile", "restrict", "static", "extern", "register", "inline", "_Atomic")]
        return self.typedefs.get(plain[0], UNKNOWN) if len(plain) == 1 and plain[0] in self.typedefs else named(words) or UNKNOWN

    def declared(self, words: list[str], declarator: Node) -> tuple[str | None, str]:
        """Name and type of a declarator; pointers to functions and to arrays are unknown."""
        name = next((n for n in declarator.walk() if n.tag == "decl_name"), None)
        if name is None:
            return None, UNKNOWN
        tags = Counter(k.tag for k in declarator.kids)
        kind = self.base(words)
        if tags["parenthesized_declarator"] or name not in declarator.kids or kind == UNKNOWN:
            return self.tree.word(name.lo), UNKNOWN
        return self.tree.word(name.lo), kind + " *" * tags["pointer_operator"] + ARRAY * tags["array_suffix"]


class Lowering:
    """Operations of one function; an operation's id is its place in `ops`."""

    def __init__(self, tree: Tree, function: Node, names: Names):
        self.tree, self.names, self.ops, self.orders = tree, names, [], []
        self.graph = c_graph.graph_of(tree, function)
        self.blocks = sorted((s[1] - s[0], i, s) for i, s in enumerate(self.graph.spans) if i > 1)
        self.scopes: list[dict[str, tuple[str, int]]] = [{}]
        self.guards: list[tuple[int, bool]] = []
        self.roots = 0
        self.result = next((k for n, k in [names.declared(names.words(function.kids[0]), d) for d in function.kids if d.tag == "declarator"] if n), UNKNOWN)
        head = next((n for n in function.walk() if n.tag == "param_list"), None)
        for p in head.kids if head else []:
            self.parameter(p)
        body = function.first("compound_stmt")
        if body:
            self.statement(body)

    # -- names ------------------------------------------------------------------------
    def parameter(self, node: Node) -> None:
        name = next((n for n in node.walk() if n.tag == "decl_name"), None)
        if name is not None:
            declarator = next((d for d in node.kids if d.tag == "declarator"), None)
            words = self.names.words(node.first("decl_specifiers"))
            kind = self.names.declared(words, declarator)[1] if declarator else UNKNOWN
        else:  # no declarators inside parameters: read the words
            words = [self.tree.word(i) for i in range(node.lo, node.hi)]
            at = next((i for i in range(len(words) - 1, -1, -1) if self.tree.kind(node.lo + i) == "identifier"), None)
            if not at:
                return
            kind = self.names.base([w for w in words[:at] if w != "*"]) if "(" not in words else UNKNOWN
            kind = kind if kind == UNKNOWN else kind + " *" * words[:at].count("*") + ARRAY * words[at:].count("[")
            self.scopes[0][words[at]] = (self.adjusted(kind), node.lo + at)
            return
        self.scopes[0][self.tree.word(name.lo)] = (self.adjusted(kind), name.lo)

    @staticmethod
    def adjusted(kind: str) -> str:
        """A parameter that is declared as an array is a pointer."""
        return kind.replace(ARRAY, " *", 1) if ARRAY in kind else kind

    def find(self, name: str) -> tuple[str, int] | None:
        return next((s[name] for s in reversed(self.scopes) if name in s), None)

    # -- operations ----------------------------------------------------------------------
    def op(self, node: Node, kind: str, op: str, type_: str, inputs: list[int] | None = None, **more) -> int:
        lo, hi = self.tree.tokens[node.lo].lo, self.tree.tokens[max(node.lo, node.hi - 1)].hi
        block = next((i for _, i, (a, b) in self.blocks if a <= lo and hi <= b), None)
        if block is None:
            raise Declined("unplaced")
        self.ops.append({"kind": kind, "op": op, "type": type_, "inputs": inputs or [], "block": block, "root": self.roots, "guards": list(self.guards), "lo": lo, "hi": hi} | more)
        return len(self.ops) - 1

    def type_of(self, value: int) -> str:
        return self.ops[value]["type"]

    def converted(self, node: Node, value: int, to: str, why: str) -> int:
        found = self.type_of(value)
        if to == UNKNOWN or found == to or to.endswith("*") and self.ops[value]["kind"] == "const":
            return value
        return self.op(node, "convert", why, to, [value], **{"from": found, "to": to})

    def promote(self, node: Node, value: int) -> int:
        kind = self.type_of(value)
        return self.converted(node, value, promoted(kind), "promotion") if kind in INTEGERS else value

    def arithmetic(self, node: Node, parts: list[tuple[Node, int]]) -> tuple[list[int], str]:
        """Operands in their common type, promoted first."""
        kinds = [self.type_of(v) for _, v in parts]
        common = usual(*kinds) if all(k in INTEGERS or k in FLOATS for k in kinds) else None
        if common is None:
            same = kinds[0] if kinds[0] == kinds[1] and kinds[0].endswith("*") else UNKNOWN
            return [v for _, v in parts], same
        done = [self.promote(n, v) if common in INTEGERS else v for n, v in parts]
        return [self.converted(n, v, common, "usual_arithmetic") for (n, _), v in zip(parts, done, strict=True)], common

    def after(self, first: range, second: range) -> None:
        """A sequence point: what has an effect in the first, and its value, before all of the second."""
        ends = [i for i in first if self.ops[i]["kind"] in ("store", "call")] + ([first[-1]] if first else [])
        begins = [i for i in second if not any(j in second for j in self.ops[i]["inputs"])]
        self.orders += sorted({(a, b, "sequenced") for a in ends for b in begins})

    def measured(self, node: Node) -> tuple[int, range]:
        start = len(self.ops)
        value = self.value(node)
        return value, range(start, len(self.ops))

    # -- expressions -------------------------------------------------------------------------
    def value(self, node: Node) -> int:
        tag, kids, tree = node.tag, node.kids, self.tree
        if tag == "paren_expr" and kids:
            return self.value(kids[0])
        if tag == "literal":
            word = tree.word(node.lo)
            kind = literal(word)
            if node.hi - node.lo != 1 or kind not in INTEGERS:
                raise Declined("unsupported_form")
            return self.op(node, "const", word, kind)
        if tag == "binary_expr" and kids:
            value, done = self.measured(kids[0])
            for k in kids[1:]:
                value = self.binary(node, tree.kind(k.lo - 1), (kids[0], value), k, done)
                done = range(done.start, len(self.ops))
            return value
        if tag == "assign_expr" and len(kids) == 2:
            return self.assign(node, kids[0], kids[1], tree.kind(node.main))
        if tag == "cond_expr" and len(kids) == 3:
            return self.conditional(node, *kids)
        if tag == "comma_expr":
            value, done = self.measured(kids[0])
            for k in kids[1:]:
                right, more = self.measured(k)
                self.after(done, more)
                value = self.op(node, "sequence", ",", self.type_of(right), [value, right])
                done = range(done.start, len(self.ops))
            return value
        if tag == "unary_expr" and kids:
            return self.unary(node, tree.kind(node.main), kids[0])
        if tag == "postfix_expr":
            if kids[-1].tag == "inc_dec_suffix":
                base = kids[0] if len(kids) == 2 else Node("postfix_expr", node.lo, kids[-2].hi, kids[:-1], node.main)
                return self.step(node, base, tree.kind(kids[-1].main), True)
            if kids[-1].tag == "call_args":
                return self.call(node)
        if tag == "name_ref" or tag == "postfix_expr":
            return self.read(node, self.place(node))
        raise Declined("unsupported_form")

    def binary(self, node: Node, op: str, left: tuple[Node, int], right_node: Node, done: range) -> int:
        if op in ("&&", "||"):
            self.guards.append((left[1], op == "&&"))
            right, more = self.measured(right_node)
            self.guards[-1] = (left[1], op != "&&")
            bypass = self.op(node, "const", "0" if op == "&&" else "1", "int")
            self.guards.pop()
            self.after(done, more)
            self.orders.append((right, bypass, "exclusive"))
            return self.op(node, "binary", op, "int", [left[1], right, bypass], operand_type="int")
        right = self.value(right_node)
        if op in ("<<", ">>"):
            values = [self.promote(left[0], left[1]), self.promote(right_node, right)]
            kind = self.type_of(values[0])
            return self.op(node, "binary", op, kind if kind in INTEGERS else UNKNOWN, values, operand_type=kind if kind in INTEGERS else UNKNOWN)
        kinds = [self.type_of(left[1]), self.type_of(right)]
        if op in ("+", "-") and any(k.endswith("*") for k in kinds):
            both = all(k.endswith("*") for k in kinds)
            kind = DISTANCE if both and op == "-" else UNKNOWN if both else next(k for k in kinds if k.endswith("*"))
            return self.op(node, "binary", op, kind, [left[1], right], operand_type=kinds[0] if both else kind)
        values, common = self.arithmetic(node, [left, (right_node, right)])
        compare = op in COMPARING
        return self.op(node, "compare" if compare else "binary", op, "int" if compare else common, values, operand_type=common)

    def conditional(self, node: Node, test: Node, yes: Node, no: Node) -> int:
        condition, done = self.measured(test)
        arms = []
        for arm, polarity in ((yes, True), (no, False)):
            self.guards.append((condition, polarity))
            arms.append(self.measured(arm))
            self.guards.pop()
            self.after(done, arms[-1][1])
        kinds = [self.type_of(v) for v, _ in arms]
        common = kinds[0] if kinds[0] == kinds[1] and kinds[0] not in INTEGERS else usual(*kinds) if all(k in INTEGERS or k in FLOATS for k in kinds) else None
        values = []
        for (value, _), arm, polarity in zip(arms, (yes, no), (True, False), strict=True):
            self.guards.append((condition, polarity))
            value = self.promote(arm, value) if common in INTEGERS else value
            values.append(self.converted(arm, value, common or UNKNOWN, "usual_arithmetic"))
            self.guards.pop()
        self.orders.append((min(values), max(values), "exclusive"))
        return self.op(node, "select", "?:", common or UNKNOWN, [condition, *values])

    def unary(self, node: Node, op: str, operand: Node) -> int:
        if op in ("++", "--"):
            return self.step(node, operand, op, False)
        if op == "*":
            return self.read(node, self.place(node))
        if op == "&":
            place = self.place(operand)
            return self.op(node, "unary", "&", UNKNOWN if place["type"] == UNKNOWN or place["type"].endswith(ARRAY) else place["type"] + " *", place["inputs"], **{k: v for k, v in place.items() if k in ("access", "name", "declared", "member")})
        if op not in ("+", "-", "~", "!"):
            raise Declined("unsupported_form")
        value = self.value(operand)
        if op == "!":
            return self.op(node, "unary", op, "int", [value])
        value = self.promote(operand, value)
        kind = self.type_of(value)
        return self.op(node, "unary", op, kind if kind in INTEGERS or kind in FLOATS and op != "~" else UNKNOWN, [value])

    def call(self, node: Node) -> int:
        base = node.kids[0]
        name = self.tree.word(base.lo)
        if len(node.kids) != 2 or base.tag != "name_ref" or self.find(name) is not None or name in self.names.objects:
            raise Declined("unsupported_form")
        start, values = len(self.ops), [self.value(k) for k in node.kids[1].kids]
        effects = [i for i in range(start, len(self.ops)) if self.ops[i]["kind"] in ("store", "call")]
        made = self.op(node, "call", name, self.names.results.get(name, UNKNOWN), values, argument_conversions=UNKNOWN)
        self.orders += [(i, made, "sequenced") for i in effects if i not in values]
        return made

    # -- places ---------------------------------------------------------------------------------
    def place(self, node: Node) -> dict:
        """Where a value stands: its type, how it is reached, and the values that reaching it takes."""
        while node.tag == "paren_expr" and node.kids:
            node = node.kids[0]
        if node.tag == "name_ref":
            name = self.tree.word(node.lo)
            found = self.find(name)
            if found is None:
                raise Declined("unsupported_form")
            return {"type": found[0], "access": "scalar", "inputs": [], "name": name, "declared": found[1]}
        if node.tag == "unary_expr" and self.tree.kind(node.main) == "*":
            value = self.value(node.kids[0])
            return {"type": self.target(self.type_of(value)), "access": "deref", "inputs": [value]}
        if node.tag != "postfix_expr" or len(node.kids) < 2:
            raise Declined("unsupported_form")
        last = node.kids[-1]
        base = node.kids[0] if len(node.kids) == 2 else Node("postfix_expr", node.lo, node.kids[-2].hi, node.kids[:-1], node.main)
        if last.tag == "index_suffix" and len(last.kids) == 1:
            value = self.value(base)
            return {"type": self.target(self.type_of(value)), "access": "element", "inputs": [value, self.value(last.kids[0])]}
        if last.tag == "member_suffix":
            member = self.tree.word(last.main + 1)
            if self.tree.kind(last.main) == ".":
                outer = self.place(base)
                return outer | {"type": self.names.members.get(outer["type"], {}).get(member, UNKNOWN), "access": "member", "member": member}
            value = self.value(base)
            return {"type": self.names.members.get(self.target(self.type_of(value)), {}).get(member, UNKNOWN), "access": "member", "inputs": [value], "member": member}
        raise Declined("unsupported_form")

    @staticmethod
    def target(kind: str) -> str:
        return kind[:-2] if kind.endswith(" *") else UNKNOWN

    def read(self, node: Node, place: dict) -> int:
        more = {k: v for k, v in place.items() if k not in ("type", "inputs")}
        if place["type"].endswith(ARRAY):
            inner = place["type"][: -len(ARRAY)]
            return self.op(node, "unary", "decay", UNKNOWN if inner.endswith(ARRAY) else inner + " *", place["inputs"], **more)
        op = place["name"] if place["access"] == "scalar" else {"deref": "*", "element": "[]", "member": "."}[place["access"]]
        return self.op(node, "load", op, place["type"], place["inputs"], **more)

    def write(self, node: Node, place: dict, value: int, at: Node) -> int:
        if place["type"].endswith(ARRAY):
            raise Declined("unsupported_form")
        value = self.converted(at, value, place["type"], "assignment")
        return self.op(node, "store", "=", place["type"], [*place["inputs"], value], operand_type=place["type"], **{k: v for k, v in place.items() if k not in ("type", "inputs")})

    def assign(self, node: Node, target: Node, value: Node, op: str) -> int:
        if value.tag == "init_list":
            raise Declined("braced_initializer")
        place = self.place(target)
        if op == "=":
            return self.write(node, place, self.value(value), value)
        held = self.read(target, place)
        return self.write(node, place, self.binary(node, op[:-1], (target, held), value, range(0)), node)

    def step(self, node: Node, target: Node, op: str, postfix: bool) -> int:
        place = self.place(target)
        held = self.read(target, place)
        one = self.op(node, "const", "1", "int")
        kind = self.type_of(held)
        if kind.endswith("*"):
            made = self.op(node, "binary", op[0], kind, [held, one], operand_type=kind)
        else:
            values, common = self.arithmetic(node, [(target, held), (node, one)])
            made = self.op(node, "binary", op[0], common, values, operand_type=common)
        stored = self.write(node, place, made, node)
        return held if postfix else stored

    # -- statements ---------------------------------------------------------------------------------
    def root(self, node: Node, purpose: str, lower) -> None:
        """One root: all of its operations, or one unknown."""
        start, ordered, depth = len(self.ops), len(self.orders), len(self.guards)
        try:
            lower()
            self.sequence(start, ordered)
        except Declined as why:
            del self.ops[start:], self.orders[ordered:], self.guards[depth:]
            lo, hi = self.tree.tokens[node.lo].lo, self.tree.tokens[max(node.lo, node.hi - 1)].hi
            block = next((i for _, i, (a, b) in self.blocks if a <= lo and hi <= b), None)
            self.ops.append({"kind": UNKNOWN, "op": purpose, "type": UNKNOWN, "inputs": [], "block": block, "root": None, "guards": [], "lo": lo, "hi": hi, "reason": str(why)})
        self.roots += 1

    def sequence(self, start: int, ordered: int) -> None:
        """Declines effects without order; calls may come in either."""
        before: dict[int, int] = {}
        first = {}
        for a, b, kind in self.orders[ordered:]:
            if kind == "sequenced":
                first.setdefault(b, []).append(a)
        for i in range(start, len(self.ops)):
            bits = 0
            for p in [*self.ops[i]["inputs"], *(c for c, _ in self.ops[i]["guards"]), *first.get(i, ())]:
                bits |= 1 << p - start | before.get(p, 0) if p >= start else 0
            before[i] = bits
        effects = [i for i in before if self.ops[i]["kind"] in ("store", "call")]
        taken = {self.ops[i]["declared"] for i in before if self.ops[i]["op"] == "&" and "declared" in self.ops[i]}
        for b in before:
            for a in effects:
                kinds = {self.ops[a]["kind"], self.ops[b]["kind"]}
                both = b in effects
                if a == b or both and a > b or not both and not (kinds == {"store", "load"} and self.alias(self.ops[a], self.ops[b], taken)):
                    continue
                low, high = min(a, b), max(a, b)
                if before[high] >> low - start & 1 or {(c, not p) for c, p in self.ops[a]["guards"]} & {*self.ops[b]["guards"]}:
                    continue
                if kinds != {"call"}:
                    raise Declined("unsequenced_effects")
                self.orders.append((low, high, "indeterminate"))

    @staticmethod
    def alias(a: dict, b: dict, taken: set[int]) -> bool:
        """Whether two accesses may fall on one object."""
        own = [x.get("declared") for x in (a, b)]
        if None in own:
            return own == [None, None] or bool({*own} & taken)
        return own[0] == own[1]

    def statement(self, node: Node) -> None:
        tag = node.tag
        if tag in ("compound_stmt", "for_stmt"):
            self.scopes.append({})
            if tag == "for_stmt":
                self.loop(node)
            else:
                for k in node.kids:
                    self.statement(k)
            self.scopes.pop()
        elif tag == "decl":
            self.declare(node)
        elif tag == "expr_stmt" and node.kids:
            self.root(node.kids[0], "discard", lambda: self.value(node.kids[0]))
        elif tag == "return_stmt" and node.kids:
            value = node.kids[0]
            self.root(value, "return", lambda: self.op(node, "return", "return", "void", [self.converted(value, self.value(value), self.result, "assignment")]))
        elif tag == "goto_stmt" and node.kids:
            self.root(node.kids[0], "indirect_dispatch", lambda: self.branch(node.kids[0], "goto"))
        elif tag in CONTROLS:
            test = node.kids[-1] if tag == "do_while_stmt" else node.kids[0]
            for k in node.kids:
                if k is test:
                    self.root(k, "control", lambda k=k: self.branch(k, CONTROLS[tag]))
                else:
                    self.statement(k)
        elif tag not in ("case_label", "attribute", "asm"):
            for k in node.kids:
                if not k.tag.endswith("_expr") and k.tag not in ("name_ref", "literal"):
                    self.statement(k)

    def branch(self, node: Node, op: str) -> int:
        return self.op(node, "branch", op, "void", [self.value(node)])

    def loop(self, node: Node) -> None:
        for k in node.kids:
            if k.tag in ("for_init", "for_step"):
                for x in k.kids:
                    if x.tag == "decl":
                        self.declare(x)
                    elif k.tag == "for_init":
                        self.root(x, "for_clause", lambda x=x: self.value(x))
            elif k.tag == "for_cond" and k.kids:
                self.root(k.kids[0], "control", lambda k=k: self.branch(k.kids[0], "for"))
        step = node.first("for_step")
        for k in node.kids:
            if k.tag not in ("for_init", "for_cond", "for_step"):
                self.statement(k)
        for x in step.kids if step else []:
            self.root(x, "for_clause", lambda x=x: self.value(x))

    def declare(self, node: Node) -> None:
        words = self.names.words(node.kids[0]) if node.kids else []
        if "typedef" in words or "extern" in words:
            return
        last: tuple[str, str, int] | None = None
        for k in node.kids:
            if k.tag == "declarator":
                name = next((n for n in k.walk() if n.tag == "decl_name"), None)
                last = None
                if name is not None:
                    last = (*self.names.declared(words, k), name.lo) if k.first("param_list") is None else (self.tree.word(name.lo), UNKNOWN, name.lo)
                    self.scopes[-1][last[0]] = (last[1], last[2])
            elif k.tag == "initializer" and last is not None and k.kids:
                self.root(k.kids[0], "initialize", lambda k=k, last=last: self.initialize(k, k.kids[0], last))

    def initialize(self, node: Node, value: Node, to: tuple[str, str, int]) -> int:
        if value.tag == "init_list":
            raise Declined("braced_initializer")
        place = {"type": to[1], "access": "scalar", "inputs": [], "name": to[0], "declared": to[2]}
        return self.write(node, place, self.value(value), value)


def operations(tree: Tree, function: Node, names: Names | None = None) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """(operations in an order of evaluation, order pairs of operations) of a function."""
    made = Lowering(tree, function, names or Names(tree))
    return made.ops, made.orders


def _read(tree: Tree) -> tuple[list[dict], None]:
    out = []
    where, names = Positions(tree.text), Names(tree)
    for number, f in enumerate(tree.functions()):
        made = Lowering(tree, f, names)
        formal = {at for _, at in made.scopes[0].values()}
        rows = []
        for i, o in enumerate(made.ops):
            at = o.get("declared")
            token = None if at is None else tree.tokens[at]
            guards = [{"id": c, "holds": p} for c, p in o["guards"]]
            rows.append(o | {"id": i, "guards": guards, "lo": where.byte(o["lo"]), "hi": where.byte(o["hi"]), "line": where.line(o["lo"]), "declared_lo": token and where.byte(token.lo), "declared_hi": token and where.byte(token.hi), "formal": None if at is None else at in formal})
        out.append({"function_id": number, "function": tree.name_of(f), "operations": rows, "orders": [{"first": a, "second": b, "kind": k} for a, b, k in made.orders]})
    return out, None


#: Names of a text's top level count in all its functions, so texts are alike only as a whole; types hang on numbers.
_reader = c_alike.Reader(_read, whole=True, kept=2_000)


def functions(text: str) -> list[dict]:
    """Operations of each function of a text and the order pairs between them."""
    read = _reader.read(text)
    return read[0] if read else _read(Tree(text))[0]
