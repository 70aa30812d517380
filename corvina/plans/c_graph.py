"""Control-flow graphs of functions.

The walk over a function's statements keeps the edges that still dangle; placing a
node ties them to it.  Statements that control can't reach give no node, unless a
label or case in them is a target; the `syntactic` coverage places them all.
`&&`, `||` and `?:` fork inside expressions: every operand but the last is a test.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from .c_syntax import EXPRESSIONS, Node, Tree

# Kinds of nodes and edges.
NODE_KINDS = "entry exit stmt cond loop_header switch indirect_dispatch case label goto break continue return diverge".split()
EDGE_KINDS = "fall true false case default fall_through jump".split()
UNEVALUATED = {"sizeof_type", "alignof_type", "type_name", "attribute", "asm", "static_assert"}
LABEL_ROUNDS = 64


@dataclass
class Graph:
    kinds: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    internal: list[bool] = field(default_factory=list)
    edges: list[list] = field(default_factory=list)  # src, dst, kind, back
    notes: list[str] = field(default_factory=list)
    short_circuits: int = 0
    left_out: bool = False  # whether a statement that control can't reach was skipped

    def reach(self, starts: list[int], reverse: bool = False) -> list[bool]:
        """Nodes on a path from the starts, or to them."""
        near: list[list[int]] = [[] for _ in self.kinds]
        for s, d, *_ in self.edges:
            near[d if reverse else s].append(s if reverse else d)
        seen = [False] * len(self.kinds)
        stack = list(starts)
        while stack:
            n = stack.pop()
            if not seen[n]:
                seen[n] = True
                stack += near[n]
        return seen

    def live(self) -> list[bool]:
        return self.reach([0])

    def ends(self) -> list[bool]:
        """Nodes from which the exit or a diverging node is reached."""
        return self.reach([1, *(i for i, k in enumerate(self.kinds) if k == "diverge")], reverse=True)

    def metrics(self, live: list[bool] | None = None, ends: list[bool] | None = None) -> dict[str, int]:
        """Measures of the graph, from its reached nodes and those that reach an end; an edge from a reached node ends in one."""
        live, ends = live or self.live(), ends or self.ends()
        nodes, inside, out = sum(live), 0, set()
        for e in self.edges:
            if live[e[0]]:
                inside += 1
                out.add(e[0])
        kinds = Counter(self.kinds)
        return {
            "n_nodes": len(self.kinds), "n_edges": len(self.edges), "reachable_nodes": nodes, "unreachable_nodes": len(self.kinds) - nodes,
            "dead_end_nodes": sum(a and not b for a, b in zip(live, ends, strict=True)), "cyclomatic": max(1, inside - nodes + 2),
            "decision_points": inside - len(out), "back_edges": sum(e[3] for e in self.edges), "loops": len({e[1] for e in self.edges if e[3]}),
        } | {f"nodes_{k}": kinds[k] for k in NODE_KINDS}


def forks(tree: Tree, node: Node) -> str | None:
    """The operator by which an expression node forks."""
    if node.tag == "cond_expr":
        return "?"
    if node.tag == "binary_expr" and tree.kind(node.main) in ("&&", "||"):
        return tree.kind(node.main)
    return None


class Walker:
    """Builds the graph of one function; `targets` are the labels that count as reached."""

    def __init__(self, tree: Tree, function: Node, syntactic: bool, targets: set[str], nested: bool = False):
        self.tree, self.g, self.syntactic, self.targets, self.nested = tree, Graph(), syntactic, targets, nested
        self.frontier: list[tuple[int, str]] = []
        self.scopes: list[dict] = []
        self.labels: dict[str, int] = {}
        self.gotos: list[tuple[int, str]] = []
        self.dispatches: list[tuple[int, list[str]]] = []
        self.function = function
        self.on_place: list = []
        self.whole = tree.span(function)
        self.forking: dict[int, bool] = {}
        self.holding: dict[int, frozenset[str]] = {}
        self.taken = sorted({tree.word(n.lo + 1) for n in function.walk() if n.tag == "label_addr"}) if tree.has_label_addresses else []
        self.add("entry", self.whole)
        self.add("exit", self.whole)
        self.frontier = [(0, "fall")]
        body = function.first("compound_stmt")
        if body:
            self.statement(body, True)
        self.finish()

    # -- pieces of the graph ---------------------------------------------------
    def add(self, kind: str, span: tuple[int, int], internal: bool = False) -> int:
        self.g.kinds.append(kind)
        self.g.spans.append(span)
        self.g.internal.append(internal)
        return len(self.g.kinds) - 1

    def edge(self, src: int, dst: int, kind: str, back: bool = False) -> None:
        self.g.edges.append([src, dst, kind, back])

    def place(self, kind: str, span: tuple[int, int], internal: bool = False) -> int:
        n = self.add(kind, span, internal)
        for src, how in self.frontier:
            self.edge(src, n, "fall_through" if kind == "case" else how)
        self.frontier = []
        for call in self.on_place:
            call(n)
        self.on_place.clear()
        return n

    def after(self, n: int) -> None:
        self.frontier = [(n, "fall")]

    # -- expressions ---------------------------------------------------------------
    def has_fork(self, node: Node) -> bool:
        if not self.tree.may_fork:
            return False
        known = self.forking.get(id(node))
        if known is None:
            known = False
            if node.tag not in UNEVALUATED and not (node.tag == "unary_expr" and self.tree.kind(node.main) in ("sizeof", "_Alignof")):
                known = forks(self.tree, node) is not None or node.tag == "stmt_expr"
                for k in node.kids:  # a plain loop: it nests as deep as the text does
                    known = self.has_fork(k) or known
            self.forking[id(node)] = known
        return known

    def evaluate(self, node: Node | None, terminal: str | None, span: tuple[int, int], internal: bool = False) -> int | None:
        """Place what evaluating a node takes, then the terminal node (unless None)."""
        if node is not None:
            operator = forks(self.tree, node)
            if operator and len(node.kids) > 1:
                if terminal is None:
                    terminal, span, internal = "stmt", self.tree.span(node), True
                self.fork(node, operator)
            elif node.tag == "stmt_expr":
                live = True
                for k in node.kids:
                    live = self.statement(k, live)
            elif self.has_fork(node):
                for k in node.kids:
                    if self.has_fork(k):
                        self.evaluate(k, None, span)
        if terminal is None:
            return None
        n = self.place(terminal, span, internal)
        if terminal == "stmt":
            self.after(n)
        return n

    def fork(self, node: Node, operator: str) -> None:
        self.g.short_circuits += 1
        kids = node.kids
        if operator == "?":
            head = self.evaluate(kids[0], "cond", self.tree.span(kids[0]), True)
            self.frontier = [(head, "true")]
            if len(kids) > 2:
                self.evaluate(kids[1], "stmt", self.tree.span(kids[1]), True)
            joined, self.frontier = self.frontier, [(head, "false")]
            self.evaluate(kids[-1], "stmt", self.tree.span(kids[-1]), True)
            self.frontier = joined + self.frontier
            return
        go_on, leave = ("true", "false") if operator == "&&" else ("false", "true")
        left = []
        if self.nested and len(kids) > 2:  # each operator of a chain is a node of its own
            self.g.short_circuits -= 1
            inner = Node(node.tag, node.lo, kids[-2].hi, kids[:-1], node.main)
            kids = [inner, kids[-1]]
        for k in kids[:-1]:
            head = self.evaluate(k, "cond", self.tree.span(k), True)
            left.append((head, leave))
            self.frontier = [(head, go_on)]
        self.evaluate(kids[-1], "stmt", self.tree.span(kids[-1]), True)
        self.frontier = self.frontier + left[::-1] if operator == "&&" else left + self.frontier

    # -- statements -----------------------------------------------------------------
    def held(self, node: Node) -> frozenset[str]:
        """What a statement holds that is reached from elsewhere or leaves it: "case", "default", "break", "continue" and labels as ":name"."""
        known = self.holding.get(id(node))
        if known is None:
            mine: set[str] = set()
            for k in node.kids:
                mine |= self.held(k)
            if node.tag == "switch_stmt":
                mine -= {"case", "default", "break"}
            elif node.tag in ("while_stmt", "do_while_stmt", "for_stmt"):
                mine -= {"break", "continue"}
            elif node.tag == "case_label":
                mine.add("case")
            elif node.tag == "default_label":
                mine |= {"case", "default"}
            elif node.tag in ("break_stmt", "continue_stmt"):
                mine.add(node.tag[:-5])
            elif node.tag == "label_stmt":
                mine.add(":" + self.tree.word(node.lo))
            known = self.holding[id(node)] = frozenset(mine)
        return known

    def entered(self, node: Node) -> bool:
        """Whether control comes into a statement other than by falling into it."""
        held = self.held(node)
        return any(x[0] == ":" and (x[1:] in self.targets or x[1:] in self.taken) for x in held) or "case" in held and any(s["kind"] == "switch" for s in self.scopes)

    def statement(self, node: Node, live: bool) -> bool:
        """Place a statement; whether control can fall out of its end."""
        if not live and not self.syntactic and not self.entered(node):
            self.g.left_out = True
            return False
        tag, span = node.tag, self.tree.span(node)
        if tag == "compound_stmt":
            for k in node.kids:
                live = self.statement(k, live)
            return live
        if tag == "expr_stmt":
            self.evaluate(node, "stmt", span)
        elif tag == "decl":
            if any(n.tag == "initializer" or n.tag == "array_suffix" and self.runtime_bound(n) for n in node.walk()):
                self.evaluate(node, "stmt", span)
        elif tag == "if_stmt":
            return self.branch(node, span)
        elif tag in ("while_stmt", "do_while_stmt", "for_stmt"):
            return self.loop(node, span)
        elif tag == "switch_stmt":
            return self.switch(node, span)
        elif tag in ("case_label", "default_label"):
            self.case(span, tag == "default_label")
        elif tag == "label_stmt":
            n = self.place("label", span)
            self.labels.setdefault(self.tree.word(node.lo), n)
            self.after(n)
        elif tag == "goto_stmt":
            self.goto(node, span)
            return False
        elif tag in ("break_stmt", "continue_stmt"):
            self.leave(tag[:-5], span)
            return False
        elif tag == "return_stmt":
            n = self.evaluate(node, "return", span)
            self.edge(n, 1, "jump")
            return False
        elif tag in ("error", "asm"):
            self.after(self.place("stmt", span))
        elif tag in EXPRESSIONS:
            self.evaluate(node, "stmt", span)
        return True

    def runtime_bound(self, suffix: Node) -> bool:
        inner = "".join(self.tree.word(i) for i in range(suffix.lo + 1, suffix.hi - 1))
        return bool(inner) and inner != "*" and not (inner.isascii() and inner.isdigit())

    def condition(self, node: Node, span: tuple[int, int]) -> tuple[Node | None, tuple[int, int]]:
        test = node.header[0] if node.header else None
        return test, self.tree.span(test) if test else span

    def branch(self, node: Node, span: tuple[int, int]) -> bool:
        test, at = self.condition(node, span)
        head = self.evaluate(test, "cond", at)
        self.frontier = [(head, "true")]
        falls = self.statement(node.arms[0], True)
        joined, self.frontier = self.frontier, [(head, "false")]
        falls = (self.statement(node.arms[1], True) if len(node.arms) > 1 else True) or falls
        self.frontier = joined + self.frontier
        return falls

    def loop(self, node: Node, span: tuple[int, int]) -> bool:
        step = None
        if node.tag == "for_stmt":
            parts = {k.tag: k for k in node.header}
            if init := parts.get("for_init"):
                if any(k.tag == "decl" for k in init.kids):
                    for k in init.kids:
                        self.statement(k, True)
                elif init.kids:
                    self.evaluate(init, "stmt", self.tree.span(init))
            clause = parts.get("for_cond")
            test = clause.kids[0] if clause and clause.kids else None
            at = self.tree.span(test) if test else span
            step = parts.get("for_step")
            step = step if step and step.kids else None
        elif node.tag == "do_while_stmt":
            test = node.kids[1] if len(node.kids) > 1 else None
            at = self.tree.span(test) if test else span
        else:
            test, at = self.condition(node, span)
        body = node.kids[0] if node.tag == "do_while_stmt" else node.arms[0] if node.arms else None
        forking = test is not None and self.has_fork(test)
        scope = {"kind": "loop", "breaks": [], "waiting": [], "target": None}
        if node.tag == "do_while_stmt":
            header = self.add("loop_header", at)
            scope |= {"target": header, "own": False}
            first: list[int] = []
            self.on_place.append(first.append)
            self.scopes.append(scope)
            if body:
                self.statement(body, True)
            if forking:
                self.evaluate(test, None, at)
            self.scopes.pop()
            if first.append in self.on_place:
                self.on_place.remove(first.append)
            for src, how in self.frontier:
                self.edge(src, header, how)
            self.edge(header, first[0] if first else header, "true", True)
            self.frontier = [(header, "false"), *scope["breaks"]]
            return True
        header = self.place("loop_header", at)
        self.frontier = [(header, "true")]
        falls_into_step = step is not None and (body is None or self.syntactic or self.falls(body) or "continue" in self.held(body))
        if not falls_into_step:
            scope |= {"target": header, "own": True}
        self.scopes.append(scope)
        head = None
        if forking:
            head = self.evaluate(test, "cond", at)
            self.frontier = [(head, "true")]
        if body:
            self.statement(body, True)
        if head is not None:
            joined, self.frontier = self.frontier, [(head, "false")]
            self.leave("break", at)
            self.frontier = joined + self.frontier
        if falls_into_step:

            def is_step(n: int) -> None:
                scope["target"] = n
                for src in scope["waiting"]:
                    self.edge(src, n, "jump")
                scope["waiting"] = []

            self.on_place.append(is_step)
            self.evaluate(step, "stmt", self.tree.span(step))
        self.scopes.pop()
        for src, how in self.frontier:
            self.edge(src, header, how, True)
        self.frontier = [(header, "false"), *scope["breaks"]]
        return True

    def falls(self, node: Node) -> bool:
        """Whether control can fall out of a statement, without placing it."""
        tag = node.tag
        if tag in ("return_stmt", "goto_stmt", "break_stmt", "continue_stmt"):
            return False
        if tag == "compound_stmt":
            live = True
            for k in node.kids:
                if live or self.entered(k):
                    live = self.falls(k) if live or k.tag != "compound_stmt" else self.falls_from_inside(k)
            return live
        if tag == "if_stmt":
            falls = len(node.arms) < 2
            for k in node.arms:
                falls = self.falls(k) or falls
            return falls
        if tag == "switch_stmt":
            held: set[str] = set()
            for k in node.kids:
                held |= self.held(k)
            return "default" not in held or "break" in held or not node.arms or self.falls(node.arms[0])
        return True

    def falls_from_inside(self, node: Node) -> bool:
        live = False
        for k in node.kids:
            if live or self.entered(k):
                live = self.falls(k)
        return live

    def switch(self, node: Node, span: tuple[int, int]) -> bool:
        test, at = self.condition(node, span)
        head = self.evaluate(test, "switch", at)
        scope = {"kind": "switch", "breaks": [], "head": head, "default": False}
        self.scopes.append(scope)
        falls = self.statement(node.arms[0], False) if node.arms else True
        self.scopes.pop()
        if not scope["default"]:
            scope["breaks"].insert(0, (head, "default"))
        self.frontier = scope["breaks"] + self.frontier
        return falls or not scope["default"] or len(scope["breaks"]) > 0

    def case(self, span: tuple[int, int], default: bool) -> None:
        n = self.place("case", span)
        scope = next((s for s in reversed(self.scopes) if s["kind"] == "switch"), None)
        if scope is None:
            self.g.notes.append("case label outside a switch")
        else:
            self.edge(scope["head"], n, "default" if default else "case")
            scope["default"] |= default
        self.after(n)

    def leave(self, how: str, span: tuple[int, int]) -> None:
        scope = next((s for s in reversed(self.scopes) if s["kind"] == "loop" or how == "break"), None)
        n = self.place(how if scope else "diverge", span)
        if scope is None:
            self.g.notes.append(f"{how} outside a loop")
        elif how == "break":
            scope["breaks"].append((n, "jump"))
        elif scope["target"] is None:
            scope["waiting"].append(n)
        else:
            self.edge(n, scope["target"], "jump", bool(scope.get("own")))

    def goto(self, node: Node, span: tuple[int, int]) -> None:
        if node.kids or self.tree.kind(node.lo + 1) == "*":
            for k in node.kids:
                if self.has_fork(k):
                    self.evaluate(k, None, span)
            targets = self.dispatch_targets(node)
            self.dispatches.append((self.place("indirect_dispatch" if targets else "diverge", span), targets))
        else:
            self.gotos.append((self.place("goto", span), self.tree.word(node.lo + 1)))

    def dispatch_targets(self, node: Node) -> list[str]:
        """Labels a computed goto may reach: those of a table or variable that is set once and never written or passed on, else all whose address is taken."""
        target = node.kids[0] if node.kids else None
        while target is not None and target.tag == "paren_expr" and target.kids:
            target = target.kids[0]
        if target is not None and target.tag == "label_addr":
            return [self.tree.word(target.lo + 1)]
        index = None
        if target is not None and target.tag == "postfix_expr" and len(target.kids) == 2 and target.kids[1].tag == "index_suffix":
            index, target = target.kids[1].kids[:1], target.kids[0]
        if target is None or target.tag != "name_ref":
            return self.taken
        name = self.tree.word(target.lo)
        set_by: list[Node] = []
        for n in self.function.walk():
            if n.tag == "decl":
                for d, value in zip(n.kids, [*n.kids[1:], None], strict=True):
                    declared = next((x for x in d.walk() if x.tag == "decl_name"), None) if d.tag == "declarator" else None
                    if declared is not None and self.tree.word(declared.lo) == name:
                        if value is None or value.tag != "initializer":
                            return self.taken
                        set_by.append(value.kids[0])
        uses = sum(n.tag == "name_ref" and self.tree.word(n.lo) == name for n in self.function.walk())
        jumps = sum(n.tag == "goto_stmt" and any(k.tag == "name_ref" and self.tree.word(k.lo) == name for x in n.kids for k in x.walk()) for n in self.function.walk())
        if len(set_by) != 1 or uses != jumps:
            return self.taken
        values = set_by[0].kids if set_by[0].tag == "init_list" else [set_by[0]]
        if not values or any(v.tag != "label_addr" for v in values) or (set_by[0].tag == "init_list") != (index is not None):
            return self.taken
        names = [self.tree.word(v.lo + 1) for v in values]
        number = self.tree.word(index[0].lo) if index and index[0].tag == "literal" else ""
        if number.isdigit() and int(number) < len(names):
            return [names[int(number)]]
        return sorted({*names})

    def finish(self) -> None:
        for n, name in self.gotos:
            if name in self.labels:
                self.edge(n, self.labels[name], "jump")
            else:
                self.g.notes.append(f"label {name} is not defined")
                self.g.kinds[n] = "diverge"
        for n, targets in self.dispatches:
            for name in targets:
                if name in self.labels:
                    self.edge(n, self.labels[name], "jump")
        for src, how in self.frontier:
            self.edge(src, 1, how)
        self.g.edges.sort(key=lambda e: e[0])
        self.mark_cycles()

    def mark_cycles(self) -> None:
        """Edges that close a cycle of the depth-first walk are back edges too."""
        out: list[list[list]] = [[] for _ in self.g.kinds]
        for e in self.g.edges:
            out[e[0]].append(e)
        state = [0] * len(out)
        for start in range(len(out)):
            if state[start]:
                continue
            state[start] = 1
            stack = [(start, iter(out[start]))]
            while stack:
                n, rest = stack[-1]
                for e in rest:
                    if state[e[1]] == 1:
                        e[3] = True
                    elif not state[e[1]]:
                        state[e[1]] = 1
                        stack.append((e[1], iter(out[e[1]])))
                        break
                else:
                    state[n] = 2
                    stack.pop()


def graph_of(tree: Tree, function: Node, syntactic: bool = False, nested: bool = False) -> Graph:
    """The graph of a function.  Labels count once a goto that is placed names them; rounds end when none is added."""
    walker = Walker(tree, function, syntactic, set(), nested)
    if not walker.gotos:
        return walker.g
    targets: set[str] = set()
    every = {tree.word(n.lo) for n in function.walk() if n.tag == "label_stmt"}
    for turn in range(LABEL_ROUNDS):
        walker = Walker(tree, function, syntactic, targets, nested) if turn else walker
        more = targets | {name for _, name in walker.gotos if name in every}
        if more == targets:
            return walker.g
        targets = more
    return Walker(tree, function, syntactic, every, nested).g
