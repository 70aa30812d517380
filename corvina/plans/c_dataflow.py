"""Scalar data flow inside a function, and what its parameters reach.

Names are resolved by lexical scope.  A plain assignment writes and doesn't read; a
compound one and ++/-- do both; a write takes effect at the end of its right-hand
side.  Writes through elements and members of a variable are weak: they never end
what was there.  Reads and writes through pointers, and what the parser could not
read, leave an issue, and a result with issues is not complete.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from . import c_graph
from .c_measure import parameters
from .c_syntax import Node, Tree

# Kinds of definitions, and calls that touch nothing of the caller's and give back what comes in.
DEFINITION_KINDS = "parameter declaration assignment compound_assignment inc_dec address_taken memory_write".split()
WEAK = {"memory_write"}
UNREAD = {"sizeof_type", "alignof_type", "type_name", "attribute", "asm", "static_assert", "decl_specifiers", "label_addr", "member_suffix", "param_list"}
BUDGET = 16
# Compiler built-ins by number of arguments; all but constant_p give back something of their first.
BUILTINS = {"__builtin_constant_p": 1, "__builtin_expect": 2, "__builtin_expect_with_probability": 3}
BUILTINS |= {f"__builtin_bswap{bits}": 1 for bits in (16, 32, 64, 128)}
BUILTINS |= {f"__builtin_{name}{size}": 1 for name in ("popcount", "parity", "clz", "ctz", "ffs") for size in ("", "l", "ll")}


@dataclass
class Flow:
    names: list[str] = field(default_factory=list)  # of bindings; free ones after the locals
    n_locals: int = 0
    n_parameters: int = 0
    definitions: list[dict] = field(default_factory=list)
    uses: list[dict] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    issues: list[dict] = field(default_factory=list)


class Reader:
    """Collects definitions, uses and calls of one function, in token positions."""

    def __init__(self, tree: Tree, function: Node):
        self.tree, self.flow = tree, Flow()
        self.scopes: list[dict[str, int]] = [{}]
        self.free: dict[str, int] = {}
        self.pending_free: list[tuple[dict, str]] = []
        for name in parameters(tree, function):
            b = self.bind(name)
            self.flow.definitions.append({"binding": b, "kind": "parameter", "lo": function.lo, "hi": function.lo, "effect_at": -1})
        self.flow.n_parameters = len(self.flow.names)
        body = function.first("compound_stmt")
        if body:
            self.visit(body)
        self.flow.n_locals = len(self.flow.names)
        for row, name in self.pending_free:
            if name not in self.free:
                self.free[name] = len(self.flow.names)
                self.flow.names.append(name)
            row["binding"] = self.free[name]

    def bind(self, name: str) -> int:
        self.flow.names.append(name)
        if name:
            self.scopes[-1][name] = len(self.flow.names) - 1
        return len(self.flow.names) - 1

    def resolve(self, row: dict, name: str) -> None:
        for scope in reversed(self.scopes):
            if name in scope:
                row["binding"] = scope[name]
                return
        self.pending_free.append((row, name))

    def use(self, node: Node) -> None:
        row = {"binding": -1, "lo": node.lo, "hi": node.hi}
        self.resolve(row, self.tree.word(node.lo))
        self.flow.uses.append(row)

    def define(self, node: Node, kind: str, effect_at: int) -> None:
        row = {"binding": -1, "kind": kind, "lo": node.lo, "hi": node.hi, "effect_at": effect_at}
        self.resolve(row, self.tree.word(node.lo))
        self.flow.definitions.append(row)

    def issue(self, kind: str, node: Node) -> None:
        self.flow.issues.append({"kind": kind, "lo": node.lo, "hi": node.hi})

    def target(self, node: Node) -> tuple[str, Node | None]:
        """What a write to an expression hits: ("name", it), ("part", base name) or ("unknown", None)."""
        while node.tag == "paren_expr" and node.kids:
            node = node.kids[0]
        if node.tag == "name_ref":
            return "name", node
        if node.tag == "postfix_expr" and node.kids[0].tag == "name_ref" and all(k.tag == "index_suffix" or k.tag == "member_suffix" and self.tree.kind(k.main) == "." for k in node.kids[1:]):
            return "part", node.kids[0]
        return "unknown", None

    def write(self, node: Node, kind: str, effect_at: int, keeps_read: bool) -> None:
        how, name = self.target(node)
        if how == "name":
            if keeps_read:
                self.use(name)
            self.define(name, kind, effect_at)
            return
        self.visit(node)
        if how == "part":
            self.define(name, "memory_write", effect_at)
        else:
            self.issue("unknown_memory_effect", node)

    def visit(self, node: Node) -> None:
        tag = node.tag
        if tag in UNREAD or tag == "unary_expr" and self.tree.kind(node.main) in ("sizeof", "_Alignof"):
            if tag == "asm":
                self.issue("unmodeled_effect", node)
            return
        if tag == "error":
            self.issue("syntax_recovery", node)
        if tag == "name_ref":
            self.use(node)
        elif tag in ("compound_stmt", "for_stmt"):
            self.scopes.append({})
            for k in node.kids:
                self.visit(k)
            self.scopes.pop()
        elif tag == "decl":
            self.declaration(node)
        elif tag == "assign_expr":
            plain = self.tree.kind(node.main) == "="
            self.visit(node.kids[1])
            self.write(node.kids[0], "assignment" if plain else "compound_assignment", node.hi, not plain)
        elif tag == "unary_expr" and self.tree.kind(node.main) in ("++", "--"):
            self.write(node.kids[0], "inc_dec", node.hi, True)
        elif tag == "unary_expr" and self.tree.kind(node.main) == "&" and self.target(node.kids[0])[0] == "name":
            self.define(self.target(node.kids[0])[1], "address_taken", node.hi)
        elif tag == "unary_expr" and self.tree.kind(node.main) == "*":
            self.issue("unknown_memory_read", node)
            self.visit(node.kids[0])
        elif tag == "postfix_expr":
            self.postfix(node)
        else:
            for k in node.kids:
                self.visit(k)

    def declaration(self, node: Node) -> None:
        if node.kids and any(self.tree.kind(i) == "typedef" for i in range(node.kids[0].lo, node.kids[0].hi)):
            return
        last: Node | None = None
        for k in node.kids:
            if k.tag == "declarator":
                last = next((n for n in k.walk() if n.tag == "decl_name"), None)
                for n in k.walk():
                    if n.tag == "array_suffix":
                        self.bounds(n)
                if last is not None:
                    self.bind(self.tree.word(last.lo))
            elif k.tag == "initializer":
                for x in k.kids:
                    self.visit(x)
                if last is not None:
                    self.define(last, "declaration", k.hi)
            elif k.tag == "error":
                self.issue("syntax_recovery", k)

    def bounds(self, suffix: Node) -> None:
        for i in range(suffix.lo, suffix.hi):
            if self.tree.kind(i) == "identifier":
                self.use(Node("name_ref", i, i + 1))

    def postfix(self, node: Node) -> None:
        base, rest = node.kids[0], node.kids[1:]
        local = base.tag == "name_ref" and any(self.tree.word(base.lo) in s for s in self.scopes)
        direct = rest[0].tag == "call_args" and base.tag == "name_ref" and not local
        if rest[-1].tag == "inc_dec_suffix" and len(rest) == 1:
            self.write(base, "inc_dec", node.hi, True)
            return
        if rest[-1].tag == "inc_dec_suffix":
            self.visit(Node("postfix_expr", node.lo, rest[-2].hi, [base, *rest[:-1]], node.main))
            if (hit := self.target(Node("postfix_expr", node.lo, rest[-2].hi, [base, *rest[:-1]])))[0] == "part":
                self.define(hit[1], "memory_write", node.hi)
            else:
                self.issue("unknown_memory_effect", node)
            return
        if not direct:
            self.visit(base)
        for i, k in enumerate(rest):
            if k.tag == "call_args":
                row = {"callee": self.tree.word(base.lo) if direct and i == 0 else None, "lo": node.lo, "hi": k.hi, "arguments": [(x.lo, x.hi) for x in k.kids]}
                self.flow.calls.append(row)
            if k.tag == "member_suffix" and self.tree.kind(k.main) == "->":
                self.issue("unknown_memory_read", k)
            for x in k.kids:
                self.visit(x)


def analyse(tree: Tree, function: Node) -> tuple[Flow, c_graph.Graph]:
    """Flow of a function with reaching definitions solved on its graph; positions are of bytes-to-be (code points)."""
    flow = Reader(tree, function).flow
    graph = c_graph.graph_of(tree, function)

    def at(lo: int, hi: int) -> tuple[int, int]:
        return tree.tokens[lo].lo, tree.tokens[max(lo, hi - 1)].hi

    owners = sorted(((s[1] - s[0], i) for i, s in enumerate(graph.spans) if i > 1))

    def owner(lo: int, hi: int) -> int | None:
        a, b = at(lo, hi)
        return next((i for _, i in owners if graph.spans[i][0] <= a and b <= graph.spans[i][1]), None)

    for d in flow.definitions:
        d["node"] = 0 if d["kind"] == "parameter" else owner(d["lo"], d["hi"])
    for u in flow.uses:
        u["node"] = owner(u["lo"], u["hi"])
    flow.uses = [u for u in flow.uses if u["node"] is not None]
    seen: set[tuple] = set()
    flow.uses = [u for u in flow.uses if (k := (u["binding"], u["lo"], u["hi"])) not in seen and not seen.add(k)]
    solve(flow, graph)
    return flow, graph


def solve(flow: Flow, graph: c_graph.Graph) -> None:
    """Edges from definitions to the uses they reach."""
    n = len(graph.kinds)
    by_node: list[list[int]] = [[] for _ in range(n)]
    for i, d in enumerate(flow.definitions):
        if d["node"] is not None and d["kind"] != "address_taken":
            by_node[d["node"]].append(i)
    of_binding: dict[int, int] = {}
    for i, d in enumerate(flow.definitions):
        of_binding[d["binding"]] = of_binding.get(d["binding"], 0) | 1 << i
    gen, kill = [0] * n, [0] * n
    for x in range(n):
        order = sorted(by_node[x], key=lambda i: (flow.definitions[i]["effect_at"], i))
        for i in order:
            d = flow.definitions[i]
            strong = d["kind"] not in WEAK and d["binding"] < flow.n_locals
            if strong:
                kill[x] |= of_binding[d["binding"]]
                gen[x] &= ~of_binding[d["binding"]]
            gen[x] |= 1 << i
    into: list[list[int]] = [[] for _ in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for s, d, *_ in graph.edges:
        into[d].append(s)
        out[s].append(d)
    before, after = [0] * n, [0] * n
    work, queued = list(range(n - 1, -1, -1)), [True] * n
    while work:
        x = work.pop()
        queued[x] = False
        before[x] = 0
        for p in into[x]:
            before[x] |= after[p]
        new = gen[x] | before[x] & ~kill[x]
        if new != after[x]:
            after[x] = new
            for y in out[x]:
                if not queued[y]:
                    queued[y] = True
                    work.append(y)
    for k, u in enumerate(flow.uses):
        same = [i for i in by_node[u["node"]] if flow.definitions[i]["binding"] == u["binding"] and flow.definitions[i]["kind"] != "parameter"]
        done = [i for i in same if flow.definitions[i]["effect_at"] <= u["lo"]]
        strong = [i for i in done if flow.definitions[i]["kind"] not in WEAK]
        if strong:
            last = max(strong, key=lambda i: (flow.definitions[i]["effect_at"], i))
            reach = [last] + [i for i in done if flow.definitions[i]["kind"] in WEAK and flow.definitions[i]["effect_at"] > flow.definitions[last]["effect_at"]]
        else:
            bits = before[u["node"]] & of_binding.get(u["binding"], 0)
            reach = [i for i in done if flow.definitions[i]["kind"] in WEAK]
            while bits:
                i = (bits & -bits).bit_length() - 1
                reach.append(i)
                bits &= bits - 1
        flow.edges += [(i, k) for i in sorted({*reach})]


def dead_stores(flow: Flow) -> list[int]:
    """Definitions that reach no use; parameters, free names, weak writes and variables whose address is taken don't count."""
    live = {d for d, _ in flow.edges}
    taken = {d["binding"] for d in flow.definitions if d["kind"] == "address_taken"}
    return [i for i, d in enumerate(flow.definitions) if i not in live and d["kind"] not in ("parameter", "address_taken", "memory_write") and d["binding"] < flow.n_locals and d["binding"] not in taken]


def unresolved(flow: Flow) -> list[int]:
    reached = {u for _, u in flow.edges}
    return [k for k in range(len(flow.uses)) if k not in reached]


def unused(flow: Flow) -> list[int]:
    """Locals that are never read and whose address is never taken."""
    touched = {u["binding"] for u in flow.uses} | {d["binding"] for d in flow.definitions if d["kind"] == "address_taken"}
    return [b for b in range(flow.n_locals) if b not in touched]


# -- between functions ---------------------------------------------------------------


@dataclass
class Summary:
    function_id: int
    name: str
    arity: int
    complete: bool
    returns: set[int] = field(default_factory=set)
    transfers: set[tuple[int, str, int]] = field(default_factory=set)  # parameter, callee, argument


def summaries(tree: Tree, policy: str = "unknown") -> list[Summary]:
    """What each parameter may reach: the function's result and arguments of direct calls; rounds end when nothing changes.

    policy for functions that the text doesn't define: unknown (incomplete),
    taint_return (the result may carry any argument), assume_pure_no_flow.
    """
    if policy not in ("unknown", "taint_return", "assume_pure_no_flow"):
        raise ValueError(f"unknown policy {policy!r}")
    functions = tree.functions()
    names = [tree.name_of(f) for f in functions]
    by_name = {n: i for i, n in enumerate(names) if names.count(n) == 1}
    flows = [analyse(tree, f) for f in functions]
    recovered = [any(n.tag == "error" for n in f.walk()) for f in functions]
    made = [Summary(i, names[i], flows[i][0].n_parameters, False) for i in range(len(functions))]
    local = [not flows[i][0].issues and not recovered[i] and all(c["callee"] for c in flows[i][0].calls) for i in range(len(functions))]
    prepared = [_prepare(f, flow, graph) for f, (flow, graph) in zip(functions, flows, strict=True)]
    # only functions that call another of the text can change after the first round
    inside = [i for i in range(len(functions)) if any(c["callee"] in by_name for c in flows[i][0].calls)]
    for turn in range(BUDGET * max(1, len(functions))):
        before = [(set(m.returns), set(m.transfers)) for m in made]
        for i in inside if turn else range(len(functions)):
            _trace(flows[i][0], flows[i][1], prepared[i], made[i], made, by_name, policy)
        if not inside or before == [(m.returns, m.transfers) for m in made]:
            break
    # complete: nothing unknown in the function nor in anything it calls (greatest fixpoint)
    complete = list(local)
    while True:
        again = [
            complete[i]
            and all(
                c["callee"] in by_name and complete[by_name[c["callee"]]] and len(c["arguments"]) == made[by_name[c["callee"]]].arity
                or c["callee"] not in names and (policy == "assume_pure_no_flow" or BUILTINS.get(c["callee"]) == len(c["arguments"]))
                for c in flows[i][0].calls
            )
            for i in range(len(functions))
        ]
        if again == complete:
            break
        complete = again
    for m, c in zip(made, complete, strict=True):
        m.complete = c
    return made


def alone(tree: Tree, number: int, function: Node, policy: str) -> tuple[Summary, list[str]]:
    """A function's summary if the text defines nothing that it calls, and names of what it calls."""
    flow, graph = analyse(tree, function)
    mine = Summary(number, tree.name_of(function), flow.n_parameters, False)
    _trace(flow, graph, _prepare(function, flow, graph), mine, [mine], {}, policy)
    known = all(c["callee"] and (policy == "assume_pure_no_flow" or BUILTINS.get(c["callee"]) == len(c["arguments"])) for c in flow.calls)
    mine.complete = known and not flow.issues and not any(n.tag == "error" for n in function.walk())
    return mine, sorted({c["callee"] for c in flow.calls if c["callee"]})


def _prepare(function: Node, flow: Flow, graph: c_graph.Graph) -> dict:
    """What tracing needs of a function whatever its callees: nodes under each decision, uses of each definition, definitions on each node, returns."""
    from . import c_depend

    n = len(graph.kinds)
    controls: dict[int, set[int]] = {}
    if any(k in ("cond", "loop_header", "switch") for k in graph.kinds):
        ipdom, _ = c_depend.post_dominators(n, [(e[0], e[1]) for e in graph.edges])
        for on, node, _ in c_depend.control_dependence(n, [(e[0], e[1], e[2]) for e in graph.edges], ipdom):
            controls.setdefault(on, set()).add(node)
    reached: dict[int, list[int]] = {}
    for d, u in flow.edges:
        reached.setdefault(d, []).append(u)
    written: dict[int, list[int]] = {}
    for i, d in enumerate(flow.definitions):
        if d["node"] is not None and d["kind"] not in ("parameter", "address_taken"):
            written.setdefault(d["node"], []).append(i)
    return {"controls": controls, "reached": reached, "written": written, "returns": [x for x in function.walk() if x.tag == "return_stmt"]}


def _trace(flow: Flow, graph: c_graph.Graph, prepared: dict, mine: Summary, made: list[Summary], by_name: dict[str, int], policy: str) -> None:
    controls, reached, written, returns = (prepared[k] for k in ("controls", "reached", "written", "returns"))

    def carries(call: dict, argument: int) -> bool:
        target = by_name.get(call["callee"])
        if target is None and BUILTINS.get(call["callee"]) == len(call["arguments"]):
            return argument == 0 and call["callee"] != "__builtin_constant_p"
        if target is None:
            return policy == "taint_return"
        return argument in made[target].returns

    def filtered(u: dict, top: tuple[int, int]) -> bool:
        """Whether a use's value gets through all calls between it and the expression `top`."""
        for c in flow.calls:
            if top[0] <= c["lo"] and c["hi"] <= top[1]:
                for k, (a, b) in enumerate(c["arguments"]):
                    if a <= u["lo"] and u["hi"] <= b and not carries(c, k):
                        return False
        return True

    for p in range(flow.n_parameters):
        tainted_definitions, tainted_uses = {p}, set()
        tainted_nodes: set[int] = set()
        work = [p]
        while work:
            for k in reached.get(work.pop(), []):
                if k in tainted_uses:
                    continue
                tainted_uses.add(k)
                u = flow.uses[k]
                for i in written.get(u["node"], []):
                    d = flow.definitions[i]
                    # the use stands in what the definition writes
                    if i not in tainted_definitions and d["lo"] <= u["lo"] and u["hi"] <= d["effect_at"] and filtered(u, (d["lo"], d["effect_at"])):
                        tainted_definitions.add(i)
                        work.append(i)
                if graph.kinds[u["node"]] in ("cond", "loop_header", "switch"):
                    for node in controls.get(u["node"], ()):
                        if node not in tainted_nodes:
                            tainted_nodes.add(node)
                            for i in written.get(node, []):
                                if i not in tainted_definitions:
                                    tainted_definitions.add(i)
                                    work.append(i)
        for k in tainted_uses:
            u = flow.uses[k]
            if any(r.lo <= u["lo"] and u["hi"] <= r.hi and filtered(u, (r.lo, r.hi)) for r in returns):
                mine.returns.add(p)
            for c in flow.calls:
                for a, (lo, hi) in enumerate(c["arguments"]):
                    if c["callee"] and lo <= u["lo"] and u["hi"] <= hi and filtered(u, (lo, hi)):
                        mine.transfers.add((p, c["callee"], a))
        if any(graph.kinds[x] == "return" for x in tainted_nodes):
            mine.returns.add(p)


def reaches(made: list[Summary], source: str, parameter: int, sink: str) -> dict:
    """Whether a parameter of `source` may come to `sink`: verdict yes, unknown or no, a path, what was explored, and why it is uncertain."""
    named: dict[str, list[Summary]] = {}
    for m in made:
        named.setdefault(m.name, []).append(m)
    uncertain: set[str] = set()
    if source not in named:
        return {"verdict": "unknown", "path": [], "explored": 0, "uncertainty": ["missing_source"]}
    if len(named[source]) > 1:
        return {"verdict": "unknown", "path": [], "explored": 0, "uncertainty": ["ambiguous_source"]}
    start = named[source][0]
    if parameter >= start.arity:
        return {"verdict": "no" if start.complete else "unknown", "path": [], "explored": 0, "uncertainty": [] if start.complete else ["incomplete_arity"]}
    stack = [[(start.name, parameter)]]
    seen: set[tuple[str, int]] = set()
    while stack:
        path = stack.pop()
        name, p = path[-1]
        if name == sink:
            return {"verdict": "yes", "path": path, "explored": len(seen) + 1, "uncertainty": sorted(uncertain)}
        if (name, p) in seen:
            continue
        seen.add((name, p))
        here = named.get(name, [])
        if name in BUILTINS and not here:
            continue
        if len(here) != 1:
            uncertain.add("ambiguous_callee" if here else "missing_callee")
            continue
        if not here[0].complete:
            uncertain.add("incomplete_summary")
        for q, callee, argument in sorted(here[0].transfers, reverse=True):
            if q == p:
                stack.append([*path, (callee, argument)])
    return {"verdict": "unknown" if uncertain else "no", "path": [], "explored": len(seen), "uncertainty": sorted(uncertain)}


def reaches_by_id(made: list[Summary], source: int, parameter: int, sink: int) -> dict:
    """`reaches` for functions given by number, so that names defined twice can be told apart at both ends."""
    by_id = {m.function_id: m for m in made}
    if source not in by_id or sink not in by_id:
        return {"verdict": "unknown", "path": [], "explored": 0, "uncertainty": ["missing_source" if source not in by_id else "missing_sink"]}
    start = by_id[source]
    if parameter >= start.arity:
        return {"verdict": "no" if start.complete else "unknown", "path": [], "explored": 0, "uncertainty": [] if start.complete else ["incomplete_arity"]}
    named: dict[str, list[Summary]] = {}
    for m in made:
        named.setdefault(m.name, []).append(m)
    uncertain: set[str] = set()
    seen: set[tuple[int, int]] = set()
    stack = [[(source, parameter)]]
    while stack:
        path = stack.pop()
        number, p = path[-1]
        if number == sink:
            return {"verdict": "yes", "path": path, "explored": len(seen) + 1, "uncertainty": sorted(uncertain)}
        if (number, p) in seen:
            continue
        seen.add((number, p))
        if not by_id[number].complete:
            uncertain.add("incomplete_summary")
        for q, callee, argument in sorted(by_id[number].transfers, reverse=True):
            if q != p or callee in BUILTINS and callee not in named:
                continue
            found = named.get(callee, [])
            if len(found) == 1:
                stack.append([*path, (found[0].function_id, argument)])
            else:
                uncertain.add("ambiguous_callee" if found else "missing_callee")
    return {"verdict": "unknown" if uncertain else "no", "path": [], "explored": len(seen), "uncertainty": sorted(uncertain)}
