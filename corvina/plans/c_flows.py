"""Memory of one text's functions, solved where the text is read: what `operators.memory` joins over the regions of all functions, for those of a source alone.

Functions meet only within their source, so nothing has to leave it.  Rows are tuples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

from . import c_alike, c_memory, c_targets
from .c_syntax import Tree
from .c_targets import REPEATED, UNKNOWN

PART, DEEP = re.compile(r"\.[^.\[]+|\[\*\]\+?"), re.compile(r"\.[^.\[]+|\[\*\]")
ROOT, FORMAL = re.compile(r"[*%<]?[^.\[+]*"), re.compile(r"\*[^.\[+]*")


def targets(function: dict) -> list[tuple[str, str]]:
    """(place, target) of a function."""
    said = tuple(dict.fromkeys((s["op"], s["dst"], s["src"], s["path"]) for s in function["steps"]))
    return c_targets.solved(said, frozenset(function["locals"]), tuple(function["unions"]))


def accesses(function: dict, held: dict[str, list[str]]) -> list[dict]:
    """Reads and writes by region."""
    out = []
    for s in function["steps"]:
        if s["op"] not in ("read", "write") or s["node"] is None:
            continue
        row = {k: s[k] for k in ("ord", "op", "node", "at")}
        if s["dst"] is not None:
            out.append(row | {"region": s["dst"], "strong": c_memory.ELEMENTS not in s["dst"]})
            continue
        regions = [c_targets.below(t, s["path"]) for t in held.get(s["src"]) or [UNKNOWN]]
        out += [row | {"region": r, "strong": len(regions) == 1 and r != UNKNOWN and c_memory.ELEMENTS not in r and REPEATED not in r} for r in regions]
    return out


def overlaps(regions: set[str], unions: list[str]) -> list[dict]:
    """Pairs of different regions that may share memory, each once."""
    named = {}
    for r in regions - {UNKNOWN}:
        root, parts = ROOT.match(r)[0], PART.findall(r)
        named[r] = (root, parts, [root + "".join(parts[:n]) for n in range(max(len(parts), 1))])
    best: dict[tuple[str, str], tuple] = {}

    def found(region: str, other: str, why: str) -> None:
        pair, ranked = (min(region, other), max(region, other)), (why != "containment", region < other, why, region, other)
        best[pair] = min(best.get(pair, ranked), ranked)

    of_union: dict[str, list[tuple[str, str]]] = {}
    wanted, below = {u: len(DEEP.findall(u)) for u in unions}, {}
    for r, (_, parts, above) in named.items():
        if parts:
            for other in above:
                if other in named:
                    found(r, other, "containment")
                if other in wanted:
                    of_union.setdefault(other, []).append((r, parts[wanted[other]]))
        for stem in {x.replace("+", "") for x in (*above, r)}:
            below.setdefault(stem, []).append(r)
    for members in of_union.values():
        for (a, m), (b, o) in product(members, members):
            if m != o and a < b:
                found(a, b, "union")
    formal = [(r, root) for r, (root, _, _) in named.items() if root[:1] == "*"]
    for (a, x), (b, y) in product(formal, formal):
        if x != y and a < b:
            found(a, b, "parameters")
    for r in named:
        if REPEATED not in r:
            continue
        stem = r[: r.index(REPEATED)]
        for other in below.get(stem, ()):
            folded = REPEATED in other
            if other != r and not (folded and r > other):
                found(r, other, "containment" if not folded and other == stem else "repetition")
    return [{"region": r, "other": o, "why": w} for _, _, w, r, o in best.values()]


def effects(functions: list[dict], held: list[dict[str, list[str]]], own: list[list[dict]]) -> list[set[tuple[int, str]]]:
    """(parameter, read or write) of each function: what it does to what its parameters refer to, its own callees included."""
    known: list[set[tuple[int, str]]] = []
    passed: list[tuple[int, int, str, int]] = []
    for k, (f, places, rows) in enumerate(zip(functions, held, own, strict=True)):
        formal: dict[str, set[int]] = {}
        for s in f["steps"]:
            if s["op"] == "parameter":
                formal.setdefault(s["src"], set()).add(s["number"])
        known.append({(n, a["op"]) for a in rows if (m := FORMAL.match(a["region"])) for n in formal.get(m[0], ())})
        for s in f["steps"]:
            if s["op"] == "argument" and s["callee"] is not None:
                roots = {m[0] for t in places.get(s["dst"], ()) if (m := FORMAL.match(t))}
                passed += [(k, n, s["callee"], s["number"]) for r in roots for n in formal.get(r, ())]
    named: dict[str, list[int]] = {}
    for k, f in enumerate(functions):
        named.setdefault(f["function"], []).append(k)
    more = bool(passed)
    while more:  # ends: there are no more effects than parameters, twice
        more = False
        for k, n, callee, number in passed:
            new = {(n, op) for j in named.get(callee, ()) for m, op in known[j] if m == number} - known[k]
            known[k] |= new
            more |= bool(new)
    return known


def reached(n_nodes: int, edges: list[dict], accesses: list[dict], overlaps: list[dict]) -> Iterator[dict]:
    """Writes that reach reads in one function."""
    writes = sorted((a for a in accesses if a["op"] == "write"), key=lambda a: (a["at"], a["ord"], a["region"]))
    why: dict[str, dict[str, str]] = {}
    ends: dict[str, set[str]] = {}  # what a strong write of a region ends besides its own
    for o in overlaps:
        why.setdefault(o["region"], {})[o["other"]] = why.setdefault(o["other"], {})[o["region"]] = o["why"]
        if o["why"] == "containment":
            ends.setdefault(o["other"], set()).add(o["region"])
        elif o["why"] == "union":
            ends.setdefault(o["region"], set()).add(o["other"])
            ends.setdefault(o["other"], set()).add(o["region"])
    of_region: dict[str, int] = {}
    for i, w in enumerate(writes):
        of_region[w["region"]] = of_region.get(w["region"], 0) | 1 << i
    kills = [sum(of_region.get(r, 0) for r in {w["region"], *ends.get(w["region"], ())}) if w["strong"] else 0 for w in writes]
    at_node: dict[int, list[int]] = {}
    for i, w in enumerate(writes):
        at_node.setdefault(w["node"], []).append(i)
    into: list[list[int]] = [[] for _ in range(n_nodes)]
    out: list[list[int]] = [[] for _ in range(n_nodes)]
    for e in edges:
        into[e["dst"]].append(e["src"])
        out[e["src"]].append(e["dst"])
    after, work = [0] * n_nodes, list(range(n_nodes - 1, -1, -1))
    waiting = set(work)

    def before(x: int) -> int:
        bits = 0
        for p in into[x]:
            bits |= after[p]
        return bits

    while work:
        x = work.pop()
        waiting.discard(x)
        bits = before(x)
        for i in at_node.get(x, ()):
            bits = bits & ~kills[i] | 1 << i
        if bits != after[x]:
            after[x] = bits
            for y in out[x]:
                if y not in waiting:
                    waiting.add(y)
                    work.append(y)
    for a in accesses:
        if a["op"] != "read":
            continue
        bits = before(a["node"])
        for i in at_node.get(a["node"], ()):
            if writes[i]["at"] <= a["at"]:
                bits = bits & ~kills[i] | 1 << i
        near = why.get(a["region"], {})
        while bits:
            i = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            region = writes[i]["region"]
            via = "same" if region == a["region"] != UNKNOWN else "unknown" if UNKNOWN in (region, a["region"]) else near.get(region)
            if via:
                yield {"write": writes[i]["ord"], "read": a["ord"], "region": region, "read_region": a["region"], "via": via}


def flows(functions: list[dict]) -> Iterator[list[dict]]:
    """Of each function, which of its writes reach which of its reads through memory, with the nodes they stand in."""
    pairs = [targets(f) for f in functions]
    held = [_places(p) for p in pairs]
    own = [accesses(f, h) for f, h in zip(functions, held, strict=True)]
    once = Counter(f["function"] for f in functions)
    done: dict[str, set[tuple[int, str]]] = {}
    for f, does in zip(functions, effects(functions, held, own), strict=True):
        done.setdefault(f["function"], set()).update(does)
    for f, places, told, rows in zip(functions, held, pairs, own, strict=True):
        called = []
        for s in f["steps"]:
            if s["op"] == "argument" and s["node"] is not None:
                ops = [op for op in ("read", "write") if once[s["callee"]] != 1 or (s["number"], op) in done[s["callee"]]]
                # a call reads before it writes
                called += [{"ord": s["ord"], "op": op, "node": s["node"], "at": s["at"] - (op == "read"), "region": t, "strong": False} for op in ops for t in places.get(s["dst"], ())]
        near = overlaps({a["region"] for a in rows} | {t for _, t in told}, f["unions"])
        node = {s["ord"]: s["node"] for s in f["steps"]}
        yield [x | {"write_node": node[x["write"]], "read_node": node[x["read"]]} for x in reached(f["n_nodes"], f["edges"], rows + called, near)]


def _places(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    held: dict[str, list[str]] = {}
    for place, target in pairs:
        held.setdefault(place, []).append(target)
    return held


def _targets(functions: list[dict]) -> list[list[tuple]]:
    return [targets(f) for f in functions]


def _effects(functions: list[dict]) -> list[list[tuple]]:
    held = [_places(targets(f)) for f in functions]
    return [sorted(x) for x in effects(functions, held, [accesses(f, h) for f, h in zip(functions, held, strict=True)])]


def _flows(functions: list[dict]) -> list[list[tuple]]:
    return [[tuple(x[c] for c in ("write", "read", "region", "read_region", "via")) for x in found] for found in flows(functions)]


def _counted(functions: list[dict]) -> list[list[tuple]]:
    return [[(*k, n) for k, n in Counter(tuple(x[c] for c in ("write_node", "read_node", "region", "read_region", "via")) for x in found).items()] for found in flows(functions)]


SOLVERS = {"targets": _targets, "effects": _effects, "flows": _flows, "counted": _counted}
#: Texts that one worker remembers, by what is solved for them.
KEPT = 8_000


def solved(text: str, what: str) -> list[tuple[str, list[tuple]]]:
    """Name of each function of a text and what is solved for it; texts that are alike get the same lists."""

    def make(tree: Tree) -> tuple[list[dict], None]:
        functions = c_memory._read(tree)[0]
        # names of places that hold numbers are compared by their letters, so they can't be told again
        if c_alike.MARK in tree.text and any(c_alike.MARK in x for f in functions for s in f["steps"] for x in (s["dst"], s["src"], s["path"]) if x):
            return [{"function": f["function"], "found": None} for f in functions], None
        return [{"function": f["function"], "found": x} for f, x in zip(functions, SOLVERS[what](functions), strict=True)], None

    # steps number a text's tokens, so texts are alike only as a whole
    read = c_alike.shared(("memory", what), make, numbers=True, whole=True, kept=KEPT, early=True).read(text)
    rows = read[0] if read else make(Tree(text))[0]
    if any(r["found"] is None for r in rows):
        functions = c_memory._read(Tree(text))[0]
        rows = [{"function": f["function"], "found": x} for f, x in zip(functions, SOLVERS[what](functions), strict=True)]
    return [(r["function"], r["found"]) for r in rows]
