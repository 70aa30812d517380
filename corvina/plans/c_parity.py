"""Block graphs for comparisons of structure across tools.

From the graph of all statements: operators of chains stand apart, operands that
compute nothing and jumps go (what came to them goes on to what followed them),
constant loops lose the edge out, and straight chains become one block.
"""

from __future__ import annotations

import re

from . import c_depend, c_graph
from .c_syntax import Node, Tree

# Jumps that are no steps of their own.
JUMPS = {"goto", "break", "continue", "label", "case"}
BARE = re.compile(r"""[\s(]*(?:[^\W\d]\w*|\.?\d[\w.]*|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")[\s)]*\Z""")
NUMBER = re.compile(r"[\s(]*(0[xX][\da-fA-F]+|\d+)[uUlL]*[\s)]*\Z")


def _remove(edges: dict[tuple[int, int], None], n: int) -> None:
    """Take a node out: its predecessors get its successors, one edge for each pair."""
    before, after = [a for a, b in edges if b == n and a != n], [b for a, b in edges if a == n and b != n]
    for pair in [e for e in edges if n in e]:
        del edges[pair]
    for a in before:
        for b in after:
            edges[a, b] = None


def blocks(tree: Tree, function: Node) -> dict:
    """`nodes` (block numbers), `edges`, `entry`, `exit`, `degenerate` of a function."""
    g = c_graph.graph_of(tree, function, syntactic=True, nested=True)
    text = [tree.text[a:b] for a, b in g.spans]
    edges: dict[tuple[int, int], None] = {}
    for s, d, kind, _ in g.edges:
        number = NUMBER.match(text[s])
        endless = g.kinds[s] == "loop_header" and number and int(number[1], 16 if number[1][:2] in ("0x", "0X") else 10)
        if not (endless and kind == "false"):
            edges[s, d] = None
    gone = set()
    for n, kind in enumerate(g.kinds):
        empty_for = kind == "loop_header" and text[n].lstrip().startswith("for")
        literal_test = kind == "cond" and not g.internal[n] and NUMBER.match(text[n])
        if n > 1 and (kind in JUMPS or g.internal[n] and kind in ("stmt", "cond") and BARE.match(text[n]) or empty_for or literal_test):
            _remove(edges, n)
            gone.add(n)
    kept = [n for n in range(len(g.kinds)) if n not in gone]
    place = {n: i for i, n in enumerate(kept)}
    pairs = [(place[a], place[b]) for a, b in edges]
    block = c_depend.chains(len(kept), pairs, anchors=set())
    ties = dict.fromkeys((block[a], block[b]) for a, b in pairs if block[a] != block[b] or a == b or (a, b) not in _inner(pairs, block))
    members: dict[int, list[int]] = {}
    for i, b in enumerate(block):
        members.setdefault(b, []).append(i)
    exits = {b for b, m in members.items() if place[1] in m}
    alone = [b for b in exits if members[b] == [place[1]] and b != block[place[0]]]
    for b in alone:  # a function's end that holds nothing is no block; what leads to it ends the function
        ends = {s for s, d in ties if d == b}
        ties = {e: None for e in ties if b not in e}
        del members[b]
        exits = (exits - {b}) | ends
    order = {b: i for i, b in enumerate(sorted(members))}
    return {
        "nodes": list(order.values()), "edges": sorted((order[a], order[b]) for a, b in ties), "entry": [order[block[place[0]]]], "exit": sorted(order[b] for b in exits if b in order),
        "degenerate": len(order) <= 1,
    }


def _inner(pairs: list[tuple[int, int]], block: list[int]) -> set[tuple[int, int]]:
    """Edges along a chain; an edge from its end to its beginning is a loop and stays."""
    first: dict[int, int] = {}
    into: dict[int, int] = {}
    for a, b in pairs:
        if block[a] == block[b]:
            into[b] = into.get(b, 0) + 1
    for i, b in enumerate(block):
        if b not in first and (i not in into or i == b):
            first[b] = i
    return {(a, b) for a, b in pairs if block[a] == block[b] and b != first.get(block[b], block[b])}
