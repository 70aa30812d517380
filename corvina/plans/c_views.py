"""Operations of functions written as graphs in one format, where the text is read.

What is written for texts that are alike (`plans.c_alike`) differs in places, names and
stated facts alone, so it is written once with slots for these, which each text fills.
"""

from __future__ import annotations

from . import c_alike, c_lower, c_loops
from .c_measure import parameters
from .c_syntax import Tree
from .c_tokens import Positions

#: What stands around a slot; a word that holds it fills one.
SLOT = "\0"
XML = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})
SAFE = str.maketrans({'"': "#quot;", "\n": " "})
QUOTED = str.maketrans({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"})
Attributes = list[tuple[str, str]]
Nodes, Edges = list[tuple[int, str, Attributes]], list[tuple[int, int, str, Attributes]]


def dot(name: str, nodes: Nodes, edges: Edges) -> str:
    def pair(k: str, v: str) -> str:
        return f'{k}="{v.translate(QUOTED)}"'

    out = [f'digraph "{name}" {{\n  node [shape=box, fontname=monospace, fontsize=10];\n']
    out += [f"  n{i} [{', '.join(pair(*a) for a in [('label', label), *attrs])}];\n" for i, label, attrs in nodes]
    for s, d, label, attrs in edges:
        inner = ", ".join(pair(*a) for a in [*([("label", label)] if label else []), *attrs])
        out.append(f"  n{s} -> n{d}{f' [{inner}]' if inner else ''};\n")
    return "".join([*out, "}\n"])


def graphml(name: str, nodes: Nodes, edges: Edges) -> str:
    def keys(items: list) -> dict[str, int]:
        return {k: i for i, k in enumerate(dict.fromkeys(["label", *(k for x in items for k, _ in x[-1])]))}

    def declared(found: dict[str, int], prefix: str, kind: str) -> list[str]:
        return [f'  <key id="{prefix}{i}" for="{kind}" attr.name="{k.translate(XML)}" attr.type="string"/>\n' for k, i in found.items()]

    def data(found: dict[str, int], prefix: str, label: str, attrs: Attributes) -> str:
        return "".join(f'      <data key="{prefix}{found[k]}">{v.translate(XML)}</data>\n' for k, v in [("label", label), *attrs])

    of_nodes, of_edges = keys(nodes), keys(edges)
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n', *declared(of_nodes, "nd", "node"), *declared(of_edges, "ed", "edge")]
    out.append(f'  <graph id="{name}" edgedefault="directed">\n')
    out += [f'    <node id="n{i}">\n{data(of_nodes, "nd", label, attrs)}    </node>\n' for i, label, attrs in nodes]
    out += [f'    <edge id="e{i}" source="n{s}" target="n{d}">\n{data(of_edges, "ed", label, attrs)}    </edge>\n' for i, (s, d, label, attrs) in enumerate(edges)]
    return "".join([*out, "  </graph>\n</graphml>\n"])


def node_link(name: str, nodes: Nodes, edges: Edges) -> str:
    def flat(first: list[str], attrs: Attributes) -> str:
        return "{" + ", ".join(sorted([*first, *(f'"{k}": "{v.translate(QUOTED)}"' for k, v in attrs)])) + "}"

    ties = ", ".join(flat([f'"label": "{label.translate(QUOTED)}"', f'"source": {s}', f'"target": {d}'], attrs) for s, d, label, attrs in edges)
    body = ", ".join(flat([f'"id": {i}', f'"label": "{label.translate(QUOTED)}"'], attrs) for i, label, attrs in nodes)
    return f'{{"directed": true, "edges": [{ties}], "graph": {{"name": "{name}"}}, "multigraph": true, "nodes": [{body}]}}'


def mermaid(name: str, nodes: Nodes, edges: Edges) -> str:
    body = [f'  n{i}["{label.translate(SAFE)}"]\n' for i, label, _ in nodes]
    ties = [f"  n{s} --> n{d}\n" if not label else f"  n{s} -->|{label.translate(SAFE)}| n{d}\n" for s, d, label, _ in edges]
    return "".join(["flowchart TD\n", *body, *ties])


WRITERS = {"dot": (dot, QUOTED), "graphml": (graphml, XML), "json": (node_link, QUOTED), "mermaid": (mermaid, SAFE)}
#: Attributes of operations that some have.
SOME = ("operand_type", "from", "to", "access", "name", "member", "argument_conversions", "reason")


class View:
    """A function's operations with slots, and what was written of it, by format and parameters that have facts."""

    __slots__ = ("nodes", "edges", "written")

    def __init__(self, nodes: list, edges: Edges):
        self.nodes, self.edges, self.written = nodes, edges, {}

    def parts(self, fmt: str, stated: tuple[bool, ...]) -> tuple[list[str], list[tuple[int, str, int]]]:
        key = (fmt, stated)
        if key not in self.written:
            nodes = [(i, label, attrs + ([("facts", f"{SLOT}facts {n}{SLOT}"), ("facts_source", f"{SLOT}sources {n}{SLOT}")] if n is not None and stated[n] else [])) for i, label, attrs, n in self.nodes]
            parts = WRITERS[fmt][0](f"{SLOT}name 0{SLOT}", nodes, self.edges).split(SLOT)
            self.written[key] = parts, [(k, *parts[k].split()) for k in range(1, len(parts), 2)]
            self.written[key] = parts, [(k, what, int(n)) for k, what, n in self.written[key][1]]
        return self.written[key]


def _made(tree: Tree) -> tuple[list[dict], None]:
    """Views of a text's functions with what fills their slots: offsets, lines, words; the span's offsets are the first, names of parameters are the first words."""
    out = []
    for function, f in zip(c_lower._read(tree)[0], tree.functions(), strict=True):
        span = tree.span(f)
        where = Positions(tree.text)
        slots: dict[str, dict] = {"offset": {x: i for i, x in enumerate(dict.fromkeys(map(where.byte, span)))}, "line": {}, "word": {}}
        formal = list(dict.fromkeys(filter(None, parameters(tree, f))))
        for p in formal:
            slots["word"][p] = len(slots["word"])

        def slot(what: str, value, slots: dict[str, dict] = slots) -> str:
            return f"{SLOT}{what} {slots[what].setdefault(value, len(slots[what]))}{SLOT}"

        def word(value, slot=slot) -> str | None:
            return None if value is None else slot("word", value) if c_alike.MARK in value or SLOT in value else value

        nodes, edges = [], []
        for o in function["operations"]:
            attrs = [("kind", o["kind"]), ("op", word(o["op"])), ("type", word(o["type"])), ("inputs", ",".join(map(str, o["inputs"]))), ("block", "" if o["block"] is None else str(o["block"])), ("root", "" if o["root"] is None else str(o["root"]))]
            attrs += [("guarded_by", ",".join(f"{g['id']}:{'true' if g['holds'] else 'false'}" for g in o["guards"])), ("span", f"{slot('offset', o['lo'])}:{slot('offset', o['hi'])}"), ("line", slot("line", o["line"]))]
            attrs += [(c, word(o.get(c))) for c in SOME]
            if o["declared_lo"] is not None:
                attrs.append(("declared", f"{slot('offset', o['declared_lo'])}:{slot('offset', o['declared_hi'])}"))
            stated = formal.index(o["name"]) if o["kind"] in ("load", "store") and o["formal"] and o.get("name") in formal else None
            nodes.append((o["id"], " ".join(filter(None, [o["kind"], word(o["op"])])), [a for a in attrs if a[1] is not None], stated))
            edges += [(v, o["id"], "", [("index", str(i))]) for i, v in enumerate(o["inputs"])]
        row = {"function_id": function["function_id"], "function": function["function"], "formal": formal, "view": View(nodes, edges), "word": list(slots["word"])}
        out.append(row | {"lo": list(slots["offset"]), "line": list(slots["line"]), "begins": span[0], "ends": span[1]})
    return out, None


#: As in `c_lower`: texts are alike only as a whole.
_reader = c_alike.Reader(_made, whole=True, kept=2_000, early=True)


def rendered(text: str, fmt: str, marker: str) -> list[tuple[str, str]]:
    """(name, graph as text) of each function of a text, with what comments state of the parameters that its operations read and set."""
    read = _reader.read(text)
    if read:
        rows = read[0]
        # texts that are told again hold no literals with strokes: a comment is one wherever it stands
        stated = c_loops.stated(text, [((r["begins"], r["ends"]), r["function"], set(r["formal"])) for r in rows], lambda at: False, None, marker)[0] if "//" in text else []
    else:
        tree = Tree(text)
        rows, stated = _made(tree)[0], c_loops.facts(tree, None, marker)[0]
    told: dict[int, dict[str, list[tuple[str, str]]]] = {}
    for s in stated:
        if s["parameter"] is not None:
            told.setdefault(s["function_id"], {}).setdefault(s["parameter"], []).append((f"{s['kind']}={s['value']}", s["origin"]))
    out = []
    for number, r in enumerate(rows):
        mine = {p: sorted(x) for p, x in told.get(number, {}).items()}
        parts, slots = r["view"].parts(fmt, tuple([p in mine for p in r["formal"]]))
        escape = WRITERS[fmt][1]
        fill = {"offset": r["lo"], "line": r["line"], "word": [w.translate(escape) for w in r["word"]], "name": [(r["function"] or "").translate(escape)]}
        if mine:
            fill["facts"] = [",".join(f for f, _ in mine.get(p, ())) for p in r["formal"]]
            fill["sources"] = [",".join(dict.fromkeys(o for _, o in mine.get(p, ()))) for p in r["formal"]]
        parts = parts.copy()
        for k, what, n in slots:
            parts[k] = str(fill[what][n])
        out.append((r["function"], "".join(parts)))
    return out
