"""Everything one pass over a C text gives: functions with their measures and graphs, tokens, diagnostics."""

from __future__ import annotations

from collections import Counter
from functools import partial

from . import c_alike, c_graph
from .c_syntax import STATEMENTS, Node, Tree
from .c_tokens import NO_OPERATORS, OPERANDS, Positions, Token, tokenize

LOOPS = {"while_stmt", "do_while_stmt", "for_stmt"}
#: Nodes that count for more than themselves.
WEIGHED = LOOPS | {"if_stmt", "switch_stmt", "cond_expr", "goto_stmt", "postfix_expr", "binary_expr"}
VISITS = 2_000_000


def shape(tree: Tree, body: Node) -> dict:
    """Nesting, cognitive complexity, statement, call and tag counts of a body."""
    tags: Counter[str] = Counter()
    callees: set[str] = set()
    cognitive = deepest = loops = calls = visits = 0
    # node, nesting, loop depth, whether it is an else-if, operator of the logical chain above
    stack: list[tuple[Node, int, int, bool, str]] = [(body, 0, 0, False, "")]
    truncated = False
    while stack:
        if visits >= VISITS:
            truncated = True
            break
        node, nesting, depth, else_if, above = stack.pop()
        visits += 1
        tag, kids = node.tag, node.kids
        tags[tag] += 1
        if nesting > deepest:
            deepest = nesting
        if depth > loops:
            loops = depth
        if tag not in WEIGHED:
            for k in reversed(kids):
                if k.kids or k.tag in WEIGHED:
                    stack.append((k, nesting, depth, False, ""))
                else:  # it adds nothing but itself
                    visits += 1
                    tags[k.tag] += 1
            continue
        below = [(k, nesting, depth, False, "") for k in kids]
        if tag == "if_stmt":
            cognitive += 1 if else_if else 1 + nesting
            arms = [(k, nesting + 1, depth, False, "") for k in node.arms]
            if len(arms) > 1:
                if node.arms[1].tag == "if_stmt":
                    arms[1] = (node.arms[1], nesting, depth, True, "")
                else:
                    cognitive += 1
            below[node.split :] = arms
        elif tag in LOOPS or tag == "switch_stmt":
            cognitive += 1 + nesting
            inner = depth + (tag in LOOPS)
            below = [(k, nesting + 1, inner, False, "") if k.tag in STATEMENTS else (k, nesting, depth, False, "") for k in kids]
        elif tag == "cond_expr":
            cognitive += 1 + nesting
            below = [(k, nesting + (i > 0), depth, False, "") for i, k in enumerate(kids)]
        elif tag == "goto_stmt":
            cognitive += 1
        elif tag == "postfix_expr":
            here = [i for i, k in enumerate(kids) if k.tag == "call_args"]
            calls += len(here)
            if 1 in here and kids[0].tag == "name_ref":
                callees.add(tree.word(kids[0].lo))
        elif tag == "binary_expr" and (operator := tree.kind(node.main)) in ("&&", "||"):
            cognitive += operator != above
            below = [(k, nesting, depth, False, operator) for k in kids]
        stack += reversed(below)
    return {
        "cognitive": cognitive, "max_nesting": deepest, "max_loop_depth": loops, "statements": sum(n for t, n in tags.items() if t in STATEMENTS), "ast_nodes": visits,
        "calls": calls, "callees": sorted(callees), "tag_counts": dict(tags), "truncated": truncated,
    }


def parameters(tree: Tree, function: Node) -> list[str]:
    """Names of the declared parameters ("" for one without a name); a lone void and "..." don't count."""
    body = function.first("compound_stmt")
    head = [k for k in function.kids if k is not body]
    found = next((n for k in head for n in k.walk() if n.tag == "param_list"), None)
    if found is None:
        return []
    names = []
    for p in found.kids:
        words = [tree.tokens[i] for i in range(p.lo, p.hi)]
        if len(found.kids) == 1 and [w.text for w in words] == ["void"] or words[0].text == "...":
            continue
        pointed = [w.text for i, w in enumerate(words) if w.kind == "identifier" and i and words[i - 1].text == "*" and i > 1 and words[i - 2].text == "("]
        depth, last, idents = 0, "", 0
        for w in words:
            depth += (w.text in ("(", "[")) - (w.text in (")", "]"))
            if not depth and w.kind == "identifier":
                last, idents = w.text, idents + 1
        typed = any(w.kind not in OPERANDS and w.kind.isidentifier() and w.kind not in ("const", "volatile", "restrict", "register") for w in words)
        names.append(pointed[0] if pointed else last if typed and not any(w.kind in ("struct", "union", "enum") for w in words) or idents > 1 or len(words) == 1 else "")
    return names


def starts_of(tokens: list[Token], where: Positions) -> list[int]:
    """The line each token begins on."""
    out, breaks, line, count = [], where.breaks, 0, len(where.breaks)
    for t in tokens:
        lo = t[2]
        while line < count and breaks[line] <= lo:
            line += 1
        out.append(line + 1)
    return out


def file_lines(text: str, where: Positions, coded: set[int]) -> dict:
    """Line counts of a text, given the lines that tokens begin on."""
    lines = text.split("\n")
    blank = sum(not line.strip() for i, line in enumerate(lines) if i + 1 not in coded)
    return {"lines": len(lines), "code_lines": len(coded), "blank_lines": blank, "other_lines": len(lines) - len(coded) - blank, "bytes": where.byte(len(text))}


def lines_only(text: str) -> dict:
    """Line counts of a text; no parser."""
    where = Positions(text)
    return file_lines(text, where, {*starts_of(tokenize(text)[0], where)})


def _lined(tree: Tree, graphs: bool | str) -> tuple[list[dict], tuple]:
    """Functions of a piece of a text, and its blank lines, those with code and whether its last line is blank."""
    read = _whole(tree, graphs)
    return read["functions"], (read["blank_lines"], read["code_lines"], not tree.text.rsplit("\n", 1)[-1].strip())


def _finish(row: dict, numbers: int) -> None:
    row["n2"] += numbers
    row["callees"].sort()


_readers = {graphs: c_alike.Reader(partial(_lined, graphs=graphs), numbers=True, finish=_finish, kept=2_000 if graphs is True else c_alike.KEPT) for graphs in (True, False, "counts")}


def unit(text: str, graphs: bool | str = True, tokens: bool = False) -> dict:
    """Functions, file lines, diagnostics and, if wanted, tokens of a text.  Offsets are of bytes; never raises on content.

    `graphs` "counts" gives the graphs' measures in place of their nodes and edges.
    """
    functions, pieces, at = ([], [], 0) if tokens else _readers[graphs].begin(text)
    if not pieces:
        return _whole(Tree(text), graphs, tokens)
    if at < len(text):
        return _continued(functions, pieces, at, text, graphs)
    for number, f in enumerate(functions):
        f["function_id"] = number
    code, lines = sum(p.told[1] for p in pieces), sum(p.lines for p in pieces) + 1
    blank = sum(p.told[0] - p.told[2] for p in pieces) + pieces[-1].told[2]
    return {"functions": functions, "lines": lines, "code_lines": code, "blank_lines": blank, "other_lines": lines - code - blank, "bytes": len(text), "diagnostics": [], "tokens": []}


def _continued(functions: list[dict], pieces: list, at: int, text: str, graphs: bool | str) -> dict:
    """`unit` of a text that is read up to an offset: the rest is read by itself and put behind."""
    rest = _whole(Tree(text[at:]), graphs)
    above = sum(p.lines for p in pieces)
    functions += c_alike.moved(rest["functions"], at, above)
    for number, f in enumerate(functions):
        f["function_id"] = number
    told = {"lines": above, "code_lines": sum(p.told[1] for p in pieces), "blank_lines": sum(p.told[0] - p.told[2] for p in pieces), "bytes": at}
    told = {k: n + rest[k] for k, n in told.items()}
    told["other_lines"] = told["lines"] - told["code_lines"] - told["blank_lines"]
    return {"functions": functions, **told, "diagnostics": c_alike.moved(rest["diagnostics"], at, above), "tokens": []}


def _whole(tree: Tree, graphs: bool | str = True, tokens: bool = False) -> dict:
    """`unit` of a text that has been parsed."""
    text = tree.text
    where = Positions(text)
    starts = starts_of(tree.tokens, where)
    functions = []
    for number, f in enumerate(tree.functions()):
        lo, hi = tree.span(f)
        body = f.first("compound_stmt")
        own = tree.tokens[f.lo : f.hi]
        operators = [t[0] for t in own if t[0] not in NO_OPERATORS]
        operands = [t[1] for t in own if t[0] in OPERANDS]
        row = {
            "function_id": number, "name": tree.name_of(f), "lo": where.byte(lo), "hi": where.byte(hi), "has_body": body is not None, "parameters": len(parameters(tree, f)),
            "first_line": where.line(lo), "last_line": where.line(max(lo, hi - 1)), "code_lines": len({*starts[f.lo : f.hi]}), "tokens": len(own),
            "n1": len({*operators}), "n2": len({*operands}), "N1": len(operators), "N2": len(operands),
        }
        row |= shape(tree, body or Node("compound_stmt", f.hi, f.hi))
        if graphs:
            g = c_graph.graph_of(tree, f)
            live, ends = g.live(), g.ends()
            # without a statement left out the second graph would be the first
            dead = c_graph.graph_of(tree, f, syntactic=True).live().count(False) if g.left_out else live.count(False)
            row |= {"short_circuits": g.short_circuits, "unreachable_statements": dead}
            if graphs == "counts":
                row |= g.metrics(live, ends)
                functions.append(row)
                continue
            row["cfg_nodes"] = [{"id": i, "kind": k, "lo": where.byte(s[0]), "hi": where.byte(s[1]), "internal": x, "live": a, "ends": b} for i, (k, s, x, a, b) in enumerate(zip(g.kinds, g.spans, g.internal, live, ends, strict=True))]
            row["cfg_edges"] = [{"ord": i, "src": e[0], "dst": e[1], "kind": e[2], "back": e[3]} for i, e in enumerate(g.edges)]
        functions.append(row)
    return {
        "functions": functions, **file_lines(text, where, {*starts}),
        "diagnostics": [{"severity": n.severity, "message": n.message, "lo": where.byte(n.lo), "hi": where.byte(n.hi)} for n in sorted(tree.notes, key=lambda n: (n.lo, n.hi))],
        "tokens": [{"idx": i, "kind": t.kind, "lo": where.byte(t.lo), "hi": where.byte(t.hi), "line": starts[i], "lexeme": t.text} for i, t in enumerate(tree.tokens)] if tokens else [],
    }
