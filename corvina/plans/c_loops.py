"""What loops say about how often they run, and facts that comments state about functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from .c_measure import parameters
from .c_syntax import Node, Tree

# Kinds of loop bounds, and kinds of facts.
BOUNDS = ("constant", "parameter", "runtime", "none")
FACTS = ("capacity", "strlen", "unroll")
RELATIONS = {"<", "<=", ">", ">=", "!="}
LOOPS = {"for_stmt", "while_stmt", "do_while_stmt"}
MARKER = "@fact"
NUMBER = re.compile(r"(0[xX][\da-fA-F]+|\d+)[uUlL]*\Z")


def _name(tree: Tree, node: Node | None) -> str | None:
    while node is not None and node.tag == "paren_expr" and node.kids:
        node = node.kids[0]
    return tree.word(node.lo) if node is not None and node.tag == "name_ref" else None


def _number(tree: Tree, node: Node | None) -> int | None:
    if node is None or node.tag != "literal" or node.hi - node.lo != 1:
        return None
    m = NUMBER.match(tree.word(node.lo))
    return int(m[1], 16 if m[1][:2].lower() == "0x" else 8 if m[1][0] == "0" and len(m[1]) > 1 and m[1].isdigit() and "8" not in m[1] and "9" not in m[1] else 10) if m else None


def _step(tree: Tree, node: Node) -> tuple[str, int] | None:
    """(variable, step) of ++, --, += n, -= n and v = v + n."""
    kids = node.kids
    if node.tag == "postfix_expr" and len(kids) == 2 and kids[1].tag == "inc_dec_suffix" and _name(tree, kids[0]):
        return _name(tree, kids[0]), 1 if tree.kind(kids[1].main) == "++" else -1
    if node.tag == "unary_expr" and tree.kind(node.main) in ("++", "--") and _name(tree, kids[0]):
        return _name(tree, kids[0]), 1 if tree.kind(node.main) == "++" else -1
    if node.tag == "assign_expr" and (v := _name(tree, kids[0])):
        operator, right = tree.kind(node.main), kids[1]
        if operator in ("+=", "-=") and (n := _number(tree, right)) is not None:
            return v, n if operator == "+=" else -n
        if operator == "=" and right.tag == "binary_expr" and len(right.kids) == 2 and _name(tree, right.kids[0]) == v and tree.kind(right.main) in ("+", "-") and (n := _number(tree, right.kids[1])) is not None:
            return v, n if tree.kind(right.main) == "+" else -n
    return None


def _written(tree: Tree, nodes: list[Node]) -> list[str]:
    """Names that are assigned below the nodes, once for each time."""
    found = []
    for top in nodes:
        for n in top.walk():
            if n.tag == "assign_expr" or n.tag == "unary_expr" and tree.kind(n.main) in ("++", "--") or n.tag == "postfix_expr" and n.kids[-1].tag == "inc_dec_suffix":
                if name := _name(tree, n.kids[0]):
                    found.append(name)
            elif n.tag == "declarator" and (d := n.first("decl_name")):
                found.append(tree.word(d.lo))
    return found


def loops(tree: Tree, function: Node) -> list[dict]:
    """Each loop's header span, bound kind, and where they are sure: variable, start, bound, step."""
    formal = set(filter(None, parameters(tree, function)))
    addressed = {tree.word(n.kids[0].lo) for n in function.walk() if n.tag == "unary_expr" and tree.kind(n.main) == "&" and _name(tree, n.kids[0])}
    return [_loop(tree, n, formal, addressed) for n in function.walk() if n.tag in LOOPS]


def _loop(tree: Tree, node: Node, formal: set[str], addressed: set[str]) -> dict:
    parts = {k.tag: k for k in node.header} if node.tag == "for_stmt" else {}
    if node.tag == "for_stmt":
        test = next(iter(parts["for_cond"].kids), None) if "for_cond" in parts else None
        body = node.arms[0] if node.arms else node
    elif node.tag == "do_while_stmt":
        test, body = (node.kids[1] if len(node.kids) > 1 else None), node.kids[0]
    else:
        test, body = (node.header[0] if node.header else None), node.arms[0] if node.arms else node
    out = {"loop": node.tag.removesuffix("_stmt"), "span": tree.span(test or node), "bound_kind": "runtime", "induction": None, "start": None, "bound": None, "step": None}
    if test is None:
        return out | {"bound_kind": "none"}
    if node.tag == "for_stmt":
        clause = parts.get("for_step")
        step = _step(tree, clause.kids[0]) if clause and len(clause.kids) == 1 else None
    else:
        read = {tree.word(n.lo) for n in test.walk() if n.tag == "name_ref"}
        statements = body.kids if body.tag == "compound_stmt" else [body]
        steps = [s for k in statements if k.tag == "expr_stmt" and k.kids and (s := _step(tree, k.kids[0])) and s[0] in read]
        step = steps[0] if len(steps) == 1 else None
    if step is None:
        return out
    variable, amount = step
    out |= {"induction": variable, "step": amount}
    inside = _written(tree, [body])
    if test.tag != "binary_expr" or len(test.kids) != 2 or tree.kind(test.main) not in RELATIONS or _name(tree, test.kids[0]) != variable or variable in addressed or node.tag != "for_stmt" or variable in inside:
        return out
    init = parts.get("for_init")
    first = init.kids[0] if init and len(init.kids) == 1 else None
    start = None
    if first is not None and first.tag == "decl" and (names := [n for n in first.walk() if n.tag == "decl_name"]) and len(names) == 1 and tree.word(names[0].lo) == variable and (value := first.first("initializer")):
        start = _number(tree, value.kids[0])
    elif first is not None and first.tag == "assign_expr" and tree.kind(first.main) == "=" and _name(tree, first.kids[0]) == variable:
        start = _number(tree, first.kids[1])
    if start is None:
        return out
    limit, name = _number(tree, test.kids[1]), _name(tree, test.kids[1])
    if limit is not None:
        return out | {"bound_kind": "constant", "start": start, "bound": str(limit)}
    if name in formal and name not in addressed and name not in _written(tree, [init, *([parts["for_step"]] if "for_step" in parts else []), body]) and name not in _written(tree, [test]):
        return out | {"bound_kind": "parameter", "start": start, "bound": name}
    return out


LINE = re.compile(r"(?P<kind>\w+)\s*(?:\(\s*(?P<parameter>\w+)\s*\))?\s*=\s*(?P<value>\w+)\s*\Z")


def facts(tree: Tree, given: list[dict] | None = None, marker: str = MARKER) -> tuple[list[dict], list[dict]]:
    """(facts attached to functions, problems).

    Comments `// <marker> capacity(p) = n`, `strlen(p) = n` and `unroll = 8` speak of
    the function that follows them; `given` facts (function, kind, parameter, value)
    win over comments.  A fact that fits nothing is a problem, never dropped in silence.
    """
    functions = [(tree.span(f), tree.name_of(f), set(filter(None, parameters(tree, f)))) for f in tree.functions()]
    return stated(tree.text, functions, lambda at: any(t.lo <= at < t.hi for t in tree.tokens), given, marker)


def stated(text: str, functions: list[tuple[tuple[int, int], str, set[str]]], within: Callable[[int], bool], given: list[dict] | None, marker: str) -> tuple[list[dict], list[dict]]:
    """`facts` of a text with functions as (span, name, parameters); `within` tells whether an offset is in a token."""
    found: dict[tuple, dict] = {}
    problems: list[dict] = []

    def attach(number: int | None, kind: str, parameter: str | None, value: str, origin: str, at: tuple[int, int]) -> None:
        def refuse(why: str) -> None:
            problems.append({"message": why, "lo": at[0], "hi": at[1]})

        if number is None:
            return refuse("no function follows this fact" if origin == "comment" else "no such function")
        _, name, formal = functions[number]
        if kind not in FACTS:
            return refuse(f"unknown kind of fact {kind}")
        if (kind == "unroll") != (parameter is None):
            return refuse("unroll takes no parameter" if parameter else f"{kind} needs a parameter")
        if parameter is not None and parameter not in formal:
            return refuse(f"{name} has no parameter {parameter}")
        if not NUMBER.match(value) and (kind == "unroll" or value not in formal):
            return refuse(f"{value} is neither a number nor a parameter")
        found[number, kind, parameter] = {"function_id": number, "function": name, "kind": kind, "parameter": parameter, "value": value, "origin": origin}

    for m in re.finditer(rf"//[ \t]*{re.escape(marker)}[ \t:]+([^\n]*)", text):
        if within(m.start()):
            continue
        parsed = LINE.match(m[1].strip())
        if not parsed:
            problems.append({"message": "this fact can't be read", "lo": m.start(), "hi": m.end()})
            continue
        inside = any(lo < m.start() < hi for (lo, hi), _, _ in functions)
        number = None if inside else next((i for i, ((lo, _), _, _) in enumerate(functions) if lo >= m.end()), None)
        attach(number, parsed["kind"], parsed["parameter"], parsed["value"], "comment", m.span())
    for g in given or []:
        numbers = [i for i, (_, name, _) in enumerate(functions) if name == g["function"]]
        attach(numbers[0] if len(numbers) == 1 else None, g["kind"], g.get("parameter"), str(g["value"]), "given", (0, 0))
    return [found[k] for k in sorted(found, key=lambda k: (k[0], FACTS.index(k[1]), k[2] or ""))], problems
