"""Types of parameters and locals as they are written, and where they disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import c_lower, c_typing
from ..plans.c_syntax import QUALIFIERS, STORAGE, Node, Tree
from ..plans.c_tokens import Positions
from ..plans.stage import alike, told
from .flow import _rows

SCHEMA = "source_id string, function_id int, function string, name string, role string, type string, pointer_depth int, array_rank int, is_const boolean, is_volatile boolean, lo int"


def _words(tree: Tree, lo: int, hi: int) -> list[str]:
    out, depth = [], 0
    for i in range(lo, hi):
        k = tree.kind(i)
        depth += (k in ("(", "{")) - (k in (")", "}"))
        if not depth and k not in (")", "}") and k not in STORAGE and k not in QUALIFIERS and k not in ("__attribute__", "__declspec", "__cdecl"):
            out.append(tree.word(i))
    return out


def _declared(tree: Tree, function: Node):
    """(name, role, base words, pointers, arrays, qualifier words, token) of each declaration in order."""
    head = next((n for n in function.walk() if n.tag == "param_list"), None)
    for p in head.kids if head else []:
        words = [tree.word(i) for i in range(p.lo, p.hi)]
        if words in (["void"], ["..."]):
            continue
        named = [i for i in range(p.lo, p.hi) if tree.kind(i) == "identifier"]
        at = named[-1] if named and (len(named) > 1 or any(tree.kind(i) != "identifier" and tree.kind(i).isidentifier() for i in range(p.lo, p.hi))) else None
        stop = at if at is not None else p.hi
        base = [w for w in _words(tree, p.lo, stop) if w not in ("*", "[", "]", "(")]
        yield tree.word(at) if at is not None else "", "parameter", base, words.count("*"), words.count("["), words, p.lo
    for n in function.walk():
        if n.tag != "decl" or not n.kids or n.kids[0].tag != "decl_specifiers":
            continue
        specifiers = n.kids[0]
        before = [tree.word(i) for i in range(specifiers.lo, specifiers.hi)]
        if "typedef" in before:
            continue
        for d in n.kids:
            name = next((x for x in d.walk() if x.tag == "decl_name"), None) if d.tag == "declarator" else None
            if name is not None:
                yield tree.word(name.lo), "local", _words(tree, specifiers.lo, specifiers.hi), sum(x.tag == "pointer_operator" for x in d.walk()), sum(x.tag == "array_suffix" for x in d.walk()), before, name.lo


def declared_types(sources: DataFrame) -> DataFrame:
    """One row per declared parameter and local: base type, pointer depth, array rank, qualifiers, in source order."""

    def make(tree: Tree, _):
        where = Positions(tree.text)
        for number, f in enumerate(tree.functions()):
            for name, role, base, pointers, arrays, words, token in _declared(tree, f):
                yield {
                    "function_id": number, "function": tree.name_of(f), "name": name, "role": role, "type": " ".join(base) or "int", "pointer_depth": pointers, "array_rank": arrays,
                    "is_const": any(w.strip("_") == "const" for w in words), "is_volatile": any(w.strip("_") == "volatile" for w in words), "lo": where.byte(tree.tokens[token].lo),
                }

    return _rows(sources, SCHEMA, make)


def type_conflicts(declared: DataFrame) -> DataFrame:
    """`source_id, function_id, name, shapes`: names of a function declared with different shapes (qualifiers don't count)."""
    shape = F.concat_ws(" ", "type", F.repeat(F.lit("*"), F.col("pointer_depth")), F.repeat(F.lit("[]"), F.col("array_rank")))
    found = declared.filter("name <> ''").groupBy("source_id", "function_id", "name").agg(F.sort_array(F.collect_set(shape)).alias("shapes"))
    return found.filter(F.size("shapes") > 1)


def typed_operations(sources: DataFrame, places: bool = True) -> DataFrame:
    """One row per operation, in the order of evaluation from the inside out: operator, type of its value (null: unknown), and each operand's type and what it is converted to (null: not at all).

    Without `places` (`lo`, `hi`) texts that are alike are read once a worker.
    """
    if not places:

        def find(tree: Tree) -> list[tuple[str, list[tuple]]]:
            names = c_lower.Names(tree)
            results = {k: v for k, v in names.results.items() if v != c_lower.UNKNOWN}
            return [(tree.name_of(f), [(r["ord"], r["op"], r["type"], r["operands"]) for r in c_typing.operations(tree, f, names.members, results)]) for f in tree.functions()]

        # types hang on literals' values and on the text's declarations
        return told(sources, alike(("typed_operations",), find, numbers=False, whole=True), "`ord` int, op string, type string, operands array<struct<type:string,converted:string>>")
    schema = "source_id string, function_id int, function string, `ord` int, lo int, hi int, op string, type string, operands array<struct<type:string,converted:string>>"

    def make(tree: Tree, _):
        where, names = Positions(tree.text), c_lower.Names(tree)
        results = {k: v for k, v in names.results.items() if v != c_lower.UNKNOWN}
        for number, f in enumerate(tree.functions()):
            for row in c_typing.operations(tree, f, names.members, results):
                span = {"lo": where.byte(tree.tokens[row["lo"]].lo), "hi": where.byte(tree.tokens[max(row["lo"], row["hi"] - 1)].hi)}
                yield {"function_id": number, "function": tree.name_of(f)} | row | span

    return _rows(sources, schema, make)
