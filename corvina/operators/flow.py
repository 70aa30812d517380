"""Data flow inside functions and between them, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import c_alike, c_dataflow
from ..plans.c_syntax import Node, Tree
from ..plans.c_tokens import Positions
from ..plans.stage import arrow_schema, mapped

DEFINITION = "struct<def:int,binding:int,variable:string,kind:string,node:int,lo:int,hi:int>"
USE = "struct<use:int,binding:int,variable:string,node:int,lo:int,hi:int>"
FLOW = {
    "n_parameters": "int", "definitions": f"array<{DEFINITION}>", "uses": f"array<{USE}>", "edges": "array<struct<def:int,use:int,variable:string>>", "dead_stores": "array<int>", "unresolved": "array<int>",
    "unused": "array<string>", "issues": "array<struct<kind:string,lo:int,hi:int>>", "calls": "array<struct<callee:string,arguments:int>>", "complete": "boolean",
}
SUMMARY = "source_id string, function_id int, function string, arity int, complete boolean, returns array<int>, transfers array<struct<parameter:int,callee:string,argument:int>>"
# Claims for verdicts.
CLAIMS = {"yes": "found_may_path", "no": "no_may_path", "unknown": "unknown"}


def _rows(sources: DataFrame, schema: str, make, extra: list[str] | None = None, alike: str = "", whole: bool = False, read=Tree) -> DataFrame:
    """Rows that `make(tree, row)` gives for each source; `read` makes something else of a text than its tree.

    `alike` names what `make(tree)` does if that gives rows for one function after the
    other, each from its own syntax alone (with `whole`, from the text's), and hangs on no
    number's value: then sources that are alike are read once a worker (`plans.c_alike`).
    """
    arrow = arrow_schema(sources, schema)

    def once(tree: Tree) -> tuple[list[dict], int]:
        return list(make(tree)), len(tree.functions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = c_alike.shared(("rows", alike), once, numbers=True, whole=whole, kept=2_000) if alike else None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["text"] or ""
                if reader and (told := c_alike.per_text(reader, text)) is not None:
                    made = told
                else:
                    made = make(Tree(text)) if alike else make(read(text), r)
                rows += [{"source_id": r["source_id"]} | x for x in made]
                if len(rows) > 500:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text", *(extra or [])), run, schema)


def data_flow(sources: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per function: definitions, uses, edges between them, dead stores, unresolved uses, unused locals, issues.

    Of these columns only `fields` are made, if given.
    """
    chosen = [f for f in FLOW if fields is None or f in fields]

    def make(tree: Tree):
        where = Positions(tree.text)
        for number, f in enumerate(tree.functions()):
            flow, _ = c_dataflow.analyse(tree, f)

            def span(lo: int, hi: int) -> dict:
                return {"lo": where.byte(tree.tokens[lo].lo), "hi": where.byte(tree.tokens[max(lo, hi - 1)].hi)}

            every = {
                "n_parameters": lambda: flow.n_parameters,
                "definitions": lambda: [{"def": i, "binding": d["binding"], "variable": flow.names[d["binding"]], "kind": d["kind"], "node": d["node"]} | span(d["lo"], d["hi"]) for i, d in enumerate(flow.definitions)],
                "uses": lambda: [{"use": i, "binding": u["binding"], "variable": flow.names[u["binding"]], "node": u["node"]} | span(u["lo"], u["hi"]) for i, u in enumerate(flow.uses)],
                "edges": lambda: [{"def": d, "use": u, "variable": flow.names[flow.uses[u]["binding"]]} for d, u in flow.edges],
                "dead_stores": lambda: c_dataflow.dead_stores(flow), "unresolved": lambda: c_dataflow.unresolved(flow), "unused": lambda: [flow.names[b] for b in c_dataflow.unused(flow)],
                "issues": lambda: [{"kind": x["kind"]} | span(x["lo"], x["hi"]) for x in flow.issues], "calls": lambda: [{"callee": c["callee"], "arguments": len(c["arguments"])} for c in flow.calls],
                "complete": lambda: not flow.issues,
            }
            yield {"function_id": number, "function": tree.name_of(f)} | {k: every[k]() for k in chosen}

    schema = "source_id string, function_id int, function string, " + ", ".join(f"{k} {FLOW[k]}" for k in chosen)
    return _rows(sources, schema, make, alike=f"data_flow {chosen}")


def _in_order(row: dict, _: int) -> None:
    row["transfers"] = sorted(row["transfers"])
    row["calls"] = sorted(row["calls"])


def _summaries(text: str, policy: str) -> list[c_dataflow.Summary]:
    """Summaries of a text's functions: each by itself, once a worker for those that are alike, unless one calls another."""

    def once(tree: Tree, policy: str) -> tuple[list[dict], int]:
        found = [c_dataflow.alone(tree, number, f, policy) for number, f in enumerate(tree.functions())]
        return [{"function_id": m.function_id, "name": m.name, "arity": m.arity, "complete": m.complete, "returns": sorted(m.returns), "transfers": [[*t] for t in sorted(m.transfers)], "calls": calls} for m, calls in found], len(found)

    rows = c_alike.per_text(c_alike.shared(("summaries",), once, numbers=True, finish=_in_order), text, (policy,))
    names = {r["name"] for r in rows or ()}
    if rows is None or any(not names.isdisjoint(r["calls"]) for r in rows):
        return c_dataflow.summaries(Tree(text), policy)
    return [c_dataflow.Summary(r["function_id"], r["name"], r["arity"], r["complete"], {*r["returns"]}, {(p, c, a) for p, c, a in r["transfers"]}) for r in rows]


def call_summaries(sources: DataFrame, policy: str = "unknown") -> DataFrame:
    """One row per function: which parameters may reach its result, which arguments of which calls, and whether that is all."""

    def make(made: list[c_dataflow.Summary], _):
        for m in made:
            yield {"function_id": m.function_id, "function": m.name, "arity": m.arity, "complete": m.complete, "returns": sorted(m.returns), "transfers": [{"parameter": p, "callee": c, "argument": a} for p, c, a in sorted(m.transfers)]}

    if policy not in ("unknown", "taint_return", "assume_pure_no_flow"):
        raise ValueError(f"unknown policy {policy!r}")
    return _rows(sources, SUMMARY, make, read=lambda text: _summaries(text, policy))


def query_reaches(sources: DataFrame, policy: str = "unknown") -> DataFrame:
    """For sources with columns `from_function, parameter, to_function`: the claim about each, a path and the uncertainty."""
    schema = "source_id string, from_function string, parameter int, to_function string, claim string, path array<struct<function:string,parameter:int>>, explored int, uncertainty array<string>"

    def make(made: list[c_dataflow.Summary], r):
        got = c_dataflow.reaches(made, r["from_function"], r["parameter"], r["to_function"])
        yield {
            "from_function": r["from_function"], "parameter": r["parameter"], "to_function": r["to_function"], "claim": CLAIMS[got["verdict"]],
            "path": [{"function": f, "parameter": p} for f, p in got["path"]], "explored": got["explored"], "uncertainty": got["uncertainty"],
        }

    return _rows(sources, schema, make, ["from_function", "parameter", "to_function"], read=lambda text: _summaries(text, policy))


def query_reaches_by_id(sources: DataFrame, policy: str = "unknown") -> DataFrame:
    """`query_reaches` with functions by number, from columns `from_id, parameter, to_id`."""
    schema = "source_id string, from_id int, parameter int, to_id int, claim string, path array<struct<function_id:int,parameter:int>>, explored int, uncertainty array<string>"

    def make(made: list[c_dataflow.Summary], r):
        got = c_dataflow.reaches_by_id(made, r["from_id"], r["parameter"], r["to_id"])
        yield {
            "from_id": r["from_id"], "parameter": r["parameter"], "to_id": r["to_id"], "claim": CLAIMS[got["verdict"]], "path": [{"function_id": f, "parameter": p} for f, p in got["path"]],
            "explored": got["explored"], "uncertainty": got["uncertainty"],
        }

    return _rows(sources, schema, make, ["from_id", "parameter", "to_id"], read=lambda text: _summaries(text, policy))


def flow_edges(flows: DataFrame) -> DataFrame:
    return flows.select("source_id", "function_id", "function", F.explode("edges").alias("e")).select("source_id", "function_id", "function", "e.*")


def pdg_edges(flows: DataFrame, dependence: DataFrame) -> DataFrame:
    """Edges of the program dependence graph: control edges, and data edges lifted to the graph's nodes."""
    data = flows.select("source_id", "function_id", "function", "definitions", "uses", F.explode("edges").alias("e")).select(
        "source_id", "function_id", "function", F.element_at("definitions", F.col("e.def") + 1)["node"].alias("src"), F.element_at("uses", F.col("e.use") + 1)["node"].alias("dst"), F.lit("data").alias("kind"))
    control = dependence.select("source_id", "function_id", "function", F.col("on").alias("src"), F.col("node").alias("dst"), F.concat(F.lit("control_"), "kind").alias("kind"))
    return control.unionByName(data.filter("src is not null").distinct())


def _bounds(tree: Tree, function: Node) -> Iterator[tuple[str, Node]]:
    """Names of a function's local arrays with those of their bounds that name something."""
    body = function.first("compound_stmt")
    for d in (n for n in (body.walk() if body else ()) if n.tag == "declarator"):
        name = next((n for n in d.walk() if n.tag == "decl_name"), None)
        for s in (k for k in d.kids if k.tag == "array_suffix" and name is not None and any(tree.kind(i) == "identifier" for i in range(k.lo, k.hi))):
            yield tree.word(name.lo), s


def runtime_bounds(sources: DataFrame) -> DataFrame:
    """`source_id, function_id, array, lo, hi`: bounds of local arrays that name something, in bytes."""

    def make(tree: Tree):
        where = Positions(tree.text)
        for number, f in enumerate(tree.functions()):
            for array, s in _bounds(tree, f):
                yield {"function_id": number, "array": array, "lo": where.byte(tree.tokens[s.lo].lo), "hi": where.byte(tree.tokens[max(s.lo, s.hi - 1)].hi)}

    return _rows(sources, "source_id string, function_id int, array string, lo int, hi int", make, alike="runtime_bounds")


def captured(sources: DataFrame) -> DataFrame:
    """What `bound_captures` gives for the sources' `data_flow` and `runtime_bounds`, in one pass over each text."""

    def make(tree: Tree):
        where = Positions(tree.text)
        for number, f in enumerate(tree.functions()):
            bounds = [*_bounds(tree, f)]
            if not bounds:
                continue
            flow, _ = c_dataflow.analyse(tree, f)
            head = {"function_id": number, "function": tree.name_of(f)}
            for array, s in bounds:
                inside = {k for k, u in enumerate(flow.uses) if s.lo <= u["lo"] and u["hi"] <= s.hi}
                for variable, d in sorted({(flow.names[flow.uses[u]["binding"]], d) for d, u in flow.edges if u in inside}):
                    yield head | {"array": array, "lo": where.byte(tree.tokens[s.lo].lo), "variable": variable, "def": d}

    return _rows(sources, "source_id string, function_id int, function string, array string, lo int, variable string, def int", make, alike="captured")


def bound_captures(flows: DataFrame, bounds: DataFrame) -> DataFrame:
    """`source_id, function_id, function, array, lo, variable, def`: definitions that a runtime bound captures where it is declared.

    A bound captures what reaches the uses that stand inside it, found by containment
    of spans within a function; one without such uses captures nothing.
    """
    keys = ["source_id", "function_id"]
    uses = flows.select(*keys, "function", F.explode("uses").alias("u"), "edges").select(*keys, "function", "u.use", "u.variable", F.col("u.lo").alias("use_lo"), F.col("u.hi").alias("use_hi"), "edges")
    inside = uses.join(bounds, keys).filter("lo <= use_lo and use_hi <= hi")
    reaching = inside.select(*keys, "function", "array", "lo", "variable", F.explode(F.filter("edges", lambda e: e["use"] == F.col("use"))).alias("e"))
    return reaching.select(*keys, "function", "array", "lo", "variable", F.col("e.def").alias("def")).distinct()


# What each kind of issue leaves open.
DIMENSIONS = {"syntax_recovery": "recovery", "unmodeled_effect": "effects", "unknown_memory_effect": "memory", "unknown_memory_read": "memory"}


def coverage(flows: DataFrame) -> DataFrame:
    """`recovery_free, effects_complete, memory_complete` of each function: no issue of a kind that leaves that open."""
    open_in = lambda dimension: F.exists("issues", lambda x: x["kind"].isin([k for k, d in DIMENSIONS.items() if d == dimension]))
    return flows.select("source_id", "function_id", "function", (~open_in("recovery")).alias("recovery_free"), (~open_in("effects")).alias("effects_complete"), (~open_in("memory")).alias("memory_complete"))
