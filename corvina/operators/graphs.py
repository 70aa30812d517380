"""Operators on functions' graphs: dominance, dependence, slices, neighbourhoods, chains, similarity.

A function's graph travels with its row, so all but the joins of pairs run without a
shuffle, in parallel over functions.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import c_alike, c_depend, c_graph, c_measure
from ..plans.c_syntax import Tree
from ..plans.stage import BATCH, EDGE, NODE, Unparsed, alike, arrow_schema, mapped, portions, told


KINDS = {kind: i for i, kind in enumerate(c_graph.NODE_KINDS)}
#: Pairs of graphs whose comparison one task remembers.
PAIRS = 20_000


def per_function(functions: DataFrame | Unparsed, solve, fields: str, extra: list[str] | None = None, alike: str = "") -> DataFrame:
    """Rows that `solve(nodes, edges, row)` gives for each function, after `source_id, function_id, function`.

    `functions` are rows with graphs, or sources that are parsed and solved in one pass;
    `alike` names what `solve` does: then sources that are alike are solved once a worker.
    """
    extra = extra or []
    schema = f"source_id string, function_id int, function string, {fields}"
    df = functions.sources if isinstance(functions, Unparsed) else functions
    arrow = arrow_schema(df, schema)

    def solved(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in rows:
            head = {"source_id": r["source_id"], "function_id": r["function_id"], "function": r["name"]}
            out += [head | x for x in solve(r["cfg_nodes"], r["cfg_edges"], r)]
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    if isinstance(functions, Unparsed):

        def once(tree: Tree, *given) -> tuple[list[dict], int]:
            found = c_measure._whole(tree)["functions"]
            row = dict(zip(extra, given, strict=True))
            return [{"function_id": f["function_id"], "name": f["name"], "solved": list(solve(f["cfg_nodes"], f["cfg_edges"], row | f))} for f in found], len(found)

        def told(held: dict[str, list], reader: c_alike.Reader) -> pa.RecordBatch:
            heads, places, known, rows = [], [], {}, []
            for k, text in enumerate(held["text"]):
                given = tuple(held[c][k] for c in extra)
                found = c_alike.per_text(reader, text or "", given)
                for r in once(Tree(text or ""), *given)[0] if found is None else found:
                    solved = r["solved"]
                    if id(solved) not in known:  # functions that are alike share what was solved: it is turned into columns once
                        known[id(solved)] = (solved, np.arange(len(rows), len(rows) + len(solved)))
                        rows += solved
                    heads.append((held["source_id"][k], r["function_id"], r["name"]))
                    places.append(known[id(solved)][1])
            ids, numbers, names = zip(*heads, strict=True) if heads else ((), (), ())
            each = np.repeat(np.arange(len(heads)), [len(p) for p in places])
            first = [pa.array(c, t).take(pa.array(each, pa.int64())) for c, t in ((ids, pa.string()), (numbers, pa.int32()), (names, pa.string()))]
            own = pa.RecordBatch.from_pylist(rows, pa.schema(list(arrow)[3:])).take(pa.array(np.concatenate([np.empty(0, np.int64), *places]), pa.int64()))
            return pa.RecordBatch.from_arrays([*first, *own.columns], schema=arrow)

        def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = c_alike.shared(("per_function", alike), once, numbers=True, kept=2_000) if alike else None
            for batch in portions(batches):
                held = {c: batch.column(c).to_pylist() for c in ("source_id", "text", *extra)}
                if reader:
                    yield told(held, reader)
                    continue
                yield from solved({c: held[c][k] for c in extra} | {"source_id": held["source_id"][k]} | f for k, text in enumerate(held["text"]) for f in c_measure.unit(text or "")["functions"])

        return mapped(df.select(F.col("source_id").cast("string").alias("source_id"), "text", *extra), parsed, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                yield from solved(batch.slice(k, BATCH).to_pylist())

    return mapped(df.select("source_id", "function_id", "name", "cfg_nodes", "cfg_edges", *extra), run, schema)


def _pairs(edges: list[dict]) -> list[tuple[int, int]]:
    return [(e["src"], e["dst"]) for e in edges]


def post_dominators(functions: DataFrame | Unparsed) -> DataFrame:
    """`node, ipdom` (null for roots) `, dead_end` of every node."""

    def solve(nodes, edges, _):
        ipdom, stuck = c_depend.post_dominators(len(nodes), _pairs(edges))
        return [{"node": i, "ipdom": None if d < 0 else d, "dead_end": i in stuck} for i, d in enumerate(ipdom)]

    return per_function(functions, solve, "node int, ipdom int, dead_end boolean", alike="post_dominators")


def _dependence(nodes, edges):
    ipdom, _ = c_depend.post_dominators(len(nodes), _pairs(edges))
    return c_depend.control_dependence(len(nodes), [(e["src"], e["dst"], e["kind"]) for e in edges], ipdom)


def control_dependence(functions: DataFrame | Unparsed) -> DataFrame:
    """`on, node, kind`: edges of the control dependence graph."""
    return per_function(functions, lambda n, e, _: [{"on": a, "node": b, "kind": k} for a, b, k in _dependence(n, e)], "`on` int, node int, kind string", alike="control_dependence")


def control_depth(functions: DataFrame | Unparsed) -> DataFrame:
    """`node, depth`: how many layers of decisions stand above each node."""
    return per_function(functions, lambda n, e, _: [{"node": i, "depth": d} for i, d in enumerate(c_depend.depths(len(n), _dependence(n, e)))], "node int, depth int", alike="control_depth")


def backward_slice(functions: DataFrame | Unparsed, seed_column: str, data_edges: str | None = None) -> DataFrame:
    """`node` of the slice of each function from the node in `seed_column`, over control and, if a column of (src, dst) is named, data dependence."""

    def solve(nodes, edges, row):
        depend = [(a, b) for a, b, _ in _dependence(nodes, edges)]
        if data_edges:
            depend += [(e["src"], e["dst"]) for e in row[data_edges] or []]
        return [{"seed": row[seed_column], "node": x} for x in c_depend.backward_slice(len(nodes), depend, row[seed_column])]

    return per_function(functions, solve, "seed int, node int", [seed_column, *([data_edges] if data_edges else [])])


def reaching(functions: DataFrame | Unparsed, start_column: str, backward: bool = False) -> DataFrame:
    """`node` of every descendant (or ancestor) of the node in `start_column`, itself excluded even on a cycle."""

    def solve(nodes, edges, row):
        out, into = c_depend.neighbours(len(nodes), _pairs(edges))
        start = row[start_column]
        if not 0 <= start < len(nodes):
            raise KeyError(start)
        return [{"start": start, "node": x} for x in sorted(c_depend.closure([start], into if backward else out) - {start})]

    return per_function(functions, solve, "start int, node int", [start_column])


def degrees(edges: DataFrame) -> DataFrame:
    """`source_id, function_id, node, in_degree, out_degree` from edge rows, parallel edges counted."""
    keys = ["source_id", "function_id"]
    both = edges.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy(*keys, "x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def chains(functions: DataFrame | Unparsed) -> DataFrame:
    """`node, block`: straight-line chains contracted; entry and exit stay apart."""
    return per_function(functions, lambda n, e, _: [{"node": i, "block": b} for i, b in enumerate(c_depend.chains(len(n), _pairs(e)))], "node int, block int")


def problems(functions: DataFrame | Unparsed, lost: str | None = None) -> DataFrame:
    """`problem, node` where a graph breaks a rule: nodes off the entry, kinds of edges that don't fit their source, a missing end.

    `lost` names a column with a kind of edges that a row's graphs are taken to have lost (null: none).
    """

    def solve(nodes, edges, row):
        out = {}
        for e in (e for e in edges if e["kind"] != row[lost]) if lost else edges:
            out.setdefault(e["src"], []).append(e["kind"])
        found = []
        for n in nodes:
            kinds = out.get(n["id"], [])
            if not n["live"] and n["kind"] not in ("entry", "exit"):
                found.append(("unreachable", n["id"]))
            if not kinds and n["kind"] not in ("exit", "diverge"):
                found.append(("no_successor", n["id"]))
            if n["kind"] == "exit" and kinds:
                found.append(("exit_has_successor", n["id"]))
            if n["kind"] == "cond" and sorted(kinds) != ["false", "true"]:
                found.append(("condition_arms", n["id"]))
            if n["kind"] == "return" and kinds != ["jump"]:
                found.append(("return_edge", n["id"]))
        return [{"problem": p, "node": i} for p, i in found]

    return per_function(functions, solve, "problem string, node int", [lost] if lost else None, alike=f"problems {lost}")


def shapes(functions: DataFrame | Unparsed) -> DataFrame:
    """`source_id, function_id, name, nodes, n_edges`: degrees and roles of each function's nodes, for comparisons."""

    def solve(nodes, edges, _):
        into, out = Counter(e["dst"] for e in edges), Counter(e["src"] for e in edges)
        yield {"nodes": [{"in": into[n["id"]], "out": out[n["id"]], "is_entry": n["kind"] == "entry", "is_exit": n["kind"] == "exit"} for n in nodes], "n_edges": len(edges)}

    return per_function(functions, solve, "nodes array<struct<`in`:int,`out`:int,is_entry:boolean,is_exit:boolean>>, n_edges int", alike="shapes").withColumnRenamed("function", "name")


def nodes(sources: DataFrame) -> DataFrame:
    """`source_id, function_id, function, id, kind, internal, live, ends` of each node of the functions' graphs, without its place in the text."""

    def find(tree: Tree) -> list[tuple[str, list[tuple]]]:
        made = ((tree.name_of(f), c_graph.graph_of(tree, f)) for f in tree.functions())
        return [(name, list(zip(range(len(g.kinds)), g.kinds, g.internal, g.live(), g.ends(), strict=True))) for name, g in made]

    return told(sources, alike(("nodes",), find), "id int, kind string, internal boolean, live boolean, ends boolean")


def unplaced(functions: DataFrame | Unparsed) -> DataFrame:
    """`source_id, function_id, name, cfg_nodes, cfg_edges` of each function: its graph without places in the text."""
    where = ("lo", "hi")
    nodes, edges = NODE.replace("lo:int,hi:int,", ""), EDGE

    def solve(found, ties, _):
        return [{"cfg_nodes": [{k: v for k, v in n.items() if k not in where} for n in found], "cfg_edges": ties}]

    return per_function(functions, solve, f"cfg_nodes array<{nodes}>, cfg_edges array<{edges}>", alike="unplaced").withColumnRenamed("function", "name")


def sizes(functions: DataFrame | Unparsed) -> DataFrame:
    """`source_id, function_id, name, n_nodes` of each function's graph."""
    return per_function(functions, lambda n, *_: [{"n_nodes": len(n)}], "n_nodes int", alike="sizes").withColumnRenamed("function", "name")


def similarity(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """`distance, approximated` for rows with `pair_id, left, right` (shapes) and `left_edges, right_edges`; exact unless `most` nodes are given."""
    kind = dict(pairs.dtypes)["pair_id"]
    schema = f"pair_id {kind}, distance long, approximated boolean"
    arrow = arrow_schema(pairs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shape(nodes: list[dict]) -> list[tuple]:
            return sorted((n["in"], n["out"], n["is_entry"], n["is_exit"]) for n in nodes)

        known: dict = {}  # pairs of alike shapes have one distance, whatever the order of nodes
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = (tuple(shape(r["left"])), tuple(shape(r["right"])), r["left_edges"], r["right_edges"])
                if key not in known:
                    if len(known) >= PAIRS:
                        known.clear()
                    known[key] = c_depend.edit_distance(*key, most)
                d, rough = known[key]
                rows.append({"pair_id": r["pair_id"], "distance": d, "approximated": rough})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return mapped(pairs.select("pair_id", "left", "right", "left_edges", "right_edges"), run, schema)


# Beginnings of names that are not compared.
UNSCORED = ("<", "+", "*", "(", ">", "JUMPOUT", "__builtin_unreachable")


def scoreable(functions: DataFrame) -> DataFrame:
    """Functions whose names are not empty and begin with none of `UNSCORED`."""
    name = F.col("name")
    bad = F.lit(False)
    for prefix in UNSCORED:
        bad = bad | name.startswith(prefix)
    return functions.filter((name != "") & ~bad)


def best_by_name(functions: DataFrame, size: str | None = None) -> DataFrame:
    """One function of each name over all sources: the largest graph, then the first source; degenerate graphs last.

    `size` names a column with numbers of nodes, for rows without `cfg_nodes`.
    """
    n = F.col(size) if size else F.size("cfg_nodes")
    order = Window.partitionBy("name").orderBy(n <= 2, n.desc(), "source_id", "function_id")
    return functions.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def size_delta(pairs: DataFrame) -> DataFrame:
    """The stand-in distance of all pairs, in SQL: differences of node and edge counts."""
    return pairs.select("pair_id", (F.abs(F.size("left") - F.size("right")) + F.abs(F.col("left_edges") - F.col("right_edges"))).cast("long").alias("distance"))


def parity_blocks(sources: DataFrame) -> DataFrame:
    """`name, nodes, edges, entry, exit, degenerate` of the block graph of every scoreable function; of one name in a source the larger, then the first."""
    from ..plans import c_parity
    from .flow import _rows

    schema = "source_id string, function_id int, name string, nodes array<int>, edges array<struct<src:int,dst:int>>, entry array<int>, exit array<int>, degenerate boolean"

    def make(tree):
        for number, f in enumerate(tree.functions()):
            b = c_parity.blocks(tree, f)
            yield {"function_id": number, "name": tree.name_of(f)} | b | {"edges": [{"src": s, "dst": d} for s, d in b["edges"]]}

    order = Window.partitionBy("source_id", "name").orderBy(F.size("nodes").desc(), "function_id")
    return scoreable(_rows(sources, schema, make, alike="parity_blocks")).withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


BLOCK_GRAPH = "struct<nodes:array<int>,edges:array<array<int>>,entry:array<int>,exit:array<int>,degenerate:boolean>"


def parity_json(blocks: DataFrame) -> DataFrame:
    """Adds `json`, a block graph as one line of JSON with its fields in a fixed order."""

    def numbers(name: str) -> Column:
        return F.concat(F.lit("["), F.array_join(F.col(name).cast("array<string>"), ","), F.lit("]"))

    edges = F.array_join(F.transform("edges", lambda e: F.concat(F.lit("["), e["src"].cast("string"), F.lit(","), e["dst"].cast("string"), F.lit("]"))), ",")
    fields = {"nodes": numbers("nodes"), "edges": F.concat(F.lit("["), edges, F.lit("]")), "entry": numbers("entry"), "exit": numbers("exit"), "degenerate": F.col("degenerate").cast("string")}
    return blocks.withColumn("json", F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}")))


def from_serialized(rows: DataFrame, key: str = "name") -> DataFrame:
    """`key, nodes, n_edges`, as `shapes` gives them, of block graphs in a column `json`.

    Nodes without edges stay; parallel edges are one; an edge of a node that isn't
    there fails the query; text that is no graph gives a null graph, left out here.
    """
    graph = rows.select(key, F.from_json("json", BLOCK_GRAPH).alias("g")).filter("g.nodes is not null")
    ties = graph.select(key, F.explode(F.array_distinct("g.edges")).alias("e")).select(key, F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))
    ends = ties.select(key, F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).groupBy(key, "x.n").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    nodes = graph.select(key, "g.entry", "g.exit", F.explode(F.array_distinct("g.nodes")).alias("n"))
    both = nodes.join(ends, [key, "n"], "full_outer").withColumn("n", F.when(F.col("entry").isNull(), F.raise_error(F.format_string("an edge names node %d, which isn't there", "n"))).otherwise(F.col("n")))
    shape = F.struct(F.coalesce("i", F.lit(0)).cast("int").alias("in"), F.coalesce("o", F.lit(0)).cast("int").alias("out"), F.array_contains("entry", F.col("n")).alias("is_entry"), F.array_contains("exit", F.col("n")).alias("is_exit"))
    return both.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", shape.alias("s")))), lambda x: x["s"]).alias("nodes"), F.coalesce(F.sum("o"), F.lit(0)).cast("int").alias("n_edges"))


def isomorphic(before: DataFrame, after: DataFrame, seconds: float = 2.0) -> DataFrame:
    """`name, isomorphic` of functions that two corpora have by name: whether one graph is the other with its nodes renamed, roles kept; null where the time is up."""
    sides = [best_by_name(x, "n_nodes").select("name", F.struct("roles", "edges").alias(k)) for x, k in ((_roles(before), "a"), (_roles(after), "b"))]
    pairs = sides[0].join(sides[1], "name")
    arrow = arrow_schema(pairs, "name string, isomorphic boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            found = []
            graphs = ([(f["roles"], f["edges"]) for f in batch.column(k).to_pylist()] for k in "ab")
            for pair in zip(*graphs, strict=True):
                if (same := True if pair[0] == pair[1] else known.get(pair)) is None:
                    (a, a_edges), (b, b_edges) = ((list(roles), list(struct.iter_unpack("<ii", edges))) for roles, edges in pair)
                    same = c_depend.isomorphic(a, a_edges, b, b_edges, seconds)
                    if len(known) >= PAIRS:
                        known.clear()
                    known[pair] = same
                found.append(same)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.bool_())], schema=arrow)

    return mapped(pairs, run, "name string, isomorphic boolean")


def _roles(functions: DataFrame | Unparsed) -> DataFrame:
    """`source_id, function_id, name, n_nodes, roles, edges`: numbers of nodes' kinds as bytes, ends of edges as pairs of four bytes."""

    def solve(nodes, edges, _):
        return [{"n_nodes": len(nodes), "roles": bytes(KINDS[n["kind"]] for n in nodes), "edges": b"".join(struct.pack("<ii", e["src"], e["dst"]) for e in edges)}]

    return per_function(functions, solve, "n_nodes int, roles binary, edges binary", alike="roles").withColumnRenamed("function", "name")


def resolve_for_units(blocks: DataFrame) -> DataFrame:
    """`unit, name, source_id, nodes`: each unit's own graph of a name, or the best of all units where its own is degenerate or missing."""
    order = Window.partitionBy("name").orderBy("degenerate", F.size("nodes").desc(), "source_id")
    best = blocks.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select("name", F.col("source_id").alias("best_id"), F.col("nodes").alias("best_nodes"))
    own = blocks.filter("not degenerate").select(F.col("source_id").alias("unit"), "name", F.col("nodes").alias("own_nodes"))
    units = blocks.select(F.col("source_id").alias("unit")).distinct()
    # every unit gets every name by contract: the product is the result's size
    every = units.join(best, F.lit(True))
    joined = every.join(own, ["unit", "name"], "left")
    return joined.select("unit", "name", F.when(F.col("own_nodes").isNull(), F.col("best_id")).otherwise(F.col("unit")).alias("source_id"), F.coalesce("own_nodes", "best_nodes").alias("nodes"))


def compare_versions(before: DataFrame, after: DataFrame, most: int | None = None) -> DataFrame:
    """`name, distance, approximated` of functions that two corpora have by name; of one name in a corpus the best graph counts."""
    a, b = shapes(best_by_name(before)), shapes(best_by_name(after))
    pairs = a.select(F.col("name").alias("pair_id"), F.col("nodes").alias("left"), F.col("n_edges").alias("left_edges")).join(
        b.select(F.col("name").alias("pair_id"), F.col("nodes").alias("right"), F.col("n_edges").alias("right_edges")), "pair_id")
    return similarity(pairs, most).withColumnRenamed("pair_id", "name")


def agreement(compared: DataFrame) -> DataFrame:
    """One row: functions compared, those without distance, the sum of distances, how many were approximated."""
    return compared.agg(F.count("*").alias("compared"), F.count_if(F.col("distance") == 0).alias("equal"), F.coalesce(F.sum("distance"), F.lit(0)).alias("total"), F.count_if("approximated").alias("approximated"))
