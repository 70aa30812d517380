"""The parse stage: one pass over each text in the executors, all products as nested columns."""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import c_alike, c_graph, c_measure
from .c_syntax import Tree

COUNTS = "lo hi parameters first_line last_line code_lines tokens n1 n2 N1 N2 cognitive max_nesting max_loop_depth statements ast_nodes calls short_circuits unreachable_statements".split()
NODE = "struct<id:int,kind:string,lo:int,hi:int,internal:boolean,live:boolean,ends:boolean>"
EDGE = "struct<ord:int,src:int,dst:int,kind:string,back:boolean>"
FUNCTION = (
    "struct<function_id:int,name:string,has_body:boolean,truncated:boolean,"
    + ",".join(f"`{'total_operators' if c == 'N1' else 'total_operands' if c == 'N2' else c}`:int" for c in COUNTS)
    + f",callees:array<string>,tag_counts:map<string,int>,cfg_nodes:array<{NODE}>,cfg_edges:array<{EDGE}>>"
)
TOKEN = "struct<idx:int,kind:string,lo:int,hi:int,line:int,lexeme:string>"
NOTE = "struct<severity:string,message:string,lo:int,hi:int>"
FILE = "lines code_lines blank_lines other_lines bytes".split()
SCHEMA = f"source_id string, functions array<{FUNCTION}>, " + ", ".join(f"{c} int" for c in FILE) + f", diagnostics array<{NOTE}>, tokens array<{TOKEN}>"


def ready(spark: SparkSession) -> None:
    """Let Python workers find this library where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with this library at hand in the workers."""
    ready(df.sparkSession)
    return df.mapInArrow(function, schema)


def grouped(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """groupBy(keys).applyInArrow with this library at hand in the workers."""
    ready(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(function, schema)


def written(df: DataFrame) -> DataFrame:
    """A copy of df in the shared checkpoint folder, so that rounds don't repeat those before them.

    The folder comes from ``spark.checkpoint.dir``; only a local session without that setting gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvina-checkpoint-"))
    return df.checkpoint(eager=True)


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


#: Measures of a function's graph, beside `COUNTS`.
GRAPH = "n_nodes n_edges reachable_nodes unreachable_nodes dead_end_nodes cyclomatic decision_points back_edges loops".split() + [f"nodes_{k}" for k in c_graph.NODE_KINDS]
WITHOUT_GRAPH = [c for c in COUNTS if c not in ("short_circuits", "unreachable_statements")]
#: Rows that a worker turns into one batch at most, and bytes of text: texts differ much in size.
BATCH, BATCH_BYTES = 64, 1 << 20


def portions(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches of few rows and of few bytes of text; one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < batch.num_rows:
            end = int(np.searchsorted(size, (size[k - 1] if k else 0) + BATCH_BYTES, side="right"))
            end = max(k + 1, min(end, k + BATCH))
            yield batch.slice(k, end - k)
            k = end


class Unparsed:
    """Sources whose graphs are wanted only inside one pass: operators on graphs solve there, so no graph leaves the worker."""

    def __init__(self, sources: DataFrame):
        self.sources = sources


def parse(sources: DataFrame, graphs: bool = True, tokens: bool = False) -> DataFrame:
    """One row per source: functions with measures and graphs, line counts, diagnostics, tokens on demand.

    Sources need `source_id, text`; a null text is empty.  No text fails.
    """
    schema = arrow_schema(sources, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = []
            for i, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                u = c_measure.unit(text or "", graphs, tokens)
                for f in u["functions"]:
                    f["total_operators"], f["total_operands"] = f.pop("N1"), f.pop("N2")
                rows.append(u | {"source_id": i})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, SCHEMA)


def measured(sources: DataFrame, graphs: bool = True) -> DataFrame:
    """One row per function with its measures alone, as flat columns; without `graphs` those of the graph are left out."""
    counts = [*COUNTS, *GRAPH] if graphs else WITHOUT_GRAPH
    named = {"total_operators": "N1", "total_operands": "N2"}
    whole = ["function_id", *("total_operators" if c == "N1" else "total_operands" if c == "N2" else c for c in counts)]
    schema = "source_id string, name string, has_body boolean, truncated boolean, " + ", ".join(f"{c} int" for c in whole) + ", callees array<string>, tag_counts map<string,int>"
    nested = (pa.list_(pa.string()), pa.map_(pa.string(), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, rows = [], []
            for i, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = c_measure.unit(text or "", "counts" if graphs else False)["functions"]
                ids += [i] * len(found)
                rows += found
            flat = [pa.array(ids, pa.string()), pa.array([r["name"] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], pa.bool_()) for c in ("has_body", "truncated"))]
            flat += [pa.array([r[named.get(c, c)] for r in rows], pa.int32()) for c in whole]
            flat += [pa.array([r["callees"] for r in rows], nested[0]), pa.array([list(r["tag_counts"].items()) for r in rows], nested[1])]
            yield pa.RecordBatch.from_arrays(flat, ["source_id", "name", "has_body", "truncated", *whole, "callees", "tag_counts"])

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, schema)


def totals(sources: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per source, after its columns in `keep`: how many functions, nodes and edges of their graphs, and diagnostics it has."""
    chosen = ["source_id", *(keep or [])]
    counted = "n_functions n_nodes n_edges n_diagnostics".split()

    def count(tree: Tree) -> np.ndarray:
        found = [c_graph.graph_of(tree, f) for f in tree.functions()]
        return np.array([len(found), sum(len(g.kinds) for g in found), sum(len(g.edges) for g in found), len(tree.notes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = c_alike.shared(("totals",), lambda tree: ([], count(tree)), numbers=True, early=True)
        for batch in portions(batches):
            rows = []
            for text in map(lambda t: t or "", batch.column("text").to_pylist()):
                # what follows the pieces that count is read by itself
                _, pieces, at = reader.begin(text)
                rows.append(sum((p.told for p in pieces), np.zeros(4, np.int64) if at == len(text) and pieces else count(Tree(text[at:]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in chosen), *(pa.array(c, pa.int64()) for c in np.array(rows).reshape(-1, 4).T)], [*chosen, *counted])

    types = dict(sources.dtypes) | {"source_id": "string"}
    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text", *(keep or [])), run, ", ".join(f"`{c}` {types[c]}" for c in chosen) + ", " + ", ".join(f"{c} long" for c in counted))


def file_lines(sources: DataFrame) -> DataFrame:
    """`source_id, lines, code_lines, blank_lines, other_lines, bytes` of each source: tokens only, no parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = [c_measure.lines_only(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), *(pa.array([r[c] for r in rows], pa.int32()) for c in FILE)], ["source_id", *FILE])

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, "source_id string, " + ", ".join(f"{c} int" for c in FILE))


def functions(units: DataFrame) -> DataFrame:
    """One row per function, measures as columns."""
    return units.select("source_id", F.explode("functions").alias("f")).select("source_id", "f.*")


def cfg_nodes(units: DataFrame) -> DataFrame:
    return functions(units).select("source_id", "function_id", F.col("name").alias("function"), F.explode("cfg_nodes").alias("n")).select("source_id", "function_id", "function", "n.*")


def cfg_edges(units: DataFrame) -> DataFrame:
    return functions(units).select("source_id", "function_id", F.col("name").alias("function"), F.explode("cfg_edges").alias("e")).select("source_id", "function_id", "function", "e.*")


def tokens(units: DataFrame) -> DataFrame:
    return units.select("source_id", F.explode("tokens").alias("t")).select("source_id", "t.*")


def diagnostics(units: DataFrame) -> DataFrame:
    return units.select("source_id", F.explode("diagnostics").alias("d")).select("source_id", "d.*")


#: Rows that `told` gives in one batch, about, and bytes of text that it reads for one.
TOLD, TOLD_BYTES = 100_000, 8 << 20


def told(sources: DataFrame, solve, fields: str, nested: bool = False, given: list[str] | None = None) -> DataFrame:
    """`source_id, function_id, function` and rows of `solve(text)`, which gives a name and a list of tuples for each function of a text.

    A list that is given again is turned into columns once a batch.  `nested` gives a row
    for each function, with its tuples as an array `found`; columns `given` go to `solve`, behind the text.
    """
    schema = "source_id string, function_id int, function string, " + (f"found array<struct<{fields}>>" if nested else fields)
    arrow, flat, given = arrow_schema(sources, schema), arrow_schema(sources, fields), given or []

    def batch(heads: list[tuple], places: list[tuple[int, int]], rows: list[tuple]) -> pa.RecordBatch:
        starts, sizes = np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64)
        ends = np.cumsum(sizes)
        wanted = pa.array(np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(flat)
        own = [pa.array(c, f.type).take(wanted) for c, f in zip(columns, flat, strict=True)]
        first = [pa.array(c, f.type) for c, f in zip(zip(*heads, strict=True) if heads else [()] * 3, list(arrow)[:3], strict=True)]
        if nested:
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            own = [pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(own, fields=list(arrow[3].type.value_type))).cast(arrow[3].type)]
        else:
            each = pa.array(np.repeat(np.arange(len(heads)), sizes), pa.int64())
            first = [c.take(each) for c in first]
        return pa.RecordBatch.from_arrays([*first, *own], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            heads, places, rows, known, made, read = [], [], [], {}, 0, 0
            columns = [held.column(c).to_pylist() for c in ("source_id", "text", *given)]
            for i, text, *more in zip(*columns, strict=True):
                for k, (name, found) in enumerate(solve(text or "", *more)):
                    if id(found) not in known:
                        known[id(found)] = (found, len(rows))
                        rows += found
                    heads.append((i, k, name))
                    places.append((known[id(found)][1], len(found)))
                    made += len(found)
                read += len(text or "")
                if made + len(heads) > TOLD or read > TOLD_BYTES:
                    yield batch(heads, places, rows)
                    heads, places, rows, known, made, read = [], [], [], {}, 0, 0
            yield batch(heads, places, rows)

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text", *given), run, schema)


def alike(key: tuple, find: Callable[[Tree], list[tuple[str, list[tuple]]]], numbers: bool = True, whole: bool = False) -> Callable[[str], list[tuple[str, list[tuple]]]]:
    """`solve` for `told` that finds the same lists for functions that are alike (`plans.c_alike`); `key` names what `find` does.

    `find` gives a name and a list for each function, from its syntax alone (`whole`: from
    the text's); `numbers` says that no decimal number's value counts.
    """

    def make(tree: Tree) -> tuple[list[dict], None]:
        return [{"function": name, "found": found} for name, found in find(tree)], None

    def solve(text: str) -> list[tuple[str, list[tuple]]]:
        read = c_alike.shared(key, make, numbers=numbers, whole=whole, early=True).read(text)
        return [(r["function"], r["found"]) for r in (read[0] if read else make(Tree(text))[0])]

    return solve


def counted(sources: DataFrame, count: Callable[[Tree], Iterator[tuple]], columns: list[str], key: str) -> DataFrame:
    """`columns, n`: how often `count(tree)` gives each tuple over all sources; only sums leave a task.

    `key` names what `count` does: it looks at one function after the other, and at no
    decimal number's value, so pieces that are alike are counted once a worker.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", n long"
    arrow = arrow_schema(sources, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = c_alike.shared(("counted", key), lambda tree: ([], Counter(count(tree))), numbers=True, early=True)
        total: Counter = Counter()
        for batch in batches:
            met: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if read := reader.read(text or ""):
                    met.update(read[1])
                else:
                    total.update(count(Tree(text or "")))
            for piece, times in met.items():
                for k, n in piece.told.items():
                    total[k] += n * times
        rows = [(*k, n) for k, n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow, strict=True)], schema=arrow)

    return mapped(sources.select("text"), run, schema).groupBy(*columns).agg(F.sum("n").alias("n"))


def token_kinds(sources: DataFrame) -> DataFrame:
    """`kind, n`: how many tokens of each kind the sources have."""
    return counted(sources, lambda tree: ((t.kind,) for t in tree.tokens), ["kind"], "token_kinds")
