"""Syntax trees, loop bounds, stated facts, diagnostics with excerpts, identities and provenance, as tables."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import c_loops
from ..plans.c_syntax import Node, Tree
from ..plans.c_tokens import Positions
from ..plans.stage import arrow_schema, counted, mapped, portions
from .flow import _rows

NODE = "node int, parent int, child_ix int, tag string, lo int, hi int, subtree_end int"
# Seeds and factors of the two byte hashes of a source's identity.
SEEDS = (0xCBF29CE484222325, 0x84222325CBF29CE4)
FACTORS = (0x00000100000001B3, 0x00000100000001E7)


def ast_nodes(sources: DataFrame) -> DataFrame:
    """One row per syntax node in preorder: a subtree is the nodes from `node` up to `subtree_end`."""

    def make(tree: Tree, _):
        where = Positions(tree.text)
        for number, f in enumerate(tree.functions()):
            rows: list[dict] = []
            stack: list[tuple[Node | int, int | None, int]] = [(f, None, 0)]
            while stack:
                node, parent, ix = stack.pop()
                if isinstance(node, int):
                    rows[node]["subtree_end"] = len(rows)
                    continue
                lo, hi = tree.span(node)
                here = len(rows)
                rows.append({"function_id": number, "node": here, "parent": parent, "child_ix": ix, "tag": node.tag, "lo": where.byte(lo), "hi": where.byte(hi), "subtree_end": here + 1})
                stack.append((here, None, 0))
                stack += [(k, here, i) for i, k in reversed(list(enumerate(node.kids)))]
            yield from rows

    return _rows(sources, f"source_id string, function_id int, {NODE}", make)


def loop_bounds(sources: DataFrame) -> DataFrame:
    """One row per loop: `bound_kind` constant, parameter, runtime or none, and what decides it."""
    schema = "source_id string, function_id int, function string, loop string, lo int, hi int, bound_kind string, induction string, start long, bound string, step long"

    def make(tree: Tree, _):
        where = Positions(tree.text)
        for number, f in enumerate(tree.functions()):
            for x in c_loops.loops(tree, f):
                lo, hi = x.pop("span")
                yield {"function_id": number, "function": tree.name_of(f), "lo": where.byte(lo), "hi": where.byte(hi)} | x

    return _rows(sources, schema, make)


def loop_counts(sources: DataFrame) -> DataFrame:
    """`loop, bound_kind, n`: how many loops of each kind, and with bounds of each kind, the sources have."""

    def count(tree: Tree) -> Iterator[tuple]:
        return ((x["loop"], x["bound_kind"]) for f in tree.functions() for x in c_loops.loops(tree, f))

    return counted(sources, count, ["loop", "bound_kind"], "loop_counts")


def facts(sources: DataFrame, given: list[dict] | None = None, marker: str = c_loops.MARKER) -> DataFrame:
    """Facts that comments and `given` (a short list, sent with the tasks) state; refused ones have a `problem`."""
    schema = "source_id string, function_id int, function string, kind string, parameter string, value string, origin string, problem string"

    def make(tree: Tree, _):
        found, problems = c_loops.facts(tree, given, marker)
        yield from found
        yield from ({"problem": p["message"]} for p in problems)

    return _rows(sources, schema, make)


def rendered(text: str, severity: str, message: str, lo: int, hi: int) -> str:
    """A diagnostic with the line it stands on and carets below; lo and hi are code points."""
    start = text.rfind("\n", 0, lo) + 1
    end = text.find("\n", lo)
    line = text[start : end if end >= 0 else len(text)]
    number = text.count("\n", 0, lo) + 1
    width = max(1, min(hi, start + len(line)) - lo)
    return f"{severity}: {message}\n {number} | {line}\n {' ' * len(str(number))} | {' ' * (lo - start)}{'^' * width}"


def diagnostics(sources: DataFrame) -> DataFrame:
    """Diagnostics with rendered excerpts."""
    schema = "source_id string, severity string, message string, lo int, hi int, text string"

    def make(tree: Tree, _):
        where = Positions(tree.text)
        for n in sorted(tree.notes, key=lambda n: (n.lo, n.hi)):
            yield {"severity": n.severity, "message": n.message, "lo": where.byte(n.lo), "hi": where.byte(n.hi), "text": rendered(tree.text, n.severity, n.message, n.lo, n.hi)}

    return _rows(sources, schema, make)


def identity(text: str) -> str:
    """Two 64-bit hashes of a text's bytes and its length: tells snapshots apart, protects nothing."""
    data = text.encode("utf-8", "surrogatepass")
    hashes = []
    for seed, factor in zip(SEEDS, FACTORS, strict=True):
        h = seed
        for byte in data:
            h = ((h ^ byte) * factor) & 0xFFFFFFFFFFFFFFFF
        hashes.append(f"{h:016x}")
    return f"{''.join(hashes)}-{len(data)}"


def provenance(functions: DataFrame, original_names: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """`name, origin, recovery_qualified` of each name: found in the original text or made by expansion; the largest body of a name counts."""
    order = Window.partitionBy("source_id", "name").orderBy((F.col("hi") - F.col("lo")).desc(), "function_id")
    largest = functions.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select("source_id", "function_id", "name", "lo", "hi")
    known = original_names.select("source_id", "name").distinct().withColumn("known", F.lit(True))
    touched = largest.join(diagnostics.select("source_id", F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi")), "source_id").filter("d_lo <= hi and d_hi >= lo").select("source_id", "function_id").distinct().withColumn("touched", F.lit(True))
    both = largest.join(known, ["source_id", "name"], "left").join(touched, ["source_id", "function_id"], "left")
    return both.select("source_id", "name", F.when(F.col("known"), "source").otherwise("generated").alias("origin"), F.coalesce("touched", F.lit(False)).alias("recovery_qualified"))


#: Directives that decide what a text says; headers are never read, so a text that only includes needs no preprocessor.
DECISIVE = frozenset("define undef if ifdef ifndef elif else endif".split())
PREPROCESSED = "text string, status string, compiler string, command array<string>, stderr string, includes_removed boolean"


def _directives(lines: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first line, line after the last, name) of each directive, continued lines included."""
    at = 0
    while at < len(lines):
        first, at = at, at + 1
        head = lines[first].lstrip(" \t")
        if head.startswith("#"):
            while lines[at - 1].rstrip("\r").endswith("\\") and at < len(lines):
                at += 1
            name = head[1:].lstrip(" \t")
            end = next((k for k, c in enumerate(name) if not (c.isalnum() or c == "_")), len(name))
            yield first, at, name[:end]


def _expanded(compiler: str, text: str, timeout: float) -> dict:
    """What a compiler's preprocessor makes of a text that it reads from its standard input."""
    command = [compiler, "-E", "-P", "-x", "c", "-"]
    report = {"compiler": compiler, "command": command}
    try:
        ended = subprocess.run(command, input=text.encode("utf-8", "replace"), capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return report | {"status": "timed-out", "stderr": f"no end within {timeout:g} seconds"}
    except OSError as error:
        return report | {"status": "failed", "stderr": str(error)}
    made, said = (x.decode("utf-8", "replace") for x in (ended.stdout, ended.stderr))
    if ended.returncode == 0 and made.strip():
        return report | {"status": "preprocessed", "text": made, "stderr": said.strip()}
    return report | {"status": "failed", "stderr": said.strip() or f"exit code {ended.returncode}, no output"}


def preprocess_one(text: str, compiler: str | None = None, timeout: float = 30.0) -> dict:
    """A text after the host's C preprocessor, without its includes; `status` is one of

    not-needed (no directive that decides anything), unavailable (no compiler),
    timed-out, failed, preprocessed; with all but the last the text is as it was.
    """
    lines = text.split("\n") if "#" in text else []
    found = list(_directives(lines))
    kept = {"text": text, "compiler": None, "command": [], "stderr": "", "includes_removed": False}
    if DECISIVE.isdisjoint(name for _, _, name in found):
        return kept | {"status": "not-needed"}
    path = next(filter(None, map(shutil.which, [compiler] if compiler else ["gcc", "cc"])), None)
    if path is None:
        return kept | {"status": "unavailable", "stderr": f"no {compiler or 'C compiler'} on this host"}
    for first, end, name in found:
        if name == "include":
            lines[first:end] = [""] * (end - first)
            kept["includes_removed"] = True
    return kept | _expanded(path, "\n".join(lines), timeout)


def _per_text(sources: DataFrame, schema: str, make) -> DataFrame:
    """One row of `make(text)` for each source; the text isn't parsed."""
    arrow = arrow_schema(sources, f"source_id string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = [{"source_id": i} | make(t or "") for i, t in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, f"source_id string, {schema}")


def preprocess(sources: DataFrame, compiler: str | None = None, timeout: float = 30.0) -> DataFrame:
    """Outcome of preprocessing each source on the executors: `text, status, compiler, command, stderr, includes_removed`."""
    return _per_text(sources, PREPROCESSED, lambda text: preprocess_one(text, compiler, timeout))


def identities(sources: DataFrame) -> DataFrame:
    """`source_id, identity` of each source."""
    return _per_text(sources, "identity string", lambda text: {"identity": identity(text)})


def line_column(offset: Column, starts: Column) -> Column:
    """struct(line, column), both from 1, of a byte offset, given the sorted byte offsets at which lines begin."""
    line = F.size(F.filter(starts, lambda s: s <= offset))
    return F.struct(line.alias("line"), (offset - F.element_at(starts, line) + 1).alias("column"))
