"""Names and what they stand for: a table of declarations with what sees them, one of uses, and their interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.c_symbols import Symbols
from ..plans.c_syntax import Tree
from ..plans.c_tokens import Positions
from .flow import _rows

ROW = "source_id string, what string, name string, kind string, lo int, hi int, begins int, ends int, depth int, function_id int"


def index(sources: DataFrame) -> DataFrame:
    """Rows of what `declared` and `used`: `begins` and `ends` bound the text that sees a declaration; depth 0 is the file, 1 parameters.  Places are bytes."""

    def make(tree: Tree):
        found, where = Symbols(tree), Positions(tree.text)
        size = len(tree.tokens)

        def byte(token: int) -> int:
            return where.byte(tree.tokens[token].lo if token < size else len(tree.text))

        for name, kind, at, begin, end, depth, function in found.declared:
            yield {"what": "declared", "name": name, "kind": kind, "lo": byte(at), "hi": where.byte(tree.tokens[at].hi), "begins": byte(begin), "ends": byte(end), "depth": depth, "function_id": function}
        for name, at, function in found.used:
            yield {"what": "used", "name": name, "lo": byte(at), "hi": where.byte(tree.tokens[at].hi), "function_id": function}

    return _rows(sources, ROW, make, alike="symbols", whole=True)


def resolved_within(sources: DataFrame) -> DataFrame:
    """What `resolved` gives for the sources' `index`, in one pass over each text: names never leave their source."""

    def make(tree: Tree):
        found, where = Symbols(tree), Positions(tree.text)
        known: dict[str, list] = {}
        for name, kind, at, begin, end, depth, _ in found.declared:
            known.setdefault(name, []).append((depth, at, begin, end, kind))
        for (name, at), function in {(name, at): function for name, at, function in reversed(found.used)}.items():
            depth, declared, _, _, kind = max((d for d in known.get(name, ()) if d[2] <= at < d[3]), default=(None,) * 5)
            token = tree.tokens[at]
            yield {
                "function_id": function, "name": name, "lo": where.byte(token.lo), "hi": where.byte(token.hi), "kind": kind, "depth": depth,
                "declared_lo": None if declared is None else where.byte(tree.tokens[declared].lo),
            }

    return _rows(sources, "source_id string, function_id int, name string, lo int, hi int, kind string, depth int, declared_lo int", make, alike="resolved", whole=True)


def resolved(rows: DataFrame) -> DataFrame:
    """`source_id, function_id, name, lo, hi, kind, depth, declared_lo` of each use, from `index` rows; null kind: nothing declares it.

    Of the declarations that see a use the innermost wins, of one scope the last.
    """
    keys = ["source_id", "name"]
    used = rows.filter("what = 'used'").select(*keys, "function_id", "lo", "hi")
    known = rows.filter("what = 'declared'").select(*keys, F.col("lo").alias("declared_lo"), "kind", "depth", "begins", "ends")
    seen = used.join(known, [*(used[k] == known[k] for k in keys), known.begins <= used.lo, used.lo < known.ends], "left").select(used["*"], "kind", "depth", "declared_lo")
    inner = Window.partitionBy(*keys, "lo").orderBy(F.desc("depth"), F.desc("declared_lo"))
    return seen.withColumn("first", F.row_number().over(inner)).filter("first = 1").select("source_id", "function_id", "name", "lo", "hi", "kind", "depth", "declared_lo")
