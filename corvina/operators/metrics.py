"""Measures of functions and files, and reports made of them: all in DataFrame functions over the parse stage's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.c_graph import NODE_KINDS
from ..plans.stage import GRAPH

# Measures that can be ranked, and those compared by default.
RANKABLE = (
    "cyclomatic cognitive max_nesting max_loop_depth lines code_lines tokens statements calls parameters decision_points loops unreachable_statements halstead_volume halstead_difficulty halstead_effort"
).split()
COMPARED = "cyclomatic cognitive max_nesting gotos unreachable_statements lines statements".split()
# The feature vector's columns, in order.
FEATURES = (
    "lines code_lines tokens bytes parameters cfg_nodes cfg_edges reachable_nodes dead_end_nodes cyclomatic decision_points back_edges loops max_nesting max_loop_depth cognitive calls statements "
    "ast_nodes short_circuits unreachable_statements halstead_distinct_operators halstead_distinct_operands halstead_total_operators halstead_total_operands halstead_vocabulary halstead_length "
    "halstead_volume halstead_difficulty halstead_effort"
).split() + [f"nodes_{k}" for k in NODE_KINDS]


GRAPH_COLUMNS = [{"n_nodes": "cfg_nodes", "n_edges": "cfg_edges"}.get(c, c) for c in GRAPH]


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _of_kind(items: Column, kind: str) -> Column:
    return _count(items, lambda n: n["kind"] == kind)


def graph_metrics(functions: DataFrame) -> DataFrame:
    """Adds graph measures from the arrays `cfg_nodes` and `cfg_edges`; no shuffle, as each function is one row."""
    nodes, edges = F.col("cfg_nodes"), F.col("cfg_edges")
    live = F.transform(F.filter(nodes, lambda n: n["live"]), lambda n: n["id"])
    n_live = _count(nodes, lambda n: n["live"])
    # an edge from a live node ends in a live node
    sources = F.filter(F.transform(edges, lambda e: e["src"]), lambda s: F.element_at(nodes, s + 1)["live"])
    inside = F.size(sources)
    forks = F.size(sources) - F.size(F.array_distinct(sources))
    return functions.select(
        "*", F.size(nodes).alias("n_nodes"), F.size(edges).alias("n_edges"), n_live.alias("reachable_nodes"), (F.size(nodes) - F.size(live)).alias("unreachable_nodes"),
        _count(nodes, lambda n: n["live"] & ~n["ends"]).alias("dead_end_nodes"), F.greatest(F.lit(1), inside - n_live + 2).alias("cyclomatic"), forks.alias("decision_points"),
        _count(edges, lambda e: e["back"]).alias("back_edges"), F.size(F.array_distinct(F.transform(F.filter(edges, lambda e: e["back"]), lambda e: e["dst"]))).alias("loops"),
        *[_of_kind(nodes, k).alias(f"nodes_{k}") for k in NODE_KINDS],
    )


def measures(functions: DataFrame) -> DataFrame:
    """All measures of functions as flat columns, from rows with graphs or from `stage.measured`; without its graph measures these are left out."""
    rows = graph_metrics(functions).drop("cfg_nodes", "cfg_edges") if "cfg_nodes" in functions.columns else functions
    rows = rows.withColumnRenamed("n_nodes", "cfg_nodes").withColumnRenamed("n_edges", "cfg_edges")
    vocabulary, length = F.col("n1") + F.col("n2"), F.col("total_operators") + F.col("total_operands")
    volume = F.when(vocabulary == 0, F.lit(0.0)).otherwise(length * F.log2(vocabulary.cast("double")))
    difficulty = F.when(F.col("n2") == 0, F.lit(0.0)).otherwise(F.col("n1") / 2.0 * (F.col("total_operands") / F.greatest(F.col("n2"), F.lit(1))))
    made = rows.select("*", *[F.lit(None).cast("int").alias(c) for c in (*GRAPH_COLUMNS, "short_circuits", "unreachable_statements") if c not in rows.columns])
    whole = made.select(
        "source_id", "function_id", "name", "first_line", "last_line", (F.col("last_line") - F.col("first_line") + 1).alias("lines"), "code_lines", "tokens", (F.col("hi") - F.col("lo")).alias("bytes"),
        "parameters", "cfg_nodes", "cfg_edges", "reachable_nodes", "unreachable_nodes", "dead_end_nodes", "cyclomatic", "decision_points", "back_edges", "loops", "max_nesting", "max_loop_depth", "cognitive",
        "calls", "callees", "statements", "ast_nodes", "short_circuits", "unreachable_statements", "has_body", "truncated", "tag_counts",
        F.col("n1").alias("halstead_distinct_operators"), F.col("n2").alias("halstead_distinct_operands"), F.col("total_operators").alias("halstead_total_operators"),
        F.col("total_operands").alias("halstead_total_operands"), vocabulary.alias("halstead_vocabulary"), length.alias("halstead_length"), volume.alias("halstead_volume"),
        difficulty.alias("halstead_difficulty"), (difficulty * volume).alias("halstead_effort"), *[f"nodes_{k}" for k in NODE_KINDS],
        F.col("nodes_goto").alias("gotos"), (F.col("nodes_goto") == 0).alias("is_structured"),
    )
    return whole if "cfg_nodes" in rows.columns else whole.drop(*GRAPH_COLUMNS, "short_circuits", "unreachable_statements", "gotos", "is_structured")


def features(measured: DataFrame) -> DataFrame:
    """The feature vector of each function, doubles in fixed order."""
    return measured.select("source_id", "function_id", "name", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def _known(metric: str, allowed: list[str]) -> str:
    if metric not in allowed:
        raise ValueError(f"unknown measure {metric!r}; one of {', '.join(allowed)}")
    return metric


def hotspots(measured: DataFrame, by: str = "cyclomatic", limit: int | None = None) -> DataFrame:
    """Functions by a measure, the largest first, then by name; a limit makes it a top-k that each task takes part in."""
    _known(by, RANKABLE)
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    ranked = measured.orderBy(F.col(by).desc(), "name", "source_id", "function_id")
    return ranked if limit is None else ranked.limit(limit)


def summary(measured: DataFrame) -> DataFrame:
    """`metric, min, median, mean, max` over all functions; no rows without functions."""
    stacked = measured.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in RANKABLE])).alias("x")).select("x.*")
    return stacked.groupBy("metric").agg(F.min("v").alias("min"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.max("v").alias("max"))


def totals(measured: DataFrame) -> DataFrame:
    """One row: counts of functions and structured functions, sums of gotos and unreachable statements."""
    return measured.agg(
        F.count("*").alias("functions"), F.count_if("is_structured").alias("structured_functions"), F.coalesce(F.sum("gotos"), F.lit(0)).alias("gotos"),
        F.coalesce(F.sum("unreachable_statements"), F.lit(0)).alias("unreachable_statements"),
    )


def _once(count: Column, name: Column, value: Column) -> Column:
    """The value, or an error that names a function which is defined twice."""
    return F.when(count > 1, F.raise_error(F.concat(F.lit("function '"), name, F.lit("' is defined more than once")))).otherwise(value)


def call_graph(functions: DataFrame, strict: bool = True) -> DataFrame:
    """`caller, callee` of directly named calls; strict: a name that is defined twice fails the query."""
    if not strict:
        return functions.select(F.col("name").alias("caller"), F.explode("callees").alias("callee")).distinct()
    named = functions.groupBy("name").agg(F.count("*").alias("n"), F.first("callees").alias("callees"))
    return named.select(F.col("name").alias("caller"), F.explode(_once(F.col("n"), F.col("name"), F.col("callees"))).alias("callee"))


def defined_names(functions: DataFrame) -> DataFrame:
    return functions.select("name").distinct()


def compare(before: DataFrame, after: DataFrame, metrics: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Functions of two reports by name: `name, status, before_<m>, after_<m>, delta_<m>, largest`.

    status is matched, added or removed; `largest` is the greatest absolute delta.
    Unknown and repeated measures raise ValueError, a name that repeats on a side fails
    the query.  `ordered`: the largest first, then by name.
    """
    metrics = list(COMPARED if metrics is None else metrics)
    for m in metrics:
        _known(m, [*RANKABLE, "gotos"])
    if len({*metrics}) < len(metrics):
        raise ValueError("a measure is named twice")
    sides = [side.select("name", F.lit(k).alias("side"), *metrics) for k, side in enumerate((before, after))]
    seen = [F.count_if(F.col("side") == k).alias(f"n_{k}") for k in (0, 1)]
    values = [F.max(F.when(F.col("side") == k, F.col(m))).alias(f"{n}_{m}") for m in metrics for k, n in enumerate(("before", "after"))]
    both = sides[0].unionByName(sides[1]).groupBy("name").agg(*seen, *values)
    most = F.greatest("n_0", "n_1")
    status = F.when(F.col("n_0") == 0, "added").when(F.col("n_1") == 0, "removed").otherwise("matched")
    deltas = [(F.col(f"after_{m}") - F.col(f"before_{m}")).alias(f"delta_{m}") for m in metrics]
    both = both.select("name", _once(most, F.col("name"), status).alias("status"), *[c for m in metrics for c in (f"before_{m}", f"after_{m}")], *deltas)
    largest = reduce(F.greatest, [F.abs(F.col(f"delta_{m}")) for m in metrics], F.lit(0)) if metrics else F.lit(0)
    made = both.select("*", F.when(F.col("status") == "matched", largest).alias("largest"))
    return made.orderBy(F.col("largest").desc_nulls_last(), "name") if ordered else made


def compare_totals(compared: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Sums over matched functions: `metric, before, after, delta`."""
    metrics = list(COMPARED if metrics is None else metrics)
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"before_{m}").cast("long").alias("b"), F.col(f"after_{m}").cast("long").alias("a")) for m in metrics])
    rows = compared.filter("status = 'matched'").select(F.explode(items).alias("x")).select("x.*")
    return rows.groupBy("metric").agg(F.sum("b").alias("before"), F.sum("a").alias("after"), (F.sum("a") - F.sum("b")).alias("delta"))
