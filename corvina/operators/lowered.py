"""Expressions as typed operations: whole lists, the order between them, and a view for export with stated facts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import c_loops, c_lower, c_views
from ..plans.stage import arrow_schema, mapped, portions
from .exports import FORMATS, _attrs

KEYS = ["source_id", "function_id"]
OPERATION = (
    "struct<id:int,kind:string,op:string,type:string,inputs:array<int>,block:int,root:int,guards:array<struct<id:int,holds:boolean>>,lo:int,hi:int,line:int,"
    "`from`:string,`to`:string,operand_type:string,access:string,name:string,declared_lo:int,declared_hi:int,formal:boolean,member:string,argument_conversions:string,reason:string>"
)
SCHEMA = f"source_id string, function_id int, function string, operations array<{OPERATION}>, orders array<struct<first:int,second:int,kind:string>>"


def lowered(sources: DataFrame) -> DataFrame:
    """One row per function: its operations and the order pairs between them.

    Operations stand in an order of evaluation, so inputs have smaller ids.  Kinds of
    order are sequenced (the first is done before the second begins), indeterminate
    (either comes first) and exclusive (never both).  A root that isn't lowered is one
    operation of kind unknown with a reason.
    """

    arrow = arrow_schema(sources, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = []
            for i, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [{"source_id": i} | f for f in c_lower.functions(text or "")]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, SCHEMA)


def operations(functions: DataFrame) -> DataFrame:
    """`lowered` rows as one row per operation."""
    return functions.select(*KEYS, "function", F.explode("operations").alias("o")).select(*KEYS, "function", "o.*")


def orders(functions: DataFrame) -> DataFrame:
    """`lowered` rows as one row per order pair."""
    return functions.select(*KEYS, "function", F.explode("orders").alias("o")).select(*KEYS, "function", "o.*")


def facts_of_accesses(functions: DataFrame, facts: DataFrame) -> DataFrame:
    """`source_id, function_id, id, facts, facts_source`: what `annotations.facts` rows state of the parameter that a load or store names.

    Joined by the declaration: a local variable of a parameter's name has none.
    """
    told = facts.filter("problem is null and parameter is not null").groupBy(*KEYS, F.col("parameter").alias("name"))
    each = F.sort_array(F.collect_list(F.struct(F.concat_ws("=", "kind", "value").alias("fact"), "origin")))
    told = told.agg(each.alias("x")).select(*KEYS, "name", F.array_join("x.fact", ",").alias("facts"), F.array_join(F.array_distinct("x.origin"), ",").alias("facts_source"))
    return operations(functions).filter("kind in ('load', 'store') and formal").join(told, [*KEYS, "name"]).select(*KEYS, "id", "facts", "facts_source")


def _guard(guards: Column) -> Column:
    return F.array_join(F.transform(guards, lambda g: F.concat(g["id"].cast("string"), F.when(g["holds"], ":true").otherwise(":false"))), ",")


def views(functions: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Operations as graph views for `exports.render`: an edge from each value to what takes it, with its place among the inputs."""
    every = functions
    if facts is not None:
        found = facts_of_accesses(functions, facts).groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("facts", "facts_source")))).alias("told"))
        every = functions.join(found, KEYS, "left")
    else:
        every = functions.withColumn("told", F.lit(None).cast("map<int,struct<facts:string,facts_source:string>>"))

    def attrs(o: Column) -> Column:
        always = {"kind": o["kind"], "op": o["op"], "type": o["type"], "inputs": F.array_join(o["inputs"].cast("array<string>"), ","), "block": F.coalesce(o["block"].cast("string"), F.lit("")), "root": F.coalesce(o["root"].cast("string"), F.lit("")), "guarded_by": _guard(o["guards"]), "span": F.concat_ws(":", o["lo"], o["hi"]), "line": o["line"]}
        declared = F.when(o["declared_lo"].isNotNull(), F.concat_ws(":", o["declared_lo"], o["declared_hi"]))
        some = {c: o[c] for c in ("operand_type", "from", "to", "access", "name", "member", "argument_conversions", "reason")} | {"declared": declared} | {c: F.col("told")[o["id"]][c] for c in ("facts", "facts_source")}
        return F.filter(F.concat(_attrs(**always), _attrs(**some)), lambda a: a["v"].isNotNull())

    nodes = F.transform("operations", lambda o: F.struct(o["id"].alias("id"), F.concat_ws(" ", o["kind"], o["op"]).alias("label"), attrs(o).alias("attrs")))
    edges = F.flatten(F.transform("operations", lambda o: F.transform(o["inputs"], lambda v, i: F.struct(v.alias("src"), o["id"].alias("dst"), F.lit("").alias("label"), _attrs(index=i).alias("attrs")))))
    return every.select(*KEYS, F.col("function").alias("name"), nodes.alias("nodes"), edges.alias("edges"))


#: Bytes of texts that leave a worker in one batch, about.
WRITTEN = 8 << 20


def rendered(sources: DataFrame, fmt: str, marker: str = c_loops.MARKER) -> DataFrame:
    """`source_id, function_id, name, text`: what `exports.render` gives for the `views` of the sources' operations with the facts that comments state, in one pass over each text."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    schema = "source_id string, function_id int, name string, text string"
    arrow = arrow_schema(sources, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 4, arrow, strict=True)], schema=arrow)

        for held in batches:
            rows, size = [], 0
            for i, text in zip(held.column("source_id").to_pylist(), held.column("text").to_pylist(), strict=True):
                for k, (name, made) in enumerate(c_views.rendered(text or "", fmt, marker)):
                    rows.append((i, k, name, made))
                    size += len(made)
                    if size > WRITTEN:
                        yield batch()
                        rows, size = [], 0
            yield batch()

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, schema)
