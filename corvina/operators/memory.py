"""Memory: what pointers refer to, regions and which of them overlap, and what reaches reads through memory.

The parse gives each function's steps (`plans.c_memory`).  The targets of pointers are a
closure without regard to order (`plans.c_targets`): a function's steps stand in one row,
so it is solved where the row is, without rounds or shuffles.  What follows is joins
over the regions of all functions at once.  Reads and writes then fall on regions; a write whose pointer has one
known target that is one object ends what was there, any other is weak.  Functions
that the text calls and defines stand in for their calls by what they do to what
their parameters refer to; calls of others may write all that their arguments reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import c_flows, c_memory, c_targets
from ..plans.c_flows import reached
from ..plans.stage import arrow_schema, mapped, portions, told, written

KEYS = ["source_id", "function_id"]
STEP = "struct<ord:int,op:string,dst:string,src:string,path:string,at:int,node:int,number:int,callee:string>"
SCHEMA = f"source_id string, function_id int, function string, n_nodes int, steps array<{STEP}>, edges array<struct<src:int,dst:int>>, unions array<string>, locals array<string>"
UNKNOWN = c_targets.UNKNOWN


#: Rows that leave a worker in one batch, about.
ROWS = 5_000


def _batches(rows: Iterator[dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches: one for each function would cost more than what is in it."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    yield pa.RecordBatch.from_pylist(held, arrow)


def steps(sources: DataFrame) -> DataFrame:
    """One row per function: steps, edges of the graph, unions."""
    arrow = arrow_schema(sources, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            rows = []
            for i, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [{"source_id": i, "function_id": k} | r for k, r in enumerate(c_memory.functions(text or ""))]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, SCHEMA)


def _flat(functions: DataFrame) -> DataFrame:
    return functions.select(*KEYS, F.explode("steps").alias("s")).select(*KEYS, "s.*")


def points_to(functions: DataFrame) -> DataFrame:
    """`source_id, function_id, place, target` of every place that may hold a pointer; target "?" is anything.

    Parameters that are pointers begin with the region of their own, "*p".  Memory that
    comes from outside, or that outsiders may have written, holds "?" as well; so do
    members and elements of which no pointer is known.  Each function ends by itself:
    paths that repeat a member fold into one region, "*p.in+", and very many targets
    within one variable into all of it, "*p+".
    """
    schema = "source_id string, function_id int, place string, target string"
    arrow = arrow_schema(functions, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    # a step that is there twice says nothing more
                    said = tuple(dict.fromkeys(tuple(s.values()) for s in row["steps"] or ()))
                    for place, target in c_targets.solved(said, frozenset(row["locals"] or ()), tuple(row["unions"] or ())):
                        yield {"source_id": row["source_id"], "function_id": row["function_id"], "place": place, "target": target}

        return _batches(rows(), arrow)

    said = F.transform("steps", lambda s: F.struct(s["op"].alias("op"), s["dst"].alias("dst"), s["src"].alias("src"), s["path"].alias("path")))
    return mapped(functions.select(*KEYS, said.alias("steps"), "locals", "unions"), run, schema)


def _fallen(functions: DataFrame, targets: DataFrame) -> DataFrame:
    """Accesses through pointers on each of their targets, with the regions that the paths below them name."""
    schema = "source_id string, function_id int, ord int, op string, node int, at int, region string"
    arrow = arrow_schema(functions, schema)
    flat = _flat(functions).filter("op in ('read', 'write') and node is not null and dst is null")
    through = flat.join(targets.withColumnRenamed("place", "src"), [*KEYS, "src"], "left").select(*KEYS, "ord", "op", "node", "at", F.coalesce("target", F.lit(UNKNOWN)).alias("target"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions = [c_targets.below(t, p) for t, p in zip(batch.column("target").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEYS, "ord", "op", "node", "at")), pa.array(regions, pa.string())], schema=arrow)

    return mapped(through, run, schema)


def accesses(functions: DataFrame, targets: DataFrame) -> DataFrame:
    """Reads and writes by region: `source_id, function_id, ord, op, node, at, region, strong`.

    An access through a pointer falls on each of its targets; region "?" is anything,
    also where nothing is known of the pointer.
    """
    direct = _flat(functions).filter("op in ('read', 'write') and node is not null and dst is not null")
    direct = direct.select(*KEYS, "ord", "op", "node", "at", F.col("dst").alias("region"), (~F.col("dst").contains(c_memory.ELEMENTS)).alias("strong"))
    count = F.count("*").over(Window.partitionBy(*KEYS, "ord"))
    many = (F.col("region") == UNKNOWN) | F.col("region").contains(c_memory.ELEMENTS) | F.col("region").contains(c_targets.REPEATED)
    return direct.unionByName(_fallen(functions, targets).withColumn("strong", (count == 1) & ~many))


def regions(functions: DataFrame, targets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`source_id, function_id, region, root` of every region that is accessed or pointed to; root is its variable."""
    found = (accesses(functions, targets) if rows is None else rows).select(*KEYS, "region").unionByName(targets.select(*KEYS, F.col("target").alias("region"))).filter(F.col("region") != UNKNOWN).distinct()
    return found.withColumn("root", F.regexp_extract("region", r"^([*%<]?[^.\[+]*)", 1))


def overlaps(functions: DataFrame, targets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`source_id, function_id, region, other, why`: pairs of different regions that may share memory, each once, the longer path first where one holds the other.

    why is containment, union (members of one union), parameters (what two parameters
    point to may be one object) or repetition (a folded region and one that it may
    stand for).  All are found by equal keys: a path's beginnings, a union's path, what
    stands before a fold, a function.
    """
    named = written(regions(functions, targets, rows))
    parts = F.regexp_extract_all(F.col("region"), F.lit(r"(\.[^.\[]+|\[\*\]\+?)"), F.lit(1))
    with_parts = named.withColumn("parts", parts)
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0))), lambda n: F.concat("root", F.array_join(F.slice("parts", F.lit(1), n), "")))
    beginnings = with_parts.filter(F.size("parts") > 0).select(*KEYS, "region", F.explode(above).alias("other"))
    contained = beginnings.join(named.select(*KEYS, F.col("region").alias("other")), [*KEYS, "other"]).select(*KEYS, "region", "other", F.lit("containment").alias("why"))
    unions = functions.select(*KEYS, F.explode("unions").alias("union"))
    members = with_parts.filter(F.size("parts") > 0).select(*KEYS, "region", F.explode(above).alias("union"), "parts", "root").join(unions, [*KEYS, "union"])
    depth = F.size(F.regexp_extract_all(F.col("union"), F.lit(r"(\.[^.\[]+|\[\*\])"), F.lit(1)))
    members = members.select(*KEYS, "union", "region", F.element_at("parts", depth + 1).alias("member"))
    other = members.select(*KEYS, "union", F.col("region").alias("other"), F.col("member").alias("other_member"))
    siblings = members.join(other, [*KEYS, "union"]).filter("member <> other_member and region < other").select(*KEYS, "region", "other", F.lit("union").alias("why"))
    formal = named.filter("root like '*%'")
    apart = formal.join(formal.select(*KEYS, F.col("region").alias("other"), F.col("root").alias("other_root")), KEYS).filter("root <> other_root and region < other").select(*KEYS, "region", "other", F.lit("parameters").alias("why"))
    folded = with_parts.filter(F.col("region").contains(c_targets.REPEATED)).select(*KEYS, "region", F.substring_index("region", c_targets.REPEATED, 1).alias("stem"))
    stems = folded.withColumn("parts", F.regexp_replace("stem", r"^[^.\[]*", "")).select(*KEYS, "region", "stem")
    plain = F.regexp_replace("other", r"\+", "")
    under = with_parts.select(*KEYS, F.col("region").alias("other"), F.explode(F.array_append(above, F.col("region"))).alias("stem")).withColumn("stem", F.regexp_replace("stem", r"\+", ""))
    repeated = stems.join(under, [*KEYS, "stem"]).filter("region <> other").select(*KEYS, "region", "other", F.when(plain == F.col("stem"), "containment").otherwise("repetition").alias("why"))
    repeated = repeated.withColumn("why", F.when(F.col("other").contains(c_targets.REPEATED), "repetition").otherwise(F.col("why"))).filter(~(F.col("other").contains(c_targets.REPEATED) & (F.col("region") > F.col("other"))))
    rank = F.when(F.col("why") == "containment", 0).otherwise(1)
    every = contained.unionByName(siblings).unionByName(apart).unionByName(repeated).withColumn("low", F.least("region", "other")).withColumn("high", F.greatest("region", "other"))
    first = Window.partitionBy(*KEYS, "low", "high").orderBy(rank, F.desc("region"), "why")
    return every.withColumn("first", F.row_number().over(first)).filter("first = 1").select(*KEYS, "region", "other", "why")


def effects(functions: DataFrame, targets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`source_id, function_id, function, parameter, op` (read or write): what functions do to what their parameters refer to, their own callees included.

    Callees are found by name in the same source; rounds end when nothing is new.
    """
    if rows is None:
        targets = written(targets)
        rows = accesses(functions, targets)
    flat = _flat(functions)
    formal = flat.filter("op = 'parameter'").select(*KEYS, F.col("src").alias("root"), F.col("number").alias("parameter"))
    touched = rows.select(*KEYS, "op", F.regexp_extract("region", r"^(\*[^.\[+]*)", 1).alias("root")).distinct()
    names = functions.select(*KEYS, "function")
    known = written(touched.join(formal, [*KEYS, "root"]).join(names, KEYS).select(*KEYS, "function", "parameter", "op").distinct())
    given = flat.filter("op = 'argument' and callee is not null").select(*KEYS, F.col("dst").alias("place"), F.col("callee"), "number")
    passed = given.join(targets, [*KEYS, "place"]).select(*KEYS, "callee", "number", F.regexp_extract("target", r"^(\*[^.\[+]*)", 1).alias("root")).join(formal, [*KEYS, "root"])
    passed = written(passed.join(names, KEYS).select(*KEYS, "function", "parameter", "callee", "number").distinct())
    parts = [known]
    while parts[-1].limit(1).count():  # ends: there are no more effects than parameters, twice
        of_callee = parts[-1].select("source_id", F.col("function").alias("callee"), F.col("parameter").alias("number"), "op")
        new = passed.join(of_callee, ["source_id", "callee", "number"]).select(*KEYS, "function", "parameter", "op").distinct()
        parts.append(written(new.join(known, [*KEYS, "function", "parameter", "op"], "left_anti")))
        known = known.unionByName(parts[-1])
        if len(parts) % 10 == 0:
            known = written(known)
    return known


def call_effects(functions: DataFrame, targets: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Accesses that calls make through their arguments, as `accesses` gives them, all weak.

    A callee that the source defines once does what `effects` says; any other may read
    and write all that its arguments point to.
    """
    given = _flat(functions).filter("op = 'argument' and node is not null").select(*KEYS, "ord", "node", "at", F.col("dst").alias("place"), "callee", "number")
    once = functions.groupBy("source_id", F.col("function").alias("callee")).agg(F.count("*").alias("n")).filter("n = 1").select("source_id", "callee", F.lit(True).alias("defined"))
    done = effects(functions, targets, rows).groupBy("source_id", F.col("function").alias("callee"), F.col("parameter").alias("number")).agg(F.collect_set("op").alias("ops"))
    does = F.when(F.col("defined"), F.coalesce("ops", F.array().cast("array<string>"))).otherwise(F.array(F.lit("read"), F.lit("write")))
    seen = given.join(once, ["source_id", "callee"], "left").join(done, ["source_id", "callee", "number"], "left").withColumn("op", F.explode(does))
    at = F.col("at") - F.when(F.col("op") == "read", 1).otherwise(0)  # a call reads before it writes
    return seen.join(targets, [*KEYS, "place"]).select(*KEYS, "ord", "op", "node", at.alias("at"), F.col("target").alias("region"), F.lit(False).alias("strong"))


def flows(functions: DataFrame, targets: DataFrame, calls: bool = True) -> DataFrame:
    """`source_id, function_id, function, write, read, region, read_region, via`: which writes reach which reads through memory.

    A write reaches a read of its own region (via "same"), of one that overlaps it (via
    why) or of anything (via "unknown").  A strong write ends those of its region before
    it, and of the parts of it; each function is solved on its own graph.
    """
    # overlaps and effects ask for both again
    targets = written(targets)
    own = written(accesses(functions, targets))
    rows = own.unionByName(call_effects(functions, targets, own)) if calls else own
    mine = rows.groupBy(*KEYS).agg(F.collect_list(F.struct("ord", "op", "node", "at", "region", "strong")).alias("accesses"))
    pairs = overlaps(functions, targets, own).groupBy(*KEYS).agg(F.collect_list(F.struct("region", "other", "why")).alias("overlaps"))
    joined = functions.select(*KEYS, "function", "n_nodes", "edges").join(mine, KEYS).join(pairs, KEYS, "left")
    schema = "source_id string, function_id int, function string, write int, read int, region string, read_region string, via string"
    arrow = arrow_schema(functions, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    head = {c: row[c] for c in (*KEYS, "function")}
                    for x in reached(row["n_nodes"], row["edges"], row["accesses"], row["overlaps"] or []):
                        yield head | x

        return _batches(rows(), arrow)

    return mapped(joined, run, schema)


def uninitialised(functions: DataFrame) -> DataFrame:
    """`source_id, function_id, function, place, read`: reads of local pointers that no write need have come before."""
    flat = _flat(functions)
    locals_ = flat.filter("op = 'local'").select(*KEYS, "dst").distinct()
    rows = flat.filter("op in ('read', 'write') and node is not null").join(locals_, [*KEYS, "dst"], "left_semi")
    begun = locals_.select(*KEYS, F.lit(-1).alias("ord"), F.lit("write").alias("op"), F.lit(0).alias("node"), F.lit(-2).alias("at"), F.col("dst").alias("region"), F.lit(True).alias("strong"))
    mine = rows.select(*KEYS, "ord", "op", "node", "at", F.col("dst").alias("region"), F.lit(True).alias("strong")).unionByName(begun)
    grouped = mine.groupBy(*KEYS).agg(F.collect_list(F.struct("ord", "op", "node", "at", "region", "strong")).alias("accesses"))
    joined = functions.select(*KEYS, "function", "n_nodes", "edges").join(grouped, KEYS)
    schema = "source_id string, function_id int, function string, place string, read int"
    arrow = arrow_schema(functions, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = {(x["region"], x["read"]) for x in reached(row["n_nodes"], row["edges"], row["accesses"], []) if x["write"] == -1}
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in (*KEYS, "function")} | {"place": p, "read": r} for p, r in sorted(found)], arrow)

    return mapped(joined, run, schema)


#: Columns of what `within` solves, after `source_id, function_id, function`.
WITHIN = {
    "targets": "place string, target string",
    "effects": "parameter int, op string",
    "flows": "write int, read int, region string, read_region string, via string",
    "counted": "write_node int, read_node int, region string, read_region string, via string, n long",
}


def within(sources: DataFrame, what: str, nested: bool = False) -> DataFrame:
    """What `points_to` ("targets"), `effects` or `flows` give for the sources' `steps`, in one pass over each text: functions meet only within their source.

    "counted" are the flows by the nodes that they begin and end in.  `nested` gives a
    row for each function, with an array `found` of structures.
    """
    return told(sources, lambda text: c_flows.solved(text, what), WITHIN[what], nested)
