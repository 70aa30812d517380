"""Where C texts come from: files, tables, and a corpus synthesised from the order tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stage import mapped

SOURCE_SCHEMA = "source_id string, path string, dialect string, text string"
FILE_FUNCTIONS = 16


def path_argument(path: str | os.PathLike) -> str:
    """A path, checked: text that was meant as code, or a name no file can have, raises ValueError."""
    name = os.fspath(path)
    if not name or "\n" in name or "\0" in name or len(os.path.basename(name).encode()) > 255:
        raise ValueError("this is no path; analyse code as text instead")
    return name


def read_files(spark: SparkSession, path: str | os.PathLike, pattern: str = "*.{c,h}") -> DataFrame:
    """`source_id, path, dialect, text` of the files below a directory (or of one file), bytes that are no UTF-8 replaced.

    Spark lists and splits the files, so a corpus of any size is read by all executors;
    a file that can't be read fails the query.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path_argument(path)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if c is None else c.decode("utf-8", "replace") for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], ["path", "text"])

    return mapped(files, run, "path string, text string").select(F.col("path").alias("source_id"), "path", F.lit("ordinary").alias("dialect"), "text")


def from_texts(df: DataFrame, id_column: str, text_column: str, dialect: str = "ordinary") -> DataFrame:
    """Sources of any table with texts; null texts are empty."""
    return df.select(F.col(id_column).cast("string").alias("source_id"), F.lit(None).cast("string").alias("path"), F.lit(dialect).alias("dialect"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def order_functions(spark: SparkSession, sf_dir: str, loop_above: int = 25) -> DataFrame:
    """`source_id, name, o_orderkey, body` of one C function per order.

    A returned line item gives an `if`, another of more than `loop_above` pieces a
    `while`, any other a call of its supplier, so every measure of the function
    follows from the rows in closed form.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    quantity = F.col("l_quantity").cast("int")
    statement = (
        F.when(F.col("l_returnflag") == "R", F.format_string("    if (a > %d) {\n        total = total + %d;\n    }\n", quantity, quantity))
        .when(F.col("l_quantity") > loop_above, F.format_string("    while (total < %d) {\n        total = total + 1;\n    }\n", quantity))
        .otherwise(F.format_string("    total = total + supplier_%d(a, %d);\n", F.col("l_suppkey"), quantity))
    )
    lines = read("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", statement.alias("s")).alias("x")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("items"))
    body = F.coalesce(F.array_join(F.col("items.s"), ""), F.lit(""))
    text = F.concat(F.format_string("int order_%d(int a, int b)\n{\n    int total = 0;\n", F.col("o_orderkey")), body, F.lit("    return total;\n}\n"))
    orders = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select((F.floor(F.col("o_orderkey") / FILE_FUNCTIONS)).cast("string").alias("source_id"), F.format_string("order_%d", F.col("o_orderkey")).alias("name"), "o_orderkey", text.alias("body"))


def order_sources(spark: SparkSession, sf_dir: str, loop_above: int = 25) -> DataFrame:
    """Files of `FILE_FUNCTIONS` order functions each, as sources."""
    # parsing costs more than moving: a stated number of partitions isn't merged by size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = order_functions(spark, sf_dir, loop_above).repartition(tasks, "source_id")
    grouped = rows.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "body"))).alias("x"))
    return grouped.select("source_id", F.concat(F.col("source_id"), F.lit(".c")).alias("path"), F.lit("ordinary").alias("dialect"), F.array_join(F.col("x.body"), "\n").alias("text"))


def _dealt(made: DataFrame, tasks: int) -> DataFrame:
    """Orders with the same statements are read by one worker, one behind the other (`plans.c_alike`); none is more than some hundredths of all."""
    return made.repartition(tasks, "_kinds").sortWithinPartitions("_kinds").drop("_kinds")


def pointer_sources(spark: SparkSession, sf_dir: str, loop_above: int = 25) -> DataFrame:
    """One source per order, with a function that works through a pointer.

    A returned line item turns the pointer to another variable, another of more than
    `loop_above` pieces writes through it, any other reads through it; even orders pass
    their parameter to a function that writes to it, odd ones pass a variable's address
    to one that the text doesn't define.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    quantity = F.col("l_quantity").cast("int")
    statement = F.when(F.col("l_returnflag") == "R", F.lit("    p = &y;\n")).when(F.col("l_quantity") > loop_above, F.format_string("    *p = %d;\n", quantity)).otherwise(F.lit("    b = *p;\n"))
    lines = read("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", statement.alias("s"), F.substring(statement, 1, 6).alias("k")).alias("x")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("items"))
    body = F.coalesce(F.array_join(F.col("items.s"), ""), F.lit(""))
    even = F.col("o_orderkey") % 2 == 0
    helper = F.when(even, F.format_string("void touch_%d(int *q)\n{\n    *q = 1;\n}\n", F.col("o_orderkey"))).otherwise("")
    call = F.when(even, F.format_string("    touch_%d(in);\n", F.col("o_orderkey"))).otherwise("    outside(&x);\n")
    text = F.concat(helper, F.format_string("int order_%d(int *in, int b)\n{\n    int x = 0;\n    int y = 0;\n    int *p = &x;\n", F.col("o_orderkey")), body, call, F.lit("    return x;\n}\n"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    orders = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    made = orders.select(F.col("o_orderkey").cast("string").alias("source_id"), F.lit(None).cast("string").alias("path"), F.lit("ordinary").alias("dialect"), text.alias("text"), F.xxhash64("items.k", even).alias("_kinds"))
    return _dealt(made, tasks)


def walking_sources(spark: SparkSession, sf_dir: str, loop_above: int = 25) -> DataFrame:
    """One source per order, with a function that walks a list and keeps a pointer to its head.

    A returned line item moves the walking pointer on, another of more than `loop_above`
    pieces writes to the member it stands at, any other reads the head's.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    statement = F.when(F.col("l_returnflag") == "R", F.lit("    p = p->next;\n")).when(F.col("l_quantity") > loop_above, F.format_string("    p->v = %d;\n", F.col("l_quantity").cast("int"))).otherwise(F.lit("    b = q->v;\n"))
    lines = read("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", statement.alias("s"), F.substring(statement, 1, 8).alias("k")).alias("x")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("items"))
    text = F.concat(F.format_string("int walk_%d(struct n *p, int b)\n{\n    struct n *q = p;\n    q->v = 5;\n", F.col("o_orderkey")), F.coalesce(F.array_join(F.col("items.s"), ""), F.lit("")), F.lit("    return q->v;\n}\n"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    orders = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    made = orders.select(F.col("o_orderkey").cast("string").alias("source_id"), F.lit(None).cast("string").alias("path"), F.lit("ordinary").alias("dialect"), text.alias("text"), F.xxhash64("items.k").alias("_kinds"))
    return _dealt(made, tasks)


#: Statements of `branch_sources` by number: short circuits, a conditional, a switch that falls through, loops of all
#: kinds with jumps out of them, nesting, and a goto.  `#` becomes the statement's place in its function.
BRANCHES = (
    "if (a && b) { total = total + 1; }",
    "total = b ? 1 : 2;",
    "switch (a) { case 1: total = 1; case 2: total = 2; break; default: total = 3; }",
    "for (int i = 0; i < b; i++) { if (i) continue; total = total + i; }",
    "do { total--; } while (total);",
    "if (a) { while (b) { b--; } } else { total = 0; }",
    "while (a || b) { if (total) break; a--; }",
    "if (a) goto L#; total = 5; L#: total = 6;",
)
#: Nodes of each statement's graph.
BRANCH_NODES = (4, 5, 8, 6, 2, 4, 8, 5)


def branch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per order with a function of one of `BRANCHES` per line item; `start` is the first node of the last, `seed` the last node of it."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kind = ((F.col("l_linenumber") + F.col("l_partkey")) % len(BRANCHES)).cast("int")
    lines = read("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", kind.alias("k")))).alias("items"))
    orders = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kinds = F.coalesce(F.col("items.k"), F.array().cast("array<int>"))
    statements, sizes = F.array(*map(F.lit, BRANCHES)), F.array(*map(F.lit, BRANCH_NODES))
    body = F.array_join(F.transform(kinds, lambda k, i: F.concat(F.lit("    "), F.replace(F.get(statements, k), F.lit("#"), i.cast("string")), F.lit("\n"))), "")
    nodes = F.aggregate(kinds, F.lit(3), lambda n, k: n + F.get(sizes, k))
    last = F.when(F.size(kinds) > 0, F.get(sizes, F.get(kinds, F.size(kinds) - 1))).otherwise(1)
    text = F.concat(F.format_string("int order_%d(int a, int b)\n{\n    int total = 0;\n", F.col("o_orderkey")), body, F.lit("    return total;\n}\n"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    made = orders.select(F.col("o_orderkey").cast("string").alias("source_id"), F.lit(None).cast("string").alias("path"), F.lit("ordinary").alias("dialect"), text.alias("text"), (nodes - last).alias("start"), (nodes - 1).alias("seed"), F.xxhash64(kinds).alias("_kinds"))
    return _dealt(made, tasks)


#: Shapes of functions for timing, by name: what stands before, for each of n (`#` is its number), after, and between.
SHAPES = {
    "declarators": ("int f(void) { ", "int v# = #; ", "return 0; }", ""),
    "parameters": ("int f(", "int p#", ") { return 0; }", ", "),
    "function_pointers": ("int f(", "int (*p#)(int)", ") { return 0; }", ", "),
    "branches": ("int f(int a, int b) { ", "if (a) b = #; ", "return b; }", ""),
    "nested_branches": ("int f(int a, int b) { ", "if (a) { ", "b = 1; {closing} return b; }", ""),
    "nested_loops": ("int f(int a, int b) { ", "while (a) { ", "a--; {closing} return b; }", ""),
    "cases": ("int f(int a, int b) { switch (a) { ", "case #: b = #; break; ", "} return b; }", ""),
    "gotos": ("int f(int a) { ", "if (a) goto end; ", "end: return a; }", ""),
    "calls": ("int f(int a) { ", "g#(a); ", "return a; }", ""),
    "operands": ("int f(int a) { return ", "a", "; }", " + "),
}


def shape_sources(sizes: DataFrame) -> DataFrame:
    """Sources `source_id, shape, n, text` of every shape in `SHAPES` for every `n` of a table."""
    listed = F.array(*[F.struct(F.lit(k).alias("shape"), *[F.lit(x).alias(f"x{i}") for i, x in enumerate(v)]) for k, v in SHAPES.items()])
    rows = sizes.select(F.col("n").cast("int").alias("n")).distinct().select("n", F.explode(listed).alias("s")).select("n", "s.*")
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.replace("x1", F.lit("#"), i.cast("string")))
    joined = F.aggregate(each, F.lit(""), lambda done, x: F.when(done == "", x).otherwise(F.concat(done, F.col("x3"), x)))
    text = F.concat("x0", F.when(F.col("n") > 0, joined).otherwise(""), F.replace("x2", F.lit("{closing}"), F.repeat(F.lit("}"), F.col("n"))))
    return rows.select(F.concat_ws(":", "shape", "n").alias("source_id"), "shape", "n", text.alias("text"))
