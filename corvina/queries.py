"""The registered queries of the source analysis and, beside each, SQL that gives the same rows.

The order tables become C functions (`sources.corpus`), which the queries parse; the
SQL computes what the parser must find from the order rows alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import c_types
from .functions import text as texts
from .operators import annotations, declared, evaluation, exports, flow, graphs, lowered, memory, metrics, symbols
from .plans import c_measure, stage
from .sources import corpus

#: Types of `typed_operations`.
TYPED = ("_Bool", "char", "unsigned char", "short", "unsigned short", "int", "unsigned int", "long", "unsigned long", "long long", "unsigned long long")
#: Line items above this many pieces give loops, in the report before and in the one after.
LOOPS, LOOPS_AFTER = 25, 35


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _functions(spark: SparkSession, sf_dir: str, loops: int = LOOPS, graphs: bool = True) -> DataFrame:
    return stage.functions(stage.parse(corpus.order_sources(spark, sf_dir, loops), graphs=graphs))


def _measures(spark: SparkSession, sf_dir: str, loops: int = LOOPS, graphs: bool = True) -> DataFrame:
    return metrics.measures(stage.measured(corpus.order_sources(spark, sf_dir, loops), graphs))


def _unparsed(spark: SparkSession, sf_dir: str, loops: int = LOOPS) -> stage.Unparsed:
    return stage.Unparsed(corpus.order_sources(spark, sf_dir, loops))


# -- measures -----------------------------------------------------------------------


def metrics_graph(spark, sf_dir):
    return _measures(spark, sf_dir).select("name", "cfg_nodes", "cfg_edges", "reachable_nodes", "unreachable_nodes", "dead_end_nodes", "cyclomatic", "decision_points", "back_edges", "loops")


def metrics_shape(spark, sf_dir):
    return _measures(spark, sf_dir).select("name", "cognitive", "max_nesting", "max_loop_depth", "statements", "calls", F.size("callees").alias("n_callees"), "parameters", "unreachable_statements", "short_circuits")


def metrics_size(spark, sf_dir):
    return _measures(spark, sf_dir, graphs=False).select("name", "lines", "code_lines", "tokens", "bytes")


def halstead_counts(spark, sf_dir):
    columns = "halstead_distinct_operators halstead_distinct_operands halstead_total_operators halstead_total_operands halstead_vocabulary halstead_length".split()
    return _measures(spark, sf_dir, graphs=False).select("name", *columns, F.round("halstead_volume", 6).alias("volume"), F.round("halstead_difficulty", 6).alias("difficulty"), F.round("halstead_effort", 6).alias("effort"))


def node_census(spark, sf_dir):
    return stage.cfg_nodes(stage.parse(corpus.order_sources(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


def edge_census(spark, sf_dir):
    return stage.cfg_edges(stage.parse(corpus.order_sources(spark, sf_dir))).groupBy("kind", "back").agg(F.count("*").alias("n"))


def hotspots_topk(spark, sf_dir):
    """Top-k report: ten functions."""
    return metrics.hotspots(_measures(spark, sf_dir), "cyclomatic", 10).select("name", "cyclomatic", "cognitive", "lines")


def summary_distribution(spark, sf_dir):
    rows = metrics.summary(_measures(spark, sf_dir))
    return rows.select("metric", *[F.round(c, 6).alias(c) for c in ("min", "median", "mean", "max")])


def report_totals(spark, sf_dir):
    return metrics.totals(_measures(spark, sf_dir))


def call_graph(spark, sf_dir):
    return metrics.call_graph(stage.measured(corpus.order_sources(spark, sf_dir), graphs=False))


def defined_names(spark, sf_dir):
    return metrics.defined_names(stage.measured(corpus.order_sources(spark, sf_dir), graphs=False))


def report_compare(spark, sf_dir):
    before, after = _measures(spark, sf_dir), _measures(spark, sf_dir, LOOPS_AFTER)
    return metrics.compare(before, after, ["cyclomatic", "cognitive", "lines", "statements"], ordered=False).drop("largest")


def compare_totals(spark, sf_dir):
    chosen = ["cyclomatic", "cognitive", "lines", "statements"]
    return metrics.compare_totals(metrics.compare(_measures(spark, sf_dir), _measures(spark, sf_dir, LOOPS_AFTER), chosen, ordered=False), chosen)


def feature_vectors(spark, sf_dir):
    rows = metrics.features(_measures(spark, sf_dir))
    return rows.select("name", *[F.round(c, 6).alias(c) for c in metrics.FEATURES])


def tokens_by_kind(spark, sf_dir):
    return stage.token_kinds(corpus.order_sources(spark, sf_dir))


# -- graphs ----------------------------------------------------------------------------


def _branches(spark: SparkSession, sf_dir: str) -> stage.Unparsed:
    return stage.Unparsed(corpus.branch_sources(spark, sf_dir))


def graph_nodes(spark, sf_dir):
    return graphs.nodes(corpus.branch_sources(spark, sf_dir)).select("function", "id", "kind", "internal", "live", "ends")


def graph_edges(spark, sf_dir):
    return stage.cfg_edges(stage.parse(corpus.branch_sources(spark, sf_dir))).select("function", "src", "dst", "kind", "back")


def branch_measures(spark, sf_dir):
    rows = metrics.measures(stage.measured(corpus.branch_sources(spark, sf_dir)))
    return rows.select("name", "cfg_nodes", "cfg_edges", "cyclomatic", "decision_points", "back_edges", "loops", "cognitive", "max_nesting", "max_loop_depth", "statements", "short_circuits", "gotos", "nodes_case", "nodes_switch", "nodes_break", "nodes_continue", "nodes_label")


def control_dependence(spark, sf_dir):
    return graphs.control_dependence(_branches(spark, sf_dir)).select("function", "on", "node", "kind")


def post_dominators(spark, sf_dir):
    """Every node's immediate post-dominator, -1 for the exit, which has none."""
    return graphs.post_dominators(_branches(spark, sf_dir)).select("function", "node", F.coalesce("ipdom", F.lit(-1)).alias("ipdom"), "dead_end")


def control_depth(spark, sf_dir):
    return graphs.control_depth(_unparsed(spark, sf_dir)).select("function", "node", "depth")


def descendants(spark, sf_dir):
    """What the last statement's first node reaches."""
    return graphs.reaching(_branches(spark, sf_dir), "start").select("function", "node")


def backward_slices(spark, sf_dir):
    """What the last statement's last node depends on."""
    return graphs.backward_slice(_branches(spark, sf_dir), "seed").select("function", "node")


def node_degrees(spark, sf_dir):
    degrees = graphs.degrees(stage.cfg_edges(stage.parse(corpus.order_sources(spark, sf_dir))))
    return degrees.groupBy("in_degree", "out_degree").agg(F.count("*").alias("n"))


def chain_contraction(spark, sf_dir):
    return graphs.chains(_unparsed(spark, sf_dir)).groupBy("function").agg(F.countDistinct("block").alias("n_blocks"))


def graph_problems(spark, sf_dir):
    return graphs.problems(_unparsed(spark, sf_dir)).groupBy("problem").agg(F.count("*").alias("n"))


def _shape_pairs(spark, sf_dir):
    """Each function beside the next of its source by id."""
    rows = graphs.shapes(_unparsed(spark, sf_dir))
    order = Window.partitionBy("source_id").orderBy("function_id")
    both = rows.select(F.col("name").alias("pair_id"), F.col("nodes").alias("left"), F.col("n_edges").alias("left_edges"), F.lead("nodes").over(order).alias("right"), F.lead("n_edges").over(order).alias("right_edges"))
    return both.filter("right is not null")


def ged_size_delta(spark, sf_dir):
    return graphs.size_delta(_shape_pairs(spark, sf_dir))


def ged_distance(spark, sf_dir):
    # comparing costs far more than moving: a stated number of partitions isn't merged by size
    return graphs.similarity(_shape_pairs(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism))


def parity_resolve(spark, sf_dir):
    """The larger graph of each name over two versions of the corpus."""
    a, b = (graphs.sizes(_unparsed(spark, sf_dir, n)).withColumn("source_id", F.concat(F.lit(k), "source_id")) for n, k in ((LOOPS, "a"), (LOOPS_AFTER, "b")))
    return graphs.best_by_name(graphs.scoreable(a.unionByName(b)), "n_nodes").select("name", F.substring("source_id", 1, 1).alias("version"), "n_nodes")


def parity_blocks(spark, sf_dir):
    return graphs.parity_blocks(corpus.order_sources(spark, sf_dir)).select("name", F.size("nodes").alias("n_blocks"), F.size("edges").alias("n_edges"), "degenerate")


def parity_units(spark, sf_dir):
    """Two versions of the corpus as two units: each has its own graph of every name."""
    a, b = (graphs.parity_blocks(corpus.order_sources(spark, sf_dir, n)).withColumn("source_id", F.lit(unit)) for n, unit in ((LOOPS, "a"), (LOOPS_AFTER, "b")))
    return graphs.resolve_for_units(stage.written(a.unionByName(b))).groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.col("unit") == F.col("source_id")).alias("own"))


def parity_rebuilt(spark, sf_dir):
    """Block graphs written as JSON and read back."""
    written = graphs.parity_json(graphs.parity_blocks(corpus.order_sources(spark, sf_dir)))
    return graphs.from_serialized(written).select("name", F.size("nodes").alias("n_blocks"), "n_edges", F.size(F.filter("nodes", lambda n: n["is_entry"])).alias("n_entries"))


def graphs_alike(spark, sf_dir):
    """Which functions of the two versions of the corpus have the same graph."""
    return graphs.isomorphic(_unparsed(spark, sf_dir), _unparsed(spark, sf_dir, LOOPS_AFTER)).select("name", "isomorphic")


def damaged_graphs(spark, sf_dir):
    """Problems of graphs of even orders that have lost their edges for what is false."""
    sources = corpus.branch_sources(spark, sf_dir).withColumn("lost", F.when(F.col("source_id").cast("long") % 2 == 0, "false"))
    return graphs.problems(stage.Unparsed(sources), "lost").select("function", "problem", "node")


def shape_measures(spark, sf_dir):
    """Measures of the timing shapes, for every size that parts have."""
    rows = corpus.shape_sources(_read(spark, sf_dir, "part").select(F.col("p_size").alias("n")))
    measured = metrics.measures(stage.measured(rows.repartition(2 * spark.sparkContext.defaultParallelism)))
    return measured.select("source_id", "parameters", "cyclomatic", "cognitive", "max_nesting", "max_loop_depth", "calls", "gotos", "nodes_case")


def shape_times(spark, sf_dir):
    """The timing shapes with their sizes in bytes; every one takes some time."""
    rows = corpus.shape_sources(_read(spark, sf_dir, "part").select(F.col("p_size").alias("n")))
    return evaluation.timed(rows, lambda text: c_measure.unit(text), 3).select("source_id", "bytes", (F.col("least_seconds") > 0).alias("timed"), (F.col("least_seconds") <= F.col("median_seconds")).alias("ordered"))


def manifest_problems(spark, sf_dir):
    """Orders as slices of their customers' texts: some with another hash, beyond the end, twice, of no source, or over the slice before."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sources = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_path"), F.concat(F.col("c_name"), F.repeat(F.lit("x"), 100)).alias("content"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = orders.withColumn("place", place).withColumn("source_path", F.when(F.col("o_orderkey") % 17 == 0, "none").otherwise(F.col("o_custkey").cast("string")))
    rows = rows.join(sources, "source_path", "left").withColumn("source_sha256", F.when(F.col("o_orderkey") % 7 == 0, F.sha2(F.lit("x"), 256)).when(F.col("o_orderkey") % 19 == 0, "ABC").otherwise(F.coalesce(F.sha2("content", 256), F.sha2(F.lit("y"), 256))))
    rows = rows.withColumn("start_byte", F.col("place") % 40).withColumn("end_byte", F.when(F.col("o_orderkey") % 11 == 0, 1000).otherwise(F.col("start_byte") + 1))
    rows = rows.select(F.col("o_orderkey").alias("id"), "source_path", "source_sha256", "start_byte", "end_byte")
    twice = rows.filter("id % 13 = 0").withColumn("source_path", F.lit("none"))
    return evaluation.manifest_problems(rows.unionByName(twice), sources)


def _export(fmt: str):
    def query(spark, sf_dir):
        return exports.render(exports.cfg_views(graphs.unplaced(_branches(spark, sf_dir)), positions=False), fmt).select("name", "text")

    return query


# -- data flow ------------------------------------------------------------------------------


def _flows(spark, sf_dir):
    return flow.data_flow(corpus.order_sources(spark, sf_dir))


def data_flow_counts(spark, sf_dir):
    return _flows(spark, sf_dir).select("function", F.size("definitions").alias("n_definitions"), F.size("uses").alias("n_uses"), F.size("issues").alias("n_issues"), "complete")


def dead_stores(spark, sf_dir):
    return flow.data_flow(corpus.branch_sources(spark, sf_dir), ["dead_stores", "unused"]).select("function", F.size("dead_stores").alias("n_dead"), F.array_sort("unused").alias("unused"))


def flow_edges(spark, sf_dir):
    return flow.flow_edges(_flows(spark, sf_dir)).groupBy("variable").agg(F.count("*").alias("n"))


def call_summaries(spark, sf_dir):
    return flow.call_summaries(corpus.order_sources(spark, sf_dir)).select("function", "arity", "complete", F.size("transfers").alias("n_transfers"))


def reach_claims(spark, sf_dir):
    tasks = 2 * spark.sparkContext.defaultParallelism
    rows = corpus.order_functions(spark, sf_dir).repartition(tasks).select(F.col("name").alias("source_id"), F.col("body").alias("text"), F.col("name").alias("from_function"), F.lit(0).alias("parameter"), F.lit("supplier_7").alias("to_function"))
    return flow.query_reaches(rows).select("from_function", "claim", F.array_join("uncertainty", ",").alias("uncertainty"))


def loop_bounds(spark, sf_dir):
    return annotations.loop_counts(corpus.order_sources(spark, sf_dir))


def constant_loops(spark, sf_dir):
    """Bounds of `for` loops that the order tables state: a literal for small orders, a parameter for others."""
    bound = F.when(F.col("o_orderkey") % 3 == 0, "n").otherwise(F.format_string("%d", F.col("o_orderkey") % 100))
    text = F.concat(F.lit("void f(int n) { for (int i = 0; i < "), bound, F.lit("; i += 2) g(i); }"))
    rows = _read(spark, sf_dir, "orders").repartition(2 * spark.sparkContext.defaultParallelism).select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    return annotations.loop_bounds(rows).select("source_id", "bound_kind", "induction", "start", "bound", "step")


def stated_facts(spark, sf_dir):
    """Facts in comments above functions, some of parameters that don't exist."""
    name = F.when(F.col("o_orderkey") % 4 == 0, "q").otherwise("p")
    text = F.concat(F.lit("// @fact capacity("), name, F.lit(") = n\n// @fact unroll = "), F.col("o_orderkey").cast("string"), F.lit("\nint f(char *p, int n) { return 0; }\n"))
    rows = _read(spark, sf_dir, "orders").repartition(2 * spark.sparkContext.defaultParallelism).select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    return annotations.facts(rows).select("source_id", "kind", "parameter", "value", "problem")


def ast_tags(spark, sf_dir):
    return annotations.ast_nodes(corpus.order_sources(spark, sf_dir)).groupBy("tag").agg(F.count("*").alias("n"))


def source_provenance(spark, sf_dir):
    """Functions of the later corpus against the names of even orders."""
    functions = _functions(spark, sf_dir, graphs=False)
    names = _read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select((F.floor(F.col("o_orderkey") / corpus.FILE_FUNCTIONS)).cast("string").alias("source_id"), F.format_string("order_%d", "o_orderkey").alias("name"))
    notes = stage.diagnostics(stage.parse(corpus.order_sources(spark, sf_dir), graphs=False))
    return annotations.provenance(functions, names, notes).select("name", "origin", "recovery_qualified")


def declared_types(spark, sf_dir):
    return declared.declared_types(corpus.order_sources(spark, sf_dir)).select("function", "name", "role", "type", "pointer_depth", "array_rank", "is_const")


def type_conflicts(spark, sf_dir):
    """Orders as functions in which every third declares a name again as something else."""
    again = F.when(F.col("o_orderkey") % 3 == 0, "{ char *x[2]; }").otherwise("{ const long x; }")
    text = F.concat(F.lit("void f(void) { long x; "), again, F.lit(" }"))
    rows = _read(spark, sf_dir, "orders").repartition(2 * spark.sparkContext.defaultParallelism).select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    return declared.type_conflicts(declared.declared_types(rows)).select("source_id", "name", F.array_join("shapes", "|").alias("shapes"))


def typed_operations(spark, sf_dir):
    """Operations on two integer types, chosen by an order's keys."""
    kinds = F.array(*map(F.lit, TYPED))
    a, b = (F.get(kinds, (F.col(c) % len(TYPED)).cast("int")) for c in ("o_orderkey", "o_custkey"))
    text = F.concat(F.lit("void f("), a, F.lit(" a, "), b, F.lit(" b) { long r; r = a + b; r = a << b; r = a < b; r = -a; }"))
    rows = _read(spark, sf_dir, "orders").repartition(2 * spark.sparkContext.defaultParallelism).select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    made = declared.typed_operations(rows)
    return made.select("source_id", "ord", "op", "type", F.array_join("operands.type", "|").alias("operands"), F.array_join("operands.converted", "|", "-").alias("converted"))


def typed_members(spark, sf_dir):
    """Operations on members, on members of nested records, on elements and on results of functions, with types chosen by an order's keys."""
    kinds = F.array(*map(F.lit, TYPED))
    a, b = (F.get(kinds, (F.col(c) % len(TYPED)).cast("int")) for c in ("o_orderkey", "o_custkey"))
    text = F.concat(F.lit("struct s { "), a, F.lit(" m, k[2]; struct s *n; }; struct t { struct s in; }; "), a, F.lit(" g(int x); void f(struct s *p, struct t t, "), b, F.lit(" b) { p->n->m + b; t.in.m + b; p->k[1] + b; g(1) + b; }"))
    rows = _read(spark, sf_dir, "orders").repartition(2 * spark.sparkContext.defaultParallelism).select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    made = declared.typed_operations(rows, places=False)
    return made.select("source_id", "ord", "op", F.coalesce("type", F.lit("?")).alias("type"), F.array_join("operands.type", "|", "?").alias("operands"), F.array_join("operands.converted", "|", "-").alias("converted"))


def bound_captures(spark, sf_dir):
    """Definitions that the bounds of an array capture: each returned line item sets the bound anew, any other may."""
    statement = F.when(F.col("l_returnflag") == "R", F.lit("n = 2; ")).otherwise(F.lit("if (m) n = 3; "))
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", statement.alias("s")).alias("i")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("i"))
    orders = _read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
    text = F.concat(F.lit("int f(int n, int m) { "), F.coalesce(F.array_join("i.s", ""), F.lit("")), F.lit("int a[n * m][4], b[n + 1][n]; n = 5; return a[0][1] + b[n][0]; }"))
    sources = orders.select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))
    return flow.captured(sources).groupBy("source_id", "array", "variable", "def").agg(F.count("*").alias("bounds"))


def resolved_names(spark, sf_dir):
    """Uses of names by what they stand for, in functions with a block that hides `x` anew for every returned line item."""
    lines = _read(spark, sf_dir, "lineitem")
    statement = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("{ T x = "), F.col("l_linenumber").cast("string"), F.lit("; "))).otherwise(F.lit("y = x + g; "))
    items = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", statement.alias("s")).alias("i")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("i"), F.count_if(F.col("i.s").startswith("{")).cast("int").alias("r"))
    orders = _read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
    body = F.concat(F.coalesce(F.array_join("i.s", ""), F.lit("")), F.repeat(F.lit("} "), F.coalesce("r", F.lit(0))))
    text = F.concat(F.lit("typedef int T; enum e { A, B }; T g; int f(T x, int y) { "), body, F.lit("for (int g = A; g < B; g++) y = g; return x + g + missing; }"))
    rows = symbols.resolved_within(orders.select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text")))
    return rows.groupBy("source_id", "name", F.coalesce("kind", F.lit("?")).alias("kind"), F.coalesce("depth", F.lit(-1)).alias("depth")).agg(F.count("*").alias("n"))


def eval_runs(spark, sf_dir):
    """Orders as specimens by priority that should have the functions of all their line items, and results that have those not returned."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("name"), "l_returnflag")
    names = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("name").alias("expected"), F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("name"))).alias("found"))
    orders = _read(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey")).join(names, "id", "left")
    manifest = orders.select("id", F.col("o_orderpriority").alias("family"), "expected", F.lit(0).alias("start_byte"), (F.col("o_orderkey") % 1000).alias("end_byte"))
    key = F.col("o_orderkey")
    results = orders.filter("o_orderkey % 13 <> 0").select(F.concat(F.lit("run"), F.col("o_custkey") % 3).alias("run_id"), "id", F.when(key % 7 == 0, "timeout").otherwise("ok").alias("status"), "found", F.when(key % 5 != 0, key % 2 == 0).alias("syntax_complete"), (key % 3 == 0).alias("cfg_complete"), F.when(key % 11 != 0, key % 100).alias("covered_bytes"))
    return evaluation.run_summary(manifest, results)


def _lowered(spark, sf_dir):
    """Orders as functions over two integer types, chosen by their keys, with a compound assignment, `&&`, a call, an increment and `?:`; odd orders state a fact."""
    kinds = F.array(*map(F.lit, TYPED))
    a, b = (F.get(kinds, (F.col(c) % len(TYPED)).cast("int")) for c in ("o_orderkey", "o_custkey"))
    fact = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("// fact: capacity(b) = "), F.col("o_custkey").cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(fact, F.lit("int f("), a, F.lit(" a, "), b, F.lit(" b)\n{\n    a += b;\n    return a && f(b++, 1) ? a : b;\n}\n"))
    orders = _read(spark, sf_dir, "orders").repartition(2 * spark.sparkContext.defaultParallelism)
    return orders.select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))


def lowered_operations(spark, sf_dir):
    """Whole lists of operations: conversions, inputs, blocks and guards."""
    made = lowered.operations(lowered.lowered(_lowered(spark, sf_dir)))
    guard = F.array_join(F.transform("guards", lambda g: F.concat(g["id"].cast("string"), F.when(g["holds"], ":true").otherwise(":false"))), ",")
    return made.select("source_id", "id", "kind", "op", "type", F.array_join(F.col("inputs").cast("array<string>"), ",").alias("inputs"), "block", "root", guard.alias("guarded_by"), F.coalesce("from", F.lit("")).alias("source"), F.coalesce("operand_type", F.lit("")).alias("operand_type"), F.coalesce("access", F.lit("")).alias("access"), F.coalesce("name", F.lit("")).alias("name"))


def lowered_orders(spark, sf_dir):
    """All order pairs between operations, by kind."""
    return lowered.orders(lowered.lowered(_lowered(spark, sf_dir))).select("source_id", "first", "second", "kind")


def lowered_facts(spark, sf_dir):
    """Facts on the loads and stores of the parameter that they speak of."""
    sources = _lowered(spark, sf_dir)
    return lowered.facts_of_accesses(lowered.lowered(sources), annotations.facts(sources, marker="fact")).select("source_id", "id", "facts", "facts_source")


def _export_operations(fmt: str):
    def query(spark, sf_dir):
        return lowered.rendered(_lowered(spark, sf_dir), fmt, marker="fact").select("source_id", "text")

    return query


def usual_conversions(spark, sf_dir):
    return c_types.conversion_table(spark)


def literal_types(spark, sf_dir):
    """Types of order keys and line numbers as literals."""
    rows = _read(spark, sf_dir, "lineitem").select(F.concat(F.pow(F.lit(10), F.col("l_linenumber") + 6).cast("long").cast("string"), F.when(F.col("l_returnflag") == "R", "u").when(F.col("l_returnflag") == "A", "L").otherwise("")).alias("literal")).distinct()
    return rows.select("literal", c_types.literal_type(F.col("literal")).alias("type"))


def mutation_totality(spark, sf_dir):
    """Damaged copies of every source: all are read, none fails."""
    damaged = evaluation.mutated(corpus.order_sources(spark, sf_dir), [1, 4])
    return stage.totals(damaged, ["severity"]).groupBy("severity").agg(F.count("*").alias("specimens"))


def manifest_identity(spark, sf_dir):
    return evaluation.manifest_identity(_read(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


# -- memory -----------------------------------------------------------------------------------


def _pointers(spark, sf_dir):
    """(functions with their steps, targets of their pointers) of the pointer corpus."""
    functions = stage.written(memory.steps(corpus.pointer_sources(spark, sf_dir)))
    return functions, memory.points_to(functions)


def mem_points_to(spark, sf_dir):
    return memory.within(corpus.pointer_sources(spark, sf_dir), "targets").filter("place not like '\\%%'").select("function", "place", "target")


def mem_accesses(spark, sf_dir):
    """Strong and weak writes to the two variables, and reads of them through the pointer or directly."""
    functions, targets = _pointers(spark, sf_dir)
    rows = memory.accesses(functions, targets).filter("region in ('x', 'y')").join(functions, memory.KEYS)
    writes, strong = F.col("op") == "write", F.col("strong")
    return rows.groupBy("function").agg(F.count_if(writes & strong).alias("n_strong"), F.count_if(writes & ~strong).alias("n_weak"), F.count_if(~writes).alias("n_reads"))


def mem_flows(spark, sf_dir):
    """Writes that reach reads of the two variables, and those that reach the last read."""
    rows = memory.within(corpus.pointer_sources(spark, sf_dir), "flows", nested=True)
    rows = rows.withColumn("found", F.filter("found", lambda x: x["read_region"].isin("x", "y") & (x["via"] == "same"))).filter("size(found) > 0")
    rows = rows.withColumn("last", F.array_max("found.read"))
    return rows.select("function", F.size("found").cast("long").alias("n"), F.size(F.filter("found", lambda x: x["read"] == F.col("last"))).cast("long").alias("n_last"))


def mem_effects(spark, sf_dir):
    """What functions do to what their parameters refer to, through a callee too."""
    return memory.within(corpus.pointer_sources(spark, sf_dir), "effects").select("function", "parameter", "op")


def mem_walks(spark, sf_dir):
    """All flows through memory, of whatever kind, in functions that walk a list: by the statements of the write and the read."""
    return memory.within(corpus.walking_sources(spark, sf_dir), "counted").select("function", "write_node", "read_node", "region", "read_region", "via", "n")


def _small(spark, sf_dir, text):
    orders = _read(spark, sf_dir, "orders").repartition(2 * spark.sparkContext.defaultParallelism)
    return stage.written(memory.steps(orders.select(F.col("o_orderkey").cast("string").alias("source_id"), text.alias("text"))))


def mem_overlaps(spark, sf_dir):
    """Orders as functions with a union, nested structures or two pointers, by their key."""
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, "float f(void) { union u v; v.i = 1; return v.f; }").when(kind == 1, "int f(void) { struct s t; t.a.b = 2; g(t.a); return t.c; }").otherwise("void f(int *p, int *q) { *p = 1; *q = 2; }")
    functions = _small(spark, sf_dir, text)
    return memory.overlaps(functions, memory.points_to(functions)).select("source_id", "region", "other", "why")


def mem_uninitialised(spark, sf_dir):
    """Orders as functions that set a pointer on one branch or on both."""
    text = F.concat(F.lit("int f(int b) { int *p, x = 1; if (b) p = &x; "), F.when(F.col("o_orderkey") % 2 == 0, "else p = &b; ").otherwise(""), F.lit("return *p; }"))
    return memory.uninitialised(_small(spark, sf_dir, text)).select("source_id", "place")


# -- texts -------------------------------------------------------------------------------------


def file_lines(spark, sf_dir):
    """Line counts of prose read as C: any text has them."""
    return stage.file_lines(corpus.from_texts(_read(spark, sf_dir, "documents"), "doc_id", "text")).select("source_id", "lines", "bytes", (F.col("code_lines") + F.col("blank_lines") + F.col("other_lines")).alias("counted"))


def split_lines(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(texts.split_lines(F.coalesce("text", F.lit("")))).alias("n_lines"))


def _preprocessed(spark, sf_dir):
    """Orders as preprocessed text: a marker and a line per line item, of a system header for returned ones."""
    path = F.when(F.col("l_returnflag") == "R", "/usr/include/x.h").otherwise(F.concat(F.lit("src/"), F.col("l_linenumber").cast("string"), F.lit(".c")))
    line = F.concat(F.lit('# 1 "'), path, F.lit('"\nint v'), F.col("l_linenumber").cast("string"), F.lit(";"))
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("s")))).alias("x"))
    return items.select(F.col("l_orderkey").cast("string").alias("source_id"), F.concat(F.lit("int before;\n"), F.array_join("x.s", "\n"), F.lit("\n")).alias("text"))


def strip_headers(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("source_id", texts.own_lines(F.col("text")).alias("text"))


def strip_headers_by_window(spark, sf_dir):
    return texts.strip_system_headers(_preprocessed(spark, sf_dir)).select("source_id", "text")


def normalize_decompiled(spark, sf_dir):
    decompiled = F.concat(F.lit("int ["), F.lit("4] f"), F.col("o_orderkey").cast("string"), F.lit("(unsigned __int128 a @ rdi, __int128 b @ xmm0);\n"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", texts.normalize(decompiled, "decompiled").alias("text"))


def escape_controls(spark, sf_dir):
    text = F.concat(F.lit('s = "'), F.col("o_orderpriority"), F.lit('\x01\t\x7f"; c = \'\x02\'; /* \x03 */'))
    return _read(spark, sf_dir, "orders").select("o_orderkey", texts.escape_controls(text).alias("text"))


# -- evaluation -----------------------------------------------------------------------------------


def eval_distribution(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("v"))
    return evaluation.distribution(rows, ["event_type"], "v")


def eval_strata(spark, sf_dir):
    return evaluation.strata(_read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 100000)


def eval_overlaps(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("lo"), (F.unix_seconds(F.col("ts").cast("timestamp")) + F.floor(F.abs("value"))).alias("hi"))
    return evaluation.overlapping(rows, "user_id", "lo", "hi").groupBy("user_id").agg(F.count("*").alias("n"))


def eval_accuracy(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("expected"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("found"))
    return evaluation.accuracy(line).select("l_orderkey", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def eval_problems(spark, sf_dir):
    manifest = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    results = _read(spark, sf_dir, "lineitem").filter("l_linenumber >= 4").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10_000_000).otherwise(0)).alias("id"))
    return evaluation.result_problems(manifest, results)


def eval_closure(spark, sf_dir):
    compared = graphs.size_delta(_shape_pairs(spark, sf_dir)).withColumnRenamed("pair_id", "id")
    proofs = _read(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.format_string("order_%d", "o_orderkey").alias("id"))
    return evaluation.closure_audit(compared, proofs)


# -- SQL ----------------------------------------------------------------------------------------------


def _base(loops: int = LOOPS, name: str = "f") -> str:
    """Counts of the statements of each order's function."""
    return f"""
    {name}_items AS (
      SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_quantity > {loops} THEN 'w' ELSE 'c' END AS k, CAST(floor(l_quantity) AS BIGINT) AS q, l_suppkey AS s FROM lineitem),
    {name} AS (
      SELECT o_orderkey, 'order_' || o_orderkey AS name, count(*) FILTER (k = 'r') AS r, count(*) FILTER (k = 'w') AS w, count(*) FILTER (k = 'c') AS c,
        count(DISTINCT s) FILTER (k = 'c') AS callees, list_distinct(list_concat(coalesce(list(q) FILTER (q IS NOT NULL), []), [0], CASE WHEN count(*) FILTER (k = 'w') > 0 THEN [1] ELSE [] END)) AS literals,
        coalesce(sum(CASE k WHEN 'r' THEN 48 + 2 * length(CAST(q AS VARCHAR)) WHEN 'w' THEN 56 + length(CAST(q AS VARCHAR)) WHEN 'c' THEN 36 + length(CAST(s AS VARCHAR)) + length(CAST(q AS VARCHAR)) END), 0) AS body_bytes
      FROM orders LEFT JOIN {name}_items ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""


_N, _E = "4 + 2 * r + 2 * w + c", "3 + 3 * r + 3 * w + c"
_LINES, _TOKENS, _STATEMENTS = "5 + 3 * r + 3 * w + c", "19 + 14 * r + 14 * w + 11 * c", "2 + 3 * r + 3 * w + c"
_NEST, _DEPTH = "CASE WHEN r + w > 0 THEN 1 ELSE 0 END", "CASE WHEN w > 0 THEN 1 ELSE 0 END"
_N1 = "7 + CASE WHEN r > 0 THEN 2 ELSE 0 END + CASE WHEN w > 0 THEN 2 ELSE 0 END + CASE WHEN r + w + c > 0 THEN 1 ELSE 0 END"
_N2 = "4 + len(literals) + callees"
_NN1, _NN2 = "11 + 7 * r + 7 * w + 5 * c", "6 + 5 * (r + w + c)"
_VOLUME, _DIFFICULTY = f"({_NN1} + {_NN2}) * log2({_N1} + {_N2})", f"({_N1}) / 2.0 * (({_NN2}) / ({_N2})::DOUBLE)"
_EFFORT = f"({_DIFFICULTY}) * ({_VOLUME})"


def _sql(select: str, **more: str) -> str:
    return f"WITH {_base()}{''.join(',' + x for x in more.values())} {select}"


_INTS = {
    "cyclomatic": "1 + r + w", "cognitive": "r + w", "max_nesting": _NEST, "max_loop_depth": _DEPTH, "lines": _LINES, "code_lines": _LINES, "tokens": _TOKENS, "statements": _STATEMENTS, "calls": "c",
    "parameters": "2", "decision_points": "r + w", "loops": "w", "unreachable_statements": "0",
}
_KINDS = {"entry": "1", "exit": "1", "stmt": "1 + r + w + c", "cond": "r", "loop_header": "w", "return": "1"}
_FEATURES = _INTS | {"cfg_nodes": _N, "cfg_edges": _E, "reachable_nodes": _N, "dead_end_nodes": "0", "back_edges": "w", "short_circuits": "0"}
_FEATURES |= {f"nodes_{k}": _KINDS.get(k, "0") for k in "entry exit stmt cond loop_header switch indirect_dispatch case label goto break continue return diverge".split()}
_FEATURES |= {
    "bytes": "length(name) + 59 + body_bytes", "ast_nodes": "9 + 11 * r + 11 * w + 10 * c", "halstead_distinct_operators": _N1, "halstead_distinct_operands": _N2, "halstead_total_operators": _NN1, "halstead_total_operands": _NN2,
    "halstead_vocabulary": f"{_N1} + {_N2}", "halstead_length": f"{_NN1} + {_NN2}", "halstead_volume": _VOLUME, "halstead_difficulty": _DIFFICULTY, "halstead_effort": _EFFORT,
}
_COMPARE = ["cyclomatic", "cognitive", "lines", "statements"]
_COMPARED = "SELECT f.name AS name, 'matched' AS status, " + ", ".join(f"{_sub} AS {_as}" for m in _COMPARE for _sub, _as in ((f"fm.{m}", f"before_{m}"), (f"gm.{m}", f"after_{m}"), (f"gm.{m} - fm.{m}", f"delta_{m}")))
_TWO = f"WITH {_base()}, {_base(LOOPS_AFTER, 'g')}, fm AS (SELECT name, " + ", ".join(f"{_INTS[m]} AS {m}" for m in _COMPARE) + " FROM f), gm AS (SELECT name, " + ", ".join(f"{_INTS[m]} AS {m}" for m in _COMPARE) + " FROM g) "

ORACLE: dict[str, str] = {
    "metrics_graph": _sql(f"SELECT name, {_N} AS cfg_nodes, {_E} AS cfg_edges, {_N} AS reachable_nodes, 0 AS unreachable_nodes, 0 AS dead_end_nodes, 1 + r + w AS cyclomatic, r + w AS decision_points, w AS back_edges, w AS loops FROM f"),
    "metrics_shape": _sql(f"SELECT name, r + w AS cognitive, {_NEST} AS max_nesting, {_DEPTH} AS max_loop_depth, {_STATEMENTS} AS statements, c AS calls, callees AS n_callees, 2 AS parameters, 0 AS unreachable_statements, 0 AS short_circuits FROM f"),
    "metrics_size": _sql(f"SELECT name, {_LINES} AS lines, {_LINES} AS code_lines, {_TOKENS} AS tokens, length(name) + 59 + body_bytes AS bytes FROM f"),
    "halstead_counts": _sql(
        f"SELECT name, {_N1} AS halstead_distinct_operators, {_N2} AS halstead_distinct_operands, {_NN1} AS halstead_total_operators, {_NN2} AS halstead_total_operands, {_N1} + {_N2} AS halstead_vocabulary, {_NN1} + {_NN2} AS halstead_length, "
        f"round(({_NN1} + {_NN2}) * log2({_N1} + {_N2}), 6) AS volume, round(({_N1}) / 2.0 * (({_NN2}) / ({_N2})::DOUBLE), 6) AS difficulty, round({_EFFORT}, 6) AS effort FROM f"),
    "node_census": _sql("SELECT kind, n FROM (SELECT unnest(['entry', 'exit', 'stmt', 'cond', 'loop_header', 'return']) AS kind, unnest([count(*), count(*), sum(1 + r + w + c)::BIGINT, sum(r)::BIGINT, sum(w)::BIGINT, count(*)]) AS n FROM f) WHERE n > 0"),
    "edge_census": _sql("SELECT kind, back, n FROM (SELECT unnest(['fall', 'fall', 'true', 'false', 'jump']) AS kind, unnest([false, true, false, false, false]) AS back, unnest([sum(2 + r + c)::BIGINT, sum(w)::BIGINT, sum(r + w)::BIGINT, sum(r + w)::BIGINT, count(*)]) AS n FROM f) WHERE n > 0"),
    "hotspots_topk": _sql(f"SELECT name, 1 + r + w AS cyclomatic, r + w AS cognitive, {_LINES} AS lines FROM f ORDER BY 2 DESC, 1 LIMIT 10"),
    "summary_distribution": _sql(
        "SELECT metric, round(min(v), 6) AS min, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, ({x})::DOUBLE AS v FROM f" for m, x in (_INTS | {"halstead_volume": _VOLUME, "halstead_difficulty": _DIFFICULTY, "halstead_effort": _EFFORT}).items()) + ") GROUP BY metric"),
    "report_totals": _sql("SELECT count(*) AS functions, count(*) AS structured_functions, 0 AS gotos, 0 AS unreachable_statements FROM f"),
    "call_graph": _sql("SELECT DISTINCT 'order_' || l_orderkey AS caller, 'supplier_' || s AS callee FROM f_items JOIN orders ON l_orderkey = o_orderkey WHERE k = 'c'"),
    "defined_names": "SELECT 'order_' || o_orderkey AS name FROM orders",
    "report_compare": _TWO + _COMPARED + " FROM f JOIN fm ON f.name = fm.name JOIN gm ON f.name = gm.name",
    "compare_totals": _TWO + " UNION ALL ".join(f"SELECT '{m}' AS metric, sum(fm.{m})::BIGINT AS before, sum(gm.{m})::BIGINT AS after, (sum(gm.{m}) - sum(fm.{m}))::BIGINT AS delta FROM fm JOIN gm ON fm.name = gm.name" for m in _COMPARE),
    "feature_vectors": _sql("SELECT name, " + ", ".join(f"round(({x})::DOUBLE, 6) AS {c}" for c, x in _FEATURES.items()) + " FROM f"),
    "declared_types": _sql("SELECT name AS function, n AS name, CASE n WHEN 'total' THEN 'local' ELSE 'parameter' END AS role, 'int' AS type, 0 AS pointer_depth, 0 AS array_rank, false AS is_const FROM f, (SELECT unnest(['a', 'b', 'total']) AS n)"),
    "type_conflicts": "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'x' AS name, 'char * []|long  ' AS shapes FROM orders WHERE o_orderkey % 3 = 0",
    "usual_conversions": """WITH t AS (SELECT * FROM (VALUES ('_Bool', 0, 1, false), ('char', 1, 8, true), ('signed char', 1, 8, true), ('unsigned char', 1, 8, false), ('short', 2, 16, true), ('unsigned short', 2, 16, false), ('int', 3, 32, true), ('unsigned int', 3, 32, false),
        ('long', 4, 64, true), ('unsigned long', 4, 64, false), ('long long', 5, 64, true), ('unsigned long long', 5, 64, false), ('__int128', 6, 128, true), ('unsigned __int128', 6, 128, false), ('float', 100, 32, NULL), ('double', 101, 64, NULL), ('long double', 102, 80, NULL)) AS t(n, r, w, s)),
      p AS (SELECT n, CASE WHEN r < 3 THEN 'int' ELSE n END AS pn, CASE WHEN r < 3 THEN 3 ELSE r END AS r, CASE WHEN r < 3 THEN 32 ELSE w END AS w, CASE WHEN r < 3 THEN true ELSE s END AS s FROM t)
      SELECT a.n AS a, b.n AS b, CASE WHEN a.r >= 100 OR b.r >= 100 OR a.s = b.s THEN CASE WHEN a.r >= b.r THEN a.pn ELSE b.pn END
        WHEN NOT a.s AND a.r >= b.r THEN a.pn WHEN NOT b.s AND b.r >= a.r THEN b.pn WHEN a.s AND a.w > b.w THEN a.pn WHEN b.s AND b.w > a.w THEN b.pn ELSE 'unsigned ' || CASE WHEN a.s THEN a.pn ELSE b.pn END END AS common FROM p a, p b""",
    "literal_types": """SELECT literal, CASE WHEN literal LIKE '%L' THEN 'long' WHEN literal LIKE '%u' THEN CASE WHEN v < 4294967296 THEN 'unsigned int' ELSE 'unsigned long' END WHEN v < 2147483648 THEN 'int' ELSE 'long' END AS type
      FROM (SELECT DISTINCT CAST(CAST(pow(10, l_linenumber + 6) AS BIGINT) AS VARCHAR) || CASE l_returnflag WHEN 'R' THEN 'u' WHEN 'A' THEN 'L' ELSE '' END AS literal, CAST(pow(10, l_linenumber + 6) AS BIGINT) AS v FROM lineitem)""",
    "mutation_totality": "SELECT severity, n AS specimens FROM (SELECT unnest([1, 4]) AS severity), (SELECT count(DISTINCT floor(o_orderkey / 16)) AS n FROM orders)",
    "manifest_identity": "SELECT sha256(string_agg(sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}'), chr(10) ORDER BY n_nationkey)) AS sha256 FROM nation",
    "loop_bounds": _sql("SELECT loop, bound_kind, n FROM (SELECT 'while' AS loop, 'runtime' AS bound_kind, sum(w)::BIGINT AS n FROM f) WHERE n > 0"),
    "constant_loops": "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN 'parameter' ELSE 'constant' END AS bound_kind, 'i' AS induction, 0 AS start, CASE WHEN o_orderkey % 3 = 0 THEN 'n' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS bound, 2 AS step FROM orders",
    "stated_facts": "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'unroll' AS kind, NULL AS parameter, CAST(o_orderkey AS VARCHAR) AS value, NULL AS problem FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 <> 0 THEN 'capacity' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'p' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'n' END, CASE WHEN o_orderkey % 4 = 0 THEN 'f has no parameter q' END FROM orders",
    "source_provenance": "SELECT 'order_' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'source' ELSE 'generated' END AS origin, false AS recovery_qualified FROM orders",
    "tokens_by_kind": _sql(
        "SELECT kind, n FROM (SELECT unnest(['int', 'identifier', 'integer', '(', ')', '{', '}', ',', '=', ';', 'return', 'if', '>', 'while', '<', '+']) AS kind, unnest([4 * count(*), sum(5 + 3 * r + 3 * w + 4 * c), sum(1 + 2 * r + 2 * w + c), sum(1 + r + w + c), "
        "sum(1 + r + w + c), sum(1 + r + w), sum(1 + r + w), sum(1 + c), sum(1 + r + w + c), sum(2 + r + w + c), count(*), sum(r), sum(r), sum(w), sum(w), sum(r + w + c)])::BIGINT AS n FROM f) WHERE n > 0"),
    "chain_contraction": f"""WITH {_base()}, p AS (SELECT l_orderkey, k, lead(k) OVER o AS next, lag(k) OVER o AS before FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_quantity > {LOOPS} THEN 'w' ELSE 'c' END AS k FROM lineitem) WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE k WHEN 'r' THEN 0 WHEN 'c' THEN 1 ELSE 2 END)),
      m AS (SELECT l_orderkey, count(*) FILTER (before IS NULL AND k <> 'w') + count(*) FILTER (k = 'c' AND coalesce(next, 'r') <> 'w') AS merged FROM p GROUP BY 1)
      SELECT name AS function, {_N} - coalesce(merged, 1) AS n_blocks FROM f LEFT JOIN m ON o_orderkey = l_orderkey""",
    "node_degrees": f"""WITH {_base()}, p AS (SELECT l_orderkey, k, lead(k) OVER o AS next, CASE WHEN lag(k) OVER o = 'r' THEN 2 ELSE 1 END AS i FROM (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_quantity > {LOOPS} THEN 'w' ELSE 'c' END AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE k WHEN 'r' THEN 0 WHEN 'c' THEN 1 ELSE 2 END)),
      d AS (SELECT 0 AS i, 1 AS o FROM f UNION ALL SELECT 1, 0 FROM f UNION ALL SELECT 1, 1 FROM f UNION ALL SELECT 1, 1 FROM f WHERE r + w + c = 0 UNION ALL SELECT CASE WHEN k = 'r' THEN 2 ELSE 1 END, 1 FROM p WHERE next IS NULL
        UNION ALL SELECT i + CASE WHEN k = 'w' THEN 1 ELSE 0 END, CASE WHEN k = 'c' THEN 1 ELSE 2 END FROM p UNION ALL SELECT 1, 1 FROM p WHERE k <> 'c')
      SELECT i AS in_degree, o AS out_degree, count(*) AS n FROM d GROUP BY ALL""",
    "graph_problems": "SELECT 'x' AS problem, 0 AS n WHERE false",
    "ged_size_delta": _sql(f"SELECT name AS pair_id, abs(n - m) + abs(e - d) AS distance FROM (SELECT name, {_N} AS n, {_E} AS e, lead({_N}) OVER w AS m, lead({_E}) OVER w AS d FROM f WINDOW w AS (PARTITION BY floor(o_orderkey / 16) ORDER BY o_orderkey)) WHERE m IS NOT NULL"),
    "parity_resolve": f"WITH {_base()}, {_base(LOOPS_AFTER, 'g')}, a AS (SELECT name, {_N} AS n FROM f), b AS (SELECT name, {_N} AS n FROM g) SELECT a.name AS name, CASE WHEN a.n >= b.n THEN 'a' ELSE 'b' END AS version, greatest(a.n, b.n) AS n_nodes FROM a JOIN b ON a.name = b.name",
    "data_flow_counts": _sql("SELECT name AS function, 3 + r + w + c AS n_definitions, 1 + 2 * r + 2 * w + 2 * c AS n_uses, 0 AS n_issues, true AS complete FROM f"),
    "call_summaries": _sql("SELECT name AS function, 2 AS arity, c = 0 AS complete, callees AS n_transfers FROM f"),
    "file_lines": "SELECT CAST(doc_id AS VARCHAR) AS source_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, strlen(text) AS bytes, length(text) - length(replace(text, chr(10), '')) + 1 AS counted FROM documents",
    "split_lines": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')) - CASE WHEN regexp_matches(text, '[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]$') THEN 1 ELSE 0 END END AS n_lines FROM documents",
    "strip_headers": "SELECT CAST(l_orderkey AS VARCHAR) AS source_id, coalesce(string_agg('int v' || l_linenumber || ';', chr(10) ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag <> 'R'), '') || chr(10) AS text FROM lineitem GROUP BY l_orderkey",
    "normalize_decompiled": "SELECT o_orderkey, 'int f' || o_orderkey || '(unsigned long long a, long long b);' || chr(10) AS text FROM orders",
    "escape_controls": "SELECT o_orderkey, 's = \"' || o_orderpriority || '\\x01' || chr(9) || '\\x7f\"; c = ''\\x02''; /* ' || chr(3) || ' */' AS text FROM orders",
    "eval_distribution": "SELECT event_type, count(*) AS n, list_sort(list(v))[(count(*) - 1) // 2 + 1] AS median, list_sort(list(v))[(95 * count(*) + 99) // 100] AS p95, max(v) AS maximum FROM (SELECT event_type, CAST(floor(value * 100) AS BIGINT) AS v FROM events WHERE value IS NOT NULL) GROUP BY event_type",
    "eval_strata": "SELECT o_orderpriority AS operator, o_orderstatus AS severity, count(*) AS specimens, count(*) FILTER (o_totalprice > 100000) AS recovered FROM orders GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, 'all', count(*), count(*) FILTER (o_totalprice > 100000) FROM orders GROUP BY 1",
    "eval_overlaps": "SELECT user_id, count(*) AS n FROM (SELECT user_id, lo, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS lo, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(abs(value)) AS BIGINT) AS hi FROM events)) WHERE reach > lo GROUP BY user_id",
    "eval_accuracy": """WITH x AS (SELECT l_orderkey, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R'), []) AS expected, coalesce(list(DISTINCT l_suppkey) FILTER (l_quantity > 25), []) AS found FROM lineitem GROUP BY 1),
      y AS (SELECT l_orderkey, len(list_intersect(expected, found)) AS hit, len(expected) AS e, len(found) AS f FROM x)
      SELECT l_orderkey, round(CASE WHEN f > 0 THEN hit / f WHEN e + f = 0 THEN 1 ELSE 0 END, 9)::DOUBLE AS precision, round(CASE WHEN e > 0 THEN hit / e WHEN e + f = 0 THEN 1 ELSE 0 END, 9)::DOUBLE AS recall FROM y""",
    "eval_problems": """WITH res AS (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 10000000 ELSE 0 END AS id, count(*) AS n FROM lineitem WHERE l_linenumber >= 4 GROUP BY 1)
      SELECT coalesce(o_orderkey, id) AS id, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem FROM orders FULL JOIN res ON o_orderkey = id WHERE o_orderkey IS NULL OR n IS NULL OR n > 1""",
}
#: What the graph of each of `corpus.BRANCHES` must be: its nodes (with * inside expressions), its edges (-1 is the next
#: statement's first node), immediate post-dominators, control dependence, all numbered within the statement.
_SHAPES = [
    ("cond* stmt* cond stmt", "0 1 true,0 2 false,1 2 fall,2 3 true,2 -1 false,3 -1 fall", "2 2 -1 -1", "0 1 true,2 3 true"),
    ("cond* stmt* stmt* stmt* stmt", "0 1 true,0 2 false,1 3 fall,2 3 fall,3 4 fall,4 -1 fall", "3 3 3 4 -1", "0 1 true,0 2 false"),
    ("switch case stmt case stmt break case stmt", "0 1 case,0 3 case,0 6 default,1 2 fall,2 3 fall_through,3 4 fall,4 5 fall,5 -1 jump,6 7 fall,7 -1 fall", "-1 2 3 4 5 -1 7 -1", "0 1 case,0 2 case,0 3 case,0 4 case,0 5 case,0 6 default,0 7 default"),
    ("stmt loop_header cond continue stmt stmt", "0 1 fall,1 2 true,1 -1 false,2 3 true,2 4 false,3 5 jump,4 5 fall,5 1 fall back", "1 -1 5 5 5 1", "1 1 true,1 2 true,1 5 true,2 3 true,2 4 false"),
    ("loop_header stmt", "0 1 true back,0 -1 false,1 0 fall", "-1 0", "0 0 true,0 1 true"),
    ("cond loop_header stmt stmt", "0 1 true,0 3 false,1 2 true,1 -1 false,2 1 fall back,3 -1 fall", "-1 -1 1 -1", "0 1 true,0 3 false,1 1 true,1 2 true"),
    ("loop_header cond* stmt* cond cond break stmt break", "0 1 true,0 -1 false,1 2 false,1 3 true,2 3 fall,3 4 true,3 7 false,4 5 true,4 6 false,5 -1 jump,6 0 fall back,7 -1 jump", "-1 3 3 -1 -1 -1 0 -1", "0 1 true,0 3 true,1 2 false,3 4 true,3 7 false,4 0 false,4 5 true,4 6 false"),
    ("cond goto stmt label stmt", "0 1 true,0 2 false,1 3 jump,2 3 fall,3 4 fall,4 -1 fall", "3 3 3 4 -1", "0 1 true,0 2 false"),
]
_FIRST = "CASE WHEN k = 4 THEN 1 ELSE 0 END"  # a do loop begins with its body


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else str(v).lower() if isinstance(v, bool) else f"'{v}'" for v in r) + ")" for r in rows) + ")"


_BRANCHED = f"""WITH sized AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_linenumber + l_partkey) % 8 AS BIGINT) AS k, ([{', '.join(map(str, corpus.BRANCH_NODES))}])[CAST((l_linenumber + l_partkey) % 8 AS BIGINT) + 1] AS size FROM lineitem),
  put AS (SELECT *, CAST(3 + sum(size) OVER o - size AS BIGINT) AS base, lead(k) OVER o AS next_k, first_value(CASE WHEN k <> 5 THEN k END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_k, row_number() OVER o AS place
    FROM sized WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, k ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT o_orderkey, 'order_' || o_orderkey AS function, put.*, base + size + CASE WHEN next_k = 4 THEN 1 ELSE 0 END AS next, next_k IS NULL AS final FROM orders JOIN put ON o_orderkey = l_orderkey),
  t AS (SELECT o_orderkey, 'order_' || o_orderkey AS function, CAST(3 + coalesce(sum(size), 0) AS BIGINT) AS ret, min_by(k, place) AS first_k FROM orders LEFT JOIN put ON o_orderkey = l_orderkey GROUP BY o_orderkey),
  nodes(k, n, kind, internal) AS {_values([(k, n, x.rstrip('*'), 1 if x.endswith('*') else 0) for k, s in enumerate(_SHAPES) for n, x in enumerate(s[0].split())])},
  edges(k, s, d, kind, back) AS {_values([(k, int(e.split()[0]), int(e.split()[1]), e.split()[2], 1 if e.endswith('back') else 0) for k, s in enumerate(_SHAPES) for e in s[1].split(',')])},
  ipdoms(k, n, d) AS {_values([(k, n, int(d)) for k, s in enumerate(_SHAPES) for n, d in enumerate(s[2].split())])},
  depends(k, s, d, kind) AS {_values([(k, int(e.split()[0]), int(e.split()[1]), e.split()[2]) for k, s in enumerate(_SHAPES) for e in s[3].split(',')])}"""
_EDGES = """SELECT function, 0 AS src, 2 AS dst, 'fall' AS kind, false AS back FROM t UNION ALL SELECT function, 2, 3 + CASE WHEN first_k = 4 THEN 1 ELSE 0 END, 'fall', false FROM t UNION ALL SELECT function, ret, 1, 'jump', false FROM t
  UNION ALL SELECT function, base + s, CASE WHEN d < 0 THEN next ELSE base + d END, kind, back = 1 FROM b JOIN edges USING (k)"""


def _slices() -> list[tuple]:
    """Statements' nodes that the last node of each depends on, itself included."""
    out = []
    for k, s in enumerate(_SHAPES):
        ties = [tuple(map(int, e.split()[:2])) for e in s[3].split(",")]
        found = {len(s[0].split()) - 1}
        while more := {a for a, b in ties if b in found} - found:
            found |= more
        out += [(k, n) for n in sorted(found)]
    return out


_COUNTED = [(k, len(s[1].split(",")), s[1].count("back"), len({e.split()[1] for e in s[1].split(",") if e.endswith("back")}), c, n, d, st, sc) for k, (s, (c, n, d, st, sc)) in enumerate(zip(_SHAPES, [(2, 1, 0, 3, 1), (1, 1, 0, 1, 1), (1, 1, 0, 9, 0), (3, 2, 1, 5, 0), (1, 1, 1, 3, 0), (4, 2, 1, 7, 0), (4, 2, 1, 5, 1), (2, 1, 0, 5, 0)], strict=True))]
_POINTERS = f"""WITH items AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_quantity > {LOOPS} THEN 'w' ELSE 'c' END AS k, CASE WHEN l_returnflag = 'R' THEN '    p = &y;' WHEN l_quantity > {LOOPS} THEN '    *p = ' || CAST(floor(l_quantity) AS BIGINT) || ';' ELSE '    b = *p;' END AS s FROM lineitem),
  placed AS (SELECT l_orderkey, k, count(*) FILTER (k = 'w') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, s ROWS UNBOUNDED PRECEDING) AS before FROM items),
  f AS (SELECT o_orderkey, 'order_' || o_orderkey AS name, count(*) FILTER (k = 'r') AS r, count(*) FILTER (k = 'w') AS w, count(*) FILTER (k = 'c') AS c, coalesce(sum(before) FILTER (k = 'c'), 0) AS seen, o_orderkey % 2 AS odd FROM orders LEFT JOIN placed ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""
# Accesses of each statement as "place; op" in order; `t` are places through a pointer, which fall on "?" too once the pointer has moved.
_WALKS = f"""WITH items AS (SELECT l_orderkey, 4 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, s) - 1 AS node, k FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_quantity > {LOOPS} THEN 'w' ELSE 'c' END AS k, CASE WHEN l_returnflag = 'R' THEN '    p = p->next;' WHEN l_quantity > {LOOPS} THEN '    p->v = ' || CAST(floor(l_quantity) AS BIGINT) || ';' ELSE '    b = q->v;' END AS s FROM lineitem)),
  f AS (SELECT o_orderkey, count(node) AS n, count(*) FILTER (k = 'r') > 0 AS moved FROM orders LEFT JOIN items ON o_orderkey = l_orderkey GROUP BY o_orderkey),
  s AS (SELECT o_orderkey, moved, unnest([0, 2, 3, 4 + n]) AS node, unnest(['e', 'd', 'i', 'x']) AS k FROM f UNION ALL SELECT o_orderkey, moved, node, k FROM f JOIN items ON o_orderkey = l_orderkey),
  kinds AS (SELECT * FROM (VALUES ('e', 'p', 'write'), ('e', 'b', 'write'), ('d', 'p', 'read'), ('d', 'q', 'write'), ('i', 'q', 'read'), ('i', '*p.v', 'write'), ('r', 'p', 'read'), ('r', '*p.next', 'read'), ('r', 'p', 'write'), ('w', 'p', 'read'), ('w', '*p.v', 'write'), ('c', 'q', 'read'), ('c', '*p.v', 'read'), ('c', 'b', 'write'), ('x', 'q', 'read'), ('x', '*p.v', 'read')) AS v (k, region, op)),
  a AS (SELECT o_orderkey, node, op, region, region NOT LIKE '*%' OR NOT moved AS strong FROM s JOIN kinds USING (k) UNION ALL SELECT o_orderkey, node, op, '?', false FROM s JOIN kinds USING (k) WHERE region LIKE '*%' AND moved),
  w AS (SELECT *, (SELECT min(node) FROM a b WHERE b.o_orderkey = a.o_orderkey AND b.region = a.region AND b.op = 'write' AND b.strong AND b.node > a.node) AS ends FROM a WHERE op = 'write')"""
_VIEWS = (
    _BRANCHED + """, vn AS (SELECT function, id, kind, CASE WHEN internal THEN 'true' ELSE 'false' END AS inside FROM (SELECT function, unnest([0, 1, 2, ret]) AS id, unnest(['entry', 'exit', 'stmt', 'return']) AS kind, false AS internal FROM t UNION ALL SELECT function, base + n, kind, internal = 1 FROM b JOIN nodes USING (k))),
  ve AS (SELECT *, row_number() OVER (PARTITION BY function ORDER BY src, ord) - 1 AS i, max(CAST(back AS INT)) OVER (PARTITION BY function) AS looped FROM (SELECT function, 0 AS src, 2 AS dst, 'fall' AS kind, false AS back, 0 AS ord FROM t UNION ALL SELECT function, 2, 3 + CASE WHEN first_k = 4 THEN 1 ELSE 0 END, 'fall', false, 0 FROM t
    UNION ALL SELECT function, ret, 1, 'jump', false, 0 FROM t UNION ALL SELECT function, base + s, CASE WHEN d < 0 THEN next ELSE base + d END, kind, back = 1, ord FROM b JOIN (SELECT *, row_number() OVER () AS ord FROM edges) USING (k)))"""
)
_NL = "chr(10)"


def _text(head: str, node: str, edge: str, tail: str, between: str = "''") -> str:
    return _VIEWS + f" SELECT t.function AS name, {head} || (SELECT string_agg({node}, {between} ORDER BY id) FROM vn WHERE vn.function = t.function) || {edge} || {tail} AS text FROM t"


def _ties(edge: str, between: str = "''") -> str:
    return f"(SELECT string_agg({edge}, {between} ORDER BY i) FROM ve WHERE ve.function = t.function)"


ORACLE |= {
    "export_dot": _text(f"'digraph \"' || t.function || '\" {{' || {_NL} || '  node [shape=box, fontname=monospace, fontsize=10];' || {_NL}", f"'  n' || id || ' [label=\"' || kind || '\", expression_internal=\"' || inside || '\"];' || {_NL}",
        _ties(f"'  n' || src || ' -> n' || dst || ' [label=\"' || kind || '\"' || CASE WHEN back THEN ', back=\"true\"' ELSE '' END || '];' || {_NL}"), f"'}}' || {_NL}"),
    "export_mermaid": _text(f"'flowchart TD' || {_NL}", f"'  n' || id || '[\"' || kind || '\"]' || {_NL}", _ties(f"'  n' || src || ' -->|' || kind || '| n' || dst || {_NL}"), "''"),
    "export_json": _VIEWS + " SELECT t.function AS name, '{\"directed\": true, \"edges\": [' || " + _ties("'{' || CASE WHEN back THEN '\"back\": \"true\", ' ELSE '' END || '\"label\": \"' || kind || '\", \"source\": ' || src || ', \"target\": ' || dst || '}'", "', '")
        + " || '], \"graph\": {\"name\": \"' || t.function || '\"}, \"multigraph\": true, \"nodes\": [' || (SELECT string_agg('{\"expression_internal\": \"' || inside || '\", \"id\": ' || id || ', \"label\": \"' || kind || '\"}', ', ' ORDER BY id) FROM vn WHERE vn.function = t.function) || ']}' AS text FROM t",
    "export_graphml": _text(
        f"'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || {_NL} || '<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">' || {_NL} || '  <key id=\"nd0\" for=\"node\" attr.name=\"label\" attr.type=\"string\"/>' || {_NL} || '  <key id=\"nd1\" for=\"node\" attr.name=\"expression_internal\" attr.type=\"string\"/>' || {_NL} "
        f"|| '  <key id=\"ed0\" for=\"edge\" attr.name=\"label\" attr.type=\"string\"/>' || {_NL} || (SELECT CASE WHEN max(looped) = 1 THEN '  <key id=\"ed1\" for=\"edge\" attr.name=\"back\" attr.type=\"string\"/>' || {_NL} ELSE '' END FROM ve WHERE ve.function = t.function) || '  <graph id=\"' || t.function || '\" edgedefault=\"directed\">' || {_NL}",
        f"'    <node id=\"n' || id || '\">' || {_NL} || '      <data key=\"nd0\">' || kind || '</data>' || {_NL} || '      <data key=\"nd1\">' || inside || '</data>' || {_NL} || '    </node>' || {_NL}",
        _ties(f"'    <edge id=\"e' || i || '\" source=\"n' || src || '\" target=\"n' || dst || '\">' || {_NL} || '      <data key=\"ed0\">' || kind || '</data>' || {_NL} || CASE WHEN back THEN '      <data key=\"ed1\">true</data>' || {_NL} ELSE '' END || '    </edge>' || {_NL}"),
        f"'  </graph>' || {_NL} || '</graphml>' || {_NL}"),
    "parity_blocks": ORACLE["chain_contraction"].replace("SELECT name AS function,", "SELECT name, n AS n_blocks, n - 1 + r + w AS n_edges, n <= 1 AS degenerate FROM (SELECT name, r, w,").replace("AS n_blocks FROM f LEFT JOIN m ON o_orderkey = l_orderkey", "- 2 AS n FROM f LEFT JOIN m ON o_orderkey = l_orderkey)"),
    "graphs_alike": f"SELECT 'order_' || o_orderkey AS name, NOT coalesce(bool_or(l_returnflag <> 'R' AND l_quantity > {LOOPS} AND l_quantity <= {LOOPS_AFTER}), false) AS isomorphic FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "damaged_graphs": _BRANCHED + " SELECT function, 'condition_arms' AS problem, base + n AS node FROM b JOIN nodes USING (k) WHERE kind = 'cond' AND o_orderkey % 2 = 0",
    "manifest_problems": "SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'duplicate_id' END, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 THEN 'missing_source' END, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 19 = 0 THEN 'malformed_hash' END, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 17 <> 0 THEN 'hash_drift' END, CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 17 <> 0 THEN 'bad_slice' END], lambda x: x IS NOT NULL)) AS problem FROM orders "
    # slices by source, those given twice under no source too
    "UNION ALL SELECT DISTINCT id, 'overlap' FROM (SELECT *, max(high) OVER (PARTITION BY path ORDER BY low, high, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT id, low, CASE WHEN id % 11 = 0 THEN 1000 ELSE low + 1 END AS high, unnest(CASE WHEN id % 13 = 0 THEN [path, 'none'] ELSE [path] END) AS path FROM (SELECT o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 40 AS low, CASE WHEN o_orderkey % 17 = 0 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END AS path FROM orders))) WHERE reach > low",
    "shape_measures": "WITH s AS (SELECT DISTINCT p_size AS n, unnest([" + ", ".join(f"'{x}'" for x in corpus.SHAPES) + "]) AS shape FROM part) SELECT shape || ':' || n AS source_id, CASE WHEN shape IN ('parameters', 'function_pointers') THEN n WHEN shape LIKE 'nested%' OR shape IN ('branches', 'cases') THEN 2 WHEN shape = 'declarators' THEN 0 ELSE 1 END AS parameters, "
    "CASE WHEN shape LIKE 'nested%' OR shape IN ('branches', 'cases', 'gotos') THEN n + 1 ELSE 1 END AS cyclomatic, CASE WHEN shape LIKE 'nested%' THEN n * (n + 1) // 2 WHEN shape = 'branches' THEN n WHEN shape = 'gotos' THEN 2 * n WHEN shape = 'cases' THEN 1 ELSE 0 END AS cognitive, "
    "CASE WHEN shape LIKE 'nested%' THEN n WHEN shape IN ('branches', 'cases', 'gotos') THEN 1 ELSE 0 END AS max_nesting, CASE WHEN shape = 'nested_loops' THEN n ELSE 0 END AS max_loop_depth, CASE WHEN shape = 'calls' THEN n ELSE 0 END AS calls, CASE WHEN shape = 'gotos' THEN n ELSE 0 END AS gotos, CASE WHEN shape = 'cases' THEN n ELSE 0 END AS nodes_case FROM s",
    "shape_times": "WITH s AS (SELECT DISTINCT p_size AS n, shape, x0, x1, x2, x3 FROM part, " + _values([(k, *v) for k, v in corpus.SHAPES.items()]) + " AS t(shape, x0, x1, x2, x3)) SELECT shape || ':' || n AS source_id, strlen(x0 || list_reduce(list_transform(range(n), lambda i: replace(x1, '#', CAST(i AS VARCHAR))), lambda a, b: a || x3 || b) || replace(x2, '{closing}', repeat('}', n))) AS bytes, true AS timed, true AS ordered FROM s",
    "parity_units": f"WITH {_base()}, {_base(LOOPS_AFTER, 'g')} SELECT 'a' AS unit, count(*) AS n, count(*) AS own FROM f UNION ALL SELECT 'b', count(*), count(*) FILTER (r + w > 0) FROM g",
    "ast_tags": _sql("SELECT tag, n FROM (SELECT unnest(['func_def', 'decl_specifiers', 'declarator', 'decl_name', 'param_list', 'param_decl', 'compound_stmt', 'decl', 'initializer', 'literal', 'return_stmt', 'name_ref', 'if_stmt', 'while_stmt', 'binary_expr', 'expr_stmt', 'assign_expr', 'postfix_expr', 'call_args']) AS tag, "
        "unnest([count(*), 2 * count(*), 2 * count(*), 2 * count(*), count(*), 2 * count(*), sum(1 + r + w), count(*), count(*), sum(1 + 2 * r + 2 * w + c), count(*), sum(1 + 3 * r + 3 * w + 4 * c), sum(r), sum(w), sum(2 * r + 2 * w + c), sum(r + w + c), sum(r + w + c), sum(c), sum(c)])::BIGINT AS n FROM f) WHERE n > 0"),
    "flow_edges": f"""WITH {_base()}, items AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_quantity > {LOOPS} THEN 'w' ELSE 'c' END AS k, CASE WHEN l_returnflag = 'R' THEN '    if (a > ' || CAST(floor(l_quantity) AS BIGINT) WHEN l_quantity > {LOOPS} THEN '    while (total < ' || CAST(floor(l_quantity) AS BIGINT) ELSE '    total = ' END AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      g AS (SELECT *, count(*) FILTER (k = 'c') OVER o - CASE WHEN k = 'c' THEN 1 ELSE 0 END AS run FROM items WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, s, k ROWS UNBOUNDED PRECEDING)),
      h AS (SELECT l_orderkey, k, run, row_number() OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber, l_partkey, s, k) AS defs FROM g),
      ends AS (SELECT o_orderkey, 1 + coalesce((SELECT count(*) FROM g WHERE g.l_orderkey = f.o_orderkey AND k <> 'c' AND run = f.c), 0) AS defs FROM f)
      SELECT 'a' AS variable, sum(r + c)::BIGINT AS n FROM f HAVING sum(r + c) > 0 UNION ALL SELECT 'total', ((SELECT sum(CASE k WHEN 'w' THEN 2 * (defs + 1) ELSE defs END) FROM h) + (SELECT sum(defs) FROM ends))::BIGINT""",
    # callees are looked at by name, until the one that is asked for
    "reach_claims": f"""WITH {_base()}, s AS (SELECT l_orderkey, bool_or(s = 7) AS found, min('supplier_' || s) AS least FROM f_items WHERE k = 'c' GROUP BY 1)
      SELECT name AS from_function, CASE WHEN c = 0 THEN 'no_may_path' WHEN found THEN 'found_may_path' ELSE 'unknown' END AS claim, CASE WHEN c = 0 THEN '' WHEN found AND least >= 'supplier_7' THEN 'incomplete_summary' ELSE 'incomplete_summary,missing_callee' END AS uncertainty FROM f LEFT JOIN s ON o_orderkey = l_orderkey""",
    "graph_nodes": _BRANCHED + " SELECT function, id, kind, internal, true AS live, true AS ends FROM (SELECT function, unnest([0, 1, 2, ret]) AS id, unnest(['entry', 'exit', 'stmt', 'return']) AS kind, false AS internal FROM t UNION ALL SELECT function, base + n, kind, internal = 1 FROM b JOIN nodes USING (k))",
    "graph_edges": _BRANCHED + " " + _EDGES,
    "branch_measures": _BRANCHED + f", c(k, e, backs, heads, cognitive, nesting, depth, statements, shorts) AS {_values(_COUNTED)}, m AS (SELECT t.function AS name, ret + 1 AS cfg_nodes, coalesce(sum(e), 0) + 3 AS cfg_edges, coalesce(sum(backs), 0) AS back_edges, coalesce(sum(heads), 0) AS loops, coalesce(sum(cognitive), 0) AS cognitive, "
    "coalesce(max(nesting), 0) AS max_nesting, coalesce(max(depth), 0) AS max_loop_depth, coalesce(sum(statements), 0) + 2 AS statements, coalesce(sum(shorts), 0) AS short_circuits, count(*) FILTER (b.k = 7) AS gotos, 3 * count(*) FILTER (b.k = 2) AS nodes_case, count(*) FILTER (b.k = 2) AS nodes_switch, "
    "count(*) FILTER (b.k = 2) + 2 * count(*) FILTER (b.k = 6) AS nodes_break, count(*) FILTER (b.k = 3) AS nodes_continue, count(*) FILTER (b.k = 7) AS nodes_label FROM t LEFT JOIN b ON t.o_orderkey = b.o_orderkey LEFT JOIN c ON b.k = c.k GROUP BY t.function, ret) SELECT *, cfg_edges - cfg_nodes + 2 AS cyclomatic, cfg_edges - cfg_nodes + 1 AS decision_points FROM m",
    "control_dependence": _BRANCHED + ' SELECT function, base + s AS "on", base + d AS node, kind FROM b JOIN depends USING (k)',
    "post_dominators": _BRANCHED + " SELECT function, node, ipdom, false AS dead_end FROM (SELECT function, 0 AS node, 2 AS ipdom FROM t UNION ALL SELECT function, 1, -1 FROM t UNION ALL SELECT function, 2, 3 + CASE WHEN first_k = 4 THEN 1 ELSE 0 END FROM t UNION ALL SELECT function, ret, 1 FROM t UNION ALL SELECT function, base + n, CASE WHEN d < 0 THEN next ELSE base + d END FROM b JOIN ipdoms USING (k))",
    "control_depth": f"""WITH items AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_quantity > {LOOPS} THEN 'w' ELSE 'c' END AS k, CASE WHEN l_returnflag = 'R' THEN '    if' WHEN l_quantity > {LOOPS} THEN '    while' ELSE '    total' END AS s FROM lineitem),
      p AS (SELECT l_orderkey, k, CAST(3 + sum(CASE k WHEN 'c' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, s, k ROWS UNBOUNDED PRECEDING) - CASE k WHEN 'c' THEN 1 ELSE 2 END AS BIGINT) AS base FROM items),
      n AS (SELECT o_orderkey, CAST(3 + coalesce(sum(CASE k WHEN 'c' THEN 1 WHEN 'r' THEN 2 WHEN 'w' THEN 2 END), 0) AS BIGINT) AS ret FROM orders LEFT JOIN p ON o_orderkey = l_orderkey GROUP BY 1)
      SELECT 'order_' || o_orderkey AS function, node, CAST(node IN (SELECT base + 1 FROM p WHERE l_orderkey = o_orderkey AND k <> 'c') AS BIGINT) AS depth FROM (SELECT o_orderkey, unnest(range(ret + 1)) AS node FROM n)""",
    "descendants": _BRANCHED + " SELECT function, unnest([1, ret]) AS node FROM t UNION ALL SELECT function, base + unnest(range(1, size)) FROM b WHERE final",
    "backward_slices": _BRANCHED + f", kept(k, n) AS {_values(_slices())} SELECT function, base + n AS node FROM b JOIN kept USING (k) WHERE final UNION ALL SELECT function, 2 FROM t WHERE ret = 3",
    "dead_stores": _BRANCHED + """, w AS (SELECT o_orderkey, CASE WHEN after_k IN (1, 2, 7) THEN 1 ELSE 0 END AS dies, k FROM b), d AS (SELECT t.o_orderkey, t.function, sum(CASE k WHEN 0 THEN dies WHEN 1 THEN dies WHEN 2 THEN 1 + 2 * dies WHEN 5 THEN dies WHEN 7 THEN 1 + dies ELSE 0 END) AS n,
      count(*) FILTER (k IN (0, 2, 5, 6, 7)) AS a, count(*) FILTER (k IN (0, 1, 3, 5, 6)) AS b FROM t LEFT JOIN w ON t.o_orderkey = w.o_orderkey GROUP BY 1, 2), begun AS (SELECT o_orderkey, min_by(k, place) FILTER (k <> 5) AS k FROM b GROUP BY 1)
      SELECT function, coalesce(n, 0) + CASE WHEN begun.k IN (1, 2, 7) THEN 1 ELSE 0 END AS n_dead, list_concat(CASE WHEN a = 0 THEN ['a'] ELSE [] END, CASE WHEN b = 0 THEN ['b'] ELSE [] END) AS unused FROM d LEFT JOIN begun ON d.o_orderkey = begun.o_orderkey""",
    "mem_points_to": _POINTERS + " SELECT name AS function, 'in' AS place, '*in' AS target FROM f UNION ALL SELECT name, 'p', 'x' FROM f UNION ALL SELECT name, 'p', 'y' FROM f WHERE r > 0 UNION ALL SELECT 'touch_' || o_orderkey, 'q', '*q' FROM f WHERE odd = 0",
    "mem_accesses": _POINTERS + " SELECT name AS function, 2 + CASE WHEN r = 0 THEN w ELSE 0 END AS n_strong, CASE WHEN r > 0 THEN 2 * w ELSE 0 END AS n_weak, 1 + CASE WHEN r > 0 THEN 2 * c ELSE c END AS n_reads FROM f",
    "mem_flows": _POINTERS + " SELECT name AS function, CASE WHEN r > 0 THEN 2 * (c + seen) + (1 + w) * (1 + odd) ELSE c + 1 + odd END + odd AS n, CASE WHEN r > 0 THEN 1 + w ELSE 1 END + odd AS n_last FROM f",
    "mem_walks": _WALKS + " SELECT 'walk_' || w.o_orderkey AS function, w.node AS write_node, r.node AS read_node, w.region, r.region AS read_region, CASE WHEN '?' IN (w.region, r.region) THEN 'unknown' ELSE 'same' END AS via, count(*) AS n FROM w JOIN a r ON w.o_orderkey = r.o_orderkey AND r.op = 'read' AND w.node < r.node AND r.node <= coalesce(w.ends, r.node) AND (w.region = r.region OR '?' IN (w.region, r.region)) GROUP BY ALL",
    "mem_effects": "SELECT 'touch_' || o_orderkey AS function, 0 AS parameter, 'write' AS op FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'order_' || o_orderkey, 0, 'write' FROM orders WHERE o_orderkey % 2 = 0",
    "mem_overlaps": "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['v.f'] WHEN 1 THEN ['t.a.b'] ELSE ['*p'] END) AS region, CASE o_orderkey % 3 WHEN 0 THEN 'v.i' WHEN 1 THEN 't.a' ELSE '*q' END AS other, CASE o_orderkey % 3 WHEN 0 THEN 'union' WHEN 1 THEN 'containment' ELSE 'parameters' END AS why FROM orders",
    "mem_uninitialised": "SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'p' AS place FROM orders WHERE o_orderkey % 2 <> 0",
}
ORACLE["typed_operations"] = (
    f"WITH c AS ({ORACLE['usual_conversions']}), o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, ([{', '.join(repr(t) for t in TYPED)}])[CAST(o_orderkey % {len(TYPED)} AS INT) + 1] AS a, ([{', '.join(repr(t) for t in TYPED)}])[CAST(o_custkey % {len(TYPED)} AS INT) + 1] AS b FROM orders), "
    "p AS (SELECT id, o.a AS a, o.b AS b, c.common AS m, x.common AS pa, y.common AS pb FROM o JOIN c ON c.a = o.a AND c.b = o.b JOIN c x ON x.a = o.a AND x.b = '_Bool' JOIN c y ON y.a = o.b AND y.b = '_Bool'), "
    "q AS (SELECT *, CASE WHEN a = m THEN '-' ELSE m END || '|' || CASE WHEN b = m THEN '-' ELSE m END AS two FROM p) "
    "SELECT id AS source_id, unnest([0, 1, 2, 3, 4, 5, 6, 7])::BIGINT AS ord, unnest(['+', '=', '<<', '=', '<', '=', '-', '=']) AS op, unnest([m, 'long', pa, 'long', 'int', 'long', pa, 'long']) AS type, unnest([a || '|' || b, m, a || '|' || b, pa, a || '|' || b, 'int', a, pa]) AS operands, "
    "unnest([two, CASE WHEN m = 'long' THEN '-' ELSE 'long' END, CASE WHEN a = pa THEN '-' ELSE pa END || '|' || CASE WHEN b = pb THEN '-' ELSE pb END, CASE WHEN pa = 'long' THEN '-' ELSE 'long' END, two, 'long', CASE WHEN a = pa THEN '-' ELSE pa END, CASE WHEN pa = 'long' THEN '-' ELSE 'long' END]) AS converted FROM q"
)
ORACLE["typed_members"] = (
    ORACLE["typed_operations"].partition(" SELECT id AS source_id")[0]
    + " SELECT id AS source_id, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9])::BIGINT AS ord, unnest(['member', 'member', '+', 'member', 'member', '+', 'member', '[]', '+', 'call']) AS op, unnest(['struct s *', a, m, 'struct s', a, m, a || ' *', a, m, a]) AS type, "
    "unnest(['struct s *', 'struct s *', a || '|' || b, 'struct t', 'struct s', a || '|' || b, 'struct s *', a || ' *|int', a || '|' || b, 'int']) AS operands, unnest(['-', '-', two, '-', '-', two, '-', '-|-', two, '-']) AS converted FROM q "
    "UNION ALL SELECT id, 10, '+', m, a || '|' || b, two FROM q"
)
ORACLE["resolved_names"] = """WITH i AS (SELECT l_orderkey AS k, l_returnflag = 'R' AS r, count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'z' ELSE 'y' END ROWS UNBOUNDED PRECEDING) AS d FROM lineitem),
  o AS (SELECT o_orderkey AS k, count(*) FILTER (r) AS r, count(*) FILTER (NOT r) AS c FROM orders LEFT JOIN i ON o_orderkey = k GROUP BY o_orderkey),
  u AS (SELECT k, 'x' AS name, CASE WHEN d = 0 THEN 'parameter' ELSE 'local' END AS kind, CASE WHEN d = 0 THEN 1 ELSE 2 + d END AS depth, count(*) AS n FROM i WHERE NOT r GROUP BY ALL
    UNION ALL SELECT k, unnest(['x', 'y', 'g', 'g', 'A', 'B', 'T', 'missing']), unnest(['parameter', 'parameter', 'object', 'local', 'enumerator', 'enumerator', 'typedef', '?']), unnest([1, 1, 0, 3, 0, 0, 0, -1]), unnest([1, 1 + c, 1 + c, 3, 1, 1, 2 + r, 1]) FROM o)
  SELECT CAST(k AS VARCHAR) AS source_id, name, kind, depth, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL"""
ORACLE["bound_captures"] = """WITH i AS (SELECT l_orderkey AS k, l_returnflag = 'R' AS r, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'n' ELSE 'i' END) AS def FROM lineitem),
  d AS (SELECT o_orderkey AS k, 0 AS def, true AS r FROM orders UNION ALL SELECT k, def, r FROM i), l AS (SELECT k, max(def) FILTER (r) AS last FROM d GROUP BY k),
  n AS (SELECT k, def FROM d JOIN l USING (k) WHERE def >= last)
  SELECT CAST(k AS VARCHAR) AS source_id, unnest(['a', 'b']) AS "array", 'n' AS variable, def, unnest([1, 2])::BIGINT AS bounds FROM n UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'a', 'm', 1, 1 FROM orders"""
ORACLE["eval_runs"] = """WITH x AS (SELECT l_orderkey AS id, list('f' || l_suppkey % 3) AS e, coalesce(list('f' || l_suppkey % 3) FILTER (l_returnflag <> 'R'), []) AS f FROM lineitem GROUP BY 1),
  m AS (SELECT o_orderkey AS id, o_custkey, unnest([o_orderpriority, 'all']) AS family, coalesce(e, []) AS e, coalesce(f, []) AS f, o_orderkey % 1000 AS bytes FROM orders LEFT JOIN x ON id = o_orderkey),
  t AS (SELECT family, count(*) AS specimens, sum(len(e))::BIGINT AS expected, sum(bytes)::BIGINT AS input_bytes FROM m GROUP BY 1),
  r AS (SELECT *, 'run' || o_custkey % 3 AS run_id, CASE WHEN id % 7 = 0 THEN 'timeout' ELSE 'ok' END AS status, CASE WHEN id % 5 <> 0 THEN id % 2 = 0 END AS s FROM m WHERE id % 13 <> 0)
  SELECT run_id, family, specimens, count(*) AS results, concat_ws(',', CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN 'ok=' || count(*) FILTER (status = 'ok') END, CASE WHEN count(*) FILTER (status = 'timeout') > 0 THEN 'timeout=' || count(*) FILTER (status = 'timeout') END) AS statuses, expected,
    sum(len(list_filter(e, lambda q: list_contains(f, q))))::BIGINT AS expected_found, count(*) FILTER (len(f) = 0) AS without_functions, sum(len(f))::BIGINT AS found, input_bytes, count(*) FILTER (id % 11 <> 0) AS reporting_coverage, (sum(id % 100) FILTER (id % 11 <> 0))::BIGINT AS covered_bytes,
    count(*) FILTER (s) AS syntax_complete_true, count(*) FILTER (NOT s) AS syntax_complete_false, count(*) FILTER (s IS NULL) AS syntax_complete_unavailable, count(*) FILTER (id % 3 = 0) AS cfg_complete_true, count(*) FILTER (id % 3 <> 0) AS cfg_complete_false, 0 AS cfg_complete_unavailable
  FROM r JOIN t USING (family) GROUP BY run_id, family, specimens, expected, input_bytes"""
# Operations in order: whether it is there, kind, op, type, inputs, block, root, guard, whether it holds, what stands for it if it isn't there, type converted from, operand type, access, name.
_LOWERED = (
    f"WITH c AS ({ORACLE['usual_conversions']}), o AS (SELECT o_orderkey, o_custkey, ([{', '.join(repr(t) for t in TYPED)}])[CAST(o_orderkey % {len(TYPED)} AS INT) + 1] AS a, ([{', '.join(repr(t) for t in TYPED)}])[CAST(o_custkey % {len(TYPED)} AS INT) + 1] AS b FROM orders), "
    "p AS (SELECT o_orderkey, o_custkey, o.a AS a, o.b AS b, c.common AS m, x.common AS pa, y.common AS pb, z.common AS mb FROM o JOIN c ON c.a = o.a AND c.b = o.b JOIN c x ON x.a = o.a AND x.b = '_Bool' JOIN c y ON y.a = o.b AND y.b = '_Bool' JOIN c z ON z.a = o.b AND z.b = 'int'), "
    "s AS (SELECT o_orderkey, o_custkey, unnest(["
    + ", ".join(
        "{" + f"'seq': {i}, 'here': {here}, 'kind': '{kind}', 'op': '{op}', 'type': {t}, 'ins': {ins}::INT[], 'block': {block}, 'root': {root}, 'guard': {guard}, 'holds': '{holds}', 'falls': {falls}, 'source': {source}, 'operand': {operand}, 'access': '{access}', 'name': '{name}'" + "}"
        for i, here, kind, op, t, ins, block, root, guard, holds, falls, source, operand, access, name in [
            (1, "true", "load", "a", "a", [], 2, 0, 0, "", 0, "''", "''", "scalar", "a"),
            (2, "true", "load", "b", "b", [], 2, 0, 0, "", 0, "''", "''", "scalar", "b"),
            (3, "pa <> a", "convert", "promotion", "pa", [1], 2, 0, 0, "", 1, "a", "''", "", ""),
            (4, "pb <> b", "convert", "promotion", "pb", [2], 2, 0, 0, "", 2, "b", "''", "", ""),
            (5, "m <> pa", "convert", "usual_arithmetic", "m", [3], 2, 0, 0, "", 3, "pa", "''", "", ""),
            (6, "m <> pb", "convert", "usual_arithmetic", "m", [4], 2, 0, 0, "", 4, "pb", "''", "", ""),
            (7, "true", "binary", "+", "m", [5, 6], 2, 0, 0, "", 0, "''", "m", "", ""),
            (8, "a <> m", "convert", "assignment", "a", [7], 2, 0, 0, "", 7, "m", "''", "", ""),
            (9, "true", "store", "=", "a", [8], 2, 0, 0, "", 0, "''", "a", "scalar", "a"),
            (10, "true", "load", "a", "a", [], 3, 1, 0, "", 0, "''", "''", "scalar", "a"),
            (11, "true", "load", "b", "b", [], 4, 1, 10, "true", 0, "''", "''", "scalar", "b"),
            (12, "true", "const", "1", "'int'", [], 4, 1, 10, "true", 0, "''", "''", "", ""),
            (13, "pb <> b", "convert", "promotion", "pb", [11], 4, 1, 10, "true", 11, "b", "''", "", ""),
            (14, "mb <> pb", "convert", "usual_arithmetic", "mb", [13], 4, 1, 10, "true", 13, "pb", "''", "", ""),
            (15, "mb <> 'int'", "convert", "usual_arithmetic", "mb", [12], 4, 1, 10, "true", 12, "'int'", "''", "", ""),
            (16, "true", "binary", "+", "mb", [14, 15], 4, 1, 10, "true", 0, "''", "mb", "", ""),
            (17, "b <> mb", "convert", "assignment", "b", [16], 4, 1, 10, "true", 16, "mb", "''", "", ""),
            (18, "true", "store", "=", "b", [17], 4, 1, 10, "true", 0, "''", "b", "scalar", "b"),
            (19, "true", "const", "1", "'int'", [], 4, 1, 10, "true", 0, "''", "''", "", ""),
            (20, "true", "call", "f", "'int'", [11, 19], 4, 1, 10, "true", 0, "''", "''", "", ""),
            (21, "true", "const", "0", "'int'", [], 5, 1, 10, "false", 0, "''", "''", "", ""),
            (22, "true", "binary", "&&", "'int'", [10, 20, 21], 5, 1, 0, "", 0, "''", "'int'", "", ""),
            (23, "true", "load", "a", "a", [], 6, 1, 22, "true", 0, "''", "''", "scalar", "a"),
            (24, "true", "load", "b", "b", [], 7, 1, 22, "false", 0, "''", "''", "scalar", "b"),
            (25, "pa <> a", "convert", "promotion", "pa", [23], 6, 1, 22, "true", 23, "a", "''", "", ""),
            (26, "m <> pa", "convert", "usual_arithmetic", "m", [25], 6, 1, 22, "true", 25, "pa", "''", "", ""),
            (27, "pb <> b", "convert", "promotion", "pb", [24], 7, 1, 22, "false", 24, "b", "''", "", ""),
            (28, "m <> pb", "convert", "usual_arithmetic", "m", [27], 7, 1, 22, "false", 27, "pb", "''", "", ""),
            (29, "true", "select", "?:", "m", [22, 26, 28], 8, 1, 0, "", 0, "''", "''", "", ""),
            (30, "m <> 'int'", "convert", "assignment", "'int'", [29], 8, 1, 0, "", 29, "m", "''", "", ""),
            (31, "true", "return", "return", "'void'", [30], 9, 1, 0, "", 0, "''", "''", "", ""),
        ]
    )
    + "], recursive := true) FROM p), n AS (SELECT *, count(*) FILTER (here) OVER (PARTITION BY o_orderkey ORDER BY seq) - 1 AS place FROM s), "
    # an operation that isn't there stands for what it would have converted, at most twice
    "f1 AS (SELECT n.o_orderkey, n.seq, CASE WHEN n.here THEN n.place ELSE x.place END AS place, n.here OR x.here AS found, x.falls FROM n LEFT JOIN n x ON x.o_orderkey = n.o_orderkey AND x.seq = n.falls), "
    "ids AS (SELECT f1.o_orderkey, f1.seq, CASE WHEN found THEN f1.place ELSE y.place END AS id FROM f1 LEFT JOIN n y ON y.o_orderkey = f1.o_orderkey AND y.seq = f1.falls), "
    "i AS (SELECT n.o_orderkey, n.seq, string_agg(ids.id, ',' ORDER BY u.k) AS inputs FROM n, unnest(n.ins) WITH ORDINALITY AS u(x, k) JOIN ids ON ids.o_orderkey = n.o_orderkey AND ids.seq = u.x GROUP BY ALL), "
    "l AS (SELECT n.*, n.place AS id, coalesce(i.inputs, '') AS inputs, CASE WHEN guard > 0 THEN g.id || ':' || holds ELSE '' END AS guarded_by FROM n LEFT JOIN i USING (o_orderkey, seq) LEFT JOIN ids g ON g.o_orderkey = n.o_orderkey AND g.seq = guard WHERE here)"
)
ORACLE["lowered_operations"] = _LOWERED + " SELECT CAST(o_orderkey AS VARCHAR) AS source_id, id, kind, op, type, inputs, block, root, guarded_by, source, operand AS operand_type, access, name FROM l"
ORACLE["lowered_orders"] = (
    _LOWERED + ", v AS (SELECT * FROM (VALUES (18, 20, 'sequenced'), (10, 11, 'sequenced'), (10, 12, 'sequenced'), (10, 19, 'sequenced'), (20, 21, 'exclusive'), (26, 28, 'exclusive'), "
    "(18, 23, 'sequenced'), (20, 23, 'sequenced'), (22, 23, 'sequenced'), (18, 24, 'sequenced'), (20, 24, 'sequenced'), (22, 24, 'sequenced')) AS t (a, b, kind)) "
    "SELECT CAST(x.o_orderkey AS VARCHAR) AS source_id, least(x.id, y.id) AS first, greatest(x.id, y.id) AS second, kind FROM v JOIN ids x ON x.seq = a JOIN ids y ON y.seq = b AND y.o_orderkey = x.o_orderkey"
)
ORACLE["lowered_facts"] = _LOWERED + " SELECT CAST(o_orderkey AS VARCHAR) AS source_id, id, 'capacity=' || o_custkey AS facts, 'comment' AS facts_source FROM l WHERE name = 'b' AND o_orderkey % 2 = 1"
_LABEL = "kind || ' ' || op"
ORACLE["export_operations_mermaid"] = (
    _LOWERED + f", e AS (SELECT o_orderkey, id, unnest(string_split(inputs, ',')) AS src, generate_subscripts(string_split(inputs, ','), 1) AS k FROM l WHERE inputs <> '') "
    f"SELECT CAST(o_orderkey AS VARCHAR) AS source_id, 'flowchart TD' || {_NL} || string_agg('  n' || id || '[\"' || {_LABEL} || '\"]' || {_NL}, '' ORDER BY id) || (SELECT string_agg('  n' || src || ' --> n' || e.id || {_NL}, '' ORDER BY e.id, k) FROM e WHERE e.o_orderkey = l.o_orderkey) AS text FROM l GROUP BY o_orderkey"
)
ORACLE["parity_rebuilt"] = f"SELECT name, n_blocks, n_edges, 1 AS n_entries FROM ({ORACLE['parity_blocks']})"
ORACLE["strip_headers_by_window"] = ORACLE["strip_headers"]
ORACLE["eval_closure"] = (
    f"WITH {_base()}, d AS (SELECT name, o_orderkey FROM (SELECT name, o_orderkey, {_N} AS n, {_E} AS e, lead({_N}) OVER w AS m, lead({_E}) OVER w AS x FROM f WINDOW w AS (PARTITION BY floor(o_orderkey / 16) ORDER BY o_orderkey)) WHERE abs(n - m) + abs(e - x) > 0) "
    "SELECT name AS id, 'omitted' AS problem FROM d WHERE o_orderkey % 2 <> 0 UNION ALL SELECT 'order_' || o_orderkey, 'stale' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM d)"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        metrics_graph, metrics_shape, metrics_size, halstead_counts, node_census, edge_census, hotspots_topk, summary_distribution, report_totals, call_graph, defined_names, report_compare, compare_totals, feature_vectors,
        tokens_by_kind, graph_nodes, graph_edges, branch_measures, control_dependence, post_dominators, control_depth, descendants, backward_slices, node_degrees, chain_contraction, graph_problems, ged_size_delta, ged_distance, parity_resolve, parity_blocks, parity_units, data_flow_counts,
        declared_types, type_conflicts, typed_operations, typed_members, resolved_names, bound_captures, eval_runs, lowered_operations, lowered_orders, lowered_facts, usual_conversions, literal_types, mutation_totality, manifest_identity, loop_bounds, constant_loops, stated_facts, ast_tags, source_provenance, dead_stores, flow_edges, call_summaries, reach_claims, file_lines, split_lines, strip_headers, strip_headers_by_window, normalize_decompiled, escape_controls, eval_distribution, eval_strata, eval_overlaps, eval_accuracy,
        eval_problems, eval_closure, mem_points_to, mem_accesses, mem_flows, mem_walks, mem_effects, mem_overlaps, mem_uninitialised, parity_rebuilt, graphs_alike, damaged_graphs, manifest_problems, shape_measures, shape_times,
    )
}
QUERIES |= {f"export_{fmt}": _export(fmt) for fmt in exports.FORMATS}
QUERIES |= {f"export_operations_{fmt}": _export_operations(fmt) for fmt in exports.FORMATS}

#: Whole-number columns of the queries above; both sides give them as 64-bit numbers.
WHOLE = {
    "metrics_graph": "cfg_nodes cfg_edges reachable_nodes unreachable_nodes dead_end_nodes cyclomatic decision_points back_edges loops",
    "metrics_shape": "cognitive max_nesting max_loop_depth statements calls n_callees parameters unreachable_statements short_circuits",
    "metrics_size": "lines code_lines tokens bytes",
    "halstead_counts": "halstead_distinct_operators halstead_distinct_operands halstead_total_operators halstead_total_operands halstead_vocabulary halstead_length",
    "node_census": "n",
    "edge_census": "n",
    "hotspots_topk": "cyclomatic cognitive lines",
    "report_totals": "functions structured_functions gotos unreachable_statements",
    "report_compare": "before_cyclomatic after_cyclomatic before_cognitive after_cognitive before_lines after_lines before_statements after_statements delta_cyclomatic delta_cognitive delta_lines delta_statements",
    "compare_totals": "before after delta",
    "tokens_by_kind": "n",
    "control_dependence": "on node",
    "post_dominators": "node ipdom",
    "control_depth": "node depth",
    "descendants": "node",
    "backward_slices": "node",
    "node_degrees": "in_degree out_degree n",
    "chain_contraction": "n_blocks",
    "graph_problems": "n",
    "ged_size_delta": "distance",
    "parity_resolve": "n_nodes",
    "data_flow_counts": "n_definitions n_uses n_issues",
    "declared_types": "pointer_depth array_rank",
    "mutation_totality": "severity specimens",
    "loop_bounds": "n",
    "constant_loops": "start step",
    "dead_stores": "n_dead",
    "call_summaries": "arity n_transfers",
    "file_lines": "lines bytes counted",
    "split_lines": "doc_id n_lines",
    "normalize_decompiled": "o_orderkey",
    "escape_controls": "o_orderkey",
    "eval_distribution": "n median p95 maximum",
    "eval_strata": "specimens recovered",
    "eval_overlaps": "user_id n",
    "eval_accuracy": "l_orderkey",
    "eval_problems": "id",
    "parity_blocks": "n_blocks n_edges",
    "parity_rebuilt": "n_blocks n_edges n_entries",
    "shape_times": "bytes",
    "shape_measures": "parameters cyclomatic cognitive max_nesting max_loop_depth calls gotos nodes_case",
    "damaged_graphs": "node",
    "manifest_problems": "id",
    "parity_units": "n own",
    "ast_tags": "n",
    "flow_edges": "n",
    "graph_nodes": "id",
    "graph_edges": "src dst",
    "branch_measures": "cfg_nodes cfg_edges cyclomatic decision_points back_edges loops cognitive max_nesting max_loop_depth statements short_circuits gotos nodes_case nodes_switch nodes_break nodes_continue nodes_label",
    "mem_accesses": "n_strong n_weak n_reads",
    "mem_flows": "n n_last",
    "typed_members": "ord",
    "resolved_names": "depth n",
    "bound_captures": "def",
    "eval_runs": "cfg_complete_unavailable",
    "lowered_operations": "id block root",
    "lowered_orders": "first second",
    "lowered_facts": "id",
    "mem_walks": "write_node read_node n",
    "mem_effects": "parameter",
}


def _wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])

    return wide


QUERIES = {name: _wide(query) for name, query in QUERIES.items()}
ORACLE = {name: f"SELECT * REPLACE ({', '.join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in WHOLE[name].split())}) FROM ({sql})" if name in WHOLE else sql for name, sql in ORACLE.items()}
