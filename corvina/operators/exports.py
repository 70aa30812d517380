"""Graph views of functions as text: DOT, GraphML, node-link JSON, Mermaid, written in SQL string functions.

A view is a row: `name, nodes array<struct<id,label,attrs array<struct<k,v>>>>,
edges array<struct<src,dst,label,attrs>>`.  All attribute values are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text formats.
FORMATS = ("dot", "graphml", "json", "mermaid")


def _attrs(**values: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])


def cfg_views(functions: DataFrame, positions: bool = True) -> DataFrame:
    """Control-flow graphs as views, with or without where nodes stand in the text."""

    def attrs(n: Column) -> Column:
        where = {"start": n["lo"], "end": n["hi"]} if positions else {}
        return _attrs(**where, expression_internal=n["internal"])

    nodes = F.transform("cfg_nodes", lambda n: F.struct(n["id"].alias("id"), n["kind"].alias("label"), attrs(n).alias("attrs")))
    edges = F.transform("cfg_edges", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["kind"].alias("label"), F.when(e["back"], _attrs(back=F.lit("true"))).otherwise(F.array().cast("array<struct<k:string,v:string>>")).alias("attrs")))
    return functions.select("source_id", "function_id", "name", nodes.alias("nodes"), edges.alias("edges"))


def cdg_views(functions: DataFrame, dependence: DataFrame, depth: DataFrame | None = None, dominators: DataFrame | None = None) -> DataFrame:
    """Control dependence graphs as views, from `graphs.control_dependence` rows.

    With `graphs.control_depth` and `graphs.post_dominators` rows, nodes tell their depth,
    immediate post-dominator (empty for a root) and whether they reach an end.
    """
    if depth is not None and dominators is not None:
        keys = ["source_id", "function_id"]
        told = depth.select(*keys, "node", "depth").join(dominators.select(*keys, "node", "ipdom"), [*keys, "node"])
        told = told.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("depth", "ipdom")))).alias("told"))
        functions = functions.join(told, keys, "left")
        more = lambda n: _attrs(depth=F.col("told")[n["id"]]["depth"], ipdom=F.coalesce(F.col("told")[n["id"]]["ipdom"].cast("string"), F.lit("")), reaches_exit=n["ends"])
        nodes = F.transform("cfg_nodes", lambda n: F.struct(n["id"].alias("id"), n["kind"].alias("label"), F.concat(_attrs(start=n["lo"], end=n["hi"], expression_internal=n["internal"]), more(n)).alias("attrs")))
        shown = functions.select("source_id", "function_id", "name", nodes.alias("nodes"))
    else:
        shown = cfg_views(functions).drop("edges")
    found = dependence.groupBy("source_id", "function_id").agg(F.sort_array(F.collect_list(F.struct(F.col("on").alias("src"), F.col("node").alias("dst"), F.col("kind").alias("label")))).alias("x"))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    edges = F.transform(F.coalesce("x", F.array().cast("array<struct<src:int,dst:int,label:string>>")), lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["label"].alias("label"), empty.alias("attrs")))
    return shown.join(found, ["source_id", "function_id"], "left").select("source_id", "function_id", "name", "nodes", edges.alias("edges"))


def flow_views(flows: DataFrame) -> DataFrame:
    """Data dependence graphs as views: definitions first, then uses, numbered on; dead stores and unresolved uses are marked."""
    n = F.size("definitions")
    definitions = F.transform("definitions", lambda d: F.struct(d["def"].alias("id"), F.concat(F.lit("def "), d["variable"]).alias("label"), _attrs(kind=d["kind"], start=d["lo"], end=d["hi"], dead=F.array_contains("dead_stores", d["def"])).alias("attrs")))
    uses = F.transform("uses", lambda u: F.struct((u["use"] + n).alias("id"), F.concat(F.lit("use "), u["variable"]).alias("label"), _attrs(kind=F.lit("use"), start=u["lo"], end=u["hi"], unresolved=F.array_contains("unresolved", u["use"])).alias("attrs")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    edges = F.transform("edges", lambda e: F.struct(e["def"].alias("src"), (e["use"] + n).alias("dst"), e["variable"].alias("label"), none.alias("attrs")))
    return flows.select("source_id", "function_id", F.col("function").alias("name"), F.concat(definitions, uses).alias("nodes"), edges.alias("edges"))


def pdg_views(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Program dependence graphs as views, from `flow.pdg_edges` rows."""
    return cdg_views(functions, edges.select("source_id", "function_id", F.col("src").alias("on"), F.col("dst").alias("node"), "kind"))


def ast_views(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """Syntax trees as views, from `annotations.ast_nodes` rows."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    kept = nodes.groupBy("source_id", "function_id").agg(F.sort_array(F.collect_list(F.struct("node", "parent", "tag", "lo", "hi"))).alias("x"))
    shown = F.transform("x", lambda n: F.struct(n["node"].alias("id"), n["tag"].alias("label"), _attrs(start=n["lo"], end=n["hi"]).alias("attrs")))
    edges = F.transform(F.filter("x", lambda n: n["parent"].isNotNull()), lambda n: F.struct(n["parent"].alias("src"), n["node"].alias("dst"), F.lit("").alias("label"), none.alias("attrs")))
    return kept.join(functions.select("source_id", "function_id", "name"), ["source_id", "function_id"]).select("source_id", "function_id", "name", shown.alias("nodes"), edges.alias("edges"))


def _quoted(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))


def _xml(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _lines(items: Column, each) -> Column:
    return F.array_join(F.transform(items, each), "")


def dot(name: Column, nodes: Column, edges: Column) -> Column:
    def pairs(attrs: Column) -> Column:
        return F.transform(attrs, lambda a: F.concat(a["k"], F.lit("="), _quoted(a["v"])))

    def node(n: Column) -> Column:
        inner = F.concat(F.array(F.concat(F.lit("label="), _quoted(n["label"]))), pairs(n["attrs"]))
        return F.concat(F.lit("  n"), n["id"].cast("string"), F.lit(" ["), F.array_join(inner, ", "), F.lit("];\n"))

    def edge(e: Column) -> Column:
        label = F.when(e["label"] != "", F.array(F.concat(F.lit("label="), _quoted(e["label"])))).otherwise(F.array().cast("array<string>"))
        inner = F.concat(label, pairs(e["attrs"]))
        tail = F.when(F.size(inner) > 0, F.concat(F.lit(" ["), F.array_join(inner, ", "), F.lit("]"))).otherwise("")
        return F.concat(F.lit("  n"), e["src"].cast("string"), F.lit(" -> n"), e["dst"].cast("string"), tail, F.lit(";\n"))

    head = F.concat(F.lit("digraph "), _quoted(name), F.lit(" {\n  node [shape=box, fontname=monospace, fontsize=10];\n"))
    return F.concat(head, _lines(nodes, node), _lines(edges, edge), F.lit("}\n"))


def _keys(items: Column) -> Column:
    """Names of all attributes, the label's first."""
    return F.array_distinct(F.concat(F.array(F.lit("label")), F.flatten(F.transform(items, lambda x: F.transform(x["attrs"], lambda a: a["k"])))))


def graphml(name: Column, nodes: Column, edges: Column, of_nodes: Column, of_edges: Column) -> Column:
    """GraphML; `of_nodes` and `of_edges` are columns with the `_keys`, since an expression would be worked out anew for every attribute."""

    def declared(found: Column, prefix: str, kind: str) -> Column:
        return F.array_join(F.transform(found, lambda k, i: F.concat(F.lit(f'  <key id="{prefix}'), i.cast("string"), F.lit(f'" for="{kind}" attr.name="'), _xml(k), F.lit('" attr.type="string"/>\n'))), "")

    def data(found: Column, prefix: str, label: Column, attrs: Column) -> Column:
        every = F.concat(F.array(F.struct(F.lit("label").alias("k"), label.alias("v"))), attrs)
        return _lines(every, lambda a: F.concat(F.lit(f'      <data key="{prefix}'), (F.array_position(found, a["k"]) - 1).cast("string"), F.lit('">'), _xml(a["v"]), F.lit("</data>\n")))

    body = _lines(nodes, lambda n: F.concat(F.lit('    <node id="n'), n["id"].cast("string"), F.lit('">\n'), data(of_nodes, "nd", n["label"], n["attrs"]), F.lit("    </node>\n")))
    ties = F.array_join(
        F.transform(edges, lambda e, i: F.concat(F.lit('    <edge id="e'), i.cast("string"), F.lit('" source="n'), e["src"].cast("string"), F.lit('" target="n'), e["dst"].cast("string"), F.lit('">\n'), data(of_edges, "ed", e["label"], e["attrs"]), F.lit("    </edge>\n"))), "",
    )
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'), declared(of_nodes, "nd", "node"), declared(of_edges, "ed", "edge"))
    return F.concat(head, F.lit('  <graph id="'), _xml(name), F.lit('" edgedefault="directed">\n'), body, ties, F.lit("  </graph>\n</graphml>\n"))


def node_link(name: Column, nodes: Column, edges: Column) -> Column:
    """Node-link JSON; attributes stand beside id and label."""

    def flat(first: Column, attrs: Column) -> Column:
        fields = F.concat(first, F.transform(attrs, lambda a: F.concat(_quoted(a["k"]), F.lit(": "), _quoted(a["v"]))))
        return F.concat(F.lit("{"), F.array_join(F.array_sort(fields), ", "), F.lit("}"))

    def number(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}": '), value.cast("string"))

    ties = F.array_join(F.transform(edges, lambda e: flat(F.array(F.concat(F.lit('"label": '), _quoted(e["label"])), number("source", e["src"]), number("target", e["dst"])), e["attrs"])), ", ")
    body = F.array_join(F.transform(nodes, lambda n: flat(F.array(number("id", n["id"]), F.concat(F.lit('"label": '), _quoted(n["label"]))), n["attrs"])), ", ")
    return F.concat(F.lit('{"directed": true, "edges": ['), ties, F.lit('], "graph": {"name": '), _quoted(name), F.lit('}, "multigraph": true, "nodes": ['), body, F.lit("]}"))


def mermaid(name: Column, nodes: Column, edges: Column) -> Column:
    def safe(text: Column) -> Column:
        return F.replace(F.replace(text, F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" "))

    body = _lines(nodes, lambda n: F.concat(F.lit("  n"), n["id"].cast("string"), F.lit('["'), safe(n["label"]), F.lit('"]\n')))
    ties = _lines(edges, lambda e: F.concat(F.lit("  n"), e["src"].cast("string"), F.when(e["label"] == "", F.lit(" --> n")).otherwise(F.concat(F.lit(" -->|"), safe(e["label"]), F.lit("| n"))), e["dst"].cast("string"), F.lit("\n")))
    return F.concat(F.lit("flowchart TD\n"), body, ties)


def render(views: DataFrame, fmt: str) -> DataFrame:
    """`source_id, function_id, name, text` of views in one format."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")
    if fmt == "graphml":
        # as rows of their own: the keys are read for each attribute of each node
        views = views.withColumns({"_of_nodes": _keys(F.col("nodes")), "_of_edges": _keys(F.col("edges"))})
        return views.select("source_id", "function_id", "name", graphml(F.col("name"), F.col("nodes"), F.col("edges"), F.col("_of_nodes"), F.col("_of_edges")).alias("text"))
    write = {"dot": dot, "json": node_link, "mermaid": mermaid}[fmt]
    return views.select("source_id", "function_id", "name", write(F.col("name"), F.col("nodes"), F.col("edges")).alias("text"))
