"""Interactive use: one snapshot of sources, parsed once, its products made on demand; and table functions for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .operators import annotations, exports, flow, graphs, lowered, metrics
from .plans import c_measure, stage


class AnalysisSession:
    """Products of one set of sources.  The parse stage runs once: its rows are kept (memory, then disk) until `close`."""

    def __init__(self, sources: DataFrame):
        self.sources = sources
        self.units = stage.parse(sources).persist()

    @classmethod
    def of_text(cls, spark: SparkSession, text: str, name: str = "text") -> AnalysisSession:
        return cls(spark.createDataFrame([(name, text)], "source_id string, text string"))

    def close(self) -> None:
        self.units.unpersist()

    @cached_property
    def functions(self) -> DataFrame:
        return stage.functions(self.units)

    @cached_property
    def measures(self) -> DataFrame:
        return metrics.measures(self.functions)

    @cached_property
    def files(self) -> DataFrame:
        return self.units.select("source_id", *stage.FILE, F.size("functions").alias("functions"))

    @cached_property
    def cfg_nodes(self) -> DataFrame:
        return stage.cfg_nodes(self.units)

    @cached_property
    def cfg_edges(self) -> DataFrame:
        return stage.cfg_edges(self.units)

    @cached_property
    def diagnostics(self) -> DataFrame:
        return annotations.diagnostics(self.sources)

    @cached_property
    def data_flow(self) -> DataFrame:
        return flow.data_flow(self.sources)

    @cached_property
    def control_dependence(self) -> DataFrame:
        return graphs.control_dependence(self.functions)

    @cached_property
    def loops(self) -> DataFrame:
        return annotations.loop_bounds(self.sources)

    @cached_property
    def ast(self) -> DataFrame:
        return annotations.ast_nodes(self.sources)

    @cached_property
    def operations(self) -> DataFrame:
        """Typed operations of each function in evaluation order, and the order pairs between them."""
        return lowered.lowered(self.sources)

    def call_summaries(self, policy: str = "unknown") -> DataFrame:
        return flow.call_summaries(self.sources, policy)

    def hotspots(self, by: str = "cyclomatic", limit: int | None = None) -> DataFrame:
        return metrics.hotspots(self.measures, by, limit)

    def export(self, representation: str = "cfg", fmt: str = "dot") -> DataFrame:
        """Graphs as text; representation ast, cfg, cdg, ddg, ops or pdg."""
        views = {
            "ast": lambda: exports.ast_views(self.ast, self.functions),
            "cfg": lambda: exports.cfg_views(self.functions),
            "cdg": lambda: exports.cdg_views(self.functions, self.control_dependence, graphs.control_depth(self.functions), graphs.post_dominators(self.functions)),
            "ddg": lambda: exports.flow_views(self.data_flow),
            "ops": lambda: lowered.views(self.operations, annotations.facts(self.sources)),
            "pdg": lambda: exports.pdg_views(self.functions, flow.pdg_edges(self.data_flow, self.control_dependence)),
        }
        if representation not in views:
            raise ValueError(f"unknown representation {representation!r}; one of {', '.join(views)}")
        return exports.render(views[representation](), fmt)


class _Tokens:
    def eval(self, text: str):
        for t in c_measure.unit(text or "", graphs=False, tokens=True)["tokens"]:
            yield t["idx"], t["kind"], t["lo"], t["hi"], t["line"], t["lexeme"]


class _Functions:
    def eval(self, text: str):
        for f in c_measure.unit(text or "")["functions"]:
            yield f["function_id"], f["name"], f["lo"], f["hi"], f["cognitive"], f["statements"], f["callees"]


class _Nodes:
    def eval(self, text: str):
        for f in c_measure.unit(text or "")["functions"]:
            for n in f["cfg_nodes"]:
                yield f["function_id"], f["name"], n["id"], n["kind"], n["lo"], n["hi"]


class _Edges:
    def eval(self, text: str):
        for f in c_measure.unit(text or "")["functions"]:
            for e in f["cfg_edges"]:
                yield f["function_id"], f["name"], e["ord"], e["src"], e["dst"], e["kind"], e["back"]


TABLE_FUNCTIONS = {
    "c_tokens": (_Tokens, "idx int, kind string, lo int, hi int, line int, lexeme string"),
    "c_functions": (_Functions, "function_id int, name string, lo int, hi int, cognitive int, statements int, callees array<string>"),
    "c_cfg_nodes": (_Nodes, "function_id int, name string, id int, kind string, lo int, hi int"),
    "c_cfg_edges": (_Edges, "function_id int, name string, ord int, src int, dst int, kind string, back boolean"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL, for `FROM t, LATERAL c_functions(t.text)`."""
    stage.ready(spark)
    for name, (handler, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
