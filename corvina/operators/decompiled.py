"""Decompiler output end to end: preprocessing, block graphs, and where each function came from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..plans import stage
from . import annotations, graphs


def analyze_decompiled(sources: DataFrame, compiler: str | None = None, timeout: float = 30.0) -> DataFrame:
    """`source_id, name, nodes, edges, entry, exit, degenerate, origin, recovery_qualified, status` of each scoreable function.

    Texts are normalised, then preprocessed where they have directives; a text whose
    preprocessing fails is read as it was, and its status says so.
    """
    plain = sources.withColumn("text", texts.normalize(F.coalesce("text", F.lit("")), "decompiled"))
    expanded = annotations.preprocess(plain, compiler, timeout)
    original = stage.functions(stage.parse(plain, graphs=False)).select("source_id", "name")
    units = stage.parse(expanded, graphs=False)
    from_where = annotations.provenance(stage.functions(units), original, stage.diagnostics(units))
    return graphs.parity_blocks(expanded).drop("function_id").join(from_where, ["source_id", "name"]).join(expanded.select("source_id", "status"), "source_id")
