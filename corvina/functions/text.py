"""Preparation of C texts by dialect, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dialects, line ends, the patterns of the decompiled dialect, and control characters that literals may keep.
DIALECTS = ("ordinary", "preprocessed", "decompiled")
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
MARKER = r'^#\s+\d+\s+"([^"]*)"'
AGGREGATE_RETURN = r"(?m)^([A-Za-z_][\w ]*?)\s*\[\d+\]\s+([A-Za-z_]\w*\s*\()"
AT_REGISTER = r"\s*@\s*[a-z]\w+\b"
KEPT_CONTROLS = {0x09, 0x0A}
CONTROLS = [c for c in [*range(0x20), 0x7F] if c not in KEPT_CONTROLS]


def split_lines(text: Column) -> Column:
    """Lines of a text at ten kinds of line ends; the empty rest after a final one doesn't count."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def system_header(path: Column) -> Column:
    return (path == "") | path.startswith("<") | path.startswith("/usr/") | path.contains("/usr/lib/gcc") | path.endswith("stdc-predef.h")


def own_lines(text: Column) -> Column:
    """Preprocessed text: the lines below markers that name a file of one's own; a text begins inside a system header."""
    marked = F.transform(split_lines(text), lambda line: F.struct(line.alias("line"), F.when(line.rlike(MARKER), F.regexp_extract(line, MARKER, 1)).alias("path")))
    start = F.struct(F.lit(True).alias("system"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        system = F.when(x["path"].isNotNull(), system_header(x["path"])).otherwise(state["system"])
        kept = F.when(x["path"].isNull() & ~state["system"], F.concat(state["kept"], F.array(x["line"]))).otherwise(state["kept"])
        return F.struct(system.alias("system"), kept.alias("kept"))

    return F.concat(F.array_join(F.aggregate(marked, start, step, lambda s: s["kept"]), "\n"), F.lit("\n"))


def strip_system_headers(sources: DataFrame) -> DataFrame:
    """`own_lines` for very long texts: a row per line, the last marker by a window over the source's lines."""
    lines = sources.select("source_id", F.posexplode(split_lines(F.col("text"))).alias("n", "line")).withColumn("marker", F.when(F.col("line").rlike(MARKER), F.regexp_extract("line", MARKER, 1)))
    below = Window.partitionBy("source_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = lines.withColumn("path", F.last("marker", ignorenulls=True).over(below)).filter(F.col("marker").isNull() & F.col("path").isNotNull() & ~system_header(F.col("path")))
    joined = kept.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("own"))
    return sources.drop("text").join(joined, "source_id", "left").select(*[c for c in sources.columns if c != "text"], F.concat(F.coalesce("own", F.lit("")), F.lit("\n")).alias("text"))


def escape_controls(text: Column) -> Column:
    r"""Control characters inside string and character literals as \xNN; tabs and line ends stay.

    Literals are cut out by one pattern that knows both quotes and escapes, and only
    the parts that are literals are rewritten.
    """
    literal = r'''"(?:\\[\s\S]|[^"\\])*"?|'(?:\\[\s\S]|[^'\\])*'?|[^"']+'''

    def escaped(part: Column) -> Column:
        out = part
        for c in CONTROLS:
            # a character after a backslash is the backslash's
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\x{c:02x}", rf"$1\\x{c:02x}")
        return F.when(part.rlike("^[\"']"), out).otherwise(part)

    dirty = text.rlike(r"[\x00-\x08\x0b-\x1f\x7f]")
    return F.when(dirty, F.array_join(F.transform(F.regexp_extract_all(text, F.lit(literal), F.lit(0)), escaped), "")).otherwise(text)


def decompiled(text: Column) -> Column:
    """Decompiler output: array return types lose their bounds, register notes go, 128-bit types get names; then literals' controls."""
    out = F.regexp_replace(text, AGGREGATE_RETURN, "$1 $2")
    out = F.regexp_replace(out, AT_REGISTER, "")
    out = F.replace(F.replace(out, F.lit("unsigned __int128"), F.lit("unsigned long long")), F.lit("__int128"), F.lit("long long"))
    return escape_controls(out)


def normalize(text: Column, dialect: str) -> Column:
    """A text by its dialect, which is stated and never guessed."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; one of {', '.join(DIALECTS)}")
    return {"ordinary": lambda t: t, "preprocessed": own_lines, "decompiled": decompiled}[dialect](text)


def normalize_sources(sources: DataFrame) -> DataFrame:
    """Sources with their texts prepared by the column `dialect`; unknown dialects fail the query."""
    text, kind = F.col("text"), F.col("dialect")
    bad = F.raise_error(F.concat(F.lit("unknown dialect "), F.coalesce(kind, F.lit("null"))))
    return sources.withColumn("text", F.when(kind == "ordinary", text).when(kind == "preprocessed", own_lines(text)).when(kind == "decompiled", decompiled(text)).otherwise(bad))
