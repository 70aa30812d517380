"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong parts (key assignments, access identifiers, long hex runs) are reported as
they are.  Weak candidates - identifiers, secrets and endpoints that alone mean
little - are reported only where complementary parts co-occur: an identifier or an
endpoint with a secret, a secret with an identifier or an endpoint, in one scope
(a paragraph between blank lines) and at most `DISTANCE` code points apart.

Positions: splitting at a pattern gives the gaps, extracting it the hits; a running
sum of both lengths gives code-point offsets.  Each hit is a row, every document
sends one more row that carries its id, and one shuffle by row serves the running
sums, the interval join (windows that look for the nearest complementary part on
either side) and the final gathering.  A row has its own key, so copies and hot
sources spread, and a task never holds more than the hits of single documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of the strong parts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak candidates: an identifier is of capitals and digits, a secret has a small letter too, so no run is both.
#: Either may follow the '=' of a key (KEY=value), or the '_' or '-' of a prefix.
WEAK_ID = r"(?<![A-Za-z0-9+/])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}(?![A-Za-z0-9+/_=-])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{3,}"
BREAK = r"\n[ \t\r]*\n"

#: (name, pattern, the part it plays), in the order in which equal starts are listed.
KINDS = [
    ("assign", ASSIGN, "secret"),
    ("access", ACCESS, "id"),
    ("hex", HEX, "secret"),
    ("weak_id", WEAK_ID, "id"),
    ("weak_secret", WEAK_SECRET, "secret"),
    ("endpoint", ENDPOINT, "endpoint"),
    ("break", BREAK, "break"),
]
STRONG = 3
DISTANCE = 200
DOCUMENT = -1


def _hits(text: Column, pattern: str, kind: int) -> Column:
    """Gap before, length and validity of each hit of one kind, in order."""

    def item(gap: Column, hit: Column) -> Column:
        valid = F.lit(True)
        if pattern is ASSIGN:
            valid = F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
        elif pattern is ACCESS:
            valid = F.length(hit) >= 20
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(hit).alias("hit"), valid.alias("valid"))

    zipped = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), item)
    return F.when(text.rlike(pattern), F.filter(zipped, lambda x: x["hit"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,gap:int,hit:int,valid:boolean>>"))


def spans(docs: DataFrame, carry: Column) -> DataFrame:
    """One row per span of every row's `text`, and one of kind -1 per row, which alone has what is to be carried.

    Columns: row (unique), carry, kind (index into KINDS), start, end (code points,
    end exclusive), reported.  Kind -1 has null positions.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), carry.alias("carry"), text.alias("text"))
    lists = F.array(*[_hits(F.col("text"), pattern, kind) for kind, (_, pattern, _) in enumerate(KINDS)])
    marker = F.array(F.struct(F.lit(DOCUMENT).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("hit"), F.lit(True).alias("valid")))
    found = (
        base.select("row", "carry", F.posexplode(F.concat(marker, F.flatten(lists))).alias("place", "x"))
        .select("row", F.when(F.col("x.kind") == DOCUMENT, F.col("carry")).alias("carry"), "place", "x.*")
        .repartition("row")
    )
    run = Window.partitionBy("row", "kind").orderBy("place")
    placed = found.withColumn("end", F.when(F.col("kind") >= 0, F.sum(F.col("gap") + F.col("hit")).over(run))).withColumn("start", F.col("end") - F.col("hit")).filter("valid")

    by_start = Window.partitionBy("row").orderBy("start", "kind", "end")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    strong = F.col("kind").between(0, STRONG - 1)
    scoped = (
        placed.withColumn("scope", F.sum(F.when(F.col("kind") == len(KINDS) - 1, 1).otherwise(0)).over(by_start))
        .withColumn("inside", F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False)))
        .filter(~(F.col("kind").isin(3, 4) & F.col("inside")))
    )
    in_scope = Window.partitionBy("row", "scope").orderBy("start", "kind", "end")
    before, after = in_scope.rowsBetween(Window.unboundedPreceding, -1), in_scope.rowsBetween(1, Window.unboundedFollowing)
    part = F.array(*[F.lit(p) for _, _, p in KINDS])[F.greatest(F.col("kind"), F.lit(0))]

    def near(*parts: str) -> Column:
        plays = (F.col("kind") >= 0) & F.col("part").isin(*parts)
        left = F.col("start") - F.max(F.when(plays, F.col("end"))).over(before)
        right = F.min(F.when(plays, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(left <= DISTANCE, F.lit(False)) | F.coalesce(right <= DISTANCE, F.lit(False))

    linked = scoped.withColumn("part", part)
    linked = linked.withColumn("near_secret", near("secret")).withColumn("near_other", near("id", "endpoint"))
    weak = F.when(F.col("part") == "secret", F.col("near_other")).otherwise(F.col("near_secret"))
    return linked.filter(F.col("kind") < len(KINDS) - 1).select("row", "carry", "kind", "start", "end", (strong | ((F.col("kind") >= STRONG) & weak)).alias("reported"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `doc_id, text`.

    A null text is empty, an empty text has no spans; null and repeated doc_ids give
    a row each, as every input row does; other columns are ignored; an empty table
    gives no rows.  `base_sha256` covers the strong spans, `spans` lists all.
    """
    names = F.array(*[F.lit(name) for name, _, _ in KINDS])
    rows = spans(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"))).filter("reported or kind < 0")
    item = F.when(F.col("kind") >= 0, F.struct("start", "kind", "end"))
    grouped = rows.groupBy("row").agg(
        F.max("carry.doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(STRONG)],
        F.sort_array(F.collect_list(item)).alias("items"),
    )

    def joined(items: Column) -> Column:
        return F.concat_ws(",", F.transform(items, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])))

    base = joined(F.filter("items", lambda x: x["kind"] < STRONG))
    return grouped.select("doc_id", *[f"n_{KINDS[k][0]}" for k in range(STRONG)], F.sha2(base, 256).alias("base_sha256"), joined(F.col("items")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with all their columns; reported spans of `text` are replaced by "[REDACTED]".

    Rows in which no pattern occurs pass without a shuffle.  Overlapping spans are
    replaced as one.  A null text stays null; an empty table gives no rows.
    """
    some = F.lit(False)
    for _, pattern, _ in KINDS[:-1]:
        some = some | F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    rows = spans(docs.filter(some), F.struct(*[F.col(f"`{c}`") for c in docs.columns])).filter("reported or kind < 0")
    item = F.when(F.col("kind") >= 0, F.struct("start", "end"))
    grouped = rows.groupBy("row").agg(F.first("carry", ignorenulls=True).alias("carry"), F.sort_array(F.collect_list(item)).alias("items"))
    text = F.col("carry")["text"]

    def step(done: Column, x: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0)).cast("int"))
        made = F.when(x["start"] >= done["at"], F.concat(done["made"], gap, F.lit("[REDACTED]"))).otherwise(done["made"])
        return F.struct(F.greatest(done["at"], x["end"].cast("int")).alias("at"), made.alias("made"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))
    cleaned = F.aggregate("items", begin, step, lambda d: F.concat(d["made"], F.substring(text, d["at"] + 1, F.length(text))))
    changed = grouped.select(*[cleaned.alias(c) if c == "text" else F.col("carry")[c].alias(c) for c in docs.columns])
    return docs.filter(~some).unionByName(changed)
