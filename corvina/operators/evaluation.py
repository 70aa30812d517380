"""Summaries of evaluation runs: distributions, strata, coverage and agreement, in SQL aggregates."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import mapped, portions


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`n, median, p95, maximum` by keys: the lower median and the nearest-rank 95th percentile, both values that occur.

    Ranks come from a window, so a large group is sorted on disk and not gathered.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    ranked = rows.filter(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(order).alias("rank"), F.count("*").over(whole).alias("n"))
    at = lambda place: F.max(F.when(F.col("rank") == place, F.col(value)))
    median, p95 = F.floor((F.col("n") - 1) / 2) + 1, F.floor((95 * F.col("n") + 99) / 100)
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), at(median).alias("median"), at(p95).alias("p95"), F.max(value).alias("maximum"))


def strata(rows: DataFrame, operator: str, severity: str, recovered: Column) -> DataFrame:
    """`operator, severity ("all" for all), specimens, recovered` by both and by operator alone."""
    rolled = rows.rollup(operator, severity).agg(F.count("*").alias("specimens"), F.sum(recovered.cast("long")).alias("recovered"), F.grouping_id().alias("g"))
    return rolled.filter("g < 3").select(F.col(operator).alias("operator"), F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col(severity)).alias("severity"), "specimens", "recovered")


def accuracy(pairs: DataFrame) -> DataFrame:
    """Precision and recall of `found` against `expected` (arrays of names): 1 where there is nothing to find and nothing found."""
    hit = F.size(F.array_intersect("found", "expected"))
    ratio = lambda n: F.when(n > 0, hit / n).when(F.size("expected") + F.size("found") == 0, 1.0).otherwise(0.0)
    return pairs.select("*", ratio(F.size(F.array_distinct("found"))).alias("precision"), ratio(F.size(F.array_distinct("expected"))).alias("recall"))


def overlapping(slices: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Slices of one source that overlap one before them, found by the running maximum of ends and not by pairs."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("_reach", F.max(end).over(before)).filter(F.col("_reach") > F.col(start)).drop("_reach")


def manifest_problems(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """`id, problem` of rows `id, source_path, source_sha256, start_byte, end_byte` against sources `source_path, content`.

    Problems: duplicate_id, missing_source, malformed_hash, hash_drift, bad_slice (empty
    or beyond the source), overlap (with a slice of the source that begins no later).
    """
    known = sources.select("source_path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.octet_length("content").alias("size"))
    joined = manifest.join(known, "source_path", "left")
    before = Window.partitionBy("source_path").orderBy("start_byte", "end_byte", "id").rowsBetween(Window.unboundedPreceding, -1)
    sound = F.col("start_byte") < F.col("end_byte")
    joined = joined.withColumn("reach", F.max(F.when(sound, F.col("end_byte"))).over(before)).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    tests = {
        "duplicate_id": F.col("n") > 1,
        "missing_source": F.col("digest").isNull(),
        "malformed_hash": ~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "hash_drift": F.col("source_sha256").rlike("^[0-9a-f]{64}$") & (F.col("source_sha256") != F.col("digest")),
        "bad_slice": ~F.coalesce(sound & (F.col("start_byte") >= 0), F.lit(False)) | (F.col("end_byte") > F.col("size")),
        "overlap": sound & (F.col("reach") > F.col("start_byte")),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return joined.select("id", F.explode(found).alias("problem")).distinct()


def timed(sources: DataFrame, analyse, repeats: int = 5) -> DataFrame:
    """`source_id, bytes, median_seconds, least_seconds` of `analyse(text)` over each source's text, measured in the executors."""
    arrow = pa.schema([("source_id", pa.string()), ("bytes", pa.int64()), ("median_seconds", pa.float64()), ("least_seconds", pa.float64())])

    def run(batches):
        for batch in portions(batches):
            rows = []
            for i, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                taken = []
                for _ in range(repeats):
                    began = time.perf_counter()
                    analyse(text or "")
                    taken.append(time.perf_counter() - began)
                taken.sort()
                rows.append({"source_id": i, "bytes": len((text or "").encode()), "median_seconds": taken[(repeats - 1) // 2], "least_seconds": taken[0]})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    if repeats < 1:
        raise ValueError("repeats must be 1 or more")
    return mapped(sources.select(F.col("source_id").cast("string").alias("source_id"), "text"), run, "source_id string, bytes long, median_seconds double, least_seconds double")


def result_problems(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """`id, problem`: specimens without a result, with several, and results of none."""
    counts = results.groupBy("id").agg(F.count("*").alias("n"))
    both = manifest.select("id", F.lit(True).alias("wanted")).join(counts, "id", "full_outer")
    problem = F.when(F.col("wanted").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return both.select("id", problem.alias("problem")).filter("problem is not null")


def claim_counts(rows: DataFrame, keys: list[str], claim: str) -> DataFrame:
    """`n_true, n_false, n_unavailable` of a nullable claim."""
    c = F.col(claim)
    return rows.groupBy(*keys).agg(F.count_if(c).alias("n_true"), F.count_if(~c).alias("n_false"), F.count_if(c.isNull()).alias("n_unavailable"))


def run_summary(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each run and family, and one for all families of a run (family "all").

    `manifest` has `id, family, expected, start_byte, end_byte`, `results` has `run_id, id,
    status, found, syntax_complete, cfg_complete, covered_bytes`.  Totals are those of the
    whole manifest, whether a specimen has a result or not; expected names count as often
    as they are expected and are found if they are found at all.  Results of no specimen
    are left to `result_problems`.
    """
    known = manifest.select("id", "family", F.coalesce("expected", F.array().cast("array<string>")).alias("expected"), (F.col("end_byte") - F.col("start_byte")).alias("bytes"))
    whole = known.rollup("family").agg(F.count("*").alias("specimens"), F.sum(F.size("expected")).alias("expected"), F.sum("bytes").alias("input_bytes"), F.grouping("family").alias("all"))
    rows = results.join(known, "id").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    rows = rows.withColumn("hits", F.size(F.filter("expected", lambda x: F.array_contains("found", x))))
    rows = rows.select("*", F.explode(F.array(F.col("family"), F.lit(None))).alias("of")).withColumn("all", F.col("of").isNull().cast("tinyint"))
    claims = [f(c, n) for c in ("syntax_complete", "cfg_complete") for n, f in {"true": lambda c, n: F.count_if(F.col(c)).alias(f"{c}_true"), "false": lambda c, n: F.count_if(~F.col(c)).alias(f"{c}_false"), "unavailable": lambda c, n: F.count_if(F.col(c).isNull()).alias(f"{c}_unavailable")}.items()]
    per = rows.groupBy("run_id", F.when(F.col("all") == 0, F.col("family")).alias("family"), "all")
    sums = per.agg(F.count("*").alias("results"), F.sum("hits").alias("expected_found"), F.count_if(F.size("found") == 0).alias("without_functions"), F.sum(F.size("found")).alias("found"), F.count("covered_bytes").alias("reporting_coverage"), F.sum("covered_bytes").alias("covered_bytes"), *claims)
    census = rows.groupBy("run_id", F.when(F.col("all") == 0, F.col("family")).alias("family"), "all", "status").agg(F.count("*").alias("n"))
    census = census.groupBy("run_id", "family", "all").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "status", "n"))), ",").alias("statuses"))
    same = lambda a, b: a["family"].eqNullSafe(b["family"]) & (a["all"] == b["all"])
    joined = sums.join(census, same(sums, census) & (sums.run_id == census.run_id)).select(sums["*"], "statuses")
    out = joined.join(whole, same(joined, whole))
    return out.select(joined.run_id, F.when(joined["all"] == 1, "all").otherwise(joined.family).alias("family"), "specimens", "results", "statuses", "expected", "expected_found", "without_functions", "found", "input_bytes", "reporting_coverage", "covered_bytes", *(f"{c}_{n}" for c in ("syntax_complete", "cfg_complete") for n in ("true", "false", "unavailable")))


def closure_audit(graphs: DataFrame, proofs: DataFrame) -> DataFrame:
    """`id, problem`: differing graphs without a proof (omitted) and proofs of graphs that don't differ (stale)."""
    differing = graphs.filter("distance > 0").select("id")
    omitted = differing.join(proofs.select("id"), "id", "left_anti").withColumn("problem", F.lit("omitted"))
    stale = proofs.select("id").join(differing, "id", "left_anti").withColumn("problem", F.lit("stale"))
    return omitted.unionByName(stale)


def read_rows(spark, path: str, schema: str) -> DataFrame:
    """JSON lines of a stated schema; a line that is no object of it fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest_identity(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """`sha256` of all rows as JSON lines with sorted keys, in the order of a column.

    Lines are hashed where they are; what meets in one row is a digest a line, for
    manifests of some thousands of specimens.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    hashed = rows.select(F.struct(F.col(order).alias("at"), F.sha2(line, 256).alias("sha")).alias("x"))
    return hashed.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["sha"]), "\n"), 256).alias("sha256"))


# Kinds of damage that `mutated` does.
MUTATIONS = ("delete", "insert", "duplicate", "swap", "truncate")
SCRAPS = ["{", "}", "(", ")", ";", '"', "'", "/*", "*/", "#", "\\", ",", "=", "goto", "case"]


def mutate(text: str, seed: int, severity: int = 1) -> tuple[str, str]:
    """(damaged text, kind of damage), the same for the same seed."""
    import random

    rng = random.Random(seed)
    kind = rng.choice(MUTATIONS)
    for _ in range(severity):
        if not text:
            return rng.choice(SCRAPS), "insert"
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.randrange(1, 20))
        if kind == "delete":
            text = text[:a] + text[b:]
        elif kind == "insert":
            text = text[:a] + rng.choice(SCRAPS) + text[a:]
        elif kind == "duplicate":
            text = text[:b] + text[a:b] + text[b:]
        elif kind == "swap":
            c = min(len(text), b + (b - a))
            text = text[:a] + text[b:c] + text[a:b] + text[c:]
        else:
            text = text[:a]
    return text, kind


def mutated(sources: DataFrame, severities: list[int], per_source: int = 1) -> DataFrame:
    """`source_id, specimen, severity, kind, text`: damaged copies of each source, seeded by its id."""
    import zlib

    from .flow import _rows

    def make(whole, row):
        for severity in severities:
            for k in range(per_source):
                seed = zlib.crc32(f"{row['source_id']}:{severity}:{k}".encode())
                text, kind = mutate(whole, seed, severity)
                yield {"specimen": k, "severity": severity, "kind": kind, "text": text}

    return _rows(sources, "source_id string, specimen int, severity int, kind string, text string", make, read=str)
