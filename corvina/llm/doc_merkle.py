"""Document fingerprints: a Merkle tree over sections, paragraphs and sentence pieces, in DataFrame functions only.

Sections end at blank lines, paragraphs at line ends, leaves are sentences or at
most `PIECE` code points of one.  A node is the SHA-256 of its children's digests,
so equal roots mean equal texts, and differing branches locate an edit.  The
fingerprint is the root followed by the tree of shortened digests: sections are
parted by ";" and paragraphs by ",", a section's own digest ends in "=", a
paragraph's in "/", leaves follow.  `edits` compares two fingerprints from the root
down, only below branches that differ.  The likeness of two fingerprints is the share
of leaves they have in common (twice the common ones over all of both).

The next document in the order of ids comes by one shuffle: ids are cut into many
ranges at approximate percentiles, each range is a window of its own, and the first
document of a range is also sent to the range before it, where it follows the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 40
#: Digits of a leaf's digest, and of a section's or paragraph's, in a fingerprint.
LEAF_HEX, INNER_HEX = 8, 8
LEAF = rf"[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"
#: Documents a range holds about, and the most ranges there are; both only balance work.
RANGE_ROWS = 256
MOST_RANGES = 1 << 14


def tree(text: Column) -> Column:
    """Digests of the leaves: array (sections) of arrays (paragraphs) of arrays of SHA-256 in hex."""

    def paragraph(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda leaf: F.sha2(leaf, 256))

    return F.transform(F.split(text, "\n\n", -1), lambda section: F.transform(F.split(section, "\n", -1), paragraph))


def fingerprint(nodes: Column) -> Column:
    """Root and shortened digests of a tree of digests."""

    def digest(children: Column) -> Column:
        return F.sha2(F.concat_ws("", children), 256)

    def paragraph(p: Column) -> Column:
        own = digest(p)
        return F.struct(own.alias("d"), F.concat(F.substring(own, 1, INNER_HEX), F.lit("/"), F.concat_ws("", F.transform(p, lambda x: F.substring(x, 1, LEAF_HEX)))).alias("s"))

    def section(made: Column) -> Column:
        own = digest(F.transform(made, lambda p: p["d"]))
        return F.struct(own.alias("d"), F.concat(F.substring(own, 1, INNER_HEX), F.lit("="), F.concat_ws(",", F.transform(made, lambda p: p["s"]))).alias("s"))

    made = F.transform(F.transform(nodes, lambda s: F.transform(s, paragraph)), section)
    return F.aggregate(F.array(made), F.lit(""), lambda _, m: F.concat(digest(F.transform(m, lambda s: s["d"])), F.lit(":"), F.concat_ws(";", F.transform(m, lambda s: s["s"]))))


def edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: array of struct(section, paragraph, leaf), from 0, in order; empty for equal roots.

    Branches are compared by place, and only those below differing ones; a leaf that
    only one side has differs, and so does a paragraph without leaves that only one
    side has (leaf null).
    """

    def places(x: Column, y: Column) -> Column:
        both = F.greatest(F.size(x), F.size(y))
        every = F.when(both > 0, F.sequence(F.lit(0), both - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))

    def parts(x: Column, mark: str, separator: str) -> Column:
        inner = F.substring(x, INNER_HEX + 2, 1 << 30) if mark else F.substring(x, 66, 1 << 30)
        return F.coalesce(F.split(inner, separator, -1), F.array().cast("array<string>"))

    def leaves(x: Column) -> Column:
        return F.coalesce(F.regexp_extract_all(F.substring(x, INNER_HEX + 2, 1 << 30), F.lit(f"[0-9a-f]{{{LEAF_HEX}}}"), F.lit(0)), F.array().cast("array<string>"))

    sa, sb = parts(a, "", ";"), parts(b, "", ";")

    def of_section(i: Column) -> Column:
        pa, pb = parts(F.get(sa, i), "=", ","), parts(F.get(sb, i), "=", ",")

        def of_paragraph(j: Column) -> Column:
            found = places(leaves(F.get(pa, j)), leaves(F.get(pb, j)))
            found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("int")))
            return F.transform(found, lambda k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf")))

        return F.flatten(F.transform(places(pa, pb), of_paragraph))

    return F.flatten(F.transform(places(sa, sb), of_section))


def compare(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key, section, paragraph, leaf` of every difference of the `text`s that two tables have under one key.

    Keys on one side alone, null keys and equal texts give no rows; repeated keys are
    compared each with each; null texts are empty; other columns are ignored.
    """
    sides = [x.select(F.col(key).alias("key"), fingerprint(tree(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias(n)) for x, n in ((left, "a"), (right, "b"))]
    both = sides[0].join(sides[1], "key").filter(F.substring("a", 1, 64) != F.substring("b", 1, 64))
    return both.select(F.col("key").alias(key), F.explode(edits(F.col("a"), F.col("b"))).alias("x")).select(key, "x.*")


def leaf_set(printed: Column) -> Column:
    """Shortened leaves of a fingerprint, the n-th repetition of one marked n."""
    bare = F.regexp_replace(F.substring(printed, 66, 1 << 30), f"[0-9a-f]{{{INNER_HEX}}}[=/]", "")
    leaves = F.regexp_extract_all(bare, F.lit(f"[0-9a-f]{{{LEAF_HEX}}}"), F.lit(0))
    runs = F.regexp_extract_all(F.concat_ws(",", F.sort_array(leaves), F.array(F.lit(""))), F.lit(rf"([0-9a-f]{{{LEAF_HEX}}},)\1*"), F.lit(0))
    marked = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), (F.length(r) / (LEAF_HEX + 1)).cast("int")), lambda n: F.concat_ws("x", F.substring(r, 1, LEAF_HEX), n)))
    return F.flatten(marked)


def likeness(a: Column, b: Column, printed_a: Column, printed_b: Column) -> Column:
    """0 to 1, from two leaf sets; 1 if the fingerprints are equal, 0 if neither has a leaf."""
    both = F.size(a) + F.size(b)
    return F.when(printed_a == printed_b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _range(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are below an id, by halving."""
    values = F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        low = (s["lo"] < s["hi"]) & (F.get(values, mid) < doc_id)
        return F.struct(F.when(low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(low | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, step, lambda s: s["lo"])


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with `next_<column>` of the row after it, ids descending, the first after the last.

    Null ids come last, equal ids in the order of their texts' hashes.
    """
    count, low, top = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(1, min(MOST_RANGES, count // RANGE_ROWS))
    bounds: list[int] = []
    if top is not None:
        bounds = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [1.0], max(10_000, 10 * wanted))).first()[0]
        bounds = sorted({*bounds, top})
    last = len(bounds)  # the range of null ids, read after all others
    # Range i holds the ids above bound i-1 up to bound i, so bound i is its first document.
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_range(F.col("doc_id"), bounds) if bounds else F.lit(-1))
    nulls = docs.filter("doc_id is null").limit(1).count() > 0
    lowest = -1 if nulls else 0
    first_of = F.col("doc_id").isin(bounds) if last <= 64 else F.col("doc_id") == F.get(F.array(*[F.lit(b) for b in bounds]), F.col("range"))
    above = F.when(F.col("doc_id") == F.lit(top), F.array(F.lit(lowest))).otherwise(F.array(F.col("range") + 1))
    rows = docs.withColumn("range", place)
    if bounds:
        also = F.when(first_of, above).otherwise(F.array().cast("array<int>"))
        if nulls:  # the first null id follows the lowest id: all of them are sent, the window picks
            also = F.when(F.col("doc_id").isNull(), F.array(F.lit(0))).otherwise(also)
    else:
        also = F.array(F.lit(-1))
    own = F.array(F.struct(F.lit(False).alias("guest"), F.col("range").alias("at")))
    rows = rows.withColumn("to", F.explode(F.concat(own, F.transform(also, lambda r: F.struct(F.lit(True).alias("guest"), r.alias("at"))))))
    # In the lowest range the guest is the top document, which comes after all others there.
    order = Window.partitionBy("to.at").orderBy(F.col("to.guest"), F.col("doc_id").desc_nulls_last(), "tie")
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("not to.guest").drop("range", "to")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of every row's text, of its edited text, and their likeness to it and to the next document's.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text is empty; an empty text's tree has one
    section, one paragraph and no leaf.  Null ids come after all others, repeated
    ids in the order of their texts' hashes; a table of one row follows itself; an
    empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", "text", F.xxhash64("text").alias("tie"), fingerprint(tree(F.col("text"))).alias("fingerprint"))
    paired = with_next(base, ["text", "fingerprint"])
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    paired = paired.select("doc_id", n.alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.left("text", (n - half).cast("int")), F.left("next_text", half)).alias("edited"))
    paired = paired.select("*", fingerprint(tree(F.col("edited"))).alias("edited_fingerprint"))
    paired = paired.select("*", leaf_set(F.col("fingerprint")).alias("a"), leaf_set(F.col("edited_fingerprint")).alias("b"), leaf_set(F.col("next_fingerprint")).alias("c"))
    return paired.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("b"), F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("a"), F.col("c"), F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
