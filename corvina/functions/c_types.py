"""C's integer types and conversions (64-bit long): promotions and the usual arithmetic conversions, in Python and as a table."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rank, width in bits and signedness of the integer types; floating types by width.
INTEGERS = {
    "_Bool": (0, 1, False), "char": (1, 8, True), "signed char": (1, 8, True), "unsigned char": (1, 8, False), "short": (2, 16, True), "unsigned short": (2, 16, False), "int": (3, 32, True),
    "unsigned int": (3, 32, False), "long": (4, 64, True), "unsigned long": (4, 64, False), "long long": (5, 64, True), "unsigned long long": (5, 64, False), "__int128": (6, 128, True), "unsigned __int128": (6, 128, False),
}
FLOATS = {"float": 32, "double": 64, "long double": 80}


def promoted(kind: str) -> str:
    """Integer promotion: what ranks below int is int."""
    return "int" if kind in INTEGERS and INTEGERS[kind][0] < INTEGERS["int"][0] else kind


def usual(left: str, right: str) -> str | None:
    """Common type of two arithmetic operands; None where a type isn't arithmetic."""
    if left in FLOATS or right in FLOATS:
        if not all(x in FLOATS or x in INTEGERS for x in (left, right)):
            return None
        return max((x for x in (left, right) if x in FLOATS), key=FLOATS.get)
    if left not in INTEGERS or right not in INTEGERS:
        return None
    a, b = promoted(left), promoted(right)
    (rank_a, width_a, signed_a), (rank_b, width_b, signed_b) = INTEGERS[a], INTEGERS[b]
    if a == b or signed_a == signed_b:
        return a if rank_a >= rank_b else b
    if signed_a:  # let a be the unsigned one
        a, b, rank_a, rank_b, width_a, width_b = b, a, rank_b, rank_a, width_b, width_a
    if rank_a >= rank_b:
        return a
    return b if width_b > width_a else f"unsigned {b}"


def conversion_table(spark: SparkSession) -> DataFrame:
    """`a, b, common` for all arithmetic types: a fixed table, small enough to go to every task."""
    kinds = [*INTEGERS, *FLOATS]
    return spark.createDataFrame([(a, b, usual(a, b)) for a, b in product(kinds, kinds)], "a string, b string, common string")


def literal_type(text: Column) -> Column:
    """Type of an integer literal by its suffix and size (decimal literals stay signed)."""
    suffix = F.lower(F.regexp_extract(text, "([uUlL]*)$", 1))
    digits = F.regexp_replace(text, "[uUlL]*$", "")
    hexadecimal = F.lower(digits).startswith("0x")
    value = F.when(hexadecimal, F.conv(F.substring(digits, 3, 64), 16, 10)).when(digits.startswith("0"), F.conv(digits, 8, 10)).otherwise(digits).cast("decimal(38,0)")
    unsigned, long = suffix.contains("u"), suffix.contains("l")
    fits = lambda bits: value < F.lit(str(2**bits)).cast("decimal(38,0)")
    name = F.when(~long & fits(31) & ~unsigned, "int").when(~long & fits(32) & (unsigned | hexadecimal), "unsigned int").when(fits(63) & ~unsigned, "long")
    return name.when(fits(64), "unsigned long").otherwise("__int128")
