"""Scalar and window expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the data model.
FORWARD = ("DRIVES", "REQUIRES", "SUBSIDIARY_OF")
BACKWARD = ("PRODUCES", "SUPPLIES")
RELATIONS = ("DRIVES", "REQUIRES", "PRODUCES", "SUPPLIES", "SUBSIDIARY_OF", "EXPOSED_TO", "SUBSTITUTES", "COMPETES_WITH", "CONSTRAINS")
NODE_TYPES = ("company", "product", "material", "theme", "region")
SHOCKABLE = ("theme", "product", "material")
MIN_CONFIDENCE = 0.5


def digest(value: Column | str, length: int) -> Column:
    """First hex digits of SHA-256."""
    return F.substring(F.sha2(F.col(value) if isinstance(value, str) else value, 256), 1, length)


def edge_id(src: str = "src", rel: str = "rel", dst: str = "dst") -> Column:
    return F.concat(F.lit("e-"), digest(F.concat_ws("|", src, rel, dst), 10))


def note_hash(note: str = "note") -> Column:
    return digest(note, 12)


def normalised(text: Column) -> Column:
    """Lower case, hyphens as spaces, runs of space as one."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), r"\s+", " "))


def node_type(node: Column) -> Column:
    return F.substring_index(node, "/", 1)


def midrank(value: str, *keys: str) -> Column:
    """(values below + half of the other equal ones) / (n - 1) within keys; 0 for a single value, null stays null."""
    order = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    whole = W.partitionBy(*keys)
    n = F.count(value).over(whole)
    same = F.count(value).over(W.partitionBy(*keys, value))
    return F.when(F.col(value).isNull(), None).when(n == 1, 0.0).otherwise((F.rank().over(order) - 1 + (same - 1) / 2) / (n - 1))


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1 with ties at their mean."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2


def day_number(day: str = "day") -> Column:
    return F.unix_date(day)


def isclose(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def poisson_surprise(matched: Column, expected: Column, most: float = 300.0) -> Column:
    """-log10 P(X >= matched) for a Poisson of mean expected, at most `most`, 0 for no match. Expressions only.

    Above the mean the tail is a series that starts at the term of `matched`, in logarithms; below it one minus the
    head, summed down from its largest term, which is in logarithms too. Terms are summed until they no longer count
    (8 standard deviations and 50 more).
    """
    x, m = expected.cast("double"), matched.cast("int")
    log_fact = F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    terms = (8 * F.sqrt(x) + 50).cast("int")
    series = F.aggregate(F.sequence(F.lit(1), terms), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * x / (m + i)).alias("t"), (a["s"] + a["t"] * x / (m + i)).alias("s")))["s"]
    above = -(-x + m * F.log(x) - log_fact + F.log(series)) / F.log(F.lit(10.0))
    falling = F.aggregate(F.sequence(F.lit(1), terms), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * F.greatest(m - i, F.lit(0)) / x).alias("t"), (a["s"] + a["t"] * F.greatest(m - i, F.lit(0)) / x).alias("s")))["s"]
    head = F.exp(-x + (m - 1) * F.log(x) - log_fact + F.log(m.cast("double"))) * falling
    below = -F.log10(F.greatest(1 - head, F.lit(1e-300)))
    return F.when(m <= 0, 0.0).otherwise(F.least(F.lit(most), F.when(m > x, above).otherwise(below)))
