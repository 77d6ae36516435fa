"""Assigning rows and groups to labelled segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.arrays import as_column
from metricloom.functions.dates import within_days
from metricloom.functions.numbers import ratio
from metricloom.operators.attach import null_safe_join, with_share, with_shares


def bands(col, edges, labels, include_top: bool = True) -> Column:
    """Left-closed intervals between edges; ``include_top`` also closes the last on the right."""
    c = as_column(col)
    out = None
    for i, label in enumerate(labels):
        last = include_top and i == len(labels) - 1
        test = (c >= edges[i]) & ((c <= edges[i + 1]) if last else (c < edges[i + 1]))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def up_to(col, limits: dict, beyond: str, missing: str) -> Column:
    """First label whose inclusive upper limit covers the value; larger and NULL have their own."""
    c = as_column(col)
    out = F.when(c.isNull(), missing)
    for label, top in limits.items():
        out = out.when(c <= top, label)
    return out.otherwise(beyond)


def span_group(first, last, rounds) -> Column:
    """unknown / single / up to a year / over a year, from first and last date and event count."""
    f, l = as_column(first), as_column(last)
    return (F.when(f.isNull() | l.isNull(), "unknown").when(as_column(rounds) == 1, "single")
            .when(within_days(l, f, 365), "up to a year").otherwise("over a year"))


def size_class(count, mass_over: float = 120, mid_from: float = 35, of: Column | None = None) -> Column:
    """Class of a population count: mass above one bound, mid from the other, else niche. With ``of``, a total, the bounds
    are shares of it."""
    c, total = as_column(count), F.lit(1) if of is None else of
    return F.when(c > total * F.lit(mass_over), "mass").when(c >= total * F.lit(mid_from), "mid").otherwise("niche")


def with_size_class(df: DataFrame, key: str, mass_over: float = 120, mid_from: float = 35, shares: bool = False) -> DataFrame:
    """Rows with the population of their key and its class; a NULL key has neither. With ``shares`` the bounds are shares
    of the rows with a key, so classes mean the same at every size of the table."""
    counts = df.groupBy(key).agg(F.count(key).alias("key_count"))
    total = counts.agg(F.sum("key_count")).scalar() if shares else None
    known = F.col(key).isNotNull()
    classed = counts.withColumn("size_class", F.when(known, size_class("key_count", mass_over, mid_from, total)))
    return null_safe_join(df, classed.withColumn("key_count", F.when(known, F.col("key_count"))), [key])


def collapse_small(key: str, cls: str = "size_class") -> Column:
    """Keys of the mass class stay; others become their class; a NULL key is niche."""
    return (F.when(F.col(cls) == "mass", F.col(key)).when(F.col(cls) == "mid", "mid").otherwise("niche"))


def size_class_summary(df: DataFrame, key: str, mass_over: float = 120, mid_from: float = 35, shares: bool = False) -> DataFrame:
    """Per class: number of keys, rows, percent of rows; ``shares`` as in ``with_size_class``."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    total = counts.agg(F.sum("_k")).scalar() if shares else None
    out = (counts.withColumn("size_class", size_class("_k", mass_over, mid_from, total)).groupBy("size_class")
           .agg(F.count(F.lit(1)).alias("n_keys"), F.sum("_k").alias("n_rows")))
    return with_share(out, "n_rows", "row_percent", scale=100.0, small=True)     # three classes


def share_by_segment(df: DataFrame, segment, *, small: bool = False, **measures: Column) -> DataFrame:
    """Aggregates per segment, each also as percent of the sum over segments; ``small`` as in ``with_shares``."""
    totals = df.groupBy(segment).agg(*[m.alias(n) for n, m in measures.items()])
    return with_shares(totals, {n: f"{n}_percent" for n in measures}, scale=100.0, small=small)


def change_percent(new, old) -> Column:
    """100 * (new - old) / old."""
    return ratio(as_column(new) - as_column(old), old) * 100.0
