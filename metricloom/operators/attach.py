"""Bringing aggregates back to rows without a window over unbounded groups.

A one-row aggregate is attached as a scalar subquery (its size is one row by construction).
A per-key aggregate is attached by an equi-join, left to the runtime: adaptive execution
broadcasts it when it measures small and splits hot keys of the row side when it does not.
A window over raw rows would instead pull each key, or everything, into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.numbers import ratio

#: Rows of a key that meet its row of a table in one place.
HOT_ROWS = 1 << 17


def scalar_of(one_row: DataFrame) -> Column:
    """All columns of a one-row DataFrame as one struct-valued scalar subquery."""
    return one_row.select(F.struct("*")).scalar()


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append every column of a one-row aggregate to each row."""
    packed = df.withColumn("_one", scalar_of(one_row))
    return packed.select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in one_row.columns])


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on same-named keys where NULL matches NULL; key columns appear once."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        eq = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = eq if cond is None else cond & eq
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def attached(rows: DataFrame, table: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``null_safe_join`` of rows with a table of one row per key, whatever share of the rows a key holds.

    The rows of a key above ``HOT_ROWS`` are dealt out to as many parts as it has multiples of that, and its row of the
    table is copied to each. The table is hashed and the rows pass by it, so no task holds or sorts them.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > HOT_ROWS)
    hot = F.broadcast(sizes.select(*keys, F.ceil(F.col("_rows") / HOT_ROWS).alias("_parts")))     # all rows / HOT_ROWS keys at most
    dealt = null_safe_join(rows, hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), "_parts"), F.lit(0)))
    copies = null_safe_join(table, hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0)))))
    return null_safe_join(dealt.drop("_parts"), copies.drop("_parts").hint("shuffle_hash"), [*keys, "_part"], how).drop("_part")


def with_group_totals(df: DataFrame, keys, **aggs: Column) -> DataFrame:
    """Append per-key aggregates to each row (``keys`` empty: the grand total)."""
    keys = list(keys)
    if not keys:
        return with_scalars(df, df.agg(*[a.alias(n) for n, a in aggs.items()]))
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return null_safe_join(df, totals, keys)


def with_shares(df: DataFrame, names: dict, by=(), scale: float = 1.0, small: bool = False) -> DataFrame:
    """Append measures as shares of their totals, overall or inside ``by``; ``names`` maps measure to new column.

    ``small`` is for report tables over a fixed set of labels (months, device types): their few
    rows fit one window, which saves computing the report a second time for its totals. Leave
    it off when the number of rows grows with the data.
    """
    if small:
        w = Window.partitionBy(*by)
        return df.withColumns({n: ratio(F.col(m), F.sum(m).over(w)) * F.lit(scale) for m, n in names.items()})
    out = with_group_totals(df, by, **{f"_t_{m}": F.sum(m) for m in names})
    shares = {n: ratio(m, f"_t_{m}") * F.lit(scale) for m, n in names.items()}
    return out.withColumns(shares).drop(*[f"_t_{m}" for m in names])


def with_share(df: DataFrame, measure: str, name: str, by=(), scale: float = 1.0, small: bool = False) -> DataFrame:
    """``with_shares`` for a single measure."""
    return with_shares(df, {measure: name}, by, scale, small)
