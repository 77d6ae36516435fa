"""Association between columns of mixed kinds, from contingency counts."""

from __future__ import annotations

import json
import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.distributions import normal_between
from metricloom.functions.numbers import ratio
from metricloom.operators.attach import scalar_of


def bin_numeric(df: DataFrame, columns, bins: int = 10) -> DataFrame:
    """Numeric columns replaced by the index of their equal-width bin; NULL stays NULL."""
    columns = list(columns)
    if not columns:
        return df
    edges = df.agg(*[f(c).cast("double").alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))])
    out = df.withColumn("_e", scalar_of(edges))
    for c in columns:
        lo, hi = F.col("_e")[f"lo_{c}"], F.col("_e")[f"hi_{c}"]
        position = F.try_divide(F.col(c) - lo, (hi - lo) / bins)
        index = F.when(F.col(c).isNotNull(), F.least(F.coalesce(F.floor(position), F.lit(0)), F.lit(bins - 1)))
        out = out.withColumn(c, index.cast("string"))
    return out.drop("_e")


def pair_counts(df: DataFrame, columns) -> DataFrame:
    """Contingency cells of every column pair: (left_column, right_column, a, b, n).

    The table is first collapsed to its joint counts, so pairs are formed from distinct
    combinations and not from rows. Rows with a NULL on either side are left out of a pair.
    """
    columns = list(columns)
    joint = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).groupBy(*columns).agg(F.count(F.lit(1)).alias("_k"))
    cells = [F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(a).alias("a"), F.col(b).alias("b"))
             for a, b in combinations(columns, 2)]
    return (joint.select("_k", F.inline(F.array(*cells))).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
            .groupBy("left_column", "right_column", "a", "b").agg(F.sum("_k").alias("n")))


PAIR = ["left_column", "right_column"]


def chi_square(cells: DataFrame) -> DataFrame:
    """Per pair: rows, levels on each side, chi-square against independence, Cramér's V."""
    return _fit(cells).drop("_sparse")


def _fit(cells: DataFrame) -> DataFrame:
    left = cells.groupBy(*PAIR, "a").agg(F.sum("n").alias("n_a"))
    right = cells.groupBy(*PAIR, "b").agg(F.sum("n").alias("n_b"))
    sizes = left.groupBy(*PAIR).agg(F.sum("n_a").alias("n_rows"), F.count(F.lit(1)).alias("left_levels")).join(
        right.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("right_levels")), PAIR)
    joined = cells.join(left, [*PAIR, "a"]).join(right, [*PAIR, "b"]).join(sizes, PAIR)
    product = F.col("n_a").cast("double") * F.col("n_b")
    out = joined.groupBy(*PAIR, "n_rows", "left_levels", "right_levels").agg(
        F.sum(F.col("n").cast("double") * F.col("n") / product).alias("_t"),
        F.count_if(product < F.col("n_rows")).alias("_sparse"))        # seen cells with under one expected row
    narrow = F.least("left_levels", "right_levels") - 1
    return (out.withColumn("chi2", F.greatest(F.col("n_rows") * (F.col("_t") - 1), F.lit(0.0)))
            .withColumn("cramers_v", F.sqrt(ratio(F.col("chi2"), F.col("n_rows") * narrow))).drop("_t"))


def _empty_as_expected(cells: DataFrame) -> DataFrame:
    """Per pair: all cells of the full table, seen or not, with under one expected row.

    A margin is reduced to its distinct sizes, at most about ``sqrt(2 * n_rows)`` of them. In the order of sizes a running
    sum of the right levels gives, for every left size, the right levels small enough; no margin is gathered.
    """
    sizes = lambda side: cells.groupBy(*PAIR, side).agg(F.sum("n").alias("_m")).groupBy(*PAIR, "_m").agg(F.count(F.lit(1)).alias("_levels"))
    rows = cells.groupBy(*PAIR).agg(F.sum("n").alias("_n"))
    limits = sizes("a").join(rows, PAIR).select(*PAIR, F.expr("(_n - 1) div _m").alias("_size"), F.lit(1).alias("_side"), "_levels")
    right = sizes("b").select(*PAIR, F.col("_m").alias("_size"), F.lit(0).alias("_side"), "_levels")
    upto = Window.partitionBy(*PAIR).orderBy("_size", "_side").rowsBetween(Window.unboundedPreceding, 0)
    small = limits.unionByName(right).withColumn("_small", F.sum(F.when(F.col("_side") == 0, F.col("_levels")).otherwise(0)).over(upto))
    return small.groupBy(*PAIR).agg(F.sum(F.when(F.col("_side") == 1, F.col("_levels") * F.col("_small")).otherwise(0)).alias("_under_one"))


#: The bivariate normal is binned over this many deviations each way; correlations are sought up to ``TOP_RHO``.
REACH, TOP_RHO = 5.0, 0.9999
#: The search divides its range in ``WAYS``, ``ROUNDS`` times. Cells of the normal are computed in blocks.
WAYS, ROUNDS, BLOCK = 16, 5, 4096
#: Quadrature points of a bin; narrow bins of many levels take fewer, ``TOTAL_NODES`` over the whole range at least.
NODES, TOTAL_NODES = 24, 4800


def nodes(n: int) -> list[tuple[float, float]]:
    """Points and weights of the quadrature with ``n`` points."""
    return list(zip(*(x.tolist() for x in np.polynomial.legendre.leggauss(n))))


def _node_tables() -> Column:
    """The quadratures of 1 to ``NODES`` points as one literal: an array of arrays of struct<u, w>."""
    tables = [[{"u": u, "w": w} for u, w in nodes(n)] for n in range(1, NODES + 1)]
    return F.from_json(F.lit(json.dumps(tables)), "array<array<struct<u: double, w: double>>>")


def _cell_probability(rho: Column) -> Column:
    """Of cell (``_i``, ``_j``) of the standard bivariate normal on uniform bins."""
    half, width = F.lit(REACH) / F.col("_r"), F.lit(2 * REACH) / F.col("_k")
    mid = F.lit(-REACH) + half * (F.col("_i") * 2 + 1)
    low = F.lit(-REACH) + width * F.col("_j")
    deviation = F.sqrt(F.lit(1.0) - rho * rho)

    def add(total, node):
        at = lambda x: node["w"] * F.exp(x * x / F.lit(-2.0)) * normal_between((low - rho * x) / deviation, (low + width - rho * x) / deviation)
        return total + F.transform(F.array(mid + half * node["u"]), at)[0]
    return F.aggregate("_nodes", F.lit(0.0), add) * half / F.lit(math.sqrt(2 * math.pi))


def _with_spreads(table: DataFrame, rhos: list[Column]) -> DataFrame:
    """Columns ``_s0``, ``_s1``, ...: chi-square over rows of the binned normal of each correlation, against independence.

    The cells are formed in blocks that spread over tasks, so a pair with very many levels has no task of its own.
    """
    blocks = table.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_cells - 1) div {BLOCK}")))).repartition(*PAIR, "_block")
    last = F.least(F.col("_block") * BLOCK + (BLOCK - 1), F.col("_cells") - 1)
    mine = F.get(_node_tables(), F.least(F.lit(NODES), F.ceil(F.lit(float(TOTAL_NODES)) / F.col("_r"))).cast("int") - 1)
    cells = blocks.withColumn("_nodes", mine).withColumn("_c", F.explode(F.sequence(F.col("_block") * BLOCK, last)))
    cells = cells.withColumns({"_i": F.expr("_c div _k"), "_j": F.expr("_c % _k")}).withColumn("_flat", _cell_probability(F.lit(0.0)))
    term = lambda p: (p - F.col("_flat")) * (p - F.col("_flat")) / F.greatest(F.col("_flat"), F.lit(1e-300))
    cells = cells.withColumn("_terms", F.transform(F.transform(F.array(*rhos), _cell_probability), term))
    return cells.groupBy(*table.columns).agg(*[F.sum(F.col("_terms")[n]).alias(f"_s{n}") for n in range(len(rhos))])


def phi_k(cells: DataFrame) -> DataFrame:
    """Correlation of the binned bivariate normal whose chi-square matches each pair's table.

    Chi-square of pure noise is taken off first: degrees of freedom without the cells that are empty as expected. The
    spread of the normal grows with its correlation, so every round computes ``WAYS - 1`` correlations of the range left
    and keeps the part that holds the target. NULL where a side has one level. Built-in functions only; the cost of a
    pair is the number of its cells, levels times levels, divided among tasks.
    """
    table = _fit(cells).join(_empty_as_expected(cells), PAIR)
    r, k = F.col("left_levels"), F.col("right_levels")
    empty = F.col("_under_one") - F.col("_sparse")
    top = F.col("n_rows") * (F.least(r, k) - 1).cast("double")
    noise = F.greatest((r - 1) * (k - 1) - empty, F.lit(0)).cast("double")
    known = F.when(top <= 0, F.lit(None).cast("double")).when((F.col("chi2") <= noise) | (noise >= top), F.lit(0.0)).when(F.col("chi2") >= top, F.lit(1.0))
    sought = known.isNull() & (top > 0)
    table = table.select(*PAIR, "n_rows", "chi2", "cramers_v", known.alias("_known"), r.alias("_r"), k.alias("_k"), sought.alias("_sought"),
                         F.when(sought, (F.col("chi2") - noise) / (top - noise)).alias("_share"), F.when(sought, r * k).otherwise(1).alias("_cells"))
    table = _with_spreads(table, [F.lit(TOP_RHO)]).withColumn("_share", F.col("_share") * F.col("_s0")).drop("_s0").withColumn("_low", F.lit(0.0))
    for n in range(1, ROUNDS + 1):
        step = TOP_RHO / WAYS ** n
        found = _with_spreads(table, [F.col("_low") + F.lit(step * i) for i in range(1, WAYS)])
        below = sum((F.when(F.col(f"_s{i}") < F.col("_share"), 1).otherwise(0) for i in range(WAYS - 1)), F.lit(0))
        table = found.select(*[(F.col("_low") + below * F.lit(step)).alias("_low") if c == "_low" else c for c in table.columns])
    middle = F.round(F.col("_low") + F.lit(TOP_RHO / WAYS ** ROUNDS / 2), 4)
    return table.select(*PAIR, "n_rows", "chi2", "cramers_v", F.when(F.col("_sought"), middle).otherwise(F.col("_known")).alias("phi_k"))


def strongest_with(pairs: DataFrame, target: str, measure: str) -> DataFrame:
    """The column most associated with a target column; of equal ones the first by name."""
    other = F.when(F.col("left_column") == target, F.col("right_column")).otherwise(F.col("left_column"))
    mine = pairs.filter((F.col("left_column") == target) | (F.col("right_column") == target))
    known = mine.filter(F.col(measure).isNotNull() & ~F.isnan(measure))
    best = known.agg(F.min(F.struct((-F.col(measure)).alias("m"), other.alias("feature"))).alias("_b"))
    return best.select(F.lit(target).alias("target"), "_b.feature", (-F.col("_b.m")).alias(measure))


