"""Exact quantiles that never hold a whole group.

The built-in exact percentile keeps one entry per distinct value of a group in the memory of
one task. Here narrowing is repeated: a mergeable sketch of fixed size gives, for every wanted
quantile, two values that are guaranteed to enclose its rank; a sketch of the values between the
two gives a narrower pair; and one last pass counts what lies below and keeps the rows between
them, already collapsed to (value, count). The exact order statistic is then picked from that
slice. Every pass combines map-side, and every group goes the same way, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.operators.attach import attached, scalar_of

ACCURACY = 10_000
CUTS = 256


def quantiles(df: DataFrame, value: str, probs: dict, by=(), kind: str = "linear",
              method: str = "exact", accuracy: int = ACCURACY, count: str | None = None) -> DataFrame:
    """One row per key with a column for each named probability; NULL values are skipped.

    kind: ``linear`` interpolates between neighbours, ``discrete`` returns an existing value.
    method: ``exact`` (any size); ``counts`` (exact and cheaper, for columns known to have few
    distinct values: one task sorts the value counts of a key); ``builtin`` (the exact built-in
    percentile, same limits); ``approx`` (the sketch alone). ``count`` names a column for the
    number of values.
    """
    if kind not in ("linear", "discrete"):
        raise ValueError(f"unknown kind {kind!r}")
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    size = [F.count("_v").alias(count)] if count else []
    if method == "builtin":
        fn = "percentile_cont" if kind == "linear" else "percentile_disc"
        return rows.groupBy(*by).agg(
            *size, *[F.expr(f"{fn}({p}) within group (order by _v)").alias(n) for n, p in probs.items()])
    if method == "approx":
        return rows.groupBy(*by).agg(
            *size, *[F.percentile_approx("_v", p, accuracy).alias(n) for n, p in probs.items()])
    if method == "counts":
        cells = rows.groupBy(*by, F.col("_v").alias("_x")).agg(F.count("*").alias("_k")).withColumn("_in", F.lit(True))
        sized = cells.withColumn("_n", F.sum("_k").over(Window.partitionBy(*by)))
        return _pick(sized, probs, by, kind, count)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    return _exact(rows, probs, by, kind, accuracy, count)


def quantile_table(df: DataFrame, columns, probs: dict, by=(), kind: str = "linear",
                   method: str = "exact", accuracy: int = ACCURACY) -> DataFrame:
    """Quantiles of several columns at once: rows are keyed by ``by`` and ``column``."""
    by = list(by)
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns]
    long = df.select(*by, F.explode(F.array(*parts)).alias("_p")).select(*by, "_p.column", "_p._x")
    return quantiles(long, "_x", probs, [*by, "column"], kind, method, accuracy)


def _ranks(probs: dict, kind: str) -> list[tuple[str, str]]:
    """The two ranks (from 0) of a group of ``_n`` values that each quantile lies between."""
    if kind == "discrete":
        return [(f"greatest(ceil({float(p)!r}D * _n) - 1, 0L)",) * 2 for p in probs.values()]
    return [(f"floor({float(p)!r}D * (_n - 1))", f"ceil({float(p)!r}D * (_n - 1))") for p in probs.values()]


def _attached(rows: DataFrame, brackets: DataFrame, by: list) -> DataFrame:
    """Rows with the bracket columns of their group."""
    if by:
        return attached(rows, brackets, by)
    return rows.withColumn("_b", scalar_of(brackets)).select("_v", "_b.*")


def _first_brackets(rows: DataFrame, ranks: list, ps: list, by: list, accuracy: int) -> DataFrame:
    """``_n`` and for each quantile ``_lo, _hi``: values of the group that enclose its ranks.

    The sketch is asked for a ladder of shares on either side of a quantile, each four times as far as the one before, and
    a group takes the nearest that its size allows: the value at share q has a rank (from 0) between q * _n - 1 and
    q * _n, give or take the sketch's error.
    """
    steps = [4 / accuracy]
    while steps[-1] < 1:
        steps.append(steps[-1] * 4)
    shares = [min(max(p + sign * d, 0.0), 1.0) for p in ps for sign in (-1, 1) for d in steps]
    sketch = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                   F.percentile_approx("_v", shares, accuracy).alias("_e"))

    def edge(side: int, far: str, beyond: str) -> str:
        step = f"greatest(0, cast(ceil(log(4, ({far} + {2 / accuracy!r}D) * {accuracy / 4!r}D) + 1e-9D) as int))"
        return f"if({step} >= {len(steps)}, {beyond}, _e[{side * len(steps)} + least({step}, {len(steps) - 1})])"
    columns = []
    for i, (p, (lower, upper)) in enumerate(zip(ps, ranks)):
        columns += [F.expr(edge(2 * i, f"{p!r}D - {lower} / _n", "_min")).alias(f"_lo{i}"), F.expr(edge(2 * i + 1, f"({upper} + 1) / _n - {p!r}D", "_max")).alias(f"_hi{i}")]
    return sketch.select(*by, "_n", *columns)


def _narrower(rows: DataFrame, brackets: DataFrame, ranks: list, by: list, accuracy: int) -> DataFrame:
    """The brackets after a sketch of the values inside each; cut points at ``CUTS`` even shares of them."""
    shares = [j / CUTS for j in range(1, CUTS)]
    names = [c for c in brackets.columns if c not in by]
    found = []
    for i in range(len(ranks)):
        inside = f"_v between _lo{i} and _hi{i}"
        found += [F.count_if(F.expr(f"_v < _lo{i}")).alias(f"_below{i}"), F.count_if(F.expr(inside)).alias(f"_in{i}"),
                  F.percentile_approx(F.expr(f"if({inside}, _v, null)"), shares, accuracy).alias(f"_c{i}")]
    sketch = _attached(rows, brackets, by).groupBy(*by, *names).agg(*found)
    columns, error = [], f"{2 / accuracy!r}D"
    for i, (lower, upper) in enumerate(ranks):
        low = f"cast(floor((({lower} - _below{i}) / _in{i} - {error}) * {CUTS}) as int)"
        high = f"cast(ceil((({upper} - _below{i} + 1) / _in{i} + {error}) * {CUTS}) as int)"
        columns += [F.expr(f"if({low} < 1, _lo{i}, _c{i}[least({low}, {CUTS - 1}) - 1])").alias(f"_lo{i}"),
                    F.expr(f"if({high} >= {CUTS}, _hi{i}, _c{i}[greatest({high}, 1) - 1])").alias(f"_hi{i}")]
    return sketch.select(*by, "_n", *columns)


def _ranks(probs: dict, kind: str) -> list[tuple[str, str]]:
    """The two ranks (from 0) among ``_n`` values that each quantile lies between."""
    if kind == "discrete":
        return [(f"greatest(ceil({float(p)!r}D * _n) - 1, 0L)",) * 2 for p in probs.values()]
    return [(f"floor({float(p)!r}D * (_n - 1))", f"ceil({float(p)!r}D * (_n - 1))") for p in probs.values()]


def _exact(rows: DataFrame, probs: dict, by: list, kind: str, accuracy: int, count: str | None) -> DataFrame:
    ranks = _ranks(probs, kind)
    brackets = _first_brackets(rows, ranks, [float(p) for p in probs.values()], by, accuracy)
    joined = _attached(rows, _narrower(rows, brackets, ranks, by, accuracy), by)

    # A value inside a bracket stands for itself; any other counts as "just below" the next
    # bracket, so running counts over the cells are ranks in the whole group.
    inside = " or ".join(f"_v between _lo{i} and _hi{i}" for i in range(len(ranks)))
    next_low = [f"if(_lo{i} > _v, _lo{i}, null)" for i in range(len(ranks))]
    above = f"least({', '.join(next_low)})" if len(ranks) > 1 else next_low[0]
    cells = (joined.select(*by, "_n", F.expr(inside).alias("_in"), F.expr(f"if({inside}, _v, {above})").alias("_x"))
             .filter("_x is not null")
             .groupBy(*by, "_n", "_x", "_in").agg(F.count("*").alias("_k")))
    return _pick(cells, probs, by, kind, count)


def _pick(cells: DataFrame, probs: dict, by: list, kind: str, count: str | None) -> DataFrame:
    """Order statistics from (value, is a value, count) cells that cover the ranks in question."""
    order = Window.partitionBy(*by, "_n").orderBy("_x", "_in").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_to", F.sum("_k").over(order))

    def at(rank: str) -> str:
        return f"max(if(_to - _k <= {rank} and {rank} < _to, struct(_in, _x), null))"

    def checked(pick: str) -> str:
        return f"if({pick}._in, {pick}._x, raise_error('quantile outside its bracket: raise accuracy'))"

    picks, results = [], []
    for i, ((name, p), (lower, upper)) in enumerate(zip(probs.items(), _ranks(probs, kind))):
        picks.append(F.expr(at(lower)).alias(f"_a{i}"))
        if kind == "discrete":
            results.append(F.expr(checked(f"_a{i}")).alias(name))
        else:
            picks.append(F.expr(at(upper)).alias(f"_b{i}"))
            a, b, h = checked(f"_a{i}"), checked(f"_b{i}"), f"({float(p)!r}D * (_n - 1))"
            results.append(F.expr(f"{a} + ({b} - {a}) * ({h} - floor({h}))").alias(name))
    size = [F.col("_n").alias(count)] if count else []
    return ranked.groupBy(*by, "_n").agg(*picks).select(*by, *size, *results)
