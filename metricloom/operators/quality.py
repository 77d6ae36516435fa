"""Reports on the state of a table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numbers import ratio
from metricloom.operators.attach import null_safe_join


def _tall(one_row: DataFrame, structs) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


def table_overview(df: DataFrame) -> DataFrame:
    """Position, name, type of every column, with the row count."""
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    parts = [F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"),
                      F.lit(f.dataType.simpleString()).alias("type"), F.col("n_rows"))
             for i, f in enumerate(df.schema)]
    return _tall(rows, parts)


def missing_report(df: DataFrame, columns=None) -> DataFrame:
    """Per column: type, NULL count, NULL percent; one pass over the table."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)])
    parts = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"_m{i}").alias("missing_count"),
                      F.bround(ratio(f"_m{i}", "_n") * 100, 2).alias("missing_percent"))
             for i, c in enumerate(columns)]
    return _tall(one, parts)


def sentinel_report(df: DataFrame, conditions: dict) -> DataFrame:
    """Per column: rows carrying a sentinel (given as a condition) and their percent."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(cond).alias(f"_m{i}") for i, cond in enumerate(conditions.values())])
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("sentinel_count"),
                      F.bround(ratio(f"_m{i}", "_n") * 100, 2).alias("sentinel_percent"))
             for i, c in enumerate(conditions)]
    return _tall(one, parts)


def missing_cooccurrence(df: DataFrame, columns) -> DataFrame:
    """Correlation of NULL indicators per column pair; NULL when one never varies."""
    columns, pairs = list(columns), list(combinations(columns, 2))
    gone = lambda c: F.col(c).isNull()
    one = df.agg(F.count(F.lit(1)).cast("double").alias("_n"),
                 *[F.count_if(gone(c)).cast("double").alias(f"_c_{c}") for c in columns],
                 *[F.count_if(gone(a) & gone(b)).cast("double").alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])

    def corr(i: int, a: str, b: str) -> Column:
        n, ka, kb = F.col("_n"), F.col(f"_c_{a}"), F.col(f"_c_{b}")
        return ratio(n * F.col(f"_p{i}") - ka * kb, F.sqrt(ka * (n - ka)) * F.sqrt(kb * (n - kb)))
    parts = [F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), corr(i, a, b).alias("null_corr"))
             for i, (a, b) in enumerate(pairs)]
    return _tall(one, parts)


def duplicate_groups(df: DataFrame, subset=None) -> DataFrame:
    """Distinct key values that occur more than once, with ``copies``."""
    return (df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def duplicate_summary(df: DataFrame, subset=None) -> DataFrame:
    """Rows, rows beyond the first of each value, and rows sharing a value with another."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("k"))
    return groups.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra_rows"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("rows_in_duplicates"))


def rows_in_duplicates(df: DataFrame, subset) -> DataFrame:
    """Every row whose key value occurs more than once."""
    return null_safe_join(df, duplicate_groups(df, subset).drop("copies"), subset)


def vocabulary(df: DataFrame, columns) -> DataFrame:
    """Distinct values of category columns with their counts, NULL included."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return (df.select(F.inline(F.array(*parts))).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def any_of(conditions) -> Column:
    """True when at least one comparison holds; an unknown comparison does not count."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def row_audit(stages: dict) -> DataFrame:
    """Row count of each processing stage and percent removed since the first."""
    counted = [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("step"), F.lit(n).alias("stage"), "n_rows")
               for i, (n, d) in enumerate(stages.items())]
    rows = reduce(DataFrame.unionByName, counted)
    base = counted[0].select("n_rows").scalar()
    return rows.withColumn("removed_percent", F.bround(ratio(base - F.col("n_rows"), base) * 100, 4))


def keys_with_many(df: DataFrame, key: str, column: str, name: str = "n_values") -> DataFrame:
    """Keys carrying more than one non-NULL value of a column."""
    return df.groupBy(key).agg(F.count(column).alias(name)).filter(F.col(name) > 1)


def value_range(df: DataFrame, columns) -> DataFrame:
    """Smallest and largest value of each column, on one row."""
    return df.agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))])
