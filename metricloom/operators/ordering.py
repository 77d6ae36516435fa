"""Sorting, top-k, ranks, and per-key sequences that survive hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from metricloom.sources.shared import shared_path, write_extract


def order_by(df: DataFrame, *spec) -> DataFrame:
    """Sort by names; a leading ``-`` means descending. NULLs go last either way."""
    cols = [F.desc_nulls_last(s[1:]) if s.startswith("-") else F.asc_nulls_last(s) for s in spec]
    return df.orderBy(*cols)


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Place of every row in a frame that is already sorted, from 1.

    The sorted rows are written once, with their range and their place in it, and read back: a lost executor can't
    change them any more. The rows before a range follow from one number per range.
    """
    placed = ordered.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    held = _held(placed)
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))     # one row per range
    return held.join(F.broadcast(starts), "_part").select(*ordered.columns, (F.col("_before") + F.col("_row") + 1).alias(name))


def top_k(df: DataFrame, k: int, *spec) -> DataFrame:
    """First k rows of the given order; end the order with a unique key to settle ties."""
    return order_by(df, *spec).limit(k)


def top_n_per_group(df: DataFrame, n: int, by, *spec) -> DataFrame:
    """First n rows of each group. Each map task keeps only its own n per group."""
    cols = [F.desc_nulls_last(s[1:]) if s.startswith("-") else F.asc_nulls_last(s) for s in spec]
    w = Window.partitionBy(*by).orderBy(*cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def dense_rank_small(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Dense rank, largest first, for report tables of bounded size (months, weekdays)."""
    return df.withColumn(name, F.dense_rank().over(Window.orderBy(F.desc_nulls_last(measure))))


def arg_max(df: DataFrame, key: str, measure: str, by=()) -> DataFrame:
    """Key with the largest measure, smallest key on ties, as an aggregate (no sort)."""
    best = F.min(F.struct((-F.col(measure)).alias("m"), F.col(key).alias("k"))).alias("_best")
    out = df.filter(F.col(measure).isNotNull()).groupBy(*by).agg(best)
    return out.select(*by, F.col("_best.k").alias(key), (-F.col("_best.m")).alias(measure))


def sorted_by_labels(df: DataFrame, col: str, labels) -> DataFrame:
    """Rows in the order of a fixed label list; labels absent from the data do not appear."""
    return df.orderBy(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col)))


def _held(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a new table in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(write_extract(df, shared_path(df.sparkSession, "ranges")))


def range_count(df: DataFrame, range_bytes: int = 256 << 20) -> int:
    """Ranges that hold about ``range_bytes`` of the input's files each; as many as shuffle partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, -(-sum(n for n in sizes if n < 1 << 60) // range_bytes))      # unknown sizes are huge


def _changes(keys: pa.Array, last: pa.Array) -> np.ndarray:
    """Where a sorted key differs from the one before it (``last``: the one before the first). NULL equals NULL, NaN NaN."""
    before = pa.concat_arrays([last, keys.slice(0, len(keys) - 1)])
    differ = pc.not_equal(keys, before)
    if pa.types.is_floating(keys.type):
        differ = pc.and_(differ, pc.invert(pc.and_(pc.is_nan(keys), pc.is_nan(before))))
    return pc.if_else(pc.is_null(differ), pc.xor(pc.is_null(keys), pc.is_null(before)), differ).to_numpy(zero_copy_only=False)


def _ranged(df: DataFrame, key: str | None, order, previous: str | None = None, sums=(), ranges: int | None = None) -> DataFrame:
    """Rows sorted by key and order in ranges, written once: the one shuffle of the operators below.

    The borders of ranges come from a sample of (key, order, row number), so a key that owns a large part of the table is
    spread over many ranges, and rows of equal order are divided too. One pass over the sorted rows of a range appends
    ``_part``, ``_row`` (place in the range), ``_last`` (whether it is the range's last), and on demand ``_start`` (the row where
    the key begins in this range), ``_previous`` (the value of the row before, of the same key) and ``_sum_<name>`` (running
    sums before the row). No built-in operator sees sorted rows of a range in order without gathering a key, so this pass
    works on Arrow batches; it holds one batch and the last row of the one before.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    columns = [*[key] * (key is not None), *order, "_tie"]
    rows = tied.repartitionByRange(ranges or range_count(df), *columns).sortWithinPartitions(*columns).drop("_tie").withColumn("_part", F.spark_partition_id())
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    more = [StructField("_row", LongType()), StructField("_last", BooleanType())]
    more += [StructField("_start", LongType())] if key is not None else []
    more += [StructField("_previous", types[previous])] if previous is not None else []
    more += [StructField(f"_sum_{m}", types[m]) for m in sums]
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields] + more)

    def work(batches):
        row, start, last, value, totals, held = 0, 0, None, None, dict.fromkeys(sums, 0), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield _closed(held, False)
            out = {c: batch.column(c) for c in batch.schema.names}
            at = np.arange(row, row + n)
            out["_row"] = pa.array(at)
            if key is not None:
                keys = batch.column(key)
                new = _changes(keys, pa.nulls(1, keys.type) if last is None else last)
                new[0] |= last is None
                start_at = np.maximum.accumulate(np.where(new, at, start))
                out["_start"], start, last = pa.array(start_at), int(start_at[-1]), keys.slice(n - 1)
            if previous is not None:
                own = batch.column(previous)
                before = pa.concat_arrays([pa.nulls(1, own.type) if value is None else value, own.slice(0, n - 1)])
                out["_previous"], value = pc.if_else(pa.array(new), pa.scalar(None, own.type), before), own.slice(n - 1)
            for m in sums:
                own = batch.column(m).fill_null(0).to_numpy(zero_copy_only=False)
                run = np.cumsum(own)
                out[f"_sum_{m}"] = pa.array(run - own + totals[m], batch.column(m).type)
                totals[m] += run[-1]
            row, held = row + n, out
        if held is not None:
            yield _closed(held, True)

    def _closed(out, final):
        flags = np.zeros(len(out["_row"]), bool)
        flags[-1] = final
        out["_last"] = pa.array(flags)
        return pa.record_batch([out[f.name] for f in schema.fields], names=[f.name for f in schema.fields])
    return _held(rows.mapInArrow(work, schema))


def with_ordinal(df: DataFrame, key: str, order, name: str, ranges: int | None = None) -> DataFrame:
    """1-based position of each row within its key, in the order of the named columns.

    Rows are sorted into ranges once; a row's place among its key's rows of the range is shifted by the key's rows in
    earlier ranges. Only the last key of a range goes on in the next, so that takes two rows for each range.
    """
    held = _ranged(df, key, order, ranges=ranges)
    ends = held.where("_last").select("_part", F.col(key).alias("_k"), (F.col("_row") - F.col("_start") + 1).alias("_n"), F.lit(1).alias("_end"))
    begins = held.where("_row = 0").select("_part", F.col(key).alias("_k"), F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_end"))
    earlier = Window.partitionBy("_k").orderBy("_part", "_end").rowsBetween(Window.unboundedPreceding, -1)
    carried = begins.unionByName(ends).withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_end = 0").select("_part", "_carry")
    out = held.join(F.broadcast(carried), "_part")                      # one row per range
    place = F.col("_row") - F.col("_start") + 1 + F.when(F.col("_start") == 0, F.col("_carry")).otherwise(0)
    return out.select(*df.columns, place.alias(name))


def with_previous(df: DataFrame, key: str, order, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Value of the key's preceding row, NULL for its first; the first row of a range takes it from the range before."""
    held = _ranged(df, key, order, previous=value, ranges=ranges)
    before = Window.orderBy("_part")
    ends = held.where("_last").select("_part", F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("_end"))
    begins = held.where("_row = 0").select("_part", F.col(key).alias("_k"))
    edges = ends.join(begins, "_part").withColumn("_before", F.lag("_end").over(before))        # one row per range
    carried = edges.select("_part", F.when(F.col("_k").eqNullSafe(F.col("_before.k")) & F.col("_before").isNotNull(), F.col("_before.v")).alias("_carry"))
    out = held.join(F.broadcast(carried), "_part")
    return out.select(*df.columns, F.when(F.col("_row") == 0, F.col("_carry")).otherwise(F.col("_previous")).alias(name))


def running_counts(counts: DataFrame, value: str, measures, ranges: int | None = None) -> DataFrame:
    """Sum of each measure over all rows with a smaller value, as ``<measure>_before``.

    ``counts`` holds one row per value. Rows are sorted into ranges once; sums run inside a range and are shifted by the
    totals of earlier ranges, so no task sees the whole column, and there are more ranges where there are more rows.
    """
    held = _ranged(counts, None, [value], sums=tuple(measures), ranges=ranges)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.where("_last").select("_part", *[(F.col(f"_sum_{m}") + F.coalesce(m, F.lit(0))).alias(f"_t_{m}") for m in measures])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures])
    return (held.join(F.broadcast(offsets), "_part")                    # one row per range
            .select(*counts.columns, *[(F.col(f"_sum_{m}") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures]))
