"""Places in an order and exact percentiles of groups of any size, by ranges.

Rows are dealt to ranges of about equal numbers in the order of group and value, and written; a range and group is counted over,
so the place of every row is known without any task holding a group. A percentile needs two rows: only the range that holds
their places is looked up, by row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.sources.tables import written


def _ordered(rows: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with their number ``_at``, written; runs: _range, _by, _first, _earlier, _count and n of the group)."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, by, *order).sortWithinPartitions(by, *order)
    at = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "in-order")
    runs = at.groupBy(F.shiftrightunsigned("_at", 33).alias("_range"), F.col(by).alias("_by")).agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_by")
    earlier = F.coalesce(F.sum("_count").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at, runs.withColumns({"_earlier": earlier, "n": F.sum("_count").over(group)})


def in_place(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0, in their group and ``n``, the group's number of rows. Null groups are a group."""
    at, runs = _ordered(rows, by, order)
    met = at.withColumn("_range", F.shiftrightunsigned("_at", 33)).join(runs.withColumnRenamed("_range", "_r"), (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn("place", F.col("_at") - F.col("_first") + F.col("_earlier")).select(*rows.columns, "place", "n")


def percentiles(df: DataFrame, by: list[str], values: dict[str, Column], points: tuple[float, ...]) -> DataFrame:
    """(by, name, point, value): percentiles of each of ``values`` in each group, interpolated at (n - 1) * point; nulls left out.

    A group without values has no row for it."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), v.cast("double").alias("value")) for name, v in values.items()]))
    rows = df.select(F.struct(*[F.col(c) for c in by] or [F.lit(0)]).alias("_key"), each.alias("_v")).select(F.struct("_key", "_v.name").alias("group"), "_v.value").where("value is not null")
    at, runs = _ordered(rows, "group", ["value"])
    rank = (F.col("n") - 1) * F.col("point")
    wanted = runs.withColumn("point", F.explode(F.array(*[F.lit(float(p)) for p in points]))).withColumn("_share", rank - F.floor(rank))
    ends = wanted.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))))
    held = ends.where((F.col("_place") >= F.col("_earlier")) & (F.col("_place") < F.col("_earlier") + F.col("_count")))
    numbers = held.select("point", "_share", F.col("_by").alias("group"), (F.col("_first") + F.col("_place") - F.col("_earlier")).alias("_at"))
    low, high = F.min("value"), F.max("value")
    found = numbers.join(at.select("_at", "value"), "_at").groupBy("group", "point").agg((low + (high - low) * F.first("_share")).alias("value"))
    return found.select(*[F.col(f"group._key.{c}").alias(c) for c in by], F.col("group.name").alias("name"), "point", "value")


def with_percentiles(summary: DataFrame, df: DataFrame, by: list[str], values: dict[str, Column], columns: dict[str, tuple[str, float]], digits: int) -> DataFrame:
    """``summary`` (a row a group) with ``columns``, each a (name, point) of ``values``, null where a group has no such value."""
    found = percentiles(df, by, values, tuple(sorted({p for _, p in columns.values()})))
    pick = lambda name, p: F.round(F.max(F.when((F.col("name") == name) & (F.col("point") == p), F.col("value"))), digits)
    wide = found.groupBy(*by).agg(*[pick(*what).alias(c) for c, what in columns.items()]).select(*[F.col(c).alias(f"_{c}") for c in by], *columns)
    if not by:
        return summary.crossJoin(wide)  # a row each
    same = [summary[c].eqNullSafe(wide[f"_{c}"]) for c in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return summary.join(wide, on, "left").select(*summary.columns, *columns)
