"""Scans over ordered groups that are dealt over many tasks, however large one group is.

Rows are dealt by ranges of (group, order) into parts, written once, and each
part is worked through on its own. What a part needs of the parts before it is
an associative summary (a count, a product, a maximum, a decayed sum, the last
row): one row for each group and part, scanned over the parts of a group. So a
task holds a part, never a group, and rows that tie in the whole order share a
part. Null keys form groups of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrace.runtime import materialize

PART = "__part"
#: Rows of a block of a decayed sum at most, and how far a weight may fall in one (far below what a double can tell from nothing).
BLOCK_ROWS, LEAST_WEIGHT = 4096, 1e-60
#: A block that isn't cut short by BLOCK_ROWS has a decay of FURTHER at most, of which a power above LAGS is zero in a double.
FURTHER, LAGS = 1e-29, 12


def in_parts(df: DataFrame, by: Sequence[str], order: Sequence[str], tag: str = "scan") -> DataFrame:
    """df with the number of each row's part: parts follow (by, order), and rows that are equal there share one."""
    return materialize(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()), tag)


def matched(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """rows with the other columns of small, joined on keys whose nulls are equal."""
    renamed = small.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in small.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(renamed, same, how).drop(*(f"__k{i}" for i in range(len(keys))))


def carried(parts: DataFrame, by: Sequence[str], summary: Column, fold, name: str = "__carry", *, after: bool = False) -> DataFrame:
    """parts with the fold of the summaries of the parts before each row's own, of its group (with after: of those behind it).

    summary is an aggregate over a part, fold makes an aggregate of the summaries' column; it is null for a group's first part.
    """
    each = parts.groupBy(*by, PART).agg(summary.alias("__summary"))
    line = Window.partitionBy(*by).orderBy(F.desc(PART) if after else PART).rowsBetween(Window.unboundedPreceding, -1)
    return matched(parts, each.select(*by, PART, fold(F.col("__summary")).over(line).alias(name)), [*by, PART])


def within(by: Sequence[str], order: Sequence, last: int = 0):
    """The window of a row's part up to it (or up to the row before it, with last -1)."""
    return Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position", tag: str = "positions") -> DataFrame:
    """Adds a row's position from 0 in its group; the order should be total for reruns to agree."""
    rows = carried(in_parts(df, by, order, tag), by, F.count(F.lit(1)), F.sum)
    place = F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order)) - 1 + F.coalesce("__carry", F.lit(0))
    return rows.withColumn(name, place).drop("__carry", PART)


def previous(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], name: str, tag: str = "previous") -> DataFrame:
    """Adds the column's value in the row before, of the same group (null in the first row)."""
    parts = in_parts(df, by, order, tag)
    rows = carried(parts, by, F.max_by(F.struct(column), F.struct(*order)), F.last)
    line = Window.partitionBy(*by, PART).orderBy(*order)
    return rows.withColumn(name, F.when(F.row_number().over(line) == 1, F.col("__carry")[column]).otherwise(F.lag(column).over(line))).drop("__carry", PART)


def wealth(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], *, from_one: bool = False) -> DataFrame:
    """Adds wealth (running product of 1 + value; null counts as 0), peak (its running maximum) and drawdown (wealth / peak - 1).

    Two carries: the product of the parts before, then, as wealth may turn negative and order its maxima anew, the largest wealth of the parts before.
    """
    growth = 1 + F.col(value)
    rows = carried(in_parts(df, by, order, "wealth"), by, F.product(growth), F.product)
    rows = rows.withColumn("wealth", F.coalesce("__carry", F.lit(1.0)) * F.coalesce(F.product(growth).over(within(by, order)), F.lit(1.0))).drop("__carry")
    rows = carried(rows, by, F.max("wealth"), F.max)
    peak = F.greatest(F.max("wealth").over(within(by, order)), F.col("__carry"), F.lit(1.0 if from_one else None).cast("double"))
    return rows.withColumn("peak", peak).withColumn("drawdown", F.col("wealth") / F.when(F.col("peak") != 0, F.col("peak")) - 1).drop("__carry", PART)


def _block(decay: Column) -> Column:
    """Rows of a block, within which decay^rows stays above LEAST_WEIGHT."""
    fall = -F.log(F.when(decay > 0, decay))
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.coalesce(F.floor(F.lit(-math.log(LEAST_WEIGHT)) / F.when(fall > 0, fall)), F.lit(1)))).cast("long")


def _decayed(rows: DataFrame, by: list[str], most: float, exclusive: bool) -> DataFrame:
    """rows (by, __at, __x, __d) with __s, the sum of __x over the group's rows up to __at, each times __d to the power of its distance.

    In a block the sum is a running sum of x / d^place, times d^place. Blocks end in one decayed sum each; these are the rows of the next level, whose decay
    is that of a whole block. There are few levels, as the decay of a block is either under LEAST_WEIGHT or that of BLOCK_ROWS rows.
    """
    d, size = F.col("__d"), _block(F.col("__d"))
    rows = rows.withColumn("__size", size).withColumn("__block", F.floor(F.col("__at") / F.col("__size")).cast("long")).withColumn("__place", F.col("__at") - F.col("__block") * F.col("__size"))
    line = Window.partitionBy(*by, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    own = F.coalesce(F.pow(d, F.col("__place") - (1 if exclusive else 0)) * F.sum(F.col("__x") * F.pow(d, -F.col("__place"))).over(line), F.lit(0.0))
    ends = rows.groupBy(*by, "__block").agg(F.sum(F.col("__x") * F.pow(d, F.col("__size") - 1 - F.col("__place"))).alias("__x"), F.max(F.pow(d, F.col("__size"))).alias("__d"))
    fall = -math.log(most) if most > 0 else math.inf
    size_of_most = max(1, min(BLOCK_ROWS, math.floor(-math.log(LEAST_WEIGHT) / fall)))
    further = most**size_of_most
    if further <= FURTHER:  # LAGS blocks on, nothing is left of a value
        sums = ends.select(*by, "__x", "__d", F.col("__block").alias("__from"), F.explode(F.sequence(F.lit(0), F.lit(LAGS))).alias("__k"))
        sums = sums.groupBy(*by, (F.col("__from") + F.col("__k")).alias("__block")).agg(F.sum(F.col("__x") * F.pow("__d", "__k")).alias("__before"))
    else:
        ends = materialize(ends, "decayed")
        if ends.filter("__block > 0").isEmpty():
            return rows.withColumn("__s", own).drop("__size", "__block", "__place")
        sums = _decayed(ends.withColumnRenamed("__block", "__at"), by, further, False).select(*by, F.col("__at").alias("__block"), F.col("__s").alias("__before"))
    rows = rows.withColumn("__own", own)
    out = matched(rows, sums.select(*by, (F.col("__block") + 1).alias("__block"), "__before"), [*by, "__block"])
    carry = F.pow(d, F.col("__place") + (0 if exclusive else 1)) * F.coalesce("__before", F.lit(0.0))
    return out.withColumn("__s", F.col("__own") + carry).drop("__size", "__block", "__place", "__own", "__before")


def decayed_sum(rows: DataFrame, value: Column, decay: float | str, by: Sequence[str], *, name: str, position: str = "position", exclusive: bool = False) -> DataFrame:
    """Adds, for each row, the sum of value over its group's rows up to it, each times decay to the power of how many rows it lies before.

    This solves v -> decay * v + value without a task for each group. rows have positions from 0 without gaps in their group; decay, a number or a column that
    is the same for a whole group, is at least 0 and below 1. exclusive: over the rows before it, the last of which has weight 1 (0 for the first row).
    """
    if isinstance(decay, str):
        most = rows.agg(F.max(decay)).first()[0]  # one number
        most = 0.0 if most is None else float(most)
    else:
        most = float(decay)
    if not 0 <= most < 1:
        raise ValueError("a decay is at least 0 and below 1")
    made = rows.withColumns({"__at": F.col(position).cast("long"), "__x": value.cast("double"), "__d": F.col(decay) if isinstance(decay, str) else F.lit(most)})
    return _decayed(made, list(by), most, exclusive).withColumn(name, F.col("__s")).drop("__at", "__x", "__d", "__s")
