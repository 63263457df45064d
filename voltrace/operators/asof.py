"""As-of joins: each left row with the nearest right row of its key before or after it.

Both sides are dealt together by ranges of (key, time), so a key of any size is
spread over many tasks and no range join is needed. In a part, the nearest right
row comes from a running window; a part's first or last right row is carried to
the parts before or behind it, across parts that have none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.operators import scan


def asof_join(left: DataFrame, right: DataFrame, *, by: Sequence[str] = ("asset_id",), time: str = "timestamp", direction: str = "forward", strict: bool = True,
              how: str = "inner", matched_time: str = "matched_timestamp", tolerance: Column | None = None, suffix: str = "_right") -> DataFrame:
    """left's columns, matched_time and right's other columns (with the suffix where left has their name).

    direction: forward takes the right row with the smallest time after left's (strict) or not before it, backward the one with the largest time before it or not
    after it. Of right rows that tie in key and time, forward takes the smallest and backward the largest by their other columns in order. how: inner drops left
    rows without a match, left keeps them with nulls. tolerance: an interval; matches further away don't count. A null key or time matches nothing. Repeated left
    rows are matched each.
    """
    if direction not in ("forward", "backward") or how not in ("inner", "left"):
        raise ValueError("direction is forward or backward, how is inner or left")
    forward, keys = direction == "forward", list(by)
    others = [c for c in right.columns if c not in (*keys, time)]
    whole = F.lit(True)
    for c in (*keys, time):
        whole &= F.col(c).isNotNull()
    payload = F.struct(F.col(time).alias("time"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))
    rights = right.filter(whole).select(*keys, F.col(time).alias("__time"), payload.alias("__right"))
    lefts = left.select(*keys, F.col(time).alias("__time"), F.struct(*left.columns).alias("__left"))
    parts = scan.in_parts(lefts.unionByName(rights, allowMissingColumns=True), keys, ["__time"], "asof")
    is_left = F.col("__left").isNotNull()
    # A window ends at the row itself: right rows of the same time come first where they count, last where they don't.
    side = F.when(is_left == strict, 0).otherwise(1)
    order = [F.desc("__time"), side, F.desc("__right")] if forward else [F.asc("__time"), side, F.asc("__right")]
    rows = scan.carried(parts, keys, F.min("__right") if forward else F.max("__right"), lambda x: F.last(x, ignorenulls=True), after=forward)
    near = F.coalesce(F.last("__right", ignorenulls=True).over(scan.within(keys, order)), F.col("__carry"))
    found = rows.withColumn("__near", F.when(whole_left(keys), near)).filter(is_left).select("__left.*", "__near")
    if tolerance is not None:
        gap_ok = F.col("__near.time") <= F.col(time) + tolerance if forward else F.col("__near.time") >= F.col(time) - tolerance
        found = found.withColumn("__near", F.when(gap_ok, F.col("__near")))
    if how == "inner":
        found = found.filter(F.col("__near").isNotNull())
    names = [c + suffix if c in left.columns or c == matched_time else c for c in others]
    return found.select(*left.columns, F.col("__near.time").alias(matched_time), *(F.col(f"__near.c{i}").alias(n) for i, n in enumerate(names)))


def whole_left(keys: Sequence[str]) -> Column:
    out = F.col("__time").isNotNull()
    for k in keys:
        out &= F.col(k).isNotNull()
    return out


def next_returns(weights: DataFrame, returns: DataFrame, *, by: Sequence[str] = ("asset_id",), weight: str = "target_weight") -> DataFrame:
    """(timestamp, asset_id, weight, return): each weight with the first strictly later return of its asset, at that return's time. Weights without one go."""
    made = asof_join(weights.select(*by, "timestamp", F.col(weight).alias("weight")), returns.select(*by, "timestamp", "return"), by=by)
    return made.select(F.col("matched_timestamp").alias("timestamp"), *by, "weight", "return")
