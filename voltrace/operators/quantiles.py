"""Exact quantiles of groups of any size, interpolated linearly between order statistics.

Groups of at most ``bound`` rows are finished in one aggregate. Larger ones are
narrowed first: a sketch with a bounded number of splitters brackets the two
order statistics that a quantile needs, an exact count says how many rows lie
below the bracket, and only the rows inside go on, until they are at most
``bound`` or all equal. So no task holds a group's values, and the result is
exact whatever the sketch's error: a bracket that misses its ranks is not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrace.operators.scan import matched
from voltrace.runtime import materialize

#: Rows of one group that a task may hold, and splitters of a sketch (its accuracy is ten times finer).
BOUND, STEPS, ROUNDS = 1 << 16, 512, 40
#: Below so many rows a bracket can't shrink any more.
LEAST_BOUND = 16


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = (), *, bound: int = BOUND) -> DataFrame:
    """(by..., q, n): the quantiles in the order of the probabilities, and the number of values. Nulls and NaN are no values.

    Without groups, an empty table gives one row (null, 0).
    """
    probs, keys = [float(p) for p in probabilities], list(by)
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie between 0 and 1")
    if bound < LEAST_BOUND:
        raise ValueError(f"bound is at least {LEAST_BOUND}")
    x = F.col(column).cast("double")
    rows = df.select(*keys, x.alias("__x")).filter(x.isNotNull() & ~F.isnan(x))
    q = F.percentile("__x", F.array(*map(F.lit, probs))).alias("q")
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound)
    large = materialize(large, "quantile-groups")
    if large.isEmpty():
        return rows.groupBy(*keys).agg(q, F.count("__x").alias("n"))
    found = _narrowed(rows, large, probs, keys, bound)
    if not keys:
        return found
    others = matched(rows, large.withColumn("__large", F.lit(True)), keys).filter("__large is null").groupBy(*keys).agg(q, F.count("__x").alias("n"))
    return found.unionByName(others)


def _narrowed(rows: DataFrame, large: DataFrame, probs: list[float], keys: list[str], bound: int) -> DataFrame:
    h = F.col("p") * (F.col("n") - 1)
    targets = large.select(*keys, "n", F.posexplode(F.array(*map(F.lit, probs))).alias("k", "p"))
    # rank: the lower order statistic's place among the rows of its cell, size: their number.
    targets = targets.select(*keys, "k", (h - F.floor(h)).alias("part"), F.floor(h).cast("long").alias("rank"), F.col("n").alias("size"))
    targets, cell, done = materialize(targets, "quantile-targets"), keys, None
    for _ in range(ROUNDS):
        steps = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
        here = matched(rows, targets.select(*cell).distinct().withColumn("__in", F.lit(True)), cell).filter("__in") if cell else rows
        sketch = here.groupBy(*cell).agg(F.percentile_approx("__x", steps, 10 * STEPS).alias("s"))
        # Splitters that lie two steps, twenty times the sketch's error, outside both order statistics.
        under, over = (F.floor(F.col("rank") / F.col("size") * STEPS) - 2).cast("int"), (F.ceil((F.col("rank") + 2) / F.col("size") * STEPS) + 2).cast("int")
        low = F.when(under >= 0, F.get("s", under)).otherwise(F.lit(float("-inf")))
        high = F.when(over <= STEPS, F.get("s", over)).otherwise(F.lit(float("inf")))
        open_ = (matched(targets, sketch, cell) if cell else targets.crossJoin(F.broadcast(sketch))).withColumns({"low": low, "high": high}).drop("s")  # without groups, one row
        open_ = materialize(open_, "quantile-brackets")
        inside = F.col("__x").between(F.col("low"), F.col("high"))
        met = matched(here, open_.select(*([c for c in cell]), *(c for c in ("k", "low", "high") if c not in cell)), cell, "inner") if cell else here.crossJoin(F.broadcast(open_.select("k", "low", "high")))  # a row for each probability
        counted = met.groupBy(*keys, "k").agg(F.count_if(F.col("__x") < F.col("low")).alias("below"), F.count_if(inside).alias("inside"), F.min(F.when(inside, F.col("__x"))).alias("least"), F.max(F.when(inside, F.col("__x"))).alias("most"))
        both = matched(open_, counted, [*keys, "k"])
        hit = (F.col("below") <= F.col("rank")) & (F.least(F.col("rank") + 2, F.col("size")) <= F.col("below") + F.col("inside"))
        both = both.withColumn("hit", hit).withColumns({"low": F.when(hit, F.col("low")).otherwise(F.lit(float("-inf"))), "high": F.when(hit, F.col("high")).otherwise(F.lit(float("inf")))})
        both = both.withColumns({"rank": F.when(hit, F.col("rank") - F.col("below")).otherwise(F.col("rank")), "size": F.when(hit, F.col("inside")).otherwise(F.col("size"))})
        both = materialize(both, "quantile-counted")
        equal = F.col("hit") & (F.col("least") == F.col("most"))
        few = ~equal & (F.col("size") <= bound)
        narrowed = both.select(*cell, *(c for c in ("k", "low", "high") if c not in cell), equal.alias("equal"))
        rows_in = matched(here, narrowed, cell, "inner") if cell else here.crossJoin(F.broadcast(narrowed))
        rows_in = materialize(rows_in.filter(inside & ~F.col("equal")).select(*keys, "k", "__x"), "quantile-rows")
        ties = both.filter(equal).select(*keys, "k", F.col("least").alias("value"))
        sorted_ = F.sort_array(F.collect_list("__x"))  # bound values at most
        small = matched(rows_in, both.filter(few).select(*keys, "k", "rank", "part"), [*keys, "k"], "inner").groupBy(*keys, "k", "rank", "part").agg(sorted_.alias("v"))
        lower, upper = F.get("v", F.col("rank").cast("int")), F.get("v", F.least(F.col("rank") + 1, F.size("v") - 1).cast("int"))
        ends = ties.unionByName(small.select(*keys, "k", (lower * (1 - F.col("part")) + upper * F.col("part")).alias("value")))
        done = ends if done is None else done.unionByName(ends)
        targets = materialize(both.filter(~equal & ~few).select(*keys, "k", "part", "rank", "size"), "quantile-targets")
        if targets.isEmpty():
            break
        rows, cell = rows_in, [*keys, "k"]
    else:
        raise RuntimeError(f"quantiles did not settle in {ROUNDS} rounds")
    q = F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda z: z["value"])
    out = done.groupBy(*keys).agg(q.alias("q"))
    return matched(out, large, keys) if keys else out.crossJoin(F.broadcast(large))  # one row each
