"""Gradient-boosted regression trees over a whole table, by histograms that Spark sums.

Features are cut into bins at exact quantiles of the table. A level of a tree is
one aggregate: sums of gradients by (node, feature, bin), combined within tasks
first, so what reaches the driver is at most nodes x features x bins rows
whatever the input; the driver picks the splits of the level from it. Rows with
their bins and current forecasts are written once for each tree. Squared error
with second-order gains, L1 and L2 penalties, and seeded draws of rows (by a hash
of their key) and of features for each tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrace.operators.kernels import boost
from voltrace.operators.quantiles import exact_quantiles
from voltrace.runtime import materialize

BINS = 64


@dataclass
class _Node:
    gradient: float
    rows: int
    depth: int
    feature: int = -1
    cut: int = 0  # rows whose bin is below it go left
    left: _Node | None = None
    right: _Node | None = None
    id: int = 0

    def leaves(self) -> list[_Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def routed(self, value) -> Column:
        """An expression over the column bins: value of the leaf that a row falls into."""
        if self.left is None:
            return F.lit(value(self))
        return F.when(F.col("bins")[self.feature] < self.cut, self.left.routed(value)).otherwise(self.right.routed(value))


@dataclass
class HistogramTrees:
    """A fitted model: where features are cut, and trees as in kernels.boost, whose thresholds are these cuts."""

    features: tuple[str, ...]
    edges: list[list[float]]
    booster: boost.Booster = field(repr=False)

    def predict(self, df: DataFrame, *, name: str = "forecast", least: float | None = 0.0) -> DataFrame:
        """df with a forecast, not below least; null where a feature is null or not finite."""
        features, booster = list(self.features), self.booster

        def run(batches):
            for pdf in batches:
                x = pdf[features].to_numpy(dtype=float)
                ok = np.isfinite(x).all(axis=1)
                out = np.full(len(pdf), np.nan)
                out[ok] = booster.predict(x[ok])
                pdf[name] = pd.Series(out if least is None else np.maximum(out, least), index=pdf.index)
                yield pdf

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{kinds}, `{name}` double")

    def importance(self) -> list[tuple[str, float]]:
        """Shares of the gain, largest first."""
        return sorted(zip(self.features, map(float, self.booster.importance()), strict=True), key=lambda x: (-x[1], x[0]))


def _bins(x: Column, edges: list[float]) -> Column:
    """How many edges are at or below x."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)) if edges else F.lit(0)


def _split(histogram: dict[tuple[int, int], tuple[float, int]], node: _Node, features: list[int], edges: list[list[float]], config: boost.Config) -> float:
    """Splits the node in place if that gains enough; the gain, or 0."""
    best = (2 * config.gamma + 1e-12, None)
    own = boost.score(node.gradient, node.rows, config)
    for f in features:
        g, n = 0.0, 0
        for cut in range(1, len(edges[f]) + 1):
            more_g, more_n = histogram.get((f, cut - 1), (0.0, 0))
            g, n = g + more_g, n + more_n
            if not more_n or n < config.min_child_weight or node.rows - n < config.min_child_weight or n == node.rows:
                continue
            gain = boost.score(g, n, config) + boost.score(node.gradient - g, node.rows - n, config) - own
            if gain > best[0]:
                best = (gain, (f, cut, g, n))
    if best[1] is None:
        return 0.0
    node.feature, node.cut, g, n = best[1]
    node.left, node.right = _Node(g, n, node.depth + 1), _Node(node.gradient - g, node.rows - n, node.depth + 1)
    return best[0]


def _arrays(root: _Node, edges: list[list[float]], config: boost.Config) -> tuple[np.ndarray, ...]:
    """The tree in the form of kernels.boost."""
    order, rows = [root], []
    for node in order:
        if node.left is not None:
            order += [node.left, node.right]
    at = {id(n): k for k, n in enumerate(order)}
    for n in order:
        inner = n.left is not None
        rows.append((n.feature if inner else -1, edges[n.feature][n.cut - 1] if inner else 0.0, at[id(n.left)] if inner else 0, at[id(n.right)] if inner else 0, boost.leaf(n.gradient, n.rows, config)))
    return tuple(np.array(c) for c in zip(*rows, strict=True))


def fit(df: DataFrame, features: list[str], target: str = "target", *, key: tuple[str, ...] = ("timestamp", "asset_id"), config: boost.Config = boost.Config(), bins: int = BINS) -> HistogramTrees:
    """Fits on the rows whose features and target are finite. key tells rows apart for the draws; rows that share one are drawn together."""
    whole = F.lit(True)
    for c in (*features, target):
        whole &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = df.filter(F.coalesce(whole, F.lit(False))).select(*key, *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(target).cast("double").alias("y"))
    edges = []
    for i in range(len(features)):
        q = exact_quantiles(rows, f"x{i}", [k / bins for k in range(1, bins)]).first()
        edges.append(sorted(set(q.q)) if q is not None and q.q is not None else [])
    about = rows.agg(F.avg("y").alias("base"), F.count(F.lit(1)).alias("n")).first()
    if not about.n:
        raise ValueError("no row with finite features and target")
    draw = F.pmod(F.xxhash64(F.lit(config.random_state), *key), F.lit(1 << 30)).alias("draw")
    state = materialize(rows.select(draw, F.array(*(_bins(F.col(f"x{i}"), edges[i]) for i in range(len(features)))).alias("bins"), "y", F.lit(about.base).alias("f")), "trees-rows")
    rng, gains = np.random.default_rng(config.random_state), np.zeros(len(features))
    booster = boost.Booster(config, float(about.base), gains=gains)
    for t in range(config.n_estimators):
        chosen = sorted(rng.permutation(len(features))[:boost.drawn(config.colsample_bytree, len(features))].tolist())
        part = F.pmod(F.xxhash64(F.lit(t), "draw"), F.lit(1 << 30)) < F.lit(int(config.subsample * (1 << 30)))
        now = state.filter(part).select("bins", (F.col("f") - F.col("y")).alias("g"))
        root, level = None, [None]
        for depth in range(config.max_depth):
            open_ = [n for n in (root.leaves() if root else []) if n.depth == depth and n.rows >= 2 * config.min_child_weight]
            if root is not None and not open_:
                break
            for k, n in enumerate(root.leaves() if root else []):
                n.id = k if n in open_ else -1
            node = root.routed(lambda n: n.id) if root else F.lit(0)
            sums = now.select(node.alias("node"), "g", F.posexplode("bins").alias("feature", "bin")).filter("node >= 0").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).collect()
            level = {}
            for r in sums:
                level.setdefault(r.node, {})[r.feature, r.bin] = (r.g, r.n)
            if root is None:
                first = [v for (f, _), v in level.get(0, {}).items() if f == 0]
                root = _Node(sum(g for g, _ in first), sum(n for _, n in first), 0)
                open_ = [root]
            for n in open_:
                gain = _split(level.get(n.id, {}), n, chosen, edges, config)
                gains[n.feature if n.left is not None else 0] += gain
        if root is None:  # no depth: a constant
            total = now.agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).first()
            root = _Node(total.g or 0.0, total.n, 0)
        booster.trees.append(_arrays(root, edges, config))
        if t + 1 < config.n_estimators:
            state = materialize(state.select("draw", "bins", "y", (F.col("f") + root.routed(lambda n: boost.leaf(n.gradient, n.rows, config))).alias("f")), "trees-rows")
    return HistogramTrees(tuple(features), edges, booster)
