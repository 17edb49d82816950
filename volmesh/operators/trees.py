"""Regression trees grown from histograms, as tables of nodes: boosted trees, forests, and a ranker with lambda gradients.

Rows carry whole-number gradients, so their sums are the same in any order. A level of all trees of a round is one aggregation by tree, node,
feature and bin, whose size does not depend on the rows; the driver picks the splits from it. A model is a table of nodes, and a score is a walk over it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

#: Gradients are multiples of one over this.
SCALE = 1_000_000


@dataclass(frozen=True)
class Growth:
    """Levels, fewest rows of a leaf, what is added to a leaf's weight, share of a leaf's value that counts, bins of a feature."""

    depth: int = 3
    least: int = 20
    damping: float = 0.0
    rate: float = 1.0
    bins: int = 16


@dataclass(frozen=True)
class Node:
    """A node of a tree of one ensemble; the root is 1, the children of n are 2n and 2n + 1. Rows with feature > bound go to 2n + 1, others (nulls too) to 2n; a leaf has neither feature nor bound, but a value."""

    ensemble: int
    tree: int
    node: int
    feature: int | None
    bin: int | None
    bound: float | None
    value: float | None
    gain: float


def whole_number(x: Column) -> Column:
    return F.floor(x * SCALE + 0.5)


def many(rows: DataFrame) -> Column:
    """How many rows a row stands for."""
    return F.col("k") if "k" in rows.columns else F.lit(1)


def edges(rows: DataFrame, xs: list[str], bins: int) -> list[list[float]]:
    """Bounds between the bins of each feature: its quantiles over rows, bins - 1 numbers a feature."""
    long = rows.select(F.posexplode(F.array(*[F.col(x).cast("double") for x in xs])).alias("_f", "_x"))
    found = {r["_f"]: r for r in quantiles(long, ["_f"], "_x", [k / bins for k in range(1, bins)]).collect()}
    return [[float(found[f][f"q{k}"]) for k in range(bins - 1)] if f in found else [0.0] * (bins - 1) for f in range(len(xs))]


def binned(xs: list[str], bounds: list[list[float]]) -> Column:
    """The bin of each feature, as an array: how many bounds lie below it; a null is in the first."""
    return F.expr("array(" + ", ".join(" + ".join(f"cast(coalesce({x} > {b!r}D, false) as int)" for b in bs) for x, bs in zip(xs, bounds)) + ")")


def _descend(splits: dict[int, tuple[int, float]], cells: list[str], leaf: Callable[[int], str], node: int = 1) -> str:
    """One tree as nested conditions in SQL: every node stands in it once."""
    if node not in splits:
        return leaf(node)
    feature, bound = splits[node]
    return f"case when {cells[feature]} > {bound!r}D then {_descend(splits, cells, leaf, 2 * node + 1)} else {_descend(splits, cells, leaf, 2 * node)} end"


def _by_ensemble(ensemble: str, trees: dict[int, str], other: str) -> str:
    return f"case {' '.join(f'when {ensemble} = {e} then {t}' for e, t in sorted(trees.items()))} else {other} end" if trees else other


def _place(splits: dict[tuple[int, int], tuple[int, float]], cells: list[str]) -> str:
    """The number of the node where a row stands so far."""
    by: dict[int, dict] = {}
    for (e, n), s in splits.items():
        by.setdefault(e, {})[n] = s
    return _by_ensemble("e", {e: _descend(t, cells, str) for e, t in by.items()}, "1")


def _cells(bounds: list) -> list[str]:
    """A row's bins, in SQL."""
    return [f"_b[{i}]" for i in range(len(bounds))]


def grow(rows: DataFrame, growth: Growth, bounds: list[list[float]], tree: int) -> list[Node]:
    """The next tree of each ensemble, from rows (e, g, h, _b, and k: how many rows it stands for, else 1): whole gradients g and weights h, and bins. A split takes the highest gain (of equals the first feature, then bin)."""
    splits: dict[tuple[int, int], tuple[int, int, float]] = {}
    leaves: dict[tuple[int, int], float] = {}
    damping = growth.damping * SCALE
    value = lambda g, h: growth.rate * float(g) / (float(h) + damping)
    for level in range(growth.depth):
        at = rows.select("e", F.expr(_place({k: (f, b) for k, (f, b, _) in splits.items()}, _cells(bounds))).alias("n"), "g", "h", "_b", many(rows).alias("k")).where(F.col("n") >= 1 << level)
        cells = at.select("e", "n", "g", "h", "k", F.posexplode("_b").alias("f", "b")).groupBy("e", "n", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("k").alias("k"))
        by: dict[tuple[int, int], dict[int, list]] = {}
        for r in cells.collect():  # nodes x features x bins
            by.setdefault((r.e, r.n), {}).setdefault(r.f, []).append((r.b, r.g, r.h, r.k))
        for key, features in by.items():
            g, h, k = (sum(c[i] for c in features[0]) for i in (1, 2, 3))
            if level == 0:
                leaves[key] = value(g, h)
            best = None
            for f in sorted(features):
                lg = lh = lk = 0
                for b, cg, ch, ck in sorted(features[f])[:-1]:
                    lg, lh, lk = lg + cg, lh + ch, lk + ck
                    if lk < growth.least or k - lk < growth.least:
                        continue
                    gain = float(lg) * float(lg) / (float(lh) + damping) + float(g - lg) * float(g - lg) / (float(h - lh) + damping) - float(g) * float(g) / (float(h) + damping)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, value(lg, lh), value(g - lg, h - lh))
            if best:
                e, n = key
                splits[key] = best[1], best[2], best[0]
                del leaves[key]
                leaves[e, 2 * n], leaves[e, 2 * n + 1] = best[3:]
    inner = [Node(e, tree, n, f, b, bounds[f][b], None, gain) for (e, n), (f, b, gain) in splits.items()]
    return inner + [Node(e, tree, n, None, None, None, v, 0.0) for (e, n), v in leaves.items()]


def walk(nodes: list[Node], cells: list[str], ensemble: str = "0", on_bins: bool = False) -> Column:
    """The sum of the values of a row's leaves, tree after tree; cells are the features of a row, or its bins, in SQL. An ensemble without trees scores 0."""
    total = "0D"
    for tree in sorted({n.tree for n in nodes}):
        by: dict[int, tuple[dict, dict]] = {}
        for n in nodes:
            if n.tree == tree:
                splits, values = by.setdefault(n.ensemble, ({}, {}))
                if n.feature is None:
                    values[n.node] = n.value
                else:
                    splits[n.node] = n.feature, n.bin if on_bins else n.bound
        total = f"({total} + {_by_ensemble(ensemble, {e: _descend(s, cells, lambda n, v=v: repr(v[n]) + 'D') for e, (s, v) in by.items()}, '0D')})"
    return F.expr(total)


_NODES = "ensemble int, tree int, node int, feature int, bin int, bound double, value double, gain double"


def to_table(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    """The model as a table, to be written and read again."""
    return spark.createDataFrame([(n.ensemble, n.tree, n.node, n.feature, n.bin, n.bound, n.value, n.gain) for n in nodes], _NODES)


def from_table(table: DataFrame) -> list[Node]:
    return [Node(*r) for r in table.select(*[c.split()[0] for c in _NODES.split(", ")]).orderBy("ensemble", "tree", "node").collect()]


def gains(nodes: list[Node], xs: list[str]) -> dict[str, float]:
    """Share of each feature in the gain: of each ensemble's whole, then the mean over ensembles with a split."""
    sums: dict[int, list[float]] = {}
    for n in sorted((n for n in nodes if n.feature is not None), key=lambda n: (n.tree, n.node)):
        sums.setdefault(n.ensemble, [0.0] * len(xs))[n.feature] += n.gain
    return {x: sum(s[i] / sum(s) for s in sums.values()) / max(len(sums), 1) for i, x in enumerate(xs)}


def boost(rows: DataFrame, gradients: Callable[[DataFrame], DataFrame], rounds: int, growth: Growth, bounds: list[list[float]]) -> list[Node]:
    """Trees one after another on rows (e, _b, ...); gradients turns rows with their score s so far into rows with g and h."""
    nodes: list[Node] = []
    for r in range(rounds):
        scored = gradients(rows.withColumn("s", walk(nodes, _cells(bounds), "e", True))).select("e", "g", "h", "_b").persist()
        nodes += grow(scored, growth, bounds, r)
        scored.unpersist()
    return nodes


def squares(y: str) -> Callable[[DataFrame], DataFrame]:
    """Gradients of squared error."""
    return lambda rows: rows.withColumns({"g": whole_number(F.col(y) - F.col("s")), "h": F.lit(SCALE).cast("long")})


def regress(rows: DataFrame, xs: list[str], y: str, train: Column, rounds: int, growth: Growth, window: Column | None = None) -> tuple[list[Node], list[list[float]]]:
    """Boosted trees of squared error, learned where train holds and y is known; an ensemble for each value (whole number) of window."""
    known = rows.where(train & F.col(y).isNotNull())
    bounds = edges(known, xs, growth.bins)
    base = known.select((F.lit(0) if window is None else window).cast("int").alias("e"), binned(xs, bounds).alias("_b"), F.col(y).cast("double").alias("_y")).persist()
    nodes = boost(base, squares("_y"), rounds, growth, bounds)
    base.unpersist()
    return nodes, bounds


def forest(rows: DataFrame, xs: list[str], y: str, train: Column, key: Column, trees: int, growth: Growth) -> tuple[list[Node], list[list[float]]]:
    """Trees beside one another, all levels of all trees at once: tree t learns from about 632 rows of a thousand, as key (a whole number of a row) decides, and without every third feature. Each tree is an
    ensemble of one."""
    known = rows.where(train & F.col(y).isNotNull())
    bounds = edges(known, xs, growth.bins)
    tree = F.explode(F.filter(F.array(*[F.lit(t) for t in range(trees)]), lambda t: F.pmod(key * 7919 + t * 104729, F.lit(1000)) < 632)).alias("e")
    base = known.select("*", tree).select("e", whole_number(F.col(y).cast("double")).alias("g"), F.lit(SCALE).cast("long").alias("h"), F.transform(binned(xs, bounds), lambda b, i: F.when(F.pmod(i + F.col("e"), F.lit(3)) == 2, 0).otherwise(b)).alias("_b")).persist()
    nodes = grow(base, growth, bounds, 0)
    base.unpersist()
    return nodes, bounds


def forest_mean(nodes: list[Node], cells: list[str], trees: int) -> Column:
    return sum((walk([n for n in nodes if n.ensemble == t], cells, str(t)) for t in range(trees)), F.lit(0.0)) / trees


def lambdas(rows: DataFrame) -> DataFrame:
    """rows (e, day, name, skip, grade, s) with g and h of the pairs of each day's top score with its other candidates, and first, gain and ideal: pairs without the top don't change who is first,
    so a day has as many pairs as candidates. A row may stand for k candidates of one score, grade and skip (name is then their smallest), and has the sums of their gradients. Of equal scores a skip comes last, then the smaller name first. A pair weighs what swapping it would change in the first place's share of the day's best gain (2 ** grade - 1).
    """
    w = Window.partitionBy("e", "day")
    gain = lambda grade: F.pow(F.lit(2.0), grade) - 1
    top = F.max(F.struct("s", (-F.col("skip")).alias("skip"), (-F.col("name")).alias("name"), "grade")).over(w)
    rows = rows.withColumns({"_t": top, "ideal": F.max(gain(F.col("grade"))).over(w), "gain": gain(F.col("grade"))})
    rows = rows.withColumn("first", F.col("name") == -F.col("_t.name"))
    above = F.col("grade") > F.col("_t.grade")
    chance = 1 / (1 + F.exp(F.when(above, F.col("s") - F.col("_t.s")).otherwise(F.col("_t.s") - F.col("s"))))
    weight = F.when(F.col("first") | (F.col("grade") == F.col("_t.grade")), 0.0).otherwise(F.abs(F.col("gain") - gain(F.col("_t.grade"))) / F.col("ideal"))
    rows = rows.withColumns({"_g": F.when(above, 1).otherwise(-1) * whole_number(chance * weight), "_h": whole_number(chance * (1 - chance) * weight)})
    k = many(rows)  # pairs of the first with its equals weigh nothing
    return rows.withColumns({"g": F.when(F.col("first"), -F.sum(F.col("_g") * k).over(w)).otherwise(F.col("_g") * k), "h": F.when(F.col("first"), F.sum(F.col("_h") * k).over(w)).otherwise(F.col("_h") * k)}).drop("_t", "_g", "_h")


def rank_fit(rows: DataFrame, xs: list[str], rounds: int, patience: int, growth: Growth) -> tuple[list[Node], dict[int, int], list[list[float]]]:
    """(nodes of the best round, that round by window, bounds) of a ranker for each window e of rows (e, day, name, skip, grade, early, xs): it learns from the days that are not early, and is judged
    after each round by the mean share of the best gain in first place over its early days. A window's best round is the first with its highest share, before `patience` rounds went without a better one; all windows are grown together until the last one stops.

    Candidates of a day with the same bins, grade and skip have the same score in every round, so they are counted first and go on as one row: a day has no more rows than bins allow, however many candidates. Days lie sorted, so a round sorts nothing.
    """
    bounds = edges(rows.where("not early"), xs, growth.bins)
    base = rows.select("e", "day", "name", "skip", "grade", "early", binned(xs, bounds).alias("_b")).repartition("e", "day")
    base = base.groupBy("e", "day", "skip", "grade", "early", "_b").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("k")).sortWithinPartitions("e", "day").persist()
    nodes: list[Node] = []
    best: dict[int, tuple[int, int]] = {}  # window: (highest share, round)
    live = True
    for r in range(rounds + 1):
        scored = lambdas(base.withColumn("s", walk(nodes, _cells(bounds), "e", True))).persist()
        share = F.when(F.col("ideal") > 0, whole_number(F.col("gain") / F.col("ideal"))).otherwise(SCALE)
        judged = scored.where("early and first").groupBy("e").agg(F.sum(share).alias("s")).collect() if r else []  # a row a window
        for e, s in judged:
            if e not in best or (s > best[e][0] and r - best[e][1] < patience):
                best[e] = (s, r)
        live = not judged or any(r - best[e][1] < patience for e, _ in judged)
        if r < rounds and live:
            nodes += grow(scored.where("not early").select("e", "g", "h", "_b", "k"), growth, bounds, r)
        scored.unpersist()
        if not live:
            break
    base.unpersist()
    last = {e: r for e, (_, r) in best.items()}
    return [n for n in nodes if n.tree < last.get(n.ensemble, rounds)], last, bounds


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, top, top_skip, top_pnl, gap, best of rows (keys, name, skip, pred, pnl): each group's first candidate, its lead over the second (0 without one), and the best that is no skip."""
    order = F.struct("pred", (-F.col("skip")).alias("skip"), (-F.col("name")).alias("name"))
    w = Window.partitionBy(*keys).orderBy(F.desc("pred"), "skip", "name")
    # of candidates with one prediction and skip only the first by name can lead; they meet on the map side, and no group is sorted whole
    level = rows.groupBy(*keys, "pred", "skip").agg(F.min("name").alias("name"), F.min_by("pnl", "name").alias("pnl"), F.count(F.lit(1)).alias("_n"))
    first = F.max(F.when(F.col("_r") == 1, F.col("_n")))
    two = level.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy(*keys).agg(
        F.max_by(F.struct("name", "skip", "pnl"), order).alias("_t"), F.when((first == 1) & (F.count(F.lit(1)) > 1), F.max("pred") - F.min("pred")).otherwise(0.0).alias("gap"))
    best = level.where("skip = 0").groupBy(*keys).agg(F.max_by("name", order).alias("best"))
    return two.join(best, keys, "left").select(*keys, F.col("_t.name").alias("top"), F.col("_t.skip").alias("top_skip"), F.col("_t.pnl").alias("top_pnl"), "gap", "best")


def confidence_gate(days: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tau, days, traded, ratio of days (keys, top_skip, top_pnl, gap): of the thresholds 0 and the nine deciles of the gap, that with the highest ratio of mean to downside deviation (of equals the
    smallest) of the days' profit, where a day counts its pick's profit if it is no skip and leads by the threshold, else 0; an unknown profit is 0.

    A day goes to the highest threshold that it reaches; sums by threshold, added from the top, give all thresholds at once.
    """
    grid = quantiles(days, keys, "gap", [k / 10 for k in range(1, 10)])
    grid = grid.select(*keys, F.array(F.lit(0.0), *[F.col(f"q{i}") for i in range(9)]).alias("_grid"))
    x = F.when(F.col("top_skip") == 0, F.coalesce("top_pnl", F.lit(0.0))).otherwise(0.0)
    level = F.size(F.filter("_grid", lambda t: t <= F.col("gap"))) - 1
    sums = days.join(grid, keys).groupBy(*keys, level.alias("_l")).agg(F.any_value("_grid").alias("_grid"), F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_x"), F.sum(F.pow(F.least(x, F.lit(0.0)), 2)).alias("_d"), F.count(F.when(F.col("top_skip") == 0, 1)).alias("_k"))
    every = sums.groupBy(*keys).agg(F.any_value("_grid").alias("_grid"), F.sum("_n").alias("days"), F.collect_list(F.struct("_l", "_x", "_d", "_k")).alias("_s"))  # ten levels at most
    at = every.select(*keys, "days", "_s", F.posexplode("_grid").alias("_i", "tau"))
    over = lambda c: F.aggregate(F.array_sort(F.filter("_s", lambda s: s["_l"] >= F.col("_i"))), F.lit(0.0), lambda a, s: a + s[c])
    scored = at.select(*keys, "days", "tau", over("_k").cast("long").alias("traded"), ((over("_x") / F.col("days")) / (F.sqrt(over("_d") / F.col("days")) + 1e-8)).alias("_q"))
    scored = scored.withColumn("ratio", F.when(F.abs("_q") < 1000, F.round("_q", 9)).otherwise(F.round("_q", 0)))  # sums differ in their last digits by the order of their rows
    return scored.groupBy(*keys, "days").agg(F.max_by(F.struct("tau", "traded", "ratio"), F.struct(F.col("ratio"), -F.col("tau"))).alias("_b")).select(*keys, "_b.tau", "days", "_b.traded", "_b.ratio")
