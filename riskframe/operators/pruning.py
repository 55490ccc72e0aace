"""Cost-complexity pruning of a fitted regression tree, with the cost chosen by cross-validation.

A tree is pruned from sums per leaf: one pass over the rows gives them, and the weakest-link sequence follows on the
driver, where a tree has at most 2^depth leaves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import complete
from ..lineage import cut
from .models import fit_tree, last_stage


@dataclass
class Node:
    """A node of a tree with the number, sum and sum of squares of its rows; leaves have no feature."""

    number: int
    feature: str | None = None
    at: float | None = None
    sides: tuple[Node, Node] | None = None
    n: float = 0.0
    s: float = 0.0
    q: float = 0.0

    @property
    def error(self) -> float:
        return max(self.q - self.s * self.s / self.n, 0.0) if self.n else 0.0

    def inner(self) -> list[Node]:
        return [] if self.sides is None else [self, *self.sides[0].inner(), *self.sides[1].inner()]

    def leaves(self) -> list[Node]:
        return [self] if self.sides is None else [*self.sides[0].leaves(), *self.sides[1].leaves()]


def read_tree(model: Model, names: Sequence[str]) -> Node:
    """The nodes of a fitted regression tree, numbered in the order of its text."""
    lines = [line.strip() for line in last_stage(model).toDebugString.splitlines()[1:] if line.strip()]
    at = 0

    def read() -> Node:
        nonlocal at
        node, line = Node(at), lines[at]
        at += 1
        found = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        if found:
            node.feature, node.at = names[int(found[1])], float(found[2])
            low = read()
            at += 1  # the line of the other side
            node.sides = (low, read())
        elif not line.startswith("Predict:"):
            raise ValueError(f"not a split of a number: {line}")
        return node
    return read()


def leaf_of(node: Node) -> Column:
    """The number of the leaf that a row falls into."""
    if node.sides is None:
        return F.lit(node.number)
    return F.when(F.col(f"`{node.feature}`") <= node.at, leaf_of(node.sides[0])).otherwise(leaf_of(node.sides[1]))


def with_sums(tree: Node, rows: DataFrame, y: str) -> Node:
    """The tree with the sums of complete rows in every node."""
    v = F.col(f"`{y}`").cast("double")
    found = {r.leaf: r for r in rows.groupBy(leaf_of(tree).alias("leaf")).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).collect()}

    def fill(node: Node) -> None:
        if node.sides is None:
            r = found.get(node.number)
            node.n, node.s, node.q = (float(r.n), r.s, r.q) if r else (0.0, 0.0, 0.0)
            return
        for side in node.sides:
            fill(side)
        node.n, node.s, node.q = (sum(getattr(c, k) for c in node.sides) for k in ("n", "s", "q"))
    fill(tree)
    return tree


def weakest_links(tree: Node) -> list[tuple[float, int, float, set[int]]]:
    """(cost, splits, error, nodes made leaves) of the nested trees, the root alone first.

    The cost of a subtree is the rise in squared error for each leaf that pruning it saves; a tree is best for costs
    from its own up to that of the next smaller one.
    """
    closed: set[int] = set()

    def below(node: Node) -> tuple[float, int]:
        if node.sides is None or node.number in closed:
            return node.error, 1
        (a, i), (b, j) = map(below, node.sides)
        return a + b, i + j

    def open_nodes(node: Node) -> list[Node]:
        return [] if node.sides is None or node.number in closed else [node, *open_nodes(node.sides[0]), *open_nodes(node.sides[1])]

    out, cost = [], 0.0
    while True:
        error, leaves = below(tree)
        out.append((cost, leaves - 1, error, set(closed)))
        links = [((node.error - e) / (k - 1), node) for node in open_nodes(tree) for e, k in [below(node)]]
        if not links:
            return out[::-1]
        least = min(g for g, _ in links)
        cost = max(cost, least)
        closed |= {node.number for g, node in links if g <= least + 1e-12 * abs(least)}


def predicted(node: Node, closed: set[int]) -> Column:
    """The mean of the leaf a row falls into, nodes in `closed` taken for leaves."""
    if node.sides is None or node.number in closed:
        return F.lit(node.s / node.n if node.n else 0.0)
    return F.when(F.col(f"`{node.feature}`") <= node.at, predicted(node.sides[0], closed)).otherwise(
        predicted(node.sides[1], closed))


def prune_table(df: DataFrame, y: str, x: Sequence[str], key: str, depth: int = 5, min_split: int = 20, k: int = 10,
                seed: int = 1) -> DataFrame:
    """(cp, splits, rel_error, xerror, xstd, chosen): the nested prunings of a tree, smallest first.

    cp is the cost up to which a tree is the best, as a share of the root's error, and rel_error its error as such a
    share. xerror is the error over k held-out folds (by a hash of `key`), each scored by the tree of the other folds
    pruned at the geometric middle of the cost range, and xstd its standard error. `chosen` marks the smallest tree
    within one standard error of the best. Rows with a missing y or x are left out; a root without error gives no rows.
    """
    rows = cut(complete(df.select(key, y, *x), [y, *x]))
    whole = with_sums(read_tree(fit_tree(rows, y, x, "regression", depth, min_split, seed=seed), x), rows, y)
    links = weakest_links(whole)
    schema = "cp double, splits int, rel_error double, xerror double, xstd double, chosen boolean"
    if not whole.error:
        return df.sparkSession.createDataFrame([], schema)
    root = whole.error
    floors = [c for c, _, _, _ in links]  # falling costs, the last 0
    middles = [math.inf] + [math.sqrt(a * b) for a, b in zip(floors, floors[1:])]
    folds = rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))
    v = F.col(f"`{y}`").cast("double")
    totals = [[0.0, 0.0] for _ in links]
    for i in range(k):
        taught, held = folds.where(F.col("_fold") != i), folds.where(F.col("_fold") == i)
        tree = with_sums(read_tree(fit_tree(taught, y, x, "regression", depth, min_split, seed=seed), x), taught, y)
        own = weakest_links(tree)
        misses = []
        for middle in middles:
            closed = next((c for cost, _, _, c in own if cost <= middle), own[-1][3])
            misses.append((v - predicted(tree, closed)) ** 2)
        sums = held.agg(*[F.sum(m).alias(f"a{j}") for j, m in enumerate(misses)],
                        *[F.sum(m * m).alias(f"b{j}") for j, m in enumerate(misses)]).first()
        for j, total in enumerate(totals):
            total[0] += sums[f"a{j}"] or 0.0
            total[1] += sums[f"b{j}"] or 0.0
    table = [[cost, splits, error / root, a / root, math.sqrt(max(b - a * a / whole.n, 0.0)) / root]
             for (cost, splits, error, _), (a, b) in zip(links, totals)]
    best = min(table, key=lambda r: (r[3], r[1]))
    small = next(j for j, r in enumerate(table) if r[3] <= best[3] + best[4])
    return df.sparkSession.createDataFrame([(r[0] / root, *r[1:], j == small) for j, r in enumerate(table)], schema)
