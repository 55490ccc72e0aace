"""The weakest-link sequence against all prunings of a small tree, and the choice among them."""

import itertools
import random

import pytest

from riskframe.operators import models as m, pruning as p


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(6)
    rows = []
    for i in range(240):
        a, b, c = draw.randrange(4) * 1.0, draw.randrange(3) * 1.0, draw.randrange(2) * 1.0
        rows.append((i, a, b, c, 3.0 * (a > 1) + 1.5 * (a > 1) * (b > 0) + draw.gauss(0, 0.5)))
    return rows, spark.createDataFrame([*rows, (999, 1.0, None, 0.0, 1.0)], "id int, a double, b double, c double, y double")


def all_prunings(node):
    """(error, leaves) of every tree with the same root."""
    out = [(node.error, 1)]
    if node.sides:
        out += [(e + f, i + j) for (e, i), (f, j) in itertools.product(*map(all_prunings, node.sides))]
    return out


def test_sequence_is_that_of_the_best_prunings(table):
    _, df = table
    rows = df.dropna()
    tree = p.with_sums(p.read_tree(m.fit_tree(rows, "y", ["a", "b", "c"], depth=3, min_split=10), ["a", "b", "c"]), rows, "y")
    links, every = p.weakest_links(tree), all_prunings(tree)
    assert tree.n == 240 and len(links) >= 3 and links[0][1] == 0 and links[-1][0] == 0.0
    bounds = [*[cost for cost, _, _, _ in links], 0.0]
    for (cost, splits, error, _), above in zip(links, [2 * bounds[0], *bounds]):
        middle = (cost + above) / 2  # between its own cost and that of the next smaller tree, it is the best
        assert error + middle * (splits + 1) == pytest.approx(min(e + middle * k for e, k in every))


def test_table_finds_the_real_splits(table):
    rows, df = table
    out = p.prune_table(df, "y", ["a", "b", "c"], "id", depth=4, min_split=10, k=5).collect()
    assert [r.rel_error for r in out] == sorted([r.rel_error for r in out], reverse=True) and out[0].rel_error == pytest.approx(1)
    assert sum(r.chosen for r in out) == 1 and next(r.splits for r in out if r.chosen) in (2, 3)
    assert out[0].xerror > 5 * next(r.xerror for r in out if r.chosen)
    flat = df.selectExpr("id", "a", "b", "c", "1.0D AS y")
    assert p.prune_table(flat, "y", ["a"], "id", k=2).count() == 0
