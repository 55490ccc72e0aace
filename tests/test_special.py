"""Tails against exact sums, and rank-sum counts against enumeration."""

from decimal import Decimal, getcontext
from itertools import combinations
from math import comb

import numpy as np
import pytest

from riskframe.functions import special as sp
from riskframe.functions.splitting import log_binomial
from riskframe.operators import inference as inf


def tail_by_hand(x, n, p):
    getcontext().prec = 60
    p = Decimal(p)
    return float(sum(comb(n, k) * p**k * (1 - p)**(n - k) for k in range(x, n + 1)))


@pytest.mark.parametrize("x, n, p", [(3, 12, 0.17), (1, 5, 0.1), (12, 12, 0.17), (40, 100, 0.3), (70, 100, 0.3), (5, 100, 0.3),
                                     (900, 2500, 0.3), (760, 2500, 0.3), (749, 2500, 0.3), (600, 2500, 0.3), (1500, 2500, 0.3),
                                     (2, 2500, 0.0001), (30, 2500, 0.0001), (2499, 2500, 0.999)])
def test_binomial_tails_are_exact(x, n, p):
    assert sp.beta_i([x], [n - x + 1], [p])[0] == pytest.approx(tail_by_hand(x, n, p), rel=1e-10)


@pytest.mark.parametrize("away", [0, 1, -1, 4, 8, -3])
def test_binomial_tails_of_a_trillion(away):
    n, p = 10**12, 0.3
    sd = (n * p * (1 - p)) ** 0.5
    x = round(n * p + away * sd)
    total = sum(np.exp(log_binomial(np.arange(x + a, x + a + 500_000, dtype=float), n, p)).sum()
                for a in range(0, int((12 - min(away, 0)) * sd), 500_000))
    assert sp.beta_i([x], [n - x + 1], [p])[0] == pytest.approx(total, rel=1e-9)


def test_columns_of_edges(spark):
    df = spark.createDataFrame([(0, 5, 0.2), (6, 5, 0.2), (5, 5, 0.0), (5, 5, 1.0), (None, 5, 0.5), (2, 5, None)], "x int, n int, p double")
    got = [r.v for r in inf.binom_test_by(df, "x", "n", {"v": "p"}).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0, None, None]


def test_rank_sum_counts_are_those_of_all_orders(spark):
    for n0, n1 in ((1, 1), (3, 4), (5, 2)):
        want = np.zeros(n0 * n1 + 1)
        for own in combinations(range(1, n0 + n1 + 1), n0):
            want[sum(own) - n0 * (n0 + 1) // 2] += 1
        assert (sp.rank_sum_counts(n0, n1) == want).all()
    rows = [("a", 1.0, 0), ("a", 2.0, 0), ("a", 5.0, 0), ("a", 3.0, 1), ("a", 7.0, 1), ("a", 8.0, 1), ("a", 9.0, 1), ("a", None, 1),
            ("b", 1.0, 0), ("b", 1.0, 1), ("c", 1.0, 0)]
    df = spark.createDataFrame(rows, "k string, x double, g int")
    got = {r.k: r for r in inf.wilcoxon_exact_by(df, "x", "g", "k").collect()}
    assert got["a"].method == "exact" and got["a"].p_exact == pytest.approx(2 * 2 / comb(7, 3))
    assert got["b"].method == got["c"].method == "normal" and got["b"].p_exact is None
    assert inf.wilcoxon_exact_by(df.where("k = 'a'"), "x", "g").first().p_exact == got["a"].p_exact
