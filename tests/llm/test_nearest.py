"""Nearest neighbours against brute force: exact where the forest is one leaf, by recall where it is not."""

import numpy as np
import pytest

from riskframe.llm import nearest, queries
from riskframe.llm.nearest import nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, score double, rank int"


def by_hand(rows, asked, top=10):
    good = {}
    for key, v in rows:
        if key is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.setdefault(key, []).append(np.array(v))
    out = []
    for q in sorted(asked):
        if q in good:
            own = good[q][0]
            far = sorted((min(np.sqrt(((own - v) ** 2).sum()) for v in vs if len(v) == len(own)), key)
                         for key, vs in good.items() if key != q and any(len(v) == len(own) for v in vs))
            out += [(q, r, key, float(s)) for r, (s, key) in enumerate(far[:top], 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, v, 1.0, 1) for k, v in rows], SCHEMA)


def run(spark, rows, asked, **more):
    df = table(spark, rows).repartition(3)
    got = nearest_neighbours(df, df.where(df.vec_id.isin(asked)), **more)
    return sorted(tuple(r) for r in got.collect())


def agree(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(2)
    out = [(i, draw.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)]
    out += [(1000 + i, out[7][1]) for i in range(40)] + [(500, out[9][1])] * 3
    out += [(600, None), (601, []), (602, [0.0] * 5), (603, [float("nan")] + [1.0] * 4), (604, [float("inf")] * 5),
            (605, [None] + [1.0] * 4), (None, [1.0] * 5), (606, [1.0, 2.0]), (607, [1.0, 2.5]), (608, [1e300] * 5),
            (609, [1e-300] * 5), (610, [-0.0, 1.0, 0.0, 0.0, 0.0]), (611, [0.0, 1.0, -0.0, 0.0, 0.0])]
    return out


def test_one_leaf_is_exact(spark, rows):
    asked = [0, 7, 9, 100, 500, 600, 602, 603, 605, 606, 608, 609, 610, 1000, 1039]
    with np.errstate(over="ignore"):
        agree(run(spark, rows, asked, leaf=10**6), by_hand(rows, asked))


def test_all_leaves_open_is_exact_in_small_packs(spark, rows, monkeypatch):
    monkeypatch.setattr(nearest, "PACK_ROWS", 16)
    monkeypatch.setattr(nearest, "PACK_QUERIES", 2)
    monkeypatch.setattr(nearest.Forest, "_budget", lambda self, draw, top, target: float("inf"))
    asked = [0, 7, 100, 500, 606, 610, 1000]
    agree(run(spark, rows, asked, leaf=8, top=3), by_hand(rows, asked, 3))


@pytest.mark.parametrize("spread", [1.0, 0.2])
def test_recall(spark, spread):
    draw = np.random.default_rng(4)
    middle = draw.standard_normal((30, 24))
    rows = [(i, (middle[i % 30] + spread * draw.standard_normal(24)).tolist()) for i in range(6000)]
    asked = list(range(0, 6000, 100))
    got, want = run(spark, rows, asked, sample=2000), by_hand(rows, asked)
    assert len(got) == len(want) and [r[1] for r in got] == [r[1] for r in want]
    assert len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.9 * len(want)


def test_empty_and_registered_query(spark, rows):
    df = table(spark, rows)
    assert nearest_neighbours(df.limit(0), df).count() == 0 and nearest_neighbours(df, df.limit(0)).count() == 0
    import duckdb
    folder = "/root/testdata/sf0.001"
    all_rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    asked = [k for k, _ in all_rows if k % 100 == 0]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_nearest"](spark, folder).collect())
    want = by_hand([(k, list(map(float, v))) for k, v in all_rows], asked)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert len({r[:1] + r[2:3] for r in got} & {r[:1] + r[2:3] for r in want}) >= 0.9 * len(want)
