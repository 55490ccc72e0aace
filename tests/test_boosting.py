"""Boosted trees against a plain recursive fit over all rows."""

import math
import random

import numpy as np
import pytest

from riskframe.operators import boosting as b

NAMES = ["x", "z", "w"]


def best(rows, g, h, setting):
    """The best split of rows (dicts), tried feature by feature and value by value."""
    whole, size = sum(g), sum(h)
    found = None
    for f in NAMES:
        known = sorted({r[f] for r in rows if r[f] is not None})
        missing = [i for i, r in enumerate(rows) if r[f] is None]
        for lo, hi in zip(known, known[1:]):
            for missing_left in (True, False) if missing else (True,):
                left = [i for i, r in enumerate(rows) if (missing_left if r[f] is None else r[f] < (lo + hi) / 2)]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl < setting.min_child or size - hl < setting.min_child:
                    continue
                gain = gl**2 / (hl + setting.reg) + (whole - gl)**2 / (size - hl + setting.reg) - whole**2 / (size + setting.reg)
                if gain > (found[0] + 1e-9 if found else 1e-6):
                    found = (gain, f, (lo + hi) / 2, missing_left, left)
    return found


def grow(rows, g, h, setting, level=0):
    split = best(rows, g, h, setting) if level < setting.depth else None
    leaf = {"value": -setting.step * sum(g) / (sum(h) + setting.reg)}
    if not split:
        return leaf
    gain, f, at, missing_left, left = split
    right = [i for i in range(len(rows)) if i not in set(left)]
    sides = [grow([rows[i] for i in s], [g[i] for i in s], [h[i] for i in s], setting, level + 1) for s in (left, right)]
    if gain < setting.gamma and all("value" in s for s in sides):
        return leaf
    return {"f": f, "at": at, "missing_left": missing_left, "sides": sides}


def value(tree, row):
    while "value" not in tree:
        v = row[tree["f"]]
        tree = tree["sides"][0 if (tree["missing_left"] if v is None else v < tree["at"]) else 1]
    return tree["value"]


def by_hand(rows, setting, rounds):
    total = [0.0] * len(rows)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in total]
        tree = grow(rows, [q - r["y"] for q, r in zip(p, rows)], [q * (1 - q) for q in p], setting)
        total = [m + value(tree, r) for m, r in zip(total, rows)]
    return [1 / (1 + math.exp(-m)) for m in total]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = []
    for i in range(240):
        x, z, w = draw.randrange(9) * 1.0, draw.choice([None, 0.0, 1.0, 2.0]), draw.randrange(4) / 4
        chance = 0.15 + 0.5 * (x > 4) + 0.25 * (z == 1.0) - 0.1 * (z is None)
        out.append({"id": i, "x": x, "z": z, "w": w, "y": int(draw.random() < chance)})
    return out


def table(spark, rows, extra=()):
    some = [(r["id"], r["x"], r["z"], r["w"], r["y"]) for r in rows] + list(extra)
    return spark.createDataFrame(some, "id int, x double, z double, w double, y int")


@pytest.mark.parametrize("setting, rounds", [
    (b.Setting(depth=1), 1), (b.Setting(step=0.3, depth=3), 3), (b.Setting(step=0.3, depth=4, gamma=3.0), 3),
    (b.Setting(step=0.5, depth=3, min_child=5.0, reg=0.5), 2)])
def test_trees_match_a_plain_fit(spark, rows, setting, rounds):
    df = table(spark, rows, [(900, 1.0, 1.0, 0.0, None)])
    model = b.fit_boosted(df, NAMES, "y", setting, rounds)
    got = {r.id: r.risk for r in model.score(df).collect()}
    assert [got[r["id"]] for r in rows] == pytest.approx(by_hand(rows, setting, rounds), abs=1e-5)
    assert len(got) == len(rows) + 1


def test_margins_are_written_between_rounds(spark, rows, monkeypatch):
    monkeypatch.setattr(b, "KEEP", 2)
    setting = b.Setting(step=0.3, depth=2)
    model = b.fit_boosted(table(spark, rows), NAMES, "y", setting, 5)
    got = {r.id: r.risk for r in model.score(table(spark, rows)).collect()}
    assert [got[r["id"]] for r in rows] == pytest.approx(by_hand(rows, setting, 5), abs=1e-5)


def test_no_pass_walks_the_trees_of_earlier_rounds(spark, rows, monkeypatch):
    behind, pass_ = [], b._pass
    monkeypatch.setattr(b, "_pass", lambda cells, fits, *a, **k: behind.extend(len(f.trees) - f.kept for f in fits.values())
                        or pass_(cells, fits, *a, **k))
    b.fit_boosted(table(spark, rows), NAMES, "y", b.Setting(step=0.3, depth=2), 4)
    assert behind and not any(behind)


def test_large_penalty_leaves_no_split(spark, rows):
    model = b.fit_boosted(table(spark, rows), NAMES, "y", b.Setting(gamma=1e6), 2)
    assert [len(t.nodes()) for t in model.trees] == [1, 1]


def test_held_out_rows_stop_the_fit_and_do_not_teach(spark, rows):
    df = table(spark, rows).selectExpr("*", "int(id % 3 = 0) AS held")
    model = b.fit_boosted(df, NAMES, "y", b.Setting(step=0.3, depth=3), 40, held="held")
    assert 1 <= len(model.trees) < 40
    taught = [r for r in rows if r["id"] % 3]
    want = by_hand(taught, b.Setting(step=0.3, depth=3), len(model.trees))
    got = {r.id: r.risk for r in model.score(df).collect()}
    assert [got[r["id"]] for r in taught] == pytest.approx(want, abs=1e-5)
    held = [(got[r["id"]], r["y"]) for r in rows if not r["id"] % 3]
    pairs = [(p > n) + (p == n) / 2 for p, y in held for n, o in held if y and not o]
    assert model.best_auc == pytest.approx(np.mean(pairs), abs=0.01)


def test_folds_and_saved_model(spark, rows, tmp_path):
    df = table(spark, rows)
    out = b.cv_boosted(df, NAMES, "y", "id", b.setting_grid(step=(0.1, 0.3), depth=(1, 3)), rounds=4, k=3, patience=2).collect()
    assert {r.setting for r in out} == {1, 2, 3, 4} and all(0.4 < r.auc <= 1 for r in out)
    assert all(sum(r.best for r in out if r.setting == s) == 1 for s in range(1, 5))
    model = b.fit_boosted(df, NAMES, "y", rounds=2)
    model.save(spark, str(tmp_path / "m"))
    assert b.load_boosted(spark, str(tmp_path / "m")) == model
    assert sum(r.importance for r in model.importance(spark).collect()) == pytest.approx(1)


def test_many_values_are_binned_by_quantiles(spark):
    df = spark.range(2000).selectExpr("id", "cast(id as double) as x", "cast(id > 900 as int) as y")
    cuts = b.feature_cuts(df, ["x"], bins=16)
    assert 8 <= len(cuts[0]) <= 15
    assert b.fit_boosted(df, ["x"], "y", rounds=3, bins=16).score(df).where("(risk > 0.5) <> (y = 1)").count() < 130


@pytest.mark.parametrize("patience", [2, None])
def test_settings_grown_in_tasks_equal_those_of_shared_passes(spark, rows, monkeypatch, patience):
    df = table(spark, rows)
    grid = [b.Setting(0.3, d, g, c) for d in (0, 1, 4) for g in (0.0, 1.0, 4.0) for c in (1.0, 3.0)]
    passes, pass_ = [], b._pass
    monkeypatch.setattr(b, "_pass", lambda *a, **k: passes.append(1) or pass_(*a, **k))
    apart = b.cv_boosted(df, NAMES, "y", "id", grid, rounds=6, k=3, patience=patience).collect()
    assert not passes
    monkeypatch.setattr(b, "LOCAL_BYTES", 0)
    shared = b.cv_boosted(df, NAMES, "y", "id", grid, rounds=6, k=3, patience=patience).collect()
    assert passes and apart == shared and len({round(r.auc, 6) for r in apart}) > 10
