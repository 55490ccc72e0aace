"""Second-order boosted trees for a 0/1 outcome, fitted by distributed histograms.

Values are binned once and equal rows become one cell with its cases and outcomes, so every pass is over cells. For
each open node the tasks sum gradients and curvatures by feature and bin; the sums of a node meet in one task, which
finds its best split, so only splits reach the driver. Many models (settings, folds) share each pass. A search over
settings whose cells are few enough sends them to every task instead, which grows all rounds of its settings alone.

A split of a node into sides with sums G and H gains GL^2/(HL + reg) + GR^2/(HR + reg) - G^2/(H + reg). Trees grow to
`depth` and are then pruned from the leaves up wherever both children are leaves and the gain is below `gamma`. A
leaf's value is -step G/(H + reg). Rows without a value of the split feature go to the side that gains more.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.growing import best_of, grow
from ..lineage import Tables, cut, spread
from .features import assign_folds

# Ship these helpers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256
UNIT = float(2**24)  # sums are of whole units, so they are the same for any partitioning
STEPS = 4096  # resolution of a predicted probability in the held-out AUC
LOCAL_BYTES = 64 * 2**20  # cells up to this size are sent to all tasks of a search
KEEP = 1  # rounds between two written margins; trees of other rounds are walked again in every pass
_LEAST_GAIN = 1e-6


@dataclass
class Setting:
    """How one model is fitted."""

    step: float = 0.1
    depth: int = 6
    gamma: float = 0.0
    min_child: float = 1.0
    reg: float = 1.0


@dataclass
class Tree:
    """Nodes in order of creation, the root first; feature -1 marks a leaf. Bins up to `at` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    g: list[float] = field(default_factory=lambda: [0.0])
    h: list[float] = field(default_factory=lambda: [0.0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing_left: bool, gain: float, gl: float, hl: float) -> list[int]:
        self.feature[node], self.at[node], self.missing_left[node], self.gain[node] = feature, at, missing_left, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for g, h in ((gl, hl), (self.g[node] - gl, self.h[node] - hl)):
            for name, x in (("feature", -1), ("at", 0), ("missing_left", True), ("left", -1), ("right", -1),
                            ("gain", 0.0), ("g", g), ("h", h), ("value", 0.0)):
                getattr(self, name).append(x)
        return [self.left[node], self.right[node]]

    def finish(self, setting: Setting) -> None:
        """Prune, then give the leaves their values. Children come after their parents."""
        for node in reversed(range(len(self.feature))):
            if self.feature[node] >= 0 and self.gain[node] < setting.gamma and all(
                    self.feature[c] < 0 for c in (self.left[node], self.right[node])):
                self.feature[node], self.left[node], self.right[node], self.gain[node] = -1, -1, -1, 0.0
        self.value = [-setting.step * g / (h + setting.reg) if f < 0 else 0.0
                      for f, g, h in zip(self.feature, self.g, self.h)]

    def nodes(self) -> list[int]:
        """The nodes left after pruning, the root first."""
        out = [0]
        for node in out:
            if self.feature[node] >= 0:
                out += [self.left[node], self.right[node]]
        return out

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins; bin 0 is a missing value."""
        feature, at, missing = np.array(self.feature), np.array(self.at), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(bins), np.int64)
        inside = np.flatnonzero(feature[node] >= 0)
        while len(inside):
            here = node[inside]
            x = bins[inside, feature[here]]
            node[inside] = np.where(np.where(x == 0, missing[here], x <= at[here]), left[here], right[here])
            inside = inside[feature[node[inside]] >= 0]
        return node


@dataclass
class BoostedTrees:
    """A fitted model: probability = 1 / (1 + exp(-sum of leaf values))."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[Tree]
    setting: Setting
    best_auc: float | None = None

    def _bins(self, frame: pd.DataFrame) -> np.ndarray:
        return _binned([frame[f].to_numpy(float) for f in self.features], self.cuts)

    def score(self, df: DataFrame, name: str = "risk") -> DataFrame:
        """df with the predicted probability."""
        trees, model = self.trees, BoostedTrees(self.features, self.cuts, [], self.setting)

        @F.pandas_udf("double")
        def risk(values: pd.DataFrame) -> pd.Series:
            bins = model._bins(values)
            total = np.zeros(len(bins))
            for tree in trees:
                total += np.array(tree.value)[tree.walk(bins)]
            return pd.Series(1 / (1 + np.exp(-total)))
        return df.withColumn(name, risk(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features])))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node: (tree, node, feature, cut, missing_left, left, right, gain, cover, value), leaves without cut."""
        rows = []
        for number, tree in enumerate(self.trees, 1):
            for i in tree.nodes():
                f = tree.feature[i]
                inner = f >= 0
                rows.append((number, i, self.features[f] if inner else None,
                             float(self.cuts[f][tree.at[i] - 1]) if inner else None,
                             tree.missing_left[i] if inner else None, tree.left[i] if inner else None,
                             tree.right[i] if inner else None, tree.gain[i] if inner else None, tree.h[i],
                             None if inner else tree.value[i]))
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, missing_left boolean, "
                                           "left int, right int, gain double, cover double, value double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, gain, splits, importance): each feature's gain, splits, and share of all gain."""
        gain, splits = dict.fromkeys(self.features, 0.0), dict.fromkeys(self.features, 0)
        for tree in self.trees:
            for i in tree.nodes():
                if tree.feature[i] >= 0:
                    gain[self.features[tree.feature[i]]] += tree.gain[i]
                    splits[self.features[tree.feature[i]]] += 1
        whole = sum(gain.values())
        return spark.createDataFrame([(f, gain[f], splits[f], gain[f] / whole if whole else None) for f in self.features],
                                     "feature string, gain double, splits int, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").write.mode("overwrite").parquet(path)


def load_boosted(spark: SparkSession, path: str) -> BoostedTrees:
    found = json.loads(spark.read.parquet(path).first()[0])
    found["trees"] = [Tree(**t) for t in found["trees"]]
    return BoostedTrees(**{**found, "setting": Setting(**found["setting"])})


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Cut points of every feature: midpoints of neighbouring values, or quantiles where there are too many values."""
    one = df.agg(*[F.approx_count_distinct(f).alias(f"n{i}") for i, f in enumerate(features)]).first()
    few = [i for i in range(len(features)) if one[f"n{i}"] <= bins * 0.9]
    many = [i for i in range(len(features)) if i not in few]
    cuts: list[list[float]] = [[] for _ in features]
    if few:
        sets = df.agg(*[F.array_sort(F.collect_set(F.nanvl(F.col(features[i]).cast("double"), F.lit(None))))
                        .alias(f"v{i}") for i in few]).first()
        for i in few:
            v = sets[f"v{i}"]
            cuts[i] = [(a + b) / 2 for a, b in zip(v, v[1:])]
    if many:
        probs = [j / bins for j in range(1, bins)]
        for i, found in zip(many, df.approxQuantile([features[i] for i in many], probs, 1 / (8 * bins))):
            cuts[i] = sorted(set(found))
    return cuts


def _binned(columns: Sequence[np.ndarray], cuts: Sequence[Sequence[float]]) -> np.ndarray:
    out = np.empty((len(columns[0]), len(columns)), np.uint16)
    for i, (x, c) in enumerate(zip(columns, cuts)):
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(np.array(c), x, "right") + 1)
    return out


def _cells(df: DataFrame, features: Sequence[str], label: str, fold: str, cuts: list[list[float]]) -> DataFrame:
    """(fold, bins, n, pos): one row for all rows of a fold with equal bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))]
            bins = _binned(columns, cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                              pa.array([row.tobytes() for row in bins], pa.binary())],
                                             names=["fold", "y", "bins"])
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("int").alias("y"),
                                                    *[F.col(f).cast("double") for f in features])
    cells = (rows.mapInArrow(run, "fold int, y int, bins binary").groupBy("fold", "bins")
             .agg(F.count("*").alias("n"), F.sum("y").alias("pos")))
    return spread(cells).withColumn("margins", F.lit(b""))


@dataclass
class _Fit:
    """One model while it grows."""

    setting: Setting
    held: int | None  # fold for the AUC, not trained on
    trees: list[Tree] = field(default_factory=list)
    kept: int = 0  # trees that are in the written margins
    slot: int = 0  # place in the written margins
    aucs: list[float] = field(default_factory=list)
    growing: Tree | None = None
    open: list[int] = field(default_factory=list)


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(-1, width)
    margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), np.float64)
    return (bins, batch.column("fold").to_numpy(), batch.column("n").to_numpy().astype(float),
            batch.column("pos").to_numpy().astype(float), margins.reshape(len(bins), -1))


def _margin(fit: _Fit, bins: np.ndarray, margins: np.ndarray) -> np.ndarray:
    out = margins[:, fit.slot].copy() if margins.shape[1] else np.zeros(len(bins))
    for tree in fit.trees[fit.kept:]:
        out += np.array(tree.value)[tree.walk(bins)]
    return out


_SPLITS = "model int, node int, feature int, at int, missing_left boolean, gain double, g double, h double, gl double, hl double"


def _histograms(fits: Mapping[int, _Fit], widths: list[int], aucs: bool):
    """Rows (model, node, sums): gradient and curvature sums of open nodes; node -1 has held-out counts by score."""
    first = np.cumsum([0, *widths])
    slots = int(first[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, fold, n, pos, margins = _read(batch, len(widths))
            place = bins + first[:-1]
            for number, fit in fits.items():
                p = 1 / (1 + np.exp(-_margin(fit, bins, margins)))
                held = fold == fit.held if fit.held is not None else np.zeros(len(fold), bool)
                if aucs and held.any():
                    at = np.minimum((p[held] * STEPS).astype(np.int64), STEPS - 1)
                    counts = np.concatenate([np.bincount(at, w, STEPS) for w in (pos[held], n[held] - pos[held])])
                    sums[number, -1] = sums.get((number, -1), 0) + counts.astype(np.int64)
                if not fit.open:
                    continue
                number_of = np.full(len(fit.growing.feature), -1)
                number_of[fit.open] = np.arange(len(fit.open))
                node = number_of[fit.growing.walk(bins)]
                rows = np.flatnonzero((node >= 0) & ~held)
                g = np.round((n[rows] * p[rows] - pos[rows]) * UNIT)
                h = np.round(n[rows] * p[rows] * (1 - p[rows]) * UNIT)
                at = (node[rows][:, None] * slots + place[rows]).ravel()
                size = len(fit.open) * slots
                both = np.stack([np.bincount(at, np.repeat(w, len(widths)), size).reshape(-1, slots) for w in (g, h)], 1)
                for i, name in enumerate(fit.open):
                    sums[number, name] = sums.get((number, name), 0) + both[i].ravel().astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                 pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["model", "node", "sums"])
    return run


def best_split(g: np.ndarray, h: np.ndarray, widths: Sequence[int], setting: Setting) -> tuple | None:
    """(feature, at, missing_left, gain, gl, hl) of the best split of sums by feature and bin; earlier features and
    lower bins win ties. None if nothing gains."""
    best, start = None, 0
    for feature, width in enumerate(widths):
        mine, curve = g[start:start + width], h[start:start + width]
        start += width
        whole, size = mine.sum(), curve.sum()
        gl, hl = np.cumsum(mine[1:])[:-1], np.cumsum(curve[1:])[:-1]
        for missing_left in (True, False) if curve[0] > 0 else (True,):
            a, b = (gl + mine[0], hl + curve[0]) if missing_left else (gl, hl)
            gain = (a * a / (b + setting.reg) + (whole - a) ** 2 / (size - b + setting.reg)
                    - whole * whole / (size + setting.reg))
            gain[(b < setting.min_child) | (size - b < setting.min_child)] = -np.inf
            if len(gain):
                i = int(np.argmax(gain))
                if gain[i] > (best[3] if best else _LEAST_GAIN):
                    best = (feature, i + 1, missing_left, float(gain[i]), float(a[i]), float(b[i]))
    return best


def _splits(fits: Mapping[int, _Fit], widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for model, node, found in zip(*(c.to_pylist() for c in batch.columns)):
                sums[model, node] = sums.get((model, node), 0) + np.frombuffer(found, np.int64)
        rows = []
        for (model, node), both in sums.items():
            if node < 0:
                pos, neg = both.reshape(2, -1).astype(float)
                below = np.cumsum(neg) - neg
                pairs = pos.sum() * neg.sum()
                auc = float((pos * (below + neg / 2)).sum() / pairs) if pairs else None
                rows.append((model, -1, None, None, None, auc, None, None, None, None))
                continue
            g, h = both.reshape(2, -1) / UNIT
            best = best_split(g, h, widths, fits[model].setting)
            total = (float(g[:widths[0]].sum()), float(h[:widths[0]].sum()))
            rows.append((model, node, *(best[:4] if best else (None,) * 4), *total, *(best[4:] if best else (None,) * 2)))
        if rows:
            types = (pa.int32(),) * 4 + (pa.bool_(),) + (pa.float64(),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             names=[x.split()[0] for x in _SPLITS.split(", ")])
    return run


def _pass(cells: DataFrame, fits: Mapping[int, _Fit], widths: list[int], aucs: bool) -> list:
    """One pass over the cells for all models: the best split of every open node, and AUCs (node -1)."""
    sent = {i: _Fit(f.setting, f.held, f.trees[f.kept:], 0, f.slot, [], f.growing, f.open) for i, f in fits.items()}
    settings = {i: _Fit(f.setting, None) for i, f in fits.items()}
    parts = min(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * max(1, len(fits)))
    return (cells.mapInArrow(_histograms(sent, widths, aucs), "model int, node int, sums binary")
            .repartition(parts, "model", "node").mapInArrow(_splits(settings, widths), _SPLITS).collect())


def _write_margins(cells: DataFrame, fits: list[_Fit], widths: list[int], tables: Tables) -> DataFrame:
    """The cells with the margins of the given models; the table before is deleted."""
    sent = [_Fit(f.setting, f.held, f.trees[f.kept:], 0, f.slot) for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, _, _, _, margins = _read(batch, len(widths))
            new = np.stack([_margin(f, bins, margins) for f in sent], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.tobytes() for x in new], pa.binary())],
                                             names=batch.schema.names)
    out = tables.keep(cells.mapInArrow(run, "fold int, bins binary, n long, pos long, margins binary"))
    tables.drop(last=1)
    for slot, f in enumerate(fits):
        f.kept, f.slot = len(f.trees), slot
    return out


def _best_round(means: list[float]) -> int:
    return int(np.argmax(means)) + 1 if means else 0


def _boost(cells: DataFrame, cuts: list[list[float]], groups: list[list[_Fit]], rounds: int, patience: int | None) -> None:
    """Grow all models together. A group (the folds of a setting) stops when its mean AUC has not risen for `patience` rounds."""
    widths = [len(c) + 2 for c in cuts]
    every = [f for g in groups for f in g]
    number = {id(f): i for i, f in enumerate(every)}
    active = list(groups)

    def note(rows) -> None:
        for r in rows:
            if r.node < 0:
                every[r.model].aucs.append(r.gain)

    judged = any(f.held is not None for f in every)
    tables = Tables(cells.sparkSession, "margins")
    for done in range(rounds + judged):
        fits = {number[id(f)]: f for g in active for f in g}
        for f in fits.values():
            f.growing, f.open = (Tree(), [0]) if done < rounds else (None, [])
        level = 0
        while fits:
            rows = _pass(cells, fits, widths, aucs=level == 0 and done > 0)
            note(rows)
            if level == 0 and done > 0 and patience is not None:
                for g in list(active):
                    if _stopped([f.aucs for f in g], patience):
                        active.remove(g)
                        for f in g:
                            f.growing, f.open = None, []
                            del fits[number[id(f)]]
            going = {}
            for r in rows:
                f = fits.get(r.model)
                if f is None or r.node < 0:
                    continue
                if level == 0:
                    f.growing.g[0], f.growing.h[0] = r.g, r.h
                if r.feature is not None and level < f.setting.depth:
                    going.setdefault(r.model, []).append((r.node, r.feature, r.at, r.missing_left, r.gain, r.gl, r.hl))
            for i, f in fits.items():
                f.open = [c for s in sorted(going.get(i, [])) for c in f.growing.split(*s)]
                if level + 1 >= f.setting.depth:
                    f.open = []
            level += 1
            if not any(f.open for f in fits.values()):
                break
        if done == rounds or not active:
            break
        for f in fits.values():
            f.growing.finish(f.setting)
            f.trees.append(f.growing)
            f.growing = None
        if (done + 1) % KEEP == 0 and done + 1 < rounds + judged:
            cells = _write_margins(cells, [f for g in active for f in g], widths, tables)
    tables.drop()


def _grown(bins: np.ndarray, widths: Sequence[int], g: np.ndarray, h: np.ndarray, setting: Setting) -> tuple[Tree, np.ndarray]:
    """An unpruned tree over cells held in memory (features x cells), and the leaf of every cell."""
    def gain(a, b, whole, size):
        out = (a * a / (b + setting.reg) + (whole - a) ** 2 / (size - b + setting.reg)
               - whole * whole / (size + setting.reg))
        out[(b < setting.min_child) | (size - b < setting.min_child)] = -np.inf
        return out
    found, leaf = grow(bins, widths, g, h, setting.depth, lambda a, b: best_of(a, b, widths, gain, _LEAST_GAIN))
    left = found["left"]
    tree = Tree(found["feature"].tolist(), found["at"].tolist(), found["missing_left"].tolist(), left.tolist(),
                np.where(left < 0, -1, left + 1).tolist(), found["gain"].tolist(), found["a"].tolist(), found["b"].tolist(),
                [0.0] * len(left))
    return tree, leaf


def _values(tree: Tree, pruned: Tree) -> np.ndarray:
    """The leaf values of the pruned tree at the nodes of the tree it came from."""
    out = np.array(pruned.value)
    for node, left in enumerate(tree.left):
        if left >= 0 and pruned.feature[node] < 0:
            out[[left, left + 1]] = out[node]
    return out


def _stopped(aucs: Sequence[list], patience: int | None) -> bool:
    """Whether the mean AUC of the folds has not risen for `patience` rounds."""
    means = [np.mean(x) for x in zip(*aucs) if None not in x]
    return patience is not None and len(means) - _best_round(means) >= patience


def _held_auc(p: np.ndarray, n: np.ndarray, pos: np.ndarray) -> float | None:
    at = np.minimum((p * STEPS).astype(np.int64), STEPS - 1)
    good, bad = (np.bincount(at, w, STEPS) for w in (pos, n - pos))
    pairs = good.sum() * bad.sum()
    return float((good * (np.cumsum(bad) - bad + bad / 2)).sum() / pairs) if pairs else None


def _boost_alone(bins: np.ndarray, n: np.ndarray, pos: np.ndarray, widths: Sequence[int], settings: Mapping[int, Setting],
                 rounds: int, patience: int | None) -> dict[int, list[list]]:
    """AUCs by setting and fold after every round. n and pos are folds x cells; settings differ in gamma alone.

    Settings whose trees have been the same so far share their margins and the next tree before it is pruned.
    """
    k = len(n)
    aucs: dict[int, list[list]] = {s: [[] for _ in range(k)] for s in settings}
    branches = [[(np.zeros(bins.shape[1]), list(settings))] for _ in range(k)]
    active = set(settings)
    for done in range(rounds + 1):
        chances = [[1 / (1 + np.exp(-m)) for m, _ in some] for some in branches]
        for i, some in enumerate(branches if done else []):
            held = np.flatnonzero(n[i])
            for p, (_, members) in zip(chances[i], some):
                auc = _held_auc(p[held], n[i][held], pos[i][held]) if len(held) else None
                for s in members if len(held) else ():
                    aucs[s][i].append(auc)
        if done:
            active -= {s for s in active if _stopped(aucs[s], patience)}
        if done == rounds or not active:
            break
        for i, some in enumerate(branches):
            taught = n.sum(0) - n[i] > 0
            rows, rest = np.flatnonzero(taught), np.flatnonzero(~taught)
            now = []
            for p, (margin, members) in zip(chances[i], some):
                members = [s for s in members if s in active]
                if not members:
                    continue
                g, h = np.zeros(len(p)), np.zeros(len(p))
                for j in range(k):  # whole units of each fold, as in a pass over its cells
                    if j != i:
                        x = n[j] * p
                        g += np.rint((x - pos[j]) * UNIT)
                        h += np.rint(x * (1 - p) * UNIT)
                tree, leaf = _grown(bins[:, rows], widths, g[rows] / UNIT, h[rows] / UNIT, settings[members[0]])
                node = np.empty(bins.shape[1], np.int64)
                node[rows], node[rest] = leaf, tree.walk(bins[:, rest].T)
                alike: dict[tuple, tuple[Tree, list[int]]] = {}
                for s in members:
                    pruned = Tree(*(list(x) for x in vars(tree).values()))
                    pruned.finish(settings[s])
                    alike.setdefault(tuple(pruned.feature), (pruned, []))[1].append(s)
                now += [(margin + _values(tree, pruned)[node], same) for pruned, same in alike.values()]
            branches[i] = now
    return aucs


def _boost_apart(cells: DataFrame, cuts: list[list[float]], groups: list[list[_Fit]], rounds: int, patience: int | None) -> bool:
    """_boost() with all rounds of a setting in one task, for AUCs only; False where the cells take over LOCAL_BYTES."""
    spark, k, widths = cells.sparkSession, len(groups[0]), [len(c) + 2 for c in cuts]
    fold = [F.coalesce(F.sum(F.when(F.col("fold") == i, F.col(c))), F.lit(0)).alias(f"{c}{i}") for c in ("n", "pos") for i in range(k)]
    tables = Tables(spark, "cells")
    packed = tables.keep(cells.groupBy("bins").agg(*fold))
    number = packed.count()
    if not number or number * (2 * len(cuts) + 16 * k) > LOCAL_BYTES:
        tables.drop()
        return False
    got = packed.toArrow()
    tables.drop()
    bins = np.frombuffer(b"".join(got["bins"].to_pylist()), np.uint16).reshape(-1, len(cuts))
    n, pos = (np.stack([got[f"{c}{i}"].to_numpy() for i in range(k)]) for c in ("n", "pos"))
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(bins.T), n, pos))
    alike: dict[tuple, dict[int, Setting]] = {}
    for i, group in enumerate(groups):
        s = group[0].setting
        alike.setdefault((s.depth, s.step, s.min_child, s.reg), {})[i] = s
    units = [alike[key] for key in sorted(alike, reverse=True)]  # the deepest take longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                bins, n, pos = shared.value
                found = _boost_alone(bins, n.astype(float), pos.astype(float), widths, units[unit], rounds, patience)
                rows = [(s, i, a) for s, folds in found.items() for i, a in enumerate(folds)]
                types = pa.int32(), pa.int32(), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["setting", "fold", "aucs"])
    grown = spark.range(0, len(units), 1, len(units)).mapInArrow(run, "setting int, fold int, aucs array<double>").collect()
    shared.unpersist()
    for r in grown:
        groups[r.setting][r.fold].aucs = list(r.aucs)
    return True


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, setting: Setting = Setting(), rounds: int = 50,
                held: str | None = None, patience: int | None = 3, bins: int = BINS) -> BoostedTrees:
    """Boosted trees of the rows with outcome 0 or 1; other rows are left out.

    Where `held` names a 0/1 column, its rows with 1 are not trained on but give the AUC after every round; fitting
    stops when that has not risen for `patience` rounds, and the trees up to the best round stay. Values may be null.
    """
    marked = df.withColumn("_fold", F.col(held).cast("int") if held else F.lit(0))
    cuts = feature_cuts(marked.where(F.col("_fold") == 0), features, bins)
    fit = _Fit(setting, 1 if held else None)
    _boost(cut(_cells(marked, features, label, "_fold", cuts)), cuts, [[fit]], rounds, patience if held else None)
    known = [a for a in fit.aucs if a is not None]
    trees = fit.trees[:_best_round(known)] if known and patience is not None else fit.trees
    return BoostedTrees(list(features), cuts, trees, setting, max(known, default=None))


def cv_boosted(df: DataFrame, features: Sequence[str], label: str, key: str, settings: Sequence[Setting], rounds: int = 100,
               k: int = 5, patience: int | None = 3, seed: int = 11, bins: int = BINS) -> DataFrame:
    """(setting number, its values, round, auc, sd, best): held-out AUC over stratified folds after each round.

    All settings and folds grow in the same passes, or with the same results each setting in one task, where there are
    several and their cells fit there; a setting stops when its mean AUC has not risen for `patience` rounds. `best` marks the round of highest mean AUC of each setting, the first of equal ones.
    """
    folds = assign_folds(df, k, label, key, seed, "_fold")
    cuts = feature_cuts(folds, features, bins)
    groups = [[_Fit(s, i) for i in range(k)] for s in settings]
    cells = cut(_cells(folds, features, label, "_fold", cuts))
    if len(groups) == 1 or not _boost_apart(cells, cuts, groups, rounds, patience):
        _boost(cells, cuts, groups, rounds, patience)
    rows = []
    for number, (s, g) in enumerate(zip(settings, groups), 1):
        per = [x for x in zip(*(f.aucs for f in g)) if None not in x]
        best = _best_round([np.mean(x) for x in per])
        rows += [(number, *map(float, asdict(s).values()), r, float(np.mean(x)), float(np.std(x, ddof=1)) if k > 1 else None,
                  r == best) for r, x in enumerate(per, 1)]
    names = ", ".join(f"{n} double" for n in asdict(Setting()))
    return df.sparkSession.createDataFrame(rows, f"setting int, {names}, round int, auc double, sd double, best boolean")


def setting_grid(**values: Sequence[float]) -> list[Setting]:
    """Every combination of the given values."""
    out = [Setting()]
    for name, some in values.items():
        out = [Setting(**{**asdict(s), name: v}) for s in out for v in some]
    return out
