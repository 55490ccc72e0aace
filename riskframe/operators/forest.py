"""Random forests of deep regression trees on a 0/1 outcome.

Values are binned and equal rows become one cell. Every task is sent the cells and grows whole trees alone, each on its
own bootstrap sample: a cell of n rows with p positive ones is taken Poisson(p) + Poisson(n - p) times. Trees are kept as
a table, and distinct rows are scored by them block by block, so neither the driver nor a task holds a whole forest.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F

from ..functions.growing import best_of, grow
from ..lineage import Tables, spread
from .boosting import _binned, feature_cuts

# Ship these helpers with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCAL_BYTES = 64 * 2**20  # cells up to this size are sent to all tasks
TREE_BYTES = 32 * 2**20  # trees that rows are scored by at once
_NODE = np.dtype([("feature", "<i2"), ("at", "<u2"), ("left", "<i4"), ("value", "<f8")])


@dataclass
class Forest:
    """Trees in the table (tree, size, nodes, gains); transform adds their mean as `_mean`."""

    features: list[str]
    cuts: list[list[float]]
    trees: DataFrame
    featureImportances: DenseVector

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)]
        names = [f"_x{i}" for i in range(len(cols))]
        tables = Tables(df.sparkSession, "scores")
        rows = tables.keep(spread(df.select(*cols).distinct()).withColumn("_mean", F.lit(0.0)))
        sizes = [(r.tree, r.size) for r in self.trees.select("tree", "size").orderBy("tree").collect()]
        blocks: list[list[int]] = [[]]
        room = TREE_BYTES
        for tree, size in sizes:
            if size > room and blocks[-1]:
                blocks.append([])
                room = TREE_BYTES
            blocks[-1].append(tree)
            room -= size
        for block in blocks:
            found = self.trees.where(F.col("tree").between(block[0], block[-1])).select("tree", "nodes").collect()
            shared = df.sparkSession.sparkContext.broadcast([bytes(r.nodes) for r in sorted(found)])
            rows = tables.keep(rows.mapInArrow(_add_scores(shared, self.cuts, len(sizes)), rows.schema))
            tables.drop(last=1)
            shared.unpersist()
        kept = rows.select(*names, F.col("_mean"))
        marked = df.withColumns(dict(zip(names, cols)))
        return marked.join(kept, names).select(*df.columns, "_mean")


def _add_scores(shared, cuts, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [np.frombuffer(t, _NODE) for t in shared.value]
        for batch in batches:
            bins = _binned([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], cuts).T
            if (bins == 0).any():
                raise ValueError("a row to score lacks a feature")
            total, every = np.zeros(batch.num_rows), np.arange(batch.num_rows)
            for tree in trees:
                node, rows = np.zeros(batch.num_rows, np.int64), every
                while len(rows):
                    here = tree[node[rows]]
                    inner = here["feature"] >= 0
                    rows, here = rows[inner], here[inner]
                    node[rows] = here["left"] + (bins[here["feature"], rows] > here["at"])
                total += tree["value"][node]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(batch.column(batch.num_columns - 1).to_numpy() + total / number)],
                                             names=batch.schema.names)
    return run


def _cells(df: DataFrame, features: Sequence[str], label: str, cuts: list[list[float]]) -> DataFrame:
    """(bins, n, pos): one row for all rows with equal bins; equal values are counted first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-2]], cuts)
            if (bins == 0).any():
                raise ValueError("a row to fit lacks a feature")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), *batch.columns[-2:]], names=["bins", "n", "pos"])
    cols = [f"_x{i}" for i in range(len(features))]
    equal = (df.select(*[F.col(f).cast("double").alias(c) for f, c in zip(features, cols)], F.col(label).cast("double").alias("_y"))
             .groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("pos")))
    return equal.mapInArrow(run, "bins binary, n long, pos long").groupBy("bins").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int, min_leaf: int, depth: int, seed: int,
               bins: int = 256) -> Forest | None:
    """A forest that tries all features at every split, or None where labels are not 0/1 or cells take over LOCAL_BYTES.

    Splits gain the most variance; both sides hold min_leaf sampled rows at least. Results do not depend on the
    partitioning: every tree has a generator of its own and the cells are ordered.
    """
    spark = df.sparkSession
    y = F.col(label).cast("double")
    if df.where(y.isNull() | ~y.isin(0.0, 1.0)).limit(1).count():
        return None
    cuts = feature_cuts(df, features, bins)
    widths = [len(c) + 2 for c in cuts]
    tables, stay = Tables(spark, "cells"), Tables(spark, "forest")
    cells = tables.keep(_cells(df, features, label, cuts))
    if cells.count() * (2 * len(features) + 16) > LOCAL_BYTES:
        tables.drop()
        return None
    got = cells.orderBy("bins").toArrow()
    tables.drop()
    if not got.num_rows:
        raise ValueError("no rows to fit")
    code = np.frombuffer(b"".join(got["bins"].to_pylist()), np.uint16).reshape(-1, len(features)).T
    n, pos = (got[c].to_numpy() for c in ("n", "pos"))
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(code), n, pos))

    def gain(u, v, whole, size):
        with np.errstate(divide="ignore", invalid="ignore"):
            out = u * u / v + (whole - u) ** 2 / (size - v) - whole * whole / size
        return np.where((v < min_leaf) | (size - v < min_leaf), -np.inf, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, pos = shared.value
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, tree])
                good, bad = rng.poisson(pos).astype(float), rng.poisson(n - pos).astype(float)
                taken = np.flatnonzero(good + bad)
                found, _ = grow(code[:, taken], widths, good[taken], (good + bad)[taken], depth,
                                lambda a, b: best_of(a, b, widths, gain, 1e-9))
                nodes = np.zeros(len(found["feature"]), _NODE)
                nodes["feature"], nodes["at"], nodes["left"] = found["feature"], found["at"], found["left"]
                nodes["value"] = found["a"] / np.maximum(found["b"], 1)
                inner = found["feature"] >= 0
                gains = np.bincount(found["feature"][inner], found["gain"][inner], len(widths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree], pa.int64()), pa.array([nodes.nbytes], pa.int64()), pa.array([nodes.tobytes()], pa.binary()),
                     pa.array([gains.tolist()], pa.list_(pa.float64()))], names=["tree", "size", "nodes", "gains"])
    parts = min(trees, 4 * spark.sparkContext.defaultParallelism)
    grown = stay.keep(spark.range(0, trees, 1, parts).mapInArrow(run, "tree long, size long, nodes binary, gains array<double>"))
    shared.unpersist()
    shares = [np.array(r.gains) for r in grown.select("tree", "gains").orderBy("tree").collect()]
    total = sum(g / g.sum() for g in shares if g.sum() > 0) if any(g.sum() > 0 for g in shares) else np.zeros(len(widths))
    return Forest(list(features), cuts, grown, DenseVector(total / total.sum() if total.sum() > 0 else total))
