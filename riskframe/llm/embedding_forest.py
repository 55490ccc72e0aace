"""Embedding near-duplicates by a forest of random-projection trees with overlapping splits.

Vectors are projected on random directions, one for each level of each tree. A node is split at the median of its
vectors' projections, and vectors near the median go to both sides, so that close vectors seldom part. Pairs are
compared inside leaves only; several trees make up for those that part in one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Tables, cut
from .components import components

TREES = 6
LEAF = 256
BLOCK = 1024
SPILL = 0.5
SHRINK = 0.3
SEED = 11


def unit_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, unit array<double>, usable): unit is null where the vector is null, zero or has a bad component."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = F.transform("v", lambda x: x / F.col("largest"))  # first by the largest part, so squares stay in range
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.col("largest") > 0)
    return (vectors.select(F.col(id_col).alias("id"), parts.alias("v")).withColumn("largest", largest)
            .withColumn("usable", F.coalesce(usable, F.lit(False)))
            .withColumn("s", F.when(F.col("usable"), scaled))
            .select("id", "usable", F.transform("s", lambda x: x / norm).alias("unit")))


def _projections(classes: DataFrame, trees: int, levels: int) -> DataFrame:
    """(cls, tree, at): projections of each class's vector on the tree's directions, one a level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1)
            size = np.diff(rows.offsets.to_numpy())
            flat = rows.flatten().to_numpy()
            start = np.cumsum(size) - size
            for width in np.unique(size).tolist():
                mine = np.flatnonzero(size == width)
                if width not in made:
                    made[width] = np.random.default_rng([SEED, width]).standard_normal((width, trees * levels))
                    made[width] /= np.linalg.norm(made[width], axis=0)
                at = (flat[start[mine][:, None] + np.arange(width)] @ made[width]).reshape(-1, levels)
                cuts = np.arange(len(at) + 1, dtype=np.int32) * levels
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[mine], trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32),
                                                                             len(mine))),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.ravel()))], names=["cls", "tree", "at"])
    return classes.select("cls", "unit").mapInArrow(run, "cls long, tree int, at array<double>")


def forest_leaves(classes: DataFrame, cosine: float, trees: int = TREES, leaf: int = LEAF,
                  spill: float = SPILL) -> DataFrame:
    """(cls, tree, leaf): the leaves of every class (cls, unit) in every tree.

    Level by level, nodes of over `leaf` vectors are split at the median. The overlap is `spill` standard deviations
    of the distance that two vectors at the threshold have on a random direction. A node stays a leaf, of whatever
    size, where less than SHRINK of it lies beyond the overlap on either side, as splitting it would only copy it.
    """
    size = classes.agg(F.count("*"), F.max(F.size("unit"))).first()
    levels = max(1, math.ceil(math.log2(max(2, size[0] / leaf))) + 3)
    reach = spill * math.sqrt((2 - 2 * cosine) / max(1, size[1] or 1))
    state = _projections(classes, trees, levels).withColumn("leaf", F.lit(1).cast("long")).withColumn(
        "open", F.lit(True))
    tables = Tables(classes.sparkSession, "forest")
    state = tables.keep(state)
    for level in range(levels):
        here = F.get("at", F.lit(level))
        nodes = (state.where("open").groupBy("tree", "leaf")
                 .agg(F.count("*").alias("n"), F.percentile_approx(
                     here, [SHRINK, 0.5, 1 - SHRINK], 1000).alias("q")))
        nodes = nodes.select("tree", "leaf", F.get("q", F.lit(1)).alias("middle"), (
            (F.col("n") > leaf) & (F.get("q", F.lit(1)) - F.get("q", F.lit(0)) > reach)
            & (F.get("q", F.lit(2)) - F.get("q", F.lit(1)) > reach)).alias("split"))
        joined = state.join(tables.keep(nodes), ["tree", "leaf"], "left")
        low, high = here <= F.col("middle") + reach, here > F.col("middle") - reach
        sides = F.when(F.col("open") & F.col("split"), F.filter(F.array(
            F.when(low, F.col("leaf") * 2), F.when(high, F.col("leaf") * 2 + 1)), lambda x: x.isNotNull()))
        state = tables.keep(joined.select("cls", "tree", "at", F.explode(F.coalesce(sides, F.array("leaf"))).alias("leaf"),
                                  (F.col("open") & F.coalesce("split", F.lit(False))).alias("open")))
        if not state.where("open").limit(1).count():
            break
        tables.drop(last=1)
    out = cut(state.select("cls", "tree", "leaf"))
    tables.drop()
    return out


def _compare(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links of one leaf, or of one pair of its blocks, that no earlier leaf of both vectors has."""
        group = group.sort_values("cls")
        ids, copies = group["cls"].to_numpy(), group["copies"].to_numpy()
        side = group["block"].to_numpy()
        split = group["low"].iloc[0] != group["high"].iloc[0]
        leaves = list(group["leaves"])
        own = int(group["number"].iloc[0])
        width = {len(u) for u in group["unit"]}
        counts = np.zeros(len(ids), np.int64)
        edges: list[tuple[int, int]] = []
        for w in width:
            mine = np.flatnonzero([len(u) == w for u in group["unit"]])
            units = np.array(list(group["unit"].iloc[mine]))
            up = list(range(len(mine)))

            def root(x: int) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            sets = [leaves[i] for i in mine]
            for start in range(0, len(mine), 256):
                near = units[start:start + 256] @ units.T >= cosine
                for a, b in zip(*np.nonzero(near)):
                    a = int(a) + start
                    if a >= b or (split and side[mine[a]] == side[mine[b]]):
                        continue
                    if np.intersect1d(sets[a], sets[b], assume_unique=True)[0] != own:
                        continue  # counted in an earlier leaf that holds both
                    counts[mine[a]] += copies[mine[b]]
                    counts[mine[b]] += copies[mine[a]]
                    x, y = root(a), root(int(b))
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        edges.append((int(ids[mine[a]]), int(ids[mine[b]])))
        hit = np.flatnonzero(counts)
        return pd.DataFrame({"a": [*ids[hit].tolist(), *[e[0] for e in edges]],
                             "b": [*([None] * len(hit)), *[e[1] for e in edges]],
                             "n": [*counts[hit].tolist(), *([0] * len(edges))]}).astype(
            {"a": "Int64", "b": "Int64", "n": "Int64"})
    return run


def embedding_classes(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector: str = "embedding",
                      trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(id, n_links, component_id, kept) per row; links are pairs met in a leaf with a cosine of at least `cosine`.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are components
    of their own; so do vectors of different lengths with each other. Equal unit vectors are one class: all pairs of
    copies link, and are counted without being formed. n_links counts the other rows linked directly. A leaf of over
    BLOCK vectors is compared block by block, each pair of blocks a group of its own, and a pair that shares several
    leaves counts in the first. component_id is the smallest id reachable, kept marks the rows that bear it. Rows
    with a null id are left out.
    """
    rows = cut(unit_vectors(vectors.where(F.col(id_col).isNotNull()), id_col, vector))
    usable = rows.where("usable")
    classes = cut(usable.groupBy("unit").agg(F.min("id").alias("cls"), F.count("*").alias("copies")))
    leaves = forest_leaves(classes, cosine, trees, leaf)
    node = F.xxhash64("tree", "leaf")
    held = cut(leaves.select("cls", node.alias("number")).groupBy("cls").agg(
        F.array_sort(F.collect_set("number")).alias("leaves")))
    blocks = leaves.groupBy(node.alias("number")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = (leaves.select("cls", node.alias("number")).join(cut(blocks), "number")
               .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .select("cls", "number", "block", F.least("block", "other").alias("low"),
                       F.greatest("block", "other").alias("high")))
    found = cut(members.join(classes, "cls").join(held, "cls").groupBy("number", "low", "high")
                .applyInPandas(_compare(cosine), "a long, b long, n long"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    result = (classes.join(linked, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
              .select("unit", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "cls").alias("component_id")))
    joined = rows.join(cut(result), "unit", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", "id").alias("component_id"),
                         (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))
