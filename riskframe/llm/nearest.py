"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample, every vector is put into one leaf of each tree. A query searches all trees
through one priority queue: the node nearest to it, by the squared distances of the cuts crossed on the way, opens
first, until a share of the forest is open. The share is the one that finds `target` of the true neighbours inside the
sample. The candidates in the open leaves are ranked by their exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, spread

TOP = 10
SAMPLE = 20_000
TREES = 4
LEAF = 32
TARGET = 0.96
PROBES = 100
PACK_ROWS = 8_192
PACK_QUERIES = 16_384
CHUNK = 256
SEED = 17


def usable_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector as the bytes of its numbers), without null ids and null, empty, zero or non-finite vectors.

    Floats keep their width, all other numbers become doubles; -0.0 becomes 0.0, so equal vectors have equal bytes.
    """
    element = vectors.schema[vector].dataType.elementType.typeName()
    column = F.col(vector) if element == "float" else F.col(vector).cast("array<double>")
    kind = _kind(vectors, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = rows.flatten()
            flat = parts.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            owner = np.repeat(np.arange(len(size)), size)
            good = size > 0
            good[owner[~np.isfinite(flat)]] = False
            some = np.zeros(len(size), bool)
            some[owner[flat != 0]] = True
            start = np.cumsum(size) - size
            keep = np.flatnonzero(good & some)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)),
                 pa.array([flat[start[i]:start[i] + size[i]].tobytes() for i in keep.tolist()], pa.binary())],
                names=["id", "vector"])
    return (vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), column.alias("v"))
            .mapInArrow(run, "id long, vector binary"))


def _kind(vectors: DataFrame, vector: str):
    return np.float32 if vectors.schema[vector].dataType.elementType.typeName() == "float" else np.float64


def _matrix(column, kind) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows by one product, and a bound of their rounding error."""
    with np.errstate(over="ignore", invalid="ignore"):  # beyond the range nothing is near, or all is looked at
        norms = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
        return norms - 2 * (a @ b.T), 1e-12 * a.shape[1] * norms


class Forest:
    """Trees over vectors of one width. Nodes are numbered over all trees; ~leaf stands for a leaf."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, top: int, target: float, seed: int):
        self.sample = sample
        draw = np.random.default_rng([seed, sample.shape[1]])
        self.planes, self.cuts, self.kids, self.held = [], [], [], []
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf, draw) for _ in range(trees)]
        self.planes = np.array(self.planes).reshape(len(self.cuts), sample.shape[1])
        self.cuts, self.kids = np.array(self.cuts), np.array(self.kids, np.int64).reshape(-1, 2)
        self.leaves = self.route(sample)
        self.budget = self._budget(draw, top, target)

    def _grow(self, sample, rows, leaf, draw) -> int:
        if len(rows) > leaf:
            a, b = sample[draw.choice(rows, 2, replace=False)]
            direction = (a - b) / np.abs(a - b).max()
            direction /= np.linalg.norm(direction)
            at = sample[rows] @ direction
            middle = np.median(at)
            low, high = rows[at <= middle], rows[at > middle]
            if len(low) and len(high):
                me = len(self.cuts)
                self.planes.append(direction)
                self.cuts.append(middle)
                self.kids.append(None)
                self.kids[me] = (self._grow(sample, low, leaf, draw), self._grow(sample, high, leaf, draw))
                return me
        self.held.append(len(rows))
        return ~(len(self.held) - 1)

    def _budget(self, draw, top: int, target: float) -> float:
        """Sample rows in the leaves to open so that `target` of the sample's own neighbours are met."""
        rows = len(self.sample)
        if rows <= top + 1 or not len(self.cuts):
            return float("inf")
        needed = []
        for probe in draw.choice(rows, min(PROBES, rows), replace=False).tolist():
            far = _squares(self.sample[probe:probe + 1], self.sample)[0][0]
            far[probe] = np.inf
            near = np.argpartition(far, top - 1)[:top]
            opened = np.zeros(len(self.held))
            total = 0
            for leaf in self.search(self.planes @ self.sample[probe] - self.cuts, float("inf")):
                total += self.held[leaf]
                opened[leaf] = total
            needed.append(opened[self.leaves[near]].min(1))
        return float(np.quantile(np.concatenate(needed), target))

    def search(self, margins: np.ndarray, budget: float) -> list[int]:
        """Leaves of all trees, nearest first, until they hold `budget` rows of the sample."""
        margins, kids = margins.tolist(), self.kids.tolist()
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        out, total = [], 0
        while queue and total < budget:
            distance, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                total += self.held[~node]
                continue
            margin = margins[node]
            near, far = kids[node] if margin <= 0 else kids[node][::-1]
            heapq.heappush(queue, (distance, near))
            heapq.heappush(queue, (distance + margin * margin, far))
        return out

    def route(self, rows: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of every row in every tree."""
        out = np.empty((len(rows), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            at = np.full(len(rows), root)
            inside = np.flatnonzero(at >= 0)
            while len(inside):
                node = at[inside]
                side = np.einsum("ij,ij->i", rows[inside], self.planes[node]) - self.cuts[node] > 0
                at[inside] = self.kids[node, side.astype(np.int64)]
                inside = inside[at[inside] >= 0]
            out[:, tree] = ~at
        return out

    def radius(self, far: np.ndarray, leaves: list[int], top: int) -> float:
        """A square that `top` vectors of the open leaves, the query itself left out, do not exceed.

        `far` bounds the squared distances to the sample from above; the sample's vectors are in the index as well.
        """
        opened = np.zeros(len(self.held), bool)
        opened[leaves] = True
        near = far[opened[self.leaves].any(1)]
        if len(near) <= top:
            return np.inf
        least = np.partition(near, top)[top]
        return float(least) if np.isfinite(least) else np.inf


class Packs:
    """Leaves of all widths in a row, cut into packs of at most PACK_ROWS rows; a larger leaf is a pack by itself."""

    def __init__(self, rows: np.ndarray):
        self.pack = np.zeros(len(rows), np.int64)
        self.rows: list[int] = []
        for leaf, n in enumerate(rows.tolist()):
            if not self.rows or self.rows[-1] + n > PACK_ROWS:
                self.rows.append(0)
            self.rows[-1] += n
            self.pack[leaf] = len(self.rows) - 1
        self.blocks = np.maximum(1, -(-np.array(self.rows, np.int64) // PACK_ROWS))


def _by_width(batch: pa.RecordBatch, kind) -> Iterator[tuple[int, pa.RecordBatch]]:
    width = pc.binary_length(batch.column(batch.schema.get_field_index("vector"))).to_numpy() // kind().itemsize
    for w in np.unique(width).tolist():
        yield w, batch.take(pa.array(np.flatnonzero(width == w)))


def _leaf_sizes(classes: DataFrame, forests, first, kind) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(first.value["end"], np.int64)
        for batch in batches:
            for width, part in _by_width(batch, kind):
                leaves = forests.value[width].route(_matrix(part.column("vector"), kind)) + first.value[width]
                counts += np.bincount(leaves.ravel(), minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], names=["leaf", "n"])
    out = np.zeros(first.value["end"], np.int64)
    for leaf, n in classes.select("vector").mapInArrow(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect():
        out[leaf] = n
    return out


def _visits(queries: DataFrame, forests, first, packs, top: int, kind) -> DataFrame:
    """(query, vector, radius, pack, leaves): what every query has to look at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, mine in _by_width(batch, kind):
                forest, base, pack = forests.value[width], first.value[width], packs.value.pack
                for start in range(0, mine.num_rows, CHUNK):
                    part = mine.slice(start, CHUNK)
                    rows = _matrix(part.column("vector"), kind)
                    far, slack = _squares(rows, forest.sample)
                    margins = rows @ forest.planes.T - forest.cuts
                    radius = np.empty(len(rows))
                    at, places, leaves, ends = [], [], [], [0]
                    for i in range(len(rows)):
                        found = forest.search(margins[i], forest.budget)
                        radius[i] = forest.radius(far[i] + slack[i], found, top)
                        open_ = np.sort(np.array(found, np.int64) + base)
                        cuts = np.flatnonzero(np.diff(pack[open_])) + 1
                        at += [i] * (len(cuts) + 1)
                        places += pack[open_[np.r_[0, cuts]]].tolist()
                        ends += (ends[-1] + np.r_[cuts, len(open_)]).tolist()
                        leaves.append(open_)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(at)), part.column("vector").take(pa.array(at)),
                         pa.array(radius[at]), pa.array(places, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(leaves)))],
                        names=["query", "vector", "radius", "pack", "leaves"])
    return queries.mapInArrow(run, "query long, vector binary, radius double, pack long, leaves array<long>")


def _members(classes: DataFrame, forests, first, packs, shares, kind) -> DataFrame:
    """(pack, block, share, leaf, vector, ids): every class once a tree, in the packs that a query looks at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch, kind):
                leaves = forests.value[width].route(_matrix(part.column("vector"), kind)) + first.value[width]
                row = np.repeat(np.arange(len(leaves)), leaves.shape[1])
                leaf = leaves.ravel()
                pack = packs.value.pack[leaf]
                times = shares.value[pack]
                block = part.column("number").to_numpy()[row] % packs.value.blocks[pack]
                share = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, leaf, pack, block = (np.repeat(x, times) for x in (row, leaf, pack, block))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pack), pa.array(block), pa.array(share), pa.array(leaf),
                     part.column("vector").take(pa.array(row)), part.column("ids").take(pa.array(row))],
                    names=["pack", "block", "share", "leaf", "vector", "ids"])
    return (classes.withColumn("number", F.xxhash64("vector").bitwiseAND(2**62 - 1))
            .mapInArrow(run, "pack long, block long, share long, leaf long, vector binary, ids array<long>"))


def _rank(top: int, kind):
    def run(members: pa.Table, visits: pa.Table) -> pa.Table:
        """The `top` nearest of each query among the members of its open leaves, by exact distance."""
        ids = members["ids"].to_pylist()
        width = np.array([len(v) for v in members["vector"].to_pylist()])
        leaf = members["leaf"].to_numpy()
        found = []
        wide = np.array([len(v) for v in visits["vector"].to_pylist()])
        for w in np.intersect1d(width, wide).tolist():  # leaves of two widths may share a pack
            mine = np.flatnonzero(width == w)
            rows = _matrix(members["vector"].take(pa.array(mine)), kind)
            known, place = np.unique(leaf[mine], return_inverse=True)
            asked = np.flatnonzero(wide == w)
            for start in range(0, len(asked), CHUNK):
                part = visits.take(pa.array(asked[start:start + CHUNK]))
                queries, radius = _matrix(part["vector"], kind), part["radius"].to_numpy()
                open_ = np.zeros((len(queries), len(known)), bool)
                opened = part["leaves"].combine_chunks()
                owner = np.repeat(np.arange(len(queries)), np.diff(opened.offsets.to_numpy()))
                seen = opened.flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, seen), len(known) - 1)
                hit = known[at] == seen
                open_[owner[hit], at[hit]] = True
                far, slack = _squares(queries, rows)
                a, b = np.nonzero(open_[:, place] & ~(far > radius[:, None] + slack))
                with np.errstate(over="ignore"):
                    score = np.sqrt(((queries[a] - rows[b]) ** 2).sum(1))
                name = part["query"].to_pylist()
                best: dict[int, set] = {}  # a pack can hold a vector in leaves of several trees
                for i, j, s in zip(a.tolist(), mine[b].tolist(), score.tolist()):
                    best.setdefault(i, set()).update((s, key) for key in ids[j] if key != name[i])
                found += [(name[i], key, s) for i, some in best.items() for s, key in heapq.nsmallest(top, some)]
        query, vec, score = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()),
                         "score": pa.array(score, pa.float64())})
    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "vec_id",
                       vector: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF,
                       target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest vectors found for each query, nearest first.

    Nearness is the Euclidean distance in doubles of the vectors as they are; equal distances go by the smaller
    vec_id; all candidates are listed where there are fewer. A query's candidates are the vectors of other ids and
    of its own length. Rows with a null id and vectors that are null, empty, zero or hold a null or non-finite
    number take no part. Rows equal in id and vector are one; of several vectors with the id of a query the one
    of least bytes is searched for, of those with the id of a candidate the nearest counts. Equal vectors are one class in the index, which keeps its `top` + 1 smallest ids,
    as no other can be in a result. Ids are integers; other columns are not read.

    The trees of a length are fitted on at most `sample` vectors of least hash; those in a query's open leaves also
    bound how far a neighbour can be. Recall is that of the sample's own neighbours, `target`, or better, as a full
    table has nearer ones. Packs of leaves with over PACK_ROWS vectors or PACK_QUERIES queries are dealt out in
    blocks, every block of vectors with every block of queries. What reaches the driver is the sample and one number
    a leaf.
    """
    spark = vectors.sparkSession
    kind = _kind(vectors, vector)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable_vectors(vectors, id_col, vector)
    smallest = Window.partitionBy("vector").orderBy("id")
    classes = cut(rows.withColumn("place", F.dense_rank().over(smallest)).where(F.col("place") <= top + 1)
                  .groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    if vectors.schema[vector].dataType != queries.schema[vector].dataType:
        raise ValueError("queries and vectors must have one type")
    asked = cut(usable_vectors(queries, id_col, vector).groupBy("id").agg(F.min("vector").alias("vector")))
    widths = [r[0] for r in asked.select(F.octet_length("vector")).distinct().collect()]
    classes = classes.where(F.octet_length("vector").isin(widths)) if widths else classes.limit(0)
    forests, first, end = {}, {}, 0
    for w in sorted(widths):
        taken = (classes.where(F.octet_length("vector") == w).orderBy(F.xxhash64("vector"), "vector").limit(sample)
                 .select("vector").toArrow())
        if taken.num_rows:
            width = w // kind().itemsize
            forests[width] = Forest(_matrix(taken["vector"], kind), trees, leaf, top, target, SEED)
            first[width] = end
            end += len(forests[width].held)
    if not forests:
        return empty
    asked = asked.where(F.octet_length("vector").isin([w * kind().itemsize for w in forests]))
    send = spark.sparkContext.broadcast
    forests, first = send(forests), send({**first, "end": end})
    packs = send(Packs(_leaf_sizes(classes, forests, first, kind)))
    visits = cut(_visits(spread(asked), forests, first, packs, top, kind))
    seen = np.zeros(len(packs.value.rows), np.int64)
    for pack, n in visits.groupBy("pack").count().collect():
        seen[pack] = n
    shares = send(-(-seen // PACK_QUERIES))
    pairs = spark.createDataFrame([(i, int(b), int(s)) for i, (b, s) in enumerate(zip(packs.value.blocks, shares.value))],
                                  "pack long, blocks long, shares long")
    dealt = (visits.join(F.broadcast(pairs), "pack")
             .withColumn("share", F.pmod(F.xxhash64("query"), F.col("shares")))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("pack", "block", "share", "query", "vector", "radius", "leaves"))
    keys = ["pack", "block", "share"]
    found = (_members(classes, forests, first, packs, shares, kind).groupBy(*keys).cogroup(dealt.groupBy(*keys))
             .applyInArrow(_rank(top, kind), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"))
