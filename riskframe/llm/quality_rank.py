"""Document quality by Bradley-Terry ranking: a linear score learnt from all preference pairs, cut at a quantile."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import store
from ..operators.ordered import running_sums

BINS = 4_096  # score bins of a step
PENALTY = 1e-3
CUT = 0.3

_WORD = re.compile(r"\S+").findall
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?!-]")
_MARKED = re.compile(r"[^\w\s.,;:'\"()?-]+(?=[.,]?(?:\s|$))")
_CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
FEATURES = ("log_words", "distinct", "distinct_pairs", "neighbours_equal", "top_share", "word_length",
            "symbols", "marked_words", "capitals", "digits", "bars", "stops", "repeated_lines", "short_lines")


def features(text: str) -> list[float]:
    """Length, variety, repetition and typography of a whole text; an empty one has no variety."""
    words = _WORD(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    pairs = list(zip(words, words[1:]))
    return [
        float(np.log1p(n)), np.log(len(counts) / n) / np.log1p(n), len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)), max(counts.values()) / n,
        min(20.0, sum(map(len, words)) / n), len(_SYMBOL.findall(text)) / chars, len(_MARKED.findall(text)) / n,
        len(_CAPITAL.findall(text)) / chars, sum(map(str.isdigit, text)) / chars, counts.get("|", 0) / n,
        text.count(".") / n, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / n]


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents with __features in place of the text, computed once; fit() and rank() take them so."""
    return store(_feature_rows(documents, [c for c in documents.columns if c != text], text))


def _feature_rows(documents: DataFrame, keep: list[str], text: str) -> DataFrame:
    if "__features" in documents.columns:
        return documents.select(*keep, "__features")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(v.as_py() or "") for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))],
                                             names=[*keep, "__features"])
    return documents.select(*keep, text).mapInArrow(run, f"{schema}, __features array<double>")


class RankModel:
    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, spread: float):
        self.centre, self.scale, self.weights, self.cut, self.spread = centre, scale, weights, cut, spread

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, increasing in the ranking score; CUT exactly where the ranking score is at the quantile."""
        raw = ((rows - self.centre) / self.scale) @ self.weights
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip((raw - self.cut) / self.spread + shift, -500, 500)))


def _sums(features: DataFrame, run, width: int) -> dict[int, np.ndarray]:
    """Sums over all tasks, by key, of the arrays of `width` numbers that run(y, x) gives for a batch of rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                for key, values in run(batch.column(0).to_numpy(), x):
                    total[key] = total.get(key, 0) + values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array(list(total.values()), pa.list_(pa.float64()))], names=["key", "s"])
    sums = [F.sum(F.get("s", i)) for i in range(width)]
    found = features.mapInArrow(add, "key int, s array<double>").groupBy("key").agg(F.array(*sums).alias("s")).collect()
    return {r.key: np.array(r.s) for r in found}


def _pair_terms(better: np.ndarray, worse: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slope and mixed curvature over all pairs of bins (count, sum of rows), and the curvature weight of each bin.

    A bin stands at its mean score. Blocks of bins are met in turn, so memory does not grow with their number squared.
    """
    (n1, z1), (n0, z0) = ((b[:, 0], b[:, 1:]) for b in (better, worse))
    s1, s0 = z1 @ weights / n1, z0 @ weights / n0
    slope, mixed = np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
    own1, own0 = np.zeros(len(n1)), np.zeros(len(n0))
    for first in range(0, len(n1), 512):
        rows = slice(first, first + 512)
        wrong = 1 / (1 + np.exp(np.clip(s1[rows, None] - s0, -500, 500)))
        slope += z1[rows].T @ (wrong @ n0) - z0.T @ (wrong.T @ n1[rows])
        bent = wrong * (1 - wrong)
        own1[rows] = bent @ n0
        own0 += bent.T @ n1[rows]
        mixed += z1[rows].T @ bent @ z0
    return slope, mixed, own1, own0


def fit(labelled: DataFrame, label: str = "quality", text: str = "text", sample_rows: int | None = None,
        id_col: str = "doc_id") -> RankModel:
    """Learn from all rows (text, label 0 or 1), null labels left out.

    Only where sample_rows is given, at most about that many rows are used, those with the smallest hash of id and text.

    The weights minimise the logistic loss of the feature differences over all pairs of one row of each label, with a
    ridge penalty. A pair's loss depends on its two ranking scores alone, so for each step the rows are summed by
    label and score bin, and the pairs of bins, each at its mean score, stand for the pairs of rows. The cut is the
    quantile of the ranking score that leaves the share of label 0 below it. With one label only there is no
    preference: all weights are 0 and the score is CUT for any text, or less for label 0 only.
    """
    key = F.xxhash64(*[c for c in (id_col, text) if c in labelled.columns])
    shown = F.col("__features") if "__features" in labelled.columns else F.coalesce(text, F.lit("")).alias("text")
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), key.alias("key"), shown)
    number = rows.count() if sample_rows is not None else 0
    if sample_rows is not None and number > sample_rows:
        rows = rows.where(F.pmod("key", F.lit(1 << 30)) < F.lit(int(sample_rows / number * (1 << 30))))
    made = store(_feature_rows(rows, ["y"], "text"))
    size = len(FEATURES)
    columns = [F.get("__features", i) for i in range(size)]
    seen = made.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1"), *[
        f(c).alias(f"{name}{i}") for name, f in (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))
        for i, c in enumerate(columns)]).first()
    n1, n0 = seen.n1, seen.n - seen.n1
    if not n1 or not n0:
        none = np.zeros(size)
        return RankModel(none, none + 1, none, 0.0 if not n0 else 1.0, 1.0)
    centre, scale, least, most = (np.array([seen[f"{name}{i}"] for i in range(size)]) for name in ("mean", "sd", "min", "max"))
    scale[scale < 1e-9] = 1.0
    least, most = (least - centre) / scale, (most - centre) / scale
    weights = np.zeros(size)
    for _ in range(30):
        low, high = (f(weights * least, weights * most).sum() for f in (np.minimum, np.maximum))
        width = max(high - low, 1e-9) / BINS

        def bins(z: np.ndarray, weights=weights, low=low, width=width) -> np.ndarray:
            return np.clip(((z @ weights - low) / width).astype(np.int64), 0, BINS - 1)

        def by_bin(y: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            z = (x - centre) / scale
            keys, place = np.unique(bins(z) + BINS * y, return_inverse=True)
            both = np.concatenate([np.ones((len(z), 1)), z], 1)
            yield from zip(keys.tolist(), np.stack([np.bincount(place, c, len(keys)) for c in both.T], 1))

        found = _sums(made, by_bin, size + 1)
        zero, one = (sorted(k for k in found if k // BINS == y) for y in (0, 1))
        slope, mixed, own1, own0 = _pair_terms(*(np.array([found[k] for k in ks]) for ks in (one, zero)), weights)
        curve = np.zeros(2 * BINS)
        curve[one], curve[zero] = own1, own0

        def bend_of(y: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            z = (x - centre) / scale
            yield 0, ((z * curve[bins(z) + BINS * y][:, None]).T @ z).ravel()

        bend = _sums(made, bend_of, size * size)[0].reshape(size, size) - mixed - mixed.T
        pairs = float(n1) * n0
        step = np.linalg.solve(bend / pairs + PENALTY * np.eye(size), slope / pairs - PENALTY * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-5:
            break

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(((x - centre) / scale) @ weights)], names=["raw"])
    raw = made.select("__features").mapInArrow(raw_scores, "raw double")
    ranked = running_sums(raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")), "raw", ["n"])
    spread, *middle = ranked.agg(
        F.sqrt(F.sum(F.col("n") * F.col("raw") * F.col("raw")) / F.sum("n")),  # the mean is 0
        *[F.max(F.when((F.col("prev_n") <= k) & (F.col("prev_n") + F.col("n") > k), F.col("raw"))) for k in (n0 - 1, n0)]).first()
    return RankModel(centre, scale, weights, sum(middle) / 2, max(1.0, spread))


def rank(documents: DataFrame, model: RankModel, text: str = "text") -> DataFrame:
    """The columns of documents but the text, with score (0 to 1); null and empty texts are scored like any other."""
    keep = [c for c in documents.columns if c not in (text, "__features", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(keep).schema)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(len(keep)).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sent.value.scores(found))],
                                             names=[*keep, "score"])
    return _feature_rows(documents, keep, text).mapInArrow(run, f"{schema}, score double")
