"""Ranked lexical search turned round: documents stream through an inverted index over the terms of the items.

The items are the small side. Their inverted index (term -> items with counts) goes to the tasks; each document's
term counts run through it once, and every task keeps a bounded heap of the best documents for each item. The heaps
are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import chunks, flat

TOP = 10
BLOCK_CHARS = 2_000_000
CELLS = 2_000_000
MERGERS = 64

# Bytes outside terms become blanks, A-Z lower case; all bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32
              for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z in lower case."""
    return text.translate(_FOLD).split()


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes]]:
    data, ends = flat(batch.column(column))
    raw, ends = data.tobytes(), ends.tolist()
    for start, stop in zip(ends, ends[1:]):
        yield terms(raw[start:stop])


def _statistics(texts: DataFrame, words: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each word the documents that hold it."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i + 2 for i, w in enumerate(sent.value)}
        found = Counter()
        for batch in chunks(batches, 0):
            for own in _texts(batch, 0):
                if own:
                    found[0] += 1
                    found[1] += len(own)
                    found.update(map(place.__getitem__, place.keys() & set(own)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.int32()),
                                          pa.array(list(found.values()), pa.int64())], names=["at", "n"])
    counts = np.zeros(len(words) + 2, np.int64)
    for at, n in texts.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    return int(counts[0]), int(counts[1]), counts[2:]


class Index:
    """Postings of the items' terms: for each known term the items that hold it and how often."""

    def __init__(self, items: list[bytes]):
        self.size = len(items)
        held: dict[bytes, list[tuple[int, int]]] = {}
        for item, text in enumerate(items):
            for term, n in Counter(terms(text)).items():
                held.setdefault(term, []).append((item, n))
        self.words = sorted(held)
        self.starts = np.cumsum([0, *(len(held[w]) for w in self.words)])
        self.items = np.array([i for w in self.words for i, _ in held[w]], np.int64)
        self.repeats = np.array([n for w in self.words for _, n in held[w]], np.int64)

    def scores(self, doc: np.ndarray, word: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """docs x items sums of value over the postings of (doc, word) entries."""
        out = np.zeros(docs * self.size, np.int64)
        per = self.starts[word + 1] - self.starts[word]
        entry = np.repeat(np.arange(len(word)), per)
        at = self.starts[word][entry] + np.arange(len(entry)) - (np.cumsum(per) - per)[entry]
        np.add.at(out, doc[entry] * self.size + self.items[at], value[entry] * self.repeats[at])
        return out.reshape(docs, self.size)


class Heaps:
    """The best `top` of (score, smaller id first, null ids last) for each item, and what a new one must beat."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score of 0 is no hit

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """scores is documents x items."""
        for doc, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.least))):
            key = ids[doc]
            entry = (int(scores[doc, item]), key is not None, 0 if key is None else -key)
            heap = self.held[item]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        rows = [(item, -key if known else None, score) for item, heap in enumerate(self.held)
                for score, known, key in heap]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()),
                                           pa.array(score, pa.int64())], names=["item", "doc_id", "score"])


def _best(texts: DataFrame, index: Index, n_docs: int, n_terms: int, holding: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): the best of every task."""
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    sent = texts.sparkSession.sparkContext.broadcast((index, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = sent.value
        place = {w: i for i, w in enumerate(index.words)}
        heaps = Heaps(index.size, top)
        most = max(1, CELLS // index.size)
        for batch in chunks(batches, 1):
            for begin in range(0, batch.num_rows, most):
                part = batch.slice(begin, most)
                doc, word, times, length = [], [], [], []
                for at, own in enumerate(_texts(part, 1)):
                    length.append(len(own))
                    counts = Counter(own)
                    known = place.keys() & counts.keys()
                    doc += [at] * len(known)
                    word += map(place.__getitem__, known)
                    times += map(counts.__getitem__, known)
                if not word:
                    continue
                doc, word, times = (np.array(x, np.int64) for x in (doc, word, times))
                m = 100 - 75 + 75 * np.array(length, np.int64) * n_docs // n_terms
                value = weights[word] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
                heaps.offer(index.scores(doc, word, value, part.num_rows), part.column(0).to_pylist())
        yield heaps.rows()
    return texts.select("doc_id", "text").mapInArrow(run, "item int, doc_id long, score long")


def _first(rows: DataFrame, top: int, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(documents: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id",
                  item_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents for every item, best first.

    Terms are the runs of ASCII letters and digits and of characters beyond ASCII in the whole text, A-Z in lower
    case. Of N documents with a term and L terms in all, a term held by df documents weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))). A document of n terms that holds it tf times scores
    w (10^9 tf div (1000 tf + 8 m)) with m = 25 + 75 n N div L, summed over the terms of the item, repeats included.
    Equal scores go by ascending doc_id, null ids last; scores of 0 are no hits. Null texts have no terms, items
    without a hit no rows. Every row of documents and of items stands for itself, also where it repeats another or
    has a null id. Ids are integers; other columns are not read.

    The items are read in blocks of about BLOCK_CHARS characters, each block against all documents, so that index
    and heaps have a bound however many items there are; documents are read twice a block, and only heaps leave
    a task.
    """
    spark = documents.sparkSession
    sought = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(text, F.lit("")).alias("text"))
    chars = sought.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in range(blocks):
        rows = sought.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = Index([r["text"].encode() for r in rows])
        n_docs, n_terms, holding = _statistics(texts, index.words)
        if not n_docs or not index.words:
            continue
        best = _best(texts, index, n_docs, n_terms, holding, top)
        best = _first(best, top, "item", F.pmod(F.xxhash64("doc_id"), F.lit(MERGERS)))
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        best = _first(best, top, "item").join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
