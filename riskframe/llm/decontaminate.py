"""Benchmark items found in documents up to a share of wrong characters.

An item with at most k errors, cut into k + 1 pieces, has a piece without error (pigeonhole). All pieces are searched
exactly in one pass over each whole text (Aho-Corasick), and where one is hit, Myers' bit-parallel edit distance
decides over the stretch the item could cover.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import fresh

ERROR_RATE = 0.08
BLOCK_CHARS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_HITS = "doc_id long, item_id long, start int, end int, distance int"


def normalise(text: str) -> str:
    """Runs of letters and digits in lower case, joined by one blank."""
    return " ".join(_WORD.findall(text)).lower()


def pieces(length: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 adjoining stretches of nearly equal length."""
    cuts = [length * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to the pattern in edit distance; the first of equal ones."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    get = bits.get
    for at, c in enumerate(text, 1):
        match = get(c, 0)
        across = match | minus
        match |= (((match & plus) + plus) ^ plus)
        up = minus | (~(match | plus) & full)
        down = plus & match
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (~(across | up) & full)
        minus = up & across
        if score < best:
            best, end = score, at
    return best, end


class Finder:
    """Searches normalised texts for items (id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick
        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            errors = int(rate * len(text))
            number = len(self.items)
            self.items.append((item, text, errors, masks(text), masks(text[::-1])))
            for start, stop in pieces(len(text), errors):
                where.setdefault(text[start:stop], []).append((number, start))
        self.automaton = None
        if where:
            self.automaton = ahocorasick.Automaton()
            for piece, places in where.items():
                self.automaton.add_word(piece, (len(piece), places))
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance), the nearest match of each stretch, stretches of one item apart."""
        if self.automaton is None:
            return []
        begins: dict[int, list[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for number, start in places:
                begins.setdefault(number, []).append(last + 1 - size - start)
        out = []
        for number, found in begins.items():
            item, pattern, errors, ahead, back = self.items[number]
            found.sort()
            done = 0
            at = 0
            while at < len(found):
                low = high = found[at]
                at += 1
                while at < len(found) and found[at] - high <= 2 * errors:
                    high = found[at]
                    at += 1
                begin, stop = max(done, low - errors), high + len(pattern) + errors
                stretch = text[max(0, begin):stop]
                distance, end = best_end(ahead, len(pattern), stretch)
                while distance <= errors:
                    start = end - best_end(back, len(pattern), stretch[:end][::-1])[1]
                    out.append((item, begin + start, begin + end, distance))
                    begin = done = begin + end
                    stretch = stretch[end:]
                    distance, end = best_end(ahead, len(pattern), stretch)
        return out


def _spans(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same matches with offsets in the original text."""
    starts, ends, place, at = [], [], [], 0
    for m in _WORD.finditer(text):
        place.append(at)
        starts.append(m.start())
        ends.append(m.end())
        at += len(m.group().lower()) + 1
    out = []
    for item, start, end, distance in found:
        first, last = max(0, bisect_right(place, start) - 1), max(0, bisect_right(place, end - 1) - 1)
        out.append((item, starts[first], ends[last], distance))
    return out


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, distance): stretches of documents that are an item but for rate of its characters.

    Both texts are compared as normalise() gives them; start and end are offsets into the original text, widened to
    whole words. Every match of an item is a row, overlapping ones of the same item are one. Items that are null or
    without letters and digits match nothing, and neither do null and empty texts. Repeated rows on either side give
    their own rows; null ids stay null. The items are read in blocks of about BLOCK_CHARS characters, each block
    against all documents, so that what a task holds is bounded however long the benchmark is.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    session = documents.sparkSession
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()),
                        ("distance", pa.int32())])
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        known = sorted(((r[0], normalise(r[1])) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        sent = session.sparkContext.broadcast([x for x in known if x[1]])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value, rate)
            for batch in batches:
                hits = []
                for doc, value in zip(batch.column(0), batch.column(1)):
                    value = value.as_py()
                    found = finder.find(normalise(value)) if value else []
                    if found:
                        hits += [(doc.as_py(), *hit) for hit in _spans(value, found)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits), schema)],
                                                     schema=schema)
        part = texts.mapInArrow(run, _HITS)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of documents without any stretch that is a benchmark item; rows with a null doc_id stay."""
    name = fresh("hit_id", documents.columns)
    hits = benchmark_hits(documents, benchmark, rate).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(hits, F.col("doc_id") == F.col(name), "left_anti")
