"""Unigram piece encoding of whole texts: best segmentation over a double-array trie, byte fallback, exact decoding.

Blanks are shown by the marker, one is put ahead of the text, and every text comes back from its ids byte for byte:
characters that are no piece become their UTF-8 bytes, and a marker that the text itself holds is spelt in bytes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .word_cache import Cache, quiet_collector

MARK = "▁"
_ENDED = re.compile(r"([^\W_]+)([!-/:-@\[-`{-~]+)").fullmatch
_CHUNKS = re.compile(" *[^ ]+| +$").findall
TOGETHER = 8  # words of one length from which on they are encoded together
MOST_TOGETHER = 20_000
LONGEST_TOGETHER = 64


class DoubleArray:
    """A trie over byte strings in two arrays: the child of s by byte b is base[s] + b if check there is s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        number = [-1]
        for word, value in words.items():
            node = 0
            for b in word:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    number.append(-1)
                node = nxt
            number[node] = value
        taken = np.zeros(4 * len(children) + 1024, bool)
        taken[0] = True
        slot_of = [0] * len(children)
        base_of = [0] * len(children)
        last: dict[int, int] = {}  # nodes of equal fan-out are placed one after another
        queue = deque([0])
        while queue:
            node = queue.popleft()
            own = np.array(sorted(children[node]), np.int64)
            if not len(own):
                continue
            start = last.get(len(own), 1)
            while True:
                if start + 2 * 256 >= len(taken):
                    taken = np.concatenate([taken, np.zeros(len(taken), bool)])
                bases = np.arange(start, start + 256)
                fits = np.flatnonzero(~taken[bases[:, None] + own].any(axis=1))
                if len(fits):
                    break
                start += 256
            base = last[len(own)] = start + int(fits[0])
            base_of[node] = base
            taken[base + own] = True
            for b in own.tolist():
                slot_of[children[node][b]] = base + b
                queue.append(children[node][b])
        self.base, self.check, self.value = ([fill] * (len(taken) + 256) for fill in (0, -1, -1))
        for node, slot in enumerate(slot_of):
            self.base[slot], self.value[slot] = base_of[node], number[node]
            for b, child in children[node].items():
                self.check[base_of[node] + b] = slot
        self.check[0] = -2


class PieceModel:
    """Pieces of a sentencepiece file with unigram log scores.

    The file's order is by frequency, so a piece's chance is set by Zipf's law from its place (the file's own scores
    are merge ranks, not chances). A character without a piece costs `unknown` and is spelt in byte pieces.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        number = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        plain: list[int] = []
        for i in range(number):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a marker inside, so words cannot be cut apart")
                plain.append(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        chance = 1.0 / np.arange(1, len(plain) + 1)
        # In units of 2^-20, so that sums and ties are exact.
        self.score = dict(zip(plain, np.rint(np.log(chance / chance.sum()) * (1 << 20)).astype(int).tolist()))
        self.unknown = min(self.score.values()) - (10 << 20)
        self.trie = DoubleArray({model.id_to_piece(i).encode(): i for i in plain})
        self.kind = "<u2" if number <= 1 << 16 else "<u4"
        #: What stands ahead of a mark (its first, after a letter or digit) inside a piece: no cut after these.
        self.ahead: dict[str, set[str]] = {}
        for piece in map(model.id_to_piece, plain):
            for k in range(1, len(piece)):
                if piece[k - 1].isalnum() and not piece[k].isalnum():
                    self.ahead.setdefault(piece[k], set()).add(piece[:k])


    def arrays(self) -> tuple[np.ndarray, ...]:
        """The trie's base, check and value, and the scores by id."""
        if not hasattr(self, "_arrays"):
            score = np.zeros(len(self.bytes_of), np.int64)
            score[list(self.score)] = list(self.score.values())
            self._arrays = (*(np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)), score)
        return self._arrays


class Coder:
    """encode(text) -> array of ids, decode(ids) -> text."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.code = np.dtype(model.kind).char
        self.words = Cache(self._with_marks)
        self.heads = Cache(lambda w: self._ids([model.byte_id[10]]) + (self._word(w) if w else b""))
        self.chunks = Cache(lambda c: self._word(c.replace(" ", MARK)))
        self.ready: dict[str, bytes] = {}
        quiet_collector()

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _with_marks(self, word: str) -> bytes:
        """A blank and a word; the marks after it are coded apart if no piece could span the place."""
        split = _ENDED(word)
        if split is None:
            return self._word(MARK + word)
        ahead = self.model.ahead.get(split[2][0])
        if ahead and any((MARK + split[1]).endswith(a) for a in ahead):
            return self._word(MARK + word)
        return self.words[split[1]] + self.chunks[split[2]]

    def _word(self, marked: str) -> bytes:
        known = self.ready.get(marked)
        return self._ids(self.best(marked)) if known is None else known

    def prepare(self, texts: list[str]) -> None:
        """Encode the words of the texts that no cache has, all of one length together, for the calls of encode."""
        for cache in (self.words, self.heads, self.chunks):
            cache.trim()
        words: set[str] = set()
        heads: set[str] = set()
        for text in texts:
            first, *lines = text.split("\n")
            words.update(first.split(" "))
            for line in lines:
                head, *rest = line.split(" ")
                heads.add(head)
                words.update(rest)
        needed = heads - self.heads.keys()
        for word in words - self.words.keys():
            split = _ENDED(word)
            if split is not None:
                ahead = self.model.ahead.get(split[2][0])
                if not (ahead and any((MARK + split[1]).endswith(a) for a in ahead)):
                    needed.add(split[2])
                    word = split[1]
            needed.add(MARK + word)
        needed.discard("")
        by_length: dict[int, list[str]] = {}
        for marked in needed:
            by_length.setdefault(len(marked.encode()), []).append(marked)
        self.ready = {}
        for length, some in by_length.items():
            if len(some) < TOGETHER or length > LONGEST_TOGETHER:
                continue
            for start in range(0, len(some), MOST_TOGETHER):
                part = some[start:start + MOST_TOGETHER]
                self.ready.update(zip(part, map(self._ids, self.best_of_length(part, length))))

    def best_of_length(self, marked: list[str], n: int) -> list[list[int]]:
        """best() of words of n bytes each, step by step for all of them."""
        model = self.model
        base, check, value, score = model.arrays()
        raw = np.frombuffer("".join(marked).encode(), np.uint8).reshape(-1, n).astype(np.int64)
        none = -1 << 62
        top = np.full((len(raw), n + 1), none)
        top[:, 0] = 0
        came = np.zeros((len(raw), n + 1), np.int64)
        used = np.full((len(raw), n + 1), -1)
        for at in range(n):
            rows = np.flatnonzero(top[:, at] != none)
            if not len(rows):
                continue
            here, first = top[rows, at], raw[rows, at]
            width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            alone = np.ones(len(rows), bool)
            inside, slot = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for end in range(at, n):
                child = base[slot] + raw[rows[inside], end]
                goes = check[child] == slot
                inside, slot = inside[goes], child[goes]
                if not len(inside):
                    break
                ends = value[slot] >= 0
                mine, piece = inside[ends], value[slot[ends]]
                alone[mine[width[mine] == end + 1 - at]] = False
                new = here[mine] + score[piece]
                better = new > top[rows[mine], end + 1]
                mine, where = mine[better], rows[mine[better]]
                top[where, end + 1], came[where, end + 1], used[where, end + 1] = new[better], at, piece[better]
            lone = np.flatnonzero(alone)
            new = here[lone] + model.unknown
            better = new > top[rows[lone], at + width[lone]]
            where, to = rows[lone[better]], at + width[lone[better]]
            top[where, to], came[where, to], used[where, to] = new[better], at, -1
        out = []
        byte_id = model.byte_id
        for word, back, ids in zip(raw.tolist(), came.tolist(), used.tolist()):
            found, at = [], n
            while at:
                start = back[at]
                if ids[at] >= 0:
                    found.append(ids[at])
                else:
                    found += [byte_id[b] for b in reversed(word[start:at])]
                at = start
            out.append(found[::-1])
        return out

    def best(self, marked: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; of equal ones that with the longer last piece."""
        model = self.model
        base, check, value, score = model.trie.base, model.trie.check, model.trie.value, model.score
        raw = marked.encode()
        n = len(raw)
        none = -1 << 62
        top = [none] * (n + 1)
        top[0] = 0
        came = [0] * (n + 1)
        used = [-1] * (n + 1)
        for at in range(n):
            here = top[at]
            if here == none:
                continue
            slot = 0
            first = raw[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            alone = True
            for end in range(at, n):
                child = base[slot] + raw[end]
                if check[child] != slot:
                    break
                slot = child
                piece = value[slot]
                if piece >= 0:
                    if end + 1 == at + width:
                        alone = False
                    new = here + score[piece]
                    if new > top[end + 1]:
                        top[end + 1], came[end + 1], used[end + 1] = new, at, piece
            if alone and here + model.unknown > top[at + width]:
                top[at + width], came[at + width], used[at + width] = here + model.unknown, at, -1
        out: list[int] = []
        at = n
        while at:
            start = came[at]
            if used[at] >= 0:
                out.append(used[at])
            else:
                out += [model.byte_id[b] for b in reversed(raw[start:at])]
            at = start
        return out[::-1]

    def _line(self, line: str) -> bytes:
        """Ids of a line that a blank precedes."""
        if line.endswith(" ") or "  " in line or line.startswith(" "):
            chunks = self.chunks
            return b"".join([chunks[c] for c in _CHUNKS(" " + line)])
        words = self.words
        return b"".join([words[w] for w in line.split(" ")])

    def encode(self, text: str) -> np.ndarray:
        if MARK in text:  # a marker of the text itself is spelt in bytes, what follows it has no blank ahead
            spelt = self._ids([self.model.byte_id[b] for b in MARK.encode()])
            parts = text.split(MARK)
            rest = [self._tail(p) for p in parts[1:]]
            return np.frombuffer(spelt.join([self._text(parts[0]), *rest]), self.model.kind)
        return np.frombuffer(self._text(text), self.model.kind)

    def _text(self, text: str) -> bytes:
        lines = text.split("\n")
        out = [self._line(lines[0])]
        for line in lines[1:]:
            out.append(self._later(line))
        return b"".join(out)

    def _later(self, line: str) -> bytes:
        """Ids of a line break and the line after it."""
        head, blank, rest = line.partition(" ")
        return self.heads[head] + (self._line(rest) if blank else b"")

    def _tail(self, text: str) -> bytes:
        """Ids of text that no blank precedes."""
        lines = text.split("\n")
        head, blank, rest = lines[0].partition(" ")
        first = (self._word(head) if head else b"") + (self._line(rest) if blank else b"")
        return b"".join([first, *map(self._later, lines[1:])])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.model.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_MADE: dict[str, Coder] = {}


def encode_pieces(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """The columns of documents with `ids` (array of int), `decoded` (text from the ids) and `ids_crc32`.

    The checksum is of the ids as little-endian 32-bit integers. An empty or null text gives the marker alone and
    decodes to the empty text. Columns named ids, decoded or ids_crc32 are replaced.
    """
    new = ("ids", "decoded", "ids_crc32")
    keep = [c for c in documents.columns if c not in new]
    at = keep.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(keep).schema)
    sent = documents.sparkSession.sparkContext.broadcast(PieceModel(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker keeps the coder and its caches from task to task; the path says which vocabulary it has.
        if vocabulary not in _MADE:
            _MADE[vocabulary] = Coder(sent.value)
        coder = _MADE[vocabulary]
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [v or "" for v in part.column(at).to_pylist()]
                coder.prepare(texts)
                ids = [coder.encode(t) for t in texts]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()),
                                                pa.array(np.concatenate(ids).astype(np.int32)))
                decoded = pa.array([coder.decode(x) for x in ids], pa.string())
                sums = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, rows, decoded, sums], names=[*keep, *new])
    return documents.select(keep).mapInArrow(run, f"{schema}, ids array<int>, decoded string, ids_crc32 long")
