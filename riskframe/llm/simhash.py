"""SimHash near-duplicates found through Golay-coded segments of the fingerprints.

The binary Golay code of length 23 puts every 23-bit word within 3 bits of one codeword. Two words that differ in
at most 2 bits have a common codeword within 4 bits of both, and a word has at most 6 codewords that near. So the
12-bit indices of the codewords near a segment are fuzzy keys: few, and sure to meet for up to two errors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, spread
from .arrow_text import chunks, flat, fresh
from .components import components
from .fingerprint import majority_bits, remix, shingle_hashes

RADIUS = 4
GROUP_LIMIT = 20_000
FOREST_LIMIT = 500_000

# Exact search over 64 bits: three segments (shift, width).
SEGMENTS = ((42, 22), (21, 21), (0, 21))

# Search over wide fingerprints, for similarities a 64-bit word cannot resolve.
WIDE_WORDS = 8
WIDE_SEGMENTS = 22
EXACT_BITS = 5
SENT_WORDS = 2  # words that candidates are compared by
SMALL_GROUP = 64
BLOCK_ROWS = 512

# The generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; per remainder the error patterns of up to 4 bits (6 columns) and their number.

    The first pattern is the coset's leader, of 3 bits or fewer. Unused columns repeat it.
    """
    upper = np.array([_remainder(x << 11) for x in range(4096)], np.int64)
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            found.setdefault(int(upper[error >> 11]) ^ (error & 2047), []).append(error)
    table = np.array([(found[s] + found[s][:1] * 6)[:6] for s in range(2048)], np.int64)
    return upper, table, np.array([len(found[s]) for s in range(2048)], np.int64)


_TABLES: list = []


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all codewords within 4 bits of each 23-bit segment (6 columns), and which columns hold one."""
    if not _TABLES:
        _TABLES.extend(_decoder())
    upper, table, number = _TABLES
    segment = segment.astype(np.int64)
    remainder = upper[segment >> 11] ^ (segment & 2047)
    return (segment[:, None] ^ table[remainder]) >> 11, np.arange(6) < number[remainder][:, None]


def exact_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that any two 64-bit words differing in at most 4 bits share, and the row of each key.

    Of three segments with at most 4 errors in all, either one is free of errors and one of the others has at most
    two (the first kind of key, six ordered pairs), or each has at most two (the second kind).
    """
    parts = [(words >> np.uint64(shift)) & np.uint64((1 << width) - 1) for shift, width in SEGMENTS]
    coded = [codeword_indices(p) for p in parts]
    rows, keys = [], []
    for kind, (sure, fuzzy) in enumerate(permutations(range(3), 2)):
        index, there = coded[fuzzy]
        row, column = np.nonzero(there)
        keys.append((kind << 36) | (parts[sure][row].astype(np.int64) << 12) | index[row, column])
        rows.append(row)
    (a, in_a), (b, in_b), (c, in_c) = coded
    for i in range(6):
        for j in range(6):
            row, column = np.nonzero(in_c & (in_a[:, i] & in_b[:, j])[:, None])
            keys.append((6 << 36) | (a[row, i] << 24) | (b[row, j] << 12) | c[row, column])
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def wide_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of wide fingerprints (rows of 64-bit words): each 23-bit segment's codewords with bits of the next one."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    scale = 1 << np.arange(22, -1, -1, dtype=np.int64)
    parts = [bits[:, 23 * s:23 * s + 23].astype(np.int64) @ scale for s in range(WIDE_SEGMENTS)]
    rows, keys = [], []
    for s, part in enumerate(parts):
        index, there = codeword_indices(part)
        row, column = np.nonzero(there)
        follow = parts[(s + 1) % WIDE_SEGMENTS][row] >> (23 - EXACT_BITS)
        keys.append((((7 + s) << EXACT_BITS | follow) << 12) | index[row, column])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


class Forest:
    """Keeps of many edges those that join two trees; forgets when it holds too many nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while up.setdefault(r, r) != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def joins(self, a: int, b: int) -> bool:
        if len(self.up) > FOREST_LIMIT:
            self.up.clear()
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning_edges(words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges between rows that differ in at most `most` bits, enough to connect all rows connected by such pairs."""
    edges, open_rows = [], np.arange(len(words))
    while len(open_rows) > 1:
        queue, open_rows = [int(open_rows[0])], open_rows[1:]
        while queue and len(open_rows):
            x = queue.pop()
            near = np.bitwise_count(words[open_rows] ^ words[x]).sum(1, dtype=np.int64) <= most
            reached = open_rows[near].tolist()
            edges += [(x, y) for y in reached]
            queue += reached
            open_rows = open_rows[~near]
    return edges


def near_pairs(words: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x < y that differ in at most `most` bits, y before ends[x], the end of the group of x."""
    ones, others = [], []
    rows, apart = np.arange(len(words)), 1
    while len(rows := rows[ends[rows] > rows + apart]):
        near = rows[np.bitwise_count(words[rows] ^ words[rows + apart]).sum(1, dtype=np.int64) <= most]
        ones.append(near)
        others.append(near + apart)
        apart += 1
    return (np.concatenate(ones), np.concatenate(others)) if ones else (rows, rows)


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bool, np.ndarray, pa.RecordBatch]]:
    """(whole, first rows of the groups, batch) over rows sorted by key (column 0), each group in one batch.

    A key with over `limit` rows comes in several batches with whole = False.
    """
    held = None
    large = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key = table.column(0).to_numpy()
        first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        if large is not None:
            stop = first[1] if key[0] == large and len(first) > 1 else (len(key) if key[0] == large else 0)
            if stop:
                yield False, np.zeros(1, np.int64), table.slice(0, stop)
                table, key = table.slice(stop), key[stop:]
                first = first[first >= stop] - stop
            if not len(key):
                held = None
                continue
            large = None
        last = int(first[-1])
        if last:
            yield True, first[:-1], table.slice(0, last)
        rest = table.slice(last).combine_chunks()
        if rest.num_rows > limit:
            yield False, np.zeros(1, np.int64), rest
            large, held = key[last], None
        else:
            held = rest.to_batches()[0]
    if held is not None:
        yield True, np.zeros(1, np.int64), pa.Table.from_batches([held])


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return np.stack([table.column(2 + w).to_numpy().view(np.uint64) for w in range(width)], axis=1)


def _compare(width: int, most: int, sides: bool):
    """A mapInArrow function over (key, id, w0.., [side]) sorted by key: edges (kind 0: a, b) that connect the ids of
    each key that are near, and the rows of oversized keys again (kind 1: key, id)."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for whole, first, table in _groups(batches, GROUP_LIMIT if not sides else 1 << 62):
            key, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int32)), pa.array(key),
                                                  pa.array(ids)], schema=schema)
                continue
            size = np.diff(np.concatenate((first, [len(key)])))
            words = _matrix(table, width)
            small = size <= SMALL_GROUP
            ends = np.repeat(np.where(small, first + size, 0), size)
            x, y = near_pairs(words, ends, most)
            out = list(zip(ids[x].tolist(), ids[y].tolist()))
            for g in np.flatnonzero(~small).tolist():
                at, n = int(first[g]), int(size[g])
                out += [(int(ids[at + i]), int(ids[at + j])) for i, j in spanning_edges(words[at:at + n], most)]
            out = [p for p in out if forest.joins(*p)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(out), np.int32)), pa.array([p[0] for p in out], pa.int64()),
                     pa.array([p[1] for p in out], pa.int64())], schema=schema)
    return run


def _bucket_pass(rows: DataFrame, width: int, most: int) -> DataFrame:
    """Edges (a, b) among the rows (key, id, w0..) of each key; keys of over GROUP_LIMIT rows go block by block.

    An oversized key is cut into blocks by a hash of the id, and every pair of blocks is a group of its own, so no
    task holds more than two blocks; in-group work is the only thing that grows faster than the rows.
    """
    def compared(df: DataFrame, sides: bool) -> DataFrame:
        return (df.repartition("key").sortWithinPartitions("key")
                .mapInArrow(_compare(width, most, sides), "kind int, a long, b long"))

    found = cut(compared(rows, False))
    over = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id"))
    edges = found.where("kind <> 1").select("a", "b")
    if over.isEmpty():
        return edges
    sizes = (over.groupBy("key").count()
             .select("key", F.ceil(F.col("count") / (GROUP_LIMIT // 2)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = (rows.join(cut(sizes), "key").withColumn("block", block).select("*", other)
             .withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
             .drop("blocks", "block", "other"))
    return edges.unionByName(compared(cells, True).select("a", "b"))


def fingerprints(df: DataFrame, text: str = "text", size: int = 4, words: int = 1) -> DataFrame:
    """The columns of df without the text, and fingerprint words w0.. over `size`-word shingles of the whole text."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(kept).schema]
                       + [f"w{w} long" for w in range(words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, len(kept)):
            hashes, offsets = shingle_hashes(*flat(batch.column(len(kept))), size)
            bits = [majority_bits(remix(hashes, w), offsets).view(np.int64) for w in range(words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, bits)],
                                             names=[*kept, *[f"w{w}" for w in range(words)]])
    return df.select(*kept, text).mapInArrow(run, schema)


def _key_rows(df: DataFrame, wide: bool, sent: int = 1) -> DataFrame:
    """(key, id, w0..) for every Golay key of (id, w0..), with the first `sent` words."""
    width = WIDE_WORDS if wide else 1
    names = [f"w{w}" for w in range(sent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids = part.column(0).to_numpy()
                words = np.stack([part.column(1 + w).to_numpy().view(np.uint64) for w in range(width)], axis=1)
                keys, rows = wide_keys(words) if wide else exact_keys(words[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(ids[rows]),
                     *[pa.array(words[rows, w].view(np.int64)) for w in range(sent)]], names=["key", "id", *names])
    return (spread(df.select("id", *[f"w{w}" for w in range(width)]))
            .mapInArrow(run, "key long, id long, " + ", ".join(f"{n} long" for n in names)))


def hamming_groups(words: DataFrame) -> DataFrame:
    """(node, component) of distinct 64-bit words `w0` under links of at most 4 differing bits; linked words only.

    Every such pair shares a key (see exact_keys), and all rows of a key are compared, so no link is lost.
    """
    rows = _key_rows(words.select(F.col("w0").alias("id"), "w0"), False)
    return components(_bucket_pass(rows, 1, RADIUS))


def fingerprint_classes(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row: 4-word shingles, links at 4 or fewer differing bits.

    The fingerprint is 16 lower-case hex digits; component_id is the smallest id reachable. Null and word-less
    texts have fingerprint zero and link like any other. Rows that repeat an id are rows of their own; a null id
    is never a component_id unless its whole component has null ids. An empty table gives no rows.
    """
    rows = cut(fingerprints(documents.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text"))
    firsts = cut(rows.groupBy("w0").agg(F.min("id").alias("first")))
    groups = hamming_groups(firsts)
    joined = firsts.join(groups.withColumnRenamed("node", "w0"), "w0", "left").select(
        "w0", "first", F.coalesce("component", "w0").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = cut(joined.join(smallest, "component").select("w0", "component_id"))
    return (rows.join(classes, "w0")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def similar_bits(similarity: float, words: int = WIDE_WORDS) -> int:
    """Differing bits to allow in a wide fingerprint for a shingle similarity (Jaccard) of at least this.

    Texts of equal length with Jaccard j have shingle vectors of cosine 2j / (1 + j), and a bit differs with
    probability angle / pi; three standard deviations are added so that pairs at the bound become candidates.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * words
    return int(np.ceil(bits * share + 3 * np.sqrt(bits * share * (1 - share))))


def _sets(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The distinct shingle hashes of each text, ascending, as bytes."""
    return [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def shingle_rows(df: DataFrame, size: int, words: int = 0, sets: bool = False) -> DataFrame:
    """(id, digest, [w0..], [shingles]) of (id, text); digest is the hash of the set of `size`-word shingles."""
    names = ["id", "digest", *[f"w{w}" for w in range(words)], *["shingles"] * sets]
    kinds = [df.schema["id"].dataType.simpleString(), *["long"] * (1 + words), *["binary"] * sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            hashes, offsets = shingle_hashes(*flat(batch.column(1)), size)
            own = _sets(hashes, offsets)
            digest = np.array([xxhash.xxh64_intdigest(x) for x in own], np.uint64).view(np.int64)
            bits = [majority_bits(remix(hashes, w), offsets).view(np.int64) for w in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest), *map(pa.array, bits),
                                              *[pa.array(own, pa.binary())] * sets], names=names)
    return df.select("id", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def similar_edges(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges between sets of Jaccard similarity or more, enough to connect all that such pairs connect."""
    size = np.array([len(x) for x in sets], np.int64)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(size)))
    seen = np.zeros(len(place) + 1, np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    edges, open_rows = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not open_rows[start]:
            continue
        queue, open_rows[start] = [start], False
        while queue and open_rows.any():
            x = queue.pop()
            mine = place[ends[x]:ends[x + 1]]
            seen[mine] = 1
            both = np.bincount(owner, weights=seen[place], minlength=len(sets))
            seen[mine] = 0
            union = size + size[x] - both
            reached = np.flatnonzero(open_rows & (both >= similarity * union - 1e-9)).tolist()
            edges += [(x, y) for y in reached]
            queue += reached
            open_rows[reached] = False
    return edges


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of similarity or more among the rows (component, node, shingles) of each component.

    A component of over BLOCK_ROWS rows is cut into blocks, and every pair of blocks is compared on its own.
    """
    sizes = cut(members.groupBy("component").count()
                .select("component", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = (members.join(sizes, "component").withColumn("block", block)
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
                     "node", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, first, table in _groups(batches, 1 << 62):
            nodes = table.column(1).to_pylist()
            ends = [*first.tolist(), len(nodes)]
            sets = [np.frombuffer(x, np.uint64) for x in table.column(2).to_pylist()]
            found = [(nodes[a + x], nodes[a + y]) for a, b in zip(ends, ends[1:]) if b - a > 1
                     for x, y in similar_edges(sets[a:b], similarity)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                                  pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicate_groups(documents: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id",
                          text: str = "text") -> DataFrame:
    """(id, component) of near duplicates by shingle sets; component is the smallest id of the group.

    Links are Jaccard similarities of the `size`-word shingle sets of at least `similarity`, computed exactly (over
    64-bit hashes). 512-bit fingerprints only search: candidates share a Golay index of one of 22 segments and
    EXACT_BITS of the next. Those whose first SENT_WORDS words differ in no more bits than similar_bits(similarity)
    allows are connected, and inside what is connected all shingle sets are compared. Equal sets are one class from the start, so copies cost one row.
    Texts without words, null ones too, are copies of each other. Rows with a null id are left out.
    """
    own = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    words = [f"w{w}" for w in range(WIDE_WORDS)]
    rows = cut(shingle_rows(own, size, WIDE_WORDS))
    classes = cut(rows.groupBy("digest").agg(F.min(F.struct("id", *words)).alias("first"))
                  .select(F.col("digest").alias("id"), F.col("first.id").alias("first"), *[f"first.{w}" for w in words]))
    near = _key_rows(classes, True, SENT_WORDS)
    edges = _bucket_pass(near, SENT_WORDS, similar_bits(similarity, SENT_WORDS))
    loose = components(edges)
    wanted = cut(classes.join(loose, F.col("id") == F.col("node")).select("node", "component", "first"))
    texts = own.join(wanted.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    sets = (shingle_rows(texts, size, 0, True).select(F.col("id").alias("first"), F.col("digest").alias("node"), "shingles"))
    members = cut(wanted.join(sets, ["first", "node"]).dropDuplicates(["node"]).select("component", "node", "shingles"))
    groups = components(_verified(members, similarity))
    named = cut(classes.select(F.col("id").alias("digest"), "first")
                .join(groups.withColumnRenamed("node", "digest"), "digest", "left")
                .select("digest", "first", F.coalesce("component", "digest").alias("group")))
    smallest = named.groupBy("group").agg(F.min("first").alias("component"))
    classed = cut(named.join(smallest, "group").select("digest", "component"))
    return rows.join(classed, "digest").select("id", "component")


def drop_near_duplicates(documents: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """The rows of documents but those that are near duplicates of a row with a smaller id; null ids stay.

    Of rows that repeat the smallest id of a group all stay, as an id names one document.
    """
    name = fresh("later_id", documents.columns)
    later = (near_duplicate_groups(documents, similarity, size, id_col, text).where("id <> component")
             .select(F.col("id").alias(name)).distinct())
    return documents.join(later, F.col(id_col) == F.col(name), "left_anti")
