"""Removal of repeated runs of lines, found by winnowing over line hashes; DataFrame functions only.

Lines are hashed, blank lines left out. Of every window of `run_lines` hashes the smallest is a fingerprint, so two
equal runs of that many lines always share one at the same place. Fingerprints that occur once end there. Around the
others the windows are extended to both sides, equal windows are joined, and each but the first is a later repeat.
A longer equal run is covered by its windows, so exactly the lines of runs of `run_lines` or more that occurred
before are deleted. passage_dedup does the same over words, so that passages inside lines are found too: only windows
around a mark that occurs twice are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import Tables, cut
from .arrow_text import fresh

RUN_LINES = 2
RUN_WORDS = 51
SENT_ROWS = 1_000_000  # so many digests of changed texts may be broadcast; beyond them the texts are joined
HOT = 10_000  # places of a mark up to which its windows are compared in one partition


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _numbered(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, digest, lines array<struct<at, hash>>) of the lines that are not blank."""
    lines = F.transform(_lines(F.col(text)), lambda l, i: F.struct(i.alias("at"), F.trim(l).alias("line")))
    lines = F.filter(lines, lambda x: x["line"] != "")
    return documents.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"),
        F.transform(lines, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("hash"))).alias("lines"))


def repeated_lines(documents: DataFrame, run_lines: int = RUN_LINES, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(id, digest, lines) of the documents with lines to delete; lines holds their numbers from 0.

    digest is the hash of the text and tells rows of one id apart. Documents come in the order of id (null first)
    and digest; rows equal in both are one document.
    """
    hashes = cut(_numbered(documents, id_col, text).where(F.size("lines") >= run_lines))
    values = F.transform("lines", lambda x: x["hash"])
    last = F.size("lines") - run_lines
    # The smallest hash of each window; of equal ones the rightmost, so the choice depends on the content alone.
    picks = F.transform(F.sequence(F.lit(0), last), lambda s: F.struct(
        s.alias("window"),
        F.array_min(F.transform(F.sequence(F.lit(0), F.lit(run_lines - 1)),
                                lambda o: F.struct(F.get(F.col("values"), s + o).alias("mark"),
                                                   (-o).alias("back")))).alias("pick")))
    windows = (hashes.withColumn("values", values).withColumn("found", F.explode(picks))
               .select("id", "digest", F.col("found.window").alias("window"), F.col("found.pick.mark").alias("mark"),
                       F.slice("values", F.col("found.window") + 1, run_lines).alias("run")))
    anchored = windows.select("mark", F.struct("id", "digest", F.col("window").alias("at")).alias("where"),
                              F.xxhash64("run").alias("run"))
    # A window's first place; fingerprints seen once need no more, as min and max of their places agree.
    marks = (anchored.groupBy("mark").agg(F.min("where").alias("low"), F.max("where").alias("high"))
             .where("low <> high").select("mark"))
    candidates = cut(anchored.join(cut(marks), "mark", "left_semi"))
    firsts = cut(candidates.groupBy("mark", "run").agg(F.min("where").alias("first"), F.max("where").alias("final"))
                 .where("first <> final").select("mark", "run", "first"))
    later = candidates.join(cut(firsts), ["mark", "run"]).where("where <> first")
    numbers = cut(later.groupBy("where.id", "where.digest").agg(F.collect_set("where.at").alias("windows")))
    own = hashes.select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "lines")
    joined = numbers.join(own.dropDuplicates(["own_id", "own_digest"]),
                          F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")))
    spots = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "windows", lambda w: F.transform(F.slice("lines", w + 1, run_lines), lambda x: x["at"])))))
    return joined.select("id", "digest", spots.alias("lines"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rewritten(documents: DataFrame, marks: DataFrame, id_col: str, text: str, rebuild) -> DataFrame:
    """documents with text replaced by rebuild(text, gone) in the rows that marks (id, digest, gone) names.

    Only the texts to change are shuffled, as long as the list of their digests is small enough to broadcast.
    """
    own_id, own_digest, gone = (fresh(n, documents.columns) for n in ("own_id", "own_digest", "gone"))
    marks = cut(marks.select(F.col("id").alias(own_id), F.col("digest").alias(own_digest), F.col("gone").alias(gone)))
    digest = F.xxhash64(text)
    on = F.col(id_col).eqNullSafe(F.col(own_id)) & (digest == F.col(own_digest))
    columns = [F.col(f"`{c}`") for c in documents.columns]

    def changed(rows: DataFrame, how: str) -> DataFrame:
        new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(rebuild(F.col(text), F.col(gone)))
        return rows.join(marks, on, how).select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns])

    if marks.count() > SENT_ROWS:
        return changed(documents, "left")
    listed = cut(marks.select(F.col(own_digest).alias(own_digest)).distinct())
    same = digest == F.col(own_digest)
    touched = documents.join(F.broadcast(listed), same, "left_semi")
    rest = documents.join(F.broadcast(listed), same, "left_anti")
    return rest.select(*columns).union(changed(touched, "left"))


def line_dedup(documents: DataFrame, run_lines: int = RUN_LINES, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """The rows of documents with later repeats of runs of `run_lines` lines deleted from the text.

    Lines are compared without blanks at their ends; blank lines are skipped over and stay. Every row stays: a text
    of repeats only becomes empty, a null or empty text stays as it is, and so does one without repeats. The first
    occurrence is that of the smallest id (null first), then of the smaller hash of the text, then the upper one.
    Rows equal in id and text get the same result. Columns of other names pass through, whatever they are called.
    """
    def rebuild(whole: Column, gone: Column) -> Column:
        return _let(_lines(whole), lambda lines: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n"))

    marks = repeated_lines(documents, run_lines, id_col, text).withColumnRenamed("lines", "gone")
    return _rewritten(documents, marks, id_col, text, rebuild)


def _doubled(values: Column, width: int, to: int, merge) -> Column:
    """An array of values of `width` neighbours each made one of values of `to` neighbours each."""
    def paired(apart: int):
        return lambda v: F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - apart, F.lit(0))),
                                    F.slice(v, F.lit(apart + 1), F.greatest(F.size(v) - apart, F.lit(0))), merge)

    while width < to:
        apart = min(width, to - width)
        values = _let(values, paired(apart))
        width += apart
    return values


def _size(run_words: int) -> int:
    return 8 if run_words >= 16 else 1


def _grams(text: Column, run_words: int) -> Column:
    """Hashes of all grams of a text; a window of run_words words has run_words - _size(run_words) + 1 of them."""
    words = F.transform(F.array_remove(F.split(text, r"\s+"), ""), lambda w: F.xxhash64(w))
    return _doubled(words, 1, _size(run_words), lambda a, b: F.xxhash64(a, b))


def _runs(grams: Column, run_words: int) -> Column:
    """Hashes of all windows."""
    return _doubled(grams, _size(run_words), run_words, lambda a, b: F.xxhash64(a, b))


def _marks(grams: Column, run_words: int) -> Column:
    """The smallest gram of every window."""
    return _doubled(grams, 1, run_words - _size(run_words) + 1, lambda a, b: F.least(a, b))


def _segments(marks: Column) -> Column:
    """array<struct<mark, low, high>>: stretches of neighbouring windows with one mark."""
    def cutting(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1),
                          lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return _let(starts, lambda s: F.zip_with(
            s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(m))),
            lambda low, end: F.struct(F.get(m, low).alias("mark"), low.alias("low"), (end - 1).alias("high"))))
    return _let(marks, lambda m: F.when(F.size(m) > 0, cutting(m)).otherwise(
        F.array().cast("array<struct<mark: bigint, low: int, high: int>>")))


def _seen_inside(grams: Column, run_words: int) -> Column:
    """The windows of a text that repeat an earlier window of it; there are none unless a gram is there twice."""
    def later(ordered: Column) -> Column:
        pairs = F.zip_with(F.slice(ordered, F.lit(1), F.size(ordered) - 1), F.slice(ordered, F.lit(2), F.size(ordered) - 1),
                           lambda x, y: F.when(x["run"] == y["run"], y["at"]))
        return F.when(F.size(ordered) > 1, F.filter(pairs, lambda x: x.isNotNull())).otherwise(none)

    none = F.array().cast("array<int>")
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), none).otherwise(_let(
        F.array_sort(F.transform(_runs(grams, run_words), lambda x, i: F.struct(x.alias("run"), i.alias("at")))), later))


def _joined(windows: Column, width: int) -> Column:
    """array<struct<low, high>>: the words that windows (numbers in any order) cover, as stretches apart."""
    def cutting(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(w) - 1),
                         lambda i: (i == 0) | (F.get(w, i) > F.get(w, i - 1) + width))
        return _let(first, lambda f: F.zip_with(
            f, F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(w))),
            lambda low, end: F.struct(F.get(w, low).alias("low"), (F.get(w, end - 1) + width - 1).alias("high"))))
    return _let(F.array_sort(F.array_distinct(windows)), cutting)


def _later_windows(windows: DataFrame) -> DataFrame:
    """(id, digest, at) of rows (run, id, digest, at, hot) whose run an earlier document has.

    The windows of a mark with few places meet in one partition; those of a hot mark are reduced to the first document
    of each run ahead of the shuffle, and joined with that.
    """
    where = F.struct("id", "digest")
    cold = (windows.where("NOT hot").withColumn("first", F.min(where).over(Window.partitionBy("run")))
            .where(where > F.col("first")).select("id", "digest", "at"))
    hot = windows.where("hot")
    first = hot.groupBy("run").agg(F.min(where).alias("first"))
    return cold.unionByName(hot.join(first, "run").where(where > F.col("first")).select("id", "digest", "at"))


def repeated_words(documents: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(id, digest, gone) of the documents with words to delete; gone holds stretches of their numbers from 0.

    Winnowing as for lines: of each window the smallest gram is its mark, and neighbouring windows mostly share one.
    What is kept of a text is one row for each such stretch. Only the windows of marks that occur again, taken from
    the text to both sides of the mark, are compared. Documents come in the order of id (null first) and digest.
    Equal texts are one document; of those with a window all words of the later ones go.
    """
    tables = Tables(documents.sparkSession, "passages")
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    rows = rows.where(F.length("text") >= 2 * run_words - 1)
    # Taken apart in one expression: a filter or a second use of a column would compute the windows again.
    found = rows.select("id", "digest", _let(_grams(F.col("text"), run_words), lambda g: F.struct(
        (F.size(g) + (_size(run_words) - 1)).alias("words"), _seen_inside(g, run_words).alias("inside"),
        _segments(_marks(g, run_words)).alias("parts"))).alias("both"))
    found = tables.keep(found.select("id", "digest", "both.words", "both.inside", "both.parts"))
    found = found.where(F.size("parts") > 0)
    copies = tables.keep(found.groupBy("digest").agg(F.min(F.struct("id")).alias("first"), F.max(F.struct("id")).alias("last"))
                         .where("first <> last").select("digest", "first"))
    known = found.join(copies, "digest", "left")
    own = known.where(F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first.id"))).dropDuplicates(["id", "digest"])
    parts = tables.keep(own.select("id", "digest", F.inline("parts")))
    places = parts.groupBy("mark").agg(F.count("*").alias("places")).where("places > 1")
    parts = parts.join(tables.keep(places), "mark").select(
        "id", "digest", F.struct("low", "high", (F.col("places") > HOT).alias("hot")).alias("part"))
    chosen = tables.keep(parts.groupBy("id", "digest").agg(F.collect_list("part").alias("parts")))
    near = rows
    if chosen.count() <= SENT_ROWS:
        near = rows.join(F.broadcast(chosen.select("digest").distinct()), "digest", "left_semi")
    on = F.col("t.id").eqNullSafe(F.col("c.id")) & (F.col("t.digest") == F.col("c.digest"))
    near = near.alias("t").join(chosen.alias("c"), on).select("t.id", "t.digest", "text", "parts")
    taken = _let(_runs(_grams(F.col("text"), run_words), run_words), lambda r: F.flatten(F.transform(
        "parts", lambda p: F.transform(F.sequence(p["low"], p["high"]), lambda at: F.struct(
            F.get(r, at).alias("run"), at.alias("at"), p["hot"].alias("hot"))))))
    windows = near.select("id", "digest", F.explode_outer(taken).alias("x"))
    windows = tables.keep(windows.select("x.run", "id", "digest", "x.at", "x.hot"))
    inside = own.where(F.size("inside") > 0).select("id", "digest", F.explode("inside").alias("at"))
    gone = (_later_windows(windows).unionByName(inside).groupBy("id", "digest")
            .agg(F.collect_list("at").alias("windows")).select("id", "digest", _joined(F.col("windows"), run_words).alias("gone")))
    # Of equal texts the first keeps what no other text has before it; the others keep nothing.
    equal = (known.where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")))
             .dropDuplicates(["id", "digest"]).select("id", "digest", F.array(
                 F.struct(F.lit(0).alias("low"), (F.col("words") - 1).alias("high"))).alias("gone")))
    out = cut(gone.unionByName(equal))
    tables.drop()
    return out


def passage_dedup(documents: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The rows of documents with later repeats of passages of `run_words` words or more deleted from the text.

    Words are runs outside white space, compared as they are, whatever the line breaks; a word goes with the white
    space after it. A passage may begin and end anywhere. Every row stays; the first occurrence is found as in
    line_dedup, and rows equal in id and text get the same result. Columns of other names pass through.
    """
    def rebuild(whole: Column, gone: Column) -> Column:
        shift = F.when(whole.rlike(r"^\s"), 1).otherwise(0)  # white space at the start is a piece without a word
        words = F.flatten(F.transform(gone, lambda g: F.sequence(g["low"] + shift, g["high"] + shift)))
        return _let(F.split(whole, r"(?<=\s)(?=\S)"), lambda pieces: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), words), lambda i: F.get(pieces, i)), ""))

    return _rewritten(documents, repeated_words(documents, run_words, id_col, text), id_col, text, rebuild)
