"""How far the sources of a language differ in their words, in exact integer arithmetic.

CountVectorizer with an absolute minDF and the largest vocabSize gives every language its kept terms and every
document an exact sparse vector of counts. The vectors are summed by source, and pairs of sources are evaluated over
the terms that they hold: a term that neither holds differs by a constant of the pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import Tables, cut
from .arrow_text import flat

LEAST_DOCUMENTS = 30
TOP = 50
EVERY_TERM = 2**31 - 1
UNIT = 1_000_000_000
PRIOR = 5
# Bytes outside terms become blanks, A-Z lower case; all bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_COUNTS = "lang string, source string, at int, n long"


def _folded(rows: DataFrame) -> DataFrame:
    """(number, source, text): the texts with terms in lower case, parted and preceded by blanks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat(batch.column(2))
            texts = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(ends.astype(np.int64)),
                                                     pa.py_buffer(data.tobytes().translate(_FOLD)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts.cast(pa.string())],
                                             names=["number", "source", "text"])
    return rows.select("number", "source", "text").mapInArrow(run, "number int, source string, text string")


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT (n + PRIOR) / total) in integers wide enough for any count; null where total is 0."""
    return F.expr(f"1 + cast({n} + {PRIOR} as decimal(28, 0)) * {UNIT} div cast(nullif({total}, 0) as decimal(28, 0))")


def _term_counts(rows: DataFrame, langs: list, least: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(lang, source, at, n) summed over the documents' vectors, and (lang, at, term) of the kept terms.

    Every row of `rows` (number, source, text) begins with an empty term, which keeps no vocabulary empty.
    """
    spark = rows.sparkSession
    parts, words = [], []
    for number, lang, documents in langs:
        if documents < least:
            continue
        mine = rows.where(F.col("number") == number).select("source", F.split(F.concat(F.lit(" "), "text"), " ").alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least), vocabSize=EVERY_TERM).fit(mine)
        vocabulary = model.vocabulary
        vector = F.unwrap_udt("vector")
        cells = model.transform(mine).select("source", F.inline(F.arrays_zip(
            vector["indices"].alias("at"), vector["values"].alias("n"))).alias("at", "n"))
        parts.append(cells.where(F.col("at") != vocabulary.index("")).groupBy("source", "at")
                     .agg(F.sum(F.col("n").cast("long")).alias("n"))
                     .select(F.lit(lang).alias("lang"), "source", "at", "n"))
        words.append(spark.createDataFrame(pa.table({"at": pa.array(range(len(vocabulary)), pa.int32()),
                                                     "term": pa.array(vocabulary, pa.string())}))
                     .where("term <> ''").select(F.lit(lang).alias("lang"), "at", "term"))
    if not parts:
        return spark.createDataFrame([], _COUNTS), spark.createDataFrame([], "lang string, at int, term string")
    return tables.keep(reduce(DataFrame.unionByName, parts)), reduce(DataFrame.unionByName, words)


def _pairs(groups: DataFrame, cells: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of every two sources of a language, both ways.

    Of two sources with shares p, and p0 for terms they do not hold, the sum over all kept terms is that of
    |p - p0 of the other| over the terms of each, plus, for terms of both, |p - p'| - |p - p0'| - |p0 - p'| + |p0 - p0'|,
    plus |p0 - p0'| for each kept term less those held by either one.
    """
    own = groups.select("lang", "source", "v", "p0", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("terms_2"))
    both = own.join(other, "lang").where("source <> item")
    rest = both.select("lang", "source", "item",
                       F.expr("coalesce((v - terms - terms_2) * abs(p0 - q0), 0)").alias("value"))
    levels = cells.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = (both.select("lang", "source", "item", "q0").join(levels, ["lang", "source"])
             .groupBy("lang", "source", "item").agg(F.expr("sum(times * abs(p - q0))").alias("value")))
    # Sources stand sorted in `held`, so every two that share a term meet once.
    shared = (held.select("lang", "held", F.posexplode("held").alias("i", "x"))
              .select("lang", "x", F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("y"))
              .groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"))
              .agg(F.expr("sum(abs(x.p - y.p) - abs(x.p - y.p0) - abs(x.p0 - y.p) + abs(x.p0 - y.p0))").alias("value")))

    def swapped(rows: DataFrame) -> DataFrame:
        return rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    parts = [rest, alone, swapped(alone), shared, swapped(shared)]
    return reduce(DataFrame.unionByName, parts).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, text: str = "text",
                      lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence audit of every (lang, source) group.

    Null text, lang and source count as ''. A language keeps the V terms that at least `least` of its documents
    hold. A group, or a whole language, in which a kept term occurs n times of N occurrences of kept terms, gives it
    p = 1 + floor(10^9 (n + 5) / (N + 5 V)). Part `pair` has a row for every other source of the language, its value
    the sum of |p - p'| over all kept terms, 0 without any. Part `term` has the `top` terms that the group holds and
    gives more than the whole language does, its value the difference. Ranks begin at 1 for each group and part,
    highest value first, equal ones by the UTF-8 order of the item. Every row counts, repeated ones as well; texts
    without terms still make their group; an empty table gives no rows. Other columns are not read.

    The kept terms of one language pass through the driver, as CountVectorizer builds its vocabulary there; nothing
    else does. Documents are written once by language, with all but their terms blanked. A hot group costs its partial
    sums, and a term held by all sources as many pairs as the result has.
    """
    spark = documents.sparkSession
    tables = Tables(spark, "divergence")
    rows = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (
        (lang, "lang"), (source, "source"), (text, "text"))])
    sizes = cut(rows.groupBy("lang", "source").agg(F.count("*").alias("documents")))
    known = sizes.groupBy("lang").agg(F.sum("documents").alias("documents")).orderBy("lang").collect()
    if not known:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    langs = [(i, r["lang"], r["documents"]) for i, r in enumerate(known)]
    numbers = spark.createDataFrame([x[:2] for x in langs], "number int, lang string")
    folder = f"{tables.folder}/texts"
    _folded(rows.join(numbers, "lang")).write.partitionBy("number").parquet(folder)
    stored = spark.read.schema("source string, text string, number int").parquet(folder)
    counts, vocabulary = _term_counts(stored, langs, least, tables)
    kept = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    groups = (sizes.select("lang", "source").join(kept, "lang", "left")
              .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms")),
                    ["lang", "source"], "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "total", "terms")]))
    groups = cut(groups.withColumn("p0", _share("0", f"total + {PRIOR} * v")))
    cells = (counts.join(groups, ["lang", "source"])
             .select("lang", "source", "at", "n", "p0", _share("n", f"total + {PRIOR} * v").alias("p")))
    held = tables.keep(cells.groupBy("lang", "at").agg(
        F.sort_array(F.collect_list(F.struct("source", "p", "p0", "n"))).alias("held"), F.sum("n").alias("all_n")))
    cells = held.select("lang", "at", "all_n", F.inline("held"))
    pairs = _pairs(groups, cells, held)
    whole_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    above = (cells.join(whole_lang, "lang").withColumn("q", _share("all_n", f"total + {PRIOR} * v")).where("p > q")
             .join(vocabulary, ["lang", "at"]).select("lang", "source", F.col("term").alias("item"),
                                                      F.expr("p - q").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")),
              above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
              .withColumn("part", F.lit("term"))]
    out = cut(ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank"))
    tables.drop()
    return out
