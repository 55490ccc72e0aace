"""Registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpoint_dir, cut
from . import language_id, quality_rank
from .decontaminate import benchmark_hits
from .embedding_forest import embedding_classes
from .lexical_search import ranked_search
from .license_scan import THRESHOLD, scan_licenses, templates
from .line_dedup import line_dedup
from .nearest import nearest_neighbours
from .pieces import encode_pieces
from .simhash import fingerprint_classes
from .source_divergence import source_divergence
from .token_files import token_digests, write_token_files
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every executor can write and read."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def query(name: str, sql: str | None = None):
    """Register fn(table), where table(name) reads a table of the scale folder."""
    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(lambda t: spark.read.parquet(f"{folder}/{t}.parquet"))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def remainder(divisor: int):
    """crc32 of doc_id as text, modulo divisor; a null id gives -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor, F.lit(-1))


@query("op1_language_id")
def _language_id(table):
    documents = table("documents")
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.fit(documents.where(remainder(4) != 2).select("lang", "text"), vocabulary)
    return (language_id.predict(documents.select("doc_id", "text"), model)
            .select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score"))


LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS spot,
                      unnest(string_split(text, chr(10))) AS line FROM documents),
solid AS (SELECT doc_id, spot, trim(line, ' ') AS line,
                 row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS place FROM split WHERE trim(line, ' ') <> ''),
pairs AS (SELECT doc_id, place, spot, lead(spot) OVER own AS next_spot, line, lead(line) OVER own AS next_line
          FROM solid WINDOW own AS (PARTITION BY doc_id ORDER BY place)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, place) AS nth
           FROM pairs WHERE next_line IS NOT NULL),
gone AS (SELECT doc_id, spot FROM ranked WHERE nth > 1 UNION SELECT doc_id, next_spot FROM ranked WHERE nth > 1),
kept AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.spot) AS text, count(*) AS lines
         FROM split s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.spot = g.spot GROUP BY s.doc_id),
lost AS (SELECT doc_id, count(*) AS lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, d.lang, d.source,
       d.n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id
"""


@query("op2_line_dedup", LINE_DEDUP_SQL)
def _line_dedup(table):
    return line_dedup(table("documents"))


@query("op3_simhash_classes")
def _simhash(table):
    return fingerprint_classes(table("documents"))


@query("op4_embedding_forest")
def _embedding_forest(table):
    return embedding_classes(table("embeddings"))


@query("op5_benchmark_hits")
def _benchmark_hits(table):
    return benchmark_hits(table("documents"), table("benchmark"))


@query("op6_token_files")
def _token_files(table):
    documents = table("documents")
    spark = documents.sparkSession
    folder = scratch(spark, "tokens")
    write_token_files(documents, folder, public_tokenizers.path("word_bpe_49k.json"))
    out = cut(token_digests(spark, folder).withColumnRenamed("id", "doc_id"))
    discard(spark, folder)
    return out


def _license_sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, k, t.replace("'", "''")) for i, (k, t) in enumerate(templates()))
    pairs = "list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]))"
    words = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    return f"""
WITH forms AS (SELECT form, license, CASE WHEN len(w) > 1 THEN {pairs} ELSE [] END AS b
               FROM (SELECT form, license, {words.format("t")} AS w FROM (VALUES {values}) v(form, license, t))),
lines AS (SELECT doc_id, 'line' AS scope, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS spot,
                 unnest(string_split(text, chr(10))) AS t FROM documents),
blocks AS (SELECT doc_id, 'block' AS scope,
                  generate_subscripts(string_split_regex(text, '\n[ \t\r]*\n'), 1) - 1 AS spot,
                  unnest(string_split_regex(text, '\n[ \t\r]*\n')) AS t FROM documents),
units AS (SELECT doc_id, scope, spot, {words.format("t")} AS w
          FROM (SELECT * FROM lines UNION ALL SELECT * FROM blocks WHERE contains(trim(t, ' '), chr(10)))),
sets AS (SELECT doc_id, scope, spot, {pairs} AS b FROM units WHERE len(w) > 1),
near AS (SELECT doc_id, scope, spot, license,
                (2 * len(list_intersect(s.b, f.b)))::DOUBLE / (len(s.b) + len(f.b)) AS dice
         FROM sets s JOIN forms f ON len(s.b) * {THRESHOLD} <= (2 - {THRESHOLD}) * len(f.b)
                                 AND len(f.b) * {THRESHOLD} <= (2 - {THRESHOLD}) * len(s.b))
SELECT doc_id, scope, CAST(spot AS INTEGER) AS "at", first(license ORDER BY dice DESC, license) AS license,
       max(dice) AS dice FROM near WHERE dice >= {THRESHOLD} GROUP BY doc_id, scope, spot"""


@query("op7_license_scan", _license_sql())
def _license_scan(table):
    return scan_licenses(table("documents"))


@query("op8_pieces")
def _pieces(table):
    coded = encode_pieces(table("documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", F.size("ids").alias("n_ids"), "ids_crc32",
                        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored"))


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", (remainder(5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


@query("op9_toxicity")
def _toxicity(table):
    return _judged(toxicity(table("documents").select("doc_id", "text"), table("labels"), remainder(5) != 0), 0.5)


@query("op10_quality_rank")
def _quality_rank(table):
    documents = quality_rank.measure(table("documents").select("doc_id", "text"))
    known = table("labels").where(remainder(5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = quality_rank.fit(documents.join(known, "doc_id"))
    return _judged(quality_rank.rank(documents, model), quality_rank.CUT)


SOURCE_DIVERGENCE_SQL = r"""
WITH bags AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS bag FROM documents),
kinds AS (SELECT DISTINCT lang, source FROM bags),
words AS (SELECT lang, source, id, term, count(*) AS n
          FROM (SELECT lang, source, id, unnest(bag) AS term FROM bags) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM words GROUP BY lang, term HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, sum(w.n) AS n FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term
           GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, s.v,
                 1 + (1000000000::HUGEINT * (k.n + 5)) // (s.total + 5 * s.v) AS q
          FROM kinds g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
          LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p
           FROM cells),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
          FROM kinds a JOIN kinds b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
rows AS (SELECT * FROM pairs UNION ALL
         SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", SOURCE_DIVERGENCE_SQL)
def _source_divergence(table):
    return source_divergence(table("documents"))


RANKED_SEARCH_SQL = r"""
WITH bags AS (SELECT doc_id, regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS bag FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(bag)::BIGINT AS n, bag FROM bags WHERE len(bag) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
counts AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf
           FROM (SELECT doc_id, n, unnest(bag) AS term FROM sizes) GROUP BY doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM counts, totals GROUP BY term),
sought AS (SELECT item_id, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT
                                   AS score
           FROM sought JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_ranked_search", RANKED_SEARCH_SQL)
def _ranked_search(table):
    return ranked_search(table("documents"), table("benchmark"))


@query("op13_nearest")
def _nearest(table):
    vectors = table("embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))
