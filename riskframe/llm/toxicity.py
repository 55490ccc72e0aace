"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are learnt entries (whole words, and beginnings of words) and typographic patterns. The label model has a
rate for every voter in each class and the correlations between voters within a class; it is fitted by expectation
maximisation over the votes of all documents, labelled ones keeping their label. A logistic classifier of the votes
is trained on the posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .word_cache import LIMIT

SUPPORT = 4
PRECISION = 0.6
PRIOR_WEIGHT = 4.0
OWN_VOTERS = 40
SHARED_VOTERS = 16
LEXICON_BLOCK = 200_000  # entries that a task holds at a time
SENT_ROWS = 500_000  # so many text hashes may be broadcast; beyond them the labelled texts are joined
ROUNDS = 6
BEGINNINGS = (3, 4, 5, 6)

_WORDS = re.compile(r"[^\W\d_]+").findall
# Pattern voters: shouting, insistent marks, masked words, and being told to go.
PATTERNS = tuple(re.compile(p) for p in (r"\b[^\W\d_a-zß-ÿ]{4,}\b.*\b[^\W\d_a-zß-ÿ]{4,}\b", r"[!?]{2,}",
                                         r"\w[*@#$%]{2,}\w", r"\b(?:shut up|go away|get lost)\b"))
# The last voter speaks, for the clean side, where no entry of the lexicon does. Silence of any other is no evidence.
VOTERS = OWN_VOTERS + SHARED_VOTERS + len(PATTERNS) + 1


def entries_of(text: str) -> set[str]:
    """Distinct words in lower case, and as `abc*` the beginnings of longer ones."""
    words = set(_WORDS(text.lower()))
    out = set(words)
    for size in BEGINNINGS:
        out.update([w[:size] + "*" for w in words if len(w) > size])
    return out


def _entry_counts(texts: DataFrame) -> DataFrame:
    """(entry, toxic, n): weight of the rows (y, weight, text) with the entry, and of those with label 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[float]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), *[pa.array([c[i] for c in counts.values()], pa.float64()) for i in (0, 1)]],
                names=["entry", "toxic", "n"])
            counts.clear()

        for batch in batches:
            for y, weight, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for entry in entries_of(text.as_py() or ""):
                    own = counts.setdefault(entry, [0.0, 0.0])
                    own[0] += y * weight
                    own[1] += weight
                if len(counts) > LIMIT:
                    yield from flush()
        yield from flush()
    return (texts.select("y", "weight", "text").mapInArrow(run, "entry string, toxic double, n double")
            .groupBy("entry").agg(F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("n"), 6).alias("n")))


def _hashes(text: str = "text") -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")]


def distinct_texts(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(y, weight, text) of the rows (text) whose text hash (h1, h2, y) is labelled, and the numbers of texts in all and of label 1.

    Equal texts weigh 1 together. Only hashes are shuffled and kept; texts are met where they are read, as long as
    the labelled hashes are few enough to broadcast, and joined with them beyond that.
    """
    copies = rows.select(*_hashes()).groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    known = cut(labels.groupBy("h1", "h2").agg(F.max("y").alias("y")).join(copies, ["h1", "h2"])
                .select("h1", "h2", "y", (1 / F.col("copies")).alias("weight")))
    texts, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    sent = F.broadcast(known) if texts <= SENT_ROWS else known
    return rows.select("text", *_hashes()).join(sent, ["h1", "h2"]).select("y", "weight", "text"), texts, toxic


def passing_entries(texts: DataFrame, number: int, toxic: int) -> DataFrame:
    """(entry, toxic, n, share, evidence) of the entries that tell label 1, kept in the checkpoint folder.

    An entry passes with a smoothed share of label 1 of PRECISION or more in SUPPORT texts or more; the share is pulled
    towards the base rate by PRIOR_WEIGHT texts, and evidence is the log likelihood ratio of the entry's own share
    against the base rate. Entries that a passing beginning covers are left out, no others.
    """
    base = toxic / number
    share = (F.col("toxic") + PRIOR_WEIGHT * base) / (F.col("n") + PRIOR_WEIGHT)
    clean = F.col("n") - F.col("toxic")
    evidence = F.col("toxic") * F.ln(F.col("toxic") / F.col("n") / base) + F.when(
        clean > 0, clean * F.ln(clean / F.col("n") / (1 - base))).otherwise(0.0)
    passing = cut(_entry_counts(texts).withColumn("share", share).where(
        (F.col("toxic") >= SUPPORT) & (F.col("share") >= max(PRECISION, min(0.95, 3 * base)))))
    # A beginning occurs in every text that its longer entries occur in, so it needs no order to come before them.
    word = F.regexp_replace("entry", r"\*$", "")
    starts = F.filter(F.array(*[F.when(F.length("word") > size, F.concat(F.substring("word", 1, size), F.lit("*")))
                                for size in BEGINNINGS]), lambda x: x.isNotNull())
    covers = passing.where(F.endswith("entry", F.lit("*"))).select(F.col("entry").alias("start"))
    spelt = passing.select("entry", word.alias("word"))
    covered = (spelt.select("entry", F.explode(starts).alias("start")).join(covers, "start", "left_semi")
               .select("entry").distinct())
    return cut(passing.join(covered, "entry", "left_anti").withColumn("evidence", F.round(evidence, 9)))


def _by_evidence(passing: DataFrame) -> DataFrame:
    return passing.orderBy(F.desc("evidence"), F.length("entry"), "entry")


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """The passing entries of rows (y, text), most evidence first; equal texts count once, with label 1 if any has it."""
    rows = labelled.where("text IS NOT NULL")
    texts, number, toxic = distinct_texts(rows, rows.select("y", *_hashes()))
    if not toxic or toxic == number:
        return []
    return [r["entry"] for r in _by_evidence(passing_entries(texts, number, toxic)).collect()]


def lexicon_blocks(passing: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """(entry, voter), in blocks of about LEXICON_BLOCK entries, however many pass.

    The entries of most evidence have a voter each, the others share one with those of a like share of label 1.
    """
    own = [r["entry"] for r in _by_evidence(passing).limit(OWN_VOTERS).collect()]
    yield [(entry, voter) for voter, entry in enumerate(own)]
    band = F.least(F.lit(SHARED_VOTERS - 1), F.greatest(F.lit(0), F.floor(
        (F.col("share") - PRECISION) / (1 - PRECISION) * SHARED_VOTERS))).cast("int")
    rest = passing.where(~F.col("entry").isin(own)).select("entry", (band + OWN_VOTERS).alias("voter"))
    blocks = -(-rest.count() // LEXICON_BLOCK)
    for block in range(blocks):
        yield [tuple(r) for r in rest.where(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == block).collect()]


class Voters:
    """Votes of a text as the bits of one number."""

    def __init__(self, lexicon: list[tuple[str, int]]):
        self.words = {entry: 1 << voter for entry, voter in lexicon if not entry.endswith("*")}
        self.beginnings = {entry[:-1]: 1 << voter for entry, voter in lexicon if entry.endswith("*")}
        self.sizes = sorted({len(b) for b in self.beginnings})

    def votes(self, text: str) -> int:
        """Of the entries alone."""
        out = 0
        words = set(_WORDS(text.lower()))
        for w in words & self.words.keys():
            out |= self.words[w]
        for size in self.sizes:
            for b in {w[:size] for w in words if len(w) > size} & self.beginnings.keys():
                out |= self.beginnings[b]
        return out


def with_patterns(votes: int, text: str) -> int:
    """The votes of the patterns too, and that of the clean side where no entry speaks."""
    out = votes or 1 << (VOTERS - 1)
    for i, pattern in enumerate(PATTERNS):
        if pattern.search(text):
            out |= 1 << (OWN_VOTERS + SHARED_VOTERS + i)
    return out


def _bits(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS) & 1).astype(float)


def _sums(patterns: DataFrame, value) -> list[np.ndarray]:
    """value(votes, y, n) gives arrays per batch; their sums over all rows, a few numbers from each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = value(_bits(batch.column(0).to_numpy()), batch.column(1).to_numpy(), batch.column(2).to_numpy())
            total = part if total is None else [a + b for a, b in zip(total, part)]
        for i, array in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(array.size, i, np.int32)),
                                              pa.array(np.arange(array.size, dtype=np.int32)),
                                              pa.array(array.ravel().astype(float))], names=["i", "at", "v"])
    got = patterns.mapInArrow(run, "i int, at int, v double").groupBy("i", "at").agg(F.sum("v").alias("v")).toPandas()
    out = []
    for _, part in got.sort_values(["i", "at"]).groupby("i"):
        out.append(part["v"].to_numpy())
    return out


class LabelModel:
    """P(toxic), the rate of each voter in both classes, and a weight of each voter that undoes double counting."""

    def __init__(self, prior: float, rates: np.ndarray, weights: np.ndarray):
        self.prior, self.rates, self.weights = prior, rates, weights

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        clean, toxic = self.rates
        odds = np.log(self.prior / (1 - self.prior)) + bits @ (self.weights * np.log(toxic / clean))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def believed(self, bits: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(y >= 0, y, self.posterior(bits))


def fit_label_model(patterns: DataFrame, base: float) -> LabelModel:
    """From rows (votes, y, n): a vote pattern, its label (-1: none) and the number of its documents."""
    model = LabelModel(base, np.stack([np.full(VOTERS, 0.01), np.full(VOTERS, 0.1)]), np.ones(VOTERS))

    for turn in range(ROUNDS):
        def moments(bits, y, n, model=model, first=turn == 0):
            # The first round learns from labelled rows alone.
            weight = n * (y >= 0) if first else n
            q = model.believed(bits, y)
            sides = (weight * (1 - q), weight * q)
            return [np.array([s.sum() for s in sides]), np.stack([s @ bits for s in sides]),
                    np.stack([(bits * s[:, None]).T @ bits for s in sides])]

        mass, ones, both = _sums(patterns, moments)
        ones, both = ones.reshape(2, VOTERS), both.reshape(2, VOTERS, VOTERS)
        rates = (ones + 0.05 * np.array([[0.1], [1.0]])) / (mass[:, None] + 0.1)
        rates = np.clip(rates, 1e-6, 1 - 1e-6)
        link = np.zeros((VOTERS, VOTERS))
        for side in range(2):  # correlation within a class is what conditional independence leaves out
            share = both[side] / max(mass[side], 1e-9)
            spread = np.sqrt(rates[side] * (1 - rates[side]))
            rho = (share - np.outer(rates[side], rates[side])) / np.maximum(np.outer(spread, spread), 1e-9)
            link += np.clip(rho, 0, 1) / 2
        np.fill_diagonal(link, 0)
        link[link < 0.1] = 0
        prior = float(np.clip(mass[1] / max(mass.sum(), 1e-9), 1e-4, 1 - 1e-4))
        model = LabelModel(prior, rates, 1 / (1 + link.sum(1)))
    return model


def fit_classifier(patterns: DataFrame, model: LabelModel, penalty: float = 0.1) -> np.ndarray:
    """Intercept and weights of a logistic regression of the posterior labels on the votes, by Newton steps."""
    weights = np.zeros(VOTERS + 1)
    for _ in range(8):
        def newton(bits, y, n, weights=weights):
            x = np.concatenate([np.ones((len(bits), 1)), bits], axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
            return [x.T @ (n * (model.believed(bits, y) - p)), (x * (n * p * (1 - p))[:, None]).T @ x]

        slope, bend = _sums(patterns, newton)
        ridge = np.full(VOTERS + 1, penalty)
        ridge[0] = 1e-6
        step = np.linalg.solve(bend.reshape(VOTERS + 1, -1) + np.diag(ridge), slope - ridge * weights)
        weights = weights + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _vote_rows(documents: DataFrame, blocks: Iterator[list[tuple[str, int]]]) -> DataFrame:
    """(id, learn, votes) of rows (id, learn, text): the texts pass by one block of the lexicon after the other."""
    kind = documents.schema["id"].dataType.simpleString()
    send = documents.sparkSession.sparkContext.broadcast

    def run(sent, last: bool):
        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voters = Voters(sent.value) if sent is not None else None
            for batch in batches:
                found = []
                for before, text in zip(batch.column(3).to_pylist(), batch.column(2)):
                    text = text.as_py() or ""
                    found.append(with_patterns(before, text) if last else before | voters.votes(text))
                own = [] if last else [batch.column(2)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *own, pa.array(found, pa.int64())],
                                                 names=["id", "learn", *(["text"] if own else []), "votes"])
        return votes
    rows = documents.select("id", "learn", "text", F.lit(0).cast("long").alias("votes"))
    for block in blocks:
        rows = rows.mapInArrow(run(send(block), False), f"id {kind}, learn boolean, text string, votes long")
    return rows.mapInArrow(run(None, True), f"id {kind}, learn boolean, votes long")


def toxicity(documents: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text: str = "text",
             label: str = "toxic") -> DataFrame:
    """(id, score): the classifier's probability that a document is toxic.

    `labels` (id, label 0 or 1; others are left out, of several rows of one id the highest counts) teaches where the
    condition `learn` on documents holds; label rows of other documents are not used. Null and empty texts have no
    votes and get the score of that. Without labels of both kinds every score is 0. Rows that repeat an id are rows
    of their own.
    """
    known = (labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("__id"))
             .agg(F.max(label).cast("int").alias("y")))
    base = documents.select(F.col(id_col).alias("id"), F.col(text).alias("text"), learn.alias("learn"))
    taught = base.where("learn AND text IS NOT NULL")
    hashed = taught.select("id", *_hashes()).join(known, F.col("id") == F.col("__id")).select("h1", "h2", "y")
    texts, number, toxic = distinct_texts(taught, hashed)
    if not toxic or toxic == number:
        return documents.select(F.col(id_col), F.lit(0.0).alias("score"))
    passing = passing_entries(texts, number, toxic)
    if passing.isEmpty():
        return documents.select(F.col(id_col), F.lit(0.0).alias("score"))
    votes = cut(_vote_rows(base, lexicon_blocks(passing)).withColumnRenamed("votes", "__votes"))
    taught = votes.where("learn").join(known, F.col("id") == F.col("__id"), "left")
    patterns = cut(taught.groupBy(F.col("__votes").alias("votes"), F.coalesce("y", F.lit(-1)).alias("y"))
                   .agg(F.count("*").cast("double").alias("n")))
    share = patterns.where("y >= 0").agg(F.sum(F.col("y") * F.col("n")) / F.sum("n")).first()[0]
    weights = fit_classifier(patterns, fit_label_model(patterns, float(share)))
    points = F.lit(float(weights[0]))
    for voter in range(VOTERS):
        points = points + F.when(F.col("__votes").bitwiseAND(1 << voter) != 0, float(weights[voter + 1])).otherwise(0.0)
    return votes.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-points))).alias("score"))
