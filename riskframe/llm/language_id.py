"""Language identification by unigram piece models, summed over all segmentations of each word.

Every language has a probability for each piece of one fixed public vocabulary. A word's likelihood is the sum, over
all ways to cut it into pieces, of the product of the pieces' probabilities (a forward pass); a text's is the product
over its words. The probabilities are learned by expectation maximisation over the word counts of the whole corpus.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .word_cache import LIMIT, quiet_collector

ROUNDS = 2
SMOOTHING = 0.1
LONGEST_WORD = 64
KNOWN_WORDS = 1_000_000  # scored words that a task keeps
UNKNOWN = 1e-5
SCALE = 30.0  # times each character, so that products stay in range
MARK = "▁"
UNDETERMINED = "und"

# \w takes numbers that are no digits, such as fractions and Roman numerals, for letters.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_BLANKED = dict.fromkeys(map(ord, _NUMBERS), " ")
# A class tries its characters beyond the basic plane one by one, so all of that plane only leads to a closer look.
_SUSPECT = re.compile("[%s\U00010000-\U0010FFFF]" % "".join(c for c in _NUMBERS if c < "\U00010000")).search
_LETTERS = re.compile(r"[^\W\d_]+").findall


def _runs(text: str) -> list[str]:
    return _LETTERS(text if text.isascii() or not _SUSPECT(text) else text.translate(_BLANKED))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, whole texts; runs over LONGEST_WORD letters are cut into that many each."""
    words = _runs(text.lower())
    if len(text) > LONGEST_WORD and max(map(len, words), default=0) > LONGEST_WORD:
        words = [w[i:i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


class Vocabulary:
    """Piece numbers by text; number 0 stands for one character that is no piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        usable = [p for p in pieces if p.strip(MARK) and _runs(p.replace(MARK, "")) == [p.replace(MARK, "")]]
        self.number = {p: i + 1 for i, p in enumerate(dict.fromkeys(p.lower() for p in usable))}
        self.longest = max(map(len, self.number))
        letters = sorted(set().union(*self.number))
        #: Letters by code point, 0 for any other; beginnings of pieces (0 the empty one) by beginning and next letter.
        self.letter = np.zeros(sys.maxunicode + 1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        place = {b: i for i, b in enumerate(dict.fromkeys(p[:k] for p in self.number for k in range(len(p) + 1)))}
        steps = sorted((place[b[:-1]] * (len(letters) + 1) + int(self.letter[ord(b[-1])]), i) for b, i in place.items() if b)
        self.steps, self.after = np.array(steps, np.int64).reshape(-1, 2).T.copy()
        #: Piece numbers of beginnings, -1 for what only begins a piece.
        self.piece = np.array([self.number.get(b, -1) for b in place], np.int32)
        self.width = len(letters) + 1

    def spans(self, words: list[str]) -> np.ndarray:
        """Piece numbers (word, start, length - 1) of equally long marked words; -1 where there is no piece."""
        n = len(words[0])
        width = min(n, self.longest)
        out = np.full((len(words), n, width), -1, np.int32)
        letter = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].reshape(-1, n)
        for start in range(n):
            rows, begun = np.arange(len(words)), np.zeros(len(words), np.int64)
            for size in range(1, min(width, n - start) + 1):
                step = begun * self.width + letter[rows, start + size - 1]
                at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                there = self.steps[at] == step
                rows, begun = rows[there], self.after[at[there]]
                if not len(rows):
                    break
                out[rows, start, size - 1] = self.piece[begun]
        single = out[:, :, 0]
        single[single < 0] = 0
        return out


_MADE: dict[str, Vocabulary] = {}
_SCORED: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def shared_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of this Python worker, read once."""
    if path not in _MADE:
        _MADE[path] = Vocabulary(path)
    return _MADE[path]


def forward(spans: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Scaled sums over the segmentations of every prefix: (word, position, language); chance is (language, piece + 1).

    The last column of chance must be 0; it stands for spans that are no piece.
    """
    words, n, widest = spans.shape
    out = np.zeros((words, n + 1, len(chance)))
    out[:, 0] = 1
    for end in range(1, n + 1):
        for size in range(1, min(end, widest) + 1):
            piece = spans[:, end - size, size - 1]
            if (piece >= 0).any():
                out[:, end] += out[:, end - size] * chance[:, piece].T * SCALE ** size
    return out


def _padded(probability: np.ndarray) -> np.ndarray:
    return np.concatenate([probability, np.zeros((len(probability), 1))], axis=1)


def word_scores(vocabulary: Vocabulary, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """Log likelihood of each word in each language."""
    out = np.empty((len(words), len(probability)))
    chance = _padded(probability)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, rows in by_length.items():
        for start in range(0, len(rows), 2000):
            part = rows[start:start + 2000]
            spans = vocabulary.spans([MARK + words[i] for i in part])
            out[part] = np.log(forward(spans, chance)[:, -1]) - (n + 1) * np.log(SCALE)
    return out


def expected_counts(vocabulary: Vocabulary, probability: np.ndarray, words: list[str], language: np.ndarray,
                    weight: np.ndarray) -> np.ndarray:
    """Expected uses (language, piece) over the segmentations of words, each counted `weight` times in one language."""
    total = np.zeros_like(probability)
    chance = _padded(probability)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for rows in by_length.values():
        for first in range(0, len(rows), 2000):
            part = np.array(rows[first:first + 2000])
            spans = vocabulary.spans([MARK + words[i] for i in part])
            tongue, widest, n = language[part], spans.shape[2], spans.shape[1]
            mine = chance[tongue[:, None, None], spans] * SCALE ** np.arange(1, widest + 1)
            ahead = np.zeros((len(part), n + 1))
            back = np.zeros((len(part), n + 1))
            ahead[:, 0] = back[:, n] = 1
            for end in range(1, n + 1):
                for size in range(1, min(end, widest) + 1):
                    ahead[:, end] += ahead[:, end - size] * mine[:, end - size, size - 1]
            for begin in range(n - 1, -1, -1):
                for size in range(1, min(n - begin, widest) + 1):
                    back[:, begin] += mine[:, begin, size - 1] * back[:, begin + size]
            times = weight[part] / ahead[:, n]
            for begin in range(n):
                for size in range(1, min(n - begin, widest) + 1):
                    piece = spans[:, begin, size - 1]
                    there = piece >= 0
                    if there.any():
                        use = ahead[:, begin] * mine[:, begin, size - 1] * back[:, begin + size] * times
                        np.add.at(total, (tongue[there], piece[there]), use[there])
    return total


def _initial(vocabulary: Vocabulary, languages: int) -> np.ndarray:
    """The same start for all languages: chance falls as the piece's place in the vocabulary, which is by frequency."""
    chance = 1.0 / np.arange(1, len(vocabulary.number) + 2)
    chance[0] = UNKNOWN
    return np.tile(chance / chance.sum(), (languages, 1))


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows (lang, text); each task counts ahead, so frequent words are sent once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_collector()
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)),
                                                  pa.array(list(words.values()), pa.int64())],
                                                 names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
                if sum(map(len, counts.values())) > LIMIT:
                    yield from flush()
        yield from flush()
    return (labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


class LanguageModel:
    """Learned languages (sorted) and the probability of each piece in each."""

    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.path, self.languages, self.probability = path, languages, probability


def fit(documents: DataFrame, vocabulary: str, rounds: int = ROUNDS, lang: str = "lang",
        text: str = "text") -> LanguageModel:
    """Learn from every row with a language and a text. The model is as large as the vocabulary times the languages.

    Rows with a null language or text teach nothing; without any other row the model has no languages.
    """
    counts = cut(_word_counts(documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
                              .select(F.col(lang).alias("lang"), F.col(text).alias("text"))))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    pieces = Vocabulary(vocabulary)
    probability = _initial(pieces, len(languages))
    place = {x: i for i, x in enumerate(languages)}
    spark = documents.sparkSession
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast(probability)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, total = shared_vocabulary(vocabulary), np.zeros_like(sent.value)
            for batch in batches:
                tongue = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
                total += expected_counts(known, sent.value, batch.column(1).to_pylist(), tongue,
                                         batch.column(2).to_numpy().astype(float))
            row, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(piece, pa.int32()),
                                              pa.array(total[row, piece])], names=["l", "piece", "uses"])

        uses = counts.mapInArrow(expect, "l int, piece int, uses double").groupBy("l", "piece").agg(
            F.sum("uses").alias("uses")).toPandas()
        total = np.zeros_like(probability)
        total[uses["l"], uses["piece"]] = uses["uses"]
        total += SMOOTHING
        probability = total / total.sum(axis=1, keepdims=True)
        probability[:, 0] = np.maximum(probability[:, 0], UNKNOWN)
        sent.unpersist()
    return LanguageModel(vocabulary, languages, probability)


def predict(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The columns of documents with lang_pred and score, the posterior of that language under equal priors.

    A null text, one without a letter, or a model without languages gives `und` and score 0. Ties go to the language
    first in order. The text column may be any column; lang_pred and score replace columns of those names.
    """
    keep = [c for c in documents.columns if c not in ("lang_pred", "score")]
    at = keep.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(keep).schema)
    model_key = uuid.uuid4().hex
    sent = documents.sparkSession.sparkContext.broadcast((model.path, model.languages, model.probability))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet_collector()
        path, languages, probability = sent.value
        vocabulary = shared_vocabulary(path)
        if model_key not in _SCORED:  # a worker keeps the words scored under one model, from task to task
            _SCORED.clear()
        place, known = _SCORED.get(model_key, ({}, np.zeros((0, len(languages)))))
        for batch in batches:
            best, score = [], []
            for start in range(0, batch.num_rows, 500):
                words = [words_of(t.as_py() or "") if languages else [] for t in batch.column(at).slice(start, 500)]
                if len(place) > KNOWN_WORDS:
                    place, known = {}, known[:0]
                new = list(set().union(*words) - place.keys())
                if new:
                    place.update(zip(new, range(len(place), len(place) + len(new))))
                    if len(place) > len(known):
                        known = np.concatenate([known, np.empty((max(len(new), len(known)), len(languages)))])
                    known[len(place) - len(new):len(place)] = word_scores(vocabulary, probability, new)
                for own in words:
                    if not own:
                        best.append(UNDETERMINED)
                        score.append(0.0)
                        continue
                    total = known[np.fromiter(map(place.__getitem__, own), np.int64, len(own))].sum(0)
                    top = int(total.argmax())
                    best.append(languages[top])
                    score.append(float(1 / np.exp(total - total[top]).sum()))
            _SCORED[model_key] = place, known
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()),
                                              pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])
    return documents.select(keep).mapInArrow(run, f"{schema}, lang_pred string, score double")
