"""Reading level by smoothed unigram language models, one per level.

The models are trained on all texts with a reader's mark, and on all texts a
readability formula places clearly, so that a few marks suffice. They are counted
where the texts are; only words and their counts reach the driver. Marks have slips and a text
may hold sentences of another level; the models are therefore trained twice: the
first models place each sentence of the training texts, the second are counted
over the sentences so placed. A document has the level with the most words in
sentences of that level by posterior likelihood.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage, spread
from . import tokens

LEVELS = (1, 2, 3)
#: Added to every count of a word.
SMOOTHING = 0.1
#: Flesch-Kincaid grades that place a text clearly: up to, between, from.
EASY, ORDINARY, HARD = 3.5, (8.0, 15.5), 21.0
RESULT = "doc_id long, band int, p_easy double, p_ordinary double, p_demanding double"

VOWELS = re.compile(r"[aeiouy]+")
#: The end of a sentence to the formula; the blanks are those of Python's regular expressions.
STOP = r"[.!?]+(?:[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"


def grade(text: str) -> float | None:
    """The Flesch-Kincaid grade; None without words."""
    words = re.findall(r"[a-z]+", text.lower())
    if not words:
        return None
    sentences = max(1, len(re.findall(r"[.!?]+(?:\s|$)", text)))
    syllables = sum(max(1, len(VOWELS.findall(w))) for w in words)
    return 0.39 * len(words) / sentences + 11.8 * syllables / len(words) - 15.59


def grades(texts: pa.Array) -> np.ndarray:
    """The grade of each text; NaN without words. Each distinct word is looked at once."""
    words, offsets = tokens.split_words(texts)
    codes, vocabulary = tokens.coded(words)
    latin = [re.findall(r"[a-z]+", w) for w in vocabulary]
    of_word = np.array([[len(x), sum(max(1, len(VOWELS.findall(w))) for w in x)] for x in latin], np.int64).reshape(-1, 2)
    sums = tokens.segment_sum(of_word[codes], offsets)
    n, syllables = sums[:, 0], sums[:, 1]
    sentences = np.maximum(1, pc.count_substring_regex(texts, STOP).to_numpy(zero_copy_only=False))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, 0.39 * n / sentences + 11.8 * syllables / n - 15.59, np.nan)


def seed_levels(texts: pa.Array) -> np.ndarray:
    """The level the formula places each text at; 0 where it is not clear."""
    g = grades(texts)
    return np.select([g <= EASY, g >= HARD, (g >= ORDINARY[0]) & (g <= ORDINARY[1])], [1, 3, 2], 0)


class Models:
    """Log probabilities of words at each level; the last row is that of an unknown word."""

    def __init__(self, counts: list[Counter]):
        words = sorted(set().union(*counts))
        self.index = {w: i for i, w in enumerate(words)}
        self.table = np.zeros((len(words) + 1, len(LEVELS)), np.float64)
        for k, c in enumerate(counts):
            total = sum(c.values()) + SMOOTHING * (len(words) + 1)
            self.table[:, k] = [np.log((c.get(w, 0) + SMOOTHING) / total) for w in words] + [np.log(SMOOTHING / total)]
        # A word no model knows says nothing about the level.
        self.table[-1] = self.table[-1].mean()

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """``(log likelihoods by sentence, words as codes, vocabulary, word offsets by sentence, sentence offsets by text)``."""
        sentences, by_text = tokens.split_sentences(tokens.unescaped(texts))
        words, by_sentence = tokens.split_words(sentences)
        codes, vocabulary = tokens.coded(words)
        known = np.array([self.index.get(w, len(self.index)) for w in vocabulary], np.int64)
        rows = self.table[known[codes]] if len(codes) else np.zeros((0, len(LEVELS)))
        return tokens.segment_sum(rows, by_sentence), codes, vocabulary, by_sentence, by_text

    def shares(self, texts: pa.Array) -> np.ndarray:
        """For each text, the share of its words in sentences of each level, by posterior; zeros if it has no word."""
        scores, _, _, by_sentence, by_text = self.read(texts)
        words = np.diff(by_sentence)
        p = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        p = p / p.sum(axis=1, keepdims=True) * words[:, None] if len(p) else p
        s = tokens.segment_sum(p, by_text)
        total = s.sum(axis=1, keepdims=True)
        return np.divide(s, total, out=np.zeros_like(s), where=total > 0)


def _count(texts: pa.Array, levels: np.ndarray, models: Models | None) -> tuple[list[str], np.ndarray]:
    """``(words, counts by word and level)`` of placed texts: each sentence at its text's level, unless the models find another clearly likelier."""
    if models is None:
        words, offsets = tokens.split_words(tokens.unescaped(texts))
        codes, vocabulary = tokens.coded(words)
        at = np.repeat(levels - 1, np.diff(offsets))
    else:
        scores, codes, vocabulary, by_sentence, by_text = models.read(texts)
        mark = np.repeat(levels - 1, np.diff(by_text))
        best = scores.argmax(axis=1)
        moved = scores[np.arange(len(scores)), best] - scores[np.arange(len(scores)), mark] > 8
        at = np.repeat(np.where(moved, best, mark), np.diff(by_sentence))
    counts = np.bincount(codes.astype(np.int64) * len(LEVELS) + at, minlength=len(vocabulary) * len(LEVELS))
    return vocabulary, counts.reshape(-1, len(LEVELS))


def _counters(rows: Iterable[tuple[str, list[int]]]) -> list[Counter]:
    """A counter for each level of rows (word, counts by level)."""
    out = [Counter() for _ in LEVELS]
    for word, counts in rows:
        for c, n in zip(out, counts, strict=True):
            if n:
                c[word] = n
    return out


def train(texts: list[str], levels: list[int]) -> Models:
    """Models from placed texts; without a word of each level they are those of the texts as placed."""
    array, at = pa.array(texts, pa.large_string()), np.array(levels, np.int64)
    counts = lambda models: _counters((w, n.tolist()) for w, n in zip(*_count(array, at, models), strict=True))
    found = counts(None)
    first = Models(found)
    return first if not all(found) else Models(counts(first))


def _english(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, mark) of the texts to learn from, spread over the tasks; ``mark`` is null where no reader marked one."""
    english = spread(documents.where("lang = 'en' and text is not null and trim(text) <> ''").select("doc_id", "text"))
    one_mark = cut_lineage(marks.where("band in (1, 2, 3)").groupBy("doc_id").agg(F.min("band").cast("int").alias("mark")))
    return english.join(broadcast_if_small(one_mark, one_mark.count(), 16), "doc_id", "left").select("text", "mark")


def placed(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """``(texts, levels)`` of a batch (text, mark): those a reader marked, and those the formula places clearly."""
    texts = tokens.column(batch, "text")
    mark, seed = pc.fill_null(batch.column("mark"), 0).to_numpy(zero_copy_only=False), seed_levels(texts)
    rows = np.concatenate([np.flatnonzero(mark), np.flatnonzero(seed)])
    return texts.take(pa.array(rows)), np.concatenate([mark[mark > 0], seed[seed > 0]]).astype(np.int64)


def training_texts(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """(text, band) of all texts the models are trained on: the marked ones, and those the formula places clearly."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, levels = placed(batch)
            yield pa.RecordBatch.from_arrays([texts.cast(pa.string()), pa.array(levels, pa.int32())], names=["text", "band"])

    return _english(documents, marks).mapInArrow(place, "text string, band int")


def trained(documents: DataFrame, marks: DataFrame) -> Models:
    """The models from all training texts, counted where the texts are: only words and their counts reach the driver."""
    spark, english = documents.sparkSession, _english(documents, marks)

    def counts(models: Models | None) -> list[Counter]:
        shared = spark.sparkContext.broadcast(models)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, n = _count(*placed(batch), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(n[:, k]) for k in range(len(LEVELS)))], names=["word", "n1", "n2", "n3"])

        found = english.mapInArrow(count, "word string, n1 long, n2 long, n3 long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3")))
        return _counters((r.word, [r.n1, r.n2, r.n3]) for r in found.toLocalIterator())

    found = counts(None)
    first = Models(found)
    return first if not all(found) else Models(counts(first))


def levels(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """Each English document with a word: its level and the share of its words at each level.

    Null and blank texts and other languages give no row; repeated rows are judged
    alike; on a tie the easier level wins. Whole texts are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trained(documents, marks))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            shares = models.shares(tokens.column(batch, "text"))
            has = shares.sum(axis=1) > 0
            band = np.array(LEVELS, np.int32)[shares.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(pa.array(has)), pa.array(band[has]), *(pa.array(shares[has, k]) for k in range(3))],
                names=["doc_id", "band", "p_easy", "p_ordinary", "p_demanding"],
            )

    english = documents.where("lang = 'en' and text is not null").select("doc_id", "text")
    return spread(english).mapInArrow(judge, RESULT)
