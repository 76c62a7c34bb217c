"""Abusive, hateful or sexual content: FTRL-proximal logistic regression over hashed words, pairs and skip-pairs.

The model judges sentences, after disguises (digits and signs for letters, masked
or spaced letters, drawn-out vowels, invisible marks) are undone; a document's
score is that of its worst sentence. It is learnt from reviewers' marks alone.
They mark whole documents and slip now and then, so training goes in rounds: at
first every sentence of a marked document shares the mark, then only those that a
model fitted without that document (in folds) scores above what clean documents
reach. A marked document without such a sentence is taken for a slip and left out.
L1 makes the weights sparse; they are sent to the executors as one small array,
together with the words by which letters typed apart are cut.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import ftrl, tokens

#: Bound of the training sample (marked documents), rounds of sentence picking, folds of the documents.
MARKED, PICKINGS, FOLDS = 6_000, 3, 3
#: Share of the clean documents whose worst sentence a picked sentence must outdo, in the first round and later.
OUTDONE = (0.9, 0.98)
#: Share of the worst sentence's score from which another sentence of its document bears the mark as well.
CLOSE = 0.8
#: Weight of a picked sentence beside a clean one: abuse is rare.
RARE = 4.0
#: Hashed features.
BITS = 20
#: Score from which a document counts as toxic.
THRESHOLD = 0.6
CHUNK = 2_000
SCORED = "job_id long, score double"

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"})
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_KEPT = r"[^\pL\pN@$*]+"
_DRAWN = re.compile(r"([a-z])\1{2,}")
_plain: dict[str, str] = {}


def plain_word(word: str) -> str:
    """A word without its disguise; a masked word is its visible letters around a mark."""
    known = _plain.get(word)
    if known is None:
        known = word
        if any(c.isalpha() for c in word):
            if re.search(r"[0-9@$]", word) and re.search(r"[a-z]", word):
                known = known.translate(_LEET)
            known = _DRAWN.sub(r"\1", known)
            if "*" in known.strip("*"):
                known = "<masked>"
        known = known.strip("*@$") if known != "<masked>" else known
        if re.fullmatch(r"\d+", known):
            known = "0"
        if len(_plain) < 200_000:
            _plain[word] = known
    return known


class Words:
    """The words of the training texts, by which letters typed apart are cut into words."""

    def __init__(self, counts: Counter):
        total = sum(counts.values()) + 1
        self.cost = {w: -float(np.log(n / total)) for w, n in counts.items() if n > 1 and w.isalpha()}
        self.longest = max(map(len, self.cost), default=0)
        #: A letter that no word explains costs more than any word.
        self.unknown = 2 * float(np.log(total)) + 1

    def cut(self, run: str) -> str:
        """Single letters as the likeliest words (least cost over all cuts); without a known word they are one word."""
        letters = run.replace(" ", "").lower()
        best = [(0.0, 0)]
        for end in range(1, len(letters) + 1):
            options = [(best[at][0] + self.cost[letters[at:end]], at) for at in range(max(0, end - self.longest), end) if letters[at:end] in self.cost]
            best.append(min([*options, (best[end - 1][0] + self.unknown, end - 1)]))
        out, end = [], len(letters)
        while end:
            at = best[end][1]
            out.append((letters[at:end], letters[at:end] in self.cost))
            end = at
        words, loose = [], ""
        for piece, known in reversed(out):
            if known:
                words += [loose, piece] if loose else [piece]
                loose = ""
            else:
                loose += piece
        return " ".join([*words, loose] if loose else words)


def sentences(texts: pa.Array, known: Words | None = None) -> tuple[pa.Array, np.ndarray]:
    """The sentences of each text without invisible marks and with spaced letters joined; a text's first sentence may be its title."""
    texts = tokens.unescaped(texts)
    invisible = pc.match_substring_regex(texts, r"[\p{Cf}]")
    if pc.any(invisible).as_py():
        texts = pc.replace_substring_regex(texts, r"[\p{Cf}]", "")
    found, offsets = tokens.split_sentences(texts, r"[.!?;]+\s+|[\n\r•]+")
    spaced = pc.match_substring_regex(found, r"(?:^|\s)\pL(?: \pL){2,}(?:\s|[,.!?]|$)")
    if pc.any(spaced).as_py():
        # Words are further apart than their letters only in some texts; joined runs are cut by the words of the training texts.
        cut = known.cut if known else lambda run: run.replace(" ", "")
        joined = [_SPACED.sub(lambda m: cut(m[0]), x) for x in found.filter(spaced).to_pylist()]
        found = pc.replace_with_mask(found, spaced, pa.array(joined, pa.large_string()))
    return found, offsets


def hashed_features(found: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """``(sentence of each, hashed features, sentences)``: words, neighbouring pairs, and pairs one word apart."""
    words, offsets = tokens.split_words(found, _KEPT)
    codes, vocabulary = tokens.coded(words)
    sentences_ = len(offsets) - 1
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sentences_
    h = np.array([xxhash.xxh3_64_intdigest(plain_word(w)) for w in vocabulary], np.uint64)[codes]
    owner = np.repeat(np.arange(sentences_), np.diff(offsets))
    parts, owners = [h], [owner]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = owner[gap:] == owner[:-gap]
        with np.errstate(over="ignore"):
            parts.append((h[:-gap] * np.uint64(factor) + h[gap:])[same])
        owners.append(owner[gap:][same])
    return np.concatenate(owners), (tokens.mix(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int64), sentences_


def features(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, offsets by sentence), each feature once a sentence."""
    owner, at, n = hashed_features(found)
    distinct = np.unique(owner << BITS | at)
    return distinct & ((1 << BITS) - 1), np.concatenate([[0], np.cumsum(np.bincount(distinct >> BITS, minlength=n))])


def sentence_scores(found: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each sentence; one without a word has 0. Only features with a weight, which are few, are told apart."""
    owner, at, n = hashed_features(found)
    own = np.flatnonzero(weights[at])
    distinct = np.unique(owner[own] << BITS | at[own])
    total = np.bincount(distinct >> BITS, weights[distinct & ((1 << BITS) - 1)], n)
    return 1 / (1 + np.exp(-np.clip(total + bias, -30, 30))) * (np.bincount(owner, minlength=n) > 0)


def _scored(at: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    total = tokens.segment_sum(weights[at].astype(np.float64), offsets)
    return 1 / (1 + np.exp(-np.clip(total + bias, -30, 30))) * (np.diff(offsets) > 0)


def worst(scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The highest score of each text's sentences; 0 without one."""
    n = len(offsets) - 1
    out = np.maximum.reduceat(np.concatenate([scores, [0.0]]), offsets[:-1]) if n else np.zeros(0)
    return np.where(np.diff(offsets) > 0, out, 0.0)


def document_scores(texts: pa.Array, weights: np.ndarray, bias: float, known: Words | None = None) -> np.ndarray:
    """The score of each text's worst sentence; 0 without a word."""
    found, offsets = sentences(texts, known)
    return worst(sentence_scores(found, weights, bias), offsets)


def train(texts: list[str], marks: list[int]) -> tuple[np.ndarray, float, Words]:
    """Weights, bias and words from marked texts (1 toxic, 0 not). Without a toxic mark no text scores above one half."""
    array, marks = pa.array(texts, pa.large_string()), np.array(marks, np.int64)
    plain = tokens.split_words(array)[0]
    known = Words(Counter({v: n for v, n in zip(*(pc.value_counts(plain).field(k).to_pylist() for k in (0, 1)), strict=True)}))
    found, by_text = sentences(array, known)
    at, offsets = features(found)
    text = np.repeat(np.arange(len(texts)), np.diff(by_text))
    toxic = marks[text] == 1 if len(text) else np.zeros(0, bool)
    targets = toxic.astype(float)
    weights = np.where(toxic, 1 / np.maximum(np.diff(by_text), 1)[text], 1.0) if len(text) else np.zeros(0)
    fold = np.random.default_rng(11).permutation(len(texts)) % FOLDS
    for k in range(PICKINGS if (marks == 1).any() and (marks == 0).any() else 0):
        scores = np.zeros(len(text))
        for f in range(FOLDS):
            held = fold[text] == f
            model = ftrl.fitted(at, offsets, targets, np.where(held, 0.0, weights), BITS)
            scores[held] = _scored(at, offsets, *model)[held]
        usual = worst(scores, by_text)[marks == 0]
        least = np.quantile(usual, OUTDONE[min(k, 1)])
        top = worst(scores, by_text)[text]
        # A mark is explained by its document's worst sentence and by those about as bad.
        picked = toxic & (scores > least) & (scores >= CLOSE * top)
        targets = picked.astype(float)
        # What else such a document holds is clean; where nothing is picked it is undecided. A sentence
        # of a clean document that the model is sure of is taken for a reviewer's slip.
        explained = np.bincount(text, picked, len(texts))[text] > 0
        weights = np.where(picked, RARE, np.where(toxic, np.where(explained, 1.0, 0.0), np.where(scores > 0.9, 0.0, 1.0)))
    return *ftrl.fitted(at, offsets, targets, weights, BITS), known


def _joined(jobs: DataFrame) -> DataFrame:
    """(job_id, text): the title is a sentence of its own before the description."""
    return jobs.select("job_id", F.concat_ws("\n", F.regexp_replace("title", r"[\n\r]+", " "), "description").alias("text"))


def trained(jobs: DataFrame, marks: DataFrame) -> tuple[np.ndarray, float, Words]:
    """The model from up to MARKED marked jobs, by the least hash of the id; a job marked twice counts as toxic if any mark says so."""
    order = F.xxhash64("job_id")
    bounded = marks.where("toxic in (0, 1)").groupBy("job_id").agg(F.max("toxic").alias("toxic")).orderBy(order).limit(MARKED)
    rows = _joined(jobs).join(F.broadcast(bounded), "job_id").collect()
    return train([r.text for r in rows], [r.toxic for r in rows])


def scores(jobs: DataFrame, marks: DataFrame) -> DataFrame:
    """(job_id, score) of every job, the score from 0 to 1; null and empty texts have 0, repeated rows are judged alike."""
    weights, bias, known = trained(jobs, marks)
    used = np.flatnonzero(weights)
    # Sparse: as many numbers as L1 leaves, bounded by the words of MARKED documents.
    shared = jobs.sparkSession.sparkContext.broadcast((used, weights[used], bias, known))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, bias, known = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = values
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                yield pa.RecordBatch.from_arrays([part.column("job_id"), pa.array(document_scores(tokens.column(part, "text"), weights, bias, known))], names=["job_id", "score"])

    return _joined(spread(jobs)).mapInArrow(judge, SCORED)


def host(url):
    """The host of a URL, in lower case; an unreadable or missing one is the empty text."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))
