"""Columnar tokenising: whole Arrow batches to flat arrays of words, without a loop per text."""

import html

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

NOT_WORD = r"[^\pL\pN]+"
SENTENCE_END = r"[.!?;:]+\s+|[\n\r•]+|[.!?]+$"
_known: dict[str, int] = {}


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (a null becomes the empty text)."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def unescaped(texts: pa.Array) -> pa.Array:
    """HTML entities resolved; only texts that hold an ampersand are touched."""
    has = pc.match_substring(texts, "&")
    if not pc.any(has).as_py():
        return texts
    return pc.replace_with_mask(texts, has, pa.array([html.unescape(x) for x in texts.filter(has).to_pylist()], pa.large_string()))


def split_words(texts: pa.Array, pattern: str = NOT_WORD) -> tuple[pa.Array, np.ndarray]:
    """``(words, offsets)``: lower-cased words of all texts in one array; text i has ``words[offsets[i]:offsets[i + 1]]``."""
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), pattern, " "))
    lists = pc.split_pattern(plain, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(lists)
    blank = pc.equal(plain, "").to_numpy(zero_copy_only=False)
    if blank.any():
        words = words.filter(pc.not_equal(words, ""))
        counts[blank] = 0
    return words, np.concatenate([[0], np.cumsum(counts)])


def split_sentences(texts: pa.Array, pattern: str = SENTENCE_END) -> tuple[pa.Array, np.ndarray]:
    """``(sentences, offsets)`` alike."""
    lists = pc.split_pattern_regex(texts, pattern)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), np.concatenate([[0], np.cumsum(counts)])


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The words as codes into their own vocabulary."""
    if not len(words):
        return np.zeros(0, np.int32), []
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int32), d.dictionary.to_pylist()


def word_hash(word: str) -> int:
    """A 64-bit hash, kept for the life of the worker while the store is small."""
    h = _known.get(word)
    if h is None:
        h = xxhash.xxh3_64_intdigest(word)
        if len(_known) < 200_000:
            _known[word] = h
    return h


def hashed(words: pa.Array) -> np.ndarray:
    """The words as 64-bit hashes."""
    codes, vocabulary = coded(words)
    return np.array([word_hash(w) for w in vocabulary], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the murmur finaliser)."""
    h = h.copy()
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(shingle hashes, offsets)`` of ``width`` consecutive words within each text; a shorter text gives one shingle of all its words."""
    n = np.diff(offsets)
    keep = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(keep)])
    total = int(out[-1])
    if not total:
        return np.zeros(0, np.uint64), out
    start = np.repeat(offsets[:-1] - out[:-1], keep) + np.arange(total)
    last = np.repeat(offsets[1:], keep)
    h = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(width):
            at = start + k
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(at < last, padded[at], np.uint64(k + 1))
    return mix(h), out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (by row) over each segment; an empty segment gives 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
