"""Held-out items inside a corpus: CGK embedding, bit-sampling LSH over windows, exact edit verification.

A CGK random walk maps the edit distance of two windows of words to a Hamming
distance: it copies the word it stands on and moves on or not by a random bit of
that word. Sampling some positions of the walk gives a hash under which windows
with few edits collide; several repetitions reach the recall. Windows of the
corpus start every third of a window; those of an item start at each of its
words, so whatever the offset of a copied passage, one of its windows meets the
item's own. Items are dealt into blocks of bounded size, of which the driver holds
one at a time, and every block is held against all documents; no document is left
out, shortened or sampled.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder, spread
from . import tokens

#: Words of a window of a long item; shorter items have windows of a quarter of their words.
WIDTH = 10
#: Repetitions of the walk, and sampled positions of it.
REPEATS, SAMPLED = 4, 12
#: Items that one pass over the corpus searches for; bounds what is sent to the tasks.
ITEM_BLOCK = 20_000
#: Share of an item's words that must be carried, in so many stretches at most.
SHARE, STRETCHES = 0.5, 2
#: Share of a window's words that must stand in the other window, before alignment.
WINDOW_SHARE = 0.7
MATCH, DIFFER = 1, 3
#: Words below which a second stretch in one band is a shared short phrase.
PHRASE = 5
#: Words by which a stretch may drift from its diagonal.
BAND = 8
RESULT = "doc_id long, item_id long, carried double"
CHUNK = 1_000


def walk_positions(repeat: int, width: int) -> list[int]:
    """The sampled positions of a walk of three times the width."""
    rng = np.random.default_rng(1_000 * repeat + width)
    steps = 3 * width
    return sorted(rng.choice(steps, min(SAMPLED, steps), replace=False).tolist())


def cgk_hashes(words: np.ndarray, starts: np.ndarray, width: int, repeat: int) -> np.ndarray:
    """The bit-sampled CGK hash of the window at each start; ``words`` are word hashes, padded by ``width`` at the end."""
    walk = tokens.mix(words ^ np.uint64(0x51ED270B * (repeat + 1)))
    sampled = walk_positions(repeat, width)
    h = np.full(len(starts), repeat + 1, np.uint64)
    at = starts.copy()
    end = starts + width
    for step in range(sampled[-1] + 1):
        inside = at < end
        if step in sampled:
            with np.errstate(over="ignore"):
                h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[at], np.uint64(7))
        at += ((walk[at] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64) & inside
    return tokens.mix(h)


def windows(offsets: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, text of each)``: whole windows every ``stride`` words, and the last one of each text."""
    n = np.maximum(np.diff(offsets) - width, -1)
    count = np.where(n >= 0, -(-np.maximum(n, 0) // stride) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[text] + np.minimum(k * stride, n[text]), text


class Items:
    """One block of items: their words and, by width and repetition, the sorted hashes of their windows."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        words, self.offsets = tokens.split_words(tokens.unescaped(pa.array(texts, pa.large_string())))
        self.words = np.concatenate([tokens.hashed(words), np.zeros(WIDTH, np.uint64)])
        #: Half of each hash, which is enough beside a window that is equal in whole ones.
        self.low = self.words.astype(np.uint32)
        n = np.diff(self.offsets)
        self.widths = np.where(n >= 4 * WIDTH, WIDTH, np.maximum(np.minimum(n, 2), n // 4))
        self.tables = {}
        for width in sorted(set(self.widths.tolist()) - {0}):
            starts, item = windows(self.offsets, width, 1)
            own = self.widths[item] == width
            starts, item = starts[own], item[own]
            for repeat in range(REPEATS):
                h = cgk_hashes(self.words, starts, width, repeat)
                order = np.argsort(h, kind="stable")
                seen = np.zeros(1 << 20, bool)
                seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.tables[width, repeat] = (h[order], starts[order], item[order], seen)

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, item, word of the text, word of the item), without repeats, of windows that collide and share most words."""
        found = []
        for width in sorted({w for w, _ in self.tables}):
            starts, text = windows(offsets, width, max(1, width // 3))
            for repeat in range(REPEATS):
                hashes, at, item, seen = self.tables[width, repeat]
                h = cgk_hashes(words, starts, width, repeat)
                maybe = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                low = np.searchsorted(hashes, h[maybe], "left")
                n = np.searchsorted(hashes, h[maybe], "right") - low
                k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                which = np.repeat(maybe, n)
                if not len(k):
                    continue
                ours = words[starts[which][:, None] + np.arange(width)]
                theirs = self.words[at[k][:, None] + np.arange(width)]
                shared = (ours[:, :, None] == theirs[:, None, :]).any(axis=1).sum(axis=1)
                good = shared >= WINDOW_SHARE * width
                found.append(np.stack([text[which][good], item[k][good], starts[which][good], at[k][good]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)


def stretches(items: np.ndarray, texts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment near a diagonal for each row: (first, end) in words of the item, between ``low`` and ``high``.

    A row of ``texts`` holds BAND words more than that of ``items`` on either
    side; a differing or missing word costs three times what a match gains.
    """
    rows, length = items.shape
    width = 2 * BAND + 1
    words, around = np.ascontiguousarray(items.T), np.ascontiguousarray(texts.T)
    # Scores and places are at most the words of an item.
    kind = np.int16 if length < 30_000 else np.int32
    score, first = np.zeros((width + 1, rows), kind), np.zeros((width + 1, rows), kind)
    top, start, end = (np.zeros(rows, kind) for _ in range(3))
    for i in range(length):
        inside = (low <= i) & (i < high)
        if not inside.any():
            score[:] = 0
            continue
        equal = (around[i : i + width] == words[i]) & inside
        # score[j] is the cell one word back in both, score[j + 1] the one without a word of the text
        s = score[:width] + np.where(equal, kind(MATCH), kind(-DIFFER))
        f = np.where(equal & (score[:width] == 0), kind(i), first[:width])
        down = score[1:] - DIFFER
        f = np.where(down > s, first[1:], f)
        s = np.maximum(np.maximum(s, down), 0)
        for j in range(1, width):
            left = s[j - 1] - DIFFER
            better = left > s[j]
            if better.any():
                s[j] = np.where(better, left, s[j])
                f[j] = np.where(better, f[j - 1], f[j])
        s[:, ~inside] = 0
        score[:width], first[:width] = s, f
        best = s.argmax(axis=0)
        peak = s[best, np.arange(rows)]
        more = peak > top
        top, start, end = np.where(more, peak, top), np.where(more, f[best, np.arange(rows)], start), np.where(more, i + 1, end)
    return start, end


def laid(items: Items, low: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows (text, item, offset of item against text): the items' words, and the text's words beside them with BAND more on either side."""
    text, item, diagonal = rows.T
    length = items.offsets[item + 1] - items.offsets[item]
    k = np.arange(length.max())
    own = np.where(k < length[:, None], items.low[np.minimum(items.offsets[item][:, None] + k, len(items.low) - 1)], np.uint32(0))
    at = diagonal[:, None] + np.arange(-BAND, len(k) + BAND)
    inside = (at >= 0) & (at < (offsets[text + 1] - offsets[text])[:, None])
    # Words beside the text equal none of an item.
    return own, np.where(inside, low[np.where(inside, at + offsets[text][:, None], 0)], np.uint32(1))


def plausible(items: Items, low: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows (text, item, offset of item against text) belong to a pair that alignment can find, and which words of the item stand in each row's band.

    An upper bound: a stretch of m matches has a positive score, hence fewer than
    m / 3 words of the item in it differ. So no more than the item's words that
    stand anywhere in the bands of a pair, and a third of the STRETCHES fullest
    stretches' matches, can be carried; a stretch has no more matches than the item
    has words standing in its band.
    """
    text, item = rows[:, 0], rows[:, 1]
    length = items.offsets[item + 1] - items.offsets[item]
    new = np.flatnonzero(np.concatenate([[True], np.any(np.diff(rows[:, :2], axis=0) != 0, axis=1)]))
    count = np.diff(np.concatenate([new, [len(rows)]]))
    own, beside = laid(items, low, offsets, rows)
    equal = np.zeros(own.shape, bool)
    for j in range(2 * BAND + 1):
        equal |= own == beside[:, j : j + own.shape[1]]
    equal &= np.arange(own.shape[1]) < length[:, None]
    anywhere = np.logical_or.reduceat(equal, new, axis=0).sum(axis=1)
    return np.repeat(anywhere + STRETCHES * (anywhere // (DIFFER // MATCH)) >= SHARE * length[new], count), equal


def union(spans: list[tuple[int, int]]) -> int:
    """The most words that one span, or STRETCHES (two) of them together, cover."""
    best = 0
    for i, (a, b) in enumerate(spans):
        best = max(best, b - a)
        if STRETCHES > 1:
            best = max([best, *(b - a + max(0, d - max(b, c)) + max(0, min(a, d) - c) for c, d in spans[i + 1 :])])
    return best


def apart(rows: np.ndarray) -> np.ndarray:
    """Which sorted rows (text, item, offset) to align: an offset within BAND of the last one aligned of its pair lies in that one's band."""
    keep, last = [], None
    for text, item, diagonal in rows.tolist():
        take = last is None or last[:2] != (text, item) or diagonal - last[2] > BAND
        keep.append(take)
        if take:
            last = (text, item, diagonal)
    return np.array(keep, bool)


def search(ids: np.ndarray, texts: pa.Array, items: Items) -> list[tuple[int, int, float]]:
    """(document, item, share carried) for each leak in one chunk of documents."""
    flat, offsets = tokens.split_words(tokens.unescaped(texts))
    words = np.concatenate([tokens.hashed(flat), np.zeros(WIDTH, np.uint64)])
    low = words.astype(np.uint32)
    hits = items.hits(words, offsets)
    if not len(hits):
        return []
    diagonal = (hits[:, 2] - offsets[hits[:, 0]]) - (hits[:, 3] - items.offsets[hits[:, 1]])
    rows = np.unique(np.concatenate([hits[:, :2], diagonal[:, None]], axis=1), axis=0)
    likely, equal = plausible(items, low, offsets, rows)
    rows, equal = rows[likely], equal[likely]
    alone = apart(rows)
    rows, equal = rows[alone], equal[alone]
    if not len(rows):
        return []
    own, beside = laid(items, low, offsets, rows)
    length = items.offsets[rows[:, 1] + 1] - items.offsets[rows[:, 1]]
    groups = np.split(np.arange(len(rows)), np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0) != 0, axis=1)) + 1)
    first, end = stretches(own, beside, np.zeros_like(length), length)
    spans: list[list[tuple[int, int]]] = [[] for _ in rows]
    for k in np.flatnonzero(end > first):
        spans[k].append((int(first[k]), int(end[k])))
    shares = [union([s for k in group for s in spans[k]]) / length[group[0]] for group in groups]
    # A second stretch may lie before or after the first one in the same band.
    short = np.array([k for group, share in zip(groups, shares, strict=True) if share < SHARE for k in group if spans[k]], np.int64)
    if len(short):
        reached = np.repeat(shares, [len(group) for group in groups]) * length
        at = np.arange(equal.shape[1])
        for start, stop in ((np.zeros_like(length), first), (end, length)):
            # The same bound as in plausible(), for the words of the item on that side.
            beyond = (equal[short] & (at >= start[short, None]) & (at < stop[short, None])).sum(axis=1)
            some = short[(beyond >= PHRASE * (1 - MATCH / DIFFER)) & (reached[short] + beyond + beyond // (DIFFER // MATCH) >= SHARE * length[short])]
            if not len(some):
                continue
            a, b = stretches(own[some], beside[some], start[some], stop[some])
            for k, x, y in zip(some.tolist(), a.tolist(), b.tolist(), strict=True):
                if y - x >= PHRASE:
                    spans[k].append((x, y))
        shares = [share if share >= SHARE else union([s for k in group for s in spans[k]]) / length[group[0]] for group, share in zip(groups, shares, strict=True)]
    return [(int(ids[rows[group[0], 0]]), int(items.ids[rows[group[0], 1]]), float(share)) for group, share in zip(groups, shares, strict=True) if share >= SHARE]


def _in_block(source: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(([i for i, _ in block], [t for _, t in block]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(*shared.value)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), tokens.column(batch, "text")
            for at in range(0, len(ids), CHUNK):
                found = search(ids[at : at + CHUNK], texts.slice(at, CHUNK), own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                    names=["doc_id", "item_id", "carried"],
                )

    return source.mapInArrow(find, RESULT)


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document that carries at least half of an item, with the item and the share carried.

    Null and blank texts and items give no row; a repeated row of documents gives
    its row again, hence ids should be unique. Up to ITEM_BLOCK items are searched
    in one pass; more are dealt into blocks, each read by itself and searched in a
    pass whose result is written to the shared folder, so neither the driver nor
    the plan grows with the items.
    """
    spark = documents.sparkSession
    rows = benchmark.where("text is not null and trim(text) <> ''").select("item_id", "text").dropDuplicates(["item_id"])
    source = spread(documents.where("text is not null").select("doc_id", "text"))
    read = lambda part: sorted((r.item_id, r.text) for r in part.collect())
    count = rows.count()
    if count <= ITEM_BLOCK:
        return _in_block(source, read(rows)) if count else spark.createDataFrame([], RESULT)
    # Twice as many blocks as would just do, as they differ in size.
    blocks, folder = 2 * -(-count // ITEM_BLOCK), f"{shared_folder(spark)}/leaks-{uuid.uuid4().hex}"
    for k in range(blocks):
        own = read(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k))
        if own:
            _in_block(source, own).write.parquet(f"{folder}/{k}")
    return spark.read.parquet(*(f"{folder}/{k}" for k in range(blocks) if _written(spark, f"{folder}/{k}")))


def _written(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
