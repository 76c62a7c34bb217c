"""Near-duplicate texts: minima of many universal hashes, banding, signature verification, components.

Each text is read once: its main body gives two hashes of the whole, by which
exact copies collapse, so a hot group of copies costs one row each, and the
signature, which is of all shingles and depends on the text alone. Signatures are
kept in few bits: 16 of each banded minimum, from which the bands are cut, and 4 of
each minimum for verification, as that is what shuffles.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage, spread
from . import boilerplate, components, tokens

#: Words of a shingle.
SHINGLE = 5
#: Hash minima, and those of a band; BANDS * ROWS of the minima are banded.
MINIMA, BANDS, ROWS = 192, 32, 3
#: Similarity of the signatures from which two texts are the same vacancy. Rewritten copies share 0.4 to 1, others below 0.3.
SIMILARITY = 0.3
#: Texts of a bucket up to which its pairs are listed; a larger one is compared whole, in pairs of blocks of so many texts.
LISTED, BLOCK = 32, 256
CHUNK = 2_000
BANDED = BANDS * ROWS
SKETCH = "id long, a long, b long, banded binary, signature binary"

_rng = np.random.default_rng(20_011)
FACTORS = (_rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
ADDENDS = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)


def body_words(texts: pa.Array, classifier: boilerplate.Classifier | None) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, their offsets) of the main body of each text, or of all of it without a classifier."""
    words, offsets = tokens.split_words(tokens.unescaped(boilerplate.bodies(texts, classifier) if classifier else texts))
    return tokens.hashed(words), offsets


def sequence_hashes(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each word sequence, each a sum of scrambled (word, place) pairs."""
    place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
    exact = []
    for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(hashes * np.uint64(seed) + tokens.mix(place + np.uint64(seed >> 7))))])
        exact.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return exact


def signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MINIMA hash minima of each text's shingles."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    has = np.diff(starts) > 0
    out = np.full((len(starts) - 1, MINIMA), 0xFFFFFFFF, np.uint32)
    if has.any():
        first = starts[:-1][has]
        for k in range(MINIMA):
            out[has, k] = np.minimum.reduceat(short * FACTORS[k] + ADDENDS[k], first)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(minima), BANDS)).copy()
    for r in range(ROWS):
        key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ minima[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
    return key.view(np.int64)


def _binary(data: np.ndarray) -> pa.Array:
    """The rows of an array of bytes as binary values."""
    offsets = np.arange(len(data) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def banded(minima: np.ndarray) -> pa.Array:
    """The low 16 bits of each banded minimum."""
    return _binary((minima[:, :BANDED] & np.uint32(0xFFFF)).astype("<u2").view(np.uint8))


def packed(minima: np.ndarray) -> pa.Array:
    """Signatures as bytes: the low 4 bits of each minimum, two to a byte."""
    low = (minima & np.uint32(15)).astype(np.uint8)
    return _binary(low[:, 0::2] | low[:, 1::2] << np.uint8(4))


def _sketched(texts: DataFrame, classifier: boilerplate.Classifier | None) -> DataFrame:
    """(id, a, b, banded, signature) of each text with a word: two hashes of its body, and its minima."""
    shared = texts.sparkSession.sparkContext.broadcast(classifier)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                words, offsets = body_words(tokens.column(part, "text"), shared.value)
                a, b = sequence_hashes(words, offsets)
                minima = signatures(*tokens.shingles(words, offsets, SHINGLE))
                out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(a), pa.array(b), banded(minima), packed(minima)], names=["id", "a", "b", "banded", "signature"])
                yield out.filter(pa.array(np.diff(offsets) > 0))

    return texts.mapInArrow(sketch, SKETCH)


def _keyed(sketched: DataFrame) -> DataFrame:
    """(id, key) for each band of each text."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(np.ascontiguousarray(_bytes(batch.column("banded"), 2 * BANDED)).view("<u2"))
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys.ravel())], names=["id", "key"])

    return sketched.select("id", "banded").mapInArrow(band, "id long, key long")


def _similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures along the last axis; unlike minima agree in 4 bits once in 16 times."""
    differ = x ^ y
    same = ((differ & 15) == 0).sum(axis=-1) + ((differ >> 4) == 0).sum(axis=-1)
    return (same / MINIMA * 16 - 1) / 15


def _agree(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) whose signatures agree in SIMILARITY of their places."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = _similarity(*(_bytes(batch.column(c), MINIMA // 2) for c in ("sa", "sb")))
            keep = pa.array(alike >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(alike).filter(keep)], names=["a", "b", "similarity"])

    return pairs.mapInArrow(verify, "a long, b long, similarity double")


def _agree_in_blocks(members: DataFrame) -> DataFrame:
    """The alike pairs (a < b) among the members (id, key, block, blocks, signature) of large buckets: each pair of blocks is one group."""

    def verify(rows: pa.Table) -> pa.Table:
        ids, block = (rows.column(c).to_numpy() for c in ("id", "block"))
        signs = _bytes(rows.column("signature"), MINIMA // 2)
        low, high = (np.flatnonzero(block == f(block)) for f in (np.min, np.max))
        one = rows.column("one")[0].as_py() == rows.column("other")[0].as_py()
        found = []
        for i in low:
            alike = _similarity(signs[i], signs[high])
            near = np.flatnonzero((alike >= SIMILARITY) & ((ids[high] > ids[i]) if one else True))
            a, b = np.full(len(near), ids[i]), ids[high][near]
            found.append((np.minimum(a, b), np.maximum(a, b), alike[near]))
        return pa.table({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("a", "b", "similarity"))})

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = members.withColumn("o", other).select("id", "block", "signature", "key", F.least("block", "o").alias("one"), F.greatest("block", "o").alias("other"))
    return paired.groupBy("key", "one", "other").applyInArrow(verify, "a long, b long, similarity double")


def links(texts: DataFrame, classifier: boilerplate.Classifier | None = None) -> tuple[DataFrame, DataFrame]:
    """``(copies, links)`` of texts (id, text): (id, representative) of exact copies, and verified (a, b, similarity) of representatives."""
    rows = cut_lineage(_sketched(spread(texts), classifier))
    least = rows.groupBy("a", "b").agg(F.min("id").alias("representative"))
    copies = cut_lineage(rows.select("id", "a", "b").join(least, ["a", "b"]).select("id", "representative"))
    # Copies are mostly few, so they are sent rather than all signatures shuffled, if their number allows.
    repeated = copies.where("id <> representative").select("id")
    own = rows.join(broadcast_if_small(repeated, repeated.count(), 16), "id", "left_anti")
    sketched = own.select("id", "signature")
    banded = _keyed(own)
    # Every pair of a bucket is compared: pairs of small ones are listed once over all buckets, large ones go by blocks.
    # The two readings of the buckets share one exchange; writing them down instead would cost half the input of disk.
    bucket = Window.partitionBy("key")
    ordered = bucket.orderBy("id")
    sized = banded.withColumn("n", F.count("*").over(bucket))
    before = F.collect_list("id").over(ordered.rowsBetween(1 - LISTED, -1))
    pairs = sized.withColumn("before", before).where(F.col("n").between(2, LISTED)).select(F.explode("before").alias("a"), F.col("id").alias("b")).distinct()
    both = pairs.join(sketched.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(
        sketched.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b"
    )
    large = sized.withColumn("r", F.row_number().over(ordered)).where(F.col("n") > LISTED).select("id", "key", ((F.col("r") - 1) / BLOCK).cast("int").alias("block"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return copies, _agree(both).union(_agree_in_blocks(large.join(sketched, "id"))).dropDuplicates(["a", "b"])


def classes(texts: DataFrame, classifier: boilerplate.Classifier | None = None) -> DataFrame:
    """(id, class_id, links) of texts (id, text) in a class of at least two: the least id of the class, and the row's links to other texts.

    Ids must be unique. Null and empty bodies belong to no class.
    """
    copies, verified = links(texts.where("text is not null"), classifier)
    verified = cut_lineage(verified)
    joined = components.components(verified.select("a", "b"))
    degree = verified.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    labelled = (
        copies.join(joined.select(F.col("node").alias("representative"), "component"), "representative", "left")
        .join(degree, "representative", "left")
        .select("id", F.coalesce("component", "representative").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    sizes = labelled.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
    return labelled.join(sizes, "class_id").select("id", "class_id", "links", F.col("n").alias("class_size"))


def long_enough(jobs: DataFrame, words: int = 40) -> DataFrame:
    """(id, text) of the jobs whose description has at least so many blank-separated words."""
    return jobs.where(F.regexp_count("description", F.lit(r"\S+")) >= words).select(F.col("job_id").alias("id"), F.col("description").alias("text"))
