"""Texts laid into sequences of a fixed token capacity: shortest-pack-first over the length histogram.

Only the histogram of lengths, which has at most ``capacity`` bins, reaches the
driver. Lengths are placed longest first; a pattern is a multiset of lengths with
the number of sequences that follow it, and each bin joins the shortest packs
first, those with the most room left. (The rule "tightest" joins those with the
least room that still fits instead, which fills a little better.) The patterns are
then joined back to the documents by their rank among those of equal length. A text
longer than the capacity gives whole sequences of its own; its rest is packed
like any text.
"""

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage, spread
from . import tokens

CAPACITY = 2048
#: The public vocabulary that counts tokens; a folder other than the installed one may be named.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Parts into which the documents of one length are dealt for ranking, so that no length is one task's.
SALTS = 64

_encodings: dict[str, object] = {}


def encoding(path: str | None = None):
    """The tokenizer, built once a worker."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every document with a token; null and empty texts give no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = np.array([len(encode(t)) for t in tokens.column(batch, "text").to_pylist()], np.int64)
            keep = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), pa.array(n).filter(keep)], names=["doc_id", "n_tokens"])

    return spread(documents.where("text is not null").select("doc_id", "text")).mapInArrow(count, "doc_id long, n_tokens long")


def patterns(histogram: dict[int, int], capacity: int, rule: str = "shortest") -> list[tuple[int, tuple[int, ...]]]:
    """``(sequences, lengths in each)`` holding each length of the histogram as often as it occurs.

    Longest lengths first. By the rule "shortest" a length goes once into each of
    the packs with the most room, by "tightest" as often as it fits into those with
    the least room that fits it; what finds no room opens new packs, one full of it
    after the other. The work depends on the number of bins, not of documents.
    """
    if rule not in ("shortest", "tightest"):
        raise ValueError(f"rule {rule}")
    room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(left: int, count: int, lengths: tuple) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        same = room[left]
        if same and same[-1][1] == lengths:
            same[-1][0] += count
        else:
            same.append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = bisect_left(rooms, length)
            if fits == len(rooms):
                # One pack after the other is opened and filled, as all others are too full.
                whole, rest = divmod(left, capacity // length)
                for n, copies in ((whole, capacity // length), (1, rest)):
                    if n and copies:
                        put(capacity - copies * length, n, (length,) * copies)
                break
            k = len(rooms) - 1 if rule == "shortest" else fits
            at = rooms[k]
            count, lengths = room[at].pop()
            if not room[at]:
                del room[at]
                rooms.pop(k)
            copies = 1 if rule == "shortest" else min(at // length, left)
            use = min(count, left // copies)
            if count > use:
                put(at, count - use, lengths)
            put(at - copies * length, use, lengths + (length,) * copies)
            left -= use * copies
    return [(n, lengths) for same in room.values() for n, lengths in same]


def _ranked(pieces: DataFrame, bins: int) -> DataFrame:
    """``pieces`` with the 0-based rank among those of equal length, in the order of salt and id.

    Each length is dealt over SALTS parts; the parts are counted, and each rank is
    the part's start plus the rank within it, so no window spans a hot length.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int"))
    within = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "part")) - 1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    starts = counts.withColumn(
        "start", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    ).drop("n")
    # A row for each length and salt at most: its number follows the capacity, not the documents.
    starts = broadcast_if_small(starts, bins * SALTS, 32)
    return within.join(starts, ["length", "salt"]).select("doc_id", "part", "length", (F.col("start") + F.col("within")).alias("rank"))


def _slots(spark: SparkSession, found: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """Where the ranks of each length go: ranks from ``low`` on fill ``copies`` places of ``n`` sequences from ``first`` on."""
    rows, next_rank, first = [], {}, 0
    for n, lengths in found:
        offset, k = 0, 0
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            low = next_rank.get(length, 0)
            rows.append((length, low, low + n * copies, first, copies, offset, k))
            next_rank[length] = low + n * copies
            offset += copies * length
            k += copies
        first += n
    schema = "length long, low long, high long, first long, copies int, offset int, place int"
    return spark.createDataFrame(rows, schema)


def pack(counts: DataFrame, capacity: int = CAPACITY, rule: str = "shortest") -> DataFrame:
    """Each document's place: (doc_id, part, sequence_id, position, n_tokens).

    ``position`` is the first token's place in the sequence. A document of up to
    ``capacity`` tokens is whole (part 0); a longer one has parts of ``capacity``
    tokens, each alone in a sequence, and a last part that is packed. Null or
    non-positive counts give no row. Equal ids with unequal counts are told apart
    by nothing, hence ids should be unique.
    """
    if capacity < 1:
        raise ValueError(f"capacity {capacity}")
    spark = counts.sparkSession
    own = cut_lineage(counts.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")))
    whole = F.when(F.col("n_tokens") > capacity, F.floor(F.col("n_tokens") / capacity)).otherwise(0).cast("long")
    last = F.when(F.col("n_tokens") > capacity, F.col("n_tokens") % capacity).otherwise(F.col("n_tokens"))
    packed = own.select("doc_id", whole.alias("part"), last.alias("length")).where("length > 0")
    full = own.where(F.col("n_tokens") > capacity).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part"), F.lit(capacity).cast("long").alias("length")
    )
    pieces = packed.unionByName(full)
    # At most one row a length: bounded by the capacity.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = patterns(histogram, capacity, rule)
    ranked = _ranked(pieces, len(histogram))
    slots = _slots(spark, found)
    # The patterns follow the bins, not the documents: at most a few for each of ``capacity`` lengths.
    at = F.col("rank") - F.col("low")
    return (
        ranked.join(broadcast_if_small(slots, sum(len(set(lengths)) for _, lengths in found), 64), "length")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select(
            "doc_id",
            F.col("part").cast("int").alias("part"),
            (F.col("first") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("offset") + at % F.col("copies") * F.col("length")).cast("int").alias("position"),
            F.col("length").cast("int").alias("n_tokens"),
        )
    )
