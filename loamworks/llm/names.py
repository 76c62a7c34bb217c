"""Variant spellings of organisation names: metric-space partitioning and exact radius joins.

A name is a core (the invented part) and a set of describing words (trade, region,
holding words). Which words describe is learnt from the names themselves: a
describing word stands beside many different cores, a core beside few words. Short
forms are learnt as well: letters of a longer describing word, in order, that stand
beside the same cores. Firms of other countries or with other describing words are
other firms, so the metric between two names is the edit distance of their cores
plus a distance no radius reaches where country or description differ.

Cores are assigned to parts by their distance to a pivot, the empty name, from
which a core is as far as it is long; by the triangle inequality a core within the
radius of another lies at most the radius further from the pivot, so boundary
cores are copied into the parts next to theirs. Large parts are compared in pairs
of blocks, so that no task holds a whole one. Inside a part the distances to one
more pivot for each letter (a long run of it: a core is as near as it holds the
letter) rule out most pairs, again by the triangle inequality, and the exact
Damerau distance, a true metric, decides the rest. Cores of any length are compared;
the distance of long ones is followed pair by pair, no further than the radius.
"""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from . import components

# Words of legal forms, in lower case without points.
LEGAL = {
    "pt", "cv", "tbk", "persero", "ud", "sdn", "bhd", "berhad", "pte", "ltd", "limited", "llp", "llc", "co", "company", "inc", "incorporated", "corp", "corporation", "plc", "public",
    "pty", "gmbh", "ag", "sa", "nv", "bv", "the",
}

# Countries as written.
COUNTRIES = {
    "id": "id", "indonesia": "id", "idn": "id", "my": "my", "malaysia": "my", "mys": "my", "sg": "sg", "singapore": "sg", "sgp": "sg", "th": "th", "thailand": "th", "tha": "th",
    "au": "au", "australia": "au", "nz": "nz", "new zealand": "nz", "hk": "hk", "hong kong": "hk", "ph": "ph", "philippines": "ph", "the philippines": "ph",
}

#: Edits within which two cores are one; a swap of neighbours is one edit (the unrestricted
#: Damerau distance, a metric). Two edits count only for a spelling that stands alone.
SLIP, RADIUS = 1, 2
#: Shortest core of which a slip or two are forgiven.
FORGIVEN = (5, 7)
#: Cores a describing word stands beside: so many at least, so large a share of all names (which bounds the words to
#: those that fit into the names so often), and so large a share of its own names.
SPREAD, SPREAD_SHARE, OWN_SHARE = 4, 1e-4, 0.08
#: A short form stands beside a longer word's cores in so many cases, and in so large a share of those with a choice.
TOGETHER, TOGETHER_SHARE = 2, 0.25
#: A describing word one edit from another that is so many times as frequent is a slip of it.
SLIPS = 20
#: Longest core and word compared by tables of many pairs and by forms with letters left out; longer ones are compared one by one.
LONGEST = 64
#: Cores and letters of a block; large parts are compared in pairs of blocks.
BLOCK, BLOCK_LETTERS = 512, 4 << 20
WORDS = "id long, country string, words array<string>"
PARSED = "id long, country string, described string, core string"


def damerau(a: str, b: str) -> int:
    """The unrestricted Damerau-Levenshtein distance, a metric."""
    last: dict[str, int] = {}
    most = len(a) + len(b)
    d = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        same = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), same
            cost = x != y
            if not cost:
                same = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def _common(a: str, b: str) -> int:
    """The letters two texts begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def damerau_within(a: str, b: str, most: int) -> int:
    """The same distance where it is ``most`` at most, else ``most`` + 1; for texts of any length."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    same = _common(a, b)
    a, b = a[same:], b[same:]
    if not a or not b:
        return len(a) + len(b)
    best = most + 1
    # The first letters differ: one is left out, or changed, or swapped over letters that are left out between.
    steps = [(1, 1, 1), (1, 0, 1), (0, 1, 1)]
    steps += [(i + 1, j + 1, i + j - 1) for i in range(1, min(most + 1, len(a))) for j in range(1, min(most + 2 - i, len(b))) if a[i] == b[0] and b[j] == a[0]]
    for i, j, cost in steps:
        if cost < best:
            best = min(best, cost + damerau_within(a[i:], b[j:], best - 1 - cost))
    return best


def name_words(company: str | None) -> list[str]:
    """The words of a typed name, without accents, acronyms in brackets and legal forms."""
    text = unicodedata.normalize("NFKD", company or "")
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().replace("&", " and ")
    text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"(?<=\w)[-'’](?=\w)", "", text)
    return [w for w in re.sub(r"[^\w]+", " ", text).split() if w not in LEGAL]


def _shorter(word: str, edits: int) -> set[str]:
    """The word with up to ``edits`` letters left out."""
    out = {word}
    for _ in range(edits):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


class Describing:
    """Learnt describing words: each with the word it stands for (itself, or the full form of a short one)."""

    def __init__(self, words: dict[str, str]):
        self.words = words
        self.near: dict[str, list[str]] = {}
        self.long: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONGEST:
                self.long.setdefault(len(w), []).append(w)
                continue
            for form in _shorter(w, self.forgiven(w)):
                self.near.setdefault(form, []).append(w)
        self.known: dict[str, str | None] = {}

    @staticmethod
    def forgiven(word: str) -> int:
        """Edits of a describing word that are taken for a slip."""
        return 2 if len(word) >= 8 else 1 if len(word) >= 5 else 0

    def met(self, word: str, most: int) -> set[str]:
        """Describing words that may lie within ``most`` (two at most) edits of ``word``."""
        found = {w for n in range(len(word) - most, len(word) + most + 1) for w in self.long.get(n, ())}
        return found if len(word) > LONGEST + most else found | {w for form in _shorter(word, most) for w in self.near.get(form, ())}

    def find(self, word: str) -> str | None:
        """The describing word that ``word`` is, shortens or misspells (one slip in words of five letters, two from eight on)."""
        if word in self.words:
            return self.words[word]
        if word not in self.known:
            most = self.forgiven(word)
            met = self.met(word, most) if most else set()
            near = sorted((d, w) for w in met if (d := damerau_within(word, w, most)) <= min(most, self.forgiven(w)))
            if len(self.known) < 200_000:
                self.known[word] = self.words[near[0][1]] if near else None
            else:
                return self.words[near[0][1]] if near else None
        return self.known[word]

    def parts(self, words: list[str]) -> tuple[str, str]:
        """``(describing words in order of the alphabet, core)``; a name of describing words only is its own core."""
        described, core = set(), []
        for word in words:
            known = self.find(word)
            if known:
                described.add(known)
            else:
                core.append(word)
        return (" ".join(sorted(described)), "".join(core)) if core else ("", "".join(words))


def within(short: str, long: str) -> bool:
    """Whether the letters of ``short`` stand in ``long`` in order."""
    letters = iter(long)
    return all(c in letters for c in short)


def _country(country: str | None) -> str:
    plain = " ".join((country or "").lower().split())
    return COUNTRIES.get(plain, plain)


def worded(rows: DataFrame) -> DataFrame:
    """(id, country, words) of rows (id, company, country); blank names give no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, _country(c), w) for i, n, c in zip(pdf.id, pdf.company, pdf.country, strict=True) if (w := name_words(n))]
            yield pd.DataFrame(out, columns=["id", "country", "words"])

    return rows.select("id", "company", "country").mapInPandas(read, WORDS)


def learnt(names: DataFrame) -> Describing:
    """The describing words of names (country, words).

    Each name's rarest word stands for its core; a describing word is one that is
    not the rarest beside many different cores. Their number is bounded by
    SPREAD_SHARE, so they are collected.
    """
    distinct = cut_lineage(names.select("country", "words").distinct())
    total = distinct.count()
    each = distinct.select("country", "words", F.explode(F.array_distinct("words")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    told = each.join(counts, "word").groupBy("country", "words").agg(F.collect_list(F.struct("n", "word")).alias("all"))
    told = told.select(F.array_min("all").alias("core"), F.explode("all").alias("other")).where("other.word <> core.word")
    spread = told.groupBy("other.word").agg(F.countDistinct("core.word").alias("cores"), F.first("other.n").alias("n"))
    found = spread.where((F.col("cores") >= F.greatest(F.lit(SPREAD), F.lit(SPREAD_SHARE * total))) & (F.col("cores") >= OWN_SHARE * F.col("n")))
    cores, count = {}, {}
    for r in found.toLocalIterator():
        cores[r.word], count[r.word] = r.cores, r.n
    words = {w: w for w in cores}
    index = Describing(words)
    for w in sorted(words):
        near = index.met(w, 1) - {w}
        better = [(count[v], v) for v in near if min(len(v), len(w)) >= FORGIVEN[0] and count[v] >= SLIPS * count[w] and damerau_within(v, w, 1) <= 1]
        if better:
            words[w] = max(better)[1]
    pairs = [(w, v) for w in words for v in words if len(w) < len(v) and words[w] == w and words[v] == v and within(w, v)]
    if pairs:
        full = _short_forms(distinct, Describing(words), pairs)
        words = {w: full.get(v, v) for w, v in words.items()}
    return Describing(words)


def _short_forms(distinct: DataFrame, describing: Describing, pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Which of the pairs (short, long) are short form and full word: the long word beside most of the short one's cores."""
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(describing)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for country, words in zip(pdf.country, pdf.words, strict=True):
                core = "".join(w for w in words if shared.value.find(w) is None)
                rows += [(country, core, x) for x in {shared.value.find(w) for w in words} - {None}] if core else []
            yield pd.DataFrame(rows, columns=["country", "core", "word"])

    beside = cut_lineage(distinct.mapInPandas(read, "country string, core string, word string").distinct())
    # Cores with one word only cannot tell.
    several = beside.groupBy("country", "core").agg(F.count("*").alias("n")).where("n > 1").select("country", "core")
    beside = beside.join(several, ["country", "core"])
    candidates = F.broadcast(spark.createDataFrame(pairs, "word string, long string"))
    longer = beside.withColumnRenamed("word", "long")
    both = beside.join(candidates, "word").join(longer, ["country", "core", "long"]).groupBy("word", "long").agg(F.count("*").alias("together"))
    each = beside.groupBy("word").agg(F.count("*").alias("n"))
    best: dict[str, tuple[int, str]] = {}
    for r in both.join(each, "word").where((F.col("together") >= TOGETHER) & (F.col("together") >= TOGETHER_SHARE * F.col("n"))).toLocalIterator():
        best[r.word] = max(best.get(r.word, (0, "")), (r.together, r.long))
    full = {w: v for w, (_, v) in best.items()}
    # A short form of a short form stands for the longest.
    return {w: full.get(v, v) for w, v in full.items()}


def parsed_names(names: DataFrame, describing: Describing) -> DataFrame:
    """(id, country, described, core) of names (id, country, words)."""
    shared = names.sparkSession.sparkContext.broadcast(describing)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, c, *shared.value.parts(list(w))) for i, c, w in zip(pdf.id, pdf.country, pdf.words, strict=True)], columns=["id", "country", "described", "core"])

    return names.mapInPandas(read, PARSED)


def coded(cores: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """``(letters as codes, lengths, codes)`` of cores; shorter ones end with a code of their own."""
    length = np.array([len(c) for c in cores], np.int64)
    flat = np.array([ord(x) for c in cores for x in c], np.int64)
    letters, codes = np.unique(flat, return_inverse=True)
    out = np.full((len(cores), int(length.max(initial=0))), len(letters), np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = codes
    return out, length, len(letters) + 1


def letter_counts(cores: list[str], length: np.ndarray) -> np.ndarray:
    """How often each letter stands in each core."""
    flat = np.frombuffer("".join(cores).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(flat, return_inverse=True)
    at = np.repeat(np.arange(len(cores)) * len(letters), length) + codes
    return np.bincount(at, minlength=len(cores) * len(letters)).reshape(len(cores), len(letters)).astype(np.int32)


def damerau_pairs(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, codes: int) -> np.ndarray:
    """The unrestricted Damerau-Levenshtein distance of each row of coded ``a`` and ``b``, all at once."""
    rows, la, lb = len(a), a.shape[1], b.shape[1]
    every = np.arange(rows)
    d = np.full((la + 2, lb + 2, rows), la + lb, np.int16)
    d[1:, 1], d[1, 1:] = np.arange(la + 1)[:, None], np.arange(lb + 1)[:, None]
    last = np.zeros((rows, codes), np.int64)
    for i in range(1, la + 1):
        same = np.zeros(rows, np.int64)
        for j in range(1, lb + 1):
            k = last[every, b[:, j - 1]]
            equal = a[:, i - 1] == b[:, j - 1]
            swap = d[k, same, every] + (i - k - 1) + 1 + (j - same - 1)
            d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~equal, swap), np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            same[equal] = j
        last[every, a[:, i - 1]] = i
    return d[na + 1, nb + 1, every].astype(np.int64)


def near_pairs(cores: list[str], others: list[str] | None = None, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(i, j, distance) of all cores within the radius, i < j; or of all of ``cores`` against all of ``others``.

    Pairs go on to the exact distance if their distances to the pivots allow it:
    an edit moves the length by one and the letters' counts by two at most.
    """
    every = cores + (others or [])
    length = np.array([len(c) for c in every], np.int64)
    counts = letter_counts(every, length)
    short = np.flatnonzero(length <= LONGEST)
    letters, _, codes = coded([every[k] for k in short])
    place = np.zeros(len(every), np.int64)
    place[short] = np.arange(len(short))
    at_once = max(1, min(20_000, 4_000_000 // max(1, counts.shape[1])))
    split = len(cores) if others is not None else 0
    out = []
    for start in range(0, len(cores), 256):
        rows = np.arange(start, min(start + 256, len(cores)))
        against = np.arange(split or start, len(every))
        far = np.abs(length[rows, None] - length[None, against]) > radius
        i, j = np.nonzero(~far)
        i, j = rows[i], against[j]
        if not split:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), at_once):
            x, y = i[at : at + at_once], j[at : at + at_once]
            keep = np.abs(counts[x] - counts[y]).sum(axis=1) <= 2 * radius
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            table = np.maximum(length[x], length[y]) <= LONGEST
            distance = np.zeros(len(x), np.int64)
            if table.any():
                p, q = x[table], y[table]
                distance[table] = damerau_pairs(letters[place[p]], length[p], letters[place[q]], length[q], codes)
            for k in np.flatnonzero(~table).tolist():
                distance[k] = damerau_within(every[x[k]], every[y[k]], radius)
            shorter = np.minimum(length[x], length[y])
            good = (distance <= radius) & ((distance == 0) | (shorter >= np.array([0, *FORGIVEN])[np.minimum(distance, radius)]))
            out += zip(x[good].tolist(), (y[good] - split).tolist(), distance[good].tolist(), strict=True)
    return out


def _parts(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the parts they stand in: (part, own, block, one, other).

    A part is a cell (country, description) and a distance from the empty name. A
    core is owned by the part of its length and a guest in those of up to RADIUS
    less. ``one`` and ``other`` are the blocks that are held against each other.
    """
    copies = nodes.withColumn("less", F.explode(F.sequence(F.lit(0), F.least(F.lit(RADIUS), F.length("core")))))
    copies = copies.withColumn("part", F.xxhash64("country", "described", F.length("core") - F.col("less"))).withColumn("own", F.col("less") == 0)
    sizes = copies.groupBy("part").agg(F.count("*").alias("size"), F.sum(F.length("core")).alias("letters"), F.max("own").alias("owned")).where("owned and size > 1")
    copies = copies.join(sizes, "part").withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("letters") / BLOCK_LETTERS)).cast("int"))
    copies = copies.withColumn("block", F.pmod(F.xxhash64("core"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return copies.select("node", "country", "described", "core", "n", "part", "own", "block", F.least("block", "o").alias("one"), F.greatest("block", "o").alias("other"))


def _join_part(cells: list[tuple], ids: list[int], cores: list[str], counts: list[int], own: np.ndarray, block: np.ndarray) -> list[tuple]:
    """The pairs of one pair of blocks; where two cells met by hash they are told apart. A pair belongs to the part of its shorter core."""
    low, high = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    if block.min() == block.max():
        found = [(low[i], low[j], d) for i, j, d in near_pairs([cores[k] for k in low])]
    else:
        found = [(low[i], high[j], d) for i, j, d in near_pairs([cores[k] for k in low], [cores[k] for k in high])]
    return [(min(ids[i], ids[j]), max(ids[i], ids[j]), d, *((counts[i], counts[j]) if ids[i] < ids[j] else (counts[j], counts[i]))) for i, j, d in found if (own[i] or own[j]) and cells[i] == cells[j]]


def spelled_alike(nodes: DataFrame) -> DataFrame:
    """(a, b, distance, na, nb) of the nodes (node, country, described, core, n) of one cell within the radius, each pair once."""

    def join(rows: pa.Table) -> pa.Table:
        pdf = rows.to_pandas().sort_values(["part", "one", "other"], kind="stable")
        keys = pdf[["part", "one", "other"]].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        cells, ids, cores, counts = list(zip(pdf.country, pdf.described, strict=True)), pdf.node.tolist(), pdf.core.tolist(), pdf.n.tolist()
        own, block, found = pdf.own.to_numpy(), pdf.block.to_numpy(), []
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)], strict=True):
            if end - at > 1:
                found += _join_part(cells[at:end], ids[at:end], cores[at:end], counts[at:end], own[at:end], block[at:end])
        return pa.table({c: pa.array([f[k] for f in found], t) for k, (c, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32()), ("na", pa.int64()), ("nb", pa.int64())))})

    # Many small parts share a group; a large part's pairs of blocks are dealt over all of them.
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("core")), F.lit(0)).alias("letters")).first()
    groups = max(4 * nodes.sparkSession.sparkContext.defaultParallelism, size.n // 1_000, size.letters // BLOCK_LETTERS)
    bucket = F.pmod(F.xxhash64("part", "one", "other"), F.lit(groups)).cast("int").alias("bucket")
    dealt = _parts(nodes).select("*", bucket).repartition(groups, "bucket")
    return dealt.groupBy("bucket").applyInArrow(join, "a long, b long, distance int, na long, nb long").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes that are one firm: one slip apart, or two where one of them occurs once and has no nearer neighbour."""
    pairs = cut_lineage(spelled_alike(nodes))
    slips = pairs.where(F.col("distance") <= SLIP)
    settled = slips.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    further = pairs.where(F.col("distance") > SLIP)
    a, b = (settled.select(F.col("node").alias(x), F.lit(True).alias(f"settled_{x}")) for x in ("a", "b"))
    alone = (F.col("settled_a").isNull() & (F.col("na") == 1)) | (F.col("settled_b").isNull() & (F.col("nb") == 1))
    further = further.join(a, "a", "left").join(b, "b", "left").where(alone)
    return slips.select("a", "b").unionByName(further.select("a", "b"))


def _shortened(nodes: DataFrame) -> DataFrame:
    """One row for each form of a core with a letter left out, and the core itself; two cores a slip apart share a form.

    Of two long cores a slip apart, all letters but two stand before or behind the
    slip. They share the half before or behind it, which is a form by its hash and
    by the length of the shorter core: its own or one less.
    """
    left_out = F.transform(F.sequence(F.lit(1), F.length("core")), lambda k: F.concat(F.substring("core", F.lit(1), k - 1), F.substring("core", k + 1, F.length("core"))))
    none = F.array().cast("array<string>")
    halves = []
    for n in (F.length("core"), F.length("core") - 1):
        half = F.floor((n - 2) / 2).cast("int")
        for side, start in (("before", F.lit(1)), ("behind", F.length("core") - half + 1)):
            halves.append(F.when(n >= LONGEST, F.concat_ws(":", F.lit(side), n.cast("string"), F.xxhash64(F.substring("core", start, half)).cast("string"))))
    forms = F.concat(
        F.array("core"),
        F.when(F.length("core").between(FORGIVEN[0], LONGEST), left_out).otherwise(none),
        F.when(F.length("core") >= LONGEST, F.array_compact(F.array(*halves))).otherwise(none),
    )
    return nodes.withColumn("form", F.explode(F.array_distinct(forms)))


def _one_slip(pairs: DataFrame) -> DataFrame:
    """The pairs (short_firm, core, full_core, firm) whose cores are one edit or one swap of neighbours apart, or equal."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[a == b or (min(len(a), len(b)) >= FORGIVEN[0] and damerau_within(a, b, 1) <= 1) for a, b in zip(pdf.core, pdf.full_core, strict=True)]]

    return pairs.mapInPandas(keep, pairs.schema)


def firms(rows: DataFrame) -> DataFrame:
    """(id, firm) of rows (id, company, country) with a name: the least id of the rows that mean the same firm.

    A name without describing words is a short form: it joins the firm of its
    country with that core if there is one only. Null and blank names give no row.
    """
    names = cut_lineage(worded(rows))
    parsed = cut_lineage(parsed_names(names, learnt(names)))
    nodes = parsed.groupBy("country", "described", "core").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    nodes = cut_lineage(nodes)
    grouped = components.components(links(nodes))
    placed = cut_lineage(nodes.join(grouped, "node", "left").withColumn("firm", F.coalesce("component", "node")).drop("component"))
    short = _shortened(placed.where("described = ''").select("core", "country", F.col("firm").alias("short_firm")))
    full = _shortened(placed.where("described <> ''").select("core", "country", "firm")).withColumnRenamed("core", "full_core")
    met = _one_slip(short.join(full, ["country", "form"]).select("short_firm", "core", "full_core", "firm").distinct())
    one = met.groupBy("short_firm").agg(F.min("firm").alias("firm"), F.countDistinct("firm").alias("firms")).where("firms = 1")
    joined = components.components(one.select(F.col("short_firm").alias("a"), F.col("firm").alias("b")))
    final = placed.join(joined.withColumnRenamed("node", "firm"), "firm", "left").select("country", "described", "core", F.coalesce("component", "firm").alias("firm"))
    return parsed.join(final, ["country", "described", "core"]).select("id", "firm")


def named_rows(enrichment: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, company, country) of both tables, whose ids are one number space."""
    return enrichment.select(F.col("row_id").alias("id"), "company", "country").unionByName(sample.select(F.col("sample_id").alias("id"), "company", "country"))
