"""Template residue, filler and error notices: trusted texts, spread to near-duplicates by SimHash.

Each field is cut into units (sentences and lines). Two kinds of units are residue
by themselves and stay alone: those that hold an unfilled placeholder, and whole
fields that are a bare filler. All other residue comes from a short list of
trusted texts: a unit near one of them is found through partitioned SimHash
tables, verified by Hamming distance and by edit similarity, and takes the label;
the label goes on from the units newly found until none is added. Every unit must
also stay near the trusted text its label started from, so that chains do not
drift into real content. A placeholder inside real content never spreads.

Only units near a trusted text can ever be reached, so these are told apart while
the fields are cut, by a lower bound of the edit distance to each trusted text, bit
by bit for many units at once. The rounds see them alone, each wording once and
only for the trusted texts it has no label of yet.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut_lineage, shared_folder, spread
from . import tokens

# Unfilled placeholders.
PLACEHOLDERS = [
    r"\{\{[^{}]*\}\}", r"\{%[^{}]*%\}", r"<%[^<>]*%>", r"<<[\w.]+>>", r"\$\{[\w.]+\}", r"@@[\w.]+@@", r"\b__[A-Za-z][\w.]*__", r"\[\[[\w. ]+\]\]",
    r"(?i)\[insert\b[^\]]*\]", r"(?i)\[[\w.]+(?: [\w.]+)? here\]", r"%[A-Za-z][A-Za-z_.]+%", r"\{[A-Za-z_][\w.]*\}", r"\[[a-z]+_[a-z_]+\]",
]

# Filler, error pages and script notices that are trusted to be residue.
SEEDS = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Lorem ipsum dolor sit amet, placeholder copy for the page layout number 1.", "Sample text goes here.", "Your text goes here.", "Insert description here.", "Replace this before publishing.", "Replace it before publishing.",
    "Description description description.", "Description to be added by someone later.", "This is placeholder text.", "This is dummy text.", "TODO add the description.", "TODO add the duties.", "TODO add benefits.", "TODO write the advert text for this job.",
    "404 Not Found", "404 - Page not found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "Service temporarily unavailable", "Service is temporarily unavailable.",
    "The page you asked for has been moved or does not exist.", "The page you requested could not be found.", "The page you are looking for does not exist.", "We can't seem to find the page you are looking for.", "We can't seem to find the vacancy you are looking for.", "Something went wrong, please try again later.",
    "You don't have permission to access this page on this server.", "Too many requests from your address.", "Checking your browser before you continue.", "Checking your browser before accessing this site.", "This content cannot be displayed in a frame.", "Your browser does not seem to support it.", "Your browser does not support JavaScript.",
    "Your session has expired.", "Your session has timed out.", "Sign in again to continue.", "Sign in again to see job 1.", "Internal error: cannot read property of undefined at line 1.", "Traceback: template page not found, line 1.",
    "Please enable JavaScript to view this page.", "Please enable JS to view this page.", "Please enable scripting to view this page.", "Please enable cookies to continue.", "JavaScript is required to use the careers portal.", "JS is required to use the careers portal.", "Scripting is required to use this site.", "You need to enable JavaScript to run this app.",
    "You need to allow scripts in your browser before this page can be shown.", "You need to allow scripts in your browser before this vacancy can be shown.", "Turn scripts on and reload.", "Turn JavaScript on and reload the page.",
    "Halaman yang Anda cari tidak ditemukan.", "Halaman tidak ditemukan.", "Seite nicht gefunden.", "Die Seite ist nicht mehr verfügbar.", "Die Stelle 1 ist nicht mehr verfügbar.", "Page introuvable.",
]

# Whole fields, in lower case.
WHOLE = [
    r"null", r"undefined", r"nan", r"none", r"n/a", r"\[object object\]", r"#(?:n/a|ref!|value!)", r"(?:no|your) (?:job )?title(?: here)?", r"job title(?: here| goes here)?", r"title here", r"untitled(?: \w+)?", r"test (?:job|post|vacancy|advert)\b.*\bignore\b.*", r"(?:sample|dummy|demo|test) (?:job|vacancy|post|posting|advert|position)\b.*", r".*\bdo not (?:publish|post)\b.*", r"(?:please )?ignore (?:this )?(?:test|job)\b.*",
    r"(?:asdf|qwer|qwerty|test|foo|bar|blah|xxx+)(?:[ -]?(?:asdf|qwer|qwerty|test|foo|bar|blah|xxx+))*", r"x{4,}", r"(?:copy of )+(?:template|untitled|document|job|advert|vacancy).*", r"template", r"just a moment(?:\.\.\.|…)?", r"access denied[.!]?", r"(?:error|http) ?[45]\d\d\b.*", r"error \d+", r"[45]\d\d(?: ?[-:–] ?| )(?:page )?(?:not found|forbidden|error).*", r"page not found.*", r"halaman tidak ditemukan.*", r"seite nicht gefunden.*", r"(?:loading|please wait)(?:\.\.\.|…)?", r"attention required!?.*", r"lorem ipsum.*",
]

CUT = r"[.!?]+\s+|[\n\r]+"
PLACEHOLDER = "|".join(f"(?:{p})" for p in PLACEHOLDERS)
WHOLE_FIELD = f"^(?:{'|'.join(WHOLE)})$"
#: Letters of a group; bits in which two units may differ.
GRAM, HAMMING = 2, 16
#: Edit similarity (1 less edits by length) to the unit a label comes from, and to the trusted text it started from.
SIMILARITY, ROOTED = 0.8, 0.6
#: Letters below which a trusted text stands for itself only.
SPREADS_FROM = 12
#: Lowest bit of each table's key, whose bits wrap around, and the bits of a key.
TABLES, KEY_BITS = tuple(range(0, 64, 2)), 12
#: Labelled texts of a round up to which their tables are sent to every task; more are met in blocks of BLOCK texts.
SENT, BLOCK = 20_000, 4_096
#: Rounds a label may travel; a round more is an error, not a cut.
ROUNDS = 40
CHUNK = 2_000
#: Pairs of a unit and a trusted text whose edit distances are bounded at once.
PAIRS = 16_384
UNITS = "job_id long, field_name string, units long, trusted long, near array<struct<unit: string, simhash: long, roots: array<int>>>"

MET = pa.schema([("unit", pa.string()), ("simhash", pa.int64()), ("root", pa.string()), ("near", pa.string())])

_LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def normal(units: pa.Array) -> pa.Array:
    """Lower case, digits as 0, and nothing but letters, digits and single blanks."""
    plain = pc.replace_substring_regex(pc.utf8_lower(units), r"\d+", "0")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(plain, r"[^\pL\pN]+", " "))


def grams(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the groups of GRAM bytes, offsets by unit); a shorter unit is one group."""
    units = units.cast(pa.large_binary())
    offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(units) else np.zeros(0, np.uint8)
    letters = data.astype(np.uint64) + np.uint64(1)
    return tokens.shingles(letters, offsets - offsets[0], GRAM)


def simhashes(units: pa.Array) -> np.ndarray:
    """The 64-bit SimHash of each unit's letter groups; 0 for an empty unit."""
    hashes, offsets = grams(units)
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    if not len(hashes):
        return out
    for long in np.flatnonzero(n > 255):
        own = hashes[offsets[long] : offsets[long + 1]]
        ones = ((own[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
        out[long] = np.uint64(sum(1 << b for b in range(64) if 2 * ones[b] > n[long]))
    short = np.flatnonzero((n > 0) & (n <= 255))
    if len(short):
        keep = np.repeat((n > 0) & (n <= 255), n)
        own = hashes[keep]
        first = np.cumsum(n[short]) - n[short]
        for byte in range(8):
            lanes = np.add.reduceat(_LANES[((own >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)], first)
            for b in range(8):
                ones = (lanes >> np.uint64(8 * b)) & np.uint64(255)
                out[short] |= (2 * ones.astype(np.int64) > n[short]).astype(np.uint64) << np.uint64(8 * byte + b)
    return out


def letter_codes(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all units, offsets by unit)."""
    units = units.cast(pa.large_binary())
    offsets = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1] if len(units) else np.zeros(1, np.int64)
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if (data < 128).all():
        return data, offsets
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), starts[offsets]


class Roots:
    """The trusted texts that labels start from, and the units that can be similar enough to them."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(texts))))}
        self.counts = np.array([[t.count(c) for c in self.letters] for t in texts], np.uint8).reshape(len(texts), len(self.letters))
        # Where each letter stands in the first 64 letters of a text, as bits; the last column is that of all other letters.
        self.places = np.zeros((len(texts), len(self.letters) + 1), np.uint64)
        for k, t in enumerate(texts):
            for at, c in enumerate(t[:64]):
                self.places[k, self.letters[c]] |= np.uint64(1 << at)
        self.class_of = np.full(max(map(ord, self.letters), default=0) + 2, len(self.letters), np.uint8)
        for c, k in self.letters.items():
            self.class_of[ord(c)] = k

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The edits that texts of these lengths may differ by."""
        return np.floor((1 - ROOTED) * np.maximum(a, b) + 1e-6).astype(np.int64)

    def near(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (unit, text), in order, but for those whose edit distance is surely too large."""
        flat, offsets = letter_codes(units)
        length = np.diff(offsets)
        reach = self.length.max(initial=0)
        able = np.flatnonzero((length > 0) & (length <= reach + self.allowed(reach, np.ceil(reach / ROOTED))))
        if not len(able) or not len(self.texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = length[able]
        letters = np.full((int(n.max()), len(able)), len(self.letters), np.uint8)
        column = np.repeat(np.arange(len(able)), n)
        row = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)
        own = self.class_of[np.minimum(flat[np.repeat(offsets[able], n) + row], len(self.class_of) - 1)]
        letters[row, column] = own
        counts = np.bincount(own.astype(np.int64) * len(able) + column, minlength=(len(self.letters) + 1) * len(able)).reshape(-1, len(able))
        counts = np.minimum(counts, 255).astype(np.uint8)
        pairs = []
        for k, m in enumerate(self.length.tolist()):
            # An edit changes one letter; letters that are not common need one each.
            common = np.zeros(len(able), np.uint8)
            for c in np.flatnonzero(self.counts[k]):
                common += np.minimum(counts[c], self.counts[k, c])
            some = np.flatnonzero(np.maximum(n, m) - common <= self.allowed(n, m))
            pairs.append(some * len(self.texts) + k)
        unit, root = np.divmod(np.concatenate(pairs), len(self.texts))
        order = np.argsort(-n[unit], kind="stable")
        unit, root = unit[order], root[order]
        keep = [np.zeros(0, np.int64)]
        for at in range(0, len(unit), PAIRS):
            x, y = unit[at : at + PAIRS], root[at : at + PAIRS]
            good = self.least_edits(letters, n, x, y) <= self.allowed(n[x], self.length[y])
            keep.append(able[x[good]] * len(self.texts) + y[good])
        return np.divmod(np.sort(np.concatenate(keep)), len(self.texts))

    def least_edits(self, letters: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The edit distance of each unit ``x`` (longest first) to the text ``y`` by Myers' bit vectors; for a text of more than 64 letters a lower bound of it."""
        one, length = np.uint64(1), n[x]
        rest = self.length[y] - np.minimum(self.length[y], 64)
        score = self.length[y] - rest
        top = (score - 1).astype(np.uint64)
        bound = score + np.abs(length - rest)
        up, down = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
        places, first = self.places.ravel(), y * self.places.shape[1]
        for j in range(int(length.max(initial=0))):
            a = int(np.searchsorted(-length, -j, "left"))
            equal = places[first[:a] + letters[j][x[:a]]]
            p, m = up[:a], down[:a]
            vertical = equal | m
            level = (((equal & p) + p) ^ p) | equal
            plus, minus = m | ~(level | p), p & level
            score[:a] += ((plus >> top[:a]) & one).astype(np.int64) - ((minus >> top[:a]) & one).astype(np.int64)
            plus, minus = (plus << one) | one, minus << one
            up[:a], down[:a] = minus | ~(vertical | plus), plus & vertical
            # What is left of the unit stands against what is left of the text.
            if rest.any():
                bound[:a] = np.minimum(bound[:a], score[:a] + np.abs(length[:a] - j - 1 - rest[:a]))
        return np.where(rest > 0, bound, score)


def root_texts() -> list[str]:
    """The trusted texts in normal form, in order."""
    return sorted(set(normal(pa.array(SEEDS, pa.large_string())).to_pylist()))


def cut_units(batch: pa.RecordBatch, roots: Roots) -> pa.RecordBatch:
    """For each field of a batch (job_id, title, description): its units, how many are residue by themselves (``trusted``), and those of the others that a label may reach (``near``) with the roots it may start from."""
    rows = []
    for field in ("title", "description"):
        texts = tokens.unescaped(tokens.column(batch, field))
        whole = pc.match_substring_regex(pc.utf8_lower(pc.utf8_trim_whitespace(texts)), WHOLE_FIELD)
        lists = pc.split_pattern_regex(texts, CUT)
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        raw = pc.replace_substring_regex(pc.list_flatten(lists), r"^[\s•*·-]+", "")
        trusted = pc.or_(pc.match_substring_regex(raw, PLACEHOLDER), whole.take(pa.array(owner)))
        units = normal(raw)
        filled = pc.greater(pc.binary_length(units), 0).to_numpy(zero_copy_only=False)
        trusted = trusted.to_numpy(zero_copy_only=False)
        count = lambda which: pa.array(np.bincount(owner[which], minlength=len(texts)))  # noqa: B023, E731
        others = np.flatnonzero(filled & ~trusted)
        unit, root = roots.near(units.take(pa.array(others)))
        own, first = np.unique(unit, return_index=True)
        near, near_owner = units.take(pa.array(others[own])), owner[others[own]]
        starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(root)), pa.int32()), pa.array(root, pa.int32()))
        found = pa.StructArray.from_arrays([near.cast(pa.string()), pa.array(simhashes(near).view(np.int64)), starts], names=["unit", "simhash", "roots"])
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(near_owner, np.arange(len(texts) + 1)), pa.int32()), found)
        columns = [batch.column("job_id"), pa.array([field] * len(texts), pa.string()), count(filled | trusted), count(trusted), found]
        rows.append(pa.RecordBatch.from_arrays(columns, names=["job_id", "field_name", "units", "trusted", "near"]))
    return pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if batch.num_rows else rows[0]


def _units(fields: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = Roots(root_texts())
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield cut_units(batch.slice(at, CHUNK), roots)

    return spread(fields.select("job_id", "title", "description")).mapInArrow(cut, UNITS)


def _alike(a: str, b: str, least: float):
    """Whether two texts are so similar by edits; the distance is not followed beyond what is allowed, which gives -1."""
    edits = f"cast(floor({1 - least:.6f} * greatest(length({a}), length({b}))) AS int)"
    return F.expr(f"levenshtein({a}, {b}, {edits}) >= 0")


def seeds(spark: SparkSession) -> DataFrame:
    """(unit, simhash, root) of the trusted texts; ``root`` is the text a label starts from."""
    units = normal(pa.array(SEEDS, pa.large_string()))
    rows = sorted({(u, h, u) for u, h in zip(units.to_pylist(), simhashes(units).view(np.int64).tolist(), strict=True)})
    return spark.createDataFrame(rows, "unit string, simhash long, root string")


def table_keys(hashes: np.ndarray, low: int) -> np.ndarray:
    """The keys of SimHashes in the table whose lowest bit is ``low``."""
    turned = hashes >> np.uint64(low) | hashes << np.uint64(64 - low) if low else hashes
    return (turned & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)


class Tables:
    """The tables of labelled texts as arrays: for each table, the texts in order of their key and where each key starts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.order, self.start = hashes, [], []
        for low in TABLES:
            keys = table_keys(hashes, low)
            self.order.append(np.argsort(keys, kind="stable"))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << KEY_BITS))]))

    def met(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (row of ``hashes``, labelled text) that share a table's key and differ in HAMMING bits at most, each once."""
        found = [np.zeros(0, np.int64)]
        for low, order, start in zip(TABLES, self.order, self.start, strict=True):
            keys = table_keys(hashes, low)
            n = start[keys + 1] - start[keys]
            row = np.repeat(np.arange(len(hashes)), n)
            other = order[np.repeat(start[keys], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
            near = np.bitwise_count(hashes[row] ^ self.hashes[other]) <= HAMMING
            found.append(row[near] * len(self.hashes) + other[near])
        return np.divmod(np.unique(np.concatenate(found)), max(len(self.hashes), 1))


def _meet(candidates: pa.RecordBatch, texts: pa.Array, hashes: np.ndarray, table: Tables, nearest: bool) -> Iterator[pa.RecordBatch]:
    """The candidates (unit, simhash, root) of one root with the labelled texts that they meet, or with the nearest of these only."""
    own = candidates.column("simhash").to_numpy(zero_copy_only=False).view(np.uint64)
    for at in range(0, len(own), CHUNK):
        row, other = table.met(own[at : at + CHUNK])
        row = row + at
        if nearest:
            order = np.lexsort((other, np.bitwise_count(own[row] ^ hashes[other]), row))
            first = order[np.unique(row[order], return_index=True)[1]]
            row, other = row[first], other[first]
        found = candidates.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([*(found.column(c) for c in ("unit", "simhash", "root")), texts.take(pa.array(other))], schema=MET)


def _met_in_tables(candidates: DataFrame, frontier: list, nearest: bool) -> DataFrame:
    """(unit, simhash, root, near) of candidates that share a table's key with a text of the same root in a small ``frontier``, which every task holds."""
    shared = candidates.sparkSession.sparkContext.broadcast([tuple(r) for r in frontier])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled = {}
        for unit, simhash, root in shared.value:
            labelled.setdefault(root, []).append((unit, simhash))
        tables = {}
        for batch in batches:
            for root in batch.column("root").unique().to_pylist():
                if root in labelled and root not in tables:
                    hashes = np.array([h for _, h in labelled[root]], np.int64).view(np.uint64)
                    tables[root] = (pa.array([u for u, _ in labelled[root]], pa.string()), hashes, Tables(hashes))
                if root in tables:
                    yield from _meet(batch.filter(pc.equal(batch.column("root"), root)), *tables[root], nearest)

    return candidates.mapInArrow(meet, "unit string, simhash long, root string, near string")


def _met_in_blocks(candidates: DataFrame, frontier: DataFrame, nearest: bool) -> DataFrame:
    """Alike for a frontier of any size: blocks of the candidates of a root against blocks of its labelled texts."""
    one, other = (-(-df.count() // BLOCK) or 1 for df in (candidates, frontier))
    block = lambda n: F.pmod(F.xxhash64("unit"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = candidates.select("unit", "simhash", "root", F.lit(False).alias("labelled"), block(one).alias("one"), every(other).alias("other"))
    both = both.unionByName(frontier.select("unit", "simhash", "root", F.lit(True).alias("labelled"), every(one).alias("one"), block(other).alias("other")))

    def meet(rows: pa.Table) -> pa.Table:
        own, own_texts = (rows.filter(x).combine_chunks() for x in (pc.invert(rows["labelled"]), rows["labelled"]))
        if not own.num_rows or not own_texts.num_rows:
            return MET.empty_table()
        hashes = own_texts["simhash"].to_numpy().view(np.uint64)
        texts = own_texts["unit"].combine_chunks().cast(pa.string())
        return pa.Table.from_batches(list(_meet(own.to_batches()[0], texts, hashes, Tables(hashes), nearest)), MET)

    return both.groupBy("root", "one", "other").applyInArrow(meet, "unit string, simhash long, root string, near string")


def near_units(candidates: DataFrame, frontier: DataFrame) -> DataFrame:
    """The ``candidates`` (unit, simhash, root) that a label of ``frontier`` reaches, each once.

    Each is held against the nearest text it meets; only where that is not
    similar enough against all others it meets.
    """
    spreading = frontier.where(F.length("unit") >= SPREADS_FROM).select("unit", "simhash", "root")
    few = spreading.limit(SENT + 1).collect()
    alike_long = F.length("unit").between(F.length("near") * SIMILARITY, F.length("near") / SIMILARITY)

    def reached(rows: DataFrame, nearest: bool) -> DataFrame:
        # Few bytes, but much work for each.
        tasks = min(4 * rows.sparkSession.sparkContext.defaultParallelism, 1 + rows.count() // 500)
        rows = rows.select("unit", "simhash", "root").repartition(tasks)
        pairs = _met_in_tables(rows, few, nearest) if len(few) <= SENT else _met_in_blocks(rows, spreading, nearest)
        return pairs.where(alike_long & _alike("unit", "near", SIMILARITY)).select("unit", "simhash", "root").distinct()

    first = cut_lineage(reached(candidates, True))
    return first.unionByName(reached(candidates.join(first, ["unit", "root"], "left_anti"), False))


def residue_units(fields: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(cut, labelled)``: the fields as cut, and the units (unit, root) the labels reach; both written below ``folder``."""
    spark = fields.sparkSession
    _units(fields).write.parquet(f"{folder}/units", compression="zstd")
    cut = spark.read.parquet(f"{folder}/units")
    texts = F.array(*(F.lit(t) for t in root_texts()))
    each = cut.select(F.explode("near").alias("x")).select("x.unit", "x.simhash", F.explode("x.roots").alias("k"))
    each = each.select("unit", "simhash", F.element_at(texts, F.col("k") + 1).alias("root")).distinct()
    each.where(_alike("unit", "root", ROOTED)).write.parquet(f"{folder}/candidates", compression="zstd")
    candidates = spark.read.parquet(f"{folder}/candidates")
    # A short trusted text is met by the same text only.
    equal = candidates.where((F.length("root") < SPREADS_FROM) & (F.col("unit") == F.col("root")))
    frontier, labelled = seeds(spark), None
    for k in range(ROUNDS + 1):
        # A wording that has a root's label needs it no more.
        left = candidates if labelled is None else candidates.join(labelled, ["unit", "root"], "left_anti")
        found = near_units(left, frontier)
        found = found.unionByName(equal) if labelled is None else found
        found.write.parquet(f"{folder}/labelled/{k}", compression="zstd")
        frontier = spark.read.parquet(f"{folder}/labelled/{k}")
        labelled = spark.read.parquet(*(f"{folder}/labelled/{i}" for i in range(k + 1)))
        if frontier.isEmpty():
            return cut, labelled
    raise RuntimeError(f"labels still travel after {ROUNDS} rounds")


def fields_with_residue(jobs: DataFrame) -> DataFrame:
    """(job_id, field_name, units, residue): each field that holds residue, its units and how many of them are residue.

    Null and empty fields hold none; repeated rows of a job count together.
    """
    folder = f"{shared_folder(jobs.sparkSession)}/residue-{uuid.uuid4().hex}"
    cut, labelled = residue_units(jobs, folder)
    # Texts of residue, sent only while they are few: their number follows the wordings in use, not the rows.
    reached = labelled.select("unit").distinct()
    reached = broadcast_if_small(reached, labelled.count(), 300)
    near = cut.select("job_id", "field_name", F.explode("near.unit").alias("unit")).join(reached, "unit")
    counts = cut.select("job_id", "field_name", "units", F.col("trusted").alias("residue"))
    counts = counts.unionByName(near.select("job_id", "field_name", F.lit(0).cast("long").alias("units"), F.lit(1).cast("long").alias("residue")))
    return counts.groupBy("job_id", "field_name").agg(F.sum("units").alias("units"), F.sum("residue").alias("residue")).where("residue > 0")
