"""Duplicate rows of one owner by a pair rule, without comparing all pairs.

A pair that the rule links shares an external id, a job id in its URL, or has a
title similarity of at least 0.75. The first two come from equality joins within
the owner. For the third, the rows of an owner whose titles have the same words are
one class; classes whose titles are alike are sought among the distinct titles
alone, where only the rarest few words of a title are keys, which by prefix
filtering loses none. Each row is then sent once to its class, and once to each
class that its own is alike to; there a task compares the texts in blocks, so that
candidate pairs are never written down. Rows alike in every field the rule reads
are one row (they share their page, so they are no pair of each other), and of a
description only the words among the signs the rule reads travel.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as tx
from ..functions.urls import url_job_id

# Trust in the methods that made a row.
METHOD_TRUST = {"schema_org": 6, "ats_api": 5, "ats_html": 4, "hybrid": 4, "llm": 3, "structural": 2, "root_fallback": 1, "domain_signal": 1}
#: Signs of a description that the rule reads.
SIGNS = 1_000
FIELDS = ["id", "owner", "page", "external_id", "url_id", "title", "description", "location_raw", "date_posted"]
#: The score that two rows need, if both have a page and if not.
BOTH_PAGES, ELSE_SCORE = 0.72, 0.65
#: Rows of a class that one task holds; the rows of a larger class meet as pairs of such blocks.
BLOCK = 2_048
#: Rows a side, and words, of one product of matrices.
TILE, WORDS = 512, 4_096
#: Bytes of a row in the tables of titles and of shared ids.
ROW_BYTES = 160


def prepared(jobs: DataFrame) -> DataFrame:
    """The fields the rule reads, of job rows; the page is the row's own URL."""
    return jobs.select(
        F.col("job_id").alias("id"), F.col("company_id").alias("owner"), F.col("source_url").alias("page"), "external_id", url_job_id(F.col("source_url")).alias("url_id"), "title", F.substring("description", 1, SIGNS).alias("description"), "location_raw", "date_posted"
    )


def digest() -> Column:
    """Equal for rows that are alike in every field the rule reads."""
    return F.unhex(F.sha2(F.to_json(F.struct(*(f for f in FIELDS if f != "id"))), 256))


def copies(rows: DataFrame) -> DataFrame:
    """(id, representative): the least id of the rows that are alike in every field the rule reads."""
    return rows.select("id", digest().alias("d")).select("id", F.min("id").over(Window.partitionBy("d")).alias("representative"))


def pair_rule(a: str, b: str, both_pages: float = BOTH_PAGES, else_score: float = ELSE_SCORE) -> tuple[Column, Column]:
    """(whether two rows are one, the title similarity). Rows of the same page are never a pair; two rows without a page count as the same page."""
    c = lambda side, f: F.col(f"{side}.{f}")
    same_page = c(a, "page").eqNullSafe(c(b, "page"))
    filled = lambda f: (F.coalesce(c(a, f), F.lit("")) != "") & (c(a, f) == c(b, f))
    title = tx.title_similarity(c(a, "title"), c(b, "title"))
    score = (
        0.4 * title
        + 0.35 * tx.either_similarity(c(a, "description"), c(b, "description"), SIGNS, 0.5, 0.0)
        + 0.15 * tx.either_similarity(c(a, "location_raw"), c(b, "location_raw"), None, 0.5, 0.5)
        + 0.1 * tx.date_proximity(c(a, "date_posted"), c(b, "date_posted"))
    )
    needed = F.when(c(a, "page").isNotNull() & c(b, "page").isNotNull(), both_pages).otherwise(else_score)
    linked = filled("external_id") | filled("url_id") | ((title >= 0.75) & (F.round(score, 9) >= needed))
    return ~same_page & F.coalesce(linked, F.lit(False)), title


def title_words() -> Column:
    """The words of a title in order; titles that are equal once normal have the same, so the similarity of two titles is that of these."""
    return F.array_sort(tx.title_tokens(tx.normal_title(F.col("title"))))


def pairs_by_id(rows: DataFrame) -> DataFrame:
    """(a, b, title) of representatives with the same external id or job id in their URLs."""
    from ..runtime import broadcast_if_small, cut_lineage

    own = lambda kind, column: F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(kind), column))
    named = F.array_compact(F.array(own("e:", F.col("external_id")), own("u:", F.col("url_id"))))
    keys = rows.select("owner", F.explode(named).alias("key"), "id", "page", title_words().alias("words"), digest().alias("d"))
    shared = cut_lineage(keys.groupBy("owner", "key").agg(F.count("*").alias("n")).where("n > 1").select("owner", "key"))
    met = keys.join(broadcast_if_small(shared, shared.count(), ROW_BYTES), ["owner", "key"])
    # Alike rows have the same keys, so the least of those that meet is their representative.
    met = met.groupBy("owner", "key", "d").agg(F.min("id").alias("id"), F.first("page").alias("page"), F.first("words").alias("words"))
    x, y = (met.select("owner", "key", F.col("id").alias(i), F.col("page").alias(f"{i}_page"), F.col("words").alias(f"{i}_words")) for i in "ab")
    pairs = x.join(y, ["owner", "key"]).where((F.col("a") < F.col("b")) & ~F.col("a_page").eqNullSafe(F.col("b_page")))
    return pairs.select("a", "b", tx.jaccard(F.col("a_words"), F.col("b_words")).alias("title"))


def similar_titles(classes: DataFrame) -> DataFrame:
    """(owner, words, other, title) of an owner's titles alike in 0.75, words < other. Two such share one of the first n - ceil(3n / 4) + 1 words in the order of rarity (prefix filtering)."""
    each = classes.where("words <> ''").select("owner", "words", F.explode(F.split("words", " ")).alias("word"))
    counts = each.groupBy("owner", "word").agg(F.count("*").alias("n"))
    own = Window.partitionBy("owner", "words")
    ranked = each.join(counts, ["owner", "word"]).withColumn("place", F.row_number().over(own.orderBy("n", "word"))).withColumn("size", F.count("*").over(own))
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.lit(0.75) * F.col("size")) + 1).select("owner", "word", "words", "size")
    other = prefix.select("owner", "word", F.col("words").alias("other"), F.col("size").alias("other_size"))
    near = prefix.join(other, ["owner", "word"]).where("words < other and 4 * least(size, other_size) >= 3 * greatest(size, other_size)")
    near = near.withColumn("title", tx.jaccard(F.split("words", " "), F.split("other", " "))).where("title >= 0.75")
    return near.select("owner", "words", "other", "title").distinct()


def seats(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(owner, words, home, title, blocks, guest): the class at which rows with these words meet their like, its number of blocks, and the similarity of the titles. Classes of a single row that no other is alike to have none."""
    from ..runtime import cut_lineage

    classes = rows.groupBy("owner", "words").agg(F.count("*").alias("n"))
    classes = cut_lineage(classes.select("owner", "words", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    alike = cut_lineage(similar_titles(classes))
    guests = alike.join(classes, ["owner", "words"]).select("owner", F.col("other").alias("words"), F.col("words").alias("home"), "title", "blocks", F.lit(True).alias("guest"))
    hosts = classes.where("n > 1").unionByName(classes.where("n = 1").join(alike, ["owner", "words"], "left_semi"))
    return cut_lineage(hosts.select("owner", "words", F.col("words").alias("home"), F.lit(1.0).alias("title"), "blocks", F.lit(False).alias("guest")).unionByName(guests))


class Tile:
    """Some rows with the codes of their words; words that ``codes`` lacks count in the sizes only, unless ``learn``."""

    def __init__(self, rows: list[dict], codes: dict[str, int], learn: bool):
        self.ids, self.pages = [r["id"] for r in rows], [r["page"] for r in rows]
        self.title = np.array([r["title"] for r in rows])
        self.day = np.array([np.nan if r["day"] is None else r["day"] for r in rows], dtype=np.float64)
        self.fields = {}
        for f in ("description", "location_raw"):
            at, code, size = [], [], []
            for i, r in enumerate(rows):
                words = (r[f] or "").split()
                size.append(len(words))
                known = [codes.setdefault(w, len(codes)) for w in words] if learn else [codes[w] for w in words if w in codes]
                at += [i] * len(known)
                code += known
            self.fields[f] = np.array(at, dtype=np.int64), np.array(code, dtype=np.int64), np.array(size), np.array([r[f] is None for r in rows])


def shared_words(x: tuple, y: tuple, codes: int) -> np.ndarray:
    """How many words each row of ``x`` shares with each of ``y``."""
    in_x, in_y = np.zeros(codes, dtype=bool), np.zeros(codes, dtype=bool)
    in_x[x[1]], in_y[y[1]] = True, True
    both = in_x & in_y
    column = np.cumsum(both) - 1
    sides = []
    for at, code, size, _ in (x, y):
        kept = both[code]
        sides.append((at[kept], column[code[kept]], len(size)))
    out = np.zeros((len(x[2]), len(y[2])), dtype=np.float32)
    for start in range(0, int(both.sum()), WORDS):
        dense = []
        for at, place, n in sides:
            here = (place >= start) & (place < start + WORDS)
            m = np.zeros((n, min(WORDS, int(both.sum()) - start)), dtype=np.float32)
            m[at[here], place[here] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.float64)


def similarity(x: Tile, y: Tile, field: str, codes: int, both: float, one: float) -> np.ndarray:
    """As ``text.either_similarity``, each row of ``x`` with each of ``y``."""
    a, b = x.fields[field], y.fields[field]
    shared = shared_words(a, b, codes)
    size_a, size_b, none_a, none_b = a[2][:, None], b[2][None, :], a[3][:, None], b[3][None, :]
    union = size_a + size_b - shared
    out = np.where(union == 0, 1.0, shared / np.maximum(union, 1))
    return np.where(none_a & none_b, both, np.where(none_a | none_b, one, out))


def linked_rows(x: Tile, y: Tile, codes: int, same: bool) -> Iterator[tuple]:
    """(a, b, title) of the rows of ``x`` and ``y`` that titles, texts, places and dates link, as ``pair_rule`` has it; ``same``: x is y."""
    days = np.abs(x.day[:, None] - y.day[None, :])
    near = np.where(np.isnan(days), 0.5, np.where(days == 0, 1.0, np.where(days <= 14, 0.8, np.where(days <= 90, 0.5, 0.0))))
    score = 0.4 * y.title[None, :] + 0.35 * similarity(x, y, "description", codes, 0.5, 0.0) + 0.15 * similarity(x, y, "location_raw", codes, 0.5, 0.5) + 0.1 * near
    # Rounded to nine places, half up.
    reached = score >= ELSE_SCORE - 5e-10
    for i, j in zip(*np.nonzero(np.triu(reached, 1) if same else reached)):
        p, q = x.pages[i], y.pages[j]
        if p != q and (p is None or q is None or score[i, j] >= BOTH_PAGES - 5e-10):
            a, b = x.ids[i], y.ids[j]
            yield min(a, b), max(a, b), float(y.title[j])


def meetings(batches: Iterator[pa.RecordBatch], tile: int = TILE) -> Iterator[tuple]:
    """The linked rows of each home: its own rows come first and are held, guests are met a tile at a time. Of rows with one digest the first counts."""
    at = last = None
    codes, homes, own, guests = {}, [], [], []

    def seat() -> None:
        homes.extend(Tile(own[i : i + tile], codes, True) for i in range(0, len(own), tile))
        own.clear()

    def meet() -> Iterator[tuple]:
        y = Tile(guests, codes, False)
        guests.clear()
        for x in homes:
            yield from linked_rows(x, y, len(codes), False)

    def close() -> Iterator[tuple]:
        seat()
        if guests:
            yield from meet()
        for i, x in enumerate(homes):
            for y in homes[i:]:
                yield from linked_rows(x, y, len(codes), x is y)

    for batch in batches:
        for row in batch.to_pylist():
            if (here := (row["owner"], row["home"], row["block"])) != at:
                yield from close()
                at, last, codes, homes = here, None, {}, []
            if row["d"] == last:
                continue
            last = row["d"]
            if not row["guest"]:
                own.append(row)
                continue
            if own:
                seat()
            guests.append(row)
            if len(guests) == tile:
                yield from meet()
    yield from close()


def pairs_by_title(rows: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(a, b, title) of representatives with titles alike in 0.75 whose score suffices."""
    from ..runtime import broadcast_if_small

    own = rows.withColumn("words", F.array_join(title_words(), " "))
    seated = seats(own, block)
    words = lambda f, length: F.when(tx.text(F.col(f)) != "", F.array_join(tx.title_tokens(F.substring(f, 1, length) if length else F.col(f)), " ")).alias(f)
    sent = own.select("owner", "words", "id", "page", digest().alias("d"), F.datediff("date_posted", F.lit("1970-01-01")).alias("day"), words("description", SIGNS), words("location_raw", None))
    sent = sent.join(broadcast_if_small(seated, seated.count(), ROW_BYTES), ["owner", "words"]).withColumn("mine", F.pmod(F.xxhash64("d"), "blocks").cast("int"))
    # A row is at home in its own block and a guest of the blocks before it, or of all blocks of another class.
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.when(F.col("guest"), F.col("blocks") - 1).otherwise(F.col("mine")))))
    sent = sent.select("owner", "home", "block", (F.col("guest") | (F.col("block") < F.col("mine"))).alias("guest"), "d", "id", "page", "title", "day", "description", "location_raw")
    kind = rows.schema["id"].dataType
    schema = t.StructType([t.StructField("a", kind), t.StructField("b", kind), t.StructField("title", t.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns, out = to_arrow_schema(schema), []
        for pair in meetings(batches, tile):
            out.append(pair)
            if len(out) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), columns)], schema=columns)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), columns)], schema=columns)

    return sent.repartition("owner", "home", "block").sortWithinPartitions("owner", "home", "block", "guest", "d", "id").mapInArrow(compare, schema)


def linked_pairs(rows: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(a, b, title_similarity) with a < b of representatives (see copies) that the rule links; one row a pair."""
    own = rows.where("owner is not null and id is not null")
    pairs = pairs_by_id(own).unionByName(pairs_by_title(own, block, tile)).dropDuplicates(["a", "b"])
    return pairs.select("a", "b", F.round("title", 3).alias("title_similarity"))


def grouped(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group, links) of every row in a group of linked rows: the least id of the group, and the representatives its text is linked with."""
    from ..runtime import cut_lineage

    pairs = cut_lineage(pairs.select("a", "b"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    labels = smallest_label(pairs).withColumnRenamed("id", "representative")
    return copies(rows).join(labels, "representative").join(degree, "representative").select("id", "group", "links")


def smallest_label(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, group): the least id reachable over the links (a, b), by passing on least labels and jumping to the label's own label."""
    from ..runtime import cut_lineage

    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")))
    for _ in range(rounds):
        told = both.join(labels.select(F.col("id").alias("b"), "group"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        lower = labels.join(told, "id").select("id", F.least("group", "near").alias("group"), F.col("group").alias("was"))
        jump = lower.join(labels.select(F.col("id").alias("group"), F.col("group").alias("over")), "group", "left")
        after = cut_lineage(jump.select("id", F.least("group", F.coalesce("over", "group")).alias("group"), "was"))
        if after.where("group <> was").isEmpty():
            return after.select("id", "group")
        labels = after.select("id", "group")
    raise RuntimeError(f"groups have not settled in {rounds} rounds")


def canonical(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, canonical_id, duplicates): the best row of each group by trust, filled fields, confidence, then the least id."""
    from ..runtime import cut_lineage
    from .merge import ladder

    # Read twice below.
    groups = cut_lineage(groups)
    trust = ladder(F.col("extraction_method"), METHOD_TRUST, 0)
    points = tx.richness_points({"salary_raw": 2, "location_raw": 1, "employment_type": 1, "date_posted": 1, "external_id": 1})
    own = rows.withColumns({"__t": trust, "__p": points, "__c": F.coalesce("extraction_confidence", F.lit(0.0))}).join(groups.withColumnRenamed("id", "job_id"), "job_id")
    best = own.groupBy("group").agg(F.max_by("job_id", F.struct("__t", "__p", "__c", (-F.col("job_id")).alias("i"))).alias("canonical_id"), (F.count("*") - 1).alias("duplicates"))
    return groups.join(best, "group").select("id", "canonical_id", "duplicates")
