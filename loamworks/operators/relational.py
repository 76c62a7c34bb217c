"""Building blocks over rows: filters that fold, pages, latest rows, shares, ancestors, flips and buckets.

Time is always a parameter. Orders end in an id, so ties have a defined place.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, predicates: Sequence[Column | None]) -> DataFrame:
    """Rows that meet every predicate; a None (an option not given) is skipped."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def matches(column: str, value) -> Column | None:
    """Equality with an optional value."""
    return None if value is None else F.col(column) == F.lit(value)


def contains_any(columns: Sequence[str], words: str | None) -> Column | None:
    """Whether any column holds the words, in either case."""
    return None if not words else reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit("")).ilike(f"%{words}%") for c in columns))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a totally ordered result."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def latest_per(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """The given columns of each key's latest row, by partial aggregation; ties go to the larger values."""
    best = F.max(F.struct(time, *columns)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__best.{c}").alias(c) for c in [time, *columns]))


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not stand in ``other``; a null key is kept, unlike under NOT IN."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_anti")


def with_any(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key stands in ``other``."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def share_of_total(df: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """Counts by key and their share in per cent; the total is taken over the groups, not the rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    # One row, whatever the data.
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") * 100.0 / F.col("__total"), digits)).drop("__total")


def coverage(df: DataFrame, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """(column, filled, share) for each column, in one pass; an empty text is filled, no rows count as one."""
    total = F.greatest(F.count("*"), F.lit(1))
    counted = df.agg(total.alias("__n"), *(F.count(c).alias(c) for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("__n")) for c in columns)))
    return counted.select(rows.alias("r")).select("r.column", "r.filled", F.round(F.col("r.filled") * 100.0 / F.col("r.__n"), digits).alias("share"))


def bands(column: Column, edges: Sequence[tuple[str, float]], otherwise: str) -> Column:
    """The first label whose lower edge the value reaches; null for null."""
    out = F.lit(otherwise)
    for label, edge in sorted(edges, key=lambda x: x[1]):
        out = F.when(column >= edge, F.lit(label)).otherwise(out)
    return F.when(column.isNotNull(), out)


def bucket_for(minutes: int) -> str:
    """The time unit that suits a span: days without one or beyond three, hours up to three days, minutes up to six hours."""
    return "day" if minutes == 0 or minutes > 4320 else "minute" if minutes <= 360 else "hour"


def over_time(df: DataFrame, time: str, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by time unit and key."""
    return df.groupBy(F.date_trunc(unit, time).alias("bucket"), *keys).agg(F.count("*").alias("n"))


def flips(df: DataFrame, key: str, order: Sequence[Column], passed: str, last: int = 5) -> DataFrame:
    """(key, observations, flips): changes of ``passed`` among each key's last observations, ``order`` being newest first."""
    recent = df.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__place") <= last)
    before = F.lag(passed).over(Window.partitionBy(key).orderBy("__place"))
    changed = (F.col(passed) != before).cast("int")
    return recent.withColumn("__changed", changed).groupBy(key).agg(F.count("*").alias("observations"), F.coalesce(F.sum("__changed"), F.lit(0)).alias("flips"))


def ancestors(tree: DataFrame, key: str, parent: str, name: str, depth: int = 4) -> DataFrame:
    """(key, path): the names of a row and those above it, nearest first, up to ``depth``; a cycle ends where the depth does."""
    nodes = tree.select(F.col(key).alias("__id"), F.col(parent).alias("__up"), F.col(name).alias("__name"))
    out = nodes.select("__id", F.array("__name").alias("path"), F.col("__up").alias("__next"))
    above = nodes.select(F.col("__id").alias("__next"), F.col("__up").alias("__over"), F.col("__name").alias("__above"))
    for _ in range(depth - 1):
        joined = out.join(above, "__next", "left")
        out = joined.select("__id", F.when(F.col("__above").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("__above"))).alias("path"), F.col("__over").alias("__next"))
    return out.select(F.col("__id").alias(key), F.array_join("path", ", ").alias("path"))


def modal_value(df: DataFrame, keys: Sequence[str], value: str, first_seen: str) -> DataFrame:
    """Each key's most frequent non-empty value; on a tie the one seen first, then the smaller."""
    counted = df.where(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(first_seen).alias("__seen"))
    return first_per(counted, keys, [F.desc("n"), F.asc("__seen"), F.asc(value)]).drop("__seen")


def pro_rata(df: DataFrame, keys: Sequence[str], weight: str, total: Column) -> DataFrame:
    """``share``: a total dealt over the rows of each key by weight, evenly where no row has any."""
    w = Window.partitionBy(*keys)
    weighted = F.coalesce(F.col(weight), F.lit(0))
    even = F.lit(1.0) / F.count("*").over(w)
    part = F.when(F.sum(weighted).over(w) > 0, weighted / F.sum(weighted).over(w)).otherwise(even)
    return df.withColumn("share", F.round(total * part, 4))


def weighted_quality(df: DataFrame, key: str, score: str, low: float = 20.0, penalty: float = 30.0) -> DataFrame:
    """(key, quality): mean of the scores, those in the lowest quarter of ranks at half weight, less a penalty for the share below ``low``; kept within 0 and 100."""
    w = Window.partitionBy(key)
    rank = (F.row_number().over(w.orderBy(F.asc(score))) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    weighted = df.where(F.col(score).isNotNull()).withColumn("__w", F.when(rank < 0.25, 0.5).otherwise(1.0))
    mean = F.sum(F.col(score) * F.col("__w")) / F.sum("__w")
    below = F.avg((F.col(score) < low).cast("int"))
    return weighted.groupBy(key).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean - penalty * below)), 1).alias("quality"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; Spark keeps k a task instead of sorting all."""
    return df.orderBy(*order).limit(k)


def changed_content(new: DataFrame, old: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, state): new, changed or same against the stored digests (key, digest)."""
    now = new.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    before = old.select(key, F.col("digest").alias("__old"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("digest"), "same").otherwise("changed")
    return now.join(before, key, "left").withColumn("state", state).drop("__old")
