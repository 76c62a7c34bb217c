"""Hosts matched to a table of known hosts by suffix."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _endings(host: Column) -> Column:
    """All endings of a host, which has at most 253 signs."""
    return F.transform(F.sequence(F.lit(1), F.length(host)), lambda k: F.substring(host, k, F.length(host)))


def known_host(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """(host, known, rank) of each host (host) that a known one (known) stands for.

    Best first: the same host (0), its parents without one and two labels (1, 2),
    then any that ends with the other (3), of which the least. All by equality
    joins on endings. Hosts are compared in lower case without a leading www; null
    and empty ones match nothing.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^[w.]+", "")
    own = hosts.select(F.col("host"), plain(F.col("host")).alias("h")).where("h <> ''").distinct()
    names = known.select(F.lower(F.trim("known")).alias("known")).where("known <> ''").distinct()
    labels = F.split("h", r"\.")
    parent = lambda n: F.when(F.size(labels) > n, F.array_join(F.slice(labels, n + 1, 253), "."))
    ladder = F.array(F.struct(F.lit(0).alias("rank"), F.col("h").alias("known")), *(F.struct(F.lit(n).alias("rank"), parent(n).alias("known")) for n in (1, 2)))
    near = own.select("host", F.explode(ladder).alias("x")).select("host", "x.rank", "x.known").where("known is not null").join(names, "known")
    below = own.select("host", F.explode(_endings(F.col("h"))).alias("known")).join(names, "known")
    above = names.select("known", F.explode(_endings(F.col("known"))).alias("h")).join(own, "h")
    loose = below.select("host", "known").unionByName(above.select("host", "known")).withColumn("rank", F.lit(3))
    best = near.select("host", "known", "rank").unionByName(loose).groupBy("host").agg(F.min(F.struct("rank", "known")).alias("b"))
    return best.select("host", "b.known", "b.rank")
