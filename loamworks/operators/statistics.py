"""Statistics of model evaluation, as aggregates."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING = 1e-4


def psi_numeric(df: DataFrame, side: str, value: str, baseline: str = "baseline", bins: int = 10, least: int = 10) -> DataFrame:
    """One row (psi, severity): stability of a number between two sides, over the baseline's quantiles; below ``least`` rows on a side it is 0."""
    shares = [k / bins for k in range(1, bins)]
    edges = df.where(F.col(side) == baseline).agg(F.array_distinct(F.percentile(value, F.array(*map(F.lit, shares)))).alias("__edges"))
    is_base = (F.col(side) == baseline).cast("long")
    # The edges are one row of at most ``bins`` numbers.
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("__bin", F.size(F.filter("__edges", lambda e: F.col(value) > e)))
    counts = placed.groupBy("__bin").agg(F.sum(is_base).alias("__b"), F.sum(1 - is_base).alias("__c"))
    every = edges.select(F.explode(F.sequence(F.lit(0), F.size("__edges"))).alias("__bin"))
    filled = every.join(counts, "__bin", "left").na.fill(0)
    return _psi(filled, least)


def psi_category(df: DataFrame, side: str, value: str, baseline: str = "baseline", least: int = 10) -> DataFrame:
    """The same over the values of either side."""
    is_base = (F.col(side) == baseline).cast("long")
    return _psi(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__bin")).agg(F.sum(is_base).alias("__b"), F.sum(1 - is_base).alias("__c")), least)


def _psi(counts: DataFrame, least: int) -> DataFrame:
    totals = counts.agg(F.sum("__b").alias("__nb"), F.sum("__c").alias("__nc"))
    share = lambda n, of: F.greatest(F.col(n) / F.greatest(F.col(of), F.lit(1)), F.lit(SMOOTHING))
    b, c = share("__b", "__nb"), share("__c", "__nc")
    psi = F.sum((c - b) * F.log(c / b))
    enough = F.least(F.max("__nb"), F.max("__nc")) >= least
    value = F.when(enough, F.round(psi, 6)).otherwise(0.0)
    out = counts.crossJoin(F.broadcast(totals)).agg(value.alias("psi"))
    return out.withColumn("severity", F.when(F.col("psi") >= 0.25, "major").when(F.col("psi") >= 0.1, "moderate").otherwise("none"))


def mcnemar(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """One row (only_a, only_b, chi2, p_value): exact two-sided binomial test of the rows where one of two predictions is right.

    The tail is summed in log space over a sequence; it grows with the
    disagreements, of which there are few beside the rows.
    """
    right_a, right_b = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    counts = df.agg(F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"))
    n, low = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    # log C(n, k) step by step, summed as probabilities.
    step = lambda s, k: F.struct((s["l"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))).alias("l"), (s["p"] + F.exp(s["l"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double")) - n * F.log(F.lit(2.0)))).alias("p"))
    start = F.struct(F.lit(0.0).alias("l"), F.exp(-n * F.log(F.lit(2.0))).alias("p"))
    tail = F.when(low >= 1, F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(low, F.lit(1))), start, step)["p"]).otherwise(F.exp(-n * F.log(F.lit(2.0))))
    chi2 = F.when(n > 0, F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, 2) / n).otherwise(0.0)
    return counts.select("only_a", "only_b", F.round(chi2, 6).alias("chi2"), F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * tail), 6)).otherwise(1.0).alias("p_value"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share; without trials 0 to 1."""
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), (middle - half) / scale), 6)).otherwise(0.0), F.when(n > 0, F.round(F.least(F.lit(1.0), (middle + half) / scale), 6)).otherwise(1.0)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, least: int, budget: float) -> DataFrame:
    """Each key's p50, p95 and p99 by interpolation, and whether p95 keeps a budget (null below ``least`` rows)."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), p.alias("p"))
    at = lambda k: F.round(F.col("p")[k], 6)
    return out.select(*keys, "n", at(0).alias("p50"), at(1).alias("p95"), at(2).alias("p99"), F.when(F.col("n") >= least, F.col("p")[1] <= budget).alias("within"))


def most_uncertain(df: DataFrame, stratum: str, probability: str, key: str, k: int, least: float = 0.1) -> DataFrame:
    """The ``k`` rows of each stratum whose probability is nearest one half, if their margin uncertainty is at least ``least``."""
    unsure = 1 - F.abs(2 * F.col(probability) - 1)
    own = df.withColumn("uncertainty", F.round(unsure, 6)).where(F.col("uncertainty") >= least)
    order = Window.partitionBy(stratum).orderBy(F.desc("uncertainty"), key)
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def bootstrap_mean(df: DataFrame, value: str, key: str, rounds: int = 200, seed: int = 42) -> DataFrame:
    """One row (mean, low, high): a 95 % interval of the mean by the Poisson bootstrap.

    Each row's weight in each round follows from a hash of its key, so the result
    is the same however the rows are partitioned, and one aggregation does all rounds.
    """
    # Poisson(1) by inversion of its distribution.
    cuts = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("r"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts[1:]), F.when(u >= cuts[0], 1).otherwise(0))
    drawn = df.where(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn("w", weight)
    means = drawn.groupBy("r").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("m"), F.avg(value).alias("plain"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.round(F.max("plain"), 6).alias("mean"), F.round(p[0], 6).alias("low"), F.round(p[1], 6).alias("high"))


def classification(df: DataFrame, strata: Column, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and false positive share for each stratum; a row may stand in several (an array)."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    rows = df.select(F.explode(strata).alias("stratum"), truth, predicted).groupBy("stratum")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "stratum", "n", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(ratio(2 * precision * recall, precision + recall), 6).alias("f1"), F.round(F.col("fp") / F.col("n"), 6).alias("fp_share")
    )


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: likeness of two texts as sets of words, the better of the shared words against either side, by edit distance."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")))
    x, y = words(a), words(b)
    shared = F.array_join(F.array_intersect(x, y), " ")
    left, right = F.trim(F.concat_ws(" ", shared, F.array_join(F.array_except(x, y), " "))), F.trim(F.concat_ws(" ", shared, F.array_join(F.array_except(y, x), " ")))
    ratio = lambda p, q: F.when(F.length(p) + F.length(q) > 0, F.round(100.0 * (1 - F.levenshtein(p, q) / F.greatest(F.length(p), F.length(q))), 2)).otherwise(100.0)
    with_shared = F.greatest(ratio(shared, left), ratio(shared, right))
    return F.when(shared != "", F.greatest(with_shared, ratio(left, right))).otherwise(ratio(left, right))


#: Queries that one pass holds against all rows.
QUERIES = 10_000


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float = 0.0) -> DataFrame:
    """The ``k`` rows of highest cosine to each query, a stated set held against all rows.

    Queries go out in blocks of at most QUERIES, each held against all rows in one
    pass, so what a task holds does not grow with the queries.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = queries.select(F.col(key).alias("query"), F.col(vector).alias("__q"), norm(F.col(vector)).alias("__nq"))
    dot = F.aggregate(F.zip_with("__q", vector, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    blocks, scored = max(1, -(-own.count() // QUERIES)), None
    for n in range(blocks):
        part = own.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n) if blocks > 1 else own
        met = vectors.withColumn("__n", norm(F.col(vector))).join(F.broadcast(part), F.col(key) != F.col("query")).select("query", key, F.round(dot / (F.col("__n") * F.col("__nq")), 5).alias("cosine"))
        scored = met if scored is None else scored.unionByName(met)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    return scored.where(F.col("cosine") > least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def weighted_coverage(extracted: Column, total: Column, expected: Column) -> Column:
    """The share of a weighted total that was extracted, at most 1; of an expected count where there is no total; null without either."""
    share = lambda whole: F.least(F.lit(1.0), extracted / whole)
    return F.when(F.coalesce(total, F.lit(0)) > 0, share(total)).when(expected > 0, share(expected))


def ranked(df: DataFrame, score: str, parts: int = 256) -> DataFrame:
    """``df`` with each row's ``place``: one more than the rows of higher score, over the whole table.

    Scores are cut into ranges at approximate quantiles; a row's place is what the
    higher ranges hold plus its place within its own, so no window spans the table
    (equal scores are one row while they are counted).
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("__n"))
    cuts = F.percentile_approx(score, [k / parts for k in range(1, parts)], 10_000)
    edges = counts.agg(F.coalesce(F.array_distinct(cuts), F.array().cast("array<double>")).alias("__edges"))
    # One row of at most ``parts`` numbers.
    placed = counts.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e >= F.col(score)))).drop("__edges")
    totals = placed.groupBy("__range").agg(F.sum("__n").alias("__all"))
    before = totals.select("__range", (F.sum("__all").over(Window.orderBy("__range")) - F.col("__all")).alias("__before"))
    within = F.sum("__n").over(Window.partitionBy("__range").orderBy(F.desc(score))) - F.col("__n")
    places = placed.withColumn("__within", within).join(F.broadcast(before), "__range").select(score, (F.col("__before") + F.col("__within") + 1).alias("place"))
    return df.join(places, score)


def best_per_cell(df: DataFrame, cells: Sequence[str], fitness: str, key: str) -> DataFrame:
    """The fittest row of each cell; on a tie the least key."""
    return df.groupBy(*cells).agg(F.max_by(key, F.struct(fitness, (-F.col(key)).alias("k"))).alias(key), F.max(fitness).alias(fitness), F.count("*").alias("tried"))


def posterior(df: DataFrame, arm: str, order: Sequence[str], win: str, decay: float = 0.9) -> DataFrame:
    """(arm, alpha, beta): a Beta posterior after decayed wins and losses in order; the events of an arm are folded as weights by their distance from the last."""
    w = Window.partitionBy(arm)
    back = F.count("*").over(w) - F.row_number().over(w.orderBy(*order))
    weight = F.pow(F.lit(decay), back)
    weighted = df.withColumn("__w", weight)
    wins = F.sum(F.when(F.col(win), F.col("__w")).otherwise(0.0))
    losses = F.sum(F.when(F.col(win), 0.0).otherwise(F.col("__w")))
    return weighted.groupBy(arm).agg(F.round(1 + wins, 6).alias("alpha"), F.round(1 + losses, 6).alias("beta"))


def terms_by_weight(documents: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The ``k`` terms of highest tf-idf of each document."""
    words = documents.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = documents.agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", F.round(F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1), 6))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "term")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(key, "term", "weight", "place")
