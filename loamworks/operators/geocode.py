"""A ladder of lookups of typed places: exact names, then similar ones by shared letter triples."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_place(column: Column) -> Column:
    """Lower case without common accents, separators as commas, single blanks."""
    accented, bare = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñç", "aaaaaaaeeeeeiiiiioooooouuuuunc"
    low = F.translate(F.lower(F.trim(column)), accented, bare)
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\s*[/|;>,]+\s*", ","), r"\s+", " "), F.lit(", "))


def name_table(gazetteer: DataFrame) -> DataFrame:
    """(geo_id, level, market_code, population, name) for every name of every entry."""
    names = F.array_distinct(F.transform(F.array_compact(F.concat(F.array("name", "ascii_name"), F.coalesce("alt_names", F.array().cast("array<string>")))), normal_place))
    return gazetteer.select("geo_id", "level", "market_code", "population", F.explode(names).alias("place"))


def terms(values: DataFrame) -> DataFrame:
    """(location_raw, market_code, position, place): the parts of each distinct value at its commas."""
    parts = F.filter(F.transform(F.split(normal_place(F.col("location_raw")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return values.select("location_raw", "market_code").where("location_raw is not null").distinct().select("location_raw", "market_code", F.posexplode(parts).alias("position", "place"))


def exact(values: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Each value's entry by exact name in its own market: the first part that has one, then the deepest level, the largest population, the least id."""
    met = terms(values).join(name_table(gazetteer), ["place", "market_code"])
    order = Window.partitionBy("location_raw", "market_code").orderBy("position", F.desc("level"), F.desc_nulls_last("population"), "geo_id")
    return met.withColumn("n", F.row_number().over(order)).where("n = 1").select("location_raw", "market_code", "geo_id")


def trigrams(column: Column) -> Column:
    """The distinct letter triples of each word, padded as two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    triples = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, triples)))


def similar(values: DataFrame, gazetteer: DataFrame, least: float = 0.35) -> DataFrame:
    """Each value's most similar name in its market by shared letter triples, from ``least`` on.

    An inverted join: names and parts meet on their triples, shared ones are
    counted, and the similarity follows from the three counts.
    """
    parts = terms(values).withColumn("grams", trigrams(F.col("place")))
    names = name_table(gazetteer).withColumn("grams", trigrams(F.col("place")))
    a = parts.select("location_raw", "market_code", "position", F.size("grams").alias("na"), F.explode("grams").alias("gram"))
    b = names.select("market_code", "geo_id", "level", "population", F.col("place").alias("name"), F.size("grams").alias("nb"), F.explode("grams").alias("gram"))
    shared = a.join(b, ["market_code", "gram"]).groupBy("location_raw", "market_code", "position", "na", "geo_id", "level", "population", "name", "nb").agg(F.count("*").alias("n"))
    scored = shared.withColumn("similarity", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6)).where(F.col("similarity") >= least)
    order = Window.partitionBy("location_raw", "market_code").orderBy("position", F.desc("similarity"), F.desc("level"), F.desc_nulls_last("population"), "geo_id", "name")
    return scored.withColumn("k", F.row_number().over(order)).where("k = 1").select("location_raw", "market_code", "geo_id", "similarity")


def ladder(values: DataFrame, gazetteer: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(location_raw, market_code, geo_id, step): cache, exact, similar, else none. Each step sees only what the one before left."""
    rest = values.select("location_raw", "market_code").where("location_raw is not null").distinct()
    steps = []
    if cache is not None:
        steps.append(rest.join(cache, ["location_raw", "market_code"]).select("location_raw", "market_code", "geo_id", F.lit("cache").alias("step")))
        rest = rest.join(cache, ["location_raw", "market_code"], "left_anti")
    by_name = exact(rest, gazetteer).withColumn("step", F.lit("exact"))
    rest = rest.join(by_name, ["location_raw", "market_code"], "left_anti")
    by_likeness = similar(rest, gazetteer).drop("similarity").withColumn("step", F.lit("similar"))
    none = rest.join(by_likeness, ["location_raw", "market_code"], "left_anti").withColumn("geo_id", F.lit(None).cast("long")).withColumn("step", F.lit("none"))
    out = by_name.unionByName(by_likeness).unionByName(none)
    for s in steps:
        out = out.unionByName(s)
    return out


def seeded(features: DataFrame, least_city: int = 15_000) -> DataFrame:
    """Level and parent of raw gazetteer features (id, code, admin, name, population): ADM1 is 2, a place of people 3 or 4 by its size, PCLI 1."""
    level = (
        F.when(F.col("code") == "PCLI", 1).when(F.col("code") == "ADM1", 2).when(F.col("code").startswith("PPL") & (F.coalesce("population", F.lit(0)) >= least_city), 3).otherwise(4)
    )
    own = features.withColumn("level", level)
    states = own.where("level = 2").groupBy(F.col("admin").alias("admin")).agg(F.min("id").alias("state_id"))
    countries = own.where("level = 1").agg(F.min("id").alias("country_id"))
    joined = own.join(states, "admin", "left").crossJoin(F.broadcast(countries))
    parent = F.when(F.col("level") == 1, None).when(F.col("level") == 2, F.col("country_id")).otherwise(F.coalesce("state_id", "country_id"))
    return joined.select("id", "name", "level", parent.alias("parent_id"))
