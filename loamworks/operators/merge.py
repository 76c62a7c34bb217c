"""Merging of records of one thing from several sources, and keyed merges of tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Trust in the methods that made a record, and weight of the fields compared.
METHOD_TRUST = {"schema_org": 10, "ats_api": 9, "ats_html": 7, "llm_instructor": 6, "llm_raw": 5, "structural": 4, "heuristic": 3}
FIELD_WEIGHTS = {"title": 2.0, "location_raw": 1.5, "employment_type": 1.0, "salary_raw": 1.0, "department": 0.8, "seniority_level": 0.8, "is_remote": 0.7, "remote_type": 0.7, "date_posted": 0.5}


def ladder(column: Column, values: dict, otherwise) -> Column:
    """The value of the matching key."""
    out = F.lit(otherwise)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def group_key(*columns: str) -> Column:
    """The first filled column with its name, so that equal values of different columns stay apart."""
    return F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in columns))


def trust_merge(df: DataFrame, keys: Sequence[str], method: str, fields: Sequence[str], tie: str, trust: dict = METHOD_TRUST, weights: dict = FIELD_WEIGHTS) -> DataFrame:
    """One row a key: each field from the most trusted record that has it, with the agreement of the records.

    A field's confidence is agreement times trust; agreement falls with each
    different value and is 0.8 for a single one. The row's confidence is the mean
    weighted by field, at most 0.99, and 0.4 without any field. Records of equal
    trust are ordered by ``tie``. Partial aggregation does all of it: no window,
    and no key is collected beyond its distinct values of a field.
    """
    ranked = df.withColumn("__trust", ladder(F.col(method), trust, 0))
    best = lambda f: F.max_by(F.struct(F.col(f).alias("v"), F.col(method).alias("m")), F.when(F.col(f).isNotNull(), F.struct("__trust", (-F.col(tie)).alias("t"))))
    grouped = ranked.groupBy(*keys).agg(
        *(best(f).alias(f"__b_{f}") for f in fields),
        *(F.count(f).alias(f"__n_{f}") for f in fields),
        *(F.countDistinct(F.col(f).cast("string")).alias(f"__u_{f}") for f in fields),
        F.count("*").alias("records"),
        F.max_by(method, F.struct("__trust", (-F.col(tie)).alias("t"))).alias("__method"),
    )

    def confidence(f: str) -> Column:
        agreement = F.when(F.col(f"__n_{f}") > 1, 1 - (F.col(f"__u_{f}") - 1) / F.col(f"__n_{f}")).otherwise(0.8)
        return agreement * ladder(F.col(f"__b_{f}.m"), trust, 3) / 10

    has = [F.when(F.col(f"__n_{f}") > 0, F.lit(weights.get(f, 0.5))).otherwise(0.0) for f in fields]
    total = sum(has[1:], has[0])
    parts = [F.when(F.col(f"__n_{f}") > 0, confidence(f) * weights.get(f, 0.5)).otherwise(0.0) for f in fields]
    mean = F.when(total > 0, F.least(F.lit(0.99), sum(parts[1:], parts[0]) / total)).otherwise(0.4)
    return grouped.select(
        *keys, *(F.col(f"__b_{f}.v").alias(f) for f in fields), F.when(F.col("records") > 1, "hybrid").otherwise(F.col("__method")).alias("method"), F.round(mean, 6).alias("confidence"), "records"
    )


def agreement(a: str, b: str, weights: dict = FIELD_WEIGHTS, half: Sequence[str] = ("salary_raw",)) -> Column:
    """0 to 1: weighted share of equal fields of two structs; fields missing in both are left out, unequal ``half`` fields count half."""
    total, same = F.lit(0.0), F.lit(0.0)
    for field, w in weights.items():
        x, y = F.col(f"{a}.{field}"), F.col(f"{b}.{field}")
        equal = F.lower(F.trim(x.cast("string"))) == F.lower(F.trim(y.cast("string")))
        total = total + F.when(x.isNull() & y.isNull(), 0.0).otherwise(w)
        same = same + F.when(x.isNull() | y.isNull(), 0.0).when(equal, w).otherwise(w * 0.5 if field in half else 0.0)
    return F.when(total > 0, same / total).otherwise(1.0)


def keep_best(df: DataFrame, keys: Sequence[str], priority: Column, fields: Sequence[str], tie: str) -> DataFrame:
    """One row a key: the record of highest priority, its blanks filled from others of the same priority in the order of ``tie``."""
    ranked = df.withColumn("__p", priority)
    own = ranked.withColumn("__top", F.max("__p").over(Window.partitionBy(*keys))).where(F.col("__p") == F.col("__top"))
    first = lambda f: F.min_by(F.col(f), F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.col(tie)))
    return own.groupBy(*keys).agg(*(first(f).alias(f) for f in fields), F.count("*").alias("records"))


def fill_blank(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Null and empty fields take a default; filled ones stay."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), d) for c, d in defaults.items()})


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Keyed merge of two tables with one row a key. Rules: ``new`` overwrites, ``fill`` keeps a filled old value, ``max`` and ``min`` ratchet, ``old`` keeps.

    A missing side leaves the other's value; keys of null never meet.
    """
    a = old.select(*keys, *(F.col(c).alias(f"__o_{c}") for c in rules), F.lit(True).alias("__in_old"))
    b = new.select(*keys, *(F.col(c).alias(f"__n_{c}") for c in rules), F.lit(True).alias("__in_new"))
    joined = a.join(b, list(keys), "full")

    def value(c: str, rule: str) -> Column:
        o, n = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if rule == "new":
            return F.when(F.col("__in_new"), n).otherwise(o)
        if rule == "fill":
            return F.coalesce(o, n)
        if rule == "old":
            return F.when(F.col("__in_old"), o).otherwise(n)
        return F.greatest(o, n) if rule == "max" else F.least(o, n)

    return joined.select(*keys, *(value(c, rule).alias(c) for c, rule in rules.items()))
