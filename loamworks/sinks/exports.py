"""Shapes of exported rows, and writers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_COLUMNS = [
    "id", "title", "company_name", "company_domain", "location_raw", "location_city", "location_country", "remote_type", "employment_type", "seniority_level", "salary_raw", "salary_min", "salary_max", "salary_currency", "quality_score",
    "extraction_method", "source_url", "date_posted", "first_seen_at",
]

COMPANY_COLUMNS = ["company_id", "name", "domain", "market_code", "ats_platform", "crawl_priority", "site_count", "expected_jobs", "last_crawl_jobs", "is_active", "discovered_via", "last_crawl_at"]
SITE_COLUMNS = [
    "id", "company_name", "company_domain", "url", "page_type", "discovery_method", "discovery_confidence", "is_primary", "is_paginated", "requires_js_rendering", "is_active", "last_crawl_jobs", "expected_jobs", "has_template", "template_accuracy",
    "last_crawled_at", "created_at",
]


def exported(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in their order, as texts; nulls as empty texts and missing columns too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    return df.select(*(text(c).alias(c) for c in columns))


def blank_unless(df: DataFrame, condition: Column, columns: Sequence[str]) -> DataFrame:
    """``df`` with some columns emptied where a condition does not hold."""
    return df.withColumns({c: F.when(condition, F.coalesce(F.col(c).cast("string"), F.lit(""))).otherwise(F.lit("")) for c in columns})


def defaulted(df: DataFrame, columns: Sequence[str], default: str = "not found") -> DataFrame:
    """``df`` with empty and null values of some columns replaced."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default)) for c in columns})


def long_metrics(df: DataFrame, stratum: str, metrics: Sequence[str]) -> DataFrame:
    """(stratum, metric, value): one row a filled metric; not-a-number counts as missing."""
    long = df.select(F.col(stratum).alias("stratum"), *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["stratum"], list(metrics), "metric", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; texts that a sheet would take for formulas keep their quotes, and all keep their outer blanks."""
    df.write.mode("overwrite").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
