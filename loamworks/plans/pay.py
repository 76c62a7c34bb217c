"""Queries of the unit conversion operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pay import parse_batches
from ..operators import units
from ..runtime import spread
from ..tables import table

PARSED = "job_id long, amount_min decimal(14,3), amount_max decimal(14,3), currency string, period string"


def _conversions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The conversion graph's table; both rate tables are dictionaries of fixed size."""
    rates = [tuple(r) for r in table(spark, sf_dir, "fx_rates").select("currency", "aud_per_unit").where("currency is not null").collect()]
    periods = [tuple(r) for r in table(spark, sf_dir, "pay_periods").select("period", "per_year").where("period is not null").collect()]
    edges = units.pay_edges(rates, periods)
    return units.conversion_table(spark, edges, ["AUD/annual"]), len(edges) + 1


def parsed_pay(jobs: DataFrame) -> DataFrame:
    """One row per job whose ``salary_raw`` states an amount: the amounts, currency and period as stated."""
    wanted = jobs.where(units.stated(F.col("salary_raw"))).select("job_id", "salary_raw", "description", "market_code")
    return spread(wanted).mapInPandas(parse_batches, PARSED)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated pay as whole Australian dollars a year."""
    conversions, n = _conversions(spark, sf_dir)
    pay = parsed_pay(table(spark, sf_dir, "extracted_jobs")).withColumn("unit", F.concat_ws("/", "currency", "period"))
    out = units.convert(pay, conversions, "unit", "AUD/annual", {"annual_min_aud": "amount_min", "annual_max_aud": "amount_max"}, n)
    return out.where("annual_min_aud is not null").select("job_id", "annual_min_aud", "annual_max_aud")


def p1_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed conversions from every currency and period to Australian dollars a year."""
    return _conversions(spark, sf_dir)[0].select("unit", F.col("scale").cast("double").alias("scale"), "steps")


QUERIES = {"p1_found": p1_found, "p1_conversions": p1_conversions}

SQL = {
    "p1_conversions": """
        SELECT currency || '/' || period AS unit, CAST(aud_per_unit AS DOUBLE) * per_year AS scale,
               CAST((CASE WHEN currency = 'AUD' THEN 0 ELSE 1 END) + (CASE WHEN period = 'annual' THEN 0 ELSE 1 END) AS INTEGER) AS steps
        FROM fx_rates CROSS JOIN pay_periods""",
}
