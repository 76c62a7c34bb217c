"""Choice among candidate URLs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_candidates(rows: DataFrame, trusted: list[str], least: float, most: int, fallback: str = "root_fallback", fallback_most: float = 0.6) -> DataFrame:
    """Up to ``most`` URLs a company: a trusted method beats others, then the confidence, then the URL's order.

    A fallback's confidence is capped; rows below ``least`` or without confidence
    are left out. One row a company and URL.
    """
    confidence = F.when(F.col("extraction_method") == fallback, F.least("extraction_confidence", F.lit(fallback_most))).otherwise(F.col("extraction_confidence"))
    own = rows.select("company_id", "url", F.col("extraction_method").isin(trusted).alias("trusted"), confidence.alias("confidence")).where(F.col("confidence") >= least)
    best = own.groupBy("company_id", "url").agg(F.max(F.struct("trusted", "confidence")).alias("best")).select("company_id", "url", "best.*")
    order = Window.partitionBy("company_id").orderBy(F.desc("trusted"), F.desc("confidence"), "url")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
