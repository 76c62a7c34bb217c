"""Job rows read from page blocks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import valid_title
from ..functions.urls import is_job_url
from .blocks import repeating_groups

PLACE = r"(?:[–—|·]\s*|\bin\s+)(\p{Lu}[\p{L}' ]+?)(?:\s*[·|]|$)"
KIND = r"(?i)\b(full[ -]?time|part[ -]?time|casual|contract|temporary|permanent)\b"


def _fields(text: Column) -> list[Column]:
    """Title before a dash, bar or dot; place after it; employment type anywhere."""
    some = lambda pattern, k: F.nullif(F.trim(F.regexp_extract(text, pattern, k)), F.lit(""))
    return [F.trim(F.regexp_extract(text, r"^([^–—|·]+)", 1)).alias("title"), some(PLACE, 1).alias("location_raw"), F.lower(some(KIND, 1)).alias("employment_type")]


def jobs_of_groups(table: DataFrame, linked: float = 0.0) -> DataFrame:
    """(page, node, title, location_raw, employment_type, confidence) of the items of each page's best repeating group with a valid title."""
    best = repeating_groups(table, linked=linked).select("page", "parent", "tag", "classes", "score")
    items = table.join(best, ["page", "parent", "tag", "classes"])
    confidence = F.round(F.least(F.lit(0.88), 0.5 + 0.02 * F.least(F.col("score"), F.lit(20.0))), 4)
    return items.select("page", "node", *_fields(F.col("text")), confidence.alias("confidence")).where(valid_title(F.col("title")))


def job_links(table: DataFrame) -> DataFrame:
    """Links with a job's address (0.72) or a text that reads like a title beside a job word in the address (0.64)."""
    links = table.where("tag = 'a' and href <> ''")
    by_url, by_text = is_job_url(F.col("href")), valid_title(F.col("text")) & F.lower("href").rlike(r"job|career|vacanc|position|opening")
    confidence = F.when(by_url, 0.72).when(by_text, 0.64)
    return links.select("page", "node", *_fields(F.col("text")), confidence.alias("confidence")).where("confidence is not null and title <> ''")


def heading_rows(table: DataFrame, least: int = 1) -> DataFrame:
    """Headings with a valid title in containers that hold at least ``least`` of them."""
    heads = table.where(F.col("tag").isin("h1", "h2", "h3", "h4"))
    counts = heads.groupBy("page", "parent").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return heads.join(counts, ["page", "parent"]).select("page", "node", *_fields(F.col("text")), F.lit(0.66).alias("confidence")).where(valid_title(F.col("title")))


def cascade(layers: list[tuple[str, float, DataFrame]], accept: int = 2) -> DataFrame:
    """Each page's jobs from its first layer with at least ``accept``, else from the first with any. Layers come in order of trust, with the most confidence each may claim."""
    every = None
    for k, (name, most, jobs) in enumerate(layers):
        own = jobs.select("page", "node", "title", "location_raw", "employment_type", F.least("confidence", F.lit(most)).alias("confidence"), F.lit(name).alias("layer"), F.lit(k).alias("k"))
        every = own if every is None else every.unionByName(own)
    counts = every.groupBy("page", "k").agg(F.count("*").alias("n"))
    order = Window.partitionBy("page").orderBy(F.desc(F.col("n") >= accept), "k")
    chosen = counts.withColumn("p", F.row_number().over(order)).where("p = 1").select("page", "k")
    return every.join(chosen, ["page", "k"]).drop("k")
