"""Queries of record scores and of candidates read from page blocks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions.text import valid_title
from ..operators import blocks as b
from ..operators import classify, listings
from ..runtime import cut_lineage
from .analytics import T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_quality() -> str:
    from ..functions.urls import JOB_URL

    wide = "[" + "".join(f"\\x{{{ord(a):04X}}}-\\x{{{ord(z):04X}}}" for a, z in _ranges()) + "]"
    has = lambda p: f"regexp_matches(t, '{p}')"
    given = {"location": ("location_raw", 10, 6, 2), "employment_type": ("employment_type", 8, 5, 1), "salary": ("salary_raw", 5, 3, 2)}
    full = lambda c, n: f"length(trim(coalesce({c}, ''), ' ')) >= {n}"
    points = (
        "CASE WHEN length(ti) < 3 THEN 0 WHEN g THEN 2 ELSE 15 END + CASE WHEN regexp_matches(coalesce(source_url, ''), '" + JOB_URL + "') THEN 5 ELSE 0 END + CASE "
        + " ".join(f"WHEN n >= {e} THEN {p}" for e, p in q.LENGTHS) + " ELSE -3 END + CASE WHEN s THEN 5 ELSE 0 END"
        + "".join(f" + CASE WHEN {full(c, least)} THEN {f} WHEN {has(q.SIGNALS[k])} THEN {i} ELSE 0 END" for k, (c, f, i, least) in given.items())
        + f" + CASE WHEN date_posted IS NOT NULL THEN 3 WHEN {has(q.SIGNALS['date'])} THEN 2 ELSE 0 END + CASE WHEN n >= 300 AND r THEN 10 WHEN n >= 150 THEN 5 ELSE 0 END"
    )
    issues = (
        ["CASE WHEN length(ti) < 3 THEN 'title_missing_or_short' WHEN g THEN 'title_generic_page' END", "CASE WHEN n < 50 THEN 'description_very_short' END", "CASE WHEN s THEN 'description_well_structured' END"]
        + [f"CASE WHEN {full(c, least)} THEN NULL WHEN {has(q.SIGNALS[k])} THEN '{k}_inferred_from_description' ELSE '{k}_missing' END" for k, (c, f, i, least) in given.items()]
        + [f"CASE WHEN date_posted IS NULL AND NOT {has(q.SIGNALS['date'])} THEN 'date_posted_missing' END", "CASE WHEN n >= 300 AND r THEN 'requirements_embedded_in_description' WHEN n < 150 THEN 'requirements_missing' END"]
        + [f"CASE WHEN {has(p)} THEN '{k}_detected' END" for k, (_, p) in q.CAPS.items()]
    )
    score = f"least(100.0, greatest(0.0, {points}))"
    for k, (cap, p) in q.CAPS.items():
        score = f"CASE WHEN {has(p)} THEN least({score}, {cap}) ELSE {score} END"
    generic = ", ".join(f"'{x}'" for x in q.GENERIC_TITLES)
    return f"""
        WITH a AS (SELECT *, trim(coalesce(title, ''), ' ') AS ti, trim(coalesce(description, ''), ' ') AS d FROM extracted_jobs),
        c AS (SELECT *, concat_ws(' ', nullif(title, ''), nullif(d, '')) AS t, length(d) + 2 * len(regexp_extract_all(d, '{wide}')) AS n, rtrim(lower(ti), '!.?') IN ({generic}) AS g FROM a),
        e AS (SELECT *, n >= 100 AND regexp_matches(d, '{q.STRUCTURE}') AS s, {' + '.join(f"regexp_matches(t, '{p}')::INT" for p in q.REQUIREMENTS)} >= 2 AS r FROM c),
        f AS (SELECT job_id, ({score})::DOUBLE AS score, array_to_string(list_filter([{', '.join(issues)}], lambda x: x IS NOT NULL), ',') AS issues FROM e)
        SELECT job_id, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' WHEN score >= 20 THEN 'poor' ELSE 'disqualified' END AS band, issues FROM f"""


def _ranges() -> list[tuple[str, str]]:
    import re

    from ..functions.text import WIDE

    return [(chr(int(a, 16)), chr(int(z, 16))) for a, z in re.findall(r"\\u([0-9A-F]{4})-\\u([0-9A-F]{4})", WIDE)]


@query(_sql_quality())
def x3_quality(spark, sf_dir):
    """Each job's score, band and ordered issues."""
    return T(spark, sf_dir).extracted_jobs.select("job_id", q.quality().alias("q")).select("job_id", "q.*")


@query("SELECT job_id, round((CASE WHEN length(coalesce(description, '')) >= 1000 THEN 0.5 ELSE length(coalesce(description, '')) / 2000.0 END + CASE WHEN salary_raw IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN location_raw IS NOT NULL THEN 0.25 ELSE 0 END)::DOUBLE * (is_active IS NOT DISTINCT FROM true)::INT, 6)::DOUBLE AS richness FROM extracted_jobs")
def x4_richness(spark, sf_dir):
    """0 to 1 by what a live record holds; others have 0."""
    n = F.length(F.coalesce("description", F.lit("")))
    parts = F.when(n >= 1000, 0.5).otherwise(n / 2000.0) + F.when(F.col("salary_raw").isNotNull(), 0.25).otherwise(0.0) + F.when(F.col("location_raw").isNotNull(), 0.25).otherwise(0.0)
    return T(spark, sf_dir).extracted_jobs.select("job_id", F.round(parts * F.col("is_active").eqNullSafe(F.lit(True)).cast("int"), 6).alias("richness"))


def _table(spark, sf_dir):
    return b.blocks(T(spark, sf_dir).snapshot_files, "snapshot_path", "html")


@query()
def h4_rows_to_jobs(spark, sf_dir):
    """Job fields read from the items of each page's best repeating group."""
    return listings.jobs_of_groups(_table(spark, sf_dir))


@query()
def h5_cascade(spark, sf_dir):
    """The first layer of each page that gives at least two jobs, else the first that gives any."""
    table = cut_lineage(_table(spark, sf_dir))
    return listings.cascade([("links", 0.88, listings.job_links(table)), ("groups", 0.7, listings.jobs_of_groups(table)), ("headings", 0.5, listings.heading_rows(table))])


@query()
def h30_job_links(spark, sf_dir):
    """Links whose text or address looks like a job."""
    return listings.job_links(_table(spark, sf_dir))


@query()
def h31_headings(spark, sf_dir):
    return listings.heading_rows(_table(spark, sf_dir))


@query("""
    WITH s AS (SELECT company_id, extraction_method, count(*) AS n, count(DISTINCT lower(trim(title))) AS titles, count(DISTINCT source_url) AS urls, count(*) FILTER (length(title) < 5) AS bad FROM extracted_jobs GROUP BY 1, 2),
    c AS (SELECT *, round((3.2 * ln(1 + n) + 2.3 * titles::DOUBLE / n + 1.7 * urls::DOUBLE / n - 3.5 * bad::DOUBLE / n), 6) AS score FROM s)
    SELECT company_id, extraction_method, score FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, extraction_method) AS p FROM c) WHERE p = 1""")
def h20_best_set(spark, sf_dir):
    """Of several sets of jobs for a site, the one of highest score by size, distinct titles and addresses, and bad titles."""
    jobs = T(spark, sf_dir).extracted_jobs
    sets = jobs.groupBy("company_id", "extraction_method").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("title"))).alias("titles"), F.countDistinct("source_url").alias("urls"), F.count_if(F.length("title") < 5).alias("bad"))
    score = 3.2 * F.log1p(F.col("n")) + 2.3 * F.col("titles") / F.col("n") + 1.7 * F.col("urls") / F.col("n") - 3.5 * F.col("bad") / F.col("n")
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("score"), "extraction_method"))
    return sets.withColumn("score", F.round(score, 6)).withColumn("p", place).where("p = 1").select("company_id", "extraction_method", "score")


@query("SELECT job_id, coalesce(nullif(trim(location_raw, ' '), ''), nullif(trim(market_code, ' '), '')) AS location_raw, coalesce(nullif(trim(description, ' '), ''), title) AS description FROM extracted_jobs")
def h19_fill_blanks(spark, sf_dir):
    """Blank fields filled from later sources in order; filled ones stay."""
    first = lambda *c: F.coalesce(*(F.nullif(F.trim(F.col(x)), F.lit("")) for x in c[:-1]), F.col(c[-1]))
    return T(spark, sf_dir).extracted_jobs.select("job_id", first("location_raw", "market_code").alias("location_raw"), first("description", "title").alias("description"))


@query()
def e27_block_classifier(spark, sf_dir):
    """Share of marked jobs that a text model, fitted on half of them, judges as their mark says."""
    t = T(spark, sf_dir)
    rows = t.extracted_jobs.select("job_id", F.concat_ws(" ", "title", "description").alias("text")).join(t.labels.groupBy("job_id").agg(F.max("toxic").cast("double").alias("label")), "job_id")
    return classify.held_out(rows, "job_id")


@query("SELECT job_id FROM extracted_jobs WHERE length(trim(coalesce(title, ''), ' ')) < 5")
def x19_short_titles(spark, sf_dir):
    jobs = T(spark, sf_dir).extracted_jobs
    return jobs.where(~valid_title(F.col("title")) & (F.length(F.trim(F.coalesce("title", F.lit("")))) < 5)).select("job_id")
