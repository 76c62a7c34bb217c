"""Queries over URLs and domains."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.urls import best_candidates
from ..tables import table

BLOCKED = ["powa-health-2.example", "kekia-farms-12.example"]
HOST = r"lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
PATH = r"regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract(source_url, '\?([^#]*)', 1)"
SUFFIXES = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
REGISTRABLE = f"""CASE WHEN len(string_split(h, '.')) <= 2 THEN h
    WHEN array_to_string(string_split(h, '.')[-2:], '.') IN ({SUFFIXES}) THEN array_to_string(string_split(h, '.')[-3:], '.')
    ELSE array_to_string(string_split(h, '.')[-2:], '.') END"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extracted_jobs")


def u1_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by registrable domain."""
    return _jobs(spark, sf_dir).groupBy(urls.registrable_domain(F.col("source_url")).alias("domain")).agg(F.count("*").alias("jobs"))


def u2_normal_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each company's root URL as typed into a list."""
    return table(spark, sf_dir, "companies").select("company_id", urls.normal_domain(F.col("root_url")).alias("domain"))


def u3_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by whether their host is on a block list."""
    return _jobs(spark, sf_dir).groupBy(urls.blocked(F.col("source_url"), BLOCKED).alias("blocked")).agg(F.count("*").alias("jobs"))


def u4_url_job_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_id", urls.url_job_id(F.col("source_url")).alias("url_id"))


def u5_job_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_id", urls.is_job_url(F.col("source_url")).alias("is_job_url"))


def u6_detail_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_id", urls.is_detail_path(F.col("source_url")).alias("is_detail"))


def u7_career_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gold_holdout_snapshots").select("snapshot_id", urls.career_score(F.col("url"), F.col("content_type")).alias("score"))


def u8_normal_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_id", urls.normal_url(F.col("source_url")).alias("url"))


def u9_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five URLs a company: trusted methods first, then confidence."""
    rows = _jobs(spark, sf_dir).select("company_id", F.col("source_url").alias("url"), "extraction_method", "extraction_confidence")
    return best_candidates(rows, trusted=["schema_org", "ats_api"], least=0.5, most=5)


def u10_likely_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir).join(table(spark, sf_dir, "companies").select("company_id", "root_url"), "company_id")
    return jobs.groupBy("company_id").agg(F.sum(urls.likely_job_url(F.col("source_url"), F.col("root_url")).cast("long")).alias("likely"), F.count("*").alias("jobs"))


def u11_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.split(F.col("domain"), r"\.")[0], F.lit(".com."), F.lower("market_code"))
    return table(spark, sf_dir, "companies").select("company_id", urls.market_of(own).alias("market"), urls.name_of(F.col("domain")).alias("name"))


def u12_site_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each found page, unless it is on a skip list."""
    rows = table(spark, sf_dir, "company_enrichment_rows").where("job_page_url is not null")
    domain = F.regexp_replace(urls.host(F.col("job_page_url")), r"^www\.", "")
    return rows.select("row_id", domain.alias("domain")).where("domain <> '' and domain not in ('facebook.com', 'linkedin.com')")


def u13_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = F.concat(F.col("source_url"), F.when(F.col("job_id") % 3 == 0, F.lit("?page=2")).otherwise(F.lit("?view=all")))
    return _jobs(spark, sf_dir).select("job_id", urls.has_paging(paged).alias("has_paging"))


QUERIES = {f.__name__: f for f in (u1_registrable_domain, u2_normal_domain, u3_blocked, u4_url_job_id, u5_job_url, u6_detail_path, u7_career_score, u8_normal_url, u9_candidates, u10_likely_job, u11_market, u12_site_domain, u13_paging)}

_ID = "regexp_matches(s, '^[0-9]+$') OR (regexp_matches(s, '^\\w{2,}[-\\w]*$') AND regexp_matches(s, '\\d') AND length(s) >= 4 AND lower(s) NOT IN (" + ", ".join(f"'{x}'" for x in urls.NO_ID) + "))"
_TRACKING = ", ".join(f"'{x}'" for x in urls.TRACKING)
SQL = {
    "u1_registrable_domain": f"SELECT {REGISTRABLE} AS domain, count(*) AS jobs FROM (SELECT {HOST} AS h FROM extracted_jobs) GROUP BY 1",
    "u2_normal_domain": r"SELECT company_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(root_url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':\d+$', ''), '^www\.', '') AS domain FROM companies",
    "u3_blocked": f"SELECT h = '' OR " + " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in BLOCKED) + f" AS blocked, count(*) AS jobs FROM (SELECT regexp_replace({HOST}, '^www\\.', '') AS h FROM extracted_jobs) GROUP BY 1",
    "u4_url_job_id": f"SELECT job_id, lower(list_filter(list_reverse(string_split({PATH}, '/')), lambda s: s <> '' AND ({_ID}))[1]) AS url_id FROM extracted_jobs",
    "u5_job_url": f"SELECT job_id, regexp_matches(source_url, '{urls.JOB_URL}') AS is_job_url FROM extracted_jobs",
    "u6_detail_path": f"SELECT job_id, regexp_matches(lower({PATH}), '/(?:jobs?|careers?|vacanc(?:y|ies)|positions?|openings?|opportunit(?:y|ies))/[^/]+') AS is_detail FROM extracted_jobs",
    "u7_career_score": r"""
        WITH p AS (SELECT snapshot_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p, lower(coalesce(content_type, '')) AS t FROM gold_holdout_snapshots),
        s AS (SELECT *, CASE WHEN regexp_matches(p, 'career|jobs?(?:/|$)|vacanc|work-with-us|join-us') THEN 0.45 WHEN regexp_matches(p, 'about|people|team|opportunit') THEN 0.2 ELSE 0 END AS a,
            CASE WHEN regexp_matches(t, 'career|jobs?\b|vacanc|work with us|join us') THEN 0.4 WHEN regexp_matches(t, 'about|people|team|opportunit') THEN 0.15 ELSE 0 END AS b FROM p)
        SELECT snapshot_id, CASE WHEN regexp_matches(p, '\.(?:pdf|docx?|jpe?g|png|gif|zip|css|js|xml)$') THEN 0.0 ELSE least(1.0, round(CAST(a + b + CASE WHEN a > 0 AND b > 0 THEN 0.1 ELSE 0 END AS DOUBLE), 2)) END::DOUBLE AS score FROM s""",
    "u8_normal_url": f"""
        WITH u AS (SELECT job_id, source_url, regexp_replace(regexp_replace(regexp_replace(trim(source_url), '#.*$', ''), '\\?.*$', ''), '/+$', '') AS b,
            array_to_string(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({_TRACKING})), '&') AS q FROM extracted_jobs)
        SELECT job_id, CASE WHEN regexp_matches(lower(trim(source_url)), '^(?:javascript|mailto|tel):|^#') THEN NULL ELSE b || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url FROM u""",
    "u9_candidates": """
        WITH c AS (SELECT company_id, source_url AS url, extraction_method IN ('schema_org', 'ats_api') AS trusted, CASE WHEN extraction_method = 'root_fallback' THEN least(extraction_confidence, 0.6) ELSE extraction_confidence END AS confidence FROM extracted_jobs),
        o AS (SELECT company_id, url, max(trusted::INT) AS trusted, max(confidence) FILTER (trusted::INT = m) AS confidence FROM (SELECT *, max(trusted::INT) OVER (PARTITION BY company_id, url) AS m FROM c WHERE confidence >= 0.5) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY trusted DESC, confidence DESC, url) AS place FROM o)
        SELECT company_id, url, trusted = 1 AS trusted, confidence, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""",
    "u10_likely_job": f"""
        WITH j AS (SELECT company_id, source_url, {PATH} AS p, regexp_extract(root_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS r FROM extracted_jobs JOIN companies USING (company_id))
        SELECT company_id, CAST(sum(CAST(p <> r AND len(list_filter(string_split(p, '/'), lambda s: s <> '')) >= 2 AND NOT regexp_matches(lower(source_url), '/(?:search|login|register|category|tag|feed|rss)(?:/|$|\\?)') AS INT)) AS BIGINT) AS likely, count(*) AS jobs FROM j GROUP BY 1""",
    "u11_market": """
        SELECT company_id, CASE WHEN market_code IN ('AU', 'SG', 'MY', 'HK', 'PH') THEN market_code WHEN market_code IN ('NZ', 'ID', 'TH') THEN market_code END AS market,
            array_to_string(list_transform(string_split(regexp_replace(string_split(array_to_string(string_split(domain, '.')[-2:], '.'), '.')[1], '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM companies""",
    "u12_site_domain": r"SELECT row_id, d AS domain FROM (SELECT row_id, regexp_replace(lower(regexp_extract(job_page_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS d FROM company_enrichment_rows WHERE job_page_url IS NOT NULL) WHERE d NOT IN ('', 'facebook.com', 'linkedin.com')",
    "u13_paging": r"SELECT job_id, regexp_matches(lower(source_url || CASE WHEN job_id % 3 = 0 THEN '?page=2' ELSE '?view=all' END), '[?&](?:page|p|pg|offset|start|from|skip)=\d+') AS has_paging FROM extracted_jobs",
}
