"""Queries of the relational operators: filters, joins, aggregates, windows, orders and time series."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as r
from ..tables import table

AS_OF = "2025-09-01 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now() -> Column:
    """The instant the queries are asked at."""
    return F.lit(AS_OF).cast("timestamp")


class T:
    """The tables of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(*self._at, name)


# ---- filters


@query("SELECT job_id, title FROM extracted_jobs WHERE market_code = 'AU' AND is_active AND (coalesce(title, '') ILIKE '%clerk%' OR coalesce(description, '') ILIKE '%clerk%') AND extraction_confidence >= 0.5 AND extraction_confidence < 0.9")
def f1_job_filter(spark, sf_dir):
    band = (F.col("extraction_confidence") >= 0.5) & (F.col("extraction_confidence") < 0.9)
    found = r.where_all(T(spark, sf_dir).extracted_jobs, [r.matches("market_code", "AU"), r.matches("is_active", True), r.matches("employment_type", None), r.contains_any(["title", "description"], "clerk"), band])
    return found.select("job_id", "title")


@query("SELECT job_id, first_seen_at, (SELECT count(*) FROM extracted_jobs) AS total FROM extracted_jobs ORDER BY first_seen_at DESC, job_id LIMIT 20 OFFSET 40")
def f2_page(spark, sf_dir):
    jobs = T(spark, sf_dir).extracted_jobs.select("job_id", "first_seen_at")
    total = jobs.agg(F.count("*").alias("total"))
    return r.page(jobs, [F.desc("first_seen_at"), F.asc("job_id")], 3, 20).crossJoin(F.broadcast(total))


@query("SELECT company_id, name FROM companies WHERE is_active")
def f3_optional(spark, sf_dir):
    return r.where_all(T(spark, sf_dir).companies, [r.matches("market_code", None), r.matches("is_active", True)]).select("company_id", "name")


@query("SELECT count(*) AS total FROM companies")
def f4_exact_total(spark, sf_dir):
    return T(spark, sf_dir).companies.agg(F.count("*").alias("total"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER) > 50, false) AS high FROM events")
def f5_json_flag(spark, sf_dir):
    high = F.get_json_object("props", "$.k").cast("int") > 50
    return T(spark, sf_dir).events.select("event_id", high.eqNullSafe(F.lit(True)).alias("high"))


@query("SELECT job_id, description[:150] AS start, date_posted FROM extracted_jobs WHERE extraction_confidence < 0.5 AND date_posted >= DATE '2025-03-01'")
def f6_low_confidence(spark, sf_dir):
    jobs, low, high = T(spark, sf_dir).extracted_jobs, F.try_to_timestamp(F.lit("2025-03-01")), F.try_to_timestamp(F.lit("not a date"))
    inside = (F.col("date_posted") >= low.cast("date")) & F.coalesce(F.col("date_posted") <= high.cast("date"), high.isNull())
    return jobs.where((F.col("extraction_confidence") < 0.5) & inside).select("job_id", F.substring("description", 1, 150).alias("start"), "date_posted")


@query(f"SELECT count(*) AS n, count(DISTINCT company_id) AS companies FROM crawl_logs WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR * 30 AND started_at < TIMESTAMP '{AS_OF}'")
def f8_time_range(spark, sf_dir):
    logs = T(spark, sf_dir).crawl_logs.where((F.col("started_at") >= now() - F.expr("INTERVAL 30 DAYS")) & (F.col("started_at") < now()))
    return logs.agg(F.count("*").alias("n"), F.countDistinct("company_id").alias("companies"))


@query("SELECT geo_id FROM geo_locations WHERE len(list_filter(alt_names, lambda x: x LIKE '%Province%')) > 0")
def f9_array_like(spark, sf_dir):
    return T(spark, sf_dir).geo_locations.where(F.exists("alt_names", lambda x: x.like("%Province%"))).select("geo_id")


@query("""
    WITH n AS (SELECT *, lower(trim(company)) AS c, lower(trim(country)) AS k FROM company_enrichment_rows WHERE status = 'done' AND completed_at >= TIMESTAMP '2025-03-01'),
    w AS (SELECT DISTINCT lower(trim(company)) AS c, lower(trim(country)) AS k FROM id_sample_700),
    o AS (SELECT n.*, row_number() OVER (PARTITION BY c, k ORDER BY completed_at DESC, row_id DESC) AS place FROM n SEMI JOIN w USING (c, k) WHERE NOT coalesce(job_page_url, '') LIKE '%blocked%')
    SELECT row_id, c AS company, k AS country FROM o WHERE place = 1""")
def f10_cached_pairs(spark, sf_dir):
    t = T(spark, sf_dir)
    pair = lambda df: df.withColumns({"c": F.lower(F.trim("company")), "k": F.lower(F.trim("country"))})
    fresh = pair(t.company_enrichment_rows.where("status = 'done' and completed_at >= timestamp '2025-03-01 00:00:00'"))
    hits = r.with_any(fresh, pair(t.id_sample_700), ["c", "k"]).where(~F.coalesce("job_page_url", F.lit("")).contains("blocked"))
    return r.first_per(hits, ["c", "k"], [F.desc("completed_at"), F.desc("row_id")]).select("row_id", F.col("c").alias("company"), F.col("k").alias("country"))


@query("SELECT geo_id, name, level FROM geo_locations WHERE market_code = 'AU' AND level >= 3 AND is_active")
def f11_list(spark, sf_dir):
    return r.where_all(T(spark, sf_dir).geo_locations, [r.matches("market_code", "AU"), F.col("level") >= 3, r.matches("is_active", True)]).select("geo_id", "name", "level")


@query("SELECT company_id, array_to_string(list_filter([CASE WHEN market_code IN ('AU', 'NZ') THEN 'oceania' END, CASE WHEN market_code NOT IN ('AU', 'NZ') THEN 'asia' END, CASE WHEN is_active THEN 'active' END], lambda x: x IS NOT NULL), ',') AS flags FROM companies")
def f12_flag_lists(spark, sf_dir):
    ocean = F.col("market_code").isin("AU", "NZ")
    flags = F.array_compact(F.array(F.when(ocean, "oceania"), F.when(~ocean, "asia"), F.when(F.col("is_active"), "active")))
    return T(spark, sf_dir).companies.select("company_id", F.array_join(flags, ",").alias("flags"))


# ---- joins


@query("SELECT c.market_code, count(*) AS jobs, count(DISTINCT j.company_id) AS companies, round(avg(extraction_confidence), 6) AS confidence FROM extracted_jobs j JOIN companies c USING (company_id) GROUP BY 1")
def j1_market_breakdown(spark, sf_dir):
    t = T(spark, sf_dir)
    joined = t.extracted_jobs.select("company_id", "extraction_confidence").join(t.companies.select("company_id", "market_code"), "company_id")
    return joined.groupBy("market_code").agg(F.count("*").alias("jobs"), F.countDistinct("company_id").alias("companies"), F.round(F.avg("extraction_confidence"), 6).alias("confidence"))


@query("SELECT c.company_id, count(*) AS active_jobs FROM companies c LEFT JOIN extracted_jobs j USING (company_id) WHERE j.is_active GROUP BY 1")
def j2_outer_made_inner(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.companies.select("company_id").join(t.extracted_jobs.where("is_active").select("company_id"), "company_id").groupBy("company_id").agg(F.count("*").alias("active_jobs"))


@query("SELECT c.company_id, c.name, count(j.job_id) AS jobs FROM companies c LEFT JOIN extracted_jobs j USING (company_id) GROUP BY 1, 2 ORDER BY jobs DESC, company_id LIMIT 40")
def j3_top_companies(spark, sf_dir):
    t = T(spark, sf_dir)
    counts = t.extracted_jobs.groupBy("company_id").agg(F.count("*").alias("jobs"))
    joined = t.companies.select("company_id", "name").join(counts, "company_id", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    return r.top_k(joined, [F.desc("jobs"), F.asc("company_id")], 40)


@query("""
    WITH s AS (SELECT company_id, count(*) AS logs, max(started_at) AS last_started FROM crawl_logs WHERE company_id IS NOT NULL GROUP BY 1)
    SELECT c.company_id, c.ats_platform, s.logs, p.crawl_type AS last_full FROM companies c LEFT JOIN s USING (company_id)
    LEFT JOIN (SELECT company_id, max(crawl_type) AS crawl_type FROM crawl_logs WHERE crawl_type = 'full_crawl' GROUP BY 1) p ON p.company_id = c.company_id AND c.is_active""")
def j4_multi_way(spark, sf_dir):
    t = T(spark, sf_dir)
    stats = t.crawl_logs.where("company_id is not null").groupBy("company_id").agg(F.count("*").alias("logs"))
    full = t.crawl_logs.where("crawl_type = 'full_crawl'").groupBy(F.col("company_id").alias("cid")).agg(F.max("crawl_type").alias("last_full"))
    return t.companies.join(stats, "company_id", "left").join(full, (F.col("cid") == F.col("company_id")) & F.col("is_active"), "left").select("company_id", "ats_platform", "logs", "last_full")


@query("SELECT l.log_id, c.name, l.started_at FROM (SELECT DISTINCT log_id, company_id, started_at FROM crawl_logs) l LEFT JOIN companies c USING (company_id) ORDER BY l.started_at DESC, l.log_id LIMIT 10")
def j5_latest_logs(spark, sf_dir):
    t = T(spark, sf_dir)
    last = r.top_k(t.crawl_logs.select("log_id", "company_id", "started_at").distinct(), [F.desc("started_at"), F.asc("log_id")], 10)
    return last.join(t.companies.select("company_id", "name"), "company_id", "left").select("log_id", "name", "started_at")


@query("SELECT g.geo_id, g.name, p.name AS parent FROM geo_locations g LEFT JOIN geo_locations p ON p.geo_id = g.parent_id")
def j6_parent_name(spark, sf_dir):
    geo = T(spark, sf_dir).geo_locations
    return geo.select("geo_id", "name", "parent_id").join(geo.select(F.col("geo_id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").drop("parent_id")


@query("""
    WITH RECURSIVE w AS (SELECT geo_id AS id, name AS n, parent_id AS up, 0 AS depth FROM geo_locations
        UNION ALL SELECT w.id, g.name, g.parent_id, depth + 1 FROM w JOIN geo_locations g ON g.geo_id = w.up WHERE depth < 3)
    SELECT id AS geo_id, string_agg(n, ', ' ORDER BY depth) AS path FROM w GROUP BY 1""")
def j7_ancestors(spark, sf_dir):
    return r.ancestors(T(spark, sf_dir).geo_locations, "geo_id", "parent_id", "name")


@query("SELECT company_id, log_id, started_at FROM (SELECT DISTINCT company_id, log_id, started_at, dense_rank() OVER (PARTITION BY company_id ORDER BY started_at DESC, log_id DESC) AS place FROM crawl_logs WHERE company_id IS NOT NULL) WHERE place = 1")
def j8_latest_row(spark, sf_dir):
    return r.latest_per(T(spark, sf_dir).crawl_logs.where("company_id is not null"), ["company_id"], "started_at", ["log_id"])


@query(r"SELECT j.job_id, max(c.company_id) AS company_id FROM extracted_jobs j JOIN companies c ON contains(lower(j.source_url), lower(c.domain)) GROUP BY 1")
def j9_domain_within(spark, sf_dir):
    """A substring condition made an equality: every host suffix of the URL is looked up."""
    t = T(spark, sf_dir)
    from ..functions.urls import host

    labels = F.split(host(F.col("source_url")), r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    return t.extracted_jobs.select("job_id", suffix.alias("domain")).join(t.companies.select("company_id", F.lower("domain").alias("domain")), "domain").groupBy("job_id").agg(F.max("company_id").alias("company_id"))


@query("SELECT company_id, EXISTS (SELECT 1 FROM extracted_jobs j WHERE j.company_id = c.company_id) AS has_jobs FROM companies c")
def j10_semi_anti(spark, sf_dir):
    t = T(spark, sf_dir)
    own = t.companies.select("company_id")
    yes, no = r.with_any(own, t.extracted_jobs, ["company_id"]), r.without(own, t.extracted_jobs, ["company_id"])
    return yes.withColumn("has_jobs", F.lit(True)).unionByName(no.withColumn("has_jobs", F.lit(False)))


@query("""
    SELECT c.company_id, CASE WHEN EXISTS (SELECT 1 FROM extracted_jobs j WHERE j.company_id = c.company_id) THEN 1 ELSE 0 END AS priority
    FROM companies c WHERE NOT EXISTS (SELECT 1 FROM crawl_logs l WHERE l.company_id = c.company_id AND l.status = 'success' AND l.started_at >= TIMESTAMP '2025-08-01')""")
def j11_candidates(spark, sf_dir):
    t = T(spark, sf_dir)
    open_ones = r.without(t.companies.select("company_id"), t.crawl_logs.where("status = 'success' and started_at >= timestamp '2025-08-01 00:00:00'"), ["company_id"])
    known = t.extracted_jobs.select("company_id").distinct().withColumn("priority", F.lit(1))
    return open_ones.join(known, "company_id", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))


@query("SELECT job_id, extraction_confidence FROM extracted_jobs j WHERE extraction_confidence IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.job_id = j.job_id) ORDER BY extraction_confidence, job_id LIMIT 25")
def j12_unreviewed(spark, sf_dir):
    t = T(spark, sf_dir)
    rest = r.without(t.extracted_jobs.where("extraction_confidence is not null").select("job_id", "extraction_confidence"), t.labels, ["job_id"])
    return r.top_k(rest, [F.asc("extraction_confidence"), F.asc("job_id")], 25)


@query("SELECT DISTINCT company_id FROM companies c WHERE EXISTS (SELECT 1 FROM extracted_jobs j WHERE j.company_id = c.company_id AND (j.description IS NULL OR j.extraction_method = 'root_fallback'))")
def j13_to_redo(spark, sf_dir):
    t = T(spark, sf_dir)
    return r.with_any(t.companies.select("company_id"), t.extracted_jobs.where("description is null or extraction_method = 'root_fallback'"), ["company_id"])


@query("SELECT company_id FROM companies WHERE domain NOT IN (SELECT domain FROM companies WHERE NOT is_active AND domain IS NOT NULL)")
def j14_not_in(spark, sf_dir):
    companies = T(spark, sf_dir).companies
    return r.without(companies.select("company_id", "domain"), companies.where("not is_active and domain is not null"), ["domain"]).select("company_id")


@query("""
    SELECT c.company_id FROM companies c LEFT JOIN extracted_jobs j USING (company_id) WHERE (SELECT count(*) FROM crawl_logs l WHERE l.company_id = c.company_id) >= 3 GROUP BY 1 HAVING count(j.job_id) < 50""")
def j15_having(spark, sf_dir):
    t = T(spark, sf_dir)
    logs = t.crawl_logs.groupBy("company_id").agg(F.count("*").alias("logs")).where("logs >= 3")
    jobs = t.extracted_jobs.groupBy("company_id").agg(F.count("*").alias("jobs"))
    return t.companies.select("company_id").join(logs, "company_id").join(jobs, "company_id", "left").where(F.coalesce("jobs", F.lit(0)) < 50).select("company_id")


@query("SELECT d.job_id, k.job_id AS canonical_id, d.title, k.title AS canonical_title FROM extracted_jobs d LEFT JOIN (SELECT company_id, min(job_id) AS job_id, arg_min(title, job_id) AS title FROM extracted_jobs GROUP BY 1) k USING (company_id)")
def j16_side_by_side(spark, sf_dir):
    jobs = T(spark, sf_dir).extracted_jobs
    first = jobs.groupBy("company_id").agg(F.min("job_id").alias("canonical_id"), F.min_by("title", "job_id").alias("canonical_title"))
    return jobs.select("job_id", "company_id", "title").join(first, "company_id", "left").drop("company_id")


@query("""
    WITH n AS (SELECT DISTINCT company_id, lower(trim(title)) AS t FROM extracted_jobs WHERE NOT is_active), a AS (SELECT DISTINCT company_id, lower(trim(title)) AS t FROM extracted_jobs WHERE is_active),
    d AS (SELECT n.*, row_number() OVER (PARTITION BY n.company_id ORDER BY n.t) AS place FROM n ANTI JOIN a USING (company_id, t)) SELECT company_id, t AS title FROM d WHERE place <= 6""")
def j19_title_difference(spark, sf_dir):
    jobs = T(spark, sf_dir).extracted_jobs.select("company_id", F.lower(F.trim("title")).alias("title"), "is_active")
    gone = r.without(jobs.where("not is_active").select("company_id", "title").distinct(), jobs.where("is_active"), ["company_id", "title"])
    return r.first_per(gone, ["company_id"], [F.asc("title")], 6)


# ---- aggregates

COVERED = ["external_id", "description", "location_raw", "salary_raw", "employment_type", "date_posted"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS filled, round(count({c}) * 100.0 / greatest(count(*), 1), 1)::DOUBLE AS share FROM extracted_jobs" for c in COVERED))
def a1_coverage(spark, sf_dir):
    return r.coverage(T(spark, sf_dir).extracted_jobs, COVERED)


_BAND = "CASE WHEN s IS NULL THEN NULL WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'fair' WHEN s >= 20 THEN 'poor' ELSE 'low' END"


@query(f"SELECT {_BAND} AS band, count(*) AS companies, round(avg(s), 4) AS mean FROM (SELECT quality_score AS s FROM companies) GROUP BY 1")
def a2_bands(spark, sf_dir):
    band = r.bands(F.col("quality_score"), [("excellent", 80), ("good", 60), ("fair", 40), ("poor", 20)], "low")
    return T(spark, sf_dir).companies.groupBy(band.alias("band")).agg(F.count("*").alias("companies"), F.round(F.avg("quality_score"), 4).alias("mean"))


@query(f"SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (description IS NULL) AS bare, count(*) FILTER (first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week, count(*) FILTER (first_seen_at >= TIMESTAMP '2025-08-31 14:00:00') AS today FROM extracted_jobs")
def a3_counters(spark, sf_dir):
    """Counters in one pass; "today" begins at midnight in Sydney."""
    local = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now(), "Australia/Sydney")), "Australia/Sydney")
    return T(spark, sf_dir).extracted_jobs.agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("description").isNull()).alias("bare"),
        F.count_if(F.col("first_seen_at") >= now() - F.expr("INTERVAL 7 DAYS")).alias("week"), F.count_if(F.col("first_seen_at") >= local).alias("today"),
    )


@query("SELECT count(*) FILTER (coalesce(length(title), 0) < 5) AS short_title, count(*) FILTER (coalesce(length(description), 0) < 100) AS short_text, count(*) FILTER (location_raw IS NULL) AS no_place, count(*) FILTER (coalesce(length(description), 0) < 100 AND location_raw IS NULL) AS short_and_no_place FROM extracted_jobs")
def a4_overlapping(spark, sf_dir):
    short, bare = F.coalesce(F.length("description"), F.lit(0)) < 100, F.col("location_raw").isNull()
    return T(spark, sf_dir).extracted_jobs.agg(F.count_if(F.coalesce(F.length("title"), F.lit(0)) < 5).alias("short_title"), F.count_if(short).alias("short_text"), F.count_if(bare).alias("no_place"), F.count_if(short & bare).alias("short_and_no_place"))


@query("SELECT extraction_method, count(*) AS jobs, round(avg(length(description)), 4) AS mean, quantile_cont(length(description), 0.5) AS median FROM extracted_jobs WHERE description IS NOT NULL GROUP BY 1")
def a5_audit(spark, sf_dir):
    n = F.length("description")
    return T(spark, sf_dir).extracted_jobs.where("description is not null").groupBy("extraction_method").agg(F.count("*").alias("jobs"), F.round(F.avg(n), 4).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"))


@query("SELECT band, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM (SELECT CASE WHEN length(description) IS NULL THEN 'none' WHEN length(description) >= 1000 THEN 'long' WHEN length(description) >= 500 THEN 'middle' ELSE 'short' END AS band FROM extracted_jobs) GROUP BY 1")
def a6_histogram(spark, sf_dir):
    band = F.coalesce(r.bands(F.length("description"), [("long", 1000), ("middle", 500)], "short"), F.lit("none"))
    return r.share_of_total(T(spark, sf_dir).extracted_jobs.select(band.alias("band")), ["band"])


@query("SELECT crawl_type, count(*) AS logs, round(count(*) FILTER (status = 'success')::DOUBLE / nullif(count(*) FILTER (status <> 'partial'), 0), 6) AS rate FROM crawl_logs GROUP BY 1")
def a7_rates(spark, sf_dir):
    rate = F.count_if(F.col("status") == "success") / F.nullif(F.count_if(F.col("status") != "partial"), F.lit(0))
    return T(spark, sf_dir).crawl_logs.groupBy("crawl_type").agg(F.count("*").alias("logs"), F.round(rate, 6).alias("rate"))


@query("SELECT company_id, count(*) - count(DISTINCT source_url) AS repeats FROM extracted_jobs GROUP BY 1 HAVING count(*) > count(DISTINCT source_url) ORDER BY repeats DESC, company_id LIMIT 15")
def a8_having(spark, sf_dir):
    repeats = F.count("*") - F.countDistinct("source_url")
    return r.top_k(T(spark, sf_dir).extracted_jobs.groupBy("company_id").agg(repeats.alias("repeats")).where("repeats > 0"), [F.desc("repeats"), F.asc("company_id")], 15)


@query("SELECT market_code, count(DISTINCT title) AS titles, count(DISTINCT company_id) AS companies, round(avg(extraction_confidence), 6) AS confidence FROM extracted_jobs GROUP BY 1")
def a9_distinct(spark, sf_dir):
    return T(spark, sf_dir).extracted_jobs.groupBy("market_code").agg(F.countDistinct("title").alias("titles"), F.countDistinct("company_id").alias("companies"), F.round(F.avg("extraction_confidence"), 6).alias("confidence"))


@query("SELECT trim(country) AS country, count(*) AS n FROM company_enrichment_rows GROUP BY 1 ORDER BY n DESC, country LIMIT 20")
def a10_counts(spark, sf_dir):
    return r.top_k(T(spark, sf_dir).company_enrichment_rows.groupBy(F.trim("country").alias("country")).agg(F.count("*").alias("n")), [F.desc("n"), F.asc("country")], 20)


@query("SELECT lower(trim(country)) AS country, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'pending') AS pending, sum(attempt_count)::BIGINT AS attempts FROM company_enrichment_rows GROUP BY 1")
def a11_pivot(spark, sf_dir):
    rows = T(spark, sf_dir).company_enrichment_rows
    return rows.groupBy(F.lower(F.trim("country")).alias("country")).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("done", "error", "pending")), F.sum("attempt_count").alias("attempts"))


@query("""
    WITH m AS (SELECT company_id, extraction_method, avg(extraction_confidence) AS c FROM extracted_jobs GROUP BY 1, 2)
    SELECT a.extraction_method AS method_a, b.extraction_method AS method_b, count(*) AS companies, round(avg(abs(a.c - b.c)), 6) AS apart FROM m a JOIN m b ON a.company_id = b.company_id AND a.extraction_method < b.extraction_method GROUP BY 1, 2""")
def a12_method_pairs(spark, sf_dir):
    """Methods number a handful, so pairs within a company are few."""
    means = T(spark, sf_dir).extracted_jobs.groupBy("company_id", "extraction_method").agg(F.avg("extraction_confidence").alias("c"))
    a, b = (means.select("company_id", F.col("extraction_method").alias(f"method_{x}"), F.col("c").alias(f"c_{x}")) for x in "ab")
    return a.join(b, "company_id").where("method_a < method_b").groupBy("method_a", "method_b").agg(F.count("*").alias("companies"), F.round(F.avg(F.abs(F.col("c_a") - F.col("c_b"))), 6).alias("apart"))


@query("SELECT extraction_method, count(*) FILTER (location_raw IS NOT NULL) AS placed, count(*) FILTER (location_raw IS NULL) AS bare FROM extracted_jobs GROUP BY 1")
def a13_by_method(spark, sf_dir):
    return T(spark, sf_dir).extracted_jobs.groupBy("extraction_method").agg(F.count_if(F.col("location_raw").isNotNull()).alias("placed"), F.count_if(F.col("location_raw").isNull()).alias("bare"))


@query(f"""
    WITH l AS (SELECT *, started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AS today, started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 60 MINUTE AS hour FROM crawl_logs WHERE started_at < TIMESTAMP '{AS_OF}'),
    q AS (SELECT count(*) AS rows, count(*) FILTER (description IS NOT NULL) AS with_text, count(*) FILTER (description IS NOT NULL AND extraction_confidence >= 0.5) AS good, count(*) FILTER (description IS NOT NULL AND extraction_confidence >= 0.5 AND is_active) AS live FROM extracted_jobs)
    SELECT coalesce(sum(pages_crawled), 0)::BIGINT AS pages, coalesce(sum(pages_crawled) FILTER (today), 0)::BIGINT AS pages_today, coalesce(sum(jobs_new) FILTER (today), 0)::BIGINT AS new_today, round(coalesce(sum(pages_crawled) FILTER (hour), 0) / 60.0, 6)::DOUBLE AS pages_a_minute,
        round(count(*) FILTER (hour) / 60.0, 6)::DOUBLE AS crawls_a_minute, any_value(rows) AS rows, any_value(with_text) AS with_text, any_value(good) AS good, any_value(live) AS live FROM l, q""")
def a14_rolling(spark, sf_dir):
    """Sums of today, rates of the last hour, and how many rows pass each step of quality."""
    t = T(spark, sf_dir)
    since = lambda span, c: F.when(F.col("started_at") >= now() - F.expr(f"INTERVAL {span}"), F.col(c))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    logs = t.crawl_logs.where(F.col("started_at") < now()).agg(
        total("pages_crawled").alias("pages"), total(since("1 DAY", "pages_crawled")).alias("pages_today"), total(since("1 DAY", "jobs_new")).alias("new_today"),
        F.round(total(since("60 MINUTES", "pages_crawled")) / 60.0, 6).alias("pages_a_minute"), F.round(F.count(since("60 MINUTES", "started_at")) / 60.0, 6).alias("crawls_a_minute"),
    )
    text = F.col("description").isNotNull()
    good = text & (F.col("extraction_confidence") >= 0.5)
    funnel = t.extracted_jobs.agg(F.count("*").alias("rows"), F.count_if(text).alias("with_text"), F.count_if(good).alias("good"), F.count_if(good & F.col("is_active")).alias("live"))
    # One row each.
    return logs.crossJoin(F.broadcast(funnel))


@query("""
    WITH p AS (SELECT market_code, company_id, coalesce(quality_score, 0) AS w FROM companies)
    SELECT company_id, round(100 * CASE WHEN sum(w) OVER m > 0 THEN w / sum(w) OVER m ELSE 1.0 / count(*) OVER m END, 4) AS share FROM p WINDOW m AS (PARTITION BY market_code)""")
def a15_pro_rata(spark, sf_dir):
    return r.pro_rata(T(spark, sf_dir).companies, ["market_code"], "quality_score", F.lit(100)).select("company_id", "share")


@query("SELECT status, CASE WHEN job_page_url IS NULL THEN 'open' WHEN job_page_url = 'not found' THEN 'missing' ELSE 'found' END AS kind, count(*) AS n, count(*) FILTER (greatest(created_at, started_at, completed_at) BETWEEN TIMESTAMP '2025-06-01' AND TIMESTAMP '2025-09-01') AS recent FROM company_enrichment_rows GROUP BY 1, 2")
def a16_greatest(spark, sf_dir):
    """Queue rows by kind and status, and those last touched within a range; missing times are passed over."""
    last = F.greatest("created_at", "started_at", "completed_at")
    kind = F.when(F.col("job_page_url").isNull(), "open").when(F.col("job_page_url") == "not found", "missing").otherwise("found")
    inside = last.between(F.lit("2025-06-01").cast("timestamp"), F.lit("2025-09-01").cast("timestamp"))
    return T(spark, sf_dir).company_enrichment_rows.groupBy("status", kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(inside).alias("recent"))


@query("""
    SELECT level, market_code, count(*) AS places, count(*) FILTER (is_active) AS active, count(*) FILTER (is_active IS NULL) AS untried, count(*) FILTER (NOT is_active) AS failed,
        count(*) FILTER (name LIKE 'Mount %' OR name LIKE 'Mt %') AS mounts, count(*) FILTER (array_to_string(alt_names, ',') LIKE '%Province%') AS provinces FROM geo_locations GROUP BY 1, 2""")
def a17_three_states(spark, sf_dir):
    """Places by level and market in three states, and classes of names by pattern."""
    mounts = F.col("name").like("Mount %") | F.col("name").like("Mt %")
    return T(spark, sf_dir).geo_locations.groupBy("level", "market_code").agg(
        F.count("*").alias("places"), F.count_if("is_active").alias("active"), F.count_if(F.col("is_active").isNull()).alias("untried"), F.count_if(~F.col("is_active")).alias("failed"),
        F.count_if(mounts).alias("mounts"), F.count_if(F.array_join("alt_names", ",").like("%Province%")).alias("provinces"),
    )


@query("""
    WITH d AS (SELECT DISTINCT log_id, company_id, started_at, status, jobs_found FROM crawl_logs WHERE company_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY started_at DESC, log_id DESC) AS place FROM d)
    SELECT company_id, count(*) AS logs, max(started_at) FILTER (status = 'success') AS last_success, round(avg(jobs_found) FILTER (place <= 3), 6) AS last_three, sum(jobs_found)::BIGINT AS jobs FROM o GROUP BY 1""")
def a18_company_stats(spark, sf_dir):
    logs = T(spark, sf_dir).crawl_logs.where("company_id is not null").select("log_id", "company_id", "started_at", "status", "jobs_found").distinct()
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("started_at"), F.desc("log_id")))
    return logs.withColumn("place", place).groupBy("company_id").agg(
        F.count("*").alias("logs"), F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success"), F.round(F.avg(F.when(F.col("place") <= 3, F.col("jobs_found"))), 6).alias("last_three"), F.sum("jobs_found").alias("jobs"),
    )


@query("SELECT c.company_id, (SELECT count(*) FROM extracted_jobs j WHERE j.company_id = c.company_id) AS jobs, (SELECT count(*) FROM crawl_logs l WHERE l.company_id = c.company_id) AS logs FROM companies c")
def a19_rollups(spark, sf_dir):
    t = T(spark, sf_dir)
    jobs, logs = (df.groupBy("company_id").agg(F.count("*").alias(n)) for df, n in ((t.extracted_jobs, "jobs"), (t.crawl_logs, "logs")))
    return t.companies.select("company_id").join(jobs, "company_id", "left").join(logs, "company_id", "left").na.fill(0, ["jobs", "logs"])


@query("SELECT run_id, round(count(*) FILTER (status = 'done') * 100.0 / count(*), 4)::DOUBLE AS percent, round(avg(epoch(completed_at) - epoch(started_at)) FILTER (status = 'done'), 4) AS seconds, count(DISTINCT worker_id) AS workers FROM company_enrichment_rows GROUP BY 1")
def a20_progress(spark, sf_dir):
    done = F.col("status") == "done"
    seconds = F.when(done, F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))
    return T(spark, sf_dir).company_enrichment_rows.groupBy("run_id").agg(F.round(F.count_if(done) * 100.0 / F.count("*"), 4).alias("percent"), F.round(F.avg(seconds), 4).alias("seconds"), F.countDistinct("worker_id").alias("workers"))


@query("""
    WITH c AS (SELECT company_id, employment_type, count(*) AS n, min(job_id) AS seen FROM extracted_jobs WHERE coalesce(employment_type, '') <> '' GROUP BY 1, 2)
    SELECT company_id, employment_type, n FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, seen, employment_type) AS place FROM c) WHERE place = 1""")
def a21_mode(spark, sf_dir):
    return r.modal_value(T(spark, sf_dir).extracted_jobs, ["company_id"], "employment_type", "job_id")


@query("SELECT extraction_method, is_active, count(*) AS n FROM extracted_jobs GROUP BY 1, 2")
def a22_breakdown(spark, sf_dir):
    return T(spark, sf_dir).extracted_jobs.groupBy("extraction_method", "is_active").agg(F.count("*").alias("n"))


@query("""
    WITH o AS (SELECT company_id, extraction_confidence * 100 AS s, row_number() OVER (PARTITION BY company_id ORDER BY extraction_confidence) AS i, count(*) OVER (PARTITION BY company_id) AS n FROM extracted_jobs WHERE extraction_confidence IS NOT NULL),
    w AS (SELECT *, CASE WHEN (i - 1)::DOUBLE / greatest(n - 1, 1) < 0.25 THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM o)
    SELECT company_id, round(greatest(0, least(100, sum(s * w) / sum(w) - 30 * avg((s < 20)::INT))), 1) AS quality FROM w GROUP BY 1""")
def a23_site_quality(spark, sf_dir):
    scored = T(spark, sf_dir).extracted_jobs.select("company_id", (F.col("extraction_confidence") * 100).alias("s"))
    return r.weighted_quality(scored, "company_id", "s")


# ---- windows


@query("SELECT company_id, job_id FROM (SELECT company_id, job_id, row_number() OVER (PARTITION BY company_id ORDER BY last_seen_at DESC, job_id DESC) AS p FROM extracted_jobs) WHERE p <= 20")
def w1_last_twenty(spark, sf_dir):
    return r.first_per(T(spark, sf_dir).extracted_jobs.select("company_id", "job_id", "last_seen_at"), ["company_id"], [F.desc("last_seen_at"), F.desc("job_id")], 20).select("company_id", "job_id")


_FLIPS = """
    WITH d AS (SELECT DISTINCT log_id, company_id, started_at, status = 'success' AS ok FROM crawl_logs WHERE company_id IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY started_at DESC, log_id DESC) AS p FROM d),
    f AS (SELECT company_id, ok <> lag(ok) OVER (PARTITION BY company_id ORDER BY p) AS changed FROM o WHERE p <= 5)
    SELECT company_id, count(*) AS observations, coalesce(sum(changed::INT), 0)::BIGINT AS flips FROM f GROUP BY 1"""


@query(_FLIPS)
def w2_flips(spark, sf_dir):
    logs = T(spark, sf_dir).crawl_logs.where("company_id is not null").select("log_id", "company_id", "started_at", (F.col("status") == "success").alias("ok")).distinct()
    return r.flips(logs, "company_id", [F.desc("started_at"), F.desc("log_id")], "ok")


@query(f"SELECT company_id FROM ({_FLIPS}) WHERE flips >= 2")
def w3_unstable(spark, sf_dir):
    return w2_flips(spark, sf_dir).where("flips >= 2").select("company_id")


@query("SELECT source_url, min(job_id) AS job_id FROM extracted_jobs GROUP BY 1")
def w4_oldest(spark, sf_dir):
    return T(spark, sf_dir).extracted_jobs.groupBy("source_url").agg(F.min("job_id").alias("job_id"))


@query("""
    WITH p AS (SELECT run_id, row_id, created_at, row_number() OVER (PARTITION BY run_id ORDER BY row_number, row_id) AS p FROM company_enrichment_rows WHERE status <> 'done')
    SELECT run_id, row_id FROM p WHERE p <= CASE WHEN run_id % 2 = 0 THEN 2 ELSE 3 END ORDER BY created_at, row_id LIMIT 50""")
def w5_fair_claim(spark, sf_dir):
    """Each run's first rows up to its free slots, then the oldest of all."""
    open_rows = T(spark, sf_dir).company_enrichment_rows.where("status <> 'done'")
    slots = open_rows.select("run_id").distinct().withColumn("slots", F.when(F.col("run_id") % 2 == 0, 2).otherwise(3))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("row_number", "row_id"))
    claimed = open_rows.withColumn("place", place).join(slots, "run_id").where("place <= slots")
    return r.top_k(claimed, [F.asc("created_at"), F.asc("row_id")], 50).select("run_id", "row_id")


@query("SELECT employment_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM extracted_jobs GROUP BY 1")
def w6_share(spark, sf_dir):
    return r.share_of_total(T(spark, sf_dir).extracted_jobs, ["employment_type"])


@query("SELECT holdout_domain_id, max(snapshot_id) AS snapshot_id FROM gold_holdout_snapshots s WHERE snapshotted_at = (SELECT max(snapshotted_at) FROM gold_holdout_snapshots m WHERE m.holdout_domain_id = s.holdout_domain_id) GROUP BY 1")
def w7_latest_snapshot(spark, sf_dir):
    return r.latest_per(T(spark, sf_dir).gold_holdout_snapshots, ["holdout_domain_id"], "snapshotted_at", ["snapshot_id"]).select("holdout_domain_id", "snapshot_id")


# ---- orders, set operations, time series


@query("SELECT company_id, quality_score FROM companies ORDER BY quality_score DESC NULLS LAST, company_id LIMIT 40")
def t1_t2_top_nulls_last(spark, sf_dir):
    return r.top_k(T(spark, sf_dir).companies.select("company_id", "quality_score"), [F.desc_nulls_last("quality_score"), F.asc("company_id")], 40)


@query("SELECT company_id AS id, 'company' AS kind FROM companies UNION ALL SELECT geo_id, 'place' FROM geo_locations")
def t3_union(spark, sf_dir):
    t = T(spark, sf_dir)
    return t.companies.select(F.col("company_id").alias("id"), F.lit("company").alias("kind")).unionByName(t.geo_locations.select(F.col("geo_id").alias("id"), F.lit("place").alias("kind")))


@query("SELECT DISTINCT company_id, market_code FROM extracted_jobs")
def t4_distinct(spark, sf_dir):
    return T(spark, sf_dir).extracted_jobs.select("company_id", "market_code").distinct()


@query("SELECT title FROM (SELECT DISTINCT market_code, lower(trim(title)) AS title FROM extracted_jobs WHERE market_code IN ('AU', 'ID')) GROUP BY 1 HAVING count(*) = 2 ORDER BY length(title) DESC, title LIMIT 5")
def t5_common(spark, sf_dir):
    """Titles found in each of some markets, the longest first."""
    markets = ["AU", "ID"]
    pairs = T(spark, sf_dir).extracted_jobs.where(F.col("market_code").isin(markets)).select("market_code", F.lower(F.trim("title")).alias("title")).distinct()
    common = pairs.groupBy("title").agg(F.count("*").alias("n")).where(F.col("n") == len(markets))
    return r.top_k(common.select("title"), [F.desc(F.length("title")), F.asc("title")], 5)


@query("SELECT job_id, 'label' AS origin FROM labels WHERE toxic = 0 UNION ALL SELECT job_id, 'short' FROM extracted_jobs WHERE length(description) < 200 UNION ALL SELECT job_id, 'fallback' FROM extracted_jobs WHERE extraction_method = 'root_fallback'")
def t6_negatives(spark, sf_dir):
    t = T(spark, sf_dir)
    parts = [(t.labels.where("toxic = 0"), "label"), (t.extracted_jobs.where("length(description) < 200"), "short"), (t.extracted_jobs.where("extraction_method = 'root_fallback'"), "fallback")]
    out = [df.select("job_id", F.lit(n).alias("origin")) for df, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"SELECT date_trunc('day', first_seen_at) AS bucket, count(*) AS n FROM extracted_jobs WHERE first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND first_seen_at < TIMESTAMP '{AS_OF}' GROUP BY 1")
def t7_daily(spark, sf_dir):
    recent = T(spark, sf_dir).extracted_jobs.where((F.col("first_seen_at") >= now() - F.expr("INTERVAL 30 DAYS")) & (F.col("first_seen_at") < now()))
    return r.over_time(recent, "first_seen_at", "day")


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' GROUP BY 1, 2")
def t8_buckets(spark, sf_dir):
    low, high = (F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-07"))
    counts = r.over_time(T(spark, sf_dir).events.where((F.col("ts") >= low) & (F.col("ts") < high)), "ts", r.bucket_for(2880), ["event_type"])
    return counts.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"SELECT count(*) FILTER (last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week, count(*) FILTER (last_seen_at < TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY) AS two_months FROM extracted_jobs")
def t9_stale(spark, sf_dir):
    older = lambda d: F.count_if(F.col("last_seen_at") < now() - F.expr(f"INTERVAL {d} DAYS"))
    return T(spark, sf_dir).extracted_jobs.agg(older(7).alias("week"), older(60).alias("two_months"))


@query("""
    WITH o AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL UNION ALL SELECT doc_id, sha256('old') FROM documents WHERE doc_id % 3 = 1)
    SELECT doc_id, sha256(coalesce(text, '')) AS digest, CASE WHEN d IS NULL THEN 'new' WHEN d = sha256(coalesce(text, '')) THEN 'same' ELSE 'changed' END AS state FROM documents LEFT JOIN o USING (doc_id)""")
def t10_changes(spark, sf_dir):
    documents = T(spark, sf_dir).documents
    old = documents.where("doc_id % 3 = 0 and text is not null").select("doc_id", F.sha2("text", 256).alias("digest")).unionByName(documents.where("doc_id % 3 = 1").select("doc_id", F.sha2(F.lit("old"), 256).alias("digest")))
    return r.changed_content(documents, old, "doc_id", "text")
