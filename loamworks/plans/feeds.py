"""Queries of sources, sinks and streams."""

import uuid

from pyspark.sql import functions as F

from ..functions.text import flat_place
from ..functions.urls import host
from ..operators import suffixes
from ..runtime import shared_folder
from ..sinks import exports
from ..sources import files
from ..streaming import jobs as streams
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


_DOMAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':\d+$', ''), '^www\.', '')"


@query(f"""
    SELECT row_id, CASE WHEN trim(coalesce(company, '')) = '' OR coalesce(d, '') = '' THEN 'skipped' WHEN d = 'jobs-1001.example' THEN 'blocked' WHEN d IN (SELECT {_DOMAIN.format('job_page_url')} FROM company_enrichment_rows WHERE row_id % 7 = 0) THEN 'excluded' ELSE 'accepted' END AS status
    FROM (SELECT *, {_DOMAIN.format('job_page_url')} AS d FROM company_enrichment_rows)""")
def s2_routing(spark, sf_dir):
    rows = T(spark, sf_dir).company_enrichment_rows
    from ..functions.urls import normal_domain

    excluded = rows.where("row_id % 7 = 0 and job_page_url is not null").select(normal_domain(F.col("job_page_url")).alias("domain"))
    return files.routed(rows, "company", "job_page_url", excluded, ["jobs-1001.example"]).select("row_id", "status")


@query(f"SELECT d AS domain, min(job_id) AS first FROM (SELECT job_id, {_DOMAIN.format('source_url')} AS d FROM extracted_jobs) WHERE d NOT IN ('', 'domain') GROUP BY 1")
def s3_first_domains(spark, sf_dir):
    return files.first_domains(T(spark, sf_dir).extracted_jobs, "source_url", "job_id")


@query("SELECT split_part(domain, '.', 1) || '.com.' || lower(market_code) AS domain, market_code AS market, min(crawl_priority)::BIGINT AS rank FROM companies WHERE market_code IN ('AU', 'SG', 'MY', 'HK', 'PH') AND domain <> 'x' GROUP BY 1, 2")
def s6_ranked(spark, sf_dir):
    own = F.concat(F.split("domain", r"\.")[0], F.lit(".com."), F.lower("market_code"))
    companies = T(spark, sf_dir).companies.where("market_code in ('AU', 'SG', 'MY', 'HK', 'PH')")
    return files.ranked_domains(companies.withColumn("typed", own), "crawl_priority", "typed", ["x"])


@query(r"SELECT company AS name, regexp_replace(regexp_replace(lower(company), '\b(?:pty|ltd|limited|inc|co|the)\b\.?', '', 'g'), '[^a-z0-9]+', '', 'g') || '.com.au' AS domain FROM company_enrichment_rows WHERE status = 'done' AND regexp_replace(regexp_replace(lower(company), '\b(?:pty|ltd|limited|inc|co|the)\b\.?', '', 'g'), '[^a-z0-9]+', '', 'g') <> ''")
def s7_registry(spark, sf_dir):
    rows = T(spark, sf_dir).company_enrichment_rows.withColumn("state", F.when(F.col("status") == "done", "REGD").otherwise("DRGD"))
    return files.registered(rows, "company", "state")


@query("SELECT CAST(job_id AS VARCHAR) AS external_id, title, location_raw, 0.98::DOUBLE AS extraction_confidence FROM (SELECT job_id, nullif(trim(title, ' '), '') AS title, nullif(trim(location_raw, ' '), '') AS location_raw FROM extracted_jobs)")
def s13_board_jobs(spark, sf_dir):
    """Rows of landed board replies, which are built from the job table, some for each company."""
    entry = F.struct(F.col("job_id").alias("id"), "title", F.struct(F.col("location_raw").alias("name")).alias("location"))
    replies = T(spark, sf_dir).extracted_jobs.groupBy("company_id", F.pmod(F.xxhash64("job_id"), F.lit(64))).agg(F.to_json(F.struct(F.collect_list(entry).alias("jobs"))).alias("body"))
    return files.board_jobs(replies, "body", "flat").select("external_id", "title", "location_raw", "extraction_confidence")


@query("""
    SELECT board, CAST(s_suppkey AS VARCHAR) AS external_id, s_name AS title, CASE board WHEN 'content' THEN n_name || ' ' || r_name ELSE n_name END AS location_raw, confidence::DOUBLE AS confidence
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (VALUES ('postings', 0.98), ('paths', 0.95), ('openings', 0.96), ('named', 0.97), ('content', 0.96), ('requisitions', 0.93), ('search', 0.92), ('feed', 0.93), ('items', 0.90)) AS b(board, confidence)""")
def s14_boards(spark, sf_dir):
    """One table landed as the replies of nine boards, each read by its own mapping into one shape."""
    t = T(spark, sf_dir)
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key, name, nation, region = (F.col(c) for c in ("s_suppkey", "s_name", "n_name", "r_name"))
    entries = {
        "postings": F.struct(key.alias("id"), name.alias("text"), F.struct(nation.alias("location")).alias("categories")),
        "paths": F.struct(F.concat(F.lit("/job/x/"), key).alias("externalPath"), name.alias("title"), nation.alias("locationsText")),
        "openings": F.struct(key.alias("id"), name.alias("jobOpeningName"), F.struct(nation.alias("city")).alias("location")),
        "named": F.struct(key.alias("id"), name.alias("title"), nation.alias("locationName")),
        "content": F.struct(key.alias("id"), name.alias("name"), F.struct(nation.alias("city"), region.alias("country")).alias("location")),
        "requisitions": F.struct(key.alias("id"), name.alias("title"), nation.alias("location")),
        "search": F.struct(key.alias("jobId"), name.alias("title"), nation.alias("city")),
        "feed": F.struct(key.alias("ref"), name.alias("position_title"), nation.alias("suburb")),
        "items": F.struct(key.alias("ref"), name.alias("position"), nation.alias("suburb")),
    }
    out = None
    for board, entry in entries.items():
        root = files.BOARDS[board][0][0]
        reply = F.to_json(F.struct(F.collect_list(entry).alias(root))) if root else F.to_json(F.collect_list(entry))
        landed = rows.groupBy(F.pmod("s_suppkey", F.lit(16))).agg(reply.alias("body"))
        own = files.board_jobs(landed, "body", board).select(F.lit(board).alias("board"), "external_id", "title", "location_raw", F.col("extraction_confidence").alias("confidence"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT event_id, array_to_string(list_sort(map_keys(m)), ',') AS filled FROM (SELECT event_id, map_from_entries(list_filter([('event_type', event_type), ('value', CASE WHEN value > 20 THEN 'high' END)], lambda p: p[2] IS NOT NULL)) AS m FROM events)")
def s5_folded(spark, sf_dir):
    events = T(spark, sf_dir).events.select("event_id", "event_type", F.when(F.col("value") > 20, "high").alias("value"))
    return files.folded(events, ["event_id"]).select("event_id", F.array_join(F.array_sort(F.map_keys("selectors")), ",").alias("filled"))


@query(r"""
    SELECT job_id::VARCHAR AS id, coalesce(title, '') AS title, coalesce(c.name, '') AS company_name, coalesce(c.domain, '') AS company_domain, coalesce(location_raw, '') AS location_raw, '' AS location_city, coalesce(c.market_code, '') AS location_country,
        CASE WHEN regexp_matches(lower(coalesce(location_raw, '')), 'hybrid') THEN 'hybrid' WHEN regexp_matches(lower(coalesce(location_raw, '')), 'remote|work from home|wfh') THEN 'remote' ELSE '' END AS remote_type, coalesce(employment_type, '') AS employment_type,
        lower(regexp_extract(coalesce(title, ''), '(?i)\b(trainee|graduate|junior|senior|principal|lead|chief)\b', 1)) AS seniority_level, coalesce(salary_raw, '') AS salary_raw, '' AS salary_min, '' AS salary_max, '' AS salary_currency,
        coalesce(CAST(round(100 * extraction_confidence) AS INT)::VARCHAR, '') AS quality_score, coalesce(extraction_method, '') AS extraction_method, coalesce(source_url, '') AS source_url, coalesce(date_posted::VARCHAR, '') AS date_posted, coalesce(strftime(first_seen_at, '%Y-%m-%d %H:%M:%S'), '') AS first_seen_at
    FROM extracted_jobs j LEFT JOIN companies c USING (company_id)""")
def k1_export_jobs(spark, sf_dir):
    """The nineteen columns of jobs with their company's; what no table states is empty."""
    t = T(spark, sf_dir)
    company = t.companies.select("company_id", F.col("name").alias("company_name"), F.col("domain").alias("company_domain"), F.col("market_code").alias("location_country"))
    place = F.lower(F.coalesce("location_raw", F.lit("")))
    own = t.extracted_jobs.join(company, "company_id", "left").withColumnRenamed("job_id", "id").withColumns({
        "remote_type": F.when(place.contains("hybrid"), "hybrid").when(place.rlike("remote|work from home|wfh"), "remote"),
        "seniority_level": F.lower(F.regexp_extract(F.coalesce("title", F.lit("")), r"(?i)\b(trainee|graduate|junior|senior|principal|lead|chief)\b", 1)),
        "quality_score": F.round(100 * F.col("extraction_confidence")).cast("int"),
        "first_seen_at": F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss"),
    })
    return exports.exported(own, exports.JOB_COLUMNS)


_COMPANY = """
    WITH l AS (SELECT company_id, max(started_at) AS last_crawl_at, arg_max(jobs_found, struct_pack(t := started_at, k := log_id)) AS last_crawl_jobs FROM crawl_logs WHERE company_id IS NOT NULL GROUP BY 1),
    j AS (SELECT company_id, count(DISTINCT regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1)) AS site_count, count(*) FILTER (is_active) AS expected_jobs FROM extracted_jobs GROUP BY 1)"""


def _companies(spark, sf_dir):
    t = T(spark, sf_dir)
    logs = t.crawl_logs.where("company_id is not null").groupBy("company_id").agg(F.max("started_at").alias("last_crawl_at"), F.max_by("jobs_found", F.struct("started_at", "log_id")).alias("last_crawl_jobs"))
    jobs = t.extracted_jobs.groupBy("company_id").agg(F.countDistinct(F.regexp_extract("source_url", "^[a-z]+://([^/?#]+)", 1)).alias("site_count"), F.count_if("is_active").alias("expected_jobs"))
    own = t.companies.join(logs, "company_id", "left").join(jobs, "company_id", "left")
    return own.withColumns({"site_count": F.coalesce("site_count", F.lit(0)), "last_crawl_at": F.date_format("last_crawl_at", "yyyy-MM-dd HH:mm:ss")})


@query(_COMPANY + """
    SELECT company_id::VARCHAR AS company_id, name, domain, market_code, coalesce(ats_platform, '') AS ats_platform, crawl_priority::VARCHAR AS crawl_priority, coalesce(site_count, 0)::VARCHAR AS site_count, coalesce(expected_jobs::VARCHAR, '') AS expected_jobs,
        coalesce(last_crawl_jobs::VARCHAR, '') AS last_crawl_jobs, is_active::VARCHAR AS is_active, '' AS discovered_via, coalesce(strftime(last_crawl_at, '%Y-%m-%d %H:%M:%S'), '') AS last_crawl_at FROM companies LEFT JOIN l USING (company_id) LEFT JOIN j USING (company_id)""")
def k2_export_companies(spark, sf_dir):
    """The twelve columns of companies, with what their rows and crawls say of them."""
    return exports.exported(_companies(spark, sf_dir), exports.COMPANY_COLUMNS)


@query(r"""
    WITH s AS (SELECT s.*, row_number() OVER (PARTITION BY url ORDER BY snapshotted_at DESC, snapshot_id DESC) AS p, min(snapshotted_at) OVER (PARTITION BY url) AS created FROM gold_holdout_snapshots s),
    v AS (SELECT snapshot_path, CASE WHEN html LIKE '%Showing 1-%' THEN CAST(nullif(regexp_extract(html, 'Showing 1-\d+ of (\d+)', 1), '') AS INT) END AS shown, html LIKE '%<li>%' AS listed, length(html) - length(replace(html, '<script', '<scrip')) >= 3 AS shell FROM snapshot_files)
    SELECT snapshot_id::VARCHAR AS id, '' AS company_name, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS company_domain, url, CASE WHEN url LIKE '%/careers/%' THEN 'careers' ELSE 'other' END AS page_type, 'snapshot' AS discovery_method, '' AS discovery_confidence, 'true' AS is_primary,
        (shown IS NOT NULL)::VARCHAR AS is_paginated, coalesce(shell::VARCHAR, '') AS requires_js_rendering, (http_status = 200)::VARCHAR AS is_active, '' AS last_crawl_jobs, coalesce(shown::VARCHAR, '') AS expected_jobs, 'false' AS has_template, '' AS template_accuracy,
        strftime(snapshotted_at, '%Y-%m-%d %H:%M:%S') AS last_crawled_at, strftime(created, '%Y-%m-%d %H:%M:%S') AS created_at FROM s LEFT JOIN v USING (snapshot_path) WHERE p = 1""")
def k3_export_sites(spark, sf_dir):
    """The seventeen columns of sites: the newest snapshot of each address, the jobs expected from what its page says it shows."""
    t = T(spark, sf_dir)
    latest = t.gold_holdout_snapshots.groupBy("url").agg(F.max(F.struct("snapshotted_at", "snapshot_id", "snapshot_path", "http_status")).alias("s"), F.min("snapshotted_at").alias("created"))
    shown = F.when(F.contains("html", F.lit("Showing 1-")), F.nullif(F.regexp_extract("html", r"Showing 1-\d+ of (\d+)", 1), F.lit("")).cast("int"))
    pages = t.snapshot_files.select("snapshot_path", shown.alias("expected_jobs"), (F.regexp_count("html", F.lit("<script")) >= 3).alias("requires_js_rendering"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    own = latest.select("url", "s.*", "created").join(pages, "snapshot_path", "left").select(
        F.col("snapshot_id").alias("id"), host(F.col("url")).alias("company_domain"), "url", F.when(F.contains("url", F.lit("/careers/")), "careers").otherwise("other").alias("page_type"), F.lit("snapshot").alias("discovery_method"), F.lit(True).alias("is_primary"),
        F.col("expected_jobs").isNotNull().alias("is_paginated"), "requires_js_rendering", (F.col("http_status") == 200).alias("is_active"), "expected_jobs", F.lit(False).alias("has_template"), time("snapshotted_at").alias("last_crawled_at"), time("created").alias("created_at"),
    )
    return exports.exported(own, exports.SITE_COLUMNS)


@query("""
    WITH h AS (SELECT DISTINCT regexp_extract(source_url, '^[a-z]+://([^/?#]+)', 1) AS host FROM extracted_jobs UNION SELECT 'www.jobs.' || domain FROM companies UNION SELECT 'x.y.' || domain FROM companies UNION SELECT substr(domain, 4) FROM companies),
    p AS (SELECT host, regexp_replace(lower(host), '^[w.]+', '') AS d FROM h), k AS (SELECT DISTINCT domain AS known FROM companies),
    m AS (SELECT host, known, CASE WHEN known = d THEN 0 WHEN known = substr(d, instr(d, '.') + 1) AND d LIKE '%.%' THEN 1 WHEN d LIKE '%.%.%' AND known = array_to_string(string_split(d, '.')[3:], '.') THEN 2 WHEN suffix(d, known) OR suffix(known, d) THEN 3 END AS rank FROM p, k WHERE d <> '')
    SELECT host, m.known, CAST(m.rank AS INT) AS rank FROM (SELECT host, arg_min(struct_pack(known := known, rank := rank), struct_pack(r := rank, k := known)) AS m FROM m WHERE rank IS NOT NULL GROUP BY 1)""")
def j18_known_hosts(spark, sf_dir):
    """The company whose host each host stands below or beside: exact, parents, then any common ending."""
    t = T(spark, sf_dir)
    domain = t.companies.select("domain")
    typed = [F.concat(F.lit("www.jobs."), "domain"), F.concat(F.lit("x.y."), "domain"), F.substring("domain", F.lit(4), F.length("domain"))]
    hosts = t.extracted_jobs.select(host(F.col("source_url")).alias("host"))
    for x in typed:
        hosts = hosts.unionByName(domain.select(x.alias("host")))
    return suffixes.known_host(hosts, domain.withColumnRenamed("domain", "known"))


_PLACES = """SELECT g.geo_id, g.name AS city, p.name AS region, g.country_code AS country, g.geo_id % 4 AS k FROM geo_locations g LEFT JOIN geo_locations p ON g.parent_id = p.geo_id"""


@query(f"""SELECT geo_id, CASE k WHEN 0 THEN concat_ws(', ', city, region, country) WHEN 1 THEN city WHEN 2 THEN concat_ws(', ', city, country) || ', ' || coalesce(region, 'Elsewhere') ELSE city END AS place FROM ({_PLACES})""")
def x28_flat_places(spark, sf_dir):
    """Places written as structured markup in four shapes (address, name only, a list, plain text), as text again."""
    geo = T(spark, sf_dir).geo_locations
    parents = geo.select(F.col("geo_id").alias("parent_id"), F.col("name").alias("region"))
    own = geo.select("geo_id", F.col("name").alias("city"), "parent_id", F.col("country_code").alias("country")).join(parents, "parent_id", "left")
    address = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    shapes = [
        F.to_json(F.struct(F.lit("Place").alias("type"), address(addressLocality=F.col("city"), addressRegion=F.col("region"), addressCountry=F.col("country")).alias("address"))),
        F.to_json(F.struct(F.col("city").alias("name"), F.struct(F.lit("").alias("addressLocality")).alias("address"))),
        F.concat(F.lit("["), F.to_json(F.struct(address(addressLocality=F.col("city"), addressCountry=F.col("country")).alias("address"))), F.lit(","), F.to_json(F.struct(F.coalesce("region", F.lit("Elsewhere")).alias("name"))), F.lit("]")),
        F.col("city"),
    ]
    written = F.element_at(F.array(*shapes), (F.pmod("geo_id", F.lit(4)) + 1).cast("int"))
    return own.select("geo_id", flat_place(written).alias("place"))


@query("SELECT job_id, CASE WHEN extraction_confidence >= 0.8 THEN coalesce(salary_raw, '') ELSE '' END AS salary_raw, CAST(CAST(round(CAST(CAST(coalesce(extraction_confidence, 0) AS VARCHAR) AS DECIMAL(28, 18)), 2) AS DECIMAL(20, 2)) AS VARCHAR) AS confidence FROM extracted_jobs")
def k4_confident_only(spark, sf_dir):
    jobs = T(spark, sf_dir).extracted_jobs
    shown = exports.blank_unless(jobs, F.col("extraction_confidence") >= 0.8, ["salary_raw"])
    # Half up on the decimal digits of the value, not on its binary fraction.
    hundredths = F.round(F.coalesce("extraction_confidence", F.lit(0.0)).cast("string").cast("decimal(28,18)"), 2)
    return shown.select("job_id", "salary_raw", hundredths.cast("decimal(20,2)").cast("string").alias("confidence"))


@query("SELECT row_id, coalesce(nullif(trim(job_page_url), ''), 'not found') AS job_page_url, coalesce(nullif(trim(comment), ''), 'not found') AS comment FROM company_enrichment_rows")
def k5_defaults(spark, sf_dir):
    return exports.defaulted(T(spark, sf_dir).company_enrichment_rows, ["job_page_url", "comment"]).select("row_id", "job_page_url", "comment")


@query("SELECT stratum, metric, value FROM (SELECT market_code AS stratum, round(avg(extraction_confidence), 6) AS confidence, count(*)::DOUBLE AS jobs FROM extracted_jobs GROUP BY 1) UNPIVOT (value FOR metric IN (confidence, jobs))")
def k7_long_metrics(spark, sf_dir):
    wide = T(spark, sf_dir).extracted_jobs.groupBy("market_code").agg(F.round(F.avg("extraction_confidence"), 6).alias("confidence"), F.count("*").alias("jobs"))
    return exports.long_metrics(wide, "market_code", ["confidence", "jobs"])


@query("SELECT count(*) AS links FROM gold_holdout_snapshots WHERE regexp_extract(url, '^[a-z]+://([^/]+)', 1) <> 'holdout-1.example'")
def s15_outbound(spark, sf_dir):
    rows = T(spark, sf_dir).gold_holdout_snapshots
    return files.outbound(rows, ["holdout-1.example"], host(F.col("url"))).agg(F.count("*").alias("links"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS largest FROM events GROUP BY 1, 2")
def z6_hourly(spark, sf_dir):
    hours = streams.hourly(T(spark, sf_dir).events, "ts", "event_type", "value")
    return hours.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""
    WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS new FROM events),
    s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def z_sessions(spark, sf_dir):
    runs = streams.sessions(T(spark, sf_dir).events, "ts", "user_id")
    return runs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT company_id, max(started_at) AS last_seen FROM crawl_logs WHERE company_id IS NOT NULL GROUP BY 1 HAVING max(started_at) < TIMESTAMP '2025-09-01' - INTERVAL 7 DAY")
def z8_gone(spark, sf_dir):
    return streams.gone(T(spark, sf_dir).crawl_logs.where("company_id is not null"), "company_id", "started_at", F.lit("2025-09-01").cast("timestamp"))


@query("SELECT row_id AS id FROM company_enrichment_rows WHERE status = 'error' ORDER BY attempt_count DESC, created_at, row_id LIMIT 20")
def z2_claim(spark, sf_dir):
    queue = T(spark, sf_dir).company_enrichment_rows.select(F.col("row_id").alias("id"), F.when(F.col("status") == "error", "pending").otherwise("done").alias("status"), F.col("attempt_count").alias("priority"), F.col("created_at").alias("added_at"))
    return streams.claim_order(queue, 20).select("id")


@query("SELECT user_id AS key, max(value) AS best FROM events GROUP BY 1")
def z7_ratchet(spark, sf_dir):
    """The best value of each key, kept by a stream of micro-batches over the landed files."""
    folder = f"{shared_folder(spark)}/ratchet-{uuid.uuid4().hex}"
    best = lambda batch: batch.groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("best"))
    ratchet = streams.Ratchet(f"{folder}/table", ["key"], {"best": "max"}, best)
    like = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(like).schema).option("pathGlobFilter", "*.parquet").parquet(_glob(like))
    streams.run_available(stream, ratchet, f"{folder}/offsets")
    return ratchet.table(spark)


def _glob(path: str) -> str:
    """A file's folder pattern; a stream reads folders, or a pattern of files."""
    return path.replace("events.parquet", "event[s].parquet")


@query("SELECT coalesce(company_id, -1)::VARCHAR || '/' || crawl_type AS key, count(*) AS attempts, count(*) FILTER (status = 'success') AS successes FROM crawl_logs WHERE started_at >= TIMESTAMP '2025-08-18' GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (status = 'success') < 0.6 * count(*)")
def h13_skipped(spark, sf_dir):
    """Keys whose costly layers are skipped: attempts of the last fourteen days, too few of which succeeded."""
    logs = T(spark, sf_dir).crawl_logs.withColumn("key", F.concat_ws("/", F.coalesce("company_id", F.lit(-1)), "crawl_type"))
    return streams.skip_layers(streams.counted_attempts(logs, "key", F.col("status") == "success", "started_at", F.lit("2025-09-01").cast("timestamp")), 3, 0.6)


@query("SELECT company_id, least(best, 20) AS depth, CASE WHEN best >= 200 THEN 4 WHEN best <= 20 THEN 2 ELSE 3 END AS workers FROM (SELECT company_id, max(jobs_found) AS best FROM crawl_logs GROUP BY 1)")
def z12_workers(spark, sf_dir):
    """Workers after one step of balancing, from three, by what waits."""
    depth = T(spark, sf_dir).crawl_logs.groupBy("company_id").agg(F.max("jobs_found").alias("best"))
    return depth.select("company_id", F.least("best", F.lit(20)).alias("depth"), streams.worker_change(F.col("best"), F.lit(3)).alias("workers"))


@query("SELECT url, content_hash, count(*) AS times FROM gold_holdout_snapshots GROUP BY 1, 2")
def z10_contents(spark, sf_dir):
    """Each content of each address once, with how often it came."""
    rows = T(spark, sf_dir).gold_holdout_snapshots
    once = streams.unseen(rows, "snapshotted_at", ["url", "content_hash"]).select("url", "content_hash")
    return once.join(rows.groupBy("url", "content_hash").agg(F.count("*").alias("times")), ["url", "content_hash"])


@query("SELECT row_id::VARCHAR AS row_id, company, country FROM company_enrichment_rows")
def s1_csv_rows(spark, sf_dir):
    """Rows written as CSV with a byte order mark before the header and read again; columns that are not asked for are left out."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    rows = T(spark, sf_dir).company_enrichment_rows.select(F.col("row_id").alias(files.BOM + " Row_ID"), "company", F.col("country").alias("country "), F.col("status").alias("other"))
    exports.write_csv(rows, folder)
    return files.csv_rows(spark, folder, ["row_id", "company"], ["row_id", "company", "country"])


@query("""
    WITH r AS (SELECT row_id, trim(company, ' ') AS company, trim(country, ' ') AS country FROM company_enrichment_rows WHERE trim(coalesce(company, ''), ' ') <> ''), c AS (SELECT lower(company) AS k, lower(country) AS l, max(completed_at) AS seen FROM company_enrichment_rows WHERE status = 'done' AND company = trim(company, ' ') AND country = trim(country, ' ') GROUP BY 1, 2)
    SELECT row_id, r.company, r.country, CASE WHEN c.seen >= TIMESTAMP '2025-08-01' THEN 'done' ELSE 'pending' END AS status FROM r LEFT JOIN c ON lower(r.company) = c.k AND lower(r.country) = c.l""")
def s4_enrichment(spark, sf_dir):
    """Rows of an uploaded list; those done before and recently enough are not done again."""
    rows = T(spark, sf_dir).company_enrichment_rows
    done = rows.where("status = 'done' and company = trim(company) and country = trim(country)").select("company", "country", "completed_at")
    return files.queued(rows.select("row_id", "company", "country"), done, "completed_at", F.lit("2025-08-01").cast("timestamp"))


@query("SELECT geo_id AS id, name, ascii_name, coalesce(alt_names, []) AS alt_names, lat, lng, country_code AS country, population FROM geo_locations WHERE level > 1")
def s9_gazetteer(spark, sf_dir):
    """Places written in the layout of a public gazetteer and read again."""
    folder = f"{shared_folder(spark)}/gazetteer-{uuid.uuid4().hex}"
    geo = T(spark, sf_dir).geo_locations
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind, code = F.when(F.col("level") == 2, "A").otherwise("P"), F.when(F.col("level") == 1, "OTHER").when(F.col("level") == 2, "ADM1").otherwise("PPL")
    fields = [text("geo_id"), text("name"), text("ascii_name"), F.coalesce(F.array_join("alt_names", ","), F.lit("")), text("lat"), text("lng"), kind, code, text("country_code"), F.lit(""), F.lit("01"), F.lit(""), F.lit(""), F.lit(""), text("population"), *[F.lit("")] * 4]
    geo.select(F.concat_ws("\t", *fields).alias("value")).write.text(folder)
    return files.gazetteer_rows(spark, folder).select("id", "name", "ascii_name", "alt_names", "lat", "lng", "country", "population")
