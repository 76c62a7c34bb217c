"""Queries of merging, deduplication and place lookup."""

from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text as tx
from ..functions.urls import registrable_domain
from ..operators import dedup, geocode, merge
from .analytics import T

QUERIES: dict = {}
SQL: dict[str, str] = {}
FIELDS = ["title", "location_raw", "employment_type", "salary_raw"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TRUST = "CASE extraction_method " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in merge.METHOD_TRUST.items()) + " ELSE {} END"


def _trusted(field: str) -> str:
    w = merge.FIELD_WEIGHTS[field]
    return f"CASE WHEN count({field}) > 0 THEN {w} * (CASE WHEN count({field}) > 1 THEN 1 - (count(DISTINCT {field}) - 1)::DOUBLE / count({field}) ELSE 0.8 END) * arg_max(t3, o) FILTER ({field} IS NOT NULL) / 10 ELSE 0 END"


@query("SELECT job_id, CASE WHEN coalesce(external_id, '') <> '' THEN 'external_id:' || external_id WHEN coalesce(source_url, '') <> '' THEN 'source_url:' || source_url ELSE 'title:' || title END AS k FROM extracted_jobs")
def m1_group_key(spark, sf_dir):
    return T(spark, sf_dir).extracted_jobs.select("job_id", merge.group_key("external_id", "source_url", "title").alias("k"))


@query(f"""
    WITH r AS (SELECT *, {_TRUST.format(0)} * 1000000000000::BIGINT - job_id AS o, {_TRUST.format(3)} AS t3 FROM extracted_jobs)
    SELECT company_id, {', '.join(f'arg_max({f}, o) FILTER ({f} IS NOT NULL) AS {f}' for f in FIELDS)}, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE arg_max(extraction_method, o) END AS method, count(*) AS records,
        round(least(0.99, ({' + '.join(_trusted(f) for f in FIELDS)}) / ({' + '.join(f'CASE WHEN count({f}) > 0 THEN {merge.FIELD_WEIGHTS[f]} ELSE 0 END' for f in FIELDS)})), 6) AS confidence
    FROM r GROUP BY 1""")
def m2_trust_merge(spark, sf_dir):
    return merge.trust_merge(T(spark, sf_dir).extracted_jobs, ["company_id"], "extraction_method", FIELDS, "job_id")


def _agree(f: str) -> str:
    w, half = merge.FIELD_WEIGHTS[f], 0.5 if f == "salary_raw" else 0.0
    return f"CASE WHEN j.{f} IS NULL OR f.{f} IS NULL THEN 0 WHEN lower(trim(j.{f})) = lower(trim(f.{f})) THEN {w} ELSE {w * half} END"


@query(f"""
    WITH f AS (SELECT * FROM extracted_jobs WHERE job_id IN (SELECT min(job_id) FROM extracted_jobs GROUP BY company_id))
    SELECT j.job_id, round(coalesce(({' + '.join(_agree(f) for f in FIELDS)})::DOUBLE / nullif({' + '.join(f'CASE WHEN j.{f} IS NULL AND f.{f} IS NULL THEN 0 ELSE {merge.FIELD_WEIGHTS[f]} END' for f in FIELDS)}, 0), 1.0), 6) AS agreement
    FROM extracted_jobs j JOIN f USING (company_id)""")
def m3_agreement(spark, sf_dir):
    jobs = T(spark, sf_dir).extracted_jobs
    weights = {f: merge.FIELD_WEIGHTS[f] for f in FIELDS}
    first = jobs.groupBy("company_id").agg(F.min_by(F.struct(*FIELDS), "job_id").alias("b"))
    return jobs.select("job_id", "company_id", F.struct(*FIELDS).alias("a")).join(first, "company_id").select("job_id", F.round(merge.agreement("a", "b", weights), 6).alias("agreement"))


@query(f"""
    WITH p AS (SELECT *, {_TRUST.format(0)} AS p, max({_TRUST.format(0)}) OVER (PARTITION BY company_id) AS top FROM extracted_jobs)
    SELECT company_id, arg_min(title, job_id) FILTER (coalesce(title, '') <> '') AS title, arg_min(salary_raw, job_id) FILTER (coalesce(salary_raw, '') <> '') AS salary_raw, count(*) AS records FROM p WHERE p = top GROUP BY 1""")
def m4_keep_best(spark, sf_dir):
    priority = merge.ladder(F.col("extraction_method"), merge.METHOD_TRUST, 0)
    return merge.keep_best(T(spark, sf_dir).extracted_jobs, ["company_id"], priority, ["title", "salary_raw"], "job_id")


@query("SELECT job_id, coalesce(nullif(trim(location_raw), ''), market_code) AS location_raw, coalesce(nullif(trim(employment_type), ''), 'unknown') AS employment_type FROM extracted_jobs")
def m5_fill_blank(spark, sf_dir):
    return merge.fill_blank(T(spark, sf_dir).extracted_jobs.select("job_id", "location_raw", "employment_type", "market_code"), {"location_raw": F.col("market_code"), "employment_type": F.lit("unknown")}).drop("market_code")


@query("""
    WITH o AS (SELECT company_id, max(jobs_found) AS best, min(started_at) AS first_at, arg_min(status, log_id) AS state FROM crawl_logs WHERE company_id IS NOT NULL AND started_at < TIMESTAMP '2025-06-01' GROUP BY 1),
    n AS (SELECT company_id, max(jobs_found) AS best, min(started_at) AS first_at, arg_min(status, log_id) AS state FROM crawl_logs WHERE company_id IS NOT NULL AND started_at >= TIMESTAMP '2025-06-01' GROUP BY 1)
    SELECT coalesce(o.company_id, n.company_id) AS company_id, greatest(o.best, n.best) AS best, least(o.first_at, n.first_at) AS first_at, CASE WHEN n.company_id IS NOT NULL THEN n.state ELSE o.state END AS state FROM o FULL JOIN n ON o.company_id = n.company_id""")
def k6_upsert(spark, sf_dir):
    logs = T(spark, sf_dir).crawl_logs.where("company_id is not null")
    cut = F.lit("2025-06-01").cast("timestamp")
    half = lambda rows: rows.groupBy("company_id").agg(F.max("jobs_found").alias("best"), F.min("started_at").alias("first_at"), F.min_by("status", "log_id").alias("state"))
    return merge.upsert(half(logs.where(F.col("started_at") < cut)), half(logs.where(F.col("started_at") >= cut)), ["company_id"], {"best": "max", "first_at": "min", "state": "new"})


def _pairs(spark, sf_dir):
    return dedup.linked_pairs(dedup.prepared(T(spark, sf_dir).extracted_jobs))


@query()
def d1_linked_pairs(spark, sf_dir):
    """Pairs of one company's rows that the pair rule links, rows alike in all it reads as one; checked against all pairs in the tests."""
    return _pairs(spark, sf_dir)


@query()
def d2_groups(spark, sf_dir):
    """The least id of each row's group, and its links."""
    rows = dedup.prepared(T(spark, sf_dir).extracted_jobs)
    return dedup.grouped(rows, dedup.linked_pairs(rows))


@query()
def d4_canonical(spark, sf_dir):
    """Each grouped row's best row and its number of duplicates."""
    return dedup.canonical(T(spark, sf_dir).extracted_jobs, d2_groups(spark, sf_dir).select("id", "group"))


@query("""
    SELECT CASE WHEN source_url LIKE '%-freight-%' THEN 'freight' WHEN source_url LIKE '%-foods-%' THEN 'foods' ELSE 'other' END AS label, count(*) AS n FROM extracted_jobs WHERE description IS NULL OR extraction_confidence < 0.5 GROUP BY 1""")
def d5_failure_clusters(spark, sf_dir):
    failed = T(spark, sf_dir).extracted_jobs.where("description is null or extraction_confidence < 0.5")
    label = F.when(F.col("source_url").contains("-freight-"), "freight").when(F.col("source_url").contains("-foods-"), "foods").otherwise("other")
    return failed.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


_ACCENTS = "'áàâäãåāéèêëēíìîïīóòôöõōúùûüūñç', 'aaaaaaaeeeeeiiiiioooooouuuuunc'"
_PLACE = lambda c: f"trim(regexp_replace(regexp_replace(translate(lower(trim({c}, ' ')), {_ACCENTS}), '\\s*[/|;>,]+\\s*', ',', 'g'), '\\s+', ' ', 'g'), ', ')"
_NAMES = f"SELECT DISTINCT geo_id, level, market_code, population, {_PLACE('n')} AS place FROM (SELECT *, unnest([name, ascii_name] || coalesce(alt_names, [])) AS n FROM geo_locations) WHERE n IS NOT NULL"
_TERMS = f"SELECT location_raw, market_code, unnest(range(len(p))) AS position, trim(unnest(p), ' ') AS place FROM (SELECT DISTINCT location_raw, market_code, list_filter(list_transform(string_split({_PLACE('location_raw')}, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM extracted_jobs WHERE location_raw IS NOT NULL)"
_EXACT = f"""SELECT location_raw, market_code, geo_id FROM (SELECT *, row_number() OVER (PARTITION BY location_raw, market_code ORDER BY position, level DESC, population DESC NULLS LAST, geo_id) AS n
    FROM ({_TERMS}) JOIN ({_NAMES}) USING (place, market_code)) WHERE n = 1"""


@query(_EXACT)
def g2_exact(spark, sf_dir):
    t = T(spark, sf_dir)
    return geocode.exact(t.extracted_jobs, t.geo_locations)


@query()
def g3_similar(spark, sf_dir):
    """The most similar names by letter triples; checked against all pairs in the tests."""
    t = T(spark, sf_dir)
    return geocode.similar(t.extracted_jobs, t.geo_locations)


@query()
def g1_ladder(spark, sf_dir):
    """Values placed by the ladder's steps."""
    t = T(spark, sf_dir)
    # What was placed before: the values of rows that are no longer active.
    cache = geocode.exact(t.extracted_jobs.where("not is_active"), t.geo_locations)
    return geocode.ladder(t.extracted_jobs, t.geo_locations, cache).groupBy("step").agg(F.count("*").alias("places"))


@query("""
    WITH f AS (SELECT geo_id AS id, CASE level WHEN 1 THEN 'PCLI' WHEN 2 THEN 'ADM1' ELSE 'PPL' END AS code, CASE WHEN level = 2 THEN geo_id WHEN level = 3 THEN parent_id END AS admin, name, population FROM geo_locations WHERE market_code = 'AU'),
    l AS (SELECT *, CASE WHEN code = 'PCLI' THEN 1 WHEN code = 'ADM1' THEN 2 WHEN population >= 15000 THEN 3 ELSE 4 END AS level FROM f)
    SELECT l.id, l.name, l.level, CASE WHEN l.level = 1 THEN NULL WHEN l.level = 2 THEN c.id ELSE coalesce(s.id, c.id) END AS parent_id FROM l LEFT JOIN l s ON s.level = 2 AND s.admin = l.admin LEFT JOIN l c ON c.level = 1""")
def g4_seed_levels(spark, sf_dir):
    geo = T(spark, sf_dir).geo_locations.where("market_code = 'AU'")
    code = F.when(F.col("level") == 1, "PCLI").when(F.col("level") == 2, "ADM1").otherwise("PPL")
    admin = F.when(F.col("level") == 2, F.col("geo_id")).when(F.col("level") == 3, F.col("parent_id"))
    return geocode.seeded(geo.select(F.col("geo_id").alias("id"), code.alias("code"), admin.alias("admin"), "name", "population"))


@query("SELECT job_id, CASE WHEN location_raw IS NULL OR trim(location_raw) IN ('', '-') THEN market_code ELSE location_raw END AS asked FROM extracted_jobs")
def g5_fallback_text(spark, sf_dir):
    blank = F.col("location_raw").isNull() | F.trim("location_raw").isin("", "-")
    return T(spark, sf_dir).extracted_jobs.select("job_id", F.when(blank, F.col("market_code")).otherwise(F.col("location_raw")).alias("asked"))


@query("SELECT geo_id FROM geo_locations WHERE is_active IS DISTINCT FROM true OR (level = 1 AND population IS NULL)")
def g6_reset(spark, sf_dir):
    return T(spark, sf_dir).geo_locations.where(~F.col("is_active").eqNullSafe(F.lit(True)) | ((F.col("level") == 1) & F.col("population").isNull())).select("geo_id")


def split_bucket(domain, seed: int = 42):
    """A stable number from 0 to 999 of a domain."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), domain), 256), 1, 15), 16, 10).cast("long"), F.lit(1000))


@query(r"""
    WITH d AS (SELECT job_id, array_to_string(string_split(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '.')[-2:], '.') AS domain FROM extracted_jobs),
    b AS (SELECT *, CAST('0x' || sha256('42:' || domain)[1:15] AS BIGINT) % 1000 AS b FROM d)
    SELECT job_id, domain, CASE WHEN domain = '' THEN 'test' WHEN b < 700 THEN 'train' WHEN b < 850 THEN 'validation' ELSE 'test' END AS split FROM b""")
def e16_split(spark, sf_dir):
    """All rows of a domain in one split; rows without a domain in the test split."""
    own = T(spark, sf_dir).extracted_jobs.select("job_id", registrable_domain(F.col("source_url")).alias("domain"))
    b = split_bucket(F.col("domain"))
    return own.withColumn("split", F.when(F.col("domain") == "", "test").when(b < 700, "train").when(b < 850, "validation").otherwise("test"))


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT domain FROM companies) c JOIN (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS domain FROM gold_holdout_snapshots) USING (domain)")
def e17_isolation(spark, sf_dir):
    """Domains that stand in both the corpus and the holdout: none."""
    t = T(spark, sf_dir)
    corpus = t.companies.select(registrable_domain(F.col("root_url")).alias("domain")).distinct()
    holdout = t.gold_holdout_snapshots.select(registrable_domain(F.col("url")).alias("domain")).distinct()
    return corpus.join(holdout, "domain", "left_semi").agg(F.count("*").alias("shared"))


@query("SELECT DISTINCT job_id, title FROM extracted_jobs WHERE job_id IN (SELECT min(job_id) FROM extracted_jobs GROUP BY source_url)")
def m6_admitted(spark, sf_dir):
    """One row a URL: the first."""
    jobs = T(spark, sf_dir).extracted_jobs
    return jobs.groupBy("source_url").agg(F.min("job_id").alias("job_id"), F.min_by("title", "job_id").alias("title")).drop("source_url")


@query(f"SELECT job_id, {_PLACE('location_raw')} AS place FROM extracted_jobs")
def x24_normal_place(spark, sf_dir):
    return T(spark, sf_dir).extracted_jobs.select("job_id", geocode.normal_place(F.col("location_raw")).alias("place"))


@query(rf"""
    WITH j AS (SELECT job_id, lower(trim(coalesce(title, ''), ' ')) AS t, lower(coalesce(source_url, '')) AS u FROM extracted_jobs)
    SELECT job_id, length(t) >= 5 AND NOT regexp_matches(t, '{'|'.join(q.NOT_JOBS)}') AND (list_has_any(regexp_split_to_array(t, '[\s/,\-–—()]+'), {q.JOB_NOUNS}) OR regexp_matches(u, '{q.JOB_ADDRESS}')) AS real FROM j""")
def x27_real_jobs(spark, sf_dir):
    jobs = T(spark, sf_dir).extracted_jobs
    return jobs.select("job_id", q.is_real_job(F.col("title"), F.col("source_url")).alias("real"))
