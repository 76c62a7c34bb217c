"""Queries of evaluation and statistics."""

from pyspark.sql import functions as F

from ..operators import composite, merge
from ..operators import relational as r
from ..operators import statistics as st
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


_SITE = "SELECT company_id, count(*) FILTER (crawl_type = 'verification') AS base, count(*) FILTER (crawl_type = 'extraction') AS model FROM crawl_logs WHERE company_id IS NOT NULL GROUP BY 1"
_MATCH = "CASE WHEN base = 0 AND model = 0 THEN 'both_failed' WHEN model = 0 THEN 'model_failed' WHEN base = 0 THEN 'model_only' WHEN model::DOUBLE / base >= 0.9 THEN 'equal_or_better' WHEN model::DOUBLE / base >= 0.5 THEN 'partial' ELSE 'worse' END"


def _sites(spark, sf_dir):
    logs = T(spark, sf_dir).crawl_logs.where("company_id is not null")
    return logs.groupBy("company_id").agg(F.count_if(F.col("crawl_type") == "verification").alias("base"), F.count_if(F.col("crawl_type") == "extraction").alias("model"))


def match_kind(base, model):
    """How a model's count compares to a baseline's."""
    share = model / F.nullif(base, F.lit(0))
    return F.when((base == 0) & (model == 0), "both_failed").when(model == 0, "model_failed").when(base == 0, "model_only").when(share >= 0.9, "equal_or_better").when(share >= 0.5, "partial").otherwise("worse")


@query(f"SELECT {_MATCH} AS kind, count(*) AS sites FROM ({_SITE}) GROUP BY 1")
def e1_match(spark, sf_dir):
    return _sites(spark, sf_dir).groupBy(match_kind(F.col("base"), F.col("model")).alias("kind")).agg(F.count("*").alias("sites"))


@query("SELECT extraction_method, count(*) AS jobs, " + ", ".join(f"count(*) FILTER (trim(coalesce({c}, ''), ' ') <> '') AS with_{c}" for c in composite.CORE_FIELDS) + ", count(*) FILTER (trim(coalesce(title, ''), ' ') <> '' AND trim(coalesce(source_url, ''), ' ') <> '' AND trim(coalesce(location_raw, ''), ' ') <> '') AS core FROM extracted_jobs GROUP BY 1")
def e2_field_coverage(spark, sf_dir):
    """Rows with each of six fields, and with the three core ones."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    core = has("title") & has("source_url") & has("location_raw")
    return T(spark, sf_dir).extracted_jobs.groupBy("extraction_method").agg(F.count("*").alias("jobs"), *(F.count_if(has(c)).alias(f"with_{c}") for c in composite.CORE_FIELDS), F.count_if(core).alias("core"))


#: Site results of two sides: ``old`` are a company's active rows, ``new`` those of good confidence; ``base`` is what its crawls found at most.
_FILLED = " + ".join(f"(trim(coalesce({c}, ''), ' ') <> '')::INT" for c in composite.CORE_FIELDS)
_RESULTS = f"""
    WITH j AS (SELECT company_id, is_active AS old, extraction_confidence >= 0.5 AS new, {_FILLED} AS filled FROM extracted_jobs),
    s AS (SELECT company_id, count(*) FILTER (old) AS old_jobs, count(*) FILTER (new) AS new_jobs, sum(filled) FILTER (old) AS old_filled, sum(filled) FILTER (new) AS new_filled FROM j GROUP BY 1),
    l AS (SELECT company_id, max(jobs_found) AS base, (arg_max(struct_pack(e := error_message), struct_pack(t := started_at, k := log_id))).e IS NOT NULL AS failed FROM crawl_logs WHERE company_id IS NOT NULL GROUP BY 1),
    r AS (SELECT company_id, ats_platform, root_url, root_url IS NOT NULL AS found, coalesce(failed, false) AS failed, coalesce(quality_score < 30, false) AS warned, coalesce(base, 0) AS base, coalesce(old_jobs, 0) AS old_jobs, coalesce(new_jobs, 0) AS new_jobs, coalesce(old_filled, 0) AS old_filled,
        coalesce(new_filled, 0) AS new_filled FROM companies LEFT JOIN s USING (company_id) LEFT JOIN l USING (company_id)),
    t AS (SELECT *, CASE WHEN lower(trim(coalesce(ats_platform, ''))) NOT IN ('', 'none', 'null', 'unknown') THEN lower(trim(ats_platform)) {' '.join(f"WHEN root_url LIKE '%{n}%' THEN '{v}'" for n, v in composite.NEEDLES.items())} WHEN root_url LIKE '%nuxt%' THEN 'spa_shell' WHEN root_url LIKE '%drupal%' THEN 'generic_cms' ELSE 'bespoke' END AS stratum FROM r)"""


def _card_sql(side: str, key: str) -> str:
    """The scorecard of one side by a key, in SQL."""
    axis = "least(100, greatest(0, {}))"
    ratio = f"(sum({side}_jobs)::DOUBLE / sum(base))"
    axes = {
        "discovery": axis.format("count(*) FILTER (found AND NOT failed)::DOUBLE / count(*) * 100"),
        "quality_extraction": axis.format(f"(count(*) FILTER ({side}_jobs > 0) - count(*) FILTER (warned))::DOUBLE / count(*) * 100"),
        "field_completeness": axis.format(f"sum({side}_filled)::DOUBLE / greatest(1, sum({side}_jobs) * 6) * 100"),
        "volume_accuracy": f"CASE WHEN sum(base) = 0 THEN CASE WHEN sum({side}_jobs) > 0 THEN 50.0 ELSE 0.0 END WHEN {ratio} >= 1 THEN greatest(0, least(100, 100 - greatest(0, ({ratio} - 1.5) * 100))) ELSE 100 * {ratio} END",
    }
    total = " + ".join(f"{w} * ({axes[k]})" for k, w in composite.WEIGHTS.items())
    return f"SELECT {key} AS stratum, count(*) AS n, round(({total})::DOUBLE, 1) AS composite, " + ", ".join(f"round(({a})::DOUBLE, 1) AS {k}" for k, a in axes.items()) + " FROM t GROUP BY 1"


def _results(spark, sf_dir, side: str):
    t = T(spark, sf_dir)
    filled = sum((F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 1).otherwise(0) for c in composite.CORE_FIELDS), F.lit(0))
    kept = t.extracted_jobs.where("is_active" if side == "old" else "extraction_confidence >= 0.5")
    jobs = kept.groupBy("company_id").agg(F.count("*").alias("jobs"), F.sum(filled).alias("filled"))
    logs = t.crawl_logs.where("company_id is not null").groupBy("company_id").agg(F.max("jobs_found").alias("base"), F.max_by(F.struct("error_message"), F.struct("started_at", "log_id")).alias("last"))
    own = t.companies.join(jobs, "company_id", "left").join(logs, "company_id", "left")
    tagged = composite.stratum(F.col("ats_platform"), F.col("root_url"))
    return own.select("company_id", tagged.alias("stratum"), F.col("root_url").isNotNull().alias("found"), F.col("last.error_message").isNotNull().alias("failed"), (F.col("quality_score") < 30).alias("warned"), "jobs", "filled", "base")


@query(_RESULTS + " " + _card_sql("new", "'all'"))
def e3_composite(spark, sf_dir):
    """Four axes and their composite over all sites."""
    return composite.scorecard(_results(spark, sf_dir, "new").withColumn("stratum", F.lit("all")), ["stratum"])


@query(_RESULTS + " SELECT stratum, count(*) AS companies FROM t GROUP BY 1")
def e4_stratum(spark, sf_dir):
    return _results(spark, sf_dir, "new").groupBy("stratum").agg(F.count("*").alias("companies"))


@query(_RESULTS + f" SELECT *, n >= 3 AS eligible FROM ({_card_sql('new', 'stratum')})")
def e5_by_stratum(spark, sf_dir):
    return composite.scorecard(_results(spark, sf_dir, "new"), ["stratum"]).withColumn("eligible", F.col("n") >= composite.LEAST_SITES)


_GATE = f"{_RESULTS}, a AS ({_card_sql('old', 'stratum')}), b AS ({_card_sql('new', 'stratum')}), c AS (SELECT a.stratum, a.composite AS champion, coalesce(b.composite, 0) AS challenger, round(coalesce(b.composite, 0) - a.composite, 1) AS delta, b.composite IS NULL OR b.composite - a.composite < -2 AS regressed FROM a LEFT JOIN b USING (stratum) WHERE a.n >= 3)"


@query(_GATE + " SELECT * FROM c")
def e6_compared(spark, sf_dir):
    """Each stratum of one side's scorecard against the other's."""
    old, new = (composite.scorecard(_results(spark, sf_dir, side), ["stratum"]) for side in ("old", "new"))
    return composite.compared(new, old)


@query(_GATE + ", v AS (SELECT (SELECT count(*) FILTER (regressed) FROM c) AS regressions, coalesce((SELECT min(composite) FROM b WHERE n >= 3) >= (SELECT min(composite) FROM a WHERE n >= 3) - 2, false) AS worst_kept) SELECT *, regressions = 0 AND worst_kept AS passed FROM v")
def e6_verdict(spark, sf_dir):
    """Whether no stratum and not the worst one lost more than the tolerance."""
    old, new = (composite.scorecard(_results(spark, sf_dir, side), ["stratum"]) for side in ("old", "new"))
    return composite.verdict(new, old)


@query(f"""
    WITH j AS (SELECT company_id, count(*) AS extracted, sum({_FILLED}) AS filled, count(DISTINCT CASE WHEN length(trim(title, ' ')) BETWEEN 4 AND 140 THEN trim(source_url) END) AS titles FROM extracted_jobs GROUP BY 1), l AS (SELECT company_id, max(jobs_found) AS expected FROM crawl_logs GROUP BY 1),
    p AS (SELECT CASE WHEN quality_score < 10 THEN 'down' END AS error, extracted, filled, titles, expected, extracted::DOUBLE / nullif(expected, 0) AS ratio FROM j JOIN companies USING (company_id) LEFT JOIN l USING (company_id)),
    a AS (SELECT round(100 * avg((error IS NULL)::INT), 1) AS discovery, round(avg(CASE WHEN titles >= 2 THEN 100.0 ELSE 0 END) FILTER (error IS NULL), 1) AS quality_extraction, round(avg(100 * filled::DOUBLE / (6 * extracted)) FILTER (error IS NULL), 1) AS field_completeness,
        round(avg(CASE WHEN expected IS NULL THEN 100.0 WHEN ratio <= 1 THEN 100 * ratio ELSE greatest(0, 100 - 100 * greatest(0, ratio - 1.5)) END) FILTER (error IS NULL), 1) AS volume_accuracy FROM p)
    SELECT *, round(0.2 * discovery + 0.3 * quality_extraction + 0.25 * field_completeness + 0.25 * volume_accuracy, 2) AS composite FROM a""")
def e13_page_axes(spark, sf_dir):
    """The axes by page means, with volume falling on both sides; companies stand for tested pages."""
    t = T(spark, sf_dir)
    filled = sum((F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 1).otherwise(0) for c in composite.CORE_FIELDS), F.lit(0))
    jobs = t.extracted_jobs.groupBy("company_id").agg(F.count("*").alias("extracted"), F.sum(filled).alias("filled"), F.countDistinct(F.when(F.length(F.trim("title")).between(4, 140), F.trim("source_url"))).alias("titles"))
    expected = t.crawl_logs.groupBy("company_id").agg(F.max("jobs_found").alias("expected"))
    pages = jobs.join(t.companies.select("company_id", F.when(F.col("quality_score") < 10, "down").alias("error")), "company_id").join(expected, "company_id", "left")
    return composite.page_axes(pages)


@query(f"""
    WITH h AS (SELECT DISTINCT log_id, company_id, started_at, jobs_found FROM crawl_logs WHERE company_id IS NOT NULL),
    b AS (SELECT company_id, max(jobs_found) FILTER (started_at < TIMESTAMP '2025-08-01') AS best, max(jobs_found) FILTER (started_at >= TIMESTAMP '2025-08-01') AS now FROM h GROUP BY 1)
    SELECT company_id, best, now FROM b WHERE best > 0 AND now IS NOT NULL AND now < greatest(1, CAST(floor(0.85 * best) AS INT))""")
def e7_regressions(spark, sf_dir):
    """Keys whose value fell below 0.85 of the best before."""
    logs, cut = T(spark, sf_dir).crawl_logs.where("company_id is not null"), F.lit("2025-08-01").cast("timestamp")
    side = lambda c: F.max(F.when(c, F.col("jobs_found")))
    both = logs.groupBy("company_id").agg(side(F.col("started_at") < cut).alias("best"), side(F.col("started_at") >= cut).alias("now"))
    return both.where((F.col("best") > 0) & (F.col("now") < F.greatest(F.lit(1), F.floor(0.85 * F.col("best")).cast("int"))))


@query("""
    WITH s AS (SELECT unnest(['all', 'type=' || event_type]) AS stratum, (value > 25)::INT AS y, (user_id % 2)::INT AS p FROM events),
    c AS (SELECT stratum, count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM s GROUP BY 1),
    d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM c)
    SELECT stratum, n, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(fp::DOUBLE / n, 6) AS fp_share FROM d""")
def e12_classification(spark, sf_dir):
    events = T(spark, sf_dir).events.select("event_type", (F.col("value") > 25).cast("int").alias("y"), (F.col("user_id") % 2).cast("int").alias("p"))
    return st.classification(events, F.array(F.lit("all"), F.concat(F.lit("type="), F.col("event_type"))), "y", "p")


@query()
def e11_fuzzy_titles(spark, sf_dir):
    """Titles alike as sets of words to the first of their company."""
    jobs = T(spark, sf_dir).extracted_jobs
    first = jobs.groupBy("company_id").agg(F.min_by("title", "job_id").alias("first_title"))
    scored = jobs.join(first, "company_id").select("job_id", st.token_set_ratio(F.col("title"), F.col("first_title")).alias("ratio"))
    return scored.where("ratio >= 80")


@query("""
    WITH a AS (SELECT j.job_id, j.company_id FROM extracted_jobs j), e AS (SELECT company_id, count(*) AS expected FROM extracted_jobs GROUP BY 1), g AS (SELECT company_id, max(jobs_found) AS extracted FROM crawl_logs GROUP BY 1)
    SELECT company_id, round(least(1.0, extracted::DOUBLE / expected), 6) AS coverage, CASE WHEN extracted::DOUBLE / expected BETWEEN 0.5 AND 2 THEN 'silver' ELSE 'suspect' END AS label FROM e JOIN g USING (company_id)""")
def e10_e14_coverage(spark, sf_dir):
    """Coverage of an expected count, at most 1; counts within half and double are trusted."""
    t = T(spark, sf_dir)
    expected = t.extracted_jobs.groupBy("company_id").agg(F.count("*").alias("e"))
    both = expected.join(t.crawl_logs.groupBy("company_id").agg(F.max("jobs_found").alias("x")), "company_id")
    share = F.col("x") / F.col("e")
    return both.select("company_id", F.round(F.least(F.lit(1.0), share), 6).alias("coverage"), F.when(share.between(0.5, 2), "silver").otherwise("suspect").alias("label"))


@query("""
    WITH n AS (SELECT company_id, count(*) AS n FROM extracted_jobs GROUP BY 1), held AS (SELECT DISTINCT regexp_extract(job_page_url, '^[a-z]+://([^/?#]+)', 1) AS domain FROM company_enrichment_rows WHERE status = 'error'),
    c AS (SELECT company_id, domain, market_code, coalesce(ats_platform, '') AS category, n FROM companies LEFT JOIN n USING (company_id) WHERE is_active AND domain NOT IN (SELECT domain FROM held WHERE domain IS NOT NULL)),
    d AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC NULLS LAST, company_id) AS p FROM c),
    s AS (SELECT *, row_number() OVER (PARTITION BY market_code, category ORDER BY n DESC NULLS LAST, company_id) AS place FROM d WHERE p = 1)
    SELECT company_id, market_code, category, n FROM s WHERE place <= 9""")
def e15_seeds(spark, sf_dir):
    """Three times as many seeds a market and category as wanted, the fullest first; blocked domains are left out, each domain counts once."""
    t = T(spark, sf_dir)
    counts = t.extracted_jobs.groupBy("company_id").agg(F.count("*").alias("n"))
    held = t.company_enrichment_rows.where("status = 'error'").select(F.regexp_extract("job_page_url", "^[a-z]+://([^/?#]+)", 1).alias("domain"))
    own = r.without(t.companies.where("is_active"), held, ["domain"]).select("company_id", "domain", "market_code", F.coalesce("ats_platform", F.lit("")).alias("category")).join(counts, "company_id", "left")
    fullest = [F.desc_nulls_last("n"), F.asc("company_id")]
    return r.first_per(r.first_per(own, ["domain"], fullest), ["market_code", "category"], fullest, 9).drop("domain")


@query("""
    WITH j AS (SELECT company_id, count(*) FILTER (extraction_confidence >= 0.8) AS gold, count(*) FILTER (extraction_confidence >= 0.4 AND extraction_confidence < 0.8) AS silver FROM extracted_jobs GROUP BY 1), l AS (SELECT company_id, max(jobs_found) AS extracted, count(DISTINCT log_id) AS expected FROM crawl_logs WHERE company_id IS NOT NULL GROUP BY 1),
    w AS (SELECT company_id, extracted, expected, gold + 0.5 * silver AS total FROM l LEFT JOIN j USING (company_id))
    SELECT company_id, round(CASE WHEN coalesce(total, 0) > 0 THEN least(1.0, extracted::DOUBLE / total) WHEN expected > 0 THEN least(1.0, extracted::DOUBLE / expected) END, 6)::DOUBLE AS coverage FROM w""")
def e10_weighted_coverage(spark, sf_dir):
    """Coverage of trusted (1) and likely (one half) rows, doubtful ones left out; without any, of the expected count."""
    t = T(spark, sf_dir)
    c = F.col("extraction_confidence")
    marked = t.extracted_jobs.groupBy("company_id").agg((F.count_if(c >= 0.8) + 0.5 * F.count_if((c >= 0.4) & (c < 0.8))).alias("total"))
    logs = t.crawl_logs.where("company_id is not null").groupBy("company_id").agg(F.max("jobs_found").alias("extracted"), F.countDistinct("log_id").alias("expected"))
    return logs.join(marked, "company_id", "left").select("company_id", F.round(st.weighted_coverage(F.col("extracted"), F.col("total"), F.col("expected")), 6).alias("coverage"))


@query(_RESULTS + " SELECT stratum, round(least(20.0, 0.05 * greatest(0, sum(base) - sum(new_jobs))), 1)::DOUBLE AS points FROM t GROUP BY 1")
def e18_cluster_points(spark, sf_dir):
    """What mending a stratum could gain at most: 0.05 points for each missing row, up to 20."""
    number = lambda c: F.coalesce(F.sum(c), F.lit(0))
    missing = F.greatest(F.lit(0), number("base") - number("jobs"))
    return _results(spark, sf_dir, "new").groupBy("stratum").agg(F.round(F.least(F.lit(20.0), 0.05 * missing), 1).alias("points"))


@query("""
    WITH o AS (SELECT company_id, max(jobs_found) AS best FROM crawl_logs WHERE company_id IS NOT NULL AND started_at < TIMESTAMP '2025-08-01' GROUP BY 1), n AS (SELECT company_id, max(jobs_found) AS best FROM crawl_logs WHERE company_id IS NOT NULL AND started_at >= TIMESTAMP '2025-08-01' GROUP BY 1)
    SELECT company_id, greatest(coalesce(o.best, n.best), coalesce(n.best, o.best)) AS best, CASE WHEN o.best IS NULL OR n.best >= o.best THEN 'new' ELSE 'old' END AS run FROM o FULL JOIN n USING (company_id)""")
def e8_ratchet(spark, sf_dir):
    """The best value of each key over two runs and the run it is from; it never falls, and the newer run takes a tie."""
    logs = T(spark, sf_dir).crawl_logs.where("company_id is not null")
    cut = F.col("started_at") < F.lit("2025-08-01").cast("timestamp")
    run = lambda rows, name, newer: rows.groupBy("company_id").agg(F.struct(F.max("jobs_found").alias("best"), F.lit(newer).alias("newer"), F.lit(name).alias("run")).alias("b"))
    merged = merge.upsert(run(logs.where(cut), "old", 0), run(logs.where(~cut), "new", 1), ["company_id"], {"b": "max"})
    return merged.select("company_id", "b.best", "b.run")


@query("SELECT CASE WHEN is_active AND extraction_confidence < 0.5 THEN 'fp' WHEN NOT is_active AND extraction_confidence >= 0.5 THEN 'fn' ELSE 'correct' END AS kind, count(*) AS n FROM extracted_jobs GROUP BY 1")
def e18_failure_kind(spark, sf_dir):
    kind = F.when(F.col("is_active") & (F.col("extraction_confidence") < 0.5), "fp").when(~F.col("is_active") & (F.col("extraction_confidence") >= 0.5), "fn").otherwise("correct")
    return T(spark, sf_dir).extracted_jobs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
    WITH t AS (SELECT company_id, lower(trim(title, ' ')) AS k, bool_or(coalesce(is_active, false)) AS old, bool_or(extraction_confidence >= 0.5) AS new FROM extracted_jobs WHERE trim(coalesce(title, ''), ' ') <> '' GROUP BY 1, 2),
    d AS (SELECT company_id, count(*) FILTER (old AND NOT coalesce(new, false)) AS missing, count(*) FILTER (new AND NOT old) AS extra FROM t GROUP BY 1),
    j AS (SELECT company_id, coalesce(is_active, false) AS old, coalesce(extraction_confidence >= 0.5, false) AS new, (salary_raw IS NOT NULL)::INT AS pay FROM extracted_jobs),
    v AS (SELECT company_id, avg(pay) FILTER (old) - avg(pay) FILTER (new) AS gap, count(*) FILTER (new)::DOUBLE / greatest(1, count(*) FILTER (old)) AS ratio FROM j GROUP BY 1)
    SELECT company_id, missing, extra, round(gap, 4) AS pay_gap, round(ratio, 4) AS volume_ratio FROM d JOIN v USING (company_id)""")
def e19_site_difference(spark, sf_dir):
    """Titles that only one of two result sets has, the gap of a field between them and the ratio of their volumes, by site."""
    jobs = T(spark, sf_dir).extracted_jobs.select("company_id", F.lower(F.trim("title")).alias("k"), F.coalesce("is_active", F.lit(False)).alias("old"), F.coalesce(F.col("extraction_confidence") >= 0.5, F.lit(False)).alias("new"), F.col("salary_raw").isNotNull().cast("int").alias("pay"))
    titles = jobs.where("k <> ''").groupBy("company_id", "k").agg(F.bool_or("old").alias("old"), F.bool_or("new").alias("new"))
    differ = titles.groupBy("company_id").agg(F.count_if(F.col("old") & ~F.col("new")).alias("missing"), F.count_if(F.col("new") & ~F.col("old")).alias("extra"))
    gap = F.avg(F.when(F.col("old"), F.col("pay"))) - F.avg(F.when(F.col("new"), F.col("pay")))
    sides = jobs.groupBy("company_id").agg(F.round(gap, 4).alias("pay_gap"), F.round(F.count_if("new") / F.greatest(F.lit(1), F.count_if("old")), 4).alias("volume_ratio"))
    return differ.join(sides, "company_id")


@query("""
    WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query, vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS cosine FROM q, embeddings WHERE vec_id <> query)
    SELECT query, vec_id, cosine, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM s WHERE cosine > 0) WHERE place <= 5""")
def e21_nearest(spark, sf_dir):
    """The five nearest vectors of every query row (ids divisible by 50), against all rows."""
    vectors = T(spark, sf_dir).embeddings
    return st.nearest(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query("""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents WHERE lang = 'id'), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT doc_id, term, round(tf * (ln((1.0 + (SELECT count(*) FROM documents WHERE lang = 'id')) / (1 + df)) + 1), 6) AS weight FROM tf JOIN d USING (term))
    SELECT doc_id, term, weight, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS place FROM s) WHERE place <= 5""")
def e21_terms(spark, sf_dir):
    return st.terms_by_weight(T(spark, sf_dir).documents.where("lang = 'id'"), "doc_id", "text", 5)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events WHERE event_type = 'click') WHERE p <= 10")
def e22_memory(spark, sf_dir):
    return r.first_per(T(spark, sf_dir).events.where("event_type = 'click'"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("""
    WITH c AS (SELECT p_partkey, p_brand, p_size // 10 AS cell, p_retailprice FROM part)
    SELECT p_brand, cell, arg_max(p_partkey, struct_pack(f := p_retailprice, k := -p_partkey)) AS p_partkey, max(p_retailprice) AS p_retailprice, count(*) AS tried FROM c GROUP BY 1, 2""")
def e23_best_per_cell(spark, sf_dir):
    parts = T(spark, sf_dir).part.select("p_partkey", "p_brand", F.floor(F.col("p_size") / 10).cast("int").alias("cell"), "p_retailprice")
    return st.best_per_cell(parts, ["p_brand", "cell"], "p_retailprice", "p_partkey")


@query("""
    WITH o AS (SELECT event_type, value > 20 AS win, power(0.9, count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS w FROM events)
    SELECT event_type, round(1 + sum(CASE WHEN win THEN w ELSE 0 END), 6) AS alpha, round(1 + sum(CASE WHEN win THEN 0 ELSE w END), 6) AS beta FROM o GROUP BY 1""")
def e24_posterior(spark, sf_dir):
    return st.posterior(T(spark, sf_dir).events.withColumn("win", F.col("value") > 20), "event_type", ["ts", "event_id"], "win")


@query("SELECT company_id, round(1.0 / rank() OVER (ORDER BY quality_score DESC), 6)::DOUBLE AS weight FROM companies WHERE quality_score IS NOT NULL")
def e25_rank_weights(spark, sf_dir):
    """Weights 1 / rank, the rank being one more than the rows of higher score."""
    scored = T(spark, sf_dir).companies.where("quality_score is not null").select("company_id", "quality_score")
    return st.ranked(scored, "quality_score").select("company_id", F.round(1.0 / F.col("place"), 6).alias("weight"))


_SIDE = "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'baseline' ELSE 'current' END AS side"


@query(f"""
    WITH s AS (SELECT {_SIDE}, value AS x FROM events), e AS (SELECT list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM s WHERE side = 'baseline'),
    b AS (SELECT side, len(list_filter(edges, lambda v: x > v)) AS bin FROM s, e), c AS (SELECT k AS bin, count(*) FILTER (side = 'baseline') AS b, count(*) FILTER (side = 'current') AS c FROM (SELECT unnest(range(0, len(edges) + 1)) AS k FROM e) LEFT JOIN b ON b.bin = k GROUP BY 1),
    p AS (SELECT greatest(b::DOUBLE / sum(b) OVER (), 0.0001) AS b, greatest(c::DOUBLE / sum(c) OVER (), 0.0001) AS c FROM c), r AS (SELECT round(sum((c - b) * ln(c / b)), 6) AS psi FROM p)
    SELECT psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS severity FROM r""")
def st1_psi_numeric(spark, sf_dir):
    side = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "baseline").otherwise("current")
    return st.psi_numeric(T(spark, sf_dir).events.select(side.alias("side"), "value"), "side", "value")


@query(f"""
    WITH c AS (SELECT event_type, count(*) FILTER (side = 'baseline') AS b, count(*) FILTER (side = 'current') AS c FROM (SELECT {_SIDE}, event_type FROM events) GROUP BY 1),
    p AS (SELECT greatest(b::DOUBLE / sum(b) OVER (), 0.0001) AS b, greatest(c::DOUBLE / sum(c) OVER (), 0.0001) AS c FROM c), r AS (SELECT round(sum((c - b) * ln(c / b)), 6) AS psi FROM p)
    SELECT psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS severity FROM r""")
def st1_psi_category(spark, sf_dir):
    side = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "baseline").otherwise("current")
    return st.psi_category(T(spark, sf_dir).events.select(side.alias("side"), "event_type"), "side", "event_type")


@query("SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (SELECT (user_id % 2) = (value > 20)::INT AS a, (user_id % 3 = 0)::INT = (value > 20)::INT AS b FROM events WHERE event_type = 'error')")
def st2_mcnemar_counts(spark, sf_dir):
    return st2_mcnemar(spark, sf_dir).select("only_a", "only_b")


@query()
def st2_mcnemar(spark, sf_dir):
    """The exact test; its p-value is checked in the tests."""
    rows = T(spark, sf_dir).events.where("event_type = 'error'").select((F.col("value") > 20).cast("int").alias("y"), (F.col("user_id") % 2).cast("int").alias("a"), (F.col("user_id") % 3 == 0).cast("int").alias("b"))
    return st.mcnemar(rows, "y", "a", "b")


@query()
def st3_bootstrap(spark, sf_dir):
    """An interval of the mean by the Poisson bootstrap; checked against the normal one in the tests."""
    return st.bootstrap_mean(T(spark, sf_dir).events, "value", "event_id")


@query("SELECT a.event_type AS metric, round(b.m - a.m, 6) AS delta, b.m - a.m >= 0.01 AS wins FROM (SELECT event_type, avg(value) AS m FROM events WHERE user_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type, avg(value) AS m FROM events WHERE user_id % 2 = 1 GROUP BY 1) b USING (event_type)")
def st4_metric_gates(spark, sf_dir):
    """Each metric of a challenger against the champion's, with the least gain that counts."""
    means = T(spark, sf_dir).events.groupBy(F.col("event_type").alias("metric")).agg(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("user_id") % 2 == 1, F.col("value"))).alias("b"))
    return means.where("a is not null and b is not null").select("metric", F.round(F.col("b") - F.col("a"), 6).alias("delta"), (F.col("b") - F.col("a") >= 0.01).alias("wins"))


@query("""
    WITH c AS (SELECT crawl_type, count(*) FILTER (status = 'success')::DOUBLE AS h, count(*)::DOUBLE AS n FROM crawl_logs GROUP BY 1)
    SELECT crawl_type, round(greatest(0, (h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low,
        round(least(1, (h / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM c""")
def st5_wilson(spark, sf_dir):
    counts = T(spark, sf_dir).crawl_logs.groupBy("crawl_type").agg(F.count_if(F.col("status") == "success").cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    low, high = st.wilson(F.col("h"), F.col("n"))
    return counts.select("crawl_type", low.alias("low"), high.alias("high"))


@query("SELECT crawl_type, count(duration_seconds) AS n, round(quantile_cont(duration_seconds, 0.5), 6) AS p50, round(quantile_cont(duration_seconds, 0.95), 6) AS p95, round(quantile_cont(duration_seconds, 0.99), 6) AS p99, CASE WHEN count(duration_seconds) >= 100 THEN quantile_cont(duration_seconds, 0.95) <= 200 END AS within FROM crawl_logs GROUP BY 1")
def st6_percentiles(spark, sf_dir):
    return st.percentiles(T(spark, sf_dir).crawl_logs, ["crawl_type"], "duration_seconds", 100, 200.0)


@query("""
    WITH u AS (SELECT job_id, market_code, round(1 - abs(2 * extraction_confidence - 1), 6) AS uncertainty FROM extracted_jobs)
    SELECT market_code, job_id, uncertainty FROM (SELECT *, row_number() OVER (PARTITION BY market_code ORDER BY uncertainty DESC, job_id) AS p FROM u WHERE uncertainty >= 0.1) WHERE p <= 5""")
def st7_uncertain(spark, sf_dir):
    return st.most_uncertain(T(spark, sf_dir).extracted_jobs, "market_code", "extraction_confidence", "job_id", 5).select("market_code", "job_id", "uncertainty")
