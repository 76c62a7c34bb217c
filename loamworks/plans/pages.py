"""Queries over pages: the block table and selections from it."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks as b
from ..operators import templates
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


def _plain_sql(expression: str) -> str:
    """Text of markup in SQL: common entities resolved, single blanks."""
    quoted = lambda x: x.replace("'", "''")
    for entity, sign in tx.ENTITIES:
        expression = f"replace({expression}, '{quoted(entity)}', '{quoted(sign)}')"
    return rf"trim(regexp_replace({expression}, '\s+', ' ', 'g'))"


def _visible_sql() -> str:
    return _plain_sql(r"regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')")


def _blocks(spark, sf_dir):
    return b.blocks(T(spark, sf_dir).snapshot_files, "snapshot_path", "html")


@query()
def h_blocks(spark, sf_dir):
    """Elements of all pages."""
    return _blocks(spark, sf_dir).select("page", "node", "parent", "tag", "own_text", "link_chars")


@query(r"SELECT snapshot_path AS page, len(regexp_extract_all(html, '<a\b')) AS links, len(regexp_extract_all(html, '<p\b')) AS paragraphs, len(regexp_extract_all(html, '<li\b')) AS items, len(regexp_extract_all(html, '<h1\b')) AS headings FROM snapshot_files")
def h_tag_counts(spark, sf_dir):
    """Elements by kind, from the block table; the SQL counts tags in the source."""
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return _blocks(spark, sf_dir).groupBy("page").agg(count("a").alias("links"), count("p").alias("paragraphs"), count("li").alias("items"), count("h1").alias("headings"))


@query(r"SELECT snapshot_path AS page, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM snapshot_files WHERE html LIKE '%<h1%'")
def h25_page_title(spark, sf_dir):
    """Each page's title: the first heading."""
    return _blocks(spark, sf_dir).where("tag = 'h1'").groupBy("page").agg(F.min_by("text", "node").alias("title"))


@query()
def h2_repeating(spark, sf_dir):
    return b.repeating_groups(_blocks(spark, sf_dir), linked=0.0)


@query()
def h3_containers(spark, sf_dir):
    return b.container_scores(_blocks(spark, sf_dir))


@query()
def h10_density(spark, sf_dir):
    return b.density(_blocks(spark, sf_dir))


def _likely(table):
    found = b.text_blocks(table)
    prose = F.least(F.lit(1.0), 10.0 * F.regexp_count("text", F.lit(r"[.!?](?:\s|$)")) / F.greatest(F.regexp_count("text", F.lit(r"\S+")), F.lit(1)))
    return b.best_block(found.select("page", "node", F.length("text").alias("length"), prose.alias("probability")))


@query()
def h14_h15_best_block(spark, sf_dir):
    """Of each page's text blocks, the longest among the likeliest by their prose."""
    return _likely(_blocks(spark, sf_dir))


@query()
def h12_layers(spark, sf_dir):
    """Each page's description by the first good layer: structured data, learnt selectors, semantic elements, the densest block, the likeliest block. Layers that call models are left out."""
    files = T(spark, sf_dir).snapshot_files
    table = cut_lineage(_blocks(spark, sf_dir))
    whole = table.groupBy("page").agg(F.lit(1).alias("one"))
    structured = b.postings(b.page_scripts(files, "snapshot_path", "html")).groupBy("page").agg(F.max_by("description", F.length("description")).alias("structured"))
    learned = templates.templated(files, "snapshot_path", "html", {"text": "div.job-description"}).select("page", F.element_at("fields", "text").alias("learned"))
    semantic = table.where(F.col("tag").isin("main", "article")).groupBy("page").agg(F.max_by("text", F.length("text")).alias("semantic"))
    texts = table.select("page", "node", "text")
    dense = b.density(table, 1).select("page", "node").join(texts, ["page", "node"]).select("page", F.col("text").alias("density"))
    likely = _likely(table).join(texts, ["page", "node"]).select("page", F.col("text").alias("classifier"))
    joined = whole
    for layer in (structured, learned, semantic, dense, likely):
        joined = joined.join(layer, "page", "left")
    layers = {"structured": 0.98, "learned": 0.90, "semantic": 0.72, "density": 0.65, "classifier": 0.80}
    return joined.select("page", *b.first_good(*((n, F.col(n), c) for n, c in layers.items())))


@query(r"""
    WITH t AS (SELECT snapshot_path AS page, unnest(regexp_extract_all(regexp_replace(html, '(?is)(<script\b[^>]*>).*?</script>', '\1', 'g'), '<[a-z][a-z0-9]*\b[^>]*>')) AS tag FROM snapshot_files),
    s AS (SELECT DISTINCT split_part(page, '/', 2) AS site, page, regexp_extract(tag, '<([a-z][a-z0-9]*)', 1) || CASE WHEN tag LIKE '%class="%' THEN '.' || array_to_string(list_sort(string_split(regexp_extract(tag, 'class="([^"]*)"', 1), ' ')), '.') ELSE '' END AS selector FROM t),
    n AS (SELECT site, count(DISTINCT page) AS total FROM s GROUP BY 1)
    SELECT site, selector, count(*) AS pages FROM s JOIN n USING (site) WHERE total >= 2 GROUP BY site, selector, total HAVING count(*) = total""")
def h16_common_selectors(spark, sf_dir):
    return b.common_selectors(_blocks(spark, sf_dir), F.split("page", "/")[1])


def _signature_sql() -> str:
    every = lambda tag, key: rf"""array_to_string(regexp_extract_all(html, '(?i)<{tag}\b[^>]*\s{key}="([^"]*)"', 1), ' ')"""
    ladder, frames = "", ""
    for name, urls, texts, scripts, base in b.SIGNATURES:
        points = " + ".join([f"2 * regexp_matches(seen, '{p}')::INT" for p in urls] + [f"regexp_matches(seen, '{p}')::INT" for p in texts] + [f"regexp_matches(scripts, '{p}')::INT" for p in scripts])
        ladder += f" WHEN {points} >= 2 THEN {{'platform': '{name}', 'points': {points}, 'confidence': round(least(0.99, {base} + 0.01 * ({points} - 2)), 6)::DOUBLE}}"
        frames += f" WHEN regexp_matches(frames, '{'|'.join(urls)}') THEN {{'platform': '{name}', 'points': 0, 'confidence': round({base} * 0.9, 6)::DOUBLE}}"
    return f"""
        WITH p AS ({_HOSTED_SQL}), q AS (SELECT page, lower(concat_ws(' ', url, {_visible_sql()}, {every("script", "src")}, {every("a", "href")})) AS seen, lower({every("script", "src")}) AS scripts, lower({every("iframe", "src")}) AS frames FROM p)
        SELECT page, x.platform AS platform, x.points AS points, x.confidence AS confidence FROM (SELECT page, CASE {ladder} {frames} END AS x FROM q) WHERE x IS NOT NULL"""


#: Pages as if some were hosted by platforms: signs in the address, in scripts and in frames.
_HOSTED_SQL = """
    SELECT snapshot_id AS page, CASE snapshot_id % 6 WHEN 0 THEN 'https://boards.greenhouse.io/x' WHEN 1 THEN 'https://a.wd3.myworkdayjobs.com/x' ELSE url END AS url,
        CASE snapshot_id % 6 WHEN 2 THEN html || '<script src="https://x.example/workday.js"></script><a href="/wd-list">x</a>' WHEN 3 THEN html || '<iframe src="https://jobs.jobvite.com/x"></iframe>' WHEN 4 THEN html || '<p>Powered by lever-job</p>' ELSE html END AS html
    FROM gold_holdout_snapshots JOIN snapshot_files USING (snapshot_path)"""


@query(f"SELECT snapshot_path AS page, length({_visible_sql()}) < 260 AS short FROM snapshot_files")
def h8_short_pages(spark, sf_dir):
    from ..functions.text import html_to_text

    return T(spark, sf_dir).snapshot_files.select(F.col("snapshot_path").alias("page"), (F.length(html_to_text(F.col("html"))) < 260).alias("short"))


@query(f"""SELECT length({_visible_sql()}) < 200 AND (regexp_matches(html, '(?i)id="(?:root|app|__next|__nuxt)"') OR len(regexp_extract_all(html, '(?i)<script')) >= 3) AS shell, count(*) AS pages FROM snapshot_files GROUP BY 1""")
def h8_shells(spark, sf_dir):
    return T(spark, sf_dir).snapshot_files.groupBy(b.is_shell(F.col("html")).alias("shell")).agg(F.count("*").alias("pages"))


@query(r"""SELECT CASE WHEN regexp_matches(lower(html), 'rel="next"|>\s*next\b|next job') THEN 'next' WHEN regexp_matches(lower(html), '[?&](?:page|p|pg)=\d+|showing \d+-\d+ of') THEN 'numbered' WHEN regexp_matches(lower(html), 'load more|show more') THEN 'more' ELSE 'none' END AS kind, count(*) AS pages FROM snapshot_files GROUP BY 1""")
def h9_paging(spark, sf_dir):
    return T(spark, sf_dir).snapshot_files.groupBy(b.paging_kind(F.col("html")).alias("kind")).agg(F.count("*").alias("pages"))


@query(r"""
    WITH l AS (SELECT snapshot_path AS page, unnest(list_zip(regexp_extract_all(html, '<a\b[^>]*\shref="([^"]*)"[^>]*>[^<]*', 1), regexp_extract_all(html, '<a\b[^>]*\shref="[^"]*"[^>]*>([^<]*)', 1), range(0, 10000)[:len(regexp_extract_all(html, '<a\b[^>]*\shref="[^"]*"[^>]*>'))])) AS x FROM snapshot_files)
    SELECT page, x[3]::INT AS position, 'https://pages.example' || x[1] AS url, """ + _plain_sql("x[2]") + """ AS anchor FROM l""")
def s15_links(spark, sf_dir):
    """Links of all pages, resolved against a base address."""
    return b.page_links(T(spark, sf_dir).snapshot_files, "snapshot_path", "html", "https://pages.example/")


@query(r"SELECT snapshot_path AS page, len(regexp_extract_all(html, '<script\b')) AS scripts FROM snapshot_files WHERE html LIKE '%<script%'")
def h29_scripts(spark, sf_dir):
    return b.page_scripts(T(spark, sf_dir).snapshot_files, "snapshot_path", "html").groupBy("page").agg(F.count("*").alias("scripts"))


@query()
def h1_postings(spark, sf_dir):
    """Job postings in JSON-LD; made of the job rows, as the given pages carry none."""
    jobs = T(spark, sf_dir).extracted_jobs.select(F.col("job_id").cast("string").alias("page"), "title", "location_raw", "date_posted")
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("JobPosting").alias("@type"), "title", F.col("date_posted").alias("datePosted"), F.struct(F.struct(F.col("location_raw").alias("addressLocality")).alias("address")).alias("jobLocation"))).alias("@graph")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.replace(graph, F.lit("<"), F.lit("\\u003c")), F.lit("</script></head></html>"))
    return b.postings(b.page_scripts(jobs.select("page", html.alias("html")), "page", "html")).select(F.col("page").cast("long").alias("job_id"), "title", "location_raw", F.col("date_posted").cast("date").alias("date_posted"), "confidence")


SQL["h1_postings"] = "SELECT job_id, title, nullif(location_raw, '') AS location_raw, date_posted, 0.95::DOUBLE AS confidence FROM extracted_jobs"


@query(r"""
    WITH h AS (SELECT snapshot_path AS page, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM snapshot_files WHERE regexp_matches(html, '<h1[^>]*>[^<]*</h1>'))
    SELECT page, """ + _plain_sql("title") + """ AS title, 0.85::DOUBLE AS confidence FROM h""")
def h17_templated(spark, sf_dir):
    """The heading of each page by a learned selector."""
    found = templates.templated(T(spark, sf_dir).snapshot_files, "snapshot_path", "html", {"title": "h1", "nothing": "h1 > .missing"})
    return found.select("page", F.element_at("fields", "title").alias("title"), "confidence")


@query("""
    SELECT p_partkey, round((CASE WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 1 ELSE 1 END)::DOUBLE / (CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE 2 END), 6) AS accuracy FROM part""")
def h17_accuracy(spark, sf_dir):
    """How far two extractions of one thing agree: equal or held in the other, unequal, missing on one side."""
    k = F.pmod("p_partkey", F.lit(3))
    kind = F.when(k == 0, F.concat(F.lit("All "), F.upper("p_type"))).when(k == 1, F.lit("#"))
    rows = T(spark, sf_dir).part.select(
        "p_partkey", F.create_map(F.lit("name"), F.col("p_name"), F.lit("kind"), F.col("p_type")).alias("a"),
        F.map_filter(F.create_map(F.lit("name"), F.concat(F.lit(" "), "p_name"), F.lit("kind"), kind), lambda _, v: v.isNotNull()).alias("b"),
    )
    return rows.select("p_partkey", F.round(templates.accuracy("a", "b", ["name", "kind", "unknown"]), 6).alias("accuracy"))


@query(r"""
    WITH l AS (SELECT snapshot_path AS page, unnest(regexp_extract_all(html, '<li[^>]*>([^<]*)</li>', 1)) AS t FROM snapshot_files WHERE html LIKE '%<li%'),
    c AS (SELECT page, """ + _plain_sql("t") + """ AS title FROM l)
    SELECT page, count(*) AS records, min(title) AS first, max(title) AS last FROM c WHERE length(title) BETWEEN 3 AND 300 GROUP BY 1""")
def h18_wrapped(spark, sf_dir):
    """Records of a wrapper that is cut at list entries, whose own text is the title."""
    rows = templates.wrapped_rows(T(spark, sf_dir).snapshot_files.where("html like '%<li%'"), "snapshot_path", "html", ["ul.jobs > li", "body"], ["li"], ["a.apply"], {"place": [".place"]}, every=True)
    return rows.groupBy("page").agg(F.count("*").alias("records"), F.min("title").alias("first"), F.max("title").alias("last"))


@query("""
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.a|.b' WHEN 1 THEN './/td[4]|.b' WHEN 2 THEN '.' || p_size WHEN 3 THEN '' ELSE '' END AS selectors FROM part""")
def h27_selector_lists(spark, sf_dir):
    """Lists of selectors as typed: JSON, YAML, a single one, null and empty."""
    k = F.pmod("p_partkey", F.lit(5))
    typed = F.when(k == 0, '[".a", "null", " .b "]').when(k == 1, '---\n- ".//td[4]"\n- null\n- .b').when(k == 2, F.concat(F.lit("'."), "p_size", F.lit("'"))).when(k == 3, "null")
    return T(spark, sf_dir).part.select("p_partkey", F.array_join(templates.selector_list(typed), "|").alias("selectors"))


@query(_signature_sql())
def h7_signatures(spark, sf_dir):
    """The platform behind each page by twelve signatures."""
    t = T(spark, sf_dir)
    k = F.pmod("snapshot_id", F.lit(6))
    url = F.when(k == 0, "https://boards.greenhouse.io/x").when(k == 1, "https://a.wd3.myworkdayjobs.com/x").otherwise(F.col("url"))
    added = F.when(k == 2, '<script src="https://x.example/workday.js"></script><a href="/wd-list">x</a>').when(k == 3, '<iframe src="https://jobs.jobvite.com/x"></iframe>').when(k == 4, "<p>Powered by lever-job</p>").otherwise("")
    pages = t.gold_holdout_snapshots.select("snapshot_id", url.alias("url"), "snapshot_path").join(t.snapshot_files, "snapshot_path").withColumn("html", F.concat("html", added))
    return b.signatures(pages, "snapshot_id", F.col("url"), F.col("html"))


@query("SELECT snapshot_path AS page, substr(" + _plain_sql("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)") + r""", 1, 400) AS excerpt FROM snapshot_files WHERE regexp_matches(html, '<h1[^>]*>[^<]*</h1>')""")
def h24_excerpts(spark, sf_dir):
    """The beginning of each page's heading."""
    return b.excerpt(_blocks(spark, sf_dir), "h1")
