"""Queries over free text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import table

SIGNALS = {
    "requirements": r"(?i)\b(?:experience in|applicants should|we expect|required|knowledge of)\b",
    "benefits": r"(?i)\b(?:in return we offer|allowance|paid parking|leave days)\b",
    "salary": r"(?i)\b(?:salary|pay|wage|rate)s?\b",
    "employment": r"(?i)\b(?:full time|part time|permanent|contract|casual)\b",
}
TECH = ["java", "javascript", "python", "sql", "c++", "node.js", "spark", "ci/cd", "template"]
HINTS = [("new zealand", "NZ"), ("australia", "AU"), ("singapore", "SG"), ("malaysia", "MY"), ("hong kong", "HK"), ("philippines", "PH"), ("indonesia", "ID"), ("thailand", "TH")]
POINTS = {"salary_raw": 2, "location_raw": 1, "employment_type": 1, "date_posted": 1, "external_id": 1}


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extracted_jobs")


def _of(name: str, make, source: str = "extracted_jobs", key: str = "job_id"):
    """A query of one computed column over a whole table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, *make())

    query.__name__ = name
    return query


x1_weighted_length = _of("x1_weighted_length", lambda: [tx.weighted_length(F.col("text")).alias("length")], "documents", "doc_id")
x2_signals = _of("x2_signals", lambda: tx.families(F.col("description"), SIGNALS))
x8_tags = _of("x8_tags", lambda: [F.array_join(tx.keyword_tags(F.concat_ws(" ", "title", "description"), TECH), "|").alias("tags")])
x9_employment = _of("x9_employment", lambda: [tx.employment_type(F.col("employment_type")).alias("kind")])
x10_title = _of("x10_title", lambda: [tx.normal_title(F.col("title")).alias("title")])
x11_tokens = _of("x11_tokens", lambda: [F.array_join(F.sort_array(tx.title_tokens(F.col("description"))), " ").alias("words")])
x14_richness = _of("x14_richness", lambda: [tx.richness_points(POINTS).alias("points")])
x15_noise = _of("x15_noise", lambda: [tx.noise(F.col("description")).alias("noise")])
x16_gate = _of("x16_gate", lambda: [tx.description_gate(F.col("description")).alias("passes")])
x17_refusal = _of("x17_refusal", lambda: [tx.is_refusal(F.concat(F.when(F.col("row_id") % 5 == 0, F.lit("I'm sorry, but ")).otherwise(F.lit("")), tx.text(F.col("comment")))).alias("refusal")], "company_enrichment_rows", "row_id")
x19_valid_title = _of("x19_valid_title", lambda: [tx.valid_title(F.col("title")).alias("valid")])
x20_cleaned = _of("x20_cleaned", lambda: [F.md5(tx.cleaned(F.col("text")).cast("binary")).alias("digest")], "documents", "doc_id")
x21_html_text = _of("x21_html_text", lambda: [tx.html_to_text(F.col("html")).alias("text")], "snapshot_files", "snapshot_path")
x22_visible_count = _of("x22_visible_count", lambda: [tx.visible_count(F.col("html")).alias("shown")], "snapshot_files", "snapshot_path")
x25_terms = _of("x25_terms", lambda: [F.array_join(tx.place_terms(F.col("location_raw")), "|").alias("terms")])
x26_market = _of("x26_market", lambda: [tx.hinted_market(F.col("location_raw"), HINTS).alias("market")])


def x5_au_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each location of the Australian market names."""
    jobs = _jobs(spark, sf_dir).where("market_code = 'AU' and location_raw is not null")
    return jobs.select("job_id", tx.au_location(F.col("location_raw")).alias("p")).select("job_id", "p.*")


def x12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each title's words are those of its company's first job."""
    jobs = _jobs(spark, sf_dir)
    first = jobs.groupBy("company_id").agg(F.min_by("title", "job_id").alias("first_title"))
    return jobs.join(first, "company_id").select("job_id", F.round(tx.title_similarity(F.col("title"), F.col("first_title")), 6).alias("similarity"))


def x13_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of description, location and date to the company's first job."""
    jobs = _jobs(spark, sf_dir)
    first = jobs.groupBy("company_id").agg(F.min_by(F.struct("description", "location_raw", "date_posted"), "job_id").alias("f"))
    both = jobs.join(first, "company_id")
    return both.select(
        "job_id",
        F.round(tx.either_similarity(F.col("description"), F.col("f.description"), 1000, 0.5, 0.0), 6).alias("by_text"),
        F.round(tx.either_similarity(F.col("location_raw"), F.col("f.location_raw"), None, 0.5, 0.5), 6).alias("by_place"),
        tx.date_proximity(F.col("date_posted"), F.col("f.date_posted")).alias("by_date"),
    )


def x18_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_id", tx.numeric_features(F.col("description")).alias("p")).select("job_id", "p.*")


def x23_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field read from a JSON object within a reply."""
    reply = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" Hope it helps."))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(tx.reply_object(reply), "$.k").cast("int").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (x1_weighted_length, x2_signals, x5_au_location, x8_tags, x9_employment, x10_title, x11_tokens, x12_jaccard, x13_similarity, x14_richness, x15_noise, x16_gate, x17_refusal, x18_features, x19_valid_title, x20_cleaned, x21_html_text, x22_visible_count, x23_reply, x25_terms, x26_market)
}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS)
_T = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"
_NORMAL = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({x}, ''))), '\\(.*?\\)', '', 'g'), '\\[.*?\\]', '', 'g'), '\\s*[-–—/|]\\s*.*$', '', 'g'), '(?:\\b(?:ref|req|id)|#)\\s*\\w+', '', 'g'), '\\s+', ' ', 'g'))"
_J = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
_N = lambda p, x="t": f"len(regexp_extract_all({x}, '{p}'))"
_STATES = "|".join(tx.AU_STATES)
_CITY = " ".join(f"WHEN contains(l, '{c}') THEN '{c.title()}'" for c in sorted(tx.AU_CITIES, key=lambda c: (-len(c), tx.AU_CITIES.index(c))))
_CAP = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
SQL = {
    "x1_weighted_length": f"SELECT doc_id, length(coalesce(text, '')) + 2 * len(regexp_extract_all(coalesce(text, ''), '[\\x{{1100}}-\\x{{115F}}\\x{{2E80}}-\\x{{303E}}\\x{{3041}}-\\x{{33FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{A000}}-\\x{{A4CF}}\\x{{A960}}-\\x{{A97C}}\\x{{AC00}}-\\x{{D7A3}}\\x{{F900}}-\\x{{FAFF}}\\x{{FE30}}-\\x{{FE6F}}\\x{{FF01}}-\\x{{FF60}}\\x{{FFE0}}-\\x{{FFE6}}]')) AS length FROM documents",
    "x2_signals": "SELECT job_id, " + ", ".join(f"regexp_matches(coalesce(description, ''), '{p}') AS {n}" for n, p in SIGNALS.items()) + " FROM extracted_jobs",
    "x5_au_location": f"""
        WITH a AS (SELECT job_id, trim(location_raw) AS t, lower(trim(location_raw)) AS l FROM extracted_jobs WHERE market_code = 'AU' AND location_raw IS NOT NULL),
        b AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(t, '(?i){p}') THEN '{n}'" for n, p in tx.REMOTE)} WHEN l IN ('remote', 'nationwide') THEN 'fully_remote' END AS remote_type,
            nullif(regexp_extract(t, '\\b(\\d{{4}})\\b', 1), '') AS postcode,
            coalesce(upper(nullif(regexp_extract(t, '(?i)\\b({_STATES})\\b', 1), '')), CASE {' '.join(f"WHEN contains(l, '{n.lower()}') THEN '{c}'" for c, n in tx.AU_STATES.items())} END) AS state_abbr,
            nullif(trim(regexp_extract(t, '(?i)^([A-Z][a-zA-Z\\s]+?)(?:\\s*[,\\-–]\\s*|\\s+)(?:{_STATES})\\b', 1)), '') AS before FROM a),
        c AS (SELECT *, coalesce(CASE WHEN length(before) > 1 THEN {_CAP('before')} END, CASE {_CITY} END) AS named FROM b)
        SELECT job_id, remote_type, CASE WHEN remote_type = 'onsite' THEN false WHEN remote_type IS NOT NULL THEN true END AS is_remote, postcode, state_abbr,
            CASE WHEN l IN ('australia', 'au', 'remote', 'nationwide', 'various') THEN NULL WHEN named IS NULL AND contains(l, 'cbd') THEN 'CBD' ELSE named END AS city,
            named IS NULL AND contains(l, 'cbd') AS is_ambiguous FROM c""",
    "x8_tags": "SELECT job_id, array_to_string(list_filter([" + ", ".join("CASE WHEN regexp_matches(t, '\\b" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in k) + f"\\b') THEN '{k}' END" for k in TECH) + "], lambda x: x IS NOT NULL), '|') AS tags FROM (SELECT job_id, lower(concat_ws(' ', title, description)) AS t FROM extracted_jobs)",
    "x9_employment": "SELECT job_id, CASE " + " ".join(f"WHEN contains(k, '{p}') THEN '{n}'" for p, n in tx.EMPLOYMENT) + " END AS kind FROM (SELECT job_id, regexp_replace(lower(employment_type), '[\\s_-]', '', 'g') AS k FROM extracted_jobs)",
    "x10_title": f"SELECT job_id, {_NORMAL('title')} AS title FROM extracted_jobs",
    "x11_tokens": f"SELECT job_id, array_to_string(list_sort({_T('description')}), ' ') AS words FROM extracted_jobs",
    "x12_jaccard": f"""
        WITH j AS (SELECT job_id, {_NORMAL('title')} AS a, {_NORMAL('first_value(title) OVER (PARTITION BY company_id ORDER BY job_id)')} AS b FROM extracted_jobs),
        k AS (SELECT *, {_T('a')} AS x, {_T('b')} AS y FROM j)
        SELECT job_id, round(CASE WHEN a = b THEN 1.0 ELSE {_J('x', 'y')} END, 6) AS similarity FROM k""",
    "x13_similarity": f"""
        WITH j AS (SELECT job_id, description AS d, location_raw AS l, date_posted AS p, first_value(description) OVER w AS fd, first_value(location_raw) OVER w AS fl, first_value(date_posted) OVER w AS fp FROM extracted_jobs WINDOW w AS (PARTITION BY company_id ORDER BY job_id)),
        k AS (SELECT *, {_T('d[:1000]')} AS a, {_T('fd[:1000]')} AS b, {_T('l')} AS x, {_T('fl')} AS y, abs(date_diff('day', p, fp)) AS n FROM j)
        SELECT job_id, round(CASE WHEN coalesce(d, '') = '' AND coalesce(fd, '') = '' THEN 0.5 WHEN coalesce(d, '') = '' OR coalesce(fd, '') = '' THEN 0.0 ELSE {_J('a', 'b')} END, 6) AS by_text,
            round(CASE WHEN coalesce(l, '') = '' OR coalesce(fl, '') = '' THEN 0.5 ELSE {_J('x', 'y')} END, 6) AS by_place,
            CASE WHEN n IS NULL THEN 0.5 WHEN n = 0 THEN 1.0 WHEN n <= 14 THEN 0.8 WHEN n <= 90 THEN 0.5 ELSE 0.0 END::DOUBLE AS by_date FROM k""",
    "x14_richness": "SELECT job_id, CASE WHEN length(coalesce(description, '')) > 100 THEN 3 ELSE 0 END + " + " + ".join(f"CASE WHEN coalesce(CAST({c} AS VARCHAR), '') <> '' THEN {p} ELSE 0 END" for c, p in POINTS.items()) + " AS points FROM extracted_jobs",
    "x15_noise": f"SELECT job_id, coalesce(CASE WHEN length(t) > 0 THEN round(least(1.0, ({_N('&[a-z#0-9]+;')} + {_N(chr(92) + 's')})::DOUBLE / length(t) + 0.1 * {_N(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}), 4) END, 0.0)::DOUBLE AS noise FROM (SELECT job_id, description AS t FROM extracted_jobs)",
    "x16_gate": r"""
        WITH a AS (SELECT job_id, coalesce(description, '') AS t, list_filter(string_split(coalesce(description, ''), chr(10)), lambda x: trim(x) <> '') AS lines FROM extracted_jobs)
        SELECT job_id, length(t) >= 100 AND NOT regexp_matches(t[:400], '(?i)cookie|privacy policy|subscribe') AND len(regexp_extract_all(t, '\p{L}'))::DOUBLE / greatest(length(t), 1) >= 0.45
            AND (len(lines) < 5 OR len(list_filter(lines, lambda x: length(trim(x)) < 30))::DOUBLE / len(lines) <= 0.7) AS passes FROM a""",
    "x17_refusal": "SELECT row_id, regexp_matches(CASE WHEN row_id % 5 = 0 THEN 'I''m sorry, but ' ELSE '' END || coalesce(comment, ''), '" + tx.REFUSAL.replace("'", "''") + "') AS refusal FROM company_enrichment_rows",
    "x18_features": r"""
        SELECT job_id, length(t) AS n_chars, len(regexp_extract_all(t, '\S+')) AS n_words, len(regexp_extract_all(t, '\n')) AS n_breaks, len(regexp_extract_all(t, '[.!?](?:\s|$)')) AS n_sentences,
            round(len(regexp_extract_all(t, '[A-Z]'))::DOUBLE / greatest(length(t), 1), 6) AS upper_share, round(len(regexp_extract_all(t, '[0-9]'))::DOUBLE / greatest(length(t), 1), 6) AS digit_share,
            len(regexp_extract_all(t, '(?m)^\s*[•*-]\s')) AS n_bullets, len(regexp_extract_all(t, 'https?://')) AS n_links
        FROM (SELECT job_id, coalesce(description, '') AS t FROM extracted_jobs)""",
    "x19_valid_title": r"""
        SELECT job_id, length(t) BETWEEN 5 AND 200 AND NOT regexp_matches(t, '\S+@\S+\.\S+') AND NOT regexp_matches(t, '\{\{|\}\}|<%|%>|\$\{')
            AND NOT regexp_matches(lower(t), '^(?:home|about us|contact|careers|jobs|search|login|register|privacy policy|page not found)$')
            AND len(regexp_extract_all(t, '[\p{L}\p{N}]'))::DOUBLE / greatest(length(t), 1) >= 0.4 AS valid FROM (SELECT job_id, trim(coalesce(title, '')) AS t FROM extracted_jobs)""",
    "x20_cleaned": r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM documents",
    "x21_html_text": r"SELECT snapshot_path, trim(regexp_replace(" + "replace(" * len(tx.ENTITIES) + r"regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')" + "".join(f", '{e}', '{s.replace(chr(39), chr(39) * 2)}')" for e, s in tx.ENTITIES) + r", '\s+', ' ', 'g')) AS text FROM snapshot_files",
    "x22_visible_count": r"SELECT snapshot_path, CAST(coalesce(nullif(regexp_extract(html, '(?i)showing\s+\d+\s*[-–]\s*\d+\s+of\s+(\d+)', 1), ''), nullif(regexp_extract(html, '(?i)\b(\d+)\s+(?:jobs?|vacanc(?:y|ies)|positions?|openings?)\s+(?:found|available|match)', 1), ''), nullif(regexp_extract(html, '(?i)\b(?:jobs?|vacancies|openings)\s*\((\d+)\)', 1), '')) AS INTEGER) AS shown FROM snapshot_files",
    "x23_reply": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "x25_terms": r"""
        WITH a AS (SELECT job_id, location_raw AS r, list_filter(list_transform(string_split(location_raw, ','), lambda x: trim(x)), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(trim(location_raw), '\s+'), lambda w: w <> '') AS w FROM extracted_jobs)
        SELECT job_id, CASE WHEN r IS NULL THEN '' WHEN len(p) > 1 THEN array_to_string(p, '|') ELSE array_to_string(list_transform(range(least(len(w), 4), 0, -1), lambda k: array_to_string(w[:k], ' ')), '|') END AS terms FROM a""",
    "x26_market": "SELECT job_id, CASE " + " ".join(f"WHEN contains(p, ' {w} ') THEN '{m}'" for w, m in HINTS) + " END AS market FROM (SELECT job_id, ' ' || regexp_replace(lower(coalesce(location_raw, '')), '[^a-z0-9]+', ' ', 'g') || ' ' AS p FROM extracted_jobs)",
}
