"""Columns over free text."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a comparison of titles.
STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "in", "at", "to", "for", "with", "on", "is", "are", "we", "you", "our", "your", "this", "that", "as",
    "be", "will", "have", "has", "from", "by", "it", "its", "we're",
]

# States of Australia, its larger cities, and wordings of remote work in order of precedence.
AU_STATES = {"NSW": "New South Wales", "VIC": "Victoria", "QLD": "Queensland", "WA": "Western Australia", "SA": "South Australia", "TAS": "Tasmania", "ACT": "Australian Capital Territory", "NT": "Northern Territory"}
AU_CITIES = [
    "sydney", "melbourne", "brisbane", "perth", "adelaide", "canberra", "darwin", "hobart", "gold coast", "newcastle", "wollongong", "geelong", "townsville", "cairns",
    "toowoomba", "ballarat", "bendigo", "albury", "launceston", "mackay",
]
REMOTE = [
    ("fully_remote", r"\b(fully?\s*remote|100%\s*remote|all\s*remote)\b"),
    ("fully_remote", r"\b(remote\s*[\-–]\s*australia|work\s*from\s*home|wfh|anywhere\s*in\s*australia|remote\s*ok)\b"),
    ("hybrid", r"\b(hybrid|part[\s\-]remote|partially\s*remote)\b"),
    ("flexible", r"\b(flexible|flex\s*work|flexible\s*work)\b"),
    ("onsite", r"\b(on[\s\-]?site|in[\s\-]office|office[\s\-]based)\b"),
]

# Employment types by part of the word, in order of precedence.
EMPLOYMENT = [("full", "full_time"), ("part", "part_time"), ("contract", "contract"), ("temp", "temporary"), ("casual", "casual"), ("intern", "internship"), ("permanent", "permanent")]

# Entities resolved in regular expressions over markup.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

# A model's refusal.
REFUSAL = r"(?i)\b(?:i (?:can(?:no|')t|am unable to|'m unable to)|as an ai|i'm sorry,? but|no (?:job )?description (?:was )?found|unable to (?:extract|find))\b"

#: Ranges of wide characters (East Asian width W and F), in the order of their numbers.
WIDE = r"[\u1100-\u115F\u2E80-\u303E\u3041-\u33FF\u3400-\u4DBF\u4E00-\u9FFF\uA000-\uA4CF\uA960-\uA97C\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE6F\uFF01-\uFF60\uFFE0-\uFFE6]"


def text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def weighted_length(column: Column, weight: int = 3) -> Column:
    """Characters, wide ones counting ``weight`` times; null has 0."""
    return F.length(text(column)) + F.lit(weight - 1) * F.regexp_count(text(column), F.lit(WIDE))


def families(column: Column, patterns: dict[str, str]) -> list[Column]:
    """A flag for each family of wordings: one alternation each, so that the plan stays small."""
    return [text(column).rlike(p).alias(name) for name, p in patterns.items()]


def normal_title(column: Column) -> Column:
    """Lower case without brackets, what follows a dash or bar, and reference numbers."""
    out = F.lower(F.trim(text(column)))
    for pattern in (r"\(.*?\)", r"\[.*?\]", r"\s*[-–—/|]\s*.*$", r"(?:\b(?:ref|req|id)|#)\s*\w+"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_tokens(column: Column) -> Column:
    """The distinct words of more than two letters that are no stop words."""
    words = F.regexp_extract_all(F.lower(text(column)), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared of all words; two empty sets are alike, an empty and a filled one are not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def title_similarity(a: Column, b: Column) -> Column:
    return F.when(normal_title(a) == normal_title(b), 1.0).otherwise(jaccard(title_tokens(normal_title(a)), title_tokens(normal_title(b))))


def either_similarity(a: Column, b: Column, length: int | None, both: float, one: float) -> Column:
    """Jaccard of two texts (of their first ``length`` signs), with fixed values where both or one are missing."""
    cut = (lambda c: F.substring(c, 1, length)) if length else (lambda c: c)
    none_a, none_b = text(a) == "", text(b) == ""
    return F.when(none_a & none_b, both).when(none_a | none_b, one).otherwise(jaccard(title_tokens(cut(a)), title_tokens(cut(b))))


def date_proximity(a: Column, b: Column) -> Column:
    days = F.abs(F.datediff(a, b))
    return F.when(days.isNull(), 0.5).when(days == 0, 1.0).when(days <= 14, 0.8).when(days <= 90, 0.5).otherwise(0.0)


def richness_points(fields: dict[str, int], long_text: str = "description", long_points: int = 3) -> Column:
    """Points for filled fields, and for a text of more than 100 signs."""
    points = [F.when(text(F.col(c).cast("string")) != "", p).otherwise(0) for c, p in fields.items()]
    return reduce(lambda x, y: x + y, points, F.when(F.length(text(F.col(long_text))) > 100, long_points).otherwise(0))


def noise(column: Column) -> Column:
    """Share of entities and white space, and a tenth for each run of blank lines, up to 1; null and empty have 0."""
    raw = F.regexp_count(column, F.lit(r"&[a-z#0-9]+;")) + F.regexp_count(column, F.lit(r"\s"))
    runs = F.regexp_count(column, F.lit(r"\n\s*\n\s*\n"))
    return F.coalesce(F.when(F.length(column) > 0, F.round(F.least(F.lit(1.0), raw / F.length(column) + 0.1 * runs), 4)), F.lit(0.0))


def description_gate(column: Column, boilerplate: str = r"(?i)cookie|privacy policy|subscribe") -> Column:
    """At least 100 signs, no boilerplate in the first 400, enough letters, and not mostly short lines."""
    lines = F.filter(F.split(text(column), "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 30))
    letters = F.regexp_count(text(column), F.lit(r"\p{L}")) / F.greatest(F.length(text(column)), F.lit(1))
    return (F.length(text(column)) >= 100) & ~F.substring(text(column), 1, 400).rlike(boilerplate) & (letters >= 0.45) & ((F.size(lines) < 5) | (short / F.size(lines) <= 0.7))


def is_refusal(column: Column) -> Column:
    return text(column).rlike(REFUSAL)


def cleaned(column: Column) -> Column:
    """Uniform line ends, single blanks, trimmed lines, at most one empty line; null stays null."""
    out = F.regexp_replace(F.regexp_replace(column, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def html_to_text(column: Column) -> Column:
    """Visible text of markup: scripts and styles dropped, tags as blanks, common entities, single blanks."""
    out = F.regexp_replace(F.regexp_replace(column, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]*>", " ")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def visible_count(column: Column) -> Column:
    """The number of jobs a page says it shows; null if it says none."""
    patterns = [r"(?i)showing\s+\d+\s*[-–]\s*\d+\s+of\s+(\d+)", r"(?i)\b(\d+)\s+(?:jobs?|vacanc(?:y|ies)|positions?|openings?)\s+(?:found|available|match)", r"(?i)\b(?:jobs?|vacancies|openings)\s*\((\d+)\)"]
    return F.coalesce(*(F.nullif(F.regexp_extract(text(column), p, 1), F.lit("")) for p in patterns)).cast("int")


def valid_title(column: Column) -> Column:
    """5 to 200 signs, no address, template or page words, at least four tenths letters and digits."""
    t = F.trim(text(column))
    alnum = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")) / F.greatest(F.length(t), F.lit(1))
    page = F.lower(t).rlike(r"^(?:home|about us|contact|careers|jobs|search|login|register|privacy policy|page not found)$")
    return F.length(t).between(5, 200) & ~t.rlike(r"\S+@\S+\.\S+") & ~t.rlike(r"\{\{|\}\}|<%|%>|\$\{") & ~page & (alnum >= 0.4)


def employment_type(column: Column) -> Column:
    """The usual name of an employment type by the first part that occurs; null for others."""
    low = F.regexp_replace(F.lower(column), r"[\s_-]", "")
    out = F.lit(None).cast("string")
    for part, name in reversed(EMPLOYMENT):
        out = F.when(low.contains(part), F.lit(name)).otherwise(out)
    return out


def au_location(column: Column) -> Column:
    """A struct of what an Australian location names: remote_type, is_remote, postcode, state_abbr, city, is_ambiguous."""
    t = F.trim(column)
    remote = F.lit(None).cast("string")
    for name, pattern in reversed(REMOTE):
        remote = F.when(t.rlike("(?i)" + pattern), F.lit(name)).otherwise(remote)
    low = F.lower(t)
    whole = low.isin("remote", "nationwide")
    remote = F.when(remote.isNull() & whole, "fully_remote").otherwise(remote)
    codes = "|".join(AU_STATES)
    abbr = F.upper(F.nullif(F.regexp_extract(t, rf"(?i)\b({codes})\b", 1), F.lit("")))
    for code, name in reversed(AU_STATES.items()):
        abbr = F.coalesce(abbr, F.when(low.contains(name.lower()), F.lit(code)))
    before = F.nullif(F.trim(F.regexp_extract(t, rf"(?i)^([A-Z][a-zA-Z\s]+?)(?:\s*[,\-–]\s*|\s+)(?:{codes})\b", 1)), F.lit(""))
    city = F.when(F.length(before) > 1, F.initcap(before))
    for known in sorted(AU_CITIES, key=lambda c: (-len(c), AU_CITIES.index(c))):
        city = F.coalesce(city, F.when(low.contains(known), F.initcap(F.lit(known))))
    ambiguous = city.isNull() & low.contains("cbd")
    city = F.when(low.isin("australia", "au", "remote", "nationwide", "various"), None).otherwise(F.when(ambiguous, "CBD").otherwise(city))
    return F.struct(
        remote.alias("remote_type"),
        F.when(remote == "onsite", False).when(remote.isNotNull(), True).alias("is_remote"),
        F.nullif(F.regexp_extract(t, r"\b(\d{4})\b", 1), F.lit("")).alias("postcode"),
        abbr.alias("state_abbr"),
        city.alias("city"),
        F.coalesce(ambiguous, F.lit(False)).alias("is_ambiguous"),
    )


def keyword_tags(column: Column, keywords: list[str]) -> Column:
    """The keywords that occur as whole words, in the order given."""
    low = F.lower(text(column))
    escaped = lambda k: "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in k)
    return F.array_compact(F.array(*(F.when(low.rlike(rf"\b{escaped(k)}\b"), F.lit(k)) for k in keywords)))


def numeric_features(column: Column) -> Column:
    """A struct of counts and shares that a block classifier reads."""
    t = text(column)
    length = F.greatest(F.length(t), F.lit(1))
    words = F.regexp_count(t, F.lit(r"\S+"))
    return F.struct(
        F.length(t).alias("n_chars"), words.alias("n_words"), F.regexp_count(t, F.lit(r"\n")).alias("n_breaks"), F.regexp_count(t, F.lit(r"[.!?](?:\s|$)")).alias("n_sentences"),
        F.round(F.regexp_count(t, F.lit(r"[A-Z]")) / length, 6).alias("upper_share"), F.round(F.regexp_count(t, F.lit(r"[0-9]")) / length, 6).alias("digit_share"),
        F.regexp_count(t, F.lit(r"(?m)^\s*[•*-]\s")).alias("n_bullets"), F.regexp_count(t, F.lit(r"https?://")).alias("n_links"),
    )


def reply_object(column: Column) -> Column:
    """The JSON object in a model's reply: plain, fenced, or the first one in prose; null without one."""
    fenced = F.nullif(F.regexp_extract(text(column), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text(column), r"(?s)(\{.*\})", 1), F.lit("")))


def place_terms(column: Column, most: int = 4) -> Column:
    """Parts at commas; without commas the prefixes of the words, longest first."""
    parts = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")
    words = F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")
    n = F.least(F.size(words), F.lit(most))
    prefixes = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    return F.when(F.size(parts) > 1, parts).when(F.size(words) > 0, prefixes).otherwise(F.array().cast("array<string>"))


def hinted_market(column: Column, hints: list[tuple[str, str]]) -> Column:
    """The market of the first hint that stands in a text as words of their own; null if none does."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text(column)), r"[^a-z0-9]+", " "), F.lit(" "))
    out = F.lit(None).cast("string")
    for words, market in reversed(hints):
        out = F.when(F.instr(padded, f" {words} ") > 0, F.lit(market)).otherwise(out)
    return out


def flat_place(column: Column) -> Column:
    """A place of structured markup as text: city, region and country of its address, else its name; several places by commas; a plain text as it is; null and unreadable as ''."""
    read = F.try_parse_json(column)

    def one(v: Column) -> Column:
        get = lambda path: F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))
        parts = F.nullif(F.concat_ws(", ", *(get(f"$.address.{k}") for k in ("addressLocality", "addressRegion", "addressCountry"))), F.lit(""))
        whole = F.try_variant_get(v, "$", "string")
        return F.coalesce(parts, get("$.name"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), whole), F.lit(""))

    several = F.try_variant_get(read, "$", "array<variant>")
    joined = F.array_join(F.filter(F.transform(several, one), lambda x: x != ""), ", ")
    return F.coalesce(F.when(several.isNotNull(), joined), F.when(read.isNotNull(), one(read)), F.when(~F.trim(column).rlike(r"^[\[{]"), F.trim(column)), F.lit(""))
