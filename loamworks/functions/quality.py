"""A score of a job record from 0 to 100 with the ordered list of what it lacks."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text, weighted_length
from .urls import is_job_url

# Wordings that stand in for missing fields, one alternation each, and wordings that cap a score.
SIGNALS = {
    "location": r"(?i)\b(?:sydney|melbourne|brisbane|perth|adelaide|canberra|auckland|wellington|singapore|kuala lumpur|hong kong|manila|jakarta|bangkok|nationwide)\b",
    "employment_type": r"(?i)\b(?:full[\s-]?time|part[\s-]?time|casual|contract|permanent|temporary|internship)\b",
    "salary": r"(?i)(?:\$\s?\d|\b(?:salary|remuneration|per annum|per hour)\b)",
    "date": r"(?i)\b(?:posted|closing date|applications close|\d{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\b",
}
REQUIREMENTS = [r"(?i)\bexperience\b", r"(?i)\bapplicants should\b", r"(?i)\bqualifications?\b", r"(?i)\brequire(?:d|ments?)\b", r"(?i)\bskills?\b", r"(?i)\bwe expect\b", r"(?i)\bknowledge of\b"]
CAPS = {
    "scam": (10.0, r"(?i)\b(?:wire transfer|send money|no interview required|guaranteed (?:income|salary|earnings)|multi.?level marketing)\b"),
    "discrimination": (10.0, r"(?i)\b(?:males? only|females? only|no foreigners|native speakers only)\b"),
    "language": (15.0, r"(?i)\b(?:bastards?|idiots?|morons?)\b"),
}
GENERIC_TITLES = ["home", "careers", "jobs", "apply now", "contact us", "about us", "search results", "vacancies"]
STRUCTURE = r"(?im)^\s*[•\-*]\s+\w|^\s*\d+\.\s+\w"

#: Points of a description by its weighted length.
LENGTHS = [(800, 40), (500, 33), (300, 24), (150, 16), (50, 8)]


def quality() -> Column:
    """Struct (score, band, issues) of a row with title, description, location_raw, employment_type, salary_raw, date_posted and source_url."""
    title, body = F.trim(text(F.col("title"))), F.trim(text(F.col("description")))
    every, length = F.concat_ws(" ", F.nullif(F.col("title"), F.lit("")), F.nullif(body, F.lit(""))), weighted_length(F.trim(text(F.col("description"))))
    short, generic = F.length(title) < 3, F.rtrim(F.lower(title), F.lit("!.?")).isin(GENERIC_TITLES)
    by_length = F.lit(-3)
    for edge, points in reversed(LENGTHS):
        by_length = F.when(length >= edge, points).otherwise(by_length)
    structured = (length >= 100) & body.rlike(STRUCTURE)
    points = [F.when(short, 0).when(generic, 2).otherwise(15), F.when(is_job_url(F.col("source_url")), 5).otherwise(0), by_length, F.when(structured, 5).otherwise(0)]
    issues = [F.when(short, "title_missing_or_short").when(generic, "title_generic_page"), F.when(length < 50, "description_very_short"), F.when(structured, "description_well_structured")]
    fields = [("location", "location_raw", 10, 6, 2), ("employment_type", "employment_type", 8, 5, 1), ("salary", "salary_raw", 5, 3, 2)]
    for name, column, full, inferred, least in fields:
        given, said = F.length(F.trim(text(F.col(column)))) >= least, every.rlike(SIGNALS[name])
        points.append(F.when(given, full).when(said, inferred).otherwise(0))
        issues.append(F.when(given, None).when(said, f"{name}_inferred_from_description").otherwise(f"{name}_missing"))
    dated, said = F.col("date_posted").isNotNull(), every.rlike(SIGNALS["date"])
    points.append(F.when(dated, 3).when(said, 2).otherwise(0))
    issues.append(F.when(~dated & ~said, "date_posted_missing"))
    wanted = reduce(lambda a, b: a + b, (every.rlike(p).cast("int") for p in REQUIREMENTS)) >= 2
    embedded = (length >= 300) & wanted
    points.append(F.when(embedded, 10).when(length >= 150, 5).otherwise(0))
    issues.append(F.when(embedded, "requirements_embedded_in_description").when(length < 150, "requirements_missing"))
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, points).cast("double")))
    for name, (cap, pattern) in CAPS.items():
        met = every.rlike(pattern)
        score = F.when(met, F.least(score, F.lit(cap))).otherwise(score)
        issues.append(F.when(met, f"{name}_detected"))
    band = F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").when(score >= 20, "poor").otherwise("disqualified")
    return F.struct(score.alias("score"), band.alias("band"), F.array_join(F.array_compact(F.array(*issues)), ",").alias("issues"))


# Words that name an occupation, and parts of titles that are no job.
JOB_NOUNS = [
    "accountant", "administrator", "advisor", "analyst", "apprentice", "architect", "assistant", "associate", "auditor", "barista", "bookkeeper", "broker", "builder", "buyer", "carpenter", "cashier", "carer", "chef", "cleaner", "clerk", "coach",
    "consultant", "coordinator", "counsellor", "designer", "developer", "director", "dispatcher", "doctor", "driver", "editor", "electrician", "engineer", "estimator", "executive", "facilitator", "fitter", "foreman", "guard", "handler", "helper",
    "inspector", "instructor", "intern", "investigator", "labourer", "lawyer", "lecturer", "librarian", "machinist", "manager", "mechanic", "merchandiser", "midwife", "miner", "nurse", "officer", "operator", "optometrist", "painter",
    "paralegal", "paramedic", "pharmacist", "photographer", "physiotherapist", "pilot", "planner", "plumber", "porter", "president", "principal", "processor", "producer", "programmer", "receptionist", "recruiter", "registrar", "representative", "researcher",
    "scaffolder", "scientist", "secretary", "solicitor", "specialist", "strategist", "superintendent", "supervisor", "surgeon", "surveyor", "teacher", "technician", "technologist", "therapist", "trader", "trainer", "treasurer", "tutor",
    "underwriter", "veterinarian", "waiter", "welder", "worker", "writer",
]
NOT_JOBS = [
    "about us", "contact", "home", "menu", "search", "login", "sign up", "register", "our team", "meet the team", "leadership", "management", "our culture", "latest news", "blog", "news", "events", "press", "media",
    "our services", "products", "solutions", "partners", "clients", "privacy", "terms", "cookie", "disclaimer", "sitemap", "working at", "life at", "why join", "our values", "benefits", "view more", "read more", "learn more", "see all", "load more",
]
JOB_ADDRESS = r"/(?:job|position|vacancy|career|opening|role|apply)"


def is_real_job(title: Column, url: Column) -> Column:
    """Whether a row reads like a job: a title of at least five signs without a part that is none, and an occupation in it or a job's address. Nulls count as empty."""
    low = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    words = F.split(low, r"[\s/,\-–—()]+")
    named = F.arrays_overlap(words, F.array(*map(F.lit, JOB_NOUNS)))
    return (F.length(low) >= 5) & ~low.rlike("|".join(NOT_JOBS)) & (named | F.lower(F.coalesce(url, F.lit(""))).rlike(JOB_ADDRESS))
