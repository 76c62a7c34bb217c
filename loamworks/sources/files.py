"""Readers of landed files, and routing of their rows. Nothing here fetches anything."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import market_of, normal_domain

BOM = "﻿"


def csv_rows(spark: SparkSession, path: str, required: Sequence[str], allowed: Sequence[str] | None = None) -> DataFrame:
    """A CSV with header as text columns; a byte order mark and blanks around names are dropped.

    Raises ``ValueError`` where a required column is missing. Columns that are not
    allowed are left out.
    """
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*(c.replace(BOM, "").strip().lower() for c in df.columns))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.select(*(c for c in df.columns if allowed is None or c in allowed))


def mostly_blank(df: DataFrame, columns: Sequence[str], most: float = 0.5) -> bool:
    """Whether any column is blank in more than ``most`` of the rows, in one aggregate; no rows count as blank."""
    blank = [F.avg((F.trim(F.coalesce(F.col(c), F.lit(""))) == "").cast("int")).alias(c) for c in columns]
    row = df.agg(*blank).first()
    return any(row[c] is None or row[c] > most for c in columns)


def routed(df: DataFrame, name: str, origin: str, excluded: DataFrame, blocked: Sequence[str]) -> DataFrame:
    """``df`` with its domain and a status: skipped (no name or origin), blocked, excluded, else accepted. ``excluded`` holds domains."""
    domain = normal_domain(F.col(origin))
    own = df.withColumn("domain", domain)
    listed = excluded.select(F.col("domain"), F.lit(True).alias("__listed")).distinct()
    blank = (F.trim(F.coalesce(F.col(name), F.lit(""))) == "") | (F.coalesce(F.col("domain"), F.lit("")) == "")
    status = F.when(blank, "skipped").when(F.col("domain").isin(list(blocked)), "blocked").when(F.col("__listed"), "excluded").otherwise("accepted")
    return own.join(listed, "domain", "left").withColumn("status", status).drop("__listed")


def queued(rows: DataFrame, done: DataFrame, time: str, since: Column) -> DataFrame:
    """``rows`` (company, country, ...) with trimmed names and a status: ``done`` where the same company and country, in either case, were done since a time, else ``pending``. Rows without a company are left out; a null country matches none."""
    plain = lambda c: F.lower(F.trim(c))
    recent = done.where(F.col(time) >= since).select(plain("company").alias("__c"), plain("country").alias("__l"), F.lit(True).alias("__done")).distinct()
    own = rows.withColumns({"company": F.trim("company"), "country": F.trim("country")}).where(F.coalesce("company", F.lit("")) != "")
    met = own.join(recent, (F.lower("company") == F.col("__c")) & (F.lower("country") == F.col("__l")), "left")
    return met.withColumn("status", F.when(F.col("__done"), "done").otherwise("pending")).drop("__c", "__l", "__done")


def first_domains(lines: DataFrame, column: str, order: str) -> DataFrame:
    """(domain, first): the distinct domains of typed lines with the place of the first; a heading ``domain`` and blank lines are left out."""
    own = lines.select(normal_domain(F.col(column)).alias("domain"), F.col(order).alias("first")).where("domain <> '' and domain <> 'domain'")
    return own.groupBy("domain").agg(F.min("first").alias("first"))


def domain_lines(spark: SparkSession, path: str) -> DataFrame:
    """First-seen domains of a one-column file."""
    lines = spark.read.option("header", False).schema("line string").csv(path)
    return first_domains(lines.select(F.replace(F.col("line"), F.lit(BOM), F.lit("")).alias("line"), F.monotonically_increasing_id().alias("n")), "line", "n")


def ranked_domains(df: DataFrame, rank: str, domain: str, skip: Sequence[str] = ()) -> DataFrame:
    """(domain, rank, market) of ranked domains that end in a market's ending and are not skipped; the best rank of each."""
    own = df.select(normal_domain(F.col(domain)).alias("domain"), F.col(rank).cast("long").alias("rank")).withColumn("market", market_of(F.col("domain")))
    return own.where(F.col("market").isNotNull() & ~F.col("domain").isin(list(skip))).groupBy("domain", "market").agg(F.min("rank").alias("rank"))


def registered(df: DataFrame, name: str, status: str, ending: str = "com.au") -> DataFrame:
    """(name, domain): rows of a registry that are registered, with a domain guessed from the name without its legal form."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"\b(?:pty|ltd|limited|inc|co|the)\b\.?", ""), r"[^a-z0-9]+", "")
    return df.where(F.upper(status).isin("REGD", "REGISTERED")).select(F.col(name).alias("name"), F.concat(slug, F.lit(f".{ending}")).alias("domain")).where(F.length("domain") > len(ending) + 1)


# Feature classes and codes of a public gazetteer that name places, and its columns read.
PLACE_CODES = ["ADM1", "ADM2", "PCLI", "PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLS", "PPLX"]
GAZETTEER = {0: "id", 1: "name", 2: "ascii_name", 3: "alternates", 4: "lat", 5: "lng", 6: "class", 7: "code", 8: "country", 10: "admin", 14: "population"}


def gazetteer_rows(spark: SparkSession, path: str, most_names: int = 15) -> DataFrame:
    """Places of a tab-separated gazetteer of at least 19 fields, with up to so many alternative names."""
    fields = F.split("value", "\t")
    column = lambda i: fields[i]
    raw = spark.read.text(path).where(F.size(fields) >= 19).select(*(column(i).alias(n) for i, n in GAZETTEER.items()))
    kept = raw.where(F.col("class").isin("A", "P") & F.col("code").isin(PLACE_CODES))
    names = F.slice(F.filter(F.split("alternates", ","), lambda x: x != ""), 1, most_names)
    return kept.select(
        F.col("id").try_cast("long").alias("id"), "name", "ascii_name", names.alias("alt_names"), F.col("lat").try_cast("decimal(10,7)").alias("lat"), F.col("lng").try_cast("decimal(10,7)").alias("lng"),
        "code", "country", "admin", F.col("population").try_cast("long").alias("population"),
    )


MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("domain", "url", "snapshot_path", "ats_platform")]
    + [T.StructField("expected_titles", T.ArrayType(T.StringType())), T.StructField("expected_job_count", T.IntegerType())]
)


def snapshots(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """The rows of a JSON manifest with the text of the file each names; null where there is none."""
    listed = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest)
    files = spark.read.text(folder, wholetext=True).select(F.col("value").alias("html"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("__file"))
    return listed.withColumn("__file", F.regexp_extract("snapshot_path", r"([^/]+)$", 1)).join(files, "__file", "left").drop("__file")


def folded(df: DataFrame, keep: Sequence[str], into: str = "selectors") -> DataFrame:
    """``df`` with every column not kept folded into one map of its filled values."""
    rest = [c for c in df.columns if c not in keep]
    pairs = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest)))
    return df.select(*keep, F.map_filter(pairs, lambda _, v: v.isNotNull() & (F.trim(v) != "")).alias(into))


# Shapes of landed job boards: where the list is, the paths of each field below an entry (the first filled
# one counts; several joined by "+" are written with a blank between them), and the confidence of the board.
BOARDS = {
    "flat": (["jobs"], {"external_id": ["id"], "source_url": ["absolute_url"], "title": ["title"], "location_raw": ["location.name"], "description": ["content"], "department": ["departments[0].name"], "date_posted": ["updated_at"]}, 0.98),
    "postings": (["postings", ""], {"external_id": ["id"], "source_url": ["hostedUrl"], "title": ["text"], "location_raw": ["categories.location"], "description": ["descriptionPlain"], "department": ["categories.department"], "employment_type": ["categories.commitment"]}, 0.98),
    "paths": (["jobPostings"], {"external_id": ["externalPath"], "source_url": ["externalPath"], "title": ["title"], "location_raw": ["locationsText"], "employment_type": ["timeType"]}, 0.95),
    "openings": (["result"], {"external_id": ["id"], "title": ["jobOpeningName", "title"], "location_raw": ["location.city", "location"], "department": ["department.label", "department"], "employment_type": ["employmentStatusLabel"]}, 0.96),
    "named": (["jobPostings"], {"external_id": ["id"], "source_url": ["jobUrl"], "title": ["title"], "location_raw": ["locationName"], "description": ["descriptionHtml"], "department": ["departmentName"], "employment_type": ["employmentType"], "salary_raw": ["compensationTierSummary"]}, 0.97),
    "content": (["content"], {"external_id": ["id"], "title": ["name"], "location_raw": ["location.city+location.country"], "department": ["department.label"], "employment_type": ["typeOfEmployment.label"], "date_posted": ["releasedDate"]}, 0.96),
    "requisitions": (["requisitions"], {"external_id": ["id"], "source_url": ["applyUrl"], "title": ["title"], "location_raw": ["location"], "department": ["category"], "date_posted": ["date"]}, 0.93),
    "search": (["searchResults"], {"external_id": ["jobId"], "source_url": ["jobDetailUrl"], "title": ["title"], "location_raw": ["city"], "department": ["category"], "date_posted": ["datePosted"]}, 0.92),
    "feed": (["jobs", "results", ""], {"external_id": ["id", "ref"], "source_url": ["url", "apply_link"], "title": ["title", "position_title"], "location_raw": ["location", "suburb"], "employment_type": ["work_type", "employment_type"], "department": ["department"], "date_posted": ["advertise_from", "date_posted"]}, 0.93),
    "items": (["jobs", "items", ""], {"external_id": ["id", "ref"], "source_url": ["url", "link"], "title": ["title", "position"], "location_raw": ["location", "suburb"], "employment_type": ["employment_type", "work_type"], "department": ["category", "department"]}, 0.90),
}
BOARD_FIELDS = ["external_id", "source_url", "title", "location_raw", "description", "department", "employment_type", "salary_raw", "date_posted"]


def board_jobs(df: DataFrame, body: str, board: str) -> DataFrame:
    """Job rows of landed JSON replies of one board, in one shape for all; replies that cannot be read and missing fields give nothing. Dates are cut to the day, ids in paths to the last step."""
    roots, fields, confidence = BOARDS[board]
    reply = F.try_parse_json(F.col(body))
    own = df.select(F.explode(F.coalesce(*(F.try_variant_get(reply, f"$.{r}" if r else "$", "array<variant>") for r in roots))).alias("e"))
    get = lambda path: F.nullif(F.trim(F.try_variant_get(F.col("e"), f"$.{path}", "string")), F.lit(""))
    # Where a board writes a text or an object in one place, the object is read by its own path.
    plain = lambda path: F.when(~F.schema_of_variant(F.try_variant_get(F.col("e"), f"$.{path}", "variant")).startswith("OBJECT"), get(path))
    one = lambda path: plain(path) if "+" not in path else F.nullif(F.concat_ws(" ", *(get(p) for p in path.split("+"))), F.lit(""))

    def field(name: str) -> Column:
        value = F.coalesce(*(one(p) for p in fields[name])) if name in fields else F.lit(None).cast("string")
        return F.substring(value, 1, 10) if name == "date_posted" else F.substring_index(value, "/", -1) if name == "external_id" else value

    return own.select(*(field(n).alias(n) for n in BOARD_FIELDS), F.lit(confidence).alias("extraction_confidence"), F.lit("ats_api").alias("extraction_method"))


def outbound(links: DataFrame, own_domains: Sequence[str], host: Column) -> DataFrame:
    """Links that lead off a page's own sites."""
    inside = F.lit(False)
    for d in own_domains:
        inside = inside | (host == d) | host.endswith(f".{d}")
    return links.where(~inside & (host != ""))
