"""Columns over URLs and domains."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = [
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au", "co.nz", "net.nz", "org.nz", "co.uk", "ac.uk", "gov.uk", "org.uk",
    "com.sg", "edu.sg", "gov.sg", "com.my", "edu.my", "gov.my", "com.hk", "edu.hk", "gov.hk",
]

# Path segments that are no job id.
NO_ID = ["jobs", "careers", "apply", "job", "position", "detail", "search", "listing", "vacancy", "opportunity", "folder"]

# Query parameters of trackers, and of paging.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "source"]
PAGING = ["page", "p", "pg", "offset", "start", "from", "skip"]

# URLs that carry a job's own number.
JOB_URL = (
    r"(?i)/jobs?/\d+|/jobs?/[\w\-]+\d{3,}|/careers?/\d+|/careers?/[\w\-]+-\d{3,}|/openings?/\d+|/positions?/\d+|/vacancies?/\d+"
    r"|[?&]jid=\w+|[?&]job_id=\w+|[?&]jobId=\w+|[?&]id=\d{4,}|/[\w\-]+-\d{4,}(?:/|$)"
)

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host(url: Column) -> Column:
    """Lower-case host; '' for a null or a URL without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, SCHEME + r"([^/?#:]+)", 1), F.lit("")))


def path(url: Column) -> Column:
    """Path without query and fragment; '' where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), SCHEME + r"[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """The query without its question mark; '' where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)


def registrable_domain(url_or_host: Column) -> Column:
    """The last two labels of a host, three below a public suffix of two labels; null gives ''."""
    text = F.coalesce(url_or_host, F.lit(""))
    own = F.when(F.instr(text, "://") > 0, host(text)).otherwise(F.ltrim(F.lower(F.trim(text)), F.lit(".")))
    labels = F.split(own, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) <= 2, own).when(last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def normal_domain(text: Column) -> Column:
    """A typed domain without scheme, path, www., port and blanks, in lower case."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[/?#].*$", ""), r":\d+$", ""), r"^www\.", "")


def blocked(url: Column, domains: list[str]) -> Column:
    """Whether a URL's host is a listed domain or below one; a URL without host is blocked."""
    own = F.regexp_replace(host(url), r"^www\.", "")
    below = [own.endswith(f".{d}") for d in domains]
    out = (own == "") | own.isin(domains)
    for x in below:
        out = out | x
    return out


def url_job_id(url: Column) -> Column:
    """The last path segment that is a number, or a code of at least four signs with a digit; null if none."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    code = lambda s: s.rlike(r"^[0-9]+$") | (s.rlike(r"^\w{2,}[-\w]*$") & s.rlike(r"\d") & (F.length(s) >= 4) & ~F.lower(s).isin(NO_ID))
    return F.lower(F.get(F.filter(F.reverse(segments), code), F.lit(0)))


def is_job_url(url: Column) -> Column:
    """Whether a URL looks like one job's own page; null gives false."""
    return F.coalesce(url, F.lit("")).rlike(JOB_URL)


def is_detail_path(url: Column) -> Column:
    """Whether the path leads below a listing."""
    return F.lower(path(url)).rlike(r"/(?:jobs?|careers?|vacanc(?:y|ies)|positions?|openings?|opportunit(?:y|ies))/[^/]+")


def career_score(url: Column, text: Column) -> Column:
    """0 to 1: how likely a link leads to a career page, by words of its path and text; files give 0."""
    low_path, low_text = F.lower(path(url)), F.lower(F.coalesce(text, F.lit("")))
    by_path = F.when(low_path.rlike(r"career|jobs?(?:/|$)|vacanc|work-with-us|join-us"), 0.45).when(low_path.rlike(r"about|people|team|opportunit"), 0.2).otherwise(0.0)
    by_text = F.when(low_text.rlike(r"career|jobs?\b|vacanc|work with us|join us"), 0.4).when(low_text.rlike(r"about|people|team|opportunit"), 0.15).otherwise(0.0)
    both = F.when((by_path > 0) & (by_text > 0), 0.1).otherwise(0.0)
    asset = low_path.rlike(r"\.(?:pdf|docx?|jpe?g|png|gif|zip|css|js|xml)$")
    return F.when(asset, 0.0).otherwise(F.least(F.lit(1.0), F.round(by_path + by_text + both, 2)))


def normal_url(url: Column) -> Column:
    """Without fragment, tracking parameters and a trailing slash; mail, phone and script links are null."""
    base = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"\?.*$", "")
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(TRACKING)), "&")
    joined = F.concat(F.regexp_replace(base, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(F.lower(F.trim(url)).rlike(r"^(?:javascript|mailto|tel):|^#"), None).otherwise(joined)


def likely_job_url(url: Column, listing: Column) -> Column:
    """Not the listing's own path, at least two segments, no search or feed page."""
    segments = F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
    return (path(url) != path(listing)) & (segments >= 2) & ~F.lower(url).rlike(r"/(?:search|login|register|category|tag|feed|rss)(?:/|$|\?)")


def market_of(domain: Column) -> Column:
    """The market of a domain's ending; null for others."""
    out = F.lit(None).cast("string")
    # Endings of markets, the longer first.
    for ending, market in [(".com.au", "AU"), (".co.nz", "NZ"), (".com.sg", "SG"), (".com.my", "MY"), (".com.hk", "HK"), (".com.ph", "PH"), (".co.id", "ID"), (".co.th", "TH"), (".au", "AU"), (".nz", "NZ"), (".sg", "SG"), (".my", "MY"), (".hk", "HK"), (".ph", "PH"), (".id", "ID"), (".th", "TH")][::-1]:
        out = F.when(F.lower(domain).endswith(ending), F.lit(market)).otherwise(out)
    return out


def name_of(domain: Column) -> Column:
    """A readable name from a domain's first label."""
    return F.initcap(F.regexp_replace(F.split(registrable_domain(domain), r"\.")[0], r"[-_]+", " "))


def has_paging(url: Column) -> Column:
    """Whether the query turns pages."""
    return F.lower(F.coalesce(url, F.lit(""))).rlike(r"[?&](?:" + "|".join(PAGING) + r")=\d+")
