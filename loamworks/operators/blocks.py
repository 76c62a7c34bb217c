"""Markup as a table of blocks, read in one pass, and selections over it."""

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.urls import is_job_url
from ..runtime import spread

VOID = {"br", "hr", "img", "input", "meta", "link", "source", "area", "base", "col", "embed", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "head"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = "page string, node int, parent int, depth int, tag string, id string, classes string, href string, own_text string, text string, link_chars int, n_links int, html_chars int, own_paragraphs int, n_paragraphs int"
LINKS = "page string, position int, url string, anchor string"
SCRIPTS = "page string, position int, kind string, body string"


class _Tree(HTMLParser):
    """Collects nodes; an unclosed element ends with its parent, a stray end tag is ignored."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        #: Where each line starts, so that places in lines become places in the page.
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.size = len(html)
        self.nodes: list[dict] = []
        #: Visible text in the order of the document; a node's own text and all below it are a range of it.
        self.texts: list[str] = []
        self.stack: list[int] = []
        self.scripts: list[tuple[str, str]] = []
        self.script: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "script":
            self.script = given.get("type", "")
        for open_tag in CLOSES.get(tag, ()):
            if self.stack and self.nodes[self.stack[-1]]["tag"] == open_tag:
                self._leave()
        parent = self.stack[-1] if self.stack else -1
        self.nodes.append({"tag": tag, "parent": parent, "depth": len(self.stack), "id": given.get("id", ""), "classes": " ".join(sorted(given.get("class", "").split())), "href": given.get("href", ""), "own": [], "attrs": given, "first": len(self.texts), "end": len(self.texts), "from": self._at(), "to": self._at() + len(self.get_starttag_text() or "")})
        if tag not in VOID:
            self.stack.append(len(self.nodes) - 1)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _leave(self, to: int | None = None) -> str:
        node = self.nodes[self.stack.pop()]
        node["end"], node["to"] = len(self.texts), self._at() if to is None else to
        return node["tag"]

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.script = None
        if any(self.nodes[k]["tag"] == tag for k in self.stack):
            # The end tag belongs to the element it closes alone.
            while self.nodes[self.stack[-1]]["tag"] != tag:
                self._leave()
            self._leave(self._at() + len(tag) + 3)

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.scripts.append((self.script, data))
        elif self.stack and not any(self.nodes[k]["tag"] in HIDDEN for k in self.stack) and data.strip():
            text = " ".join(data.split())
            self.nodes[self.stack[-1]]["own"].append(text)
            self.texts.append(text)

    def close(self) -> None:
        super().close()
        while self.stack:
            self._leave(self.size)


def parse(html: str | None) -> _Tree:
    tree = _Tree(html or "")
    tree.feed(html or "")
    tree.close()
    return tree


def node_rows(page: str, html: str | None) -> list[tuple]:
    """The rows of one page: each element with its own text, all text below it in the order of the document, and the share of it within links."""
    tree = parse(html)
    nodes, texts = tree.nodes, tree.texts
    linked, links, own, below = ([0] * len(nodes) for _ in range(4))
    # Children follow their parents, so one pass from the end gathers everything.
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if n["tag"] == "a":
            links[k] += 1
            linked[k] = sum(map(len, texts[n["first"] : n["end"]]))
        if n["parent"] >= 0:
            linked[n["parent"]] += linked[k]
            links[n["parent"]] += links[k]
            own[n["parent"]] += n["tag"] == "p"
            below[n["parent"]] += below[k] + (n["tag"] == "p")
    return [
        (page, k, n["parent"], n["depth"], n["tag"], n["id"], n["classes"], n["href"], " ".join(n["own"]), " ".join(texts[n["first"] : n["end"]]), linked[k], links[k], n["to"] - n["from"], own[k], below[k])
        for k, n in enumerate(nodes)
    ]


def _pages(df: DataFrame, page: str, html: str) -> DataFrame:
    return spread(df.select(F.col(page).alias("page"), F.col(html).alias("html")))


def blocks(pages: DataFrame, page: str, html: str) -> DataFrame:
    """One row an element of each page. Null and empty pages give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([row for p, h in zip(pdf.page, pdf.html, strict=True) for row in node_rows(p, h)], columns=names)

    return _pages(pages, page, html).mapInPandas(read, BLOCKS)


def page_links(pages: DataFrame, page: str, html: str, base: str | None = None) -> DataFrame:
    """The links of each page, resolved against its address; fragments, scripts, mail and phone links are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, h in zip(pdf.page, pdf.html, strict=True):
                for k, row in enumerate(r for r in node_rows(p, h) if r[4] == "a" and r[7] and not re.match(r"(?i)#|javascript:|mailto:|tel:", r[7])):
                    rows.append((p, k, urljoin(base or p, row[7]), row[9]))
            yield pd.DataFrame(rows, columns=["page", "position", "url", "anchor"])

    return _pages(pages, page, html).mapInPandas(read, LINKS)


def page_scripts(pages: DataFrame, page: str, html: str) -> DataFrame:
    """The script bodies of each page with their type."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, k, kind, body) for p, h in zip(pdf.page, pdf.html, strict=True) for k, (kind, body) in enumerate(parse(h).scripts)], columns=["page", "position", "kind", "body"])

    return _pages(pages, page, html).mapInPandas(read, SCRIPTS)


def _walk(value, kind: str, depth: int = 0) -> Iterator[dict]:
    """Objects of one type anywhere in a JSON value: in graphs, lists and nested keys."""
    if depth > 12:
        return
    if isinstance(value, list):
        for v in value:
            yield from _walk(v, kind, depth + 1)
    elif isinstance(value, dict):
        types = value.get("@type")
        if kind in (types if isinstance(types, list) else [types]):
            yield value
        else:
            for v in value.values():
                yield from _walk(v, kind, depth + 1)


def postings(scripts: DataFrame) -> DataFrame:
    """(page, title, location_raw, salary_raw, employment_type, date_posted, description, confidence) of the job postings in JSON-LD scripts; unreadable JSON gives none."""

    def place(v) -> str | None:
        v = v[0] if isinstance(v, list) and v else v
        address = v.get("address", v) if isinstance(v, dict) else v
        if isinstance(address, dict):
            parts = [address.get(k) for k in ("addressLocality", "addressRegion", "addressCountry")]
            return ", ".join(str(p.get("name") if isinstance(p, dict) else p) for p in parts if p) or None
        return str(address) if address else None

    def pay(v) -> str | None:
        if not isinstance(v, dict):
            return str(v) if v else None
        inner = v.get("value")
        if isinstance(inner, dict):
            low, high, unit = inner.get("minValue", inner.get("value")), inner.get("maxValue"), inner.get("unitText")
            return " ".join(str(x) for x in (v.get("currency"), f"{low} - {high}" if high else low, f"per {unit}".lower() if unit else None) if x) or None
        return " ".join(str(x) for x in (v.get("currency"), inner) if x) or None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page", "title", "location_raw", "salary_raw", "employment_type", "date_posted", "description", "confidence"]
        for pdf in batches:
            rows = []
            for page, body in zip(pdf.page, pdf.body, strict=True):
                try:
                    value = json.loads(body)
                except ValueError:
                    continue
                for job in _walk(value, "JobPosting"):
                    kind = job.get("employmentType")
                    rows.append((page, job.get("title"), place(job.get("jobLocation")), pay(job.get("baseSalary")), ", ".join(kind) if isinstance(kind, list) else kind, job.get("datePosted"), job.get("description"), 0.95))
            yield pd.DataFrame(rows, columns=names)

    schema = "page string, title string, location_raw string, salary_raw string, employment_type string, date_posted string, description string, confidence double"
    return scripts.where(F.lower("kind").contains("ld+json")).select("page", "body").mapInPandas(read, schema)


def repeating_groups(table: DataFrame, least: int = 3, linked: float = 0.6, text: int = 15) -> DataFrame:
    """Each page's best group of like siblings: at least ``least`` of one tag and class, most with links, of enough text; the score is links times mean length over 20."""
    grouped = table.where("parent >= 0").groupBy("page", "parent", "tag", "classes").agg(
        F.count("*").alias("items"), F.count_if(F.col("n_links") > 0).alias("with_links"), F.avg(F.length("text")).alias("mean_text")
    )
    good = grouped.where((F.col("items") >= least) & (F.col("with_links") >= linked * F.col("items")) & (F.col("mean_text") >= text))
    scored = good.withColumn("score", F.round(F.col("with_links") * F.col("mean_text") / 20, 6))
    order = Window.partitionBy("page").orderBy(F.desc("score"), "parent", "tag", "classes")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def container_scores(table: DataFrame, words: str = r"job|career|vacanc|position|opening") -> DataFrame:
    """(page, node, score) of elements from 5 on: 10 for a class that names jobs, 5 or 3 for like children, 3 for job links, 4 and the rows up to 10 for tables."""
    children = table.where("parent >= 0").groupBy("page", F.col("parent").alias("node"), "tag").agg(F.count("*").alias("n"), F.max(is_job_url(F.col("href")).cast("int")).alias("job"))
    best = children.groupBy("page", "node").agg(F.max("n").alias("like"), F.max("job").alias("job"))
    rows = table.where("tag = 'tr'").groupBy("page", F.col("parent").alias("node")).agg(F.count("*").alias("rows"))
    joined = table.select("page", "node", "tag", "classes").join(best, ["page", "node"], "left").join(rows, ["page", "node"], "left")
    score = (
        F.when(F.col("classes").rlike(words), 10).otherwise(0) + F.when(F.col("like") >= 5, 5).when(F.col("like") >= 3, 3).otherwise(0) + F.when(F.col("job") == 1, 3).otherwise(0)
        + F.when((F.col("tag") == "table") & F.col("rows").isNotNull(), 4 + F.least(F.col("rows"), F.lit(10))).otherwise(0)
    )
    return joined.select("page", "node", score.cast("int").alias("score")).where("score >= 5")


# Words of job texts.
JOB_TERMS = [
    "responsibilities", "requirements", "qualifications", "experience", "skills", "role", "position", "opportunity", "team", "company", "benefits", "salary", "location", "remote", "hybrid", "onsite", "degree", "candidate", "reporting",
    "collaborate", "passion", "ideal", "culture", "flexible", "competitive", "manage", "develop", "support", "lead", "join", "apply", "employment", "career", "permanent", "contract", "full-time", "part-time", "environment",
]


def density(table: DataFrame, k: int = 8, least: int = 100) -> DataFrame:
    """(page, node, length, score, place): each page's ``k`` densest blocks.

    The score is the length times the share of the markup that is text, the share
    of the text outside links, half and half of the share in sentences, a bonus for
    job words (up to a quarter above 0.75) and one for paragraphs below it (up to
    0.3). Blocks under ``least`` signs are left out.
    """
    body = table.where(F.col("tag").isin("div", "section", "article", "td", "main")).where(F.length("text") >= least)
    length = F.length("text")
    share = lambda part, whole: F.least(F.lit(1.0), part / F.greatest(F.lit(1), whole))
    sentences = F.length(F.array_join(F.regexp_extract_all("text", F.lit(r"([A-Z][^.!?]{15,}[.!?])"), F.lit(1)), ""))
    low = F.lower("text")
    words = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in JOB_TERMS), F.lit(0))
    # Paragraphs right below, and up to five anywhere below.
    bonus = 1 + F.least(F.lit(0.3), (F.col("own_paragraphs") + F.least(F.lit(5), F.col("n_paragraphs"))) * 0.05)
    score = length * share(length, F.col("html_chars")) * (1 - share(F.col("link_chars"), length)) * (0.5 + 0.5 * share(sentences, length)) * (0.75 + F.least(F.lit(0.25), words / 20)) * bonus
    scored = body.select("page", "node", length.alias("length"), F.round(score, 6).alias("score")).where("score > 0")
    order = Window.partitionBy("page").orderBy(F.desc("score"), F.desc("node"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def text_blocks(table: DataFrame, least: int = 100, most: int = 50) -> DataFrame:
    """(page, node, text): blocks of enough text, one for each beginning of 200 signs, the longest first."""
    start = F.substring("text", 1, 200)
    long = table.where(F.length("text") >= least).withColumn("start", start)
    one = long.groupBy("page", "start").agg(F.max(F.struct(F.length("text").alias("n"), "node", "text")).alias("b"))
    order = Window.partitionBy("page").orderBy(F.desc("b.n"), "b.node")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("page", "b.node", "b.text", "place")


def best_block(scored: DataFrame, least: float = 0.65, near: float = 0.9) -> DataFrame:
    """Of blocks (page, node, length, probability): among those within ``near`` of the page's best probability, if that reaches ``least``, the longest."""
    top = scored.groupBy("page").agg(F.max("probability").alias("top")).where(F.col("top") >= least)
    close = scored.join(top, "page").where(F.col("probability") >= near * F.col("top"))
    return close.groupBy("page").agg(F.max_by("node", F.struct("length", (-F.col("node")).alias("k"))).alias("node"))


def first_good(*layers: tuple[str, Column, float]) -> list[Column]:
    """(text, layer, confidence) of the first layer whose text passes the gate; layers are (name, text, confidence)."""
    good = [(n, F.when(tx.description_gate(c), c), p) for n, c, p in layers]
    text = F.coalesce(*(c for _, c, _ in good))
    name, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for n, c, p in reversed(good):
        name, confidence = F.when(c.isNotNull(), F.lit(n)).otherwise(name), F.when(c.isNotNull(), F.lit(p)).otherwise(confidence)
    return [text.alias("text"), name.alias("layer"), confidence.alias("confidence")]


def common_selectors(table: DataFrame, group: Column, least: int = 2) -> DataFrame:
    """(site, selector, pages): tag and class selectors found on every page of a site of at least ``least`` pages."""
    selector = F.concat_ws(".", "tag", F.when(F.col("classes") != "", F.replace("classes", F.lit(" "), F.lit("."))))
    own = table.select(group.alias("site"), "page", selector.alias("selector")).distinct()
    counts = own.groupBy("site", "selector").agg(F.count("*").alias("pages"))
    sizes = own.groupBy("site").agg(F.countDistinct("page").alias("all")).where(F.col("all") >= least)
    return counts.join(sizes, "site").where("pages = all").select("site", "selector", "pages")


# Signs of job platforms: patterns of addresses, texts and scripts, and the confidence.
SIGNATURES = [
    ("greenhouse", [r"boards\.greenhouse\.io", r"job-boards\.greenhouse\.io"], ["greenhouse", "gh_jboard"], [], 0.95),
    ("lever", [r"jobs\.lever\.co"], ["lever-jobs-container", "lever-job"], [], 0.95),
    ("workday", [r"myworkdayjobs\.com", r"wd\d+\.myworkdayjobs\.com"], ["workday", "wd-"], ["workday"], 0.95),
    ("bamboohr", [r"bamboohr\.com/careers", r"\.bamboohr\.com"], ["bamboo", "bamboohr"], [], 0.90),
    ("icims", [r"careers-\w+\.icims\.com", r"icims\.com"], ["icims", "icims"], [], 0.92),
    ("taleo", [r"taleo\.net"], ["taleo", r"oracle.*recruit"], [], 0.92),
    ("smartrecruiters", [r"careers\.smartrecruiters\.com"], ["smartrecruiters", "smart-apply"], [], 0.93),
    ("ashby", [r"jobs\.ashbyhq\.com"], ["ashby", "ashbyhq"], [], 0.94),
    ("jobvite", [r"jobs\.jobvite\.com"], ["jobvite"], [], 0.93),
    ("applynow", [r"applynow\.net\.au"], ["applynow", "applyboard"], [], 0.88),
    ("pageup", [r"pageuppeople\.com"], ["pageup", "pageuppeople", "pua-table"], [], 0.90),
    ("jazzhr", [r"jazzhr\.com", r"app\.jazz\.co"], ["jazzhr", "jazz-"], [], 0.90),
]


def signatures(pages: DataFrame, page: str, url: Column, html: Column, rules: list = SIGNATURES) -> DataFrame:
    """(page, platform, points, confidence): the first platform whose signs reach two points.

    A sign of the address counts 2, of the text and of scripts 1, searched in the
    address, the visible text and the addresses of scripts and links. A point more
    adds 0.01 to the platform's confidence, up to 0.99. A page without a platform
    takes that of the first frame with a platform's address, at 0.9 of its
    confidence and 0 points.
    """
    every = lambda tag, key: F.array_join(F.regexp_extract_all(html, F.lit(rf'(?i)<{tag}\b[^>]*\s{key}="([^"]*)"'), F.lit(1)), " ")
    scripts = every("script", "src")
    seen = F.lower(F.concat_ws(" ", url, tx.html_to_text(html), scripts, every("a", "href")))
    frames = F.lower(every("iframe", "src"))
    own = pages.select(F.col(page).alias("page"), seen.alias("seen"), F.lower(scripts).alias("scripts"), frames.alias("frames"))
    points = lambda urls, texts, own_scripts: sum((F.when(F.col(c).rlike(p), n).otherwise(0) for c, n, patterns in (("seen", 2, urls), ("seen", 1, texts), ("scripts", 1, own_scripts)) for p in patterns), F.lit(0))
    counted = own.select("page", F.array(*(points(u, t, c) for _, u, t, c, _ in rules)).alias("points"), F.array(*(F.col("frames").rlike("|".join(u)) for _, u, *_ in rules)).alias("framed"))
    # The first platform with enough points, else the first with a frame; places count from 1, 0 is none.
    first = F.array_position(F.transform("points", lambda p: p >= 2), True)
    placed = counted.select("page", "points", first.alias("seen"), F.array_position("framed", True).alias("framed"))
    names, bases = F.array(*(F.lit(r[0]) for r in rules)), F.array(*(F.lit(r[4]) for r in rules))
    at = F.when(F.col("seen") > 0, F.col("seen")).otherwise(F.col("framed")).cast("int")
    own_points = F.when(F.col("seen") > 0, F.element_at("points", at)).otherwise(0).cast("int")
    found = placed.where("seen > 0 or framed > 0").select("page", at.alias("at"), own_points.alias("points"), (F.col("seen") > 0).alias("seen"))
    confidence = F.when(F.col("seen"), F.least(F.lit(0.99), F.element_at(bases, F.col("at")) + 0.01 * (F.col("points") - 2))).otherwise(F.element_at(bases, F.col("at")) * 0.9)
    return found.select("page", F.element_at(names, F.col("at")).alias("platform"), "points", F.round(confidence, 6).alias("confidence"))


def excerpt(table: DataFrame, tag: str, most: int = 400) -> DataFrame:
    """(page, excerpt): up to ``most`` signs of the text of each page's first element of a tag."""
    return table.where(F.col("tag") == tag).groupBy("page").agg(F.substring(F.min_by("text", "node"), 1, most).alias("excerpt"))


def is_shell(html: Column) -> Column:
    """Whether a page is an empty frame that scripts fill: little text, and a mount point or many scripts."""
    visible = F.length(tx.html_to_text(html))
    return (visible < 200) & (html.rlike(r"(?i)id=\"(?:root|app|__next|__nuxt)\"") | (F.regexp_count(html, F.lit("(?i)<script")) >= 3))


def paging_kind(html: Column) -> Column:
    """How a page goes on: next link, numbered pages, load-more button, or none."""
    low = F.lower(html)
    return F.when(low.rlike(r"rel=\"next\"|>\s*next\b|next job"), "next").when(low.rlike(r"[?&](?:page|p|pg)=\d+|showing \d+-\d+ of"), "numbered").when(low.rlike(r"load more|show more"), "more").otherwise("none")
