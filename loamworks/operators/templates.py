"""Learned selectors: lists of them as typed, their use on pages, and how far two extractions agree."""

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .blocks import parse

#: Most rows read from a page by a wrapper, and the signs of a title and of another field.
ROWS, TITLE, FIELD = 500, (3, 300), (2, 499)
CONFIDENCE = 0.85
_SELECTOR = re.compile(r"^(?:\.?//)?([A-Za-z][\w-]*|\*)?(?:#([\w-]+))?((?:\.[\w-]+)*)(?:\[(\d+)\])?$")


def selector_list(column: Column) -> Column:
    """Selectors typed as a JSON array, a YAML list or a single one, as an array without empty and null entries; nothing gives an empty array."""
    text = F.trim(F.coalesce(column, F.lit("")))
    bare = lambda c: F.regexp_replace(F.trim(c), r"^['\"]+|['\"]+$", "")
    filled = lambda c: F.filter(F.transform(c, bare), lambda x: x.isNotNull() & ~x.isin("", "null", "None"))
    none = F.array().cast("array<string>")
    listed = F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), none))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.startswith("- "))
    yaml = F.when(text.startswith("---"), F.transform(lines, lambda x: F.substring(x, F.lit(3), F.length(x))))
    return filled(F.when(text.isin("", "null", "None", "[]"), none).otherwise(F.coalesce(listed, yaml, F.array(text))))


def _fits(node: dict, selector: str) -> bool:
    found = _SELECTOR.match(selector)
    if not found:
        return False
    tag, own, classes, _ = found.groups()
    return (not tag or tag in ("*", node["tag"])) and (not own or own == node["id"]) and set(classes.split(".")) - {""} <= set(node["classes"].split())


class Page:
    """A page's nodes with the range of nodes below each."""

    def __init__(self, html: str | None):
        tree = parse(html)
        self.nodes, self.texts = tree.nodes, tree.texts
        self.last = list(range(len(self.nodes)))
        for k in range(len(self.nodes) - 1, -1, -1):
            parent = self.nodes[k]["parent"]
            if parent >= 0:
                self.last[parent] = max(self.last[parent], self.last[k])

    def select(self, selector: str, within: int | None = None) -> list[int]:
        """The nodes a selector fits, in order: tag, #id and .classes, also as //tag[k]; its last step where it has several, which must lie below the ones before."""
        steps = [s for s in re.split(r"\s*>\s*|\s+|(?<=[\w\]])/+(?=[\w*])", selector.strip()) if s]
        own: list[int | None] = [within]
        for step in steps:
            place = _SELECTOR.match(step)
            found: list[int | None] = []
            for root in own:
                low, high = (0, len(self.nodes) - 1) if root is None else (root + 1, self.last[root])
                fits = [k for k in range(low, high + 1) if _fits(self.nodes[k], step)]
                found += fits[int(place[4]) - 1 : int(place[4])] if place and place[4] else fits
            own = list(dict.fromkeys(found))
        return [k for k in own if k is not None]

    def text(self, k: int) -> str:
        return " ".join(self.texts[self.nodes[k]["first"] : self.nodes[k]["end"]])

    def first_text(self, selectors: list[str], within: int | None, signs: tuple[int, int]) -> tuple[str | None, int | None]:
        """The first selector's first text of so many signs, and its node."""
        for selector in selectors:
            for k in self.select(selector, within)[:1]:
                if signs[0] <= len(text := self.text(k)) <= signs[1]:
                    return text, k
        return None, None


def templated(pages: DataFrame, page: str, html: str, template: dict[str, str]) -> DataFrame:
    """(page, fields, confidence): the text of the first element of each page that each field's selector fits; a page where none does gives no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, markup in zip(pdf.page, pdf.html, strict=True):
                own = Page(markup)
                fields = {f: own.text(found[0]) for f, s in template.items() if (found := own.select(s))}
                if fields:
                    rows.append((name, fields, CONFIDENCE))
            yield pd.DataFrame(rows, columns=["page", "fields", "confidence"])

    return spread(pages.select(F.col(page).alias("page"), F.col(html).alias("html"))).mapInPandas(read, "page string, fields map<string,string>, confidence double")


def accuracy(a: str, b: str, fields: list[str]) -> Column:
    """0 to 1: of the fields that two maps know, the share in which both are empty or one text holds the other; 0 without a field."""
    known, right = F.lit(0), F.lit(0)
    for f in fields:
        has = F.map_contains_key(a, f) | F.map_contains_key(b, f)
        x, y = (F.lower(F.trim(F.coalesce(F.element_at(c, f), F.lit("")))) for c in (a, b))
        known = known + F.when(has, 1).otherwise(0)
        right = right + F.when(has & (((x == "") & (y == "")) | ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))), 1).otherwise(0)
    return F.when(known > 0, right / known).otherwise(0.0)


def wrapped_rows(pages: DataFrame, page: str, html: str, boundary: list[str], title: list[str], link: list[str], fields: dict[str, list[str]], every: bool = False) -> DataFrame:
    """(page, position, title, source_url, fields) of the records that a wrapper reads from each page.

    The first boundary selector with matches cuts the records (the whole page
    without one); titles, links and fields are the first selector's first fit
    within a record. The link falls back to one in the title, then to the first.
    With ``every``, each fit of the first title selector is a record of its own.
    Records without a title of 3 to 300 signs are left out.
    """

    def titles(own: Page, root: int | None) -> list[tuple[str, int]]:
        if every:
            return [(t, k) for k in own.select(title[0], root) if TITLE[0] <= len(t := own.text(k)) <= TITLE[1]]
        text, at = own.first_text(title, root, TITLE)
        return [] if text is None else [(text, at)]

    def record(own: Page, root: int | None, base: str, text: str, at: int) -> tuple:
        anchors = [k for s in link for k in own.select(s, root)] + ([at] if own.nodes[at]["tag"] == "a" else own.select("a", at)) + own.select("a", root)
        href = next((h for k in anchors if (h := own.nodes[k]["href"]) and not re.match(r"(?i)#|javascript:|mailto:|tel:", h)), None)
        found = {f: t for f, s in fields.items() if (t := own.first_text(s, root, FIELD)[0]) is not None}
        return text, urljoin(base, href) if href else None, found

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, markup in zip(pdf.page, pdf.html, strict=True):
                own = Page(markup)
                roots = next((found for s in boundary if (found := own.select(s))), [None])
                records = [record(own, root, name, *found) for root in roots for found in titles(own, root)][:ROWS]
                rows += [(name, k, *x) for k, x in enumerate(records)]
            yield pd.DataFrame(rows, columns=["page", "position", "title", "source_url", "fields"])

    return spread(pages.select(F.col(page).alias("page"), F.col(html).alias("html"))).mapInPandas(read, "page string, position int, title string, source_url string, fields map<string,string>")
