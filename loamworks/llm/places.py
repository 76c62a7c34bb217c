"""Free-entered places mapped to a reference list: a trie of its names searched with a Levenshtein automaton.

The trie holds every name of every entry (name, ascii name, alternative names,
abbreviated first words). A typed value is cut into the places it names; each is
looked up as it stands, then by running the automaton of its letters over the
trie, which returns all names within a distance that depends on the length. The
entries found are reconciled along the parents, and the most specific one named is
the answer. Only distinct values are searched.
"""

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage

# Values that name no place.
NO_PLACE = re.compile(
    r"(?:(?:fully |100% |permanently )?(?:remote|work from home|wfh|home ?-?based|anywhere|flexible|nationwide|negotiable|tbc|tba|to be confirmed|to be advised"
    r"|see (?:description|advert|ad|below)|various|multiple|various locations|multiple locations|all (?:sites|locations)|n/?a|none|null|unknown|not specified|hybrid|on-?site|-+|\.|\?)"
    r"(?: (?:role|position|work|only|ok|possible))?[\s,/.-]*)+"
)
# Words around a place that are no part of it.
AROUND = re.compile(
    r"\(\s*(?:\d+ days? (?:from|at) home|remote|hybrid|wfh|flexible)[^)]*\)|\b\d+ days? (?:from|at) home\b"
    r"|^(?:hybrid|remote|on-?site|onsite|wfh)\b\s*[-,:/|]?|\b(?:near|close to|around|greater|regional|inner|outer|based in|located in)\b"
    r"|\b(?:area|cbd|wide|surrounds|and surrounds|metro|suburbs|hybrid|remote|on-?site)\b|\b\d{3,6}\b"
)
# First words and their short forms.
SHORT_FORMS = {"mount": "mt", "saint": "st", "port": "pt", "north": "nth", "south": "sth", "new": "nw", "lake": "lk", "east": "e", "west": "w", "fort": "ft"}
CUT = re.compile(r"[,/|>;()]+|\s[-–—]\s|\s-|-\s")
#: Least lengths at which one and two edits are allowed.
ONE_EDIT, TWO_EDITS = 5, 11
#: Entries of a reference list that every task may hold; values searched by one task.
ENTRIES, VALUES = 500_000, 2_000
_tries: dict = {}
PARSED = "location_raw string, market_code string, n long, geo_id long, distance int"


def plain(text: str) -> str:
    """Lower case without accents; twice-encoded letters are restored first."""
    if "Ã" in text or "Â" in text or "Å" in text or "Ä" in text:
        for damage in ("cp1252", "latin-1"):
            try:
                text = text.encode(damage).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    text = unicodedata.normalize("NFKD", text.replace("đ", "d").replace("ø", "o").replace("ł", "l"))
    return " ".join("".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower().replace("'", "").replace(".", " ").split())


class Gazetteer:
    """The reference list and the trie of its names."""

    def __init__(self, entries: list[tuple]):
        """``entries``: (geo_id, level, names, parent_id, market_code, population)."""
        self.level, self.parent, self.market, self.population = {}, {}, {}, {}
        self.names: dict[str, set[int]] = {}
        self.root: dict = {}
        for geo_id, level, names, parent, market, population in entries:
            self.level[geo_id], self.parent[geo_id], self.market[geo_id], self.population[geo_id] = level or 0, parent, market, population or 0
            for name in names:
                for form in self._forms(plain(name or "")):
                    self.names.setdefault(form, set()).add(geo_id)
        #: Longer texts than this and the edits allowed are near no name.
        self.longest = max(map(len, self.names), default=0)
        for name in self.names:
            node = self.root
            for letter in name:
                node = node.setdefault(letter, {})
            node[""] = name
        self.near = lru_cache(50_000)(self._near)

    @staticmethod
    def _forms(name: str) -> list[str]:
        if not name:
            return []
        first, _, rest = name.partition(" ")
        other = SHORT_FORMS.get(first) or next((k for k, v in SHORT_FORMS.items() if v == first), None)
        return [name, f"{other} {rest}"] if rest and other else [name]

    def _near(self, word: str, edits: int) -> tuple[tuple[int, str], ...]:
        """(distance, name) of all names within ``edits`` of ``word``, a swap of neighbours being one edit.

        The automaton's states are the reachable (letters read, edits) kept as a
        row of distances; a branch ends where no state is left.
        """
        n, found = len(word), []
        stack = [(child, letter, list(range(n + 1)), None, "") for letter, child in self.root.items() if letter]
        while stack:
            node, letter, row, before, last = stack.pop()
            depth_row = [row[0] + 1]
            for j in range(1, n + 1):
                d = min(row[j] + 1, depth_row[j - 1] + 1, row[j - 1] + (word[j - 1] != letter))
                if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == letter:
                    d = min(d, before[j - 2] + 1)
                depth_row.append(d)
            if min(depth_row) > edits:
                continue
            for x, child in node.items():
                if x:
                    stack.append((child, x, depth_row, row, letter))
                elif depth_row[n] <= edits:
                    found.append((depth_row[n], child))
        return tuple(sorted(found))

    def ancestors(self, geo_id: int) -> set[int]:
        out: set[int] = set()
        while (geo_id := self.parent.get(geo_id)) is not None and geo_id not in out:
            out.add(geo_id)
        return out

    def lookup(self, part: str, fuzzy: bool) -> tuple[set[int], int]:
        """The entries a typed part may name, and the distance."""
        if part in self.names:
            return self.names[part], 0
        edits = 2 if len(part) >= TWO_EDITS else 1 if len(part) >= ONE_EDIT else 0
        if not fuzzy or not edits or len(part) > self.longest + edits:
            return set(), 0
        near = self.near(part, edits)
        # A slip seldom makes a name of another length class; short names need one edit.
        near = [(d, name) for d, name in near if len(name) >= ONE_EDIT and (d < 2 or len(name) >= TWO_EDITS - 1)]
        if not near:
            return set(), 0
        least = near[0][0]
        return set().union(*(self.names[name] for d, name in near if d == least)), least

    def parts(self, segment: str) -> list[tuple[str, set[int], int]]:
        """The places a segment names: itself, or several names written one after the other."""
        for fuzzy in (False, True):
            found, d = self.lookup(segment, fuzzy)
            if found:
                return [(segment, found, d)]
            words = segment.split(" ")
            for k in range(len(words) - 1, 0, -1):
                head, hd = self.lookup(" ".join(words[:k]), fuzzy)
                if head:
                    tail, td = self.lookup(" ".join(words[k:]), fuzzy)
                    if tail:
                        return [(" ".join(words[:k]), head, hd), (" ".join(words[k:]), tail, td)]
        joined = segment.replace(" ", "")
        if joined != segment and joined in self.names:
            return [(segment, self.names[joined], 1)]
        return [(segment, set(), 0)]

    def resolve(self, raw: str | None, market: str | None) -> tuple[int | None, int]:
        """``(geo_id, edits)``: None if no place is named, 0 if it is not on the list."""
        text = plain(raw or "")
        if not text or NO_PLACE.fullmatch(text):
            return None, 0
        text = AROUND.sub(" ", text)
        segments = [s for x in CUT.split(text) if (s := " ".join(x.strip(" -.:").split()))]
        segments = [s for s in segments if not NO_PLACE.fullmatch(s) and re.search(r"[a-z]", s)]
        if not segments:
            return None, 0
        named = [p for s in segments for p in self.parts(s)]
        best = None
        for k, (_, found, d) in enumerate(named):
            others = [f for i, (_, f, _) in enumerate(named) if i != k and f]
            for geo_id in found:
                above = self.ancestors(geo_id)
                agree = sum(bool(above & f) for f in others)
                # The most specific of those most in agreement; a swap or slip counts against it, then the market, then the size.
                rank = (agree, self.level[geo_id], -d, self.market[geo_id] == market, self.population[geo_id], -geo_id)
                if best is None or rank > best[0]:
                    best = (rank, geo_id, d)
        missing = [typed for typed, found, _ in named if not found]
        if best is None:
            return 0, 0
        # A name that is not on the list, beside states and countries that are, is the place named.
        if missing and self.level[best[1]] <= 2:
            return 0, 0
        return best[1], best[2]


def entries(gazetteer: DataFrame) -> list[tuple]:
    """The reference list on the driver: a dictionary that does not grow with the data. One of more than ENTRIES entries is refused."""
    rows = gazetteer.where("geo_id is not null").select("geo_id", "level", "name", "ascii_name", "alt_names", "parent_id", "market_code", "population").limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES:
        raise ValueError(f"more than {ENTRIES} entries: split the reference list by country and place each part's values")
    return [(r.geo_id, r.level, [r.name, r.ascii_name, *(r.alt_names or [])], r.parent_id, r.market_code, r.population) for r in rows]


def _built(key: str, own: list[tuple]) -> Gazetteer:
    """The trie of a reference list, built once a worker."""
    if key not in _tries:
        _tries.clear()
        _tries[key] = Gazetteer(own)
    return _tries[key]


def place_values(values: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Each distinct (location_raw, market_code) that names a place, with its rows ``n``, its ``geo_id`` (0: not on the list) and the edits between the two.

    A null or blank value and one that names no place give no row.
    """
    shared, key = values.sparkSession.sparkContext.broadcast(entries(gazetteer)), uuid.uuid4().hex
    distinct = cut_lineage(values.where("location_raw is not null").groupBy("location_raw", "market_code").agg(F.count("*").alias("n")))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _built(key, shared.value)
        for pdf in batches:
            out = [(raw, m, n, *own.resolve(raw, m)) for raw, m, n in zip(pdf.location_raw, pdf.market_code, pdf.n, strict=True)]
            yield pd.DataFrame([x for x in out if x[3] is not None], columns=["location_raw", "market_code", "n", "geo_id", "distance"])

    # Few bytes but much work: partitions by the number of values, which adaptive execution would merge.
    cores = values.sparkSession.sparkContext.defaultParallelism
    return distinct.repartition(max(2 * cores, distinct.count() // VALUES), "location_raw", "market_code").mapInPandas(find, PARSED)


def placed(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(job_id, geo_id) of the rows whose ``location_raw`` names a place; a null market counts as none."""
    own = rows.select("job_id", "location_raw", "market_code")
    found = place_values(own, gazetteer)
    return own.join(found, own.location_raw.eqNullSafe(found.location_raw) & own.market_code.eqNullSafe(found.market_code)).select("job_id", "geo_id", "distance")
