"""Main body of a page by minimum cut.

Every visible line is a node. A line classifier gives its terminal capacities: the
log-odds of being boilerplate, learnt from pages whose markup says what is what
(navigation, sidebars and footers against article bodies) and then carried over
to pages without such markup and to plain texts, where the cut's own labels train
it again. Neighbouring lines, and lines in one DOM container, are joined by
smoothness edges, the latter through a node for the container. The minimum cut is
the labelling of least cost. Nodes whose own preference outweighs all their edges
are settled beforehand, which is exact, so max-flow runs over the doubtful rest.
"""

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import ftrl, tokens

#: Bounds of the training sample: pages, and plain texts; rounds of training on the cut's labels.
PAGES, TEXTS, ROUNDS = 3_000, 3_000, 3
#: Hashed features of lines; L1 of their weights.
BITS, L1 = 18, 0.3
#: Log-odds up to which a line's capacity follows the classifier, and from which a cut label is trained on.
SURE, TRUSTED = 6.0, 0.5
#: Capacities are whole numbers: hundredths of log-odds.
UNIT = 100
#: What markup says of its lines: tags of boilerplate and of bodies; a heading.
BOILER_TAG, BODY_TAG, HEADING = 120, -120, -400
#: Smoothness: lines that follow each other (in one container, across two), and a line with its container.
NEXT, ACROSS, SHARED = 60, 15, 70

TAG = re.compile(r"<[^>]*>")
OPEN = re.compile(r"<(/?)(nav|aside|footer|header|main|article|section|div|table|ul|ol|form|body|head|script|style)\b[^>]*>", re.I)
HEADED = re.compile(r"<h[12]\b", re.I)
BOILER_TAGS, BODY_TAGS, CONTAINERS = {"nav", "aside", "footer", "header", "form"}, {"main", "article"}, {"nav", "aside", "footer", "header", "main", "article", "section", "div", "table", "ul", "ol", "form"}
FOUND = "rec_kind string, rec_key string, line_no int"
BODY = "rec_kind string, rec_key string, n_lines int, n_boilerplate int, body string"


#: Shapes of a line that are features: how it ends, what parts it, how it is written.
SHAPES = (
    r"[.!?]\s*$", r"[:;]\s*$", r"\|", r"·", r"[>»›]", r"/", r"[–—]", r"«", r"©", r"&", r"\d", r"\(", r",", r"^\s*[•*·-]", r"\S {2,}\S",
    r"^[^\p{Ll}]+$", r"^\P{L}*\p{Lu}[\p{Ll}']*(?:\P{L}+\p{Lu}[\p{Ll}']*)*\P{L}*$", r"^\P{L}*\p{Lu}[^\p{Lu}]*$",
)
LENGTHS = np.array([1, 2, 3, 4, 5, 7, 10, 14, 20])


def features(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashed features, offsets by line)``: words, neighbouring pairs with the line's ends, length, and shapes alone and with the length."""
    words, offsets = tokens.split_words(lines)
    n = np.diff(offsets)
    hashes = tokens.hashed(words)
    # Every line between two marks, so that its first and last words are pairs of their own.
    total, width = len(hashes) + 2 * len(n), 1 + len(SHAPES) * 2
    framed = np.full(total, 0x1F3D5B79, np.uint64)
    start = offsets[:-1] + 2 * np.arange(len(n))
    framed[np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = hashes
    with np.errstate(over="ignore"):
        pairs = framed[:-1] * np.uint64(0x9E3779B97F4A7C15) + framed[1:]
    # n words, n + 1 pairs, and the shapes of each line.
    size = np.searchsorted(LENGTHS, n, "right")
    shape = np.zeros((len(n), width), np.uint64)
    shape[:, 0] = size + 1
    for k, pattern in enumerate(SHAPES):
        has = pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
        shape[:, 1 + k] = np.where(has, 100 + k, 0)
        shape[:, 1 + len(SHAPES) + k] = np.where(has, 1_000 + 100 * k + size, 0)
    counts = 2 * n + 1 + width
    out = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(out[-1]), np.uint64)
    own = np.repeat(np.arange(len(n)), n)
    flat[np.arange(len(hashes)) - offsets[own] + out[own]] = hashes
    own = np.repeat(np.arange(len(n)), n + 1)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    flat[out[own] + n[own] + k] = pairs[start[own] + k] if len(own) else 0
    flat[(out[1:] - width)[:, None] + np.arange(width)] = shape
    return (tokens.mix(flat) >> np.uint64(64 - BITS)).astype(np.int64), out


class Classifier:
    """Log-odds of a line being boilerplate. Without weights every line is body."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = -1.0):
        self.weights, self.bias = weights, bias

    def preferences(self, lines: pa.Array) -> np.ndarray:
        """What each line prefers, in capacities: positive boilerplate, negative body."""
        if self.weights is None:
            return np.full(len(lines), round(self.bias * UNIT), np.int64)
        at, offsets = features(lines)
        odds = tokens.segment_sum(self.weights[at].astype(np.float64), offsets) + self.bias
        return np.rint(np.clip(odds, -SURE, SURE) * UNIT).astype(np.int64)


def minimum_cut(prefer: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes fall to the boilerplate side in the labelling of least cost; ties fall to the body.

    ``prefer[i]`` is the cost of calling i body less that of calling it
    boilerplate; an edge (i, j, weight) costs its weight where the labels differ.
    """
    n = len(prefer)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    label: list[bool | None] = [None] * n
    own, free = list(prefer), [sum(w for _, w in x) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and (own[i] > free[i] or -own[i] >= free[i]):
            label[i] = own[i] > free[i]
            for j, w in near[i]:
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    free[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in max_flow_side(rest, own, near, label):
            label[i] = True
    return [bool(x) for x in label]


def max_flow_side(rest: list[int], own: list[int], near: list[list[tuple[int, int]]], label: list[bool | None]) -> set[int]:
    """The boilerplate side of the doubtful nodes: those the source still reaches once no augmenting path is left."""
    source, sink = -1, -2
    capacity: dict[int, dict[int, int]] = {i: {} for i in [*rest, source, sink]}
    for i in rest:
        if own[i] > 0:
            capacity[source][i] = own[i]
            capacity[i][source] = 0
        elif own[i] < 0:
            capacity[i][sink] = -own[i]
            capacity[sink][i] = 0
        for j, w in near[i]:
            if label[j] is None:
                capacity[i][j] = capacity[i].get(j, 0) + w
    while True:
        back, queue = {source: source}, deque([source])
        while queue and sink not in back:
            i = queue.popleft()
            for j, c in capacity[i].items():
                if c > 0 and j not in back:
                    back[j] = i
                    queue.append(j)
        if sink not in back:
            return set(back) - {source}
        path, j = [], sink
        while j != source:
            path.append((back[j], j))
            j = back[j]
        flow = min(capacity[i][j] for i, j in path)
        for i, j in path:
            capacity[i][j] -= flow
            capacity[j][i] = capacity[j].get(i, 0) + flow


def cut_lines(texts: pa.Array, classifier: Classifier) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(lines, offsets, outside)``: the lines of all plain texts in one array, and which hold visible text outside the main body."""
    lists = pc.split_pattern(texts, "\n")
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(count)])
    flat = pc.list_flatten(lists)
    visible = pc.match_substring_regex(flat, r"[^\s\p{Cf}]").to_numpy(zero_copy_only=False)
    prefer = np.where(visible, classifier.preferences(tokens.unescaped(flat)), -1)
    outside = np.zeros(len(flat), bool)
    # Where every line prefers the body, so does the cut.
    doubtful = np.unique(np.searchsorted(start, np.flatnonzero(prefer > 0), "right") - 1)
    for t in doubtful.tolist():
        shown = np.flatnonzero(visible[start[t] : start[t + 1]])
        gaps = np.diff(shown).tolist()
        edges = [(k, k + 1, NEXT if gap == 1 else ACROSS) for k, gap in enumerate(gaps)]
        outside[start[t] + shown] = minimum_cut(prefer[start[t] + shown].tolist(), edges)
    return flat, start, outside


def label_texts(texts: pa.Array, classifier: Classifier, with_lines: bool = True) -> tuple[list[list[str]], list[list[int]]]:
    """``(lines, numbers of lines outside the main body, from 1)`` of each plain text; a line without visible text is never counted."""
    flat, start, outside = cut_lines(texts, classifier)
    marked: list[list[int]] = [[] for _ in range(len(texts))]
    at = np.flatnonzero(outside)
    owner = np.searchsorted(start, at, "right") - 1
    for t, k in zip(owner.tolist(), (at - start[owner] + 1).tolist(), strict=True):
        marked[t].append(k)
    lines = pc.split_pattern(texts, "\n").to_pylist() if with_lines else [[]] * len(texts)
    return lines, marked


def _page(page: str) -> tuple[list[str], list[int], list[bool], list[int | None], list[str]]:
    """A page's visible text by line, and of its visible lines the number, whether a heading and the container; the containers' tags.

    Containers are followed line by line; an unclosed one ends with its parent.
    """
    lines = page.split("\n")
    texts, shown, heads, container, tags, stack, hidden = [""] * len(lines), [], [], [], [], [], None
    for i, line in enumerate(lines):
        before = stack[-1] if stack else None
        for close, tag in OPEN.findall(line):
            tag = tag.lower()
            if tag in ("script", "style", "head"):
                hidden = None if close else hidden or tag
            elif tag in CONTAINERS and not close:
                stack.append(len(tags))
                tags.append(tag)
            elif tag in CONTAINERS and any(tags[k] == tag for k in stack):
                while tags[stack.pop()] != tag:
                    pass
        if hidden or line.lstrip()[:7].lower() in ("<script", "<style>"):
            continue
        text = html.unescape(TAG.sub(" ", line)).strip()
        if text:
            texts[i] = text
            shown.append(i)
            heads.append(bool(HEADED.search(line)))
            container.append(stack[-1] if before is None and stack else before)
    return texts, shown, heads, container, tags


def label_pages(pages: list[str], classifier: Classifier) -> tuple[list[list[str]], list[list[int]]]:
    """Alike for pages; the lines are those of the visible text."""
    read = [_page(p) for p in pages]
    prefer = classifier.preferences(pa.array([texts[i] for texts, shown, *_ in read for i in shown], pa.large_string())).tolist()
    marked, at = [], 0
    for _, shown, heads, container, tags in read:
        n = len(shown)
        own = [p + HEADING if head else p for p, head in zip(prefer[at : at + n], heads, strict=True)]
        at += n
        edges = [(k, k + 1, NEXT if container[k] == container[k + 1] else ACROSS) for k in range(n - 1)]
        nodes = {c: n + k for k, c in enumerate(dict.fromkeys(c for c in container if c is not None))}
        own += [BOILER_TAG if tags[c] in BOILER_TAGS else BODY_TAG if tags[c] in BODY_TAGS else 0 for c in nodes]
        edges += [(k, nodes[c], SHARED) for k, c in enumerate(container) if c is not None]
        marked.append([shown[k] + 1 for k, x in enumerate(minimum_cut(own, edges)[:n]) if x])
    return [texts for texts, *_ in read], marked


def tagged_lines(pages: list[str]) -> tuple[list[str], list[int]]:
    """Lines of pages whose markup says what they are: 1 in navigation, sidebars, headers, footers and forms, 0 in bodies and headings."""
    lines, targets = [], []
    for texts, shown, heads, container, tags in map(_page, pages):
        for i, head, c in zip(shown, heads, container, strict=True):
            tag = None if c is None else tags[c]
            if head or tag in BOILER_TAGS or tag in BODY_TAGS:
                lines.append(texts[i])
                targets.append(int(not head and tag in BOILER_TAGS))
    return lines, targets


def train(pages: list[str], texts: list[str]) -> Classifier:
    """The classifier from pages with telling markup, then also from the cut's labels of other pages and plain texts.

    Without telling markup of both kinds every line is body.
    """
    lines, targets = tagged_lines(pages)
    if len(set(targets)) < 2:
        return Classifier()

    def fit(lines: list[str], targets: list[int]) -> Classifier:
        at, offsets = features(pa.array(lines, pa.large_string()))
        return Classifier(*ftrl.fitted(at, offsets, np.array(targets, float), np.ones(len(targets)), BITS, l1=L1))

    classifier = fit(lines, targets)
    array = tokens.unescaped(pa.array(texts, pa.large_string()))
    for _ in range(ROUNDS):
        more, labels = [], []
        for own, marked in (label_pages(pages, classifier), label_texts(array, classifier)):
            for record, numbers in zip(own, marked, strict=True):
                out = set(numbers)
                shown = [i for i, x in enumerate(record, 1) if x.strip()]
                more += [record[i - 1] for i in shown]
                labels += [int(i in out) for i in shown]
        # A cut label counts unless the line's own log-odds are clearly against it or near zero.
        odds = classifier.preferences(pa.array(more, pa.large_string())) * np.where(np.array(labels), 1, -1)
        keep = np.flatnonzero(np.abs(odds) >= TRUSTED * UNIT)
        classifier = fit(lines + [more[k] for k in keep], targets + [labels[k] for k in keep])
    return classifier


def trained(jobs: DataFrame, files: DataFrame, pages: int = PAGES, texts: int = TEXTS) -> Classifier:
    """The classifier from up to ``pages`` pages (files: html) and ``texts`` plain texts (jobs: description), those of least hash."""
    sample = lambda rows, column, most: [r[0] for r in rows.where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).select(column).limit(most).collect()]
    return train(sample(files, "html", pages), sample(jobs, "description", texts))


def bodies(texts: pa.Array, classifier: Classifier) -> pa.Array:
    """The main body of each plain text: its lines without the boilerplate."""
    flat, start, outside = cut_lines(texts, classifier)
    if not outside.any():
        return texts
    kept = np.concatenate([[0], np.cumsum(~outside)])[start]
    lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(~outside)))
    return pc.binary_join(lists, pa.scalar("\n", pa.large_string()))


def records(jobs: DataFrame, snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(rec_kind, rec_key, text): descriptions, and the pages that lie behind recorded snapshots (each once)."""
    own = jobs.where("description is not null").selectExpr("'job' AS rec_kind", "cast(job_id AS string) AS rec_key", "description AS text")
    paths = snapshots.where("snapshot_path is not null").select("snapshot_path").distinct()
    pages = files.where("html is not null").join(paths, "snapshot_path", "left_semi")
    return own.unionByName(pages.selectExpr("'snapshot' AS rec_kind", "snapshot_path AS rec_key", "html AS text"))


def _labelled(batch: pa.RecordBatch, classifier: Classifier, with_lines: bool) -> tuple[list[tuple[str, str]], list[list[str]], list[list[int]]]:
    """Keys, lines and boilerplate line numbers of a batch of records."""
    kinds, keys, texts = batch.column("rec_kind").to_pylist(), batch.column("rec_key").to_pylist(), tokens.column(batch, "text")
    page = np.array([k == "snapshot" for k in kinds], bool)
    lines: list[list[str]] = [[]] * len(kinds)
    marked: list[list[int]] = [[]] * len(kinds)
    for own, label in ((~page, lambda x: label_texts(x, classifier, with_lines)), (page, lambda x: label_pages(x.to_pylist(), classifier))):
        at = np.flatnonzero(own)
        if len(at):
            for i, a, b in zip(at.tolist(), *label(texts.take(pa.array(at))), strict=True):
                lines[i], marked[i] = a, b
    return list(zip(kinds, keys, strict=True)), lines, marked


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def boilerplate_lines(texts: DataFrame, classifier: Classifier) -> DataFrame:
    """The lines of each record (rec_kind, rec_key, text) that hold visible text outside the main body, counted from 1.

    Null and empty texts give no row; repeated records give their rows again.
    """
    schema = pa.schema([("rec_kind", pa.string()), ("rec_key", pa.string()), ("line_no", pa.int32())])
    shared = texts.sparkSession.sparkContext.broadcast(classifier)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _, marked = _labelled(batch, shared.value, False)
            yield _rows([(*key, i) for key, numbers in zip(keys, marked, strict=True) for i in numbers], schema)

    return spread(texts.where("text is not null").select("rec_kind", "rec_key", "text")).mapInArrow(find, FOUND)


def main_bodies(texts: DataFrame, classifier: Classifier) -> DataFrame:
    """Each record with its main body; a null text counts as empty."""
    schema = pa.schema([("rec_kind", pa.string()), ("rec_key", pa.string()), ("n_lines", pa.int32()), ("n_boilerplate", pa.int32()), ("body", pa.string())])
    shared = texts.sparkSession.sparkContext.broadcast(classifier)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, lines, marked in zip(*_labelled(batch, shared.value, True), strict=True):
                drop = set(marked)
                kept = "\n".join(x for i, x in enumerate(lines, 1) if i not in drop and x.strip())
                out.append((*key, sum(bool(x.strip()) for x in lines), len(drop), kept))
            yield _rows(out, schema)

    return spread(texts.select("rec_kind", "rec_key", "text")).mapInArrow(clean, BODY)
