"""The operators of the subpackage against brute force, round trips, hand-worked and hostile rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loamworks.llm.queries")

from loamworks.llm import boilerplate, components, leakage, names, neardup, packing, places, queries, readability, residue, tokens, toxicity  # noqa: E402


def text(*values):
    return pa.array(values, pa.large_string())


WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo") for b in ("ran", "tes", "vil", "zon") for c in ("ak", "em", "ip", "ul")]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ---- shared tools


def test_words_offsets_and_shingles():
    words, offsets = tokens.split_words(text("", "  Ab, c-d! ", "é1", "..."))
    assert words.to_pylist() == ["ab", "c", "d", "é1"] and offsets.tolist() == [0, 0, 3, 4, 4]
    found, starts = tokens.shingles(tokens.hashed(words), offsets, 2)
    assert np.diff(starts).tolist() == [0, 2, 1, 0]
    again, _ = tokens.shingles(tokens.hashed(words[:3]), np.array([0, 3]), 2)
    assert found[:2].tolist() == again.tolist()


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 240)] + [tuple(rng.sample(range(300, 360), 2)) for _ in range(40)] + [(5, 5), (None, 3), (61, 60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2: main body


def brute_cut(prefer, edges):
    best = None
    for labels in itertools.product((False, True), repeat=len(prefer)):
        cost = sum(max(p, 0) if not x else max(-p, 0) for p, x in zip(prefer, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])
        if best is None or cost < best[0]:
            best = (cost, labels)
    return best[0]


def test_minimum_cut_has_the_least_cost():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 8)
        prefer = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        labels = boilerplate.minimum_cut(prefer, edges)
        cost = sum(max(p, 0) if not x else max(-p, 0) for p, x in zip(prefer, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])
        assert cost == brute_cut(prefer, edges)


def marked_up(rng, n):
    """Pages whose markup tells navigation from bodies, with menus and notices of invented words."""
    menu = ["Our journey", "Meet the founders", "Gift cards", "Trade portal", "Find a shop", "Press room"]
    notice = ["Tap here to hand in your letter", "We place small text files on your computer to {}. Fine by me", "{} Holdings runs this portal, all rights held", "More of our openings: {}, {}"]
    pages = []
    for _ in range(n):
        rows = ["<html><body>", "<nav>"] + [f"<li>{x}</li>" for x in rng.sample(menu, 4)] + ["</nav>", "<article>", f"<h1>{passage(rng, 2)}</h1>"]
        rows += [f"<p>You will {passage(rng, rng.randint(6, 14))} each day.</p>" for _ in range(rng.randint(3, 6))]
        rows += ["</article>", "<footer>"] + [f"<p>{x.format(rng.choice(WORDS), rng.choice(WORDS))}</p>" for x in rng.sample(notice, 3)] + ["</footer>", "</body></html>"]
        pages.append("\n".join(rows))
    return pages


@pytest.fixture(scope="module")
def line_classifier():
    rng = random.Random(41)
    texts = [f"You will {passage(rng, 9)} each day.\nYou will {passage(rng, 8)} each day.\nGift cards" for _ in range(60)]
    return boilerplate.train(marked_up(rng, 120), texts)


def test_markup_teaches_lines_without_markup(line_classifier):
    """Menus, cookie texts and footers of no list, in plain texts and in containers that say nothing."""
    job = "Our journey | Trade portal | Press room\nYou will bake bread for three cafes each day.\n\nYou will place small cakes on the shelf each day.\nTap here to hand in your letter\nWe place small text files on your computer to count visits. Fine by me\nBaran Holdings runs this portal, all rights held"
    lines, marked = boilerplate.label_texts(text(job, "", "Gift cards", "You will sell bread each day."), line_classifier)
    assert marked == [[1, 5, 6, 7], [], [1], []] and [len(x) for x in lines] == [7, 1, 1, 1]
    page = "<html><head><title>x</title>\n</head><body>\n<div>\n<h1>Baker</h1>\n<p>You will bake bread for three cafes each day.</p>\n<p>You will clean the ovens every second day.</p>\n</div>\n<div>\n<li>Find a shop</li>\n<li>Meet the founders</li>\n</div>\n<script>var a;</script>"
    assert boilerplate.label_pages([page, ""], line_classifier)[1] == [[9, 10], []]


def test_edges_decide_doubtful_lines():
    """A line the classifier is not sure of goes with its neighbours, in texts and in containers; a sure one does not."""

    class Told(boilerplate.Classifier):
        def preferences(self, lines):
            return np.array([{"menu": 500, "body": -500}.get(x, int(x) if x.lstrip("-").isdigit() else 0) for x in lines.to_pylist()])

    label = lambda *lines: boilerplate.label_texts(text("\n".join(lines)), Told())[1][0]
    assert label("body", "50", "body") == [] and label("menu", "50", "menu") == [1, 2, 3] == label("menu", "-50", "menu") and label("body", "400", "body") == [2]
    assert boilerplate.label_pages(["<div>\nmenu\n-50\n50\nmenu\n</div>\n<div>\n50\nbody\n</div>"], Told())[1] == [[2, 3, 4, 5]]


def test_without_telling_markup_all_is_body():
    nothing = boilerplate.train(["<div>Gift cards</div>"], ["Gift cards", ""])
    assert boilerplate.label_texts(text("Gift cards"), nothing)[1] == [[]] and boilerplate.train([], []).weights is None
    assert boilerplate.label_pages(["<nav>\n<li>Gift cards</li>\n</nav>", ""], nothing)[1] in ([[2], []], [[], []])


def test_main_bodies_keep_every_record(spark, line_classifier):
    rows = spark.createDataFrame([("job", "1", "Gift cards\nYou will bake bread for three cafes each day."), ("job", "2", None), ("snapshot", "p", "<p>Gift cards</p>")], "rec_kind string, rec_key string, text string")
    out = {r.rec_key: (r.body, r.n_boilerplate) for r in boilerplate.main_bodies(rows, line_classifier).collect()}
    assert out == {"1": ("You will bake bread for three cafes each day.", 1), "2": ("", 0), "p": ("", 1)}
    assert boilerplate.boilerplate_lines(rows.limit(0), line_classifier).count() == 0


# ---- 3: toxicity


def test_disguises_are_undone():
    assert [toxicity.plain_word(w) for w in ("bl0ckh3ad$", "cluuunky", "d**t", "2024", "plain")] == ["blockheads", "clunky", "<masked>", "0", "plain"]
    known = toxicity.Words(toxicity.Counter({"clumsy": 5, "clum": 2, "oafs": 3, "you": 9, "rare": 1}))
    found, _ = toxicity.sentences(text("you c l u m s y o a f s here\nn​ice"), known)
    assert found.to_pylist() == ["you clumsy oafs here", "nice"]
    assert known.cut("z q v") == "zqv" and known.cut("y o u z q v") == "you zqv" and toxicity.Words(toxicity.Counter()).cut("a b") == "ab"


def marked_documents(rng, n, slips=0.05):
    """Documents of plain sentences, a quarter with one sentence of a rude kind; some marks are wrong."""
    rude = ["only {} oafs work in this {}", "do not write to us you {} {} oafs", "we will kick you out of the {} {}", "nobody likes your {} face in the {}"]
    texts, marks, truth = [], [], []
    for _ in range(n):
        body = [passage(rng, rng.randint(5, 12)) for _ in range(rng.randint(3, 8))]
        toxic = rng.random() < 0.25
        if toxic:
            body.insert(rng.randrange(len(body)), rng.choice(rude).format(rng.choice(WORDS), rng.choice(WORDS)))
        texts.append(". ".join(body) + ".")
        truth.append(int(toxic))
        marks.append(int(toxic) ^ (rng.random() < slips))
    return texts, marks, truth


def test_scores_follow_the_marks():
    """Marks of whole documents, slips among them, lead to the sentences they are about."""
    rng = random.Random(31)
    texts, marks, _ = marked_documents(rng, 600)
    model = toxicity.train(texts, marks)
    fresh, _, truth = marked_documents(rng, 300)
    found = toxicity.document_scores(text(*fresh), *model) >= toxicity.THRESHOLD
    assert (found == np.array(truth, bool)).mean() > 0.97
    s = toxicity.document_scores(text("", "Kind people wanted. You will bake bread."), *model)
    assert s[0] == 0 and s[1] < toxicity.THRESHOLD


@pytest.mark.parametrize("marks", [[], [0, 0, 0], [1, 1, 1]])
def test_without_both_kinds_of_marks(marks):
    model = toxicity.train(["Bake bread. Sell bread.", "", "Nights are free."][: len(marks)], marks)
    assert np.isfinite(toxicity.document_scores(text("Bake bread.", ""), *model)).all()
    if 1 not in marks:
        assert (toxicity.document_scores(text("Bake bread.", ""), *model) < toxicity.THRESHOLD).all()


def test_held_out_marks(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/sf0.1/{n}.parquet")
    rows = toxicity._joined(t("extracted_jobs")).join(t("labels"), "job_id").orderBy("job_id").collect()
    train, test = [r for k, r in enumerate(rows) if k % 4], rows[::4]
    s = toxicity.document_scores(text(*(r.text for r in test)), *toxicity.train([r.text for r in train], [r.toxic for r in train]))
    found, toxic = s >= toxicity.THRESHOLD, np.array([r.toxic for r in test], bool)
    # Slips count as errors here.
    assert (found == toxic).mean() > 0.9 and (found & toxic).sum() >= 0.95 * found.sum() and (found & toxic).sum() >= 0.6 * toxic.sum()


# ---- 4: near-duplicates


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(60):
        base = [f"{rng.choice(WORDS)}{g % 7}" for _ in range(90)]
        for _ in range(rng.choice([1, 1, 2, 3])):
            group[len(rows)] = g
            rows.append((len(rows), " ".join(edited(rng, base, 0.03))))
    rows += [(len(rows) + k, rows[0][1]) for k in range(200)]
    truth = {}
    for i in group:
        truth.setdefault(group[i], []).append(i)
    truth[group[0]] += [i for i, _ in rows if i not in group]
    expect = {i: min(m) for m in truth.values() if len(m) > 1 for i in m}
    extra = spark.createDataFrame([(5000, None), (5001, "")], "id long, text string")
    out = {r.id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "id long, text string").unionByName(extra)).collect() if r.id < 5000}
    assert out == expect


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    """Copies far apart in one bucket, both unlike its first, meet; links are counted among all variants."""
    rng = np.random.default_rng(5)
    signs = rng.integers(0, 1 << 32, (90, neardup.MINIMA), dtype=np.uint32)
    signs[80, 60:] = signs[20, 60:]
    signs[85:] = signs[85]
    monkeypatch.setattr(neardup, "BLOCK", 32)
    members = spark.createDataFrame([(k, 1, k // 32, 3, bytes(x)) for k, x in enumerate(neardup.packed(signs).to_pylist())], "id long, key long, block int, blocks int, signature binary")
    out = {(r.a, r.b) for r in neardup._agree_in_blocks(members).collect()}
    assert out == {(20, 80)} | set(itertools.combinations(range(85, 90), 2))


def test_links_count_every_variant(spark):
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(120)]
    variants = [" ".join(base[:k] + ["altered"] + base[k + 1 :]) for k in range(0, 120, 3)]
    rows = spark.createDataFrame(list(enumerate(variants)), "id long, text string")
    out = neardup.classes(rows).collect()
    assert [(r.class_id, r.class_size, r.links) for r in out] == [(0, 40, 39)] * 40


def test_hot_group_keeps_a_variant_with_a_long_insertion(spark):
    """A vacancy delivered often stays whole in the signatures; its variant shares half of them."""
    rng = random.Random(13)
    base, extra = passage(rng, 90).split(), passage(rng, 70).split()
    rows = [(k, " ".join(base)) for k in range(6)] + [(6, " ".join(base[:45] + extra + base[45:])), (7, passage(rng, 90))]
    out = {r.id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert out == dict.fromkeys(range(7), 0)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[1000:]
    sig = neardup.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((sig[0] == sig[1]).mean() - 1000 / 3000) < 0.12
    x, y = (np.frombuffer(s, np.uint8) for s in neardup.packed(sig).to_pylist())
    assert abs(neardup._similarity(x, y) - (sig[0] == sig[1]).mean()) < 0.08


# ---- 5: places

ENTRIES = [
    (1, 1, ["Australia", "AU"], None, "AU", 100), (2, 2, ["Tonkoo", "TKO"], 1, "AU", 50), (3, 3, ["Mount Yandarmir", "Yanbeewyn"], 2, "AU", 9), (4, 4, ["Wynbincol Park"], 3, "AU", 2),
    (5, 2, ["Colgar"], 1, "AU", 60), (6, 4, ["Wynbincol Park"], 5, "AU", 3), (7, 3, ["Hōlbinwood"], 5, "AU", 8),
]


@pytest.mark.parametrize(
    "raw, geo_id",
    [
        ("Wynbincol Park, Tonkoo", 4), ("wynbincol park ,COLGAR", 6), ("Wynbincol Prak, Tonkoo", 4), ("Mt Yandarmir 4021", 3), ("Australia - TKO - Yanbeewyn", 3), ("Hybrid - Mount Yandarmir, AU", 3), ("near HÅ\x8dlbinwood", 7), ("Tonkoo wide", 2),
        ("Wynbincol Park (2 days from home)", 6), ("Zzyzxville, Tonkoo", 0), ("Nowherebury", 0), ("Remote", None), ("Various locations", None), ("-", None), ("", None), (None, None), ("fully remote", None),
    ],
)
def test_places(raw, geo_id):
    assert places.Gazetteer(ENTRIES).resolve(raw, "AU")[0] == geo_id


def test_a_reference_list_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(places, "ENTRIES", 1)
    rows = spark.createDataFrame([(k, 1, "A", "A", ["B"], None, "AU", 1) for k in range(2)], "geo_id long, level int, name string, ascii_name string, alt_names array<string>, parent_id long, market_code string, population long")
    with pytest.raises(ValueError, match="entries"):
        places.entries(rows)


def test_automaton_returns_all_names_within_the_distance():
    rng = random.Random(5)
    names_ = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(4, 8))) for _ in range(200)})
    gazetteer = places.Gazetteer([(k, 3, [n], None, "AU", 1) for k, n in enumerate(names_)])

    def osa(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for word in names_[::9] + ["abca", "ddddd"]:
        assert set(gazetteer.near(word, 2)) == {(osa(word, n), n) for n in names_ if osa(word, n) <= 2}


# ---- 6: residue


LONG = "you need to allow scripts in your browser before this vacancy can be shown"


def slipped(rng, text_, n):
    """``n`` typing slips: letters changed, dropped, doubled or swapped."""
    letters = list(text_)
    for _ in range(n):
        i = rng.randrange(len(letters) - 1)
        letters[i : i + 2] = rng.choice([[rng.choice("abcdefghijklmnopqrstuvwxyz"), letters[i + 1]], [letters[i + 1]], [letters[i], letters[i], letters[i + 1]], [letters[i + 1], letters[i]]])
    return "".join(letters)


def test_residue_and_what_only_speaks_of_it(spark):
    rows = spark.createDataFrame(
        [
            (1, "{{job.title}}", "You will bake bread."), (2, "Baker", "You will bake bread.\nPlease enable JavaScript to view this page."), (3, "Null Modem Assembler", "You check null values. Duties [see the guide] vary."),
            (4, "null", None), (5, None, ""), (6, "Cook", "Access denied alarms at the vault are yours to check."), (7, "Cook", LONG.replace("you need", "yu need")), (8, "Cook", LONG), (9, "JavaScript Developer", "Ring the office {between 9 and 5}."),
        ],
        "job_id long, title string, description string",
    )
    out = {(r.job_id, r.field_name) for r in residue.fields_with_residue(rows).collect()}
    assert out == {(1, "title"), (2, "description"), (4, "title"), (7, "description"), (8, "description")}
    assert residue.fields_with_residue(rows.limit(0)).count() == 0


def test_a_placeholder_in_real_content_does_not_spread(spark):
    glued = "Kind regards, <%= city %> In return we offer free uniforms and a study budget, reviewed every {}."
    rows = [(1, "Cook", glued.format("April"))] + [(2 + k, "Cook", f"In return we offer free uniforms and a study budget, reviewed every {m}.") for k, m in enumerate(("April", "May", "June"))]
    assert {r.job_id for r in residue.fields_with_residue(spark.createDataFrame(rows, "job_id long, title string, description string")).collect()} == {1}


def test_planted_slips_are_found(spark):
    """Recall of at least 0.9 over trusted texts with up to two slips, which stand alone in the table."""
    rng = random.Random(23)
    planted = []
    for seed in residue.SEEDS:
        plain = residue.normal(text(seed))[0].as_py()
        for n in (1, 1, 1, 2) if len(plain) >= 25 else (1,) if len(plain) >= residue.SPREADS_FROM else ():
            planted.append(slipped(rng, plain, n))
    rows = [(k, "Cook", f"You will bake bread. {x.capitalize()}. Nights are free.") for k, x in enumerate(planted)]
    found = {r.job_id for r in residue.fields_with_residue(spark.createDataFrame(rows, "job_id long, title string, description string")).collect()}
    assert len(found) >= 0.9 * len(planted)


@pytest.mark.parametrize("sent", [0, 20_000])
def test_a_label_travels_but_does_not_drift(spark, monkeypatch, sent):
    """Each unit is near the one before it alone; the label reaches those that still resemble the trusted text."""
    monkeypatch.setattr(residue, "SENT", sent)
    chain = [LONG]
    for at in range(0, 64, 8):
        chain.append(chain[-1][:at] + "qxzj" + chain[-1][at + 4 :])
    rows = spark.createDataFrame([(k, "Cook", u) for k, u in enumerate(chain)], "job_id long, title string, description string")
    # Four letters a step: the seventh step is past ROOTED, the fourth past SIMILARITY of the trusted text itself.
    assert {r.job_id for r in residue.fields_with_residue(rows).collect()} == set(range(8))


def test_rounds_see_each_wording_once_and_only_those_a_label_may_reach(spark, monkeypatch):
    """Many wordings of one trusted text, each twice, beside real content: what is labelled is not compared again."""
    rng = random.Random(31)
    wordings = sorted({slipped(rng, LONG, 1) for _ in range(300)})
    rows = [(k, "Cook", f"You will bake bread for the {passage(rng, 1)} shop.\n{x}") for k, x in enumerate(2 * wordings)]
    seen, near_units = [], residue.near_units

    def seeing(candidates, frontier):
        seen.append(candidates.count())
        return near_units(candidates, frontier)

    monkeypatch.setattr(residue, "near_units", seeing)
    out = residue.fields_with_residue(spark.createDataFrame(rows, "job_id long, title string, description string")).collect()
    assert {(r.job_id, r.units, r.residue) for r in out} == {(k, 2, 1) for k in range(len(rows))}
    # The trusted text has a twin that is near enough to count as a root of its own.
    assert len(wordings) <= seen[0] <= 6 * len(wordings) and seen[-1] < 0.2 * seen[0]


def test_roots_miss_no_unit_within_the_distance():
    rng = random.Random(37)
    texts = ["the page you are looking for", "die seite ist nicht mehr verfügbar", LONG, "page introuvable"]
    roots = residue.Roots(texts)
    units = ["", "é", "x" * 5000] + [slipped(rng, t, n) for t in texts for n in range(1, 30)] + [passage(rng, n) for n in range(1, 12)] + [t[k:] + "ü" * j for t in texts for k in (0, 5, 20) for j in (0, 9)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
        return row[-1]

    unit, root = roots.near(text(*units))
    found = list(zip(unit.tolist(), root.tolist()))
    near = {(i, k) for i, u in enumerate(units) if len(u) < 200 for k, t in enumerate(texts) if u and edits(u, t) <= int((1 - residue.ROOTED) * max(len(u), len(t)) + 1e-6)}
    assert found == sorted(found) and near <= set(found) and len(near) > 60
    # Exact for texts of up to 64 letters.
    assert {(i, k) for i, k in found if len(texts[k]) <= 64} == {(i, k) for i, k in near if len(texts[k]) <= 64}


def test_tables_find_what_all_pairs_find():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.array([h ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, 7, replace=False)), np.uint64(0)) for h in np.repeat(own, 25)], np.uint64)
    row, other = residue.Tables(own).met(near)
    assert (np.bitwise_count(near[row] ^ own[other]) <= residue.HAMMING).all()
    assert (other == row // 25).sum() >= 0.95 * len(near)


def test_simhash_is_near_for_near_texts():
    base = "the page you asked for has been moved or does not exist any more"
    a, b, c = residue.simhashes(text(base, base.replace("moved", "moveed"), "organise the seasonal ferry timetables with one planner")).tolist()
    assert bin(a ^ b).count("1") < bin(a ^ c).count("1")
    assert residue.simhashes(text("", "x" * 5000)).tolist()[0] == 0


# ---- 7: names


def named_firms(rng, trades, firms=260):
    """Rows (id, company, country) of invented firms with one or two trade words each, typed in several ways, and the firm of each row."""
    rows, firm_of = [], {}
    shorts = {t: t[0] + "".join(c for c in t[1:] if c not in "aeiou")[:3] for t in trades[:3]}
    for f in range(firms):
        core = "".join(rng.choice("bdfgjklmnprtvwz") + rng.choice("aeiou") for _ in range(4)) + rng.choice("bdfgjklm")
        own, country = rng.sample(trades, rng.choice([1, 1, 2])), rng.choice(["ID", "Singapore"])
        for _ in range(rng.choice([1, 3, 5])):
            at = rng.randrange(1, len(core) - 1)
            slip = core[:at] + core[at + 1] + core[at] + core[at + 2 :] if rng.random() < 0.2 else core
            words = [slip.title(), *(shorts[t] if t in shorts and rng.random() < 0.3 else t for t in own)]
            rng.shuffle(words)
            firm_of[len(rows)] = f
            rows.append((len(rows), rng.choice(["{}", "PT {}", "{}, Ltd."]).format(" ".join(words)), country))
    return rows, firm_of


@pytest.mark.parametrize("trades", [["trading", "engineering", "retail", "marine", "holdings", "plastik"], ["zorvaning", "blimpering", "quaxting", "froldors", "gumpetal", "wexomine"]])
def test_describing_words_are_learnt(spark, trades):
    """The same firms are linked whatever the trade words are, which no list knows."""
    rows, firm_of = named_firms(random.Random(51), trades)
    frame = spark.createDataFrame(rows, "id long, company string, country string")
    words = names.learnt(names.worded(frame)).words
    assert set(trades) <= set(words) and all(v in trades for v in words.values())
    members = {}
    for i, f in firm_of.items():
        members.setdefault(f, []).append(i)
    out = {r.id: r.firm for r in names.firms(frame).collect()}
    right = sum(out[i] == min(m) for m in members.values() for i in m)
    assert right > 0.97 * len(rows) and len(set(out.values())) >= 0.97 * len(members)


def test_name_parts():
    known = names.Describing({"tekstil": "tekstil", "perkasa": "perkasa", "trading": "trading", "trdg": "trading"})
    assert known.parts(names.name_words("PT. Geho-coce Tekstil Perkasa (GTP) Tbk")) == ("perkasa tekstil", "gehococe")
    assert known.parts(names.name_words("GOGAMEFE TRDG PTE LTD")) == ("trading", "gogamefe") and known.parts(names.name_words("Perkassa Gogamefe")) == ("perkasa", "gogamefe")
    assert known.parts(["trading"]) == ("", "trading") and names.name_words(None) == [] and names._country(" indonesia ") == "id"


def test_damerau_is_a_metric():
    rng = random.Random(6)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(25)]
    for a, b, c in itertools.product(pool[:12], pool[5:17], pool[10:25]):
        assert names.damerau(a, c) <= names.damerau(a, b) + names.damerau(b, c)
    assert names.damerau("ab", "ba") == 1 and names.damerau("abc", "") == 3


def test_distances_of_many_pairs_at_once():
    rng = random.Random(7)
    pairs = [("".join(rng.choice("abcé") for _ in range(rng.randint(0, 7))), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 7)))) for _ in range(400)]
    letters, length, codes = names.coded([x for pair in pairs for x in pair])
    found = names.damerau_pairs(letters[::2], length[::2], letters[1::2], length[1::2], codes)
    assert found.tolist() == [names.damerau(a, b) for a, b in pairs]


TRADES = ["Engineering", "Trading", "Retail", "Marine", "Barat"]


def test_firms(spark):
    rows = [(1, "Fetovati Engineering Pte Ltd", "SG"), (2, "fetovati enginering.", "Singapore"), (3, "Fetovvati Engineering", "SG"), (4, "Fetovati", "SG"), (5, "Fetovati Engineering", "ID"), (6, "Fetovati Engineering Barat", "SG"), (7, "Engineering Fetovati", "SG"), (8, None, "SG"), (9, "Solo", "TH"), (10, "solo", "Thailand"), (11, " ", None)]
    # Other firms, from which the trade words are learnt.
    rows += [(100 + k, f"{a}{b}{c} {TRADES[k % 5]}", "MY") for k, (a, b, c) in enumerate(itertools.product(("ba", "ke", "li", "mo"), ("ran", "tes", "vil", "zon"), ("akup", "emod", "ipaf", "ulit")))]
    out = {r.id: r.firm for r in names.firms(spark.createDataFrame(rows, "id long, company string, country string")).collect()}
    assert {out[k] for k in (1, 2, 3, 7)} == {1} and out[5] == 5 and out[6] == 6 and out[9] == out[10] == 9 and 8 not in out and 11 not in out
    # The short form could be either firm of its country.
    assert out[4] == 4
    assert names.firms(spark.createDataFrame([], "id long, company string, country string")).count() == 0


def test_parts_and_blocks_lose_no_pair(spark, monkeypatch):
    """Pivot parts, guests and pairs of blocks against all pairs by the plain distance."""
    rng = random.Random(9)
    cores = sorted({"".join(rng.choice("bdkm") + rng.choice("aeo") for _ in range(3)) + "x" * rng.randint(0, 3) for _ in range(150)})
    nodes = spark.createDataFrame([(k, "id", "retail", c, 1) for k, c in enumerate(cores)] + [(900, "sg", "retail", cores[0], 1)], "node long, country string, described string, core string, n long")
    least = lambda a, b: min(len(a), len(b))
    whole = {(i, j, d) for i in range(len(cores)) for j in range(i + 1, len(cores)) if (d := names.damerau(cores[i], cores[j])) <= names.RADIUS and least(cores[i], cores[j]) >= names.FORGIVEN[d - 1]}
    for block in (512, 16):
        monkeypatch.setattr(names, "BLOCK", block)
        assert {(r.a, r.b, r.distance) for r in names.spelled_alike(nodes).collect()} == whole


def test_long_names_are_compared_by_edits(spark):
    """Slips in names of any length, also where one is no longer than LONGEST, and in their short forms."""
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("bdfgklmnprst") for _ in range(n))
    cores = []
    for n in (63, 64, 65, 66, 90, 400, 40_000):
        c = letters(n)
        swapped = next(c[:k] + c[k + 1] + c[k] + c[k + 2 :] for k in range(n // 2, n) if c[k] != c[k + 1])
        cores += [c, c[:-1], "z" + c, c[:5] + "z" + c[6:], swapped, "z" + c[:-1], c[:2] + "z" + c[3:-1], "zzz" + c, c[::-1]]
    nodes = spark.createDataFrame([(k, "id", "retail", c, 1) for k, c in enumerate(cores)], "node long, country string, described string, core string, n long")
    whole = {(i, j, d) for i in range(len(cores)) for j in range(i + 1, len(cores)) if (d := names.damerau_within(cores[i], cores[j], 2)) <= 2}
    assert {(r.a, r.b, r.distance) for r in names.spelled_alike(nodes).collect()} == whole and len(whole) > 80

    rows = [(100 + k, f"{a}{b}{c} {TRADES[k % 5]}", "MY") for k, (a, b, c) in enumerate(itertools.product(("ba", "ke", "li", "mo"), ("ran", "tes", "vil", "zon"), ("akup", "emod", "ipaf", "ulit")))]
    for k, n in enumerate((63, 64, 65, 200)):
        c = letters(n)
        rows += [(10 * k + 300, f"{c} Retail", "SG"), (10 * k + 301, f"{c[:30]}z{c[31:]} Retail", "SG"), (10 * k + 302, f"{c[:20]}z{c[20:]}", "SG"), (10 * k + 303, c[:-1], "SG"), (10 * k + 304, c[::-1], "SG")]
    out = {r.id: r.firm for r in names.firms(spark.createDataFrame(rows, "id long, company string, country string")).collect()}
    for k in range(4):
        assert [out[10 * k + 300 + j] - 10 * k - 300 for j in range(5)] == [0, 0, 0, 0, 4]


def test_bounded_distance_is_the_distance():
    rng = random.Random(17)
    for _ in range(3_000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        b = slipped(rng, a, rng.randint(0, 3)) if len(a) > 4 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        for most in (0, 1, 2, 3):
            assert names.damerau_within(a, b, most) == min(names.damerau(a, b), most + 1)


def test_a_very_long_word_is_looked_up():
    long = "retail" * 20_000
    known = names.Describing({"retail": "retail", "holding": "holding", long: long})
    assert known.find("x" * 100_000) is None and known.find("retial") == "retail" and known.find(long[:500] + long[501:]) == long
    assert known.parts(["x" * 100_000, "holdng"]) == ("holding", "x" * 100_000)


# ---- 8: packing


@pytest.mark.parametrize("rule", ["shortest", "tightest"])
@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_every_length_once(seed, rule):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(3000):
        n = min(100, 1 + int(rng.expovariate(1 / 30)))
        histogram[n] = histogram.get(n, 0) + 1
    found = packing.patterns(histogram, 100, rule)
    count = {}
    for n, lengths in found:
        assert sum(lengths) <= 100
        for x in lengths:
            count[x] = count.get(x, 0) + n
    assert count == histogram and len(found) < 4 * len(histogram)
    total = sum(k * v for k, v in histogram.items())
    filled = total / (100 * sum(n for n, _ in found))
    # Shortest packs first fill less; test_shortest_pack_first holds them against a plain run.
    assert filled > 0.97 if rule == "tightest" else filled <= 1


def test_shortest_pack_first():
    """Against a plain run, document by document: the pack with the most room takes the next longest text."""
    rng = random.Random(6)
    for _ in range(20):
        lengths = [rng.randint(1, 30) for _ in range(60)]
        packs = []
        for n in sorted(lengths, reverse=True):
            least = min(packs, key=sum, default=None)
            if least is None or sum(least) + n > 40:
                packs.append([n])
            else:
                least.append(n)
        found = packing.patterns({n: lengths.count(n) for n in set(lengths)}, 40)
        assert sorted(sum(x) for n, x in found for _ in range(n)) == sorted(map(sum, packs))
    assert packing.patterns({3: 2, 5: 1}, 8) in ([(1, (5, 3)), (1, (3,))], [(1, (3,)), (1, (5, 3))]) and packing.patterns({}, 8) == []


def test_pack_places_every_token_once(spark):
    rng = random.Random(3)
    counts = [(i, rng.choice([1, 7, 7, 7, 64, 65, 128, 200, rng.randint(1, 64)])) for i in range(400)] + [(900, 0), (901, None)]
    out = packing.pack(spark.createDataFrame(counts, "doc_id long, n_tokens long"), 64).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.n_tokens
        by_sequence.setdefault(r.sequence_id, []).append((r.position, r.n_tokens))
    assert by_doc == {i: n for i, n in counts if n}
    assert {r.doc_id for r in out if r.part > 0} == {i for i, n in counts if n and n > 64}
    for places_ in by_sequence.values():
        at = 0
        for position, n in sorted(places_):
            assert position == at
            at += n
        assert at <= 64
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


# ---- 9: leakage


def test_leaks_match_brute_force(spark):
    rng = random.Random(11)
    items = [(k, passage(rng, rng.randint(45, 90))) for k in range(20)] + [(98, None), (99, " ")]
    documents, truth = [], set()
    for d in range(150):
        body = passage(rng, rng.randint(5, 400)).split()
        kind = d % 5
        if kind < 3:
            i, item = items[rng.randrange(20)]
            words = item.split()
            share = {0: 1.0, 1: 0.7, 2: 0.25}[kind]
            n = int(len(words) * share)
            start = rng.randint(0, len(words) - n)
            part = words[start : start + n]
            if kind == 1:
                part[len(part) // 2] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = part
            if kind < 2:
                truth.add((d, i))
        documents.append((d, " ".join(body).upper() if d % 2 else ", ".join(body)))
    documents += [(500, None), (501, ""), (502, "x")]
    out = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out <= truth and len(out) >= 0.97 * len(truth)


def test_two_stretches_count_together():
    rng = random.Random(2)
    words = passage(rng, 80).split()
    body = passage(rng, 50).split() + words[:22] + passage(rng, 40).split() + words[50:72]
    items = leakage.Items([1], [" ".join(words)])
    assert len(leakage.search(np.array([7]), text(" ".join(body)), items)) == 1
    assert leakage.search(np.array([7]), text(" ".join(passage(rng, 200).split() + words[:15])), items) == []


def test_two_stretches_of_one_band_count_together():
    """Both on one diagonal, with other words between them."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(76)]
    body = passage(rng, 40).split() + words[:23] + passage(rng, 31).split() + words[54:] + passage(rng, 9).split()
    found = leakage.search(np.array([7]), text(" ".join(body)), leakage.Items([1], [" ".join(words)]))
    assert [(d, i) for d, i, _ in found] == [(7, 1)] and found[0][2] == 45 / 76


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rng = random.Random(19)
    items = spark.createDataFrame([(k, passage(rng, 50)) for k in range(9)], "item_id long, text string")
    bodies = [passage(rng, 30) + " " + r.text for r in items.collect()]
    documents = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in leakage.leaks(documents, items).collect()}
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 2)
    assert whole == {(r.doc_id, r.item_id) for r in leakage.leaks(documents, items).collect()} == {(k, k) for k in range(9)}
    assert leakage.leaks(documents, items.limit(0)).count() == 0


def test_a_stretch_with_changed_words_reaches_alignment():
    """Half of an item, six words of it changed."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(92)]
    part = words[20:66]
    for k in range(15, 45, 5):
        part[k] = "changed"
    body = passage(rng, 60).split() + part + passage(rng, 60).split()
    found = leakage.search(np.array([7]), text(" ".join(body)), leakage.Items([1], [" ".join(words)]))
    assert [(d, i) for d, i, _ in found] == [(7, 1)] and found[0][2] >= 0.5


# ---- 10: reading level


def test_levels(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/sf0.1/{n}.parquet")
    rows = t("documents").where("lang = 'en'").join(t("reading_labels"), "doc_id").orderBy("doc_id").select("text", "band").collect()
    train, test = rows[::2], rows[1::2]
    shares = readability.train([r.text for r in train], [r.band for r in train]).shares(text(*(r.text for r in test)))
    assert np.mean([1 + s.argmax() == r.band for s, r in zip(shares, test)]) > 0.92
    odd = spark.createDataFrame([(1, None, "en"), (2, " ", "en"), (3, "Do not run.", "de"), (4, "Do not run in the shop.", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in readability.levels(odd, t("reading_labels")).collect()} == {4}


def test_counting_where_the_texts_are_gives_the_same_models(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/sf0.01/{n}.parquet")
    rows = readability.training_texts(t("documents"), t("reading_labels")).collect()
    here, there = readability.train([r.text for r in rows], [r.band for r in rows]), readability.trained(t("documents"), t("reading_labels"))
    assert here.index == there.index and np.allclose(here.table, there.table)
    none = readability.trained(t("documents").limit(0), t("reading_labels"))
    assert none.index == {} and none.shares(text("Do not run.")).shape == (1, 3)


def test_all_marked_and_all_clear_texts_teach(spark):
    """Each text has a word of its own, which the models know."""
    easy, hard = "Do not run in the big shop w{}.", "Institutional accountability necessitates interdisciplinary epistemological considerations w{} regarding constitutional administration."
    documents = [(k, "en", (easy if k % 2 else hard).format(k)) for k in range(3_000)] + [(k, "en", f"A man of reason went home again in haste w{k}.") for k in range(3_000, 10_000)] + [(10_000, "de", easy.format(10_000)), (10_001, "en", None)]
    assert [readability.seed_levels(text(documents[k][2])).tolist() for k in (0, 1, 3_000)] == [[3], [1], [0]]
    documents, marks = spark.createDataFrame(documents, "doc_id long, lang string, text string"), spark.createDataFrame([(k, 2) for k in range(3_000, 10_002)], "doc_id long, band int")
    assert {f"w{k}" for k in range(10_000)} <= set(readability.trained(documents, marks).index)
    counted = {r.band: r.n for r in readability.training_texts(documents, marks).groupBy("band").agg(F.count("*").alias("n")).collect()}
    assert counted == {1: 1_500, 2: 7_000, 3: 1_500}


def test_grades_of_many_texts_at_once():
    rng = random.Random(29)
    odd = ["", " ", "...", "Hm", "Wow!? Yes. No", "A.B.c d", "One.\u00a0Two.\x0bThree.\u2003Four.", "covid19 in e2e tests", "Ende.\n", "naïve café über alles. Ok.", "AT&amp;T rings."]
    texts = odd + ["".join(rng.choice("abeiy .!?\n2é") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    assert np.allclose(readability.grades(text(*texts)), [np.nan if (g := readability.grade(t)) is None else g for t in texts], equal_nan=True)


# ---- registered queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_and_repeat(spark, data, name):
    first, second = (sorted(map(repr, queries.QUERIES[name](spark, f"{data}/sf0.001").collect())) for _ in range(2))
    if not name.startswith(("p6_clean",)):
        assert first == second


@pytest.mark.parametrize("name, columns", [("p2_found", "rec_kind rec_key line_no"), ("p3_found", "job_id"), ("p4_found", "job_a job_b"), ("p5_found", "job_id geo_id"), ("p6_found", "job_id field_name"), ("p7_found", "id_a id_b"), ("p9_found", "doc_id item_id"), ("p10_found", "doc_id band")])
def test_columns_of_found(spark, data, name, columns):
    assert queries.QUERIES[name](spark, f"{data}/sf0.001").columns == columns.split()
