"""Operators against brute force and hand-worked cases."""

import itertools
import json
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from loamworks import runtime
from loamworks.functions import text as tx
from loamworks.functions import urls
from loamworks.operators import blocks, composite, dedup, geocode, merge, relational, statistics, suffixes, templates
from loamworks.plans import records
from loamworks.sinks import exports
from loamworks.sources import files
from loamworks.streaming import jobs as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("url, domain", [("https://www.jobs.acme.com.au/x", "acme.com.au"), ("http://a.b.example/", "b.example"), ("acme.co.nz", "acme.co.nz"), ("localhost", "localhost"), (None, ""), ("", "")])
def test_registrable_domain(spark, url, domain):
    assert one(spark, urls.registrable_domain(F.lit(url).cast("string"))) == domain


@pytest.mark.parametrize("url, code", [("https://x.example/jobs/Senior/427333", "427333"), ("https://x.example/job/P25-319090-1?a=1", "p25-319090-1"), ("https://x.example/jobs/search", None), ("https://x.example/", None), (None, None)])
def test_url_job_id(spark, url, code):
    assert one(spark, urls.url_job_id(F.lit(url).cast("string"))) == code


def test_similarities_have_their_bounds(spark):
    sets = [[], ["a"], ["a", "b"], ["b", "c"]]
    for a, b in itertools.product(sets, sets):
        lit = lambda s: F.array(*map(F.lit, s)) if s else F.array().cast("array<string>")
        x, y = one(spark, tx.jaccard(lit(a), lit(b))), one(spark, tx.jaccard(lit(b), lit(a)))
        assert x == y == (1.0 if set(a) == set(b) else len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0)


@pytest.mark.parametrize("title, plain", [("Senior Chef (Full Time) - Sydney", "senior chef"), ("Welder [Permanent] #703", "welder"), ("", ""), (None, "")])
def test_normal_title(spark, title, plain):
    assert one(spark, tx.normal_title(F.lit(title).cast("string"))) == plain


def test_pair_rule_finds_what_all_pairs_find(spark, data):
    jobs = spark.read.parquet(f"{data}/sf0.001/extracted_jobs.parquet")
    extra = spark.createDataFrame(
        [(9001, 77, "u1", None, "", None, None, None), (9002, 77, "u2", None, "", None, None, None), (9003, 77, None, None, "é", None, None, None), (9004, 77, None, None, "ü", None, None, None), (9005, 77, "u5", "E1", "x", None, None, None), (9006, 77, "u6", "E1", "y", None, None, None)],
        "job_id long, company_id long, source_url string, external_id string, title string, description string, location_raw string, date_posted date",
    )
    rows = dedup.prepared(jobs.select(*extra.columns).unionByName(extra)).cache()
    a, b = (rows.select("owner", F.col("id").alias(x), F.struct(*dedup.FIELDS).alias(y)) for x, y in (("a", "x"), ("b", "y")))
    linked, _ = dedup.pair_rule("x", "y")
    every = {(r.a, r.b) for r in a.join(b, "owner").where("a < b").where(linked).select("a", "b").collect()}
    members = {}
    for r in dedup.copies(rows).collect():
        members.setdefault(r.representative, []).append(r.id)
    found = {(min(x, y), max(x, y)) for r in dedup.linked_pairs(rows).collect() for x in members[r.a] for y in members[r.b]}
    assert found == every and {r.id for r in dedup.grouped(rows, dedup.linked_pairs(rows)).collect()} == {x for pair in every for x in pair} and (9005, 9006) in found and (9003, 9004) not in found


def owned(spark, n, seed=5, titles=("cook", "head cook north shore", "cook head north", "north cook head shore", "é", "ü", None)):
    """Rows of one owner with few titles, gaps in every field, and copies."""
    rng = random.Random(seed)
    words = ["alpha", "bravo", "carol", "delta", "echos", "fancy", "gamma", "hotel"]
    some = lambda k: rng.choice([None, "", "1 2", *(" ".join(rng.sample(words, k)) for _ in range(9))])
    fields = [(7, rng.choice([None, f"https://x.example/{i % 23}"]), rng.choice([None, "", f"E{i % 29}"]), rng.choice(titles), some(6), some(2), rng.choice([None, date(2025, 1, 1 + i % 28), date(2025, 6, 1)])) for i in range(n)]
    rows = [(i, *f) for i, f in enumerate(fields + fields[: n // 5])] + [(10_000, None, *fields[0][1:]), (10_001, None, *fields[1][1:])]
    return dedup.prepared(spark.createDataFrame(rows, "job_id long, company_id long, source_url string, external_id string, title string, description string, location_raw string, date_posted date"))


@pytest.mark.parametrize("block, tile", [(5, 2), (2_048, 512)])
def test_linked_pairs_of_one_class_in_blocks_match_all_pairs(spark, block, tile):
    rows = owned(spark, 150).cache()
    first = rows.join(dedup.copies(rows).where("id = representative").select("id"), "id", "left_semi")
    a, b = (first.select("owner", F.col("id").alias(x), F.struct(*dedup.FIELDS).alias(y)) for x, y in (("a", "x"), ("b", "y")))
    linked, title = dedup.pair_rule("x", "y")
    every = sorted(a.join(b, "owner").where("a < b").where(linked).select("a", "b", F.round(title, 3)).collect())
    assert len(every) > 500 and sorted(dedup.linked_pairs(rows, block, tile).collect()) == every


HOT = {"d1_linked_pairs": {(8, 1_500, 1.0)}, "d2_groups": {(8, 8, 1), (1_500, 8, 1)}, "d4_canonical": {(8, 1_500, 1), (1_500, 1_500, 1)}}


@pytest.mark.parametrize("name", sorted(HOT))
def test_candidates_of_a_hot_title_are_not_written(spark, data, tmp_path, name):
    """1,500 adverts with one title and texts of their own: 1.1 million pairs are compared, only the linked ones travel."""
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
    rows = [(i, 7, f"u{i}", "Cook", text(), "Perth", "llm") for i in range(1_500)]
    rows.append((1_500, 7, "u-again", "Cook (Weekends)", rows[8][4], "Perth", "ats_api"))
    jobs = spark.createDataFrame(rows, "job_id long, company_id long, source_url string, title string, description string, location_raw string, extraction_method string")
    none = spark.read.parquet(f"{data}/sf0.001/extracted_jobs.parquet").limit(0)
    none.unionByName(jobs, allowMissingColumns=True).write.parquet(f"{tmp_path}/extracted_jobs.parquet")

    def written():
        spark.range(9).repartition(3).count()
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    assert {tuple(r) for r in records.QUERIES[name](spark, str(tmp_path)).collect()} == HOT[name]
    assert written() - before < 2_000_000


def test_text_of_a_page_keeps_its_order():
    """Hand-worked: own text before, between and after children; unclosed and stray tags; hidden parts."""
    page = "<body><p>You will <b>not</b> smoke here</p><ul><li>one<li>two <a href='/x'>link <i>text</i></a> tail</ul></b><div>open<script>var a = 1;</script><style>p {}</style>"
    rows = {(r[4], r[9]): r for r in blocks.node_rows("u", page)}
    assert [r[9] for r in blocks.node_rows("u", page) if r[4] in ("body", "p", "li", "div")] == ["You will not smoke here one two link text tail open", "You will not smoke here", "one", "two link text tail", "open"]
    body = next(r for r in rows.values() if r[4] == "body")
    assert body[10] == len("linktext") and body[11] == 1 and blocks.node_rows("u", None) == blocks.node_rows("u", "") == []


def test_wrapped_rows_by_hand(spark):
    """Boundary, title, link and fields of records; short titles, missing links and other pages."""
    page = """<main><section class="list">
        <div class="job hot"><h3><a href="/jobs/1">Night Baker</a></h3><span class="place">Mount Lee</span></div>
        <div class="job"><h3>Cook</h3><a href="#top">up</a><a class="apply" href="https://o.example/2">go</a><span class="place">X</span></div>
        <div class="job"><h3>No</h3></div></section><div class="other"><h3>Footer</h3></div></main>"""
    rows = spark.createDataFrame([("https://a.example/list", page), ("p", None), ("q", "<p>x</p>")], "url string, html string")
    out = templates.wrapped_rows(rows, "url", "html", [".missing", "section > .job"], ["h2", "h3"], ["a.apply"], {"place": [".place"]}).orderBy("position").collect()
    assert [(r.title, r.source_url, r.fields) for r in out] == [("Night Baker", "https://a.example/jobs/1", {"place": "Mount Lee"}), ("Cook", "https://o.example/2", {})]
    own = templates.Page(page)
    assert [own.text(k) for k in own.select("//div[2]/h3")] == ["Cook"] and own.select("div.job.hot h3 a") == own.select("a")[:1] and own.select("bad[selector") == []
    found = {r.page: r.fields for r in templates.templated(rows, "url", "html", {"title": "h3", "gone": "h6"}).collect()}
    assert found == {"https://a.example/list": {"title": "Night Baker"}}


def test_density_by_hand(spark):
    """Length, markup, links, sentences, words and paragraphs of two blocks, worked out by hand."""
    text = "You will lead a team of bakers in our night kitchen, and you join them at five."
    linked = "Jobs near you that we found for people who looked at this page some days ago now."
    page = f"<body><div><p>{text}</p><p>{text}</p></div><div><a href='/x'>{linked}</a> {linked}</div><div>short</div></body>"
    table = blocks.blocks(spark.createDataFrame([("u", page)], "page string, html string"), "page", "html")
    out = {r.node: (r.length, r.score) for r in blocks.density(table, 8).collect()}
    n, m = 2 * len(text) + 1, 2 * len(linked) + 1
    first = n * (n / len(f"<div><p>{text}</p><p>{text}</p></div>")) * (0.5 + 0.5 * 2 * len(text) / n) * (0.75 + 3 / 20) * (1 + 4 * 0.05)
    second = m * (m / len(f"<div><a href='/x'>{linked}</a> {linked}</div>")) * (1 - len(linked) / m) * (0.5 + 0.5 * 2 * len(linked) / m) * 0.75
    assert {k: (a, round(b, 4)) for k, (a, b) in out.items()} == {1: (n, round(first, 4)), 4: (m, round(second, 4))}


def test_volume_and_stratum_by_hand(spark):
    cases = [(0, 0, 0.0), (3, 0, 50.0), (5, 10, 50.0), (10, 10, 100.0), (15, 10, 100.0), (20, 10, 50.0), (40, 10, 0.0), (2, None, 50.0)]
    rows = spark.createDataFrame(cases, "jobs int, base int, expect double")
    assert all(abs(r.v - r.expect) < 1e-9 for r in rows.select("expect", composite.volume(F.col("jobs"), F.col("base")).alias("v")).collect())
    tags = spark.createDataFrame([("Workday ", None, "workday"), ("none", "https://x.Lever.co/a", "lever"), (None, "see __NEXT_DATA__", "spa_shell"), ("", "wordpress", "generic_cms"), (None, None, "bespoke")], "tag string, hay string, expect string")
    assert all(r.s == r.expect for r in tags.select("expect", composite.stratum(F.col("tag"), F.col("hay")).alias("s")).collect())
    cards = spark.createDataFrame([("a", 5, 70.0), ("b", 4, 80.0), ("c", 2, 90.0)], "stratum string, n int, composite double")
    worse = cards.withColumn("composite", F.when(F.col("stratum") == "a", 68.0).otherwise(F.col("composite")))
    assert composite.verdict(worse, cards).first().passed and not composite.verdict(worse.where("stratum <> 'b'"), cards).first().passed
    assert [r.regressed for r in composite.compared(cards.withColumn("composite", F.lit(67.9)), cards).orderBy("stratum").collect()] == [True, True]
    empty = composite.scorecard(spark.createDataFrame([], "k string, found boolean, failed boolean, warned boolean, jobs long, filled long, base long"), ["k"])
    assert empty.count() == 0


def test_known_hosts_against_all_pairs(spark):
    hosts = [("www.a.b.example",), ("c.example",), ("x.y.c.example",), ("ample",), ("",), (None,), ("zz",), ("x.y.z.c.example",)]
    known = ["b.example", "C.example", "a.b.example", "d.c.example", None, ""]
    out = {r.host: (r.known, r["rank"]) for r in suffixes.known_host(spark.createDataFrame(hosts, "host string"), spark.createDataFrame([(k,) for k in known], "known string")).collect()}
    assert out == {"www.a.b.example": ("a.b.example", 0), "c.example": ("c.example", 0), "x.y.c.example": ("c.example", 2), "ample": ("a.b.example", 3), "x.y.z.c.example": ("c.example", 3)}


def test_flat_places_and_selector_lists(spark):
    places = [('{"address":{"addressLocality":"A","addressCountry":"AU"}}', "A, AU"), ('{"name":"N","address":"s"}', "N"), ('["X",{"name":"Y"},{}]', "X, Y"), ("plain", "plain"), ("[broken", ""), (None, ""), ('"quoted"', "quoted")]
    assert all(r.p == r.expect for r in spark.createDataFrame(places, "raw string, expect string").select("expect", tx.flat_place(F.col("raw")).alias("p")).collect())
    lists = [('["a", null, "null", "\'b\'"]', ["a", "b"]), ("---\n- \".//td[4]\"\n- ''\nno", [".//td[4]"]), ("'.x'", [".x"]), ("null", []), ("[]", []), (None, []), ("[broken", [])]
    assert all(r.s == r.expect for r in spark.createDataFrame(lists, "raw string, expect array<string>").select("expect", templates.selector_list(F.col("raw")).alias("s")).collect())


def test_ranks_without_one_window(spark):
    rng = random.Random(2)
    scores = [(k, float(rng.choice([1, 1, 1, 2, 5, rng.random() * 9]))) for k in range(500)] + [(900, None)]
    out = {r.k: r.place for r in statistics.ranked(spark.createDataFrame(scores, "k int, s double"), "s", 8).collect()}
    assert out == {k: 1 + sum(1 for _, y in scores if y is not None and y > x) for k, x in scores if x is not None}
    assert statistics.ranked(spark.createDataFrame([], "k int, s double"), "s").count() == 0


def test_temporary_folder_only_on_one_machine():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            setCheckpointDir = staticmethod(lambda _: pytest.fail("a folder was set"))

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_folder(Elsewhere)


def test_smallest_label_is_the_least_reachable(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 101), (7, 7)] + [tuple(random.sample(range(200, 240), 2)) for _ in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = {r.id: r.group for r in dedup.smallest_label(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: find(x) for pair in links for x in pair}


def test_similar_places_match_all_pairs(spark, data):
    t = lambda n: spark.read.parquet(f"{data}/sf0.001/{n}.parquet")
    found = {(r.location_raw, r.market_code): r.geo_id for r in geocode.similar(t("extracted_jobs"), t("geo_locations")).collect()}
    grams = lambda s: {f"  {w} "[k : k + 3] for w in "".join(c if c.isalnum() else " " for c in s).split() for k in range(len(w) + 1)}
    names = [(r.market_code, r.geo_id, r.level, r.population or -1, grams(r.place), r.place) for r in geocode.name_table(t("geo_locations")).collect()]
    best = {}
    for r in geocode.terms(t("extracted_jobs")).collect():
        own = grams(r.place)
        for market, geo_id, level, population, theirs, name in names:
            if market == r.market_code and own & theirs:
                s = round(len(own & theirs) / len(own | theirs), 6)
                if s >= 0.35:
                    rank = (r.position, -s, -level, -population, geo_id, name)
                    key = (r.location_raw, r.market_code)
                    if key not in best or rank < best[key]:
                        best[key] = rank
    assert found == {k: v[4] for k, v in best.items()}


def test_upsert_rules(spark):
    schema = "k int, a int, b string, c int"
    old, new = spark.createDataFrame([(1, 5, "x", 9), (2, 1, None, 1)], schema), spark.createDataFrame([(2, 7, "y", 0), (3, None, "z", 4)], schema)
    out = {r.k: tuple(r)[1:] for r in merge.upsert(old, new, ["k"], {"a": "max", "b": "fill", "c": "new"}).collect()}
    assert out == {1: (5, "x", 9), 2: (7, "y", 0), 3: (None, "z", 4)}
    assert merge.upsert(old.limit(0), new.limit(0), ["k"], {"a": "max"}).count() == 0


def test_trust_merge_prefers_trust_and_measures_agreement(spark):
    rows = spark.createDataFrame([(1, 1, "structural", "A", None), (1, 2, "schema_org", "B", None), (1, 3, "llm_raw", "B", "x"), (2, 4, "unheard", None, None)], "owner int, id int, m string, title string, salary_raw string")
    out = {r.owner: r for r in merge.trust_merge(rows, ["owner"], "m", ["title", "salary_raw"], "id").collect()}
    title, pay = (1 - 1 / 3) * 10 / 10, 0.8 * 5 / 10
    assert (out[1].title, out[1].salary_raw, out[1].method) == ("B", "x", "hybrid")
    assert out[1].confidence == pytest.approx((2 * title + 1 * pay) / 3, abs=1e-6)
    assert (out[2].title, out[2].confidence, out[2].method) == (None, 0.4, "unheard")


def test_mcnemar_matches_the_binomial(spark):
    for only_a, only_b in [(0, 0), (1, 0), (3, 9), (25, 40), (0, 12), (400, 350)]:
        rows = [(1, 1, 0)] * only_a + [(1, 0, 1)] * only_b + [(1, 1, 1)] * 5
        r = statistics.mcnemar(spark.createDataFrame(rows, "y int, a int, b int"), "y", "a", "b").first()
        n, low = only_a + only_b, min(only_a, only_b)
        exact = min(1.0, 2 * sum(math.comb(n, k) for k in range(low + 1)) / 2**n) if n else 1.0
        assert (r.only_a, r.only_b) == (only_a, only_b) and r.p_value == pytest.approx(exact, abs=1e-5)


def test_bootstrap_is_near_the_normal_interval(spark):
    rows = spark.range(4000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("v"))
    r = statistics.bootstrap_mean(rows, "v", "id", 300).first()
    m, s = rows.agg(F.avg("v"), F.stddev("v")).first()
    half = 1.96 * s / 4000**0.5
    assert r.mean == pytest.approx(m, abs=1e-5) and r.low == pytest.approx(m - half, abs=half * 0.35) and r.high == pytest.approx(m + half, abs=half * 0.35)


def test_psi_of_like_sides_is_zero(spark):
    v = spark.range(200).select((F.col("id") % 50).cast("double").alias("x"))
    both = v.withColumn("side", F.lit("baseline")).unionByName(v.withColumn("side", F.lit("current")))
    assert statistics.psi_numeric(both, "side", "x").first().psi == 0.0
    moved = v.withColumn("side", F.lit("baseline")).unionByName(v.select((F.col("x") + 40).alias("x")).withColumn("side", F.lit("current")))
    assert statistics.psi_numeric(moved, "side", "x").first().severity == "major"
    assert statistics.psi_numeric(both.limit(3), "side", "x").first().psi == 0.0


def test_flips_and_pages(spark):
    rows = spark.createDataFrame([("u", i, i % 2 == 0) for i in range(9)] + [("v", 1, True)], "k string, at int, ok boolean")
    out = {r.k: (r.observations, r.flips) for r in relational.flips(rows, "k", [F.desc("at")], "ok").collect()}
    assert out == {"u": (5, 4), "v": (1, 0)}
    assert [r.at for r in relational.page(rows.where("k = 'u'"), [F.asc("at")], 2, 4).collect()] == [4, 5, 6, 7]


def test_ancestors_end_at_the_depth(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (8, 9, "x"), (9, 8, "y"), (5, 99, "z")], "i int, p int, n string")
    out = {r.i: r.path for r in relational.ancestors(rows, "i", "p", "n").collect()}
    assert out == {1: "a", 2: "b, a", 3: "c, b, a", 8: "x, y, x, y", 9: "y, x, y, x", 5: "z"}


HTML = """<html><head><title>t</title><script type="application/ld+json">{"@graph": [{"@type": "ItemList", "x": [{"@type": ["JobPosting"], "title": "Chef", "jobLocation": {"address": {"addressLocality": "Perth", "addressCountry": {"name": "AU"}}},
"baseSalary": {"currency": "AUD", "value": {"minValue": 10, "maxValue": 20, "unitText": "HOUR"}}, "employmentType": ["A", "B"]}]}]}</script><script>bad{</script></head>
<body><div class="b a"><ul><li><a href="/jobs/123">One job with words</a><li><a href="../x">Two job with words</a><li><a href="#no">Three job with words</a></ul></div><p>A &amp; B<p>C</body>"""


def test_blocks_recover_unclosed_elements(spark):
    pages = spark.createDataFrame([("https://e.example/a/b", HTML), ("n", None), ("e", "")], "page string, html string")
    table = blocks.blocks(pages, "page", "html").cache()
    assert [r.text for r in table.where("tag = 'p'").orderBy("node").collect()] == ["A & B", "C"]
    assert table.where("tag = 'li'").select("parent").distinct().count() == 1
    assert table.where("tag = 'div'").first().classes == "a b"
    assert [r.url for r in blocks.page_links(pages, "page", "html").orderBy("position").collect()] == ["https://e.example/jobs/123", "https://e.example/x"]
    job = blocks.postings(blocks.page_scripts(pages, "page", "html")).collect()
    assert [(j.title, j.location_raw, j.salary_raw, j.employment_type) for j in job] == [("Chef", "Perth, AU", "AUD 10 - 20 per hour", "A, B")]
    assert blocks.repeating_groups(table).first().items == 3


def test_sources(spark, tmp_path):
    (tmp_path / "leads.csv").write_text("﻿Name , Site\n\"A, B\",https://www.a.example/x\n,\nC,blocked.example\n", encoding="utf-8")
    rows = files.csv_rows(spark, str(tmp_path / "leads.csv"), ["name", "site"])
    assert not files.mostly_blank(rows, ["name", "site"]) and files.mostly_blank(rows.limit(0), ["name"])
    excluded = spark.createDataFrame([("a.example",), ("a.example",)], "domain string")
    out = {r.name: (r.domain, r.status) for r in files.routed(rows, "name", "site", excluded, ["blocked.example"]).collect()}
    assert out == {"A, B": ("a.example", "excluded"), None: (None, "skipped"), "C": ("blocked.example", "blocked")}
    with pytest.raises(ValueError):
        files.csv_rows(spark, str(tmp_path / "leads.csv"), ["phone"])
    (tmp_path / "domains.csv").write_text("domain\nWWW.X.example\nhttps://x.example/a\n\ny.example\n")
    assert {r.domain for r in files.domain_lines(spark, str(tmp_path / "domains.csv")).collect()} == {"x.example", "y.example"}
    fields = ["7", "Náme", "Name", ",".join(f"n{k}" for k in range(20)), "1.5", "2.5", "P", "PPL", "AU", "", "02", "", "", "", "12000", "", "", "", "2020-01-01"]
    (tmp_path / "geo.txt").write_text("\t".join(fields) + "\n" + "\t".join(fields[:10]) + "\n" + "\t".join([*fields[:6], "H", "LK", *fields[8:]]) + "\n", encoding="utf-8")
    geo = files.gazetteer_rows(spark, str(tmp_path / "geo.txt")).collect()
    assert len(geo) == 1 and geo[0].id == 7 and len(geo[0].alt_names) == 15 and geo[0].population == 12000
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "one.html").write_text("<p>1</p>\n<p>2</p>")
    (tmp_path / "manifest.json").write_text(json.dumps([{"domain": "d", "url": "u", "snapshot_path": "pages/one.html", "expected_titles": ["a"], "expected_job_count": 1}, {"domain": "e", "snapshot_path": "pages/none.html"}]))
    shots = {r.domain: r.html for r in files.snapshots(spark, str(tmp_path / "manifest.json"), str(tmp_path / "pages")).collect()}
    assert shots == {"d": "<p>1</p>\n<p>2</p>", "e": None}
    board = spark.createDataFrame([(json.dumps({"postings": [{"id": "1", "text": "T", "categories": {"location": "L"}}]}),), ("broken{",), (None,)], "body string")
    assert [(r.external_id, r.title, r.location_raw) for r in files.board_jobs(board, "body", "postings").collect()] == [("1", "T", "L")]


def test_sinks_round_trip(spark, tmp_path):
    rows = exports.exported(spark.createDataFrame([(1, 'a "b"\nc', None)], "id int, t string, u string"), ["id", "t", "u", "missing"])
    exports.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(str(tmp_path / "c")).first()
    assert tuple(back)[:2] == ("1", 'a "b"\nc')
    exports.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().t == 'a "b"\nc'


def test_streams_equal_their_tables(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/sf0.001/events.parquet")
    for k, part in enumerate(source.randomSplit([0.3, 0.3, 0.4], 5)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: streams.file_stream(spark, str(tmp_path / "in"), f"{data}/sf0.001/events.parquet")
    ratchet = streams.Ratchet(str(tmp_path / "t"), ["user_id"], {"best": "max"}, lambda b: b.groupBy("user_id").agg(F.max("value").alias("best")))
    streams.run_available(stream(), ratchet, str(tmp_path / "c1"))
    assert ratchet.last == 2
    expect = {(r.user_id, r.best) for r in source.groupBy("user_id").agg(F.max("value").alias("best")).collect()}
    assert {(r.user_id, r.best) for r in ratchet.table(spark).collect()} == expect
    ratchet(source.limit(5), 2)
    assert {r.user_id for r in ratchet.table(spark).collect()} <= {u for u, _ in expect}
    got = {}
    counters = streams.attempt_counters(stream().withColumn("ok", F.col("value") > 20), "user_id", "ok", "ts", late="60 days")
    query = counters.writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({r.key: (r.attempts, r.successes) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert got == {str(r.user_id): (r.n, r.s) for r in source.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("s")).collect()}
    query = streams.hourly(stream(), "ts", "event_type", "value", "400 days").writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((r.hour, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("hourly")) == key(streams.hourly(source, "ts", "event_type", "value"))


def test_confident_export_keeps_halves(spark, tmp_path):
    from loamworks.plans.feeds import k4_confident_only

    rows = [(1, 0.825, "a"), (2, 0.805, "b"), (3, 0.8, "c"), (4, None, "d"), (5, 0.795, "e"), (6, 0.8249, None)]
    spark.createDataFrame(rows, "job_id long, extraction_confidence double, salary_raw string").write.parquet(str(tmp_path / "extracted_jobs.parquet"))
    out = {r.job_id: (r.salary_raw, r.confidence) for r in k4_confident_only(spark, str(tmp_path)).collect()}
    assert out == {1: ("a", "0.83"), 2: ("b", "0.81"), 3: ("c", "0.80"), 4: ("", "0.00"), 5: ("", "0.80"), 6: ("", "0.82")}


def test_short_pages_keep_pages_with_entities(spark, tmp_path):
    from loamworks.plans.pages import h8_short_pages

    # 250 signs and 10 ampersands are 260 visible signs, one fewer is short; written out, the entities are longer.
    rows = [("long", "<p>" + "x" * 250 + "&amp;" * 10 + "</p>"), ("short", "<p>" + "x" * 249 + "&amp;" * 10 + "</p>"), ("plain", "<p>x</p>")]
    spark.createDataFrame(rows, "snapshot_path string, html string").write.parquet(str(tmp_path / "snapshot_files.parquet"))
    assert {r.page: r.short for r in h8_short_pages(spark, str(tmp_path)).collect()} == {"long": False, "short": True, "plain": True}
