"""The operators against brute force, on odd rows and on empty tables."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from conftest import DOCS, PAGES

from pairloom.llm import byte_bpe, html_text, language_id, mixing, near_dedup, nearest, quality_classifier, quality_rules, sharding, url_filter
from pairloom.llm import queries as llm
from pairloom.llm.words import words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# -- 1 -----------------------------------------------------------------------


def test_urls_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = con.sql(llm.ORACLES["op1_url_filter"])
    mine = llm.QUERIES["op1_url_filter"](spark, SF).select(*rel.columns)
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(map(str, rel.fetchall()))


def test_urls_odd(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org/en/12", "x://notexample.org/es/", "x://example.org", "http://org/a", "ftp://a.com/de/", "http://.org/x", "http://b.com/frog", "http://host.com/a://b.org/", "http://org?/x", "http://cheap-pills.example.net/a"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.url_filter(df, llm.CONTRACT_RULES, llm.FALLBACK_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"), ("example.org", "", None, "allow"), ("org", "/a", "org/", "allow"), ("a.com", "/de/", "com/de/", "block"), (".org", "/x", "org/", "allow"),
        ("b.com", "/frog", None, "allow"), ("host.com", "/a://b.org/", None, "allow"), ("org", "", None, "allow"), ("cheap-pills.example.net", "/a", None, "block"),
    ]
    assert url_filter.url_filter(df.limit(0), llm.CONTRACT_RULES).count() == 0
    assert url_filter.url_filter(df, []).where("verdict = 'block'").count() == 0


def test_index_by_rarest_token():
    rules = [url_filter.Rule("example.org/en/1", "block"), url_filter.Rule("*-x-*", "block"), url_filter.Rule("*ads*", "block"), url_filter.Rule("^Ads^", "block"), url_filter.Rule("*free-download*", "block")]
    assert [r.keys() for r in rules] == [["example", "org", "en"], ["x"], ["~ads"], ["ads"], ["~" + "free-download"[i : i + 3] for i in range(11)]]
    assert url_filter.filed(rules, {"example": 9, "org": 9, "en": 2, "~fre": 4, "~ee-": 1, "~e-d": 1, **{"~" + "free-download"[i : i + 3]: 2 for i in range(4, 11)}, "~ree": 3}) == ["en", "x", "~ads", "ads", "~e-d"]


def fits(rule, host, path):
    where, literal = host + path, rule.literal
    if rule.pattern[0] == "*":
        return literal.translate(LOWER) in where.translate(LOWER)
    if rule.pattern[0] == "^":
        return re.search(rf"(?<![a-z0-9]){re.escape(literal.translate(LOWER))}(?![a-z0-9])", where.translate(LOWER)) is not None
    of, _, start = rule.pattern.partition("/")
    return (host == of or host.endswith("." + of)) and path.startswith("/" + start)


def test_many_rules_against_brute_force(spark):
    rng = np.random.default_rng(4)
    names = ["a", "b", "ads", "my-ads", "x1", "shop", "news", "été", "casino", "ad"]
    pick = lambda: names[int(rng.integers(len(names)))]
    rules = [url_filter.Rule(f"{pick()}.{pick()}/{pick()}", "block") for _ in range(40)] + [url_filter.Rule(f"{pick()}/", "allow") for _ in range(9)]
    others = [url_filter.Rule(f"*{x}*", "block") for x in ("sino", "ads/", "-ADS", "été/n")] + [url_filter.Rule(f"^{x}^", "block") for x in ("ads", "shop", "my-ads", "x1/ad")]
    many = [url_filter.Rule(f"host{i}.test/p{i}/", "block") for i in range(3000)]
    urls = [f"http://{pick()}.{pick()}.{pick().upper()}/{pick()}{pick()}/{pick().title()}?q=ads" for _ in range(300)] + ["http://" + "x" * 100_000 + ".casino/", "http://www.host17.test/p17/x", "http://host17.test/p1/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:5])], "page_id long, url string")
    got = url_filter.url_filter(df, rules + many + rules[:3], others).collect()
    assert len(got) == len(urls) + 5 and {r.verdict for r in got} == {"allow", "block"} and sum(r.pattern_rule is not None for r in got) > 20
    best = lambda rs, r: min((x for x in rs if fits(x, r.host, r.path)), key=lambda x: (-len(x.pattern), x.pattern), default=None)
    for r in got:
        first, second = best(rules + many, r), best(others, r)
        assert (r.rule, r.pattern_rule) == (first and first.pattern, None if first else second and second.pattern) and r.verdict == (first or second or rules[-1]).verdict


def test_only_fetched_rules_run(spark):
    """A rule whose regular expression fails when it runs does no harm where no URL holds its key."""
    broken = type("Broken", (url_filter.Rule,), {"regex": property(lambda self: "(")})("^never-seen^", "block")
    df = spark.createDataFrame([(1, "http://a.org/ads/")], "page_id long, url string")
    assert url_filter.url_filter(df, [], [broken, url_filter.Rule("*ds/*", "block")]).first().pattern_rule == "*ds/*"
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        url_filter.url_filter(spark.createDataFrame([(1, "http://a.org/seen/never")], "page_id long, url string"), [], [broken]).collect()
    for bad in ("*a*", "**", "^-^", "x" * 500):
        with pytest.raises(ValueError, match="needs"):
            url_filter.url_filter(df, [url_filter.Rule(bad, "block")])


# -- 2 -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_feistel(n):
    f = sharding.Feistel(n, 5)
    p = f.position(np.arange(n))
    assert sorted(p) == list(range(n)) and list(f.row(p)) == list(range(n))
    shard, slot = sharding.locate(np.arange(n), n, 7, 5)
    assert list(sharding.row_at(shard, slot, n, 7, 5)) == list(range(n))


def check_shards(rows, n, shards):
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == n and all(sorted(s) == list(range(len(s))) for s in per.values())
    sizes = [len(per.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark, odd_docs, no_docs, sf001):
    rows = sharding.shard(odd_docs, 4).collect()
    check_shards(rows, odd_docs.count(), 4)
    want = sorted((r.doc_id if r.doc_id is not None else -1, 16 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard(no_docs, 4).count() == 0
    a = sorted(map(str, sharding.shard(sf001, 40).collect()))
    assert a == sorted(map(str, sharding.shard(sf001.repartition(5), 40).collect()))
    check_shards(sharding.shard(sf001, 40).collect(), 200, 40)


# -- 3 -----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body class="has-sidebar"><!-- <p>no</p> -->
<header><h1>Site</h1><p>The best site about all sorts of things in the world.</p></header><nav><ul><li><a href="/">Home</a><li><a>About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to give you the best experience on our site.</p></div>
<article><header><h2>Storm hits coast</h2></header><p>A large&nbsp;storm hit the <b>coast</b> on Monday &amp; left many
homes without power.<p>Short.<br><ul><li>One point of the article.<li>Another point</ul>
<div class="ad">Buy the best pills now, cheap and quick.</div><form><p>Subscribe to our letter.</p></form><p>It was the third storm &lt;this year&gt;.</article>
<aside><p>Popular: this and that, and the other thing as well.</p></aside><section id="comments"><p>I think this is great news for everyone who lives there.</p></section>
<footer>&copy; 2020 All rights reserved.</footer></body></html>"""
TEXT = "Storm hits coast\nA large storm hit the coast on Monday & left many homes without power.\nShort.\nOne point of the article.\nAnother point\nIt was the third storm <this year>."


def test_html():
    assert html_text.main_text(PAGE) == TEXT
    plain = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>").replace("<header><h2>", "<h2>").replace("</h2></header>", "</h2>")
    assert html_text.main_text(plain) == TEXT
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == ""
    assert html_text.main_text("<article><p>never closed <script>x") == "never closed"
    assert html_text.main_text("<article><p>a</div></b><p>b<!-- open") == "a\nb"


def test_html_layout_names():
    """Wrappers named for a layout, and a form around the page, don't take the article away."""
    story = "<p>A large storm hit the coast on Monday and left many homes without power.</p><p>It was the third storm this year, said the mayor of the town.</p>"
    text = "A large storm hit the coast on Monday and left many homes without power.\nIt was the third storm this year, said the mayor of the town."
    side = '<div class="sidebar"><p>Popular: this and that, too.</p></div><div class="related"><article><p>Another storm, last year.</p></article></div>'
    for wrapper in ('<div class="page has-sidebar">', '<div class="no-sidebar">', '<div class="hasSidebar">', '<div class="sidebar-layout">', '<form id="aspnetForm">', '<div class="print"><form>'):
        for holder in ("article", "main"):
            assert html_text.main_text(f"<body>{wrapper}<{holder}>{story}</{holder}>{side}</body>") == text, (wrapper, holder)
    for wrapper in ('<form id="aspnetForm">', '<div class="page has-sidebar">', '<div class="links-layout">'):
        assert html_text.main_text(f"<body>{wrapper}<div>{story}</div></body>") == text, wrapper
    comments = '<section id="comments"><article class="comment"><p>' + "I think this is great news for everyone who lives there. " * 20 + "</p></article></section>"
    assert html_text.main_text(f"<body><article>{story}</article>{comments}</body>") == text
    deep = '<div class="ad">' * 3_000 + f"<article>{story}</article>"
    assert html_text.main_text(deep) == text


SOUP = """<body><div id="top"><a href="/">Home</a></div><div><a href="/a">News of the day</a></div><div><a href="/b">All that you need.</a></div>
<div id="x1"><h2>Storm hits coast</h2><div>A large storm hit the coast on Monday and left many homes without power until the evening.</div><div>Why</div>
<div>It was the third storm this year, said the mayor of the town, and the worst one by far that anyone could think of.</div><div>So</div><div>Nobody
was hurt in the storm, but the road along the sea will stay shut for a week or two, and the trains are late as well.</div></div>
<div><div><a href="/c">More</a></div><div><a href="/d">Most read</a></div></div></body>"""


def test_edges_decide(monkeypatch):
    """Short blocks between long ones are content by their ties alone; max-flow runs on every page with text."""
    runs, flow = [], html_text._max_flow
    monkeypatch.setattr(html_text, "_max_flow", lambda *a: runs.append(1) or flow(*a))
    bs = html_text.blocks(SOUP)
    own = [html_text.score(b) > 0 for b in bs if html_text.settle(bs) is None]
    cut = html_text.labels(bs)
    texts = [b.text for b in bs]
    assert {t for t, alone, tied in zip(texts, own, cut) if tied and not alone} == {"Storm hits coast", "Why", "So"} and len(runs) == 1
    assert [t for t, tied in zip(texts, cut) if not tied] == ["Home", "News of the day", "All that you need.", "More", "Most read"]
    monkeypatch.setattr(html_text, "edges", lambda bs: ([], 0))
    assert html_text.labels(bs) == own != cut


def test_html_wrappers():
    story = "<p>A large storm hit the coast on Monday and left many homes without power.</p>"
    text = "A large storm hit the coast on Monday and left many homes without power."
    for page in ('<div class="layout has-sidebar"><article>%s</article></div>', '<div class="with-sidebar"><main>%s</main></div>', '<div id="page" class="no-sidebar">%s</div>', '<div class="search-page"><article>%s</article></div>', '<article><div class="print-area">%s</div></article>', '<form id="aspnetForm"><article>%s</article></form>'):
        assert html_text.main_text(page % story) == text, page
    assert html_text.main_text("<article><p>Let <math><mi>x</mi></math> be it.</p></article>") == "Let x be it."
    long = "I think this is great news for everyone who lives there, and for all of their friends as well. " * 5
    assert html_text.main_text(f'<article>{story * 3}<div id="comments"><p>{long}</p><p>{long}</p></div></article>') == "\n".join([text] * 3)


def test_html_tables():
    assert [b.text for b in html_text.blocks("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f<dl><dt>g<dd>h</dl><ul><li>i<li>j<ol><li>k</ol>l</ul>")] == list("abcdefghijkl")
    assert [b.text for b in html_text.blocks("a < b<p title='x > y'>c</p><a href=it's>d</a><!-- > -->e<p class=\"z\"q>f<?g>h</ x>i")] == ["a < b", "c", "de", "fhi"]
    assert [b.text for b in html_text.blocks("<p>a<svg/>b<iframe>c<script>d</script>e<p>f<style>g")] == ["a b c e", "f"]


def test_html_hostile():
    """Time grows with the page's length, whatever is left open or closed twice."""
    import time

    n = 20_000
    pages = ["<div>" * n + "</section>" * n, "<" + "a" * 50 * n, "<a" * n, "<iframe>" * n, "<!" * n, '<a b="' * n, "<li><ul>" + "<div>" * n + "<li></li>" * n, "<b><div>" + "<i>" * n + "</b>x" * n, "<b>" * n + "x<p>y</p>" * n, "<article>" + "<p>word " * n, "<table>" * n + "<td>x" * n, "<!--" * n, "&" * n + "&amp" * n]
    for page in pages:
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 10, page[:40]


def test_learned_weights(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_text.sample(pages)
    weights = html_text.learn(got)
    assert 0 < len(got) <= pages.select("html").distinct().count() and html_text.sample(pages.union(pages).repartition(3)) == got and weights != html_text.PRIOR and html_text.learn(reversed(got)) == pytest.approx(weights, abs=1e-5)
    assert html_text.learn([]) == html_text.learn(["<p>nothing says what this is"]) == html_text.PRIOR
    # a block of either kind is on the right side by what its text says
    said = [(sum(w * x for w, x in zip(weights, html_text.features(b))) > 0, not html_text.against(b.home)) for h in got for bs in [html_text.blocks(h)] if html_text.settle(bs) is None for b in bs if html_text.against(b.home) or b.home.state[1]]
    assert np.mean([x == y for x, y in said]) > 0.8


def test_pages_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = con.sql(llm.ORACLES["op3_html_text"])
    assert sorted(map(tuple, llm.QUERIES["op3_html_text"](spark, SF).select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_minimum_cut_is_least():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        s = [float(v) for v in rng.normal(size=n)]
        ties = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label):
            return sum(abs(v) for v, k in zip(s, label) if (v > 0) != k) + sum(w for i, j, w in ties if label[i] != label[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(s, ties)) == pytest.approx(best)


def test_pages(spark):
    odd = [(1, None, None), (2, "u", PAGE), (2, "u", PAGE), (None, "u", ""), (3, "u", "<article>" + "<p>word " * 20_000)]
    df = spark.createDataFrame(odd, PAGES).withColumns({c: F.lit("clash") for c in ("text", "_mark", "_html")})
    assert sorted(r.page_id or 0 for r in html_text.extract(df).collect()) == [0, 1, 2, 2, 3]
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[1].text == "" and got[1].n_chars == 0 and got[2].text == TEXT and got[2].n_chars == len(TEXT) and got[3].n_chars == 20_000 * 5 - 1
    assert html_text.extract(df.limit(0)).count() == 0
    for r in llm.QUERIES["op3_html_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        from html import unescape

        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"<(?:/?p|/?h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


# -- 4 -----------------------------------------------------------------------


def statistics(text):
    w = WORD.findall(text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_statistics(spark, odd_docs, no_docs, sf001):
    extra = spark.createDataFrame([(100, "a b c a b c a", "en", "s", 1), (101, "a\n\na\n b\n b\nb\r\n", "en", "s", 1), (102, "a a a a", "en", "s", 1), (103, "x y z q x y z", "en", "s", 1)], DOCS)
    for df in (odd_docs, extra, sf001):
        for r in quality_rules.with_statistics(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(r.text)
    judged = quality_rules.apply(odd_docs, quality_rules.DecisionList())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed) for r in judged.collect())
    assert quality_rules.kept_only(quality_rules.apply(no_docs, quality_rules.DecisionList())).count() == 0


def test_decision_list():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    bad = ((x[:, 0] > 0.7) & (x[:, 1] > 0.5)) | (x[:, 1] < 0.1)
    rules = quality_rules.learn(x, bad, ["symbols_per_word", "upper_share"])
    drop = np.zeros(600, bool)
    for tests, _ in rules.rules:
        drop |= quality_rules._covers(list(tests), x, ["symbols_per_word", "upper_share"])
    assert (drop == bad).mean() > 0.95 and len(rules.rules) >= 2
    assert str(quality_rules.DecisionList()) == "keep all" and quality_rules.learn(x, np.zeros(600, bool), ["a", "b"]).rules == ()


def test_rules_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.fit(docs, labels)
    got = quality_rules.apply(docs, rules).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.05 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert quality_rules.fit(docs, labels.limit(0)).rules == ()


# -- 5 -----------------------------------------------------------------------


def test_resampling(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged, sample = quality_classifier.resample(docs, labels)
    rows = judged.collect()
    k = quality_classifier.wanted(judged.drop("kept"), labels)
    least = sorted((r.key for r in rows), reverse=True)[k - 1]
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in rows if r.key >= least} == {r.doc_id for r in sample.collect()}
    q = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.kept for r in rows if q.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if q.get(r.doc_id) == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    odd = odd_docs
    some, kept = quality_classifier.resample(odd, labels, share=0.5)
    assert some.count() == odd.count() and kept.columns == odd.columns and {r["_key"] for r in kept.collect()} == {"clash"}
    none, kept = quality_classifier.resample(no_docs, labels)
    assert none.count() == kept.count() == 0
    flat, _ = quality_classifier.resample(odd, labels.limit(0), share=1.0)
    assert {r.log_weight for r in flat.collect()} == {0.0}


def test_recall_on_held_out_labels(spark):
    """Good documents whose labels the fit has not seen are kept like those that it has, in each language."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0
    judged, _ = quality_classifier.resample(docs, labels.where(~held))
    rows = judged.join(labels.where(held).select("doc_id", "quality"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        good = [r.kept for r in rows if r.quality == 1 and r.lang == lang]
        assert len(good) > 50 and np.mean(good) > 0.95, (lang, np.mean(good))
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_weights_leave_own_fold_out(spark, sf001):
    docs = sf001.limit(60).select("text")
    models = quality_classifier.fold_models(docs)
    folds = docs.withColumn("fold", quality_classifier.fold_of(F.col("text")))
    for k in range(quality_classifier.FOLDS):
        assert (models[k] == quality_classifier.model(folds.where(F.col("fold") != k).select("text"))).all()
    ratios = np.random.default_rng(3).normal(size=models.shape)
    for r in folds.withColumn("w", quality_classifier.log_weight(F.col("text"), ratios, 100)).collect():
        one = quality_classifier.model(spark.createDataFrame([(r.text,)], "text string"))
        assert r.w == pytest.approx((one * ratios[r.fold]).sum() * min(1, 100 / max(one.sum(), 1)), abs=1e-5)


def test_weights_by_hand(spark, sf001):
    docs = sf001.limit(40)
    target = quality_classifier.model(docs.limit(10).select("text"))
    raw = quality_classifier.model(docs.select("text"))
    assert raw.sum() == sum(max(2 * len(WORD.findall(r.text)) - 1, 0) for r in docs.collect())
    ratios = quality_classifier.log_ratios(target, raw)
    for r in docs.select("text", quality_classifier.log_weight(F.col("text"), ratios).alias("w")).collect():
        one = quality_classifier.model(spark.createDataFrame([(r.text,)], "text string"))
        assert r.w == pytest.approx((one * ratios).sum(), abs=1e-5)


def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=3000)] + [7.0] * 500 + [7.0000000000000009] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 3, 4, 400, 503, 504, 3000, 3503):
        assert quality_classifier.kth_largest(df, "x", k, few=20, bins=16) == sorted(values, reverse=True)[k - 1]


# -- 6 -----------------------------------------------------------------------


def code_length(texts, text, order=language_id.ORDER):
    """Bits of text under one language, straight from the definition."""
    counts = Counter()
    for t in texts:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                counts[t[i - k : i], t[i]] += 1
    total, kinds = Counter(), Counter()
    for (c, _), n in counts.items():
        total[c] += n
        kinds[c] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            c = text[i - k : i]
            if c not in kinds:
                continue
            n, d = total[c], kinds[c]
            if counts[c, text[i]]:
                bits -= np.log2(counts[c, text[i]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths():
    texts = {"a": [b"the cat sat on the mat", b"then"], "b": [b"le chat est la", "été".encode()]}
    m = language_id.Model(texts)
    some = [b"the chat", b"zzz", b"", "\u00e9t\u00e9 x".encode(), b"t"]
    raw = np.frombuffer(b"".join(some), np.uint8)
    got = m.bits(raw, np.concatenate([[0], np.cumsum([len(s) for s in some])]).astype(np.int64))
    want = [[code_length(texts[k], s) for k in "ab"] for s in some]
    assert np.allclose(got, want, atol=1e-3)


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and len(held) > 200
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert odd[4].lang_pred == odd[3].lang_pred == odd[5].lang_pred == "und" and odd[1].lang_pred in model.languages and not odd[None].held_out
    assert language_id.predict(no_docs, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd_docs, language_id.train(no_docs)).collect()} == {"und"}


# -- 7 -----------------------------------------------------------------------


def test_water_fill():
    t = mixing.water_fill([10, 1000, 1000], [1, 2, 3], 2010, 3)
    assert t[0] == 30 and sum(t) == pytest.approx(2010) and t[2] / t[1] == pytest.approx(1.5)
    assert mixing.water_fill([0, 5], [1, 2], 5, 3) == [0, 5]
    counts = mixing.draw_counts([7, 0, 100, 3], 4, 1)
    assert counts.sum(0).tolist() == [7, 0, 100, 3] and counts.sum(1).tolist() == [27, 28, 27, 28]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 63, 64, 65, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def check_mix(rows, docs, block):
    size = {}
    for r in docs:
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill([size[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(size.values()), 3)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, len(WORD.findall(r.text or ""))) for r in docs)
    for s, t in zip(names, want):
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == size[s] and r.target == pytest.approx(t) and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 4 * block


def test_mix(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    check_mix(rows, docs.collect(), 128)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    odd = odd_docs
    check_mix(mixing.mix(odd, block=16).collect(), odd.collect(), 16)
    assert mixing.mix(no_docs).count() == 0


def test_mixed_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = r.taken
    text = {r.doc_id: r.text for r in docs.collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        own = WORD.findall(r.text)
        got[r.doc_id] += len(own)
        assert r.n_chars == len(r.text) and (r.text == text[r.doc_id] or set(own) <= set(WORD.findall(text[r.doc_id])))
    assert got == Counter({k: v for k, v in taken.items() if v})
    odd = odd_docs
    n = Counter()
    for r in mixing.mixed_documents(odd, block=16).collect():
        n[r.doc_id] += len(WORD.findall(r.text))
    want = Counter()
    for r in mixing.mix(odd, block=16).collect():
        want[r.doc_id] += r.taken
    assert n == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixed_documents(no_docs).count() == 0


# -- 8 -----------------------------------------------------------------------


def brute_neighbours(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, v in fine:
        if i % 20 == 0:
            near = sorted((-float(sum(a * b for a, b in zip(v, w))), j) for j, w in fine if j != i and len(w) == len(v))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [None] * 16), (2100, [1.0] * 8), (2101, [2.0] * 8), (None, [1.0] * 16), (2120, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("clash"))
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_neighbours(rows, 20)
    assert got.keys() == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [j for j, _ in v] == [j for j, _ in want[q]] and np.allclose([s for _, s in v], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(llm.ORACLES["op8_nearest"])
    got = llm.QUERIES["op8_nearest"](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# -- 9 -----------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    s = {r.doc_id: shingles(r.text) for r in docs}
    up = {d: d for d in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(v), top(d)) for d, v in s.items()}


def test_near_duplicates(spark, sf001, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in range(160)]
    rows = list(sf001.collect())
    for i in range(150):
        w = list(base)
        for j in rng.choice(160, int(rng.integers(0, 8)), replace=False):
            w[j] = f"e{i}_{j}"
        rows.append((10_000 + i, " ".join(w), "en", "s", 1))
    for i in range(80):
        rows.append((20_000 + i, " ".join(["one shared passage of words that all have"] + [f"u{i}_{k}" for k in range(40)]), "en", "s", 1))
    df = spark.createDataFrame(rows, DOCS)
    want = brute_components(df.collect())
    for limit, tile in ((1024, 256), (12, 8)):
        monkeypatch.setattr(near_dedup, "LIMIT", limit)
        monkeypatch.setattr(near_dedup, "TILE", tile)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
        assert got == want
    kept = near_dedup.deduplicated(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want.values()})


def test_near_duplicates_odd(spark, odd_docs, no_docs):
    odd = odd_docs
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert got[1, 3, 1, True] == 2 and got[2, 3, 1, False] == 1 and got[3, 0, 3, True] == got[4, 0, 4, True] == got[5, 0, 5, True] == 1
    assert got[8, 1, 8, True] == 1 and got[9, 1, 8, False] == 1 and got[None, 3, None, True] == 1 and got[None, 0, None, True] == 1
    assert {k[2] for k in got if k[0] in (6, 7)} == {6} and sum(got.values()) == odd.count()
    kept = near_dedup.deduplicated(odd)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 10, 11] and kept.columns == odd.columns and {r.rep for r in kept.collect()} == {"clash"} and kept.where("doc_id is null").count() == 2
    assert near_dedup.near_duplicates(no_docs).count() == near_dedup.deduplicated(no_docs).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f", "", "", 0), (1, "q w e r t y", "", "", 0), (2, "q w e r t y", "", "", 0), (3, "a b c d e f", "", "", 0)], DOCS)
    assert {r.component_id for r in near_dedup.near_duplicates(two).collect()} == {1}


def thue_morse(n):
    """Two different words whose polynomials are equal modulo 2^64 for any odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    pairs = [thue_morse(n) for n in (3, 6, 9, 10, 12)]
    h, _ = words(*(lambda raw: (raw, np.array([0, len(raw)])))(np.frombuffer(" ".join(w for p in pairs for w in p).encode(), np.uint8)))
    assert len(set(h.tolist())) == 2 * len(pairs)
    x, y = pairs[2]
    docs = spark.createDataFrame([(1, x, "", "", 0), (2, y, "", "", 0), (3, x + " z", "", "", 0)], DOCS)
    assert {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()} == {1: (1, True), 2: (2, True), 3: (3, True)}


def test_words_of_any_length():
    rng = np.random.default_rng(5)
    some = ["".join(rng.choice(list("abAB"), int(n))) for n in rng.integers(1, 80, 3000)] + ["a" * n for n in range(1, 200)]
    texts = [" ".join(some[:1500]), "\t".join(some[1500:]), ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for lower in (True, False):
        h, to = words(raw, at, 3, lower)
        of = {}
        for w, v in zip(some, h.tolist(), strict=True):
            of.setdefault(w.lower() if lower else w, set()).add(v)
        assert to.tolist() == [0, 1500, len(some), len(some)] and all(len(v) == 1 for v in of.values()) and len({next(iter(v)) for v in of.values()}) == len(of)


def test_words():
    texts = ["a  b\tC", "", " ", "é ñ", "a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    h, at = words(raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64))
    assert at.tolist() == [0, 3, 3, 3, 5, 6] and h[0] == h[5] and len(set(h.tolist())) == 5


# -- 10 ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    e = byte_bpe.Encoder.from_tiktoken(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return e, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={}), P


def test_bpe(spark, tokenizer, odd_docs, no_docs, sf001):
    e, other, P = tokenizer
    path = P.path("byte_bpe_50k.tiktoken")
    for df in (odd_docs, sf001):
        want = Counter()
        for r in df.collect():
            ids = other.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, byte_bpe.encode_texts(df, path, P.PATTERN).collect())) == want
    assert byte_bpe.encode_texts(no_docs, path, P.PATTERN).count() == 0
    both = byte_bpe.decode(byte_bpe.encode(odd_docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)


def test_bpe_bytes(tokenizer):
    e, other, _ = tokenizer
    rng = np.random.default_rng(8)
    for _ in range(400):
        raw = bytes(rng.choice(list(b"aetnih \n.\xc3\xa9\xff0"), int(rng.integers(1, 60))).astype(np.uint8))
        p = byte_bpe.Prefixes(e, raw)
        assert p.ids() == other._core_bpe.encode_single_piece(raw)
        p.append(b"ing the")
        assert p.ids() == other._core_bpe.encode_single_piece(raw + b"ing the")
        a, b = sorted(rng.integers(0, len(raw) + 1, 2))
        p.edit(int(a), int(b), b"tion")
        assert p.ids() == other._core_bpe.encode_single_piece(raw[:a] + b"tion" + raw[b:] + b"ing the")
    long = byte_bpe.Prefixes(e, b"the quick brown fox " * 500)
    assert long.edit(100, 103, b"x") < 500


# -- pipeline ----------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.collect(), stage(spark, docs, sf)
        rows = out.collect()
        if name in ("quality_classifier", "quality_rules"):
            clean = [r.doc_id for r in before if r.doc_id in labels and labels[r.doc_id].quality == 1 and statistics(r.text)[0] >= 50]
            kept = {r.doc_id for r in rows}
            assert np.mean([d in kept for d in clean]) > 0.97 and len(rows) < len(before)
        if name == "near_dedup":
            assert sorted(r.doc_id for r in rows) == sorted({c for _, c in brute_components(before).values()})
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, out.schema)
        else:
            text = Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in before)
            assert Counter(r.decoded_sha256 for r in rows) == text


def test_mixed_rows_are_whole(spark):
    """Equal texts under one doc_id keep each their own columns."""
    rows = [(1, "a b c d e f g h " * 20, "l%d" % i, "s", i) for i in range(6)] + [(2, "x y " * 60, "m", "t", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("_row", "_doc", "_full", "_parts", "_text", "row_id", "start")})
    got = mixing.mixed_documents(docs, block=16).collect()
    assert {r.lang for r in got} <= {f"l{i}" for i in range(6)} | {"m"} and {r["_row"] for r in got} == {r["start"] for r in got} == {"clash"}
    taken = Counter()
    for r in mixing.mix(docs, block=16).collect():
        taken[r.doc_id] += r.taken
    words_of = Counter()
    for r in got:
        words_of[r.doc_id] += len(WORD.findall(r.text))
    assert words_of == taken and max(Counter(r.lang for r in got).values()) <= 4


def test_pipeline_odd(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables pass through each stage and through run."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, None), (None, 1, 1), (6, None, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    long = spark.createDataFrame([(i, f"plain words that go on for a while number {i} " * 12, "en", "s" if i % 3 else None, 1) for i in range(40, 70)], DOCS)
    for name, docs, marks in (("odd", odd_docs.unionByName(long, allowMissingColumns=True), labels), ("none", no_docs, labels.limit(0)), ("unlabelled", odd_docs, labels.limit(0))):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        marks.write.parquet(f"{sf}/labels.parquet")
        assert corpus_pipeline.run(spark, sf).count() == corpus_pipeline.run(spark, sf).count()
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            n = out.count()
            assert stage_name == "byte_bpe" or out.columns == docs.columns
            assert n == docs.count() if stage_name == "byte_bpe" else stage_name == "mixing" or n <= docs.count()


def test_pipeline_rules_learn(spark, monkeypatch):
    """The rules stage has a list of its own, though the classifier has taken the labelled bad documents away."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    left = docs.join(labels.where("quality = 0"), "doc_id", "left_anti")
    lists, fit = [], quality_rules.fit
    monkeypatch.setattr(quality_rules, "fit", lambda *a, **k: lists.append(fit(*a, **k)) or lists[-1])
    out = corpus_pipeline.rules(spark, left, sf)
    assert len(lists) == 1 and lists[0].rules
    assert out.columns == left.columns and out.join(left, "doc_id", "left_anti").isEmpty()


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names


def test_mix_with_many_sources(spark, odd_docs, monkeypatch):
    """Beyond the bound of a broadcast, sources are joined by a salted key; the result is the same."""
    few = sorted(map(str, mixing.mix(odd_docs, block=16).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(odd_docs, block=16).collect())) == few


def test_pipeline_row_groups(spark, tmp_path):
    """What a stage's caller and materialize write comes in row groups far below 128 MB, of which each task holds one."""
    import pyarrow.parquet as pq

    import corpus_pipeline
    from pairloom.llm.store import materialize

    spark.conf.unset("parquet.block.size")
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 150), x -> sha2(concat(id, '-', x), 256)))").alias("text"))
    rules = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "/root/testdata/sf0.001")
    try:
        rules.write.parquet(f"{tmp_path}/rules")
        spark.conf.unset("parquet.block.size")
        _, made = materialize(docs, "groups")
        for folder in (tmp_path / "rules", Path(made.removeprefix("file:"))):
            (file,) = folder.glob("*.parquet")
            assert pq.ParquetFile(file).metadata.num_rows == 4000 and pq.ParquetFile(file).num_row_groups > 1
    finally:
        spark.conf.unset("parquet.block.size")


def test_stages_alone(tmp_path):
    """A stage called by itself, in a driver that was started elsewhere and without PYTHONPATH: workers find the package."""
    import os
    import subprocess

    import corpus_pipeline

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.abspath(corpus_pipeline.__file__))!r})
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {f"file://{tmp_path}/shared"!r}).getOrCreate()
sf = "/root/testdata/sf0.001"
print("rows", dict(corpus_pipeline.STAGES)["quality_classifier"](spark, spark.read.parquet(sf + "/documents.parquet"), sf).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-3000:]


def test_pipeline_reads(spark, sf001):
    """Stages read texts in short batches and small pieces, unless the session has settings of its own."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["byte_bpe"]
    made = {"spark.sql.parquet.columnarReaderBatchSize": "512", "parquet.hadoop.vectored.io.enabled": "false", "parquet.read.allocation.size": "262144"}
    own = {"spark.sql.parquet.columnarReaderBatchSize": "300", "parquet.hadoop.vectored.io.enabled": "true", "parquet.read.allocation.size": "1000000"}
    try:
        for name in made:
            spark.conf.unset(name)
        stage(spark, sf001, "/root/testdata/sf0.001")
        assert {name: spark.conf.get(name) for name in made} == made
        for name, value in own.items():
            spark.conf.set(name, value)
        stage(spark, sf001, "/root/testdata/sf0.001")
        assert {name: spark.conf.get(name) for name in own} == own
    finally:
        for name in made:
            spark.conf.unset(name)
