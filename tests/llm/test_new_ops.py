"""Spelling variants, exact duplicates and source divergence against brute force, on odd rows and on empty tables."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from conftest import DOCS

from pairloom.llm import divergence, exact_dedup, spelling
from pairloom.llm.store import materialize

LOWER = {i: i + 32 for i in range(65, 91)}

# -- 11 ----------------------------------------------------------------------


def results(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, times=10):
    near = defaultdict(list)
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w] or "", words[form[w]] if form[w] else 0, root(w)) for w, n in words.items())


def as_rows(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def test_variants_odd(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert as_rows(spelling.variants(odd_docs)) == brute_variants(results(rows))
    assert spelling.variants(no_docs).count() == 0 and spelling.variants(odd_docs.where("text IS NULL")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_brute_force(spark, seed):
    """Words of two letters and of one stem, so that segments are crowded; equal counts; small limits cut and deal them."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abé"), int(rng.integers(7, 11)))) for _ in range(150)]
    words += ["prefixes" + "".join(rng.choice(list("abc"), int(rng.integers(1, 5)))) for _ in range(150)]
    words += ["".join(rng.choice(list("abc"), int(rng.integers(1, 5)))) + "endings" for _ in range(80)] + ["z" * 3000, "z" * 3001, "z" * 1500 + "y" + "z" * 1500]
    often = {w: int(rng.choice([1, 1, 2, 30, 400])) for w in words}
    docs = [(int(i), " ".join(w for w in words for _ in range(often[w]))) for i in range(4)]
    df = spark.createDataFrame([(*d, "x", "y", 0) for d in docs], DOCS)
    want = brute_variants(results(docs))
    assert len(want) > 150 and sum(w[0] != w[5] for w in want) > 30 and any(w[3] and w[3] != w[5] for w in want)
    assert as_rows(spelling.variants(df)) == want
    assert as_rows(spelling.variants(df, hot=9, shard_rows=500)) == want


def test_roots_follow_chains(spark):
    words = [("aaaaaaa", 2), ("aaaaaab", 25), ("aaaaabb", 300), ("aaaabbb", 4000), ("aaaaaac", 2), ("ccccccc", 5)]
    text = " ".join(w for w, n in words for _ in range(n))
    df = spark.createDataFrame([(None, text)], "doc_id long, text string")
    got = {r.word: r for r in spelling.variants(df).collect()}
    kept = results([(None, text)])
    assert as_rows(spelling.variants(df)) == brute_variants(kept) and len(got) == len(kept)
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(17)], "word string, form string")
    ends, _ = spelling.roots(forms)
    assert {r.root for r in ends.collect()} == {"w17"} and ends.count() == 17


def test_edits_belong_to_one_part():
    rng = np.random.default_rng(3)
    for _ in range(4000):
        a, b = ("".join(rng.choice(list("ab"), int(rng.integers(4, 8)))) for _ in range(2))
        half = len(a) // 2
        found = spelling.edit_at(a, b, 0, half) + spelling.edit_at(a, b, half, len(a))
        assert found == one_edit(a, b)


# -- 12 ----------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(-1 if doc_id is None else doc_id)
    out = []
    for t, ids in groups.items():
        for k, i in enumerate(sorted(ids, reverse=True)):
            out.append((i, max(ids), len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def exact_rows(df):
    n = lambda x: -1 if x is None else x
    return sorted((n(r.doc_id), n(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_exact_odd(spark, odd_docs, no_docs):
    want = brute_exact([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert exact_rows(exact_dedup.exact_duplicates(odd_docs)) == want
    assert exact_rows(exact_dedup.exact_duplicates(odd_docs, shard_keys=2)) == want
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    only_null = odd_docs.where("doc_id IS NULL")
    assert exact_rows(exact_dedup.exact_duplicates(only_null)) == brute_exact([(r.doc_id, r.text) for r in only_null.collect()])


def test_exact_hot_group(spark):
    """A third of all rows are copies of one text, on both sides of the history's end."""
    rows = [(i, ["Copy", "cOPY", "copy"][i % 9 // 3] if i % 3 == 0 else f"t{i // 4}") for i in range(3000)] + [(2999, "copy")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_rows(exact_dedup.exact_duplicates(df, shard_keys=100)) == brute_exact(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_perfect_hash(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8)
    seeds = exact_dedup.perfect_hash(digests)
    assert sorted(exact_dedup.slots_of(digests, seeds)) == list(range(n))


def test_lookup_compares_bytes(spark):
    """Digests that the index doesn't hold lead to slots as well; none is taken for a repeat. An index serves later days."""
    old = spark.createDataFrame([(i, f"old {i % 50}") for i in range(100)], "doc_id long, text string")
    rows, _ = materialize(exact_dedup.keys(old), "t")
    index, _ = materialize(exact_dedup.build_index(exact_dedup.winners(rows), 3), "t")
    assert sum(r.n for r in index.collect()) == 50 and exact_dedup.index_rows(index).count() == 50
    day = spark.createDataFrame([(i, f"OLD {i}" if i % 3 else f"new {i // 6}", "x", "y") for i in range(600)] + [(None, "new 0", "x", "y")], "doc_id long, text string, digest string, size string")
    got = exact_dedup.fresh(day, index, 3)
    assert got.columns == day.columns
    want = {i for i in range(600) if i % 3 and i >= 50} | {i for i in range(600) if i % 3 == 0 and i % 6 == 3}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    sums = exact_dedup.winners(materialize(exact_dedup.keys(day), "t")[0])
    for salts in (1, 4):
        met = exact_dedup.look_up(sums, index, 3, salts).collect()
        assert len(met) == len({t for _, t, *_ in [(r.doc_id, r.text.translate(LOWER)) for r in day.collect()]})
        assert sum(r.size_before > 0 for r in met) == sum(bool(i % 3) for i in range(50))
        assert all((r.earlier is None) == (r.size_before == 0) for r in met)


# -- 13 ----------------------------------------------------------------------


def brute_divergence(rows, documents, top=50):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or ""))
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in terms]
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= documents]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        p = shares(counts[lang, source])
        q = shares(sum((c for (k, _), c in counts.items() if k == lang), Counter()))
        pairs = [(sum(abs(p[t] - x) for t, x in shares(counts[lang, s]).items()), s) for k, s in groups if k == lang and s != source]
        terms = [(p[t] - q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def test_divergence_odd(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    for documents in (1, 2, 30):
        assert sorted(map(tuple, divergence.divergence(odd_docs, documents=documents).collect())) == brute_divergence(rows, documents)
    assert divergence.divergence(no_docs).count() == 0


def test_divergence_against_brute_force(spark):
    rng = np.random.default_rng(5)
    terms = [f"{a}{b}é" for a in "abcdefgh" for b in "xyz"] + ["漢", "IT", "it", "\U0001f600"]
    rows = [(str(rng.choice(["a", "b", "c"])), f"s{min(int(rng.integers(9)), int(rng.integers(9)))}", " ".join(rng.choice(terms, int(rng.integers(1, 9))))) for _ in range(400)]
    rows += [("c", "alone", None), (None, "s1", "axé it"), ("d", "s1", "nothing kept"), ("d", "s2", "here"), ("a", "s0", "it " * 100_000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "'x' AS term", "0 AS n", "0 AS p", "'y' AS item")
    got = sorted(map(tuple, divergence.divergence(df, documents=8, top=5).collect()))
    want = brute_divergence(rows, 8, 5)
    assert got == want and {r[2] for r in got} == {"pair", "term"} and any(r[4] == 0 for r in got if r[0] == "d")


def test_shares_are_exact_above_long(spark):
    got = spark.sql("SELECT 90000000000000000L AS n, 100000000000000000L AS total, 7L AS kept").select(divergence.share("n", "total", "kept")).first()[0]
    assert got == 1 + 10**9 * (90000000000000000 + 5) // (100000000000000000 + 35)


# -- labels that stand several times -------------------------------------------


def test_repeated_labelled_rows_change_nothing(spark, monkeypatch):
    """However often a labelled document stands in the table, it counts once, and no more rows come to the driver."""
    from pairloom.llm import quality_classifier, quality_rules

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 80)) if i % 2 else " ".join(rng.choice(["buy", "now", "!!!", "$$"], 80))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    once, often = (spark.createDataFrame(rows + [rows[0]] * k + [(1, "Another text of one id " * 30)] * (1 if k else 1), "doc_id long, text string") for k in (0, 700))
    lists = [quality_rules.fit(d, labels) for d in (once, often, often.repartition(7))]
    assert lists[0] == lists[1] == lists[2]
    keys = once.selectExpr("doc_id", "double(doc_id % 2) + doc_id / 1000 AS key")
    many = keys.union(keys.where("doc_id = 0").crossJoin(spark.range(900)).select("doc_id", "key"))
    monkeypatch.setattr(quality_classifier, "MAX_TARGET_ROWS", 60)
    for most in (60, 1000):
        k = quality_classifier.wanted(keys, labels, most=most)
        assert k == quality_classifier.wanted(many, labels, most=most) == quality_classifier.wanted(many.repartition(5), labels, most=most)


def test_cut_and_target_from_all_labelled_rows(spark):
    """More labelled documents than any bound had: the cut is the brute force's over all of them, and the target model counts all."""
    from pairloom.llm import quality_classifier

    rng = np.random.default_rng(11)
    n = 30_000
    mark = rng.integers(0, 2, n)
    key = np.round(rng.normal(size=n) + 3 * mark, 3)  # with ties
    keys = spark.createDataFrame([(i, float(key[i])) for i in range(n)] + [(n + 10 + i, float(i)) for i in range(-5, 6)], "doc_id long, key double")
    labels = spark.createDataFrame([(i, int(mark[i])) for i in range(n)], "doc_id long, quality int")
    good, bad = np.sort(key[mark == 1]), np.sort(key[mark == 0])
    cuts = np.unique(key)
    kept, passed = 1 - np.searchsorted(good, cuts) / len(good), 1 - np.searchsorted(bad, cuts) / len(bad)
    cut = cuts[np.argmax(np.where(kept >= 0.99, kept - passed, -1.0))]
    assert quality_classifier.wanted(keys, labels) == keys.where(f"key >= {cut}").count()
    one = keys.selectExpr("doc_id", "1.5D AS key")
    assert quality_classifier.wanted(one, labels) == one.count()
    texts = keys.selectExpr("int(doc_id) AS doc_id", "concat('t', doc_id) AS text")
    got = quality_classifier.target_texts(texts, labels)
    assert got.count() == mark.sum() and {r.text for r in got.collect()} == {f"t{i}" for i in range(n) if mark[i]}
