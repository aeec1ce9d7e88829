"""Queries over the test tables for each operator, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, exact_dedup, html_text, language_id, near_dedup, nearest, quality_classifier, quality_rules, sharding, spelling, url_filter
from .mixing import mix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CONTRACT_RULES = [url_filter.Rule(p, v) for p, v in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]
#: Where no rule speaks: words of gambling, medicine and download spam, of advertising and tracking hosts, and pages without
#: prose of their own, each as it stands between separators.
FALLBACK_RULES = [
    url_filter.Rule(f"^{w}^", "block")
    for w in "casino poker betting jackpot pills viagra cialis pharmacy escort porn xxx warez torrent crack keygen free-download spam-farm ads adserver doubleclick track tracker tracking clickbank affiliate payday-loan login signin signup wp-login wp-admin cart checkout basket search tag tags feed rss print".split()
]


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), CONTRACT_RULES, FALLBACK_RULES).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


ORACLES["op1_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(host_of, start, pattern, verdict) AS (
  VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'),
         ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')
), fits AS (
  SELECT page_id, arg_max(pattern, length(pattern)) AS rule, arg_max(verdict, length(pattern)) AS verdict
  FROM parts JOIN rules ON (host = host_of OR ends_with(host, '.' || host_of)) AND starts_with(path, start)
  GROUP BY page_id
), others AS (
  SELECT unnest(string_split('""" + " ".join(r.pattern[1:-1] for r in FALLBACK_RULES) + r"""', ' ')) AS word
), literal AS (
  SELECT page_id, arg_min('^' || word || '^', (-length(word), word)) AS pattern_rule
  FROM parts JOIN others ON contains(lower(host || path), word) AND regexp_matches(lower(host || path), '(^|[^a-z0-9])' || word || '($|[^a-z0-9])') GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN l.pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN f.rule IS NULL THEN l.pattern_rule END AS pattern_rule
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN literal l USING (page_id)
"""


@_query
def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rules = quality_rules.fit(docs, labels)
    return quality_rules.apply(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@_query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


@_query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode_texts(_table(spark, sf_dir, "documents"), path, pattern)


@_query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_classifier.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged


@_query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


ORACLES["op8_nearest"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""


@_query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


ORACLES["op9_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS sh FROM w
), n AS (
  SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c
)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""


#: For pages like those of the test tables, whose one article holds nothing but its text: what stands there, read by patterns.
ORACLES["op3_html_text"] = r"""
WITH inner_ AS (
  SELECT page_id, url, unnest(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<(/?p|/?h1)>')) AS part,
         generate_subscripts(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<(/?p|/?h1)>'), 1) AS k FROM pages
), plain AS (
  SELECT page_id, url, k, regexp_replace(part, '<[^>]*>', ' ', 'g') AS part FROM inner_
), decoded AS (
  SELECT page_id, url, k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(part, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS part FROM plain
), clean AS (
  SELECT page_id, url, k, trim(regexp_replace(part, '[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\p{Z}]+', ' ', 'g')) AS part FROM decoded
), texts AS (
  SELECT page_id, any_value(url) AS url, coalesce(string_agg(part, chr(10) ORDER BY k) FILTER (WHERE part <> ''), '') AS text FROM clean GROUP BY page_id
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte from its table, which follows from its polynomial; words are at most Latin-1, so two bytes at most in UTF-8.
ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
), l AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY 1, 2
), h AS (
  SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
           lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))),
         lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM l, tab
), d AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
), x AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.less
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.less
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS best_n FROM near GROUP BY 1
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN best USING (word)
), walk(word, here, k) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN f ON f.word = walk.here AND f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, arg_max(walk.here, walk.k) AS root FROM f JOIN walk USING (word) GROUP BY f.word, f.n, f.n_near, f.form, f.form_n
"""


@_query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), x AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM x GROUP BY 1, 2, 3
), k AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY 1, 2 HAVING sum(docs) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), grid AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, k.n AS m FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p, 1 + (1000000000 * (m + 5)) // (sum(m) OVER s + 5 * count(*) OVER s) AS q
  FROM grid WINDOW s AS (PARTITION BY lang, source)
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
