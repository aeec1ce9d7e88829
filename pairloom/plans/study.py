"""Queries over the driver's tables, one family of operators each, with DuckDB SQL where SQL can express them.

Stand-ins: lineitem rows are paired measures (quantity and price), clustered by supplier, in the directions of the return
flag; orders are jobs with a status; events are lines on users' timelines; conversations are transcripts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import arrays, numeric, pitch, text
from ..operators import clusters, extended, gate, graph, inference, pairing, quantiles, resume, selection, summary, systems, text_metrics, timeline, tracks, training

from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# -- summaries ---------------------------------------------------------------


@query("""
SELECT o_orderpriority AS direction, count(*) AS attempted, count(*) FILTER (WHERE o_orderstatus <> 'P') AS succeeded,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) AS failure_rate
FROM orders GROUP BY 1
""")
def agg_reliability(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderpriority", "o_orderstatus")
    rows = o.select(F.col("o_orderpriority").alias("direction"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"))
    return rounded(summary.reliability(rows, by=["direction"]), "failure_rate")


@query("""
WITH own AS (SELECT l_returnflag AS direction, l_suppkey AS g, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_returnflag AS direction, avg(l_quantity) AS mq, count(l_quantity) AS nq FROM lineitem GROUP BY 1)
SELECT o.direction, round(avg(q), 6) AS group_mean_l_quantity, count(q) AS l_quantity_groups, round(avg(p), 4) AS group_mean_l_extendedprice,
       count(p) AS l_extendedprice_groups, round(any_value(mq), 6) AS mean_l_quantity, any_value(nq) AS l_quantity_count
FROM own o JOIN m USING (direction) GROUP BY 1
""")
def agg_two_level_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice").withColumnRenamed("l_returnflag", "direction")
    two = summary.two_level_means(rows, ["direction"], "l_suppkey", ["l_quantity", "l_extendedprice"])
    out = two.join(summary.row_means(rows, ["direction"], ["l_quantity"]), "direction")
    return rounded(rounded(out, "group_mean_l_quantity", "mean_l_quantity"), "group_mean_l_extendedprice", places=4)


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson_r FROM lineitem GROUP BY 1, 2
""")
def agg_guarded_corr(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return rounded(summary.correlations(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice"), "pearson_r")


_DECOMPOSED = """
WITH b AS (SELECT l_returnflag AS k, l_suppkey AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
c AS (SELECT *, count(*) OVER w AS m, avg(x) OVER w AS gx, avg(y) OVER w AS gy, avg(x) OVER (PARTITION BY k) AS grand FROM b WINDOW w AS (PARTITION BY k, g)),
pooled AS (SELECT k, corr(x, y) AS pooled_r, count(*) AS n FROM b GROUP BY 1),
within AS (SELECT k, corr(x - gx, y - gy) AS within_r, sum((gx - grand) ^ 2) AS ssb, sum((x - gx) ^ 2) AS ssw FROM c WHERE m > 1 GROUP BY 1),
means AS (SELECT k, g, any_value(gx) AS gx, any_value(gy) AS gy FROM c WHERE m > 1 GROUP BY 1, 2),
between_ AS (SELECT k, corr(gx, gy) AS between_r, count(*) AS n_groups FROM means GROUP BY 1)
SELECT p.k AS l_returnflag, n, n_groups, round(pooled_r, 6) AS pooled_r, round(within_r, 6) AS within_r, round(between_r, 6) AS between_r, round(ssb / (ssb + ssw), 6) AS between_share
FROM pooled p JOIN within USING (k) JOIN between_ USING (k)
"""


@query(_DECOMPOSED)
def agg_within_between(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice")
    out = summary.decomposition(rows, "l_quantity", "l_extendedprice", "l_suppkey", ["l_returnflag"])
    return rounded(out, "pooled_r", "within_r", "between_r", "between_share")


@query("""
WITH u AS (SELECT 'rate' AS measure, l_discount AS a, l_tax AS b FROM lineitem UNION ALL SELECT 'amount', l_quantity, l_extendedprice / 1000 FROM lineitem)
SELECT measure, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(stddev_samp(a), 6) AS sd_a, round(stddev_samp(b), 6) AS sd_b,
       round(avg(b - a), 6) AS delta, round(avg(b - a) - 1.96 * stddev_samp(b - a) / sqrt(count(*)), 6) AS delta_low,
       round(avg(b - a) + 1.96 * stddev_samp(b - a) / sqrt(count(*)), 6) AS delta_high, round(corr(a, b), 6) AS pearson_r
FROM u GROUP BY 1
""")
def agg_paired_deltas(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_discount", "l_tax", "l_quantity", "l_extendedprice").withColumn("k", F.col("l_extendedprice") / 1000)
    out = summary.paired_deltas(rows, {"rate": ("l_discount", "l_tax"), "amount": ("l_quantity", "k")})
    return rounded(out, "mean_a", "mean_b", "sd_a", "sd_b", "delta", "delta_low", "delta_high", "pearson_r")


@query("""
SELECT l_shipmode_ AS k, count(r) AS n, round(quantile_cont(r, 0.5), 6) AS median, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.9), 6) AS p90
FROM (SELECT l_linestatus AS l_shipmode_, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END AS r FROM lineitem) GROUP BY 1
""")
def agg_ratio_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_linestatus", "l_extendedprice", "l_quantity").withColumnRenamed("l_linestatus", "k")
    return rounded(summary.ratio_stats(rows, "l_extendedprice", "l_quantity", ["k"]), "median", "mean", "p90").drop("sd")


@query("""
SELECT l_suppkey, count(*) AS n, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99
FROM (SELECT 0 AS l_suppkey, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_suppkey, l_extendedprice FROM lineitem) GROUP BY 1
""")
def agg_quantiles(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice")
    rows = l.select(F.explode(F.array(F.lit(0).cast("long"), F.col("l_suppkey").cast("long"))).alias("l_suppkey"), "l_extendedprice")
    got = quantiles.exact_quantiles(rows, ["l_suppkey"], "l_extendedprice", [0.01, 0.5, 0.99])
    return got.select("l_suppkey", "n", *[F.round(F.get("quantiles", F.lit(i)), 6).alias(c) for i, c in enumerate(("p1", "p50", "p99"))])


def _results(spark, sf_dir) -> DataFrame:
    """Rows of lineitem as a pipeline's results: what was ordered as generated, what a price stands for as the human's."""
    l = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0")
    q, x, n = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"), F.col("l_linenumber")
    sides = {"f0_mean": (q + 80, x / 500 + 60), "f0_std": (q, x / 2000), "energy": (F.col("l_tax").cast("double"), F.col("l_discount").cast("double")), "duration": (q - 1, x / 1500), "speaking_rate": (q / 10, n.cast("double"))}
    scores = {"speaker_similarity": F.col("l_discount") * 10, "human_target_speaker_similarity": F.col("l_tax") * 5 + 0.5, "asr_wer": q / 50, "tts_intelligibility_wer": F.when(n > 1, q / 60)}
    return l.select(F.when(F.col("l_linestatus") == "O", "en-es").otherwise("es-en").alias("direction"), F.col("l_suppkey").cast("string").alias("speaker_id"), F.when(n < 6, "ok").otherwise("failed").alias("status"), (n < 4).alias("same_speaker_pair"), *[v.cast("double").alias(k) for k, v in scores.items()], *[v.alias(f"{f}_{r}") for f, (a, b) in sides.items() for r, v in (("generated", a), ("target_reference", b))])


_SIDES = {"f0_mean": ("l_quantity + 80", "l_extendedprice / 500 + 60"), "f0_std": ("l_quantity", "l_extendedprice / 2000"), "energy": ("l_tax", "l_discount"), "duration": ("l_quantity - 1", "l_extendedprice / 1500"), "speaking_rate": ("l_quantity / 10", "l_linenumber")}
_NUMBERED = "SELECT direction, unnest([{names}]) AS name, unnest([{values}]) AS value FROM {of}"


def _numbered(of: str, names: dict[str, str]) -> str:
    return _NUMBERED.format(names=", ".join(f"'{n}'" for n in names), values=", ".join(f"({v})::DOUBLE" for v in names.values()), of=of)


_SCORES = {"speaker_similarity": "l_discount * 10", "human_target_speaker_similarity": "l_tax * 5 + 0.5", "asr_wer": "l_quantity / 50", "tts_intelligibility_wer": "CASE WHEN l_linenumber > 1 THEN l_quantity / 60 END"}


@query(f"""
WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'en-es' ELSE 'es-en' END AS direction, l_suppkey AS g, l_linenumber < 6 AS ok, l_linenumber < 4 AS same, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _SCORES.items())},
  {", ".join(f"({a})::DOUBLE AS {f}_g, ({b})::DOUBLE AS {f}_h" for f, (a, b) in _SIDES.items())} FROM lineitem WHERE l_orderkey % 3 = 0),
good AS (SELECT * FROM r WHERE ok),
whole AS (SELECT NULL::VARCHAR AS direction, count(*) AS n, count(*) FILTER (WHERE ok) AS good FROM r),
rowed AS (SELECT direction, count(*) AS n, count(*) FILTER (WHERE same) AS same, {", ".join(f"avg({k}) AS {k}" for k in _SCORES)},
  count(*) FILTER (WHERE duration_g <> 0 AND duration_h <> 0) AS rn, quantile_cont(CASE WHEN duration_g <> 0 THEN duration_g / duration_h END, 0.5) AS rm, avg(CASE WHEN duration_g <> 0 THEN duration_g / duration_h END) AS ra,
  quantile_cont(CASE WHEN duration_g <> 0 THEN duration_g / duration_h END, 0.9) AS rp, avg(CASE WHEN duration_g <> 0 THEN duration_g END) AS mg, avg(duration_h) AS mh FROM good GROUP BY 1),
own AS (SELECT direction, g, {", ".join(f"avg({k}) AS {k}" for k in _SCORES)} FROM good GROUP BY 1, 2),
two AS (SELECT direction, {", ".join(f"avg({k}) AS {k}, count({k}) AS n_{k}" for k in _SCORES)} FROM own GROUP BY 1),
long AS ({" UNION ALL ".join(f"SELECT direction, g, '{f}' AS f, " + (f"12 * log2({f}_g / 100) AS x, 12 * log2({f}_h / 100) AS y" if f.startswith("f0") else f"{f}_g AS x, {f}_h AS y") + " FROM good WHERE same" + (f" AND {f}_g > 0 AND {f}_h > 0" if f.startswith("f0") else "") + (f" AND {f}_g BETWEEN 60 AND 400 AND {f}_h BETWEEN 60 AND 400" if f == "f0_mean" else "") for f in _SIDES)}),
c AS (SELECT *, count(*) OVER w AS m, avg(x) OVER w AS gx, avg(y) OVER w AS gy, avg(x) OVER (PARTITION BY direction, f) AS grand FROM long WINDOW w AS (PARTITION BY direction, f, g)),
pooled AS (SELECT direction, f, corr(x, y) AS pooled_r, count(*) AS n FROM long GROUP BY 1, 2 HAVING count(*) >= 3),
within AS (SELECT direction, f, CASE WHEN count(*) >= 3 THEN corr(x - gx, y - gy) END AS within_r, sum((gx - grand) ^ 2) AS ssb, sum((x - gx) ^ 2) AS ssw FROM c WHERE m > 1 GROUP BY 1, 2),
means AS (SELECT direction, f, g, any_value(gx) AS gx, any_value(gy) AS gy FROM c WHERE m > 1 GROUP BY 1, 2, 3),
between_ AS (SELECT direction, f, CASE WHEN count(*) >= 3 THEN corr(gx, gy) END AS between_r, count(*) AS n_groups FROM means GROUP BY 1, 2),
parts AS (SELECT * FROM pooled LEFT JOIN within USING (direction, f) LEFT JOIN between_ USING (direction, f)),
numbers AS (
  {_numbered("whole", {"attempted": "n", "succeeded": "good", "failed": "n - good", "failure_rate": "(n - good) / n"})}
  UNION ALL {_numbered("rowed", {"n": "n", "prosody_n_same_speaker": "same", **{f"{k}_row_mean": k for k in _SCORES}, "duration_ratio_n": "rn", "duration_ratio_median": "rm", "duration_ratio_mean": "ra", "duration_ratio_p90": "rp", "duration_ratio_mean_generated_s": "mg", "duration_ratio_mean_human_s": "mh"})}
  UNION ALL {_numbered("two", {**{f"{k}_speaker_mean": k for k in _SCORES}, "speaker_similarity_n_speakers": "n_speaker_similarity", "human_target_speaker_similarity_n_speakers": "n_human_target_speaker_similarity", "identity_pct_of_ceiling": "100 * speaker_similarity / human_target_speaker_similarity"})}
  UNION ALL SELECT direction, 'gen_vs_human_' || f || '_' || unnest(['pooled_r', 'within_r', 'between_r', 'n', 'n_groups', 'between_share']), unnest([pooled_r, within_r, between_r, n::DOUBLE, coalesce(n_groups, 0)::DOUBLE, ssb / (ssb + ssw)]) FROM parts)
SELECT direction, name, round(value, 5) AS value FROM numbers
""")
def agg_pipeline_numbers(spark, sf_dir):
    return rounded(summary.pipeline_numbers(_results(spark, sf_dir)), "value", places=5)


@query("""
WITH s AS (SELECT s_nationkey::VARCHAR AS a, (s_suppkey % 40)::VARCHAR AS b FROM supplier)
SELECT count(*) AS pairs, count(*) FILTER (WHERE a = b) AS same_speaker, count(*) FILTER (WHERE a <> b) AS different_speaker,
       count(*) AS english_texts, count(*) AS spanish_texts, (SELECT count(DISTINCT v) FROM (SELECT a AS v FROM s UNION ALL SELECT b FROM s)) AS speakers FROM s
""")
def agg_corpus_counts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 40).cast("string")
    return summary.corpus_counts(s.select(a.alias("english_speaker_id"), b.alias("spanish_speaker_id"), (a == b).alias("same_speaker_pair"), F.col("s_name").alias("english_text"), F.col("s_name").alias("spanish_text")))


@query("""
SELECT conv_id AS job_id, round(sum(length(text)) FILTER (WHERE role <> 'system') / nullif(sum(length(text) + turn) FILTER (WHERE role <> 'system'), 0), 6) AS final_ratio,
       round(sum(length(text) + 2) FILTER (WHERE role <> 'system') / nullif(sum(length(text) + turn) FILTER (WHERE role <> 'system'), 0), 6) AS raw_ratio,
       count(*) FILTER (WHERE role <> 'system' AND turn % 3 = 0) AS clamped, count(*) FILTER (WHERE role <> 'system' AND turn % 4 = 1) AS truncated,
       count(*) FILTER (WHERE role = 'system') AS failed, round(avg(length(text) * 1.0) FILTER (WHERE role <> 'system'), 6) AS similarity
FROM conversations GROUP BY 1
""")
def agg_job_totals(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    n = F.length("text").cast("double")
    seg = F.struct(F.col("turn").cast("int").alias("index"), F.when(F.col("role") == "system", "error").otherwise("ok").alias("status"), (n + F.col("turn")).alias("original_seconds"), (n + 2).alias("raw_seconds"), n.alias("final_seconds"), (F.col("turn") % 3 == 0).alias("clamped"), F.when(F.col("turn") % 4 == 1, 1.0).otherwise(0.0).alias("truncated_seconds"), n.alias("similarity"))
    out = summary.job_totals(c.groupBy(F.col("conv_id").alias("job_id")).agg(F.collect_list(seg).alias("segments")))
    return rounded(out, "final_ratio", "raw_ratio", "similarity")


@query("""
WITH t AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events),
r AS (SELECT *, median(CASE WHEN k > 1 THEN value END) OVER w AS mid, count(CASE WHEN k > 1 THEN value END) OVER w AS n
      FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round(CASE WHEN n >= 2 THEN mid * (total - k) * 1.14 END, 6) AS eta_seconds FROM r
""")
def agg_running_eta(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events", "user_id", "event_id", "value").withColumn("total", F.count(F.lit(1)).over(W.partitionBy("user_id")))
    return rounded(summary.remaining_time(e, "user_id", "event_id", "value", "total"), "eta_seconds").select("user_id", "event_id", "eta_seconds")


@query("""
WITH g AS (SELECT l_suppkey AS k, avg(l_discount) / 50 AS p, avg(l_tax) * 15 AS delta FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN p < 0.001 AND abs(delta) < 0.6 THEN 'negligible' WHEN p < 0.001 THEN 'survives' ELSE 'not_significant' END AS effect FROM g
""")
def agg_effects(spark, sf_dir):
    # the table's order of rows settles means that lie on a limit to within rounding
    rows = table(spark, sf_dir, "lineitem", F.col("l_suppkey").alias("k"), "l_discount", "l_tax", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    means = summary.settled_means(rows, "k", {"l_discount": [0.05], "l_tax": [-0.04, 0.04]}, ["file", "row"])
    g = means.select("k", (F.col("l_discount") / 50).alias("p"), (F.col("l_tax") * 15).alias("delta"))
    return summary.classify_effects(g, tests=50, small=0.6).select("k", "effect")


# -- gate and reshape --------------------------------------------------------


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(value >= 5, false)) AS failed_low, count(*) FILTER (WHERE NOT coalesce(value <= 80, false)) AS failed_high,
       count(*) FILTER (WHERE event_type = 'error') AS failed_error, count(*) FILTER (WHERE value BETWEEN 5 AND 80 AND event_type <> 'error') AS n_kept FROM events
""")
def fil_gate_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events", "value", "event_type")
    return gate.threshold_gate(e, {"low": F.col("value") >= 5, "high": F.col("value") <= 80, "error": F.col("event_type") != "error"})[1]


def _features(spark, sf_dir) -> DataFrame:
    """Line items as feature rows: English from quantity and tax, Spanish from price and discount."""
    rows = table(spark, sf_dir, "lineitem")
    d = lambda c: F.col(c).cast("double")
    part = F.col("l_suppkey") % 10
    made = {"pair_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "split": F.when(part < 6, "train").when(part < 8, "dev").otherwise("test"), "same_speaker_pair": F.col("l_returnflag") != "A", "en_speaker": F.col("l_suppkey").cast("string"), "es_speaker": F.col("l_suppkey").cast("string"), "error": F.when(F.col("l_linenumber") == 7, "unreadable").otherwise("")}
    for side, hz, seconds in (("en", d("l_quantity") * 8 + 40, d("l_quantity") / 2.4), ("es", d("l_extendedprice") / 200 + 50, d("l_extendedprice") / 5000)):
        made |= {f"{side}_f0_mean_hz": hz, f"{side}_f0_mean_st": numeric.semitones(hz), f"{side}_f0_std_hz": d("l_tax") * 100, f"{side}_f0_std_st": d("l_discount") * 30, f"{side}_duration": seconds, f"{side}_voiced_ratio": F.lit(0.25) + d("l_tax") * 5, f"{side}_n_words": d("l_linenumber"), f"{side}_speaking_rate": numeric.safe_div(d("l_linenumber"), seconds)}
    return rows.select(*[v.alias(k) for k, v in made.items()])


_FEATURES = """
f AS (SELECT l_orderkey || '-' || l_linenumber AS pair_id, CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'dev' ELSE 'test' END AS split,
        l_returnflag <> 'A' AS same, l_suppkey::VARCHAR AS speaker, l_linenumber = 7 AS bad, l_linenumber::DOUBLE AS words, 0.25 + l_tax * 5 AS voiced, l_discount * 30 AS sd,
        l_quantity * 8 + 40 AS en_hz, l_extendedprice / 200 + 50 AS es_hz, l_quantity / 2.4 AS en_s, l_extendedprice / 5000 AS es_s FROM lineitem)
"""


@query(f"""
WITH {_FEATURES}, c AS (SELECT *, voiced >= 0.3 AS v, en_s BETWEEN 0.4 AND 20 AS d1, es_s BETWEEN 0.4 AND 20 AS d2, en_hz BETWEEN 60 AND 400 AS h1, es_hz BETWEEN 60 AND 400 AS h2 FROM f),
k AS (SELECT *, NOT bad AND v AND d1 AND d2 AND h1 AND h2 AS ok, (en_hz <= 63 OR en_hz >= 380 OR es_hz <= 63 OR es_hz >= 380) AS edge FROM c)
SELECT count(*) AS rows_extracted, count(*) FILTER (WHERE bad) AS dropped_extraction_error, 0 AS failed_nan_f0, 2 * count(*) FILTER (WHERE NOT bad AND NOT v) AS failed_voiced_ratio,
       count(*) FILTER (WHERE NOT bad AND NOT d1) + count(*) FILTER (WHERE NOT bad AND NOT d2) AS failed_duration,
       count(*) FILTER (WHERE NOT bad AND NOT h1) + count(*) FILTER (WHERE NOT bad AND NOT h2) AS failed_f0_implausible,
       count(*) FILTER (WHERE NOT bad AND NOT ok) AS dropped_by_criteria, count(*) FILTER (WHERE ok AND edge) AS near_bound_kept, count(*) FILTER (WHERE ok AND same) AS same_speaker_pairs,
       count(*) FILTER (WHERE ok AND NOT same) AS different_speaker_pairs, count(*) FILTER (WHERE NOT bad AND NOT (ok AND same)) AS dropped_quality_gate,
       count(*) FILTER (WHERE ok AND same) AS rows_kept, round(1 - count(*) FILTER (WHERE ok AND same) / count(*), 4) AS drop_rate FROM k
""")
def fil_quality_gate(spark, sf_dir):
    return gate.gate(_features(spark, sf_dir))[1]


@query(f"""
WITH {_FEATURES}, u AS (
  SELECT 'en-es' AS direction, split, speaker, en_hz AS s_hz, es_hz AS t_hz, en_s AS s_s, es_s AS t_s FROM f UNION ALL SELECT 'es-en', split, speaker, es_hz, en_hz, es_s, en_s FROM f)
SELECT direction, split, count(*) AS n, round(avg(12 * log2(s_hz / 100)), 6) AS s_f0, round(avg(12 * log2(t_hz / 100)), 6) AS t_f0, round(avg(ln(t_s / s_s)), 6) AS ratio, round(avg(ln(s_s)), 6) AS s_log_dur
FROM u GROUP BY 1, 2
""")
def prj_directional(spark, sf_dir):
    d = pairing.directional(_features(spark, sf_dir))
    out = d.groupBy("direction", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("s_f0_mean_st").alias("s_f0"), F.avg("t_f0_mean_st").alias("t_f0"), F.avg("target_log_dur_ratio").alias("ratio"), F.avg("s_log_dur").alias("s_log_dur"))
    return rounded(out, "s_f0", "t_f0", "ratio", "s_log_dur")


# -- joins -------------------------------------------------------------------


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE d.lang END AS label FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def jn_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "lang").withColumnRenamed("lang", "label")
    side = table(spark, sf_dir, "labels", "doc_id", "quality").select(F.col("doc_id").alias("k"), F.concat(F.lit("q"), "quality").alias("v"))
    return pairing.with_fallback(d, side, "doc_id", "label", "k", "v")


@query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'no_labels' WHEN l.quality = 0 THEN 'labels_unusable' WHEN p.page_id IS NULL THEN 'no_pages' ELSE 'kept' END AS reason, count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id GROUP BY 1
""")
def jn_drop_reasons(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    pages = table(spark, sf_dir, "pages", "page_id").withColumnRenamed("page_id", "doc_id")
    return pairing.drop_counts(pairing.with_drop_reason(d, [("labels", labels, ["doc_id"], F.col("quality") == 1), ("pages", pages, ["doc_id"], None)]))


@query("""
SELECT u.conv_id || ':' || u.turn || '__' || a.conv_id || ':' || a.turn AS pair_id, u.conv_id % 7 = a.turn % 7 AS same_speaker_pair
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
""")
def jn_self_pairing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    key = lambda t: F.concat_ws(":", "conv_id", t)
    lang = F.when(F.col("role") == "user", "EN").when(F.col("role") == "assistant", "es").otherwise("xx")
    peer = F.when(F.col("role") == "user", key(F.col("turn") + 1)).otherwise("")
    speaker = F.when(F.col("role") == "user", F.col("conv_id") % 7).otherwise(F.col("turn") % 7).cast("string")
    f = c.select(key(F.col("turn")).alias("key"), lang.alias("lang_code"), peer.alias("trans_id"), speaker.alias("participant_id"), "text")
    audio = f.select(F.col("key").alias("audio_id"), F.concat(F.lit("/sound/"), "key").alias("path"))
    return pairing.link_pairs(f, audio).select("pair_id", "same_speaker_pair")


@query("""
SELECT event_id, user_id, 'new' AS state, value FROM events WHERE event_id % 3 <> 0 UNION ALL
SELECT event_id, user_id, 'old' AS state, value + 1 FROM events WHERE event_id % 3 = 0
""")
def jn_resume_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    done = e.where("event_id % 3 = 0").withColumns({"value": F.col("value") + 1, "state": F.lit("old")})
    fresh = resume.pending(e, done, ["event_id"]).withColumn("state", F.lit("new"))
    stale = e.withColumn("state", F.lit("stale")).where("event_id % 2 = 0")
    return resume.upsert(resume.upsert(stale, fresh, ["event_id"]), done, ["event_id"])


@query("""
SELECT o_orderkey, CASE WHEN c.k IS NOT NULL THEN c.v END AS measured, c.k IS NOT NULL AS reused
FROM orders o LEFT JOIN (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') c ON c.k = o.o_orderkey
""")
def jn_carry_forward(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    cached = o.select("o_orderkey", F.col("o_totalprice").alias("measured"), F.when(F.col("o_orderstatus") == "F", "").otherwise("failed").alias("error"))
    return resume.carried(o.select("o_orderkey"), cached, ["o_orderkey"], ["measured"])


@query("""
SELECT o_orderkey, o.o_orderpriority AS source, o.o_orderstatus AS generated, length(o.o_orderpriority) AS value_source, length(o.o_orderstatus) AS value_generated FROM orders o
""")
def jn_measure_once(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("generated"))
    return pairing.measure_once(o, ["source", "generated"], "o_orderkey", lambda paths: paths.withColumn("value", F.length("path")))


@query("""
SELECT a.event_id, a.user_id, count(b.event_id) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(b.ts) / 1e6 >= epoch_us(a.ts) / 1e6 AND epoch_us(b.ts) / 1e6 < epoch_us(a.ts) / 1e6 + 3600
GROUP BY 1, 2
""")
def jn_point_in_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = e.select("event_id", "user_id", at.alias("start"), (at + 3600).alias("end"))
    points = e.select("user_id", at.alias("at"))
    return timeline.stab(points, spans, "user_id", "at", "start", "end", 3600.0).groupBy("event_id", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS st, epoch_us(ts) / 1e6 + value AS en, CASE WHEN event_id % 4 <> 0 THEN event_id % 5 END AS label FROM events),
g AS (SELECT a.event_id, arg_min(b.label, (greatest(0, b.st - a.en, a.st - b.en), b.event_id)) AS label FROM s a JOIN s b ON a.user_id = b.user_id AND a.label IS NULL AND b.label IS NOT NULL GROUP BY 1)
SELECT s.event_id, coalesce(s.label, g.label) AS label FROM s LEFT JOIN g USING (event_id)
""")
def jn_nearest_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    s = e.select("user_id", "event_id", at.alias("start"), (at + F.col("value")).alias("end"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 5).alias("label"))
    return timeline.fill_nearest(s, "user_id", "event_id", "start", "end", "label").select("event_id", "label")


# -- windows and timeline ----------------------------------------------------


@query("""
WITH s AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS st, epoch_us(ts) / 1e6 + value * 60 AS en, event_type AS label, 1e10 AS total,
             lead(epoch_us(ts) / 1e6) OVER w AS nx, lead(event_type) OVER w AS nl FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
u AS (SELECT *, greatest(least(en + 0.3, CASE WHEN nx IS NOT NULL THEN nx - CASE WHEN nl = label THEN 0.1 ELSE 0.2 END ELSE total END) - st, 0.3) AS win FROM s)
SELECT user_id, event_id, round(win, 3) AS "window", round(least(st + win, coalesce(nx, total)) - st, 3) AS room FROM u
""")
def win_line_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value", "event_type")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    s = e.select("user_id", "event_id", F.struct("ts", "event_id").alias("idx"), at.alias("start"), (at + F.col("value") * 60).alias("end"), F.col("event_type").alias("label"), F.lit(1e10).alias("total"))
    out = timeline.line_windows(s, job="user_id")
    return out.select("user_id", "event_id", F.round("window", 3).alias("window"), F.round(F.col("deadline") - F.col("start"), 3).alias("room"))


@query(r"""
WITH w AS (SELECT conv_id, turn, length(text) AS total, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS pos FROM conversations),
x AS (SELECT *, length(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')) + 1 + CASE WHEN regexp_matches(word, '[.,!?;:…]$') THEN 2 ELSE 0 END AS wt FROM w),
c AS (SELECT *, sum(wt) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto, sum(wt) OVER (PARTITION BY conv_id, turn) AS al FROM x)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, word, round(CAST(total * (upto - wt) / al AS DOUBLE), 6) AS word_start, round(CAST(total * upto / al AS DOUBLE), 6) AS word_end FROM c
""")
def win_word_times(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumns({"start": F.lit(0.0), "end": F.length("text").cast("double")})
    return rounded(timeline.estimated_words(c, ["conv_id", "turn"], "text", "start", "end"), "word_start", "word_end")


@query("""
WITH g AS (SELECT l_returnflag AS family, l_suppkey AS k, avg(l_discount) * 2 + l_suppkey * 1e-9 AS p FROM lineitem GROUP BY l_returnflag, l_suppkey),
r AS (SELECT family, k, p * p * p * 10 AS p FROM g WHERE k % 9 <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS m FROM r)
SELECT family, k, round(max(least(1, (m - i + 1) * p)) OVER (PARTITION BY family ORDER BY i ROWS UNBOUNDED PRECEDING), 9) AS holm FROM i
""")
def win_holm(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem", "l_returnflag", "l_suppkey", "l_discount").groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("k")).agg((F.avg("l_discount") * 2 + F.first("l_suppkey") * 1e-9).alias("p"))
    g = g.withColumn("p", F.when(F.col("k") % 9 != 0, F.col("p") * F.col("p") * F.col("p") * 10))
    return rounded(systems.holm(g, "p", ["family"]).where("p is not null").select("family", "k", "holm"), "holm", places=9)


@query("""
SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1 AS label
FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events)
""")
def win_first_appearance(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type").withColumnRenamed("event_type", "label")
    return timeline.first_labels(e, "user_id", "event_id", "label")


@query("""
WITH b AS (SELECT user_id, event_id, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events),
u AS (SELECT *, CASE WHEN value < 5 AND before >= 60 THEN 0 ELSE greatest(0, least(value, 200 - before)) END AS used FROM b),
t AS (SELECT *, sum(used) OVER (PARTITION BY user_id) AS s FROM u)
SELECT user_id, event_id, value, round(used, 6) AS used FROM t WHERE used > 0 AND s >= 5
""")
def win_greedy_reference(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_id", "value")
    return rounded(timeline.greedy_reference(e, "user_id", "value", "event_id", most=200.0, target=60.0, short=5.0, least=5.0), "used")


@query("""
WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber))
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CASE WHEN k = n THEN 'best' WHEN k = n // 2 + 1 THEN 'median' ELSE 'lower_quartile' END AS pick
FROM r WHERE k IN (n, n // 2 + 1, n // 4 + 1)
""")
def win_percentile_picks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return selection.percentile_picks(rows, ["l_returnflag"], "l_extendedprice", "o").drop("o")


# -- graph -------------------------------------------------------------------


@query("""
SELECT 's' || s_suppkey AS speaker, 'n' || s_nationkey AS component FROM supplier UNION SELECT 'n' || s_nationkey, 'n' || s_nationkey FROM supplier
""")
def gr_components(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.concat(F.lit("s"), "s_suppkey").alias("english_speaker_id"), F.concat(F.lit("n"), "s_nationkey").alias("spanish_speaker_id"))
    return graph.speaker_components(s)


@query()
def gr_partition(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_suppkey").alias("pair_id"), F.concat(F.lit("s"), "s_suppkey").alias("english_speaker_id"), F.concat(F.lit("n"), "s_nationkey").alias("spanish_speaker_id"))
    return graph.assign_splits(s)


@query("""
WITH m AS (SELECT l_suppkey::VARCHAR AS member, l_returnflag AS split FROM lineitem UNION ALL SELECT 'p' || l_partkey, l_returnflag FROM lineitem)
SELECT member, count(DISTINCT split) AS n_splits FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1
""")
def gr_leaks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag").select("l_suppkey", F.concat(F.lit("p"), "l_partkey").alias("part"), F.col("l_returnflag").alias("split"))
    return graph.leaks(rows, ["l_suppkey", "part"])


# -- systems -----------------------------------------------------------------


def _frame(spark, sf_dir) -> DataFrame:
    part = F.col("l_suppkey") % 10
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(part < 6, "train").when(part < 8, "dev").otherwise("test").alias("split"), (F.col("l_quantity") * 1500).alias("copy"), F.col("l_extendedprice").alias("target"), F.col("l_discount").alias("x1"), F.col("l_tax").alias("x2"), F.col("l_quantity").alias("x3"))


@query("""
WITH f AS (SELECT CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'dev' ELSE 'test' END AS split, l_quantity * 1500 AS c, l_extendedprice AS t FROM lineitem),
tr AS (SELECT avg(t) AS m, avg(t - c) AS o FROM f WHERE split = 'train'),
p AS (SELECT split, 'B0' AS system, c AS p, t FROM f UNION ALL SELECT split, 'B1', m, t FROM f, tr UNION ALL SELECT split, 'B2', c + o, t FROM f, tr),
s AS (SELECT split, system, count(*) AS n, round(avg(abs(p - t)), 3) AS mae, round(median(abs(p - t)), 3) AS medae, round(sqrt(avg((p - t) ^ 2)), 3) AS rmse, avg(abs(p - t)) AS raw FROM p GROUP BY 1, 2)
SELECT split, system, n, mae, medae, rmse, round_even(100 * (raw - b) / b, 2) AS mae_vs_b2_pct FROM s JOIN (SELECT split, raw AS b FROM s WHERE system = 'B2') USING (split)
""")
def st_baselines(spark, sf_dir):
    rows = systems.baselines(_frame(spark, sf_dir), [], "copy", "target")
    long = systems.long_systems(rows, ["split", "target"], ["B0", "B1", "B2"])
    scores = systems.error_metrics(long, ["split", "system"], "prediction", "target")
    out = systems.versus_baseline(scores, ["split"], "system", "mae", "B2")
    return rounded(out, "mae", "medae", "rmse", places=3).select("split", "system", "n", "mae", "medae", "rmse", F.col("mae_vs_B2_pct").alias("mae_vs_b2_pct"))


@query()
def st_ridge_study(spark, sf_dir):
    rows, _ = systems.study(_frame(spark, sf_dir), ["x1", "x2", "x3"], "copy", "target")
    long = systems.long_systems(rows, ["split", "target"], ["B0", "B1", "B2", "ridge"])
    return systems.error_metrics(long, ["split", "system"], "prediction", "target")


@query("""
WITH t AS (SELECT l_discount AS x1, l_tax AS x2, l_extendedprice - l_quantity * 1500 AS y FROM lineitem WHERE l_suppkey % 10 < 6),
m AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM t),
g AS (SELECT *, n + 1.0 AS a, n * c12 / sqrt(v1 * v2) AS b, n * c1 / sqrt(v1) AS r1, n * c2 / sqrt(v2) AS r2 FROM m)
SELECT round(my, 4) AS intercept, round((r1 * a - b * r2) / (a * a - b * b), 4) AS w1, round((a * r2 - b * r1) / (a * a - b * b), 4) AS w2 FROM g
""")
def st_ridge_weights(spark, sf_dir):
    rows = _frame(spark, sf_dir).where("split = 'train'").withColumn("y", F.col("target") - F.col("copy"))
    m = systems.Moments(rows, ["x1", "x2"], "y").ridge(1.0)
    return spark.createDataFrame([(round(float(m.intercept), 4), round(float(m.weights[0]), 4), round(float(m.weights[1]), 4))], "intercept double, w1 double, w2 double")


def _clusters(spark, sf_dir) -> DataFrame:
    """Errors of two systems by supplier and ship mode, summed by supplier."""
    l = table(spark, sf_dir, "lineitem", "l_linestatus", "l_suppkey", "l_quantity", "l_extendedprice")
    return l.groupBy("l_linestatus", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("e"), F.sum(F.col("l_extendedprice") / 1500).alias("b"))


@query()
def st_cluster_inference(spark, sf_dir):
    rows = systems.baselines(_frame(spark, sf_dir), [], "copy", "target").where("split = 'test'")
    rows = rows.select(F.col("l_suppkey").cast("string").alias("c"), F.abs(F.col("B1") - F.col("target")).alias("e"), F.abs(F.col("B2") - F.col("target")).alias("b"))
    return inference.cluster_inference(rows, [], "c", "e", "b")


@query("""
WITH per AS (SELECT l_linestatus, l_suppkey, count(*) AS n, sum(l_quantity) AS e, sum(l_extendedprice / 1500) AS b FROM lineitem GROUP BY 1, 2),
picks AS (SELECT o_orderkey % 100 AS draw, 1 + o_custkey % (SELECT max(s_suppkey) FROM supplier) AS l_suppkey, count(*) AS times FROM orders GROUP BY 1, 2),
s AS (SELECT l_linestatus, draw, (sum(times * e) - sum(times * b)) / sum(times * n) AS d FROM per JOIN picks USING (l_suppkey) GROUP BY 1, 2),
q AS (SELECT l_linestatus, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM s GROUP BY 1)
SELECT l_linestatus, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo > 0 OR hi < 0 AS excludes_zero FROM q
""")
def st_bootstrap_given(spark, sf_dir):
    per = _clusters(spark, sf_dir)
    most = table(spark, sf_dir, "supplier", "s_suppkey").agg(F.max("s_suppkey").alias("most"))
    draws = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(F.broadcast(most), F.lit(True))
    picks = draws.groupBy((F.col("o_orderkey") % 100).alias("draw"), (1 + F.col("o_custkey") % F.col("most")).alias("l_suppkey")).agg(F.count(F.lit(1)).alias("times"))
    keyed = picks.join(per.select("l_linestatus").distinct(), F.lit(True))
    sums = inference.resample_given(per, keyed, ["l_linestatus"], "l_suppkey", ["n", "e", "b"])
    return rounded(inference.percentile_interval(sums, ["l_linestatus"], "n", "e", "b"), "ci_low", "ci_high")


@query("""
WITH RECURSIVE d AS (
  SELECT c_nationkey || '|' || c_mktsegment AS k, c_acctbal - 4000 AS d FROM customer UNION ALL SELECT c_mktsegment, c_acctbal - 4300 FROM customer
  UNION ALL SELECT 'tied|' || l_returnflag, l_quantity - 25 FROM lineitem WHERE l_orderkey % 97 = 1
), z AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY k, abs(d)) AS m FROM d WHERE d <> 0
), s AS (SELECT k, count(*) AS nz, sum(r) FILTER (WHERE d > 0) AS plus, sum(m * m - 1) AS ties FROM z GROUP BY 1
), c AS (SELECT d.k, count(*) AS n FROM d GROUP BY 1
), t AS (SELECT c.k, n, coalesce(nz, 0) AS nz, least(coalesce(plus, 0), nz * (nz + 1) / 2.0 - coalesce(plus, 0)) AS w, ties FROM c LEFT JOIN s USING (k)
), w(n, v, ways) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL
  SELECT n + 1, v, sum(ways) FROM (SELECT n, v, ways FROM w WHERE n < 50 UNION ALL SELECT n, v + n + 1, ways FROM w WHERE n < 50) GROUP BY n, v
), x AS (SELECT k, abs(w - nz * (nz + 1) / 4.0) / sqrt(nz * (nz + 1) * (2 * nz + 1) / 24.0 - ties / 48.0) / sqrt(2) AS x FROM t
), e AS (SELECT k, CASE WHEN x > 5 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * i + 1) * ln(greatest(x, 1e-300)) - lgamma(i + 1)) / (2 * i + 1))) END AS normal FROM x
), p AS (SELECT k, 2 * sum(ways) / 2.0 ^ any_value(nz) AS exact FROM t JOIN w ON w.n = nz AND v <= w AND nz = t.n AND ties = 0 AND nz <= 50 GROUP BY 1)
SELECT t.k, t.n, nz AS n_nonzero, round(w, 1) AS statistic, round(CASE WHEN nz > 0 THEN least(1, coalesce(exact, normal)) END, 6) AS p FROM t JOIN e USING (k) LEFT JOIN p USING (k)
""")
def st_signed_ranks(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment", "c_acctbal")
    rows = c.select(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("k"), (F.col("c_acctbal") - 4000).cast("double").alias("d"))
    rows = rows.union(c.select("c_mktsegment", (F.col("c_acctbal") - 4300).cast("double")))
    tied = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_quantity").where("l_orderkey % 97 = 1")
    rows = rows.union(tied.select(F.concat(F.lit("tied|"), "l_returnflag"), (F.col("l_quantity") - 25).cast("double")))
    return rounded(rounded(inference.signed_ranks(rows, ["k"], "d"), "statistic", places=1), "p")


@query("""
WITH t AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_suppkey % 10 < 6)
SELECT CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'dev' ELSE 'test' END AS split, round(avg((l_quantity - m) / s), 6) AS mean_std, round(max((l_quantity - m) / s), 6) AS max_std FROM lineitem, t GROUP BY 1
""")
def st_standardised(spark, sf_dir):
    out = systems.standardised(_frame(spark, sf_dir), ["x3"]).groupBy("split").agg(F.avg("x3_std").alias("mean_std"), F.max("x3_std").alias("max_std"))
    return rounded(out, "mean_std", "max_std")


# -- text --------------------------------------------------------------------

_ASCII = "regexp_replace({}, '[^ -~]', '', 'g')"


@query(f"""
WITH t AS (SELECT conv_id, turn, {_ASCII.format('text')} AS hyp, lag({_ASCII.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations)
SELECT conv_id, turn, round(levenshtein(ref, hyp) / length(ref), 6) AS cer FROM t WHERE length(ref) > 0
""")
def str_cer(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("hyp", F.regexp_replace("text", "[^ -~]", ""))
    c = c.withColumn("ref", F.lag("hyp").over(W.partitionBy("conv_id").orderBy("turn"))).where(F.length("ref") > 0)
    return c.select("conv_id", "turn", F.round(text_metrics.cer("ref", "hyp"), 6).alias("cer"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_words, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS spoken,
       len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS n_numbers,
       len(list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_'']+'), lambda w: lower(w)), lambda w: w IN ('no', 'not', 'never', 'nobody', 'nothing', 'none', 'neither', 'nor', 'nowhere', 'cannot', 'without')))
       + len(list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_'']+'), lambda w: lower(w)), lambda w: ends_with(w, 'n''t'))) AS n_negations
FROM documents
""")
def str_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", text.word_count("text").alias("n_words"), text.spoken_chars("text").alias("spoken"), F.size(text.numbers("text")).alias("n_numbers"), text.negations("text", "en").alias("n_negations"))


@query("""
SELECT doc_id, ('0x' || substr(sha256(doc_id || '|' || lang), 1, 8))::BIGINT % 2147483647 AS seed FROM documents
""")
def str_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "lang").select("doc_id", numeric.seed31("doc_id", "lang").alias("seed"))


@query(r"""
WITH b AS (SELECT conv_id, turn, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM conversations),
c AS (SELECT conv_id, turn, body, regexp_replace(regexp_replace(body, '([?!…])\s+', '\1' || chr(1), 'g'), '(\.)\s+([A-ZÁÉÍÓÚÑÜ¿¡])', '\1' || chr(1) || '\2', 'g') AS cut FROM b),
p AS (SELECT conv_id, turn, body, list_filter(list_transform(string_split(cut, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM c),
q AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN [body] WHEN len(p) > 1 AND NOT regexp_matches(p[-1], '\s') AND NOT regexp_matches(p[-1], '[.?!…]$')
  THEN list_append(p[1:len(p) - 2], p[-2] || ' ' || p[-1]) ELSE p END AS p FROM p)
SELECT conv_id, turn, unnest(range(len(p)))::INTEGER AS pos, unnest(p) AS sentence FROM q
""")
def str_sentences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


_WORDS = r"regexp_extract_all(regexp_replace(lower({}), '\p{{P}}', '', 'g'), '\S+')"


# the rows of the edit table are folded over the reference's words; what comes from the left is a running minimum
@query(f"""
WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
p AS (SELECT role, ref, {_WORDS.format("ref")} AS r, {_WORDS.format("text")} AS h FROM t WHERE ref IS NOT NULL),
d AS (SELECT role, ref, len(r) AS n, list_reduce(list_prepend(range(len(h) + 1), list_transform(r, lambda w: list_transform(h, lambda x: CAST(x <> w AS BIGINT)))),
  lambda row, cost: list_transform([list_transform(range(len(row)), lambda j: CASE WHEN j = 0 THEN row[1] + 1 ELSE least(row[j + 1] + 1, row[j] + cost[j]) END - j)],
    lambda b: list_transform(range(len(b)), lambda j: j + list_min(b[1:j + 1])))[1])[-1] AS edits FROM p)
SELECT role, round(sum(edits) / sum(n), 6) AS corpus_wer, round(avg(CASE WHEN trim(ref) <> '' AND n > 0 THEN edits / n END), 6) AS mean_wer, count(*) AS n FROM d GROUP BY 1
""")
def str_word_error(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("ref", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("ref is not null")
    out = text_metrics.with_word_errors(c, "ref", "text").groupBy("role").agg(text_metrics.corpus_wer().alias("corpus_wer"), F.avg("wer").alias("mean_wer"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "corpus_wer", "mean_wer")


@query()
def str_translation_scores(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("ref", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("ref is not null")
    return text_metrics.translation_scores(c, ["role"], "text", "ref")


@query(r"""
SELECT page_id, starts_with(lower(url), 'http') AND NOT regexp_matches(regexp_extract(url, '^https?://([^/?#:]*)', 1), '^localhost$|\.(localhost|local|internal)$')
  AND regexp_extract(url, '^https?://([^/?#:]*)', 1) <> '' AS public FROM pages
""")
def str_public_url(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", text.public_url("url").alias("public"))


@query(f"""
WITH t AS (SELECT conv_id, turn, {_ASCII.format('text')} AS text, lag({_ASCII.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
p AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(ref), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS r, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS h FROM t WHERE ref IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN r = '' THEN 0.0 ELSE levenshtein(r, CASE WHEN h = '' THEN '-' ELSE h END) / length(r) END, 6) AS cer FROM p
""")
def str_take_cer(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("hyp", F.regexp_replace("text", "[^ -~]", ""))
    c = c.withColumn("ref", F.lag("hyp").over(W.partitionBy("conv_id").orderBy("turn"))).where("ref is not null")
    return c.select("conv_id", "turn", F.round(text.take_cer("ref", "hyp"), 6).alias("cer"))


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS parsed, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN round(value / (event_id % 5), 6) END AS ratio,
       CASE WHEN event_id % 7 <> 0 AND value > 0 THEN round(12 * log2(value / 100), 6) END AS semitones, CASE WHEN event_id % 7 <> 0 AND value > 0 THEN round(ln(value), 6) END AS logged,
       CASE WHEN event_id % 7 <> 0 THEN value BETWEEN 60 AND 400 END AS plausible, event_id % 3 = 0 AS flag, least(greatest(value, 10), 40) AS clamped,
       least(4, greatest(1.5, 0.3 * value)) AS least_seconds FROM events
""")
def fil_guards(spark, sf_dir):
    """Parsing and guards: text that is no number, division by zero, logarithms of what has none, truth in any dress."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events", "event_id", "value").withColumn("raw", F.when(k % 7 == 0, F.element_at(F.array(F.lit("nan"), F.lit(""), F.lit("inf"), F.lit("x")), (k % 4 + 1).cast("int"))).otherwise(F.col("value").cast("string")))
    e = e.withColumns({"x": numeric.finite("raw"), "said": F.when(k % 3 == 0, F.lit("\tTrue ")).otherwise("no")})
    logs = {"ratio": numeric.safe_div("x", (k % 5).cast("double")), "semitones": numeric.semitones("x"), "logged": numeric.safe_ln("x")}
    return e.select("event_id", F.col("x").alias("parsed"), *[F.round(v, 6).alias(n) for n, v in logs.items()], numeric.plausible_hz("x").alias("plausible"), numeric.truth("said").alias("flag"), numeric.clamp(F.col("value"), 10.0, 40.0).alias("clamped"), numeric.min_speaker_seconds("value").alias("least_seconds"))


@query("""
SELECT l_orderkey, l_returnflag AS text, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2
""")
def set_unique_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").withColumnsRenamed({"l_returnflag": "text", "l_linenumber": "pos"})
    return selection.unique_candidates(rows, ["l_orderkey"], "text", "pos").select("l_orderkey", "text", "pos")


# -- selection ---------------------------------------------------------------


@query("""
SELECT l_orderkey, arg_min(l_linenumber, (l_returnflag = 'R', round_even(l_discount, 2), l_quantity, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY 1
""")
def srt_best_take(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity").withColumn("run", F.col("l_returnflag") == "R")
    return selection.best_take(rows, ["l_orderkey"], "run", "l_discount", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber")


@query()
def srt_pick_shorter(spark, sf_dir):
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumns({"current": F.first("text").over(W.partitionBy("conv_id").orderBy("turn")), "score": -F.col("turn") / 100.0, "room": F.lit(40)})
    good = selection.eligible(c, ["conv_id"], "text", "score", "current", "en", delta=1.0)
    return selection.pick_shorter(good, ["conv_id"], "text", "score", "room", "turn")


@query("""
WITH k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('498|' || doc_id), doc_id) AS r FROM (SELECT DISTINCT lang, doc_id FROM documents))
SELECT lang, doc_id, source FROM documents SEMI JOIN (SELECT * FROM k WHERE r <= 20) USING (lang, doc_id)
""")
def smp_sample_keys(spark, sf_dir):
    return resume.sample_keys(table(spark, sf_dir, "documents", "lang", "doc_id", "source"), "doc_id", 20, ["lang"], 498)


@query("""
SELECT source, CAST(least(floor((least(greatest(n_chars, 0), 6000)) / 100.0) + 1, 60) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1, 2
""")
def fig_histogram(spark, sf_dir):
    return selection.histogram(table(spark, sf_dir, "documents", "source", "n_chars"), "n_chars", 0.0, 6000.0, 60, ["source"])


@query("""
SELECT l_returnflag, count(l_extendedprice) AS n, round(min(l_extendedprice), 4) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(max(l_extendedprice), 4) AS high FROM lineitem GROUP BY 1
""")
def fig_box_stats(spark, sf_dir):
    return rounded(selection.box_stats(table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice"), "low", "q1", "median", "q3", "high", places=4)


# -- vectors and arrays ------------------------------------------------------


@query("""
WITH l AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(s, 6) AS similarity FROM l
""")
def st_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(numeric.cosine("embedding", "other"), 6).alias("similarity"))


@query("""
WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label AS l, list(x ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT vec_id, label, l, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, c)
SELECT vec_id, label, arg_min(l, (-round(s, 12), l)) AS label_near, round(arg_min(s, (-round(s, 12), l)), 6) AS similarity FROM s GROUP BY 1, 2
""")
def gr_nearest_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    centres = e.groupBy("label").agg(clusters.mean_vector("embedding", 64).alias("centre"))
    out = clusters.nearest_centroid(e, centres, "vec_id", "embedding", "label", "centre")
    return out.select("vec_id", "label", "label_near", F.round("similarity", 6).alias("similarity"))


@query()
def gr_cluster_voices(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    seg = e.select(F.floor(F.col("vec_id") / 25).alias("job"), (F.col("vec_id") % 25).alias("idx"), F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("embedding"), (F.lit(1.0) + F.col("vec_id") % 4).alias("seconds"), (F.col("vec_id") % 25 * 5.0).alias("start"))
    return clusters.cluster_jobs(seg)


_DCT = ", ".join("list_sum(list_transform(range(64), lambda i: v[i + 1] * sqrt(2 / 64.0) * cos(pi() * (2 * i + 1) * %d / 128.0)))" % k for k in range(1, 9))


@query(f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, list_transform([{_DCT}], lambda x: round(x, 6)) AS coefficients FROM e
""")
def arr_dct(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform(arrays.dct_encode("embedding"), lambda x: numeric.signed_round(x, 6)).alias("coefficients"))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, list_transform(range(64), lambda i: round(list_sort(list_transform(range(-2, 3), lambda j: v[least(greatest(i + j, 0), 63) + 1]))[3], 6)) AS smooth FROM e
""")
def arr_median_filter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform(arrays.median_filter("embedding", 5), lambda x: numeric.signed_round(x.cast("double"), 6)).alias("smooth"))


@query()
def arr_contours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    hz = F.transform("embedding", lambda x: (F.lit(150.0) + x.cast("double") * 200).cast("float"))
    out = e.select("vec_id", arrays.resample_contour(hz, F.transform("embedding", lambda x: x > -0.3)).alias("c")).where("c.shape is not null")
    back = arrays.dct_decode(arrays.dct_encode("c.shape"))
    return out.select("vec_id", F.round("c.level", 6).alias("level"), F.round("c.ratio", 6).alias("ratio"), F.round(arrays.array_corr("c.shape", back), 6).alias("reconstruction_r"))


@query("""
SELECT vec_id, CAST(round_even(len(embedding) * 8 * 0.8, 0) AS INTEGER) AS n FROM embeddings
""")
def arr_time_scale(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    sound = F.flatten(F.array_repeat(F.transform("embedding", lambda x: x.cast("double")), 8))
    return e.select("vec_id", F.size(arrays.stretch(8000)(sound, F.lit(0.8))).alias("n"))


# -- streaming ---------------------------------------------------------------


@query("""
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, CAST(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3
""")
def stream_windows(spark, sf_dir):
    """The batch form of the windowed rollup; the stream's own run is tested to give the same rows."""
    return rounded(jobs.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "value"), "total", places=4).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""
WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s
""")
def stream_sessions(spark, sf_dir):
    out = jobs.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})




@query(f"""
WITH e AS (SELECT vec_id % 4 AS k, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT k, v, [{_DCT}] AS c FROM e),
b AS (SELECT k, v, list_transform(range(64), lambda i: list_sum(list_transform(range(1, 9), lambda j: c[j] * sqrt(2 / 64.0) * cos(pi() * (2 * i + 1) * j / 128.0)))) AS b FROM c),
r AS (SELECT k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - list_avg(v)) * (b[i] - list_avg(b)))) / sqrt(list_sum(list_transform(v, lambda x: (x - list_avg(v)) ^ 2)) * list_sum(list_transform(b, lambda x: (x - list_avg(b)) ^ 2))) AS r,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - b[i]) ^ 2)) / 64) AS rmse FROM b)
SELECT k, count(*) AS contours, round(avg(r), 6) AS r_mean, round(quantile_cont(r, 0.5), 6) AS r_median, round(quantile_cont(r, 0.1), 6) AS r_p10, round(quantile_cont(rmse, 0.5), 6) AS rmse_median FROM r GROUP BY 1
""")
def arr_reconstruction(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select((F.col("vec_id") % 4).alias("k"), F.col("embedding").cast("array<double>").alias("shape"))
    return rounded(summary.reconstruction_stats(e, "shape", ["k"]), "r_mean", "r_median", "r_p10", "rmse_median")


# -- recordings --------------------------------------------------------------


def _track(spark, sf_dir) -> DataFrame:
    """Vectors as seconds of 64 samples, sixteen to a recording; the last recording's last second is cut short."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.floor(F.col("vec_id") / 16).alias("job"), (F.col("vec_id") % 16).alias("second"), F.when(F.col("vec_id") % 16 == 15, F.slice(v, 1, 40)).otherwise(v).alias("samples"))


_SAMPLES = """
t AS (SELECT vec_id // 16 AS job, vec_id % 16 AS second, (CASE WHEN vec_id % 16 = 15 THEN embedding[1:40] ELSE embedding END)::DOUBLE[] AS s FROM embeddings),
x AS (SELECT job, second, unnest(s) AS v, second * 64 + unnest(range(len(s))) AS i FROM t),
n AS (SELECT job, max(i) + 1 AS n FROM x GROUP BY 1)"""


@query(f"""
WITH {_SAMPLES},
seg AS (SELECT event_id % 1000 AS job, (event_id * 7 % 150) / 10.0 AS a, (event_id * 7 % 150) / 10.0 + (event_id % 13) / 10.0 AS b FROM events WHERE event_id % 3 = 0),
cut AS (SELECT DISTINCT job, greatest(0, trunc(a * 64)::BIGINT) AS a, trunc(b * 64)::BIGINT AS b FROM seg WHERE trunc(b * 64)::BIGINT > trunc(a * 64)::BIGINT),
g AS (SELECT x.job, x.i, any_value(x.v) AS v, any_value(second) AS second, CASE WHEN count(cut.a) > 0 THEN 0.25 ELSE 0.8 END AS g FROM x LEFT JOIN cut ON cut.job = x.job AND cut.a <= x.i AND x.i < cut.b GROUP BY 1, 2),
wide AS (SELECT job, i, g FROM g UNION ALL SELECT g.job, -k, g.g FROM g, range(1, 10) r(k) WHERE i = 0 UNION ALL SELECT g.job, i + k, g.g FROM g JOIN n USING (job), range(1, 10) r(k) WHERE i = n - 1),
m AS (SELECT job, i, avg(g) OVER (PARTITION BY job ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS g FROM wide)
SELECT g.job, second, round(sum(v * m.g), 6) AS total, round(max(abs(v * m.g)), 6) AS peak, round(min(m.g), 6) AS least_gain FROM g JOIN m USING (job, i) GROUP BY 1, 2
""")
def arr_duck(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id").where("event_id % 3 = 0")
    start = (F.col("event_id") * 7 % 150) / 10.0
    seg = e.select((F.col("event_id") % 1000).alias("job"), start.alias("start"), (start + (F.col("event_id") % 13) / 10.0).alias("end"))
    track = _track(spark, sf_dir)
    out = tracks.duck(track, seg, 64)
    ones = tracks.duck(track.withColumn("samples", F.transform("samples", lambda v: F.lit(1.0))), seg, 64).select("job", "second", F.round(F.array_min("samples"), 6).alias("least_gain"))
    total = F.aggregate("samples", F.lit(0.0), lambda t, v: t + v)
    return out.select("job", "second", F.round(total, 6).alias("total"), F.round(F.array_max(F.transform("samples", F.abs)), 6).alias("peak")).join(ones, ["job", "second"])


@query(f"""
WITH {_SAMPLES},
c AS (SELECT x.job, x.i, v, second, unnest(CASE WHEN (i + 12) // 100 > i // 100 AND (i // 100 + 1) * 100 < n THEN [i // 100, i // 100 + 1] ELSE [i // 100] END) AS chunk, n FROM x JOIN n USING (job)),
m AS (SELECT *, v - avg(v) OVER (PARTITION BY job, chunk) AS d FROM c),
w AS (SELECT job, second, i, d * CASE WHEN chunk > 0 AND i < chunk * 100 THEN (i - chunk * 100 + 12) / 11.0 ELSE 1 END * CASE WHEN (chunk + 1) * 100 < n AND i >= (chunk + 1) * 100 - 12 THEN 1 - (i - (chunk + 1) * 100 + 12) / 11.0 ELSE 1 END AS v FROM m),
s AS (SELECT job, second, i, sum(v) AS v FROM w GROUP BY 1, 2, 3)
SELECT job, second, count(*) AS n, round(sum(v), 6) AS total, round(sum(v * v), 6) AS energy FROM s GROUP BY 1, 2
""")
def arr_overlap_add(spark, sf_dir):
    def less_mean(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("samples", numeric.let("samples", lambda s: numeric.let(arrays.array_mean(s), lambda m: F.transform(s, lambda v: v - m))))

    pieces = less_mean(tracks.chunks(_track(spark, sf_dir), 64, 100, 12))
    out = tracks.overlap_add(pieces, 64, 100, 12)
    total = lambda f: F.round(F.aggregate("samples", F.lit(0.0), lambda t, v: t + f(v)), 6)
    return out.select("job", "second", F.size("samples").cast("long").alias("n"), total(lambda v: v).alias("total"), total(lambda v: v * v).alias("energy"))


@query("""
SELECT s_suppkey, 80 + s_suppkey * 37 % 300 AS hz, true AS near, true AS voiced, 16 AS frames, 3 AS n_words FROM supplier
""")
def arr_pitch(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey").withColumn("hz", 80 + F.col("s_suppkey") * 37 % 300)
    wave = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda i: 0.3 * F.sin(2 * F.pi() * i * F.col("hz") * h / 16000.0))
    sound = F.zip_with(wave(1), wave(2), lambda a, b: a + 0.5 * b)
    told = s.select("s_suppkey", "hz", pitch.track(sound, F.lit(16000)).alias("t")).withColumn("p", pitch.prosody("t", F.lit("three short words")))
    return told.select("s_suppkey", "hz", (F.abs(F.col("p.f0_median_hz") / F.col("hz") - 1) < 0.01).alias("near"), (F.col("p.voiced_ratio") > 0.9).alias("voiced"), F.size("t.f0").alias("frames"), F.col("p.n_words").alias("n_words"))


@query("""
WITH s AS (SELECT l_orderkey AS job, l_suppkey % 3 AS speaker, count(*) FILTER (WHERE l_linenumber % 4 <> 0) AS voiced, avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_discount::DOUBLE / 3 END) AS similarity FROM lineitem GROUP BY 1, 2)
SELECT job, round(sum(voiced * similarity) / nullif(sum(CASE WHEN similarity IS NOT NULL THEN voiced END), 0), 6) AS similarity FROM s GROUP BY 1
""")
def agg_job_similarity(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_discount")
    n = F.col("l_linenumber")
    speakers = l.groupBy(F.col("l_orderkey").alias("job"), (F.col("l_suppkey") % 3).alias("speaker")).agg(F.count_if(n % 4 != 0).alias("voiced"), F.avg(F.when(n % 3 != 0, F.col("l_discount").cast("double") / 3)).alias("similarity"))
    return rounded(summary.job_similarity(speakers, ["job"]), "similarity")


# -- extended study ----------------------------------------------------------


@query("""
WITH f AS (SELECT l_returnflag, CASE WHEN l_suppkey % 10 < 6 THEN 'train' WHEN l_suppkey % 10 < 8 THEN 'dev' ELSE 'test' END AS split, l_suppkey, l_quantity * 1500 AS c, l_extendedprice AS t FROM lineitem),
tr AS (SELECT avg(t) AS m, avg(t - c) AS o FROM f WHERE split = 'train'),
w AS (SELECT l_returnflag, l_suppkey, t, unnest([{'s': 'B0', 'p': c::DOUBLE}, {'s': 'B1', 'p': m}, {'s': 'B2', 'p': c + o}, {'s': 'twin', 'p': c + o + 1e-7}]) AS x, abs(c + o - t) AS b FROM f, tr WHERE split = 'test'),
e AS (SELECT l_returnflag, x.s AS system, l_suppkey, abs(x.p - t) AS e, b FROM w),
g AS (SELECT l_returnflag, system, count(*) AS n, avg(e) AS mae, median(e) AS medae, avg(b) AS base, bool_and(abs(e - b) <= 1e-9 + 1e-6 * abs(b)) AS same, count(DISTINCT l_suppkey) AS clusters FROM e GROUP BY 1, 2)
SELECT l_returnflag, system, n, round(mae, 3) AS mae, round(medae, 3) AS medae, round_even(100 * (mae - base) / base, 2) + 0.0 AS change, CASE WHEN system <> 'B2' THEN same END AS equivalent,
       CASE WHEN system <> 'B2' THEN clusters END AS clusters, system = 'B1' AS is_primary, CASE WHEN system = 'twin' THEN 1.0 END AS p_twin FROM g
""")
def st_extended(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem", "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice")
    part = F.col("l_suppkey") % 10
    frame = flags.select("l_returnflag", "l_suppkey", F.when(part < 6, "train").when(part < 8, "dev").otherwise("test").alias("split"), (F.col("l_quantity") * 1500).alias("copy"), F.col("l_extendedprice").alias("target"))
    rows = systems.baselines(frame, [], "copy", "target").where("split = 'test'").withColumn("twin", F.col("B2") + 1e-7)
    got = extended.judged(rows, ["l_returnflag"], ["B0", "B1", "B2", "twin"], "target", "l_suppkey", primary=("B1",), draws=200)
    told = rounded(got.withColumn("p_twin", F.when(F.col("system") == "twin", F.col("p"))), "mae", "medae", places=3)
    return told.select("l_returnflag", "system", "n", "mae", "medae", (F.col("mae_vs_B2_pct") + 0.0).alias("change"), "equivalent", F.col("n_clusters").alias("clusters"), "is_primary", "p_twin")


@query("""
WITH u AS (SELECT label, vec_id, unnest(embedding) AS t, unnest(list_reverse(embedding)) AS p, unnest(list_transform(embedding, lambda x: x * x)) AS square FROM embeddings),
r AS (SELECT label, vec_id, corr(t::DOUBLE, p::DOUBLE) AS reversed, corr(t::DOUBLE, square::DOUBLE) AS square FROM u GROUP BY 1, 2),
l AS (SELECT label, 'reversed' AS system, reversed AS r FROM r UNION ALL SELECT label, 'square', square FROM r UNION ALL SELECT label, 'flat', NULL FROM r)
SELECT label, system, count(r) AS n, round(avg(r), 6) AS shape_r_mean, round(median(r), 6) AS shape_r_median FROM l GROUP BY 1, 2
""")
def st_shape_scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings", "label", "embedding")
    arms = {"reversed": F.reverse("embedding"), "square": F.transform("embedding", lambda x: x * x), "flat": F.transform("embedding", lambda x: F.lit(1.0))}
    return rounded(extended.shape_scores(v, ["label"], arms, "embedding"), "shape_r_mean", "shape_r_median")


# -- networks ----------------------------------------------------------------


def _curves(spark, sf_dir) -> DataFrame:
    """Vectors as curves of 64 points, their first eight values as scalars, two of them scaled up as targets, by label."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("e", F.col("embedding").cast("array<double>"))
    return v.select("vec_id", "label", F.when(F.col("vec_id") % 5 == 0, "dev").otherwise("train").alias("split"), F.slice("e", 1, 8).alias("x"), F.col("e").alias("c"), F.array(30 * F.col("e")[0], 4 * F.col("e")[1]).alias("y"))


@query("""
WITH v AS (SELECT label, 30 * embedding[1]::DOUBLE AS a, 4 * embedding[2]::DOUBLE AS b FROM embeddings WHERE label IS NOT NULL),
h AS (SELECT label, CASE WHEN abs(a) < 1 THEN a * a / 2 ELSE abs(a) - 0.5 END AS ha, CASE WHEN abs(b) < 1 THEN b * b / 2 ELSE abs(b) - 0.5 END AS hb,
             greatest(-1, least(1, -a)) AS ga, greatest(-1, least(1, -b)) AS gb FROM v)
SELECT label::VARCHAR AS label, seed, count(*) AS n, round(sum(ha + 0.3 * hb), 6) AS loss, round(sum(ga), 6) AS slope_a, round(sum(0.3 * gb), 6) AS slope_b
FROM h, (SELECT unnest([1, 2])::BIGINT AS seed) GROUP BY ALL
""")
def ml_gradient(spark, sf_dir):
    """Loss and the last layer's slopes of untrained convolutions, for every label and seed: what an untrained network predicts
    is nothing, so SQL can say both."""
    shape = training.Shape("curve", 8, 64, 2, hidden=16)
    rows = training.usable(_curves(spark, sf_dir), shape, "label", ["vec_id"], "x", "c", "y", "split")
    keys = [str(r.label) for r in table(spark, sf_dir, "embeddings", "label").where("label is not null").distinct().collect()]
    got = training.sums(rows, shape, {(k, seed): shape.start(seed) for k in keys for seed in (1, 2)}, [1.0, 0.3])
    return rounded(got.select(F.col("k").alias("label"), "seed", "n", "loss", F.element_at("gradient", -2).alias("slope_a"), F.element_at("gradient", -1).alias("slope_b")), "loss", "slope_a", "slope_b")


@query()
def ml_training(spark, sf_dir):
    """Three epochs of convolutions of two seeds over all vectors: the development losses by epoch."""
    shape = training.Shape("curve", 8, 64, 2, hidden=16)
    rows = _curves(spark, sf_dir).withColumn("all", F.lit("all"))
    made = training.train(rows, shape, "all", ["vec_id"], "x", "c", "y", [1, 2], weights=[1.0, 0.3], batch=100_000, epochs=3, rate=0.01)
    return made.select("seed", F.posexplode("losses").alias("epoch", "loss")).select("seed", (F.col("epoch") + 1).alias("epoch"), F.round("loss", 6).alias("loss"))
