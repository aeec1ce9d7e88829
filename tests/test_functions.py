import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays, numeric, text
from pairloom.operators import text_metrics
from pairloom.plans import study


def one(spark, *columns, rows=None, schema=None):
    df = spark.createDataFrame(rows or [(1,)], schema or "x int")
    return list(df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_numbers(spark):
    got = one(spark, *[numeric.finite(F.lit(v)) for v in ("", "nan", "inf", " 1.5", "x")])
    assert got == [None, None, None, 1.5, None]
    assert one(spark, *[numeric.semitones(F.lit(float(v))) for v in (100, 200, 50)]) == [0.0, 12.0, -12.0]
    assert one(spark, numeric.semitones(F.lit(0.0)), numeric.hertz(F.lit(12.0))) == [None, 200.0]
    assert one(spark, numeric.min_speaker_seconds(F.lit(1.0)), numeric.min_speaker_seconds(F.lit(100.0))) == [1.5, 4.0]


def test_signed_round(spark):
    values = [-3e-7, 3e-7, -0.0, 0.0, -5e-7, 1.2345675, -2.5, None, math.inf]
    got = one(spark, *[numeric.signed_round(F.lit(v).cast("double"), 6) for v in values])
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert [str(v) for v in got] == [str(v) for v in want] and str(got[0]) == "-0.0"
    assert one(spark, numeric.signed_round(F.lit(-2.5), 0), numeric.signed_round(F.lit(2.5), 0)) == [-3.0, 3.0]


def duck_rows(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return {r[0]: [str(v) for v in r[1]] for r in con.execute(study.ORACLES[name]).fetchall()}


def nearly_nothing(spark, folder):
    """Vectors whose coefficients and medians are negative and round to nothing."""
    rows = [(k, [-v] * 64) for k, v in enumerate((2e-7, 4e-7, 0.0))] + [(3, [-5e-8 * math.cos(math.pi * (2 * i + 1) / 128) for i in range(64)])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_dct_of_nearly_nothing(spark, tmp_path):
    """The signs of coefficients that round to nothing are those of the SQL."""
    folder = nearly_nothing(spark, tmp_path)
    got = {r.vec_id: [str(v) for v in r.coefficients] for r in study.QUERIES["arr_dct"](spark, folder).collect()}
    # the other coefficients cancel, and have either sign
    assert got[3][0] == duck_rows("arr_dct", folder)[3][0] == "-0.0"


def test_medians_of_nearly_nothing(spark, tmp_path):
    """Medians that round to nothing keep their signs, as in the SQL."""
    folder = nearly_nothing(spark, tmp_path)
    got = {r.vec_id: [str(v) for v in r.smooth] for r in study.QUERIES["arr_median_filter"](spark, folder).collect()}
    assert got == duck_rows("arr_median_filter", folder) and got[0] == ["-0.0"] * 64


def test_seeds(spark):
    pair = F.lit("EN_001_10__ES_001_10")
    assert one(spark, numeric.seed31(pair, F.lit("en-es")), numeric.seed31(pair, F.lit("es-en"))) == [922575599, 1750702897]


def test_guarded_corr(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert df.agg(numeric.guarded_corr("x", "y")).first()[0] is None
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 3.0)], "x double, y double")
    assert df.agg(numeric.guarded_corr("x", "y")).first()[0] == pytest.approx(1)
    assert df.agg(numeric.guarded_corr("x", "y", 3)).first()[0] is None


def test_sentences(spark):
    got = one(spark, *[text.sentences(F.lit(s)) for s in ("¿Acento? No tengo acento.", "I agree with you. I", "Dr. no sé. Vale", "", "One only")])
    assert got == [["¿Acento?", "No tengo acento."], ["I agree with you. I"], ["Dr. no sé. Vale"], [""], ["One only"]]
    assert one(spark, text.speak_whole(F.lit("¿Acento? No tengo acento.")), text.speak_whole(F.lit("No tengo acento aquí."))) == [True, False]


def test_markers(spark):
    keep = lambda c, r, lang="en": text.keeps_markers(F.lit(c), F.lit(r), lang)
    got = one(spark, keep("Is it?", "Is it so?"), keep("It is.", "Is it so?"), keep("I do like it.", "I don't like it."), keep("I have 3.", "I have 3 or 4."), keep("Well I", "Well I do."), keep(" ", "x"), keep("No sé.", "No lo sé.", "es"))
    assert got == [True, False, False, False, False, False, True]


def test_counts(spark):
    assert one(spark, text.word_count(F.lit("")), text.word_count(F.lit(" a  b ")), text.spoken_chars(F.lit("¡Sí, 12!"))) == [0, 2, 4]
    assert one(spark, text.budget_chars(F.lit(2.0), F.lit("es")), text.needs_shortening(F.lit("a" * 40), F.lit(2.0), F.lit("es"))) == [31, True]
    assert one(spark, text.chunks_of(F.lit("One. Two. Three."), 9))[0] == ["One. Two.", "Three."]
    assert one(spark, text.speech_speed(F.lit("hola"), F.lit("es"), F.lit(9.0)), text.speech_speed(F.lit("a" * 100), F.lit("es"), F.lit(1.0))) == [1.0, 1.25]


def test_language_check(spark):
    c = lambda d, p, final=True: text.check_language(F.lit(d), F.lit(p), F.lit("en-es"), final)
    assert one(spark, c("en", 0.9), c("fr", 0.3), c("es", 0.9), c("fr", 0.8), c("fr", 0.8, False), c("fr", 0.95, False)) == ["ok", "ok", "wrong_direction", "unsupported", "recheck", "unsupported"]


@pytest.mark.parametrize(("url", "ok"), [("https://example.com/x", True), ("http://localhost/x", False), ("http://127.0.0.1", False), ("http://10.1.2.3:80/", False), ("ftp://example.com", False), ("http://192.168.0.1/", False), ("https://8.8.8.8/a", True), ("http://a.internal/", False), ("http://[::1]/", False), ("http://172.20.0.1", False), ("", False), ("http://", False)])
def test_public_url(spark, url, ok):
    assert one(spark, text.public_url(F.lit(url)))[0] is ok


def test_failures(spark):
    assert one(spark, *[text.failure_kind(F.lit(m)) for m in ("Please log in", "Unsupported URL: x", "HTTP 404", "boom", None)]) == ["private", "unsupported", "unavailable", "other", "other"]


def test_cer_of_takes(spark):
    got = one(spark, text.take_cer(F.lit("¿Acento?"), F.lit("asento")), text.take_cer(F.lit("ab"), F.lit("")), text.take_cer(F.lit("?"), F.lit("x")), text.take_cer(F.lit("Año"), F.lit("ano")))
    assert got == pytest.approx([1 / 6, 1.0, 0.0, 0.0])


def test_word_errors(spark):
    rows = spark.createDataFrame([("The cat, sat.", "the cat sat"), ("a b c d", ""), ("", "x"), ("one two", "two")], "r string, h string")
    got = text_metrics.with_word_errors(rows, "r", "h").collect()
    assert [r.wer for r in got] == [0.0, 1.0, None, 0.5]
    assert text_metrics.with_word_errors(rows.where("r <> ''"), "r", "h").agg(text_metrics.corpus_wer()).first()[0] == pytest.approx(5 / 9)


def test_bleu_and_chrf():
    same = text_metrics.bleu_counts("the cat sat on the mat", "the cat sat on the mat")
    assert text_metrics.bleu(same) == pytest.approx(100)
    counts = text_metrics.bleu_counts("the cat sat on mat", "the cat sat on the mat")
    assert counts == [5, 3, 2, 1, 5, 4, 3, 2, 5, 6]
    want = math.exp(1 - 6 / 5) * math.exp(sum(math.log(100 * m / t) for m, t in zip(counts[:4], counts[4:8])) / 4)
    assert text_metrics.bleu(counts) == pytest.approx(want)
    assert text_metrics.tokens_13a('It\'s 3.5, "yes".') == ["It's", "3.5", ",", '"', "yes", '"', "."]
    assert text_metrics.chrf(text_metrics.chrf_counts("abc def", "abc def")) == pytest.approx(100)
    assert text_metrics.chrf(text_metrics.chrf_counts("abc", "xyz")) == 0
    # orders 1 and 2 occur on both sides: precision 2/2 and 1/1, recall 2/3 and 1/2
    p, r = (1 + 1) / 2, (2 / 3 + 1 / 2) / 2
    assert text_metrics.chrf(text_metrics.chrf_counts("ab", "abc")) == pytest.approx(100 * 5 * p * r / (4 * p + r))


def test_contour(spark):
    flat = arrays.contour_of(np.array([120.0] * 30 + [0.0] * 20), np.array([True] * 30 + [False] * 20))
    assert np.allclose(flat[0], 0) and flat[2] == 0.6
    assert arrays.contour_of(np.array([120.0] * 2), np.array([True] * 2)) is None
    assert arrays.contour_of(np.array([900.0] * 9), np.array([True] * 9)) is None


def test_dct(spark):
    x = np.random.default_rng(1).normal(size=64)
    df = spark.createDataFrame([(x.tolist(),)], "a array<double>").withColumn("c", arrays.dct_encode("a")).withColumn("b", arrays.dct_decode("c"))
    r = df.first()
    m = np.array(arrays.dct_rows())
    assert np.allclose(r["c"], m @ x) and np.allclose(r["b"], m.T @ (m @ x)) and abs(np.mean(r["b"])) < 1e-12
    assert df.select(arrays.array_corr("a", "a")).first()[0] == pytest.approx(1)


def test_filters(spark):
    df = spark.createDataFrame([([0.0] * 10 + [12.0] + [0.0] * 10,)], "a array<double>")
    got = df.select(F.array_max(arrays.median_filter("a", 5)), arrays.moving_average("a", 3), arrays.active_rms("a")).first()
    assert got[0] == 0 and got[1][9] == pytest.approx(4) and got[1][0] == 0 and got[2] == 12
    silent = spark.createDataFrame([([0.0, 0.0], [0.5, -0.5])], "a array<double>, b array<double>")
    assert silent.select(arrays.speech_gain("a", "b"), arrays.speech_gain("b", "b")).first() == (1.0, 1.0)
    mixed = silent.select(arrays.mix_down("b", "b", F.lit(2.0)).alias("m")).first().m
    assert mixed.peak == 1.5 and max(map(abs, mixed.samples)) == pytest.approx(0.99)


@pytest.mark.parametrize("factor", [0.5, 0.67, 0.85, 1.0, 1.25])
@pytest.mark.parametrize("n", [0, 5, 399, 8000])
def test_time_scale(factor, n):
    x = np.sin(np.arange(n) * 2 * np.pi * 200 / 8000)
    y = arrays.time_scaled(x, 8000, factor)
    assert len(y) == round(n * factor)
    if n == 8000:
        crossings = lambda v: ((v[:-1] < 0) & (v[1:] >= 0)).sum() / len(v)
        assert crossings(y[400:-400]) == pytest.approx(crossings(x), rel=0.05)


def test_time_scale_refuses():
    for bad in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            arrays.time_scaled(np.zeros(9), 8000, bad)


def test_spans(spark):
    df = spark.createDataFrame([([(1000, 3000), (9000, 10000)], 20000)], "s array<struct<start:long,end:long>>, n long")
    r = df.select(arrays.voiced_seconds("s", 8000), arrays.tightened_seconds("s", "n", 8000)).first()
    assert r[0] == 3000 / 8000 and r[1] == pytest.approx((400 + 2000 + 2000 + 1000 + 800) / 8000)


def test_white_space_is_blank(spark):
    df = spark.createDataFrame([("\t \n", "x 　\x1f", " y")], "a string, b string, c string")
    row = df.select(text.first_nonblank("a", "b", "c").alias("v"), text.first_nonblank("a").alias("w"), numeric.truth(F.lit("\ttrue\n")).alias("t")).first()
    assert (row.v, row.w, row.t) == ("x", "", True)


def test_word_edits(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    r = random.Random(1)
    some = [f"w{i}" for i in range(12)] + ["é", "a", "😀"]
    rows = [tuple([r.choice(some) for _ in range(r.randrange(20))] for _ in range(2)) for _ in range(200)] + [([f"q{i}" for i in range(2000)], [f"q{i}" for i in range(1, 2000)]), (None, ["a"]), ([], [])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", text_metrics.word_edits(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == edits(x.a or [], x.b or []) for x in got) and len(got) == 203
