"""The extended study against NumPy: inputs, deployed arms, judgement with both families, shapes, and the whole command."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays
from pairloom.operators import extended, inference, pairing
from pairloom.plans import api

SCALARS = "s_f0_mean_st double, s_f0_std_st double, s_log_dur double, s_voiced_ratio double, s_n_words double, s_speaking_rate double, s_duration double"


def frame(spark, n: int = 160, seed: int = 5):
    """Both directions; the targets follow the words' ratio and a coefficient of the contour, which T1 doesn't have."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        direction = ("en-es", "es-en")[i % 2]
        split = "test" if i % 16 < 4 else "dev" if i % 16 < 7 else "train"
        f, words, mt = rng.normal(size=4).tolist(), float(rng.integers(3, 30)), int(rng.integers(3, 30))
        shape = rng.normal(size=64)
        dct = np.array(arrays.dct_rows()) @ shape
        t = [float(v) for v in (f[0] + 3 * np.log((mt + 1) / (words + 1)), f[1] + dct[0], rng.normal() * 0.1)]
        t_shape = shape + rng.normal(size=64)
        net = [*t, 0.0, *(np.array(arrays.dct_rows()) @ t_shape)]
        rows.append((f"p{i}", direction, split, f"s{i % 12}", *f, words, words / 2, 2.0, f[0], f[1], 0.0, *t, mt, shape.tolist(), t_shape.tolist(), [float(v) for v in net], float(words + 1) if i % 3 else None, mt - 1))
    schema = f"pair_id string, direction string, split string, speaker string, {SCALARS}, copy_f0_mean_st double, copy_f0_std_st double, copy_log_dur_ratio double, target_f0_mean_st double, target_f0_std_st double, target_log_dur_ratio double, words_said int, s_shape array<double>, t_shape array<double>, net array<double>, asr_words double, mt_asr_words int"
    return spark.createDataFrame(rows, schema)


def test_inputs(spark):
    df = frame(spark, 8)
    odd = df.limit(1).withColumns({"pair_id": F.lit("odd"), "s_shape": F.array(F.lit(1.0)), "words_said": F.lit(None).cast("int")})
    got = extended.with_full(df.unionByName(odd), "words_said").collect()
    for r in got:
        if r.pair_id == "odd":
            assert r.mt_words is None and r.log_word_ratio is None and r.s_dct_1 is None
            continue
        assert r.log_word_ratio == pytest.approx(np.log((r.words_said + 1) / (r.s_n_words + 1)))
        assert [r[c] for c in extended.DCT_INPUTS] == pytest.approx((np.array(arrays.dct_rows()) @ r.s_shape).tolist())
    assert len(extended.FEATURES_FULL) == 16 and len(api.FEATURE_SETS["full"]) == 16


def test_deployed(spark):
    df = extended.with_full(frame(spark, 12), "words_said")
    lacking = df.withColumns({"direction": F.lit("none"), "asr_words": F.lit(None).cast("double")})
    got = extended.with_deployed(df.unionByName(lacking), ["direction"]).collect()
    names = [*pairing.FEATURES_T1, *extended.WORD_INPUTS]
    for r in got:
        gold = [r[n] for n in names]
        if r.direction == "none":
            assert r.deployed is None and not r.from_deploy
        elif r.asr_words is None:
            assert not r.from_deploy and r.deployed == gold
        else:
            want = [*gold[:4], r.asr_words, r.asr_words / 2.0, float(r.mt_asr_words), np.log((r.mt_asr_words + 1) / (r.asr_words + 1))]
            assert r.from_deploy and r.deployed == pytest.approx(want)
    share = {r.direction: (r.rows, r.coverage) for r in extended.coverage(extended.with_deployed(df, ["direction"]), ["direction"]).collect()}
    assert share == {"en-es": (6, pytest.approx(4 / 6)), "es-en": (6, pytest.approx(4 / 6))}


def test_judged_against_numpy(spark):
    rng = np.random.default_rng(8)
    n = 90
    truth = rng.normal(size=n)
    arms = {"B2": truth + rng.normal(size=n), "good": truth + rng.normal(size=n) * 0.2, "weak": truth + rng.normal(size=n) * 0.9, "twin": None}
    arms["twin"] = arms["B2"] * (1 + 1e-12)
    rows = [("k", f"s{i % 9}", float(truth[i]), *[float(arms[a][i]) if (a, i) != ("weak", 4) else None for a in arms]) for i in range(n)]
    rows += [("k", "s1", None, 1.0, 1.0, 1.0, 1.0), ("k", "s1", 1.0, None, 1.0, 1.0, 1.0), ("k", "s1", float("nan"), 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, speaker string, truth double, B2 double, good double, weak double, twin double")
    table = extended.judged(df, ["k"], list(arms), "truth", "speaker", primary=("good", "twin"), draws=300)
    got = {r.system: r for r in table.collect()}
    base = np.abs(arms["B2"] - truth)
    for name, p in arms.items():
        fine = np.array([(name, i) != ("weak", 4) for i in range(n)])
        e, r = np.abs(p - truth)[fine], got[name]
        assert r.n == fine.sum() and r.mae == pytest.approx(e.mean()) and r.medae == pytest.approx(np.median(e)) and r.rmse == pytest.approx(np.sqrt((e**2).mean()))
        assert r.pearson_r == pytest.approx(np.corrcoef(p[fine], truth[fine])[0, 1])
        assert r.mae_vs_B2_pct == pytest.approx(100 * (e.mean() - base.mean()) / base.mean(), abs=0.006)
        assert r.is_primary == (name in ("good", "twin"))
    assert got["B2"].p is None and got["B2"].p_rows is None and got["B2"].equivalent is None and got["B2"].holm_all is None
    assert got["twin"].equivalent and got["twin"].p == got["twin"].p_rows == got["twin"].holm_all == got["twin"].holm_primary == 1.0
    assert not got["good"].equivalent and got["good"].excludes_zero and got["good"].ci_high < 0 and got["good"].n_clusters == 9
    # nine speakers, all better: the exact test's least p
    assert got["good"].p == pytest.approx(2 / 2**9) and got["good"].p_rows < 1e-6
    assert got["good"].holm_all == pytest.approx(min(1, 3 * got["good"].p)) and got["good"].holm_primary == pytest.approx(2 * got["good"].p) and got["weak"].holm_primary is None
    assert got["weak"].holm_all == pytest.approx(max(got["good"].holm_all, min(1, 2 * got["weak"].p)))
    rows = df.withColumn("d", F.abs(F.col("weak") - F.col("truth")) - F.abs(F.col("B2") - F.col("truth")))
    assert got["weak"].p_rows == pytest.approx(inference.signed_ranks(rows, ["k"], "d").first().p)
    size = extended.families(table).first()
    assert (size.family_size, size.family_size_all) == (2, 3)


def test_twin_of_a_baseline_that_is_all_but_right(spark):
    """One error of the baseline is so small that the twin's rounding is large beside it: the errors differ, the predictions
    don't, and p is 1."""
    rows = [(f"s{i % 9}", 3e4 + i, 3e4 + i + (0.05 if i == 7 else 10.0 + i)) for i in range(90)]
    df = spark.createDataFrame(rows, "speaker string, truth double, B2 double").withColumns({"k": F.lit("k"), "twin": F.col("B2") + 1e-7, "other": F.col("B2") + 0.5})
    got = {r.system: r for r in extended.judged(df, ["k"], ["B2", "twin", "other"], "truth", "speaker", draws=50).collect()}
    assert not got["twin"].equivalent and got["twin"].p == got["twin"].p_rows == got["twin"].holm_all == 1.0
    assert not got["other"].equivalent and got["other"].p < 0.01 and "_alike" not in got["twin"].asDict()


def test_shapes(spark):
    rng = np.random.default_rng(1)
    t, p = rng.normal(size=(7, 64)), rng.normal(size=(7, 64))
    rows = [("a", t[i].tolist(), p[i].tolist() if i else [2.0] * 64) for i in range(7)] + [("b", [0.0] * 64, p[0].tolist()), ("a", None, None)]
    df = spark.createDataFrame(rows, "k string, t array<double>, p array<double>")
    got = {(r.k, r.system): r for r in extended.shape_scores(df, ["k"], {"arm": "p", "self": "t"}, "t").collect()}
    r = [np.corrcoef(t[i], p[i])[0, 1] for i in range(1, 7)]
    assert got["a", "arm"].n == 6 and got["a", "arm"].shape_r_mean == pytest.approx(np.mean(r)) and got["a", "arm"].shape_r_median == pytest.approx(np.median(r))
    assert got["a", "self"].shape_r_mean == pytest.approx(1) and got["b", "arm"].n == 0 and got["b", "arm"].shape_r_mean is None


def test_extended_study(spark):
    df = extended.with_full(frame(spark), "words_said")
    df = df.withColumn("net_deploy", F.when(F.col("direction") == "en-es", F.col("net")))
    out = api.extended_study(df, ("net", "net_deploy"), draws=200)
    table = {(r.direction, r.target, r.system): r for r in out["table"].collect()}
    systems = {"B0", "B1", "B2", "ridge_t0", "ridge_t1", "ridge_full", "net", "net_deploy"}
    assert {k[2] for k in table if k[0] == "en-es"} == systems and {k[2] for k in table if k[0] == "es-en"} == systems - {"net_deploy"}
    for direction in ("en-es", "es-en"):
        for target in ("f0_mean_st", "f0_std_st"):
            # what the full set alone has makes the target; the network is given it
            assert table[direction, target, "ridge_full"].mae < 0.35 * table[direction, target, "ridge_t0"].mae
            assert table[direction, target, "net"].mae == pytest.approx(0, abs=1e-9)
    size = out["families"].first()
    assert size.family_size == 6 and size.family_size_all == 3 * (6 + 7)
    shape = {(r.direction, r.system): r.shape_r_mean for r in out["shape"].collect()}
    assert 0.5 < shape["en-es", "B0"] < 0.9 and shape["en-es", "net"] == shape["en-es", "net_deploy"] and set(shape) >= {("es-en", "B2"), ("es-en", "net")}
    with pytest.raises(ValueError, match="no direction"):
        api.extended_study(df.where("split <> 'test'"))
