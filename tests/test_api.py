import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import registry
from pairloom.operators import network, summary
from pairloom.plans import api, study
from pairloom.sources import audio, tables


def test_commands(spark, tmp_path):
    root = tmp_path / "corpus"
    root.mkdir()
    rows = ["id,participant_id,lang_code,trans_id,text"]
    for i in range(8):
        rows += [f"EN_{i},s{i},EN,ES_{i},hello {i}", f"ES_{i},s{i},ES,EN_{i},hola {i}"]
    (root / "fragments-short.csv").write_text("\n".join(rows))
    for i in range(8):
        for lang in ("EN", "ES"):
            (root / f"{lang}_{i}.wav").write_bytes(audio.encode_pcm16(np.zeros(80), 8000))
    manifest = api.split_manifest(api.build_manifest(spark, str(root)))
    assert manifest.count() == 8 and {r.split for r in manifest.collect()} == {"train", "dev", "test"}
    (root / "t.txt").write_text("EN_0.wav|AB|new words\n")
    merged = api.merge_transcripts(spark, manifest, str(root / "t.txt"))
    assert merged.where("english_text = 'new words'").count() == 1
    tables.write_manifest(merged, str(root / "m"))
    assert tables.read_manifest(spark, str(root / "m")).count() == 8
    left = api.todo(spark, merged, str(root / "none.csv"))
    assert left.count() == 16 and api.todo(spark, merged, str(root / "none.csv"), limit=3).count() == 6
    done = left.where("direction = 'en-es'").limit(4).select("*", F.lit("ok").alias("status"), F.col("source_reference_text").alias("asr_text"), F.col("translation_reference").alias("translated_text"), F.lit("").alias("tts_asr_text"), F.lit("0.5").alias("asr_wer"))
    done.write.csv(str(root / "results.csv"), header=True)
    assert api.todo(spark, merged, str(root / "results.csv")).count() == 12
    got = api.summarize(spark, str(root / "results.csv")).first()
    assert got.attempted == 4 and got.corpus_asr_wer == 0 and got.corpus_tts_wer == 1 and got.tts_empty_count == 4 and got.corpus_chrf == pytest.approx(100) and got.mean_asr_wer == 0.5
    with pytest.raises(FileNotFoundError):
        api.build_manifest(spark, str(tmp_path / "corpus" / "m"))


def test_report(spark):
    out = api.report(study._features(spark, "/root/testdata/sf0.001"))
    assert out["T1_gate"].first().rows_kept > 0 and out["T3_corpus"].count() == 4
    rows = {(r.direction, r.target, r.system): r for r in out["T4_results"].collect()}
    # copying predicts no change of duration, so the train mean and the offset copy agree
    assert rows["en-es", "log_dur_ratio", "B1"].mae == pytest.approx(rows["en-es", "log_dur_ratio", "B2"].mae)
    assert rows["en-es", "f0_mean_st", "ridge"].mae <= rows["en-es", "f0_mean_st", "B2"].mae * 1.05


def test_leakcheck(spark):
    mt = spark.createDataFrame([("a", "en-es", "9", 0), ("a", "en-es", "4", 1), ("b", "en-es", "5", 0), ("c", "en-es", "8", 0), ("d", "en-es", "3", 0), ("e", "en-es", " ", 0)], "pair_id string, direction string, mt_words string, line int")
    say = lambda n: " ".join(["w"] * n)
    syn = spark.createDataFrame([(" a ", "", say(4), say(5)), ("", "b", say(6), say(5)), ("c", "", say(8), say(8)), ("d", "", "\t ", say(3)), ("e", "", say(1), say(1)), ("x", "", "a", "a")], "sample_id string, pair_id string, translated_text string, translation_reference string").withColumn("direction", F.lit("en-es"))
    from pairloom.operators import pairing

    rows = {r.pair_id: (r.mt_words, r.pipeline_words, r.human_words) for r in pairing.leak_check(mt, syn, "line").collect()}
    assert rows == {"a": (4, 4, 5), "b": (5, 6, 5), "c": (8, 8, 8)}
    got = api.leakcheck(mt.where("line = 1 or pair_id <> 'a'"), syn).first()
    assert got.n == 3 and got.mt_vs_pipeline_mae_words == got.mt_vs_human_mae_words == pytest.approx(1 / 3) and got.mt_vs_pipeline_r == pytest.approx(np.corrcoef([4, 5, 8], [4, 6, 8])[0, 1])
    with pytest.raises(Exception, match="no overlapping"):
        api.leakcheck(mt.limit(0), syn).collect()
    seen = syn.withColumns({"asr_text": F.lit("one two"), "k": F.lit(1)}).unionByName(syn.withColumns({"asr_text": F.lit("three"), "k": F.lit(2)}))
    assert {r.pair_id: (r.asr_words, r.mt_words) for r in pairing.deploy_lookup(seen, "en-es", "k").collect()} == {"a": (1, 4), "b": (1, 6), "c": (1, 8), "e": (1, 1), "x": (1, 1)}


def test_network(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = np.tanh(x[:, :1]) + 0.5 * x[:, 1:2]
    fresh = network.Network(3, 8, 1, 0)
    assert not fresh(x).any() and fresh.parameters() == 3 * 8 + 8 + 8 + 1
    rows = spark.createDataFrame([("d", "train" if i < 200 else "dev", v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(x, y))], "k string, split string, x array<double>, y array<double>")
    made = network.train_all(rows, "k", "x", "y", [1, 2], hidden=8).collect()
    assert sorted(r.seed for r in made) == [1, 2] and max(r.best_loss for r in made) < 0.05
    nets = [network.restored(r.weights, 3, 1) for r in made]
    out = rows.withColumn("b", F.array(F.lit(1.0))).select("y", network.ensemble("x", nets, "b", [1.0]).alias("p")).collect()
    assert np.mean([abs(r.p[0] - 1 - r.y[0]) for r in out]) < 0.2
    assert network.mean_loss([(1.0, 1), (2.0, 3)]) == 1.75 and network.mean_loss([]) is None


def test_ladder(spark):
    rows = [("d", arm, f"s{i % 3}", float(i), float(i + k), 1.0, 2.0, 0.5, 2.0, 1.0) for k, arm in enumerate(("a", "b")) for i in range(9)]
    df = spark.createDataFrame(rows, "direction string, arm string, speaker string, got double, want double, s1 double, s2 double, shape double, sec double, target double")
    got = {r.arm: r for r in summary.ladder(df, ["direction"], "arm", "got", "want", ("s1", "s2"), "shape", ("sec", "target"), "speaker").collect()}
    assert got["b"].level_mae == 1 and got["a"].r_within == pytest.approx(1) and got["a"].n_speakers == 3 and got["a"].duration_ratio == 2
    gain = summary.share_of_gain(spark.createDataFrame([("d", "S0", 2.0), ("d", "S1", 3.0), ("d", "S3", 1.0), ("d", "net", 1.5)], "d string, arm string, v double"), ["d"], "arm", "v", ["S0", "S1"], "S3")
    assert {r.arm: r.share_of_gain for r in gain.collect()} == {"S0": 0, "S1": -1, "S3": 1, "net": 0.5}


def test_registry(spark):
    assert registry.register(spark) == ["contour", "plain_nfkd", "word_edits"]
    registry.views(spark, "/root/testdata/sf0.001", "documents")
    row = spark.sql("SELECT plain_nfkd('¡Él, ﬁn!') AS p, word_edits(array('a', 'b'), array('b')) AS e, (SELECT count(*) FROM documents) AS n").first()
    assert row.p == "el fin" and row.e == 1 and row.n == 200
