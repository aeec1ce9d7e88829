import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import clusters, gate, graph, pairing, resume, selection, summary, systems, timeline
from pairloom.sources import audio, tables
from pairloom.streaming import jobs

FRAGMENTS = "key string, lang_code string, trans_id string, participant_id_unique string, text string"


def test_pairing(spark):
    f = spark.createDataFrame([("EN_001_2.10", "EN", "ES_001_1.10", "s1", "hi"), ("ES_001_1.10", "es", "EN_001_2.10", "s1", "hola"), ("EN_9", "EN", "EN_001_2.10", "s2", "x"), ("EN_8", "en", "ES_8", "s3", "no sound"), ("ES_8", "es", "", "s4", "")], FRAGMENTS)
    sound = spark.createDataFrame([("EN_001_2.10", "/a.wav"), ("ES_001_1.10", "/b.wav"), ("EN_8", "/c.wav")], "audio_id string, path string")
    got = pairing.link_pairs(f, sound).collect()
    assert len(got) == 1
    assert got[0].pair_id == "EN_001_2.10__ES_001_1.10" and got[0].same_speaker_pair and got[0].english_audio == "/a.wav" and got[0].spanish_text == "hola"
    turned = {r.direction: r for r in pairing.result_rows(spark.createDataFrame(got, tables.MANIFEST)).collect()}
    assert turned["es-en"].source_reference_text == "hola" and turned["es-en"].translation_reference == "hi" and turned["en-es"].tts_seed != turned["es-en"].tts_seed


def test_fragments(spark):
    rows = spark.createDataFrame([("a", "", "1"), ("a", "", "1"), ("", "b", "2"), ("", " ", "3")], "id string, audio_id string, v string")
    assert sorted(r.key for r in tables.fragments(rows).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="Conflicting"):
        tables.fragments(rows.union(spark.createDataFrame([("a", "", "9")], rows.schema))).collect()


def test_transcripts(spark, tmp_path):
    lines = spark.createDataFrame([("x/EN_1.wav|AB| hello ",), ("ES_2.wav|VB¡Andale! Okay",), ("EN_1.wav|AB|later|wins",)], "value string").coalesce(1)
    got = {r.audio_id: r for r in tables.transcripts_piped(lines).collect()}
    assert got["EN_1"].text == "later|wins" and got["ES_2"].text == "¡Andale! Okay" and got["ES_2"].repaired and not got["EN_1"].repaired
    with pytest.raises(Exception, match="Expected"):
        tables.transcripts_piped(spark.createDataFrame([("nothing",)], "value string")).collect()
    with pytest.raises(ValueError):
        tables.transcripts_csv(lines)
    m = spark.createDataFrame([("EN_1", "old", "ES_9", "keep")], "english_id string, english_text string, spanish_id string, spanish_text string")
    t = spark.createDataFrame([("EN_1", "")], "audio_id string, text string")
    r = pairing.merge_transcripts(m, t).first()
    assert r.english_text == "" and r.spanish_text == "keep"
    with pytest.raises(Exception, match="Conflicting"):
        pairing.merge_sources(t, spark.createDataFrame([("EN_1", "other")], t.schema)).collect()
    assert pairing.conflicts(t.union(spark.createDataFrame([("EN_1", "other")], t.schema)), "audio_id", "text").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m.csv").write_text("﻿pair_id,same_speaker_pair,english_text\np1,TRUE,\"a, b\"\n", encoding="utf-8")
    r = tables.read_manifest(spark, str(tmp_path / "d" / "m.csv")).first()
    assert r.pair_id == "p1" and r.same_speaker_pair and r.english_text == "a, b" and r.split == ""
    assert tables.read_results(spark, str(tmp_path / "none.csv")).count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = str(tmp_path / "out")
    assert tables.append_new(rows, path, ["k"]).count() == 2
    more = rows.union(spark.createDataFrame([("c", 3)], rows.schema))
    tables.append_new(more, path, ["k"])
    assert spark.read.parquet(path).count() == 3
    assert tables.union_sorted(rows, spark.createDataFrame([(1,)], "a int")).columns == ["a", "k", "v"]
    assert tables.markdown(rows).splitlines()[0] == "| k | v |"
    tables.write_report({"t": rows}, str(tmp_path / "report"), {"by": "test"})
    assert spark.read.text(str(tmp_path / "report" / "t.md")).count() == 4


def test_latex_refuses_long_tables(spark):
    assert len(tables.latex(spark.range(3), most=3).splitlines()) == 6
    with pytest.raises(ValueError):
        tables.latex(spark.range(4), most=3)


def test_sound(spark, tmp_path):
    x = np.sin(np.arange(800) / 9) / 2
    (tmp_path / "EN_1.wav").write_bytes(audio.encode_pcm16(np.stack([x, -x]), 8000))
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    got = {r.path.rsplit("/", 1)[-1]: r for r in audio.read_wav(spark, str(tmp_path)).select("path", "rate", "duration", audio.mono(F.col("channels")).alias("m"), F.size(audio.stereo(F.col("channels"))).alias("n")).collect()}
    assert got["EN_1.wav"].rate == 8000 and got["EN_1.wav"].duration == 0.1 and got["EN_1.wav"].n == 2 and np.allclose(got["EN_1.wav"].m, 0, atol=1e-4)
    assert got["bad.wav"].rate is None
    inv = tables.inventory(spark, str(tmp_path)).first()
    assert inv.wav_count == 2 and inv.english_wav_count == 1
    assert tables.audio_index(tables.files(spark, str(tmp_path), "*.wav")).count() == 2


def test_jobs(spark, tmp_path):
    old = {"job_id": "a", "segments": [{"index": 0, "original_seconds": 2.0, "final_seconds": 1.0, "raw_seconds": 3.0, "status": "ok", "similarity": 0.5}]}
    new = {"job_id": "b", "direction": "en-es", "segments": [{"index": 0, "original_seconds": 1.0, "final_seconds": 1.0, "raw_seconds": 1.0, "status": "error", "speaker": 1}, {"index": 1, "original_seconds": 4.0, "final_seconds": 5.0, "raw_seconds": 6.0, "status": "ok", "clamped": True, "truncated_seconds": 0.2, "speaker": 1}]}
    for j in (old, new, {"job_id": "c"}):
        (tmp_path / f"{j['job_id']}.json").write_text(json.dumps(j, indent=1))
    jobs_ = tables.read_jobs(spark, str(tmp_path))
    got = {r.job_id: r for r in summary.job_totals(jobs_).collect()}
    assert got["a"].final_ratio == 0.5 and got["b"].final_ratio == 1.25 and got["b"].failed == 1 and got["b"].clamped == 1 and got["b"].truncated == 1 and got["c"].final_ratio is None and got["c"].failed == 0
    assert summary.job_speakers(jobs_).where("speaker = 1").first().segments == 2


def test_splits(spark):
    rows = [(f"p{i}_{k}", f"s{i}", f"s{i}") for i in range(10) for k in range(2)] + [("cross", "s0", "s1")]
    pairs = spark.createDataFrame(rows, "pair_id string, english_speaker_id string, spanish_speaker_id string")
    got = graph.assign_splits(pairs)
    split = {r.english_speaker_id: r.split for r in got.collect()}
    assert split["s0"] == split["s1"] and set(split.values()) == {"train", "dev", "test"}
    graph.require_disjoint(got, ["english_speaker_id", "spanish_speaker_id"])
    with pytest.raises(ValueError):
        graph.require_disjoint(got.withColumn("split", F.col("pair_id")), ["english_speaker_id"])
    with pytest.raises(Exception, match="lacks"):
        graph.speaker_components(spark.createDataFrame([("p", "", "x")], pairs.schema)).collect()
    with pytest.raises(ValueError):
        graph.greedy_parts({"a": 1})


def test_components_random(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == {x: top(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gate(spark):
    base = {f"{s}_{f}": 1.0 for s in ("en", "es") for f in tables.SIDE_FIELDS} | {"en_f0_mean_hz": 120.0, "es_f0_mean_hz": 120.0, "pair_id": "a", "split": "train", "same_speaker_pair": True, "en_speaker": "s", "es_speaker": "s", "error": ""}
    rows = [base, base | {"en_f0_mean_hz": 62.0}, base | {"en_f0_mean_hz": 500.0, "es_f0_mean_hz": 20.0}, base | {"es_duration": 0.1}, base | {"error": "x"}, base | {"same_speaker_pair": False}, base | {"en_f0_mean_st": None}]
    df = spark.createDataFrame([tuple(r[f.name] for f in tables.feature_schema().fields) for r in rows], tables.feature_schema())
    kept, stats = gate.gate(df)
    s = stats.first()
    assert kept.count() == 2 and s.rows_kept == 2 and s.failed_f0_implausible == 2 and s.failed_duration == 1 and s.failed_nan_f0 == 1 and s.dropped_extraction_error == 1 and s.near_bound_kept == 1
    assert s.dropped_by_criteria == 3 and s.dropped_quality_gate == 4 and s.different_speaker_pairs == 1
    assert gate.gate(df, False)[0].count() == 3
    assert gate.gate(df.limit(0))[1].first().drop_rate == 0


def test_direction_flip(spark):
    base = {f.name: None for f in tables.feature_schema().fields} | {"pair_id": "a", "en_duration": 1.0, "es_duration": 2.0}
    got = {r.direction: r for r in pairing.directional(spark.createDataFrame([tuple(base[f.name] for f in tables.feature_schema().fields)], tables.feature_schema())).collect()}
    assert got["en-es"].log_dur_ratio == pytest.approx(np.log(2)) and got["es-en"].log_dur_ratio == pytest.approx(-np.log(2)) and got["en-es"].copy_log_dur_ratio == 0


def test_reliability(spark):
    rows = spark.createDataFrame([("ok",), ("failed",)], "status string")
    assert summary.reliability(rows).first().failure_rate == 0.5
    assert summary.reliability(rows.limit(0)).first().failure_rate == 0
    m = spark.createDataFrame([("d", "a", 1.0), ("d", "a", 3.0), ("d", "b", 10.0), ("d", None, float("nan"))], "d string, s string, v double")
    r = summary.two_level_means(m, ["d"], "s", ["v"]).first()
    assert r.group_mean_v == 6 and r.v_groups == 2


def test_decomposition(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 7}", float(x), float(x * 0.5 + y + i % 7)) for i, (x, y) in enumerate(rng.normal(size=(80, 2)))] + [("single", 9.0, -9.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got, keep = summary.decomposition(df, "x", "y", "g").first(), summary.decomposition(df, "x", "y", "g", drop_singletons=False).first()
    x, y, g = (np.array(c) for c in zip(*[(r[1], r[2], r[0]) for r in rows]))
    many = [k for k in np.unique(g) if (g == k).sum() > 1]
    cx = np.concatenate([x[g == k] - x[g == k].mean() for k in many])
    cy = np.concatenate([y[g == k] - y[g == k].mean() for k in many])
    assert got.within_r == pytest.approx(np.corrcoef(cx, cy)[0, 1]) and got.pooled_r == pytest.approx(np.corrcoef(x, y)[0, 1]) and got.n_groups == 7 and keep.n_groups == 8


def test_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = x @ [2, -1.5, 0.25, 3] + 7
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, y double")
    m = systems.Moments(df, ["a", "b", "c", "d"], "y").ridge(1e-8)
    assert np.allclose(m.weights / m.sd, [2, -1.5, 0.25, 3], atol=1e-6)
    worst = df.select(F.max(F.abs(m.column() - F.col("y")))).first()[0]
    assert worst < 1e-5


def test_study(spark):
    rng = np.random.default_rng(1)
    rows = [(("train", "dev", "test")[i % 3], float(a), float(c), float(c + 2 + 3 * a + e)) for i, (a, c, e) in enumerate(rng.normal(size=(300, 3)) * [1, 1, 0.1])]
    df = spark.createDataFrame(rows, "split string, x double, copy double, target double")
    out, model = systems.study(df, ["x"], "copy", "target")
    scores = {r.system: r for r in systems.error_metrics(systems.long_systems(out.where("split = 'test'"), ["target"], ["B0", "B1", "B2", "ridge"]), ["system"], "prediction", "target").collect()}
    assert scores["ridge"].mae < 0.2 < scores["B2"].mae < scores["B0"].mae and model.penalty <= 10
    same = systems.equivalent(out.withColumn("again", F.col("B2")), ["split"], "B2", "again").collect()
    assert all(r.equivalent for r in same)


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "i int, p double")
    got = [r.holm for r in systems.holm(df).orderBy("i").collect()]
    assert got[:3] == pytest.approx([0.03, 0.06, 0.06]) and got[3] is None


def test_cluster_inference(spark):
    rows = [(f"s{i % 8}", 1.0 + i % 8 / 10, 2.0 + i % 8 / 9) for i in range(80)]
    got = systems.clustered(spark.createDataFrame(rows, "c string, e double, b double"), "c", "e", "b")
    assert got["n_clusters"] == 8 and got["p"] == pytest.approx(2 / 2**8) and got["ci_high"] < 0 and got["excludes_zero"]


def test_windows(spark):
    seg = spark.createDataFrame([("j", 0, 0.0, 1.0, 1, 10.0), ("j", 1, 1.05, 2.0, 1, 10.0), ("j", 2, 4.0, 5.0, 2, 10.0), ("j", 3, 9.9, 9.95, 2, 10.0)], "job string, idx int, start double, end double, label int, total double")
    got = timeline.line_windows(seg).orderBy("idx").collect()
    assert [round(r.window, 6) for r in got] == [0.95, 1.25, 1.3, 0.3] and [round(r.deadline, 6) for r in got] == [0.95, 2.3, 5.3, 10.0]
    assert all(a.deadline <= b.start for a, b in zip(got, got[1:]))
    assert spark.range(1).select(timeline.dropped_seconds(F.lit(3.0), F.lit(8.0), F.lit(10.0))).first()[0] == 1.0


def test_voices():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=64), rng.normal(size=64)
    voice = lambda v: v + rng.normal(size=64) * 0.3
    assert clusters.cluster_voices([voice(a), voice(b), voice(a), voice(b)], [3.0] * 4) == [0, 1, 0, 1]
    assert clusters.cluster_voices([voice(a) for _ in range(5)], [3.0] * 5) == [0] * 5
    # by the job's own rule 3 of 9.3 seconds are a voice, by the fixed 4 seconds they are not
    four, seconds, starts = [voice(a), None, voice(b), voice(a)], [3.0, 0.3, 3.0, 3.0], [0, 3.1, 8, 12]
    assert clusters.cluster_voices(four, seconds, starts, speaker_s=clusters.job_speaker_seconds(seconds)) == [0, 0, 1, 0]
    assert clusters.cluster_voices(four, seconds, starts) == [0, 0, 0, 0]
    assert len(set(clusters.cluster_voices([voice(a) for _ in range(4)], [3.0] * 4, speakers=2))) == 2
    assert clusters.cluster_voices([], []) == [] and clusters.cluster_voices([None, None], [1.0, 1.0]) == [0, 0]
    # a short outlier without enough speech joins a group, and a quiet group folds into its nearest
    assert clusters.cluster_voices([voice(a), voice(a), voice(b)], [5.0, 5.0, 1.0]) == [0, 0, 0]


def test_voice_cases():
    rng = np.random.default_rng(11)

    def say(k, n, noise=0.75):
        return [np.eye(64)[k] + noise * rng.standard_normal(64) / 8 for _ in range(n)]

    a, b, c = say(0, 6), say(1, 6), say(2, 3)
    assert clusters.cluster_voices(a[:5] + b[:5] + [a[5], b[5]], [3.0] * 10 + [0.6, 0.6]) == [0] * 5 + [1] * 5 + [0, 1]
    # a voice that only ever says short things is one of its own if they add up
    assert clusters.cluster_voices(a + b + c, [3.0] * 12 + [1.4] * 3, speaker_s=4.0) == [0] * 6 + [1] * 6 + [2] * 3
    assert set(clusters.cluster_voices(a + b + c, [3.0] * 12 + [0.4] * 3, speaker_s=4.0)) == {0, 1}
    # two tight halves that average linkage to a wide distance has joined are split
    assert clusters.cluster_voices(say(0, 4, 0.3) + say(1, 4, 0.3), [3.0] * 8, distance=1.5) == [0] * 4 + [1] * 4
    # without a vector: the segment nearest in time, by gaps
    got = clusters.cluster_voices([*a[:3], None, *b[:3]], [2.5, 6.0, 8.0, 0.35, 3.5, 3.0, 3.0], [0.0, 3.0, 10.5, 18.5, 21.5, 25.5, 29.0])
    assert got[3] == got[2] != got[4]
    assert len(set(clusters.cluster_voices(a, [3.0] * 6, speakers=9))) == 6
    with pytest.raises(ValueError, match="at most"):
        clusters.cluster_voices([None] * 10_001, [1.0] * 10_001)


def brute_linkage(unit, distance, most):
    sets = [[i] for i in range(len(unit))]
    while len(sets) > most:
        far = {(x, y): 1 - np.mean([unit[i] @ unit[j] for i in sets[x] for j in sets[y]]) for x in range(len(sets)) for y in range(x)}
        (x, y), d = min(far.items(), key=lambda p: p[1])
        if distance is not None and d > distance:
            break
        sets[y] += sets.pop(x)
    return {frozenset(s) for s in sets}


def test_linkage_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        unit = clusters.to_unit(rng.normal(size=(int(rng.integers(1, 14)), 6)))
        for distance, most in ((0.75, 1), (0.9, 1), (None, 3)):
            own = clusters.linked(unit, distance, most)
            assert {frozenset(np.flatnonzero(own == k).tolist()) for k in set(own.tolist())} == brute_linkage(unit, distance, most)


def test_voices_by_job(spark):
    """Each job's own speech sets the least of a voice, and its rows may be many and repeated."""
    rng = np.random.default_rng(3)
    say = lambda k: (np.eye(16)[k] + 0.05 * rng.standard_normal(16)).tolist()
    rows = [(1, i, say(k), s, 9.0 * i) for i, (k, s) in enumerate([(0, 3.0), (1, 3.0), (0, 3.0)])] + [(2, i, say(k), s, 9.0 * i) for i, (k, s) in enumerate([(0, 9.0), (1, 3.0), (0, 9.0)])]
    df = spark.createDataFrame(rows, "job long, idx long, embedding array<double>, seconds double, start double")
    got = {(r.job, r.idx): r.label for r in clusters.cluster_jobs(df).collect()}
    assert [got[1, i] for i in range(3)] == [0, 1, 0] and [got[2, i] for i in range(3)] == [0, 0, 0]
    assert clusters.cluster_jobs(df.limit(0)).count() == 0


def test_nearest_centroids(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, -2.0])], "k int, v array<double>")
    c = spark.createDataFrame([("b", [2.0, 0.0]), ("a", [0.0, 3.0]), ("z", [0.0, 0.0]), ("n", None)], "l string, c array<double>")
    got = {r.k: (r.label_near, r.similarity and round(r.similarity, 6)) for r in clusters.nearest_centroid(v, c, "k", "v", "l", "c").collect()}
    assert got == {1: ("b", 1.0), 2: ("a", 0.707107), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("b", -0.447214)}
    assert {r.label_near for r in clusters.nearest_centroid(v, c.limit(0), "k", "v", "l", "c").collect()} == {None}


def test_fill_nearest_keeps_rows(spark):
    rows = [("j", 0, 0.0, 1.0, 7), ("j", 1, 1.5, 2.0, None), ("j", 1, 1.5, 2.0, None), ("j", 2, 2.6, 4.0, 8), ("k", 0, 0.0, 1.0, None)]
    got = timeline.fill_nearest(spark.createDataFrame(rows, "job string, idx int, s double, e double, l int"), "job", "idx", "s", "e", "l").collect()
    assert sorted((r.job, r.idx, r.l) for r in got if r.l is not None) == [("j", 0, 7), ("j", 1, 7), ("j", 1, 7), ("j", 2, 8)] and len(got) == 5


def test_resume(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, "ok"), (2, "failed")], "k int, status string")
    assert sorted(r.k for r in resume.pending(todo, done, ["k"], F.col("status") != "ok").collect()) == [2, 3]
    assert sorted(r.k for r in resume.pending(todo, done, ["k"]).collect()) == [3]
    new = spark.createDataFrame([(2, "ok"), (3, "ok")], done.schema)
    assert {r.k: r.status for r in resume.upsert(done, new, ["k"]).collect()} == {1: "ok", 2: "ok", 3: "ok"}


def test_slot(spark):
    def call(model, row):
        if row["text"] == "bad":
            raise RuntimeError("x" * 2000)
        return {"text_out": row["text"].upper() + model}

    slot = resume.Slot("shout", "text_out string", lambda: "!", call, most=20)
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a")], "id int, text string")
    got = {r.id: r for r in slot.run(df, ["text"], ["id"], distinct=True).collect()}
    assert got[1].text_out == "A!" and got[3].text_out == "A!" and got[2].text_out is None and got[2].error_stage == "shout" and len(got[2].error_message) == 20


def test_selection(spark):
    takes = spark.createDataFrame([(1, 0, True, 0.0, 1.0), (1, 1, False, 0.111, 9.0), (1, 2, False, 0.112, 3.0)], "line int, attempt int, runaway boolean, cer double, seconds double")
    assert selection.best_take(takes, ["line"], "runaway", "cer", "seconds", "attempt").first().attempt == 2
    c = spark.createDataFrame([(1, "I do not like this at all.", -0.1), (1, "I do not like it.", -0.2), (1, "I like it.", -0.15), (1, "Not.", -0.25), (1, "I do not.", -0.9)], "line int, text string, score double").withColumn("current", F.lit("I really do not like this at all.")).withColumn("room", F.lit(15))
    good = selection.eligible(c, ["line"], "text", "score", "current", "en")
    assert sorted(r.text for r in good.collect()) == ["I do not like it.", "I do not like this at all.", "Not."]
    assert selection.pick_shorter(good, ["line"], "text", "score", "room").first().text == "I do not like it."
    assert selection.pick_shorter(good, ["line"], "text", "score").first().text == "Not."
    pieces = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "line int, pos int, text string")
    assert selection.rejoin(pieces, ["line"], "pos", "text").first().text == "a b"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path, out = str(tmp_path / "in"), "streamed"
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    stream = jobs.event_stream(spark, path, events.schema, "*.parquet", files=100)
    q = jobs.windowed(stream, "ts", ["event_type"], "value").writeStream.format("memory").queryName(out).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    row = lambda r: (r.window_start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(row, spark.table(out).collect())) == sorted(map(row, jobs.windowed(events, "ts", ["event_type"], "value").collect()))


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    work = lambda df: df.withColumn("status", F.when(F.col("k") % 2 == 0, "ok").otherwise("failed"))
    for batch in ([1, 2], [2, 1, 3]):
        spark.createDataFrame([(k,) for k in batch], "k int").coalesce(1).write.mode("append").parquet(src)
        jobs.process_into(jobs.event_stream(spark, src, spark.read.parquet(src).schema, "*.parquet"), out, str(tmp_path / "ckpt"), ["k"], work).awaitTermination()
    got = sorted((r.k, r.status) for r in spark.read.parquet(out).collect())
    assert got == [(1, "failed"), (1, "failed"), (2, "ok"), (3, "failed")]
    assert jobs.latest(spark.read.parquet(out), ["k"]).count() == 3


def test_join_sums(spark):
    """Hot and cold keys alike get their sums; keys without a row in sums go."""
    from pairloom.operators import hot

    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 64), (3, 65), (4, 1), (None, 3)) for i in range(n)], "k long, i long")
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k is null or k <> 4")
    got = hot.join_sums(rows, sums, "k", "n", 633).groupBy("k", "n").count().collect()
    assert sorted(map(tuple, got)) == [(1, 500, 500), (2, 64, 64), (3, 65, 65)]
    assert hot.hot_above(10**12) == 10**8 and hot.join_sums(rows.limit(0), sums.limit(0), "k", "n", 0).count() == 0


def test_components_of_stars_and_chains(spark):
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (2000, None), (None, 2001)] + [(7, 0)] * 3
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1101)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links(spark, monkeypatch):
    """Few links take few tasks, whatever the number of shuffle partitions, and the same components as links dealt out."""
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    rng = random.Random(8)
    links = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(x, 7) for x in range(400, 600)], "a long, b long").coalesce(1)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-links", "")
        few = sorted(map(tuple, graph.components(links).collect()))
        spark.sparkContext.setJobGroup("others", "")
        track = spark.sparkContext.statusTracker()
        stages = {k for j in track.getJobIdsForGroup("few-links") for k in track.getJobInfo(j).stageIds}
        assert sum(i.numCompletedTasks for k in stages if (i := track.getStageInfo(k))) < 5 * 97
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    monkeypatch.setattr(graph, "FEW_LINKS", 0)
    assert sorted(map(tuple, graph.components(links).collect())) == few


def test_effects_on_a_limit(spark, tmp_path):
    """Means that lie on a limit to within rounding: sums go row by row, as in the SQL with one thread, in however many parts the
    table is read."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pairloom.plans import study

    n, draw = 40 * 300, np.random.default_rng(3)
    cents = np.stack([draw.permutation(np.repeat([3, 4, 5, 6, 7], 60)) for _ in range(40)], axis=1).ravel()  # of each supplier's 300 rows the mean is 0.05
    lines = pa.table({"l_suppkey": np.arange(n) % 40, "l_discount": cents / 100, "l_tax": (cents - 1) / 100})
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(8):
        pq.write_table(lines.slice(i * n // 8, n // 8), tmp_path / f"lineitem.parquet/part-{i}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.sql(study.ORACLES["agg_effects"]).fetchall())
    assert len({x[1] for x in want}) > 1
    assert sorted(map(tuple, study.QUERIES["agg_effects"](spark, str(tmp_path)).collect())) == want
