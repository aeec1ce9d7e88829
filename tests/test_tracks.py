"""Timelines and recordings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import clusters, timeline, tracks


def test_fill_nearest_against_all_pairs(spark):
    """Segments in any order, overlapping, nested, equal; ties go to the first."""
    rng = np.random.default_rng(7)
    rows = []
    for job in range(12):
        for i in range(int(rng.integers(1, 45))):
            s = float(rng.integers(0, 40))
            rows.append((f"j{job}", int(rng.integers(0, 200)), s, s + float(rng.integers(0, 9 if job % 2 else 30)), int(rng.integers(5)) if rng.random() < 0.6 else None))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += [("j0", 500, None, 3.0, 1), ("j0", 501, 2.0, None, None), (None, 1, 0.0, 1.0, 4), (None, 2, 5.0, 6.0, None)]
    df = spark.createDataFrame(rows, "job string, idx int, s double, e double, l int").repartition(5)
    got = {(r.job, r.idx): r.l for r in timeline.fill_nearest(df, "job", "idx", "s", "e", "l").collect()}
    known = [r for r in rows if r[4] is not None and None not in r[2:4]]
    for job, idx, s, e, l in rows:
        near = min(((max(0.0, y[2] - e, s - y[3]), y[1], y[4]) for y in known if y[0] == job), default=None) if l is None and None not in (s, e) else None
        assert got[job, idx] == (l if near is None else near[2])
    assert len(got) == len(rows)


def numpy_duck(x, segments, rate, under=0.25, bed=0.8, fade=0.15):
    env = np.full(len(x), bed)
    for a, b in segments:
        env[max(0, int(a * rate)) : max(0, int(b * rate))] = under
    width = max(1, int(fade * rate))
    if width > 1 and len(x) > width:
        wide = np.concatenate([np.full(width, env[0]), env, np.full(width, env[-1])])
        low = width - 1 - (width - 1) // 2
        env = np.array([wide[width + i - low : width + i - low + width].mean() for i in range(len(x))])
    return x * env


def whole(track):
    rows = sorted((r.job, r.second, r.samples) for r in track.collect())
    return {j: np.concatenate([s for k, _, s in rows if k == j]) for j in {r[0] for r in rows}}


@pytest.mark.parametrize("rate", [20, 50, 7])
def test_duck_against_numpy(spark, rate):
    rng = np.random.default_rng(rate)
    sounds = {f"j{i}": rng.normal(size=int(n)) for i, n in enumerate([rate * 5, rate * 3 + 4, rate // 2, 1, rate * 9])}
    segments = {"j0": [(0.0, 0.4), (0.3, 1.1), (3.0, 3.2), (4.8, 5.0)], "j1": [(-1.0, 0.5), (2.0, 99.0)], "j2": [(0.1, 0.2)], "j4": [(float(a), float(a + b)) for a, b in zip(rng.uniform(0, 9, 14), rng.uniform(0, 0.6, 14), strict=True)], "other": [(0.0, 1.0)]}
    arrays = spark.createDataFrame([(j, x.tolist()) for j, x in sounds.items()] + [("none", []), ("null", None)], "job string, samples array<double>")
    seg = spark.createDataFrame([(j, *s) for j, ss in segments.items() for s in ss] + [("j3", 0.5, 0.5)], "job string, start double, end double")
    track = tracks.as_track(arrays, "job", "samples", rate)
    assert all(len(r.samples) <= rate for r in track.collect())
    got = whole(tracks.duck(track, seg, rate))
    assert set(got) == set(sounds)
    for j, x in sounds.items():
        assert got[j] == pytest.approx(numpy_duck(x, segments.get(j, []), rate), abs=1e-12)


def test_no_speech_leaves_a_level_bed(spark):
    track = tracks.as_track(spark.createDataFrame([("j", [1.0] * 205)], "job string, samples array<double>"), "job", "samples", 50)
    none = spark.createDataFrame([], "job string, start double, end double")
    assert set(whole(tracks.duck(track, none, 50))["j"]) == {0.8}


@pytest.mark.parametrize(("chunk", "overlap"), [(30, 7), (11, 10), (100, 1), (25, 0), (1000, 100)])
def test_chunks_come_back(spark, chunk, overlap):
    """What a step leaves alone is the same to 1e-12, whatever the chunks; a scale is a scale."""
    rng = np.random.default_rng(chunk)
    sounds = {f"j{i}": rng.normal(size=n) for i, n in enumerate([1, 7, 30, 31, 100, 203])}
    track = tracks.as_track(spark.createDataFrame([(j, x.tolist()) for j, x in sounds.items()], "job string, samples array<double>"), "job", "samples", 20)
    pieces = tracks.chunks(track, 20, chunk, overlap)
    for r in pieces.collect():
        assert len(r.samples) <= chunk + overlap and r.samples == sounds[r.job][r.start : r.start + len(r.samples)].tolist()
    got = whole(tracks.overlap_add(pieces.withColumn("samples", F.transform("samples", lambda v: v * 3.0)), 20, chunk, overlap))
    for j, x in sounds.items():
        assert got[j] == pytest.approx(3 * x, abs=1e-12)


def test_in_chunks_with_a_model(spark):
    """A step in Python, one chunk at a time."""
    x = np.arange(500.0)
    track = tracks.as_track(spark.createDataFrame([("j", x.tolist())], "job string, samples array<double>"), "job", "samples", 50)

    def model(pieces):
        def run(frames):
            for pdf in frames:
                pdf["samples"] = [[-v for v in s] for s in pdf["samples"]]
                yield pdf

        return pieces.mapInPandas(run, pieces.schema)

    assert whole(tracks.in_chunks(track, model, 50, 2.0, 0.1))["j"] == pytest.approx(-x, abs=1e-11)


def test_envelope(spark):
    segments = [(0.1, 0.3), (0.2, 0.5), (0.9, 7.0), (0.6, 0.6), (-1.0, 0.05)]
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in segments],), ([],)], "s array<struct<start:double,end:double>>")
    got = [r[0] for r in df.select(timeline.envelope(F.col("s"), 100, 100)).collect()]
    want = [1.0] * 100
    for a, b in segments:
        for i in range(max(0, int(a * 100)), min(100, int(b * 100))):
            want[i] = 0.25
    assert got == [want, [1.0] * 100]


def test_linkage_of_many(spark):
    """Thousands of segments of planted voices, and equal vectors."""
    rng = np.random.default_rng(1)
    who = rng.integers(0, 9, 2500)
    unit = clusters.to_unit(rng.normal(size=(9, 64))[who] + 0.3 * rng.normal(size=(2500, 64)))
    own = clusters.linked(unit, 0.6)
    assert len(set(zip(who.tolist(), own.tolist(), strict=True))) == 9 == len(set(own.tolist()))
    same = clusters.linked(np.ones((50, 3)) / np.sqrt(3), 0.1)
    assert set(same.tolist()) == {0} and len(clusters.average_tree(np.eye(6))) == 5
