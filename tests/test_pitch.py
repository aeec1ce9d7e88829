"""The pitch tracker on sounds whose pitch is known, its measures, and the edit of a track."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import pitch

RATE = 16_000


def voice(hz, harmonics=5):
    phase = 2 * np.pi * np.cumsum(np.broadcast_to(hz, RATE) if np.ndim(hz) == 0 else hz) / RATE
    return 0.2 * sum(np.sin(k * phase) / k for k in range(1, harmonics + 1))


@pytest.mark.parametrize("hz", [70, 100, 145.3, 220, 333, 500, 900])
@pytest.mark.parametrize("harmonics", [1, 6])
def test_tones(hz, harmonics):
    f0, rms = pitch.tracked(voice(float(hz), harmonics), RATE)
    inner = f0[3:-3]
    assert len(f0) == 1 + RATE // 512 == len(rms) and (inner > 0).all()
    assert np.abs(inner / hz - 1).max() < 0.01


def test_glides_and_silence():
    hz = np.linspace(110, 220, RATE)
    f0, _ = pitch.tracked(np.concatenate([voice(hz), np.zeros(RATE // 2), voice(150.0)]), RATE)
    at = np.arange(len(f0)) * 512
    for i in range(3, len(f0) - 3):
        if 1500 < at[i] < RATE - 1500:
            assert abs(f0[i] / hz[at[i]] - 1) < 0.01
        elif RATE + 1500 < at[i] < 1.5 * RATE - 1500:
            assert f0[i] == 0
        elif 1.5 * RATE + 1500 < at[i]:
            assert abs(f0[i] / 150 - 1) < 0.01


def test_noise_has_no_pitch():
    f0, _ = pitch.tracked(np.random.default_rng(1).normal(0, 0.1, 3 * RATE), RATE)
    assert (f0 > 0).mean() < 0.05


def test_measures(spark):
    sound = np.concatenate([voice(200.0), np.zeros(RATE)])
    rows = [(1, sound.tolist(), "one two  three"), (2, np.zeros(4000).tolist(), ""), (3, None, "x"), (4, [], "x"), (5, [math.nan] * 9, None), (6, [0.1] * 10, None)]
    df = spark.createDataFrame(rows, "k int, s array<double>, text string")
    got = {r.k: r for r in df.select("k", pitch.track("s", F.lit(RATE)).alias("t"), "text").select("k", "t", pitch.prosody("t", "text").alias("p")).collect()}
    p, f0 = got[1].p, np.array([v or 0 for v in got[1].t.f0])
    voiced = f0[f0 > 0]
    st = 12 * np.log2(voiced / 100)
    assert (p.duration, p.n_words, p.speaking_rate, p.n_voiced) == (2.0, 3, 1.5, len(voiced)) and 0.4 < p.voiced_ratio < 0.6
    assert (p.f0_mean_hz, p.f0_median_hz, p.f0_std_hz, p.f0_mean_st, p.f0_std_st) == pytest.approx((voiced.mean(), np.median(voiced), voiced.std(), st.mean(), st.std()))
    assert (p.rms, p.rms_std) == pytest.approx((np.mean(got[1].t.rms), np.std(got[1].t.rms)))
    assert (got[2].p.n_voiced, got[2].p.f0_mean_hz, got[2].p.f0_std_st, got[2].p.speaking_rate, got[2].p.voiced_ratio) == (0, None, None, None, 0.0)
    assert [got[k].p for k in (3, 4, 5)] == [None] * 3 and got[6].p.n_voiced == 0


def test_edits(spark):
    rng = np.random.default_rng(2)
    f0 = np.where(rng.random(80) < 0.7, 150 * 2 ** (np.sin(np.arange(80) / 9) / 6), 0.0)
    on, st = f0 > 0, lambda x: 12 * np.log2(x / 100)
    own = float(np.median(st(f0[on])))
    up = pitch.edited(f0, level=own + 2)
    assert (up[~on] == 0).all() and np.median(st(up[on])) == pytest.approx(own + 2)
    assert np.median(st(pitch.edited(f0, level=own + 9)[on])) == pytest.approx(own + 3)
    assert np.median(st(pitch.edited(f0, level=own + 9, own_level=own + 8)[on])) == pytest.approx(own + 9)
    shape = np.sin(np.linspace(0, 6, 64))
    bent = st(pitch.edited(f0, shape=shape, span=1.2)[on])
    assert bent.std() == pytest.approx(1.2) and np.median(bent) == pytest.approx(own) and np.corrcoef(bent, np.interp(np.linspace(0, 1, 80), np.linspace(0, 1, 64), shape)[on])[0, 1] > 0.99
    assert st(pitch.edited(f0, shape=shape * 1e-3, span=5.0)[on]).std() == pytest.approx(3 * 1e-3 * shape.std(), rel=0.3)
    long = pitch.edited(f0, stretch=1.5)
    assert len(long) == 120 and set(long) <= set(f0) and len(pitch.edited(f0, stretch=9.0)) == 160
    assert pitch.edited(np.full(9, 390.0), level=36.0).max() == 400.0
    assert (pitch.edited(np.array([0, 100.0, 0]), level=9.0) == [0, 100, 0]).all()
    df = spark.createDataFrame([(f0.tolist(), own + 2, None, None, None, None), (None, 1.0, [0.0, 1.0], 1.0, 1.0, 1.0)], "f array<double>, l double, s array<double>, w double, d double, o double")
    got = [r[0] for r in df.select(pitch.edit_f0("f", "l", "s", "w", "d", "o")).collect()]
    assert got[0] == pytest.approx(up.tolist()) and got[1] is None
