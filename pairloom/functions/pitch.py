"""Pitch of sounds: a tracker, the measures of a track, and the edit of a track.

The tracker compares each frame with itself some samples later: the normalised difference has minima at the period and its
multiples. A frame's deepest minima are its candidates, no voice is one more; the path through all frames that costs least
wins, where a deep minimum costs little and a jump in pitch or voicing costs more. Frames go in blocks, so memory follows
the block and not the sound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import array_mean
from .numeric import F0_HIGH, F0_LOW, col, let
from .text import word_count

#: The band that is searched, Hz; samples of a frame and between frames.
SEARCH_LOW, SEARCH_HIGH, FRAME, HOP = 65.0, 1000.0, 2048, 512
#: Candidates of a frame; what no voice costs, a semitone's jump (up to an octave), and a change of voicing; below this
#: level, relative to a full scale of 1, a frame is silent.
CANDIDATES, UNVOICED, JUMP, SWITCH, SILENT = 6, 0.35, 0.01, 0.08, 1e-4
#: Added to a candidate's cost for each octave below the top of the band: a multiple of a period is as deep as the period.
LOWER = 0.03
BLOCK = 1_000

TRACK = T.StructType([T.StructField("f0", T.ArrayType(T.DoubleType())), T.StructField("rms", T.ArrayType(T.DoubleType())), T.StructField("duration", T.DoubleType())])


def differences(frames: np.ndarray, longest: int) -> np.ndarray:
    """The difference of each frame with itself 0 to `longest` samples later, over its cumulative mean."""
    width = frames.shape[1] - longest
    size = 1 << (frames.shape[1] + width - 1).bit_length()
    both = np.fft.irfft(np.fft.rfft(frames, size) * np.conj(np.fft.rfft(frames[:, :width], size)), size)[:, : longest + 1]
    squares = np.concatenate([np.zeros((len(frames), 1)), np.cumsum(frames**2, 1)], 1)
    energy = squares[:, width : width + longest + 1] - squares[:, : longest + 1]
    d = np.maximum(energy[:, :1] + energy - 2 * both, 0)
    mean = np.cumsum(d[:, 1:], 1) / np.arange(1, longest + 1)
    return np.concatenate([np.ones((len(frames), 1)), np.divide(d[:, 1:], mean, out=np.ones_like(mean), where=mean > 0)], 1)


def candidates(d: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and cost of each frame's deepest minima; cost is infinite where there are fewer."""
    low = max(2, int(rate / SEARCH_HIGH))
    mid, left, right = d[:, low:-1], d[:, low - 1 : -2], d[:, low + 1 :]
    bend = left - 2 * mid + right
    # the place and depth of the parabola through the three: between samples a short period's minimum is deeper
    shift = np.clip(np.divide(0.5 * (left - right), bend, out=np.zeros_like(bend), where=bend > 0), -1, 1)
    depth = np.where((mid < left) & (mid <= right), np.maximum(mid - 0.25 * (left - right) * shift, 0), np.inf)
    hz = rate / (np.arange(low, low + mid.shape[1]) + shift)
    cost = depth + LOWER * np.log2(SEARCH_HIGH / hz)
    k = min(CANDIDATES, cost.shape[1])
    best = np.argpartition(cost, k - 1, 1)[:, :k]
    return np.take_along_axis(hz, best, 1), np.take_along_axis(cost, best, 1)


def best_path(hz: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The frequency of each frame on the cheapest path, 0 where it has no voice."""
    n, k = hz.shape
    pitch = 12 * np.log2(hz)
    total = np.append(cost[0], UNVOICED)
    back = np.zeros((n, k + 1), np.int32)
    move = np.full((k + 1, k + 1), SWITCH)
    move[k, k] = 0.0
    for i in range(1, n):
        move[:k, :k] = JUMP * np.minimum(np.abs(pitch[i - 1][:, None] - pitch[i][None, :]), 12) * 3
        ways = total[:, None] + move
        back[i] = ways.argmin(0)
        total = ways[back[i], np.arange(k + 1)] + np.append(cost[i], UNVOICED)
    out = np.zeros(n)
    at = int(total.argmin())
    for i in range(n - 1, -1, -1):
        out[i] = hz[i, at] if at < k else 0.0
        at = back[i, at]
    return out


def tracked(samples: np.ndarray, rate: int, frame: int = FRAME, hop: int = HOP) -> tuple[np.ndarray, np.ndarray]:
    """F0 in Hz, 0 where there is no voice, and root mean square, of frames around every hop-th sample."""
    n = 1 + len(samples) // hop
    padded = np.concatenate([np.zeros(frame // 2), samples, np.zeros(frame)])
    longest = min(int(rate / SEARCH_LOW) + 1, frame // 2)
    hz, cost, rms = [], [], []
    for i in range(0, n, BLOCK):
        at = np.arange(i, min(n, i + BLOCK))[:, None] * hop + np.arange(frame)
        frames = padded[at]
        level = np.sqrt((frames**2).mean(1))
        h, c = candidates(differences(frames, longest), rate)
        c[level < SILENT] = np.inf
        hz.append(h)
        cost.append(c)
        rms.append(level)
    return best_path(np.concatenate(hz), np.concatenate(cost)), np.concatenate(rms)


@F.pandas_udf(TRACK)
def track(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """f0 (null where there is no voice), rms and seconds; nulls for a null, empty or unsound sound."""
    rows = []
    for x, r in zip(samples, rate, strict=True):
        sound = None if x is None else np.asarray(x, float)
        if sound is None or not len(sound) or not r or r != r or not np.isfinite(sound).all():
            rows.append((None, None, None))
            continue
        f0, rms = tracked(sound, int(r))
        rows.append(([v if v > 0 else None for v in f0.tolist()], rms.tolist(), len(sound) / int(r)))
    return pd.DataFrame(rows, columns=["f0", "rms", "duration"])


def _spread(a: Column) -> Column:
    """Population standard deviation; NULL of an empty array."""
    return let(array_mean(a), lambda m: F.sqrt(array_mean(F.transform(a, lambda v: (v - m) * (v - m)))))


def _middle(a: Column) -> Column:
    def mid(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    return let(F.sort_array(a), mid)


def prosody(of: str | Column, transcript: str | Column) -> Column:
    """A struct of a track's measures: duration, f0_mean_hz, f0_median_hz, f0_std_hz, f0_mean_st, f0_std_st, voiced_ratio, n_voiced,
    rms, rms_std, n_words, speaking_rate. What can't be told is null: pitch without voice, a rate without words."""
    sound = col(of)

    def measures(p: Column) -> Column:
        voiced, st, n = p["voiced"], p["st"], F.size(p["voiced"])
        return F.struct(
            p["duration"].alias("duration"), array_mean(voiced).alias("f0_mean_hz"), _middle(voiced).alias("f0_median_hz"), _spread(voiced).alias("f0_std_hz"), array_mean(st).alias("f0_mean_st"), _spread(st).alias("f0_std_st"),
            F.try_divide(n.cast("double"), p["frames"].cast("double")).alias("voiced_ratio"), n.alias("n_voiced"), array_mean(p["rms"]).alias("rms"), _spread(p["rms"]).alias("rms_std"), p["words"].alias("n_words"),
            F.when(p["words"] > 0, F.try_divide(p["words"].cast("double"), p["duration"])).alias("speaking_rate"),
        )

    voiced = F.filter(sound["f0"], lambda v: v > 0)
    state = F.struct(voiced.alias("voiced"), F.transform(voiced, lambda v: 12 * F.log2(v / 100.0)).alias("st"), F.size(sound["f0"]).alias("frames"), sound["rms"].alias("rms"), sound["duration"].alias("duration"), word_count(transcript).alias("words"))
    return F.when(sound["f0"].isNotNull(), let(state, measures))


# -- the edit of a track -----------------------------------------------------

#: Most semitones that a level moves, scales of a span, width of the median filter, scales of time, and the
#: fewest voiced frames that are edited.
LEVEL_CAP, SPAN_LOW, SPAN_HIGH, SMOOTH, TIME_LOW, TIME_HIGH, LEAST_VOICED = 3.0, 0.3, 3.0, 5, 0.5, 2.0, 4


def _smoothed(x: np.ndarray, width: int = SMOOTH) -> np.ndarray:
    if len(x) < width:
        return x
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, width // 2, mode="edge"), width), 1)


def edited(f0: np.ndarray, level: float | None = None, shape: np.ndarray | None = None, span: float | None = None, stretch: float | None = None, own_level: float | None = None) -> np.ndarray:
    """See edit_f0."""
    if len(f0) < LEAST_VOICED:
        return f0
    by = 1.0 if stretch is None else min(max(stretch, TIME_LOW), TIME_HIGH)
    if abs(by - 1) >= 1e-3:  # frames are repeated or left out: between a voiced and an unvoiced one there is no pitch
        f0 = f0[np.round(np.linspace(0, len(f0) - 1, max(LEAST_VOICED, round(len(f0) * by)))).astype(int)]
    on = f0 > 0
    if on.sum() < LEAST_VOICED or (level is None and shape is None):
        return f0
    st = 12 * np.log2(np.where(on, f0, 100.0) / 100)
    middle = float(np.median(st[on]))
    form = np.where(on, st - middle, 0.0) if shape is None else np.interp(np.linspace(0, 1, len(f0)), np.linspace(0, 1, len(shape)), shape)
    form = _smoothed(form)
    wide = float(form[on].std())
    if span is not None and span > 0 and wide > 1e-6:
        form = form * min(max(span / wide, SPAN_LOW), SPAN_HIGH)
    form = form - np.median(form[on])
    base = middle if own_level is None else own_level
    move = 0.0 if level is None else min(max(level - base, -LEVEL_CAP), LEVEL_CAP)
    return np.where(on, np.clip(100 * 2 ** ((base + move + form) / 12), F0_LOW, F0_HIGH), 0.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def edit_f0(f0: pd.Series, level: pd.Series, shape: pd.Series, span: pd.Series, stretch: pd.Series, own_level: pd.Series) -> pd.Series:
    """An F0 track (0 where there is no voice) with another level, form, span or length; each may be null.

    stretch (0.5 to 2) repeats or leaves out frames. A form (semitones over normalised time) replaces the track's own; it
    is smoothed by a median of 5, scaled (0.3 to 3) to the span, its standard deviation over voiced frames, and centred on
    them. The level (semitones) moves by 3 at most from own_level, by default the track's median. Pitch stays from 60 to 400 Hz;
    frames without voice stay as they are. Tracks of under four voiced frames keep their pitch.
    """
    some = lambda v: None if v is None or v != v else float(v)
    out = []
    for track_, lv, sh, sp, by, own in zip(f0, level, shape, span, stretch, own_level, strict=True):
        out.append(None if track_ is None else edited(np.asarray(track_, float), some(lv), None if sh is None else np.asarray(sh, float), some(sp), some(by), some(own)).tolist())
    return pd.Series(out)
