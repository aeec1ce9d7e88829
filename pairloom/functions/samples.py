"""Operators on samples of one channel: where speech is, trimming, placing, resampling, a gate against steady noise.

What is index arithmetic is an expression over the spans; what needs a spectrum or an energy runs in Arrow batches. A null
array gives a null; an empty or silent one has no spans and stays as it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import col, let

# How far below the loudest frame speech may be, frames and steps of its energy; pauses and air that are kept
# and the fade of what is cut off, in seconds; spectrum frames and steps, the share of quiet frames that are noise, deviations
# above its mean that are kept, the most it is turned down, and how many bins and frames a mask is averaged over.
TOP_DB, FRAME, STEP = 35.0, 1024, 256
PAUSE_S, LEAD_S, TAIL_S, FADE_S = 0.25, 0.05, 0.10, 0.05
SPECTRUM, HOP, QUIET, DEVIATIONS, REDUCTION_DB, SMOOTH = 2048, 512, 15.0, 1.5, 12.0, (5, 7)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SAMPLES = T.ArrayType(T.DoubleType())


def _each(f: Callable[[np.ndarray], object], kind: T.DataType):
    @F.pandas_udf(kind)
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else f(np.asarray(s, float)) for s in samples], dtype=object)

    return run


def spans_of(x: np.ndarray, top_db: float = TOP_DB, frame: int = FRAME, step: int = STEP) -> list[dict[str, int]]:
    """Runs of frames, centred at multiples of `step`, whose energy is at most top_db below the loudest one's."""
    if not len(x) or not x.any():
        return []
    power = np.concatenate([[0.0], np.cumsum(x * x)])
    centre = np.arange(0, len(x) + 1, step)
    lo, hi = np.clip(centre - frame // 2, 0, len(x)), np.clip(centre + frame // 2, 0, len(x))
    energy = np.maximum(power[hi] - power[lo], 0.0)
    loud = np.concatenate([[False], energy > energy.max() * 10 ** (-top_db / 10), [False]])
    turns = np.flatnonzero(loud[1:] != loud[:-1]).reshape(-1, 2)
    return [{"start": int(a * step), "end": int(min(b * step, len(x)))} for a, b in turns if a * step < len(x)]


#: samples to array<struct<start, end>>: where there is speech.
speech_spans = _each(spans_of, SPANS)


def tightened(samples: str | Column, spans: str | Column, rate: int, pause: float = PAUSE_S, lead: float = LEAD_S, tail: float = TAIL_S) -> Column:
    """The samples with outer silence cut to a little air and inner pauses to `pause` seconds of silence at most."""
    keep, air, after = int(pause * rate), int(lead * rate), int(tail * rate)

    def cut(p: Column) -> Column:
        x, s = p["x"], p["s"]
        n = F.size(s)
        part = lambda a, b: F.slice(x, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
        first = part(F.greatest(s[0]["start"] - air, F.lit(0)), s[0]["end"])
        silence = F.array_repeat(F.lit(0.0), keep)
        rest = F.transform(F.slice(s, 2, F.greatest(n - 1, F.lit(0))), lambda b, i: F.concat(F.when(b["start"] - s[i]["end"] <= keep, part(s[i]["end"], b["start"])).otherwise(silence), part(b["start"], b["end"])))
        end = F.element_at(s, -1)["end"]
        return F.when(n == 0, x).otherwise(F.concat(first, F.flatten(rest), part(end, end + after)))

    return let(F.struct(col(samples).cast("array<double>").alias("x"), F.coalesce(col(spans), F.array().cast("array<struct<start:long,end:long>>")).alias("s")), lambda p: F.when(p["x"].isNotNull(), cut(p)))


def placed(samples: str | Column, offset: Column, limit: Column, rate: int, fade: float = FADE_S) -> Column:
    """(piece, dropped): what of a line may stand from sample `offset` up to `limit`, faded out where it is cut, and the
    seconds that are lost."""

    def fit(p: Column) -> Column:
        n = F.size(p["x"])
        usable = F.greatest(F.lit(0), F.least(n, (p["l"] - p["o"]).cast("int")))
        ramp = F.least(F.lit(int(fade * rate)), usable)
        return let(F.struct(F.slice(p["x"], 1, usable).alias("x"), (n > usable).alias("cut"), usable.alias("n"), ramp.alias("ramp"), ((n - usable) / float(rate)).alias("lost")), lambda q: F.struct(F.transform(q["x"], lambda v, i: F.when(~q["cut"] | (i < q["n"] - q["ramp"]), v).otherwise(v * F.try_divide((q["n"] - 1 - i).cast("double"), F.greatest(q["ramp"] - 1, F.lit(1)).cast("double")))).alias("piece"), q["lost"].alias("dropped")))

    return let(F.struct(F.coalesce(col(samples).cast("array<double>"), F.array().cast("array<double>")).alias("x"), offset.cast("long").alias("o"), limit.cast("long").alias("l")), fit)


def resample(x: np.ndarray, source: int, target: int, zeros: int = 24, step: int = 1 << 14) -> np.ndarray:
    """Band-limited interpolation: each new sample is a sum over a windowed sinc around its place, ceil(n * target / source)
    of them."""
    if source == target or not len(x):
        return x.copy()
    cutoff = min(1.0, target / source) * 0.95
    reach = math.ceil(zeros / cutoff)
    padded, many = np.pad(x, reach), -(-len(x) * target // source)
    out = np.empty(many)
    for k in range(0, many, step):
        at = np.arange(k, min(k + step, many)) * (source / target)
        near = np.floor(at).astype(int)
        taps = near[:, None] + np.arange(-reach + 1, reach + 1)[None, :]
        far = at[:, None] - taps
        weight = cutoff * np.sinc(cutoff * far) * np.cos(np.clip(far / reach, -1, 1) * (np.pi / 2)) ** 2
        out[k : k + step] = (padded[np.clip(taps + reach, 0, len(padded) - 1)] * weight).sum(1)
    return out


def resampled(source: int, target: int):
    return _each(lambda x: resample(x, source, target).tolist(), SAMPLES)


def _box_mean(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means over `size` neighbours along an axis; beyond the edges the values are mirrored."""
    half = size // 2
    wide = np.moveaxis(np.pad(a, [(half, half) if k == axis else (0, 0) for k in range(a.ndim)], mode="symmetric"), axis, 0)
    sums = np.concatenate([np.zeros_like(wide[:1]), np.cumsum(wide, 0)])
    return np.moveaxis((sums[size:] - sums[:-size]) / size, 0, axis)


def gate(x: np.ndarray, deviations: float = DEVIATIONS, reduction_db: float = REDUCTION_DB) -> np.ndarray:
    """Steady noise turned down by at most reduction_db. The noise of each band is read off the quietest frames that aren't
    digital silence; where a band's level is within the noise, a smoothed mask lowers it."""
    if len(x) < SPECTRUM or not x.any():
        return x.copy()
    window = np.hanning(SPECTRUM + 1)[:-1]
    padded = np.pad(x, SPECTRUM // 2 + (-len(x)) % HOP, mode="constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, SPECTRUM)[::HOP]
    bands = np.fft.rfft(frames * window, axis=1)
    level = 20 * np.log10(np.abs(bands) + 1e-10)
    energy = (np.abs(bands) ** 2).sum(1)
    live = energy > 1e-8 * energy.max()
    quiet = live & (energy <= np.percentile(energy[live], QUIET))
    noise = level[quiet if quiet.sum() >= 5 else live]
    above = (level > noise.mean(0) + deviations * noise.std(0)).astype(float)
    mask = _box_mean(_box_mean(above, SMOOTH[0], 1), SMOOTH[1], 0)
    floor = 10 ** (-reduction_db / 20)
    back = np.fft.irfft(bands * (floor + (1 - floor) * mask), SPECTRUM, axis=1) * window
    total, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for k, frame in enumerate(back):
        total[k * HOP : k * HOP + SPECTRUM] += frame
        weight[k * HOP : k * HOP + SPECTRUM] += window**2
    start = SPECTRUM // 2 + (-len(x)) % HOP
    return (total / np.maximum(weight, 1e-8))[start : start + len(x)]


spectral_gate = _each(lambda x: gate(x).tolist(), SAMPLES)
