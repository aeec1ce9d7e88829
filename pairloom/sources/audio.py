"""PCM sound as array columns. Codecs are Arrow-batched functions over binary columns; only WAV needs no other program."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOUND = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("channels", T.ArrayType(T.ArrayType(T.FloatType())))])


def decode_pcm16(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples from -1 to 1, shape (channels, frames)."""
    with wave.open(io.BytesIO(raw)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("16-bit PCM is expected")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).T / 32768.0
        return w.getframerate(), x


def encode_pcm16(samples: np.ndarray, rate: int) -> bytes:
    """Samples (frames) or (channels, frames), clipped to -1 to 1."""
    x = np.atleast_2d(np.asarray(samples, float))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").T.tobytes())
    return out.getvalue()


@F.pandas_udf(SOUND)
def decode(content: pd.Series) -> pd.DataFrame:
    """NULL for what isn't 16-bit PCM."""
    rows = []
    for raw in content:
        try:
            rate, x = decode_pcm16(raw)
            rows.append((rate, [c.astype(np.float32).tolist() for c in x]))
        except Exception:  # noqa: BLE001  an unreadable file is a NULL, not the end of the job
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["rate", "channels"])


def encode(rate: int):
    @F.pandas_udf("binary")
    def run(channels: pd.Series) -> pd.Series:
        return pd.Series([encode_pcm16(np.stack([np.asarray(c, float) for c in x]), rate) if x is not None else None for x in channels])

    return run


def mono(channels):
    """The mean of the channels."""
    n = F.size(channels).cast("double")
    first = F.transform(F.get(channels, F.lit(0)), lambda v: v.cast("double"))
    return F.transform(F.aggregate(F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))), first, lambda a, c: F.zip_with(a, c, lambda x, y: x + y)), lambda v: v / n)


def stereo(channels):
    """Two channels: one is doubled, further ones are dropped."""
    return F.when(F.size(channels) == 1, F.concat(channels, channels)).otherwise(F.slice(channels, 1, 2))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, duration) of the sound files at path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    sound = df.select("path", decode("content").alias("_s")).select("path", "_s.rate", "_s.channels")
    return sound.withColumn("duration", F.size(F.get("channels", F.lit(0))) / F.col("rate").cast("double"))
