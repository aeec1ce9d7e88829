"""Names for SQL: the scalar functions that SQL doesn't have, and table views over a folder."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def plain_nfkd(texts: pd.Series) -> pd.Series:
    """Lower case, compatibility-decomposed without marks, only letters, digits and underscores, single spaces: for any
    script. text.plain_text covers Western European letters as an expression."""

    def plain(t: str | None) -> str | None:
        if t is None:
            return None
        kept = (c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in kept).split())

    return texts.map(plain)


def register(spark: SparkSession) -> list[str]:
    """Register word_edits, plain_nfkd and contour for SQL; returns their names."""
    from ..operators.text_metrics import MAX_KINDS
    from .arrays import resample_contour

    made = {"plain_nfkd": plain_nfkd, "contour": resample_contour}
    for name, f in made.items():
        spark.udf.register(name, f)
    # as operators.text_metrics.word_edits: each kind of word is a character beyond the first 65,536
    at = "(65536 + array_position(kinds, w))"
    code = f"4034953344L + (({at} >> 18) << 24) + ((({at} >> 12) & 63) << 16) + ((({at} >> 6) & 63) << 8) + ({at} & 63)"
    one = lambda words: f"array_join(transform({words}, w -> CAST(unhex(hex({code})) AS STRING)), '')"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION word_edits(r ARRAY<STRING>, h ARRAY<STRING>) RETURNS INT RETURN
        SELECT if(size(kinds) > {MAX_KINDS}, CAST(raise_error('too many kinds of words') AS INT), levenshtein({one("r")}, {one("h")})) FROM (SELECT array_distinct(concat(r, h)) AS kinds)""")
    return sorted([*made, "word_edits"])


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """A temporary view for each Parquet table of the folder."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
