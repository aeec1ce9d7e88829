"""Joins of rows with a table about their own keys, where one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize

#: Fewer keys than this are hot: each holds more than 1 / HOT of all rows.
HOT = 10_000
#: Keys with no more rows than this are never hot.
FEW = 64


def hot_above(total: int) -> int:
    return max(FEW, -(-total // HOT))


def join_sums(rows: DataFrame, sums: DataFrame, key: str, many: str, total: int, paths: list[str] | None = None) -> DataFrame:
    """rows joined with sums, which in `many` says how many of the `total` rows have the key; all sums of a key say the same.

    The sums are written first, and where no key is hot, which is the usual case, the join is a plain one. Hot keys, fewer
    than HOT whatever the size of the table, come by a broadcast and their rows stay where they are; the others come by a
    shuffle, in which no key holds more than 1 / HOT of the rows. paths: gets the table that the result reads.
    """
    sums, path = materialize(sums, "sums")
    if paths is not None:
        paths.append(path)
    above = F.col(many) > hot_above(total)
    if not sums.where(above).limit(1).count():
        return rows.join(sums, key)
    hot, cold = F.broadcast(sums.where(above)), sums.where(~above)
    return rows.join(hot, key).union(rows.join(F.broadcast(sums.where(above).select(key)), key, "left_anti").join(cold, key))
