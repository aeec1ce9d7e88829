"""Numeric column expressions: parsing, guards, pitch scales, seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plausible band of a speaking voice, Hz.
F0_LOW, F0_HIGH = 60.0, 400.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters that count as white space at the ends of a text.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: str | Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.btrim(col(text), F.lit(WHITE))


def let(value: str | Column, body) -> Column:
    """body(value), with the value computed once however often the body names it. Higher-order functions evaluate what is
    written in their lambda again for each element; a lambda's own variable is not."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def finite(x: str | Column) -> Column:
    """A double; text that is no number, NaN and infinities become NULL."""
    d = F.expr(f"try_cast(`{x}` AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def safe_div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def signed_round(x: str | Column, places: int) -> Column:
    """x to so many places, halves away from zero, as SQL's round does it: what is negative and rounds to nothing is -0.0, which
    F.round makes 0.0."""
    scale = float(10**places)
    return F.signum(col(x)) * F.round(F.abs(col(x)) * scale) / scale


def semitones(hz: str | Column) -> Column:
    """Semitones above 100 Hz; NULL at or below 0."""
    x = col(hz)
    return F.when(x > 0, 12 * F.log2(x / 100.0))


def hertz(st: str | Column) -> Column:
    return 100.0 * F.pow(F.lit(2.0), col(st) / 12.0)


def safe_ln(x: str | Column) -> Column:
    return F.when(col(x) > 0, F.log(col(x)))


def plausible_hz(hz: str | Column, low: float = F0_LOW, high: float = F0_HIGH) -> Column:
    return col(hz).between(low, high)


def truth(x: str | Column) -> Column:
    """'true' in any letter case."""
    return F.lower(strip(col(x).cast("string"))) == "true"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def seed31(*parts: str | Column) -> Column:
    """A stable seed below 2^31 - 1: the first four bytes of the SHA-256 of the parts joined by '|', big-endian."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 2147483647


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, least: int = 2) -> Column:
    """Pearson's r from sums; NULL under `least` rows or without variance on either side."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    r = (sxy - sx * sy / n) / F.sqrt(vx * vy)
    return F.when((n >= least) & (vx > 1e-12 * F.greatest(F.lit(1.0), F.abs(sxx))) & (vy > 1e-12 * F.greatest(F.lit(1.0), F.abs(syy))), r)


def guarded_corr(x: str | Column, y: str | Column, least: int = 2) -> Column:
    """An aggregate: r over rows where both are present; NULL under `least` rows or if either side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x).cast("double")), F.when(both, col(y).cast("double"))
    spread = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    moments = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when((F.count(a) >= least) & spread, moments)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays; NULL if either is missing or zero."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return let(F.struct(col(a).alias("x"), col(b).alias("y")), lambda p: F.try_divide(dot(p["x"], p["y"]), F.sqrt(dot(p["x"], p["x"])) * F.sqrt(dot(p["y"], p["y"]))))


def unit(v: str | Column) -> Column:
    """The array scaled to length 1; a zero array stays."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    scaled = lambda x: let(norm(x), lambda n: F.transform(x, lambda e: e.cast("double") / F.when(n > 0, n).otherwise(1.0)))
    return let(v, scaled)


def min_speaker_seconds(total: str | Column) -> Column:
    """Least speech that keeps a voice apart: 30 % of all, between 1.5 and 4 seconds."""
    return clamp(0.3 * col(total), 1.5, 4.0)
