"""Text column expressions: cleaning, counting, sentences, markers, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, col, strip

# Words that negate, by language; speech rates by output language (spoken characters a second, and
# characters a voiced second); languages by code; directions.
NEGATIONS = {
    "en": ("no", "not", "never", "nobody", "nothing", "none", "neither", "nor", "nowhere", "cannot", "without"),
    "es": ("no", "ni", "nunca", "jamás", "jamas", "nadie", "nada", "ninguno", "ninguna", "ningún", "ningun", "tampoco", "sin"),
}
SPOKEN_CHARS_PER_S = {"es": 10.8, "en": 12.0}
CHARS_PER_VOICED_S = {"es": 12.0, "en": 13.2}
LANGUAGES = {"en": "English", "es": "Spanish"}
DIRECTIONS = {"en-es": ("en", "es"), "es-en": ("es", "en")}
MAX_SPEED, TRANSPARENT = 1.25, 0.85
FREE_COMPRESSION = MAX_SPEED / TRANSPARENT
SENTENCE_END = ".?!…"


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def first_nonblank(*columns: str | Column) -> Column:
    """The first of the columns that isn't blank, trimmed; '' if all are."""
    return F.coalesce(*[F.nullif(strip(col(c)), F.lit("")) for c in columns], F.lit(""))


def direction_part(direction: str | Column, i: int) -> Column:
    """Source (0) or target (1) of 'en-es'."""
    return F.split(col(direction), "-")[i]


def error_words(text: str | Column) -> Column:
    """Words for error rates: lower case, punctuation gone, white space collapsed."""
    plain = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"\p{P}", "")
    return F.regexp_extract_all(plain, F.lit(r"\S+"), F.lit(0))


def word_count(text: str | Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\S+"), F.lit(0)))


#: Letters with marks of the Latin alphabets at hand and their base letters.
_MARKED, _BASE = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def plain_text(text: str | Column) -> Column:
    """Lower case without accents or punctuation, single spaces. Covers the letters of Western European languages."""
    low = F.translate(F.lower(F.coalesce(col(text), F.lit(""))), _MARKED, _BASE)
    return strip(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def take_cer(reference: str | Column, heard: str | Column) -> Column:
    """Character error rate on plain text; a blank hypothesis counts as '-', a blank reference gives 0."""
    ref, hyp = plain_text(reference), plain_text(heard)
    hyp = F.when(hyp == "", F.lit("-")).otherwise(hyp)
    return F.when(ref == "", F.lit(0.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def spoken_chars(text: str | Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[^\p{L}\p{N}]", ""))


def _absent(table: Column):
    return lambda w: ~F.array_contains(table, w)


def negations(text: str | Column, language: str | Column) -> Column:
    lang = col(language) if isinstance(language, Column) else F.lit(language)
    words = F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), F.lower)
    out = F.lit(0)
    for code, own in NEGATIONS.items():
        table = F.array(*[F.lit(w) for w in own])
        n = F.size(words) - F.size(F.filter(words, _absent(table)))
        if code == "en":
            n = n + F.size(F.filter(words, lambda w: w.endswith("n't")))
        out = F.when(lang == code, n).otherwise(out)
    return out


def numbers(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"[0-9]+"), F.lit(0)))


def _ends_sentence(text: Column) -> Column:
    return F.regexp_like(strip(text), F.lit(r"[.?!…]$"))


def keeps_markers(candidate: str | Column, reference: str | Column, language: str | Column) -> Column:
    """No fewer questions or negations, no lost number, a sentence's end kept; a blank candidate keeps nothing."""
    c, r = col(candidate), col(reference)
    return (
        (strip(c) != "")
        & (F.regexp_count(c, F.lit(r"\?")) >= F.regexp_count(r, F.lit(r"\?")))
        & (negations(c, language) >= negations(r, language))
        & (F.size(F.array_except(numbers(r), numbers(c))) == 0)
        & (~_ends_sentence(r) | _ends_sentence(c))
    )


def sentences(text: str | Column) -> Column:
    """Sentences of a line: after ? ! … and white space, or after a full stop before a capital or an opening mark. A last
    single word without an end joins the sentence before it."""
    body = strip(F.coalesce(col(text), F.lit("")))
    parts = F.filter(F.transform(F.split(body, r"(?<=[?!…])\s+|(?<=\.)\s+(?=[A-ZÁÉÍÓÚÑÜ¿¡])"), strip), lambda p: p != "")
    last, n = F.get(parts, F.size(parts) - 1), F.size(parts)
    rejoined = F.concat(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat_ws(" ", F.get(parts, n - 2), last)))
    loose = (n > 1) & (word_count(last) == 1) & ~_ends_sentence(last)
    return F.when(n == 0, F.array(body)).when(loose, rejoined).otherwise(parts)


def speak_whole(text: str | Column) -> Column:
    """Whether the line holds a sentence of at most two words."""
    return F.exists(sentences(text), lambda s: word_count(s) <= 2)


def chunks_of(text: str | Column, most: int = 220) -> Column:
    """Sentences packed in order into chunks of at most `most` characters; a longer sentence is a chunk of its own."""
    parts = F.filter(F.split(strip(F.coalesce(col(text), F.lit(""))), r"(?<=[.!?])\s+"), lambda p: p != "")

    def add(done: Column, part: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        fits = (F.size(done) > 0) & (F.length(last) + 1 + F.length(part) <= most)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, part)))
        return F.when(fits, joined).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def budget_chars(window: str | Column, language: Column, free: float = FREE_COMPRESSION) -> Column:
    """Spoken characters that fit the window, cut to whole ones."""
    return (lookup(language, SPOKEN_CHARS_PER_S, 11.0) * F.greatest(col(window), F.lit(0.1)) * free).cast("int")


def needs_shortening(text: str | Column, window: str | Column, language: Column, free: float = FREE_COMPRESSION) -> Column:
    return spoken_chars(text) > lookup(language, SPOKEN_CHARS_PER_S, 11.0) * F.greatest(col(window), F.lit(0.1)) * free


def speech_speed(text: str | Column, language: Column, window: str | Column) -> Column:
    """Speed that fits the window, between 1 and 1.25, to three places."""
    chars = F.greatest(F.length(F.replace(col(text), F.lit(" "), F.lit(""))), F.lit(1))
    predicted = chars / lookup(language, CHARS_PER_VOICED_S, 12.0) + 0.25 * (F.size(sentences(text)) - 1)
    return F.bround(clamp(predicted / F.greatest(col(window), F.lit(0.1)), 1.0, MAX_SPEED), 3)


def language_name(code: str | Column) -> Column:
    return F.coalesce(lookup(col(code), LANGUAGES, None), F.initcap(col(code)))


def check_language(detected: str | Column, confidence: str | Column, direction: str | Column, final: bool = True, sure: float = 0.5, early: float = 0.9) -> Column:
    """ok, wrong_direction, unsupported, or recheck where an early check isn't sure enough of an unsupported language."""
    d, c = col(detected), col(confidence)
    out = F.when((d == direction_part(direction, 0)) | (c < sure), "ok").when(d == direction_part(direction, 1), "wrong_direction")
    return (out if final else out.when(c < early, "recheck")).otherwise("unsupported")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(strip(url), r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def public_url(url: str | Column) -> Column:
    """An http or https link to a public host: no local name, no private, loopback, link-local or reserved address."""
    host = _host(F.coalesce(col(url), F.lit("")))
    octets = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    is_v4 = F.regexp_like(host, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))
    a, b, c = (F.get(octets, i) for i in range(3))
    inner = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
    inner = inner | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)))) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    v4_ok = ~inner & F.forall(octets, lambda o: o <= 255)
    v6_bad = F.regexp_like(host, F.lit(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|::ffff:.*|2001:db8:.*)\]$"))
    named = ~F.regexp_like(host, F.lit(r"^localhost$|\.(localhost|local|internal)$"))
    return (host != "") & named & F.when(is_v4, v4_ok).otherwise(~v6_bad)


def failure_kind(message: str | Column) -> Column:
    """What a download's error message says: private, unsupported, unavailable or other."""
    low = F.lower(F.coalesce(col(message), F.lit("")))

    def says(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return F.when(says("login", "log in", "sign in", "cookies", "private"), "private").when(says("unsupported url"), "unsupported").when(says("unavailable", "not available", "404"), "unavailable").otherwise("other")


def word_list(timings: str | Column) -> Column:
    """Timed words, trimmed, times to three places, empty ones gone."""
    kept = F.transform(col(timings), lambda w: F.struct(strip(w["word"]).alias("word"), F.bround(w["start"], 3).alias("start"), F.bround(w["end"], 3).alias("end")))
    return F.filter(kept, lambda w: w["word"] != "")
