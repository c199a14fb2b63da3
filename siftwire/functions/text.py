"""Scalar expressions: the text, number and time rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of a field.
TRIMMED = r"[ \t\n\r\x00\x0B]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; other letters stay."""
    return F.translate(text, _UPPER, _LOWER)


def trimmed(text: Column) -> Column:
    """Without space, tab, LF, CR, NUL and VT at both ends."""
    return F.regexp_replace(text, rf"^{TRIMMED}+|{TRIMMED}+$", "")


def blank(text: Column) -> Column:
    return trimmed(F.coalesce(text, F.lit(""))) == ""


def quoted(term: Column) -> Column:
    """The term as a regular expression that matches itself."""
    return F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")


def whole_word(text: Column, term: Column) -> Column:
    """True if the term stands in the text with neither a letter nor a digit next to it, in any case."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), quoted(term), F.lit(r"(?![\p{L}\p{N}])"))
    return ~blank(term) & F.coalesce(F.rlike(text, pattern), F.lit(False))


def host(url: Column) -> Column:
    """The lower-case host of a URL without one leading www., '' if it has none.

    A regular expression takes over where the strict parser gives up, on odd characters in path or host.
    """
    loose = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    strict = F.try_parse_url(url, F.lit("HOST"))
    return F.regexp_replace(ascii_lower(F.coalesce(strict, loose)), r"^www\.", "")


def domain(name: Column) -> Column:
    return F.regexp_replace(ascii_lower(trimmed(F.coalesce(name, F.lit("")))), r"^www\.", "")


def normal_name(name: Column) -> Column:
    """A name for comparison: lower case, only letters, digits and single spaces, without a leading 'the '."""
    kept = F.regexp_replace(trimmed(ascii_lower(F.coalesce(name, F.lit("")))), r"[^\p{L}\p{N}\s]+", " ")
    bare = F.regexp_replace(kept, r"^the\s+", "")
    return trimmed(F.regexp_replace(bare, r"\s+", " "))


def epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 or RFC 822 time; 0 if missing or unreadable. Weekday names are ignored."""
    plain = F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), r"^[A-Za-z]{3,9},\s*", "")
    rfc = F.regexp_replace(plain, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    tries = [F.try_to_timestamp(plain)]
    tries += [F.try_to_timestamp(rfc, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "d MMM yy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z")]
    return F.coalesce(F.unix_timestamp(F.coalesce(*tries)), F.lit(0).cast("long"))


def recency_bonus(timestamp: Column, now: int) -> Column:
    """2 at age 0 or in the future, falling by the factor e in seven days; 0 without a time."""
    age = F.greatest(F.lit(0).cast("double"), (F.lit(now) - timestamp).cast("double"))
    return F.when(timestamp > 0, 2.0 * F.exp(-age / 604800.0)).otherwise(0.0)


# Words that raise the score of an item which no model has rated.
KEYWORDS = ["award", "launch", "ships", "GA", "million", "10k"]


def keyword_score(text: Column, keywords: list[str]) -> Column:
    """1 and 1 more for each keyword that stands in the text as a whole ASCII word, in any case."""
    total = F.lit(1.0)
    for word in keywords:
        total = total + F.when(F.coalesce(text, F.lit("")).rlike(rf"(?i)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"), 1.0).otherwise(0.0)
    return F.round(total, 1)


def plain_number(value: Column) -> Column:
    """A double as text, whole numbers without a decimal point."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")
