"""Text functions: column expressions where Spark's own suffice, Arrow-batched functions where they don't.

The normalisers differ on purpose and are not interchangeable. Those named ``*_exact`` fold case and compatibility
forms as Unicode defines them; the others stay in the JVM and lower-case.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Reject patterns, in their order of precedence.
EMAIL = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
URL = r"(?i)(?:https?://|www\.|\b[a-z0-9.-]+\.(?:com|org|net|io)\b)"
PHONE = r"(?U)(?<!\w)(?:\+?\d[\s().-]*){7,}(?!\w)"
HANDLE = r"(?:^|\s)@[A-Za-z0-9_]+"
MARKUP = r"(?i)</?[A-Za-z][^>]*>|\[[^\]]+\]\([^)]*\)|```|\{[^{}]*:[^{}]*\}|&(?:lt|gt|amp|quot|#\d+);?"
CODE = r"(?:\b(?:def|class|import|return|const|let|var)\b|[{};]{2,}|\w+\([^)]*\)\s*[;{])"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ENGLISH_TOKEN = r"[A-Za-z]+(?:'[A-Za-z]+)?"
ENGLISH_PHRASE = rf"^(?:{ENGLISH_TOKEN})(?:\s+{ENGLISH_TOKEN})*[.!?]?$"
NUMBER = r"(?U)\b(?:\d+[A-Za-z-]*|[A-Z]\d+)\b"
ENTITY = r"(?U)\b(?:[A-Z][\w'’-]*)(?:\s+[A-Z][\w'’-]*)*\b"


def collapse(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\u0085  ]+", " "))


#: White space as Unicode has it.
SPACES = "[\\s\\x0b\\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def collapse_all(text: Column) -> Column:
    """As ``collapse``, for all white space of Unicode."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def fold(text: Column) -> Column:
    """Collapsed and lower-cased."""
    return F.lower(collapse(text))


def plain(text: Column) -> Column:
    """Folded, with everything but letters, digits, underscores and apostrophes as single blanks."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_']+", " "))


def surface(text: Column) -> Column:
    """Trimmed, final stops taken off, collapsed and lower-cased."""
    return fold(F.regexp_replace(F.trim(text), r"[.!?]+$", ""))


def lines(text: Column) -> Column:
    """Collapsed lines that are not blank."""
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\u0085  ]"), collapse), lambda x: x != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def english_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENGLISH_TOKEN), F.lit(0))


def shape(text: Column) -> Column:
    """Plain text with numbers and capitalised runs masked."""
    masked = F.regexp_replace(F.regexp_replace(text, NUMBER, "<number>"), ENTITY, "<entity>")
    return F.trim(F.regexp_replace(fold(masked), r"[^\p{L}\p{N}_'<>]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sentence(text: Column) -> Column:
    """The first letter in upper case and a final stop where none is."""
    cap = F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
    return F.when(text == "", text).when(cap.rlike(r"[.!?]$"), cap).otherwise(F.concat(cap, F.lit(".")))



def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def tail(text: Column, n: int = 80) -> Column:
    return F.right(text, F.lit(n))


def keep_edges(original: Column, replacement: Column) -> Column:
    """The replacement between the original's leading and trailing white space."""
    return F.concat(F.regexp_extract(original, r"^\s*", 0), F.trim(replacement), F.when(F.trim(original) == "", "").otherwise(F.regexp_extract(original, r"\s*$", 0)))


def round_to(n: Column, d: Column, places: int) -> Column:
    """n / d to so many places, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.round(n / d, places))


def _casefold(nfkc: bool, last: bool):
    """Collapsed and case-folded as Unicode defines it; ``last``: white space is collapsed after folding, not before."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        t = unicodedata.normalize("NFKC", value) if nfkc else value
        return " ".join(t.strip().casefold().split()) if last else " ".join(t.split()).casefold()

    return F.pandas_udf(lambda s: pd.Series([one(v) for v in s], dtype=object), "string")


def folded_exact(text: Column) -> Column:
    """Compatibility forms, white space and case folded; signs stay."""
    return _casefold(True, False)(text)


def folded_after(text: Column) -> Column:
    """As ``folded_exact``, with white space collapsed last, so that what folding makes of it collapses too."""
    return _casefold(True, True)(text)


def folded_case(text: Column) -> Column:
    """White space and case folded as Unicode defines them; compatibility forms stay."""
    return _casefold(False, False)(text)


def round_exact(value: Column, places: int) -> Column:
    """The double rounded half to even by its exact binary value, as ``round(2.675, 2) == 2.67``."""
    return F.pandas_udf(lambda s: s.map(lambda v: round(v, places), na_action="ignore"), "double")(value)


def _exact(value: str | None) -> str | None:
    if value is None:
        return None
    t = " ".join(unicodedata.normalize("NFKC", value).split()).casefold()
    return re.sub(r"[^\w']+", " ", t).strip()


def plain_exact(text: Column) -> Column:
    """As ``plain``, with compatibility forms and case folded as Unicode defines them."""
    return F.pandas_udf(lambda s: pd.Series([_exact(v) for v in s], dtype=object), "string")(text)


def _spans(value: str | None) -> list[dict] | None:
    return None if value is None else [{"start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", value)]


def token_spans(text: Column) -> Column:
    """Starts and ends, in code points, of the words between white space."""
    return F.pandas_udf(lambda s: pd.Series([_spans(v) for v in s], dtype=object), "array<struct<start int, end int>>")(text)
