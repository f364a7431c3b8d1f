"""Word-level edits between a draft and a candidate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EDITS = "array<struct<start int, end int, replacement string>>"


def diff(draft: str, candidate: str) -> list[tuple[int, int, str]]:
    """Edits ``(start, end, replacement)`` over the draft's words, from a longest common subsequence of words.

    Of equally long subsequences, the one that leaves the draft's words first is taken.
    """
    a, b = draft.split(), candidate.split()
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j, si, sj = [], 0, 0, 0, 0

    def flush() -> None:
        if (si, sj) != (i, j):
            out.append((si, i, " ".join(b[sj:j])))

    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            flush()
            i, j = i + 1, j + 1
            si, sj = i, j
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    i, j = len(a), len(b)
    flush()
    return out


def apply(draft: str, edits: list[tuple[int, int, str]]) -> str:
    """The draft with its edits, which don't overlap, applied; single blanks between words."""
    words = draft.split()
    for start, end, replacement in sorted(edits, reverse=True):
        words[start:end] = replacement.split()
    return " ".join(words)


def diff_of(draft: Column, candidate: Column) -> Column:
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else [dict(zip(("start", "end", "replacement"), e)) for e in diff(p, q)] for p, q in zip(x, y)], dtype=object)

    return F.pandas_udf(both, EDITS)(draft, candidate)


def apply_of(draft: Column, edits: Column) -> Column:
    def both(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else apply(p, [(e["start"], e["end"], e["replacement"]) for e in q]) for p, q in zip(x, y)], dtype=object)

    return F.pandas_udf(both, "string")(draft, edits)


def bare(word: Column) -> Column:
    """A word without punctuation at its ends."""
    return F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", "")


def replacements(draft: Column, committed: Column) -> Column:
    """Pairs of words at the same place that differ beyond case, of texts with as many words; words of letters and
    digits only, of two bytes or more."""
    a, b = (F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "") for c in (draft, committed))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.lower(bare(x)).alias("shorthand"), bare(y).alias("expansion")))
    good = F.filter(pairs, lambda p: (p["shorthand"] != F.lower(p["expansion"])) & p["shorthand"].rlike(r"^[\p{L}\p{N}]+$") & p["expansion"].rlike(r"^[\p{L}\p{N}]+$") & (F.octet_length(p["shorthand"]) >= 2) & (F.octet_length(p["expansion"]) >= 2))
    return F.when(F.size(a) == F.size(b), good).otherwise(F.filter(pairs, lambda p: F.lit(False)))
