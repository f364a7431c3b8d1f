"""Seeded typing noise with an audit trail."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions.distance import KEY_ROWS

# operators' weights and rewrites by sound.
WEIGHTS = {"substitution": 59, "deletion": 16, "insertion": 10, "transposition": 2, "repeat": 8, "spacing": 5, "vowel_deletion": 0, "phonetic_rewrite": 0}
DRAFT_WEIGHTS = {"substitution": 35, "deletion": 12, "insertion": 8, "transposition": 5, "repeat": 8, "spacing": 10, "vowel_deletion": 12, "phonetic_rewrite": 10}
SOUNDS = (("tion", "shun"), ("ph", "f"), ("ck", "k"), ("qu", "kw"))
ATTEMPTS = 32
TRACE = "array<struct<event int, operator string, index int, source string, replacement string>>"


@lru_cache(1)
def neighbours() -> dict[str, list[tuple[str, float]]]:
    """Keys within one key width of each key, nearer ones heavier; sideways before up and down before across."""
    at = {c: (i, j + off) for i, (row, off) in enumerate(KEY_ROWS) for j, c in enumerate(row)}
    out = {}
    for c, (i, x) in at.items():
        near = []
        for d, (k, y) in at.items():
            if d != c and abs(k - i) <= 1 and abs(x - y) <= 1.0:
                near.append((d, 6.0 if k == i else 3.0 if abs(x - y) <= 0.5 else 1.0))
        out[c] = near
    return out


def _like(letter: str, new: str) -> str:
    return new.upper() if letter.isupper() else new


def _edit(op: str, t: str, rng: random.Random, letters_only: bool) -> tuple[int, str, str] | None:
    """One edit ``(index, source, replacement)`` of the text, or None where the operator finds no place."""
    letters = [i for i, c in enumerate(t) if c.isalpha()]
    if op in ("substitution", "insertion"):
        spots = [(i, [(k, w) for k, w in neighbours().get(t[i].lower(), []) if k.isalpha() or not letters_only]) for i in letters]
        spots = [(i, n) for i, n in spots if n]
        if not spots:
            return None
        i, near = rng.choice(spots)
        key = _like(t[i], rng.choices([k for k, _ in near], [w for _, w in near])[0])
        return (i, t[i], key) if op == "substitution" else (i, t[i], t[i] + key)
    if op == "deletion":
        return (i := rng.choice(letters), t[i], "") if len(letters) > 1 else None
    if op == "repeat":
        return (i := rng.choice(letters), t[i], t[i] * 2) if letters else None
    if op == "transposition":
        spots = [i for i in letters if i + 1 < len(t) and t[i + 1].isalpha() and t[i] != t[i + 1]]
        return (i := rng.choice(spots), t[i : i + 2], t[i + 1] + t[i]) if spots else None
    if op == "spacing":
        blanks = [i for i, c in enumerate(t) if c == " " and 0 < i < len(t) - 1]
        if blanks and rng.random() < 0.5:
            return rng.choice(blanks), " ", ""
        inner = [i for i in letters if i + 1 < len(t) and t[i + 1].isalpha()]
        return (i := rng.choice(inner), t[i], t[i] + " ") if inner else None
    if op == "vowel_deletion":
        spots, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and t[j].isalpha():
                j += 1
            if j - i >= 3:
                spots += [k for k in range(i + 1, j) if t[k].lower() in "aeiou"]
            i = max(j, i + 1)
        return (i := rng.choice(spots), t[i], "") if spots else None
    low, spots = t.lower(), []
    for source, sound in SOUNDS:
        k = low.find(source)
        while k >= 0:
            spots.append((k, t[k : k + len(source)], _like(t[k], sound[0]) + sound[1:]))
            k = low.find(source, k + 1)
    for k, c in enumerate(low):
        after, before = low[k + 1 : k + 2], low[k - 1 : k]
        if c == "c" and after and after in "eiy":
            spots.append((k, t[k], _like(t[k], "s")))
        elif c == "c" and before != "t" and after not in ("k",):
            spots.append((k, t[k], _like(t[k], "k")))
    return rng.choice(spots) if spots else None


def noisy(text: str, events: int, seed: int, weights: dict[str, int] | None = None, letters_only: bool = True) -> tuple[str, list[dict]]:
    """The text after up to ``events`` edits, and their trace. No text comes twice; the same seed gives the same.

    An event that finds no new text in 32 attempts ends the row early, so the trace may be shorter than asked.
    """
    weights = weights or WEIGHTS
    rng, seen, trace = random.Random(seed), {text}, []
    ops = [o for o, w in weights.items() if w > 0]
    for event in range(events):
        for _ in range(ATTEMPTS):
            op = rng.choices(ops, [weights[o] for o in ops])[0]
            edit = _edit(op, text, rng, letters_only)
            if edit is None:
                continue
            i, source, new = edit
            out = text[:i] + new + text[i + len(source) :]
            if out not in seen and out.strip():
                seen.add(out)
                trace.append({"event": event, "operator": op, "index": i, "source": source, "replacement": new})
                text = out
                break
        else:
            break
    return text, trace


def augment(rows: DataFrame, key: str, text: str, events: str, seed: str, weights: dict[str, int] | None = None) -> DataFrame:
    """``(key, text, draft, requested, operations, category)``: each row's noise depends on its key and the seed alone.

    The category is that of the trace: phonetic before compressed before typing; unchanged without operations. Null
    texts are left out.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, text string, draft string, requested int, operations {TRACE}"
    own = F.xxhash64(F.lit(seed), F.col(key).cast("string")).bitwiseAND(F.lit(2**62 - 1))
    base = rows.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text"), F.col(events).cast("int").alias("events"), own.alias("seed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [noisy(t, int(n), int(s), weights) for t, n, s in zip(b["text"], b["events"], b["seed"])]
            yield pd.DataFrame({key: b[key], "text": b["text"], "draft": [d for d, _ in done], "requested": b["events"], "operations": [o for _, o in done]})

    has = lambda *names: F.exists("operations", lambda o: o["operator"].isin(*names))
    category = F.when(F.size("operations") == 0, "unchanged").when(has("phonetic_rewrite"), "phonetic").when(has("vowel_deletion", "spacing"), "compressed").otherwise("typing")
    return base.mapInPandas(run, schema).withColumn("category", category)
