"""Problem 1: texts that break off.

A backward character n-gram model, trained on all different texts of the column, tells for the last letters of a text
how often a text, a line or a sentence was complete after them and how often it went on. Contexts of 1 to 24 letters
are counted over every position of every different text, however often it occurs, and interpolated from short to long;
a text's own end is left out. A text is cut off where the log-odds of ending fall below its language's and column's
threshold, which lies in the widest valley of the group's own log-odds. No ending is exempt: stops, brackets, quotes and
emoji are letters that the model reads like others.

Before counting, texts are brought to their one form (see ``lookalike``), numbers become 0 and words that few texts hold
become one of two signs, emoji a third, so that contexts reach beyond names. A mark that a cut left behind (dots, a replacement
character, a bracketed note) is taken off when the model has not met it after the letters before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.lookalike import canonical
from inkfold.session import cut

ORDERS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 24)
WEIGHT = 6.0  # of the shorter context's estimate, in observations
LABEL = 0.3  # least share of a label's occurrences that have its mark
OFTEN = 8  # copies that make a label of a text short enough for one context, if its letters seldom go on elsewhere
BITS = (16, 27)  # least and most bits of the bit map of last contexts, eight for each: at most 16 MB, beyond which it only tells less
SEEN = 4  # observations that a context needs to be used
NAME, WORD, PICTURE = "\x01", "\x02", "\x03"  # stand for a capitalised and a small word that few texts hold, and for emoji
WORDS = 200_000  # most common words that are broadcast
RARE = 375  # a word is common if it is in at least one of so many texts, so that common words are boundedly many
LEAST = 2  # and in at least so many texts: a word met once tells nothing
CENTRE, LOW, HIGH = -2.6, -3.6, -1.8  # where thresholds lie without evidence, and their range
POOLED = 500.0  # texts that the whole field counts for in the histogram of each of its groups
PULL = 0.002  # share of a group's texts that a threshold one unit off the centre must save
STOPS = np.array([ord(c) for c in ".!?。！？"], dtype=np.uint64)
CLOSERS = np.array([ord(c) for c in ")]}”’»\"'"], dtype=np.uint64)
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_LETTERS_ASCII, _DIGIT_ASCII = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]+")
_DIGIT = regex.compile(r"\p{Nd}+")
_PICTURE = regex.compile(r"[\p{So}\p{Sk}\uFE0F\u200D]+")
_MARK = regex.compile(r"(?:\s*(?:…|\.\.\.+|�+|[\[(<]+\s*(?:…|\.\.\.|truncated|cut|snip|more|continued|gekürzt|tronqué|cortado)[^\])>]*[\])>]*))+\s*$", regex.I)
_P = np.uint64(0x100000001B3)

# Frequent words and letters by which a text's language is told.
LANGUAGE_SIGNS = {
    "de": "der die das und ist nicht für bis mit wir den dem sie können bitte wird ä ö ü ß",
    "fr": "le la les de du est été pour à nous avec vous l’ d’ é è ê ç",
    "es": "el la los de del por que más con para según una ¿ ¡ ñ ó í",
    "pt": "os uma não você para com até às ã õ ç",
    "pl": "dla czy już na nie ż ł ś ę ą",
    "en": "the and for to of is with by on at in please are items due status",
}


def language(text: str) -> str:
    """A coarse guess at the language of the last sentences."""
    tail = text[-120:].lower()
    if (n := sum("Ѐ" <= c <= "ӿ" for c in tail)) and n * 2 > sum(c.isalpha() for c in tail):
        return "ru"
    words = set(tail.replace("’", "’ ").split()) | set(tail)
    best, score = "en", 0
    for name, signs in LANGUAGE_SIGNS.items():
        n = sum(s in words for s in signs.split(" "))
        if n > score or (n == score and name == "en"):
            best, score = name, n
    return best


def shape(text: str, common: set[str], starts: set[str]) -> str:
    """The text as the model reads it."""
    t = canonical(text)[0].rstrip()
    mark = _MARK.search(t)
    end = mark.start() if mark else len(t)

    def known(m) -> str:
        w = m.group()
        if w in common or m.start() >= end:
            return w
        # a word that breaks off as the start of a common one is no name; a small word at the end may be cut
        if m.end() == end and (w[0].islower() or w in starts):
            return w
        return WORD if w[0].islower() else NAME

    if t.isascii():
        return _DIGIT_ASCII.sub("0", _LETTERS_ASCII.sub(known, t))
    return _PICTURE.sub(PICTURE, _DIGIT.sub("0", _LETTERS.sub(known, t)))


def _settle(h: np.ndarray, order: int) -> np.ndarray:
    """The hash of a context of one order, from the running hash of its letters."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _P
        return h ^ (h >> np.uint64(29))


def _codes(shapes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in shapes], dtype=np.int64)
    return np.frombuffer("".join(shapes).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), n


def _grow(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ letter) * _P
        return h ^ (h >> np.uint64(32))


def unit_ends(codes: np.ndarray) -> np.ndarray:
    """1 where a line or sentence is complete: before a line break, and at a stop, with the closing signs after it, before
    a blank that no small letter follows."""
    one, two = np.append(codes[1:], 10), np.append(codes[2:], [10, 10])[: len(codes)]
    stop = np.isin(codes, STOPS)
    for _ in range(2):  # a stop may have two closing signs
        stop |= np.isin(codes, CLOSERS) & np.append(False, stop[:-1])
    small = ((two >= 97) & (two <= 122)) | ((two >= 0xDF) & (two < 0x100)) | ((two >= 0x430) & (two < 0x460))
    return ((one == 10) | (stop & (one == 32) & ~small) | (codes == 0x3002)).astype(np.int64)


def all_contexts(shapes: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order, the hashes of all its contexts and whether each is an end. Contexts do not cross texts."""
    codes, n = _codes(shapes)
    stop = np.cumsum(n)
    first = np.repeat(stop - n, n)
    at = np.arange(len(codes))
    ends = unit_ends(codes)
    ends[stop[n > 0] - 1] = 1
    # a closing sign before a final stop could as well have ended the text
    ends[:-1] |= np.isin(codes[:-1], CLOSERS) & np.isin(codes[1:], STOPS) & (ends[1:] == 1)
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(ORDERS[-1]):
        whole = at - k >= first
        at, first, ends, h = at[whole], first[whole], ends[whole], _grow(h[whole], codes[at[whole] - k])
        if k + 1 in ORDERS:
            yield k + 1, _settle(h, k + 1), ends


def last_contexts(shapes: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order, the ordinals of the texts that are long enough, and the hashes of their last contexts."""
    codes, n = _codes(shapes)
    end = np.cumsum(n) - 1
    who, h = np.arange(len(n)), np.zeros(len(n), dtype=np.uint64)
    for k in range(ORDERS[-1]):
        long = n[who] > k
        who, h = who[long], h[long]
        h = _grow(h, codes[end[who] - k]) if len(who) else h
        if k + 1 in ORDERS:
            yield k + 1, who, _settle(h, k + 1)


def common_words(texts: DataFrame, pattern: str = r"\p{Lu}[\p{L}\p{M}]*") -> set[str]:
    """Words of a pattern, of at least one in ``RARE`` texts, and ``LEAST``, so that more texts of a kind do not change what is common.
    Their number is at most RARE times a text's words; of more than ``WORDS``, the most frequent counts stay whole."""
    least = max(LEAST, -(-texts.count() // RARE))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("w"))
    counted = cut(words.groupBy("w").count().where(F.col("count") >= least))
    if counted.count() > WORDS:
        # as many of the greatest counts as fit; the counts are at most as many as there are kept words
        top = counted.orderBy(F.desc("count")).limit(WORDS + 1).agg(F.min("count").alias("m")).first()["m"]
        counted = counted.where(F.col("count") > top)
    return {r["w"] for r in counted.select("w").toLocalIterator()}


def truncated(values: DataFrame) -> DataFrame:
    """``(row_id, field, value, ...)`` to the rows whose value breaks off, with ``log_odds`` and ``language``.

    Null, empty and blank values are never cut off. Each row is judged alone, so repeated rows come out alike; the
    model counts a text once, however often it occurs. Other columns stay, whatever their names.
    """
    keep = [c for c in values.columns if c not in ("row_id", "field", "value")]
    extra = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.lit(None).cast("struct<c0:string>")
    rows = values.where(F.col("value").isNotNull() & (F.trim("value") != "")).select("row_id", "field", "value", extra.alias("extra"))
    # a text's least row stands for it, so that texts are not carried about
    texts = cut(rows.groupBy("field", F.col("value").alias("text")).agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    words = common_words(texts, r"\p{L}[\p{L}\p{M}]*")
    common = values.sparkSession.sparkContext.broadcast((words, {w[:i] for w in words if w[0].isupper() for i in range(1, len(w))}))

    def shapes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang = [language(t) for t in b["text"]]
            b["text"] = [shape(t, *common.value) for t in b["text"]]
            yield b.rename(columns={"text": "shape"}).assign(lang=lang)

    shaped = cut(texts.mapInPandas(shapes_of, "field string, shape string, id long, copies long, lang string"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shapes = b["shape"].tolist()
            bare = [_MARK.sub("", s) for s in shapes]
            mark = np.array([min(len(s) - len(x), 4) if len(x) > 1 else 0 for x, s in zip(bare, shapes)])
            lang = b["lang"].to_numpy()
            label = np.array([len(x if len(x) > 1 else s) <= ORDERS[-1] for x, s in zip(bare, shapes)], dtype=bool) & (b["copies"].to_numpy() >= OFTEN)
            for some, ids in ((shapes, np.arange(len(b))), ([x for x, m in zip(bare, mark) if m], np.nonzero(mark)[0])):
                for order, who, h in last_contexts(some):
                    row = b.iloc[ids[who]]
                    yield pd.DataFrame({"field": row["field"].to_numpy(), "id": row["id"].to_numpy(), "lang": lang[ids[who]], "label": label[ids[who]], "variant": mark[ids[who]] if some is not shapes else 0, "order": order, "h": h.view(np.int64)})

    last = cut(shaped.mapInPandas(ends, "field string, id long, lang string, label boolean, variant int, order int, h long"))
    # a bit map tells which contexts end some text: only those are counted
    bits = int(min(max((8 * last.count()).bit_length(), BITS[0]), BITS[1]))
    place = F.shiftrightunsigned("h", 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    marked = last.select(F.shiftrightunsigned(place, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toPandas()
    wanted = np.zeros((1 << bits) // 64, dtype=np.int64)
    wanted[marked["w"].to_numpy(dtype=np.int64)] = marked["b"].to_numpy(dtype=np.int64)
    bitmap = values.sparkSession.sparkContext.broadcast(wanted.view(np.uint64))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = bitmap.value
        for b in batches:
            for field, some in b.groupby("field"):
                size = np.cumsum(some["shape"].str.len().to_numpy()) // 1_000_000
                for piece in np.unique(size):
                    part = some[size == piece]
                    for _, h, stop in all_contexts(part["shape"].tolist()):
                        at = h >> np.uint64(64 - bits)
                        hit = (use[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                        keys, of = np.unique(h[hit], return_inverse=True)
                        ended = np.bincount(of, weights=stop[hit], minlength=len(keys)).astype(np.int64)
                        met = np.bincount(of, minlength=len(keys))
                        yield pd.DataFrame({"field": field, "h": keys.view(np.int64), "ended": ended, "met": met})

    counts = shaped.mapInPandas(count, "field string, h long, ended long, met long").groupBy("field", "h").agg(F.sum("ended").alias("ended"), F.sum("met").alias("met")).where("met > 1")
    seen = last.join(counts, ["field", "h"], "left").groupBy("field", "id", "lang", "label").agg(F.sort_array(F.collect_list(F.struct("variant", "order", F.coalesce("ended", F.lit(0)).alias("ended"), F.coalesce("met", F.lit(0)).alias("met")))).alias("seen"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["log_odds"] = [odds(s, label) for s, label in zip(b["seen"], b["label"])]
            yield b[["field", "id", "lang", "log_odds"]]

    scored = cut(seen.mapInPandas(judge, "field string, id long, lang string, log_odds double").join(texts.select("field", "id", "text"), ["field", "id"]).select("field", "text", "lang", "log_odds"))
    bins = scored.groupBy("field", "lang", F.floor(F.col("log_odds") * 5).alias("bin")).count().toPandas()
    pooled = {k: g.groupby("bin", as_index=False)["count"].sum() for k, g in bins.groupby("field")}
    limits = {k: threshold(g, pooled[k[0]]) for k, g in bins.groupby(["field", "lang"])}
    case = F.lit(CENTRE)
    for (field, lang), limit in limits.items():
        case = F.when((F.col("field") == field) & (F.col("lang") == lang), limit).otherwise(case)
    bad = scored.where(F.col("log_odds") < case)
    out = rows.join(bad, (rows["field"] == bad["field"]) & (rows["value"] == bad["text"])).select("row_id", rows["field"], "value", F.col("lang").alias("language"), "log_odds", "extra")
    return out.select("row_id", "field", "value", "language", "log_odds", *[F.col(f"extra.c{i}").alias(c) for i, c in enumerate(keep)])


def odds(seen, label: bool = False) -> float:
    """Log-odds of ending, from the counts of a text's last contexts, short to long, without the text itself.
    ``label``: a short text of many copies, which is whole unless its letters mostly go on in other texts."""
    own = [s for s in seen if s["variant"] == 0]
    bare = [s for s in seen if s["variant"] > 0]
    marked = {s["order"]: s["met"] for s in own}
    if label:
        whole = max(bare or own, key=lambda s: s["order"])
        if max(1, marked.get(whole["order"] + whole["variant"], 0) if bare else whole["ended"]) >= LABEL * whole["met"]:
            return 0.0
    if bare:
        # a mark belongs to a label if its letters seldom go on without it
        short = max((s for s in bare if s["order"] <= 6), key=lambda s: s["order"], default=None)
        with_mark = marked.get(short["order"] + short["variant"], 0) if short else 0
        if with_mark > 3 and with_mark >= LABEL * short["met"]:
            bare = []
    p, last = 0.02, -1
    for s in bare or own:
        self = 0 if bare else 1
        e, n = max(0, s["ended"] - self), max(0, s["met"] - self)
        if n >= SEEN and n != last:  # the same places count once, however long their common letters
            p, last = (e + WEIGHT * p) / (n + WEIGHT), n
    if last < 0:
        return 0.0  # letters that no other text has tell nothing
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def threshold(bins: pd.DataFrame, pooled: pd.DataFrame) -> float:
    """The emptiest place between ``LOW`` and ``HIGH`` of a group's log-odds, by one rule at every size.

    Shares count, not numbers: the group's histogram, to which the whole field adds as ``POOLED`` texts, plus a slight
    pull to ``CENTRE``, which settles empty histograms.
    """

    def shares(h: pd.DataFrame) -> dict[int, float]:
        return dict(zip(h["bin"], h["count"] / max(1, h["count"].sum())))

    own, field, size = shares(bins), shares(pooled), float(bins["count"].sum())
    share = {b: (own.get(b, 0.0) * size + p * POOLED) / (size + POOLED) for b, p in field.items()}
    spots = range(int(np.floor(LOW * 5)), int(np.floor(HIGH * 5)))
    return (min(spots, key=lambda s: sum(share.get(s + d, 0.0) for d in (-1, 0, 1)) + PULL * ((s + 0.5) / 5 - CENTRE) ** 2) + 0.5) / 5


def truncation_report(values: DataFrame) -> DataFrame:
    """``(source, field, n_rows, n_truncated, share)`` over ``(row_id, field, value, source)``; null values are no rows."""
    total = values.where("value is not null").groupBy("source", "field").agg(F.count(F.lit(1)).alias("n_rows"))
    bad = truncated(values).groupBy("source", "field").agg(F.count(F.lit(1)).alias("n"))
    both = total.join(bad, total["source"].eqNullSafe(bad["source"]) & (total["field"] == bad["field"]), "left")
    n = F.coalesce("n", F.lit(0))
    return both.select(total["source"], total["field"], "n_rows", n.alias("n_truncated"), (n / F.col("n_rows")).alias("share"))
