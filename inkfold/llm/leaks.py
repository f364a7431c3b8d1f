"""Problem 9: documents that contain passages of evaluation items.

Texts become words without case and punctuation. Each window of ``words`` words of a document walks through the CGK
embedding: at step t the word under the pointer is written out, and a random bit of (t, word) says whether the pointer
moves on. Windows that differ by few edits meet again after few steps, so edit distance turns into Hamming distance,
and a sample of the written places is a locality-sensitive key. As many walks with own random bits and samples are made
as reach the wanted recall on windows perturbed by the allowed number of edits; equal windows are equal in every walk,
so without edits one walk has recall 1. Every meeting is verified on the words themselves.

The keys of up to ``BLOCK`` windows of items go to every task as one broadcast value; those of more items are joined
with the documents' keys as tables, and the texts come to the meetings that are left. Either way the documents are
read once.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.session import cut

BLOCK = 1_000_000  # item windows times walks that are broadcast: 8 bytes of key and 8 of place each
TRIALS = 2_000  # perturbed windows on which recall is measured
_ODD = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: Column) -> Column:
    """Words without case, apostrophes dropped and all other punctuation, marks and spacing as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "['’‘ʼ`´]", ""), r"[^\p{L}\p{M}\p{N}]+", " "))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _ODD
        return h ^ (h >> np.uint64(29))


@lru_cache(64)
def repetitions(words: int, edits: int, sample: int, recall: float) -> int:
    """Walks of which at least one gives the same key to a window and to the same window after ``edits`` random edits,
    in a share ``recall`` of TRIALS windows of different words."""
    if edits == 0:
        return 1
    rng = random.Random(words * 1000 + edits)
    word = lambda: f"{rng.getrandbits(40):x}"
    one, two = [], []
    for _ in range(TRIALS):
        a = [word() for _ in range(words)]
        b = [*a, *(word() for _ in range(edits))]
        for _ in range(edits):
            j = rng.randrange(words)
            b[j : j + 1] = rng.choice([[], [word()], [b[j], word()]])
        one.append(" ".join(a))
        two.append(" ".join([*b, *(word() for _ in range(edits))][:words]))
    (_, h, _, at), (_, g, _, to) = windows(one, words), windows(two, words)
    met, n = np.zeros(TRIALS, dtype=bool), 0
    while met.mean() < recall:
        met |= walk_keys(h, at, at + words, words, sample, n) == walk_keys(g, to, to + words, words, sample, n)
        n += 1
    return n


def walk_keys(h: np.ndarray, start: np.ndarray, end: np.ndarray, words: int, sample: int, walk: int) -> np.ndarray:
    """Keys of the windows at ``start`` (ends exclusive) over word hashes ``h``, for one walk."""
    rng = np.random.default_rng(7919 * walk + 17)
    steps = 3 * words
    taken = set(rng.choice(steps * 2 // 3, size=min(sample, steps * 2 // 3), replace=False).tolist())
    own = _mix(h ^ np.uint64(walk * int(_ODD) % (1 << 64)))
    bits = _mix(own ^ _ODD)
    at, key, pad = start.copy(), np.zeros(len(start), dtype=np.uint64), np.uint64(1)
    own, bits = np.append(own, pad), np.append(bits, np.uint64(0))
    for t in range(max(taken) + 1):
        here = np.where(at < end, at, len(h))
        if t in taken:
            key = _mix(key ^ own[here])
        at += ((bits[here] >> np.uint64(t % 64)) & np.uint64(1)).astype(at.dtype)
    return key


def windows(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, their hashes, and each window's text and first word."""
    n = np.array([t.count(" ") + 1 if t else 0 for t in texts], dtype=np.int64)
    every = np.array(" ".join(t for t in texts if t).split(" ") if n.sum() else [], dtype=object)
    h = pd.util.hash_array(every, categorize=True) if len(every) else np.zeros(0, dtype=np.uint64)
    count = np.maximum(n - words + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(n) - n, count)
    return every, h, owner, start


def edits_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether a prefix of b is at most ``most`` word edits from a; banded."""
    far = most + 1
    d = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            row[j] = i if j == 0 else min(d.get(j - 1, far) + (x != b[j - 1]), d.get(j, far) + 1, row.get(j - 1, far) + 1)
        d = row
        if not d or min(d.values()) > most:
            return False
    return min(d.values()) <= most


def leaks(docs: DataFrame, items: DataFrame, words: int = 13, edits: int = 0, recall: float = 0.95, sample: int = 6, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(doc, item)``: each document and item such that a window of ``words`` words of the item stands in the document
    with at most ``edits`` words inserted, deleted or replaced. Each pair comes once.

    Null and empty texts and items of fewer words match nothing; repeated rows give one pair; other columns are dropped.
    """
    item_rows = items.select(F.col(item_col).alias("item"), plain_words(F.col(text_col)).alias("t")).where(F.size(F.split("t", " ")) >= words).distinct()
    doc_rows = docs.select(F.col(doc_col).alias("doc"), plain_words(F.col(text_col)).alias("t")).where(F.size(F.split("t", " ")) >= words - edits)
    walks = repetitions(words, edits, sample, recall)
    item_rows = cut(item_rows)
    size = item_rows.agg(F.coalesce(F.sum(F.size(F.split("t", " ")) + (1 - words)), F.lit(0)).alias("n")).first()["n"]
    doc_type, item_type = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    if size * walks <= BLOCK:
        block = item_rows.toPandas()
        ids = block["item"].tolist()
        every, h, owner, start = windows(block["t"].tolist(), words)
        tables = []
        for w in range(walks):
            keys = walk_keys(h, start, start + words, words, sample, w)
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], order))
        shared = docs.sparkSession.sparkContext.broadcast((tables, ids, every, owner, start, signatures(h, start, start + words, words)))
        found = doc_rows.mapInPandas(_finder(shared, words, edits, sample), f"doc {doc_type}, item {item_type}")
    else:
        found = _joined(doc_rows, item_rows, words, edits, sample, walks, doc_type, item_type)
    return found.distinct().select(F.col("doc").alias(doc_col), F.col("item").alias(item_col))


def _pieces(b: pd.DataFrame, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows of a batch in pieces of at most so many letters, or of one text."""
    size = np.cumsum(b["t"].str.len().to_numpy()) // most
    for p in np.unique(size):
        yield b[size == p]


def _doc_windows(texts: list[str], words: int, edits: int):
    """A document's windows may be cut short by its end as far as words may be missing."""
    every, h, owner, start = windows(texts, max(1, words - edits))
    last = np.cumsum([t.count(" ") + 1 for t in texts])
    return every, h, owner, start, np.minimum(start + words, last[owner]), last


def _joined(docs: DataFrame, items: DataFrame, words: int, edits: int, sample: int, walks: int, doc_type: str, item_type: str) -> DataFrame:
    """The same by a join on the keys of each walk; keys of many windows are split by the join's skew handling."""

    def emit(whose: str):
        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for some in _pieces(b):
                    ids, texts = some[whose].to_numpy(), some["t"].tolist()
                    _, h, owner, start, end, last = _doc_windows(texts, words, edits if whose == "doc" else 0)
                    if not len(start):
                        continue
                    first = last[owner] - np.array([t.count(" ") + 1 for t in texts])[owner]
                    for w in range(walks):
                        key = walk_keys(h, start, end, words, sample, w)
                        yield pd.DataFrame({"walk": w, "key": key.view(np.int64), whose: ids[owner], whose[0]: (start - first).astype(np.int32)})

        return keys

    d = docs.mapInPandas(emit("doc"), f"walk int, key long, doc {doc_type}, d int")
    i = items.mapInPandas(emit("item"), f"walk int, key long, item {item_type}, i int")
    met = cut(d.join(i, ["walk", "key"]).select("doc", "item", "d", "i").distinct())

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for x, y, at, to in zip(b["ti"], b["td"], b["i"], b["d"]):
                good.append(edits_within(x.split(" ")[at : at + words], y.split(" ")[to : to + words + edits], edits))
            yield b.loc[good, ["doc", "item"]]

    texts = met.join(docs.withColumnRenamed("t", "td"), "doc").join(items.withColumnRenamed("t", "ti"), "item")
    return texts.select("doc", "item", "d", "i", "td", "ti").mapInPandas(verify, f"doc {doc_type}, item {item_type}")


def signatures(h: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """A bit map of 64 of the words of each window of ``length`` words that is cut short at its end."""
    bit = np.append(np.uint64(1) << (_mix(h) >> np.uint64(58)), np.uint64(0))
    out = np.zeros(len(start), dtype=np.uint64)
    for k in range(length):
        at = start + k
        out |= bit[np.where(at < end, at, len(h))]
    return out


def _finder(shared, words: int, edits: int, sample: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, ids, item_words, item_of, item_start, item_sig = shared.value
        for b in batches:
            for some in _pieces(b):
                docs = some["doc"].to_numpy()
                every, h, owner, start, end, last = _doc_windows(some["t"].tolist(), words, edits)
                sig = signatures(h, start, last[owner], words + edits) if edits else None
                pairs, tried = set(), np.zeros(0, dtype=np.int64)
                for w, (keys, place) in enumerate(tables):
                    if not len(keys):
                        continue
                    key = walk_keys(h, start, end, words, sample, w)
                    lo = np.searchsorted(keys, key, "left")
                    hit = np.nonzero(keys[np.minimum(lo, len(keys) - 1)] == key)[0]
                    n = np.searchsorted(keys, key[hit], "right") - lo[hit]
                    i = np.repeat(hit, n)
                    j = place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)]
                    if edits:
                        # an edit takes one word of the item's away at most; meetings of earlier walks are settled
                        near = np.bitwise_count(item_sig[j] & ~sig[i]) <= edits
                        i, j = i[near], j[near]
                        meeting = np.unique(i * len(item_start) + j)
                        meeting = meeting[~np.isin(meeting, tried)]
                        tried = np.union1d(tried, meeting)
                        i, j = meeting // len(item_start), meeting % len(item_start)
                    for x_, y_ in zip(i.tolist(), j.tolist()):
                        pair = (owner[x_], item_of[y_])
                        if pair in pairs:
                            continue
                        x = item_words[item_start[y_] : item_start[y_] + words].tolist()
                        y = every[start[x_] : min(start[x_] + words + edits, last[owner[x_]])].tolist()
                        if x == y[:words] or (edits and edits_within(x, y, edits)):
                            pairs.add(pair)
                yield pd.DataFrame({"doc": [docs[a] for a, _ in pairs], "item": [ids[b_] for _, b_ in pairs]})

    return find
