"""Distances between short texts, Arrow-batched where Spark has none."""

from __future__ import annotations

import difflib
import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rows of a keyboard, each with the offset of its first key in key widths.
KEY_ROWS = (("`1234567890-=", 0.0), ("qwertyuiop[]\\", 0.25), ("asdfghjkl;'", 0.5), ("zxcvbnm,./", 1.0))
NEAR_KEY, SWAP = 0.55, 0.65


@lru_cache(1)
def key_places() -> dict[str, tuple[int, int]]:
    return {c: (i, j) for i, (row, _) in enumerate(KEY_ROWS) for j, c in enumerate(row)}


def adjacent_keys(a: str, b: str) -> bool:
    """Whether two keys touch on the grid of rows and columns."""
    p, q = key_places().get(a), key_places().get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


@lru_cache(200_000)
def typing_distance(a: str, b: str) -> float:
    """Edit distance with cheap neighbouring keys and cheap swaps of adjacent letters."""
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            sub = row[j - 1] + (0.0 if x == y else NEAR_KEY if adjacent_keys(x, y) else 1.0)
            best = min(sub, row[j] + 1.0, new[j - 1] + 1.0)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + SWAP)
            new.append(best)
        before, row = row, new
    return row[-1]


def ratio(a: str, b: str) -> float:
    """Matching-blocks similarity of the new text ``a`` and the earlier ``b``; the order matters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


_FEATURE = re.compile(r"[\w<>']+")


def simhashes(texts: list[str | None]) -> list[int | None]:
    """64-bit similarity hashes as signed longs: each bit is the majority of the hashes of a text's tokens and adjacent
    pairs. A text without tokens has all bits set."""
    features, sizes = [], []
    for t in texts:
        tokens = _FEATURE.findall(t or "")
        features += tokens + [f"{x} {y}" for x, y in zip(tokens, tokens[1:])]
        sizes.append(max(0, 2 * len(tokens) - 1))
    digests = b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features)
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
    size = np.array(sizes, dtype=np.int64)
    ends = np.cumsum(size)
    sums = np.concatenate([np.zeros((1, 64), dtype=np.int64), np.cumsum(bits, axis=0, dtype=np.int64)])
    ones = sums[ends] - sums[ends - size]
    major = np.packbits(2 * ones >= size[:, None], axis=1).view(">i8").ravel() if len(texts) else []
    return [None if t is None else int(v) for t, v in zip(texts, major)]


def simhash(text: str | None) -> int | None:
    return simhashes([text])[0]


def _pairs(f, kind: str):
    def both(a: Column, b: Column) -> Column:
        return F.pandas_udf(lambda x, y: pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)]), kind)(a, b)

    return both


typing_distance_of = _pairs(typing_distance, "double")
ratio_of = _pairs(ratio, "double")


def simhash_of(text: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(simhashes(s.tolist()), dtype="Int64"), "long")(text)
