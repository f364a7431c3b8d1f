"""Edit-distance segment join over all texts, exact, without pairs of hot groups on the wire.

Two texts match when at most ``len(longer) // 10`` insertions, deletions and replacements turn one into the other.
With k edits allowed, the longer text is cut into k + 1 disjoint segments of which one must survive unchanged in the
shorter one, at most k places away. Segments are as long as k + 1 of them fit into the shortest text of their class of
lengths. Any cut will do, so each text is cut where its segments are rarest: a count sketch of all segments of the
corpus steers a dynamic program. The shorter text offers its substrings of the segment length of each class that may
hold a partner, but only those that a bit map of all cuts has. Segments meet in shards of bounded size; a frequent
segment is split into square tiles. Survivors of the position, length and bag-of-letters bounds are verified by banded
dynamic programming. Sketch and bit map grow with the corpus up to a fixed size, beyond which they only tell less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.session import cut

#: Letters of a segment of texts from so many letters on: k + 1 segments must fit into the shortest of a class.
CLASSES = ((10, 5), (20, 6), (30, 7))
SKETCH_BITS = (16, 20)  # least and most bits of the count sketch: at most 8 MB on the driver, 4 MB in each task
MAP_BITS = (16, 22)  # of the bit map of cuts: at most half a megabyte
TILE = 20_000  # most rows of one side of one segment in a shard
SHARD = 150_000  # rows aimed at in a shard
CHUNK = 1_000_000  # candidate pairs looked at together
LONG = 400  # beyond this length, the cut takes the rarest segment of each of k + 1 equal blocks
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def allowed(length):
    """Edits allowed between two texts of which the longer has this length."""
    return length // 10


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points in a row, with each text's start and length."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else n, n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def segment_length(n: np.ndarray) -> np.ndarray:
    """The segment length of texts of these lengths; 0 for texts that match only themselves."""
    out = np.zeros(len(n), dtype=np.int64)
    for low, q in CLASSES:
        out[n >= low] = q
    return out


def may_probe(n: np.ndarray, q: int) -> np.ndarray:
    """Whether texts of these lengths may match a longer or equally long one of the class of segment length ``q``."""
    i = [x for _, x in CLASSES].index(q)
    low, high = CLASSES[i][0], CLASSES[i + 1][0] if i + 1 < len(CLASSES) else np.iinfo(np.int64).max
    least = np.maximum(n, low)
    return (least < high) & (least - allowed(least) <= n)


def segments(codes: np.ndarray, start: np.ndarray, n: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each substring of ``q`` letters: the text's ordinal, its position, its hash."""
    count = np.maximum(n - q + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, h = np.repeat(start, count) + pos, np.full(count.sum(), q, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h = _mix((h + codes[at + i].astype(np.uint64) + np.uint64(1)) * _A)
    return owner, pos, h


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _bits(limits: tuple[int, int], number: int) -> int:
    return int(min(max(int(number).bit_length(), limits[0]), limits[1]))


CHUNKS = 1024  # parts of a sketch that are added up apart


def sketch(texts: DataFrame, bits: int) -> np.ndarray:
    """How often each bucket's segments occur, over all texts, in 2^bits counts. They travel as bytes, not as rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for _, some in pieces(batches):
            codes, start, n = letters(some.tolist())
            for _, q in CLASSES:
                who = np.nonzero(may_probe(n, q))[0]
                total += np.bincount(bucket(segments(codes, start[who], n[who], q)[2], bits), minlength=len(total))
        parts = total.reshape(CHUNKS, -1)
        used = np.nonzero(parts.any(axis=1))[0]
        yield pd.DataFrame({"chunk": used, "part": [p.astype(np.int32 if p.max() < 2**31 else np.int64).tobytes() for p in parts[used]]})

    size = (1 << bits) // CHUNKS

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, dtype=np.int64)
        for p in g["part"]:
            total += np.frombuffer(p, dtype=np.int32 if len(p) == 4 * size else np.int64)
        return pd.DataFrame({"chunk": g["chunk"].iloc[:1], "part": [total.tobytes()]})

    out = np.zeros((CHUNKS, size), dtype=np.int64)
    for r in texts.mapInPandas(count, "chunk long, part binary").groupBy("chunk").applyInPandas(add, "chunk long, part binary").collect():
        out[r["chunk"]] = np.frombuffer(r["part"], dtype=np.int64)
    return out.ravel()


def pivot_map(texts: DataFrame, shared, bits: int) -> np.ndarray:
    """A bit map of the hashes at which texts are cut, as bytes: 2^bits bits, put together by words of 64."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(1 << bits, dtype=bool)
        for _, some in pieces(batches):
            for _, _, h, cut_here, _ in offers(some.tolist(), shared.value):
                mine[bucket(h[cut_here], bits)] = True
        words = np.packbits(mine).view(np.int64)
        used = np.nonzero(words)[0]
        yield pd.DataFrame({"word": used, "bits": words[used]})

    out = np.zeros((1 << bits) // 64, dtype=np.int64)
    rows = texts.mapInPandas(mark, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def offers(texts: list[str], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each class: the text's ordinal, the position and the hash of each segment of texts that may have a partner
    there, and the ordinals of those segments at which texts of the class are cut."""
    codes, start, n = letters(texts)
    own = segment_length(n)
    for _, q in CLASSES:
        who = np.nonzero(may_probe(n, q))[0]
        owner, pos, h = segments(codes, start[who], n[who], q)
        yield who[owner], pos, h, pivots(n[who], own[who] == q, h, counts, q), q


def cuts(cost: np.ndarray, n: np.ndarray, k: int, q: int) -> np.ndarray:
    """For texts with k edits allowed: positions of k + 1 disjoint segments of least total cost.

    ``cost`` is a matrix of texts by positions, infinite where no segment starts.
    """
    rows, width = cost.shape
    best = np.full((k + 2, width + q + 1, rows), np.inf, dtype=np.float32)
    best[0] = 0
    by_pos = np.ascontiguousarray(cost.T)
    for i in range(width):
        # best[m][i + q]: m segments that end at or before i + q
        np.minimum(best[1:, i + q - 1], best[:-1, i] + by_pos[i], out=best[1:, i + q])
    out = np.zeros((rows, k + 1), dtype=np.int64)
    at, left, who = np.full(rows, width + q - 1), np.full(rows, k + 1), np.arange(rows)
    for i in range(width - 1, -1, -1):
        live = (left > 0) & (at >= i + q)
        take = live & (best[left, i + q, who] < best[left, i + q - 1, who])
        out[who[take], left[take] - 1] = i
        left[take] -= 1
        at[take] = i
    return out


def pivots(n: np.ndarray, mine: np.ndarray, h: np.ndarray, counts: np.ndarray, q: int) -> np.ndarray:
    """Ordinals, among all segments of texts of these lengths, of those at which the texts of ``mine`` are cut."""
    first = np.concatenate([[0], np.cumsum(np.maximum(n - q + 1, 0))])
    rarity = np.log1p(counts[bucket(h, len(counts).bit_length() - 1)].astype(np.float64))
    out = []
    ks = np.where(mine, allowed(n), 0)
    for k in np.unique(ks[ks > 0]):
        who = np.nonzero((ks == k) & (n <= LONG))[0]
        if len(who):
            cost = np.full((len(who), int(n[who].max()) - q + 1), np.inf, dtype=np.float32)
            for j, t in enumerate(who):
                # the square makes one frequent segment cost more than several rare ones
                cost[j, : n[t] - q + 1] = np.expm1(rarity[first[t] : first[t + 1]]) + 0.01
            out.append((first[who][:, None] + cuts(cost, n[who], int(k), q)).ravel())
    for t in np.nonzero((ks > 0) & (n > LONG))[0]:
        edges = np.linspace(0, n[t], ks[t] + 2).astype(int)
        r = rarity[first[t] : first[t + 1]]
        out.append(np.array([first[t] + a + int(np.argmin(r[a : max(a + 1, b - q + 1)])) for a, b in zip(edges[:-1], edges[1:])]))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def within(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of rows is at most its k; a has the shorter texts. Banded, a band of 2k + 1."""
    ok = np.zeros(len(na), dtype=bool)
    if not len(na):
        return ok
    w, far = int(k.max()), np.int32(1 << 20)
    off = np.arange(2 * w + 1, dtype=np.int32)
    live = np.arange(len(na))
    pad = np.zeros((len(b), w), dtype=b.dtype)
    wide = np.concatenate([pad, b, np.zeros((len(b), w + max(0, a.shape[1] - b.shape[1]) + 1), dtype=b.dtype)], axis=1)
    d = np.where(off >= w, off - w, far) + np.zeros((len(na), 1), dtype=np.int32)  # row 0: j = off - w
    for i in range(int(na.max()) + 1):
        done = na[live] == i
        if done.any():
            e = live[done]
            ok[e] = d[done, nb[e] - na[e] + w] <= k[e]
            live, d = live[~done], d[~done]
        if i % 8 == 7:
            keep = d.min(axis=1) <= k[live]
            live, d = live[keep], d[keep]
        if not len(live):
            break
        j = off + (i + 1 - w)
        diag = d + (wide[live, i + 1 - 1 : i + 1 + 2 * w] != a[live, i][:, None])
        up = np.concatenate([d[:, 1:], np.full((len(live), 1), far, dtype=np.int32)], axis=1) + 1
        t = np.minimum(diag, up)
        t[:, j < 0] = far
        t[:, j == 0] = i + 1
        d = np.minimum.accumulate(t - off, axis=1) + off
    return ok


def bags(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two bit maps of each text, of letters and of pairs of letters, in unary counts; an edit changes at most 2 and 4 bits."""
    owner = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), 8), dtype=np.uint64)
    last = np.zeros(len(codes), dtype=bool)
    last[(start + n)[n > 0] - 1] = True
    single = (codes.astype(np.int64) * 2654435761 >> 7) % 64
    single[(codes >= 97) & (codes < 123)] = codes[(codes >= 97) & (codes < 123)] - 97
    double = (codes[:-1].astype(np.int64) * 31 + codes[1:]) * 2654435761 >> 11
    for kind, slot, who in ((0, single % 64, owner), (1, (double % 128)[~last[:-1]] if len(codes) else single, owner[:-1][~last[:-1]] if len(codes) else owner)):
        width = 64 if kind == 0 else 128
        tally = np.bincount(who * width + slot, minlength=len(n) * width).reshape(len(n), width)
        for depth in range(4 if kind == 0 else 2):
            bits = np.packbits(tally > depth, axis=1, bitorder="little").view(np.uint64)
            at = depth if kind == 0 else 4 + 2 * depth
            out[:, at : at + bits.shape[1]] = bits
    return out


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def match_shard(rows: pd.DataFrame, forest: bool) -> pd.DataFrame:
    """Pairs (a, b) of ids in one shard that match. With ``forest``, only enough of them to connect what they connect."""
    ids, first = np.unique(rows["id"].to_numpy(), return_index=True)
    texts = [t or "" for t in rows["text"].to_numpy()[first].tolist()]
    codes, start, _ = letters(texts)
    n, have = rows["n"].to_numpy().astype(np.int64)[first], np.array([len(t) for t in texts], dtype=np.int64)
    me = np.searchsorted(ids, rows["id"].to_numpy())
    pivot = rows["pivot"].to_numpy(dtype=bool)
    key, pos = rows["key"].to_numpy(), rows["pos"].to_numpy().astype(np.int64)
    order = np.lexsort((pos[pivot], key[pivot]))
    ik, ip, im = key[pivot][order], pos[pivot][order], me[pivot][order]
    names, ik = np.unique(ik, return_inverse=True)
    slot = np.searchsorted(names, key)
    slot = np.where((slot < len(names)) & (names[np.minimum(slot, max(len(names) - 1, 0))] == key) if len(names) else False, slot, -1)
    probe = ~pivot & (slot >= 0)
    pk, pp, pm = slot[probe].astype(np.int64), pos[probe], me[probe]
    reach = allowed(n[im].max()) if len(im) else 0
    span = int(max(ip.max(initial=0), pp.max(initial=0))) + reach + 2
    where = ik.astype(np.int64) * span + ip
    lo = np.searchsorted(where, pk * span + np.maximum(pp - reach, 0), "left")
    hi = np.searchsorted(where, pk * span + np.minimum(pp + reach, span - 1), "right")
    size = hi - lo
    sig = bags(codes, start, have)
    sent = [i for i, x in enumerate(rows["sig"].to_numpy()[first]) if x is not None]
    for i in sent:  # a long text stayed behind; its bit maps came along
        sig[i] = np.frombuffer(rows["sig"].to_numpy()[first[i]], dtype=np.uint64)
    wide = int(have.max(initial=0))
    whole = np.zeros((len(n), wide), dtype=np.uint32)
    whole[np.repeat(np.arange(len(n)), have), np.arange(len(codes)) - np.repeat(start, have)] = codes
    label, left, right, open_ = np.arange(len(n)), [], [], []
    total, p0 = np.concatenate([[0], np.cumsum(size)]), 0
    while p0 < len(size):
        p1 = max(p0 + 1, int(np.searchsorted(total, total[p0] + CHUNK, "right")) - 1)
        c = size[p0:p1]
        who = np.repeat(np.arange(p0, p1), c)
        s_at = np.arange(total[p1] - total[p0]) - np.repeat(total[p0:p1] - total[p0], c) + lo[who]
        r, s, shift = pm[who], im[s_at], np.abs(pp[who] - ip[s_at])
        p0 = p1
        k = allowed(n[s])
        keep = (shift <= k) & (n[s] - n[r] <= k) & ((n[r] < n[s]) | ((n[r] == n[s]) & (r < s)))
        if forest:
            keep &= label[r] != label[s]
        r, s, k = r[keep], s[keep], k[keep]
        long = n[s] > LONG
        if long.any():  # two long texts meet at many places: each pair once
            once = np.unique(r[long] * len(n) + s[long])
            r, s = np.concatenate([r[~long], once // len(n)]), np.concatenate([s[~long], once % len(n)])
            k = allowed(n[s])
        x = np.bitwise_count(sig[r, :4] ^ sig[s, :4]).sum(axis=1)
        r, s, k = (v[x <= 2 * k] for v in (r, s, k))
        x = np.bitwise_count(sig[r, 4:] ^ sig[s, 4:]).sum(axis=1)
        r, s, k = (v[x <= 4 * k] for v in (r, s, k))
        later = n[s] > LONG  # verified after the shards, on the texts
        open_.append(np.unique(r[later] * len(n) + s[later]))
        r, s, k = r[~later], s[~later], k[~later]
        if not len(r):
            continue
        pair = np.unique(r * len(n) + s)
        r, s = pair // len(n), pair % len(n)
        k = allowed(n[s])
        step = max(1, 20_000_000 // max(1, wide + 4 * int(k.max(initial=0))))
        for at in range(0, len(r), step):
            i, j, e = r[at : at + step], s[at : at + step], k[at : at + step]
            if forest:
                fresh = label[i] != label[j]
                i, j, e = i[fresh], j[fresh], e[fresh]
            good = within(whole[i], n[i], whole[j], n[j], e)
            i, j = i[good], j[good]
            if forest and len(i):
                parent = label.copy()
                for a, b in zip(i.tolist(), j.tolist()):
                    a_, b_ = _root(parent, a), _root(parent, b)
                    if a_ != b_:
                        parent[max(a_, b_)] = min(a_, b_)
                        left.append(a)
                        right.append(b)
                while (parent != (up := parent[parent])).any():
                    parent = up
                label = parent
            else:
                left += i.tolist()
                right += j.tolist()
    pair = np.unique(np.array([left, right], dtype=np.int64).reshape(2, -1), axis=1)
    rest = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *open_]))
    return pd.DataFrame({"a": np.concatenate([ids[pair[0]], ids[rest // max(1, len(n))]]), "b": np.concatenate([ids[pair[1]], ids[rest % max(1, len(n))]]), "sure": np.arange(pair.shape[1] + len(rest)) < pair.shape[1]})


def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pairs with both texts, those that match; pairs of long texts one by one."""
    for b in batches:
        good = []
        for x, y in zip(b["ta"], b["tb"]):
            x, y = sorted((x, y), key=len)
            (ca, _, na), (cb, _, nb) = letters([x]), letters([y])
            good.append(bool(within(ca[None, :], na, cb[None, :], nb, allowed(nb))[0]))
        yield b.loc[good, ["a", "b"]]


def pieces(batches: Iterator[pd.DataFrame], most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and texts in pieces of at most so many letters, or of one text."""
    for b in batches:
        ids, texts = b["id"].to_numpy(), b["text"].to_numpy()
        size = np.cumsum([len(t) for t in texts]) // most
        for p in np.unique(size):
            yield ids[size == p], texts[size == p]


def edit_links(texts: DataFrame, forest: bool = True) -> DataFrame:
    """``(id, text)``, one row per different text, to ``(a, b)``: ids of matching texts.

    With ``forest``, the pairs of a shard that only close circles are left out: classes are the same. Without, all pairs
    come out (once or more). Null texts match nothing; texts under ten letters match only themselves.
    """
    texts = texts.select("id", "text").where(F.col("text").isNotNull())
    size = texts.agg(F.sum(F.length("text")).alias("letters"), F.count(F.lit(1)).alias("n")).first()
    bits = _bits(SKETCH_BITS, size["letters"] or 0)
    counts = sketch(texts, bits)
    shared = texts.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max(initial=0) < 2**31 else counts)
    map_bits = _bits(MAP_BITS, 8 * ((size["letters"] or 0) // 10 + size["n"]))
    marked = texts.sparkSession.sparkContext.broadcast(pivot_map(texts, shared, map_bits))
    shards = max(1, int(counts.sum() // SHARD))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, has_cut = shared.value, np.unpackbits(marked.value).astype(bool)
        for ids, texts_ in pieces(batches):
            _, _, n = letters(texts_.tolist())
            carried = np.where(n > LONG, None, texts_)
            sig = np.full(len(n), None, dtype=object)
            for i in np.nonzero(n > LONG)[0]:
                sig[i] = bags(*letters([texts_[i]])).tobytes()
            for owner, pos, h, at_cut, _ in offers(texts_.tolist(), seen):
                probes = np.nonzero(has_cut[bucket(h, map_bits)])[0]
                take = np.concatenate([at_cut, probes])
                is_pivot = np.arange(len(take)) < len(at_cut)
                # a bucket that was met once in the corpus has no partner
                met = seen[bucket(h[take], bits)].astype(np.int64)
                take, is_pivot, met = take[met > 1], is_pivot[met > 1], met[met > 1]
                tiles = -(-met // TILE)
                of = np.repeat(np.arange(len(take)), tiles)
                other = np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                take, is_pivot, tiles = take[of], is_pivot[of], tiles[of]
                with np.errstate(over="ignore"):
                    own = (_mix(ids[owner[take]].astype(np.uint64) * _A) % tiles.astype(np.uint64)).astype(np.int64)
                    tile = np.where(is_pivot, own * tiles + other, other * tiles + own)
                    shard = _mix(h[take] + tile.astype(np.uint64) * _A) % np.uint64(shards)
                for at in range(0, len(take), 200_000):
                    x = slice(at, at + 200_000)
                    who = owner[take[x]]
                    yield pd.DataFrame({"shard": shard[x].astype(np.int64), "key": h[take[x]].view(np.int64), "pivot": is_pivot[x], "pos": pos[take[x]].astype(np.int32), "id": ids[who], "n": n[who].astype(np.int32), "text": carried[who], "sig": sig[who]})

    rows = texts.mapInPandas(emit, "shard long, key long, pivot boolean, pos int, id long, n int, text string, sig binary")
    found = cut(rows.groupBy("shard").applyInPandas(lambda g: match_shard(g, forest), "a long, b long, sure boolean").distinct())
    ta, tb = (texts.select(F.col("id").alias(x), F.col("text").alias("t" + x)) for x in "ab")
    late = found.where("not sure").select("a", "b").join(ta, "a").join(tb, "b").mapInPandas(verify, "a long, b long")
    return found.where("sure").select("a", "b").union(late)
