"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary, and decoding it, inside the JVM.

A document is cut into words by the vocabulary's pattern. A word that is a token itself, as most are, is looked up
where it stands. Every other distinct word is encoded once: its bytes, in hexadecimal, are folded by a higher-order
function that merges, in each step, all occurrences of the adjacent pair of least rank. Only those words and their
places are shuffled, so a frequent word costs nothing unless it is no token, and then the join's skew handling splits it.

The rank map is an array of slots, each token in one of two that its hash names, so that a lookup reads two slots,
whatever the vocabulary's size, and compares the whole key. It enters the plan as one scalar value.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cuts a text into words; a fixed value that belongs to the vocabulary.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 2**31 - 1  # above all ranks


@lru_cache(4)
def load_ranks(path: str) -> tuple[tuple[str, int], ...]:
    """Tokens, as hexadecimal digits of their bytes, with their ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return tuple((base64.b64decode(a).hex().upper(), int(b)) for a, b in (line.split() for line in f if line.strip()))


def _places(key: str, slots: int) -> tuple[int, int]:
    h = xxhash.xxh64(key.encode(), seed=42).intdigest()
    return h % slots if h < 1 << 63 else (h - (1 << 64)) % slots, (h >> 40) % slots


@lru_cache(4)
def slot_table(ranks: tuple[tuple[str, int], ...]) -> tuple[tuple[str | None, int | None], ...]:
    """Every token in one of its two slots, by moving tokens until each has one."""
    slots = 1 << max(4, (3 * len(ranks)).bit_length())
    while True:
        table: list[tuple[str, int] | None] = [None] * slots
        for entry in ranks:
            at, moves = _places(entry[0], slots)[0], 0
            while entry is not None and moves < 500:
                table[at], entry = entry, table[at]
                if entry is not None:
                    a, b = _places(entry[0], slots)
                    at, moves = (b if at == a else a), moves + 1
            if entry is not None:
                break
        else:
            return tuple(e or (None, None) for e in table)
        slots *= 2


def _rank(table: Column, key: Column, slots: int) -> Column:
    h = F.xxhash64(key)
    one = F.get(table, F.pmod(h, F.lit(slots)).cast("int"))
    two = F.get(table, F.pmod(F.shiftrightunsigned(h, 40), F.lit(slots)).cast("int"))
    return F.when(one["key"] == key, one["rank"]).when(two["key"] == key, two["rank"])


def _scalar(spark: SparkSession, ranks) -> tuple[Column, int]:
    table = slot_table(ranks)
    df = spark.createDataFrame([([*table],)], "t array<struct<key string, rank int>>")
    return df.scalar(), len(table)


def _parts(marked: Column) -> Column:
    """The pieces of a word, which stand marked off as <..><..>."""
    return F.split(F.regexp_replace(marked, "^<|>$", ""), "><", -1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _join(p: Column, a: Column, b: Column) -> Column:
    return F.replace(p, F.concat(F.lit("<"), a, F.lit("><"), b, F.lit(">")), F.concat(F.lit("<"), a, b, F.lit(">")))


def _fold(word: Column, table: Column, slots: int) -> Column:
    """Ranks of the tokens of one word given in hexadecimal digits."""
    def merged(p: Column, t: Column) -> Column:
        def by_pieces(x: Column) -> Column:
            keys = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.concat(a, b))
            ranks = F.transform(keys, lambda k: F.coalesce(_rank(t, k, slots), F.lit(NONE)))
            return _let(ranks, lambda r: _let(F.array_min(r), lambda least: F.when(least == NONE, F.concat(F.lit("!"), p)).otherwise(_let(F.array_position(r, least).cast("int"), lambda i: _join(p, F.get(x, i - 1), F.get(x, i))))))

        return _let(_parts(p), lambda x: F.when(F.size(x) < 2, F.concat(F.lit("!"), p)).otherwise(by_pieces(x)))

    def step(p: Column, t: Column) -> Column:
        return F.when(p.startswith("!"), p).otherwise(merged(p, t))  # a leading ! marks a finished word

    def folded(w: Column, t: Column) -> Column:
        n = (F.length(w) / 2).cast("int")
        start = F.concat(F.when(n < 2, "!").otherwise(""), F.regexp_replace(w, "(..)", "<$1>"))
        # the table stays outside the folded state, which is copied at every step
        return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, lambda p, _: step(p, t), lambda p: F.transform(_parts(F.ltrim(p, F.lit("!"))), lambda x: _rank(t, x, slots)))

    return _let(F.struct(word.alias("w"), table.alias("t")), lambda s: folded(s["w"], s["t"]))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", out: str = "ids") -> DataFrame:
    """``(id, out)`` with one row for each row of ``docs``; other columns are dropped, whatever their names.

    Null and empty texts give the empty list. A repeated row gives as many equal rows; rows of one id and different
    texts are told apart by text. Special tokens are ordinary text. The path names a ``.tiktoken`` file of ranks.
    """
    spark = docs.sparkSession
    ranks = load_ranks(path)
    table, slots = _scalar(spark, ranks)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PATTERN), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words.alias("words"), table.alias("table"))
    both = F.array(F.struct("words", "table"))  # one reference to each, so that the table stays a value of the plan
    found = F.transform(both, lambda s: F.transform(F.transform(s["words"], lambda w: F.hex(F.encode(w, "UTF-8"))), lambda w, i: F.struct(i.alias("pos"), _rank(s["table"], w, slots).alias("rank"), w.alias("word"))))
    rows = rows.select("id", "h", F.get(found, F.lit(0)).alias("found"))
    entry = "array<struct<pos int, ids array<int>>>"
    known = rows.select("id", "h", F.transform(F.filter("found", lambda x: x["rank"].isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), F.array(x["rank"]).alias("ids"))).cast(entry).alias("known"), F.lit(None).cast("struct<pos int, ids array<int>>").alias("part"))
    rest = rows.select("id", "h", F.explode(F.filter("found", lambda x: x["rank"].isNull())).alias("x")).select("id", "h", F.col("x.pos").alias("pos"), F.col("x.word").alias("word"))
    distinct = rest.select("word").distinct().select("word", table.alias("table")).select("word", _fold(F.col("word"), F.col("table"), slots).alias("ids"))
    parts = rest.join(distinct, "word").select("id", "h", F.lit(None).cast(entry).alias("known"), F.struct("pos", "ids").cast("struct<pos int, ids array<int>>").alias("part"))
    by_doc = known.union(parts).groupBy("id", "h").agg(F.collect_list("known").alias("known"), F.collect_set("part").alias("parts"))
    all_parts = F.array_sort(F.concat(F.get("known", F.lit(0)), F.col("parts")))
    copies = F.explode(F.sequence(F.lit(1), F.size("known")))
    return by_doc.select(F.col("id").alias(id_col), F.flatten(F.transform(all_parts, lambda x: x["ids"])).alias(out), copies.alias("_copy")).drop("_copy")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with ``out``: the text of its ids. Null ids give null, an empty list the empty text, unknown ids nothing."""
    ranks = load_ranks(path)
    pieces: list[str | None] = [None] * (max(r for _, r in ranks) + 1)
    for key, r in ranks:
        pieces[r] = key
    table = encoded.sparkSession.createDataFrame([(pieces,)], "t array<string>").scalar()
    both = F.array(F.struct(F.col(ids_col).alias("i"), F.col("_table").alias("t")))
    text = F.get(F.transform(both, lambda s: F.decode(F.unhex(F.array_join(F.transform(s["i"], lambda i: F.get(s["t"], i)), "")), "UTF-8")), F.lit(0))
    return encoded.withColumn("_table", table).withColumn(out, F.when(F.col(ids_col).isNotNull(), text)).drop("_table")
