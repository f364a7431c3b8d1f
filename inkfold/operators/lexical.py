"""Spelling candidates: an edit-distance join between tokens and a vocabulary, ranked by typing distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.functions.distance import typing_distance_of

MOST = 2  # edits looked up
LEAST_LENGTH = 3


def deletions(word: Column, edits: int = MOST) -> Column:
    """The word and all words that come of it by deleting up to two letters."""
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    if edits == 1:
        return F.array_distinct(F.concat(F.array(word), one))
    two = F.flatten(F.transform(one, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
    return F.array_distinct(F.concat(F.array(word), one, two))


def reach(token: Column) -> Column:
    """Edits looked up for a token: 1 up to three letters, 2 beyond."""
    return F.when(F.length(token) <= 3, 1).otherwise(MOST)


def edit_candidates(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, word, zipf, distance)``: vocabulary words within reach of each distinct token, other than itself.

    Two words within k edits share a word that both reach by at most k deletions, so the join is one on equal keys and
    loses nothing; what it brings together is verified by edit distance.
    """
    t = tokens.select("token").where(F.col("token").isNotNull() & (F.length("token") >= 1)).distinct()
    v = vocabulary.select(F.lower("word").alias("word"), "zipf").where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.max("zipf").alias("zipf"))
    tk = t.select("token", F.explode(deletions(F.col("token"))).alias("k"))
    vk = v.select("word", "zipf", F.explode(deletions(F.col("word"))).alias("k"))
    pairs = tk.join(vk, "k").where("token != word").select("token", "word", "zipf").distinct()
    d = F.levenshtein("token", "word", MOST)
    return pairs.withColumn("distance", d).where((F.col("distance") >= 0) & (F.col("distance") <= reach(F.col("token"))))


def ranked(candidates: DataFrame, top: int = 3) -> DataFrame:
    """The first ``top`` candidates of each token by edit distance, frequency, length and word."""
    w = W.partitionBy("token").orderBy("distance", F.desc("zipf"), F.abs(F.length("token") - F.length("word")), "word")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hints(candidates: DataFrame, top: int = 3) -> DataFrame:
    """As ``ranked``, by typing distance, without words beyond what the token's length allows."""
    limit = F.when(F.length("token") <= 4, 1.10).when(F.length("token") <= 6, 1.65).otherwise(2.0)
    d = candidates.withColumn("typing", typing_distance_of(F.col("token"), F.col("word"))).where(F.col("typing") <= limit)
    w = W.partitionBy("token").orderBy("typing", F.desc("zipf"), F.abs(F.length("token") - F.length("word")), "word")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


#: Words that stand in a path, handle, name with digits or dotted name, which are no spelling mistakes.
UNPROTECTED = r"(?<![\p{L}\p{N}_/@\\.'-])[A-Za-z]+(?:'[A-Za-z]+)?(?![\p{L}\p{N}_/@\\-]|\.[\p{L}\p{N}]|'[\p{L}])"


def lookup_tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, token)``: the first place of each unprotected lower-case word that may be looked up."""
    found = F.regexp_extract_all(text, F.lit(UNPROTECTED), F.lit(0))
    pairs = rows.select(key, F.posexplode(found).alias("pos", "token")).where(F.col("token") == F.lower("token"))
    return pairs.groupBy(key, "token").agg(F.min("pos").alias("pos"))


def derived_vocabulary(rows: DataFrame, text: str, least: int = 3) -> DataFrame:
    """``(word, zipf)`` of a corpus' own words: the logarithm of how many texts in a billion hold the word."""
    d = rows.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(T.english_tokens(F.lower(text)))).alias("word"))
    counts = d.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    total = rows.agg(F.count(text).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("word", F.log10(F.col("n") * 1e9 / F.col("total")).alias("zipf"))  # total is one row
