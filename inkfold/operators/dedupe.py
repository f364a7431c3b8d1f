"""Ordered removal of duplicates: exact, normalised and near, where only rows that stay block later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.functions.distance import ratio_of, simhash_of
from inkfold.session import cut

NEAR = 0.90
SNIPPETS = "array<struct<app_name:string,window_title:string,visible_text:string>>"


def ordered(rows: DataFrame, order: str, exact: str, normal: str, group: str | None = None) -> DataFrame:
    """``rows`` with ``reason``: null for those that stay, else exact_duplicate or normalized_duplicate.

    The first row of each normalised text stays, and no other: an exact copy of it, or of any text alike, is a
    duplicate of the first one.
    """
    n = W.partitionBy(normal).orderBy(order)
    e = W.partitionBy(exact).orderBy(order)
    first_n, first_e = F.row_number().over(n), F.row_number().over(e)
    return rows.withColumn("_e", first_e).withColumn("_n", first_n).withColumn("reason", F.when(F.col("_n") == 1, F.lit(None).cast("string")).when(F.col("_e") > 1, "exact_duplicate").otherwise("normalized_duplicate")).drop("_e", "_n")


def near_links(texts: DataFrame, near: float = NEAR) -> DataFrame:
    """``(earlier, later, ratio)`` of ids whose masked texts share a band of their similarity hash and are alike.

    ``texts``: id, group, shape, one row for each different shape of a group. Texts without tokens, which all hash
    alike, are no candidates. The four bands are joined on equal keys; a pair that shares several comes once.
    """
    h = cut(texts.where(F.coalesce("shape", F.lit("")) != "").withColumn("h", simhash_of(F.col("shape"))))
    bands = h.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftright("h", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("value")) for i in range(4)])).alias("b")).select("id", "b.band", "b.value")
    pairs = bands.alias("x").join(bands.alias("y"), ["band", "value"]).where("x.id < y.id").select(F.col("x.id").alias("earlier"), F.col("y.id").alias("later")).distinct()
    a, b = (h.select(F.col("id").alias(n), F.col("shape").alias(f"s_{n}"), F.col("group").alias(f"g_{n}")) for n in ("earlier", "later"))
    # the longest common part is bounded by lengths: most pairs need no comparison
    la, lb = F.length("s_earlier"), F.length("s_later")
    full = pairs.join(a, "earlier").join(b, "later").where(~F.col("g_earlier").eqNullSafe(F.col("g_later")) | F.col("g_earlier").isNull()).where(2.0 * F.least(la, lb) / (la + lb) >= near)
    return full.withColumn("ratio", ratio_of(F.col("s_later"), F.col("s_earlier"))).where(F.col("ratio") >= near).select("earlier", "later", "ratio")


def kept(ids: DataFrame, links: DataFrame) -> DataFrame:
    """The lexicographically first set of ids without a link between two: an id stays unless an earlier one that
    stays links to it. Settled round by round: ids with no open earlier neighbour stay, their later neighbours go."""
    open_ = cut(ids.select("id").distinct())
    links = cut(links.select("earlier", "later").distinct())
    stay = None
    while not open_.isEmpty():
        blocked = links.select(F.col("later").alias("id")).distinct()
        now = cut(open_.join(blocked, "id", "left_anti"))
        stay = now if stay is None else stay.union(now)
        gone = cut(links.join(now.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct())
        open_ = cut(open_.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        links = cut(links.join(open_.withColumnRenamed("id", "earlier"), "earlier", "left_semi").join(open_.withColumnRenamed("id", "later"), "later", "left_semi"))
    return ids.limit(0).select("id") if stay is None else stay


def shapes(rows: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """``(id, group, shape)``: masked texts, the first id of each."""
    s = rows.select(F.col(key).alias("id"), (F.col(group) if group else F.lit(None)).cast("string").alias("group"), T.shape(F.col(text)).alias("shape"))
    return s.where("shape is not null").groupBy("shape", "group").agg(F.min("id").alias("id")).select("id", "group", "shape")


def whole(text: Column, suggestion: Column, snippets: Column) -> Column:
    """What a candidate's shape is made of: text, suggestion, and every snippet's application, title and visible text.
    Absent snippets and fields of snippets count as empty."""
    part = lambda s: F.concat_ws(" ", *[F.coalesce(s[n], F.lit("")) for n in ("app_name", "window_title", "visible_text")])
    return F.concat_ws(" | ", F.array(text, suggestion), F.transform(F.coalesce(snippets, F.expr("array()").cast(SNIPPETS)), part))


def normal_key(text: Column, suggestion: Column, snippets: Column) -> Column:
    """The normalised key of a candidate, over text, suggestion and all snippets, part by part. Equal candidates have
    equal keys, so it stands for the exact key too."""
    parts = F.transform(F.coalesce(snippets, F.expr("array()").cast(SNIPPETS)), lambda s: F.array(*[T.plain(F.coalesce(s[n], F.lit(""))) for n in ("app_name", "window_title", "visible_text")]))
    return F.to_json(F.struct(T.plain(text).alias("t"), T.plain(suggestion).alias("s"), parts.alias("c")))


def kept_rows(rows: DataFrame, near: float = NEAR) -> DataFrame:
    """``(id)`` of the candidates that stay, in order of id; ``rows`` has unique id, group, normal and shape. A row goes
    if a row that stays before it has its key, or is near it and of another group; shape-mates of one group stay."""
    # of rows alike in all three the first decides for the others
    first = cut(rows.where("shape is not null").groupBy("normal", "group", "shape").agg(F.min("id").alias("id")))
    equal = first.alias("x").join(first.alias("y"), "normal").where("x.id < y.id").select(F.col("x.id").alias("earlier"), F.col("y.id").alias("later"))
    return kept(first, near_links(first.select("id", "group", "shape"), near).select("earlier", "later").union(equal))


def screened(rows: DataFrame, reference: DataFrame, near: float = NEAR) -> DataFrame:
    """``(id, reason)`` of rows ``(id, normal, shape)`` that a reference ``(id, normal, shape)`` has already:
    ``reference_duplicate`` for an equal key, else ``reference_near_duplicate``. They go before rows are compared with
    each other, so that they block none."""
    same = rows.join(reference.select("normal").distinct(), "normal", "left_semi").select("id", F.lit("reference_duplicate").alias("reason"))
    rest = rows.join(same.select("id"), "id", "left_anti")
    tag = lambda d, n: d.where("shape is not null").groupBy("shape").agg(F.min("id").alias("id")).select(F.concat(F.lit(f"{n}:"), F.col("id").cast("string")).alias("id"), F.lit(None).cast("string").alias("group"), "shape")
    links = near_links(tag(reference, 0).union(tag(rest, 1)), near).where("earlier like '0:%' and later like '1:%'")
    shapes_ = tag(rest, 1).join(links.select(F.col("later").alias("id")).distinct(), "id", "left_semi").select("shape")
    return same.union(rest.join(shapes_, "shape", "left_semi").select("id", F.lit("reference_near_duplicate").alias("reason")))
