"""Problems 2 and 5: drafts that are the same, splits that keep them together, overlaps between splits.

Rows belong to one draft if they share a family, or if their texts match (see ``editjoin``), directly or through other
rows. Texts are compared in their one form (see ``lookalike``), reduced to letters and digits without case.

Null families and null texts connect nothing; a text without letters or digits counts as null. Copies of a text are
joined before any comparison, so a text of a third of all rows costs as much as one of two rows.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.components import frontier_components
from inkfold.llm.editjoin import edit_links
from inkfold.llm.lookalike import canonical
from inkfold.session import cut

_REST = regex.compile(r"[^\p{L}\p{N}]+")


def reduce_text(value: str | None) -> str | None:
    """Letters and digits of the text's one form, without case; None if there are none."""
    if value is None:
        return None
    return _REST.sub("", canonical(value)[0].casefold()) or None


def reduced(values: pd.Series) -> pd.Series:
    return pd.Series([reduce_text(v) for v in values], dtype=object)


def drafts(rows: DataFrame) -> DataFrame:
    """``(row_id, text, family_id, ...)`` to ``(row_id, draft, ...)``: rows of one draft share the long ``draft``.

    Other columns stay as they are, whatever their names, save ``text`` and ``family_id``. row_id is unique.
    """
    keep = [c for c in rows.columns if c not in ("row_id", "text", "family_id")]
    extra = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.lit(None).cast("struct<c0:string>")
    short = cut(rows.select("row_id", "family_id", F.pandas_udf(reduced, "string")("text").alias("text"), extra.alias("extra")))
    texts = cut(short.where("text is not null").groupBy("text").agg(F.min("row_id").alias("id")))
    # a text's node is the least of its rows; a row without text is its own node
    placed = cut(short.join(texts, "text", "left").select("row_id", "family_id", F.coalesce("id", "row_id").alias("node"), "extra"))
    families = placed.where("family_id is not null").select("family_id", "node").distinct()
    heads = families.groupBy("family_id").agg(F.min("node").alias("head"))
    ties = families.join(heads, "family_id").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    labels = frontier_components(ties.union(edit_links(texts)))
    out = placed.join(labels, "node", "left").select("row_id", F.coalesce("label", "node").alias("draft"), "extra")
    return out.select("row_id", "draft", *[F.col(f"extra.c{i}").alias(c) for i, c in enumerate(keep)])


def draft_groups(rows: DataFrame) -> DataFrame:
    """``(row_id, group_id)`` for each row whose draft has another row; group_id is the draft's least row_id."""
    d = cut(drafts(rows.select("row_id", "text", "family_id")))
    groups = d.groupBy("draft").agg(F.min("row_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return d.join(groups, "draft").select("row_id", "group_id")


def cross_split_pairs(rows: DataFrame) -> DataFrame:
    """``(row_id_a, row_id_b)``, the smaller first: rows of one draft of which one is in train, the other in eval or test.

    Splits are compared without blanks and case; rows with a null or another split form no pair.
    """
    split = F.lower(F.trim("split"))
    d = cut(drafts(rows.select("row_id", "text", "family_id", split.alias("split"))).where("split in ('train', 'eval', 'test')"))
    train = d.where("split = 'train'").select("draft", F.col("row_id").alias("t"))
    held = d.where("split != 'train'").select("draft", F.col("row_id").alias("h"))
    return held.join(train, "draft").select(F.least("t", "h").alias("row_id_a"), F.greatest("t", "h").alias("row_id_b"))


def overlap_classes(rows: DataFrame) -> DataFrame:
    """One row for each draft that stands in train and in eval or test: ``(draft, n_train, n_held, row_id_train,
    row_id_held)``, the numbers of its rows and the least row of each side, whatever the number of pairs."""
    split = F.lower(F.trim("split"))
    d = drafts(rows.select("row_id", "text", "family_id", split.alias("split"))).where("split in ('train', 'eval', 'test')")
    train = F.col("split") == "train"
    g = d.groupBy("draft").agg(F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_held"), F.min(F.when(train, F.col("row_id"))).alias("row_id_train"), F.min(F.when(~train, F.col("row_id"))).alias("row_id_held"))
    return g.where("n_train > 0 and n_held > 0")


def overlap_report(rows: DataFrame) -> DataFrame:
    """For each split and source of held-out rows: rows, those that also occur in train, and their share.

    Counts come from one pass over the drafts; pairs are never formed.
    """
    split = F.lower(F.trim("split"))
    d = cut(drafts(rows.select("row_id", "text", "family_id", split.alias("split"), "source")))
    train = d.where("split = 'train'").select("draft").distinct().withColumn("hit", F.lit(1))
    held = d.where("split in ('eval', 'test')").join(train, "draft", "left")
    return held.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_in_train"), (F.count("hit") / F.count(F.lit(1))).alias("share"))


def assign_splits(rows: DataFrame, shares: dict[str, float] | None = None, salt: str = "split-v1") -> DataFrame:
    """``(row_id, assigned)``: each row's split, the same for all rows of a draft.

    Drafts are laid out in the order of a salted hash and the shares are met by rows, not drafts: a draft goes to the
    split in which the middle of its rows falls. The order's running totals are taken within 4,096 hash ranges and
    over the ranges, so no task sees more than one range. The draft's least row_id names it, so that the
    result depends on the rows alone. An empty table gives an empty table; shares need not sum to 1.
    """
    from pyspark.sql import Window as W

    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    d = cut(drafts(rows.select("row_id", "text", "family_id")))
    named = d.groupBy("draft").agg(F.min("row_id").alias("name"), F.count(F.lit(1)).alias("n"))
    place = F.sha2(F.concat_ws("\x1f", F.lit(salt), F.col("name").cast("string")), 256)
    named = cut(named.withColumn("place", place).withColumn("range", F.substring("place", 1, 3)))
    ranges = named.groupBy("range").agg(F.sum("n").alias("m"))
    before = ranges.select("range", (F.sum("m").over(W.orderBy("range")) - F.col("m")).alias("before"), F.sum("m").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    inside = F.sum("n").over(W.partitionBy("range").orderBy("place")) - F.col("n") / 2
    at = named.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("u", (F.col("before") + F.col("inside")) / F.col("all"))
    total, edge, choice = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        edge += share / total
        hit = F.col("u") < edge
        choice = F.when(hit, name) if choice is None else choice.when(hit, name)
    return d.join(at.select("draft", choice.otherwise(name).alias("assigned")), "draft").select("row_id", "assigned")
