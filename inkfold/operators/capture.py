"""What is read around a writer, and when it is sent: screen texts within a budget, rhythms, idle moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import text as T

# Kinds of elements whose text counts, and those that hold the writer's own text.
TEXTS, OWN = ("static_text", "heading", "link"), ("text_area", "text_field")
MOST_ELEMENTS = 512  # of a screen, as the feature is bounded
LEAST_MS, MOST_MS, FACTOR, DEFAULT_MS = 180.0, 700.0, 2.2, 250.0


def screen_text(elements: DataFrame, by: list[str], budget: int, parent_path: str = "path") -> DataFrame:
    """``(*by, context)``: the texts of each screen, breadth first, each once, one a line, within ``budget`` letters.

    ``elements`` has ``depth, ord, role, editable, text`` and ``path``, an array of the ordinals of an element's
    ancestors. What lies within an editable element or a text field is not visited; only the first MOST_ELEMENTS
    visited count. The last text is cut to what is left of the budget. A screen has a bounded number of elements.
    """
    stops = F.coalesce(F.col("editable"), F.lit(False)) | F.coalesce(F.col("role").isin(*OWN), F.lit(False))
    walls = elements.where(stops).groupBy(*by).agg(F.collect_set("ord").alias("_walls"))
    seen = elements.join(walls, by, "left").where(F.col("_walls").isNull() | ~F.arrays_overlap(F.coalesce(parent_path, F.array().cast("array<int>")), "_walls"))
    order = W.partitionBy(*by).orderBy("depth", "ord")
    first = seen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MOST_ELEMENTS)
    value = T.collapse_all(F.col("text"))
    texts = first.where(~stops & F.col("role").isin(*TEXTS)).withColumn("_t", value).where("_t != ''")
    once = texts.groupBy(*by, "_t").agg(F.min(F.struct("depth", "ord")).alias("_o"))
    cost = F.char_length("_t") + 1
    before = F.coalesce(F.sum(cost).over(W.partitionBy(*by).orderBy("_o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - before
    kept = once.withColumn("_room", room).where("_room > 0").withColumn("_t", F.left("_t", F.col("_room").cast("int")))
    lines = F.array_sort(F.collect_list(F.struct("_o", "_t")))
    return kept.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["_t"]), "\n").alias("context"))


def rhythm(keys: DataFrame, by: list[str], ts_ms: str, order: list[str], recent: int = 12) -> DataFrame:
    """``keys`` with ``pause_ms``: how long a pause must be to count, from the upper median of the group's last gaps
    between keys, at least 180 and at most 700; a group's first key has none and takes 250 as its median."""
    w = W.partitionBy(*by).orderBy(ts_ms, *order)
    gaps = keys.withColumn("_gap", F.col(ts_ms) - F.lag(ts_ms).over(w))
    last = F.array_sort(F.collect_list("_gap").over(w.rowsBetween(-recent + 1, 0)))
    median = F.coalesce(F.get(last, F.floor(F.size(last) / 2).cast("int")).cast("double"), F.lit(DEFAULT_MS))
    return gaps.withColumn("pause_ms", F.least(F.lit(MOST_MS), F.greatest(F.lit(LEAST_MS), F.lit(FACTOR) * median))).drop("_gap")


def cadence(draft: Column, kind: str, pause_ms: Column | float = 600.0) -> Column:
    """When a key makes a draft be sent: 0 at once, a pause in milliseconds, or null for never.

    ``chunk_pause`` waits for a stop or a pause, ``word`` for a stop or a whole word or half a second, ``greedy`` sends
    each key, ``rhythm`` waits for a stop or the writer's own pause, ``sentence`` for a stop alone.
    """
    stop, word = draft.rlike(r"[.!?]\z"), draft.rlike(r"\S\s\z")
    wait = pause_ms if isinstance(pause_ms, Column) else F.lit(pause_ms)
    if kind == "greedy":
        return F.lit(0.0)
    if kind == "word":
        return F.when(stop | word, 0.0).otherwise(500.0)
    if kind == "sentence":
        return F.when(stop, 0.0)
    if kind in ("chunk_pause", "rhythm"):
        return F.when(stop, 0.0).otherwise(wait)
    raise ValueError(f"unknown cadence {kind}")


def idle(keys: DataFrame, by: list[str], ts_ms: str, generation: str, text: str, delay_ms: int = 220, most: int = 80) -> DataFrame:
    """The keys after which nothing came for ``delay_ms``: only the newest generation of each group's moment is
    captured, with at most ``most`` UTF-16 units of text from its end, none of them half a letter."""
    w = W.partitionBy(*by).orderBy(ts_ms, generation)
    alone = keys.withColumn("_next", F.lead(ts_ms).over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col(ts_ms) >= delay_ms))
    tail = F.right(text, F.lit(most))
    # letters beyond the basic plane take two units
    units = F.aggregate(F.reverse(F.split(tail, "")), F.struct(F.lit(0).alias("n"), F.lit("").alias("s"), F.lit(False).alias("full")), lambda a, c: _add(a, c, most), lambda a: a["s"])
    return alone.withColumn("captured", units).drop("_next")


def _add(a: Column, c: Column, most: int) -> Column:
    size = F.when(F.octet_length(c) > 3, 2).otherwise(F.when(c == "", 0).otherwise(1))
    fits = ~a["full"] & (a["n"] + size <= most)
    return F.struct(F.when(fits, a["n"] + size).otherwise(a["n"]).alias("n"), F.when(fits, F.concat(c, a["s"])).otherwise(a["s"]).alias("s"), (~fits).alias("full"))


def reviewed(rows: DataFrame, line: str, choices: dict[int, int], snippets: str) -> DataFrame:
    """``rows`` with ``snippet``: the one that a review chose for their line, else the first; null without any."""
    pairs = [x for k, v in choices.items() for x in (F.lit(k), F.lit(v))]
    at = F.coalesce(F.element_at(F.create_map(*pairs), F.col(line).cast("int")), F.lit(0)) if pairs else F.lit(0)
    return rows.withColumn("snippet", F.get(snippets, at))
