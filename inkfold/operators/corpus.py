"""Rows of a corpus: traces, inputs, content ids, provenance and family splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.operators.sampling import numbered

# Characters kept of a context snippet's fields.
BOUNDS = {"app_name": 80, "window_title": 120, "visible_text": 240}


def trace_errors(method: Column, seed: Column, requested: Column, operations: Column) -> Column:
    """What breaks the form of a generation trace: null for a sourced row without a trace, or a whole augmentation."""
    some = seed.isNotNull() | requested.isNotNull() | operations.isNotNull()
    return (
        F.when(method == "sourced", F.when(some, "trace_of_sourced_row"))
        .when(method != "augmentation", "unknown_method")
        .when(method.isNull(), "no_method")
        .when(seed.isNull() | (seed < 0), "seed")
        .when(~F.coalesce(requested.between(1, 10), F.lit(False)), "requested_events")
        .when(F.coalesce(F.size(operations), F.lit(-1)) != requested, "operations")
    )


def bounded_snippet(snippets: Column, at: int = 0) -> Column:
    """One snippet with its fields collapsed and bounded; an empty visible text falls back to the title. Null for none."""
    s = F.get(snippets, F.lit(at))
    field = lambda n: F.nullif(F.substring(T.collapse(s[n]), 1, BOUNDS[n]), F.lit(""))
    made = F.struct(field("app_name").alias("app_name"), F.substring(F.coalesce(field("visible_text"), field("window_title")), 1, BOUNDS["visible_text"]).alias("visible_text"), field("window_title").alias("window_title"))
    return F.when(s.isNotNull(), made)


def bounded_context(snippets: Column, most: int = 1, chars: int = 240) -> Column:
    """The first snippets, with visible texts of so many characters."""
    return F.transform(F.slice(snippets, 1, most), lambda s: s.withField("visible_text", F.substring(s["visible_text"], 1, chars)))


def model_input(text: Column, snippets: Column, hints: Column | None = None) -> Column:
    """A model's input as JSON in a stable order; empty contexts and missing hints are left out."""
    context = F.when(F.size(snippets) > 0, snippets)
    fields = [text.alias("text"), context.alias("context_snippets")] + ([hints.alias("hints")] if hints is not None else [])
    return F.to_json(F.struct(*fields))


def source_parts(record_id: Column) -> Column:
    """``(partition, id)`` of a record id of five or more parts between colons; null for others."""
    p = F.split(record_id, ":")
    return F.when(F.size(p) >= 5, F.struct(F.get(p, F.lit(1)).alias("partition"), F.get(p, F.lit(2)).alias("id")))


def family_of(text: Column, prefix: str) -> Column:
    """A family id: a digest of the folded text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(T.fold(text), 256), 1, 20))


def training_rows(rows: DataFrame, keep: list[str], prefix: str = "row_") -> DataFrame:
    """``rows`` with ``example_id``, a digest of the kept fields as JSON with sorted keys and nulls written."""
    json = F.to_json(F.struct(*[F.col(c) for c in sorted(keep)]), {"ignoreNullFields": "false"})
    return rows.withColumn("example_id", F.concat(F.lit(prefix), F.substring(F.sha2(json, 256), 1, 20)))


def fill_splits(families: DataFrame, key: str, size: str, shares: dict[str, float], seed: str) -> DataFrame:
    """``(key, split)``: families in seeded order, each to the split that is filled least against its share.

    The order matters to every step, so one task walks it, over one key and one number a family. For corpora of more
    families than a task can hold, ``sampling.hash_split`` keeps families together by another contract.
    """
    names, want = list(shares), list(shares.values())

    def walk(batches):
        have = [0.0] * len(names)
        for b in batches:
            out = []
            for n in b["n"]:
                i = min(range(len(names)), key=lambda j: (have[j] / want[j] if want[j] else float("inf"), j))
                have[i] += float(n)
                out.append(names[i])
            yield pd.DataFrame({key: b[key], "split": out})

    kind = families.schema[key].dataType.simpleString()
    placed = families.where(F.col(key).isNotNull()).select(key, F.col(size).alias("n"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("p"))
    return placed.repartition(1).sortWithinPartitions("p", key).mapInPandas(walk, f"{key} {kind}, split string")


def rotating(rows: DataFrame, order: str, seed: str, size: int = 16) -> DataFrame:
    """``size`` rows in a row of an order, from an offset that the seed decides, around its end."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    at = numbered(rows, [order], "_i").join(F.broadcast(n))  # n is one row
    start = F.pmod(F.xxhash64(F.lit(seed)), F.greatest("_n", F.lit(1)))
    return at.where(F.pmod(F.col("_i") - start, F.greatest("_n", F.lit(1))) < size).drop("_i", "_n")


def without_line(text: Column, caret: Column) -> Column:
    """The text around the line that holds the caret (a code point offset), without that line."""

    def cut(t: str | None, c: int | None) -> str | None:
        if t is None or c is None:
            return t
        c = max(0, min(int(c), len(t)))
        a = max(t.rfind("\n", 0, c), t.rfind("\r", 0, c)) + 1
        ends = [i for i in (t.find("\n", c), t.find("\r", c)) if i >= 0]
        b = min(ends) if ends else len(t)
        b = b + 2 if t[b : b + 2] == "\r\n" else min(b + 1, len(t))
        return t[:a] + t[b:]

    return F.pandas_udf(lambda x, y: pd.Series([cut(p, None if pd.isna(q) else q) for p, q in zip(x, y)], dtype=object), "string")(text, caret)
