"""JSON lines: strict scans with line numbers, schema gates, and byte-stable sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.operators.sampling import numbered


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = True) -> DataFrame:
    """Objects of a file or folder; blank lines are skipped, malformed ones fail. A missing path is an empty table."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad lines ``(line, reason)``: not an object, keys missing or unknown, or values of another type.

    One scan of text serves both; nothing is inferred and extra keys are errors.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    want = sorted(f.name for f in schema.fields)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    nulls = F.lit(False)
    for f in schema.fields:
        given = F.get_json_object("value", f"$.{f.name}")
        nulls = nulls | (parsed[f.name].isNull() & (given.isNotNull() if f.nullable else F.lit(True)))
    reason = F.when(keys.isNull(), "not_an_object").when(F.array_sort(keys) != F.array(*map(F.lit, want)), "keys").when(nulls, "types")
    checked = lines.select("value", parsed.alias("row"), reason.alias("reason"))
    return checked.where("reason is null").select("row.*"), checked.where("reason is not null").select(F.col("value").alias("line"), "reason")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of one file's lines that are not blank, numbered from 1 with blank ones counted; for sources
    where the line number is data. A file may be as large as it is: its blocks are numbered apart and put in a row."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    return numbered(lines, ["_block", "_row"], "_n").select((F.col("_n") + 1).cast("int").alias("line_no"), "value").where(F.trim("value") != "")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str, version: int) -> DataFrame:
    """A JSON document whose ``schema_version`` is the wanted one; another version is an error."""
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    got = [r["schema_version"] for r in m.select("schema_version").limit(2).collect()]
    if got != [version]:
        raise ValueError(f"schema_version {got}, not {version}")
    return m


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256, bytes)`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def canonical_json(*columns: str):
    """A compact JSON object with keys in order and nulls written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_id(prefix: str, json) -> F.Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(json, 256), 1, 20))


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None, files: int | None = None) -> None:
    """Rows as JSON lines with keys in order. With an order and one file, equal rows give equal bytes."""
    out = rows.select(*sorted(rows.columns))
    if files:
        out = out.coalesce(files)
    if order:
        out = out.sortWithinPartitions(*order) if files == 1 else out.orderBy(*order)
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_document(rows: DataFrame, path: str) -> None:
    """One small aggregate of at most one row as a JSON document on the driver, replaced at once."""
    found = rows.toJSON().take(2)
    if len(found) > 1:
        raise ValueError("a document holds one row")
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write((found or ["{}"])[0] + "\n")
    os.replace(tmp, path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown; rows beyond ``most`` are counted in a last line, not left out in silence."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    shown = rows.limit(most + 1).collect()
    more = [f"\n{rows.count() - most} more rows"] if len(shown) > most else []
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in shown[:most]] + more) + "\n"
