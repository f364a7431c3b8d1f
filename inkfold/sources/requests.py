"""Requests and settings from outside: lines of tagged JSON, documents of fixtures, strict configuration files."""

from __future__ import annotations

import dataclasses
import tomllib
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dispatched(lines: DataFrame, schemas: dict[str, T.StructType | str], value: str = "value", tag: str = "type") -> dict[str, DataFrame]:
    """Lines of tagged JSON by their tag, each parsed by its schema, and under ``""`` the lines ``(value, reason)`` that
    are no object, have no or an unknown tag, or do not fit: ``not_an_object``, ``unknown_type``, ``fields``.

    Works on streams too: each part is a filter and a parse of the same lines, and nothing is kept between lines.
    Blank and null lines are left out. A missing required field, one declared not null, is a line that does not fit.
    """
    rows = lines.where(F.trim(value) != "")
    kind = F.get_json_object(value, f"$.{tag}")
    whole = F.json_object_keys(value).isNotNull()
    out, fits = {}, F.lit(False)
    for name, schema in schemas.items():
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        parsed = F.from_json(value, schema)
        good = F.lit(True)
        for f in schema.fields:
            if not f.nullable:
                good = good & parsed[f.name].isNotNull()
        mine = whole & (kind == name) & F.coalesce(good, F.lit(False))
        fits = fits | F.coalesce(mine, F.lit(False))
        out[name] = rows.where(mine).select(parsed.alias("_r")).select("_r.*")
    reason = F.when(~whole, "not_an_object").when(~F.coalesce(kind.isin(*schemas), F.lit(False)), "unknown_type").otherwise("fields")
    out[""] = rows.where(~fits).select(F.col(value).alias("value"), reason.alias("reason"))
    return out


def answered(requests: DataFrame, key: str, ok: Column, result: Column, code: Column) -> DataFrame:
    """``(value)``: one line of JSON for each request, its result or its error code, in the order of the key."""
    body = F.to_json(F.struct(F.col(key).alias(key), F.when(ok, F.lit("ok")).otherwise("error").alias("status"), F.when(ok, result).alias("result"), F.when(~ok, code).alias("code")))
    return requests.select(key, body.alias("value"))


def fixtures(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """A document that holds an array of fixtures, as rows; a repeated key is an error. Such documents are small."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    repeated = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][key]!r} is repeated")
    return rows


def _checked(name: str, value: Any, kind: Any, limits: tuple | None) -> Any:
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ValueError(f"{name} is no table")
        return _table(name, value, kind)
    origin, args = get_origin(kind), get_args(kind)
    if origin is dict:
        if not isinstance(value, dict):
            raise ValueError(f"{name} is no table")
        return {k: _checked(f"{name}.{k}", v, args[1], limits) for k, v in value.items()}
    if origin in (list, tuple):
        if not isinstance(value, list):
            raise ValueError(f"{name} is no array")
        return origin(_checked(f"{name}[{i}]", v, args[0], limits) for i, v in enumerate(value))
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
        raise ValueError(f"{name} is no {kind.__name__}")
    if kind is str and not value.strip():
        raise ValueError(f"{name} is empty")
    if limits is not None and not limits[0] <= value <= limits[1]:
        raise ValueError(f"{name} is not within {limits[0]} and {limits[1]}")
    return value


def _table(name: str, values: dict, kind: type) -> Any:
    hints, fields = get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
    if extra := sorted(set(values) - set(fields)):
        raise ValueError(f"{name or 'file'} has unknown keys {extra}")
    required = {n for n, f in fields.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    if missing := sorted(required - set(values)):
        raise ValueError(f"{name or 'file'} lacks {missing}")
    return kind(**{k: _checked(f"{name}.{k}".lstrip("."), v, hints[k], fields[k].metadata.get("range")) for k, v in values.items()})


def settings(path: str, kind: type) -> Any:
    """A TOML file as a dataclass: unknown and missing keys, other types, empty strings and values outside a field's
    ``metadata={"range": (low, high)}`` are errors that name the key."""
    with open(path, "rb") as f:
        return _table("", tomllib.load(f), kind)
