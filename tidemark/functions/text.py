"""Columns out of the text formats that labels, reports and settings come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_label(line: Column) -> Column:
    """``start-end:d1,d2`` -> struct(start, end, dims); null for a line that doesn't have just one colon or doesn't parse."""
    ok = line.rlike(r"^\s*\d+\s*-\s*\d+\s*:\s*\d+(\s*,\s*\d+)*\s*$")
    g = lambda k: F.regexp_extract(line, r"^\s*(\d+)\s*-\s*(\d+)\s*:(.*)$", k)
    dims = F.transform(F.split(g(3), ","), lambda x: F.trim(x).try_cast("int"))
    return F.when(ok, F.struct(g(1).try_cast("bigint").alias("start"), g(2).try_cast("bigint").alias("end"), dims.alias("dims")))


def nested_list(text: Column) -> Column:
    """``[[s, e], ...]`` -> array of structs (start, end)."""
    pairs = F.from_json(text, "array<array<bigint>>")
    return F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("start"), F.get(p, 1).alias("end")))


def bare_list(text: Column) -> Column:
    """``[point, contextual]`` -> array of strings."""
    inner = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")


def report_row(line: Column) -> Column:
    """``window | score | root | effect | edge (change)`` -> struct; null for other lines. Variables are called Var_k."""
    parts = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    number = lambda x: F.regexp_extract(x, r"Var_(\d+)", 1).try_cast("int")
    ok = (F.size(parts) >= 4) & F.get(parts, 0).rlike(r"^\d+$")
    return F.when(ok, F.struct(F.get(parts, 0).try_cast("int").alias("window_idx"), F.get(parts, 1).try_cast("double").alias("score"), number(F.get(parts, 2)).alias("root"), number(F.get(parts, 3)).alias("effect")))


def json_field(text: Column, fields: str, default: str | None = None) -> Column:
    """First field of ``a//b//c`` that isn't null, else the default."""
    found = [F.get_json_object(text, f"$.{f.strip()}") for f in fields.split("//")]
    return F.coalesce(*found, F.lit(default))


def json_lambda(text: Column, name: str, default=0.1) -> Column:
    return F.coalesce(F.get_json_object(text, f"$.{name}").try_cast("double"), F.lit(default))


def window_of_path(path: Column) -> Column:
    """Run number of ``.../run_012/...``; null where there is none."""
    return F.nullif(F.regexp_extract(path, r"run_(\d+)", 1), F.lit("")).try_cast("int")
