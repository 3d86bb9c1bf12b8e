"""Tool calls that a model wrote as plain text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from docquarry.functions import fixed
from docquarry.functions.text import SPACE

_AS_TEXT = rf"\b({'|'.join(fixed.TOOL_NAMES)}){SPACE}*\(([^()]*(?:\([^)]*\)[^()]*)*)\)"
_AS_JSON = (
    rf'(?s)\[{SPACE}*\{{{SPACE}*"name"{SPACE}*:{SPACE}*"[a-z_]+"{SPACE}*,{SPACE}*"arguments"{SPACE}*:'
    rf"{SPACE}*\{{.*?\}}{SPACE}*\}}{SPACE}*\]"
)
_CALL = "struct<tool:string,args:map<string,string>>"
_PAIR = re.compile(
    r"""\s*(?P<key>[^=,]*?)\s*=\s*
        (?P<value>(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[\[({](?:[^\])}]*)[\])}]|[^,"'\[({])*)\s*(?:,|$)""",
    re.VERBOSE | re.DOTALL,
)
_LITERALS = {"None": None, "True": "true", "False": "false"}


def _plain(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def split_arguments(blob: str) -> dict[str, str | None]:
    """``a="x, y", b=2`` to a mapping; values as text, literals in JSON form."""
    blob = blob.strip().rstrip(".,;:")
    if not blob:
        return {}
    try:
        parsed = json.loads("{" + blob + "}")
        return {k: _plain(v) for k, v in parsed.items()}
    except ValueError:
        pass
    out: dict[str, str | None] = {}
    for m in _PAIR.finditer(blob):
        key, value = m["key"].strip(), m["value"].strip()
        if not key:
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = _LITERALS.get(value, value)
    return out


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def _arguments(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda row: None if row is None else [split_arguments(b) for b in row])


def tool_calls(content: Column) -> Column:
    """``array<struct<tool,args>>``: the JSON list form if present, else ``name(key=value, …)``."""
    call = "array<struct<name:string,arguments:string,function:struct<name:string,arguments:string>>>"
    listed = F.from_json(F.regexp_extract(content, _AS_JSON, 0), call)
    as_json = F.filter(
        F.transform(listed, lambda c: F.struct(
            F.coalesce(c["function"]["name"], c["name"]).alias("tool"),
            F.coalesce(
                F.from_json(F.coalesce(c["function"]["arguments"], c["arguments"]), "map<string,string>"),
                F.create_map().cast("map<string,string>")).alias("args"))),
        lambda c: F.coalesce(c["tool"], F.lit("")) != "")
    names = F.regexp_extract_all(content, F.lit(_AS_TEXT), F.lit(1))
    blobs = F.regexp_extract_all(content, F.lit(_AS_TEXT), F.lit(2))
    as_text = F.zip_with(names, _arguments(blobs), lambda n, a: F.struct(n.alias("tool"), a.alias("args")))
    return F.when(F.coalesce(F.size(as_json), F.lit(0)) > 0, as_json.cast(f"array<{_CALL}>")).otherwise(
        as_text.cast(f"array<{_CALL}>"))


