"""JSON values that stand in scripts: found by what comes before them, ended where they balance, whatever follows."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Names that states are assigned to, and the call that chunks of a flight are pushed by.
NAMES = ("__NUXT__", "__remixContext", "__APOLLO_STATE__")
FLIGHT = "self.__next_f.push("
_BEFORE = [(n, re.compile(rf"window\.{n}\s*=\s*")) for n in NAMES]
_PUSH = re.compile(re.escape(FLIGHT) + r"\s*")
FOUND = ArrayType(StructType([StructField("mark", StringType()), StructField("json", StringType())]))


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def balanced(text: str, at: int) -> str | None:
    """The JSON object or list that begins at a position, up to its own end; brackets in strings do not count. None if it is none."""
    if text[at : at + 1] not in ("{", "["):
        return None
    try:
        return text[at : _DECODER.raw_decode(text, at)[1]]
    except (ValueError, RecursionError):
        return None


def _assigned(html: str | None) -> list[dict[str, str]]:
    out = []
    for name, before in _BEFORE:
        found = before.search(html) if html and name in html else None
        value = balanced(html, found.end()) if found else None
        if value is not None:
            out.append({"mark": name, "json": value})
    at = 0
    while html and FLIGHT in html and (found := _PUSH.search(html, at)):
        value = balanced(html, found.end())
        if value is not None:
            out.append({"mark": FLIGHT, "json": value})
        at = found.end() + len(value or "")
    return out


@F.arrow_udf(FOUND)
def assigned(html: pa.Array) -> pa.Array:
    """(mark, json) of the first value assigned to each name, and of every pushed chunk in order."""
    kind = pa.list_(pa.struct([("mark", pa.string()), ("json", pa.string())]))
    return pa.array([_assigned(x) for x in html.to_pylist()], kind)


def first_of(found: Column, mark: str) -> Column:
    """The value of a mark, null without one."""
    return F.get(F.filter(found, lambda x: x["mark"] == mark), F.lit(0))["json"]
