"""Items of a list literal, as the service reads and prints them.

JSON lists are read by the JSON rules, else Python lists by Python's: nested
lists, tuples and dictionaries, trailing commas, escapes, joined strings, bytes
and complex numbers.  An item that is not a string is printed as Python prints
it.  No built-in function does that, so this one step is an Arrow function; it
is given only the texts that stand in brackets.
"""

from __future__ import annotations

import ast
import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python workers need pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITEMS = "array<struct<kind:string,text:string,truthy:boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("truthy", pa.bool_())]))


def _kind(x) -> str:
    if isinstance(x, str):
        return "string"
    if isinstance(x, bool):
        return "bool"
    if x is None:
        return "null"
    return "number" if isinstance(x, (int, float, complex)) else "nested"


def list_items(text: str | None) -> list[dict] | None:
    """(kind, text, truthy) of the items, or None if it is no list literal."""
    if text is None:
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(text)
            if not isinstance(found, list):
                return None
            # lone surrogates, which JSON escapes can make, are no text
            return [{"kind": _kind(x), "text": str(x).encode("utf-8", "replace").decode(), "truthy": bool(x)} for x in found]
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def _batch(texts: pa.Array) -> pa.Array:
    return pa.array([list_items(t) for t in texts.to_pylist()], _TYPE)


def literal_items(c: Column) -> Column:
    """``ITEMS`` of the list literal in ``c``; null for null and other texts."""
    return F.arrow_udf(_batch, ITEMS)(c)
