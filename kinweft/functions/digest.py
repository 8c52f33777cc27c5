"""Canonical JSON, digests and keyed identifiers, as Columns and for driver-side values.

Canonical JSON has sorted keys, no absent fields and no white space.  Keys sort as people sort words:
punctuation, digits, letters, case only where all else is equal.  Columns get their key order when the plan is
made, so a digest is one expression and stays in generated code.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import unicodedata
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_order(text: str) -> tuple:
    """A sort key for dictionary order: letters without accents and case, then accents, then lower before upper."""
    base, accents, case = [], [], []
    for c in unicodedata.normalize("NFD", text):
        if unicodedata.combining(c):
            accents.append(c)
            continue
        low = c.lower()
        base.append((2 if c.isalpha() else 1 if c.isdigit() else 0, low))
        case.append(c != low)
    return base, accents, case


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _plain(value[k]) for k in sorted((k for k in value if value[k] is not Ellipsis), key=word_order)}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise TypeError("canonical JSON has no such number")
        return int(value) if value.is_integer() else value
    if value is None or isinstance(value, (bool, int, str)):
        return value
    raise TypeError(f"canonical JSON has no {type(value).__name__}")


def canonical_json(value: Any) -> str:
    """Canonical JSON of a driver-side value; fields with the value ``...`` are absent."""
    return json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def scoped_id(workspace: str, kind: str, value: Any) -> str:
    """An identifier that only this workspace gives to this value."""
    if not workspace or not kind:
        raise TypeError("a workspace and a kind are needed")
    return f"{kind}_{hmac.new(workspace.encode(), f'{kind}\n{canonical_json(value)}'.encode(), hashlib.sha256).hexdigest()[:32]}"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def json_string(text: Column) -> Column:
    """A JSON string literal; null for null."""
    made = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(made, 2, F.length(made) - 2))


def json_value(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a Column of this type, null if the value is; struct fields become camelCase keys."""
    if isinstance(kind, T.StructType):
        return json_object({camel(f.name): json_value(value[f.name], f.dataType) for f in kind.fields})
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_value(x, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_value(e["value"], kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    if isinstance(kind, T.StringType):
        return json_string(value)
    return value.cast("string")


def json_object(fields: dict[str, Column]) -> Column:
    """An object of JSON texts; fields whose text is null are left out."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), fields[k]) for k in sorted(fields, key=word_order)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def scoped_id_column(workspace: str, kind: str, value_json: Column) -> Column:
    """:func:`scoped_id` of a Column of canonical JSON: HMAC from two digests, as Spark has no HMAC."""
    key = workspace.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.concat(F.lit(f"{kind}\n"), value_json).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.concat(F.lit(f"{kind}_"), F.substring(digest, 1, 32))
