"""Attribute values in canonical form, their sizes and limits.

A value is a tagged JSON string that keeps its kind exactly: ``{"s":text}``, ``{"t":bool}``, ``{"i":"int"}``,
``{"d":"hex bits"}``, ``{"b":"hex"}``, ``{"a":[...]}``, ``{"k":[[key, value], ...]}``. Equal strings are equal values:
ints and doubles never meet, doubles compare by their bits, a list of pairs keeps its order. An attribute map sorts by
key. In Python a value is the parsed form of that string.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Sizes in bytes; STRUCT, ENTRY, MAP and NAMED are the engine's published terms, the rest are ours.
STRUCT, ENTRY, MAP, NAMED, SLOT = 16, 160, 768, 32, 16


class Refused(ValueError):
    """Why a record can't be taken: ``slug`` names the reason."""

    def __init__(self, slug: str, detail: str = ""):
        super().__init__(f"{slug}: {detail}" if detail else slug)
        self.slug = slug


def double_bits(x: float) -> str:
    return struct.pack(">d", x).hex()


def canonical(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def array_value(items: list) -> dict:
    if len({next(iter(i)) for i in items}) > 1:
        raise Refused("mixed_array")
    return {"a": items}


def pairs_value(pairs: list) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise Refused("duplicate_key")
    return {"k": [[k, v] for k, v in pairs]}


def attributes(pairs: list) -> dict:
    """A map sorted by key; a repeated key is refused."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Refused("duplicate_key")
    return dict(sorted(out.items()))


def depth(value: dict) -> int:
    """Containers on the longest way down."""
    kind, x = next(iter(value.items()))
    if kind == "a":
        return 1 + max(map(depth, x), default=0)
    if kind == "k":
        return 1 + max((depth(v) for _, v in x), default=0)
    return 0


def value_size(value: dict) -> int:
    kind, x = next(iter(value.items()))
    if kind == "s":
        return len(x.encode())
    if kind == "b":
        return len(x) // 2
    if kind == "t":
        return 1
    if kind in "id":
        return 8
    if kind == "a":
        return sum(2 * SLOT + value_size(v) for v in x)
    return sum(ENTRY + len(k.encode()) + value_size(v) for k, v in x)


def entry_size(key: str, value: dict) -> int:
    return ENTRY + len(key.encode()) + value_size(value)


def map_size(attrs: dict) -> int:
    return (MAP if attrs else 0) + sum(entry_size(k, v) for k, v in attrs.items())


def text_size(text: str | None) -> int:
    return NAMED + len(text.encode()) if text is not None else 0


def plain(value: dict | None):
    """A value as plain JSON data: scalars as they are, bytes as hex."""
    if value is None:
        return None
    kind, x = next(iter(value.items()))
    if kind == "i":
        return int(x)
    if kind == "d":
        return struct.unpack(">d", bytes.fromhex(x))[0]
    if kind == "a":
        return [plain(v) for v in x]
    if kind == "k":
        return {k: plain(v) for k, v in x}
    return x


@F.pandas_udf(StringType())
def plain_json(values: pd.Series) -> pd.Series:
    """Canonical value strings to plain JSON text; null stays null."""
    return values.map(lambda v: None if v is None else json.dumps(plain(json.loads(v)), ensure_ascii=False))


def string_attribute(attrs_key: Column, key: str) -> Column:
    """A string-valued attribute of a canonical map, null where absent or of another kind."""
    return F.get_json_object(attrs_key, f"$['{key}'].s")
