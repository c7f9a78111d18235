"""Hashes and the JSON bodies that are hashed, as column expressions.

Content addresses are SHA-256 in lower-case hex: as wide as the 32-byte addresses of the
data model, built in, and the same in other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def address(*parts: Column) -> Column:
    """Content address of the concatenated parts."""
    whole = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.sha2(whole, 256)


def short(hash_: Column) -> Column:
    """The 12 hex digits shown in listings."""
    return F.substring(hash_, 1, 12)


def parsed(text: Column) -> Column:
    """A 64-digit hash in any case as lower-case hex; null if it is none."""
    low = F.lower(text)
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def is_hash_name(name: Column) -> Column:
    return name.rlike("^[0-9a-f]{64}$")


def from_bytes(values: Column) -> Column:
    """An array of 32 integers, as stored manifests hold hashes, to hex."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")


def fan_out(hash_: Column) -> Column:
    """Partition key of the object store: the first two digits."""
    return F.substring(hash_, 1, 2)


def purge_id(path: Column, content: Column) -> Column:
    return F.substring(address(F.concat_ws(":", path, content)), 1, 16)


#: Escapes of JSON strings in the canonical form: short ones where there are some, lower-case digits elsewhere.
ESCAPES = {"\\": "\\\\", '"': '\\"'} | {chr(c): f"\\u{c:04x}" for c in range(0x20)} | {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_text(text: str) -> str:
    """A string as a JSON string literal in the canonical form."""
    return '"' + "".join([ESCAPES.get(c, c) for c in text]) + '"'


def json_string(text: Column) -> Column:
    """The same as an expression. The backslash is the first to be escaped."""
    for c, escape in ESCAPES.items():
        text = F.replace(text, F.lit(c), F.lit(escape))
    return F.concat(F.lit('"'), text, F.lit('"'))


def audit_body(seq: Column, ts: Column, event: Column, detail: Column, prev: Column) -> Column:
    """The compact JSON array whose hash chains the audit log: numbers and strings mixed."""
    quoted = [json_string(c) for c in (event, detail, prev)]
    return F.concat(F.lit("["), seq.cast("string"), F.lit(","), ts.cast("string"), *[x for q in quoted for x in (F.lit(","), q)], F.lit("]"))
