"""Content-addressed identities: SHA-256 over canonical bytes, as columns and, bit for bit the same, on the driver.

Canonical bytes: texts are their length (eight bytes, big-endian) and UTF-8; digests are 32
raw bytes; numbers are eight bytes, big-endian; values are a kind byte and their payload
(text for string, atom, decimal, date and timestamp, a number for int64 and duration).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values as V
from ..values import Value
from .columns import Typed

#: The namespace of the domain tags; a parameter, so that identities of other systems can be reproduced.
NAMESPACE = "quillgraph"


def tag(name: str, namespace: str = NAMESPACE) -> str:
    return f"{namespace}.{name}.v1"


def number(n: int) -> bytes:
    return (n % 2**64).to_bytes(8, "big")


def text(s: str) -> bytes:
    raw = s.encode("utf-8")
    return number(len(raw)) + raw


def raw_digest(digest: str) -> bytes:
    if not digest.startswith("sha256:") or len(digest) != 71 or digest.lower() != digest:
        raise ValueError(f"no digest: {digest!r}")
    return bytes.fromhex(digest[7:])


def value(v: Value) -> bytes:
    body = number(v.data) if v.kind in (V.INT64, V.DURATION) else text(v.text())
    return bytes([V.KIND_BYTES[v.kind]]) + body


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def lineage_id(namespace_text: str, root_key: str, domain: str = NAMESPACE) -> str:
    if not namespace_text or not root_key:
        raise ValueError("a lineage needs a namespace and a root key")
    return digest(text(tag("lineage-root", domain)) + text(namespace_text) + text(root_key))


def source_id(lineage: str, kind: str, key: str, domain: str = NAMESPACE) -> str:
    return digest(text(tag("source-entity", domain)) + raw_digest(lineage) + text(kind) + text(key))


def synthetic_id(lineage: str, kind: str, rule: str, progenitors: Iterable[str], discriminator: Value, domain: str = NAMESPACE) -> str:
    ids = sorted(progenitors)
    body = text(tag("synthetic-entity", domain)) + raw_digest(lineage) + text(kind) + text(rule) + number(len(ids))
    return digest(body + b"".join(map(raw_digest, ids)) + value(discriminator))


def number_column(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def text_column(s: Column) -> Column:
    return F.concat(number_column(F.octet_length(s)), F.encode(s, "utf-8"))


def constant(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def timestamp_text(ns: Column) -> Column:
    """The canonical text of a timestamp column."""
    from .columns import NS, day_of, floor_div

    second = F.pmod(floor_div(ns, NS), F.lit(86400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rest = F.pmod(ns, F.lit(NS))
    tail = F.when(rest == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 9, "0"), F.lit("0"))))
    return F.concat(F.date_format(day_of(ns), "yyyy-MM-dd"), F.lit("T"), two(F.call_function("div", second, F.lit(3600))), F.lit(":"), two(F.call_function("div", second, F.lit(60)) % 60), F.lit(":"), two(second % 60), tail, F.lit("Z"))


def value_column(t: Typed) -> Column:
    mark = constant(bytes([V.KIND_BYTES[t.kind]]))
    if t.kind in (V.INT64, V.DURATION):
        return F.concat(mark, number_column(t.col))
    if t.kind == V.DECIMAL:
        return F.concat(mark, text_column(t.text()))
    if t.kind == V.DATE:
        return F.concat(mark, text_column(F.date_format(t.col, "yyyy-MM-dd")))
    return F.concat(mark, text_column(timestamp_text(t.col) if t.kind == V.TIMESTAMP else t.col))


def digest_column(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def source_id_column(lineage: str, kind: str, key: Column, domain: str = NAMESPACE) -> Column:
    head = text(tag("source-entity", domain)) + raw_digest(lineage) + text(kind)
    return digest_column(F.concat(constant(head), text_column(key)))


def synthetic_id_column(lineage: str, kind: str, rule: str, progenitors: Column, discriminator: Typed, domain: str = NAMESPACE) -> Column:
    """progenitors: an array of ids. The bytes of all of them are hashed together, so an identity takes 32 bytes of memory for each."""
    head = text(tag("synthetic-entity", domain)) + raw_digest(lineage) + text(kind) + text(rule)
    ids = F.array_sort(F.transform(progenitors, lambda i: F.substring(i, 8, 64)))
    return digest_column(F.concat(constant(head), number_column(F.size(ids)), F.unhex(F.array_join(ids, "")), value_column(discriminator)))
