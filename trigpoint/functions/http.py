"""Validators of responses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the polynomial of the tag's CRC-32, its lowest power in the highest bit.
POLYNOMIAL = 0xD5828281


def _table() -> list[int]:
    out = []
    for crc in range(256):
        for _ in range(8):
            crc = crc >> 1 ^ (POLYNOMIAL if crc & 1 else 0)
        out.append(crc)
    return out


def crc32_of(body: Column) -> Column:
    """The CRC-32 of a binary column by POLYNOMIAL."""
    table = F.array(*(F.lit(x).cast("long") for x in _table()))
    byte = lambda i: F.conv(F.hex(F.substring(body, i, F.lit(1))), 16, 10).cast("long")
    places = F.when(F.length(body) > 0, F.sequence(F.lit(1), F.length(body))).otherwise(F.array().cast("array<int>"))
    step = lambda crc, i: F.shiftright(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)).cast("int")))
    return F.aggregate(places, F.lit(0xFFFFFFFF).cast("long"), step, lambda crc: crc.bitwiseXOR(F.lit(0xFFFFFFFF)))


def etag(body: Column, status: Column | None = None, method: Column | None = None) -> Column:
    """`"<bytes>-<crc>"` of a body as text; null for an empty one, for other statuses than 200, and for other methods than GET and HEAD."""
    raw = F.encode(body, "UTF-8")
    out = F.when(F.length(raw) > 0, F.concat(F.lit('"'), F.length(raw).cast("string"), F.lit("-"), crc32_of(raw).cast("string"), F.lit('"')))
    out = out if status is None else F.when(status == 200, out)
    return out if method is None else F.when(method.isin("GET", "HEAD"), out)


def not_modified(tag: Column, if_none_match: Column) -> Column:
    """Whether a client that sent If-None-Match has the body that a tag stands for. A weak tag is compared with the tag, and with the tag
    without its first two characters; others may be anywhere in what was sent. Without a tag: false."""
    sent = F.coalesce(if_none_match, F.lit(""))
    rest = F.substring(sent, F.lit(3), F.length(sent))
    weak = (rest == tag) | (rest == F.substring(tag, F.lit(3), F.length(tag)))
    return F.coalesce(F.when(sent.startswith("W/"), weak).otherwise(F.contains(sent, tag)), F.lit(False))
