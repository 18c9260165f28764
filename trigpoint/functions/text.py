"""Trigrams, typos and readable numbers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(name: Column) -> Column:
    """Distinct windows of three characters over a name with two NULs on each side."""
    pad = F.concat(F.chr(F.lit(0)), F.chr(F.lit(0)))
    padded = F.concat(pad, name, pad)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) + 2), lambda i: F.substring(padded, i, F.lit(3))))


def typo(name: Column, kind: Column, at: Column) -> Column:
    """kind 0: the character at a place (from 1) becomes x; 1: it goes; else a q is put before it. Names of less than two characters get an a."""
    left, right = F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name))
    changed = F.when(kind == 0, F.concat(left, F.lit("x"), right)).when(kind == 1, F.concat(left, right)).otherwise(F.concat(left, F.lit("q"), F.substring(name, at, F.length(name))))
    return F.when(F.length(name) < 2, F.concat(name, F.lit("a"))).otherwise(changed)


#: Fixed value: the white space of Unicode, which requests may have around their parts.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trimmed(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def byte_size(n: Column) -> Column:
    """Bytes in the largest binary unit with one decimal."""
    units = ("KiB", "MiB", "GiB", "TiB")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, u in enumerate(units, 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {u}"))).otherwise(out)
    return out


def duration(ns: Column) -> Column:
    """Nanoseconds as 1.5s, 20.25ms, 7µs or 12ns: in the largest unit that gives at least one, without zeros at the end; 0s for none."""
    out = F.concat(ns.cast("string"), F.lit("ns"))
    for unit, size, digits in (("µs", 1_000, 3), ("ms", 1_000_000, 6), ("s", 1_000_000_000, 9)):
        rest = F.regexp_replace(F.concat(F.lit("."), F.lpad((ns % size).cast("string"), digits, "0")), r"\.?0+$", "")
        out = F.when(ns >= size, F.concat(F.floor(ns / size).cast("string"), rest, F.lit(unit))).otherwise(out)
    return F.when(ns == 0, "0s").otherwise(out)
