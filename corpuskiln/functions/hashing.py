"""Hash keys and hash-ordered draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """The text as a JSON string, other than ASCII kept as it is."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)


def identity_key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.sha2(json_string(value), 256))


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts with null characters between."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def unit(digest: Column) -> Column:
    """A digest as a number in [0, 1), by its first 52 bits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 2.0**52


def split_of(draw: Column, fractions: list[tuple[str, float]]) -> Column:
    """The split in whose part of [0, 1) a number falls; the last one also takes what rounding leaves."""
    total, result = 0.0, None
    for name, fraction in fractions[:-1]:
        total += fraction
        result = F.when(draw < total, name) if result is None else result.when(draw < total, name)
    last = fractions[-1][0]
    return F.lit(last) if result is None else result.otherwise(last)


def set_digest(line: Column) -> Column:
    """An aggregate: the digest of a multiset of lines, whatever their order. It adds up parts of the lines' digests, so
    groups of any size are combined before the shuffle and never collected."""
    digest = F.sha2(line, 256)
    parts = (F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31, 46))
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in parts)), 256)
