"""Scalar functions on versioned keys: a key is a prefix and a suffix, `prefix@timestamp`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bits of a trailer that hold the kind of an operation.
KIND_BITS = 8


def prefix(key: Column) -> Column:
    return F.regexp_replace(key, "@[0-9]+$", "")


def suffix(key: Column) -> Column:
    """The timestamp of a key, null for none."""
    found = F.regexp_extract(key, "@([0-9]+)$", 1)
    return F.when(found != "", found).cast("long")


def trailer(seq: Column, kind: Column) -> Column:
    return F.shiftleft(seq, KIND_BITS).bitwiseOR(kind)


def trailer_seq(t: Column) -> Column:
    return F.shiftright(t, KIND_BITS)


def trailer_kind(t: Column) -> Column:
    return t.bitwiseAND((1 << KIND_BITS) - 1)


def immediate_successor(key: Column) -> Column:
    """The least binary key above."""
    return F.concat(key, F.lit(b"\0"))


def abbreviated(key: Column) -> Column:
    """An order-preserving digest: the first eight bytes, filled with zero bytes, in hexadecimal."""
    return F.rpad(F.hex(F.substring(key, 1, 8)), 16, "0")


def validate(key: Column, at_most: int = 1 << 16) -> Column:
    """Whether a binary key may be written: not null and not too long for a length of two bytes."""
    return key.isNotNull() & (F.octet_length(key) < at_most)


# Engine keys: a prefix, a zero byte, and a version (wall time of 8 bytes, maybe a logical part of 4) with its length.

#: The lengths that close a key, with the zero byte and themselves counted as the format does.
WALL, WALL_LOGICAL, BARE = 9, 13, 0


def engine_key(prefix: Column, wall: Column | None = None, logical: Column | None = None) -> Column:
    """The binary form, newest first only by `engine_order`; a logical part of null or 0 isn't written."""
    if wall is None:
        return F.concat(prefix, F.lit(b"\0"))
    hexed = lambda n, width: F.unhex(F.lpad(F.hex(n), width, "0"))
    has = F.coalesce(logical, F.lit(0)) != 0 if logical is not None else F.lit(False)
    tail = F.when(has, F.concat(hexed(logical if logical is not None else F.lit(0), 8), F.lit(bytes([WALL_LOGICAL])))).otherwise(F.lit(bytes([WALL])))
    return F.concat(prefix, F.lit(b"\0"), hexed(wall, 16), tail)


def _closing(key: str) -> Column:
    """Bytes of the version with the zero byte's place, by the last byte."""
    return F.conv(F.hex(F.substring(key, -1, 1)), 16, 10).cast("int")


def engine_prefix(key: str) -> Column:
    n = _closing(key)
    return F.substring(F.col(key), F.lit(1), F.octet_length(key) - F.when(n == 0, 1).otherwise(n + 1))


def _version(key: str, skip: int, width: int) -> Column:
    n = _closing(key)
    first = F.octet_length(key) - n + 1 + skip
    return F.conv(F.hex(F.substring(F.col(key), first, F.lit(width))), 16, 10).cast("long")


def engine_wall(key: str) -> Column:
    return F.when(_closing(key) >= WALL, _version(key, 0, 8))


def engine_logical(key: str) -> Column:
    return F.when(_closing(key) == WALL_LOGICAL, _version(key, 8, 4)).when(_closing(key) == WALL, F.lit(0).cast("long"))


def engine_order(key: str) -> list[Column]:
    """Prefix in byte order, keys without a version first, then the newest."""
    return [engine_prefix(key), engine_wall(key).isNotNull(), -engine_wall(key), -engine_logical(key)]
