"""The wire form of a batch: a header of twelve bytes, then records of a kind and two length-prefixed strings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf

#: Fixed values of the format: kinds that carry one string, kinds that carry two, and those without a sequence number.
ONE, TWO, UNNUMBERED = {0: "DEL", 7: "SINGLEDEL", 3: "LOGDATA", 19: "RANGEKEYDEL"}, {1: "SET", 2: "MERGE", 15: "RANGEDEL", 18: "SETWITHDEL", 20: "RANGEKEYUNSET", 21: "RANGEKEYSET", 23: "DELSIZED"}, {3}
HEADER = 12


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a length is cut off")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = _varint(data, at)
    if at + n > len(data):
        raise ValueError("a string is cut off")
    return data[at : at + n], at + n


def decode(data: bytes) -> Iterator[tuple[int, str, bytes, bytes | None]]:
    """(seq, kind, key, value) of each record; the header holds the first number and the count."""
    seq, count = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:HEADER], "little")
    at, found = HEADER, 0
    while at < len(data):
        kind, value = data[at], None
        key, at = _string(data, at + 1)
        if kind in TWO:
            value, at = _string(data, at)
        elif kind not in ONE:
            raise ValueError(f"kind {kind} is unknown")
        yield seq, TWO.get(kind) or ONE[kind], key, value
        if kind not in UNNUMBERED:
            seq, found = seq + 1, found + 1
    if found != count:
        raise ValueError(f"{found} records, the header says {count}")


def encode(seq: int, records: list[tuple[str, bytes, bytes | None]]) -> bytes:
    number = {name: k for k, name in (ONE | TWO).items()}

    def string(x: bytes) -> bytes:
        n, out = len(x), b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n]) + x

    body = b"".join(bytes([number[k]]) + string(key) + (string(value or b"") if number[k] in TWO else b"") for k, key, value in records)
    count = sum(number[k] not in UNNUMBERED for k, _, _ in records)
    return seq.to_bytes(8, "little") + count.to_bytes(4, "little") + body


@udtf(returnType="seq bigint, kind string, key binary, value binary")
class ParseBatch:
    """SQL table function over a batch's bytes."""

    def eval(self, data: bytes) -> Iterator[tuple[int, str, bytes, bytes | None]]:
        yield from decode(bytes(data))
