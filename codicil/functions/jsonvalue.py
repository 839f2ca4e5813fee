"""Digests of JSON values, independent of their notation."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import xxhash


def _number(text: str):
    """1, 1.0 and 10e-1 are one value; nothing is rounded."""
    if abs(len(text)) < 300 and not text.lstrip("-").isdigit():
        d = Decimal(text)
        if d == d.to_integral_value() and d.adjusted() < 300:
            return int(d)
        return {"\x00n": str(d.normalize())}
    return int(text) if len(text) < 300 else {"\x00n": text}


def _distinct_names(pairs: list) -> dict:
    return dict(pairs)  # of members with one name the last holds, as in most readers


_DECODER = json.JSONDecoder(parse_float=_number, parse_constant=lambda x: {"\x00c": x}, strict=False)
_ENCODER = json.JSONEncoder(sort_keys=True, ensure_ascii=True, separators=(",", ":"), check_circular=False)


def canonical(text: str | None) -> str:
    """One notation for each JSON value: members sorted, no blanks, one escape form.

    null (the SQL one) becomes "", text that is no JSON stays as it is behind
    a mark, so it is compared as text.
    """
    if text is None:
        return ""
    try:
        return _ENCODER.encode(_DECODER.decode(text))
    except (ValueError, RecursionError, ArithmeticError):
        return "\x00text:" + text


def digest_column(texts: list[str | None]) -> pa.Array:
    """64-bit digests, as signed longs."""
    h = xxhash.xxh3_64_intdigest
    out = [h(canonical(t).encode("utf-8", "surrogatepass")) for t in texts]
    return pa.array([x - (1 << 64) if x >> 63 else x for x in out], pa.int64())


def with_digest(column: str, name: str = "digest"):
    """For ``mapInArrow``: replaces ``column`` by the digest of its JSON value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            kept = [i for i in range(batch.num_columns) if i != at]
            arrays = [batch.column(i) for i in kept] + [digest_column(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + [name])

    return run
