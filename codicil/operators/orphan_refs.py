"""References to records that do not exist.

Keys are dictionary-encoded as integers: each task numbers the keys it holds, in
ranges of 32,768. For each period of a range the referenced and the held codes
become compressed bitmaps (containers that are sorted lists of codes while
sparse and bits where dense); references AND-NOT parents leaves the codes of
missing keys, which are decoded with the range's part of the dictionary, while
it is at hand: nothing but the keys is moved, and no bitmap leaves its task.

A key counts once for each period it is used in, however often it is referenced
(partial aggregation before the shuffle). The missing keys are joined back to the
references: a counted few are sent to where the references are; more are joined
with both sides split by a salt, as one key may have a third of all references.

Defined results: null references are no references; a reference repeated on a
record counts once; keys compare exactly, code point by code point; an empty
parent table makes every reference an orphan; empty references give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.session import durable

#: Codes of one range, and up to how many of them a container is a list.
BITS, SPARSE = 32768, 2048
#: Parts of the references to one key.
SALTS = 8


class Bitmap:
    """A compressed set of codes of one range."""

    def __init__(self, codes: list[int]):
        self.dense = len(codes) > SPARSE
        self.codes = np.array(codes, np.uint16)
        if self.dense:
            bits = np.zeros(BITS, bool)
            bits[self.codes] = True
            self.codes = np.packbits(bits, bitorder="little")

    def bits(self) -> np.ndarray:
        if self.dense:
            return self.codes
        bits = np.zeros(BITS, bool)
        bits[self.codes] = True
        return np.packbits(bits, bitorder="little")

    def and_not(self, other: Bitmap | None) -> np.ndarray:
        """The codes of this set that the other hasn't."""
        if other is None or (not self.dense and not other.dense):
            mine = self.codes if not self.dense else np.flatnonzero(np.unpackbits(self.codes, bitorder="little"))
            return mine if other is None else np.setdiff1d(mine, other.codes, assume_unique=True)
        return np.flatnonzero(np.unpackbits(self.bits() & ~other.bits(), bitorder="little"))


def _missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the keys of a task with the periods that ask for them and hold them: those asked for and not held."""
    domains: list[str] = []
    keys: list[str] = []
    asked: dict[str, list[int]] = {}
    held: dict[str, list[int]] = {}
    ever: list[list[str]] = []

    def decoded() -> pa.RecordBatch:
        at = {p: Bitmap(codes).and_not(Bitmap(held[p]) if p in held else None).tolist() for p, codes in asked.items()}
        rows = [(p, domains[i], keys[i], ever[i]) for p, codes in at.items() for i in codes]
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["period", "domain", "key", "held_in"])

    for batch in batches:
        for d, k, a, h in zip(*(batch.column(c).to_pylist() for c in ("domain", "key", "asked", "held"))):
            if not a:
                continue  # no one asks
            code = len(keys)
            domains.append(d)
            keys.append(k)
            ever.append(h)
            for p in a:
                asked.setdefault(p, []).append(code)
            for p in h:
                held.setdefault(p, []).append(code)
            if len(keys) == BITS:
                yield decoded()
                domains, keys, asked, held, ever = [], [], {}, {}, []
    if keys:
        yield decoded()


def missing_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """period, domain, key of all keys that are referenced in a period and not held in it; ``held_in``: the periods that do hold it."""
    used = references.where("key is not null and period is not null").select("domain", "key", "period", F.lit(1).alias("role")).unionByName(
        parents.where("key is not null and period is not null").select("domain", "key", "period", F.lit(2).alias("role")))
    # Sets of periods are bounded by the register of periods, however many references a key has.
    entries = used.groupBy("domain", "key").agg(
        F.collect_set(F.when(F.col("role") == 1, F.col("period"))).alias("asked"), F.collect_set(F.when(F.col("role") == 2, F.col("period"))).alias("held"))
    return entries.mapInArrow(_missing, "period string, domain string, key string, held_in array<string>")


def orphan_references(references: DataFrame, parents: DataFrame, held_in: str | None = None, few: int = 50_000) -> DataFrame:
    """The rows of ``references`` (period, domain, key and any further columns) whose key is absent.

    ``parents``: period, domain, key. ``domain`` names the table a key belongs to.
    ``held_in``: name of a further column with the periods that hold the key. Up to
    ``few`` missing keys are sent to the references, more are joined to them salted.
    """
    refs = references.where("key is not null and period is not null")
    missing = durable(missing_keys(references, parents), "missing")
    held = [] if held_in is None else [F.col("_held").alias(held_in)]
    missing = missing.select("period", "domain", "key", *([F.col("held_in").alias("_held")] if held else []))
    on, kept = ["period", "domain", "key"], refs.columns
    if missing.count() <= few:
        missing = F.broadcast(missing)  # at most ``few`` keys
    else:
        refs = refs.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in kept]), F.lit(SALTS)).cast("int"))
        missing = missing.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).hint("merge")
        on = [*on, "_salt"]
    return refs.join(missing, on, "inner" if held else "left_semi").select(*kept, *held)


def absence(period_no, held_nos):
    """Why a key is not there, by the order of the periods: never held, held before (deleted), only later (late), or both (a gap)."""
    before, after = F.exists(held_nos, lambda x: x < period_no), F.exists(held_nos, lambda x: x > period_no)
    return F.when(before & after, "gap").when(before, "deleted").when(after, "late").otherwise("missing")
