"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight schedule: a piecewise linear function of training time
from 0 to 1. The schedules are balanced so that at every knot the weights of all
sources sum to 1 and each source's integral is its target share. A source's
cumulative token demand is total x integral of its weight up to t; inverting it
turns the running number of tokens delivered by the source into a training
position, and documents are range-sorted by position.

The total is the largest at which every source that has documents can give its
share within its number of repeats. A document is used floor(demand /
available) times, and once more if it is among the first in hash order that
fill the rest, so uses differ by at most one within a source.

A source may hold any share of the rows: running sums are taken within hash
buckets of each source, and only one number for each bucket is added up across
them.

Defined results: rows with a null id, an unlisted or null source are not used;
null and empty texts have no tokens and are not used; a listed source without
tokens gets a row in the report with an actual share of 0 and the others are
scaled up; repeated rows of one document count once, and a document under several
listed sources counts in the first by name; an empty table gives empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a hash bucket, within which running sums are taken; bytes of a vocabulary file at most.
PER_BUCKET, VOCABULARY_BYTES = 10_000, 64_000_000


@lru_cache(4)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(column: str, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index(column)
            tokens = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(tokens, pa.int64())], names=[*(batch.schema.names[i] for i in kept), "tokens"])

    return run


def count_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``tokens`` instead of ``text``; whole texts are encoded. The vocabulary file is read here and sent to the workers."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read(VOCABULARY_BYTES + 1)
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer} has more than {VOCABULARY_BYTES} bytes")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + ["tokens long"])
    return df.mapInArrow(_count(text, shared), schema)


def balance(shares: np.ndarray, raw: np.ndarray, rounds: int = 10_000, error: float = 1e-10) -> np.ndarray:
    """Weights (source, knot) with column sums 1 and integrals ``shares``, in the proportions of ``raw``; iterated until both hold within ``error``."""
    knots = raw.shape[1]
    area = np.full(knots, 1 / (knots - 1))  # trapezoids
    area[[0, -1]] /= 2
    w = raw * shares[:, None]
    for _ in range(rounds):
        w = w * (shares / (w @ area))[:, None]
        w = w / w.sum(0)
        if np.abs(w @ area - shares).max() <= error:
            return w
    raise ValueError(f"the schedules can't be balanced within {error}: weights of 0 leave no way to the target shares")


def ramp(max_repeats: Sequence[int], knots: int = 5) -> np.ndarray:
    """Default schedule: the more often a source may repeat, the more of it comes late."""
    r = np.asarray(max_repeats, float)
    return 1 + np.linspace(0, 1, knots)[None, :] * ((r - 1) / max(1.0, r.max()))[:, None]


def plan(targets: list[tuple[str, float, int]], available: Mapping[str, int], schedule: np.ndarray | None = None) -> dict:
    """Demand and balanced weights of each listed source that has tokens, for the largest exact total."""
    shares = {s: p for s, p, r in targets if available.get(s, 0) > 0 and p > 0 and r > 0}
    whole = sum(shares.values())
    if not whole:
        return {}
    repeats = {s: r for s, _, r in targets}
    shares = {s: p / whole for s, p in shares.items()}
    total = min(repeats[s] * available[s] / p for s, p in shares.items())
    names = sorted(shares)
    at = [i for i, (s, _, _) in sorted(enumerate(targets), key=lambda x: x[1][0]) if s in shares]
    raw = ramp([repeats[s] for s in names]) if schedule is None else schedule[at]
    weights = balance(np.array([shares[s] for s in names]), raw)
    out = {}
    for s, w in zip(names, weights):
        steps = (w[1:] + w[:-1]) / 2 / (len(w) - 1)
        demand = min(total * shares[s], float(repeats[s] * available[s]))
        out[s] = {"demand": demand, "available": int(available[s]), "weights": (w / steps.sum()).tolist(), "filled": np.concatenate([[0], np.cumsum(steps) / steps.sum()]).tolist()}
    return out


def invert(y, weights, filled):
    """Training time at which a source has delivered the fraction ``y`` of its demand (Spark columns).

    Within a step of length h the integral is filled + w0 x + (w1 - w0) x^2 / 2h.
    """
    n = F.size(filled) - 1
    step = F.least(n, F.greatest(F.lit(1), F.size(F.filter(filled, lambda f: f <= y))))
    h = 1 / n
    w0, w1, left = F.element_at(weights, step), F.element_at(weights, step + 1), y - F.element_at(filled, step)
    slope = (w1 - w0) / h
    # 2 left / (w0 + sqrt(w0^2 + 2 slope left)) is the root without cancellation.
    x = 2 * left / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * left)))
    return F.least(F.lit(1.0), (step - 1) * h + F.least(h, F.coalesce(x, F.lit(0.0))))


class Mixture:
    """The planned mixture of ``docs`` (doc_id, source, text) for ``targets`` (source, target_share, max_repeats)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, schedule: np.ndarray | None = None):
        spark = docs.sparkSession
        rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("p"), F.max("max_repeats").alias("r")).orderBy("source").limit(100_001).collect()
        if len(rows) > 100_000:
            raise ValueError("more than 100,000 sources")
        self.targets = [(r["source"], float(r["p"] or 0), int(r["r"] or 0)) for r in rows]
        listed = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in self.targets], "source string"))
        used = docs.where("doc_id is not null").select("doc_id", "source", "text").join(listed, "source", "left_semi")
        counted = count_tokens(used, "text", tokenizer).where("tokens > 0")
        counted = counted.groupBy("doc_id").agg(F.min(F.struct("source", F.negative("tokens").alias("t"))).alias("x")).select("doc_id", "x.source", F.negative("x.t").alias("tokens"))
        counted = durable(counted.withColumn("h", F.xxhash64("doc_id", F.lit("mixture"))), "tokens")
        buckets = max(1, -(-counted.count() // PER_BUCKET))  # of each source, so that none outgrows a task
        self.docs = counted.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
        sums = self.docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        self.available = {r[0]: r[1] for r in self.docs.groupBy("source").agg(F.sum("tokens")).collect()}
        self.plan = plan(self.targets, self.available, schedule)
        self.planned = spark.createDataFrame(
            [(s, p["demand"], p["available"], p["weights"], p["filled"]) for s, p in self.plan.items()],
            "source string, demand double, available long, weights array<double>, filled array<double>")
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source", "bucket", "offset")
        within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        placed = self.docs.withColumn("start", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        placed = placed.join(offsets, ["source", "bucket"]).withColumn("start", F.col("start") + F.col("offset")).join(F.broadcast(self.planned), "source")
        full = F.floor(F.col("demand") / F.col("available"))
        rest = F.col("demand") - full * F.col("available")
        # Of the last pass the documents whose middle lies within the rest.
        self.chosen = placed.withColumn("uses", full + F.when(F.col("start") + F.col("tokens") / 2 < rest, 1).otherwise(0)).where("uses > 0")

    def _position(self, copy):
        done = copy * F.col("available") + F.col("start") + F.col("tokens") / 2
        return invert(F.least(F.lit(1.0), done / F.col("demand")), F.col("weights"), F.col("filled"))

    def documents(self) -> DataFrame:
        """doc_id, source, tokens, uses and the position of the first use, range-sorted by it."""
        placed = self.chosen.select("doc_id", "source", "tokens", "uses", self._position(F.lit(0)).alias("first_position"))
        return placed.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")

    def order(self) -> DataFrame:
        """One row for each use, range-sorted by training position."""
        uses = self.chosen.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("uses").cast("int") - 1)))
        placed = uses.select("doc_id", "source", "copy", "tokens", self._position(F.col("copy")).alias("position"))
        return placed.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")

    def shares(self) -> DataFrame:
        """Target and actual share of each listed source."""
        spark = self.docs.sparkSession
        got = self.chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum("uses").alias("n_uses"), F.count(F.lit(1)).alias("n_documents"), F.max("uses").alias("most_uses"))
        listed = spark.createDataFrame(self.targets, "source string, target_share double, max_repeats int")
        both = F.broadcast(listed).join(got, "source", "left").fillna(0, ["used_tokens", "n_uses", "n_documents", "most_uses"])
        total = got.agg(F.sum("used_tokens").alias("total"))
        return both.join(F.broadcast(total), F.lit(True), "left").select(  # one row beside the listed sources
            "source", "target_share", "max_repeats", "n_documents", "n_uses", "most_uses", "used_tokens",
            F.round(F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
