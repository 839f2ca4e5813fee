"""What changed between full snapshots.

Each snapshot is a set of (key, digest of the value). For every pair of
consecutive snapshots the symmetric difference is decoded from invertible Bloom
lookup tables, one per hash bucket: each element is added (+1) for the later
snapshot and subtracted (-1) for the earlier one in three cells, so equal
elements cancel and only the cells of differing elements remain. Peeling cells
that hold a single element recovers the differing key-hash pairs; buckets that
can't be peeled are built again with eight times the cells, twice at most, and
what fails even then (a matter of chance, or of buckets far beyond their size)
is compared element by element. The recovered hashes are joined back to the
records, their digests are verified there, and the keys are classified as added,
removed or changed.

Data moved: a value is read once, where it lies, and becomes a digest; hashes of
keys and digests (four numbers for each record) are partitioned by bucket, once,
and everything from there to the peeled elements happens in that stage, so equal
elements of neighbouring snapshots meet before anything else is moved. The
number of buckets follows the largest snapshot, so a bucket is bounded however
uneven the snapshots are. Rows repeated for one key are dropped in the task that
reads them.

Defined results: rows with a null key are left out; repeated rows of one key
count once, where the values of repeated rows differ the key takes the smallest
digest; a null value is a value of its own; snapshots without rows are empty
sets, so a key's first appearance is ``added``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions.jsonvalue import digest_column
from codicil.session import durable

_HASHES = 3
_DIFF = "pair int, bucket int, side int, h1 long, h2 long, digest long, failed boolean"
_ARROW = pa.schema([("pair", pa.int32()), ("bucket", pa.int32()), ("side", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("digest", pa.int64()), ("failed", pa.bool_())])
#: Keys that a task remembers to drop repeated rows.
_SEEN = 200_000


def _digests(n_keys: int, value: str):
    """For ``mapInArrow``: the value becomes its digest; a row whose key has had an equal or smaller digest in this task is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for batch in batches:
            kept = [i for i, name in enumerate(batch.schema.names) if name != value]
            digest = digest_column(batch.column(batch.schema.get_field_index(value)).to_pylist())
            new = []
            for i, (d, *key) in enumerate(zip(digest.to_pylist(), *(batch.column(c).to_pylist() for c in kept))):
                key = tuple(key)
                if least.get(key, d + 1) > d:
                    if len(least) >= _SEEN:
                        least.clear()
                    least[key] = d
                    new.append(i)
            made = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), digest], names=[*(batch.schema.names[c] for c in kept), "digest"])
            yield made if len(new) == batch.num_rows else made.take(pa.array(new, pa.int64()))

    return run


def _places(check: int, third: int) -> tuple[int, int, int]:
    """The three cells of an element, one in each third of the table."""
    return tuple(k * third + ((check >> (20 * k)) & 0xFFFFF) % third for k in range(_HASHES))


def _checksum(h1: int, h2: int, digest: int) -> int:
    """Spark's ``xxhash64(h1, h2, digest)``: each value is hashed with the hash before it as seed, 42 first."""
    seed = 42
    for x in (h1, h2, digest):
        seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
    return seed


def peel(cells: list[tuple], third: int) -> list[tuple] | None:
    """side, h1, h2, digest of all elements of a table, or None where cells remain. cells: place, n, h1, h2, digest, checksum."""
    table = {place: list(rest) for place, *rest in cells}
    found, todo = [], list(table)
    while todo:
        n, h1, h2, digest, chk = table[todo.pop()]
        if n not in (1, -1) or _checksum(h1, h2, digest) != chk & 0xFFFFFFFFFFFFFFFF:
            continue  # empty, or a mixture of elements
        found.append((n, h1, h2, digest))
        for place in _places(chk, third):
            t = table.setdefault(place, [0, 0, 0, 0, 0])
            t[:] = t[0] - n, t[1] ^ h1, t[2] ^ h2, t[3] ^ digest, t[4] ^ chk
            if t[0] in (1, -1):
                todo.append(place)
    return None if any(any(t) for t in table.values()) else found


def _peel_groups(n_cells: int):
    """For ``mapInArrow`` over cells sorted by pair and bucket: a group has at most ``n_cells`` rows."""
    columns = ("cell", "n", "h1", "h2", "digest", "chk")

    def rows(key: tuple, cells: list) -> list[tuple]:
        got = peel(cells, n_cells // _HASHES)
        return [(*key, 0, 0, 0, 0, True)] if got is None else [(*key, *x, False) for x in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells, out = None, [], []
        for batch in batches:
            for p, b, *cell in zip(*(batch.column(c).to_pylist() for c in ("pair", "bucket", *columns))):
                if (p, b) != key:
                    if cells:
                        out += rows(key, cells)
                    key, cells = (p, b), []
                cells.append(tuple(cell))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                out = []
        if cells:
            out += rows(key, cells)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return run


def _difference(elements: DataFrame, n_cells: int) -> DataFrame:
    """Sums the cells of both snapshots of each pair, and peels them. ``elements`` are partitioned by bucket and stay so."""
    third = n_cells // _HASHES
    places = F.array(*[F.lit(k * third) + F.shiftright("chk", 20 * k).bitwiseAND(F.lit(0xFFFFF)) % third for k in range(_HASHES)])
    cells = elements.withColumn("chk", F.xxhash64("h1", "h2", "digest")).withColumn("cell", F.explode(places))
    summed = cells.groupBy("pair", "bucket", "cell").agg(F.sum("side").alias("n"), *[F.bit_xor(c).alias(c) for c in ("h1", "h2", "digest", "chk")])
    left = summed.where("n != 0 or h1 != 0 or h2 != 0 or digest != 0 or chk != 0")
    return left.sortWithinPartitions("pair", "bucket").mapInArrow(_peel_groups(n_cells), _DIFF)


def _compared(elements: DataFrame) -> DataFrame:
    """The same difference without tables: the sum of each element's sides, in the partition of its bucket."""
    net = elements.groupBy("pair", "bucket", "h1", "h2", "digest").agg(F.sum("side").cast("int").alias("side")).where("side != 0")
    return net.select("pair", "bucket", "side", "h1", "h2", "digest", F.lit(False).alias("failed"))


def back_names(names: list[str], keys: list[str]) -> list:
    return [F.col(k).alias(n) for n, k in zip(names, keys)]


def snapshot_changes(
    df: DataFrame,
    snapshots: DataFrame,
    tag: str,
    keys: list[str],
    value: str,
    per_bucket: int = 4096,
    first_cells: int = 1536,
    rounds: int = 3,
) -> DataFrame:
    """tag, keys, change_kind for each pair of consecutive snapshots.

    ``snapshots``: ``tag`` and a running number from 0 in ``release_no``; pairs
    are made of neighbours. ``value`` holds JSON text, compared by value.
    ``per_bucket`` records of the largest snapshot share a lookup table of
    ``first_cells`` cells; buckets that can't be peeled get eight times as many
    in each of ``rounds`` rounds. All three steer speed only.
    """
    spark = df.sparkSession
    no = F.broadcast(snapshots.select(tag, "release_no"))  # a numbered register, bounded by ready_releases
    names, keys = keys, [f"_k{i}" for i in range(len(keys))]  # keys may have any name
    rows = df.select(F.col(tag).alias("_tag"), *[F.col(n).alias(k) for n, k in zip(names, keys)], F.col(value).alias("_value"))
    rows = rows.join(no.withColumnRenamed(tag, "_tag"), "_tag").select("release_no", *keys, "_value").where(" and ".join(f"{k} is not null" for k in keys))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_value"] + ["digest long"])
    digests = rows.mapInArrow(_digests(len(keys), "_value"), schema)
    digests = durable(digests.withColumns({"h1": F.xxhash64(*keys, F.lit(1)), "h2": F.xxhash64(*keys, F.lit(2))}), "digests")

    last = snapshots.agg(F.max("release_no")).first()[0]
    sizes = digests.groupBy("release_no").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    if not sizes["total"] or not last:
        return digests.limit(0).select(F.lit("").alias(tag), *back_names(names, keys), F.lit("").alias("change_kind"))
    n_buckets = max(1, -(-sizes["largest"] // per_bucket))
    # Pair i compares snapshot i with i+1: a snapshot is the later of one pair and the earlier of the next.
    sides = F.array(F.struct((F.col("release_no") - 1).alias("pair"), F.lit(1).alias("side")), F.struct(F.col("release_no").alias("pair"), F.lit(-1).alias("side")))
    n_tasks = max(min(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), sizes["total"] // 2_000_000)
    hashed = digests.select("release_no", "h1", "h2", "digest", F.pmod("h2", F.lit(n_buckets)).cast("int").alias("bucket"))

    def elements(source: DataFrame) -> DataFrame:
        one = source.repartition(n_tasks, "bucket").groupBy("bucket", "release_no", "h1", "h2").agg(F.min("digest").alias("digest"))
        both = one.select("h1", "h2", "digest", "bucket", F.explode(sides).alias("x")).select("x.*", "bucket", "h1", "h2", "digest")
        return both.where((F.col("pair") >= 0) & (F.col("pair") < last))

    parts, failed = [], None
    for n in range(rounds + 1):
        own = hashed if failed is None else hashed.join(failed.select("bucket").distinct(), "bucket", "left_semi")
        own = elements(own)
        if failed is not None:
            own = own.join(F.broadcast(failed), ["pair", "bucket"], "left_semi") if few else own.join(failed, ["pair", "bucket"], "left_semi")
        got = durable(_difference(own, first_cells * 8**n) if n < rounds else _compared(own), "difference")
        parts.append(got.where("not failed"))
        failed = got.where("failed").select("pair", "bucket")
        open_ = failed.limit(10_001).count()
        if not open_:
            break
        few = open_ <= 10_000
    diff = parts[0]
    for p in parts[1:]:
        diff = diff.unionByName(p)

    # Back to the records: the digest recovered must be that of a record of the snapshot it was recovered for.
    wanted = diff.select((F.col("pair") + F.when(F.col("side") == 1, 1).otherwise(0)).alias("release_no"), "pair", "side", "h1", "h2", "digest")
    back = digests.join(wanted, ["release_no", "h1", "h2", "digest"]).select("pair", "side", *keys).distinct()
    changed = back.groupBy("pair", *keys).agg(F.sum("side").alias("net"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") == 2, "changed").when(F.col("net") == 1, "added").otherwise("removed")
    later = F.broadcast(snapshots.select(tag, (F.col("release_no") - 1).alias("pair")))
    return changed.join(later, "pair").select(tag, *back_names(names, keys), kind.alias("change_kind"))
