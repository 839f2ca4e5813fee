"""Writing records, artifacts and projection tables."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.errors import PipelineError
from codicil.session import durable
from codicil.sources import files


def json_text(row: Column) -> Column:
    """A struct as compact JSON in field order; nulls are written, since they are part of the contract."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def json_bytes(value) -> bytes:
    """One object, two blanks of indent, key order as given, a final line feed."""
    return (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()


def jsonl_bytes(values) -> bytes:
    return "".join(json.dumps(v, ensure_ascii=False, separators=(",", ":")) + "\n" for v in values).encode()


def write_lines(df: DataFrame, order: list[str], text: str, path: str) -> None:
    """Lines in order over all files: range partitions, sorted within, so reading files by name gives the order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.text(path)


def write_atomically(path: str, data: bytes) -> None:
    """An artifact appears whole or not at all, in the file system of its path."""
    files.write(path, data)


def write_artifact(root: str, relative: str, result: dict) -> dict:
    """A stage artifact that names its own path."""
    result = result | {"path": relative}
    write_atomically(files.join(root, relative), json_bytes(result))
    return result


def store_documents(documents: DataFrame, store: str) -> DataFrame:
    """Adds documents that the content-addressed store lacks; returns what was added."""
    spark = documents.sparkSession
    new = documents.where("problem is null").select("source_id", "content", "length").dropDuplicates(["source_id"])
    if files.exists(store):
        new = new.join(spark.read.parquet(store).select("source_id"), "source_id", "left_anti")
    new = durable(new, "stored")
    new.write.mode("append").parquet(store)
    return new.select("source_id", "length")


def collisions(stored: DataFrame, documents: DataFrame) -> DataFrame:
    """Equal digests over unequal lengths."""
    return stored.join(documents.select("source_id", F.col("length").alias("other")), "source_id").where("length <> other").select("source_id")


def same_files(wanted: dict[str, bytes], folder: str) -> bool:
    """Whether a folder holds these files with these bytes and nothing else."""
    have = {}
    for d, _, names in os.walk(folder):
        for name in names:
            with open(os.path.join(d, name), "rb") as f:
                have[os.path.relpath(os.path.join(d, name), folder)] = f.read()
    return have == wanted


def write_candidate(wanted: dict[str, bytes], folder: str) -> str:
    """Writes a candidate folder once: the same bytes again are no change, other bytes are refused."""
    if os.path.isdir(folder):
        if same_files(wanted, folder):
            return "unchanged"
        raise PipelineError("candidate_edited", folder)
    part = f"{folder}.{uuid.uuid4().hex}.part"
    for name, data in wanted.items():
        write_atomically(os.path.join(part, name), data)
    os.rename(part, folder)
    return "written"


def merge_sources(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry with new sources by id, sorted; one that is held under the same id with other content is refused at the caller by ``changed_sources``."""
    return registry.unionByName(new.join(registry.select("source_id"), "source_id", "left_anti")).orderBy("source_id")


def changed_sources(registry: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(registry.select("source_id", F.col("record").alias("held")), "source_id").where("record <> held").select("source_id")


def append_event(root: str, table: str, event: dict) -> None:
    """Receipts, passes and progress: one JSON file for each event, so concurrent writers never meet."""
    write_atomically(files.join(root, table, f"{uuid.uuid4().hex}.json"), jsonl_bytes([event]))


def refresh(spark: SparkSession) -> None:
    """After an activation nothing cached of the release before may be read."""
    spark.catalog.clearCache()
