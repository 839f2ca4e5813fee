"""Reading corpus records, and the files and artifacts around them."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import subprocess
import tarfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from codicil import schemas
from codicil.errors import PipelineError
from codicil.sources import files


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON object each, with the text beside the parsed columns; a file that is none fails."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("record"), F.col("_metadata.file_path").alias("file"))
    parsed = text.withColumn("r", F.from_json("record", schema, {"mode": "FAILFAST"}))
    return parsed.select("file", "record", "r.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their line number from 1; blank lines are skipped and keep their number.

    Line order has meaning, so a file is one row before it is split; it is a
    list of the records of one act and stays well below a task's memory.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "record"))
    rows = whole.where(F.trim("record") != "").select("file", (F.col("i") + 1).alias("line"), "record")
    parsed = rows.withColumn("r", F.from_json("record", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("file", "line", "record", "r.*")


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON object, with their place."""
    return lines.where("_corrupt_record is not null").select("file", "line", F.left("record", F.lit(120)).alias("excerpt"))


#: The files of a corpus: one list of sources, and three files in each act's folder.
EXPECTED = ("sources.jsonl",)
PER_ACT = ("act.json", "provisions.jsonl", "citations.jsonl")


def layout(spark: SparkSession, root: str) -> DataFrame:
    """Missing and unexpected files below ``root``: kind, path (relative)."""
    base = root.rstrip("/") + "/"
    # The listing, not the rows, since empty files have none; a release has three files for each act.
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).inputFiles()
    listed = spark.createDataFrame([(unquote(n),) for n in names], "path string")
    have = listed.select(F.regexp_replace("path", "^.*?" + re.escape(base), "").alias("path"))
    acts = have.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("dir")).where("dir <> ''").distinct()
    want = acts.select(F.explode(F.array(*[F.concat("dir", F.lit("/" + f)) for f in PER_ACT])).alias("path"))
    want = want.unionByName(spark.createDataFrame([(f,) for f in EXPECTED], "path string"))
    missing = want.join(have, "path", "left_anti").select(F.lit("missing").alias("kind"), "path")
    return missing.unionByName(have.join(want, "path", "left_anti").select(F.lit("unexpected").alias("kind"), "path"))


def load_corpus(spark: SparkSession, root: str, release_tag: str) -> dict[str, DataFrame]:
    """The records of one release folder, checked for layout; record text, file and line are kept."""
    problems = layout(spark, root).limit(20).collect()
    if problems:
        raise PipelineError("invalid_corpus_layout", "; ".join(f"{p['kind']}: {p['path']}" for p in problems))
    base = root.rstrip("/")
    out = {
        "acts": read_object(spark, f"{base}/*/*/acts/*/*/act.json", schemas.ACT), "provisions": read_lines(spark, f"{base}/*/*/acts/*/*/provisions.jsonl", schemas.PROVISION),
        "citations": read_lines(spark, f"{base}/*/*/acts/*/*/citations.jsonl", schemas.CITATION), "sources": read_lines(spark, f"{base}/sources.jsonl", schemas.SOURCE)}
    return {k: v.withColumn("release_tag", F.lit(release_tag)) for k, v in out.items()}


def unsorted_sources(sources: DataFrame) -> DataFrame:
    """Sources whose id is not above the one on the line before."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line")
    return sources.withColumn("before", F.lag("source_id").over(w)).where("before >= source_id").select("line", "source_id")


# Documents as bytes.


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as binary rows: path, content, length, sha256, and why a file can't be a document."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    head = F.substring("content", 1, 1024)
    reason = (
        F.when(F.col("length") > 100_000_000, "too_large").when(F.lower(F.decode(F.substring("content", 1, 256), "ISO-8859-1")).rlike("^\\s*<(!doctype html|html)"), "html")
        .when(F.instr(F.decode(head, "ISO-8859-1"), "%PDF-") == 0, "not_pdf"))
    return rows.withColumns({"source_id": F.concat(F.lit("sha256:"), F.sha2("content", 256)), "problem": reason})


def verify_documents(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose bytes are absent or differ in length or digest."""
    j = sources.select("source_id", "byte_length").join(documents.select("source_id", "length"), "source_id", "left")
    why = F.when(F.col("length").isNull(), "missing_or_changed").when(F.col("length") != F.col("byte_length"), "length")
    return j.select("source_id", why.alias("problem")).where("problem is not null")


def inspect_pages(documents: DataFrame, inspect: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of an injected inspector over each document's bytes (page count, content evidence, native text, OCR).

    The inspector yields one dict for each page; a document that can't be read
    gives one row with ``inspection_error`` and does not stop the others.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column("source_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = [{"source_id": source} | r for r in inspect(content)]
                except Exception as e:  # noqa: BLE001 - any failure of one document is its own result
                    rows = [{"source_id": source, "inspection_error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return documents.select("source_id", "content").mapInArrow(run, schema)


def pdf_inspector(content: bytes) -> Iterator[dict]:
    """Native text of each page, where a PDF reader is installed."""
    try:
        import io

        import pypdf
    except ImportError as e:
        raise PipelineError("inspector_unavailable", "no PDF reader is installed") from e
    reader = pypdf.PdfReader(io.BytesIO(content))
    if reader.is_encrypted or not 1 <= len(reader.pages) <= 2000:
        raise PipelineError("unusable_pdf", "encrypted, empty or more than 2000 pages")
    for i, page in enumerate(reader.pages, 1):
        yield {"pdf_page": i, "text": page.extract_text() or "", "inspection_error": None}


def require_models(folder: str, names: tuple[str, ...]) -> None:
    """The files an OCR adapter needs are in place."""
    missing = [n for n in names if not os.path.exists(os.path.join(folder, n))]
    if missing:
        raise PipelineError("ocr_models_missing", ", ".join(missing))


def fetch(url: str, opener: Callable[[str], tuple[int, Iterator[bytes]]], sleep: Callable[[float], None], attempts: int = 2, cap: int = 100_000_000) -> tuple[bytes, str]:
    """Content and digest of a document through an injected opener; once more after a passing failure."""
    for n in range(attempts):
        try:
            status, chunks = opener(url)
            if status in (408, 425, 429, 500, 502, 503, 504):
                raise PipelineError("download_failed", f"status {status}", retryable=True)
            if status != 200:
                raise PipelineError("download_failed", f"status {status}")
            digest, parts, size = hashlib.sha256(), [], 0
            for c in chunks:
                size += len(c)
                if size > cap:
                    raise PipelineError("too_large", f"more than {cap} bytes")
                digest.update(c)
                parts.append(c)
            content = b"".join(parts)
            if b"%PDF-" not in content[:1024]:
                raise PipelineError("not_pdf", "no PDF header in the first KiB")
            return content, "sha256:" + digest.hexdigest()
        except PipelineError as e:
            if not e.retryable or n + 1 == attempts:
                raise
            sleep(0.5 * (n + 1))
    raise AssertionError


def tagged_release(repository: str, tag: str, folder: str, below: str = "corpus") -> tuple[str, str]:
    """Commit and corpus folder of an exact Git tag: the files of that commit are put into ``folder``, whatever is checked out.

    A branch or a commit of that name is no tag. Paths that would leave the folder are refused.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", tag):
        raise PipelineError("invalid_release_tag", tag)

    def git(*args: str) -> bytes:
        done = subprocess.run(["git", "-C", repository, *args], capture_output=True, check=False)
        if done.returncode:
            raise PipelineError("release_tag_missing", done.stderr.decode(errors="replace").strip() or tag)
        return done.stdout

    commit = git("rev-parse", "--verify", "--end-of-options", f"refs/tags/{tag}^{{commit}}").decode().strip()
    with tarfile.open(fileobj=io.BytesIO(git("archive", "--format=tar", commit, below))) as tar:
        tar.extractall(folder, filter="data")
    return commit, os.path.join(folder, below)


#: Members of an acquisition request.
REQUEST_FIELDS = ("url", "document_title", "document_publisher", "language", "source_class")
REQUEST_OPTIONAL = ("publication", "provider_name", "redistribution", "document_notes", "notes")


def load_request(text: str) -> dict:
    """A checked acquisition request: required members present and non-blank, none unknown, defaults filled."""
    value = json.loads(text)
    if not isinstance(value, dict):
        raise PipelineError("invalid_request", "a request is an object")
    missing = [f for f in REQUEST_FIELDS if not isinstance(value.get(f), str) or not value[f].strip()]
    unknown = sorted(set(value) - set(REQUEST_FIELDS) - set(REQUEST_OPTIONAL))
    if missing or unknown:
        raise PipelineError("invalid_request", f"missing {missing}, unknown {unknown}")
    return {"publication": None, "provider_name": None, "redistribution": {"status": "not_researched", "license": None, "notes": None}, "document_notes": [], "notes": None} | value


def load_artifact(root: str, relative: str, stage: str, source_id: str | None = None) -> dict:
    """A stage artifact below ``root``: path stays inside, it names itself, its stage and its source."""
    if files.is_remote(root):
        if relative.startswith("/") or ".." in relative.split("/"):
            raise PipelineError("artifact_outside_cache", relative)
        path = files.join(root, relative)
    else:
        base = os.path.realpath(root)
        path = os.path.realpath(os.path.join(base, relative))
        if os.path.commonpath([base, path]) != base:
            raise PipelineError("artifact_outside_cache", relative)
    value = json.loads(files.read(path))
    if value.get("stage") != stage or value.get("path") != relative or (source_id and value.get("source_id") != source_id):
        raise PipelineError("artifact_mismatch", relative)
    return value


def lineage(artifacts: DataFrame) -> DataFrame:
    """Chains structure, extraction, classification, receipt by path: broken links and differing sources.

    ``artifacts``: path, stage, source_id, input_path.
    """
    up = artifacts.select(F.col("path").alias("input_path"), F.col("source_id").alias("up_source"), F.lit(True).alias("_held"))
    j = artifacts.where("input_path is not null").join(up, "input_path", "left")
    why = F.when(F.col("_held").isNull(), "missing_input").when(~F.col("source_id").eqNullSafe(F.col("up_source")), "other_source")
    return j.select("path", "stage", why.alias("problem")).where("problem is not null")
