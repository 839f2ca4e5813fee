"""Recognition of scanned pages by an injected engine, in small batches and from page checkpoints.

The engine is two callables: ``render(document, page)`` gives an image, and
``recognise(images)`` a result (texts, scores, boxes) for each. Results are
appended to a table of checkpoints under the page's key, which covers the
engine's profile, so that a run that is started again does only what is pending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codicil.operators.pages import ocr_lines, pending_pages
from codicil.session import durable
from codicil.sources import files

CHECKPOINT = "document string, pdf_page int, key string, texts array<string>, scores array<double>, boxes array<array<double>>, error string"
_ARROW = pa.schema([
    ("document", pa.string()), ("pdf_page", pa.int32()), ("key", pa.string()), ("texts", pa.list_(pa.string())), ("scores", pa.list_(pa.float64())), ("boxes", pa.list_(pa.list_(pa.float64()))), ("error", pa.string())])


def recognise_pages(pages: DataFrame, render: Callable[[str, int], object], recognise: Callable[[list], list[dict]], size: int = 2) -> DataFrame:
    """Results of pages (document, pdf_page, key), ``size`` at a time; where a batch fails its pages are tried alone, so that one hides no other."""

    def result(row: dict, got: dict | None, error: str | None) -> dict:
        got = got or {}
        return row | {"texts": got.get("texts") or [], "scores": got.get("scores") or [], "boxes": got.get("boxes") or [], "error": error}

    def attempt(rows: list[dict]) -> list[dict]:
        try:
            got = recognise([render(r["document"], r["pdf_page"]) for r in rows])
            if len(got) != len(rows):
                raise ValueError(f"{len(rows)} pages, {len(got)} results")
            return [result(r, g, None) for r, g in zip(rows, got)]
        except Exception as e:  # noqa: BLE001 - a failure is a result
            return [result(rows[0], None, f"{type(e).__name__}: {e}")] if len(rows) == 1 else [x for r in rows for x in attempt([r])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), size):
                yield pa.RecordBatch.from_pylist(attempt(rows[at : at + size]), schema=_ARROW)

    return pages.select("document", "pdf_page", "key").mapInArrow(run, CHECKPOINT)


def run_ocr(pages: DataFrame, checkpoints: str, profile: str, render: Callable, recognise: Callable, size: int = 2) -> DataFrame:
    """Lines of all pages of the ocr route: what the checkpoints hold under this profile, and the rest recognised and added. Failed pages stay pending."""
    spark = pages.sparkSession
    none = spark.createDataFrame([], CHECKPOINT)
    done = spark.read.schema(CHECKPOINT).parquet(checkpoints) if files.exists(checkpoints) else none
    todo = pending_pages(pages, done, profile)
    new = durable(recognise_pages(todo, render, recognise, size), "recognised")
    new.where("error is null").write.mode("append").parquet(checkpoints)
    asked = pending_pages(pages, none, profile).select("key")
    held = spark.read.schema(CHECKPOINT).parquet(checkpoints).join(asked, "key", "left_semi")
    return ocr_lines(held.dropDuplicates(["key"]))
