"""Flattening of nested content.

Content is a recursive union (text; lists of items that hold content; tables of
cells that hold content), which no finite struct can describe. One Arrow pass
over the JSON text turns each record into flat rows: one for every block, item
and cell, with its path. All rules about content are then plain column
expressions over this table.

Row: ``path`` (array of steps), ``kind`` (text kinds, list, item, table,
caption, cell, segment), ``block_id``, ``text`` (null but for text and labels),
grid columns for cells, and the source pages. Text that is no JSON object gives
no rows; unknown kinds are kept as rows without content.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codicil.vocab import TEXT_BLOCK_KINDS

FIELDS = (
    ("seq", pa.int32(), "int"), ("path", pa.list_(pa.string()), "array<string>"), ("kind", pa.string(), "string"), ("block_id", pa.string(), "string"),
    ("text", pa.string(), "string"), ("table_id", pa.string(), "string"), ("row_group", pa.string(), "string"), ("row_index", pa.int32(), "int"),
    ("row_id", pa.string(), "string"), ("column_start", pa.int32(), "int"), ("row_span", pa.int32(), "int"), ("column_span", pa.int32(), "int"),
    ("role", pa.string(), "string"), ("scope", pa.string(), "string"), ("blank", pa.bool_(), "boolean"), ("header_cell_ids", pa.list_(pa.string()), "array<string>"),
    ("column_count", pa.int32(), "int"), ("row_ids", pa.list_(pa.string()), "array<string>"), ("repeated_row_ids", pa.list_(pa.string()), "array<string>"), ("group_role", pa.string(), "string"),
    ("source_ids", pa.list_(pa.string()), "array<string>"), ("pdf_pages", pa.list_(pa.int32()), "array<int>"),
)


class _Flat:
    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, path: list[str], kind: str, node: dict, **more) -> None:
        spans = [s for s in node.get("source_spans") or [] if isinstance(s, dict)]
        pages = [s["pdf_page"] for s in spans if isinstance(s.get("pdf_page"), int)]
        self.rows.append({"seq": len(self.rows) + 1, "path": path, "kind": kind, "source_ids": [s["source_id"] for s in spans if s.get("source_id")], "pdf_pages": pages} | more)

    def blocks(self, blocks, path: list[str], kind: str | None = None) -> None:
        for i, b in enumerate(blocks or []):
            if isinstance(b, dict):
                self.block(b, [*path, str(i)])

    def block(self, b: dict, path: list[str]) -> None:
        kind = b.get("kind") or "unknown"
        if kind in TEXT_BLOCK_KINDS:
            self.add(path, kind, b, block_id=b.get("block_id"), text=b.get("text"))
        elif kind == "list":
            self.add(path, kind, b, block_id=b.get("block_id"))
            for i, item in enumerate(b.get("items") or []):
                at = [*path, "items", str(i)]
                self.add(at, "item", item, block_id=item.get("item_id"), text=item.get("label"))
                self.blocks(item.get("content_blocks"), at)
        elif kind == "table":
            self.table(b, path)
        else:
            self.add(path, kind, b, block_id=b.get("block_id"))

    def table(self, t: dict, path: list[str]) -> None:
        own = {"table_id": t.get("block_id"), "column_count": t.get("column_count")}
        self.add(path, "table", t, block_id=t.get("block_id"), **own)
        if isinstance(t.get("caption"), dict):
            self.add([*path, "caption"], "caption", t["caption"], block_id=t["caption"].get("block_id"), text=t["caption"].get("text"), **own)
        index = 0
        for g, group in enumerate(t.get("row_groups") or []):
            for row in group.get("rows") or []:
                index += 1
                for k, cell in enumerate(row.get("cells") or []):
                    at = [*path, "groups", str(g), str(index), str(k)]
                    self.add(at, "cell", cell, block_id=cell.get("cell_id"), row_group=group.get("group_id"), row_index=index, row_id=row.get("row_id"), column_start=cell.get("column_start"),
                             row_span=cell.get("row_span"), column_span=cell.get("column_span"), role=cell.get("role"), group_role=group.get("role"), scope=cell.get("scope"), blank=cell.get("blank"), header_cell_ids=cell.get("header_cell_ids"), **own)
                    self.blocks(cell.get("content_blocks"), at)
        for k, segment in enumerate(t.get("source_segments") or []):
            self.add([*path, "segments", str(k)], "segment", segment, block_id=segment.get("segment_id"), row_ids=segment.get("row_ids"), repeated_row_ids=segment.get("repeated_header_row_ids"), **own)
        self.blocks(t.get("notes"), [*path, "notes"])


def flatten(record: str | None) -> list[dict]:
    try:
        value = json.loads(record) if record else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(value, dict):
        return []
    out = _Flat()
    out.blocks(value.get("content_blocks"), [])
    return out.rows


def _flatten_batches(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != column]
            rows, at = [], []
            for i, record in enumerate(batch.column(column).to_pylist()):
                own = flatten(record)
                rows += own
                at += [i] * len(own)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in names), *(pa.array([r.get(f) for r in rows], t) for f, t, _ in FIELDS)], names=[*names, *(f for f, _, _ in FIELDS)])

    return run


def flatten_blocks(df: DataFrame, record: str = "canonical_record") -> DataFrame:
    """All columns but ``record``, with one row for each piece of content."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != record] + [f"{f} {t}" for f, _, t in FIELDS])
    return df.mapInArrow(_flatten_batches(record), schema)
