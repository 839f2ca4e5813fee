"""Shape of canonical records: members, types, closed values, and rules between members.

A specification is plain data; one small interpreter checks values against it
and returns every problem with its path. ``check_records`` runs it over a
column, so a release's shape problems come out as one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codicil import vocab
from codicil.schemas import SCHEMA_VERSION

ID = vocab.ID_PATTERNS
DATE = r"^\d{4}-\d{2}-\d{2}$"


def text(pattern: str | None = None, null: bool = False, values: tuple | None = None):
    return ("text", pattern, null, values)


def whole(low: int, null: bool = False):
    return ("int", low, null)


def many(item, least: int = 0):
    return ("list", item, least)


def obj(required: dict, optional: dict | None = None, null: bool = False):
    return ("object", required, optional or {}, null)


CLAIM = obj({"date": text(DATE, True), "null_reason": text(None, True, vocab.DATE_NULL_REASONS), "source_ids": many(text(ID["source_id"]))})
SPAN = obj({"source_id": text(ID["source_id"]), "pdf_page": whole(1)}, {"printed_page": text()})
REF = obj({"source_id": text(ID["source_id"]), "role": text(None, False, vocab.SOURCE_ROLES), "scope_note": text(None, True)})
ACT = obj({
    "schema_version": text(None, False, (SCHEMA_VERSION,)), "record_type": text(None, False, ("act",)), "act_id": text(ID["act_id"]), "jurisdiction": text(), "country_code": text("^[A-Z]{2}$"),
    "titles": obj({"official": text(), "short": text(None, True), "long": text(None, True)}), "year": whole(1), "number": text(None, True), "citation": text(None, True),
    "dates": obj({k: CLAIM for k in ("assent", "publication", "commencement", "repeal")}), "aliases": many(text()), "status": text(None, False, vocab.ACT_STATUS),
    "checked_through_date": text(DATE, True), "status_source_ids": many(text(ID["source_id"])), "source_refs": many(REF, 1),
    "editorial_notes": many(obj({"note": text(), "source_ids": many(text(ID["source_id"])), "decision_refs": many(text())}))}, {"text_kind": text(None, False, vocab.TEXT_KINDS)})
SOURCE = obj({
    "schema_version": text(None, False, (SCHEMA_VERSION,)), "record_type": text(None, False, ("source",)), "source_id": text(ID["source_id"]), "document_title": text(), "document_publisher": text(null=True),
    "language": text(ID["language"]), "source_class": text(None, False, vocab.SOURCE_CLASSES),
    "publication": obj({k: text(None, True) for k in ("name", "date", "number", "volume", "notice_number", "page_range")}, null=True), "media_type": text(None, False, ("application/pdf",)),
    "byte_length": whole(1), "page_count": whole(1), "text_layer": text(None, False, vocab.TEXT_LAYERS),
    "locations": many(obj({"url": text("^https?://"), "provider_name": text(null=True), "retrieved_at": text(), "http_last_modified": text(null=True), "notes": text(null=True)})),
    "redistribution": obj({"status": text(), "license": text(null=True), "notes": text(null=True)}), "document_notes": many(text())})
CITATION = obj({
    "schema_version": text(None, False, (SCHEMA_VERSION,)), "record_type": text(None, False, ("citation",)), "citation_id": text(ID["citation_id"]), "source_provision_id": text(ID["provision_id"]),
    "source_block_id": text(ID["block_id"]), "text_range": obj({"start": whole(0), "end": whole(1)}), "target": obj({"act_id": text(ID["act_id"]), "provision_id": text(ID["provision_id"], True)})})
BLOCK = ("block",)
PROVISION = obj({
    "schema_version": text(None, False, (SCHEMA_VERSION,)), "record_type": text(None, False, ("provision",)), "provision_id": text(ID["provision_id"]), "node_type": text(None, False, vocab.NODE_TYPES),
    "display_label": text(None, True), "heading": text(None, True), "parent_provision_id": text(ID["provision_id"], True), "order": whole(1), "source_spans": many(SPAN, 1), "content_blocks": many(BLOCK),
    "text_fidelity": text(None, False, vocab.TEXT_FIDELITY)})
TEXT_BLOCK = obj({"block_id": text(ID["block_id"]), "kind": text(None, False, vocab.TEXT_BLOCK_KINDS), "text": text(), "source_spans": many(SPAN, 1)})
LIST_BLOCK = obj({
    "block_id": text(ID["block_id"]), "kind": text(None, False, ("list",)), "marker_style": text(None, False, vocab.MARKER_STYLES), "source_spans": many(SPAN, 1),
    "items": many(obj({"item_id": text(ID["block_id"]), "label": text(None, True), "content_blocks": many(BLOCK), "source_spans": many(SPAN, 1)}), 1)}, {"start": whole(1)})
CELL = obj({
    "cell_id": text(ID["block_id"]), "column_start": whole(1), "role": text(None, False, ("header", "data")), "scope": text(None, True, vocab.CELL_SCOPES), "row_span": whole(1), "column_span": whole(1),
    "header_cell_ids": many(text(ID["block_id"])), "blank": ("bool",), "content_blocks": many(BLOCK), "source_spans": many(SPAN)})
TABLE_BLOCK = obj({
    "block_id": text(ID["block_id"]), "kind": text(None, False, ("table",)), "caption": obj({"text": text(), "source_spans": many(SPAN, 1)}, {"block_id": text(ID["block_id"])}, True), "column_count": whole(1),
    "row_groups": many(obj({"group_id": text(ID["block_id"]), "role": text(None, False, ("header", "body", "footer")), "rows": many(obj({"row_id": text(ID["block_id"]), "cells": many(CELL, 1)}), 1)}), 1),
    "notes": many(BLOCK), "source_segments": many(("any",)), "layout_status": text(None, False, vocab.LAYOUT_STATUS), "source_spans": many(SPAN, 1)})
RECORDS = {"act": ACT, "provision": PROVISION, "source": SOURCE, "citation": CITATION}


def problems(value, spec, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, message) of everything in ``value`` that the specification forbids."""
    kind = spec[0]
    if kind == "text":
        _, pattern, null, values = spec
        if value is None:
            if not null:
                yield path, "null"
        elif not isinstance(value, str) or not value:
            yield path, "no text"
        elif values is not None and value not in values:
            yield path, "unknown value"
        elif pattern is not None and not re.match(pattern, value):
            yield path, "bad form"
    elif kind == "int":
        if value is None and spec[2]:
            return
        if isinstance(value, bool) or not isinstance(value, int) or value < spec[1]:
            yield path, f"no whole number from {spec[1]}"
    elif kind == "bool":
        if not isinstance(value, bool):
            yield path, "no truth value"
    elif kind == "list":
        if not isinstance(value, list) or len(value) < spec[2]:
            yield path, f"no list of at least {spec[2]}"
        else:
            for i, x in enumerate(value):
                yield from problems(x, spec[1], f"{path}[{i}]")
    elif kind == "object":
        _, required, optional, null = spec
        if value is None and null:
            return
        if not isinstance(value, dict):
            yield path, "no object"
            return
        for k in required.keys() - value.keys():
            yield f"{path}.{k}", "missing"
        for k in value.keys() - required.keys() - optional.keys():
            yield f"{path}.{k}", "unknown member"
        for k, s in (required | optional).items():
            if k in value:
                yield from problems(value[k], s, f"{path}.{k}")
        if spec is CELL and value.get("blank") and value.get("content_blocks"):
            yield f"{path}.content_blocks", "blank cell with content"
        if spec is CLAIM and (value.get("date") is None) == (value.get("null_reason") is None):
            yield path, "a date or a reason, not both"
        if spec is ACT and sum(r.get("role") == "authoritative_text" for r in value.get("source_refs") or [] if isinstance(r, dict)) != 1:
            yield f"{path}.source_refs", "not exactly one authoritative text"
    elif kind == "block":
        own = value.get("kind") if isinstance(value, dict) else None
        yield from problems(value, LIST_BLOCK if own == "list" else TABLE_BLOCK if own == "table" else TEXT_BLOCK, path)


def check_record(kind: str, record: str | None) -> list[tuple[str, str]]:
    try:
        value = json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        return [("$", "no JSON")]
    return sorted(problems(value, RECORDS[kind]))


def check_records(df: DataFrame, kind: str, key: str, record: str = "canonical_record") -> DataFrame:
    """release_tag, key, path, message of all shape problems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, k, p, m) for t, k, r in zip(*(batch.column(i).to_pylist() for i in range(3))) for p, m in check_record(kind, r)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(4)], names=["release_tag", "key", "path", "message"])

    return df.select("release_tag", key, record).mapInArrow(run, "release_tag string, key string, path string, message string")
