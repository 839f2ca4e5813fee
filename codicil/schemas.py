"""Fixed schemas: records as they are read, projection tables, API payloads. Nothing is inferred."""

from __future__ import annotations

SCHEMA_VERSION = "0.1.0"
PROJECTION_VERSION = 1

_CLAIM = "struct<date:string,null_reason:string,source_ids:array<string>>"
#: Read with these; nested content stays JSON text (``record``), since it has no finite struct.
ACT = (
    "schema_version string, record_type string, act_id string, jurisdiction string, country_code string, titles struct<official:string,short:string,long:string>,"
    f" year int, number string, citation string, text_kind string, dates struct<assent:{_CLAIM},publication:{_CLAIM},commencement:{_CLAIM},repeal:{_CLAIM}>,"
    " aliases array<string>, status string, checked_through_date string, status_source_ids array<string>,"
    " source_refs array<struct<source_id:string,role:string,scope_note:string>>"
)
PROVISION = (
    "schema_version string, record_type string, provision_id string, node_type string, display_label string, heading string, parent_provision_id string,"
    " `order` int, source_spans array<struct<source_id:string,pdf_page:int,printed_page:string>>, text_fidelity string"
)
SOURCE = (
    "schema_version string, record_type string, source_id string, document_title string, document_publisher string, language string, source_class string,"
    " media_type string, byte_length bigint, page_count int, text_layer string"
)
CITATION = (
    "schema_version string, record_type string, citation_id string, source_provision_id string, source_block_id string, text_range struct<start:int,end:int>,"
    " target struct<act_id:string,provision_id:string>"
)

PROJECTION = {
    "acts": "release_tag string, act_id string, schema_version string, jurisdiction string, country_code string, official_title string, short_title string, year int, number string,"
    " citation string, text_kind string, status string, checked_through_date date, title_keys array<string>, citation_key string, source_ids array<string>, searchable_text string, canonical_record string",
    "provisions": "release_tag string, provision_id string, act_id string, schema_version string, parent_provision_id string, sibling_order int, sequence int, depth int, node_type string,"
    " display_label string, heading string, text_fidelity string, reference_key string, source_ids array<string>, searchable_text string, canonical_record string",
    "sources": "release_tag string, source_id string, schema_version string, document_title string, document_publisher string, language string, source_class string, canonical_record string",
    "citations": "release_tag string, citation_id string, schema_version string, source_provision_id string, source_block_id string, target_act_id string, target_provision_id string, canonical_record string",
    "corpus_releases": "release_tag string, commit_sha string, canonical_schema_versions array<string>, projection_schema_version int, import_state string, imported_at timestamp",
}

#: Payloads of the read API.
ACT_SUMMARY = "act_id string, official_title string, short_title string, year int, number string, citation string, text_kind string, status string, checked_through_date date"
PROVISION_SUMMARY = "provision_id string, act_id string, node_type string, display_label string, heading string"
OUTLINE_ROW = "provision_id string, parent_provision_id string, node_type string, display_label string, heading string, `order` int, sequence int, depth int, has_content boolean, has_children boolean"
SEARCH_ITEM = f"kind string, match_kind string, act struct<{ACT_SUMMARY.replace(' ', ':').replace(',:', ',')}>, provision struct<{PROVISION_SUMMARY.replace(' ', ':').replace(',:', ',')}>, breadcrumb array<struct<{PROVISION_SUMMARY.replace(' ', ':').replace(',:', ',')}>>, excerpt string"


def differences(df, expected: str) -> list[str]:
    """How a table's columns differ from a schema: missing, unknown, of another type."""
    from pyspark.sql.types import _parse_datatype_string

    want = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(expected).fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [f"missing {c}" for c in want if c not in have] + [f"unknown {c}" for c in have if c not in want]
    return out + [f"{c} is {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]
