"""The stages from a request to a corpus folder: acquire, classify, extract, candidate, review, promote.

Every stage reads the artifact of the stage before and writes one more; without
``execute`` it only says what it would do. What needs a network or a reader of
page content is injected.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.errors import PipelineError
from codicil.functions.records import check_record
from codicil.operators import pages as P
from codicil.operators.structure import assign_ids, unassignable
from codicil.sources import files
from codicil.sources.corpus import fetch, load_artifact, load_request
from codicil.sources.sinks import append_event, json_bytes, jsonl_bytes, same_files, write_artifact, write_atomically, write_candidate


#: Pages of a document, at most.
MAX_PAGES = 2000


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _stamp() -> str:
    """Time and a random part, so that no two runs share an artifact."""
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ") + "-" + uuid.uuid4().hex[:6]


def source_candidate(request: dict, digest: str, size: int, page_count: int, url: str) -> dict:
    """The Source record that a downloaded document would become."""
    return {
        "schema_version": "0.1.0", "record_type": "source", "source_id": digest, "document_title": request["document_title"], "document_publisher": request["document_publisher"],
        "language": request["language"], "source_class": request["source_class"], "publication": request["publication"], "media_type": "application/pdf", "byte_length": size, "page_count": page_count,
        "text_layer": "unknown", "locations": [{"url": url, "provider_name": request["provider_name"], "retrieved_at": now(), "http_last_modified": None, "notes": request["notes"]}],
        "redistribution": request["redistribution"], "document_notes": request["document_notes"]}


def acquire(text: str, root: str, opener: Callable, count_pages: Callable[[bytes], int], execute: bool = False, sleep: Callable[[float], None] = lambda s: None) -> dict:
    """Downloads a requested document into the content-addressed cache; a receipt is written for success and failure alike."""
    request = load_request(text)
    if not execute:
        return {"stage": "acquire", "status": "dry_run", "url": request["url"]}
    relative = f"receipts/{hashlib.sha256(text.encode()).hexdigest()[:12]}-{_stamp()}.json"
    receipt = {"stage": "acquire", "url": request["url"], "started_at": now()}
    try:
        content, digest = fetch(request["url"], opener, sleep)
        pages = count_pages(content)
        if not 1 <= pages <= MAX_PAGES:
            raise PipelineError("unusable_pdf", f"{pages} pages")
        record = source_candidate(request, digest, len(content), pages, request["url"])
        bad = check_record("source", json.dumps(record))
        if bad:
            raise PipelineError("invalid_source", "; ".join(f"{p}: {m}" for p, m in bad))
        path = files.join(root, "documents", digest.removeprefix("sha256:") + ".pdf")
        if files.exists(path):
            if files.read(path) != content:
                raise PipelineError("digest_collision", digest)
        else:
            write_atomically(path, content)
        receipt |= {"status": "success", "source_id": digest, "source": record}
    except PipelineError as e:
        receipt |= {"status": "failed", "code": e.code, "message": e.message, "retryable": e.retryable}
    append_event(root, "runs", receipt)
    return write_artifact(root, relative, receipt)


def _page_rows(pages: DataFrame) -> list[dict]:
    """The pages of one document in order; an error where there are more than a document may have."""
    rows = [r.asDict() for r in pages.orderBy("pdf_page").limit(MAX_PAGES + 1).collect()]
    if len(rows) > MAX_PAGES:
        raise PipelineError("unusable_pdf", f"more than {MAX_PAGES} pages")
    return rows


def classify(pages: DataFrame, source_id: str, root: str, receipt: str) -> dict:
    """Report of the pages of one document: evidence, routes, summary, thresholds, warnings."""
    load_artifact(root, receipt, "acquire", source_id)
    routed = P.routed(P.text_evidence(pages.where(F.col("document") == source_id)))
    rows = _page_rows(routed.drop("text"))
    s = P.summary(routed).first()
    review = sorted(r["pdf_page"] for r in P.review_pages(routed).collect())
    report = {
        "stage": "classify", "status": "success", "source_id": source_id, "input_receipt": receipt, "thresholds": {"substantive_characters": P.SUBSTANTIVE, "dominant_image": P.DOMINANT_IMAGE}, "pages": rows,
        "summary": s.asDict() | {"manual_review_pages": review}, "warnings": [f"page {r['pdf_page']}: {r['inspection_error']}" for r in rows if r["inspection_error"]]}
    return write_artifact(root, f"classifications/{source_id[7:19]}-{_stamp()}.json", json.loads(json.dumps(report, default=str)))


def extract(pages: DataFrame, ocr: DataFrame, source_id: str, root: str, classification: str) -> dict:
    """Page texts in order; refused under a hard review, and when recognised pages are missing or not asked for."""
    report = load_artifact(root, classification, "classify", source_id)
    if report["summary"]["route"] == "manual_review":
        raise PipelineError("manual_review_required", source_id)
    routed = P.routed(P.text_evidence(pages.where(F.col("document") == source_id)))
    got = P.merge_extraction(routed, ocr)
    if got.where("missing").limit(1).count() or P.unexpected_ocr(routed, ocr.where(F.col("document") == source_id)).limit(1).count():
        raise PipelineError("ocr_pages_differ", source_id)
    rows = _page_rows(got.drop("missing"))
    methods = {m: sum(r["method"] == m for r in rows) for m in ("native", "ocr", "skip")}
    result = {"stage": "extract", "status": "success", "source_id": source_id, "input_classification": classification, "pages": rows, "summary": {"page_methods": methods, "text_characters": sum(r["text_characters"] for r in rows)}}
    return write_artifact(root, f"extractions/{source_id[7:19]}-{_stamp()}.json", result)


def ordered_digest(ids: list[str]) -> str:
    return "sha256:" + hashlib.sha256("".join(i + "\n" for i in ids).encode()).hexdigest()


def candidate(spark: SparkSession, act: dict, drafts: list[dict], source: dict, root: str) -> dict:
    """A candidate folder with permanent ids and a manifest; the same input gives the same bytes."""
    schema = "scope string, node_id string, parent_id string, seq int, node_type string, display_label string, heading string, `order` int, first_text string"
    text = lambda d: next((b.get("text") for b in d["content_blocks"] if isinstance(b.get("text"), str)), None)
    nodes = spark.createDataFrame([(act["act_id"], d["draft_id"], d["parent_draft_id"], n, d["node_type"], d["display_label"], d["heading"], d["order"], text(d)) for n, d in enumerate(drafts, 1)], schema)
    lost = unassignable(nodes).limit(5).collect()
    if lost:
        raise PipelineError("unassignable_provision_id", ", ".join(r["node_id"] for r in lost))
    ids = {r["node_id"]: f"{act['act_id']}:{r['local_id']}" for r in assign_ids(nodes).collect()}  # the nodes of one act
    if len(ids) != len(drafts):
        raise PipelineError("invalid_structure", f"expected {len(drafts)} provisions, found {len(ids)}")
    provisions = [
        {"schema_version": "0.1.0", "record_type": "provision", "provision_id": ids[d["draft_id"]], "node_type": d["node_type"], "display_label": d["display_label"], "heading": d["heading"],
         "parent_provision_id": ids.get(d["parent_draft_id"]), "order": d["order"], "source_spans": d["source_spans"], "content_blocks": d["content_blocks"], "text_fidelity": "machine_extracted"} for d in drafts]
    folder = os.path.join(root, "candidates", act["act_id"])
    manifest = {"candidate_version": 1, "act_id": act["act_id"], "source_id": source["source_id"], "provision_count": len(provisions), "ordered_provision_ids_sha256": ordered_digest([p["provision_id"] for p in provisions])}
    made = {"act.json": json_bytes(act), "provisions.jsonl": jsonl_bytes(provisions), "citations.jsonl": b"", "source.json": json_bytes(source), "candidate.json": json_bytes(manifest)}
    return manifest | {"reused": write_candidate(made, folder) == "unchanged", "candidate_path": os.path.relpath(folder, root)}


def _load_candidate(folder: str) -> tuple[dict, dict, list[dict], dict]:
    def read(name: str) -> str:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            return f.read()

    provisions = [json.loads(x) for x in read("provisions.jsonl").splitlines() if x.strip()]
    return json.loads(read("candidate.json")), json.loads(read("act.json")), provisions, json.loads(read("source.json"))


def review(folder: str) -> dict:
    """Whether a reviewed candidate may be promoted: nothing lost or renamed, nothing left as extracted by machine, all shapes valid."""
    manifest, act, provisions, source = _load_candidate(folder)
    if len(provisions) != manifest["provision_count"]:
        raise PipelineError("candidate_truncated", f"expected {manifest['provision_count']} provisions, found {len(provisions)}")
    if ordered_digest([p["provision_id"] for p in provisions]) != manifest["ordered_provision_ids_sha256"]:
        raise PipelineError("candidate_ids_changed", manifest["act_id"])
    machine = sum(p["text_fidelity"] == "machine_extracted" for p in provisions)
    bad = [f"{k}: {p} {m}" for k, r in (("act", act), ("source", source), *(("provision", p) for p in provisions)) for p, m in check_record(k, json.dumps(r))]
    return {"ready": not machine and not bad, "provisions": len(provisions), "machine_extracted": machine, "problems": bad[:20]}


def verify_bytes(source: dict, documents: str) -> None:
    """The stored document of a source has the length and the digest that its record states."""
    path = os.path.join(documents, source["source_id"].removeprefix("sha256:") + ".pdf")
    if not os.path.exists(path):
        raise PipelineError("source_missing", path)
    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while part := f.read(65536):
            digest.update(part)
            size += len(part)
    if size != source["byte_length"] or "sha256:" + digest.hexdigest() != source["source_id"]:
        raise PipelineError("source_changed", source["source_id"])


def promote(folder: str, corpus: str, execute: bool = False, documents: str | None = None) -> dict:
    """Adds a reviewed candidate to a corpus: its source by id, keeping the order, and its act folder as one step.

    With ``documents``, the folder of the content-addressed store, the bytes of the source are verified again first.
    """
    manifest, act, provisions, source = _load_candidate(folder)
    state = review(folder)
    path = os.path.join(corpus, "sources.jsonl")
    registry = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            registry = [json.loads(x) for x in f if x.strip()]
    held = {s["source_id"]: s for s in registry}
    country, scope, year, number = act["act_id"].split("-")[0], *act["act_id"].removeprefix(act["act_id"].split("-")[0] + "-").rsplit("-", 2)
    target = os.path.join(corpus, country, scope, "acts", year, number)
    if not state["ready"]:
        raise PipelineError("review_incomplete", f"{state['machine_extracted']} provisions as extracted; {state['problems'][:3]}")
    with open(os.path.join(folder, "citations.jsonl"), "rb") as f:
        made = {"act.json": json_bytes(act), "provisions.jsonl": jsonl_bytes(provisions), "citations.jsonl": f.read()}
    if os.path.exists(target) and (source["source_id"] in held or not same_files(made, target)):
        raise PipelineError("act_exists", target)
    if source["source_id"] in held and held[source["source_id"]] != source:
        raise PipelineError("source_conflict", source["source_id"])
    if documents is not None:
        verify_bytes(source, documents)
    if execute:
        # The act folder appears whole, by one rename, and the register that makes its source known is swapped after it. Where
        # the second step is missing after a crash, the same candidate is promoted again and finds its folder unchanged.
        merged = sorted((held | {source["source_id"]: source}).values(), key=lambda s: s["source_id"])
        write_candidate(made, target)
        write_atomically(path, jsonl_bytes(merged))
    return {"stage": "promote", "status": "success" if execute else "dry_run", "act_directory": os.path.relpath(target, corpus), "provisions": manifest["provision_count"]}
