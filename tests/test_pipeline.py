import json
import os

import pytest

from codicil.errors import PipelineError
from codicil.plans import pipeline as L
from codicil.sources.corpus import load_corpus
from tests import corpus_fixture as X

REQUEST = {"url": "https://archive.invalid/a.pdf", "document_title": "Gazette 1", "document_publisher": "Press", "language": "eng", "source_class": "official_gazette"}


def test_acquire_classify_extract(spark, tmp_path):
    root, text = str(tmp_path), json.dumps(REQUEST)
    good = lambda url: (200, iter([b"%PDF-1.7 ", b"body"]))
    assert L.acquire(text, root, good, lambda b: 3)["status"] == "dry_run" and not os.listdir(root)
    receipt = L.acquire(text, root, good, lambda b: 3, execute=True)
    assert receipt["status"] == "success" and os.path.exists(os.path.join(root, "documents", receipt["source_id"][7:] + ".pdf"))
    failed = L.acquire(text, root, lambda u: (404, iter([])), lambda b: 3, execute=True)
    assert (failed["status"], failed["code"]) == ("failed", "download_failed") and len(os.listdir(os.path.join(root, "runs"))) == 2
    sid = receipt["source_id"]
    pages = spark.createDataFrame([(sid, 1, "w" * 150, 0.0), (sid, 2, "", 0.9), (sid, 3, "", 0.0), ("other", 1, "x", 0.0)], "document string, pdf_page int, text string, dominant_image_coverage double")
    report = L.classify(pages, sid, root, receipt["path"])
    assert report["summary"]["route"] == "hybrid" and report["summary"]["manual_review_pages"] == [1, 2, 3]
    ocr = spark.createDataFrame([(sid, 2, "read")], "document string, pdf_page int, text string")
    out = L.extract(pages, ocr, sid, root, report["path"])
    assert out["summary"] == {"page_methods": {"native": 1, "ocr": 1, "skip": 1}, "text_characters": 154}
    for bad in (ocr.limit(0), ocr.unionByName(ocr.selectExpr("document", "1 as pdf_page", "text"))):
        with pytest.raises(PipelineError, match="sha256"):
            L.extract(pages, bad, sid, root, report["path"])


def test_pages_beyond_the_bound_are_refused_not_dropped(spark, tmp_path):
    root = str(tmp_path)
    receipt = L.acquire(json.dumps(REQUEST), root, lambda url: (200, iter([b"%PDF-1.7 body"])), lambda b: 3, execute=True)
    sid = receipt["source_id"]
    pages = lambda n: spark.range(1, n + 1).selectExpr(f"'{sid}' AS document", "int(id) AS pdf_page", "repeat('w', 150) AS text")
    ocr = spark.createDataFrame([], "document string, pdf_page int, text string")
    report = L.classify(pages(2000), sid, root, receipt["path"])
    assert len(report["pages"]) == len(L.extract(pages(2000), ocr, sid, root, report["path"])["pages"]) == 2000
    for stage in (lambda: L.classify(pages(2001), sid, root, receipt["path"]), lambda: L.extract(pages(2001), ocr, sid, root, report["path"])):
        with pytest.raises(PipelineError, match="more than 2000 pages"):
            stage()
    assert len(os.listdir(os.path.join(root, "classifications"))) == len(os.listdir(os.path.join(root, "extractions"))) == 1


def drafts():
    rows = []
    for p in X.provisions():
        rows.append({"draft_id": p["provision_id"], "parent_draft_id": p["parent_provision_id"], "node_type": p["node_type"], "display_label": p["display_label"], "heading": p["heading"], "order": p["order"], "source_spans": p["source_spans"], "content_blocks": p["content_blocks"]})
    return rows


def test_candidate_review_promote(spark, tmp_path):
    root, corpus = str(tmp_path / "cache"), str(tmp_path / "corpus")
    source = X.source() | {"publication": None, "redistribution": {"status": "allowed", "license": None, "notes": None}, "document_notes": []}
    made = L.candidate(spark, X.act(), drafts(), source, root)
    assert made["provision_count"] == 4 and not made["reused"] and L.candidate(spark, X.act(), drafts(), source, root)["reused"]
    folder = os.path.join(root, made["candidate_path"])
    assert L.review(folder) == {"ready": False, "provisions": 4, "machine_extracted": 4, "problems": []}
    with pytest.raises(PipelineError) as e:
        L.promote(folder, corpus)
    assert e.value.code == "review_incomplete"
    path = os.path.join(folder, "provisions.jsonl")
    lines = open(path).read().replace("machine_extracted", "double_reviewed")
    open(path, "w").write(lines.split("\n")[0] + "\n")
    with pytest.raises(PipelineError, match="expected 4 provisions, found 1"):
        L.review(folder)
    open(path, "w").write(lines)
    assert L.review(folder)["ready"]
    assert L.promote(folder, corpus)["status"] == "dry_run" and not os.path.exists(corpus)
    with pytest.raises(PipelineError) as e:
        L.promote(folder, corpus, execute=True, documents=root)
    assert e.value.code == "source_missing" and not os.path.exists(corpus)
    with open(os.path.join(root, "a" * 64 + ".pdf"), "wb") as f:
        f.write(b"123456789")
    with pytest.raises(PipelineError) as e:
        L.promote(folder, corpus, execute=True, documents=root)
    assert e.value.code == "source_changed" and not os.path.exists(corpus)
    # A promotion that ended before the register was swapped is finished by the next one.
    assert L.promote(folder, corpus, execute=True)["act_directory"] == "qm/federal/acts/2023/37"
    os.unlink(os.path.join(corpus, "sources.jsonl"))
    assert L.promote(folder, corpus, execute=True)["status"] == "success"
    assert load_corpus(spark, corpus, "t")["provisions"].count() == 4
    with pytest.raises(PipelineError) as e:
        L.promote(folder, corpus, execute=True)
    assert e.value.code == "act_exists"
    with pytest.raises(PipelineError) as e:
        L.candidate(spark, X.act(), drafts()[1:], source, str(tmp_path / "other"))
    assert e.value.code == "invalid_structure"
