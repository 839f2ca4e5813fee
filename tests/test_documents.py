import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codicil.errors import PipelineError, Unavailable
from codicil.functions.blocks import flatten_blocks
from codicil.operators import pages as P
from codicil.operators import reader
from codicil.operators import validate as V
from codicil.operators import workflow as W
from codicil.sources import corpus as C
from codicil.sources import ocr as O
from codicil.sources import page_content as N
from tests import corpus_fixture as X


def test_operations_of_a_stream():
    got = list(N.operations(b"q 1 0 0 -1.5 .5 +2 cm % a note (with) Tj\n/Im1 Do (a (b) \\) c) Tj [(x) 3 (y)] TJ <4142> Tj << /A [1 2] >> BDC BI /W 2 ID \x00\x01 EI S"))
    assert [op for _, op in got] == [b"q", b"cm", b"Do", b"Tj", b"TJ", b"Tj", b"BDC", b"BI", b"S"]
    assert got[1][0] == [1.0, 0.0, 0.0, -1.5, 0.5, 2.0] and got[2][0] == ["/Im1"] and got[4][0] == [None] and got[6][0] == [None]


def test_page_evidence():
    scan = N.evidence(N.Page(b"q 500 0 0 800 0 0 cm /Im Do Q 3 Tr BT (hidden) Tj ET 0 Tr (seen) Tj", 500, 800, xobjects={"/Im": "Image"}))
    assert (scan["image_count"], scan["dominant_image_coverage"], scan["invisible_text"], scan["text_show_operations"]) == (1, 1.0, True, 2)
    nested = N.evidence(N.Page(b"q .5 0 0 .5 0 0 cm q 500 0 0 800 0 0 cm /Im Do Q 0 0 m 9 9 l S f* /Gone Do /Form Do Q Q", 500, 800, xobjects={"/Im": "Image", "/Form": "Form"}))
    assert (nested["dominant_image_coverage"], nested["vector_operations"], nested["unresolved_xobjects"], nested["invisible_text"]) == (0.25, 2, 1, False)
    turned = N.evidence(N.Page(b"0 800 -500 0 500 0 cm BI /W 1 ID zz EI", 500, 800))
    assert turned["dominant_image_coverage"] == 1.0 and N.evidence(N.Page(b"", 0, 0))["dominant_image_coverage"] == 0
    state = N.evidence(N.Page(b"q 3 Tr Q (seen) Tj Q Q", 1, 1))
    assert not state["invisible_text"]


def test_inspection_of_documents_leads_to_routes(spark):
    def pages_of(content):
        if content == b"broken":
            raise ValueError("no pages")
        yield N.Page(b"BT (text) Tj ET", 500, 800, "w" * 150)
        yield N.Page(b"q 500 0 0 800 0 0 cm /Im Do Q", 500, 800, "", {"/Im": "Image"})
        yield N.Page(None, 500, 800)  # fails by itself

    docs = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"broken"))], "source_id string, content binary")
    found = C.inspect_pages(docs, N.inspector(pages_of), N.SCHEMA).withColumnRenamed("source_id", "document")
    routes = {(r["document"], r["pdf_page"]): r["route"] for r in P.routed(P.text_evidence(found.fillna({"image_count": 0, "vector_operations": 0, "unresolved_xobjects": 0, "invisible_text": False, "dominant_image_coverage": 0.0}))).collect()}
    assert routes == {("a", 1): "extract", ("a", 2): "ocr", ("a", 3): "review", ("b", None): "review"}


def test_ocr_in_batches_from_checkpoints(spark, tmp_path):
    pages = spark.createDataFrame([("d", n, "ocr" if n < 6 else "extract") for n in range(1, 8)], "document string, pdf_page int, route string")
    seen, path = spark.sparkContext.accumulator(0), str(tmp_path / "done")
    good = {"bad": False}

    def render(document, page):
        if page == 3 and not good["bad"]:
            raise ValueError("unreadable")
        return page

    def recognise(images):
        seen.add(len(images))
        assert len(images) <= 2
        return [{"texts": [f"page {i}", " "], "scores": [0.9, 0.1], "boxes": [[0.0, 1.0], [2.0, 3.0]]} for i in images]

    first = {r["pdf_page"]: r["text"] for r in O.run_ocr(pages, path, "engine-1", render, recognise).collect()}
    assert first == {n: f"page {n}" for n in (1, 2, 4, 5)}
    good["bad"], before = True, seen.value
    second = {r["pdf_page"]: r["text"] for r in O.run_ocr(pages, path, "engine-1", render, recognise).collect()}
    assert second == {n: f"page {n}" for n in range(1, 6)} and seen.value - before == 1  # only the page that failed
    assert O.run_ocr(pages, path, "engine-2", render, recognise).count() == 5 and seen.value - before == 6


def test_a_tag_is_read_as_it_was(spark, tmp_path):
    repo = str(tmp_path / "repo")
    X.write(os.path.join(repo, "corpus"))
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True).stdout.decode().strip()
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("tag", "corpus-v0.1.0")
    git("branch", "corpus-v9")
    os.unlink(os.path.join(repo, "corpus", "sources.jsonl"))
    commit, folder = C.tagged_release(repo, "corpus-v0.1.0", str(tmp_path / "out"))
    assert commit == git("rev-parse", "HEAD") and C.load_corpus(spark, folder, "corpus-v0.1.0")["provisions"].count() == 4
    for tag in ("corpus-v0.2.0", "corpus-v9", commit, "--all", "../x"):
        with pytest.raises(PipelineError):
            C.tagged_release(repo, tag, str(tmp_path / "other"))


def test_states_of_runs(tmp_path):
    root = str(tmp_path)
    assert W.load_state(root, "r", "k") is None
    W.save_state(root, "r", "k", {"units": ["ü"]})
    assert W.load_state(root, "r", "k") == {"units": ["ü"]} and W.load_state(root, "r", "other") is None
    with pytest.raises(PipelineError, match="gone"):
        W.load_state(root, "r", "k", lambda s: ["gone"])
    assert reader.one_release("a", "a") == "a"
    with pytest.raises(Unavailable):
        reader.one_release("a", "b")


def test_segment_rows(spark):
    import json

    def rules(*segments):
        t = X.table()
        t["source_segments"] = [{"segment_id": f"s{i}", "row_ids": own, "repeated_header_row_ids": again, "source_spans": X.SPAN} for i, (own, again) in enumerate(segments)]
        p = X.provision("schedule-1", "schedule", "SCHEDULE", "Dues", None, 2, [t])
        df = spark.createDataFrame([("r", p["provision_id"], json.dumps(p))], "release_tag string, provision_id string, canonical_record string")
        return sorted((r["rule"], r["detail"]) for r in V.segment_rows(flatten_blocks(df)).collect())

    assert rules((["row-1", "row-2"], ["row-1"]), ([], [])) == []
    assert rules((["row-9"], [])) == [("unknown_segment_row", "s0/row-9")] and rules(([], ["row-9"])) == [("unknown_repeated_row", "s0/row-9")]
    assert rules((["row-2"], ["row-2"]), (["row-2"], ["row-1"])) == [("repeated_row_no_header", "s0/row-2"), ("repeated_row_not_own", "s1/row-1")]
