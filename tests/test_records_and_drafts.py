import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from codicil.functions.records import check_record
from codicil.operators import drafts as D
from codicil.operators.ranking import ranked
from tests import corpus_fixture as X


def source():
    return X.source() | {"publication": None, "redistribution": {"status": "allowed", "license": None, "notes": None}, "document_notes": []}


VALID = {"act": X.act(), "provision": X.provisions()[0], "source": source(), "citation": X.citation()}


@pytest.mark.parametrize("kind", VALID)
def test_valid_records(kind):
    assert check_record(kind, json.dumps(VALID[kind])) == []


def test_tables_and_lists_are_valid():
    for p in X.provisions():
        assert check_record("provision", json.dumps(p)) == []


@pytest.mark.parametrize("kind,change,path", [
    ("act", {"version_id": "1"}, "$.version_id"), ("provision", {"node_type": "clauseish"}, "$.node_type"), ("provision", {"node_type": "proviso"}, "$.node_type"), ("act", {"document_type": "act"}, "$.document_type"),
    ("act", {"language": "eng"}, "$.language"), ("act", {"status": "active"}, "$.status"), ("act", {"text_kind": "restated"}, "$.text_kind"), ("act", {"source_refs": VALID["act"]["source_refs"] * 2}, "$.source_refs"),
    ("source", {"act_id": X.ACT}, "$.act_id"), ("source", {"media_type": "text/html"}, "$.media_type"), ("citation", {"resolution_status": "open"}, "$.resolution_status"),
    ("provision", {"source_spans": [{"source_id": X.SOURCE, "pdf_page": 1, "printed_page": None}]}, "$.source_spans[0].printed_page"), ("provision", {"order": 0}, "$.order"), ("provision", {"order": True}, "$.order")])
def test_mutations_are_refused(kind, change, path):
    assert [p for p, _ in check_record(kind, json.dumps(VALID[kind] | change))] == [path]


def test_blank_cell_and_broken_text():
    p = copy.deepcopy(X.provisions()[3])
    p["content_blocks"][0]["row_groups"][1]["rows"][0]["cells"][0]["blank"] = True
    assert [m for _, m in check_record("provision", json.dumps(p))] == ["blank cell with content"]
    assert check_record("act", "{") == [("$", "no JSON")] and check_record("act", None) == [("$", "no object")]


def test_misplaced_blocks_and_promoted_children():
    node = {"node_type": "section", "content_blocks": [], "children": [{"kind": "text", "text": "a"}, {"kind": "table", "node_type": "table", "rows": [["x"]], "children": []}, {"node_type": "paragraph", "kind": "text", "children": []}]}
    out = D.embed_blocks(node)
    assert [b["kind"] for b in out["content_blocks"]] == ["text", "table"] and "node_type" not in out["content_blocks"][1] and len(out["children"]) == 1
    loose = lambda t: {"node_type": "subsection", "display_label": None, "heading": None, "children": [], "content_blocks": [{"kind": "text", "text": t}]}
    para = lambda label: {"node_type": "paragraph", "display_label": label, "heading": None, "children": [], "content_blocks": [{"kind": "text", "text": "w"}]}
    section = {"node_type": "section", "children": [{"node_type": "subsection", "display_label": "(1)", "heading": None, "content_blocks": [], "children": [para("(a)"), para("(b)")]}, loose("(c) the third"), loose("Provided that nothing"), loose("Plain words")]}
    got = D.reattach_promoted(section)
    first = got["children"][0]
    assert [c["display_label"] for c in first["children"]] == ["(a)", "(b)", "(c)"] and first["children"][2]["node_type"] == "paragraph"
    assert [b["text"] for b in first["children"][2]["content_blocks"]] == ["the third", "Provided that nothing"] and len(got["children"]) == 2 and len(section["children"]) == 4
    assert D.recover_json('{"a": [1]}]}') == {"a": [1]}
    with pytest.raises(ValueError):
        D.recover_json('{"a": 1} x')
    assert D.table_issues({"column_count": 2, "rows": [["(1) a", "(2) b"]], "header_row_count": 1}) == []
    assert len(D.table_issues({"column_count": 1, "rows": [["(1) a"], ["(2) b"], [" "], []], "header_row_count": 9, "caption": "c"})) == 5


def test_draft_pages(spark):
    df = spark.createDataFrame([(1, "text", "a", [1, 2]), (2, "text", " ", [1]), (3, "text", "a", []), (4, "text", "a", [2, 1]), (5, "text", "a", [0]), (6, "odd", "a", [1]), (7, "text", "a", [1, 1]), (8, "list", None, [1]), (9, "text", "a", None)], "draft_block_id long, kind string, text string, pdf_pages array<int>")
    got = {r["draft_block_id"]: r["problem"] for r in D.block_issues(df).collect()}
    assert got == {2: "blank_text", 3: "no_pages", 4: "not_increasing", 5: "not_positive", 6: "unknown_kind", 7: "not_increasing", 9: "no_pages"}
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, None)], "document string, pdf_page int, text string")
    assert D.marked_text(pages).first()["text"] == "--- PDF PAGE 1 ---\n\n\n--- PDF PAGE 2 ---\nb"


def test_rank_over_tasks(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = {(r["g"], r["v"]): r["rank"] for r in ranked(df, ["g"], ["v"]).collect()}
    for g in ("hot", "a", "b", None):
        own = sorted(v for x, v in rows if x == g)
        assert [got[g, v] for v in own] == list(range(1, len(own) + 1))
    assert ranked(df.where(F.lit(False)), ["g"], ["v"]).count() == 0
