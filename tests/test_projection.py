import os

import pytest

from codicil.errors import InvalidRequest, NotFound, PipelineError, Unavailable
from codicil.operators import search as S
from codicil.plans import projection as J
from codicil.service import Reader
from codicil.sources import corpus as C
from tests import corpus_fixture as X


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    root = X.write(str(tmp_path_factory.mktemp("corpus")))
    return J.build(C.load_corpus(spark, root, "corpus-v0.1.0"))


def release(tag="corpus-v0.1.0", sha="1" * 40):
    return J.Release(tag, sha, ("0.1.0",))


def test_golden_columns(rows):
    assert {k: v.count() for k, v in rows.items()} == {"acts": 1, "sources": 1, "provisions": 4, "citations": 1}
    a = rows["acts"].first()
    assert a["title_keys"] == ["harbour act 2023", "harbour act", "an act about harbours", "ha 2023"] and a["citation_key"] == "act no 37 of 2023"
    assert a["searchable_text"].split("\n") == ["Harbour Act 2023", "Harbour Act", "An Act about harbours", "HA 2023", "Act No. 37 of 2023", "2023", "37"]
    p = rows["provisions"].orderBy("sequence").collect()
    assert [r["sequence"] for r in p] == [1, 2, 3, 4] and [r["depth"] for r in p] == [0, 1, 2, 0]
    assert [r["reference_key"] for r in p] == ["chapter 2", "section 8", "section 8 paragraph b", "schedule 1"]
    assert p[2]["searchable_text"] == "(b)\nat every quay:\n(i)\na log;\n(ii)\na lamp.\nsection 8 paragraph b"
    assert p[3]["searchable_text"].split("\n") == ["SCHEDULE", "Dues", "Quay dues", "Metres", "Due", "12", "45.50", "Per day or part of a day.", "schedule 1"]
    assert p[3]["source_ids"] == [X.SOURCE]


def test_import_activate_rollback(spark, rows, tmp_path):
    store = J.Store(spark, str(tmp_path / "store"))
    with pytest.raises(Unavailable):
        Reader(store).ready()
    assert store.preview(release()) == ("import_and_activate", ())
    assert not os.path.exists(store.root)  # a preview writes nothing
    assert store.publish(release(), rows) == "import_and_activate"
    assert store.publish(release(), rows) == "noop"
    assert store.preview(release(sha="2" * 40)) == ("blocked", ("release_commit_conflict",))
    second = {k: v.withColumn("release_tag", J.F.lit("corpus-v0.2.0")) for k, v in rows.items()}
    assert store.publish(release("corpus-v0.2.0"), second) == "import_and_activate"
    assert store.pointer() == {"active_release_tag": "corpus-v0.2.0", "previous_release_tag": "corpus-v0.1.0"}
    assert store.publish(release(), rows) == "activate_existing"
    assert store.pointer()["active_release_tag"] == "corpus-v0.1.0"
    with pytest.raises(PipelineError, match="corpus-v0.0.0"):
        store.publish(release("corpus-v0.0.0"), rows)
    with store.lock(), pytest.raises(PipelineError) as e:
        store.publish(release("corpus-v0.3.0"), rows)
    assert e.value.code == "projection_busy"


def test_failed_import_leaves_no_trace(spark, tmp_path):
    root = X.write(str(tmp_path / "c"), target="qm-federal-2000-1")
    store = J.Store(spark, str(tmp_path / "store"))
    with pytest.raises(PipelineError) as e:
        store.publish(release(), J.build(C.load_corpus(spark, root, "corpus-v0.1.0")))
    assert e.value.code == "import_reference_missing"
    assert store.release("corpus-v0.1.0") is None and store.pointer()["active_release_tag"] is None


def test_decisions():
    bad = J.Release("x", "s", ("0.1.0",), 1, "importing")
    want = release()
    assert J.decide(want, J.State(active=bad), True) == ("blocked", ("active_release_invalid",))
    assert J.decide(want, J.State(read_only=False), True) == ("blocked", ("projection_not_read_only",))
    assert J.decide(want, J.State(), False) == ("blocked", ("projection_database_read_only",))
    held = J.Release(want.release_tag, want.commit_sha, ("0.2.0",))
    assert J.decide(want, J.State(target=held), True) == ("blocked", ("release_metadata_conflict",))
    assert J.decide(want, J.State(target=J.Release(want.release_tag, want.commit_sha, ("0.1.0",), 1, "importing")), True)[1] == ("release_import_incomplete",)
    assert J.decide(want, J.State(target=want), True) == ("activate_existing", ())


def test_reader(spark, rows, tmp_path):
    store = J.Store(spark, str(tmp_path / "store"))
    store.publish(release(), rows)
    r = Reader(store)
    assert r.health() == {"status": "ok"} and r.meta()["commit_sha"] == "1" * 40
    assert r.list_acts()["total"] == 1 and r.list_acts(1, 5)["items"] == []
    assert [s["source_id"] for s in r.get_act(X.ACT)["sources"]] == [X.SOURCE]
    outline = [(x["provision_id"].split(":")[1], x["has_content"], x["has_children"]) for x in r.contents(X.ACT).collect()]
    assert outline == [("chapter-2", False, True), ("section-8", True, True), ("section-8.paragraph-b", True, False), ("schedule-1", True, False)]
    assert r.contents(X.ACT, max_depth=0).count() == 2 and r.contents(X.ACT, "qm-x-2000-1:none").count() == 0
    d = r.get_provision(f"{X.ACT}:section-8.paragraph-b")
    summary = lambda local: f"{X.ACT}:{local}"
    assert [a["provision_id"] for a in d["ancestors"]] == [summary("chapter-2"), summary("section-8")] and d["navigation"]["previous"]["provision_id"] == summary("section-8") and d["navigation"]["next"]["provision_id"] == summary("schedule-1")
    assert d["descendants"] == [] and d["citations"] == [] and set(d["act"]) == set(S.ACT_SUMMARY) and d["provision"]["display_label"] == "(b)" and [x["source_id"] for x in d["sources"]] == [X.SOURCE]
    top = r.get_provision(f"{X.ACT}:chapter-2")
    assert [x["provision_id"] for x in top["descendants"]] == [summary("section-8"), summary("section-8.paragraph-b")] and top["ancestors"] == [] and top["navigation"]["previous"] is None
    assert [(c["citation"]["source_block_id"], c["target"]["act"]["act_id"], c["target"]["provision"]["provision_id"]) for c in top["citations"]] == [("duty", X.ACT, summary("section-8"))]
    assert r.get_source(X.SOURCE)["document_title"] == "Gazette 1"
    assert r.search("HA 2023")[0]["match_kind"] == "exact_act_alias"
    assert r.search("Act No 37 of 2023")[0]["match_kind"] == "exact_act_citation"
    hit = r.search("section 8 paragraph b", act_id=X.ACT)[0]
    assert (hit["match_kind"], [b["display_label"] for b in hit["breadcrumb"]], hit["act"]["act_id"], hit["provision"]["node_type"]) == ("exact_provision_reference", ["CHAPTER II", "8."], X.ACT, "paragraph")
    assert hit["excerpt"].startswith("(b)") and r.search("HA 2023")[0]["provision"] is None
    assert [(x["kind"], x["match_kind"]) for x in r.search("lamps")] == [("provision", "lexical")] and r.search("nothing like it") == []
    for call in (lambda: r.get_act("Nope"), lambda: r.search("  "), lambda: r.search("x", limit=51), lambda: r.list_acts(limit=0), lambda: r.search("x" * 257)):
        with pytest.raises(InvalidRequest):
            call()
    with pytest.raises(NotFound) as e:
        r.get_act("qm-federal-1900-1")
    assert e.value.code == "act_not_found"


def test_loader_is_strict(spark, tmp_path):
    root = X.write(str(tmp_path / "a"), extra="notes.txt")
    assert {tuple(r) for r in C.layout(spark, root).collect()} == {("unexpected", "notes.txt")}
    with pytest.raises(PipelineError):
        C.load_corpus(spark, root, "t")
    os.unlink(os.path.join(root, "notes.txt"))
    os.unlink(os.path.join(root, "qm/federal/acts/2023/37/citations.jsonl"))
    assert {tuple(r) for r in C.layout(spark, root).collect()} == {("missing", "qm/federal/acts/2023/37/citations.jsonl")}
    path = os.path.join(root, "sources.jsonl")
    with open(path, "w") as f:
        f.write('{"source_id":"b"}\n\nnot json\n{"source_id":"a"}\n')
    lines = C.read_lines(spark, path, "source_id string")
    assert [(r["line"], r["source_id"]) for r in lines.where("_corrupt_record is null").orderBy("line").collect()] == [(1, "b"), (4, "a")]
    assert [r["line"] for r in C.bad_lines(lines).collect()] == [3]
    assert [r["source_id"] for r in C.unsorted_sources(lines.where("_corrupt_record is null")).collect()] == ["a"]
