import json

from codicil import __main__ as M
from codicil.plans import pipeline as L
from tests import corpus_fixture as X
from tests.test_pipeline import drafts


def test_commands_are_parsed():
    a = M.parser().parse_args(["promote", "folder", "corpus", "--execute"])
    assert (a.folder, a.corpus, a.execute, a.documents) == ("folder", "corpus", True, None)
    assert M.parser().parse_args(["run", "p2_found", "dir"]).queries == "codicil.queries" and not M.parser().parse_args(["rollback", "s", "t"]).execute


def test_candidate_review_and_promote(spark, tmp_path, capsys):
    source = X.source() | {"publication": None, "redistribution": {"status": "allowed", "license": None, "notes": None}, "document_notes": []}
    for name, value in (("act", X.act()), ("drafts", drafts()), ("source", source)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    made = M.execute(M.parser().parse_args(["candidate", *(str(tmp_path / f"{n}.json") for n in ("act", "drafts", "source")), str(tmp_path)]))
    folder = str(tmp_path / made["candidate_path"])
    assert M.main(["review", folder]) == 0 and json.loads(capsys.readouterr().out)["machine_extracted"] == 4
    assert M.main(["promote", folder, str(tmp_path / "corpus")]) == 1 and json.loads(capsys.readouterr().err)["code"] == "review_incomplete"
    assert L.review(folder)["ready"] is False


def test_release_commands(spark, tmp_path, capsys):
    root, store = X.write(str(tmp_path / "c")), str(tmp_path / "store")
    run = lambda *a: (M.main(list(a)), json.loads(capsys.readouterr().out.strip().split("\n")[0]))[1]
    assert run("publish", root, store, "corpus-v0.1.0", "1" * 40)["action"] == "import_and_activate"
    assert run("publish", root, store, "corpus-v0.1.0", "1" * 40, "--execute")["executed"] and run("publish", root, store, "corpus-v0.1.0", "1" * 40)["action"] == "noop"
    assert run("rollback", store, "corpus-v0.9.0") == {"release_tag": "corpus-v0.9.0", "action": "blocked", "blockers": ["release_missing"], "executed": False}
    assert run("rollback", store, "corpus-v0.1.0", "--execute")["action"] == "noop"
    assert run("search", store, "Harbour Act 2023")["match_kind"] == "exact_act_title"
