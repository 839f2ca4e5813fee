import json
import os

import pytest

from codicil.errors import PipelineError
from codicil.plans import projection as J
from codicil.sources import corpus as C
from tests import corpus_fixture as X

FOLDER = "qm/federal/acts/2023/37"


def broken(root, name, change):
    """One record of a release changed in place."""
    path = os.path.join(root, "sources.jsonl" if name == "sources" else os.path.join(FOLDER, f"{name}.jsonl" if name != "act" else "act.json"))
    with open(path, encoding="utf-8") as f:
        rows = [json.loads(f.read())] if name == "act" else [json.loads(x) for x in f if x.strip()]
    change(rows)
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))


def test_a_sound_release_passes(spark, tmp_path):
    rows = J.checked(C.load_corpus(spark, X.write(str(tmp_path)), "t"))
    assert rows["provisions"].count() == 4


@pytest.mark.parametrize("name,change,rule", [
    ("citations", lambda r: r[0]["text_range"].update(start=13, end=4), "citation_range"), ("citations", lambda r: r[0]["target"].update(provision_id="qm-federal-2000-1:section-1"), "target_act_differs"),
    ("provisions", lambda r: r[3].update(order=3), "sibling_order"), ("sources", lambda r: r[0].update(page_count=0), "page_beyond_source"),
    ("provisions", lambda r: r[2]["content_blocks"][1].update(block_id="keeps"), "content_id_used_twice"), ("provisions", lambda r: r[3]["content_blocks"][0].update(column_count=1), "cell_too_wide"),
    ("provisions", lambda r: r[1].update(node_type="clause"), "shape"), ("act", lambda r: r[0].update(status_source_ids=["sha256:" + "b" * 64]), "evidence_not_named"), ("provisions", lambda r: r[1].update(parent_provision_id=f"{X.ACT}:gone"), "no_parent")])
def test_what_breaks_a_rule_is_refused(spark, tmp_path, name, change, rule):
    root = X.write(str(tmp_path))
    broken(root, name, change)
    with pytest.raises(PipelineError, match=rule) as e:
        J.checked(C.load_corpus(spark, root, "t"))
    assert e.value.code == "invalid_corpus"
