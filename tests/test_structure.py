import pytest

from codicil.errors import PipelineError
from codicil.operators import structure as S
from codicil.operators import workflow as W


#: id, type, label, parent, order, first words, expected local id
TREE = (
    ("a", "preamble", None, None, 1, "Whereas quays decay", "preamble"),
    ("b", "chapter", "CHAPTER IV", None, 2, None, "chapter-4"),
    ("c", "cross_heading", None, "b", 1, None, "chapter-4.cross-heading-keeping-quays"),
    ("d", "section", "12A.", "c", 1, "A quay master must report.", "section-12a"),
    ("e", "definition", None, "d", 1, "\u201cQuay master\u201d has its plain sense", "section-12a.definition-quay-master"),
    ("f", "paragraph", "(q)", "d", 2, "yearly", "section-12a.paragraph-q"),
    ("g", "subparagraph", None, "f", 7, "in writing", "section-12a.paragraph-q.subparagraph-unnumbered-7"),
    ("h", "section", "12A.", "c", 2, "A second one of that number.", "section-12a~2"),
    ("i", "subsection", "(2)", "h", 1, "It stands alone.", "section-12a.subsection-2"),
    ("j", "schedule", "SCHEDULE A", None, 3, None, "schedule-1"),
    ("k", "schedule_part", "PART III", "j", 1, None, "schedule-1.part-3"),
    ("l", "schedule_paragraph", "6.", "k", 1, "Dues are per day.", "schedule-1.part-3.paragraph-6"),
    ("m", "schedule", None, None, 4, None, "schedule-2"))


def drafts(spark):
    rows = [("act", i, p, n, k, label, "Keeping quays" if k == "cross_heading" else None, o, words) for n, (i, k, label, p, o, words, _) in enumerate(TREE, 1)]
    return spark.createDataFrame(rows, "scope string, node_id string, parent_id string, seq int, node_type string, display_label string, heading string, `order` int, first_text string")


def test_permanent_ids(spark):
    assert {r["node_id"]: r["local_id"] for r in S.assign_ids(drafts(spark)).collect()} == {row[0]: row[-1] for row in TREE}


def test_node_rules(spark):
    nodes = drafts(spark)
    assert S.parent_matrix(nodes).count() == 0 and S.unassignable(nodes).count() == 0

    def under(node, parent):
        return nodes.withColumn("parent_id", S.F.when(S.F.col("node_id") == node, parent).otherwise(S.F.col("parent_id")))

    assert [(r["node_id"], r["parent_type"]) for r in S.parent_matrix(under("g", "h")).collect()] == [("g", "section")]
    assert [r["node_id"] for r in S.mixed_children(under("i", "d")).collect()] == ["d"]


def test_rules_of_drafts(spark):
    rows = [("s", "a", "Plain words (x) amid."), ("s", "b", "First line\n(a) second"), ("s", "c", "The rule: (b) applies"), ("s", "d", "That is —(iv) so; 7. and more"), ("s", "e", None), ("s", "f", "(a) its own")]
    got = S.hidden_markers(spark.createDataFrame(rows, "scope string, node_id string, first_text string")).collect()
    assert {(r["node_id"], r["marker"]) for r in got} == {("b", "(a)"), ("c", "(b)"), ("d", "(iv)")}
    lists = spark.createDataFrame([("s", "a", "bullet", ["x"]), ("s", "b", "lower_alpha", None), ("s", "c", "none", ["(ii)"]), ("s", "d", "none", None)], "scope string, node_id string, marker_style string, labels array<string>")
    assert {r["node_id"] for r in S.structural_lists(lists).collect()} == {"b", "c"}
    nodes = spark.createDataFrame([("s", "u1", None, "8.", "Quays"), ("s", "u1", "n1", None, None), ("s", "u2", None, "9.", None), ("s", "u2", None, "10.", None), ("s", "u3", None, "3.", "Dues"), ("s", "u5", None, "5.", "Tolls")], "scope string, unit_id string, parent_id string, display_label string, heading string")
    units = spark.createDataFrame([("s", "u1", "8", "QUAYS"), ("s", "u2", "9.", None), ("s", "u3", "4.", "Dues"), ("s", "u4", None, None), ("s", "u5", None, "Fees")], "scope string, unit_id string, display_label string, heading string")
    assert {(r["unit_id"], r["issue"], r["n_roots"]) for r in S.unit_roots(nodes, units).collect()} == {("u2", "roots", 2), ("u3", "label", 1), ("u4", "roots", 0), ("u5", "heading", 1)}
    pages = spark.createDataFrame([("s", "u", [2, 3]), ("s", "u", [6]), ("s", "v", [1])], "scope string, unit_id string, pages array<int>")
    assert {(r["unit_id"], r["pdf_page"]) for r in S.page_gaps(pages).collect()} == {("u", 4), ("u", 5)}


@pytest.mark.parametrize("labels,jumps", [(["5.", "5A.", "5B.", "6."], []), (["5.", "5A.", "7."], [("5A", "7")]), (["1.", "Interim", "9.", "10."], []), (["1.", "1."], [("1", "1")]), (["2.", None, "3."], [])])
def test_section_sequence(spark, labels, jumps):
    df = spark.createDataFrame([("a", f"n{i}", i, "section", x) for i, x in enumerate(labels)], "scope string, node_id string, seq int, node_type string, display_label string")
    assert [(r["after"], r["found"]) for r in S.section_jumps(df).collect()] == jumps


def test_plan(spark):
    pages = spark.createDataFrame([("d", i, f"{i}. Heading {i}\nwords") for i in range(1, 7)], "scope string, pdf_page int, text string")
    unit = "scope string, position int, unit_id string, start_page int, end_page int, display_label string, heading string"
    good = spark.createDataFrame([("d", 1, "u1", 1, 3, "1.", None), ("d", 2, "u2", 4, 6, None, "Heading 4")], unit)
    whole = spark.createDataFrame([("d", 1, 6)], "scope string, legal_start int, legal_end int")
    assert S.plan_issues(good, whole, pages).count() == 0
    bad = spark.createDataFrame([("d", 1, "u1", 1, 2, None, None), ("d", 2, "u1", 4, 7, None, "Zzz"), ("d", 3, "u3", 5, 6, None, None)], unit)
    short = spark.createDataFrame([("d", 2, 9)], "scope string, legal_start int, legal_end int")
    codes = {r["issue"] for r in S.plan_issues(bad, short, pages).collect()}
    assert codes == {"page_beyond_document", "start_differs", "end_differs", "duplicate_unit", "unit_outside_range", "units_overlap", "page_gap", "marker_outside_range", "page_not_covered", "heading_not_recoverable"}


def test_patches():
    draft = {"nodes": [{"label": "1.", "children": [{"label": "(a)"}, {"label": "(b)"}]}]}
    out = S.apply_patch(draft, [
        {"op": "move", "from": "/nodes/0/children/1", "path": "/nodes/0/children/0"}, {"op": "replace", "path": "/nodes/0/label", "value": "2."}, {"op": "add", "path": "/nodes/-", "value": {"label": "3."}},
        {"op": "remove", "path": "/nodes/0/children/1"}])
    assert out == {"nodes": [{"label": "2.", "children": [{"label": "(b)"}]}, {"label": "3."}]} and draft["nodes"][0]["label"] == "1."
    for op in ({"op": "remove", "path": ""}, {"op": "remove", "path": "/nodes/4"}, {"op": "move", "from": "/nodes/0", "path": "/nodes/0/children/0"}, {"op": "test", "path": "/nodes"}, {"op": "replace", "path": "/nodes/0/none", "value": 1}):
        with pytest.raises(PipelineError):
            S.apply_patch(draft, [op])
    with pytest.raises(PipelineError, match="list of 1"):
        S.apply_patch(draft, [{"op": "replace", "path": "/nodes/7", "value": 1}])
    with pytest.raises(PipelineError):
        S.apply_patch(draft, [{"op": "add", "path": "/x", "value": 1}] * 25)
    flat = S.flatten_draft(draft)
    assert [(r["draft_id"], r["parent_draft_id"], r["order"], r["path"]) for r in flat] == [("node-0001", None, 1, [1]), ("node-0002", "node-0001", 1, [1, 1]), ("node-0003", "node-0001", 2, [1, 2])]


def test_tables():
    t = S.materialize_table({"header_row_count": 1, "rows": [["Item", "Fee"], ["Mooring", ""]]}, "t")
    cell = t["row_groups"][1]["rows"][0]["cells"]
    assert cell[0]["header_cell_ids"] == ["t-r1-c1"] and cell[1]["blank"] and not cell[1]["content_blocks"]
    with pytest.raises(PipelineError):
        S.materialize_table({"rows": [["a"], ["b", "c"]]}, "t")


def test_runs_resume_and_stay_in_bounds(spark):
    units = W.work_key(spark.createDataFrame([("u1", "text 1"), ("u2", "text 2"), ("u3", None)], "unit_id string, input string"), "unit_id", "input")
    done = units.where("unit_id = 'u1'").select("key").selectExpr("key", "true as valid")
    todo = W.pending(units, done)
    assert todo.count() == 2

    def worker(u):
        if u["unit_id"] == "u3":
            raise ValueError("no input")
        return u["input"].upper()

    got = {r["output"]: (r["error"], r["attempts"]) for r in W.run_units(todo, worker).collect()}
    assert got == {"TEXT 2": (None, 1), None: ("ValueError: no input", 2)}

    def slow(u):
        import time

        time.sleep(5)

    late = W.run_units(todo.limit(1), slow, attempts=1, timeout_s=0.2).collect()
    assert [(r["error"], r["attempts"]) for r in late] == [("TimeoutError: no result within 0.2 s", 1)]
    state, issues, events = W.repair_loop(5, lambda s: ["x"] * s, lambda s, i: s - 2 if s > 3 else s + 1, lambda a, b: len(b) < len(a), W.Settings())
    assert (state, events) == (3, [("audited", 0), ("repaired", 1), ("rejected", 2), ("rejected", 3), ("failed", 3)])
    with pytest.raises(PipelineError, match="2000000"):
        W.repair_loop(1, lambda s: ["x"], lambda s, i: s, lambda a, b: False, W.Settings(), lambda: 3_000_000)
    assert "secret" not in repr(W.Settings(api_key="secret"))
