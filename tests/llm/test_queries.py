"""The registered text queries over the smallest tables."""

import os

import pytest

from codicil.llm import queries as Q
from codicil.llm.language import LANGUAGES, label_language
from codicil.llm.leakage import words

DATA = os.environ.get("CODICIL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["release_tag", "table_name", "record_id", "field_name"], "p5_found": ["table_name", "record_id", "line_no", "noise"], "p6_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "segment_no", "lang"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_with_distinct_rows(spark, name):
    df = Q.queries()[name](spark, DATA)
    got = [str(r) for r in df.collect()]
    assert got and len(got) == len(set(got))
    assert df.columns == COLUMNS.get(name, df.columns)


def test_leaks_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/eval_items.parquet").select("item_id", "text").collect()]
    grams = {}
    for m, t in items:
        w = words(t or "")
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k:k + 13]), set()).add(m)
    want = set()
    for i, t in docs:
        w = words(t or "")
        for k in range(len(w) - 12):
            want |= {(i, m) for m in grams.get(tuple(w[k:k + 13]), ())}
    assert {tuple(r) for r in Q.p6_found(spark, DATA).collect()} == want


def test_languages_agree_with_most_labels(spark):
    """Held-out accuracy: the fit sees a sample, most labels are right, and a document is reported where they differ."""
    docs = {r["doc_id"]: label_language(r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    main = {r["doc_id"]: r["lang"] for r in Q.p8_languages(spark, DATA).where("segment_no = 0").collect()}
    known = [d for d, lang in docs.items() if lang in LANGUAGES]
    assert sum(docs[d] == main[d] for d in known) / len(known) > 0.85
    wrong = {r["doc_id"] for r in Q.p8_found(spark, DATA).where("segment_no = 0").collect()}
    assert wrong == {d for d in docs if docs[d] != main[d]}
