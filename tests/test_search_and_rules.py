import json

import pytest
from pyspark.sql import functions as F

from codicil.functions import presentation as V
from codicil.functions import textkeys as K
from codicil.functions.blocks import flatten, flatten_blocks
from codicil.functions.stemming import stem
from codicil.operators import search as S
from codicil.operators import validate as M
from codicil.operators.reader import not_modified, parse_offset
from codicil.sources import corpus as C
from codicil.sources import sinks as B
from tests import corpus_fixture as X


@pytest.mark.parametrize("words,want", [
    ("consign consigned consigning consignment", "consign"), ("consist consisted consistency consistent consistently", "consist"), ("consolation consolations console consoled consoling consolingly", "consol"), ("constancy", "constanc"),
    ("conspiracy", "conspiraci"), ("conspirator conspirators", "conspir"), ("knackeries", "knackeri"), ("skies", "sky"), ("skis", "ski"), ("dying", "die"), ("lying", "lie"), ("news", "news"), ("succeed succeeds", "succeed"),
    ("generate generates generated", "generat"), ("generously", "generous"), ("communism", "communism"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("say", "say"), ("by", "by"), ("flies", "fli"), ("ties", "tie"), ("gas", "gas"),
    ("agreed", "agre"), ("relational", "relat"), ("controller", "control"), ("protected protection protections protective", "protect"), ("sitting sittings sits", "sit"), ("youth", "youth"), ("falling", "fall"), ("1994", "1994"), ("éa", "éa")])
def test_stems(words, want):
    assert {stem(w) for w in words.split()} == {want}


def test_lexical(spark):
    texts = spark.createDataFrame([("r", "act", "a", "The protections of personal data"), ("r", "act", "b", "personal notes and, much later, the protection"), ("r", "act", "c", "Data alone"), ("r", "act", "d", None)], "release_tag string, kind string, id string, text string")
    post = S.build_postings(texts)
    run = lambda q: [r["id"] for r in S.lexical(post, S.parse(q)).orderBy(F.desc("rank"), "id").collect()]
    assert run("protection personal") == ["a", "b"]  # the closer words rank first
    assert run('"personal data"') == ["a"] and run("data -personal") == ["c"] and run("notes or alone") == ["b", "c"] and run("the of") == [] and run("-data") == []


def test_cover_density():
    def density(*phrases, more=()):
        spans = [[(p, p) for p in places] for places in phrases]
        return S.cover_density([spans], [*(p for places in phrases for p in places), *more])

    assert density([1], [2]) == pytest.approx(0.1) and density([1], [4]) == pytest.approx(0.1 / 3) and density([1], []) == 0
    assert density([1, 10], [2, 9]) == pytest.approx(0.2)  # 1 to 2 and 9 to 10; what lies between holds a shorter one
    assert density([5], more=[1, 9]) == pytest.approx(0.1)
    # Alternatives: the shortest cover of any; a word of the query within a cover is no gap.
    assert S.cover_density([[[(1, 1)], [(4, 4)]], [[(2, 2)]]], [1, 2, 4]) == pytest.approx(0.1)
    assert S.cover_density([[[(1, 1)], [(4, 4)]]], [1, 2, 4]) == pytest.approx(0.1 / 2)
    assert S.cover_density([[[(3, 5)]]], [3, 4, 5]) == pytest.approx(0.1)


def test_keys(spark):
    df = spark.createDataFrame([("Act No. 37 of 2023",), ("Straße ﬁve",), ("Café",), (None,), ("",)], "s string")
    got = df.select(K.search_key("s"), K.audit_key("s"), K.slug("s")).collect()
    assert [tuple(r) for r in got] == [("act no 37 of 2023", "actno37of2023", "act-no-37-of-2023"), ("strasse five", "strassefive", "strae-five"), ("café", "cafe", "cafe"), (None, None, None), ("", "", "")]
    romans = spark.createDataFrame([("IV",), ("xiv",), ("MCM",), ("IIX",), ("abc",), ("",)], "s string").select(K.roman_value("s")).collect()
    assert [r[0] for r in romans] == [4, 14, 1900, 8, None, None]
    marks = spark.createDataFrame([("PART C", "part"), ("Section 12.", "section"), ("(a)", "paragraph"), ("Chapter IV", "chapter"), (" - ", "section")], "s string, t string").select(K.marker_token("s", "t")).collect()
    assert [r[0] for r in marks] == ["100", "12", "a", "4", None]
    assert K.pointer_tokens("/a~1b/c~0d/0") == ["a/b", "c~d", "0"]
    r = spark.createDataFrame([("ab\nc",)], "s string").select(K.line_ranges("s").alias("x")).first()["x"]
    assert [(x["line"], x["start"], x["end"]) for x in r] == [(1, 0, 2), (2, 3, 4)]


def test_segments(spark):
    df = spark.createDataFrame([("a😀bcdef", [(1, 3, "c1"), (2, 4, "c2"), (5, 4, "c3"), (4, 99, "c4"), (5, 7, "c5")])], "t string, r array<struct<start:int,end:int,citation_id:string>>")
    got = df.select(V.cited_segments(F.col("t"), F.col("r")).alias("s")).first()["s"]
    assert [(x["text"], x["citation_id"]) for x in got] == [("a", None), ("😀b", "c1"), ("cd", None), ("ef", "c5")]


def test_presentation(spark):
    r = spark.createDataFrame([("lower_roman", 4), ("upper_alpha", 2), ("decimal", 7), ("none", 1)], "s string, n int").select(V.list_marker(F.col("s"), F.col("n"))).collect()
    assert [x[0] for x in r] == ["(iv)", "(B)", "7.", None]
    act = X.act("A </script> & B")
    df = spark.createDataFrame([("t", X.ACT, act["titles"]["official"], None, "spent", json.dumps(act))], "release_tag string, act_id string, official_title string, short_title string, status string, canonical_record string")
    ld = V.legislation(df).first()["json_ld"]
    assert "</script>" not in ld and json.loads(ld)["legislationDate"] == "2023-05-01" and "legislationLegalForce" not in json.loads(ld)
    x = spark.createDataFrame([("Fees", "Fees  and more"), ("Fees", "Fees"), (None, "text")], "a string, b string").select(S.excerpt_beyond(F.col("a"), F.col("b"))).collect()
    assert [v[0] for v in x] == ["and more", None, "text"]
    assert not_modified('"a"', 'W/"b", W/"a"') and not_modified('"a"', "*") and not not_modified('"a"', None)
    o = spark.createDataFrame([("7",), ("x",), ("-3",), (None,)], "o string").select(parse_offset(F.col("o"))).collect()
    assert [v[0] for v in o] == [7, 0, 0, 0]


def test_blocks():
    rows = flatten(json.dumps(X.provisions()[3]))
    assert [r["kind"] for r in rows] == ["table", "caption", "cell", "text", "cell", "text", "cell", "text", "cell", "text", "text"]
    assert flatten(None) == flatten("no json") == flatten("[1]") == []


def grid(spark, change):
    t = X.table()
    change(t)
    p = X.provision("schedule-1", "schedule", "SCHEDULE", "Dues", None, 2, [t])
    df = spark.createDataFrame([("r", p["provision_id"], json.dumps(p))], "release_tag string, provision_id string, canonical_record string")
    b = flatten_blocks(df)
    cells = b.where("kind = 'cell'")
    v = M.all_of(M.cells_beyond(cells), M.cell_overlap(cells), M.header_references(cells), M.blank_with_content(cells, b), M.duplicate_content_ids(b))
    return {r["rule"] for r in v.collect()}


def test_table_rules(spark):
    body = lambda t: t["row_groups"][1]["rows"][0]["cells"]
    assert grid(spark, lambda t: None) == set()
    assert grid(spark, lambda t: body(t)[1].update(column_span=2)) == {"cell_too_wide"}
    assert grid(spark, lambda t: body(t)[0].update(row_span=2)) == {"cell_too_tall"}
    assert grid(spark, lambda t: body(t)[0].update(column_span=2)) == {"cells_overlap"}
    assert grid(spark, lambda t: body(t)[0].update(header_cell_ids=["short-due", "gone"])) == {"header_reference"}
    assert grid(spark, lambda t: body(t)[0].update(blank=True)) == {"blank_cell_with_content"}
    assert grid(spark, lambda t: body(t)[0].update(cell_id="short-due")) == {"content_id_used_twice"}


def test_urls_and_requests(spark):
    urls = [("https://a.example/x", None), ("ftp://a", "scheme"), ("https://u:p@a/x", "credentials"), ("https:///x", "host"), ("http://a/x#y", "fragment"), (None, "scheme")]
    got = spark.createDataFrame([(u,) for u, _ in urls], "u string").select(M.bad_url(F.col("u"))).collect()
    assert [r[0] for r in got] == [p for _, p in urls]
    msgs = spark.createDataFrame([('{"a":1,"z":2}',), (None,)], "j string").select(M.required_fields(F.col("j"), ("a", "b"))).collect()
    assert [r[0] for r in msgs] == [["missing b", "unknown z"], ["missing a", "missing b"]]
    with pytest.raises(Exception, match="missing"):
        C.load_request('{"url": "https://a"}')


def test_documents_and_stores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.7\n")
    (tmp_path / "in/b.pdf").write_bytes(b"<html>x</html>")
    docs = C.read_documents(spark, str(tmp_path / "in"))
    assert sorted(r["problem"] or "" for r in docs.select("problem").collect()) == ["", "html"]
    store = str(tmp_path / "store")
    assert B.store_documents(docs, store).count() == 1 and B.store_documents(docs, store).count() == 0
    digest = docs.where("problem is null").first()["source_id"]
    want = spark.createDataFrame([(digest, 9), ("sha256:gone", 1), (digest, 8)], "source_id string, byte_length long")
    assert sorted(r["problem"] for r in C.verify_documents(docs, want).collect()) == ["length", "missing_or_changed"]

    def inspect(content):
        if content.startswith(b"<"):
            raise ValueError("no document")
        yield {"pdf_page": 1, "text": "one"}

    rows = C.inspect_pages(docs, inspect, "source_id string, pdf_page int, text string, inspection_error string").collect()
    assert {(r["text"], r["inspection_error"]) for r in rows} == {("one", None), (None, "ValueError: no document")}
    files = {"x/a.json": B.json_bytes({"b": 1, "a": "é"})}
    assert B.write_candidate(files, str(tmp_path / "cand")) == "written" and B.write_candidate(files, str(tmp_path / "cand")) == "unchanged"
    with pytest.raises(Exception):
        B.write_candidate({"x/a.json": b"other"}, str(tmp_path / "cand"))
    B.write_artifact(str(tmp_path), "s/1.json", {"stage": "extract", "source_id": "q"})
    assert C.load_artifact(str(tmp_path), "s/1.json", "extract", "q")["path"] == "s/1.json"
    for bad in (("../x", "extract"), ("s/1.json", "structure")):
        with pytest.raises(Exception):
            C.load_artifact(str(tmp_path), *bad)
    assert B.jsonl_bytes([{"a": "é"}]) == '{"a":"é"}\n'.encode()


def test_downloads():
    calls = []

    def opener(url):
        calls.append(url)
        return (503, iter([])) if len(calls) == 1 else (200, iter([b"%PDF-", b"x"]))

    content, digest = C.fetch("https://a", opener, lambda s: None)
    assert content == b"%PDF-x" and digest.startswith("sha256:") and len(calls) == 2
    with pytest.raises(Exception, match="404"):
        C.fetch("https://a", lambda u: (404, iter([])), lambda s: None)
    with pytest.raises(Exception):
        C.fetch("https://a", lambda u: (200, iter([b"<html>"])), lambda s: None)


def test_streaming(spark, tmp_path):
    from codicil.streaming.ingest import distinct_arrivals, land

    df = spark.sql("select 'r' release_tag, cast(id % 5 as string) record_id, timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) ts from range(20)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    land(distinct_arrivals(stream, ["release_tag", "record_id"], "ts"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
