import re

import pytest

from codicil.llm.scan_repair import PAGE_NUMBER, ScanRepair, form_of, misread_words, signature, skeleton, variants

BODY = "the council shall publish the annual report within thirty days and the registrar may inspect every vessel at the harbour before the season"


@pytest.mark.parametrize("a,b", [("turn", "tum"), ("claim", "daim"), ("notice", "nofice"), ("meeting", "meehng"), ("village", "wllage"), ("unless", "iinless"), ("pass5", "passs"), ("in", "m"), ("fi|e", "file")])
def test_confusable_spellings_share_a_skeleton(a, b):
    assert skeleton(a) == skeleton(b)


def test_variants_reach_the_written_form():
    for w, f in (("c1aim", "claim"), ("havinq", "having"), ("embankrnent", "embankment"), ("meehng", "meeting"), ("c0nstituti0n", "constitution"), ("mun!cipal", "municipal")):
        assert f in variants(w)


@pytest.mark.parametrize("line,yes", [("107", True), ("— 213 —", True), ("[178]", True), ("C 194", True), ("B. 142", True), ("Page 7", True), ("154 of 244", True), ("l71", True), ("  99", True), ("PART II", False), ("not exceeding 500 units", False), ("I", False), ("", False)])
def test_page_numbers(line, yes):
    assert bool(re.match(PAGE_NUMBER, line)) is yes


def test_forms_of_excerpts():
    assert form_of("— 12 —") == form_of("[12]") == "printed_page_number"
    assert form_of("[Cap. 76]") == form_of("SCHEDULES") == form_of("[Item 1 is\n inserted]") == "editorial_annotation"
    assert form_of("HARBOUR ACT 1973  12") == "recurring_header" and form_of(" ") is None and form_of(None) is None
    assert signature("12 HARBOUR ACT 1973") == signature("H4RBOUR ACT 1973   44")


def make(spark):
    plain = [(i, "s1", BODY.replace(" ", "\n", i % 3)) for i in range(1, 40)]
    faulty = [
        (101, "s1", "the council shall pub-\nlish the annual report"), (102, "s1", "the councll shall publish the\nHARBOUR ACT 1973    12\nannual rep-\n\n13\nort within"), (103, "s1", "every vesse1 at the harb0ur"),
        (104, "s1", "the sub-\ncommittee met"), (105, "s1", "the sub-committee and the sub-committee"), (106, "s1", None), (108, "s1", "--\n...\nthe council shall\n***\npublish-\n--"), (107, "s1", ""), (103, "s1", "every vesse1 at the harb0ur")]
    blocks = spark.createDataFrame(plain + faulty, "draft_block_id long, source_id string, text string").selectExpr("*", "'x' as sig", "1 as kind")
    ex = spark.createDataFrame([(1, "s1", "recurring_header", "HARBOUR ACT 1973"), (2, "s1", "recurring_header", "14"), (3, "s1", None, "[Cap. 3]"), (4, "s1", "printed_page_number", None), (4, "s1", "printed_page_number", None)], "exclusion_id long, source_id string, reason string, source_excerpt string")
    return blocks, ex


def test_noise_and_paragraphs(spark):
    blocks, ex = make(spark)
    r = ScanRepair(blocks, ex)
    got = {tuple(x) for x in r.noise().collect()}
    assert got == {
        ("draft_text_blocks", 101, 1, "split_word"), ("draft_text_blocks", 102, 1, "misread"), ("draft_text_blocks", 102, 2, "running_header"), ("draft_text_blocks", 102, 3, "split_word"),
        ("draft_text_blocks", 102, 5, "page_number"), ("draft_text_blocks", 103, 1, "misread"), ("audit_exclusions", 2, 0, "wrong_reason"), ("audit_exclusions", 3, 0, "wrong_reason")}
    text = {x["draft_block_id"]: x["text"] for x in r.paragraphs().collect()}
    assert text[101] == "the council shall publish the annual report"
    assert text[102] == "the council shall publish the annual report within"
    assert text[103] == "every vessel at the harbour" and text[104] == "the sub-committee met" and text[106] == "" and text[107] == ""


def test_empty(spark):
    blocks, ex = make(spark)
    r = ScanRepair(blocks.limit(0), ex.limit(0))
    assert r.noise().count() == 0 and r.paragraphs().count() == 0


@pytest.mark.parametrize("size", [150, 600])
def test_misread_names_are_found_without_a_frequent_form(spark, size):
    """Names that occur once: the letters of the others tell which are misread, whatever the size of the vocabulary."""
    parts = ["Mor", "Gaul", "Tel", "Nar", "Wen", "Pol", "Sun", "Rim", "Zin", "Ret", "Qua", "Ther"]
    names = [a + b.lower() + c.lower() for a in parts for b in parts for c in parts][::1728 // size]
    misread = {"Morwentelnar": "Morwenfelnar", "Polsunrimgaul": "Polsiinrimgaul", "Therzinmorpol": "Therzirimorpol"}
    assert not set(misread) & set(names)
    vocabulary = spark.createDataFrame([(w, 1) for w in [*names, *misread.values()]], "word string, n long")
    pairs = spark.createDataFrame([], "a string, b string, n long")
    got = {r["word"]: r["form"] for r in misread_words(vocabulary, pairs).collect()}
    assert got == {v: k for k, v in misread.items()}


def test_letter_scores_against_counting(spark):
    import math

    import numpy as np

    from codicil.llm.scan_repair import Letters, letter_model, letter_scores

    words = ["Morgan", "Morwen", "Gaulmor", "mormor", "Eé", "Ɐa"]
    model = letter_model(spark.createDataFrame([(w,) for w in words], "word string"))
    cases = [("Morwen", "Morwenn"), ("mormor", "mormor"), ("Gaulmor", "Qaulmor"), ("Eé", "Ee")]

    def counted(word, string):
        others = [x.lower() for x in words if x != word]
        pad = lambda x: "^^^" + x.lower() + "$"
        total = 0.0
        for i in range(3, len(pad(string))):
            p = 1 / 64
            for k in range(4):
                gram, start = pad(string)[i - k : i + 1], pad(string)[i - k : i]
                at = [(pad(x)[j - k : j], pad(x)[j]) for x in others for j in range(3, len(pad(x)))]
                after = [c for b, c in at if b == start]
                if after:
                    kinds = len(set(after))
                    p = (after.count(gram[-1]) + kinds * p) / (len(after) + kinds)
            total += math.log(p)
        return total

    got = letter_scores([w for w, _ in cases], np.arange(len(cases)), [v for _, v in cases], model)
    assert got.tolist() == pytest.approx([counted(w, v) for w, v in cases])


def test_skeleton_by_column(spark):
    from pyspark.sql import functions as F

    from codicil.llm.scan_repair import skeleton_column

    words = ["Turn", "tum", "WILL", "9q", "meehng", "0865", "fi|e", "dwarf", "Ünder", "zoo2y"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", skeleton_column(F.col("w"))).collect()
    assert all(r[1] == skeleton(r[0]) for r in got)


PHRASES = {
    "modern": "the modern law of", "modem": "a modem for sale", "bill": "this bill was read", "hill": "on hill land near", "east": "the east gate is", "cast": "was cast iron by", "clear": "has clear title to", "dear": "a dear friend who"}
OFTEN = {"modern": 180, "modem": 20, "bill": 400, "hill": 32, "east": 140, "cast": 8, "clear": 80, "dear": 9}


def test_words_that_are_both_true_stay_and_context_finds_the_misread(spark):
    """Frequencies far apart, both words in use: each stays where its neighbours know it; the rare word in the common one's place does not."""
    rows = [PHRASES[w] for w, n in OFTEN.items() for _ in range(n)]
    rows += ["the modem law of the", "this hill was read", "has dear title to"]
    blocks = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "draft_block_id long, source_id string, text string")
    ex = spark.createDataFrame([], "exclusion_id long, source_id string, reason string, source_excerpt string")
    r = ScanRepair(blocks, ex)
    n = len(rows)
    assert {(x["record_id"], x["noise"]) for x in r.noise().collect()} == {(n - 3, "misread"), (n - 2, "misread"), (n - 1, "misread")}
    text = {x["draft_block_id"]: x["text"] for x in r.paragraphs().collect()}
    assert [text[n - 3], text[n - 2], text[n - 1]] == ["the modern law of the", "this bill was read", "has clear title to"]


def test_only_the_place_is_repaired(spark):
    """Of two equal words of a line, one is judged correct."""
    rows = ["he saw the modem law of the modem for sale"] + ["the modern law of the"] * 30 + ["the modem for sale is"] * 9
    blocks = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "draft_block_id long, source_id string, text string")
    ex = spark.createDataFrame([], "exclusion_id long, source_id string, reason string, source_excerpt string")
    text = {x["draft_block_id"]: x["text"] for x in ScanRepair(blocks, ex).paragraphs().collect()}
    assert text[0] == "he saw the modern law of the modem for sale" and text[35] == "the modem for sale is"


def test_headers_without_any_exclusion(spark):
    """By recurrence within a source, over sources, and by the title of the source; short ones too, and not the ends of paragraphs."""
    body = lambda i, head: f"a line of plain words {i}\n{head}\nand more of it for the Council\nof the Harbour Board."
    rows = [(i, "s1", body(i, f"GAZETTE {i}")) for i in range(3)] + [(10 + i, f"t{i}", body(i, f"Federal Reports, Part {i}")) for i in range(3)]
    rows += [(20, "u", body(9, "12 Seed Certification Act")), (21, "v", body(9, "Once Only Heading")), (22, "v", body(3, "No. 4 Well Drilling Act")), (23, "w", body(3, "No. 5 Museum Loans Act")), (24, "x", body(3, "No. 6 Road Haulage Act"))]
    blocks = spark.createDataFrame(rows, "draft_block_id long, source_id string, text string")
    sources = spark.createDataFrame([("u", "Gazette issue 4: Seed Certification Act"), ("v", "Well Drilling Act, office copy"), ("w", "Museum Loans Act"), ("x", "Road Haulage Act"), ("x", None)], "source_id string, document_title string")
    ex = spark.createDataFrame([], "exclusion_id long, source_id string, reason string, source_excerpt string")
    got = {(x["record_id"], x["line_no"]) for x in ScanRepair(blocks, ex, sources).noise().collect() if x["noise"] == "running_header"}
    assert got == {(i, 2) for i, *_ in rows if i != 21}
    assert {x["record_id"] for x in ScanRepair(blocks, ex).noise().collect() if x["noise"] == "running_header"} == {0, 1, 2, 10, 11, 12}
