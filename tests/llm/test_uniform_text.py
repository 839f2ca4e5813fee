import pathlib
import random
import subprocess
import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codicil.llm.uniform_text import _public_lookalikes, _script, transducer, uniform_text

CASES = {
    "Ａｃｔ　２００２": "Act 2002", "oﬃce": "office", "№ 5": "No 5", "𝐁𝐨𝐚𝐫𝐝": "Board",  # width and compatibility
    "a b c d": "a b c d", "trans​fer": "transfer", "so­ft": "soft", "A͏ct": "Act", "﻿x⁠y‏": "xy",  # spaces, invisible
    "é": "é", "ọ̀": "ọ̀", "ọ̀": "ọ̀", "ü": "ü",  # accents
    "Аct": "Act", "Surνеy": "Survey", "lօdged": "lodged", "В𝐓Α": "BTA", "А person": "A person", "Mɑrks": "Marks", "Зaкон": "Закон",  # look-alikes
}
KEPT = ["“x” — ‘y’ – z", "ọ̀rọ̀", "ẹ̀kọ́", "Закон", "устав 2006", "Σύνταγμα", "νόμος", "ƙauye ɓangare ɗaki", "m² ½", "Ulbenaré", "", "plain", "это а тоже", "نمی‌خواهم"]


@pytest.mark.parametrize("text,plain", CASES.items())
def test_replaced(text, plain):
    assert transducer()(text) == unicodedata.normalize("NFC", plain)


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    text = unicodedata.normalize("NFC", text)
    assert transducer()(text) == text


SEEN = [
    "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "\u2764\ufe0f", "1\ufe0f\u20e3", "\u8fbb\U000e0100", "\U0001f469\U0001f3fd\u200d\U0001f52c",
    "\u0930\u093e\u091c\u094d\u200d\u092f", "\u0928\u092e\u0938\u094d\u200c\u0924\u0947", "СССР", "А. С. Рос", "ΑΒΑΧ", "Κ.Α.", "\u2460", "\ufdfc", "Закон о СССР", "x\u00b2", "3\u0301"]
RECAST = {
    "\u03f2at": "cat", "ꓐoard": "Board", "ⲞFFICE": "OFFICE", "Асt of the СССР": "Act of the CCCP", "a\ufe0fb": "ab", "x\u200dy": "xy", "19З4": "1934", "\U0001d6c2ct": "act"}


@pytest.mark.parametrize("text", SEEN)
def test_what_is_seen_stays(text):
    assert transducer()(text) == text


def test_recast_with_the_public_table(spark):
    form = transducer(_public_lookalikes())
    assert len(_public_lookalikes()) > 200 and {t: form(t) for t in RECAST} == RECAST
    assert all(form(unicodedata.normalize("NFC", t)) == unicodedata.normalize("NFC", t) for t in [*KEPT, *SEEN])


def test_public_table_is_whole_without_session_or_library():
    code = "from codicil.llm.uniform_text import _public_lookalikes, transducer; t = _public_lookalikes(); print(len(t), transducer(t)('\\ua4d0oard'))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=pathlib.Path(__file__).parents[2])
    assert out.stdout.split() == ["296", "Board"], out.stderr


def test_public_table_is_the_one_of_the_library(spark):
    apart = {"CJK", "KATAKANA", "HIRAGANA", "HANGUL", "BOPOMOFO", "LATIN", "MATHEMATICAL", "FULLWIDTH"}  # fill squares or are Latin already
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] == "L" and unicodedata.bidirectional(c) == "L" and _script(c) not in apart and not unicodedata.decomposition(c)]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    plain: dict[str, list[str]] = {}
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz23456789":
        plain.setdefault(checker.getSkeleton(0, c), []).append(c)
    found = {}
    for c, skeleton in zip(letters, checker.getSkeleton(0, "\n".join(letters)).split("\n"), strict=True):
        if same := plain.get(skeleton):
            found[c] = next((x for x in same if x.isdigit() or x.isupper() == c.isupper()), same[0])
    assert dict(_public_lookalikes()) == found and len(_public_lookalikes()) == len(found)


def test_idempotent_on_many_random_texts(spark):
    form, rng = transducer(_public_lookalikes(), True), random.Random(8)
    odd = sorted(form.odd)
    some = "abOIl10 .\néыЗаконΑΒαβνοсрхоСԱօᎪ\u0301\u0323\u0308\u200b\u200d\ufe0fﬁⅣ№\U0001d6c2\U0001d400Ａ\U0001f468\u094d\u0915"
    for _ in range(100_000):
        text = "".join(rng.choice(some) if rng.random() < 0.8 else rng.choice(odd) for _ in range(rng.randrange(1, 14)))
        once = form(text)
        assert form(once) == once, ascii(text)


@given(st.text(alphabet=st.sampled_from("abOn1 \nе́о̣̀ΑИ－Ａ ​­ﬁ№é’ọα‍ㅤ̈"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_idempotent_and_composed(text):
    once = transducer()(text)
    assert transducer()(once) == once and unicodedata.is_normalized("NFC", once)


def test_table_is_free_of_conflicts():
    t = transducer()
    for ch, out in t.single.items():
        assert all(c not in t.single or t.single[c] == c for c in out), hex(ord(ch))
        assert unicodedata.is_normalized("NFC", out)


def test_dataframe(spark):
    rows = [(1, "Ａct", "q"), (2, None, "q"), (3, "", None), (4, "x" * 300_000 + "е", "q"), (1, "Ａct", "q"), (5, "plain", "q")]
    df = spark.createDataFrame(rows, "id int, text string, _changed string")
    got = sorted((r["id"], r["_uniform"] and r["_uniform"][-3:], r["_changed"]) for r in uniform_text(df, "text").collect())
    assert got == [(1, "Act", True), (1, "Act", True), (2, None, False), (3, "", False), (4, "xxe", True), (5, "ain", False)]
    assert uniform_text(df, "text", only_changed=True).count() == 3
    assert uniform_text(df.limit(0), "text").count() == 0
