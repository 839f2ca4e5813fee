import pytest

from codicil.llm.language import LANGUAGES, changes, fit, identify, label_column, label_language, sample_labelled, sentences

#: Short passages of everyday wording in each language, written for these tests.
SAYINGS = {
    "eng": ["The farmer brings the apples to the market before the sun is high.", "We would like to know when the next train leaves for the coast.", "Nobody had opened the old wooden door for many years."],
    "fra": ["Le fermier apporte les pommes au marché avant que le soleil soit haut.", "Nous voudrions savoir quand part le prochain train pour la côte.", "Personne n'avait ouvert la vieille porte de bois depuis des années."],
    "deu": ["Der Bauer bringt die Äpfel zum Markt, bevor die Sonne hoch steht.", "Wir möchten wissen, wann der nächste Zug an die Küste fährt.", "Niemand hatte die alte Holztür seit vielen Jahren geöffnet."],
    "spa": ["El granjero lleva las manzanas al mercado antes de que el sol esté alto.", "Quisiéramos saber cuándo sale el próximo tren hacia la costa.", "Nadie había abierto la vieja puerta de madera desde hacía muchos años."],
    "por": ["O fazendeiro leva as maçãs ao mercado antes que o sol esteja alto.", "Gostaríamos de saber quando parte o próximo comboio para a costa.", "Ninguém tinha aberto a velha porta de madeira há muitos anos."],
    "swa": ["Mkulima analeta matunda sokoni kabla jua halijapanda juu.", "Tungependa kujua treni ijayo itaondoka lini kwenda pwani.", "Hakuna mtu aliyefungua mlango ule wa mbao kwa miaka mingi."],
    "hau": ["Manomi yana kawo 'ya'yan itace kasuwa kafin rana ta yi zafi.", "Muna so mu san lokacin da jirgin ƙasa na gaba zai tashi.", "Babu wanda ya buɗe tsohuwar ƙofar katako har shekaru da yawa."],
    "yor": ["Àgbẹ̀ náà ń gbé èso wá sí ọjà kí oòrùn tó mú.", "A fẹ́ mọ ìgbà tí ọkọ̀ ojú irin tó ń bọ̀ yóò gbéra.", "Kò sí ẹni tó ṣí ilẹ̀kùn àtijọ́ náà fún ọ̀pọ̀ ọdún."],
}


@pytest.mark.parametrize("label,lang", [
    ("eng", "eng"), ("EN", "eng"), ("en-QM", "eng"), ("English", "eng"), ("es-419", "spa"), ("yo-Latn", "yor"), ("Français", "fra"), ("ger", "deu"), (" PT ", "por"), ("Kiswahili", "swa"),
    ("ita", "?"), ("und", None), ("unknown", None), ("zxx", None), ("", None), ("  ", None), (None, None), ("123", None)])
def test_labels(label, lang):
    assert label_language(label) == lang


def documents():
    rows, k = [], 0
    for lang in LANGUAGES:
        for n in range(12):
            k += 1
            text = "\n\n".join(" ".join(SAYINGS[lang][(n + j) % 3] for j in range(3)) for _ in range(2))
            label = lang if n % 6 else LANGUAGES[(LANGUAGES.index(lang) + 1) % 8]  # a sixth of the labels is wrong
            rows.append((k, label, text.upper() if n % 5 == 1 else text, lang))
    return rows


def test_fit_recovers_from_wrong_labels_and_mixtures_are_split(spark):
    rows = documents()
    mixed = "\n\n".join([" ".join(SAYINGS["eng"]), " ".join(SAYINGS["fra"]), "12. — 34", " ".join(SAYINGS["eng"])])
    extra = [(900, None, mixed, "eng"), (901, "xx", None, None), (902, "eng", "", None), (903, "eng", "1234 --", None), (904, "deu", " ".join(SAYINGS["deu"]) * 400, "deu")]
    df = spark.createDataFrame(rows + extra, "doc_id long, lang string, text string, truth string")
    got = {r["doc_id"]: r for r in identify(df, "text", "lang", ["doc_id", "truth"]).collect()}
    assert len(got) == len(rows) + len(extra)
    for k, _, _, truth in rows:
        assert got[k]["main"] == truth
        assert {s["lang"] for s in got[k]["segments"]} == {truth}
        assert 0.9 < got[k]["main_confidence"] <= 1
    assert got[900]["main"] == "eng" and [s["lang"] for s in got[900]["segments"]] == ["eng", "fra", "eng", "eng"]
    for k in (901, 902, 903):
        assert got[k]["main"] is None and got[k]["main_confidence"] == 0 and not got[k]["segments"]
    assert got[904]["main"] == "deu"
    empty = df.limit(0)
    with pytest.raises(ValueError):
        identify(empty, "text", "lang", ["doc_id"])


def test_held_out_accuracy():
    texts = [s for lang in LANGUAGES for s in SAYINGS[lang][:2]]
    models = fit(texts, [lang for lang in LANGUAGES for _ in range(2)])
    from codicil.llm.language import fold, segment_scores

    held = [SAYINGS[lang][2] for lang in LANGUAGES]
    scores, _, _ = segment_scores([fold(t) for t in held], models)
    right = sum(LANGUAGES[i] == lang for i, lang in zip(scores.argmax(1), LANGUAGES))
    assert right >= 6  # from two sentences each


def test_label_column(spark):
    df = spark.createDataFrame([("EN",), (None,), ("und",), ("ita",)], "lang string")
    assert [r[0] for r in df.select(label_column("lang")).collect()] == ["eng", None, None, "?"]


OTHERS = {
    "ita": "Il contadino porta le mele al mercato prima che il sole sia alto. Vorremmo sapere quando parte il prossimo treno per la costa. Nessuno aveva aperto la vecchia porta di legno da molti anni.",
    "nld": "De boer brengt de appels naar de markt voordat de zon hoog staat. Wij willen graag weten wanneer de volgende trein naar de kust vertrekt. Niemand had de oude houten deur in vele jaren geopend.",
    "none": "Qxj vrrk plomz ghtw ynnb eewq zzkl puhv drts mmgb okij nhuy tgbv rfcd edcx wsxz qazp lokm ijnb uhbv ygvc tfcx rdxz eszw",
    "rus": "Крестьянин несёт яблоки на рынок, пока солнце не поднялось высоко."}


def test_other_languages_are_none_of_ours_and_absent_ones_cannot_be_chosen(spark):
    rows = [r for r in documents() if r[3] != "hau"]
    df = spark.createDataFrame([(k, lang if lang != "hau" else "eng", t) for k, lang, t, _ in rows] + [(1000 + i, None, t) for i, t in enumerate([*OTHERS.values(), " ".join(SAYINGS["hau"])])], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in identify(df, "text", "lang", ["doc_id"]).collect()}
    assert all(got[k]["main"] == truth for k, _, _, truth in rows)
    for i in range(5):
        assert got[1000 + i]["main"] is None and got[1000 + i]["main_confidence"] == 0 and all(s["lang"] is None for s in got[1000 + i]["segments"])
    assert all("hau" not in dict(r["proportions"] or {}) for r in got.values())


def test_changes_within_a_paragraph():
    texts = [" ".join(s) for s in SAYINGS.values()]
    models = fit(texts, list(SAYINGS))
    mixed = " ".join(SAYINGS["eng"]) + " " + " ".join(SAYINGS["fra"]) + " Sure?"
    got = changes([mixed, " ".join(SAYINGS["deu"]), "", "1. 2. 3."], models)
    cut = len(" ".join(SAYINGS["eng"])) + 1
    assert [(a, b, lang) for a, b, lang, _ in got[0]] == [(0, cut, "eng"), (cut, len(mixed), "fra")] and got[1:] == [[], [], []]
    assert sentences("") == [] and sentences("x" * 70 + ". " + "y" * 80) == [(0, 72), (72, 152)] and sentences("Short. " * 30)[-1][1] == 210 and sentences("Short. ") == [(0, 7)]


def test_a_language_of_few_copied_texts_is_sampled(spark):
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 'eng', 'swa') AS lang", "if(id % 2 = 0, concat('the farmer number ', id), 'mkulima analeta matunda sokoni') AS text")
    texts, labels = sample_labelled(rows, "text", "lang", 20)
    assert labels.count("swa") == 1 and labels.count("eng") == 20 and len(set(texts)) == 21
    long = spark.createDataFrame([("eng", "word " * 1000), ("eng", "the farmer"), ("deu", "Der Bauer bringt die Äpfel")], "lang string, text string")
    texts, labels = sample_labelled(long, "text", "lang", 20, sample_bytes=100)
    assert sorted(labels) == ["deu", "eng"]
    many = spark.range(120_000).selectExpr("if(id = 7, 'eng', concat('label ', id)) AS lang", "'the farmer brings the apples' AS text")
    assert sample_labelled(many, "text", "lang", 20)[1] == ["eng"]
