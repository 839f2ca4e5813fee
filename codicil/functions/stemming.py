"""English stemming: the Snowball English stemmer (M. F. Porter, "Snowball: a language for stemming algorithms", 2001; also called Porter2)."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words with a stem of their own, and words that stay, at the start and after the plural step.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
#: Beginnings behind which the first region starts, whatever follows.
BEGINNINGS = ("gener", "commun", "arsen")
#: Endings of steps 2, 3 and 4 with what they become (None: by a rule of their own).
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": None, "li": None,
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": None}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
#: Frequent English words that are not indexed.
STOP_WORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each"
    " few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of"
    " off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this"
    " those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split())
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_V, _N = "[aeiouy]", "[^aeiouy]"


def _after(word: str, start: int) -> int:
    """Where the region behind the first non-vowel that follows a vowel begins."""
    m = re.compile(f"{_V}{_N}").search(word, start)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    return re.search(f"{_N}{_V}[^aeiouywxY]$|^{_V}{_N}$", word) is not None


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of other letters than a to z stay."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w in IRREGULAR:
        return IRREGULAR[w]
    # A y at the start or behind a vowel is a consonant, written Y meanwhile.
    w = re.sub(f"({_V})y", r"\1Y", "Y" + w[1:] if w[0] == "y" else w)
    begin = next((b for b in BEGINNINGS if w.startswith(b)), None)
    r1 = len(begin) if begin else _after(w, 0)
    r2 = _after(w, r1)

    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    # 1b: past and progressive forms
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search(_V, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    # 1c: y behind a consonant
    if len(w) > 2 and w[-1] in "yY" and re.match(_N, w[-2]):
        w = w[:-1] + "i"
    # 2
    ending = _longest(w, STEP2)
    if ending and len(w) - len(ending) >= r1:
        base = w[: -len(ending)]
        if ending == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif ending == "li":
            w = base if base[-1:] and base[-1] in "cdeghkmnrt" else w
        else:
            w = base + STEP2[ending]
    # 3
    ending = _longest(w, STEP3)
    if ending and len(w) - len(ending) >= r1:
        base = w[: -len(ending)]
        if ending != "ative":
            w = base + STEP3[ending]
        elif len(base) >= r2:
            w = base
    # 4
    ending = _longest(w, STEP4)
    if ending and len(w) - len(ending) >= r2 and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
