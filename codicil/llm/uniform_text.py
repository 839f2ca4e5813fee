"""Visually identical text with different characters: one consistent form.

A transducer, compiled once from the Unicode tables, reads a text by grapheme
clusters (a base character and the marks on it). A cluster goes through one trie
of longest matches that replaces what is not the plain character for what is
seen: width and other compatibility variants, special spaces, accents left apart;
invisible characters go where they do nothing. Each distinct cluster is looked up
once and its result, checked to be a fixed point, is kept. Letters of another
alphabet that stand in for look-alikes are decided by their word on the same
walk:

* a word that mixes alphabets is brought to the one its other letters need; for
  these any pair that the public confusables data of Unicode names is accepted;
* a word wholly of letters that look like Latin ones in every face is Latin if
  the text is written in Latin letters elsewhere and nothing in its line is truly
  written in that alphabet; an abbreviation such as the Cyrillic one of the Soviet
  Union stays where its text is Cyrillic;
* a word of figures and of letters that look like figures has figures.

Kept, since they are seen: typographic quotes and dashes, composed letters, marks
for which no composed character exists, superscripts, subscripts, fractions,
circled characters, words drawn as one sign; joiners in emoji sequences, after a
virama, and between letters of scripts that are shaped by them; variation selectors
after symbols and ideographs; tags of flags.

Defined results: null stays null; an empty text stays empty; texts of any
length are processed whole; the function is idempotent.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other alphabets, by the Latin letter they look like in every face; a whole word of them may be a Latin one.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕꜱ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟϹ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "Ԍ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ",
    "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս",
    "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ΥҮ", "Z": "ΖᏃ",
}
#: Letters of other left-to-right alphabets, by the one ASCII letter or figure that Unicode's confusables data gives for them
#: (version 16.0, as ICU 77.1 has it; a test derives them from that library again).
PUBLIC = {
    "2": "ϨᒿꙄ", "3": "ЗӠⳌ𑣊𖼻", "4": "Ꮞ𑢯", "5": "𑢻", "6": "бᏮⳒ𑣕", "7": "𐓒𑣆", "8": "𐌚", "9": "Ⳋ𑢬𑣌𑣖", "A": "ΑАᎪᗅꓮ𐊠𖽀", "B": "ΒВᏴᗷꓐ𐊂𐊡𐌁",
    "C": "СᏟⲤꓚ𐊢𐌂𐐕𐔜", "D": "Ꭰᗞᗪꓓ", "E": "ΕЕᎬⴹꓰ𐊆𑢦𑢮", "F": "Ϝᖴꓝ𐊇𐊥𐔥𑢢𑣂", "G": "ԌᏀᏳꓖ", "H": "ΗНᎻᕼⲎꓧ𐋏", "I": "ΙІӀⲒ", "J": "ͿЈᎫᒍꓙ",
    "K": "ΚКᏦᛕⲔꓗ𐔘", "L": "ᏞᒪⳐꓡ𐐛𐔦𑢣𑢲𖼖", "M": "ΜϺМᎷᗰᛖⲘꓟ𐊰𐌑", "N": "ΝⲚꓠ𐔓", "O": "ΟОՕଠዐⲞⵔꓳ𐊒𐊫𐐄𐓂𐔖𑢵", "P": "ΡРᏢᑭⲢꓑ𐊕", "Q": "ⵕ",
    "R": "ᎡᏒᖇꓣ𐒴𖼵", "S": "ЅՏᏕᏚꓢ𐊖𐐠𖼺", "T": "ΤТᎢⲦꓔ𐊗𐊱𐌕𑢼𖼊", "U": "Սሀᑌꓴ𐓎𑢸𖽂", "V": "ѴᏙᐯⴸꓦꛟ𐔝𑢠𖼈", "W": "ԜᎳᏔꓪ", "X": "ΧХᚷⲬⵝꓫ𐊐𐊴𐌗𐔧",
    "Y": "ΥУҮᎩᎽⲨꓬ𐊲𑢤𖽃", "Z": "ΖᏃꓜ𑢩", "a": "αа", "b": "ЬᏏᑲᖯ", "c": "сⲥꮯ𐐽", "d": "ԁᏧᑯꓒ", "e": "еҽ", "f": "ք", "g": "ց", "h": "һհᏂ",
    "i": "ιіӏᎥꙇꭵ𑣃", "j": "ϳј", "l": "ᛁⵏꓲ𐊊𐌉𖼨", "m": "𑜀", "n": "ոռ", "o": "οσоօഠဝჿⲟ𐐬𐓪𑣈𑣗", "p": "ρрⲣ", "q": "ԛգզ", "r": "гᴦⲅꮁ",
    "s": "ѕꮪ𐑈𑣁", "u": "υս𐓶𑣘", "v": "νѵꮩ𑜆𑣀", "w": "ѡԝաꮃ𑜊𑜎𑜏", "x": "хᕁᕽ", "y": "γуүყ𑣜", "z": "ꮓ𑣄",
}
#: Compatibility decompositions that change what is seen.
_DIFFERENT = ("<super>", "<sub>", "<fraction>", "<circle>")
_DASHES = "‐‑‒–—―−"
_FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
_BREAKS = "\u2028\u2029"
_SHAPED = frozenset(("ARABIC", "SYRIAC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "MONGOLIAN", "KHMER", "MYANMAR", "TIBETAN"))
_JOINERS = "\u200c\u200d"
_WIDTH = 0xFEE0  # from an ASCII character to its full-width form
_CACHE = 100_000


@lru_cache(65536)
def _script(ch: str) -> str:
    """First word of the name of a letter or mark: LATIN, GREEK, CYRILLIC, ..."""
    return unicodedata.name(ch, "").split(" ", 1)[0] if ch.isalpha() or unicodedata.category(ch)[0] == "M" else ""


def _selector(ch: str) -> bool:
    return "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef"


def _tag(ch: str) -> bool:
    return "\U000e0020" <= ch <= "\U000e007f"


def _hidden(ch: str) -> bool:
    """Characters that are not seen by themselves."""
    return unicodedata.category(ch) == "Cf" and unicodedata.bidirectional(ch) != "AN" or ch in _FILLERS or _selector(ch)


def _plain(ch: str, twice_widened: bool) -> str | None:
    """What replaces a single character anywhere, or None if it is plain."""
    cp, kind = ord(ch), unicodedata.category(ch)
    if cp < 0x80 or ch in _DASHES or cp == 0xFFFD:
        return None
    if kind == "Zs" or ch in _BREAKS:
        return " " if kind == "Zs" else "\n"
    if _hidden(ch):
        return None
    if kind == "Cn":
        back = cp - 2 * _WIDTH
        return chr(back) if twice_widened and 0x21 <= back <= 0x7E else None
    rule = unicodedata.decomposition(ch)
    if rule.startswith("<"):
        out = None if rule.startswith(_DIFFERENT) else unicodedata.normalize("NFKC", ch)
        if out and len(out) > 3 and unicodedata.bidirectional(ch) in ("R", "AL"):  # a word drawn as one sign
            return None
    else:
        out = unicodedata.normalize("NFC", ch)
    return out if out != ch else None


@lru_cache(1)
def _public_lookalikes() -> tuple[tuple[str, str], ...]:
    """The public look-alikes in pairs. They come with the code, so that no session, library or call that fails can leave any out."""
    return tuple((ch, plain) for plain, others in PUBLIC.items() for ch in others)


class Transducer:
    """The compiled tables. ``single``: by character; ``trie``: base and marks, in canonical order."""

    def __init__(self, public: tuple[tuple[str, str], ...] = (), twice_widened: bool = False) -> None:
        self.standing: dict[str, str] = {}
        for plain, others in LOOKALIKES.items():
            for ch in others:
                if self.standing.setdefault(ch, plain) != plain:
                    raise ValueError(f"conflict: U+{ord(ch):04X} stands in for two letters")
        self.single: dict[str, str] = {}
        self.trie: dict = {}
        for cp in range(0x80, sys.maxunicode + 1):
            if 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or cp >= 0xF0000:
                continue
            ch = chr(cp)
            if ch not in self.standing and (out := _plain(ch, twice_widened)) is not None:
                self._add(self.single, ch, out)
            rule = unicodedata.decomposition(ch)
            if rule and not rule.startswith("<"):
                parts = unicodedata.normalize("NFD", ch)
                if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
                    node = self.trie
                    for p in parts:
                        node = node.setdefault(p, {})
                    self._add(node, "", ch)
        self._check()
        self.mixed = {c: o for c, o in public if o.isalpha() and c not in self.single} | self.standing
        self.figures = {c: o for c, o in public if o.isdigit() and c not in self.single}
        self.reverse = {s: {p: c for c, p in self.standing.items() if _script(c) == s} for s in ("GREEK", "CYRILLIC", "ARMENIAN")}
        marks = {chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me")}
        self.hidden = frozenset(chr(c) for c in range(0x80, sys.maxunicode + 1) if _hidden(chr(c)))
        self.foreign = re.compile("[" + "".join([*self.mixed, *self.figures]) + "]")
        self.odd = frozenset(self.single) | frozenset(self.mixed) | frozenset(self.figures) | marks | self.hidden
        self.cluster = regex.compile(r"\X", regex.S)
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}]+")
        self.known: dict[str, str] = {}

    @staticmethod
    def _add(node: dict, key: str, out: str) -> None:
        if node.setdefault(key, out) != out:
            raise ValueError(f"conflict: {key!r} has two plain forms")

    def _check(self) -> None:
        """Every output is a fixed point: nothing in it is replaced again."""
        for ch, out in list(self.single.items()):
            again = unicodedata.normalize("NFC", "".join(self.single.get(c, c) for c in out))
            self.single[ch] = "".join(self.single.get(c, c) for c in again)
            if any(self.single.get(c, c) != c for c in self.single[ch]):
                raise ValueError(f"U+{ord(ch):04X} maps to {out!r}, which is mapped again")

    def _match(self, text: str) -> str:
        """Longest matches over base characters and their marks, in canonical order."""
        rest = unicodedata.normalize("NFD", "".join(self.single.get(c, c) for c in text))
        out, i = [], 0
        while i < len(rest):
            node, best, j = self.trie, None, i
            while j < len(rest) and rest[j] in node:
                node = node[rest[j]]
                j += 1
                if "" in node:
                    best = node[""], j
            out.append(best[0] if best else rest[i])
            i = best[1] if best else i + 1
        return unicodedata.normalize("NFC", "".join(out))  # a mark may compose past another one

    def form(self, cluster: str) -> str:
        """The plain form of a cluster, found once for each distinct one."""
        if (out := self.known.get(cluster)) is None:
            out, last = self._match(cluster), cluster
            while out != last:
                out, last = self._match(out), out
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[cluster] = out
        return out

    def _seen(self, text: str, i: int) -> bool:
        """Whether a hidden character does something to what is seen at its place."""
        ch = text[i]
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if not before:
            return False
        before, after = self.single.get(before, before)[-1:], self.single.get(after, after)[:1]  # as they will be
        kind = unicodedata.category(before)
        if ch in _JOINERS:
            j = i - 1
            while j >= 0 and unicodedata.category(text[j])[0] == "M":
                if unicodedata.combining(text[j]) == 9 and _script(text[j]) in _SHAPED:
                    return True
                j -= 1
            if before.isalpha() and after.isalpha() and _script(before) in _SHAPED and _script(after) in _SHAPED:
                return True
            drawn = kind == "So" or "\U0001f3fb" <= before <= "\U0001f3ff" or (before == "\ufe0f" and i > 1 and text[i - 2] not in self.single and unicodedata.category(text[i - 2]) == "So")
            return ch == "\u200d" and drawn and after != "" and unicodedata.category(after) in ("So", "Sm")
        if _selector(ch):
            return kind in ("So", "Sm", "Sk") or before.isalpha() and _script(before) in ("CJK", "MYANMAR", "MONGOLIAN") or (before in "0123456789#*" and after == "\u20e3")
        if _tag(ch):
            return before == "\U0001f3f4" or (_tag(before) and self._seen(text, i - 1))
        if ch in "\u180b\u180c\u180d\u180f":
            return before not in self.hidden and before.isalpha() and _script(before) == "MONGOLIAN"
        return ch in "\u115f\u1160" and any(c.isalpha() and c not in self.hidden and "\u1100" <= c <= "\u11ff" for c in (before, after))

    def _shown(self, text: str, start: int, end: int) -> str:
        """A piece of text without what is hidden and does nothing there."""
        piece = text[start:end]
        if self.hidden.isdisjoint(piece):
            return piece
        return "".join(c for i, c in enumerate(piece, start) if c not in self.hidden or self._seen(text, i))

    def _piece(self, text: str, start: int, end: int) -> str:
        """A run of words: hidden and variant characters and accents by clusters, then the letters that stand in, by words."""
        out = "".join(map(self.form, self.cluster.findall(self._shown(text, start, end))))
        if not unicodedata.is_normalized("NFC", out):  # marks of neighbouring clusters in another order
            out = unicodedata.normalize("NFC", out)
        return self.word.sub(lambda m: self._word(m[0], text, start), out) if self.foreign.search(out) else out

    def _word(self, word: str, text: str, at: int) -> str:
        """One word in plain characters, with the letters it needs."""
        if not self.foreign.search(word):
            return word
        scripts = {_script(c) for c in word if c.isalpha()} - {""}
        strange = [c for c in word if c.isalpha() and _script(c) != "LATIN"]
        if "LATIN" in scripts:
            if all(c in self.mixed for c in strange):
                return self._recast(word, self.mixed)
            back = self.reverse.get(next(iter(scripts - {"LATIN"})), {}) if len(scripts) == 2 else {}
            if all(c in back for c in word if c.isalpha() and _script(c) == "LATIN"):  # Latin letters inside a word of another alphabet
                return self._recast(word, {c: back[c] for c in back if _script(c) == "LATIN"})
            return word
        if strange and all(c in self.figures for c in strange) and any(c.isdigit() for c in word):
            return self._recast(word, self.figures)
        if all(c in self.standing for c in strange) and (len(scripts) > 1 or self._is_latin(text, at, scripts)):
            return self._recast(word, self.standing)
        return word

    def _recast(self, word: str, table: dict[str, str]) -> str:
        return unicodedata.normalize("NFC", "".join(table.get(c, c) for c in word))

    def _plainly(self, text: str, low: int, high: int) -> list[str]:
        """The words of a part of a text as they will be, but for letters standing in."""
        return self.word.findall("".join(self.single.get(c, c) for c in self._shown(text, low, high)))

    def _is_latin(self, text: str, at: int, scripts: set[str]) -> bool:
        """Whether a word wholly of look-alikes is Latin: its line has nothing truly of its alphabet, and its text has Latin letters."""
        low = max(text.rfind(b, 0, at) for b in ("\n", *_BREAKS)) + 1
        if (low, *scripts) not in self.true:
            high = min((i for i in (text.find(b, at) for b in ("\n", *_BREAKS)) if i >= 0), default=len(text))
            self.true[(low, *scripts)] = any(
                {_script(c) for c in w if c.isalpha()} <= scripts and any(c.isalpha() and c not in self.standing for c in w) for w in self._plainly(text, low, high))
        if self.true[(low, *scripts)]:
            return False
        if () not in self.true:
            scripts_of = ((w, {_script(c) for c in w if c.isalpha()}) for w in self._plainly(text, 0, len(text)))
            self.true[()] = any("LATIN" in own or (len(own) > 1 and all(c in self.standing for c in w if c.isalpha())) for w, own in scripts_of)
        return self.true[()]

    def _in_run(self, ch: str) -> bool:
        return (ch in self.odd or ch.isalnum()) and ch not in _BREAKS

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii() or self.odd.isdisjoint(text):
            return text
        out, at = [], 0
        self.true: dict[tuple, bool] = {}  # of this text: lines with true words of an alphabet, and whether there are Latin letters
        for i, ch in enumerate(text):
            if i < at or ch not in self.odd:
                continue  # plain, or within a run that is done
            start = end = i
            while start > at and self._in_run(text[start - 1]):
                start -= 1
            while end < len(text) and self._in_run(text[end]):
                end += 1
            end = max(end, i + 1)
            if start > at and unicodedata.category(text[start])[0] == "M" and text[start - 1] not in "\n" + _BREAKS:
                start -= 1  # a mark on something that is no letter
            out += text[at:start], self._piece(text, start, end)
            at = end
        out.append(text[at:])
        return "".join(out)


@lru_cache(4)
def transducer(public: tuple[tuple[str, str], ...] = (), twice_widened: bool = False) -> Transducer:
    return Transducer(public, twice_widened)


def _uniform(column: str, only_changed: bool, public: tuple[tuple[str, str], ...], twice_widened: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = transducer(public, twice_widened)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            out = [form(t) for t in texts]
            changed = [a != b for a, b in zip(texts, out)]
            arrays = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(out, pa.string()), pa.array(changed, pa.bool_())]
            made = pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_uniform", "_changed"])
            yield made.filter(made.column("_changed")) if only_changed else made

    return run


#: For the JVM: most texts are plain ASCII and never go to Python.
NON_ASCII = "[^\\x00-\\x7F]"


def uniform_text(df: DataFrame, column: str, only_changed: bool = False, twice_widened: bool = False) -> DataFrame:
    """``df`` with ``_uniform`` (the text in its consistent form) and ``_changed``.

    ``twice_widened``: unassigned code points that lie where the widening of a
    full-width form once more would put it are read as that form, for sources whose
    characters were converted twice.
    """
    df = df.drop("_uniform", "_changed")  # columns of these names give way to the new ones
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _uniform string, _changed boolean"
    odd = df.where(F.col(column).rlike(NON_ASCII)).mapInArrow(_uniform(column, only_changed, _public_lookalikes(), twice_widened), schema)
    if only_changed:
        return odd
    plain = df.where(~F.coalesce(F.col(column).rlike(NON_ASCII), F.lit(False)))
    return odd.unionByName(plain.withColumns({"_uniform": F.col(column), "_changed": F.lit(False)}))
