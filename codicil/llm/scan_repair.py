"""Noise in text from scanned pages: faulty lines named, paragraphs repaired.

1. Lines. A line that is only a number in one of the usual forms is a page
   number. A line written like a title (most of its longer words capitalised, no
   stop at its end) gets a signature: digits masked away, confusable glyphs folded
   to their strokes. It is a running header if its signature recurs amid sentences of
   its source (``MIN_REPEATS`` times) or of as many sources, was set aside on audited
   pages, or is the title of its source, alone or with words beside it that stand
   beside the titles of as many sources. The rest are text lines.
2. Words. Each text line is followed, by SQL windows over its block, by the next
   text line, past headers, page numbers and blank lines. A word broken off at
   the end of a line is joined to its continuation where the joined form is
   written in one piece elsewhere and the hyphen is not the word's own, which
   its neighbour decides where both spellings are in use.
3. Misread words. All words are grouped by the skeleton of their glyphs, in
   which confusable glyphs are the same strokes (m, rn, in and ni are). In a
   group, a rarer word that one confusion leads to a more frequent form may be a
   misreading of it, and its neighbours decide: a word that has neighbours of its
   own, where the form isn't in use, is a word and stays, except where both
   neighbours at a place know the form and not the word; a word without any is
   taken for the form if it is as rare as misreadings of the form can be, and else
   again only where both neighbours know the form. Mixtures of letters and digits
   can't be words. Names too rare for a form are compared by their letters: a model
   of the letters of all other words tells how much likelier a spelling is that one
   confusion leads to, so that the test goes by the vocabulary, whatever its size.
4. Paragraphs. Text lines are joined again by window order, each word replaced
   at its own place, split words in one piece.

Words, not their occurrences, are grouped and compared; a skeleton's words pass
one after another, the frequent first, in a sorted stream.

Defined results: null and empty texts have no lines with noise and an empty
paragraph; repeated blocks count once, and of different texts under one id the
smallest counts; a text of any length is read whole; without a header anywhere no
line is a running header.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.session import durable

#: Glyphs that scanning takes for each other.
CONFUSIONS = (
    ("m", "rn"), ("m", "in"), ("n", "ri"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("w", "vi"), ("h", "ti"), ("h", "b"), ("e", "c"), ("t", "f"),
    ("a", "o"), ("o", "0"), ("i", "l"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "6"), ("g", "q"), ("g", "9"), ("y", "v"), ("z", "2"),
    ("A", "4"), ("E", "F"), ("O", "0"), ("O", "Q"), ("S", "5"), ("B", "8"), ("I", "l"), ("I", "1"), ("G", "6"), ("Z", "2"), ("1", "l"), ("0", "O"),
    ("i", "!"), ("l", "|"), ("i", "|"), ("l", "!"), ("I", "|"), ("I", "!"), ("1", "|"), ("il", "fl"),
)
_EDITS = sorted({(a, b) for a, b in CONFUSIONS} | {(b, a) for a, b in CONFUSIONS})
#: The same as strokes, so that every confusable spelling has one skeleton: first glyphs of like strokes to one of them, then that one to its strokes.
_ALIKE = ("q9uhb68rl1tf|!yeo0452", "ggnnnnniiiiiiivcaaasz")
_STROKES = (("m", "iii"), ("n", "ii"), ("d", "ci"), ("w", "vi"))
_FOLD = str.maketrans(*_ALIKE)
#: Page numbers, as printed: 12, - 12 -, [12], Page 12, C 12, B. 12, 12 of 90; an l or I may be a misread 1.
PAGE_NUMBER = r"^\s*(?:[-–—]\s*[\dlIO]{1,5}\s*[-–—]|\[\s*[\dlIO]{1,5}\s*\]|(?:[Pp]age|[Pp]\.|[A-Z]\.?)?\s*[\dlIO]*\d[\dlIO]*(?:\s+of\s+[\dlIO]+)?)\s*$"
#: Letters and digits, and the strokes that an i or l may be read as; own hyphens and apostrophes stay within.
_GLYPHS = r"(?:[\p{L}\p{M}\p{N}|]|!(?=[\p{L}|]))+"
WORD = rf"{_GLYPHS}(?:['’-]{_GLYPHS})*"
BROKEN = r"[\p{L}\p{N}|!][-­¬‐‑‒–]\s*$"
#: How often a masked line recurs in a source, or a form of it over sources, to be a header.
MIN_REPEATS = 3
#: Of a title's longer words so many are capitalised; of a line that is taken for a header because it recurs, nearly all.
TITLE_SHARE, ALONE_SHARE = 0.6, 0.85
#: A form is so many times as frequent as a word that is a misreading of it; a word read wrongly n times, n times as much again, up to the second value.
SURE_RATIO, MOST_TIMES = 8, 12
#: Misreadings in shorter forms are told by neighbours only.
MIN_LETTERS = 4
#: Letters that the model looks at, bits of its tables, and by how much (natural logarithm) a spelling must be likelier than a word, for each time that the word occurs.
_GRAM, _GRAM_BITS, LIKELIER = 4, 20, 9.0


def skeleton(word: str) -> str:
    out = word.lower().translate(_FOLD)
    for a, b in _STROKES:
        out = out.replace(a, b)
    return out


def skeleton_column(word: Column) -> Column:
    out = F.translate(F.lower(word), *_ALIKE)
    for a, b in _STROKES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def signature(line: str | None) -> str:
    """Letters of a line as strokes, digits masked away, so page numbers and issues don't matter."""
    if not line:
        return ""
    s = unicodedata.normalize("NFKD", line)
    kept = [w for w in re.sub(r"[^\w\s]|_", "", s).split() if not re.fullmatch(r"[\dlIO]*\d[\dlIO]*", w)]
    return "".join(skeleton(w.replace("F", "e").replace("E", "e")) for w in kept).replace("t", "f").replace("c", "f")


def form_of(excerpt: str | None) -> str | None:
    """What was set aside: the reason that fits an excerpt."""
    if not excerpt or not excerpt.strip():
        return None
    if re.match(PAGE_NUMBER, excerpt):
        return "printed_page_number"
    x = excerpt.strip()
    if x.startswith("[") or signature(x) == signature("SCHEDULES"):
        return "editorial_annotation"
    return "recurring_header"


def variants(word: str) -> set[str]:
    """All spellings that one kind of confusion leads to, at one place or at all places at once."""
    out = set()
    for a, b in _EDITS:
        i = word.find(a)
        while i >= 0:
            out.add(word[:i] + b + word[i + len(a):])
            i = word.find(a, i + 1)
        if word.count(a) > 1:
            out.add(word.replace(a, b))
    out.discard(word)
    return out


def _arrow(kind: str, f):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


# Lines.


_LETTER = "[\\p{L}\\p{M}\\p{N}|!'’]"


def _share(line: Column, least: float) -> Column:
    """Whether a line has longer words, at least so many of them capitalised."""
    long, capital = (F.regexp_count(line, F.lit(f"(?<!{_LETTER}){first}{_LETTER}{{3,}}")) for first in ("\\p{L}", "\\p{Lu}"))
    return (long > 0) & (capital >= least * long)


def titlelike(line: Column) -> Column:
    """Whether a line is written like a title: most longer words capitalised, no stop at its end."""
    return ~line.rlike("[.;:,]\\s*$") & _share(line, TITLE_SHARE)


def stands_alone(line: Column) -> Column:
    """Of lines like titles, those that no sentence runs through: a capital or figure first, nearly all longer words capitalised, a whole word last."""
    return line.rlike("^\\s*[\\p{Lu}\\p{N}]") & _share(line, ALONE_SHARE) & ~line.rlike("(?:^|\\s)\\p{Ll}{1,3}\\s*$")


def _blocks(blocks: DataFrame) -> DataFrame:
    """draft_block_id, source_id, ls: the lines of each block."""
    own = blocks.where("draft_block_id is not null").select("draft_block_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), "source_id").alias("x"))
    return own.groupBy("draft_block_id").agg(F.min("x").alias("x")).select("draft_block_id", "x.source_id", F.split("x.text", "\n").alias("ls"))


def _signed(blocks: DataFrame) -> DataFrame:
    """Lines like titles with their signature; ``amid``: a sentence goes on around them, which it never does around a heading of the text itself."""
    lines = blocks.select("draft_block_id", "source_id", "ls", F.posexplode("ls").alias("i", "line")).where(titlelike(F.col("line")) & ~F.col("line").rlike(PAGE_NUMBER))
    before, after = F.get("ls", F.col("i") - 1), F.get("ls", F.col("i") + 1)
    amid = F.coalesce(before.rlike("[\\p{Ll},]\\s*$"), F.lit(False)) | F.coalesce(after.rlike("^\\s*\\p{Ll}"), F.lit(False))
    return lines.select("draft_block_id", "source_id", (F.col("i") + 1).alias("line_no"), "line", amid.alias("amid"), _arrow("string", signature)("line").alias("sig")).where("sig <> ''")


def _title_pieces(sources: DataFrame) -> DataFrame:
    """source_id, piece: signatures of a source's title and of its parts between colons and commas."""
    titles = sources.where("document_title is not null and source_id is not null").select("source_id", "document_title").distinct()
    parts = F.filter(F.transform(F.split("document_title", "[:,]"), F.trim), lambda x: x.rlike("\\S\\s+\\S"))
    pieces = titles.select("source_id", F.explode(F.concat(F.array("document_title"), parts)).alias("t")).where(titlelike(F.col("t")))
    return pieces.select("source_id", _arrow("string", signature)("t").alias("piece")).where("piece <> ''").distinct()


def header_signatures(lines: DataFrame, exclusions: DataFrame, sources: DataFrame | None) -> DataFrame:
    """sig: what running headers look like."""
    audited = exclusions.where("source_excerpt is not null").select("source_id", "source_excerpt")
    audited = audited.where(titlelike(F.col("source_excerpt")) & ~F.startswith(F.ltrim("source_excerpt"), F.lit("["))).select("source_id", _arrow("string", signature)("source_excerpt").alias("sig"), _arrow("string", form_of)("source_excerpt").alias("form"))
    audited = audited.where("sig <> '' and form = 'recurring_header'").groupBy("source_id", "sig").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("aside"))
    printed = lines.groupBy("source_id", "sig").agg(F.count_if(F.col("amid") & stands_alone(F.col("line"))).alias("n"), F.lit(False).alias("aside"))
    by_source = durable(audited.unionByName(printed).groupBy("source_id", "sig").agg(F.sum("n").alias("n"), F.bool_or("aside").alias("aside")), "signatures")
    recurs = by_source.groupBy("sig").agg(F.max("n").alias("most"), F.count_if(F.col("n") > 0).alias("n_sources"), F.bool_or("aside").alias("aside"))
    out = recurs.where((F.col("most") >= MIN_REPEATS) | (F.col("n_sources") >= MIN_REPEATS) | F.col("aside")).select("sig")
    if sources is not None:
        named = by_source.join(_title_pieces(sources), "source_id").where(F.contains("sig", F.col("piece")))
        at = F.instr(F.col("sig"), F.col("piece"))
        beside = F.concat(F.left("sig", at - 1), F.lit("|"), F.substr("sig", at + F.length("piece")))
        named = durable(named.select("source_id", "sig", beside.alias("beside")), "titled")
        known = named.groupBy("beside").agg(F.countDistinct("source_id").alias("n")).where((F.col("n") >= MIN_REPEATS) | (F.col("beside") == "|")).select("beside")
        out = out.unionByName(named.join(known, "beside", "left_semi").select("sig"))
    return out.distinct()


def classify_lines(blocks: DataFrame, exclusions: DataFrame, sources: DataFrame | None) -> DataFrame:
    """Lines with ``kind`` (text, running_header, page_number or blank), and text lines as sequences of words.

    ``e`` has the words of a line, a broken one in one piece at the line where it
    starts; first: how many words belong to the line before; w0, w9: the words before
    and after; next_no: the next text line.
    """
    blocks = durable(_blocks(blocks), "blocks")
    signed = durable(_signed(blocks), "signed")
    headers = header_signatures(signed, exclusions, sources)
    hits = signed.join(headers, "sig", "left_semi").groupBy("draft_block_id").agg(F.collect_list("line_no").alias("headers"))
    # Blocks are partitioned by id once, whole; their lines and the windows over them stay where they are.
    lines = blocks.repartition("draft_block_id").join(hits, "draft_block_id", "left")
    lines = lines.select("draft_block_id", "source_id", F.coalesce("headers", F.array().cast("array<int>")).alias("headers"), F.posexplode("ls").alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    kind = (
        F.when(F.trim("line") == "", "blank").when(F.col("line").rlike(PAGE_NUMBER), "page_number").when(F.array_contains("headers", F.col("line_no")), "running_header").otherwise("text"))
    text = F.col("kind") == "text"
    t = lines.withColumn("kind", kind).select(
        "draft_block_id", "source_id", "line_no", "line", "kind", F.when(text, F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("words"), F.when(text, F.col("line").rlike(BROKEN)).alias("broken"))
    order = Window.partitionBy("draft_block_id", F.col("kind") == "text").orderBy("line_no")
    t = t.select(
        "*", F.lead("line_no").over(order).alias("next_no"), F.lead("words").over(order).alias("next_words"),
        F.coalesce(F.lag("broken").over(order), F.lit(False)).alias("continues"), F.lag("words").over(order).alias("last_words"))
    last, first = lambda c: F.try_element_at(c, F.lit(-1)), lambda c: F.try_element_at(c, F.lit(1))
    broken = F.col("broken") & F.col("next_words").isNotNull() & (F.size("next_words") > 0) & (F.size("words") > 0)
    skip = F.when(F.col("continues"), 1).otherwise(0)
    whole = F.slice("words", skip + 1, F.greatest(F.lit(0), F.size("words") - skip - F.when(broken, 1).otherwise(0)))
    joined = F.when(broken, F.struct(last("words").alias("head"), first("next_words").alias("tail")))
    return t.select(
        "draft_block_id", "source_id", "line_no", "line", "kind", "next_no", skip.alias("first"), F.when(~F.col("continues"), last("last_words")).alias("w0"), F.when(~broken, first("next_words")).alias("w9"),
        F.when(broken, F.concat(whole, F.array(F.concat(joined["head"], joined["tail"])))).otherwise(whole).alias("e"), joined.alias("joined"))


# Words.


def _occurrences(lines: DataFrame) -> DataFrame:
    """Each word of the text lines with its place and its neighbours; head and tail of a broken one."""
    at = lines.where("kind = 'text'").select("draft_block_id", "line_no", "next_no", "first", "w0", "w9", "e", "joined", F.posexplode("e").alias("pos", "word"))
    broken = F.col("joined").isNotNull() & (F.col("pos") == F.size("e") - 1)
    return at.select(
        "draft_block_id", "line_no", "next_no", (F.col("pos") + F.col("first")).alias("place"), "word", F.when(broken, F.col("joined.head")).alias("head"), F.when(broken, F.col("joined.tail")).alias("tail"),
        F.when(F.col("pos") > 0, F.get("e", F.col("pos") - 1)).otherwise(F.col("w0")).alias("before"), F.coalesce(F.get("e", F.col("pos") + 1), F.col("w9")).alias("after"))


def word_pairs(occurrences: DataFrame) -> DataFrame:
    """a, b, n, n_whole: how often b follows a (null at the start of a block), and how often it is not a broken word."""
    return occurrences.groupBy(F.col("before").alias("a"), F.col("word").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("head").isNull()).alias("n_whole"))


# Misread words.


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For words sorted by skeleton and falling count: the most frequent form that one confusion leads to."""
    now, count = None, {}
    for batch in batches:
        rows = []
        for sk, w, n in zip(*(batch.column(c).to_pylist() for c in ("sk", "word", "n"))):
            if sk != now:
                now, count = sk, {}
            if count:
                forms = [(count[v], v) for v in variants(w) if count.get(v, 0) > max(1, n)]
                if forms:
                    m, f = max(forms)
                    rows.append((w, n, f, m))
            if n > 1:
                count[w] = n
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "form", "m"])


def _odd_token(word: str) -> str | None:
    """A mixture of letters and digits or strokes as it must have been: all digits or all letters."""
    if re.search("[|!]", word):
        word_ = word.replace("|", "l").replace("!", "i")
        return _odd_token(word_) or word_
    if not (re.search(r"\d", word) and re.search(r"[^\W\d_]", word)) or re.fullmatch(r"\d+(?:st|nd|rd|th|[a-zA-Z])?|[A-Z]{1,2}\d+", word):
        return None
    digits = re.sub("[lI]", "1", re.sub("[oO]", "0", word))
    if digits.isdigit():
        return digits
    if sum(c.isalpha() for c in word) < 2 * sum(c.isdigit() for c in word):
        return None
    up = word.upper() == word
    return "".join({"0": "O" if up else "o", "1": "I" if up else "l", "5": "S" if up else "s", "6": "G" if up else "b", "4": "A", "8": "B", "9": "g", "2": "Z" if up else "z"}.get(c, c) for c in word)


class Letters:
    """The letter sequences of many strings as slots of the model's tables: by order (letters before), string and position."""

    def __init__(self, words: list[str]):
        size = np.array([len(w) for w in words], np.int64)
        width = int(size.max(initial=0)) + 1
        text = "".join(w.lower().ljust(width, "$")[:width] for w in words)
        if len(text) != width * len(words):  # a letter whose lower case is two characters
            text = "".join((w if len(w.lower()) != len(w) else w.lower()).ljust(width, "$")[:width] for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.uint64) + np.uint64(1)
        codes = np.concatenate([np.full((len(words), _GRAM - 1), ord("^") + 1, np.uint64), codes], axis=1)
        self.used = np.arange(width) <= size[:, None]
        self.gram, self.start = [], []
        with np.errstate(over="ignore"):
            for k in range(_GRAM):
                h = np.full((len(words), width), k + 1, np.uint64)
                for j in range(k):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, _GRAM - 1 - k + j : _GRAM - 1 - k + j + width]
                self.start.append(self._slot(h))
                self.gram.append(self._slot((h ^ np.uint64(0xABCDEF)) * np.uint64(0x9E3779B97F4A7C15) + codes[:, _GRAM - 1 :]))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return (h >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)


def letter_scores(words: list[str], owners: np.ndarray, strings: list[str], model: np.ndarray) -> np.ndarray:
    """Log-likelihoods of strings by their letters (Witten-Bell), each without what the word of its owner adds to the model.

    model: by slot, how often a sequence occurs, how often its start does, and how many letters follow the start.
    """
    own, other = Letters(words), Letters(strings)
    p = np.full(other.used.shape, 1 / 64)
    for k in range(_GRAM):
        g0, s0 = np.where(own.used, own.gram[k], -1), np.where(own.used, own.start[k], -1)
        same = g0[:, :, None] == g0[:, None, :]
        times = same.sum(2)
        first = ~np.tril(same, -1).any(2)
        sole = first & own.used & (model[0][g0] <= times)
        g, s = other.gram[k], other.start[k]
        starts = s0[owners][:, None, :] == s[:, :, None]
        n = np.maximum(model[0][g] - (g0[owners][:, None, :] == g[:, :, None]).sum(2), 0)
        total = model[1][s] - starts.sum(2)
        kinds = np.maximum(model[2][s] - (starts & sole[owners][:, None, :]).sum(2), 1)
        p = np.where(total > 0, (n + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.where(other.used, np.log(p), 0).sum(1)


def _is_name(w: str) -> bool:
    return w.isalpha() and w[:1].isupper() and w[1:].islower() and len(w) >= MIN_LETTERS


def _by_letters(table):
    """For words without a frequent form: a spelling that the letters of the other words make far likelier."""

    @F.pandas_udf("string")
    def run(words: pd.Series, n: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(words), dtype=object)
        names = [(i, w, sorted(v for v in variants(w) if _is_name(v))) for i, w in enumerate(words) if w and _is_name(w)]
        names = [x for x in names if x[2]]
        for at in range(0, len(names), 256):
            part = names[at : at + 256]
            own = [w for _, w, _ in part]
            owners = np.repeat(np.arange(len(part)), [len(v) for _, _, v in part])
            forms = [v for _, _, vs in part for v in vs]
            base = letter_scores(own, np.arange(len(own)), own, table.value)
            score = np.concatenate([letter_scores(own, owners[k : k + 2048], forms[k : k + 2048], table.value) for k in range(0, len(forms), 2048)])
            best: dict = {}
            for o, f, x in zip(owners.tolist(), forms, score.tolist()):
                best[o] = max(best.get(o, (-np.inf, "")), (x, f))
            for o, (x, f) in best.items():
                i = part[o][0]
                if x - base[o] >= LIKELIER * max(n.iloc[i], 1):
                    out.iloc[i] = f
        return out

    return run


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of sequences and of their starts with counts, summed over the task as far as memory is worth it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> _GRAM_BITS).astype(np.int32)), pa.array((keys & ((1 << _GRAM_BITS) - 1)).astype(np.int32)), pa.array(n)], names=["gram", "start", "n"])

    for batch in batches:
        words = batch.column("word").to_pylist()
        for at in range(0, len(words), 4096):
            x = Letters(words[at : at + 4096])
            keys = np.concatenate([(x.gram[k][x.used] << _GRAM_BITS) | x.start[k][x.used] for k in range(_GRAM)])
            held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield batch_of(*held.pop())
    if held:
        yield batch_of(*merged())


def letter_model(vocabulary: DataFrame) -> np.ndarray:
    """Counts of the letter sequences of distinct words, in tables of fixed size (three of 2^20 numbers, whatever the vocabulary)."""
    grams = vocabulary.select("word").mapInArrow(_count_letters, "gram int, start int, n long").groupBy("gram", "start").agg(F.sum("n").alias("n"))
    entry = lambda kind, at, n: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("at"), n.alias("n"))
    tables = grams.select(F.explode(F.array(entry(0, "gram", F.col("n")), entry(1, "start", F.col("n")), entry(2, "start", F.lit(1).cast("long")))).alias("e"))
    got = tables.select("e.*").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    model = np.zeros((3, 1 << _GRAM_BITS), np.int64)
    model[got.column("kind").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return model


def misread_words(vocabulary: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, form, certain, n, m: what each misread word may have been, and the counts of both; where it is not certain, neighbours decide at each place.

    vocabulary: word, n (as a whole word); pairs: a, b, n.
    """
    worded = vocabulary.where(~F.col("word").rlike("^[0-9]+$")).select(skeleton_column(F.col("word")).alias("sk"), "word", "n")
    chosen = durable(worded.repartition("sk").sortWithinPartitions("sk", F.desc("n"), "word").mapInArrow(_choose, "word string, n long, form string, m long"), "chosen")

    # Neighbours of the word's own: pairs that recur and in which the form is hardly known. Where they make up most of its neighbours, it is a word.
    doubt = chosen.select("word", "form")
    left = pairs.join(doubt, pairs["b"] == doubt["word"]).select("word", "n", F.col("a"), F.col("form").alias("b"))
    right = pairs.join(doubt, pairs["a"] == doubt["word"]).select("word", "n", F.col("form").alias("a"), F.col("b"))
    near = left.unionByName(right).where("a is not null and b is not null")
    near = near.join(pairs.select("a", "b", F.col("n").alias("of_form")), ["a", "b"], "left")
    own = (F.col("n") >= 2) & (SURE_RATIO * F.col("n") > F.coalesce("of_form", F.lit(0)))
    words = near.groupBy("word").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("own"), F.sum("n").alias("all")).where("2 * own > all").select("word", F.lit(True).alias("_own"))
    times = F.greatest("n", F.lit(1))
    rare = (F.col("m") >= SURE_RATIO * times * F.least(times, F.lit(MOST_TIMES))) & (F.length("form") >= MIN_LETTERS) & ~F.col("form").rlike("^[0-9]+$")
    chosen = durable(chosen.join(words, "word", "left").select("word", "form", (rare & F.col("_own").isNull()).alias("certain"), "n", "m"), "forms")

    # What is left: mixtures of letters and digits, and names.
    certain = chosen.where("certain")
    rest = vocabulary.join(certain.select("word"), "word", "left_anti")
    mixed = rest.where(F.col("word").rlike("[|!]|[0-9]") & F.col("word").rlike("\\p{L}|[|!]")).select("word", _arrow("string", _odd_token)("word").alias("form"))
    letters = vocabulary.where(F.col("word").rlike("^[\\p{L}\\p{M}]+$"))
    table = vocabulary.sparkSession.sparkContext.broadcast(letter_model(letters))
    names = rest.where(F.col("word").rlike(f"^\\p{{Lu}}[\\p{{Ll}}\\p{{M}}]{{{MIN_LETTERS - 1},}}$")).select("word", _by_letters(table)("word", "n").alias("form"))
    odd = durable(mixed.unionByName(names).where("form is not null and form != word"), "odd")
    unsure = chosen.where("not certain").join(odd.select("word"), "word", "left_anti")
    return certain.unionByName(odd.select("word", "form", F.lit(True).alias("certain"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))).unionByName(unsure)


def _at_places(marked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places of uncertain words where both neighbours know the form, and (beyond this one place) none knows the word, or one alone does and knows the form as well."""
    n = lambda name: pairs.select("a", "b", F.col("n").alias(name))
    df = marked.join(n("fl").withColumnsRenamed({"a": "before", "b": "form"}), ["before", "form"])
    df = df.join(n("fr").withColumnsRenamed({"a": "form", "b": "after"}), ["form", "after"]).where(F.col("fl") + F.col("fr") >= 4)
    df = df.join(n("wl").withColumnsRenamed({"a": "before", "b": "word"}), ["before", "word"], "left")
    df = df.join(n("wr").withColumnsRenamed({"a": "word", "b": "after"}), ["word", "after"], "left")
    wl, wr = (F.coalesce(c, F.lit(1)) - 1 for c in ("wl", "wr"))
    as_well = lambda form, word: form * F.col("n") >= word * F.col("m")  # noqa: E731 - the form's share of such neighbours is no smaller than the word's
    return df.where(((wl <= 0) & (wr <= 0)) | ((wl <= 0) & as_well(F.col("fr"), wr)) | ((wr <= 0) & as_well(F.col("fl"), wl)))


class ScanRepair:
    """The noise of draft blocks, and their repaired text."""

    def __init__(self, blocks: DataFrame, exclusions: DataFrame, sources: DataFrame | None = None):
        self.lines = durable(classify_lines(blocks, exclusions, sources), "lines")
        words = _occurrences(self.lines)
        self.exclusions = exclusions
        pairs = durable(word_pairs(words), "pairs")
        vocabulary = durable(pairs.groupBy(F.col("b").alias("word")).agg(F.sum("n_whole").alias("n")), "vocabulary")

        forms = misread_words(vocabulary, pairs)
        marked = durable(words.join(forms, "word"), "marked")
        columns = ("draft_block_id", "line_no", "place", "word", "head", "form")
        told = _at_places(marked.where("not certain and head is null"), pairs)
        self.misread = durable(marked.where("certain").select(*columns).unionByName(told.select(*columns)), "misread")

        # Broken words: the joined form, or the form it must have been, is written elsewhere in one piece.
        broken = words.where("head is not null").join(self.misread.where("head is not null").select("draft_block_id", "line_no", "place", "form"), ["draft_block_id", "line_no", "place"], "left")
        broken = broken.withColumn("one", F.coalesce("form", "word")).withColumn("compound", F.concat_ws("-", "head", "tail"))
        for name in ("one", "compound"):
            broken = broken.join(vocabulary.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}")), name, "left")
            broken = broken.join(pairs.select(F.col("a").alias("before"), F.col("b").alias(name), F.col("n_whole").alias(f"p_{name}")), ["before", name], "left")
        got = lambda c: F.coalesce(c, F.lit(0))
        both = F.when(got("p_one") != got("p_compound"), got("p_one") > got("p_compound")).otherwise(got("n_one") >= got("n_compound"))
        is_split = (got("n_one") > 0) & F.when(got("n_compound") > 0, both).otherwise(True)
        self.split = durable(broken.where(is_split).select("draft_block_id", "line_no", "next_no", "place", "word", "head", "tail", "one", "form"), "split")

    def noise(self) -> DataFrame:
        """table_name, record_id, line_no, noise."""
        out = self.lines.where("kind in ('running_header', 'page_number')").select("draft_block_id", "line_no", F.col("kind").alias("noise"))
        out = out.unionByName(self.split.select("draft_block_id", "line_no", F.lit("split_word").alias("noise")))
        out = out.unionByName(self.misread.where("head is null").select("draft_block_id", "line_no", F.lit("misread").alias("noise")))
        # A misread broken word lies on the line of the first differing character.
        same = F.aggregate(F.sequence(F.lit(1), F.length("head")), F.lit(True), lambda ok, i: ok & (F.col("word").substr(i, F.lit(1)) == F.col("form").substr(i, F.lit(1))))
        out = out.unionByName(self.split.where("form is not null").select("draft_block_id", F.when(same, F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), F.lit("misread").alias("noise")))
        wrong = self.exclusions.where("exclusion_id is not null").select("exclusion_id", "reason", _arrow("string", form_of)("source_excerpt").alias("form")).where("form is not null and not (reason <=> form)")
        drafts = out.select(F.lit("draft_text_blocks").alias("table_name"), F.col("draft_block_id").cast("long").alias("record_id"), F.col("line_no").cast("long").alias("line_no"), "noise")
        return drafts.unionByName(wrong.select(F.lit("audit_exclusions").alias("table_name"), F.col("exclusion_id").cast("long").alias("record_id"), F.lit(0).cast("long").alias("line_no"), F.lit("wrong_reason").alias("noise"))).distinct()

    def paragraphs(self) -> DataFrame:
        """draft_block_id and its continuous text."""
        repl = self.misread.where("head is null").groupBy("draft_block_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("place", "form"))).alias("repl"))
        split = self.split.select("draft_block_id", "line_no", "next_no", "head", "tail", "one")
        line = self.lines.where("kind = 'text'").select("draft_block_id", "line_no", "line").join(repl, ["draft_block_id", "line_no"], "left")
        line = line.join(split.select("draft_block_id", "line_no", "head", "one"), ["draft_block_id", "line_no"], "left")
        line = line.join(split.select("draft_block_id", F.col("next_no").alias("line_no"), "tail"), ["draft_block_id", "line_no"], "left")
        # What stands between the words, and the words: each replaced at its own place only.
        gaps, words = F.split("line", WORD), F.regexp_extract_all("line", F.lit(WORD), F.lit(0))
        line = line.withColumns({"gaps": gaps, "words": words})
        fixed = F.transform("words", lambda w, i: F.when(F.col("repl").isNotNull(), F.coalesce(F.try_element_at("repl", i), w)).otherwise(w))
        fixed = F.transform(fixed, lambda w, i: F.when(F.col("tail").isNotNull() & (i == 0), "").when(F.col("one").isNotNull() & (i == F.size("words") - 1), F.col("one")).otherwise(w))
        after = F.transform("gaps", lambda g, i: F.when(F.col("one").isNotNull() & (i == F.size("words")), "").otherwise(g))
        joined = F.array_join(F.zip_with(after, F.concat(fixed, F.array(F.lit(""))), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
        line = line.withColumn("final", F.trim(F.when(F.size("words") > 0, joined).otherwise(F.col("line"))))
        # A hyphen of the word's own joins to the next line without a space.
        glue = F.when(F.col("one").isNull() & F.col("final").rlike("[\\p{L}]-$"), "").otherwise(" ")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.concat("final", glue).alias("t")))), lambda x: x["t"]), "")
        blocks = self.lines.select("draft_block_id").distinct()
        return blocks.join(line.groupBy("draft_block_id").agg(F.trim(text).alias("text")), "draft_block_id", "left").select("draft_block_id", F.regexp_replace(F.coalesce("text", F.lit("")), " ([,.;:])", "$1").alias("text"))
