"""Missing or wrong language labels: the language of each document and paragraph.

Multilingual mixture inference. Character n-grams of folded text (no case, no
accents, so capitals and texts written without accents are no special case)
have a log-likelihood under each language. Paragraphs are the segments; for
each document expectation-maximisation estimates the language proportions from
the segments' likelihoods, over a set of languages that is grown while the gain
in likelihood exceeds a penalty for each further language. The main language
has the largest share of the text; a segment takes the language with the
largest posterior. The same inference over the sentences of a paragraph finds
where its language changes (``switches``).

Likelihoods only compare the languages with each other. Whether a text is in any
of them is told by the share of its n-grams that no sampled text of the language
has: beyond a limit half way between what sampled texts show against the other
half of the sample and all, it is in another language (null). A language without
sampled text can't be chosen.

The n-gram models are fitted here from a bounded sample of labelled documents
(``per_label`` and ``sample_bytes`` for each language, documented and checked); as
labels may be wrong, the fit itself re-assigns the sampled paragraphs by the
models and fits again. All documents are then classified, whole, in one pass
without a shuffle.

Defined results: null or empty text, and text of other scripts, has no language
(null, confidence 0) and yields no segments; paragraphs without letters take the
main language; ties go to the first language in ``LANGUAGES``; very long texts are
processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.batches import by_size
from codicil.session import durable

LANGUAGES = ("eng", "fra", "hau", "yor", "por", "swa", "spa", "deu")
#: Notations of language labels (ISO 639-1, 639-2/B and 639-3 codes, names in English and in the language).
NOTATIONS = {
    "eng": ("en", "eng", "english"), "fra": ("fr", "fra", "fre", "french", "francais"), "hau": ("ha", "hau", "hausa"),
    "yor": ("yo", "yor", "yoruba"), "por": ("pt", "por", "portuguese", "portugues"), "swa": ("sw", "swa", "swh", "swahili", "kiswahili"),
    "spa": ("es", "spa", "spanish", "espanol", "castellano", "castilian"), "deu": ("de", "deu", "ger", "german", "deutsch"),
}
_BY_NOTATION = {n: lang for lang, names in NOTATIONS.items() for n in names}

BITS, ORDERS = 16, (3, 4)
#: Neighbouring n-grams overlap, so a log-likelihood counts for this share of itself.
TEMPER = 0.25
#: Log-likelihoods of an n-gram differ by no more than this between languages, so that no single one decides.
CLIP = 5.0
#: A further language must raise the (tempered) log-likelihood by this many units for each doubling of the n-grams.
PENALTY = 1.0
#: A paragraph is looked through for a change of language in sentences of so many letters at least.
SENTENCE, SENTENCE_LETTERS = re.compile(r"(?<=[.!?;:])\s+"), 40
#: n-grams from which a piece may be said to be in none of the languages.
ENOUGH = 20
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LETTERS = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 39 if c == 39 else 32 for c in range(256))


def label_language(label: str | None) -> str | None:
    """The language a label names, in whatever notation; "?" where it names one that is none of ours; null where it names none."""
    if label is None:
        return None
    words = re.findall(r"[a-z]+", unicodedata.normalize("NFKD", label).encode("ascii", "ignore").decode().lower())
    if not words or words[0] in ("und", "unknown", "zxx", "mul", "mis", "none", "null", "na", "n", "xx"):
        return None
    return _BY_NOTATION.get(words[0], "?")


def fold(text: str) -> bytes:
    """Lower-case ASCII letters; everything else is a space."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
    return text.encode("ascii", "ignore").translate(_LETTERS)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of each order that start at each position; 0 where there is none worth counting."""
    x = data.astype(np.uint32) - 31
    out = []
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.uint32))
            continue
        h, letters = np.zeros(m, np.uint32), np.zeros(m, np.int8)
        for k in range(n):
            part = x[k : k + m]
            h = h * np.uint32(0x9E3779B1) + part
            letters += part > 8
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        out.append(np.where(letters >= n - 1, h | np.uint32(1), 0))  # at most one space within, so names across blanks count little
    return out


class Models(NamedTuple):
    """tables: clipped log-likelihoods by order, hash and language; known: by hash of the longest order and language, whether a sampled text has it;
    limits: share of unknown n-grams beyond which a text is in another language; present: languages with sampled text."""

    tables: np.ndarray
    known: np.ndarray
    limits: np.ndarray
    present: np.ndarray


def _starts(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces in one array, three characters apart, and where each begins."""
    data = np.frombuffer(b" \x00 ".join(pieces), np.uint8)  # the zero byte is no letter, so n-grams across pieces have two non-letters
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.where(data == 0, 32, data), np.concatenate([[0], np.cumsum(lengths + 3)[:-1] - 1])  # the blank before a piece is its first character


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows by piece."""
    if not len(rows):
        return np.zeros((len(starts), *rows.shape[1:]))
    at = np.minimum(starts, len(rows) - 1)
    out = np.add.reduceat(rows, at, axis=0)
    out[np.concatenate([np.diff(at) == 0, [False]]) | (starts >= len(rows))] = 0  # reduceat gives one element, not none, for these
    return out


def segment_scores(pieces: list[bytes], models: Models) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each piece: summed log-likelihoods by language, and the number of n-grams; the longest n-grams for ``unknown``."""
    data, starts = _starts(pieces)
    scores, counts = np.zeros((len(pieces), len(LANGUAGES))), np.zeros(len(pieces))
    for k, h in enumerate(grams(data)):
        scores += _sums(models.tables[k][h], starts)
        counts += _sums((h > 0).astype(np.float64), starts)
    scores[:, ~models.present] = -1e9
    return scores * TEMPER, counts * TEMPER, (h, starts)


def unknown(longest: tuple[np.ndarray, np.ndarray], of: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece how many of its longest n-grams its language ``of`` hasn't, and how many there are."""
    h, starts = longest
    lang = np.repeat(of, np.diff(np.append(starts, max(len(h), starts[-1] if len(starts) else 0))))[: len(h)]
    used = h > 0
    new = used & ~known[h, lang]
    return _sums(new.astype(np.float64), starts), _sums(used.astype(np.float64), starts)


def fit(texts: list[str], labels: list[str], rounds: int = 3) -> Models:
    """Models fitted with re-assignment of paragraphs."""
    pieces, owner, half = [], [], []
    for i, (text, label) in enumerate(zip(texts, labels)):
        for p in PARAGRAPH.split(text):
            pieces.append(fold(p))
            owner.append(LANGUAGES.index(label))
            half.append(i % 2)
    owner, half = np.array(owner, np.int64), np.array(half)
    hashed = [grams(np.frombuffer(p, np.uint8)) for p in pieces]

    def counts_of(k: int, which: np.ndarray) -> np.ndarray:
        count = np.zeros((1 << BITS, len(LANGUAGES)))
        for lang in range(len(LANGUAGES)):
            own = [hashed[i][k] for i in np.flatnonzero(which & (owner == lang))]
            if own:
                count[:, lang] = np.bincount(np.concatenate(own), minlength=1 << BITS)
        count[0] = 0
        return count

    everything = np.ones(len(pieces), bool)
    models = None
    for _ in range(rounds):
        tables = np.zeros((len(ORDERS), 1 << BITS, len(LANGUAGES)), np.float32)
        present = np.zeros(len(LANGUAGES), bool)
        for k in range(len(ORDERS)):
            count = counts_of(k, everything)
            present |= count.sum(0) > 0
            seen = count.sum(1) > 0
            p = np.log((count + 0.5) / (count.sum(0) + 0.5 * max(1, seen.sum())))
            p -= p.max(1, keepdims=True)
            p = np.maximum(p, -CLIP)
            p[~seen] = 0
            p[0] = 0
            tables[k] = p
        known = count > 0
        models = Models(tables, known, np.ones(len(LANGUAGES)), present)
        if pieces:
            scores, n, longest = segment_scores(pieces, models)
            owner = np.where(n > 5, scores.argmax(1), owner)
    # How much of a text its own language may not know: each half of the sample against the other.
    rates = []
    for side in (0, 1):
        if (half == side).any():
            new, n = unknown(tuple(x for x in (longest[0], longest[1])), owner, counts_of(len(ORDERS) - 1, half != side) > 0)
            ok = (half == side) & (n >= ENOUGH)
            rates.append(np.stack([owner[ok], new[ok] / n[ok]], 1))
    rates = np.concatenate(rates) if rates else np.zeros((0, 2))
    usual = lambda x: float(np.quantile(x, 0.99)) if len(x) >= 20 else 1 / 3
    limits = np.array([(1 + usual(rates[rates[:, 0] == lang, 1])) / 2 for lang in range(len(LANGUAGES))])
    return models._replace(limits=limits)


def infer(scores: np.ndarray, counts: np.ndarray, size: np.ndarray, doc: np.ndarray, n_docs: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by document and posteriors by segment.

    Set selection: start from the best single language, add the language with
    the largest gain while it exceeds the penalty. EM then runs over the set;
    a segment counts with its number of characters (``size``).
    """
    n_lang = scores.shape[1]

    def by_doc(x):
        return np.stack([np.bincount(doc, x[:, j], n_docs) for j in range(x.shape[1])], 1)

    total = np.bincount(doc, counts, n_docs)
    first = by_doc(scores).argmax(1)
    allowed = np.zeros((n_docs, n_lang), bool)
    allowed[np.arange(n_docs), first] = True
    penalty = PENALTY * np.log2(2 + total)
    for _ in range(n_lang - 1):
        now = np.where(allowed[doc], scores, -np.inf).max(1)
        gain = by_doc(np.maximum(0, scores - now[:, None]))
        gain[allowed] = -1
        best = gain.argmax(1)
        add = gain[np.arange(n_docs), best] > penalty
        if not add.any():
            break
        allowed[np.flatnonzero(add), best[add]] = True
    share = allowed / allowed.sum(1, keepdims=True)
    post = np.zeros_like(scores)
    weight = np.where(counts > 0, size, 1e-9)
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            logit = scores + np.log(share)[doc]
        logit -= logit.max(1, keepdims=True)
        post = np.exp(logit)
        post /= post.sum(1, keepdims=True)
        share = by_doc(post * weight[:, None])
        share = np.where(allowed, share + 1e-6, 0)
        share /= share.sum(1, keepdims=True)
    return share, post


OUTPUT = (
    "main string, main_confidence double, proportions map<string,double>, segments array<struct<segment_no:int,lang:string,confidence:double,n_chars:int>>, "
    "switches array<struct<segment_no:int,part_no:int,start:int,end:int,lang:string,confidence:double>>")
_SEGMENTS = pa.list_(pa.struct([("segment_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_chars", pa.int32())]))
_SWITCHES = pa.list_(pa.struct([("segment_no", pa.int32()), ("part_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def sentences(paragraph: str) -> list[tuple[int, int]]:
    """Ranges of sentences, short ones joined to the next."""
    cuts = [0, *(m.end() for m in SENTENCE.finditer(paragraph)), len(paragraph)]
    out, start = [], 0
    for end in cuts[1:]:
        if end - start >= SENTENCE_LETTERS or end == len(paragraph):
            if out and end - start < SENTENCE_LETTERS:
                out[-1] = (out[-1][0], end)
            elif end > start:
                out.append((start, end))
            start = end
    return out


def changes(paragraphs: list[str], models: Models) -> list[list[tuple[int, int, str, float]]]:
    """For each paragraph the ranges of its languages with a confidence, where it has more than one."""
    ranges = [sentences(p) for p in paragraphs]
    of = [i for i, r in enumerate(ranges) for _ in r]
    out: list[list] = [[] for _ in paragraphs]
    if not of:
        return out
    pieces = [fold(paragraphs[i][a:b]) for i, r in enumerate(ranges) for a, b in r]
    scores, counts, _ = segment_scores(pieces, models)
    _, post = infer(scores, counts, np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(of), len(paragraphs))
    places = [ab for r in ranges for ab in r]
    for i, (a, b), n, p in zip(of, places, counts, post):
        lang = LANGUAGES[int(p.argmax())] if n > 0 else None
        parts = out[i]
        if parts and (lang is None or parts[-1][2] in (lang, None)):
            last = parts[-1]
            parts[-1] = (last[0], b, last[2] or lang, min(last[3], float(p.max())) if lang else last[3])
        else:
            parts.append((a, b, lang, float(p.max()) if lang else 1.0))
    return [parts if len(parts) > 1 else [] for parts in out]


def _classify(column: str, shared, keep: list[str], with_switches: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: Models = shared.value
        for big in batches:
            for batch in by_size(big, column):
                texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
                paragraphs, doc, number = [], [], []
                for i, text in enumerate(texts):
                    for k, p in enumerate(PARAGRAPH.split(text) if text else (), 1):
                        paragraphs.append(p)
                        doc.append(i)
                        number.append(k)
                results: list[dict] = [{"main": None, "main_confidence": 0.0, "proportions": [], "segments": [], "switches": []} for _ in texts]
                if paragraphs:
                    pieces = [fold(p) for p in paragraphs]
                    doc_of, size = np.array(doc), np.fromiter(map(len, pieces), np.int64, len(pieces))
                    scores, counts, longest = segment_scores(pieces, models)
                    share, post = infer(scores, counts, size, doc_of, len(texts))
                    has = np.bincount(doc_of, counts, len(texts)) > 0
                    main = share.argmax(1)
                    best = np.where(counts > 0, post.argmax(1), main[doc_of])
                    sure = np.where(counts > 0, post.max(1), share.max(1)[doc_of])
                    # Texts that their likeliest language hardly knows are in none of the languages.
                    new, n = unknown(longest, best, models.known)
                    strange = (n >= ENOUGH) & (new > models.limits[best] * n)
                    own = best == main[doc_of]
                    new_of, n_of = (np.bincount(doc_of, x * own, len(texts)) for x in (new, n))
                    other = (n_of >= ENOUGH) & (new_of > models.limits[main] * n_of)
                    # How likely the main language is, if the text is in one: the posterior of the whole text.
                    total = np.stack([np.bincount(doc_of, scores[:, j], len(texts)) for j in range(len(LANGUAGES))], 1)
                    odds = np.exp(np.clip(total - total[np.arange(len(texts)), main][:, None], -700, 30)).sum(1)
                    for i in np.flatnonzero(has):
                        kept = np.flatnonzero(share[i] > 1e-4)
                        results[i]["proportions"] = [(LANGUAGES[j], float(share[i, j])) for j in kept]
                        if not other[i]:
                            results[i] |= {"main": LANGUAGES[main[i]], "main_confidence": float(max(1 / odds[i], share[i, main[i]] if len(kept) > 1 else 0))}
                    for j, (i, k) in enumerate(zip(doc, number)):
                        if has[i]:
                            results[i]["segments"].append({"segment_no": k, "lang": None if strange[j] else LANGUAGES[best[j]], "confidence": 0.0 if strange[j] else float(sure[j]), "n_chars": int(size[j])})
                    if with_switches:
                        for i, k, parts in zip(doc, number, changes(paragraphs, models)):
                            results[i]["switches"] += [{"segment_no": k, "part_no": m, "start": a, "end": b, "lang": lang, "confidence": c} for m, (a, b, lang, c) in enumerate(parts, 1)]
                arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                arrays += [pa.array([r["main"] for r in results], pa.string()), pa.array([r["main_confidence"] for r in results], pa.float64())]
                arrays += [pa.array([r["proportions"] for r in results], pa.map_(pa.string(), pa.float64()))]
                arrays += [pa.array([r["segments"] for r in results], _SEGMENTS), pa.array([r["switches"] for r in results], _SWITCHES)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "main", "main_confidence", "proportions", "segments", "switches"])

    return run


def sample_labelled(df: DataFrame, text: str, label: str, per_label: int, sample_bytes: int = 4_000_000) -> tuple[list[str], list[str]]:
    """At most ``per_label`` distinct documents and ``sample_bytes`` of text for each language, by hash of the text, and their labels.

    A language whose share of the hashes has no document (few texts, much copied) is sampled from all of its documents.
    """
    names = _label_names(df, label)
    labelled = df.join(names, df[label] == F.col("_label")).select(F.col(text).alias("t"), "_lang", "_n", F.xxhash64(text).alias("h")).where(F.length("t") > 0)
    labelled = labelled.where(F.octet_length("t") <= sample_bytes)
    order = Window.partitionBy("_lang").orderBy("h", "t")

    def take(rows: DataFrame) -> list:
        # Copies of one text count once, so a text with a third of all rows neither floods the sample nor a task.
        rows = rows.dropDuplicates(["_lang", "h"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label)
        rows = rows.withColumn("size", F.sum(F.octet_length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.where((F.col("size") <= sample_bytes) | (F.col("r") == 1)).select("t", "_lang").collect()

    some = take(labelled.where(F.pmod("h", F.lit(1 << 40)) < F.least(F.lit(1.0), 2.0 * per_label / F.col("_n")) * (1 << 40)))
    missing = {r["_lang"] for r in names.select("_lang").distinct().collect()} - {r["_lang"] for r in some}
    if missing:
        some += take(labelled.where(F.col("_lang").isin(*missing)))
    if not some:
        raise ValueError("no labelled documents to fit on")
    return [r["t"] for r in some], [r["_lang"] for r in some]


def _label_names(df: DataFrame, label: str) -> DataFrame:
    """_label, _lang, _n: the notations in use that name one of the languages, and the number of rows of each language.

    Notations are read where they are, each once; a column of free text may have any number of them.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_rows"))
    names = durable(counts.select("_label", "_rows", label_column("_label").alias("_lang")).where(F.col("_lang").isin(*LANGUAGES)), "labels")
    per = names.groupBy("_lang").agg(F.sum("_rows").alias("_n"))  # eight rows at most
    return names.join(F.broadcast(per), "_lang").select("_label", "_lang", "_n")


def identify(df: DataFrame, text: str, label: str, keep: list[str], per_label: int = 300, sample_bytes: int = 4_000_000, switches: bool = False) -> DataFrame:
    """``keep`` columns with main language, confidence, proportions and segments of each row; with ``switches``, also the changes of language within paragraphs."""
    models = fit(*sample_labelled(df, text, label, per_label, sample_bytes))
    shared = df.sparkSession.sparkContext.broadcast(models)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", " + OUTPUT
    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(_classify(text, shared, keep, switches), schema)


def label_column(label: str):
    """``label_language`` over a column, by Arrow; null where the label names no language."""
    @F.pandas_udf("string")
    def parse(s: pd.Series) -> pd.Series:
        memo = {x: label_language(x) for x in s.dropna().unique()}
        return s.map(memo).astype(object).where(s.notna(), None)

    return parse(label)
