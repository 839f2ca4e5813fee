"""Evaluation texts leaking into training text.

Windows of the items and of the documents are compared. A window is as long as
the shortest passage that counts (``width``), so that parts of an item are found
at any place of it; or, with ``item_sized``, as long as the item itself (rounded
down to a step of a ladder, which bounds the number of widths), so that an item
is found as a whole with words changed in it.

1. Windows get a 64-bit SimHash fingerprint. A multi-index over ``radius`` + 2
   blocks of the fingerprint finds all pairs of fingerprints within ``radius``:
   at least two blocks of such a pair agree, so every pair of blocks is looked
   up.
2. Windows that are as similar as asked for may lie further apart than any
   radius that can be indexed. Where that is wanted (all but ``exact``),
   candidates come also from an index of the items' word shingles: two windows of
   n shingles with the similarity share at least m of them, so of any n - m + 1
   shingles of a document's window (the rarest are taken) one is in the item's.
   This leaves no pair out.
3. Candidates are verified by the exact similarity of their weighted word
   shingles, and with ``exact`` by the words themselves.

A window of a document with fewer than m shingles that occur anywhere in the
items can't reach the similarity; only the others, few in most texts, get a
fingerprint. Equal windows of the items are one class with a list of owners, and
equal windows of a group of documents are looked up once, so repeated passages
cost no pairs.

The items are the stated query set. Their words are hashed by the executors and
streamed to the driver in blocks of at most ``block_windows`` windows (a longer
item is cut into overlapping pieces); each block is sent to the executors once.
Documents are read, split into words and hashed in one pass; a task goes through
the blocks one after another for each group of documents, with one block in
memory, and there is no shuffle. Documents are read whole.

Words are runs of letters and digits after NFKC and case folding; with
``glyphs``, characters of scripts without blanks are words of their own.

Defined results: null or empty texts, and items shorter than a window (with
``item_sized``: than a shingle), have no windows and match nothing; repeated
documents each give their rows; equal items under several ids are all reported;
ids may have any type; other columns of both tables don't matter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codicil.llm.batches import by_size

WORD = re.compile(r"[^\W_]+")
#: Scripts without blanks: kana, ideographs, Thai, Lao, Khmer, Burmese.
_GLYPH = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f"
GLYPH_WORD = re.compile(f"[{_GLYPH}]|[^\\W_{_GLYPH}]+")
MAX_RADIUS = 6
#: Widths of item-sized windows: odd, so that no bit of a fingerprint is a tie.
LADDER = (5, 7, 9, 11, 13, 17, 21, 25, 33, 41, 49, 65, 81, 97, 127)
_FILTER_BITS = 22
#: Words of documents that a task takes through all blocks at a time; starts of windows looked at, and candidates verified at a time.
_GROUP_WORDS, _STEP, _PLACES = 1_000_000, 500_000, 20_000


def words(text: str, glyphs: bool = False) -> list[str]:
    low = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    return (GLYPH_WORD if glyphs else WORD).findall(low)


class WordHashes(dict):
    """64-bit hash of each word, kept while a task runs (words repeat; the dictionary is cleared when large)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


_SHIFTS = np.arange(64, dtype=np.uint64)


def simhash(windows: np.ndarray) -> np.ndarray:
    """Fingerprints of windows (rows of an odd number of hashes): a bit is set where more than half of the hashes have it."""
    out = np.zeros(len(windows), np.uint64)
    half = windows.shape[1] // 2 if windows.ndim == 2 else 0
    for at in range(0, len(windows), 4096):
        part = windows[at : at + 4096]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(*part.shape, 8), axis=2, bitorder="little")
        set_ = bits.sum(1, dtype=np.uint16) > half
        out[at : at + 4096] = (set_.astype(np.uint64) << _SHIFTS).sum(1, dtype=np.uint64)
    return out


def block_pairs(radius: int) -> list[tuple[np.uint64, np.uint64, np.uint64, np.uint64]]:
    """For each pair of the ``radius`` + 2 blocks of a fingerprint: shift and mask of both."""
    m = radius + 2
    edges = [64 * i // m for i in range(m + 1)]
    block = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return [(*x, *y) for x, y in combinations(block, 2)]


def _key(f: np.ndarray, pair) -> np.ndarray:
    a, am, b, bm = pair
    return ((f >> a) & am) | (((f >> b) & bm) << np.uint64(32))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words along the last axis."""
    n = h.shape[-1] - size + 1
    if n <= 0:
        return np.zeros((*h.shape[:-1], 0), np.uint64)
    out, mixed = np.zeros((*h.shape[:-1], n), np.uint64), _mix(h)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mixed[..., k : k + n]
    return out


def shared_shingles(similarity: float, n: int) -> int:
    """How many of their ``n`` shingles two windows of at least this similarity share."""
    return next(m for m in range(n + 1) if m / (2 * n - m) >= similarity)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges, with the range each belongs to."""
    row = np.repeat(np.arange(len(first)), count)
    return np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row], row


class WindowIndex:
    """The windows of one width of a block of items: classes of equal windows, their owners, fingerprints, and the places of each shingle."""

    def __init__(self, width: int, shingle: int, radius: int, items: list[tuple[int, np.ndarray]]):
        self.width, self.shingle, self.radius = width, shingle, radius
        parts, owner, start, at = [], [], [], 0
        for item, h in items:
            n = len(h) - width + 1
            if n > 0:
                parts.append(h)
                owner.append(np.full(n, item, np.int64))
                start.append(at + np.arange(n))
                at += len(h)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.words, owner, start = cat(parts, np.uint64), cat(owner, np.int64), cat(start, np.int64)
        prints = simhash(_mix(self.words)[start[:, None] + np.arange(width)]) if len(start) else np.zeros(0, np.uint64)
        whole = shingles(self.words, width)[start]
        order = np.lexsort((prints, whole))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (prints[order][1:] != prints[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        self.start, self.prints = start[order[new]], prints[order[new]]
        pairs = np.unique(np.stack([of, owner], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.owner = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))
        self.class_at = np.full(len(self.words), -1, np.int64)  # the class of the window that starts at a place
        self.class_at[start] = of
        self._tables()

    def __getstate__(self) -> dict:
        """What is sent; the tables are made again where they are used."""
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "known", "first", "places")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._tables()

    def _tables(self) -> None:
        self.tables = []
        for pair in block_pairs(self.radius):
            key = _key(self.prints, pair)
            order = np.argsort(key, kind="stable")
            self.tables.append((pair, key[order], order))
        # Places of shingles within windows: an item's last places belong to the window that ends there.
        inside = np.zeros(len(self.words) + 1, np.int64)
        starts = np.flatnonzero(self.class_at >= 0)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + self.width - self.shingle + 1, -1)
        places = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        at = shingles(self.words, self.shingle)[places] if len(places) else np.zeros(0, np.uint64)
        order = np.argsort(at, kind="stable")
        self.places = places[order]
        self.known, first = np.unique(at[order], return_index=True)
        self.first = np.append(first, len(places))

    def lookup(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the positions ``at`` hold a shingle of this index, how many places have it, and the first of them."""
        k = np.searchsorted(self.known, s[at])
        k[k == len(self.known)] = 0
        hit = self.known[k] == s[at]
        k = k[hit]
        return at[hit], self.first[k + 1] - self.first[k], self.first[k]

    def near(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (row, class) pairs of fingerprints within the radius, in parts; a pair may come more than once."""
        for pair, keys, order in self.tables:
            key = _key(prints, pair)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            some = np.flatnonzero(hi > lo)
            ends = np.cumsum(hi[some] - lo[some])
            cuts = np.searchsorted(ends, np.arange(_PLACES, (int(ends[-1]) if len(ends) else 0) + 1, _PLACES)) if len(ends) else []
            for part in np.split(some, np.unique(cuts)) if len(some) else []:
                at, row = _ranges(lo[part], hi[part] - lo[part])
                w, c = part[row], order[at]
                close = np.bitwise_count(prints[w] ^ self.prints[c]) <= self.radius
                yield w[close], c[close]

    def sharing(self, w: np.ndarray, hits: np.ndarray, count: np.ndarray, first: np.ndarray, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``w``, class) pairs, in parts, among them all that share ``need`` shingles; ``w``: starts of windows with as many known shingles."""
        n = self.width - self.shingle + 1
        rows = np.arange(len(w))
        for part in np.array_split(rows, len(w) * n // _PLACES + 1):
            q = w[part][:, None] + np.arange(n)
            k = np.minimum(np.searchsorted(hits, q), len(hits) - 1)
            places = np.where(hits[k] == q, count[k], 0)
            # Known or not, any n - need + 1 shingles will do: those with the fewest places.
            rare = np.argsort(places, axis=1, kind="stable")[:, : n - need + 1]
            places, k = np.take_along_axis(places, rare, 1).ravel(), np.take_along_axis(k, rare, 1).ravel()
            of, ends = np.repeat(part, n - need + 1), np.cumsum(places)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, _PLACES):
                x = np.arange(lo, min(lo + _PLACES, ends[-1]))
                row = np.searchsorted(ends, x, "right")
                place = self.places[first[k[row]] + x - (ends[row] - places[row])]
                start = place[:, None] - np.arange(n)
                c = np.where(start >= 0, self.class_at[start], -1)
                keep = c >= 0
                yield np.repeat(of[row], n).reshape(-1, n)[keep], c[keep]

    def matches(self, flat: np.ndarray, s: np.ndarray, at: np.ndarray, inside: np.ndarray, similarity: float, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, class, similarity) of windows of a text; ``s``: its shingles, ``at``: where any of the items' may be, ``inside``: for each start how many words follow in its document."""
        n = self.width - self.shingle + 1
        need = max(1, shared_shingles(similarity, n))
        if not len(self.start) or len(s) < n or len(at) < need:
            return
        hits, count, first = self.lookup(s, at)
        if len(hits) < need:
            return
        # Windows whose first known shingle is hits[i] and that reach the one ``need`` - 1 further on.
        i = np.arange(len(hits) - need + 1)
        low = np.maximum(np.concatenate([[-1], hits[:-1]])[i] + 1, np.maximum(hits[i + need - 1] - n + 1, 0))
        w, _ = _ranges(low, np.maximum(np.minimum(hits[i], len(s) - n) - low + 1, 0))
        w = w[inside[w] >= self.width]
        if not len(w):
            return
        span = np.arange(self.width)
        prints = simhash(_mix(flat)[w[:, None] + span])
        whole = np.zeros(len(w), np.uint64)
        with np.errstate(over="ignore"):  # equal windows have equal shingles
            for k in range(n):
                whole = whole * np.uint64(0xD6E8FEB86659FD93) + s[w + k]
        _, one, same = np.unique(np.stack([whole, prints], 1), axis=0, return_index=True, return_inverse=True)
        by_class = np.argsort(same.ravel(), kind="stable")
        members = np.searchsorted(same.ravel()[by_class], np.arange(len(one) + 1))
        starts = w[one]
        seen = np.zeros(0, np.int64)
        parts = self.near(prints[one]) if exact else (p for source in (self.near(prints[one]), self.sharing(starts, hits, count, first, need)) for p in source)
        step = max(1, 1_000_000 // n)
        for r, c in parts:
            pair = np.setdiff1d(r * len(self.start) + c, seen)
            seen = np.union1d(seen, pair)
            for k in range(0, len(pair), step):
                rr, cc = pair[k : k + step] // len(self.start), pair[k : k + step] % len(self.start)
                a, b = flat[starts[rr][:, None] + span], self.words[self.start[cc][:, None] + span]
                sim = shingle_similarity(a, b, self.shingle)
                keep = sim >= similarity
                if exact:
                    keep &= (a == b).all(1)
                rr, cc, sim = rr[keep], cc[keep], sim[keep]
                x, row = _ranges(members[rr], members[rr + 1] - members[rr])
                yield w[by_class[x]], cc[row], sim[row]


def shingle_similarity(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of the word shingles of windows, row by row.

    A shingle weighs as many times as it occurs in its window (multisets), so
    equal windows have 1 and a window that repeats itself is not overrated.
    """
    if not len(a):
        return np.zeros(0)

    sa, sb = shingles(a, size), shingles(b, size)
    n = sa.shape[1]
    # The occurrence number of each shingle in its window makes the multiset a set; in the two sets, sorted together, a shared one stands twice.
    place = np.arange(n)

    def numbered(x: np.ndarray) -> np.ndarray:
        x = np.sort(x, axis=1)
        new = np.ones(x.shape, bool)
        new[:, 1:] = x[:, 1:] != x[:, :-1]
        nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
        with np.errstate(over="ignore"):
            return x + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    together = np.sort(np.concatenate([numbered(sa), numbered(sb)], axis=1), axis=1)
    both = (together[:, 1:] == together[:, :-1]).sum(1)
    return both / (2 * n - both)


class Block:
    """A bounded part of the items: their ids, and an index for each width of window."""

    def __init__(self, items: list[tuple[object, np.ndarray, int]], shingle: int, radius: int):
        ids = {}
        by_width: dict[int, list] = {}
        for item, h, width in items:
            by_width.setdefault(width, []).append((ids.setdefault(item, len(ids)), h))
        self.ids = list(ids)
        self.indexes = [WindowIndex(w, shingle, radius, rows) for w, rows in sorted(by_width.items())]
        self._filter()

    def _filter(self) -> None:
        """One bit for each shingle of any index, so that a text is looked through once for all widths."""
        self.any = np.zeros(1 << _FILTER_BITS, bool)
        for ix in self.indexes:
            self.any[ix.known >> np.uint64(64 - _FILTER_BITS)] = True

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "indexes": self.indexes}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._filter()


def _match(id_column: str, text_column: str, blocks: list, similarity: float, shingle: int, exact: bool, glyphs: bool, item_type: pa.DataType):
    def results(ids: list, docs: list[np.ndarray], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        size = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), size)
        inside = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        s = shingles(flat, shingle)
        found: dict = {}
        for b in blocks:
            block: Block = b.value
            hits = np.flatnonzero(block.any[s >> np.uint64(64 - _FILTER_BITS)])
            for ix in block.indexes:
                for at in range(0, max(0, len(s)), _STEP):
                    end = at + _STEP + ix.width - 1
                    lo, hi = np.searchsorted(hits, [at, end - shingle + 1])
                    for w, c, sim in ix.matches(flat[at:end], s[at : end - shingle + 1], hits[lo:hi] - at, inside[at:end], similarity, exact):
                        x, row = _ranges(ix.owned[c], ix.owned[c + 1] - ix.owned[c])
                        rows = np.stack([doc[w[row] + at], ix.owner[x], w[row] + at], 1)
                        first = np.lexsort((-sim[row], rows[:, 2], rows[:, 1], rows[:, 0]))
                        for (d, o, pos), v in zip(rows[first].tolist(), sim[row][first].tolist()):
                            f = found.setdefault((d, block.ids[o]), [set(), 0.0])
                            f[0].add(pos)
                            f[1] = max(f[1], v)
            if len(blocks) > 1:
                b.__dict__.pop("_value", None)  # one block in memory at a time
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _ in found], id_type), pa.array([m for _, m in found], item_type),
                 pa.array([len(x[0]) for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.float64())],
                names=[id_column, "item_id", "n_windows", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, docs, n, kind = WordHashes(), [], [], 0, None
        for big in batches:
            for batch in by_size(big, text_column):
                kind = batch.schema.field(id_column).type
                for i, t in zip(batch.column(batch.schema.get_field_index(id_column)).to_pylist(), batch.column(batch.schema.get_field_index(text_column)).to_pylist()):
                    h = hashes.of(words(t, glyphs)) if t else ()
                    if len(h) >= shingle:
                        ids.append(i)
                        docs.append(h)
                        n += len(h)
                        if n >= _GROUP_WORDS:
                            yield from results(ids, docs, kind)
                            ids, docs, n = [], [], 0
        if docs:
            yield from results(ids, docs, kind)

    return run


def _item_words(id_column: str, text_column: str, glyphs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            ids = batch.column(batch.schema.get_field_index(id_column))
            yield pa.RecordBatch.from_arrays([ids, pa.array([hashes.of(words(t, glyphs)).tobytes() for t in texts], pa.binary())], names=[id_column, "_words"])

    return run


def item_blocks(items: DataFrame, item_id: str, text: str, width: int, shingle: int, radius: int, item_sized: bool, block_windows: int, glyphs: bool) -> Iterator[Block]:
    """The items' hashed words, streamed to the driver, in blocks of a bounded number of windows."""
    block, n = [], 0
    own = items.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull())
    hashed = own.mapInArrow(_item_words(item_id, text, glyphs), f"`{item_id}` {dict(items.dtypes)[item_id]}, _words binary").distinct()
    for item, raw in hashed.toLocalIterator(prefetchPartitions=True):
        h = np.frombuffer(raw, np.uint64)
        w = max((x for x in LADDER if x <= len(h) and x >= shingle), default=0) if item_sized else width
        if not w or len(h) < w:
            continue
        for at in range(0, len(h) - w + 1, block_windows):
            piece = h[at : at + block_windows + w - 1]
            if block and n + len(piece) - w + 1 > block_windows:
                yield Block(block, shingle, radius)
                block, n = [], 0
            block.append((item, piece, w))
            n += len(piece) - w + 1
    if block:
        yield Block(block, shingle, radius)


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    width: int = 13, radius: int = 2, similarity: float = 0.8, shingle: int = 5, exact: bool = False, item_sized: bool = False, block_windows: int = 400_000, glyphs: bool = False,
) -> DataFrame:
    """doc_id, item_id, number of matching windows and best similarity, of all pairs with a match.

    ``radius`` 0 to 6 between fingerprints; ``similarity`` of the weighted
    ``shingle``-word shingles of two windows, whatever their fingerprints;
    ``exact``: the same words in order, for which fingerprints suffice;
    ``item_sized``: windows as long as their item, instead of ``width``.
    """
    if not 0 <= radius <= MAX_RADIUS or not 1 <= width <= 127 or width % 2 == 0 or not 1 <= shingle <= width or not 0 < similarity <= 1 or block_windows < 1:
        raise ValueError("radius 0 to 6, odd width up to 127, shingle up to the width, similarity above 0 and up to 1")
    if doc_id in ("item_id", "n_windows", "similarity"):
        raise ValueError(f"the column {doc_id} of the documents has the name of a result; rename it")
    spark = docs.sparkSession
    item_type = next(f.dataType for f in items.schema if f.name == item_id)
    schema = f"`{doc_id}` {dict(docs.dtypes)[doc_id]}, item_id {item_type.simpleString()}, n_windows long, similarity double"
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item_id, item_text, width, shingle, radius, item_sized, block_windows, glyphs)]
    if not blocks:
        return spark.createDataFrame([], schema)
    return docs.select(doc_id, text).mapInArrow(_match(doc_id, text, blocks, similarity, shingle, exact, glyphs, to_arrow_type(item_type)), schema)
