import random
from collections import Counter

import numpy as np
import pytest

from codicil.llm.leakage import LADDER, WindowIndex, WordHashes, leaked_items, shingle_similarity, simhash, words


def test_simhash_against_counting():
    h = np.random.default_rng(1).integers(0, 2**63, 140, dtype=np.uint64)
    for width in (1, 3, 13, 31, 127):
        want = [sum(1 << b for b in range(64) if sum((int(x) >> b) & 1 for x in h[k:k + width]) > width // 2) for k in range(len(h) - width + 1)]
        assert simhash(np.lib.stride_tricks.sliding_window_view(h, width)).tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6])
def test_index_finds_every_fingerprint_within_the_radius(radius):
    rng = random.Random(radius)
    vocabulary = [f"w{i}" for i in range(50)]
    text = [rng.choice(vocabulary) for _ in range(300)]
    ix = WindowIndex(13, 5, radius, [(1, WordHashes().of(text))])
    prints = ix.prints.copy()
    for i in range(len(prints)):
        for _ in range(rng.randrange(radius + 3)):
            prints[i] ^= np.uint64(1 << rng.randrange(64))
    got = {(int(w), int(c)) for ws, cs in ix.near(prints) for w, c in zip(ws, cs)}
    want = {(a, b) for a in range(len(prints)) for b in range(len(ix.prints)) if bin(int(prints[a]) ^ int(ix.prints[b])).count("1") <= radius}
    assert got == want


def test_weighted_shingle_similarity():
    h = WordHashes()
    a = h.of("a b c d e f g h i j k l m".split())
    b = h.of("a b c d e f g h i j k l x".split())
    assert shingle_similarity(a[None], a[None], 5)[0] == 1
    assert shingle_similarity(a[None], b[None], 5)[0] == pytest.approx(8 / 10)
    r = h.of(["a"] * 13)
    assert shingle_similarity(r[None], r[None], 5)[0] == 1


def brute(docs, items, width=13):
    grams = {}
    for m, t in items:
        w = words(t) if t else []
        for k in range(len(w) - width + 1):
            grams.setdefault(tuple(w[k:k + width]), set()).add(m)
    out = set()
    for i, t in docs:
        w = words(t) if t else []
        for k in range(len(w) - width + 1):
            out |= {(i, m) for m in grams.get(tuple(w[k:k + width]), ())}
    return out


def corpus():
    rng = random.Random(3)
    sentence = lambda n: [f"t{rng.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(sentence(rng.randrange(5, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "Only four short words")]
    items.append((33, items[0][1]))  # equal items
    docs = []
    for i in range(200):
        w = sentence(rng.randrange(0, 200))
        if i % 4 == 0:
            src = words(items[rng.randrange(30)][1])
            n = rng.choice([12, 13, 14, 40])
            s = rng.randrange(max(1, len(src) - n))
            w[len(w) // 2:len(w) // 2] = src[s:s + n]
        docs.append((i, " ".join(w).upper() if i % 8 == 0 else ",  ".join(w)))
    docs += [(500, None), (501, ""), (502, docs[0][1]), (503, " ".join(f"z{k}" for k in range(60_000)) + " " + items[1][1])]
    return docs, items


def test_found_equals_brute_force_in_one_and_many_blocks(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "similarity")
    m = spark.createDataFrame(items, "item_id long, text string")
    for block in (400_000, 100):
        got = leaked_items(d, "doc_id", "similarity", m, "item_id", "text", radius=2, similarity=1.0, exact=True, block_windows=block)
        rows = [(r["doc_id"], r["item_id"]) for r in got.collect()]
        assert set(rows) == brute(docs, items)
        assert len(rows) == len(set(rows))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string")
    m = d.withColumnRenamed("doc_id", "item_id")
    assert leaked_items(d, "doc_id", "text", m.limit(0), "item_id", "text").count() == 0
    assert leaked_items(d.limit(0), "doc_id", "text", m, "item_id", "text").count() == 0
    assert leaked_items(d, "doc_id", "text", m, "item_id", "text").first()["similarity"] == 1
    with pytest.raises(ValueError):
        leaked_items(d, "doc_id", "text", m, "item_id", "text", radius=9)
    with pytest.raises(ValueError):
        leaked_items(m, "item_id", "text", m, "item_id", "text")


def test_ids_of_any_type_and_separators(spark):
    line = "\n".join(f"w{i}" for i in range(13))
    d = spark.createDataFrame([("d1", line.replace("\n", "\t")), ("d2", "x")], "doc string, text string")
    m = spark.createDataFrame([("i1", line), ("i2", line.upper()), (None, line)], "item string, text string")
    got = leaked_items(d, "doc", "text", m, "item", "text", exact=True)
    assert sorted(tuple(r) for r in got.collect()) == [("d1", "i1", 1, 1.0), ("d1", "i2", 1, 1.0)] and dict(got.dtypes)["item_id"] == "string"
    glyphs = "".join(chr(0x4E00 + i) for i in range(13))
    d = spark.createDataFrame([("d", "x" + glyphs + "y")], "doc string, text string")
    m = spark.createDataFrame([(b"i", glyphs)], "item binary, text string")
    assert leaked_items(d, "doc", "text", m, "item", "text", glyphs=True).first()["item_id"] == b"i" and leaked_items(d, "doc", "text", m, "item", "text").count() == 0


def test_documents_are_read_once_for_any_number_of_blocks(spark):
    docs, items = corpus()
    acc = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b

    d = spark.createDataFrame(docs, "doc_id long, text string")
    d = d.mapInArrow(counted, d.schema)
    m = spark.createDataFrame(items, "item_id long, text string")
    got = leaked_items(d, "doc_id", "text", m, "item_id", "text", exact=True, block_windows=50)
    assert {(r[0], r[1]) for r in got.collect()} == brute(docs, items) and acc.value == len(docs)


def test_a_passage_repeated_in_all_items_and_documents(spark):
    hot = " ".join(f"h{i}" for i in range(20))
    d = spark.range(400).selectExpr("id AS doc_id", f"repeat('{hot} ', 5) AS text")
    m = spark.range(300).selectExpr("id AS item_id", f"concat('{hot} own', id) AS text")
    got = leaked_items(d, "doc_id", "text", m, "item_id", "text")
    assert got.count() == 400 * 300 and got.where("similarity < 1").count() == 0


def changed(rng, w, every):
    """Every so many words another one, from a random place on."""
    at = rng.randrange(every)
    return [f"new{rng.randrange(9999)}" if i % every == at else x for i, x in enumerate(w)]


@pytest.mark.parametrize("every,similarity,length", [(10, 0.25, 40), (12, 0.35, 40), (60, 0.8, 120)])
def test_changed_items_are_found_as_a_whole(spark, every, similarity, length):
    """Recall over planted changes by item-sized windows; what the similarity is, is set by the number of changes."""
    rng = random.Random(every)
    items = [(i, [f"t{rng.randrange(3000)}" for _ in range(length)]) for i in range(100)]
    docs = [(i, " ".join([f"u{rng.randrange(3000)}" for _ in range(50)] + changed(rng, w, every) + [f"u{rng.randrange(3000)}" for _ in range(50)])) for i, w in items]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(d, "doc_id", "text", m, "item_id", "text", similarity=similarity, item_sized=True).collect()}
    assert len(got & {(i, i) for i, _ in items}) >= 90 and len(got - {(i, i) for i, _ in items}) == 0


def test_item_sized_windows_equal_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(f"t{rng.randrange(80)}" for _ in range(rng.choice([3, 5, 8, 12, 13, 20, 30, 70, 140])))) for i in range(40)]
    docs = []
    for i in range(120):
        src = words(items[rng.randrange(40)][1])
        if i % 3:
            src[rng.choice([0, -1, len(src) // 2])] = "changed"
        docs.append((i, " ".join([f"u{rng.randrange(30)}" for _ in range(10)] + src + [f"u{rng.randrange(30)}" for _ in range(10)])))
    want = {}
    for m, t in items:
        w = words(t)
        width = max((x for x in LADDER if x <= len(w)), default=0)
        if width:
            for key, value in near(docs, [(m, t)], 0.8, width).items():
                want[key] = value
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = leaked_items(d, "doc_id", "text", m, "item_id", "text", item_sized=True).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["similarity"]) for r in got} == want and len(got) == len(want) > 50


def near(docs, items, similarity, width=13, size=5):
    """Number of windows and best similarity of all pairs, by comparing every two windows."""
    def windows(t):
        w = words(t) if t else []
        return [Counter(tuple(w[p:p + size]) for p in range(k, k + width - size + 1)) for k in range(len(w) - width + 1)]

    out, n = {}, width - size + 1
    for m, t in items:
        theirs = windows(t)
        for d, u in docs:
            best = [max(((c := (a & b).total()) / (2 * n - c) for b in theirs), default=0) for a in windows(u)]
            if got := [x for x in best if x >= similarity]:
                out[d, m] = (len(got), max(got))
    return out


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_similar_windows_equal_brute_force(spark, similarity):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.choice([12, 13, 14, 25])))) for i in range(12)]
    items += [(20, "a " * 15), (21, items[1][1]), (22, None), (23, "a b " * 8)]
    docs = []
    for i in range(40):
        src = words(items[rng.randrange(12)][1])
        src[rng.choice([0, -1, len(src) // 2])] = "changed"  # an edge word leaves 8 of 10 shingles, one amid the window less
        w = [f"u{rng.randrange(30)}" for _ in range(rng.randrange(20))]
        docs.append((i, " ".join(w[:5] + src + w[5:])))
    docs += [(50, "a " * 14), (51, "b a " * 9), (52, items[1][1] + " " + items[2][1]), (53, None), (54, "")]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = near(docs, items, similarity)
    assert any(s < 1 for _, s in want.values())
    for block in (400_000, 20):
        got = leaked_items(d, "doc_id", "text", m, "item_id", "text", radius=2, similarity=similarity, block_windows=block).collect()
        assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["similarity"]) for r in got} == want and len(got) == len(want)
