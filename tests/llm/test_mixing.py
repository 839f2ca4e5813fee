import numpy as np
import pytest

from codicil.llm.mixing import Mixture, balance, count_tokens, invert, plan, ramp


def test_balanced_schedule():
    shares = np.array([0.5, 0.3, 0.2])
    w = balance(shares, ramp([1, 2, 6]))
    area = np.array([0.5, 1, 1, 1, 0.5]) / 4
    assert np.allclose(w.sum(0), 1, atol=1e-6) and np.allclose(w @ area, shares, atol=1e-9)
    assert w[2, -1] > w[2, 0]


def test_plan_is_the_largest_exact_total():
    p = plan([("a", 0.5, 1), ("b", 0.3, 4), ("gone", 0.2, 1)], {"a": 1000, "b": 100})
    assert set(p) == {"a", "b"}
    total = sum(x["demand"] for x in p.values())
    assert p["a"]["demand"] / total == pytest.approx(0.625) and p["b"]["demand"] == pytest.approx(400)
    assert plan([("a", 1.0, 1)], {}) == {}


def test_inversion(spark):
    from pyspark.sql import functions as F

    w = balance(np.array([0.6, 0.4]), ramp([1, 5]))[1]
    steps = (w[1:] + w[:-1]) / 2 / 4
    filled = np.concatenate([[0], np.cumsum(steps) / steps.sum()])
    w = w / steps.sum()
    ts = np.linspace(0, 1, 21)
    grid = np.linspace(0, 1, 200_001)
    cum = np.concatenate([[0], np.cumsum((np.interp(grid, np.linspace(0, 1, 5), w)[1:] + np.interp(grid, np.linspace(0, 1, 5), w)[:-1]) / 2 / 200_000)])
    ys = np.interp(ts, grid, cum)
    df = spark.createDataFrame([(float(y), [float(x) for x in w], [float(x) for x in filled]) for y in ys], "y double, w array<double>, f array<double>")
    got = [r[0] for r in df.select(invert(F.col("y"), F.col("w"), F.col("f"))).collect()]
    assert np.allclose(got, ts, atol=1e-4)


def make(spark):
    docs = [(i, "a", "one two three four " * (1 + i % 5)) for i in range(400)] + [(1000 + i, "b", "five six seven " * 3) for i in range(12)]
    docs += [(2000, "unlisted", "x y"), (2001, None, "x y"), (2002, "a", None), (2003, "a", ""), (None, "a", "x"), (3, "a", "one two three four " * 4)]
    targets = [("a", 0.7, 1), ("b", 0.25, 3), ("gone", 0.05, 2)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as tokens", "'q' as bucket"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_caps_and_order(spark):
    docs, targets = make(spark)
    m = Mixture(docs, targets)
    chosen = m.documents().collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    uses = {}
    for r in chosen:
        uses.setdefault(r["source"], []).append(r["uses"])
    assert set(uses) == {"a", "b"} and max(uses["a"]) == 1 and max(uses["b"]) <= 3 and max(uses["b"]) - min(uses["b"]) <= 1
    shares = {r["source"]: r for r in m.shares().collect()}
    assert shares["gone"]["actual_share"] == 0 and shares["gone"]["n_documents"] == 0
    assert shares["a"]["actual_share"] == pytest.approx(0.7 / 0.95, abs=0.02)
    order = m.order().collect()
    assert len(order) == sum(r["uses"] for r in chosen)
    pos = [r["position"] for r in order]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    late = sum(r["tokens"] for r in order if r["source"] == "b" and r["position"] > 0.5) / sum(r["tokens"] for r in order if r["source"] == "b")
    assert late > 0.5  # the repeated source comes late


def test_token_counts_are_those_of_whole_texts(spark):
    from codicil.llm.mixing import TOKENIZER, _encoding

    texts = ["", "Hello, world", "ọ̀rọ̀ " * 5, "word " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in count_tokens(df, "text").collect()}
    with open(TOKENIZER, "rb") as f:
        e = _encoding(f.read())
    assert got == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_empty(spark):
    docs, targets = make(spark)
    m = Mixture(docs.limit(0), targets)
    assert m.documents().count() == 0 and m.order().count() == 0
    assert {r["actual_share"] for r in m.shares().collect()} == {0}
