import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codicil.operators import hierarchy as H


def brute(links):
    """status, root, depth, path by following parents one by one."""
    out = {}
    for v in links:
        seen, at = [], v
        while True:
            if at in seen:
                out[v] = ("on_cycle" if at == v else "cycle", None, None, None)
                break
            if at not in links:
                out[v] = ("missing", None, None, None)
                break
            seen.append(at)
            if links[at] is None:
                path = seen[::-1]
                out[v] = ("root", at, len(path) - 1, path)
                break
            at = links[at]
    return out


def random_links(rng, n, cycles=True):
    links = {}
    for i in range(n):
        r = rng.random()
        parent = None if r < 0.05 else f"x{rng.randrange(5)}" if r < 0.08 else f"n{rng.randrange(n if cycles and rng.random() < 0.15 else max(1, i))}"
        links[f"n{i}"] = parent
    return links


@given(st.lists(st.integers(-1, 30), min_size=1, max_size=31))
@settings(max_examples=200, deadline=None)
def test_forest_agrees_with_walking(parents):
    n = len(parents)
    up = np.array([p if p < n else -1 for p in parents])
    f = H.WeightedForest(up, np.ones(n, np.int64))
    want = brute({i: (int(p) if p >= 0 else None) for i, p in enumerate(up)})
    for i in range(n):
        status, root, depth, _ = want[i]
        assert f.on_cycle[i] == (status == "on_cycle")
        assert f.cyclic[i] == (status in ("on_cycle", "cycle"))
        if status == "root":
            assert (f.root[i], f.offset[i]) == (root, depth)


def resolve(spark, links, max_bucket, localities=None, scope="r"):
    df = spark.createDataFrame([(scope, v, p) for v, p in links.items()], "s0 string, id string, up string")
    h = H.build_hierarchy(df, "s0", "id", "up", localities or (F.lit(None).cast("string"),), max_bucket)
    return {r["id"]: (r["status"], r["root"], r["depth"], r["path"]) for r in h.collect()}


@pytest.mark.parametrize("seed,max_bucket", [(1, 200_000), (2, 40), (3, 40), (4, 200)])
def test_random_forests_with_small_buckets(spark, seed, max_bucket):
    """Small buckets force crossing links; the smallest also leave too many for one group, so pointer doubling closes them."""
    rng = random.Random(seed)
    links = random_links(rng, 150)
    got = resolve(spark, links, max_bucket, (F.substring("id", 1, 2), F.lit("all")))
    assert got == brute(links)


def test_deep_chain_and_crossing_cycle(spark):
    links = {f"n{i}": (f"n{i - 1}" if i else None) for i in range(120)}
    links |= {f"c{i}": f"c{(i + 1) % 30}" for i in range(30)} | {"below": "c7", "lower": "below"}
    got = resolve(spark, links, 40, (F.substring(F.reverse("id"), 1, 1), F.lit("all")))
    assert got == brute(links)


def test_defined_results(spark):
    df = spark.createDataFrame(
        [("r", "a", None, 1), ("r", "a", None, 2), ("r", None, "a", 1), (None, "b", None, 1), ("r", "b", "b", 1), ("r", "c", "", 1), ("q", "b", "a", 1)], "s string, v string, t string, w int")
    h = H.build_hierarchy(df, "s", "v", "t")
    assert {(r["s"], r["v"], r["status"]) for r in h.collect()} == {("r", "a", "root"), ("r", "b", "on_cycle"), ("r", "c", "missing"), ("q", "b", "missing")}
    assert H.build_hierarchy(df.limit(0), "s", "v", "t").count() == 0


def test_defects_and_closure(spark):
    rows = [("r", "a", "x", None, 1, 0), ("r", "b", "x", "a", 1, 1), ("r", "c", "x", "a", 1, 1), ("r", "d", "x", "c", 2, 5), ("r", "e", "x", "gone", 1, 1), ("r", "f", "x", "f", None, None)]
    df = spark.createDataFrame(rows, "rel string, id string, act string, up string, o int, d int")
    h = H.build_hierarchy(df, "rel", "id", "up")
    got = {(r["id"], r["defect"]) for r in H.link_defects(df, h, "rel", "id", "act", "up", "o", "d").collect()}
    assert got == {("b", "sibling_clash"), ("c", "sibling_clash"), ("d", "wrong_depth"), ("e", "detached"), ("f", "on_cycle")}
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in H.closure(h, "rel", "id").collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("c", "d", 1)}


@pytest.mark.parametrize("max_bucket", [8, 1000])
def test_sizes_and_carried_values(spark, max_bucket):
    rng = random.Random(3)
    links = random_links(rng, 150)
    want = brute(links)
    below = {v: 0 for v in links}
    for status, _, _, path in want.values():
        for up in (path or [])[:-1]:
            below[up] += 1
    df = spark.createDataFrame([("r", v, p, int(v[1:]) % 7 or None) for v, p in links.items()], "s string, id string, up string, n int")
    h = H.build_hierarchy(df, "s", "id", "up", (F.substring("id", 1, 2), F.lit("all")), max_bucket, carry=(F.col("n"), F.concat(F.lit("|"), F.col("id"))), sizes=True)
    for r in h.collect():
        status, root, depth, path = want[r["id"]]
        assert (r["status"], r["root"], r["depth"], r["path"]) == (status, root, depth, path)
        assert r["n_descendants"] == (below[r["id"]] if status == "root" else None)
        assert r["steps"] == ([[v, str(int(v[1:]) % 7) if int(v[1:]) % 7 else None, "|" + v] for v in path] if path else None)


def test_preorder_of_siblings_that_clash(spark):
    """Equal orders, ids of which one begins the other, and orders beyond nine digits."""
    from codicil.operators import tree

    rows = [("s-1", None, 1), ("s-1-bis", None, 1), ("s-1.a", "s-1", 1), ("s-1.b", "s-1", 2), ("s-1-bis.a", "s-1-bis", 1), ("big", None, 2_000_000_000), ("s-2", None, None)]
    nodes = spark.createDataFrame([("r", "act", v, p, o, "section", None, v, True) for v, p, o in rows], "release_tag string, act_id string, provision_id string, parent_provision_id string, sibling_order int, node_type string, display_label string, heading string, has_content boolean")
    h = tree.hierarchy_of(nodes)
    got = [r["provision_id"] for r in tree.contents(nodes, h).orderBy("position").collect()]
    assert got == ["s-2", "s-1", "s-1.a", "s-1.b", "s-1-bis", "s-1-bis.a", "big"]
    ends = {r["provision_id"]: (r["position"], r["subtree_end"]) for r in tree.with_subtree_end(nodes, h).collect()}
    assert ends["s-1"] == (2, 4) and ends["s-1-bis"] == (5, 6) and {r["provision_id"]: r["breadcrumb"] for r in tree.breadcrumbs(h).collect()} == {"s-1.a": "s-1", "s-1.b": "s-1", "s-1-bis.a": "s-1-bis"}
