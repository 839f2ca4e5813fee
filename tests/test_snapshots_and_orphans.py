import json
import random

import pytest

from codicil.functions.jsonvalue import canonical
from codicil.operators.orphan_refs import orphan_references
from codicil.operators.snapshot_diff import _checksum, snapshot_changes


@pytest.mark.parametrize("a,b,same", [
    ('{"a":1,"b":[1,2]}', '{ "b" : [1, 2],\n "a": 1 }', True), ('{"a":"\\u00e9"}', '{"a":"é"}', True), ('{"a":"e\\u0301"}', '{"a":"é"}', False), ('{"a":[1,2]}', '{"a":[2,1]}', False),
    ('{"a":1.0}', '{"a":1}', True), ('{"a":1e2}', '{"a":100}', True), ('{"a":0.1}', '{"a":0.10}', True), ('{"a":true}', '{"a":1}', False), ('{"a":null}', "{}", False), ("no json", "no  json", False),
    ('{"a":"\\/"}', '{"a":"/"}', True), ('{"a":"1"}', '{"a":1}', False), ('{"a":12345678901234567890}', '{"a":12345678901234567891}', False)])
def test_json_values(a, b, same):
    assert (canonical(a) == canonical(b)) is same


def test_checksum_is_the_engines(spark):
    got = spark.sql("select xxhash64(cast(-5 as bigint), cast(7 as bigint), cast(9 as bigint)) as h").first()["h"]
    assert got & (2**64 - 1) == _checksum(-5, 7, 9)


def brute(rows, tags):
    state = {t: {} for t in tags}
    for t, k, v in rows:
        if k is not None and t in state:
            state[t][k] = canonical(v)
    out = set()
    for a, b in zip(tags, tags[1:]):
        for k in state[a].keys() | state[b].keys():
            x, y = state[a].get(k), state[b].get(k)
            if x != y:
                out.add((b, k, "added" if x is None else "removed" if y is None else "changed"))
    return out


def test_changes_also_with_tables_that_are_too_small(spark):
    rng, tags = random.Random(5), ["v1", "v2", "v3"]
    rows = []
    for t in tags:
        for k in range(400):
            if rng.random() < 0.9:
                v = json.dumps({"k": k, "v": rng.randrange(3) if rng.random() < 0.2 else 0})
                rows += [(t, f"k{k}", v)] * (2 if rng.random() < 0.1 else 1)
    df = spark.createDataFrame(rows, "tag string, digest string, side string")  # names that the operator uses itself
    snaps = spark.createDataFrame([(t, i) for i, t in enumerate(tags)], "tag string, release_no int")
    for how in ({"per_bucket": 100, "first_cells": 12}, {"per_bucket": 100, "first_cells": 3, "rounds": 1}, {"per_bucket": 400, "first_cells": 3, "rounds": 2}, {}):
        got = snapshot_changes(df, snaps, "tag", ["digest"], "side", **how)
        rows_ = [tuple(r) for r in got.collect()]
        assert set(rows_) == brute(rows, tags) and len(rows_) == len(set(rows_))


def test_many_small_snapshots_and_one_large(spark):
    """Sizes far apart: the large one's arrival and departure change every record of it."""
    small, large = 300, 60_000
    df = spark.range(small).selectExpr("concat('v', id) AS tag", "'k' AS k", "'{}' AS v").unionByName(spark.range(large).selectExpr("'v150' AS tag", "concat('r', id) AS k", "concat('[', id, ']') AS v"))
    snaps = spark.range(small).selectExpr("concat('v', id) AS tag", "int(id) AS release_no")
    got = {(r["tag"], r["change_kind"]): r["count"] for r in snapshot_changes(df, snaps, "tag", ["k"], "v", first_cells=96).groupBy("tag", "change_kind").count().collect()}
    assert got == {("v150", "added"): large, ("v151", "removed"): large}


def test_a_key_that_holds_a_third_of_all_rows(spark):
    rows = spark.range(30_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS tag", "if(id % 3 = 0, 'hot', concat('k', id div 2)) AS k", "concat('{\"x\": ', if(id % 3 = 0, id % 7, 1), '}') AS v")
    snaps = spark.createDataFrame([("a", 0), ("b", 1)], "tag string, release_no int")
    plain = rows.toPandas()
    want = set()
    least = {(t, k): min(canonical(v) for v in g) for (t, k), g in plain.groupby(["tag", "k"])["v"]}
    for k in set(plain["k"]):
        x, y = least.get(("a", k)), least.get(("b", k))
        if (x is None) != (y is None):
            want.add(("b", k, "added" if x is None else "removed"))
    got = {tuple(r) for r in snapshot_changes(rows, snaps, "tag", ["k"], "v").collect()}
    assert {x for x in got if x[1] != "hot"} == {x for x in want if x[1] != "hot"}


def test_snapshot_edges(spark):
    snaps = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "tag string, release_no int")
    df = spark.createDataFrame([("a", "x", None), ("b", "x", ""), ("b", None, "1"), ("other", "x", "1")], "tag string, k string, v string")
    got = {tuple(r) for r in snapshot_changes(df, snaps, "tag", ["k"], "v").collect()}
    assert got == {("b", "x", "changed"), ("c", "x", "removed")}
    assert snapshot_changes(df.limit(0), snaps, "tag", ["k"], "v").count() == 0
    assert snapshot_changes(df, snaps.limit(1), "tag", ["k"], "v").count() == 0


def test_orphans(spark):
    refs = spark.createDataFrame(
        [("p1", "t", "a", "r1"), ("p1", "t", "b", "r2"), ("p2", "t", "a", "r3"), ("p1", "u", "a", "r4"), ("p1", "t", None, "r5"), ("p1", "t", "A", "r6"), (None, "t", "b", "r7"), ("p1", "t", "b", "r2")],
        "period string, domain string, key string, code string")
    parents = spark.createDataFrame([("p1", "t", "a"), ("p1", "t", "a"), ("p2", "t", "b"), ("p2", "t", None)], "period string, domain string, key string")
    got = {(r["period"], r["domain"], r["key"], r["code"]) for r in orphan_references(refs, parents).collect()}
    assert got == {("p1", "t", "b", "r2"), ("p2", "t", "a", "r3"), ("p1", "u", "a", "r4"), ("p1", "t", "A", "r6")}
    assert orphan_references(refs, parents.limit(0)).count() == 6
    assert orphan_references(refs.limit(0), parents).count() == 0


def test_many_codes_in_one_period(spark):
    """More keys than one bitmap holds."""
    keys = spark.range(100_000).selectExpr("'p' as period", "'t' as domain", "concat('k', id) as key")
    parents = keys.where("cast(substring(key, 2) as int) % 1000 <> 7")
    assert orphan_references(keys, parents).count() == 100


def test_bitmaps_sparse_and_dense():
    from codicil.operators.orphan_refs import BITS, Bitmap

    rng = random.Random(1)
    for n, m in ((10, 10), (10, 20_000), (20_000, 10), (20_000, 25_000), (BITS, BITS), (5, 0)):
        a, b = sorted(rng.sample(range(BITS), n)), sorted(rng.sample(range(BITS), m))
        assert Bitmap(a).and_not(Bitmap(b)).tolist() == sorted(set(a) - set(b)) and Bitmap(a).and_not(None).tolist() == a


def test_a_missing_key_with_a_third_of_all_references(spark):
    refs = spark.range(60_000).selectExpr("'p' AS period", "'t' AS domain", "if(id % 3 = 0, 'hot', concat('k', id % 500)) AS key", "id AS record")
    parents = spark.range(500).selectExpr("'p' AS period", "'t' AS domain", "concat('k', id) AS key")
    for few in (50_000, 0):
        got = orphan_references(refs, parents, "held_in", few)
        assert got.count() == 20_000 and got.select("key").distinct().collect()[0][0] == "hot" and got.where("size(held_in) > 0").count() == 0
        assert orphan_references(refs, parents, few=few).count() == 20_000


def test_why_a_key_is_absent(spark):
    from codicil.operators.orphan_refs import absence
    from pyspark.sql import functions as F

    rows = [(2, []), (2, [1]), (2, [3]), (2, [1, 3])]
    got = spark.createDataFrame(rows, "n int, held array<int>").select(absence(F.col("n"), F.col("held"))).collect()
    assert [r[0] for r in got] == ["missing", "deleted", "late", "gap"]
