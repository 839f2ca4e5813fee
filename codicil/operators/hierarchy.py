"""Parent-child links to full hierarchies.

``build_hierarchy`` resolves an adjacency list of unknown depth with weighted
disjoint-set forests:

1. Nodes are put into buckets of bounded size by a locality key (nodes that
   probably hang together share one). In each bucket the local links become a
   forest whose nodes know their local root and their offset (number of links)
   to it. A local root is a true root, a node on a local cycle, or a node whose
   parent lies in another bucket.
2. Only the nodes of the last kind go up. Each is linked to the local root of
   its parent, with the parent's offset as weight, so the graph shrinks to one
   vertex for each crossing link. The vertices are merged level by level over
   coarser buckets; what is still open after the levels is closed in one group
   per scope where its size is within ``max_bucket``, and by distributed pointer
   doubling otherwise.
3. Going down again, each node takes status, root and depth from its local
   root. Paths come from walking the parent index in order of the offset.

Defined results: rows with a null id or scope are left out; repeated rows of a
key count once (the smallest by value); a null parent makes a root; a parent
absent from the scope detaches the node and all below it; an empty input gives
an empty result; extra columns are carried by the caller, not here.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.session import durable

# What a vertex ends in.
ROOT, MISSING, CYCLE, ON_CYCLE, OPEN = "root", "missing", "cycle", "on_cycle", "open"

_LOCAL = "b long, s string, v string, t string, w long, status string, path array<string>, parent string, below long"
#: Between an id and what it carries along its paths; stands for null there.
_SEP, _NULL = "\x1f", "\x00"


class WeightedForest:
    """Vertices 0..n-1 with at most one link each, compressed to (root, offset).

    ``up[i]`` is the vertex that i is linked to, or -1. Compression doubles the
    pointers, adding offsets, so a chain of n links takes log2(n) passes.
    """

    def __init__(self, up: np.ndarray, weight: np.ndarray):
        n = len(up)
        me = np.arange(n)
        ends = up < 0
        self.up, self.weight = up, weight
        root, offset = np.where(ends, me, up), np.where(ends, 0, weight)
        for _ in range(max(1, int(n).bit_length()) + 1):
            offset = offset + offset[root]
            root = root[root]
            if ends[root].all():
                break
        self.root, self.offset = root, offset
        self.cyclic = ~ends[root]
        # After at least n steps every vertex that never ends stands on its cycle.
        self.on_cycle = np.zeros(n, bool)
        self.on_cycle[root[self.cyclic]] = True
        self._close_cycles()

    def _close_cycles(self) -> None:
        """Gives vertices below a cycle the cycle vertex they enter it by, and the offset to it."""
        if not self.cyclic.any():
            return
        n = len(self.up)
        me = np.arange(n)
        stop = (self.up < 0) | self.on_cycle
        root, offset = np.where(stop, me, self.up), np.where(stop, 0, self.weight)
        for _ in range(int(n).bit_length() + 1):
            offset = offset + offset[root]
            root = root[root]
        self.root, self.offset = root, offset

    def downward(self) -> np.ndarray:
        """All vertices, each after the one it is linked to (cycle vertices count as ends)."""
        steps = WeightedForest._hops(self.up, self.on_cycle)
        return np.argsort(steps, kind="stable")

    @staticmethod
    def _hops(up: np.ndarray, on_cycle: np.ndarray) -> np.ndarray:
        n = len(up)
        stop = (up < 0) | on_cycle
        root, hops = np.where(stop, np.arange(n), up), np.where(stop, 0, 1)
        for _ in range(int(n).bit_length() + 1):
            hops = hops + hops[root]
            root = root[root]
        return hops


def _forest_of(s: pd.Series, v: pd.Series, parent: pd.Series, weight: np.ndarray, has_parent: np.ndarray):
    """The local links of one bucket: a forest over its rows and, by row, whether the parent is outside."""
    index = pd.MultiIndex.from_arrays([s, v])
    up = np.full(len(v), -1)
    if has_parent.any():
        up[has_parent] = index.get_indexer(pd.MultiIndex.from_arrays([s[has_parent], parent[has_parent]]))
    return WeightedForest(up, weight), has_parent & (up < 0)


def _local_forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Level 0, one bucket: local root, offset and path of each node.

    ``parent`` is kept only for local roots with a parent elsewhere.
    """
    pdf = pdf.reset_index(drop=True)
    parent = pdf["parent"].to_numpy(object)
    has = pdf["parent"].notna().to_numpy()
    forest, outside = _forest_of(pdf["s"], pdf["v"], pdf["parent"], np.ones(len(pdf), np.int64), has)
    ids, labels = pdf["v"].to_numpy(object), pdf["label"].to_numpy(object)
    paths: list = [None] * len(pdf)
    below = np.zeros(len(pdf), np.int64)
    order = forest.downward()
    for i in order:
        paths[i] = [labels[i]] if forest.root[i] == i else paths[forest.up[i]] + [labels[i]]
    for i in order[::-1]:
        if forest.root[i] != i:
            below[forest.up[i]] += below[i] + 1
    at = forest.root
    status = np.where(forest.on_cycle, ON_CYCLE, np.where(forest.on_cycle[at], CYCLE, np.where(outside[at], OPEN, ROOT)))
    return pd.DataFrame({
        "b": pdf["b"], "s": pdf["s"], "v": ids, "t": ids[at], "w": forest.offset, "status": status,
        "path": paths, "parent": np.where(outside, parent, None), "below": below,
    })


_LINK = "s string, v string, t string, w long, status string, prefix array<string>"


def _merge_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A higher level, one group: compress links (v to t, weight, path from t to the parent of v)."""
    pdf = pdf.reset_index(drop=True)
    open_ = (pdf["status"] == OPEN).to_numpy()
    forest, outside = _forest_of(pdf["s"], pdf["v"], pdf["t"], pdf["w"].to_numpy(np.int64), open_)
    target, status = pdf["t"].to_numpy(object), pdf["status"].to_numpy(object)
    weight, prefix = pdf["w"].to_numpy(np.int64), [list(x) if x is not None else [] for x in pdf["prefix"]]
    out_t, out_w, out_s, out_p = target.copy(), weight.copy(), status.copy(), list(prefix)
    for i in forest.downward():
        if forest.on_cycle[i]:
            out_s[i] = ON_CYCLE
        elif forest.up[i] >= 0:
            u = forest.up[i]
            if forest.on_cycle[u] or out_s[u] in (CYCLE, ON_CYCLE):
                out_s[i], out_t[i] = CYCLE, out_t[u]
            elif out_s[u] != OPEN:  # what stays open keeps its own link, so that a later cycle is found whole
                out_t[i], out_s[i] = out_t[u], out_s[u]
                out_w[i] = weight[i] + out_w[u]
                out_p[i] = out_p[u] + prefix[i]
    return pd.DataFrame({"s": pdf["s"], "v": pdf["v"], "t": out_t, "w": out_w, "status": out_s, "prefix": out_p})


def _mark_cycle_paths(key, nodes: pd.DataFrame, ports: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one bucket between a port on a cycle and the local root it leads to."""
    parent = {(s, v): p for s, v, p in zip(nodes["s"], nodes["v"], nodes["up"])}
    seen = set()
    for at in zip(ports["s"], ports["v"]):
        while at in parent and at not in seen:
            seen.add(at)
            at = (at[0], parent[at])
    return pd.DataFrame(sorted(seen), columns=["s", "v"])


def _buckets(df: DataFrame, localities: Sequence[Column], max_bucket: int, n: int) -> Column:
    """Bucket of each row; localities with too many rows for a bucket are split by id."""
    return F.pmod(F.xxhash64(*localities, F.when(F.col("_split"), F.col("v"))), F.lit(n))


def build_hierarchy(
    df: DataFrame,
    scope: str,
    node: str,
    parent: str,
    localities: Sequence[Column] = (),
    max_bucket: int = 200_000,
    carry: Sequence[Column] = (),
    sizes: bool = False,
) -> DataFrame:
    """scope, node, status, root, depth (null unless a root is reached), path (ids from the root).

    ``carry``: values that each node takes along its paths; then ``steps`` has for
    each node of the path its id and these values, as strings. ``sizes``: also
    ``n_descendants``, summed from the subtrees of the buckets, without pairs.

    ``localities``: keys over ``node`` and ``scope``, from fine to coarse, that
    tell which nodes probably hang together (the scope by default); a key with
    too many rows for a bucket is split by id. They steer speed, never results.
    """
    spark = df.sparkSession
    localities = list(localities) or [F.col(scope)]
    keys = [c.cast("string").alias(f"l{i}") for i, c in enumerate(localities)]
    label = F.concat_ws(_SEP, F.col(node).cast("string"), *[F.coalesce(c.cast("string"), F.lit(_NULL)) for c in carry])
    rows = (
        df.select(F.col(scope).cast("string").alias("s"), F.col(node).cast("string").alias("v"), F.col(parent).cast("string").alias("parent"), *keys, label.alias("label"))
        .where("s is not null and v is not null")
        .groupBy("s", "v").agg(F.min("parent").alias("parent"), *[F.min(f"l{i}").alias(f"l{i}") for i in range(len(keys))], F.min("label").alias("label"))
    )
    rows = durable(rows, "nodes")
    n = max(1, -(-rows.count() * 4 // max_bucket))
    n = max(n, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * 4))

    hot = rows.groupBy("s", "l0").count().where(F.col("count") > max_bucket // 4).select("s", "l0", F.lit(True).alias("_split"))
    split = rows.join(hot, ["s", "l0"], "left").withColumn("_split", F.coalesce("_split", F.lit(False)))
    placed = split.withColumn("b", _buckets(split, [F.col("s"), F.col("l0")], max_bucket, n))
    local = durable(placed.select("b", "s", "v", "parent", "label").groupBy("b").applyInPandas(_local_forest, _LOCAL), "forest")

    # Up: a link from each open local root to the local root of its parent.
    crossing = local.where((F.col("status") == OPEN) & F.col("parent").isNotNull()).select("s", "v", "parent")
    at = local.select("s", F.col("v").alias("parent"), F.col("t").alias("t"), F.col("w").alias("w1"), F.col("status").alias("status1"), F.col("path").alias("path1"))
    links = crossing.join(at, ["s", "parent"], "left").select(
        "s", "v", "parent", F.col("t"), (F.coalesce("w1", F.lit(0)) + 1).alias("w"),
        F.when(F.col("status1").isNull(), MISSING).when(F.col("status1") == ON_CYCLE, CYCLE).otherwise(F.col("status1")).alias("status"),
        F.coalesce("path1", F.array().cast("array<string>")).alias("prefix"),
    )
    links = durable(links, "links")
    ports = links.select("s", "v", F.col("parent").alias("port"))
    merged = links.drop("parent")
    for i in range(1, len(keys)):
        if merged.where(F.col("status") == OPEN).limit(1).count() == 0:
            break  # most links lead straight to a root
        merged = _level(merged, rows, f"l{i}", max_bucket)
    merged = _close(merged, max_bucket)

    on_cycle = merged.where(F.col("status") == ON_CYCLE).select("s", "v")
    crossing_cycles = _ports_on_cycles(local, rows, ports, on_cycle)
    # Down: what the local root ends in holds for all nodes of its tree.
    top = merged.select("s", F.col("v").alias("t"), F.col("t").alias("top"), F.col("w").alias("w2"), F.col("status").alias("status2"), "prefix")
    out = local.join(top, ["s", "t"], "left").join(crossing_cycles, ["s", "v"], "left")
    status = (
        F.when(F.col("_marked"), ON_CYCLE)
        .when(F.col("status") != OPEN, F.col("status"))
        .when(F.col("status2") == ON_CYCLE, CYCLE)
        .otherwise(F.col("status2"))
    )
    depth = F.col("w") + F.when(F.col("status") == OPEN, F.col("w2")).otherwise(0)
    path = F.when((F.col("status") == OPEN) & (F.col("status2") == ROOT), F.concat("prefix", "path")).when(F.col("status") == ROOT, F.col("path"))
    more = []
    if sizes:
        # What hangs below a node in other buckets: the local trees whose way to the root leads through it.
        hung = merged.where(F.col("status") == ROOT).select("s", F.col("v").alias("r"), F.explode("prefix").alias("x")).join(local.select("s", F.col("v").alias("r"), (F.col("below") + 1).alias("n")), ["s", "r"])
        hung = hung.groupBy("s", F.split_part("x", F.lit(_SEP), F.lit(1)).alias("v")).agg(F.sum("n").alias("_hung"))
        out = out.join(hung, ["s", "v"], "left")
        more = [F.when(F.col("status") == ROOT, F.col("_below")).alias("n_descendants")]
    below = F.col("below") + F.coalesce("_hung", F.lit(0)) if sizes else F.lit(None)
    out = out.select(F.col("s").alias(scope), F.col("v").alias(node), status.alias("status"), path.alias("path"), depth.alias("_depth"), below.alias("_below"))
    ids = F.transform("path", lambda x: F.split_part(x, F.lit(_SEP), F.lit(1))) if carry else F.col("path")
    if carry:
        more.append(F.when(F.col("status") == ROOT, F.transform("path", lambda x: F.transform(F.split(x, _SEP), lambda v: F.nullif(v, F.lit(_NULL))))).alias("steps"))
    return out.select(
        scope, node, "status", F.when(F.col("status") == ROOT, ids[0]).alias("root"),
        F.when(F.col("status") == ROOT, F.col("_depth")).alias("depth"), F.when(F.col("status") == ROOT, ids).alias("path"), *more)


def _level(links: DataFrame, rows: DataFrame, key: str, max_bucket: int) -> DataFrame:
    """Merges links within groups of a coarser locality; oversized groups are left for the next level."""
    keyed = links.join(rows.select("s", "v", F.col(key).alias("k")), ["s", "v"], "left")
    sizes = keyed.groupBy("s", "k").count().where(F.col("count") <= max_bucket).select("s", "k", F.lit(True).alias("_fits"))
    keyed = durable(keyed.join(sizes, ["s", "k"], "left"), "level")
    fits = keyed.where("_fits").withColumn("b", F.xxhash64("s", "k"))
    done = fits.groupBy("b").applyInPandas(lambda pdf: _merge_links(pdf.drop(columns=["b", "k", "_fits"])), _LINK)
    return durable(done.unionByName(keyed.where("_fits is null").select("s", "v", "t", "w", "status", "prefix")), "links")


def _close(links: DataFrame, max_bucket: int) -> DataFrame:
    """Resolves every link that is still open."""
    if links.where(F.col("status") == OPEN).limit(1).count() == 0:
        return links
    largest = links.groupBy("s").count().agg(F.max("count")).first()[0] or 0
    if largest <= max_bucket:
        return durable(links.groupBy("s").applyInPandas(_merge_links, _LINK), "links")
    return _double(links)


def _double(links: DataFrame) -> DataFrame:
    """Pointer doubling by joins: for open links without a bound on their number.

    The first pass, without paths, finds the links that are open after more
    steps than there are links: they lie on or below a cycle, and their targets
    are then exactly the vertices on cycles. The second pass is free of cycles.
    """
    n = links.count()
    bare = _rounds(links.withColumn("prefix", F.array().cast("array<string>")), n)
    lost = durable(bare.where(F.col("status") == OPEN).select("s", "v", "t"), "lost")
    cycle = lost.select("s", F.col("t").alias("v")).distinct().withColumn("_on", F.lit(True))
    below = lost.select("s", "v").join(cycle, ["s", "v"], "left").withColumn("_lost", F.lit(True))
    known = links.join(below, ["s", "v"], "left").withColumn("status", F.when(F.col("_on"), ON_CYCLE).when(F.col("_lost"), CYCLE).otherwise(F.col("status")))
    return _rounds(durable(known.drop("_on", "_lost"), "links"), n)


def _rounds(links: DataFrame, n: int) -> DataFrame:
    now, open_, known = links, F.col("status") == OPEN, F.col("st2").isNotNull()
    for _ in range(max(1, n.bit_length()) + 1):
        up = now.select("s", F.col("v").alias("t"), F.col("t").alias("t2"), F.col("w").alias("w2"), F.col("status").alias("st2"), F.col("prefix").alias("p2"))
        now = durable(
            now.join(up, ["s", "t"], "left").select(
                "s", "v", F.when(open_ & known, F.col("t2")).otherwise(F.col("t")).alias("t"),
                F.when(open_ & known, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"),
                F.when(open_ & (F.col("st2") == ON_CYCLE), CYCLE).when(open_ & known, F.col("st2")).otherwise(F.col("status")).alias("status"),
                F.when(open_ & known, F.concat("p2", "prefix")).otherwise(F.col("prefix")).alias("prefix"),
            ), "double")
        if now.where(open_).limit(1).count() == 0:
            break
    return now


def _ports_on_cycles(local: DataFrame, rows: DataFrame, ports: DataFrame, on_cycle: DataFrame) -> DataFrame:
    """Nodes on cycles that cross buckets: the local paths that such a cycle takes through each bucket."""
    spark = local.sparkSession
    if on_cycle.limit(1).count() == 0:
        return spark.createDataFrame([], "s string, v string, _marked boolean")
    starts = on_cycle.join(ports, ["s", "v"]).select("s", F.col("port").alias("v"))
    placed = durable(starts.join(local.select("s", "v", "b"), ["s", "v"]), "ports")
    nodes = (
        local.select("b", "s", "v").join(placed.select("b").distinct(), "b", "left_semi")
        .join(rows.select("s", "v", F.col("parent").alias("up")), ["s", "v"])
    )
    marked = nodes.groupBy("b").cogroup(placed.groupBy("b")).applyInPandas(_mark_cycle_paths, "s string, v string")
    return durable(marked.distinct().withColumn("_marked", F.lit(True)), "marked")


def link_defects(nodes: DataFrame, hierarchy: DataFrame, scope: str, node: str, owner: str, parent: str, order: str, depth: str) -> DataFrame:
    """scope, node, defect: links, depths and orders that prevent or contradict a proper tree."""
    own = nodes.select(scope, node, owner, parent, order, depth).where(F.col(scope).isNotNull() & F.col(node).isNotNull())
    own = own.groupBy(scope, node).agg(F.min(F.struct(owner, parent, order, depth)).alias("x")).select(scope, node, "x.*")
    reached = hierarchy.select(scope, node, "status", F.col("depth").alias("_links"))
    kind = (
        F.when(F.col("status") == ON_CYCLE, "on_cycle")
        .when(F.col("status") == CYCLE, "under_cycle")
        .when(F.col("status") == MISSING, "detached")
        .when(~F.col(depth).eqNullSafe(F.col("_links").cast("int")), "wrong_depth")
    )
    broken = own.join(reached, [scope, node]).select(scope, node, kind.alias("defect")).where("defect is not null")
    clash = own.where(F.col(order).isNotNull()).groupBy(scope, owner, parent, order).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = [own[c].eqNullSafe(clash[c]) for c in (owner, parent)]
    both = own.join(clash, (own[scope] == clash[scope]) & (own[order] == clash[order]) & at[0] & at[1], "left_semi")
    return broken.unionByName(both.select(scope, node, F.lit("sibling_clash").alias("defect")))


def closure(hierarchy: DataFrame, scope: str, node: str) -> DataFrame:
    """scope, ancestor, descendant, distance: every descendant of every node that reaches a root."""
    up = hierarchy.where("path is not null").select(scope, F.col(node).alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where(F.col("at") < F.col("depth")).select(scope, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
