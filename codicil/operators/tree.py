"""Reading order, navigation and derived columns over resolved hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators import hierarchy as H
from codicil.operators.ranking import ranked
from codicil.session import durable

R = "release_tag"


def hierarchy_of(nodes: DataFrame, localities: Sequence[Column] = ()) -> DataFrame:
    """The hierarchy of nodes whose paths carry what reading needs: order, name and heading of each step, and the sizes of subtrees."""
    carry = (F.coalesce("sibling_order", F.lit(0)), F.coalesce("display_label", "heading", "node_type"), F.col("heading"))
    return H.build_hierarchy(nodes, R, "provision_id", "parent_provision_id", localities, carry=carry, sizes=True)


def ordered(nodes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Nodes that reach a root, with links and the path of (order, id) steps; preorder is the order of these paths, so no recursion is needed."""
    steps = F.transform("steps", lambda x: F.struct(x[1].cast("int").alias("o"), x[0].alias("id")))
    return nodes.join(hierarchy.where("steps is not null").select(R, "provision_id", F.col("depth").alias("links"), steps.alias("step_path")), [R, "provision_id"])


#: Whether a provision has content, from its record.
HAS_CONTENT = "coalesce(json_array_length(get_json_object(canonical_record, '$.content_blocks')), 0) > 0"


def contents(nodes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Outline rows of every act: preorder position, depth, whether there is content and children. nodes: with ``has_content``, or the record it comes from."""
    if "has_content" not in nodes.columns:
        nodes = nodes.withColumn("has_content", F.expr(HAS_CONTENT))
    rows = ordered(nodes, hierarchy)
    parents = nodes.where("parent_provision_id is not null").select(R, F.col("parent_provision_id").alias("provision_id"), F.lit(True).alias("_kids")).distinct()
    slim = rows.join(parents, [R, "provision_id"], "left").select(
        R, "act_id", "provision_id", "parent_provision_id", "node_type", "display_label", "heading", F.col("sibling_order").alias("order"), "step_path", F.col("links").alias("depth"),
        "has_content", F.coalesce("_kids", F.lit(False)).alias("has_children"))
    return ranked(slim, [R, "act_id"], ["step_path"], "position").drop("step_path")


def subtree(closure: DataFrame, hierarchy: DataFrame, provision_id: str) -> DataFrame:
    """A node and all its descendants, in each release."""
    own = hierarchy.where((F.col("provision_id") == provision_id) & F.col("path").isNotNull()).select(R, "provision_id", F.lit(0).cast("long").alias("distance"))
    below = closure.where(F.col("ancestor") == provision_id).select(R, F.col("descendant").alias("provision_id"), F.col("distance").cast("long").alias("distance"))
    return own.unionByName(below)


def breadcrumbs(hierarchy: DataFrame) -> DataFrame:
    """Labels of the ancestors, from the root, of every node that has any."""
    names = F.transform(F.slice("steps", 1, F.col("depth").cast("int")), lambda x: x[2])
    return hierarchy.where("depth > 0").select(R, "provision_id", F.array_join(names, " > ").alias("breadcrumb"))


def ancestor_summaries(provisions: DataFrame, wanted: DataFrame) -> DataFrame:
    """release_tag, provision_id, breadcrumb: the summaries of the ancestors of some provisions, from the root; found by parent links of their acts only."""
    acts = wanted.join(provisions.select(R, "provision_id", "act_id"), [R, "provision_id"]).select(R, "act_id").distinct()
    near = provisions.join(acts, [R, "act_id"], "left_semi")
    h = H.build_hierarchy(near, R, "provision_id", "parent_provision_id").where("depth > 0").join(wanted, [R, "provision_id"], "left_semi")
    up = h.select(R, "provision_id", "depth", F.posexplode("path").alias("at", "step")).where("at < depth")
    named = near.select(R, F.col("provision_id").alias("step"), F.struct("provision_id", "act_id", "node_type", "display_label", "heading").alias("x"))
    g = up.join(named, [R, "step"]).groupBy(R, "provision_id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    return g.select(R, "provision_id", F.transform("s", lambda x: x["x"]).alias("breadcrumb"))


def previous_next(nodes: DataFrame) -> DataFrame:
    """Neighbours in document order within the act."""
    at = durable(ranked(nodes.select(R, "act_id", "provision_id", "sequence"), [R, "act_id"], ["sequence", "provision_id"]), "positions")
    beside = lambda step, name: at.select(R, "act_id", (F.col("rank") + step).alias("rank"), F.col("provision_id").alias(name))
    out = at.join(beside(1, "previous_id"), [R, "act_id", "rank"], "left").join(beside(-1, "next_id"), [R, "act_id", "rank"], "left")
    return out.select(R, "provision_id", "previous_id", "next_id")


def inherited_heading(hierarchy: DataFrame) -> DataFrame:
    """The heading of a node or of its nearest ancestor with one that is not blank."""
    headed = F.filter(F.transform(F.reverse("steps"), lambda x: x[3]), lambda h: F.trim(h) != "")
    return hierarchy.where("steps is not null").select(R, "provision_id", F.get(headed, F.lit(0)).alias("heading")).where("heading is not null")


def siblings(nodes: DataFrame) -> DataFrame:
    """Position among the children of one parent (or the roots of an act), and their number."""
    w = Window.partitionBy(R, "act_id", "parent_provision_id")
    return nodes.select(
        R, "provision_id", F.row_number().over(w.orderBy("sibling_order", "provision_id")).cast("long").alias("position"), F.count(F.lit(1)).over(w).alias("n_siblings"))


def outline(nodes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Two levels: nodes of depth 0 and 1, the latter under their parent, or on top if that is missing."""
    depth = hierarchy.select(R, "provision_id", F.col("depth").alias("links"))
    known = nodes.join(depth, [R, "provision_id"], "left").select(R, "act_id", "provision_id", "parent_provision_id", "heading", F.coalesce("links", F.col("depth").cast("long")).alias("level"))
    rows = known.where("level <= 1")
    top = rows.where("level = 0").select(R, F.col("provision_id").alias("parent_provision_id"), F.lit(True).alias("_held"))
    return rows.join(top, [R, "parent_provision_id"], "left").select(
        R, "act_id", "provision_id", F.when(F.col("_held") & (F.col("level") == 1), F.col("parent_provision_id")).alias("under"), (F.col("level") == 0).alias("is_top"))


def relative_depth(nodes: DataFrame, root: str) -> DataFrame:
    """Stored depth relative to a node; 1 where the node is missing in the release."""
    base = nodes.where(F.col("provision_id") == root).select(R, F.col("depth").alias("d0"))
    inside = nodes.where(F.col("provision_id").startswith(root + "."))
    return inside.join(base, R, "left").select(R, "provision_id", F.coalesce(F.col("depth") - F.col("d0"), F.lit(1)).alias("relative_depth"))


def with_subtree_end(nodes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Interval encoding: [position, subtree_end] holds a node and all below it, for range filters without recursion."""
    c = durable(contents(nodes, hierarchy), "contents")
    steps = hierarchy.where("path is not null").select(R, "provision_id", F.explode("path").alias("up"))
    at = c.select(R, "provision_id", "position")
    end = steps.join(at, [R, "provision_id"]).groupBy(R, F.col("up").alias("provision_id")).agg(F.max("position").alias("subtree_end"))
    return c.join(end, [R, "provision_id"])
