"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import hierarchy as H
from codicil.operators import tree
from codicil.session import durable, ready_releases, table

KEYS = {"acts": "act_id", "provisions": "provision_id", "sources": "source_id", "citations": "citation_id"}
NODE = ("act_id", "parent_provision_id", "sibling_order", "sequence", "depth", "node_type", "display_label", "heading", "text_fidelity", "reference_key")

#: SQL for the same: rows of ready releases; repeated rows of a key agree in these columns.
READY = "release_tag IN (SELECT release_tag FROM corpus_releases WHERE import_state = 'ready')"
P_SQL = f"p AS (SELECT DISTINCT release_tag, provision_id, {', '.join(NODE)} FROM provisions WHERE {READY})"


def ready(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Rows of the ready releases; the register of releases is refused beyond 10,000 rows, so it may be broadcast."""
    return table(spark, d, name).join(F.broadcast(ready_releases(spark, d).select("release_tag")), "release_tag", "left_semi")


def clean(spark: SparkSession, d: str, name: str, *columns: str, **derived: Column) -> DataFrame:
    """One row for each key of the ready releases; ``derived`` columns are made before repeated rows meet, so that what they come from isn't moved."""
    key = KEYS[name]
    kept = [c for c in columns if c not in ("release_tag", key)]
    rows = ready(spark, d, name).select("release_tag", key, *kept, *[c.alias(n) for n, c in derived.items()])
    kept += derived
    if not kept:
        return rows.distinct()
    return rows.groupBy("release_tag", key).agg(F.min(F.struct(*kept)).alias("_x")).select("release_tag", key, "_x.*")


#: Provision ids are act:segment.segment..., so the first segment tells what hangs together.
LOCALITY = (("provision_id", "^[^:]*:?[^.]*"), ("provision_id", "^[^:]*"))


def localities() -> tuple[Column, ...]:
    return tuple(F.regexp_extract(c, pattern, 0) for c, pattern in LOCALITY)


def provision_hierarchy(spark: SparkSession, d: str, sizes: bool = False) -> DataFrame:
    p = ready(spark, d, "provisions").select("release_tag", "provision_id", "parent_provision_id")
    return H.build_hierarchy(p, "release_tag", "provision_id", "parent_provision_id", localities(), sizes=sizes)


def reading_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy with what reading needs along its paths."""
    p = ready(spark, d, "provisions").select("release_tag", "provision_id", "parent_provision_id", "sibling_order", "display_label", "heading", "node_type")
    return durable(tree.hierarchy_of(p, localities()), "hierarchy")
