"""Registered queries of the core operators: name to callable, name to SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import hierarchy as H
from codicil.operators.orphan_refs import absence, orphan_references
from codicil.operators.snapshot_diff import snapshot_changes
from codicil.plans import marred, pages, search, structure, tree, validate
from codicil.plans.common import provision_hierarchy
from codicil.plans.common import ready as _ready
from codicil.session import durable, ready_releases, table

MODULES = (tree, search, validate, pages, structure, marred)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every link, depth or order that prevents or contradicts a proper tree."""
    cols = ("release_tag", "provision_id", "act_id", "parent_provision_id", "sibling_order", "depth")
    p = _ready(spark, d, "provisions").select(*cols)
    return H.link_defects(p, provision_hierarchy(spark, d), *cols[:3], "parent_provision_id", "sibling_order", "depth")


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Status, root, depth, path and number of descendants of each provision."""
    h = provision_hierarchy(spark, d, sizes=True)
    return h.select("release_tag", "provision_id", "status", "root", "depth", F.array_join("path", " > ").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every provision that reaches a root."""
    return H.closure(provision_hierarchy(spark, d), "release_tag", "provision_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Acts and provisions added, removed or changed by value between consecutive ready releases."""
    acts = table(spark, d, "acts").select("release_tag", F.lit("act").alias("record_type"), F.col("act_id").alias("record_id"), "canonical_record")
    provisions = table(spark, d, "provisions").select("release_tag", F.lit("provision").alias("record_type"), F.col("provision_id").alias("record_id"), "canonical_record")
    return snapshot_changes(acts.unionByName(provisions), ready_releases(spark, d), "release_tag", ["record_type", "record_id"], "canonical_record")


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes of each kind, by release and record type."""
    return p3_found(spark, d).groupBy("release_tag", "record_type", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def _orphans(spark: SparkSession, d: str, held_in: str | None = None) -> DataFrame:
    c, p = _ready(spark, d, "citations"), _ready(spark, d, "provisions").select("release_tag", "provision_id", "source_ids")

    def ref(df, field, record, key, domain):
        return df.select(F.col("release_tag").alias("period"), F.lit(domain).alias("domain"), F.col(key).alias("key"), F.lit(field).alias("reference_field"), F.col(record).alias("record_id"))

    # All three keys of a citation from one scan.
    keys = F.array(*[
        F.struct(F.lit(domain).alias("domain"), F.col(key).alias("key"), F.lit(field).alias("reference_field"))
        for key, field, domain in (
            ("source_provision_id", "citation.source_provision_id", "provisions"),
            ("target_provision_id", "citation.target.provision_id", "provisions"),
            ("target_act_id", "citation.target.act_id", "acts"))])
    cited = c.select(F.col("release_tag").alias("period"), F.explode(keys).alias("x"), F.col("citation_id").alias("record_id")).select("period", "x.*", "record_id")
    spans = ref(p.select("release_tag", "provision_id", F.explode("source_ids").alias("source_id")), "provision.source_id", "provision_id", "source_id", "sources")
    parents = None
    for name, key in (("provisions", "provision_id"), ("acts", "act_id"), ("sources", "source_id")):
        held = _ready(spark, d, name).select(F.col("release_tag").alias("period"), F.lit(name).alias("domain"), F.col(key).alias("key"))
        parents = held if parents is None else parents.unionByName(held)
    return orphan_references(cited.unionByName(spans), parents, held_in)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References to records that their release does not hold."""
    return _orphans(spark, d).select(F.col("period").alias("release_tag"), "reference_field", "record_id", F.col("key").alias("missing_key")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans by table, field and release, and by what became of the key: missing, deleted, late, or a gap between releases that hold it."""
    no = F.create_map(*[F.lit(x) for r in ready_releases(spark, d).collect() for x in (r["release_tag"], r["release_no"])])  # the register of releases, at most 10,000
    found = _orphans(spark, d, "held_in").select("period", "reference_field", "record_id", "key", "held_in").distinct()
    found = found.withColumn("reason", absence(no[F.col("period")], F.transform("held_in", lambda p: no[p])))
    found = found.withColumn("table_name", F.when(F.col("reference_field").startswith("citation"), "citations").otherwise("provisions"))
    return found.groupBy("table_name", "reference_field", F.col("period").alias("release_tag"), "reason").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("key").alias("n_missing_keys"))


def queries() -> dict:
    own = (p2_found, p2_hierarchy, p2_descendants, p3_found, p3_summary, p4_found, p4_report)
    return {f.__name__: f for f in (*own, *(q for m in MODULES for q in m.QUERIES))}


_READY = "release_tag IN (SELECT release_tag FROM corpus_releases WHERE import_state = 'ready')"

_CHANGES = f"""tags AS (
  SELECT release_tag, row_number() OVER (ORDER BY list_transform(string_split(substr(release_tag, 9), '.'), lambda x: CAST(x AS INT))) AS no
  FROM corpus_releases WHERE import_state = 'ready'),
records AS (
  SELECT DISTINCT release_tag, 'act' AS record_type, act_id AS record_id, canonical_record AS j FROM acts WHERE {_READY}
  UNION SELECT DISTINCT release_tag, 'provision', provision_id, canonical_record FROM provisions WHERE {_READY}),
leaves AS (
  SELECT r.release_tag, r.record_type, r.record_id, r.j, t.fullkey || '|' || t.type || '|' || coalesce(t.atom ->> '$', '') AS leaf
  FROM records r, json_tree(r.j) t),
val AS (
  SELECT release_tag, record_type, record_id, min(v) AS v FROM (
    SELECT release_tag, record_type, record_id, j, md5(string_agg(leaf, chr(1) ORDER BY leaf)) AS v FROM leaves GROUP BY ALL) GROUP BY ALL),
numbered AS (SELECT val.*, no FROM val JOIN tags USING (release_tag)),
found AS (
  SELECT t.release_tag, coalesce(a.record_type, b.record_type) AS record_type, coalesce(a.record_id, b.record_id) AS record_id,
    CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM (SELECT * FROM numbered WHERE no > 1) a
  FULL JOIN (SELECT record_type, record_id, v, no + 1 AS no FROM numbered WHERE no < (SELECT max(no) FROM tags)) b
    ON a.no = b.no AND a.record_type = b.record_type AND a.record_id = b.record_id
  JOIN tags t ON t.no = coalesce(a.no, b.no) WHERE a.v IS DISTINCT FROM b.v)"""

_ORPHANS = f"""c AS (SELECT * FROM citations WHERE {_READY}), p AS (SELECT * FROM provisions WHERE {_READY}),
refs AS (
  SELECT release_tag, 'citation.source_provision_id' AS reference_field, citation_id AS record_id, source_provision_id AS missing_key FROM c
  UNION SELECT release_tag, 'citation.target.provision_id', citation_id, target_provision_id FROM c
  UNION SELECT release_tag, 'citation.target.act_id', citation_id, target_act_id FROM c
  UNION SELECT release_tag, 'provision.source_id', provision_id, unnest(source_ids) FROM p),
held AS (
  SELECT DISTINCT release_tag, 'provision_id' AS kind, provision_id AS key FROM p UNION SELECT release_tag, 'act_id', act_id FROM acts
  UNION SELECT release_tag, 'source_id', source_id FROM sources),
found AS (
  SELECT * FROM refs r WHERE missing_key IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM held h WHERE h.release_tag = r.release_tag AND h.key = r.missing_key AND ends_with(r.reference_field, h.kind)))"""


_NODES = """nodes AS (
  SELECT release_tag, provision_id, min(parent_provision_id) AS parent, min(act_id) AS act_id,
         min(sibling_order) AS sibling_order, min(depth) AS depth
  FROM provisions WHERE release_tag IN (SELECT release_tag FROM corpus_releases WHERE import_state = 'ready')
  GROUP BY 1, 2),
down AS (
  SELECT release_tag, provision_id, provision_id AS root, CAST(0 AS BIGINT) AS links, provision_id AS path FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.release_tag, n.provision_id, d.root, d.links + 1, d.path || ' > ' || n.provision_id
  FROM nodes n JOIN down d ON n.release_tag = d.release_tag AND n.parent = d.provision_id),
lost AS (
  SELECT n.release_tag, n.provision_id, false AS done FROM nodes n
  WHERE n.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes q WHERE q.release_tag = n.release_tag AND q.provision_id = n.parent)
  UNION ALL
  SELECT n.release_tag, n.provision_id, false FROM nodes n JOIN lost l ON n.release_tag = l.release_tag AND n.parent = l.provision_id),
cyclic AS (
  SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.release_tag = n.release_tag AND d.provision_id = n.provision_id)
  AND NOT EXISTS (SELECT 1 FROM lost l WHERE l.release_tag = n.release_tag AND l.provision_id = n.provision_id)),
walk AS (
  SELECT release_tag, provision_id AS start, parent AS at FROM cyclic
  UNION
  SELECT w.release_tag, w.start, c.parent FROM walk w JOIN cyclic c ON c.release_tag = w.release_tag AND c.provision_id = w.at),
status AS (
  SELECT release_tag, provision_id, 'root' AS status, root, links, path FROM down
  UNION ALL SELECT release_tag, provision_id, 'missing', NULL, NULL, NULL FROM lost
  UNION ALL SELECT c.release_tag, c.provision_id,
    CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.release_tag = c.release_tag AND w.start = c.provision_id AND w.at = c.provision_id)
         THEN 'on_cycle' ELSE 'cycle' END, NULL, NULL, NULL FROM cyclic c)"""

_CLOSURE = """pairs AS (
  SELECT release_tag, provision_id AS descendant, parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM nodes n
  WHERE parent IS NOT NULL AND EXISTS (SELECT 1 FROM down d WHERE d.release_tag = n.release_tag AND d.provision_id = n.provision_id)
  UNION ALL
  SELECT p.release_tag, p.descendant, n.parent, p.distance + 1 FROM pairs p
  JOIN nodes n ON n.release_tag = p.release_tag AND n.provision_id = p.ancestor WHERE n.parent IS NOT NULL)"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_NODES}
SELECT s.release_tag, s.provision_id, CASE status WHEN 'on_cycle' THEN 'on_cycle' WHEN 'cycle' THEN 'under_cycle'
  WHEN 'missing' THEN 'detached' ELSE 'wrong_depth' END AS defect
FROM status s JOIN nodes n ON n.release_tag = s.release_tag AND n.provision_id = s.provision_id
WHERE status <> 'root' OR n.depth IS DISTINCT FROM s.links
UNION ALL
SELECT release_tag, provision_id, 'sibling_clash' FROM (
  SELECT *, count(*) OVER (PARTITION BY release_tag, act_id, parent, sibling_order) AS n FROM nodes WHERE sibling_order IS NOT NULL)
WHERE n > 1""",
    "p2_hierarchy": f"""WITH RECURSIVE {_NODES}, {_CLOSURE}
SELECT s.release_tag, s.provision_id, s.status, s.root, s.links AS depth, s.path, coalesce(p.n, 0) AS n_descendants
FROM status s LEFT JOIN (SELECT release_tag, ancestor, count(*) AS n FROM pairs GROUP BY 1, 2) p
ON p.release_tag = s.release_tag AND p.ancestor = s.provision_id""",
    "p2_descendants": f"""WITH RECURSIVE {_NODES}, {_CLOSURE}
SELECT release_tag, ancestor, descendant, distance FROM pairs""",
    "p3_found": f"WITH {_CHANGES} SELECT * FROM found",
    "p3_summary": f"WITH {_CHANGES} SELECT release_tag, record_type, change_kind, count(*) AS n FROM found GROUP BY ALL",
    "p4_found": f"WITH {_ORPHANS} SELECT * FROM found",
    "p4_report": f"""WITH {_ORPHANS},
no AS (SELECT release_tag, row_number() OVER (ORDER BY list_transform(string_split(substr(release_tag, 9), '.'), lambda x: CAST(x AS INT))) AS n FROM corpus_releases WHERE import_state = 'ready'),
why AS (SELECT f.*, coalesce(bool_or(h.n < f.n), false) AS b, coalesce(bool_or(h.n > f.n), false) AS a FROM (SELECT found.*, no.n FROM found JOIN no USING (release_tag)) f
  LEFT JOIN (SELECT held.*, no.n FROM held JOIN no USING (release_tag)) h ON h.key = f.missing_key AND ends_with(f.reference_field, h.kind) GROUP BY ALL)
SELECT CASE WHEN starts_with(reference_field, 'citation') THEN 'citations' ELSE 'provisions' END AS table_name, reference_field, release_tag,
  CASE WHEN b AND a THEN 'gap' WHEN b THEN 'deleted' WHEN a THEN 'late' ELSE 'missing' END AS reason,
  count(*) AS n_references, count(DISTINCT record_id) AS n_records, count(DISTINCT missing_key) AS n_missing_keys
FROM why GROUP BY ALL""",
}
for _m in MODULES:
    SQL |= _m.SQL
SQL["valid_no_cycle"] = f"""WITH RECURSIVE {_NODES}
SELECT 'parent_cycle' AS rule, release_tag, provision_id AS key, status AS detail FROM status WHERE status IN ('on_cycle', 'cycle')"""
