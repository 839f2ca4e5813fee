"""Queries over provision trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import hierarchy as H
from codicil.operators import reader, tree
from codicil.plans.common import NODE, P_SQL, READY, clean, reading_hierarchy, ready

SECTION = "qm-federal-constitution-1994:section-1"


def _nodes(spark: SparkSession, d: str, *more: str, **derived) -> DataFrame:
    return clean(spark, d, "provisions", *NODE, *more, **derived)


def _contents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _nodes(spark, d, has_content=F.expr(tree.HAS_CONTENT)), reading_hierarchy(spark, d)


def _closure(h: DataFrame) -> DataFrame:
    return H.closure(h, "release_tag", "provision_id")


def tree_contents(spark: SparkSession, d: str) -> DataFrame:
    return tree.contents(*_contents(spark, d))


def tree_contents_filtered(spark: SparkSession, d: str) -> DataFrame:
    return reader.contents_of(tree_contents(spark, d), act_id="qm-federal-constitution-1994", max_depth=1)


def tree_subtree(spark: SparkSession, d: str) -> DataFrame:
    h = reading_hierarchy(spark, d)
    return tree.subtree(_closure(h), h, SECTION)


def tree_subtree_interval(spark: SparkSession, d: str) -> DataFrame:
    out = tree.with_subtree_end(*_contents(spark, d))
    return out.select("release_tag", "provision_id", "position", F.col("subtree_end").cast("long").alias("subtree_end"))


def tree_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return tree.breadcrumbs(reading_hierarchy(spark, d))


def tree_previous_next(spark: SparkSession, d: str) -> DataFrame:
    return tree.previous_next(_nodes(spark, d))


def tree_inherited_heading(spark: SparkSession, d: str) -> DataFrame:
    return tree.inherited_heading(reading_hierarchy(spark, d))


def tree_siblings(spark: SparkSession, d: str) -> DataFrame:
    return tree.siblings(_nodes(spark, d))


def tree_outline(spark: SparkSession, d: str) -> DataFrame:
    return tree.outline(_nodes(spark, d), reading_hierarchy(spark, d))


def tree_outline_count(spark: SparkSession, d: str) -> DataFrame:
    return tree_outline(spark, d).groupBy("release_tag", "act_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def tree_relative_depth(spark: SparkSession, d: str) -> DataFrame:
    return tree.relative_depth(_nodes(spark, d), SECTION)


def provision_detail(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d, "source_ids")
    return reader.provision_detail(nodes, tree.previous_next(nodes), reading_hierarchy(spark, d), clean(spark, d, "citations", "source_provision_id"))


def provision_payload(spark: SparkSession, d: str) -> DataFrame:
    h = reading_hierarchy(spark, d)
    return reader.payload(
        _nodes(spark, d, "source_ids"), _closure(h), h, clean(spark, d, "acts", "official_title"), clean(spark, d, "sources"), clean(spark, d, "citations", "source_provision_id", "target_act_id", "target_provision_id"))


def list_acts(spark: SparkSession, d: str) -> DataFrame:
    acts = clean(spark, d, "acts", "official_title", "short_title", "year", "number", "citation", "text_kind", "status", "title_keys")
    return reader.list_acts(acts, offset=10, limit=20)


def act_sources(spark: SparkSession, d: str) -> DataFrame:
    return reader.act_sources(clean(spark, d, "acts", "canonical_record"), clean(spark, d, "sources", "document_title", "source_class"))


def incomplete_acts(spark: SparkSession, d: str) -> DataFrame:
    return reader.incomplete_acts(clean(spark, d, "acts", "source_ids"), clean(spark, d, "sources"))


def citation_targets(spark: SparkSession, d: str) -> DataFrame:
    return reader.citations_of(
        clean(spark, d, "citations", "source_provision_id", "target_act_id", "target_provision_id"), clean(spark, d, "acts", "official_title"), clean(spark, d, "provisions", "display_label"))


def release_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = None
    for name in ("acts", "provisions", "sources", "citations"):
        n = clean(spark, d, name).groupBy("release_tag").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        parts = n if parts is None else parts.unionByName(n)
    return parts


def fidelity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d, "provisions", "text_fidelity").groupBy("release_tag", "text_fidelity").agg(F.count(F.lit(1)).alias("n"))


def schema_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for name in ("acts", "provisions", "sources", "citations"):
        v = ready(spark, d, name).select("release_tag", "schema_version")
        rows = v if rows is None else rows.unionByName(v)
    return rows.groupBy("release_tag").agg(F.array_join(F.sort_array(F.collect_set("schema_version")), ",").alias("versions"))


def ordered_id_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest over the ids of each act in document order; an act bounds the list."""
    p = clean(spark, d, "provisions", "act_id", "sequence")
    ids = p.groupBy("release_tag", "act_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "provision_id"))).alias("ids"))
    text = F.concat(F.array_join(F.transform("ids", lambda x: x["provision_id"]), "\n"), F.lit("\n"))
    return ids.select("release_tag", "act_id", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("digest"))


def response_etag(spark: SparkSession, d: str) -> DataFrame:
    s = clean(spark, d, "sources", "document_title", "document_publisher", "page_count")
    body = F.concat_ws("|", "source_id", "document_title", "document_publisher", "page_count")
    return s.select("release_tag", "source_id", reader.etag(body).alias("etag"), reader.source_line(F.col("document_title"), F.col("document_publisher"), F.col("page_count")).alias("line"))


QUERIES = (
    tree_contents, tree_contents_filtered, tree_subtree, tree_subtree_interval, tree_breadcrumbs, tree_previous_next, tree_inherited_heading, tree_siblings,
    tree_outline, tree_outline_count, tree_relative_depth, provision_detail, provision_payload, list_acts, act_sources, incomplete_acts, citation_targets, release_counts,
    fidelity_histogram, schema_versions, ordered_id_digest, response_etag,
)

_DOWN = f"""{P_SQL},
down AS (
  SELECT p.*, CAST(0 AS BIGINT) AS links, [{{'o': coalesce(sibling_order, 0), 'id': provision_id}}] AS step_path, [provision_id] AS path
  FROM p WHERE parent_provision_id IS NULL
  UNION ALL
  SELECT p.*, d.links + 1, list_append(d.step_path, {{'o': coalesce(p.sibling_order, 0), 'id': p.provision_id}}), list_append(d.path, p.provision_id)
  FROM p JOIN down d ON p.release_tag = d.release_tag AND p.parent_provision_id = d.provision_id),
steps AS (SELECT release_tag, provision_id, links, unnest(path) AS step, unnest(range(len(path))) AS at FROM down)"""
_CONTENTS = f"""{_DOWN},
contents AS (
  SELECT d.release_tag, d.act_id, d.provision_id, d.parent_provision_id, d.node_type, d.display_label, d.heading, d.sibling_order AS "order",
    row_number() OVER (PARTITION BY d.release_tag, d.act_id ORDER BY d.step_path) AS position, d.links AS depth,
    j.n > 0 AS has_content, k.provision_id IS NOT NULL AS has_children
  FROM down d
  LEFT JOIN (SELECT DISTINCT release_tag, parent_provision_id AS provision_id FROM p WHERE parent_provision_id IS NOT NULL) k
    ON k.release_tag = d.release_tag AND k.provision_id = d.provision_id
  LEFT JOIN (SELECT release_tag, provision_id, max(json_array_length(canonical_record, '$.content_blocks')) AS n FROM provisions GROUP BY 1, 2) j
    ON j.release_tag = d.release_tag AND j.provision_id = d.provision_id)"""
_CRUMBS = """crumbs AS (
  SELECT s.release_tag, s.provision_id, string_agg(coalesce(q.display_label, q.heading, q.node_type), ' > ' ORDER BY s.at) AS breadcrumb
  FROM steps s JOIN p q ON q.release_tag = s.release_tag AND q.provision_id = s.step WHERE s.at < s.links GROUP BY 1, 2)"""
_PREV = """neighbours AS (
  SELECT release_tag, provision_id, lag(provision_id) OVER w AS previous_id, lead(provision_id) OVER w AS next_id
  FROM p WINDOW w AS (PARTITION BY release_tag, act_id ORDER BY sequence, provision_id))"""
_OUTLINE = f"""{_DOWN},
lv AS (SELECT p.*, coalesce(d.links, p.depth) AS level FROM p LEFT JOIN down d ON d.release_tag = p.release_tag AND d.provision_id = p.provision_id),
outl AS (
  SELECT a.release_tag, a.act_id, a.provision_id, CASE WHEN b.provision_id IS NOT NULL AND a.level = 1 THEN a.parent_provision_id END AS under, a.level = 0 AS is_top
  FROM (SELECT * FROM lv WHERE level <= 1) a LEFT JOIN (SELECT release_tag, provision_id FROM lv WHERE level = 0) b
  ON b.release_tag = a.release_tag AND b.provision_id = a.parent_provision_id)"""

SQL = {
    "tree_contents": f"WITH RECURSIVE {_CONTENTS} SELECT * FROM contents",
    "tree_contents_filtered": f"WITH RECURSIVE {_CONTENTS} SELECT * FROM contents WHERE act_id = 'qm-federal-constitution-1994' AND depth <= 1",
    "tree_subtree": f"WITH RECURSIVE {_DOWN} SELECT s.release_tag, s.provision_id, s.links - s.at AS distance FROM steps s WHERE s.step = '{SECTION}'",
    "tree_subtree_interval": f"""WITH RECURSIVE {_CONTENTS}
SELECT c.release_tag, c.provision_id, c.position, max(b.position) AS subtree_end
FROM contents c JOIN steps s ON s.release_tag = c.release_tag AND s.step = c.provision_id
JOIN contents b ON b.release_tag = s.release_tag AND b.provision_id = s.provision_id GROUP BY ALL""",
    "tree_breadcrumbs": f"WITH RECURSIVE {_DOWN}, {_CRUMBS} SELECT * FROM crumbs",
    "tree_previous_next": f"WITH {P_SQL}, {_PREV} SELECT * FROM neighbours",
    "tree_inherited_heading": f"""WITH RECURSIVE {_DOWN}
SELECT s.release_tag, s.provision_id, max_by(q.heading, s.at) AS heading FROM steps s
JOIN p q ON q.release_tag = s.release_tag AND q.provision_id = s.step WHERE trim(q.heading) <> '' GROUP BY 1, 2""",
    "tree_siblings": f"""WITH {P_SQL}
SELECT release_tag, provision_id, row_number() OVER (PARTITION BY release_tag, act_id, parent_provision_id ORDER BY sibling_order NULLS FIRST, provision_id) AS position,
  count(*) OVER (PARTITION BY release_tag, act_id, parent_provision_id) AS n_siblings FROM p""",
    "tree_outline": f"WITH RECURSIVE {_OUTLINE} SELECT * FROM outl",
    "tree_outline_count": f"WITH RECURSIVE {_OUTLINE} SELECT release_tag, act_id, count(*) AS n_nodes FROM outl GROUP BY 1, 2",
    "tree_relative_depth": f"""WITH {P_SQL}
SELECT a.release_tag, a.provision_id, coalesce(a.depth - b.depth, 1) AS relative_depth
FROM p a LEFT JOIN p b ON b.release_tag = a.release_tag AND b.provision_id = '{SECTION}' WHERE starts_with(a.provision_id, '{SECTION}.')""",
    "provision_detail": f"""WITH RECURSIVE {_DOWN}, {_CRUMBS}, {_PREV},
src AS (SELECT release_tag, provision_id, any_value(array_to_string(list_sort(list_distinct(source_ids)), ',')) AS sources FROM provisions WHERE {READY} GROUP BY 1, 2),
below AS (SELECT release_tag, step AS provision_id, count(*) AS n FROM steps s WHERE s.at < s.links GROUP BY 1, 2),
cit AS (SELECT release_tag, source_provision_id AS provision_id, string_agg(citation_id, ',' ORDER BY citation_id) AS c
  FROM (SELECT DISTINCT release_tag, citation_id, source_provision_id FROM citations WHERE {READY}) GROUP BY 1, 2)
SELECT p.release_tag, p.provision_id, p.act_id, src.sources, n.previous_id, n.next_id, coalesce(crumbs.breadcrumb, '') AS breadcrumb,
  coalesce(below.n, 0) AS n_descendants, coalesce(cit.c, '') AS citations
FROM p LEFT JOIN src USING (release_tag, provision_id) LEFT JOIN neighbours n USING (release_tag, provision_id)
LEFT JOIN crumbs USING (release_tag, provision_id) LEFT JOIN below USING (release_tag, provision_id) LEFT JOIN cit USING (release_tag, provision_id)""",
    "provision_payload": f"""WITH RECURSIVE {_DOWN},
m AS (SELECT s.release_tag, s.step AS provision_id, s.provision_id AS member, q.sequence FROM steps s JOIN p q ON q.release_tag = s.release_tag AND q.provision_id = s.provision_id),
below AS (SELECT release_tag, provision_id, string_agg(member, ',' ORDER BY sequence, member) AS x FROM m WHERE member <> provision_id GROUP BY 1, 2),
src AS (SELECT DISTINCT release_tag, provision_id AS member, unnest(source_ids) AS source_id FROM provisions WHERE {READY}),
named AS (SELECT DISTINCT m.release_tag, m.provision_id, source_id FROM m JOIN src USING (release_tag, member)),
held AS (SELECT n.release_tag, n.provision_id, count(*) AS n_sources, string_agg(h.source_id, ',' ORDER BY h.source_id) AS x FROM named n
  LEFT JOIN (SELECT DISTINCT release_tag, source_id FROM sources) h ON h.release_tag = n.release_tag AND h.source_id = n.source_id GROUP BY 1, 2),
ac AS (SELECT DISTINCT release_tag, act_id, official_title FROM acts WHERE {READY}),
c AS (SELECT DISTINCT release_tag, citation_id, source_provision_id AS member, target_act_id, target_provision_id FROM citations WHERE {READY}),
cit AS (SELECT m.release_tag, m.provision_id, string_agg(c.citation_id || '>' || c.target_act_id || coalesce('/' || t.provision_id, ''), ',' ORDER BY m.sequence, c.citation_id) AS x
  FROM m JOIN c USING (release_tag, member) JOIN ac ON ac.release_tag = c.release_tag AND ac.act_id = c.target_act_id
  LEFT JOIN p t ON t.release_tag = c.release_tag AND t.act_id = c.target_act_id AND t.provision_id = c.target_provision_id GROUP BY 1, 2)
SELECT d.release_tag, d.provision_id, ac.official_title, coalesce(below.x, '') AS descendants, coalesce(held.x, '') AS sources, coalesce(cit.x, '') AS citations, coalesce(held.n_sources, 0) AS n_sources
FROM down d JOIN ac ON ac.release_tag = d.release_tag AND ac.act_id = d.act_id LEFT JOIN below ON below.release_tag = d.release_tag AND below.provision_id = d.provision_id
LEFT JOIN held ON held.release_tag = d.release_tag AND held.provision_id = d.provision_id LEFT JOIN cit ON cit.release_tag = d.release_tag AND cit.provision_id = d.provision_id""",
    "list_acts": f"""WITH a AS (SELECT DISTINCT release_tag, act_id, official_title, short_title, year, number, citation, text_kind, status, title_keys FROM acts WHERE {READY}),
n AS (SELECT *, row_number() OVER (PARTITION BY release_tag ORDER BY title_keys[1], year DESC, act_id) AS rn, count(*) OVER (PARTITION BY release_tag) AS total FROM a)
SELECT release_tag, act_id, official_title, short_title, year, number, citation, text_kind, status, total FROM n WHERE rn > 10 AND rn <= 30""",
    "act_sources": f"""WITH r AS (
  SELECT release_tag, act_id, i, json_extract_string(canonical_record, '$.source_refs[' || CAST(i AS VARCHAR) || '].source_id') AS source_id
  FROM (SELECT *, unnest(range(CAST(json_array_length(canonical_record, '$.source_refs') AS BIGINT))) AS i FROM (
    SELECT release_tag, act_id, min(canonical_record) AS canonical_record FROM acts WHERE {READY} GROUP BY 1, 2))),
f AS (SELECT release_tag, act_id, source_id, row_number() OVER (PARTITION BY release_tag, act_id ORDER BY min(i)) AS position FROM r GROUP BY 1, 2, 3)
SELECT f.release_tag, f.act_id, f.position, f.source_id, s.document_title, s.source_class
FROM f JOIN (SELECT DISTINCT release_tag, source_id, document_title, source_class FROM sources WHERE {READY}) s USING (release_tag, source_id)""",
    "incomplete_acts": f"""WITH a AS (SELECT DISTINCT release_tag, act_id, unnest(list_distinct(source_ids)) AS source_id FROM acts WHERE {READY}),
g AS (SELECT a.release_tag, a.act_id, count(*) AS n_named, count(s.source_id) AS n_found FROM a
  LEFT JOIN (SELECT DISTINCT release_tag, source_id FROM sources) s USING (release_tag, source_id) GROUP BY 1, 2)
SELECT * FROM g WHERE n_named <> n_found""",
    "citation_targets": f"""SELECT c.release_tag, c.citation_id, c.source_provision_id, c.target_act_id, a.official_title AS target_title, c.target_provision_id, p.display_label AS target_label
FROM (SELECT DISTINCT release_tag, citation_id, source_provision_id, target_act_id, target_provision_id FROM citations WHERE {READY}) c
JOIN (SELECT DISTINCT release_tag, act_id, official_title FROM acts) a ON a.release_tag = c.release_tag AND a.act_id = c.target_act_id
LEFT JOIN (SELECT DISTINCT release_tag, provision_id, display_label FROM provisions) p ON p.release_tag = c.release_tag AND p.provision_id = c.target_provision_id""",
    "release_counts": " UNION ALL ".join(
        f"SELECT release_tag, count(DISTINCT {k}) AS n_rows, '{t}' AS table_name FROM {t} WHERE {READY} GROUP BY 1"
        for t, k in (("acts", "act_id"), ("provisions", "provision_id"), ("sources", "source_id"), ("citations", "citation_id"))),
    "fidelity_histogram": f"WITH {P_SQL} SELECT release_tag, text_fidelity, count(*) AS n FROM p GROUP BY 1, 2",
    "schema_versions": "SELECT release_tag, string_agg(DISTINCT schema_version, ',' ORDER BY schema_version) AS versions FROM ("
    + " UNION ALL ".join(f"SELECT release_tag, schema_version FROM {t}" for t in ("acts", "provisions", "sources", "citations")) + f") WHERE {READY} GROUP BY 1",
    "ordered_id_digest": f"""WITH {P_SQL}
SELECT release_tag, act_id, 'sha256:' || sha256(string_agg(provision_id || chr(10), '' ORDER BY sequence, provision_id)) AS digest FROM p GROUP BY 1, 2""",
    "response_etag": f"""SELECT DISTINCT release_tag, source_id, '"' || sha256(concat_ws('|', source_id, document_title, document_publisher, page_count)) || '"' AS etag,
  concat_ws(', ', document_title, document_publisher, 'pages ' || page_count) AS line FROM sources WHERE {READY}""",
}
