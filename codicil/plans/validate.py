"""Queries of the integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil import vocab
from codicil.functions.blocks import flatten_blocks
from codicil.operators import hierarchy as H
from codicil.operators import tree
from codicil.operators import validate as V
from codicil.plans.common import NODE, P_SQL, READY, clean, provision_hierarchy, reading_hierarchy, ready
from codicil.plans.tree import _CONTENTS

#: Columns that repeat a member of the record, by table: key, and column to path.
MIRRORED = {
    "provisions": ("provision_id", {
        "schema_version": "$.schema_version", "parent_provision_id": "$.parent_provision_id", "node_type": "$.node_type", "display_label": "$.display_label", "heading": "$.heading", "text_fidelity": "$.text_fidelity",
        "sibling_order": "$.order", "provision_id": "$.provision_id"}),
    "acts": ("act_id", {
        "schema_version": "$.schema_version", "act_id": "$.act_id", "jurisdiction": "$.jurisdiction", "country_code": "$.country_code", "official_title": "$.titles.official", "short_title": "$.titles.short", "year": "$.year",
        "number": "$.number", "citation": "$.citation", "text_kind": "$.text_kind", "status": "$.status", "checked_through_date": "$.checked_through_date"}),
    "sources": ("source_id", {
        "schema_version": "$.schema_version", "source_id": "$.source_id", "document_title": "$.document_title", "document_publisher": "$.document_publisher", "language": "$.language", "source_class": "$.source_class", "page_count": "$.page_count"}),
    "citations": ("citation_id", {
        "schema_version": "$.schema_version", "citation_id": "$.citation_id", "source_provision_id": "$.source_provision_id", "source_block_id": "$.source_block_id", "target_act_id": "$.target.act_id", "target_provision_id": "$.target.provision_id"}),
}


def _p(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return clean(spark, d, "provisions", *NODE, *more)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return flatten_blocks(clean(spark, d, "provisions", "canonical_record"))


def valid_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    from codicil.plans.common import KEYS

    return V.all_of(*[V.duplicate_keys(ready(spark, d, t).select("release_tag", k), k) for t, k in KEYS.items()])


def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.all_of(
        V.patterns(clean(spark, d, "acts"), "act_id", "act_id"), V.patterns(clean(spark, d, "provisions"), "provision_id", "provision_id"),
        V.patterns(clean(spark, d, "sources"), "source_id", "source_id"), V.patterns(clean(spark, d, "citations"), "citation_id", "citation_id"))


def valid_ids_across(spark: SparkSession, d: str) -> DataFrame:
    return V.duplicate_ids_across(*[(clean(spark, d, t), k) for t, k in (("acts", "act_id"), ("provisions", "provision_id"), ("sources", "source_id"), ("citations", "citation_id"))])


def valid_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    p, a, s = _p(spark, d), clean(spark, d, "acts", "status", "text_kind"), clean(spark, d, "sources", "source_class")
    return V.all_of(
        V.closed_values(p, "provision_id", "node_type", vocab.NODE_TYPES), V.closed_values(p, "provision_id", "text_fidelity", vocab.TEXT_FIDELITY),
        V.closed_values(a, "act_id", "status", vocab.ACT_STATUS), V.closed_values(a, "act_id", "text_kind", vocab.TEXT_KINDS),
        V.closed_values(s, "source_id", "source_class", vocab.SOURCE_CLASSES))


def valid_references(spark: SparkSession, d: str) -> DataFrame:
    p, a, c = _p(spark, d), clean(spark, d, "acts"), clean(spark, d, "citations", "source_provision_id", "target_act_id", "target_provision_id")
    return V.all_of(
        V.missing_target(p, "provision_id", "act_id", a, "act_id", "no_act"), V.missing_target(p, "provision_id", "parent_provision_id", p, "provision_id", "no_parent"),
        V.missing_target(c, "citation_id", "source_provision_id", p, "provision_id", "no_citing_provision"),
        V.missing_target(c, "citation_id", "target_act_id", a, "act_id", "no_target_act"), V.missing_target(c, "citation_id", "target_provision_id", p, "provision_id", "no_target_provision"))


def valid_tree(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d)
    return V.all_of(V.foreign_parent(p), V.owner_prefix(p), V.incomplete_siblings(p), V.depth_against_parent(p), V.positions(p))


def valid_sequence(spark: SparkSession, d: str) -> DataFrame:
    return V.sequence_gaps(_p(spark, d))


def valid_reading_order(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d, "canonical_record")
    return V.reading_order(tree.contents(p, reading_hierarchy(spark, d)), p)


def valid_no_cycle(spark: SparkSession, d: str) -> DataFrame:
    h = provision_hierarchy(spark, d)
    return V.violations(h.where(F.col("status").isin(H.ON_CYCLE, H.CYCLE)), "parent_cycle", F.col("provision_id"), F.col("status"))


def valid_reference_keys(spark: SparkSession, d: str) -> DataFrame:
    g = _p(spark, d).groupBy("release_tag", "act_id", "reference_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return V.violations(g, "reference_key_used_twice", F.col("act_id"), F.col("reference_key"))


def valid_mirrors(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the four tables that repeats a member of its record."""
    parts = [V.mirrors(ready(spark, d, name).select("release_tag", "canonical_record", *dict.fromkeys([key, *columns])), key, columns) for name, (key, columns) in MIRRORED.items()]
    return V.all_of(*parts).distinct()


def valid_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Sources that an act's status or dates rest on without its naming them, and named ones that the release does not hold."""
    acts = clean(spark, d, "acts", "canonical_record")
    return V.all_of(V.unnamed_evidence(acts), V.missing_named(acts, clean(spark, d, "sources")))


def valid_sources_of_act(spark: SparkSession, d: str) -> DataFrame:
    return V.unlinked_sources(clean(spark, d, "acts", "source_ids"), _p(spark, d, "source_ids"))


def valid_pages(spark: SparkSession, d: str) -> DataFrame:
    return V.pages_beyond(_blocks(spark, d), clean(spark, d, "sources", "page_count"))


def valid_content_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.duplicate_content_ids(_blocks(spark, d))


def valid_citations(spark: SparkSession, d: str) -> DataFrame:
    c = clean(spark, d, "citations", "source_provision_id", "source_block_id", "target_act_id", "target_provision_id", "canonical_record")
    return V.all_of(V.citation_ranges(c, _blocks(spark, d)), V.target_mismatch(c), V.citation_prefix(c))


def valid_grids(spark: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(spark, d)
    cells = blocks.where("kind = 'cell'")
    return V.all_of(V.cells_beyond(cells), V.cell_overlap(cells), V.header_references(cells), V.blank_with_content(cells, blocks), V.segment_rows(blocks))


def valid_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Members, types and closed values of every record of every kind."""
    from codicil.functions.records import check_records

    kinds = (("act", "acts", "act_id"), ("provision", "provisions", "provision_id"), ("source", "sources", "source_id"), ("citation", "citations", "citation_id"))
    parts = [check_records(ready(spark, d, t).select("release_tag", k, "canonical_record"), kind, k).withColumn("kind", F.lit(kind)) for kind, t, k in kinds]
    return V.all_of(*parts).groupBy("kind", "path", "message").agg(F.countDistinct("release_tag", "key").alias("n_records"))


def draft_block_issues(spark: SparkSession, d: str) -> DataFrame:
    from codicil.operators.drafts import block_issues
    from codicil.session import table

    return block_issues(table(spark, d, "draft_text_blocks"))


def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return b.where(F.col("kind").isin(*vocab.TEXT_BLOCK_KINDS)).select("release_tag", "provision_id", "block_id", "kind", F.char_length("text").cast("long").alias("n_chars"))


def content_characters(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d)
    return b.where(F.col("kind").isin(*vocab.TEXT_BLOCK_KINDS)).groupBy("release_tag", F.substring_index("provision_id", ":", 1).alias("act_id")).agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def source_locations(spark: SparkSession, d: str) -> DataFrame:
    s = clean(spark, d, "sources", "canonical_record")
    urls = s.select("release_tag", "source_id", F.explode(F.from_json(F.get_json_object("canonical_record", "$.locations"), "array<struct<url:string>>")).alias("x"))
    return urls.select("release_tag", "source_id", F.col("x.url").alias("url"), V.bad_url(F.col("x.url")).alias("problem"))


def act_directories(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d, "acts").select("act_id", V.act_directory(F.col("act_id")).alias("directory")).distinct()


def grid_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as rectangles of a grid: (supplier mod 50 x part mod 50), to exercise overlap at volume."""
    from codicil.session import table

    li = table(spark, d, "lineitem")
    cells = li.select(F.lit("grid").alias("release_tag"), F.col("l_returnflag").alias("provision_id"), F.col("l_linestatus").alias("table_id"), (F.col("l_suppkey") % 50 + 1).cast("int").alias("row_index"),
                      (F.col("l_partkey") % 50 + 1).cast("int").alias("column_start"), F.least(F.lit(3), F.col("l_linenumber")).alias("row_span"), F.lit(2).alias("column_span"))
    return V.cell_overlap(cells)


def key_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines and customers without orders: anti joins at volume."""
    from codicil.session import table

    o, li, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    empty = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(F.lit("order_without_lines").alias("rule"), F.col("o_orderkey").alias("key"))
    idle = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.lit("customer_without_orders").alias("rule"), F.col("c_custkey").alias("key"))
    return empty.unionByName(idle)


def json_field_mirror(spark: SparkSession, d: str) -> DataFrame:
    """A member of a JSON column beside the parsed value, null-safely compared."""
    from codicil.session import table

    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.try_cast("bigint").alias("k"), (~k.eqNullSafe(F.col("user_id").cast("string"))).alias("differs"))


QUERIES = (
    valid_duplicate_keys, valid_ids, valid_ids_across, valid_vocabularies, valid_references, valid_tree, valid_sequence, valid_reading_order, valid_no_cycle,
    valid_reference_keys, valid_mirrors, valid_evidence, valid_sources_of_act, valid_pages, valid_content_ids, valid_citations, valid_grids, valid_shapes, draft_block_issues, content_blocks, content_characters,
    source_locations, act_directories, grid_overlap, key_integrity, json_field_mirror,
)

_V = "'{}' AS rule, release_tag, {} AS key, {} AS detail"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_REFS = (
    ("provisions", "provision_id", "act_id", "acts", "act_id", "no_act"), ("provisions", "provision_id", "parent_provision_id", "provisions", "provision_id", "no_parent"),
    ("citations", "citation_id", "source_provision_id", "provisions", "provision_id", "no_citing_provision"), ("citations", "citation_id", "target_act_id", "acts", "act_id", "no_target_act"),
    ("citations", "citation_id", "target_provision_id", "provisions", "provision_id", "no_target_provision"),
)
_TEXTS = f"""rec AS (SELECT release_tag, provision_id, min(canonical_record) AS j FROM provisions WHERE {READY} GROUP BY 1, 2),
nodes AS (SELECT r.release_tag, r.provision_id, t.path AS node_path, t.fullkey, t.key, t.atom ->> '$' AS value FROM rec r, json_tree(r.j) t WHERE starts_with(t.fullkey, '$.content_blocks')),
ids AS (SELECT release_tag, provision_id, node_path, value AS block_id FROM nodes WHERE key IN ('block_id', 'item_id', 'cell_id')),
texts AS (SELECT i.release_tag, i.provision_id, i.block_id, n.value AS text, k.value AS kind FROM ids i
  JOIN nodes n ON n.release_tag = i.release_tag AND n.provision_id = i.provision_id AND n.node_path = i.node_path AND n.key = 'text'
  LEFT JOIN nodes k ON k.release_tag = i.release_tag AND k.provision_id = i.provision_id AND k.node_path = i.node_path AND k.key = 'kind')"""

SQL = {
    "valid_duplicate_keys": _union(*[
        f"SELECT {_V.format('duplicate_key', k, 'CAST(count(*) AS VARCHAR)')} FROM {t} WHERE {READY} GROUP BY release_tag, {k} HAVING count(*) > 1"
        for t, k in (("acts", "act_id"), ("provisions", "provision_id"), ("sources", "source_id"), ("citations", "citation_id"))]),
    "valid_ids": _union(*[
        f"SELECT DISTINCT {_V.format('bad_' + k, k, chr(39) * 2)} FROM {t} WHERE {READY} AND NOT regexp_matches({k}, '{vocab.ID_PATTERNS[k]}')"
        for t, k in (("acts", "act_id"), ("provisions", "provision_id"), ("sources", "source_id"), ("citations", "citation_id"))]),
    "valid_ids_across": "WITH i AS (" + _union(*[
        f"SELECT DISTINCT release_tag, {k} AS id FROM {t} WHERE {READY}" for t, k in (("acts", "act_id"), ("provisions", "provision_id"), ("sources", "source_id"), ("citations", "citation_id"))])
    + f") SELECT {_V.format('id_used_twice', 'id', 'CAST(count(*) AS VARCHAR)')} FROM i GROUP BY release_tag, id HAVING count(*) > 1",
    "valid_vocabularies": _union(*[
        f"SELECT DISTINCT {_V.format('unknown_' + c, k, c)} FROM {t} WHERE {READY} AND {c} NOT IN ({', '.join(repr(x) for x in allowed)})"
        for t, k, c, allowed in (
            ("provisions", "provision_id", "node_type", vocab.NODE_TYPES), ("provisions", "provision_id", "text_fidelity", vocab.TEXT_FIDELITY), ("acts", "act_id", "status", vocab.ACT_STATUS),
            ("acts", "act_id", "text_kind", vocab.TEXT_KINDS), ("sources", "source_id", "source_class", vocab.SOURCE_CLASSES))]),
    "valid_references": _union(*[
        f"SELECT DISTINCT {_V.format(rule, 'x.' + k, 'x.' + c)} FROM {t} x WHERE {READY} AND x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {u} y WHERE y.release_tag = x.release_tag AND y.{uk} = x.{c})"
        for t, k, c, u, uk, rule in _REFS]),
    "valid_tree": f"WITH {P_SQL} " + _union(
        f"SELECT {_V.format('parent_in_other_act', 'provision_id', 'parent_provision_id')} FROM p WHERE split_part(parent_provision_id, ':', 1) <> act_id",
        f"SELECT {_V.format('id_outside_act', 'provision_id', 'act_id')} FROM p WHERE NOT starts_with(provision_id, act_id || ':')",
        """SELECT 'sibling_order' AS rule, release_tag, coalesce(parent_provision_id, act_id) AS key, concat_ws('/', min(sibling_order), max(sibling_order), count(DISTINCT sibling_order), count(*)) AS detail
FROM p GROUP BY release_tag, act_id, parent_provision_id HAVING NOT (count(*) = count(DISTINCT sibling_order) AND min(sibling_order) = 1 AND max(sibling_order) = count(*)) OR count(DISTINCT sibling_order) = 0""",
        """SELECT 'depth', a.release_tag, a.provision_id, concat_ws('/', a.depth, CASE WHEN a.parent_provision_id IS NULL THEN 0 ELSE b.depth + 1 END)
FROM p a LEFT JOIN p b ON b.release_tag = a.release_tag AND b.provision_id = a.parent_provision_id
WHERE CASE WHEN a.parent_provision_id IS NULL THEN 0 ELSE b.depth + 1 END IS NOT NULL AND a.depth IS DISTINCT FROM CASE WHEN a.parent_provision_id IS NULL THEN 0 ELSE b.depth + 1 END""",
        "SELECT 'not_positive', release_tag, provision_id, concat_ws('/', sibling_order, sequence, depth) FROM p WHERE sibling_order < 1 OR sequence < 1 OR depth < 0"),
    "valid_sequence": f"""WITH {P_SQL}, s AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY release_tag, act_id ORDER BY sequence, provision_id), 0) AS before FROM p)
SELECT {_V.format('sequence', 'provision_id', "concat_ws('/', before, sequence)")} FROM s WHERE sequence <> before + 1""",
    "draft_block_issues": """SELECT draft_block_id, problem FROM (SELECT draft_block_id, CASE
  WHEN kind IS NULL OR kind NOT IN ('text', 'quoted_text', 'formula', 'signature', 'list', 'table') THEN 'unknown_kind'
  WHEN kind NOT IN ('list', 'table') AND trim(coalesce(text, '')) = '' THEN 'blank_text' WHEN pdf_pages IS NULL OR len(pdf_pages) = 0 THEN 'no_pages'
  WHEN list_min(pdf_pages) < 1 THEN 'not_positive' WHEN pdf_pages <> list_sort(list_distinct(pdf_pages)) THEN 'not_increasing' END AS problem FROM draft_text_blocks) WHERE problem IS NOT NULL""",
    "valid_reading_order": f"""WITH RECURSIVE {_CONTENTS},
r AS (SELECT c.release_tag, c.provision_id, c.position, row_number() OVER (PARTITION BY c.release_tag, c.act_id ORDER BY p.sequence, c.provision_id) AS rank
  FROM contents c JOIN p ON p.release_tag = c.release_tag AND p.provision_id = c.provision_id)
SELECT {_V.format('reading_order', 'provision_id', "concat_ws('/', rank, position)")} FROM r WHERE rank <> position""",
    "valid_pages": f"""WITH rec AS (SELECT release_tag, provision_id, min(canonical_record) AS j FROM provisions WHERE {READY} GROUP BY 1, 2),
n AS (SELECT r.release_tag, r.provision_id, t.path AS node_path, t.key, t.atom ->> '$' AS v FROM rec r, json_tree(r.j) t WHERE starts_with(t.fullkey, '$.content_blocks')),
s AS (SELECT DISTINCT a.release_tag, a.provision_id, a.v AS source_id, CAST(b.v AS INT) AS page FROM n a
  JOIN n b ON b.release_tag = a.release_tag AND b.provision_id = a.provision_id AND b.node_path = a.node_path AND b.key = 'pdf_page' WHERE a.key = 'source_id'),
c AS (SELECT release_tag, source_id, min(page_count) AS page_count FROM sources GROUP BY 1, 2)
SELECT {_V.format('page_beyond_source', 'provision_id', "concat_ws('/', page, page_count)")} FROM s JOIN c USING (release_tag, source_id) WHERE page < 1 OR page > page_count""",
    "valid_reference_keys": f"WITH {P_SQL} SELECT {_V.format('reference_key_used_twice', 'act_id', 'reference_key')} FROM p GROUP BY release_tag, act_id, reference_key HAVING count(*) > 1",
    "valid_mirrors": _union(*[
        f"SELECT DISTINCT {_V.format('column_differs_from_record', key, repr(c))} FROM {t} WHERE {READY} AND CAST({c} AS VARCHAR) IS DISTINCT FROM (canonical_record ->> '{path}')" for t, (key, columns) in MIRRORED.items() for c, path in columns.items()]),
    "valid_evidence": f"""WITH a AS (SELECT release_tag, act_id, min(canonical_record) AS j FROM acts WHERE {READY} GROUP BY 1, 2),
e AS (SELECT DISTINCT release_tag, act_id, unnest(list_concat(CAST(json_extract_string(j, '$.status_source_ids[*]') AS VARCHAR[]), CAST(json_extract_string(j, '$.dates.*.source_ids[*]') AS VARCHAR[]))) AS s FROM a),
n AS (SELECT DISTINCT release_tag, act_id, unnest(CAST(json_extract_string(j, '$.source_refs[*].source_id') AS VARCHAR[])) AS s FROM a)
SELECT {_V.format('evidence_not_named', 'act_id', 's')} FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.release_tag = e.release_tag AND n.act_id = e.act_id AND n.s = e.s)
UNION ALL SELECT {_V.format('named_source_missing', 'act_id', 's')} FROM n WHERE NOT EXISTS (SELECT 1 FROM sources x WHERE x.release_tag = n.release_tag AND x.source_id = n.s)""",
    "valid_sources_of_act": f"""WITH o AS (SELECT DISTINCT release_tag, act_id, provision_id, unnest(source_ids) AS s FROM provisions WHERE {READY}),
n AS (SELECT DISTINCT release_tag, act_id, unnest(source_ids) AS s FROM acts)
SELECT {_V.format('source_not_of_act', 'provision_id', 's')} FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.release_tag = o.release_tag AND n.act_id = o.act_id AND n.s = o.s)""",
    "content_blocks": f"WITH {_TEXTS} SELECT release_tag, provision_id, block_id, kind, length(text) AS n_chars FROM texts WHERE kind IS NOT NULL",
    "content_characters": f"""WITH {_TEXTS} SELECT a.release_tag, a.act_id, CAST(sum(length(t.text)) AS BIGINT) AS n_chars
FROM texts t JOIN (SELECT DISTINCT release_tag, provision_id, split_part(provision_id, ':', 1) AS act_id FROM provisions) a USING (release_tag, provision_id) WHERE t.kind IS NOT NULL GROUP BY 1, 2""",
    "valid_content_ids": f"WITH {_TEXTS} SELECT {_V.format('content_id_used_twice', 'provision_id', 'block_id')} FROM ids GROUP BY release_tag, provision_id, block_id HAVING count(*) > 1",
    "valid_citations": f"""WITH {_TEXTS},
c AS (SELECT release_tag, citation_id, min(source_provision_id) AS provision_id, min(source_block_id) AS block_id, min(target_act_id) AS ta, min(target_provision_id) AS tp,
  CAST(min(canonical_record ->> '$.text_range.start') AS INT) AS s, CAST(min(canonical_record ->> '$.text_range.end') AS INT) AS e FROM citations WHERE {READY} GROUP BY 1, 2),
w AS (SELECT c.release_tag, citation_id, CASE WHEN t.text IS NULL THEN 'no_block' WHEN NOT (s >= 0 AND s < e) THEN 'reversed' WHEN e > length(t.text) THEN 'beyond_text' END AS why
  FROM c LEFT JOIN texts t ON t.release_tag = c.release_tag AND t.provision_id = c.provision_id AND t.block_id = c.block_id)
SELECT {_V.format('citation_range', 'citation_id', 'why')} FROM w WHERE why IS NOT NULL
UNION ALL SELECT {_V.format('target_act_differs', 'citation_id', 'tp')} FROM c WHERE split_part(tp, ':', 1) <> ta
UNION ALL SELECT {_V.format('citation_id_outside_act', 'citation_id', 'provision_id')} FROM c WHERE NOT starts_with(citation_id, 'citation:' || split_part(provision_id, ':', 1) || ':')""",
    "source_locations": f"""WITH s AS (SELECT release_tag, source_id, min(canonical_record) AS j FROM sources WHERE {READY} GROUP BY 1, 2),
u AS (SELECT release_tag, source_id, unnest(CAST(json_extract_string(j, '$.locations[*].url') AS VARCHAR[])) AS url FROM s)
SELECT release_tag, source_id, url, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' WHEN contains(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@') THEN 'credentials'
  WHEN regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', '') = '' THEN 'host' WHEN contains(url, '#') THEN 'fragment' END AS problem FROM u""",
    "act_directories": f"""SELECT DISTINCT act_id, regexp_extract(act_id, '^([a-z]{{2}})-', 1) || '/' || regexp_extract(act_id, '^[a-z]{{2}}-(.*?)-[0-9]{{4}}-', 1) || '/acts/'
  || regexp_extract(act_id, '-([0-9]{{4}})-', 1) || '/' || regexp_extract(act_id, '-[0-9]{{4}}-(.*)$', 1) AS directory FROM acts WHERE {READY}""",
    "grid_overlap": """WITH c AS (SELECT l_returnflag AS p, l_linestatus AS t, l_suppkey % 50 + 1 AS r0, l_partkey % 50 + 1 AS c0, least(3, l_linenumber) AS rs FROM lineitem),
g AS (SELECT p, t, c0, unnest(range(r0, r0 + rs)) AS r FROM c), h AS (SELECT p, t, r, unnest(range(c0, c0 + 2)) AS c FROM g)
SELECT 'cells_overlap' AS rule, 'grid' AS release_tag, p AS key, concat_ws('/', t, r, c) AS detail FROM h GROUP BY p, t, r, c HAVING count(*) > 1""",
    "key_integrity": """SELECT 'order_without_lines' AS rule, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customer_without_orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "json_field_mirror": "SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k, (props ->> '$.k') IS DISTINCT FROM CAST(user_id AS VARCHAR) AS differs FROM events",
}
