"""Rules over tables in which known faults have been put, since the tables as they are hold none of their kind.

Every row of the tables goes through; the faults depend on a row's own numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil import vocab
from codicil.operators import pages as P
from codicil.operators import structure as S
from codicil.operators import validate as V
from codicil.operators.drafts import block_issues
from codicil.plans.common import NODE, P_SQL, READY, clean, ready
from codicil.plans.pages import _NOTE, _SIG
from codicil.plans.validate import _TEXTS, _V, MIRRORED, _blocks, _union
from codicil.session import table


def marred_ids_across(spark: SparkSession, d: str) -> DataFrame:
    """Citations under the ids of the provisions that cite."""
    return V.duplicate_ids_across((clean(spark, d, "provisions"), "provision_id"), (clean(spark, d, "citations", "source_provision_id"), "source_provision_id"))


def marred_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    p = clean(spark, d, "provisions", "sequence", "node_type", "text_fidelity").withColumns({
        "node_type": F.when(F.col("sequence") % 5 == 0, "clause").otherwise(F.col("node_type")), "text_fidelity": F.when(F.col("sequence") % 7 != 0, F.col("text_fidelity"))})
    return V.all_of(V.closed_values(p, "provision_id", "node_type", vocab.NODE_TYPES), V.closed_values(p, "provision_id", "text_fidelity", vocab.TEXT_FIDELITY))


def marred_reference_keys(spark: SparkSession, d: str) -> DataFrame:
    """Reference keys without their figures."""
    p = clean(spark, d, "provisions", "act_id", "reference_key").withColumn("reference_key", F.regexp_replace("reference_key", "[0-9]+", "#"))
    return V.violations(p.groupBy("release_tag", "act_id", "reference_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "reference_key_used_twice", F.col("act_id"), F.col("reference_key"))


def marred_mirrors(spark: SparkSession, d: str) -> DataFrame:
    columns = MIRRORED["provisions"][1]
    rows = ready(spark, d, "provisions").select("release_tag", "provision_id", "canonical_record", "sequence", *columns).withColumns({
        "heading": F.when(F.col("sequence") % 3 != 0, F.col("heading")), "display_label": F.when(F.col("sequence") % 4 == 0, F.lit("0.")).otherwise(F.col("display_label"))})
    return V.mirrors(rows, "provision_id", columns).distinct()


def marred_content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content ids cut to five characters."""
    return V.duplicate_content_ids(_blocks(spark, d).withColumn("block_id", F.left("block_id", F.lit(5))))


def marred_draft_blocks(spark: SparkSession, d: str) -> DataFrame:
    b, n = table(spark, d, "draft_text_blocks").where("draft_block_id is not null"), F.col("draft_block_id") % 6
    return block_issues(b.withColumns({
        "kind": F.when(n == 0, "odd").otherwise(F.col("kind")), "text": F.when(n == 1, " ").otherwise(F.col("text")),
        "pdf_pages": F.when(n == 2, F.array().cast("array<int>")).when(n == 3, F.reverse("pdf_pages")).when(n == 4, F.array(F.lit(0), F.lit(3))).otherwise(F.col("pdf_pages"))}))


def marred_children(spark: SparkSession, d: str) -> DataFrame:
    """Sections some of whose subsections became paragraphs."""
    p = clean(spark, d, "provisions", "act_id", "parent_provision_id", "sequence", "node_type")
    kind = F.when((F.col("node_type") == "subsection") & (F.col("sequence") % 2 == 0), "paragraph").otherwise(F.col("node_type"))
    return S.mixed_children(p.select(F.concat_ws("|", "release_tag", "act_id").alias("scope"), F.col("provision_id").alias("node_id"), F.col("parent_provision_id").alias("parent_id"), kind.alias("node_type")))


def marred_grids(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables of four columns, their lines as cells of all sizes with references to the first line and to another one."""
    li = table(spark, d, "lineitem")
    cells = li.select(
        F.lit("grid").alias("release_tag"), F.col("l_orderkey").cast("string").alias("provision_id"), F.lit("t").alias("table_id"), F.lit("g").alias("row_group"), F.col("l_linenumber").cast("int").alias("row_index"),
        (F.col("l_partkey") % 4 + 1).cast("int").alias("column_start"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("row_span"), (F.col("l_partkey") % 3 + 1).cast("int").alias("column_span"), F.lit(4).alias("column_count"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("block_id"), F.when(F.col("l_linenumber") == 1, "header").otherwise("data").alias("role"),
        F.array(F.lit("c1"), F.concat(F.lit("c"), (F.col("l_suppkey") % 4 + 1).cast("string"))).alias("header_cell_ids"))
    return V.all_of(V.cells_beyond(cells), V.cell_overlap(cells), V.header_references(cells.withColumn("header_cell_ids", F.array_distinct("header_cell_ids"))))


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of their source with a header in print, a number above it on every fifth, a note on every seventh and a line SCHEDULES on every eleventh."""
    docs, n = table(spark, d, "documents").where("doc_id is not null"), F.col("doc_id")
    name = F.coalesce("source", F.lit("none"))
    head = F.concat(F.lit("Reports collected by "), name, F.lit(", page "), n.cast("string"))
    lines = F.array_compact(F.array(
        F.when(n % 5 == 0, n.cast("string")), head, F.regexp_replace(F.regexp_replace("text", "\n+", " "), "[\\[\\]]", " "), F.when(n % 7 == 0, F.lit("[Section 3 is\n altered]")), F.when(n % 7 == 1, F.lit("[no note of the editors]")), F.when(n % 11 == 0, F.lit("Schedules"))))
    return docs.select(name.alias("document"), n.alias("pdf_page"), F.array_join(lines, "\n").alias("text"))


def marred_headers(spark: SparkSession, d: str) -> DataFrame:
    return P.recurring_lines(_printed(spark, d))


def marred_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return P.exclusions(_printed(spark, d)).withColumn("source_line", F.col("source_line").cast("long"))


QUERIES = (
    marred_ids_across, marred_vocabularies, marred_reference_keys, marred_mirrors, marred_content_ids, marred_draft_blocks, marred_children, marred_grids, marred_headers, marred_exclusions,
)

_CELLS = """c AS (SELECT CAST(l_orderkey AS VARCHAR) AS p, CAST(l_linenumber AS INT) AS r, l_partkey % 4 + 1 AS c0, l_suppkey % 3 + 1 AS rs, l_partkey % 3 + 1 AS cs, 'c' || l_linenumber AS id,
  CASE WHEN l_linenumber = 1 THEN 'header' ELSE 'data' END AS role, list_distinct(['c1', 'c' || (l_suppkey % 4 + 1)]) AS refs FROM lineitem),
e AS (SELECT *, max(r) OVER (PARTITION BY p) AS last FROM c), g AS (SELECT p, c0, cs, unnest(range(r, r + rs)) AS rr FROM c), h AS (SELECT p, rr, unnest(range(c0, c0 + cs)) AS cc FROM g),
f AS (SELECT p, unnest(refs) AS ref FROM c)"""
_PRINTED = f"""printed AS (SELECT coalesce(source, 'none') AS document, doc_id AS pdf_page, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) END, 'Reports collected by ' || coalesce(source, 'none') || ', page ' || doc_id,
  regexp_replace(regexp_replace(text, '\\n+', ' ', 'g'), '[\\[\\]]', ' ', 'g'), CASE WHEN doc_id % 7 = 0 THEN '[Section 3 is' || chr(10) || ' altered]' WHEN doc_id % 7 = 1 THEN '[no note of the editors]' END, CASE WHEN doc_id % 11 = 0 THEN 'Schedules' END],
  lambda x: x IS NOT NULL), chr(10)) AS text FROM documents),
top AS (SELECT document, {_SIG.format('line')} AS signature FROM (SELECT document, unnest(string_split(text, chr(10))[:4]) AS line FROM printed)),
rec AS (SELECT t.document, signature, count(*) AS n FROM top t WHERE length(signature) >= 20 GROUP BY 1, 2 HAVING count(*) >= greatest(3, (SELECT (count(*) + 4) // 5 FROM printed s WHERE s.document = t.document)))"""

SQL = {
    "marred_ids_across": f"""WITH i AS (SELECT DISTINCT release_tag, provision_id AS id FROM provisions WHERE {READY} UNION ALL SELECT DISTINCT release_tag, source_provision_id FROM citations WHERE {READY})
SELECT {_V.format('id_used_twice', 'id', 'CAST(count(*) AS VARCHAR)')} FROM i GROUP BY release_tag, id HAVING count(*) > 1""",
    "marred_vocabularies": f"WITH {P_SQL} " + _union(
        f"SELECT {_V.format('unknown_node_type', 'provision_id', chr(39) + 'clause' + chr(39))} FROM p WHERE sequence % 5 = 0",
        f"SELECT {_V.format('unknown_text_fidelity', 'provision_id', "''")} FROM p WHERE sequence % 7 = 0"),
    "marred_reference_keys": f"""WITH {P_SQL}, k AS (SELECT release_tag, act_id, regexp_replace(reference_key, '[0-9]+', '#', 'g') AS k FROM p)
SELECT {_V.format('reference_key_used_twice', 'act_id', 'k')} FROM k GROUP BY release_tag, act_id, k HAVING count(*) > 1""",
    "marred_mirrors": f"""WITH r AS (SELECT DISTINCT release_tag, provision_id, sequence, canonical_record AS j FROM provisions WHERE {READY})
SELECT DISTINCT {_V.format('column_differs_from_record', 'provision_id', "'heading'")} FROM r WHERE sequence % 3 = 0 AND (j ->> '$.heading') IS NOT NULL
UNION ALL SELECT DISTINCT {_V.format('column_differs_from_record', 'provision_id', "'display_label'")} FROM r WHERE sequence % 4 = 0 AND (j ->> '$.display_label') IS DISTINCT FROM '0.'""",
    "marred_content_ids": f"WITH {_TEXTS}, s AS (SELECT release_tag, provision_id, left(block_id, 5) AS b FROM ids) SELECT {_V.format('content_id_used_twice', 'provision_id', 'b')} FROM s GROUP BY release_tag, provision_id, b HAVING count(*) > 1",
    "marred_draft_blocks": """WITH m AS (SELECT draft_block_id, CASE WHEN draft_block_id % 6 = 0 THEN 'odd' ELSE kind END AS kind, CASE WHEN draft_block_id % 6 = 1 THEN ' ' ELSE text END AS text,
  CASE draft_block_id % 6 WHEN 2 THEN [] WHEN 3 THEN list_reverse(pdf_pages) WHEN 4 THEN [0, 3] ELSE pdf_pages END AS pages FROM draft_text_blocks)
SELECT draft_block_id, problem FROM (SELECT draft_block_id, CASE WHEN kind IS NULL OR kind NOT IN ('text', 'quoted_text', 'formula', 'signature', 'list', 'table') THEN 'unknown_kind'
  WHEN kind NOT IN ('list', 'table') AND trim(coalesce(text, '')) = '' THEN 'blank_text' WHEN pages IS NULL OR len(pages) = 0 THEN 'no_pages'
  WHEN list_min(pages) < 1 THEN 'not_positive' WHEN pages <> list_sort(list_distinct(pages)) THEN 'not_increasing' END AS problem FROM m) WHERE problem IS NOT NULL""",
    "marred_children": f"""WITH {P_SQL}, n AS (SELECT release_tag || '|' || act_id AS scope, provision_id, parent_provision_id AS parent, CASE WHEN node_type = 'subsection' AND sequence % 2 = 0 THEN 'paragraph' ELSE node_type END AS kind FROM p)
SELECT scope, parent AS node_id FROM n x WHERE kind IN ('subsection', 'paragraph') AND EXISTS (SELECT 1 FROM n s WHERE s.scope = x.scope AND s.provision_id = x.parent AND s.kind = 'section') GROUP BY 1, 2 HAVING count(DISTINCT kind) = 2""",
    "marred_grids": f"WITH {_CELLS} " + _union(
        "SELECT 'cell_too_wide' AS rule, 'grid' AS release_tag, p AS key, id AS detail FROM e WHERE c0 + cs - 1 > 4", "SELECT 'cell_too_tall', 'grid', p, id FROM e WHERE r + rs - 1 > last",
        "SELECT 'cells_overlap', 'grid', p, concat_ws('/', 't', rr, cc) FROM h GROUP BY p, rr, cc HAVING count(*) > 1",
        "SELECT 'header_reference', 'grid', f.p, f.ref FROM f LEFT JOIN c ON c.p = f.p AND c.id = f.ref WHERE c.role IS NULL OR c.role <> 'header'"),
    "marred_headers": f"WITH {_PRINTED} SELECT * FROM rec",
    "marred_exclusions": f"""WITH {_PRINTED},
l AS (SELECT document, pdf_page, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM printed),
f AS (SELECT *, min(CASE WHEN trim(line) <> '' THEN i END) OVER (PARTITION BY document, pdf_page) AS first FROM l),
r AS (SELECT f.document, pdf_page, i + 1 AS source_line, CASE WHEN i = first AND regexp_matches(trim(line), '^[0-9]+$') THEN 'printed_page_number'
  WHEN i < 4 AND rec.signature IS NOT NULL THEN 'recurring_header' WHEN lower(trim(line)) = 'schedules' THEN 'editorial_annotation' END AS reason, left(line, 240) AS excerpt
  FROM f LEFT JOIN rec ON rec.document = f.document AND rec.signature = {_SIG.format('line')}),
n AS (SELECT document, pdf_page, text, unnest(regexp_extract_all(text, '\\[[^\\]]+\\]')) AS note FROM printed),
e AS (SELECT document, pdf_page, len(string_split(split_part(text, note, 1), chr(10))) AS source_line, trim(regexp_replace(note, '\\s+', ' ', 'g')) AS x FROM n)
SELECT * FROM r WHERE reason IS NOT NULL UNION ALL
SELECT document, pdf_page, source_line, 'editorial_annotation', left(x, 240) FROM (SELECT *, lower(trim(trim(x, '[]'))) AS y FROM e) WHERE {_NOTE}""",
}
