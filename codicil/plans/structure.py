"""Queries of structure rules, permanent ids, projection and release decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil import schemas, vocab
from codicil.functions import textkeys as K
from codicil.operators import structure as S
from codicil.operators import workflow as W
from codicil.plans import projection as J
from codicil.plans.common import P_SQL, READY, clean, ready
from codicil.session import ready_releases, table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    p = clean(spark, d, "provisions", "act_id", "parent_provision_id", "sequence", "node_type", "display_label", "heading", "sibling_order", "searchable_text")
    return p.select(
        F.concat_ws("|", "release_tag", "act_id").alias("scope"), F.col("provision_id").alias("node_id"), F.col("parent_provision_id").alias("parent_id"), F.col("sequence").alias("seq"),
        "node_type", "display_label", "heading", F.col("sibling_order").alias("order"), F.col("searchable_text").alias("first_text"))


def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.assign_ids(_nodes(spark, d))


def unassignable_ids(spark: SparkSession, d: str) -> DataFrame:
    return S.unassignable(_nodes(spark, d))


def parent_matrix(spark: SparkSession, d: str) -> DataFrame:
    return S.parent_matrix(_nodes(spark, d))


def mixed_children(spark: SparkSession, d: str) -> DataFrame:
    return S.mixed_children(_nodes(spark, d))


def section_jumps(spark: SparkSession, d: str) -> DataFrame:
    return S.section_jumps(_nodes(spark, d))


def roman_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The roman value of every label and heading word that is one."""
    words = clean(spark, d, "provisions", "display_label").select(F.regexp_extract("display_label", "([ivxlcdmIVXLCDM]+)", 1).alias("word")).distinct().where("word <> ''")
    return words.select("word", K.roman_value("word").cast("long").alias("value"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d, "provisions", "heading").select("heading").where("heading is not null").distinct().select("heading", K.slug("heading").alias("slug"))


def search_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", K.search_key("p_name").alias("key"))


def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the search key of every whole text."""
    return table(spark, d, "documents").select("doc_id", F.sha2(K.search_key("text"), 256).alias("key"))


def content_addresses(spark: SparkSession, d: str) -> DataFrame:
    """One row for each distinct text: its address and how often it occurs."""
    docs = table(spark, d, "documents")
    return docs.groupBy(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("address")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def citation_segments(spark: SparkSession, d: str) -> DataFrame:
    """The cited words of every citation's block, by code-point range."""
    from codicil.functions.blocks import flatten_blocks

    c = clean(spark, d, "citations", "source_provision_id", "source_block_id", "canonical_record")
    texts = flatten_blocks(clean(spark, d, "provisions", "canonical_record")).where("text is not null and block_id is not null").groupBy("release_tag", "provision_id", "block_id").agg(F.min("text").alias("text"))
    own = c.select("release_tag", "citation_id", F.col("source_provision_id").alias("provision_id"), F.col("source_block_id").alias("block_id"),
                   F.get_json_object("canonical_record", "$.text_range.start").try_cast("int").alias("s"), F.get_json_object("canonical_record", "$.text_range.end").try_cast("int").alias("e"))
    j = own.join(texts, ["release_tag", "provision_id", "block_id"]).where("s >= 0 and s < e and e <= char_length(text)")
    return j.select("release_tag", "citation_id", F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")).alias("cited"))


def project_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = clean(spark, d, "citations", "canonical_record").select("release_tag", F.col("canonical_record").alias("record"), F.from_json("canonical_record", schemas.CITATION).alias("r")).select("release_tag", "record", "r.*")
    return J.citation_rows(rows).drop("canonical_record")


def project_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = clean(spark, d, "sources", "canonical_record").select("release_tag", F.col("canonical_record").alias("record"), F.from_json("canonical_record", schemas.SOURCE).alias("r")).select("release_tag", "record", "r.*")
    return J.source_rows(rows).drop("canonical_record")


def project_acts(spark: SparkSession, d: str) -> DataFrame:
    rows = clean(spark, d, "acts", "canonical_record").select("release_tag", F.col("canonical_record").alias("record"), F.from_json("canonical_record", schemas.ACT).alias("r")).select("release_tag", "record", "r.*")
    out = J.act_rows(rows)
    return out.select("release_tag", "act_id", "official_title", "short_title", "year", "number", "text_kind", "status", "citation_key", F.array_join("title_keys", "|").alias("title_keys"), F.array_join("source_ids", "|").alias("source_ids"))


def project_provisions(spark: SparkSession, d: str) -> DataFrame:
    rows = clean(spark, d, "provisions", "sequence", "canonical_record").select("release_tag", F.col("sequence").alias("line"), F.col("canonical_record").alias("record"), F.from_json("canonical_record", schemas.PROVISION).alias("r")).select("release_tag", "line", "record", "r.*")
    out = J.provision_rows(rows)
    return out.select("release_tag", "provision_id", "act_id", "sibling_order", "node_type", "reference_key", F.array_join("source_ids", "|").alias("source_ids"))


def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Events as passes of a run for each user: sums, and the pass that exceeds a budget."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), F.floor(F.abs("value")).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    return W.over_budget(e, 500).select("run_id", "position", "spent")


def promotion_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each two neighbouring ready releases as before and after a review; ``release_tag`` is the later one. A record differs by its value, here its digest."""
    p = clean(spark, d, "provisions", "act_id", "text_fidelity", heading_=F.coalesce("heading", F.lit(""))).withColumnRenamed("heading_", "canonical_record")
    no = F.broadcast(ready_releases(spark, d))  # a register of at most 10,000 versions
    after = p.join(no.where("release_no > 0").select("release_tag"), "release_tag", "left_semi")
    later = no.select(F.col("release_tag").alias("later"), (F.col("release_no") - 1).alias("release_no"))
    before = p.join(no, "release_tag").join(F.broadcast(later), "release_no").drop("release_tag", "release_no").withColumnRenamed("later", "release_tag")
    return W.promotion_gate(before, after, ("release_tag", "act_id"))


def release_actions(spark: SparkSession, d: str) -> DataFrame:
    """What publishing would do while the newest ready release is active: each registered release, the same under another commit, and one of the next major version."""
    rel = table(spark, d, "corpus_releases").where("release_tag is not null").select("release_tag", "commit_sha", "canonical_schema_versions", "projection_schema_version", "import_state")
    version = F.transform(F.split(F.substr("release_tag", F.lit(9)), "\\."), lambda x: x.cast("int"))
    live = rel.where("import_state = 'ready'").withColumn("version", version)
    record = lambda row: J.Release(row["release_tag"], row["commit_sha"], tuple(row["canonical_schema_versions"]), row["projection_schema_version"], row["import_state"]) if row else None
    active, previous = ([record(r) for r in live.orderBy(F.desc("version")).limit(2).collect()] + [None, None])[:2]
    wanted = rel.drop("import_state")
    number = F.split(F.substr("release_tag", F.lit(9)), "\\.")
    ahead = F.concat_ws(".", (number[0].cast("int") + 1).cast("string"), number[1], number[2])
    many = wanted.withColumn("request", F.lit("as registered")).unionByName(
        wanted.withColumns({"commit_sha": F.reverse("commit_sha"), "request": F.lit("other commit")})).unionByName(
        wanted.withColumns({"release_tag": F.concat(F.lit("corpus-v"), ahead), "request": F.lit("next major version")}))
    return J.decide_all(many, rel, active, previous).select("release_tag", "request", "action", "blockers")


def schema_differences(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the stored tables against the projection's fixed schemas."""
    rows = [(t, x) for t, s in schemas.PROJECTION.items() for x in schemas.differences(table(spark, d, t), s)]
    return spark.createDataFrame(rows, "table_name string, difference string")


QUERIES = (
    assigned_ids, unassignable_ids, parent_matrix, mixed_children, section_jumps, roman_numbers, slugs, search_keys, document_keys, content_addresses, citation_segments,
    project_citations, project_sources, project_acts, project_provisions, token_usage, promotion_gate, release_actions, schema_differences,
)

_N = f"""p AS (SELECT DISTINCT release_tag || '|' || act_id AS scope, provision_id AS node_id, parent_provision_id AS parent_id, sequence AS seq, node_type, display_label, heading, sibling_order AS ord
  FROM provisions WHERE {READY})"""
_ALLOWED = " OR ".join(
    f"(a.node_type = '{k}' AND NOT coalesce({'a.parent_id IS NULL OR ' if None in v else ''}b.node_type IN ({', '.join(repr(x) for x in v if x)}), false))" for k, v in vocab.PARENTS.items())

_BARE = "trim(regexp_replace(trim(display_label, ' ' || chr(9) || chr(10) || chr(13)), '(?i)^(?:PART|CHAPTER|DIVISION|SECTION)\\s+', ''), ' ' || chr(9) || chr(10) || chr(13) || '().:-')"
_DIGITS = "list_transform(list_reverse(string_split(upper({w}), '')), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END)"
_ROMAN = "list_sum(list_transform({d}, lambda v, i: CASE WHEN i > 1 AND v < list_max({d}[1:i - 1]) THEN -v ELSE v END))"
_SLUG = "nullif(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"
_SEGMENTS = f"""p AS (SELECT DISTINCT release_tag || '|' || act_id AS scope, provision_id AS node_id, parent_provision_id AS parent_id, sequence AS seq, node_type, display_label, heading, sibling_order AS ord, searchable_text
  FROM provisions WHERE {READY}),
b AS (SELECT *, {_BARE} AS bare, sum(CASE WHEN node_type = 'schedule' THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY seq, node_id ROWS UNBOUNDED PRECEDING) AS schedule_no FROM p),
r AS (SELECT *, CASE WHEN node_type IN ('part', 'chapter', 'division', 'schedule_part') AND regexp_matches(upper(bare), '^[IVXLCDM]+$') THEN {_DIGITS.format(w='bare')} END AS d FROM b),
t AS (SELECT *, coalesce(CASE WHEN node_type = 'definition' THEN {_SLUG.format(x="nullif(regexp_extract(searchable_text, '^\\s*[\"“‘'']([^\"”’'']+)[\"”’'']', 1), '')")}
  ELSE coalesce(CAST({_ROMAN.format(d='d')} AS VARCHAR), {_SLUG.format(x='bare')}) END,
  CASE WHEN node_type IN ('cross_heading', 'table', 'form') THEN {_SLUG.format(x='heading')} END,
  CASE WHEN node_type IN ('subsection', 'paragraph', 'subparagraph', 'schedule_paragraph', 'schedule_subparagraph') AND parent_id IS NOT NULL AND ord >= 1 THEN 'unnumbered-' || ord END) AS token FROM r),
s AS (SELECT *, CASE WHEN node_type = 'schedule' THEN 'schedule-' || schedule_no WHEN node_type IN ({', '.join(repr(x) for x in S.FIXED)}) THEN replace(node_type, '_', '-')
  WHEN token IS NULL THEN NULL ELSE replace(regexp_replace(node_type, '^schedule_', ''), '_', '-') || '-' || token END AS segment, node_type IN ({', '.join(repr(x) for x in S.ABSOLUTE)}) AS absolute FROM t)"""

SQL = {
    "unassignable_ids": f"WITH {_SEGMENTS} SELECT scope, node_id, node_type FROM s WHERE segment IS NULL",
    "assigned_ids": f"""WITH RECURSIVE {_SEGMENTS},
walk AS (SELECT scope, node_id, seq, segment, segment AS base FROM s WHERE parent_id IS NULL
  UNION ALL SELECT s.scope, s.node_id, s.seq, s.segment, CASE WHEN s.absolute THEN s.segment ELSE concat_ws('.', w.base, s.segment) END FROM s JOIN walk w ON w.scope = s.scope AND w.node_id = s.parent_id),
n AS (SELECT *, row_number() OVER (PARTITION BY scope, base ORDER BY seq, node_id) AS k FROM walk WHERE segment IS NOT NULL)
SELECT scope, node_id, CASE WHEN k = 1 THEN base ELSE base || '~' || k END AS local_id FROM n""",
    "roman_numbers": f"""WITH w AS (SELECT DISTINCT regexp_extract(display_label, '([ivxlcdmIVXLCDM]+)', 1) AS word FROM provisions WHERE {READY}), d AS (SELECT word, {_DIGITS.format(w='word')} AS d FROM w WHERE word <> '')
SELECT word, CAST({_ROMAN.format(d='d')} AS BIGINT) AS value FROM d""",
    "parent_matrix": f"WITH {_N} SELECT a.scope, a.node_id, a.node_type, coalesce(b.node_type, '') AS parent_type FROM p a LEFT JOIN p b ON b.scope = a.scope AND b.node_id = a.parent_id WHERE {_ALLOWED}",
    "mixed_children": f"""WITH {_N} SELECT scope, parent_id AS node_id FROM p x WHERE node_type IN ('subsection', 'paragraph')
  AND EXISTS (SELECT 1 FROM p s WHERE s.scope = x.scope AND s.node_id = x.parent_id AND s.node_type = 'section') GROUP BY 1, 2 HAVING count(DISTINCT node_type) = 2""",
    "section_jumps": f"""WITH {_N},
s AS (SELECT *, regexp_matches(display_label, '(?i)^\\s*\\d+[a-z]?\\.?\\s*$') AS fits FROM p WHERE node_type = 'section' AND display_label <> ''),
r AS (SELECT *, sum(CASE WHEN fits THEN 0 ELSE 1 END) OVER (PARTITION BY scope ORDER BY seq, node_id ROWS UNBOUNDED PRECEDING) AS run FROM s),
n AS (SELECT *, CAST(regexp_extract(display_label, '(\\d+)', 1) AS INT) AS num, lower(regexp_extract(display_label, '(?i)\\d+([a-z]?)', 1)) AS suf FROM r WHERE fits),
l AS (SELECT *, lag(num) OVER w AS n0, lag(suf) OVER w AS s0 FROM n WINDOW w AS (PARTITION BY scope, run ORDER BY seq, node_id))
SELECT scope, node_id, n0 || upper(s0) AS after, num || upper(suf) AS found FROM l WHERE n0 IS NOT NULL
  AND NOT ((num = n0 AND suf = CASE WHEN s0 = '' THEN 'a' ELSE chr(ascii(s0) + 1) END) OR (num = n0 + 1 AND suf = ''))""",
    "slugs": f"""SELECT DISTINCT heading, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(heading), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM provisions WHERE heading IS NOT NULL AND {READY}""",
    "search_keys": "SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), ' ') AS key FROM part",
    "document_keys": "SELECT doc_id, sha256(array_to_string(regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]+'), ' ')) AS key FROM documents",
    "content_addresses": "SELECT 'sha256:' || sha256(text) AS address, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "project_citations": f"SELECT DISTINCT release_tag, citation_id, schema_version, source_provision_id, source_block_id, target_act_id, target_provision_id FROM citations WHERE {READY}",
    "project_sources": f"SELECT DISTINCT release_tag, source_id, schema_version, document_title, document_publisher, language, source_class FROM sources WHERE {READY}",
    "project_acts": f"""SELECT DISTINCT release_tag, act_id, canonical_record ->> '$.titles.official' AS official_title, canonical_record ->> '$.titles.short' AS short_title, year, number, text_kind, status, citation_key,
  array_to_string(title_keys, '|') AS title_keys, array_to_string(source_ids, '|') AS source_ids FROM acts WHERE {READY}""",
    "project_provisions": f"""SELECT DISTINCT release_tag, provision_id, act_id, sibling_order, node_type, reference_key, array_to_string(list_sort(list_distinct(source_ids)), '|') AS source_ids FROM provisions WHERE {READY}""",
    "token_usage": """WITH e AS (SELECT user_id AS run_id, event_id AS position, sum(CAST(floor(abs(value)) AS BIGINT) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)
SELECT run_id, min(position) AS position, CAST(min(spent) AS BIGINT) AS spent FROM e WHERE spent > 500 GROUP BY 1""",
    "promotion_gate": f"""WITH {P_SQL},
no AS (SELECT release_tag, row_number() OVER (ORDER BY list_transform(string_split(substr(release_tag, 9), '.'), lambda x: CAST(x AS INT))) AS n FROM corpus_releases WHERE import_state = 'ready'),
q AS (SELECT p.*, n, coalesce(heading, '') AS h FROM p JOIN no USING (release_tag)),
bef AS (SELECT t.release_tag AS later, q.* FROM q JOIN no t ON t.n = q.n + 1),
b AS (SELECT later AS release_tag, act_id, count(*) AS n_before FROM bef GROUP BY 1, 2),
a AS (SELECT release_tag, act_id, count(*) AS n_after, count(*) FILTER (WHERE text_fidelity = 'machine_extracted') AS n_machine FROM q WHERE n > 1 GROUP BY 1, 2),
l AS (SELECT x.later AS release_tag, x.act_id, count(*) FILTER (WHERE y.provision_id IS NULL) AS n_lost, count(*) FILTER (WHERE y.h <> x.h) AS n_changed FROM bef x
  LEFT JOIN q y ON y.release_tag = x.later AND y.act_id = x.act_id AND y.provision_id = x.provision_id GROUP BY 1, 2),
j AS (SELECT coalesce(a.release_tag, b.release_tag) AS release_tag, coalesce(a.act_id, b.act_id) AS act_id, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, coalesce(n_machine, 0) AS n_machine
  FROM b FULL JOIN a ON a.release_tag = b.release_tag AND a.act_id = b.act_id)
SELECT j.*, coalesce(n_lost, 0) AS n_lost, coalesce(n_changed, 0) AS n_changed, n_machine = 0 AND coalesce(n_lost, 0) = 0 AND n_after >= n_before AS ready FROM j LEFT JOIN l ON l.release_tag = j.release_tag AND l.act_id = j.act_id""",
    "citation_segments": f"""WITH c AS (SELECT release_tag, citation_id, min(source_provision_id) AS pid, min(source_block_id) AS bid, CAST(min(canonical_record ->> '$.text_range.start') AS INT) AS s, CAST(min(canonical_record ->> '$.text_range.end') AS INT) AS e
  FROM citations WHERE {READY} GROUP BY 1, 2),
rec AS (SELECT release_tag, provision_id, min(canonical_record) AS j FROM provisions WHERE {READY} GROUP BY 1, 2),
n AS (SELECT r.release_tag, r.provision_id, t.path AS node_path, t.key, t.atom ->> '$' AS v FROM rec r, json_tree(r.j) t WHERE starts_with(t.fullkey, '$.content_blocks')),
x AS (SELECT a.release_tag, a.provision_id, a.v AS bid, b.v AS text FROM n a JOIN n b ON b.release_tag = a.release_tag AND b.provision_id = a.provision_id AND b.node_path = a.node_path AND b.key = 'text' WHERE a.key = 'block_id')
SELECT c.release_tag, c.citation_id, substr(x.text, s + 1, e - s) AS cited FROM c JOIN x ON x.release_tag = c.release_tag AND x.provision_id = c.pid AND x.bid = c.bid WHERE s >= 0 AND s < e AND e <= length(x.text)""",
    "release_actions": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY import_state ORDER BY list_transform(string_split(substr(release_tag, 9), '.'), lambda x: CAST(x AS INT)) DESC) AS n FROM corpus_releases),
w AS (SELECT release_tag, commit_sha, 'as registered' AS request FROM r UNION ALL SELECT release_tag, reverse(commit_sha), 'other commit' FROM r
  UNION ALL SELECT 'corpus-v' || (CAST(split_part(substr(release_tag, 9), '.', 1) AS INT) + 1) || '.' || split_part(release_tag, '.', 2) || '.' || split_part(release_tag, '.', 3), commit_sha, 'next major version' FROM r),
c AS (SELECT w.release_tag, request, r.n, r.release_tag IS NULL AS fresh, CASE WHEN r.release_tag IS NULL THEN '' WHEN r.commit_sha <> w.commit_sha THEN 'release_commit_conflict'
  WHEN r.import_state <> 'ready' THEN 'release_import_incomplete' ELSE '' END AS blockers FROM w LEFT JOIN r ON r.release_tag = w.release_tag)
SELECT release_tag, request, CASE WHEN blockers <> '' THEN 'blocked' WHEN fresh THEN 'import_and_activate' WHEN n = 1 THEN 'noop' ELSE 'activate_existing' END AS action, blockers FROM c""",
}
