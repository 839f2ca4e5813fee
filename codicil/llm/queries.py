"""Registered queries of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm import language
from codicil.llm.leakage import leaked_items
from codicil.llm.mixing import Mixture
from codicil.llm.scan_repair import ScanRepair
from codicil.llm.uniform_text import uniform_text
from codicil.session import ready_releases, table


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """release_tag, table_name, record_id, field_name, text of the fields that must come out in one form."""
    ready = F.broadcast(ready_releases(spark, d).select("release_tag"))  # a register of at most 10,000 versions
    acts = table(spark, d, "acts").select(
        "release_tag", F.lit("acts").alias("table_name"), F.col("act_id").alias("record_id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("official_title", "searchable_text")])).alias("x"),
    ).select("release_tag", "table_name", "record_id", "x.*")
    provisions = table(spark, d, "provisions").select(
        "release_tag", F.lit("provisions").alias("table_name"), F.col("provision_id").alias("record_id"), F.lit("searchable_text").alias("field_name"), F.col("searchable_text").alias("text"))
    return acts.unionByName(provisions).join(ready, "release_tag", "left_semi")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields that hold a character that is not the plain one for what is seen."""
    changed = uniform_text(_fields(spark, d), "text", only_changed=True, twice_widened=True)  # as these sources were
    return changed.select("release_tag", "table_name", "record_id", "field_name").distinct()


def p1_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Every field in its consistent form, and a digest of it to compare by."""
    out = uniform_text(_fields(spark, d), "text", twice_widened=True)
    keys = ["release_tag", "table_name", "record_id", "field_name"]
    return out.groupBy(*keys).agg(F.min("_uniform").alias("text"), F.bool_or("_changed").alias("changed")).withColumn("digest", F.sha2("text", 256))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "mixture_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their number of uses."""
    return _mixture(spark, d).documents()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each listed source."""
    return _mixture(spark, d).shares()


def p7_order(spark: SparkSession, d: str) -> DataFrame:
    """Every use of every chosen document, range-sorted by training position."""
    return _mixture(spark, d).order()


def _languages(spark: SparkSession, d: str, **how) -> DataFrame:
    return language.identify(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", "lang", ["doc_id", "lang"], **how)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose label is missing or wrong, and paragraphs in another language than the main one, as far as they are in one of the eight."""
    docs = _languages(spark, d).where("main is not null")
    named = language.label_column("lang")
    wrong = F.when(named.eqNullSafe(F.col("main")), F.array()).otherwise(F.array(F.struct(F.lit(0).alias("segment_no"), F.col("main").alias("lang"))))
    other = F.transform(F.filter("segments", lambda s: s["lang"] != F.col("main")), lambda s: F.struct(s["segment_no"].alias("segment_no"), s["lang"].alias("lang")))
    rows = docs.select("doc_id", F.explode(F.concat(wrong.cast("array<struct<segment_no:int,lang:string>>"), other)).alias("x"))
    return rows.select("doc_id", F.col("x.segment_no").cast("long").alias("segment_no"), "x.lang")


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Main language and confidence of each document (segment 0) and of each paragraph; und where it is none of the eight."""
    docs = _languages(spark, d)
    whole = F.array(F.struct(F.lit(0).alias("segment_no"), F.col("main").alias("lang"), F.col("main_confidence").alias("confidence")))
    parts = F.transform("segments", lambda s: F.struct(s["segment_no"].alias("segment_no"), s["lang"].alias("lang"), s["confidence"].alias("confidence")))
    rows = docs.select("doc_id", F.explode(F.concat(whole, parts)).alias("x"))
    return rows.select("doc_id", F.col("x.segment_no").cast("long").alias("segment_no"), F.coalesce("x.lang", F.lit("und")).alias("lang"), F.round("x.confidence", 6).alias("confidence"))


def p8_switches(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that change their language amid the text: ranges of code points with their languages."""
    rows = _languages(spark, d, switches=True).select("doc_id", F.explode("switches").alias("x"))
    cols = [F.col(f"x.{c}").cast("long").alias(c) for c in ("segment_no", "part_no", "start", "end")]
    return rows.select("doc_id", *cols, F.coalesce("x.lang", F.lit("und")).alias("lang"), F.round("x.confidence", 6).alias("confidence"))


def _repair(spark: SparkSession, d: str) -> ScanRepair:
    return ScanRepair(table(spark, d, "draft_text_blocks"), table(spark, d, "audit_exclusions"), table(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines with traces of layout and misreading, and exclusions with a wrong reason."""
    return _repair(spark, d).noise()


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The continuous readable text of each block."""
    return _repair(spark, d).paragraphs()


def _leaked(spark: SparkSession, d: str, **how) -> DataFrame:
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text", **how)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least 13 consecutive words of an item."""
    return _leaked(spark, d, width=13, radius=2, similarity=0.8, exact=True).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items with windows of at least 0.8 similarity: how many windows, and the best similarity."""
    return _leaked(spark, d, width=13, radius=2, similarity=0.8).withColumn("similarity", F.round("similarity", 6))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item as a whole, or nearly so: item-sized windows of at least 0.8 similarity."""
    return _leaked(spark, d, radius=4, similarity=0.8, item_sized=True).withColumn("similarity", F.round("similarity", 6))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_uniform, p5_found, p5_paragraphs, p6_found, p6_leaks, p6_items, p7_mixture, p7_shares, p7_order, p8_found, p8_languages, p8_switches)}


_READY = "release_tag IN (SELECT release_tag FROM corpus_releases WHERE import_state = 'ready')"
_ODD = (
    "[\\x{A0}\\x{AD}\\x{34F}\\x{1680}\\x{2000}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}-\\x{206F}\\x{2116}\\x{3000}\\x{FB00}-\\x{FB06}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FF01}-\\x{FF5E}\\x{1D400}-\\x{1D7FF}\\x{251}\\x{261}\\x{585}]"
)
_WORDS = "regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]+')"

#: p1: the classes of characters that occur in these tables, by regular expression (the operator covers all of Unicode).
#: p6: all runs of 13 words, joined. DuckDB has no NFKC or case folding; on these texts NFC, lower case and ß suffice.
SQL: dict[str, str] = {
    "p1_found": f"""WITH f AS (
  SELECT release_tag, 'acts' AS table_name, act_id AS record_id, 'official_title' AS field_name, official_title AS text FROM acts
  UNION ALL SELECT release_tag, 'acts', act_id, 'searchable_text', searchable_text FROM acts
  UNION ALL SELECT release_tag, 'provisions', provision_id, 'searchable_text', searchable_text FROM provisions),
w AS (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+') AS words FROM f WHERE {_READY} AND text IS NOT NULL)
SELECT DISTINCT release_tag, table_name, record_id, field_name FROM w
WHERE nfc_normalize(text) <> text OR regexp_matches(text, '{_ODD}') OR len(list_filter(words, lambda x:
  regexp_matches(x, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}]') AND (regexp_matches(x, '\\p{{Latin}}') OR length(x) = 1))) > 0""",
    "p6_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p6_leaks": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
ds AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
isx AS (SELECT item_id, k, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
dk AS (SELECT *, s IN (SELECT s FROM isx) AS known, count(*) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS n FROM ds),
dw AS (SELECT doc_id, k, n, count(*) FILTER (WHERE known) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS m FROM dk),
ws AS (SELECT a.doc_id, a.k, b.s, row_number() OVER (PARTITION BY a.doc_id, a.k, b.s ORDER BY b.k) AS o FROM dw a JOIN dk b ON b.doc_id = a.doc_id AND b.k BETWEEN a.k AND a.k + 8 WHERE a.n = 9 AND a.m >= 8),
iw AS (SELECT item_id, k, count(*) OVER (PARTITION BY item_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS n FROM isx),
vs AS (SELECT a.item_id, a.k, b.s, row_number() OVER (PARTITION BY a.item_id, a.k, b.s ORDER BY b.k) AS o FROM iw a JOIN isx b ON b.item_id = a.item_id AND b.k BETWEEN a.k AND a.k + 8 WHERE a.n = 9),
pairs AS (SELECT ws.doc_id, ws.k, vs.item_id, vs.k AS j, count(*) AS c FROM ws JOIN vs ON vs.s = ws.s AND vs.o = ws.o GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8)
SELECT doc_id, item_id, count(DISTINCT k) AS n_windows, round(max(c / (18 - c)), 6) AS similarity FROM pairs GROUP BY 1, 2""",
}
