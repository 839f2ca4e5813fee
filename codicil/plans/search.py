"""Queries of exact and lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions import textkeys as K
from codicil.operators import search as S
from codicil.operators import tree
from codicil.plans.common import READY, clean
from codicil.session import durable

ACT = tuple(c for c in S.ACT_SUMMARY if c != "act_id")
PROVISION = tuple(c for c in S.PROVISION_SUMMARY if c != "provision_id")
TITLE = "Constitution of the Federation of Qumara 1994"
NAMED = "section 5 constitution of the federation of qumara 1994"
WORDS = "calendar of sittings"


def _acts(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d, "acts", "title_keys", "citation_key", "canonical_record", "searchable_text", "official_title")


def _provisions(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d, "provisions", "act_id", "sequence", "reference_key", "searchable_text", "heading")


def _postings(spark: SparkSession, d: str, stemmed: bool) -> DataFrame:
    a = _acts(spark, d).select("release_tag", F.lit("act").alias("kind"), F.col("act_id").alias("id"), F.col("searchable_text").alias("text"))
    p = _provisions(spark, d).select("release_tag", F.lit("provision").alias("kind"), F.col("provision_id").alias("id"), F.col("searchable_text").alias("text"))
    return S.build_postings(a.unionByName(p), stemmed)


def search_exact_acts(spark: SparkSession, d: str) -> DataFrame:
    return S.exact_acts(_acts(spark, d), TITLE)


def search_named_act(spark: SparkSession, d: str) -> DataFrame:
    return S.named_act(_acts(spark, d), NAMED)


def search_exact_reference(spark: SparkSession, d: str) -> DataFrame:
    acts = _acts(spark, d)
    return S.exact_provisions(_provisions(spark, d), NAMED, S.named_act(acts, NAMED))


def search_excerpts(spark: SparkSession, d: str) -> DataFrame:
    p = _provisions(spark, d)
    return p.select("release_tag", "provision_id", K.excerpt("searchable_text", "reference_key").alias("excerpt"))


def search_excerpt_beyond_title(spark: SparkSession, d: str) -> DataFrame:
    p = _provisions(spark, d)
    return p.select("release_tag", "provision_id", S.excerpt_beyond(F.col("heading"), K.excerpt("searchable_text", "reference_key")).alias("beyond"))


def search_lexical_unstemmed(spark: SparkSession, d: str) -> DataFrame:
    return S.lexical(_postings(spark, d, False), S.parse(WORDS, False)).select("release_tag", "kind", "id")


def search_lexical_phrase(spark: SparkSession, d: str) -> DataFrame:
    return S.lexical(_postings(spark, d, False), S.parse(f'"{WORDS}" -tribunal', False)).select("release_tag", "kind", "id")


def search_lexical_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Forms of the words, alternatives, and the rank by cover density."""
    return S.lexical(_postings(spark, d, True), S.parse("protected calendars or sitting"))


def search_items(spark: SparkSession, d: str) -> DataFrame:
    """A search as it is answered: each item with its act, provision, breadcrumb and excerpt."""
    acts = durable(clean(spark, d, "acts", *ACT, "title_keys", "citation_key", "canonical_record", "searchable_text"), "acts")
    provisions = durable(clean(spark, d, "provisions", *PROVISION, "parent_provision_id", "sequence", "reference_key", "searchable_text"), "provisions")
    texts = acts.select("release_tag", F.lit("act").alias("kind"), F.col("act_id").alias("id"), F.col("searchable_text").alias("text")).unionByName(
        provisions.select("release_tag", F.lit("provision").alias("kind"), F.col("provision_id").alias("id"), F.col("searchable_text").alias("text")))
    listed = durable(S.search(acts, provisions, S.build_postings(texts), WORDS, limit=5), "listed")
    wanted = listed.where("kind = 'provision'").select("release_tag", F.col("id").alias("provision_id"))
    items = S.items(listed, acts, provisions, tree.ancestor_summaries(provisions, wanted))
    return items.select(
        "release_tag", "position", "kind", "match_kind", "act.act_id", F.col("act.official_title").alias("title"), F.col("act.status").alias("status"), F.col("provision.provision_id").alias("provision_id"),
        F.col("provision.heading").alias("heading"), F.array_join(F.transform("breadcrumb", lambda x: x["provision_id"]), " > ").alias("breadcrumb"), "excerpt")


def search_composed(spark: SparkSession, d: str) -> DataFrame:
    acts, provisions = durable(_acts(spark, d), "acts"), durable(_provisions(spark, d), "provisions")
    return S.search(acts, provisions, _postings(spark, d, True), TITLE, limit=20)


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every unstemmed term, by release."""
    return _postings(spark, d, False).groupBy("release_tag", "term").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.size("positions")).alias("n_occurrences"))


QUERIES = (
    search_exact_acts, search_named_act, search_exact_reference, search_excerpts, search_excerpt_beyond_title, search_lexical_unstemmed, search_lexical_phrase,
    search_lexical_stemmed, search_composed, search_items, index_terms,
)

_KEY = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ')"
_T = TITLE.lower()
_A = f"a AS (SELECT release_tag, act_id, min(title_keys) AS title_keys, min(citation_key) AS citation_key, min(canonical_record) AS j, min(searchable_text) AS text FROM acts WHERE {READY} GROUP BY 1, 2)"
_P = f"p AS (SELECT DISTINCT release_tag, provision_id, act_id, sequence, reference_key, searchable_text, heading FROM provisions WHERE {READY})"
_EXCERPT = "CASE WHEN length(searchable_text) > length(reference_key) THEN left(searchable_text, least(320, length(searchable_text) - length(reference_key) - 1)) END"
_NAMED = f"""{_A},
hit AS (SELECT release_tag, act_id, list_filter(title_keys, lambda k: k <> '' AND instr(' {NAMED} ', ' ' || k || ' ') > 0) AS keys FROM a),
one AS (SELECT release_tag, any_value(act_id) AS act_id, any_value(keys) AS keys FROM hit WHERE len(keys) > 0 GROUP BY 1 HAVING count(*) = 1),
named AS (SELECT release_tag, act_id, trim(regexp_replace(replace(' {NAMED} ', ' ' || list_sort(list_transform(keys, lambda k: lpad(CAST(length(k) AS VARCHAR), 6, '0') || k), 'DESC')[1][7:] || ' ', ''), ' +', ' ', 'g')) AS reference_key FROM one)"""
_TOKENS = f"""{_A}, {_P},
texts AS (SELECT release_tag, 'act' AS kind, act_id AS id, text FROM a UNION ALL SELECT release_tag, 'provision', provision_id, searchable_text FROM p),
tok AS (SELECT release_tag, kind, id, regexp_extract_all(replace(replace(replace(replace(replace(replace(lower(text), 'ﬃ', 'ffi'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ß', 'ss'), 'ς', 'σ'), '[\\p{{L}}\\p{{N}}]+') AS w FROM texts)"""

#: Forms of the words asked for, by the stemmer's rules; lexical hits of a word list with their rank: a cover is one word, or two neighbouring ones of the words asked for.
_FORM = "CASE WHEN regexp_full_match({w}, 'protect(s|ed|ing|ion|ions|ive|ively|edly|ingly)?') THEN 'protect' WHEN regexp_full_match({w}, 'calendar(s|ed|ing)?') THEN 'calendar' WHEN regexp_full_match({w}, 'sit(s|ting|tings|ted)?') THEN 'sit' END"
_STEMMED = f"""ev AS (SELECT release_tag, kind, id, {_FORM.format(w='x')} AS term, pos FROM (SELECT release_tag, kind, id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM tok) WHERE {_FORM.format(w='x')} IS NOT NULL),
pair AS (SELECT *, lead(term) OVER w AS term2, lead(pos) OVER w AS pos2 FROM ev WINDOW w AS (PARTITION BY release_tag, kind, id ORDER BY pos)),
cov AS (SELECT release_tag, kind, id, 0.1 AS x FROM pair WHERE term = 'sit'
  UNION ALL SELECT release_tag, kind, id, 0.1 / (pos2 - pos) FROM pair WHERE (term = 'protect' AND term2 = 'calendar') OR (term = 'calendar' AND term2 = 'protect'))"""
#: The same for words that must all occur, "calendar" and forms of "sit" (of is not indexed): covers are neighbouring pairs of the two.
_WORDS = f"""ev AS (SELECT release_tag, kind, id, {_FORM.format(w='x')} AS term, pos FROM (SELECT release_tag, kind, id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM tok) WHERE {_FORM.format(w='x')} IN ('calendar', 'sit')),
pair AS (SELECT *, lead(term) OVER w AS term2, lead(pos) OVER w AS pos2 FROM ev WINDOW w AS (PARTITION BY release_tag, kind, id ORDER BY pos)),
hit AS (SELECT release_tag, kind, id, round(sum(0.1 / (pos2 - pos)), 9) AS rank FROM pair WHERE term <> term2 GROUP BY 1, 2, 3),
own AS (SELECT release_tag, 'act' AS kind, act_id AS id, act_id, 0 AS sequence FROM a UNION ALL SELECT release_tag, 'provision', provision_id, act_id, sequence FROM p),
listed AS (SELECT release_tag, kind, id, act_id, row_number() OVER (PARTITION BY release_tag ORDER BY rank DESC, act_id, sequence, id) AS position FROM hit JOIN own USING (release_tag, kind, id))"""
_FOUR = {"constitut": "constitut(ion|ions|ional|ionally|ive|e|es|ed|ing)?", "feder": "feder(al|als|ally|ation|ations|ate|ated|ates|ating)?", "qumara": "qumaras?", "1994": "1994"}
_LAST = ", ".join(f"max(CASE WHEN term = '{t}' THEN pos END) OVER w AS l{i}" for i, t in enumerate(_FOUR))
#: Ranks of texts that hold all four words: at each word the shortest cover that ends there, counted where it begins later than the one before.
_COMPOSED = f"""ev AS (SELECT * FROM (SELECT release_tag, kind, id, pos, CASE {' '.join(f"WHEN regexp_full_match(x, '{r}') THEN '{t}'" for t, r in _FOUR.items())} END AS term
  FROM (SELECT release_tag, kind, id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM tok)) WHERE term IS NOT NULL),
win AS (SELECT *, row_number() OVER w AS rn, {_LAST} FROM ev WINDOW w AS (PARTITION BY release_tag, kind, id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT *, least(l0, l1, l2, l3) AS l FROM win WHERE l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL),
cov AS (SELECT *, lag(l) OVER (PARTITION BY release_tag, kind, id ORDER BY pos) AS pl FROM ends),
hit AS (SELECT release_tag, kind, id, round(sum(0.1 / (1 + (c.pos - c.l + 1) - (c.rn - b.rn + 1))), 9) AS rank FROM cov c JOIN win b USING (release_tag, kind, id) WHERE b.pos = c.l AND (pl IS NULL OR c.l > pl) GROUP BY 1, 2, 3),
own AS (SELECT release_tag, 'act' AS kind, act_id AS id, act_id, 0 AS sequence FROM a UNION ALL SELECT release_tag, 'provision', provision_id, act_id, sequence FROM p),
lex AS (SELECT * FROM (SELECT release_tag, kind, id, 6 AS priority, 'lexical' AS match_kind, rank, act_id, sequence, row_number() OVER (PARTITION BY release_tag ORDER BY rank DESC, act_id, sequence, id) AS n FROM hit JOIN own USING (release_tag, kind, id)) WHERE n <= 20),
exact AS (SELECT release_tag, 'act' AS kind, act_id AS id, CASE WHEN citation_key = '{_T}' THEN 2 WHEN '{_T}' IN ({_KEY.format("j ->> '$.titles.official'")}, {_KEY.format("j ->> '$.titles.short'")}) THEN 3 ELSE 4 END AS priority, act_id
  FROM a WHERE citation_key = '{_T}' OR list_contains(title_keys, '{_T}')),
every_ AS (SELECT release_tag, kind, id, priority, CASE priority WHEN 2 THEN 'exact_act_citation' WHEN 3 THEN 'exact_act_title' ELSE 'exact_act_alias' END AS match_kind, 0.0 AS rank, act_id, 0 AS sequence FROM exact
  UNION ALL SELECT release_tag, kind, id, priority, match_kind, rank, act_id, sequence FROM lex),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY release_tag, kind, id ORDER BY priority) AS k FROM every_) WHERE k = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY release_tag ORDER BY priority, rank DESC, CASE WHEN priority < 6 THEN id ELSE act_id END, sequence, id) AS position FROM once)"""

SQL = {
    "search_lexical_stemmed": f"WITH {_TOKENS}, {_STEMMED} SELECT release_tag, kind, id, round(sum(x), 9) AS rank FROM cov GROUP BY 1, 2, 3",
    "search_composed": f"WITH {_TOKENS}, {_COMPOSED} SELECT release_tag, position, kind, id, match_kind FROM placed WHERE position <= 20",
    "search_items": f"""WITH RECURSIVE {_TOKENS}, {_WORDS},
top AS (SELECT * FROM listed WHERE position <= 5),
par AS (SELECT DISTINCT release_tag, provision_id, act_id, parent_provision_id FROM provisions
  WHERE {READY} AND (release_tag, act_id) IN (SELECT (release_tag, act_id) FROM top WHERE kind = 'provision')),
up AS (SELECT release_tag, id, id AS step, 0 AS n FROM top WHERE kind = 'provision'
  UNION ALL SELECT u.release_tag, u.id, q.parent_provision_id, u.n + 1 FROM up u JOIN par q ON q.release_tag = u.release_tag AND q.provision_id = u.step WHERE q.parent_provision_id IS NOT NULL AND u.n < 60),
rooted AS (SELECT DISTINCT u.release_tag, u.id FROM up u JOIN par q ON q.release_tag = u.release_tag AND q.provision_id = u.step WHERE q.parent_provision_id IS NULL),
crumb AS (SELECT u.release_tag, u.id, string_agg(step, ' > ' ORDER BY n DESC) AS breadcrumb FROM up u JOIN rooted USING (release_tag, id) WHERE n > 0 GROUP BY 1, 2),
ac AS (SELECT DISTINCT release_tag, act_id, official_title, status FROM acts WHERE {READY}),
pr AS (SELECT *, {_EXCERPT} AS excerpt FROM p)
SELECT t.release_tag, t.position, t.kind, 'lexical' AS match_kind, t.act_id, ac.official_title AS title, ac.status, pr.provision_id, pr.heading, coalesce(crumb.breadcrumb, '') AS breadcrumb, pr.excerpt
FROM top t JOIN ac ON ac.release_tag = t.release_tag AND ac.act_id = t.act_id LEFT JOIN pr ON t.kind = 'provision' AND pr.release_tag = t.release_tag AND pr.provision_id = t.id
LEFT JOIN crumb ON t.kind = 'provision' AND crumb.release_tag = t.release_tag AND crumb.id = t.id""",
    "search_exact_acts": f"""WITH {_A}
SELECT release_tag, act_id, CASE WHEN {_KEY.format("j ->> '$.citation'")} = '{_T}' THEN 'exact_act_citation'
  WHEN '{_T}' IN ({_KEY.format("j ->> '$.titles.official'")}, {_KEY.format("j ->> '$.titles.short'")}) THEN 'exact_act_title' ELSE 'exact_act_alias' END AS match_kind
FROM a WHERE citation_key = '{_T}' OR list_contains(title_keys, '{_T}')""",
    "search_named_act": f"WITH {_NAMED} SELECT * FROM named",
    "search_exact_reference": f"""WITH {_NAMED}, {_P}
SELECT release_tag, act_id, provision_id, 'exact_provision_reference' AS match_kind, {_EXCERPT} AS excerpt FROM p JOIN named USING (release_tag, act_id, reference_key) WHERE reference_key <> ''""",
    "search_excerpts": f"WITH {_P} SELECT release_tag, provision_id, {_EXCERPT} AS excerpt FROM p",
    "search_excerpt_beyond_title": f"""WITH {_P},
x AS (SELECT release_tag, provision_id, trim(regexp_replace(coalesce(heading, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t, trim(regexp_replace({_EXCERPT}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS e FROM p)
SELECT release_tag, provision_id, CASE WHEN contains(t, e) THEN NULL ELSE nullif(CASE WHEN starts_with(e, t) THEN trim(substr(e, length(t) + 1)) ELSE e END, '') END AS beyond FROM x""",
    "search_lexical_unstemmed": f"WITH {_TOKENS} SELECT release_tag, kind, id FROM tok WHERE list_has_all(w, ['calendar', 'of', 'sittings'])",
    "search_lexical_phrase": f"WITH {_TOKENS} SELECT release_tag, kind, id FROM tok WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' calendar of sittings ') AND NOT list_contains(w, 'tribunal')",
    "index_terms": f"""WITH {_TOKENS}
SELECT release_tag, term, count(DISTINCT (kind, id)) AS n_texts, count(*) AS n_occurrences FROM (SELECT release_tag, kind, id, unnest(w) AS term FROM tok) GROUP BY 1, 2""",
}
