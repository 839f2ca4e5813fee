"""Exact and lexical search over one release or all.

The inverted index is a table of postings (release, kind, id, term, positions),
built once by an Arrow pass over the search texts and laid out by term, so a
query reads the postings of its terms only. A query is a web-search expression:
words are all required, ``or`` gives alternatives, quotes a phrase, a leading
minus excludes. Ranking is by cover density: the shorter the spans of text that
cover all terms, the higher (Clarke, Cormack and Tudhope, 2000).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.stemming import STOP_WORDS, stem
from codicil.functions.textkeys import excerpt, search_key_py

R = "release_tag"
#: Order of exact matches.
PRIORITY = {"exact_act_id": 1, "exact_provision_id": 1, "exact_act_citation": 2, "exact_act_title": 3, "exact_act_alias": 4, "exact_provision_reference": 5, "lexical": 6}
_TOKEN = re.compile(r"[^\W_]+")


class InvalidQuery(ValueError):
    pass


def checked_query(query: str, limit: int = 20) -> str:
    """The query in composed form without outer blanks: 1 to 256 code points; limit 1 to 50."""
    q = unicodedata.normalize("NFC", query).strip()
    if not 1 <= len(q) <= 256:
        raise InvalidQuery("a query has 1 to 256 characters")
    if not 1 <= limit <= 50:
        raise InvalidQuery("a limit is from 1 to 50")
    return q


def terms(text: str, stemmed: bool = True) -> list[tuple[str, int]]:
    """Indexed terms with their positions (from 1; words that are not indexed keep their place)."""
    out = []
    for i, w in enumerate(_TOKEN.findall(text.casefold()), 1):
        if not stemmed:
            out.append((w, i))
        elif w not in STOP_WORDS:
            out.append((stem(w), i))
    return out


@dataclass(frozen=True)
class Clause:
    """One alternative: phrases (of one or more terms) that must and must not occur."""

    must: tuple[tuple[str, ...], ...] = ()
    never: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = field(default_factory=tuple)

    @property
    def terms(self) -> list[str]:
        return sorted({t for c in self.clauses for p in (*c.must, *c.never) for t in p})


def parse(query: str, stemmed: bool = True) -> Query:
    """``a b``, ``a or b``, ``"a b"``, ``-a``; or binds weaker than the blank."""
    clauses: list[tuple[list, list]] = [([], [])]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word.lower() == "or" and not minus:
            clauses.append(([], []))
            continue
        got = tuple(t for t, _ in terms(phrase or word, stemmed))
        if got:
            clauses[-1][1 if minus else 0].append(got)
    return Query(tuple(Clause(tuple(m), tuple(n)) for m, n in clauses if m))


def _postings(stemmed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != "text"]
            rows, term, places = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                by: dict[str, list[int]] = {}
                for t, p in terms(text or "", stemmed):
                    by.setdefault(t, []).append(p)
                rows += [i] * len(by)
                term += by
                places += by.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n).take(at) for n in names), pa.array(term, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=[*names, "term", "positions"])

    return run


def build_postings(texts: DataFrame, stemmed: bool = True) -> DataFrame:
    """texts: release_tag, kind, id, text. One row for each text and term with the term's positions."""
    return texts.select(R, "kind", "id", "text").mapInArrow(_postings(stemmed), f"{R} string, kind string, id string, term string, positions array<int>")


def write_index(postings: DataFrame, path: str) -> None:
    """The index of one release laid out for reading by term: ranges of terms in files, sorted, so that statistics skip the others."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(path)


def _phrase_at(places: dict[str, list[int]], phrase: tuple[str, ...]) -> list[int]:
    if any(t not in places for t in phrase):
        return []
    sets = [set(places[t]) for t in phrase[1:]]
    return [p for p in places[phrase[0]] if all(p + k + 1 in s for k, s in enumerate(sets))]


#: Fixed value: weight of a word of the text (titles have no weight of their own).
WEIGHT = 0.1


def _spans(places: dict[str, list[int]], phrase: tuple[str, ...]) -> list[tuple[int, int]]:
    """Begin and end of each occurrence of a phrase."""
    return [(p, p + len(phrase) - 1) for p in _phrase_at(places, phrase)]


def cover_density(clauses: list[list[list[tuple[int, int]]]], words: list[int]) -> float:
    """Sum over the shortest covers of weight / (1 + words in it that the query doesn't ask for).

    clauses: for each alternative its phrases' occurrences; a cover holds all phrases
    of some alternative, and no shorter one within does. words: positions of all
    words of the query.
    """
    ends = sorted((e, s, c, k) for c, phrases in enumerate(clauses) for k, spans in enumerate(phrases) for s, e in spans)
    last = [[-1] * len(phrases) for phrases in clauses]
    total, begun, i = 0.0, -1, 0
    words = sorted(set(words))
    while i < len(ends):
        end = ends[i][0]
        while i < len(ends) and ends[i][0] == end:
            _, s, c, k = ends[i]
            last[c][k] = max(last[c][k], s)
            i += 1
        begin = max((min(x) for x in last if x), default=-1)
        if begin > begun:
            begun = begin
            asked = bisect_right(words, end) - bisect_left(words, begin)
            total += WEIGHT / (1 + max(0, end - begin + 1 - asked))
    return total


def _evaluate(query: Query):
    @F.pandas_udf("double")
    def run(found: pd.Series) -> pd.Series:
        def rank(rows):
            places = {r["term"]: list(r["positions"]) for r in rows}
            clauses = []
            for c in query.clauses:
                spans = [_spans(places, p) for p in c.must]
                if all(spans) and not any(_phrase_at(places, p) for p in c.never):
                    clauses.append(spans)
            asked = {t for c in query.clauses for p in c.must for t in p}
            return cover_density(clauses, [p for t in asked for p in places.get(t, ())]) if clauses else None

        return found.map(rank)

    return run


def lexical(postings: DataFrame, query: Query) -> DataFrame:
    """release_tag, kind, id, rank of the texts that match."""
    if not query.clauses:
        return postings.limit(0).select(R, "kind", "id", F.lit(0.0).alias("rank"))
    hits = postings.where(F.col("term").isin(query.terms))
    by_text = hits.groupBy(R, "kind", "id").agg(F.collect_list(F.struct("term", "positions")).alias("found"))  # at most one row for each term of the query
    return by_text.select(R, "kind", "id", F.round(_evaluate(query)("found"), 9).alias("rank")).where("rank is not null")


def exact_acts(acts: DataFrame, query: str) -> DataFrame:
    """Acts whose id, citation or a title key equals the query, with the kind of match.

    The long title is a key but no kind of match, so a hit by it alone is dropped.
    """
    key = search_key_py(query)
    hit = acts.where((F.col("act_id") == query) | (F.col("citation_key") == key) | F.array_contains("title_keys", key))
    own = lambda path: F.get_json_object("canonical_record", path)
    same = lambda c: _key_equals(c, key)
    aliases = F.from_json(own("$.aliases"), "array<string>")
    kind = (
        F.when(F.col("act_id") == query, "exact_act_id").when(F.col("citation_key") == key, "exact_act_citation")
        .when(same(own("$.titles.official")) | same(own("$.titles.short")), "exact_act_title")
        .when(F.array_contains(_keys_of(aliases), key), "exact_act_alias"))
    return hit.select(R, "act_id", kind.alias("match_kind")).where("match_kind is not null")


def _key_equals(c: Column, key: str) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and search_key_py(x) == key).astype(bool)

    return F.coalesce(run(c), F.lit(False))


def _keys_of(c: Column) -> Column:
    from codicil.functions.textkeys import distinct_keys

    return distinct_keys(F.coalesce(c, F.array().cast("array<string>")))


def named_act(acts: DataFrame, query: str) -> DataFrame:
    """The one act of each release whose title occurs in the query, and what the query asks of it.

    The longest title key is cut out with the blanks on both its sides, so a
    name amid the query glues its neighbours; releases in which several acts
    occur have none.
    """
    key = f" {search_key_py(query)} "
    inside = F.filter("title_keys", lambda k: (k != "") & (F.instr(F.lit(key), F.concat(F.lit(" "), k, F.lit(" "))) > 0))
    rows = acts.select(R, "act_id", inside.alias("keys")).where("size(keys) > 0")
    one = rows.groupBy(R).agg(F.count(F.lit(1)).alias("n"), F.first("act_id").alias("act_id"), F.first("keys").alias("keys")).where("n = 1")
    longest = F.aggregate("keys", F.lit(""), lambda a, k: F.when(F.char_length(k) > F.char_length(a), k).otherwise(a))
    at = one.withColumn("name", longest).withColumn("at", F.instr(F.lit(key), F.concat(F.lit(" "), "name", F.lit(" "))))
    rest = F.concat(F.expr("left(q, at - 1)"), F.expr("substring(q, at + char_length(name) + 2)"))
    return at.withColumn("q", F.lit(key)).select(R, "act_id", F.trim(F.regexp_replace(rest, " +", " ")).alias("reference_key"))


def exact_provisions(provisions: DataFrame, query: str, reference: DataFrame) -> DataFrame:
    """Provisions by id, or by reference key within the act that ``reference`` (release, act, key) names."""
    by_id = provisions.where(F.col("provision_id") == query).select(R, "act_id", "provision_id", F.lit("exact_provision_id").alias("match_kind"), excerpt("searchable_text", "reference_key").alias("excerpt"))
    asked = reference.where("reference_key <> ''")
    by_key = provisions.join(asked, [R, "act_id", "reference_key"]).where(F.col("provision_id") != query)
    return by_id.unionByName(by_key.select(R, "act_id", "provision_id", F.lit("exact_provision_reference").alias("match_kind"), excerpt("searchable_text", "reference_key").alias("excerpt")))


def search(acts: DataFrame, provisions: DataFrame, postings: DataFrame, query: str, act_id: str | None = None, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """Exact matches by kind, then lexical ones by rank, each record once, ``limit`` items for each release."""
    query = checked_query(query, limit)
    if act_id is None:
        reference, a, p = named_act(acts, query), acts, provisions
    else:
        a, p = acts.where(F.col("act_id") == act_id), provisions.where(F.col("act_id") == act_id)
        reference = a.select(R, "act_id").withColumn("reference_key", F.lit(search_key_py(query)))
    exact = exact_acts(a, query).select(R, F.lit("act").alias("kind"), F.col("act_id").alias("id"), "match_kind", F.lit(0.0).alias("rank"), "act_id", F.lit(0).alias("sequence"))
    prov = exact_provisions(p, query, reference).select(R, F.lit("provision").alias("kind"), F.col("provision_id").alias("id"), "match_kind", F.lit(0.0).alias("rank"), "act_id", F.lit(0).alias("sequence"))
    hits = lexical(postings, parse(query, stemmed))
    owner = a.select(R, F.lit("act").alias("kind"), F.col("act_id").alias("id"), "act_id", F.lit(0).alias("sequence")).unionByName(
        p.select(R, F.lit("provision").alias("kind"), F.col("provision_id").alias("id"), "act_id", "sequence"))
    lex = hits.join(owner, [R, "kind", "id"])
    # The lexical limit applies before repeated records are dropped, so fewer than ``limit`` may remain.
    top = lex.withColumn("_n", F.row_number().over(Window.partitionBy(R).orderBy(F.desc("rank"), "act_id", "sequence", "id"))).where(F.col("_n") <= limit)
    top = top.select(R, "kind", "id", F.lit("lexical").alias("match_kind"), "rank", "act_id", "sequence")
    rank_of = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    every = exact.unionByName(prov).unionByName(top).withColumn("priority", rank_of[F.col("match_kind")])
    order = [F.col("priority"), F.desc("rank"), F.when(F.col("priority") < 6, F.col("id")).otherwise(F.col("act_id")), F.col("sequence"), F.col("id")]
    once = every.withColumn("_k", F.row_number().over(Window.partitionBy(R, "kind", "id").orderBy(*order))).where("_k = 1")
    listed = once.withColumn("position", F.row_number().over(Window.partitionBy(R).orderBy(*order))).where(F.col("position") <= limit)
    return listed.select(R, F.col("position").cast("long").alias("position"), "kind", "id", "match_kind")


ACT_SUMMARY = ("act_id", "official_title", "short_title", "year", "number", "citation", "text_kind", "status", "checked_through_date")
PROVISION_SUMMARY = ("provision_id", "act_id", "node_type", "display_label", "heading")


def act_summary() -> Column:
    return F.struct(*ACT_SUMMARY)


def provision_summary() -> Column:
    return F.struct(*PROVISION_SUMMARY)


def items(listed: DataFrame, acts: DataFrame, provisions: DataFrame, crumbs: DataFrame) -> DataFrame:
    """Listed records as items: kind, match_kind, act, provision (null for acts), breadcrumb (summaries of the ancestors, from the root) and excerpt.

    crumbs: release_tag, provision_id, breadcrumb, for the listed provisions at least.
    """
    act = acts.select(R, F.col("act_id").alias("_act"), act_summary().alias("act"))
    prov = provisions.select(R, F.col("provision_id").alias("id"), F.lit("provision").alias("kind"), provision_summary().alias("provision"), excerpt("searchable_text", "reference_key").alias("excerpt"))
    rows = listed.join(prov, [R, "kind", "id"], "left").withColumn("_act", F.coalesce("provision.act_id", "id")).join(act, [R, "_act"])
    rows = rows.join(crumbs.select(R, F.col("provision_id").alias("id"), F.lit("provision").alias("kind"), "breadcrumb"), [R, "kind", "id"], "left")
    none = F.array().cast(rows.schema["breadcrumb"].dataType)
    return rows.select(R, "position", "kind", "match_kind", "act", "provision", F.coalesce("breadcrumb", none).alias("breadcrumb"), "excerpt")


def match_reason(kind) -> Column:
    """Why an item is listed, in words."""
    words = {"exact_act_id": "Exact act identifier", "exact_act_citation": "Exact citation", "exact_act_title": "Exact title", "exact_act_alias": "Exact alias", "exact_provision_id": "Exact provision identifier", "exact_provision_reference": "Exact reference", "lexical": "Words in the text"}
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[kind]


def excerpt_beyond(title: Column, text: Column) -> Column:
    """What an excerpt says beyond its title: blanks collapsed, the title as prefix cut, null if nothing is left."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    t, x = squeeze(F.coalesce(title, F.lit(""))), squeeze(text)
    cut = F.when(x.startswith(t), F.trim(F.substring(x, F.char_length(t) + 1, F.char_length(x)))).otherwise(x)
    return F.when(F.contains(t, x), F.lit(None)).otherwise(F.nullif(cut, F.lit("")))
