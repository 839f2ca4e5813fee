"""Release-scoped reads: listings, single records, provision detail, response identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.errors import Unavailable

R = "release_tag"


def scoped(df: DataFrame, release_tag: str | None) -> DataFrame:
    """One release, or all: an absent option leaves no trace in the plan."""
    return df if release_tag is None else df.where(F.col(R) == release_tag)


def list_acts(acts: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the acts of each release by first title key, newest year first; ``total`` beside each row.

    Offset and limit belong to the listing itself.
    """
    if not (0 <= offset and 1 <= limit <= 100):
        raise ValueError("offset from 0, limit from 1 to 100")
    w = Window.partitionBy(R).orderBy(F.try_element_at("title_keys", F.lit(1)), F.desc("year"), "act_id")
    rows = acts.select(R, "act_id", "official_title", "short_title", "year", "number", "citation", "text_kind", "status", F.row_number().over(w).alias("_n"))
    # The bound on the row number lets each task keep only its first rows before the shuffle.
    page = rows.where(F.col("_n") <= offset + limit).where(F.col("_n") > offset).drop("_n")
    return page.join(acts.groupBy(R).agg(F.count(F.lit(1)).alias("total")), R)


def act_sources(acts: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources of each act in the order in which its record names them first."""
    refs = acts.select(R, "act_id", F.from_json(F.get_json_object("canonical_record", "$.source_refs"), "array<struct<source_id:string,role:string>>").alias("refs"))
    first = refs.select(R, "act_id", F.posexplode(F.array_distinct(F.transform("refs", lambda x: x["source_id"]))).alias("position", "source_id"))
    held = sources.select(R, "source_id", "document_title", "source_class")
    return first.join(held, [R, "source_id"]).select(R, "act_id", (F.col("position") + 1).cast("long").alias("position"), "source_id", "document_title", "source_class")


def incomplete_acts(acts: DataFrame, sources: DataFrame) -> DataFrame:
    """Acts whose number of sources found differs from the number they name."""
    want = acts.select(R, "act_id", F.size(F.array_distinct("source_ids")).cast("long").alias("n_named"), F.explode_outer("source_ids").alias("source_id"))
    got = want.join(sources.select(R, "source_id", F.lit(1).alias("_held")), [R, "source_id"], "left")
    out = got.groupBy(R, "act_id", "n_named").agg(F.countDistinct(F.when(F.col("_held") == 1, F.col("source_id"))).alias("n_found"))
    return out.where("n_named <> n_found")


def contents_of(contents: DataFrame, act_id: str | None = None, parent_provision_id: str | None = None, max_depth: int | None = None) -> DataFrame:
    """Outline rows with optional scope; an absent option is no predicate at all."""
    out = contents
    for condition in (
        None if act_id is None else F.col("act_id") == act_id,
        None if parent_provision_id is None else F.col("parent_provision_id") == parent_provision_id,
        None if max_depth is None else F.col("depth") <= max_depth,
    ):
        out = out if condition is None else out.where(condition)
    return out


def citations_of(citations: DataFrame, acts: DataFrame, provisions: DataFrame) -> DataFrame:
    """Citations with their target act and, where one is named, target provision."""
    act = acts.select(R, F.col("act_id").alias("target_act_id"), F.col("official_title").alias("target_title"))
    prov = provisions.select(R, F.col("provision_id").alias("target_provision_id"), F.col("display_label").alias("target_label"))
    return citations.join(act, [R, "target_act_id"]).join(prov, [R, "target_provision_id"], "left").select(
        R, "citation_id", "source_provision_id", "target_act_id", "target_title", "target_provision_id", "target_label")


def provision_detail(provisions: DataFrame, neighbours: DataFrame, hierarchy: DataFrame, citations: DataFrame) -> DataFrame:
    """One row for each provision: breadcrumb, neighbours, number of descendants, sources, and its citations in order."""
    cited = citations.groupBy(R, F.col("source_provision_id").alias("provision_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_id"))), lambda x: x["citation_id"]), ",").alias("citations"))
    names = F.array_join(F.transform(F.slice("steps", 1, F.col("depth").cast("int")), lambda x: x[2]), " > ")
    placed = hierarchy.where("steps is not null").select(R, "provision_id", names.alias("breadcrumb"), "n_descendants")
    out = provisions.select(R, "provision_id", "act_id", F.array_join(F.array_sort(F.array_distinct("source_ids")), ",").alias("sources"))
    for extra in (neighbours, placed, cited):
        out = out.join(extra, [R, "provision_id"], "left")
    return out.select(R, "provision_id", "act_id", "sources", "previous_id", "next_id", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.coalesce("citations", F.lit("")).alias("citations"))


def payload(provisions: DataFrame, closure: DataFrame, hierarchy: DataFrame, acts: DataFrame, sources: DataFrame, citations: DataFrame) -> DataFrame:
    """What a reader of each provision is given, for all that reach a root: its act, the provisions below in order, and the sources and citations of the whole subtree.

    ``n_sources`` counts the sources that the subtree names, ``sources`` lists those that the release holds; citations name their targets.
    """
    own = hierarchy.where("path is not null").select(R, "provision_id", F.col("provision_id").alias("member"))
    pairs = own.unionByName(closure.select(R, F.col("ancestor").alias("provision_id"), F.col("descendant").alias("member")))
    members = pairs.join(provisions.select(R, F.col("provision_id").alias("member"), "sequence", "source_ids"), [R, "member"])
    below = members.where("member <> provision_id").groupBy(R, "provision_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "member"))).alias("b"))
    below = below.select(R, "provision_id", F.array_join(F.transform("b", lambda x: x["member"]), ",").alias("descendants"))
    named = members.select(R, "provision_id", F.explode("source_ids").alias("source_id")).distinct().join(sources.select(R, "source_id", F.lit(True).alias("_held")), [R, "source_id"], "left")
    named = named.groupBy(R, "provision_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_held"), F.col("source_id")))), ",").alias("sources"))
    act = acts.select(R, F.col("act_id").alias("target_act_id"))
    target = provisions.select(R, F.col("act_id").alias("target_act_id"), F.col("provision_id").alias("target_provision_id"), F.col("provision_id").alias("_target"))
    cited = citations.join(act, [R, "target_act_id"]).join(target, [R, "target_act_id", "target_provision_id"], "left")
    cited = members.join(cited.withColumnRenamed("source_provision_id", "member"), [R, "member"]).select(
        R, "provision_id", F.struct("sequence", "citation_id", F.concat_ws("/", F.concat_ws(">", "citation_id", "target_act_id"), "_target").alias("t")).alias("c"))
    cited = cited.groupBy(R, "provision_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["t"]), ",").alias("citations"))
    out = own.select(R, "provision_id").join(provisions.select(R, "provision_id", "act_id"), [R, "provision_id"]).join(acts.select(R, "act_id", "official_title"), [R, "act_id"])
    for extra in (below, named, cited):
        out = out.join(extra, [R, "provision_id"], "left")
    return out.select(R, "provision_id", "official_title", *[F.coalesce(c, F.lit("")).alias(c) for c in ("descendants", "sources", "citations")], F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def etag(body: Column) -> Column:
    """Strong validator of a response body."""
    return F.concat(F.lit('"'), F.sha2(body, 256), F.lit('"'))


def not_modified(tag: str, if_none_match: str | None) -> bool:
    """Whether a conditional request needs no body: any listed tag, weak or strong, or *."""
    if if_none_match is None:
        return False
    tags = [t.strip() for t in if_none_match.split(",")]
    return "*" in tags or any(t.removeprefix("W/") == tag for t in tags)


def source_line(title, publisher, pages) -> Column:
    """Provenance footnote."""
    return F.concat_ws(", ", title, publisher, F.when(pages.isNotNull(), F.concat(F.lit("pages "), pages.cast("string"))))


def one_release(*tags: str) -> str:
    """The release that several reads came from; a mixture is refused, since a publication lay between them."""
    if len(set(tags)) != 1:
        raise Unavailable(f"reads from {', '.join(sorted(set(tags)))}; read again")
    return tags[0]


def page_links(offset: Column, limit: Column, total: Column) -> Column:
    """Offsets of the previous and next page, null where there is none."""
    return F.struct(
        F.when(offset > 0, F.greatest(F.lit(0), offset - limit)).alias("previous"), F.when(offset + limit < total, offset + limit).alias("next"))


def parse_offset(text) -> Column:
    """A page offset from a request; anything that is no number counts as 0."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(text.try_cast("bigint"), F.lit(0)))
