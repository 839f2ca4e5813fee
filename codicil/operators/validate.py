"""Integrity rules: each gives a violation table (rule, release_tag, key, detail).

Nothing is raised and nothing collected: a release is publishable when the
union of its violations is empty, and every violation is reported at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil import vocab
from codicil.functions.textkeys import act_of

R = "release_tag"


def violations(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), R, key.cast("string").alias("key"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    rows = df.groupBy(R, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(rows, "duplicate_key", F.col(key), F.col("n"))


def duplicate_ids_across(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Ids are unique over all kinds of record."""
    ids = reduce(DataFrame.unionByName, [df.select(R, F.col(k).alias("id")).distinct() for df, k in tables])
    return violations(ids.groupBy(R, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "id_used_twice", F.col("id"), F.col("n"))


def patterns(df: DataFrame, column: str, pattern: str) -> DataFrame:
    bad = df.where(F.col(column).isNull() | ~F.col(column).rlike(vocab.ID_PATTERNS[pattern]))
    return violations(bad, f"bad_{pattern}", F.coalesce(F.col(column), F.lit("")))


def closed_values(df: DataFrame, key: str, column: str, allowed: tuple) -> DataFrame:
    bad = df.where(~F.col(column).isin(*allowed) | F.col(column).isNull())
    return violations(bad, f"unknown_{column}", F.col(key), F.col(column))


def missing_target(df: DataFrame, key: str, column: str, targets: DataFrame, target_key: str, rule: str) -> DataFrame:
    """References that resolve to nothing in the same release."""
    refs = df.where(F.col(column).isNotNull()).select(R, key, F.col(column).alias("_ref"))
    lost = refs.join(targets.select(R, F.col(target_key).alias("_ref")).distinct(), [R, "_ref"], "left_anti")
    return violations(lost, rule, F.col(key), F.col("_ref"))


def foreign_parent(provisions: DataFrame) -> DataFrame:
    """A parent belongs to the same act."""
    bad = provisions.where(act_of("parent_provision_id") != F.col("act_id"))
    return violations(bad, "parent_in_other_act", F.col("provision_id"), F.col("parent_provision_id"))


def owner_prefix(provisions: DataFrame) -> DataFrame:
    bad = provisions.where(~F.col("provision_id").startswith(F.concat(F.col("act_id"), F.lit(":"))))
    return violations(bad, "id_outside_act", F.col("provision_id"), F.col("act_id"))


def incomplete_siblings(provisions: DataFrame) -> DataFrame:
    """The orders of the children of one parent are 1 to n, each once."""
    g = provisions.groupBy(R, "act_id", "parent_provision_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("sibling_order").alias("lo"), F.max("sibling_order").alias("hi"), F.countDistinct("sibling_order").alias("d"))
    bad = g.where("not (n = d and lo = 1 and hi = n) or d = 0")
    return violations(bad, "sibling_order", F.coalesce("parent_provision_id", "act_id"), F.concat_ws("/", "lo", "hi", "d", "n"))


def depth_against_parent(provisions: DataFrame) -> DataFrame:
    up = provisions.select(R, F.col("provision_id").alias("parent_provision_id"), F.col("depth").alias("up"))
    j = provisions.join(up, [R, "parent_provision_id"], "left")
    want = F.when(F.col("parent_provision_id").isNull(), 0).otherwise(F.col("up") + 1)
    return violations(j.where(want.isNotNull() & ~F.col("depth").eqNullSafe(want)), "depth", F.col("provision_id"), F.concat_ws("/", F.col("depth"), want))


def positions(provisions: DataFrame) -> DataFrame:
    bad = provisions.where("sibling_order < 1 or sequence < 1 or depth < 0")
    return violations(bad, "not_positive", F.col("provision_id"), F.concat_ws("/", "sibling_order", "sequence", "depth"))


def sequence_gaps(provisions: DataFrame) -> DataFrame:
    """Sequence numbers of an act that are used twice or leave a gap before them."""
    w = Window.partitionBy(R, "act_id").orderBy("sequence", "provision_id")
    step = provisions.withColumn("before", F.coalesce(F.lag("sequence").over(w), F.lit(0)))
    return violations(step.where("sequence <> before + 1"), "sequence", F.col("provision_id"), F.concat_ws("/", "before", "sequence"))


def reading_order(contents: DataFrame, provisions: DataFrame) -> DataFrame:
    """Stored sequence and preorder of the tree put the nodes of an act into the same order."""
    w = Window.partitionBy(R, "act_id").orderBy("sequence", "provision_id")
    j = contents.select(R, "act_id", "provision_id", "position").join(provisions.select(R, "provision_id", "sequence"), [R, "provision_id"])
    bad = j.withColumn("rank", F.row_number().over(w)).where("rank <> position")
    return violations(bad, "reading_order", F.col("provision_id"), F.concat_ws("/", "rank", "position"))


def mirrors(df: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
    """Columns that must equal a member of the record, null-safely. ``pairs``: column to JSON path."""
    checks = F.array(*[
        F.when(~F.col(c).cast("string").eqNullSafe(F.get_json_object("canonical_record", path)), F.lit(c)) for c, path in pairs.items()])
    bad = df.select(R, key, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("column"))
    return violations(bad, "column_differs_from_record", F.col(key), F.col("column"))


def _named(acts: DataFrame) -> DataFrame:
    refs = F.from_json(F.get_json_object("canonical_record", "$.source_refs"), "array<struct<source_id:string>>")
    return acts.select(R, "act_id", F.explode(F.transform(refs, lambda x: x["source_id"])).alias("source_id")).distinct()


def unnamed_evidence(acts: DataFrame) -> DataFrame:
    """Sources of the status and of the dates of an act that are not among those it names."""
    ids = lambda path: F.coalesce(F.from_json(F.get_json_object("canonical_record", path), "array<string>"), F.array().cast("array<string>"))
    dates = F.from_json(F.get_json_object("canonical_record", "$.dates"), "map<string,struct<source_ids:array<string>>>")
    dated = F.flatten(F.transform(F.map_values(dates), lambda x: F.coalesce(x["source_ids"], F.array().cast("array<string>"))))
    used = acts.select(R, "act_id", F.explode(F.concat(ids("$.status_source_ids"), F.coalesce(dated, F.array().cast("array<string>")))).alias("source_id")).distinct()
    return violations(used.join(_named(acts), [R, "act_id", "source_id"], "left_anti"), "evidence_not_named", F.col("act_id"), F.col("source_id"))


def missing_named(acts: DataFrame, sources: DataFrame) -> DataFrame:
    lost = _named(acts).join(sources.select(R, "source_id"), [R, "source_id"], "left_anti")
    return violations(lost, "named_source_missing", F.col("act_id"), F.col("source_id"))


def unlinked_sources(acts: DataFrame, provisions: DataFrame) -> DataFrame:
    """Sources of a provision that its act does not name."""
    own = provisions.select(R, "act_id", "provision_id", F.explode("source_ids").alias("source_id")).distinct()
    named = acts.select(R, "act_id", F.explode("source_ids").alias("source_id")).distinct()
    return violations(own.join(named, [R, "act_id", "source_id"], "left_anti"), "source_not_of_act", F.col("provision_id"), F.col("source_id"))


def pages_beyond(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited pages that the source does not have."""
    spans = blocks.select(R, "provision_id", F.explode(F.arrays_zip("source_ids", "pdf_pages")).alias("x")).select(R, "provision_id", F.col("x.source_ids").alias("source_id"), F.col("x.pdf_pages").alias("page"))
    j = spans.join(sources.select(R, "source_id", "page_count"), [R, "source_id"]).where("page < 1 or page > page_count").distinct()
    return violations(j, "page_beyond_source", F.col("provision_id"), F.concat_ws("/", "page", "page_count"))


def duplicate_content_ids(blocks: DataFrame) -> DataFrame:
    g = blocks.where("block_id is not null").groupBy(R, "provision_id", "block_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(g, "content_id_used_twice", F.col("provision_id"), F.col("block_id"))


def citation_ranges(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """A citation's block exists, has text, and holds its range of code points."""
    own = citations.select(R, "citation_id", F.col("source_provision_id").alias("provision_id"), F.col("source_block_id").alias("block_id"),
                           F.get_json_object("canonical_record", "$.text_range.start").try_cast("int").alias("start"), F.get_json_object("canonical_record", "$.text_range.end").try_cast("int").alias("end"))
    texts = blocks.where("text is not null and block_id is not null").groupBy(R, "provision_id", "block_id").agg(F.max(F.char_length("text")).alias("size"))
    j = own.join(texts, [R, "provision_id", "block_id"], "left")
    why = F.when(F.col("size").isNull(), "no_block").when(~((F.col("start") >= 0) & (F.col("start") < F.col("end"))), "reversed").when(F.col("end") > F.col("size"), "beyond_text")
    return violations(j.withColumn("why", why).where("why is not null"), "citation_range", F.col("citation_id"), F.col("why"))


def target_mismatch(citations: DataFrame) -> DataFrame:
    bad = citations.where(F.col("target_provision_id").isNotNull() & (act_of("target_provision_id") != F.col("target_act_id")))
    return violations(bad, "target_act_differs", F.col("citation_id"), F.col("target_provision_id"))


def citation_prefix(citations: DataFrame) -> DataFrame:
    bad = citations.where(~F.col("citation_id").startswith(F.concat(F.lit("citation:"), act_of("source_provision_id"), F.lit(":"))))
    return violations(bad, "citation_id_outside_act", F.col("citation_id"), F.col("source_provision_id"))


# Tables as grids.


def cells_beyond(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy(R, "provision_id", "table_id", "row_group").agg(F.max("row_index").alias("last"))
    j = cells.join(rows, [R, "provision_id", "table_id", "row_group"])
    wide = j.where(F.col("column_start") + F.col("column_span") - 1 > F.col("column_count"))
    tall = j.where(F.col("row_index") + F.col("row_span") - 1 > F.col("last"))
    return all_of(violations(wide, "cell_too_wide", F.col("provision_id"), F.col("block_id")), violations(tall, "cell_too_tall", F.col("provision_id"), F.col("block_id")))


def cell_overlap(cells: DataFrame) -> DataFrame:
    """Grid places that two cells take."""
    at = cells.where("row_span >= 1 and column_span >= 1").select(
        R, "provision_id", "table_id", F.explode(F.sequence("row_index", F.col("row_index") + F.col("row_span") - 1)).alias("r"), "column_start", "column_span")
    at = at.select(R, "provision_id", "table_id", "r", F.explode(F.sequence("column_start", F.col("column_start") + F.col("column_span") - 1)).alias("c"))
    g = at.groupBy(R, "provision_id", "table_id", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(g, "cells_overlap", F.col("provision_id"), F.concat_ws("/", "table_id", "r", "c"))


def header_references(cells: DataFrame) -> DataFrame:
    """Header ids of a cell name header cells of the same table."""
    refs = cells.select(R, "provision_id", "table_id", F.explode("header_cell_ids").alias("ref"))
    heads = cells.select(R, "provision_id", "table_id", F.col("block_id").alias("ref"), "role")
    bad = refs.join(heads, [R, "provision_id", "table_id", "ref"], "left").where("role is null or role <> 'header'")
    return violations(bad, "header_reference", F.col("provision_id"), F.col("ref"))


def blank_with_content(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cells marked blank that hold content below their path."""
    held = blocks.where("kind <> 'cell' and size(path) > 4").select(R, "provision_id", F.array_join(F.slice("path", 1, F.size("path") - 1), "/").alias("at")).distinct()
    own = cells.where("blank").select(R, "provision_id", "block_id", F.array_join("path", "/").alias("at"))
    return violations(own.join(held, [R, "provision_id", "at"], "left_semi"), "blank_cell_with_content", F.col("provision_id"), F.col("block_id"))


def segment_rows(blocks: DataFrame) -> DataFrame:
    """Rows that a table's source segments name: they exist; repeated ones are header rows and among the segment's own."""
    rows = blocks.where("kind = 'cell'").select(R, "provision_id", "table_id", F.col("row_id").alias("ref"), F.col("group_role").alias("_role")).distinct()
    segments = blocks.where("kind = 'segment'").select(R, "provision_id", "table_id", "block_id", F.coalesce("row_ids", F.array().cast("array<string>")).alias("own"), F.coalesce("repeated_row_ids", F.array().cast("array<string>")).alias("again"))
    named = segments.select(R, "provision_id", "table_id", "block_id", "own", F.explode(F.concat(
        F.transform("own", lambda r: F.struct(r.alias("ref"), F.lit(False).alias("repeated"))), F.transform("again", lambda r: F.struct(r.alias("ref"), F.lit(True).alias("repeated"))))).alias("x")).select("*", "x.*")
    j = named.join(rows, [R, "provision_id", "table_id", "ref"], "left")
    rule = (
        F.when(F.col("_role").isNull(), F.when(F.col("repeated"), "unknown_repeated_row").otherwise("unknown_segment_row"))
        .when(F.col("repeated") & (F.col("_role") != "header"), "repeated_row_no_header").when(F.col("repeated") & ~F.array_contains("own", F.col("ref")), "repeated_row_not_own"))
    bad = j.withColumn("_rule", rule).where("_rule is not null").distinct()
    return bad.select(F.col("_rule").alias("rule"), R, F.col("provision_id").alias("key"), F.concat_ws("/", "block_id", "ref").alias("detail"))


# URLs and requests.


def bad_url(url: Column) -> Column:
    """Why a URL can't be a source location, or null: http(s), a host, no credentials, no fragment."""
    u = F.coalesce(url, F.lit(""))
    authority = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(~F.lower(u).rlike("^https?://"), "scheme").when(F.contains(authority, F.lit("@")), "credentials")
        .when(F.regexp_replace(authority, ":[0-9]*$", "") == "", "host").when(F.contains(u, F.lit("#")), "fragment"))


def act_directory(act_id: Column) -> Column:
    """Where an act's files lie: country/scope/acts/year/rest of the id."""
    part = lambda rule: F.regexp_extract(act_id, rule, 1)
    return F.concat_ws("/", part("^([a-z]{2})-"), part("^[a-z]{2}-(.*?)-[0-9]{4}-"), F.lit("acts"), part("-([0-9]{4})-"), part("-[0-9]{4}-(.*)$"))


def required_fields(record: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """Missing and unknown members of a JSON object, as an array of messages."""
    keys = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    known = F.array(*[F.lit(x) for x in (*required, *optional)])
    return F.concat(
        F.transform(F.array_except(F.array(*[F.lit(x) for x in required]), keys), lambda x: F.concat(F.lit("missing "), x)),
        F.transform(F.array_except(keys, known), lambda x: F.concat(F.lit("unknown "), x)))
