"""Derived wording and structured data for readers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.textkeys import json_script_safe
from codicil.sources.sinks import json_text

#: Node types that hold others and are listed, not read through.
CONTAINERS = ("part", "chapter", "division", "schedule", "schedule_part", "arrangement")
#: Legal force in structured data; spent and unknown say nothing.
FORCE = {"in_force": "InForce", "repealed": "NotInForce", "not_yet_commenced": "NotInForce", "mixed": "PartiallyInForce"}


def is_container(node_type: Column) -> Column:
    return node_type.isin(*CONTAINERS)


def title(label: Column, heading: Column, node_type: Column) -> Column:
    """Label and heading, else the node type in words."""
    said = F.concat_ws(" ", F.nullif(F.trim(label), F.lit("")), F.nullif(F.trim(heading), F.lit("")))
    return F.when(said != "", said).otherwise(F.initcap(F.regexp_replace(node_type, "_", " ")))


def currentness(checked: Column) -> Column:
    return F.when(checked.isNull(), "Currentness not checked").otherwise(F.concat(F.lit("Checked through "), F.date_format(checked, "d MMMM yyyy")))


def href(act_id: Column, provision_id: Column) -> Column:
    """Path of a provision's page: the part of its id behind the act, percent-encoded."""
    local = F.regexp_replace(provision_id, "^[^:]*:", "")
    return F.concat(F.lit("/acts/"), F.url_encode(act_id), F.when(provision_id.isNotNull(), F.concat(F.lit("/"), F.url_encode(local))).otherwise(""))


def preferred_date(commencement: Column, assent: Column) -> Column:
    return F.coalesce(commencement, assent)


def legislation(acts: DataFrame) -> DataFrame:
    """JSON-LD of each act, safe inside a script element; members without a value are left out."""
    force = F.create_map(*[F.lit(x) for kv in FORCE.items() for x in kv])
    date = preferred_date(F.get_json_object("canonical_record", "$.dates.commencement.date"), F.get_json_object("canonical_record", "$.dates.assent.date"))
    body = F.to_json(F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Legislation").alias("@type"), F.col("act_id").alias("identifier"), F.col("official_title").alias("name"),
        F.col("short_title").alias("alternateName"), date.alias("legislationDate"), force[F.col("status")].alias("legislationLegalForce")))
    return acts.select("release_tag", "act_id", json_script_safe(body).alias("json_ld"))


def breadcrumb_list(crumbs: Column) -> Column:
    """JSON-LD of a breadcrumb: array of (name, href) as list items from 1."""
    items = F.transform(crumbs, lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["href"].alias("item")))
    return json_text(F.struct(F.lit("BreadcrumbList").alias("@type"), items.alias("itemListElement")))


def list_marker(style: Column, position: Column) -> Column:
    """Generated marker of a list item without a printed label."""
    alpha = F.char(F.lit(96) + position)
    roman = F.lower(_roman(position))
    return (
        F.when(style == "decimal", F.concat(position.cast("string"), F.lit("."))).when(style == "lower_alpha", F.concat(F.lit("("), alpha, F.lit(")")))
        .when(style == "upper_alpha", F.concat(F.lit("("), F.upper(alpha), F.lit(")"))).when(style == "lower_roman", F.concat(F.lit("("), roman, F.lit(")")))
        .when(style == "upper_roman", F.concat(F.lit("("), F.upper(roman), F.lit(")"))).when(style == "bullet", "•"))


def _roman(n: Column) -> Column:
    units = F.array(*[F.lit(x) for x in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")])
    tens = F.array(*[F.lit(x) for x in ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")])
    return F.concat(F.get(tens, F.floor(n / 10).cast("int") % 10), F.get(units, n % 10))


def cited_segments(text: Column, ranges: Column) -> Column:
    """Text cut at citation ranges (start, end, citation_id), in order of their start.

    Reversed ranges, those outside the text and those that overlap an earlier
    one are skipped. array<struct<text, citation_id>>; pieces without a citation
    have a null id.
    """
    kind = "array<struct<text:string,citation_id:string>>"
    size = F.char_length(text)
    fit = F.array_sort(F.filter(ranges, lambda r: (r["start"] >= 0) & (r["start"] < r["end"]) & (r["end"] <= size)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def piece(a, b, cid):
        return F.struct(F.substring(text, a + 1, b - a).alias("text"), cid.cast("string").alias("citation_id"))

    def step(acc, r):
        before = F.when(r["start"] > acc["at"], F.array(piece(acc["at"], r["start"], F.lit(None)))).otherwise(F.array().cast(kind))
        taken = F.struct(r["end"].cast("int").alias("at"), F.concat(acc["out"], before, F.array(piece(r["start"], r["end"], r["citation_id"]))).alias("out"))
        return F.when(r["start"] >= acc["at"], taken).otherwise(acc)

    def finish(acc):
        return F.when(acc["at"] < size, F.concat(acc["out"], F.array(piece(acc["at"], size, F.lit(None))))).otherwise(acc["out"])

    return F.aggregate(fit, start, step, finish)
