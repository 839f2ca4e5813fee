"""Structure of drafts: plans, node rules, section sequence, patches, permanent ids."""

from __future__ import annotations

import copy
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil import vocab
from codicil.errors import PipelineError
from codicil.functions import textkeys as K
from codicil.operators import hierarchy as H
from codicil.operators.validate import all_of
from codicil.session import durable

# Permanent ids.

#: Node types whose ids are fixed, and those that start anew instead of extending their parent's id.
FIXED = ("document_title", "long_title", "arrangement", "preamble", "enacting_formula", "authentication", "explanatory_note")
ABSOLUTE = ("part", "chapter", "division", "section", "schedule", *FIXED)
UNNUMBERED = ("subsection", "paragraph", "subparagraph", "schedule_paragraph", "schedule_subparagraph")


def segments(nodes: DataFrame) -> DataFrame:
    """nodes with ``segment``: the step a node adds to its id; null where none can be assigned.

    nodes: scope, node_id, parent_id, seq, node_type, display_label, heading, order, first_text.
    """
    kind = F.col("node_type")
    running = Window.partitionBy("scope").orderBy("seq", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    schedule_no = F.sum(F.when(kind == "schedule", 1).otherwise(0)).over(running)
    token = F.when(kind == "definition", K.definition_term("first_text")).otherwise(K.marker_token("display_label", "node_type"))
    token = F.coalesce(
        token, F.when(kind.isin("cross_heading", "table", "form"), F.nullif(K.slug("heading"), F.lit(""))),
        F.when(kind.isin(*UNNUMBERED) & F.col("parent_id").isNotNull() & (F.col("order") >= 1), F.concat(F.lit("unnumbered-"), F.col("order").cast("string"))))
    name = F.when(kind.startswith("schedule_"), F.regexp_replace(kind, "^schedule_", "")).otherwise(F.regexp_replace(kind, "_", "-"))
    step = (
        F.when(kind == "schedule", F.concat(F.lit("schedule-"), schedule_no.cast("string"))).when(kind.isin(*FIXED), F.regexp_replace(kind, "_", "-"))
        .otherwise(F.concat(name, F.lit("-"), token)))
    return nodes.withColumn("segment", step)


def assign_ids(nodes: DataFrame) -> DataFrame:
    """scope, node_id, local_id for nodes that reach a root.

    An id extends the parent's id without its collision suffix, so it is the
    join of the segments from the last node of an absolute type on: no fold in
    document order is needed. Equal ids get ~2, ~3, ... by position.
    """
    rows = durable(segments(nodes), "segments")
    h = H.build_hierarchy(rows, "scope", "node_id", "parent_id", carry=(F.col("segment"), F.col("node_type").isin(*ABSOLUTE)))
    start = F.array_max(F.transform("steps", lambda x, i: F.when(x[2] == "true", i)))
    base = F.array_join(F.transform(F.filter("steps", lambda x, i: i >= F.coalesce(start, F.lit(0))), lambda x: x[1]), ".")
    g = h.where("steps is not null").select("scope", "node_id", base.alias("base"))
    based = rows.select("scope", "node_id", "seq", "segment").join(g, ["scope", "node_id"]).where("segment is not null")
    n = F.row_number().over(Window.partitionBy("scope", "base").orderBy("seq", "node_id"))
    return based.withColumn("n", n).select("scope", "node_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("~"), F.col("n").cast("string"))).alias("local_id"))


def unassignable(nodes: DataFrame) -> DataFrame:
    return segments(nodes).where("segment is null").select("scope", "node_id", "node_type")


# Node rules.


def parent_matrix(nodes: DataFrame) -> DataFrame:
    """Nodes under a parent of a type that may not own them."""
    up = nodes.select("scope", F.col("node_id").alias("parent_id"), F.col("node_type").alias("parent_type"))
    j = nodes.join(up, ["scope", "parent_id"], "left")
    bad = F.lit(False)
    for kind, allowed in vocab.PARENTS.items():
        named = [a for a in allowed if a is not None]
        fits = F.col("parent_type").isin(*named) | (F.col("parent_id").isNull() if None in allowed else F.lit(False))
        bad = bad | ((F.col("node_type") == kind) & ~F.coalesce(fits, F.lit(False)))
    return j.where(bad).select("scope", "node_id", "node_type", F.coalesce("parent_type", F.lit("")).alias("parent_type"))


def mixed_children(nodes: DataFrame) -> DataFrame:
    """Sections that own both subsections and paragraphs."""
    g = nodes.where(F.col("node_type").isin("subsection", "paragraph")).groupBy("scope", "parent_id").agg(F.countDistinct("node_type").alias("n")).where("n = 2")
    sections = nodes.where("node_type = 'section'").select("scope", F.col("node_id").alias("parent_id"))
    return g.join(sections, ["scope", "parent_id"]).select("scope", F.col("parent_id").alias("node_id"))


def empty_leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without wording and without children."""
    kids = nodes.where("parent_id is not null").select("scope", F.col("parent_id").alias("node_id")).distinct()
    blank = F.trim(F.coalesce("first_text", F.lit(""))) == ""
    return nodes.where(blank & (F.trim(F.coalesce("heading", F.lit(""))) == "")).join(kids, ["scope", "node_id"], "left_anti").select("scope", "node_id", "node_type")


def hidden_markers(nodes: DataFrame) -> DataFrame:
    """Wording that holds a marker which should be a node of its own: one that opens a later line, or stands behind a dash, colon or semicolon."""
    inside = F.slice(F.split("first_text", "\n|[—–]\\s*|[:;]\\s+"), 2, 1_000_000)
    found = F.flatten(F.transform(inside, K.markers))
    return nodes.where("first_text is not null").select("scope", "node_id", F.get(found, F.lit(0)).alias("marker")).where("marker is not null")


def structural_lists(blocks: DataFrame) -> DataFrame:
    """Lists that should be nodes: their style numbers the law's own units, or one of their items has a marker for a label.

    blocks: scope, node_id, marker_style, labels (array of the items' labels).
    """
    marked = F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: K.is_marker(x))
    return blocks.where(F.col("marker_style").isin("decimal", "lower_alpha", "upper_alpha", "lower_roman", "upper_roman") | marked).select("scope", "node_id", "marker_style")


def unit_roots(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """Units whose draft has not exactly the one root that the plan names. nodes: scope, unit_id, parent_id, display_label, heading; units: scope, unit_id, display_label, heading."""
    top = nodes.where("parent_id is null").groupBy("scope", "unit_id").agg(
        F.count(F.lit(1)).alias("n_roots"), F.first("display_label").alias("label"), F.first("heading").alias("head"))
    key = lambda c: F.coalesce(K.audit_key(c), F.lit(""))
    j = units.select("scope", "unit_id", "display_label", "heading").join(top, ["scope", "unit_id"], "left").withColumn("n_roots", F.coalesce("n_roots", F.lit(0)))
    why = F.when(F.col("n_roots") != 1, "roots").when((key("display_label") != "") & (key("label") != key("display_label")), "label").when((key("heading") != "") & (key("head") != key("heading")), "heading")
    return j.select("scope", "unit_id", why.alias("issue"), "n_roots").where("issue is not null")


def page_gaps(nodes: DataFrame) -> DataFrame:
    """Pages within a unit's span that none of its nodes cites. nodes: scope, unit_id, pages (array<int>)."""
    cited = nodes.select("scope", "unit_id", F.explode("pages").alias("pdf_page")).distinct()
    span = cited.groupBy("scope", "unit_id").agg(F.min("pdf_page").alias("a"), F.max("pdf_page").alias("b"))
    every = span.select("scope", "unit_id", F.explode(F.sequence("a", "b")).alias("pdf_page"))
    return every.join(cited, ["scope", "unit_id", "pdf_page"], "left_anti")


def repeated_ancestor_text(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Nodes whose wording stands already in an ancestor."""
    t = nodes.where("length(first_text) >= 20")
    low = t.select("scope", F.col("node_id").alias("descendant"), "first_text")
    high = t.select("scope", F.col("node_id").alias("ancestor"), F.col("first_text").alias("above"))
    return closure.join(low, ["scope", "descendant"]).join(high, ["scope", "ancestor"]).where(F.contains("above", F.col("first_text"))).select("scope", F.col("descendant").alias("node_id"), "ancestor")


def unrecoverable(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Labels and headings whose characters don't occur in order on the page they are cited from."""
    j = nodes.join(pages.select("scope", "pdf_page", "text"), ["scope", "pdf_page"])
    parts = [j.where(F.col(c).isNotNull() & ~K.is_subsequence(K.audit_key(c), K.audit_key("text"))).select("scope", "node_id", F.lit(c).alias("field")) for c in ("display_label", "heading")]
    return all_of(*parts)


def canonical_types(nodes: DataFrame) -> DataFrame:
    """Inside a schedule, parts and paragraphs take the schedule's own node types."""
    inside = F.col("in_schedule")
    table = F.create_map(*[F.lit(x) for x in ("part", "schedule_part", "paragraph", "schedule_paragraph", "subparagraph", "schedule_subparagraph", "section", "schedule_paragraph", "subsection", "schedule_subparagraph")])
    return nodes.withColumn("node_type", F.when(inside, F.coalesce(table[F.col("node_type")], F.col("node_type"))).otherwise(F.col("node_type")))


def section_jumps(nodes: DataFrame) -> DataFrame:
    """Sections whose number does not follow: n is followed by n+1 or nA, nA by nB or n+1.

    A label that is no number starts a new run; scope, seq, node_type, display_label.
    """
    own = nodes.where("node_type = 'section' and display_label is not null and display_label <> ''")
    fits = F.col("display_label").rlike("(?i)^\\s*\\d+[a-z]?\\.?\\s*$")
    own = own.withColumns({
        "fits": fits, "num": F.when(fits, F.regexp_extract("display_label", "(\\d+)", 1).cast("int")),
        "suffix": F.when(fits, F.lower(F.regexp_extract("display_label", "(?i)\\d+([a-z]?)", 1)))})
    order = Window.partitionBy("scope").orderBy("seq", "node_id")
    own = own.withColumn("run", F.sum(F.when(fits, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("fits")
    w = Window.partitionBy("scope", "run").orderBy("seq", "node_id")
    own = own.withColumns({"n0": F.lag("num").over(w), "s0": F.lag("suffix").over(w)})
    nxt = F.when(F.col("s0") == "", "a").otherwise(F.char(F.ascii("s0") + 1))
    ok = ((F.col("num") == F.col("n0")) & (F.col("suffix") == nxt)) | ((F.col("num") == F.col("n0") + 1) & (F.col("suffix") == ""))
    name = lambda n, s: F.concat(F.col(n).cast("string"), F.upper(s))
    return own.where(F.col("n0").isNotNull() & ~ok).select("scope", "node_id", name("n0", "s0").alias("after"), name("num", "suffix").alias("found"))


# Plans.


def plan_issues(units: DataFrame, plans: DataFrame, pages: DataFrame) -> DataFrame:
    """All reasons against a plan: scope, issue, detail.

    units: scope, position, unit_id, start_page, end_page, display_label, heading;
    plans: scope, legal_start, legal_end; pages: scope, pdf_page, text.
    """
    w = Window.partitionBy("scope").orderBy("position")
    u = units.withColumns({"end0": F.lag("end_page").over(w), "unit0": F.lag("unit_id").over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("scope"))}).join(plans, "scope")

    def issue(df: DataFrame, code: str, detail: Column) -> DataFrame:
        return df.select("scope", F.lit(code).alias("issue"), detail.cast("string").alias("detail"))

    ends = units.groupBy("scope").agg(F.min_by("start_page", "position").alias("first"), F.max_by("end_page", "position").alias("last"), F.count(F.lit(1)).alias("n")).join(plans, "scope")
    n_pages = pages.groupBy("scope").agg(F.count(F.lit(1)).alias("n_pages"))
    inside = pages.join(plans, "scope").withColumn("in", F.col("pdf_page").between(F.col("legal_start"), F.col("legal_end")))
    covered = units.select("scope", F.explode(F.sequence("start_page", "end_page")).alias("pdf_page")).distinct()
    expected = plans.where("legal_end >= legal_start").select("scope", F.explode(F.sequence("legal_start", "legal_end")).alias("pdf_page"))
    start_text = units.join(pages.select("scope", F.col("pdf_page").alias("start_page"), "text"), ["scope", "start_page"])
    named = [issue(start_text.where(F.col(c).isNotNull() & ~K.is_subsequence(K.audit_key(c), K.audit_key("text"))), f"{c}_not_recoverable", F.col("unit_id")) for c in ("display_label", "heading")]
    return all_of(
        issue(ends.where("n > 64"), "too_many_units", F.col("n")), issue(ends.join(n_pages, "scope").where("legal_end > n_pages"), "page_beyond_document", F.col("legal_end")),
        issue(ends.where("first <> legal_start"), "start_differs", F.concat_ws("/", "legal_start", "first")), issue(ends.where("last <> legal_end"), "end_differs", F.concat_ws("/", "legal_end", "last")),
        issue(units.groupBy("scope", "unit_id").count().where("count > 1"), "duplicate_unit", F.col("unit_id")),
        issue(u.where("start_page < legal_start or end_page > legal_end"), "unit_outside_range", F.col("unit_id")),
        issue(u.where("start_page < end0"), "units_overlap", F.col("unit_id")), issue(u.where("start_page > end0 + 1"), "page_gap", F.concat_ws("/", "unit0", "unit_id")),
        issue(inside.where(~F.col("in") & (F.size(K.markers("text")) > 0)), "marker_outside_range", F.col("pdf_page")),
        issue(inside.where(F.col("in") & F.exists(F.split("text", "\n"), lambda x: F.lower(F.trim(x)).isin(*vocab.FRONT_HEADINGS))), "excluded_heading_inside", F.col("pdf_page")),
        issue(expected.join(covered, ["scope", "pdf_page"], "left_anti"), "page_not_covered", F.col("pdf_page")), *named)


def shared_boundaries(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Units whose last page is the next unit's first one: text with a marker stands above the next heading there."""
    w = Window.partitionBy("scope").orderBy("position")
    u = units.withColumns({
        "next_start": F.lead("start_page").over(w), "next_label": F.lead("display_label").over(w), "next_heading": F.lead("heading").over(w)})
    j = u.join(pages.select("scope", F.col("pdf_page").alias("next_start"), F.col("text").alias("next_text")), ["scope", "next_start"], "left")
    title = F.coalesce("next_heading", "next_label")
    above = F.when(title.isNotNull() & F.contains(F.lower("next_text"), F.lower(title)), F.split_part(F.lower("next_text"), F.lower(title), F.lit(1)))
    extend = (F.col("next_start") == F.col("end_page") + 1) & (F.size(K.markers(above)) > 0)
    return j.select(*[c for c in units.columns if c != "end_page"], F.when(extend, F.col("next_start")).otherwise(F.col("end_page")).alias("end_page"))


# Patches on one draft (driver or inside a grouped function).

MAX_OPS = 24


def _walk(root, tokens: list[str]):
    at = root
    for t in tokens:
        if isinstance(at, list):
            if not re.fullmatch(r"0|[1-9]\d*", t) or int(t) >= len(at):
                raise PipelineError("invalid_pointer", f"index {t} in a list of {len(at)}")
            at = at[int(t)]
        elif isinstance(at, dict) and t in at:
            at = at[t]
        else:
            raise PipelineError("invalid_pointer", f"no member {t}")
    return at


def _put(holder, key: str, value) -> None:
    if isinstance(holder, list):
        i = len(holder) if key == "-" else int(key) if key.isdigit() else -1
        if not 0 <= i <= len(holder):
            raise PipelineError("invalid_pointer", f"index {key} in a list of {len(holder)}")
        holder.insert(i, value)
    else:
        holder[key] = value


def _drop(holder, key: str):
    value = _walk(holder, [key])
    del holder[int(key) if isinstance(holder, list) else key]
    return value


def apply_patch(draft: dict, operations: list[dict]) -> dict:
    """A new draft after add, remove, replace and move operations; the given one stays as it is."""
    if len(operations) > MAX_OPS:
        raise PipelineError("invalid_patch", f"more than {MAX_OPS} operations")
    out = copy.deepcopy(draft)
    for op in operations:
        path = K.pointer_tokens(op["path"])
        if not path:
            raise PipelineError("invalid_patch", "the root can't be changed")
        holder = _walk(out, path[:-1])
        if op["op"] == "add":
            _put(holder, path[-1], copy.deepcopy(op["value"]))
        elif op["op"] == "remove":
            _drop(holder, path[-1])
        elif op["op"] == "replace":
            _walk(holder, path[-1:])
            holder[int(path[-1]) if isinstance(holder, list) else path[-1]] = copy.deepcopy(op["value"])
        elif op["op"] == "move":
            source = K.pointer_tokens(op["from"])
            if not source or path[: len(source)] == source:
                raise PipelineError("invalid_patch", "a node can't move into itself")
            value = _drop(_walk(out, source[:-1]), source[-1])
            _put(_walk(out, path[:-1]), path[-1], value)
        else:
            raise PipelineError("invalid_patch", f"unknown operation {op['op']}")
    return out


def flatten_draft(draft: dict) -> list[dict]:
    """Nodes of a draft tree in reading order with running ids, parents and sibling order."""
    rows: list[dict] = []

    def visit(nodes: list, parent: str | None, path: list[int]) -> None:
        for i, n in enumerate(nodes, 1):
            own = f"node-{len(rows) + 1:04d}"
            rows.append({"draft_id": own, "parent_draft_id": parent, "order": i, "path": [*path, i]} | {k: v for k, v in n.items() if k != "children"})
            visit(n.get("children") or [], own, [*path, i])

    visit(draft.get("nodes") or [], None, [])
    return rows


def materialize_table(table: dict, prefix: str) -> dict:
    """A draft table (rows of texts, a number of header rows) as a table block with cells and header association."""
    heads, rows = table.get("header_row_count", 0), table["rows"]
    width = max((len(r) for r in rows), default=0)
    if any(len(r) != width for r in rows):
        raise PipelineError("invalid_table", "rows differ in length")
    groups: dict[str, list] = {"header": [], "body": []}
    for i, row in enumerate(rows, 1):
        role = "header" if i <= heads else "body"
        cells = []
        for c, text in enumerate(row, 1):
            blank = not (text or "").strip()
            cells.append({
                "cell_id": f"{prefix}-r{i}-c{c}", "column_start": c, "role": "header" if role == "header" else "data", "scope": "column" if role == "header" else None,
                "row_span": 1, "column_span": 1, "header_cell_ids": [] if role == "header" else [f"{prefix}-r{h}-c{c}" for h in range(1, heads + 1)], "blank": blank,
                "content_blocks": [] if blank else [{"block_id": f"{prefix}-r{i}-c{c}-text", "kind": "text", "text": text.strip()}]})
        groups[role].append({"row_id": f"{prefix}-r{i}", "cells": cells})
    return {"block_id": prefix, "kind": "table", "column_count": width, "row_groups": [{"group_id": f"{prefix}-{r}", "role": r, "rows": x} for r, x in groups.items() if x], "notes": []}
