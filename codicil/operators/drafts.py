"""Draft trees as a model delivers them: rules on content, and recovery of misplaced parts."""

from __future__ import annotations

import copy
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.vocab import TEXT_BLOCK_KINDS

BLOCK_KINDS = (*TEXT_BLOCK_KINDS, "list", "table")
_NODE_MEMBERS = {"node_type", "display_label", "heading", "pdf_page", "content_blocks", "children"}


def bad_pages(pages: Column) -> Column:
    """Why a list of pages is refused: empty, not positive, or not strictly increasing."""
    steps = F.zip_with(F.slice(pages, 1, F.greatest(F.lit(0), F.size(pages) - 1)), F.slice(pages, 2, F.greatest(F.lit(0), F.size(pages) - 1)), lambda a, b: a < b)
    return (
        F.when(pages.isNull() | (F.size(pages) == 0), "no_pages").when(F.exists(pages, lambda p: p.isNull() | (p < 1)), "not_positive")
        .when(F.exists(steps, lambda ok: ~ok), "not_increasing"))


def block_issues(blocks: DataFrame) -> DataFrame:
    """Rows of draft blocks (draft_block_id, kind, text, pdf_pages) with a problem."""
    why = F.coalesce(
        F.when(~F.col("kind").isin(*BLOCK_KINDS) | F.col("kind").isNull(), "unknown_kind"),
        F.when(F.col("kind").isin(*TEXT_BLOCK_KINDS) & (F.trim(F.coalesce("text", F.lit(""))) == ""), "blank_text"), bad_pages(F.col("pdf_pages")))
    return blocks.select("draft_block_id", why.alias("problem")).where("problem is not null")


def table_issues(table: dict) -> list[str]:
    """Rules of a draft table: rectangular, captions with pages, header rows within, null for blank, numbered headers in columns of their own."""
    rows, width = table.get("rows") or [], table.get("column_count")
    out = []
    if any(len(r) != width for r in rows):
        out.append("row length differs from column_count")
    if any(c is not None and not c.strip() for r in rows for c in r):
        out.append("blank cells are null")
    if table.get("header_row_count", 1) > len(rows):
        out.append("more header rows than rows")
    caption, pages = table.get("caption"), table.get("caption_pdf_pages") or []
    if (caption is None) != (not pages) or (caption is not None and not caption.strip()):
        out.append("a caption has text and pages")
    numbers = {int(m[1]) for r in rows for c in r if c is not None and (m := re.match(r"\s*\((\d+)\)\s+", c))}
    if len(numbers) > 1 and numbers == set(range(1, len(numbers) + 1)) and width != len(numbers):
        out.append("numbered headers have a column each")
    return out


def embed_blocks(node: dict) -> dict:
    """Content blocks that were delivered among the children go to the node's content.

    A bare block always; a table dressed as a node where it has no label,
    heading, children or content of its own.
    """
    kept, moved = [], []
    for child in node.get("children") or []:
        bare = isinstance(child, dict) and child.get("kind") in BLOCK_KINDS and "node_type" not in child
        dressed = isinstance(child, dict) and child.get("kind") == child.get("node_type") == "table" and not any(child.get(k) for k in ("display_label", "heading", "children", "content_blocks"))
        if bare or dressed:
            moved.append({k: v for k, v in child.items() if bare or k not in _NODE_MEMBERS})
        else:
            kept.append(embed_blocks(child) if isinstance(child, dict) else child)
    return node | {"children": kept, "content_blocks": [*(node.get("content_blocks") or []), *moved]}


def _style(label: str) -> str:
    bare = label.strip().strip("().").casefold()
    return "decimal" if bare.isdigit() else "roman" if len(bare) > 1 and set(bare) <= set("ivxlcdm") else "alpha"


def _owner(node: dict, style: str) -> tuple[dict, str] | None:
    """The nearest node, from the end, that has children with labels of a style, and their type."""
    same = [c for c in node.get("children") or [] if c.get("display_label") and _style(c["display_label"]) == style]
    if same:
        return node, same[-1]["node_type"]
    for child in reversed(node.get("children") or []):
        if found := _owner(child, style):
            return found
    return None


def reattach_promoted(node: dict) -> dict:
    """Unlabelled subsections that belong below: provisos join the last wording, marked ones the run of their marker."""
    node = copy.deepcopy(node)
    if node.get("node_type") == "section":
        kept: list[dict] = []
        for child in node.get("children") or []:
            blocks = child.get("content_blocks") or []
            loose = kept and child.get("node_type") == "subsection" and not child.get("display_label") and not child.get("heading") and not child.get("children") and len(blocks) == 1 and isinstance(blocks[0].get("text"), str)
            words = blocks[0]["text"] if loose else ""
            marked = re.match(r"(?is)\s*(\((?:\d+[a-z]?|[a-z]+)\s*\)|\d+[a-z]?\.)\s+(\S.*)$", words) if loose else None
            place = _owner(kept[-1], _style(marked[1])) if marked else None
            if loose and re.match(r"(?i)\s*provided(?:\s+further)?\s+that\b", words):
                last = kept[-1]
                while last.get("children"):
                    last = last["children"][-1]
                last.setdefault("content_blocks", []).extend(blocks)
            elif place:
                place[0]["children"].append(child | {"node_type": place[1], "display_label": marked[1], "content_blocks": [blocks[0] | {"text": marked[2].strip()}]})
            else:
                kept.append(child)
        node["children"] = kept
    node["children"] = [reattach_promoted(c) for c in node.get("children") or []]
    return node


def recover_json(raw: str):
    """A JSON value followed by nothing but surplus closing delimiters; else a ValueError."""
    value, end = json.JSONDecoder().raw_decode(raw.strip())
    if set(raw.strip()[end:].strip()) - set("]}"):
        raise ValueError("text behind the value")
    return value


def marked_text(pages: DataFrame) -> DataFrame:
    """document, text: all pages in order, each under its mark (for a reader of whole documents)."""
    page = F.concat(F.lit("--- PDF PAGE "), F.col("pdf_page").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    return pages.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page", page.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def source_spans(source_id: Column, pages: Column) -> Column:
    """Spans of sorted, distinct pages."""
    return F.transform(F.array_sort(F.array_distinct(pages)), lambda p: F.struct(source_id.alias("source_id"), p.alias("pdf_page")))


def proviso_starts(nodes: DataFrame) -> DataFrame:
    """Nodes whose wording opens with a proviso and so can't stand alone."""
    return nodes.where(F.col("first_text").rlike("(?i)^\\s*provided(\\s+further)?\\s+that\\b")).select("scope", "node_id")
