"""Closed vocabularies of the corpus records (fixed values)."""

NODE_TYPES = (
    "document_title", "long_title", "arrangement", "preamble", "enacting_formula", "part", "chapter", "division", "cross_heading", "section", "subsection",
    "paragraph", "subparagraph", "definition", "schedule", "schedule_part", "schedule_paragraph", "schedule_subparagraph", "table", "form", "authentication",
    "explanatory_note",
)
TEXT_FIDELITY = ("machine_extracted", "single_reviewed", "double_reviewed", "source_conflict")
ACT_STATUS = ("in_force", "repealed", "spent", "not_yet_commenced", "mixed", "unknown")
TEXT_KINDS = ("as_enacted", "consolidated")
SOURCE_CLASSES = ("official_gazette", "certified_legislative_copy", "official_agency_copy", "official_translation", "institutional_copy", "secondary_copy")
TEXT_LAYERS = ("born_digital", "ocr", "scan_only", "mixed", "unknown")
REDISTRIBUTION = ("allowed", "not_allowed", "not_researched")
SOURCE_ROLES = ("authoritative_text", "certified_copy", "official_mirror", "comparison_copy", "metadata_evidence")
DATE_NULL_REASONS = ("not_researched", "not_found", "provision_specific", "not_applicable", "unknown")
MARKER_STYLES = ("decimal", "lower_alpha", "upper_alpha", "lower_roman", "upper_roman", "bullet", "none", "source")
LAYOUT_STATUS = ("faithfully_reconstructed", "reconstruction_uncertain", "source_conflict")
CELL_SCOPES = ("row", "column", "row_group", "column_group")
TEXT_BLOCK_KINDS = ("text", "quoted_text", "formula", "signature")
PAGE_ROUTES = ("extract", "ocr", "skip", "review")
DOCUMENT_ROUTES = ("extract", "ocr", "hybrid", "manual_review")
MATCH_KINDS = ("exact_act_id", "exact_act_citation", "exact_act_title", "exact_act_alias", "exact_provision_id", "exact_provision_reference", "lexical")
ISSUE_CODES = ("missing_source", "unsupported_output", "duplicate_source_claim", "missing_marker", "extra_marker")
EXCLUSION_REASONS = ("printed_page_number", "recurring_header", "editorial_annotation")
RELEASE_ACTIONS = ("import_and_activate", "activate_existing", "noop", "blocked")

#: Forms of identifiers (fixed values).
ID_PATTERNS = {
    "act_id": "^[a-z]{2}(?:-[a-z0-9]+)+-[0-9]{4}-[a-z0-9][a-z0-9-]*$",
    "provision_id": "^[a-z]{2}(?:-[a-z0-9]+)+-[0-9]{4}-[a-z0-9][a-z0-9-]*:[a-z0-9][a-z0-9.-]*(?:~[0-9]+)?$",
    "citation_id": "^citation:[a-z]{2}(?:-[a-z0-9]+)+-[0-9]{4}-[a-z0-9][a-z0-9-]*:[0-9]{6}$",
    "source_id": "^sha256:[0-9a-f]{64}$",
    "block_id": "^[a-z0-9][a-z0-9._~-]{0,127}$",
    "language": "^[a-z]{3}$",
    "release_tag": "^corpus-v[0-9]+\\.[0-9]+\\.[0-9]+$",
    "commit_sha": "^[0-9a-f]{40}$",
    "unit_id": "^[a-z0-9][a-z0-9-]{0,63}$",
}

#: How an editorial note in brackets begins, the numbers that a schedule may be called by, and what a note says was done.
NOTE_STARTS = ("section", "part", "item", "schedule")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
ORDINAL_ENDINGS = ("st", "nd", "rd", "th")
NOTE_VERBS = ("altered", "inserted", "substituted", "deleted")
NOTE_TITLE = "alteration act"
#: Headings of pages that are no part of the law itself.
FRONT_HEADINGS = (
    "foreword", "preface", "arrangement of sections", "arrangement of articles", "arrangement of regulations", "arrangement of rules", "table of contents", "explanatory memorandum", "explanatory note",
)

#: Which node types may own a node of a type (None: it may be a root).
PARENTS = {
    "section": (None, "part", "chapter", "division", "cross_heading"),
    "subsection": ("section",),
    "paragraph": ("section", "subsection", "definition", "schedule_subparagraph"),
    "subparagraph": ("paragraph",),
    "schedule_part": ("schedule",),
    "schedule_paragraph": ("schedule", "schedule_part", "cross_heading"),
    "schedule_subparagraph": ("schedule_paragraph",),
}
