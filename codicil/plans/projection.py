"""Flattening canonical records into release-scoped tables, and publishing releases.

The tables are built with column expressions from the parsed records; only
Unicode keys and nested content use Arrow. A release is written to its own
folder, counted, and then marked ready; readers follow a one-row pointer that is
replaced in one step, so they see the release before or after, never a mixture.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from codicil import schemas
from codicil.errors import PipelineError
from codicil.functions import textkeys as K
from codicil.functions.blocks import flatten_blocks
from codicil.functions.records import check_records
from codicil.operators import hierarchy as H
from codicil.operators import search
from codicil.operators import validate as V
from codicil.session import durable
from codicil.sources import files
from codicil.sources.sinks import json_bytes, write_atomically
from codicil.vocab import TEXT_BLOCK_KINDS

R = "release_tag"
SUPPORTED = (schemas.SCHEMA_VERSION,)


def source_rows(sources: DataFrame) -> DataFrame:
    return sources.select(R, "source_id", "schema_version", "document_title", "document_publisher", "language", "source_class", F.col("record").alias("canonical_record"))


def act_rows(acts: DataFrame) -> DataFrame:
    t = F.col("titles")
    titles = F.concat(F.array(t["official"], t["short"], t["long"]), F.coalesce("aliases", F.array().cast("array<string>")))
    lines = F.concat(titles, F.array("citation", F.col("year").cast("string"), "number"))
    text = F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != ""), "\n")
    return acts.select(
        R, "act_id", "schema_version", "jurisdiction", "country_code", t["official"].alias("official_title"), t["short"].alias("short_title"), "year", "number", "citation",
        F.coalesce("text_kind", F.lit("as_enacted")).alias("text_kind"), "status", F.col("checked_through_date").try_cast("date").alias("checked_through_date"),
        K.distinct_keys(titles).alias("title_keys"), K.search_key("citation").alias("citation_key"),
        F.array_sort(F.array_distinct(F.transform("source_refs", lambda x: x["source_id"]))).alias("source_ids"), text.alias("searchable_text"), F.col("record").alias("canonical_record"))


def content_text(provisions: DataFrame) -> DataFrame:
    """release_tag, provision_id, text of the content in reading order, and all source ids in it."""
    flat = flatten_blocks(provisions.select(R, "provision_id", "record"), "record")
    said = flat.where(F.col("kind").isin(*TEXT_BLOCK_KINDS, "item", "caption"))
    texts = said.where("text is not null").groupBy(R, "provision_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    ids = flat.groupBy(R, "provision_id").agg(F.array_distinct(F.flatten(F.collect_list("source_ids"))).alias("inner_ids"))
    return ids.join(texts, [R, "provision_id"], "left")


def provision_rows(provisions: DataFrame) -> DataFrame:
    """Sequence is the line number among the act's records; depth comes from the resolved hierarchy."""
    own = durable(provisions.withColumn("act_id", K.act_of("provision_id")), "records")
    h = H.build_hierarchy(own, R, "provision_id", "parent_provision_id", (F.regexp_extract("provision_id", "^[^:]*:?[^.]*", 0), F.substring_index("provision_id", ":", 1)))
    w = Window.partitionBy(R, "act_id").orderBy("line")
    key = K.search_key(F.regexp_replace("provision_id", "^[^:]*:", ""))
    rows = own.withColumn("sequence", F.row_number().over(w)).withColumn("reference_key", key)
    rows = rows.join(h.select(R, "provision_id", F.col("depth").cast("int").alias("depth")), [R, "provision_id"], "left").join(content_text(own), [R, "provision_id"], "left")
    ids = F.array_sort(F.array_distinct(F.concat(F.transform(F.coalesce("source_spans", F.array().cast("array<struct<source_id:string,pdf_page:int,printed_page:string>>")), lambda s: s["source_id"]), F.coalesce("inner_ids", F.array().cast("array<string>")))))
    return rows.select(
        R, "provision_id", "act_id", "schema_version", "parent_provision_id", F.col("order").alias("sibling_order"), "sequence", "depth", "node_type", "display_label", "heading", "text_fidelity", "reference_key",
        ids.alias("source_ids"), K.joined_lines("display_label", "heading", "content", "reference_key").alias("searchable_text"), F.col("record").alias("canonical_record"))


def citation_rows(citations: DataFrame) -> DataFrame:
    return citations.select(R, "citation_id", "schema_version", "source_provision_id", "source_block_id", F.col("target.act_id").alias("target_act_id"), F.col("target.provision_id").alias("target_provision_id"), F.col("record").alias("canonical_record"))


def build(records: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a release; unsupported schema versions and repeated reference keys stop it."""
    strange = _versions(records).where(~F.col("schema_version").isin(*SUPPORTED)).limit(5).collect()
    if strange:
        raise PipelineError("unsupported_schema_version", ", ".join(sorted(r[0] for r in strange)))
    out = {"acts": act_rows(records["acts"]), "sources": source_rows(records["sources"]), "provisions": provision_rows(records["provisions"]), "citations": citation_rows(records["citations"])}
    out["provisions"] = durable(out["provisions"], "provisions")
    twice = out["provisions"].groupBy("act_id", "reference_key").count().where("count > 1").limit(5).collect()
    if twice:
        raise PipelineError("duplicate_reference_key", "; ".join(f"{r['act_id']}: {r['reference_key']}" for r in twice))
    return out


def _versions(records: dict[str, DataFrame]) -> DataFrame:
    found = None
    for df in records.values():
        v = df.select("schema_version").distinct()
        found = v if found is None else found.unionByName(v)
    return found.where("schema_version is not null").distinct()


def schema_versions(records: dict[str, DataFrame]) -> list[str]:
    """All versions in use, sorted; more than a thousand are refused, none is left out."""
    found = [r[0] for r in _versions(records).limit(1001).collect()]
    if len(found) > 1000:
        raise PipelineError("unsupported_schema_version", "more than 1,000 schema versions")
    return sorted(found)


def violations(records: dict[str, DataFrame], rows: dict[str, DataFrame]) -> DataFrame:
    """Everything that is wrong with a release as read: shapes of records, then rules across them. rule, release_tag, key, detail."""
    acts, provisions, sources, citations = (rows[n] for n in ("acts", "provisions", "sources", "citations"))
    keys = {"acts": ("act", "act_id"), "provisions": ("provision", "provision_id"), "sources": ("source", "source_id"), "citations": ("citation", "citation_id")}
    shapes = [check_records(records[n].select(R, key, F.col("record").alias("canonical_record")), kind, key).select(F.lit("shape").alias("rule"), R, "key", F.concat_ws(" ", "path", "message").alias("detail")) for n, (kind, key) in keys.items()]
    blocks = durable(flatten_blocks(provisions.select(R, "provision_id", "canonical_record")), "blocks")
    cells = blocks.where("kind = 'cell'")
    counts = sources.withColumn("page_count", F.get_json_object("canonical_record", "$.page_count").cast("int"))
    return V.all_of(
        *shapes, *[V.duplicate_keys(rows[n], key) for n, (_, key) in keys.items()], V.duplicate_ids_across(*[(rows[n], key) for n, (_, key) in keys.items()]),
        V.missing_target(provisions, "provision_id", "act_id", acts, "act_id", "no_act"), V.missing_target(provisions, "provision_id", "parent_provision_id", provisions, "provision_id", "no_parent"),
        V.missing_target(citations, "citation_id", "source_provision_id", provisions, "provision_id", "no_citing_provision"),
        V.missing_target(citations, "citation_id", "target_act_id", acts, "act_id", "no_target_act"), V.missing_target(citations, "citation_id", "target_provision_id", provisions, "provision_id", "no_target_provision"),
        V.foreign_parent(provisions), V.owner_prefix(provisions), V.incomplete_siblings(provisions), V.unlinked_sources(acts, provisions), V.unnamed_evidence(acts), V.missing_named(acts, sources),
        V.pages_beyond(blocks, counts), V.duplicate_content_ids(blocks), V.citation_ranges(citations, blocks), V.target_mismatch(citations), V.citation_prefix(citations),
        V.cells_beyond(cells), V.cell_overlap(cells), V.header_references(cells), V.blank_with_content(cells, blocks), V.segment_rows(blocks))


def checked(records: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables of a release that breaks no rule; else an error with the first violations."""
    rows = build(records)
    found = violations(records, rows).limit(20).collect()
    if found:
        raise PipelineError("invalid_corpus", "; ".join(f"{r['rule']}: {r['key']} {r['detail'] or ''}".strip() for r in found))
    return rows


# Releases.


@dataclass(frozen=True)
class Release:
    release_tag: str
    commit_sha: str
    canonical_schema_versions: tuple[str, ...]
    projection_schema_version: int = schemas.PROJECTION_VERSION
    import_state: str = "ready"


@dataclass(frozen=True)
class State:
    active: Release | None = None
    previous: Release | None = None
    target: Release | None = None
    blockers: tuple[str, ...] = ()
    read_only: bool = True


def decide(want: Release, state: State, read_only: bool) -> tuple[str, tuple[str, ...]]:
    """What a publication would do, and what forbids it."""
    codes = list(state.blockers)
    if state.read_only != read_only:
        codes.append("projection_not_read_only" if read_only else "projection_database_read_only")
    for role in ("active", "previous"):
        r = getattr(state, role)
        if r is not None and (r.import_state != "ready" or r.projection_schema_version != schemas.PROJECTION_VERSION or set(r.canonical_schema_versions) - set(SUPPORTED)):
            codes.append(f"{role}_release_invalid")
    held = state.target
    if held is not None:
        if held.commit_sha != want.commit_sha:
            codes.append("release_commit_conflict")
        elif (held.canonical_schema_versions, held.projection_schema_version) != (want.canonical_schema_versions, want.projection_schema_version):
            codes.append("release_metadata_conflict")
        elif held.import_state != "ready":
            codes.append("release_import_incomplete")
    if codes:
        return "blocked", tuple(codes)
    if held is None:
        return "import_and_activate", ()
    return ("noop" if state.active is not None and state.active.release_tag == want.release_tag else "activate_existing"), ()


def decide_all(wanted: DataFrame, registry: DataFrame, active: Release | None, previous: Release | None) -> DataFrame:
    """``decide`` for many releases at once: wanted and registry are joined by tag; the two releases of the pointer are given.

    wanted: release_tag, commit_sha, canonical_schema_versions, projection_schema_version; the registry has import_state too.
    """
    held = registry.select(R, F.struct("commit_sha", "canonical_schema_versions", "projection_schema_version", "import_state").alias("held"))
    usable = lambda r: r is None or (r.import_state == "ready" and r.projection_schema_version == schemas.PROJECTION_VERSION and set(r.canonical_schema_versions) <= set(SUPPORTED))
    h = F.col("held")
    same = (h["canonical_schema_versions"] == F.col("canonical_schema_versions")) & (h["projection_schema_version"] == F.col("projection_schema_version"))
    conflict = (
        F.when(h.isNull(), None).when(h["commit_sha"] != F.col("commit_sha"), "release_commit_conflict").when(~same, "release_metadata_conflict")
        .when(h["import_state"] != "ready", "release_import_incomplete"))
    of_state = [F.lit(f"{role}_release_invalid") for role, r in (("active", active), ("previous", previous)) if not usable(r)]
    codes = F.array_compact(F.array(*of_state, conflict))
    action = (
        F.when(F.size(codes) > 0, "blocked").when(h.isNull(), "import_and_activate").when(F.col(R).eqNullSafe(F.lit(active.release_tag if active else None)), "noop").otherwise("activate_existing"))
    return wanted.join(held, R, "left").select(*wanted.columns, action.alias("action"), F.array_join(codes, ",").alias("blockers"))


@dataclass
class Store:
    """Published releases below ``root``: tables partitioned by release, a register, and the pointer."""

    spark: SparkSession
    root: str
    tables: tuple[str, ...] = field(default=("acts", "sources", "provisions", "citations"))

    def _path(self, *parts: str) -> str:
        return files.join(self.root, *parts)

    @contextmanager
    def lock(self) -> Iterator[None]:
        """One publication at a time; a second one fails at once."""
        try:
            with files.exclusive(self._path("lock")):
                yield
        except BlockingIOError as e:
            raise PipelineError("projection_busy", "another publication is running", retryable=True) from e

    def _load(self, name: str) -> dict | None:
        try:
            return json.loads(files.read(self._path(name)))
        except FileNotFoundError:
            return None

    def release(self, tag: str | None) -> Release | None:
        r = self._load(f"releases/{tag}.json") if tag else None
        return Release(**(r | {"canonical_schema_versions": tuple(r["canonical_schema_versions"])})) if r else None

    def pointer(self) -> dict:
        return self._load("pointer.json") or {"active_release_tag": None, "previous_release_tag": None}

    def state(self, tag: str, read_only: bool) -> State:
        p = self.pointer()
        return State(self.release(p["active_release_tag"]), self.release(p["previous_release_tag"]), self.release(tag), (), read_only)

    def read(self, name: str, tag: str | None = None) -> DataFrame:
        """A table of one ready release, the active one by default; one scan prunes all other releases."""
        tag = tag or self.pointer()["active_release_tag"]
        r = self.release(tag)
        if r is None or r.import_state != "ready":
            raise PipelineError("projection_unavailable", f"release {tag} is not published", retryable=True)
        return self.spark.read.schema(schemas.PROJECTION[name]).parquet(self._path(name)).where(F.col(R) == tag)

    def preview(self, want: Release) -> tuple[str, tuple[str, ...]]:
        return decide(want, self.state(want.release_tag, True), True)

    def publish(self, want: Release, rows: dict[str, DataFrame] | None, allow_bootstrap: bool = False) -> str:
        """Imports where needed, verifies the counts, marks ready, and swaps the pointer."""
        if want.release_tag == "corpus-v0.0.0" and not allow_bootstrap:
            raise PipelineError("bootstrap_release_blocked", want.release_tag)
        with self.lock():
            action, codes = decide(want, self.state(want.release_tag, False), False)
            if action == "blocked":
                raise PipelineError(codes[0], ", ".join(codes))
            if action == "noop":
                return action
            if action == "import_and_activate":
                self._import(want, rows or {})
            p = self.pointer()
            if p["active_release_tag"] != want.release_tag:
                write_atomically(self._path("pointer.json"), json_bytes({"active_release_tag": want.release_tag, "previous_release_tag": p["active_release_tag"]}))
            self.spark.catalog.clearCache()
            return action

    def _import(self, want: Release, rows: dict[str, DataFrame]) -> None:
        record = want.__dict__ | {"canonical_schema_versions": list(want.canonical_schema_versions)}
        write_atomically(self._path("releases", f"{want.release_tag}.json"), json_bytes(record | {"import_state": "importing"}))
        try:
            for name in self.tables:
                # The rows are counted on their way to the files, so that no plan runs twice.
                seen = Observation(f"import_{name}")
                rows[name].drop(R).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(self._path(name, f"{R}={want.release_tag}"))
                if self.spark.read.parquet(self._path(name, f"{R}={want.release_tag}")).count() != seen.get["n"]:
                    raise PipelineError("import_count_mismatch", name)
            self._index(want.release_tag)
            lost = self._dangling(want.release_tag)
            if lost:
                raise PipelineError("import_reference_missing", lost)
        except Exception:
            self._undo(want.release_tag)
            raise
        write_atomically(self._path("releases", f"{want.release_tag}.json"), json_bytes(record | {"import_state": "ready"}))

    def _index(self, tag: str) -> None:
        """The postings of the release, sorted by term, so that a query reads those of its terms."""
        texts = None
        for name, kind, key in (("acts", "act", "act_id"), ("provisions", "provision", "provision_id")):
            t = self.spark.read.schema(schemas.PROJECTION[name]).parquet(self._path(name)).where(F.col(R) == tag).select(R, F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("searchable_text").alias("text"))
            texts = t if texts is None else texts.unionByName(t)
        search.write_index(search.build_postings(texts).drop(R), self._path("postings", f"{R}={tag}"))

    def postings(self, tag: str) -> DataFrame:
        schema = f"kind string, id string, term string, positions array<int>, {R} string"
        return self.spark.read.schema(schema).parquet(self._path("postings")).where(F.col(R) == tag)

    def _dangling(self, tag: str) -> str:
        t = {n: self.spark.read.schema(schemas.PROJECTION[n]).parquet(self._path(n)).where(F.col(R) == tag) for n in self.tables}
        pairs = (("provisions", "act_id", "acts", "act_id"), ("provisions", "parent_provision_id", "provisions", "provision_id"), ("citations", "source_provision_id", "provisions", "provision_id"),
                 ("citations", "target_act_id", "acts", "act_id"), ("citations", "target_provision_id", "provisions", "provision_id"))
        for name, c, other, key in pairs:
            lost = t[name].where(F.col(c).isNotNull()).select(F.col(c).alias("k")).join(t[other].select(F.col(key).alias("k")), "k", "left_anti")
            if lost.limit(1).count():
                return f"{name}.{c}"
        return ""

    def _undo(self, tag: str) -> None:
        """A failed import leaves no trace: only folders of this release, which no reader may see yet, are removed."""
        for name in (*self.tables, "postings"):
            files.delete(self._path(name, f"{R}={tag}"))
        files.delete(self._path("releases", f"{tag}.json"))
