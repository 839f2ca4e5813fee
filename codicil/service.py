"""The read API as functions: each request is pinned to one release and answered from one record or page."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil import vocab
from codicil.errors import InvalidRequest, NotFound, Unavailable
from codicil.operators import reader, search, tree
from codicil.plans.projection import R, Store
from codicil.session import durable


@dataclass
class Reader:
    """Reads a store; it has no way to write."""

    store: Store

    @staticmethod
    def health() -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        return {"status": "ready", "release_tag": self._tag()}

    def meta(self) -> dict:
        r = self.store.release(self._tag())
        return {"release_tag": r.release_tag, "commit_sha": r.commit_sha, "canonical_schema_versions": list(r.canonical_schema_versions), "projection_schema_version": r.projection_schema_version}

    def _tag(self) -> str:
        r = self.store.release(self.store.pointer()["active_release_tag"])
        if r is None or r.import_state != "ready":
            raise Unavailable("no release is active")
        return r.release_tag

    @staticmethod
    def _check(kind: str, value: str | None) -> None:
        if value is None or not re.match(vocab.ID_PATTERNS[kind], value):
            raise InvalidRequest(f"{value!r} is no {kind}")

    def _one(self, table: str, key: str, value: str, code: str, tag: str):
        row = self.store.read(table, tag).where(F.col(key) == value).limit(1).collect()  # a point lookup
        if not row:
            raise NotFound(code, f"{value} is not in {tag}")
        return row[0].asDict(recursive=True)

    def list_acts(self, offset: int = 0, limit: int = 50) -> dict:
        if offset < 0 or not 1 <= limit <= 100:
            raise InvalidRequest("offset from 0, limit from 1 to 100")
        acts = self.store.read("acts", self._tag())
        page = acts.orderBy(F.try_element_at("title_keys", F.lit(1)), F.desc("year"), "act_id").offset(offset).limit(limit)
        return {"items": [r.asDict() for r in page.select(*search.ACT_SUMMARY).collect()], "total": acts.count()}

    def get_act(self, act_id: str) -> dict:
        self._check("act_id", act_id)
        tag = self._tag()
        act = self._one("acts", "act_id", act_id, "act_not_found", tag)
        rows = reader.act_sources(self.store.read("acts", tag).where(F.col("act_id") == act_id), self.store.read("sources", tag)).orderBy("position").collect()
        return {"act": act, "sources": [r.asDict() for r in rows]}

    def get_source(self, source_id: str) -> dict:
        self._check("source_id", source_id)
        return self._one("sources", "source_id", source_id, "source_not_found", self._tag())

    def contents(self, act_id: str, parent_provision_id: str | None = None, max_depth: int | None = None) -> DataFrame:
        """Outline rows in document order; an unknown parent gives none."""
        self._check("act_id", act_id)
        tag = self._tag()
        self._one("acts", "act_id", act_id, "act_not_found", tag)
        p = self.store.read("provisions", tag).where(F.col("act_id") == act_id)
        kids = p.where("parent_provision_id is not null").select(F.col("parent_provision_id").alias("provision_id"), F.lit(True).alias("_k")).distinct()
        rows = p.join(kids, "provision_id", "left").select(
            "provision_id", "parent_provision_id", "node_type", "display_label", "heading", F.col("sibling_order").alias("order"), "sequence", "depth",
            (F.coalesce(F.json_array_length(F.get_json_object("canonical_record", "$.content_blocks")), F.lit(0)) > 0).alias("has_content"), F.coalesce("_k", F.lit(False)).alias("has_children"))
        return reader.contents_of(rows, None, parent_provision_id, max_depth).orderBy("sequence")

    def get_provision(self, provision_id: str) -> dict:
        """A provision with its act, the records below it in order, ancestors, neighbours, and the sources and citations of the subtree.

        Sequence is preorder without gaps within an act, so the subtree is the
        run of deeper nodes behind it, and the nearest earlier node of each
        smaller depth is the ancestor there.
        """
        self._check("provision_id", provision_id)
        tag = self._tag()
        own = self._one("provisions", "provision_id", provision_id, "provision_not_found", tag)
        act_row = self._one("acts", "act_id", own["act_id"], "act_not_found", tag)
        provisions = self.store.read("provisions", tag)
        act = provisions.where(F.col("act_id") == own["act_id"])
        nxt = act.where((F.col("sequence") > own["sequence"]) & (F.col("depth") <= own["depth"])).agg(F.min("sequence")).first()[0]
        tree_ = act.where((F.col("sequence") >= own["sequence"]) & (F.col("sequence") < nxt if nxt is not None else F.lit(True)))
        members = tree_.select("provision_id", "sequence", "source_ids", "canonical_record").orderBy("sequence").collect()  # one page's records
        up = act.where((F.col("sequence") < own["sequence"]) & (F.col("depth") < own["depth"])).groupBy("depth").agg(F.max_by(search.provision_summary(), "sequence").alias("x"))
        side = act.where(F.col("sequence").isin(own["sequence"] - 1, own["sequence"] + 1)).select("sequence", search.provision_summary().alias("x")).collect()
        at = {r["sequence"]: r["x"].asDict() for r in side}
        named = sorted({s for m in members for s in m["source_ids"] or ()})
        sources = self.store.read("sources", tag).where(F.col("source_id").isin(*named)).orderBy("source_id").select("canonical_record").collect() if named else []
        if len(sources) != len(named):
            raise Unavailable(f"{provision_id} names {len(named)} sources, the release holds {len(sources)} of them")
        target = provisions.select(F.col("act_id").alias("target_act_id"), F.col("provision_id").alias("target_provision_id"), search.provision_summary().alias("p"))
        acts = self.store.read("acts", tag).select(F.col("act_id").alias("target_act_id"), search.act_summary().alias("a"))
        cited = self.store.read("citations", tag).join(tree_.select(F.col("provision_id").alias("source_provision_id"), "sequence"), "source_provision_id")
        cited = cited.join(acts, "target_act_id").join(target, ["target_act_id", "target_provision_id"], "left").orderBy("sequence", "citation_id")
        return {
            "act": {k: act_row[k] for k in search.ACT_SUMMARY}, "provision": json.loads(own["canonical_record"]), "descendants": [json.loads(m["canonical_record"]) for m in members[1:]],
            "ancestors": [r["x"].asDict() for r in up.orderBy("depth").collect()], "navigation": {"previous": at.get(own["sequence"] - 1), "next": at.get(own["sequence"] + 1)},
            "sources": [json.loads(r[0]) for r in sources],
            "citations": [
                {"citation": json.loads(r["canonical_record"]), "target": {"act": r["a"].asDict(), "provision": r["p"].asDict() if r["p"] is not None else None}} for r in cited.collect()]}

    def search(self, query: str, act_id: str | None = None, limit: int = 20) -> list[dict]:
        """Items with their act, provision, breadcrumb and excerpt; the postings of the query's terms come from the release's index."""
        try:
            query = search.checked_query(query, limit)
        except search.InvalidQuery as e:
            raise InvalidRequest(str(e)) from e
        tag = self._tag()
        if act_id is not None:
            self._check("act_id", act_id)
            self._one("acts", "act_id", act_id, "act_not_found", tag)
        acts, provisions = self.store.read("acts", tag), self.store.read("provisions", tag)
        hits = durable(search.search(acts, provisions, self.store.postings(tag), query, act_id, limit), "hits")
        found = hits.where("kind = 'provision'").select(R, F.col("id").alias("provision_id"))
        items = search.items(hits, acts, provisions, tree.ancestor_summaries(provisions, found))
        return [r.asDict(recursive=True) for r in items.orderBy("position").drop(R, "position").collect()]  # at most ``limit`` rows
