"""python -m codicil COMMAND ...: run and search queries, publish releases, and the stages from a request to a corpus folder.

Commands that change something only say what they would do without --execute.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

COMMANDS = {
    "run": ("run a registered query", ("query", "dir"), ("--out", "--queries")), "publish": ("publish a corpus folder as a release", ("corpus", "store", "tag", "commit"), ("--execute",)),
    "rollback": ("make a published release the active one", ("store", "tag"), ("--execute",)), "search": ("search the active release", ("store", "words"), ()),
    "acquire": ("download a requested document", ("request", "root"), ("--execute",)), "classify": ("report the pages of a document", ("pages", "source", "root", "receipt"), ()),
    "extract": ("put the texts of the pages in order", ("pages", "ocr", "source", "root", "classification"), ()), "candidate": ("give drafts their permanent ids", ("act", "drafts", "source_record", "root"), ()),
    "review": ("whether a candidate may be promoted", ("folder",), ()), "promote": ("add a reviewed candidate to a corpus", ("folder", "corpus"), ("--documents", "--execute")),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codicil", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (words, given, options) in COMMANDS.items():
        c = sub.add_parser(name, help=words)
        for g in given:
            c.add_argument(g)
        for o in options:
            c.add_argument(o, action="store_true") if o == "--execute" else c.add_argument(o, default="codicil.queries" if o == "--queries" else None)
    return p


def _opener(url: str):
    """Status and 64 KiB chunks of a document."""
    import urllib.error
    import urllib.request

    try:
        response = urllib.request.urlopen(url, timeout=30)  # noqa: S310 - the scheme is checked by the request
    except urllib.error.HTTPError as e:
        return e.code, iter(())
    return response.status, iter(lambda: response.read(65536), b"")


def _json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def execute(args: argparse.Namespace) -> object:
    """The result of a command, for printing; a DataFrame is shown by the command itself."""
    from codicil.plans import pipeline as L
    from codicil.plans import projection as J
    from codicil.service import Reader
    from codicil.session import get_spark, scope
    from codicil.sources.corpus import load_corpus, pdf_inspector

    if args.command == "review":
        return L.review(args.folder)
    if args.command == "promote":
        return L.promote(args.folder, args.corpus, args.execute, args.documents)
    if args.command == "acquire":
        with open(args.request, encoding="utf-8") as f:
            return L.acquire(f.read(), args.root, _opener, lambda content: sum(1 for _ in pdf_inspector(content)), args.execute)
    spark = get_spark()
    with scope(spark):
        if args.command == "run":
            df = importlib.import_module(args.queries).queries()[args.query](spark, args.dir)
            df.write.parquet(args.out) if args.out else df.show(50, truncate=100)
            return None
        if args.command == "publish":
            store, records = J.Store(spark, args.store), load_corpus(spark, args.corpus, args.tag)
            want = J.Release(args.tag, args.commit, tuple(J.schema_versions(records)))
            action, codes = store.preview(want)
            if args.execute and action != "blocked":
                action = store.publish(want, J.checked(records) if action == "import_and_activate" else None)
            return {"release_tag": args.tag, "action": action, "blockers": list(codes), "executed": args.execute}
        if args.command == "rollback":
            store = J.Store(spark, args.store)
            held = store.release(args.tag)
            action, codes = store.preview(held) if held else ("blocked", ("release_missing",))
            if args.execute and action != "blocked":
                action = store.publish(held, None)
            return {"release_tag": args.tag, "action": action, "blockers": list(codes), "executed": args.execute}
        if args.command == "search":
            return Reader(J.Store(spark, args.store)).search(args.words)
        if args.command == "classify":
            return L.classify(spark.read.parquet(args.pages), args.source, args.root, args.receipt)
        if args.command == "extract":
            return L.extract(spark.read.parquet(args.pages), spark.read.parquet(args.ocr), args.source, args.root, args.classification)
        return L.candidate(spark, _json(args.act), _json(args.drafts), _json(args.source_record), args.root)


def main(argv: list[str] | None = None) -> int:
    from codicil.errors import PipelineError

    try:
        result = execute(parser().parse_args(argv))
    except PipelineError as e:
        print(json.dumps({"code": e.code, "message": e.message, "retryable": e.retryable}), file=sys.stderr)
        return 1
    if isinstance(result, list):
        for item in result:
            print(json.dumps(item, default=str, ensure_ascii=False))
    elif result is not None:
        print(json.dumps(result, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
