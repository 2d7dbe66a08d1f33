"""Command line: python -m gleanery ingest | query | status | clear."""

from __future__ import annotations

import argparse
import json
import sys

from gleanery.config import Settings
from gleanery.service import EmptyStoreError, Gleanery
from gleanery.session import build_session
from gleanery.sources.pages import html_files

SHOWN_SOURCES = 8


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleanery", description="Hybrid document retrieval on Spark.")
    top.add_argument("--root", default=Settings.root, help="folder of the stored tables")
    commands = top.add_subparsers(dest="command", required=True)

    ingest = commands.add_parser("ingest", help="bring the store up to date with a set of pages")
    source = ingest.add_mutually_exclusive_group(required=True)
    source.add_argument("-u", "--urls", nargs="+", help="urls to download")
    source.add_argument("--table", help="parquet table with url and html")
    source.add_argument("--html", help="folder of html files")
    ingest.add_argument("-f", "--force", action="store_true", help="process unchanged pages too")
    ingest.add_argument("--merge", action="store_true", help="keep urls that are not in this run")

    query = commands.add_parser("query", help="ask a question")
    query.add_argument("question", nargs="?")
    query.add_argument("-k", "--top-k", type=int, default=8)
    query.add_argument("--url-filter")
    query.add_argument("--no-page-index", action="store_true")
    query.add_argument("--no-bm25", action="store_true")
    query.add_argument("--no-generate", action="store_true")
    query.add_argument("--no-cache", action="store_true")
    query.add_argument("--json", action="store_true", help="print the search document")
    query.add_argument("-i", "--interactive", action="store_true")

    commands.add_parser("status", help="sizes, settings and cache statistics")
    clear = commands.add_parser("clear", help="empty stored tables")
    clear.add_argument("--vectors", action="store_true")
    clear.add_argument("--cache", action="store_true")
    clear.add_argument("--query-cache", action="store_true")
    clear.add_argument("--all", action="store_true")
    clear.add_argument("--yes", action="store_true", help="do not ask")
    return top


def run_ingest(app: Gleanery, args, out) -> None:
    mode = "merge" if args.merge else "sync"
    if args.urls:
        report = app.ingest_urls(args.urls, args.force, mode)
    else:
        pages = app.spark.read.parquet(args.table).select("url", "html") if args.table else html_files(app.spark, args.html)
        report = app.ingest(pages, args.force, mode)
    for name, value in app.ingest_status().items():
        print(f"{name}: {value}", file=out)
    for row in report.details.orderBy("url").toLocalIterator():
        print(f"{row['status']:<10} {row['chunks']:>6} {row['tokens']:>8}  {row['url']}", file=out)
    if report.removed_urls is not None:
        for row in report.removed_urls.orderBy("url").toLocalIterator():
            print(f"removed    {row['url']}", file=out)


def run_query(app: Gleanery, args, question: str, out) -> None:
    reply = app.query(
        question, args.top_k, args.url_filter, not args.no_page_index, not args.no_bm25, not args.no_generate, not args.no_cache
    )
    if args.json:
        print(json.dumps(reply.search_schema, indent=2, ensure_ascii=False), file=out)
        return
    if reply.cache_hit:
        print(f"cache hit ({reply.cache_hit_type})", file=out)
    print(reply.answer, file=out)
    for i, s in enumerate(reply.sources[:SHOWN_SOURCES], 1):
        m = s["metadata"]
        print(f"{i:>2} {s['score']:.3f} {s['reranker_score']:.3f} {s['source']:<24} {m.get('source_url', '')} {m.get('section_heading', '')}", file=out)
    print(f"retrieval {reply.retrieval_time_ms:.0f} ms, generation {reply.generation_time_ms:.0f} ms, total {reply.total_time_ms:.0f} ms", file=out)


def main(argv: list[str] | None = None, app: Gleanery | None = None, out=sys.stdout, ask=input) -> int:
    args = parser().parse_args(argv)
    app = app or Gleanery(build_session(), Settings.load(root=args.root))
    if args.command == "ingest":
        run_ingest(app, args, out)
    elif args.command == "status":
        print(json.dumps(app.status(), indent=2), file=out)
    elif args.command == "clear":
        named = {"vectors": args.vectors, "cache": args.cache, "query_cache": args.query_cache, "all": args.all}
        targets = [name for name, wanted in named.items() if wanted]
        if targets and (args.yes or ask("Clear stored data? [y/N] ").strip().lower() == "y"):
            print(app.clear(targets)["message"], file=out)
    else:
        try:
            if args.interactive:
                while (question := ask("Ask: ").strip()).lower() not in ("quit", "exit", "q"):
                    if question:
                        run_query(app, args, question, out)
            elif args.question:
                run_query(app, args, args.question, out)
            else:
                print("give a question or --interactive", file=out)
        except (EOFError, KeyboardInterrupt):
            pass
        except EmptyStoreError:
            print("The store is empty: run ingest first.", file=out)
    return 0
