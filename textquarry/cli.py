"""Command line: ``python -m textquarry.cli ROOT ingest|search|docs|media|status ...``.

ROOT, or the nearest folder above it that has one, may hold a ``config.yaml``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from textquarry import config
from textquarry.engine import Engine
from textquarry.session import session


def _print(df: DataFrame, line) -> int:
    n = 0
    for r in df.toLocalIterator():
        print(line(r))
        n += 1
    return n


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textquarry")
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("--full", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--top-k", type=int)
    c.add_argument("--type")
    c.add_argument("--mode", choices=("any", "all"), default="any")
    c.add_argument("--show-full", action="store_true")
    c.add_argument("--context", type=int, default=0)
    c = sub.add_parser("docs")
    c.add_argument("what", choices=("list", "outline", "show"))
    c.add_argument("selector", nargs="?", default="")
    c.add_argument("--section")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("media")
    c.add_argument("what", choices=("list", "gc"))
    sub.add_parser("status")
    a = p.parse_args(argv)
    c = config.load(a.root)
    e = Engine(session(), c.root, c.corpus, c.data, c.max_chars, c.overlap_chars, c.top_k)
    if a.command == "ingest":
        counts = e.ingest(a.full)
        print(" ".join(f"{k}={v}" for k, v in counts.items()))
        return int(counts["failed"] > 0)
    if a.command == "search":
        hits = e.search(a.query, a.top_k, a.type, a.mode).cache()
        body = "text" if a.show_full else "snippet"
        if not _print(hits, lambda r: f"{r['score']:.4f} {r['source_path']} [{r['section']}]\n{r[body]}\n"):
            print("no results")
        if a.context:
            _print(e.neighbours(hits, a.context), lambda r: f"{r['hit_id']} {r['distance']:+d} {r['chunk_id']}")
    elif a.command == "docs":
        if a.what == "list":
            n = _print(e.list_documents(), lambda r: f"{r['source_type']} {r['source_path']} ({r['chunk_count']}) {r['title']}")
            none = "no documents"
        elif a.what == "outline":
            n = _print(e.outline(a.selector), lambda r: f"{r['first_chunk']}: {r['section']} ({r['chunk_count']})")
            none = "no chunks"
        else:
            n = _print(e.show(a.selector, a.section, a.limit), lambda r: f"[{r['chunk_index']}] {r['section']}\n{r['text']}\n")
            none = "no chunks"
        if not n:
            print(none)
    elif a.command == "media":
        if a.what == "gc":
            print(f"deleted_files={e.collect_media()}")
        else:
            _print(e.media(), lambda r: f"{r['local_path']} {r['source_path']}")
    else:
        _print(e.status(), lambda r: f"{r['name']}: {r['rows']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
