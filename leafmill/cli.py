"""The verbs on a command line: ``python -m leafmill.cli --wiki ROOT VERB ...``.

Errors of the request itself (bad arguments, files that exist or are missing) end in status 2 and a
line on standard error. People get few rows of long lists; --json gives all.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from .session import session
from .workspace import EmbeddingConfig, Workspace

#: Rows that people are shown.
SHOWN = {"change-summary": 20, "consistency-audit": 20, "is-verbose": 5}
_REFUSED = (ValueError, FileExistsError, FileNotFoundError)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="leafmill", description="Search and analytics over a tree of Markdown pages")
    top.add_argument("--wiki", default=os.environ.get("WIKI_PATH") or str(Path.home() / "wiki"))
    verbs = top.add_subparsers(dest="verb", required=True)
    flag = {"action": "store_true"}
    options = {
        "index": {"--include-raw": flag},
        "status": {},
        "search": {"query": {}, "--limit": {"type": int, "default": 8}, "--include-raw": flag, "--type": {"dest": "types", "action": "append"}, "--tag": {"dest": "tags", "action": "append"}, "--explain": flag},
        "grep": {"pattern": {}, "--include-raw": flag, "--regex": flag, "--case-sensitive": flag, "--context": {"type": int, "default": 2}, "--limit": {"type": int, "default": 100}},
        "read": {"path": {}, "--heading": {}, "--start-line": {"type": int}, "--end-line": {"type": int}},
        "is-verbose": {"path": {}, "--include-code": flag, "--compare-to": {}},
        "verbosity-audit": {"--limit": {"type": int, "default": 20}, "--include-raw": flag, "--severity": {"choices": ["ok", "warning", "high"]}},
        "change-summary": {"--include-raw": flag, "--update": flag, "--since": {}, "--change-count-threshold": {"type": int, "default": 1}, "--byte-threshold": {"type": int, "default": 1}, "--line-threshold": {"type": int, "default": 1}},
        "consistency-audit": {"--include-raw": {"action": "store_const", "const": True}},
        "write": {"path": {}, "--mode": {"default": "create", "choices": ["create", "overwrite", "append", "replace-section"]}, "--heading": {}, "--occurrence": {"type": int}, "--content-file": {"required": True}, "--no-reindex": flag},
    }
    for verb, own in options.items():
        p = verbs.add_parser(verb)
        for name, how in own.items():
            p.add_argument(name, **how)
        p.add_argument("--json", action="store_true")
    return top


def answer(w: Workspace, a: argparse.Namespace) -> dict[str, DataFrame | list[dict]]:
    """What the verb returns, by name; one part is the usual case."""
    if a.verb == "index":
        return {"status": w.reindex(a.include_raw)}
    if a.verb == "status":
        return {"status": w.status()}
    if a.verb == "search":
        own = {"limit": a.limit, "include_raw": a.include_raw, "types": a.types, "tags": a.tags}
        return {"explain": w.search_explain(a.query, **own)} if a.explain else {"results": w.search(a.query, **own)}
    if a.verb == "grep":
        return {"hits": w.grep(a.pattern, a.include_raw, regex=a.regex, case_sensitive=a.case_sensitive, context=a.context, limit=a.limit)}
    if a.verb == "read":
        return {"page": w.read(a.path, a.heading, a.start_line, a.end_line)}
    if a.verb == "is-verbose":
        return {"analysis": w.is_verbose(a.path, a.compare_to, a.include_code)}
    if a.verb == "verbosity-audit":
        return {"pages": w.verbosity_audit(a.limit, a.include_raw, a.severity)}
    if a.verb == "change-summary":
        head, rows = w.change_summary(a.update, a.include_raw, changes=a.change_count_threshold, size=a.byte_threshold, lines=a.line_threshold)
        return {"summary": head, "files": rows}
    if a.verb == "consistency-audit":
        head, rows = w.consistency_audit(a.include_raw)
        return {"summary": head, "issues": rows}
    return {"written": [w.write(a.path, Path(a.content_file).read_text("utf-8"), a.mode, not a.no_reindex, a.heading, a.occurrence)]}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    w = Workspace(session(), a.wiki, EmbeddingConfig.from_env().embedder())
    try:
        parts = answer(w, a)
        found = {k: v if isinstance(v, list) else [json.loads(x) for x in v.toJSON().collect()] for k, v in parts.items()}
    except _REFUSED as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if a.json:
        print(json.dumps(found if len(found) > 1 else next(iter(found.values())), ensure_ascii=False))
        return 0
    for name, rows in found.items():
        print(f"{name}: {len(rows)}")
        for row in rows[: SHOWN.get(a.verb, len(rows))]:
            print("  " + "  ".join(f"{k}={v}" for k, v in row.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
