"""Command line: python -m cipherlode [folder] --json F --md F --cbom F --fail-on high|medium --exclude X --test-files X; or: serve."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from cipherlode.plans import cbom, report, scan


def session() -> SparkSession:
    root = str(Path(__file__).resolve().parent.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (root, os.environ.get("PYTHONPATH"))))
    out = SparkSession.builder.appName("cipherlode").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def stamp() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def as_json(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def told(summary: dict, written: dict[str, str]) -> str:
    """What a person is told once reports are in files: the verdict, counts, and where to look."""
    count = summary["by_priority"]
    levels = ", ".join(f"{count[p]} {p}" for p in report.PRIORITIES)
    head = [f"cipherlode: {summary['verdict']}", f"  read {summary['files_scanned']} files; priority: {levels}; dynamic: {summary['dynamic']}"]
    return "\n".join(head + [f"  {kind}: {os.path.abspath(path)}" for kind, path in written.items()]) + "\n"


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: something reaches the threshold; 2: wrong use, or a report that can't be written.

    Without an output's name, a pipe gets the Markdown; a person at a terminal gets
    cipherlode.json and cipherlode.md in the current folder, and a few lines on them.
    """
    p = argparse.ArgumentParser(prog="cipherlode", description=__doc__)
    p.add_argument("folder", nargs="?", default=".")
    for name in ("--json", "--md", "--cbom", "--write"):
        p.add_argument(name, metavar="FILE")
    p.add_argument("--fail-on", choices=["high", "medium"])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--test-files", action="append", default=[])
    p.add_argument("--now", default=None, help="the time to write into the report")
    p.add_argument("--version", action="version", version=report.TOOL["version"])
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["serve"]:
        from cipherlode import rpc

        return rpc.listen(session(), sys.stdin, sys.stdout)
    args = p.parse_args(argv)
    if not os.path.isdir(args.folder):
        print(f"not a directory: {args.folder}", file=sys.stderr)
        return 2
    now, root = args.now or stamp(), os.path.basename(os.path.abspath(args.folder))
    found = scan.settled(scan.scan_folder(session(), os.path.abspath(args.folder), args.exclude, args.test_files))
    if sys.stdout.isatty() and not (args.json or args.md or args.cbom or args.write):
        args.json, args.md = "cipherlode.json", "cipherlode.md"
    written = {kind: path for kind, path in (("Markdown", args.md), ("JSON", args.json), ("CycloneDX 1.6", args.cbom), ("tables", args.write)) if path}
    markdown = report.markdown_lines(found, root, now).select("line")
    try:
        if args.json:
            Path(args.json).write_text(as_json(report.report(found, root, now)), encoding="utf-8")
        if args.cbom:
            Path(args.cbom).write_text(as_json(cbom.document(found, root, now)), encoding="utf-8")
        if args.write:
            scan.write(found, args.write)
            cbom.write(found, root, now, f"{args.write}/bom")
        if args.md:
            with open(args.md, "w", encoding="utf-8") as f:
                f.writelines(row["line"] + "\n" for row in markdown.toLocalIterator())
    except OSError as error:
        print(f"cannot write the report: {error}", file=sys.stderr)
        return 2
    if written:
        sys.stdout.write(told(report.summary(found).first().asDict(recursive=True), written))
    else:
        sys.stdout.writelines(row["line"] + "\n" for row in markdown.toLocalIterator())
    met = report.over_threshold(found, args.fail_on) if args.fail_on else 0
    if met:
        print(f"at priority {args.fail_on} or above: {met}", file=sys.stderr)
    return int(met > 0)
