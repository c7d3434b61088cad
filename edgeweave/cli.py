"""Command line: validate, parse, convert, analyze, build, clean, conform, query, diff, patch.

``python -m edgeweave.cli query FILE --where confidence__gt=0.8 --select source,target``
"""

from __future__ import annotations

import argparse
import csv
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EdgeError
from .operators import conform, diff, query, repair, stats, validate
from .sinks import text as sinks
from .sources.build import document, edge
from .sources.files import parse_files, read_texts


def _session() -> SparkSession:
    s = SparkSession.builder.appName("edgeweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _print(df: DataFrame, form: str) -> None:
    """All rows of a result, one after another; the driver holds a partition of them at a time."""
    if form == "table":
        widths = df.select(*[F.greatest(F.lit(max(4, len(c))), F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0))).alias(c) for c in df.columns]).first()
        line = lambda cells: print("|" + "|".join(str(x).ljust(w) for x, w in zip(cells, widths, strict=True)) + "|")
        line(df.columns)
        for r in df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in df.columns]).toLocalIterator():
            line(r)
    elif form == "json":
        lead = "["
        for r in df.toLocalIterator():
            print(lead + json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False), end="")
            lead = ", "
        print("]" if lead != "[" else "[]")
    elif len(df.columns) == 1:  # lines of text
        print(df.columns[0])
        for (v,) in df.toLocalIterator():
            print("" if v is None else v)
    else:
        out = csv.writer(sys.stdout, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(["" if v is None else v for v in r] for r in df.toLocalIterator())


def _loaded(spark: SparkSession, path: str, mode: str = "auto"):
    doc = parse_files(spark, path, mode)
    valid = True
    for b in doc.diagnostics.where("severity = 'error'").toLocalIterator():
        print(f"[{b.code}] {b.doc_id}: {b.message}", file=sys.stderr)
        valid = False
    return doc, valid


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="edgeweave")
    sub = p.add_subparsers(dest="cmd", required=True)
    add = lambda name, *files: [c := sub.add_parser(name), [c.add_argument(f) for f in files]][0]
    add("validate", "file").add_argument("--strict", action="store_true")
    add("parse", "file").add_argument("--mode", default="auto")
    add("convert", "file").add_argument("--to", choices=("json", "text", "ntriples", "turtle", "csv"), default="json")
    add("analyze", "file")
    add("build", "source", "target").add_argument("--mod", default="")
    add("clean", "file")
    add("conform", "file", "schema")
    q = add("query", "file")
    for a in ("--where", "--select", "--pointer"):
        q.add_argument(a, default="")
    q.add_argument("--limit", type=int)
    q.add_argument("--count", action="store_true")
    q.add_argument("--format", choices=("table", "json", "csv"), default="table")
    d = add("diff", "a", "b")
    d.add_argument("--summary", action="store_true")
    add("patch", "a", "b")
    args = p.parse_args(argv)
    spark = _session()
    try:
        return _run(spark, args)
    except EdgeError as e:
        print(e, file=sys.stderr)
        return 1


def _run(spark: SparkSession, args) -> int:
    if args.cmd == "build":
        mods = {k.strip(): query.typed_value(v) for k, _, v in (x.partition("=") for x in args.mod.split(",") if x.strip())}
        print(document(spark, edge(args.source, args.target).mod(**mods)).to_text().first()["text"])
        return 0
    if args.cmd == "clean":
        out = repair.repair(repair.clean(read_texts(spark, args.file)))
        print("\n".join(r.text for r in out.select("text").collect()))
        return 0
    if args.cmd in ("diff", "patch"):
        (a, ok_a), (b, ok_b) = _loaded(spark, args.a), _loaded(spark, args.b)
        if not (ok_a and ok_b):
            return 1
        if args.cmd == "diff":
            _print(diff.diff_summary(a.statements, b.statements) if args.summary else diff.diff_text(diff.diff(a.statements, b.statements)).select("line"), "csv")
        else:
            out = diff.patch(a.statements, diff.diff(a.statements, b.statements), b.statements)
            print("\n".join(r.text for r in sinks.canonical_text(out).orderBy("stmt_idx").collect()))
        return 0
    doc, ok = _loaded(spark, args.file, getattr(args, "mode", "auto"))
    s = doc.statements
    if args.cmd == "validate":
        checked = validate.validate(doc, args.strict)
        _print(checked.diagnostics.select("code", "statement_index", "field", "message"), "csv")
        return int(checked.documents.where(~F.col("is_valid")).limit(1).count() > 0)
    if not ok:
        return 1
    if args.cmd == "parse":
        _print(sinks.to_json(s).select("json"), "csv")
    elif args.cmd == "convert":
        made = {"json": sinks.to_json, "text": sinks.canonical_text, "ntriples": sinks.ntriples, "turtle": sinks.turtle, "csv": sinks.table}[args.to](s)
        _print(made.select(made.columns[-1]) if args.to != "csv" else made, "csv")
    elif args.cmd == "analyze":
        s = s.cache()
        for name, df in stats.report(s).items():
            print(f"# {name}")
            _print(df, "csv")
    elif args.cmd == "conform":
        found = conform.conformance(s, conform.load_schema(args.schema))
        _print(found, "csv")
        return int(found.limit(1).count() > 0)
    elif args.cmd == "query":
        out = query.pointer(s, args.pointer) if args.pointer else query.run_query(s, args.where, args.select, args.limit, args.count)
        _print(out.drop("doc_id", "stmt_idx") if args.select else out, args.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
