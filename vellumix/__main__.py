"""python -m vellumix COMMAND: transform, fix, validate, check, compare, members, merge or publish the documents of a folder. Results with a path become files of that name below the output folder."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import functions as F

from .plans import workflows as W
from .session import session
from .sources import markup


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellumix", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in {"transform": ("--to",), "fix": ("--day", "--authors"), "validate": (), "check": (), "compare": ("--with",), "members": ("--with",), "merge": ("--with", "--type"), "publish": ("--root",)}.items():
        c = sub.add_parser(name)
        c.add_argument("-i", "--input", required=True)
        c.add_argument("-o", "--output", help="folder for the results; without it they are shown")
        for option in more:
            c.add_argument(option, required=option in ("--with", "--root"), choices={"--to": list(W.EXTENSION), "--type": ["flags", *W.revise.KINDS]}.get(option))
    return p


def run(spark, args):
    if args.command == "transform":
        return W.transform(spark, args.input, args.to)
    if args.command == "fix":
        return W.fix(spark, args.input, args.day or datetime.date.today().isoformat(), args.authors or "")
    if args.command == "validate":
        return W.validate(spark, args.input)
    if args.command == "check":
        return W.findings(spark, args.input)
    if args.command == "compare":
        return W.consistency(spark, args.input, getattr(args, "with"))
    if args.command == "members":
        return W.members_of(spark, args.input, getattr(args, "with"))
    if args.command == "merge":
        if args.type in (None, "flags"):
            return W.revisions(spark, args.input, getattr(args, "with"))
        return W.merged(spark, args.input, getattr(args, "with"), args.type)
    return W.publish(spark, args.input, args.root)


def main(argv: list[str] | None = None, spark=None) -> None:
    args = parser().parse_args(argv)
    spark = spark or session()
    out = run(spark, args)
    if args.command == "fix":
        out = out.withColumn("out_path", F.concat("name", F.lit(".xml")))
    if not args.output:
        out.show(1000, truncate=False)
    elif "out_path" in out.columns:
        print(f"{markup.write_files(out, args.output)} files written")
    else:
        out.write.mode("overwrite").parquet(args.output)
    told = W.problems(spark, args.input, args.to) if args.command == "transform" else out.select(F.col("out_path").alias("name"), F.explode("problems").alias("problem")) if "problems" in out.columns else None
    if told is not None:
        for r in told.orderBy("name", "problem").toLocalIterator():
            print(f"{r.name}: {r.problem}", file=sys.stderr)


if __name__ == "__main__":
    main()
