"""The command line: ``python -m loamgrid.plans.cli VERB ...``."""

import argparse
import json
import sys

from pyspark.sql import SparkSession

from loamgrid.core.errors import LoamError
from loamgrid.functions.values import human_bytes
from loamgrid.plans import jobs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamgrid")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("convert", "reproject"):
        v = verbs.add_parser(verb)
        v.add_argument("source")
        v.add_argument("target")
        v.add_argument("--to-crs", required=verb == "reproject")
        v.add_argument("--layer")
        v.add_argument("--hilbert", action="store_true")
        v.add_argument("--source-crs", type=int)
    v = verbs.add_parser("filter-bbox")
    v.add_argument("source")
    v.add_argument("target")
    v.add_argument("--bbox", required=True)
    v.add_argument("--layer")
    v = verbs.add_parser("optimize")
    v.add_argument("source")
    v.add_argument("target")
    v.add_argument("--batch-rows", type=int, default=10_000)
    for verb in ("inspect", "metadata", "profile"):
        v = verbs.add_parser(verb)
        v.add_argument("source")
        if verb == "metadata":
            v.add_argument("--output")
        if verb == "profile":
            v.add_argument("--layer")
            v.add_argument("--top-n", type=int, default=10)
            v.add_argument("--sample-n", type=int, default=5)
            v.add_argument("--distinct-limit", type=int, default=10_000)
    return p


def run(spark: SparkSession, argv: list[str]) -> dict:
    a = parser().parse_args(argv)
    if a.verb in ("convert", "reproject"):
        options = {"hilbert": True} if a.hilbert else {}
        return jobs.convert(spark, a.source, a.target, to_crs=a.to_crs, layer=a.layer, source_crs=a.source_crs, **options)
    if a.verb == "filter-bbox":
        return jobs.filter_bbox(spark, a.source, a.target, jobs.parse_bbox(a.bbox), a.layer)
    if a.verb == "optimize":
        return jobs.optimize(spark, a.source, a.target, a.batch_rows)
    if a.verb == "metadata":
        return jobs.metadata(spark, a.source, a.output)
    if a.verb == "profile":
        return jobs.profile(spark, a.source, a.layer, top_n=a.top_n, sample_n=a.sample_n, distinct_limit=a.distinct_limit)
    return jobs.inspect(spark, a.source)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser().parse_args(argv)
    spark = SparkSession.builder.appName("loamgrid").getOrCreate()
    try:
        out = run(spark, argv)
    except LoamError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, default=str))
    if out.get("bytes"):
        print(human_bytes(out["bytes"]), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
