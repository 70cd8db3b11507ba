"""Command line: ``python -m lamella.cli FAMILY METHOD INPUT [--out PATH] [--name value ...]``."""

from __future__ import annotations

import argparse
import ast

from pyspark.sql import SparkSession

from . import api

FAMILIES = {"operations": api.BasicOperations, "filters": api.Filters, "threshold": api.Threshold, "label": api.Label, "aggregative": api.Aggregative, "metautils": api.MetadataUpdater}


def value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lamella")
    parser.add_argument("family", choices=FAMILIES)
    parser.add_argument("method")
    parser.add_argument("input", nargs="+")
    parser.add_argument("--out", required=True)
    args, rest = parser.parse_known_args(argv)
    options = {rest[k].removeprefix("--").replace("-", "_"): value(rest[k + 1]) for k in range(0, len(rest) - 1, 2)}
    spark = SparkSession.builder.appName("lamella").getOrCreate()
    facade = FAMILIES[args.family](spark)
    inputs = [value(x) for x in args.input]
    getattr(facade, args.method)(*inputs, out=args.out, **options)


if __name__ == "__main__":
    main()
