"""Command line: ``python -m weftmap.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import parse_size
from .model import Params
from .plans.compute import compute, compute_domains, expected_only
from .plans.filter import filter_results
from .plans.merge import merge_files
from .plans.products import product
from .plans.view import view
from .sources import manifest
from .sources.pixels import read_pixels
from .sources.results import build_metadata, export_file, load_expected, listed_collisions, pair_files, read_metadata, read_results, save_expected, write_results
from .sources.text import count_drops, domains_of, mask_bins, read_bed3, read_bedpe, read_chrom_sizes, tsv_lines, two_chroms

VERSION = "1.0"


def session() -> SparkSession:
    return SparkSession.builder.appName("weftmap").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def kind_of(args: argparse.Namespace) -> str:
    return "cis" if args.cis_only else "trans" if args.trans_only else "all"


def _model_options(p: argparse.ArgumentParser, defaults: Params) -> None:
    p.add_argument("--min-delta", type=int)
    p.add_argument("--max-delta", type=int)
    p.add_argument("--bin-aggregation-possible-distances-cutoff", type=float)
    p.add_argument("--bin-aggregation-observed-distances-cutoff", type=float)
    p.add_argument("--interpolate-expected-values", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--evs-interpolation-qtile", type=float)
    p.add_argument("--evs-interpolation-window", type=int)
    p.add_argument("--mad-max", type=float)
    p.add_argument("--bin-mask", help="BED3 with intervals to be masked")
    p.set_defaults(model=defaults)


_MODEL = {
    "min_delta": "min_delta", "max_delta": "max_delta", "bin_aggregation_possible_distances_cutoff": "possible_cutoff", "bin_aggregation_observed_distances_cutoff": "observed_cutoff",
    "interpolate_expected_values": "interpolate", "evs_interpolation_qtile": "quantile", "evs_interpolation_window": "window", "mad_max": "mad_max",
}


def params_of(args: argparse.Namespace) -> Params:
    from dataclasses import replace

    given = {field: getattr(args, option) for option, field in _MODEL.items() if getattr(args, option) is not None}
    params = replace(args.model, **given)
    if params.min_delta >= params.max_delta:
        raise ValueError("--min-delta must be below --max-delta")
    return params


def _selection(p: argparse.ArgumentParser) -> None:
    p.add_argument("--chrom1")
    p.add_argument("--chrom2")
    p.add_argument("--cis-only", action="store_true")
    p.add_argument("--trans-only", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftmap", description="Significant contacts of sparse contact matrices.")
    top.add_argument("-V", "--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("cartesian-product", help="pairs of intervals")
    p.add_argument("domains")
    p.add_argument("-c", "--chrom-sizes")
    _selection(p)

    p = commands.add_parser("checksum", help="digests of files or reports")
    p.add_argument("files", nargs="+")

    p = commands.add_parser("compute", help="p-values of pixels or domains")
    p.add_argument("pixels")
    p.add_argument("chrom_sizes")
    p.add_argument("output")
    p.add_argument("--resolution", type=int, required=True)
    p.add_argument("--expected-values")
    p.add_argument("--domains")
    p.add_argument("--bad-bin-fraction", type=float, default=0.1)
    p.add_argument("--interaction-aggregation-strategy", choices=["auto", "one-pass", "multi-pass"], default="auto", help="kept for old scripts; the planner chooses")
    p.add_argument("--compression-method", choices=["zstd", "lz4"], default="zstd")
    p.add_argument("--compression-level", type=int, default=9)
    p.add_argument("--force", action="store_true")
    _selection(p)
    _model_options(p, Params())

    p = commands.add_parser("expected", help="expected values")
    p.add_argument("pixels")
    p.add_argument("chrom_sizes")
    p.add_argument("--output", required=True)
    p.add_argument("--resolution", type=int, required=True)
    p.add_argument("--force", action="store_true")
    _selection(p)
    _model_options(p, Params.expected_command())

    p = commands.add_parser("filter", help="correct p-values")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("chrom_sizes")
    p.add_argument("--fdr", type=float, default=0.01)
    p.add_argument("--log-ratio", type=float, default=2.0)
    p.add_argument("--drop-non-significant", action=argparse.BooleanOptionalAction, default=True)
    how = p.add_mutually_exclusive_group()
    for flag, value in (("--correct-pvals-chrom-by-chrom", "chrom-chrom"), ("--correct-pvals-cis-trans", "cis-trans"), ("--correct-pvals-all", "all")):
        how.add_argument(flag, dest="by", action="store_const", const=value)
    p.set_defaults(by="cis-trans")
    p.add_argument("--by-pair", action="store_true", help="a folder written by all executors instead of one file")
    p.add_argument("--force", action="store_true")

    p = commands.add_parser("merge", help="many results into one file")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--input-prefix")
    which.add_argument("--input-files", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("chrom_sizes")
    p.add_argument("--ignore-report-file", action="store_true")
    p.add_argument("--by-pair", action="store_true", help="a folder written by all executors instead of one file")
    p.add_argument("--max-memory", type=lambda t: parse_size(t, 125 * 10**6), help="kept for old scripts; executors have their own limits")
    p.add_argument("--force", action="store_true")

    p = commands.add_parser("metadata", help="metadata of a file")
    p.add_argument("parquet")
    p.add_argument("--raw", action="store_true")

    p = commands.add_parser("view", help="rows of a result")
    p.add_argument("parquet")
    p.add_argument("--range", default="all")
    p.add_argument("--range2", default="all")
    p.add_argument("--pvalue-cutoff", type=float, default=1.0)
    p.add_argument("--log-ratio-cutoff", type=float, default=float("-inf"))
    p.add_argument("--write-header", action=argparse.BooleanOptionalAction, default=True)
    return top


def validate(args: argparse.Namespace) -> None:
    """Options that exclude each other."""
    if getattr(args, "cis_only", False) and (args.trans_only or args.chrom1 or args.chrom2):
        raise ValueError("--cis-only excludes --trans-only, --chrom1 and --chrom2")
    if getattr(args, "trans_only", False) and (args.chrom1 or args.chrom2):
        raise ValueError("--trans-only excludes --chrom1 and --chrom2")
    if getattr(args, "chrom2", None) and not args.chrom1:
        raise ValueError("--chrom2 needs --chrom1")
    if getattr(args, "expected_values", None) and (given := [o for o in _MODEL if getattr(args, o) is not None] + ["bin_mask"] * bool(args.bin_mask)):
        raise ValueError(f"--expected-values excludes {', '.join('--' + o.replace('_', '-') for o in given)}")


def _out(path: str, force: bool) -> str:
    if not force and (there := listed_collisions([path])):
        raise FileExistsError(f"refusing to overwrite, pass --force to do so:{there}")
    return "overwrite" if force else "errorifexists"


def put(rows, args: argparse.Namespace, genome, mode: str, metadata: str) -> None:
    """One file for exchange, or a folder by pair."""
    if args.by_pair:
        write_results(rows, args.output, genome, mode)
    else:
        export_file(rows, args.output, genome, metadata)


def _print(rows) -> None:
    for row in tsv_lines(rows).toLocalIterator():
        print(row["line"])


def run(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    validate(args)
    if args.command == "checksum":
        for path in args.files:
            digest, good = manifest.checksum(path)
            if not good:
                print(f"warning: {path} does not match its own checksum", file=sys.stderr)
            print(f"{path}  {digest}")
        return 0
    if args.command == "metadata":
        text = read_metadata(args.parquet)
        print(text if args.raw else json.dumps(json.loads(text), indent=3))
        return 0

    spark = session()
    genome = None
    if getattr(args, "chrom_sizes", None):
        genome = read_chrom_sizes(spark, args.chrom_sizes, getattr(args, "resolution", None) or 1)
    if args.command == "cartesian-product":
        if genome is None and args.chrom1:
            genome = two_chroms(args.chrom1, args.chrom2)
        _print(product(read_bed3(spark, args.domains), genome, kind_of(args), args.chrom1, args.chrom2))
    elif args.command == "expected":
        mode = _out(args.output, args.force)
        pair = (args.chrom1, args.chrom2 or args.chrom1) if args.chrom1 else None
        mask = mask_bins(read_bed3(spark, args.bin_mask), genome) if args.bin_mask else None
        save_expected(expected_only(read_pixels(spark, args.pixels, genome), genome, params_of(args), mask, kind_of(args), pair), args.output, genome, mode)
    elif args.command == "compute":
        mode = _out(args.output, args.force)
        kind = kind_of(args) if not args.chrom1 else "cis" if (args.chrom2 or args.chrom1) == args.chrom1 else "trans"
        pixels = read_pixels(spark, args.pixels, genome)
        mask = mask_bins(read_bed3(spark, args.bin_mask), genome) if args.bin_mask else None
        expected = load_expected(spark, args.expected_values, genome, kind) if args.expected_values else None
        params = None if expected else params_of(args)
        if args.domains:
            rectangles = read_bedpe(spark, args.domains)
            select = (kind != "trans", kind != "cis", args.chrom1, args.chrom2)
            print(count_drops(rectangles, genome, *select), file=sys.stderr)
            rows = compute_domains(pixels, domains_of(rectangles, genome, *select), genome, params, expected, mask, args.bad_bin_fraction, kind)
        else:
            rows = compute(pixels, genome, params, expected, mask, kind)
        if args.chrom1:
            rows = rows.where((F.col("chrom1") == args.chrom1) & (F.col("chrom2") == (args.chrom2 or args.chrom1)))
        write_results(rows, args.output, genome, mode, codec=args.compression_method, level=args.compression_level)
    elif args.command == "filter":
        mode = _out(args.output, args.force)
        earlier = read_metadata(args.input) if Path(args.input).is_file() else ""
        rows = filter_results(read_results(spark, args.input, "compute"), args.fdr, args.log_ratio, args.by, keep_all=not args.drop_non_significant)
        put(rows, args, genome, mode, build_metadata("filter", genome, {"fdr": args.fdr, "log-ratio": args.log_ratio, "by": args.by}, [earlier], VERSION))
    elif args.command == "merge":
        mode = _out(args.output, args.force)
        if args.input_prefix:
            prefix = Path(args.input_prefix)
            report = prefix.parent / f"{prefix.name}.json"
            if report.exists() and not args.ignore_report_file:
                manifest.Manifest.load(report).validate().raise_failures()
            paths = pair_files(str(prefix.parent), prefix.name, genome)
        else:
            paths = args.input_files
        if not paths:
            raise FileNotFoundError("no table to merge was found")
        earlier = [read_metadata(p) for p in paths if Path(p).is_file()]
        put(merge_files(spark, paths, genome), args, genome, mode, build_metadata("merge", genome, {"input-files": paths}, earlier, VERSION))
    elif args.command == "view":
        rows = view(read_results(spark, args.parquet), args.range, args.range2, args.pvalue_cutoff, args.log_ratio_cutoff)
        if args.write_header:
            print("\t".join(rows.columns))
        _print(rows)
    return 0


if __name__ == "__main__":
    try:
        sys.exit(run(sys.argv[1:]))
    except (ValueError, FileNotFoundError, FileExistsError) as problem:
        sys.exit(f"error: {problem}")
