"""Command line: convert and validate one file. Exit codes: 64 usage, 65 bad data, 66 no input, 70 failure."""

from __future__ import annotations

import argparse
import os
import sys

from .sources.files import MAX_PAYLOAD, EncoderOptions, decode_file, encode_file
from .sources.recording import Recording

FORMATS = ("gpx", "tcx", "fit", "csv", "geojson")
_DELTAS = {"hr": "heart_rate", "cadence": "cadence", "power": "power", "temp": "temperature"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trailframe")
    commands = top.add_subparsers(dest="command")
    c = commands.add_parser("convert")
    c.add_argument("--from", dest="source", choices=FORMATS)
    c.add_argument("--to", choices=FORMATS)
    c.add_argument("--input", "-i")
    c.add_argument("--output", "-o")
    c.add_argument("--encoding", default="utf8")
    c.add_argument("--max-delta-seconds", type=float)
    c.add_argument("--precision-latlon", type=int, default=6)
    c.add_argument("--precision-ele", type=int, default=2)
    for name in _DELTAS:
        c.add_argument(f"--{name}-max-delta", type=float)
    c.add_argument("--gpx-version", choices=("1.1", "1.0"), default="1.1")
    c.add_argument("--tcx-version", choices=("2", "1"), default="2")
    v = commands.add_parser("validate")
    v.add_argument("--format", choices=FORMATS)
    v.add_argument("--input", "-i")
    v.add_argument("--gap-threshold", type=float, default=300.0)
    return top


def fail(code: int, message: str) -> int:
    print(message, file=sys.stderr)
    return code


def say(rec: Recording) -> None:
    for d in rec.diagnostics:
        print(f"{d['severity']}: {d['code']}: {d['message']}", file=sys.stderr)


def payload(path: str) -> tuple[bytes | None, int]:
    if not os.path.exists(path):
        return None, fail(66, f"Input file not found: {path}")
    if os.path.getsize(path) > MAX_PAYLOAD:
        return None, fail(65, f"Input file exceeds {MAX_PAYLOAD} bytes.")
    with open(path, "rb") as f:
        return f.read(), 0


def convert(args: argparse.Namespace) -> int:
    if not all((args.input, args.output, args.source, args.to)):
        return fail(64, "convert requires --from, --to, --input, and --output.")
    try:
        "".encode(args.encoding)
    except LookupError:
        return fail(64, f"Unknown encoding {args.encoding!r}.")
    data, code = payload(args.input)
    if data is None:
        return code
    by_channel = {c: round(d * 1e6) for n, c in _DELTAS.items() if (d := getattr(args, f"{n}_max_delta")) is not None}
    default = 5_000_000 if args.max_delta_seconds is None else round(args.max_delta_seconds * 1e6)
    options = EncoderOptions(default, by_channel, args.precision_latlon, args.precision_ele, args.gpx_version, int(args.tcx_version))
    try:
        rec = decode_file(data, fmt=args.source, encoding=args.encoding).numbered()
        say(rec)
        if any(d["severity"] == "error" for d in rec.diagnostics):
            return fail(65, "Conversion aborted due to parser errors.")
        with open(args.output, "wb") as f:
            f.write(encode_file(rec, args.to, options))
    except Exception as e:
        return fail(70, f"Conversion failed: {e}")
    print(f"Converted {args.input} to {args.output}")
    return 0


def validate(args: argparse.Namespace) -> int:
    if not args.input or not args.format:
        return fail(64, "validate requires --format and --input.")
    data, code = payload(args.input)
    if data is None:
        return code
    try:
        from pyspark.sql import SparkSession

        from .operators.validate import validate as findings
        from .sources.files import decoded, unnested

        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        say(decode_file(data, fmt=args.format))
        a = unnested(decoded(spark.createDataFrame([(args.input, bytearray(data))], "path string, content binary"), fmt=args.format))
        gap = args.gap_threshold if args.gap_threshold > 0 else 300.0
        rows = findings(a, round(gap * 1e6)).groupBy("severity", "code").count().orderBy("severity", "code").collect()
        points = a.points.count()
    except Exception as e:
        return fail(70, f"Validation failed: {e}")
    errors = [r for r in rows if r.severity == "error"]
    print("Validation failed:" if errors else f"Validation passed ({points} points).")
    for r in rows:
        print(f"  - {r.severity}: {r.code} x {r['count']}")
    return 65 if errors else 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 64 if e.code else 0
    if args.command is None:
        return fail(64, "Give a command: convert or validate.")
    return convert(args) if args.command == "convert" else validate(args)


if __name__ == "__main__":
    sys.exit(main())
