"""Command line: mask, restore, or compare.

python -m veilspark.cli [INPUT] [-c CONFIG] [-e ENGAGEMENT] [-r | --json] [--remember | --restore | --init]
python -m veilspark.cli compare HIGH LOW [--labels H L] [--report-out FILE] [--max-rows N] [--include-bodies FILTER]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import sitemap, vault
from .operators.redact import redact, summary_line
from .policy import Policy
from .sources.files import of_text, read_items
from .sources.store import KEY_VARIABLE, Store


def _parsers() -> tuple[argparse.ArgumentParser, argparse.ArgumentParser]:
    main = argparse.ArgumentParser("veilspark")
    main.add_argument("input", nargs="?")
    main.add_argument("-c", "--config")
    main.add_argument("-e", "--engagement")
    main.add_argument("-r", "--report", action="store_true")
    main.add_argument("--json", action="store_true")
    how = main.add_mutually_exclusive_group()
    for flag in ("--remember", "--restore", "--init"):
        how.add_argument(flag, action="store_true")
    compare = argparse.ArgumentParser("veilspark compare")
    compare.add_argument("high")
    compare.add_argument("low")
    compare.add_argument("-c", "--config")
    compare.add_argument("-e", "--engagement")
    compare.add_argument("--labels", nargs=2, default=("high", "low"))
    compare.add_argument("--report-out")
    compare.add_argument("--max-rows", type=int, default=sitemap.MAX_ROWS)
    compare.add_argument("--include-bodies")
    return main, compare


def _policy(args, store: Store) -> Policy:
    if args.config is None:
        return store.resolve(args.engagement)
    base = Policy.load(args.config)
    if args.engagement is None:
        return base
    path = Path(args.engagement)
    return base.layered(Policy.load(path) if path.exists() else store.load_engagement(store.find_engagement(args.engagement)))


def _vault(spark: SparkSession, store: Store, profile: str, key: bytes):
    sealed = store.load_vault(profile)
    empty = "profile string, replacement string, value string, uses long, last_used long"
    if sealed is None:
        return spark.createDataFrame([], empty)
    return vault.open_sealed(spark.createDataFrame([(profile, bytearray(sealed))], "profile string, sealed binary"), key)


def main(argv: list[str], store: Store | None = None, out=sys.stdout, err=sys.stderr) -> int:
    store, (plain, compare) = store or Store.default(), _parsers()
    if argv[:1] == ["compare"]:
        args = compare.parse_args(argv[1:])
        spark = SparkSession.builder.getOrCreate()
        high, low = (sitemap.items(read_items(spark, p)) for p in (args.high, args.low))
        rows = sitemap.compare(sitemap.endpoint_stats(high, most=None), sitemap.endpoint_stats(low, most=None))
        policy, bodies = _policy(args, store), None
        if args.include_bodies:
            bodies = sitemap.samples(high, args.labels[0], args.include_bodies, policy).unionByName(sitemap.samples(low, args.labels[1], args.include_bodies, policy))
        text = sitemap.report(rows, high, low, policy, tuple(args.labels), args.max_rows, bodies)
        Path(args.report_out).write_text(text, "utf-8") if args.report_out else out.write(text)
        return 0
    args = plain.parse_args(argv)
    if args.restore and args.json:
        plain.error("--restore doesn't go with --json")
    if args.init:
        if not store.global_path.exists():
            store.save_global(Policy())
        out.write(f"{store.global_path}\n")
        return 0
    spark = SparkSession.builder.getOrCreate()
    text = Path(args.input).read_text("utf-8") if args.input else sys.stdin.read()
    profile = store.profile(args.engagement)
    key = vault.key_from_hex(os.environ.get(KEY_VARIABLE, "")) if args.remember or args.restore else b""
    if args.restore:
        r = vault.restore(of_text(spark, text), _vault(spark, store, profile, key)).first()
        out.write(r.restored)
        for p in r.parts:
            if p.kind == "ambiguous":
                err.write(f"ambiguous: {p.text}: {', '.join(p.candidates)}\n")
        return 0
    done = redact(of_text(spark, text), _policy(args, store))
    r = done.first()
    if args.remember:
        known = vault.prune(vault.record(done, F.lit(profile), known=_vault(spark, store, profile, key)))
        if sealed := vault.seal(known, key).first():
            store.save_vault(profile, bytes(sealed.sealed))
    if args.json:
        out.write(json.dumps({"output": r.output, "format": r.format, "findings": [f.asDict() for f in r.findings]}, ensure_ascii=False, indent=2) + "\n")
    else:
        out.write(r.output)
    if args.report:
        counts: dict[str, int] = {}
        for f in r.findings:
            counts[f.category] = counts.get(f.category, 0) + 1
        err.write(summary_line(counts, None if args.engagement is None else profile) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
