"""Command line: convert volumes, print headers and labels, test streams, write sidecars. Inputs are never removed unless that is asked for."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .sources import files
from .sources import stream as S


def session() -> SparkSession:
    return SparkSession.builder.appName("lamella").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamella", description=__doc__)
    p.add_argument("source", nargs="+", help="files; - reads names from the standard input")
    p.add_argument("-d", "--decompress", action="store_true", help="streams to .npy; otherwise arrays to streams")
    p.add_argument("-i", "--info", action="store_true", help="print headers")
    p.add_argument("-l", "--labels", action="store_true", help="print labels")
    p.add_argument("-T", "--test", action="store_true", help="verify checksums")
    p.add_argument("-M", "--sidecar", action="store_true", help="write the table of labels beside the file")
    p.add_argument("-p", "--pins", action="store_true", help="allow the pin format")
    p.add_argument("-m", "--context-order", type=int, default=0)
    p.add_argument("-z", "--gzip", action="store_true", help="compress the output once more")
    p.add_argument("-r", "--remove", action="store_true", help="remove inputs that were converted")
    return p


def converted(path: str, args) -> str:
    kind, second = files.kind_of(path)
    stem = path[: len(path) - len(kind + second)]
    return stem + (files.ARRAY if args.decompress else files.STREAM) + (".gz" if args.gzip else "")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    names = [n for s in args.source for n in (sys.stdin.read().split() if s == "-" else [s])]
    failed = 0
    for name in names:
        try:
            if args.info:
                print(name, files.load_header(name))
            elif args.labels:
                print(name, *S.Stream.parse(files.bload(name)).unique().tolist())
            elif args.test:
                report = S.check(files.bload(name))
                good = report["header"] and report["crack_index"] and report["labels"] and not report["bad_z"]
                failed += not good
                print(name, "ok" if good else report)
            elif args.sidecar:
                files.write_sidecar(files.load_any(session(), name), os.path.abspath(name) + ".labels.parquet")
            else:
                v = files.load_any(session(), name)
                to = converted(name, args)
                files.save(v, to, **({} if args.decompress else {"pins": args.pins, "context_order": args.context_order}))
                print(to)
                if args.remove:
                    os.remove(name)
        except (OSError, ValueError, TypeError) as e:
            failed += 1
            print(f"{name}: {e}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
