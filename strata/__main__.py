"""python -m strata a ARCHIVE PATH... | x ARCHIVE FOLDER, with --level, --backend, --password, --no-filter, --threads, --no-solid and --no-dedup."""

from __future__ import annotations

import argparse
import dataclasses
import getpass
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strata", description=__doc__)
    p.add_argument("verb", choices=("a", "x"))
    p.add_argument("archive")
    p.add_argument("paths", nargs="+")
    p.add_argument("--level", type=int, choices=range(10), default=3)
    p.add_argument("--backend", choices=("zstd", "zlib", "lzma"), help="compressor instead of the level's own")
    p.add_argument("--password")
    p.add_argument("--no-filter", action="store_true")
    p.add_argument("--no-solid", action="store_true")
    p.add_argument("--no-dedup", action="store_true")
    p.add_argument("--threads", type=int, default=0)
    o = p.parse_args(args)
    from pyspark.sql import SparkSession

    from strata.errors import StrataError
    from strata.options import Options
    from strata.plans import archive
    from strata.sources import files

    spark = SparkSession.builder.master(f"local[{o.threads or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if o.verb == "a":
            options = dataclasses.replace(Options.of_level(o.level, o.password, not o.no_filter, o.backend))
            options = dataclasses.replace(options, solid=options.solid and not o.no_solid, dedup=options.dedup and not o.no_dedup)
            archive.create_archive(files.scan(spark, o.paths, skip=(o.archive,)), o.archive, options)
        else:
            password = o.password or (getpass.getpass() if archive.is_encrypted(o.archive) else None)
            archive.extract_archive(spark, o.archive, o.paths[0], password)
    except StrataError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return -e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
