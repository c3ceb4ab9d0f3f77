"""Command line: ``python -m quadrille [-v | -h | -V] SPEC``.  Exit codes: 0 done, 1 bad specification, 2 failure."""

from __future__ import annotations

import sys

from quadrille import __version__


def main(args: list[str]) -> int:
    verbose = False
    while args and args[0] in ("-v", "-h", "-V", "-VV"):
        flag = args.pop(0)
        if flag == "-v":
            print(f"quadrille {__version__}")
            return 0
        if flag == "-h":
            from quadrille.plans.pipeline import OPERATORS

            print(__doc__, "Operators:", ", ".join(f"@{n}" for n in sorted(OPERATORS)), sep="\n")
            return 0
        verbose = True
    if not args:
        print(__doc__, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from quadrille.plans.pipeline import Pipeline

    spark = SparkSession.builder.appName("quadrille").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if verbose else "ERROR")
    pipeline = Pipeline(spark)
    try:
        pipeline.parse(args if len(args) > 1 else args[0])
    except (ValueError, OSError) as e:
        print(f"bad specification: {e}", file=sys.stderr)
        return 1
    try:
        Pipeline(spark).run(args if len(args) > 1 else args[0])
    except Exception as e:  # noqa: BLE001 - reported by the exit code
        print(f"failed: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
