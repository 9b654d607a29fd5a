"""python -m motorlode vin|codes ...: prints an answer as JSON. Exit codes: 0, 1 for a failure, 2 for invalid input."""

from __future__ import annotations

import argparse
import json
import sys


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="motorlode", description="Decode a vehicle identifier, or look up type codes.")
    kinds = parser.add_subparsers(dest="kind", required=True)
    vin = kinds.add_parser("vin")
    vin.add_argument("supplied")
    vin.add_argument("--model-year", type=int)
    vin.add_argument("--market")
    vin.add_argument("--long", action="store_true", help="with evidence and explanations")
    types = kinds.add_parser("codes")
    types.add_argument("hsn")
    types.add_argument("tsn")
    return parser.parse_args(words)


def main(words: list[str] | None = None, spark=None) -> int:
    a = arguments(words)
    try:
        from motorlode import api

        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
        status, found = api.decode_one(spark, a.supplied, a.model_year, a.market, a.long) if a.kind == "vin" else api.lookup_type(spark, a.hsn, a.tsn)
    except ValueError as error:
        print(f"motorlode: {error}", file=sys.stderr)
        return 2
    except Exception as error:  # the command's own failures, whatever they are
        print(f"motorlode: {error}", file=sys.stderr)
        return 1
    print(json.dumps(found, indent=2))
    return 0 if status in ("MODERN_FORMAT", "VALID") else 2


if __name__ == "__main__":
    raise SystemExit(main())
