"""Command line: python -m lectern --tables DIR METHOD [name=value ...] | methods | query NAME SF_DIR.

DIR holds a Parquet folder for each table of lectern.api.TABLES that there is. Values are JSON where they parse as JSON, else
text. --save writes changed tables back as new versions beside the old ones; without it a change is a dry run.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from lectern import api
from lectern.errors import EngineError
from lectern.operators.exports import table


def values(pairs: list[str]) -> dict:
    out = {}
    for p in pairs:
        name, _, text = p.partition("=")
        try:
            out[name] = json.loads(text)
        except ValueError:
            out[name] = text
    return out


def load(spark: SparkSession, tables: str) -> api.Library:
    found = {n: os.path.join(tables, n) for n in api.TABLES}
    return api.Library(spark, **{n: spark.read.parquet(p) for n, p in found.items() if os.path.isdir(p)})


def shown(result, output: str) -> str:
    result = api.plain(result)
    rows = result.get("items", result) if isinstance(result, dict) else result
    if output == "table" and isinstance(rows, list) and all(isinstance(r, dict) for r in rows):
        return table(rows)
    return json.dumps(result, ensure_ascii=False, indent=2, default=str)


def main(argv: list[str] | None = None) -> int:
    parse = argparse.ArgumentParser(prog="lectern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parse.add_argument("--tables", default=".")
    parse.add_argument("--output", choices=("json", "table"), default="json")
    parse.add_argument("--save", metavar="DIR", help="write changed tables here")
    parse.add_argument("method")
    parse.add_argument("params", nargs="*")
    args = parse.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        if args.method == "query":
            from lectern.plans.catalogue import QUERIES

            print(shown(QUERIES[args.params[0]].run(spark, args.params[1]), args.output))
            return 0
        lib = load(spark, args.tables)
        before = dict(lib.t)
        print(shown(lib.call("system.listMethods" if args.method == "methods" else args.method, **values(args.params)), args.output))
        if args.save:
            for name, df in lib.t.items():
                if df is not before[name]:
                    df.write.mode("errorifexists").parquet(os.path.join(args.save, name))
        return 0
    except EngineError as e:
        print(json.dumps({"code": e.code, "message": str(e)}), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
