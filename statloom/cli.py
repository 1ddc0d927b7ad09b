"""Command line: run a script, or print its SQL.

    python -m statloom.cli [-o FILE] [--annotate] [--run] [SCRIPT]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from statloom.plans.script import TERMINAL, logical_lines, parse, unrolled
from statloom.session import Session


def compile_script(spark: SparkSession, text: str, annotate: bool = False) -> str:
    """The SQL of a script's last dataset, ended by a semicolon; with ``annotate`` the commands as comments before it."""
    s = Session(spark, sql_comments=False)
    for line in unrolled(logical_lines(text)):
        c = parse(line)
        if c.verb not in TERMINAL and c.verb not in ("save", "export"):
            s.run(line)
    notes = "".join(f"-- {step.text}\n" for step in s.steps) if annotate else ""
    return f"{notes}{s.sql()};\n"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="statloom")
    parser.add_argument("script", nargs="?", help="script file; standard input if left out")
    parser.add_argument("-o", "--output", help="file for the SQL")
    parser.add_argument("--annotate", action="store_true", help="print the commands as comments")
    parser.add_argument("--run", action="store_true", help="run the script and show what its terminal commands give")
    given = parser.parse_args(args)
    if given.script:
        with open(given.script, encoding="utf-8") as f:
            text = f.read()
    else:
        text = sys.stdin.read()
    spark = SparkSession.builder.appName("statloom").getOrCreate()
    if given.run:
        s = Session(spark)
        for line in unrolled(logical_lines(text)):
            r = s.run(line)
            if r.data is not None:
                r.data.show(50, truncate=False)
        return 0
    sql = compile_script(spark, text, given.annotate)
    if given.output:
        with open(given.output, "w", encoding="utf-8") as f:
            f.write(sql)
    else:
        print(sql, end="")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
