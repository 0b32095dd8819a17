"""A command line for statements: ``python -m lodestone ROOT``, one statement a line, until ``.exit`` or the end of input."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from lodestone.errors import Outcome
from lodestone.operators.relational import text_rows
from lodestone.plans.engine import Engine


def run(engine: Engine, lines: TextIO, out: TextIO, prompt: str = "") -> None:
    """Execute each line and write its rows and outcome; rows come one partition at a time."""
    print(prompt, end="", file=out, flush=True)
    for line in lines:
        result = engine.execute(line)
        if result.outcome == Outcome.SUCCESS:
            if result.df is not None:
                print(" | ".join(result.df.columns), file=out)
                for row in text_rows(result.df).toLocalIterator():
                    print(row.line, file=out)
            print("done" if result.n is None else f"{result.n} row(s)", file=out)
        elif result.outcome not in (Outcome.EMPTY, Outcome.EXIT):
            print(result.outcome if result.message in ("", result.outcome) else f"{result.outcome}: {result.message}", file=out)
        if not engine.open:
            return
        print(prompt, end="", file=out, flush=True)


def main() -> None:
    if len(sys.argv) != 2:
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    run(Engine(spark, sys.argv[1]), sys.stdin, sys.stdout, "> " if sys.stdin.isatty() else "")
    spark.stop()


if __name__ == "__main__":
    main()
