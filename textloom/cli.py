"""python -m textloom.cli BOOK RECIPE OUTPUT: records of a book as a TSV file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import __version__
from .errors import ExtractionError
from .plans.compiler import extract
from .plans.recipe import load_recipe
from .sink import write_tsv


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textloom", description="Extract the records of a book by a recipe.")
    p.add_argument("--version", action="version", version=__version__)
    for name in ("book", "recipe", "output"):
        p.add_argument(name)
    a = p.parse_args(args)
    try:
        recipe = load_recipe(a.recipe)
        n = write_tsv(extract(SparkSession.builder.getOrCreate(), a.book, recipe), a.output)
    except (ExtractionError, OSError) as e:
        print(f"textloom: {e}", file=sys.stderr)
        return 2
    print(f"{n} records")
    return 0


if __name__ == "__main__":
    sys.exit(main())
