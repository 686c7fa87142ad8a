"""python -m pagescope schema|meta|row-groups|pages|dump|check-dump PATH ..., or dump-schema"""

from __future__ import annotations

import argparse
import sys
import traceback
from contextlib import nullcontext

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .plans import show
from .plans.progress import progress
from .plans.session import Lens
from .sources import dumps


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pagescope", description="Parquet internals")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("-v", "--verbose", action="count", default=0, help="whole errors; twice: Spark's own messages, too")
    top.add_argument("--progress", action="store_true", help="running stages, on the error stream")
    verbs = top.add_subparsers(dest="verb", required=True)
    verbs.add_parser("dump-schema").add_argument("--check", metavar="FILE", help="only compare with a schema that was printed before")
    verbs.add_parser("check-dump").add_argument("path")
    for name in ("schema", "meta", "row-groups", "pages", "dump"):
        verb = verbs.add_parser(name)
        verb.add_argument("path")
        verb.add_argument("--from-dump", action="store_true", help="PATH holds JSON dumps")
        if name == "meta":
            verb.add_argument("--key")
        if name in ("row-groups", "pages"):
            verb.add_argument("--column", required=name == "pages")
        if name == "pages":
            verb.add_argument("--row-group", type=int)
        if name == "dump":
            verb.add_argument("--metadata-only", action="store_true")
    return top


def _table(found: DataFrame) -> bool:
    """Prints all rows, and their names first; whether there were any."""
    some = False
    for row in found.toLocalIterator():
        if not some:
            print("\t".join(found.columns))
        some = True
        print("\t".join("" if v is None else str(v) for v in row))
    return some


def _run(asked: argparse.Namespace, spark: SparkSession) -> int:
    if asked.verb == "dump-schema":
        text = dumps.dump_schema().json()
        if asked.check is None:
            print(text)
            return 0
        with open(asked.check) as known:
            same = known.read().strip() == text
        if not same:
            print(f"{asked.check} isn't the schema of dumps", file=sys.stderr)
        return 0 if same else 1
    if asked.verb == "check-dump":
        return 1 if _table(dumps.check(spark.read.text(asked.path, wholetext=True).selectExpr("_metadata.file_path AS file_path", "value AS json"))) else 0
    lens = Lens(spark, asked.path, from_dumps=asked.from_dump)
    if asked.verb in ("schema", "dump"):
        column = "line" if asked.verb == "schema" else "json"
        for row in (show.schema_lines(lens) if asked.verb == "schema" else lens.dump(asked.metadata_only)).toLocalIterator():
            print(row[column])
        return 0
    if asked.verb == "meta":
        found = show.key_value(lens, asked.key) if asked.key else show.summary(lens)
    else:
        found = show.row_group_rows(lens, asked.column) if asked.verb == "row-groups" else show.page_rows(lens, asked.column, asked.row_group)
    if _table(found):
        return 0
    print("nothing found", file=sys.stderr)
    return 1


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("pagescope").getOrCreate()
    if asked.verbose > 1:
        spark.sparkContext.setLogLevel("INFO")
    told = progress(spark, lambda phase, done, total: print(f"{phase}: {done} of {total} tasks", file=sys.stderr)) if asked.progress else nullcontext()
    try:
        with told:
            return _run(asked, spark)
    except (PySparkException, OSError, ValueError) as error:
        if asked.verbose:
            traceback.print_exc()
        print(f"error: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
