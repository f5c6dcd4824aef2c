"""``python -m vantarow QUERY DIRECTORY [--out PATH] [--master MASTER]``: runs a named query; ``--list`` names them."""

from __future__ import annotations

import argparse

from vantarow import catalogue
from vantarow.session import session
from vantarow.sources.files import settings


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vantarow", description="Run a named query over a directory of Parquet tables.")
    parser.add_argument("query", nargs="?", choices=sorted(catalogue.QUERIES), metavar="QUERY")
    parser.add_argument("directory", nargs="?", help="where the tables are")
    parser.add_argument("--out", help="write Parquet there instead of showing the first rows")
    parser.add_argument("--master", help="Spark master; the session's own if not given")
    parser.add_argument("--list", action="store_true", help="name the queries")
    asked = parser.parse_args(arguments)
    if asked.list:
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    if not asked.query or not asked.directory:
        parser.error("a query and a directory are needed")
    spark = session(master=asked.master)
    # of the session: spark.vantarow.rows, spark.vantarow.truncate
    shown = settings(spark, {"rows": "20", "truncate": "false"})
    result = catalogue.QUERIES[asked.query](spark, asked.directory)
    if asked.out:
        result.write.parquet(asked.out)
    else:
        result.show(int(shown["rows"]), truncate=shown["truncate"].lower() == "true")


if __name__ == "__main__":
    main()
