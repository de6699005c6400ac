"""Command line: ``python -m lexweave QUERY --data DIR`` runs a query; ``--correct`` reads sentences and corrects them until ``exit``."""

from __future__ import annotations

import argparse
import sys
import time


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from . import catalog
    from .plans import decoders as D
    from .sources import corpora

    p = argparse.ArgumentParser(prog="lexweave", description=__doc__)
    p.add_argument("query", nargs="?", choices=sorted(catalog.QUERIES), help="a query of the catalogue")
    p.add_argument("--data", required=True, help="folder of the Parquet tables")
    p.add_argument("--rows", type=int, default=20, help="rows to print (0: none)")
    p.add_argument("--json", help="folder to write the whole result to")
    p.add_argument("--markdown", action="store_true", help="print as a Markdown table")
    p.add_argument("--correct", action="store_true", help="correct sentences typed in")
    a = p.parse_args(args)
    if not a.query and not a.correct:
        p.error("a query or --correct is wanted")
    own = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName("lexweave").getOrCreate()
    if a.query:
        found = catalog.QUERIES[a.query](spark, a.data)
        if a.json:
            corpora.write_report(found, a.json)
        if a.rows and a.markdown:
            print(corpora.markdown([r.asDict() for r in found.limit(a.rows).collect()]), end="")
        elif a.rows:
            found.show(a.rows, truncate=100)
    if a.correct:
        models = catalog.editor_models(spark, a.data).value
        for line in iter(sys.stdin.readline, ""):
            if line.strip() == "exit":
                break
            began, words = time.time(), D.tokenize(line)
            new = models.correct(words)
            marked = [f"**{y}**" if x != y else y for x, y in zip(words, new, strict=True)]
            print(f"{D.detokenize(marked)}  ({1000 * (time.time() - began):.1f} ms)", flush=True)
    if own:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
