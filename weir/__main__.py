"""python -m weir [-i FORMAT] [-f FORMAT] [-o PATH] [--any] [--lake FOLDER] [--split COLUMN] QUERY [FILE...]

Runs a query over files (read one after another, fused by field name) or over
what its own text names. Without -o the result is printed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weir import sources
from weir.engine import Engine
from weir.lake.store import Lake
from weir.lang.lexer import QueryError
from weir.operators import rel as R
from weir.operators.lower import combined


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weir", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("query")
    p.add_argument("files", nargs="*")
    p.add_argument("-i", dest="input", help="format of the files")
    p.add_argument("-f", dest="format", default="zson", help="format of the result")
    p.add_argument("-o", dest="out", help="folder of the result")
    p.add_argument("--any", action="store_true", help="values of any type, each with its own")
    p.add_argument("--lake", help="folder of pools")
    p.add_argument("--split", help="one folder for each value of this column")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("weir").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, lake=Lake(spark, a.lake) if a.lake else None)
    try:
        if a.any:
            source = None
            for f in a.files:
                own = sources.readers.sequence(spark, f)
                source = own if source is None else source.union(own)
            df = engine.values(a.query, source).withColumnRenamed("v", "value")
            if a.out:
                df.write.text(a.out)
            else:
                for r in df.toLocalIterator():
                    print(r[0])
            return 0
        rels = [R.of(sources.read(spark, f, a.input)) for f in a.files]
        df = engine.query(a.query, combined(rels).result() if rels else None)
        if a.out:
            sources.write(df, a.out, a.format, **({"split": a.split} if a.split else {}))
        elif a.format == "table":
            df.show(1 << 30, truncate=False)
        else:
            lines = df.select(F.to_json(F.struct("*"))) if a.format == "json" else sources.writers.zson_lines(df)
            for r in lines.toLocalIterator():
                print(r[0])
        return 0
    except QueryError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
