"""python -m foliant import FOLDER | search CHUNKS DOCS QUERY"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import search
from .plans.service import import_folder


def main(args: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    if args[:1] == ["import"] and len(args) == 2:
        added, again, bad = import_folder(spark, args[1]).agg(F.expr("count_if(NOT duplicate AND error IS NULL)"), F.expr("count_if(duplicate)"), F.expr("count_if(error IS NOT NULL)")).first()
        print(f"{added} added, {again} already there, {bad} refused")
        return 0
    if args[:1] == ["search"] and len(args) == 4:
        search.grouped(spark.read.parquet(args[1]), spark.read.parquet(args[2]), args[3]).orderBy("rank").show(50, truncate=60)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
