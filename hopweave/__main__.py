"""python -m hopweave DATA K OUTPUT [--g-max N | --ranges N] [--queries FILE] [--ids rank|original]

Builds the index of an ``.e`` file, writes labels, ranks, answers and one line of
metrics below OUTPUT, and fails if answers differ from exact search.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hopweave.plans.build import build, check_queries
from hopweave.sources.edge_lists import append_metrics, read_edge_list, read_queries


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="hopweave")
    p.add_argument("data")
    p.add_argument("k", type=int)
    p.add_argument("output")
    p.add_argument("--g-max", type=int)
    p.add_argument("--ranges", type=int)
    p.add_argument("--queries")
    p.add_argument("--ids", choices=["rank", "original"], default="rank")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("hopweave").getOrCreate()
    edges, vertices = read_edge_list(spark, a.data)
    index = build(spark, edges, a.k, a.g_max, vertices, a.ranges)
    index.labels.write.mode("overwrite").parquet(f"{a.output}/labels")
    index.ranks.write.mode("overwrite").parquet(f"{a.output}/ranks")
    wrong = {}
    if a.queries:
        queries = read_queries(spark, a.queries)
        index.ask(queries, a.ids).write.mode("overwrite").parquet(f"{a.output}/answers")
        if a.ids == "rank":
            wrong = check_queries(spark, index, queries.where(F.col("h") >= 0))
    append_metrics(spark, index.metrics | wrong, f"{a.output}/metrics")
    return int(any(wrong.get(x, 0) for x in ("n_distance", "n_path")))


if __name__ == "__main__":
    sys.exit(main())
