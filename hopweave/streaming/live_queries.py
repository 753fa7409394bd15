"""Queries that arrive as files, answered from a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators.query import distances
from hopweave.plans.tables import shared_dir

QUERY = "qid long, s int, t int, h int"


def answer_stream(spark: SparkSession, queries: str, labels: DataFrame, k: int, out: str, name: str = "queries") -> None:
    """Answer every Parquet file of queries in a folder once, batch by batch; a
    restart goes on after the last finished batch."""

    def answer(batch: DataFrame, number: int) -> None:
        found = distances(batch, labels, k).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(QUERY).option("maxFilesPerTrigger", 8).parquet(queries)
    run = stream.writeStream.foreachBatch(answer).option("checkpointLocation", f"{shared_dir(spark)}/stream-{name}").trigger(availableNow=True).start()
    run.awaitTermination()
