"""Near duplicates: of each component of the n-gram join one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import land, plain
from hopweave.llm.ngramjoin import join_components
from hopweave.plans.tables import small


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and whatever names
    these have: of each component the smallest id (null ids last, then the first
    landed row).  Rows with a null or empty text stay."""
    rows, of = plain(docs)
    numbered = land(spark, rows.withColumn("row", F.monotonically_increasing_id()), "ngram-rows")
    found = join_components(spark, numbered, "row", of[text_col]).where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("comp"))
    # Rows alone in their component stay; the others are found by size first.
    found = land(spark, found, "ngram-found")
    several = land(spark, found.groupBy("comp").count().where("count > 1").select("comp"), "ngram-several")
    members = found.join(small(several, several.count()), "comp")
    members = numbered.select("row", F.col(of[id_col]).alias("id")).join(members, "row")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stays = members.groupBy("comp").agg(F.min(rank).alias("best")).select(F.col("best.row").alias("row"))
    lost = land(spark, members.select("row").join(stays, "row", "left_anti"), "ngram-lost")
    return numbered.join(small(lost, lost.count()), "row", "left_anti").select(*rows.columns).toDF(*docs.columns)
