"""Operator 10: exact deduplication with keyed streaming state.

Rows are landed as narrow records (digest, identifier, length, locator) and a
streaming query folds them into state keyed by digest.  State lives in RocksDB
on disk, checkpointed to the shared folder, and never expires: per digest it
holds how many rows have it and the stable identifier and content locator of
the row that stays.  New files of records only add to it: with a folder for the
state given, later calls go on from what earlier ones left there.  Afterwards the
state itself is read; digests that more than one row has are hits, and a hit's
rows are compared by their full bytes before they count as copies.  Rows of
earlier calls are read for that from where their locators say they lie.

Only DataFrame operations and the built-in state store run on executors.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import land, plain, settings, shared_dir
from hopweave.plans.tables import delete, exists, small

# The code points that equality ignores.
BLANKS = " \t\n\x0b\x0c\r"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORDS_PER_STORE = 1_000_000  # an open store takes 4 MB of disk at least, so few large ones
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _best() -> Column:
    """Order of who stays: most code points, smallest doc_id (null last), then
    the earliest landed of rows that agree in both."""
    return F.struct(
        "n_chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("low"), F.bitwise_not("row").alias("early"), "path", "at"
    )


def fold(spark: SparkSession, records: str, schema, place: str, n: int, files_per_batch: int = 1000) -> None:
    """Take the files of records (a folder) that the state in ``place`` has not seen
    into it; ``n`` is about how many records there are."""
    stores = max(spark.sparkContext.defaultParallelism, -(-n // RECORDS_PER_STORE))
    with settings(spark, STATE | {"spark.sql.streaming.internal.stateStore.partitions": str(stores)}):
        query = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(records)
            .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(_best()).alias("best"))
            .writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", place).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def state(spark: SparkSession, place: str) -> DataFrame:
    """digest, group_size and the row that stays, from the state store."""
    with settings(spark, STATE):
        read = spark.read.format("statestore").load(place)
    count, best = read.schema["value"].dataType.fieldNames()
    return read.select(F.col("key.digest").alias("digest"), F.col("value")[count].alias("group_size"), F.col("value")[best].alias("best"))


def _located(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """row, doc_id, text and the place of each row: its file and its number there.
    A table that does not come straight from files is landed."""
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")]
    wanted = [row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    try:
        return docs.select(*wanted, *place)
    except AnalysisException:
        return land(spark, docs.select(*wanted), "dedup-texts").select("row", "doc_id", "text", *place)


def _read_located(spark: SparkSession, text_col: str, places: DataFrame) -> DataFrame:
    """``places`` (path, at, ...) of earlier calls with their ``bytes``, read from
    the files named: as many names as files come to the driver."""
    files = [unquote(r["path"]) for r in places.select("path").distinct().collect()]
    rows = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), normalised(F.col(f"`{text_col}`")).alias("bytes"))
    return rows.join(small(places, places.count()), ["path", "at"])


def dedup(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, digest=sha256,
    state_dir: str | None = None,
) -> DataFrame:
    """One row per input row: row, doc_id, keep_id, group_size, kept, digest,
    path, at, keep_path, keep_at.

    Texts are equal when identical without ``BLANKS``; null counts as empty, so
    null, empty and blank texts are one group.  Of equal texts the row with the
    most code points stays, then the smallest doc_id, which must be an integer; a
    null doc_id loses ties.  Of rows that repeat both, exactly one stays.  ``row_col``
    may name a column of unique numbers that identify rows; by default rows are
    numbered as they are read.  Texts are compared whole, however long; other
    columns are ignored, whatever their names.  An empty table gives no rows.

    ``path`` and ``at`` say where a row's content lies.  With ``state_dir``, a folder
    that all executors share, the state stays there: a call sees the rows of all
    calls before it, counts them in group_size and may find that one of them stays
    (kept is false then for all its own rows).  The files of earlier calls must still
    be there, as Parquet with the same text column.  Without, the state goes.
    """
    rows = _located(spark, docs, id_col, text_col, row_col)
    records = rows.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), digest(normalised(F.col("text"))).alias("digest"), "path", "at")
    records = land(spark, records, "dedup-records")
    place = f"{state_dir or shared_dir(spark)}/dedup-state" + ("" if state_dir else f"-{uuid.uuid4().hex}")
    prior = None
    if state_dir:
        if exists(spark, f"{place}/offsets"):
            # Who stayed so far, of the digests that came again.
            prior = land(spark, state(spark, place).join(records.select("digest").distinct(), "digest", "left_semi"), "dedup-prior")
        records.write.mode("append").parquet(f"{state_dir}/dedup-records")
    fold(spark, f"{state_dir}/dedup-records" if state_dir else records._landed_path, records.schema, place, records.count())
    found = state(spark, place).where("group_size > 1")
    if state_dir:
        found = found.join(records.select("digest").distinct(), "digest", "left_semi")
    hits = land(spark, found, "dedup-hits")
    if not state_dir:
        delete(spark, place)
    n_hits = hits.count()

    # Full bytes: all texts of a hit agree exactly when the least and the
    # greatest do.  Both are folded before the shuffle, so a hot hit is cheap.
    bytes_ = rows.select(digest(normalised(F.col("text"))).alias("digest"), normalised(F.col("text")).alias("bytes")).join(small(hits.select("digest"), n_hits), "digest", "left_semi")
    if prior is not None and not prior.isEmpty():
        old = _read_located(spark, text_col, prior.select("digest", "best.path", "best.at"))
        bytes_ = bytes_.unionByName(old.select("digest", "bytes"))
    differ = bytes_.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")).where("least != most").select("digest")
    differ = land(spark, differ, "dedup-differ")
    collided = not differ.isEmpty()
    if collided:
        records, hits = records.join(differ, "digest", "left_anti"), hits.join(differ, "digest", "left_anti")

    found = records.join(small(hits.select("digest", "group_size", "best"), n_hits), "digest", "left").select(
        "row", "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).when(F.col("best.known"), F.bitwise_not("best.low")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.col("best").isNull() | _stays()).alias("kept"),
        "digest", "path", "at", F.coalesce("best.path", "path").alias("keep_path"), F.coalesce("best.at", "at").alias("keep_at"),
    )
    return found.unionByName(_by_bytes(spark, rows, differ, prior, text_col, digest)) if collided else found


def _stays() -> Column:
    return (F.bitwise_not("best.early") == F.col("row")) & (F.col("best.path") == F.col("path")) & (F.col("best.at") == F.col("at"))


def _by_bytes(spark, rows, differ, prior, text_col, digest) -> DataFrame:
    """Rows whose digests collide, grouped by the texts themselves.  Of earlier
    calls the row that the state has is one of them."""
    text = normalised(F.col("text"))
    rows = rows.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), digest(text).alias("digest"), text.alias("bytes"), "path", "at", F.lit(False).alias("old"))
    rows = rows.join(differ, "digest", "left_semi")
    if prior is not None:
        old = prior.join(differ, "digest", "left_semi").select(
            "digest", "best.path", "best.at", F.bitwise_not("best.early").alias("row"), F.when(F.col("best.known"), F.bitwise_not("best.low")).alias("doc_id"), "best.n_chars", F.lit(True).alias("old")
        )
        if not old.isEmpty():
            rows = rows.unionByName(_read_located(spark, text_col, old))
    rows = land(spark, rows, "dedup-collided")
    groups = rows.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.max(_best()).alias("best"))
    return rows.join(groups, ["digest", "bytes"]).where("not old").select(
        "row", "doc_id", F.when(F.col("best.known"), F.bitwise_not("best.low")).alias("keep_id"), "group_size", _stays().alias("kept"), "digest",
        "path", "at", F.col("best.path").alias("keep_path"), F.col("best.at").alias("keep_at"),
    )


def decisions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return dedup(spark, docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and whatever names
    these have; nulls, empty texts, ties and repeats as in ``dedup``."""
    rows, of = plain(docs)
    numbered = land(spark, rows.withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    lost = land(spark, dedup(spark, numbered, of[id_col], of[text_col], "row").where("not kept").select("row"), "dedup-lost")
    return numbered.join(small(lost, lost.count()), "row", "left_anti").select(*rows.columns).toDF(*docs.columns)
