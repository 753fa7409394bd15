"""Operator 8: document fingerprints, bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``k`` smallest 64-bit hashes of a text's
distinct five-word shingles.  Sketches of parts merge into the sketch of the
whole, and they estimate resemblance, containment and the number of distinct
shingles.  With fewer than ``k`` shingles all three are exact.

Everything is built-in column functions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, WORDS = 128, 5
RANGE_BYTES = 64_000_000  # of text in one range of ids, about


# ------------------------------------------------------------ sketch algebra


def word_hashes(text: Column) -> Column:
    """Hashes of the words, which white space separates; empty text: none."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, k: int = K, words: int = WORDS) -> Column:
    """Sketch from word hashes.  Fewer words than a shingle: one shingle of all."""
    rolled = F.transform(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - F.lit(words - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *(F.get(hashes, i + F.lit(j)) for j in range(1, words))),
    )
    shingles = (
        F.when(F.size(hashes) >= words, rolled)
        .when(F.size(hashes) > 0, F.array(F.xxhash64(hashes)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together (shingles across the cut are in neither)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1.0 of two empty texts."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: k - 1 over the share of the hash
    range below the k-th smallest."""
    share = (F.get(a, F.size(a) - 1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has, from
    the resemblance and the three distinct counts; 1.0 where the first is empty."""
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct(a, k)))


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """Sketch per key from the sketches of its parts, however many there are.

    The k smallest of a part can only lose in a larger union, so hashes are
    ranked per key in two steps, the first within slices of the rows; no task
    holds more than a slice's sketches or a key's slices.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64))
    flat = parts.select(*keys, salt.alias("__slice"), F.explode(sketch_col).alias("__h")).distinct()
    ranked = W.partitionBy(*keys, "__slice").orderBy("__h")
    flat = flat.withColumn("__n", F.row_number().over(ranked)).where(F.col("__n") <= k).select(*keys, "__h").distinct()
    ranked = W.partitionBy(*keys).orderBy("__h")
    flat = flat.withColumn("__n", F.row_number().over(ranked)).where(F.col("__n") <= k)
    return flat.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def as_text(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), " ")


def from_text(fingerprint: Column) -> Column:
    return F.transform(F.array_remove(F.split(fingerprint, " "), ""), lambda x: x.cast("bigint"))


# ------------------------------------------------------- documents in a row


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: doc_id, text, sketch.  Null text: the empty text,
    whose sketch is empty.  Other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), word_hashes(text).alias("__words"))
    return hashed.select("doc_id", "text", sketch_of(F.col("__words"), k).alias("sketch"))


def _range_of(bounds: list[int]):
    """How many bounds are at most the column: a binary search."""
    # One literal in the plan, however many bounds there are.
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else None
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def place(x: Column) -> Column:
        if not bounds:
            return F.lit(0)
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda at, s: F.when((at + s <= len(bounds)) & (F.get(array, at + s - F.lit(1)) <= x), at + s).otherwise(at),
        )

    return place


def with_next(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``fingerprint`` with next_text and next_sketch of the document that
    follows by descending doc_id; after the last comes the first.

    Ids are cut in ranges at quantiles, so many that a range has about
    ``range_bytes`` of text, and a window sorts one range at a time; every range
    gets the first row of the range below as its last row.  Order of repeated ids:
    descending text; null ids come last.  The rows of one id stay in one range.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    bounds = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    place = _range_of(sorted(set(bounds)))
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place(F.col("doc_id"))).alias("range")

    # As many rows as there are ranges: the largest id of each, in driver order.
    tops = sorted(ids.groupBy(at).agg(F.max("doc_id").alias("top")).collect(), key=lambda r: -r["range"])
    rows = fingerprint(docs, id_col, text_col, k).withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place(F.col("doc_id"))))
    follow = spark.createDataFrame([(t["range"], t["top"], tops[i - 1]["range"]) for i, t in enumerate(tops)], "range int, top long, above int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    heads = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("above").agg(F.max("text").alias("text"))
    )
    heads = heads.select("above", "text", word_hashes(F.col("text")).alias("__words")).select(
        F.lit(None).cast("long").alias("doc_id"), "text", sketch_of(F.col("__words"), k).alias("sketch"),
        F.col("above").alias("range"), F.lit(True).alias("sent"),
    )
    order = W.partitionBy("range").orderBy(F.col("sent"), F.desc_nulls_last("doc_id"), F.desc("text"))
    both = rows.withColumn("sent", F.lit(False)).unionByName(heads).repartition(ranges, "range")
    return (
        both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
        .where(~F.col("sent")).drop("sent", "range")
    )


def edited_digests(spark: SparkSession, docs: DataFrame, k: int = K, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The contract's columns."""
    rows = with_next(spark, docs, k=k, range_bytes=range_bytes).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).select("doc_id", "n_chars", "sketch", "next_sketch", "edited", word_hashes(F.col("edited")).alias("__words"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch_of(F.col("__words"), k).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
