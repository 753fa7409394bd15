"""Operator 9: quality classifier, an interpolated modified Kneser-Ney n-gram model.

The model is trained on trusted text: all labelled documents of good quality that
are not toxic.  Its symbols are bytes as they are, its order is 5, its counts grow
with the trusted text; none of it is ever on the driver or broadcast.

1. Tasks count the 5-grams of their rows, per language and half of the trusted
   documents; counts are summed in shards by (model, gram).  Models are each
   language's, the pooled one of all languages, and for both the models of either
   half alone.
2. Lower orders count left contexts.  Discounts, context totals and interpolated
   probabilities come from joins of these count tables on (model, gram).
3. The logarithm of an interpolated probability is a sum over orders: what the
   context gives away, and what a gram that was seen has over its lower order.  So
   the model is a table of one number for each gram of each order, and a text's
   log likelihood is the sum of its grams' numbers: a join.  Chunks of documents
   send their distinct grams to shards by hash, shards send the numbers back,
   and the chunk's documents, which took their own way, are summed up.
4. Thresholds are quantiles per language of the trusted documents' scores, each by
   the model of the half that does not have the document.

A model of trusted text finds a text that repeats itself as likely as one that does
not.  So beside the perplexity there is a second score with a quantile of its own,
the novelty: the share of a text's pairs of neighbouring words that are distinct.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import FRUGAL, discard, land, plain, release, settings, slices, stable, trim
from hopweave.plans.tables import small

ORDER = 5
QUANTILE = 0.9995
PRIOR = 200  # bytes of the language's average text that every text is mixed with
FEW = 500  # documents of a language whose extremes are taken as they are
POOLED = "*"
CHUNK = 20_000_000  # bytes of text that are scored together, about; a longer text is whole
SEGMENT = 1_000_000  # bytes of a chunk that are sorted at once
BATCH_BYTES = 2_000_000
PAD = b"\n" * (ORDER - 1)

U = np.uint64


# ------------------------------------------------------------------- grams


def grams(whole: list[bytes]):
    """(place, packed 5-grams) of segments of the texts: each text and the line
    ends that close it, after the line ends that open it."""
    data = np.frombuffer(PAD.join([b"", *whole, b""]), np.uint8)
    for a in range(0, max(len(data) - ORDER + 1, 0), SEGMENT):
        part = data[a : a + SEGMENT + ORDER - 1].astype(U)
        packed = np.zeros(len(part) - ORDER + 1, U)
        for i in range(ORDER):
            packed = packed << U(8) | part[i : len(packed) + i]
        yield a, packed


def suffixes(full: np.ndarray) -> list[np.ndarray]:
    """The grams of each order 0 .. 5 that end as ``full`` do."""
    return [full & U((1 << 8 * k) - 1) for k in range(ORDER)] + [full]


def keys_of(model: str, order: int, packed: np.ndarray) -> np.ndarray:
    """64-bit names of a model's grams."""
    salt = int.from_bytes(blake2b(f"{order} {model}".encode(), digest_size=8).digest(), "little")
    with np.errstate(over="ignore"):
        h = (packed ^ U(salt)) * U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(29))


def _distinct(packed: np.ndarray) -> np.ndarray:
    packed = np.sort(packed)  # much faster here than hashing, which np.unique does
    return packed[_starts(packed)]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in ``ordered``, which is not empty."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))


def _wanted(models: list[str], whole: list[bytes]) -> dict[str, np.ndarray]:
    """Distinct 5-grams of the texts of each model."""
    out = {}
    for model in dict.fromkeys(models):
        seen = [_distinct(g) for _, g in grams([x for x, m in zip(whole, models) if m == model])]
        out[model] = _distinct(np.concatenate(seen)) if len(seen) > 1 else seen[0]
    return out


def _requested(wanted: dict[str, np.ndarray]) -> np.ndarray:
    """Sorted names of all grams that the texts need."""
    parts = [keys_of(model, k, _distinct(g) if k < ORDER else g) for model, full in wanted.items() for k, g in enumerate(suffixes(full))]
    return _distinct(np.concatenate(parts))


# --------------------------------------------------------------- training


def _counted(batches):
    """(model, half, gram, n): sums of this task's rows."""
    held: dict[tuple, list] = {}

    def summed(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    for batch in batches:
        for part in slices(batch, 2, SEGMENT):
            groups = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
            whole = part.column(2).cast(pa.binary()).to_pylist()
            for group in dict.fromkeys(groups):
                parts = held.setdefault(group, [])
                for _, g in grams([x for x, y in zip(whole, groups) if y == group]):
                    parts.append(np.unique(g, return_counts=True))
                # Summed up whenever twice what the last sum left is held.
                if sum(len(k) for k, _ in parts) > max(200_000, 2 * len(parts[0][0])):
                    held[group] = [summed(parts)]
    for (lang, half), parts in held.items():
        keys, n = summed(parts)
        for i in range(0, len(keys), 50_000):
            k = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(k)), pa.array([half] * len(k), pa.int32()), pa.array(k.astype(np.int64)), pa.array(n[i : i + 50_000])],
                ["lang", "half", "gram", "n"],
            )


def model_name(lang: Column, half: Column | None = None) -> Column:
    """Of a language's model, or of that of one half of its trusted documents."""
    return F.concat(F.lit(":") if half is None else F.concat(half.cast("string"), F.lit(":")), lang)


def gram_counts(trusted: DataFrame) -> DataFrame:
    """model, gram, n of ``trusted`` (lang, half, text)."""
    own = trusted.mapInArrow(_counted, "lang string, half int, gram long, n long")
    names = [model_name(x, half) for x in (F.lit(POOLED), F.col("lang")) for half in (None, F.col("half"))]
    # A text without a language counts for the pooled models only.
    models = F.when(F.col("lang") == POOLED, F.array(*names[:2])).otherwise(F.array(*names))
    return own.groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")).select(F.explode(models).alias("model"), "gram", "n").groupBy("model", "gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 per model."""
    n = [F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)]
    counts = level.groupBy("model").agg(*n)
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def d(i: int) -> Column:
        free = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))
        return F.least(F.greatest(free, F.lit(0.1)), F.lit(float(i))).alias(f"d{i}")

    return counts.select("model", d(1), d(2), d(3))


def model_table(spark: SparkSession, counts: DataFrame, n_models: int) -> DataFrame:
    """model, order, gram, v, landed: the number of every observed gram of each order.

    With p_k the interpolated probability and b_k a context's back-off weight,
    log p_k(w | c) = log b_k(c) + log p_(k-1)(w | c') + x, where x, the gram's
    excess, is 0 for an unseen gram, and an unseen context has b = 1.  A gram's v is
    its excess plus the log b that it has as a context; the gram of order 0 has
    log b_1 + log 1/256.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: kinds of left neighbours
        levels[k] = levels[k + 1].groupBy("model", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = land(spark, levels[k], f"quality-level{k}")
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    lower, out, orders = None, None, []
    for k in range(1, ORDER + 1):
        rows = levels[k].join(small(_discounts(levels[k]), n_models), "model").withColumn("taken", taken)
        rows = rows.withColumn("context", F.shiftright("gram", 8))
        contexts = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("share"))
        if k == 1:
            below = F.lit(1.0 / 256)
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(
                lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["model", "suffix"]
            )
            below = F.col("below")
        p = (F.col("n") - F.col("taken")) / F.col("total") + F.col("share") * below
        rows = rows.join(contexts, ["model", "context"]).select("model", "gram", p.alias("p"), (F.log(p) - F.log("share") - F.log(below)).alias("excess"))
        weights = contexts.select("model", F.col("context").alias("gram"), F.log("share").alias("weight"))
        if k == 1:
            made = weights.select("model", F.lit(0).alias("order"), "gram", (F.col("weight") - F.log(F.lit(256.0))).cast("float").alias("v"))
        else:  # the grams of the order below are this order's contexts
            made = lower.join(weights, ["model", "gram"], "left").select("model", F.lit(k - 1).alias("order"), "gram", (F.col("excess") + F.coalesce("weight", F.lit(0.0))).cast("float").alias("v"))
        out = made if out is None else out.unionByName(made)
        lower = land(spark, rows, f"quality-order{k}")
        orders.append(lower)
    table = land(spark, out.unionByName(lower.select("model", F.lit(ORDER).alias("order"), "gram", F.col("excess").cast("float").alias("v"))), "quality-model")
    for df in [*levels.values(), *orders]:
        discard(spark, df)
    return table


# ---------------------------------------------------------------- scoring

PACKED = "bucket int, kind int, chunk long, a binary, b binary"
GRAMS, REQUEST, ANSWER, ROWS = range(4)


def _packed(rows):
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "kind", "chunk", "a", "b"])


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket's keys begin in sorted ``keys``."""
    return np.searchsorted((keys >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1)).tolist()


def _table_rows(buckets: int):
    def run(batches):
        for batch in batches:
            models = batch.column(0).dictionary_encode()
            names, of = models.dictionary.to_pylist(), models.indices.to_numpy()
            orders, packed, v = (batch.column(i).to_numpy() for i in (1, 2, 3))
            keys = np.zeros(len(of), U)
            for m, name in enumerate(names):
                for k in range(ORDER + 1):
                    at = (of == m) & (orders == k)
                    keys[at] = keys_of(name, k, packed[at].astype(U))
            order = np.argsort(keys)
            keys, v = keys[order], v[order].astype("<f4")
            cut = _cuts(keys, buckets)
            rows = [(i, GRAMS, 0, keys[a:b].tobytes(), v[a:b].tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            if rows:
                yield _packed(rows)

    return run


def _chunks(batches):
    """(number, rows) of a task's chunks; the same in every run over the rows."""
    number, held, size = None, [], 0
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column("part")[0].as_py() << 32
        for part in slices(batch, 1, CHUNK):
            held.append(part)
            size += part.column(1).nbytes
            if size >= CHUNK:
                whole, held, size = pa.Table.from_batches(held).combine_chunks(), [], 0
                yield number, whole
                number, whole = number + 1, None
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


def _texts(part) -> tuple[list[str], list[bytes]]:
    return part.column(0).to_pylist(), [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]


def _requests(buckets: int):
    def run(batches):
        for number, part in _chunks(batches):
            keys = _requested(_wanted(*_texts(part)))
            cut = _cuts(keys, buckets)
            check = _check(keys)
            yield _packed([(i, REQUEST, number, keys[a:b].tobytes(), check) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a])
            del keys, part
            trim()

    return run


def _answers(batches):
    """One shard: the table's rows come first, then requests."""
    held, keys, v = [], None, None
    for batch in batches:
        out, size = [], 0
        for bucket, kind, chunk, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == GRAMS:
                held.append((a, b))
                continue
            if keys is None:
                keys = np.concatenate([np.frombuffer(x, U) for x, _ in held] or [np.zeros(0, U)])
                v = np.concatenate([np.frombuffer(x, "<f4") for _, x in held] or [np.zeros(0, "<f4")])
                order = np.argsort(keys)
                keys, v, held = keys[order], v[order], []
            asked = np.frombuffer(a, U)
            got = np.zeros(len(asked), "<f4")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                known = keys[at] == asked
                got[known] = v[at[known]]
            out.append((bucket, ANSWER, chunk, b, got.tobytes()))
            size += 4 * len(got)
            if size > BATCH_BYTES:
                yield _packed(out)
                out, size = [], 0
        if out:
            yield _packed(out)


def _rows(batches):
    """The chunks' own rows, compressed."""
    for number, part in _chunks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
            w.write_table(part)
        yield _packed([(-1, ROWS, number, sink.getvalue().to_pybytes(), None)])


def novelty(text: bytes) -> float:
    """Share of the pairs of neighbouring words that are distinct; 1 without any."""
    words = text.split()
    return len(set(zip(words, words[1:]))) / (len(words) - 1) if len(words) > 1 else 1.0


def likelihoods(models: list[str], whole: list[bytes], wanted: dict[str, np.ndarray], keys: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Log likelihood of each text with the line ends that close it.

    A segment's grams are sorted together with the text that each is of, so that
    every distinct gram is looked up once and in order."""
    out = np.zeros(len(whole))
    for model, full in wanted.items():
        value = np.zeros(len(full))
        for k, g in enumerate(suffixes(full)):
            distinct = _distinct(g) if k < ORDER else g
            numbers = v[np.searchsorted(keys, keys_of(model, k, distinct))]
            value += numbers[np.searchsorted(distinct, g)] if k < ORDER else numbers
        own = [i for i, m in enumerate(models) if m == model]
        ends = np.cumsum([len(whole[i]) + len(PAD) for i in own])
        total = np.zeros(len(own))
        for a, g in grams([whole[i] for i in own]):
            first, last = np.searchsorted(ends, [a, a + len(g) - 1], "right")
            inside = np.clip(ends[first : last + 1] - a, 0, len(g))
            # A gram has 40 bits, and a segment's texts are fewer than its grams.
            packed = np.sort(g << U(24) | np.repeat(np.arange(last + 1 - first, dtype=U), np.diff(inside, prepend=0)))
            starts = _starts(packed >> U(24))
            numbers = value[np.searchsorted(full, packed[starts] >> U(24))]
            of = (packed & U((1 << 24) - 1)).astype(np.int64)
            total[first : last + 1] += np.bincount(of, np.repeat(numbers, np.diff(starts, append=len(packed))), last + 1 - first)
        out[own] = total
    return out


def _check(keys: np.ndarray) -> bytes:
    return blake2b(keys.tobytes(), digest_size=8).digest()


def _summed(names: list[str]):
    def sums(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        with pa.ipc.open_stream(table.column("a")[kinds.index(ROWS)].as_buffer()) as r:
            part = r.read_all().combine_chunks()
        models, whole = _texts(part)
        wanted = _wanted(models, whole)
        keys = _requested(wanted)
        answers = sorted((table.column("bucket")[i].as_py(), i) for i, k in enumerate(kinds) if k == ANSWER)
        if any(table.column("a")[i].as_py() != _check(keys) for _, i in answers):
            raise RuntimeError("a chunk's rows differ from those that its grams were asked for")
        v = np.concatenate([np.frombuffer(table.column("b")[i].as_py(), "<f4") for _, i in answers]).astype(np.float64)
        more = [pa.array([len(x) for x in whole], pa.int64()), pa.array(-likelihoods(models, whole, wanted, keys, v)), pa.array([novelty(x) for x in whole])]
        return pa.table([part.column(x) for x in names] + more, names=[*names, "n", "nll", "novelty"])

    def run(table: pa.Table) -> pa.Table:
        out = sums(table)
        trim()
        return out

    return run


def _scored(spark: SparkSession, rows: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """Columns ``names`` of ``rows`` (model, text, further ones) with n, nll and
    novelty, in any order.  ``rows`` are read twice and must come in one order."""
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stable(spark, rows, "quality-rows").withColumn("part", F.spark_partition_id())
    numbers = table.select("model", "order", "gram", "v").mapInArrow(_table_rows(buckets), PACKED)
    answers = numbers.unionByName(rows.mapInArrow(_requests(buckets), PACKED))
    answers = answers.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind").mapInArrow(_answers, PACKED)
    kinds = dict((f.name, f.dataType.simpleString()) for f in rows.schema)
    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in names), "n long, nll double, novelty double"])
    return answers.unionByName(rows.mapInArrow(_rows, PACKED)).groupBy("chunk").applyInArrow(_summed(names), schema)


# ------------------------------------------------------------- the classifier


@dataclass
class Model:
    table: DataFrame | None = None  # model, order, gram, v
    limits: DataFrame | None = None  # lang, mean, most, least: of languages with a model of their own, and the pooled one
    langs: int = 0  # rows of ``limits``


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of good and never toxic labels."""
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("trusted_id"))
    return good.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) = 0").select("trusted_id")


def _named(docs: DataFrame, langs: DataFrame, n: int, half: Column | None = None) -> DataFrame:
    """``docs`` (lang, text, ...) with the model that scores them, put first."""
    own = langs.select("lang", F.lit(True).alias("own"))
    lang = F.when(F.col("own"), F.col("lang")).otherwise(POOLED)
    rest = [c for c in docs.columns if c not in ("lang", "text")]
    return docs.join(small(own, n), "lang", "left").select(model_name(lang, half).alias("model"), "text", *rest)


def _mixed(mean: Column) -> Column:
    """Log perplexity a byte, of the text and PRIOR bytes of average text."""
    return (F.col("nll") + PRIOR * mean) / (F.col("n") + len(PAD) + PRIOR)


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE,
) -> Model:
    """Model and thresholds from all trusted documents.  A language without trusted
    documents in both halves takes the pooled model; if all languages together are
    such a one, the model is empty and everything is kept."""
    with settings(spark, FRUGAL):
        return _train(spark, docs, labels, id_col, text_col, lang_col, quantile)


def _train(spark, docs, labels, id_col, text_col, lang_col, quantile) -> Model:
    ids = land(spark, trusted_ids(labels).withColumn("half", F.pmod(F.xxhash64("trusted_id"), F.lit(2)).cast("int")), "quality-trusted")
    docs, of = plain(docs)
    lang, text = F.coalesce(F.col(of[lang_col]).cast("string"), F.lit(POOLED)), F.coalesce(F.col(of[text_col]), F.lit(""))
    trusted = docs.select(F.col(of[id_col]).alias("trusted_id"), lang.alias("lang"), text.alias("text")).join(small(ids, ids.count()), "trusted_id").select("lang", "half", "text")
    halves = trusted.select("lang", "half").distinct()
    halves = land(spark, halves.unionByName(halves.select(F.lit(POOLED).alias("lang"), "half")).groupBy("lang").agg(F.count_distinct("half").alias("halves")), "quality-langs")
    langs = halves.where("halves = 2").select("lang")
    n = langs.count()
    if not n:
        return Model()
    counts = land(spark, gram_counts(trusted), "quality-counts")
    table = model_table(spark, counts, 3 * halves.count())
    release(spark)
    # Each trusted document by the model of the other half.
    rows = _named(trusted, langs, n, 1 - F.col("half"))
    found = land(spark, _scored(spark, rows, table.where(~F.col("model").startswith(":")), ["model"]).withColumn("lang", F.substring("model", 3, 1 << 30)), "quality-scores")
    # The pooled model's thresholds cover all trusted documents that it scores itself, or else all there are.
    means = found.groupBy("lang").agg((F.sum("nll") / F.sum(F.col("n") + len(PAD))).alias("mean"))
    means = means.unionByName(found.agg((F.sum("nll") / F.sum(F.col("n") + len(PAD))).alias("mean")).select(F.lit(POOLED).alias("lang"), "mean"))
    means = means.groupBy("lang").agg(F.max("mean").alias("mean"))
    scores = found.join(small(means, n), "lang").select("lang", "mean", _mixed(F.col("mean")).alias("score"), "novelty")
    scores = scores.unionByName(scores.where(F.col("lang") != POOLED).withColumn("lang", F.lit(POOLED)))
    at = lambda c, q: F.percentile_approx(c, [0.5, q], 10_000)
    limits = scores.groupBy("lang").agg(F.max("mean").alias("mean"), F.count(F.lit(1)).alias("seen"), at("score", quantile).alias("s"), at("novelty", 1 - quantile).alias("v"))
    # The extreme of a few documents is drawn out along an exponential tail to that
    # of FEW; from so many on the factor is 1.
    far = F.greatest(F.lit(1.0), F.lit(math.log(FEW)) / F.log(F.col("seen") + 1))
    drawn = lambda c: (F.col(c)[0] + far * (F.col(c)[1] - F.col(c)[0]))
    limits = land(spark, limits.select("lang", "mean", drawn("s").alias("most"), drawn("v").alias("least")), "quality-limits")
    return Model(table.where(F.col("model").startswith(":")), limits, n + 1)


def _judged(spark: SparkSession, rows: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """Columns ``names`` of ``rows`` (lang, text, ...), lang, n, score, novelty, most, least."""
    with settings(spark, FRUGAL):
        found = _scored(spark, _named(rows, model.limits, model.langs), model.table, ["model", *names])
    found = found.withColumn("lang", F.substring("model", 2, 1 << 30)).join(small(model.limits, model.langs), "lang")
    return found.withColumn("score", _mixed(F.col("mean")))


KEPT = "score <= most AND novelty >= least"


def classify(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, model (language, or * for the pooled), n_bytes,
    perplexity and threshold (per byte, after mixing with PRIOR bytes of average
    text), novelty and least_novelty, kept.

    A null or empty text has about the average perplexity and novelty 1, and is
    kept; a null or unknown language takes the pooled model; repeated rows each have
    a row; an empty table gives none; with an empty model everything is kept and has
    null scores.  Texts are scored whole, however long.
    """
    docs, of = plain(docs)
    lang, text = F.coalesce(F.col(of[lang_col]).cast("string"), F.lit(POOLED)), F.coalesce(F.col(of[text_col]), F.lit(""))
    rows = docs.select(lang.alias("lang"), text.alias("text"), F.col(of[id_col]).alias("doc_id"))
    if model.table is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("perplexity", "threshold", "novelty", "least_novelty")]
        return rows.select("doc_id", F.lit(POOLED).alias("model"), F.octet_length("text").cast("long").alias("n_bytes"), *none, F.lit(True).alias("kept"))
    return _judged(spark, rows, model, ["doc_id"]).select(
        "doc_id", F.col("lang").alias("model"), F.col("n").alias("n_bytes"), F.exp("score").alias("perplexity"), F.exp("most").alias("threshold"),
        "novelty", F.col("least").alias("least_novelty"), F.expr(KEPT).alias("kept"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns and
    whatever names these have; nulls, empty texts and repeats as there."""
    if model.table is None:
        return docs
    rows, of = plain(docs)
    lang, text = F.coalesce(F.col(of[lang_col]).cast("string"), F.lit(POOLED)), F.coalesce(F.col(of[text_col]), F.lit(""))
    kept = _judged(spark, rows.select(lang.alias("lang"), text.alias("text"), *[c for c in rows.columns if c != of[text_col]], F.col(of[text_col]).isNull().alias("none")), model, ["text", "none", *[c for c in rows.columns if c != of[text_col]]]).where(KEPT)
    back = [F.when(~F.col("none"), F.col("text")).alias(c) if c == of[text_col] else F.col(c) for c in rows.columns]
    return kept.select(*back).toDF(*docs.columns)
