"""Operator 5: packing documents along a space-filling curve.

1. Every document's byte pairs are hashed to a vector, the vector is projected
   to ``DIMS`` dimensions, and its place on a Hilbert curve becomes a sort key.
   The low bits of the key are a hash of the id, so that equal texts, which meet
   at one point of the curve, still spread over partitions.
2. Quantiles of the keys bound the ranges.  Only ranges - 1 numbers come to the
   driver.
3. Documents are tokenised once and their ids shuffled once, to their range.
4. Each range is sorted by key and cut every ``length`` ids, so neighbours on
   the curve share sequences.  What is left at a range's end becomes sequences
   of powers of two, so nothing at all is padded.

A task of step 4 reads its range as a stream: it holds one batch and no range.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.boundaries import PATTERN
from hopweave.llm.common import slices, texts

DIMS, BITS, BUCKETS = 3, 14, 256
RANGE_BYTES = 32_000_000  # of text in one range, about


# ---------------------------------------------------------------- the curve


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) below 2**bits.

    From the highest bit down each coordinate undoes the curve's reflection or
    exchange of axes; the Gray code of the result, bits interleaved, is the index.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            turned = (x[i] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, level = np.zeros_like(x[0]), 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b) & 1
    return out


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMS))


def curve_keys(texts_: list[bytes], ids: list) -> np.ndarray:
    """Sort keys: Hilbert index of the hashed vector, then a hash of the id."""
    vectors = np.zeros((len(texts_), BUCKETS))
    for row, text in zip(vectors, texts_):
        b = np.frombuffer(text, np.uint8)
        if len(b) > 1:
            row += np.bincount(b[:-1] * np.uint8(31) + b[1:], minlength=BUCKETS)
    vectors = np.sqrt(vectors)  # frequent pairs count less
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    spots = vectors @ _projection()
    # The projection of a unit vector is standard normal; tanh makes it bounded.
    grid = np.clip(((np.tanh(spots) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    tail = 63 - DIMS * BITS
    salt = np.array([(-1 if i is None else i) & (1 << 63) - 1 for i in ids], np.uint64)
    with np.errstate(over="ignore"):
        salt = (salt ^ (salt >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - tail)
    return hilbert_index(grid, BITS) << tail | salt.astype(np.int64)


# ------------------------------------------------------------------ tokens


def _printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable
    ones stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(vocabulary: str):
    """The ids of a byte-level BPE file, computed by tiktoken: for vocabularies
    numbered in merge order it gives the ids that the file's own library gives,
    in a quarter of the time.  The file's added tokens are taken as tokens wherever
    their strings stand in a text, as the library does."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], file.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        raise ValueError(f"{vocabulary}: added tokens take neighbouring characters")
    byte, vocab = _printable_bytes(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocab[a + b] for a, b in pairs]
    if merged != sorted(merged):
        raise ValueError(f"{vocabulary}: ids do not follow the order of merges")
    known = {c for c, b in byte.items()} | {a + b for a, b in pairs}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t in known}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


# ----------------------------------------------------------------- packing


def _tail_lengths(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(
    spark: SparkSession, docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null or empty text: only ``end_id``.  Repeated rows are packed as often as
    they occur.  An empty table gives no rows.  ``doc_id`` must be an integer
    column (nulls allowed).  ``sequence_id`` is the range's number times 2**32
    plus the sequence's number in it, so it follows the curve.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    docs = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def keys(batches):
        for batch in batches:
            for part in slices(batch):
                whole = [x.encode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(curve_keys(whole, part.column(0).to_pylist())), pa.array(list(map(len, whole)), pa.int64())], ["key", "n_bytes"]
                )

    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Keys of equal rank in count: lengths average out over a range.
    fine = max(at_least, 2)
    keyed = docs.mapInArrow(keys, "key long, n_bytes long")
    seen = keyed.agg(
        F.sum("n_bytes").alias("n"), F.percentile_approx("key", [i / fine for i in range(1, fine)], 20 * fine).alias("bounds")
    ).first()
    bounds, ranges = seen["bounds"] or [], fine
    if (seen["n"] or 0) > RANGE_BYTES * fine:  # more ranges than the session's partitions
        ranges = -(-seen["n"] // RANGE_BYTES)
        bounds = keyed.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    bounds = np.array(sorted(set(bounds)), np.int64)

    def tokens(batches):
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            for part in slices(batch):
                ids, whole = part.column(0).to_pylist(), part.column(1).to_pylist()
                key = curve_keys([x.encode() for x in whole], ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.searchsorted(bounds, key, "right").astype(np.int32)),
                        pa.array(key),
                        part.column(0),
                        # 16 bits hold the ids of all vocabularies below 65,536; others need 32
                        pa.array([_narrow(np.append(encode(x, allowed_special="all"), end_id)) for x in whole], pa.binary()),
                    ],
                    ["range", "key", "doc_id", "tokens"],
                )

    def cut(batches):
        yield from _cut(batches, length)

    return (
        docs.mapInArrow(tokens, "range int, key long, doc_id long, tokens binary")
        .repartitionById(len(bounds) + 1, F.col("range"))
        .sortWithinPartitions("key", "doc_id", "tokens")
        .select("range", "doc_id", "tokens")
        .mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    )


def _narrow(ids: np.ndarray) -> bytes:
    """A leading byte 2 or 4 tells the width."""
    if ids.max(initial=0) < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + ids.astype("<u4").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype("<u4")


def _cut(batches, length: int):
    """Cut one range's stream every ``length`` ids.  The pieces of the sequence
    that is still open are held back: they may turn out to be the tail."""
    held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
    filled = number = top = 0

    def close(size: int, pieces: list[tuple]):
        """Emit a sequence of ``size`` ids from the front of ``pieces``."""
        nonlocal number
        rows, offset = [], 0
        while offset < size:
            doc, start, ids, total = pieces.pop(0)
            take = min(len(ids), size - offset)
            rows.append((doc, start, take, ids[:take].tobytes(), total, top << 32 | number, offset))
            if take < len(ids):
                pieces.insert(0, (doc, start + take, ids[take:], total))
            offset += take
        number += 1
        return rows

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        rows, size = [], 0
        for place, doc, packed in zip(*(c.to_pylist() for c in batch.columns)):
            top, ids = place, _wide(packed)
            held.append((doc, 0, ids, len(ids)))
            filled += len(ids)
            while filled >= length:
                rows += close(length, held)
                filled -= length
                size += length
            if size > 1_000_000:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)
    if filled:
        yield batch_of([r for n in _tail_lengths(filled) for r in close(n, held)])


def piece_digests(packed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
