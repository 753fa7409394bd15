"""Operator 2: byte-level BPE encoding and decoding.

``boundaries`` cuts the texts into pre-tokens; each slice is looked up in a
cache of finished merges, and only a new slice runs pair merging.  The encoder
keeps the byte offset of every pre-token and the number of ids before it, so
any byte range can be decoded without decoding what precedes it.

Nothing is shuffled: a task reads its rows and writes its rows.  Memory per
task: the slice of the batch at hand (see ``common.slices``) and a cache of at
most ``CACHE`` pre-tokens, emptied when full.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.boundaries import pieces
from hopweave.llm.common import slices, texts

CACHE = 250_000
LONG = 120  # bytes; longer pre-tokens merge with a heap


class Merger(dict):
    """bytes -> little-endian unsigned 32-bit ids.  A missing key is merged."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.size = 1 + max(ranks.values())
        self.token = [b""] * self.size
        for t, r in ranks.items():
            self.token[r] = t
        self.pair: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        """Rank of the merge of two ids; self.size where there is none."""
        key = a * self.size + b
        found = self.pair.get(key)
        if found is None:
            found = self.ranks.get(self.token[a] + self.token[b], self.size)
            if len(self.pair) >= CACHE:
                self.pair.clear()
            self.pair[key] = found
        return found

    def __missing__(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        ids = [whole] if whole is not None else self.merge(piece)
        if len(self) >= CACHE:
            self.clear()
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= LONG:
            self[piece] = packed
        return packed

    def merge(self, piece: bytes) -> list[int]:
        if len(piece) > LONG:
            return self.merge_long(piece)
        ids, none, rank = [self.byte[b] for b in piece], self.size, self.rank
        ranks = [rank(a, b) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(best, ids[i + 1])
            if i:
                ranks[i - 1] = rank(ids[i - 1], best)
        return ids

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges in the same order, in O(n log n)."""
        n, none = len(piece), self.size
        ids = [self.byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank(ids[i], ids[i + 1])) < none]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := self.rank(r, ids[k])) < none:
                    heappush(heap, (s, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (s := self.rank(ids[h], r)) < none:
                heappush(heap, (s, h, ids[h], r))
        return [x for x in ids if x >= 0]


@lru_cache(4)
def merger(path: str) -> Merger:
    """One per Python worker and file, kept from task to task."""
    with open(path, "rb") as lines:
        return Merger({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian
    unsigned 32-bit), piece_bytes and piece_ids (binary, the same layout:
    cumulative bytes and ids before each pre-token, and their totals).

    Null or empty text: no ids, offsets of one 0 each.  ``ranks`` is the path of
    a rank file that every executor can open.
    """
    docs = texts(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = merger(ranks)
        get = known.__getitem__
        for batch in batches:
            for part in slices(batch):
                data, at, heads = pieces(part.column(1))
                ends = at.tolist()
                ids = list(map(get, [data[a:b] for a, b in zip(ends, ends[1:])]))
                counts = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, out=counts[1:])
                bounds = heads.tolist()
                spans = list(zip(bounds, bounds[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([int(counts[b] - counts[a]) for a, b in spans], pa.int64()),
                        pa.array([b"".join(ids[a:b]) for a, b in spans], pa.binary()),
                        pa.array([(at[a : b + 1] - at[a]).astype("<u4").tobytes() for a, b in spans], pa.binary()),
                        pa.array([(counts[a : b + 1] - counts[a]).astype("<u4").tobytes() for a, b in spans], pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids", "piece_bytes", "piece_ids"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, piece_bytes binary, piece_ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds ``decoded`` (binary) to what ``encode`` returned."""
    kept = encoded.select("doc_id", "n_tokens", "ids")
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches):
        token = merger(ranks).token
        for batch in batches:
            for part in slices(batch, 2):
                out = [b"".join([token[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return kept.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def decode_range(ids: bytes, piece_bytes: bytes, piece_ids: bytes, begin: int, end: int, ranks: str) -> bytes:
    """Bytes [begin, end) of one document: only the pre-tokens that overlap the
    range are decoded."""
    at, count, ids = (np.frombuffer(x, "<u4") for x in (piece_bytes, piece_ids, ids))
    end = min(end, int(at[-1]))
    if begin >= end:
        return b""
    i, j = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, end, "left"))
    token = merger(ranks).token
    return b"".join(token[x] for x in ids[count[i] : count[j]].tolist())[begin - int(at[i]) : end - int(at[i])]


def round_trip_digests(docs: DataFrame, ranks: str) -> DataFrame:
    """The contract's columns: encode, decode what was encoded, digest both."""
    return decode(encode(docs, ranks), ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
