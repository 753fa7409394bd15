"""Operator 1: token counts under a unigram model, by trie-shared dynamic programming.

The unigram segmentation of a pre-token is the sequence of vocabulary pieces
with the largest sum of log probabilities.  Its forward score at a position
depends only on the bytes before it, so all pre-tokens with a common prefix
share the scores of that prefix: distinct pre-tokens are inserted in a trie,
each trie node gets its forward score once, when it is made, and the node where
a pre-token ends keeps the number of pieces of its best segmentation.

Log probabilities are integers (micro-nats), so scores compare exactly; of equal
scores the segmentation with fewer pieces counts.  A rank file has no
probabilities: ``zipf_scores`` gives the piece of rank r the Zipf-Mandelbrot
weight 1 / (r + 2.7).  Any {bytes: score} that holds all 256 single bytes works.

Nothing is shuffled.  Memory per task: one slice of a batch, a trie of at most
``NODES`` nodes and as many remembered counts; both start anew when full, which
changes no result.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hopweave.llm.boundaries import pieces
from hopweave.llm.common import slices, texts

NODES = 300_000
LONG = 200  # bytes; the scores of longer pre-tokens are not kept in the trie


def zipf_scores(ranks: str) -> dict[bytes, int]:
    """Piece -> score in micro-nats, from the ranks of a vocabulary file."""
    with open(ranks, "rb") as lines:
        read = [(base64.b64decode(t), int(r)) for t, r in map(bytes.split, lines)]
    total = log(sum(1 / (r + 2.7) for _, r in read))
    return {t: -round(1e6 * (log(r + 2.7) + total)) for t, r in read}


class Trie(dict):
    """bytes -> number of pieces.  A missing pre-token is inserted."""

    def __init__(self, scores: dict[bytes, int]):
        super().__init__()
        self.scores = scores
        self.longest = max(map(len, scores))
        self.grow_anew()

    def grow_anew(self) -> None:
        # Node 0 is the root; child of node n by byte b is at edges[n << 8 | b].
        self.edges: dict[int, int] = {}
        self.score, self.count = [0], [0]

    def forward(self, piece: bytes, end: int, path_score, path_count) -> tuple[int, int]:
        """Best (score, pieces) of piece[:end] from those of its prefixes."""
        best, fewest, get = None, 0, self.scores.get
        for begin in range(max(0, end - self.longest), end):
            s = get(piece[begin:end])
            if s is not None:
                s += path_score[begin]
                n = path_count[begin] + 1
                if best is None or s > best or s == best and n < fewest:
                    best, fewest = s, n
        return best, fewest

    def __missing__(self, piece: bytes) -> int:
        if len(piece) > LONG:
            scores, counts = [0], [0]
            for end in range(1, len(piece) + 1):
                s, n = self.forward(piece, end, scores, counts)
                scores.append(s)
                counts.append(n)
            return counts[-1]
        if len(self.score) >= NODES:
            self.grow_anew()
        node, edges, scores, counts = 0, self.edges, [0], [0]
        for end, byte in enumerate(piece, 1):
            key = node << 8 | byte
            child = edges.get(key)
            if child is None:  # a new prefix: scored here, once
                s, n = self.forward(piece, end, scores, counts)
                child = edges[key] = len(self.score)
                self.score.append(s)
                self.count.append(n)
            node = child
            scores.append(self.score[node])
            counts.append(self.count[node])
        if len(self) >= NODES:
            self.clear()
        self[piece] = counts[-1]
        return counts[-1]


@lru_cache(4)
def trie(ranks: str) -> Trie:
    """One per Python worker and file, kept from task to task."""
    return Trie(zipf_scores(ranks))


def count_tokens(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pretokens, n_tokens (longs).

    Null or empty text: zeros.  Pre-tokens are those of ``boundaries``; ``ranks``
    is the path of a rank file that every executor can open.
    """
    docs = texts(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = trie(ranks).__getitem__
        for batch in batches:
            for part in slices(batch):
                data, at, heads = pieces(part.column(1))
                ends = at.tolist()
                sums = np.zeros(len(ends), np.int64)
                np.cumsum(np.fromiter(map(known, [data[a:b] for a, b in zip(ends, ends[1:])]), np.int64, len(ends) - 1), out=sums[1:])
                begin, end = heads[:-1], heads[1:]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x.astype(np.int64)) for x in (at[end] - at[begin], end - begin, sums[end] - sums[begin]))],
                    ["doc_id", "n_bytes", "n_pretokens", "n_tokens"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_pretokens long, n_tokens long")
