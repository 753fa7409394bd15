"""Operator 4: n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles.  Two documents link when
intersection / union >= 3/4.  The result is exact: per document the size of its
set and the smallest doc_id reachable by links.

Shingles are put in one global order, rarest first.  If x and y link, their
first l shared shingles lie in the first |x| - o + l of x and |y| - o + l of y,
o being the overlap that their sizes need.  l is chosen per document: where the
shingles of its prefix are frequent, a longer prefix is estimated to cost less,
because a pair must then share as many shingles of it (the smallest of both l and
the overlap that their sizes need) before it is verified.

1. Per chunk of texts, shingles are hashed by numpy to 64 bits and sent to
   buckets by hash, packed in ten bytes with their document; a shingle that many
   documents of a chunk have is sent once with its count.  Buckets return the
   document frequency of shingles that at least two documents have.
2. A shingle of one document is in no intersection, so the returned shingles are
   all that linking needs.  Documents with too few of them cannot link and are
   done; the others are landed with theirs.
3. Equal sets collapse to one representative.  Representatives post their
   prefixes for l = 1 to lists by (shingle, size class): linked ones must meet in
   one of them.  Pairs that meet are joined with the lengthened prefixes, and only
   pairs with l shared shingles there are verified, that is, joined with the sets.
4. Lists are worked off without emitting all pairs: the documents of a list that
   are not in the component of its most central document are verified against
   it, links are merged to components, and what is left is repeated with more
   central documents, until every pair of a list is verified or connected.
   Short lists verify their remaining pairs at once.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.llm.common import FRUGAL, discard, land, release, settings, slices, texts, trim

WORDS = 5
NUM, DEN = 3, 4  # similarity threshold
CHUNK = 3_000_000  # bytes of text whose shingles are packed together
BUCKET_BYTES = 24_000_000  # of packed shingles in one bucket, about
SHARED_IN_CHUNK = 8  # documents of a chunk from which a shingle is sent once
LONGEST_MATCH = 6  # largest l
TASK_BYTES = 128_000_000  # of text whose profiles or posts one task writes, at least a task for each core
VERIFY = 4.0  # cost of a verification in list entries
SHORT_LIST = 24
BROADCAST_ROWS = 100_000
LONG_WORD = 32  # bytes; longer words are hashed one by one
BLOCK = 1 << 18  # bytes whose words are hashed together

U = np.uint64


# ---------------------------------------------------------------- hashing


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(32))


@lru_cache(1)
def _tables():
    rng = np.random.default_rng(54321)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    weights = rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * U(2) + U(1)
    return values[fold], blank, base, inverse, weights


@lru_cache(1)
def _powers(n: int):
    _, _, base, inverse, _ = _tables()
    ones = np.full(n, U(base)), np.full(n, U(inverse))
    ones[0][0] = ones[1][0] = U(1)
    return np.cumprod(ones[0]), np.cumprod(ones[1])


def _words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, block by block: they do not depend on where a word lies.  Of
    longer words than LONG_WORD only the first bytes and the length count."""
    values, _, _, _, weights = _tables()
    power, inverse = _powers(BLOCK + LONG_WORD)  # a block and a word that begins in it
    word = np.empty(len(starts), np.uint64)
    cut = np.searchsorted(starts, np.arange(0, len(b) + BLOCK, BLOCK)).tolist()
    for block, (i, j) in enumerate(zip(cut, cut[1:])):
        if i == j:
            continue
        at = block * BLOCK
        own = b[at : at + BLOCK + LONG_WORD]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(values[own] * power[: len(own)], out=total[1:])
        first = starts[i:j] - at
        last = np.minimum(ends[i:j] - at, first + LONG_WORD)
        word[i:j] = (total[last] - total[first]) * inverse[first]
    return _mix(word + (ends - starts).astype(np.uint64) * weights[WORDS])


def shingle_sets(whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, text after text, and each
    text's number of them.  A-Z count as a-z; words are separated by white space;
    fewer than five words: their sequence is the one shingle; none: no shingle.
    """
    _, blank, _, _, weights = _tables()
    data = b" ".join(whole) + b" "
    b = np.frombuffer(data, np.uint8)
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    doc_at = np.cumsum(lengths + 1) - (lengths + 1)
    gap = np.empty(len(b) + 1, bool)
    gap[0], gap[1:] = True, blank[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[0::2], edge[1::2]
    word = _words(b, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        folded = data[starts[i] : ends[i]].translate(_lower())
        word[i] = int.from_bytes(blake2b(folded, digest_size=8).digest(), "little")
    first = np.append(np.searchsorted(starts, doc_at), len(starts))
    n_words = np.diff(first)
    # full shingles
    full = np.maximum(n_words - WORDS + 1, 0)
    doc_of = np.repeat(np.arange(len(whole)), full)
    begin = np.repeat(first[:-1] - (np.cumsum(full) - full), full) + np.arange(len(doc_of))
    h = np.zeros(len(begin), np.uint64)
    for j in range(WORDS):
        h += word[begin + j] * weights[j]
    # short texts
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    extra = np.zeros(len(short), np.uint64)
    for j in range(WORDS - 1):
        has = n_words[short] > j
        extra[has] += word[first[short[has]] + j] * weights[j]
    extra += n_words[short].astype(np.uint64) * weights[WORDS]
    key, doc = _mix(np.concatenate([h, extra])), np.concatenate([doc_of, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    if len(key):
        fresh = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
        key, doc = key[fresh], doc[fresh]
    return key, np.bincount(doc, minlength=len(whole))


@lru_cache(1)
def _lower() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _set_digests(key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits per document that only depend on its set."""
    at = np.append(0, np.cumsum(sizes))
    out = np.zeros((len(sizes), 2), np.uint64)
    for i, salt in enumerate((U(0x5851F42D4C957F2D), U(0x14057B7EF767814F))):
        sums = np.append(U(0), np.cumsum(_mix(key * U(2) + salt) ^ (_mix(key + salt) << U(1))))
        out[:, i] = sums[at[1:]] - sums[at[:-1]]
    return out


# --------------------------------------------- frequencies, packed by chunk

PACKED = "bucket int, chunk long, kind int, a binary, b binary, ids array<bigint>"
SETS, SHINGLES, COUNTED, SHARED, FOUND, FOUND_SHARED = range(6)


def _rows(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))],
        ["bucket", "chunk", "kind", "a", "b", "ids"],
    )


def _heads_of(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _trimmed(run):
    """``run`` over a task's batches, whose worker keeps little when it is done."""

    def batchwise(batches):
        yield from run(batches)
        trim()

    return batchwise


def _pack(buckets: int):
    def run(batches):
        # 2**23 partitions of 2**24 chunks of 2**16 rows.
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, most=CHUNK):
                ids = part.column(0).to_pylist()
                key, sizes = shingle_sets([x.encode() for x in part.column(1).to_pylist()])
                own = int(number % buckets)
                out = [(own, number, SETS, sizes.astype("<u4").tobytes(), _set_digests(key, sizes).tobytes(), ids)]
                doc = np.repeat(np.arange(len(ids), dtype="<u2"), sizes)
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                head = _heads_of(key)
                count = np.diff(np.append(head, len(key)))
                often = count >= SHARED_IN_CHUNK
                shared = np.repeat(often, count)
                if often.any():
                    out.append((own, number, SHARED, key[shared].tobytes(), doc[shared].tobytes(), None))
                cut_at = lambda x: np.searchsorted((x >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1)).tolist()
                for kind, keys, more in ((SHINGLES, key[~shared], doc[~shared]), (COUNTED, key[head[often]], count[often].astype("<u2"))):
                    cut = cut_at(keys)
                    out += [(i, number, kind, keys[a:b].tobytes(), more[a:b].tobytes(), None) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                yield _rows(out)
                number += 1

    return run


def _count(batches):
    """One bucket: pass on what belongs to chunks, return frequencies over 1."""
    held = []
    for batch in batches:
        rows = batch.to_pylist()
        passed = [tuple(r.values()) for r in rows if r["kind"] not in (SHINGLES, COUNTED)]
        held += [(r["chunk"], r["kind"], r["a"], r["b"]) for r in rows if r["kind"] in (SHINGLES, COUNTED)]
        if passed:
            yield _rows(passed)
    if not held:
        return
    single = np.concatenate([np.frombuffer(a, np.uint64) for _, kind, a, _ in held if kind == SHINGLES] or [np.zeros(0, np.uint64)])
    single.sort()
    head = _heads_of(single)
    many = np.concatenate([np.frombuffer(a, np.uint64) for _, kind, a, _ in held if kind == COUNTED] or [np.zeros(0, np.uint64)])
    often = np.concatenate([np.frombuffer(b, "<u2") for _, kind, _, b in held if kind == COUNTED] or [np.zeros(0, "<u2")])
    keys, at = np.unique(np.concatenate([single[head], many]), return_inverse=True)
    df = np.bincount(at, np.concatenate([np.diff(np.append(head, len(single))), often.astype(np.int64)]), len(keys)).astype(np.int64)
    del single, head, many, often, at
    keys, df = keys[df > 1], np.minimum(df[df > 1], (1 << 32) - 1).astype("<u4")
    if not len(keys):
        return
    out, size = [], 0
    for chunk, kind, a, b in held:
        entries = np.frombuffer(a, np.uint64)
        at = np.minimum(np.searchsorted(keys, entries), len(keys) - 1)
        known = keys[at] == entries
        if not known.any():
            continue
        entries, found = entries[known], df[at[known]]
        if kind == SHINGLES:  # with each entry's document and frequency
            more = np.frombuffer(b, "<u2")[known].tobytes() + found.tobytes()
            out.append((0, chunk, FOUND, entries.tobytes(), more, None))
        else:
            out.append((0, chunk, FOUND_SHARED, entries.tobytes(), found.tobytes(), None))
        size += 14 * len(entries)
        if size > 2_000_000:
            yield _rows(out)
            out, size = [], 0
    if out:
        yield _rows(out)


# ---------------------------------------------------------------- prefixes


@lru_cache(1)
def size_classes() -> np.ndarray:
    """Least set size of each class; classes grow by about a twentieth."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 21 // 20))
    return np.array(out)


def needed(x: int, y: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-NUM * (x + y) // (NUM + DEN))


def choose_l(n: int, unique: int, df: np.ndarray) -> int:
    """The l of least estimated cost: entries read from the lists of the prefix,
    and verifications of the documents that may be met l times in them."""
    best, cost = 1, None
    ahead = np.append(0.0, np.cumsum(df - 1.0))
    for length in range(1, LONGEST_MATCH + 1):
        k = min(max(n - -(-NUM * n // DEN) + length - unique, 0), len(df))
        c = ahead[k] * (1 + VERIFY / length)
        if cost is None or c < cost:
            best, cost = length, c
    return best


PROFILE = (
    "row long, doc_id long, n long, hi long, lo long, l int, wide int, score double, keys array<bigint>, "
    "posts array<struct<class:int,used:int,indexed:int>>"
)


def _profile(table: pa.Table) -> pa.Table:
    """All documents of one chunk."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == SETS)
    ids, sizes = own["ids"], np.frombuffer(own["a"], "<u4").astype(np.int64)
    digests = np.frombuffer(own["b"], np.int64).reshape(-1, 2)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, "<u2"), np.zeros(0, "<u4"))]
    for r in rows:
        if r["kind"] == FOUND:
            n = len(r["a"]) // 8
            parts.append((np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], "<u2", n), np.frombuffer(r["b"], "<u4", n, 2 * n)))
    often = [(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], "<u4")) for r in rows if r["kind"] == FOUND_SHARED]
    if often:  # put their documents back
        keys, of = np.concatenate([k for k, _ in often]), np.concatenate([d for _, d in often])
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        for r in rows:
            if r["kind"] == SHARED:
                put = np.frombuffer(r["a"], np.uint64)
                parts.append((put, np.frombuffer(r["b"], "<u2"), of[np.searchsorted(keys, put)]))
    key, doc, df = (np.concatenate(x) for x in zip(*parts))
    key, doc, df = key.view(np.int64), doc.astype(np.int64), df.astype(np.int64)
    order = np.lexsort((key, df, doc))
    doc, key, df = doc[order], key[order], df[order]
    cut = np.searchsorted(doc, np.arange(len(ids) + 1))
    bounds = size_classes()
    out = []
    for i, (doc_id, n) in enumerate(zip(ids, sizes.tolist())):
        k, d = key[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]]
        unique = n - len(k)
        length, wide, score, keys, posts = 1, 0, 0.0, None, None
        if n and len(k) >= -(-NUM * n // DEN):  # else no other set can overlap enough
            length, score, posts = choose_l(n, unique, d), float(d.sum()), []
            home, least = int(np.searchsorted(bounds, n, "right")) - 1, -(-NUM * n // DEN)
            # A post is due only where the returned shingles can make the overlap.
            reach = lambda o, l=1: min(max(n - o + l - unique, 0), len(k)) if len(k) >= o else 0
            wide = reach(needed(n, least), length)
            for c in range(int(np.searchsorted(bounds, least, "right")) - 1, home + 1):
                used = reach(needed(n, max(least, int(bounds[c]))))
                if used:
                    posts.append({"class": c, "used": used, "indexed": reach(needed(n, n)) if c == home else 0})
            keys = k
        out.append((own["chunk"] << 16 | i, doc_id, n, int(digests[i, 0]), int(digests[i, 1]), length, wide, score, keys if posts else None, posts or None))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()),
             pa.list_(pa.struct([("class", pa.int32()), ("used", pa.int32()), ("indexed", pa.int32())]))]
    names = ["row", "doc_id", "n", "hi", "lo", "l", "wide", "score", "keys", "posts"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _trimmed_profile(table: pa.Table) -> pa.Table:
    try:
        return _profile(table)
    finally:
        trim()


def profiles(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Landed profiles, and the number of tasks for tables of their size."""
    docs = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A word of six bytes is a shingle of ten.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 5 // 3 // BUCKET_BYTES), 1)
    counted = docs.mapInArrow(_trimmed(_pack(buckets)), PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(_trimmed(_count), PACKED)
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return land(spark, counted.groupBy("chunk").applyInArrow(_trimmed_profile, PROFILE).coalesce(tasks), "ngram-profiles"), tasks


# ------------------------------------------------------------- components


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _hang(edges: DataFrame) -> DataFrame:
    """Both star operations on edges (u, v), v < u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, comp (smallest node of the component) of all nodes that link to a
    smaller one, from pairs (a, b).

    Star operations hang every node's larger neighbours, then its smaller ones
    and itself, on the least node it knows, which about halves the depth.  They
    are repeated until each node has one edge, to a node without one: a star for
    each component.  No component is ever in one place.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = land(spark, edges, "ngram-edges", True)
    while True:
        after = land(spark, _hang(edges), "ngram-edges", True)
        discard(spark, edges)
        edges = after
        several = edges.groupBy("u").count().where("count > 1").select("u")
        deep = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if several.unionByName(deep).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


# ------------------------------------------------------------------ links


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), which have met in a list, with ``met``: whether they share
    as many shingles of their lengthened prefixes as the smaller l of the two, or as
    the overlap that their sizes need where that is less.  Only prefixes move."""
    side = lambda x: sets.select(F.col("row").alias(x), F.col("n").alias(f"{x}_n"), F.col("l").alias(f"{x}_l"), F.slice("keys", F.lit(1), F.col("wide")).alias(f"{x}_prefix"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    due = F.call_function("div", NUM * (F.col("a_n") + F.col("b_n")) + NUM + DEN - 1, F.lit(NUM + DEN))  # as ``needed``
    met = F.size(F.array_intersect("a_prefix", "b_prefix")) >= F.least(F.col("a_l").cast("long"), F.col("b_l").cast("long"), due)
    return both.select("a", "b", "a_n", "b_n", met.alias("met"))


def _verified(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with ``linked`` and ``shared``, the overlap, which is null where the
    prefixes rule the pair out: such pairs never meet with their sets.

    Shingles of one document only are missing from ``keys`` and cannot be shared, so
    the overlap is that of the keys.
    """
    side = lambda x: sets.select(F.col("row").alias(x), F.col("keys").alias(f"{x}_keys"))
    both = met.where("met").join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("a_keys", "b_keys")).cast("long")
    both = both.select("a", "b", "a_n", "b_n", shared.alias("shared"))
    linked = DEN * F.col("shared") >= NUM * (F.col("a_n") + F.col("b_n") - F.col("shared"))
    rest = met.where("not met").select("a", "b", F.lit(False).alias("linked"), F.lit(None).cast("long").alias("shared"))
    return both.select("a", "b", linked.alias("linked"), "shared").unionByName(rest)


def _heads(posted: DataFrame, pivots: int) -> DataFrame:
    """The documents of each list that the others are verified against: at first
    the most central one, later more, and all of a short list."""
    if pivots == 1:
        top = F.max(F.struct("score", F.bitwise_not("row").alias("low"), "n", "k", "comp", "over", "at"))
        return posted.where("indexed").groupBy("key", "class").agg(top.alias("x")).select(
            "key", "class", F.bitwise_not("x.low").alias("head"), F.col("x.n").alias("head_n"), F.col("x.k").alias("head_k"), F.col("x.comp").alias("head_comp"), F.col("x.over").alias("head_over"), F.col("x.at").alias("head_at")
        )
    # Ranks of long lists are taken among the best of each task first.
    rank = F.row_number().over(Window.partitionBy("key", "class").orderBy(F.desc("score"), "row"))
    best = posted.where("indexed").where(F.col("m") > SHORT_LIST).withColumn("rank", rank).where(F.col("rank") <= pivots).drop("rank")
    heads = best.unionByName(posted.where("indexed").where(F.col("m") <= SHORT_LIST))
    return heads.select("key", "class", F.col("row").alias("head"), F.col("n").alias("head_n"), F.col("k").alias("head_k"), F.col("comp").alias("head_comp"), F.col("over").alias("head_over"), F.col("at").alias("head_at"))


def link_components(spark: SparkSession, sets: DataFrame, tasks: int) -> DataFrame:
    """node, comp as ``components``, of sets that link; see the module's text, 4."""
    posted = sets.select("row", "n", F.size("keys").alias("k"), "score", "keys", F.explode("posts").alias("p")).select(
        "row", "n", "k", "score", F.col("p.class").alias("class"), F.col("p.indexed").alias("last"), F.posexplode(F.slice("keys", F.lit(1), F.col("p.used"))).alias("at", "key")
    )
    posted = posted.select("key", "class", "row", "n", "k", "at", "score", (F.col("at") < F.col("last")).alias("indexed"), F.col("row").alias("comp"), F.lit(None).cast("long").alias("over")).repartition("key", "class")
    lists = posted.groupBy("key", "class").agg(F.count(F.lit(1)).alias("m"), F.max("indexed").alias("any")).where("m > 1 AND any").drop("any")
    posted = land(spark, posted.join(lists, ["key", "class"]).coalesce(tasks), "ngram-posted")
    comp, done, pivots = None, None, 1
    while not posted.isEmpty():
        heads = _heads(posted, pivots)
        # The overlap that two sizes need must fit in both sets' shared shingles.
        # Those are inside or outside of the list's first head, whose overlaps
        # with both are known after the first round; and they stand before, at
        # or behind the list's shingle in both sets' orders.
        inside = F.least("over", "head_over") + F.least(F.col("k") - F.col("over"), F.col("head_k") - F.col("head_over"))
        inside = F.when(F.col("over").isNotNull() & F.col("head_over").isNotNull(), inside)
        ordered = F.least("at", "head_at") + 1 + F.least(F.col("k") - F.col("at"), F.col("head_k") - F.col("head_at")) - 1
        most = F.least(ordered, F.coalesce(inside, F.least("k", "head_k")))
        fit = NUM * (F.col("n") + F.col("head_n")) <= (NUM + DEN) * most
        pairs = posted.join(heads, ["key", "class"]).where((F.col("comp") != F.col("head_comp")) & (fit | F.lit(pivots == 1)))
        pairs = pairs.select(F.least("row", "head").alias("a"), F.greatest("row", "head").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        met = land(spark, _met(pairs, sets), "ngram-met", True)
        pairs = land(spark, _verified(met, sets), "ngram-pairs", True)
        discard(spark, met)
        done = pairs if done is None else done.unionByName(pairs)
        comp = components(spark, done.where("linked"))
        # What is left: lists whose documents that were no head are in several
        # components, one of them in the list by its shorter prefix.
        rest = posted.drop("comp", "m").join(heads.select("key", "class", F.col("head").alias("row")), ["key", "class", "row"], "left_anti")
        rest = rest.join(_small(comp.withColumnRenamed("node", "row"), comp.count()), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
        several = rest.groupBy("key", "class").agg(
            F.count(F.lit(1)).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("indexed").alias("any")
        ).where("c0 != c1 AND any").select("key", "class", "m")
        rest = rest.join(several, ["key", "class"])
        if pivots == 1:
            first = heads.select("key", "class", "head")
            overs = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "shared")
            rest = rest.drop("over").join(first, ["key", "class"]).withColumn("x", F.least("row", "head")).withColumn("y", F.greatest("row", "head"))
            rest = rest.join(overs, ["x", "y"], "left").withColumnRenamed("shared", "over").drop("x", "y", "head")
        left = land(spark, rest, "ngram-posted", True)
        discard(spark, posted)
        posted, pivots = left, pivots * 16
        release(spark)
    return spark.createDataFrame([], "node long, comp long") if comp is None else comp


def join_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_copies.

    ``n_copies`` is the number of rows with the same set.  A text that is null or
    has no words has no shingles and is its own component.  A null doc_id takes
    part but never names a component unless all ids of it are null.  Rows that
    repeat a doc_id are separate documents.  An empty table gives no rows.
    """
    with settings(spark, FRUGAL):
        profile, tasks = profiles(spark, docs, id_col, text_col)
        rows = profile.where("n > 0").select("row", "doc_id", "hi", "lo")
        # Equal sets: one representative each.
        same = rows.groupBy("hi", "lo").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        copied = same.where("copies > 1").select("hi", "lo", "rep")
        sets = profile.where("posts IS NOT NULL").join(_small(copied, copied.count()), ["hi", "lo"], "left").where("rep IS NULL OR rep = row")
        release(spark)
        comp = link_components(spark, sets.select("row", "n", "l", "wide", "score", "keys", "posts"), tasks)
        # Only sets that repeat or link need a name.
        same = same.join(_small(comp.withColumnRenamed("node", "rep"), comp.count()), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        groups = same.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1")
        named = land(spark, same.join(groups, "comp").select("hi", "lo", "component_id", "copies"), "ngram-named", True)
    found = profile.select("row", "doc_id", "n", "hi", "lo").join(_small(named, named.count()), ["hi", "lo"], "left")
    inside = (F.col("n") > 0) & F.col("copies").isNotNull()
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(inside, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(inside, F.col("copies")).otherwise(1).alias("n_copies"),
    )


def labelled(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return join_components(spark, docs).select("doc_id", "n_shingles", "component_id")
