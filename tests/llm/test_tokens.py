import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from hopweave.llm import boundaries, bytepair, packing, tokencount
from hopweave.llm.common import documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_boundaries_against_pattern():
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(2)
    alphabet = [*"ab's tmdrvel1 9\n\t '.é中", "'s", "'re", "'ll", "'ve", "  ", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    data, at, heads = boundaries.pieces(pa.array(texts))
    got = [data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    for text, a, b in zip(texts, heads[:-1], heads[1:]):
        assert got[a:b] == pattern.findall(text), repr(text)


def test_boundaries_of_long_text_cross_blocks():
    import regex

    rng = random.Random(4)
    text = "".join(rng.choice(["it's ", "a", " ", "\n", "'", "9", "é", "..."]) for _ in range(5000))
    data, at, _ = boundaries.pieces(pa.array([text]))
    assert [data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())] == regex.findall(public_tokenizers.PATTERN, text)


def test_encode_as_the_library_and_decode(spark, tricky, sf):
    e = library()
    for docs in (tricky, documents(spark, sf)):
        want = sorted((r.doc_id or -1, e.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
        out = bytepair.decode(bytepair.encode(docs, RANKS), RANKS).collect()
        got = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in out)
        assert got == want


def test_digests_and_ranges(tricky, nothing):
    e = library()
    for r in bytepair.round_trip_digests(tricky, RANKS).where("doc_id IN (8, 5)").collect():
        text = next(t.text or "" for t in tricky.collect() if t.doc_id == r.doc_id)
        ids = np.array(e.encode_ordinary(text), "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    r = bytepair.encode(tricky, RANKS).where("doc_id = 8").first()
    text = next(t.text for t in tricky.collect() if t.doc_id == 8).encode()
    for a, b in ((0, 5), (7, 30), (20, 10_000), (9, 9)):
        assert bytepair.decode_range(r.ids, r.piece_bytes, r.piece_ids, a, b, RANKS) == text[a:b]
    assert bytepair.round_trip_digests(nothing, RANKS).count() == 0


def test_token_counts_against_all_segmentations(spark, tricky, nothing):
    scores = {b"a": -3, b"b": -4, b"ab": -5, b"ba": -9, b"aba": -8, b"bb": -8}
    trie = tokencount.Trie(scores)

    def best(word):
        if not word:
            return (0, 0)
        options = [(s + scores[word[:n]], -(-c) + 1) for n in range(1, len(word) + 1) if word[:n] in scores for s, c in [best(word[n:])]]
        return max(options, key=lambda x: (x[0], -x[1]))

    rng = random.Random(1)
    for _ in range(300):
        word = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9)))
        assert trie[word] == best(word)[1], word
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = {r.doc_id: r for r in tokencount.count_tokens(tricky, ranks).collect()}
    assert len(rows) == 12 and rows[5][1:] == (0, 0, 0) and rows[1].n_tokens == rows[2].n_tokens > 0
    assert rows[10].n_bytes == 5000 and tokencount.count_tokens(nothing, ranks).count() == 0


def test_hilbert_curve_is_one_path():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = np.argsort(packing.hilbert_index(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_pack_keeps_every_id_once(spark, tricky, nothing, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    added = ["x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|", "<|endoftext|>\nthe end"]
    assert t.encode(added[0], add_special_tokens=False).ids == [87, 50256, 88]
    added = spark.createDataFrame(list(enumerate(added)), "doc_id long, text string")
    for docs in (tricky.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), documents(spark, sf), added):
        whole = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
        rows = packing.piece_digests(packing.pack(spark, docs, VOCABULARY, 256)).collect()
        at, sequences = {}, {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            ids = whole[r.doc_id]
            assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids) and r.length > 0
            at[r.doc_id] = r.start + r.length
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == {k: len(v) for k, v in whole.items()}
        for pieces in sequences.values():
            pieces.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0
            size = sum(n for _, n in pieces)
            assert size <= 256 and size & (size - 1) == 0
    # Null and repeated ids: as many ids as all rows together, each row's pieces whole.
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in tricky.collect())
    rows = packing.pack(spark, tricky, VOCABULARY, 256).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == want
    assert sum(r.length for r in rows) == sum(n * c for (_, n), c in want.items())
    assert packing.pack(spark, nothing, VOCABULARY).count() == 0
