"""Operators 4 and 7 against the libraries they stand for."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import token_cache
from corvane.llm.packing import Bins, pack, token_ids
from corvane.session import scratch_path

PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def key(x):
    return (x[0] is None, x)


def test_counts(spark, odd, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for df in (odd, docs):
        cache = scratch_path(spark, "test-cache")
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        want = sorted(((i, len(t.encode()), len(sp.encode(t))) for i, t in rows), key=str)
        got = token_cache.count_tokens(df, PIECE, cache).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t for _, t in rows})
        again = token_cache.count_tokens(df, PIECE, cache)  # every content is known
        assert sorted((tuple(r) for r in again.collect()), key=str) == want
        assert spark.read.parquet(cache).count() == stored.count()


def test_counts_empty(spark, empty):
    assert token_cache.count_tokens(empty, PIECE, scratch_path(spark, "test-cache")).count() == 0


def test_version_changes_with_file():
    assert token_cache.tokenizer_version(PIECE) != token_cache.tokenizer_version(BYTE)


def test_ids_equal_the_library(docs, odd):
    tok = Tokenizer.from_file(BYTE)
    ids = token_ids(BYTE)
    for r in [*docs.collect(), *odd.collect()]:
        t = r.text or ""
        assert ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    ids = token_ids(BYTE)
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(np.append(ids(r.text or ""), np.uint32(1)))
    rows = pack(df, BYTE).collect()
    seqs, found = defaultdict(list), defaultdict(int)
    for r in rows:
        seqs[r.sequence_id].append(r)
        whole = [w for w in texts[r.id] if len(w) == r.doc_tokens and r.start + r.length <= len(w)
                 and zlib.crc32(w[r.start:r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32]
        assert whole
        found[r.id] += r.length
    assert {k: sum(map(len, v)) for k, v in texts.items()} == dict(found)
    padding = total = 0
    for held in seqs.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * total


def test_packing_empty(empty):
    assert pack(empty, BYTE).count() == 0


def test_cuts_cover_every_length():
    b = Bins(2048, 0)
    for n in range(1, 5000):
        cuts = b.cuts(n)
        assert sum(cuts) == n and len([c for c in cuts if c < 64]) <= 1


def test_class_bins_hold_a_fixed_count():
    b = Bins(2048, 3)
    out = [p for i in range(100) for p in b.put(i, np.ones(63, np.uint32))]
    assert [len([p for p in out if p[5] == s]) for s in sorted({p[5] for p in out})] == [32, 32, 32]
    rest = list(b.close())
    assert sorted({sum(p[2] for p in rest if p[5] == s) for s in {p[5] for p in rest}}) == [4, 8, 16, 32, 64, 128]
