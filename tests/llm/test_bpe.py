"""Operator 6 against the library, and as a round trip."""

import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from corvane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_rows(odd, docs):
    for df in (odd, docs):
        want = sorted(((r.doc_id, np.array(LIB.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode())
                       for r in df.collect()), key=str)
        got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
        assert sorted(((r.id, bytes(r.ids), bytes(r.body)) for r in got), key=str) == want


def test_empty(empty):
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_long_words_equal_short_steps():
    rng = random.Random(3)
    c = bpe.codec(PATH, None)
    for size in (2, 5, 64, 65, 200, 700):
        for letters in ("a", "ab", "etaoin shr", "thequickon"):
            w = "".join(rng.choice(letters) for _ in range(size)).encode()
            want = LIB._encode_single_piece(w)
            assert list(c.contract_long(c.letter[np.frombuffer(w, np.uint8)])) == want or w in RANKS


def test_very_long_word():
    assert bpe.codec(PATH, None).encode(["x" * 100_000])[0] == np.array(LIB.encode_ordinary("x" * 100_000), "<u4").tobytes()


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    c = bpe.Codec(PATH, None)
    texts = ["one two three four", "five six", "one two"]
    for t in texts:
        assert c.encode([t])[0] == np.array(LIB.encode_ordinary(t), "<u4").tobytes()
