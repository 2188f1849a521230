"""Operator 6, byte-level BPE encoding and decoding by recursive SQL inside each partition.

A partition's distinct new words become token-position rows of a DuckDB table. A recursive query
joins neighbouring tokens to the merge table and contracts each word's leftmost pair of least rank
until no pair is left (`SHORT`). Long words contract all occurrences of that pair at once where
this gives the same result (`LONG`), in bursts of bounded size, so a word of a hundred thousand
letters neither piles up its states nor takes a step per letter. Decoding joins the ids to the
vocabulary and puts the bytes in order by an ordered aggregation.

There is no shuffle. Encoded words are kept between batches up to `WORDS`, then forgotten.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, pieces

WORDS = 400_000  # words a worker remembers
LETTERS = 64  # bytes from which a word is long
BURST = 2_000_000  # state rows of one recursive query over long words

SHORT = """WITH RECURSIVE state AS (
 SELECT word, pos, tok, lead(pos) OVER w AS npos, lead(tok) OVER w AS nxt, 0 AS step FROM start
 WINDOW w AS (PARTITION BY word ORDER BY pos)
 UNION ALL (
 WITH best AS (SELECT word, min(rank::BIGINT * 65536 + pos * 256 + npos) AS b FROM state JOIN merges ON tok = l AND nxt = r GROUP BY word),
 pair AS (SELECT word, (b // 65536)::INT AS made, b // 256 % 256 AS one, b % 256 AS two FROM best),
 gone AS (SELECT p.*, s.npos, s.nxt FROM state s JOIN pair p ON s.word = p.word AND s.pos = p.two)
 SELECT s.word, s.pos, CASE WHEN s.pos = one THEN made ELSE s.tok END AS tok, CASE WHEN s.pos = one THEN g.npos ELSE s.npos END AS npos,
  CASE WHEN s.pos = one THEN g.nxt WHEN s.npos = one THEN made ELSE s.nxt END AS nxt, s.step + 1 AS step
 FROM state s JOIN gone g USING (word) WHERE s.pos <> two))
SELECT word, tok FROM state SEMI JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step) ORDER BY word, pos"""

LONG = """WITH RECURSIVE state AS (
 SELECT word, pos, tok, 0 AS step FROM start
 UNION ALL (
 WITH seq AS (SELECT *, lead(tok) OVER w AS nxt, lead(tok, 2) OVER w AS nxt2, lag(tok) OVER w AS prv, row_number() OVER w AS i
   FROM state WHERE step < {steps} WINDOW w AS (PARTITION BY word ORDER BY pos)),
 ranked AS (SELECT s.*, rank FROM seq s JOIN merges ON tok = l AND nxt = r),
 least AS (SELECT *, i - row_number() OVER (PARTITION BY word ORDER BY i) AS chain FROM ranked
   QUALIFY rank = min(rank) OVER (PARTITION BY word)),
 turn AS (SELECT *, row_number() OVER (PARTITION BY word, chain ORDER BY i) % 2 = 1 AS mine FROM (
   SELECT * EXCLUDE (chain), i - row_number() OVER (PARTITION BY word ORDER BY i) AS chain FROM least)),
 checked AS (SELECT t.word, t.i, t.rank, min(t.i) OVER (PARTITION BY t.word) AS first,
   bool_or(coalesce(a.rank < t.rank, false) OR coalesce(b.rank < t.rank, false) OR coalesce(c.rank < t.rank, false))
    OVER (PARTITION BY t.word) AS unsafe
   FROM turn t LEFT JOIN merges a ON a.l = t.prv AND a.r = t.rank LEFT JOIN merges b ON b.l = t.rank AND b.r = t.nxt2
   LEFT JOIN merges c ON c.l = t.rank AND c.r = t.rank WHERE mine),
 chosen AS (SELECT word, i, rank FROM checked WHERE NOT unsafe OR i = first),
 joined AS (SELECT s.word, s.pos, s.step, coalesce(c.rank, s.tok) AS tok, g.i AS gone FROM seq s
   LEFT JOIN chosen c ON c.word = s.word AND c.i = s.i LEFT JOIN chosen g ON g.word = s.word AND g.i = s.i - 1
   WHERE s.word IN (SELECT word FROM chosen))
 SELECT word, pos, tok, step + 1 AS step FROM joined WHERE gone IS NULL))
SELECT word, list(tok ORDER BY pos) AS ids, any_value(last) AS steps
FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM state) WHERE step = last GROUP BY word"""

DECODE = """SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS body FROM tokens JOIN vocabulary USING (id) GROUP BY doc"""


class Codec:
    def __init__(self, path: str, pattern: str | None):
        import duckdb
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.letter = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        found = [(self.ranks[b[:k]], self.ranks[b[k:]], i) for b, i in self.ranks.items() for k in range(1, len(b))
                 if b[:k] in self.ranks and b[k:] in self.ranks]
        left, right, made = zip(*found) if found else ((), (), ())
        self.table("merges", l=left, r=right, rank=made)
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [b.hex() for b in self.ranks]})
        self.con.register("given", vocab)
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")

    def table(self, name: str, **cols) -> None:
        self.con.register("given", pa.table({k: pa.array(v, pa.int32()) for k, v in cols.items()}))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def start(self, tokens: list[np.ndarray]) -> None:
        sizes = np.array([len(t) for t in tokens])
        self.table("start", word=np.repeat(np.arange(len(tokens), dtype=np.int32), sizes), tok=np.concatenate(tokens),
                   pos=(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32))

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word; a word that is itself a token is that token."""
        out: list = [np.uint32(self.ranks[w]).tobytes() if w in self.ranks else None for w in words]
        todo = [i for i, w in enumerate(words) if out[i] is None and len(w) < LETTERS]
        for at in range(0, len(todo), 50_000):
            part = todo[at:at + 50_000]
            self.start([self.letter[np.frombuffer(words[i], np.uint8)] for i in part])
            found = self.con.execute(SHORT).fetchnumpy()
            word, flat = found["word"], found["tok"].astype("<u4").tobytes()
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            for w, i, j in zip(word[first].tolist(), (first * 4).tolist(), [*(first[1:] * 4).tolist(), len(flat)]):
                out[part[w]] = flat[i:j]
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = np.asarray(self.contract_long(self.letter[np.frombuffer(w, np.uint8)]), "<u4").tobytes()
        return out

    def contract_long(self, ids: np.ndarray) -> np.ndarray:
        while True:
            self.start([ids])
            steps = max(1, min(200, BURST // len(ids)))
            (_, ids, done), = self.con.execute(LONG.format(steps=steps)).fetchall()
            if done < steps:
                return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in self.known})
        if len(self.known) + len(new) > WORDS:
            self.known = {}
            new = list({w for ws in split for w in ws})
        self.known.update(zip(new, self.contract([w.encode() for w in new])))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        self.table("tokens", doc=np.repeat(np.arange(len(packed), dtype=np.int32), sizes),
                   pos=np.arange(sizes.sum(), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes),
                   id=np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
        out = [b""] * len(packed)
        for doc, body in self.con.execute(DECODE).fetchall():
            out[doc] = body
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str | None = None) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, row_id: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """id, ids: the token ids of each row as little-endian unsigned 32-bit integers, without special
    tokens. A null text is empty and has no ids. Rows are kept as they are, repeated or null ids too."""

    def run(batches):
        c = codec(path, pattern)
        for b in pieces(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(c.encode(b.column(1).to_pylist()), pa.binary())],
                                             names=["id", "ids"])

    return columns(df, row_id, text).mapInArrow(run, "id long, ids binary")


def decode(df: DataFrame, path: str) -> DataFrame:
    """id, ids, body: the bytes that the ids of `encode` stand for; null ids count as none."""

    def run(batches):
        c = codec(path, None)
        for b in pieces(batches, 1 << 20):
            ids = b.column(1).cast(pa.binary())
            body = c.decode([x or b"" for x in ids.to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids, pa.array(body, pa.binary())], names=["id", "ids", "body"])

    return df.select("id", "ids").mapInArrow(run, "id long, ids binary, body binary")


def token_count(ids):
    return (F.octet_length(ids) / 4).cast("long")
