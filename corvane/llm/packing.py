"""Operator 7, harmonic packing of tokenised documents into sequences of a fixed capacity.

A document is cut into pieces whose lengths fall into reciprocal-capacity classes: class k holds
lengths in (C/(k+1), C/k], and a sequence of class k takes exactly k pieces. Cuts are made at
C/1, C/2, C/4 ... C/32, so those classes fill their sequences without waste; only the last, short
piece of a document lands in a class with a little padding (at most 1/(k+1) with k >= 32).

Every worker fills the bins of its own partition, so there is no shuffle and no shared state. What
a worker has open at its end is laid end to end and cut into sequences whose sizes are powers of
two, which need no padding. A task holds at most one open bin per class.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import columns, pieces

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FINEST = 32  # the finest class that documents are cut for on purpose


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the letters from U+0100 on, in order."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(maxsize=4)
def token_ids(path: str):
    """text -> ids as the tokenizer file gives them without special tokens added.

    A byte-level BPE file whose ids follow its merges is the same thing as a table of ranks, which
    encodes several times faster; texts that hold an added token's string, and all other files, go
    through the file's own library.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()

    def by_file(text):
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
             and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
    if not plain:
        return by_file
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])):
        return by_file
    import public_tokenizers
    import tiktoken

    letter = byte_letters()
    ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(text):
        if any(a in text for a in added):
            return by_file(text)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return by_ranks


class Bins:
    """The open bins of one worker. `put` and `close` return finished pieces."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next, self.open = capacity, worker << 40, {}

    def cuts(self, n: int) -> list[int]:
        c = self.capacity
        out = [c] * (n // c)
        n %= c
        for k in (2 ** i for i in range(1, FINEST.bit_length())):
            if n and c % k == 0 and n >= c // k:
                out.append(c // k)
                n -= c // k
        return out + ([n] if n else [])

    def put(self, row_id, ids: np.ndarray):
        start, total = 0, len(ids)
        for n in self.cuts(total):
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append((row_id, start, ids[start:start + n].copy(), total))
            start += n
            if len(held) == k:
                yield from self.seal(self.open.pop(k))

    def seal(self, held):
        at = 0
        for row_id, start, ids, total in held:
            yield row_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at
            at += len(ids)
        self.next += 1

    def close(self):
        held = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in held)
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            bin_, need = [], size
            while need:
                row_id, start, ids, total = held[0]
                n = min(need, len(ids))
                bin_.append((row_id, start, ids[:n], total))
                need -= n
                if n == len(ids):
                    held.pop(0)
                else:
                    held[0] = (row_id, start + n, ids[n:], total)
            yield from self.seal(bin_)


def pack(df: DataFrame, path: str, row_id: str = "doc_id", text: str = "text", capacity: int = 2048,
         end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and then `end_id`; a null text is empty and so is one token long.
    Every id lies in exactly one piece, and the pieces of a sequence follow each other without a
    gap. Repeated rows and null ids are documents like others. An empty table gives no pieces.
    """
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(batches):
        encode, bins, rows = token_ids(path), Bins(capacity, TaskContext.get().partitionId()), []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
            rows.clear()
            return out

        for b in pieces(batches, 4 << 20):
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(body), np.uint32(end_id))
                rows.extend(bins.put(doc, ids))
                if len(rows) >= 20000:
                    yield batch()
        rows.extend(bins.close())
        if rows:
            yield batch()

    return columns(df, row_id, text).mapInArrow(run, PIECES)
