"""Operator 3, toxicity scores of texts restored from disguise by a noisy-channel decoder.

A disguised token is a lattice: a leet sign may stand for letters, a stretched letter for one or two,
a separator for nothing or for a word break. Viterbi search finds the reading that a character
trigram model of the whole corpus and the channel's costs make likeliest; tokens without disguise are
left alone. Tokens of any length and runs of three or more spaced letters are read whole, long ones in
overlapping pieces as well, since the few readings kept of a long token differ in few places; a run
of at most two different letters with one of them three times in succession is not taken for words.
Words and word beginnings of the restored text are the evidence.

What is learnt: the trigram counts from every document, and the evidence weights (log odds of the
training labels, each document judged without its own count) with a small logistic model from at
most TOXIC + CLEAN labelled documents, taken in the order of a hash of their ids. The trigram table has a fixed
size, and features are words of at least two of those TOXIC documents, so both are broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, pieces, stored
from .ngram_join import ngrams

TOXIC, CLEAN = 3000, 7000  # labelled documents learnt from, at most
LETTERS = 28  # a-z, any other letter, and 0 for a break
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
        "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
JOINTS = ".-_*~/\\ "
EDGE = ".,;:!?\"'()[]{}<>«»„“”…*#&%_~"
DISGUISED = re.compile(r"([^\W\d_])\1\1|[^\W\d_][0-9@$!|+(€£]+|[0-9@$|+(€£!]+[^\W\d_]|(?:[^\W_][.\-_*~/\\]){2,}[^\W_]")
SURE = 4.5  # log odds from which one word may be enough
KNOWN, SHORT = 300_000, 200  # tokens a worker remembers, and their length at most
PIECE = 48  # stretches of a long token that are read at once besides the whole; pieces overlap by half


def letter_class() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        if chr(c).isalpha():
            table[c] = 27
    table[0x3000:0xD800] = 27
    table[0xF900:0xFB00] = 27
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    return table


CLASS = letter_class()


def trigrams(text: str) -> np.ndarray:
    """Codes of the text's letter trigrams; what is not a letter is one break however long."""
    c = CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
    c = np.concatenate([[0, 0], c, [0]])
    keep = np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]
    keep[1] = True
    c = c[keep]
    return (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]


def _count(batches):
    total = np.zeros(LETTERS ** 3, np.int64)
    for b in pieces(batches, 4 << 20):
        for text in b.column(1).to_pylist():
            total += np.bincount(trigrams(text), minlength=LETTERS ** 3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(third letter | first two) over the whole corpus: LETTERS^3 sums come to the driver."""
    sums = docs.mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(LETTERS ** 3)
    n[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    n = n.reshape(LETTERS, LETTERS, LETTERS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + LETTERS)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    return np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings and costs of each stretch of a token."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c.isalpha():
            out.append([(c * n, 0.0)] if n < 3 else [(c, 0.5), (c * 2, 0.8)])
        elif c in JOINTS:
            out.append([("", 0.2), (" ", 1.5)])
        elif c in LEET:
            out.append([(x * k, 0.5 + (n > k)) for x in LEET[c] for k in {1, min(n, 2)}] + [(" ", 4.0)])
        else:
            out.append([(" ", 1.0)])
        i = j
    return out


def likeliest(stretches: list, lm: np.ndarray, best: int = 4) -> list[str]:
    """The likeliest readings, best first: Viterbi over the last two letters with `best` paths to each. A path
    is a linked list of its readings, so the work is linear in the token's length."""
    paths: dict = {(0, 0): [(0.0, None)]}
    for options in [*stretches, [(" ", 0.0)]]:
        new: dict = {}
        for (a, b), held in paths.items():
            for reading, extra in options:
                p, q, total = a, b, extra
                for ch in reading:
                    x = int(CLASS[ord(ch)])
                    if x == 0 and q == 0:
                        continue
                    total -= lm[p, q, x]
                    p, q = q, x
                new.setdefault((p, q), []).extend((cost + total, (path, reading)) for cost, path in held)
        paths = {k: sorted(v, key=itemgetter(0))[:best] for k, v in new.items()}
    out: dict = {}
    for _, path in sorted((x for v in paths.values() for x in v), key=itemgetter(0)):
        parts = []
        while path:
            path, reading = path
            parts.append(reading)
        out["".join(reversed(parts)).strip()] = None
        if len(out) == best:
            break
    return list(out)


def restore(token: str, lm: np.ndarray, best: int = 4) -> list[str]:
    return likeliest(lattice(token), lm, best)


def restored_words(token: str, lm: np.ndarray) -> list[str]:
    """Words of the likeliest readings of the whole token and, if it is long, of overlapping pieces."""
    stretches = lattice(token)
    parts = [stretches]
    if len(stretches) > PIECE:
        parts += [stretches[i:i + PIECE] for i in range(0, len(stretches) - PIECE // 2, PIECE // 2)]
    return [w for part in parts for text in likeliest(part, lm) for w in text.split()]


def tokens(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends; letters set apart by spaces are one token."""
    words = text.lower().split()
    lens = [len(w) for w in words]
    if lens.count(1) < 3:
        return words
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1 and (w.isalpha() or w in LEET):
            run.append(w)
            continue
        if len(run) > 2 and (len(set(run)) > 2 or not any(a == b == c for a, b, c in zip(run, run[1:], run[2:]))):
            out.append(" ".join(run))
        else:
            out += run
        run = []
        if w:
            out.append(w)
    return out


@dataclass
class Model:
    lm: np.ndarray
    weights: dict = field(default_factory=dict)  # feature -> log odds
    coef: tuple = (-20.0, 0.0, 0.0, 0.0)
    known: dict = field(default_factory=dict)

    def readings(self, token: str) -> list[str]:
        spaced = " " in token
        token = token if spaced else token.lstrip(EDGE).rstrip(EDGE + "$|")
        if spaced or DISGUISED.search(token):
            return restored_words(token, self.lm)
        return [token]

    def features(self, token: str) -> set[str]:
        out = set()
        for w in self.readings(token):
            w = w.strip(EDGE)
            if len(w) > 2:
                out.add(w)
                out.update("^" + w[:k] for k in (4, 5, 6) if len(w) >= k)
        return out

    def of_text(self, text: str) -> set[frozenset]:
        """The features of each distinct token."""
        out = set()
        for t in set(tokens(text)):
            f = self.known.get(t)
            if f is None:
                if len(self.known) > KNOWN // 4:
                    self.known.clear()
                f = frozenset(self.features(t))
                if len(t) <= SHORT:
                    self.known[t] = f
            out.add(f)
        return out

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The two strongest weights among the text's distinct tokens, and what the first is over `SURE`."""
        first = second = 0.0
        for t in set(tokens(text)):
            w = self.known.get(t)
            if w is None:
                if len(self.known) > KNOWN:
                    self.known.clear()
                w = max((self.weights.get(f, 0.0) for f in self.features(t)), default=0.0)
                if len(t) <= SHORT:
                    self.known[t] = w
            if w > second:
                first, second = max(first, w), min(first, w)
        return first, second, max(0.0, first - SURE)

    def score(self, text: str) -> float:
        z = self.coef[0] + float(np.dot(self.coef[1:], self.evidence(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), x.T @ (p - y) + ridge * c)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c


def rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic fit without negative coefficients: a column that would get one is left out."""
    use = list(range(x.shape[1]))
    while True:
        c = logistic(x[:, use], y)
        bad = [j for j, v in zip(use, c[1:]) if v < 0]
        if not bad:
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(j + 1 for j in use)]] = c
            return out
        use = [j for j in use if j not in bad]


def _odds(t, c, n_t, n_c, prior=2.0):
    """Log odds of a feature's documents against all, drawn towards none by `prior` documents of the usual mix."""
    p = n_t / max(1, n_t + n_c)
    return np.log((t + prior * p) / (c + prior * (1 - p))) - np.log(max(p, 1e-9) / max(1 - p, 1e-9))


def _looks(batches):
    """Two least hashes of a text's word triples. Near copies share them, other texts don't, so that copies of
    one document are not taken for evidence from many."""
    for b in batches:
        sets = [ngrams(t, 3) for t in b.column(0).to_pylist()]
        least = [[int((g * np.uint64(k)).view(np.int64).min()) if len(g) else 0 for g in sets] for k in (1, 0x9E3779B97F4A7C15)]
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, least)], names=["text", "y", "id", "m1", "m2"])


def _tally(model):
    def run(batches):
        m, seen = model.value, {}
        m.known = {}

        def out():
            part = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()),
                                               pa.array([v[1] for v in seen.values()], pa.int64())], names=["feature", "t", "c"])
            seen.clear()
            return part

        for b in pieces(batches, 1 << 20):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in frozenset().union(*m.of_text(text)):
                    v = seen.setdefault(f, [0, 0])
                    v[0 if y else 1] += 1
            if len(seen) > 400_000:
                yield out()
        if seen:
            yield out()

    return run


def _judged(model, counts, n_t, n_c):
    """(label, two strongest weights) of training documents, each without its own count."""

    def run(batches):
        m, table = model.value, counts.value
        m.known = {}
        for b in pieces(batches, 1 << 20):
            rows = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = [max((_odds(t - y, c - (1 - y), n_t - y, n_c - (1 - y)) for f in fs if f in table for t, c in (table[f],)
                          if t - y >= 2), default=0.0) for fs in m.of_text(text)]
                top = sorted([0.0, 0.0, *w])[-2:]
                rows.append((int(y), float(top[1]), float(top[0])))
            y, a, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(a), pa.array(s)], names=["y", "a", "s"])

    return run


def train(df: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "toxic", fold: int = 5) -> Model:
    """Learns from all texts of `df` (language model) and from labelled rows whose crc32(id) mod `fold` is not
    0 (weights). Null labels and ids are passed over, of several labels of an id the greatest counts. Texts of any
    length are read whole; repeated rows and near copies count once as evidence, each time in the language model. Without both kinds of labels every score is next to 0."""
    spark, docs = df.sparkSession, columns(df, row_id, text)
    model = Model(language_model(docs))
    known = labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{row_id}`").isNotNull() & ~held_out(F.col(f"`{row_id}`"), fold))
    known = known.groupBy(F.col(f"`{row_id}`").cast("long").alias("id")).agg(F.max((F.col(f"`{label}`") > 0).cast("int")).alias("y"))
    first = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # TOXIC + CLEAN rows at most
    looks = docs.join(chosen, "id").select("text", "y", "id").mapInArrow(_looks, "text string, y int, id long, m1 long, m2 long")
    order = F.struct(F.xxhash64("id").alias("h"), "id", "text", "m2")  # of near copies the same one stays in every run
    apart = looks.groupBy("y", "m1").agg(F.min(order).alias("r")).groupBy("y", "r.m2").agg(F.min("r").alias("r")).select("r.text", "y")
    sample = stored(apart.select("text", "y").repartition(24), "toxic-sample")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    if not n_t or not n_c:
        return model
    shared = spark.sparkContext.broadcast(model)
    tally = sample.mapInArrow(_tally(shared), "feature string, t long, c long").groupBy("feature").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t >= 2")
    odds = F.log((F.col("t") + 1) / (n_t + 1)) - F.log((F.col("c") + 1) / (n_c + 1))
    best = tally.filter(odds > 1).toArrow().to_pylist()  # words of the sample alone
    table = {r["feature"]: (r["t"], r["c"]) for r in best}
    judged = sample.mapInArrow(_judged(shared, spark.sparkContext.broadcast(table), n_t, n_c), "y long, a double, s double").toArrow()
    y, a, s = (judged.column(n).to_numpy() for n in ("y", "a", "s"))
    y, a, s = (v[np.lexsort((s, a, y))] for v in (y, a, s))  # sums in one order
    c = rising(np.column_stack([a, s, np.maximum(0, a - SURE)]), y)
    weights = {f: float(_odds(t, n, n_t, n_c)) for f, (t, n) in table.items() if t >= 3}
    return Model(model.lm, weights, tuple(float(v) for v in c))


def held_out(row_id: Column, fold: int = 5) -> Column:
    """crc32 of the id as text is divisible by `fold`; a null id is never learnt from either."""
    return F.coalesce(F.crc32(row_id.cast("string")) % fold == 0, F.lit(True))


def score_column(spark, model: Model, text: Column) -> Column:
    """The score of each text between 0 and 1; a null text is empty, and an empty text has a score. Very
    long texts are scored whole; equal texts have equal scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t or "") for t in texts], dtype="float64")

    return score(text)
