"""Stream forms of the batch operators, on Structured Streaming."""

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rules import count_if, share
from ..functions.text import tokens


def run_to_files(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs over all input there is now and stops. The file sink records each batch once, so a
    restart after a loss neither drops nor repeats rows."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/_progress")
         .trigger(availableNow=True).start(f"{path}/data"))
    q.awaitTermination()


@contextmanager
def disk_state(spark: SparkSession):
    """Streams started inside keep their state on the executors' disks, with a log of changes in the progress folder, so
    state neither fills the heap nor is lost with an executor."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ingest_incremental(stream: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """Appends rows whose key is neither in `done` nor among those that came before, whatever their batch. Keys that came
    are state, dealt by key and kept on disk: a batch reads its own keys, not the files of earlier batches. A null key
    counts as one key. A repeated batch is recorded once by the file sink."""
    with disk_state(stream.sparkSession):
        run_to_files(stream.join(done.select(key), key, "left_anti").dropDuplicates([key]), path)


def stream_exact_dedup(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First arrivals of each key; a key is remembered for the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_score(stream: DataFrame, score: Column, decide) -> DataFrame:
    """Stateless scoring: logits from a head column, then a decision on them."""
    return decide(stream.withColumn("z", score))


TOPIC_OUT = "conv_id bigint, turn bigint, vote string, escalate boolean"
TOPIC_STATE = "turns bigint, first string"


def _words(text: str) -> list[str]:
    return "".join(ch if ch.isalpha() or ch.isnumeric() else " " for ch in text.lower()).split()


def topic_switch(stream: DataFrame, time: str, delay: str, min_words=4, min_turns=3, cs=0.35, cn=0.2, bs=5.0, bn=2.0) -> DataFrame:
    """Decides for every user turn but a conversation's first whether the topic changed.

    State per conversation: user turns so far and the first turn's words. Turns older than the
    watermark are dropped; a conversation silent for the delay is forgotten. A trigger's
    turns of one conversation are put in turn order, so the trigger size bounds the memory.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def decide(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        turns, first = state.get if state.exists else (0, None)
        pdf = pd.concat(frames).sort_values("turn")
        out = []
        for turn, text in zip(pdf["turn"], pdf["text"]):
            words = _words(text)
            turns += 1
            if first is None:
                first = " ".join(sorted(set(words)))
                continue
            a, b = set(first.split()), set(words)
            shared = len(a & b)
            bm25 = 0.25 * shared
            cos = shared / ((len(a) * len(b)) ** 0.5) if a and b else 0.0
            guard = len(words) < min_words or turns < min_turns
            says = ["same" if s >= hi else "new" if s <= lo else "unsure" for s, hi, lo in ((bm25, bs, bn), (cos, cs, cn))]
            new = not guard and says == ["new", "new"]
            out.append((key[0], turn, "new" if new else "same", not guard and not new and "same" not in says and "new" in says))
        state.update((turns, first))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 86_400_000)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "vote", "escalate"])

    rows = stream.withWatermark(time, delay).select("conv_id", "turn", "text", time)
    return rows.groupBy("conv_id").applyInPandasWithState(
        decide, TOPIC_OUT, TOPIC_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class _TopicTurns(StatefulProcessor):
    """State of a conversation: waiting turns by time and turn, turns decided, words of the first, time of the last."""

    def __init__(self, idle_ms: int, min_words: int, min_turns: int, cs: float, cn: float, bs: float, bn: float):
        self.idle_ms, self.min_words, self.min_turns = idle_ms, min_words, min_turns
        self.limits = (bs, bn), (cs, cn)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, turn bigint", "words string")
        self.decided = handle.getValueState("decided", "turns bigint, first string, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = 0
        for pdf in rows:
            for at, turn, words in zip(pdf["at_ms"].tolist(), pdf["turn"].tolist(), pdf["words"]):
                self.waiting.updateValue((at, turn), (words,))
                self.handle.registerTimer(at)
                last = max(last, at)
        turns, first, before = self.decided.get() or (0, None, 0)
        self.decided.update((turns, first, max(last, before)))
        self.handle.registerTimer(max(last, before) + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        state = self.decided.get()
        if state is None:
            return iter(())
        turns, first, last = state
        due = sorted(k for k in self.waiting.keys() if k[0] <= now)
        out = []
        for k in due:
            words = self.waiting.getValue(k)[0].split()
            self.waiting.removeKey(k)
            turns += 1
            if first is None:
                first = " ".join(sorted(set(words)))
            else:
                out.append((key[0], k[1], *self.vote(turns, words, set(first.split()))))
        if last + self.idle_ms <= now and not any(True for _ in self.waiting.keys()):
            self.decided.clear()
        else:
            self.decided.update((turns, first, last))
        return iter([pd.DataFrame(out, columns=["conv_id", "turn", "vote", "escalate"])] if out else [])

    def vote(self, turns: int, words: list[str], first: set[str]) -> tuple[str, bool]:
        own = set(words)
        shared = len(first & own)
        scores = 0.25 * shared, shared / (len(first) * len(own)) ** 0.5 if first and own else 0.0
        says = ["same" if s >= hi else "new" if s <= lo else "unsure" for s, (hi, lo) in zip(scores, self.limits)]
        guard = len(words) < self.min_words or turns < self.min_turns
        new = not guard and says == ["new", "new"]
        return "new" if new else "same", not guard and not new and "same" not in says and "new" in says

    def close(self) -> None:
        pass


def topic_switch_in_order(stream: DataFrame, time: str, delay: str, idle_ms: int, min_words=4, min_turns=3, cs=0.35, cn=0.2, bs=5.0,
                          bn=2.0) -> DataFrame:
    """As `topic_switch`, with turns counted in event-time order (ties by turn) however triggers deal them: a turn waits in
    state until the watermark reaches it, when none before it can come any more. Turns behind the watermark are
    dropped, so a conversation's answer does not depend on the triggers but for what came later than `delay`. A
    conversation is forgotten `idle_ms` after its last turn; what comes then starts anew. Rows of equal time and turn are
    one turn, the last to come; null texts have no words; null ids are one conversation, null times are dropped.
    """
    rows = stream.filter(F.col(time).isNotNull() & F.col("turn").isNotNull()).withWatermark(time, delay).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.array_join(tokens(F.col("text")), " "), F.lit("")).alias("words"),
        F.unix_millis(time).alias("at_ms"), time)
    return rows.groupBy("conv_id").transformWithStateInPandas(
        _TopicTurns(idle_ms, min_words, min_turns, cs, cn, bs, bn), TOPIC_OUT, "append", "EventTime")


def windowed_decision_metrics(df: DataFrame, time: str, delay: str, length: str, accepted: Column, value: Column) -> DataFrame:
    """Rows, share accepted and mean value of accepted rows per time window. The same on a
    stream and on a table; on a stream a window comes out when the watermark has passed it."""
    return df.withWatermark(time, delay).groupBy(F.window(time, length).alias("w")).agg(
        F.count("*").alias("n"), share(accepted).alias("coverage"), F.avg(F.when(accepted, value)).alias("mean_value"))
