"""Session state as a stream: bounded turn history per session.

``retained_turns`` keeps each session's newest turns as list state, which a restart reads back from the checkpoint; a trigger emits the window of each
session that it changed.  ``bounded_turns`` keeps two counters only: a trigger emits those of its own turns that are inside the window when it ends.
"""

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators.session import add_facts

OUTPUT = "session string, turn_id bigint, number int, window_size int, user string, summary string, assistant_length int"
STATE = "next_id bigint, kept int"


def bounded_turns(turns: DataFrame, most=fixed.MAX_TURNS) -> DataFrame:
    """Number and bound a stream of turns (session, seq, user, assistant).

    However many turns one session sends, a task holds ``most`` of them plus one Arrow batch.
    """
    facts = add_facts(turns).select(F.col("session").cast("string").alias("session"), "seq", "user", "summary", "assistant_length")

    def step(key, batches, state: GroupState):
        next_id, kept = state.get if state.exists else (1, 0)
        newest, n = None, 0
        for pdf in batches:
            n += len(pdf)
            newest = pdf if newest is None else pd.concat([newest, pdf])
            newest = newest.nlargest(most, "seq")
        newest = newest.sort_values("seq")
        size = min(kept + n, most)
        state.update((next_id + n, size))
        k = len(newest)
        yield pd.DataFrame({
            "session": key[0], "turn_id": range(next_id + n - k, next_id + n), "number": range(size - k + 1, size + 1),
            "window_size": size, "user": newest["user"].values, "summary": newest["summary"].values,
            "assistant_length": newest["assistant_length"].values})

    return facts.groupBy("session").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


RETAINED = "session string, version bigint, number int, seq bigint, user string, assistant string, summary string"
_KEPT = "seq bigint, user string, assistant string, summary string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Retention(StatefulProcessor):
    """A session's newest turns by ``seq``, in whatever order they come, and how many turns it had."""

    def __init__(self, most, idle_ms):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle):
        self.kept = handle.getListState("kept", _KEPT, self.idle_ms)
        self.seen = handle.getValueState("seen", "n bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        names = [c.split()[0] for c in _KEPT.split(", ")]
        window = pd.DataFrame(list(self.kept.get()) if self.kept.exists() else [], columns=names)
        n = self.seen.get()[0] if self.seen.exists() else 0
        for pdf in rows:  # one Arrow batch at a time
            n += len(pdf)
            window = pd.concat([window, pdf[names]]) if len(window) else pdf[names]
            window = window.sort_values("seq", kind="stable").tail(self.most)
        self.seen.update((n,))
        self.kept.put([tuple(r) for r in window.astype({"seq": "int64"}).astype(object).itertuples(index=False)])
        yield pd.DataFrame({"session": str(key[0]), "version": n, "number": range(1, len(window) + 1), **{c: window[c].values for c in names}})

    def close(self):
        pass


def retained_turns(turns: DataFrame, most=fixed.MAX_TURNS, idle_ms=None) -> DataFrame:
    """(session, version, number, seq, user, assistant, summary) of a stream of turns (session, seq, user, assistant).

    Each trigger emits the whole window of every session it changed under a new ``version`` (the turns so far), numbered from 1; ``latest`` keeps the newest.
    A session without turns for ``idle_ms`` is forgotten.  State is list state in RocksDB: the session must name that provider (``ROCKSDB``).
    """
    facts = add_facts(turns).select(F.col("session").cast("string").alias("session"), F.col("seq").cast("bigint").alias("seq"), "user", "assistant", "summary")
    return facts.groupBy("session").transformWithStateInPandas(_Retention(most, idle_ms), RETAINED, "append", "ProcessingTime" if idle_ms else "None")


def latest(emitted: DataFrame) -> DataFrame:
    """The newest window of each session among emitted ones."""
    newest = emitted.groupBy("session").agg(F.max("version").alias("version"))
    return emitted.join(newest, ["session", "version"]).drop("version")


def run_retention(turns: DataFrame, folder: str, most=fixed.MAX_TURNS) -> DataFrame:
    """Drains a stream of turns through ``retained_turns`` into Parquet under ``folder`` and returns the latest windows; run again, it goes on where it stopped."""
    spark = turns.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        stream = retained_turns(turns, most).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
        stream.trigger(availableNow=True).start(f"{folder}/windows").awaitTermination()
    finally:
        spark.conf.set(key, before)
    return latest(spark.read.schema(RETAINED).parquet(f"{folder}/windows"))


def activity(events: DataFrame, minutes=5, late="10 minutes") -> DataFrame:
    """Activity per interval: the periodic autosave as a watermarked windowed aggregate."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type") \
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
