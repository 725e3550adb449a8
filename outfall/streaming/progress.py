"""Run progress: phases, changes, claims.  Each stream has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from outfall.functions.ship import by_value
from outfall.operators.ordered import previous_value
from outfall.operators.runs import TERMINAL

UNFINISHED = ("pending", "running")  # fixed values
CHANGE = "run_id string, ts timestamp, event_id bigint, payload string"
OPEN = ("queued", "running")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OVERDUE = "run_id string, status string, last_ts timestamp"


def run_phase(updates: DataFrame) -> DataFrame:
    """Phase of each run from its latest observed rows.

    ``updates``: run_id, ts, event_id, status, analyzer, stage_status.
    """
    at = [F.col("ts"), F.col("event_id")]

    def latest(analyzer: str):
        return F.max(F.when(F.col("analyzer") == analyzer, F.struct(*at, "stage_status")))["stage_status"].alias(analyzer)

    state = updates.groupBy("run_id").agg(F.max(F.struct(*at, "status"))["status"].alias("status"), latest("unpack"), latest("static"))
    phase = (
        F.when(F.col("status").isin(TERMINAL), "done")
        .when(F.col("static").isin(*UNFINISHED), "static").when(F.col("static").isNotNull(), "report")
        .when(F.col("unpack").isin(*UNFINISHED), "unpack").when(F.col("unpack").isNotNull(), "index").otherwise("queued")
    )
    return state.withColumn("phase", phase)


def with_payload(updates: DataFrame) -> DataFrame:
    return updates.withColumn("payload", F.concat_ws("|", "status", "analyzer", "stage_status"))


def progress_changes(updates: DataFrame) -> DataFrame:
    """Rows whose snapshot differs from the one before, up to the first terminal one."""
    order = F.struct("ts", "event_id")
    ends = updates.groupBy("run_id").agg(F.min(F.when(F.col("status").isin(TERMINAL), order)).alias("end"))
    rows = previous_value(with_payload(updates), ["run_id"], ["ts", "event_id"], F.date_trunc("DAY", F.col("ts")), F.col("payload"), "before")
    live = rows.join(ends, "run_id").where(F.col("end").isNull() | (order <= F.col("end")))
    return live.where(~F.col("payload").eqNullSafe(F.col("before"))).select("run_id", "ts", "event_id", "payload")


def with_state_store(df: DataFrame) -> DataFrame:
    """Stateful processors need a store with column families: set for streams started from this session."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


def _millis(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def _texts(values: list[str]) -> pd.Series:
    return pd.Series(values, dtype=object)


class Progress(StatefulProcessor):
    """The last snapshot of a run; a finished run is remembered for ``linger_ms`` of event time, then nothing of it is left."""

    def __init__(self, linger_ms: int):
        self.linger_ms = linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "payload string, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, done = self.last.get() if self.last.exists() else (None, False)
        if done:
            return
        words: dict[str | None, int] = {before: 0}
        parts = []  # per row two numbers and a code, however long the snapshots are
        for part in rows:
            codes = part.payload.map(lambda text: words.setdefault(text, len(words))).to_numpy(np.int32)
            parts.append((_millis(part.ts), part.event_id.to_numpy(np.int64), codes))
        at, event, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((event, at))
        at, event, code = at[order], event[order], code[order]
        names = list(words)
        final = np.array([(w or "").split("|")[0] in TERMINAL for w in names])
        ends = np.flatnonzero(final[code])
        live = slice(0, int(ends[0]) + 1) if len(ends) else slice(None)
        at, event, code = at[live], event[live], code[live]
        new = np.flatnonzero(code != np.concatenate(([0], code[:-1])))
        self.last.update((names[code[-1]], bool(len(ends))))
        if len(ends):
            self.handle.registerTimer(max(int(at[-1]) // 1000 + self.linger_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"run_id": _texts([key[0]] * len(new)), "ts": at[new].astype("datetime64[us]"), "event_id": event[new], "payload": _texts([names[c] for c in code[new]])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_stream(updates: DataFrame, delay: str = "1 hour", linger_s: int = 86_400) -> DataFrame:
    """Streaming twin: the last snapshot of each run is its state.

    Rows later than ``delay`` are dropped. Rows of a finished run are ignored for ``linger_s`` seconds of event time; a row after that, if it is not too
    late itself, begins the run anew.
    """
    rows = with_payload(updates).select("run_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "payload").withWatermark("ts", delay)
    return with_state_store(rows).groupBy("run_id").transformWithStateInPandas(Progress(linger_s * 1000), CHANGE, "Append", "EventTime")


def claim_once(claims: DataFrame) -> DataFrame:
    """The first claim of each run wins; redeliveries lose."""
    first = F.min(F.struct("ts", "event_id"))
    return claims.groupBy("run_id").agg(first.alias("f"), F.count("*").alias("deliveries")).select("run_id", "f.ts", "f.event_id", "deliveries")


def claim_stream(claims: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming twin within the watermark of redelivery."""
    return claims.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id"])


class Overdue(StatefulProcessor):
    """Status and time of the last update of each open run, with one event-time timer."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at bigint, event_id bigint")

    def _timer(self, at: int) -> int:
        return at // 1000 + self.timeout_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        best = (old[1], old[2], old[0]) if old else None
        for part in rows:
            at, event = _millis(part.ts), part.event_id.to_numpy(np.int64)
            i = int(np.lexsort((event, at))[-1])
            here = (int(at[i]), int(event[i]), part.status.iloc[i])
            best = here if best is None or here[:2] >= best[:2] else best
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if best[2] in OPEN:
            self.last.update((best[2], best[0], best[1]))
            self.handle.registerTimer(max(self._timer(best[0]), timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.last.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, at, _ = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"run_id": _texts([key[0]]), "status": _texts([status]), "last_ts": np.array([at]).astype("datetime64[us]")})

    def close(self) -> None:
        pass


def overdue_stream(updates: DataFrame, timeout_s: int, delay: str = "1 hour") -> DataFrame:
    """Open runs without an update for ``timeout_s`` seconds of event time, each once; a later update watches the run anew."""
    rows = updates.select("run_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status").withWatermark("ts", delay)
    return with_state_store(rows).groupBy("run_id").transformWithStateInPandas(Overdue(timeout_s * 1000), OVERDUE, "Append", "EventTime")


by_value(__name__)
