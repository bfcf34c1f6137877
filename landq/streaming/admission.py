"""At most so many accepted requests in any so many seconds for a client, judged in the order of event times.

Requests wait in the state until the watermark has passed them, so the answers depend neither on how the input is cut
into triggers nor on the order in which it arrives within the delay. What is older than the watermark when it arrives is
late: the stream drops it and counts it in its progress. A client's state is what it sent within the delay and what was
accepted within the window; a timer clears it when both have passed.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
ANSWER_DDL = "client string, request_id long, us long, accepted boolean"


def judged(window: deque, requests: Iterable[tuple[int, int]], limit: int, span: int) -> list[bool]:
    """A verdict for each (us, request_id) in order; ``window`` has the accepted times and is carried on."""
    verdicts = []
    for us, _ in requests:
        while window and window[0] <= us - span:
            window.popleft()
        verdicts.append(len(window) < limit)
        if verdicts[-1]:
            window.append(us)
    return verdicts


def _answers(client: str, requests: list[tuple[int, int]], verdicts: list[bool]) -> pd.DataFrame:
    return pd.DataFrame(
        {"client": client, "request_id": [r[1] for r in requests], "us": [r[0] for r in requests], "accepted": verdicts}
    ).astype({"request_id": "int64", "us": "int64", "accepted": "bool"})


class OrderedAdmission(StatefulProcessor):
    """Requests wait for the watermark; a timer for the first one that waits has them judged."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, request_id long")
        self.accepted = handle.getListState("accepted", "us long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.request_id) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1]) for r in self.waiting.get())
        ready = [r for r in waiting if r[0] <= passed]
        window = deque(sorted(r[0] for r in self.accepted.get()))
        verdicts = judged(window, ready, self.limit, self.span)
        while window and window[0] <= passed - self.span:
            window.popleft()
        rest = waiting[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.accepted.put([(us,) for us in window]) if window else self.accepted.clear()
        if rest:
            self._wake(rest[0][0])
        elif window:
            self._wake(window[-1] + self.span)
        for (us, request), accepted in zip(ready, verdicts):
            yield Row(client=key[0], request_id=request, us=us, accepted=accepted)

    def close(self) -> None:
        pass


def admit(requests: DataFrame, limit: int, seconds: int, delay: str) -> DataFrame:
    """client, request_id, us, accepted, given once the watermark is ``delay`` past a request.

    ``requests``: client (string), request_id (long), ts (timestamp). Equal times go by request_id.
    """
    timed = requests.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("client").transformWithState(
        statefulProcessor=OrderedAdmission(limit, seconds), outputStructType=ANSWER_DDL, outputMode="Append", timeMode="EventTime"
    )


def still_waiting(spark: SparkSession, checkpoint: str, limit: int, seconds: int) -> DataFrame:
    """Answers to the requests that wait in a stopped stream's state, as they would be if nothing else came."""

    def state(name: str) -> DataFrame:
        held = spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", "true")
        return held.load(checkpoint).select(F.col("key.client").alias("client"), "list_element.*")

    rows = state("waiting").select("client", "us", "request_id")
    rows = rows.unionAll(state("accepted").select("client", "us", F.lit(None).cast("long")))

    def judge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        new = group["request_id"].notna()
        window = deque(sorted(int(us) for us in group.loc[~new, "us"]))
        requests = sorted((int(us), int(r)) for us, r in zip(group.loc[new, "us"], group.loc[new, "request_id"]))
        return _answers(key[0], requests, judged(window, requests, limit, seconds * MICROS))

    return rows.groupBy("client").applyInPandas(judge, ANSWER_DDL)
