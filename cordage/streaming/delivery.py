"""Sending rows to topics so that a failure drops a row, never the query, and every row is accounted for."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "topic string, sent long, dropped long"
METRIC = "delivery"


class Transport(Protocol):
    """What a task sends by; made in the task, so it need not be picklable."""

    def send(self, topic: str, key: str | None, value: str) -> None:
        """Hand a row on, or raise."""

    def flush(self) -> Counter:
        """Wait for what is on its way; the rows of each topic that did not arrive."""


def deliver(rows: DataFrame, transport: Callable[[], Transport], retries: int = 2) -> DataFrame:
    """Send ``(key, value, topic)`` rows and give ``(topic, sent, dropped)``, a row a topic and task.

    A row is tried ``retries`` times more after it fails, and then dropped. A transport that can't be made or flushed drops what it
    had. Nothing that a transport raises gets out. Counts are observed under ``METRIC``. A task that Spark runs again
    sends again, so delivery is at least once; only what its last run gives is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, dropped = Counter(), Counter()
        try:
            sink = transport()
        except Exception:  # noqa: BLE001
            sink = None
        for b in batches:
            for key, value, topic in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                (sent if sink is not None and _sent(sink, topic, key, value, retries) else dropped)[topic] += 1
        if sink is not None:
            try:
                lost = Counter(sink.flush())
            except Exception:  # noqa: BLE001
                lost = Counter(sent)
            for topic, n in lost.items():
                n = min(n, sent[topic])
                sent[topic], dropped[topic] = sent[topic] - n, dropped[topic] + n
        topics = sorted({*sent, *dropped}, key=str)
        yield pa.RecordBatch.from_arrays([pa.array(topics, pa.string()), *(pa.array([c[t] for t in topics], pa.int64()) for c in (sent, dropped))], ["topic", "sent", "dropped"])

    counts = rows.select("key", "value", "topic").mapInArrow(run, COUNTS)
    return counts.observe(METRIC, F.sum("sent").alias("sent"), F.sum("dropped").alias("dropped"))


def _sent(sink: Transport, topic: str, key: str | None, value: str, retries: int) -> bool:
    for _ in range(1 + retries):
        try:
            sink.send(topic, key, value)
            return True
        except Exception:  # noqa: BLE001
            continue
    return False


def send_stream(rows: DataFrame, transport: Callable[[], Transport], counts: str, checkpoint: str, retries: int = 2, **trigger):
    """Send a stream's rows; each batch's counts are written to ``counts`` once, so their sums are the rows read."""
    told = deliver(rows, transport, retries)
    return told.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(counts)


class DeliveryListener(StreamingQueryListener):
    """Sums of what the session's queries sent and dropped, while they run."""

    def __init__(self):
        self.sent = self.dropped = self.rows = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        seen = event.progress.observedMetrics.get(METRIC)
        if seen is not None:
            self.sent, self.dropped, self.rows = self.sent + (seen["sent"] or 0), self.dropped + (seen["dropped"] or 0), self.rows + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
