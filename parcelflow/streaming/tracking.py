"""Tracking updates of both vendors, pushed or pulled, as keyed state: each event once, and where a shipment stands.

An update is a payload: the vendor's current status and the events it tells (vendors tell whole histories again and again).
A shipment's state is a row (what it was told last, the status it has reached, counts) and a list of the events that were
seen, an entry each. Calls to the store cost more than all else, so an update makes a few of them, however many events it
tells: the list is read once, and what is new is appended at once. An event that is told again is appended again only
when its entry is older than REFRESH; an entry expires EXPIRES and REFRESH after it was written, so it outlives the last
telling by EXPIRES at least. A timer clears what is left of a shipment that has had no update for EXPIRES; so state is
bounded by what is alive. Repeats after that count anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..folders import work_dir
from ..operators.events import RANKS
from .pushes import payloads_of_both

#: How long state outlives the last update, and how old an entry gets before it is written again, in milliseconds: 180 days
#: and one.
EXPIRES, REFRESH = 180 * 24 * 3600 * 1000, 24 * 3600 * 1000
OUT = "number string, provider string, tracking_status string, status string, n_events long, n_updates long, n_changes long"
_SUMMARY = "tracking_status string, status string, n_events long, n_updates long, n_changes long, told_at long"
#: The store that such state needs; and no batches without lines, of which timers would ask for one after the other, so
#: that a call ends when it has caught up.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Tracking(StatefulProcessor):
    """Rows (number, provider, arrival, current, marks: of its events, as JSON) of a shipment to its new state.

    The last status told counts as tracking_status, a missing one too; status moves only to a rank that isn't less.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", _SUMMARY, EXPIRES)
        self.seen = handle.getListState("seen", "mark string, told_at long", EXPIRES + REFRESH)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, told = key[0], sorted(rows, key=lambda r: (r.arrival, r.provider))
        now, old = timerValues.getCurrentProcessingTimeInMs(), self.summary.get()
        tracking, status, n, updates, changes = old[:5] if old else (None, "Processing", 0, 0, 0)
        # Within a micro-batch an event counts once, however often it is told; of the list only its own entries are held.
        marks = dict.fromkeys(mark for r in told for mark in json.loads(r.marks))
        for mark, at in self.seen.get() if old and marks else ():
            if mark in marks:
                marks[mark] = max(at, marks[mark] or at)
        n += sum(at is None for at in marks.values())
        written = [(mark, now) for mark, at in marks.items() if at is None or now - at >= REFRESH]
        if written:
            self.seen.appendList(written)
        for r in told:
            updates, changes = updates + 1, changes + (r.current is not None and r.current != tracking)
            tracking = r.current
            mapped = "Processing" if r.current == "Information Received" else r.current
            if mapped in RANKS and RANKS[mapped] >= RANKS.get(status, 0):
                status = mapped
        self.summary.update((tracking, status, n, updates, changes, now))
        if not old:
            self.handle.registerTimer(now + EXPIRES)
        yield Row(number=number, provider=told[-1].provider, tracking_status=tracking, status=status, n_events=n, n_updates=updates, n_changes=changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The timer stands where the first update put it; if there were others since, it is put off."""
        old = self.summary.get()
        if old and old[5] + EXPIRES > timerValues.getCurrentProcessingTimeInMs():
            self.handle.registerTimer(old[5] + EXPIRES)
        else:
            self.summary.clear()
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def updates(lines: DataFrame) -> DataFrame:
    """number, provider, arrival, current and events of lines(provider, arrival, value): one parser for what is pushed
    and what is pulled, and for a table as for a stream."""
    return payloads_of_both(lines, ("arrival",))


@contextmanager
def _rocksdb(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def states(told: DataFrame) -> DataFrame:
    """The new state of each shipment that a micro-batch of updates touches (update mode; needs the RocksDB store).

    A line's events go to the Python workers as one string, each event once: items and fields cost far more there.
    """
    mark = lambda e: F.concat_ws("|", *(F.coalesce(e[c], F.lit("")) for c in ("ts", "status", "location")))
    marks = F.array_distinct(F.transform(F.coalesce("events", F.array()), mark))
    return told.select("number", "provider", "arrival", "current", F.to_json(marks).alias("marks")).groupBy("number").transformWithState(statefulProcessor=Tracking(), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")


def follow(spark: SparkSession, path: str, out: str, form: str = "json") -> None:
    """Take in all lines(provider, arrival, value) that have come to the folder since the last call, and append the states
    they make to out/states. State and progress are in out/checkpoint, so a call that was cut off is made good by the next.
    The folder's files are of one form, as Spark's readers name it.
    """
    lines = spark.readStream.schema("provider string, arrival long, value string").format(form).load(path)
    with _rocksdb(spark):
        run = states(updates(lines)).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
        run.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/states/batch={k}")).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each shipment: the one after most updates."""
    told = spark.read.schema(OUT).parquet(f"{out}/states")
    columns = [c.split()[0] for c in OUT.split(", ") if not c.startswith("number")]
    return told.groupBy("number").agg(F.max_by(F.struct(*columns), "n_updates").alias("s")).select("number", "s.*")


def waves(spark: SparkSession, lines: DataFrame, by: str, many: int) -> DataFrame:
    """The last states after lines(provider, arrival, value, and by: 0 to many - 1) have come in so many waves, each
    taken in before the next comes."""
    folder = work_dir(spark)
    for k in range(many):
        lines.where(F.col(by) == k).select("provider", "arrival", "value").write.mode("append").parquet(f"{folder}/in")
        follow(spark, f"{folder}/in", folder, "parquet")
    return newest(spark, folder)
