"""Tracking pushes as a stream: JSON lines to events, each event once, and the state of every shipment.

State is kept by shipment: the last status, the accepted status and its rank, and the keys of the newest KEPT events that
were seen, so that vendors can send histories again (a push holds MOST events at most) and state stays bounded. Arrival
order counts, as in operators.events.fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import work_dir
from ..functions.carriers import STATUSES_A, STATUSES_B, map_status
from ..operators.events import RANKS

PUSH = "number string, events array<struct<seq: long, ts: string, status: string, location: string>>"
_OUT = "number string, tracking_status string, status string, n_events long"
#: Keys of events that are kept for each shipment, and events of a push that count.
KEPT, MOST = 1000, 20
_STATE = "tracking_status string, status string, n_events long, seen string"


def read_pushes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each event of each pushed line, files in the order of their time."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    pushed = lines.select(F.from_json("value", PUSH).alias("p")).where("p.number is not null")
    return pushed.select("p.number", F.explode("p.events").alias("e")).select("number", "e.*")


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    tracking, status, n, seen = state.get if state.exists else (None, "Processing", 0, "")
    known = set(seen.split("\n")) if seen else set()
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for ts, new, place in zip(rows["ts"], rows["status"], rows["location"], strict=True):
        # An event without a place is never equal to another.
        mark = None if place is None or ts is None or new is None else f"{ts}|{new.strip()}|{place.strip()}"
        if mark in known:
            continue
        if mark:
            known.add(mark)
        n, tracking = n + 1, new
        mapped = "Processing" if new == "Information Received" else new
        if mapped in RANKS and RANKS[mapped] >= RANKS.get(status, 0):
            status = mapped
    state.update((tracking, status, n, "\n".join(sorted(known)[-KEPT:])))  # keys begin with the time
    yield pd.DataFrame({"number": [key[0]], "tracking_status": [tracking], "status": [status], "n_events": [n]})


def states(events: DataFrame) -> DataFrame:
    """The newest state of each shipment that a micro-batch touches (update mode)."""
    return events.groupBy("number").applyInPandasWithState(_apply, _OUT, _STATE, "update", "NoTimeout")


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    files = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(files.schema)
    single = [f.rpartition("/")[2] for f in files.inputFiles()] == [name]
    return stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)


def newest_states(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The last state of each shipment after all events(number, seq, ts, status, location) that are there now.

    Each micro-batch appends the states it touched to a table; the one with most events is a shipment's last.
    """
    out = work_dir(spark)
    run = states(events).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
    run.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{out}/states")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(_OUT).parquet(f"{out}/states")
    return told.groupBy("number").agg(F.max_by(F.struct("tracking_status", "status", "n_events"), "n_events").alias("s")).select("number", "s.*")


def hourly_totals(spark: SparkSession, events: DataFrame) -> DataFrame:
    """hour, status and events of all events that are there now, as micro-batches count them."""
    out = work_dir(spark)
    run = hourly(events).select(F.col("hour.start").alias("hour"), "status", "events").writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
    run.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{out}/hours")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("hour timestamp, status string, events long").parquet(f"{out}/hours").groupBy("hour", "status").agg(F.max("events").alias("events"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and status, late ones within the watermark included."""
    timed = events.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "status").agg(F.count("*").alias("events"))


# The payloads of the two vendors.
_A = "data struct<tracking_number: string, delivery_status: string, origin_info: struct<trackinfo: array<struct<checkpoint_date: string, tracking_detail: string, location: string>>>>"
_B = (
    "event string, data struct<number: string, track_info: struct<latest_status: struct<status: string>,"
    " tracking: struct<providers: array<struct<events: array<struct<time_iso: string, description: string, location: string>>>>>>>"
)


def _of(p: Column, vendor: str) -> tuple[Column, Column, Column]:
    """Number (null where the line is no update), current status and events of a parsed payload."""
    data = p["data"]
    if vendor == "A":
        number, latest, told = data["tracking_number"], map_status(data["delivery_status"], STATUSES_A), data["origin_info"]["trackinfo"]
        names = ("checkpoint_date", "tracking_detail", "location")
    else:
        info = data["track_info"]
        number, latest = F.when(p["event"] == "TRACKING_UPDATED", data["number"]), map_status(info["latest_status"]["status"], STATUSES_B)
        told, names = F.try_element_at(info["tracking"]["providers"], F.lit(1))["events"], ("time_iso", "description", "location")
    event = lambda e: F.struct(e[names[0]].alias("ts"), F.trim(e[names[1]]).alias("status"), F.trim(F.coalesce(e[names[2]], F.lit(""))).alias("location"))
    return number, latest, F.transform(F.slice(F.reverse(F.coalesce(told, F.array())), 1, MOST), event)


def payloads(lines: DataFrame, vendor: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """number, carried columns, current (canonical status) and events (oldest first, at most MOST) of vendor A's or B's
    JSON lines in the column value.

    Works on streams and tables. Lines without a number, and B's that aren't updates, go; events may be missing.
    """
    # A row of its own for what was parsed, so that a line is parsed once and not for each use of its fields.
    pushed = lines.select(*carried, F.explode(F.array(F.from_json("value", _A if vendor == "A" else _B))).alias("p"))
    number, latest, events = _of(F.col("p"), vendor)
    return pushed.where(number != "").select(number.alias("number"), *carried, latest.alias("current"), events.alias("events"))


def payloads_of_both(lines: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """As payloads, of lines(provider, value, ...) of both vendors in one pass; those of other providers go."""
    is_a = F.col("provider") == "A"
    read = F.struct(F.when(is_a, F.from_json("value", _A)).alias("a"), F.when(~is_a, F.from_json("value", _B)).alias("b"))
    pushed = lines.where(F.col("provider").isin("A", "B")).select("provider", *carried, F.explode(F.array(read)).alias("p"))
    a, b = _of(F.col("p.a"), "A"), _of(F.col("p.b"), "B")
    number, latest, events = (F.when(is_a, x).otherwise(y) for x, y in zip(a, b, strict=True))
    return pushed.where(number != "").select(number.alias("number"), "provider", *carried, latest.alias("current"), events.alias("events"))
