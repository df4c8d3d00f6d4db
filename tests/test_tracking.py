"""Tracking updates as keyed state: odd payloads, repeats, late events, and going on after a stop."""

import json

from pyspark.sql import Row

from parcelflow.streaming import tracking


def a(number, status, *events):
    return json.dumps({"data": {"tracking_number": number, "delivery_status": status, "origin_info": {"trackinfo": [{"checkpoint_date": t, "tracking_detail": s, "location": p} for t, s, p in events]}}})


def b(number, status, *events, event="TRACKING_UPDATED"):
    told = [{"events": [{"time_iso": t, "description": s, "location": p} for t, s, p in events]}]
    return json.dumps({"event": event, "data": {"number": number, "track_info": {"latest_status": {"status": status}, "tracking": {"providers": told}}}})


def test_each_event_counts_once_whoever_tells_it_and_whenever(spark):
    one, two, late = ("t1", "Left ", None), ("t2", "Came", "HUB"), ("t0", "Booked", "HUB")
    lines = [
        ("A", 1, a("N1", "transit", two, one), 0), ("A", 2, a("N1", "transit", two, one), 0), ("B", 3, b("N1", "Delivered", ("t2", "Came", " HUB "), ("t1", "Left", "")), 1),
        ("A", 4, a("N1", "transit", two, one, late), 2), ("B", 5, b("N2", "NotFound"), 1), ("B", 6, b("N2", "Delivered", two, event="TRACKING_STOPPED"), 1),
        ("A", 7, "no json", 0), ("A", 8, None, 0), ("A", 9, a(None, "transit", one), 2), ("C", 10, a("N1", "transit", one), 2),
    ]
    found = tracking.waves(spark, spark.createDataFrame(lines, "provider string, arrival long, value string, wave int"), "wave", 3)
    assert {tuple(r) for r in found.collect()} == {("N1", "A", "In Transit", "Delivered", 3, 4, 3), ("N2", "B", "Information Received", "Processing", 0, 1, 1)}


class _Store:
    """A value, a list and timers of one shipment, and how often they are called."""

    def __init__(self):
        self.calls, self.held, self.entries, self.timers = 0, None, [], []

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return _Entries(self)

    def get(self):
        self.calls += 1
        return self.held

    def update(self, row):
        self.calls, self.held = self.calls + 1, row

    def clear(self):
        self.held = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class _Entries:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return iter(list(self.store.entries))

    def appendList(self, rows):
        self.store.calls += 1
        self.store.entries += rows

    def clear(self):
        self.store.entries = []


class _Clock(int):
    def getCurrentProcessingTimeInMs(self):
        return int(self)


def test_an_update_calls_the_store_a_few_times_however_many_events_it_tells():
    store, day, end = _Store(), tracking.REFRESH, tracking.EXPIRES
    shipment = tracking.Tracking()
    shipment.init(store)
    update = lambda at, events: list(shipment.handleInputRows(("N1",), iter([Row(number="N1", provider="A", arrival=at, current="In Transit", marks=json.dumps([f"m{k}" for k in events]))]), _Clock(at)))[0]
    assert update(0, range(500)).n_events == 500 and store.calls <= 6
    assert update(1, range(490, 510)).n_events == 510 and store.calls <= 12 and len(store.entries) == 510
    # Told again after a day, entries are written again, so that they live on; no event counts twice.
    assert update(day, range(3)).n_events == 510 and len(store.entries) == 513
    assert update(day + 1, range(3)).n_events == 510 and len(store.entries) == 513
    assert store.timers == [end]
    list(shipment.handleExpiredTimer(("N1",), _Clock(end), None))
    assert store.timers == [end, day + 1 + end] and store.held and store.entries
    list(shipment.handleExpiredTimer(("N1",), _Clock(day + 1 + end), None))
    assert store.held is None and not store.entries
