"""Shipment analytics as Spark jobs: reporting, ingest, label extraction, layout and tracking events."""
