"""Logical tables: catalog, snapshot filters, sinks, and the adapter for the supplied test tables."""

from rackpulse.sources.catalog import (
    PAID, LOGICAL_TABLES, Catalog, snapshot, snapshot_range, snapshot_in, paid,
)
from rackpulse.sources.sinks import materialise, read_materialised

__all__ = ["PAID", "LOGICAL_TABLES", "Catalog", "snapshot", "snapshot_range", "snapshot_in", "paid",
           "materialise", "read_materialised"]
