"""Readers and writers."""

from tillstar.sources.tables import DRIVER_TABLES, read_table  # noqa: F401
