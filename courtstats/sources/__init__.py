"""Sources and sinks: typed scans, multi-file unions, backfill, CSV I/O."""

from courtstats.sources.tables import TABLE_SCHEMAS, read_table, table, write_table

__all__ = ["TABLE_SCHEMAS", "read_table", "table", "write_table"]
