"""Scans (parquet tables, delimited logs, header CSV), sinks, and the stand-in
tables that map the driver's test data onto the reference's inputs."""

from quarry.sources.tables import read_table, TABLES  # noqa: F401
from quarry.sources.delimited import read_weblog, read_weblog_tm, read_csv_inferred  # noqa: F401
from quarry.sources.sinks import (  # noqa: F401
    store_delimited, save_table, insert_positional, write_warehouse)
