"""Sources and sinks: CSV scans with the null-token convention, CSV export,
typed parquet tables, file-order surrogate keys."""

from .csv_io import read_csv_text, read_lookup_csv, read_menu_csv, write_csv
from .tables import append_table, create_table, drop_table, reset_table
from .keys import with_file_order_ids

__all__ = ["read_csv_text", "read_lookup_csv", "read_menu_csv", "write_csv",
           "append_table", "create_table", "drop_table", "reset_table", "with_file_order_ids"]
