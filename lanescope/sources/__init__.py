from lanescope.sources.export import write_by_day, write_clustered, write_csv
from lanescope.sources.tables import (
    conform,
    jdbc_options,
    read_checked,
    read_important_roads,
    read_table,
    unreadable_values,
)

__all__ = [
    "conform", "jdbc_options", "read_checked", "read_important_roads", "read_table",
    "unreadable_values", "write_by_day", "write_clustered", "write_csv",
]
