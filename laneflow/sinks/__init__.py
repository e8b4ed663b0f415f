from laneflow.sinks.files import (
    jam_document,
    measurement_lines,
    site_dictionary_lines,
    write_jam_document,
    write_jam_lines,
    write_measurement_csv,
    write_partitions,
    write_rows,
    write_site_dictionary,
    write_snapshots,
)

__all__ = [
    "jam_document",
    "measurement_lines",
    "site_dictionary_lines",
    "write_jam_document",
    "write_jam_lines",
    "write_measurement_csv",
    "write_partitions",
    "write_rows",
    "write_site_dictionary",
    "write_snapshots",
]
