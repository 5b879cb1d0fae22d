from lexmill.sources.readers import (
    file_manifest,
    ingest,
    input_files,
    input_roots,
    log_history,
    read_files,
    read_log_history,
    read_table,
)
from lexmill.sources.writers import input_example, read_back, write_table

__all__ = [
    "file_manifest",
    "ingest",
    "input_example",
    "input_files",
    "input_roots",
    "log_history",
    "read_back",
    "read_files",
    "read_log_history",
    "read_table",
    "write_table",
]
