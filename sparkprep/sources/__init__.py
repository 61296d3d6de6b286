"""Scans and sinks."""

from sparkprep.sources.files import (  # noqa: F401
    read_csv,
    read_stage,
    scan_folder,
    write_stage,
)
