"""Registered check queries: one per inventory operator, each over the driver
tables, plus the DuckDB oracle SQL that must return the same rows.

Importing this package registers everything; ``QUERIES`` and ``ORACLES``
are the two name-keyed dicts ``__spark_entry__`` exposes.
"""

from sparkprep.catalog.registry import ORACLES, QUERIES  # noqa: F401
from sparkprep.catalog import prep, profile, model  # noqa: F401,E402
