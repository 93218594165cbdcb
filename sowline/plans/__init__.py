"""Operators mapped onto the driver tables.

Each registered query is ``fn(spark, sf_dir) -> DataFrame`` and, where the
semantics are expressible in SQL, carries an equivalent DuckDB statement over
the same parquet tables.  Importing the family modules fills the registry.
"""

from sowline.plans.registry import QUERIES, ORACLE, register  # noqa: F401
from sowline.plans import machines, calendar, joins, progress, nesting, textual, planning, coverage, records, ordering, dates, feeds, bounded, daily  # noqa: F401,E402
